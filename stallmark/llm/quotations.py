"""Chat formatting: quoted passages linked to the messages that they come from.

A line that starts with ``>`` signs is quoted, at the level of their number; a
line ``On ... wrote:`` in front belongs to the quotation. Neighbouring lines of one
level are one paragraph, however they are wrapped (an empty line ends it), and
each sentence of a quoted paragraph is a passage; normalised (lower case, single spaces) and
hashed it meets the first message of the conversation that has the same sentence, or the same
line, in its own words. A message replies to the earlier one of which it
quotes most passages at the lowest level. Without quotation it begins a thread, at its own turn; a thread is a message
with the replies to it, each followed by its own replies.

Passages are aggregated before each join: one that a million messages share is one
row. The order inside threads takes rounds that grow with the logarithm of their depth, over replies alone, and
no row holds a path. The place of a message in its conversation is counted over ranges of the sorted rows,
so that no task has a whole conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark import cut, cut_seen, small

_MARK = r"^[ \t]*(?:>[ \t]*)+"
_ANNOUNCED = r"^On .*wrote:\s*$"


def level_of(line: Column) -> Column:
    """Number of the ``>`` signs that a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 0), "[^>]", ""))


def normal(passage: Column) -> Column:
    """In lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(passage), r"\s+", " "))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: ~x.rlike(_ANNOUNCED))


def own_words(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them."""
    return F.trim(F.array_join(F.filter(_lines(text), lambda x: level_of(x) == 0), "\n"))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paragraphs(text: Column) -> Column:
    """The runs of lines of one level, up to an empty line, as structs (level, lines); lines are normalised and none is empty."""
    marked = F.transform(_lines(text), lambda x: F.struct(level_of(x).alias("level"), normal(F.regexp_replace(x, _MARK, "")).alias("body")))

    def grouped(lines: Column) -> Column:
        size = F.size(lines)
        before = lambda i: F.element_at(lines, F.greatest(i - 1, F.lit(1)))
        starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.element_at(lines, i)["level"] != before(i)["level"]) | (before(i)["body"] == ""))

        def run(first: Column, end: Column) -> Column:
            bodies = F.transform(F.slice(lines, first, end - first), lambda x: x["body"])
            return F.struct(F.element_at(lines, first)["level"].alias("level"), F.filter(bodies, lambda b: b != "").alias("lines"))

        found = _with(starts, lambda s: F.transform(s, lambda first, k: run(first, F.coalesce(F.try_element_at(s, k + 2), size + 1))))
        return F.when(size > 0, found)

    return F.filter(F.coalesce(_with(marked, grouped), F.array().cast("array<struct<level:int,lines:array<string>>>")), lambda p: F.size(p["lines"]) > 0)


def sentences(lines: Column) -> Column:
    """The sentences of a paragraph (its end is one): a full stop, question or exclamation mark and a space are between them."""
    return F.split(F.regexp_replace(F.array_join(lines, " "), "([.!?]) ", "$1\n"), "\n")


def _hashed(passage: str) -> Column:
    return F.sha2(F.col(passage).cast("binary"), 256).alias("h")


def replies(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each row: ``conv_id, turn, role, text, level, n_quoted, n_linked, parent, thread, position``.

    ``text`` is without quotations, ``level`` the deepest quotation level,
    ``n_quoted`` the number of quoted passages, ``n_linked`` those found in an
    earlier message, ``parent`` the turn replied to (null if none is quoted),
    ``thread`` the turn of the message that its thread begins with (its own without a parent) and ``position`` the place, from 1, of the message in its
    conversation: threads by turn, in each a message before its replies, these by turn, each with all that replies to it before the next; rows of one turn by role and text.
    Of several messages with a passage the first one has it; of parents with equally many passages
    at the lowest level the last. Null and empty
    texts have no passages; a message with a null conversation or turn links with nothing and has no position;
    repeated rows stay, as do messages that are all quotation (with an empty text). Other columns are ignored,
    an empty table gives no row. Texts of any length and with any number of quoted lines are read whole.
    """
    base = messages.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).cast("string").alias("x"))
    parts = base.where("c is not null and t is not null").select("c", "t", F.explode(paragraphs(F.col("x"))).alias("p")).select("c", "t", "p.level", "p.lines")
    quoted = parts.where("level > 0").select("c", "t", "level", F.explode(sentences(F.col("lines"))).alias("p"))
    quoted = cut(quoted.select("c", "t", "level", _hashed("p")).groupBy("c", "t", "level", "h").agg(F.count("*").alias("n")))
    # Only passages that someone quotes are looked for.
    wanted, seen = cut_seen(quoted.select("c", "h").distinct())
    own = parts.where("level = 0").select("c", "t", F.explode(F.array_union(sentences(F.col("lines")), "lines")).alias("p")).select("c", "t", _hashed("p"))
    own = cut(own.join(small(wanted, seen["n"]), ["c", "h"], "left_semi").groupBy("c", "h").agg(F.min("t").alias("source")))
    met = quoted.join(own, ["c", "h"], "left").withColumn("source", F.when(F.col("source") < F.col("t"), F.col("source")))
    votes = cut(met.groupBy("c", "t", "level", "source").agg(F.sum("n").alias("n")))
    best = F.min_by("source", F.struct("level", -F.col("n"), -F.col("source"))).alias("parent")
    link = votes.groupBy("c", "t").agg(F.max("level").alias("level"), F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"))
    parent, seen = cut_seen(votes.where("source is not null").groupBy("c", "t").agg(best))
    out = base.join(link.join(parent, ["c", "t"], "left"), ["c", "t"], "left")
    out = out.select("c", "t", "r", own_words(F.col("x")).alias("text"), F.coalesce("level", F.lit(0)).alias("level"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_quoted", "n_linked")), "parent")
    if seen["n"]:
        out = out.join(_threads(parent), ["c", "t"], "left").withColumns({"thread": F.coalesce("thread", "t"), "place": F.coalesce("place", F.lit(0))})
    else:
        out = out.withColumns({"thread": F.col("t"), "place": F.lit(0)})
    return _placed(out).drop("place").withColumnsRenamed({"c": conv_id, "t": turn, "r": role})


def _threads(links: DataFrame) -> DataFrame:
    """(c, t, thread, place) of each message with a parent: the turn that its thread begins with, and its place there, from 1, each reply before the next sibling.

    The place of a reply is that of its parent, and one, and the sizes of its earlier siblings with all that replies to them. Sizes and sums along
    ancestors are added up by pointers that jump twice as far in each round, until all are at a beginning.
    """
    upward = lambda df, *more: df.select("c", F.col("t").alias("up"), F.col("up").alias("next"), *more)
    nodes = links.select("c", "t", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"))
    left = 1
    while left:
        below = nodes.where("up is not null").groupBy("c", F.col("up").alias("t")).agg(F.sum("size").alias("more"))
        met = nodes.join(below, ["c", "t"], "left").join(upward(nodes), ["c", "up"], "left")
        nodes, seen = cut_seen(met.select("c", "t", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), F.count("up").alias("left"))
        left = seen["left"]
    # Sums over earlier siblings, in ranges: a message may have any number of replies.
    ranged = links.join(nodes.select("c", "t", "size"), ["c", "t"]).repartitionByRange("c", "parent", "t")
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("c", "parent", "_range").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("c", "parent").orderBy("_range")) - F.col("_sum")
    sums = sums.select("c", "parent", "_range", before.alias("_before"))
    own = F.sum("size").over(Window.partitionBy("c", "parent", "_range").orderBy("t")) - F.col("size")
    placed = ranged.join(sums, ["c", "parent", "_range"]).withColumn("place", F.col("_before") + own + 1)
    nodes, left = cut(placed.select("c", "t", F.col("parent").alias("up"), F.col("parent").alias("thread"), "place")), 1
    while left:
        met = nodes.join(upward(nodes, F.col("thread").alias("_thread"), F.col("place").alias("_place")), ["c", "up"], "left")
        place, thread = F.col("place") + F.coalesce("_place", F.lit(0)), F.coalesce("_thread", "thread")
        nodes, seen = cut_seen(met.select("c", "t", F.col("next").alias("up"), thread.alias("thread"), place.alias("place")), F.count("up").alias("left"))
        left = seen["left"]
    return nodes.select("c", "t", "thread", "place")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with ``position``: counted in each range of the sorted rows, and from range to range by their sums."""
    lone = F.col("c").isNull() | F.col("t").isNull()
    ordered = rows.where(~lone).repartitionByRange("c", "thread", "place", "t", "r").sortWithinPartitions("c", "thread", "place", "t", "r", "text")
    ordered = cut(ordered.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ranges = ordered.groupBy("c", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("c").orderBy("_range")) - F.col("_n")
    ranges = cut(ranges.select("c", "_range", (F.col("_first") - before - 1).alias("_zero")))
    placed = ordered.join(ranges, ["c", "_range"]).withColumn("position", F.col("_at") - F.col("_zero")).select(*rows.columns, "position")
    return placed.unionByName(rows.where(lone).withColumn("position", F.lit(None).cast("long")))


def conversations(messages: DataFrame, *, conv_id: str = "conv_id", **names) -> DataFrame:
    """The rows of ``replies`` thread by thread, by a range sort that splits long conversations too."""
    return replies(messages, conv_id=conv_id, **names).orderBy(conv_id, "position")
