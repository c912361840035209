"""Greedy grouping of listings: each joins the first group whose leader it matches.

Listings are taken in the order (listing_id, provider, scan order); a leader is
the first listing of its group. So the leaders are the independent set that comes first in that order in
the graph of matches, and it is found in parallel:

- **Matches** come from an inverted index. Two token sets that match share at
  least a fixed part of the smaller one (``least_share``), so that one of the rarest tokens of the smaller is in the
  larger: the index has all tokens of a set, and is asked for those few. What meets there is scored exactly.
- **Rounds.** The first ``FIRST`` listings of each query are decided, then ``GROWTH`` times as
  many, and so on: the rounds grow with the logarithm of the listings, not with their groups. The matches among the undecided listings of a
  round are an edge list; whatever has no undecided earlier match is a leader, what matches one is not, until
  no edge is left. The new leaders are then offered to all later listings, which
  each take the earliest that they match. Near copies leave with the first rounds, so that no list of all their pairs arises.

That is the sequential result, but no task ever holds a query's listings. Equal token sets are decided once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DeduplicationConfig
from ..functions.similarity import decision, features, pair_score
from ..functions.text import fingerprint
from ..shared import cut, cut_counted, numbered

#: Listings of each query that are decided in the first round, and how many times as many by the end of each further one.
FIRST, GROWTH = 256, 16


def qualifies(a: Column, b: Column, config: DeduplicationConfig) -> Column:
    """Do two ``features`` belong to one group?"""
    d = decision(pair_score(a, b, config.match_config), config.match_config)
    return d.isin("same_product", "possible_match") if config.include_possible_matches else d == "same_product"


def least_share(config: DeduplicationConfig) -> float:
    """The least part of the smaller of two matching sets that they have in common; 0 if sets with nothing in common match."""
    c = config.match_config
    need = (c.possible_threshold if config.include_possible_matches else c.same_threshold) - 0.5e-4 - 1e-9  # scores are rounded

    def best(share: float) -> float:
        base = (1 - c.overlap_weight) * share / (2 - share) + c.overlap_weight * share  # of sets of one size, else it is lower
        models = max(base, base + (1 - base) * c.shared_model_boost)
        return max(models, models + (1 - models) * c.shared_brand_boost, models * c.brand_conflict_factor)

    if need <= 0:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if best(mid) >= need else (mid, high)
    return max(low, 1e-9)


def _indexed(sets: DataFrame, share: float) -> DataFrame:
    """sets (query, s, k, f) with ``place`` in the query, ``id``, tokens from rare to frequent, and how many of them to look up."""
    placed = cut(numbered(sets, "query", [F.col("k")], "place").withColumn("id", F.monotonically_increasing_id()))
    tokens = placed.select("query", "id", F.explode("s").alias("token"))
    often = tokens.groupBy("query", "token").agg(F.count("*").alias("often"))
    rare = tokens.join(often, ["query", "token"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("rare"))
    looked_up = F.size("s") - F.greatest(F.lit(1), F.ceil(F.size("s") * share - 1e-6)) + 1
    return placed.join(rare.select("id", F.col("rare.token").alias("tokens")), "id").withColumn("looked_up", looked_up.cast("int"))


def _meeting(left: DataFrame, right: DataFrame, config: DeduplicationConfig) -> DataFrame:
    """(a, b) of a row of left and a row of right, as structs, that match: once for each token by which they meet."""
    side = lambda name: F.struct("id", "place", "k", "f", F.size("tokens").alias("n")).alias(name)
    few = lambda df, name: df.select("query", F.explode(F.slice("tokens", 1, F.col("looked_up"))).alias("token"), side(name))
    every = lambda df, name: df.select("query", F.explode("tokens").alias("token"), side(name))
    met = few(left, "a").join(every(right, "b"), ["query", "token"]).where("a.n <= b.n")
    if left is not right:
        met = met.select("a", "b").unionByName(every(left, "a").join(few(right, "b"), ["query", "token"]).where("a.n > b.n").select("a", "b"))
    common = F.size(F.array_intersect("a.f.tokens", "b.f.tokens"))  # what most pairs fail, before the whole score
    enough = (F.col("a.id") != F.col("b.id")) & (common >= F.least("a.n", "b.n") * least_share(config) - 1e-6)
    return met.where(enough & qualifies(F.col("a.f"), F.col("b.f"), config)).select("a", "b")


def _followers(todo: DataFrame, config: DeduplicationConfig) -> DataFrame | None:
    """(id) of the rows of todo that match an earlier leader among them; null if none matches another."""
    earlier = F.col("a.place") < F.col("b.place")
    first, second = F.when(earlier, F.col("a.id")).otherwise(F.col("b.id")), F.when(earlier, F.col("b.id")).otherwise(F.col("a.id"))
    edges, n = cut_counted(_meeting(todo, todo, config).select(first.alias("a"), second.alias("b")).distinct())
    out = None
    while n:
        waiting = edges.select(F.col("b").alias("a")).distinct()
        gone = edges.join(waiting, "a", "left_anti").select("b").distinct()
        left = edges.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti")
        step, n = cut_counted(left.select("a", "b").unionByName(gone.select(F.lit(None).cast("long").alias("a"), "b")), F.col("a").isNotNull())
        part = step.where("a is null").select(F.col("b").alias("id"))
        out, edges = part if out is None else out.unionByName(part), step.where("a is not null")
    return out


def assign_groups(df: DataFrame, config: DeduplicationConfig | None = None, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """df (query, listing_id, provider, ordinal, tokens, ...) with ``leader``, a struct that names the group."""
    c = config or DeduplicationConfig()
    key = F.struct("listing_id", "provider", "ordinal")
    df = df.withColumn("k", key)
    if not c.enabled:
        return df.withColumnRenamed("k", "leader")
    # One candidate for each set of tokens: equal sets match with score 1. Without tokens nothing matches.
    df = df.withColumn("s", F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t != "")))).withColumn("lone", F.size("s") == 0)
    sets = df.where(~F.col("lone")).groupBy("query", "s").agg(F.min("k").alias("k")).withColumn("f", features(F.col("s"), c.match_config))
    share = least_share(c)
    if share == 0:  # everything matches
        done = sets.groupBy("query").agg(F.min("k").alias("leader"))
        out = df.join(done, ["query"], "left")
        return out.withColumn("leader", F.when(~F.col("lone"), F.col("leader")).otherwise(F.col("k"))).drop("k", "s", "lone")
    rows = cut(_indexed(sets, share))
    most = rows.agg(F.max("place")).first()[0] or 0
    todo, bound, done = rows, first, None
    while True:
        now = todo if bound >= most else todo.where(F.col("place") <= bound)
        followers = _followers(now, c)
        leaders = now if followers is None else cut(now.join(followers, "id", "left_anti"))
        later = todo if followers is None and bound < most else todo.join(leaders.select("id"), "id", "left_anti")
        if followers is None and bound >= most:
            part = leaders.select("id", F.col("k").alias("leader"))
        else:
            taken = _meeting(leaders, later, c).where("a.place < b.place").groupBy(F.col("b.id").alias("id")).agg(F.min(F.struct("a.place", "a.k")).alias("leader")).select("id", "leader.k")
            part = cut(leaders.select("id", F.col("k").alias("leader")).unionByName(taken.withColumnRenamed("k", "leader")))
        done = part if done is None else done.unionByName(part)
        if bound >= most:
            break
        todo, bound = cut(todo.join(part.select("id"), "id", "left_anti")), bound * growth
    known = rows.select("query", "s", "id").join(done, "id").drop("id")
    out = df.join(known, ["query", "s"], "left")
    return out.withColumn("leader", F.coalesce("leader", "k")).drop("k", "s", "lone")


def canonical(df: DataFrame, config: DeduplicationConfig | None = None) -> DataFrame:
    """One row for each (query, leader): its best listing in ``c``, fingerprint, size, is_duplicate and sorted providers."""
    c = config or DeduplicationConfig()
    priority = F.coalesce(*(F.when(F.col("provider") == p, i) for i, p in enumerate(c.provider_priority)), F.lit(len(c.provider_priority)))
    order = F.struct(priority, -F.size(F.array_distinct("tokens")), "listing_id", "provider", "ordinal")
    own = [x for x in df.columns if x not in ("query", "leader")]
    out = df.groupBy("query", "leader").agg(F.min_by(F.struct(*own), order).alias("c"), F.count("*").alias("group_size"), F.sort_array(F.collect_set("provider")).alias("providers"))
    return out.withColumn("fingerprint", fingerprint(F.col("c.tokens"), F.col("c.n_currency"), F.col("c.n_condition"))).withColumn("is_duplicate", F.col("group_size") > 1)


def totals(groups: DataFrame) -> DataFrame:
    """(query, total_groups, total_input, duplicates_removed); sizes add up to the input."""
    out = groups.groupBy("query").agg(F.count("*").alias("total_groups"), F.sum("group_size").alias("total_input"))
    return out.withColumn("duplicates_removed", F.col("total_input") - F.col("total_groups"))
