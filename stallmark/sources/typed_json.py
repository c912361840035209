"""Checked reading of JSON documents: their types are kept (VARIANT), and wrong ones are told by the field's path.

A ``Shape`` is an object with typed fields. Reading follows three rules: a required
field has to be there with its type, an optional one may be missing or null, and a loose one
counts only where it has its type. A boolean is no number.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, NUMBER, FLAG, TEXTS = "text", "number", "boolean", "texts"


@dataclass(frozen=True)
class Shape:
    """``optional`` fields are of one kind or a shape; ``first`` fields are loose lists of which the first entry, if an object, has a shape."""

    required: tuple[str, ...] = ()
    optional: dict[str, Union[str, "Shape"]] = field(default_factory=dict)
    first: dict[str, "Shape"] = field(default_factory=dict)
    #: Loose fields: lists of texts, and lists of objects with one text.
    texts: tuple[str, ...] = ()
    each: dict[str, str] = field(default_factory=dict)


def at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def kind_of(value: Column) -> Column:
    """What a variant holds: text, number, boolean, list, object, nothing (JSON's null); null if there is none."""
    schema = F.schema_of_variant(value)
    names = F.create_map(*(F.lit(x) for x in ("STR", TEXT, "BOO", FLAG, "VOI", "nothing", "OBJ", "object", "ARR", "list")))
    return F.coalesce(F.try_element_at(names, F.substring(schema, 1, 3)), F.when(schema.isNotNull(), NUMBER))


def _wrong(found: Column, wanted: str, path: str, required: bool) -> Column:
    """A message if the kind found is not the one wanted, else null."""
    got = F.concat(F.lit(f"{path}: expected {wanted}, got "), found)
    if required:
        return F.when(found.isNull(), F.lit(f"{path}: missing field")).when(found != wanted, got)
    return F.when(~found.isin("nothing", wanted), got)


def _messages(value: Column, shape: Shape, path: str, inside: str = "") -> Column:
    """The messages about the fields of an object (of the one at ``inside``), as an array with nulls."""
    own = [_wrong(kind_of(at(value, inside + name)), TEXT, f"{path}.{name}", True) for name in shape.required]
    parts = [F.array(*own)] if own else []
    none = F.array().cast("array<string>")
    for name, kind in shape.optional.items():
        found = kind_of(at(value, inside + name))
        wrong = F.array(_wrong(found, kind if isinstance(kind, str) else "object", f"{path}.{name}", False))
        parts.append(wrong if isinstance(kind, str) else F.when(found == "object", _messages(value, kind, f"{path}.{name}", f"{inside}{name}.")).otherwise(wrong))
    for name, kind in shape.first.items():
        first = f"{inside}{name}[0]"
        parts.append(F.when(kind_of(at(value, first)) == "object", _messages(value, kind, f"{path}.{name}[0]", f"{first}.")).otherwise(none))
    return F.concat(*parts)


def problems(value: Column, shape: Shape, path: str) -> Column:
    """All messages about a variant, an empty array if it has the shape."""
    found = kind_of(value)
    other = F.array(F.concat(F.lit(f"{path}: expected object, got "), F.coalesce(found, F.lit("nothing"))))
    return F.when(found == "object", F.array_compact(_messages(value, shape, path))).otherwise(other)


def texts(value: Column, name: str) -> Column:
    """The texts of a loose list; null if it is none."""
    return F.transform(F.filter(at(value, name, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))


def _inner_texts(value: Column, name: str, key: str) -> Column:
    return F.transform(at(value, name, "array<variant>"), lambda x: F.when(F.schema_of_variant(at(x, key)) == "STRING", at(x, key, "string")))


def read(value: Column, shape: Shape, inside: str = "") -> Column:
    """A struct with the fields of a variant that has the shape (``problems`` tells): required and optional ones first, then the loose ones."""
    types = {TEXT: "string", NUMBER: "double", FLAG: "boolean"}
    cells = [at(value, inside + n, "string").alias(n) for n in shape.required]
    for name, kind in shape.optional.items():
        cells.append((at(value, inside + name, types[kind]) if isinstance(kind, str) else read(value, kind, f"{inside}{name}.")).alias(name))
    cells += [read(value, kind, f"{inside}{name}[0].").alias(name) for name, kind in shape.first.items()]
    cells += [texts(value, inside + n).alias(n) for n in shape.texts]
    cells += [_inner_texts(value, inside + n, key).alias(n) for n, key in shape.each.items()]
    return F.struct(*cells)


def entries(pages: DataFrame, name: str) -> DataFrame:
    """pages with ``entry`` (a variant), a row for each entry of the list ``name`` of its JSON ``text``, and the page's own ``problem``.

    A page without the list (or a null text) has no entries; one that is no JSON, no object, or has no
    list there has one row with a problem and no entry.
    """
    page = F.col("_page")
    rows = pages.withColumn("_page", F.try_parse_json("text")).withColumn("_found", kind_of(at(page, name)))
    whole = kind_of(page)
    problem = (
        F.when(page.isNull() & F.col("text").isNotNull(), F.lit("page: not JSON")).when(whole != "object", F.concat(F.lit("page: expected object, got "), whole))
        .when(~F.col("_found").isin("list", "nothing"), F.concat(F.lit(f"{name}: expected list, got "), F.col("_found")))
    )
    rows = rows.withColumn("problem", problem)
    listed = F.when(F.col("problem").isNotNull(), F.array(F.lit(None).cast("variant"))).when(F.col("_found") == "list", at(page, name, "array<variant>"))
    return rows.select(*pages.columns, "problem", F.posexplode(listed).alias("place", "entry"))


def refused(pages: DataFrame, name: str, shape: Shape) -> DataFrame:
    """pages (all columns) with ``place`` of an entry and ``problems``, a row for each entry, or page, that cannot be read."""
    rows = entries(pages, name)
    own = F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(problems(F.col("entry"), shape, f"{name}[]"))
    return rows.withColumn("problems", own).where(F.size("problems") > 0).select(*pages.columns, F.when(F.col("problem").isNull(), F.col("place")).alias("place"), "problems")


def checked(pages: DataFrame, name: str, shape: Shape, column: str) -> DataFrame:
    """(column), a struct for each entry of the pages' list; an error that names the first field that is wrong, whatever is read of the rest."""
    rows = entries(pages, name)
    first = F.coalesce("problem", F.get(problems(F.col("entry"), shape, f"{name}[]"), F.lit(0)))
    sound = rows.where(F.when(first.isNotNull(), F.raise_error(first).cast("boolean")).otherwise(True))
    return sound.select(read(F.col("entry"), shape).alias(column))
