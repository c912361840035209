"""Ordered results as files, written by all tasks: what is too large to be printed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(ordered: DataFrame, form: str, folder: str, columns: Sequence[str]) -> None:
    """An ordered table in a new folder: JSON lines of all its columns, or CSV of the given ones with a header in each file.

    Files follow one another in the order of the rows (Spark sorts by ranges), so that their names sort as the rows do. Lists are joined by
    semicolons in CSV, as they are when printed. Fails if the folder exists; an empty table gives a folder without rows.
    """
    if form == "json":
        ordered.write.json(folder)
        return
    kinds = dict(ordered.dtypes)
    cells = [F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]
    ordered.select(*cells).write.options(header=True, escape='"').csv(folder)
