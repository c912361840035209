"""Price strategies in Python: over (price, count) pairs, with a state that can be merged."""

from __future__ import annotations

import pickle
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PairStrategy
from ..shared import send_package

#: Prices that one call of ``update`` sees, about.
PART = 100_000


def estimates(kept: DataFrame, keys: list[str], strategy: PairStrategy) -> DataFrame:
    """(keys, e) from rows with keys, price, c and n, the size of the group.

    A large group is dealt in parts by its prices, each part becomes a state in a task of its own, and only states meet. Parts are sorted
    by price and states by their bytes, so that results do not depend on the order of rows.
    """
    send_package(kept.sparkSession)

    @F.pandas_udf("binary")
    def part(price: pd.Series, count: pd.Series) -> bytes:
        order = np.argsort(price.to_numpy(), kind="stable")
        return pickle.dumps(strategy.update(strategy.start(), price.to_numpy()[order], count.to_numpy()[order]))

    @F.pandas_udf("double")
    def whole(states: pd.Series) -> float:
        found = strategy.finish(reduce(strategy.merge, (pickle.loads(s) for s in sorted(states))))
        return float("nan") if found is None else float(found)

    parts = kept.groupBy(*keys, F.pmod(F.xxhash64("price"), F.ceil(F.col("n") / PART)).alias("_part")).agg(part("price", "c").alias("_state"))
    return parts.groupBy(*keys).agg(F.nullif(whole("_state"), F.lit(float("nan"))).alias("e"))


def modal_price(width: float) -> PairStrategy:
    """The middle of the band of this width that has most listings, of equal ones the lowest; the state is a count for each band."""

    def update(state: Counter, prices: np.ndarray, counts: np.ndarray) -> Counter:
        bands, place = np.unique(np.floor(prices / width), return_inverse=True)
        state.update(dict(zip(bands.tolist(), np.bincount(place, weights=counts).astype("int64").tolist(), strict=True)))
        return state

    return PairStrategy("modal_price", Counter, update, lambda a, b: a + b, lambda s: (min(s, key=lambda band: (-s[band], band)) + 0.5) * width if s else None)
