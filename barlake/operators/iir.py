"""First-order recursions (EMA, Wilder) as a blocked scan: windows only, no join and no loop over bars."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barlake.functions.rolling import up_to_here

#: Rows of a block, at most, and the largest exponent of the weights in one.
BLOCK, EXPONENT = 2048, 600


@dataclass(frozen=True)
class Smooth:
    """y = (1 - alpha) y' + alpha x from the first value on, told once least values are there."""

    name: str
    source: str
    alpha: float
    least: int


def ema(name: str, source: str, n: int) -> Smooth:
    return Smooth(name, source, 2 / (n + 1), n)


def wilder(name: str, source: str, n: int) -> Smooth:
    return Smooth(name, source, 1 / n, n)


def memory(*specs: Smooth) -> int:
    """Rows after which a recursion no longer shows what came before: its weight is below 1e-17."""
    return max(s.least + math.ceil(40 / -math.log1p(-s.alpha)) for s in specs)


def smooth(df: DataFrame, *specs: Smooth) -> DataFrame:
    """df with a column for each spec. df has symbol, close_time and rn; sources have nulls at their head only.

    Within blocks of rows the recursion is a running sum of scaled values; a block begins with what the blocks before
    it leave over, of which those beyond 1e-17 are left out. All specs share the windows.
    """
    size = min(BLOCK, *(int(EXPONENT / -math.log1p(-s.alpha)) for s in specs))
    blk = df.withColumns({"_blk": F.floor(F.col("rn") / size), "_pos_in": (F.col("rn") % size).cast("double")} | {f"_seen{k}": F.count(s.source).over(up_to_here()) for k, s in enumerate(specs)})
    inside = W.partitionBy("symbol", "_blk").orderBy("close_time").rowsBetween(W.unboundedPreceding, 0)
    local = {}
    for k, s in enumerate(specs):
        keep = math.log1p(-s.alpha)
        weight = F.when(F.col(f"_seen{k}") == 1, 1.0).otherwise(s.alpha)
        local[f"_local{k}"] = F.exp(F.col("_pos_in") * keep) * F.sum(F.coalesce(F.col(s.source) * weight * F.exp(-F.col("_pos_in") * keep), F.lit(0.0))).over(inside)
    blk = blk.withColumns(local)
    whole, carry = W.partitionBy("symbol").orderBy("_blk"), {}
    for k, s in enumerate(specs):
        left = (1 - s.alpha) ** size
        reach = max(1, math.ceil(40 / -math.log(left))) if left > 0 else 1
        end = lambda m, k=k: F.coalesce(F.max_by(f"_local{k}", "rn").over(whole.rangeBetween(-m, -m)), F.lit(0.0))
        carry[f"_carry{k}"] = sum((end(m) * left ** (m - 1) for m in range(1, reach + 1)), F.lit(0.0))
    out = blk.withColumns(carry)
    done = {s.name: F.when(F.col(s.source).isNotNull() & (F.col(f"_seen{k}") >= s.least), F.col(f"_local{k}") + F.exp((F.col("_pos_in") + 1) * math.log1p(-s.alpha)) * F.col(f"_carry{k}")) for k, s in enumerate(specs)}
    return out.select(*df.columns, *(v.alias(n) for n, v in done.items()))
