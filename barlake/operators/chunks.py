"""Windows of bounded reach over one long series in many tasks: chunks of rows, each with a halo of the rows before it.

A step whose windows look back over no more than reach rows gives the same values on a chunk that begins reach rows early.
The rows of a halo are copied to the chunks that need them, take part in the windows, and are left out of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk, and the least share of them that is not halo, as a divisor.
ROWS, THIN = 50_000, 4


def in_chunks(df: DataFrame, step: Callable[[DataFrame], DataFrame], reach: int, rows: int = ROWS) -> DataFrame:
    """step(df), where step's windows are over the bars of a symbol and look back over reach rows at most, for recursions the
    rows after which what came before no longer shows. df has rn, the number of each row within its symbol.

    Chunks are of rows rows, or more where halos would make up too much of them. Within step the symbol is a pair of symbol
    and chunk, so that its windows, groups and joins by symbol are dealt by chunk.
    """
    rows = max(rows, reach // THIN + 1)
    own, last = F.floor(F.col("rn") / rows), F.floor((F.col("rn") + reach) / rows)
    spread = df.withColumn("_chunk", F.explode(F.sequence(own, last)))
    spread = spread.withColumns({"_own": F.col("_chunk") == own, "symbol": F.struct(F.col("symbol").alias("name"), F.col("_chunk").alias("chunk"))}).drop("_chunk")
    out = step(spread)
    kept = out.where("_own") if "_own" in out.columns else out.join(spread.where("_own").select("symbol", "close_time"), ["symbol", "close_time"], "left_semi")
    return kept.withColumn("symbol", F.col("symbol.name")).drop("_own")
