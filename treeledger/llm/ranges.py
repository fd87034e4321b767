"""Ranges of an id that hold about the same number of rows each, found from the ids alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.shared import stored

# Ranges at most; larger tables get larger ranges. Bounds the list of first ids on the driver.
MAX_RANGES = 16_384
# The id that a missing id counts as.
LEAST = -(1 << 63)


def range_starts(rows: DataFrame, key: str, size: int) -> list[int]:
    """The ids at which new ranges begin, ascending; equal ids fall into one range, null counts as least."""
    ids = stored(rows.selectExpr(f"coalesce(CAST({key} AS LONG), {LEAST + 1}L - 1L) AS id"), "ids")
    wanted = max(1, min(MAX_RANGES, ids.count() // size))
    dealt = ids.repartitionByRange(wanted, "id")
    firsts = dealt.groupBy(F.expr("spark_partition_id()")).agg(F.expr("min(id) AS id")).limit(MAX_RANGES).collect()
    return sorted({row.id for row in firsts})[1:]


def range_number(key: str, starts: list[int]) -> str:
    """SQL for how many ranges begin at or before an id, by halving steps."""
    if not starts:
        return "0"
    steps = ", ".join(str(1 << n) for n in reversed(range(len(starts).bit_length())))
    listed = "array(" + ", ".join(f"{s}L" if s > LEAST else f"({s + 1}L - 1L)" for s in starts) + ")"
    value = f"coalesce(CAST({key} AS LONG), {LEAST + 1}L - 1L)"
    return f"aggregate(array({steps}), 0, (at, step) -> if(get({listed}, at + step - 1) <= {value}, at + step, at))"
