"""Write changes as text records."""

from pyspark.sql import DataFrame

from treeledger.operators.export import raw_lines


def write_raw(delta: DataFrame, path: str, nul: bool = False) -> None:
    """One record per change in the order of new paths; records end with a line feed or NUL."""
    ordered = delta.orderBy("path", "status")
    raw_lines(ordered, nul).write.option("lineSep", "\0" if nul else "\n").text(path)
