"""Connected components of a graph given as a table of links."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.shared import prepare, stored

# Links that a task contracts at once.
_CONTRACTED = 1 << 18


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the given links, as links from the smallest node to each other one."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(side) for side in spanning_stars(a, b)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= _CONTRACTED:
            yield flush()
            held = []
    if held:
        yield flush()


def connected_components(links: DataFrame) -> DataFrame:
    """The node and the smallest node of its component, for each node that has a link.

    ``links`` has columns ``a`` and ``b``, in any order and number; a null or equal pair is no link.
    Tasks first contract what they hold; then large and small stars alternate until nothing moves.
    The minimum of a node is aggregated before it is shuffled and joined back, so a node with very
    many links never gathers them in one task.
    """
    prepare(links.sparkSession)
    links = links.selectExpr("CAST(a AS LONG) AS a", "CAST(b AS LONG) AS b").where("a <> b")
    stars = stored(links.mapInArrow(_contract, "a long, b long").distinct(), "links")
    before = None
    while True:
        state = stars.agg(F.expr("count(1)"), F.expr("sum(pmod(xxhash64(a, b), 1L << 40))")).first()
        if state == before:
            return stars.selectExpr("b AS node", "a AS component")
        before = state
        both = stars.selectExpr("a AS node", "b AS other").union(stars.selectExpr("b AS node", "a AS other"))
        least = both.groupBy("node").agg(F.expr("least(node, min(other)) AS low"))
        large = both.where("other > node").join(least, "node").selectExpr("low AS a", "other AS b").distinct()
        up = large.groupBy("b").agg(F.expr("min(a) AS low"))
        small = (
            large.join(up, "b")
            .selectExpr("explode(array(struct(low AS a, a AS b), struct(low AS a, b))) AS link")
            .selectExpr("link.a", "link.b")
            .where("a <> b")
            .distinct()
        )
        stars = stored(small, "stars")
