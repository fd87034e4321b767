"""Embedding near-dedup: an epsilon grid order join.

Vectors are scaled to length one, so a cosine of at least c is a distance of at most
eps = sqrt(2 - 2c). All of them are turned onto the leading principal directions of the whole table
and fall into grid cells of the width eps. Within a label they are sorted by cell and cut into
intervals of similar size. Pairs of intervals whose bounding boxes lie further apart than eps can
hold no link and are skipped, whole runs of them at once by the boxes around runs; of the others, a
task halves both intervals again and again, skips what is provably distant, and compares the small
intervals that are left, in double precision.

Equal vectors of a label form a class that takes part once, so copies are never expanded into pairs.
For each vector a pair of intervals yields the number of vectors linked and a few links that connect
the same components; never all links.

Nulls: vectors that are null, zero, or hold null or non-finite components link with nothing, and so
do vectors without a label, and vectors of another length than the label's others. Each is its own
component. Rows that share a vec_id count as one node with several vectors. Rows without vec_id are
returned with no component. Other columns are ignored. An empty table gives an empty result.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.components import connected_components, spanning_stars
from treeledger.llm.shared import prepare, stored
from treeledger.operators.spread import rank_in_groups

# Leading directions that make up the grid.
GRID_DIMENSIONS = 8
# Vectors in an interval that is sent to a task, and in one that is compared without more halving.
INTERVAL = 2048
LEAF = 128
# Boxes of one level that a box of the next one holds.
FAN = 16
# Rounding of a product of two vectors of length one; links this close to the limit are computed anew.
_ROUNDING = 1e-9


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of outer products of a task's vectors, for each length of vectors."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = [np.frombuffer(v, np.float64) for v in batch.column(0).to_pylist()]
        for width in {len(v) for v in vectors}:
            m = np.array([v for v in vectors if len(v) == width])
            m = np.hstack([m / np.linalg.norm(m, axis=1, keepdims=True), np.ones((len(m), 1))])
            sums[width] = sums.get(width, 0) + m.T @ m
    for width, m in sums.items():
        n = len(m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n * n, width)), pa.array(np.arange(n * n)), pa.array(m.ravel())], ["width", "place", "value"]
        )


def _directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The leading principal directions, for each length of vectors; sums over all rows."""
    rows = (
        vectors.select("unit")
        .mapInArrow(_scatter, "width long, place long, value double")
        .groupBy("width", "place")
        .agg(F.expr("sum(value) AS value"))
        .toPandas()
    )
    found = {}
    for width, part in rows.groupby("width"):
        n = int(width) + 1
        m = np.zeros(n * n)
        m[part["place"].to_numpy()] = part["value"].to_numpy()
        m = m.reshape(n, n)
        mean = m[:-1, -1] / m[-1, -1]
        _, directions = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        found[int(width)] = directions[:, ::-1][:, :GRID_DIMENSIONS]
    return found


def _turn(directions: dict[int, np.ndarray], eps: float):
    """Add the position on the grid's directions and a text that sorts like the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for value in batch.column(2).to_pylist():
                unit = np.frombuffer(value, np.float64)
                position = (unit / np.linalg.norm(unit)) @ directions[len(unit)]
                at.append(position.tobytes())
                cells.append((np.floor(position / eps).astype(np.int32) + (1 << 15)).clip(0, 65535).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.binary()), pa.array(cells, pa.binary())],
                [*batch.schema.names, "at", "cell"],
            )

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounding box of each interval."""
    low: dict[tuple, np.ndarray] = {}
    high: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for label, part, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
            p, key = np.frombuffer(at, np.float64), (label, part)
            low[key] = np.minimum(low[key], p) if key in low else p
            high[key] = np.maximum(high[key], p) if key in high else p
    keys = list(low)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int64()),
            pa.array([low[k].tolist() for k in keys], pa.list_(pa.float64())),
            pa.array([high[k].tolist() for k in keys], pa.list_(pa.float64())),
        ],
        ["label", "part", "low", "high"],
    )


def _around(boxes: DataFrame) -> DataFrame:
    """The bounding box of each run of FAN neighbours in the order of the grid."""
    # Short vectors have fewer directions.
    side = lambda f, name: f"filter(array({', '.join(f'{f}(get({name}, {i}))' for i in range(GRID_DIMENSIONS))}), x -> x IS NOT NULL) AS {name}"
    return boxes.groupBy("label", F.expr(f"part DIV {FAN} AS part")).agg(F.expr(side("min", "low")), F.expr(side("max", "high")))


def interval_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """label, one, two: the pairs of intervals, each with itself too, whose boxes lie within eps of each other.

    Boxes of neighbours in grid order are joined to wider boxes, level by level, up to one per label. From
    there pairs are followed down: what lies below two boxes that are further apart than eps is never met,
    so work follows the pairs that are left and not the square of a label's intervals.
    """
    levels = [boxes]
    top = boxes.agg(F.expr("max(part)")).first()[0] or 0
    while top > 0:
        levels.append(stored(_around(levels[-1]), "boxes"))
        top //= FAN
    near = f"""aggregate(zip_with(zip_with(l1, h2, (l, h) -> l - h), zip_with(l2, h1, (l, h) -> l - h),
        (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x) <= {(eps + 1e-9) ** 2}D"""
    children = lambda name: f"explode(sequence({name} * {FAN}, {name} * {FAN} + {FAN - 1})) AS {name}"
    pairs = levels.pop().selectExpr("label", "part AS one", "part AS two", "low AS l2", "high AS h2")
    while levels:
        below = levels.pop()
        one = below.selectExpr("label", "part AS one", "low AS l1", "high AS h1")
        two = below.selectExpr("label", "part AS two", "low AS l2", "high AS h2")
        # Parts of the first box against the whole second one, then against its parts.
        halfway = pairs.selectExpr("label", children("one"), "two", "l2", "h2").join(one, ["label", "one"]).where(near)
        met = halfway.selectExpr("label", "one", children("two"), "l1", "h1").join(two, ["label", "two"]).where(f"one <= two AND {near}")
        pairs = stored(met.select("label", "one", "two", "l2", "h2"), "interval-pairs")
    return pairs.select("label", "one", "two")


class _Interval:
    """Vectors in the order of the grid, with their classes."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["cell", "class"])
        self.ids = rows["class"].to_numpy(np.int64)
        self.copies = rows["copies"].to_numpy(np.int64)
        self.raw = np.array([np.frombuffer(v, np.float64) for v in rows["unit"]])
        self.unit = self.raw / np.linalg.norm(self.raw, axis=1, keepdims=True)
        self.at = np.array([np.frombuffer(v, np.float64) for v in rows["at"]])


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def join_intervals(one: _Interval, two: _Interval, same: bool, cosine: float, eps: float):
    """Links of the vectors of two intervals: linked copies for each, and links that span the components."""
    counts_one, counts_two = np.zeros(len(one.ids), np.int64), np.zeros(len(two.ids), np.int64)
    a_side, b_side = [], []
    work = [(0, len(one.ids), 0, len(two.ids))]
    while work:
        i, j, k, m = work.pop()
        if same and m <= i:
            continue
        gap = np.maximum(0, np.maximum(one.at[i:j].min(0) - two.at[k:m].max(0), two.at[k:m].min(0) - one.at[i:j].max(0)))
        if math.sqrt(float(gap @ gap)) > eps + 1e-9:
            continue
        if j - i > LEAF or m - k > LEAF:
            # Halve what is too long; of equal halves the pair (later, earlier) is the mirror of another.
            first = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > LEAF else [(i, j)]
            second = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > LEAF else [(k, m)]
            work += [(*x, *y) for x in first for y in second if not (same and (i, j) == (k, m) and x > y)]
            continue
        product = one.unit[i:j] @ two.unit[k:m].T
        linked = product >= cosine
        for x, y in np.argwhere(np.abs(product - cosine) < _ROUNDING):
            linked[x, y] = _exact(one.raw[i + x], two.raw[k + y]) >= cosine
        if same and (i, j) == (k, m):
            np.fill_diagonal(linked, False)
        counts_one[i:j] += linked @ two.copies[k:m]
        if not (same and (i, j) == (k, m)):
            counts_two[k:m] += linked.T @ one.copies[i:j]
        x, y = np.nonzero(linked)
        if len(x):
            a, b = spanning_stars(one.ids[i + x], two.ids[k + y])
            a_side.append(a)
            b_side.append(b)
    if same:
        counts_one, counts_two = counts_one + counts_two, np.zeros(0, np.int64)
    empty = np.empty(0, np.int64)
    a, b = np.concatenate([empty, *a_side]), np.concatenate([empty, *b_side])
    return counts_one, counts_two, *spanning_stars(a, b)


def _join_pair(cosine: float, eps: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = [_Interval(part) for _, part in group.groupby("side", sort=True)]
        same = len(sides) == 1
        one, two = sides[0], sides[-1]
        counts_one, counts_two, a, b = join_intervals(one, two, same, cosine, eps)
        ids = np.concatenate([one.ids, two.ids[: len(counts_two)], b])
        linked = np.concatenate([counts_one, counts_two, np.zeros(len(b), np.int64)])
        other = np.concatenate([np.full(len(ids) - len(b), -1), a]).astype(float)
        rows = pd.DataFrame({"class": ids, "linked": linked, "is_link": np.arange(len(ids)) >= len(ids) - len(b)})
        rows["other"] = pd.array(other.astype(np.int64), "Int64")
        return rows[(rows["linked"] > 0) | rows["is_link"]][["class", "other", "is_link", "linked"]]

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    prepare(spark)
    eps = math.sqrt(2 - 2 * cosine)
    rows = vectors.selectExpr(
        "CAST(vec_id AS LONG) AS vec_id",
        "CAST(label AS STRING) AS label",
        """CASE WHEN label IS NOT NULL AND size(embedding) > 0
            AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('Infinity'))
            AND exists(embedding, x -> x <> 0) THEN CAST(embedding AS ARRAY<DOUBLE>) END AS v""",
    ).selectExpr("vec_id", "label", "v", "CASE WHEN v IS NOT NULL THEN sha2(array_join(transform(v, x -> CAST(x + 0.0D AS STRING)), ','), 256) END AS digest")
    rows = stored(rows, "vectors")
    usable = rows.where("v IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("label", "digest").agg(
        F.expr("min(vec_id) AS class"), F.expr("count(1) AS copies"), F.expr("any_value(v) AS v")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Scaled by the largest component, so that neither very large nor very small ones overflow.
            values = [np.array(v, np.float64) for v in batch.column(4).to_pylist()]
            unit = pa.array([(v / np.abs(v).max()).tobytes() for v in values], pa.binary())
            label = pa.array([f"{x}/{len(v)}" for x, v in zip(batch.column(0).to_pylist(), values)], pa.string())
            yield pa.RecordBatch.from_arrays([label, batch.column(2), unit, batch.column(3)], ["label", "class", "unit", "copies"])

    classes = stored(classes.mapInArrow(packed, "label string, class long, unit binary, copies long"), "vector-classes")
    turned = stored(
        classes.mapInArrow(_turn(_directions(classes), eps), "label string, class long, unit binary, copies long, at binary, cell binary"),
        "turned",
    )
    # Intervals: a label's rows in the order of their cells. Large labels are ranked in ranges.
    ordered = turned.withColumn("order", F.expr("concat(hex(cell), lpad(hex(class), 16, '0'))"))
    placed = stored(
        rank_in_groups(ordered, ["label"], "order", "rank").selectExpr(
            "label", "class", "unit", "copies", "at", "cell", f"CAST(rank - 1 AS LONG) DIV {INTERVAL} AS part"
        ),
        "intervals",
    )
    boxes = stored(
        placed.select("label", "part", "at").repartition("label", "part").mapInArrow(
            _boxes, "label string, part long, low array<double>, high array<double>"
        ),
        "boxes",
    )
    pairs = interval_pairs(boxes, eps)
    sides = pairs.selectExpr("label", "one", "two", "one AS part", "0 AS side").union(
        pairs.where("one < two").selectExpr("label", "one", "two", "two AS part", "1 AS side")
    )
    found = stored(
        sides.join(placed, ["label", "part"])
        .select("label", "one", "two", "side", "class", "copies", "unit", "at", "cell")
        .groupBy("label", "one", "two")
        .applyInPandas(_join_pair(cosine, eps), "class long, other long, is_link boolean, linked long"),
        "found",
    )
    linked = found.where("NOT is_link").groupBy("class").agg(F.expr("sum(linked) AS linked"))
    of_class = usable.groupBy("label", "digest").agg(F.expr("min(vec_id) AS class"), F.expr("count(1) AS copies"))
    links = found.where("is_link").selectExpr("class AS a", "other AS b")
    several = usable.groupBy("vec_id").agg(F.expr("count(1) AS c")).where("c > 1")
    links = links.union(
        usable.join(several, "vec_id").join(of_class, ["label", "digest"]).selectExpr("vec_id AS a", "class AS b")
    )
    labels = connected_components(links)
    described = (
        of_class.join(linked, "class", "left")
        .join(labels, F.col("class") == F.col("node"), "left")
        .selectExpr("label", "digest", "copies - 1 + coalesce(linked, 0) AS n_links", "coalesce(component, class) AS component_id")
    )
    near = usable.join(described, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL OR vec_id IS NULL").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    return near.union(alone).selectExpr("vec_id", "n_links", "component_id", "vec_id = component_id AS kept")
