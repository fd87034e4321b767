"""Joins and ranks whose cost does not depend on how rows are spread over the keys.

One key may hold a third of all rows, and adaptive execution splits a crowded partition only where
both sides of a join come straight from a shuffle. A small sample, chosen by a hash of the row's own identity, is looked at while the plan is built. It
tells which keys are that large; only their rows are split further, and where there is none the
plan stays plain. What the sample says affects the distribution of the work and never the result.
What the driver sees of it, and what is broadcast, is limited in rows by the constants below,
whatever the size of the data.
"""

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is split when it holds about this many rows.
HOT_ROWS = 1_000_000
# Sampled rows by which such a key is recognised.
_SEEN = 32
# Keys that are split at most. Any further key holds less than 1/100,000 of the rows.
MAX_HOT_KEYS = 100_000
# Pieces of all split keys together, but for one per key; up to 5 * 10^11 rows of large keys a piece
# has HOT_ROWS / 2 rows.
MAX_PIECES = 1_000_000
# Points, and groups of points, that one row of a large key is compared with: a root of the above.
MAX_GROUP = 1023
# A table of at most this size is sent to all executors instead of shuffling its partner.
MAX_LOOKUP_ROWS = 100_000
MAX_LOOKUP_BYTES = 64 << 20


def sample_rows(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows whose identity falls into one of many hash classes; the same ones every time."""
    classes = max(1, hot_rows // _SEEN)
    return df.where(f"pmod(xxhash64({', '.join(by)}), {classes}) = 0")


def hot_keys(sample: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The largest keys of a sample and into how many pieces each should go, if there are any."""
    largest: list[Row] = (
        sample.groupBy(*keys)
        .agg(F.expr("count(1) AS _n"))
        .where(f"_n >= {_SEEN}")
        .orderBy(F.expr("-_n"), *keys)
        .limit(MAX_HOT_KEYS)
        .collect()
    )
    if not largest:
        return None
    total = sum(row["_n"] for row in largest)
    rows = [
        (*[row[key] for key in keys], min(-(-row["_n"] * MAX_PIECES // total), -(-2 * row["_n"] // _SEEN)))
        for row in largest
    ]
    fields = [sample.schema[key] for key in keys]
    schema = T.StructType([*fields, T.StructField("_pieces", T.IntegerType(), False)])
    return F.broadcast(sample.sparkSession.createDataFrame(rows, schema))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Join rows that may crowd on few keys with a table that has few rows per key.

    The rows of a crowded key are dealt over several pieces by a hash of ``by``, and its few
    partners are repeated for each piece. ``how`` keeps or drops rows of the left side only.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not a join that keeps to the left side: {how}")
    on = list(on)
    hot = hot_keys(sample_rows(left, by, hot_rows) if sample is None else sample, on)
    if hot is None:
        return left.join(right, on, how)
    dealt = left.join(hot, on, "left").selectExpr(
        "* EXCEPT (_pieces)",
        f"coalesce(pmod(xxhash64({', '.join(by)}, 1), _pieces), 0) AS _piece",
    )
    repeated = right.join(hot, on, "left").selectExpr(
        "* EXCEPT (_pieces)",
        "explode(sequence(0L, coalesce(_pieces, 1) - 1L)) AS _piece",
    )
    return dealt.join(repeated, [*on, "_piece"], how).drop("_piece")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    by: Sequence[str],
    hot_rows: int = HOT_ROWS,
    most: int = MAX_LOOKUP_ROWS,
) -> DataFrame:
    """Join with a table that is small more often than not, such as commits or given paths.

    It is measured, no further than to the limit. Within it the table is broadcast and the left
    side stays where it is; beyond it both sides are shuffled, crowded keys apart.
    """
    # Every partition hands over as many rows as the limit allows, so only their sizes go.
    sizes = right.selectExpr("octet_length(to_json(struct(*))) AS n_bytes").limit(most + 1)
    size = sizes.selectExpr("count(1) AS n_rows", "coalesce(sum(n_bytes), 0) AS n_bytes")
    measured = size.first()
    if measured["n_rows"] <= most and measured["n_bytes"] <= MAX_LOOKUP_BYTES:
        return left.join(F.broadcast(right), list(on), how)
    return spread_join(left, right, on, how, by, hot_rows)


class _Ranges(NamedTuple):
    """Where the rows of large keys are cut: sorted points in groups, and each group's first point.

    A row thus meets two short lists instead of all points of its key.
    """

    groups: DataFrame  # keys, _firsts
    points: DataFrame  # keys, _span, _points
    size: int  # points in a group

    def place(self, df: DataFrame, keys: list[str], by: str, how: str) -> DataFrame:
        """Add ``_piece``, the number of points at or before the row, where the key is large."""
        grouped = df.join(self.groups, keys, how).selectExpr(
            "* EXCEPT (_firsts)", f"if(_firsts IS NULL, NULL, {count_up_to(by, '_firsts')}) AS _span"
        )
        return grouped.join(self.points, [*keys, "_span"], how).selectExpr(
            "* EXCEPT (_span, _points)",
            f"if(_points IS NULL, 0, _span * {self.size} + {count_up_to(by, '_points')}) AS _piece",
        )


def count_up_to(value: str, points: str, bits: int = MAX_GROUP.bit_length()) -> str:
    """How many of the sorted points, fewer than two to the power of ``bits``, lie at or before the value, by halving steps."""
    steps = ", ".join(str(1 << n) for n in reversed(range(bits)))
    return f"""aggregate(array({steps}), 0,
        (at, step) -> if(get({points}, at + step - 1) <= {value}, at + step, at))"""


def _ranges(sample: DataFrame, keys: list[str], by: str) -> _Ranges | None:
    """Cut the rows of large keys into pieces of similar size, if there are large keys."""
    hot = hot_keys(sample, keys)
    if hot is None:
        return None
    # One value per piece is picked at random, so no key gives more values than it has pieces.
    picked = (
        sample.join(hot, keys)
        .groupBy(*keys, F.expr(f"pmod(xxhash64({by}, 2), _pieces) AS _pick"))
        .agg(F.expr(f"min_by({by}, xxhash64({by}, 3)) AS _point"))
        .groupBy(*keys)
        .agg(F.expr("sort_array(collect_list(_point)) AS _points"))
    )
    rows = picked.collect()
    size = max(1, math.isqrt(max(len(row["_points"]) for row in rows)))
    groups, points = [], []
    for row in rows:
        key, found = [row[name] for name in keys], row["_points"]
        groups.append((*key, found[size::size]))
        points += [(*key, n // size, found[n : n + size]) for n in range(0, len(found), size)]
    key_fields = ", ".join(f"{name} {sample.schema[name].dataType.simpleString()}" for name in keys)
    make = sample.sparkSession.createDataFrame
    value = sample.schema[by].dataType.simpleString()
    return _Ranges(
        F.broadcast(make(groups, f"{key_fields}, _firsts array<{value}>")),
        F.broadcast(make(points, f"{key_fields}, _span int, _points array<{value}>")),
        size,
    )


def rank_in_groups(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    name: str,
    sample: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    cluster: Sequence[str] | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in the order of ``by``, which is unique in the group.

    Groups of ordinary size take one window. A large group is cut into consecutive ranges; each
    range is numbered by itself and the sizes of the ranges before it are added. ``sample`` may
    give rows like those of ``df`` that are cheaper to read; it needs ``keys`` and ``by``. A caller
    that goes on to work by some of the keys names them as ``cluster`` to save a shuffle.
    """
    keys = list(keys)
    listed = ", ".join(keys)
    if sample is None:
        sample = sample_rows(df, [by], hot_rows)
    ranges = _ranges(sample.select(*keys, by), keys, by)
    if ranges is None:
        placed = df.repartition(*cluster) if cluster else df
        return placed.selectExpr("*", f"row_number() OVER (PARTITION BY {listed} ORDER BY {by}) AS {name}")

    numbered = ranges.place(df, keys, by, "left").selectExpr(
        "*", f"row_number() OVER (PARTITION BY {listed}, _piece ORDER BY {by}) AS _within"
    )
    # One row per range of a large group.
    sizes = (
        ranges.place(df.select(*keys, by), keys, by, "inner")
        .groupBy(*keys, "_piece")
        .agg(F.expr("count(1) AS _size"))
        .selectExpr(
            *keys,
            "_piece",
            f"sum(_size) OVER (PARTITION BY {listed} ORDER BY _piece"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before",
        )
    )
    return numbered.join(F.broadcast(sizes), [*keys, "_piece"], "left").selectExpr(
        "* EXCEPT (_piece, _within, _before)", f"_within + coalesce(_before, 0) AS {name}"
    )
