import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from treeledger.operators.compare import compare, detect_renames, diff
from treeledger.operators import spread
from treeledger.operators.spread import hot_keys, lookup_join, rank_in_groups, sample_rows, spread_join


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of the rows have one key, the others many keys."""
    return spark.range(9000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', cast(id % 700 AS string))) AS k",
        "sha1(cast(id AS string)) AS p",
    )


def test_split_groups_are_numbered_as_whole_ones(crowded):
    plain = rank_in_groups(crowded, ["k"], "p", "n")
    split = rank_in_groups(crowded, ["k"], "p", "n", hot_rows=64)
    assert "_piece" not in plain._jdf.queryExecution().toString()
    assert "_piece" in split._jdf.queryExecution().toString()
    assert rows_of(plain) == rows_of(split)
    assert plain.agg(F.max("n")).first()[0] == 3000


def test_no_task_numbers_a_whole_crowded_group(crowded):
    split = rank_in_groups(crowded, ["k"], "p", "n", hot_rows=64)
    plan = split._jdf.queryExecution().analyzed().toString()
    assert "_piece" in plan
    hot = hot_keys(sample_rows(crowded, ["p"], 64), ["k"])
    pieces = {row["k"]: row["_pieces"] for row in hot.collect()}
    assert pieces["hot"] > 50


def test_hot_keys_follow_the_sample(spark, monkeypatch):
    many = spark.range(200_000).selectExpr("cast(id % 4000 AS string) AS k", "cast(id AS string) AS p")
    assert hot_keys(many, ["k"]).count() == 4000
    few = many.where("k < '2'")
    assert rows_of(rank_in_groups(few, ["k"], "p", "n", hot_rows=32)) == rows_of(rank_in_groups(few, ["k"], "p", "n"))
    monkeypatch.setattr(spread, "MAX_HOT_KEYS", 1000)
    assert hot_keys(many, ["k"]).count() == 1000
    assert hot_keys(many.limit(0), ["k"]) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_a_join(spark, crowded, how):
    right = crowded.select("k").distinct().where("k <> 'k5'").withColumn("v", F.upper("k"))
    plain = crowded.join(right, ["k"], how)
    split = spread_join(crowded, right, ["k"], how, ["p"], hot_rows=64)
    small = lookup_join(crowded, right, ["k"], how, ["p"], hot_rows=64)
    large = lookup_join(crowded, right, ["k"], how, ["p"], hot_rows=64, most=10)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert "_piece" in large._jdf.queryExecution().toString()
    for joined in (split, small, large):
        assert plain.columns == joined.columns
        assert rows_of(plain) == rows_of(joined)


def test_other_joins_are_refused(crowded):
    with pytest.raises(ValueError, match="left side"):
        spread_join(crowded, crowded, ["k"], "full_outer", ["p"])


def test_renames_of_crowded_content(spark):
    old = spark.range(5000).selectExpr(
        "concat('a/', sha1(cast(id AS string))) AS path", "'blob' AS kind", "sha1(cast(if(id % 2 = 0, 0, id) AS string)) AS digest"
    )
    new = spark.range(4000).selectExpr(
        "concat('b/', sha1(cast(id AS string))) AS path", "'blob' AS kind", "sha1(cast(if(id % 2 = 0, 0, id) AS string)) AS digest"
    )
    whole, split = diff(old, new), diff(old, new, hot_rows=64)
    assert rows_of(whole) == rows_of(split)
    counts = {row["status"]: row["count"] for row in whole.groupBy("status").count().collect()}
    assert counts == {"R": 4000, "D": 1000}
    assert rows_of(detect_renames(compare(old, new), hot_rows=64)) == rows_of(split)


def test_a_limit_on_very_many_renames(spark):
    """The renames of one comparison are a large group themselves."""
    old, new = (spark.range(5000).selectExpr(f"concat('{d}/', sha1(cast(id AS string))) AS path", "'blob' AS kind", "sha1(cast(id AS string)) AS digest") for d in "ab")
    whole, split = diff(old, new, limit=700), diff(old, new, limit=700, hot_rows=64)
    assert "_piece" in split._jdf.queryExecution().toString()
    assert rows_of(whole) == rows_of(split)
    counts = {row["status"]: row["count"] for row in split.groupBy("status").count().collect()}
    assert counts == {"R": 700, "D": 4300, "A": 4300}
