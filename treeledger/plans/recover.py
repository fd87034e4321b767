"""Restore many files at once: classify, locate, rank, copy."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.operators.intervals import intervals_of_manifests
from treeledger.operators.locate import bind_requests, classify_requests, locate, locate_first, rank_candidates
from treeledger.operators.spread import HOT_ROWS, lookup_join
from treeledger.session import new_shared_path, stored
from treeledger.sinks.restore import restore_files, restore_links


def restore(
    requests: DataFrame,
    root: str,
    commits: DataFrame,
    manifests: DataFrame,
    snapshots: DataFrame,
    stores: DataFrame,
    copies: DataFrame,
    existing: DataFrame | None = None,
    store: str | None = None,
    any_revision: bool = False,
    links: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    intervals: DataFrame | None = None,
) -> DataFrame:
    """One row per request with what became of it and the snapshot that served.

    ``copies`` gives the mounted ``root`` of each ``reference``, ``links`` the target text for the
    ``digest`` of a link, which needs no snapshot. The snapshot to try first is found for all requests
    at once; the others are looked for only where that copy failed. What was located is written to the
    shared folder, so that the copying job, which has effects, reads settled rows. Of several
    requests for one path the newest commit is served, the others are ``superseded``. ``intervals`` gives
    the history if it is kept as such.
    """
    spark = requests.sparkSession
    bound = bind_requests(requests, commits, manifests, snapshots)
    if intervals is None:
        intervals = stored(intervals_of_manifests(commits, manifests, hot_rows), "intervals")
    first = stored(locate_first(bound, commits, intervals, snapshots, stores, store, any_revision, hot_rows), "first")
    # Who offers something at all is asked again only if one store alone counts.
    offered = first if store is None else locate_first(bound, commits, intervals, snapshots, stores, None, any_revision, hot_rows)
    located = first.select("path", "ref", "store")
    if store is not None:
        located = located.unionByName(offered.select("path", "ref", "store"))

    outcomes = new_shared_path(spark, "outcomes")
    classified = classify_requests(
        requests, commits, manifests, snapshots, stores, existing, store, any_revision, located, hot_rows, bound
    )
    by_seq = commits.selectExpr("commit_id", "seq AS _seq")
    served = "outcome IN ('ok', 'link')"
    settled = (
        lookup_join(classified, by_seq, ["commit_id"], "left", ["path", "ref"], hot_rows)
        .selectExpr("*", f"row_number() OVER (PARTITION BY path, {served} ORDER BY _seq DESC, ref) AS _turn")
        .selectExpr(
            *[f"if({served} AND _turn > 1, 'superseded', outcome) AS outcome" if c == "outcome" else c for c in classified.columns]
        )
    )
    settled.write.parquet(outcomes)
    classified = spark.read.schema(settled.schema).parquet(outcomes)

    wanted = classified.where("outcome = 'ok'").select("path", "ref")
    roots = copies.select("reference", "root")
    plan = first.withColumn("try_order", F.lit(1)).join(wanted, ["path", "ref"], "left_semi")
    plan = lookup_join(plan, roots, ["reference"], "inner", ["path", "ref"], hot_rows)
    done = new_shared_path(spark, "restored")
    tried = stored(restore_files(plan, root), "tried")
    # A request without a row had a snapshot first whose copy is not there.
    left = wanted.join(tried.where("outcome <> 'failed'").select("path", "ref"), ["path", "ref"], "left_anti")
    left = stored(left, "left")
    tried.join(left, ["path", "ref"], "left_anti").write.parquet(f"{done}/kind=blob/try=1")
    if not left.isEmpty():
        again = bound.join(left, ["path", "ref"], "left_semi")
        others = rank_candidates(locate(left, commits, manifests, snapshots, stores, any_revision, hot_rows, again), store)
        others = others.where("eligible").join(first.select("path", "ref", "reference"), ["path", "ref", "reference"], "left_anti")
        plan = lookup_join(others, roots, ["reference"], "inner", ["path", "ref"], hot_rows)
        restore_files(plan, root).write.parquet(f"{done}/kind=blob/try=2")
    if links is not None:
        entries = manifests.selectExpr("revision AS commit_id", "path", "digest")
        targets = links.groupBy("digest").agg(F.expr("min(link_target) AS link_target"))
        asked = classified.where("outcome = 'link'").join(entries, ["commit_id", "path"])
        found = lookup_join(asked, targets, ["digest"], "inner", ["path", "ref"], hot_rows)
        restore_links(found, root).write.parquet(f"{done}/kind=link")
    copied = spark.read.schema("path string, ref string, outcome string, reference string").option("recursiveFileLookup", "true").parquet(done).selectExpr("path", "ref", "outcome AS _done", "reference")
    return classified.join(copied, ["path", "ref"], "left").select(
        "path",
        "ref",
        F.expr("if(outcome = 'ok', coalesce(_done, 'failed'), coalesce(_done, outcome)) AS outcome"),
        "reference",
    )
