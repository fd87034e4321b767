"""Record the staged manifest as a new commit."""

import hashlib
import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.status import adds_new_content
from treeledger.operators.compare import delta_of_sides, detect_renames
from treeledger.operators.history import head_commit
from treeledger.operators.intervals import change_set
from treeledger.operators.rollup import changed_root, root_rollup
from treeledger.plans.manifest import settle_unread
from treeledger.schema import COMMITS, MANIFEST
from treeledger.session import stored
from treeledger.sources import ledger, tables
from treeledger.sources.tables import append_commit, read_commits, read_manifest


class NothingStaged(ValueError):
    """The staged manifest equals the last commit."""


def commit(
    spark: SparkSession,
    base: str,
    staged: DataFrame,
    message: str,
    when: int | None = None,
    tz_offset_min: int = 0,
    unread: DataFrame | None = None,
    mode: str = "refuse",
) -> DataFrame:
    """Append a commit and return it with ``adds_new_content``, the reason to take a snapshot.

    The staged manifest and the last state are compared once; from there on only what changed is
    stored and looked at. The place in the history is claimed first, so of two writers one gets it and the
    other an error. The change set is written before the row that makes the commit visible, so a job
    that fails in between leaves nothing but a claim, which is given back. The id follows from parent, time, message and content.
    ``unread`` lists what the scan could not read; see ``settle_unread`` for ``mode``.
    """
    commits = read_commits(spark, base)
    parent = head_commit(commits).select("commit_id", "seq").first()
    seq = parent["seq"] + 1 if parent else 0
    head = read_manifest(spark, base, parent["commit_id"]) if parent else spark.createDataFrame([], MANIFEST)
    if unread is not None:
        staged = settle_unread(staged, unread, head, mode)
    changes = stored(change_set(head, staged.select(*MANIFEST.names)), "changes")
    renamed = detect_renames(
        delta_of_sides(changes.selectExpr("path", "old_kind", "old_digest", "kind AS new_kind", "digest AS new_digest"))
    )
    found = renamed.agg(F.expr("count(1) AS n"), F.bool_or(adds_new_content()).alias("brings")).first()
    if not found["n"]:
        raise NothingStaged("no changes staged for commit")

    ledger.claim(spark, base, seq)
    try:
        return _append(spark, base, changes, parent, seq, bool(found["brings"]), message, when, tz_offset_min)
    except BaseException:
        if head_commit(read_commits(spark, base)).where(F.col("seq") >= seq).isEmpty():
            ledger.release(spark, base, seq)
        raise


def _append(
    spark: SparkSession, base: str, changes: DataFrame, parent: Row | None, seq: int, brings: bool, message: str, when: int | None, zone: int
) -> DataFrame:
    # A writer that saw the history before this place was taken and given back starts anew.
    newest = head_commit(read_commits(spark, base)).select("commit_id").first()
    if (newest and newest["commit_id"]) != (parent and parent["commit_id"]):
        raise ledger.Taken(f"commit {seq} was written by another writer")
    if parent and not ledger.has_history(spark, base):
        # The ledger holds full copies so far: the last one is where the history starts.
        old = read_manifest(spark, base, parent["commit_id"])
        start = old.selectExpr("path", "CAST(NULL AS STRING) AS old_kind", "CAST(NULL AS STRING) AS old_digest", "kind", "digest")
        ledger.write_changes(start, base, parent["seq"], old.count())
    before = tables.read_root(spark, base, parent["commit_id"]) if parent else {"n_files": 0, "h1": 0, "h2": 0}
    if before is None:
        before = root_rollup(read_manifest(spark, base, parent["commit_id"])).first().asDict()
    step = changed_root(changes).first()
    root = {name: before[name] + step[name] for name in ("n_files", "h1", "h2")}
    values = {
        "parent_id": parent["commit_id"] if parent else None,
        "seq": seq,
        "commit_time": int(time.time()) if when is None else when,
        "tz_offset_min": zone,
        "message": message,
    }
    parts = [values["parent_id"] or "", values["commit_time"], zone, root["n_files"], root["h1"], root["h2"], message]
    made = {"commit_id": hashlib.sha1("\n".join(map(str, parts)).encode()).hexdigest(), **values}
    record = spark.createDataFrame([tuple(made[name] for name in COMMITS.names)], COMMITS)
    kept = record.selectExpr("*", *[f"CAST('{root[c]}' AS {'LONG' if c == 'n_files' else 'DECIMAL(38, 0)'}) AS {c}" for c in root])
    ledger.write_changes(changes, base, seq, changes.count())
    append_commit(kept, base)
    ledger.settle(spark, base, seq, root["n_files"])
    return record.withColumn("adds_new_content", F.lit(brings))
