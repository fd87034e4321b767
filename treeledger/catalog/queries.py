"""Every operator over the given tables."""

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.catalog import inputs as i
from treeledger.functions.digests import abbreviated, link_identity, text_digest, unreadable
from treeledger.functions.status import adds_new_content, shown_old_digest, status_code
from treeledger.operators import cache, compare, constrain, export, history, ignore, intervals, locate, rollup, staging
from treeledger.plans import manifest as trees
from treeledger.plans import record, recover
from treeledger.plans import status as statuses
from treeledger.schema import INTERVALS, LISTING
from treeledger.session import mounted, new_shared_path, ship_package, small_batches
from treeledger.sources import content, tables
from treeledger.sources import stores as store_sources
from treeledger.sources import tree as tree_source

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str, ctes: str, *names: str) -> list[DataFrame]:
    return [i.spark_table(spark, sf_dir, ctes, name) for name in names]


def _stored(df: DataFrame, *partitions: str) -> DataFrame:
    """The frame as a table in the shared folder, the form in which manifests are kept."""
    path = new_shared_path(df.sparkSession, "table")
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pair_diff(ctes: str, old: str = "old", new: str = "new", **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compare.diff(*_tables(spark, sf_dir, ctes, old, new), **options)

    return run


_diff = _pair_diff(i.PAIR)
_diff_orders = _pair_diff(i.ORDERS)


def _diff_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (_stored(side) for side in _tables(spark, sf_dir, i.PAIR, "old", "new"))
    return compare.diff_pruned(old, new, *[_stored(rollup.dir_rollup(side)) for side in (old, new)])


def _keep_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, seen, broken = _tables(spark, sf_dir, i.UNREAD, "listing", "seen", "broken")
    return constrain.keep_unread(listing, seen, broken)


def _refresh_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshots are looked at again, but every third copy cannot be read."""
    known, commits, stores, lost = _tables(spark, sf_dir, i.COPY_COMMITS, "known", "copy_commits", "stores", "lost")
    readable = commits.join(lost, ["store", "snapshot_id"], "left_anti")
    return store_sources.refresh_snapshots(known, store_sources.newest_commits(readable), stores, unread=lost)


def _adds_new_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select("path", "status", adds_new_content().alias("adds_new_content"))


def _status_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _diff(spark, sf_dir).withColumn("shown_digest", shown_old_digest())
    return shown.select(
        "path",
        "status_name",
        status_code().alias("status_code"),
        "shown_digest",
        abbreviated("shown_digest").alias("short_digest"),
    )


def _path_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = compare.filter_status(_diff(spark, sf_dir), "R")
    return export.with_path_change(renamed).select("old_path", "new_path", "path_change")


def _emptied_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (old,) = _tables(spark, sf_dir, i.PAIR, "old")
    return export.emptied_dirs(old, export.rename_plan(_diff(spark, sf_dir)))


def _constrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, docs = _tables(spark, sf_dir, i.PAIR, "new", "docs")
    given = (
        docs.where("toxic = 1")
        .selectExpr("concat(source, '/', lang) AS path")
        .union(docs.where("lang = 'fr'").select("path"))
        .union(docs.selectExpr("'web' AS path"))
    )
    return constrain.constrain(new, given)


def _constrain_cross_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _tables(spark, sf_dir, i.PAIR, "old", "new")
    return statuses.diff_unstaged(old, new, ["src1", "src2"])


def _staging(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    old, new, docs = _tables(spark, sf_dir, i.PAIR, "old", "new", "docs")
    changed = (
        docs.where("toxic = 1")
        .selectExpr("concat(source, '/', lang) AS path")
        .union(docs.where("lang = 'es'").selectExpr("spanish_path AS path"))
        .union(docs.selectExpr("'web' AS path"))
    )
    return old, new, docs, _stored(staging.stage_paths(old, new, changed))


def _stage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staging(spark, sf_dir)[3]


def _stage_glob_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _tables(spark, sf_dir, i.PAIR, "old", "new")
    return staging.stage_paths(old, new, ["src1?/es", "web"], glob=True)


def _reset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, docs, staged = _staging(spark, sf_dir)
    back = docs.where("quality = 0").selectExpr("source AS path").union(docs.selectExpr("'web' AS path"))
    return staging.reset_paths(staged, old, back)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _, staged = _staging(spark, sf_dir)
    return statuses.status(old, staged, new)


def _apply_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    (old,) = _tables(spark, sf_dir, i.PAIR, "old")
    return compare.apply_delta(old, _diff(spark, sf_dir))


def _digest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _tables(spark, sf_dir, i.DOCS, "docs")
    return docs.select("doc_id", text_digest("text").alias("digest")).withColumn(
        "unreadable", unreadable()
    )


def _link_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = _tables(spark, sf_dir, i.DOCS, "docs")
    listing = docs.selectExpr(
        "path",
        "if(lang = 'fr', 'link', 'blob') AS kind",
        "if(lang = 'fr', concat('../originals/', path), NULL) AS link_target",
        "sha1(text) AS digest",
    )
    return listing.select("path", link_identity().alias("digest"))


def _cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = cache.probe_cache(*_tables(spark, sf_dir, i.CACHE, "listing", "cache"))
    return probed.select("path", "cache_state", "digest")


def _cache_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = cache.probe_cache(*_tables(spark, sf_dir, i.MOVED, "moved", "cache"))
    return probed.select("path", "cache_state", "digest")


def _cache_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = cache.probe_cache(*_tables(spark, sf_dir, i.REPLACED, "replaced", "cache"))
    return probed.select("path", "cache_state", "digest")


def _cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = _tables(spark, sf_dir, i.CACHE, "cache")
    entries = rows.selectExpr("path", "concat_ws(':', version, mtime_ns, algorithm, digest) AS entry")
    return cache.parse_entries(entries)


def _cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, rows, docs = _tables(spark, sf_dir, i.CACHE, "listing", "cache", "docs")
    hits, misses = cache.split_cached(listing, rows)
    read = docs.selectExpr("path", "sha1(text) AS digest")
    return cache.refresh_cache(rows, misses.join(read, "path"), hits)


def _probe_by_path_first(ctes: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cache.probe_by_path_first(*_tables(spark, sf_dir, ctes, name, "cache")).select("path", "cache_state", "digest")

    return run


def _cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cache after a run: what changed goes into its buckets."""
    listing, rows, docs = _tables(spark, sf_dir, i.CACHE, "listing", "cache", "docs")
    base = new_shared_path(spark, "ledger")
    tables.write_cache(rows, base, 16)
    known = tables.read_cache(spark, base)
    probed = _stored(cache.probe_by_path_first(listing, known))
    read = docs.selectExpr("path", "sha1(text) AS digest")
    digested = probed.where("cache_state <> 'hit'").drop("cache_state", "digest").join(read, "path")
    tables.update_cache(spark, base, cache.cache_changes(known, digested, probed.where("cache_state = 'hit'")))
    return tables.read_cache(spark, base)


def _corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, docs = _tables(spark, sf_dir, i.CACHE, "cache", "docs")
    recorded = docs.selectExpr(
        "path",
        "'blob' AS kind",
        """CASE WHEN source = 'src3' THEN sha1(concat(text, '?'))
                WHEN source = 'src5' THEN sha1(concat(text, '!')) ELSE sha1(text) END AS digest""",
    )
    rehashed = docs.selectExpr(
        "path",
        "'blob' AS kind",
        "sha1(text) AS digest",
        "1000000 * doc_id + if(source = 'src5', 1, 0) AS mtime_ns",
    )
    return trees.verify(recorded, rehashed, rows)


def _dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (listing,) = _tables(spark, sf_dir, i.PATHS, "listing")
    return rollup.dir_rollup(listing).selectExpr(
        "dir", "n_files", "cast(h1 AS string) AS h1", "cast(h2 AS string) AS h2"
    )


def _changed_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _tables(spark, sf_dir, i.PAIR, "old", "new")
    return rollup.changed_dirs(rollup.dir_rollup(old), rollup.dir_rollup(new))


def _prune_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore.prune_ignored(*_tables(spark, sf_dir, i.PATHS, "listing"))


def _ignored_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignore.ignored_dirs(*_tables(spark, sf_dir, i.PATHS, "listing"))


def _is_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, marks = _tables(spark, sf_dir, i.PATHS, "listing", "marks")
    asked = (
        listing.select("path")
        .union(marks.selectExpr("dir AS path"))
        .union(marks.selectExpr("concat(dir, '/new') AS path"))
    )
    return ignore.is_ignored(asked, listing)


def _snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_sources.snapshot_ids(*_tables(spark, sf_dir, i.COPIES_OF_HOSTS, "paths", "stores"))


def _store_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = _tables(spark, sf_dir, i.WEB, "web")
    stores = pages.selectExpr("cast(page_id AS string) AS store", "url", "0 AS ordinal")
    return store_sources.check_stores(stores).select("store", "store_error")


def _refresh_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, commits, stores = _tables(spark, sf_dir, i.COPY_COMMITS, "known", "copy_commits", "stores")
    fresh = store_sources.newest_commits(commits)
    return store_sources.refresh_snapshots(known, fresh, stores, ["aux1"])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, manifests = _tables(spark, sf_dir, i.HISTORY, "commits", "manifests")
    return history.log(commits, _stored(manifests, "revision"))


def _log_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a history with as many commits as there are events, from its change sets."""
    runs, commits = _tables(spark, sf_dir, i.CHAIN_TREE, "runs", "commits")
    changes = intervals.changes_of_intervals(runs)
    return history.log_of_changes(commits, _stored(changes))


def _log_decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.decorate(*_tables(spark, sf_dir, i.CHAIN, "commits", "snapshots", "stores"))


def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.resolve_refs(*_tables(spark, sf_dir, i.CHAIN, "refs", "commits", "snapshots"))


def _ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    (commits,) = _tables(spark, sf_dir, i.CHAIN, "commits")
    start = commits.where("message = 'signup'").agg(F.max_by("commit_id", "seq")).first()[0]
    return history.ancestors(commits, start).drop("tz_offset_min")


def _diff_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, manifests, snapshots = _tables(spark, sf_dir, i.HISTORY, "commits", "manifests", "snapshots")
    return statuses.diff_refs(
        commits, _stored(manifests, "revision"), "aux1/2", "HEAD", snapshots, letters="m"
    )


def _history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change sets of the five revisions."""
    commits, manifests = _tables(spark, sf_dir, i.HISTORY, "commits", "manifests")
    return intervals.changes_of_manifests(commits, _stored(manifests, "revision"))


def _history_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intervals_of_changes(_stored(_history_changes(spark, sf_dir)))


def _diff_refs_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, snapshots = _tables(spark, sf_dir, i.HISTORY, "commits", "snapshots")
    changes = _stored(_history_changes(spark, sf_dir))
    return statuses.diff_refs_of_changes(commits, changes, "aux1/2", "HEAD", snapshots, letters="m")


def _rollup_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of the new manifest from that of the old one and what changed."""
    old, new = _tables(spark, sf_dir, i.PAIR, "old", "new")
    kept = rollup.update_rollup(rollup.dir_rollup(old), _stored(intervals.change_set(old, new)))
    return kept.selectExpr("dir", "n_files", "cast(h1 AS string) AS h1", "cast(h2 AS string) AS h2")


def _backups(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    names = ("requests", "commits", "manifests", "snapshots", "stores")
    requests, commits, manifests, *others = _tables(spark, sf_dir, i.HISTORY, *names)
    return [_stored(requests), commits, _stored(manifests, "revision"), *others]


def _locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate(*_backups(spark, sf_dir))


def _locate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, commits, manifests, snapshots, stores = _backups(spark, sf_dir)
    bound = locate.bind_requests(requests, commits, manifests, snapshots)
    runs = _stored(intervals.intervals_of_manifests(commits, manifests))
    first = locate.locate_first(bound, commits, runs, snapshots, stores)
    return first.select("path", "ref", "found_path", "same_path", "reference")


def _locate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's file as of each commit that touched it: where to get it from first."""
    commits, runs, snapshots, stores = _tables(spark, sf_dir, i.CHAIN_TREE, "commits", "runs", "snapshots", "stores")
    # The requests of ``bound`` are the runs themselves and what lasts, so one table holds both.
    spans = _stored(runs.select(*INTERVALS.names, "commit_id"))
    newest = commits.agg(F.expr("max_by(commit_id, seq) AS commit_id"), F.expr("max(seq) AS seq"))
    then = spans.selectExpr("path", "commit_id AS ref", "commit_id", "from_seq AS seq", "kind", "digest")
    now = spans.where("to_seq IS NULL").select("path", "kind", "digest").crossJoin(F.broadcast(newest))
    bound = then.unionByName(now.withColumn("ref", F.lit("HEAD")))
    first = locate.locate_first(bound, commits, spans.select(*INTERVALS.names), snapshots, stores)
    return first.select("path", "ref", "seq", "found_path", "same_path", "reference")


def _rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = locate.rank_candidates(_locate(spark, sf_dir), "aux2")
    return ranked.select("path", "ref", "reference", "eligible", "try_order")


def _classify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    backups = _backups(spark, sf_dir)
    (docs,) = _tables(spark, sf_dir, i.DOCS, "docs")
    return locate.classify_requests(*backups, existing=docs.where("lang = 'de'"), store="aux2")


def _write_texts(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text")):
                full = os.path.join(root, path.as_py())
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as out:
                    out.write(text.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return write


def _write_tree(docs: DataFrame) -> str:
    """Documents as files of a tree in the shared folder, written by the executors."""
    spark = docs.sparkSession
    ship_package(spark)
    root = mounted(new_shared_path(spark, "tree"))
    os.makedirs(root)
    texts = docs.select("path", F.col("text").cast("binary").alias("text"))
    written = texts.repartition("path").mapInArrow(_write_texts(root), "n long")
    with small_batches(spark):
        written.agg(F.sum("n")).first()
    return root


def _tree_of_documents(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    (docs,) = _tables(spark, sf_dir, i.DOCS, "docs")
    return _write_tree(docs), docs


# Paths of a tree that are scanned alone: a folder, a folder below another, files, one that is not there.
_GIVEN = ["src1", "src2/en", "src2/en/x", "nowhere", "src3/fr"]


def _scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _tree_of_documents(spark, sf_dir)
    return tree_source.scan_tree(spark, root, _GIVEN).select("path", "kind", "size")


def _unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents, where the toxic ones went after the tree was listed."""
    (docs,) = _tables(spark, sf_dir, i.DOCS, "docs")
    root = _write_tree(docs.where("toxic = 0"))
    listed = docs.selectExpr("path", "'blob' AS kind", "CAST(octet_length(text) AS LONG) AS size")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in LISTING if f.name not in listed.columns}
    found = content.digest_files(listed.withColumns(empty), root)
    return found.withColumn("unreadable", unreadable()).select("path", "digest", "unreadable")


def _rehash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest and the new cache of a tree whose cache is wrong everywhere."""
    root, _ = _tree_of_documents(spark, sf_dir)
    known = tree_source.scan_tree(spark, root).selectExpr(
        "path", "1 AS version", "mtime_ns", "'sha1' AS algorithm", "sha1(path) AS digest", "size", "dev", "inode", "ctime_ns"
    )
    state = trees.build_manifest(spark, root, cache=_stored(known), rehash=True)
    entries = state.cache.selectExpr("path", "digest AS cached")
    return state.manifest.join(entries, "path").select("path", "digest", "cached")


def _commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits and what the ledger has of them."""
    old, new = _tables(spark, sf_dir, i.PAIR, "old", "new")
    base = new_shared_path(spark, "ledger")
    for n, staged in enumerate((old, new, old)):
        record.commit(spark, base, staged, f"Change {n}", when=86400 * n, tz_offset_min=-90)
    commits = tables.read_commits(spark, base)
    parents = commits.selectExpr("commit_id AS parent_id", "seq AS parent_seq")
    named = commits.join(parents, "parent_id", "left").selectExpr("commit_id AS revision", "seq", "parent_seq", "message")
    return tables.read_manifest(spark, base).join(F.broadcast(named), "revision").drop("revision")


def _commit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    (commits,) = _tables(spark, sf_dir, i.CHAIN, "commits")
    zoned = commits.withColumn("tz_offset_min", F.expr("CAST(seq % 1440 - 720 AS INT)"))
    return history.with_times(zoned).selectExpr("seq", "local_time", "unix_micros(committed_at) AS micros")


def _snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all turns are stored, all vanish, and those of the users are stored again."""
    (turns,) = _tables(spark, sf_dir, i.TURNS, "turns")
    base = new_shared_path(spark, "ledger")
    found = []
    for part in (turns, turns.where("false"), turns.where("store = 'user'")):
        tables.write_snapshots(part, base)
        found.append(tables.read_snapshots(spark, base).agg(F.expr("count(1) AS kept_before")))
    return tables.read_snapshots(spark, base).crossJoin(found[1])


def _unreadable_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _tables(spark, sf_dir, i.BROKEN, "old", "new")
    changed = compare.diff(old, new, copies=True, match_unreadable=False)
    return changed.select("status", "old_path", "new_path", "old_digest", "new_digest")


def _status_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    (listing,) = _tables(spark, sf_dir, i.PATHS, "listing")
    ignored = ignore.ignored_dirs(listing)
    kept = ignore.prune_ignored(listing).select("path", "kind", "digest")
    shown = statuses.status(kept, kept, kept, ignored=ignored, show_ignored=True)
    return shown.select("section", "status", "status_name", "path")


def _store_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address in the forms that stores may and may not have."""
    stores = i.spark_table(spark, sf_dir, i.ADDRESSES, "addresses")
    return store_sources.check_stores(stores).select("store", "store_error")


def _tree_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _tree_of_documents(spark, sf_dir)
    state = trees.build_manifest(spark, root)
    return state.manifest.select("path", "kind", "digest", "unreadable")


def _restore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restore every document from a copy of the tree into an empty folder."""
    copy, docs = _tree_of_documents(spark, sf_dir)
    target = mounted(new_shared_path(spark, "restored"))
    manifests = docs.selectExpr(
        "path", "'blob' AS kind", "sha1(text) AS digest", "sha1('c0') AS revision"
    )
    commits, stores, snapshots = _tables(spark, sf_dir, i.HISTORY, "commits", "stores", "snapshots")
    first = commits.where("seq = 0")
    one = snapshots.where("reference = 'aux1/1'")
    copies = one.select("reference").withColumn("root", F.lit(copy))
    requests = docs.selectExpr("path", "'HEAD' AS ref")
    return recover.restore(requests, target, first, manifests, one, stores, copies)


def _restore_two_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is asked for at two revisions; the newer one is restored."""
    (docs,) = _tables(spark, sf_dir, i.DOCS, "docs")
    edited = docs.selectExpr("path", "concat(text, '!') AS text")
    manifests = docs.selectExpr("path", "'blob' AS kind", "sha1(text) AS digest", "sha1('c0') AS revision").union(
        edited.selectExpr("path", "'blob'", "sha1(text)", "sha1('c1')")
    )
    commits, stores, snapshots = _tables(spark, sf_dir, i.HISTORY, "commits", "stores", "snapshots")
    two = snapshots.where("reference IN ('aux1/1', 'aux1/2')")
    roots = {"aux1/1": _write_tree(docs), "aux1/2": _write_tree(edited)}
    copies = spark.createDataFrame(list(roots.items()), "reference string, root string")
    requests = docs.selectExpr("path", "explode(array('HEAD', 'HEAD~1')) AS ref")
    target = mounted(new_shared_path(spark, "restored"))
    done = recover.restore(
        requests, target, commits.where("seq <= 1"), _stored(manifests, "revision"), two, stores, copies
    )
    there = trees.build_manifest(spark, target).manifest.select("path", "digest")
    return done.join(there, "path").select("path", "ref", "outcome", "reference", "digest")


def queries() -> dict[str, Query]:
    return {
        "diff": _diff,
        "diff_ties": _pair_diff(i.TIES),
        "diff_orders": _diff_orders,
        # A lower mark for large groups, so that the split ranks run at the size of the test data.
        "diff_crowded": _pair_diff(i.CROWDED, hot_rows=2_000),
        "diff_pruned": _diff_pruned,
        "keep_unread": _keep_unread,
        "refresh_unread": _refresh_unread,
        "diff_copies": _pair_diff(i.COPIES, new="copied", copies=True),
        "diff_typechange": _pair_diff(i.LINKED, typechange=True),
        "diff_kinds_apart": _pair_diff(i.LINKED),
        "filter_upper": lambda s, d: compare.filter_status(_diff(s, d), "MR"),
        "filter_lower": lambda s, d: compare.filter_status(_diff(s, d), "ad"),
        "adds_new_content": _adds_new_content,
        "commit_gate": lambda s, d: compare.new_content(_pair_diff(i.CROWDED)(s, d)),
        "status_letters": _status_letters,
        "path_change": _path_change,
        "raw_lines": lambda s, d: export.raw_lines(_diff(s, d)),
        "rename_plan": lambda s, d: export.rename_plan(_diff(s, d)),
        "rename_limit": _pair_diff(i.ORDERS, limit=500),
        "emptied_dirs": _emptied_dirs,
        "constrain": _constrain,
        "constrain_cross_rename": _constrain_cross_rename,
        "stage_paths": _stage_paths,
        "stage_glob_remove": _stage_glob_remove,
        "reset_paths": _reset_paths,
        "status": _status,
        "apply_delta": _apply_delta,
        "digest_text": _digest_text,
        "link_identity": _link_identity,
        "cache_split": _cache_split,
        "cache_moved": _cache_moved,
        "cache_replaced": _cache_replaced,
        "cache_entries": _cache_entries,
        "cache_refresh": _cache_refresh,
        "cache_upsert": _cache_upsert,
        "probe_listed": _probe_by_path_first(i.CACHE, "listing"),
        "probe_moved": _probe_by_path_first(i.MOVED, "moved"),
        "probe_replaced": _probe_by_path_first(i.REPLACED, "replaced"),
        "corruption": _corruption,
        "dir_rollup": _dir_rollup,
        "changed_dirs": _changed_dirs,
        "prune_ignored": _prune_ignored,
        "ignored_dirs": _ignored_dirs,
        "is_ignored": _is_ignored,
        "snapshot_ids": _snapshot_ids,
        "store_errors": _store_errors,
        "refresh_snapshots": _refresh_snapshots,
        "log": _log,
        "log_chain": _log_chain,
        "log_decorated": _log_decorated,
        "resolve": _resolve,
        "ancestors": _ancestors,
        "diff_refs": _diff_refs,
        "history_changes": _history_changes,
        "history_intervals": _history_intervals,
        "diff_refs_changes": _diff_refs_changes,
        "rollup_update": _rollup_update,
        "locate": _locate,
        "locate_first": _locate_first,
        "locate_chain": _locate_chain,
        "rank_candidates": _rank_candidates,
        "classify_requests": _classify_requests,
        "tree_manifest": _tree_manifest,
        "restore_files": _restore_files,
        "restore_two_refs": _restore_two_refs,
        "scan_paths": _scan_paths,
        "unreadable": _unreadable,
        "rehash": _rehash,
        "commit": _commit,
        "commit_times": _commit_times,
        "snapshot_table": _snapshot_table,
        "unreadable_differ": _unreadable_differ,
        "status_ignored": _status_ignored,
        "store_outcomes": _store_outcomes,
    }
