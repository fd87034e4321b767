"""Which backup snapshot still holds the content a file had at some revision."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import proper_ancestors
from treeledger.operators.history import resolve_refs
from treeledger.operators.intervals import intervals_of_manifests, last_marked, marks_by_block, with_last_marked
from treeledger.operators.spread import HOT_ROWS, MAX_LOOKUP_ROWS, hot_keys, lookup_join, sample_rows, spread_join
from treeledger.schema import BLOB, LINK
from treeledger.session import stored

# Depths of unknown paths that are told apart, at most.
_MAX_DEPTHS = 64


def bind_requests(
    requests: DataFrame, commits: DataFrame, manifests: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """Requests with the commit their ``ref`` stands for and the entry their path has there.

    A stored table: names are resolved once, whatever the requests go through afterwards.
    """
    asked = requests.select("path", "ref").distinct()
    found = stored(resolve_refs(asked, commits, snapshots), "refs")
    # Many requests may name the same commit.
    named = lookup_join(asked, found, ["ref"], "left", ["path"])
    entries = manifests.selectExpr("revision AS commit_id", "path", "kind", "digest")
    return stored(named.join(entries, ["commit_id", "path"], "left"), "requests")


def locate(
    requests: DataFrame,
    commits: DataFrame,
    manifests: DataFrame,
    snapshots: DataFrame,
    stores: DataFrame,
    any_revision: bool = False,
    hot_rows: int = HOT_ROWS,
    bound: DataFrame | None = None,
) -> DataFrame:
    """One row per request and snapshot that holds the requested content.

    ``requests`` has ``path`` and ``ref``. Snapshots of the requested commit and of those before
    it count, or of any commit with ``any_revision``. In a snapshot the requested path is taken if
    it holds the content, else the first path that does, at any depth.

    Copies of one content are first reduced to one path per commit, so no request meets more rows
    than there are commits with snapshots. ``bound`` gives what ``bind_requests`` found.

    Large keys are looked for in the stored requests and manifests, not in what is derived from them.
    """
    if bound is None:
        bound = bind_requests(requests, commits, manifests, snapshots)
    wanted = bound.where(f"kind = '{BLOB}'").select(
        "path", "ref", "kind", "digest", F.col("seq").alias("_seq")
    )

    bases = stored(
        snapshots.selectExpr("base_commit_id AS commit_id")
        .distinct()
        .join(commits.select("commit_id", "seq"), "commit_id"),
        "bases",
    )
    rows = manifests.selectExpr("revision AS commit_id", "path", "kind", "digest")
    held = lookup_join(rows, bases, ["commit_id"], "inner", ["path"], hot_rows)
    contents = wanted.select("kind", "digest").distinct()
    first_paths = (
        spread_join(
            held, contents, ["kind", "digest"], "left_semi", ["path"], hot_rows, sample_rows(rows, ["path"], hot_rows)
        )
        .groupBy("commit_id", "seq", "kind", "digest")
        .agg(F.expr("min(path) AS _first"))
    )
    found = spread_join(
        wanted, first_paths, ["kind", "digest"], "inner", ["path", "ref"], hot_rows
    )
    if not any_revision:
        found = found.where("seq <= _seq")
    in_place = held.selectExpr("commit_id", "path", "kind", "digest", "true AS _in_place")
    placed = found.join(in_place, ["commit_id", "path", "kind", "digest"], "left").selectExpr(
        "path",
        "ref",
        "kind",
        "digest",
        "commit_id",
        "seq",
        "if(_in_place, path, _first) AS found_path",
        "coalesce(_in_place, false) AS same_path",
    )

    sources = stored(
        lookup_join(
            snapshots, stores.select("store", "ordinal"), ["store"], "inner", ["reference"]
        ).selectExpr("base_commit_id AS commit_id", "store", "snapshot_id", "reference", "ordinal"),
        "sources",
    )
    return lookup_join(placed, sources, ["commit_id"], "inner", ["path", "ref"], hot_rows)


def locate_first(
    bound: DataFrame,
    commits: DataFrame,
    intervals: DataFrame,
    snapshots: DataFrame,
    stores: DataFrame,
    store: str | None = None,
    any_revision: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The snapshot to try first for each request that some snapshot can serve, at most one row each.

    The same row that ``locate`` and ``rank_candidates`` put first, without making the others. ``bound`` is
    what ``bind_requests`` gives, ``intervals`` the history; ``store`` lets only its snapshots count.
    An interval of content is cut at the last snapshot within it. The newest snapshot that serves a request
    is then the smaller of two places: the last snapshot before the request, and the furthest that any
    interval of the content which began by then reaches. That is a running maximum per content, whose
    rows are as many as the content has beginnings, and requests times, that differ.
    """
    named = lookup_join(snapshots, stores.select("store", "ordinal"), ["store"], "inner", ["reference"])
    if store is not None:
        named = named.where(F.col("store") == store)
    known = commits.select("commit_id", "seq")
    sources = stored(
        lookup_join(named.withColumnRenamed("base_commit_id", "commit_id"), known, ["commit_id"], "inner", ["reference"])
        .groupBy("seq", "commit_id")
        .agg(F.expr("min(struct(ordinal, snapshot_id, store, reference)) AS _source"))
        .selectExpr("seq", "commit_id", "_source.ordinal", "_source.snapshot_id", "_source.store", "_source.reference"),
        "sources",
    )
    # Content ends at the place before the commit that takes it away.
    places = known.selectExpr("explode(array(seq, seq - 1)) AS seq")
    blocks = stored(marks_by_block(places, sources.select("seq")), "blocks")
    most = sources.agg(F.expr("max(seq) AS seq")).scalar()

    asked = bound.where(f"kind = '{BLOB}' AND seq IS NOT NULL AND digest IS NOT NULL").select("path", "ref", "kind", "digest", "seq")
    if any_revision:
        wanted = asked.withColumn("_until", most)
    else:
        wanted = with_last_marked(asked, "seq", "_until", blocks, ["path", "ref"], hot_rows)
    wanted = wanted.drop("seq").where("_until IS NOT NULL")
    runs = intervals.where(f"kind = '{BLOB}' AND digest IS NOT NULL")
    crowded = hot_keys(
        sample_rows(asked, ["path", "ref"], hot_rows)
        .select("kind", "digest")
        .unionByName(sample_rows(runs, ["path", "from_seq"], hot_rows).select("kind", "digest")),
        ["kind", "digest"],
    )
    # Few requests leave most of a history out before anything is shuffled.
    if asked.limit(MAX_LOOKUP_ROWS + 1).count() <= MAX_LOOKUP_ROWS:
        runs = lookup_join(runs, asked.select("kind", "digest").distinct(), ["kind", "digest"], "left_semi", ["path", "from_seq"], hot_rows)
    # What still lasts reaches to the last snapshot of all.
    runs = runs.withColumn("_end", F.coalesce(F.expr("to_seq - 1"), most))
    held = (
        with_last_marked(runs, "_end", "_reach", blocks, ["path", "from_seq"], hot_rows)
        .select("path", "kind", "digest", "from_seq", "_reach")
        .where("_reach >= from_seq")
    )

    if crowded is None:
        placed = _place(wanted, held)
    else:
        contents = crowded.select("kind", "digest")
        plain, large = (
            [side.join(F.broadcast(contents), ["kind", "digest"], how) for side in (wanted, held)] for how in ("left_anti", "left_semi")
        )
        placed = _place(*plain).unionByName(_place_crowded(large[0], stored(large[1], "held"), hot_rows))
    placed = stored(placed, "placed")
    # Content that lies elsewhere, beside copies that lasted longer: its first path there.
    moved = stored(placed.where("_open").select("kind", "digest", "seq").distinct(), "moved")
    there = placed.withColumnRenamed("_found", "_first")
    if not moved.isEmpty():
        elsewhere = (
            lookup_join(held, moved, ["kind", "digest"], "inner", ["path", "from_seq"], hot_rows)
            .where("seq BETWEEN from_seq AND _reach")
            .groupBy("kind", "digest", "seq")
            .agg(F.expr("min(path) AS _first"))
            .withColumn("_open", F.lit(True))
        )
        there = lookup_join(
            placed, stored(elsewhere, "elsewhere"), ["kind", "digest", "seq", "_open"], "left", ["path", "ref"], hot_rows
        ).withColumn("_first", F.expr("if(_open, _first, _found)"))
    return lookup_join(there, sources, ["seq"], "inner", ["path", "ref"], hot_rows).selectExpr(
        "path", "ref", "kind", "digest", "commit_id", "seq", "if(same_path, path, _first) AS found_path", "same_path",
        "store", "snapshot_id", "reference", "ordinal",
    )


def _place(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """The newest snapshot of each request, of contents with ordinary numbers of rows, by one shuffle.

    Adds ``seq``, ``same_path``, the first path ``_found`` that holds the content there, and ``_open`` if that
    must be looked for: where copies reach beyond the place. Where they end with it, they are those that
    reach furthest, so their first path comes with the maximum.
    """
    rows = held.selectExpr("kind", "digest", "path", "CAST(NULL AS STRING) AS ref", "from_seq AS at", "_reach").unionByName(
        wanted.selectExpr("kind", "digest", "path", "ref", "_until AS at", "CAST(NULL AS LONG) AS _reach")
    )
    # Everything below is grouped by at least these.
    first = rows.repartition("kind", "digest").selectExpr("*", "min(path) OVER (PARTITION BY kind, digest, _reach) AS _first")
    furthest = first.selectExpr(
        "* EXCEPT (_first)",
        """max(if(_reach IS NULL, NULL, struct(_reach AS seq, _first AS path)))
           OVER (PARTITION BY kind, digest ORDER BY at, _reach IS NULL ROWS UNBOUNDED PRECEDING) AS _far""",
    )
    return (
        furthest.withColumn("seq", F.expr("if(_reach IS NULL, least(at, _far.seq), at)"))
        .selectExpr(
            "*", "max(_reach) OVER (PARTITION BY kind, digest, path ORDER BY seq, _reach IS NULL ROWS UNBOUNDED PRECEDING) AS _own"
        )
        .where("_reach IS NULL AND _far IS NOT NULL")
        .withColumn("same_path", F.expr("path IS NOT NULL AND coalesce(_own >= seq, false)"))
        .selectExpr(
            "path", "ref", "kind", "digest", "seq", "same_path", "NOT same_path AND _far.seq > seq AS _open",
            "if(same_path OR _far.seq > seq, NULL, _far.path) AS _found",
        )
    )


def _place_crowded(wanted: DataFrame, held: DataFrame, hot_rows: int) -> DataFrame:
    """The same of contents with very many rows: requests and beginnings that differ meet, and go back to the others."""
    starts = held.groupBy("kind", "digest", F.expr("from_seq AS at")).agg(F.expr("max(_reach) AS _reach"))
    points = wanted.selectExpr("kind", "digest", "_until AS at", "CAST(NULL AS LONG) AS _reach").distinct()
    best = (
        starts.unionByName(points)
        .selectExpr(
            "kind", "digest", "at", "_reach IS NULL AS _asks",
            "max(_reach) OVER (PARTITION BY kind, digest ORDER BY at, _reach IS NULL ROWS UNBOUNDED PRECEDING) AS _far",
        )
        .where("_asks AND _far IS NOT NULL")
        .selectExpr("kind", "digest", "at AS _until", "least(at, _far) AS seq")
    )
    found = spread_join(wanted, best, ["kind", "digest", "_until"], "inner", ["path", "ref"], hot_rows).drop("_until")

    # A path has few intervals of one content; at most one holds the place.
    own = held.selectExpr("path AS _path", "kind AS _kind", "digest AS _digest", "from_seq", "_reach")
    inside = "path = _path AND kind = _kind AND digest = _digest AND seq >= from_seq AND seq <= _reach"
    return found.join(own, F.expr(inside), "left").selectExpr(
        *found.columns, "_path IS NOT NULL AS same_path", "_path IS NULL AS _open", "CAST(NULL AS STRING) AS _found"
    )


def serviceable(
    bound: DataFrame,
    commits: DataFrame,
    intervals: DataFrame,
    snapshots: DataFrame,
    stores: DataFrame,
    store: str | None = None,
    any_revision: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The requests that some snapshot can serve, without saying which: path, ref, and ``matching``, whether one of ``store`` can.

    A request has a row here where it has one in ``locate_first``. An interval of content counts if a snapshot
    lies within it, and a request is served if the earliest beginning of such an interval is not after the
    last snapshot before the request. So one beginning per content is all that meets the requests.
    """
    fits = F.lit(True) if store is None else F.col("store") == store
    named = lookup_join(snapshots, stores.select("store"), ["store"], "inner", ["reference"])
    known = commits.select("commit_id", "seq")
    taken = stored(
        lookup_join(named.select(F.col("base_commit_id").alias("commit_id"), fits.alias("_fits")), known, ["commit_id"], "inner", ["_fits"])
        .groupBy("seq")
        .agg(F.bool_or("_fits").alias("_fits")),
        "taken",
    )
    places = known.selectExpr("explode(array(seq, seq - 1)) AS seq").distinct()
    every = last_marked(places, taken.select("seq")).withColumnRenamed("last", "_every")
    own = last_marked(places, taken.where("_fits").select("seq")).withColumnRenamed("last", "_own")
    newest = stored(every.join(own, "seq", "left"), "newest")
    most = newest.agg(F.expr("max(struct(seq, _every, _own)) AS m")).scalar()

    ends = newest.selectExpr("seq AS _end", "_every", "_own")
    runs = lookup_join(intervals.selectExpr("*", "to_seq - 1 AS _end"), ends, ["_end"], "left", ["path", "from_seq"], hot_rows)
    reach = {name: f"if(if(to_seq IS NULL, _most.{name}, {name}) >= from_seq, from_seq, NULL)" for name in ("_every", "_own")}
    firsts = (
        runs.where(f"kind = '{BLOB}'")
        .withColumn("_most", most)
        .groupBy("kind", "digest")
        .agg(F.expr(f"min({reach['_every']}) AS _first"), F.expr(f"min({reach['_own']}) AS _first_own"))
        .where("_first IS NOT NULL")
    )
    wanted = bound.where(f"kind = '{BLOB}' AND seq IS NOT NULL").select("path", "ref", "kind", "digest", "seq")
    if any_revision:
        wanted = wanted.withColumn("seq", most["seq"])
    wanted = lookup_join(wanted, newest, ["seq"], "inner", ["path", "ref"], hot_rows)
    return (
        spread_join(wanted, firsts, ["kind", "digest"], "inner", ["path", "ref"], hot_rows)
        .where("_first <= _every")
        .selectExpr("path", "ref", "coalesce(_first_own <= _own, false) AS matching")
    )


def rank_candidates(located: DataFrame, store: str | None = None) -> DataFrame:
    """Number the snapshots of each request in the order to try them.

    The newest commit comes first, then the order of stores, then the snapshot id. With ``store``
    others are set aside: not ``eligible``, numbered among themselves. One request has at most as
    many rows as there are snapshots.
    """
    eligible = F.lit(True) if store is None else F.col("store") == store
    return located.withColumn("eligible", eligible).selectExpr(
        "*",
        """row_number() OVER (PARTITION BY path, ref, eligible
                              ORDER BY seq DESC, ordinal, snapshot_id) AS try_order""",
    )


def _asked_dirs(entries: DataFrame, manifests: DataFrame, hot_rows: int) -> DataFrame:
    """Those of the unknown paths that are directories of their commit.

    Rows are cut to the depths that the unknown paths have, and meet these before anything is shuffled if
    they are few.
    """
    deep = "size(split(path, '/'))"
    unknown = stored(
        entries.where("commit_id IS NOT NULL AND kind IS NULL").select("commit_id", "path").distinct(), "unknown"
    )
    depths = [r.d for r in unknown.selectExpr(f"if(path = '', 0, {deep}) AS d").distinct().limit(_MAX_DEPTHS + 1).collect()]
    if len(depths) > _MAX_DEPTHS:
        above = proper_ancestors()
    else:
        listed = ", ".join(str(d) for d in sorted(depths)) or "-1"
        above = f"transform(filter(array({listed}), d -> d < {deep}), d -> substring_index(path, '/', d))"
    rows = manifests.selectExpr("revision AS commit_id", "path")
    revisions = unknown.select("commit_id").distinct()
    below = lookup_join(rows, revisions, ["commit_id"], "left_semi", ["path"], hot_rows)
    cut = below.selectExpr("commit_id", f"explode({above}) AS path")
    return (
        lookup_join(cut, unknown, ["commit_id", "path"], "left_semi", ["path"], hot_rows)
        .distinct()
        .selectExpr("commit_id", "path", "true AS _is_dir")
    )


def classify_requests(
    requests: DataFrame,
    commits: DataFrame,
    manifests: DataFrame,
    snapshots: DataFrame,
    stores: DataFrame,
    existing: DataFrame | None = None,
    store: str | None = None,
    any_revision: bool = False,
    located: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    bound: DataFrame | None = None,
    intervals: DataFrame | None = None,
) -> DataFrame:
    """What will become of each request, as a word instead of an error.

    ``existing`` lists paths that are in the working tree and will not be overwritten. ``bound`` gives
    what ``bind_requests`` found, ``intervals`` the history if it is at hand.
    """
    entries = bind_requests(requests, commits, manifests, snapshots) if bound is None else bound
    if located is None:
        if intervals is None:
            intervals = stored(intervals_of_manifests(commits, manifests, hot_rows), "intervals")
        served = serviceable(entries, commits, intervals, snapshots, stores, store, any_revision, hot_rows)
        offers = served.selectExpr("path", "ref", "true AS _offered", "matching AS _matching")
    else:
        matching = F.expr("true") if store is None else F.col("store") == store
        offers = located.groupBy("path", "ref").agg(F.expr("true AS _offered"), F.bool_or(matching).alias("_matching"))
    asked = requests.select("path").distinct()
    dirs = _asked_dirs(entries, manifests, hot_rows)
    there = (
        asked.select("path").where("false") if existing is None else existing.select("path")
    ).distinct()
    return (
        entries.join(dirs, ["commit_id", "path"], "left")
        .join(offers, ["path", "ref"], "left")
        .join(there.selectExpr("path", "true AS _exists"), "path", "left")
        .withColumn("_no_commit", commits.agg(F.expr("count(1) = 0 AS none")).scalar())
        .selectExpr(
            "path",
            "ref",
            "commit_id",
            f"""CASE WHEN _no_commit THEN 'no_commit'
                     WHEN _exists THEN 'exists'
                     WHEN commit_id IS NULL THEN 'bad_revision'
                     WHEN kind IS NULL AND _is_dir THEN 'directory'
                     WHEN kind IS NULL THEN 'unknown_path'
                     WHEN kind = '{LINK}' THEN 'link'
                     WHEN _offered IS NULL THEN 'no_snapshot'
                     WHEN NOT coalesce(_matching, false) THEN 'excluded_only'
                     ELSE 'ok' END AS outcome""",
        )
    )
