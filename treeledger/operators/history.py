"""Commits, their changes, and the names by which they are found."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.operators.compare import delta_of_sides, detect_renames
from treeledger.operators.intervals import changes_of_manifests
from treeledger.operators.spread import HOT_ROWS, lookup_join, sample_rows
from treeledger.session import stored

# Fixed value: the fewest digits by which a commit id may be abbreviated.
MIN_PREFIX = 4
_ID_LENGTH = 40


def head_seq(commits: DataFrame) -> Column:
    """The place of the newest commit, NULL without commits."""
    return commits.agg(F.expr("max(seq) AS seq")).scalar()


def head_commit(commits: DataFrame) -> DataFrame:
    return commits.where(F.col("seq") == head_seq(commits))


def ancestors(commits: DataFrame, commit_id: str | None = None) -> DataFrame:
    """The commit and all before it. History is one chain, so a filter on the place finds them."""
    if commit_id is None:
        return commits
    start = commits.where(F.col("commit_id") == commit_id).select("seq").scalar()
    return commits.where(F.col("seq") <= start)


def log(
    commits: DataFrame,
    manifests: DataFrame,
    commit_id: str | None = None,
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The changes of every commit against its parent, up to the given commit, as one job.

    Manifests are shuffled once, by path, where each row meets its neighbours in the history. Renames
    are looked for within each commit. A history that is kept as change sets goes to ``log_of_changes``.
    """
    wanted = ancestors(commits, commit_id)
    parts = [changes_of_manifests(wanted, rows, hot_rows) for rows in (manifests, sample_rows(manifests, ["path"], hot_rows))]
    return log_of_changes(wanted, parts[0], limit=limit, hot_rows=hot_rows, sample=parts[1])


def log_of_changes(
    commits: DataFrame,
    changes: DataFrame,
    commit_id: str | None = None,
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
    sample: DataFrame | None = None,
) -> DataFrame:
    """The same from change sets: what is read and shuffled is what changed. ``sample`` may give some of the paths."""
    wanted = ancestors(commits, commit_id).select("seq", "commit_id")
    scope = ["seq", "commit_id"]
    if sample is None:
        sample = sample_rows(changes, ["path"], hot_rows)
    deltas = []
    for part in (changes, sample):
        sides = part.selectExpr("seq", "path", "old_kind", "old_digest", "kind AS new_kind", "digest AS new_digest")
        deltas.append(delta_of_sides(lookup_join(sides, wanted, ["seq"], "inner", ["path"], hot_rows), scope))
    return detect_renames(deltas[0], scope, limit, sample=deltas[1], hot_rows=hot_rows)


def decorate(commits: DataFrame, snapshots: DataFrame, stores: DataFrame) -> DataFrame:
    """The names of each commit, one per row: ``HEAD`` and the snapshots taken of it.

    Sorted by ``ordinal`` and ``reference`` they come in display order, ``HEAD`` first. Rows and not
    lists, as one commit may have any number of snapshots.
    """
    heads = head_commit(commits).selectExpr("commit_id", "seq", "-1 AS ordinal", "'HEAD' AS reference")
    ordered = lookup_join(
        snapshots, stores.select("store", "ordinal"), ["store"], "inner", ["reference"]
    ).selectExpr("base_commit_id AS commit_id", "ordinal", "reference")
    known = commits.select("commit_id", "seq")
    taken = lookup_join(ordered, known, ["commit_id"], "inner", ["reference"])
    return heads.unionByName(taken.select("commit_id", "seq", "ordinal", "reference"))


# A name and the steps back from it: ``~n`` goes n commits back, ``^`` one, and they may be repeated.
_STEPS = r"^(.*?)((?:~[0-9]*|\\^[0-9]*)*)$"


def _by_prefix(keys: DataFrame, commits: DataFrame) -> DataFrame:
    """Which commit each proper beginning of an id stands for, where no other id begins so: _key, _short.

    Ids and keys are sorted together among those with the same first digits. The least id that is not below
    a key is the only one it can stand for, if the id after that one begins otherwise.
    """
    ids = commits.selectExpr("commit_id AS _at", "commit_id AS _id", "seq")
    every = ids.unionByName(keys.selectExpr("_key AS _at", "CAST(NULL AS STRING) AS _id", "CAST(NULL AS LONG) AS seq"))
    # From the last one down, an id before the key that equals it.
    down = f"OVER (PARTITION BY substring(_at, 1, {MIN_PREFIX}) ORDER BY _at DESC, _id IS NULL {{}})"
    before = down.format("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    placed = every.selectExpr("*", f"last(_id, true) {before} AS _above")
    near = placed.selectExpr("*", f"last(if(_id IS NULL, NULL, struct(_id, seq, _above)), true) {before} AS _near")
    return near.where("_id IS NULL AND _near._id <> _at AND startswith(_near._id, _at) AND NOT coalesce(startswith(_near._above, _at), false)").selectExpr(
        "_at AS _key", "_near.seq AS _short"
    )


def resolve_refs(
    refs: DataFrame,
    commits: DataFrame,
    snapshots: DataFrame | None = None,
    branch: str = "master",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The commit each name stands for; ``problem`` says so where there is none.

    A snapshot's name comes first, then ``HEAD``, ``@`` and the branch, and a commit id or the start of
    one that no other commit shares; steps back (``~n``, ``^``) may follow any of them. A commit has one
    parent, so ``^2`` stands for nothing. Very many names may share a base or stand for one commit; small
    tables of snapshots and commits are sent to the names, large ones meet them with such keys split.
    """
    step = "CASE WHEN x IN ('~', '^', '^1') THEN 1L WHEN x = '^0' THEN 0L WHEN x LIKE '~%' THEN try_cast(substring(x, 2) AS bigint) END"
    stepped = f"regexp_extract(ref, '{_STEPS}', {{}})"
    has_steps = "coalesce(ref RLIKE '[~^]', false)"
    asked = refs.select("ref").distinct()
    plain = asked.where(f"NOT {has_steps}").selectExpr("ref", "ref AS _base", "0L AS _steps")
    parsed = asked.where(has_steps).selectExpr(
        "ref",
        f"{stepped.format(1)} AS _base",
        f"aggregate(regexp_extract_all({stepped.format(2)}, '[~^][0-9]*', 0), 0L, (a, x) -> a + {step}) AS _steps",
    )
    if snapshots is None:
        named = plain.unionByName(parsed).selectExpr("ref", "_base AS _target", "_steps")
    else:
        taken = stored(snapshots.select("reference", "base_commit_id"), "taken")
        whole, part = (taken.selectExpr(f"reference AS {c}", f"base_commit_id AS {name}") for c, name in (("ref", "_whole"), ("_base", "_part")))
        # A name without steps is its own base, so both lookups find it where it lies.
        own = taken.selectExpr("reference AS ref", "base_commit_id AS _part")
        named = lookup_join(lookup_join(plain, whole, ["ref"], "left", ["ref"], hot_rows), own, ["ref"], "left", ["ref"], hot_rows)
        # Few snapshots have a name that looks like steps, or one of those that stand for the newest commit.
        found = lookup_join(parsed, whole.where(has_steps), ["ref"], "left", ["ref"], hot_rows)
        tip = F.coalesce(F.col("_base").isin("HEAD", "@", branch), F.lit(False))
        for rows, names in ((found.where(tip), part.where(tip)), (found.where(~tip), part.where(~tip))):
            named = named.unionByName(lookup_join(rows, names, ["_base"], "left", ["ref"], hot_rows))
        named = named.selectExpr("ref", "coalesce(_whole, _part, _base) AS _target", "if(_whole IS NULL, _steps, 0L) AS _steps")

    known = stored(commits.select("commit_id", "seq"), "known")
    keyed = stored(
        named.withColumn("_head", head_seq(known))
        .withColumn("_branch", F.lit(branch))
        .selectExpr("*", "_target IN ('HEAD', '@', _branch) AS _at_head")
        .selectExpr("ref", "_steps", "if(_at_head, _head, NULL) AS _tip", "if(_at_head, NULL, lower(_target)) AS _key"),
        "keyed",
    )
    hex_key = f"_key RLIKE '^[0-9a-f]{{{MIN_PREFIX},{_ID_LENGTH - 1}}}$'"
    short = _by_prefix(keyed.where(hex_key).select("_key").distinct(), known)
    # An id that is found whole is no beginning, so each key has one of the two.
    ids = stored(known.selectExpr("commit_id AS _key", "seq AS _found").unionByName(short.selectExpr("_key", "_short AS _found")), "ids")
    # What stands for the newest commit has no key to look for.
    based = lookup_join(keyed.where("_key IS NOT NULL").drop("_tip"), ids, ["_key"], "left", ["ref"], hot_rows)
    based = based.selectExpr("ref", "_found - _steps AS seq").unionByName(
        keyed.where("_key IS NULL").selectExpr("ref", "_tip - _steps AS seq")
    )
    return lookup_join(based, known, ["seq"], "left", ["ref"], hot_rows).selectExpr(
        "ref",
        "commit_id",
        "if(commit_id IS NULL, NULL, seq) AS seq",
        "if(commit_id IS NULL, 'bad revision', NULL) AS problem",
    )


def with_times(commits: DataFrame) -> DataFrame:
    """Commits with ``committed_at``, a timestamp, and ``local_time``, the clock where they were made."""
    zone = "format_string('%s%02d:%02d', if(tz_offset_min < 0, '-', '+'), abs(tz_offset_min) DIV 60, abs(tz_offset_min) % 60)"
    # The day and the seconds of the day are counted, so the session's zone plays no part.
    moved = "(commit_time + 60L * tz_offset_min)"
    day = f"date_format(date_add(DATE'1970-01-01', CAST(floor({moved} / 86400) AS INT)), 'yyyy-MM-dd')"
    second = f"pmod({moved}, 86400L)"
    clock = f"format_string('%02d:%02d:%02d', {second} DIV 3600, {second} DIV 60 % 60, {second} % 60)"
    return commits.selectExpr(
        "*",
        "timestamp_seconds(commit_time) AS committed_at",
        f"concat_ws(' ', {day}, {clock}, {zone}) AS local_time",
    )


def resolve_names(
    names: list[str], commits: DataFrame, snapshots: DataFrame | None = None
) -> list[str]:
    """The commit ids of a few names, looked up at once; a name without a commit is an error."""
    refs = commits.sparkSession.createDataFrame([(name,) for name in names], "ref string")
    found = {row["ref"]: row["commit_id"] for row in resolve_refs(refs, commits, snapshots).collect()}
    for name in names:
        if found[name] is None:
            raise ValueError(f"bad revision: {name}")
    return [found[name] for name in names]
