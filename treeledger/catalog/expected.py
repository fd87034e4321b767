"""The same results in plain SQL, each from the definition of the operator and not from its plan."""

from treeledger.catalog import inputs as i
from treeledger.schema import SKIP_FLAGS, SKIP_NAMES, LEDGER_DIR

_NAMES = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "copied", "T": "type-changed"}
_NAME = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " END"


def _delta(old: str = "old", new: str = "new", scope: tuple[str, ...] = (), out: str = "delta", typechange: bool = False) -> str:
    """Common table expressions that end in the changes with renames paired by rank."""
    s = "".join(f"{c}, " for c in scope)
    both = " AND ".join(f"o.{c} = n.{c}" for c in (*scope, "path"))
    scoped = "".join(f"coalesce(o.{c}, n.{c}) AS {c}, " for c in scope)
    pair = " AND ".join(f"d.{c} = a.{c}" for c in (*scope, "kind", "digest", "k"))
    paired = "".join(f"coalesce(d.{c}, a.{c}) AS {c}, " for c in scope)
    changed = f"""
      SELECT {s}'M' AS status, old_path, new_path, old_kind, new_kind, old_digest, new_digest, 0 AS similarity
      FROM {out}_sides WHERE old_kind = new_kind AND old_digest <> new_digest"""
    if typechange:
        changed += f"""
      UNION ALL SELECT {s}'T', old_path, new_path, old_kind, new_kind, old_digest, new_digest, 0
      FROM {out}_sides WHERE old_kind <> new_kind"""
    gone = "new_path IS NULL" if typechange else "(new_path IS NULL OR old_kind <> new_kind)"
    fresh = "old_path IS NULL" if typechange else "(old_path IS NULL OR old_kind <> new_kind)"
    return f"""
{out}_sides AS (
  SELECT {scoped}o.path AS old_path, n.path AS new_path, o.kind AS old_kind, n.kind AS new_kind,
         o.digest AS old_digest, n.digest AS new_digest
  FROM {old} o FULL OUTER JOIN {new} n ON {both}),
{out}_d AS (
  SELECT {s}old_path AS path, old_kind AS kind, old_digest AS digest,
         row_number() OVER (PARTITION BY {s}old_kind, old_digest ORDER BY old_path) AS k
  FROM {out}_sides WHERE old_path IS NOT NULL AND {gone}),
{out}_a AS (
  SELECT {s}new_path AS path, new_kind AS kind, new_digest AS digest,
         row_number() OVER (PARTITION BY {s}new_kind, new_digest ORDER BY new_path) AS k
  FROM {out}_sides WHERE new_path IS NOT NULL AND {fresh}),
{out}_all AS ({changed}
  UNION ALL
  SELECT {paired}CASE WHEN d.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' ELSE 'R' END,
         d.path, a.path, d.kind, a.kind, d.digest, a.digest,
         CASE WHEN d.path IS NULL OR a.path IS NULL THEN 0 ELSE 100 END
  FROM {out}_d d FULL OUTER JOIN {out}_a a ON {pair}),
{out} AS (
  SELECT {s}status, {_NAME.format('status')} AS status_name, old_path, new_path,
         coalesce(new_path, old_path) AS path, old_kind, new_kind, old_digest, new_digest, similarity
  FROM {out}_all)"""


def _sql(ctes: str, select: str) -> str:
    return i.plain_sql(f"WITH {ctes} {select}")


def _diff(ctes: str, select: str = "SELECT * FROM delta", **options) -> str:
    return _sql(f"{ctes},{_delta(**options)}", select)


def _inside(path: str, table: str) -> str:
    """Is there a row in the table with this path or a directory above it."""
    return f"""EXISTS (SELECT 1 FROM {table} g
        WHERE {path} = g.path OR g.path = '' OR starts_with({path}, concat(g.path, '/')))"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SKIP = (*SKIP_NAMES, LEDGER_DIR)
_PARTS = "string_split(path, '/')"

# Directories left out, with every reason.
_HITS = f"""
steps AS (
  SELECT path, {_PARTS} AS parts, unnest(range(1, len({_PARTS}) + 1)) AS n FROM listing),
reasons AS (
  SELECT array_to_string(parts[1:n], '/') AS path, parts[n] AS reason
  FROM steps WHERE n < len(parts) AND list_contains({_list(_SKIP)}, parts[n])
  UNION
  SELECT coalesce(array_to_string(parts[1:n - 1], '/'), ''), parts[n]
  FROM steps WHERE list_contains({_list(SKIP_FLAGS)}, parts[n])),
hits AS (SELECT path, min(reason) AS reason FROM reasons GROUP BY path)"""

_LOG = f"""{i.HISTORY},
log_new AS (SELECT c.seq, c.commit_id, m.path, m.kind, m.digest
            FROM manifests m JOIN commits c ON m.revision = c.commit_id),
log_old AS (SELECT c.seq, c.commit_id, m.path, m.kind, m.digest
            FROM manifests m JOIN commits c ON m.revision = c.parent_id),
{_delta('log_old', 'log_new', ('seq', 'commit_id')).strip()}"""

_STAGE = f"""{i.PAIR},
changed AS (SELECT concat(source, '/', lang) AS path FROM docs WHERE toxic = 1
            UNION SELECT spanish_path FROM docs WHERE lang = 'es'
            UNION SELECT 'web'),
staged AS (
  SELECT path, kind, digest FROM old WHERE NOT {_inside('old.path', 'changed')}
  UNION ALL SELECT path, kind, digest FROM new WHERE {_inside('new.path', 'changed')})"""

_STEP = """CASE WHEN x IN ('~', '^', '^1') THEN 1 WHEN x = '^0' THEN 0
    WHEN x LIKE '~%' THEN coalesce(TRY_CAST(substr(x, 2) AS BIGINT), 1000000000000) ELSE 1000000000000 END"""
_SUFFIX = r"'^(.*?)((?:~[0-9]*|\^[0-9]*)*)$'"

_RESOLVED = f"""{i.CHAIN},
parsed AS MATERIALIZED (
  SELECT ref, regexp_extract(ref, {_SUFFIX}, 1) AS base,
         coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(ref, {_SUFFIX}, 2), '[~^][0-9]*'), lambda x: {_STEP})), 0) AS steps
  FROM (SELECT DISTINCT ref FROM refs) a),
known AS MATERIALIZED (SELECT reference, base_commit_id FROM snapshots),
chain AS MATERIALIZED (SELECT commit_id, seq, substr(commit_id, 1, 4) AS start FROM commits),
named AS MATERIALIZED (
  SELECT p.ref, lower(coalesce(w.base_commit_id, b.base_commit_id, p.base)) AS target,
         coalesce(w.base_commit_id, b.base_commit_id, p.base) IN ('HEAD', '@', 'master') AS at_head,
         CASE WHEN w.reference IS NULL THEN p.steps ELSE 0 END AS steps
  FROM parsed p LEFT JOIN known w ON w.reference = p.ref LEFT JOIN known b ON b.reference = p.base),
by_id AS (
  SELECT n.ref, n.steps, min(c.seq) AS seq
  FROM (SELECT *, substr(target, 1, 4) AS start FROM named
        WHERE NOT at_head AND regexp_matches(target, '^[0-9a-f]{{4,40}}$')) n
  JOIN chain c ON c.start = n.start WHERE starts_with(c.commit_id, n.target)
  GROUP BY n.ref, n.steps HAVING count(*) = 1),
by_place AS (SELECT ref, steps, (SELECT max(seq) FROM chain) AS seq FROM named WHERE at_head),
asked AS (SELECT ref FROM parsed),
places AS MATERIALIZED (SELECT ref, CAST(seq - steps AS BIGINT) AS place FROM (SELECT * FROM by_place UNION ALL SELECT * FROM by_id) u),
found AS (SELECT p.ref, c.commit_id, c.seq FROM places p JOIN chain c ON c.seq = p.place)"""

_LOCATED = f"""{i.HISTORY},
bound AS (
  SELECT r.path, r.ref, c.commit_id, c.seq FROM requests r
  JOIN (SELECT substr(sha1('c1'), 1, 10) AS ref, sha1('c1') AS id UNION ALL SELECT 'aux1/3', sha1('c2')
        UNION ALL SELECT 'HEAD', sha1('c4')) t ON r.ref = t.ref
  JOIN commits c ON c.commit_id = t.id),
wanted AS (
  SELECT b.path, b.ref, b.seq, m.kind, m.digest FROM bound b
  JOIN manifests m ON m.revision = b.commit_id AND m.path = b.path),
holders AS (
  SELECT w.path, w.ref, w.kind, w.digest, c.commit_id, c.seq,
         min(CASE WHEN m.path = w.path THEN m.path END) AS here, min(m.path) AS anywhere
  FROM wanted w JOIN manifests m ON m.kind = w.kind AND m.digest = w.digest
  JOIN commits c ON c.commit_id = m.revision AND c.seq <= w.seq
  WHERE c.commit_id IN (SELECT base_commit_id FROM snapshots)
  GROUP BY ALL),
located AS (
  SELECT h.path, h.ref, h.kind, h.digest, h.commit_id, h.seq, coalesce(here, anywhere) AS found_path,
         here IS NOT NULL AS same_path, s.store, s.snapshot_id, s.reference, t.ordinal
  FROM holders h JOIN snapshots s ON s.base_commit_id = h.commit_id JOIN stores t ON t.store = s.store)"""

_PATH_CHANGE = """
parts AS (SELECT *, string_split(old_path, '/') AS a, string_split(new_path, '/') AS b FROM delta WHERE status = 'R'),
fronts AS (SELECT *, (SELECT count(*) FROM (SELECT unnest(range(1, least(len(a), len(b)) + 1)) AS n) t
                      WHERE a[1:n] = b[1:n]) AS f FROM parts),
backs AS (SELECT *, (SELECT count(*) FROM (SELECT unnest(range(1, least(len(a), len(b)) - f + 1)) AS n) t
                     WHERE a[len(a) - n + 1:len(a)] = b[len(b) - n + 1:len(b)]) AS e FROM fronts),
fitted AS (SELECT *, CASE WHEN least(len(a), len(b)) = f + e AND f > 0 THEN f - 1 ELSE f END AS p,
                  CASE WHEN least(len(a), len(b)) = f + e AND f = 0 THEN e - 1 ELSE e END AS q FROM backs)"""

_LANE = "CAST(('0x' || substr(id, {}, 15)) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    ties, orders, crowded = i.TIES, i.ORDERS, i.CROWDED
    found = {
        "diff": _diff(i.PAIR),
        "diff_ties": _diff(ties),
        "diff_orders": _diff(orders),
        "diff_crowded": _diff(crowded),
        "diff_pruned": _diff(i.PAIR),
        "keep_unread": _sql(
            i.UNREAD,
            f"""SELECT path, kind, digest FROM seen UNION ALL
                SELECT path, kind, digest FROM listing WHERE {_inside('listing.path', 'broken')} AND path NOT IN (SELECT path FROM seen)""",
        ),
        "refresh_unread": _sql(
            i.COPY_COMMITS,
            """SELECT c.store, c.snapshot_id, arg_max(commit_id, seq) AS base_commit_id, concat(c.store, '/', c.snapshot_id) AS reference
               FROM copy_commits c WHERE conv_id % 3 <> 0 GROUP BY c.store, c.snapshot_id
               UNION ALL SELECT k.store, k.snapshot_id, k.base_commit_id, k.reference FROM known k
               JOIN lost l ON l.store = k.store AND l.snapshot_id = k.snapshot_id""",
        ),
        "diff_copies": _diff(
            i.COPIES,
            f"""SELECT CASE WHEN s.source IS NULL THEN status ELSE 'C' END AS status,
                  CASE WHEN s.source IS NULL THEN status_name ELSE 'copied' END AS status_name,
                  coalesce(s.source, old_path) AS old_path, new_path, d.path,
                  CASE WHEN s.source IS NULL THEN old_kind ELSE new_kind END AS old_kind, new_kind,
                  CASE WHEN s.source IS NULL THEN old_digest ELSE new_digest END AS old_digest, new_digest,
                  CASE WHEN s.source IS NULL THEN similarity ELSE 100 END AS similarity
                FROM delta d LEFT JOIN (SELECT kind, digest, min(path) AS source FROM old GROUP BY ALL) s
                ON d.status = 'A' AND d.new_kind = s.kind AND d.new_digest = s.digest""",
            new="copied",
        ),
        "diff_typechange": _diff(i.LINKED, typechange=True),
        "diff_kinds_apart": _diff(i.LINKED),
        "filter_upper": _diff(i.PAIR, "SELECT * FROM delta WHERE status IN ('M', 'R')"),
        "filter_lower": _diff(i.PAIR, "SELECT * FROM delta WHERE status NOT IN ('A', 'D')"),
        "adds_new_content": _diff(
            i.PAIR,
            """SELECT path, status, status IN ('A', 'M') OR (status IN ('R', 'C') AND similarity <> 100)
                      AS adds_new_content FROM delta""",
        ),
        "commit_gate": _diff(
            i.CROWDED,
            "SELECT coalesce(bool_or(status IN ('A', 'M')), false) AS adds_new_content FROM delta",
        ),
        "status_letters": _diff(
            i.PAIR,
            """SELECT path, status_name, status AS status_code,
                      CASE WHEN status = 'A' OR similarity = 100 THEN '-' ELSE old_digest END AS shown_digest,
                      substr(CASE WHEN status = 'A' OR similarity = 100 THEN '-' ELSE old_digest END, 1, 10) AS short_digest
               FROM delta""",
        ),
        "path_change": _sql(
            f"{i.PAIR},{_delta()},{_PATH_CHANGE}",
            """SELECT old_path, new_path, CASE WHEN p + q = 0 THEN concat(old_path, ' -> ', new_path)
                 ELSE array_to_string(list_concat(list_concat(a[1:p], [concat('{',
                   array_to_string(a[p + 1:len(a) - q], '/'), ' -> ',
                   array_to_string(b[p + 1:len(b) - q], '/'), '}')]), a[len(a) - q + 1:len(a)]), '/')
                 END AS path_change FROM fitted""",
        ),
        "raw_lines": _diff(
            i.PAIR,
            """SELECT concat(status, ' ', rpad(CASE WHEN status = 'A' OR similarity = 100 THEN '-' ELSE old_digest END, 40, ' '),
                      chr(9), coalesce(old_path, new_path),
                      CASE WHEN old_path <> new_path THEN concat(chr(9), new_path) ELSE '' END) AS line
               FROM delta""",
        ),
        "rename_plan": _diff(
            i.PAIR, "SELECT old_path AS src, new_path AS dst FROM delta WHERE status = 'R'"
        ),
        "rename_limit": _diff(
            orders,
            """, ranked AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY new_path) AS k FROM delta)
               SELECT * EXCLUDE (k) FROM ranked WHERE status <> 'R' OR k <= 500
               UNION ALL SELECT 'D', 'deleted', old_path, NULL, old_path, old_kind, NULL, old_digest, NULL, 0
               FROM ranked WHERE status = 'R' AND k > 500
               UNION ALL SELECT 'A', 'added', NULL, new_path, new_path, NULL, new_kind, NULL, new_digest, 0
               FROM ranked WHERE status = 'R' AND k > 500""",
        ),
        "emptied_dirs": _diff(
            i.PAIR,
            """, plan AS (SELECT old_path AS src, new_path AS dst FROM delta WHERE status = 'R'),
               replayed AS (SELECT path FROM old WHERE path NOT IN (SELECT src FROM plan)
                            UNION ALL SELECT dst FROM plan),
               held AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS dir FROM
                 (SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS n FROM replayed) t),
               left_behind AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS dir FROM
                 (SELECT string_split(src, '/') AS parts, unnest(range(1, len(string_split(src, '/')))) AS n FROM plan) t)
               SELECT dir FROM left_behind WHERE dir NOT IN (SELECT dir FROM held)""",
        ),
        "constrain": _sql(
            f"{i.PAIR}, given AS (SELECT DISTINCT concat(source, '/', lang) AS path FROM docs WHERE toxic = 1 "
            "UNION SELECT path FROM docs WHERE lang = 'fr' UNION SELECT 'web')",
            f"SELECT path, kind, digest FROM new WHERE {_inside('new.path', 'given')}",
        ),
        "constrain_cross_rename": _sql(
            f"""{i.PAIR},
            part_old AS (SELECT * FROM old WHERE path LIKE 'src1/%' OR path LIKE 'src2/%'),
            part_new AS (SELECT * FROM new WHERE path LIKE 'src1/%' OR path LIKE 'src2/%'),
            {_delta('part_old', 'part_new').strip()}""",
            "SELECT * FROM delta",
        ),
        "stage_paths": _sql(_STAGE, "SELECT * FROM staged"),
        "stage_glob_remove": _sql(
            i.PAIR,
            """SELECT path, kind, digest FROM old WHERE NOT regexp_full_match(path, 'src1./es(/.*)?', 's')
                 AND path <> 'web' AND NOT starts_with(path, 'web/')
               UNION ALL SELECT path, kind, digest FROM new WHERE starts_with(path, 'web/')""",
        ),
        "reset_paths": _sql(
            f"{_STAGE}, back AS (SELECT 'web' AS path UNION SELECT source FROM docs WHERE quality = 0)",
            f"""SELECT path, kind, digest FROM staged WHERE NOT {_inside('staged.path', 'back')}
                UNION ALL SELECT path, kind, digest FROM old WHERE {_inside('old.path', 'back')}""",
        ),
        "status": _sql(
            f"{_STAGE},{_delta('old', 'staged', out='s')},{_delta('staged', 'new', out='u')}",
            "SELECT 'staged' AS section, * FROM s UNION ALL SELECT 'unstaged', * FROM u",
        ),
        "apply_delta": _sql(i.PAIR, "SELECT path, kind, digest FROM new"),
        "digest_text": "SELECT doc_id, sha1(text) AS digest, false AS unreadable FROM documents",
        "link_identity": _sql(
            i.DOCS,
            """SELECT path, CASE WHEN lang = 'fr' THEN sha1(concat('../originals/', path)) ELSE sha1(text) END AS digest
               FROM docs""",
        ),
        "cache_split": _sql(
            i.CACHE,
            """SELECT l.path, CASE WHEN c.path IS NULL THEN 'absent' WHEN version <> 1 THEN 'bad_version'
                 WHEN algorithm <> 'sha1' THEN 'bad_algorithm' WHEN c.mtime_ns < l.mtime_ns THEN 'outdated'
                 WHEN digest = '' THEN 'empty' ELSE 'hit' END AS cache_state,
                 CASE WHEN version = 1 AND algorithm = 'sha1' AND c.mtime_ns >= l.mtime_ns AND digest <> ''
                      THEN digest END AS digest
               FROM listing l LEFT JOIN cache c ON l.path = c.path""",
        ),
        "restore_two_refs": _sql(
            i.DOCS,
            """SELECT path, 'HEAD' AS ref, 'restored' AS outcome, 'aux1/2' AS reference, sha1(concat(text, '!')) AS digest FROM docs
               UNION ALL SELECT path, 'HEAD~1', 'superseded', NULL, sha1(concat(text, '!')) FROM docs""",
        ),
        "scan_paths": _sql(
            i.DOCS,
            """SELECT path, 'blob' AS kind, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM docs
               WHERE source = 'src1' OR (source = 'src2' AND lang = 'en') OR (source = 'src3' AND lang = 'fr')""",
        ),
        "unreadable": _sql(
            i.DOCS,
            """SELECT path, CASE WHEN toxic = 0 THEN sha1(text) ELSE repeat('0', 40) END AS digest, toxic <> 0 AS unreadable
               FROM docs""",
        ),
        "rehash": _sql(i.DOCS, "SELECT path, sha1(text) AS digest, sha1(text) AS cached FROM docs"),
        "commit": _sql(
            i.PAIR,
            """SELECT path, kind, digest, seq, CASE WHEN seq > 0 THEN seq - 1 END AS parent_seq, concat('Change ', CAST(seq AS STRING)) AS message
               FROM (SELECT *, unnest([CAST(0 AS BIGINT), CAST(2 AS BIGINT)]) AS seq FROM old
                     UNION ALL SELECT *, CAST(1 AS BIGINT) FROM new) u""",
        ),
        "commit_times": _sql(
            i.CHAIN,
            """, zoned AS (SELECT seq, commit_time, seq % 1440 - 720 AS tz FROM commits)
               SELECT seq, CAST(commit_time AS BIGINT) * 1000000 AS micros,
                 concat(strftime(make_timestamp(CAST((commit_time + 60 * tz) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S'), ' ',
                        CASE WHEN tz < 0 THEN '-' ELSE '+' END, lpad(CAST(abs(tz) // 60 AS STRING), 2, '0'), ':',
                        lpad(CAST(abs(tz) % 60 AS STRING), 2, '0')) AS local_time
               FROM zoned""",
        ),
        "snapshot_table": _sql(
            i.TURNS, "SELECT *, CAST(0 AS BIGINT) AS kept_before FROM turns WHERE store = 'user'"
        ),
        "unreadable_differ": _sql(
            i.BROKEN,
            """SELECT 'M' AS status, o.path AS old_path, n.path AS new_path, o.digest AS old_digest, n.digest AS new_digest
               FROM old o JOIN new n ON o.path = n.path WHERE o.digest <> n.digest OR n.digest = repeat('0', 40)
               UNION ALL SELECT 'D', path, NULL, digest, NULL FROM old WHERE path NOT IN (SELECT path FROM new)
               UNION ALL SELECT 'A', NULL, path, NULL, digest FROM new WHERE path NOT IN (SELECT path FROM old)""",
        ),
        "status_ignored": _sql(
            f"{i.PATHS},{_HITS}",
            "SELECT 'ignored' AS section, 'X' AS status, 'ignored' AS status_name, path FROM hits",
        ),
        "store_outcomes": _sql(
            i.ADDRESSES,
            """SELECT store, CASE form WHEN 'host' THEN 'host must be empty' WHEN 'no_host' THEN 'host must not be empty'
                 WHEN 'scheme' THEN 'unknown scheme' WHEN 'query' THEN 'query must be empty'
                 WHEN 'fragment' THEN 'fragment must be empty' WHEN 'parameters' THEN 'parameters must be empty'
                 WHEN 'wild_host' THEN 'host must not contain *' WHEN 'two_wild' THEN 'more than one *'
                 WHEN 'none' THEN 'no path' END AS store_error
               FROM addresses""",
        ),
        "cache_moved": _sql(
            i.MOVED,
            """SELECT m.path, CASE WHEN c.inode IS NULL THEN 'absent' WHEN version <> 1 THEN 'bad_version'
                 WHEN algorithm <> 'sha1' THEN 'bad_algorithm' WHEN c.mtime_ns <> m.mtime_ns THEN 'outdated'
                 WHEN digest = '' THEN 'empty' ELSE 'hit' END AS cache_state,
                 CASE WHEN version = 1 AND algorithm = 'sha1' AND c.mtime_ns = m.mtime_ns AND digest <> ''
                      THEN digest END AS digest
               FROM moved m LEFT JOIN cache c ON m.inode = c.inode""",
        ),
        "cache_replaced": _sql(
            i.REPLACED,
            """, joined AS (
                 SELECT r.path, r.mtime_ns AS now, r.size AS n, f.inode AS own, p.path AS known_path, p.inode AS other, p.mtime_ns AS p_mtime,
                        p.size AS p_size, p.version AS p_version, p.algorithm AS p_algorithm, p.digest AS p_digest,
                        f.version, f.algorithm, f.mtime_ns, f.digest
                 FROM replaced r LEFT JOIN cache f ON r.inode = f.inode LEFT JOIN cache p ON r.path = p.path),
               states AS (
                 SELECT *, CASE WHEN own IS NOT NULL THEN
                     CASE WHEN version <> 1 THEN 'bad_version' WHEN algorithm <> 'sha1' THEN 'bad_algorithm'
                       WHEN mtime_ns <> now THEN 'outdated' WHEN digest = '' THEN 'empty' ELSE 'hit' END
                   WHEN known_path IS NULL THEN 'absent' WHEN other IS NOT NULL THEN 'replaced'
                   WHEN p_version <> 1 THEN 'bad_version' WHEN p_algorithm <> 'sha1' THEN 'bad_algorithm'
                   WHEN NOT (p_mtime = now AND p_size = n) THEN 'outdated' WHEN p_digest = '' THEN 'empty' ELSE 'hit' END AS cache_state
                 FROM joined)
               SELECT path, cache_state, CASE WHEN cache_state = 'hit' THEN coalesce(digest, p_digest) END AS digest FROM states""",
        ),
        "cache_entries": _sql(
            i.CACHE, "SELECT path, version, mtime_ns, algorithm, digest FROM cache"
        ),
        "cache_refresh": _sql(
            i.CACHE,
            """, good AS (SELECT l.path FROM listing l JOIN cache c ON l.path = c.path
                 WHERE version = 1 AND algorithm = 'sha1' AND c.mtime_ns >= l.mtime_ns AND digest <> '')
               SELECT d.path, 1 AS version, l.mtime_ns, 'sha1' AS algorithm,
                 CASE WHEN d.path IN (SELECT path FROM good) THEN c.digest ELSE sha1(text) END AS digest,
                 l.size, l.dev, l.inode, l.ctime_ns
               FROM docs d JOIN listing l ON l.path = d.path LEFT JOIN cache c ON c.path = d.path""",
        ),
        "corruption": _sql(
            f"""{i.CACHE},
            recorded AS (SELECT path, 'blob' AS kind, CASE WHEN source = 'src3' THEN sha1(concat(text, '?'))
                         WHEN source = 'src5' THEN sha1(concat(text, '!')) ELSE sha1(text) END AS digest FROM docs),
            rehashed AS (SELECT path, 'blob' AS kind, sha1(text) AS digest,
                         1000000 * doc_id + CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS mtime_ns FROM docs),
            {_delta('recorded', 'rehashed').strip()}""",
            """SELECT d.*, status = 'M' AND coalesce(r.mtime_ns <= c.mtime_ns, false) AS suspect
               FROM delta d LEFT JOIN rehashed r ON r.path = d.path LEFT JOIN cache c ON c.path = d.path""",
        ),
        "dir_rollup": _sql(
            i.PATHS,
            f""", up AS (SELECT path, kind, digest, {_PARTS} AS parts, unnest(range(0, len({_PARTS}))) AS n FROM listing),
                ids AS (SELECT CASE WHEN n = 0 THEN '' ELSE array_to_string(parts[1:n], '/') END AS dir,
                          sha1(concat(digest, kind, array_to_string(parts[n + 1:len(parts)], '/'))) AS id FROM up)
                SELECT dir, count(*) AS n_files, CAST(sum({_LANE.format(1)}) AS STRING) AS h1,
                       CAST(sum({_LANE.format(16)}) AS STRING) AS h2 FROM ids GROUP BY dir""",
        ),
        "rollup_update": _sql(
            i.PAIR,
            f""", up AS (SELECT path, kind, digest, {_PARTS} AS parts, unnest(range(0, len({_PARTS}))) AS n FROM new),
                ids AS (SELECT CASE WHEN n = 0 THEN '' ELSE array_to_string(parts[1:n], '/') END AS dir,
                          sha1(concat(digest, kind, array_to_string(parts[n + 1:len(parts)], '/'))) AS id FROM up)
                SELECT dir, count(*) AS n_files, CAST(sum({_LANE.format(1)}) AS STRING) AS h1,
                       CAST(sum({_LANE.format(16)}) AS STRING) AS h2 FROM ids GROUP BY dir""",
        ),
        "changed_dirs": _diff(
            i.PAIR,
            """, touched AS (SELECT old_path AS path FROM delta_all WHERE old_path IS NOT NULL
                             UNION SELECT new_path FROM delta_all WHERE new_path IS NOT NULL)
               SELECT DISTINCT CASE WHEN n = 0 THEN '' ELSE array_to_string(parts[1:n], '/') END AS dir FROM
                 (SELECT string_split(path, '/') AS parts, unnest(range(0, len(string_split(path, '/')))) AS n FROM touched) t""",
        ),
        "prune_ignored": _sql(
            f"{i.PATHS},{_HITS}",
            f"SELECT path, kind, digest FROM listing WHERE NOT {_inside('listing.path', 'hits')}",
        ),
        "ignored_dirs": _sql(
            f"{i.PATHS},{_HITS}",
            """SELECT path, reason FROM hits h WHERE NOT EXISTS (
                 SELECT 1 FROM hits g WHERE g.path = '' AND h.path <> '' OR starts_with(h.path, concat(g.path, '/')))""",
        ),
        "is_ignored": _sql(
            f"{i.PATHS},{_HITS}, asked AS (SELECT path FROM listing UNION SELECT dir FROM marks UNION SELECT concat(dir, '/new') FROM marks)",
            f"""SELECT path, {_inside('asked.path', 'hits')}
                  OR len(list_intersect({_PARTS}[1:len({_PARTS}) - 1], {_list(_SKIP)})) > 0
                  OR len(list_intersect({_PARTS}, {_list(SKIP_FLAGS)})) > 0 AS ignored FROM asked""",
        ),
        "snapshot_ids": _sql(
            i.COPIES_OF_HOSTS,
            r"""SELECT DISTINCT 'aux1' AS store, regexp_extract(path, '^backup/([^/]*)-copy/snapshot/', 1) AS snapshot_id,
                  concat('aux1/', regexp_extract(path, '^backup/([^/]*)-copy/snapshot/', 1)) AS reference
                FROM paths WHERE path LIKE 'backup/%'
                UNION SELECT 'aux2', regexp_extract(path, '^mirror/m_([^/]*)/', 1),
                  concat('aux2/', regexp_extract(path, '^mirror/m_([^/]*)/', 1))
                FROM paths WHERE path LIKE 'mirror/%/.treeledger/%'""",
        ),
        "store_errors": _sql(
            f"""{i.WEB}, urls AS (SELECT page_id, url FROM {{pages}})""",
            """SELECT CAST(page_id AS STRING) AS store,
                 CASE WHEN regexp_matches(url, '^[^#]*[?].') THEN 'query must be empty'
                      WHEN url LIKE '%#_%' THEN 'fragment must be empty'
                      ELSE 'unknown scheme' END AS store_error FROM urls""",
        ),
        "refresh_snapshots": _sql(
            i.COPY_COMMITS,
            """SELECT store, snapshot_id, base_commit_id, reference FROM known WHERE store <> 'aux1'
               UNION ALL SELECT store, snapshot_id, arg_max(commit_id, seq), concat(store, '/', snapshot_id)
               FROM copy_commits WHERE store = 'aux1' GROUP BY store, snapshot_id""",
        ),
        "log": _sql(_LOG, "SELECT * FROM delta"),
        "log_chain": _sql(
            f"""{i.CHAIN_TREE},
            steps AS (SELECT *, lag(path) OVER w AS old_path, lag(digest) OVER w AS old FROM runs
                      WINDOW w AS (PARTITION BY user_id ORDER BY from_seq)),
            told AS (
              SELECT from_seq AS seq, commit_id, CASE WHEN old_path = path THEN 'M' ELSE 'R' END AS status, old_path, path AS new_path, old, digest
              FROM steps WHERE (old_path = path) <> (old = digest)
              UNION ALL SELECT from_seq, commit_id, 'A', NULL, path, NULL, digest FROM steps
              WHERE old_path IS NULL OR (old_path <> path AND old <> digest)
              UNION ALL SELECT from_seq, commit_id, 'D', old_path, NULL, old, NULL FROM steps WHERE old_path <> path AND old <> digest)""",
            f"""SELECT seq, commit_id, status, {_NAME.format('status')} AS status_name, old_path, new_path,
                  coalesce(new_path, old_path) AS path, CASE WHEN old_path IS NOT NULL THEN 'blob' END AS old_kind,
                  CASE WHEN new_path IS NOT NULL THEN 'blob' END AS new_kind, old AS old_digest, digest AS new_digest,
                  CASE WHEN status = 'R' THEN 100 ELSE 0 END AS similarity FROM told""",
        ),
        "log_decorated": _sql(
            i.CHAIN,
            """SELECT c.commit_id, c.seq, t.ordinal, s.reference FROM snapshots s
               JOIN stores t ON t.store = s.store JOIN commits c ON c.commit_id = s.base_commit_id
               UNION ALL SELECT commit_id, seq, -1, 'HEAD' FROM commits WHERE seq = (SELECT max(seq) FROM commits)""",
        ),
        "resolve": _sql(
            _RESOLVED,
            """SELECT a.ref, f.commit_id, f.seq, CASE WHEN f.ref IS NULL THEN 'bad revision' END AS problem
               FROM asked a LEFT JOIN found f ON a.ref = f.ref""",
        ),
        "ancestors": _sql(
            i.CHAIN,
            """SELECT commit_id, parent_id, seq, commit_time, message FROM commits
               WHERE seq <= (SELECT max(seq) FROM commits WHERE message = 'signup')""",
        ),
        "diff_refs": _sql(
            f"""{i.HISTORY},
            before AS (SELECT path, kind, digest FROM manifests WHERE revision = sha1('c1')),
            after AS (SELECT path, kind, digest FROM manifests WHERE revision = sha1('c4')),
            {_delta('before', 'after').strip()}""",
            "SELECT * FROM delta WHERE status <> 'M'",
        ),
        "history_changes": _sql(
            _LOG,
            """SELECT coalesce(o.seq, n.seq) AS seq, coalesce(o.path, n.path) AS path, o.kind AS old_kind, o.digest AS old_digest,
                 n.kind AS kind, n.digest AS digest
               FROM log_old o FULL OUTER JOIN log_new n ON o.seq = n.seq AND o.path = n.path
               WHERE o.digest IS DISTINCT FROM n.digest""",
        ),
        "history_intervals": _sql(
            f"""{i.HISTORY},
            placed AS (SELECT m.path, m.kind, m.digest, c.seq,
                         c.seq - row_number() OVER (PARTITION BY m.path, m.kind, m.digest ORDER BY c.seq) AS island
                       FROM manifests m JOIN commits c ON c.commit_id = m.revision)""",
            """SELECT path, kind, digest, min(seq) AS from_seq,
                 CASE WHEN max(seq) < (SELECT max(seq) FROM commits) THEN max(seq) + 1 END AS to_seq
               FROM placed GROUP BY path, kind, digest, island""",
        ),
        "diff_refs_changes": _sql(
            f"""{i.HISTORY},
            before AS (SELECT path, kind, digest FROM manifests WHERE revision = sha1('c1')),
            after AS (SELECT path, kind, digest FROM manifests WHERE revision = sha1('c4')),
            {_delta('before', 'after').strip()}""",
            "SELECT * FROM delta WHERE status <> 'M'",
        ),
        "locate_first": _sql(
            _LOCATED,
            """SELECT path, ref, found_path, same_path, reference FROM located
               QUALIFY row_number() OVER (PARTITION BY path, ref ORDER BY seq DESC, ordinal, snapshot_id) = 1""",
        ),
        "locate_chain": _sql(
            f"""{i.CHAIN_TREE},
            taken AS (SELECT c.seq, s.reference FROM snapshots s JOIN commits c ON c.commit_id = s.base_commit_id),
            offers AS (
              SELECT b.path, b.ref, t.seq, r.path AS found_path, r.path = b.path AS same_path, t.reference
              FROM bound b JOIN runs r ON r.digest = b.digest
              JOIN taken t ON t.seq >= r.from_seq AND (t.seq < r.to_seq OR r.to_seq IS NULL) AND t.seq <= b.seq)""",
            """SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY path, ref ORDER BY seq DESC) = 1""",
        ),
        "locate": _sql(_LOCATED, "SELECT * FROM located"),
        "rank_candidates": _sql(
            _LOCATED,
            """SELECT path, ref, reference, store = 'aux2' AS eligible,
                 CAST(row_number() OVER (PARTITION BY path, ref, store = 'aux2' ORDER BY seq DESC, ordinal, snapshot_id)
                      AS INTEGER) AS try_order
               FROM located""",
        ),
        "classify_requests": _sql(
            f"""{_LOCATED},
            dirs AS (SELECT DISTINCT revision, array_to_string(parts[1:n], '/') AS path FROM (
                SELECT revision, {_PARTS} AS parts, unnest(range(1, len({_PARTS}))) AS n FROM manifests) t),
            offers AS (SELECT path, ref, bool_or(store = 'aux2') AS fits FROM located GROUP BY path, ref)""",
            """SELECT b.path, b.ref, b.commit_id,
                 CASE WHEN b.path IN (SELECT path FROM docs WHERE lang = 'de') THEN 'exists'
                      WHEN w.path IS NULL AND d.path IS NOT NULL THEN 'directory'
                      WHEN w.path IS NULL THEN 'unknown_path' WHEN o.path IS NULL THEN 'no_snapshot'
                      WHEN NOT o.fits THEN 'excluded_only' ELSE 'ok' END AS outcome
               FROM bound b LEFT JOIN wanted w ON w.path = b.path AND w.ref = b.ref
               LEFT JOIN dirs d ON d.revision = b.commit_id AND d.path = b.path
               LEFT JOIN offers o ON o.path = b.path AND o.ref = b.ref""",
        ),
        "tree_manifest": _sql(
            i.DOCS, "SELECT path, 'blob' AS kind, sha1(text) AS digest, false AS unreadable FROM docs"
        ),
        "restore_files": _sql(
            i.DOCS, "SELECT path, 'HEAD' AS ref, 'restored' AS outcome, 'aux1/1' AS reference FROM docs"
        ),
    }
    # Other ways to the same rows.
    same = {"cache_upsert": "cache_refresh", "probe_listed": "cache_split", "probe_moved": "cache_moved", "probe_replaced": "cache_replaced"}
    return found | {name: found[of] for name, of in same.items()}
