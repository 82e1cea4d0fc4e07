"""The same queries in DuckDB SQL."""

_A = """
a AS (
  SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path,
         strlen(text) AS size,
         1700000000000000000 + doc_id * 1000003 AS mtime_ns,
         1700000000000000000 + doc_id * 1000003 + 7 AS ctime_ns,
         CASE WHEN doc_id % 19 <> 6 THEN sha256(text) END AS digest,
         CASE WHEN doc_id % 19 = 6 THEN strlen(text) // 2 END AS bytes_hashed,
         source
  FROM documents)"""

_B = """
b AS (
  SELECT relative_path, strlen(body) AS size, mtime_ns, ctime_ns,
         CASE WHEN NOT unfinished THEN sha256(body) END AS digest,
         CASE WHEN unfinished THEN strlen(body) // 2 END AS bytes_hashed,
         source
  FROM (
    SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path,
           CASE WHEN doc_id % 7 = 2 THEN text || ' ' ELSE text END AS body,
           1700000000000000000 + doc_id * 1000003 + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS mtime_ns,
           1700000000000000007 + doc_id * 1000003 + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS ctime_ns,
           doc_id % 17 = 4 AS unfinished, source
    FROM documents WHERE doc_id % 11 <> 3
    UNION ALL
    SELECT 'new/' || source || '/' || lang || '/doc_' || doc_id || '.txt', text,
           1700000000000000000 + doc_id, 1700000000000000000 + doc_id, false, source
    FROM documents WHERE doc_id % 13 = 5))"""

_C = """
c AS (
  SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path,
         sha256(CASE WHEN doc_id % 6 = 4 THEN text || '!' ELSE text END) AS digest,
         strlen(CASE WHEN doc_id % 6 = 4 THEN text || '!' ELSE text END) AS size,
         1700000000000000000 + doc_id * 1000003 AS mtime_ns,
         1700000000000000000 + doc_id * 1000003 + 9 AS ctime_ns
  FROM documents WHERE doc_id % 10 <> 1)"""

_D = """
d AS (
  SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path,
         sha256(text || CASE WHEN doc_id % 101 = 7 THEN '?' WHEN doc_id % 6 = 4 THEN '!' ELSE '' END) AS digest
  FROM documents WHERE doc_id % 10 <> 1 AND doc_id % 103 <> 5
  UNION ALL
  SELECT 'late/' || source || '/' || lang || '/doc_' || doc_id || '.txt', sha256(text)
  FROM documents WHERE doc_id % 107 = 9)"""

_NEARLY = f"""{_C}, {_D},
compared AS (
  SELECT coalesce(c.relative_path, d.relative_path) AS relative_path,
         CASE WHEN d.relative_path IS NULL THEN 'only_left'
              WHEN c.relative_path IS NULL THEN 'only_right'
              WHEN c.digest <> d.digest THEN 'mismatch'
              ELSE 'match' END AS status
  FROM c FULL JOIN d ON c.relative_path = d.relative_path)"""

# A file lies below the root and below every directory on its path.
_DIRECTORIES = f"""{_A}, {_B},
paths AS (
  SELECT coalesce(a.relative_path, b.relative_path) AS p, a.relative_path IS NOT NULL AS l, b.relative_path IS NOT NULL AS r,
         a.digest AS old, b.digest AS new
  FROM a FULL JOIN b ON a.relative_path = b.relative_path),
below AS (
  SELECT *, unnest(list_transform(range(len(string_split(p, '/'))),
                                  lambda n: array_to_string(string_split(p, '/')[1:n], '/'))) AS directory
  FROM paths)"""

_COMPARED = f"""{_A}, {_B},
compared AS (
  SELECT coalesce(a.relative_path, b.relative_path) AS relative_path,
         CASE WHEN b.relative_path IS NULL THEN 'only_left'
              WHEN a.relative_path IS NULL THEN 'only_right'
              WHEN a.digest IS NULL OR b.digest IS NULL THEN 'unverified'
              WHEN a.digest <> b.digest THEN 'mismatch'
              ELSE 'match' END AS status
  FROM a FULL JOIN b ON a.relative_path = b.relative_path)"""


def _verdict(source: str) -> str:
    return f"""
  SELECT count(*) FILTER (status IN ('only_left', 'only_right')) = 0 AS files_identical,
         count(*) FILTER (status = 'mismatch') = 0 AS checksums_identical,
         count(*) FILTER (status IN ('only_left', 'only_right', 'mismatch')) = 0 AS equal,
         count(*) FILTER (status = 'unverified') = 0 AS fully_verified
  FROM {source}"""


_LABEL = """
  CASE change_mask WHEN 1 THEN 'size' WHEN 2 THEN 'ctime' WHEN 3 THEN 'size & ctime' WHEN 4 THEN 'mtime'
    WHEN 5 THEN 'size & mtime' WHEN 6 THEN 'ctime & mtime' WHEN 7 THEN 'size & ctime & mtime' END AS change_label"""

_MASK = """
  CAST((CASE WHEN a.size <> b.size THEN 1 ELSE 0 END) + (CASE WHEN a.ctime_ns <> b.ctime_ns THEN 2 ELSE 0 END)
    + (CASE WHEN a.mtime_ns <> b.mtime_ns THEN 4 ELSE 0 END) AS BIGINT)"""


def _plan(maxdepth: int, clean_ignored: bool, ignore="'^src1/'", include="'/en/'") -> str:
    return f"""{_A}, {_B},
joined AS (
  SELECT coalesce(a.relative_path, b.relative_path) AS relative_path,
         a.relative_path IS NOT NULL AS in_m, b.relative_path IS NOT NULL AS in_l,
         a.bytes_hashed IS NULL AS complete,
         a.size AS was_size, a.mtime_ns AS was_mtime_ns, a.ctime_ns AS was_ctime_ns,
         a.digest AS was_digest, a.bytes_hashed AS was_bytes_hashed,
         b.size AS now_size, b.mtime_ns AS now_mtime_ns, b.ctime_ns AS now_ctime_ns, b.digest AS now_digest,
         {_MASK} AS raw_mask
  FROM a FULL JOIN b ON a.relative_path = b.relative_path),
judged AS (
  SELECT *,
         in_l AND length(relative_path) - length(replace(relative_path, '/', '')) <= {maxdepth} AS candidate,
         NOT regexp_matches(relative_path, {include}) AND regexp_matches(relative_path, {ignore}) AS ignored
  FROM joined),
masked AS (
  SELECT *, CASE WHEN in_m AND candidate THEN raw_mask ELSE -1 END AS change_mask FROM judged),
acted AS (
  SELECT *,
    CASE WHEN in_m AND {str(clean_ignored).lower()} AND ignored THEN 'DELETE_IGNORED'
         WHEN in_m AND NOT in_l THEN 'DELETE_MISSING'
         WHEN in_m AND NOT candidate THEN 'KEEP'
         WHEN in_m AND change_mask = 0 AND complete THEN 'KEEP'
         WHEN candidate AND ignored THEN 'IGNORED'
         WHEN candidate AND NOT in_m THEN 'ADD'
         WHEN in_m AND change_mask = 0 THEN 'RESUME'
         WHEN in_m AND NOT complete THEN 'REHASH'
         WHEN in_m THEN 'CHANGED' END AS action
  FROM masked),
plan AS (SELECT *, {_LABEL} FROM acted WHERE action IS NOT NULL)"""


def _time(column: str) -> str:
    """UTC text of a nanosecond column, split so that nothing is rounded."""
    return (
        f"strftime(make_timestamp(({column} - {column} % 1000000000) // 1000), '%Y-%m-%d %H:%M:%S') || '.' "
        f"|| lpad(({column} % 1000000000)::VARCHAR, 9, '0')"
    )


def _units(column: str, units: dict[str, int], zero: str) -> str:
    parts, above = [], None
    for unit, length in units.items():
        rest = f"({column})" if above is None else f"(({column}) % {above})"
        # A month is not a whole number of weeks, so every larger unit is taken off in turn.
        if above is not None and len(parts) > 2:
            rest = f"((({column}) % 31536000000000000 % 2628000000000000) % {above})"
        parts.append(f"CASE WHEN {rest} // {length} > 0 THEN ({rest} // {length})::VARCHAR || '{unit}' END")
        above = length
    return f"CASE WHEN ({column}) = 0 THEN '{zero}' ELSE concat_ws(' ', {', '.join(parts)}) END"


# Fixed values, as in functions/formats.py.
_TIME_UNITS = {
    "y": 31536000000000000,
    "mon": 2628000000000000,
    "w": 604800000000000,
    "d": 86400000000000,
    "h": 3600000000000,
    "min": 60000000000,
    "s": 1000000000,
    "ms": 1000000,
    "μs": 1000,
    "ns": 1,
}


def _bytes(column: str) -> str:
    parts = [
        f"CASE WHEN (({column}) >> {shift}) % 1024 > 0 THEN ((({column}) >> {shift}) % 1024)::VARCHAR || '{unit}' END"
        for unit, shift in [("EB", 60), ("PB", 50), ("TB", 40), ("GB", 30), ("MB", 20), ("kB", 10), ("B", 0)]
    ]
    return f"CASE WHEN ({column}) = 0 THEN '0B' ELSE concat_ws(' ', {', '.join(parts)}) END"


_TREE = """
tree AS (
  SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path, 'file' AS kind,
         strlen(text) AS size, source AS top FROM documents
  UNION ALL SELECT DISTINCT source, 'dir', NULL::BIGINT, source FROM documents
  UNION ALL SELECT DISTINCT source || '/' || lang, 'dir', NULL::BIGINT, source FROM documents)"""


def _totals(root: int) -> str:
    total = "coalesce(sum(CASE WHEN kind = 'file' THEN size END), 0)::BIGINT"
    return f"""{total} AS total_size, {_bytes(total)} AS total_size_text,
    count(*) + {root} AS total_items, count(*) FILTER (kind = 'dir') + {root} AS dirs,
    count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'symlink') AS symlinks"""


_URL_PATH = "regexp_replace(url, '^https?://[^/]+/|[?#].*$', '', 'g')"
_URL_ROOT = "regexp_extract(url, '^https?://[^/]+', 0)"

_CHUNKS = """
chunks AS (
  SELECT doc_id, n AS chunk_no, greatest((strlen(text) + 1023) // 1024, 1) AS chunks,
         sha256(encode(text)[n * 1024 + 1 : least((n + 1) * 1024, strlen(text))]) AS hex
  FROM (SELECT doc_id, text, unnest(range(greatest((strlen(text) + 1023) // 1024, 1))) AS n FROM documents))"""

_LEVELS = """
level0 AS (SELECT doc_id, chunk_no AS n, hex, chunks AS width, false AS root FROM chunks),""" + ",".join(
    f"""
level{i + 1} AS (
  SELECT doc_id, n // 1024 AS n,
         CASE WHEN root THEN min(hex) ELSE sha256(unhex(string_agg(hex, '' ORDER BY n))) END AS hex,
         (width + 1023) // 1024 AS width, root OR width <= 1024 AS root
  FROM level{i} GROUP BY doc_id, n // 1024, width, root)"""
    for i in range(3)
)

_FAULTY = f"""{_A}, {_B},
damaged AS (
  SELECT relative_path, size, size % 13 = 0 AND digest IS NOT NULL AS short,
         size % 13 <> 0 AND size % 17 = 0 AS zero,
         (digest IS NULL AND (size % 13 = 0 OR size % 17 <> 0)) AS no_digest,
         CASE WHEN size % 19 = 0 THEN size + 1 ELSE bytes_hashed END AS hashed
  FROM (SELECT relative_path, size, digest, bytes_hashed FROM a
        UNION ALL SELECT relative_path, size, digest, bytes_hashed FROM b)),
flags AS (
  SELECT relative_path, false AS no_path, short AS digest_length, zero AS zero_digest,
         coalesce(hashed <= 0 OR hashed >= size, false) AS bytes_hashed_range,
         hashed IS NULL AND no_digest AS complete_without_digest,
         hashed IS NOT NULL AND NOT no_digest AS incomplete_with_digest
  FROM damaged)"""

_CLEAN = f"""{_A},
flags AS (
  SELECT relative_path, false AS no_path, false AS digest_length, false AS zero_digest,
         coalesce(bytes_hashed <= 0 OR bytes_hashed >= size, false) AS bytes_hashed_range,
         bytes_hashed IS NULL AND digest IS NULL AS complete_without_digest,
         bytes_hashed IS NOT NULL AND digest IS NOT NULL AS incomplete_with_digest
  FROM a)"""

_FAULTS = [
    "no_path",
    "digest_length",
    "zero_digest",
    "bytes_hashed_range",
    "complete_without_digest",
    "incomplete_with_digest",
]


def _self_check() -> str:
    counts = ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in _FAULTS)
    ok = " AND ".join(f"count(*) FILTER ({f}) = 0" for f in _FAULTS)
    repeated = "(SELECT count(*) FROM (SELECT relative_path FROM flags GROUP BY 1 HAVING count(*) > 1))"
    return f"""
SELECT count(*) AS files, {repeated} AS duplicate_path, {counts}, {ok} AND {repeated} = 0 AS ok FROM flags"""


_ORDERS = """
drifted AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 8 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 13 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate
  FROM orders WHERE o_orderkey % 17 <> 4
  UNION ALL
  SELECT -o_orderkey - 1, CASE WHEN o_orderkey % 29 = 8 THEN NULL ELSE o_orderstatus END,
         CASE WHEN o_orderkey % 13 = 2 THEN o_totalprice + 1 ELSE o_totalprice END, o_orderdate
  FROM orders WHERE o_orderkey % 23 = 6)"""

_LINES = """
times AS (
  SELECT *, CASE WHEN (l_orderkey + l_partkey) % 19 = 3 THEN 0
                 WHEN (l_orderkey + l_partkey) % 31 = 5 THEN 2 ELSE 1 END AS n,
         CASE WHEN (l_orderkey + l_partkey) % 37 = 7 THEN l_tax + 1 ELSE l_tax END AS new_tax
  FROM lineitem),
stacked AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, 1 AS left_n, 0 AS right_n FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, new_tax, 0, n FROM times WHERE n > 0)"""


def oracle_sql() -> dict[str, str]:
    key = "o_orderkey"
    return {
        "compare_missing_left": f"WITH {_A}, {_B} SELECT relative_path FROM b ANTI JOIN a USING (relative_path)",
        "compare_missing_right": f"WITH {_A}, {_B} SELECT relative_path FROM a ANTI JOIN b USING (relative_path)",
        "compare_mismatch": f"""WITH {_A}, {_B}
            SELECT a.relative_path FROM a JOIN b ON a.relative_path = b.relative_path AND a.digest <> b.digest""",
        "compare_status": f"WITH {_COMPARED} SELECT relative_path, status FROM compared",
        "compare_report": f"WITH {_COMPARED} SELECT relative_path, status FROM compared WHERE status <> 'match'",
        "compare_status_counts": f"WITH {_COMPARED} SELECT status, count(*) AS files FROM compared GROUP BY status",
        "compare_verdict": f"WITH {_COMPARED} {_verdict('compared')}",
        "compare_verdict_self": f"""WITH {_A},
            own AS (SELECT CASE WHEN digest IS NULL THEN 'unverified' ELSE 'match' END AS status FROM a)
            {_verdict('own')}""",
        "compare_multi_root": f"""WITH {_A}, {_B}
            SELECT split_part(a.relative_path, '/', 1) AS prefix,
                   substr(a.relative_path, strpos(a.relative_path, '/') + 1) AS relative_path
            FROM a JOIN b ON a.relative_path = b.relative_path AND a.digest <> b.digest""",
        "compare_by_tree_digest": f"WITH {_NEARLY} SELECT relative_path, status FROM compared WHERE status <> 'match'",
        "compare_counts_by_tree_digest": f"WITH {_NEARLY} SELECT status, count(*) AS files FROM compared GROUP BY status",
        "compare_by_tree_digest_drifted": f"WITH {_COMPARED} SELECT relative_path, status FROM compared WHERE status <> 'match'",
        "compare_by_directory": f"""WITH {_DIRECTORIES}
            SELECT directory,
                   CASE WHEN count(*) FILTER (r) = 0 THEN 'only_left' WHEN count(*) FILTER (l) = 0 THEN 'only_right'
                        WHEN bool_or(NOT l OR NOT r OR old IS DISTINCT FROM new) THEN 'unlike'
                        WHEN bool_or(old IS NULL) THEN 'unverified' ELSE 'alike' END AS status,
                   count(*) FILTER (l) AS left_rows, count(*) FILTER (r) AS right_rows
            FROM below GROUP BY directory""",
        "digest_documents": "SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents",
        "digest_copies": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
        "chunk_digests": f"WITH {_CHUNKS} SELECT doc_id, chunk_no, upper(hex) AS chunk_sha256, chunks FROM chunks",
        "chunk_tree_digest": f"WITH {_CHUNKS}, {_LEVELS} SELECT doc_id, upper(hex) AS tree_sha256 FROM level3",
        "filter_ignore": f"WITH {_A} SELECT relative_path FROM a WHERE NOT regexp_matches(relative_path, '^src1/')",
        "filter_include_over_ignore": f"""WITH {_A} SELECT relative_path FROM a
            WHERE regexp_matches(relative_path, '/en/') OR NOT regexp_matches(relative_path, '^src1/')""",
        "filter_maxdepth": f"""
            SELECT relative_path, depth FROM (
              SELECT {_URL_PATH} AS relative_path,
                     length({_URL_PATH}) - length(replace({_URL_PATH}, '/', '')) AS depth FROM pages)
            WHERE depth <= 1""",
        "path_normalise": f"""
            SELECT page_id, regexp_replace(url, '/+$', '') AS trimmed,
                   CASE WHEN page_id % 4 = 0 THEN '' ELSE '/' END AS only_slashes, page_id % 4 AS slashes,
                   ltrim(substr(url, length({_URL_ROOT}) + 1), '/') AS relative,
                   regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$', 0) AS base,
                   {_URL_ROOT} || '/' || {_URL_PATH} AS joined
            FROM pages""",
        "tree_totals": f"WITH {_TREE} SELECT {_totals(1)} FROM tree",
        "tree_totals_by_source": f"WITH {_TREE} SELECT top, {_totals(0)} FROM tree GROUP BY top",
        "tree_totals_maxdepth": f"""
            WITH files AS (SELECT strlen(html) AS size FROM pages
              WHERE length({_URL_PATH}) - length(replace({_URL_PATH}, '/', '')) <= 1)
            SELECT coalesce(sum(size), 0)::BIGINT AS total_size,
                   {_bytes('coalesce(sum(size), 0)::BIGINT')} AS total_size_text,
                   count(*) + 1 AS total_items, 1::BIGINT AS dirs, count(*) AS files, 0::BIGINT AS symlinks FROM files""",
        "metadata_change_mask": f"""WITH {_A}, {_B},
            masks AS (SELECT a.relative_path, {_MASK} AS change_mask
                      FROM a JOIN b ON a.relative_path = b.relative_path)
            SELECT relative_path, change_mask, {_LABEL} FROM masks""",
        "refresh_plan": f"WITH {_plan(3, False)} SELECT relative_path, action, change_mask, change_label FROM plan",
        "refresh_plan_clean_ignored": f"""WITH {_plan(2, True)}
            SELECT relative_path, action, change_mask, change_label FROM plan""",
        "refresh_plan_multi_root": f"""WITH {_plan(32767, False, "'^[^/]+/en/'", "'never'")}
            SELECT split_part(relative_path, '/', 1) AS prefix,
                   substr(relative_path, strpos(relative_path, '/') + 1) AS relative_path,
                   action, change_mask
            FROM plan""",
        "refresh_action_counts": f"""WITH {_plan(2, True)}
            SELECT action, change_mask, change_label, count(*) AS files FROM plan GROUP BY ALL""",
        "refresh_report": f"""WITH {_plan(3, False)}
            SELECT relative_path, change_label,
                   CASE WHEN change_mask & 1 <> 0 THEN {_bytes('was_size')} END AS was_size,
                   CASE WHEN change_mask & 1 <> 0 THEN {_bytes('now_size')} END AS now_size,
                   CASE WHEN change_mask & 2 <> 0 THEN {_time('was_ctime_ns')} END AS was_ctime,
                   CASE WHEN change_mask & 2 <> 0 THEN {_time('now_ctime_ns')} END AS now_ctime,
                   CASE WHEN change_mask & 4 <> 0 THEN {_time('was_mtime_ns')} END AS was_mtime,
                   CASE WHEN change_mask & 4 <> 0 THEN {_time('now_mtime_ns')} END AS now_mtime
            FROM plan WHERE action = 'CHANGED'""",
        "refresh_apply": f"""WITH {_plan(3, False)},
            due AS (SELECT *, action IN ('ADD', 'CHANGED', 'REHASH', 'RESUME') AS due FROM plan
                    WHERE action NOT LIKE 'DELETE%' AND (in_m OR action = 'ADD')),
            done AS (SELECT *, due AND now_digest IS NOT NULL AS done FROM due)
            SELECT relative_path,
                   CASE WHEN done THEN now_size ELSE was_size END AS size,
                   CASE WHEN done THEN now_mtime_ns ELSE was_mtime_ns END AS mtime_ns,
                   CASE WHEN done THEN now_ctime_ns ELSE was_ctime_ns END AS ctime_ns,
                   done OR was_digest IS NOT NULL AS has_digest,
                   CASE WHEN NOT done THEN was_bytes_hashed END AS bytes_hashed
            FROM done WHERE done OR in_m""",
        "refresh_any_change": f"""WITH {_plan(3, False)}
            SELECT count(*) FILTER (action NOT IN ('KEEP', 'IGNORED')) > 0 AS any_change FROM plan""",
        "root_guard": f"""SELECT DISTINCT {_URL_ROOT} AS prefix FROM pages
            WHERE {_URL_ROOT} NOT IN (SELECT {_URL_ROOT} FROM pages WHERE url LIKE 'https:%')""",
        "root_merge": f"SELECT DISTINCT {_URL_ROOT} AS prefix FROM pages WHERE url LIKE 'https:%'",
        "format_values": f"""
            SELECT o_orderkey, {_bytes(f'{key} * {key} * 1000')} AS bytes,
                   {_units(f'{key} * {key} * 1000003', _TIME_UNITS, '0ns')} AS duration,
                   {_time(f'(1700000000000000000 - {key} * 1000000007)')} AS time,
                   format('{{:,}}', (round(o_totalprice * 100)::BIGINT * 10)) AS grouped
            FROM orders""",
        "reconcile_orders": f"""WITH {_ORDERS}
            SELECT coalesce(o.o_orderkey, d.o_orderkey) AS o_orderkey,
                   CASE WHEN d.o_orderkey IS NULL THEN 'only_left' WHEN o.o_orderkey IS NULL THEN 'only_right'
                        WHEN o.o_orderstatus IS NOT DISTINCT FROM d.o_orderstatus
                         AND o.o_totalprice IS NOT DISTINCT FROM d.o_totalprice
                         AND o.o_orderdate IS NOT DISTINCT FROM d.o_orderdate THEN 'match'
                        ELSE 'mismatch' END AS status
            FROM orders o FULL JOIN drifted d ON o.o_orderkey = d.o_orderkey""",
        "reconcile_lineitem": f"""WITH {_LINES},
            counted AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax,
                               sum(left_n)::BIGINT AS left_rows, sum(right_n)::BIGINT AS right_rows
                        FROM stacked GROUP BY ALL)
            SELECT l_orderkey, l_linenumber, left_rows, right_rows,
                   CASE WHEN right_rows = 0 THEN 'only_left' WHEN left_rows = 0 THEN 'only_right'
                        WHEN left_rows <> right_rows THEN 'count_differs' ELSE 'match' END AS status
            FROM counted""",
        "reconcile_lineitem_by_sketch": f"""WITH {_LINES},
            counted AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax,
                               sum(left_n)::BIGINT AS left_rows, sum(right_n)::BIGINT AS right_rows
                        FROM stacked GROUP BY ALL)
            SELECT l_orderkey, l_linenumber, left_rows, right_rows,
                   CASE WHEN right_rows = 0 THEN 'only_left' WHEN left_rows = 0 THEN 'only_right'
                        ELSE 'count_differs' END AS status
            FROM counted WHERE left_rows <> right_rows""",
        "reconcile_events_by_sketch": """
            WITH few AS (SELECT * FROM events WHERE event_id % 211 = 3),
            moved AS (
                SELECT event_id, event_type,
                       CASE WHEN event_id % 5 = 1 THEN ts + INTERVAL 1 MICROSECOND ELSE ts END AS ts,
                       CASE WHEN event_id % 7 = 3 THEN ts + INTERVAL 1 MICROSECOND ELSE ts END AS mark,
                       CASE WHEN event_id % 8 = 6 THEN props || ',' ELSE props END AS props, user_id
                FROM few WHERE event_id % 9 <> 2),
            stacked AS (
                SELECT event_id, event_type, ts, ts AS mark, props, user_id, 2 AS l, 0 AS r FROM few
                UNION ALL SELECT event_id, event_type, ts, mark, props, user_id, 0, 2 FROM moved),
            counted AS (SELECT event_id, sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows
                        FROM stacked GROUP BY event_id, event_type, ts, mark, props, user_id)
            SELECT event_id, left_rows, right_rows,
                   CASE WHEN right_rows = 0 THEN 'only_left' ELSE 'only_right' END AS status
            FROM counted WHERE left_rows <> right_rows""",
        "reconcile_documents": """WITH moved AS (
                SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN text || ' ' ELSE text END AS text,
                       CASE WHEN doc_id % 13 = 5 THEN NULL ELSE lang END AS lang
                FROM documents WHERE doc_id % 11 <> 3
                UNION ALL SELECT -doc_id - 1, text, lang FROM documents WHERE doc_id % 17 = 4)
            SELECT coalesce(d.doc_id, m.doc_id) AS doc_id,
                   CASE WHEN m.doc_id IS NULL THEN 'only_left' WHEN d.doc_id IS NULL THEN 'only_right'
                        WHEN (d.text, d.lang) IS NOT DISTINCT FROM (m.text, m.lang) THEN 'match'
                        ELSE 'mismatch' END AS status
            FROM documents d FULL JOIN moved m ON d.doc_id = m.doc_id""",
        "reconcile_events": """WITH moved AS (
                SELECT event_id, event_type,
                       CASE WHEN event_id % 5 = 1 THEN ts + INTERVAL 1 MICROSECOND ELSE ts END AS ts,
                       CASE WHEN event_id % 7 = 3 THEN ts + INTERVAL 1 MICROSECOND ELSE ts END AS mark,
                       CASE WHEN event_id % 8 = 6 THEN props || ',' ELSE props END AS props
                FROM events WHERE event_id % 9 <> 2)
            SELECT e.event_id,
                   CASE WHEN m.event_id IS NULL THEN 'only_left'
                        WHEN (e.ts, e.ts, e.event_type, e.props)
                             IS NOT DISTINCT FROM (m.ts, m.mark, m.event_type, m.props) THEN 'match'
                        ELSE 'mismatch' END AS status
            FROM events e LEFT JOIN moved m ON e.event_id = m.event_id""",
        "manifest_self_check": f"WITH {_FAULTY} {_self_check()}",
        "manifest_self_check_clean": f"WITH {_CLEAN} {_self_check()}",
        "manifest_violations": f"WITH {_FAULTY} "
        + " UNION ALL ".join(f"SELECT relative_path, '{f}' AS fault FROM flags WHERE {f}" for f in _FAULTS)
        + " UNION ALL SELECT relative_path, 'duplicate_path' FROM flags GROUP BY relative_path HAVING count(*) > 1",
        "snapshot_merge_on_read": f"""WITH {_C}
            SELECT relative_path, size, mtime_ns, ctime_ns, true AS has_digest, NULL::BIGINT AS bytes_hashed FROM c""",
        "snapshot_history": f"""WITH {_A}, {_B}, {_C},
            pairs AS (
              SELECT 2::BIGINT AS snapshot_id, coalesce(a.relative_path, b.relative_path) AS relative_path,
                     a.relative_path IS NULL AS came, b.relative_path IS NULL AS went, a.digest AS old, b.digest AS new
              FROM a FULL JOIN b ON a.relative_path = b.relative_path
              UNION ALL
              SELECT 3::BIGINT, coalesce(b.relative_path, c.relative_path),
                     b.relative_path IS NULL, c.relative_path IS NULL, b.digest, c.digest
              FROM b FULL JOIN c ON b.relative_path = c.relative_path)
            SELECT snapshot_id, relative_path,
                   CASE WHEN came THEN 'added' WHEN went THEN 'removed'
                        WHEN old IS NULL OR new IS NULL THEN 'unverified' ELSE 'changed' END AS event
            FROM pairs WHERE came OR went OR old IS NULL OR new IS NULL OR old <> new""",
    }
