"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from . import licences

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]"

_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
gram AS (
    SELECT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM gram),
place AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
met AS (
    SELECT p.r, p.i, s.n, g.item
    FROM place p JOIN sizes s ON p.i + s.n - 1 <= len(p.w)
    JOIN gram g ON g.n = s.n AND g.g = array_to_string(p.w[p.i:p.i + s.n - 1], ' ')
),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM met) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT r, item FROM met WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '?')) AS draw
    FROM documents
),
src AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source
),
ordered AS (
    SELECT *, sum(source_size) OVER () AS total,
           coalesce(sum(3 * source_size) OVER earlier, 0) AS caps,
           sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights
    FROM src
    WINDOW earlier AS (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
-- The first source, by cap over weight, that its share does not fill decides the level.
level AS (
    SELECT total - caps AS rest, weights FROM ordered
    WHERE 3 * source_size * weights > weight * (total - caps)
    ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST LIMIT 1
),
target AS (
    SELECT source, source_size,
           CASE WHEN rest IS NULL OR 3 * source_size * weights <= weight * rest THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(weight * rest AS DOUBLE) / CAST(weights AS DOUBLE) END AS target
    FROM src LEFT JOIN level ON true
),
wanted AS (
    SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS words FROM target
),
running AS (
    SELECT s.doc_id, s.size, w.source_size, w.target, w.words,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE
            size * (words // source_size) + greatest(0, least(size, words % source_size - ahead)) END AS BIGINT) AS taken
FROM running
"""

_NEAR = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS i FROM doc WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS (
    SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
    SELECT a, b FROM edge
    UNION
    SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
),
least_of AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

_LINES = rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM doc),
keyed AS (
    SELECT *, regexp_replace(regexp_replace({_LOWER.format('line')}, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS k FROM line
),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY r, doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    made = f"regexp_replace(lower({column}), {_quoted(licences.COPYRIGHT_LINE)}, '', 'g')"
    made = rf"regexp_replace({made}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for spelling, kept in licences.SPELLINGS:
        made = f"replace({made}, {_quoted(spelling)}, {_quoted(kept)})"
    return made


def _licence_sql() -> str:
    notices = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licences.NOTICES)
    whole = r"trim(regexp_replace({0}, '[ \n]+', ' ', 'g'))"
    return f"""
WITH known AS (
    SELECT DISTINCT name, {whole.format(_canonical('t'))} AS body FROM (VALUES {notices}) v(name, t)
),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_canonical('text')} AS c FROM documents),
unit AS (
    SELECT r, {whole.format('c')} AS body, 1 AS entire FROM doc
    UNION ALL
    SELECT r, trim(unnest(string_split(c, chr(10)))), 0 FROM doc
),
hit AS (
    SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, sum(1 - entire) AS n_notices, max(entire) AS entire
    FROM unit JOIN known USING (body) WHERE body <> '' GROUP BY r
)
SELECT doc_id, coalesce(licences, '') AS licences, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices,
       coalesce(entire, 0) = 1 AS entire, sha256({whole.format('c')}) AS text_digest
FROM doc LEFT JOIN hit USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": _DECONTAMINATION,
        "op5_mixing": _MIXING,
        "op8_licences": _licence_sql(),
        "op9_near_duplicates": _NEAR,
        "op10_line_dedup": _LINES,
    }
