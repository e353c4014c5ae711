"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

# Files as in `derived.file_rows`.
_FILES = """
files AS (
  SELECT doc_id, lang, source AS repo_url, md5(source) AS commit,
         lang || '/f' || doc_id
           || (['.py', '.md', '.js', '.png', '.java', ''])[doc_id % 6 + 1] AS rel,
         strlen(text) AS size, text
  FROM documents)"""

_LANGUAGE = """CASE WHEN rel LIKE '%.py' THEN 'python' WHEN rel LIKE '%.js' THEN 'javascript'
     WHEN rel LIKE '%.java' THEN 'java' END"""
_SUFFIX = r"lower(coalesce(regexp_extract(rel, '[^/](\.[^./]+)$', 1), ''))"

path_suffix_language = f"""
WITH {_FILES}
SELECT repo_url, rel, {_SUFFIX} AS suffix, {_LANGUAGE} AS language, false AS notebook
FROM files"""

page_suffixes = r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$|^[a-z]+://[^/?#]*/?', '', 'g') AS path
           FROM pages)
SELECT page_id, path, lower(coalesce(regexp_extract(path, '[^/](\.[^./]+)$', 1), '')) AS suffix
FROM p"""

relative_paths = f"""
WITH {_FILES}, p AS (SELECT '/data/' || repo_url || '/' || rel AS path FROM files)
SELECT path, CASE WHEN starts_with(path, '/data/src1/') THEN path[12:] END AS below_root
FROM p"""

path_ignore = f"""
WITH {_FILES}, p AS (
  SELECT doc_id, (['', '.git/', 'a/node_modules/', 'Build/', 'build/', 'x.egg-info/', '.env/',
                   'a.git/'])[doc_id % 8 + 1] || rel AS rel
  FROM files)
SELECT doc_id, rel,
       list_has_any(string_split(rel, '/'),
         ['.git', 'node_modules', '__pycache__', '.pytest_cache', '.mypy_cache', '.ruff_cache',
          '.venv', 'venv', '.env', 'dist', 'build', '.egg-info', 'target']) AS ignored
FROM p"""

_REASON = """CASE WHEN rel LIKE '%.png' THEN 'binary' WHEN size > 4000 THEN 'too_large'
     WHEN size IS NULL THEN 'ignored' ELSE 'ok' END"""

file_decisions = f"""
WITH {_FILES}, f AS (
  SELECT repo_url, rel, CASE WHEN doc_id % 97 <> 0 THEN size END AS size FROM files),
d AS (SELECT repo_url, rel, {_REASON} AS reason FROM f)
SELECT repo_url, rel, reason = 'ok' AS include, reason FROM d"""

decision_counts = f"""
WITH {_FILES}, d AS (SELECT *, {_REASON} AS reason FROM files)
SELECT repo_url, min(commit) AS commit, count(*) AS total_files,
       count(*) FILTER (reason = 'ok' AND lang <> 'es') AS processed_files,
       count(*) FILTER (reason = 'binary') AS skipped_binary,
       count(*) FILTER (reason = 'too_large') AS skipped_large,
       count(*) FILTER (reason = 'ok' AND lang = 'es') AS skipped_empty,
       0::BIGINT AS failed_files
FROM d GROUP BY repo_url"""

repo_urls = """
WITH u AS (SELECT doc_id, (['https://github.com/o/r', 'git@github.com:o/r',
                            'http://github.com/o/r', 'ftp://x/'])[doc_id % 4 + 1] || doc_id AS repo_url
           FROM documents)
SELECT doc_id, repo_url,
       starts_with(repo_url, 'https://github.com/') OR starts_with(repo_url, 'git@github.com:') AS valid
FROM u"""

_HUMAN = """CASE WHEN {n} < 1024 THEN printf('%.1f B', {n}::DOUBLE)
     WHEN {n} < 1048576 THEN printf('%.1f KB', {n} / 1024.0::DOUBLE)
     WHEN {n} < 1073741824 THEN printf('%.1f MB', {n} / 1048576.0::DOUBLE)
     WHEN {n} < 1099511627776 THEN printf('%.1f GB', {n} / 1073741824.0::DOUBLE)
     ELSE printf('%.1f TB', {n} / 1099511627776.0::DOUBLE) END"""

human_bytes = f"""
WITH s AS (SELECT l_orderkey AS a,
                  (l_orderkey::DOUBLE * l_partkey * pow(64, l_linenumber - 1))::BIGINT AS b
           FROM lineitem)
SELECT {_HUMAN.format(n='a')} AS orderkey, {_HUMAN.format(n='b')} AS product, count(*) AS n
FROM s GROUP BY 1, 2"""

sanitize_strip = r"""
SELECT doc_id,
       chr(160) || chr(9) || chr(28) || text || chr(8195) || ' ' || chr(10) || chr(12288) AS clean,
       regexp_replace(text, '^[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', '')
         || chr(0) || chr(8195) || ' ' || chr(0) AS stripped,
       true AS blank
FROM documents"""

decode_text = """
SELECT doc_id, text || chr(10) || 'a' || chr(65533) || 'b' || chr(65533) || 'c' || chr(65533) AS text
FROM documents"""

notebook_extract = """
SELECT doc_id,
       chr(10) || '## Code Cell 1' || chr(10) || '```python' || chr(10) || text || chr(10) || chr(10)
       || '```' || chr(10) || chr(10) || '## Markdown Cell 3' || chr(10) || text
       || chr(10) || chr(10) || '## Raw Cell 4' || chr(10) || text AS content
FROM documents"""

unreadable_files = """
SELECT doc_id, CASE lang WHEN 'fr' THEN 'notebook could not be parsed' ELSE 'OSError: gone' END AS error
FROM documents WHERE lang IN ('fr', 'de')"""

short_labels = """
SELECT doc_id, substr(md5(source), 1, 8) AS commit, 'Unknown' AS unknown, source AS known,
       upper(lang[1]) || lang[2:] AS titled
FROM documents"""

meta_json = f"""
WITH {_FILES}
SELECT doc_id,
       '{{"source":"github","repo_url":"' || repo_url || '","file_paths":["' || rel || '"],"commit":"'
         || commit || '","chunk_index":' || doc_id || ',"total_chunks":' || size || '}}' AS json,
       repo_url, rel AS path, doc_id AS chunk_index, true AS no_language
FROM files"""

# Central European time by its rule: summer time from 01:00 UTC on the last Sunday of
# March to 01:00 UTC on the last Sunday of October.
local_times = """
WITH e AS (SELECT event_id, ts,
                  make_date(year(ts), 3, 31) AS m, make_date(year(ts), 10, 31) AS o FROM events),
s AS (SELECT event_id, ts,
             (m - dayofweek(m)::INT)::TIMESTAMP + INTERVAL 1 HOUR AS b,
             (o - dayofweek(o)::INT)::TIMESTAMP + INTERVAL 1 HOUR AS f FROM e)
SELECT event_id,
       strftime(ts + CASE WHEN ts >= b AND ts < f THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END,
                '%Y-%m-%d %H:%M:%S') AS local_ts
FROM s"""

token_counts = r"""
SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n
FROM documents"""


# --- chunkers. Each CTE reads (k1, k2, text) and yields (k1, k2, pos, chunk). ---


def _line_ctes(name: str, source: str, lines: int, overlap: int, max_chars: int | None) -> str:
    stride = lines - overlap
    if max_chars is None:
        pieces = f"SELECT k1, k2, w, 0 AS i, t AS chunk FROM {name}_w"
    else:
        pieces = f"""SELECT k1, k2, w, i, substr(t, i * {max_chars} + 1, {max_chars}) AS chunk
          FROM (SELECT *, unnest(range(greatest(ceil(length(t) / {max_chars}.0), 1)::BIGINT)) AS i
                FROM {name}_w)"""
    return f"""
{name}_l AS (SELECT k1, k2, string_split(text, chr(10)) AS l FROM ({source})),
{name}_k AS (SELECT k1, k2, l, unnest(range(ceil(greatest(len(l) - {overlap}, 1) / {stride}.0)::BIGINT)) AS w
             FROM {name}_l),
{name}_w AS (SELECT k1, k2, w,
                    array_to_string(l[w * {stride} + 1 : w * {stride} + {lines}], chr(10)) AS t
             FROM {name}_k),
{name}_p AS ({pieces}),
{name} AS (SELECT k1, k2, row_number() OVER (PARTITION BY k1, k2 ORDER BY w, i) - 1 AS pos, w, chunk
           FROM {name}_p)"""


def _token_ctes(name: str, source: str, piece: int = 64, budget: int = 1024, overlap: int = 64) -> str:
    frame = f"OVER (PARTITION BY k1, k2 ORDER BY i ROWS BETWEEN CURRENT ROW AND {piece - 1} FOLLOWING)"
    return rf"""
{name}_s AS (SELECT k1, k2, regexp_extract(text, '^\s*') AS head,
                    regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+\s*|[^\p{{L}}\p{{N}}_\s]\s*') AS toks
             FROM ({source})),
{name}_t AS (SELECT k1, k2, len(toks) AS n, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
             FROM {name}_s),
{name}_e AS (SELECT k1, k2, i,
                    coalesce(max(CASE WHEN i = n OR right(tok, 1) = chr(10) THEN i END) {frame},
                             max(CASE WHEN regexp_matches(tok, '\s$') THEN i END) {frame},
                             max(i) {frame}) AS e
             FROM {name}_t),
{name}_g AS (SELECT k1, k2, 1::BIGINT AS i, 0::BIGINT AS p FROM {name}_s WHERE len(toks) > 0
             UNION ALL
             SELECT g.k1, g.k2, x.e + 1, g.p + 1
             FROM {name}_g g JOIN {name}_e x USING (k1, k2, i)),
{name}_q AS (SELECT g.k1, g.k2, g.p,
                    CASE WHEN g.p = 0 THEN s.head ELSE '' END
                      || array_to_string(s.toks[g.i : x.e], '') AS t
             FROM {name}_g g JOIN {name}_e x USING (k1, k2, i) JOIN {name}_s s USING (k1, k2)),
{name}_l AS (SELECT k1, k2, list(t ORDER BY p) AS ps FROM {name}_q GROUP BY k1, k2),
{name}_c AS (SELECT k1, k2, p, n, sum(n) OVER (PARTITION BY k1, k2 ORDER BY p) AS c
             FROM (SELECT k1, k2, p,
                          len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS n
                   FROM {name}_q)),
{name}_m AS (SELECT a.k1, a.k2, a.p AS s, max(v.p) AS e, max(v.c) AS c
             FROM {name}_c a JOIN {name}_c v
               ON a.k1 = v.k1 AND a.k2 = v.k2 AND v.p >= a.p AND v.c - a.c + a.n <= {budget}
             GROUP BY a.k1, a.k2, a.p),
{name}_x AS (SELECT m.k1, m.k2, m.s, m.e, min(w.p) AS next
             FROM {name}_m m LEFT JOIN {name}_c w
               ON m.k1 = w.k1 AND m.k2 = w.k2 AND w.p > m.s AND w.p <= m.e + 1
                  AND m.c - w.c + w.n <= {overlap}
             GROUP BY m.k1, m.k2, m.s, m.e),
{name}_h AS (SELECT k1, k2, s, e, next, 0::BIGINT AS pos FROM {name}_x WHERE s = 0
             UNION ALL
             SELECT x.k1, x.k2, x.s, x.e, x.next, h.pos + 1
             FROM {name}_h h JOIN {name}_x x ON x.k1 = h.k1 AND x.k2 = h.k2 AND x.s = h.next
               JOIN {name}_l l ON l.k1 = h.k1 AND l.k2 = h.k2 AND h.e < len(l.ps) - 1),
{name} AS (SELECT k1, k2, pos, array_to_string(ps[s + 1 : e + 1], '') AS chunk
           FROM {name}_h JOIN {name}_l USING (k1, k2))"""


_PYTHON = (r"^\s*(?:async\s+def|def|class)\s", r"^\s*[@#]")
_JAVA_MODIFIERS = (
    "public|private|protected|internal|static|final|abstract|sealed|virtual|override"
    "|async|partial|readonly|synchronized|native|default|unsafe|extern|new"
)
_JAVA = (
    rf"^\s*(?:(?:{_JAVA_MODIFIERS})\s+)*(?:class|interface|enum|record|struct|namespace)\s+\w"
    rf"|^\s*(?:(?:{_JAVA_MODIFIERS})\s+)+[\w<>\[\],.? ]+\(",
    r"^\s*(?:@|//|/\*|\*)",
)


def _declaration_ctes(
    name: str, source: str, patterns: tuple[str, str], overlap: int, budget: int = 1024,
    expand: bool = False,
) -> str:
    opener, leader = patterns
    doc = "PARTITION BY k1, k2"
    header = "''"
    if expand:
        header = rf"""CASE WHEN regexp_matches(l[s + 1], '^\s') THEN coalesce(
            list_filter(l[1 : s], lambda x: regexp_matches(x, '^\S') AND regexp_matches(x, '{opener}'))[-1]
              || chr(10), '') ELSE '' END"""
    return rf"""
{name}_d AS (SELECT k1, k2, string_split(text, chr(10)) AS l FROM ({source})),
{name}_l AS (SELECT k1, k2, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM {name}_d),
{name}_f AS (SELECT *, length(regexp_replace(line, '\s', '', 'g')) AS n,
                    regexp_matches(line, '{leader}') AS lead, regexp_matches(line, '{opener}') AS opens
             FROM {name}_l),
{name}_b AS (SELECT *, (opens OR lead)
                      AND NOT coalesce(lag(lead) OVER ({doc} ORDER BY i), false) AS begins
             FROM {name}_f),
{name}_o AS (SELECT *, sum((i > 0 AND begins AND regexp_matches(line, '^\S'))::INT)
                      OVER ({doc} ORDER BY i) AS o FROM {name}_b),
{name}_x AS (SELECT *, sum(n) OVER ({doc}, o) AS osize,
                    row_number() OVER ({doc}, o ORDER BY i) AS opos FROM {name}_o),
{name}_y AS (SELECT *, sum((opos > 1 AND begins)::INT) OVER ({doc}, o ORDER BY i) AS b FROM {name}_x),
{name}_z AS (SELECT *, sum(n) OVER ({doc}, o, b) AS bsize,
                    row_number() OVER ({doc}, o, b ORDER BY i) AS bpos FROM {name}_y),
{name}_u AS (SELECT k1, k2, i, n,
                    sum((opos = 1 OR (osize > {budget} AND bpos = 1)
                         OR (osize > {budget} AND bsize > {budget}))::INT) OVER ({doc} ORDER BY i) AS u
             FROM {name}_z),
{name}_r AS (SELECT k1, k2, u, min(i) AS s, max(i) + 1 AS e, sum(n) AS n
             FROM {name}_u GROUP BY k1, k2, u),
{name}_c AS (SELECT *, sum(n) OVER ({doc} ORDER BY u) AS c FROM {name}_r),
{name}_n AS (SELECT a.k1, a.k2, a.u, a.s, max(v.u) AS v, max(v.e) AS e, max(v.c) - any_value(a.c - a.n) AS n
             FROM {name}_c a JOIN {name}_c v
               ON a.k1 = v.k1 AND a.k2 = v.k2 AND v.u >= a.u
                  AND (v.u = a.u OR v.c - a.c + a.n <= {budget})
             GROUP BY a.k1, a.k2, a.u, a.s),
{name}_g AS (SELECT k1, k2, u, s, v, e, n, 0::BIGINT AS p, NULL::BIGINT AS before
             FROM {name}_n WHERE u = (SELECT min(m.u) FROM {name}_n m)
               OR s = 0
             UNION ALL
             SELECT x.k1, x.k2, x.u, x.s, x.v, x.e, x.n, g.p + 1, g.s
             FROM {name}_g g JOIN {name}_n x ON x.k1 = g.k1 AND x.k2 = g.k2 AND x.u = g.v + 1),
{name}_m AS (SELECT k1, k2, p, s AS own, e, n,
                    greatest(s - {overlap}, coalesce(before, s)) AS s FROM {name}_g WHERE s = 0 OR p > 0),
{name}_h AS (SELECT k1, k2, p, n, l[own + 1] AS line,
                    {header} || array_to_string(l[s + 1 : e], chr(10)) AS t
             FROM {name}_m JOIN {name}_d USING (k1, k2)),
{name}_i AS (SELECT *, unnest(range(CASE WHEN n <= {budget} THEN 1
                                    ELSE ceil(length(line) / {budget}.0)::BIGINT END)) AS j
             FROM {name}_h),
{name} AS (SELECT k1, k2, row_number() OVER ({doc} ORDER BY p, j) - 1 AS pos,
                  CASE WHEN n <= {budget} THEN t ELSE substr(line, j * {budget} + 1, {budget}) END AS chunk
           FROM {name}_i)"""


_DOCS = "SELECT doc_id AS k1, 0 AS k2, text FROM documents"
_SHOW = "SELECT k1 AS doc_id, pos, chunk FROM c"
_CODE = r"""SELECT doc_id AS k1, source AS k2,
  'import x' || chr(10) || '@dec' || chr(10) || 'class A(B):' || chr(10) || '    '
  || replace(text, chr(10), chr(10) || '    def f(self):' || chr(10) || '        ')
  || chr(10) || 'def last():' || chr(10) || '    ' || string_split(text, chr(10))[1] AS text
  FROM documents"""

line_chunks = f"WITH {_line_ctes('c', _DOCS, 40, 15, 1024)} {_SHOW}"
line_windows = f"WITH {_line_ctes('c', _DOCS, 7, 3, None)} {_SHOW}"
char_pieces = """
WITH p AS (SELECT page_id, html, unnest(range(greatest(ceil(length(html) / 500.0), 1)::BIGINT)) AS pos
           FROM pages)
SELECT page_id, pos, substr(html, pos * 500 + 1, 500) AS chunk FROM p"""
notebook_chunks = """
WITH c AS (
  SELECT doc_id, 1 AS i, chr(10) || '## Code Cell 1' || chr(10) || '```python' || chr(10) || text
         || chr(10) || chr(10) || '```' AS t FROM documents
  UNION ALL SELECT doc_id, 2, chr(10) || '## Markdown Cell 3' || chr(10) || text FROM documents
  UNION ALL SELECT doc_id, 3, chr(10) || '## Raw Cell 4' || chr(10) || text FROM documents),
n AS (SELECT doc_id, max(length(t)) FILTER (i = 1) AS a, max(length(t)) FILTER (i = 2) AS b,
             max(length(t)) FILTER (i = 3) AS c FROM c GROUP BY doc_id),
g AS (SELECT doc_id, (a + b > 1024)::INT AS g2,
             (CASE WHEN a + b > 1024 THEN b ELSE a + b END + c > 1024)::INT AS g3 FROM n),
p AS (SELECT doc_id, CASE i WHEN 1 THEN 0 WHEN 2 THEN g2 ELSE g2 + g3 END AS g,
             string_agg(t, chr(10) ORDER BY i) AS t, sum(length(t)) AS n
      FROM c JOIN g USING (doc_id) GROUP BY 1, 2),
x AS (SELECT doc_id, g, t, n, unnest(range(CASE WHEN n <= 1024 THEN 1
             ELSE ceil(length(t) / 1024.0)::BIGINT END)) AS j FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, j) - 1 AS pos,
       CASE WHEN n <= 1024 THEN t ELSE substr(t, j * 1024 + 1, 1024) END AS chunk FROM x"""
token_chunks = f"WITH RECURSIVE {_token_ctes('c', _DOCS)} {_SHOW}"
struct_chunks = f"WITH RECURSIVE {_declaration_ctes('c', _CODE, _PYTHON, 3)} {_SHOW}"
expanded_chunks = f"""
WITH RECURSIVE {_declaration_ctes('c', _CODE, _PYTHON, 0, expand=True)}
SELECT k1 AS doc_id, pos, k2 || chr(10) || chunk AS chunk FROM c"""


def _routed(where: str = "true") -> str:
    """CTE `routed` with (k1 = repo_url, k2 = rel, language, pos, chunk)."""

    def of(suffix: str) -> str:
        return f"SELECT repo_url AS k1, rel AS k2, text FROM files WHERE rel LIKE '{suffix}' AND {where}"

    other = f"""SELECT repo_url AS k1, rel AS k2, text FROM files
                WHERE rel NOT LIKE '%.py' AND rel NOT LIKE '%.js' AND rel NOT LIKE '%.java' AND {where}"""
    return f"""{_FILES}, {_declaration_ctes('py', of('%.py'), _PYTHON, 3)},
{_declaration_ctes('ja', of('%.java'), _JAVA, 3)}, {_line_ctes('js', of('%.js'), 40, 15, 1024)},
{_token_ctes('ot', other)},
routed AS (SELECT *, 'python' AS language FROM py UNION ALL SELECT *, 'java' FROM ja
           UNION ALL SELECT k1, k2, pos, chunk, 'javascript' FROM js UNION ALL SELECT *, NULL FROM ot)"""


routed_chunks = f"""
WITH RECURSIVE {_routed()}
SELECT doc_id, language, pos, chunk
FROM routed JOIN files ON repo_url = k1 AND rel = k2"""

# --- groups ---

_LABEL = f"coalesce({_LANGUAGE}, 'semantic')"
_GROUPED = f"""{_FILES}, g AS (SELECT repo_url, {_LABEL} AS label, rel, text FROM files)"""

language_groups = f"""
WITH {_GROUPED}
SELECT repo_url, label, count(*) AS files, min(rel) AS first_rel FROM g GROUP BY repo_url, label"""

group_lines = f"""
WITH {_GROUPED},
s AS (SELECT repo_url, label, rel, string_split(text, chr(10)) AS l FROM g),
u AS (SELECT repo_url, label, rel, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM s)
SELECT repo_url, label, rel, line,
       row_number() OVER (PARTITION BY repo_url, label ORDER BY rel, i) - 1 AS line_no
FROM u"""

_JOINED = """SELECT repo_url AS k1, label AS k2, string_agg(text, chr(10) ORDER BY rel) AS text
             FROM g GROUP BY repo_url, label"""



def _window_files(name: str, source: str, groups: str, lines: int = 40, stride: int = 25) -> str:
    """The files with lines in each window of their group: (k1, k2, w, file_paths)."""
    return f"""
{name}_n AS (SELECT {groups}, rel, len(string_split(text, chr(10))) AS n FROM {source}),
{name}_o AS (SELECT *, sum(n) OVER (PARTITION BY k1, k2 ORDER BY rel) - n AS first FROM {name}_n),
{name}_w AS (SELECT *, unnest(range(greatest((first - {lines}) // {stride} - 1, 0)::BIGINT,
                                    ((first + n - 1) // {stride} + 1)::BIGINT)) AS w FROM {name}_o),
{name} AS (SELECT k1, k2, w, string_agg(rel, '|' ORDER BY first) AS file_paths FROM {name}_w
           WHERE first < w * {stride} + {lines} AND first + n > w * {stride} GROUP BY k1, k2, w)"""


group_line_chunks = f"""
WITH {_GROUPED}, {_line_ctes('c', _JOINED, 40, 15, None)},
{_window_files('f', 'g', 'repo_url AS k1, label AS k2')}
SELECT k1 AS repo_url, k2 AS label, pos AS "window", chunk, file_paths FROM c JOIN f USING (k1, k2, w)"""

group_file_paths = f"""
WITH {_GROUPED}
SELECT repo_url, label, rel,
       row_number() OVER (PARTITION BY repo_url, label ORDER BY rel) - 1 AS position,
       count(*) OVER (PARTITION BY repo_url, label) AS files
FROM g"""

group_path_lists = f"""
WITH {_GROUPED}, p AS (
  SELECT repo_url, label, rel,
         (row_number() OVER (PARTITION BY repo_url, label ORDER BY rel) - 1) // 100 AS page FROM g)
SELECT repo_url, label, page, string_agg(rel, '|' ORDER BY rel) AS file_paths
FROM p GROUP BY repo_url, label, page"""

_BY_FILE = "SELECT repo_url AS k1, rel AS k2, text FROM files"

chunk_counts_by_group = f"""
WITH {_GROUPED}, {_line_ctes('c', _BY_FILE, 40, 15, 1024)}
SELECT k1 AS repo_url, label, count(*) AS chunks
FROM c JOIN g ON k1 = repo_url AND k2 = rel GROUP BY k1, label"""

# --- duplicates and numbers ---

_UNITS = f"""{_GROUPED}, {_line_ctes('c', _BY_FILE, 7, 0, 200)},
firsts AS (SELECT repo_url, label, min(rel) AS first_rel FROM g GROUP BY repo_url, label),
placed AS (SELECT k1 AS repo_url, first_rel, k2 AS unit, pos, chunk
           FROM c JOIN g ON k1 = g.repo_url AND k2 = rel
             JOIN firsts ON firsts.repo_url = g.repo_url AND firsts.label = g.label),
kept AS (SELECT * FROM placed
         QUALIFY row_number() OVER (PARTITION BY repo_url, chunk ORDER BY first_rel, unit, pos) = 1)"""

dedup_first_wins = f"WITH {_UNITS} SELECT repo_url, first_rel, unit, pos FROM kept"

chunk_numbering = f"""
WITH {_UNITS}
SELECT repo_url, unit, pos, chunk,
       row_number() OVER (PARTITION BY repo_url ORDER BY first_rel, unit, pos) - 1 AS chunk_index,
       count(*) OVER (PARTITION BY repo_url) AS total_chunks,
       row_number() OVER (ORDER BY repo_url, first_rel, unit, pos) - 1 AS ordinal
FROM kept"""

duplicates_removed = f"""
WITH {_UNITS}
SELECT repo_url, count(*) AS chunks, count(DISTINCT chunk) AS unique_chunks,
       count(*) - count(DISTINCT chunk) AS duplicates
FROM placed GROUP BY repo_url"""

duplicate_documents = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"

# --- whole repositories ---

_INCLUDED = "rel NOT LIKE '%.png' AND size <= 51200"
_INDEXED = f"""{_routed(_INCLUDED)},
firsts AS (SELECT repo_url, {_LABEL} AS label, min(rel) AS first_rel
           FROM files WHERE {_INCLUDED} GROUP BY 1, 2),
placed AS (SELECT k1 AS repo_url, first_rel, k2 AS rel, pos, chunk
           FROM routed JOIN firsts ON k1 = repo_url AND coalesce(language, 'semantic') = label),
kept AS (SELECT * FROM placed WHERE regexp_matches(chunk, '\\S')
         QUALIFY row_number() OVER (PARTITION BY repo_url, chunk ORDER BY first_rel, rel, pos) = 1)"""

indexed_chunks = f"""
WITH RECURSIVE {_INDEXED}
SELECT repo_url, chunk AS content, rel AS file_path,
       row_number() OVER (PARTITION BY repo_url ORDER BY first_rel, rel, pos) - 1 AS chunk_index,
       count(*) OVER (PARTITION BY repo_url) AS total_chunks,
       row_number() OVER (ORDER BY repo_url, first_rel, rel, pos) - 1 AS ordinal
FROM kept"""

_COUNTS = """counts AS (
  SELECT repo_url, min(commit) AS commit, count(*) AS total_files,
         count(*) FILTER (rel NOT LIKE '%.png' AND size <= 51200) AS processed_files,
         count(*) FILTER (rel LIKE '%.png') AS skipped_binary,
         count(*) FILTER (rel NOT LIKE '%.png' AND size > 51200) AS skipped_large,
         0::BIGINT AS skipped_empty, 0::BIGINT AS failed_files
  FROM files GROUP BY repo_url)"""

run_summary = f"""
WITH RECURSIVE {_INDEXED}, {_COUNTS}
SELECT counts.*, total_chunks
FROM counts JOIN (SELECT repo_url, count(*) AS total_chunks FROM kept GROUP BY repo_url) USING (repo_url)"""

_JS = """js AS (SELECT source AS repo_url, lang || '/f' || doc_id || '.js' AS rel, text
               FROM documents WHERE strlen(text) <= 51200)"""
_JS_JOINED = """SELECT repo_url AS k1, 0 AS k2, string_agg(text, chr(10) ORDER BY rel) AS text
                FROM js GROUP BY repo_url"""

group_scope_chunks = f"""
WITH {_JS}, {_line_ctes('c', _JS_JOINED, 40, 15, 1024)},
kept AS (SELECT * FROM c WHERE regexp_matches(chunk, '\\S')
         QUALIFY row_number() OVER (PARTITION BY k1, chunk ORDER BY pos) = 1),
{_window_files('f', 'js', 'repo_url AS k1, 0 AS k2')}
SELECT k1 AS repo_url, chunk AS content, file_paths,
       row_number() OVER (PARTITION BY k1 ORDER BY pos) - 1 AS chunk_index,
       count(*) OVER (PARTITION BY k1) AS total_chunks
FROM kept JOIN f USING (k1, k2, w)"""

stored_group_files = f"""
WITH {_GROUPED}
SELECT repo_url, label, rel,
       row_number() OVER (PARTITION BY repo_url, label ORDER BY rel) - 1 AS position,
       count(*) OVER (PARTITION BY repo_url, label) AS files
FROM g WHERE strlen(text) <= 51200 AND rel NOT LIKE '%.png'"""

# --- embedding ---


def _rounded(x: str) -> str:
    return f"CASE WHEN abs({x}) < 5e-7 THEN 0.0::DOUBLE ELSE round({x}, 6) END"


def _bucket_ctes(name: str, source: str, dim: int) -> str:
    """Counts of hashed tokens of (key, text): (key, bucket, n)."""
    return rf"""
{name}_t AS (SELECT key, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS t
             FROM ({source})),
{name} AS (SELECT key, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS bucket, count(*) AS n
           FROM {name}_t GROUP BY 1, 2)"""


def _vector_ctes(name: str, source: str, dim: int) -> str:
    """The same as unit vectors stored in 32 bits, and the norms of those."""
    return f"""{_bucket_ctes(name + '_b', source, dim)},
{name} AS (SELECT key, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS x
           FROM {name}_b),
{name}_n AS (SELECT key, sqrt(sum(x * x)) AS norm FROM {name} GROUP BY key)"""


_DOC_TEXT = "SELECT doc_id AS key, text FROM documents"
_ASKED = "SELECT item_id AS key, text FROM benchmark"

hash_embed_buckets = f"""
WITH {_bucket_ctes('b', _DOC_TEXT, 1536)} SELECT key AS doc_id, bucket, n FROM b"""

embed_documents = f"""
WITH {_vector_ctes('v', _DOC_TEXT, 64)}
SELECT doc_id, place, round(coalesce(x, 0), 5) AS x
FROM (SELECT doc_id, unnest(range(64)) AS place FROM documents) d
LEFT JOIN v ON v.key = doc_id AND v.bucket = place"""

check_documents = """
SELECT doc_id, CASE lang WHEN 'fr' THEN 'content is white space only' WHEN 'en' THEN NULL
               ELSE 'content is missing' END AS error
FROM documents"""


def _lexical_knn(dim: int, k: int) -> str:
    return f"""{_vector_ctes('v', _DOC_TEXT, dim)}, {_vector_ctes('q', _ASKED, dim)},
pairs AS (SELECT qn.key AS query_id, vn.key AS id, qn.norm * vn.norm AS norms
          FROM q_n qn CROSS JOIN v_n vn),
dots AS (SELECT q.key AS query_id, v.key AS id, sum(q.x * v.x) AS dot
         FROM q JOIN v USING (bucket) GROUP BY 1, 2),
ranked AS (SELECT query_id, id, 1 - coalesce(dot, 0) / norms AS distance,
                  row_number() OVER (PARTITION BY query_id
                                     ORDER BY round(1 - coalesce(dot, 0) / norms, 12), id) AS rank
           FROM pairs LEFT JOIN dots USING (query_id, id) QUALIFY rank <= {k})"""


embed_knn = f"""
WITH {_lexical_knn(1536, 2)}
SELECT query_id, id, rank, {_rounded("distance")} AS distance FROM ranked"""

search_index = f"""
WITH {_lexical_knn(64, 2)}
SELECT query_id, id + 1 AS id, rank, {_rounded("distance")} AS distance,
       nullif(source, 'src3') AS repo_url, sha256(text) AS digest
FROM ranked JOIN documents ON doc_id = id"""

# --- search ---

_DISTANCE = "list_cosine_distance(r.embedding::DOUBLE[], q.embedding::DOUBLE[])"

cosine_distances = f"""
SELECT r.vec_id AS id, {_rounded(_DISTANCE)} AS distance, round(1 + {_DISTANCE}, 5) AS one_more_by_unit
FROM embeddings r, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""


def _knn(queries: str, k: int | str, limit: float | None = None) -> str:
    bound = "true" if limit is None else f"{_DISTANCE} <= {limit}"
    return f"""
SELECT q.vec_id AS query_id, r.vec_id AS id, {_rounded(_DISTANCE)} AS distance,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE}, r.vec_id) AS rank
FROM embeddings r, {queries} q WHERE {bound}
QUALIFY rank <= {k}"""


knn_top2 = _knn("(SELECT * FROM embeddings WHERE vec_id = 0)", 2)
knn_batch = _knn("embeddings", 5)
knn_threshold = _knn("embeddings", 10, 0.6)
knn_self = """
SELECT vec_id AS query_id, vec_id AS id, 1::BIGINT AS rank, 0.0::DOUBLE AS distance
FROM embeddings"""


def _among(pairs: str, k: int) -> str:
    """The k nearest of pairs (q, r) of ids."""
    return f"""
SELECT q.vec_id AS query_id, r.vec_id AS id, {_rounded(_DISTANCE)} AS distance,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE}, r.vec_id) AS rank
FROM {pairs} p JOIN embeddings q ON p.q = q.vec_id JOIN embeddings r ON p.r = r.vec_id
QUALIFY rank <= {k}"""


knn_lsh = f"""
WITH s AS (SELECT t, b, list(CASE WHEN md5(t || ':' || b || ':' || i)[1] < '8' THEN 1.0 ELSE -1.0 END::DOUBLE
                             ORDER BY i) AS s
           FROM range(6) x(t), range(6) y(b), range(64) z(i) GROUP BY t, b),
c AS (SELECT vec_id, t, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], s) >= 0 THEN 1 << b ELSE 0 END) AS c
      FROM embeddings, s GROUP BY vec_id, t),
p AS (SELECT DISTINCT a.vec_id AS q, b.vec_id AS r FROM c a JOIN c b USING (t, c))
{_among('p', 5)}"""
knn_clusters = f"""
WITH n AS (SELECT e.vec_id, c.vec_id AS cell, row_number() OVER (PARTITION BY e.vec_id
             ORDER BY list_cosine_distance(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.vec_id) AS nth
           FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 16) c),
p AS (SELECT a.vec_id AS q, b.vec_id AS r FROM n a JOIN n b USING (cell) WHERE a.nth <= 4 AND b.nth = 1)
{_among('p', 5)}"""
knn_unembedded = f"""
WITH r AS (SELECT vec_id, CASE WHEN embedding[1] > 0.33::DOUBLE THEN embedding END AS embedding
           FROM embeddings),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS id,
             list_cosine_distance(r.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
      FROM r, embeddings q)
SELECT query_id, id, {_rounded("d")} AS distance,
       row_number() OVER (PARTITION BY query_id ORDER BY d NULLS LAST, id) AS rank
FROM d QUALIFY rank <= 10"""

render_results = f"""
WITH found AS ({_knn("(SELECT * FROM embeddings WHERE label <> 2)", 2)}),
texts AS (
  SELECT query_id, rank,
         '### Result ' || rank || chr(10) || '**Repository:** '
         || CASE WHEN label = 0 THEN 'Unknown' ELSE 'r' || label END || chr(10)
         || CASE WHEN label = 1 THEN '**File:** f' || id || chr(10) ELSE '' END
         || CASE WHEN label = 4 THEN '**Language:** python' || chr(10) ELSE '' END
         || '**Chunk:** ' || label || chr(10) || chr(10) || '**Content:**' || chr(10) || '```'
         || chr(10) || CASE WHEN label <> 1 THEN 'c' || id ELSE '' END || chr(10) || '```' || chr(10) AS t
  FROM found JOIN embeddings ON vec_id = id),
joined AS (SELECT query_id, string_agg(t, chr(10) ORDER BY rank) AS t FROM texts GROUP BY query_id)
SELECT vec_id AS query_id, coalesce(t, 'No results found for the query.') AS rendered
FROM embeddings LEFT JOIN joined ON query_id = vec_id"""

# --- the file source and the index ---

scan_files = f"""
WITH {_FILES}
SELECT 'https://github.com/o/' || repo_url AS repo_url, commit, rel, size, sha256(text) AS digest,
       NULL::VARCHAR AS error
FROM files"""

scan_summary = f"""
WITH RECURSIVE {_INDEXED}, {_COUNTS}
SELECT counts.* REPLACE ('https://github.com/o/' || repo_url AS repo_url),
       total_chunks, stored
FROM counts JOIN (SELECT repo_url, count(*) AS total_chunks,
                         count(*) FILTER (regexp_matches(chunk, '\\S')) AS stored
                  FROM kept GROUP BY repo_url) USING (repo_url)"""

_STORED = "nullif(source, 'src3') AS repo_url, sha256(text) AS digest"
_N = "(SELECT count(*) FROM documents)"

index_rows = f"SELECT doc_id + 1 AS id, {_STORED} FROM documents"
search_self = "SELECT doc_id AS query_id, true AS found FROM documents"
of_repo = f"SELECT doc_id + 1 AS id, {_STORED} FROM documents WHERE source = 'src0'"
drop_table = "SELECT count(*) AS n_rows, true AS there, false AS other_there FROM documents"
ingest_one = f"""
SELECT doc_id + 1 AS id, {_STORED}, false AS added FROM documents
UNION ALL
SELECT {_N} + 1, NULL, sha256(text), true
FROM (SELECT text FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1)"""
audit_stamps = """
SELECT nullif(source, 'src3') AS repo_url, true AS old, source IN ('src1', 'src2') AS renewed, count(*) AS n
FROM documents GROUP BY source"""
empty_input = f"""
WITH {_FILES}
SELECT repo_url, count(*) AS total_files, count(*) FILTER (rel NOT LIKE '%.png') AS skipped_large,
       0::BIGINT AS total_chunks, true AS refused, true AS nothing_stored
FROM files GROUP BY repo_url"""
embed_fallback = """
SELECT doc_id, NOT starts_with(text, 'T') AS embedded,
       CASE WHEN starts_with(text, 'T') THEN 'ValueError: no T' END AS error
FROM documents"""
scan_failures = """
SELECT 'https://github.com/o/' || source AS repo_url,
       CASE source WHEN 'src1' THEN 1 ELSE count(*) END AS total_files,
       (source = 'src1')::BIGINT AS failed_files, source <> 'src1' AS stored,
       CASE source WHEN 'src1' THEN '.' END AS path,
       CASE source WHEN 'src1' THEN 'FileNotFoundError: No such file or directory' END AS error
FROM documents GROUP BY source"""
assigned_ids = """
SELECT doc_id, CASE WHEN lang = 'fr' THEN doc_id + 1000000
  ELSE (SELECT coalesce(max(doc_id) + 1000000, 0) FROM documents WHERE lang = 'fr')
       + row_number() OVER (PARTITION BY lang = 'fr' ORDER BY doc_id) END AS id
FROM documents"""
foreign_meta = """
SELECT event_id AS id, 'https://github.com/a/b' AS repo_url, event_type AS content,
       props AS meta_json, true AS no_language
FROM events"""
repo_exists = """
WITH asked AS (SELECT source AS repo_url FROM documents UNION SELECT lang FROM documents)
SELECT repo_url, repo_url IN (SELECT source FROM documents WHERE source <> 'src3') AS present
FROM asked"""
delete_repo = f"""
SELECT doc_id + 1 AS id, {_STORED}, (SELECT count(*) FROM documents WHERE source = 'src0') AS deleted
FROM documents WHERE source <> 'src0'"""
replace_repo = f"""
SELECT doc_id + 1 AS id, {_STORED} FROM documents WHERE source NOT IN ('src1', 'src2')
UNION ALL
SELECT {_N} + row_number() OVER (ORDER BY doc_id), source, sha256('v2 ' || text)
FROM documents WHERE source IN ('src1', 'src2')"""
append_repo = f"""
SELECT doc_id + 1 AS id, {_STORED} FROM documents
UNION ALL
SELECT {_N} + row_number() OVER (ORDER BY doc_id), source, sha256(text)
FROM documents WHERE source IN ('src1', 'src2')"""
