"""The named queries as SQL on the given tables, written independently of the DataFrame operators.

Shared with the engine are only the scalar expressions that derive the sample records (``plans/records.py``), the
rendered templates and the fixed values.  Structure facts of the Python blocks below were worked out by hand.
"""

from __future__ import annotations

import re

from corpusreview import constants as K
from corpusreview.plans import records as R
from corpusreview.plans.catalog import SESSION_SILENCE
from corpusreview.plans.templates import LINES, PY_BLOCKS

ORACLES: dict[str, str] = {}
SILENCE = SESSION_SILENCE * 1_000_000


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# ---- facts about the Python blocks, by hand --------------------------------------------------------------------------
# block, order in block, level in the tree, name, first line, length, arguments, documented, complexity, nesting, async
FUNCTIONS = [
    (1, 0, 1, "classify", 1, 8, "value,limit", True, 5, 2, False),
    (2, 0, 1, "fetch", 1, 10, "session", False, 5, 2, True),
    (2, 1, 2, "inner", 5, 5, "x", False, 3, 2, False),
    (3, 0, 2, "area", 3, 7, "w", False, 3, 1, False),
    (3, 1, 2, "name", 11, 3, "self", True, 1, 0, False),
    (4, 0, 1, "route", 1, 12, "code", False, 10, 5, False),
    (5, 0, 1, "long_one", 1, 56, "", False, 1, 0, False),
    (7, 0, 2, "run", 2, 8, "self", False, 2, 0, False),
]
# block, name, line, methods, documented, bases
CLASSES = [
    (3, "Shape", 1, "area,name", True, "Name(id='Base', ctx=Load())"),
    (7, "Empty", 1, "run", False, ""),
]
IMPORTS = [(0, 0, "os"), (0, 1, "sys"), (0, 2, ".sibling"), (0, 3, "pkg.mod.thing")]
# block, import nodes, branch nodes (every If, loop, Try, handler, With, Assert and BoolOp)
NODES = [(0, 3, 0), (1, 0, 3), (2, 0, 4), (3, 0, 2), (4, 0, 5), (5, 0, 0), (6, 0, 1), (7, 0, 1)]


def values(rows) -> str:
    def one(v):
        return q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


# ---- the sample records ----------------------------------------------------------------------------------------------
RENDERED = f"""
blocks AS (SELECT {str_list(PY_BLOCKS)} AS bs, {str_list(LINES)} AS ls),
rendered AS (
  SELECT o_orderkey, o_custkey, CASE WHEN r = 1 THEN body ELSE repeat(body || chr(10), r) END AS content FROM (
    SELECT o_orderkey, o_custkey, {R.REPEATS} AS r,
      CASE WHEN o_orderkey % 7 = 0
        THEN array_to_string(list_transform(range(0, {R.BLOCKS}), lambda j: bs[{R.BLOCK_NO} + 1]), chr(10))
        ELSE array_to_string(list_transform(range(0, {R.LINE_COUNT}),
             lambda j: replace(ls[{R.LINE_NO} + 1], '#N#', {R.NUMBER})), chr(10)) END AS body
    FROM orders, blocks))"""

SRC = f"""{RENDERED},
src AS (
  SELECT source AS repo, {R.DOC_PATH} AS path, CAST(strlen(text) AS BIGINT) AS size, text AS content FROM documents
  UNION ALL SELECT {R.PAGE_REPO}, {R.PAGE_PATH}, CAST(strlen(html) AS BIGINT), html FROM pages
  UNION ALL SELECT {R.CODE_REPO}, {R.CODE_PATH}, CAST(strlen(content) AS BIGINT), content FROM rendered)"""

LANGUAGE_CASE = "CASE ext " + " ".join(f"WHEN {q(e)} THEN {q(x)}" for e, x in K.LANGUAGE_BY_EXTENSION.items())
HIDDEN = (
    "len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.') OR p IN "
    f"{in_list(K.VENDORED_PARTS)})) > 0"
)
FILES = f"""{SRC},
files AS (
  SELECT *, {LANGUAGE_CASE} ELSE 'unknown' END AS language, {HIDDEN} AS vendored FROM (
    SELECT *, lower(regexp_extract(list_extract(string_split(path, '/'), -1), '^.+(\\.[^.]+)$', 1)) AS ext FROM src)),
listed AS (SELECT * FROM files WHERE language <> 'unknown' AND NOT vendored),
kept AS (SELECT * FROM listed WHERE size <= 51200)"""

WITH_LINES = f"""{FILES},
lined AS (
  SELECT *, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lns
  FROM (SELECT *, string_split(content, chr(10)) AS parts FROM kept)),
lines AS (SELECT repo, path, language, unnest(range(1, len(lns) + 1)) AS line_no, unnest(lns) AS line FROM lined)"""

REVIEWS = f"""
rv AS (SELECT o_custkey AS run_id, o_orderkey AS seq, {R.REVIEW_PATH} AS file_path, {R.REVIEW_LANGUAGE} AS language,
  {R.REVIEW_SCORE} AS score, {R.REVIEW_SUMMARY} AS summary FROM orders),
iss AS (SELECT o_custkey AS run_id, o_orderkey AS seq, i + 1 AS issue_no,
  CASE WHEN {R.ISSUE_PATH} = '' THEN {R.REVIEW_PATH} ELSE {R.ISSUE_PATH} END AS file_path, {R.SEVERITY} AS severity,
  {R.CATEGORY} AS category, {R.ISSUE_LINE} AS line_number, {R.DESCRIPTION} AS description, {R.SUGGESTION} AS suggestion
  FROM (SELECT *, unnest(range(0, {R.ISSUE_COUNT})) AS i FROM orders)),
disc AS (SELECT o_custkey AS run_id, {R.CODE_PATH} AS path,
  CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE {R.REVIEW_LANGUAGE} END AS language, {R.CENTS} % 60000 AS size
  FROM orders UNION ALL SELECT c_custkey, 'README.md', 'unknown', 10 FROM customer)"""

REPLIES = f"""
rp AS (SELECT o_custkey AS run_id, o_orderkey AS seq, {R.CODE_PATH} AS file_path, {R.REVIEW_LANGUAGE} AS language,
  {R.REPLY} AS raw FROM (SELECT *, array_to_string(list_transform(range(0, {R.ISSUE_COUNT}), lambda i: {R.REPLY_ISSUE}), ', ')
  AS reply_issues FROM orders))"""

EVENTS = f"""
ev AS (SELECT user_id AS run_id, event_id AS seq, event, {R.EVENT_DATA} AS data FROM (
  SELECT event_id, user_id, {R.EVENT} AS event,
    array_to_string(list_transform(range(0, {R.EVENT_ISSUE_COUNT}), lambda i: {R.EVENT_ISSUE}), ', ') AS event_issues
  FROM events))"""


def half_even(tenths: str, n: str) -> str:
    """``tenths / n`` tenths, rounded half to even to whole tenths, in exact integer arithmetic."""
    a, b = f"CAST({tenths} AS HUGEINT)", f"CAST({n} AS HUGEINT)"
    up = f"CASE WHEN 2 * ({a} % {b}) > {b} OR (2 * ({a} % {b}) = {b} AND ({a} // {b}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST({a} // {b} + {up} AS DOUBLE) / 10"


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes.strip()}\n{select.strip()}" if ctes else select.strip()


# ---- selection -------------------------------------------------------------------------------------------------------
ORACLES["scan_source_tree"] = f"""
SELECT 'pages' AS repo, path, size, 'javascript' AS language,
  CASE WHEN size <= 51200 THEN md5(html) END AS content_md5,
  CASE WHEN size > 51200 THEN {q(K.SKIP_REASON)} END AS skip_reason
FROM (SELECT 'site' || CAST(page_id % 7 AS STRING) || '/_pkg/_' || CAST(page_id AS STRING) || '.js' AS path,
  CAST(strlen(replace(html, chr(10), chr(13) || chr(10))) AS BIGINT) AS size, html FROM pages WHERE page_id % 2 = 1)"""
oracle("filter_extension", FILES, "SELECT repo, path FROM files WHERE language <> 'unknown'")
oracle("filter_vendored", FILES, "SELECT repo, path FROM files WHERE NOT vendored")
oracle("size_guard", FILES, f"SELECT repo, path, size, CASE WHEN size > 51200 THEN {q(K.SKIP_REASON)} END AS skip_reason FROM files")
ORACLES["decode_text"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"
oracle("doc_file_names", SRC, """
SELECT repo, path, base, string_split(base, '.')[1] || '_docs.md' AS file_name, string_split(path, '.')[-1] AS ext
FROM (SELECT *, string_split(path, '/')[-1] AS base FROM src)""")
oracle("detect_language", FILES, "SELECT repo, path, language FROM files")
oracle("filter_languages", FILES, "SELECT repo, path, language FROM files WHERE language IN ('python', 'java', 'unknown')")
oracle("restrict_paths", SRC, f"SELECT repo, path FROM src WHERE path IN (SELECT {R.DOC_PATH} FROM labels)")
oracle("discovery_counts", REVIEWS, f"""
SELECT run_id, files, total_files, CASE WHEN files = 0 THEN {q(K.NO_FILES_MESSAGE)} END AS error FROM (
  SELECT run_id, count(*) FILTER (WHERE language IN ('python', 'java')) AS files, count(*) AS total_files
  FROM disc GROUP BY run_id)""")
oracle("file_sizes", SRC, """
SELECT repo, path, size, CASE WHEN size < 1024 THEN CAST(size AS STRING) || ' B'
  WHEN size < 1048576 THEN CAST(CAST(round_even(size / 1024, 1) AS DECIMAL(20, 1)) AS STRING) || ' KB'
  ELSE CAST(CAST(round_even(size / 1048576, 1) AS DECIMAL(20, 1)) AS STRING) || ' MB' END AS size_text
FROM (SELECT repo, path, unnest([size, size * 300]) AS size FROM src)""")
URLS = f"""
urls AS (SELECT 'p' || CAST(page_id AS STRING) AS id, url FROM pages
  UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), {R.REPO_URL} FROM customer),
split AS (SELECT id, url, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*:', ''),
  '^//[^/]*', '') AS path FROM urls)"""
oracle("repo_slugs", URLS, """
SELECT id, url, slug, slug IS NOT NULL AS is_repo FROM (
  SELECT id, url, CASE WHEN len(parts) >= 2 THEN parts[1] || '/' || parts[2] END AS slug FROM (
    SELECT id, url, string_split(regexp_replace(trim(path, '/'), '\\.git$', ''), '/') AS parts FROM split))""")
oracle("valid_repo_urls", URLS, """
SELECT id, url, trim(url) = '' OR (
  regexp_matches(trim(url), '^[a-zA-Z]+://([^/@]*@)?[Gg]it[Hh]ub\\.com(:[0-9]+)?(/|$)')
  AND len(list_filter(string_split(trim(path), '/'), lambda p: p <> '')) >= 2) AS is_valid FROM split""")

# ---- lines and text --------------------------------------------------------------------------------------------------
oracle("explode_lines", WITH_LINES, "SELECT repo, path, line_no, line FROM lines")
TRUNCATED = (
    "CASE WHEN len(lns) <= 200 THEN content ELSE array_to_string(lns[1:200], chr(10)) || chr(10) || chr(10) || '# ... [' "
    "|| CAST(len(lns) - 200 AS STRING) || ' more lines truncated] ...' || chr(10) END"
)
oracle("truncate_text", WITH_LINES, f"SELECT repo, path, {TRUNCATED} AS truncated FROM lined")
oracle("line_counts", WITH_LINES, """
SELECT repo, path, len(lns) AS lines_of_code, len(list_filter(lns, lambda x: regexp_matches(x, '\\S'))) AS non_blank_lines
FROM lined""")
oracle("text_samples", FILES, """
SELECT repo, path, left(content, 1000) AS doc_sample, left(content, 500) AS readme_sample, left(content, 50) AS match_sample,
  left(content, 80) || '…' AS summary_sample FROM kept""")
oracle("markdown_blocks", f"""
docs AS (SELECT doc_id, {R.DOC_PATH} AS path, string_split({R.DOC_TEXT}, chr(10)) AS parts FROM documents),
ln AS (SELECT doc_id, path, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line FROM docs),
fl AS (SELECT *, starts_with(line, '```') AS fence,
  sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM ln),
code AS (SELECT c.path, c.line_no, trim(substr(o.line, 4)) AS lang, o.doc_id, o.n FROM fl o JOIN fl c
  ON o.doc_id = c.doc_id AND o.fence AND c.fence AND o.n % 2 = 1 AND c.n = o.n + 1)""", """
SELECT path, line_no, 'code' AS kind, lang,
  coalesce((SELECT string_agg(line, chr(10) ORDER BY fl.line_no) FROM fl WHERE fl.doc_id = code.doc_id AND fl.n = code.n
            AND NOT fence), '') AS text FROM code
UNION ALL
SELECT path, line_no,
  CASE WHEN starts_with(line, '# ') THEN 'h1' WHEN starts_with(line, '## ') THEN 'h2' WHEN starts_with(line, '### ') THEN 'h3'
    WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN 'item' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END,
  '', CASE WHEN starts_with(line, '# ') THEN substr(line, 3) WHEN starts_with(line, '## ') THEN substr(line, 4)
    WHEN starts_with(line, '### ') THEN substr(line, 5) WHEN starts_with(line, '- ') OR starts_with(line, '* ')
    THEN substr(line, 3) WHEN trim(line) = '' THEN '' ELSE line END
FROM fl WHERE NOT fence AND n % 2 = 0""")

# ---- Python structure ------------------------------------------------------------------------------------------------
PYTHON = f"""{WITH_LINES},
fn(b, ord, level, name, rel, length, args, has_docstring, complexity, nesting, is_async) AS ({values(FUNCTIONS)}),
cl(b, name, rel, methods, has_docstring, bases) AS ({values(CLASSES)}),
im(b, ord, module) AS ({values(IMPORTS)}),
nd(b, imports, branches) AS ({values(NODES)}),
bl(b, n) AS ({values([(i, text.count(chr(10)) + 1) for i, text in enumerate(PY_BLOCKS)])}),
py AS (SELECT repo, path FROM kept WHERE language = 'python'),
placed AS (
  SELECT p.path, p.j, p.b,
    coalesce(sum(bl.n) OVER (PARTITION BY p.path ORDER BY p.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT {R.CODE_PATH} AS path, j, {R.BLOCK_NO} AS b FROM (
    SELECT *, unnest(range(0, ({R.BLOCKS}) * ({R.REPEATS}))) AS j FROM orders WHERE o_orderkey % 7 = 0)) p
  JOIN bl ON bl.b = p.b),
pyf AS (
  SELECT py.repo, py.path, fn.name, CAST(off + rel AS INTEGER) AS line, CAST(off + rel + length - 1 AS INTEGER) AS end_line,
    length, args, has_docstring, complexity, nesting, is_async, level, placed.j, fn.ord
  FROM py JOIN placed USING (path) JOIN fn ON fn.b = placed.b),
pym AS (
  SELECT repo, path, count(*) AS function_count, sum(complexity) AS total_complexity, max(nesting) AS max_nesting,
    {half_even("sum(length * 10)", "count(*)")} AS avg_function_length FROM pyf GROUP BY repo, path)"""
oracle("py_functions", PYTHON, """
SELECT repo, path, name, line, end_line, length, args, has_docstring, complexity, nesting, is_async FROM pyf""")
oracle("py_classes", PYTHON, """
SELECT py.repo, py.path, cl.name, CAST(off + rel AS INTEGER) AS line, methods, has_docstring, bases
FROM py JOIN placed USING (path) JOIN cl ON cl.b = placed.b""")
oracle("py_imports", PYTHON, """
SELECT py.repo, py.path, CAST(row_number() OVER (PARTITION BY py.repo, py.path ORDER BY placed.j, ord) AS INTEGER) AS seq, module
FROM py JOIN placed USING (path) JOIN im ON im.b = placed.b""")
oracle("py_nodes", PYTHON, """
SELECT py.repo, py.path,
  CAST(sum((SELECT count(*) FROM fn WHERE fn.b = placed.b)) AS BIGINT) AS function_nodes,
  CAST(sum((SELECT count(*) FROM cl WHERE cl.b = placed.b)) AS BIGINT) AS class_nodes,
  CAST(sum(nd.imports) AS BIGINT) AS import_nodes, CAST(sum(nd.branches) AS BIGINT) AS branch_nodes
FROM py JOIN placed USING (path) JOIN nd ON nd.b = placed.b GROUP BY py.repo, py.path
HAVING sum(nd.imports) + sum(nd.branches) + sum((SELECT count(*) FROM fn WHERE fn.b = placed.b))
  + sum((SELECT count(*) FROM cl WHERE cl.b = placed.b)) > 0""")
oracle("py_complexity", PYTHON, """
SELECT py.repo, py.path, CAST(coalesce(function_count, 0) AS INTEGER) AS function_count,
  CAST(coalesce(total_complexity, 0) AS INTEGER) AS total_complexity,
  coalesce(avg_function_length, CAST(0 AS DOUBLE)) AS avg_function_length
FROM py LEFT JOIN pym ON pym.repo = py.repo AND pym.path = py.path""")
oracle("py_nesting", PYTHON, """
SELECT py.repo, py.path, CAST(coalesce(max_nesting, 0) AS INTEGER) AS max_nesting
FROM py LEFT JOIN pym ON pym.repo = py.repo AND pym.path = py.path""")

# ---- JavaScript / TypeScript structure -------------------------------------------------------------------------------
# Accented letters become an ASCII letter first: word boundaries of the SQL engine's patterns know ASCII only.
FOLDED = "regexp_replace({}, '[À-ÖØ-öø-ÿĀ-ž]', 'x', 'g')"
JS_FUNCTION = (
    r"\b(?:function\s+([a-zA-Z0-9_$]+)\s*\()|\b(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*(?:async\s*)?\(.*?\)\s*=>"
    r"|\b([a-zA-Z0-9_$]+)\s*\((?:[^()]*|\([^()]*\))*\)\s*\{"
)
JS = f"""{WITH_LINES},
js AS (SELECT *, {FOLDED.format('content')} AS folded FROM kept WHERE language IN ('javascript', 'typescript')),
jsn AS (SELECT repo, path, unnest(range(0, len(g1))) AS i, unnest(g1) AS a, unnest(g2) AS b, unnest(g3) AS c FROM (
  SELECT repo, path, regexp_extract_all(folded, {q(JS_FUNCTION)}, 1) AS g1, regexp_extract_all(folded, {q(JS_FUNCTION)}, 2) AS g2,
    regexp_extract_all(folded, {q(JS_FUNCTION)}, 3) AS g3 FROM js)),
jsf AS (SELECT repo, path, i, name FROM (SELECT repo, path, i, coalesce(nullif(a, ''), nullif(b, ''), c) AS name FROM jsn)
  WHERE name NOT IN ('if', 'for', 'while', 'switch', 'catch')),
jsc AS (SELECT repo, path, unnest(range(1, len(m) + 1)) AS seq, unnest(m) AS name
  FROM (SELECT repo, path, regexp_extract_all(folded, '\\bclass\\s+([a-zA-Z0-9_$]+)', 1) AS m FROM js)),
jsi AS (SELECT repo, path, unnest(range(1, len(m) + 1)) AS seq, unnest(m) AS import_text
  FROM (SELECT repo, path, regexp_extract_all(content, '\\bimport\\s+.*?\\s+from\\b|\\brequire\\s*\\(') AS m FROM js)),
jsx AS (SELECT repo, path, 1 + len(regexp_extract_all(folded, '\\b(if|for|while|catch|switch|case)\\b|&&|\\|\\||\\?')) AS complexity FROM js)"""
oracle("js_functions", JS, """
SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY i) AS INTEGER) AS seq, name, 1 AS complexity FROM jsf""")
oracle("js_classes", JS, "SELECT repo, path, CAST(seq AS INTEGER) AS seq, name, false AS has_docstring FROM jsc")
oracle("js_imports", JS, "SELECT repo, path, CAST(seq AS INTEGER) AS seq, import_text FROM jsi")
oracle("js_complexity", JS, "SELECT repo, path, CAST(complexity AS INTEGER) AS complexity FROM jsx")

# ---- smells ----------------------------------------------------------------------------------------------------------
COMMENT = r"regexp_matches(line, '^\s*(#|//|/\*|\*)')"
JS_COMMENT = r"regexp_matches(line, '^\s*(//|/\*|\*)')"


def message(rule: str, *args: str) -> str:
    pieces = K.SMELL_TEXT[rule].replace("%d", "%s").split("%s")
    out = [q(pieces[0])]
    for arg, piece in zip(args, pieces[1:]):
        out += [f"CAST({arg} AS STRING)", q(piece)]
    return " || ".join(out)


# o1..o4 put the smells of a file into reporting order
SMELLS = f"""{PYTHON.replace("fn(b,", "fn(b,", 1)},
s_file AS (SELECT repo, path, 'long_file' AS rule, 1 AS line, 'warning' AS severity, {message('long_file', 'len(lns)')} AS description,
  0 AS o1, 0 AS o2, 0 AS o3, 0 AS o4 FROM lined WHERE len(lns) > 300),
s_number AS (SELECT repo, path, 'magic_number' AS rule, CAST(line_no AS INTEGER) AS line, 'info' AS severity,
  {message('magic_number', 'm')} AS description, 1 AS o1, line_no AS o2, i AS o3, 0 AS o4 FROM (
    SELECT repo, path, line_no, unnest(ms) AS m, unnest(range(0, len(ms))) AS i FROM (
      SELECT repo, path, line_no, regexp_extract_all(regexp_replace({FOLDED.format('line')}, '=\\s\\d+', '= ', 'g'),
        '(?:^|[^0-9A-Za-z_])(\\d{{2,}})\\b', 1) AS ms FROM lines WHERE NOT {COMMENT}))),
s_console AS (SELECT repo, path, 'console_log' AS rule, CAST(line_no AS INTEGER) AS line, 'info' AS severity,
  {q(K.SMELL_TEXT['console_log'])} AS description, 2 AS o1, line_no AS o2, 0 AS o3, 0 AS o4 FROM lines
  WHERE language IN ('javascript', 'typescript') AND contains(line, 'console.log') AND NOT {JS_COMMENT}),
s_var AS (SELECT repo, path, 'var_usage' AS rule, CAST(line_no AS INTEGER) AS line, 'warning' AS severity,
  {q(K.SMELL_TEXT['var_usage'])} AS description, 2 AS o1, line_no AS o2, 1 AS o3, 0 AS o4 FROM lines
  WHERE language IN ('javascript', 'typescript') AND regexp_matches({FOLDED.format('line')}, '\\bvar\\s+[a-zA-Z0-9_$]+') AND NOT {JS_COMMENT}),
s_long AS (SELECT repo, path, 'long_function' AS rule, line, 'warning' AS severity,
  {message('long_function', 'name', 'length')} AS description, 2 AS o1, level AS o2, line AS o3, 0 AS o4 FROM pyf WHERE length > 50),
s_doc AS (SELECT repo, path, 'missing_docstring' AS rule, line, 'info' AS severity,
  {message('missing_docstring', 'name')} AS description, 2 AS o1, level AS o2, line AS o3, 1 AS o4 FROM pyf WHERE NOT has_docstring),
s_deep AS (SELECT repo, path, 'deep_nesting' AS rule, line, 'warning' AS severity,
  {message('deep_nesting', 'name', 'nesting')} AS description, 2 AS o1, level AS o2, line AS o3, 2 AS o4 FROM pyf WHERE nesting > 4),
smells AS ({" UNION ALL ".join(f"SELECT * FROM {s}" for s in ("s_file", "s_number", "s_console", "s_var", "s_long", "s_doc", "s_deep"))})"""
for _name, _cte in (
    ("smell_long_file", "s_file"), ("smell_magic_number", "s_number"), ("smell_console_log", "s_console"),
    ("smell_var_usage", "s_var"), ("smell_long_function", "s_long"), ("smell_missing_docstring", "s_doc"),
    ("smell_deep_nesting", "s_deep"), ("all_smells", "smells"),
):
    oracle(_name, SMELLS, f"SELECT repo, path, rule, line, severity, description FROM {_cte}")
oracle("stream_smells", SMELLS, "SELECT repo, path, rule, line, severity, description FROM smells")
oracle("quality_long_line", WITH_LINES, """
SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS chars FROM lines WHERE length(line) > 120""")
oracle("quality_todo", WITH_LINES, """
SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS chars FROM lines
WHERE contains(line, 'TODO') OR contains(line, 'FIXME')""")


def quality_list(lines: str) -> str:
    """List of remarks of a list of lines."""
    return f"""list_filter(flatten(list_transform({lines}, lambda x, i: [
      CASE WHEN length(x) > 120 THEN 'Line ' || CAST(i AS STRING) || ' exceeds 120 characters (' || CAST(length(x) AS STRING) || ' chars).' END,
      CASE WHEN contains(x, 'TODO') OR contains(x, 'FIXME')
        THEN 'Line ' || CAST(i AS STRING) || ' contains developer comment placeholder (TODO/FIXME).' END])), lambda r: r IS NOT NULL)"""


DOC_MARK = "contains(content, '\"\"\"') OR contains(content, '''''''') OR contains(content, '/*')"
oracle("code_quality", WITH_LINES, f"""
SELECT repo, path, language, line_count, CASE WHEN len(found) = 0 THEN {q(K.NO_QUALITY_ISSUE)} ELSE array_to_string(found, chr(10)) END
  AS issues_detected, has_docstrings FROM (
  SELECT repo, path, language, CAST(len(lns) AS INTEGER) AS line_count, {quality_list('lns')} AS found, {DOC_MARK} AS has_docstrings FROM lined)""")

# ---- security --------------------------------------------------------------------------------------------------------
# the same patterns without Java's flags and without the look-ahead that only saves time
SQL_PATTERN = {
    name: re.sub(r"\(\?=\[[a-z]+\]\)", "", pattern).replace("(?iuUd)", "(?i)").replace("(?Ud)", "")
    for name, pattern in K.SECURITY_RULES
}


def located(files: str, keys: str) -> str:
    """Matches of all rules in ``files``: ``keys, type, o, i, line, match, description``."""
    parts = []
    for o, (rule, pattern) in enumerate(SQL_PATTERN.items()):
        parts.append(f"""
  SELECT {keys}, {q(rule)} AS type, {o} AS o, i,
    CAST(len(string_split(array_to_string(gaps[1:i], '') || array_to_string(ms[1:i - 1], ''), chr(10))) AS INTEGER) AS line,
    left(ms[i], 50) AS match, {q(K.VULNERABILITY_TEXT % rule.replace('_', ' '))} AS description
  FROM (SELECT {keys}, ms, string_split_regex(content, {q(pattern)}) AS gaps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT {keys}, content, regexp_extract_all(content, {q(pattern)}) AS ms FROM {files}) WHERE len(ms) > 0)""")
    return " UNION ALL ".join(parts)


SECURITY = f"""{FILES},
vul AS ({located('kept', 'repo, path')})"""
for _rule in SQL_PATTERN:
    oracle(f"sec_{_rule}", SECURITY, f"""
SELECT repo, path, CAST(i AS INTEGER) AS seq, type, line, match, description FROM vul WHERE type = {q(_rule)}""")
oracle("security_scan", SECURITY, """
SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY o, i) AS INTEGER) AS seq, type, line, match, description FROM vul""")
oracle("sec_locations", f"""{SRC},
prose AS (SELECT * FROM src WHERE path NOT LIKE 'gen/%'),
vul AS ({located('prose', 'repo, path')})""", """
SELECT repo, path, type, count(*) AS matches, min(line) AS first_line, max(line) AS last_line FROM vul GROUP BY repo, path, type""")

# ---- refactoring and docstrings --------------------------------------------------------------------------------------
LINES_OF = """(CASE WHEN ends_with({c}, chr(10)) OR {c} = '' THEN list_reverse(list_reverse(string_split({c}, chr(10)))[2:])
  ELSE string_split({c}, chr(10)) END)"""


def hint_list(lines: str, score: str) -> str:
    return f"""list_filter([CASE WHEN len({lines}) > 50 THEN {q(K.REFACTOR_LONG)} END, CASE WHEN {score} > 5 THEN {q(K.REFACTOR_COMPLEX)} END,
      CASE WHEN len(list_filter({lines}, lambda x: starts_with(x, '                '))) > 0 THEN {q(K.REFACTOR_DEEP)} END], lambda h: h IS NOT NULL)"""


def or_default(found: str, default: str) -> str:
    return f"CASE WHEN len({found}) = 0 THEN [{q(default)}] ELSE {found} END"


oracle("refactoring_hints", f"""{RENDERED},
r1 AS (SELECT o_orderkey, {LINES_OF.format(c='content')} AS lns FROM rendered),
r2 AS (SELECT o_orderkey, {hint_list('lns', '(o_orderkey % 9)')} AS found FROM r1),
r3 AS (SELECT o_orderkey, {or_default('found', K.REFACTOR_NONE)} AS hints FROM r2)""", """
SELECT o_orderkey, CAST(unnest(range(1, len(hints) + 1)) AS INTEGER) AS seq, unnest(hints) AS hint FROM r3""")
NAME_OF = r"coalesce(nullif(regexp_extract({c}, '\b(def|class|function)\s+([a-zA-Z0-9_$]+)', 2), ''), 'element')"
PARAMS_OF = (
    r"list_transform(list_filter(string_split(regexp_extract({c}, '\((.*?)\)', 1), ','), lambda p: trim(p) <> ''), "
    r"lambda p: trim(string_split(string_split(trim(p), ':')[1], '=')[1]))"
)
oracle("element_name", FILES, f"SELECT repo, path, {NAME_OF.format(c=FOLDED.format('content'))} AS name FROM kept")
oracle("element_params", FILES, f"SELECT repo, path, array_to_string({PARAMS_OF.format(c='content')}, '|') AS params FROM kept")
CALLS = f"""{RENDERED},
calls AS (SELECT o_orderkey AS call_id, CASE o_orderkey % 5 WHEN 0 THEN 'analyze_code_quality' WHEN 1 THEN 'detect_security_vulnerability'
    WHEN 2 THEN 'generate_docstring' WHEN 3 THEN 'suggest_refactoring' ELSE 'other_tool' END AS tool,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE content END AS code,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'python' END AS language,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {R.CODE_PATH} END AS file_path,
  CASE o_orderkey % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'module' WHEN 3 THEN 'method' END AS element_type,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 9 END AS score FROM rendered),
c1 AS (SELECT * REPLACE (coalesce(code, '') AS code), coalesce(code, '') AS content, {LINES_OF.format(c="coalesce(code, '')")} AS lns,
  {NAME_OF.format(c="coalesce(code, '')")} AS name, {PARAMS_OF.format(c="coalesce(code, '')")} AS params FROM calls)"""
ARGS = (
    "CASE WHEN coalesce(element_type, 'function') = 'function' AND len(params) > 0 THEN chr(10) || '    Args:' || chr(10) || "
    "array_to_string(list_transform(params, lambda p: '        ' || p || ': Description of ' || p || '.'), chr(10)) ELSE '' END"
)


def template(text: str, *args: str) -> str:
    pieces = text.split("%s")
    out = [q(pieces[0])]
    for arg, piece in zip(args, pieces[1:]):
        out += [arg, q(piece)]
    return " || ".join(out)


DOCSTRING = (
    f"CASE element_type WHEN 'class' THEN {template(K.DOCSTRING_CLASS, 'name')} WHEN 'module' THEN "
    f"{template(K.DOCSTRING_MODULE, 'name')} ELSE {template(K.DOCSTRING_FUNCTION, 'name', ARGS)} END"
)
oracle("docstring_templates", CALLS, f"""
SELECT call_id, element_type, {DOCSTRING} AS docstring FROM c1 WHERE call_id IN (SELECT call_id FROM calls WHERE code IS NOT NULL)""")
oracle("run_tools", f"""{CALLS},
vul AS ({located('c1', 'call_id')}),
found AS (SELECT call_id, string_agg(type || '|' || CAST(line AS STRING) || '|' || match || '|' || description, chr(10) ORDER BY o, i) AS v
  FROM vul GROUP BY call_id),
c2 AS (SELECT *, {quality_list('lns')} AS remarks, {hint_list('lns', 'coalesce(score, 1)')} AS hints FROM c1)""", f"""
SELECT call_id, tool, 'executed' AS status,
  CASE WHEN tool = 'other_tool' THEN 'Unknown tool: other_tool' END AS error,
  CASE WHEN tool = 'generate_docstring' THEN {DOCSTRING} END AS docstring,
  CASE WHEN tool = 'detect_security_vulnerability' THEN 'Success' END AS scan_status,
  CASE WHEN tool = 'analyze_code_quality' THEN coalesce(file_path, 'unknown') END AS file_path,
  CASE WHEN tool = 'analyze_code_quality' THEN coalesce(language, 'unknown') END AS language,
  CASE WHEN tool = 'analyze_code_quality' THEN CAST(len(lns) AS INTEGER) END AS line_count,
  CASE WHEN tool = 'analyze_code_quality' THEN array_to_string({or_default('remarks', K.NO_QUALITY_ISSUE)}, chr(10)) END AS issues_detected,
  CASE WHEN tool = 'analyze_code_quality' THEN {DOC_MARK} END AS has_docstrings,
  CASE WHEN tool = 'detect_security_vulnerability' THEN coalesce(v, '') END AS vulnerabilities,
  CASE WHEN tool = 'detect_security_vulnerability' THEN {q(','.join(SQL_PATTERN))} END AS rules_scanned,
  CASE WHEN tool = 'suggest_refactoring' THEN array_to_string({or_default('hints', K.REFACTOR_NONE)}, chr(10)) END AS suggestions
FROM c2 LEFT JOIN found USING (call_id)""")

# ---- metrics and prompts ---------------------------------------------------------------------------------------------
METRICS = f"""{SMELLS},{JS[len(WITH_LINES) + 1:]},
sc AS (SELECT repo, path, count(*) AS n FROM smells GROUP BY repo, path),
jn AS (SELECT repo, path, count(*) AS n FROM jsf GROUP BY repo, path),
jc AS (SELECT repo, path, count(*) AS n FROM jsc GROUP BY repo, path),
ji AS (SELECT repo, path, count(*) AS n FROM jsi GROUP BY repo, path),
pc AS (SELECT path, count(*) AS n FROM placed JOIN cl ON cl.b = placed.b GROUP BY path),
pi AS (SELECT path, count(*) AS n FROM placed JOIN im ON im.b = placed.b GROUP BY path),
met AS (
  SELECT l.repo, l.path, l.language, l.content, l.lns, CAST(len(l.lns) AS INTEGER) AS lines_of_code,
    CAST(len(list_filter(l.lns, lambda x: regexp_matches(x, '\\S'))) AS INTEGER) AS non_blank_lines,
    CAST(coalesce(pym.function_count, jn.n, 0) AS INTEGER) AS function_count,
    CAST(coalesce(pc.n, jc.n, 0) AS INTEGER) AS class_count, CAST(coalesce(pi.n, ji.n, 0) AS INTEGER) AS import_count,
    coalesce(pym.avg_function_length, CAST(0 AS DOUBLE)) AS avg_function_length,
    CAST(coalesce(pym.total_complexity, jsx.complexity, 0) AS INTEGER) AS total_complexity,
    CAST(coalesce(sc.n, 0) AS INTEGER) AS smell_count
  FROM lined l
  LEFT JOIN pym ON pym.repo = l.repo AND pym.path = l.path
  LEFT JOIN pc ON pc.path = l.path AND l.language = 'python' LEFT JOIN pi ON pi.path = l.path AND l.language = 'python'
  LEFT JOIN jn ON jn.repo = l.repo AND jn.path = l.path LEFT JOIN jc ON jc.repo = l.repo AND jc.path = l.path
  LEFT JOIN ji ON ji.repo = l.repo AND ji.path = l.path LEFT JOIN jsx ON jsx.repo = l.repo AND jsx.path = l.path
  LEFT JOIN sc ON sc.repo = l.repo AND sc.path = l.path)"""
SCALARS = (
    "lines_of_code", "non_blank_lines", "function_count", "class_count", "import_count", "avg_function_length",
    "total_complexity",
)
oracle("file_metrics", METRICS, f"SELECT repo, path, language, {', '.join(SCALARS)}, smell_count FROM met")
NL = "chr(10)"
METRIC_LINES = f" || {NL} || ".join(f"'  - {m}: ' || CAST({m} AS STRING)" for m in SCALARS)
PROMPTS = f"""{METRICS},
st AS (SELECT repo, path, string_agg('  - [' || severity || '] L' || CAST(line AS STRING) || ': ' || description, chr(10)
  ORDER BY o1, o2, o3, o4) AS listed FROM smells GROUP BY repo, path),
rpr AS (SELECT met.repo, met.path, met.language, 'Review this ' || language || ' file and answer with one JSON review object.'
  || {NL} || {NL} || 'File: ' || met.path || {NL} || {NL} || 'Metrics of the whole file:' || {NL} || {METRIC_LINES}
  || {NL} || {NL} || 'Smells found by static rules:' || {NL} || coalesce(st.listed, '  (none detected)')
  || {NL} || {NL} || 'Code:' || {NL} || '```' || language || {NL} || {TRUNCATED} || {NL} || '```'
  || {NL} || {NL} || 'Judge readability, bugs, security, performance and conventions. Give a score from 0 to 100.' AS prompt
  FROM met LEFT JOIN st ON st.repo = met.repo AND st.path = met.path)"""
oracle("review_prompts", PROMPTS, "SELECT * FROM rpr")
oracle("infer_stub", PROMPTS, """
SELECT repo AS run_id, path AS file_path, language, CAST(length(prompt) % 101 AS DOUBLE) AS score,
  CAST(length(prompt) AS STRING) || ' characters' AS summary, false AS is_fallback FROM rpr""")
oracle("infer_ledger", FILES, """
SELECT repo, path, md5(prompt) || ' at 0.2' AS raw, CAST(NULL AS STRING) AS error,
  CASE WHEN ('0x' || left(md5(prompt), 8))::BIGINT % 7 = 0 THEN 'ValueError: quota' END AS first_error
FROM (SELECT repo, path, 'Judge: ' || left(content, 40) AS prompt FROM kept)""")
oracle("doc_prompts", WITH_LINES, f"""
SELECT repo, path, language, 'Write Markdown documentation for this ' || language || ' file: ' || path || {NL} || {NL}
  || 'Cover its purpose, every function and class with parameters and results, examples and caveats.' || {NL} || {NL}
  || '```' || language || {NL} || {TRUNCATED} || {NL} || '```' AS prompt FROM lined""")
oracle("readme_prompts", f"""{FILES},
tree AS (SELECT repo, string_agg('- ' || path || ' (' || language || ', ' || CAST(size AS STRING) || ' bytes)', chr(10) ORDER BY path) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM listed) WHERE n <= 50 GROUP BY repo),
samples AS (SELECT repo, string_agg('### ' || path || {NL} || '```' || {NL} || left(content, 500) || {NL} || '```', chr(10) ORDER BY path) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM kept) WHERE n <= 5 GROUP BY repo)""", f"""
SELECT repo, 'Write a README for a repository with these files:' || {NL} || {NL} || t || {NL} || {NL} || 'Starts of some files:'
  || {NL} || {NL} || coalesce(s, '') || {NL} || {NL}
  || 'Include title, features, installation, usage, structure, contributing and licence sections.' AS prompt
FROM tree LEFT JOIN samples USING (repo)""")
oracle("generate_docs", f"""{WITH_LINES},
req AS (SELECT DISTINCT {R.DOC_PATH} AS path FROM labels),
asked AS (SELECT repo, path, md5('Write Markdown documentation for this ' || language || ' file: ' || path || {NL} || {NL}
  || 'Cover its purpose, every function and class with parameters and results, examples and caveats.' || {NL} || {NL}
  || '```' || language || {NL} || {TRUNCATED} || {NL} || '```') AS h FROM lined WHERE path IN (FROM req)),
tree AS (SELECT repo, string_agg('- ' || path || ' (' || language || ', ' || CAST(size AS STRING) || ' bytes)', chr(10) ORDER BY path) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM listed WHERE path IN (FROM req)) WHERE n <= 50 GROUP BY repo),
samples AS (SELECT repo, string_agg('### ' || path || {NL} || '```' || {NL} || left(content, 500) || {NL} || '```', chr(10) ORDER BY path) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM kept WHERE path IN (FROM req)) WHERE n <= 5 GROUP BY repo),
readme AS (SELECT repo, md5('Write a README for a repository with these files:' || {NL} || {NL} || coalesce(t, '') || {NL} || {NL} || 'Starts of some files:'
  || {NL} || {NL} || coalesce(s, '') || {NL} || {NL}
  || 'Include title, features, installation, usage, structure, contributing and licence sections.') AS h
  FROM (SELECT DISTINCT repo FROM listed) LEFT JOIN tree USING (repo) LEFT JOIN samples USING (repo))""", f"""
SELECT repo, path, CASE left(h, 1) WHEN '0' THEN '_Documentation generation failed: ValueError: quota_'
  WHEN '1' THEN '_Documentation generation failed: no_reply_' ELSE 'doc ' || h END AS doc, CASE left(h, 1) WHEN '0' THEN 'ValueError: quota' END AS error FROM asked
UNION ALL SELECT repo, 'README.md', CASE left(h, 1) WHEN '0' THEN '# README' || {NL} || {NL} || '_Generation failed: ValueError: quota_' WHEN '1' THEN ''
  ELSE '# ' || h END, CASE left(h, 1) WHEN '0' THEN 'ValueError: quota' END FROM readme
UNION ALL SELECT r_name, NULL, NULL, '{K.NO_FILES_MESSAGE}' FROM region""")

# ---- replies ---------------------------------------------------------------------------------------------------------
TEXT_FIELDS = ("category", "file_path", "description", "suggestion")
WHOLE = "regexp_full_match(e ->> '$.line_number', '\\s*[+-]?[0-9]+(\\.0*)?\\s*')"


def issue_ok(defaults: bool) -> str:
    def text(name: str) -> str:
        given = f"coalesce(json_type(e, '$.{name}'), 'absent')"
        return f"{given} IN ('VARCHAR'{', ' + q('absent') if defaults else ''})"

    severity = "coalesce(e ->> '$.severity', 'info')" if defaults else "e ->> '$.severity'"
    checks = ["json_type(e) = 'OBJECT'", f"coalesce({severity} IN {in_list(K.SEVERITIES)}, false)", text("severity")]
    checks += [text(f) for f in TEXT_FIELDS]
    checks += [
        f"""CASE coalesce(json_type(e, '$.line_number'), 'NULL') WHEN 'NULL' THEN true WHEN 'UBIGINT' THEN true WHEN 'BIGINT' THEN true
        WHEN 'DOUBLE' THEN (e ->> '$.line_number')::DOUBLE = floor((e ->> '$.line_number')::DOUBLE) WHEN 'VARCHAR' THEN {WHOLE} ELSE false END""",
        "coalesce(json_type(e, '$.code_snippet'), 'NULL') IN ('NULL', 'VARCHAR')",
    ]
    return "(" + " AND ".join(checks) + ")"


LINE_OF = "CAST(CAST(e ->> '$.line_number' AS DOUBLE) AS BIGINT)"
PARSED = f"""{REPLIES},
dj AS (SELECT *, TRY_CAST(nullif(raw, '') AS JSON) AS d FROM rp),
el AS (SELECT run_id, seq, unnest(range(0, len(es))) AS n, unnest(es) AS e FROM (
  SELECT run_id, seq, CASE WHEN json_type(d, '$.issues') = 'ARRAY' THEN json_extract(d, '$.issues[*]') ELSE [] END AS es FROM dj)),
ok AS (SELECT run_id, seq, bool_and({issue_ok(False)}) AS good,
  string_agg(concat_ws('|', e ->> '$.severity', e ->> '$.category', e ->> '$.file_path', coalesce(CAST({LINE_OF} AS STRING), '-'),
    e ->> '$.description', e ->> '$.suggestion', coalesce(e ->> '$.code_snippet', '-')), chr(10) ORDER BY n) AS listed FROM el GROUP BY run_id, seq),
sc AS (SELECT *, CASE WHEN json_type(d, '$.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(d ->> '$.score' AS DOUBLE) END AS score FROM dj),
re AS (SELECT sc.run_id, sc.seq, file_path, language, d ->> '$.summary' AS summary, score, coalesce(listed, '') AS listed, CASE
  WHEN d IS NULL THEN 'invalid_json' WHEN json_type(d) <> 'OBJECT' THEN 'not_an_object'
  WHEN coalesce(json_type(d, '$.issues'), 'ARRAY') <> 'ARRAY' THEN 'issues_not_a_list' WHEN NOT coalesce(good, true) THEN 'invalid_issue'
  WHEN score IS NULL THEN 'score_not_a_number' WHEN NOT score BETWEEN 0 AND 100 THEN 'score_out_of_range'
  WHEN coalesce(json_type(d, '$.summary'), 'absent') <> 'VARCHAR' THEN 'summary_not_a_text' END AS reason
  FROM sc LEFT JOIN ok ON ok.run_id = sc.run_id AND ok.seq = sc.seq)"""
oracle("parse_reviews", PARSED, """
SELECT run_id, seq, file_path, language, CASE WHEN reason IS NULL THEN score ELSE CAST(50 AS DOUBLE) END AS score,
  CASE WHEN reason IS NULL THEN summary ELSE 'Analysis failed: ' || reason END AS summary,
  CASE WHEN reason IS NULL THEN listed ELSE '' END AS issues, reason IS NOT NULL AS is_fallback FROM re""")
oracle("invalid_reviews", PARSED, "SELECT run_id, seq, file_path, language, reason FROM re WHERE reason IS NOT NULL")
oracle("extract_issues", f"""{REPLIES},
aj AS (SELECT *, TRY_CAST(nullif(regexp_extract(raw, '(?s)\\[.*\\]'), '') AS JSON) AS a FROM rp),
el AS (SELECT run_id, seq, file_path AS path, unnest(range(1, len(es) + 1)) AS n, unnest(es) AS e FROM (
  SELECT *, CASE WHEN json_type(a) = 'ARRAY' THEN json_extract(a, '$[*]') ELSE [] END AS es FROM aj)),
good AS (SELECT run_id, seq FROM el GROUP BY run_id, seq HAVING bool_and({issue_ok(True)}))""", f"""
SELECT run_id, seq, CAST(n AS INTEGER) AS issue_no, coalesce(e ->> '$.severity', 'info') AS severity, coalesce(e ->> '$.category', 'general') AS category,
  coalesce(e ->> '$.file_path', path) AS file_path, {LINE_OF} AS line_number, coalesce(e ->> '$.description', '') AS description,
  coalesce(e ->> '$.suggestion', '') AS suggestion, e ->> '$.code_snippet' AS code_snippet
FROM el JOIN good USING (run_id, seq)""")
oracle("parse_docs", f"""
d AS (SELECT doc_id, source AS repo, {R.DOC_PATH} AS path, text, {R.DOC_TEXT} AS md FROM documents)""", """
SELECT repo, path, CASE doc_id % 8 WHEN 3 THEN 'missing_key' WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'not_a_text' ELSE 'ok' END AS status,
  CASE doc_id % 8 WHEN 3 THEN '{"doc": "other ' || CAST(doc_id AS STRING) || '"}' WHEN 4 THEN '_Documentation generation failed: invalid_json_'
    WHEN 5 THEN '_Documentation generation failed: not_a_text_' ELSE md END AS doc FROM d""")

oracle("published_docs", f"""
d AS (SELECT doc_id, source AS repo, {R.DOC_PATH} AS path, text, {R.DOC_TEXT} AS md FROM documents)""", """
SELECT repo, path, string_split(string_split(path, '/')[-1], '.')[1] || '_docs.md' AS file_name, status, md5(doc) AS doc_md5 FROM (SELECT repo, path, CASE doc_id % 8 WHEN 3 THEN 'missing_key' WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'not_a_text' ELSE 'ok' END AS status,
  CASE doc_id % 8 WHEN 3 THEN '{"doc": "other ' || CAST(doc_id AS STRING) || '"}' WHEN 4 THEN '_Documentation generation failed: invalid_json_'
    WHEN 5 THEN '_Documentation generation failed: not_a_text_' ELSE md END AS doc FROM d)""")

# ---- issues ----------------------------------------------------------------------------------------------------------
ISSUE_COLUMNS = "run_id, seq, CAST(issue_no AS INTEGER) AS issue_no, file_path, severity, category, line_number, description, suggestion"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'suggestion' THEN 3 ELSE 99 END"
oracle("flatten_issues", REVIEWS, f"SELECT {ISSUE_COLUMNS} FROM iss")
oracle("issues_by_severity", REVIEWS, f"SELECT {ISSUE_COLUMNS} FROM iss WHERE severity = 'critical'")
oracle("issues_by_category", REVIEWS, f"SELECT {ISSUE_COLUMNS} FROM iss WHERE category = 'best-practice'")
oracle("search_issues", REVIEWS, f"""
SELECT {ISSUE_COLUMNS} FROM iss WHERE contains(lower(description), ' 100%_done') OR contains(lower(file_path), ' 100%_done')
  OR contains(lower(category), ' 100%_done')""")
oracle("shown_counts", REVIEWS, """
SELECT run_id, coalesce(shown, 0) AS shown, coalesce(issues, 0) AS issues, files FROM
  (SELECT run_id, count(*) AS files FROM rv GROUP BY run_id) LEFT JOIN (SELECT run_id, count(*) AS issues,
    count(*) FILTER (WHERE severity = 'warning' AND contains(lower(description), 'needs')) AS shown FROM iss GROUP BY run_id) USING (run_id)""")
oracle("severity_dim", REVIEWS, f"""
SELECT run_id, seq, CAST(issue_no AS INTEGER) AS issue_no, severity, upper(left(severity, 1)) || substr(severity, 2) AS severity_label,
  {RANK} AS severity_rank, category, CASE WHEN category IN {in_list(K.CATEGORIES)} THEN category ELSE 'other' END AS known_category FROM iss""")
oracle("issues_sorted_severity", REVIEWS, f"""
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY {RANK}, seq, issue_no) AS position, severity, {RANK} AS severity_rank,
  seq, CAST(issue_no AS INTEGER) AS issue_no, file_path FROM iss""")
oracle("issues_sorted_file", REVIEWS, """
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(file_path, '') COLLATE icu_noaccent, seq, issue_no) AS position,
  file_path, seq, CAST(issue_no AS INTEGER) AS issue_no, severity FROM iss""")
oracle("issues_in_file", REVIEWS, f"""
SELECT run_id, fp AS file_path, row_number() OVER (PARTITION BY run_id, fp ORDER BY {RANK}, seq, issue_no) AS position, severity, seq,
  CAST(issue_no AS INTEGER) AS issue_no FROM (SELECT *, CASE WHEN file_path = '' THEN 'Unknown file' ELSE file_path END AS fp FROM iss)""")
oracle("issues_by_file", REVIEWS, f"""
SELECT g.run_id, g.file_path, issue_count, row_number() OVER (PARTITION BY g.run_id ORDER BY place) AS group_no, f.language, f.score, f.summary,
  CAST(issue_count AS STRING) || CASE WHEN issue_count = 1 THEN ' issue' ELSE ' issues' END AS issue_text
FROM (SELECT run_id, CASE WHEN file_path = '' THEN 'Unknown file' ELSE file_path END AS file_path, count(*) AS issue_count, min(({RANK}, seq, issue_no)) AS place
  FROM iss GROUP BY 1, 2) g
LEFT JOIN (SELECT * FROM rv QUALIFY row_number() OVER (PARTITION BY run_id, file_path ORDER BY seq) = 1) f
  ON f.run_id = g.run_id AND f.file_path = g.file_path""")
CATEGORY_ROWS = """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY total DESC, first_seq, first_no) AS rank FROM (
  SELECT run_id, CASE WHEN category = '' THEN 'other' ELSE category END AS category, count(*) FILTER (WHERE severity = 'critical') AS critical,
    count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total,
    min(seq) AS first_seq, arg_min(issue_no, (seq, issue_no)) AS first_no
  FROM iss GROUP BY ALL) QUALIFY rank <= 8"""
CATEGORY_ROWS = CATEGORY_ROWS.replace("CASE WHEN category = '' THEN 'other' ELSE category END AS category", "cat AS category").replace(
    "FROM iss", "FROM (SELECT *, CASE WHEN category = '' THEN 'other' ELSE category END AS cat FROM iss)"
).replace("GROUP BY ALL", "GROUP BY run_id, cat")
oracle("category_breakdown", REVIEWS, f"""
SELECT run_id, category, critical, warning, info, total, CAST(rank AS INTEGER) AS rank FROM ({CATEGORY_ROWS})""")
oracle("category_share", REVIEWS, f"""
SELECT run_id, CAST(rank AS INTEGER) AS rank, category, total, total / max(total) OVER (PARTITION BY run_id) * 100 AS share FROM ({CATEGORY_ROWS})""")
oracle("issue_categories", REVIEWS, """
SELECT DISTINCT run_id, category FROM iss WHERE category <> '' UNION ALL SELECT DISTINCT run_id, 'all' FROM iss""")
oracle("recent_items", "", """
SELECT user_id, item, last_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC) AS INTEGER) AS rank FROM (
  SELECT user_id, props ->> '$.k' AS item, max(event_id) AS last_at FROM events GROUP BY 1, 2) QUALIFY rank <= 5""")

# ---- reviews and reports ---------------------------------------------------------------------------------------------
COUNTED = f"""{REVIEWS},
ic AS (SELECT run_id, seq, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'warning') AS warning FROM iss GROUP BY run_id, seq),
rc AS (SELECT rv.*, coalesce(n, 0) AS n, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning,
  coalesce(n, 0) - coalesce(critical, 0) - coalesce(warning, 0) AS info,
  CASE WHEN critical > 0 THEN 1.5 WHEN n IS NULL THEN 0.8 ELSE 1.0 END AS w FROM rv LEFT JOIN ic USING (run_id, seq)),
sums AS (SELECT run_id, count(*) AS files_analyzed, CAST(sum(critical) AS BIGINT) AS critical_count, CAST(sum(warning) AS BIGINT) AS warning_count,
  CAST(sum(info) AS BIGINT) AS info_count, {half_even("sum(CAST(round(score * 10) AS BIGINT) * CAST(w * 10 AS BIGINT))", "sum(CAST(w * 10 AS BIGINT))")} AS overall_score FROM rc GROUP BY run_id),
total AS (SELECT run_id, count(*) AS total_files FROM disc GROUP BY run_id)"""
LABEL = "CASE WHEN {s} >= 90 THEN 'excellent' WHEN {s} >= 75 THEN 'good' WHEN {s} >= 50 THEN 'needs improvement' ELSE 'poor' END"
REPORT = f"""{COUNTED},
rep0 AS (SELECT run_id, total_files, coalesce(files_analyzed, 0) AS files_analyzed, coalesce(overall_score, CAST(100 AS DOUBLE)) AS overall_score,
  coalesce(critical_count, 0) AS critical_count, coalesce(warning_count, 0) AS warning_count, coalesce(info_count, 0) AS info_count
  FROM total LEFT JOIN sums USING (run_id)),
rep AS (SELECT *, {LABEL.format(s='overall_score')} AS quality_label FROM rep0)"""
SUMMARY = (
    "'Repository analysis complete. Reviewed ' || CAST(files_analyzed AS STRING) || ' file(s) with an overall quality score of ' "
    "|| CAST(overall_score AS STRING) || '/100 (' || quality_label || '). Found ' || CAST(critical_count AS STRING) || "
    "' critical issue(s), ' || CAST(warning_count AS STRING) || ' warning(s), and ' || CAST(info_count AS STRING) || ' informational note(s).'"
)
REPORT_COLUMNS = "total_files, files_analyzed, overall_score, critical_count, warning_count, info_count, quality_label"
oracle("severity_counts", COUNTED, "SELECT run_id, critical_count, warning_count, info_count FROM sums")
oracle("overall_score", REPORT, "SELECT run_id, overall_score FROM rep")
oracle("run_report", REPORT, f"SELECT run_id, {REPORT_COLUMNS}, {SUMMARY} AS summary FROM rep")
oracle("published_reports", REPORT, f"""
SELECT r.run_id, CASE WHEN c.c_custkey IS NOT NULL THEN 'https://example.org/r' || CAST(r.run_id AS STRING) END AS repo_url, total_files,
  files_analyzed, overall_score, quality_label, v.reviews, v.issues, v.last_path
FROM (SELECT run_id, {REPORT_COLUMNS} FROM rep) r LEFT JOIN customer c ON c.c_custkey = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS reviews, CAST(sum(n) AS BIGINT) AS issues, max(file_path) AS last_path
  FROM (SELECT rv.run_id, rv.seq, rv.file_path, count(iss.seq) AS n FROM rv LEFT JOIN iss ON iss.run_id = rv.run_id AND iss.seq = rv.seq GROUP BY ALL)
  GROUP BY run_id) v ON v.run_id = r.run_id""")
oracle("file_severity_counts", REVIEWS, f"""
SELECT rv.run_id, rv.seq, rv.file_path, severity, CAST(count(*) AS INTEGER) AS issues FROM rv JOIN iss USING (run_id, seq)
WHERE severity IN {in_list(K.SEVERITIES)} GROUP BY ALL""")
oracle("score_distribution", REVIEWS, """
SELECT run_id, CAST(band_no AS INTEGER) AS band_no, band, files, files / n * 100 AS share FROM (
  SELECT run_id, band_no, band, count(*) FILTER (WHERE score BETWEEN low AND high) AS files, count(*) AS n FROM rv,
    (VALUES (1, 'Excellent (90-100)', 90, 100), (2, 'Good (75-89)', 75, 89), (3, 'Fair (50-74)', 50, 74), (4, 'Poor (0-49)', 0, 49))
      t(band_no, band, low, high) GROUP BY run_id, band_no, band)""")
oracle("language_breakdown", REVIEWS, f"""
SELECT f.run_id, f.language, files, bytes, mean_score FROM
  (SELECT run_id, language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM disc GROUP BY ALL) f
  LEFT JOIN (SELECT run_id, language, {half_even("sum(CAST(round(score * 10) AS BIGINT))", "count(*)")} AS mean_score FROM rv GROUP BY ALL) s
  ON s.run_id = f.run_id AND s.language = f.language""")
oracle("worst_files", REVIEWS, """
SELECT run_id, seq, file_path, score, CASE WHEN summary <> '' THEN left(summary, 80) || '…' END AS summary_start,
  CAST(row_number() OVER (PARTITION BY run_id ORDER BY score, seq) AS INTEGER) AS rank FROM rv QUALIFY rank <= 5""")
CHIP = "CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'warn' ELSE 'bad' END"
oracle("live_feed", REVIEWS, f"""
SELECT run_id, seq, file_path, language, score, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS position, {CHIP} AS score_class FROM rv""")
DIAL = "CASE WHEN score >= 80 THEN '{0}xcellent' WHEN score >= 60 THEN '{1}ood' WHEN score >= 40 THEN '{2}air' ELSE '{3}oor' END"
oracle("score_classes", REVIEWS, f"""
SELECT run_id, seq, score, {DIAL.format(*'egfp')} AS dial_class, {CHIP} AS chip_class, {LABEL.format(s='score')} AS quality_label,
  CAST(floor(score + 0.5) AS BIGINT) AS shown_score, {DIAL.format(*'EGFP')} || ' Quality' AS dial_label FROM rv""")
REVIEW_ROWS = f"""{REPORT},
nested AS (SELECT o_custkey AS run_id, o_orderkey AS seq, {{'file_path': {R.REVIEW_PATH}, 'language': {R.REVIEW_LANGUAGE},
  'score': {R.REVIEW_SCORE}, 'summary': {R.REVIEW_SUMMARY}, 'issues': list_transform(range(0, {R.ISSUE_COUNT}), lambda i:
  {{'severity': {R.SEVERITY}, 'category': {R.CATEGORY}, 'file_path': {R.ISSUE_PATH}, 'line_number': {R.ISSUE_LINE},
    'description': {R.DESCRIPTION}, 'suggestion': {R.SUGGESTION}}})}} AS r FROM orders)"""
# JSON of a review without its null fields: only line numbers can be null
SPARSE = "regexp_replace(CAST(to_json(r) AS STRING), '\"line_number\":null,', '', 'g')"
oracle("report_json", REVIEW_ROWS, f"""
SELECT run_id, 'report' AS kind, CAST(-1 AS BIGINT) AS seq, CAST(to_json({{'run_id': run_id, 'total_files': total_files,
  'files_analyzed': files_analyzed, 'overall_score': overall_score, 'critical_count': critical_count, 'warning_count': warning_count,
  'info_count': info_count, 'quality_label': quality_label, 'summary': {SUMMARY}}}) AS STRING) AS body FROM rep
UNION ALL SELECT run_id, 'review', seq, {SPARSE} FROM nested""")
oracle("event_rows", f"""{REVIEW_ROWS},
dc AS (SELECT run_id, count(*) FILTER (WHERE language <> 'unknown') AS files, count(*) AS total_files FROM disc GROUP BY run_id),
gone AS (SELECT run_id FROM dc WHERE files = 0),
done AS (SELECT run_id, count(*) AS files_analyzed, CAST(sum(critical) AS BIGINT) AS critical_count, CAST(sum(warning) AS BIGINT) AS warning_count,
  CAST(sum(info) AS BIGINT) AS info_count, {half_even("sum(CAST(round(score * 10) AS BIGINT) * CAST(w * 10 AS BIGINT))", "sum(CAST(w * 10 AS BIGINT))")} AS overall_score
  FROM rc WHERE (seq * 37) % 60000 <= 51200 AND run_id NOT IN (FROM gone) GROUP BY run_id),
rs AS (SELECT *, files_analyzed AS total_files, {LABEL.format(s='overall_score')} AS quality_label FROM done)""", f"""
SELECT c_custkey AS run_id, 0 AS stage, CAST(0 AS BIGINT) AS seq, 'clone_start' AS event,
  '{{"repo_url":"https://example.org/r' || CAST(c_custkey AS STRING) || '","branch":null}}' AS data FROM customer
UNION ALL SELECT run_id, 1, 0, 'clone_complete', '{{"files":' || CAST(files AS STRING) || ',"total_files":' || CAST(total_files AS STRING)
  || ',"repo_url":"https://example.org/r' || CAST(run_id AS STRING) || '"}}' FROM dc
UNION ALL SELECT run_id, 2, 0, 'error', '{{"message":"{K.NO_FILES_MESSAGE}"}}' FROM dc WHERE files = 0
UNION ALL SELECT run_id, 3, seq, 'file_start', '{{"file":"' || file_path || '","language":"' || language || '"}}' FROM rv WHERE run_id NOT IN (FROM gone)
UNION ALL SELECT run_id, 3, seq, 'file_skip', '{{"file":"' || file_path || '","reason":"{K.SKIP_REASON}"}}' FROM rv WHERE (seq * 37) % 60000 > 51200 AND run_id NOT IN (FROM gone)
UNION ALL SELECT run_id, 3, seq, 'file_complete', '{{"review":' || CAST(to_json(r) AS STRING) || '}}' FROM nested WHERE (seq * 37) % 60000 <= 51200 AND run_id NOT IN (FROM gone)
UNION ALL SELECT run_id, 4, 0, 'analysis_complete', '{{"report":' || CAST(to_json({{'total_files': total_files,
  'files_analyzed': files_analyzed, 'overall_score': overall_score, 'critical_count': critical_count, 'warning_count': warning_count,
  'info_count': info_count, 'quality_label': quality_label, 'summary': {SUMMARY}}}) AS STRING) || '}}' FROM rs""")

# ---- events ----------------------------------------------------------------------------------------------------------
RECORDS = f"""{EVENTS},
rec AS (SELECT run_id, event_id AS seq, {R.EVENT_RECORD} AS record FROM (SELECT run_id, seq AS event_id, event, data FROM ev)),
ps AS (SELECT run_id, seq, list_transform(string_split(record, chr(10)), lambda x: trim(x)) AS ls FROM rec),
pe AS (SELECT run_id, seq, coalesce(list_transform(list_filter(ls, lambda x: starts_with(x, 'event:')), lambda x: trim(substr(x, 7)))[-1], 'message') AS event,
  list_transform(list_filter(ls, lambda x: starts_with(x, 'data:')), lambda x: trim(substr(x, 6))) AS ds FROM ps),
done AS (SELECT run_id, min(seq) AS end_at FROM pe WHERE list_contains(ds, '[DONE]') GROUP BY run_id),
log AS (SELECT pe.run_id, pe.seq, event, list_filter(ds, lambda x: json_valid(x))[-1] AS data FROM pe LEFT JOIN done USING (run_id)
  WHERE end_at IS NULL OR seq < end_at)"""
oracle("parse_event_log", RECORDS, "SELECT run_id, seq, event, data FROM log WHERE data IS NOT NULL AND data <> 'null'")
oracle("scan_event_log", RECORDS, """
SELECT run_id, event, count(*) AS events, CAST(sum(length(data)) AS BIGINT) AS chars FROM log
WHERE data IS NOT NULL AND data <> 'null' GROUP BY run_id, event""")
ORACLES["follow_event_log"] = ORACLES["scan_event_log"]
oracle("run_sessions", f"""
ev AS (SELECT user_id AS run_id, event_id AS seq, ts, {R.EVENT} AS event FROM events),
gaps AS (
  SELECT *, lag(ts) OVER w AS before, lag(event) OVER w AS event_before FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
starts AS (
  SELECT *, sum(CASE WHEN before IS NULL OR event_before IN ('analysis_complete', 'error') OR epoch_us(ts) - epoch_us(before) > {SILENCE} THEN 1 ELSE 0 END)
    OVER (PARTITION BY run_id ORDER BY ts, seq) AS session FROM gaps),
folded AS (
  SELECT run_id, session, min(ts) AS started, max(ts) AS last_at, count(*) AS events, count(*) FILTER (WHERE event = 'file_start') AS files,
    arg_max(CASE event WHEN 'clone_start' THEN 'cloning' WHEN 'clone_complete' THEN 'analyzing' WHEN 'analysis_complete' THEN 'complete' WHEN 'error' THEN 'error' END,
      (ts, seq)) FILTER (WHERE event IN ('clone_start', 'clone_complete', 'analysis_complete', 'error')) AS known,
    (SELECT max(ts) FROM ev) AS latest, max(session) OVER (PARTITION BY run_id) AS newest
  FROM starts GROUP BY run_id, session),
named AS (SELECT *, coalesce(known, 'cloning') AS state, session < newest OR (epoch_us(last_at) + {SILENCE}) // 1000 + 1 <= epoch_ms(latest) AS silent FROM folded)""", """
SELECT run_id, started, last_at, events, files, CASE WHEN state IN ('complete', 'error') THEN state WHEN silent THEN 'failed' ELSE state END AS state,
  state IN ('complete', 'error') OR silent AS closed FROM named""")
oracle("file_index", EVENTS, """
SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS file_index, coalesce(data ->> '$.file', '') AS file
FROM ev WHERE event = 'file_start'""")
oracle("run_progress", EVENTS, """
SELECT run_id, total, current, current_file, reviewed, issues,
  CASE WHEN total > 0 THEN CAST(floor(current / total * 100 + 0.5) AS BIGINT) ELSE 0 END AS percent,
  CASE last_event WHEN 'clone_complete' THEN 'Found ' || CAST(total AS STRING) || ' source files. Starting analysis...'
    WHEN 'file_start' THEN 'Analyzing file ' || CAST(starts AS STRING) || ' of ' || CAST(total AS STRING) || '...'
    WHEN 'file_skip' THEN 'Skipped ' || coalesce(last_data ->> '$.file', 'file') || ': ' || coalesce(last_data ->> '$.reason', 'too large')
    ELSE 'Cloning repository...' END AS phase
FROM (
  SELECT *, CASE WHEN reset_event = 'file_start' THEN starts ELSE 0 END AS current,
    CASE WHEN reset_event = 'file_start' THEN coalesce(reset_data ->> '$.file', '') ELSE '' END AS current_file FROM (
    SELECT run_id, count(*) FILTER (WHERE event = 'file_start') AS starts,
      coalesce(CAST(arg_max(coalesce(data ->> '$.files', '0'), seq) FILTER (WHERE event = 'clone_complete') AS BIGINT), 0) AS total,
      count(*) FILTER (WHERE event = 'file_complete' AND json_type(data, '$.review') = 'OBJECT') AS reviewed,
      CAST(coalesce(sum(json_array_length(data, '$.review.issues')) FILTER (WHERE event = 'file_complete'), 0) AS BIGINT) AS issues,
      arg_max(event, seq) FILTER (WHERE event IN ('file_start', 'clone_complete')) AS reset_event,
      arg_max(data, seq) FILTER (WHERE event IN ('file_start', 'clone_complete')) AS reset_data,
      arg_max(event, seq) FILTER (WHERE event IN ('file_start', 'clone_complete', 'clone_start', 'file_skip')) AS last_event,
      arg_max(data, seq) FILTER (WHERE event IN ('file_start', 'clone_complete', 'clone_start', 'file_skip')) AS last_data
    FROM ev GROUP BY run_id))""")
oracle("run_state", EVENTS, """
SELECT run_id, coalesce(last, 'cloning') AS open_state,
  CASE WHEN coalesce(last, 'cloning') IN ('cloning', 'analyzing') THEN 'complete' ELSE last END AS state FROM (
  SELECT run_id, arg_max(CASE event WHEN 'clone_start' THEN 'cloning' WHEN 'clone_complete' THEN 'analyzing' WHEN 'analysis_complete' THEN 'complete'
    ELSE 'error' END, seq) FILTER (WHERE event IN ('clone_start', 'clone_complete', 'analysis_complete', 'error')) AS last FROM ev GROUP BY run_id)""")
EVENT_ISSUES = f"""{EVENTS},
er AS (SELECT run_id, seq, coalesce(CAST(data ->> '$.review.score' AS DOUBLE), 0) AS score,
  coalesce(json_extract_string(data, '$.review.issues[*].severity'), []) AS sevs FROM ev
  WHERE event = 'file_complete' AND json_type(data, '$.review') = 'OBJECT')"""
oracle("stream_severity", EVENT_ISSUES, """
SELECT run_id, severity, count(*) AS issues FROM (SELECT run_id, unnest(sevs) AS severity FROM er) GROUP BY ALL""")
oracle("fallback_stats", EVENT_ISSUES, """
SELECT run_id, count(*) AS files_scanned, count(*) AS files_analyzed, CAST(floor(sum(CAST(score AS DECIMAL(18, 1))) / count(*) + 0.5) AS BIGINT) AS overall_score,
  CAST(sum(len(list_filter(sevs, lambda s: s = 'critical'))) AS BIGINT) AS critical_count,
  CAST(sum(len(list_filter(sevs, lambda s: s = 'warning'))) AS BIGINT) AS warning_count,
  CAST(sum(len(list_filter(sevs, lambda s: s = 'info'))) AS BIGINT) AS info_count,
  'Analyzed ' || CAST(count(*) AS STRING) || ' files.' AS summary
FROM er WHERE run_id NOT IN (SELECT run_id FROM ev WHERE event = 'analysis_complete') GROUP BY run_id""")

# ---- whole reviews ---------------------------------------------------------------------------------------------------
STATIC = f"""{SMELLS},
vul AS ({located('kept', 'repo, path')}),
found AS (SELECT repo, path, 'security' AS category, 'critical' AS severity FROM vul
  UNION ALL SELECT repo, path, 'code-quality', severity FROM smells),
fc AS (SELECT kept.repo, kept.path, count(severity) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info
  FROM kept LEFT JOIN found ON found.repo = kept.repo AND found.path = kept.path GROUP BY kept.repo, kept.path),
fs AS (SELECT *, greatest(0, 100 - 10 * critical - 3 * warning - info) AS score, CASE WHEN critical > 0 THEN 1.5 WHEN n = 0 THEN 0.8 ELSE 1.0 END AS w FROM fc),
ss AS (SELECT repo, count(*) AS files_analyzed, {half_even("sum(CAST(score AS BIGINT) * 10 * CAST(w * 10 AS BIGINT))", "sum(CAST(w * 10 AS BIGINT))")} AS overall_score, CAST(sum(critical) AS BIGINT) AS critical_count,
  CAST(sum(warning) AS BIGINT) AS warning_count, CAST(sum(info) AS BIGINT) AS info_count FROM fs GROUP BY repo),
s1 AS (SELECT l.repo AS run_id, total_files, coalesce(files_analyzed, 0) AS files_analyzed, coalesce(overall_score, CAST(100 AS DOUBLE)) AS overall_score,
  coalesce(critical_count, 0) AS critical_count, coalesce(warning_count, 0) AS warning_count, coalesce(info_count, 0) AS info_count
  FROM (SELECT repo, count(*) AS total_files FROM listed GROUP BY repo) l LEFT JOIN ss ON ss.repo = l.repo),
s2 AS (SELECT *, {LABEL.format(s='overall_score')} AS quality_label FROM s1)"""
oracle("static_report", STATIC, f"""SELECT run_id, {REPORT_COLUMNS}, {SUMMARY} AS summary, coalesce(files_skipped, 0) AS files_skipped
FROM s2 LEFT JOIN (SELECT repo, count(*) AS files_skipped FROM listed WHERE size > 51200 AND lower(language) IN ('python', 'javascript', 'typescript', 'java')
  GROUP BY repo) ON repo = run_id""")
oracle("static_categories", STATIC, """
SELECT repo AS run_id, category, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,
  count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM found GROUP BY repo, category""")
