"""Sample records: tables in the shape of files, reviews, replies, events and calls, derived from the given tables.

Every record is computed from one row of ``documents``, ``pages``, ``orders``, ``events`` or ``customer`` by plain
projections, so the derivation itself never shuffles and grows with the tables.  The scalar expressions are SQL text that
reads the same in every ANSI dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusreview.functions.arrays import computed_once
from corpusreview.operators import selection
from corpusreview.plans.templates import LINES, PY_BLOCKS

# ---- scalar expressions ----------------------------------------------------------------------------------------------
DOC_PATH = (
    "CASE doc_id % 11 WHEN 0 THEN 'src' WHEN 1 THEN 'lib' WHEN 2 THEN 'node_modules/a' WHEN 3 THEN '.git' "
    "WHEN 4 THEN 'build' WHEN 5 THEN 'dist/x' WHEN 6 THEN 'venv' WHEN 7 THEN '__pycache__' WHEN 8 THEN 'pkg' "
    "WHEN 9 THEN '_pkg' ELSE '.hidden' END || '/' || CAST(doc_id AS STRING) || "
    "CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.jsx' WHEN 4 THEN '.tsx' "
    "WHEN 5 THEN '.java' WHEN 6 THEN '.md' WHEN 7 THEN '.PY' ELSE '' END"
)
PAGE_REPO = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
PAGE_PATH = "'web/' || CAST(page_id AS STRING) || '.js'"
CODE_REPO = "'c' || CAST(o_custkey AS STRING)"
CODE_PATH = (
    "'gen/' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' "
    "WHEN 3 THEN '.ts' WHEN 4 THEN '.jsx' WHEN 5 THEN '.tsx' ELSE '.py' END"
)
REPEATS = "CASE WHEN o_orderkey % 997 = 0 THEN 400 WHEN o_orderkey % 31 = 0 THEN 20 ELSE 1 END"
BLOCKS = "1 + o_orderkey % 6"
BLOCK_NO = f"(o_orderkey * 3 + j % ({BLOCKS})) % {len(PY_BLOCKS)}"
LINE_COUNT = "5 + o_orderkey % 23"
LINE_NO = f"(o_orderkey * 7 + j * 11) % {len(LINES)}"
NUMBER = "CAST(o_orderkey + j AS STRING)"

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
REVIEW_PATH = (
    "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'src/f' || CAST(o_orderkey % 12 AS STRING) || '.py' END"
)
REVIEW_LANGUAGE = (
    "CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' ELSE 'java' END"
)
REVIEW_SCORE = f"CAST({CENTS} % 1001 AS DOUBLE) / 10"
REVIEW_SUMMARY = (
    "'Review of order ' || CAST(o_orderkey AS STRING) || ', ' || o_orderpriority || '. ' "
    "|| repeat('Long text. ', CAST(o_orderkey % 12 AS INT))"
)
ISSUE_COUNT = "(o_orderkey * 7 + o_custkey) % 9"
SEVERITY = (
    "CASE (o_orderkey + 3 * i) % 10 WHEN 0 THEN 'critical' WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' "
    "WHEN 3 THEN 'warning' WHEN 4 THEN 'warning' WHEN 9 THEN 'suggestion' ELSE 'info' END"
)
CATEGORY = (
    "CASE (o_orderkey + 5 * i) % 13 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'best-practice' "
    "WHEN 3 THEN 'code-quality' WHEN 4 THEN 'error-handling' WHEN 5 THEN 'documentation' WHEN 6 THEN 'maintainability' "
    "WHEN 7 THEN 'accessibility' WHEN 8 THEN 'testing' WHEN 9 THEN 'style' WHEN 10 THEN 'bug' WHEN 11 THEN 'naming' "
    "ELSE '' END"
)
ISSUE_PATH = (
    f"CASE (o_orderkey + i) % 9 WHEN 0 THEN '' WHEN 1 THEN 'lib/other.js' ELSE {REVIEW_PATH} END"
)
ISSUE_LINE = "CASE WHEN (o_orderkey + i) % 7 = 0 THEN NULL ELSE CAST((o_orderkey * 3 + i) % 400 AS BIGINT) END"
DESCRIPTION = (
    "'Issue ' || CAST(i AS STRING) || ' of order ' || CAST(o_orderkey AS STRING) || CASE (o_orderkey + i) % 5 "
    "WHEN 0 THEN ': 100%_done' WHEN 1 THEN ': Needs Review' ELSE '' END"
)
SUGGESTION = "'Change part ' || CAST(i AS STRING)"

# replies: V picks the kind of reply
V = "o_orderkey % 16"
REPLY_SCORE = (
    f"CAST(CAST(floor(({CENTS} % 1001) / 10) AS BIGINT) AS STRING) || '.' || CAST(({CENTS} % 1001) % 10 AS STRING)"
)
REPLY_ISSUE = (
    f"CASE WHEN {V} = 15 THEN '{{\"description\": \"only text ' || CAST(i AS STRING) || '\"}}' ELSE "
    f"'{{\"severity\": \"' || CASE WHEN {V} = 3 AND i = 2 THEN 'blocker' WHEN {SEVERITY} = 'suggestion' THEN 'info' "
    f"ELSE {SEVERITY} END || '\", \"category\": ' || CASE WHEN {V} = 7 THEN 'null' ELSE '\"' || {CATEGORY} || '\"' END "
    f"|| ', \"file_path\": \"' || {ISSUE_PATH} || '\", \"line_number\": ' || CASE WHEN {V} = 5 THEN '\"12\"' "
    f"WHEN {V} = 8 THEN '12.5' WHEN {V} = 9 THEN '12.0' ELSE coalesce(CAST({ISSUE_LINE} AS STRING), 'null') END "
    f"|| ', \"description\": \"' || {DESCRIPTION} || '\", \"suggestion\": \"' || {SUGGESTION} "
    f"|| '\", \"code_snippet\": ' || CASE WHEN i % 2 = 0 THEN 'null' ELSE '\"x = [1]\"' END || '}}' END"
)
REPLY_BODY = (
    f"'{{\"file_path\": \"given\", \"language\": \"given\", ' || CASE {V} WHEN 10 THEN '' WHEN 11 THEN '\"issues\": null, ' "
    f"ELSE '\"issues\": [' || reply_issues || '], ' END || '\"score\": ' || CASE {V} WHEN 4 THEN '101' "
    f"WHEN 5 THEN '\"' || {REPLY_SCORE} || '\"' ELSE {REPLY_SCORE} END || CASE WHEN {V} = 6 THEN '' ELSE "
    f"', \"summary\": \"Order ' || CAST(o_orderkey AS STRING) || '\"' END || '}}'"
)
REPLY = (
    f"CASE {V} WHEN 1 THEN 'Here are the issues:' || chr(10) || '[' || reply_issues || ']' || chr(10) || 'Done.' "
    f"WHEN 2 THEN left({REPLY_BODY}, CAST(length({REPLY_BODY}) - 4 AS INT)) WHEN 12 THEN '[' || reply_issues || ']' "
    f"WHEN 13 THEN '' WHEN 14 THEN {REPLY_BODY} || CASE o_custkey % 3 WHEN 0 THEN ' and more' "
    "WHEN 1 THEN ', 1] trailing' ELSE ',\"x\"]' END WHEN 15 THEN 'Found [' || reply_issues || ']' "
    f"ELSE {REPLY_BODY} END"
)

# events
EVENT = (
    "CASE WHEN event_id % 500 = 0 THEN 'error' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'clone_start' "
    "WHEN event_type = 'signup' THEN 'clone_complete' WHEN event_type = 'view' THEN 'file_start' "
    "WHEN event_type = 'click' THEN 'file_complete' WHEN event_type = 'error' THEN 'file_skip' "
    "WHEN event_id % 40 = 0 THEN 'analysis_complete' WHEN event_id % 4 = 1 THEN 'heartbeat' ELSE 'file_start' END"
)
EVENT_FILE = "'src/f' || CAST(event_id % 30 AS STRING) || '.py'"
EVENT_ISSUE = (
    "'{\"severity\": \"' || CASE (event_id + i) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' "
    "ELSE 'suggestion' END || '\", \"category\": \"bug\", \"description\": \"d' || CAST(i AS STRING) || '\"}'"
)
EVENT_ISSUE_COUNT = "event_id % 4"
EVENT_DATA = (
    "CASE event WHEN 'clone_start' THEN '{\"repo_url\": \"https://example.org/r' || CAST(user_id AS STRING) || '\", \"branch\": null}' "
    "WHEN 'clone_complete' THEN CASE WHEN event_id % 7 = 0 THEN '{}' ELSE '{\"files\": ' || CAST(event_id % 60 AS STRING) "
    "|| ', \"total_files\": ' || CAST(event_id % 60 + 5 AS STRING) || '}' END "
    "WHEN 'file_start' THEN CASE WHEN event_id % 11 = 0 THEN '{\"language\": \"x\"}' ELSE '{\"file\": \"' || "
    + EVENT_FILE
    + " || '\", \"language\": \"python\"}' END "
    "WHEN 'file_skip' THEN CASE WHEN event_id % 13 = 0 THEN '{}' ELSE '{\"file\": \"' || "
    + EVENT_FILE
    + " || '\", \"reason\": \"File too large or unreadable\"}' END "
    "WHEN 'file_complete' THEN CASE WHEN event_id % 17 = 0 THEN '{\"review\": null}' ELSE '{\"review\": {\"file_path\": \"' || "
    + EVENT_FILE
    + " || '\", \"language\": \"python\"' || CASE WHEN event_id % 23 = 0 THEN '' ELSE ', \"score\": ' || "
    "CAST(event_id % 101 AS STRING) || '.5' END || CASE WHEN event_id % 19 = 0 THEN '' ELSE ', \"issues\": [' || event_issues "
    "|| ']' END || ', \"summary\": \"s\"}}' END "
    "WHEN 'analysis_complete' THEN '{\"report\": {\"total_files\": 9, \"files_analyzed\": 8, \"overall_score\": 71.5}}' "
    "WHEN 'error' THEN '{\"message\": \"boom\"}' ELSE '{}' END"
)
EVENT_RECORD = (
    "CASE WHEN event_id % 400 = 7 THEN 'data: [DONE]' WHEN event_id % 12 = 0 THEN 'data: ' || data "
    "WHEN event_id % 12 = 1 THEN ' event:  ' || event || '  ' || chr(10) || '  data:' || data || ' ' "
    "WHEN event_id % 12 = 2 THEN 'event: old' || chr(10) || 'event: ' || event || chr(10) || 'data: {\"old\": 1}' || chr(10) "
    "|| 'data: ' || data WHEN event_id % 12 = 3 THEN 'event: ' || event || chr(10) || 'data: {broken' "
    "WHEN event_id % 12 = 4 THEN 'event: ' || event || chr(10) || 'data: ' || data || chr(10) || 'data: {broken' "
    "WHEN event_id % 12 = 5 THEN 'event: ' || event || chr(10) || 'data: null' WHEN event_id % 12 = 6 THEN ': ping' "
    "ELSE 'event: ' || event || chr(10) || 'id: 7' || chr(10) || 'data: ' || data END"
)

# documentation replies and addresses
DOC_TEXT = (
    "'# Title ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || '## Body' || chr(10) || text || chr(10) || '```python' "
    "|| chr(10) || 'print(' || CAST(doc_id AS STRING) || ')' || chr(10) || '# not a title' || chr(10) || '```' || chr(10) "
    "|| '- item' || chr(10) || '* item 2' || chr(10) || '### Part' || chr(10) || '#### deep' || CASE WHEN doc_id % 3 = 0 "
    "THEN chr(10) || '``` js ' || chr(10) || 'lost' ELSE '' END"
)
REPO_URL = (
    "CASE c_custkey % 12 WHEN 0 THEN 'https://github.com/owner' || CAST(c_custkey AS STRING) || '/' || lower(c_mktsegment) "
    "WHEN 1 THEN 'https://github.com/o/r' || CAST(c_custkey AS STRING) || '.git' WHEN 2 THEN 'https://github.com/o/r/' "
    "WHEN 3 THEN 'https://github.com/single' WHEN 4 THEN 'http://www.github.com/a/b' WHEN 5 THEN '' "
    "WHEN 6 THEN 'not a url' WHEN 7 THEN 'https://GitHub.com/A/b/tree/main?x=1#top' WHEN 8 THEN 'github.com/a/b' "
    "WHEN 9 THEN 'https://user@github.com:443//a//b' WHEN 10 THEN ' https://github.com/a/b ' "
    "ELSE 'https://github.com.example.org/a/b' END"
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# ---- files -----------------------------------------------------------------------------------------------------------
def doc_rows(documents: DataFrame) -> DataFrame:
    """Files of a ``documents`` table or stream."""
    return documents.selectExpr(
        "source AS repo", f"{DOC_PATH} AS path", "CAST(octet_length(text) AS BIGINT) AS size", "text AS content"
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_rows(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Files of a ``pages`` table or stream."""
    return pages.selectExpr(
        f"{PAGE_REPO} AS repo", f"{PAGE_PATH} AS path", "CAST(octet_length(html) AS BIGINT) AS size", "html AS content"
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rows(table(spark, sf_dir, "pages"))


def rendered_orders(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    return rendered(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), once)


def rendered(orders: DataFrame, once: bool = False) -> DataFrame:
    """Keys of an ``orders`` table or stream with a rendered source text: Python blocks for one file in seven, template
    lines for the rest.

    ``once`` renders before any filter on the text's size, for queries that need the text anyway; without it a query on
    paths alone renders nothing.
    """
    blocks, lines = F.array(*[F.lit(b) for b in PY_BLOCKS]), F.array(*[F.lit(x) for x in LINES])
    picks = (
        orders.withColumn("_blocks", blocks)
        .withColumn("_lines", lines)
        .selectExpr(
            "o_orderkey",
            "o_custkey",
            f"""CASE WHEN o_orderkey % 7 = 0
                THEN array_join(transform(sequence(0, CAST({BLOCKS} AS INT) - 1),
                     j -> element_at(_blocks, CAST({BLOCK_NO} AS INT) + 1)), chr(10))
                ELSE array_join(transform(sequence(0, CAST({LINE_COUNT} AS INT) - 1),
                     j -> replace(element_at(_lines, CAST({LINE_NO} AS INT) + 1), '#N#', {NUMBER})), chr(10))
                END AS _body""",
            f"{REPEATS} AS _repeats",
        )
    )
    content = "CASE WHEN _repeats = 1 THEN _body ELSE repeat(_body || chr(10), _repeats) END AS content"
    if once:
        return computed_once(picks, ["o_orderkey", "o_custkey"], content=F.expr(content.removesuffix(" AS content")))
    return picks.selectExpr("o_orderkey", "o_custkey", content)


def code_rows(orders: DataFrame, once: bool = False) -> DataFrame:
    """Rendered files of an ``orders`` table or stream."""
    return rendered(orders, once).selectExpr(
        f"{CODE_REPO} AS repo", f"{CODE_PATH} AS path", "CAST(octet_length(content) AS BIGINT) AS size", "content"
    )


def code_files(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    return code_rows(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), once)


def source_files(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """``repo, path, size, content`` of the whole corpus."""
    given = doc_files(spark, sf_dir).unionByName(page_files(spark, sf_dir))
    return given.unionByName(code_files(spark, sf_dir, once))


def analysed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.analysed(source_files(spark, sf_dir, once=True))


# ---- reviews and replies ---------------------------------------------------------------------------------------------
def _issue_range(count: str, upper: int) -> str:
    return f"filter(sequence(0, {upper}), i -> i < {count})"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, seq, file_path, language, score, summary, issues`` - one review per order."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return orders.selectExpr(
        "o_custkey AS run_id",
        "o_orderkey AS seq",
        f"{REVIEW_PATH} AS file_path",
        f"{REVIEW_LANGUAGE} AS language",
        f"{REVIEW_SCORE} AS score",
        f"{REVIEW_SUMMARY} AS summary",
        f"""transform({_issue_range(ISSUE_COUNT, 8)}, i -> named_struct('severity', {SEVERITY}, 'category', {CATEGORY},
            'file_path', {ISSUE_PATH}, 'line_number', {ISSUE_LINE}, 'description', {DESCRIPTION},
            'suggestion', {SUGGESTION})) AS issues""",
    )


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, path, language, size`` of every file found: one per order, and a read-me per customer."""
    files = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS run_id",
        f"{CODE_PATH} AS path",
        f"CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE {REVIEW_LANGUAGE} END AS language",
        f"{CENTS} % 60000 AS size",
    )
    readme = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS run_id", "'README.md' AS path", "'unknown' AS language", "CAST(10 AS BIGINT) AS size"
    )
    return files.unionByName(readme)


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, seq, file_path, language, raw`` - one reply per order, in sixteen well- and ill-formed kinds."""
    joined = f"array_join(transform({_issue_range(ISSUE_COUNT, 8)}, i -> {REPLY_ISSUE}), ', ') AS reply_issues"
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return (
        orders.selectExpr("*", joined)
        .selectExpr(
            "o_custkey AS run_id", "o_orderkey AS seq", f"{CODE_PATH} AS file_path", f"{REVIEW_LANGUAGE} AS language",
            f"{REPLY} AS raw",
        )
    )


def doc_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, raw`` - documentation replies, some without the key, some not JSON."""
    return (
        table(spark, sf_dir, "documents", "doc_id", "source", "text")
        .selectExpr("doc_id", "source AS repo", f"{DOC_PATH} AS path", "text", f"{DOC_TEXT} AS documentation")
        .selectExpr(
            "repo",
            "path",
            """CASE doc_id % 8 WHEN 3 THEN '{"doc": "other ' || CAST(doc_id AS STRING) || '"}' WHEN 4 THEN text
               WHEN 5 THEN '{"documentation": null}' ELSE to_json(named_struct('documentation', documentation))
               END AS raw""",
        )
    )


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").selectExpr(
        f"{DOC_PATH} AS path", f"{DOC_TEXT} AS doc"
    )


# ---- events, calls, addresses ----------------------------------------------------------------------------------------
def events_from(events: DataFrame) -> DataFrame:
    """Review events of an ``events`` table or stream."""
    joined = f"array_join(transform({_issue_range(EVENT_ISSUE_COUNT, 3)}, i -> {EVENT_ISSUE}), ', ') AS event_issues"
    return (
        events.selectExpr("event_id", "user_id", "ts", f"{EVENT} AS event", joined)
        .selectExpr("user_id AS run_id", "event_id AS seq", "ts", "event", f"{EVENT_DATA} AS data")
    )


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, seq, ts, event, data``."""
    return events_from(table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records of event logs: ``run_id, seq, record``."""
    events = review_events(spark, sf_dir).withColumnRenamed("seq", "event_id")
    return events.selectExpr("run_id", "event_id AS seq", f"{EVENT_RECORD} AS record")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool call per rendered file."""
    k = "o_orderkey"
    return rendered_orders(spark, sf_dir).selectExpr(
        f"{k} AS call_id",
        f"""CASE {k} % 5 WHEN 0 THEN 'analyze_code_quality' WHEN 1 THEN 'detect_security_vulnerability'
            WHEN 2 THEN 'generate_docstring' WHEN 3 THEN 'suggest_refactoring' ELSE 'other_tool' END AS tool""",
        f"CASE WHEN {k} % 101 = 0 THEN NULL ELSE content END AS code",
        f"CASE WHEN {k} % 8 = 0 THEN NULL ELSE 'python' END AS language",
        f"CASE WHEN {k} % 9 = 0 THEN NULL ELSE {CODE_PATH} END AS file_path",
        f"""CASE {k} % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'module' WHEN 3 THEN 'method'
            ELSE NULL END AS element_type""",
        f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE CAST({k} % 9 AS INT) END AS complexity_score",
    )


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, url``: page addresses and repository-shaped addresses."""
    pages = table(spark, sf_dir, "pages").selectExpr("'p' || CAST(page_id AS STRING) AS id", "url")
    customers = table(spark, sf_dir, "customer").selectExpr("'c' || CAST(c_custkey AS STRING) AS id", f"{REPO_URL} AS url")
    return pages.unionByName(customers)


def item_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, item, at``: what users touched, from the events' properties."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id", "CAST(get_json_object(props, '$.k') AS STRING) AS item", "event_id AS at"
    )
