"""Model replies: validation and flattening.

A reply is parsed once into a VARIANT and then checked field by field.  Checks follow lax reading of the declared types:
numbers may be given as text, whole floats are integers, text fields must be text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions.arrays import computed_once, numbered_rows

ISSUE = (
    "struct<severity:string,category:string,file_path:string,line_number:bigint,description:string,suggestion:string,"
    "code_snippet:string>"
)
ISSUE_FIELDS = ("severity", "category", "file_path", "line_number", "description", "suggestion", "code_snippet")
_INT_TEXT = r"^\s*[+-]?[0-9]+(?:\.0*)?\s*$"
_FLOAT_TEXT = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
_TEXT_FIELDS = ("category", "file_path", "description", "suggestion")
# what an issue gets when a key is absent from a free-text reply; a present null does not default
_DEFAULTS = {"severity": "info", "category": "general", "description": "", "suggestion": ""}


def strict_json(raw: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    The parser stops after the first value; the text is therefore read as the first of two array elements, the second of
    which is the text's own digest.  A text that closes the array itself cannot spell its digest.
    """
    mark = F.md5(raw)
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"'), mark, F.lit('"]'))), "$", "array<variant>")
    whole = lambda x: (F.size(x) == 2) & F.coalesce(F.try_variant_get(x[1], "$", "string") == mark, F.lit(False))
    return F.transform(F.array(both), lambda x: F.when(whole(x), x[0]))[0]


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is(v: Column, *kinds: str) -> Column:
    """The value is a ``STRING``, ``BIGINT``, ``DECIMAL``, ``DOUBLE``, ``BOOLEAN`` or ``VOID``; false if absent."""
    schema = F.schema_of_variant(v)
    plain = schema.isin([k for k in kinds if k != "DECIMAL"])
    return F.coalesce(plain | schema.startswith("DECIMAL") if "DECIMAL" in kinds else plain, F.lit(False))


def _is_object(v: Column) -> Column:
    # reading the top level is much cheaper than deriving the schema of everything below
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _text(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _absent_or_null(v: Column) -> Column:
    return v.isNull() | _is(v, "VOID")


def _number(v: Column) -> Column:
    """Double of a number, numeric text or boolean; NULL for anything else."""
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(_is(v, *_NUMBERS), F.try_variant_get(v, "$", "double"))
        .when(_is(v, "STRING") & text.rlike(_FLOAT_TEXT), F.trim(text).try_cast("double"))
        .when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("double"))
    )


def _integer(v: Column) -> Column:
    """Integer of a whole number, integer text or boolean; NULL for anything else."""
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(_is(v, "BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "bigint"))
        .when(_is(v, *_NUMBERS) & (number == F.floor(number)), F.try_variant_get(v, "$", "bigint"))
        .when(_is(v, "STRING") & text.rlike(_INT_TEXT), F.trim(text).try_cast("decimal(38,9)").try_cast("bigint"))
        .when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("bigint"))
    )


def _issues(elements: Column, defaults: dict[str, Column] | None = None) -> Column:
    """Issue structs of the elements of an array, NULL where an element is not a valid issue."""
    defaults = defaults or {}

    def parts(v: Column) -> Column:
        def text(name: str) -> Column:
            value = _field(v, name)
            given = _text(value)
            return (F.when(value.isNull(), defaults[name]).otherwise(given) if name in defaults else given).alias(name)

        line, snippet = _field(v, "line_number"), _field(v, "code_snippet")
        return F.struct(
            text("severity"),
            text("category"),
            text("file_path"),
            _integer(line).alias("line_number"),
            text("description"),
            text("suggestion"),
            _text(snippet).alias("code_snippet"),
            (~_absent_or_null(line)).alias("has_line"),
            (~_absent_or_null(snippet)).alias("has_snippet"),
            # without defaults a text field is only found in an object
            (_is_object(v) if defaults else F.lit(True)).alias("is_object"),
        )

    def checked(p: Column) -> Column:
        ok = p["is_object"] & p["severity"].isin(list(K.SEVERITIES))
        for name in _TEXT_FIELDS:
            ok = ok & p[name].isNotNull()
        ok = ok & (~p["has_line"] | p["line_number"].isNotNull()) & (~p["has_snippet"] | p["code_snippet"].isNotNull())
        issue = F.struct(*[p[f].alias(f) for f in ISSUE_FIELDS]).cast(ISSUE)
        return F.when(F.coalesce(ok, F.lit(False)), issue)

    return F.transform(F.transform(elements, parts), checked)


def _no_issues() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def with_checked_review(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``score, summary, issues`` as given and ``reason``: NULL, or why the reply is not a review."""
    root = F.col("_root")
    score, issues = F.col("score"), F.col("issues")
    parsed = (
        df.withColumn("_root", strict_json(F.col(raw)))
        .withColumn("_list", _field(root, "issues"))
        .withColumn("score", _number(_field(root, "score")))
        .withColumn("summary", _text(_field(root, "summary")))
        .withColumn(
            "issues",
            F.when(F.col("_list").isNull(), _no_issues()).otherwise(
                _issues(F.try_variant_get(F.col("_list"), "$", "array<variant>"))
            ),
        )
    )
    reason = (
        F.when(F.col(raw).isNull(), "no_reply")
        .when(root.isNull(), "invalid_json")
        .when(~_is_object(root), "not_an_object")
        .when(issues.isNull(), "issues_not_a_list")
        .when(F.exists(issues, lambda i: i.isNull()), "invalid_issue")
        .when(score.isNull(), "score_not_a_number")
        .when(~score.between(0, 100) | F.isnan(score), "score_out_of_range")
        .when(F.col("summary").isNull(), "summary_not_a_text")
    )
    checked = {"score": score, "summary": F.col("summary"), "issues": issues, "reason": reason}
    return computed_once(parsed, df.columns, **checked)


def parse_reviews(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One review per reply; path and language come from the request.

    Any violation replaces the whole review by a fallback of score 50 without issues, marked ``is_fallback``.
    """
    bad = F.col("reason").isNotNull()
    kept = [c for c in df.columns if c != raw]
    return with_checked_review(df, raw).select(
        *kept,
        F.when(bad, F.lit(K.FALLBACK_SCORE)).otherwise(F.col("score")).alias("score"),
        F.when(bad, F.concat(F.lit("Analysis failed: "), F.col("reason"))).otherwise(F.col("summary")).alias("summary"),
        F.when(bad, _no_issues()).otherwise(F.col("issues")).alias("issues"),
        bad.alias("is_fallback"),
    )


def invalid_reviews(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies that are not valid reviews, with the reason."""
    kept = [c for c in df.columns if c != raw]
    return with_checked_review(df, raw).filter(F.col("reason").isNotNull()).select(*kept, "reason")


def extract_issues(df: DataFrame, raw: str = "raw", path: str = "file_path", keys=None) -> DataFrame:
    """Issues of the JSON array inside free texts, first ``[`` to last ``]``; one invalid element voids the text."""
    keys = list(keys or [c for c in df.columns if c not in (raw, path)])
    defaults = {**{k: F.lit(v) for k, v in _DEFAULTS.items()}, "file_path": F.col(path)}
    array = strict_json(F.regexp_extract(F.col(raw), r"(?s)\[.*\]", 0))
    issues = F.col("_issues")
    found = df.withColumn("_array", array).withColumn(
        "_issues", _issues(F.try_variant_get(F.col("_array"), "$", "array<variant>"), defaults)
    )
    whole = F.when(~F.exists(issues, lambda i: i.isNull()), issues)
    return numbered_rows(found, keys, whole, "issue", "issue_no").select(*keys, "issue_no", "issue.*")


def flatten_issues(reviews: DataFrame, keys=("run_id", "seq")) -> DataFrame:
    """One row per issue; an issue without a path gets its review's path."""
    rows = numbered_rows(reviews.withColumnRenamed("file_path", "_path"), [*keys, "_path"], F.col("issues"), "issue", "issue_no")
    return rows.select(
        *keys,
        "issue_no",
        F.coalesce(F.nullif(F.col("issue.file_path"), F.lit("")), F.col("_path")).alias("file_path"),
        *[F.col(f"issue.{c}") for c in ("severity", "category", "line_number", "description", "suggestion")],
    )


def parse_docs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``doc``: the documentation text, the raw reply when the key is missing, a failure text for bad replies."""
    root = F.col("_root")
    value = _field(root, "documentation")
    failed = F.concat(F.lit("_Documentation generation failed: "), F.col("status"), F.lit("_"))
    return (
        df.withColumn("_root", strict_json(F.col(raw)))
        .withColumn(
            "status",
            F.when(F.col(raw).isNull(), "no_reply")
            .when(root.isNull(), "invalid_json")
            .when(~_is_object(root), "not_an_object")
            .when(value.isNull(), "missing_key")
            .when(~_is(value, "STRING"), "not_a_text")
            .otherwise("ok"),
        )
        .withColumn(
            "doc",
            F.when(F.col("status") == "ok", _text(value))
            .when(F.col("status") == "missing_key", F.col(raw))
            .otherwise(failed),
        )
        .drop("_root")
    )
