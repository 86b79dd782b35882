"""Security rules: matches on whole texts, located by line."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions.arrays import numbered_rows

VULNERABILITY = "struct<type:string,line:int,match:string,description:string>"


_MARK, _END = "\u0001", "\u0003"
#: A text with no more calls of this kind is searched for whole calls directly: a call without its end costs one look at the
#: rest of its line.
DIRECT_CALLS = 100


def match_lines(code: Column, pattern: str) -> Column:
    """1-based line of each match, in text order.

    Every match gets a mark in front, everything but marks and newlines is dropped, and the marks of line ``i`` are
    turned into that many ``i``: linear in the text, whatever the number of matches.  Marks that are already in the text
    become another control character first, which no rule tells apart.
    """
    clean = F.replace(code, F.lit(_MARK), F.lit("\u0002"))
    marks = F.regexp_replace(F.regexp_replace(clean, pattern, _MARK + "$0"), f"[^\n{_MARK}]+", "")
    return F.flatten(F.transform(F.split(marks, "\n", -1), lambda line, i: F.array_repeat(i + 1, F.length(line))))


def located(code: Column, rule: str, pattern: str) -> Column:
    """Matches of one rule as an array of ``(type, line, match, description)``."""

    linear = K.LINEAR_RULES.get(rule) if pattern == dict(K.SECURITY_RULES).get(rule) else None
    pattern = linear or pattern

    def build(matches: Column) -> Column:
        rows = F.zip_with(
            matches,
            match_lines(code, pattern),
            lambda match, line: F.struct(
                F.lit(rule).alias("type"),
                line.cast("int").alias("line"),
                F.left(match, F.lit(K.MATCH_CHARS)).alias("match"),
                F.lit(K.VULNERABILITY_TEXT % rule.replace("_", " ")).alias("description"),
            ),
        )
        if not linear:
            return rows
        live = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
        return F.transform(F.filter(F.arrays_zip(rows.alias("row"), live.alias("live")), lambda x: x["live"] != ""), lambda x: x["row"])

    none = F.array().cast(f"array<{VULNERABILITY}>")
    # the one-element array binds the matches to a name, so the text is searched once; lines only where there are any
    found = F.array(F.regexp_extract_all(code, F.lit(pattern), F.lit(0)))
    return F.transform(found, lambda m: F.when(F.size(m) > 0, build(m)).otherwise(none))[0]


_OPEN, _CLOSE = "\u0004", "\u0005"


def unsafe_calls(code: Column) -> Column:
    """``unsafe_execution`` in texts with calls whose closing part may be far off or missing: same matches, linear time.

    Complete calls become a pair of control characters (with their line breaks), open ones are only put between them.  What
    lies between two complete calls is searched for the plain words, which are never part of a call's start.
    """
    rule = "unsafe_execution"
    clean = F.replace(F.replace(code, F.lit(_OPEN), F.lit("\u0002")), F.lit(_CLOSE), F.lit("\u0002"))
    calls = F.filter(F.regexp_extract_all(clean, F.lit(K.UNSAFE_CALL), F.lit(1)), lambda x: x != "")
    marked = F.regexp_replace(clean, K.UNSAFE_CALL, f"{_OPEN}$4{_CLOSE}$2$3")
    lines = match_lines(marked, f"{_OPEN}{_CLOSE}|{K.UNSAFE_WORD}")

    def texts(found: Column) -> Column:
        words = lambda part: F.regexp_extract_all(part, F.lit(K.UNSAFE_WORD), F.lit(0))
        one = lambda i: F.when(i < F.size(found), F.array(F.get(found, i))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(F.split(marked, _OPEN + _CLOSE, -1), lambda part, i: F.concat(words(part), one(i))))

    matches = F.transform(F.array(calls), texts)[0]
    return F.zip_with(
        matches,
        lines,
        lambda match, line: F.struct(
            F.lit(rule).alias("type"),
            line.cast("int").alias("line"),
            F.left(match, F.lit(K.MATCH_CHARS)).alias("match"),
            F.lit(K.VULNERABILITY_TEXT % rule.replace("_", " ")).alias("description"),
        ),
    )


def _found(code: Column, rule: str, pattern: str) -> Column:
    if rule != "unsafe_execution" or pattern != dict(K.SECURITY_RULES)[rule]:
        return located(code, rule, pattern)
    return F.when(code.rlike(K.OPEN_CALL), unsafe_calls(code)).otherwise(located(code, rule, K.UNSAFE_WORD))


def _is_plain(code: Column) -> Column:
    """Texts of ASCII characters without marks, where Unicode classes and case folding match as the plain ones do."""
    return (F.octet_length(code) == F.char_length(code)) & ~code.contains(_MARK) & ~code.contains(_END)


def _marked(code: Column, rule: str, pattern: str, replacement: str) -> Column:
    """``located`` of a plain text in one search: each match comes back between marks, its text and line are read off them."""

    def build(marked: Column) -> Column:
        behind = F.filter(F.split(marked, _MARK, -1), lambda _, i: i > 0)
        matches = F.transform(behind, lambda x: F.substring_index(x, _END, 1))
        skeleton = F.regexp_replace(marked, f"[^\n{_MARK}]+", "")
        lines = F.flatten(F.transform(F.split(skeleton, "\n", -1), lambda line, i: F.array_repeat(i + 1, F.length(line))))
        rows = F.zip_with(
            matches,
            lines,
            lambda match, line: F.struct(
                F.lit(rule).alias("type"),
                line.cast("int").alias("line"),
                F.left(match, F.lit(K.MATCH_CHARS)).alias("match"),
                F.lit(K.VULNERABILITY_TEXT % rule.replace("_", " ")).alias("description"),
            ),
        )
        # a stretch that a linear rule takes in one step is an empty match
        return F.filter(rows, lambda r: r["match"] != "") if rule in K.LINEAR_MARKS else rows

    flags = pattern.replace("(?iuUd)", "(?id)").replace("(?Ud)", "(?d)")
    none = F.array().cast(f"array<{VULNERABILITY}>")
    marked = F.array(F.regexp_replace(code, flags, replacement))
    return F.transform(marked, lambda m: F.when(m.contains(_MARK), build(m)).otherwise(none))[0]


def _found_plain(code: Column, rule: str, pattern: str) -> Column:
    whole = f"{_MARK}$0{_END}"
    if pattern != dict(K.SECURITY_RULES).get(rule):
        return located(code, rule, pattern)
    if rule in K.LINEAR_MARKS:
        return _marked(code, rule, K.LINEAR_MARKS[rule], f"{_MARK}$1{_END}$2")
    if rule != "unsafe_execution":
        return _marked(code, rule, pattern, whole)
    calls = (F.length(code) - F.length(F.replace(code, F.lit(K.CALL_HEAD), F.lit("")))) / len(K.CALL_HEAD)
    return F.when(calls <= DIRECT_CALLS, _marked(code, rule, pattern, whole)).otherwise(unsafe_calls(code))


def vulnerabilities(code: Column, rules=K.SECURITY_RULES) -> Column:
    """All rules, in rule order then text order; texts without any rule's head word are searched once.

    ASCII texts take patterns without Unicode classes, and each rule searches them once for matches and lines.
    """
    none = F.array().cast(f"array<{VULNERABILITY}>")

    def of_rule(rule: str, pattern: str) -> Column:
        heads = K.PLAIN_HEADS.get(rule) if pattern == dict(K.SECURITY_RULES).get(rule) else None
        found = _found_plain(code, rule, pattern)
        if not heads:
            return found
        return F.when(reduce(or_, [code.contains(h) for h in heads]), found).otherwise(none)

    plain = F.concat(*[of_rule(rule, pattern) for rule, pattern in rules])
    found = F.concat(*[_found(code, rule, pattern) for rule, pattern in rules])
    return F.when(_is_plain(code), plain).when(code.rlike(K.SECURITY_HEADS), found).otherwise(F.when(code.isNotNull(), none))


def with_vulnerabilities(df: DataFrame, rules=K.SECURITY_RULES) -> DataFrame:
    return df.withColumn("vulnerabilities", vulnerabilities(F.col("content"), rules))


def security_scan(df: DataFrame, rules=K.SECURITY_RULES, keys=("repo", "path")) -> DataFrame:
    """One row per match; ``seq`` is its place in the file's result list."""
    return numbered_rows(df, keys, vulnerabilities(F.col("content"), rules), "v").select(*keys, "seq", "v.*")


def security_rule(df: DataFrame, rule: str, keys=("repo", "path")) -> DataFrame:
    return security_scan(df, [r for r in K.SECURITY_RULES if r[0] == rule], keys)


def rules_scanned() -> list[str]:
    return [name for name, _ in K.SECURITY_RULES]
