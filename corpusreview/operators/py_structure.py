"""Functions, classes, imports, complexity and nesting of Python texts.

Python code can only be parsed by Python, so one small Arrow UDF turns a text into the list of its interesting syntax
nodes in pre-order, each with the index of the last node below it and, for functions, the branch weight and greatest
depth below.  A node's sub-tree is then a slice of that list, and the rest - spans, complexity, nesting, methods, order -
is Catalyst expressions on the list.  Only the text of Python files is sent to the worker and the rest of the row stays
in the JVM; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusreview.functions.arrays import numbered_rows, rows_of
from corpusreview.functions.scores import one_decimal

NODE = (
    "struct<id:int,last:int,level:int,depth:int,weight:int,below:int,deepest:int,line:int,end_line:int,kind:string,"
    "name:string,is_async:boolean,has_docstring:boolean,names:array<string>>"
)
TREE = f"struct<has_errors:boolean,nodes:array<{NODE}>>"


def _tree_udf():
    # everything the task needs is defined in here, so the function travels to the executors by value
    node_type = pa.struct(
        [(n, pa.int32()) for n in ("id", "last", "level", "depth", "weight", "below", "deepest", "line", "end_line")]
        + [("kind", pa.string()), ("name", pa.string()), ("is_async", pa.bool_()), ("has_docstring", pa.bool_())]
        + [("names", pa.list_(pa.string()))]
    )

    def trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ast
        import re
        import warnings

        import pyarrow as pa

        # fixed values: node kinds that count as a branch / as a nesting level
        branches = (ast.If, ast.For, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.Assert, ast.BoolOp)
        levels = (ast.If, ast.For, ast.While, ast.With, ast.Try)
        functions = (ast.FunctionDef, ast.AsyncFunctionDef)
        kept = {*branches, *functions, ast.ClassDef, ast.Import, ast.ImportFrom}
        # nothing below these is kept; below expressions and plain statements only "and" / "or" are
        leaves = {ast.Load, ast.Store, ast.Pass, ast.Break, ast.Continue, ast.alias, ast.Global}
        plain = (ast.expr, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Return, ast.Delete, ast.Raise)

        def facts(node):
            """``weight, kind, name, is_async, has_docstring, names`` of a node that is kept."""
            if isinstance(node, branches):
                # an "if" directly in an else branch (every elif) is one branch more
                extra = sum(isinstance(x, ast.If) for x in node.orelse) if isinstance(node, ast.If) else 0
                return 1 + extra, "branch", None, None, None, None
            if isinstance(node, (*functions, ast.ClassDef)):
                first = node.body[0].value if isinstance(node.body[0], ast.Expr) else None
                documented = isinstance(first, ast.Constant) and isinstance(first.value, str)
                if isinstance(node, ast.ClassDef):
                    return 0, "class", node.name, False, documented, [ast.dump(b) for b in node.bases]
                is_async = isinstance(node, ast.AsyncFunctionDef)
                return 0, "function", node.name, is_async, documented, [a.arg for a in node.args.args]
            if isinstance(node, ast.Import):
                return 0, "import", None, None, None, [a.name for a in node.names]
            return 0, "import", None, None, None, [f"{node.module or ''}.{a.name}" for a in node.names]

        line_end, boolean = re.compile(r"\r\n|\r|\n"), re.compile(r"\b(?:and|or)\b")

        def boolean_lines(code):
            """Running number of lines that hold ``and`` / ``or``."""
            counts = [0]
            for line in line_end.split(code):
                counts.append(counts[-1] + (boolean.search(line) is not None))
            return counts

        def children(node, counts):
            """Child nodes that can hold a kept node, last one first."""
            for field in reversed(node._fields):
                value = getattr(node, field, None)
                for x in reversed(value) if isinstance(value, list) else (value,):
                    if isinstance(x, plain):
                        if counts[x.end_lineno] > counts[x.lineno - 1]:
                            yield x
                    elif isinstance(x, ast.AST) and type(x) not in leaves:
                        yield x

        def parsed(code):
            """The tree; a text that is nested too deep for the parser is a faulty text, a lack of memory is not."""
            try:
                return ast.parse(code)
            except MemoryError as e:
                if "too complex" in str(e) or "stack overflowed" in str(e):
                    raise SyntaxError(str(e)) from None
                raise

        def nodes(code):
            rows, open_rows, todo, counts = [], [], [(parsed(code), 0, 0)], boolean_lines(code)
            while todo:
                node, level, depth = todo.pop()
                if node is None:  # all below row number ``level`` is done: its sums go to the row above
                    row = rows[level]
                    row[1] = len(rows)
                    open_rows.pop()
                    if open_rows:
                        above = rows[open_rows[-1]]
                        above[5] += row[5]
                        above[6] = max(above[6], row[6])
                    continue
                if type(node) in kept:
                    depth += isinstance(node, levels)
                    weight, *rest = facts(node)
                    todo.append((None, len(rows), 0))
                    span = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
                    open_rows.append(len(rows))
                    rows.append([len(rows) + 1, None, level, depth, weight, weight, depth, *span, *rest])
                todo += [(child, level + 1, depth) for child in children(node, counts)]
            return rows

        def listed(codes):
            offsets, errors, rows = [0], [], []
            for code in codes:
                try:
                    rows += nodes(code) if code is not None else []
                    errors.append(None if code is None else False)
                except (SyntaxError, ValueError, RecursionError):
                    errors.append(True)
                offsets.append(len(rows))
            columns = list(zip(*rows)) if rows else [()] * len(node_type)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, node_type)]
            structs = pa.StructArray.from_arrays(arrays, fields=list(node_type))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            return pa.StructArray.from_arrays([pa.array(errors, pa.bool_()), lists], ["has_errors", "nodes"])

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for batch in batches:
                # copies of a text within the batch are parsed once
                texts = batch.dictionary_encode()
                found = listed([*texts.dictionary.to_pylist(), None])
                yield found.take(texts.indices.fill_null(len(texts.dictionary)))

    return F.arrow_udf(trees, TREE)


def is_python(language: Column) -> Column:
    return F.lower(language) == "python"


def _of_kind(nodes: Column, kind: str) -> Column:
    """Nodes of a kind, level by level and left to right."""
    keyed = F.transform(
        F.filter(nodes, lambda n: n["kind"] == kind),
        lambda n: F.struct(n["level"].alias("level"), n["id"].alias("id"), n.alias("node")),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["node"])


def _function(f: Column) -> Column:
    return F.struct(
        f["name"].alias("name"),
        f["line"].alias("line"),
        f["end_line"].alias("end_line"),
        (f["end_line"] - f["line"] + 1).alias("length"),
        f["names"].alias("args"),
        f["has_docstring"].alias("has_docstring"),
        (f["below"] + 1).alias("complexity"),
        (f["deepest"] - f["depth"]).alias("nesting"),
        f["is_async"].alias("is_async"),
    )


def _class(c: Column) -> Column:
    return F.struct(
        c["name"].alias("name"),
        c["line"].alias("line"),
        F.transform(
            _of_kind(F.slice(F.col("py_nodes"), c["id"], c["last"] - c["id"] + 1), "function"), lambda n: n["name"]
        ).alias("methods"),
        c["has_docstring"].alias("has_docstring"),
        c["names"].alias("bases"),
    )


def with_py_nodes(df: DataFrame) -> DataFrame:
    """Add ``py_nodes`` and ``py_has_errors`` (NULL for other languages, whose text is not sent to Python)."""
    tree = _tree_udf()(F.when(is_python(F.col("language")), F.col("content")))
    return (
        df.withColumn("_tree", tree)
        .withColumn("py_nodes", F.col("_tree.nodes"))
        .withColumn("py_has_errors", F.col("_tree.has_errors"))
        .drop("_tree")
    )


def with_py_structure(df: DataFrame) -> DataFrame:
    """Add ``py_functions, py_classes, py_imports`` (arrays) and ``py_has_errors``."""
    nodes = F.col("py_nodes")
    return (
        with_py_nodes(df)
        .withColumn("py_functions", F.transform(_of_kind(nodes, "function"), _function))
        .withColumn("py_classes", F.transform(_of_kind(nodes, "class"), _class))
        .withColumn("py_imports", F.flatten(F.transform(_of_kind(nodes, "import"), lambda n: n["names"])))
        .drop("py_nodes")
    )


def py_nodes(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    """One row per kept syntax node of each Python file."""
    python = df.filter(is_python(F.col("language")))
    return rows_of(with_py_nodes(python), keys, F.col("py_nodes"), "id")


def py_functions(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    python = df.filter(is_python(F.col("language")))
    return rows_of(with_py_structure(python), keys, F.col("py_functions"), "name")


def py_classes(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    python = df.filter(is_python(F.col("language")))
    return rows_of(with_py_structure(python), keys, F.col("py_classes"), "name")


def py_imports(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    python = df.filter(is_python(F.col("language")))
    return numbered_rows(with_py_structure(python), keys, F.col("py_imports"), "module")


def py_complexity(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    """Per file: functions and the sum of their complexities; code outside functions counts nothing."""
    python = df.filter(is_python(F.col("language")))
    fns = F.col("py_functions")
    return with_py_structure(python).select(
        *keys,
        "py_has_errors",
        F.size(fns).alias("function_count"),
        F.aggregate(fns, F.lit(0), lambda acc, f: acc + f["complexity"]).alias("total_complexity"),
        F.coalesce(F.array_max(F.transform(fns, lambda f: f["nesting"])), F.lit(0)).alias("max_nesting"),
        mean_length(fns).alias("avg_function_length"),
    )


def mean_length(fns: Column) -> Column:
    total = F.aggregate(fns, F.lit(0), lambda acc, f: acc + f["length"])
    mean = one_decimal(total.cast("decimal(12,0)") / F.size(fns).cast("decimal(8,0)")).cast("double")
    return F.when(F.size(fns) > 0, mean).otherwise(F.lit(0.0))
