import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corpusreview.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def files(spark):
    """Build ``repo, path, size, content, language`` rows from ``{path: content}``."""
    from corpusreview.operators.selection import with_language

    def build(texts: dict[str, str]):
        rows = [("r", path, len(text.encode()), text) for path, text in texts.items()]
        return with_language(spark.createDataFrame(rows, "repo string, path string, size bigint, content string"))

    return build


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]
