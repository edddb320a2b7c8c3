"""Each query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from veriloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    text = lambda x: "NULL" if pd.isna(x) else f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(text, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert len(ours) and rows(ours) == rows(theirs)


def test_config_leaves(spark):
    from veriloom.sources.config import config_leaves

    bad = config_leaves(spark.createDataFrame([("a.toml", "x = "), ("b.json", "[1]"), ("c.ini", None)], "path string, text string")).toPandas()
    assert len(bad) == 2 and bad["error"].notna().all()


def test_whole_texts(spark, tmp_path):
    texts = ["x = 1  # noqa\nplain\nDELETE FROM t WHERE a = 1\n#!/bin/sh\nend", "#!/bin/bash\nset -euo pipefail\n. common.sh\nrun"]
    spark.createDataFrame([(i * 11, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("suppression_lines") == [(0, 1, "noqa")] and run("sql_pattern_lines") == [(0, 3, "DELETE FROM")]


SQL_LINES = {
    "CREATE EXTENSION vector": "CREATE EXTENSION", "create or replace view": "CREATE OR REPLACE", "CREATE POLICY p1x": "CREATE POLICY", "DROP INDEX abc_i": "DROP INDEX", "ENABLE ROW LEVEL SECURITY": "ENABLE RLS",
    "GRANT all ON t TO u": "GRANT ON", "REVOKE all ON t": "REVOKE ON", "SET LOCAL a = 1": "SET LOCAL", "LOAD 'extension'": "LOAD extension", "MATCH (n:Person)": "Cypher MATCH", "RETURN  id  (n) now": "Cypher RETURN",
    "the value a$12 here": "Parameterized $N", "drop it IF EXISTS": "IF EXISTS", "x WHERE aa > 10": "WHERE clause", "DELETE FROM a UPDATE b SET c": "DELETE FROM", "nothing of note": None, "WHERE a=1": None,
}


def test_sql_and_attribution_patterns(spark):
    from pyspark.sql import functions as F
    from veriloom.operators import checks

    assert len(checks.SQL_PATTERNS) == 33
    rows = spark.createDataFrame([(x,) for x in SQL_LINES], "text string")
    assert {r.text: r.p for r in rows.select("text", checks.sql_pattern(F.col("text")).alias("p")).collect()} == SQL_LINES
    message = "feat: x\n\U0001F916 made\n  # \U0001F916\nassisted by C++ (x)\nassisted by Cxx\nby C++ (x) \U0001F916"
    got = checks.attribution(spark.createDataFrame([("m", message)], "path string, text string"), ("C++ (x)",)).collect()
    assert sorted(r.line for r in got) == [2, 4, 6]


def test_python_policies(spark):
    from veriloom.operators import python_facts

    def facts(source, path):
        rows = python_facts.python_facts(spark.createDataFrame([(path, source)], "path string, text string")).collect()
        return sorted((r.line, r.kind, r.detail) for r in rows)

    source = """import os, pytest
a = "SELECT"
"standalone SELECT a FROM b"
late = "x" * 1 + "%s select a from b"
run(message="SELECT a FROM bcd", q=f"DELETE FROM {t} now")
key = os.getenv("K", "sk-abc")
other = os.environ.get("K", default="plain")
sql = f"select abc from {t}"
os.environ["A"] = "1"
@pytest.mark.skipif(True)
@pytest.mark.slow
def f():
    return 1
""".replace("%s", "y" * 200)
    got = [x for x in facts(source, "tests/a.py") if x[1] in ("sql", "banned_marker", "DEFAULT_SECRET", "SQL_INJECTION", "TEST_ENV_BYPASS")]
    assert got == [(4, "sql", "SELECT FROM"), (5, "sql", "DELETE FROM"), (6, "DEFAULT_SECRET", "os.getenv"), (8, "SQL_INJECTION", "SELECT"), (8, "sql", "SELECT FROM"), (9, "TEST_ENV_BYPASS", "os.environ"), (10, "banned_marker", "pytest.mark.skipif")]
    assert not [x for x in facts(source, "migrations/a.py") if x[1] in ("sql", "TEST_ENV_BYPASS")]
