"""Every registered query with SQL equals DuckDB on the small tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    found = entry.queries()
    wrong = []
    for name, sql in entry.oracle_sql().items():
        df = found[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr)
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        want = sorted((tuple(rounded(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
        if got != want or cols != sorted(names):
            wrong.append(name)
    assert not wrong
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for top, _, names in os.walk(os.path.join(root, "lumenframe")):
        if os.path.basename(top) == "llm" or "/llm/" in top:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(top, n)) as f:
                    assert "lumenframe.llm" not in f.read(), n
