import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_contract(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    if os.path.isdir(DATA):
        assert e.entry(spark).limit(5).count() > 0


def test_library_stands_without_llm():
    """Nothing outside the subpackage names it."""
    for folder, _, names in os.walk(os.path.join(ROOT, "verselake")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "verselake.llm" not in f.read(), n


def test_discard(spark):
    from verselake.session import discard, written

    one = written(spark.range(5))
    two = written(one.selectExpr("id + 1 as id"))
    path = one._written_to.removeprefix("file://")
    assert os.path.isdir(path)
    discard(one)
    assert not os.path.exists(path) and two.count() == 5
