import importlib
import re

import pytest

import __spark_entry__ as entry
from paperweave.plans import citation_queries, data_problems, sink_queries
from tests.conftest import rows

CORE = {**citation_queries.queries(), **sink_queries.queries(), **data_problems.queries()}
SQL = {**citation_queries.oracle_sql(), **sink_queries.oracle_sql(), **data_problems.oracle_sql()}


def plain(x):
    x = x.isoformat(" ") if hasattr(x, "isoformat") else x
    return re.sub(r"\+00:00$", "", str(x)) if x is not None else None


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, sf, duck, name):
    df = CORE[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    out = duck.execute(SQL[name])
    cols = [d[0] for d in out.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(x) for x in r) for r in out.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_package(monkeypatch):
    monkeypatch.setattr(entry, "OPTIONAL", ["paperweave.llm_gone.queries"])
    real = importlib.import_module

    def gone(name):
        if name.startswith("paperweave.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="paperweave.llm")
        return real(name)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(entry.queries()) == set(CORE)


def test_cli(spark, sf, tmp_path):
    from paperweave.cli import arguments, run

    base = ["--documents", f"{sf}/raw_doc.parquet", "-y", "1990", "-l", "0", "--persons", f"{sf}/person.parquet", "--publications", f"{sf}/publication.parquet", "-k", "toolkit"]
    got = run(arguments().parse_args([*base, "json", "--dest", str(tmp_path / "j")]))
    nodes = spark.read.parquet(str(tmp_path / "j" / "nodes"))
    assert {r[0] for r in nodes.select("paper_id").collect()} <= {r[0] for r in got.nodes().collect()}
    run(arguments().parse_args([*base, "graph", "--dest", str(tmp_path / "g")]))
    assert rows(spark.read.parquet(str(tmp_path / "g" / "cite"))) is not None
