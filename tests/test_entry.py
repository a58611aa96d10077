import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "part events documents embeddings labels".split()


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["rank"] == 1


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_operators(monkeypatch):
    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("loomquery.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m.startswith("loomquery.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import loomquery

    monkeypatch.delattr(loomquery, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    found = importlib.reload(entry).queries()
    assert "bm25_topk" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


@pytest.mark.parametrize("name", ["bm25_topk", "tfidf_cosine_topk", "knn_batch", "ndcg_at_10", "object_concat_search", "candidate_union_max", "json_result_rows"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, got[cols].values.tolist())) == sorted(map(repr, want[cols].values.tolist()))
