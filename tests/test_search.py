import hashlib
import json
import math

import duckdb
import numpy as np
import pytest

from loomquery import cli, evaluation, scratch
from loomquery.engine import SearchEngine, register, resolve, strategies
from loomquery.functions import text as tx
from loomquery.operators import bm25, cascade, held, knn, metrics, models, neural, projection, ranking, rptree, tfidf, vector_index
from loomquery.plans import registry
from loomquery.server import App
from loomquery.sources import corpus as io
from loomquery.sources import synthetic, vector_store

TEXTS = ["the support port", "port", "airport report", "", None, "a\nb c port port", "nothing here", "port"]


def plain_bm25(texts, query, k1=1.5, b=0.75):
    low = [(t or "").lower() for t in texts]
    dl = [t.count(" ") + 1 for t in low]
    mean = sum(dl) / len(dl)
    out = [0.0] * len(texts)
    for s in tx.stems_of(query):
        tf = [t.count(s) for t in low]
        df = sum(x > 0 for x in tf)
        idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
        out = [o + idf * x * (k1 + 1) / (x + k1 * (1 - b + b * d / mean)) for o, x, d in zip(out, tf, dl)]
    return out


def best(query):
    score = plain_bm25(TEXTS, query)
    return sorted((i for i, x in enumerate(score) if x > 0), key=lambda i: (-score[i], i))


def ids(df):
    return [r["index"] for r in df.orderBy("rank").collect()]


def test_bm25_equals_the_plain_formula(spark):
    docs = io.from_list(spark, TEXTS)
    got = {r["index"]: r["score"] for r in bm25.scores(docs, "port airport").collect()}
    for i, x in enumerate(plain_bm25(TEXTS, "port airport")):
        assert abs(got[i] - x) < 1e-12


def test_bm25_ties_edges_and_batches(spark):
    docs = io.from_list(spark, TEXTS)
    want = best("port")
    assert {1, 7} <= set(want) and want.index(7) == want.index(1) + 1  # equal texts: by index
    assert ids(bm25.search(docs, "port", 3)) == want[:3]
    assert bm25.search(docs, "zzz").count() == 0
    assert bm25.search(docs, "! a").count() == 0
    assert bm25.search(docs.limit(0), "port").count() == 0
    assert bm25.search(docs, "port", 99).count() == 5
    with pytest.raises(ValueError):
        bm25.search(docs, "port", 0)
    batch = bm25.batch_search(docs, {1: "port", 2: "nothing", 3: "zzz"}, 2)
    assert sorted((r["query_id"], r["rank"], r["index"]) for r in batch.collect()) == [(1, 1, want[0]), (1, 2, want[1]), (2, 1, 6)]


def test_bm25_plan_does_not_shuffle_documents(spark):
    docs = io.from_list(spark, TEXTS)
    plan = bm25.search(docs, "port", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "hashpartitioning" not in plan


def test_tfidf_and_small_rptree_agree(spark):
    docs, queries, _ = synthetic.dataset(spark, 10)
    q = queries.first()["query"]
    docs = docs.select("index", "document")
    a = tfidf.search(docs, q, 5).collect()
    b = rptree.search(docs, q, 5).collect()
    assert a == b and len(a) == 5 and all(r["index"] < 10 for r in a)
    assert tfidf.search(docs, "  ", 5).count() == 0


def test_rptree_leaves_partition_the_corpus_and_find_neighbours(spark):
    docs, queries, _ = synthetic.dataset(spark, 60)
    docs = docs.select("index", "document")
    assign, inner = rptree.build(rptree.vectors(docs), trees=2, leaf_size=50)
    counts = assign.groupBy("tree", "index").count()
    assert counts.count() == 2 * 480 and counts.where("count <> 1").count() == 0
    assert inner.count() and assign.groupBy("tree", "node").count().agg({"count": "max"}).first()[0] <= 50
    q = queries.first()["query"]
    found = rptree.search(docs, q, 5, n_candidates=120).collect()
    exact = tfidf.search(docs, q, 5).collect()
    assert len(found) == 5 and found[0]["score"] <= exact[0]["score"] + 1e-9
    assert found[0]["score"] > 0.5 * exact[0]["score"]


def test_knn_is_exact(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((60, 8)).astype("float32")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(u @ u[3]))[:5].tolist()
    assert ids(knn.search(table, m[3].tolist(), 5)) == best
    asked = table.where("vec_id = 3").selectExpr("vec_id as query_id", "embedding as query_vector")
    assert ids(knn.batch_search(table, asked, 5)) == best


def test_min_max_and_union(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0)], "index long, score double")
    assert [r["score"] for r in ranking.min_max(df, "score").orderBy("index").collect()] == [0.0, 1.0, 0.5]
    assert ranking.min_max(df.limit(1), "score").first()["score"] == 0.5
    other = spark.createDataFrame([(1, 9.0), (5, 1.0)], "index long, score double")
    got = {r["index"]: (r["score"], r["origin"]) for r in ranking.union_max(df, other).collect()}
    assert got == {0: (1.0, 0), 1: (9.0, 0), 2: (2.0, 0), 5: (1.0, 1)}
    assert [ranking.candidate_count(n) for n in (10, 4000, 100000)] == [50, 200, 500]


def test_projection_dual_equals_primal_and_round_trips(spark, tmp_path):
    texts = [f"word{i} shared text {i % 3}" for i in range(20)]
    w = projection.train(texts)
    x = np.zeros((20, projection.FEATURES))
    for i, t in enumerate(texts):
        at, v = projection.hashed(t)
        x[i, at] = v
    used = np.flatnonzero(x.any(0))
    y = models.HashEmbedder().embed(texts)
    primal = np.linalg.solve(x[:, used].T @ x[:, used] + np.eye(len(used)), x[:, used].T @ y)
    assert np.abs(w[used] - primal).max() < 1e-4
    projection.save(spark, w, str(tmp_path / "w"))
    assert np.allclose(projection.load(spark, str(tmp_path / "w")), w)


def test_cascades(spark):
    docs, queries, _ = synthetic.dataset(spark, 15)
    docs = docs.select("index", "document")
    q = queries.first()["query"]
    w = projection.train_on(docs)
    small = cascade.search(docs, q, w, 5, skip_neural=True)
    assert ids(small) == ids(projection.search(docs, q, w, 5))
    assert projection.search(docs, "zzz", w, 7).count() == 7  # no signal still gives k rows
    large = cascade.candidates(docs, q, w, 5, stage1_k=10, stage2_k=8, sps_direct_threshold=50)
    assert large.count() == 8
    assert set(ids(large)) <= set(ids(bm25.search(docs, q, 10))) | set(ids(projection.search(docs, q, w, 10)))
    for found in (cascade.search(docs, q, w, 5), cascade.search_v2(docs, q, w, 5)):
        scores = [r["score"] for r in found.orderBy("rank").collect()]
        assert len(scores) == 5 and scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError):
        cascade.candidates(docs, q, w, 5, sps_direct_threshold=1, merge="other")
    assert cascade.is_confident([1.0, 0.9], 5) and not cascade.is_confident([1.0, 0.9, 0.89], 2) and cascade.is_confident([1.0, 0.9, 0.1], 2)


def test_neural_drops_blank_and_rerank_keeps_order_of_ties(spark):
    docs = io.from_list(spark, TEXTS)
    assert set(ids(neural.search(docs, "port", 99))) == {0, 1, 2, 5, 6, 7}

    class Flat:
        def score(self, query, documents):
            return np.zeros(len(documents))

    c = spark.createDataFrame([(2, 30, "x"), (1, 20, "y")], "rank long, index long, document string")
    assert ids(neural.rerank(c, "q", 2, Flat())) == [20, 30]
    assert neural.embed(docs).count() == 6


def test_metrics_against_a_plain_model(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], "query_id long, rank long, index long")
    qrels = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 11)], "query_id long, index long")
    got = {r["query_id"]: r for r in metrics.evaluate(results, qrels, queries).collect()}
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert abs(got[1]["ndcg_10"] - (1 / math.log2(3) + 0.5) / ideal) < 1e-12
    assert (got[1]["mrr"], got[1]["precision_10"], got[1]["hit_rate_10"]) == (0.5, 0.2, 1.0)
    assert abs(got[1]["recall_10"] - 2 / 3) < 1e-12
    assert [got[2][c] for c in ("ndcg_10", "mrr", "recall_100", "hit_rate_10")] == [0.0] * 4
    assert [got[3][c] for c in ("ndcg_10", "mrr", "recall_100", "precision_10")] == [0.0] * 4
    p = spark.createDataFrame([("a", float(i)) for i in range(24)] + [("a", None), ("b", 1.0), ("c", None)], "g string, x double")
    found = metrics.position_percentiles(p, "g", "x", {"p50": 0.5, "p95": 0.95, "top": 1.0})
    assert {tuple(r) for r in found.collect()} == {("a", 12.0, 22.0, 23.0), ("b", 1.0, 1.0, 1.0)}


def test_engine_registry_lists_and_objects(spark):
    assert {"lexical", "projection", "neural", "cascade", "rptree", "cascade_v2"} <= set(strategies())
    assert resolve("auto") == "cascade"
    with pytest.raises(ValueError, match="lexical"):
        resolve("nope")

    @register("reverse_test")
    def reverse(corpus, query, top_k=10):
        return ranking.top_k(corpus.selectExpr("index", "cast(index as double) as score"), top_k).select("rank", "index", "score")

    assert ids(SearchEngine(spark, "reverse_test").search("x", ["a", "b", "c"], 2)) == [2, 1]
    found = SearchEngine(spark, "lexical").search("port", TEXTS, 2).collect()
    assert [(r["rank"], r["index"], r["document"]) for r in found] == [(k + 1, i, TEXTS[i]) for k, i in enumerate(best("port")[:2])]
    table = io.from_objects(spark, [{"a": "port", "b": 1}, {"a": None}, {"a": "x", "c": {"k": True}}])
    rows = SearchEngine(spark, "lexical").search_objects("port", table, "a, b, missing", 5).collect()
    assert [(r["index"], r["document"], r["object"]["b"]) for r in rows] == [(0, "port 1 ", "1")]
    rows, ms = SearchEngine(spark, "lexical", k1=1.2).search_timed("port", TEXTS, 3)
    assert len(rows) == 3 and ms > 0


def test_json_sources_and_cli(spark, tmp_path, capsys):
    f = tmp_path / "docs.json"
    f.write_text(json.dumps(["port here", "other"]))
    assert [(r["index"], r["document"]) for r in io.read_json_strings(spark, str(f)).orderBy("index").collect()] == [(0, "port here"), (1, "other")]
    assert cli.main(["search", "port", "-f", str(f), "-s", "lexical", "-k", "1"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["strategy"] == "lexical" and out["num_documents"] == 2 and out["results"][0]["index"] == 0
    o = tmp_path / "objects.json"
    o.write_text(json.dumps([{"t": "port"}, {"t": "x", "u": 2}]))
    assert {c for c in io.read_json_objects(spark, str(o)).columns} == {"index", "t", "u"}
    assert cli.main(["search", "port", "-f", str(o), "-s", "lexical"], spark) == 1  # records need fields
    assert cli.main(["search", "port", "-f", str(o), "-s", "lexical", "--text-fields", "t,u"], spark) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["object"]["t"] == "port"
    f.write_text("[]")
    assert cli.main(["search", "port", "-f", str(f)], spark) == 1
    with pytest.raises(ValueError):
        io.parse_json("  ")


def test_server_requests(spark):
    app = App(spark)
    assert app.handle("GET", "/health") == (200, {"status": "ok"})
    assert "lexical" in app.handle("GET", "/strategies")[1]["strategies"]
    status, out = app.handle("POST", "/search", {"query": "port", "documents": TEXTS[:3], "strategy": "lexical", "top_k": 1})
    assert status == 200 and out["results"][0]["document"] in TEXTS[:3] and out["num_documents"] == 3
    status, out = app.handle("POST", "/search/objects", {"query": "port", "objects": [{"a": "port", "n": 1}], "text_fields": ["a"], "strategy": "lexical"})
    assert status == 200 and out["results"][0]["object"] == {"a": "port", "n": 1}
    assert app.handle("POST", "/search", {"query": "x", "documents": ["a"], "strategy": "nope"})[0] == 422
    assert app.handle("POST", "/search", {"query": "x", "documents": ["a"], "top_k": 0, "strategy": "lexical"})[0] == 422
    assert app.handle("GET", "/nothing")[0] == 404


def test_evaluation_harness(spark, tmp_path):
    docs, queries, qrels = synthetic.dataset(spark, 5)
    by_query, failed = evaluation.run(spark, ["lexical", "nope"], docs.select("index", "document"), queries, qrels)
    board = evaluation.summary(by_query).collect()
    asked = {r["query_id"]: r["query"] for r in queries.collect()}
    direct = metrics.evaluate(bm25.batch_search(docs, asked, 100), qrels, queries).agg({"ndcg_10": "avg"}).first()[0]
    assert list(failed) == ["nope"] and board[0]["strategy"] == "lexical" and abs(board[0]["ndcg_10"] - direct) < 1e-12
    evaluation.save(by_query, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 24


def test_stream_of_micro_batches(spark, tmp_path):
    from loomquery.streaming.micro_batch import search_stream

    src = tmp_path / "in"
    io.from_list(spark, TEXTS).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("index long, document string").parquet(str(src))
    search_stream(stream, "port", str(tmp_path / "out"), str(tmp_path / "ck"), 3).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "batch=0"))
    assert ids(got) == best("port")[:3]


def test_trees_split_to_any_depth_and_give_up_on_equal_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.standard_normal((300, 8)), np.ones((60, 8))])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "index long, v array<float>")
    whole, inner = rptree.build(docs, trees=2, leaf_size=10)
    monkeypatch.setattr(rptree, "TOP_LEVELS", 2)
    deep, below = rptree.build(docs, trees=2, leaf_size=10)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, deep.select(whole.columns).collect()))
    assert sorted(map(tuple, inner.collect())) == sorted(map(tuple, below.collect()))
    sizes = {(r["tree"], r["node"]): r["count"] for r in whole.groupBy("tree", "node").count().collect()}
    assert all(n <= 10 or n >= 60 for n in sizes.values()) and max(sizes.values()) >= 60
    q = rng.standard_normal(8)
    counts = whole.groupBy("tree", "node").agg({"index": "count"}).withColumnRenamed("count(index)", "n")
    got = {(r["tree"], r["node"]): r["take"] for r in rptree.leaves_for(q, counts, inner, 70, seed=42).collect()}
    cuts = {(r["tree"], r["node"]): r["threshold"] for r in inner.collect()}
    for tree in (0, 1):  # a plain best-first walk
        queue, left, want = [(0.0, 0, 1)], 70, {}
        while queue and left > 0:
            queue.sort()
            _, _, node = queue.pop(0)
            if (tree, node) in cuts:
                d = q @ rptree._direction(42, tree, node, 8) - cuts[tree, node]
                near, far = (2 * node + 1, 2 * node) if d > 0 else (2 * node, 2 * node + 1)
                queue += [(0.0, -node, near), (abs(d), 1, far)]
            else:
                want[tree, node] = min(left, sizes[tree, node])
                left -= want[tree, node]
        assert {k: v for k, v in got.items() if k[0] == tree} == want


def test_tree_recall_grows_with_the_candidates(spark):
    """Twenty excerpts over a thousand documents; the figures are in the README."""
    docs = io.from_table(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text").where(tx.not_blank("document"))
    texts = [r["document"].split() for r in docs.where("index % 37 = 0").orderBy("index").collect()]
    queries = [" ".join(t[5:45]) for t in texts if len(t) > 60][:20]
    vecs = rptree.vectors(docs).persist()
    assign, inner = rptree.build(vecs)
    assign, sizes = assign.persist(), assign.groupBy("tree", "node").agg({"index": "count"}).withColumnRenamed("count(index)", "n").persist()
    w = {r["index"]: {t["term"]: t["weight"] for t in r["terms"]} for r in vecs.collect()}
    idf = {r["term"]: r["idf"] for r in tfidf.vocabulary(tfidf.term_counts(docs), docs.selectExpr("count(1) as n")).collect()}
    where = {}
    for r in assign.collect():
        where.setdefault((r["tree"], r["node"]), []).append(r["index"])
    recall = {}
    for budget in (66, 200, 600):
        found = []
        for text in queries:
            tf = {}
            for word in models.words(text):
                if word in idf:
                    tf[word] = tf.get(word, 0) + 1
            asked = {t: (1 + math.log(n)) * idf[t] for t, n in tf.items()}
            score = {i: sum(x * own.get(t, 0) for t, x in asked.items()) for i, own in w.items()}
            exact = sorted(score, key=lambda i: (-score[i], i))[:10]
            q = sum(x * models.sign_rows([models.signs(t)])[0] for t, x in asked.items()) / math.sqrt(sum(x * x for x in asked.values()))
            take = rptree.leaves_for(q, sizes, inner, budget).collect()
            pool = {i for r in take for i in sorted(where[r["tree"], r["node"]])[: r["take"]]}
            found.append(len(pool & set(exact)) / 10)
        recall[budget] = sum(found) / len(found)
    print("rptree recall at 10 by rows a tree:", recall)
    assert recall[66] > 0.25 and recall[200] > recall[66] and recall[600] >= 0.9
    spark.catalog.clearCache()


@pytest.mark.parametrize("case", ["distinct", "copies", "equal", "one", "none"])
def test_median_split_equals_its_sql(spark, tmp_path, monkeypatch, case):
    monkeypatch.setattr(rptree, "ACCURACY", 100)  # as many rows beyond it as a million beyond the real one
    m = np.random.default_rng(9).standard_normal((2001, 8)).astype("float32")
    m = {"distinct": m, "copies": np.concatenate([m[:300], *[m[300:303]] * 500]), "equal": m[[0] * 300], "one": m[:1], "none": m[:0]}[case]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(9000, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {tuple(r) for r in registry.QUERIES["median_split"](spark, str(tmp_path)).select("index", "tree", "node").collect()}
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == set(con.sql(registry.ORACLE_SQL["median_split"]).fetchall()) and len(got) == 2 * len(m)


def test_rptree_medians_are_exact_and_levels_bounded(spark, monkeypatch):
    monkeypatch.setattr(rptree, "ACCURACY", 100)
    p = np.random.default_rng(4).standard_normal(6000).round(2)  # many ties
    rows = [(0, 2 + i % 2 * (i % 7), float(x)) for i, x in enumerate(p)]
    want = {}
    for node in {r[1] for r in rows}:
        own = sorted(r[2] for r in rows if r[1] == node)
        want[0, node] = own[(len(own) - 1) // 2]
    assert rptree.medians(spark.createDataFrame(rows, "tree int, node long, p double"), 10) == want
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).standard_normal((400, 8)))], "index long, v array<double>")
    for top in (1, 16):
        monkeypatch.setattr(rptree, "TOP_LEVELS", top)
        assign, inner = rptree.build(docs, trees=2, leaf_size=1, levels=3)
        assert {r["node"] for r in assign.collect()} == set(range(8, 16)) and inner.count() == 14


def test_vector_index_recall_and_exactness(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16)) * 2
    m = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16))).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = str(tmp_path / "index")
    assert vector_index.build(table, path, sample_rows=1000) == 3000
    asked = table.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    found = dict(vector_index.sweep(spark, path, table, asked, (1, 8, 55)))
    assert found[1] < found[8] and found[8] >= 0.9 and found[55] == 1.0
    exact = {tuple(r) for r in knn.batch_search(table, asked, 5).select("query_id", "rank", "index").collect()}
    assert exact == {tuple(r) for r in vector_index.search(spark, path, asked, 5, probes=999).select("query_id", "rank", "index").collect()}
    empty = str(tmp_path / "empty")
    assert vector_index.build(table.where("vec_id = 5000"), empty) == 0 and vector_index.search(spark, empty, asked).count() == 0


def test_vector_index_takes_any_number_of_queries(spark, tmp_path, monkeypatch):
    m = np.random.default_rng(6).standard_normal((300, 8)).astype("float32")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([m, m]))], "vec_id long, embedding array<float>")
    path = str(tmp_path / "index")
    vector_index.build(table, path)
    asked = table.where("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    few = {p: vector_index.search(spark, path, asked, 5, probes=p).collect() for p in (2, 999)}
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 50)  # 120 queries
    monkeypatch.setattr(knn, "BLOCK_ROWS", 7)
    for p, want in few.items():
        assert len(want) == 600 and set(want) == set(vector_index.search(spark, path, asked, 5, probes=p).collect())
    assert set(few[999]) == set(knn.batch_search(table, asked, 5).collect())


def test_vector_store_tables(spark, tmp_path):
    spark.createDataFrame([(1, "[0.5,1.0]"), (2, None)], "id long, embedding string").write.parquet(str(tmp_path / "t"))
    got = {r["vec_id"]: r["embedding"] for r in vector_store.read_table(spark, str(tmp_path / "t")).collect()}
    assert got == {1: [0.5, 1.0], 2: None}
    answers = spark.createDataFrame([(1, 0.25)], "id long, distance double")
    assert [tuple(r) for r in vector_store.results(answers).collect()] == [(0, 0.75)]


def test_batches_equal_single_searches(spark):
    docs, queries, _ = synthetic.dataset(spark, 12)
    docs = docs.select("index", "document")
    asked = {r["query_id"]: r["query"] for r in queries.collect()}
    w = projection.sign_map()
    for many, one in (
        (projection.batch_search(docs, asked, w, 5), lambda q: projection.search(docs, q, w, 5)),
        (neural.batch_search(docs, asked, 5), lambda q: neural.search(docs, q, 5)),
    ):
        rows = {(r["query_id"], r["rank"]): (r["index"], r["score"]) for r in many.collect()}
        for i, q in asked.items():
            want = one(q).orderBy("rank").collect()
            assert [rows[i, r["rank"]][0] for r in want] == [r["index"] for r in want]
            assert all(abs(rows[i, r["rank"]][1] - r["score"]) < 1e-9 for r in want)


def test_models_by_plain_sums():
    def bits(g):
        d = hashlib.md5(g.encode()).hexdigest()
        return [1.0 if int(d[j // 4], 16) >> (3 - j % 4) & 1 else -1.0 for j in range(64)]

    v = np.zeros(64)
    for w in ("ecole", "ab", "ab"):
        grams = [w, *(f"<{w}>"[j : j + 3] for j in range(len(w)))]
        v += np.mean([bits(g) for g in grams], axis=0)
    assert np.allclose(models.HashEmbedder().embed(["École, ab x ab!"])[0], v / np.linalg.norm(v))
    assert not models.HashEmbedder().embed([""]).any()
    with pytest.raises(RuntimeError, match="fastembed"):
        models.FastEmbedder().embed(["a"])
    with pytest.raises(RuntimeError, match="sentence_transformers"):
        models.CrossEncoderScorer().score("a", ["b"])


def test_engine_forgets_what_it_was_not_told_to_keep(spark, tmp_path):
    a, _, _ = synthetic.dataset(spark, 12)
    a = a.select("index", "document")
    other = ["some other words here", "cargo of another kind", "vessel and anchor"] * 4
    fresh = [tuple(r)[:3] for r in SearchEngine(spark, "projection").search("cargo vessel", a, 5).collect()]
    engine = SearchEngine(spark, "projection")
    engine.search("cargo vessel", other, 3).collect()
    assert [tuple(r)[:3] for r in engine.search("cargo vessel", a, 5).collect()] == fresh
    engine.train(other, model_path=str(tmp_path / "w"))
    stored = SearchEngine(spark, "projection", model_path=str(tmp_path / "w"))
    want = [tuple(r)[:3] for r in engine.search("cargo vessel", a, 5).collect()]
    assert [tuple(r)[:3] for r in stored.search("cargo vessel", a, 5).collect()] == want
    held.release()
    assert not held._HELD


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
