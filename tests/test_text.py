import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomquery.functions import text as tx
from loomquery.functions import vectors as vx
from loomquery.plans import registry


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("x")).first()["x"]


def test_stems_follow_rule_order_and_minimum(spark):
    words = "used sing is studied trying dresses searching nation buildings".split()
    got = [r["s"] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(tx.stem("w").alias("s")).collect()]
    assert got == ["used", "sing", "is", "study", "try", "dress", "search", "nation", "build"]
    assert [tx._stem(w) for w in words] == got


def test_length_counts_only_spaces(spark):
    assert one(spark, tx.space_length("t"), t="a\nb c") == 2
    assert one(spark, tx.space_length("t"), t="") == 1


def test_substring_frequency_is_infix_and_does_not_overlap(spark):
    rows = spark.createDataFrame([("support",), ("port",), ("airport report",)], "t string").select(tx.substring_tf("t", "port").alias("n")).collect()
    assert [r["n"] for r in rows] == [1, 1, 2]
    assert one(spark, tx.substring_tf("t", "aaa"), t="aaaa") == 1


def test_query_tokens_split_at_accents(spark):
    assert one(spark, tx.query_tokens("q"), q="Naïve café, C3PO!") == ["na", "ve", "caf", "c3po"]
    assert tx.stems_of("Tests tests testing") == ["tes", "test"]


def test_blank(spark):
    rows = spark.createDataFrame([("",), ("  ",), ("\t\n",), (None,), ("a",), (" ",)], "t string").select(tx.not_blank("t").alias("b")).collect()
    assert [r["b"] for r in rows] == [False, False, False, False, True, False]


def test_concat_keeps_the_space_of_a_missing_field(spark):
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert df.select(tx.concat_fields("x", "y", "z").alias("t")).first()["t"] == "a  3"
    assert tx.field_list(" a, b ,c") == ["a", "b", "c"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(vx.norm("a").alias("n"), vx.unit("a").alias("u"), vx.cosine("a", "z").alias("c"), vx.text_literal("a").alias("t"), vx.dot("a", "a").alias("d")).first()
    assert (r["n"], r["c"], r["t"], r["d"]) == (5.0, 0.0, "[3.000000,4.000000]", 25.0)
    assert [round(x, 6) for x in r["u"]] == [0.6, 0.8]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abcdeginrstuy", min_size=2, max_size=9), min_size=1, max_size=5))
def test_driver_and_column_stems_agree(spark, words):
    got = spark.createDataFrame([(" ".join(words),)], "q string").select(tx.query_stems("q").alias("s")).first()["s"]
    assert got == tx.stems_of(" ".join(words))


def test_stem_sql_equals_column(spark):
    words = [(w,) for w in "things relation mission darkness shipment readable flexible finally darling supposedly flying tried thing dated walked slowly over boxes cars cats pens beds is".split()]
    df = spark.createDataFrame(words, "w string").select(tx.stem("w").alias("a"), F.expr(tx.stem_sql("w")).alias("b"))
    assert df.where("a <> b").count() == 0


def test_vector_literals_equal_their_sql(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [
        [0.0078125, -0.0078125, 0.0234375, 1.0000005, 0.5], [3e38, 16777216.0, 1e15], [nan, -nan, inf, -inf], [-1e-9, -0.0, 1e-45],
        [None, 1.5, None], [None, None], [], None, [2.5],
    ]
    table = pa.table({"vec_id": pa.array(range(len(odd)), pa.int64()), "embedding": pa.array(odd, pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    got = {tuple(r) for r in registry.QUERIES["vector_literals"](spark, str(tmp_path)).select("vec_id", "literal").collect()}
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert got == set(con.sql(registry.ORACLE_SQL["vector_literals"]).fetchall())
    assert (0, "[0.007812,-0.007812,0.023438,1.000000,0.500000]") in got and (5, None) in got and (6, "[]") in got
