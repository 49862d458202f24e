"""Open attributes: getters over any kind of value, keys that are added, and a CSV of the keys found."""

from pyspark.sql import functions as F

from roadtrace.functions import attributes as A
from roadtrace.sources import egress


def made(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, json string").withColumn("attributes", A.parsed(F.col("json")))


def test_getters(spark):
    a = F.col("attributes")
    df = made(spark, '{"x": 7}', '{"x": 7.9}', '{"x": "12"}', '{"x": "no"}', '{"x": true}', '{"x": null}', "{}", None, "[1]", "{broken", '{"x": "TRUE"}')
    rows = df.select("id", A.text(a, "x"), A.number(a, "x"), A.whole(a, "x", -1), A.flag(a, "x"), A.number(a, "x", None)).orderBy("id").collect()
    assert [r[1] for r in rows] == ["7", "7.9", "12", "no", "true", None, None, None, None, None, "TRUE"]
    assert [r[2] for r in rows][:4] == [7.0, 7.9, 12.0, None] and [r[2] for r in rows][5:10] == [0.0] * 5
    assert [r[3] for r in rows][:4] == [7, 7, 12, None] and [r[3] for r in rows][5:10] == [-1] * 5
    assert [r[4] for r in rows] == [False] * 4 + [True] + [False] * 5 + [True]
    assert [r[5] for r in rows][5:10] == [None] * 5


def test_put(spark):
    a = F.col("attributes")
    df = made(spark, '{"x": 1, "y": "b"}', None).withColumn("attributes", A.put(A.put(A.put(a, "x", F.lit(2.5)), "z", F.lit("new")), "y", F.lit(None).cast("string")))
    got = df.select(A.number(a, "x"), A.text(a, "y"), A.text(a, "z"), F.array_sort(F.map_keys("attributes"))).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(2.5, "b", "new", ["x", "y", "z"]), (2.5, None, "new", ["x", "z"])]


def test_csv_of_the_keys_found(spark):
    df = made(spark, '{"b": "=1+1", "a": -3}', '{"c": "p, \\"q\\"", "b": "  t "}', None, '{"a": 1.0, "d": [1, 2]}').withColumn("name", F.lit(" -x"))
    lines = {r.id: r.line for r in egress.csv_open(df, ["id", "name"]).collect()}
    assert lines == {None: "id,name,a,b,c,d", 0: "0,,-3,,,", 1: '1,,,t,"p, ""q""",', 2: "2,,,,,", 3: '3,,1.0,,,"[1,2]"'}
    none = made(spark, None, "{}").where("id < 0")
    assert [tuple(r) for r in egress.csv_open(none, ["id"]).collect()] == [(None, "id")]
