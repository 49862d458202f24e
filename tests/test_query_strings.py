"""Query strings: each step of their reading stands once in the plan, and odd strings give what they gave."""

from pyspark.sql import functions as F

from roadtrace.functions import frames


def test_steps_are_evaluated_once(spark):
    df = spark.createDataFrame([("id=1&lat=2&lon=3",)], "q string").select(frames.query_fields(F.col("q")).alias("x"))
    shown = df.select(*frames.fields_of(F.col("x")).values())
    text = shown._jdf.queryExecution().optimizedPlan().toString()
    assert text.lower().count("regexp_replace(q") <= 1


def test_odd_strings(spark):
    rows = ["?id=a&id=b&x=1&x=2&timestamp=1700000000", "deviceid=z&timestamp=1700000000123&location=1.5%2C-2&valid=0", None, "", "&&=3&lat=%zz&lon&speed=abc", "timestamp=2024-01-02T03:04:05Z&heading=7&bearing=&altitude=1e2"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, q string")
    one = df.select("i", frames.query_fields(F.col("q")).alias("x")).select("i", "x.*").orderBy("i").collect()
    other = df.select("i", *[c.alias(n) for n, c in frames.query_string(F.col("q")).items()]).orderBy("i").collect()
    assert one == other
    assert [r.unique_id for r in one] == ["b", "z", None, None, None, None] and [r.fix_ms for r in one] == [1_700_000_000_000, 1_700_000_000_123, None, None, None, 1_704_164_645_000]
    assert [r.valid for r in one] == [True, False, None, True, True, True] and (one[1].latitude, one[1].longitude) == (1.5, -2.0)
    assert one[0].attributes == {"x": "2"} and one[2].attributes is None and one[3].attributes == {} and (one[5].course, one[5].altitude) == (7.0, 100.0)
