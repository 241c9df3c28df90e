import glob
import os
import shutil

from pyspark.sql import functions as F

from brindle.operators import admission as A
from brindle.operators import loading as L
from brindle.sources import stored as T

FIELDS = "url string, unit_text string, min_value long, max_value long, hours_per_week int, employment_type string"


def test_split_names_the_rules(spark):
    good = '{"url":"%s","unit_text":"HOUR","min_value":5,"max_value":6,"hours_per_week":40}'
    lines = [
        (1, good % "a"), (2, good % "a"), (3, '{"url":"b","unit_text":"DECADE","min_value":-1}'), (4, '{"url":"b","min_value":null}'), (5, '{"url":"c","unit_text":"DAY","min_value":0}'),
        (6, '{"url":"c","unit_text":"DAY","min_value":0,"employment_type":"STAGE"}'), (7, '{"url":"d","unit_text":"DAY","min_value":9,"max_value":8,"hours_per_week":81}'),
        (8, '{"url":"e","unit_t'), (9, None), (10, ""), (11, '{"url":"f","min_value":"x"}'), (12, "{}"), (13, "{}"), (14, good % "a"),
    ]
    df = spark.createDataFrame(lines, "k long, line string")
    parts = A.split(A.parsed(df, "line", FIELDS), A.pay_checks(), unique=["url"], order="k")
    got = {r.k: r.reason for r in A.statuses(parts, "k").collect()}
    want = {2: "conflict", 3: "unit,pair,zero", 5: "zero", 7: "range,hours", 8: "malformed", 9: "malformed", 10: "malformed", 11: "malformed", 14: "conflict"}
    assert got == {k: want.get(k) for k, _ in lines}
    assert parts.counts == {"rows": 14, "malformed": 4, "unit": 1, "pair": 1, "range": 1, "zero": 2, "hours": 1, "conflict": 2}
    assert {r["_raw"] for r in parts.rejected.where("k in (8, 9)").collect()} == {'{"url":"e","unit_t', ""}
    assert A.RAW not in parts.good.columns
    empty = A.split(A.parsed(df.limit(0), "line", FIELDS), A.pay_checks(), unique=["url"])
    assert empty.good.count() == 0 and empty.rejected.count() == 0


def test_restore_rows(spark, tmp_path):
    folder = str(tmp_path / "b")
    L.backup({"t": spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")}, folder)
    with open(f"{folder}/t/more.json", "w") as f:
        f.write('{"k":3,"s":"c"}\n{"k":oops\n{"k":1,"s":"again"}\n{"k":4,"s":null}\n')
    got = A.restore_rows(spark, folder, {"t": "k long, s string, made long", "gone": "k long"}, {"t": {"named": F.col("s").isNotNull()}}, {"t": ["k"]}, ["made"])
    assert list(got) == ["t"] and got["t"].good.columns == ["k", "s"]
    assert sorted(r.k for r in got["t"].good.collect()) == [1, 2, 3]
    assert got["t"].counts == {"rows": 6, "malformed": 1, "named": 1, "conflict": 1}


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/_slot=*/*.parquet")}


def test_only_changed_slots_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("v"), F.lit(None).cast("string").alias("s"))
    T.create(df, path, "k", 16)
    before = files(path)
    same = df.where("k < 400")
    assert T.upsert(spark, path, same, "k", 1, 16) == 0 and files(path) == before
    change = spark.createDataFrame([(7, 0.5, "x"), (7, 0.25, "y"), (8, 16.0, None), (None, 1.0, "n"), (5000, 1.0, "new")], "k long, v double, s string")
    hit = T.upsert(spark, path, change, "k", 5, 16)
    after = files(path)
    assert 1 <= hit <= 2
    kept = set(before) & set(after)
    assert all(before[p] == after[p] for p in kept) and len({os.path.dirname(p) for p in before if p not in kept}) == hit
    state = lambda: {r.k: (r.v, r.s) for r in T.rows(spark, path).collect()}
    want = {k: (k * 2.0, None) for k in range(1000)} | {7: (0.5, "x"), 5000: (1.0, "new")}
    assert state() == want
    late = spark.createDataFrame([(7, 9.0, "late")], "k long, v double, s string")
    assert T.upsert(spark, path, late, "k", 4, 16) == 0 and T.upsert(spark, path, change, "k", 5, 16) == 0 and state() == want and files(path) == after
    assert T.upsert(spark, path, change.limit(0), "k", 6, 16) == 0


def test_a_batch_that_died_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    T.create(df, path, "k", 4)
    change = df.where("k % 9 = 0").withColumn("v", F.lit("new"))
    T._prepare(spark, path, change, "k", 1, 4, f"{path}/_pending-1")
    shutil.rmtree(f"{path}/_slot=2")  # died after it took a slot away
    assert T.upsert(spark, path, change, "k", 1, 4) == 4
    assert {r.k: r.v for r in T.rows(spark, path).collect()} == {k: "new" if k % 9 == 0 else "old" for k in range(100)}
    assert not os.path.exists(f"{path}/_pending-1")
