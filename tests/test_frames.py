import subprocess
import sys

from pyspark.sql import functions as F

from loomquery import dbapi
from loomquery.functions.columns import Lit, call
from loomquery.operators import relational as R
from loomquery.streaming import events


def test_columns(spark):
    df = spark.createDataFrame([("abc", [1, 2])], "s string, a array<int>")
    out = df.select(call("LPAD", "s", 5, Lit("*")).alias("p"), call("LENGTH", "a", kinds={"a": "array"}).alias("n"), call("TITLE", "s").alias("t")).first()
    assert tuple(out) == ("**abc", 2, "Abc")


def test_operators(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 2), (None, "d", 5)], "k long, v string, o long")
    assert {r.v for r in R.distinct_on(df, ["k"], F.col("o")).collect()} == {"b", "c", "d"}
    assert R.distinct_on(df, ["k"]).count() == 3
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k long, w string")
    assert R.semi(df, right, ["k"]).count() == 2 and R.anti(df, right, ["k"]).count() == 2
    assert sorted(map(tuple, R.salted_join(df, right, ["k"]).select("v", "w").collect())) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    assert R.salted_join(df, right, ["k"], how="left").count() == 6
    assert {(r.k, r.s, r.n) for r in R.two_step(df, ["k"], {"s": ("sum", "o"), "n": ("count", "o")}).collect()} == {(1, 4, 2), (2, 2, 1), (None, 5, 1)}
    assert [r.v for r in R.top_k(df, 2, F.desc("o")).collect()] == ["d", "a"]
    lists = spark.createDataFrame([(1, [1, 1, 2]), (2, []), (3, None)], "k long, a array<int>")
    assert R.unnest(lists, "a", "e", F.col("e") < 2, distinct=True).count() == 1
    assert df.agg(R.product("o").alias("p")).first().p == 30.0


def test_dbapi(spark):
    c = dbapi.connect(spark).cursor().execute("SELECT id, name FROM $planets WHERE id < :n ORDER BY id", {"n": 4})
    assert c.description[1][0] == "name" and c.fetchone() == (1, "Mercury") and c.fetchmany(1) == [(2, "Venus")] and c.fetchall() == [(3, "Earth")] and c.fetchone() is None


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, "click", 1.0, "{}") for i in range(40)] + [(0, "2024-01-01 00:00:00", 0, "click", 1.0, "{}"), (99, "2024-01-02 00:00:00", 1, "view", 2.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make in (("w", events.windowed), ("s", events.sessions), ("d", events.deduplicated)):
        q = make(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"t_{name}").option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("t_w").collect()) == [10, 15, 16]
    assert sum(r.n for r in spark.table("t_s").collect()) == 41
    assert spark.table("t_d").count() == 41


def test_entry_without_the_optional_folder(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "loomquery", tmp_path / "loomquery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_group_by' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
