"""running_totals equals a single global window, also with heavy ties and a hot value."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialsift.operators.ordered import running_totals, sliced


def _frame(spark, n=3000, hot_share=0.34, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        g = "a" if k % 3 else "b"
        s = 0.5 if rnd.random() < hot_share else round(rnd.random(), 2)  # a third of rows share one score
        rows.append((g, k, s, int(rnd.random() < 0.2)))
    return spark.createDataFrame(rows, "g string, key long, score double, y int")


def test_matches_single_window(spark):
    df = _frame(spark)
    order = [F.col("score").desc(), F.col("key").asc()]
    got = running_totals(df, order, ["g"], {"cum": F.col("y")}, num_slices=5, totals_prefix="t_")
    w = Window.partitionBy("g").orderBy(*order)
    ref = df.withColumn("r2", F.row_number().over(w)).withColumn(
        "c2", F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    j = got.join(ref.select("key", "r2", "c2"), "key")
    assert j.count() == 3000
    assert j.where((F.col("rank") != F.col("r2")) | (F.col("cum") != F.col("c2"))).count() == 0
    tot = got.groupBy("g").agg(F.max("t_n").alias("n"), F.count("*").alias("c")).collect()
    assert all(r["n"] == r["c"] for r in tot)


def test_no_groups(spark):
    df = _frame(spark, 1000, 0.5, 2)
    got = running_totals(df, [F.col("score").asc(), F.col("key").asc()], [], num_slices=4)
    ranks = sorted(r["rank"] for r in got.select("rank").collect())
    assert ranks == list(range(1, 1001))


def test_one_exchange_of_the_rows_before_they_are_written(spark):
    """The plan that is materialised has one exchange (the range split), no window and no single task."""
    df = _frame(spark)
    plan = sliced(df, [F.col("score").desc(), F.col("key").asc()], ["g"], {"cum": F.col("y")}, 5)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") == 1 and "rangepartitioning" in initial
    assert "Window" not in initial and "SinglePartition" not in initial


def test_offsets_join_is_a_broadcast(spark):
    df = _frame(spark)
    out = running_totals(df, [F.col("score").desc(), F.col("key").asc()], ["g"], {"cum": F.col("y")}, num_slices=5)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_clashing_column_names(spark):
    df = _frame(spark, 200).withColumns({"_pos": F.lit(1), "_n": F.lit(2), "_first": F.lit(3)})
    got = running_totals(df, [F.col("score").asc(), F.col("key").asc()], [], {"_cum": F.col("y")}, num_slices=3)
    assert set(df.columns) < set(got.columns) and got.agg(F.max("rank")).first()[0] == 200
