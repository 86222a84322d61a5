"""Bootstrap intervals of F1 that every engine and every rerun draws alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.metrics import cells, ratio

#: Rows drawn one after the other by one task.
STRIDE = 4096


def draws(df: DataFrame, replicates: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """Outcome counts and F1 of resamples with replacement, each as large as the table: ``(b, tp, fp, fn, f1)``.

    F1 depends on a row's outcome only.  With the rows thought in the order tp, fp, fn, tn a draw
    is a number below their count, and its outcome follows from three cumulative counts, so the
    rows themselves are read once and never joined.  Draw i of replicate b is the first 15 hex
    digits of md5("b-i") modulo the count.
    """
    spark = df.sparkSession
    c = df.agg(*[v.alias(k) for k, v in cells(F.col(y), F.col(pred)).items()])
    c = c.select("tp", (F.col("tp") + F.col("fp")).alias("c2"), (F.col("tp") + F.col("fp") + F.col("fn")).alias("c3"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))
    # One row of four counts.
    plan = spark.range(replicates).withColumnRenamed("id", "b").join(F.broadcast(c)).filter("n > 0")
    parts = plan.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRIDE))))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b", "part")
    each = parts.withColumn("i", F.explode(F.sequence(F.col("part") * STRIDE, F.least((F.col("part") + 1) * STRIDE, F.col("n")) - 1)))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("b").cast("string"), F.col("i").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % F.col("n")
    each = each.withColumn("d", drawn)
    sums = each.groupBy("b").agg(
        F.count_if(F.col("d") < F.col("tp")).alias("tp"),
        F.count_if((F.col("d") >= F.col("tp")) & (F.col("d") < F.col("c2"))).alias("fp"),
        F.count_if((F.col("d") >= F.col("c2")) & (F.col("d") < F.col("c3"))).alias("fn"),
    )
    return sums.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def interval(drawn: DataFrame, levels: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Exact percentiles of F1 over the replicates: ``(level, f1)``."""
    at = F.array(*[F.lit(q) for q in levels])
    return drawn.agg(F.percentile("f1", at).alias("p")).select(F.posexplode("p").alias("k", "f1")).select(at[F.col("k")].alias("level"), "f1")
