"""Random forest with balanced class weights on a chronological split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions.metrics import predicted


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``(target, n, weight)``: n / (2 n_c) for each class."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    # One row with the number of rows.
    return counts.join(F.broadcast(total)).select(target, "n", (F.col("total") / (2.0 * F.col("n"))).alias("weight"))


def fit(train: DataFrame, features: Sequence[str], target: str, trees: int = 500, depth: int = 5, min_leaf: int = 2, seed: int = 42, max_bins: int = 256) -> RandomForestClassificationModel:
    """A forest on weighted rows.

    A feature is cut at ``max_bins`` quantiles of its values, or at all of them where it has fewer.
    A small table should come in one partition, then refits agree.
    """
    # Two classes.
    weighted = train.join(F.broadcast(class_weights(train, target).drop("n")), target)
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(weighted)
    forest = RandomForestClassifier(labelCol=target, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(ready)


def forecast(model: RandomForestClassificationModel, df: DataFrame, features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Adds ``prob`` of the positive class and ``pred``; rows keep their keys."""
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    scored = model.transform(ready).withColumn("prob", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction").withColumn("pred", predicted(F.col("prob"), threshold))


def importance(model: RandomForestClassificationModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)``, the largest first."""
    values = model.featureImportances.toArray().tolist()
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in zip(features, values, strict=True)])
    return df.sparkSession.range(1).select(F.explode(entries).alias("e")).select("e.*").orderBy(F.desc("importance"), "feature")


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved forest as a table: ``(tree, node, feature, cut, left, right, gain, weight, shares)``.

    A row for each node; ``feature`` counts from 0, rows with values up to ``cut`` go ``left``.
    ``weight`` is the training weight that reached the node and ``shares`` how it falls on the
    classes.  Leaves have no feature, cut, children and gain.
    """
    n = F.col("nodeData")
    inner = n.leftChild >= 0
    weight = F.aggregate(n.impurityStats, F.lit(0.0), lambda a, x: a + x)
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n.id.alias("node"),
        F.when(inner, n.split.featureIndex).alias("feature"),
        F.when(inner, F.get(n.split.leftCategoriesOrThreshold, F.lit(0))).alias("cut"),
        F.when(inner, n.leftChild).alias("left"),
        F.when(inner, n.rightChild).alias("right"),
        F.when(inner, n.gain).alias("gain"),
        weight.alias("weight"),
        n.impurityStats.alias("stats"),
    )
    return rows.withColumn("shares", F.transform("stats", lambda x: x / F.col("weight"))).drop("stats")


def score_nodes(nodes: DataFrame, df: DataFrame, key: Sequence[str], features: Sequence[str], depth: int) -> DataFrame:
    """``key`` and ``prob`` of the positive class, by a join with the table of nodes for each level.

    The keys tell rows apart.  A forest has at most trees * 2 ** (depth + 1) nodes, whatever it was
    trained on, so the table is broadcast; a row's trees stay in its task, and are summed there.
    """
    known = F.broadcast(nodes.select("tree", F.col("node").alias("_node"), "feature", "cut", "left", "right"))
    roots = F.broadcast(nodes.filter("node = 0").select("tree"))
    values = F.array(*[F.col(f).cast("double") for f in features])
    at = df.select(*key, values.alias("_x"), F.lit(0).alias("node")).join(roots)
    for _ in range(depth):
        at = at.join(known.withColumnRenamed("tree", "_tree"), (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")))
        step = F.when(F.col("left").isNull(), F.col("node")).when(F.get("_x", F.col("feature")) <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
        at = at.select(*key, "_x", "tree", step.alias("node"))
    leaves = F.broadcast(nodes.select("tree", "node", F.get("shares", F.lit(1)).alias("share")))
    return at.join(leaves, ["tree", "node"]).groupBy(*key).agg(F.avg("share").alias("prob"))


def node_importance(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)``, the largest first: each tree's gains by weight, as shares of the tree's, averaged."""
    gains = nodes.filter("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    trees = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
    shares = gains.join(trees, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    names = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(f).alias("name")) for k, f in enumerate(features)])
    # A row for each feature.
    all_ = nodes.sparkSession.range(1).select(F.explode(names).alias("n")).select("n.*").join(shares, "feature", "left").na.fill(0.0, ["share"])
    total = F.sum("share").over(Window.partitionBy(F.lit(0)))
    return all_.select(F.col("name").alias("feature"), F.coalesce(F.try_divide("share", total), F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")
