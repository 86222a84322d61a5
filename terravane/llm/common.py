"""What several corpus operators share: written stages, literal tables, connected components."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Settings while a stage is written: its shuffle files go when it is a table, and batches of long texts stay small.
STAGE_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only where the setting is
    absent, as in local tests, a temporary folder of this machine is used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="terravane-")
    return f"{root.rstrip('/')}/terravane-{uuid.uuid4().hex}"


@contextmanager
def stage_settings(spark: SparkSession) -> Iterator[None]:
    """STAGE_SETTINGS within the block, and what was there before after it."""
    before = {k: spark.conf.get(k, None) for k in STAGE_SETTINGS}
    for k, v in STAGE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write_stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    with stage_settings(spark):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def drop_stages(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes written stages that nothing reads any more."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def literal_table(spark: SparkSession, schema: str, rows: Sequence[dict]) -> DataFrame:
    """A small table from driver values, as a literal in the plan."""
    parsed = F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def lower_az(word: Column) -> Column:
    """A word with A-Z lower-cased and every other letter as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # lower() does just that where all characters are single bytes, and is much faster.
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


#: CRC-32 in SQL for the independent engine: a table of 256 remainders, and the unsigned checksum of a word's UTF-8 bytes.
CRC_TABLE_SQL = "crc_table AS (SELECT list(r ORDER BY n) AS t FROM (SELECT n.range AS n, list_reduce([n.range, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) n))"


def crc_sql(word: str) -> str:
    """The checksum of an expression, in a query that also reads ``crc_table``."""
    octets = f"list_transform(range(1, strlen({word}) + 1), lambda i: ('0x' || substr(hex(encode({word})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, so that operators do not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def with_fields(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


class Hidden:
    """A table under column names that no operator uses; ``restore`` gives them back."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.df = df.toDF(*[f"_c{i}" for i in range(len(self.names))])

    def __call__(self, name: str) -> str:
        """The present name of a column; exact names come before those in another case."""
        same = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name}")
        return f"_c{same[0]}"

    def columns(self, names: Sequence[str] | None = None) -> list[str]:
        """The present names of the columns asked for, by default all."""
        return [self(n) for n in names] if names is not None else self.df.columns

    def restore(self, df: DataFrame, *results: str, names: Sequence[str] | None = None) -> DataFrame:
        """The columns asked for, as they were called, and the results, which take the place of columns so called."""
        made = {r.lower() for r in results}
        back = [(h, self.names[int(h[2:])]) for h in self.columns(names)]
        return df.select(*[F.col(h).alias(n) for h, n in back if n.lower() not in made], *results)


def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """Connected components of the undirected edges ``(a, b)``, as ``(node, component)``.

    ``component`` is the smallest node of the component; nodes without edges are absent.
    Alternates large-star and small-star steps, each of them two aggregations and joins on the
    edges, so no neighbourhood is ever gathered in one task.  Every round is written to the
    shared folder.  The rounds grow as the logarithm of the longest path, and end as soon as the
    edges are stars: the driver keeps a thread for every exchange of the last minute, so a round
    that would only show that nothing changes is not run, and the joins do without broadcasts.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b")
        if large:
            both = both.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least.hint("merge"), "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def settled(pairs: DataFrame) -> bool:
        """Whether every node has one edge to a smaller node, which has none itself: then that is the component's smallest."""
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()

    now, k = write_stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0"), 0
    while not settled(now):
        k += 1
        now = write_stage(star(star(now, True), False), folder, f"{name}-{k}")
        drop_stages(spark, folder, f"{name}-{k - 1}")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b"), F.col("b")).distinct())
