"""Readers and writers of tables at the edges; Parquet is used between stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


@lru_cache(maxsize=1)
def _local_root() -> str:
    """A temporary folder of this machine, gone when the process ends."""
    path = tempfile.mkdtemp(prefix="terravane-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; of this machine only where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{(root or _local_root()).rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in a scratch folder, for what is read several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | StructType, provenance: bool = False) -> DataFrame:
    """CSV files with a header and a declared schema; a row that does not fit is an error."""
    out = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nanValue", "NaN").csv(path)
    return out.withColumn("source_file", F.col("_metadata.file_name")) if provenance else out


def read_tsv(spark: SparkSession, path: str, schema: str | StructType, key: str | None = None, header: bool = True) -> DataFrame:
    """Evidence tables.

    A row that does not fit keeps what could be read of it, and its text as ``_corrupt_record``,
    which is null in all others; see ``corrupt``.  With ``key`` rows go whose key is missing or a
    repeated header, but those that do not fit stay.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fields = StructType([*fields.fields, *StructType.fromDDL("_corrupt_record STRING").fields])
    reader = spark.read.schema(fields).option("header", header).option("sep", "\t").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    out = reader.option("enforceSchema", True).csv(path)
    keyed = F.col("_corrupt_record").isNotNull() | (F.col(key).isNotNull() & (F.col(key).cast("string") != key)) if key else F.lit(True)
    return out.filter(keyed)


def corrupt(rows: DataFrame) -> DataFrame:
    """``(rows, corrupt)``: how many rows of an evidence table there are, and how many do not fit."""
    return rows.agg(F.count("*").alias("rows"), F.count("_corrupt_record").alias("corrupt"))


def read_json_document(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A file that is one JSON document, as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pixels(df: DataFrame, path: str, block: int = 512) -> None:
    """Pixels as Parquet in blocks of the grid, so that windowed reads open few files."""
    blocks = df.withColumn("block_row", F.floor(F.col("row") / block).cast("int")).withColumn("block_col", F.floor(F.col("col") / block).cast("int"))
    blocks.repartition("block_row", "block_col").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("block_row", "block_col").option("compression", "zstd").parquet(path)


def in_file_order(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """Rows of a Parquet scan with their place in its files: by file path, and by row within a file.

    The place is a whole number that grows with both, and is not gapless.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    placed = rows.withColumns({"_file": file, "_row": row})
    # A row for each file.
    paths = placed.select("_file").distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file")).cast("long"))
    return placed.join(paths, "_file").withColumn(name, F.shiftleft("_number", 40) + F.col("_row")).drop("_file", "_row", "_number")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder with their content: (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def first_file(spark: SparkSession, path: str, pattern: str) -> str:
    """The first path in code point order; raises if there is none."""
    found = files(spark, path, pattern).agg(F.min("path").alias("path")).first().path
    if found is None:
        raise FileNotFoundError(f"no {pattern} in {path}")
    return found


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table from values."""
    return spark.createDataFrame(list(rows), schema)
