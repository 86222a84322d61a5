"""Beginnings and digests of files of any size, read in ranges of bytes.

A file's content never is a value of a row: tasks read blocks of files, as streams, and give what
is asked of them.  So files beyond the size of a row can be sniffed, verified, and a damaged block
found, and a large file is the work of many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a block, of a task, and of one read.
BLOCK, TASK, READ = 64 << 20, 256 << 20, 4 << 20


@dataclass
class Ranges(InputPartition):
    """Blocks for one task: (path, file's size, number of the block, offset, length)."""

    blocks: list[tuple[str, int, int, int, int]]


def planned(files: list[tuple[str, int]], block: int, task: int) -> list[Ranges]:
    """The blocks of files dealt out to tasks of about ``task`` bytes; an empty file has one empty block."""
    out, now, filled = [], [], 0
    for path, size in sorted(files):
        for k in range(max(1, -(-size // block))):
            length = min(block, size - k * block)
            # An opened file costs something even if it is small.
            if now and filled + length > task:
                out.append(Ranges(now))
                now, filled = [], 0
            now.append((path, size, k, k * block, length))
            filled += max(length, task // 1024)
    return [*out, Ranges(now)] if now else out


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.block, self.task, self.head = (int(options.get(name, default)) for name, default in (("block", BLOCK), ("task", TASK), ("head", 16)))
        self.digest = options.get("digest", "true").lower() == "true"

    def partitions(self) -> list[Ranges]:
        from fnmatch import fnmatch

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda name: name.startswith(("_", "."))
        return planned([(f.path, f.size) for f in found if f.is_file and not hidden(f.base_name) and fnmatch(f.base_name, self.pattern)], self.block, self.task)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for path, size, block, offset, length in partition.blocks:
            head, digest, left = b"", hashlib.sha256(), length
            with system.open_input_file(path) as file:
                file.seek(offset)
                if block == 0:
                    head = file.read(min(self.head, size))
                    file.seek(0)
                while self.digest and left:
                    part = file.read(min(READ, left))
                    if not part:
                        raise OSError(f"{path} ends before byte {offset + length}")
                    digest.update(part)
                    left -= len(part)
            yield path, size, block, offset, length, head if block == 0 else None, digest.hexdigest() if self.digest else None


class FileBlocks(DataSource):
    """``spark.read.format("file_blocks").option("path", uri)``; see ``file_blocks``."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return "path string, size long, block long, offset long, length long, head binary, sha256 string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


def file_blocks(spark: SparkSession, path: str, pattern: str = "*", block: int = BLOCK, digest: bool = True) -> DataFrame:
    """A row for each block of the files below a URI: ``(path, size, block, offset, length, head, sha256)``.

    ``head`` holds the first bytes of a file, in its block 0; ``sha256`` is that of the block, null
    without ``digest``, when only beginnings are read.  Files whose names begin with ``_`` or ``.``
    are left out.  The URI may be of any file system that Arrow opens, on driver and executors.
    """
    spark.dataSource.register(FileBlocks)
    return spark.read.format("file_blocks").options(path=path, pattern=pattern, block=str(block), digest=str(digest)).load()


def heads(blocks: DataFrame) -> DataFrame:
    """``(path, length, content)`` with a file's beginning as its content, for ``evidence.sniffed``."""
    return blocks.filter("block = 0").select("path", F.col("size").alias("length"), F.col("head").alias("content"))


def verified_blocks(have: DataFrame, want: DataFrame, key: str = "path") -> DataFrame:
    """For each file: ``status`` (equal, changed, missing or extra) and the ``damaged`` blocks by number.

    Files are compared block by block, so a single changed block is named; a file that has grown or
    shrunk is changed, and its blocks beyond the other's are damaged too.
    """
    sides = [t.select(key, "block", F.col("sha256").alias(n)) for t, n in ((have, "have"), (want, "want"))]
    joined = sides[0].join(sides[1], [key, "block"], "full_outer")
    differs = ~F.col("have").eqNullSafe(F.col("want"))
    # Numbers of damaged blocks only: a list of them is small beside the file.
    out = joined.groupBy(key).agg(F.count("have").alias("n_have"), F.count("want").alias("n_want"), F.sort_array(F.collect_list(F.when(differs, F.col("block")))).alias("damaged"))
    status = F.when(F.col("n_have") == 0, "missing").when(F.col("n_want") == 0, "extra").when(F.size("damaged") == 0, "equal").otherwise("changed")
    return out.select(key, status.alias("status"), "damaged")
