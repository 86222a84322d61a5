"""WARC archives: writing, and normalising monolithic gzip files to one member for each record.

A monolithic archive is one gzip stream over all records, so nothing in it can be reached without
inflating everything before.  The normaliser inflates each such file once, as a stream, writes
every record as a gzip member of its own, and a sidecar index of offsets and lengths, with which
a record is read by one seek.

Archives live in the shared folder and are reached through Arrow's file systems, so any store
they know will do.  A file is written under a name of its attempt and then moved to its final
name, so a repeated or speculative task replaces a file by an equal one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import shared_folder, write_stage

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 1000
READ = 1 << 18
MOST_TASKS = 20_000
#: Compression of the monolithic files and of the members.
FAST, GOOD = 1, 4
_END = b"\r\n\r\n"


def urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(name: str) -> int | None:
    number = name[len("<urn:page:") : -1]
    return None if number == "none" else int(number)


def record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has no payload of its own but names the record that has it."""
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    body = b"" if revisit else payload
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + _END + body + _END


def headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the pieces of an inflated archive; holds one record at a time."""
    have = bytearray()
    need = None
    for part in parts:
        have += part
        while True:
            if need is None:
                cut = have.find(_END)
                if cut < 0:
                    break
                need = cut + len(_END) + int(headers(bytes(have[:cut]))["Content-Length"]) + len(_END)
            if len(have) < need:
                break
            yield bytes(have[:need])
            del have[:need]
            need = None
    if have:
        raise ValueError(f"the archive ends within a record, after {len(have)} bytes of it")


def inflated(file) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in pieces of bounded size."""
    machine = zlib.decompressobj(31)
    while data := file.read(READ):
        while data:
            yield machine.decompress(data, READ)
            data = machine.unconsumed_tail
            if machine.eof:
                data, machine = machine.unused_data, zlib.decompressobj(31)


class _Output:
    """A file that appears under its name when it is whole."""

    def __init__(self, where: str) -> None:
        self.system, self.path = fs.FileSystem.from_uri(where)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.file, self.at = self.system.open_output_stream(self.own), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.file.close()
        self.system.move(self.own, self.path)


def _write(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        out, count = None, 0
        machine = zlib.compressobj(FAST, zlib.DEFLATED, 31)
        for batch in batches:
            for page, url, payload, digest, refers in zip(*[batch.column(c) for c in ("page", "url", "payload", "digest", "refers_to")], strict=True):
                out = out or _Output(name)
                out.write(machine.compress(record(page.as_py(), url.as_py(), payload.as_py(), bytes.fromhex(digest.as_py()), refers.as_py())))
                count += 1
        if out:
            out.write(machine.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])

    return work


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (page, url, payload, digest, refers_to) to one monolithic archive a partition: (file, records)."""
    return pages.mapInArrow(_write(folder), "file string, records long")


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, wanted in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
            target = source.removesuffix(".warc.gz") + "-members.warc.gz"
            system, path = fs.FileSystem.from_uri(source)
            out, side = _Output(target), _Output(target + ".idx")
            ids, offsets, lengths = [], [], []
            with system.open_input_stream(path, compression=None) as file:
                for one in records(inflated(file)):
                    page = headers(one[: one.find(_END)])["WARC-Record-ID"]
                    member = gzip.compress(one, GOOD, mtime=0)
                    ids.append(page_of(page))
                    offsets.append(out.at)
                    lengths.append(len(member))
                    side.write(f"{page}\t{out.at}\t{len(member)}\n".encode())
                    out.write(member)
            out.close()
            side.close()
            if len(ids) != wanted:
                raise ValueError(f"{source} holds {len(ids)} records, not {wanted}")
            yield pa.RecordBatch.from_arrays([pa.array([target] * len(ids)), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["file", "page", "offset", "length"])


def normalise(files: DataFrame) -> DataFrame:
    """Rewrites the archives (file, records) with a member for each record: (file, page, offset, length)."""
    return files.mapInArrow(_normalise, "file string, page long, offset long, length long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads records by the index; neighbours in a file share an open handle."""
    name, file = None, None
    for batch in batches:
        out: list[tuple] = []
        for source, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
            if source != name:
                system, path = fs.FileSystem.from_uri(source)
                name, file = source, system.open_input_file(path)
            file.seek(offset)
            one = gzip.decompress(file.read(length))
            cut = one.find(_END)
            head, body = headers(one[:cut]), one[cut + len(_END) : -len(_END)]
            kind, refers = head["WARC-Type"], head.get("WARC-Refers-To")
            digest, size = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex(), int(head["WARC-Payload-Length"])
            if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
                raise ValueError(f"a payload in {source} at {offset} is not the one written")
            out.append((page_of(head["WARC-Record-ID"]), size, digest, kind, page_of(refers) if refers else None, body))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index (file, offset, length), digests of responses checked."""
    return index.mapInArrow(_read, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def deduplicated(pages: DataFrame, page: str, payload: Column, url: Column) -> DataFrame:
    """(page, url, payload, digest, refers_to): which records revisit one with an equal payload.

    Of equal payloads of LEAST_REVISIT bytes and more the largest page number keeps it.  Only
    digests and numbers are shuffled to find it, pre-aggregated, whatever the payloads' sizes.
    """
    made = pages.select(F.col(page).cast("long").alias("page"), url.alias("url"), payload.alias("payload"))
    made = made.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= LEAST_REVISIT
    holders = made.filter(long).groupBy("digest").agg(F.max("page").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Both sides are dealt by digest, payloads with theirs; the few holders are hashed, so payloads are not sorted.
    joined = made.join(holders.withColumnRenamed("digest", "same").hint("shuffle_hash"), long & (F.col("digest") == F.col("same")), "left")
    return joined.select("page", "url", "payload", "digest", F.when(F.col("page") != F.col("holder"), F.col("holder")).alias("refers_to"))


def archive_round_trip(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """Archives pages, normalises the archives, reads them back: (records, folder of the archives).

    A null html is an empty payload, a null url gives a record without target, a null page
    number a record that none refers to unless all of its payload are such.  Repeated rows have a record each; of equal
    payloads with equal largest numbers all those are responses.  An empty table gives no files.
    """
    folder = shared_folder(pages.sparkSession)
    target = F.col(url) if url in pages.columns else F.lit(None).cast("string")
    made = deduplicated(pages, page, F.coalesce(F.encode(html, "UTF-8"), F.lit(b"")), target)
    files = write_stage(write_archives(made, f"{folder}/archives"), folder, "files")
    # A file is one task's work, so the few rows that name files are dealt out one by one.
    tasks = max(1, min(files.count(), MOST_TASKS))
    index = write_stage(normalise(files.repartition(tasks)), folder, "index")
    return read_records(index.repartition(tasks, "file").sortWithinPartitions("file", "offset")), folder
