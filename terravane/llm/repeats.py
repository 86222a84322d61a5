"""Exact removal of long repeated byte strings by content-defined phrases.

The idea is that of prefix-free parsing: a rolling hash of the text itself decides where phrases
begin, so equal passages are cut into equal phrases; the repetitive corpus then shrinks to a
dictionary of distinct phrases, and order (here: equality) of the text's suffixes, cut at the
length asked for, is settled inside the dictionary instead of in the corpus.

For a minimum length N and a gram of k bytes, every N-byte string has a least gram hash.
Consecutive strings that share it form a *run*; the run's phrase is the text its strings cover.
Equal strings lie in runs with equal least hashes, so:

* a run whose hash occurs nowhere else, and only once in its own phrase, holds no repeat;
* a run whose whole phrase occurs elsewhere consists of repeats;
* only phrases that share their hash with a different phrase must be looked into.  One copy of
  each goes on to the next level, with a longer gram and thus shorter runs.  At k = N a run is a
  single string or equal strings in a row, and the question is settled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import rolling
from terravane.llm.common import Hidden, drop_stages, shared_folder, with_fields, write_stage

#: Gram lengths by level, as parts of the minimum length; the last level is the length itself.
LEVELS = (0.16, 0.75, 1.0)


def runs(data: np.ndarray, borders: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts between the borders of a byte array.

    Returns for each run its text, least hash, phrase hash, first and last start (within its
    text), and whether it may repeat itself.  Grams and phrases are hashed by different
    polynomials, 62 bits each, so that two strings that agree in both are equal but for one chance
    in 2**124.  Where a gram is a whole string the phrase is that string, however often it follows
    itself.
    """
    begin, end = borders[:-1], borders[1:]
    long = np.flatnonzero(end - begin >= length)
    strings = (end - begin)[long] - length + 1
    total = int(strings.sum())
    # Starts of the strings that lie within one text.
    start = np.arange(total) + np.repeat(begin[long] - np.concatenate([[0], np.cumsum(strings)[:-1]]), strings) if total else np.zeros(0, dtype=np.int64)
    if not total:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none.astype(bool)
    p = rolling.prefix(data)
    h = rolling.windows(p, gram)
    least = rolling.sliding_min(h, length - gram + 1)[start]
    new = np.ones(total, dtype=bool)
    new[1:] = least[1:] != least[:-1]
    new[np.concatenate([[0], np.cumsum(strings)[:-1]])] = True
    at = np.flatnonzero(new)
    first, last = start[at], start[np.concatenate([at[1:], [total]]) - 1]
    end_of = first + length if gram == length else last + length
    phrase = rolling.slices(rolling.prefix(data, rolling.OTHERS), first, end_of, rolling.OTHERS)
    # A run's string that begins with the least gram, and is not the run's last, proves a second occurrence.
    twice = np.flatnonzero(~new[1:] & (h[start[:-1]] == least[:-1]))
    again = np.zeros(len(at), dtype=bool)
    again[np.searchsorted(at, twice, side="right") - 1] = True
    text = np.searchsorted(begin, first, side="right") - 1
    # Empty texts share their border with the next one, which is the last of them.
    return text, least[at], phrase, first - begin[text], last - begin[text], again


_RUNS = pa.schema([("gram", pa.int64()), ("phrase", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())])
_RUNS_DDL = "gram long, phrase long, doc long, at int, first int, last int, again boolean"


def _find_runs(length: int, gram: int):
    """Maps (doc, at, context, bytes) to its runs; ``first`` and ``last`` are relative to the document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ats = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "at"))
            contexts = batch.column("context").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for row, data, borders in rolling.chunks(batch.column("bytes")):
                text, grams, phrases, first, last, again = runs(data, borders, length, gram)
                text = text + row
                grams, at = rolling.mix(grams ^ contexts[text]), ats[text]
                made = (grams.view(np.int64), phrases.view(np.int64), docs[text], at, first + at, last + at, again)
                yield pa.RecordBatch.from_arrays([pa.array(a).cast(f.type) for a, f in zip(made, _RUNS, strict=True)], schema=_RUNS)

    return work


def repeated_ranges(docs: DataFrame, length: int, folder: str) -> DataFrame:
    """Starts of repeated strings, as ``(doc, first, last)`` ranges, of ``(doc, bytes)`` rows.

    ``doc`` is a hash of the bytes, so rows with equal bytes share their ranges, and each range
    is given once, however many rows have it.  Counts are
    pre-aggregated before each shuffle; a hash that very many runs share is one row on one side
    of a join, whose other side Spark may split.
    """
    source, ranges = docs.select("doc", F.lit(0).alias("at"), F.lit(0).cast("long").alias("context"), "bytes"), []
    for level, part in enumerate(LEVELS):
        gram = max(1, min(length, round(length * part)))
        found = source.mapInArrow(_find_runs(length, gram), _RUNS_DDL)
        if gram == length:
            # A run is a single string, or equal ones in a row, each of which counts; its hashes say all.
            twice = found.groupBy("gram", "phrase").agg(F.sum(F.expr("last - first + 1")).alias("n")).filter("n > 1").select("gram", "phrase")
            ranges.append(found.select("gram", "phrase", "doc", "first", "last").join(twice, ["gram", "phrase"]).select("doc", "first", "last"))
            break
        grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("phrase").alias("p"), F.max("phrase").alias("q"), F.max("again").alias("self"))
        grams = grams.filter("n > 1 or self").select("gram", (F.expr("p <> q") | F.col("self")).alias("open"))
        kept = write_stage(found.drop("again").join(grams, "gram").withColumn("pick", F.xxhash64("doc", "at", "first")), folder, f"runs-{level}")
        # Copies of a phrase behave alike; one occurrence stands for all on the next level.
        phrases = kept.groupBy("gram", "phrase").agg(F.count("*").alias("n"), F.min("pick").alias("picked"))
        marked = write_stage(kept.join(phrases, ["gram", "phrase"]).filter("n > 1 or open"), folder, f"marked-{level}")
        ranges.append(marked.filter("n > 1").select("doc", "first", "last"))
        stand = marked.filter("open and pick = picked").dropDuplicates(["gram", "phrase", "pick"])
        wanted = stand.groupBy("doc", "at").agg(F.collect_list(F.struct("first", "last", "gram")).alias("wanted"))
        texts = source.select("doc", "at", "bytes").join(wanted.hint("shuffle_hash"), ["doc", "at"])
        texts = texts.select("doc", "at", "bytes", F.explode("wanted").alias("w"))
        cut = F.substring(F.col("bytes"), F.col("w.first") - F.col("at") + 1, F.col("w.last") - F.col("w.first") + length)
        texts = texts.select("doc", F.col("w.first").alias("at"), F.col("w.gram").alias("context"), cut.alias("bytes"))
        if level == 0:
            # Rows with equal bytes have given their phrases once each.
            texts = texts.dropDuplicates(["doc", "at", "context"])
        source = write_stage(texts, folder, f"texts-{level}")
    out = ranges[0]
    for more in ranges[1:]:
        out = out.union(more)
    # Every row of equal bytes has given its ranges; a list of them must not grow with the copies.
    return out.distinct()


def cover(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs ``[begin, end)`` of the strings that start at first..last."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + length)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return begin[new], end[np.concatenate([new[1:], [len(begin)]]) - 1]


def _remove(length: int, keep_text: bool, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lasts = batch.column("_firsts"), batch.column("_lasts")
            out = {f.name: [] for f in schema if f.name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, value in enumerate(batch.column("_bytes")):
                data = value.as_buffer()
                data = memoryview(data) if data is not None else memoryview(b"")
                n, removed, spans, kept = len(data), 0, 0, [data]
                if firsts[i].is_valid and len(firsts[i]):
                    begin, end = cover(firsts[i].values.to_numpy(), lasts[i].values.to_numpy(), length)
                    removed, spans = int((end - begin).sum()), len(begin)
                    kept = [data[a:b] for a, b in zip([0, *end], [*begin, n], strict=True)]
                digest = hashlib.sha256()
                for piece in kept:
                    digest.update(piece)
                out["n_bytes"].append(n)
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(digest.hexdigest())
                if keep_text:
                    # A cut may go through a character: what is left of it goes too.
                    out["kept"].append(b"".join(kept).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if f.name in out else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return work


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, keep: list[str] | None = None, with_kept: bool = False) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts anywhere else.

    Returns the columns ``keep`` (by default all but the text) with ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept_sha256`` of the remaining bytes, and their text
    as ``kept`` if asked for.  Texts are taken as UTF-8; a null text is empty; texts shorter
    than ``length`` lose nothing; matches never cross rows; a string repeated within its own row
    counts; rows that repeat a whole text all lose it.  Strings are compared by two independent
    hashes of 62 bits, one of the gram and one of the phrase.  Columns named like the results give way.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    folder = shared_folder(spark)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    hidden = Hidden(docs)
    encoded = F.coalesce(F.encode(hidden(text), "UTF-8"), F.lit(b""))
    ranges = repeated_ranges(hidden.df.select(F.xxhash64(encoded).alias("doc"), encoded.alias("bytes")).filter(F.octet_length("bytes") >= length), length, folder)
    lists = write_stage(ranges.groupBy("doc").agg(F.collect_list("first").alias("_firsts"), F.collect_list("last").alias("_lasts")), folder, "ranges")
    drop_stages(spark, folder, *[f"{s}-{k}" for s in ("runs", "marked", "texts") for k in range(len(LEVELS))])

    kept = hidden.columns(keep)
    rows = hidden.df.select(*kept, encoded.alias("_bytes"), F.xxhash64(encoded).alias("doc"))
    joined = rows.join(lists.hint("shuffle_hash"), "doc", "left").drop("doc")
    types = with_fields(rows.select(*kept).schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_kept)
    out = joined.mapInArrow(_remove(length, with_kept, to_arrow_schema(types)), types)
    return hidden.restore(out, *types.names[len(kept) :], names=keep)
