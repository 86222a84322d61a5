"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A document's signature has ``SYMBOLS`` symbols of 11 bits, each the hash of its least shingle
under one of as many permutations: two signatures agree in a symbol with about the probability of
the sets' Jaccard similarity.  Their Hamming distance counts the symbols that differ.

The signature is split into chunks of ``CHUNK`` symbols.  Two signatures at a distance of at most
``RADIUS`` differ in at most one symbol of some chunk, because RADIUS < 2 * SYMBOLS / CHUNK
(pigeonhole).  Enumerating the allowed error of a chunk means leaving out each of its symbols in
turn, so all pairs within the radius meet in one of SYMBOLS keys.  Pairs that meet are candidates
up to the distance ``LIMIT``: at a similarity of 0.8 the distance is binomial with mean 12 of 60,
and exceeds it about once in a million; such a pair fails to meet about once in ten million.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm import rolling
from terravane.llm.common import Hidden, components, drop_stages, shared_folder, with_fields, write_stage

SYMBOLS, CHUNK = 60, 5
CHUNKS = SYMBOLS // CHUNK
RADIUS, LIMIT = 2 * CHUNKS - 1, 28
#: Chunks of the first round, orders in which its buckets choose their centre, and nodes and shingles of a block.
FIRST, ORDERS, BLOCK, BLOCK_SHINGLES = 2, 3, 128, 1 << 18
#: A chunk is a 64-bit number with a symbol of 11 bits in each lane of 12.
LANE, SYMBOL = 12, (1 << 11) - 1
_LOW, _HIGH = (sum(x << LANE * j for j in range(CHUNK)) for x in (SYMBOL, SYMBOL + 1))

_rng = np.random.Generator(np.random.PCG64(20))
_XOR = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32) | np.uint32(1)

#: Bytes that part words, and the table that lower-cases A-Z.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of UTF-8 bytes.

    With fewer than n words the whole sequence is the only shingle; without words there is none.
    """
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    h = rolling.slices(rolling.prefix(_LOWER[data]), start, end)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = rolling.mix(out * np.uint64(rolling.MULTIPLIER) + h[i : i + len(out)] + np.uint64(n))
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The chunks of the signature of a set of at least one hash."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048, None] ^ _XOR
        part *= _MUL
        np.minimum(least, part.min(axis=0), out=least)
    symbols = rolling.mix(least.astype(np.uint64)) & np.uint64(SYMBOL)
    return (symbols.reshape(CHUNKS, CHUNK) << (np.arange(CHUNK, dtype=np.uint64) * np.uint64(LANE))).sum(axis=1, dtype=np.uint64)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For signatures of (m, CHUNKS), their (m, SYMBOLS) keys: each chunk without each of its symbols."""
    out = np.empty((*sig.shape, CHUNK), dtype=np.uint64)
    for left in range(CHUNK):
        out[:, :, left] = sig & np.uint64(_LOW ^ (SYMBOL << LANE * left))
    place = np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(rolling.MULTIPLIER)
    return rolling.mix(out.reshape(len(sig), SYMBOLS) + place)


def distance(x: str, y: str) -> Column:
    """Hamming distance of two signatures: a lane of the difference is filled up beyond its symbol if not 0."""
    parts = [F.bit_count((F.col(x)[c].bitwiseXOR(F.col(y)[c]) + F.lit(_LOW)).bitwiseAND(F.lit(_HIGH))) for c in range(CHUNKS)]
    return reduce(lambda p, q: p + q, parts)


#: A set's size, its 128-bit print in two numbers, and its signature.
_SETS = "n_shingles long, p long, q long, sig array<long>"


def prints(hashes: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit print in two numbers."""
    one = np.bitwise_xor.reduce(rolling.mix(hashes + np.uint64(1)), keepdims=True) + np.uint64(len(hashes))
    two = np.add.reduce(rolling.mix(hashes ^ np.uint64(rolling.MULTIPLIER)), keepdims=True)
    return tuple(int(rolling.mix(x).view(np.int64)[0]) for x in (one, two))


def _fingerprints(n: int, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"n_shingles": [], "p": [], "q": [], "sig": []}
            for value in batch.column("_bytes"):
                found = shingles(np.frombuffer(value.as_buffer() or b"", dtype=np.uint8), n)
                p, q = prints(found) if len(found) else (None, None)
                for name, v in zip(made, (len(found), p, q, signature(found).view(np.int64) if len(found) else None), strict=True):
                    made[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return work


def _keys(chunks: int):
    """(node, component, size, sig) -> a row for each key of the first chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "component", "size"]
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sig = part.column("sig").flatten().to_numpy().view(np.uint64).reshape(-1, CHUNKS)
                keys = chunk_keys(sig)[:, : chunks * CHUNK]
                same = [pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), keys.shape[1])) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys).ravel().view(np.int64)), *same], names=["key", *names])

    return work


_KEYS = "key long, node long, component long, size long"


def _set_of(n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(np.frombuffer(v.as_buffer() or b"", dtype=np.uint8), n).tobytes() for v in batch.column("bytes")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, type=pa.binary())], names=["node", "shingles"])

    return work


def _links(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, p, q in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (p, q))
                both = np.concatenate([p, q])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (len(both) - same):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return work


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """Adds ``n_shingles``, ``component_id``, ``kept`` and ``chosen`` to every row.

    A row's set holds its distinct ``words``-word shingles over whole texts, lower-cased in A-Z.
    Rows are linked when 100 * |intersection| >= ``percent`` * |union|; ``component_id`` is the
    smallest key reachable over links, ``kept`` says whether that is the row's own.  A null or
    blank text has an empty set and is linked with nothing.  Rows with equal sets are one node,
    whose key is the smallest; rows with a null key belong to the node's component, and are kept
    only if no row of it has a key.  ``chosen`` holds for one row of each component, the first by
    key, null keys last, and then by a hash of the text; rows that repeat it in key and text are
    chosen alike, and rows with an empty set always.  A very long text is one row's work.  An
    empty table gives no rows.  Columns named like the results give way to them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    folder = shared_folder(spark)
    hidden = Hidden(docs)
    docs, key, text = hidden.df, hidden(key), hidden(text)
    encoded = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(key).alias("id"), identity(encoded).alias("th"), encoded.alias("_bytes"))
    types = with_fields(rows.drop("_bytes").schema, _SETS)
    prints = write_stage(rows.mapInArrow(_fingerprints(words, to_arrow_schema(types)), types), folder, "prints")
    first = F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("one")
    nodes = prints.filter("n_shingles > 0").groupBy("p", "q").agg(first, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    # Numbers are given once, as the table is written, and so are distinct.
    nodes = write_stage(nodes.select(F.monotonically_increasing_id().alias("node"), "p", "q", "one.id", "one.th", "n", "sig"), folder, "nodes")

    # First, by the keys of a few chunks, every member of a bucket against the bucket's centre: that settles most of
    # any group of copies.  The centre is the first in one of a few orders, so buckets of a group have several.
    lone = nodes.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("size"), "sig")
    keys = lone.mapInArrow(_keys(FIRST), _KEYS).select("key", "node")
    rank = F.xxhash64("node", F.pmod("key", F.lit(ORDERS)))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", rank).alias("centre")).filter("n > 1").drop("n")
    stars = keys.join(shared, "key").filter("node <> centre")
    stars = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    stars = write_stage(_plausible(stars, nodes, percent), folder, "stars")
    sets_of = nodes.select("node", "id", "th")
    links = _confirmed(stars, sets_of, rows, words, percent, folder, "near")
    # Candidates make clusters, confirmed links the components within them.
    strict = components(links, folder, "first").withColumnRenamed("component", "strict")
    groups = components(stars, folder, "loose").join(strict, "node", "left").withColumn("strict", F.coalesce("strict", "node"))
    parts = groups.groupBy("component", "strict").agg(F.count("*").alias("n"))
    main = parts.groupBy("component").agg(F.max_by("strict", "n").alias("main"), F.sum("n").alias("size"))
    groups = write_stage(groups.join(main, "component"), folder, "groups")

    # Then each node that is not linked with most of its own cluster against that cluster as a whole, and, where a
    # bucket of any key holds several clusters, each node against the larger of them.
    labelled = nodes.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"), "n", "sig", F.coalesce("strict", "node").alias("own"))
    keys = labelled.select("node", "component", "size", "sig").mapInArrow(_keys(CHUNKS), _KEYS)
    mixed = keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    inside = write_stage(keys.join(mixed, "key"), folder, "inside")
    about = labelled.select("node", "n", "sig", "own")
    x = inside.join(about, "node").select("key", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("size").alias("size_x"), F.col("n").alias("na"), F.col("sig").alias("sa"), "own")
    y = inside.groupBy("key", "component").agg(F.min("node").alias("node"), F.max("size").alias("size")).join(about, "node")
    y = y.select(F.col("key").alias("k"), F.col("component").alias("cy"), F.col("size").alias("size_y"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    # The distance to a node of its own is part of the join's condition, so pairs beyond the limit are never made.
    towards = F.expr("size_x < size_y or (size_x = size_y and cx < cy)") & ((F.col("size_y") > 1) | _may_link(percent))
    # What is known of a node goes along, so that its meetings need not be joined with it again.
    meetings = x.join(y, (F.col("key") == F.col("k")) & towards).select("x", "cy", "size_y", "na", "own").distinct()
    meetings = write_stage(meetings, folder, "meetings")
    pairs = meetings.filter("size_y = 1").select(F.least("x", "cy").alias("a"), F.greatest("x", "cy").alias("b")).distinct()
    more = _confirmed(pairs.join(stars, ["a", "b"], "left_anti"), sets_of, rows, words, percent, folder, "rest")
    own = groups.filter("strict <> main").join(nodes.select("node", "n"), "node").select(F.col("node").alias("x"), F.col("component").alias("cy"), F.col("size").alias("size_y"), F.col("n").alias("na"), F.col("strict").alias("own"))
    more = more.union(_linked_wholes(meetings.filter("size_y > 1").union(own), groups, nodes.select("node", "n"), sets_of, rows, words, percent, folder))
    # A component's star stands for its links.
    merged = components(groups.select(F.col("node").alias("a"), F.col("strict").alias("b")).union(more), folder, "last")

    labels = nodes.select("node", "p", "q", "id", "th").join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labels.groupBy("component").agg(first)
    labels = write_stage(labels.join(least, "component").select("p", "q", "one"), folder, "labels")
    drop_stages(spark, folder, "nodes", "inside", "meetings", "groups", "stars", "near", "rest", "wholes")

    found = prints.select("id", "th", "n_shingles", "p", "q").distinct().join(labels, ["p", "q"], "left").drop("p", "q")
    found = found.withColumnsRenamed({"id": "_id", "th": "_th"})
    own = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_mine") == F.col("_th"))
    out = docs.withColumn("_mine", identity(encoded)).join(found, own)
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("one.id")).otherwise(F.col(key)))
    out = out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    out = out.withColumn("chosen", (F.col("n_shingles") == 0) | (F.col("kept") & (F.col("_mine") == F.col("one.th"))))
    return hidden.restore(out, "n_shingles", "component_id", "kept", "chosen")


def identity(value: Column) -> Column:
    """What stands for a binary value: 128 bits, as equal texts of a large corpus are told by it alone."""
    return F.unhex(F.md5(value))


def _may_link(percent: int) -> Column:
    """Whether the sizes and signatures of ``a`` and ``b`` allow the similarity."""
    sizes = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    return sizes & (distance("sa", "sb") <= LIMIT)


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow the similarity."""
    for name in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("sig").alias(f"s{name}")), name)
    return pairs.filter(_may_link(percent)).select("a", "b")


def _sets(ids: DataFrame, sets_of: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)`` of the nodes, made again from their texts."""
    wanted = ids.join(sets_of, "node").withColumnsRenamed({"id": "_i", "th": "_t"}).hint("shuffle_hash")
    texts = rows.join(wanted, (F.col("th") == F.col("_t")) & F.col("id").eqNullSafe(F.col("_i"))).select("node", F.col("_bytes").alias("bytes"))
    # Only a repeated row, equal in key and text, gives its set twice.
    return texts.mapInArrow(_set_of(words), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets_of: DataFrame, rows: DataFrame, words: int, percent: int, folder: str, name: str) -> DataFrame:
    """The pairs that are similar enough on their full sets."""
    pairs = write_stage(pairs, folder, f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = write_stage(_sets(ids, sets_of, rows, words), folder, f"{name}-sets")
    joined = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
    links = write_stage(joined.mapInArrow(_links(percent), "a long, b long"), folder, name)
    drop_stages(rows.sparkSession, folder, f"{name}-pairs", f"{name}-sets")
    return links


def linked_to(asking: list[np.ndarray], own: np.ndarray, members: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """For each asking set and each label but its own, the first member so labelled that is similar enough."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    values = np.concatenate(members)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(m) for m in members])
    out = []
    for i, one in enumerate(asking):
        low, high = np.searchsorted(values, one, "left"), np.searchsorted(values, one, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        same = np.bincount(owner[at], minlength=len(members))
        good = np.flatnonzero((100 * same >= percent * (sizes + len(one) - same)) & (labels != own[i]))
        _, first = np.unique(labels[good], return_index=True)
        out += [(i, int(j)) for j in good[first]]
    return out


def _ask(percent: int):
    def work(asking: pa.Table, members: pa.Table) -> pa.Table:
        x, y = asking.column("x").to_pylist(), members.column("y").to_pylist()
        found = []
        if x and y:
            one, other = ([np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in c] for c in (asking.column("shingles"), members.column("members")))
            found = linked_to(one, asking.column("own").to_numpy(), other, members.column("label").to_numpy(), percent)
        return pa.table({"a": pa.array([x[i] for i, _ in found], pa.int64()), "b": pa.array([y[j] for _, j in found], pa.int64())})

    return work


def _linked_wholes(meetings: DataFrame, groups: DataFrame, sizes: DataFrame, sets_of: DataFrame, rows: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """A link from each node to each component of the clusters it met that has a similar enough member.

    ``meetings`` has ``x`` with its size ``na`` and component ``own``, and ``cy``.  All members are looked at, not only those met.  Members and
    asking nodes are dealt into blocks of about BLOCK nodes and BLOCK_SHINGLES shingles, and a
    task compares a block with a block; as one link is enough to join a component, one comes out
    for each node, block and component.
    """

    def blocks(df: DataFrame, by: str, name: str) -> DataFrame:
        n = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
        return df.groupBy(by).agg(n.cast("int").alias(name))

    # Both are read by several joins of the plans below, and are made once.
    meetings = write_stage(meetings, folder, "wholes-asking")
    asked = blocks(meetings.withColumnRenamed("na", "n"), "cy", "chunks")
    asked = write_stage(asked.join(blocks(groups.join(sizes, "node").join(asked, F.col("component") == F.col("cy")), "cy", "blocks"), "cy"), folder, "wholes-blocks")
    members = groups.join(asked, F.col("component") == F.col("cy")).select("cy", F.col("node").alias("y"), "blocks", "chunks", F.col("strict").alias("label"))
    ids = members.select(F.col("y").alias("node")).union(meetings.select("x")).distinct()
    sets = write_stage(_sets(ids, sets_of, rows, words), folder, "wholes-sets")
    everyone = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    right = members.join(sets.withColumnRenamed("node", "y"), "y").select("cy", F.pmod(F.xxhash64("y"), "blocks").cast("int").alias("block"), everyone.alias("chunk"), "y", "shingles", "label")
    asking = meetings.join(asked, "cy")
    everyone = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = asking.join(sets.withColumnRenamed("node", "x"), "x").select("cy", everyone.alias("block"), F.pmod(F.xxhash64("x"), "chunks").cast("int").alias("chunk"), "x", "own", "shingles")
    right = right.select(*[F.col(c).alias(n) for c, n in zip(right.columns, ("cm", "bm", "km", "y", "members", "label"), strict=True)])
    links = left.groupBy("cy", "block", "chunk").cogroup(right.groupBy("cm", "bm", "km")).applyInArrow(_ask(percent), "a long, b long")
    links = write_stage(links, folder, "wholes")
    drop_stages(rows.sparkSession, folder, "wholes-asking", "wholes-blocks", "wholes-sets")
    return links
