"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of vectors.

A shard's graph is grown by insertion, in batches that double.  For each new vector a greedy beam
search from the shard's entries proposes neighbours; robust pruning takes the nearest of them, drops
every other that is closer to the taken one than to the new vector by the factor ALPHA, and goes on
until DEGREE edges are chosen, so edges lead in different directions.  Edges are also added the
other way and pruned alike.  A second pass searches the whole graph for every vector and prunes
again.  Entries are chosen far from each other, so that a crowd of near copies, whose edges stay
within it, holds one of them and not all.  What no entry reaches is tied to its nearest reachable vector.  Queries walk every
shard's graph with a beam; what they find is ranked by the exact measure, and the best of all
shards remain.

Equal vectors are one node, with as many of their keys as an answer can hold.  Shards hold about
SHARD nodes and meet blocks of about QUERIES queries, so a task's memory does not depend on the
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm.common import shared_folder, write_stage

DEGREE, ALPHA, BEAM, EXPAND = 32, 1.2, 64, 4
SHARD, QUERIES, ENTRIES = 4096, 2048, 32
#: Searches in step, and the largest batch of insertions.
TOGETHER = 512

_NODE = "dim int, shard int, node int, keys array<long>, vector binary, edges array<int>, entry boolean"
_FOUND = "query int, query_id long, vec_id long, score double"


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column that hold a vector with a direction, by length: (rows, vectors in double precision)."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        # A null component becomes one that is no number.
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield rows[good], x[good]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in usable(batch.column("embedding")):
            # Zeros of either sign are equal.
            raw = pa.array([(v + 0.0).tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array(np.full(len(x), x.shape[1], np.int32)), raw], names=["key", "dim", "vector"])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b; rows are scaled first, so no square overflows or vanishes."""
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, for walking."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes met from the entries, nearest first: ids, -1 where there are fewer, and squared distances."""
    ids, near = [], []
    for k in range(0, len(queries), TOGETHER):
        found = _walk(points, edges, entries, queries[k : k + TOGETHER], beam)
        ids.append(found[0])
        near.append(found[1])
    return np.concatenate(ids), np.concatenate(near)


def _walk(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(queries)
    ids = np.full((n, beam), -1, dtype=np.int64)
    far = np.full((n, beam), np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    seen = np.zeros((n, len(points)), dtype=bool)
    start = 2 - 2 * (queries @ points[entries].T)
    top = np.argsort(start, axis=1, kind="stable")[:, :beam]
    m = top.shape[1]
    ids[:, :m], far[:, :m], done[:, :m] = entries[top], np.take_along_axis(start, top, axis=1), False
    seen[:, entries] = True
    active = np.arange(n)
    while len(active):
        rest = done[active]
        # The nearest nodes of the beam that are not expanded yet come first.
        pick = np.argsort(rest, axis=1, kind="stable")[:, :EXPAND]
        fresh = ~np.take_along_axis(rest, pick, axis=1)
        at = np.take_along_axis(ids[active], pick, axis=1)
        done[active[:, None], pick] = True
        next_ = edges[at].copy()
        next_[~fresh] = -1
        next_ = next_.reshape(len(active), -1).astype(np.int64)
        new = (next_ >= 0) & ~seen[active[:, None], next_]
        # One node may be met twice in a step: the first time counts.
        order = np.argsort(next_, axis=1, kind="stable")
        ordered = np.take_along_axis(next_, order, axis=1)
        again = np.zeros_like(new)
        np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
        new &= ~again
        who, where = np.nonzero(new)
        seen[active[who], next_[who, where]] = True
        met = np.full(next_.shape, np.inf, dtype=np.float32)
        met[who, where] = 2 - 2 * np.einsum("ij,ij->i", points[next_[who, where]], queries[active[who]])
        both = np.concatenate([far[active], met], axis=1)
        top = np.argsort(both, axis=1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(both, top, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, next_, -1)], axis=1), top, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~new], axis=1), top, axis=1)
        active = active[~done[active].all(axis=1)]
    return ids, far


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """Edges of the nodes ``own``, from candidates (-1: none) that may repeat and hold the node itself."""
    out = np.full((len(own), degree), -1, dtype=np.int32)
    for k in range(0, len(own), TOGETHER):
        mine, c = own[k : k + TOGETHER], np.sort(candidates[k : k + TOGETHER], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == mine[:, None]] = -1
        x = points[c]
        far = np.where(c >= 0, 2 - 2 * np.einsum("ijk,ik->ij", x, points[mine]), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        c, far, x = np.take_along_axis(c, order, axis=1), np.take_along_axis(far, order, axis=1), np.take_along_axis(x, order[:, :, None], axis=1)
        between = 2 - 2 * np.matmul(x, x.transpose(0, 2, 1))
        alive, row = c >= 0, np.arange(len(mine))
        for r in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            out[k : k + TOGETHER, r] = np.where(some, c[row, first], -1)
            alive &= alpha * alpha * between[row, first] > far
            alive[row, first] = False
    return out


def _linked_back(points: np.ndarray, edges: np.ndarray, sources: np.ndarray) -> None:
    """Adds the edges of the sources the other way round and prunes where there are too many."""
    there = edges[sources]
    p, q = np.repeat(sources, there.shape[1]), there.ravel()
    p, q = p[q >= 0], q[q >= 0].astype(np.int64)
    order = np.argsort(q, kind="stable")
    p, q = p[order], q[order]
    # A node that many lead to takes them a few at a time.
    turn = np.arange(len(q)) - np.searchsorted(q, q)
    for k in range(0, int(turn.max(initial=-1)) + 1, DEGREE):
        now = (turn >= k) & (turn < k + DEGREE)
        nodes, at = np.unique(q[now], return_inverse=True)
        come = np.full((len(nodes), DEGREE), -1, dtype=np.int64)
        come[at, turn[now] - k] = p[now]
        edges[nodes] = robust_prune(points, nodes, np.concatenate([edges[nodes].astype(np.int64), come], axis=1))


def scattered(points: np.ndarray, n: int = ENTRIES) -> np.ndarray:
    """Up to n nodes: the one nearest the mean, and then always the one farthest from those before."""
    out = [int((points @ points.mean(axis=0)).argmax())]
    closest = points @ points[out[0]]
    while len(out) < min(n, len(points)):
        out.append(int(closest.argmin()))
        closest = np.maximum(closest, points @ points[out[-1]])
        closest[out] = np.inf
    return np.array(out)


def build_graph(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1: none) of every node of unit vectors, and the entries."""
    n = len(points)
    edges = np.full((n, DEGREE), -1, dtype=np.int32)
    entries = scattered(points)
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    order = np.concatenate([entries, order[~np.isin(order, entries)]])
    for again in (False, True):
        begin = 0
        while begin < n:
            batch = order[begin : begin + (TOGETHER if again else min(TOGETHER, max(begin, len(entries))))]
            found, _ = beam_search(points, edges, entries, points[batch])
            # Vectors of one batch do not meet in the graph yet.
            near = points[batch] @ points[batch].T
            beside = batch[np.argsort(-near, axis=1, kind="stable")[:, :DEGREE]]
            edges[batch] = robust_prune(points, batch, np.concatenate([found, beside, edges[batch].astype(np.int64)], axis=1))
            _linked_back(points, edges, batch)
            begin += len(batch)
    return _tied(points, edges, entries), entries


def _tied(points: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The edges with one more for every part that no entry reaches, from its nearest node that is reached."""
    reached = np.zeros(len(points), dtype=bool)

    def reach(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            front = np.unique(edges[front])
            front = front[front >= 0]
            front = front[~reached[front]]

    reach(entries)
    while not reached.all():
        lost, known = np.flatnonzero(~reached), np.flatnonzero(reached)
        best = np.concatenate([(points[lost[k : k + TOGETHER]] @ points[known].T).argmax(axis=1) for k in range(0, len(lost), TOGETHER)])
        node = lost[np.einsum("ij,ij->i", points[lost], points[known[best]]).argmax()]
        at = known[best[np.searchsorted(lost, node)]]
        free = np.flatnonzero(edges[at] < 0)
        if not len(free):
            edges = np.concatenate([edges, np.full((len(edges), 1), -1, dtype=edges.dtype)], axis=1)
            free = [edges.shape[1] - 1]
        edges[at, free[0]] = node
        reach(np.array([node]))
    return edges


def _build(table: pa.Table) -> pa.Table:
    """A shard's nodes with their edges."""
    table = table.combine_chunks().sort_by("vector")
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)
    edges, entries = build_graph(units(x))
    node = np.arange(len(x))
    lists = pa.array([e[e >= 0] for e in edges], pa.list_(pa.int32()))
    made = {"dim": table.column("dim"), "shard": table.column("shard"), "node": pa.array(node, pa.int32()), "keys": table.column("keys"), "vector": table.column("vector"), "edges": lists, "entry": pa.array(np.isin(node, entries))}
    return pa.table(made)


def _search(k: int):
    def work(nodes: pa.Table, asking: pa.Table) -> pa.Table:
        """The k best of a shard for each query of a block."""
        empty = pa.table({n: pa.array([], t) for n, t in (("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        if not nodes.num_rows or not asking.num_rows:
            return empty
        nodes = nodes.combine_chunks().sort_by("node")
        lists = nodes.column("edges").combine_chunks()
        n = np.asarray(lists.value_lengths())
        edges = np.full((len(n), max(1, n.max())), -1, dtype=np.int32)
        edges[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
        x, q = (np.frombuffer(b"".join(t.column("vector").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1) for t in (nodes, asking))
        entries = np.flatnonzero(nodes.column("entry").to_numpy())
        points = units(x)
        found, _ = beam_search(points, edges, entries, units(q), max(BEAM, 4 * (k + 1)))
        row, place = np.nonzero(found >= 0)
        node = found[row, place]
        score = cosines(q[row], x[node])
        # A node answers with each of its keys but the query's own.
        keys = nodes.column("keys").combine_chunks()
        lengths, offsets, flat = np.asarray(keys.value_lengths()), keys.offsets.to_numpy(), keys.flatten().to_numpy()
        base = offsets - offsets[0]
        m = lengths[node]
        row, score, at = np.repeat(row, m), np.repeat(score, m), np.repeat(base[node], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        key = flat[at]
        ids = asking.column("query_id").to_numpy()
        other = key != ids[row]
        row, score, key = row[other], score[other], key[other]
        order = np.lexsort((key, -score, row))
        row, score, key = row[order], score[order], key[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        row = row[best]
        return pa.table({"query": asking.column("query").combine_chunks().take(pa.array(row)), "query_id": pa.array(ids[row]), "vec_id": pa.array(key[best]), "score": pa.array(score[best])})

    return work


def nearest(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose key is divisible by ``every``, its k nearest found.

    Nearness is the cosine in double precision on the vectors as they are; ties go to the smaller
    key.  Candidates are all rows with a vector of the same length, but those with the query's own
    key.  Vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor do rows with a null key.  Rows that share a key and a vector are one query and one
    candidate; rows that share only the key are queries of their own, told apart by ``query``
    (0, 1, ... by vector, for each key), and a candidate each.  A very long vector is one row's work; an
    empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    folder = shared_folder(vectors.sparkSession)
    given = vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("embedding")).filter("key is not null")
    rows = write_stage(given.mapInArrow(_vectors, "key long, dim int, vector binary").distinct(), folder, "vectors")

    # Of equal vectors, the first k + 1 keys are enough: one of them may be the query's.
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("dim", "vector").orderBy("key"))).filter(F.col("place") <= k + 1)
    nodes = some.groupBy("dim", "vector").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    nodes = write_stage(nodes, folder, "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    asking = rows.filter(F.col("key") % every == 0).withColumn("query", F.row_number().over(Window.partitionBy("key").orderBy("dim", "vector")) - 1)
    blocks = asking.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    # A row for each length of vectors.
    sizes = shards.join(blocks, "dim")
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    # A group is one shard.  Its rows are few bytes but long to work on, so the number of tasks is not left to their size.
    n = shards.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    dealt = dealt.select("dim", "shard", "keys", "vector").repartition(2 * n, "dim", "shard")
    graph = write_stage(dealt.groupBy("dim", "shard").applyInArrow(_build, _NODE), folder, "graph")

    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = graph.join(sizes.select("dim", "blocks"), "dim").withColumn("block", upto("blocks"))
    right = asking.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("key", "vector"), F.col("blocks")).cast("int"))
    right = right.select(F.col("dim").alias("d"), F.col("block").alias("b"), upto("shards").alias("s"), "query", F.col("key").alias("query_id"), "vector")
    # A group is one shard and one block of queries.
    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("d", "s", "b")).applyInArrow(_search(k), _FOUND)
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score", "query")
