"""Near-duplicate vectors by counting collisions in windows of one-dimensional projections.

Every unit vector is projected onto ``PROJECTIONS`` Gaussian directions.  Two vectors collide in
a projection when the one lies in the window centred on the other.  For a pair at the cosine
threshold t the difference of projections is normal with deviation s = sqrt(2 - 2 t), so with
windows of ``WIDTH`` deviations to either side the number of collisions is binomial; ``NEEDED``
collisions are calibrated to miss about one such pair in 10**5, and pairs more alike are missed
less.  Pairs that reach the count are verified by their cosine in double precision.

The first projection also sorts: vectors are cut into bands of its axis, wide enough that a pair
at the threshold lies in the same or neighbouring bands except for one pair in 15,000 at the
threshold (``REACH`` deviations), and bands with many vectors into blocks of about ``BLOCK``.
Tasks compare blocks with blocks, so no label and no crowded place of the axis is gathered whole.
Out of a pair of blocks come counts for each vector and a spanning forest of its links, never the
pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import components, drop_stages, shared_folder, write_stage

PROJECTIONS, WIDTH, NEEDED, REACH, BLOCK = 24, 1.5, 13, 4.0, 1024


@lru_cache(maxsize=16)
def directions(dim: int) -> np.ndarray:
    """Gaussian directions for a dimension, the same in every task and run."""
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, PROJECTIONS))


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors of a list column by their lengths: (rows, unit vectors)."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        # A null component has become one that is no number.
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]
        yield rows[good], x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _prepare(spread: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in units(batch.column("embedding")):
                dim = x.shape[1]
                bands = np.floor(x @ directions(dim)[:, 0] / (REACH * spread)).astype(np.int64)
                kept = batch.select(["node", "label"]).take(pa.array(rows))
                unit = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.columns, unit, pa.array([dim] * len(x), pa.int32()), pa.array(bands)], names=["node", "label", "unit", "dim", "band"])

    return work


def block_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of rows of two blocks of unit vectors; of i < j if they are the same block."""
    spread = np.sqrt(2 - 2 * threshold)
    g = directions(a.shape[1])
    pa_, pb = (a @ g).astype(np.float32), (b @ g).astype(np.float32)
    left, right = [], []
    for i in range(0, len(a), 256):
        count = np.zeros((len(a[i : i + 256]), len(b)), dtype=np.uint8)
        for m in range(PROJECTIONS):
            count += np.abs(pa_[i : i + 256, m, None] - pb[None, :, m]) <= np.float32(WIDTH * spread)
        x, y = np.nonzero(count >= NEEDED)
        x += i
        if same:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 20_000):
            u, v = x[k : k + 20_000], y[k : k + 20_000]
            close = np.einsum("ij,ij->i", a[u], b[v]) >= threshold
            left.append(u[close])
            right.append(v[close])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _compare(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        """The rows of a pair of blocks: what their links add to each vector's count, and a forest of them."""
        sides, size = {}, {}
        for side in "ab":
            part = table.filter(pc.equal(table.column("side"), side))
            size |= zip(part.column("node").to_pylist(), part.column("size").to_pylist(), strict=True)
            sides[side] = part.column("node").to_numpy(), np.frombuffer(b"".join(part.column("unit").to_pylist()), dtype=np.float64).reshape(part.num_rows, -1) if part.num_rows else None
        first = table.slice(0, 1).to_pylist()[0]
        same = first["inside"] and first["i"] == first["j"]
        (ids, units), (others, their) = sides["a"], sides["a"] if same else sides["b"]
        if len(ids) and len(others):
            x, y = block_links(units, their, threshold, same)
            x, y = ids[x], others[y]
        else:
            x = y = np.zeros(0, dtype=np.int64)
        # A link with a class is one with each of its vectors.
        linked, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        n = np.zeros(len(linked), dtype=np.int64)
        np.add.at(n, at, np.array([size[k] for k in np.concatenate([y, x]).tolist()], dtype=np.int64))
        tree = forest(x, y)
        node = np.concatenate([linked, np.array([p for p, _ in tree], dtype=np.int64)])
        other = pa.array([None] * len(linked) + [q for _, q in tree], pa.int64())
        count = np.concatenate([n, np.zeros(len(tree), dtype=np.int64)])
        return pa.table({"node": pa.array(node, pa.int64()), "other": other, "n": pa.array(count, pa.int64())})

    return work


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", label: str = "label", embedding: str = "embedding", threshold: float = 0.93) -> DataFrame:
    """Per row of ``vectors``: its key, ``n_links``, ``component_id`` and ``kept``.

    Rows are compared if their labels are equal and not null and their vectors equally long.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    ``n_links`` counts the other rows linked directly; ``component_id`` is the smallest key
    reachable; ``kept`` says whether that is the row's own.  Rows whose unit vectors are equal are
    one class, compared once and counted as many times as it has rows, so copies cost nothing
    beyond their rows.  Rows with a null key link with nothing, have a null component and are
    kept.  Rows with equal keys are told apart for counting, and share the smallest component that
    one of them is in.  A very long vector is one row's work; an empty table gives no rows; other
    columns, whatever their names, are not looked at.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    spread = float(np.sqrt(2 - 2 * threshold))
    source = vectors.select(F.col(key).cast("long").alias("node"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = source.filter("node is not null and label is not null").mapInArrow(_prepare(spread), "node long, label string, unit binary, dim int, band long")
    rows = write_stage(rows, folder, "units")
    same = ["label", "dim", "unit"]
    classes = rows.groupBy(*same).agg(F.min("node").alias("least"), F.count("*").alias("size"), F.first("band").alias("band"))
    ready = write_stage(classes.withColumn("node", F.monotonically_increasing_id()), folder, "classes")
    places = ready.groupBy("label", "dim", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    after = places.select("label", "dim", (F.col("band") - 1).alias("band"), F.col("blocks").alias("next"))
    before = places.select("label", "dim", (F.col("band") + 1).alias("band"), F.col("blocks").alias("prev"))
    band = ["label", "dim", "band"]
    places = places.join(after, band, "left").join(before, band, "left").na.fill(0, ["next", "prev"])
    blocks = ready.join(places, band).withColumn("block", F.pmod(F.xxhash64("node", "unit"), F.col("blocks")).cast("int"))

    # A block meets its own band's blocks from itself on, and all of the next band's.
    everyone = F.sequence(F.lit(0), F.col("blocks") - 1)
    inside = F.transform(everyone, lambda k: F.struct(F.col("band").alias("band"), F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j"), F.lit(True).alias("inside"), F.when(F.col("block") <= k, "a").otherwise("b").alias("side")))
    nexts = F.when(F.col("next") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("next") - 1, F.lit(0))), lambda k: F.struct(F.col("band").alias("band"), F.col("block").alias("i"), k.alias("j"), F.lit(False).alias("inside"), F.lit("a").alias("side"))))
    prevs = F.when(F.col("prev") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("prev") - 1, F.lit(0))), lambda k: F.struct((F.col("band") - 1).alias("band"), k.alias("i"), F.col("block").alias("j"), F.lit(False).alias("inside"), F.lit("b").alias("side"))))
    none = F.array().cast("array<struct<band:bigint,i:int,j:int,inside:boolean,side:string>>")
    meetings = F.concat(inside, F.coalesce(nexts, none), F.coalesce(prevs, none))
    dealt = blocks.select("label", "dim", "node", "size", "unit", F.explode(meetings).alias("m")).select("label", "dim", "node", "size", "unit", "m.*")
    group = ["label", "dim", "band", "i", "j", "inside"]
    # A group is two blocks, of about 2 * BLOCK vectors.
    found = dealt.groupBy(*group).applyInArrow(_compare(threshold), "node long, other long, n long")
    found = write_stage(found, folder, "found")

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), folder)
    about = ready.select("node", "least", "size").join(counts, "node", "left").join(groups, "node", "left")
    about = about.withColumn("component", F.coalesce("component", "node")).withColumn("n", F.coalesce("n", F.lit(0)) + F.col("size") - 1)
    smallest = about.groupBy("component").agg(F.min("least").alias("smallest"))
    about = about.join(smallest, "component").select("node", "n", "smallest")
    members = rows.select(F.col("node").alias("member"), *same).join(ready.select("node", *same), same).join(about, "node")
    about = write_stage(members.groupBy(F.col("member").alias("node")).agg(F.sum("n").alias("n_links"), F.min("smallest").alias("component")), folder, "about")
    drop_stages(spark, folder, "units", "classes", "found")
    out = vectors.select(F.col(key)).join(about.withColumnRenamed("node", "_node"), F.col(key) == F.col("_node"), "left")
    out = out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col(key)).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
