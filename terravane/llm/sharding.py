"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm.common import Hidden, literal_table

#: Positions on the ring are 0 .. RING - 1; virtual nodes sit on the borders of CELLS equal cells.
RING, CELLS = 1 << 31, 1 << 16
#: Rows whose order is found in one task, on average.
BIN_ROWS = 4096


def ring(shards: int, virtual_nodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """``(position, shard)`` of each virtual node, by position; a new shard moves no old one."""
    points = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            digest = hashlib.md5(f"{seed}/{shard}/{v}".encode()).digest()
            cell = int.from_bytes(digest[:4], "big") % CELLS
            points.setdefault(cell * (RING // CELLS), shard)
    return sorted(points.items())


def quotas(total: int, shards: int, slack: float) -> list[int]:
    """Rows a shard may hold: equal shares that differ by one at most, enlarged by ``slack``."""
    share = [total // shards + (s < total % shards) for s in range(shards)]
    return [q + int(q * slack) for q in share]


def overflow(arcs: list[int], owners: list[int], room: list[int]) -> list[dict]:
    """Sends what a full shard cannot take on clockwise, arc by arc, until everything has a shard.

    ``arcs`` holds the number of keys whose first virtual node is that arc's.  Within an arc the
    first keys in ring order are taken first.  Returns pieces ``(arc, first, last, shard, slot)``.
    Works on counts alone, one number for each virtual node.
    """
    left, room = [(n, 0) for n in arcs], list(room)
    used, pieces = [0] * len(room), []
    for hop in range(len(arcs)):
        for arc, (n, begin) in enumerate(left):
            shard = owners[(arc + hop) % len(arcs)]
            take = min(n, room[shard])
            if take:
                pieces.append({"arc": arc, "first": begin, "last": begin + take - 1, "shard": shard, "base": used[shard], "hops": hop})
                room[shard] -= take
                used[shard] += take
                left[arc] = (n - take, begin + take)
        if not any(n for n, _ in left):
            break
    return pieces


def shard_ring(docs: DataFrame, key: str, shards: int = 8, virtual_nodes: int = 64, slack: float = 0.0, spread: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Adds ``shard``, ``slot``, ``home_shard`` and ``hops`` to every row.

    A row's place on the ring is a hash of ``key`` (and of ``spread``, which parts rows whose
    keys are equal or null).  The next virtual node clockwise owns it; if that shard has its
    quota, the row goes on to the next.  With ``slack`` 0 row counts differ by one at most, with
    ``slack`` e no shard holds more than (1 + e) of its share.  ``slot`` counts a shard's rows
    from 0 without gaps.  Null keys hash like any other value; rows that are equal in key and
    spread are interchangeable; an empty table gives no rows; columns named like results give way to them.  A new shard changes the owner of
    the arcs its virtual nodes cut, and quotas of the others, so only those rows move.

    Only counts go to the driver: one for each virtual node.  Ranks within an arc come from a
    prefix sum over bins of ring positions, so that no task orders an arc as a whole.
    """
    spark = docs.sparkSession
    points = ring(shards, virtual_nodes, seed)
    hidden = Hidden(docs)
    docs, by = hidden.df, [hidden(key), *[hidden(c) for c in spread]]
    at, bin_, arc, rank, pieces = "_at", "_bin", "_arc", "_rank", "_pieces"

    total = docs.count()
    fine = max(0, math.ceil(math.log2(max(1, total) / BIN_ROWS / CELLS)))
    width = max(1, RING // CELLS >> fine)
    placed = docs.withColumn(at, F.pmod(F.xxhash64(*by), F.lit(RING)))
    placed = placed.withColumn(bin_, F.floor(F.col(at) / width))

    # Virtual nodes sit on cell borders, so a bin never spans two arcs.  An arc ends below its virtual node.
    per_cell = (RING // CELLS) // width
    bounds = [p // (RING // CELLS) * per_cell for p, _ in points]
    arcs = [{"arc": i, "low": bounds[i - 1] if i else 0, "high": b - 1} for i, b in enumerate(bounds) if b > (bounds[i - 1] if i else 0)]
    arcs.append({"arc": 0, "low": bounds[-1], "high": CELLS * per_cell - 1})
    owner = literal_table(spark, "arc int, low bigint, high bigint", arcs).select("arc", F.explode(F.sequence("low", "high")).alias("bin"))
    bins = placed.groupBy(F.col(bin_).alias("bin")).agg(F.count("*").alias("n")).join(owner, "bin")
    before = Window.partitionBy("arc").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))

    counts = {r.arc: r.n for r in bins.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    plan = overflow([counts.get(i, 0) for i in range(len(points))], [s for _, s in points], quotas(total, shards, slack))
    plan = literal_table(spark, "arc int, first bigint, last bigint, shard int, base bigint, hops int", plan)
    plan = plan.groupBy("arc").agg(F.collect_list(F.struct("first", "last", "shard", "base", "hops")).alias("pieces"))
    home = literal_table(spark, "arc int, home int", [{"arc": i, "home": s} for i, (_, s) in enumerate(points)])
    # One row for each virtual node, at most one piece for each shard in it: far below the broadcast limit.
    bins = bins.join(F.broadcast(plan.join(home, "arc")), "arc")
    bins = bins.select(F.col("bin").alias(bin_), F.col("offset").alias(rank), F.col("pieces").alias(pieces), F.col("home").alias(arc))

    order = Window.partitionBy(bin_).orderBy(at, *by)
    ranked = placed.withColumn(at, F.row_number().over(order)).join(bins, bin_)
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(at) - 1)
    ranked = ranked.withColumn(pieces, F.filter(pieces, lambda p: (p["first"] <= F.col(rank)) & (F.col(rank) <= p["last"]))[0])
    piece = F.col(pieces)
    sharded = ranked.select(
        *docs.columns,
        piece["shard"].alias("shard"),
        (piece["base"] + F.col(rank) - piece["first"]).alias("slot"),
        F.col(arc).alias("home_shard"),
        piece["hops"].alias("hops"),
    )
    return hidden.restore(sharded, "shard", "slot", "home_shard", "hops")
