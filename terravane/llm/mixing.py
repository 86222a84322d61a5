"""Mixing sources to target weights over fixed-length token blocks, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm.common import Hidden

#: Words are maximal runs of characters other than space, tab, newline, vertical tab, form feed and return.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Parts of a source whose words are counted side by side.
BINS = 1 << 14
ROUNDS = 24
#: Slots that are dealt out together.
PIECE = 1024


def words(text: Column) -> Column:
    """The words of a text; none for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words, without building a second list of them."""
    pieces = F.size(F.split(text, SPACES)) - text.rlike("^[\\x20\\x09-\\x0D]").cast("int") - text.rlike("[\\x20\\x09-\\x0D]\\z").cast("int")
    return F.when(F.length(text) > 0, pieces).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``.

    Weights go to the sources in code point order, null last, and repeat.  The targets share the
    sum of all sizes by weight; none exceeds ``cap`` times its source's size, and what that cuts
    off is shared among the others by weight, again and again.  This is a common level: with the
    sources in the order of ``cap * size / weight`` a prefix is capped, and the rest divides what
    remains.  One row for each source is all that these windows order.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    ordered = ordered.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("limit") / F.col("w"))
    by_ratio = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    weight = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = ordered.withColumn("level", rest / weight)
    level = F.coalesce(F.min_by("level", F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(everything), F.lit(0.0))
    return levels.withColumn("target", F.least("limit", F.col("w") * level)).select("source", "source_size", "target")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A keyed pseudorandom permutation of 0..n-1 (swap-or-not, which fits any n) at ``index``."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("shift"), r, *key), n) - x, n)
        swap = F.xxhash64(F.greatest(x, partner), r, *key) % 2 != 0
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def streams(docs: DataFrame, text: str, key: str, source: str, start: str, size: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their word count and where their words start in their source's token stream; source sizes.

    The stream's order is pseudorandom in (key, text).  A prefix sum over bins keeps any source,
    however large, out of a single task.
    """
    bin_ = "_bin"
    base = docs.withColumn(size, word_count(F.col(text)))
    base = base.withColumn(start, F.xxhash64(key, text)).withColumn(bin_, F.pmod(start, F.lit(BINS)))
    inside = Window.partitionBy(source, bin_).orderBy(start, key, size).rowsBetween(Window.unboundedPreceding, -1)
    ranked = base.withColumn(start, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    # Totals come from the ranked rows, so that Spark can use their exchange again and reads the texts once.
    totals = ranked.groupBy(F.col(source).alias("s"), F.col(bin_).alias("b")).agg(F.max(F.col(start) + F.col(size)).alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = ranked.join(offsets, F.col(source).eqNullSafe(F.col("s")) & F.col(bin_).eqNullSafe(F.col("b")))
    sizes = totals.groupBy(F.col("s").alias("source")).agg(F.sum("n").alias("source_size"))
    return joined.withColumn(start, F.col(start) + F.col("offset")).drop("s", "b", "offset", bin_), sizes


def draws(plan: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """What fills each slot of the output: ``(source, shard, slot, pass, block, length)``.

    ``plan`` has ``source``, ``source_size`` and ``target``.  A source of target t draws the blocks
    of its passes one after the other until it has t words, of the last of them only what is
    missing.  The output is a row of slots, one for each draw of all sources, cut into shards of
    ``shard_slots``.  The urn of all draws is laid out on the slots by a pseudorandom permutation:
    so each shard's source counts are a multinomial draw, under the condition that all shards
    together have every source's number of draws.  Draw i of a source is entry i mod n of its pass
    i div n over its n blocks, and each pass takes the blocks by its own pseudorandom permutation
    of their indices; a shorter block at the stream's end is always a pass's last, so that the
    words of a part of a pass are known beforehand.  No block is drawn again before all others
    have been.
    """
    whole = Window.partitionBy(F.lit(0))
    plan = plan.filter("source_size > 0 and target > 0").withColumn("n", F.ceil(F.col("source_size") / block))
    plan = plan.withColumn("words", F.round("target").cast("long"))
    plan = plan.withColumn("passes", F.expr("words div source_size")).withColumn("rest", F.expr("words % source_size"))
    plan = plan.withColumn("draws", F.col("passes") * F.col("n") + F.ceil(F.col("rest") / block))
    plan = plan.withColumn("high", F.sum("draws").over(whole.orderBy(F.col("source").asc_nulls_last())))
    plan = plan.withColumn("total", F.sum("draws").over(whole)).withColumn("low", F.col("high") - F.col("draws"))

    # Slots come from each source's own range of the urn, cut into large and then small pieces.
    def cut(df: DataFrame, name: str, first: Column, end: Column, step: int) -> DataFrame:
        """A row for every ``step`` numbers from first to below end."""
        return df.withColumn(name, F.explode(F.sequence(first, end - 1, F.lit(step).cast("long"))))

    d = F.col("draws")
    slots = cut(plan.filter("draws > 0"), "large", F.lit(0).cast("long"), d, PIECE * PIECE)
    slots = cut(slots, "small", F.col("large"), F.least(F.col("large") + PIECE * PIECE, d), PIECE)
    # The rows are few bytes each but long to compute, so their number of partitions is not left to their size.
    slots = slots.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("source", "small"))
    slots = cut(slots, "i", F.col("small"), F.least(F.col("small") + PIECE, d), 1)
    slots = slots.withColumn("slot", permuted(F.col("low") + F.col("i"), F.col("total"), F.lit(seed), F.lit("slot")))
    slots = slots.withColumn("pass", F.expr("i div n")).withColumn("entry", F.expr("i % n"))
    short = (F.col("source_size") % block != 0).cast("long")
    full = F.col("n") - short
    block_of = F.when(F.col("entry") < full, permuted(F.col("entry"), full, F.lit(seed), F.col("source"), F.col("pass"))).otherwise(F.col("entry"))
    length = F.when((F.col("pass") == F.col("passes")) & (F.col("i") == d - 1), F.col("rest") - F.col("entry") * block).otherwise(block)
    return slots.select("source", F.expr(f"slot div {shard_slots}").alias("shard"), "slot", "pass", block_of.alias("block"), length.cast("long").alias("length"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, block: int = 64, shard_slots: int = 1024, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of all rows by source: (rows, slots, picks).

    The columns of ``docs`` may not be called like those made here: see ``Hidden``.  Rows are
    those of ``docs`` with ``_size`` (words; 0 for null and empty texts), ``_start`` (its place in
    its source's token stream), ``source_size`` and ``target``.  Slots say which block of which
    source fills each place of each output shard; see ``draws``.  Picks are the slots joined with
    the blocks by index: ``(source, start, shard, slot, pass, first, last)``, where the slot takes
    words first..last-1 of the row at ``start``.  A source without words gets target 0.  Rows with
    equal key and text are interchangeable.
    """
    size, start = "_size", "_start"
    placed, sizes = streams(docs, text, key, source, start, size)
    plan = targets(sizes, weights, cap)
    slots = draws(plan, block, shard_slots, seed)

    spans = placed.filter(F.col(size) > 0).select(F.col(source).alias("source"), F.col(start).alias("start"), F.col(size).alias("size"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    same = spans["source"].eqNullSafe(slots["source"]) & (spans["block"] == slots["block"])
    # Their sizes are known too late for Spark: it takes what explode makes of a few rows for small.
    picks = spans.join(slots.hint("merge"), same).select(
        spans["source"],
        "start",
        "shard",
        "slot",
        "pass",
        F.greatest(spans["block"] * block - F.col("start"), F.lit(0)).alias("first"),
        F.least(spans["block"] * block + F.col("length") - F.col("start"), F.col("size")).alias("last"),
    )
    with_plan = placed.join(plan.withColumnRenamed("source", "_plan_source"), F.col(source).eqNullSafe(F.col("_plan_source"))).drop("_plan_source")
    return with_plan, slots, picks.filter("first < last")


def taken_words(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``taken``, ``n_slots`` and ``first_shard``.

    ``taken`` counts the words that the mix takes from the row, ``n_slots`` the slots of the output
    that hold some of them, and ``first_shard`` is the first shard with one, null if none has.
    Columns of ``docs`` that are called so give way.
    """
    hidden = Hidden(docs)
    source = hidden(source)
    rows, _, picks = mix(hidden.df, hidden(text), hidden(key), source, **options)
    of_row = [F.sum(F.col("last") - F.col("first")).alias("_taken"), F.count("*").alias("_slots"), F.min("shard").alias("first_shard")]
    sums = picks.groupBy(F.col("source").alias("_s"), F.col("start").alias("_at")).agg(*of_row)
    match = F.col(source).eqNullSafe(F.col("_s")) & (F.col("_start") == F.col("_at")) & (F.col("_size") > 0)
    out = rows.join(sums, match, "left")
    for name, found in (("taken", "_taken"), ("n_slots", "_slots")):
        out = out.withColumn(name, F.coalesce(found, F.lit(0)).cast("long"))
    return hidden.restore(out.withColumnRenamed("_size", "size"), "size", "source_size", "target", "taken", "n_slots", "first_shard")


def mixed_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one for each pass over a row's words.

    A pass that takes all words keeps the text as it is; a part of a pass keeps its words, joined
    by single spaces.  Rows of which nothing is drawn are not in the mix.
    """
    hidden = Hidden(docs)
    text, source = hidden(text), hidden(source)
    rows, _, picks = mix(hidden.df, text, hidden(key), source, **options)
    passes = picks.groupBy(F.col("source").alias("_s"), F.col("start").alias("_at"), "pass").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_spans"), F.sum(F.col("last") - F.col("first")).alias("_n"))
    match = F.col(source).eqNullSafe(F.col("_s")) & (F.col("_start") == F.col("_at"))
    out = rows.filter("_size > 0").join(passes, match)
    parts = F.flatten(F.transform("_spans", lambda s: F.slice(words(F.col(text)), (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int"))))
    cut = F.when(F.col("_n") == F.col("_size"), F.col(text)).otherwise(F.array_join(parts, " "))
    return hidden.restore(out.withColumn(text, cut))
