"""Importance resampling towards a target's distribution of word n-grams.

Words become a table of positions: one row for each word of a row, by posexplode.  ``lead`` over a
row's positions gives the words that follow, and joined with them every n-gram of each order that
starts there.  N-grams are hashed into buckets; what a bucket gains, the logarithm of its rate in
the target over its rate in the corpus, is joined to each n-gram and summed by row.  Gumbel noise
on the sums makes the highest ones a draw without replacement in proportion to the weights.

Texts, not words, are dealt to tasks, so the windows of ``lead`` need no shuffle of the positions;
counts and sums are aggregated before they are shuffled.  The table of gains has a row for each
bucket, a fixed number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm.common import CRC_TABLE_SQL, Hidden, crc_sql, lower_az, shared_folder, write_stage

#: Runs of digits, letters and whatever lies beyond ASCII; letters in both cases, as words are lower-cased one by one.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def positions(rows: DataFrame, text: str) -> DataFrame:
    """A row for each word: the other columns, ``_at`` from 0 and ``_word``; a row without words keeps one, both null."""
    others = [c for c in rows.columns if c != text]
    found = rows.select(*others, F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("_at", "_word"))
    return found.withColumn("_word", lower_az(F.col("_word")))


def grams(rows: DataFrame, text: str, row: str, orders: tuple[int, int], buckets: int) -> DataFrame:
    """A row for each n-gram of the orders ``first`` to ``last``: the other columns, ``_at`` and ``_bucket``.

    ``row`` tells rows apart.  A row of ``rows`` without n-grams keeps rows whose bucket is null.
    """
    first, last = orders
    if last > 1:
        # The exchange is of texts; what is made of a row's text then is in its task already.
        rows = rows.repartition(row)
    out = positions(rows, text)
    if last > 1:
        along = Window.partitionBy(row).orderBy("_at")
        out = out.withColumns({f"_w{k}": F.lead("_word", k).over(along) for k in range(1, last)})
    following = ["_word", *[f"_w{k}" for k in range(1, last)]]
    # concat is null where a following word is.
    made = [F.concat(*[p for k in range(n) for p in ([F.lit(" ")] if k else []) + [F.col(following[k])]]) for n in range(first, last + 1)]
    out = out.withColumn("_gram", made[0] if len(made) == 1 else F.explode(F.array(*made))).drop(*following)
    return out.withColumn("_bucket", F.crc32(F.col("_gram").cast("binary")) % buckets).drop("_gram")


def gains(corpus: DataFrame, target: DataFrame, text: str, target_text: str, orders: tuple[int, int], buckets: int, folder: str) -> DataFrame:
    """``(_bucket, gain)`` of the buckets that the corpus fills, a thousand times the logarithm, rounded down."""
    sides = [
        grams(t.select(F.col(c).alias("_text"), F.monotonically_increasing_id().alias("_row")), "_text", "_row", orders, buckets).select("_bucket", F.lit(k).alias("_side"))
        for k, (t, c) in enumerate(((corpus, text), (target, target_text)))
    ]
    counted = sides[0].union(sides[1]).filter("_bucket is not null").groupBy("_bucket").agg(F.count_if(F.col("_side") == 0).alias("s"), F.count_if(F.col("_side") == 1).alias("t"))
    counted = write_stage(counted, folder, "counts")
    s, t = counted.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    whole = lambda c, n: F.col(c).cast("double") + F.lit(float(n))
    rate = whole("t", 1) * F.lit(float(s + buckets)) / (whole("s", 1) * F.lit(float(t + buckets)))
    return counted.filter("s > 0").select("_bucket", F.floor(F.lit(1000.0) * F.log(rate)).alias("gain"))


def noise(key: Column, seed: str) -> Column:
    """A thousand times a standard Gumbel number of the key, rounded down; a null key counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", orders: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10) -> DataFrame:
    """Per row of ``docs``: its key, ``n_features``, ``weight``, ``score`` and ``rank``.

    Words are maximal runs of digits, letters and characters beyond ASCII, of whole texts,
    lower-cased in A-Z.  ``weight`` is the sum of the gains of a row's n-grams, repeats counted;
    ``score`` adds the noise of its key.  Of the rows with ``least_words`` words, ``percent`` of a
    hundred are drawn, rounded down: those of the highest scores, ties to the smaller key, null
    keys last.  ``rank`` counts the drawn rows in that order, and is null for others.

    A null or empty text has no words, no n-grams and weight 0.  Rows that repeat a key draw the
    same noise and are drawn each for itself; a null key is one more key.  A very long text is one
    row's work.  An empty table gives no rows, an empty target gains that only tell rare from
    frequent.  Other columns, whatever their names, are not looked at.
    """
    folder, hidden, aim = shared_folder(docs.sparkSession), Hidden(docs), Hidden(target)
    key, text, target_text = hidden(key), hidden(text), aim(target_text)
    gained = gains(hidden.df, aim.df, text, target_text, orders, buckets, folder)
    rows = hidden.df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    # A row for each bucket at most, whatever the corpus.
    each = grams(rows, "_text", "_row", orders, buckets).join(F.broadcast(gained), "_bucket", "left")
    sums = each.groupBy("_row", "_key").agg(F.count("_bucket").alias("n_features"), F.coalesce(F.max("_at") + 1, F.lit(0)).alias("_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = sums.withColumn("score", F.col("weight") + noise(F.col("_key"), seed))
    scored = write_stage(scored, folder, "scored")
    able = F.col("_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    ranked = numbered(scored.filter(able), [F.desc("score"), F.asc_nulls_last("_key"), F.desc("n_features"), F.asc("_row")], "rank", folder)
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return hidden.restore(out.withColumnRenamed("_key", key), "n_features", "weight", "score", "rank", names=[hidden.names[int(key[2:])]])


def numbered(rows: DataFrame, order: list[Column], name: str, folder: str) -> DataFrame:
    """The rows with their place in the order, from 1, as ``name``: sorted in ranges, then counted by range."""
    sorted_ = rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    # The id of a row is its partition's number in the upper bits and its place there in the lower 33.
    split = sorted_.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    split = write_stage(split, folder, "ranges")
    # A row for each partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return split.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


#: The query over ``documents`` and ``benchmark`` in SQL.
RESAMPLED_SQL = rf"""WITH {CRC_TABLE_SQL},
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
each AS (SELECT r, unnest(words) AS word FROM docs),
hashed AS (SELECT word, {crc_sql("word")} % 10000 AS bucket FROM (SELECT word FROM each UNION SELECT word FROM aim), crc_table),
own AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (word) GROUP BY bucket),
other AS (SELECT bucket, count(*) AS t FROM aim JOIN hashed USING (word) GROUP BY bucket),
gained AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM own) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM other) + 10000)::DOUBLE)))::BIGINT AS gain FROM own LEFT JOIN other USING (bucket)),
weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM each JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN weighed USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features DESC) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed"""
