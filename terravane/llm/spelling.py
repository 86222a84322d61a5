"""Spelling variants: words one edit apart, found by an inverted index of positional q-grams.

Two words of lengths a and b, b the longer one, that are one edit apart share at least b - 2q + 1
of their q-grams, at the same place or, behind an inserted letter, one further on.  So of the
grams of a word in one order of all grams (rare ones first, then by gram and place) that many
may be lost, and some gram among the first q + 1 of the longer word is among the first q of the
shorter one (q + 1, if the words are equally long).  Only those grams are posted:

* A posting list belongs to a gram, its place and the length of the words that are looked up in it.
  Words of that length post their first q + 1 grams; words one letter shorter ask for their first
  q grams, at the gram's own place and one further on.  So limits on length and place are part of
  the key.
* Lists are merged by Spark's sort, which spills, where one process would use a heap.  A list of
  more than BLOCK words is dealt into blocks, and tasks take pairs of blocks.
* Of a merged list, the pairs that share enough of *all* their grams under the place limit pass the
  count filter, and are verified letter by letter.  Only they leave the task.

Which gram is rare follows counts in RARITY buckets, whatever the vocabulary; another order would
find the same pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import CRC_TABLE_SQL, Hidden, crc_sql, drop_stages, lower_az, shared_folder, write_stage

#: Letters of a word: ASCII's, and U+00C0 to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Buckets of gram counts, and words of a list that one task takes against another such block.
RARITY, BLOCK = 65_536, 4096
#: Rows and columns of the part of a merged list that is counted at once.
TILE = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_ROUTED = pa.schema([("list", pa.int64()), ("length", pa.int32()), ("asks", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def word_counts(docs: DataFrame, text: str, key: str, least: int, written: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(word, n)`` of the letter runs of whole texts with at least ``least`` letters, lower-cased in A-Z.

    ``written`` says what becomes of a run, given the key and the run; what is shorter then is not counted.
    """
    found = docs.select(F.col(key).alias("_key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("_run"))
    found = found.withColumn("_run", lower_az(F.col("_run")))
    word = written(F.col("_key"), F.col("_run")) if written else F.col("_run")
    return found.select(word.alias("word")).filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def letters(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their code points as a matrix."""
    lengths = np.asarray(pc.utf8_length(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        joined = "".join(words.take(pa.array(rows)).to_pylist())
        yield rows, np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), length)


def grams_of(codes: np.ndarray, q: int) -> np.ndarray:
    """A number for each gram, by row and place; up to three letters it is the gram itself."""
    places = codes.shape[1] - q + 1
    out = np.zeros((len(codes), places), dtype=np.uint64)
    for k in range(q):
        out = out * np.uint64(1 << 21) + codes[:, k : k + places]
    return out


def _bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams * _MULTIPLIER) >> np.uint64(48)).astype(np.int64) % RARITY


def _count_grams(q: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, dtype=np.int64)
        for batch in batches:
            for _, codes in letters(batch.column("word")):
                total += np.bincount(_bucket(grams_of(codes, q)).ravel(), minlength=RARITY)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "grams"])

    return work


def posted(codes: np.ndarray, q: int, counts: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """What words of one length post and ask for: (length of the list's words, whether it asks, rows, list)."""
    grams, length = grams_of(codes, q), codes.shape[1]
    place = np.broadcast_to(np.arange(grams.shape[1]), grams.shape)
    order = np.lexsort((place, grams, counts[_bucket(grams)]), axis=1)[:, : q + 1]
    first = np.take_along_axis(grams, order, axis=1)

    def lists(at: np.ndarray, of: np.ndarray, words: int) -> np.ndarray:
        return ((of ^ (np.uint64(words) << np.uint64(40))) * _MULTIPLIER + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)

    rows = np.broadcast_to(np.arange(len(codes))[:, None], order.shape)
    yield length, False, rows.ravel(), lists(order, first, length).ravel()
    for further in (0, 1):
        yield length + 1, True, rows[:, :q].ravel(), lists(order[:, :q] + further, first[:, :q], length + 1).ravel()


def _route(q: int, counts):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word"), batch.column("n")
            for rows, codes in letters(words):
                for k in range(0, len(rows), 8192):
                    for length, asks, at, lists in posted(codes[k : k + 8192], q, counts.value):
                        at = pa.array(rows[k : k + 8192][at])
                        yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(np.full(len(lists), length, np.int32)), pa.array(np.full(len(lists), asks)), words.take(at), n.take(at)], schema=_ROUTED)

    return work


class Lettered:
    """Words of one length: their letters, and sixteen bits of each gram, by place."""

    def __init__(self, codes: np.ndarray, q: int) -> None:
        self.codes = codes
        # More grams may seem shared than are, never fewer.
        self.grams = np.ascontiguousarray((grams_of(codes, q) * _MULTIPLIER >> np.uint64(48)).astype(np.uint16).T)


def shared_grams(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many grams of a are in b at their place or, if b has one more, one further on; places first, the rest broadcasts."""
    out = 0
    for p in range(len(a)):
        same = a[p] == b[p]
        if len(b) > len(a):
            same |= a[p] == b[p + 1]
        out = out + same.astype(np.uint8 if len(a) < 256 else np.int32)
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters, b's as wide as a's or one wider, differ by one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + behind >= a.shape[1]


def close(a: Lettered, b: Lettered, groups: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words of a and of b one edit apart, of groups (first of a, number, first of b, number).

    Large groups are counted tile by tile, small ones many at a time.
    """
    least = b.codes.shape[1] - 2 * q + 1
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), 50_000):
            u, v = i[k : k + 50_000], j[k : k + 50_000]
            good = one_edit(a.codes[u], b.codes[v])
            left.append(u[good])
            right.append(v[good])

    pairs = groups[:, 1] * groups[:, 3]
    for first, n, other, m in groups[pairs > TILE].tolist():
        for r in range(first, first + n, TILE):
            for s in range(other, other + m, TILE):
                u, v = a.grams[:, r : min(r + TILE, first + n), None], b.grams[:, None, s : min(s + TILE, other + m)]
                i, j = np.nonzero(shared_grams(u, v) >= least)
                keep(r + i, s + j)
    groups, pairs = groups[pairs <= TILE], pairs[pairs <= TILE]
    ends = np.cumsum(pairs)
    for part in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(ends // 400_000)) + 1):
        n = pairs[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        m = np.repeat(groups[part, 3], n)
        i, j = np.repeat(groups[part, 0], n) + at // m, np.repeat(groups[part, 2], n) + at % m
        good = np.flatnonzero(shared_grams([g[i] for g in a.grams], [g[j] for g in b.grams]) >= least) if len(i) else i
        keep(i[good], j[good])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_in_lists(rows: pa.RecordBatch, q: int) -> pa.RecordBatch:
    """The near pairs, both ways, of whole lists: rows sorted by list, length, i, j, asks and side."""
    words, n = rows.column("word"), rows.column("n")
    place, lettered, row_of = np.zeros(rows.num_rows, dtype=np.int64), {}, {}
    for at, codes in letters(words):
        place[at], lettered[codes.shape[1]], row_of[codes.shape[1]] = np.arange(len(at)), Lettered(codes, q), at
    keys = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("list", "length", "i", "j")]
    asks, side, cross = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "side", "cross"))
    begin = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    own, other, asking = (np.add.reduceat(x.astype(np.int64), begin) for x in (~asks & (side == 0), ~asks & (side == 1), asks))
    lengths, single = keys[1][begin], ~cross[begin]
    xs, ys = [], []
    for length in np.unique(lengths).tolist():
        here = lengths == length
        for first, n_first, second, n_second, short in (
            (begin, own, begin, own * single, length),
            (begin, own, begin + own, other, length),
            (begin + own + other, asking, begin, own, length - 1),
        ):
            some = np.flatnonzero(here & (n_first > 0) & (n_second > 0))
            if len(some):
                groups = np.stack([place[first[some]], n_first[some], place[second[some]], n_second[some]], axis=1)
                x, y = close(lettered[short], lettered[length], groups, q)
                x, y = row_of[short][x], row_of[length][y]
                if second is first:
                    # A block meets itself from both sides.
                    x, y = x[x < y], y[x < y]
                xs.append(x)
                ys.append(y)
    x, y = (np.concatenate([np.zeros(0, dtype=np.int64), *v]) for v in (xs, ys))
    a, b = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
    return pa.RecordBatch.from_arrays([words.take(a), words.take(b), n.take(b)], schema=_NEAR)


def _merged(q: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, waiting = ("list", "length", "i", "j"), []
        of_row = lambda batch, k: [batch.column(c)[k].as_py() for c in keys]
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last list of a batch may go on in the next one.
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            before = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
            cut = int(before[-1]) + 1 if len(before) else 0
            if not cut and waiting and of_row(waiting[-1], waiting[-1].num_rows - 1) != of_row(batch, 0):
                ready, waiting = waiting, [batch]
            elif cut:
                ready, waiting = [*waiting, batch.slice(0, cut)], [batch.slice(cut)]
            else:
                waiting.append(batch)
                continue
            yield near_in_lists(pa.concat_batches(ready), q)
        if waiting:
            yield near_in_lists(pa.concat_batches(waiting), q)

    return work


def near_words(words: DataFrame, least: int, folder: str) -> DataFrame:
    """``(word, near, near_n)``: every ordered pair one edit apart, of a table of distinct words ``(word, n)``.

    No word is shorter than ``least``, which is 4 or more.  A list of only asking words, or of one
    word, is dropped before it is dealt out.
    """
    spark = words.sparkSession
    q = min(3, least // 2)
    if q < 2:
        raise ValueError("words must have four letters at least")
    counted = words.select("word").mapInArrow(_count_grams(q), "bucket long, grams long").groupBy("bucket").agg(F.sum("grams").alias("grams"))
    # RARITY rows at most.
    counts = np.zeros(RARITY, dtype=np.int64)
    for row in counted.collect():
        counts[row.bucket] = row.grams
    routed = write_stage(words.mapInArrow(_route(q, spark.sparkContext.broadcast(counts)), "list long, length int, asks boolean, word string, n long"), folder, "routed")
    key = ["list", "length"]
    sizes = routed.groupBy(*key).agg(F.count_if(~F.col("asks")).alias("own"), F.count_if("asks").alias("asking")).filter("own > 0 and own + asking > 1")
    sizes = sizes.select(*key, F.ceil(F.col("own") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("parts"))
    rows = routed.join(sizes, key).withColumn("at", F.pmod(F.xxhash64("word"), F.when(F.col("asks"), F.col("parts")).otherwise(F.col("blocks"))).cast("int"))
    # Block i of a list meets itself and each later block j, and each part of the words that ask: those are numbered behind the blocks.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    blocks = F.transform(every, lambda k: pair(F.least("at", k), F.greatest("at", k), F.when(F.col("at") <= k, 0).otherwise(1)))
    asked = F.when(F.col("parts") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0))), lambda k: pair(F.col("at"), F.col("blocks") + k, 0)))
    asking = F.transform(every, lambda k: pair(k, F.col("blocks") + F.col("at"), 1))
    # A list of one block and one part is one meeting.
    small = (F.col("blocks") == 1) & (F.col("parts") <= 1)
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    meetings = F.when(small, F.array(pair(F.lit(0), F.lit(0), 0))).when(F.col("asks"), asking).otherwise(F.concat(blocks, F.coalesce(asked, none)))
    dealt = rows.select(*key, "asks", "word", "n", F.explode(meetings).alias("m")).select(*key, "m.i", "m.j", "m.side", "asks", (F.col("m.i") != F.col("m.j")).alias("cross"), "word", "n")
    dealt = dealt.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "asks", "side")
    found = dealt.mapInArrow(_merged(q), "word string, near string, near_n long")
    # A pair may share several posted grams.
    return write_stage(found.distinct(), folder, "near")


def followed(forms: DataFrame, rounds: int) -> DataFrame:
    """``(word, root)``: where chains of ``(word, form)`` end, by doubling; 2 ** rounds is at least the longest chain."""
    up = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        further = up.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        up = up.join(further, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
    return up


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least_letters: int = 7, least_n: int = 2, times: int = 10, written: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Per word of the corpus: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    Words are the distinct maximal runs of letters (ASCII and U+00C0 to U+00FF) of whole texts,
    lower-cased in A-Z, with ``least_letters`` letters and ``least_n`` occurrences.  Words are near
    that differ by one inserted, deleted or replaced letter.  A word's form is its near word of
    most occurrences (ties: the first in code point order) if that has ``times`` as many as itself;
    its root is where forms lead, itself if it has none.  ``written`` may change a run, given its
    row's key, before it is counted.

    Null and empty texts have no words; repeated rows count each for itself; a null key is one more
    key; very long texts and words are one row's work; an empty table gives no rows.  Other
    columns, whatever their names, are not looked at.
    """
    if times < 2 or least_n < 1:
        raise ValueError("a form has at least twice as many occurrences")
    spark = docs.sparkSession
    folder, hidden = shared_folder(spark), Hidden(docs)
    counted = word_counts(hidden.df, hidden(text), hidden(key), least_letters, written)
    words = write_stage(counted.filter(F.col("n") >= least_n), folder, "words")
    near = near_words(words, least_letters, folder)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near", "near_n")).alias("best"))
    about = words.join(best, "word", "left").withColumn("has", F.col("best.near_n") >= times * F.col("n"))
    about = about.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), F.col("best.near_n")).alias("form_n"))
    about = write_stage(about, folder, "about")
    drop_stages(spark, folder, "routed", "words", "near")
    # Each step multiplies the count, so the largest count bounds a chain.
    top, steps = about.agg(F.max("n")).first()[0] or 0, 0
    while least_n * times ** (steps + 1) <= top:
        steps += 1
    roots = followed(about.filter("form is not null").select("word", "form"), max(steps - 1, 0).bit_length())
    return about.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def mistyped(key: Column, run: Column, every: int = 31) -> Column:
    """A run without one of its letters, if its checksum together with the key is a multiple of ``every``; a null key counts as the empty text."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


#: The query over ``documents`` in SQL: words that are near share a form with one letter left out or blotted.
VARIANTS_SQL = rf"""WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
long_runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {crc_sql("k")} AS h FROM long_runs, crc_table),
written AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM places),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
about AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, coalesce(form, word) AS root, 0 AS steps FROM about UNION ALL SELECT c.word, a.form, steps + 1 FROM chain c JOIN about a ON c.root = a.word WHERE a.form IS NOT NULL)
SELECT word, form, arg_max(root, steps) AS root, n, n_near, form_n FROM about JOIN chain USING (word) GROUP BY ALL"""
