"""Corpus operators against brute force on small tables with every awkward kind of row."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from terravane.llm import embeddups, langid, media, mixing, neardup, pieces, repeats, rolling, sharding, toolcalls, warc
from terravane.llm.common import components, literal_table, shared_folder

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, source string, node string, size long, kept string, _text int"


def words(rng, n):
    return " ".join(rng.choice(["the", "over", "thon", "ing", "and", "blest", "of", "Ereat.", "with", "shand"]) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, blanks, repeated rows, a long text and a key shared by two texts."""
    rng = random.Random(4)
    base, passage = words(rng, 120), words(rng, 60)
    texts = [base, base, base.upper(), base + " tail", "intro " + passage + words(rng, 30), words(rng, 25) + passage, None, "", " \t\n ", "one", "One", "one two", "ab" * 400, "é" * 300, words(rng, 4000)]
    for k in range(1, 12):
        w = base.split()
        for i in rng.sample(range(len(w)), 3 * k):
            w[i] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    out = [(10 + i, t, "en", "ab"[i % 2] if i % 5 else None) for i, t in enumerate(texts)]
    out += [(10, base, "en", "a"), (None, base, None, "a"), (None, "alone here with some words", None, "b"), (11, "another text of eleven", "en", "a")]
    return [(*r, "clash", 7, "clash", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Near-duplicates.


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(docs, rows, n):
    got = neardup.near_duplicates(docs, words=n)
    assert got.columns == ["doc_id", "text", "lang", "source", "node", "size", "_text", "n_shingles", "component_id", "kept", "chosen"]
    sets = [shingle_set(r[1], n) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None]
        least = min(ids) if ids else None
        want[r[0], r[1], len(sets[i]), least, r[0] == least] += 1
    found = got.collect()
    assert Counter((r.doc_id, r.text, r.n_shingles, r.component_id, r.kept) for r in found) == want
    chosen = {(r.doc_id, r.text) for r in found if r.chosen and r.n_shingles}
    assert len(chosen) == len({group[i] for i in range(len(rows)) if sets[i]}) and all(r.chosen for r in found if not r.n_shingles)


def test_one_row_of_a_group_is_chosen_whatever_its_keys(spark):
    rng = random.Random(12)
    base = words(rng, 200)
    texts = [base, base.upper(), base + " tail", base + " other tail"]
    for keys in ([None] * 4, [7] * 4, [None, 7, 7, None], [9, 8, None, 8]):
        got = neardup.near_duplicates(spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")).collect()
        assert sum(r.chosen for r in got) == 1
        assert all(r.doc_id == min((k for k in keys if k is not None), default=None) for r in got if r.chosen)


def test_complementary_words_have_different_hashes():
    """Modulo 2**64 every base hashes the two texts alike."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits).encode() for flip in (0, 1))
    a, b = (neardup.shingles(np.frombuffer(t, dtype=np.uint8), 2) for t in (one, other))
    assert len(a) == len(b) == 1 and a[0] != b[0]
    p = rolling.prefix(np.frombuffer(one + other, dtype=np.uint8))
    assert rolling.windows(p, 1024)[0] != rolling.windows(p, 1024)[-1]


def test_near_duplicates_of_nothing(none):
    assert neardup.near_duplicates(none).count() == 0


def test_signatures_meet_within_the_radius():
    rng = np.random.default_rng(1)
    low = rng.integers(0, neardup.SYMBOL, (200, neardup.CHUNKS, neardup.CHUNK), dtype=np.uint64)
    other = low.copy()
    for k in range(200):
        at = rng.permutation(neardup.SYMBOLS)[: neardup.RADIUS]
        other[k].reshape(-1)[at] ^= np.uint64(1)
    pack = lambda x: (x << (np.arange(neardup.CHUNK, dtype=np.uint64) * np.uint64(neardup.LANE))).sum(axis=2, dtype=np.uint64)
    a, b = neardup.chunk_keys(pack(low)), neardup.chunk_keys(pack(other))
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_distance_counts_symbols(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(50):
        a, b = rng.integers(0, 3, (2, neardup.CHUNKS, neardup.CHUNK))
        pack = lambda x: [int(sum(int(v) << neardup.LANE * j for j, v in enumerate(c))) for c in x]
        rows.append((pack(a), pack(b), int((a != b).sum())))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, d int")
    assert df.filter(neardup.distance("x", "y") != F.col("d")).isEmpty()


def test_similarity_is_estimated():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 3000), dtype=np.uint64)
    b[:2000] = a[:2000]
    lanes = [((s[:, None] >> (np.arange(neardup.CHUNK, dtype=np.uint64) * np.uint64(neardup.LANE))) & np.uint64(neardup.SYMBOL)).ravel() for s in map(neardup.signature, (a, b))]
    assert abs((lanes[0] == lanes[1]).mean() - 0.5) < 0.2


def test_linked_to_equals_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(40)]
    own, labels = rng.integers(0, 5, (2, 20))
    got = neardup.linked_to(sets[:20], own, sets[20:], labels, 50)
    want = set()
    for i, a in enumerate(sets[:20]):
        good = [j for j, b in enumerate(sets[20:]) if 100 * len(np.intersect1d(a, b)) >= 50 * len(np.union1d(a, b)) and labels[j] != own[i]]
        want |= {(i, next(j for j in good if labels[j] == c)) for c in {labels[j] for j in good}}
    assert set(got) == want and len(got) == len(want)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark))
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long"), shared_folder(spark)).count() == 0


def test_components_run_no_round_that_changes_nothing(spark, monkeypatch):
    """Each round is a dozen exchanges, for each of which the driver keeps a thread for a minute."""
    from terravane.llm import common

    written, write = [], common.write_stage
    monkeypatch.setattr(common, "write_stage", lambda df, folder, name: written.append(name) or write(df, folder, name))
    for edges, rounds in (([(1, 2), (1, 3), (7, 5)], 0), ([(3, 1), (3, 2)], 1), ([(1, 2), (2, 3)], 1)):
        written.clear()
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark)).collect()}
        assert got == ({1: 1, 2: 1, 3: 1, 7: 5, 5: 5} if not rounds else {1: 1, 2: 1, 3: 1})
        assert len(written) == 1 + rounds


# Repeated byte strings.


def brute_repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    for b in data:
        cut = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                cut[i : i + n] = b"\1" * n
        spans = sum(1 for i, c in enumerate(cut) if c and not (i and cut[i - 1]))
        yield len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest()


@pytest.mark.parametrize("n", [200, 40, 7])
def test_repeats_equal_brute_force(docs, rows, n):
    got = repeats.remove_repeats(docs, length=n, keep=["doc_id", "_text", "kept"])
    want = Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], n), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_repeats_of_random_and_periodic_bytes(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(30)] + ["abc" * 20, "a" * 50, "b" * 12 + "q" + "b" * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, length=12).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 12)))


def test_a_lone_run_of_equal_bytes_repeats_itself(spark):
    texts = ["before " + "=" * 300 + " after", "-" * 201, "~" * 200, "#" * 200 + " and " + "#" * 199, "ab" * 101]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, length=200).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))
    assert [got[i][1] for i in range(4)] == [300, 201, 0, 0]


def test_ranges_of_copies_do_not_grow_with_the_copies(spark):
    rng = random.Random(15)
    text = words(rng, 200)
    texts = [text] * 40 + ["before " + text, words(rng, 100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("doc"), F.encode("text", "UTF-8").alias("bytes"))
    got = [tuple(r) for r in repeats.repeated_ranges(df.repartition(3), 200, shared_folder(spark)).collect()]
    assert got and len(got) == len(set(got))
    assert len({doc for doc, _, _ in got}) == 2


def test_repeats_keep_whole_characters(spark):
    df = spark.createDataFrame([("é" * 20 + "x",), ("yé" + "é" * 18,)], "text string")
    got = repeats.remove_repeats(df, length=31, with_kept=True).collect()
    assert {r.kept for r in got} <= {"x", "y", "éx", "yé"}
    assert repeats.remove_repeats(df.limit(0), with_kept=True).count() == 0


def test_window_hashes_depend_on_content_only():
    data = np.frombuffer(b"zzabcdefabcdefzz", dtype=np.uint8)
    h = rolling.windows(rolling.prefix(data), 6)
    assert h[2] == h[8] and len(set(h.tolist())) == len(h) - 1
    assert rolling.sliding_min(np.array([5, 3, 4, 1, 7, 9]), 3).tolist() == [3, 1, 1, 1]


# Sharding.


def brute_ring(keys, shards, virtual_nodes):
    """Every key, in ring order, goes to the arc's shard if its quota lasts, and else on, hop after hop."""
    points = sharding.ring(shards, virtual_nodes)
    room = sharding.quotas(len(keys), shards, 0)
    waiting = [[] for _ in points]
    for at, key in sorted(keys):
        waiting[next((i for i, (p, _) in enumerate(points) if p > at), 0)].append(key)
    out = {}
    for hop in range(len(points)):
        for arc, queue in enumerate(waiting):
            shard = points[(arc + hop) % len(points)][1]
            take, waiting[arc] = queue[: room[shard]], queue[room[shard] :]
            room[shard] -= len(take)
            out |= dict.fromkeys(take, shard)
    return out


def test_ring_equals_brute_force(spark):
    df = spark.range(3000).withColumn("at", F.pmod(F.xxhash64("id"), F.lit(sharding.RING)))
    keys = [(r.at, r.id) for r in df.collect()]
    got = sharding.shard_ring(df, "id", shards=5, virtual_nodes=7).collect()
    assert {r.id: r.shard for r in got} == brute_ring(keys, 5, 7)
    assert any(r.hops for r in got) and all(r.shard == r.home_shard for r in got if not r.hops)


def test_ring_is_balanced_and_gapless(docs, rows):
    got = sharding.shard_ring(docs.withColumn("shard", F.lit("old")), "doc_id", shards=4, spread=["text"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_ring_moves_little_and_repeats(spark):
    df = spark.range(4000)
    runs = [{r.id: r.shard for r in sharding.shard_ring(df.repartition(k), "id", shards=8, slack=0.25).select("id", "shard").collect()} for k in (2, 5)]
    assert runs[0] == runs[1]
    more = {r.id: r.shard for r in sharding.shard_ring(df, "id", shards=9, slack=0.25).select("id", "shard").collect()}
    assert sum(more[k] != runs[0][k] for k in more) < 0.4 * len(more)


def test_ring_with_one_hot_key_and_with_nothing(spark):
    same = spark.range(100).select(F.lit(None).cast("long").alias("k"))
    assert sorted(r["count"] for r in sharding.shard_ring(same, "k", shards=3).groupBy("shard").count().collect()) == [33, 33, 34]
    assert sharding.shard_ring(same.limit(0), "k").count() == 0


# Mixing.


def brute_targets(sizes, weights, cap):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > cap * sizes[s]]
        if not over:
            return fixed | {s: w[s] * level for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5, "ç": 300}, {"a": 1}, {"a": 0, "b": 0}, {"a": 1, "b": 1000, "c": 1, "d": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 3.0).collect()}
    assert got == pytest.approx(brute_targets(sizes, (5, 2, 1), 3))


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_mix_meets_targets(docs, rows):
    got = mixing.taken_words(docs, block=16).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    want = brute_targets(dict(sizes), (5, 2, 1), 3)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in mine) == pytest.approx(want[s], abs=1)
    assert all(r.taken <= 3 * r.size for r in got)
    again = mixing.taken_words(docs.repartition(7), block=16).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_equals_a_plain_one(docs):
    """Slots are filled in plain Python, and every word of a slot is given to its row."""
    block, shard_slots = 16, 8
    placed, slots, _ = mixing.mix(mixing.Hidden(docs).df, "_c1", "_c0", "_c3", block=block, shard_slots=shard_slots)
    placed, slots = placed.collect(), slots.collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots))) and all(r.shard == r.slot // shard_slots for r in slots)
    owner = {}
    for n, r in enumerate(placed):
        owner |= {(r._c3, r._start + k): n for k in range(r._size)}
    taken, homes, held = Counter(), {}, Counter()
    for r in slots:
        mine = {owner.get((r.source, r.block * block + k)) for k in range(r.length)} - {None}
        for n in mine:
            homes.setdefault(n, []).append(r.shard)
        for k in range(r.length):
            if (r.source, r.block * block + k) in owner:
                taken[owner[r.source, r.block * block + k]] += 1
                held[r.source, r["pass"], r.block] += 1
    got = Counter((r.doc_id, r.text, r.taken, r.n_slots, r.first_shard) for r in mixing.taken_words(docs, block=block, shard_slots=shard_slots).collect())
    assert got == Counter((r._c0, r._c1, taken[n], len(homes.get(n, [])), min(homes.get(n, []), default=None)) for n, r in enumerate(placed))
    # A pass has every block of its source once, the last pass a part of them.
    passes = {}
    for s, p, b in held:
        passes.setdefault((s, p), []).append(b)
    for (s, p), blocks in passes.items():
        assert len(blocks) == len(set(blocks)) and ((s, p + 1) not in passes or len(blocks) == -(-sum(r._size for r in placed if r._c3 == s) // block))


def test_shards_draw_sources_by_their_share(spark):
    plan = spark.createDataFrame([("a", 64 * 4000, 64 * 6000.0), ("b", 64 * 900, 64 * 1800.0), (None, 50, 75.0)], "source string, source_size long, target double")
    slots = mixing.draws(plan, 64, 100, 0).collect()
    counts = Counter((r.shard, r.source) for r in slots)
    assert Counter(r.source for r in slots) == {"a": 6000, "b": 1800, None: 2}
    share = np.array([counts[k, "a"] for k in range(78)])
    expected = np.sqrt(100 * 6000 / 7802 * 1802 / 7802)
    assert abs(share.mean() - 100 * 6000 / 7802) < 1 and 0.7 * expected < share.std() < 1.3 * expected
    assert sum(min(r.length, 50) for r in slots if r.source is None) == 75


def test_mixed_rows_hold_the_words_taken(docs):
    taken = Counter()
    for r in mixing.taken_words(docs, block=16).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_rows(docs, block=16)
    assert mixed.columns == docs.columns
    held = Counter()
    for r in mixed.collect():
        held[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert held == +taken


def test_mix_of_nothing(none):
    assert mixing.taken_words(none).count() == 0 and mixing.mixed_rows(none).count() == 0


# Archives.


def test_archives_round_trip(spark):
    long = "x" * 1500
    pages = [(1, "http://a/", long), (5, "http://b/\r\nX: y", long), (3, None, long), (2, "u", "short"), (9, "u", "short"), (4, "u", None), (4, "u", None), (None, "u", "é" * 900), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3")]
    df = spark.createDataFrame([(*p, 1, "c") for p in pages], "page_id long, url string, html string, file int, page string").repartition(3)
    records, folder = warc.archive_round_trip(df)
    got = Counter((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect())
    want = Counter()
    for page, _, html in pages:
        data = (html or "").encode()
        revisit = html == long and page != 5
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None] += 1
    assert got == want
    assert warc.archive_round_trip(df.limit(0))[0].count() == 0
    whole = b"".join(r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "*members.warc.gz").load(f"{folder}/archives").collect())
    assert sum(1 for _ in warc.records(iter([zlib.decompress(m, 31) for m in members(whole)]))) == len(pages)


def members(data):
    while data:
        machine = zlib.decompressobj(31)
        machine.decompress(data)
        yield data[: len(data) - len(machine.unused_data)]
        data = machine.unused_data


def test_truncated_archives_are_refused():
    one = warc.record(1, "u", b"abc", b"0" * 20, None)
    assert list(warc.records(iter([one[:9], one[9:] + one]))) == [one, one]
    with pytest.raises(ValueError):
        list(warc.records(iter([one[:-2]])))


# Tool calls.


def test_calls_are_linked_ordered_and_validated(spark):
    calls = [
        ("c", 1, "a", "add", '{"y": 2, "x": 1}', None),
        ("c", 2, "b", "add", '{"x": "1", "z": null}', ["a"]),
        ("c", 3, "d", "add", "not json", ["b", "a", "gone"]),
        ("c", 4, "p", "none", "{}", ["q"]),
        ("c", 5, "q", "add", '{"x": 1.5, "y": 1}', ["p"]),
        ("c", 6, "t", "add", '{"x": 1, "y": 2}', []),
        ("c", 7, "t", "add", '{"x": 1, "y": 2}', None),
        ("c", 8, None, "add", None, None),
    ]
    results = [("c", 0, "d", "early"), ("c", 9, "a", 'say "é"\n'), ("c", 10, "nobody", "x"), ("c", 11, "t", "x"), ("c", 12, None, None), ("c", 13, "p", "x")]
    schemas = literal_table(spark, toolcalls.SCHEMA, [{"tool": "add", "parameter": p, "kind": "number", "required": True} for p in "xy"])
    out = toolcalls.link_calls(
        spark.createDataFrame(calls, "conv_id string, turn long, call_id string, tool string, arguments string, needs array<string>"),
        spark.createDataFrame(results, "conv_id string, turn long, call_id string, content string"),
        schemas,
    ).collect()
    assert len(out) == len(calls) + len(results)
    by = {(r.kind, r.turn): r for r in out}
    assert {k: (r.status, r.step) for k, r in by.items() if r.step is not None} == {
        ("call", 1): ("linked", 0), ("call", 2): ("unanswered", 2), ("call", 3): ("linked", 4), ("result", 0): ("linked", 5), ("result", 9): ("linked", 1),
        ("call", 6): ("ambiguous", 0), ("call", 7): ("ambiguous", 0), ("result", 11): ("ambiguous", 1),
    }
    assert by["call", 4].status == by["call", 5].status == by["result", 13].status == "cyclic" and by["result", 10].status == by["result", 12].status == "orphan"
    assert [by["call", k].errors for k in (1, 2, 3, 4, 5)] == [[], ["missing: y", "not number: x", "unexpected: z"], ["no object"], ["unknown tool"], []]
    assert by["call", 1].json == '{"arguments":{"x":1,"y":2},"call_id":"a","conv_id":"c","kind":"call","status":"linked","step":0,"tool":"add","turn":1}'
    assert by["result", 9].json == '{"call_id":"a","content":"say \\"é\\"\\n","conv_id":"c","kind":"result","status":"linked","step":1,"turn":9}'


CALLS, RESULTS = "conv_id string, turn long, call_id string, tool string, arguments string, needs array<string>, depth int, c string, first int", "conv_id string, turn long, call_id string, content string, n int, row int"


def test_identifiers_hold_within_a_conversation(spark):
    calls = [(c, 1, "call_0", "add", '{"x": 1, "y": 2}', None, 9, "c", 1) for c in ("a", "b", None)]
    calls += [("d", 1, "t", "add", '{"x": 1, "y": 2}', None, 9, "c", 1), ("d", 2, "t", "nope", "{}", None, 9, "c", 1), ("d", 3, None, "nope", "{}", None, 9, "c", 1), ("d", 4, None, "add", "{}", [None, "t"], 9, "c", 1)]
    results = [(c, 2, "call_0", "x", 1, 1) for c in ("a", None)]
    schemas = literal_table(spark, toolcalls.SCHEMA, [{"tool": "add", "parameter": p, "kind": "number", "required": True} for p in "xy"])
    out = toolcalls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    assert {(r.conv_id, r.turn): (r.status, r.errors, r.step) for r in out if r.kind == "call"} == {
        ("a", 1): ("linked", [], 0), ("b", 1): ("unanswered", [], 0), (None, 1): ("linked", [], 0), ("d", 1): ("ambiguous", [], 0), ("d", 2): ("ambiguous", ["unknown tool"], 0),
        ("d", 3): ("unanswered", ["unknown tool"], None), ("d", 4): ("unanswered", ["missing: x", "missing: y"], None),
    }
    assert [(r.status, r.step) for r in out if r.kind == "result"] == [("linked", 1)] * 2


def test_depths_of_long_chains_and_webs(spark):
    rng = random.Random(6)
    needs = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(200)}
    needs |= {f"w{k}": [f"w{j}" for j in rng.sample(range(k), min(k, 2))] + ["c7"] * (k == 5) + ["lost"] for k in range(12)}
    needs |= {"x": ["y"], "y": ["z"], "z": ["x"], "behind": ["x"], "both": ["behind", "c3"], "self": ["self"], "after": ["c199"]}

    def depth(x, seen=()):
        if x in seen:
            return None
        found = [depth(y, (*seen, x)) for y in needs[x] if y in needs]
        return None if None in found else max(found, default=-1) + 1

    df = spark.createDataFrame(list(needs.items()), "id string, needs array<string>")
    got = {r.id: r.depth for r in toolcalls.depths(df, shared_folder(spark)).collect()}
    assert got == {x: d for x in needs if (d := depth(x)) is not None}


def test_calls_of_nothing(spark):
    calls, results = toolcalls.conversation_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert toolcalls.link_calls(calls, results, literal_table(spark, toolcalls.SCHEMA, toolcalls.REPLY)).count() == 0


# Vectors.


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(12):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), (base + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])).tolist(), k % 3))
    good = len(rows)
    rows += [(1000, [0.0] * 16, 1), (1001, None, 1), (1002, [], 1), (1003, [1.0, None] * 8, 1), (1004, [float("nan")] * 16, 1), (1005, [float("inf")] * 16, 1), (1006, rows[0][1], None), (1007, rows[0][1][:8], 0), (1008, [x * 1e200 for x in rows[0][1]], 0)]
    rows.append((None, rows[0][1], 0))
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, node int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddups.near_duplicate_vectors(df).collect()}
    use = [i for i in (*range(good), len(rows) - 2)]
    unit = np.array([rows[i][1] for i in use])
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array([rows[i][2] for i in use])[:, None] == np.array([rows[i][2] for i in use]))
    np.fill_diagonal(near, False)
    label = np.arange(len(use))
    for _ in range(len(use)):
        label = np.array([min(label[i], label[near[i]].min(initial=len(use))) for i in range(len(use))])
    for k, i in enumerate(use):
        v = rows[i][0]
        assert got[v] == (near[k].sum(), rows[use[label[k]]][0], label[k] == k)
    assert all(got[v] == (0, v, True) for v in (*range(1000, 1008), None))
    assert embeddups.near_duplicate_vectors(df.limit(0)).count() == 0


def test_copies_of_vectors_are_counted_by_their_rows(spark):
    rng = np.random.default_rng(16)
    base = rng.standard_normal(24)
    near = base + rng.standard_normal(24) * 0.05
    rows = [(k, base.tolist(), "a") for k in range(30)] + [(30 + k, (near * 2.0**k).tolist(), "a") for k in range(4)] + [(50, base.tolist(), "b"), (7, (-base).tolist(), "a")]
    got = {}
    for r in embeddups.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(5)).collect():
        got.setdefault(r.vec_id, (r.n_links, r.component_id, r.kept))
    assert all(got[k] == (33, 0, k == 0) for k in range(34)) and got[50] == (0, 50, True)


def test_projections_recall_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * side
    found = sum(len(embeddups.block_links(a[k : k + 1], b[k : k + 1], 0.93, False)[0]) for k in range(len(a)))
    assert found >= 0.999 * len(a)


# Images.


def pgm(pixels):
    return b"P5\n# made here\n%d %d\n255\n" % pixels.shape[::-1] + pixels.astype(np.uint8).tobytes()


def png(pixels, filter_=0):
    raw, before = b"", np.zeros(pixels.shape[1], dtype=np.int64)
    for line in pixels.astype(np.int64):
        left = np.concatenate([[0], line[:-1]])
        corner = np.concatenate([[0], before[:-1]])
        p, q, r = abs(before - corner), abs(left - corner), abs(left + before - 2 * corner)
        paeth = np.where((p <= q) & (p <= r), left, np.where(q <= r, before, corner))
        guess = [0 * line, left, before, (left + before) // 2, paeth][filter_]
        raw += bytes([filter_]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        before = line
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    size = pixels.shape[1].to_bytes(4, "big") + pixels.shape[0].to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", size + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def scenes():
    rng = np.random.default_rng(9)
    out = []
    for _ in range(12):
        grid = rng.random((12, 12))
        at = np.clip((np.arange(120) + 0.5) / 10 - 0.5, 0, 11)
        low, part = np.minimum(at.astype(int), 10), 0
        part = at - low
        rows = grid[low] * (1 - part)[:, None] + grid[low + 1] * part[:, None]
        out.append(np.rint((rows[:, low] * (1 - part) + rows[:, low + 1] * part) * 200 + 20))
    return out


def test_images_are_decoded(scenes):
    image = scenes[0][:40, :50]
    for data in (pgm(image), *[png(image, k) for k in range(5)]):
        assert np.array_equal(media.gray(data), image)
    for bad in (None, b"", b"GIF89a", b"P5\n9 9\n255\n12", png(image)[:60]):
        assert media.gray(bad) is None


def test_cropped_turned_and_edited_copies_are_found(spark, scenes):
    table = spark.createDataFrame([(k, pgm(s), "x") for k, s in enumerate(scenes)] + [(90, None, "x"), (91, b"no image", "x"), (None, pgm(scenes[0]), "x"), (92, pgm(np.full((80, 80), 9)), "x")], "image long, media binary, key string")
    queries = [(100, pgm(scenes[3][20:110, 10:100])), (101, pgm(np.rint(scenes[5] * 0.7 + 30))), (102, png(np.rot90(scenes[7]).copy())), (103, pgm(np.flipud(np.random.default_rng(1).random((90, 90)) * 255)))]
    found = media.find_copies(spark.createDataFrame(queries, "image long, media binary"), table).collect()
    assert {(r.query, r.image) for r in found} == {(100, 3), (101, 5), (102, 7)}
    by = {r.query: r for r in found}
    assert abs(by[100].dx - 10) <= 3 and abs(by[100].dy - 20) <= 3 and by[100].turn == 0 and by[100].steps == 0
    assert by[102].turn in (3.0, 9.0, 2.5, 8.5, 3.5, 9.5)
    assert media.find_copies(table.limit(0), table).count() == 0


def shrunk(pixels, by):
    return np.rint(media._shrink(pixels.shape[0], by) @ pixels.astype(np.float32) @ media._shrink(pixels.shape[1], by).T)


def test_smaller_copies_are_found(spark, scenes):
    table = spark.createDataFrame([(k, pgm(s), k) for k, s in enumerate(scenes)], "image long, media binary, query int")
    queries = [(100 + k, pgm(shrunk(scenes[k], 2 if k % 2 else 1 / 0.7))) for k in range(12)]
    found = media.find_copies(spark.createDataFrame(queries, "image long, media binary"), table).collect()
    right = {r.query: r.steps for r in found if r.image == r.query - 100}
    assert len(right) >= 10 and all(r.image == r.query - 100 for r in found)
    # Four steps of a quarter of an octave make a half, two make 0.7.
    assert all(steps == (4 if k % 2 else 2) for k, steps in right.items())


def test_copies_of_sizes_between_the_scales_are_found(spark, scenes):
    """Every scene at nine sizes and edits, among all: at least nine of ten found, hardly any wrong."""
    noise = np.random.default_rng(1)
    edits = [lambda s, f=f: shrunk(s, 1 / f) for f in (0.5, 0.6, 0.65, 0.7, 0.8, 0.85)]
    edits += [lambda s: s[20:110, 10:100], lambda s: np.rint(s * 0.7 + 30), lambda s: np.clip(np.rint(s + noise.normal(0, 3, s.shape)), 0, 255)]
    table = spark.createDataFrame([(k, pgm(s)) for k, s in enumerate(scenes)], "image long, media binary")
    asked = [(1000 * e + k, pgm(edit(s))) for e, edit in enumerate(edits) for k, s in enumerate(scenes)]
    found = {(r.query, r.image) for r in media.find_copies(spark.createDataFrame(asked, "image long, media binary"), table).collect()}
    right = {(q, i) for q, i in found if q % 1000 == i}
    for e in range(len(edits)):
        assert sum(q // 1000 == e for q, _ in right) >= 0.9 * len(scenes), e
    assert len(right) >= 0.98 * len(found)


def test_copies_equal_brute_force(spark, scenes):
    """All pairs of descriptors of all images instead of tables."""
    images = [s[:70, :70] for s in scenes[:6]] + [scenes[0][10:80, 5:75], scenes[1][:70, :70] * 0.8 + 9, np.full((70, 70), 3)]
    rows = [(k, pgm(p)) for k, p in enumerate(images)]
    df = spark.createDataFrame(rows, "image long, media binary")
    got = {(r.query, r.image): r.corners for r in media.find_copies(df, df).collect()}
    known = [media.descriptors(media.gray(m)[None]) for _, m in rows]
    want = {}
    for i, (_, a, x) in enumerate(known):
        for j, (_, b, y) in enumerate(known):
            votes = {}
            for p, bits in zip(a, x, strict=True):
                for q, other in zip(b, y, strict=True):
                    if int(np.unpackbits(bits ^ other).sum()) > media.MOST_BITS or not (bits.reshape(-1, 4) == other.reshape(-1, 4)).all(axis=1).any():
                        continue
                    p8, q8 = (np.array([np.rint(v[0] * 8) / 8, np.rint(v[1] * 8) / 8]) for v in (p, q))
                    angles = [np.rint(v[2] / media.TURN) % (1 << media.ANGLE) * media.TURN for v in (p, q)]
                    by = angles[1] - angles[0]
                    d = q8 - media.STEP ** (q[3] - p[3]) * np.array([np.cos(by) * p8[0] - np.sin(by) * p8[1], np.sin(by) * p8[0] + np.cos(by) * p8[1]])
                    for s in np.ndindex(2, 2, 2):
                        t, u, v = (np.floor(z + h / 2) - h / 2 + 0.5 for z, h in zip((by / (2 * np.pi / media.TURNS), *(d / media.WINDOW)), s, strict=True))
                        votes.setdefault((q[3] - p[3], t % media.TURNS, u, v), []).append((tuple(p), tuple(q)))
            most = max((min(len({p for p, _ in v}), len({q for _, q in v})) for v in votes.values()), default=0)
            if most >= media.LEAST_CORNERS:
                want[i, j] = most
    assert got == want and {(0, 6), (6, 0), (1, 7)} <= set(want)


def test_groups_of_copies_have_representatives(spark, scenes):
    rng = np.random.default_rng(4)
    rows = [(k * 100 + j, pgm(np.clip(scenes[k] + rng.normal(0, 1.0, scenes[k].shape), 0, 255))) for k in range(4) for j in range(1 + 8 * (k < 2))]
    described = media.describe(spark.createDataFrame(rows, "image long, media binary")).cache()
    got = {r.image: r.representative for r in media.representatives(described, shared_folder(spark)).collect()}
    assert all(a // 100 == b // 100 and b not in got for a, b in got.items())
    assert len(got) == 16
    assert media.representatives(described.limit(0), shared_folder(spark)).count() == 0


def all_corners(asked, known):
    """(query, image) -> corners that agree, from all pairs of descriptors; both name lists of media.descriptors."""
    out = {}
    for i, (a, x) in asked.items():
        for j, (b, y) in known.items():
            votes = {}
            for k, m in np.argwhere(np.unpackbits(x[:, None] ^ y, axis=2).sum(axis=2) <= media.MOST_BITS):
                p, q = a[k], b[m]
                angles = [np.rint(v[2] / media.TURN) % (1 << media.ANGLE) * media.TURN for v in (p, q)]
                by, c = angles[1] - angles[0], np.rint(np.array([p[:2], q[:2]]) * 8) / 8
                d = c[1] - media.STEP ** (q[3] - p[3]) * np.array([[np.cos(by), -np.sin(by)], [np.sin(by), np.cos(by)]]) @ c[0]
                for s in np.ndindex(2, 2, 2):
                    t, u, v = (np.floor(z + h / 2) - h / 2 + 0.5 for z, h in zip((by / (2 * np.pi / media.TURNS), *(d / media.WINDOW)), s, strict=True))
                    votes.setdefault((q[3] - p[3], t % media.TURNS, u, v), []).append((k, m))
            most = max((min(len({k for k, _ in v}), len({m for _, m in v})) for v in votes.values()), default=0)
            if most >= media.LEAST_CORNERS:
                out[i, j] = most
    return out


def test_whole_search_leaves_out_no_pair(spark, scenes, monkeypatch):
    """Noisy copies, whose descriptors differ in more bits than tables find."""
    rng = np.random.default_rng(2)
    noisy = [np.clip(np.rint(scenes[k][:70, :70] + rng.normal(0, s, (70, 70))), 0, 255) for k in range(4) for s in (0, 6, 10)]
    asked = [np.rint(noisy[k][5:, 5:] * 0.8 + 20) for k in range(0, 12, 3)]
    rows = [[(k, pgm(p)) for k, p in enumerate(pictures)] for pictures in (asked, noisy)]
    of = [{k: media.descriptors(media.gray(m)[None])[1:] for k, m in side} for side in rows]
    want = all_corners(*of)
    a, b = (spark.createDataFrame(side, "image long, media binary") for side in rows)
    # One block, and then blocks of an image or two on both sides.
    assert {(r.query, r.image): r.corners for r in media.find_copies(a, b, whole=True).collect()} == want
    monkeypatch.setattr(media, "ASKING_BLOCK", 40)
    monkeypatch.setattr(media, "BLOCK", 60)
    assert {(r.query, r.image): r.corners for r in media.find_copies(a, b, whole=True).collect()} == want
    by_tables = {(r.query, r.image): r.corners for r in media.find_copies(a, b).collect()}
    assert sum(by_tables.values()) < sum(want.values())
    assert media.find_copies(a, b.limit(0), whole=True).count() == 0 and media.find_copies(a.limit(0), b, whole=True).count() == 0


def test_image_query_gives_every_pair_there_is(spark, tmp_path):
    from terravane.llm import queries

    rng = np.random.default_rng(6)
    bases = rng.normal(size=(5, 64))
    vectors = {k: (bases[k % 5] + rng.normal(size=64) * (0.02 + 0.12 * (k % 4))).astype(np.float32) for k in [*range(40), 100, 200, 300]}
    spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    of = [{k: media.descriptors(media.gray(media.picture(v.tolist(), edited))[None])[1:] for k, v in vectors.items() if not edited or k % 100 == 0} for edited in (True, False)]
    want = all_corners(*of)
    out = queries.op1_image_copies(spark, str(tmp_path)).collect()
    assert {(m.query_id, r.vec_id): m.corners for r in out for m in r.matches or []} == want
    assert {r.vec_id: r.n_queries for r in out} == {k: sum(i == k for _, i in want) for k in vectors}


def corner_batch(asks, images):
    """A side of a comparison: the descriptors of pictures."""
    of = [media.descriptors(np.float32(p)[None])[1:] for p in images]
    numbers = np.ascontiguousarray(np.concatenate([b for _, b in of])).view(np.int64).reshape(-1, len(media.WORDS))
    columns = [np.repeat(np.arange(len(of)), [len(b) for _, b in of]), media.packed(np.concatenate([s for s, _ in of])), *numbers.T.copy()]
    return pa.RecordBatch.from_arrays([pa.array([asks] * len(numbers)), *[pa.array(c) for c in columns]], names=["asks", "image", "spot", *media.WORDS])


def test_votes_of_images_make_no_rows(spark, scenes):
    """Copies leave a comparison as one row a pair, however many matches they have, and windows of votes are no rows."""
    copies = [np.rint(scenes[0][:70, :70])] * 12
    block = [corner_batch(asks, copies) for asks in (True, False)]
    found = pa.Table.from_batches(media._compare(iter(block))).to_pylist()
    assert sorted((r["query"], r["image"]) for r in found) == [(i, j) for i in range(12) for j in range(12)]
    assert {(r["corners"], r["steps"]) for r in found} == {(block[0].num_rows / 12, 0)}
    voted, best = [], media._best
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(media, "STEP_VOTES", 10)
        patch.setattr(media, "_best", lambda *c: voted.append(len(c[0])) or best(*c))
        assert pa.Table.from_batches(media._compare(iter(block))).sort_by([("query", "ascending"), ("image", "ascending")]).to_pylist() == sorted(found, key=lambda r: (r["query"], r["image"]))
    assert len(voted) == 144
    met = spark.createDataFrame([(1, 2, 3, 4)], "query long, image long, asked long, spot long")
    assert "Generate" not in media.places(met)._jdf.queryExecution().toString()


def test_votes_are_counted_over_whole_pairs(scenes):
    """Matches of a pair that are cut into batches at any place."""
    spots = np.unique(media.packed(media.descriptors(np.rint(scenes[1][:70, :70])[None].astype(np.float32))[1]))
    rows = np.array([(q, i, s, s) for q, i, m in ((1, 1, len(spots)), (1, 2, 7), (2, 2, 5), (3, 1, 6), (3, 9, 9)) for s in spots[:m]]).T.copy()
    for size in (1, 4, 6, rows.shape[1]):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in rows], names=["query", "image", "asked", "spot"]) for k in range(0, rows.shape[1], size)]
        found = pa.Table.from_batches(media._places(iter(batches))).to_pylist()
        assert [(r["query"], r["image"], r["corners"]) for r in found] == [(1, 1, len(spots)), (1, 2, 7), (3, 1, 6), (3, 9, 9)]
    assert pa.Table.from_batches(media._places(iter([]))).num_rows == 0


def test_few_corners_wait_for_the_others(scenes):
    """Of the pairs of descriptors fewer than all are compared at once, and the copies are the same."""
    rng = np.random.default_rng(4)
    noisy = [np.clip(np.rint(scenes[k][:70, :70] + rng.normal(0, s, (70, 70))), 0, 255) for k in range(6) for s in (0, 8)]
    asked = [np.rint(noisy[k][4:, 7:] * 0.8 + 20) for k in range(0, 12, 2)] + [np.rint(media._shrink(70, 1.42) @ noisy[0] @ media._shrink(70, 1.42).T)]
    of = [{k: media.descriptors(np.float32(p)[None])[1:] for k, p in enumerate(side)} for side in (asked, noisy)]
    block = [corner_batch(True, asked), corner_batch(False, noisy)]
    compared, near = [], media._near
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(media, "_near", lambda x, y: compared.append(len(x[0]) * len(y[0])) or near(x, y))
        found = pa.Table.from_batches(media._compare(iter(block))).to_pylist()
    assert {(r["query"], r["image"]): r["corners"] for r in found} == all_corners(*of)
    assert 0 < sum(compared) < 0.9 * block[0].num_rows * block[1].num_rows


def test_comparison_takes_few_large_steps(scenes):
    """Steps are as large as what they hold allows, and smaller where much matches."""
    rng = np.random.default_rng(5)
    noisy = [np.clip(np.rint(scenes[k][:70, :70] + rng.normal(0, 4, (70, 70))), 0, 255) for k in range(12) for _ in range(3)]
    block = [corner_batch(True, [p[4:, 7:] for p in noisy]), corner_batch(False, noisy)]
    levels = len(np.unique(block[1].column("spot").to_numpy() >> 2 * media.PLACE + media.ANGLE))
    compared, near = [], media._near

    def counted(x, y):
        compared.append((len(x[0]), len(y[0])))
        return near(x, y)

    def rows():
        return pa.Table.from_batches(media._compare(iter(block))).sort_by([("query", "ascending"), ("image", "ascending")]).to_pylist()

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(media, "_near", counted)
        want = rows()
        assert len(want) >= 12 * 9 and len(compared) <= levels * (block[0].num_rows // 1024 + 1)
        compared.clear()
        patch.setattr(media, "STEP_MATCHES", 300)
        assert rows() == want
        assert all(a * b <= max(300, b) for a, b in compared)


def test_near_descriptors_in_steps_of_any_size(monkeypatch):
    rng = np.random.default_rng(7)
    words = rng.integers(0, 1 << 63, (4, 1)).astype(np.uint64)
    # Some bits of each word are turned over: distances around the limit.
    x, y = ([w ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (7, n)).astype(np.uint64)) for w in words] for n in (23, 101))
    far = sum(np.bitwise_count(u[:, None] ^ v).astype(int) for u, v in zip(x, y, strict=True))
    want = np.argwhere(far <= media.MOST_BITS).tolist()
    assert 0 < len(want) < far.size
    for pairs in (1, 101, 250, 1 << 16):
        monkeypatch.setattr(media, "STEP_PAIRS", pairs)
        assert np.stack(media._near(x, y), axis=1).tolist() == want


def test_descriptors_are_as_defined(scenes, monkeypatch):
    """Those of pictures described together are those of each, and each bit is a test of the smoothed patch."""
    pictures = np.stack([np.rint(s[:60, :52]) for s in scenes[:5]]).astype(np.float32)
    monkeypatch.setattr(media, "STEP_CORNERS", 7)
    owner, spots, bits = media.descriptors(pictures)
    for k, picture in enumerate(pictures):
        _, own, tests = media.descriptors(picture[None])
        assert np.array_equal(own, spots[owner == k]) and np.array_equal(tests, bits[owner == k])
    smooth = [sum(np.pad(p, 1, mode="edge")[dy : dy + 60, dx : dx + 52] for dy in range(3) for dx in range(3)) for p in pictures]
    for k, (x, y, angle, level), row in zip(owner, spots, bits, strict=True):
        if level == 0:
            turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            u, v = (np.rint(media._TESTS[:, i] @ turn.T).astype(int) for i in (0, 1))
            a, b = (smooth[k][int(y) + t[:, 1], int(x) + t[:, 0]] for t in (u, v))
            assert np.array_equal(np.unpackbits(row), a < b)


# Pieces.


def test_pieces_equal_the_library():
    machine = pieces.Transducer(open(MODEL, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    alphabet = list("ab \n\t  éèñ①😀ﬁ\x00eennttiioonnthe1299,.▁") + ["the ", "tion"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        ids = machine.encode(text)
        assert ids.tolist() == library.encode(text)
        assert machine.decode(ids) == text.replace("▁", " ")


def test_merging_looks_up_few_places_of_a_word():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    machine = pieces.Transducer(open(MODEL, "rb").read())
    machine.trie = Counted(machine.trie)
    words = ["▁internationalization", "▁the", "▁understanding", "▁information"]
    for word in words:
        assert [machine.text(v) for v in machine.merge_path(word)] == machine.merged(word)
    # A place where no symbol of the path starts is looked at only on a wrong way.
    assert Counted.asked <= sum(map(len, words)) / 2


def test_unigram_path_is_the_best():
    machine = pieces.Transducer(open(MODEL, "rb").read())
    machine.bpe = False
    rng = random.Random(3)
    for _ in range(200):
        word = "▁" + "".join(rng.choice("thenio①") for _ in range(rng.randint(1, 9)))
        best = {0: 0.0}
        for j in range(1, len(word) + 1):
            best[j] = max(best[i] + (machine.scores[machine.ids[word[i:j]]] if word[i:j] in machine.ids else -machine.penalty) for i in range(j) if word[i:j] in machine.ids or j - i == 1)
        path = machine.score_path(word)
        assert "".join(map(machine.text, path)) == word
        assert sum(machine.scores[v] if v < len(machine.texts) else -machine.penalty for v in path) == pytest.approx(best[len(word)])


def test_words_are_forgotten_not_lost(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_BYTES", 3 * 300)
    monkeypatch.setattr(pieces, "MEMORY_PAIRS", 5)
    machine = pieces.Transducer(open(MODEL, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = " ".join(f"word{i % 11} then" for i in range(60)) + " " + "longword" * 100
    assert machine.encode(text).tolist() == library.encode(text) and len(machine.words) <= 3
    assert not any(len(w) > pieces.LONG_WORD for w in machine.words)


def test_decoding_of_awkward_ids(spark):
    rows = [([1, 2], "a"), (None, "b"), ([], "c"), ([None, 10**6, -5], "d"), ([3 + 0xC3], "e"), ([3 + 0xC3, 3 + 0xA9], "f")]
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k int, ids array<int>, text string")
    machine = pieces.Transducer(open(MODEL, "rb").read())
    first = min(machine.bytes.values())
    df = df.withColumn("ids", F.transform("ids", lambda x: F.when((F.col("k") >= 4), x - 3 + first).otherwise(x)))
    out = pieces.decode(df, MODEL)
    assert out.columns == ["k", "ids", "text"]
    got = {r.k: r.text for r in out.collect()}
    assert got[1] is None and got[2] == "" and got[3].count("⁇") == 3 and got[4] == "\ufffd" and got[5] == "é"


def test_encode_and_decode_tables(docs, rows, none):
    out = pieces.encode(docs.withColumn("ids", F.lit(1)), MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter((r[0], tuple(library.encode(r[1] or ""))) for r in rows)
    got = out.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert Counter(r.text for r in pieces.decode(out.select("ids"), MODEL).collect()) == Counter(r[1] or "" for r in rows)
    assert pieces.encode(none, MODEL).count() == 0


# Languages.


def test_automaton_knows_all_substrings():
    text = "abcbcabcaab"
    moves = langid.suffix_automaton(text)

    def known(word):
        state = 0
        for c in word:
            state = moves[state].get(c)
            if state is None:
                return False
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(known(s) for s in subs) and not any(known(s + "c") for s in subs if s + "c" not in subs)


def brute_phrases(sample, text):
    """Longest matches in the sample, whole texts with what is no letter made one blank."""
    plain = lambda t: " " + re.sub("x+", " ", "".join(c if c.isalpha() else "x" for c in t.lower().replace("x", "q"))).strip() + " "
    known, text = " ".join(map(plain, sample)).replace("  ", " "), plain(text)
    count = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in known:
            j += 1
        i, count = max(j, i + 1), count + 1
    return len(text.replace(" ", "")), count


@pytest.mark.parametrize("piece", [4096, 64, 7])
def test_phrases_equal_brute_force(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "TOGETHER", 3000)
    rng = random.Random(piece)
    sample = {"one": [words(rng, 150), "ÉTÉ déjà, vu... 12 fois"], "two": ["".join(rng.choice("ab ½") for _ in range(900))], "few": ["z"]}
    sample = {k: [t.replace("x", "q") for t in v] for k, v in sample.items()}
    texts = [words(rng, rng.randint(0, 300)) for _ in range(30)] + ["".join(rng.choice("abo ½éΔ") for _ in range(rng.randint(0, 3000))) for _ in range(30)] + ["a" * 5000, None, "", "12", "½ ² ①", "b"]
    texts = [t and t.replace("x", "q") for t in texts]
    parser = langid.Parser(langid.Automata(sample))
    n, phrases = parser.counts(texts)
    for t, size, row in zip(texts, n, phrases, strict=True):
        want = [brute_phrases(sample[k], t or "") for k in sorted(sample)]
        assert size == want[0][0]
        if size:
            assert row.tolist() == [c for _, c in want]
    assert [parser.judge([t])[0][0] for t in texts[-5:-1]] == ["und"] * 4


def test_a_long_text_without_blanks_is_parsed_and_encoded(spark):
    long = "abcdefghij" * 100_000
    df = spark.createDataFrame([(1, long, "en"), (2, "some words", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"en"}
    assert all(r.round_trip for r in pieces.encode(df, MODEL).collect())
    assert {r.n_shingles for r in neardup.near_duplicates(df).collect()} == {1}


def test_language_of_awkward_rows(docs, rows, none):
    got = langid.identify(docs.withColumn("score", F.lit("old"))).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred, r.score) == (("en", 1.0) if letters else ("und", 0.0))
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_every_language_is_learned_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_WHOLE", 70 * 400)
    alphabet = "abcdefghijklmnopqrstuvwxyzäöüßéèàùçñáíóúøåæþðœčšžřůěłąęśźżćńőűğışđ"
    text = lambda k, n: " ".join(alphabet[k % 60 : k % 60 + 3] * 2 + alphabet[(7 * k) % 60] for _ in range(n))
    rows = [(f"l{k:02}", text(k, 30 + j)) for k in range(70) for j in range(3)] + [("l69", text(69, 2000))] + [("zz", "ж" * 20_000), ("zz", "ж" * 9000)]
    got = langid.samples(spark.createDataFrame(rows, "l string, t string"))
    assert len(got) == 71 and all(1 <= len(v) for v in got.values())
    # The shortest of a language's long rows; whole rows in a language's part of the bound.
    assert [len(t) for t in got["zz"]] == [9000]
    assert all(sum(map(len, v)) <= 70 * 400 // 71 or len(v) == 1 for v in got.values())


def test_alphabets_beyond_two_bytes():
    many = [chr(c) for c in range(0x3400, 0x2A6DF) if chr(c).isalpha()][:66_000]
    automata = langid.Automata({"many": ["".join(many)], "few": ["abc abd"]})
    assert len(automata.alphabet) > 1 << 16
    n, phrases = langid.Parser(automata).counts(["".join(many[-40:]), "abc", "".join(many[:2]) + many[-1]])
    assert n.tolist() == [40, 3, 3]
    at = automata.languages.index("many")
    assert phrases[0, at] <= 3 and phrases[1, automata.languages.index("few")] == 1 and phrases[2, at] <= 4


def test_language_of_held_out_documents(spark, sf):
    from terravane.llm.queries import op10_cross_parsing

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_cross_parsing(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_a_word_is_remembered_when_it_comes_again_and_within_the_bound(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_BYTES", 2000)
    made = []
    memory = pieces.Memory(lambda word: made.append(word) or word.encode())
    assert memory["one"] == b"one" and not memory
    assert memory["one"] == b"one" and list(memory) == ["one"]
    assert memory["one"] == b"one" and made == ["one", "one"]
    long = "x" * (pieces.LONG_WORD + 1)
    for word in [*(f"w{i}" for i in range(60)), long] * 3:
        assert memory[word] == word.encode() and memory.size <= 2000 and len(memory) < 10 and len(memory.old) < 10
    assert long not in memory and long not in memory.old
