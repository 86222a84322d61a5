"""Resampling, spelling variants and nearest vectors against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import graphsearch, queries, resampling, spelling

DOCS = "doc_id long, text string, rank string, _word int, n int, word string, component_id int"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows():
    """Nulls, blanks, repeated rows, a key of two texts, a long text, letters beyond ASCII in both cases."""
    rng = random.Random(7)
    pool = ["Alpha", "beta", "GAMMA", "Été", "ÉTÉ", "x1", "delta9", "naïve", "日本", "eta"]
    text = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ",", "!"]) for _ in range(n))
    out = [(i, text(rng.choice([3, 19, 20, 21, 60]))) for i in range(40)]
    out += [(40, None), (41, ""), (42, " \t!? "), (43, text(3000)), (5, text(30)), out[7], out[7], (None, text(25)), (None, text(25)), (None, None)]
    return [(k, t, "clash", 1, 2, "clash", 3) for k, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


# Resampling.


def features(text, first, last):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(first, last + 1) for i in range(len(w) - n + 1)]


def resampled(rows, target, first, last, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, first, last)[1]) for texts in ([r[1] for r in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for key, text, *_ in rows:
        w, f = features(text, first, last)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(f), weight, score, len(w)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r.append(k + 1)
    return Counter(tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in out)


@pytest.mark.parametrize(("orders", "buckets"), [((1, 1), 10_000), ((1, 3), 50), ((2, 2), 10_000)])
def test_resampling_equals_brute_force(spark, docs, rows, orders, buckets):
    target = ["alpha beta gamma", None, "été 日本 ALPHA", ""]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, _bucket int")
    got = resampling.resample(docs, aim, orders=orders, buckets=buckets, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == resampled(rows, target, *orders, buckets, 20, 30)


def test_resampling_of_empty_tables(spark, docs, rows):
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    got = resampling.resample(docs, none, percent=100)
    assert Counter(map(tuple, got.collect())) == resampled(rows, [], 1, 1, 10_000, 20, 100)


@pytest.mark.parametrize("name", ["op11_position_ngrams", "op12_gram_index"])
def test_query_equals_sql(spark, sf, name):
    import duckdb

    engine = duckdb.connect()
    for t in ("documents", "benchmark"):
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = engine.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


# Spelling variants.


def near(a, b):
    """Exactly one edit apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def wordlist(rng, alphabet, lengths, n):
    out = {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(n)}
    for w in sorted(out):
        i = rng.randrange(len(w))
        out |= {w[:i] + rng.choice(alphabet) + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + w[i + 1 :]}
    return sorted(w for w in out if len(w) >= min(lengths))


@pytest.mark.parametrize(("least", "alphabet", "block"), [(7, "ab", 4096), (7, "aé", 5), (4, "abc", 7), (5, "abcdefgh", 3), (9, "ab", 2)])
def test_near_words_equal_brute_force(spark, tmp_path, monkeypatch, least, alphabet, block):
    """Few letters, so that grams repeat within words and lists are long; small blocks, so that lists are split."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(least * block)
    words = [*wordlist(rng, alphabet, range(least, least + 4), 60), "z" * 300, "z" * 301]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = spelling.near_words(df, least, f"file://{tmp_path}")
    n = {w: i for i, w in enumerate(words)}
    want = Counter((a, b, n[b]) for a in words for b in words if near(a, b))
    assert want and Counter(map(tuple, got.collect())) == want


def test_large_and_small_groups_alike(monkeypatch):
    rng = random.Random(3)
    words = [w for w in wordlist(rng, "abc", [7], 150) if len(w) in (7, 8)]
    a, b = (np.array([[ord(c) for c in w] for w in words if len(w) == n], dtype=np.uint32) for n in (7, 8))
    for x, y in ((a, a), (a, b)):
        groups = np.array([[0, len(x), 0, len(y)]])
        found = []
        for tile in (10**9, 50):
            monkeypatch.setattr(spelling, "TILE", tile)
            i, j = spelling.close(spelling.Lettered(x, 3), spelling.Lettered(y, 3), groups, 3)
            found.append(Counter(zip(i.tolist(), j.tolist(), strict=True)))
        text = lambda m: ["".join(map(chr, r)) for r in m]
        assert found[0] == found[1] == Counter((i, j) for i, v in enumerate(text(x)) for j, w in enumerate(text(y)) if near(v, w))


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["Separate", "definitély", "occurred", "RECEIVE", "beginning"]
    texts = []
    for w in base:
        texts += [w] * 300
        for m in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:3] + "q" + w[3:], w[:2] + "×" + w[2:]}:
            texts += [m] * rng.choice([1, 2, 25, 31])
            texts += [m[:4] + "z" + m[4:]] * 2
    rng.shuffle(texts)
    rows = [(k, ", ".join(texts[i : i + 50]), "c", 1, 2, "w", 3) for k, i in enumerate(range(0, len(texts), 50))]
    rows += [(900, None, "c", 1, 2, "w", 3), (None, "Separate 123", "c", 1, 2, "w", 3), (901, "", "c", 1, 2, "w", 3), rows[0], (902, "y" * 5000 + " " + "y" * 5000 + " " + "y" * 5001, "c", 1, 2, "w", 3)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)

    def mangled(key, run):
        h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
        return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run

    for written in (None, spelling.mistyped):
        n = Counter()
        for key, text, *_ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = run.translate(LOWER)
                n[mangled(key, run) if written else run] += 1
        n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
        beside = {w: [v for v in n if near(v, w)] for w in n}
        form = {}
        for w, c in n.items():
            best = min(beside[w], key=lambda v: (-n[v], v), default=None)
            form[w] = best if best is not None and n[best] >= 10 * c else None

        def root(w):
            return root(form[w]) if form[w] else w

        want = Counter((w, form[w], root(w), c, len(beside[w]), n[form[w]] if form[w] else None) for w, c in n.items())
        got = spelling.variants(docs, written=written)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert Counter(map(tuple, got.collect())) == want and any(root(w) != form[w] for w in n if form[w])
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.filter("text is null or text = ''")).count() == 0


def test_long_chains_are_followed(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(8)] + [("a", "w3")]
    got = dict(spelling.followed(spark.createDataFrame(chain, "word string, form string"), 3).collect())
    assert set(got.values()) == {"w8"} and len(got) == 9


# Nearest vectors.


def brute_nearest(rows, every, k):
    """For each query (key, vector): the exact scores of all candidates, best first."""
    good = []
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((key, tuple(v)))
    good = sorted(set(good))
    out = {}
    for key, v in good:
        if key % every == 0:
            one = lambda u: np.array(u) / np.abs(u).max()
            found = [(float(one(v) @ one(w) / math.sqrt((one(v) @ one(v)) * (one(w) @ one(w)))), other) for other, w in good if other != key and len(w) == len(v)]
            out[key, v] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
    return out


def test_nearest_of_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(60, rows[0][1]), (61, rows[0][1]), (62, rows[0][1]), (100, rows[0][1]), (63, (2 * np.array(rows[0][1])).tolist())]
    rows += [(150, None), (151, []), (200, [0.0] * 6), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, rows[1][1])]
    rows += [(250, [1.0, 0.0]), (251, [1.0, 1.0]), (300, [3.0, 4.0, 5.0]), rows[3], rows[50], (50, rows[9][1]), (350, [1e-200] * 6), (351, [1e200] * 6)]
    schema = "vec_id long, embedding array<double>, score string, rank string, dim string"
    df = spark.createDataFrame([(k, v, "c", "c", "c") for k, v in rows], schema).repartition(3)
    got = defaultdict(list)
    for r in graphsearch.nearest(df).orderBy("query_id", "query", "rank").collect():
        got[r.query_id, r["query"]].append((r.score, r.vec_id, r["rank"]))
    want = defaultdict(list)
    for (key, _), found in sorted(brute_nearest(rows, 50, 5).items()):
        want[key].append(found)
    assert {k for k, _ in got} == {0, 50, 100, 250, 350} and len(want[50]) == 2 and (50, 2) not in got
    for key, lists in want.items():
        own = [got[key, q] for q in range(len(lists))]
        assert all([r for _, _, r in o] == list(range(1, len(o) + 1)) for o in own)
        # Two vectors of one key: in either order.
        rounded = lambda f: sorted(tuple(round(x[0], 9) for x in o) for o in f)
        assert rounded(own) == rounded(lists)
    assert [v for _, v, _ in got[250, 0]] == [251]
    # Equal vectors: nearest in the order of their keys, and the multiple of them with the same cosine.
    assert {v for _, v, _ in got[0, 0]} == {60, 61, 62, 63, 100} and {v for _, v, _ in got[100, 0]} == {0, 60, 61, 62, 63}
    assert got[350, 0][0][0] == pytest.approx(1.0) and got[350, 0][0][1] == 351
    assert graphsearch.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["spread", "crowded"])
def test_recall_against_brute_force(spark, monkeypatch, kind):
    """Several shards and blocks; crowds of near and of equal vectors."""
    monkeypatch.setattr(graphsearch, "SHARD", 700)
    monkeypatch.setattr(graphsearch, "QUERIES", 20)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 32))
    if kind == "crowded":
        x[:600] = x[0] + 0.05 * rng.standard_normal((600, 32))
        x[600:900] = x[600]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graphsearch.nearest(df).collect()
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    hits = [score[r.query_id, r.vec_id] >= np.sort(score[r.query_id])[-5] - 1e-12 for r in got]
    assert len(got) == 5 * 40 and np.mean(hits) >= 0.95
    assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 for r in got)
    if kind == "crowded":
        equal = {r["rank"]: r.vec_id for r in got if r.query_id == 700}
        assert equal == {k + 1: 600 + k for k in range(5)}


def test_graph_reaches_every_node():
    rng = np.random.default_rng(2)
    points = graphsearch.units(np.concatenate([rng.standard_normal((300, 8)), 5 + 0.01 * rng.standard_normal((300, 8)), rng.standard_normal((1, 8))]))
    edges, entries = graphsearch.build_graph(points)
    reached, front = set(entries.tolist()), list(entries)
    while front:
        front = [int(v) for u in front for v in edges[u] if v >= 0 and int(v) not in reached and not reached.add(int(v))]
    assert len(reached) == len(points)
    assert len(graphsearch.build_graph(points[:1])[1]) == 1


def test_pruned_edges_are_no_longer_than_they_need_to_be():
    points = graphsearch.units(np.array([[1, 0], [1, 0.1], [1, 0.2], [1, -0.1], [0, 1]], dtype=float))
    got = graphsearch.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 0, 1, -1]]), alpha=1.0)
    # 2 and 4 lie behind 1.
    assert sorted(got[0][got[0] >= 0].tolist()) == [1, 3]
