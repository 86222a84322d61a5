"""The corpus queries over the driver tables."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terravane.llm import media, queries

COLUMNS = {
    "op2_ring_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_minhash_hamming": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_archive_members": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_collision_counting": ["vec_id", "n_links", "component_id", "kept"],
    "op8_phrase_parsing": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_piece_transducer": ["doc_id", "ids", "n_ids", "n_fallback", "round_trip"],
    "op10_cross_parsing": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_returns_every_row_once(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table, key = {"op5": ("pages", "page_id"), "op7": ("embeddings", "vec_id")}.get(name[:3], ("documents", "doc_id"))
    ids = sorted(r[0] for r in out.select(key).collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect())


def test_shards_differ_by_one_at_most(spark, sf):
    counts = [r["count"] for r in queries.op2_ring_sharding(spark, sf).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1


def test_every_edited_picture_finds_its_source(spark, sf):
    found = queries.op1_image_copies(spark, sf).cache()
    wanted = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 100 = 0").collect()}
    matches = {(m.query_id, r.group_id) for r in found.filter("matches is not null").collect() for m in r.matches}
    groups = {r.vec_id: r.group_id for r in found.collect()}
    assert sum((q, groups[q]) in matches for q in wanted) >= 0.9 * len(wanted)
    assert found.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert found.filter("(n_queries > 0) <> (query_id is not null)").isEmpty()


def test_groups_of_pictures_recall_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(3)
    bases = rng.normal(size=(12, 64))
    vectors = [(k, None) if k == 77 else (k, bases[k % 12] if k % 5 else bases[k % 12] + rng.normal(size=64) * 0.05 * (k % 3)) for k in range(0, 300)]
    vectors += [(None, bases[0]), (1000, bases[1]), (1100, bases[1])]
    df = spark.createDataFrame([(k, v if v is None else v.tolist()) for k, v in vectors], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op1_image_copies(spark, str(tmp_path)).cache()
    assert sorted(map(repr, (r.vec_id for r in out.collect()))) == sorted(repr(k) for k, _ in vectors)
    asked = media.pictures(df.filter("vec_id % 100 = 0"), "vec_id", "embedding", edited=True)
    want = {(r.query, r.image) for r in media.find_copies(asked, media.pictures(df, "vec_id", "embedding")).collect()}
    members: dict[int, list[int]] = {}
    classes: dict[int, list[int]] = {}
    for r in out.filter("vec_id is not null and group_id is not null").collect():
        members.setdefault(r.group_id, []).append(r.vec_id)
        if r.vec_id % 100 == 0:
            classes.setdefault(r.class_id, []).append(r.vec_id)
    same = {q: c for c in classes.values() for q in c}
    got = {(q, v) for r in out.filter("matches is not null").collect() for m in r.matches for q in same[m.query_id] for v in members[r.group_id]}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)
    assert {r.vec_id: r.n_queries for r in out.collect() if r.vec_id is not None} == {k: len({q for q, v in got if v == k}) for k, _ in vectors if k is not None}


def test_tool_calls_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    out = queries.op6_tool_calls(spark, sf)
    found = con.execute(queries.oracle_sql()["op6_tool_calls"])
    names = [c[0] for c in found.description]
    assert sorted(map(repr, out.select(*names).collect())) == sorted(map(repr, (spark_row(names, r) for r in found.fetchall())))


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(*names)(*values)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.filter("not round_trip or n_ids = 0").isEmpty() and out.count() > 0
    assert out.join(docs, "doc_id", "left_anti").isEmpty()


def test_stages_on_awkward_rows(spark, sf):
    rows = [(1, "a fine text of some words here", "en", "s", 30), (1, "a fine text of some words here", "en", "s", 30), (2, None, "en", None, 0), (3, "", "en", "s", 0), (4, "1234 5678", "en", "s", 9), (5, "x " * 400 + "end", None, "t", 803)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["language ID"](spark, docs, sf).collect()} == {1, 5}
    kept = stages["MinHash near-dedup"](spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5] and kept.columns == docs.columns
    cut = {r.doc_id: r.text for r in stages["suffix-array dedup"](spark, kept, sf).collect()}
    assert cut[1] == rows[0][1] and len(cut[5]) < 210
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0 and (out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0])


def test_stages_keep_columns_called_like_their_results(spark, sf):
    extra = ["_text", "kept", "n_removed", "lang_pred", "score", "chosen", "component_id", "size", "taken", "_c1", "digest"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.select(*[F.lit(f"{c} of ").alias(c) for c in extra[:3]], "*", *[F.lit(f"{c} of ").alias(c) for c in extra[3:]])
    docs = docs.withColumns({c: F.concat(c, "doc_id") for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in extra), name
        assert all(r.n_chars == len(r.text) for r in rows) or name in ("language ID", "MinHash near-dedup")
    assert "kept" not in corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns


def test_near_copies_leave_and_clean_documents_stay(spark, sf):
    from terravane.llm.queries import op3_minhash_hamming

    kept = op3_minhash_hamming(spark, sf)
    assert kept.filter("kept").count() == kept.select("component_id").distinct().count()
    assert kept.filter(F.col("component_id") > F.col("doc_id")).isEmpty()
