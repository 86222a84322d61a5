"""The corpus operators as named queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import literal_table, shared_folder, write_stage
from terravane.llm.embeddups import near_duplicate_vectors
from terravane.llm.graphsearch import nearest
from terravane.llm.langid import identify
from terravane.llm.media import compared, describe, pictures
from terravane.llm.mixing import taken_words
from terravane.llm.neardup import near_duplicates
from terravane.llm.pieces import encode
from terravane.llm.repeats import remove_repeats
from terravane.llm.resampling import RESAMPLED_SQL, resample
from terravane.llm.sharding import shard_ring
from terravane.llm.spelling import VARIANTS_SQL, mistyped, variants
from terravane.llm.toolcalls import CONVERSATIONS_SQL, REPLY, SCHEMA, conversation_calls, link_calls
from terravane.llm.warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every picture all edited crops of every hundredth picture that are copies of it.

    The tables hold no images, so every embedding is drawn as one.  Equal embeddings give equal
    pictures, of which the one with the least vec_id (``class_id``, and ``group_id`` alike) is
    described and compared with all queries.  ``n_queries`` counts the queries found, ``query_id``
    and the rest name the best.  ``matches`` lists all, with their geometry, in the row of the
    picture that stands for its class, and nowhere else, so copies are not listed once more; equal
    queries are one, with their number.
    """
    folder = shared_folder(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    keyed = vectors.filter("vec_id is not null and embedding is not null")
    images = keyed.groupBy("embedding").agg(F.min("vec_id").alias("class_id"))
    asked = keyed.filter("vec_id % 100 = 0").groupBy("embedding").agg(F.min("vec_id").alias("query_id"), F.count("*").alias("n_queries"))
    described = write_stage(describe(pictures(images, "class_id", "embedding")), folder, "described")
    asking = write_stage(describe(pictures(asked, "query_id", "embedding", edited=True)), folder, "asking")
    found = compared(asking, described, folder)
    named = found.join(asked.select(F.col("query_id").alias("query"), "n_queries"), "query").withColumnRenamed("query", "query_id")
    match = F.struct("query_id", "n_queries", "corners", "turn", "steps", "dx", "dy")
    best = F.max(F.struct("corners", -F.col("query_id"), "query_id", "turn", "steps", "dx", "dy")).alias("b")
    found = named.groupBy(F.col("image").alias("group_id")).agg(F.sum("n_queries").alias("n_queries"), best, F.array_sort(F.collect_list(match)).alias("matches"))
    classes = images.withColumn("group_id", F.col("class_id"))
    out = keyed.join(classes, "embedding").drop("embedding").join(found, "group_id", "left")
    out = out.unionByName(vectors.filter("vec_id is null or embedding is null").drop("embedding"), allowMissingColumns=True)
    of_best = [F.col(f"b.{c}").alias(c) for c in ("query_id", "corners", "turn", "steps", "dx", "dy")]
    return out.select("vec_id", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), *of_best, "class_id", "group_id", F.when(F.col("vec_id") == F.col("group_id"), F.col("matches")).alias("matches"))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a ring of 8 shards whose row counts differ by one at most.

    A null text has size 1 and no checksum.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    sharded = shard_ring(docs, "doc_id", shards=8, spread=["text_crc32", "size"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard", "hops")


def op3_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles at a similarity of 0.8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source with weights 5, 2, 1 and at most three passes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken_words(docs).select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_shard")


def op5_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after writing, normalising and reading back the archives."""
    records, _ = archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a call or a result, linked, ordered and serialised."""
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    linked = link_calls(calls, results, literal_table(spark, SCHEMA, REPLY))
    return linked.withColumn("errors", F.concat_ws(";", "errors"))


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within each label at a cosine of 0.93."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_phrase_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 200-byte strings found elsewhere cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=200, keep=["doc_id"])


def op9_piece_transducer(spark: SparkSession, sf_dir: str, model_file: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """The piece ids of every whole document, and whether decoding them gives it back."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_file)


def op10_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned outside the held-out quarter.

    A null doc_id counts as an empty text here, and so is learned from.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    docs = docs.withColumn("held_out", fold == 2)
    return identify(docs, learn=~F.col("held_out"), keep=["doc_id", "held_out"])


def op11_position_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark's words, a tenth of them drawn."""
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op12_gram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, some of them mistyped, with their near words and forms."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"), written=mistyped)


def op13_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector, among all."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_image_copies": op1_image_copies,
        "op2_ring_sharding": op2_ring_sharding,
        "op3_minhash_hamming": op3_minhash_hamming,
        "op4_source_mix": op4_source_mix,
        "op5_archive_members": op5_archive_members,
        "op6_tool_calls": op6_tool_calls,
        "op7_collision_counting": op7_collision_counting,
        "op8_phrase_parsing": op8_phrase_parsing,
        "op9_piece_transducer": op9_piece_transducer,
        "op10_cross_parsing": op10_cross_parsing,
        "op11_position_ngrams": op11_position_ngrams,
        "op12_gram_index": op12_gram_index,
        "op13_pruned_graph": op13_pruned_graph,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_tool_calls": CONVERSATIONS_SQL, "op11_position_ngrams": RESAMPLED_SQL, "op12_gram_index": VARIANTS_SQL}
