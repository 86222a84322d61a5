"""A corpus pipeline in five stages, each of them one of the corpus operators.

A stage is a function of (spark, docs, sf_dir).  All but the last return the columns of
``documents`` and whatever other columns came with them: no name that an operator uses or makes
touches a column of the table, as the operators see it under other names.  ``n_chars`` follows the
text.  A very long text is one row's work in every stage, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import Hidden, drop_stages, shared_folder, write_stage
from terravane.llm.langid import identify
from terravane.llm.mixing import mixed_rows
from terravane.llm.neardup import near_duplicates
from terravane.llm.pieces import encode
from terravane.llm.repeats import remove_repeats

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def with_text(hidden: Hidden, df: DataFrame, text: Column) -> DataFrame:
    """The table's columns as they were called, with another text and its length."""
    made = {hidden("text"): text, **({hidden("n_chars"): F.length(text).cast("long")} if "n_chars" in hidden.names else {})}
    return hidden.restore(df.withColumns(made))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be found, as they have no letters or no text.

    Repeated rows are judged alike, and a column ``lang_pred`` of the table stays what it is.
    """
    hidden = Hidden(docs)
    judged = identify(hidden.df, hidden("text"), hidden("lang"))
    return hidden.restore(judged.filter("lang_pred <> 'und'"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id.

    Similar means a Jaccard similarity of 0.8 or more over shingles of five words.  Null doc_ids
    come last, and a hash of the text decides among equal ones.  Documents without words are no
    near-duplicates of any.  Of rows that are equal in doc_id and text one stays.
    """
    hidden = Hidden(docs)
    key, text = hidden("doc_id"), hidden("text")
    chosen = near_duplicates(hidden.df, text, key, words=5, percent=80).filter("chosen")
    return hidden.restore(chosen.withColumn("digest", F.md5(text)).dropDuplicates([key, "digest"]))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes text covered by 200-byte strings that occur elsewhere; documents of nothing else go.

    A null text becomes the empty one; rows that repeat a whole text of 200 bytes all lose it.
    """
    hidden = Hidden(docs)
    cleaned = remove_repeats(hidden.df, hidden("text"), keep=hidden.columns(), with_kept=True)
    return with_text(hidden, cleaned.filter("kept <> '' or n_removed = 0"), F.col("kept"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws blocks of words by source: weights 5, 2, 1 repeating, three passes over a source at most.

    Documents without words (null, empty or blank texts) are in no block and so not in the mix; a
    null source is a source of its own; repeated rows are drawn each for itself.
    """
    hidden = Hidden(docs)
    text = hidden("text")
    return with_text(hidden, mixed_rows(hidden.df, text, hidden("doc_id"), hidden("source")), F.col(text))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, with its doc_id, language and source.

    Null and empty texts have no ids; every row has one in the result, repeated ones too.  Other
    columns are not in it.
    """
    return encode(docs, MODEL_FILE, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("source mix", source_mix),
    ("SentencePiece tokens", tokens),
]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder but the last.

    A stage's table goes as soon as the next one is written; the last of them is read by the result.
    """
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_stage(docs, folder, f"stage-{k}")
            drop_stages(spark, folder, *[f"stage-{k - 1}"] * (k > 0))
    return docs
