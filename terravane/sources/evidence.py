"""Evidence about sources: manifests, sniffed downloads, literature records, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Literature records: keys of the inverted index may differ in case only, so it must be a map.
LITERATURE = "id STRING, doi STRING, title STRING, publication_year INT, abstract_inverted_index MAP<STRING,ARRAY<INT>>"
GRANULES = "feed STRUCT<entry: ARRAY<STRUCT<producer_granule_id: STRING, title: STRING, time_start: STRING, time_end: STRING, boxes: ARRAY<STRING>>>>"
_SIGNATURES = {"pdf": "%PDF-", "png": "\x89PNG", "nc": "CDF", "nc4": "\x89HDF"}


def read_literature(spark: SparkSession, path: str) -> DataFrame:
    """One record a file."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", LITERATURE).alias("r")).select("r.*")


def read_granules(spark: SparkSession, path: str) -> DataFrame:
    """The entries of search responses, one row each."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", GRANULES)["feed"]["entry"]).alias("e")).select("e.*")


def inverted(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, word, positions) of each text's words, parted by single spaces."""
    words = df.select(key, F.posexplode(F.split(text, " ")).alias("at", "word"))
    return words.groupBy(key, "word").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def rebuilt(index: DataFrame, key: str) -> DataFrame:
    """Texts from (key, word, positions): each word at its positions.  A text is a row, so one group is one text."""
    placed = index.select(key, "word", F.explode("positions").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "word")))
    return placed.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["word"]), " ").alias("text"))


def indexed(text: Column) -> Column:
    """The inverted index of a text as a map from its words, parted by single spaces, to their positions.

    Words are sorted with their positions, and runs of the same word cut out, all within the row; a
    null text has a null index.
    """
    words = F.split(text, " ", -1)
    placed = F.sort_array(F.transform(words, lambda w, k: F.struct(w.alias("word"), k.alias("at"))))

    def runs(s: Column) -> Column:
        n = F.size(s)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get(s, k)["word"] != F.get(s, k - 1)["word"]))

        def cut(b: Column) -> Column:
            ends = F.concat(F.slice(b, 2, F.size(b)), F.array(n))
            pairs = F.arrays_zip(b.alias("b"), ends.alias("e"))
            return F.transform(pairs, lambda p: F.struct(F.get(s, p["b"])["word"], F.transform(F.slice(s, p["b"] + 1, p["e"] - p["b"]), lambda x: x["at"])))

        # What a lambda binds is made once; an expression in its body would be made for every element.
        return F.get(F.transform(F.array(begins), cut), F.lit(0))

    return F.map_from_entries(F.get(F.transform(F.array(placed), runs), F.lit(0)))


def abstract(index: Column) -> Column:
    """The text of an inverted index held as a map."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda s: s["word"]), " ")


def hit_list(records: DataFrame) -> DataFrame:
    """Year (``NA`` if missing), DOI and title."""
    return records.select(F.coalesce(F.col("publication_year").cast("string"), F.lit("NA")).alias("year"), "doi", "title")


def is_html(head: Column) -> Column:
    """Whether a content's beginning is that of a web page."""
    start = F.lower(F.ltrim(head))
    return start.startswith("<!doctype") | start.startswith("<html")


def sniffed(files: DataFrame) -> DataFrame:
    """Adds ``extension`` and ``accepted``: the content begins as the extension promises.

    An error page saved under another name is rejected; unknown extensions are accepted unless
    they hold a page.
    """
    head = F.substring(F.col("content"), 1, 16)
    text = F.decode(head, "ISO-8859-1")
    known = F.create_map(*[F.lit(x) for pair in _SIGNATURES.items() for x in pair])
    out = files.withColumn("extension", F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1)))
    wanted = F.try_element_at(known, F.col("extension"))
    page = is_html(text) & ~F.col("extension").isin("html", "htm")
    return out.withColumn("accepted", ~page & F.coalesce(text.startswith(wanted), F.lit(True)))


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of files with their content."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verified(have: DataFrame, want: DataFrame, key: str = "path") -> DataFrame:
    """Full comparison of two manifests: equal, changed, missing or extra."""
    joined = have.withColumnRenamed("sha256", "have").join(want.withColumnRenamed("sha256", "want"), key, "full_outer")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") == F.col("want"), "equal").otherwise("changed")
    return joined.select(key, status.alias("status"))


def overlaps(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Whether start..end meets first..last; an open end (null or ``present``) reaches on."""
    return (start <= last) & (end.isNull() | (end >= first))
