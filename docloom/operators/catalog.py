"""The document catalogue: latest deliveries, merges, cascading deletes, children of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def delivered(documents: DataFrame) -> Column:
    return F.struct(F.coalesce("created_at", F.lit(EPOCH).cast(dict(documents.dtypes)["created_at"])), "source_path", "doc_type", "domain_category")


def merged_documents(documents: DataFrame) -> DataFrame:
    """One row a document: path and extension of the first delivery, all else of the last."""
    at = delivered(documents)
    first = F.min_by(F.struct("source_path", "original_ext"), at)
    last = F.max_by(F.struct("doc_type", "domain_category", "minio_bucket", "minio_key", "created_at"), at)
    g = documents.groupBy("document_id").agg(first.alias("f"), last.alias("l"))
    return g.select("document_id", "f.source_path", "f.original_ext", "l.doc_type", "l.domain_category", "l.minio_bucket", "l.minio_key", "l.created_at")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order; per-task limits are applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def section_texts(blocks: DataFrame) -> DataFrame:
    """(section_id, text): stripped blocks that are not blank, in order, with blank lines between."""
    kept = blocks.filter("block_type = 'text' and trim(content) <> '' and section_id is not null")
    parts = F.array_sort(F.collect_list(F.struct("seq", "id", F.trim("content").alias("c"))))
    return kept.groupBy("section_id").agg(F.array_join(F.transform(parts, lambda p: p["c"]), "\n\n").alias("text"))


def page_ranges(blocks: DataFrame) -> DataFrame:
    return blocks.filter("section_id is not null").groupBy("section_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def with_summaries(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """``documents`` with the late (document_id, summary, keywords) of ``updates``; null where none came. A second update of a document replaces the first by its ``at``."""
    late = updates.groupBy("document_id").agg(F.max_by(F.struct("summary", "keywords"), "at").alias("u"))
    return documents.drop("summary", "keywords").join(late, "document_id", "left").select("*", F.col("u.summary").alias("summary"), F.col("u.keywords").alias("keywords")).drop("u")


def digests(propositions: DataFrame, sentences: int = 3, most: int = 30) -> DataFrame:
    """(document_id, summary, keywords): the first propositions in order, and the most frequent keywords, of equal ones the first.

    ``propositions`` has (document_id, id, seq, proposition, keywords), distinct.
    """
    lead = top_by(propositions.filter("proposition is not null"), ["document_id"], sentences, "seq", "id")
    items = F.array_sort(F.collect_list(F.struct("rank", "proposition")))  # the first few
    summary = lead.groupBy("document_id").agg(F.array_join(F.transform(items, lambda i: i["proposition"]), " ").alias("summary"))
    words = propositions.select("document_id", "id", "seq", F.posexplode("keywords").alias("pos", "keyword")).filter("keyword is not null")
    n = words.groupBy("document_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "id", "pos")).alias("first"))
    top = top_by(n, ["document_id"], most, F.desc("n"), "first", "keyword")
    ranked = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    keywords = top.groupBy("document_id").agg(F.transform(ranked, lambda i: i["keyword"]).alias("keywords"))
    return summary.join(keywords, "document_id", "full")


def exported(files: DataFrame, folder: str) -> None:
    """Text files by name: a folder for each ``file_name`` holds one part with its ``body``."""
    files.select("file_name", "body").repartition("file_name").write.partitionBy("file_name").text(folder)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key. Of several new rows under a key all stay; null keys of ``new`` are added."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
