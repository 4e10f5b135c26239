"""Corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

Every stage takes what its predecessor kept.  All but the last return the columns of
documents; n_chars follows the text where a stage changes it.  Each stage's contract
for nulls, empty texts, repeated rows and empty tables is its operator's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietframe.llm import op02_langid, op03_jaccard, op05_decontaminate, op09_packing, op10_lines
from quietframe.llm.common import fresh, materialize, prepare, read_table, salted_lookup, tokenizer_path

#: A text whose likeliest language has less than this calibrated probability goes.
LEAST_SCORE = 0.5


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, n_chars taken from the text."""
    return docs.select(*[F.when(docs["`text`"].isNull(), docs["`n_chars`"]).otherwise(F.char_length(docs["`text`"])).cast(like.schema[c].dataType).alias(c) if c == "n_chars" else docs[f"`{c}`"] for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no certain language go."""
    prepare(spark)
    model = op02_langid.train(docs)
    lang, score = (fresh(docs.columns, c) for c in ("_lang", "_score"))
    kept = op02_langid.predict(docs, model).where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id has go from the text."""
    bitmaps = materialize(op10_lines.keep_bitmaps(docs), "line-bitmaps")
    return _measured(op10_lines.apply_bitmaps(docs, bitmaps), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the text with the smallest doc_id stays (of several under that id
    the least by hash), once where it is repeated; texts without words or doc_id stay."""
    prepare(spark)
    found = op03_jaccard.jaccard_components(docs).where("component is not null").select("doc_id", "th", "component")
    found = materialize(found.groupBy("doc_id", "th", "component").count(), "near-duplicates")
    groups = found.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    gone = salted_lookup(found, ["component"], "doc_id", groups).where("first <> struct(doc_id, th)")
    doc, th, n = (fresh(docs.columns, c) for c in ("_gone", "_gone_th", "_nth"))
    text_hash = F.xxhash64(F.coalesce(docs["`text`"], F.lit("")))

    def marked(rows: DataFrame) -> DataFrame:
        return materialize(rows.select(F.col("doc_id").alias(doc), F.col("th").alias(th)), "marked")

    def having(kept: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        return kept.join(rows, (kept["`doc_id`"] == rows[doc]) & (text_hash == rows[th]), how)

    kept = having(docs, marked(gone), "left_anti")
    again = marked(found.where("count > 1"))
    if again.isEmpty():
        return kept
    one = Window.partitionBy(docs["`doc_id`"], text_hash).orderBy(F.lit(0))
    once = having(kept, again, "left_semi").withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n)
    return having(kept, again, "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; fewer hits are cut from the text."""
    return _measured(op05_decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of the documents that are left."""
    prepare(spark)
    return op09_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("packing", packing),
]
#: SQL can't express a trained model or a tokeniser; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
