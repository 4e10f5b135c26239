"""Line dedup with DataFrame functions only.

Keys of lines are hashed to 128 bits; (hash, salt) is range-partitioned with a
secondary sort by document and position, so a window streams over each run and
sees its first occurrence.  The salt spreads a hot line over SALTS ranges; the
first occurrences of its ranges are then merged.  What comes back for each
document is a compressed keep bitmap, not text: 64-bit words of one bit a line,
where words that keep every line are left out.

Contract for odd rows: null or empty text is one empty line; a row with a null
doc_id keeps all its lines and makes no line of others a copy; rows that share a
doc_id count as one document; extra columns stay; an empty table gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, default_partitions, fresh, materialize, pick, read_table

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points that a key has at least to be dropped as a copy.
LEAST = 10


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased; ASCII lines take the fast path."""
    s = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """For each document that loses lines: doc_id, th (hash of its text), keep (array
    of struct(word int, bits long), a bit for each line, without the words that
    keep all), n_dropped."""
    n = default_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    rows = rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), "doc_id", "th", "pos")
    rows = materialize(rows, "line-hashes")  # sampled for ranges and read twice
    ranged = rows.repartitionByRange(n, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    seen = ranged.withColumn("first", F.first("doc_id").over(run)).withColumn("nth", F.row_number().over(run))
    # A run's first rows, merged over salts: at most SALTS a key, and few keys have more than one document.
    heads = seen.where("nth = 1").groupBy("h1", "h2").agg(F.min("first").alias("least"), F.collect_set("salt").alias("salts"))
    heads = heads.where(F.size("salts") > 1).select("h1", "h2", "least", F.explode("salts").alias("salt"))
    lost = seen.join(heads, ["h1", "h2", "salt"], "left").where(F.col("doc_id") > F.coalesce("least", "first"))
    word = F.floor(F.col("pos") / 64).cast("int")
    words = lost.groupBy("doc_id", "th", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))).alias("lost"))
    return words.groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep"),
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
    )


def dense(keep: Column) -> Column:
    """All words up to the last that drops a line, in one pass over the sparse ones."""
    gap = lambda x, i: x["word"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"]) - 1
    return F.flatten(F.transform(keep, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(x, i)), F.array(x["bits"]))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with the kept lines as text, and the columns _n_lines and _n_dropped
    (fresh(): underscores before them where `docs` has such columns).

    Bitmaps grow with the documents, so they always meet texts in a merge join: one
    exchange of the texts whatever their number, that spills and that AQE splits."""
    key, th, words, lost = (fresh(docs.columns, c) for c in ("_bitmap_of", "_bitmap_th", "_bitmap_words", "_bitmap_lost"))
    b = bitmaps.select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("keep").alias(words), F.col("n_dropped").alias(lost))
    text = F.coalesce(docs["`text`"], F.lit(""))
    both = docs.join(b.hint("merge"), (docs["`doc_id`"] == F.col(key)) & (F.xxhash64(text) == F.col(th)), "left")
    both = both.withColumn(words, dense(F.col(words)))
    bit = lambda i: F.coalesce(F.get(F.col(words), F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    kept = F.filter(lines_of(F.col("`text`")), lambda _, i: F.call_function("shiftright", bit(i), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    new = F.when(F.col(words).isNull(), F.col("`text`")).otherwise(F.array_join(kept, "\n"))
    return both.select(
        *[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        (F.octet_length(F.coalesce(F.col("`text`"), F.lit(""))) - F.octet_length(F.replace(F.coalesce(F.col("`text`"), F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long").alias(fresh(docs.columns, "_n_lines")),
        F.coalesce(F.col(lost), F.lit(0).cast("long")).alias(fresh(docs.columns, "_n_dropped")),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    done = apply_bitmaps(docs, materialize(keep_bitmaps(docs), "line-bitmaps"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS least FROM keyed WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, coalesce(k.doc_id > f.least, false) AS lost FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(lost::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE = {"op10_line_dedup": SQL}
