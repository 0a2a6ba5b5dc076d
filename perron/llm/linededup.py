"""Op 9: drop lines that an earlier document holds, as run-length keep bitmaps. DataFrame functions only.

1. Each line becomes two 64-bit hashes of its key (128 bits: collisions stay out of reach at 10^12 lines), its document
   and its position. No text leaves the task that read it.
2. These rows are range-partitioned by hash and a salt of the document and sorted by document and position; a stream
   over each sorted run takes the first document of the run. The salt keeps a line that a third of all documents share
   from landing in one partition.
3. What is first within its salt (at most ``SALTS`` documents for each line) meets once more by hash; the first document
   of the line keeps its lines.
4. A document's dropped positions become runs, the compressed form of its bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least number of parts of a line's holders; a quarter of the shuffle partitions where that is more.
SALTS = 64


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else kept. ``lower`` does just that, and faster, to a text of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    text, salts = F.coalesce(F.col(text_column), F.lit("")), max(SALTS, shared.parallelism(docs.sparkSession) // 4)
    each = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(lower_ascii(text), "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    return each.select("doc_id", "text_hash", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    )


def dropped_runs(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_dropped, firsts, lasts) of each document that loses lines.

    firsts[i]..lasts[i] are the i-th run of dropped positions, counted from 0; documents without a row keep all lines.
    A null text is one empty line. Rows with the same id count as one document: lines that only they share stay, and
    their bitmaps are told apart by text_hash (xxhash64 of the text). A null id counts as smaller than any other.
    An empty table gives no rows. Other columns are not read.
    """
    rows = shared.written(line_hashes(docs, id_column, text_column, min_chars), "line-hashes")
    dealt = rows.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("local", ~F.first("doc_id").over(stream).eqNullSafe(F.col("doc_id")))
    by_line = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = local.where(~F.col("local")).withColumn("late", ~F.first("doc_id").over(by_line).eqNullSafe(F.col("doc_id")))
    keys = ["doc_id", "text_hash", "pos"]
    lost = local.where("local").select(keys).unionByName(heads.where("late").select(keys))
    at = F.array_sort(F.collect_set("pos"))
    found = lost.groupBy("doc_id", "text_hash").agg(at.alias("at"))
    n = F.size("at")
    firsts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    lasts = F.filter("at", lambda x, i: (i == n - 1) | (F.get("at", i + 1) != x + 1))
    return found.select("doc_id", "text_hash", n.alias("n_dropped"), firsts.alias("firsts"), lasts.alias("lasts"))


def keep_runs(firsts: Column, lasts: Column, n_lines: Column) -> Column:
    """The kept runs (from, count) between the dropped ones."""
    starts = F.concat(F.array(F.lit(0)), F.transform(lasts, lambda x: x + 1))
    stops = F.concat(firsts, F.array(n_lines))
    runs = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("from"), (b - a).alias("count")))
    return F.filter(runs, lambda r: r["count"] > 0)


def apply_runs(docs: DataFrame, runs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with its text column deduplicated, and n_lines, n_dropped and keep_runs added (names in the way go)."""
    own = docs.drop("n_lines", "n_dropped", "keep_runs")
    runs = runs.select(F.col("doc_id").alias("_run_id"), F.col("text_hash").alias("_run_hash"), F.col("n_dropped").alias("_n"), F.col("firsts").alias("_firsts"), F.col("lasts").alias("_lasts"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    both = own.withColumn("_hash", F.xxhash64(text)).join(runs.hint("shuffle_hash"), F.col(id_column).eqNullSafe(F.col("_run_id")) & (F.col("_hash") == F.col("_run_hash")), "left")
    lines = lines_of(F.col(text_column))
    kept = keep_runs(F.col("_firsts"), F.col("_lasts"), F.size(lines))
    joined = F.array_join(F.flatten(F.transform(kept, lambda r: F.slice(lines, r["from"] + 1, r["count"]))), "\n")
    lost = F.col("_firsts").isNotNull()
    out = both.select(
        *[F.col(c) for c in own.columns if c != text_column],
        F.when(lost, joined).otherwise(F.col(text_column)).alias(text_column),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(lost, kept).otherwise(F.array(F.struct(F.lit(0).alias("from"), F.size(lines).alias("count")))).alias("keep_runs"),
    )
    return out.select(*own.columns, "n_lines", "n_dropped", "keep_runs")


def dedup_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 10) -> DataFrame:
    """Documents without the lines (keys of ``min_chars`` code points or more) that a smaller id holds."""
    runs = dropped_runs(docs, id_column=id_column, text_column=text_column, min_chars=min_chars)
    return apply_runs(docs, runs, id_column=id_column, text_column=text_column)


SQL = r"""
WITH each AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM each
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.first_doc IS NOT NULL AND f.first_doc <> k.doc_id AS dropped FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
