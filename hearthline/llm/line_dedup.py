"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.llm.frames import NO_ID, keep_shuffles_short, stored, table, text_key, texts
from hearthline.plans.catalog import query

#: Columns that the operator adds; columns of these names in the input are replaced.
OUT = ("n_lines", "n_dropped", "kept_text")
_WHITE = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    """The parts of a text between newlines; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its own columns and ``kept_text``, ``n_lines`` (before dropping), ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents stays only in
    the document with the largest id that holds it. Rows with one id count as one document; a missing id counts as the
    largest. A missing or empty text is one empty line, which is too short to go. Every repeat of a line within the
    document that keeps it stays. An empty table gives an empty table.
    """
    keep_shuffles_short(docs.sparkSession)
    t = texts(docs, id_col, text_col)
    # Line numbers and hashes only: no text is shuffled here.
    held = (t.select("id", text_key(F.col("text")).alias("key"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
            .select("id", "key", "pos", line_key(F.col("line")).alias("line"))
            .where(F.char_length("line") >= min_chars)
            .select("id", "key", "pos", F.unhex(F.md5("line")).alias("hash")))
    held = stored(held, "lines")
    frequent = (held.select("hash", "id").distinct().groupBy("hash").agg(F.count("*").alias("n"), F.max("id").alias("last"))
                .where(F.col("n") >= min_docs).select("hash", "last"))
    gone = (held.join(frequent, "hash").where(F.col("id") != F.col("last"))
            .groupBy("id", "key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
            .select(F.col("id").alias("_gid"), F.col("key").alias("_gkey"), F.col("gone").alias("_gone")))
    mine = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    joined = docs.join(gone, (mine == gone["_gid"]) & (text_key(text) == gone["_gkey"]), "left")
    all_lines, dropped = lines(text), F.coalesce(gone["_gone"], F.array().cast("array<int>"))
    # The kept lines are the runs between dropped positions.
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(F.size(all_lines))),
                      lambda a, b: F.slice(all_lines, a + 2, b - a - 1))
    kept = F.when(gone["_gone"].isNull(), text).otherwise(F.array_join(F.flatten(runs), "\n"))
    return joined.select(*(docs[c] for c in docs.columns if c not in OUT), F.size(all_lines).cast("long").alias("n_lines"),
                         F.size(dropped).cast("long").alias("n_dropped"), kept.alias("kept_text"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, x[i] AS line, translate(trim(x[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), f AS (
  SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), j AS (SELECT l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id <> f.last AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


@query("op5_line_dedup", SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
