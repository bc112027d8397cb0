"""Benchmark decontamination as a prefix-filtered set join.

A window (``size`` consecutive words of an item) is the set of its shingles, each with its offset. It can only occur in a document
that holds all of them, so containment 1 needs a prefix of one: its rarest shingle over the whole corpus. Those prefixes are
joined with the shingles of the documents; offset and length bound where the window would lie; the words there decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.llm.frames import NO_ID, keep_shuffles_short, stored, table, text_key, texts
from hearthline.llm.words import ALNUM, TO_ALNUM, Hasher, Words, chunks, shingles
from hearthline.plans.catalog import query

#: Bits of the filter that is sent to all tasks: half a megabyte whatever the benchmark's size. A fuller filter lets more
#: shingles through to the join; it never loses one.
FILTER_BITS = 1 << 22
SHINGLE = 3

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def windows_of(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, win, len, k): every window of every item as its words joined by a space; k is its shingle length."""
    w = items.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.lit(size), F.size("w")))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return (w.select("item", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))).alias("win"))
            .withColumn("k", F.least(F.lit(SHINGLE), F.col("len"))).distinct())


def _shingles_at(words: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, k), " ").alias("shingle")))


def _bits(g: np.ndarray) -> np.ndarray:
    return (g & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        for _, off, data in chunks(b.column("shingle")):
            w = Words(off, data, ALNUM)
            h, n = hasher(w), w.counts()
            out = [_bits(g[w.first[:-1][n == k]]) for k in np.unique(n[n > 0]).tolist() for g, _ in [shingles(h, w.first, k)]]
            yield pa.record_batch({"bit": pa.array(np.unique(np.concatenate(out or [np.empty(0, np.int64)])))})


def _scanner(bits: bytes, sizes: list[int], reach: int):
    """Passages of documents around every shingle that the filter lets through, ``reach`` words further at both ends."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, on = Hasher(), np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        for b in batches:
            for row, off, data in chunks(b.column("text")):
                w = Words(off, data, ALNUM)
                h, n = hasher(w), len(off) - 1
                passages: list = [[] for _ in range(n)]
                # Marks +1 where a passage begins and -1 where it ends; their running sum is above 0 inside passages.
                edge = np.zeros(len(h) + 1, np.int32)
                of = w.row()
                for k in sizes:
                    g, ok = shingles(h, w.first, k)
                    at = np.flatnonzero(on[_bits(g)] & ok)
                    np.add.at(edge, np.maximum(at - reach, w.first[of[at]]), 1)
                    np.add.at(edge, np.minimum(at + k + reach, w.first[of[at] + 1]), -1)
                # Passages of neighbouring rows must not join: cut at every row border.
                inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
                new_row = np.zeros(len(inside), bool)
                new_row[1:-1][w.first[:-1][w.first[:-1] < len(h)]] = True
                begins = np.flatnonzero(inside[1:] & (~inside[:-1] | new_row[1:]))
                ends = np.flatnonzero(inside[:-1] & (~inside[1:] | new_row[1:]))
                for s, e in zip(begins.tolist(), ends.tolist()):
                    r = int(of[s])
                    raw = data[w.start[s]:w.end[e - 1]].tobytes().translate(TO_ALNUM)
                    passages[r].append({"start": s - int(w.first[r]), "words": b" ".join(raw.split()).decode("utf-8", "replace")})
                part = b.slice(row, n)
                yield pa.record_batch({"id": part.column("id"), "key": part.column("key"), "n_words": pa.array(w.counts().astype(np.int64)),
                                       "passages": pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.string())])))})

    return scan


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, key (see text_key), n_words, n_hit (words inside any occurrence of a window), items (ids of the items with an
    occurring window, sorted) per row of ``docs``.

    An item of fewer than ``size`` words is one window; items without words have none. Equal rows give equal results; an item
    listed twice counts once, an item without id marks words but is not listed. Without documents or items there is nothing to hit.
    """
    spark = docs.sparkSession
    keep_shuffles_short(spark)
    windows = stored(windows_of(items, size, item_id_col, item_text_col), "windows")
    win = windows.select("win", "len", "k").distinct()
    parts = (win.withColumn("w", F.split("win", " ")).select("win", "len", "k", F.explode(_shingles_at(F.col("w"), F.col("k"))).alias("s"))
             .select("win", "len", "k", "s.at", "s.shingle"))
    sizes = sorted(r["k"] for r in win.select("k").distinct().collect())  # at most SHINGLE values
    bits = parts.select("shingle").distinct().mapInArrow(_filter_bits, "bit long").distinct()
    on = np.zeros(FILTER_BITS, bool)
    on[np.array([r["bit"] for r in bits.collect()], np.int64)] = True  # at most FILTER_BITS numbers
    seen = stored(
        texts(docs, id_col, text_col, key=text_key(docs[text_col]))
        .mapInArrow(_scanner(np.packbits(on, bitorder="little").tobytes(), sizes, size - 1),
                    "id long, key long, n_words long, passages array<struct<start:int,words:string>>")
        .withColumn("row", F.monotonically_increasing_id()), "passages")
    passages = seen.select("row", F.posexplode("passages").alias("no", "p")).select("row", "no", "p.start", F.split("p.words", " ").alias("words"))
    found = None
    for k in sizes:
        s = passages.where(F.size("words") >= k).select("row", "no", F.explode(_shingles_at(F.col("words"), F.lit(k))).alias("s")).select(
            "row", "no", "s.at", "s.shingle", F.lit(k).alias("k"))
        found = s if found is None else found.unionByName(s)
    empty = spark.createDataFrame([], "row long, n_hit long, items array<string>")
    if found is None:
        hits = empty
    else:
        # Rarity of the benchmark's shingles over all documents; a window with a shingle that occurs nowhere goes at once.
        rarity = found.groupBy("shingle", "k").agg(F.count("*").alias("freq"))
        prefix = (parts.join(rarity, ["shingle", "k"], "left").groupBy("win", "len", "k")
                  .agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "shingle", "at")).alias("rarest"))
                  .where(F.col("rarest.freq") > 0)
                  .select("win", "len", "k", F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("offset")))
        candidates = (found.join(prefix, ["shingle", "k"]).withColumn("begin", F.col("at") - F.col("offset")).where(F.col("begin") >= 0)
                      .select("row", "no", "begin", "len", "win"))
        verified = (candidates.join(passages, ["row", "no"]).where(F.col("begin") + F.col("len") <= F.size("words"))
                    .where(F.array_join(F.slice("words", F.col("begin") + 1, F.col("len")), " ") == F.col("win"))
                    .select("row", (F.col("start") + F.col("begin")).alias("b"), (F.col("start") + F.col("begin") + F.col("len")).alias("e"), "win"))
        verified = stored(verified, "hits")
        spans = verified.select("row", "b", "e").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("spans"))
        start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
        covered = F.aggregate("spans", start, lambda a, s: F.struct(
            F.greatest(a["to"], s["e"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(a["to"], s["b"]))).alias("n")))
        listed = (verified.select("row", "win").distinct().join(windows.where(F.col("item").isNotNull()).select("win", "item"), "win")
                  .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
        hits = spans.select("row", covered["n"].alias("n_hit")).join(listed, "row", "left")
    return seen.select("row", "id", "key", "n_words").join(hits, "row", "left").select(
        "id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op2_decontamination", SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
