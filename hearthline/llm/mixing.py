"""Mixing sources to target weights: whole repeats, then a subset of documents whose sizes fill the remaining budget.

The subset is found on counts of documents by exact size, not on documents: a seeded share of every size first, then
bounded-knapsack dynamic programming for what is left. Which documents of a size are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthline.llm.frames import NO_ID, keep_shuffles_short, stored, table, text_key
from hearthline.plans.catalog import query

#: The dynamic programme fits at most this many words; whatever exceeds it is taken in whole documents before.
DP_WORDS = 1 << 15
#: Documents of one size and source that are ranked in one piece.
RANKED = 1 << 12


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``sizes`` (src, source, size; one row per source) with ``weight`` and ``target``.

    Sources in code point order, null last, get the weights in turn. The targets share the sum of all sizes by weight;
    none exceeds ``most`` times its source's size, and what the others gain from that is again shared by weight. That has
    a closed form: with sources ordered by most * size / weight, those whose bound is below the common level are at their
    bound. The windows run over sources, of which there are few, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", given.cast("double")).withColumn("bound", most * F.col("size"))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    s = (s.withColumn("all_words", F.sum("size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
         .withColumn("bound_before", F.sum("bound").over(up) - F.col("bound"))
         .withColumn("weight_before", F.sum("weight").over(up) - F.col("weight")))
    # The level if this source and all later ones are below their bounds.
    s = s.withColumn("level", (F.col("all_words") - F.col("bound_before")) / (F.col("all_weight") - F.col("weight_before")))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("bound"))
    level = F.max(F.when(F.col("free"), F.struct(-F.col("bound") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return s.withColumn("target", F.when(F.col("free"), level * F.col("weight")).otherwise(F.col("bound"))).select(
        "src", "source", "size", "weight", "target")


def fit(length: np.ndarray, count: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as they can, not above.

    Every length first gives its share of the budget, rounded down; while more than DP_WORDS are missing, the longest
    documents that still fit are added; the rest is a bounded knapsack over the remaining counts.
    """
    take = np.zeros(len(length), np.int64)
    total = int((length * count).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return count.copy()
    # Leave a part of the budget to the knapsack, so that lengths of any kind can help to fill it.
    plan = max(0, budget - DP_WORDS // 2)
    take = np.array([int(c) * plan // total for c in count.tolist()], np.int64)
    rest = budget - int((length * take).sum())
    order = np.argsort(-length, kind="stable")
    for i in order:
        if rest <= DP_WORDS:
            break
        if length[i] > 0:
            more = min(int(count[i] - take[i]), (rest - DP_WORDS // 2) // int(length[i]))
            if more > 0:
                take[i] += more
                rest -= more * int(length[i])
    # Reachable sums as bits of one integer; each step is a bundle of 1, 2, 4, ... documents of one length.
    cap, mask = min(rest, DP_WORDS), (1 << (min(rest, DP_WORDS) + 1)) - 1
    rng = np.random.default_rng(seed)
    reach, steps = 1, []
    for i in rng.permutation(len(length)):
        size, left, bundle = int(length[i]), int(count[i] - take[i]), 1
        if size == 0 or size > cap:
            continue
        left = min(left, cap // size)
        while left > 0 and not reach >> cap & 1:
            b = min(bundle, left)
            steps.append((i, b, reach))
            reach |= reach << (size * b) & mask
            left, bundle = left - b, bundle * 2
        if reach >> cap & 1:
            break
    at = reach.bit_length() - 1
    for i, b, before in reversed(steps):
        if not before >> at & 1:
            take[i] += b
            at -= int(length[i]) * b
    return take


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, key (see text_key), size, source_size, target, taken (words that the mix takes, repeats counted) per row of ``docs``.

    A source takes all its documents as often as the target holds its size, then a subset for the rest. Documents
    without words take 0. A missing source is a source of its own, last in order. The choice depends on ids, texts and
    the seed only, so reruns agree; rows equal in all three are interchangeable. An empty table gives an empty table.
    """
    keep_shuffles_short(docs.sparkSession)
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    sized = stored(
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_key(F.col(text_col)).alias("key"),
                    F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
        .withColumn("src", src)
        .withColumn("lot", F.xxhash64(F.lit(seed), "id", "key")), "sized")
    # Counts per (source, size, lot range): the lot ranges are fine enough that one of them can be ranked in one task.
    hist = stored(sized.groupBy("src", "size").agg(F.count("*").alias("n")), "sizes")
    sources = targets(sized.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("size")), weights, most)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        target, size = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
        rows = rows.sort_values("size")
        repeats = int(target // size) if size else 0
        budget = int(round(target - repeats * size)) if size else 0
        rows = rows.assign(repeats=repeats)
        rows["pick"] = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), budget, seed)
        return rows[["src", "size", "n", "source_size", "target", "repeats", "pick"]]

    plan = stored(
        hist.join(sources.select("src", F.col("size").alias("source_size"), "target"), "src")
        .groupBy("src").applyInPandas(choose, "src string, size long, n long, source_size long, target double, repeats long, pick long"), "plan")
    # Seeded choice: in (source, size), the `pick` smallest lots. Lots are cut into ranges by their place among 2^63 values.
    share = F.shiftrightunsigned("lot", 11) / F.lit(float(1 << 53))
    placed = (sized.join(plan, ["src", "size"])
              .withColumn("ranges", F.greatest(F.lit(1), F.floor(F.col("n") / RANKED)))
              .withColumn("range", F.floor(share * F.col("ranges"))))
    partial = placed.where((F.col("pick") > 0) & (F.col("pick") < F.col("n")))
    ahead = Window.partitionBy("src", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edges = (partial.groupBy("src", "size", "range").agg(F.count("*").alias("here"))
             .withColumn("before", F.coalesce(F.sum("here").over(ahead), F.lit(0))))
    ranked = (partial.join(edges, ["src", "size", "range"])
              .withColumn("in_all", F.col("before") + F.col("here") <= F.col("pick")))
    cut = ranked.where(~F.col("in_all") & (F.col("before") < F.col("pick")))
    within = Window.partitionBy("src", "size", "range").orderBy("lot", "id", "key")
    chosen = (ranked.where("in_all").select("id", "key", "size", "source_size", "target", "repeats", F.lit(1).alias("extra"))
              .unionByName(ranked.where(F.col("before") >= F.col("pick")).select("id", "key", "size", "source_size", "target", "repeats", F.lit(0).alias("extra")))
              .unionByName(cut.withColumn("r", F.row_number().over(within)).select(
                  "id", "key", "size", "source_size", "target", "repeats",
                  F.when(F.col("r") <= F.col("pick") - F.col("before"), 1).otherwise(0).alias("extra"))))
    whole = placed.where((F.col("pick") <= 0) | (F.col("pick") >= F.col("n"))).select(
        "id", "key", "size", "source_size", "target", "repeats", F.when(F.col("pick") > 0, 1).otherwise(0).alias("extra"))
    return whole.unionByName(chosen).select("id", "key", "size", "source_size", "target",
                                            (F.col("size") * (F.col("repeats") + F.col("extra"))).cast("long").alias("taken"))


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "size", "source_size", "target", "taken")
