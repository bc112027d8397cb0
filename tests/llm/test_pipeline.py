"""The pipeline stage by stage against brute force on a small table."""

import corpus_pipeline
import numpy as np
import pytest
from test_table_operators import brute_hits, brute_lines, shingle_set, split

RNG = np.random.default_rng(9)
SYLLABLES = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "so") for b in ("n", "ra", "de", "st", "ku")]


def prose(lines=8, words=14):
    return "\n".join(" ".join(RNG.choice(SYLLABLES, words)).capitalize() + "." for _ in range(lines))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    notice, item = "All rights reserved by the people who made this.", " ".join(RNG.choice(SYLLABLES, 24))
    base = prose(14)
    rows = [(i, prose(), f"s{i % 3}") for i in range(40)]
    rows += [(40 + i, " ".join(w + "$$$" for w in prose(10).split()), "s0") for i in range(10)]
    rows += [(60 + i, prose() + "\n" + notice, "s1") for i in range(6)]
    rows += [(70, base, "s1"), (71, base, "s2"), (72, base + " again.", "s0"), (72, base + " again.", "s0"), (73, "x " + base, None)]
    rows += [(80, prose() + "\n" + item, "s1"), (81, item.upper() + ".\n" + prose(), "s2"), (90, None, "s1"), (91, "", "s1"), (92, "too short", "s1"), (None, prose(), "s2"), (None, prose(), "s2")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "k") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 40 <= i < 50), 0) for i, _, _ in rows if i is not None and i % 2 == 0 and i < 60], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, item


def test_stages(spark, tables):
    d, item = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    read = lambda df: sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"]) for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)
    one = corpus_pipeline.stored(stage["quality_rules"](spark, docs, d), "t")
    assert one.columns == docs.columns
    assert read(one) == [r for r in read(docs) if not (40 <= r[0] < 50) and r[0] not in (90, 91, 92)]
    two = corpus_pipeline.stored(stage["line_dedup"](spark, one, d), "t")
    assert two.columns == docs.columns
    assert read(two) == [(i, t) for i, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in one.collect()])]
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = corpus_pipeline.stored(stage["ngram_jaccard"](spark, two, d), "t")
    rows = [r for r in two.collect()]
    assert three.columns == docs.columns and three.count() < len(rows)
    kept = [shingle_set(t) for _, t in read(three)]
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if a and b)
    every = [shingle_set(t) for _, t in read(two)]
    assert all(any(100 * len(a & b) >= 75 * len(a | b) for b in kept) for a in every if a)
    assert sum(r["doc_id"] is None for r in three.collect()) == 2
    four = corpus_pipeline.stored(stage["decontamination"](spark, three, d), "t")
    clean = {i for i, _, n, _ in brute_hits([(r["doc_id"], r["text"]) for r in three.collect()], [("q", item)]) if not n}
    assert {i for i, _ in read(four)} == {i if i < 2**62 else -1 for i in clean} and not {80, 81} & clean
    five = stage["source_mixing"](spark, four, d).collect()
    assert sorted(r["size"] for r in five) == sorted(len(split(t)) for _, t in read(four))


def test_run(spark, tables):
    d, _ = tables
    assert corpus_pipeline.run(spark, d).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_stages_of_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
