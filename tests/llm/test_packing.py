"""Best-fit packing: token ids against the tokenizer, places against the rules, counts against brute-force best fit."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from hearthline.llm import packing

MODEL = Path(packing.TOKENIZER).read_text()
TOKENS = Tokenizer.from_str(MODEL)
ODD = ["", " ", "a  b", "a   b\n  c \n d", "  x", "x  ", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "it's  don't 12 3", "a\t b", "\x1c a \x1c", " " * 200_000,
       "é ß 中文 😀    x", "ab1 " * 5_000, "z" * 30_000]


@pytest.mark.parametrize("cut", [5, 1 << 20])
def test_ids_are_those_of_the_tokenizer(monkeypatch, sf, spark, cut):
    monkeypatch.setattr(packing, "SLICE", cut)
    encode = packing.Encoder(MODEL)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert encode.ranked is not None
    for t in ODD + texts:
        assert encode(t).tolist() == TOKENS.encode(t, add_special_tokens=False).ids


def test_a_model_of_another_kind_goes_through_the_tokenizer():
    import public_tokenizers

    model = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    encode, other = packing.Encoder(model), Tokenizer.from_str(model)
    assert encode.ranked is None and all(encode(t).tolist() == other.encode(t, add_special_tokens=False).ids for t in ODD[:8])


def best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = min((g for g in gaps if g >= n), default=None)
        if fits is not None:
            gaps.remove(fits)
        gaps.append((capacity if fits is None else fits) - n)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 50).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 25), max_size=15))))
def test_plans_fill_sequences_without_gaps(case):
    capacity, counts = case
    placed, ranks = defaultdict(list), Counter()
    entries = packing.plan(counts, capacity)
    for length, first, n, sequence, each, offset in entries:
        assert first == ranks[length] and n % each == 0
        ranks[length] += n
        for j in range(n):
            placed[sequence + j // each].append((offset + j % each * length, length))
    assert ranks == {k: v for k, v in counts.items() if v} and sorted(placed) == list(range(len(placed)))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * length > capacity for _, length in pieces) <= 2
    assert len(placed) <= best_fit_decreasing(counts, capacity) and -(-sum(n * c for n, c in counts.items()) // capacity) <= len(placed)


def test_a_plan_is_small_for_any_number_of_pieces():
    rng = np.random.default_rng(1)
    counts = {n: int(rng.integers(1, 10**9)) for n in range(1, 1025)}
    assert len(packing.plan(counts, 1024)) < 11 * 3 * 1024


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, length int, sequence_id int, _rank int")


ROWS = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "no id"), (4, "word " * 3_000), (5, "a long " * 40), (6, "x " * 500), (7, "y " * 700)] + [
    (10 + i, "tok " * (i * 37 % 400)) for i in range(60)]


def test_packed_pieces_hold_every_text(spark):
    pieces = packing.token_pieces(documents(spark, ROWS))
    packed = packing.best_fit(pieces).cache()
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    rows = packed.collect()
    assert sorted(whole) == list(range(len(whole))) and all(0 < len(x) <= 1024 for x in whole.values())
    assert sum(map(len, whole.values())) == sum(r["length"] for r in rows)
    want = Counter((i, tuple(TOKENS.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in ROWS)
    texts = defaultdict(list)
    for r in rows:
        ids = whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert ids == r["ids"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        texts[r["id"]].append((r["start"], r["piece"], ids))
    # Rows of one id are told apart by their content only.
    got = Counter()
    for i, parts in texts.items():
        n = sum(p[0] == 0 for p in parts)
        assert len({tuple(p[2]) for p in parts if p[0] == 0}) == 1
        one = [x for k, x in enumerate(sorted(parts)) if k % n == 0]
        assert [p[1] for p in one] == list(range(len(one))) and all(len(p[2]) == 1024 for p in one[1:])
        got[i, tuple(t for p in one for t in p[2])] += n
    assert got == want
    assert len(whole) <= best_fit_decreasing(Counter(r["length"] for r in rows), 1024)


def test_any_table_with_lengths(spark):
    rows = [(1, 600), (2, 400), (3, None), (4, 0), (5, 2_000), (6, 1_024), (7, 24), (7, 24), (8, -3)]
    got = {(r["k"], r["sequence_id"] is None) for r in packing.best_fit(spark.createDataFrame(rows, "k int, n int"), "n").collect()}
    assert got == {(1, False), (2, False), (3, True), (4, True), (5, True), (6, False), (7, False), (8, True)}
    assert packing.best_fit(spark.createDataFrame([], "k int, length int")).count() == 0
    assert packing.token_pieces(documents(spark, [])).count() == 0


def test_query_covers_all_documents(spark, sf):
    got = packing.op12_best_fit_packing(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = Counter()
    for r in docs:
        ids = TOKENS.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(zip(edges, edges[1:])):
            want[r["doc_id"], k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    rows = got.collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    n = len({r["sequence_id"] for r in rows})
    assert -(-sum(r["length"] for r in rows) // 1024) <= n <= best_fit_decreasing(Counter(r["length"] for r in rows), 1024)
