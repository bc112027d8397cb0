"""Best-fit packing of token pieces into sequences: large-item matching, then best fit of the small ones.

Pieces of one length are interchangeable, so the packing is planned on the number of pieces of each length, at most one entry for every
length up to the capacity. Pieces above a third of the capacity share a sequence with at most one more of their kind and are matched
greedily; smaller ones go into the smallest gap that holds them, longest first. A plan entry gives a run of equal pieces a run of
sequences; each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from hearthline.llm.frames import keep_shuffles_short, stored, table
from hearthline.plans.catalog import query

CAPACITY, END_ID = 1024, 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of a text that are encoded at a time.
SLICE = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as ``tokenizers`` gives them for a model file's content.

    A plain byte-level model whose ids are the ranks of its merges is also run from these ranks, four times as fast and with the same ids;
    texts that this can't take (long runs of white space) and all other models go through ``tokenizers``. Long texts are cut before
    spaces that follow no white space, where such a model always begins a token.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.exact, self.ranked = Tokenizer.from_str(model), self._ranked(json.loads(model))

    @staticmethod
    def _ranked(model: dict):
        import tiktoken

        bpe, split, added = model["model"], model.get("pre_tokenizer") or {}, model.get("added_tokens") or []
        vocab, special = bpe.get("vocab"), {t["content"]: t["id"] for t in added}
        if (bpe.get("type") != "BPE" or any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
                or model.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
                or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(" " in t for t in special)):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        first = len(vocab) - len(special.keys() & vocab.keys()) - len(merges)
        if any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
            return None
        byte = _byte_letters()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def _slices(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            end = text.find(" ", at + SLICE)
            while end > 0 and text[end - 1].isspace():
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def _exact(self, text: str) -> list[int]:
        return self.exact.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is None:
            return np.array(self._exact(text), np.uint32)
        found = []
        for part in self._slices(text):
            try:
                ids = (self.ranked.encode(part, allowed_special="all", disallowed_special=()) if any(t in part for t in self.ranked.special_tokens_set)
                       else self.ranked.encode_ordinary(part))
            except ValueError:  # its pattern has a bound on backtracking
                ids = self._exact(part)
            found.append(np.array(ids, np.uint32))
        return found[0] if len(found) == 1 else np.concatenate(found)


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 and, with ``with_ids``, the token ids of every piece of every text.

    A text is its ids and ``end_id``; a missing text is empty and has the end only. What is longer than ``capacity`` is cut from its end
    into pieces of that length, so that only the first may be shorter. Rows are never merged: a repeated row has pieces of its own, and a
    missing id stays missing. Other columns are not read. An empty table gives an empty one. ``tokenizer`` is a file of the driver; its
    content travels to the tasks.
    """
    model = Path(tokenizer).read_text()
    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(model)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:5])]
            if with_ids:
                ends = np.cumsum([0, *columns[3]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[5]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, z) in enumerate(zip(edges, edges[1:])):
                    own = ids[a:z]
                    rows.append((i, k, a, z - a, zlib.crc32(own.tobytes()), own if with_ids else None))
                    held += z - a if with_ids else 1
                    if held >= 1 << 17:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, pieces per sequence, offset): places for ``counts[length]`` pieces of each length.

    An entry takes the next pieces of a length, so many for each of consecutive sequences. A run of sequences that small pieces of a
    length go to is left with less than half its gap, so it is visited at most log2(capacity) times, and a length splits one run
    at most: the plan has O(capacity * log(capacity)) entries, however many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    out, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []  # the gaps that some sequence has, ascending

    def put(length: int, first: int, n_sequences: int, each: int, offset: int) -> None:
        out.append((length, taken[length], n_sequences * each, first, each, offset))
        taken[length] += n_sequences * each
        left[length] -= n_sequences * each

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in (b for b in large if b <= min(a, capacity - a)):
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                if a == b:
                    put(a, sequences, pairs, 2, 0)
                else:
                    put(a, sequences, pairs, 1, 0)
                    put(b, sequences, pairs, 1, a)
                leave(capacity - a - b, sequences, pairs)
                sequences += pairs
        if alone := left[a]:
            put(a, sequences, alone, 1, 0)
            leave(capacity - a, sequences, alone)
            sequences += alone
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                new = -(-left[s] // (capacity // s))
                leave(capacity, sequences, new)
                sequences += new
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del order[at]
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, first, full, each, capacity - gap)
                leave(gap - full // full * each * s, first, full)
            if full < n:
                rest = left[s]  # fewer than a sequence of this gap takes
                if rest:
                    put(s, first + full, 1, rest, capacity - gap)
                    leave(gap - rest * s, first + full, 1)
                leave(gap, first + full + (rest > 0), n - full - (rest > 0))
    return out


def best_fit(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: each row's place in a sequence of at most ``capacity``, without gaps from 0 on.

    Columns of these names are replaced; all others stay. Rows of one length are interchangeable, repeated rows included, and any of them
    may get a given place. A length that is missing, below 1 or above the capacity has no place (null). Only the counts by length
    reach the driver, at most ``capacity`` of them. An empty table gives an empty one.
    """
    keep_shuffles_short(items.sparkSession)
    own = [c for c in items.columns if c not in ("sequence_id", "offset")]
    length = F.col(length_col).cast("long")
    inside = F.when(length.between(1, capacity), length).otherwise(F.lit(0))
    ranked_schema = T.StructType([*items.select(own).schema, T.StructField("_length", T.LongType()), T.StructField("_part", T.LongType()), T.StructField("_rank", T.LongType())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the rows of a partition within their length."""
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            n = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            order = np.argsort(n, kind="stable")
            there, counts = np.unique(n, return_counts=True)
            at = np.empty(len(n), np.int64)
            at[order] = np.arange(len(n)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen[there], counts)
            seen[there] += counts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int64)), pa.array(at)], [f.name for f in ranked_schema])

    ranked = stored(items.select(*own, F.coalesce(inside, F.lit(0)).alias("_length")).mapInArrow(rank, ranked_schema), "ranked")
    here = ranked.groupBy("_length", "_part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(here.withColumn("_before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "ranks-before")
    counts = {r["_length"]: r["n"] for r in before.where("_length > 0").groupBy("_length").agg(F.sum("n").alias("n")).collect()}
    entries = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    schema = T.StructType([*items.select(own).schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (entries[:, 0] << 48) + entries[:, 1]
        for b in batches:
            n, rank_ = (b.column(b.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1))
            none = n == 0
            e = entries[np.maximum(0, np.searchsorted(key, (n << 48) + rank_, "right") - 1)] if len(entries) else np.zeros((len(n), 6), np.int64)
            nth, each = rank_ - e[:, 1], np.maximum(1, e[:, 4])
            places = e[:, 3] + nth // each, e[:, 5] + nth % each * n
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(p, mask=none) for p in places)], [f.name for f in schema])

    placed = ranked.join(before.select("_length", "_part", "_before"), ["_length", "_part"])
    return placed.select(*own, "_length", (F.col("_before") + F.col("_rank")).alias("_rank")).mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of every sequence, from pieces with their ids and places. At most one capacity of ids a row."""
    piece = F.struct("offset", "ids")
    joined = packed.where("sequence_id is not null").groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    return joined.select("sequence_id", F.flatten(F.col("pieces.ids")).alias("ids"))


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return best_fit(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
