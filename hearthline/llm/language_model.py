"""LM scoring: a small causal self-attention model over subword ids, trained and run in numpy.

A subword's probability is that of its group given the context, of its class in the group, and its share in the class; frequent
subwords are classes of their own. The shares, and how classes follow one another inside words and at their borders, are
counts over all training documents (taken from the word counts, so no text is read twice). Attention over the last subwords corrects them; it is trained on every block
of every training document, bucket by bucket, and averaged over the buckets after each round. Buckets are of pieces of documents by hash, so
that weights don't depend on how the table is split among tasks.

Windows overlap: every block of BLOCK subwords is scored once and sees the block before it as context. A word's probability in the text is
the attention model's (the product over its subwords) by the weight OWN and its share in the training documents by the rest.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.classifier import fold
from hearthline.llm.frames import NO_ID, keep_shuffles_short, stored, table, text_key, texts
from hearthline.llm.words import FOLDED, Hasher, Words, chunks
from hearthline.plans.catalog import query

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's vocabulary cuts text before merging; fixed with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, DIM, GROUPS, MEMBERS, ROWS = 16, 16, 32, 32, 1024
CLASSES, OWN_CLASS = GROUPS * MEMBERS, GROUPS * MEMBERS - 64
ROUNDS, RATE, BATCH = 2, 0.01, 512
#: Words whose counts are sent to all tasks (the most frequent ones); the counts of all others are joined.
HEAD = 1 << 16
#: Weight of the attention model; documents of a training bucket; words whose ids a task remembers.
OWN, BUCKET_DOCS, KNOWN = 0.7, 1 << 13, 1 << 20
#: Subwords of a training piece; words of a training bucket.
PIECE, BUCKET_TOKENS = 32 * BLOCK, 1 << 22
_CHUNK = 1 << 21


def read_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Subwords:
    """Ids of words, each encoded behind a space."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.begins = np.zeros(self.end + 1, bool)
        self.begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.int64)
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(words) or at[0]:  # white space beyond ASCII inside words can confuse the borders
            parts = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
            return np.array([i for p in parts for i in p], np.int64), np.array([len(p) for p in parts])
        return ids, np.diff(np.append(at, len(ids)))


def _ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] of them), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _word_bytes(w: Words, pick: np.ndarray) -> pa.Array:
    n = w.end[pick] - w.start[pick]
    off = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(w.code[_ragged(w.start[pick], n)])]).cast(pa.binary())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        for _, off, data in chunks(b.column("text"), _CHUNK):
            w = Words(off, data, FOLDED)
            h, first, n = np.unique(hasher(w), return_index=True, return_counts=True)
            yield pa.record_batch({"h": pa.array(h.view(np.int64)), "word": _word_bytes(w, first), "c": pa.array(n.astype(np.int64))})


@dataclass(frozen=True)
class Counts:
    """What the model takes from all training documents."""

    class_of: np.ndarray  # of each id
    share: np.ndarray  # log10 of an id's share in its class
    row_of: np.ndarray  # row of the embedding of each id; the last row stands for the beginning
    group: np.ndarray  # log probability of the next group after each row
    member: np.ndarray  # log probability of each class in its group after each row: rows x groups x members


def _tally(ranks: dict[bytes, int]):
    """How often ids occur, begin words, and follow one another inside words."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Subwords(ranks)
        for b in batches:
            for at in range(0, len(b), 1 << 16):
                part = b.slice(at, 1 << 16)
                c = part.column("c").to_numpy()
                ids, n = code(part.column("word").to_pylist())
                weight, begin = np.repeat(c, n), np.zeros(len(ids), bool)
                begin[np.cumsum(n) - n] = True
                inner = np.flatnonzero(~begin)
                last = np.cumsum(n) - 1
                # (id, next id); next -1: the id's own count, -2: as the first of a word, -3: as the last of a word.
                a = np.concatenate([ids, ids[begin], ids[last], ids[inner - 1]])
                z = np.concatenate([np.full(len(ids), -1), np.full(int(begin.sum()), -2), np.full(len(last), -3), ids[inner]])
                pair, where = np.unique(a << 20 | z + 3, return_inverse=True)
                yield pa.record_batch({"pair": pa.array(pair), "c": pa.array(np.bincount(where, np.concatenate([weight, weight[begin], weight[last], weight[inner]])).astype(np.int64))})

    return tally


def _counts(words: DataFrame, n_docs: int, ranks: dict[bytes, int]) -> Counts:
    end = max(ranks.values()) + 1
    pairs = words.select("word", "c").mapInArrow(_tally(ranks), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    pairs = stored(pairs.select(F.shiftright("pair", 20).alias("a"), (F.col("pair").bitwiseAND((1 << 20) - 1) - 3).alias("z"), "c"), "pairs")
    single = np.zeros((3, end + 1))
    for r in pairs.where("z < 0").collect():  # at most three numbers for each id of the vocabulary
        single[-r["z"] - 1, r["a"]] = r["c"]
    own, start, last = single
    own[end] = start[end] = n_docs
    order = np.argsort(-own, kind="stable")
    begins = np.zeros(end + 1, bool)
    begins[[i for t, i in ranks.items() if t[:1] == b" "]] = True
    # The most frequent ids are classes of their own; the others are banded by frequency, word beginnings apart. Classes are numbered
    # with those that begin words last, so that groups of them are alike.
    class_of = np.empty(end + 1, np.int64)
    class_of[order[:OWN_CLASS]] = np.arange(OWN_CLASS)
    rest, bands = order[OWN_CLASS:], (CLASSES - OWN_CLASS) // 2
    for side in (0, 1):
        ids = rest[begins[rest] == bool(side)]
        mass = np.cumsum(own[ids] + 0.1)
        class_of[ids] = OWN_CLASS + side * bands + np.minimum(bands - 1, (mass / mass[-1] * bands * 0.9999).astype(np.int64))
    side = np.concatenate([begins[order[:OWN_CLASS]], np.repeat([False, True], bands)])
    class_of = np.argsort(np.argsort(side, kind="stable"))[class_of]
    seen = own + 0.1
    share = np.log10(seen / np.bincount(class_of, seen, CLASSES)[class_of])
    rank = np.argsort(order)
    row_of = np.where(rank < ROWS, rank, ROWS + class_of // MEMBERS)
    rows = ROWS + GROUPS + 1
    follow = np.zeros((rows, CLASSES))
    # The vocabulary bounds this table to rows x classes: ids are turned into them before they are collected.
    to_row, to_class = row_of.tolist(), class_of.tolist()
    spark = words.sparkSession
    kinds = spark.createDataFrame([(i, to_row[i], to_class[i]) for i in range(end + 1)], "id long, row long, cls long")
    inner = (pairs.where("z >= 0").join(F.broadcast(kinds.select(F.col("id").alias("a"), "row")), "a")  # one row per id of the vocabulary
             .join(F.broadcast(kinds.select(F.col("id").alias("z"), "cls")), "z").groupBy("row", "cls").agg(F.sum("c").alias("c")))
    for r in inner.collect():
        follow[r["row"], r["cls"]] = r["c"]
    start_class = np.bincount(class_of, start, CLASSES)
    start_class = (start_class + 0.01) / (start_class + 0.01).sum()
    follow += np.bincount(row_of, last, rows)[:, None] * start_class
    follow[rows - 1] = start_class * 1e6
    usual = np.bincount(class_of, own + 0.1, CLASSES)
    follow += 2.0 * usual / usual.sum()
    follow = follow.reshape(rows, GROUPS, MEMBERS)
    group = follow.sum(2)
    return Counts(class_of, share.astype(np.float32), row_of, np.log(group / group.sum(1, keepdims=True)).astype(np.float32),
                  np.log(follow / group[..., None]).astype(np.float32))


# embedding, query, key, value, distance, output onto groups, output onto the members of each group
SHAPES = ((ROWS + GROUPS + 1, DIM), (DIM, DIM), (DIM, DIM), (DIM, DIM), (2 * BLOCK,), (DIM, GROUPS), (GROUPS, DIM, MEMBERS))


def _start() -> np.ndarray:
    rng = np.random.default_rng(5)
    parts = [rng.normal(0, 0.3, SHAPES[0]), *(rng.normal(0, 0.25, s) for s in SHAPES[1:4]), np.linspace(0, -2, 2 * BLOCK), np.zeros(SHAPES[5]), np.zeros(SHAPES[6])]
    return np.concatenate([p.ravel() for p in parts])


def _unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        size = int(np.prod(s))
        out.append(flat[at:at + size].reshape(s))
        at += size
    return out


_I, _J = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None]
_DISTANCE = np.clip(_I + BLOCK - _J, 0, 2 * BLOCK - 1)
_FUTURE = _J - BLOCK > _I


def _places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all sequences ``first[i]:first[i + 1]``: start, sequence, its first place, its end."""
    n = np.diff(first)
    many = -(-n // BLOCK)
    seq = np.repeat(np.arange(len(n)), many)
    return np.repeat(first[:-1], many) + BLOCK * _ragged(np.zeros(len(n), np.int64), many), seq, first[:-1][seq], first[1:][seq]


def _by_group(g: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and each group with its places in that order, so that a group's outputs are one product."""
    cut = np.concatenate(([0], np.cumsum(np.bincount(g, minlength=GROUPS)))).tolist()
    return np.argsort(g.astype(np.uint8), kind="stable"), [(i, x, y) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]


@dataclass(frozen=True)
class Blocks:
    """Sequences in blocks behind an empty one, so that every block has one before it."""

    rows: np.ndarray  # before each place: blocks x BLOCK
    classes: np.ndarray  # -1: no place of a sequence
    opened: np.ndarray  # blocks that begin a sequence: they see nothing of the block before


def _keep_memory() -> None:
    """Once a block of this size was given back, malloc keeps smaller ones for the next step instead of asking the system for new pages."""
    np.empty(30 << 20, np.uint8)


def _blocks(counts: Counts, ids: np.ndarray, first: np.ndarray, lead: np.ndarray | None = None) -> Blocks:
    """Blocks of all sequences; the first ``lead`` ids of a sequence are only context."""
    at, seq, begin, end = _places(first)
    inside = np.arange(BLOCK) < (end - at)[:, None]
    rows = np.full((len(at) + 1, BLOCK), len(counts.group) - 1, np.int16)
    classes = np.full((len(at) + 1, BLOCK), -1, np.int16)
    row_of, class_of = counts.row_of.astype(np.int16), counts.class_of.astype(np.int16)
    prev = np.empty(len(ids), np.int16)
    prev[1:] = row_of[ids[:-1]]
    prev[first[:-1][np.diff(first) > 0]] = len(counts.group) - 1
    rows[1:][inside], classes[1:][inside] = prev, class_of[ids]
    if lead is not None:
        classes[1:][at - begin < lead[seq]] = -1
    return Blocks(rows, classes, np.append(True, at == begin))


# Columns of the table of each row's key, value, a one that sums up the attention, query and embedding.
_K, _V, _Q, _E = slice(0, DIM), slice(DIM, 2 * DIM + 1), slice(2 * DIM + 1, 3 * DIM + 1), slice(3 * DIM + 1, 4 * DIM + 1)


def _table(theta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Key, value, one, query and embedding of each row, and what distance adds to attention: it depends on nothing else."""
    e, wq, wk, wv, dist = theta[:5]
    return np.hstack([e @ wk, e @ wv, np.ones((len(e), 1)), e @ wq / np.sqrt(DIM), e]).astype(np.float32), np.where(_FUTURE, -1e9, dist[_DISTANCE]).astype(np.float32)


def _attention(table: np.ndarray, near: np.ndarray, rows: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, ...]:
    """The table's columns of all blocks but the first and of each with the block before, the weights of attention and their sums
    of values, the weights' own last."""
    x = table.take(rows.ravel(), axis=0).reshape(len(rows), BLOCK, -1)
    both = np.lib.stride_tricks.as_strided(x, (len(x) - 1, 2 * BLOCK, x.shape[2]), x.strides, writeable=False)
    a = x[1:, :, _Q] @ both[:, :, _K].transpose(0, 2, 1)
    a += near
    if opened.any():
        a[opened, :, :BLOCK] = -1e9
    if a.max() > 60 or np.einsum("bii->bi", a[:, :, BLOCK:]).min() < -60:  # far from what exp can't hold unless training went astray
        a -= a.max(2, keepdims=True)
    np.exp(a, out=a)
    return x[1:], both, a, a @ both[:, :, _V]


_ONES = np.ones(max(GROUPS, MEMBERS), np.float32)


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of outputs, which may be moved by a constant each, and the sums."""
    p = np.exp(z)
    total = p @ _ONES[:z.shape[1]]
    if not (total.max(initial=1) < 1e15 and total.min(initial=1) > 1e-15):  # far from what exp can't hold unless training went astray
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        total = p @ _ONES[:z.shape[1]]
    return p, total


def _sum_by_row(rows: np.ndarray, g: np.ndarray, many: int) -> np.ndarray:
    """Sums of ``g`` by row as a few products: rows are split in two digits, the first by sorting, the second by zeros and ones."""
    low = 16
    high = -(-many // low)
    first = rows // low
    order, cut = np.argsort(first.astype(np.uint8), kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(first, minlength=high)))).tolist()
    hit = np.zeros((len(rows), low), np.float32)
    hit[np.arange(len(rows)), (rows - first * low)[order]] = 1
    g, out = g.take(order, axis=0), np.zeros((high, low, g.shape[1]), np.float32)
    for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
        if y > x:
            out[i] = hit[x:y].T @ g[x:y]
    return out.reshape(high * low, -1)[:many]


def train_step(theta: list[np.ndarray], counts: Counts, part: Blocks) -> tuple[float, np.ndarray]:
    """Mean loss of all blocks but the first, which is only context, and its gradient."""
    e, wq, wk, wv, _, ug, um = theta
    ug, um = ug.astype(np.float32), um.astype(np.float32)
    table, near = _table(theta)
    x, both, a, o = _attention(table, near, part.rows, part.opened[1:])
    per = 1 / o[:, :, DIM:]
    o = o[:, :, :DIM] * per
    t, row = part.classes[1:].ravel(), part.rows.ravel().astype(np.int64)
    real = np.flatnonzero(t >= 0)
    order, of = _by_group(t[real] // MEMBERS)
    order = real[order]
    n, all_, t, last = max(1, len(order)), np.arange(len(order)), t[order].astype(np.int64), row[BLOCK:][order]
    g, m = t // MEMBERS, t % MEMBERS
    h = (o + x[:, :, _E]).reshape(-1, DIM).take(order, axis=0)
    zg, zm = h @ ug, counts.member.reshape(-1, MEMBERS).take(last * GROUPS + g, axis=0)
    zg += counts.group.take(last, axis=0)
    for i, y, z in of:
        zm[y:z] += h[y:z] @ um[i]
    loss = 0.0
    (zg, sum_g), (zm, sum_m) = _exp(zg), _exp(zm)
    for z, total, hit in ((zg, sum_g, g), (zm, sum_m, m)):  # each becomes its own gradient
        loss -= float(np.log(z[all_, hit] / total + 1e-30).sum()) / n
        z *= (1 / (total * n))[:, None]
        z[all_, hit] -= 1 / n
    gug, gum = h.T @ zg, np.zeros_like(um)
    gh = zg @ ug.T
    for i, y, z in of:
        gum[i] = h[y:z].T @ zm[y:z]
        gh[y:z] += zm[y:z] @ um[i].T
    # What each place hands on: to its key, value, query and embedding.
    back = np.zeros((len(part.rows), BLOCK, 4 * DIM), np.float32)
    whole = np.zeros((len(row) - BLOCK, DIM), np.float32)
    whole[order] = gh
    whole = whole.reshape(-1, BLOCK, DIM)
    back[1:, :, 3 * DIM:] = whole
    left = np.empty((*whole.shape[:2], DIM + 1), np.float32)
    np.multiply(whole, per, out=left[:, :, :DIM])
    left[:, :, DIM] = -((left[:, :, :DIM] * o).reshape(-1, DIM) @ _ONES[:DIM]).reshape(-1, BLOCK)
    gs = left @ both[:, :, _V].transpose(0, 2, 1)
    gs *= a
    pair = np.empty((len(whole), 2 * BLOCK, 2 * DIM), np.float32)
    np.matmul(gs.transpose(0, 2, 1), x[:, :, _Q], out=pair[:, :, :DIM])
    np.matmul(a.transpose(0, 2, 1), left[:, :, :DIM], out=pair[:, :, DIM:])
    back[1:, :, :2 * DIM] = pair[:, BLOCK:]
    back[:-1, :, :2 * DIM] += pair[:, :BLOCK]
    np.matmul(gs, both[:, :, _K], out=back[1:, :, 2 * DIM:3 * DIM])
    gd = np.bincount(_DISTANCE.ravel(), np.ones(len(gs), np.float32) @ gs.reshape(len(gs), -1), 2 * BLOCK)
    gk, gv, gq, ge = np.hsplit(_sum_by_row(row, back.reshape(-1, 4 * DIM), len(e)).astype(float), 4)
    gq = gq / np.sqrt(DIM)
    parts = (ge + gk @ wk.T + gv @ wv.T + gq @ wq.T, e.T @ gq, e.T @ gk, e.T @ gv, gd, gug, gum)
    return loss, np.concatenate([p.ravel() for p in parts])


class WordIds:
    """The ids of words by the words' hashes; each word is encoded once, as long as the memory's bound holds."""

    def __init__(self, code: Subwords):
        self.code = code
        self._forget()

    def _forget(self) -> None:
        self.hash, self.begin, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.array([self.code.end], np.int64)  # at 0

    def __call__(self, w: Words, h: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` the distinct, ascending words ``h`` begin, and their lengths; ``pick`` is a place of each in ``w``."""
        if len(self.hash) + len(h) > KNOWN:
            self._forget()
        at = np.searchsorted(self.hash, h)
        new = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] != h) if len(self.hash) else np.arange(len(h))
        if len(new):
            ids, n = self.code(_word_bytes(w, pick[new]).to_pylist())
            self.hash, self.n = np.insert(self.hash, at[new], h[new]), np.insert(self.n, at[new], n)
            self.begin = np.insert(self.begin, at[new], len(self.ids) + np.cumsum(n) - n)
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.hash, h)
        return self.begin[at], self.n[at]


def _encoded(words: WordIds, w: Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The subword ids of all rows, an end after each; the borders of the rows and of the words (ends are words); the distinct
    hashes and which of them each word is (their number: an end)."""
    distinct, pick, back = np.unique(h, return_index=True, return_inverse=True)
    begin, n = words(w, distinct, pick)
    begin, n = np.append(begin, 0), np.append(n, 1)
    word = np.insert(back, w.first[1:], len(pick))
    size = np.concatenate(([0], np.cumsum(n[word])))
    return words.ids[_ragged(begin[word], n[word])], size[np.concatenate(([0], w.first[1:] + np.arange(1, len(w.first))))], size, distinct, word


def _bucket(counts: Counts, rows: pa.Table) -> Blocks:
    """The blocks of a bucket's pieces by place and turn. Pieces are laid out as they come, a few at a time, so that none is copied to be sorted."""
    many = -(-pc.list_value_length(rows["ids"]).to_numpy().astype(np.int64) // BLOCK)
    order = np.lexsort((rows["nth"].to_numpy(), rows["place"].to_numpy()))
    start = np.empty(len(many), np.int64)
    start[order] = 1 + np.cumsum(many[order]) - many[order]
    size, lead = 1 + int(many.sum()), rows["lead"].to_numpy()
    all_ = Blocks(np.full((size, BLOCK), len(counts.group) - 1, np.int16), np.full((size, BLOCK), -1, np.int16), np.ones(size, bool))
    done = 0
    for chunk in rows["ids"].chunks:
        for i in range(0, len(chunk), 1024):
            part = chunk.slice(i, 1024)
            first = part.offsets.to_numpy().astype(np.int64)
            here = slice(done, done + len(part))
            some = _blocks(counts, part.flatten().to_numpy(zero_copy_only=False), first - first[0], lead[here])
            to = _ragged(start[here], many[here])
            all_.rows[to], all_.classes[to], all_.opened[to] = some.rows[1:], some.classes[1:], some.opened[1:]
            done += len(part)
    return all_


def _trainer(counts: Counts, flat: np.ndarray):
    """One pass of Adam over a bucket's windows; gives the number of steps, the weighted loss and the weights."""

    def train(rows: pa.Table) -> pa.Table:
        _keep_memory()
        now, m, v, step, lost = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0, 0.0
        blocks = _bucket(counts, rows)
        own = np.flatnonzero(blocks.classes[:, 0] >= 0)  # a block that a piece only repeats as context isn't predicted
        for i in range(0, len(own), BATCH):
            part = slice(own[i] - 1, own[min(i + BATCH, len(own)) - 1] + 1)
            loss, g = train_step(_unpack(now), counts, Blocks(blocks.rows[part], blocks.classes[part], blocks.opened[part]))
            step, lost = step + 1, lost + loss
            m += 0.1 * (g - m)
            g *= g
            v += 0.001 * (g - v)
            g = np.sqrt(v / (1 - 0.999**step), out=g)
            g += 1e-8
            now -= RATE / (1 - 0.9**step) * m / g
        return pa.table({"v": pa.array([np.concatenate(([step, lost], now * step)).tobytes()], pa.binary())})

    return train


def _windows(ranks: dict[bytes, int]):
    """(place, nth, lead, ids): all subwords of each row, an end after them, in pieces of PIECE; the first ``lead`` of a piece are the block before it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher = WordIds(Subwords(ranks)), Hasher()
        for b in batches:
            places = b.column("place").to_numpy()
            for at, off, data in chunks(b.column("text"), _CHUNK):
                w = Words(off, data, FOLDED)
                ids, first = _encoded(words, w, hasher(w))[:2]
                many = -(-np.diff(first) // PIECE)
                row = np.repeat(np.arange(len(many)), many)
                turn = _ragged(np.zeros(len(many), np.int64), many)
                lead = np.where(turn > 0, BLOCK, 0)
                begin = first[:-1][row] + turn * PIECE
                size = np.minimum(begin + PIECE, first[1:][row]) - begin + lead
                yield pa.record_batch({
                    "place": pa.array(places[at + row]), "nth": pa.array(turn), "lead": pa.array(lead),
                    "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(ids[_ragged(begin - lead, size)].astype(np.int32)))})

    return cut


def _fit(train: DataFrame, n_docs: int, n_tokens: int, ranks: dict[bytes, int], counts: Counts) -> np.ndarray:
    """Weights after ROUNDS over every block of the training documents; rows that are equal in id and text count once."""
    flat = _start()
    pieces = train.select(F.xxhash64("id", "key").alias("place"), "text").mapInArrow(_windows(ranks), "place long, nth long, lead long, ids array<int>").dropDuplicates(["place", "nth"])
    # Buckets of pieces by hash; long documents make more buckets, so that none holds more than a bounded number of words.
    buckets = max(1, -(-n_docs // BUCKET_DOCS), -(-n_tokens // BUCKET_TOKENS))
    windows = stored(pieces.withColumn("bucket", F.pmod(F.xxhash64("place", "nth"), F.lit(buckets))), "windows")
    for _ in range(ROUNDS):
        # Stored, so that the shuffle of the windows goes with its job; a row for each bucket.
        rdd = stored(windows.groupBy("bucket").applyInArrow(_trainer(counts, flat), "v binary"), "weights").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.float64))
        total = rdd.treeAggregate(np.zeros(len(flat) + 2), lambda a, b: a + b, lambda a, b: a + b)
        if not total[0]:
            break
        flat = total[2:] / total[0]
    return flat


def score_ids(theta: list[np.ndarray], counts: Counts, ids: np.ndarray, first: np.ndarray, at_once: int = 512) -> np.ndarray:
    """log10 probability of every id given those before it in its sequence, each scored once."""
    e, ug, um = theta[0], *(u.astype(np.float32) for u in theta[5:])
    table, near = _table(theta)
    group = (e @ ug + counts.group).astype(np.float32)
    member = (np.einsum("rd,gdm->rgm", e, um) + counts.member).astype(np.float32).reshape(-1, MEMBERS)
    blocks = _blocks(counts, ids, first)
    out = np.zeros(blocks.rows[1:].shape, np.float32)
    for i in range(1, len(blocks.rows), at_once):
        rows, classes = blocks.rows[i - 1:i + at_once], blocks.classes[i:i + at_once].ravel()
        h = _attention(table, near, rows, blocks.opened[i:i + at_once])[3].reshape(-1, DIM + 1)
        real = np.flatnonzero(classes >= 0)
        order, of = _by_group(classes[real] // MEMBERS)
        order = real[order]
        h, cls, last = h.take(order, axis=0), classes[order].astype(np.int64), rows[1:].ravel()[order].astype(np.int64)
        h = h[:, :DIM] / h[:, DIM:]
        g, m, all_ = cls // MEMBERS, cls % MEMBERS, np.arange(len(cls))
        zg, zm = h @ ug, member.take(last * GROUPS + g, axis=0)
        zg += group.take(last, axis=0)
        for k, x, y in of:
            zm[x:y] += h[x:y] @ um[k]
        total = _exp(zg)[1] * _exp(zm)[1]  # before the outputs are read: it may move them
        out[i - 1:i - 1 + at_once].reshape(-1)[order] = zg[all_, g] + zm[all_, m] - np.log(total)
    return out[blocks.classes[1:] >= 0] / np.log(10) + counts.share[ids].astype(float)


@dataclass(frozen=True)
class Known:
    """The training tokens: their number, the distinct ones, the documents, and the counts of the most frequent words by hash."""

    n: int
    distinct: int
    docs: int
    head: np.ndarray
    count: np.ndarray

    def mixed(self, count: np.ndarray, score: np.ndarray) -> np.ndarray:
        """log10 probability of tokens that occur ``count`` times and that the attention model scores with ``score``."""
        if not self.n:
            return score
        with np.errstate(divide="ignore"):
            return np.where(count > 0, np.log10(OWN * 10.0**score + (1 - OWN) * count / self.n), score + np.log10(OWN))


def _scorer(ranks: dict[bytes, int], counts: Counts, flat: np.ndarray, known: Known):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher, theta = WordIds(Subwords(ranks)), Hasher(), _unpack(flat)
        _keep_memory()
        for b in batches:
            for row, off, data in chunks(b.column("text"), _CHUNK):
                w = Words(off, data, FOLDED)
                ids, first, borders, distinct, word = _encoded(words, w, hasher(w))
                own = np.add.reduceat(score_ids(theta, counts, ids, first), borders[:-1])
                at = np.minimum(np.searchsorted(known.head, distinct), max(0, len(known.head) - 1))
                count = np.where(known.head[at] == distinct, known.count[at], -1) if len(known.head) else np.full(len(distinct), -1)
                # -1: a word that isn't among the frequent ones; its count is joined.
                c = np.append(count, known.docs)[word]
                n, end = len(off) - 1, word == len(distinct)
                of = np.repeat(np.arange(n), w.counts() + 1)
                tail = np.flatnonzero(c < 0)
                rest = np.flatnonzero(c >= 0)
                frequent = rest[~end[rest]]
                ends = np.concatenate(([0], np.cumsum(np.bincount(of[tail], minlength=n)))).astype(np.int32)
                part = b.slice(row, n)
                yield pa.record_batch({
                    "id": part.column("id"), "key": part.column("key"), "n_words": pa.array(w.counts().astype(np.int64)),
                    "head_mixed": pa.array(np.bincount(of[rest], known.mixed(c[rest], own[rest]), n).astype(float)), "head_known": pa.array(np.bincount(of[frequent], minlength=n).astype(np.int64)),
                    "head_score": pa.array(np.bincount(of[frequent], np.log10((c[frequent] + 1) / (known.n + known.distinct + 1)), n).astype(float)),  # without words bincount gives whole numbers
                    "tail": pa.ListArray.from_arrays(pa.array(ends), pa.array(distinct[word[tail]].view(np.int64))),
                    "tail_own": pa.ListArray.from_arrays(pa.array(ends), pa.array(own[tail]))})

    return score


def lm_scores(docs: DataFrame, ranks: dict[bytes, int], parts: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (see text_key), held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``.

    Words in lower case (A-Z only), then an end. base_score: add-one unigram over words and the end; score: the model's log10 probability of
    the words and the end, attention running over the subwords of the text (its words joined by spaces, one before the first). A missing text is an
    empty one: only the end is scored. Every row counts, also a repeated one. Without training rows the base has no counts and the
    model only its starting values.
    """
    spark = docs.sparkSession
    keep_shuffles_short(spark)
    held_out = fold(F.when(F.col("id") != NO_ID, F.col("id")), parts) == held
    t = texts(docs, id_col, text_col, key=text_key(docs[text_col]))
    train = t.where(~held_out)
    words = stored(train.select("text").mapInArrow(_count_words, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c")), "words")
    n_docs = train.count()
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"] + n_docs, size["v"] + (n_docs > 0)
    floor = float(n + v + 1)
    counts = _counts(words, n_docs, ranks)
    flat = _fit(train, n_docs, n, ranks, counts)
    # Frequent words by bands of counts, so that a bounded table of bands says which words to fetch: at most HEAD pairs of numbers.
    band = F.floor(F.log2("c") * 16)
    bands = sorted(((r["band"], r["n"]) for r in words.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, lowest = 0, None
    for b, many in bands:
        held += many
        if held > HEAD:
            break
        lowest = b
    top = words.where(band >= lowest).select("h", "c").collect() if lowest is not None else []
    head = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(head)
    known = Known(n, v, n_docs, head[order], np.array([r["c"] for r in top], np.int64)[order])
    scored = stored(t.mapInArrow(_scorer(ranks, counts, flat, known), "id long, key long, n_words long, head_mixed double, head_known long, head_score double, "
                                                                      "tail array<long>, tail_own array<double>").withColumn("row", F.monotonically_increasing_id()), "scored")
    novel = F.col("own") + math.log10(OWN) if n else F.col("own")
    mixed = F.when(F.col("c").isNull(), novel).otherwise(F.log10(OWN * F.pow(F.lit(10.0), F.col("own")) + (1 - OWN) * F.col("c") / F.lit(float(max(1, n)))))
    tail = (scored.select("row", F.explode(F.arrays_zip("tail", "tail_own")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.tail_own").alias("own"))
            .join(words.select("h", "c"), "h", "left").groupBy("row")
            .agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(floor))).alias("tail_score"), F.count("c").alias("tail_known"), F.sum(mixed).alias("tail_mixed")))
    end_score = float(np.log10((n_docs + 1) / floor))
    return scored.drop("tail", "tail_own").join(tail, "row", "left").select(
        "id", "key", held_out.alias("held_out"), (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0)) + F.lit(end_score)).alias("base_score"),
        (F.col("head_mixed") + F.coalesce("tail_mixed", F.lit(0.0))).alias("score"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), read_ranks())
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), *out.columns[2:])
