"""Substring dedup: suffix automata of reference shards, through which documents are streamed for matching statistics.

Only passages that a smaller id holds as well can go, and finding them needs no automaton: of every ``window`` words the smallest
5-word hash is an anchor that equal windows share, so anchors of two documents and then hashes of the windows around them narrow
the corpus down to passages that repeat. Their first holders are the reference, cut into shards of bounded size. An automaton of
a shard is sent to as many tasks as its candidates need; there matching statistics over the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.frames import NO_ID, keep_shuffles_short, stored, table, text_key, texts
from hearthline.llm.words import PLAIN, Hasher, Words, chunks, shingles
from hearthline.plans.catalog import query

ANCHOR = 5
#: Words of reference passages in a shard, and of candidates that one task streams through it.
SHARD_WORDS, STREAM_WORDS = 60_000, 250_000


def _smallest(g: np.ndarray, width: int) -> np.ndarray:
    """Places of the leftmost smallest value among g[i:i + width], for every i."""
    value, place, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        n = len(value) - step
        if n <= 0:
            return np.empty(0, np.int64)
        left = value[:n] <= value[step:]
        value, place = np.where(left, value[:n], value[step:]), np.where(left, place[:n], place[step:])
        have += step
    return place


class _Chunk:
    """Windows and anchors of one run of rows: starts of whole windows, and runs of windows with one anchor."""

    def __init__(self, hasher: Hasher, off: np.ndarray, data: np.ndarray, window: int):
        self.words = w = Words(off, data, PLAIN)
        self.h = hasher(w)
        g, _ = shingles(self.h, w.first, ANCHOR)
        place = _smallest(g, window - ANCHOR + 1)
        ok = shingles(self.h, w.first, window)[1] if len(place) else np.empty(0, bool)
        self.start = np.flatnonzero(ok[:len(place)])
        at = place[self.start]
        row = w.row()[self.start] if len(self.start) else self.start
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        self.run = np.flatnonzero(new)
        self.length = np.diff(np.append(self.run, len(at)))
        self.row = row[self.run]
        self.anchor = g[at[self.run]].view(np.int64)
        self.pos = self.start[self.run] - w.first[self.row]


def _anchors(window: int, places: bool):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for row, off, data in chunks(b.column("text")):
                c = _Chunk(hasher, off, data, window)
                out = {"h": pa.array(c.anchor), "id": pa.array(ids[row + c.row])}
                # The first window of the run and how many there are, in one number.
                yield pa.record_batch(out | ({"place": pa.array(c.pos * 64 + c.length)} if places else {}))

    return anchors


def _windows(window: int):
    """Hashes of the windows in the given runs."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            ids, keys = b.column("id").to_numpy(zero_copy_only=False), b.column("key").to_numpy(zero_copy_only=False)
            given = b.column("places")
            for row, off, data in chunks(b.column("text")):
                w = Words(off, data, PLAIN)
                g, ok = shingles(hasher(w), w.first, window)
                of, at = [], []
                for r in range(len(off) - 1):
                    p = np.asarray(given[row + r].values)
                    begin, n = p // 64, p % 64
                    i = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum())) if len(p) else p
                    i = np.unique(i[i + window <= int(w.first[r + 1] - w.first[r])])
                    of.append(np.full(len(i), row + r))
                    at.append(i)
                of, at = np.concatenate(of).astype(np.int64), np.concatenate(at).astype(np.int64)
                yield pa.record_batch({"wh": pa.array(g[w.first[of - row] + at].view(np.int64)), "id": pa.array(ids[of]), "key": pa.array(keys[of]), "pos": pa.array(at)})

    return windows


def _cut(window: int):
    """Reference passages (what this document holds first) and candidates (what ``ref`` holds before), from marked windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("ref", "is_ref", "id", "key", "start", "n", "text")}
            for doc, key, text, pos, ref in zip(*(b.column(c).to_pylist() for c in ("id", "key", "text", "pos", "ref"))):
                words, order = text.encode("utf-8", "replace").split(), np.argsort(pos, kind="stable")
                p, r = np.array(pos)[order], np.array(ref)[order]
                edge = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(r) != 0)))
                for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(p)]):
                    a, z = int(p[s]), int(p[e - 1]) + window
                    for n, v in zip(out, (int(r[s]), int(r[s]) == doc, doc, key, a, z - a, b" ".join(words[a:z]))):
                        out[n].append(v)
            yield pa.record_batch({n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))})

    return cut


class Automaton:
    """Suffix automaton of many word sequences, added by rising id; each state knows the smallest id that holds its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-1]

    def _state(self, moves: dict, length: int, owner: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the words of p and ``word``, apart from the longer ones that end in the same places."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.owner[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, owner: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                continue
            new = self._state({}, self.length[last] + 1, owner)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.next[p][word])
            last = new

    def spans(self, words: list, owner: int, least: int) -> list[tuple[int, int]]:
        """Maximal runs of ``words`` covered by matches of ``least`` words or more that a smaller owner holds."""
        out: list[tuple[int, int]] = []
        state = size = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(word)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= least:
                s = state
                while self.length[self.link[s]] >= least:
                    s = self.link[s]
                if self.owner[s] < owner:
                    if out and i + 1 - least <= out[-1][1]:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((i + 1 - least, i + 1))
        return out


def _stream(window: int):
    def stream(group: pd.DataFrame) -> pd.DataFrame:
        ids: dict[bytes, int] = {}
        auto = Automaton()
        refs = group[group["is_ref"]].sort_values(["id", "start"])
        for owner, text in zip(refs["id"], refs["text"]):
            auto.add([ids.setdefault(w, len(ids)) for w in text.split()], owner)
        out: list[tuple[int, int, int, int]] = []
        todo = group[~group["is_ref"]]
        for doc, key, start, text in zip(todo["id"], todo["key"], todo["start"], todo["text"]):
            out += [(doc, key, start + a, start + z) for a, z in auto.spans([ids.get(w, -1) for w in text.split()], doc, window)]
        return pd.DataFrame(out, columns=["id", "key", "a", "z"])

    return stream


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, kept = [], [], []
        for text, a, z in zip(*(b.column(c).to_pylist() for c in ("text", "a", "z"))):
            words = text.encode("utf-8", "replace").split()
            n.append(len(words))
            if a:
                out, to = [], 0
                for s, e in sorted(zip(a, z)):
                    if s > to:
                        out += words[to:s]
                    to = max(to, e)
                words = out + words[to:]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.record_batch({"id": b.column("id"), "key": b.column("key"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                               "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})


def dedup_substrings(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (see text_key), n_words, n_removed, kept_text (kept words joined by a space) per row of ``docs``.

    A word goes if one of the windows of ``window`` words that cover it also starts in a document with a smaller id. Repeats within one
    id stay, also across several rows of that id; a missing id counts as the largest, and rows without id don't remove from one
    another. Texts of fewer words stay whole. Windows are those of the input, not of what is left.
    """
    spark = docs.sparkSession
    if window <= ANCHOR or window - ANCHOR > 60:
        raise ValueError(f"window must be {ANCHOR + 1} to {ANCHOR + 60} words")
    keep_shuffles_short(spark)
    t = texts(docs, id_col, text_col)
    several = (F.col("low") < F.col("high"),)
    shared = stored(t.mapInArrow(_anchors(window, False), "h long, id long").groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"))
                    .where(several[0]).select("h"), "anchors")
    places = stored(t.mapInArrow(_anchors(window, True), "h long, id long, place long").join(shared, "h", "left_semi")
                    .groupBy("id").agg(F.collect_set("place").alias("places")), "places")
    keyed = texts(docs, id_col, text_col, key=text_key(docs[text_col]))
    windows = stored(keyed.join(places, "id").select("id", "key", "text", "places").mapInArrow(_windows(window), "wh long, id long, key long, pos long"), "windows")
    first = stored(windows.groupBy("wh").agg(F.min("id").alias("low"), F.max("id").alias("high")).where(several[0]).select("wh", F.col("low").alias("ref")), "firsts")
    marks = stored(windows.join(first, "wh").groupBy("id", "key").agg(F.collect_set(F.struct("pos", "ref")).alias("m"))
                   .select("id", "key", F.col("m.pos").alias("pos"), F.col("m.ref").alias("ref")), "marks")
    passages = stored(keyed.join(marks, ["id", "key"]).select("id", "key", "text", "pos", "ref")
                      .mapInArrow(_cut(window), "ref long, is_ref boolean, id long, key long, start long, n long, text binary"), "passages")
    # Shards of about SHARD_WORDS reference words; one with many candidates is sent to several tasks.
    total = passages.where("is_ref").agg(F.sum("n")).first()[0] or 0
    cut = passages.withColumn("shard", F.pmod(F.xxhash64("ref"), F.lit(1 + total // SHARD_WORDS)))
    tasks = cut.where("not is_ref").groupBy("shard").agg((1 + F.floor(F.sum("n") / STREAM_WORDS)).alias("tasks"))
    sent = cut.join(tasks, "shard")
    salted = (sent.where("is_ref").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
              .unionByName(sent.where("not is_ref").withColumn("task", F.pmod(F.xxhash64("id", "key", "start"), F.col("tasks")))))
    spans = stored(salted.select("shard", "task", "is_ref", "id", "key", "start", "text")
                   .groupBy("shard", "task").applyInPandas(_stream(window), "id long, key long, a long, z long"), "spans")
    by_row = spans.groupBy("id", "key").agg(F.collect_set(F.struct("a", "z")).alias("s")).select("id", "key", F.col("s.a").alias("a"), F.col("s.z").alias("z"))
    return keyed.join(by_row, ["id", "key"], "left").select("id", "key", "text", "a", "z").mapInArrow(
        _drop, "id long, key long, n_words long, n_removed long, kept_text string")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT x, min(doc_id) AS low FROM g GROUP BY x HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (x) WHERE doc_id > low),
k AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
s AS (SELECT k.doc_id, count(r.p) AS n_removed, string_agg(word, ' ' ORDER BY k.p) FILTER (WHERE r.p IS NULL) AS kept
      FROM k LEFT JOIN r USING (doc_id, p) GROUP BY k.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""


@query("op9_substring_dedup", SQL)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
