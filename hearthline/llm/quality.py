"""Quality rules: a conditional random field labels each line content or boilerplate; the share of content decides.

The field is fitted on a bounded sample of labelled documents, of which each line carries the document's label. Lines are
described by counts of characters and words only, so that no language is preferred.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.crf import Crf, fit, viterbi
from hearthline.llm.frames import NO_ID, keep_shuffles_short, table, text_key, texts
from hearthline.plans.catalog import query

#: Labelled documents and lines of each that the field is fitted on; everything else uses whole texts.
FIT_DOCS, FIT_LINES = 2_000, 100

_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS, _WHITE = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), bytes([0x20, *range(9, 14)])
_LETTERS = _UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TAIL = bytes(range(0x80, 0xC0))  # the bytes of a code point after its first
FEATURES = 20


def _share(line: bytes, kind: bytes, of: int) -> float:
    return (len(line) - len(line.translate(None, kind))) / of


def line_features(line: bytes, repeated: bool) -> list[float]:
    """Numbers in 0..1 about one line; a line without words has only the first two."""
    words = line.split()
    if not words:
        return [1.0, 1.0] + [0.0] * (FEATURES - 2)
    n, chars = len(words), sum(map(len, words))
    symbols, upper, digits = _share(line, _SYMBOLS, chars), _share(line, _UPPER, chars), _share(line, _DIGITS, chars)
    marks = sum(1 for w in words if w[-1] in b"!$%&#*|")
    fresh = len(set(words)) / n
    last = words[-1][-1]
    return [1.0, 0.0, float(n < 4), float(4 <= n < 12), float(n >= 12), min(1.0, symbols * 5), float(symbols > 0.05), min(1.0, upper * 2),
            float(upper > 0.4), min(1.0, digits * 5), marks / n, float(marks * 5 > n), fresh if n >= 8 else 1.0, float(n >= 8 and fresh < 0.4),
            float(repeated), float(last in b".?:;"), float(last in b"!|%$&*#"), min(1.0, chars / n / 20), float(chars > 25 * n),
            1.0 - min(1.0, _share(line, _LETTERS, chars))]


def _lines(text: bytes) -> tuple[list[bytes], list[bool]]:
    seen: set[bytes] = set()
    parts, again = text.split(b"\n"), []
    for p in parts:
        again.append(p in seen and bool(p.strip()))
        seen.add(p)
    return parts, again


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = text.split()
    n = len(w)
    chars = len(text.translate(None, _WHITE + _TAIL))
    repeat = 0
    grams = list(zip(w, w[1:], w[2:]))
    if len(set(grams)) < len(grams):
        times, end = Counter(grams), 0
        for i, g in enumerate(grams):
            if times[g] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return n, chars, len(text) - len(text.translate(None, _SYMBOLS)), sum(_lines(text)[1]), repeat


def fit_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf:
    """The field, from at most FIT_DOCS labelled documents (those of smallest hash) and FIT_LINES lines of each.

    Without labelled documents of both kinds, every line is content.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id is not null and label in (0, 1)").groupBy("_id").agg(F.max("label").alias("label"))
    mine = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null")
    chosen = mine.select("_id").join(marked, "_id").orderBy(F.xxhash64("_id"), "_id").limit(FIT_DOCS)
    sample = mine.join(F.broadcast(chosen), "_id")  # FIT_DOCS rows of two numbers

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["_id"], b["text"]):
                parts, again = _lines(text.encode("utf-8", "replace"))
                out.append(np.array([line_features(p, a) for p, a in zip(parts[:FIT_LINES], again)], np.float32).tobytes())
            yield pd.DataFrame({"id": b["_id"], "label": b["label"], "x": out})

    rows = sorted(tuple(r) for r in sample.mapInPandas(describe, "id long, label int, x binary").collect())[:FIT_DOCS]
    kinds = {r[1] for r in rows}
    if len(kinds) < 2:
        return Crf(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.array([0.0, 1.0]))
    x = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
    lengths = np.array([len(a) for a in x])
    y = np.repeat(np.array([r[1] for r in rows]), lengths)
    return fit(np.concatenate(x).astype(float), y, lengths, 2)


def _judge(crf: Crf, min_words: int, max_repeat: int, min_content: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                base, x, lengths, sizes = [], [], [], []
                for text in part.column("text").to_pylist():
                    raw = text.encode("utf-8", "replace")
                    base.append(base_counts(raw))
                    parts, again = _lines(raw)
                    x += [line_features(p, a) for p, a in zip(parts, again)]
                    lengths.append(len(parts))
                    sizes += [len(p.translate(None, _WHITE + _TAIL)) for p in parts]
                size = np.array(sizes, float)
                content = np.add.reduceat(viterbi(crf, np.array(x), np.array(lengths)) * size, np.cumsum(lengths) - lengths)
                whole = np.add.reduceat(size, np.cumsum(lengths) - lengths)
                share = np.divide(content, whole, out=np.zeros(len(whole)), where=whole > 0)
                n, chars, symbols, dup, repeat = (np.array(c, np.int64) for c in zip(*base))
                failed = (n < min_words) | (100 * repeat > max_repeat * n)
                yield pa.record_batch({"id": part.column("id"), "key": part.column("key"), "n_words": pa.array(n), "word_chars": pa.array(chars),
                                       "n_symbols": pa.array(symbols), "n_dup_lines": pa.array(dup), "n_repeat_words": pa.array(repeat),
                                       "base_failed": pa.array(failed), "content_share": pa.array(share), "kept": pa.array(~failed & (share >= min_content))})

    return judge


def line_quality(docs: DataFrame, crf: Crf, min_words: int = 50, max_repeat: int = 50, min_content: float = 0.5,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (see text_key), the base counts, base_failed, content_share (of non-blank characters in content lines), kept.

    A missing or empty text has no words and fails. Rows are judged one by one: repeated rows get the same verdict.
    """
    return texts(docs, id_col, text_col, key=text_key(docs[text_col])).mapInArrow(
        _judge(crf, min_words, max_repeat, min_content),
        "id long, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, content_share double, kept boolean")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep_shuffles_short(spark)
    docs = table(spark, sf_dir, "documents")
    out = line_quality(docs, fit_lines(docs, table(spark, sf_dir, "labels")))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), *out.columns[2:])
