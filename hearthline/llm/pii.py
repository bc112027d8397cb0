"""Personal data: fixed patterns, and a conditional random field over word shapes for what they miss.

The field is fitted on a small labelled table that is built by rule below: sentences with addresses and numbers in spellings
that the patterns don't take, and with numbers that are no personal data.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.crf import Crf, fit, viterbi
from hearthline.llm.frames import NO_ID, keep_shuffles_short, table, text_key, texts
from hearthline.plans.catalog import query

# Fixed patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# An address lies within a run of its own characters; only runs around an @ are searched.
_ADDRESS = re.compile(r"[A-Za-z0-9._%+@-]+")
_DIGIT = re.compile(r"[0-9]")
_NOT_ADDRESS = re.compile(r"[^A-Za-z0-9._%+@-]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word with one of these is looked at, with WINDOW words on both sides; the field can't mark words further away.
CUE = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]", re.I)
WINDOW = 4


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and _ADDRESS.match(text, begin - 1, begin):
            begin -= 1
        stop = _NOT_ADDRESS.search(text, at)
        end = stop.start() if stop else len(text)
        for m in EMAIL.finditer(text, begin, end):
            yield m.span()
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


_CUES = [{"at", "(at)", "[at]", "{at}"}, {"dot", "(dot)", "[dot]", "{dot}"}, {"tel", "phone", "call", "fax", "mobile", "cell", "telephone", "dial"},
         {"email", "mail", "e-mail", "contact", "write"}, {"card", "visa", "credit"}, {"ip", "host", "address", "server"},
         {"version", "section", "page", "token", "order", "id", "no", "number", "year", "price", "chapter", "line"}]
_SHAPES = [re.compile(p, re.I) for p in (
    r"[^0-9]*\d{3}-\d{4}\W*", r"\W*\(\d{3}\)\W*", r"\W*(?:\(?\d{3}\)?[.-])\d{3}[.-]\d{4}\W*", r"\W*\d{3}\W*", r"\W*\d{4}\W*", r"\W*\d+\W*", r"[^0-9@]*",
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\W*", r"[\w.+-]+[(\[{](?:at|@)[)\]}][\w.-]+.*", r".*[(\[{]dot[)\]}]\w+\W*", r"[a-z][\w-]*\.(?:[a-z][\w-]*\.)*(?:com|org|net|edu|io|info)\W*", r"(?:com|org|net|edu|io|info)\W*", r"\W*\d+(?:\.\d+)+\W*",
    r"\W*\d{1,3}(?:[.,:]\d{1,3})?\W*", r".*[a-z].*\d.*|.*\d.*[a-z].*", r"[a-z][\w.-]*", r"\+\d{1,3}\W*", r"\W*\d{14,19}\W*", r".*[.!?;:]\W*", r"\W*\d{4}-\d\d?-\d\d?\W*")]


def shape(word: str) -> list[float]:
    """What a word looks like, without what it says; words of no cue list, digit or sign look alike."""
    bare = word.lower().strip(".,;:!?\"'")
    return [float(p.fullmatch(word) is not None) for p in _SHAPES] + [float(bare in c) for c in _CUES]


N_SHAPES = len(_SHAPES) + len(_CUES)


def features(shapes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each word's shape with those of two words on both sides of its sequence, and a constant."""
    n = len(shapes)
    seq = np.repeat(np.arange(len(lengths)), lengths)
    cols = [np.ones((n, 1), np.float32)]
    for d in (-2, -1, 0, 1, 2):
        at = np.arange(n) + d
        ok = (at >= 0) & (at < n)
        ok[ok] = seq[at[ok]] == seq[ok]
        cols.append(np.where(ok[:, None], shapes[np.where(ok, at, 0)], 0))
    return np.concatenate(cols, 1)


def labelled_table() -> list[list[tuple[str, int]]]:
    """Sentences as (word, label); labels are 0 for none, else 1 + the place in KINDS."""
    names, hosts, tops = ("ann", "b.lee", "kim", "j-doe", "rosa"), ("mail", "example", "web-host", "corp"), ("com", "org", "net")
    fill = ["then the list was sent".split(), "so we met again,".split(), "und der das mit ihm.".split(), "que la casa de los".split(), "les mots de la page.".split()]
    digits = "".join(str(i * 7 % 10) for i in range(400))

    def number(i: int, form: str) -> str:
        d = iter(digits[i * 3 % 300:])
        return "".join(next(d) if c == "9" else c for c in form)

    marked: list[list[tuple[str, int]]] = []
    for i in range(12):
        n, h, t = names[i % 5], hosts[i % 4], tops[i % 3]
        for form in (f"{n} (at) {h} (dot) {t}", f"{n} [at] {h}.{t}", f"{n}(at){h}.{t}", f"{n}[at]{h}[dot]{t}", f"{n} at {h} [dot] {t}", f"{n}@{h}.{t}"):
            marked.append([(w, 1) for w in form.split()])
        for form in ("(999) 999-9999", "999-999-9999", "999.999.9999", "(999) 999 9999", "+9 (999) 999-9999", "(999)999-9999"):
            marked.append([(w, 4) for w in number(i, form).split()])
        marked.append([(number(i, "199.99.9.99"), 2)])
        for form in ("version 9.9", "section 9.9.9", "page 99", "in 1999", "order 9999999", "999 items", "2021-09-09", "token = \"9a9f99bc99de9\"", "9,999 times",
                     "no 99999999999", "at 9:99", "99 99", "999-9999 9", "9999999999999999", "the dot on the i", "at home", "see example.com today", "99.9 %"):
            marked.append([(w, 0) for w in number(i, form).split()])
    out = []
    for i, m in enumerate(marked):
        before, after = fill[i % len(fill)], fill[(i // len(fill) + 1) % len(fill)]
        cue = {1: ["email"], 4: ["call"]}.get(m[0][1], ["address"]) if i % 3 == 0 and m[0][1] else []
        if i % 4 == 1:  # at the end of a sentence
            m = [*m[:-1], (m[-1][0] + ".", m[-1][1])]
        out.append([(w, 0) for w in [*before, *cue]] + m + [(w, 0) for w in after])
    return out


def fit_shapes() -> Crf:
    rows = labelled_table()
    lengths = np.array([len(r) for r in rows])
    x = np.array([shape(w) for r in rows for w, _ in r], np.float32)
    y = np.array([k for r in rows for _, k in r])
    return fit(features(x, lengths), y, lengths, 1 + len(KINDS), rounds=200)


_TRIM_LEFT, _TRIM_RIGHT = "\"'<#*$%&|,;:!?", "\"'>#*$%&|,;:!?."


def more_spans(crf: Crf, docs: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) that the field marks in each text."""
    seqs: list[tuple[int, list[tuple[int, int]]]] = []
    known: dict[str, list[float]] = {}
    for d, text in enumerate(docs):
        if not CUE.search(text):
            continue
        words = [m.span() for m in WORD.finditer(text)]
        near = np.zeros(len(words) + 1, int)
        for i, (s, e) in enumerate(words):
            if CUE.search(text, s, e):
                near[max(0, i - WINDOW)] += 1
                near[min(len(words), i + WINDOW + 1)] -= 1
        on = np.concatenate(([False], np.cumsum(near[:-1]) > 0, [False]))
        edge = np.flatnonzero(on[1:] != on[:-1])
        seqs += [(d, words[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    # A bounded number of words at a time; the shape of a repeated word is taken from a small table.
    group, size = [], 0
    for k, seq in enumerate(seqs):
        group.append(seq)
        size += len(seq[1])
        if size < 1 << 15 and k + 1 < len(seqs):
            continue
        shapes = []
        for d, words in group:
            for s, e in words:
                w = docs[d][s:e]
                if w not in known:
                    if len(known) > 1 << 15:
                        known.clear()
                    known[w] = shape(w)
                shapes.append(known[w])
        lengths = np.array([len(w) for _, w in group])
        labels = viterbi(crf, features(np.array(shapes, np.float32), lengths), lengths)
        at = 0
        for d, words in group:
            got = labels[at:at + len(words)]
            at += len(words)
            for kind, run in itertools.groupby(range(len(words)), key=lambda i: int(got[i])):
                if kind:
                    r = list(run)
                    s, e = words[r[0]][0], words[r[-1]][1]
                    s += len(docs[d][s:e]) - len(docs[d][s:e].lstrip(_TRIM_LEFT))
                    e -= len(docs[d][s:e]) - len(docs[d][s:e].rstrip(_TRIM_RIGHT))
                    if e > s:
                        out[d].append((s, e, kind - 1))
        group, size = [], 0
    return out


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _finder(crf: Crf):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                docs = part.column("text").to_pylist()
                base = [base_spans(t) for t in docs]
                every = []
                for mine, extra in zip(base, more_spans(crf, docs)):
                    fresh = [x for x in extra if not any(x[0] < e and s < x[1] for s, e, _ in mine)] if extra else []
                    every.append(sorted(mine + fresh, key=lambda s: (s[0], s[2])))
                cols = {f"n_{k}": pa.array([sum(x[2] == i for x in m) for m in base], pa.int64()) for i, k in enumerate(KINDS)}
                yield pa.record_batch({"id": part.column("id"), "key": part.column("key"), **cols,
                                       "base_spans": pa.array(map(_text, base), pa.string(), size=len(base)),
                                       "spans": pa.array(map(_text, every), pa.string(), size=len(every))})

    return find


def personal_data(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (see text_key), n_email, n_ip, n_card, n_phone (base spans), base_spans, spans per row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. Spans of the field that touch a base span are
    dropped. A missing or empty text has no spans; rows are read one by one, so repeated rows get the same spans.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts(docs, id_col, text_col, key=text_key(docs[text_col])).mapInArrow(
        _finder(crf), f"id long, key long, {counts}, base_spans string, spans string")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep_shuffles_short(spark)
    out = personal_data(table(spark, sf_dir, "documents"), fit_shapes())
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), *(f"n_{k}" for k in KINDS),
                      F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
