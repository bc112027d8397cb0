"""Operators across documents against brute force on small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import decontaminate, jaccard, language_model, line_dedup, mixing, substring_dedup
from hearthline.llm.components import components
from hearthline.llm.frames import NO_ID

RNG = np.random.default_rng(4)
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "so", "é") for b in ("n", "ra", "de", "St", "ku")]


def words(n):
    return RNG.choice(VOCABULARY, n).tolist()


def frame(spark, rows):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 1, 2, "x") for i, t in rows], "doc_id long, text string, source string, id int, n int, key string")


def copies():
    """Near copies around a base, exact copies, a passage in many texts, odd rows."""
    base, passage = words(120), words(25)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[RNG.integers(len(w))] = f"x{RNG.integers(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(5)]
    rows += [(200 + i, "\n".join([" ".join(words(30)), " ".join(passage), " ".join(words(int(RNG.integers(5, 60))))])) for i in range(40)]
    rows += [(300, None), (301, ""), (302, "a b c"), (303, "A b C"), (304, " \n"), (305, "one"), (306, "long " * 5_000), (307, " ".join(base[:110])),
             (308, "a b c"), (309, "two " * 5_000), (None, " ".join(base)), (310, " ".join(passage[:12]))]
    order = RNG.permutation(len(rows))
    return [rows[i] for i in order]


ROWS = copies()


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    w = split(fold(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    ids = [NO_ID if i is None else i for i, _ in rows]
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    low = defaultdict(lambda: NO_ID)
    for i in range(len(rows)):
        low[top(i)] = min(low[top(i)], ids[i])
    return sorted((ids[i], len(sets[i]), low[top(i)]) for i in range(len(rows)))


def test_jaccard_join_loses_no_link(spark):
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, ROWS)).collect())
    assert got == brute_components(ROWS)


def test_jaccard_join_of_chains_and_crowds(spark):
    """Texts that link only through others, and a crowd with members that link to one another but not to its leader."""
    rows, w = [], words(200)
    for i in range(12):  # each shares most with the next, little with the last
        rows.append((1_000 - i, " ".join(w[i * 8:i * 8 + 100])))
    base = words(100)
    for i in range(30):
        x = list(base)
        for j in range(5):
            x[j * 20 + 3] = f"v{i // 3}_{j}"  # three of a kind, five edits off the base
        x[50] = f"own{i}"
        rows.append((2_000 + i, " ".join(x)))
    rows.append((1_999, " ".join(base)))
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("block", [7, 512])
def test_jaccard_join_counts_every_link(spark, monkeypatch, block):
    """Also those of two texts that others have joined before; crowds of several blocks, chains, copies and small components."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "WIDE", 50)
    rng, rows = np.random.default_rng(9), list(ROWS)
    for c in range(12):  # small components beside the crowd of ROWS
        base = [f"c{c}w{i}" for i in range(60)]
        for i in range(c % 5 + 2):
            x = list(base)
            x[int(rng.integers(60))] = f"e{i}"
            rows.append((5_000 + 10 * c + i, " ".join(x)))
    sets = {i: shingle_set(t) for i, t in enumerate(t for _, t in rows)}
    distinct = [s for s in set(sets.values()) if s]
    links = {s: sum(s != q and 100 * len(s & q) >= 75 * len(s | q) for q in distinct) for s in distinct}
    want = sorted((NO_ID if i is None else i, links.get(shingle_set(t), 0)) for i, t in rows)
    got = sorted((r["id"], r["n_links"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == want and max(links.values()) > 20


def test_jaccard_join_of_empty_tables(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    assert {r["component_id"] for r in jaccard.near_duplicates(frame(spark, [(1, None), (2, ""), (3, None)])).collect()} == {1, 2, 3}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substrings(rows, k=13):
    holders = defaultdict(set)
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - k + 1):
            holders[tuple(w[p:p + k])].add(NO_ID if i is None else i)
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for p in range(len(w) - k + 1):
            if min(holders[tuple(w[p:p + k])]) < (NO_ID if i is None else i):
                gone.update(range(p, p + k))
        out.append((NO_ID if i is None else i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def test_substring_dedup(spark):
    rows = ROWS + [(102, ROWS[0][1]), (102, "again " + (ROWS[1][1] or ""))]  # rows that share an id
    got = sorted(tuple(r) for r in substring_dedup.dedup_substrings(frame(spark, rows)).select("id", "n_words", "n_removed", "kept_text").collect())
    assert got == brute_substrings(rows)
    assert substring_dedup.dedup_substrings(frame(spark, [])).count() == 0


def test_automaton_matches_every_substring():
    auto = substring_dedup.Automaton()
    texts = [RNG.integers(0, 3, int(RNG.integers(1, 25))).tolist() for _ in range(12)]
    for owner, t in enumerate(texts):
        auto.add(t, owner)
    for owner in range(13):
        for k in (2, 4, 6):
            t = RNG.integers(0, 4, 60).tolist()
            has = lambda x: any(x == u[j:j + k] for u in texts[:owner] for j in range(len(u) - k + 1))
            want = {p + j for p in range(len(t) - k + 1) if has(t[p:p + k]) for j in range(k)}
            got = auto.spans(t, owner, k)
            assert {p for a, z in got for p in range(a, z)} == want and all(a < z for a, z in got)


def brute_lines(rows):
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(NO_ID if i is None else i)
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i
    out = []
    for i, t in rows:
        x, me = (t or "").split("\n"), NO_ID if i is None else i
        kept = [y for y in x if not gone(me, y)]
        out.append((i if i is not None else -1, len(x), len(x) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    shared = ["  A line that many documents SHARE\t", "a line that many documents share", "short", "", "Another long line of text, shared by three"]
    rows = ROWS + [(400 + i, "\n".join(RNG.choice(shared, int(RNG.integers(1, 8))).tolist())) for i in range(25)]
    rows += [(400, shared[0]), (401, None), (None, shared[1]), (None, shared[1])]
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert got.columns == [*frame(spark, []).columns[:3], "id", "n", "key", "n_lines", "n_dropped", "kept_text"]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def brute_hits(rows, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            v = cut(text)
            n = min(size, len(v))
            wins = {tuple(v[p:p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p:p + n]) in wins:
                    hit.update(range(p, p + n))
                    found |= {item} - {None}
        out.append((NO_ID if i is None else i, len(w), len(hit), sorted(found)))
    return sorted(out)


def test_decontamination(spark):
    long_item = words(40)
    items = [("q1", " ".join(long_item)), ("q2", "Is it so?"), ("q3", None), ("q4", " ... "), ("q5", "one"), ("q1", " ".join(long_item)), (None, "two two"), ("q6", " ".join(words(12)))]
    rows = ROWS + [(500, "x, " + ", ".join(long_item[5:17]) + " y"), (501, "is IT-so! one"), (502, " ".join(long_item[:9])), (503, items[-1][1].upper().replace("É", "é") + " " + " ".join(long_item)), (503, None)]
    got = decontaminate.contamination(frame(spark, rows), spark.createDataFrame([(*x, "y", 1) for x in items], "item_id string, text string, win string, len int"))
    assert sorted((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()) == brute_hits(rows, items)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [r["n_hit"] for r in decontaminate.contamination(frame(spark, [(1, "one")]), none).collect()] == [0]
    assert decontaminate.contamination(frame(spark, []), some).count() == 0


def brute_targets(size, weights=(1, 2, 3)):
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    free, target, left = set(names), {}, sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    return target


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * int(RNG.integers(0, 60))), RNG.choice(["a", "b", "c", "é"], p=[0.7, 0.2, 0.05, 0.05])) for i in range(400)]
    rows = [(i, t, str(s)) for i, t, s in rows] + [(900, "x y", None), (901, None, "z"), (None, "x " * 30, "b"), (5, "again", "a"), (5, "again", "a"), (902, "w " * 9_000, "c")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, id int")
    out = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(5)).collect()
    line = lambda r: (r["id"], r["key"], r["size"], r["taken"])
    assert sorted(map(line, out)) == sorted(map(line, again)) and len(out) == len(rows)
    source_of = defaultdict(set)
    for i, _, s in rows:
        source_of[NO_ID if i is None else i].add(s)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        (s,) = source_of[r["id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    assert target == pytest.approx(brute_targets(dict(size)))
    assert all(abs(taken[s] - target[s]) <= max(1, 0.02 * target[s]) for s in target)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_fit_reaches_what_can_be_reached():
    for _ in range(60):
        length = np.unique(RNG.integers(1, 12, 4))
        count = RNG.integers(1, 5, len(length))
        sums = {0}
        for n, c in zip(length.tolist(), count.tolist()):
            sums = {s + n * i for s in sums for i in range(c + 1)}
        budget = int(RNG.integers(0, int((length * count).sum()) + 3))
        take = mixing.fit(length, count, budget, 1)
        assert (take <= count).all() and (take >= 0).all()
        assert int((length * take).sum()) == max(s for s in sums if s <= budget)


def test_fit_of_large_budgets():
    length, count = np.arange(1, 3_000), RNG.integers(1, 50, 2_999)
    for part in (0.1, 0.5, 0.999):
        budget = int((length * count).sum() * part)
        take = mixing.fit(length, count, budget, 1)
        assert (take <= count).all() and int((length * take).sum()) == budget


def test_language_model(spark):
    rows = [(i, " ".join(words(int(RNG.integers(0, 60))))) for i in range(300)] + [(300, None), (301, ""), (None, "Ka ka"), (302, "z" * 20_000), (5, "ka"), (5, "ka"), (303, "a b 　 c ")]
    out = language_model.lm_scores(frame(spark, rows), language_model.read_ranks()).collect()
    assert len(out) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    train = [split(fold(t)) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()) + len(train), len(count) + 1
    want = []
    for i, t in rows:
        w = split(fold(t))
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((NO_ID if i is None else i, held(i), len(w) + 1, 1 + sum(x in count for x in w), n, round(base, 5)))
    assert sorted((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == sorted(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_language_model_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    out = language_model.lm_scores(frame(spark, [(held[0], "a b"), (held[1], None)]), language_model.read_ranks()).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert language_model.lm_scores(frame(spark, []), language_model.read_ranks()).count() == 0


def test_model_is_a_distribution():
    """The probabilities of all next subwords add up to one, and blocks see no future."""
    rng = np.random.default_rng(6)
    rows, ids_n = language_model.ROWS + language_model.GROUPS + 1, 3_000
    cls = np.arange(ids_n) % language_model.CLASSES
    weight = rng.random(ids_n)
    share = np.log10(weight / np.bincount(cls, weight)[cls])
    counts = language_model.Counts(cls, share, np.arange(ids_n) % (rows - 1), np.log(rng.dirichlet(np.ones(language_model.GROUPS), rows)),
                                   np.log(rng.dirichlet(np.ones(language_model.MEMBERS), (rows, language_model.GROUPS))))
    theta = language_model._unpack(language_model._start() + rng.normal(0, 0.2, len(language_model._start())))
    text = rng.integers(0, ids_n, 40)
    every = np.concatenate([np.append(text[:35], i) for i in range(ids_n)])
    last = language_model.score_ids(theta, counts, every, np.arange(ids_n + 1) * 36)[35::36]
    assert (10.0**last).sum() == pytest.approx(1, abs=1e-3)
    whole = language_model.score_ids(theta, counts, text, np.array([0, 40]))
    part = language_model.score_ids(theta, counts, text[:20], np.array([0, 20]))
    assert whole[:20] == pytest.approx(part, abs=1e-4)



def test_language_model_beats_its_base_on_held_out_texts(spark):
    """Per token, on the largest of the small tables: the model has learnt more than how often words occur."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    out = language_model.lm_scores(docs, language_model.read_ranks()).where("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert (out["sum(score)"] - out["sum(base_score)"]) / out["sum(n_tokens)"] > 0.1


def test_language_model_weights_do_not_depend_on_the_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = ({r["id"]: r["score"] for r in language_model.lm_scores(docs.repartition(n), language_model.read_ranks()).collect()} for n in (1, 5))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-3


def test_language_model_learns_from_every_subword(spark):
    ranks = language_model.read_ranks()
    rows = [(1, " ".join(f"word{i % 37} b{i}" for i in range(1500)), 7), (2, "", 8), (3, "one two", 9)]
    batch = pa.RecordBatch.from_pydict({"place": pa.array([r[2] for r in rows]), "text": [r[1] for r in rows]})
    code = language_model.Subwords(ranks)
    for place, text in ((r[2], r[1]) for r in rows):
        want = [*code([w.encode() for w in text.split()])[0].tolist(), code.end]
        pieces = [r for b in language_model._windows(ranks)(iter([batch])) for r in b.to_pylist() if r["place"] == place]
        pieces.sort(key=lambda r: r["nth"])
        assert [i for r in pieces for i in r["ids"][r["lead"]:]] == want
        assert all(r["ids"][:r["lead"]] == before["ids"][-r["lead"]:] for before, r in zip(pieces, pieces[1:]))


def plain_step(theta, counts, prev, target, opened):
    """Loss and gradient in double precision, window by window: prev, target are windows x 2 blocks."""
    e, wq, wk, wv, dist, ug, um = theta
    size, dim = language_model.BLOCK, language_model.DIM
    i, j = np.arange(size)[:, None], np.arange(2 * size)[None]
    distance = np.clip(i + size - j, 0, 2 * size - 1)
    x = e[prev]
    q, k, v = x[:, size:] @ wq, x @ wk, x @ wv
    s = q @ k.transpose(0, 2, 1) / np.sqrt(dim) + dist[distance]
    s[:, j - size > i] = -1e9
    s[opened, :, :size] = -1e9
    a = np.exp(s - s.max(2, keepdims=True))
    a /= a.sum(2, keepdims=True)
    h = (x[:, size:] + a @ v).reshape(-1, dim)
    t, row = target[:, size:].ravel(), prev[:, size:].ravel()
    real = t >= 0
    n, t = real.sum(), np.maximum(t, 0)
    g, m, every = t // language_model.MEMBERS, t % language_model.MEMBERS, np.arange(len(t))
    zg, zm = h @ ug + counts.group[row], np.einsum("nd,ndm->nm", h, um[g]) + counts.member[row, g]
    loss = 0.0
    for z, hit in ((zg, g), (zm, m)):
        np.exp(z - z.max(1, keepdims=True), out=z)
        z /= z.sum(1, keepdims=True)
        loss -= np.log(z[every, hit][real]).sum() / n
        z[every, hit] -= 1
        z *= real[:, None] / n
    gum = np.zeros_like(um)
    np.add.at(gum, g, h[:, :, None] * zm[:, None, :])
    gh = (zg @ ug.T + np.einsum("nm,ndm->nd", zm, um[g])).reshape(len(prev), size, dim)
    ga, gv = gh @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ gh
    gs = a * (ga - (ga * a).sum(2, keepdims=True))
    gd = np.bincount(distance.ravel(), gs.sum(0).ravel(), 2 * size)
    gs /= np.sqrt(dim)
    gq, gk = gs @ k, gs.transpose(0, 2, 1) @ q
    gx = gk @ wk.T + gv @ wv.T
    gx[:, size:] += gh + gq @ wq.T
    ge = np.zeros_like(e)
    np.add.at(ge, prev, gx)
    flat, own = x.reshape(-1, dim).T, x[:, size:].reshape(-1, dim).T
    return loss, np.concatenate([p.ravel() for p in (ge, own @ gq.reshape(-1, dim), flat @ gk.reshape(-1, dim), flat @ gv.reshape(-1, dim), gd, h.T @ zg, gum)])


def test_training_step_is_the_plain_gradient():
    rng = np.random.default_rng(8)
    size, rows = language_model.BLOCK, language_model.ROWS + language_model.GROUPS + 1
    ids_n = 3_000
    counts = language_model.Counts(rng.integers(0, language_model.CLASSES, ids_n), np.zeros(ids_n), np.arange(ids_n) % (rows - 1),
                                   np.log(rng.dirichlet(np.ones(language_model.GROUPS), rows)).astype(np.float32),
                                   np.log(rng.dirichlet(np.ones(language_model.MEMBERS), (rows, language_model.GROUPS))).astype(np.float32))
    theta = language_model._unpack(language_model._start() + rng.normal(0, 0.2, len(language_model._start())))
    n = np.concatenate([[1, size, size + 1, 5 * size - 3], rng.integers(1, 40 * size, 24)])
    lead = np.where((np.arange(len(n)) % 2 == 1) & (n > size), size, 0)
    first, ids = np.concatenate(([0], np.cumsum(n))), rng.integers(0, ids_n, n.sum())
    blocks = language_model._blocks(counts, ids, first, lead)
    own = np.flatnonzero(blocks.classes[:, 0] >= 0)
    prev, target, opened = [], [], []
    for x, y, skip in zip(first[:-1], first[1:], lead):  # the same windows, one by one
        before = np.concatenate([[rows - 1], counts.row_of[ids[x:y - 1]]])
        for at in range(skip, y - x, size):
            p, t = np.full(2 * size, rows - 1), np.full(2 * size, -1)
            begin, end = max(0, at - size), min(y - x, at + size)
            p[begin - at + size:end - at + size], t[begin - at + size:end - at + size] = before[begin:end], counts.class_of[ids[x + begin:x + end]]
            prev.append(p), target.append(t), opened.append(at == 0)
    prev, target, opened = np.array(prev), np.array(target), np.array(opened)
    assert len(own) == len(prev)
    plain, got = plain_step(theta, counts, prev, target, opened), language_model.train_step(theta, counts, blocks)
    assert got[0] == pytest.approx(plain[0], rel=1e-5)
    assert np.abs(got[1] - plain[1]).max() < 1e-5 * np.abs(plain[1]).max()
