"""The prefix trie against a brute-force trie."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hearthline.llm import prefix_trie


def digest(role, text):
    role = role or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text or ''}".encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), len((text or "").encode())))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def brute(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids, out = defaultdict(list), []
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in kids[node]) or 1
        saved = sum(totals[k][1] for k in kids[node]) + ((len(members[node]) - 1) * node[-1][1] if node else 0)
        totals[node] = leaves, saved
        ends = sorted(c for c in members[node] if len(conversations[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "conv_id long, turn long, role string, text string, n int, node string, key binary")
    trie = prefix_trie.prefix_trie(prefix_trie.shared_starts(prefix_trie.turns_in_order(df)))
    return sorted((tuple(r) for r in trie.collect()), key=lambda r: (r[1], r[0]))


def chats(seed, n):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        for t in range(int(rng.integers(1, 14))):
            # Few choices for early turns, so that starts are shared far and wide.
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {'é' * (t % 4)} {rng.integers(1, 2 + t // 2)}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = chats(seed, 150)
    assert run(spark, rows) == brute(rebuilt(rows))


@pytest.mark.parametrize("ranges", ["1", "3", "40"])
def test_any_number_of_ranges(spark, ranges):
    """Copies of one conversation by a third of all, ends inside others' starts, borders anywhere."""
    rows = chats(9, 80)
    base = [("user", "hello"), ("assistant", "hi"), ("user", "more"), ("assistant", None)]
    rows += [(5 * c, t, *base[t]) for c in range(100, 160) for t in range(4)]
    rows += [(1000 + 5 * c, t, *base[t]) for c in range(5) for t in range(c)]
    rows += [(2000, t, "user", "again") for t in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        assert run(spark, rows) == brute(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, "b"), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "", ""), (7, 0, None, None),
            (8, 3, "user", "z"), (8, 1, "user", "long " * 50_000), (5, 0, "a", "bc"), (6, 0, "ab", "c"), (10, 0, "a", "bc"), (15, 0, "ab", "c")]
    assert run(spark, rows) == brute(rebuilt(rows))
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "lost")]) == []


def test_conversations_without_turns_end_at_the_root(spark):
    # A conversation whose start is absent and all of whose own turns fall under it.
    lone = next(c for c in range(1, 5_000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    assert run(spark, [(lone, 0, "user", "x")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_long_lists_of_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_CHARS", 40)
    rows = [(5 * c, 0, "user", "same") for c in range(300)] + [(5 * c, 0, "user", "other") for c in range(300, 310)]
    assert run(spark, rows) == brute(rebuilt(rows))
