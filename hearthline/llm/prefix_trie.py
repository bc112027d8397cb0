"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours, partition by partition.

A conversation is the sequence of its turns' digests. Distinct sequences are sorted into ranges. Within a range the edges between sorted
neighbours, weighted by the length of their common prefix, are taken in descending order; every merge of two components is a
branching node, and the unary nodes lie on the edges of that forest. Nodes that reach over a range's border are the prefixes that its
first or last sequence shares with the neighbouring range: of each range only these are left when its forest is contracted. All figures of a
node add up over the ranges that hold it, so the contracted forests are merged by grouping on the prefix's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthline.llm.frames import keep_shuffles_short, stored, table
from hearthline.plans.catalog import query

#: Bytes of a turn's digest; bytes of sequences that one range is meant to hold; digits and commas of ids that one row holds.
DIGEST, RANGE_BYTES, LIST_CHARS = 16, 32 << 20, 1 << 20


def turns_in_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turns: the turns of every conversation as (digest, bytes of the text), by turn number, missing numbers first.

    Turns of one number are ordered by the digest of role and text; equal ones are separate turns. A missing role or text is empty. Rows
    without a conversation belong to none and are left out; other columns are not read. Texts become digests before the shuffle,
    but one conversation is one row, at about 40 bytes a turn.
    """
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.struct(
        F.col(turn).isNotNull().alias("numbered"), F.col(turn).cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)).alias("digest"), F.octet_length(t).alias("bytes")).alias("turn"))
    listed = rows.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("turns"))


def shared_starts(listed: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt on a common start: the first h turns of conversation c - c % group, then c's own turns after its first h.

    h is the CRC-32 of c in decimal, modulo ``most``. A conversation that is absent gives no start; one with fewer turns gives all.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("int")
    base = listed.select(F.col("conv").alias("_base"), F.slice("turns", 1, most).alias("_start"))
    own = listed.withColumn("_base", F.col("conv") - F.col("conv") % group).withColumn("_h", h)
    none = F.array().cast(listed.schema["turns"].dataType)
    start = F.coalesce(F.slice("_start", 1, F.col("_h")), none)
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("_h")))
    return own.join(base, "_base", "left").select("conv", F.concat(start, rest).alias("turns"))


def _digests(pairs: DataFrame) -> DataFrame:
    """seq, ends_sha256: the SHA-256 of every sequence's conversations in ascending order, joined by commas.

    Sorting is spread over ranges of (seq, conv), so a sequence of very many copies is sorted by many tasks; what is left for one task is
    to hash its list, row by row.
    """
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, part, size = None, 0, [], 0
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != seq or size >= LIST_CHARS:
                    if part:
                        yield pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.binary()), "first": [first], "convs": [",".join(part)]})
                    seq, first, part, size = s, c, [], 0
                part.append(str(c))
                size += len(part[-1]) + 1
        if part:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.binary()), "first": [first], "convs": [",".join(part)]})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state, done = None, None, []
        for b in batches:
            for s, text in zip(b.column(0).to_pylist(), b.column(1)):
                if s != seq:
                    if state is not None:
                        done.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["seq", "ends_sha256"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([state.hexdigest()])], ["seq", "ends_sha256"])

    sorted_ = pairs.repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv")
    chunks = sorted_.select("seq", "conv").mapInArrow(lists, "seq binary, first long, convs string")
    return chunks.repartition("seq").sortWithinPartitions("seq", "first").select("seq", "convs").mapInArrow(hashes, "seq binary, ends_sha256 string")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at which two sequences of digests begin alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


def merge_neighbours(lengths: np.ndarray, common: np.ndarray, convs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The branching forest of sorted distinct sequences: first and last sequence, depth, parent (-1: none), children and smallest conversation
    of every node; the first nodes are the sequences themselves.

    ``common[i]`` is the common prefix of sequences i and i + 1. Edges are taken by descending common prefix, from the left among equals: a
    union of two components makes a node at that depth, unless the left one's top lies there already. The right one's never does, for
    of two neighbours only the first can be a prefix of the other.
    """
    m = len(lengths)
    up, top = list(range(m)), list(range(m))  # union-find; the top node of the component with this root
    first, last, depth, parent, children, least = list(range(m)), list(range(m)), lengths.tolist(), [-1] * m, [0] * m, convs.tolist()

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for e in np.argsort(-common, kind="stable").tolist():
        d, a, b = int(common[e]), find(e), find(e + 1)
        x, y = top[a], top[b]
        if depth[x] > d:
            node = len(depth)
            for column, value in ((first, first[x]), (last, last[x]), (depth, d), (parent, -1), (children, 1), (least, least[x])):
                column.append(value)
            parent[x] = node
        else:
            node = x
        parent[y] = node
        last[node] = last[y]
        children[node] += 1
        least[node] = min(least[node], least[y])
        # The longer component's root stays.
        a, b = (a, b) if last[x] - first[x] >= last[y] - first[y] else (b, a)
        up[b] = a
        top[a] = node
    return tuple(np.array(x, np.int64) for x in (first, last, depth, parent, children, least))


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "shared boolean, node binary, parent binary")


def range_nodes(keys: list[bytes], sizes: list[np.ndarray], convs: np.ndarray, counts: np.ndarray, ends: list[str], left: int, right: int) -> pa.Table:
    """The trie nodes of one range of sorted sequences, with the columns of NODE.

    ``sizes`` are the texts' bytes by turn, ``ends`` what nodes get where a sequence ends; ``left`` and ``right`` are the common prefixes with the
    neighbouring ranges, -1 at the ends. Prefixes up to these and the root are shared: their rows hold this range's part of each figure and the
    digests of their own and their parent's prefix. All other rows are whole and have a parent's digest if that one is shared.
    """
    m = len(keys)
    lengths = np.array([len(k) // DIGEST for k in keys], np.int64)
    common = np.array([left, *(common_turns(a, b) for a, b in zip(keys, keys[1:])), right], np.int64)
    first, last, depth, parent, children, least = merge_neighbours(lengths, common[1:m], convs)
    at = np.cumsum([0, *lengths + 1])
    before = np.concatenate([np.concatenate([[0], np.cumsum(s, dtype=np.int64)]) for s in sizes])  # before[at[i] + k]: bytes of i's first k turns
    total = before[at[1:] - 1]
    new = total - before[at[:-1] + np.maximum(common[:m], 0)]  # of turns that the sequence before doesn't share
    to = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    n_to, bytes_to, new_to, leaves_to = to(counts), to(counts * total), to(new), to(common[1:] < lengths)

    # One row for each depth of a node's edge to its parent; the last of them is the node.
    above = np.where(parent >= 0, depth[parent], -1)
    tall = depth - above
    node = np.repeat(np.arange(len(first)), tall)
    d = above[node] + 1 + np.arange(len(node)) - np.repeat(np.cumsum(tall) - tall, tall)
    a, z, bottom = first[node], last[node] + 1, d == depth[node]

    def is_shared(a: np.ndarray, z: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (a == 0) & (d <= left) | (z == m) & (d <= right) | (d == 0)

    # Bytes saved: those of all sequences from this depth on, less one copy of each distinct turn that no earlier range has counted.
    n, high = n_to[z] - n_to[a], np.maximum(d - 1, 0)
    begun = (a == 0) & (d <= left)
    distinct = total[a] - before[at[a] + np.where(begun, max(left, 0), high)] + new_to[z] - new_to[a + 1]
    saved = bytes_to[z] - bytes_to[a] - n * before[at[a] + high] - distinct
    kids = np.where(bottom, children[node], 1) - ((a == 0) & (left > d))
    kept = [ends[i] if e else None for i, e in zip(a.tolist(), (bottom & (lengths[a] == d)).tolist())]
    # The parent is the row above on the same edge, or the node that the edge hangs on.
    on = np.where((d == above[node] + 1) & (parent[node] >= 0), parent[node], node)
    shared, parent_shared = is_shared(a, z, d), is_shared(first[on], last[on] + 1, d - 1) & (d > 0)

    digests: dict[tuple[bool, int], bytes] = {}
    for side, i, most in ((True, 0, left), (False, m - 1, right)):
        state = hashlib.md5()
        for k in range(max(most, 0) + 1):
            digests[side, k] = state.digest()
            state.update(keys[i][k * DIGEST:(k + 1) * DIGEST])

    def names(which: np.ndarray, a: np.ndarray, d: np.ndarray) -> pa.Array:
        out: list[bytes | None] = [None] * len(which)
        for i in np.flatnonzero(which).tolist():
            out[i] = digests[bool(a[i] == 0 and d[i] <= left), int(d[i])]
        return pa.array(out, pa.binary())

    return pa.table({
        "conv_id": least[node], "depth": d, "parent_conv_id": pa.array(least[on], mask=parent_shared | (d == 0)), "n_convs": n, "n_children": kids,
        "n_leaves": leaves_to[z] - leaves_to[a], "saved_tokens": saved, "ends_sha256": pa.array(kept, pa.string()), "shared": shared,
        "node": names(shared, a, d), "parent": names(parent_shared, first[on], d - 1)})


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """Every distinct start of the conversations ``rebuilt`` (conv, turns of (digest, bytes)), one row per node.

    conv_id (its smallest conversation), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256: see
    op13_prefix_trie. A conversation without turns ends at the root. No conversation gives no node. Equal sequences are merged before anything
    is sorted; ranges are of sequences, so a turn or start that very many conversations share is spread over many of them.
    """
    spark = rebuilt.sparkSession
    keep_shuffles_short(spark)
    key = F.unhex(F.array_join("turns.digest", ""))
    convs = stored(rebuilt.select("conv", key.alias("key"), F.col("turns.bytes").alias("sizes")).withColumn("seq", F.unhex(F.md5("key"))), "conversations")
    merged = convs.groupBy("seq").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("key").alias("key"), F.first("sizes").alias("sizes"))
    listed = merged.join(_digests(convs.select("seq", "conv")), "seq").drop("seq")
    size = convs.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    ranges = stored(listed.repartitionByRange(n_ranges, "key").withColumn("range", F.spark_partition_id()), "ranges")
    # Common prefixes with the neighbouring ranges, from the smallest and largest sequence of each.
    borders = ranges.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    by_range = Window.partitionBy().orderBy("range")

    def borders_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pydict({
                "range": [r["range"] for r in rows],
                "left": pa.array([-1 if r["before"] is None else common_turns(r["before"], r["low"]) for r in rows], pa.int32()),
                "right": pa.array([-1 if r["after"] is None else common_turns(r["high"], r["after"]) for r in rows], pa.int32())}, schema=pa.schema(
                    [("range", pa.int32()), ("left", pa.int32()), ("right", pa.int32())]))

    near = borders.select("range", "low", "high", F.lag("high").over(by_range).alias("before"), F.lead("low").over(by_range).alias("after"))
    near = stored(near.mapInArrow(borders_common, "range int, left int, right int"), "borders")

    def forest(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        sizes = rows["sizes"].combine_chunks()
        values, cuts = sizes.values.to_numpy(zero_copy_only=False), sizes.offsets.to_numpy()
        column = lambda c: rows[c].to_numpy()
        return range_nodes(rows["key"].to_pylist(), [values[x:y] for x, y in zip(cuts[:-1], cuts[1:])], column("conv"), column("n"),
                           rows["ends_sha256"].to_pylist(), rows["left"][0].as_py(), rows["right"][0].as_py())

    nodes = stored(ranges.join(near, "range").groupBy("range").applyInArrow(forest, NODE), "nodes")
    added = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    shared = nodes.where("shared").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in added),
        F.max("ends_sha256").alias("ends_sha256"))
    shared = stored(shared, "shared-nodes")
    parents = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv"))
    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent")
    whole = nodes.where("not shared").select(*columns, "parent_conv_id").unionByName(shared.select(*columns, F.lit(None).cast("long").alias("parent_conv_id")))
    none = F.lit(hashlib.sha256().hexdigest())
    return whole.join(parents, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_parent_conv").alias("parent_conv_id"), *added, F.coalesce("ends_sha256", none).alias("ends_sha256"))


# CRC-32 of a number's digits: eight shifts for each byte.
_CRC = """xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

SQL = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
         md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (SELECT c, {_CRC.format(c="c")} % 9 AS h FROM (SELECT DISTINCT c FROM own)
), parts AS (
  SELECT heads.c, 0 AS p, own.i, own.k, own.b FROM heads JOIN own ON own.c = heads.c - heads.c % 5 AND own.i <= h
  UNION ALL SELECT heads.c, 1, own.i, own.k, own.b FROM heads JOIN own ON own.c = heads.c AND own.i > h
), turns AS (SELECT c, k, b, row_number() OVER (PARTITION BY c ORDER BY p, i) AS d FROM parts
), starts AS (
  SELECT c, d, b, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS node FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM heads
), nodes AS (SELECT node, d, min(c) AS conv_id, count(*) AS n, max(b) AS b FROM starts GROUP BY node, d
), links AS (SELECT node, left(node, CAST(32 * (d - 1) AS BIGINT)) AS parent FROM nodes WHERE d > 0
), kids AS (SELECT parent AS node, count(*) AS n FROM links GROUP BY parent
), below AS (
  SELECT s.node, count(*) FILTER (WHERE k.node IS NULL) AS leaves, sum((u.n - 1) * u.b) AS saved
  FROM nodes u JOIN starts s ON s.c = u.conv_id AND s.d <= u.d LEFT JOIN kids k ON k.node = u.node GROUP BY s.node
), ends AS (
  SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max_by(node, d) AS node FROM starts GROUP BY c) GROUP BY node
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children,
       below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN links l USING (node) LEFT JOIN nodes p ON p.node = l.parent LEFT JOIN kids k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node
"""


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared_starts(turns_in_order(table(spark, sf_dir, "conversations"))))
