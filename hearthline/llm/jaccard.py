"""N-gram Jaccard join by vertical partitioning.

The shingles of all documents that can have a partner are put into one global order, rarest first, and that order is cut into
fragments. Candidate pairs count their common shingles in each fragment separately; the partial counts are summed per pair.

Exact throughout: documents with equal sets are one class; a class can only have a partner if enough of its smallest
hashes occur in other classes; a pair that reaches the threshold shares one of the rarest shingles of both. Classes under one
such shingle are first compared with one leader only, then across the components that arose, so that a large group of near copies costs
a number of comparisons in proportion to its size, not to its square. Links inside the components are then counted one by one, by blocks of classes:
their number is quadratic in a crowd, so blocks bound the memory of a task and spread the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.llm.components import components
from hearthline.llm.frames import NO_ID, keep_shuffles_short, merged, stored, table, text_key, texts
from hearthline.llm.words import FOLDED, Hasher, Words, chunks, mix, shingles
from hearthline.plans.catalog import query

FRAGMENTS = 6
#: Rounds in which a shingle's holders meet one leader; whatever is still apart then meets all that the bounds allow.
LEADERS = 2
#: Classes and shingles of a block whose links are counted together; columns of one product.
BLOCK, BLOCK_GRAMS, WIDE = 512, 1 << 19, 1 << 12


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    hasher = Hasher()
    for _, off, data in chunks(column):
        w = Words(off, data, FOLDED)
        h, n = hasher(w), w.counts()
        g, _ = shingles(h, w.first, k)
        short = {j: shingles(h, w.first, j)[0] for j in np.unique(n[(n > 0) & (n < k)]).tolist()}
        for s, c in zip(w.first[:-1].tolist(), n.tolist()):
            yield np.unique(g[s:s + c - k + 1]) if c >= k else short[c][s:s + 1] if c else g[:0]


def _longs(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(rows) if rows else np.empty(0, np.uint64)).view(np.int64)))


def _describe(k: int, percent: int):
    """Set size, two hashes of the set and its smallest hashes."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                sets = list(_sets(part.column("text"), k))
                one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                two = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                size = np.array([len(s) for s in sets], np.int64)
                lead = [s[:len(s) - -(-percent * len(s) // 100) + 1 + len(s) // 16] for s in sets]
                yield pa.record_batch({"id": part.column("id"), "key": part.column("key"), "n": pa.array(size), "c1": pa.array(one), "c2": pa.array(two),
                                       "lead": _longs(lead)})

    return describe


def _all_hashes(k: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                yield pa.record_batch({"cid": part.column("cid"), "n": part.column("n"), "grams": _longs(list(_sets(part.column("text"), k)))})

    return hashes


def _least_common(n: Column, percent: int) -> Column:
    """Common shingles that a set of n needs at least with any partner."""
    return F.ceil(F.lit(percent) * n / 100).cast("long")


def _may_link(percent: int) -> Column:
    """Bounds on a pair from the sizes (n), the sizes without shingles of one class only (s) and the places of a common shingle (pos)."""
    need = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / (100 + percent))
    return ((100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (F.least("a.s", "b.s") >= need)
            & (F.least("a.pos", "b.pos") + 1 + F.least(F.col("a.s") - F.col("a.pos"), F.col("b.s") - F.col("b.pos")) - 1 >= need))


def _first_common(percent: int) -> Column:
    """Bound for the first common shingle of a pair: nothing before it is common, so all common ones lie at or after it in both."""
    need = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / (100 + percent))
    return F.least(F.col("a.s") - F.col("a.pos"), F.col("b.s") - F.col("b.pos")) >= need


def _through_leader(percent: int) -> Column:
    """Bound from the overlaps o of both with the leader of their shingle: common shingles lie in both overlaps, or outside of them."""
    need = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / (100 + percent))
    most = F.least("a.o", "b.o") + F.least(F.col("a.s") - F.col("a.o"), F.col("b.s") - F.col("b.o"))
    return F.coalesce(most >= need, F.lit(True))


def _pair_links(rows: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Links of every row with the rows of the other side (``left`` with ``right``), or among all if both sides are the same."""
    values, column, held = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = held > 1
    number, row = np.cumsum(shared) - 1, np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(shared.sum()), WIDE):
        x, y = np.searchsorted(column, (at, at + WIDE))
        holds = np.zeros((len(rows), min(WIDE, int(shared.sum()) - at)), np.float32)
        holds[row[x:y], column[x:y] - at] = 1
        overlap += (holds[left] @ holds[right].T).astype(np.int64)
    link = (100 * overlap >= percent * (n[left][:, None] + n[right][None] - overlap)) & (left[:, None] != right[None])
    out = np.zeros(len(rows), np.int64)
    out[left] = link.sum(1)
    if not np.array_equal(left, right):
        out[right] = link.sum(0)
    return out


def _count_links(percent: int):
    """(cid, n_links) of a group: of whole components (i = -1), of one block (i = j) or of two blocks of a component."""

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("comp")
        cid, comp, n, block, i, j = (group[c].to_numpy() for c in ("cid", "comp", "n", "block", "i", "j"))
        grams = group["grams"].combine_chunks()
        values, ends = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
        rows, out = [values[a:b] for a, b in zip(ends[:-1], ends[1:])], np.zeros(len(cid), np.int64)
        first = np.flatnonzero(np.concatenate(([True], comp[1:] != comp[:-1])))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(comp)]):
            every = np.arange(b - a)
            left, right = (every, every) if i[a] == j[a] else (every[block[a:b] == i[a]], every[block[a:b] == j[a]])
            if len(left) and len(right):
                out[a:b] = _pair_links(rows[a:b], n[a:b], left, right, percent)
        return pa.table({"cid": pa.array(cid), "n_links": pa.array(out)})

    return count


def _links_of(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(cid, n_links): to how many other classes each class of a component (cid, comp) links; ``sets`` has cid, n, s and grams (df, h).

    A pair is compared in one group: small components are packed whole, and larger ones are dealt over blocks by hash, so that a group
    holds about two blocks at most. Work and rows shuffled are quadratic in a component, the latter divided by the block.
    """
    member = sets.select("cid", "n", "s", F.col("grams.h").alias("grams")).join(merged(comp), "cid")
    size = stored(comp.join(merged(sets.select("cid", "s")), "cid").groupBy("comp").agg(F.count("*").alias("m"), F.sum("s").alias("total")).select(
        "comp", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("int").alias("blocks"), "m", "total"), "component-sizes")
    small = size.where("blocks = 1").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    packs = max(1, -(-small["m"] // (16 * BLOCK)), -(-small["total"] // BLOCK_GRAMS))
    dealt = member.join(merged(size.select("comp", "blocks")), "comp").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    whole = dealt.where("blocks = 1").withColumns({"pack": F.pmod(F.xxhash64("comp"), F.lit(packs)), "i": F.lit(-1), "j": F.lit(-1)})
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    split = dealt.where("blocks > 1").withColumn("with", F.explode(others)).withColumns({"pack": F.col("comp"), "i": F.col("with.i"), "j": F.col("with.j")}).drop("with")
    groups = whole.unionByName(split).select("pack", "i", "j", "comp", "cid", "n", "block", "grams")
    return groups.groupBy("pack", "i", "j").applyInArrow(_count_links(percent), "cid long, n_links long").groupBy("cid").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (see text_key), n_shingles, class_id, n_links (links of its class to other classes), component_id and group (a number of the
    component; null without words) per row.

    Two documents link when their common shingles are at least ``percent`` % of all their shingles. component_id is the smallest id
    that links lead to. Documents without words link with nothing, not with one another. Equal rows are in one class; a missing id
    counts as the largest. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    keep_shuffles_short(spark)
    described = texts(docs, id_col, text_col, key=text_key(docs[text_col])).mapInArrow(
        _describe(k, percent), "id long, key long, n long, c1 long, c2 long, lead array<long>")
    sets = stored(described.select("id", "key", "n", "c1", "c2"), "sets")
    # One class per set, numbered as it is written.
    classes = stored(described.where("n > 0").groupBy("n", "c1", "c2").agg(F.min(F.struct("id", "key")).alias("of"), F.first("lead").alias("lead"))
                     .select(F.monotonically_increasing_id().alias("cid"), "n", "c1", "c2", "of.id", "of.key", "lead"), "classes")
    # Classes of which enough of the smallest hashes occur elsewhere; all others are done.
    leads = classes.select("cid", "n", F.explode("lead").alias("h"))
    common = stored(leads.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h"), "common")
    suspects = stored(leads.join(merged(common), "h", "left_semi").groupBy("cid", "n").agg(F.count("*").alias("hits"))
                      .where(F.col("hits") > F.floor(_least_common(F.col("n"), percent) / 16)).select("cid"), "suspects")
    whose = classes.join(merged(suspects), "cid", "left_semi").select("cid", "n", "id", "key")
    text_of = (texts(docs, id_col, text_col).join(merged(whose), "id").where(text_key(F.col("text")) == F.col("key"))
               .groupBy("id", "cid", "n").agg(F.first("text").alias("text")))
    grams = stored(text_of.select("cid", "n", "text").mapInArrow(_all_hashes(k), "cid long, n long, grams array<long>"), "grams")
    # The global order: by the number of classes that hold a shingle, then by hash. What only one holds is left out.
    held = grams.select("cid", "n", F.explode("grams").alias("h"))
    rarity = stored(held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "rarity")
    ordered = (held.join(merged(rarity), "h").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("grams"))
               .withColumn("s", F.size("grams").cast("long")).where(F.col("s") >= _least_common(F.col("n"), percent)))
    ordered = stored(ordered, "ordered")
    place = lambda x: x["df"] + (x["h"].cast("double") / float(1 << 64) + 0.5)  # noqa: E731  rises with the order
    cuts = ordered.select(F.explode("grams").alias("g")).agg(F.percentile_approx(
        place(F.col("g")), [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0] or []  # FRAGMENTS - 1 numbers
    number = lambda g: sum(((place(g) > c).cast("int") for c in cuts), F.lit(0))
    pieces = stored(ordered.select("cid", F.explode("grams").alias("g")).select("cid", number(F.col("g")).alias("fragment"), "g.h")
                    .groupBy("cid", "fragment").agg(F.collect_list("h").alias("hashes")), "fragments")
    reach = F.col("s") - _least_common(F.col("n"), percent) + 1
    posts = stored(ordered.select("cid", "n", "s", F.posexplode(F.slice("grams", F.lit(1), reach.cast("int"))).alias("pos", "g"))
                   .select("cid", "n", "s", F.col("pos").cast("long").alias("pos"), "g.h"), "prefixes")

    def compared(pairs: DataFrame, label: str) -> DataFrame:
        """overlap and link of the pairs (a, na, b, nb): overlaps by fragment, summed. Pairs without common shingles are left out."""
        each = pairs.withColumn("fragment", F.explode(F.array(*(F.lit(i) for i in range(FRAGMENTS)))))
        left = pieces.select(F.col("cid").alias("a"), "fragment", F.col("hashes").alias("ha"))
        right = pieces.select(F.col("cid").alias("b"), "fragment", F.col("hashes").alias("hb"))
        part = (each.join(merged(left), ["a", "fragment"]).join(merged(right), ["b", "fragment"])
                .select("a", "na", "b", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("overlap")))
        total = part.groupBy("a", "na", "b", "nb").agg(F.sum("overlap").alias("overlap"))
        return stored(total.withColumn("link", 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))), label)

    def pairs_of(x: DataFrame, y: DataFrame, also: Column) -> DataFrame:
        p = x.alias("a").join(merged(y.alias("b")), (F.col("a.h") == F.col("b.h")) & (F.col("a.cid") != F.col("b.cid")) & _may_link(percent) & also)
        low = F.col("a.cid") < F.col("b.cid")
        return p.select(F.least("a.cid", "b.cid").alias("a"), F.when(low, F.col("a.n")).otherwise(F.col("b.n")).alias("na"),
                        F.greatest("a.cid", "b.cid").alias("b"), F.when(low, F.col("b.n")).otherwise(F.col("a.n")).alias("nb")).distinct()

    # Everyone against one leader per shingle: the one with the fewest shingles of its own, as the text that others were copied from.
    best = F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "cid", "n", "s", "pos")).alias("m")
    leader = posts.groupBy("h").agg(best, F.count("*").alias("members")).where("members > 1").select("h", "m.cid", "m.n", "m.s", "m.pos")
    links = tried = known = None
    for again in range(LEADERS + 1):
        if again:
            # Then, under each shingle, what is outside the largest component: led by its best member, in the last round by everyone.
            comp = stored(components(links), "components").withColumnRenamed("node", "cid")
            labelled = stored(posts.join(merged(comp), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
                              .join(merged(leader.select("h", F.col("cid").alias("led"))), "h", "left").join(merged(known), ["cid", "led"], "left"), "labelled")
            by_comp = labelled.groupBy("h", "comp").agg(F.count("*").alias("m"))
            major = by_comp.groupBy("h").agg(F.max(F.struct("m", "comp"))["comp"].alias("major"), F.count("*").alias("comps")).where("comps > 1")
            split = labelled.join(merged(major.select("h", "major")), "h")
            minor = split.where("comp <> major")
            lead = minor if again == LEADERS else minor.groupBy("h").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "cid", "n", "s", "pos", "comp", "major", "o")).alias("m")).select("h", "m.*")
            both = (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.major")) | (F.col("a.cid") < F.col("b.cid")) | F.lit(again < LEADERS)) & _through_leader(percent)
            if again == LEADERS:  # a pair meets under all its common shingles of the prefixes; it counts under the first
                both &= _first_common(percent)
            pairs = pairs_of(lead, split, both).join(merged(tried), ["a", "b"], "left_anti")
        else:
            pairs = pairs_of(posts, leader, F.lit(True))
        pairs = stored(pairs, "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        found = compared(pairs, "compared")
        if known is None:
            known = found.select(F.col("a").alias("cid"), F.col("b").alias("led"), F.col("overlap").alias("o")).unionByName(
                found.select(F.col("b").alias("cid"), F.col("a").alias("led"), F.col("overlap").alias("o")))
        found = found.where("link").select("a", "b")
        links = found if links is None else links.unionByName(found)
    comp = stored(components(links), "components").withColumnRenamed("node", "cid")
    ends = _links_of(ordered, comp, percent)
    # Class numbers back to the smallest id of each component.
    named = classes.select("cid", "n", "c1", "c2", "id").join(merged(comp), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    smallest = named.groupBy("comp").agg(F.min("id").alias("component"))
    final = (named.join(merged(smallest), "comp").join(merged(ends), "cid", "left")
             .select("n", "c1", "c2", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component", F.col("comp").alias("group")))
    return sets.join(merged(final), ["n", "c1", "c2"], "left").select(
        "id", "key", F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), "group")


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    mine = [F.when(F.col(c) != NO_ID, F.col(c)).alias(n) for c, n in (("id", "doc_id"), ("component_id", "component_id"), ("class_id", "class_id"))]
    return out.select(mine[0], "n_shingles", mine[1], mine[2], "n_links")
