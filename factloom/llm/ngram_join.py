"""N-gram Jaccard join: grouped prefix join, and the connected groups of its links.

Documents are sets of word n-grams.  Two sets can only be similar enough if they share an n-gram among the first few of a
common order, the prefix.  Documents with identical sets are one class, classes with identical prefix and size are one
group; groups meet through a posting list per prefix n-gram, pairs are filtered by size on the level of groups, then
expanded to classes and verified exactly.

Order.  Rare n-grams come first.  Rarity is read from a table of 2**22 counters that all n-grams of the corpus are hashed
into (fixed size, one pass); an order by any function of the n-gram is right, a good one is fast.

Skew.  A posting list is never expanded into its pairs.  Every list names a hub - the member with the fewest n-grams of
its own, which near copies of one text have most in common with - and lists of one hub are gathered into a family, so
that near copies meet once and not once per shared n-gram.  Families are dealt into blocks, every two blocks meet in one
group of bounded size, and all their similarities are counted there at once.  Two classes may meet in several families;
their link counts in the one of the smallest hub.  What leaves a group is one row per linked member: how many documents
it is linked with there, and the component it belongs to there.  Nothing of the size of the corpus reaches the driver.

Links.  n_links of a document is the number of other documents whose sets are similar enough to its own, those with an
equal set included; all of them are verified and counted, not only those that components need.  Pairs are counted, not
returned, as their number is the square of a group's size.

Defined results: a null or empty text has no n-gram, links with nothing and is its own component; a text shorter than an
n-gram is one n-gram; rows of one id are returned once each, those with equal sets count as one document, and those with
different sets are documents of their own that happen to share a name; ties are broken by the smallest id; empty tables
give an empty result; extra columns are ignored; texts of any length are read whole.  A row without an id is not counted
and has no number of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .arrow import unused
from .scratch import drop, durable

SKETCH_BITS, BLOCK_BITS = 22, 16
_DOCS = "id long, th long, n long, s1 long, s2 long, gh long, prefix array<long>"
#: A set of n-grams: how many it has, and two hashes of it.
SET = ["n", "s1", "s2"]


def extra(n):
    """By how much prefixes are longer than they must be; so many more n-grams two similar sets must then share there."""
    return n // 20


def prefix_length(n: int, percent: int) -> int:
    """Two sets of similarity percent/100 share 1 + extra of their first so many n-grams, for the smaller extra of both."""
    return min(n, n - (percent * n + 99) // 100 + 1 + extra(n))


def _told(s: np.ndarray) -> tuple[int, int, int]:
    """Size and two hashes of a set."""
    return len(s), int(W.mix(s).sum(dtype=W.U)), int(W.mix(s ^ W.U(0x1234567)).sum(dtype=W.U))


def _levels(docs: DataFrame, k: int) -> np.ndarray:
    """Counters of all n-grams as levels of 0 to 255 (eighth powers of two), 4 MB whatever the corpus."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        any_rows = False
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            for _, s in W.shingle_sets(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    total += np.bincount((np.concatenate(held) >> W.U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                    held, size, any_rows = [], 0, True
            if size:
                total += np.bincount((np.concatenate(held) >> W.U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                any_rows = True
        if any_rows:
            for i, block in enumerate(np.split(total.astype(np.uint32), 1 << (SKETCH_BITS - BLOCK_BITS))):
                if block.any():
                    packed = block.astype(np.uint8) if block.max() < 256 else block
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed.itemsize], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["block", "width", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(raw, np.uint8 if width == 1 else np.uint32)
                sums[i] = sums.get(i, 0) + part.astype(np.int64)
        for i, part in sums.items():
            level = np.minimum(255, np.floor(8 * np.log2(part + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])

    blocks = 1 << (SKETCH_BITS - BLOCK_BITS)
    parts = docs.select("text").mapInArrow(count, "block int, width int, counts binary")
    rows = parts.repartition(blocks, "block").mapInArrow(add, "block int, levels binary").collect()  # at most 64 rows of 64 KB
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        out[r.block << BLOCK_BITS : (r.block + 1) << BLOCK_BITS] = np.frombuffer(r.levels, np.uint8)
    return out


def _described(docs: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """One row per document: hash of the text, set size, two hashes of the set, hash of the prefix, and the prefix as ordered keys."""

    def run(batches):
        rare = levels.value
        for batch in batches:
            ids = batch.column(0)
            n, s1, s2, gh, prefixes = [], [], [], [], []
            for _, s in W.shingle_sets(batch.column(1), k):
                size, one, two = _told(s)
                n.append(size)
                s1.append(one)
                s2.append(two)
                if size:
                    keys = (rare[(s >> W.U(64 - SKETCH_BITS)).astype(np.int64)].astype(W.U) << W.U(55)) | (W.mix(s) >> W.U(9))
                    p = prefix_length(size, percent)
                    keys = np.sort(np.partition(keys, p - 1)[:p] if p < size else keys)
                    prefixes.append(keys.astype(np.int64))
                    gh.append(int(W.mix(keys).sum(dtype=W.U)))
                else:
                    prefixes.append(np.zeros(0, np.int64))
                    gh.append(0)
            signed = lambda v: pa.array(np.array(v, W.U).view(np.int64) if v else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(n, pa.int64()), signed(s1), signed(s2), signed(gh), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "th", "n", "s1", "s2", "gh", "prefix"])

    return docs.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, _DOCS)


def _sets_of(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(cid, grams) of the classes in wanted (cid, id of a document, set); a filter of fixed size spares most others the work."""
    slots = 1 << 25
    at = F.pmod(F.xxhash64("id"), F.lit(slots))
    rows = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # at most 1,024 rows of 4 KB
    bits = np.zeros(slots // 8 + 8192, np.uint8)
    for r in rows:
        # bucket numbers count from 1 at position 1
        bits[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    table = docs.sparkSession.sparkContext.broadcast(bits)
    place = F.pmod(F.xxhash64("id"), F.lit(slots))
    marked = docs.select("id", "text", (F.bitmap_bucket_number(place) * 32768 + F.bitmap_bit_position(place)).alias("bit"))

    def run(batches):
        have = table.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            hit = (have[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            some = batch.filter(pa.array(hit.astype(bool)))
            for at in range(0, some.num_rows, 256):
                part = some.slice(at, 256)
                sets = [s for _, s in W.shingle_sets(part.column(1), k)]
                told = [pa.array(np.array(x, W.U).view(np.int64)) for x in zip(*(_told(s) for s in sets), strict=True)] if sets else [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), *told, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", *SET, "grams"])

    # a document may stand in several rows, and other documents may have its id: the set tells them apart
    made = marked.mapInArrow(run, "id long, n long, s1 long, s2 long, grams array<long>")
    return made.join(wanted, ["id", *SET]).select("cid", "grams").dropDuplicates(["cid"])


def _same(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return r.n, r.h or 0


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes on edges (u, v): comp is the smallest node reachable. Alternating large and small stars."""

    def large(e):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e):
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()

    e = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = _same(e)
    while seen[0]:
        nxt = durable(small(large(e)), "cc")
        drop(e)
        e, now = nxt, _same(nxt)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


#: Members of a family that meet at once in a task are two blocks of about this size.
BLOCK = 192


def _overlap(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets at places a and those at places b have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[element] > 1
    element, owner = number[element[shared]], owner[shared]
    common = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    for lo in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        x, y = np.searchsorted(element, [lo, lo + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[x:y], element[x:y] - lo] = 1
        common += dense[a] @ dense[b].T
    return common.astype(np.int64)


def _block_links(hub: int, within: bool, side: np.ndarray, cids: np.ndarray, weights: np.ndarray, hubs: list[np.ndarray], grams: list[np.ndarray], percent: int) -> list[tuple[int, int, int]]:
    """(cid, smallest cid it is connected to, documents it is linked with) of the members linked here.

    Members of block 0 meet those of block 1, or all meet each other (within).  Pairs that also meet in the family of a
    smaller hub are left to that.
    """
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if within:
        a = b = np.arange(len(cids))
    if not len(a) or not len(b):
        return []
    common = _overlap(grams, a, b)
    sizes = np.array([len(g) for g in grams])
    linked = 100 * common >= percent * (sizes[a][:, None] + sizes[b][None, :] - common)
    if within:
        np.fill_diagonal(linked, False)
    if linked.any():
        linked &= _overlap([h[h < hub] for h in hubs], a, b) == 0
    if not linked.any():
        return []
    count, label, none = np.zeros(len(cids), np.int64), cids.copy(), np.iinfo(np.int64).max
    count[a] += linked @ weights[b]
    if not within:
        count[b] += linked.T @ weights[a]
    while True:
        before = label.copy()
        label[a] = np.minimum(label[a], np.where(linked, label[b][None, :], none).min(axis=1))
        label[b] = np.minimum(label[b], np.where(linked, label[a][:, None], none).min(axis=0))
        if (label == before).all():
            break
    return [(int(cids[i]), int(label[i]), int(count[i])) for i in np.flatnonzero(count)]


def _dealt(family: DataFrame, percent: int) -> DataFrame:
    """(hub, group, side, cid, weight): members of families (hub, cid, n, weight) dealt into groups of bounded size.

    A family of more than BLOCK members is cut into bands of size, so wide that sets similar enough are in one band or in
    neighbouring ones, and a band into blocks by hash.  Each block meets all blocks of its band and of the next band; all
    other pairs of blocks are left out, as their sizes keep them apart.
    """
    width = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1.0
    counted = family.groupBy("hub").agg(F.count("*").alias("_m")).where(F.col("_m") > BLOCK).select(F.col("hub").alias("_hub"))
    banded = family.join(counted, F.col("hub") == F.col("_hub"), "left").withColumn("band", F.when(F.col("_hub").isNotNull(), F.floor(F.log(F.col("n").cast("double")) / width)).otherwise(0).cast("int"))
    sizes = banded.where("_hub is not null").groupBy("hub", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # bands of a family are as many as its sizes have orders of magnitude
    per_hub = sizes.groupBy("hub").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"))
    met = banded.drop("_hub").join(per_hub, "hub", "left")
    blocks = lambda step: F.coalesce(F.element_at("bands", F.col("band") + step), F.lit(1 if step == 0 else 0))
    met = met.withColumn("block", F.pmod(F.xxhash64("cid"), blocks(0)).cast("int"))
    place = lambda lower, upper, i, j, side: F.struct(lower.alias("lower"), upper.alias("upper"), i.alias("i"), j.alias("j"), side.alias("side"))
    band, block, zero, one = F.col("band"), F.col("block"), F.lit(0), F.lit(1)
    others = lambda step: F.when(blocks(step) > 0, F.sequence(zero, blocks(step) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(others(0), lambda x: place(band, band, F.least(block, x), F.greatest(block, x), (block > x).cast("int")))
    above = F.transform(others(1), lambda x: place(band, band + 1, block, x, zero))
    below = F.transform(others(-1), lambda x: place(band - 1, band, x, block, one))
    return met.withColumn("g", F.explode(F.concat(own, above, below))).select("hub", "g.*", "cid", "weight")


def _linked(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, links) of the classes of families (hub, cid, n, weight): a is connected to b, and linked with so many documents.

    A class may have several rows; its links are their sum.  In each group of _dealt() all similarities are counted at once.
    """
    hubs = family.groupBy("cid").agg(F.collect_list("hub").alias("hubs"))
    group = ["hub", "lower", "upper", "i", "j"]
    dealt = _dealt(family, percent)
    rows = dealt.join(hubs, "cid").join(sets, "cid").select(*group, "side", "cid", "weight", "hubs", "grams")
    rows = rows.repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        key, held = None, []

        def done():
            side, cids, weights = (np.array([r[c] for r in held], np.int64) for c in range(3))
            return _block_links(key[0], key[1] == key[2] and key[3] == key[4], side, cids, weights, [r[3] for r in held], [r[4] for r in held], percent)

        def packed(out):
            columns = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

        for batch in batches:
            out = []
            head = [c.to_pylist() for c in batch.columns[:8]]
            lists = [(np.asarray(c.values), np.asarray(c.offsets)) for c in batch.columns[8:]]
            for r, (*place, side, cid, weight) in enumerate(zip(*head, strict=True)):
                if place != key:
                    if len(held) > 1:
                        out += done()
                    key, held = place, []
                held.append((side, cid, weight, *(flat[offsets[r] : offsets[r + 1]] for flat, offsets in lists)))
            yield packed(out)
        yield packed(done() if len(held) > 1 else [])

    return rows.mapInArrow(run, "a long, b long, links long")


def _placed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, th, n, component_id, keeper, n_links) of every row of docs (id, text): th is a hash of the text, and keeper the
    (id, th) that stands for the component."""
    sc = docs.sparkSession.sparkContext
    levels = sc.broadcast(_levels(docs, k))
    described = durable(_described(docs, k, percent, levels), "ngram-docs")
    # identical sets are one class, with a number of its own as ids may be shared by different texts; classes with identical
    # prefix and size are one group
    keyed = described.where("n > 0 and id is not null")
    classes = keyed.groupBy(*SET).agg(F.min(F.struct("id", "th")).alias("least"), F.min("gh").alias("gh"), F.count_distinct("id").alias("weight"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")
    groups = classes.groupBy("gh", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("size"))
    heads = classes.join(groups.select("gid"), F.col("cid") == F.col("gid")).select(F.col("least.id").alias("id"), *SET, "gid")
    postings = keyed.select("id", *SET, F.size("prefix").alias("p"), "prefix").join(heads, ["id", *SET]).dropDuplicates(["gid"])
    lists = postings.select("gid", "n", "p", F.explode("prefix").alias("token"))
    for _ in range(2):
        # a list needs two members, and a member must be in as many lists as it shares n-grams with its nearest partner:
        # of a partner's extra n-grams at least percent/100 as many as of its own
        met = lists.join(lists.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "token")
        met = durable(met, "ngram-met")
        rich = met.groupBy("gid").agg(F.count("*").alias("met"), F.min("n").alias("n")).where(F.col("met") >= 1 + F.floor(F.floor(F.col("n") * percent / 100) / 20))
        lists = met.join(rich.select("gid", "met"), "gid").select("token", "gid", "n", (F.col("p") - F.col("met")).alias("alone"), "p")
    lists = durable(lists, "ngram-lists")
    members_all = classes.join(groups.select("gh", "n", "gid", "size"), ["gh", "n"]).select("gid", "cid", "size", "weight", F.col("least.id").alias("id"), *SET)
    listed = lists.select("gid").distinct().withColumn("listed", F.lit(True))
    members = durable(members_all.join(listed, "gid", "left").where("listed or size > 1").drop("listed"), "ngram-members")
    sets = durable(_sets_of(docs, k, members.select("cid", "id", *SET)), "ngram-sets")

    # a list's hub: the member with the fewest n-grams in its prefix that no other group has there, as a text has that
    # others are copies of; the members of all lists of a hub are a family, and so are the classes of a group
    hubs = lists.groupBy("token").agg(F.min(F.struct("alone", "gid")).alias("hub")).select("token", F.col("hub.gid").alias("hub"))
    met = durable(hubs.join(lists.select("token", "gid"), "token").where("hub <> gid").select("hub", "gid").distinct(), "ngram-hubs")
    family = met.union(met.select("hub", F.col("hub").alias("gid")).distinct())
    family = family.join(members.select("gid", "cid", "n", "weight"), "gid").select("hub", "cid", "n", "weight").union(members.where("size > 1").select("gid", "cid", "n", "weight")).distinct()
    family = durable(family, "ngram-family")
    links = durable(_linked(family, sets, percent), "ngram-links")
    labels = durable(connected(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("cid", "comp"), "ngram-labels")
    counts = links.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    drop(lists, met, members, sets, family)
    keepers = labels.join(classes.select("cid", "least"), "cid").groupBy("comp").agg(F.min("least").alias("keeper"))
    placed = classes.join(labels.join(keepers, "comp").select("cid", "keeper"), "cid", "left").join(counts, "cid", "left")
    placed = placed.select(*SET, F.coalesce("keeper", "least").alias("keeper"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = described.select("id", "th", *SET)
    # empty sets are their own components; all others look up that of their class
    n_links = F.when(F.col("id").isNotNull(), F.col("n_links")).alias("n_links")
    full = rows.where("n > 0").join(placed, SET, "left").select("id", "th", "n", "keeper", n_links)
    empty = rows.where("n = 0").withColumn("n_links", F.lit(0).cast("long")).select("id", "th", "n", F.struct("id", "th").alias("keeper"), n_links)
    return full.union(empty).select("id", "th", "n", F.col("keeper.id").alias("component_id"), "keeper", "n_links")


def components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _placed(rows, k, percent).select("id", "n", "component_id", "n_links").toDF(id_col, "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays: that with the smallest id (of several with that id, one text by its hash).

    Of rows equal in id and text one stays.  Documents with empty sets all stay, and so do rows without an id, which cannot
    be told apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = _placed(rows, k, percent).where("id is not null and keeper.id = id and keeper.th = th").select(F.col("id").alias("_keep_id"), F.col("th").alias("_keep_th")).distinct()
    name = unused(docs, "_th")
    hashed = docs.where(F.col(id_col).isNotNull()).withColumn(name, F.xxhash64(text_col))
    found = hashed.join(kept, (F.col(id_col).cast("long") == F.col("_keep_id")) & (F.col(name) == F.col("_keep_th")), "left_semi")
    return found.dropDuplicates([id_col, name]).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of 3-word n-gram sets at a Jaccard similarity of 0.9, and the number of links of each document."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
