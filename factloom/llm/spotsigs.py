"""Document fingerprints: SpotSigs.

A spot signature is a common word (an anchor) and the chain of the next content words after it; the set of a document's
signatures is its fingerprint.  Running prose yields many signatures, menus and lists few.  Sets are compared by Jaccard
similarity; since it is at most the ratio of the set sizes, documents are partitioned by set length and only neighbouring
length classes meet, through an inverted index of each set's rarest signatures.  Where the likeness itself is asked for,
as in the query, nothing is cut: the length classes then say how a pair is counted.

A fingerprint travels as text: base64 of the sorted 32-bit signatures.

Defined results: a null text is empty; a text without any word has the empty fingerprint, and two empty fingerprints are
equal (1.0); a text with words but no signature is fingerprinted by its words; repeated rows have equal fingerprints;
rows without an id come after all others, rows with equal ids (or none) are ordered by text; a single row follows itself;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: Anchors: fixed values, the commonest function words of the four languages in use.
ANCHORS = (
    "the of and to in a is that it for as with was on be by at this are or an from "
    "der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch "
    "le la les de des et en du que qui dans un une est pour par sur au avec il "
    "el los las y se del una con por su para como es lo al"
).split()
#: Content words in a chain.
CHAIN = 3


def _anchor_hashes() -> np.ndarray:
    column = pa.array([" ".join(ANCHORS)])
    _, _, buf, offs = next(W.chunks(column))
    starts, ends, _ = W.word_bounds(buf, offs)
    return np.unique(W.span_hashes(buf, starts, ends, True))


_ANCHORS = _anchor_hashes()
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"'()")] = True


def signatures(column: pa.Array, chain: int = CHAIN):
    """(row, sorted distinct 32-bit signatures) of each text."""
    for lo, hi, buf, offs in W.chunks(column):
        starts, ends, first = W.word_bounds(buf, offs)
        n = len(starts)
        if n:
            # a word without the punctuation at its end, unless nothing is left
            for _ in range(2):
                cut = (ends - starts > 1) & _PUNCTUATION[buf[ends - 1]]
                ends = ends - cut
            hashes = W.span_hashes(buf, starts, ends, True)
            at = np.searchsorted(_ANCHORS, hashes)
            anchor = _ANCHORS[np.minimum(at, len(_ANCHORS) - 1)] == hashes
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            content = np.flatnonzero(~anchor)
            spots = np.flatnonzero(anchor)
            begin = np.searchsorted(content, spots)
            ok = begin + chain <= len(content)
            spots, begin = spots[ok], begin[ok]
            ok = doc[content[begin + chain - 1]] == doc[spots] if len(spots) else np.zeros(0, bool)
            spots, begin = spots[ok], begin[ok]
            value = hashes[spots] * W._FOLD[0]
            for i in range(chain):
                value = value + hashes[content[begin + i]] * W._FOLD[i + 1]
            value = (W.mix(value) >> W.U(32)).astype(np.uint32)
            bounds = np.searchsorted(doc[spots], np.arange(hi - lo + 1))
            single = (hashes >> W.U(32)).astype(np.uint32)
        for i in range(hi - lo):
            if not n or first[i] == first[i + 1]:
                yield lo + i, np.zeros(0, np.uint32)
            elif bounds[i] == bounds[i + 1]:
                yield lo + i, np.unique(single[first[i] : first[i + 1]])
            else:
                yield lo + i, np.unique(value[bounds[i] : bounds[i + 1]])


def spelled(signature_set: np.ndarray) -> str:
    return base64.b64encode(signature_set.astype("<u4").tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def length_class(size: np.ndarray, least: float) -> np.ndarray:
    """Partition of sets by length: class k holds sizes from least**-k up to the next, so partners are at most a class apart."""
    return np.floor(np.log(np.maximum(size, 1)) / -np.log(least) + 1e-9).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 at once if their sizes alone keep it under ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


#: Sets whose sizes differ by more than this ratio are counted by looking up the smaller one's members in the larger.
FAR = 1 / 16


def pruned_likeness(left: list[np.ndarray], right: list[np.ndarray], least: float = 0.0) -> np.ndarray:
    """Jaccard similarity of each pair of sets, 0.0 where it is under ``least``; exact for every pair if that is 0.

    Pairs whose length classes are no neighbours, or whose sizes alone keep them under least, are dropped first.  Of the
    rest only the first few elements are compared, as two sets that are alike enough share one of their prefixes; what is
    left is counted in full: neighbours by length all at once, a small set against a far larger one by looking it up.
    """
    n, m = (np.fromiter(map(len, part), np.int64, len(part)) for part in (left, right))
    out = np.where((n == 0) & (m == 0), 1.0, 0.0)
    apart = np.abs(length_class(n, least or FAR) - length_class(m, least or FAR)) > 1
    kept = (np.minimum(n, m) >= least * np.maximum(n, m)) & (n > 0) & (m > 0) & ~(apart & (least > 0))
    both = np.zeros(len(n), np.int64)

    def shared(pairs: np.ndarray, cut) -> np.ndarray:
        keys = []
        for part, size in ((left, n), (right, m)):
            sets = [part[i][: cut(int(size[i]))] for i in pairs]
            owner = np.repeat(np.arange(len(pairs)), [len(x) for x in sets]).astype(np.uint64)
            keys.append((owner << np.uint64(32)) | (np.concatenate(sets).astype(np.uint64) if sets else np.zeros(0, np.uint64)))
        return np.bincount((np.intersect1d(*keys, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=len(pairs))

    pairs = np.flatnonzero(kept & ~apart)
    if least:
        pairs = pairs[shared(pairs, lambda size: size - int(np.ceil(size * least - 1e-9)) + 1) > 0]
    both[pairs] = shared(pairs, lambda size: size)
    for i in np.flatnonzero(kept & apart):
        small, large = sorted((left[i], right[i]), key=len)
        both[i] = np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small)
    value = both / np.maximum(n + m - both, 1)
    return np.where(kept & (value >= least), value, out)


def _fingerprints(texts: list[str]) -> list[np.ndarray]:
    return [s for _, s in signatures(pa.array(texts, pa.string()))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, size) of each document."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.StringType()), T.StructField("size", T.IntegerType())])

    def run(batches):
        for batch in batches:
            sets = [s for _, s in signatures(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spelled(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int32())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def near_pairs(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(a, b, likeness) of fingerprints that are at least ``least`` alike, one row per pair of distinct fingerprints.

    a and b are the smallest ids with their fingerprint: copies are classes, not pairs.  Sets are partitioned by length
    class, of which those within the ratio ``least`` are neighbours; in a partition sets meet by the signatures of their
    prefix, rarest first, as only sets that share one there can be alike enough.
    """
    classes = prints.where("size > 0").groupBy("fingerprint", "size").agg(F.min(id_col).alias("id"))
    # class k holds sizes from least**-k up to the next; partners lie in the same class or the next
    classes = classes.withColumn("part", F.floor(F.log("size") / F.lit(-np.log(least))).cast("int"))
    schema = "id long, size int, part int, sig long"

    def explode(batches):
        for batch in batches:
            ids, sizes, parts, sigs = [], [], [], []
            for i, size, part, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for s in parsed(text).tolist():
                    ids.append(i), sizes.append(size), parts.append(part), sigs.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parts, pa.int32()), pa.array(sigs, pa.int64())], names=["id", "size", "part", "sig"])

    rows = classes.select(F.col("id").cast("long"), "size", "part", "fingerprint").mapInArrow(explode, schema)
    counted = rows.join(rows.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "sig"))
    # ceil(least * size) with a little slack for binary fractions, so that no prefix is too short
    prefix = counted.where("df > 1").withColumn("rank", rank + 0).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1)
    left = prefix.select("sig", "part", F.col("id").alias("a"), F.col("size").alias("size_a"))
    right = prefix.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("part").alias("own"))
    pairs = left.join(right, ["sig", "part"]).where((F.col("a") != F.col("b")) & ((F.col("own") < F.col("part")) | (F.col("a") < F.col("b"))))
    pairs = pairs.where(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    text = classes.select(F.col("id").cast("long").alias("id"), "fingerprint")
    both = pairs.join(text.toDF("a", "fa"), "a").join(text.toDF("b", "fb"), "b")

    def compare(batches):
        for batch in batches:
            alike = [likeness(parsed(x), parsed(y), least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], names=["a", "b", "likeness"])

    return both.select("a", "b", "fa", "fb").mapInArrow(compare, "a long, b long, likeness double").where(F.col("likeness") >= least)


_EDITED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document by descending id (after the last: the first).

    Ids are cut into ranges by sampled quantiles.  Every range also gets a copy of the first document of the range after
    it, so one shuffle brings each document next to its follower and ranges are worked through as streams.
    """
    spark = docs.sparkSession
    doc = F.col(id_col).cast("long")
    # rows without an id are placed by the smallest number, after all others
    rows = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(-(1 << 63))).alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("place", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    bounds = np.array([int(c) for c in cuts], np.int64)

    def parts(place: pa.Array) -> np.ndarray:
        # ranges count downwards from the largest ids
        return len(bounds) - np.searchsorted(bounds, place.to_numpy(zero_copy_only=False), side="right")

    def highest(batches):
        best: dict[int, int] = {}
        for batch in batches:
            place = batch.column(0)
            for p, x in zip(parts(place).tolist(), place.to_pylist(), strict=True):
                best[p] = max(x, best.get(p, x))
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.int32()), pa.array(best.values(), pa.int64())], names=["part", "place"])

    tops = rows.select("place").mapInArrow(highest, "part int, place long")
    heads = {r.part: r.head for r in tops.groupBy("part").agg(F.max("place").alias("head")).collect()}  # one row per range
    if not heads:
        return spark.createDataFrame([], _EDITED)
    present = sorted(heads)
    before = {present[i]: present[i - 1] for i in range(len(present))}  # the first range follows the last

    def deal(batches):
        for batch in batches:
            part = parts(batch.column(1))
            # only the first document of a range is copied, to the end of the range before it
            guests = [i for i, (p, x) in enumerate(zip(part.tolist(), batch.column(1).to_pylist(), strict=True)) if heads[p] == x]
            both = pa.Table.from_batches([batch, batch.take(pa.array(guests, pa.int64()))]) if guests else pa.Table.from_batches([batch])
            home = [*part.tolist(), *(before[part[i]] for i in guests)]
            guest = [0] * len(part) + [1] * len(guests)
            dealt = both.append_column("part", pa.array(home, pa.int32())).append_column("guest", pa.array(guest, pa.int32()))
            yield from dealt.select(["part", "guest", "doc_id", "text", "place"]).to_batches()

    dealt = rows.select("doc_id", "place", "text").mapInArrow(deal, "part int, guest int, doc_id long, text string, place long")
    ordered = dealt.repartition(max(1, ranges // 4), "part").sortWithinPartitions("part", "guest", F.desc("place"), "text").drop("place")

    def run(batches):
        def pairs():
            part, held = None, None
            for batch in batches:
                for p, guest, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                    if held is not None and p == part:
                        yield (*held, text.as_py())
                    # of a range's guests (more than one only if ids repeat) the first is the follower
                    part, held = p, None if guest else (doc, text.as_py())

        out, size = [], 0
        for item in pairs():
            out.append(item)
            size += len(item[1])
            if size > 1 << 20:
                yield _edited_batch(out)
                out, size = [], 0
        if out:
            yield _edited_batch(out)

    return ordered.mapInArrow(run, _EDITED)


def _edited_batch(items: list[tuple[int, str, str]]) -> pa.RecordBatch:
    edited = []
    for _, text, follower in items:
        k = len(text) // 3
        edited.append(text[: len(text) - k] + follower[:k])
    own, changed, after = _fingerprints([x[1] for x in items]), _fingerprints(edited), _fingerprints([x[2] for x in items])
    columns = [
        pa.array([x[0] for x in items], pa.int64()), pa.array([len(x[1]) for x in items], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(map(spelled, own), pa.string()), pa.array(map(spelled, changed), pa.string()), pa.array(pruned_likeness(own, changed)), pa.array(pruned_likeness(own, after)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_EDITED.names)


def op3_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
