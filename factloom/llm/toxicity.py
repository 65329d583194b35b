"""Toxicity: non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic examples and unlabelled text.  The risk of
the negative class is estimated as the risk over unlabelled text less the class prior times the risk that positives
would have as negatives; where that estimate falls under zero it counts as zero, which keeps the classifier from fitting
the unlabelled set.  The prior is given, or the share of toxic rows among the labelled rows of the documents at hand:
labels of documents that an earlier step dropped say nothing about the unlabelled text, and a prior that is too low
teaches that some toxic text is clean.  Where all these labels are toxic, it is estimated from the unlabelled text: no
feature may be rarer there than the prior times its rate among positives, so the least ratio of the two rates, over
features that a twentieth of the positives have, bounds it from above.

Positives are a bounded sample of the labelled toxic rows, drawn by a hash of the id: at most ``max_positive`` (3,000).
Unlabelled text is the whole corpus but for the held-out rows.  Three passes read it: one counts in how many documents
each feature occurs and keeps those that tell positives apart (``max_features`` of them at most, the size of the model);
one reduces each document to its kept features and counts equal ones; the last scores.  Between them every step of the
descent is one aggregate over the table of patterns, computed in numpy by its tasks; the driver holds vectors of the
model's size only, and a lost executor costs a task of one step.

Defined results: a null or empty text has no words and gets the score of the intercept; labels that are null are ignored,
several labels of one document count as their maximum; without toxic examples every score is the prior (near 0 if it is
unknown); toxic labels alone are enough to learn from; toxic examples with equal texts count once, unlabelled documents as often as they occur; a row without an id is
unlabelled text and is scored like any other; repeated rows are scored alike; extra columns pass through untouched, and
the score takes a name that none of them has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import annotate, give_back, unused
from .scratch import drop, durable

BITS, BLOCK_BITS = 20, 12
_MASK = np.int32((1 << BITS) - 1)
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}*#$%&|<>-_")] = True


def word_features(column: pa.Array):
    """(row, sorted distinct buckets) of each text: its words and their beginnings of 4, 5 and 6 bytes, and of these again
    those that it has twice or more, and three times or more.

    Words are lower-cased and stripped of marks at their ends; beginnings catch inflected and compound forms.  What a text
    says repeatedly tells more than what it says once.
    """
    for lo, hi, buf, offs in W.chunks(column):
        starts, ends, first = W.word_bounds(buf, offs)
        if len(starts):
            for _ in range(4):
                ends = ends - ((ends - starts > 1) & _EDGE[buf[ends - 1]])
                starts = starts + ((ends - starts > 1) & _EDGE[buf[starts]])
            made = [W.span_hashes(buf, starts, ends, True)]
            made += [W.mix(W.span_hashes(buf, starts, np.minimum(ends, starts + n), True) + W.U(n)) for n in (4, 5, 6)]
            buckets = (np.stack(made, axis=1) >> W.U(64 - BITS)).astype(np.int32)
        for i in range(hi - lo):
            if first[i + 1] == first[i]:
                yield lo + i, np.zeros(0, np.int32)
                continue
            own, count = np.unique(buckets[first[i] : first[i + 1]], return_counts=True)
            more = own[count >= 2]
            often = own[count >= 3]
            yield lo + i, np.unique(np.concatenate([own, (more * 5 + 77_773) & _MASK, (often * 9 + 55_511) & _MASK]))


@dataclass
class Model:
    """Weights of buckets (sorted) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.buckets] = self.weights
        return dense


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(step, positive: np.ndarray, n_p: int, n_u: int, prior: float, most: int = 40, ridge: float = 1e-3, memory: int = 8) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss, by L-BFGS over all examples.

    positive: how many positive examples hold each feature.  step(weights, bias) gives, over all examples, the summed loss
    of being taken as negative and its gradient (features, then bias), for positives and for unlabelled text.  About
    ``most`` steps are asked for at most.
    """
    held = np.append(positive, n_p)
    penalty = np.append(np.full(len(positive), ridge), 0.0)

    def risk(x: np.ndarray) -> tuple[float, np.ndarray]:
        (loss_p, grad_p), (loss_u, grad_u) = step(x[:-1], x[-1])
        value = prior * (loss_p - held @ x) / n_p  # the loss of a positive as positive is its loss as negative less its score
        grad = prior * (grad_p - held) / n_p
        negative = loss_u / n_u - prior * loss_p / n_p
        if negative > 0:
            value, grad = value + negative, grad + grad_u / n_u - prior * grad_p / n_p
        return value + (penalty * x * x).sum() / 2, grad + penalty * x

    x = np.append(np.zeros(len(positive)), np.log(prior / (1 - prior)))
    value, grad = risk(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < most and np.abs(grad).max() > 1e-5:
        way, kept = grad.copy(), []
        for s, y in reversed(moves):
            a = (s @ way) / (s @ y)
            kept.append(a)
            way -= a * y
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        size = 1.0 if moves else 1.0 / max(np.abs(grad).max(), 1e-12)
        for _ in range(6):
            nxt = x - size * way
            used += 1
            got, slope = risk(nxt)
            if got <= value - 1e-4 * size * (grad @ way):
                break
            size /= 4
        else:
            break  # no way down: the bottom, or the edge where the negative risk reaches zero
        if (nxt - x) @ (slope - grad) > 1e-12:
            moves = [*moves, (nxt - x, slope - grad)][-memory:]
        x, value, grad = nxt, got, slope
    return x[:-1], float(x[-1])


def _blocks(flagged: DataFrame) -> DataFrame:
    """(block, positive, width, counts): how many positives and how many documents in all hold each bucket, by task."""

    def run(batches):
        held = {side: np.zeros(1 << BITS, np.int64) for side in (False, True)}
        for batch in batches:
            marked = batch.column(1).to_numpy(zero_copy_only=False)
            for i, buckets in word_features(batch.column(0)):
                held[False][buckets] += 1
                if marked[i]:
                    held[True][buckets] += 1
        for positive in (False, True):
            for i, part in enumerate(np.split(held[positive], 1 << (BITS - BLOCK_BITS))):
                if most := int(part.max()):
                    packed = part.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([positive]), pa.array([packed.itemsize], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["block", "positive", "width", "counts"])
        held.clear()
        give_back()

    return flagged.select("_text", "_positive").mapInArrow(run, "block int, positive boolean, width int, counts binary")


def signed_root(a: np.ndarray, b: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Signed root of the likelihood ratio statistic that a of n_p and b of n_u have different rates.

    It is nearly normal where they have not, for rare features and sides of very unequal size too.
    """
    rate = (a + b) / (n_p + n_u)
    total = np.zeros(len(a))
    for x, n in ((a, n_p), (n_p - a, n_p), (b, n_u), (n_u - b, n_u)):
        null = rate if x is a or x is b else 1 - rate
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(x > 0, x * np.log(x / n / null), 0.0)
    return np.sign(a / n_p - b / n_u) * np.sqrt(2 * np.maximum(total, 0.0))


def telling(flagged: DataFrame, n_p: int, n_u: int, least_count: int, least_z: float) -> DataFrame:
    """(bucket, z, positives, documents) of the features whose rates among positives and all documents differ beyond chance."""

    def run(batches):
        sums: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            for i, positive, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 8: np.int64}[width])
                sums[i, positive] = sums.get((i, positive), 0) + part.astype(np.int64)
        for i in sorted({i for i, _ in sums}):
            a, b = (sums.get((i, side), np.zeros(1 << BLOCK_BITS, np.int64)) for side in (True, False))
            z = signed_root(a, b, n_p, n_u)
            keep = np.flatnonzero((np.abs(z) >= least_z) & (np.where(z > 0, a, b) >= least_count))
            yield pa.RecordBatch.from_arrays([pa.array(keep + (i << BLOCK_BITS), pa.int32()), pa.array(z[keep]), pa.array(a[keep]), pa.array(b[keep])], names=["bucket", "z", "positives", "documents"])

    return _blocks(flagged).repartition("block").mapInArrow(run, "bucket int, z double, positives long, documents long")


def patterns(flagged: DataFrame, kept: np.ndarray) -> DataFrame:
    """(pattern, n_p, n_u): how many positives and how many documents in all hold exactly these of the kept features.

    A pattern is the places in kept as 16-bit numbers; documents of one pattern are one row from here on.
    """

    def run(batches):
        place = np.full(1 << BITS, -1, np.int16)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            made = []
            for _, buckets in word_features(batch.column(0)):
                at = place[buckets]
                made.append(at[at >= 0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], names=["pattern", "positive"])
        give_back()

    rows = flagged.select("_text", "_positive").mapInArrow(run, "pattern binary, positive boolean")
    return rows.groupBy("pattern").agg(F.sum(F.col("positive").cast("long")).alias("n_p"), F.count("*").alias("n_u"))


def partial_sums(table: DataFrame, k: int):
    """The step of train() over a table of patterns; at most 256 partial sums of fixed size reach the driver a step."""
    table = table.coalesce(256)

    def step(weights, bias):
        def run(batches):
            total = np.zeros((2, k + 2))
            for batch in batches:
                column = batch.column(0)
                _, offsets, data = column.buffers()
                offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 2
                cols = np.frombuffer(data, np.int16)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.int16)
                rows = np.repeat(np.arange(len(column)), np.diff(offsets))
                f = bias + np.bincount(rows, weights[cols], minlength=len(column))
                s, loss = _sigmoid(f), np.logaddexp(0, f)
                for side in (0, 1):
                    n = batch.column(1 + side).to_numpy()
                    total[side, :k] += np.bincount(cols, (n * s)[rows], minlength=k)
                    total[side, k:] += (n * s).sum(), (n * loss).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        rows = table.mapInArrow(run, "sums binary").collect()  # at most 256 rows of 16 (k + 2) bytes
        total = sum((np.frombuffer(r.sums).reshape(2, k + 2) for r in rows), np.zeros((2, k + 2)))
        return tuple((part[k + 1], part[: k + 1].copy()) for part in total)

    return step


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(ids: DataFrame, total: int, most: int) -> DataFrame:
    """Under most of total ids (column _id), by a hash: the aim leaves room for chance, so nothing is cut off."""
    space = 1 << 30
    share = space if total <= most else int(space * 0.9 * most / total)
    return ids.where(F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(space)) < share)


def estimated_prior(positives: np.ndarray, documents: np.ndarray, n_p: int, n_u: int) -> float:
    """Upper bound of the share of positives among documents, from the features that positives and documents have."""
    common = positives >= max(5, n_p / 20)
    rates = (documents[common] + 1) / n_u / (positives[common] / n_p)
    return min(0.5, max(n_p / n_u, float(rates.min(initial=0.5))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 3_000, max_features: int = 4_096, least_count: int = 5, least_z: float = 4.0, prior: float | None = None) -> Model:
    """Train from the rows that are not held out: at most max_positive labelled toxic ones, and all documents as unlabelled.

    prior: the share of toxic documents, if it is known.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(~held_out("_id"))
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).alias("_toxic"))
    # only labels of documents that are there count, as often as these occur
    marks = durable(marks.join(docs.groupBy("_id").agg(F.count("*").alias("_rows")), "_id"), "toxic-marks")
    counts = marks.agg(F.sum("_rows").alias("n"), F.sum(F.col("_toxic").cast("long") * F.col("_rows")).alias("p"), F.count(F.when(F.col("_toxic") == 1, 1)).alias("ids")).first()
    n, p = counts.n or 0, counts.p or 0
    if prior is None and (p < n or not p):
        prior = p / n if n else 0.0
    within = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    toxic = _sampled(marks.where("_toxic = 1").select("_id"), counts.ids, max_positive)
    # of toxic documents with equal texts one stands for all
    chosen = durable(docs.join(F.broadcast(toxic), "_id").groupBy(F.xxhash64("_text").alias("_h"), F.length("_text").alias("_n")).agg(F.min("_id").alias("_id")).select("_id", F.lit(True).alias("_positive")).distinct(), "toxic-ids")
    flagged = docs.join(F.broadcast(chosen), "_id", "left").select("_text", F.coalesce("_positive", F.lit(False)).alias("_positive"))  # at most max_positive ids
    size = docs.join(F.broadcast(chosen), "_id", "left").agg(F.count("_positive").alias("p"), F.count("*").alias("u")).first()
    if not size.p:
        drop(marks, chosen)
        rate = within(prior or 0.0)
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(rate / (1 - rate))))
    found = telling(flagged, size.p, size.u, least_count, least_z).orderBy(F.abs("z").desc(), "bucket").limit(max_features).collect()
    found.sort(key=lambda r: r.bucket)
    kept, positive, documents = (np.array([r[c] for r in found], np.int64) for c in (0, 2, 3))
    prior = within(estimated_prior(positive, documents, size.p, size.u) if prior is None else prior)
    table = durable(patterns(flagged, kept), "toxic-patterns")
    weights, bias = train(partial_sums(table, len(kept)), positive.astype(float), size.p, size.u, prior)
    drop(marks, chosen, table)
    return Model(kept, weights.astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs and a struct column whose field ``value`` is the score of its text; docs must have no column of that name."""
    table = docs.sparkSession.sparkContext.broadcast(model.table())  # 2**BITS floats, whatever the corpus
    intercept = model.intercept

    def kernel(column):
        weights = table.value
        return [pa.array(_sigmoid(np.array([intercept + float(weights[b].sum(dtype=np.float64)) for _, b in word_features(column)], float)))]

    return annotate(docs, text_col, kernel, T.StructType([T.StructField("value", T.DoubleType())]), name)


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents that score under limit, with their own columns only."""
    name = unused(docs, "_score")
    return score(docs, fit(docs, labels, text_col=text_col), text_col, name).where(F.col(name)["value"] < limit).select(*docs.columns)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    value = F.col("score")["value"]
    return scored.select("doc_id", held_out().alias("held_out"), value.alias("score"), F.when(value >= 0.7, 1).otherwise(0).alias("predicted"))
