"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which tokens of another, counted over a corpus.

Both tokenizers write the same bytes (a space and the text), so each splits them into runs.  Bytes where runs of both end
are common cuts; between two cuts lies a group.  Two tokens are linked where their runs overlap.

Kernel.  Ends of tokens are cumulative sums of their byte lengths; ``intersect1d`` gives the common cuts, ``searchsorted``
the group of every token and the first and last partner of each, and links come from repeating a token once per partner.
Texts are first cut before lone spaces, where neither tokenizer ever joins (see ``Aligner``); so every such part is a whole
number of groups, and what a part gives is worked out once per Python worker and remembered within a bound of bytes.

Counts.  A task gathers its documents into blocks of a bounded number of bytes and emits a block's distinct pairs with
their numbers.  They are added up in two shuffles, salted by block first.  The totals then return to the blocks that hold
the pair, where each document adds up what its own links have: what is shuffled is a row per block and distinct pair, and
not one per document and link.  A document longer than a block is a block of its own.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte for byte, have no tokens: their
numbers are 0 and their digest is empty; repeated rows are aligned and counted each; ties for a token's best partner all
count; rows without an id are kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .arrow import give_back
from .scratch import durable

#: Bytes that a worker remembers of parts, and bytes of text in a block.
REMEMBERED_BYTES, BLOCK_BYTES = 96 << 20, 16 << 20
#: Salts of the first of the two sums.
SALTS = 16
#: Bytes before which a lone space may be cut: signs of ASCII, and first bytes of longer characters that are no white space.
_AFTER = np.zeros(256, bool)
_AFTER[33:127] = True
_AFTER[0xC3:0xF5] = True
_AFTER[[0xE1, 0xE2, 0xE3]] = False


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level vocabularies: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Tokens of parts of texts by two vocabularies, and what links them.

    A part begins with a space that no space stands before and a sign or letter follows.  The first tokenizer's pattern always
    begins a match there; no piece of the second vocabulary holds a space after another sign (checked when it is read), so
    it never merges across.  A part's tokens are therefore those of the whole text there.
    """

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        table = byte_alphabet()
        size = 1 + max(self.a.get_vocab().values())
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(table[c] for c in n) if all(c in table for c in n) else n.encode() for n in names]
        self.b_size = self.b.vocab_size()
        told = [self.b.id_to_piece(i) for i in range(self.b_size)]
        if any("▁" in p.lstrip("▁") for p in told):
            raise ValueError("a piece holds a space after another sign: texts cannot be cut before lone spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(told)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # ids in decimal with the sign that may follow, one after another
        self.digits = [b"".join(x) for x in ([b"%d%s" % (i, s) for i in range(max(size, self.b_size))] for s in (b",", b"|", b";"))]
        widths = np.array([len(str(i)) + 1 for i in range(max(size, self.b_size))], np.int64)
        self.widths, self.places = widths, np.cumsum(widths) - widths
        self.flat_digits = np.frombuffer(b"".join(self.digits), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        #: per part: whether its tokens give it back, how many tokens, groups and links it has, its groups in decimal
        self.good, self.numbers, self.groups = np.zeros(0, bool), np.zeros((0, 4), np.int64), []
        #: pairs of ids of all parts' links one after another
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Work out parts not met before, all at once."""
        ids = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        pieces = self.b.encode([p[1:] for p in parts], num_threads=1)
        raw = [p.encode() for p in parts]
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = np.array([b"".join(map(a_bytes, x)) == r == b"".join(map(b_bytes, y)) for x, y, r in zip(ids, pieces, raw, strict=True)], bool)
        if not good.all():
            ids, pieces = ([x if g else [] for x, g in zip(t, good, strict=True)] for t in (ids, pieces))
        n_a, n_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (ids, pieces))
        a, b = (np.fromiter(chain.from_iterable(t), np.int64, n.sum()) for t, n in ((ids, n_a), (pieces, n_b)))
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        first = np.searchsorted(b_ends, a_ends - self.a_length[a], "right")
        partners = np.searchsorted(b_ends, a_ends) - first + 1
        before = np.cumsum(partners) - partners
        pairs = np.repeat(a * self.b_size, partners) + b[np.repeat(first - before, partners) + np.arange(partners.sum())]
        # tokens in the order of groups, those of the first vocabulary first, each with the sign that follows
        group = np.concatenate([a_group, b_group])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side, token = group[order], side[order], np.concatenate([a, b])[order]
        sign = np.where(np.append(group[1:], -1) != group, 2, np.where(np.append(side[1:], -1) != side, 1, 0))
        text = W.gathered(self.flat_digits, self.places[token] + sign * len(self.digits[0]), self.widths[token]).tobytes()
        text_ends = np.append(0, np.cumsum(self.widths[token]))[np.cumsum(n_a + n_b)]
        # numbers of each part
        links = np.diff(np.append(0, np.append(0, np.cumsum(partners))[np.cumsum(n_a)]))
        groups = np.diff(np.append(0, np.append(0, a_group + 1)[np.cumsum(n_a)]))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.good = np.concatenate([self.good, good])
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, groups, links], axis=1)])
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(links) - links])
        self.pairs = np.concatenate([self.pairs, pairs])
        told = text_ends.tolist()
        self.groups += [text[x:y] for x, y in zip([0, *told[:-1]], told, strict=True)]
        # a part in the table and in lists takes about 250 bytes besides its text, digits and pairs
        self.held += 250 * len(parts) + 2 * sum(map(len, raw)) + len(text) + 8 * len(pairs)

    def runs(self, column: pa.Array, limit: int = 2 << 20):
        """(first row, numbers (row, 4), digests, row of each link, pair of each link) of runs of whole texts."""
        for lo, hi, buf, offs in W.chunks(column, limit):
            if self.held > REMEMBERED_BYTES:
                self._forget()
            some = np.flatnonzero(np.diff(offs))
            numbers, digests = np.zeros((hi - lo, 4), np.int64), [""] * (hi - lo)
            if not len(some):
                yield lo, numbers, digests, np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            data = np.insert(buf, offs[some], 32)
            begins = offs[some] + np.arange(len(some))
            cut = np.zeros(len(data), bool)
            cut[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & _AFTER[data[2:]]
            cut[begins] = True
            at = np.flatnonzero(cut)
            codes, parts = W.coded(data, np.diff(at, append=len(data)), pa.string())
            parts = parts.to_pylist()
            place = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
            missing = np.flatnonzero(place < 0)
            if len(missing):
                place[missing] = len(self.known) + np.arange(len(missing))
                self._learn([parts[i] for i in missing])
            place = place[codes]
            first = np.append(np.searchsorted(at, begins), len(at))
            good = np.add.reduceat(~self.good[place], first[:-1], dtype=np.int64) == 0
            numbers[some] = np.where(good[:, None], np.add.reduceat(self.numbers[place], first[:-1]), 0)
            held = place.tolist()
            for row, ok, x, y in zip(some.tolist(), good.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if ok:
                    digests[row] = hashlib.sha256(b"".join(map(self.groups.__getitem__, held[x:y]))[:-1]).hexdigest()
            owner = np.repeat(some, np.diff(first))
            use = np.repeat(good, np.diff(first))
            place, owner = place[use], owner[use]
            links = self.numbers[place, 3]
            yield lo, numbers, digests, np.repeat(owner, links), W.gathered(self.pairs, self.starts[place], links) if len(place) else np.zeros(0, np.int64)


@lru_cache(1)
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One per Python worker, so that parts stay known from task to task."""
    return Aligner(byte_level, pieces)


_ROWS = "kind int, block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<int>, pairs array<long>, n array<long>"
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


def _lists(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, kind))


class _Block:
    """Documents gathered until they hold enough bytes."""

    def __init__(self):
        self.ids, self.numbers, self.digests, self.pairs, self.times, self.sizes, self.bytes = [], [], [], [], [], [], 0

    def add(self, ids: pa.Array, numbers, digests, owner, pairs, size: int) -> None:
        # pairs are numbers under 2**31, and a run has fewer rows than that
        key, times = np.unique((owner << 31) | pairs, return_counts=True)
        self.ids.append(ids)
        self.numbers.append(numbers)
        self.digests += digests
        self.pairs.append(key & ((1 << 31) - 1))
        self.times.append(times)
        self.sizes.append(np.bincount(key >> 31, minlength=len(ids)))
        self.bytes += size

    def rows(self, block: int):
        """A row per document with the places of its distinct pairs, and one with the block's distinct pairs."""
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.concatenate(self.times)
        total = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64)
        numbers, sizes = np.concatenate(self.numbers), np.concatenate(self.sizes)
        n = len(numbers)
        void = _lists(np.zeros(0, np.int64), np.zeros(n, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block)), pa.concat_arrays(self.ids), *(pa.array(numbers[:, i]) for i in range(4)),
            pa.array(self.digests, pa.string()), _lists(at, np.cumsum(sizes), pa.int32()), _lists(times, np.cumsum(sizes), pa.int32()), void, void,
        ], names=_NAMES)
        none = [pa.nulls(1, t) for t in (pa.int64(),) * 5]
        empty = _lists(np.zeros(0, np.int32), np.zeros(1, np.int64), pa.int32())
        one = np.array([len(pairs)])
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([block]), *none, pa.nulls(1, pa.string()), empty, empty, _lists(pairs, one, pa.int64()), _lists(total, one, pa.int64())], names=_NAMES)


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one block with the corpus-wide counts of their links added up."""
    order = np.argsort(counts["at"].to_numpy())
    count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
    at, times = (documents[c].combine_chunks() for c in ("at", "times"))
    ends = np.append(0, np.cumsum(at.value_lengths().fill_null(0).to_numpy()))
    at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    add = lambda v: pa.array(np.diff(np.append(0, np.cumsum(v))[ends]).astype(np.int64))
    out = documents.select(["id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", add(times * best[at])).append_column("count_sum", add(times * count[at])).append_column("groups_sha256", documents["groups_sha256"])


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): numbers of every document, and how often each pair of ids is linked in all of them.

    byte_level: vocabulary file of a byte-level tokenizer; pieces: model file of one that cuts pieces and adds a space.
    """

    def run(batches):
        kernel, task, blocks, block = aligner(byte_level, pieces), TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for lo, numbers, digests, owner, pairs in kernel.runs(batch.column(1)):
                part = batch.slice(lo, len(numbers))
                block.add(part.column(0), numbers, digests, owner, pairs, part.column(1).nbytes)
                if block.bytes >= block_bytes:
                    yield from block.rows(task << 32 | blocks)
                    blocks, block = blocks + 1, _Block()
        if block.ids:
            yield from block.rows(task << 32 | blocks)
        give_back()

    rows = durable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _ROWS), "aligned")
    held = rows.where("kind = 1").select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.n").alias("n"))
    salted = held.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    b_size = aligner_size(pieces)
    b_id = F.pmod("pair", F.lit(b_size))
    counts = durable(salted.groupBy("pair").agg(F.sum("n").alias("count")).select("pair", F.expr(f"pair div {b_size}").alias("a_id"), b_id.alias("b_id"), "count"), "alignment")
    highest = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    judged = counts.join(F.broadcast(highest), "b_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))  # at most a row per entry of the vocabulary
    replies = held.select(F.col("block").alias("to"), "at", "pair").join(judged, "pair").select("to", "at", "count", "best")
    documents = rows.where("kind = 0").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    schema = f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    summed = documents.groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(lambda d, c: _summed(d, c).rename_columns([f.split()[0].strip("`") for f in schema.split(", ")]), schema)
    return summed, counts.select("a_id", "b_id", "count")


@lru_cache(4)
def aligner_size(pieces: str) -> int:
    """Entries of a vocabulary of pieces."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces).vocab_size()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of all documents by two public vocabularies."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
