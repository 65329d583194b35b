"""Best-fit packing: best-two-fit.

Documents become token sequences; only those over the capacity are cut.  A bin is filled greedily (longest piece first,
then always the longest that still fits); then its smallest piece is replaced by two unpacked pieces that fit the gap
with it more tightly, as long as that helps.

Which pieces share a bin depends on their lengths alone, and there are at most ``capacity`` lengths.  So the driver sees
only a histogram of lengths, plans bins over it and repeats each bin while the counts allow: that gives the same bins as
packing one after another, with at most a few thousand patterns at any input size.  Pieces then find their place by
their rank among pieces of equal length, which is counted inside many small cells.

Defined results: null or empty text is one piece holding only the end id; repeated rows are packed each on their own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import give_back
from .scratch import drop, durable

#: Bytes that one Python worker remembers, and those of a word besides its letters and ids: an entry of a table, two
#: objects and two numbers.  Before it would hold more, the memory starts anew.
REMEMBERED_BYTES, WORD_BYTES = 64 << 20, 240
#: Bytes of text whose words are looked up at once; they may all be new.
RUN_BYTES = 1 << 20
#: A special token of the vocabulary.
BETWEEN = "<|startoftext|>"


#: Letters, digits and other signs of ASCII; bytes with the last bit stay with their neighbours (apostrophes, and all else).
_WHOLE = 8
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[:128] = 4
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = _WHOLE


class WordTokenizer:
    """Token ids of whole texts by a word-level vocabulary file; words met before come from memory.

    The tokenizer drops white space and never joins across it, and no special token holds any.  So a text's ids are those
    of its parts between ASCII white space one after another, whatever else the parts hold (other white space too).  It
    never joins letters, digits and other signs either, so parts are cut between those of ASCII (but not at apostrophes,
    which begin endings like 's), and it lowers letters, so parts are remembered in lower case.  Words that may hold a
    special token are taken as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        #: ids of all known words one after another, and where those of each word are
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Number of each word in memory; new ones are tokenised at once.

        What is held stays under REMEMBERED_BYTES, or under what the words of one run need if that is more.
        """
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing) and self.bytes + sum(map(len, words)) + WORD_BYTES * len(missing) > REMEMBERED_BYTES:
            self._forget()
            at, missing = np.full(len(words), -1, np.int64), np.arange(len(words))
        if len(missing):
            known = self.known
            new = [words[i] for i in missing]
            flat, lengths = self._encoded(new)
            first, size = len(known), len(self.flat)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            self.bytes += sum(map(len, new)) + WORD_BYTES * len(new) + flat.nbytes
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, size + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            at[missing] = np.arange(first, first + len(new))
        return at

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has.

        Many words go through the tokenizer as one text, with a special token between them that none of them holds.
        """
        held = [i for i, w in enumerate(words) if "<|" in w]
        if held:
            rest = sorted(set(range(len(words))) - set(held))
            made = dict(zip(held, (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([words[i] for i in held], add_special_tokens=False)), strict=True))
            flat, lengths = self._encoded([words[i] for i in rest])
            made |= dict(zip(rest, np.split(flat, np.cumsum(lengths)[:-1]), strict=True)) if rest else {}
            return np.concatenate([made[i] for i in range(len(words))]), np.array([len(made[i]) for i in range(len(words))], np.int64)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = ["".join([w + BETWEEN for w in words[i : i + 1000]]) for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.between)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def runs(self, column: pa.Array, end_id: int):
        """(first row, ids, offsets) of runs of whole texts; each text's ids end with end_id."""
        for lo, hi, buf, offs in W.chunks(column, RUN_BYTES):
            starts, ends, first = W.word_bounds(buf, offs)
            data = buf[W._IS_WORD[buf]]
            lower = W._LOWER[data]
            size = ends - starts
            kind = _KIND[data]
            cut = (kind[1:] != kind[:-1]) & ((kind[1:] | kind[:-1]) < _WHOLE)
            opens = np.flatnonzero(data == ord("<"))
            if len(opens):
                special = np.zeros(len(size), bool)
                special[np.searchsorted(np.cumsum(size), opens, "right")] = True
                keep = np.repeat(special, size)
                lower[keep] = data[keep]
                cut &= ~keep[1:]
            begins = np.cumsum(size) - size
            places = np.zeros(len(data) + 1, bool)
            places[begins] = True
            places[1:-1] |= cut
            parts = np.flatnonzero(places[:-1])
            first = np.searchsorted(parts, np.append(begins, len(data))[first])
            codes, words = W.coded(lower, np.diff(parts, append=len(data)), pa.string())
            at = self._numbers(words.to_pylist())[codes]
            lengths = self.lengths[at]
            total = np.zeros(len(at) + 1, np.int64)
            np.cumsum(lengths, out=total[1:])
            own = total[first]  # ids before each text, without ends
            ids = np.insert(W.gathered(self.flat, self.starts[at], lengths), own[1:], np.uint32(end_id))
            yield lo, ids, own + np.arange(hi - lo + 1)


@lru_cache(1)
def tokenizer(vocabulary: str) -> WordTokenizer:
    """One tokenizer per Python worker, so that words stay known from task to task."""
    return WordTokenizer(vocabulary)


_PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")])


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document: (doc_id, piece, start, length, ids_crc32)."""

    def run(batches):
        words = tokenizer(vocabulary)
        for batch in batches:
            for lo, ids, offsets in words.runs(batch.column(1), end_id):
                size = np.diff(offsets)
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                begin = 4 * (offsets[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))], names=_PIECES.names)
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _PIECES)


def _longest(present: list[int], limit: int) -> int:
    """Index of the longest present length of at most limit; -1 if there is none."""
    return bisect_right(present, limit) - 1


def plan_bins(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, how many such bins), packing all pieces of the histogram."""
    left = {k: v for k, v in histogram.items() if v > 0}
    present = sorted(left)
    plan = []

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            present.pop(bisect_right(present, length) - 1)

    def give(length: int) -> None:
        if not left.get(length):
            present.insert(bisect_right(present, length), length)
            left[length] = 0
        left[length] += 1

    def best_two(room: int) -> tuple[int, int, int]:
        """(sum, a, b) of the two present pieces whose sum comes closest to room from below."""
        best, i, j = (0, 0, 0), 0, _longest(present, room - 1)
        while 0 <= i <= j:
            a, b = present[i], present[j]
            if a + b > room or (i == j and left[a] < 2):
                j -= 1
                continue
            if a + b > best[0]:
                best = (a + b, a, b)
                if a + b == room:
                    break
            i += 1
        return best

    while present:
        content: list[int] = []
        gap = capacity
        while (i := _longest(present, gap)) >= 0:
            content.append(present[i])
            gap -= present[i]
            take(present[i])
        while gap and present and len(content) > 1:
            small = content[-1]
            total, a, b = best_two(gap + small)
            if total <= small:
                break
            content.pop()
            give(small)
            for x in (a, b):
                take(x)
                content.append(x)
            content.sort(reverse=True)
            gap += small - total
        used = {x: content.count(x) for x in content}
        more = min(left.get(x, 0) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= more * n
            if not left[x] and more:
                present.pop(bisect_right(present, x) - 1)
        plan.append((tuple(content), more + 1))
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length its runs of ranks: columns first rank, sequence of that rank, offset; a run has consecutive sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for content, times in plan:
        at = 0
        for x in content:
            runs.setdefault(x, []).append((ranks.get(x, 0), sequence, at))
            ranks[x] = ranks.get(x, 0) + times
            at += x
        sequence += times
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = durable(pieces, "pieces")
    placed = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    per_cell = durable(placed.groupBy("length", "cell").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in per_cell.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(slots(plan_bins(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_cell.select("length", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start"))
    ranked = placed.withColumn("rank", rank).join(offsets, ["length", "cell"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))
    schema = T.StructType([*_PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        table = runs.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rows = order[a:b]
                own = table[int(length[rows[0]])]
                i = np.searchsorted(own[:, 0], rank[rows], "right") - 1
                sequence[rows] = own[i, 1] + rank[rows] - own[i, 0]
                offset[rows] = own[i, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4,096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).withColumn("piece", F.col("piece").cast("int"))
