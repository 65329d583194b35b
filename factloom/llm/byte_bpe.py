"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A token sequence is what merging by rank makes of a text exactly if each neighbouring pair is what merging makes of the
pair's own bytes.  So the merges compile into a nondeterministic transducer whose states are (last token, place in the
trie of tokens) and which may end a token wherever the pair check allows.  ``Transducer`` determinises it on demand: a
state is the set of paths still alive, each with the tokens it has not emitted yet; a step moves all paths by a byte,
drops those that cannot go on and emits the tokens that all of them share.  A path lives at most as long as the longest
token, which bounds the lookahead.  States and steps are made when first met and remembered up to a bound.

``Utf8Decoder`` turns token bytes into characters as they arrive, byte by byte through a small state machine, and keeps
an incomplete character until its last byte comes.  Texts are worked through in chunks that begin and end between matches
of the split pattern; equal chunks of a batch are encoded once, their ids are fed to the decoder one by one, and what comes
out must be the chunk.  As a chunk ends where a character ends, the decoder starts each one in its first state.

Defined results: a null text is empty and has no tokens; bytes that are no UTF-8 decode to U+FFFD in streaming text
output, while decoded bytes are always exact; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import give_back

#: Bounds of what one Python worker remembers: states of the transducer, pair checks, chunks of text and their bytes.
MAX_STATES, MAX_PAIRS, MAX_CHUNKS, MAX_BYTES = 300_000, 600_000, 1_200_000, 32 << 20

#: White space by Unicode outside ASCII.
WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (which is the id)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes byte strings by merge ranks, byte by byte with bounded lookahead."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        # trie nodes: children by byte, and the token that ends there
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for data, rank in ranks.items():
            node = 0
            for b in data:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        #: whether merging makes a token at all, once known
        self.made: list[bool | None] = [None] * (max(self.bytes_of) + 1)
        self.half: dict[int, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[int, bool], list[bytes]] = {}
        self._reset()

    def _reset(self) -> None:
        #: a state: tuple of (last token, trie node, tokens not emitted); node 0 means that a token has just ended
        self.states: list[tuple] = [((-1, 0, ()),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.paths: dict[tuple, tuple] = {}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """Merging by rank as defined, down to so many parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes a token; empty parts for a single byte, None if merging never makes it."""
        if token not in self.half:
            data = self.bytes_of[token]
            parts = self.merge(data, 2)
            self.half[token] = (b"", b"") if len(data) == 1 else (parts[0], parts[1]) if len(parts) == 2 else None
        return self.half[token]

    def edge(self, token: int, right: bool) -> list[bytes]:
        """What stands at a token's right or left end while it is merged, from a byte up to the token."""
        key = (token, right)
        if key not in self.edges:
            made = [self.bytes_of[token]]
            while (parts := self.halves(self.ranks[made[-1]])) and parts[0]:
                made.append(parts[right])
            self.edges[key] = made[::-1]
        return self.edges[key]

    def fits(self, last: int, token: int) -> bool:
        """Whether merging leaves these two tokens side by side.

        The ends that meet grow in the order of their ranks; the tokens part if at some moment the ends themselves merge
        before either of them grows (of equal ranks the leftmost goes first).
        """
        found = self.pairs.get((last, token))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ranks, a, b = self.ranks, self.edge(last, True), self.edge(token, False)
            i = j = 0
            never = 1 << 60
            while True:
                grow_a = ranks[a[i + 1]] if i + 1 < len(a) else never
                grow_b = ranks[b[j + 1]] if j + 1 < len(b) else never
                cross = ranks.get(a[i] + b[j], never)
                if cross < grow_a and cross <= grow_b and cross != never:
                    found = False
                    break
                if grow_a == grow_b == never:
                    found = True
                    break
                if grow_a <= grow_b:
                    i += 1
                else:
                    j += 1
            self.pairs[last, token] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        alive, ended = [], []
        children, token_at, pairs, made = self.children, self.token_at, self.pairs, self.made
        for last, node, owed in self.states[state]:
            nxt = children[node].get(byte)
            if nxt is None:
                continue
            if children[nxt]:
                alive.append((last, nxt, owed))
            token = token_at[nxt]
            if token < 0:
                continue
            fits = made[token]
            if fits is None:
                fits = made[token] = self.halves(token) is not None
            if fits and last >= 0:
                fits = pairs.get((last, token))
                if fits is None:
                    fits = self.fits(last, token)
            if fits:
                ended.append((token, 0, (*owed, token)))
        alive += ended  # oldest start first, what has just ended last: equal sets of paths come in equal order
        if not alive:
            raise ValueError("a byte that no token covers")
        shared = alive[0][2]
        for path in alive:
            owed, n = path[2], 0
            while n < len(shared) and n < len(owed) and shared[n] == owed[n]:
                n += 1
            shared = shared[:n]
        if shared:
            alive = [(last, node, owed[len(shared) :]) for last, node, owed in alive]
        key = tuple([self.paths.setdefault(x, x) for x in alive])
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        made = self.steps[state][byte] = (at, shared)
        return made

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one match of the split pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state, steps = 0, self.steps
        for byte in data:
            try:
                state, ready = steps[state][byte]
            except KeyError:
                state, ready = self._step(state, byte)
            if ready:
                out += ready
        for _, node, owed in self.states[state]:
            if node == 0:
                out.extend(owed)
                return out
        raise ValueError("no path ends here")


#: States of the UTF-8 machine: 0 start; 1-3 so many bytes to come; 4, 5, 6, 7 after E0, ED, F0, F4 (narrower second byte); -1 error.
def _utf8_table() -> list[list[int]]:
    table = [[-1] * 256 for _ in range(8)]
    for b in range(0x80):
        table[0][b] = 0
    for b in range(0xC2, 0xE0):
        table[0][b] = 1
    for b in range(0xE0, 0xF0):
        table[0][b] = {0xE0: 4, 0xED: 5}.get(b, 2)
    for b in range(0xF0, 0xF5):
        table[0][b] = {0xF0: 6, 0xF4: 7}.get(b, 3)
    for b in range(0x80, 0xC0):
        for state in (1, 2, 3):
            table[state][b] = state - 1
        table[4 if b >= 0xA0 else 5][b] = 1
        table[6][b], table[7][b] = (2, -1) if b >= 0x90 else (-1, 2)
    return table


class Utf8Decoder:
    """Incremental decoding: feed() returns the characters completed so far, finish() what is left."""

    table = _utf8_table()

    def __init__(self):
        self.state, self.held = 0, bytearray()

    def feed(self, data: bytes) -> str:
        if not self.state and data.isascii():
            return data.decode()
        out, table = [], self.table
        for b in data:
            nxt = table[self.state][b]
            if nxt < 0 and self.state:  # the character broke off; this byte starts anew
                out.append("�")
                self.state, self.held = 0, bytearray()
                nxt = table[0][b]
            if nxt < 0:
                out.append("�")
                continue
            self.held.append(b)
            self.state = nxt
            if not nxt:
                out.append(self.held.decode())
                self.held = bytearray()
        return "".join(out)

    def finish(self) -> str:
        left = "�" if self.held else ""
        self.state, self.held = 0, bytearray()
        return left


def decode_stream(ids, bytes_of: dict[int, bytes]):
    """Characters of a stream of ids, as soon as they are complete."""
    decoder = Utf8Decoder()
    for i in ids:
        if text := decoder.feed(bytes_of[i]):
            yield text
    if text := decoder.finish():
        yield text


_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
#: White space of two and three bytes in UTF-8, as numbers.
_WIDE = {n: np.sort([int.from_bytes(chr(c).encode()) for c in WIDE_SPACES if len(chr(c).encode()) == n]) for n in (2, 3)}


def cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing any match of the pattern: where they begin, and before each space that
    stands alone between characters that are no white space (such a space begins a match)."""
    n = len(buf)
    blank_at, blank_before = np.ones(n + 1, bool), np.ones(n + 1, bool)  # a text's ends count as white space
    blank_at[:n] = blank_before[1:] = _BLANK[buf]
    blank_before[0] = True
    for size, lead, codes in ((2, buf == 0xC2, _WIDE[2]), (3, (buf >= 0xE1) & (buf <= 0xE3), _WIDE[3])):
        at = np.flatnonzero(lead[: max(0, n - size + 1)])
        code = sum(buf[at + i].astype(np.int64) << (8 * (size - 1 - i)) for i in range(size))
        at = at[np.isin(code, codes)]
        blank_at[at] = True
        blank_before[at + size] = True
    blank_before[offs] = True
    begins = np.unique(offs[:-1][np.diff(offs) > 0])
    ends_here = np.zeros(n + 1, bool)
    ends_here[offs[1:]] = True
    alone = np.flatnonzero(buf == 32)
    alone = alone[~blank_before[alone] & ~blank_at[alone + 1] & ~ends_here[alone + 1]]
    return np.union1d(begins, alone)


class Encoder:
    """Whole texts to ids and back, with a memory of the chunks between cuts and of the matches in them."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.spelled = [b" %d" % i for i in range(max(self.transducer.bytes_of) + 1)]
        self.decoder = Utf8Decoder()
        self.known = {}
        self._age()
        gc.freeze()  # tables that live as long as the worker

    def _age(self) -> None:
        """Begin a new generation of memory; what is met again moves over from the last one, the rest is forgotten."""
        #: of each chunk and match met, the ids in decimal, each after a space, and the bytes decoded from them
        self.known: dict[bytes, tuple[bytes, bytes]]
        self.known, self.older, self.bytes = {}, self.known, 0

    def ids(self, text: str) -> list[int]:
        """Token ids of a text."""
        return [i for m in self.pattern.findall(text) for i in self.transducer.encode(m.encode())]

    def _kept(self, chunk: bytes, decimal: bytes, decoded: bytes) -> tuple[bytes, bytes]:
        # what was decoded is mostly equal to the chunk; then one object serves for both
        found = self.known[chunk] = decimal, chunk if decoded == chunk else decoded
        self.bytes += len(chunk)
        return found

    def _match(self, chunk: bytes) -> tuple[bytes, bytes]:
        """One match of the pattern; a new one is encoded, and its ids are decoded one by one."""
        found = self.known.get(chunk)
        if found is not None:
            return found
        found = self.older.get(chunk)
        if found is None:
            ids = self.transducer.encode(chunk)
            feed, bytes_of, spelled = self.decoder.feed, self.transducer.bytes_of, self.spelled
            text = "".join([feed(bytes_of[x]) for x in ids]) + self.decoder.finish()
            found = b"".join([spelled[x] for x in ids]), text.encode()
        return self._kept(chunk, *found)

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        """A chunk that this generation does not know: its matches one after another."""
        found = self.known.get(chunk)  # met as a part meanwhile
        if found is not None:
            return found
        found = self.older.get(chunk)
        if found is None:
            text = chunk.decode()
            # a space and letters are one match
            if text.isalpha() or (text[0] == " " and text[1:].isalpha()):
                return self._match(chunk)
            parts = [self._match(m.encode()) for m in self.pattern.findall(text)]
            if len(parts) == 1:
                return parts[0]
            found = tuple(map(b"".join, zip(*parts, strict=True)))
        return self._kept(chunk, *found)

    def _entries(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        if len(self.known) > MAX_CHUNKS // 2 or self.bytes > MAX_BYTES // 2:
            self._age()
        found = list(map(self.known.get, chunks))
        return [self._chunk(c) if e is None else e for c, e in zip(chunks, found, strict=True)]

    def digests(self, column: pa.Array):
        """(number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes decoded from them) of each text."""
        for lo, hi, buf, offs in W.chunks(column, 1 << 20):
            starts = cuts(buf, offs)
            codes, chunks = W.coded(buf, np.diff(starts, append=len(buf)), pa.binary())
            entries, decoded = zip(*self._entries(chunks.to_pylist()), strict=True) if len(chunks) else ((), ())
            total = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(np.array([e.count(b" ") for e in entries], np.int64)[codes], out=total[1:])
            first = np.searchsorted(starts, offs)
            count = np.diff(total[first]).tolist()
            hashes = []
            # the decimal ids lose their first space
            for made, skip in ((entries, 1), (decoded, 0)):
                joined = pa.array(made, pa.large_binary()).take(pa.array(codes))
                _, ends, data = joined.buffers()
                bounds = np.frombuffer(ends, np.int64)[first].tolist() if len(codes) else [0] * len(first)
                data = memoryview(data) if data is not None else memoryview(b"")
                hashes.append([hashlib.sha256(data[a + skip if b > a else a : b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            yield from zip(count, *hashes, strict=True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """digests() of one text."""
        return next(self.digests(pa.array([text], pa.string())))


@lru_cache(1)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker; it is the same for all tasks that the worker runs."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): token ids of each text, and the text decoded from them again."""
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            ids = [enc.ids(x or "") for x in batch.column(1).to_pylist()]
            back = ["".join(decode_stream(x, enc.transducer.bytes_of)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


_DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded again."""

    def run(batches):
        enc = encoder(path, pattern)
        gc.disable()  # there are no cycles to find among millions of long-lived objects
        try:
            for batch in batches:
                rows = list(enc.digests(batch.column(1)))
                n, ids, data = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], names=_DIGESTS.names)
        finally:
            gc.enable()
            give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _DIGESTS)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded by the 50k byte-level vocabulary and decoded again."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
