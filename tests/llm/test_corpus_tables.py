"""Manifest, mixing and alignment against plain Python, on odd tables too."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.llm import alignment, merkle, mixing
from factloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, source string, lang string, n_chars long, text string, `group` string, `index` long, block long, pair string, copy int, size long"
ROWS = [
    (3, "b", "en", 5, "one two three", "x", 1, 1, "p", 1, 1), (3, "b", "en", 5, "one two three", "x", 1, 1, "p", 1, 1), (3, "b", "en", 7, "another text", None, 2, 2, None, 2, 2),
    (None, None, None, None, None, None, None, None, None, None, None), (4, None, "en", None, "", "y", 3, 3, "q", 3, 3), (7, "a", None, 3, "  two  spaces ", "y", 3, 3, "q", 3, 3),
    (-5, "a", "de", 1, "x", "y", 3, 3, "q", 3, 3), (8, "a", "de", 2, "gr\u00fc\u00df <|endoftext|> <0x41> </s>", "y", 3, 3, "q", 3, 3), (9, "\U0001f600", "zh", 2, "\u4f60\u597d\u3000\u4e16\u754c \U0001f600", "y", 3, 3, "q", 3, 3),
    (10, "\uffff", "zh", 2, "a\u2581b", "y", 3, 3, "q", 3, 3), (11, "a", "zh", 2, "\n \u00a0x \u00a0\u00a0 y\t \tz '", "y", 3, 3, "q", 3, 3), (12, "a", "fr", 2, "it's 'twas o'clock 's x\u0000y", "y", 3, 3, "q", 3, 3),
    (13, "a", "fr", 2, "w" * 70000 + " tail", "y", 3, 3, "q", 3, 3), (14, "a", "fr", 2, "word and " * 30000, "y", 3, 3, "q", 3, 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, ODD)


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _up(level, member):
    """(top, siblings of each member on the way up, left to right)."""
    paths = {m: [] for m in member}
    at = {m: i for m, i in member.items()}
    while len(level) > 1:
        for m, i in at.items():
            paths[m].append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else ""))
            at[m] = i // 2
        level = [_h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def _manifest(rows):
    """The manifest by the definition: rows are (doc_id, source, lang, n_chars, text)."""
    told = lambda r: _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for lang in langs:
        mine = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, told(r)))
        found[lang] = (mine, *_up([told(r) for r in mine], {i: i for i in range(len(mine))}))
    root, tops = _up([found[x][1] for x in langs], {x: i for i, x in enumerate(langs)})
    out = []
    for lang, (mine, subroot, paths) in found.items():
        for i, r in enumerate(mine):
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = told((*r[:3], r[3] + 1, r[4])) if bad else told(r)
            way = paths[i] + tops[lang]
            for side, other in way:
                folded = _h(other, folded) if side else _h(folded, other)
            out.append((r[0], told(r), subroot, root, _h(*(x for _, x in way)), folded, folded == root))
    return out


def _checked(df, height=10):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.col("n_chars") + F.coalesce(hit.cast("long"), F.lit(0))
    return merkle.manifest(df, tampered=merkle.leaf_digest([changed if c == "n_chars" else F.col(c) for c in merkle.FIELDS]), height=height)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_against_plain_trees(spark, odd, height):
    many = spark.range(70).select("id", F.concat(F.lit("s"), F.col("id") % 3), F.when(F.col("id") < 40, "en").when(F.col("id") < 53, "de"), F.col("id"), F.lit("t"))
    for df in (odd, many.toDF(*merkle.FIELDS)):
        rows = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
        mine = sorted(map(tuple, _checked(df, height).collect()), key=repr)
        assert mine == sorted(_manifest(rows), key=repr)
        assert {r[6] for r in mine} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, odd):
    one = odd.where("doc_id = -5")
    assert [tuple(r) for r in _checked(one).collect()] == _manifest([tuple(r) for r in one.select(*merkle.FIELDS).collect()])
    assert merkle.manifest(odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_merkle", "op12_mixing"])
def test_same_as_sql(spark, same, name):
    assert same(QUERIES[name](spark, SF), ORACLES[name]) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_targets_fill_and_pass_on(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 400), ("d", 2), ("e", 300), ("f", 0)]
    df = spark.createDataFrame([(n, s, (5, 2, 1)[i % 3]) for i, (n, s) in enumerate(sizes)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    # shares of 1,712 words by weight, the excess over three times the size going to the others again and again
    share, full = {n: 0.0 for n, _ in sizes}, set()
    weight = {n: (5, 2, 1)[i % 3] for i, (n, _) in enumerate(sizes)}
    while True:
        left = 1712 - sum(3 * s for n, s in sizes if n in full)
        free = sum(w for n, w in weight.items() if n not in full)
        share = {n: 3.0 * s if n in full else left * weight[n] / free for n, s in sizes}
        more = {n for n, s in sizes if share[n] > 3 * s} - full
        if not more:
            break
        full |= more
    assert got == pytest.approx(share)
    assert sum(got.values()) == pytest.approx(1712) and len(full) > 2


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.mixture(odd).collect()
    assert len(rows) == len(ROWS)
    size = Counter()
    for r in ROWS:
        size[r[1]] += len(re.findall(r"[^ \t-\r]+", r[4] or ""))
    assert Counter(r.source_size for r in rows) == Counter(size[r[1]] for r in ROWS)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sorted(map(repr, mixing.mixture(odd).collect())) == sorted(map(repr, rows))
    assert mixing.mixture(odd.limit(0)).collect() == []


def test_mix_comes_near_targets_and_emits_rows(spark):
    ids = spark.range(6000)
    words = F.expr("case when id % 997 = 0 then 4000 else 1 + id % 120 end").cast("int")
    source = F.when(F.col("id") < 2400, "hot").when(F.col("id") < 2500, "small").otherwise(F.concat(F.lit("s"), F.col("id") % 4))
    docs = ids.select(F.col("id").alias("doc_id"), source.alias("source"), F.repeat(F.lit("w "), words).alias("text"), F.lit("kept").alias("copy"))
    taken = {(r.source_size, r.target): r.t for r in mixing.mixture(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()}
    assert len(taken) == 6
    assert all(abs(t - target) <= 4000 + 0.02 * target for (_, target), t in taken.items())
    mixed = mixing.mixed(docs)
    assert mixed.columns == ["doc_id", "source", "text", "copy", "_copy"]
    counted = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {r.doc_id: r.copies for r in mixing.mixture(docs).where("copies > 0").collect()}


def _aligned(docs, a_path, b_path):
    """Alignment token by token, by the tokenizers on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(a_path)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=b_path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    count, told = Counter(), []
    for i, text in docs:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_raw = [bytes(table[c] for c in a_model.id_to_token(x)) for x in a]
        b_raw = [bytes([int(b_model.id_to_piece(x)[3:5], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace("\u2581", " ").encode() for x in b]
        if not text or not (b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode()):
            a = b = a_raw = b_raw = []
        p = q = x = y = 0
        links, groups, left, right = [], [], [], []
        while p < len(a):
            links.append((a[p], b[q]))
            ends = x + len(a_raw[p]), y + len(b_raw[q])
            if ends[0] <= ends[1]:
                left.append(a[p])
                p, x = p + 1, ends[0]
            if ends[1] <= ends[0]:
                right.append(b[q])
                q, y = q + 1, ends[1]
            if ends[0] == ends[1]:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        count.update(links)
        told.append((i, len(a), len(b), groups, links))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    rows = [(i, n_a, n_b, len(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), _h(";".join(g)) if g else "") for i, n_a, n_b, g, k in told]
    return rows, count


@pytest.mark.parametrize("block", [2000, alignment.BLOCK_BYTES])
def test_alignment_token_by_token(spark, odd, block):
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    docs = odd.select("doc_id", "text", "block", "pair", F.lit(1).alias("at")).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "doc_id as block", "lang as pair", "2 as at"))
    rows, count = _aligned([(r.doc_id, r.text) for r in docs.collect()], *paths)
    made, pairs = alignment.align(docs, *paths, block_bytes=block)
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, rows))
    assert {(r.a_id, r.b_id): r["count"] for r in pairs.collect()} == dict(count)
    assert sum(r[1] == 0 for r in rows) >= 3


def test_alignment_forgets_and_goes_on(spark, monkeypatch):
    """A worker's memory that is full starts anew, which changes nothing."""
    import public_tokenizers
    import pyarrow as pa

    kernel = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = pa.array([r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()])
    whole = [(lo, n.tolist(), d, o.tolist(), p.tolist()) for lo, n, d, o, p in kernel.runs(texts, limit=4096)]
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 0)
    assert [(lo, n.tolist(), d, o.tolist(), p.tolist()) for lo, n, d, o, p in kernel.runs(texts, limit=4096)] == whole


def test_alignment_of_no_rows(spark, odd):
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert alignment.align(odd.limit(0), *paths)[0].collect() == []
