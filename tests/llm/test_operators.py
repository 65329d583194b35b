"""Each operator against brute force, an exact round trip or SQL, and on awkward rows."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, ngram_join, packing, quality_rules, sharding, spotsigs, tool_calls, toxicity, url_filter, warc, words
from factloom.llm.scratch import fresh

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n", "a", "a b", "A  b", "a\x0bb c d e f", "é è ü ñ 日本 語", "x " * 5000, "\n\na b\n\na b\n", "tab\tcr\r\nend", "the cat sat on the mat " * 3]


@pytest.fixture(scope="module")
def documents(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(ODD)] + [(10_005, "a b")], "doc_id long, text string")
    return own.unionByName(odd).cache()


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def brute_components(rows, k, percent):
    sets = {}
    for i, x in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_ngram_join(documents, rows, k, percent):
    expected = brute_components(rows, k, percent)
    got = ngram_join.components(documents, k, percent).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in got)


def test_ngram_join_near_copies(spark):
    """A text and many copies with an edit each: linked through the text, though not all with each other."""
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for _ in range(1 + i % 3):
            w[random.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    expected = brute_components(rows, 3, 90)
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def brute_links(rows, k, percent):
    """Of each id, the other ids with a similar set; plain pairs over an inverted index."""
    sets, holders = {}, collections.defaultdict(set)
    for i, x in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        for g in sets[i]:
            holders[g].add(i)
    return {i: sum(100 * len(s & sets[j]) >= percent * len(s | sets[j]) for j in set().union(*(holders[g] for g in s)) - {i}) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_ngram_join_links(spark, documents, rows, k, percent):
    """Every link counts: among the documents, and among more near copies than one block holds, with exact copies."""
    random.seed(5)
    base = [f"w{i}" for i in range(120)]
    copies = []
    for i in range(20_000, 20_450):
        w = list(base)
        for _ in range(i % 4):
            w[random.randrange(120)] = f"x{i % 300}"
        copies.append((i, " ".join(w)))
    more = spark.createDataFrame([*copies, copies[7], (None, copies[7][1])], "doc_id long, text string")
    expected = brute_links([*rows, *copies], k, percent)
    assert max(expected.values()) > 200
    got = ngram_join.components(documents.select("doc_id", "text").unionByName(more), k, percent).collect()
    assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == expected
    assert [r.n_links for r in got if r.doc_id is None] == [None]


def test_ngram_join_empty(spark, documents):
    assert ngram_join.components(documents.where("false")).count() == 0
    kept = ngram_join.keep_one(spark.createDataFrame([(1, "a b c d e", 7), (2, "a b c d e", 8), (2, "a b c d e", 8), (None, "q", 9)], "doc_id long, text string, n long"))
    assert sorted((r.doc_id or 0, r.n) for r in kept.collect()) == [(0, 9), (1, 7)]


def test_toxicity(spark):
    random.seed(1)
    vocabulary = [f"word{i}" for i in range(300)]
    made = []
    for i in range(1500):
        words = random.choices(vocabulary, k=60)
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                words.insert(random.randrange(60), random.choice(["vile", "nasty", "rotten"]))
        made.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in made if i % 2 == 0] + [(None, 1), (3, None)], "doc_id long, toxic int")
    scored = {r.doc_id: r.score["value"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(scored) == 1502 and all(0 <= s <= 1 for s in scored.values())
    wrong = sum((scored[i] >= 0.7) != bool(x) for i, _, x in made if zlib.crc32(str(i).encode()) % 3 == 1)
    assert wrong <= 5
    none = toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).first()
    assert none.score["value"] < 0.7


def test_toxicity_wide_vocabulary(spark):
    """240 toxic words, each in about 1.2 % of the toxic examples, are learned."""
    rng = np.random.RandomState(6)

    def example(toxic):
        words = [f"plain{i}" for i in rng.choice(2000, 40, replace=False)]
        return " ".join([*words, *(f"{i}vile" for i in rng.choice(240, 3, replace=False))] if toxic else words)

    made = [(i, example(i % 10 == 0), int(i % 10 == 0)) for i in range(36_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in made], "doc_id long, toxic int")
    judged = {r.doc_id: r.score["value"] >= 0.7 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    unseen = [(judged[i], x) for i, _, x in made if zlib.crc32(str(i).encode()) % 3 == 1]
    caught, harmed = (np.mean([hit for hit, x in unseen if x == side]) for side in (1, 0))
    assert caught >= 0.5 and harmed <= 0.01


def brute_word_features(text):
    """Features by plain loops: each word and its beginnings, and how often the text has them (to three)."""
    seen = collections.Counter()
    for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
        w = w.encode()
        for _ in range(4):
            if len(w) > 1 and w[-1:] in toxicity_marks:
                w = w[:-1]
            if len(w) > 1 and w[:1] in toxicity_marks:
                w = w[1:]
        seen.update([(0, w)] + [(n, w[:n]) for n in (4, 5, 6)])
    return {brute_bucket(k, *f) for f, n in seen.items() for k in (1, 2, 3) if n >= k}


@functools.lru_cache(None)
def brute_bucket(k, n, word):
    """Features meet in 2**20 buckets, so the place of each is taken over; all else is counted anew."""
    h = words.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), True)
    own = int((words.mix(h + words.U(n)) if n else h)[0]) >> 44
    return {1: own, 2: own * 5 + 77_773, 3: own * 9 + 55_511}[k] % 2**20


toxicity_marks = [bytes([c]) for c in b".,;:!?\"'()[]{}*#$%&|<>-_"]


def test_toxicity_equals_brute_force(spark):
    """The whole query against plain Python: features by loops, their counts, a dense matrix, and the same descent."""
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, brute_word_features(r.text), r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    learned = {i: x for i, x in marks.items() if not out(i)}
    texts = {}
    for i, _, t in sorted(docs, key=lambda d: d[0]):
        if learned.get(i) == 1:
            texts.setdefault(t, i)
    positive_ids = set(texts.values())
    every = [f for i, f, _ in docs if not out(i)]
    positive = [f for i, f, _ in docs if i in positive_ids]
    a, b = (collections.Counter(x for f in part for x in f) for part in (positive, every))
    n_p, n_u = len(positive), len(every)
    kept = []
    for x, n in b.items():
        r = (a[x] + n) / (n_p + n_u)
        cells = [(a[x], n_p * r), (n_p - a[x], n_p * (1 - r)), (n, n_u * r), (n_u - n, n_u * (1 - r))]
        g = 2 * sum(k * np.log(k / e) for k, e in cells if k)
        if g >= 16 and (a[x] if a[x] / n_p > n / n_u else n) >= 5:
            kept.append(x)
    kept.sort()
    dense = lambda part: np.array([[x in f for x in kept] for f in part], float).reshape(len(part), len(kept))
    matrix = {side: dense(part) for side, part in (("p", positive), ("u", every))}

    def step(weights, bias):
        sums = []
        for side in ("p", "u"):
            f = matrix[side] @ weights + bias
            s = 1 / (1 + np.exp(-f))
            sums.append((np.log1p(np.exp(f)).sum(), np.append(s @ matrix[side], s.sum())))
        return sums

    weights, bias = toxicity.train(step, matrix["p"].sum(axis=0), n_p, n_u, sum(learned.values()) / len(learned))
    assert len(kept) >= 5
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, f, _ in docs:
        expected = 1 / (1 + np.exp(-(bias + sum(w for x, w in zip(kept, weights) if x in f))))
        assert abs(got[i].score - expected) < 1e-5 and got[i].held_out == out(i) and got[i].predicted == int(got[i].score >= 0.7)


def test_toxicity_descent():
    """train() ends where no move lowers the risk by more than a fiftieth of what it gained (the risk has an edge at zero)."""
    rng = np.random.RandomState(3)
    x = {"p": (rng.rand(60, 6) < 0.5).astype(float), "u": (rng.rand(400, 6) < 0.25).astype(float)}

    def step(weights, bias):
        f = [x[side] @ weights + bias for side in "pu"]
        s = [1 / (1 + np.exp(-v)) for v in f]
        return [(np.logaddexp(0, v).sum(), np.append(p @ x[side], p.sum())) for side, v, p in zip("pu", f, s)]

    def risk(w, prior=0.2):
        f = {side: x[side] @ w[:-1] + w[-1] for side in "pu"}
        plus, minus = np.logaddexp(0, -f["p"]).mean(), {side: np.logaddexp(0, f[side]).mean() for side in "pu"}
        return prior * plus + max(0.0, minus["u"] - prior * minus["p"]) + 1e-3 * (w[:-1] ** 2).sum() / 2

    weights, bias = toxicity.train(step, x["p"].sum(axis=0), 60, 400, 0.2)
    found = np.append(weights, bias)
    gained = risk(np.append(np.zeros(6), np.log(0.2 / 0.8))) - risk(found)
    assert gained > 0 and all(risk(found) <= risk(found + rng.randn(7) * scale) + gained / 50 for scale in (0.01, 0.1, 1.0) for _ in range(200))


def test_ngram_join_shared_ids(spark):
    """Different texts under one id are documents of their own: no link and no text is lost."""
    base = [[f"{t}{i}" for i in range(60)] for t in "abcd"]
    text = [" ".join(b) for b in base]
    rows = [(1, text[0]), (1, text[1]), (2, text[0] + " more"), (3, text[1] + " more"), (4, text[2]), (4, text[2]), (4, text[3]), (4, ""), (4, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, th int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.components(docs).collect())
    assert got == sorted([(1, 58, 1, 1), (1, 58, 1, 1), (2, 59, 1, 1), (3, 59, 1, 1), (4, 58, 4, 0), (4, 58, 4, 0), (4, 58, 4, 0), (4, 0, 4, 0), (4, 0, 4, 0)])
    # with another first id, the two pairs are seen to be two components
    renamed = docs.withColumn("doc_id", F.when(F.col("th") == 1, 5).otherwise(F.col("doc_id")))
    assert {(r.doc_id, r.component_id) for r in ngram_join.components(renamed).collect()} == {(1, 1), (2, 1), (5, 3), (3, 3), (4, 4)}
    kept = ngram_join.keep_one(docs.select("th", "doc_id", "text"))
    assert kept.columns == ["th", "doc_id", "text"]
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter({(1, text[0]): 1, (1, text[1]): 1, (4, text[2]): 1, (4, text[3]): 1, (4, ""): 1, (4, None): 1})


@pytest.mark.parametrize("percent", [80, 90])
def test_ngram_join_bands(spark, percent):
    """A family of beginnings of one text, of all lengths: neighbouring bands of size meet, and no link is lost."""
    base = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(base[: 100 + i])) for i in range(600)]
    expected = brute_links(rows, 3, percent)
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).collect()
    assert {r.doc_id: r.n_links for r in got} == expected
    assert {r.component_id for r in got} == {0}


def test_toxicity_from_positives_alone(spark):
    """Without a single negative label: toxic texts are marked, clean texts are not."""
    text = lambda toxic, i: " ".join([f"plain{(i * 7 + j * (1 + i % 11)) % 90}" for j in range(30)] + (["vile", "nasty"] if toxic else []))
    docs = spark.createDataFrame([(i, text(i % 8 == 0, i)) for i in range(1200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 1200, 16)], "doc_id long, toxic int")
    for prior in (None, 0.125):
        scored = toxicity.score(docs, toxicity.fit(docs, labels, prior=prior)).collect()
        assert all((r.score.value >= 0.7) == (r.doc_id % 8 == 0) for r in scored)
    assert toxicity.drop_toxic(docs, labels).count() == 1050
    assert 0.1 < toxicity.estimated_prior(np.array([50, 40]), np.array([150, 900]), 50, 1200) < 0.13


def test_toxicity_labels_of_absent_documents(spark):
    """Labels of documents that an earlier stage dropped change nothing: neither the prior nor what is learned from."""
    rng = random.Random(4)
    text = lambda toxic: " ".join(rng.sample([f"plain{i}" for i in range(90)], 30) + (rng.sample(["vile", "nasty", "rotten"], 1) if toxic else []))
    docs = spark.createDataFrame([(i, text(i % 6 == 0)) for i in range(1800)], "doc_id long, text string")
    own = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 1800)], "doc_id long, toxic int").where("doc_id % 7 < 4")
    expected = toxicity.fit(docs, own)
    for toxic in (0, 1):
        labels = own.unionByName(spark.createDataFrame([(i, toxic) for i in range(10_000, 13_000)], "doc_id long, toxic int"))
        assert {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} == {i for i in range(1800) if i % 6}
        got = toxicity.fit(docs, labels, max_positive=200)
        assert list(got.buckets) == list(expected.buckets) and abs(got.intercept - expected.intercept) < 1e-6
    assert toxicity.drop_toxic(docs, labels.where("doc_id >= 10000")).count() == 1800


def test_toxicity_odd(spark):
    """Rows without an id, repeated rows, empty and very long texts, a column named score; an empty table."""
    text = lambda toxic, i: " ".join([f"plain{(i * 7 + j) % 90}" for j in range(30)] + (["vile", "nasty"] if toxic else []))
    rows = [(i, text(i % 5 == 0, i), "s") for i in range(600)] + [(None, text(True, 1), "s"), (None, None, "s"), (None, "", "s"), (7, text(False, 7), "s"), (7, text(False, 7), "s"), (9_000, "plain1 " * 20_000, "s"), (9_001, "vile nasty " * 20_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 2 and ids[7] == 3 and ids[9_000] == 1 and ids[9_001] == 0 and ids[5] == 0 and ids[6] == 1
    assert toxicity.drop_toxic(docs.where("false"), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.where("false")).count() == len(rows)


def brute_signatures(text):
    """Signatures as tuples of words, by plain loops over the text."""
    words = []
    for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
        for _ in range(2):
            if len(w.encode()) > 1 and w[-1] in ".,;:!?\"'()":
                w = w[:-1]
        words.append(w)
    anchors, out = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        chain = [x for x in words[i:] if x not in anchors][:3] if w in anchors else []
        if len(chain) == 3:
            out.add((w, *chain))
    return out or {(w,) for w in words}


def brute_likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_spotsigs_edits(documents, rows):
    """All columns against plain loops; rows without an id come last, equal ids are ordered by text."""
    more = documents.select("doc_id", F.lit("own").alias("part"), "text", F.lit(1).alias("guest"))
    rows = [*rows, (None, "of the no id a b c d"), (None, "of a"), (None, None)]
    more = more.unionByName(more.sparkSession.createDataFrame([(i, "x", t, 2) for i, t in rows[-3:]], "doc_id long, part string, text string, guest int"))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    made = spotsigs.with_edits(more).collect()
    got = collections.defaultdict(list)
    for r in made:
        got[r.doc_id, r.n_chars].append(r)  # one row, but for a row that is repeated
    assert len(made) == len(rows)
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, changed, next_ = map(brute_signatures, (text, edited, after))
        expected = (hashlib.sha256(edited.encode()).hexdigest(), len(own), len(changed), round(brute_likeness(own, changed), 9), round(brute_likeness(own, next_), 9))
        assert expected in [(r.edited_sha256, *(len(spotsigs.parsed(x)) for x in (r.fingerprint, r.edited_fingerprint)), round(r.near_edited, 9), round(r.near_next, 9)) for r in got[i, len(text)]]
    assert spotsigs.with_edits(documents.where("false")).count() == 0


def test_pruned_likeness():
    rng = np.random.RandomState(2)
    base = [np.unique(rng.randint(0, 2**32, rng.randint(0, 60), dtype=np.uint64).astype(np.uint32)) for _ in range(400)]
    other = [np.unique(np.concatenate([x[rng.rand(len(x)) < rng.rand()], base[i - 1][: rng.randint(0, 9)]])) for i, x in enumerate(base)]
    base += [np.arange(5_000, dtype=np.uint32), np.arange(7, dtype=np.uint32), np.zeros(0, np.uint32)]
    other += [np.array([3, 4_999, 9_000], np.uint32), np.arange(6, 4_000, dtype=np.uint32), np.arange(3, dtype=np.uint32)]
    for least in (0.0, 0.05, 0.5, 0.8, 0.95):
        plain = [spotsigs.likeness(a, b) for a, b in zip(base, other)]
        assert spotsigs.pruned_likeness(base, other, least).tolist() == [x if x >= least else 0.0 for x in plain]


def test_spotsigs_pairs(documents):
    prints = spotsigs.fingerprints(documents)
    first = {}
    for r in prints.where("size > 0").collect():
        first[r.fingerprint] = min(r.doc_id, first.get(r.fingerprint, r.doc_id))
    sets = sorted((i, set(spotsigs.parsed(x).tolist())) for x, i in first.items())
    expected = {(a, b) for n, (b, y) in enumerate(sets) for a, x in sets[:n] if len(x & y) >= 0.6 * len(x | y)}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(prints, 0.6).collect()} == expected


def test_tool_calls(spark, same):
    same(tool_calls.op4_tool_calls(spark, SF), tool_calls.OP4_SQL)


def test_tool_calls_odd(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "search", '{"query": "x", "limit": 3.5}', ["b"]), (1, "b", 5, "search", "{bad", []), (1, "a", 0, "nope", "[]", None), (2, "p", 1, "lookup", '{"z":1,"key":2}', ["q"]), (2, "q", 2, "lookup", '{"key":2}', ["p"]), (None, "q", 1, None, None, ["z"])],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", 3, "late"), (1, "a", 2, "early"), (9, "zz", 2, None)], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id, r.name): r for r in tool_calls.link(calls, results).collect()}
    assert got[1, "a", "search"].record == '{"arguments":{"limit":3.5,"query":"x"},"call_id":"a","name":"search","result":"early"}'
    assert got[1, "a", "search"].errors == "type:limit" and got[1, "a", "search"].level == 1 and got[1, "b", "search"].level == 0
    assert got[1, "b", "search"].errors == "json" and got[9, "zz", None].status == "orphan"
    assert got[2, "p", "lookup"].errors == "unknown:z" and got[2, "p", "lookup"].in_cycle
    assert tool_calls.link(calls.where("false"), results.where("false")).count() == 0


def test_tool_calls_without_names(spark):
    """Rows without a conversation or an identifier are each kept."""
    calls = spark.createDataFrame([(None, "a", 0, "lookup", '{"key":1}', None), (1, None, 1, "lookup", '{"key":1}', ["a"]), (1, None, 1, "lookup", '{"key":1}', ["a"]), (None, None, None, None, None, None)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, None, 2, "x"), (1, None, 3, "y"), (1, None, 3, "y"), (None, "a", 1, "z"), (None, None, None, None)], "conv_id long, call_id string, turn long, content string").withColumn("level", F.lit("own"))
    got = tool_calls.link(calls.withColumn("result", F.lit(1)), results).collect()
    assert collections.Counter(r.status for r in got) == {"unanswered": 4, "orphan": 5}
    assert all(r.level is None for r in got)


def test_tool_call_levels(spark):
    """Longest chains against plain recursion: a chain forwards of 300 calls, random dependencies, cycles."""
    random.seed(8)
    wants = {(1, f"c{i}"): [f"c{i + 1}"] for i in range(300)} | {(1, "c300"): None}
    wants |= {(2, f"c{i}"): [f"c{random.randrange(60)}" for _ in range(random.randrange(3))] if i < 20 else [f"c{random.randrange(i)}" for _ in range(random.randrange(3))] for i in range(60)}
    wants |= {(3, f"c{i}"): [f"c{j}" for j in random.sample(range(i), min(i, 2))] + ["gone"] for i in range(40)}

    def depth(node, above=()):
        if node in above:
            return None
        below = [depth((node[0], d), (*above, node)) for d in wants[node] or [] if (node[0], d) in wants]
        return None if None in below else 1 + max(below, default=-1)

    import sys

    sys.setrecursionlimit(5000)
    plain = {}
    for node in sorted(wants, key=lambda n: (n[0], -int(n[1][1:]))):
        plain[node] = 300 - int(node[1][1:]) if node[0] == 1 else depth(node)
    rows = [(c, i, 0, "lookup", '{"key":1}', d) for (c, i), d in wants.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(calls).collect()} == plain


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)]


def test_quality_counts(documents, rows):
    got = np.stack([x.to_numpy() for x in quality_rules.counts(pa.array([x for _, x in rows]))])
    for i, (_, text) in enumerate(rows):
        assert list(got[:5, i]) == brute_counts(text)


def test_quality_rules(spark):
    docs = spark.createDataFrame([(i, ("%%% " if i % 4 == 0 else "") + " ".join(f"word{i}x{j}" for j in range(40)) + ("".join(f" $$${j}" for j in range(20)) if i % 4 == 0 else ""), "c") for i in range(400)] + [(999, None, "c"), (998, "", "c")], "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(5, None)], "doc_id long, quality int")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4}
    assert quality_rules.keep_good(docs, labels.where("false")).count() == 400


def test_quality_names_that_clash(spark):
    """A column that has the name of a verdict keeps its content."""
    docs = spark.createDataFrame([(i, "plain words " * 20, f"s{i}", i, "r") for i in range(5)], "doc_id long, text string, stats string, kept long, RULE string")
    out = quality_rules.judge(docs, quality_rules.DecisionList())
    assert out.columns == [*docs.columns, "_stats", "_rule", "_kept"]
    assert sorted(r.stats for r in out.collect()) == [f"s{i}" for i in range(5)]


def test_sharding(spark, documents, rows):
    got = sharding.shard_texts(documents, 7).collect()
    assert len(got) == len(rows)
    shard_of, load, slots = {}, collections.Counter(), collections.defaultdict(list)
    text_of = dict(rows)
    for r in got:
        raw = (text_of[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        assert shard_of.setdefault(text_of[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_texts(documents.where("false"), 7).count() == 0


@pytest.mark.parametrize("n, shards, most", [(1, 3, 5), (30, 24, 1000), (2000, 24, 1000)])
def test_cut_points(spark, n, shards, most):
    random.seed(n)
    items = sorted((random.getrandbits(62), random.randint(1, most)) for _ in range(n))
    lo, hi = max(s for _, s in items), sum(s for _, s in items)
    while lo < hi:
        mid, used, part = (lo + hi) // 2, 1, 0
        for _, s in items:
            if part + s > mid:
                used, part = used + 1, 0
            part += s
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    cuts, capacity = sharding.cut_points(spark.createDataFrame(items, "at long, size long"), shards)
    load = collections.Counter(sum(at >= c for c in cuts) for at, s in items for _ in range(s))
    assert capacity == lo == max(load.values())


def test_byte_bpe(rows):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = byte_bpe.Encoder(path, P.PATTERN)
    random.seed(2)
    tokens = list(ranks)
    texts = [x or "" for _, x in rows] + ["a\n\n\nb  ", "foo\n bar", "  x", "\u2003a \u3000b", "a\x1cb", "=" * 77, "<|endoftext|> don't"]
    texts += [b"".join(random.choices(tokens, k=random.randint(1, 6))).decode("utf-8", "replace") for _ in range(1500)]
    for x in texts:
        ids = theirs.encode_ordinary(x)
        assert ours.digest(x) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
        assert "".join(byte_bpe.decode_stream(ids, ours.transducer.bytes_of)) == x


def test_utf8_machine():
    random.seed(4)
    parts = [0x41, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xED, 0xA0, 0xC3, 0xA9, 0xF4, 0x90, 0xFF]
    for _ in range(2000):
        data = bytes(random.choices(parts, k=random.randint(0, 12)))
        d = byte_bpe.Utf8Decoder()
        assert "".join(d.feed(data[i : i + 1]) for i in range(len(data))) + d.finish() == data.decode("utf-8", "replace")


def test_url_filter(spark, same):
    same(url_filter.op8_url_filter(spark, SF), url_filter.OP8_SQL)


def test_cascade(spark, monkeypatch):
    keys = spark.range(50_000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    wrong = lambda cascade: cascade.listed(keys.withColumn("words", F.lit(0)).withColumn("block", F.lit(0)), "key", "found").where("found <> listed").count()
    cascade = url_filter.build_cascade(keys)
    assert len(cascade.levels) > 1 and cascade.levels[0][1] > 1
    assert wrong(cascade) == 0
    plan = cascade.listed(keys, "key", "found")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    monkeypatch.setattr(url_filter, "HELD_BLOCKS", 1)  # larger levels by joins
    assert wrong(cascade) == 0
    empty = url_filter.build_cascade(keys.where("not listed"))
    assert empty.listed(keys, "key", "found").where("found").count() == 0
    full = url_filter.build_cascade(keys.where("listed"))
    assert full.listed(keys.where("listed"), "key", "found").where("not found").count() == 0


def test_url_filter_odd(spark):
    """An empty table, and repeated rows with columns of the operator's own names."""
    rows = spark.createDataFrame([(1, "http://a.net/x", "own", True)] * 3 + [(None, None, "own", False)], "page_id long, url string, host string, listed boolean")
    hosts = rows.select(url_filter.host_of(F.col("url")).alias("key")).distinct()
    judged = url_filter.judge(rows, url_filter.build_cascade(url_filter.listed_hosts(hosts))).collect()
    assert len(judged) == 4 and len({(r.page_id, r.host, r.verdict) for r in judged}) == 2
    none = rows.where("false")
    assert url_filter.judge(none, url_filter.build_cascade(url_filter.listed_hosts(hosts.where("false")))).count() == 0


def test_url_parts(spark):
    urls = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/x?y#z"), (4, "x://h?q"), (5, "x://h#/p"), (6, "x://"), (7, "a://b://c/d")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(urls, url_filter.Cascade([], 4)).collect()}
    assert got == {1: ("", "", None), 2: ("", "", None), 3: ("a.example.com", "/en/x", "example.com/en/"), 4: ("h", "", None), 5: ("h", "", None), 6: ("", "", None), 7: ("b:", "//c/d", None)}


def test_warc(spark, same):
    same(warc.op9_warc(spark, SF), warc.OP9_SQL)


def test_warc_round_trip(spark):
    rows = [(5, "http://a", "x"), (3, "u\r\n", "x"), (9, None, None), (7, "q", ""), (8, "z", "é" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(pages, fresh(spark, "archives"))
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == warc.sha1_base32(raw)
        assert got[i].record_type == "revisit" or bytes(got[i].payload) == raw
    assert (got[5].refers_to, got[9].refers_to, got[3].refers_to) == (3, 7, None)
    nameless = spark.createDataFrame([(None, "a", "x", 1), (None, "b", "x", 2), (4, "c", "x", 3), (6, None, "x", 4), (6, "again", "x", 5)], "page_id long, url string, html string, salt int")
    back = warc.read_records(warc.write_archives(nameless, fresh(spark, "archives"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in back) == [(0, "response", 0), (0, "response", 0), (4, "response", 0), (6, "revisit", 4), (6, "revisit", 4)]
    assert warc.read_records(warc.write_archives(pages.where("false"), fresh(spark, "archives"))).count() == 0
    some = warc.read_records(index.where("page_id in (3, 8)"))
    assert sorted(r.page_id for r in some.collect()) == [3, 8]


def test_packing(spark, documents, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    special = [(30_000 + i, x) for i, x in enumerate(["hello <|endoftext|> world", "x<|startoftext|>y<|ENDoftext|>", "é́ ́x\u00a0y\u2003z \x1ca", "İstanbul don't 12a's", "a" * 9000, "b " * 9000])]
    more = documents.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string")).withColumn("piece", F.lit("own"))
    got = packing.pack(packing.token_pieces(more, path, capacity=256), capacity=256).collect()
    ids = {}
    for i, x in [*rows, *special]:
        ids[i] = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 1]
    bins, total = collections.defaultdict(list), collections.Counter()
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.start == 256 * r.piece and len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * sum(r.length for r in got) / 256 + 1
    assert packing.pack(packing.token_pieces(documents.where("false"), path)).count() == 0


def brute_bins(lengths, capacity):
    """Best-two-fit as defined, one bin after another over a plain list."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        content, gap = [], capacity
        while (fits := [x for x in left if x <= gap]):
            content.append(fits[0])
            left.remove(fits[0])
            gap -= fits[0]
        while len(content) > 1 and gap:
            small = min(content)
            pairs = [(a + b, -min(a, b)) for i, a in enumerate(left) for b in left[:i] if small < a + b <= gap + small]
            if not pairs:
                break
            total, a = max(pairs)
            content.remove(small)
            content += [-a, total + a]
            left.remove(-a)
            left.remove(total + a)
            left = sorted([*left, small], reverse=True)
            gap += small - total
        bins.append(tuple(sorted(content)))
    return collections.Counter(bins)


def test_packing_memory_is_bounded(rows, monkeypatch):
    """What a worker remembers stays under its bound of bytes, or under what one run needs; ids stay the same."""
    import public_tokenizers

    made = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array([x for _, x in rows], pa.string())
    whole = [(lo, ids.tolist(), ends.tolist()) for lo, ids, ends in made.runs(texts, 1)]
    monkeypatch.setattr(packing, "RUN_BYTES", 1 << 14)
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 1 << 20)
    made._forget()
    cut, most = [], 0
    for _, ids, ends in made.runs(texts, 1):
        cut += np.split(ids, ends[1:-1])
        most = max(most, made.bytes)
        assert made.bytes >= packing.WORD_BYTES * len(made.known) + made.flat.nbytes
    assert most <= 1 << 20
    joined = [y.tolist() for _, ids, ends in whole for y in np.split(np.array(ids), ends[1:-1])]
    assert [x.tolist() for x in cut] == joined


def test_plan_bins_equals_brute_force():
    for seed in range(60):
        random.seed(seed)
        capacity = random.choice([10, 20, 60, 300])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 40))] + [random.randint(1, capacity)] * random.randint(0, 20)
        planned = collections.Counter()
        for content, times in packing.plan_bins(dict(collections.Counter(lengths)), capacity):
            planned[tuple(sorted(content))] += times
        assert planned == brute_bins(lengths, capacity)


def test_plan_bins():
    for seed in range(40):
        random.seed(seed)
        capacity = random.choice([10, 50, 4096])
        wanted = collections.Counter()
        for _ in range(random.randint(0, 200)):
            wanted[random.randint(1, capacity)] += random.choice([1, 1, 2, 30])
        packed = collections.Counter()
        for content, times in packing.plan_bins(dict(wanted), capacity):
            assert sum(content) <= capacity and times > 0
            for x in content:
                packed[x] += times
        assert packed == wanted


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_join", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = corpus_pipeline.good(spark, docs, SF)
    assert good.columns == docs.columns
    stats = {r.doc_id: brute_counts(r.text) for r in docs.collect()}
    assert all(stats[r.doc_id][0] >= 20 for r in good.collect())
    clean = {r.doc_id for r in labels.where("quality = 1").collect() if stats[r.doc_id][0] >= 20 and 100 * stats[r.doc_id][4] <= 30 * stats[r.doc_id][0]}
    assert clean <= {r.doc_id for r in good.collect()}
    one = corpus_pipeline.distinct(spark, docs, SF)
    expected = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in expected.items() if i == c}
    final = corpus_pipeline.run(spark, SF)
    left = corpus_pipeline.distinct(spark, corpus_pipeline.harmless(spark, good, SF), SF)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in left.collect()}


def test_pipeline_odd(spark, tmp_path):
    """Rows without an id, repeated rows, null and empty texts, clashing names; then empty tables."""
    import corpus_pipeline

    prose = lambda i: " ".join(f"w{x}" for x in random.Random(i).choices(range(5000), k=60))
    rows = [(i, prose(i), "own", 1) for i in range(200)] + [(3, prose(3), "own", 1), (500, prose(4), "own", 1), (None, prose(900), "own", 1), (None, None, "own", 1), (501, None, "own", 1), (502, "", "own", 1), (503, "one two", "own", 1), (504, "long " + prose(7) * 200, "own", 1)]
    schema = "doc_id long, text string, component_id string, piece int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"{tmp_path}/a")
        assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    # short texts go, of equal texts the smallest id stays, a row without an id stays
    assert ids == collections.Counter([*range(200), None]) or ids == collections.Counter([*range(200), None, 504])
    final = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert collections.Counter(r.doc_id for r in final if r.piece == 0) == ids
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_empty_tables(spark):
    """Every operator over no rows gives no rows."""
    import public_tokenizers as P

    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.token_digests(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert quality_rules.judge(none, quality_rules.DecisionList()).count() == 0
    assert sharding.shard_texts(none, 24).count() == 0
    assert spotsigs.near_pairs(spotsigs.fingerprints(none)).count() == 0
