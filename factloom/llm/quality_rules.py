"""Quality rules: learned decision lists.

Per-document statistics are computed in one streaming pass.  From labelled statistics, sequential covering grows a
conjunction of thresholds that marks bad documents (largest FOIL gain first), prunes its last conditions on rows held
back, removes what it covers and goes on.  The list becomes one ordered Spark CASE expression, so that judging the
corpus is a projection without shuffles.

Fitting uses a bounded sample: at most ``max_labelled`` labelled rows (default 20,000), chosen by a hash of the id.
Everything else runs over all rows.

Defined results: null or empty text has no words and fails the base rules; labels that are null are ignored, several
labels of one document count as their minimum; without usable labels the list is empty and only the base rules act;
repeated rows are judged alike, each on its own; extra columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import annotate, unused

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
_FIELDS = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])
_WINDOW = 8
_SYMBOL, _UPPER, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?")] = True
_DIGIT[48:58] = True


def _per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many True lie between one offset and the next."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _own(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of one document."""
    return W.mix(hashes + docs.astype(W.U) * W.U(0xD1342543DE82EF95))


def counts(column: pa.Array) -> list[pa.Array]:
    """The COUNTS of each text of an Arrow array."""
    parts = []
    for lo, hi, buf, offs in W.chunks(column):
        n_docs = hi - lo
        starts, ends, first = W.word_bounds(buf, offs)
        n_words = np.diff(first)
        in_word = W._IS_WORD[buf]
        # lines: one starts with each document and after each line feed
        feeds = np.flatnonzero(buf == 10)
        line_start = np.unique(np.concatenate([offs[:-1], feeds + 1]))
        line_doc = np.searchsorted(offs, line_start, "right") - 1
        ok = line_start < offs[np.minimum(line_doc + 1, n_docs)]
        line_start, line_doc = line_start[ok], line_doc[ok]
        at = np.searchsorted(feeds, line_start)
        line_end = np.minimum(np.append(feeds, len(buf))[at], offs[line_doc + 1])
        full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
        key = _own(W.span_hashes(buf, line_start, line_end), line_doc)
        _, kept = np.unique(key, return_index=True)
        n_lines = np.bincount(line_doc, minlength=n_docs)
        n_dup = n_lines - np.bincount(line_doc[kept], minlength=n_docs)
        # words in windows found twice or more
        n_repeat = np.zeros(n_docs, np.int64)
        if len(starts) > _WINDOW:
            doc_of = np.repeat(np.arange(n_docs), n_words)
            windows = W.window_hashes(W.span_hashes(buf, starts, ends), _WINDOW)
            begin = np.flatnonzero(doc_of[: len(windows)] == doc_of[_WINDOW - 1 :])
            key = _own(windows[begin], doc_of[begin])
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            cover = np.zeros(len(starts) + 1, np.int64)
            cover[begin[twice]] += 1
            np.add.at(cover, begin[twice] + _WINDOW, -1)
            n_repeat = np.bincount(doc_of[np.cumsum(cover[:-1]) > 0], minlength=n_docs)
        parts.append(np.stack([
            n_words, _per_doc(in_word & (buf & 0xC0 != 0x80), offs), _per_doc(_SYMBOL[buf], offs), n_dup, n_repeat,
            n_lines, _per_doc(_UPPER[buf], offs), _per_doc(_MARK[buf], offs), _per_doc(_DIGIT[buf], offs),
        ]))
    table = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0))
    return [pa.array(row.astype(np.int64)) for row in table]


def with_counts(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs and a struct column with the COUNTS of its text."""
    return annotate(docs, text_col, counts, _FIELDS, name)


#: Ratios that the rules test, as (name, numerator, denominator); a denominator of 0 gives 0.
RATIOS = (
    ("mean_word", "word_chars", "n_words"),
    ("symbols", "n_symbols", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"),
    ("upper", "n_upper", "word_chars"),
    ("marks", "n_marks", "n_words"),
    ("digits", "n_digits", "word_chars"),
)


def ratio_columns(stats: Column) -> dict[str, Column]:
    """The tested features as Spark columns over the struct of counts."""
    made = {n: F.when(stats[d] > 0, stats[a].cast("double") / stats[d]).otherwise(F.lit(0.0)) for n, a, d in RATIOS}
    return made | {"words": stats["n_words"].cast("double")}


def base_failed(stats: Column) -> Column:
    """Fixed rules: under 20 words, or over 30 per cent of words in repeated windows."""
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, op, threshold); precision and cover as seen on the rows held back."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float = 1.0
    cover: int = 0


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects."""

    rules: list[Rule] = field(default_factory=list)

    def column(self, features: dict[str, Column]) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            hit = F.lit(True)
            for name, op, cut in rule.tests:
                hit = hit & (features[name] > cut if op == ">" else features[name] <= cut)
            out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _holds(x: dict[str, np.ndarray], tests) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), bool)
    for name, op, cut in tests:
        hit &= x[name] > cut if op == ">" else x[name] <= cut
    return hit


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.95, min_cover: int = 5, max_rules: int = 16, max_tests: int = 4, seed: int = 7) -> DecisionList:
    """Sequential covering over feature arrays; bad marks the rows that rules should cover.

    Two thirds of the rows grow rules, the rest prunes them.  A rule is taken only if its precision on either part is at
    least min_precision and it covers min_cover bad rows or more; the first that fails ends the list.
    """
    n = len(bad)
    out = DecisionList()
    if not n or bad.all() or not bad.any():
        return out
    grow = np.random.RandomState(seed).rand(n) < 2 / 3
    left = np.ones(n, bool)
    for _ in range(max_rules):
        a, b = left & grow, left & ~grow
        tests: list[tuple[str, str, float]] = []
        inside = a.copy()
        while len(tests) < max_tests and (inside & ~bad).any():
            p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not p0:
                break
            best = (0.0, None)
            for name, v in x.items():
                seen = np.sort(v[inside])
                cuts = np.unique(np.quantile(seen, np.linspace(0.01, 0.99, 99)))
                up, vb, vg = None, np.sort(v[inside & bad]), np.sort(v[inside & ~bad])
                for op in (">", "<="):
                    p, q = np.searchsorted(vb, cuts, "right"), np.searchsorted(vg, cuts, "right")
                    if op == ">":
                        p, q = len(vb) - p, len(vg) - q
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))), 0.0)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0] + 1e-12:
                        above = seen[np.searchsorted(seen, cuts[i], "right") :]
                        middle = (cuts[i] + above[0]) / 2 if len(above) else cuts[i]
                        best = (float(gain[i]), (name, op, float(middle)))
            if best[1] is None:
                break
            tests.append(best[1])
            inside &= _holds(x, tests[-1:])
        if not tests:
            break

        def worth(t):
            hit = b & _holds(x, t)
            p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - q) / (p + q) if p + q else -1.0

        options = [tuple(tests[:i]) for i in range(1, len(tests) + 1)]
        tests = max(options, key=lambda t: (worth(t), -len(t)))
        on_a, on_b = ((part & _holds(x, tests)) for part in (a, b))
        rates = [float((hit & bad).sum() / max(1, hit.sum())) for hit in (on_a, on_b)]
        cover = int(((on_a | on_b) & bad).sum())
        if min(rates) < min_precision or cover < min_cover:
            break
        out.rules.append(Rule(tests, rates[1], cover))
        left &= ~_holds(x, tests)
        if not (left & bad).any():
            break
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> DecisionList:
    """Learn a list from at most max_labelled labelled documents; label 0 marks bad ones."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) == 0).alias("_bad"))
    total = marks.count()
    if not total:
        return DecisionList()
    space = 1 << 30
    share = min(space, int(space * (0.95 * max_labelled / total))) if total > max_labelled else space
    marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(space)) < share).limit(max_labelled)
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(marks), "_id")
    stats = with_counts(some.select("_id", "_bad", "_text"), "_text", "_stats")
    rows = stats.where(~base_failed(F.col("_stats"))).select("_id", "_bad", *[c.alias(n) for n, c in ratio_columns(F.col("_stats")).items()]).limit(max_labelled).toPandas()
    rows = rows.sort_values("_id", kind="stable")
    names = [c for c in rows.columns if not c.startswith("_")]
    return learn({c: rows[c].to_numpy(float) for c in names}, rows["_bad"].to_numpy(bool))


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", stats_name: str = "stats", kept_name: str = "kept", rule_name: str = "rule") -> DataFrame:
    """docs with its counts, the number of the rule that rejected it (0: none) and whether it is kept.

    A name that docs has already gets underscores in front.
    """
    stats_name, kept_name, rule_name = (unused(docs, name) for name in (stats_name, kept_name, rule_name))
    out = with_counts(docs, text_col, stats_name)
    failed, hit = base_failed(F.col(stats_name)), rules.column(ratio_columns(F.col(stats_name)))
    return out.select("*", hit.alias(rule_name), (~failed & (hit == 0)).alias(kept_name))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the base rules and the learned list keep, with their own columns only."""
    stats, kept, rule = unused(docs, "_stats"), unused(docs, "_kept"), unused(docs, "_rule")
    judged = judge(docs, fit(docs, labels, text_col=text_col), text_col, stats, kept, rule)
    return judged.where(F.col(kept)).select(*docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base verdict and learned verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(docs, fit(docs, labels))
    stats = F.col("stats")
    return out.select("doc_id", *[stats[c].alias(c) for c in COUNTS[:5]], base_failed(stats).alias("base_failed"), "kept", "rule")
