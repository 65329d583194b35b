"""Mixing sources to target weights.

Words are counted per source; every source gets a share of all of them by its weight, but never more than ``cap`` times its
own, and what it cannot take goes to the others by weight.  A document is then emitted floor(rate) times, and once more
with the probability of the rate's fraction.

Draws.  That last copy is a Bernoulli draw seeded by a hash of the document's id.  Independent draws would miss a small
source's target by chance (a fifth, with fifty documents of very unequal length), so draws are balanced: documents of a
source stand in the order of their size (to two digits) and, within a size, of their hash; one hash-seeded number per
source starts the draws, and a document gets its copy where the sum of fractions up to it passes a whole number.  Every
document keeps its probability, and the words taken miss the target by about one long document at most.

Defined results: null or empty texts have size 0; documents without a source are one source, the last; sources of size 0
have a target of 0 and take nothing; rows without an id are drawn like all others; repeated rows are drawn each on their
own, in any order; texts of any length are counted whole; ties of size and hash go by id; an empty table gives no rows;
other columns, whatever their names, are ignored by ``mixture`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import unused
from .ranks import ranked
from .scratch import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used at most so many times.
CAP = 3
#: A source's documents meet its target in so many shares, so that no task holds a whole hot source.
SHARES = 16


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (source_size, weight) with ``target``: all words shared by weight, none above cap times its size.

    What a full source cannot take raises the words per weight of the others, which may fill more sources, until none is
    above.  A step is one aggregate over sources; only two sums come to the driver.
    """
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, free, held = whole.words or 0, whole.weights or 1, 0
    full = F.col("source_size") * cap
    while True:
        per_weight = float(words - held) / float(free)
        above = full < F.col("weight") * F.lit(per_weight)
        step = sources.agg(F.coalesce(F.sum(F.when(above, full)), F.lit(0)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if step.held == held or not step.free:
            return sources.withColumn("target", F.when(above, full.cast("double")).otherwise(F.col("weight") * F.lit(per_weight)))
        held, free = step.held, step.free


def _unit(seed: str, of):
    """A number in [0, 1) from a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(of.cast("string"), F.lit("-"))).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def mixture(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row of docs, and a struct ``carried`` of the columns in carry."""
    carried = F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("string").alias("carried")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), carried), "mix-sizes")
    per_source = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull()), "mix-sources")
    placed, _ = ranked(per_source, [], ["last", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("index") % len(weights) + 1).cast("int")).cast("long")
    aimed = targets(durable(placed.select("source", "source_size", weight.alias("weight")), "mix-sources"), cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = aimed.select(F.col("source").alias("of"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"), _unit("start:", F.col("source")).alias("start"))
    aimed = aimed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    digits = F.pow(F.lit(10.0), F.greatest(F.length(F.col("size").cast("string")) - 2, F.lit(0))).cast("long")
    hashed = sized.withColumn("rough", F.col("size") - F.col("size") % digits).withColumn("draw", F.md5(F.concat(F.lit("draw:"), F.coalesce(F.col("id").cast("string"), F.lit("-"))).cast("binary")))
    drawn, _ = ranked(hashed, ["source"], ["rough", "draw", "id", "size"])
    met = drawn.withColumn("own", F.pmod("index", F.lit(SHARES))).join(aimed, F.col("source").eqNullSafe(F.col("of")) & (F.col("own") == F.col("share")))
    # the sum of fractions up to this document passes a whole number
    extra = F.floor(F.col("start") + (F.col("index") + 1) * F.col("part")) - F.floor(F.col("start") + F.col("index") * F.col("part"))
    copies = (F.col("whole") + extra).cast("long")
    return met.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "carried")


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as many times as the mix takes it; a further column counts its copies from 0."""
    copy = unused(docs, "copy")
    out = mixture(docs, weights, cap, id_col, source_col, text_col, carry=tuple(docs.columns)).where("copies > 0")
    return out.select("carried.*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias(copy))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken")


_U = "('0x' || md5({}))[1:14]::BIGINT / 281474976710656.0"
OP12_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, source_size, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INTEGER]::BIGINT AS w FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL)),
fill AS (SELECT 0 AS i, sum(source_size)::DOUBLE / sum(w)::DOUBLE AS per, 0::BIGINT AS held, sum(source_size)::BIGINT AS words FROM s
  UNION ALL SELECT i + 1, (any_value(words) - sum(CASE WHEN {CAP} * source_size < w * per THEN {CAP} * source_size ELSE 0 END))::DOUBLE / sum(CASE WHEN {CAP} * source_size < w * per THEN 0 ELSE w END)::DOUBLE,
    sum(CASE WHEN {CAP} * source_size < w * per THEN {CAP} * source_size ELSE 0 END)::BIGINT, any_value(words) FROM fill, s GROUP BY i HAVING i < 40),
lam AS (SELECT per FROM fill ORDER BY i DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN {CAP} * source_size < w * per THEN ({CAP} * source_size)::DOUBLE ELSE w * per END AS target FROM s, lam),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {_U.format("'start:' || coalesce(source, '-')")} AS start FROM t),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size - size % (10 ** greatest(length(size::VARCHAR) - 2, 0))::BIGINT, md5('draw:' || coalesce(doc_id::VARCHAR, '-')), doc_id NULLS FIRST, size) - 1 AS i FROM d)
SELECT doc_id, size, source_size, target, ((floor(rate) + floor(start + (i + 1) * (rate - floor(rate))) - floor(start + i * (rate - floor(rate)))) * size)::BIGINT AS taken FROM q JOIN r ON r.source IS NOT DISTINCT FROM q.source"""
