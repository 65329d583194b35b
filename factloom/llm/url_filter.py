"""URL filters: prefix rules and an exact Bloom filter cascade, both native.

The cascade answers "is this key on the list?" exactly for every key of the corpus without joining the list: level 1
encodes the listed keys, level 2 the unlisted keys that level 1 lets through, level 3 the listed keys that level 2 lets
through, and so on until no false positive is left.  A key is listed if the first level that denies it has an even
number (counted from 1), or if all pass and the number of levels is odd.

A level is a blocked Bloom filter: a table of blocks of 32,768 bits, made by a bitmap aggregate per block.  A key has all
its bits in one block, so a row looks up one block a level.  A level of at most HELD_BLOCKS blocks is a value of the plan
(a scalar subquery) in which rows look up their bits without a join; a larger one stays a table, met by an equi join on
the block's number.  The list itself is never joined.  A level takes ``bits_per_key`` bits for each key that it encodes,
so its size follows the list and the (small) number of false positives, never the number of rows, and building it takes
time in proportion to the list.

Defined results: a null url or one without "://" has an empty host and path; an empty host is a key like any other;
an empty list lists nothing; repeated rows are judged alike; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, durable

BLOCK_BITS = 32_768
#: Levels of at most so many blocks (of 4 KB: 16 MB, 13 million keys) are held as values of the plan.
HELD_BLOCKS = 4_096

#: (host, path prefix, verdict); a rule fits its host and all subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z in lower case."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, nulls if none does; longer hosts first, then longer paths."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _block(key: Column, level: int, blocks: int) -> Column:
    """The block of a level that holds all bits of a key."""
    return F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(blocks).cast("long"))


def _bit(key: Column, level: int, i: int) -> Column:
    """Bit i of a key inside its block, by double hashing with an odd step."""
    h = F.xxhash64(F.lit(2 * level + 1), key)
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return F.pmod(h.bitwiseAND(F.lit((1 << 32) - 1)) + F.lit(i) * step, F.lit(BLOCK_BITS).cast("long"))


class Cascade:
    """Levels as (table of blocks, number of blocks); a block is 32,768 bits in an array of 512 words."""

    def __init__(self, levels: list[tuple[DataFrame, int]], hashes: int):
        self.levels, self.hashes = levels, hashes

    def passes(self, df: DataFrame, key: str, level: int, name: str) -> DataFrame:
        """df with a boolean column: whether a level's filter lets the key through.

        Each row looks up the one block of its key: in a value that every task holds, up to HELD_BLOCKS blocks, else by an
        equi join on the block's number.
        """
        table, blocks = self.levels[level]
        block = _block(F.col(key), level, blocks)
        if blocks <= HELD_BLOCKS:
            # every block is there, so a block's place in the array is its number
            held = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "words"))), lambda b: b["words"])).scalar()
            return df.withColumn(name, self._hit(F.get(held, block.cast("int")), key, level))
        met = df.join(table.withColumnsRenamed({"block": "_block", "words": "_words"}), block == F.col("_block"), "left")
        return met.withColumn(name, self._hit(F.col("_words"), key, level)).drop("_block", "_words")

    def _hit(self, words: Column, key: str, level: int) -> Column:
        """Whether all bits of a key are set in the words of its block."""
        hit = F.lit(True)
        for i in range(self.hashes):
            at = _bit(F.col(key), level, i)
            # bits are counted from the lowest of each byte, bytes from the highest of each word
            shift = (7 - F.shiftright(at, 3).bitwiseAND(F.lit(7))) * 8 + at.bitwiseAND(F.lit(7))
            hit = hit & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), shift.cast("int")) == 1)
        return F.coalesce(hit, F.lit(False))

    def listed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with a boolean column: exact membership for keys of the universe that the cascade was built over."""
        n = len(self.levels)
        for level in range(n):
            df = self.passes(df, key, level, f"_passes{level}")
        out = F.lit(n % 2 == 1)
        for level in reversed(range(n)):
            out = F.when(~F.col(f"_passes{level}"), F.lit(level % 2 == 1)).otherwise(out)
        return df.withColumn(name, out).drop(*[f"_passes{level}" for level in range(n)])


def _filter(keys: DataFrame, level: int, count: int, hashes: int, bits_per_key: int) -> tuple[DataFrame, int]:
    """The blocks (block, words) of a Bloom filter over column ``key``, and how many there can be."""
    blocks = max(1, -(-count * bits_per_key // BLOCK_BITS))
    bits = keys.select(_block(F.col("key"), level, blocks).alias("block"), F.explode(F.array(*[_bit(F.col("key"), level, i) for i in range(hashes)])).alias("bit"))
    # a row without a bit for every block, as blocks are found by their place
    bits = bits.unionByName(keys.sparkSession.range(blocks).select(F.col("id").alias("block"), F.lit(None).cast("long").alias("bit")))
    # every block is put together by one task from a bounded number of bits, so no task holds more than a few blocks
    made = bits.repartition("block").groupBy("block").agg(F.hex(F.bitmap_construct_agg("bit")).alias("hex"))
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.conv(F.substring("hex", w * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    return durable(made.select("block", words.alias("words")), "cascade-level"), blocks


def build_cascade(universe: DataFrame, hashes: int = 4, bits_per_key: int = 10) -> Cascade:
    """The cascade over distinct keys; universe has columns ``key`` (distinct, not null) and ``listed`` (boolean)."""
    universe = durable(universe.select("key", "listed"), "cascade-universe")
    encode, other = universe.where("listed").select("key"), universe.where("not listed").select("key")
    levels: list[tuple[DataFrame, int]] = []
    used = []
    while count := encode.count():
        levels = [*levels, _filter(encode, len(levels), count, hashes, bits_per_key)]
        wrong = durable(Cascade(levels, hashes).passes(other, "key", len(levels) - 1, "_passes").where("_passes").select("key"), "cascade-wrong")
        used.append(wrong)
        encode, other = wrong, encode
    drop(universe, *used)
    return Cascade(levels, hashes)


def listed_hosts(hosts: DataFrame) -> DataFrame:
    """Stands for an external block list: hosts whose MD5 begins with 0 to 4. Columns key and listed."""
    return hosts.select("key", F.substring(F.md5(F.col("key").cast("binary")), 1, 1).between("0", "4").alias("listed"))


def judge(pages: DataFrame, cascade: Cascade, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule's verdict, else block for listed hosts and allow for others."""
    base = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = cascade.listed(base.select(F.col(id_col), "host", "path", name.alias("rule"), verdict.alias("verdict")), "host", "_listed")
    return ruled.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    return judge(pages, build_cascade(listed_hosts(hosts)))


OP8_SQL = r"""
WITH parts AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), ruled AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
    END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE rule
        WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow'
        WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block'
        ELSE CASE WHEN substr(md5(host), 1, 1) BETWEEN '0' AND '4' THEN 'block' ELSE 'allow' END
    END AS verdict
FROM ruled
"""
