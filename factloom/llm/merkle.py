"""Merkle dataset manifest: trees of digests over all rows, built and proved in Pregel-style supersteps.

Leaves stand in an order within their group (language); two neighbours become their parent's digest, level by level, until
one digest is left per group; the groups' digests in their order form one more tree, whose top is the root.

Supersteps.  A vertex is a node of the tree, and a message goes to the parent's number, half one's own.  Nodes are held in
blocks of 2**height neighbours, keyed by (group, number of the block).  In an upward superstep each block first delivers
the messages among its own nodes - parents whose children are all here complete, hash and forward at once - and sends the
one digest that leaves it to the block above.  In the reverse supersteps each block, given the siblings above it, sends
every child the siblings on its way up, until the leaves fold theirs and compare with the root.  So N leaves take
log(N) / height shuffles in each direction, each a 2**height-th of the one before; no task holds more than one block.

Defined results: nulls are the sign ``-``; null languages are a group of their own, the first; rows without an id come
first in their group and are not tampered with; repeated rows are leaves of their own, in any order; an empty table has
no rows and no root; a lone leaf is its group's digest; texts of any length are hashed whole by Spark; other columns of
any name are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import ranked
from .scratch import durable

#: Levels of the tree that one superstep climbs or descends.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself; ``-`` if null."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*told), 256)


def _spread(key) -> int:
    """Partition of a key, the same in every Python process."""
    return zlib.crc32(repr(key).encode())


def _levels(nodes: list[str], width: int, height: int) -> list[list[str]]:
    """Levels of a block from its own nodes up, where ``width`` is the number of nodes of the whole level; stops at the top."""
    out = [nodes]
    while width > 1 and len(out) <= height:
        low = out[-1]
        out.append([hashed(*low[i : i + 2]) for i in range(0, len(low), 2)])
        width = (width + 1) // 2
    return out


def _siblings(levels: list[list[str]], at: int) -> list[tuple[bool, str]]:
    """(whether it stands to the left, digest) of the sibling at each level below the block's top; '' if there is none."""
    out = []
    for low in levels[:-1]:
        other = at ^ 1
        out.append((other < at, low[other] if other < len(low) else ""))
        at >>= 1
    return out


def _blocks(width: int, height: int) -> int:
    """Number of blocks that hold ``width`` nodes."""
    return (width + (1 << height) - 1) >> height


def _steps(total: int, height: int) -> int:
    """Supersteps until a tree of so many leaves has one block."""
    steps = 1
    while (total := _blocks(total, height)) > 1:
        steps += 1
    return steps


class Forest:
    """Trees over leaves ((group, index, total), value), value[0] being the digest; one tree per group."""

    def __init__(self, leaves: RDD, largest: int, tasks: int, height: int):
        self.steps, self.tasks, self.height = _steps(largest, height), tasks, height
        mask = (1 << height) - 1
        messages = leaves.map(lambda r: ((r[0][0], r[0][1] >> height), (r[0][1] & mask, r[0][2], r[1])))
        self.blocks, tops = [], []
        for _ in range(self.steps):
            blocks = messages.partitionBy(tasks, _spread)
            self.blocks.append(blocks)
            done = blocks.groupByKey(tasks, _spread).map(lambda r: _upward(r, height))
            tops.append(done.filter(lambda r: r[1][1] == 1).map(lambda r: (r[0][0], r[1][0])))
            messages = done.filter(lambda r: r[1][1] > 1).map(lambda r: ((r[0][0], r[0][1] >> height), (r[0][1] & mask, r[1][1], (r[1][0],))))
        self.tops = leaves.context.union(tops)

    def descend(self, known: RDD) -> RDD:
        """(value, siblings up to the root, what was known) of every leaf.

        known: (group, (leaves of the group, siblings above its top, anything)).
        """
        height, sent = self.height, None
        for step in range(self.steps, 0, -1):
            ends = known.filter(lambda r, s=step: _steps(r[1][0], height) == s).map(lambda r: ((r[0], 0), r[1][1:])).partitionBy(self.tasks, _spread)
            got = ends if sent is None else ends.union(sent.partitionBy(self.tasks, _spread))
            met = _together(self.blocks[step - 1], got, self.tasks).flatMap(lambda r: _downward(r, height))
            sent = met.map(lambda r: ((r[0], r[1]), (r[3], r[4])))
        return met.map(lambda r: r[2:])


def _together(blocks: RDD, told: RDD, tasks: int) -> RDD:
    """(key, (messages of a block, what it is told)); both are dealt alike already, so nothing moves."""
    both = blocks.mapValues(lambda v: (0, v)).union(told.mapValues(lambda v: (1, v))).groupByKey(tasks, _spread)
    return both.mapValues(lambda vs: tuple([v for kind, v in vs if kind == side] for side in (0, 1)))


def _upward(record, height: int):
    """A block's digest for the block above, and how many blocks its level has."""
    key, messages = record
    held = sorted(messages, key=lambda m: m[0])
    width = held[0][1]
    return key, (_levels([m[2][0] for m in held], width, height)[-1][0], _blocks(width, height))


def _downward(record, height: int):
    """(group, number, value, siblings, known) of each node of a block."""
    (group, block), (messages, ((above, known),)) = record
    held = sorted(messages, key=lambda m: m[0])
    levels = _levels([m[2][0] for m in held], held[0][1], height)
    for at, _, value in held:
        yield group, (block << height) + at, value, [*_siblings(levels, at), *above], known


def _proved(record, root: str):
    """One row of the manifest."""
    (leaf, doc_id, tampered), siblings, subroot = record
    folded = tampered
    for left, other in siblings:
        folded = hashed(other, folded) if left else hashed(folded, other)
    return doc_id, leaf, subroot, root, hashed(*(d for _, d in siblings)), folded, folded == root


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group_col: str = "lang", tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    tampered: the digest with which a leaf is verified in place of its own, to see that a change is found.
    """
    spark = docs.sparkSession
    schema = f"`{id_col}` long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    leaf = leaf_digest([F.col(c) for c in fields])
    leaves = docs.select(F.col(group_col).alias("group"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), F.monotonically_increasing_id().alias("row"), (leaf if tampered is None else tampered).alias("tampered"))
    placed, largest = ranked(leaves, ["group"], ["id", "leaf", "row"])
    if not largest:
        return spark.createDataFrame([], schema)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.select("group", "index", "total", "leaf", "id", "tampered").rdd.map(lambda r: ((r[0], r[1], r[2]), (r[3], r[4], r[5])))
    trees = Forest(rows, largest, tasks, height)
    subroots = durable(spark.createDataFrame(trees.tops, "group string, subroot string"), "subroots")
    sizes = placed.where("index = 0").select(F.col("group").alias("g"), F.col("total").alias("leaves"))
    over, groups = ranked(durable(subroots.join(sizes, F.col("group").eqNullSafe(F.col("g"))).select("group", "subroot", "leaves"), "subroots"), [], ["group"])
    top = Forest(over.rdd.map(lambda r: ((0, r["index"], r["total"]), (r["subroot"], r["group"], r["leaves"]))), groups, tasks, height)
    root = top.tops.first()[1]
    known = top.descend(spark.sparkContext.parallelize([(0, (groups, [], None))], 1)).map(lambda r: (r[0][1], (r[0][2], r[1], r[0][0])))
    return spark.createDataFrame(trees.descend(known).map(lambda r: _proved(r, root)), schema, verifySchema=False)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of documents; where 7 divides the id's checksum, a leaf with n_chars one higher is verified."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.col("n_chars").cast("long") + F.coalesce(hit.cast("long"), F.lit(0))
    return manifest(docs, tampered=leaf_digest([changed if c == "n_chars" else F.col(c) for c in FIELDS]))


#: Checksum of a short ASCII text: eight shifts a byte, through a table of 256 numbers.
_CRC = """bits AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS) + ")"
OP11_SQL = f"""WITH RECURSIVE {_CRC},
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, crcs),
leaf AS (SELECT doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace('n_chars::', '(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::')} AS bad FROM d),
base AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
up AS (SELECT 0 AS lv, lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM base
  UNION ALL SELECT lv + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY lv, lang, i // 2),
subs AS (SELECT lang, lv, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM up WHERE n = 1),
top AS (SELECT 0 AS lv, j AS i, subroot AS h, count(*) OVER () AS n FROM subs UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY lv, i // 2),
way AS (SELECT b.doc_id, b.lang, b.i, u.lv, (b.i >> u.lv) & 1 AS bit, coalesce(s.h, '') AS sib FROM base b JOIN (SELECT DISTINCT lv, lang FROM up WHERE n > 1) u ON u.lang IS NOT DISTINCT FROM b.lang LEFT JOIN up s ON s.lv = u.lv AND s.lang IS NOT DISTINCT FROM b.lang AND s.i = xor(b.i >> u.lv, 1)
  UNION ALL SELECT b.doc_id, b.lang, b.i, 1000 + u.lv, (g.j >> u.lv) & 1, coalesce(s.h, '') FROM base b JOIN subs g ON g.lang IS NOT DISTINCT FROM b.lang JOIN (SELECT DISTINCT lv FROM top WHERE n > 1) u ON true LEFT JOIN top s ON s.lv = u.lv AND s.i = xor(g.j >> u.lv, 1)),
paths AS (SELECT lang, i, list(CASE WHEN bit = 1 THEN 'L' ELSE 'R' END || sib ORDER BY lv) AS path, string_agg(sib, '' ORDER BY lv) AS sibs FROM way GROUP BY ALL),
told AS (SELECT b.doc_id, b.leaf, g.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(p.sibs, '')) AS proof_sha256,
  list_reduce(list_prepend(b.bad, coalesce(p.path, [])), lambda a, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
  FROM base b JOIN subs g ON g.lang IS NOT DISTINCT FROM b.lang LEFT JOIN paths p ON p.i = b.i AND p.lang IS NOT DISTINCT FROM b.lang)
SELECT *, folded_root = root AS verified FROM told"""
