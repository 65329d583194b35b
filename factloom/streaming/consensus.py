"""Consensus of inputs over a stream of facts: each micro-batch adds what it newly says, and no fact counts twice.

Facts that arrive again within the delay are dropped by their hash: a batch leaves the hashes of its facts in a table, and
the facts of the next meet them in an anti join, so executors hold no state in memory; a batch is read twice.  What the
sources of an input say together (how many, flags, extremes) can be merged, so a batch's new facts are aggregated by
themselves; of old facts only the hashes are read again.  The state is these aggregates, a table per batch, merged when they
are read; every few batches one table takes in all before it.  All tables lie in a folder that driver and executors share: a
batch that is run again, after a failure, starts from the same tables and writes the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.inputs import KEY, gated, merged, told

HASH, ARRIVED = "content_hash", "arrived"
#: What told() reads of a fact.
ASKED = [*KEY, "value", "multiplier", "raw_value", "currency", "value_type", "source_page", "extraction_method"]
#: The last of so many batches takes in the tables of all before it.
WHOLE_EVERY = 8


def with_hash(facts: DataFrame, arrived) -> DataFrame:
    """facts with the hash of their whole content and the time of their arrival.

    Equal facts of one load are sources of their own and told apart by a number; loaded again, they have the same hashes.
    The hash is 16 bytes of SHA-256 and 4 of the number.
    """
    content = F.unhex(F.substring(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256), 1, 32))
    numbered = facts.withColumn("_content", content).withColumn("_n", F.row_number().over(Window.partitionBy("_content").orderBy("_content")))
    return numbered.withColumn(HASH, F.concat("_content", F.unhex(F.lpad(F.hex("_n"), 8, "0")))).drop("_content", "_n").withColumn(ARRIVED, arrived)


def _tables(spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
    """Paths of the tables in folder by the number of their batch."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return {int(n.removeprefix(prefix)): f"{folder}/{n}" for n in names if n.startswith(prefix)}


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _seen(spark: SparkSession, folder: str, number: int, delay: str) -> tuple[DataFrame | None, int | None]:
    """Hashes from batches before this one that may arrive again, and the time (microseconds) up to which a fact is late."""
    paths = {n: p for n, p in _tables(spark, folder, "batch=").items() if n < number}
    if not paths:
        return None, None
    read = lambda some: spark.read.option("basePath", folder).parquet(*some)
    times = [F.unix_micros(F.max(ARRIVED) - F.expr(f"{k} * INTERVAL '{delay}'")).alias(name) for k, name in enumerate(("latest", "late", "gone"))]
    spans = {r.batch: r for r in read(paths.values()).groupBy("batch").agg(*times).collect()}
    late, gone = (max((r[name] for r in spans.values() if r[name] is not None), default=None) for name in ("late", "gone"))
    # what arrived the delay before the latest is late, so a hash of twice the delay before needs no remembering
    over = [n for n in paths if n not in spans or (spans[n].latest is not None and spans[n].latest < gone)]
    _delete(spark, [paths.pop(n) for n in over])
    if not paths:
        return None, None
    seen = read(paths.values()).select(HASH, ARRIVED)
    return seen if gone is None else seen.where(F.col(ARRIVED).isNull() | (F.col(ARRIVED) > F.timestamp_micros(F.lit(gone)))), late


def _parts(spark: SparkSession, folder: str, before: int) -> list[DataFrame]:
    """The state after all batches before this one, as tables to be merged."""
    paths = _tables(spark, folder, "state-")
    numbers = sorted(n for n in paths if n < before)
    whole = max((n for n in numbers if _takes_all(n)), default=0)
    return [spark.read.parquet(paths[n]) for n in numbers if n >= whole]


def _takes_all(number: int) -> bool:
    return number % WHOLE_EVERY == WHOLE_EVERY - 1


def _merged(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else merged(reduce(DataFrame.unionByName, parts))


def start(stream: DataFrame, folder: str, delay: str = "1 day") -> StreamingQuery:
    """Add a stream of facts (with content_hash and arrived) to the state in folder, until all that is there is read.

    delay: how long after its first arrival a fact may arrive again and still be known.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen, late = _seen(spark, f"{folder}/facts", number, delay)
        if late is not None:
            batch = batch.where(F.col(ARRIVED).isNull() | (F.col(ARRIVED) > F.timestamp_micros(F.lit(late))))
        batch.select(HASH, ARRIVED).write.mode("overwrite").parquet(f"{folder}/facts/batch={number}")
        # one shuffle and one sort by the hash serve both steps
        others = F.struct(*[c for c in batch.columns if c != HASH])
        new = batch.repartition(HASH).groupBy(HASH).agg(F.first(others).alias("fact")).select(HASH, "fact.*")
        if seen is not None:
            new = new.join(seen, HASH, "left_anti")
        state = told(new)
        if _takes_all(number):
            state = _merged([*_parts(spark, folder, number), state])
        state.write.mode("overwrite").parquet(f"{folder}/state-{number}")
        if _takes_all(number):
            # what it took in stays until the next, for a batch run again and for those who read it meanwhile
            _delete(spark, [p for n, p in _tables(spark, folder, "state-").items() if n < number - WHOLE_EVERY])

    # what has no name is no source of an input
    named = stream.where(F.col("canonical_name").isNotNull()).select(*ASKED, HASH, ARRIVED)
    return named.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def consensus(spark: SparkSession, folder: str) -> DataFrame:
    """What select_values() gives for all facts that have arrived."""
    parts = _parts(spark, folder, 1 << 62)
    if not parts:
        raise ValueError(f"no batch has been merged in {folder}")
    return gated(_merged(parts))
