"""Facts that arrive bit by bit give what they give at once."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import inputs
from factloom.plans.catalog import facts
from factloom.streaming import consensus

SF = "/root/testdata/sf0.001"


def test_batches_equal_the_whole(spark, tmp_path):
    """Two rounds of arrival, the second with facts of the first again and with conflicts; no fact counts twice."""
    own = facts(spark, SF).where("doc_id <= 4")
    moved = own.where("canonical_name = 'revenue' and year = 1996").withColumn("value", (F.col("value") + 1).cast(own.schema["value"].dataType))
    whole = own.unionByName(moved)
    source, state = str(tmp_path / "in"), f"file://{tmp_path}/state"
    stamped = consensus.with_hash(whole, F.timestamp_seconds(F.col("year")))
    schema = stamped.schema
    run = lambda: consensus.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), state).awaitTermination()
    stamped.where("year < 1997").coalesce(1).write.parquet(source)
    run()
    first = consensus.consensus(spark, state)
    assert {r.year for r in first.select("year").distinct().collect()} == {r.year for r in own.where("year < 1997").select("year").distinct().collect()}
    stamped.where("year >= 1996").coalesce(1).write.mode("append").parquet(source)
    run()
    key = lambda df: sorted((tuple(r) for r in df.drop("pages").collect()), key=repr)
    assert key(consensus.consensus(spark, state)) == key(inputs.select_values(whole))
    assert consensus.consensus(spark, state).where("reason = 'CONFLICT'").count() > 0


def test_nothing_arrived(spark, tmp_path):
    with pytest.raises(ValueError):
        consensus.consensus(spark, f"file://{tmp_path}/none")


def _key(df):
    return sorted((tuple(r) for r in df.select(*inputs.KEY, "n_sources", "amount", "currency", "reason", F.array_sort("pages")).collect()), key=repr)


def test_state_lies_in_tables(spark, monkeypatch, tmp_path):
    """Four loads are four batches and no more, and executors hold no facts between them; facts without a year count too."""
    from factloom.plans import streams

    own = facts(spark, SF).where("doc_id <= 4")
    whole = own.unionByName(own.where("year = 1996 and doc_id = 2").withColumn("year", F.lit(None).cast("int")))
    monkeypatch.setattr(streams, "facts", lambda *_: whole)
    monkeypatch.setattr(streams, "fresh", lambda _, tag: f"file://{tmp_path}/{tag}")
    got = streams._streamed(spark, SF)
    plain = lambda df: sorted((tuple(r) for r in df.select(*inputs.KEY, "n_sources", F.round(F.col("amount").cast("double"), 6), "currency", "reason").collect()), key=repr)
    assert plain(got) == plain(inputs.select_values(whole))
    progress = tmp_path / "consensus/progress"
    assert {x.name for x in (progress / "commits").iterdir() if x.name.isdigit()} == {"0", "1", "2", "3"}
    assert not (progress / "state").exists()


def _batches(spark, tmp_path, loads, delay="1 day"):
    """Each load is one batch."""
    source, state = str(tmp_path / "in"), f"file://{tmp_path}/state"
    for load in loads:
        load.coalesce(1).write.mode("append").parquet(source)
        consensus.start(spark.readStream.schema(load.schema).parquet(source), state, delay).awaitTermination()
    return state


def test_a_whole_table_takes_in_those_before(spark, monkeypatch, tmp_path):
    """Seven batches of which every second takes in the tables before; each brings the facts of the one before again."""
    monkeypatch.setattr(consensus, "WHOLE_EVERY", 2)
    own = facts(spark, SF).where("doc_id <= 3")
    stamped = consensus.with_hash(own, F.timestamp_seconds(F.col("year"))).cache()
    state = _batches(spark, tmp_path, [stamped.where(f"year in ({y}, {y - 1})") for y in range(1996, 2003)])
    left = {n for n in range(7) if (tmp_path / f"state/state-{n}").exists()}
    assert left == {3, 4, 5, 6}
    assert _key(consensus.consensus(spark, state)) == _key(inputs.select_values(own.where("year between 1995 and 2002")))


def test_a_batch_that_is_run_again(spark, tmp_path):
    """The last batch is run again, as after a failure before it was noted as done, and gives the same state."""
    own = facts(spark, SF).where("doc_id <= 3")
    stamped = consensus.with_hash(own, F.timestamp_seconds(F.col("year"))).cache()
    state = _batches(spark, tmp_path, [stamped.where("year <= 1998"), stamped.where("year >= 1997")])
    once = _key(consensus.consensus(spark, state))
    for name in ("1", ".1.crc"):
        (tmp_path / "state/progress/commits" / name).unlink()
    consensus.start(spark.readStream.schema(stamped.schema).parquet(str(tmp_path / "in")), state).awaitTermination()
    assert (tmp_path / "state/progress/commits/1").exists()
    assert _key(consensus.consensus(spark, state)) == once == _key(inputs.select_values(own))


def test_facts_are_known_for_the_delay(spark, tmp_path):
    """A fact is known within the delay, late ones are left out, and what is forgotten counts again."""
    own = facts(spark, SF).where("doc_id = 3 and year = 1997 and canonical_name = 'total_assets'")
    at = lambda day: consensus.with_hash(own, F.timestamp_seconds(F.lit(86_400 * (100 + day))))
    count = lambda state: sorted(r.n_sources for r in consensus.consensus(spark, state).collect())
    other = consensus.with_hash(facts(spark, SF).where("doc_id = 5"), F.timestamp_seconds(F.lit(86_400 * 110)))
    assert count(state := _batches(spark, tmp_path, [at(0), at(0.5)])) == [1] * own.count() and own.count() > 0
    _batches(spark, tmp_path, [other])
    # late by now, and the hashes of the first batches are no longer there
    _batches(spark, tmp_path, [at(0)])
    own_only = lambda: sorted(r.n_sources for r in consensus.consensus(spark, state).where("doc_id = 3").collect())
    assert own_only() == [1] * own.count()
    assert not (tmp_path / "state/facts/batch=0").exists()
    _batches(spark, tmp_path, [at(10)])
    assert own_only() == [2] * own.count()
