"""Streams against the batch upsert."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgelake.functions.identity import REPO_IDENTITY, with_fingerprint
from forgelake.operators import upsert
from forgelake.streaming.ingest import WriteLog, first_sightings, live_counts, newest_counts, upsert_stream

OBS = "owner string, name string, url string, stars bigint, seq bigint"


def batches():
    """Four batches of sightings whose order is that of ``seq``."""
    out, seq = [], 0
    for n in range(4):
        rows = []
        for i in range(40):
            seq += 1
            owner = "hot" if i % 3 == 0 else f"o{i % 7}"
            rows.append((owner, "n", f"u{(i * (n + 1) // 5) % 2}", seq, seq))
        out.append(rows)
    return out


def log_of(spark, root):
    schema = T.StructType([*spark.createDataFrame([], OBS).schema.fields, T.StructField("hash", T.StringType())])
    return WriteLog(spark, f"{root}/table", schema, upsert.REPO_KEY, ["seq"])


def state_of(df):
    return {(r.owner, r.name): (r.url, r.stars, r.hash) for r in df.collect()}


@pytest.mark.parametrize("compact_every", [None, 2])
def test_stream_equals_batch(spark, tmp_path, compact_every):
    log = log_of(spark, tmp_path)
    for rows in batches():
        spark.createDataFrame(rows, OBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        source = spark.readStream.schema(OBS).parquet(str(tmp_path / "landing"))
        query = upsert_stream(source, log, str(tmp_path / "checkpoint"), REPO_IDENTITY, compact_every=compact_every, chunk_rows=10)
        query.awaitTermination()
    every = spark.createDataFrame([r for b in batches() for r in b], OBS)
    want = upsert.upsert_repos(every, ["seq"]).drop("updated_at")
    assert state_of(log.state()) == state_of(want)
    # Only changes were written.
    written = upsert.written(upsert.classify(every, upsert.REPO_KEY, ["seq"], REPO_IDENTITY)).count()
    assert log._read("log", "batch_id").count() == written < every.count()
    assert (tmp_path / "table" / "base").exists() == bool(compact_every)


def test_replayed_batch_takes_effect_once(spark, tmp_path):
    log = log_of(spark, tmp_path)
    first, second = (with_fingerprint(spark.createDataFrame(b, OBS), REPO_IDENTITY) for b in batches()[:2])
    log.write(first, 0)
    log.write(second, 1)
    before = state_of(log.state())
    log.compact(1)
    log.write(second, 1)
    log.write(second, 1)
    assert state_of(log.state()) == before
    # A replay compares with the state before the batch, even after it was folded into a base.
    assert state_of(log.state(before=1)) == state_of(log.stored_for(second, 1).unionByName(
        log.state(before=1).join(second, ["owner", "name"], "left_anti")))
    assert log.state(before=0).isEmpty()


def test_live_counts(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "a"))
    spark.range(5).write.parquet(str(tmp_path / "b"))
    streams = {n: spark.readStream.schema("id bigint").parquet(str(tmp_path / n)) for n in ("a", "b")}
    query = live_counts(streams).writeStream.outputMode("complete").format("memory").queryName("counted")
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.entity: r.n for r in spark.table("counted").collect()} == {"a": 7, "b": 5}


def test_newest_counts_fill_in_empty_tables(spark, tmp_path):
    for batch, rows in enumerate([[("a", 3)], [("a", 5), ("b", 1)]]):
        spark.createDataFrame(rows, "entity string, n bigint").write.parquet(str(tmp_path / f"batch_id={batch}"))
    got = newest_counts(spark, str(tmp_path), ["a", "b", "none"]).collect()
    assert {r.entity: r.n for r in got} == {"a": 5, "b": 1, "none": 0}


def test_last_sighting_of_a_contact_wins_in_a_stream(spark, tmp_path):
    obs = "login string, url string, company string, seq bigint"
    schema = T.StructType([*T._parse_datatype_string(obs).fields, T.StructField("hash", T.StringType())])
    log = WriteLog(spark, str(tmp_path / "table"), schema, ["login"], ["seq"])
    for rows in ([("a", "u", "full", 1), ("b", "u", "full", 2)], [("a", "u", "", 3)]):
        spark.createDataFrame(rows, obs).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        source = spark.readStream.schema(obs).parquet(str(tmp_path / "landing"))
        upsert_stream(source, log, str(tmp_path / "checkpoint"), ("login", "url"), last_wins=True).awaitTermination()
    assert {r.login: r.company for r in log.state().collect()} == {"a": "", "b": "full"}


@pytest.mark.parametrize("bounded", [False, True])
def test_first_sightings_drop_a_returning_fingerprint(spark, tmp_path, bounded):
    rows = [("k", "A", "2024-01-01 00:00:00"), ("k", "B", "2024-01-01 00:00:01"), ("k", "A", "2024-01-01 00:00:02")]
    table = spark.createDataFrame(rows, "key string, hash string, ts string").withColumn("ts", F.to_timestamp("ts"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    options = {"event_time": "ts", "delay": "1 hour"} if bounded else {}
    name = f"firsts_{bounded}".lower()
    query = first_sightings(stream, ["key"], **options).writeStream.format("memory").queryName(name)
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.hash for r in spark.table(name).collect()) == ["A", "B"]
