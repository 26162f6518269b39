"""Streams give what the batch operators give, whatever order events arrive in."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.catalog.events import ERRORS, OPS, TAGS, _k, _mapped
from quillon.operators import lifecycle, policy, present, resolve
from quillon.sources.tables import event_stream, events
from quillon.streaming import ipc
from quillon.streaming.evidence import CLAIM, EvidenceStore, collect_evidence, first_hypotheses, latest_evidence
from quillon.streaming.lifecycle import replay_stream
from quillon.streaming.ordered import ROCKSDB
from quillon.streaming.present import deferred_present_stream, present_stream, present_to
from tests.conftest import SF

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)


@pytest.fixture(autouse=True)
def _on_disk(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drain(df, name, spark, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


def schema_of(df):
    return df.schema.simpleString()[7:-1].replace(":", " ")


def arriving(spark, of, tmp_path, files=4, spread=timedelta(days=3)):
    """Rows of ``of`` (ts, ...) in files, each displaced by up to ``spread`` in time and shuffled within its file; then one of a
    later time, whose coming says that all others are there."""
    r, rows = random.Random(6), [row.asDict() for row in of.collect()]
    at = {k: row["ts"] + spread * r.random() for k, row in enumerate(rows)}
    order = sorted(range(len(rows)), key=at.get)
    for k in range(files):
        part = order[len(order) * k // files : len(order) * (k + 1) // files]
        r.shuffle(part)
        spark.createDataFrame([tuple(rows[i].values()) for i in part], of.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = max(row["ts"] for row in rows)
    for days in (8, 16):
        end = dict.fromkeys(rows[0]) | {"ts": last + days * DAY, "event_id": -days, "user_id": -1}
        spark.createDataFrame([tuple(end[c] for c in of.columns)], of.schema).write.mode("append").parquet(str(tmp_path / "in"))
    return event_stream(spark, str(tmp_path / "in"), schema_of(of))


def test_lifecycle_stream_equals_batch_with_sizes_over_shuffled_input(spark, tmp_path):
    size = lambda most: F.when(F.col("event_type").isin("signup", "click") & (_k() % 11 > 0), _k() % most + 1)
    of = events(spark, SF).select("event_id", "user_id", "ts", _mapped(OPS).alias("op"), F.when(_k() % 5 > 0, _k() % 7 == 0).alias("is_first_frame"), size(400).alias("width"), size(300).alias("height"))
    of = of.unionByName(of.where("event_id % 9 = 0").withColumn("event_id", F.col("event_id") + 10**6))  # events of one time
    stream = replay_stream(arriving(spark, of, tmp_path), "user_id", late="4 days").where("key <> '-1'")
    names = ["event_id", "phase_before", "outcome", "phase", "output", "width", "height", "bytes", "stride", "damage"]
    got = drain(stream, "lifecycle", spark, tmp_path).select(*names)
    batch = lifecycle.replay(of, "user_id", ["ts", "event_id"])
    batch = batch.select(*names[:5], "surface.width", "surface.height", "frame.bytes", "frame.stride", "frame.damage")
    assert got.count() == of.count() and got.exceptAll(batch).count() == 0


def test_deferred_present_equals_batch_in_any_order(spark, tmp_path):
    r, rows = random.Random(2), []
    for key in range(60):
        for _ in range(r.randint(0, 4)):
            rows.append((f"k{key}", T0 + timedelta(milliseconds=r.randint(0, 3_000)), "surface"))
        for _ in range(r.randint(0, 6)):
            rows.append((f"k{key}", T0 + timedelta(milliseconds=r.randint(0, 3_000)), "scale"))
    rows += [("same", T0, "scale"), ("same", T0, "surface"), ("edge", T0, "surface"), ("edge", T0 + timedelta(milliseconds=100), "scale")]
    of = spark.createDataFrame(rows, "key string, ts timestamp, kind string")
    r.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], of.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for days in (1, 2):
        spark.createDataFrame([("end", T0 + days * DAY, "none")], of.schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), schema_of(of))
    got = {x.key: (x.present_us, x.cause) for x in drain(deferred_present_stream(stream, "key", late="10 seconds"), "deferred", spark, tmp_path).collect()}
    surfaces = of.where("kind = 'surface'").groupBy("key").agg(F.min("ts").alias("surface_ts"))
    batch = policy.deferred_present(surfaces, of.where("kind = 'scale'").select("key", F.col("ts").alias("scale_ts")), "key")
    want = {x.key: (x.us, x.cause) for x in batch.select("key", F.unix_micros("present_ts").alias("us"), F.when(F.col("scale_ts") <= F.col("present_ts"), "scale").otherwise("limit").alias("cause")).collect()}
    assert got == want and {"scale", "limit"} == {c for _, c in got.values()}


def test_ipc_stream(spark, tmp_path):
    rows = [(1, bytearray(b"ping\n")), (2, bytearray(b"")), (3, bytearray(b"nope")), (4, bytearray(b"status"))]
    spark.createDataFrame(rows, "conn_id long, data binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    reads = event_stream(spark, str(tmp_path / "in"), "conn_id long, data binary")
    ipc.serve(reads, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r.conn_id: r.reply for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "pong\n", 3: "error: unknown command 'nope'\n", 4: "frames=0 animate=true ipc_commands=4\n"}


def test_present_stream_equals_batch(spark, tmp_path):
    error = F.when(_k() % 17 == 0, ERRORS[0]).when(_k() % 17 == 1, ERRORS[1]).when(_k() % 17 == 2, ERRORS[2])
    tag = F.when(F.col("event_id") % 6 > 0, _mapped(TAGS))
    of = events(spark, SF).select("event_id", "user_id", "ts", tag.alias("frame_tag"), error.alias("inject_error"), F.when(_k() % 7 > 0, _k() % 5 == 0).alias("recreate"))
    names = ["event_id", "result", "status", "present_count", "recreate_count"]
    stream = present_stream(arriving(spark, of, tmp_path), "user_id", late="4 days").where("key <> '-1'")
    got = drain(stream, "presented", spark, tmp_path).select(*names)
    batch = present.present(of, "user_id", ["ts", "event_id"]).select(*names)
    assert got.count() == of.count() and got.exceptAll(batch).count() == 0
    present_to(stream, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.where("result = 'Presented'").count()


def claims(spark, n=400, seed=3):
    r = random.Random(seed)
    rows = [(f"q{r.randrange(12)}", f"c{r.randrange(6)}", r.choice(["author_anchor", "code_literal"]), r.randrange(4), None, f"e{k}", k // 3, r.randrange(3), k) for k in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, CLAIM)


def test_evidence_store_equals_recomputation_after_every_batch(spark, tmp_path):
    all_ = claims(spark)
    batches = [all_.where(F.col("pos") % 5 == k).cache() for k in range(5)]
    store, seen = EvidenceStore(spark, f"file://{tmp_path}/store"), None
    with pytest.raises(ValueError, match="no evidence"):
        store.read("K")
    for k, batch in enumerate(batches):
        store.add(batch, k)
        store.add(batch, k)  # the same again
        seen = batch if seen is None else seen.unionByName(batch)
        if k in (1, 3):
            store.compact()
            store.add(batches[0], 0)  # long within the snapshot
        for name, whole in (("K", latest_evidence(seen)), ("H", first_hypotheses(seen))):
            got = store.read(name)
            assert got.count() == whole.count() and got.select(*whole.columns).exceptAll(whole).count() == 0
    batches[2].limit(3).write.parquet(f"file://{tmp_path}/store/batch=9/K")  # a batch that was interrupted
    assert store.read("K").count() == latest_evidence(all_).count() and store.snapshot() == 3
    # the rows that the batch operators keep
    plain = resolve.evidence(all_.withColumn("pass", F.col("arrived"))).select("question_id", "chunk_id", "source_type", "value")
    assert store.read("K").select(*plain.columns).exceptAll(plain).count() == 0
    plain = resolve.hypotheses(all_.withColumn("pass", F.col("arrived"))).select("question_id", "source_type", "value", "chunk_id")
    assert store.read("H").select(*plain.columns).exceptAll(plain).count() == 0


def test_evidence_of_a_stream(spark, tmp_path):
    all_ = claims(spark, 300, 4)
    for k in range(3):
        all_.where(F.col("pos") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), CLAIM)
    for _ in range(2):  # the second run finds nothing new
        collect_evidence(stream, f"file://{tmp_path}/store", str(tmp_path / "cp"), compact_every=2).awaitTermination(120)
    store, whole = EvidenceStore(spark, f"file://{tmp_path}/store"), first_hypotheses(all_)
    assert store.snapshot() == 1 and store.read("H").select(*whole.columns).exceptAll(whole).count() == 0 and store.read("H").count() == whole.count()
