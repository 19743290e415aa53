"""Keyed chains, event time, anchors against receipts and the log source, replayed in micro-batches with restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tallychain.operators import anchors, chain
from tallychain.sources import logs
from tallychain.streaming import event_time, keyed


def fed(spark, source, schema, parts):
    """A stream over a folder that gets its parts one file each, in order."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def drained(df, out, mark, mode="append"):
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(180)


@pytest.fixture
def state_store(spark):
    before = {k: spark.conf.get(k, None) for k in keyed.STATE_STORE}
    for k, v in keyed.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_keyed_chains_equal_the_fold_over_restarts(spark, tmp_path, state_store):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    r, schema = random.Random(1), "model_id string, block_index long, ts long, data string"
    rows = [(f"m{r.randrange(5)}", i, 100 + i, f"d{i}") for i in range(120)]
    parts = [rows[i : i + 30] for i in range(0, 120, 30)]
    drained(keyed.keyed_chains(fed(spark, source, schema, parts[:2]), "model_id"), out, mark)
    drained(keyed.keyed_chains(fed(spark, source, schema, [parts[2], parts[3] + rows[:3] + [(None, 7, 7, "x"), ("m1", None, 1, "y")]]), "model_id"), out, mark)
    found = spark.read.parquet(out)
    want = chain.fold(spark.createDataFrame(rows, schema), keys=("model_id",))
    assert sorted(map(tuple, found.where("not late").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    late = found.where("late").collect()
    assert sorted(r.block_index for r in late) == [0, 1, 2] and all(r.hash is None for r in late)


def test_the_future_does_not_drag_the_bound(spark, tmp_path):
    source, path, mark = (str(tmp_path / x) for x in ("in", "split", "mark"))
    schema = "event_id long, kind string, ts long"
    parts = [[(1, "a", 10_000), (2, "a", 10_000 + 10**9), (3, "b", 5_000)], [(4, "a", 12_000), (5, "b", 9_000), (6, "b", 5_999), (7, "a", None)], [(8, "a", 7_999), (9, "a", 8_000), (10, "b", 30_000)]]
    for n, part in enumerate(parts):  # a restart before each
        stream = fed(spark, source, schema, [part])
        event_time.divided(stream, path, mark, now=50_000, lateness=4_000).awaitTermination(180)
    aside = {r.event_id: r.aside for r in spark.read.parquet(f"{path}/aside").collect()}
    assert aside == {2: "future", 6: "late", 7: "undated", 8: "late"}
    accepted = spark.read.parquet(f"{path}/accepted")
    assert sorted(r.event_id for r in accepted.collect()) == [1, 3, 4, 5, 9, 10]
    stream = spark.readStream.schema(accepted.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/accepted")
    drained(event_time.windowed_counts(stream, ["kind"], "1 hour", "4000 seconds"), str(tmp_path / "counts"), str(tmp_path / "mark2"))
    whole = {tuple(r) for r in event_time.windowed_counts(accepted, ["kind"]).collect()}
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "counts")).select("start", "kind", "events").collect()]
    assert len(found) == len(set(found)) and set(found) == {x for x in whole if x[0] + 3600 <= 26_000} and len(found) == 4


def test_a_receipt_before_or_after_its_anchor_confirms_it_once(spark, tmp_path):
    a_schema, r_schema = "tx_hash string, last_block_index long, anchored_at long, block_number long, status string", "tx_hash string, block_number long, mined_at long"
    a_parts = [[("t1", 1, 1000, None, "pending"), ("t2", 2, 1000, None, "pending")], [("t3", 3, 2000, None, "pending"), ("t4", 4, 2000, 77, "confirmed")], [("end", 9, 90_000, None, "pending")], [("end2", 10, 190_000, None, "pending")]]
    r_parts = [[("t3", 33, 1500), ("t1", None, 1200)], [("t1", 11, 1700), ("t1", 11, 1700), ("t4", 44, 2100)], [("x", 1, 90_000)], [("y", 1, 190_000)]]
    a, r, out, mark = (str(tmp_path / x) for x in ("a", "r", "out", "mark"))
    for part_a, part_r in zip(a_parts, r_parts):  # a restart before each
        made = event_time.confirmations(fed(spark, a, a_schema, [part_a]), fed(spark, r, r_schema, [part_r]), "2 hours", "10 minutes")
        drained(made, out, mark)
    found = sorted(tuple(x) for x in spark.read.parquet(out).select("tx_hash", "block_number", "status").collect())
    assert [x for x in found if x[0].startswith("t")] == [("t1", 11, "confirmed"), ("t2", None, "pending"), ("t3", 33, "confirmed"), ("t4", 77, "confirmed")]


def test_log_source(spark, tmp_path):
    path = str(tmp_path / "node")
    spark.dataSource.register(logs.ContractLogs)
    row = lambda n, i: (n, i, ["0xA", f"r{n}", "h", "n", "d", str(n)] if n % 3 else None)
    first = [row(n, i) for n in range(0, 60, 2) for i in range(2)]
    frame = lambda rows: spark.createDataFrame(rows, logs.SCHEMA)
    logs.export_logs(frame(first), path, 16)
    read = spark.read.format("contract_logs").option("path", path).option("step", 10)
    assert sorted(map(tuple, read.load().collect()), key=str) == sorted(first, key=str) and read.load().rdd.getNumPartitions() == 6
    assert sorted({r.block_number for r in read.option("fromBlock", 7).option("toBlock", 21).load().collect()}) == list(range(8, 22, 2))
    events = anchors.from_args(spark.read.format("contract_logs").option("path", f"file://{path}").load())
    assert events.where("technical_address is null").count() == sum(1 for x in first if x[2] is None)

    def stream():
        source = spark.readStream.format("contract_logs").option("path", path).option("step", 10).option("fromBlock", 4).load()
        drained(source, str(tmp_path / "out"), str(tmp_path / "mark"))
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)

    assert stream() == sorted([x for x in first if x[0] >= 4], key=str)
    more = [row(n, 0) for n in range(60, 75)]
    logs.export_logs(frame(more), path, 16, "append")
    assert stream() == sorted([x for x in first + more if x[0] >= 4], key=str) == stream()
    assert spark.read.format("contract_logs").option("path", str(tmp_path / "none")).load().count() == 0
    with pytest.raises(Exception, match="without a block number"):
        logs.export_logs(frame([(None, 0, None)]), str(tmp_path / "bad"))


def test_bounds_are_pushed(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    r = logs.PushedReader({"path": str(tmp_path), "step": "10"})
    other = EqualTo(("log_index",), 3)
    assert list(r.pushFilters([GreaterThan(("block_number",), 14), LessThanOrEqual(("block_number",), 31), other])) == [other]
    assert (r.lo, r.hi) == (15, 31) and logs.ranges(r.lo, r.hi, 10) == [logs.Blocks(15, 19), logs.Blocks(20, 29), logs.Blocks(30, 31)]
