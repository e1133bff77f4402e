from datetime import datetime, timedelta

from mnestra import schema
from mnestra.operators.store import fold_oplog
from mnestra.sources.versioned import VersionedTable
from mnestra.streaming import oplog

OPS = [(1, "a", "insert", 7.0), (2, "a", "update", 3.0), (2, "a", "update", 3.0), (3, "b", "insert", 1.0), (4, "b", "delete", None), (5, "a", "decay", 0.5)]


def test_stream_gives_the_batch_state(spark, tmp_path):
    rows = spark.createDataFrame([(s, datetime(2024, 1, 1, s), i, o, v) for s, i, o, v in OPS], schema.OPLOG)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    log = VersionedTable(spark, str(tmp_path / "log"), schema.OPLOG, ["seq"])
    for _ in range(2):  # the second run finds nothing new
        oplog.fold_stream(oplog.read_oplog(spark, str(tmp_path / "in"), files_per_trigger=1), log, str(tmp_path / "ck")).awaitTermination(120)
    want = {tuple(r) for r in fold_oplog(rows).collect()}
    assert {tuple(r) for r in oplog.state(log).collect()} == want and len(want) == 1
    log.compact()
    assert {tuple(r) for r in oplog.state(log).collect()} == want
    assert oplog.operations_per_window(rows, "1 day").where("op = 'insert'").first()["n"] == 2


def test_rows_far_behind_are_kept(spark, tmp_path):
    """One file a trigger, so that a watermark would have moved on before the old rows come."""
    at = datetime(2024, 6, 1)
    ops = [(1, "a", "insert", 7.0, 0), (2, "b", "insert", 2.0, 1), (3, "a", "update", 3.0, -25), (4, "b", "delete", None, -991), (5, "c", "insert", 4.0, -2), (3, "a", "update", 3.0, -25)]
    rows = spark.createDataFrame([(s, at + timedelta(days=d), i, o, v) for s, i, o, v, d in ops], schema.OPLOG)
    log = VersionedTable(spark, str(tmp_path / "log"), schema.OPLOG, ["seq"])
    for n in range(len(ops)):
        spark.createDataFrame(rows.collect()[n : n + 1], schema.OPLOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        oplog.fold_stream(oplog.read_oplog(spark, str(tmp_path / "in"), files_per_trigger=1), log, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r["seq"] for r in log.read().collect()) == [1, 2, 3, 4, 5]
    want = {tuple(r) for r in fold_oplog(rows).collect()}
    assert {tuple(r) for r in oplog.state(log).collect()} == want and {r[0] for r in want} == {"a", "c"}
    counts = oplog.operations_per_window(oplog.read_oplog(spark, str(tmp_path / "in"), files_per_trigger=1), "1 day")
    counts.writeStream.format("memory").queryName("op_counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {r["op"]: r["n"] for r in spark.sql("SELECT op, sum(n) AS n FROM op_counts GROUP BY op").collect()} == {"insert": 3, "update": 1, "delete": 1}
