import datetime

from quernstone import schema
from quernstone.streaming import monitor


def run(query, name, mode="append"):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()


def test_windows_of_a_stream_and_a_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/message_events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = monitor.event_stream(spark, str(tmp_path / "in"), 1)
    run(monitor.error_windows(stream, late="3650 days"), "windows", "complete")
    got = {tuple(r) for r in spark.sql("select * from windows").collect()}
    assert got == {tuple(r) for r in monitor.error_windows(table).collect()} and got


def test_repeated_calls(spark, tmp_path):
    call = [("c", "cancel", "{}")]
    at = datetime.datetime(2031, 1, 1)
    event = lambda i, calls: (i, "a", "r", "t", 1, i, "assistant", None, calls, None, None, "s", at, at)
    rows = [event(1, call), event(2, None), event(3, call), event(3, call), event(4, [("d", "get", "{}")])]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema.EVENT).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    stream = monitor.event_stream(spark, str(tmp_path / "p*"), 1)
    run(monitor.repeated_calls(stream), "repeats")
    assert [tuple(r) for r in spark.sql("select * from repeats").collect()] == [("a", 3, "cancel", 2)]
