from datetime import datetime, timedelta

from sparkloom.streaming import search_log
from sparkloom.streaming.progress import ProgressTail

T0 = datetime(2025, 1, 1)


def test_a_log_is_appended_told_of_and_pruned(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "log")
    rows = spark.createDataFrame([(i, T0 + timedelta(days=i), "q") for i in range(10)], "id long, ts timestamp, text string")
    rows.filter("id < 5").write.parquet(source)
    tail = ProgressTail(50)
    spark.streams.addListener(tail)
    try:
        for part in ("id >= 5", None):
            stream = spark.readStream.schema(rows.schema).parquet(source)
            search_log.append(stream, folder, str(tmp_path / "ck")).awaitTermination()
            if part:
                rows.filter(part).write.mode("append").parquet(source)
    finally:
        spark.streams.removeListener(tail)
    assert spark.read.parquet(folder).count() == 10
    assert {"started", "progress", "ended"} <= {kind for _, kind, _, _ in tail.tail()}
    assert search_log.prune(spark, folder, "ts", "2025-01-09 00:00:00", 5) == 1
    spark.catalog.clearCache()
    assert sorted(r.id for r in spark.read.parquet(folder).collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert search_log.prune(spark, folder, "ts", "2025-01-09 00:00:00", 5) == 0


def test_a_tail_drops_the_oldest():
    tail = ProgressTail(2)
    tail._events.extend([1, 2, 3])
    assert tail.tail() == [2, 3]
