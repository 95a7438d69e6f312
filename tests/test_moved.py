"""What became of listed rows: same, moved, lost, new, with late rows and a restart before every batch."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime, timedelta

from tidemark.streaming import state

BEGAN = datetime(2026, 1, 1)
SCHEMA = "k string, day date, at timestamp"


def at(d):
    return BEGAN + timedelta(days=d)


def test_moved_lost_and_late_rows_are_told_once(spark, tmp_path):
    told = Counter()

    def run(n, listed, seen):
        for name, rows in (("listed", listed), ("seen", seen)):
            spark.createDataFrame([(k, date(2026, 2, d), at(t)) for k, d, t in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/{n}")
        a, b = (spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{x}/*") for x in ("listed", "seen"))
        out = state.moved_and_lost(a, b, "k", "day", "at").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
        now = Counter((r["k"], r["day"] and r["day"].day, r["now"] and r["now"].day, r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        new = now - told
        told.clear()
        told.update(now)
        return sorted(new.elements(), key=str)

    assert run(1, [("same", 3, 0), ("moved", 4, 0), ("lost", 5, 0), ("slow", 6, 0)], [("same", 3, 1), ("moved", 9, 1)]) == [("moved", 4, 9, "moved"), ("same", 3, 3, "same")]
    # The second sighting on that day says nothing new; a third day does. No row listed before "fresh" was seen can come any more.
    assert run(2, [("far", 1, 5)], [("moved", 9, 1), ("moved", 11, 2), ("fresh", 7, 2), ("slow", 6, 6)]) == [("fresh", None, 7, "new"), ("moved", 4, 11, "moved"), ("slow", 6, 6, "same")]
    # Both streams move on: what nobody saw is lost, once.
    assert run(3, [("x", 1, 20)], [("y", 1, 20)]) == [("far", 1, None, "lost"), ("lost", 5, None, "lost")]
    # Rows behind the watermark are left out.
    assert run(4, [("lost", 5, 1)], [("same", 30 - 10, 1), ("x", 2, 21)]) == [("x", 1, 2, "moved")]
