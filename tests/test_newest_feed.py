"""The newest events kept by a stream, with late and repeated events and a restart from its checkpoint."""

import datetime as dt

from kgspark.streaming import feeds


def test_newest_events_after_each_file_and_a_restart(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, [None, "a", "a", "b"][i % 4], t0 + dt.timedelta(minutes=(i * 37) % 50)) for i in range(120)]
    rows += [(None, "a", t0), (500, "a", None)]
    schema = "event_id long, event_type string, ts timestamp"
    parts = [rows[:40], rows[60:], [*rows[40:60], *rows[:10]]]  # the third one is late and repeats
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
        slots = feeds.newest_by_key(stream, n=7, salts=2)
        feeds.upsert_stream(slots, f"{tmp_path}/slots", f"{tmp_path}/state", "slot", available_now=True, mode="update").awaitTermination()
        seen = {(k, t, e) for p in parts[: i + 1] for e, k, t in p if e is not None and t is not None}
        want = set()
        for key in (None, "a", "b"):
            own = sorted(((t, e) for k, t, e in seen if k == key), reverse=True)[:7]
            want |= {(key, e, n) for n, (_, e) in enumerate(own, 1)}
        got = feeds.newest_of(feeds.read_upserts(spark, f"{tmp_path}/slots", "slot"), 7).collect()
        assert {(r["key"], r["id"], r["rank"]) for r in got} == want and len(got) == len(want)
