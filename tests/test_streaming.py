"""The answer cache over a stream equals that over a table."""

import pytest

from lawloom.plans.queries import table
from lawloom.streaming import spacing


@pytest.mark.parametrize(("seconds", "strict"), [(spacing.CACHE_SECONDS, True), (spacing.COOLDOWN_SECONDS, False)])
def test_stream_equals_table(spark, tmp_path, seconds, strict):
    events = table(spark, "/root/testdata/sf0.001", "events").orderBy("ts")
    for k in range(3):
        events.where(f"event_id % 1000000 div 350 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = spacing.spaced_stream(source, "event_type", "ts", "event_id", seconds, strict)
    run = stream.writeStream.format("memory").queryName(f"spaced_{seconds}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    whole = spacing.spaced(spark.read.parquet(str(tmp_path / "in")), "event_type", "ts", "event_id", seconds, strict)
    columns = ("event_type", "event_id", "opened", "elapsed_us")
    assert sorted(spark.table(f"spaced_{seconds}").select(*columns).collect()) == sorted(whole.select(*columns).collect())


def test_openings():
    import numpy as np

    assert spacing._openings(np.array([0, 5, 10, 11, 30]), 10, None).tolist() == [0, 0, 10, 10, 30]
    assert spacing._openings(np.array([12, 20]), 10, 10).tolist() == [10, 20]
