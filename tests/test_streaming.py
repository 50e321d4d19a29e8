"""Pick tracking as a stream against the nights in a row."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.functions import scoring as sc
from tidemark.plans import nightly
from tidemark.streaming import tracking


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, tracking.PROVIDER)
    yield spark
    spark.conf.set(key, old)


def test_stream_tells_what_the_nights_in_a_row_tell(rocks, tmp_path):
    spark, rng = rocks, random.Random(9)
    start, choices = date(2024, 1, 4), ["", "", "A", "A|B", "B"]
    nights = [start + timedelta(days=k) for k in (0, 1, 4, 5, 60, 100, 101, 120)]
    rows = [[(s, f"c{s}", start - timedelta(days=s % 3), night, rng.choice(choices), str(nights[2]) if s % 4 == 0 and k >= 2 else None) for s in range(12)] for k, night in enumerate(nights)]
    schema = "scenario_id long, code string, first_date date, night timestamp, signals string, moved_at string"
    cal, out = calendar.dimension(spark), []
    for batch in rows:
        told = [(s, c, f, datetime(n.year, n.month, n.day), x, m) for s, c, f, n, x, m in batch]
        spark.createDataFrame(told, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = tracking.track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cal)
        keep = lambda df, _: out.extend((r["scenario_id"], r["night"].date(), r["event"], r["detail"]) for r in df.collect())
        stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    # The batch: signals of each night against those emitted before, moves that weren't told yet.
    days = {r["d"]: r["bd_seq"] for r in cal.collect()}
    emitted, moved, want = [], set(), []
    for k, batch in enumerate(rows):
        told = [(s, c, days[n] - days[f], x.split("|"), n) for s, c, f, n, x, _ in batch if x]
        signals = spark.createDataFrame(told, "scenario_id long, code string, days_since_pick int, signals array<string>, night date")
        before = spark.createDataFrame(emitted, "scenario_id long, code string, signals array<string>, _seq int")
        new = [(r["scenario_id"], r["code"], r["signals"], k, r["night"]) for r in nightly.new_signals(signals, before).collect()]
        emitted += [n[:4] for n in new]
        want += [(s, night, "sell_signal", "|".join(x)) for s, _, x, _, night in new]
        for s, _, f, n, _, m in batch:
            if m and s not in moved and days[n] - days[f] <= sc.LONGEST_WAIT:
                moved.add(s)
                want.append((s, n, "moved", m))
    assert sorted(out) == sorted(want) and any(days[n] - days[start] > sc.LONGEST_WAIT for n in nights)


def test_state_goes_when_the_time_for_signals_is_over(rocks, tmp_path):
    spark = rocks
    schema = "scenario_id long, code string, first_date date, night timestamp, signals string, moved_at string"
    first = date(2024, 1, 4)
    left = []
    for night in (datetime(2024, 1, 5), datetime(2024, 6, 3), datetime(2024, 6, 20)):
        # The first pick is heard of once; later nights are those of other picks.
        s = 1 if night.month == 1 else night.day
        spark.createDataFrame([(s, "c", first if s == 1 else night.date(), night, "A", None)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = tracking.track(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), calendar.dimension(spark))
        q = stream.writeStream.outputMode("append").foreachBatch(lambda df, _: df.count()).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        left.append(sorted(r["key"]["scenario_id"] for r in spark.read.format("statestore").option("stateVarName", "told").load(str(tmp_path / "state")).select(F.col("key")).collect()))
    assert left[0] == [1] and 1 not in left[-1] and left[-1]
