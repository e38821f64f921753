import random

import pytest

from kinetide.operators import matching
from kinetide.streaming import outcomes

GRACE, HORIZON, LATENESS = 3_000, 10_000, 4_000
A, O = "session_id string, t long, alert_idx long", "session_id string, t long, outcome_id long, event string"
END = 10_000_000  # rows that close the streams


def feed(spark, tmp_path, rows, name, schema, parts):
    for i in range(parts + 1):
        piece = rows[i * len(rows) // parts:(i + 1) * len(rows) // parts] if i < parts else [("end", END, -1, "end")[:len(schema.split(", "))]]
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


@pytest.mark.parametrize(("seed", "parts"), [(0, 1), (1, 6), (2, 12)])
def test_stream_equals_table(spark, tmp_path, seed, parts):
    rng = random.Random(seed)
    alerts = [(rng.choice("abc"), rng.randrange(0, 120_000), i) for i in range(60)]
    marks = [(rng.choice("abcd"), rng.randrange(0, 120_000), i, "confirmed_pick") for i in range(80)]
    marks += [("a", alerts[0][1], 900, "false_alarm"), (None, 50, 901, "false_alarm")]  # a mark at an alert's own time, one without a session
    alerts += [(*alerts[1][:2], 61)]
    late = lambda rows: sorted(rows, key=lambda r: r[1] + rng.randrange(LATENESS))  # noqa: E731  out of order, within the lateness
    a, o = feed(spark, tmp_path, late(alerts), "a", A, parts), feed(spark, tmp_path, late(marks), "o", O, parts)
    found = outcomes.stream_outcomes(a, o, GRACE, HORIZON, LATENESS)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(str(tmp_path / "out")).where("outcome_id >= 0").collect()), key=str)
    table = matching.match_outcomes(spark.createDataFrame(alerts, A), spark.createDataFrame(marks, O), GRACE, 20_000).where("session_id is not null").collect()
    want = [(*r[:4], r[4] if r[5] is not None and r[5] <= HORIZON else None, r[5] if r[5] is not None and r[5] <= HORIZON else None) for r in map(tuple, table)]
    assert got == sorted([*want, (None, 901, 50, "false_alarm", None, None)], key=str)
    assert any(r[4] is not None for r in got) and any(r[5] is None for r in got)
