import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetide.streaming import live

MODEL = {"names": ["x_mean", "gone"], "mean": [0.0, 1.0], "scale": [1.0, 1.0], "coef": [2.0, 1.0], "intercept": 0.0, "medians": {"x_mean": 0.0, "gone": 1.0}}


def mean_only(t, v, end):
    return {"x_mean": float(v["x"].mean())}


def feed(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        t = np.cumsum(rng.integers(15, 30, 1500))
        x = np.sin(t / 4000) + rng.normal(0, 0.2, len(t))
        rows += [(s, int(a), None, float(b)) for a, b in zip(t, x)]
        rows += [(s, int(a), "missed_pick", None) for a in t[200::400] + 1]
    return rows


def by_hand(rows, window=2000, interval=300, least=60, cooldown=1500, grace=2500):
    out = []
    for s in ("a", "b"):
        buffer, last_eval, last_fired, last_idx, idx = [], None, None, None, 0
        for _, t, event, x in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if event:
                since = None if last_fired is None else t - last_fired
                out.append((s, "outcome", None, t, None, None, None, last_idx if since is not None and since <= grace else None, since))
                continue
            buffer = [(a, b) for a, b in buffer if a >= t - window] + [(t, x)]
            if last_eval is not None and t - last_eval < interval:
                continue
            last_eval = t
            if len(buffer) < least:
                continue
            p = 1 / (1 + np.exp(-2 * np.mean([b for _, b in buffer])))
            fired = p >= 0.5 and (last_fired is None or t - last_fired >= cooldown)
            if fired:
                last_fired, last_idx = t, idx
            out.append((s, "eval", idx, t, len(buffer), round(p, 9), fired, None, None))
            idx += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_live_alerts_equal_a_plain_loop(spark, tmp_path, parts):
    rows = feed()
    schema = "session_id string, t long, event string, x double"
    ordered = sorted(rows, key=lambda r: r[1])
    for i in range(parts):  # successive files are successive micro-batches
        piece = ordered[i * len(ordered) // parts:(i + 1) * len(ordered) // parts]
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    alerts = live.live_alerts(stream, MODEL, mean_only, ["x"], 2000, 300, 60, 0.5, 1500, 2500)
    live.write_logs(alerts, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    evals = spark.read.parquet(str(tmp_path / "out/eval_log")).collect()
    outcomes = spark.read.parquet(str(tmp_path / "out/outcomes")).collect()
    got = [(r.session_id, "eval", r.eval_idx, r.timestamp_ms, r.n_samples_in_window, round(r.probability, 9), r.alert_fired, None, None) for r in evals]
    got += [(r.session_id, "outcome", None, r.timestamp_ms, None, None, None, r.matched_alert_idx,
             None if r.seconds_since_alert is None else round(r.seconds_since_alert * 1000)) for r in outcomes]
    assert sorted(got, key=str) == by_hand(rows)
    assert any(r.alert_fired for r in evals) and any(r.suppressed_by_cooldown for r in evals)


def test_late_rows_are_counted(spark, tmp_path):
    schema = "session_id string, t long, event string, x double"
    for piece in ([("a", t, None, 1.0) for t in range(0, 1000, 10)], [("a", 5, None, 1.0), ("a", 1000, None, 1.0)]):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.live_alerts(stream, MODEL, mean_only, ["x"], 500, 0, 1, 0.5, 10, 10)
    query = out.writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("late").orderBy(F.col("t").desc()).first()
    assert last.n_late == 1 and last.t == 1000 and last.eval_idx == 100


def test_vectors(spark):
    t = np.arange(9000) * 20
    rng = np.random.default_rng(0)
    v = {c: rng.normal(0, 100, 9000) for c in ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")}
    assert len(live.imu_vector(t, v, int(t[-1]) + 1)) == 54
    many = live.multi_horizon_vector({30_000: "w30", 60_000: "w60", 180_000: "w180"}, lambda t, v, e: {"rmssd_clean": 1.0})
    out = many(t, v, int(t[-1]) + 1)
    assert len(out) == 217 and out["w30_accel_x_mean"] == pytest.approx(v["accel_x"][-1500:].mean() / 16384)


def test_rows_out_of_order_wait(spark, tmp_path):
    """Two orders of the same files give the same evaluations, as long as no row is more than `lateness` behind."""
    schema = "session_id string, t long, event string, x double"
    rows = [("a", t, "missed_pick" if t % 230 == 0 and t else None, float(np.sin(t / 90))) for t in range(0, 3000, 10)]
    found = []
    for name, order in (("sorted", range(6)), ("mixed", (1, 0, 3, 2, 5, 4))):
        for k in order:
            spark.createDataFrame(rows[50 * k:50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        out = live.live_alerts(stream, MODEL, mean_only, ["x"], 400, 50, 5, 0.5, 200, 300, lateness=1100)
        out.writeStream.format("memory").queryName(f"order_{name}").trigger(availableNow=True).start().awaitTermination()
        found.append(sorted(map(str, spark.table(f"order_{name}").collect())))
    assert found[0] == found[1] and len(found[0]) > 20 and "n_late=0" in found[0][0]
