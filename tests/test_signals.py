import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetide.functions import dsp
from kinetide.operators import alerts, augment, cardiac, features, intervals, spectral, windows
from kinetide.operators.ordered import Running, exact_percentiles, islands, previous, running
from kinetide.plans.dataset import WINDOW_MS


def iir(b, a, x, z):
    y = np.zeros(len(x))
    z = z.copy()
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        for k in range(len(z) - 1):
            z[k] = b[k + 1] * v + z[k + 1] - a[k + 1] * y[i]
        z[-1] = b[-1] * v - a[-1] * y[i]
    return y


def zero_phase(x, coefficients):
    """Sample by sample: odd extension, steady-state start, forward and backward."""
    b, a = (np.array(c) for c in coefficients)
    n = len(a) - 1
    m = np.zeros((n, n))
    m[:, 0] = -a[1:]
    m[:-1, 1:] += np.eye(n - 1)
    start = np.linalg.solve(np.eye(n) - m, b[1:] - a[1:] * b[0])
    e = np.concatenate([2 * x[0] - x[15:0:-1], x, 2 * x[-1] - x[-2:-17:-1]])
    y = iir(b, a, e, start * e[0])
    return iir(b, a, y[::-1], start * y[-1])[::-1][15:-15]


@pytest.mark.parametrize("n", [16, 100, 3000])
def test_zero_phase_filter(n):
    x = 50_000 + np.random.default_rng(n).normal(0, 300, n).cumsum()
    for c in (dsp.PULSE_BAND, dsp.MUSCLE_LOW):
        np.testing.assert_allclose(dsp.zero_phase(x, c), zero_phase(x, c), rtol=1e-9, atol=1e-6)
    assert dsp.zero_phase(x[:15], dsp.PULSE_BAND) is None


def test_peaks():
    assert list(dsp.local_maxima(np.array([0, 1, 1, 1, 0, 2, 0, 3, 3.0]))) == [2, 5]
    x = np.zeros(60)
    x[[5, 10, 20, 40]] = [1, 3, 2, 5]
    assert list(dsp.spaced_peaks(x, 13)) == [10, 40]
    assert list(dsp.spaced_peaks(x, 10)) == [10, 20, 40]  # exactly the distance apart is enough
    assert list(dsp.spaced_peaks(np.zeros(10), 3)) == []


def test_ordered_helpers_equal_plain_scans(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"k": rng.choice(["hot", "x", "y"], 3000, p=[0.9, 0.05, 0.05]), "t": rng.permutation(9000)[:3000], "v": rng.normal(size=3000)})
    frame["n"] = frame.v.where(rng.uniform(size=3000) > 0.7)
    df = spark.createDataFrame(frame).withColumn("n", F.nanvl("n", F.lit(None).cast("double"))).withColumn("b", F.floor(F.col("t") / 37))
    specs = {"s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), False), "f": Running("last", F.col("n")), "r": Running("last", F.col("n"), reverse=True)}
    got = running(df, ["k"], "b", ["t"], specs).toPandas().sort_values(["k", "t"])
    plain = frame.sort_values(["k", "t"])
    g = plain.groupby("k")
    np.testing.assert_allclose(got.s, g.v.cumsum())
    np.testing.assert_allclose(got.m, g.v.cummax().groupby(plain.k).shift(1))
    np.testing.assert_allclose(got.f, g.n.ffill())
    np.testing.assert_allclose(got.r, g.n.bfill())
    got = previous(df, ["k"], "b", ["t"], {"p": F.col("v")}, {"q": F.col("v")}).toPandas().sort_values(["k", "t"])
    np.testing.assert_allclose(got.p, g.v.shift(1))
    np.testing.assert_allclose(got.q, g.v.shift(2))
    got = islands(df, ["k"], "b", ["t"], F.col("v") > 0).toPandas().sort_values(["k", "t"])
    up = plain.v > 0
    np.testing.assert_array_equal(got.island, ((up != up.groupby(plain.k).shift(1)) & up.groupby(plain.k).shift(1).notna()).groupby(plain.k).cumsum())


def test_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 20_000, p=[0.9, 0.0999, 0.0001]), "v": np.round(rng.exponential(size=20_000), 2)})
    frame.loc[frame.k == "a", "v"] = np.where(rng.uniform(size=(frame.k == "a").sum()) < 0.6, 1.5, frame.v[frame.k == "a"])  # one value holds most rows
    got = exact_percentiles(spark.createDataFrame(frame), ["k"], "v", {"lo": 0.025, "mid": 0.5, "hi": 0.975, "top": 1.0}).toPandas().set_index("k")
    for k, part in frame.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["lo", "mid", "hi", "top"]].to_numpy(float), np.percentile(part.v, [2.5, 50, 97.5, 100]), rtol=1e-12)


def test_emg_candidates_in_chunks(spark):
    rng = np.random.default_rng(4)
    n = 9000
    raw = rng.normal(0, 20, n)
    for a, b in ((500, 900), (950, 1300), (4000, 4015), (7000, 7800), (8700, 9000)):
        raw[a:b] *= 40
    t = 1000 + np.arange(n) * 2
    raw = raw.astype(int)
    env = zero_phase(np.abs(raw).astype(float), dsp.MUSCLE_LOW)
    above = env > 3 * np.median(env)
    edges = np.flatnonzero(np.diff(np.r_[0, above, 0]))
    found = []
    for a, b in zip(edges[::2], edges[1::2] - 1):
        if found and t[a] - found[-1][1] <= 200:
            found[-1] = (found[-1][0], t[b], max(found[-1][2], abs(raw[a:b + 1]).max()))
        else:
            found.append((t[a], t[b], abs(raw[a:b + 1]).max()))
    want = [f for f in found if f[1] - f[0] >= 50]
    frame = pd.DataFrame({"session_id": "s", "t": t, "emg_raw": raw})
    short = pd.DataFrame({"session_id": "tiny", "t": range(10), "emg_raw": range(10)})
    df = spark.createDataFrame(pd.concat([frame, short]))
    for chunk in (2500, 100_000):
        got = intervals.find_candidates(df, chunk=chunk, width=3000).orderBy("start_t").collect()
        assert [(r.session_id, r.start_t, r.end_t, r.peak) for r in got] == [("s", *map(int, w)) for w in want]
    chunked = intervals.envelope(df, "emg_raw", 3000, chunk=2500).where("session_id = 's'").orderBy("t").toPandas()
    np.testing.assert_allclose(chunked.envelope, env, atol=1e-6)


def pulse(bpm, seconds, seed=0, noise=5.0):
    t = np.arange(seconds * 50) * 20
    return t, 50_000 + 500 * np.sin(2 * np.pi * bpm / 60 * t / 1000) + np.random.default_rng(seed).normal(0, noise, len(t))


def test_compute_features(spark):
    rng = np.random.default_rng(5)
    t, ir = pulse(72, 60)
    raw = {c: rng.normal(0, 2000, len(t)).astype(int) for c in features.IMU}
    frame = pd.DataFrame({"session_id": "s", "t": t + 500, "ppg_ir": ir.astype(int), **raw})
    flat = frame.assign(session_id="flat", ppg_ir=5)
    wins = spark.createDataFrame([("w", "s", 500, 60_500, 1, 0), ("f", "flat", 500, 60_500, 0, 0), ("tiny", "s", 500, 560, 1, 0)],
                                 "window_id string, session_id string, start_t long, end_t long, label int, horizon int")
    got = spectral.compute_features(spark.createDataFrame(pd.concat([frame, flat])), wins, WINDOW_MS).toPandas().set_index("window_id")
    assert got.loc["w", "n_samples"] == 3000 and got.loc["tiny", "n_samples"] == 3
    assert len([c for c in got.columns if c.startswith(("accel", "gyro", "ppg"))]) == 59
    assert abs(got.loc["w", "ppg_hr_mean"] - 72) < 1 and pd.isna(got.loc["w", "ppg_rmssd"]) and pd.isna(got.loc["f", "ppg_hr_mean"])
    for c in features.IMU:
        x = raw[c] * spectral.IMU_SCALES[c]
        power, freqs = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(len(x), 1 / 50)
        want = [x.mean(), x.std(), x.min(), x.max(), np.sqrt((x**2).mean()), (np.diff(np.sign(x)) != 0).mean(), freqs[power.argmax()],
                power[freqs < 5].sum() * freqs[1], power[(freqs >= 5) & (freqs < 15)].sum() * freqs[1]]
        np.testing.assert_allclose(got.loc["w", [f"{c}_{s}" for s in features.TIME_STATS + features.SPECTRAL_STATS]].to_numpy(float), want, rtol=1e-9)
        assert got.loc["tiny", f"{c}_dominant_freq"] == 0


def ectopic(ibi):
    ok = []
    for i in range(len(ibi)):
        near = np.r_[ibi[max(0, i - 5):i], ibi[i + 1:i + 6]]
        m = np.median(near) if len(near) else 0
        ok.append(not (m > 0 and abs(ibi[i] - m) / m > 0.2))
    return np.array(ok, bool)


def test_heart_features(spark):
    rng = np.random.default_rng(6)
    beats, want = [], {}
    for w, n in (("many", 60), ("nine", 10), ("five", 6), ("fast", 30), ("two", 2), ("one", 1)):
        ibi = rng.normal(820, 40, n - 1).round() if w != "fast" else np.full(n - 1, 200.0)
        if n > 30:
            ibi[20] = 1300
        t = 1000 + np.r_[0, ibi.cumsum()]
        beats += [(w, int(x)) for x in t]
        ok = ectopic(ibi)
        valid = ibi[ok]
        good = n > 2 and 40 <= (60000 / ibi).mean() <= 180
        both = ok[:-1] & ok[1:]
        steps = np.diff(ibi)[both] if n > 2 else []
        want[w] = (
            np.polyfit((t[1:][ok] - t[0]) / 1000, 60000 / valid, 1)[0] * 60 if good and len(valid) >= 5 else None,
            np.sqrt(np.mean(np.square(steps))) if good and len(valid) >= 10 and len(steps) >= 9 else None,
            valid.std() if good and len(valid) >= 10 else None,
        )
    df = spark.createDataFrame(beats, "window_id string, t long")
    segments = spark.createDataFrame([(w, 500) for w in want] + [("none", 500), ("short", 5)], "window_id string, n_samples long")
    got = {r.window_id: r for r in cardiac.quality_record(segments, df).collect()}
    for w, (slope, rmssd, sdnn) in want.items():
        for name, value in (("hr_trend_slope", slope), ("rmssd_clean", rmssd), ("sdnn_clean", sdnn)):
            assert got[w][name] == (None if value is None else pytest.approx(value, rel=1e-9)), (w, name)
        assert got[w].trend_ok == (slope is not None) and got[w].hrv_ok == (rmssd is not None)
    assert got["many"].n_valid_ibis == 58 and got["fast"].plausible_hr is False and got["none"].n_raw_peaks == 0
    funnel = cardiac.quality_funnel(cardiac.quality_record(segments, df)).first()
    assert funnel.n_anchors == 8 and funnel.n_both_ok == sum(v[1] is not None for v in want.values())


def test_cooldown_in_chunks(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for s in ("a", "b", "c"):
        t = np.sort(rng.choice(4000, 700, replace=False)) * (1 if s != "c" else 20)
        p = rng.uniform(size=700) if s != "b" else np.ones(700)
        last = None
        for i, (x, q) in enumerate(zip(t, p)):
            key = len(rows)
            hot = q >= 0.4
            fired = hot and (last is None or x - last >= 30)
            last = x if fired else last
            rows.append((s, key, int(x), float(q)))
            want[key] = (bool(fired), bool(hot and not fired))
    df = spark.createDataFrame(rows, "session_id string, eval_id long, t long, probability double")
    for chunk in (1, 3, 1000):
        got = alerts.cooldown_alerts(df, 30, 0.4, chunk).collect()
        assert {r.eval_id: (r.alert_fired, r.suppressed_by_cooldown) for r in got} == want


def test_augmentations(spark):
    n = 500
    x = np.sin(np.arange(n) / 20) * 100
    arrays = spark.createDataFrame([("w", x.tolist(), (x * 2).tolist()), ("short", [1.0, 2.0], [3.0, 4.0])], "window_id string, accel_x array<double>, gyro_x array<double>")
    run = lambda seed: {(r.window_id, r.augmentation, r.copy): np.array([r.accel_x, r.gyro_x]) for r in augment.augment(
        arrays, ["accel_x", "gyro_x"], ["jitter", "magnitude_warp", "time_warp"], 2, seed).collect()}
    got, again, other = run(1), run(1), run(2)
    assert len(got) == 14 and all((got[k] == again[k]).all() for k in got)
    assert not (got["w", "jitter", 0] == other["w", "jitter", 0]).all()
    np.testing.assert_array_equal(got["w", "none", 0][0], x)
    noise = got["w", "jitter", 0][0] - x
    assert 0.5 < noise.std() / (0.02 * x.std()) < 1.5
    ratio = got["w", "magnitude_warp", 1] / got["w", "none", 0]
    np.testing.assert_allclose(ratio[0][5:], ratio[1][5:], rtol=1e-9)  # one curve for all channels
    np.testing.assert_allclose(np.diff(ratio[0][5:], 4), 0, atol=1e-9)  # and it is a cubic
    assert np.abs(got["w", "time_warp", 0]).max() <= 200 and got["w", "time_warp", 0].shape == (2, n)
    np.testing.assert_array_equal(got["short", "time_warp", 0], [[1, 2], [3, 4]])


def test_windows_by_hand(spark):
    """Overlaps, truncation at the edge, close markers, matching by session."""
    t = list(range(0, 1000, 10))
    df = spark.createDataFrame([("s", x) for x in t] + [("quiet", x) for x in t] + [("late", x + 5000) for x in t], "session_id string, t long")
    marks = spark.createDataFrame([(1, "s", 150, "e"), (2, "s", 500, "e"), (3, "s", 520, "e"), (4, "late", 5000, "e")], "marker_id long, session_id string, t long, event string")
    out = windows.labelled_windows(df, marks, 100, 20).collect()
    pos = sorted((r.window_id, r.start_t, r.end_t) for r in out if r.label == 1)
    assert pos == [("p:1:0", 30, 130), ("p:2:0", 380, 480), ("p:3:0", 400, 500)]  # the one before 'late' has no samples
    neg = [(r.session_id, r.start_t) for r in out if r.label == 0]
    free = [x for x in range(0, 900, 100) if not any(x + 100 > a and x < b for _, a, b in pos)]
    assert len(neg) == 3 and {s for s, _ in neg} == {"s"} and {x for _, x in neg} <= set(free)
    every = windows.labelled_windows(df, marks, 100, 20, all_negatives=True)
    assert sorted(r.start_t for r in every.where("label = 0 and session_id = 's'").collect()) == free
    assert windows.min_samples(60_000) == 1500


@pytest.mark.parametrize("x", [[32.620000000000005, -43.82, -32.62, -40.7], [-24.23, -38.01, 24.230000000000004, -46.61]])
def test_equal_powers_are_told_apart_by_plain_sums(x):
    """Both frequencies are equal but for rounding; a transform takes the lower one, sums in time order the higher one."""
    plain = [sum(sum(v * f(2 * np.pi * (k * j % 4) / 4) for j, v in enumerate(x)) ** 2 for f in (np.cos, np.sin)) for k in range(3)]
    assert dsp.spectrum_stats(np.array(x), 16.0)[0] == 4.0 * int(np.argmax(plain)) == 8.0
    assert dsp.spectrum_stats(np.zeros(8), 16.0)[0] == 0.0


def test_labelled_features_add_up_in_time_order(spark, tmp_path):
    """Events come in reverse order; means, deviations and root mean squares are those of the samples in time order, to the last bit."""
    from kinetide.plans import queries, tables

    rng = np.random.default_rng(3)
    rows = [(u * 100 + i, pd.Timestamp("2024-01-05") + pd.Timedelta(hours=2 * i), u, "error" if i == 13 else "view", float(v), "{}")
            for u in range(40) for i, v in enumerate(np.round(rng.uniform(0, 200, 14), 2))]
    table = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    table["ts"] = table["ts"].astype("datetime64[us]")
    table.iloc[::-1].to_parquet(tmp_path / "events.parquet")
    found = {r.session_id: r for r in queries.labelled_features(spark, str(tmp_path)).where("label = 1").collect()}
    assert len(found) == 40
    for u, r in found.items():
        ev = table[table.user_id == u].sort_values("ts")
        t = ev["ts"].astype("int64").to_numpy()
        end = t[-1] - tables.BUFFER
        x = (ev["value"].to_numpy() - 50.0)[(t >= end - tables.SHORT) & (t < end)]
        mean = m2 = 0.0
        for n, v in enumerate(x, 1):
            before, mean = mean, mean + (v - mean) / n
            m2 += (v - mean) * (v - before)
        assert r.x_mean == np.cumsum(x)[-1] / len(x)
        assert r.x_rms == np.sqrt(np.cumsum(x * x)[-1] / len(x))
        assert r.x_std == np.sqrt(m2 / len(x))
