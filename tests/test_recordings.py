"""Recordings to results on small seeded folders."""
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import recorder
from kinetide.operators import bootstrap, cardiac, metrics, spectral, validation
from kinetide.plans import dataset, experiments
from kinetide.sources import packets, recordings, storage
from kinetide.streaming import live

DAYS = ["2026-07-07", "2026-07-08", "2026-07-09"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for i, day in enumerate(DAYS):
        marks = [230_000, 420_000, 455_000, 700_000] if i < 2 else [260_000, 640_000]
        recorder.session(root, f"s{i}", 1100, marks, day, seed=i, bpm=66 + 6 * i, burst=0.3)
    recorder.session(root, "nometa", 100, [90_000], None, seed=9)
    (root / "nomarks.bin").write_bytes(recorder.imu(5) * 3)
    (root / "empty.bin").write_bytes(b"")
    return root


@pytest.fixture(scope="module")
def rec(spark, folder, tmp_path_factory):
    return dataset.Recordings(spark, str(folder), str(tmp_path_factory.mktemp("decoded") / "imu"))


@pytest.fixture(scope="module")
def table_a(rec):
    return dataset.imu_table(rec)


def test_sidecar_files(spark, rec, folder, tmp_path):
    days = {r.session_id: r.day_str for r in rec.sessions.collect()}
    assert days == {"s0": DAYS[0], "s1": DAYS[1], "s2": DAYS[2]}
    assert rec.markers.count() == 11 and rec.markers.select("marker_id").distinct().count() == 11
    found = spark.createDataFrame([("s0", 10, 20, 7)], "session_id string, start_ms long, end_ms long, peak_emg int")
    (tmp_path / "s0.candidates.csv").write_text("start_ms,end_ms,peak_emg\n10,20,7\n")
    (tmp_path / "s0.labels.csv").write_text("start_ms,end_ms,label\n10,20,1\n")
    assert recordings.read_intervals(spark, str(tmp_path), "candidates").first()["peak_emg"] == 7
    assert recordings.read_intervals(spark, str(tmp_path), "labels").first()["label"] == 1
    recordings.write_intervals(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().session_id == "s0"


def test_build_dataset(rec, folder):
    table, names = dataset.build_dataset(rec)
    rows = table.toPandas().set_index("window_id")
    assert "ppg_rmssd" not in names and len(names) == 58  # never long enough, so dropped
    assert set(rows.day_str) == {*DAYS, "unknown"} and not rows[names].isna().any().any()
    positives = rows[rows.label == 1]
    assert len(positives) == 11
    # the windows and their means by hand, for one session
    raw = np.frombuffer((folder / "s0.bin").read_bytes(), dtype=packets.IMU.dtype)
    t = raw["timestamp_ms"].astype(int)
    one = positives[positives.session_id == "s0"]
    for m in (230_000, 420_000, 455_000, 700_000):
        inside = (t >= m - 67_000) & (t < m - 7_000)
        hit = one[one.start_t == m - 67_000]
        assert len(hit) == 1 and hit.n_samples.iloc[0] == inside.sum()
        assert hit.accel_z_mean.iloc[0] == pytest.approx(raw["accel_z"][inside].mean() / 16384, rel=1e-9)
    negatives = rows[(rows.label == 0) & (rows.session_id == "s0")]
    assert len(negatives) == 4
    for start in negatives.start_t:
        assert (start - 1000) % 60_000 == 0
        assert all(start + 60_000 <= m - 67_000 or start >= m - 7_000 for m in (230_000, 420_000, 455_000, 700_000))


def test_feature_sets(rec, table_a):
    table, names = table_a
    assert len(names) == 54
    _, c = dataset.FEATURE_SETS["C"](rec)
    assert len(c) == 72
    d, d_names = dataset.FEATURE_SETS["D"](rec)
    assert len(d_names) == 216 and {n.split("_")[0] for n in d_names} == {"w30", "w60", "w180"}
    # the 60 s part of an anchor equals the plain window when the window was complete
    anchor = d.where("label = 1").select("window_id", "w60_accel_x_mean").join(
        table.select("window_id", "accel_x_mean"), "window_id").collect()
    assert anchor and all(r.w60_accel_x_mean == pytest.approx(r.accel_x_mean, rel=1e-9) for r in anchor)
    thermal, t_names = dataset.thermal_table(rec)
    assert len(t_names) == 14 and thermal.count() == table.count()


def test_heart_tables(rec):
    table, names = dataset.dual_window_table(rec)
    rows = table.toPandas()
    cut_short = rows.session_id == "nometa"  # its early segment lies before the recording's start
    assert cut_short.sum() == 1 and not rows[cut_short].hrv_ok.any()
    assert rows[~cut_short].hrv_ok.all() and rows[~cut_short].raw_hr_mean.between(60, 85).all()
    s0 = rows[rows.session_id == "s0"]
    np.testing.assert_allclose(s0.hr_trend_mean, 66, atol=1.5)
    ids = ["window_id", "day_str", "label"]
    configs = cardiac.heart_configurations(table, names, ids)
    assert {k: len(v.columns) - 3 for k, v in configs.items()} == {"A_only": 54, "A_plus_hr_trend": 56, "A_plus_hrv": 56, "A_plus_both": 58}
    plain, heart = cardiac.variability_pair(table, names, ids)
    assert bootstrap.population_mismatch(plain, heart, names).isEmpty()
    results, pairs = experiments.heart_comparison(configs, ids, int(1.1 * len(rows)), n_rep=4)
    found = {r.candidate: r for r in pairs.collect()}
    assert results.count() == 4 and set(found) == set(configs)
    assert all(r.own_low <= r.own_mean <= r.own_high for r in found.values()) and [k for k, r in found.items() if r.mean_diff is None] == ["A_only"]
    assert experiments.heart_comparison({"A_only": configs["A_only"]}, ids, 10 * len(rows), n_rep=4)[1] is None


def test_sweep_and_resume(spark, rec, table_a, tmp_path):
    log = str(tmp_path / "log")
    table, names = table_a
    few = names[:6]
    dirty = dataset.dirty_table(rec)
    assert [r.dirty for r in dirty[0].where("label = 1").orderBy("session_id", "end_t").collect()].count(True) == 2  # 455 s after 420 s, twice
    aug = {"jitter": dataset.augmented_table(rec, ["jitter"])}
    args = dict(classifiers=["lr_l2_baseline", "gaussian_nb", "nested_elasticnet", "conditional_logit"], prior=(few, [0.1] * 6),
                dirty=(dirty[0], few), all_negatives=(dataset.imu_table(rec, all_negatives=True)[0], few),
                augmented={"jitter": (aug["jitter"][0], few)})
    out = experiments.sweep(spark, {"A": (table, few)}, log, **args)
    assert out.count() == 4 + 8 + 2 + 1
    files = spark.read.json(log).count()
    assert experiments.sweep(spark, {"A": (table, few)}, log, **args).count() == out.count() and spark.read.json(log).count() == files
    row = out.where("model = 'lr_l2_baseline'").first()
    assert row.mean_auc == pytest.approx(np.mean(row.fold_aucs)) and len(row.fold_aucs) == 3  # the session without metadata has one class
    top = experiments.top_bootstrap(spark, log, {"A": (table, few)}, n_rep=4)
    assert "A/lr_l2_baseline" in {r.config for r in top.collect()}


def test_extra_features_and_buffers(rec, table_a):
    table, names = table_a
    thermal, t_names = dataset.thermal_table(rec)
    results, pairs = experiments.with_and_without((table, names[:6]), (thermal, t_names), kinds=["lr_l2_baseline"], n_rep=4)
    assert results.count() == 2 and pairs.first().candidate == "with" and pairs.first().model == "lr_l2_baseline"
    assert {r.feature_set: r.added for r in results.collect()} == {"without": [], "with": t_names}
    results, pairs = experiments.buffer_sweep(lambda b: (dataset.imu_table(rec, buffer_ms=b)[0], names[:4]), "lr_l2_baseline", n_rep=4)
    assert {r.feature_set for r in results.collect()} == {"7000", "5000", "3000"} and pairs.count() == 2
    best, scores, held = experiments.train_and_select(table, names[:4], ["lr_l2_baseline"])
    assert best == "lr_l2_baseline" and held.first().test_day == "unknown"


def test_stored_tables_and_models(spark, table_a, tmp_path):
    table, names = table_a
    calls = []
    build = lambda: calls.append(1) or (table, names)
    for _ in range(2):
        back, order = storage.cached_features(spark, str(tmp_path / "features"), "A", build)
    assert calls == [1] and order == names and back.count() == table.count()
    fitted = experiments.deployable(table, names, str(tmp_path / "model"))
    model = storage.read_model(spark, str(tmp_path / "model"))
    assert model["names"] == names
    np.testing.assert_allclose(model["coef"], fitted.coef[0])
    assert live.check_model(model, 60_000, 60_000) == [] and len(live.check_model(model, 30_000, 60_000)) == 1
    with pytest.raises(ValueError):
        live.check_model({**model, "coef": [1.0]}, 60_000, 60_000)
    scored = {r.window_id: r.probability for r in live.score_rows(table, model).collect()}
    for row in table.limit(5).collect():
        assert scored[row.window_id] == pytest.approx(live.probability(row.asDict(), model))


def public(root):
    rng = np.random.default_rng(11)
    for k, name in enumerate(("exp-1", "exp-5", "exp-6")):
        place = root / name
        place.mkdir()
        start = 1_582_118_074_000 + k * 10_000_000
        t = start + np.arange(6000) * 100
        for kind, shift in (("acc", 0), ("gyr", 37)):
            frame = pd.DataFrame(rng.normal(0, 1, (6000, 3)) + 5, columns=list("xyz"))
            frame.insert(0, "timestamp", t + shift)
            frame.to_csv(place / f"{kind}Labeled.csv", index=False)
    for name, start in (("exp-1", 0), ("exp-5", 20_000_000), ("exp-6", 10_000_000)):  # the last two are swapped
        rows = [f"{1_582_118_074_000 + start},,", "2.30,nail,1", "0.30,nail,1", "5.00,,1", "6.15,hair,7", "7.05,hair,2"]
        (root / name / "timestamps.csv").write_text("start,label,stage\n" + "\n".join(rows) + "\n")


def test_public_recordings(spark, tmp_path):
    public(tmp_path)
    events = recordings.read_public_events(spark, str(tmp_path)).collect()
    offsets = sorted((r.session_id, r.t - r.recording_start) for r in events)
    assert [s for s, _ in offsets] == ["exp-1", "exp-1", "exp-5", "exp-5", "exp-6", "exp-6"]
    assert [round(o / 1000) for s, o in offsets if s == "exp-5"] == [150, 425]
    assert {r.session_id: r.recording_start - 1_582_118_074_000 for r in events} == {"exp-1": 0, "exp-5": 10_000_000, "exp-6": 20_000_000}
    table, names = dataset.public_table(spark, str(tmp_path))
    rows = table.toPandas()
    assert len(names) == 54 and len(rows) == 12 and rows.label.sum() == 6 and rows.groupby("day_str").size().eq(4).all()
    starts = {r.session_id: r.recording_start for r in events}
    for r in rows[rows.label == 0].itertuples():
        near = [abs(r.end_t - e.t) for e in events if e.session_id == r.session_id]
        assert min(near) >= 60_000 and (r.end_t - starts[r.session_id] - 37) % 5000 == 0
    flipped, _ = dataset.public_table(spark, str(tmp_path), flip=True)
    both = table.select("window_id", F.col("accel_y_mean").alias("a"), F.col("gyro_y_mean").alias("g")).join(
        flipped.select("window_id", "accel_y_mean", "gyro_y_mean"), "window_id").collect()
    assert len(both) == 12 and all(r.a == -r.accel_y_mean and r.g == r.gyro_y_mean for r in both)
    kept, raw, _ = experiments.population_prior(table, names)
    assert len(kept) == 36 and len(raw) == 36
    experiments.population_prior(table, names, str(tmp_path / "prior"))
    again, coefficients = storage.read_prior(spark, str(tmp_path / "prior"))
    assert again == kept and coefficients == pytest.approx(raw)


def test_prior_evaluation_and_flip(spark, table_a, tmp_path):
    table, names = table_a
    some = names[:3]
    out = experiments.evaluate_prior(table, names[:5], some, [0.1, 0.2, 0.3], n_rep=3)
    assert out["sweep"].count() == 8 and isinstance(out["overlap"], bool) and out["shift"].count() == 3
    got = experiments.sign_flip(table, names[:5], (some, [9.0] * 3), (some, [-9.0] * 3), n_rep=3)
    assert got["outcomes"].count() == 3
    with pytest.raises(ValueError):
        experiments.sign_flip(table, names, (some, [1.0] * 3), (some[:2], [1.0] * 2))
    (tmp_path / "prior.json").write_text(json.dumps({"feature_names": some, "coefficients_population_std_units": [1, 2, 3], "population_scaler_scale": [2, 2, 4]}, indent=1))
    assert storage.read_prior(spark, str(tmp_path / "prior.json")) == (some, [0.5, 1.0, 0.75])
    with pytest.raises(ValueError):
        experiments.evaluate_prior(table, names, ["nowhere"], [1.0], n_rep=3)
