import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import recorder
from kinetide.operators import audit
from kinetide.sources import packets

LENGTHS = {1: 37, 2: 11, 3: 11}


def plain_scan(data: bytes, codes: list[int]):
    """Byte by byte: accepted frames and stray start bytes."""
    kept, stray, i = [], [], 0
    while i < len(data):
        if data[i] != 0xAA:
            i += 1
            continue
        code = data[i + 1] if i + 1 < len(data) else 0
        n = LENGTHS.get(code, 0)
        if code in codes and i + n <= len(data):
            body = 0
            for b in data[i + 1:i + n - 2]:
                body ^= b
            if body == data[i + n - 2] and data[i + n - 1] == 0xBB:
                kept.append((i, code))
                i += n
                continue
        stray.append(i)
        i += 1
    return kept, stray


def noisy(seed: int, n: int = 400) -> bytes:
    """Frames with torn ones, flipped checksums, start bytes in payloads, frames inside frames and a torn tail."""
    rng = random.Random(seed)
    out = bytearray()
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            f = recorder.imu(i, 0xAA - 256, 0x01AA, rng.randint(-9, 9), ir=0xAA0102AA, red=rng.randint(0, 2**32 - 1))
        elif kind < 0.8:
            f = recorder.emg(i, rng.choice([0xAA - 256, 5, -7]))
        elif kind < 0.85:
            f = recorder.eda(i, 3)
        elif kind < 0.9:
            inner = recorder.emg(i, 1)
            f = bytearray(recorder.imu(i, ir=1))
            f[7:18] = inner
            body = 0
            for b in f[1:35]:
                body ^= b
            f[35] = body
        else:
            f = bytearray(recorder.imu(i))
            if rng.random() < 0.5:
                f[35] ^= 1
            else:
                f = f[:rng.randint(1, 36)]
        out += bytes(f)
    return bytes(out[:-5])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("codes", [["imu"], ["emg"], ["imu", "emg"]])
def test_ranges_equal_a_plain_scan(seed, codes, monkeypatch):
    data = noisy(seed)
    frames = [packets.FRAMES[c] for c in codes]
    kept, stray = plain_scan(data, [f.code for f in frames])
    monkeypatch.setattr(packets, "LOOK_BACK", 40)
    for chunk in (17, 100, 5000, len(data)):
        got, bad = [], []
        for a in range(0, len(data), chunk):
            _, low, pos, number, loose = packets.scan(lambda x, y: data[x:y], len(data), a, min(a + chunk, len(data)), frames)
            got += [(int(p + low), frames[k].code) for p, k in zip(pos, number)]
            bad += [int(p + low) for p in loose]
        assert got == kept
        assert bad == stray


def test_read_and_audit_files(spark, tmp_path):
    data = noisy(9)
    (tmp_path / "2026-07-23-07-89pm.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")
    kept, stray = plain_scan(data, [1])
    rows = packets.read_packets(spark, str(tmp_path), "imu", chunk=1000).orderBy("file_offset").collect()
    assert [r.file_offset for r in rows] == [p for p, _ in kept]
    first = struct.unpack("<BBBIhhhhhhIIffBB", data[kept[0][0]:kept[0][0] + 37])
    assert (rows[0].timestamp_ms, rows[0].accel_x, rows[0].ppg_ir, rows[0].session_id) == (first[3], first[4], first[10], "2026-07-23-07-89pm")

    kept, stray = plain_scan(data, [1, 2])
    frames = packets.scan_frames(spark, str(tmp_path), chunk=700)
    counts = audit.frame_audit(frames).first()
    assert counts.n_imu == sum(c == 1 for _, c in kept) and counts.n_emg == sum(c == 2 for _, c in kept)
    assert counts.n_unclassified == len(stray)
    assert counts.unclassified_rate == pytest.approx(len(stray) / (len(kept) + len(stray)))
    assert sorted(r.file_offset for r in audit.bad_positions(frames, 500).collect()) == stray[:20]


def test_integrity_report(spark, tmp_path):
    wrap = 2**32
    times = [wrap - 40, wrap - 20, 5, 25, 25, 25, 10, 600_000]
    body = [recorder.imu(t, ax=i if i == 5 else 0) for i, t in enumerate(times)]
    (tmp_path / "2026-07-23-07-89pm.bin").write_bytes(b"".join(body))
    recorder.session(tmp_path, "2026-07-23-07-12pm", 400, [30_000, 360_000, 999_999_999, 0], None)
    packet = packets.read_samples(spark, str(tmp_path), chunk=50_000).persist()
    from kinetide.sources import recordings
    report = audit.integrity_report(packets.scan_frames(spark, str(tmp_path)), packet, recordings.read_markers(spark, str(tmp_path)),
                                    "file_offset", 100, 300_000)
    rows = {r.session_id: r for r in report.collect()}
    bad = rows["2026-07-23-07-89pm"]
    assert (bad.n_backward, bad.n_wraps, bad.n_anomalies) == (2, 1, 1)
    assert (bad.n_exact, bad.n_conflicting) == (1, 1)
    assert bad.valid_clock_time is False and bad.span == 600_000 - (wrap - 40)
    good = rows["2026-07-23-07-12pm"]
    assert good.valid_clock_time is True and good.n_imu == 20_000
    assert good.markers_per_bucket == [2, 2]  # the early one rounds toward zero, the late one counts in the last bucket


def test_incremental_ingest(spark, tmp_path):
    raw, out, ledger = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "ledger")
    raw.mkdir()
    frames = [recorder.imu(i * 20, ax=i) for i in range(100)]
    path = raw / "s.bin"
    seen = []
    for stop in (40 * 37 + 20, 40 * 37 + 36, 100 * 37):
        path.write_bytes(b"".join(frames)[:stop])
        packets.ingest_increment(spark, str(raw), out, ledger, chunk=500)
        seen.append(spark.read.parquet(out).count())
    assert seen == [40, 40, 100]
    rows = spark.read.parquet(out).orderBy("file_offset").collect()
    assert [r.accel_x for r in rows] == list(range(100))


def test_streaming_decode(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for k in range(3):
        (raw / f"s{k}.bin").write_bytes(b"".join(recorder.imu(i, ax=k) for i in range(50)))
    stream = packets.stream_recordings(spark, str(raw), files_per_trigger=1)
    query = stream.writeStream.format("memory").queryName("decoded").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.session_id: r["count"] for r in spark.table("decoded").groupBy("session_id").count().collect()} == {"s0": 50, "s1": 50, "s2": 50}
