"""Seeded recordings for tests."""
from __future__ import annotations

import json
import struct
from functools import reduce
from pathlib import Path

import numpy as np


def _frame(body: bytes) -> bytes:
    return b"\xaa" + body + bytes([reduce(lambda a, b: a ^ b, body), 0xBB])


def imu(t, ax=0, ay=0, az=0, gx=0, gy=0, gz=0, ir=0, red=0, amb=20.0, obj=30.0) -> bytes:
    return _frame(struct.pack("<BBIhhhhhhIIff", 1, 1, t, ax, ay, az, gx, gy, gz, ir, red, amb, obj))


def emg(t, raw=0) -> bytes:
    return _frame(struct.pack("<BBIh", 2, 1, t, raw))


def eda(t, raw=0) -> bytes:
    return _frame(struct.pack("<BBIh", 3, 1, t, raw))


def session(root: Path, name: str, seconds: int, markers: list[int], day: str | None, seed: int = 0, bpm: float = 72.0, start: int = 1000,
            burst: float = 0.0, emg_hz: int = 0) -> None:
    """A recording with markers (ms); the signal is livelier before markers when burst > 0."""
    rng = np.random.default_rng(seed)
    n = seconds * 50
    t = start + np.arange(n) * 20
    acc, gyr = rng.normal(0, 2000, (n, 3)), rng.normal(0, 300, (n, 3))
    acc[:, 2] += 16000
    for m in markers:
        near = (t >= m - 67_000) & (t < m - 7_000)
        acc[near] *= 1 + burst
    acc = acc.clip(-32_000, 32_000)
    ir = 50_000 + 500 * np.sin(2 * np.pi * bpm / 60 * t / 1000) + rng.normal(0, 5, n)
    amb, obj = 20 + rng.normal(0, 0.1, n), 30 + rng.normal(0, 0.1, n) + np.arange(n) * 1e-4
    out = bytearray()
    for i in range(n):
        out += imu(int(t[i]), *(int(v) for v in acc[i]), *(int(v) for v in gyr[i]), int(ir[i]), 7, float(amb[i]), float(obj[i]))
        for k in range(emg_hz // 50):
            out += emg(int(t[i]) + 2 * k, int(rng.normal(0, 100)))
    (root / f"{name}.bin").write_bytes(bytes(out))
    if markers is not None:
        (root / f"{name}.markers.csv").write_text("timestamp_ms,event\n" + "".join(f"{m},lip_picking\n" for m in markers))
    if day:
        (root / f"{name}.meta.json").write_text(json.dumps({
            "session_id": name, "port": "COM3", "baud": 921600, "start_utc": f"{day}T03:24:00+00:00", "pkt_version": 1}, indent=2))
