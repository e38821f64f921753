"""Recordings that grow between triggers."""
import recorder
from kinetide.sources import growing


def test_each_frame_once_while_files_grow(spark, tmp_path):
    raw, out, state = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "state")
    (raw / "later").mkdir(parents=True)
    a, b = (b"".join(recorder.imu(i * 20, ax=i + k) for i in range(100)) for k in (0, 1000))
    a = a[:37 * 30] + b"\xaa\x01noise" + a[37 * 30:]

    def trigger():
        stream = growing.stream_growing(spark, str(raw), chunk=500)
        stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.session_id, r.accel_x) for r in spark.read.parquet(out).collect())

    (raw / "a.bin").write_bytes(a[:37 * 20 + 36])  # the last frame lacks a byte
    assert trigger() == [("a", i) for i in range(20)]
    (raw / "a.bin").write_bytes(a[:37 * 60])
    (raw / "later" / "b.bin").write_bytes(b[:37])
    assert trigger() == [("a", i) for i in range(59)] + [("b", 1000)]
    assert trigger() == [("a", i) for i in range(59)] + [("b", 1000)]  # nothing new
    (raw / "a.bin").write_bytes(a)
    (raw / "later" / "b.bin").write_bytes(b)
    assert trigger() == [("a", i) for i in range(100)] + [("b", 1000 + i) for i in range(100)]
    offsets = [r.file_offset for r in spark.read.parquet(out).where("session_id = 'a'").orderBy("file_offset").collect()]
    assert offsets == [i * 37 + (7 if i >= 30 else 0) for i in range(100)]


def test_offsets_and_ranges(tmp_path):
    reader = growing.GrowingReader(str(tmp_path), "emg", 10)
    (tmp_path / "short.bin").write_bytes(b"x" * 10)
    assert reader.latestOffset() == {}
    (tmp_path / "s.bin").write_bytes(b"x" * 36)
    end = reader.latestOffset()
    assert list(end.values()) == [26] and list(end)[0].endswith("/s.bin")
    assert [(p.begin, p.stop) for p in reader.partitions({}, end)] == [(0, 10), (10, 20), (20, 26)]
    assert [(p.begin, p.stop) for p in reader.partitions({k: 15 for k in end}, end)] == [(15, 25), (25, 26)]
    assert reader.partitions(end, end) == []
