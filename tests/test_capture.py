"""Captures: any range size gives the same rows; nothing is left of failed writes; streams go on where they stopped."""

import os
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orderflow.sources import capture


def write(path, frames, mark=capture.MICRO, cut=0):
    """A capture as other tools write it."""
    data = struct.pack("<IHHiIII", mark, 2, 4, 0, 0, 65_535, 1)
    for i, frame in enumerate(frames):
        data += struct.pack("<IIII", 1_700_000_000 + i, i * 7 % 10**6, len(frame), len(frame) + i % 3) + frame
    with open(path, "wb") as f:
        f.write(data[: len(data) - cut])
    return data


def frames(rnd, n):
    """Random frames, zeros, and some that look like headers of records."""
    fake = struct.pack("<IIII", 1_700_000_000, 5, 16, 16)
    return [rnd.choice([rnd.randbytes(rnd.randrange(1, 200)), bytes(rnd.randrange(1, 90)), fake * rnd.randrange(1, 9), fake[:11]]) for _ in range(n)]


def read(spark, path, size):
    capture.register(spark)
    return spark.read.format("pcap").option("rangeBytes", size).load(str(path))


@pytest.mark.parametrize("mark, unit", [(capture.MICRO, 1_000), (capture.NANO, 1)])
def test_ranges_of_any_size(tmp_path, monkeypatch, mark, unit):
    monkeypatch.setattr(capture, "SNAPLEN", 300)  # so that ranges begin far behind the file's head
    given = frames(random.Random(3), 400)
    data = write(tmp_path / "a.pcap", given, mark)
    want = [((1_700_000_000 + i) * 10**9 + i * 7 % 10**6 * unit, len(f) + i % 3, f) for i, f in enumerate(given)]
    for size in (40, 97, 1_000, 5_003, len(data), 10**9):
        got = [r for part in capture._ranges(capture._files(str(tmp_path)), size) for b in capture.records(part.path, part.start, part.end) for r in b.to_pylist()]
        assert [(r["ts_ns"], r["orig_len"], r["frame"]) for r in got] == want
        assert [r["at"] for r in got] == sorted({r["at"] for r in got})


def test_batch_reader(spark, tmp_path):
    rnd = random.Random(4)
    sets = [frames(rnd, n) for n in (150, 1, 0)]
    for i, s in enumerate(sets):
        write(tmp_path / f"{i}.pcap", s, cut=3 if i == 0 else 0)  # the last record of one file is cut off
    (tmp_path / "_hidden").write_bytes(b"no capture")
    want = sorted(sets[0][:-1] + sets[1])
    for size in (0, 333, 64 << 20):
        assert sorted(bytes(r.frame) for r in read(spark, tmp_path, size).collect()) == want
    assert read(spark, tmp_path / "1.pcap", 10).count() == 1
    (tmp_path / "bad.pcap").write_bytes(b"no capture at all, but long enough")
    with pytest.raises(Exception, match="no capture that is known"):
        read(spark, tmp_path, 0).collect()


def test_sink_leaves_nothing_of_failed_writes(spark, tmp_path):
    capture.register(spark)
    rows = spark.range(0, 300, 1, 5).select((F.col("id") * 10**8).alias("ts_ns"), F.lit(None).cast("int").alias("orig_len"), F.encode(F.format_string("frame %d", "id"), "utf-8").alias("frame"))
    out = str(tmp_path / "out")
    rows.write.format("pcap").mode("append").save(out)
    back = lambda: sorted((r.ts_ns, bytes(r.frame)) for r in read(spark, out, 64).collect())
    first = sorted((i * 10**8, b"frame %d" % i) for i in range(300))
    assert back() == first and not [f for f in os.listdir(out) if f == "_temporary" and os.listdir(f"{out}/{f}")]
    broken = rows.withColumn("frame", F.when(F.col("ts_ns") == 299 * 10**8, F.lit(b"")).otherwise(F.col("frame")))  # one task fails after it has begun, others succeed
    with pytest.raises(Exception, match="a frame has"):
        broken.write.format("pcap").mode("append").save(out)
    assert back() == first and os.listdir(f"{out}/_temporary") == []
    rows.limit(10).write.format("pcap").mode("append").save(out)
    assert len(back()) == 310
    rows.limit(7).write.format("pcap").mode("overwrite").save(out)
    assert len(back()) == 7
    with pytest.raises(Exception, match="captures need the columns"):
        rows.drop("frame").write.format("pcap").mode("append").save(out)


def test_task_that_dies_is_tried_again(tmp_path):
    """Of two attempts of one task, the one whose message is committed counts."""
    writer = capture._Writer(str(tmp_path / "out"), False)
    batch = pa.record_batch({"ts_ns": [1], "orig_len": pa.array([None], pa.int32()), "frame": [b"x"]})

    def dies():
        yield batch
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    writer.write(iter([batch]))  # an attempt whose message is lost
    done = writer.write(iter([batch]))
    writer.commit([done, writer.write(iter([])), None])
    assert os.listdir(tmp_path / "out" / "_temporary") == [] and len([f for f in os.listdir(tmp_path / "out") if f.endswith(".pcap")]) == 1
    other = capture._Writer(str(tmp_path / "out"), False)
    other.abort([other.write(iter([batch]))])
    assert os.listdir(tmp_path / "out" / "_temporary") == []


def test_stream_goes_on(spark, tmp_path):
    capture.register(spark)
    rnd, sent, folder = random.Random(9), [], tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("pcap").option("rangeBytes", 200).load(str(folder))
        query = stream.select("frame").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(bytes(r.frame) for r in spark.read.schema("frame binary").parquet(str(tmp_path / "out")).collect())

    for turn in range(3):
        for i in range(turn + 1):
            new = frames(rnd, 20)
            write(folder / f"{turn}-{i}.pcap", new)
            sent += new
        assert run() == sorted(sent)
    assert run() == sorted(sent)


def test_frames_and_destinations(spark):
    df = spark.createDataFrame([(b"abc", 3_758_096_385, 26_401), (b"", 1, 65_535), (None, 1, 1)], "payload binary, ip long, port int")
    df = df.withColumn("frame", capture.framed(F.col("payload"), F.col("ip"), F.col("port")))
    ip, port = capture.destination(F.col("frame"))
    assert [tuple(r) for r in df.select(ip, port, F.length("frame"), F.substring("frame", 43, 9)).collect()] == [(3_758_096_385, 26_401, 45, b"abc"), (1, 65_535, 42, b""), (None, None, None, None)]
