"""Lines by byte range: every range size gives the same lines; growing files lose and double nothing."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom.sources import bytelines, jsonl
from labelloom.sources.session import work_path


def written(tmp_path):
    rng = random.Random(5)
    for name in ("a.log", "b.log"):
        lines = ["x" * rng.choice([0, 1, 2, 7, 30, 31, 32, 200]) + rng.choice(["", "é", "日", "\r"]) for _ in range(300)]
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"\n" if name == "a.log" else b""))
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "one.log").write_bytes(b"no feed")
    (tmp_path / "_hidden.log").write_bytes(b"no\n")
    (tmp_path / "feeds.log").write_bytes(b"\n\n\n")
    want = {}
    for path in sorted(tmp_path.glob("[!_]*.log")):
        lines = path.read_bytes().split(b"\n")
        want[path.name] = [x.removesuffix(b"\r").decode() for x in (lines if lines[-1] else lines[:-1])]
    return want


def test_ranges_of_any_size_hold_each_line_once(tmp_path, monkeypatch):
    want = written(tmp_path)
    for size, chunk in ((1, 4 << 20), (3, 2), (32, 33), (1000, 7), (1 << 20, 64), (1 << 20, 4 << 20)):
        monkeypatch.setattr(bytelines, "CHUNK", chunk)
        reader = bytelines._Reader({"path": str(tmp_path), "glob": "*.log", "rangebytes": str(size)})
        got = {}
        for part in reader.partitions():
            for batch in reader.read(part):
                for row in batch.to_pylist():
                    got.setdefault(row["path"].rsplit("/", 1)[1], []).append(row)
        for name, lines in want.items():
            rows = sorted(got.get(name, []), key=lambda r: r["at"])
            assert [r["value"] for r in rows] == lines, (name, size, chunk)
            data = (tmp_path / name).read_bytes()
            assert all(r["at"] == 0 or data[r["at"] - 1 : r["at"]] == b"\n" for r in rows)


def test_numbers_without_a_copy(spark, tmp_path):
    want = written(tmp_path)
    lines = jsonl.read_numbered_lines(spark, str(tmp_path), glob="*.log", range_bytes=100)
    got = {}
    for r in lines.collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["line_no"], r["value"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in want.items() if v}
    assert jsonl.read_numbered_lines(spark, str(tmp_path), glob="nothing*").count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        jsonl.read_numbered_lines(spark, str(tmp_path / "nothing")).count()


def test_growing_files_across_restarts(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    out, state = work_path(spark, "tail-rows"), work_path(spark, "tail-state")

    def drain():
        rows = bytelines.tail_lines(spark, str(folder), "*.log", range_bytes=8)
        writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
        found = spark.read.schema(bytelines.SCHEMA).parquet(out).withColumn("name", F.substring_index("path", "/", -1))
        return [(r["name"], r["at"], r["value"]) for r in found.orderBy("name", "at").collect()]

    (folder / "a.log").write_text("one\ntwo is longer than a range\nthr")
    assert drain() == [("a.log", 0, "one"), ("a.log", 4, "two is longer than a range")]
    with open(folder / "a.log", "a") as f:
        f.write("ee\nfour\nfi")
    (folder / "b.log").write_text("\nlast")
    seen = drain()
    assert seen[2:] == [("a.log", 31, "three"), ("a.log", 37, "four"), ("b.log", 0, "")]
    assert drain() == seen  # nothing new, nothing doubled
    with open(folder / "a.log", "a") as f:
        f.write("ve\n")
    with open(folder / "b.log", "a") as f:
        f.write("\n")
    assert [x for x in drain() if x not in seen] == [("a.log", 42, "five"), ("b.log", 1, "last")]


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k:03d}.log").write_text(f"a{k}\nb{k}\n")
    lines = jsonl.read_numbered_lines(spark, str(tmp_path), glob="*.log")
    got = {(r.path.rsplit("/", 1)[1], r.line_no, r.value) for r in lines.collect()}
    assert got == {(f"{k:03d}.log", i + 1, f"{c}{k}") for k in range(300) for i, c in enumerate("ab")}
    assert bytelines.read_byte_lines(spark, str(tmp_path)).rdd.getNumPartitions() <= 40
    parts = [bytelines.ByteRange("x", at, at + 100) for at in range(0, 1000, 100)]
    assert [p for group in bytelines.packed(parts, 3, 1 << 30) for p in group.parts] == parts
    assert all(len(group.parts) == 1 for group in bytelines.packed(parts, 1, 1))
