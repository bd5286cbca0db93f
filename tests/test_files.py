"""Files cut in mid-line, hidden and unreadable ones."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewright.sources import files


def test_heads_drop_the_cut_line(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "a/one.txt").write_bytes(b"first\nsecond\r\nthird")
    (tmp_path / "a/two.txt").write_bytes(b"no end")
    (tmp_path / "a/three.txt").write_bytes("é\nbad \xff".encode("latin-1") + b"\n")
    (tmp_path / "a/empty.txt").write_bytes(b"")
    (tmp_path / "_hidden/x.txt").write_bytes(b"hidden\n")
    (tmp_path / "a/other.csv").write_bytes(b"csv\n")
    rows = lambda **kw: sorted((r["path"].split("/")[-1], r["line_no"], r["line"]) for r in files.heads(spark, str(tmp_path), suffix=".txt", **kw).collect())
    assert rows() == [("one.txt", 1, "first"), ("one.txt", 2, "second"), ("three.txt", 1, "�"), ("three.txt", 2, "bad �")]
    assert rows(size=9) == [("one.txt", 1, "first"), ("three.txt", 1, "�"), ("three.txt", 2, "bad �")]
    assert rows(size=6, per_task=1) == [("one.txt", 1, "first"), ("three.txt", 1, "�")]
    assert rows(size=2) == [("three.txt", 1, "�")]
    assert {r["size_bytes"] for r in files.heads(spark, f"file://{tmp_path}/a", suffix="one.txt").collect()} == {19}


def test_heads_of_an_empty_folder_and_many_lines(spark, tmp_path):
    assert files.heads(spark, str(tmp_path)).count() == 0
    (tmp_path / "long.txt").write_text("".join(f"{k}\n" for k in range(10_000)))
    got = files.heads(spark, str(tmp_path), size=1 << 20)
    assert got.count() == 10_000 and got.where("line_no <> cast(line as long) + 1").count() == 0


def test_scan_images(spark, tmp_path):
    for name in ("W11A_2024_05_06_1210.jpg", "note.jpg", "W11A_2024_05_06_1310.png"):
        (tmp_path / "46001" / "2024").mkdir(parents=True, exist_ok=True)
        (tmp_path / "46001/2024" / name).write_bytes(b"x" * 7)
    (row,) = files.scan_images(spark, str(tmp_path)).collect()
    assert (row["station_id"], row["camera"], row["size_bytes"]) == ("46001", "W11A", 7) and row["time_utc"].hour == 12
    assert {r["top"] for r in files.scan(spark, str(tmp_path)).collect()} == {"46001"} and files.scan(spark, str(tmp_path), ".png").count() == 1


def test_newest_readable_falls_back(spark, tmp_path):
    for k in range(12):
        text = json.dumps([{"k": k}])
        (tmp_path / f"cams_202401{k + 1:02d}T000000Z.json").write_text(text if k < 2 else text[:-2])
    (tmp_path / "cams_latest.json").write_text("[]")
    stamp = lambda p: F.nullif(F.regexp_extract(p, "cams_([0-9]{8}T[0-9]{6}Z)[.]json$", 1), F.lit(""))
    readable = lambda t: t.rlike("\\]$")
    for step in (1, 4, 100):
        (row,) = files.newest_readable(spark, str(tmp_path), stamp, readable, step).collect()
        assert row["stamp"] == "20240102T000000Z" and json.loads(row["text"]) == [{"k": 1}]
    assert files.newest_readable(spark, str(tmp_path), stamp, lambda t: F.lit(False)).count() == 0


def test_bytes_needed(spark):
    now = datetime(2024, 1, 2)
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 23), now), (None, now), (datetime(2024, 1, 3), now), (datetime(2020, 1, 1), now)], "last timestamp, now timestamp")
    got = [r[0] for r in rows.select(files.bytes_needed(F.col("last"), F.col("now"), 100, 5000)).collect()]
    assert got == [300, 5000, 200, 5000]
