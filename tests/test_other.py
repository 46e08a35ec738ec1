import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import images, intervals, store
from marginalia.sources import files
from marginalia.streaming import ingest


def png(w=2, h=2, colour=2, extra=b"", raw=None):
    def chunk(k, d):
        return struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))

    n = 4 if colour == 6 else 3
    body = raw if raw is not None else (b"\0" + bytes(w * n)) * h
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_profiles():
    assert images.image_profile(png())[:4] == (2, 2, 3, False)
    assert images.image_profile(png(colour=6))[3] is True
    assert images.image_profile(png(raw=b"\0\0"))[-1] == "data_length"
    assert images.image_profile(png(raw=(b"\x05" + bytes(6)) * 2))[-1] == "bad_filter"
    assert images.image_profile(png()[:-5])[-1] == "truncated_chunk"
    broken = bytearray(png())
    broken[20] ^= 1
    assert images.image_profile(bytes(broken))[-1] == "bad_crc"
    assert images.image_profile(b"")[-1] == "empty" and images.image_profile(None)[-1] == "empty" and images.image_profile(b"GIF")[-1] == "not_png"


def test_jpeg_profiles():
    sof = b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00"
    sos = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34"
    data = b"\xff\xd8\xff\xe0\x00\x04ab" + sof + sos + b"\xff\xd9"
    assert images.image_profile(data)[:3] == (32, 16, 1) and images.image_profile(data)[5] == "jpeg"
    assert images.image_profile(data[:-2])[-1] == "unterminated_scan"
    assert images.image_profile(b"\xff\xd8" + sos + b"\xff\xd9")[-1] == "scan_before_frame"


def test_area_average():
    checker = np.array([[[0], [255]], [[255], [0]]], dtype=np.uint8)
    assert images.area_average(checker, 1, 1)[0, 0, 0] == 128
    assert images.area_average(np.array([[[0], [90], [240]]], dtype=np.uint8), 2, 1)[0, :, 0].tolist() == [30, 190]


def test_image_tokens(spark):
    rows = [(256, 256, 255, 100), (768, 768, 765, None), (1536, 864, 1105, None), (2049, 1000, 1445, 1568), (512, 512, None, 361), (1092, 1092, None, 1521)]
    df = spark.createDataFrame(rows, "w long, h long, t long, p long").select("*", images.tile_tokens(F.col("w"), F.col("h")).alias("a"), images.patch_tokens(F.col("w"), F.col("h")).alias("b"))
    for r in df.collect():
        assert r["t"] in (None, r["a"]) and r["p"] in (None, r["b"])


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes("﻿가\n".encode())
    p = images.profiles(files.read_binary(spark, str(tmp_path), [str(tmp_path)], "*.png")).first()
    assert (p["width"], p["error"]) == (2, None) and p["image_id"].startswith("image_")
    got = {r["path"][-5:]: (r["valid"], r["text"]) for r in files.read_texts(spark, str(tmp_path), [str(tmp_path)], "*.txt").collect()}
    assert got == {"b.txt": (False, None), "c.txt": (True, "﻿가\n")}
    for path, roots, code in ((tmp_path / "a.png", [], "empty_roots"), ("/etc/passwd", [str(tmp_path)], "denied"), (tmp_path / "no", [str(tmp_path)], "read_failure"), (tmp_path, [str(tmp_path)], "non_regular")):
        with pytest.raises(files.SourceError, match=code):
            files.check_path(str(path), roots)


def test_strict_json(spark, tmp_path):
    assert files.strict_json('{"a": [1, {"b": "[[["}]}') == {"a": [1, {"b": "[[["}]}
    for bad in ('{"a": 1, "a": 2}', '{"x": {"a": 1, "a": 2}}', "﻿{}", "NaN", "[" * 200 + "]" * 200):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "x long, y string")
    files.write_jsonl(df, str(tmp_path / "o"))
    files.write_jsonl(df, str(tmp_path / "o"))
    assert files.read_jsonl(spark, str(tmp_path / "o"), "x long, y string", "*.json").count() == 4
    assert files.markdown(df.orderBy("x")).splitlines()[2] == "| 1 | a\\|b |"


def test_intervals(spark):
    s = spark.createDataFrame([("d", 1, 3), ("d", 3, 5), ("d", 6, 8), ("d", 7, 7), ("e", 1, 1)], "k string, start_line int, end_line int")
    m = sorted((r["k"], r["start_line"], r["end_line"], r["merged"]) for r in intervals.merge_spans(s, "k").collect())
    assert m == [("d", 1, 5, 2), ("d", 6, 8, 2), ("e", 1, 1, 1)]
    p = spark.createDataFrame([("d", 5), ("d", 200)], "k string, line int")
    wide = spark.createDataFrame([("d", 1, 300), ("d", 6, 8)], "k string, start_line int, end_line int")
    assert sorted((r["line"], r["end_line"]) for r in intervals.contained(p, wide, "k", "line").collect()) == [(5, 300), (200, 300)]
    left = spark.createDataFrame([("d", 1, 300)], "k string, l_start int, l_end int")
    right = spark.createDataFrame([("d", 100, 500), ("d", 301, 302)], "k string, r_start int, r_end int")
    assert intervals.overlapping(left, right, "k").count() == 1


def test_store():
    s = store.Store(100)
    assert s.put("a", 60) == 0 and s.put("b", 30) == 0 and s.get("a") and s.put("c", 30) == 1
    assert not s.get("b") and s.get("a") and s.put("big", 500) == 2 and s.total == 500 and s.put("d", 1) == 1
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            store.Store(bad)


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a/x.txt", "token: abc\n"), (2, "a/y.txt", None)], "doc_id long, path string, text string").write.parquet(str(src))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, str(src), "doc_id long, path string, text string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["doc_id"]: (r["mode"], r["line_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("exact", 1), 2: ("unknown", 0)}


def test_recorded_image_sizes(spark, tmp_path):
    import json

    from marginalia.plans import catalogue

    turn = {"turn": 1, "question": "q", "toolCalls": [{"id": "c", "result": {"images": [{"width": 256, "height": 256}, {"width": 1536, "height": 864}]}}], "originalsRequested": [{"artifactId": "a", "width": 512, "height": 384}, {"artifactId": "b", "width": 256, "height": 256}, {"artifactId": "c", "width": 0, "height": 5}]}
    spark.createDataFrame([(1, json.dumps({"turns": [turn]}), 1)], "record_id long, body string, received_at long").write.parquet(str(tmp_path / "session_record.parquet"))
    q = catalogue.queries()
    tokens = {(r["w"], r["h"]): r["tiles"] for r in q["image_tokens_recorded"](spark, str(tmp_path)).collect()}
    assert set(tokens) == {(256, 256), (1536, 864), (512, 384)} and tokens[256, 256] == 255 and tokens[1536, 864] == 1105
    assert {(r["w"], r["h"]) for r in q["overview_sizes_recorded"](spark, str(tmp_path)).collect()} == set(tokens)
