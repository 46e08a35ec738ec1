"""Images: token formulas, geometry decisions, exact area averages, and header validation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_SIDE, MAX_PIXELS, CROP_SIDE = 10 * 1024 * 1024, 8192, 16_777_216, 1536


def tile_tokens(width: Column, height: Column) -> Column:
    """85 + 170 per 512-pixel tile after fitting into 2048 and the short side to 768, never enlarging."""
    fit = F.least(F.lit(1.0), 2048.0 / F.greatest(width, height))
    w, h = F.floor(width * fit), F.floor(height * fit)
    s = F.when(F.least(w, h) > 768, 768.0 / F.least(w, h)).otherwise(F.lit(1.0))
    return (85 + 170 * F.ceil(F.floor(w * s) / 512.0) * F.ceil(F.floor(h * s) / 512.0)).cast("long")


def patch_tokens(width: Column, height: Column, limit: int = 1568) -> Column:
    """28-pixel patches; the largest long side (at most ``limit``) with at most ``limit`` patches."""
    patches = lambda w, h: F.ceil(w / 28.0) * F.ceil(h / 28.0)
    long, short = F.greatest(width, height), F.least(width, height)
    at = lambda x: patches(x, F.floor(x * (short / long) + 0.5))
    fitting = F.filter(F.sequence(F.least(F.lit(limit), long).cast("int"), F.lit(1), F.lit(-1)), lambda x: at(x) <= limit)
    return F.when((long <= limit) & (patches(width, height) <= limit), patches(width, height)).otherwise(F.coalesce(F.get(F.transform(fitting, at), F.lit(0)), F.lit(0))).cast("long")


def crop_decision(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """What a crop request comes to, before any pixel is read."""
    outside = (x < 0) | (y < 0) | (w < 1) | (h < 1) | (x + w > width) | (y + h > height)
    return F.when(outside, "crop_out_of_bounds").when((x == 0) & (y == 0) & (w == width) & (h == height), "original").when((w > CROP_SIDE) | (h > CROP_SIDE), "resize_required").otherwise("cropped")


def overview_size(width: Column, height: Column, max_side: int = 512) -> Column:
    """(width, height) fitted into ``max_side``, never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.floor(width * scale + 0.5)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(height * scale + 0.5)).cast("int").alias("height"))


def _weights(n: int, m: int) -> np.ndarray:
    """Overlap of source pixel j with target pixel i in units of 1/m and 1/n: an m x n integer matrix."""
    lo = np.maximum.outer(np.arange(m) * n, np.arange(n) * m)
    hi = np.minimum.outer((np.arange(m) + 1) * n, (np.arange(n) + 1) * m)
    return np.clip(hi - lo, 0, None).astype(np.int64)


def area_average(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Exact area average of an (h, w, channels) image, rounded half up."""
    h, w = pixels.shape[:2]
    total = np.einsum("ih,hwc,jw->ijc", _weights(h, height), pixels.astype(np.int64), _weights(w, width))
    area = h * w
    return ((2 * total + area) // (2 * area)).astype(np.uint8)


def region_band(top: Column, bottom: Column, width: Column, height: Column, margin: Column) -> Column:
    """Full-width band around a text line, clamped to the image."""
    y0, y1 = F.greatest(F.lit(0), F.floor(top - margin)), F.least(height, F.ceil(bottom + margin))
    return F.struct(F.lit(0).alias("x"), y0.cast("int").alias("y"), width.cast("int").alias("w"), (y1 - y0).cast("int").alias("h"))


PROFILE = "width int, height int, channels int, alpha boolean, ancillary array<string>, frame string, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_profile(data: bytes) -> tuple:
    """Header facts of an 8-bit RGB(A) PNG, or the code of what is wrong with it."""
    bad = lambda code: (None, None, None, None, None, None, code)
    if len(data) > MAX_BYTES:
        return bad("too_large")
    if data[:8] != _SIGNATURE:
        return bad("not_png")
    at, size, extra, body, ended, last = 8, None, [], [], False, ""
    while at < len(data):
        if at + 12 > len(data):
            return bad("truncated_chunk")
        n = struct.unpack_from(">I", data, at)[0]
        kind, end = data[at + 4 : at + 8], at + 12 + n
        if end > len(data):
            return bad("truncated_chunk")
        if zlib.crc32(data[at + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return bad("bad_crc")
        if (kind == b"IHDR") != (at == 8):
            return bad("header_order")
        if kind == b"IHDR":
            if n != 13:
                return bad("bad_header")
            w, h, depth, colour, *rest = struct.unpack_from(">IIBBBBB", data, at + 8)
            if depth != 8 or colour not in (2, 6) or any(rest):
                return bad("unsupported_format")
            if not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE and w * h <= MAX_PIXELS):
                return bad("dimensions")
            size = (w, h, 4 if colour == 6 else 3)
        elif kind == b"IDAT":
            if body and last != "IDAT":
                return bad("data_order")
            body.append(data[at + 8 : end - 4])
        elif kind == b"IEND":
            ended = n == 0 and end == len(data)
            break
        elif kind[0] & 32:
            extra.append(kind.decode("latin-1"))
            if len(extra) > 32:
                return bad("too_many_chunks")
        else:
            return bad("unknown_critical_chunk")
        last, at = kind.decode("latin-1"), end
    if not ended or size is None or not body:
        return bad("incomplete")
    stride = 1 + size[0] * size[2]
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(body), stride * size[1] + 1)
    except zlib.error:
        return bad("bad_data")
    if len(raw) != stride * size[1] or not inflate.eof:
        return bad("data_length")
    if max(raw[::stride]) > 4:
        return bad("bad_filter")
    return (*size, size[2] == 4, sorted(set(extra)), "png", None)


def jpeg_profile(data: bytes) -> tuple:
    """Frame facts of a JPEG by a marker walk, or the code of what is wrong with it."""
    bad = lambda code: (None, None, None, None, None, None, code)
    if len(data) > MAX_BYTES:
        return bad("too_large")
    if data[:2] != b"\xff\xd8":
        return bad("not_jpeg")
    at, size, segments, scans = 2, None, [], 0
    while True:
        while at < len(data) and data[at] == 0xFF and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            return bad("marker_expected")
        mark = data[at + 1]
        at += 2
        if mark == 0xD9:
            return (*size, False, sorted(set(segments)), "jpeg", None) if size and scans else bad("incomplete")
        if at + 2 > len(data):
            return bad("truncated_segment")
        n = struct.unpack_from(">H", data, at)[0]
        if n < 2 or at + n > len(data):
            return bad("truncated_segment")
        seg = data[at + 2 : at + n]
        if mark in (0xC0, 0xC1, 0xC2):
            if size:
                return bad("second_frame")
            if len(seg) < 6 or seg[0] != 8 or seg[5] not in (1, 3):
                return bad("unsupported_format")
            h, w = struct.unpack_from(">HH", seg, 1)
            if not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE and w * h <= MAX_PIXELS):
                return bad("dimensions")
            size = (w, h, seg[5])
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return bad("unsupported_format")
        elif 0xE0 <= mark <= 0xEF or mark == 0xFE:
            segments.append("COM" if mark == 0xFE else f"APP{mark - 0xE0}")
        at += n
        if mark == 0xDA:
            if not size:
                return bad("scan_before_frame")
            scans += 1
            if scans > 64:
                return bad("too_many_scans")
            while True:  # entropy-coded bytes up to the next marker that isn't a restart or stuffing
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    return bad("unterminated_scan")
                if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                    at += 2
                    continue
                break


def image_profile(data: bytes | None) -> tuple:
    if not data:
        return (None, None, None, None, None, None, "empty")
    try:
        return jpeg_profile(data) if data[:2] == b"\xff\xd8" else png_profile(data)
    except (struct.error, IndexError):
        return (None, None, None, None, None, None, "truncated")


def profiles(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, image_id, byte_length, sha256 + PROFILE`` of binary files."""
    names = [c.split()[0] for c in PROFILE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([image_profile(bytes(b) if b is not None else None) for b in pdf["_data"]], columns=names)
            for c in ("width", "height", "channels"):
                out[c] = out[c].astype("Int32")
            out["alpha"] = out["alpha"].astype("boolean")
            yield pd.concat([pdf[["path", "image_id", "byte_length", "sha256"]].reset_index(drop=True), out], axis=1)

    sha = F.sha2(F.col(content), 256)
    rows = files.select(F.col(path).alias("path"), F.concat(F.lit("image_"), F.substring(F.sha2(F.encode(F.concat(F.col(path), F.lit("\0"), sha), "utf-8"), 256), 1, 16)).alias("image_id"), F.octet_length(content).cast("long").alias("byte_length"), sha.alias("sha256"), F.col(content).alias("_data"))
    return rows.mapInPandas(run, f"path string, image_id string, byte_length long, sha256 string, {PROFILE}")


def reinspect(index: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed images against a fresh scan: ``same``, ``source_changed`` or ``missing``."""
    now = files.select("path", F.sha2("content", 256).alias("_sha"), F.octet_length("content").cast("long").alias("_n"))
    state = F.when(F.col("_sha").isNull(), "missing").when((F.col("_sha") != F.col("sha256")) | (F.col("_n") != F.col("byte_length")), "source_changed").otherwise("same")
    return index.join(now, "path", "left").withColumn("state", state).drop("_sha", "_n")


def region_window(x: Column, y: Column, width: Column, height: Column, w: int, h: int) -> Column:
    """A window of at most w x h centred on a point, clamped to the image."""
    ww, hh = F.least(F.lit(w), width), F.least(F.lit(h), height)
    x0 = F.greatest(F.lit(0), F.least(F.floor(x - ww / 2 + 0.5), width - ww))
    y0 = F.greatest(F.lit(0), F.least(F.floor(y - hh / 2 + 0.5), height - hh))
    return F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), ww.cast("int").alias("w"), hh.cast("int").alias("h"))


def best_line(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The text line with the most hits, then the highest confidence, then the first."""
    rest = F.struct(*[c for c in lines.columns if c not in keys])
    return lines.where("hits > 0").groupBy(*keys).agg(F.max_by(rest, F.struct("hits", "confidence", -F.col("line_no"))).alias("r")).select(*keys, "r.*")
