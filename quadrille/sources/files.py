"""Image files in; detections, markers, scenes and codes out."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..families import Family
from ..operators.detect import pixels_of
from ..schemas import IMAGE


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG and JPEG files as gray images, decoded by Spark's image source. Color becomes luma by integer weights."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return to_gray(raw)


def to_gray(raw: DataFrame) -> DataFrame:
    """Rows of the image source (blue, green, red[, alpha] bytes) as gray images."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, h, w, n, data in zip(*(b.column(c).to_pylist() for c in ("origin", "height", "width", "nChannels", "data")), strict=True):
                if data is None:  # nothing to decode: an image without pixels, which has no detections
                    yield pa.RecordBatch.from_arrays([pa.array([origin], pa.string()), *(pa.array([x], pa.int32()) for x in (w, h, w)), pa.array([None], pa.binary())], ["image_id", "width", "height", "stride", "data"])
                    continue
                p = np.frombuffer(data, np.uint8).reshape(h, w, n)
                gray = p[..., 0] if n == 1 else (29 * p[..., 0].astype(np.uint32) + 150 * p[..., 1] + 77 * p[..., 2] >> 8).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([np.ascontiguousarray(gray).tobytes()], pa.binary())], ["image_id", "width", "height", "stride", "data"])

    return raw.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, IMAGE)


def to_json(per_image: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON object for each image."""
    text = F.to_json(F.struct(F.col("image_id").alias("file"), "image_width", "image_height", "detections"), {"pretty": str(pretty).lower()})
    per_image.select(text.alias("value")).write.text(path, lineSep="\n")


def truth_json(truth: DataFrame, path: str) -> None:
    """One JSON object for each image with all that lies in it, to go beside its encoded() file."""
    fields = [c for c in truth.columns if c != "image_id"]
    listed = truth.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("family", "id", *[c for c in fields if c not in ("family", "id")]))).alias("tags"))
    listed.select(F.to_json(F.struct(F.col("image_id").alias("file"), "tags")).alias("value")).write.text(path)


def report_json(reports: DataFrame, path: str) -> None:
    """A line of JSON for each scenario of a report; its totals come from operators.evaluate.totals()."""
    reports.select(F.to_json(F.struct(*reports.columns)).alias("value")).write.text(path)


def png(img: np.ndarray) -> bytes:
    """An 8-bit PNG: gray for two dimensions, RGBA for three."""
    h, w = img.shape[:2]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if img.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def pgm(img: np.ndarray) -> bytes:
    h, w = img.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(img).tobytes()


def tag_image(family: Family, id_: int, scale: int = 1) -> np.ndarray:
    """A marker as RGBA pixels, each cell scale pixels wide."""
    n = family.layout.size
    rgba = np.frombuffer(family.rgba(id_), np.uint8).reshape(n, n, 4)
    return rgba.repeat(scale, 0).repeat(scale, 1)


def mosaic_image(family: Family, ids: list[int], columns: int | None = None, scale: int = 1) -> np.ndarray:
    """Markers in rows, a transparent cell apart."""
    side = (family.layout.size + 1) * scale
    columns = columns or max(1, int(np.ceil(np.sqrt(len(ids)))))
    out = np.zeros((-(-len(ids) // columns) * side, columns * side, 4), np.uint8)
    for k, i in enumerate(ids):
        y, x = k // columns * side, k % columns * side
        t = tag_image(family, i, scale)
        out[y : y + len(t), x : x + len(t)] = t
    return out


def pdf(family: Family, ids: list[int], cell: float = 5.0, columns: int = 1, rows: int = 1) -> bytes:
    """A PDF of A4 pages with rows x columns markers each, a cell so many points wide."""
    width, height = 595.0, 842.0
    per, pages = columns * rows, []
    for lo in range(0, len(ids), per):
        ops = []
        for k, i in enumerate(ids[lo : lo + per]):
            cells = family.render(i)
            n = len(cells)
            x0 = width * (k % columns + 0.5) / columns - n * cell / 2
            y0 = height * (1 - (k // columns + 0.5) / rows) + n * cell / 2
            for y, x in zip(*np.nonzero(cells >= 0), strict=True):
                ops.append(f"{'1' if cells[y, x] else '0'} g {x0 + x * cell:.2f} {y0 - (y + 1) * cell:.2f} {cell:.2f} {cell:.2f} re f")
        pages.append("\n".join(ops).encode())
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(pages))))]
    for k, body in enumerate(pages):
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << >> >>" % (width, height, 4 + 2 * k))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
    out, at = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def code_file(family: Family) -> bytes:
    """The codes as little-endian 64-bit numbers."""
    return family.codes.astype("<u8").tobytes()


def encoded(images: DataFrame, kind: str = "pgm") -> DataFrame:
    """(image_id, file) with each image as the bytes of a PGM or PNG file."""
    write = {"pgm": pgm, "png": png}[kind]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image_id, w, h, stride, data in zip(*(b.column(c).to_pylist() for c in ("image_id", "width", "height", "stride", "data")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([image_id]), pa.array([write(pixels_of(data, w, h, stride))], pa.binary())], ["image_id", "file"])

    return images.mapInArrow(run, "image_id string, file binary")


def parse_ids(spec: str) -> list[int]:
    """Ids like "0-4,7,10-12"."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, _, hi = part.partition("-")
        a, b = int(lo), int(hi or lo)
        if b < a:
            raise ValueError(f"{part!r} runs backward")
        out += range(a, b + 1)
    return out
