"""GeoTIFF: a codec for float and integer tiles, and Spark data sources that read and write it.

Reads strips or tiles, chunky or planar, plain or deflate (with or without the horizontal
predictor), of 8-, 16- or 32-bit integers and 32- or 64-bit floats, with pixel scale and tie point.
Writes deflate strips.
"""

from __future__ import annotations

import glob
import mmap
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# TIFF field types (size, struct code) and tags.
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
EPSG_KEY = 3072


def header(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    if struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    fields = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
        size, code = _TYPES.get(kind, (1, "B"))
        place = entry + 8 if size * n <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        raw = data[place : place + size * n]
        fields[tag] = (raw.rstrip(b"\0").decode(),) if kind == 2 else struct.unpack(order + code * n, raw)
    return order, fields


def geo(fields: dict[int, tuple]) -> dict:
    """x0, y0 (upper left corner), res and epsg; None where absent, as in files placed by a side file."""
    keys = fields.get(GEO_KEYS, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] == EPSG_KEY), None)
    if PIXEL_SCALE not in fields or TIE_POINT not in fields:
        return {"x0": None, "y0": None, "res": None, "epsg": epsg}
    col, row, _, x, y, _ = fields[TIE_POINT][:6]
    sx, sy = fields[PIXEL_SCALE][:2]
    return {"x0": x - col * sx, "y0": y + row * sy, "res": sx, "epsg": epsg}


def decode(data: bytes) -> tuple[np.ndarray, dict]:
    """(bands, height, width) and the placement."""
    order, f = header(data)
    width, height, bands = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
    bits, kind = f.get(BITS, (1,))[0], f.get(FORMAT, (1,))[0]
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    packing, predictor, planar = f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0], f.get(PLANAR, (1,))[0] == 2
    if packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {packing} with predictor {predictor} is not supported")
    tiled = TILE_OFFSETS in f
    bw, bh = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(f.get(ROWS, (height,))[0], height))
    offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[OFFSETS], f[COUNTS])
    across, down = -(-width // bw), -(-height // bh)
    deep = 1 if planar else bands
    out = np.zeros((bands, height, width), dtype.newbyteorder("="))
    for i, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(i, across * down)
        r, c = divmod(place, across)
        raw = data[at : at + n]
        raw = zlib.decompress(raw) if packing != 1 else raw
        rows = bh if tiled else min(bh, height - r * bh)
        block = np.frombuffer(raw, dtype, rows * bw * deep).reshape(rows, bw, deep)
        if predictor == 2:
            block = np.cumsum(block, 1, dtype=block.dtype.newbyteorder("="))
        rows, columns = min(rows, height - r * bh), min(bw, width - c * bw)
        part = block[:rows, :columns].transpose(2, 0, 1)
        out[plane if planar else slice(None), r * bh : r * bh + rows, c * bw : c * bw + columns] = part[0] if planar else part
    nodata = f.get(NO_DATA, (None,))[0]
    return out, geo(f) | {"nodata": nodata}


def encode(bands: np.ndarray, x0: float, y0: float, res: float, epsg: int = 2056, nodata: str | None = None, rows: int = 64) -> bytes:
    """Deflate strips, chunky."""
    n, height, width = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    chunky = np.ascontiguousarray(bands.transpose(1, 2, 0)).astype(bands.dtype.newbyteorder("<"))
    strips = [zlib.compress(chunky[r : r + rows].tobytes(), 6) for r in range(0, height, rows)]
    body, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(body))
        body += s + b"\0" * (len(s) & 1)
    fields = {
        WIDTH: (4, (width,)),
        HEIGHT: (4, (height,)),
        BITS: (3, (bands.dtype.itemsize * 8,) * n),
        COMPRESSION: (3, (8,)),
        PHOTOMETRIC: (3, (1,)),
        OFFSETS: (4, tuple(offsets)),
        SAMPLES: (3, (n,)),
        ROWS: (4, (rows,)),
        COUNTS: (4, tuple(len(s) for s in strips)),
        PLANAR: (3, (1,)),
        FORMAT: (3, (kind,) * n),
        PIXEL_SCALE: (12, (res, res, 0.0)),
        TIE_POINT: (12, (0.0, 0.0, 0.0, x0, y0, 0.0)),
        GEO_KEYS: (3, (1, 1, 0, 2, 1024, 0, 1, 1, EPSG_KEY, 0, 1, epsg)),
    }
    if nodata is not None:
        fields[NO_DATA] = (2, nodata)
    start = 8 + len(body)
    extra_at = start + 2 + 12 * len(fields) + 4
    directory, extra = struct.pack("<H", len(fields)), b""
    for tag in sorted(fields):
        kind, values = fields[tag]
        raw = values.encode() + b"\0" if kind == 2 else struct.pack("<" + _TYPES[kind][1] * len(values), *values)
        count = len(raw) if kind == 2 else len(values)
        if len(raw) <= 4:
            directory += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
        else:
            directory += struct.pack("<HHII", tag, kind, count, extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) & 1)
    return b"II*\0" + struct.pack("<I", start) + body + directory + b"\0" * 4 + extra


SUFFIXES = {4: "_rgbchm.tif", 6: "_nirchm.tif"}


def tile_paths(folders: list[str], suffix: str) -> list[str]:
    """Files of each folder in name order, folders in the order given."""
    return [p for folder in folders for p in sorted(glob.glob(f"{glob.escape(folder)}/*{suffix}"))]


def place_of(path: str) -> tuple[str | None, str | None]:
    """Cell key and acquisition date that a path names."""
    cell = re.search(r"(c\d+_r\d+)", os.path.basename(path))
    date = re.search(r"(\d{8})", os.path.basename(os.path.dirname(path)))
    return cell and cell[1], date and date[1]


class TiffSource(DataSource):
    """``spark.read.format("tesselon_tiff").option("suffix", ...).load(folders)``: one row a tile.

    Options: path (folders joined by commas), suffix, bands and epsg (asserted if given), metaonly.
    Writing takes rows of path, x0, y0, res and bands (arrays of floats) with height and width.
    """

    @classmethod
    def name(cls) -> str:
        return "tesselon_tiff"

    def schema(self) -> str:
        return "path string, cell string, date string, height int, width int, x0 double, y0 double, res double, epsg int, bands array<array<float>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folders = options["path"].split(",")
        self.suffix = options.get("suffix", ".tif")
        self.bands, self.epsg = (int(v) if (v := options.get(k)) else None for k in ("bands", "epsg"))
        self.meta = str(options.get("metaonly", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in tile_paths(self.folders, self.suffix)]

    def read(self, part: _File) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if self.meta else f.read()  # a header needs a few pages only
        cell, date = place_of(part.path)
        if self.meta:
            _, fields = header(data)
            height, width, n, place, flat = fields[HEIGHT][0], fields[WIDTH][0], fields.get(SAMPLES, (1,))[0], geo(fields), None
        else:
            arr, place = decode(data)
            n, height, width = arr.shape
            flat = [band.astype(np.float32).ravel().tolist() for band in arr]
        if self.bands and n != self.bands:
            raise ValueError(f"{part.path} has {n} bands, not {self.bands}")
        if self.epsg and place["epsg"] != self.epsg:
            raise ValueError(f"{part.path} is in EPSG:{place['epsg']}, not {self.epsg}")
        yield part.path, cell, date, height, width, place["x0"], place["y0"], place["res"], place["epsg"], flat


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.folder, self.nodata = options["path"], options.get("nodata")

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        for row in rows:
            arr = np.array(row["bands"], np.float32).reshape(len(row["bands"]), row["height"], row["width"])
            target = os.path.join(self.folder, os.path.basename(row["path"]))
            temporary = f"{target}.{uuid.uuid4().hex}"
            with open(temporary, "wb") as f:
                f.write(encode(arr, row["x0"], row["y0"], row["res"], row["epsg"] or 2056, self.nodata))
            os.replace(temporary, target)
        return WriterCommitMessage()


def register(spark) -> None:
    spark.dataSource.register(TiffSource)
