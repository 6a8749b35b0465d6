"""Media columns: AVI files of motion-JPEG as bytes in a column.

``write_avi`` makes a RIFF file (headers, ``movi`` list, ``idx1`` index) from JPEG frames;
``read_avi`` finds the video frames through the index, or by walking ``movi`` where that is
missing.  Frames are intra-coded, so each is decoded alone.  Shots are cut where the difference of
successive grey histograms exceeds an adaptive threshold: mean plus ``SPREAD`` standard deviations
of the differences in the window before it, and at least ``FLOOR``.  Each shot is a clip row.

Cases: a null text counts as empty, whose payload is 64 zero bytes; equal texts give equal files
and rows; a null media value gives no clips, one that is no AVI raises ValueError; a file without
frames has no clips; longer payloads take more frames, a file being bounded by RIFF's 4 GB; no rows
give no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesselon.llm import jpeg
from tesselon.llm.cluster import small_batches, tidy
from tesselon.llm.wordbytes import slices

RATE = 25
BINS = 16
WINDOW = 8
SPREAD = 2.0
FLOOR = 0.15
UNIT = 64
_NOTE = "samples="
#: Of the files of texts one in so many is read back by the general decoder (some 20 ms a frame).
GENERAL = 256


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes] | np.ndarray, width: int, height: int, rate: int = RATE, note: str = "") -> bytes:
    """``frames``: JPEG images as bytes, or an array with one image a row."""
    if isinstance(frames, np.ndarray):
        n, size = frames.shape
        even = size + (size & 1)
        body = np.zeros((n, 8 + even), np.uint8)
        body[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
        body[:, 8 : 8 + size] = frames
        movi, sizes, steps = body.tobytes(), np.full(n, size), np.full(n, 8 + even)
    else:
        movi = b"".join(_chunk(b"00dc", f) for f in frames)
        sizes = np.array([len(f) for f in frames], np.int64)
        steps = 8 + sizes + (sizes & 1)
    index = np.zeros((len(sizes), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # key frame
    index[:, 2] = 4 + np.cumsum(steps) - steps
    index[:, 3] = sizes
    top = int(sizes.max(initial=0))
    avih = struct.pack("<14I", 1_000_000 // rate, top * rate, 0, 0x10, len(sizes), 0, 1, top, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(sizes), top, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    parts = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    if note:
        parts += _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note.encode() + b"\0"))
    return _chunk(b"RIFF", b"AVI " + parts + _chunk(b"LIST", b"movi" + movi) + _chunk(b"idx1", index.tobytes()))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> dict:
    """width, height, rate, note, and offsets and sizes of the video frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"width": 0, "height": 0, "rate": float(RATE), "note": "", "offsets": np.zeros(0, np.int64), "sizes": np.zeros(0, np.int64)}
    movi, index, found = None, None, []
    for name, at, size in _walk(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, a, s in _walk(data, at + 4, at + size):
                if inner == b"avih":
                    micro, *_ = struct.unpack_from("<I", data, a)
                    out["rate"] = 1e6 / micro if micro else float(RATE)
                    out["width"], out["height"] = struct.unpack_from("<II", data, a + 32)
                elif inner == b"LIST" and data[a : a + 4] == b"strl":
                    for deep, b, _ in _walk(data, a + 4, a + s):
                        if deep == b"strh" and data[b : b + 4] == b"vids":
                            scale, rate = struct.unpack_from("<II", data, b + 20)
                            out["rate"] = rate / scale if scale and rate else out["rate"]
        elif name == b"LIST" and kind == b"INFO":
            for inner, a, s in _walk(data, at + 4, at + size):
                if inner == b"ICMT":
                    out["note"] = data[a : a + s].rstrip(b"\0").decode()
        elif name == b"LIST" and kind == b"movi":
            movi = at, size
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", 4 * (size // 16), at).reshape(-1, 4)
    if movi is not None:
        if index is not None and len(index):
            video = (index[:, 0] >> 16 == int.from_bytes(b"dc", "little")) | (index[:, 0] >> 16 == int.from_bytes(b"db", "little"))
            offsets = index[video, 2].astype(np.int64)
            if len(offsets):  # offsets count from the list's name, or in some files from the start
                offsets += movi[0] if data[movi[0] + offsets[0] : movi[0] + offsets[0] + 4][2:] in (b"dc", b"db") else 0
            out["offsets"], out["sizes"] = offsets + 8, index[video, 3].astype(np.int64)
        else:
            stack = [(movi[0] + 4, movi[0] + movi[1])]
            while stack:
                for name, at, size in _walk(data, *stack.pop()):
                    if name == b"LIST":
                        stack.append((at + 4, at + size))
                    elif name[2:] in (b"dc", b"db"):
                        found.append((at, size))
            found.sort()
            out["offsets"], out["sizes"] = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
    return out


def grey_frames(data: bytes, file: dict, plain: bool = False) -> list[np.ndarray] | np.ndarray:
    """First component of each frame; samples (frames x samples) where the file holds sample frames only, unless ``plain``."""
    if not len(file["offsets"]):
        return []
    if not plain and (file["sizes"] == jpeg.frame_bytes()).all():
        raw = np.frombuffer(data, np.uint8)
        step = np.diff(file["offsets"])
        if not len(step) or (step == step[0]).all():
            width = int(step[0]) if len(step) else int(file["sizes"][0])
            rows = np.lib.stride_tricks.as_strided(raw[file["offsets"][0] :], (len(file["offsets"]), int(file["sizes"][0])), (width, 1), writeable=False)
            samples = jpeg.decode_samples(rows)
            if samples is not None:
                return samples
    frames = [jpeg.decode(data[a : a + s]) for a, s in zip(file["offsets"].tolist(), file["sizes"].tolist(), strict=True)]
    return [f if f.ndim == 2 else f[..., 0] for f in frames]


def histograms(frames: list[np.ndarray] | np.ndarray) -> np.ndarray:
    if isinstance(frames, np.ndarray):
        n = len(frames)
        at = (frames.astype(np.int64) * BINS >> 8) + np.arange(n)[:, None] * BINS
        return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / frames.shape[1]
    return np.array([np.bincount((f.astype(np.int64) * BINS >> 8).ravel(), minlength=BINS) / f.size for f in frames]).reshape(len(frames), BINS)


def cuts(hist: np.ndarray) -> np.ndarray:
    """Frames that begin a new shot."""
    if len(hist) < 2:
        return np.zeros(0, np.int64)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    n = len(diff)
    sums = np.concatenate([[0.0], np.cumsum(diff)])
    squares = np.concatenate([[0.0], np.cumsum(diff * diff)])
    low = np.maximum(np.arange(n) - WINDOW, 0)
    count = np.maximum(np.arange(n) - low, 1)
    mean = (sums[:-1] - sums[low]) / count
    spread = np.sqrt(np.maximum((squares[:-1] - squares[low]) / count - mean * mean, 0))
    return np.flatnonzero(diff > np.maximum(mean + SPREAD * spread, FLOOR)) + 1


def clip_rows(data: bytes) -> list[dict]:
    file = read_avi(data)
    return _clips(histograms(grey_frames(data, file)), file["rate"])


def _clips(hist: np.ndarray, rate: float) -> list[dict]:
    n = len(hist)
    if not n:
        return []
    marks = [0, *cuts(hist).tolist(), n]
    return [{"clip": i, "first_frame": a, "last_frame": b - 1, "start_s": a / rate, "end_s": b / rate} for i, (a, b) in enumerate(zip(marks, marks[1:], strict=False))]


def clips(media: DataFrame, key: str, column: str) -> DataFrame:
    """Timed clip rows of a media column: key, clip, first_frame, last_frame, start_s, end_s."""
    from pyspark.sql import types as T

    kept = media.select(media[key].alias("_key"), media[column].alias("_media"))
    schema = T.StructType([T.StructField(key, kept.schema[0].dataType), *T._parse_datatype_string("clip int, first_frame long, last_frame long, start_s double, end_s double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [] if not batch.column(1)[i].is_valid else clip_rows(batch.column(1)[i].as_py())
                columns = [[r[c] for r in rows] for c in ("clip", "first_frame", "last_frame", "start_s", "end_s")]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, _CLIP, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), batch.schema.field(0).type), *arrays], names=[key, *[f.name for f in _CLIP]])

    return kept.mapInArrow(tidy(run), schema)


_CLIP = [pa.field("clip", pa.int32()), pa.field("first_frame", pa.int64()), pa.field("last_frame", pa.int64()), pa.field("start_s", pa.float64()), pa.field("end_s", pa.float64())]


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (max(-(-len(text) // UNIT), 1) * UNIT - len(text))


def store(payload: bytes) -> bytes:
    """An AVI file of sample frames that holds the payload; the last frame is filled with zeros."""
    n = -(-len(payload) // jpeg.SAMPLES)
    samples = np.zeros(n * jpeg.SAMPLES, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    return write_avi(jpeg.encode_samples(samples.reshape(n, -1)), 8 * jpeg.ACROSS, 8 * jpeg.DOWN, note=f"{_NOTE}{len(payload)}")


def media_row(text: bytes) -> tuple:
    """Digest columns of one text: stored as a file, whose bytes alone give the rest."""
    media = store(payload_of(text))
    file = read_avi(media)
    general = zlib.crc32(media) % GENERAL == 0
    if general:  # pixels of any JPEG decoder: each sample is a flat block
        pixels = grey_frames(media, file, plain=True)
        hist = histograms(pixels)
        frames = np.stack([p[::8, ::8].ravel() for p in pixels])
    else:
        frames = grey_frames(media, file)
        hist = histograms(frames)
    back = np.ascontiguousarray(frames).tobytes()[: int(file["note"].removeprefix(_NOTE))]
    shots = _clips(hist, file["rate"])
    feature = f"frames={len(frames)};rate={file['rate']:g};size={file['width']}x{file['height']};decoder={'general' if general else 'table'};clips={len(shots)}"
    timed = ";".join(f"{s['first_frame']}-{s['last_frame']}@{s['start_s']:g}-{s['end_s']:g}" for s in shots)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, timed


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and clips (frames@seconds) of each text.

    One file in ``GENERAL``, chosen by its bytes, is read back by the general decoder, the others by the table of sample frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = [media_row((t or "").encode()) for t in piece.column("text").to_pylist()]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEDIA, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=["doc_id", *[f.name for f in _MEDIA]])

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string")


_MEDIA = [pa.field(n, pa.string() if n.endswith("sha256") or n in ("feature", "clips") else pa.int64()) for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")]
