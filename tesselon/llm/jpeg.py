"""Baseline JPEG: a general decoder, and a lossless sample codec within baseline.

The sample codec stores one 8-bit sample as one flat 8x8 block.  With a DC quantiser of 8 a flat
block's only coefficient is sample - 128, so any baseline decoder returns the samples exactly.
The Huffman table gives DC category s a code of 15 - s bits; with the category's s further bits and
a one-bit end of block, each sample takes 16 bits, none of whose bytes is 0xFF.  Coding and
decoding are therefore table look-ups over whole arrays.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Blocks across and down a frame of the sample codec.
ACROSS, DOWN = 32, 32
SAMPLES = ACROSS * DOWN

# Fixed values of the JPEG standard (Annex K): code counts by length, then symbols.
STD_DC_LUMA = "00010501010101010100000000000000", "000102030405060708090a0b"
STD_DC_CHROMA = "00030101010101010101010000000000", "000102030405060708090a0b"
STD_AC_LUMA = (
    "0002010303020403050504040000017d",
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
)
STD_AC_CHROMA = (
    "00020102040403040705040400010277",
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
)


def zigzag() -> np.ndarray:
    """Row-major index of each coefficient in scan order: diagonals in turn, direction alternating."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
_BASIS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((length, code, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: length * 256 + symbol, 0 if no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for length, code, symbol in _codes(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbol
    return table


@lru_cache(1)
def _standard() -> dict[tuple[int, int], np.ndarray]:
    named = {(0, 0): STD_DC_LUMA, (0, 1): STD_DC_CHROMA, (1, 0): STD_AC_LUMA, (1, 1): STD_AC_CHROMA}
    return {k: _lookup(bytes.fromhex(a), bytes.fromhex(b)) for k, (a, b) in named.items()}


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) or (height, width, components) of a baseline JPEG, as stored (YCbCr isn't converted)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    quant: dict[int, np.ndarray] = {}
    tables = dict(_standard())
    parts, at, interval, height, width = [], 2, 0, 0, 0
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit samples are supported")
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline coding is supported")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            for i in range(body[0]):
                for p in parts:
                    if p["id"] == body[1 + 2 * i]:
                        p["dc"], p["ac"] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            break
    return _scan(data, at, parts, quant, tables, interval, height, width)


def _scan(data, at, parts, quant, tables, interval, height, width) -> np.ndarray:
    hmax, vmax = max(p["h"] for p in parts), max(p["v"] for p in parts)
    if len(parts) == 1:
        parts[0]["h"] = parts[0]["v"] = hmax = vmax = 1
    mcus_x, mcus_y = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    for p in parts:
        p["out"] = np.zeros((mcus_y * p["v"], mcus_x * p["h"], 64), np.int64)
    bits, have = 0, 0

    def need(n: int) -> None:
        nonlocal bits, have, at
        while have < n:
            byte = data[at] if at < len(data) else 0
            if byte == 0xFF and at + 1 < len(data):
                if data[at + 1] == 0:
                    at += 2
                else:
                    byte = 0  # a marker: zeros are read from here on
            else:
                at += 1
            bits, have = (bits << 8 | byte) & 0xFFFFFFFFFF, have + 8

    def symbol(table: np.ndarray) -> int:
        nonlocal have
        need(16)
        found = int(table[bits >> (have - 16) & 0xFFFF])
        if not found:
            raise ValueError("damaged JPEG data")
        have -= found >> 8
        return found & 255

    def extra(n: int) -> int:
        nonlocal have
        if not n:
            return 0
        need(n)
        have -= n
        value = bits >> have & ((1 << n) - 1)
        return value if value >> (n - 1) else value - (1 << n) + 1

    last = [0] * len(parts)
    for mcu in range(mcus_x * mcus_y):
        if interval and mcu and mcu % interval == 0:
            bits = have = 0
            while not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at += 2
            last = [0] * len(parts)
        y, x = divmod(mcu, mcus_x)
        for i, p in enumerate(parts):
            for v in range(p["v"]):
                for h in range(p["h"]):
                    block = p["out"][y * p["v"] + v, x * p["h"] + h]
                    last[i] += extra(symbol(tables[0, p["dc"]]))
                    block[0] = last[i]
                    k = 1
                    while k < 64:
                        run, n = divmod(symbol(tables[1, p["ac"]]), 16)
                        if not n:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        block[k] = extra(n)
                        k += 1
    planes = []
    for p in parts:
        rows, columns = p["out"].shape[:2]
        grid = np.zeros((rows, columns, 64))
        grid[..., ZIGZAG] = p["out"] * quant[p["q"]]
        pixels = np.einsum("ux,rcuv,vy->rcxy", _BASIS, grid.reshape(rows, columns, 8, 8), _BASIS)
        plane = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        plane = plane.repeat(vmax // p["v"], 0).repeat(hmax // p["h"], 1)
        planes.append(plane[:height, :width])
    return planes[0] if len(planes) == 1 else np.stack(planes, -1)


@lru_cache(1)
def _sample_tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """Header of a sample frame; 16-bit word by difference + 255; difference by word (1000: none)."""
    counts = bytes(1 if 7 <= length <= 15 else 0 for length in range(1, 17))
    symbols = bytes(range(8, -1, -1))
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    header = (
        b"\xff\xd8"
        + part(0xDB, b"\x00" + bytes([8] + [1] * 63))
        + part(0xC0, struct.pack(">BHHB", 8, 8 * DOWN, 8 * ACROSS, 1) + bytes([1, 0x11, 0]))
        + part(0xC4, b"\x00" + counts + symbols)
        + part(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
        + part(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )
    words = np.zeros(511, np.uint16)
    back = np.full(1 << 16, 1000, np.int16)
    by_category = {s: (length, code) for length, code, s in _codes(counts, symbols)}
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        code = by_category[s][1]
        value = diff if diff >= 0 else diff + (1 << s) - 1
        words[diff + 255] = (code << s | value) << 1
        back[words[diff + 255]] = diff
    return header, words, back


def frame_bytes() -> int:
    return len(_sample_tables()[0]) + 2 * SAMPLES + 2


def encode_samples(samples: np.ndarray) -> np.ndarray:
    """JPEG frames (one a row) of samples (one frame a row)."""
    header, words, _ = _sample_tables()
    out = np.empty((len(samples), frame_bytes()), np.uint8)
    out[:, : len(header)] = np.frombuffer(header, np.uint8)
    level = samples.astype(np.int16) - 128
    level[:, 1:] -= level[:, :-1].copy()
    out[:, len(header) : -2] = words[level + 255].astype(">u2").view(np.uint8).reshape(len(samples), -1)
    out[:, -2:] = (0xFF, 0xD9)
    return out


def decode_samples(frames: np.ndarray) -> np.ndarray | None:
    """Samples of frames that ``encode_samples`` made; None if any is another kind of JPEG."""
    header, _, back = _sample_tables()
    if frames.shape[1] != frame_bytes() or not (frames[:, : len(header)] == np.frombuffer(header, np.uint8)).all():
        return None
    diffs = back[np.ascontiguousarray(frames[:, len(header) : -2]).view(">u2")]
    if (diffs == 1000).any():
        return None
    return (np.cumsum(diffs, 1, dtype=np.int32) + 128).astype(np.uint8)
