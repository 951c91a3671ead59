"""Pixels of sequential JPEG images with Huffman codes, 8 bits, one or three components.

The bits are read in Python, everything after (scaling, inverse cosine transform,
colours) is numpy over all blocks.  Chroma is widened by repetition.  Progressive and
arithmetic-coded images, and those of four components, are errors.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np

#: Places of a block's coefficients in the order of the file: along the diagonals, turning at their ends.
_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_SCAN_END = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])")


@dataclass
class _Component:
    across: int
    down: int
    quantizer: int
    #: Blocks of its plane, with those that fill up the last units.
    wide: int = 0
    high: int = 0
    coefficients: array = field(default_factory=lambda: array("h"))


def _codes(lengths: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits that may come next: length of the code << 8 | symbol; 0 for none."""
    table, code, at = [0] * 65536, 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            first = code << (16 - n)
            table[first : first + (1 << (16 - n))] = [n << 8 | symbols[at]] * (1 << (16 - n))
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Bits:
    """Bits of one run of a scan, without its stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.at += 8
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(part.ljust(8, b"\0"), "big")
        self.n += 64

    def symbol(self, table: list[int]) -> int:
        if self.n < 32:
            self.fill()
        entry = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not entry:
            raise ValueError("bad code")
        self.n -= entry >> 8
        return entry & 255

    def number(self, size: int) -> int:
        """A signed number of so many bits: those that begin with 0 are negative."""
        if not size:
            return 0
        self.n -= size
        value = (self.held >> self.n) & ((1 << size) - 1)
        return value if value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, dc: list[int], ac: list[int], before: int, out: array, at: int) -> int:
    before += bits.number(bits.symbol(dc))
    out[at] = before
    k = 1
    while k < 64:
        code = bits.symbol(ac)
        run, size = code >> 4, code & 15
        if size:
            k += run
            out[at + _ZIGZAG[k]] = bits.number(size)
            k += 1
        elif run == 15:
            k += 16
        else:
            break
    return before


def _scan(data: bytes, parts: list[tuple[_Component, list[int], list[int]]], width: int, height: int, most: tuple[int, int], every: int) -> None:
    alone = len(parts) == 1
    if alone:
        c = parts[0][0]
        across, down = -(-(-(-width * c.across // most[0])) // 8), -(-(-(-height * c.down // most[1])) // 8)
    else:
        across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    runs, unit, units = _RESTART.split(data), 0, across * down
    for run in runs:
        bits, before = _Bits(run), [0] * len(parts)
        end = min(units, unit + every) if every else units
        for u in range(unit, end):
            y, x = divmod(u, across)
            for i, (c, dc, ac) in enumerate(parts):
                for v in range(1 if alone else c.down):
                    for h in range(1 if alone else c.across):
                        row, col = (y, x) if alone else (y * c.down + v, x * c.across + h)
                        before[i] = _block(bits, dc, ac, before[i], c.coefficients, 64 * (row * c.wide + col))
            if bits.at > len(bits.data) + 16:
                raise ValueError("the image data ends early")
        unit = end
    if unit < units:
        raise ValueError("the image data ends early")


def _plane(c: _Component, table: np.ndarray) -> np.ndarray:
    blocks = np.frombuffer(c.coefficients, np.int16).reshape(-1, 8, 8) * table
    pixels = _COSINES.T @ blocks @ _COSINES + 128
    return pixels.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide)


def decode_jpeg(data: bytes) -> np.ndarray:
    """Pixels [y, x, channel], in blue, green, red order or of one channel."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quantizers, codes, components, every, rgb, scanned = 2, {}, {}, {}, 0, False, False
    width = height = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        part = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while part:
                wide = 2 if part[0] >> 4 else 1
                table = np.zeros(64)
                table[_ZIGZAG] = np.frombuffer(part[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                quantizers[part[0] & 15], part = table.reshape(8, 8), part[1 + 64 * wide :]
        elif kind == 0xC4:
            while part:
                n = sum(part[1:17])
                codes[part[0]], part = _codes(part[1:17], part[17 : 17 + n]), part[17 + n :]
        elif kind in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", part[:6])
            if depth != 8 or n not in (1, 3) or not width or not height:
                raise ValueError("unsupported JPEG")
            components = {part[6 + 3 * k]: _Component(part[7 + 3 * k] >> 4, part[7 + 3 * k] & 15, part[8 + 3 * k]) for k in range(n)}
            most = tuple(max(getattr(c, d) for c in components.values()) for d in ("across", "down"))
            for c in components.values():
                c.wide, c.high = -(-width // (8 * most[0])) * c.across, -(-height // (8 * most[1])) * c.down
                c.coefficients = array("h", bytes(128 * c.wide * c.high))
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("unsupported JPEG")
        elif kind == 0xDD:
            (every,) = struct.unpack(">H", part[:2])
        elif kind == 0xEE and part[:5] == b"Adobe":
            rgb = part[11] == 0
        elif kind == 0xDA:
            if not components:
                raise ValueError("no header")
            end = _SCAN_END.search(data, at)
            stop = end.start() if end else len(data)
            chosen = [(components[part[1 + 2 * k]], codes[part[2 + 2 * k] >> 4], codes[16 | part[2 + 2 * k] & 15]) for k in range(part[0])]
            _scan(data[at:stop], chosen, width, height, most, every)
            at, scanned = stop, True
    if not scanned:
        raise ValueError("no image data")
    planes = []
    for c in components.values():
        p = _plane(c, quantizers[c.quantizer])
        planes.append(np.repeat(np.repeat(p, most[1] // c.down, axis=0), most[0] // c.across, axis=1)[:height, :width])
    if len(planes) == 1:
        out = planes[0][:, :, None]
    elif rgb:
        out = np.stack(planes[::-1], axis=2)
    else:
        y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
        out = np.stack([y + 1.772 * blue, y - 0.344136 * blue - 0.714136 * red, y + 1.402 * red], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
