"""TIFF files, read block by block: classic and big ones, in strips or tiles, plain or compressed.

The directory at a file's head tells where its blocks lie, so a block is read by itself, and a file of any size is dealt
to tasks by its blocks.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

#: Fixed: sample types by bits and format; forms and sizes of tags' values by type.
KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (64, 1): "u8", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (16, 3): "f2", (32, 3): "f4", (64, 3): "f8"}
FORMS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Fixed: codes of compression.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpacked_bits(raw: bytes) -> bytes:
    """PackBits: a length of 0 to 127 before as many bytes and one, one of 129 to 255 before a byte that repeats."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpacked_lzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, that grow one code early; 256 clears, 257 ends."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, bits, held, width, last = list(single), [], 0, 0, 9, None
    for byte in raw:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(single), 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


@dataclass
class Tiff:
    """A file's first directory."""

    order: str
    tags: dict[int, tuple]

    @classmethod
    def opened(cls, f: BinaryIO) -> Tiff:
        f.seek(0)
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        big = magic == 43
        number, place, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
        f.seek(struct.unpack_from(order + place, head, 8 if big else 4)[0])
        (n,) = struct.unpack(order + number, f.read(struct.calcsize(number)))
        raw, tags = f.read(entry * n), {}
        for at in range(0, entry * n, entry):
            tag, kind, count = struct.unpack_from(order + "HH" + place, raw, at)
            if kind not in FORMS:
                continue
            size, begin = struct.calcsize(FORMS[kind]) * count, at + 4 + struct.calcsize(place)
            if size <= struct.calcsize(place):
                value = raw[begin : begin + size]
            else:
                f.seek(struct.unpack_from(order + place, raw, begin)[0])
                value = f.read(size)
            tags[tag] = struct.unpack(f"{order}{count}{FORMS[kind]}", value)
        return cls(order, tags)

    def one(self, tag: int, rest: int = 1) -> int:
        return self.tags.get(tag, (rest,))[0]

    @property
    def width(self) -> int:
        return self.tags[256][0]

    @property
    def height(self) -> int:
        return self.tags[257][0]

    @property
    def bands(self) -> int:
        return self.one(277)

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a block: a tile, or a strip."""
        return (self.tags[323][0], self.tags[322][0]) if 322 in self.tags else (min(self.height, self.one(278, self.height)), self.width)

    @property
    def grid(self) -> tuple[int, int]:
        (h, w) = self.block
        return -(-self.height // h), -(-self.width // w)

    @property
    def kind(self) -> str:
        return self.order + KINDS[self.one(258), self.one(339)]

    def nodata(self) -> float | None:
        told = bytes(self.tags.get(42113, ())).split(b"\0")[0].strip()
        try:
            return float(told) if told else None
        except ValueError:
            return None

    def epsg(self) -> int | None:
        """The code of the projected, else of the geographic reference system that the file's keys name."""
        keys = self.tags.get(34735, ())
        told = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        found = [told[k] for k in (3072, 2048) if 0 < told.get(k, 0) < 32767]
        return found[0] if found else None

    def read(self, f: BinaryIO, at: int) -> tuple[int, int, np.ndarray]:
        """A block's first row and column, and its pixels within the image: (rows, columns, bands)."""
        (h, w), (down, across) = self.block, self.grid
        r, c = at // across * h, at % across * w
        rows = h if 322 in self.tags else min(h, self.height - r)
        apart = self.one(284) == 2 and self.bands > 1
        offsets, sizes = (self.tags[324], self.tags[325]) if 322 in self.tags else (self.tags[273], self.tags.get(279))
        planes = []
        for band in range(self.bands if apart else 1):
            place, samples = at + band * down * across, 1 if apart else self.bands
            count = rows * w * samples
            kind = np.dtype(self.kind)
            f.seek(offsets[place])
            raw = self._unpacked(f.read(sizes[place] if sizes else count * kind.itemsize))
            raw = raw[: count * kind.itemsize].ljust(count * kind.itemsize, b"\0")
            planes.append(self._predicted(raw, rows, w, samples))
        data = np.concatenate(planes, 2) if apart else planes[0]
        return r, c, data[: self.height - r, : self.width - c]

    def _unpacked(self, raw: bytes) -> bytes:
        how = self.one(259)
        if how == PLAIN:
            return raw
        if how in (DEFLATE, OLD_DEFLATE):
            return zlib.decompress(raw)
        if how in (LZW, PACKBITS):
            return unpacked_lzw(raw) if how == LZW else unpacked_bits(raw)
        raise ValueError(f"compression {how} isn't read")

    def _predicted(self, raw: bytes, rows: int, columns: int, samples: int) -> np.ndarray:
        kind, how = np.dtype(self.kind), self.one(317)
        if how == 3:  # a row's bytes by their rank, most significant first, as differences
            planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, columns * kind.itemsize, samples), 1, dtype=np.uint8) if samples > 1 else np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), 1, dtype=np.uint8)
            planes = planes.reshape(rows, kind.itemsize, columns * samples).transpose(0, 2, 1)
            return np.ascontiguousarray(planes).view(">f" + str(kind.itemsize)).reshape(rows, columns, samples)
        data = np.frombuffer(raw, kind).reshape(rows, columns, samples)
        return np.cumsum(data, 1, dtype=kind.newbyteorder("=")) if how == 2 else data
