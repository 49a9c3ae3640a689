"""The self-describing header and the bitmap image that carry a payload."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import xxhash

from octetflow.functions.chacha import batch_cipher
from octetflow.functions.digests import key_bytes

# Types of fields, first bytes and version of a header, and its layouts.
UINT8, UINT16, UINT32, UINT64, STRING, BOOL, FLOAT, DOUBLE = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 0x30, 0x40
MAGIC, FORMAT = 0x41494F48, 1
_HEAD, _ENTRY = "<IHII", "<BIIH"


class HeaderWriter:
    """Named, typed fields, packed bit by bit from the lowest bit on, whole numbers at the least width that holds them."""

    def __init__(self):
        self.entries: list[tuple[int, int, int, bytes]] = []
        self.value, self.bits = 0, 0

    def _add(self, name: str, kind: int, width: int, value: int) -> HeaderWriter:
        self.entries.append((kind, width, self.bits, name.encode()))
        self.value |= value << self.bits
        self.bits += width
        return self

    def uint(self, name: str, value: int, kind: int = UINT64, width: int = 0) -> HeaderWriter:
        """``width`` is raised to what the value needs."""
        if not 0 <= value < 2**64:
            raise ValueError(f"{name}: not an unsigned number of 64 bits")
        return self._add(name, kind, max(width, 1, value.bit_length()), value)

    def string(self, name: str, value: str | bytes) -> HeaderWriter:
        raw = value.encode() if isinstance(value, str) else value
        return self._add(name, STRING, 8 * len(raw), int.from_bytes(raw, "little"))

    def boolean(self, name: str, value: bool) -> HeaderWriter:
        return self._add(name, BOOL, 1, int(value))

    def float(self, name: str, value: float) -> HeaderWriter:
        return self._add(name, FLOAT, 32, int.from_bytes(struct.pack("<f", value), "little"))

    def double(self, name: str, value: float) -> HeaderWriter:
        return self._add(name, DOUBLE, 64, int.from_bytes(struct.pack("<d", value), "little"))

    def size(self) -> int:
        return struct.calcsize(_HEAD) + sum(struct.calcsize(_ENTRY) + len(n) for *_, n in self.entries) + -(-self.bits // 8)

    def clear(self) -> None:
        self.__init__()

    def to_bytes(self) -> bytes:
        data = self.value.to_bytes(-(-self.bits // 8), "little")
        return struct.pack(_HEAD, MAGIC, FORMAT, len(self.entries), len(data)) + b"".join(struct.pack(_ENTRY, k, w, o, len(n)) + n for k, w, o, n in self.entries) + data


class HeaderReader:
    """Fields by name; of repeated names the last counts. Getters give None for what is missing or of another type."""

    def __init__(self, raw: bytes):
        if len(raw) < struct.calcsize(_HEAD):
            raise ValueError("the header is cut short")
        magic, version, count, size = struct.unpack_from(_HEAD, raw)
        if magic != MAGIC or version != FORMAT:
            raise ValueError("there is no header here")
        self.fields: dict[str, tuple[int, int, int]] = {}
        at = struct.calcsize(_HEAD)
        for _ in range(count):
            kind, width, offset, n = struct.unpack_from(_ENTRY, raw, at)
            at += struct.calcsize(_ENTRY)
            self.fields[raw[at : at + n].decode()] = (kind, width, offset)
            at += n
        if at + size > len(raw):
            raise ValueError("the header is cut short")
        self.value, self.length = int.from_bytes(raw[at : at + size], "little"), at + size
        if any(o + w > 8 * size for _, w, o in self.fields.values()):
            raise ValueError("a field lies outside the header")

    def _bits(self, name: str, *kinds: int) -> tuple[int, int] | None:
        kind, width, offset = self.fields.get(name, (None, 0, 0))
        return (self.value >> offset & (1 << width) - 1, width) if kind in kinds else None

    def uint(self, name: str) -> int | None:
        found = self._bits(name, UINT8, UINT16, UINT32, UINT64, BOOL)
        return found and found[0]

    def boolean(self, name: str) -> bool | None:
        found = self._bits(name, BOOL)
        return found and bool(found[0])

    def string(self, name: str) -> str | None:
        found = self._bits(name, STRING)
        return found and found[0].to_bytes(found[1] // 8, "little").decode("utf-8", "replace")

    def float(self, name: str) -> float | None:
        found = self._bits(name, FLOAT)
        return found and struct.unpack("<f", found[0].to_bytes(4, "little"))[0]

    def double(self, name: str) -> float | None:
        found = self._bits(name, DOUBLE)
        return found and struct.unpack("<d", found[0].to_bytes(8, "little"))[0]

    def has(self, name: str) -> bool:
        return name in self.fields

    def names(self) -> list[str]:
        return list(self.fields)

    def as_strings(self) -> dict[str, str]:
        out = {}
        for name, (kind, *_) in self.fields.items():
            get = {STRING: self.string, BOOL: self.boolean, FLOAT: self.float, DOUBLE: self.double}.get(kind, self.uint)
            v = get(name)
            out[name] = str(v).lower() if isinstance(v, bool) else str(v)
        return out


def digest_texts(data: bytes) -> dict[str, str]:
    import hashlib

    return {"hash": f"{xxhash.xxh3_64_intdigest(data):X}", "SHA": hashlib.sha256(data).hexdigest(), "CRC": f"{zlib.crc32(data):X}"}


def side(size: int, grey: bool) -> int:
    n = size if grey else 8 * size
    root = math.isqrt(n)
    return root + (root * root < n)


def stride(width: int, grey: bool) -> int:
    return (width + 3) // 4 * 4 if grey else (width + 31) // 32 * 4


def header_for(data: bytes, name: str, encrypted: bool, compressed: bool, packed: bool, version: str = "0.6", with_hash: bool = True, sha: bool = False, crc: bool = False) -> HeaderWriter:
    texts = digest_texts(data)
    w = HeaderWriter().uint("binary_length", 8 * len(data)).string("filename", name).boolean("encrypted", encrypted).string("v", version)
    w.boolean("compress", compressed).boolean("pack", packed).string("hash", texts["hash"] if with_hash else "")
    if sha:
        w.string("SHA", texts["SHA"])
    if crc:
        w.string("CRC", texts["CRC"])
    return w


def bmp_encode(data: bytes, header: bytes = b"", key: str | bytes | None = None, grey: bool = False) -> bytes:
    """A square bitmap whose pixels are the payload, contiguous, with zeros only at the end. ``header``: empty where metadata is stored apart."""
    width = side(len(data), grey)
    pixels = stride(width, grey) * width
    table = (np.arange(256, dtype="<u4") * 0x010101).tobytes() if grey else struct.pack("<II", 0, 0xFFFFFF)
    at = 54 + len(table) + len(header)
    if at + pixels > 2**31 - 1:
        raise ValueError("the image would pass 2 GiB")
    bits, colours = (8, 256) if grey else (1, 2)
    body = batch_cipher(key_bytes(key), data) if key is not None else data
    head = struct.pack("<HIHHI", 0x4D42, at + pixels, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, width, 1, bits, 0, pixels, 0, 0, colours, colours)
    return b"".join([head, table, header, body, bytes(pixels - len(data))])


def bmp_fields(image: bytes) -> dict[str, int]:
    if len(image) < 54:
        raise ValueError("the image is cut short")
    kind, size, _, _, at = struct.unpack_from("<HIHHI", image)
    _, width, height, _, bits, _, pixels, _, _, colours, _ = struct.unpack_from("<IiiHHIIiiII", image, 14)
    if kind != 0x4D42:
        raise ValueError("this is no bitmap")
    if bits not in (1, 8):
        raise ValueError("bitmaps here have 1 or 8 bits a pixel")
    return {"file_size": size, "offset_data": at, "width": width, "height": height, "bit_count": bits, "size_image": pixels, "colors_used": colours}


def bmp_header(image: bytes) -> HeaderReader | None:
    """The header between colour table and pixels, if there is one."""
    f = bmp_fields(image)
    start = 54 + 4 * f["colors_used"]
    return HeaderReader(image[start : f["offset_data"]]) if f["offset_data"] > start else None


def bmp_decode(image: bytes, length: int | None = None, key: str | bytes | None = None) -> bytes:
    """The payload; ``length`` in bytes, from the header if None."""
    f = bmp_fields(image)
    if length is None:
        head = bmp_header(image)
        if head is None or head.uint("binary_length") is None:
            raise ValueError("the payload's length is not known")
        length = head.uint("binary_length") // 8
    data = image[f["offset_data"] : f["offset_data"] + length]
    if len(data) != length:
        raise ValueError("the image is cut short")
    return batch_cipher(key_bytes(key), data) if key is not None else data


def verify(data: bytes, stored: dict[str, str]) -> dict[str, bool | None]:
    """Each stored digest against the data (None where none is stored), and ``overall``, as stored images are accepted: True without a stored XXH3, else whether all stored ones agree."""
    texts = digest_texts(data)
    out: dict[str, bool | None] = {k: (texts[k] == stored[k] if stored.get(k) else None) for k in ("hash", "SHA", "CRC")}
    out["overall"] = True if out["hash"] is None else all(v is not False for v in out.values())
    return out
