"""R's serialised objects, as far as a text in them is concerned: the XDR form, plain or compressed with gzip.

Read: the first string of a character vector, or of a list (a data frame too) whose first element holds one.
Written: a character vector of one string.
"""

from __future__ import annotations

import gzip
import struct

# Fixed values of the format: types of items, flag bits, and the versions that name an encoding.
NULL, SYMBOL, PAIRS, CHARS, LOGICAL, INTEGER, REAL, STRINGS, LIST = 254, 1, 2, 9, 10, 13, 14, 16, 19
REFERENCE, HAS_ATTRIBUTES, HAS_TAG, LATIN1, UTF8 = 255, 1 << 9, 1 << 10, 1 << 14, 1 << 15


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("the serialised object ends too early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def int(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def header(self) -> None:
        if self.take(2) != b"X\n":
            raise ValueError("not a serialised object in XDR form")
        version = self.int()
        self.take(8)
        if version == 3:
            self.take(self.int())
        elif version != 2:
            raise ValueError(f"unknown version {version} of the format")

    def item(self):
        flags = self.int()
        kind = flags & 0xFF
        if kind == NULL or kind == REFERENCE:
            return None
        if kind == CHARS:
            n = self.int()
            return None if n < 0 else self.take(n).decode("latin-1" if flags & LATIN1 else "utf-8")
        if kind == SYMBOL:
            return self.item()
        if kind == PAIRS:
            if flags & HAS_ATTRIBUTES:
                self.item()
            if flags & HAS_TAG:
                self.item()
            self.item()
            return self.item()
        if kind in (LOGICAL, INTEGER, REAL):
            self.take(self.int() * (8 if kind == REAL else 4))
            out = None
        elif kind in (STRINGS, LIST):
            out = [self.item() for _ in range(self.int())]
        else:
            raise ValueError(f"items of type {kind} are not read")
        if flags & HAS_ATTRIBUTES:
            self.item()
        return out


def text_of(raw: bytes) -> str:
    r = _Reader(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
    r.header()
    found = r.item()
    while isinstance(found, list) and found:
        found = found[0]
    if not isinstance(found, str):
        raise ValueError("the serialised object holds no text")
    return found


def of_text(text: str) -> bytes:
    data = text.encode()
    head = b"X\n" + struct.pack(">iii", 2, 0x00030500, 0x00020300)
    return gzip.compress(head + struct.pack(">iiii", STRINGS, 1, CHARS | UTF8, len(data)) + data, mtime=0)
