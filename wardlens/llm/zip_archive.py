"""Stored members of ZIP and ZIP64 archives, located and range-read without extraction."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO
from zlib import crc32

# Fixed values of the format: signatures and the marks that say "see the ZIP64 field".
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_ALL16, _ALL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of the first payload byte
    size: int


def members(source: BinaryIO, size: int) -> list[Member]:
    """The stored members of an archive of ``size`` bytes; reads the directory and the members' local headers only.

    A compressed or encrypted member is an error: its records cannot be reached by offset.
    """

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        found = source.read(n)
        if len(found) != n:
            raise ValueError("the archive ends early")
        return found

    tail_at = max(0, size - 22 - _ALL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    place = tail_at + at
    if place >= 20 and (count == _ALL16 or length == _ALL32 or start == _ALL32):
        locator = read(place - 20, 20)
        if locator[:4] == _LOCATOR:
            head = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if head[:4] != _END64:
                raise ValueError("no ZIP64 end of a central directory")
            count, length, start = struct.unpack_from("<QQQ", head, 32)
    directory = read(start, length)
    found, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("a broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, names, extras, notes = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + names : at + 46 + names + extras]
        at += 46 + names + extras + notes
        cut = 0
        while cut + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, cut)
            if kind == 1:  # the fields that did not fit, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, cut + 4))
                full = wide.pop(0) if full == _ALL32 else full
                packed = wide.pop(0) if packed == _ALL32 else packed
                header = wide.pop(0) if header == _ALL32 else header
            cut += 4 + n
        if name.endswith("/"):
            continue
        if method != 0 or flags & 1 or packed != full:
            raise ValueError(f"{name} is not stored as it is")
        local = read(header, 30)
        if local[:4] != _LOCAL:
            raise ValueError("a broken local header")
        here, more = struct.unpack_from("<HH", local, 26)
        found.append(Member(name, header + 30 + here + more, full))
    return found


class Writer:
    """Writes stored members one after another to a stream that cannot seek; sizes follow each member.

    ZIP64 fields are always written for members and for the end record, so a member may pass 4 GiB.
    """

    def __init__(self, sink: BinaryIO) -> None:
        self.sink, self.at, self.entries = sink, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        """Begin a member; append() adds to it until finish()."""
        self.name, self.header, self.sum, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(_LOCAL + struct.pack(
            "<HHHHHIIIHH", 45, 0x808, 0, 0, 0x21, 0, _ALL32, _ALL32, len(self.name), len(extra)) + self.name + extra)

    def append(self, data: bytes) -> None:
        self.sum = crc32(data, self.sum)
        self.size += len(data)
        self._put(data)

    def finish(self) -> None:
        self._put(b"PK\7\x08" + struct.pack("<IQQ", self.sum, self.size, self.size))
        self.entries.append((self.name, self.sum, self.size, self.header))

    def close(self) -> None:
        start = self.at
        for name, checksum, size, header in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._put(_CENTRAL + struct.pack(
                "<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 0x21, checksum, _ALL32, _ALL32, len(name), len(extra), 0, 0,
                0, 0, _ALL32) + name + extra)
        length, end = self.at - start, self.at
        n = len(self.entries)
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
        self._put(_LOCATOR + struct.pack("<IQI", 0, end, 1))
        self._put(_END + struct.pack(
            "<HHHHIIH", 0, 0, min(n, _ALL16), min(n, _ALL16), _ALL32, _ALL32, 0))
