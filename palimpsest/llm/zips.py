"""ZIP archives of stored members: a writer, and a reader that fetches byte ranges only.

The reader finds members through the end records and the central directory, with their ZIP64 forms, and
gives ranges of stored members without extracting them.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

#: Signatures and layouts of the format's records, less their signatures.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORM, CENTRAL_FORM, END_FORM, END64_FORM, LOCATOR64_FORM = "<5H3I2H", "<6H3I5H2I", "<4H2IH", "<Q2H2I4Q", "<IQI"
ZIP64_EXTRA, MOST16, MOST32, UTF8, DOS_DATE = 1, 0xFFFF, 0xFFFFFFFF, 0x800, 0x21
MAX_COMMENT = 65_535


class FormatError(ValueError):
    """The bytes are not an archive this reader can read."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


class Writer:
    """Writes stored members to ``out`` (anything with write); ``zip64``: use the large forms even if not needed."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        large = self.zip64 or size >= MOST32
        extra = struct.pack("<2H2Q", ZIP64_EXTRA, 16, size, size) if large else b""
        shown = MOST32 if large else size
        self.members.append((raw, crc, size, self.at))
        self._put(LOCAL + struct.pack(LOCAL_FORM, 45 if large else 20, UTF8, 0, 0, DOS_DATE, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        self._put(data)

    def close(self, comment: bytes = b"") -> None:
        start = self.at
        for raw, crc, size, header in self.members:
            large = self.zip64 or max(size, header) >= MOST32
            extra = struct.pack("<2H3Q", ZIP64_EXTRA, 24, size, size, header) if large else b""
            shown, place = (MOST32, MOST32) if large else (size, header)
            need = 45 if large else 20
            self._put(CENTRAL + struct.pack(CENTRAL_FORM, need, need, UTF8, 0, 0, DOS_DATE, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or n >= MOST16 or max(size, start) >= MOST32:
            end64 = self.at
            self._put(END64 + struct.pack(END64_FORM, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(LOCATOR64 + struct.pack(LOCATOR64_FORM, 0, end64, 1))
            n, size, start = MOST16, MOST32, MOST32
        self._put(END + struct.pack(END_FORM, 0, 0, n, n, size, start, len(comment)) + comment)


class Reader:
    """``file``: seekable, with read; ``size``: its length. Reads the directory at once, members when asked."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        n, length, start = self._end()
        self.members = self._directory(n, self.read(start, length))

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise FormatError(f"range {at}+{n} is outside of {self.size} bytes")
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise FormatError(f"{len(data)} of {n} bytes at {at}")
        return data

    def _end(self) -> tuple[int, int, int]:
        fixed = len(END) + struct.calcsize(END_FORM)
        if self.size < fixed:
            raise FormatError("too short for an archive")
        tail = self.read(base := max(0, self.size - fixed - MAX_COMMENT), self.size - base)
        at = len(tail) - fixed
        while (at := tail.rfind(END, 0, at + len(END))) >= 0:
            _, _, _, n, length, start, comment = struct.unpack_from(END_FORM, tail, at + len(END))
            if at + fixed + comment == len(tail):  # else the signature stands within the comment
                break
            at -= 1
        if at < 0:
            raise FormatError("no end record")
        place = base + at
        if MOST16 == n or MOST32 in (length, start):
            step = len(LOCATOR64) + struct.calcsize(LOCATOR64_FORM)
            locator = self.read(place - step, step) if place >= step else b""
            if locator.startswith(LOCATOR64):
                _, end64, _ = struct.unpack_from(LOCATOR64_FORM, locator, len(LOCATOR64))
                record = self.read(end64, len(END64) + struct.calcsize(END64_FORM))
                if not record.startswith(END64):
                    raise FormatError("no ZIP64 end record where its locator points")
                n, length, start = struct.unpack_from(END64_FORM, record, len(END64))[-3:]
            elif MOST32 in (length, start):
                raise FormatError("no ZIP64 locator")
        return n, length, start

    def _directory(self, n: int, data: bytes) -> dict[str, Member]:
        out, at, fixed = {}, 0, len(CENTRAL) + struct.calcsize(CENTRAL_FORM)
        for _ in range(n):
            if data[at : at + len(CENTRAL)] != CENTRAL:
                raise FormatError(f"no directory entry at {at}")
            _, _, flags, method, _, _, crc, packed, size, names, extras, comments, _, _, _, header = struct.unpack_from(CENTRAL_FORM, data, at + len(CENTRAL))
            raw, extra = data[at + fixed : at + fixed + names], data[at + fixed + names : at + fixed + names + extras]
            size, packed, header = self._wide(extra, size, packed, header)
            name = raw.decode("utf-8" if flags & UTF8 else "cp437")
            out[name] = Member(name, method, crc, packed, size, header)
            at += fixed + names + extras + comments
        return out

    @staticmethod
    def _wide(extra: bytes, *narrow: int) -> list[int]:
        """Values that are all ones stand in the ZIP64 extra field, in order."""
        values, at = list(narrow), 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, at)
            if kind == ZIP64_EXTRA:
                field = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                values = [next(field, v) if v == MOST32 else v for v in values]
            at += 4 + n
        return values

    def start_of(self, member: Member) -> int:
        """Where a member's data begin, which only its local header tells."""
        if member.method:
            raise FormatError(f"{member.name} is compressed; only stored members have ranges")
        fixed = len(LOCAL) + struct.calcsize(LOCAL_FORM)
        head = self.read(member.header, fixed)
        if not head.startswith(LOCAL):
            raise FormatError(f"no local header for {member.name}")
        names, extras = struct.unpack_from(LOCAL_FORM, head, len(LOCAL))[-2:]
        return member.header + fixed + names + extras

    def range_of(self, member: Member, start: int, at: int, n: int) -> bytes:
        """``n`` bytes at ``at`` of a member whose data begin at ``start``."""
        if at < 0 or at + n > member.size:
            raise FormatError(f"range {at}+{n} is outside of {member.name}")
        return self.read(start + at, n)

    def whole(self, member: Member) -> bytes:
        data = self.range_of(member, self.start_of(member), 0, member.size)
        if zlib.crc32(data) != member.crc:
            raise FormatError(f"checksum of {member.name}")
        return data
