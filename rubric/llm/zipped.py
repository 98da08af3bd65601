"""Directories of ZIP files read by ranges: end record, ZIP64 records, central
directory and local headers.  No member is extracted; ``Member`` says where
its bytes are."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from ..sources.files import located

#: Signatures, layouts and lengths of the records, and the values that point to their ZIP64 forms.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_FORM = struct.Struct("<4s4H2LH")
END64_FORM = struct.Struct("<4sQ2H2L4Q")
LOCATOR64_FORM = struct.Struct("<4sLQL")
ENTRY_FORM = struct.Struct("<4s6H3L5H2L")
LOCAL_FORM = struct.Struct("<4s5H3L2H")
COMMENT = 0xFFFF
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
EXTRA64 = 1
UTF8_NAME = 0x800
STORED = 0


@dataclass
class Member:
    """``offset``: of its local header in the file; ``size``: of its bytes there."""

    name: str
    method: int
    offset: int
    size: int
    encrypted: bool

    @property
    def stored(self) -> bool:
        return self.method == STORED and not self.encrypted


def open_file(path: str):
    """A file for range reads, on any file system that pyarrow knows (``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfs:``)."""
    system, name = located(path)
    return system.open_input_file(name)


def read_at(file, offset: int, size: int) -> bytes:
    data = file.read_at(size, offset)
    if len(data) != size:
        raise ValueError(f"the file ends inside a record at {offset}")
    return data


def directory(file) -> list[Member]:
    """The members of a ZIP file, in the order of its central directory."""
    length = file.size()
    tail_at = max(0, length - END_FORM.size - COMMENT)
    tail = read_at(file, tail_at, length - tail_at)
    at = tail.rfind(END)
    while at >= 0:  # the signature may stand in the comment too: the comment of the true one ends with the file
        if at + END_FORM.size <= len(tail) and at + END_FORM.size + END_FORM.unpack_from(tail, at)[7] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP file: the end record is missing")
    _, disk, first_disk, _, entries, size, offset, _ = END_FORM.unpack_from(tail, at)
    end = tail_at + at
    full = FULL16 in (disk, first_disk, entries) or FULL32 in (size, offset)
    where = end - LOCATOR64_FORM.size
    locator = read_at(file, where, LOCATOR64_FORM.size) if where >= END64_FORM.size else b""
    if locator.startswith(LOCATOR64):  # also where the short fields would do
        # A file with something in front of the archive has all its offsets short by as much.
        for place in (LOCATOR64_FORM.unpack(locator)[2], where - END64_FORM.size):
            record = read_at(file, place, END64_FORM.size) if place <= where else b""
            if record.startswith(END64):
                _, _, _, _, disk, first_disk, _, entries, size, offset = END64_FORM.unpack(record)
                end = place
                break
        else:
            raise ValueError("the ZIP64 end record is missing")
    elif full:
        raise ValueError("the ZIP64 end record is missing")
    if disk or first_disk:
        raise ValueError("a ZIP file over several disks")
    shift = end - size - offset
    if shift < 0:
        raise ValueError("the central directory doesn't fit in front of the end record")
    return entries_of(read_at(file, offset + shift, size), entries, shift)


def entries_of(data: bytes, entries: int, shift: int) -> list[Member]:
    out, at = [], 0
    for _ in range(entries):
        if data[at:at + 4] != ENTRY or at + ENTRY_FORM.size > len(data):
            raise ValueError("the central directory is damaged")
        _, _, _, flags, method, _, _, _, size, whole, n_name, n_extra, n_comment, _, _, _, offset = ENTRY_FORM.unpack_from(data, at)
        at += ENTRY_FORM.size
        name = data[at:at + n_name].decode("utf-8" if flags & UTF8_NAME else "cp437")
        extra = data[at + n_name:at + n_name + n_extra]
        at += n_name + n_extra + n_comment
        # The ZIP64 field holds those of the three values that are full, in this order.
        wide = iter(extra64(extra))
        whole = next(wide, whole) if whole == FULL32 else whole
        size = next(wide, size) if size == FULL32 else size
        offset = next(wide, offset) if offset == FULL32 else offset
        out.append(Member(name, method, offset + shift, size, bool(flags & 1)))
    return out


def extra64(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == EXTRA64:
            n = min(n, len(extra) - at - 4) // 8
            return list(struct.unpack_from(f"<{n}Q", extra, at + 4))
        at += 4 + n
    return []


def data_offset(file, member: Member) -> int:
    """Where a member's bytes begin: behind its local header, whose name and extra fields have lengths of their own."""
    head = read_at(file, member.offset, LOCAL_FORM.size)
    if not head.startswith(LOCAL):
        raise ValueError(f"{member.name}: the local header is missing")
    *_, n_name, n_extra = LOCAL_FORM.unpack(head)
    return member.offset + LOCAL_FORM.size + n_name + n_extra
