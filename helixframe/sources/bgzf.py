"""Block gzip: gzip members of at most 64 KiB that carry their own size."""

from __future__ import annotations

import struct
import zlib

#: Fixed value: the empty member that ends a file.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00


def block(data: bytes, level: int = 6) -> bytes:
    """One member for at most BLOCK bytes."""
    for use in (level, 0):
        packer = zlib.compressobj(use, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        if len(body) + 26 <= 0x10000:
            break
    header = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return header + body + struct.pack("<2I", zlib.crc32(data), len(data))


def compress(data: bytes) -> bytes:
    """All members of ``data``, without the one that ends a file."""
    return b"".join(block(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK))


def decompress(raw: bytes) -> bytes:
    """The data of all members, those of plain gzip too."""
    out = []
    while raw:
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw) + d.flush())
        raw = d.unused_data
    return b"".join(out)


def starts(raw: bytes, at: int) -> int:
    """The first place from ``at`` on where a member starts that carries its own size and inflates; -1 without one."""
    while (at := raw.find(b"\x1f\x8b\x08\x04", at)) >= 0:
        if (n := member_size(raw, at)) and at + n <= len(raw):
            try:
                zlib.decompress(raw[at : at + n], 31)
                return at
            except zlib.error:
                pass
        at += 1
    return -1


def member_size(raw: bytes, at: int) -> int:
    """Bytes of the member at ``at``, 0 if it does not carry them."""
    if raw[at : at + 4] != b"\x1f\x8b\x08\x04" or raw[at + 12 : at + 16] != b"BC\x02\x00" or len(raw) < at + 18:
        return 0
    return struct.unpack_from("<H", raw, at + 16)[0] + 1


def lines_of_range(file, size: int, begin: int, end: int) -> list[bytes]:
    """The lines of a block gzip file that start in members from ``begin`` up to ``end``.

    Text is cut at the first line end after each bound, so ranges that meet give each line once.
    """
    most = 0x10000
    raw = file.read_at(min(end + most, size) - begin, begin)
    at = starts(raw, 0) if begin else 0
    text, n = [], 0
    while 0 <= at < end - begin and (n := member_size(raw, at)):
        text.append(zlib.decompress(raw[at : at + n], 31))
        at += n
    if not text:
        return []
    data = b"".join(text)
    place = begin + at
    while place < size:  # the rest of the last line
        head = file.read_at(min(most, size - place), place)
        n = member_size(head, 0)
        more = zlib.decompress(head[:n], 31) if n else b""
        cut = more.find(b"\n")
        data += more if cut < 0 else more[: cut + 1]
        if cut >= 0 or not n:
            break
        place += n
    if begin:  # it belongs to the range before
        data = data[data.find(b"\n") + 1 :] if b"\n" in data else b""
    return data.splitlines()
