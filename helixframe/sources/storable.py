"""Reader of serialised Perl data (the Storable format, major version 2).

Hashes become ``Record`` (a dict that knows its class), arrays lists, references what they refer
to, undef None, strings str where they are UTF-8 and bytes otherwise. Objects that occur
several times are one object here as well. Code, hooks and tied variables raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Callable


class Record(dict):
    """A hash; ``kind`` is its class, None for a plain one."""

    kind: str | None = None


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0
        self.seen: list = []
        self.classes: list[str] = []
        if raw[:4] == b"pst0":
            self.at = 4
        first = self._byte()
        if first >> 1 != 2:
            raise ValueError(f"Storable data of major version {first >> 1}")
        minor = self._byte()
        self.order = ">" if first & 1 else "<"
        self.long = 8
        if not first & 1:
            order = self._take(self._byte())
            sizes = self._take(3 + (minor >= 2))
            self.order = "<" if order.startswith(b"1234") else ">"
            self.long = len(order)
            if sizes[0] != 4:
                raise ValueError("Storable data with ints of other than 4 bytes")

    def _take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("Storable data end early")
        self.at += n
        return out

    def _byte(self) -> int:
        return self._take(1)[0]

    def _size(self) -> int:
        return struct.unpack(f"{self.order}I", self._take(4))[0]

    def _keep(self, x):
        self.seen.append(x)
        return x

    def _text(self, raw: bytes):
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw

    def value(self):
        code = self._byte()
        read = _READ.get(code)
        if read is None:
            raise ValueError(f"Storable data of kind {code} at byte {self.at - 1}")
        return read(self)

    def shared(self):
        (k,) = struct.unpack(">I", self._take(4))
        return self.seen[k]

    def array(self) -> list:
        out = self._keep([])
        for _ in range(self._size()):
            out.append(self.value())
        return out

    def hash(self, flags: bool = False) -> Record:
        if flags:
            self._byte()
        out = self._keep(Record())
        for _ in range(self._size()):
            v = self.value()
            if flags:
                self._byte()
            out[self._text(self._take(self._size()))] = v
        return out

    def reference(self):
        k = len(self.seen)
        self.seen.append(None)
        self.seen[k] = out = self.value()
        return out

    def blessed(self, known: bool):
        n = self._byte()
        n = self._size() if n & 0x80 else n
        if not known:
            self.classes.append(self._take(n).decode())
        kind = self.classes[n if known else -1]
        out = self.value()
        if isinstance(out, Record):
            out.kind = kind
        return out


def _string(long: bool) -> Callable:
    return lambda r: r._keep(r._text(r._take(r._size() if long else r._byte())))


#: The format's codes.
_READ: dict[int, Callable] = {
    0: _Reader.shared,
    1: _string(True),
    2: _Reader.array,
    3: _Reader.hash,
    4: _Reader.reference,
    5: lambda r: r._keep(None),
    6: lambda r: r._keep(struct.unpack(f"{r.order}{'q' if r.long == 8 else 'i'}", r._take(r.long))[0]),
    7: lambda r: r._keep(struct.unpack(f"{r.order}d", r._take(8))[0]),
    8: lambda r: r._keep(r._byte() - 128),
    9: lambda r: r._keep(struct.unpack(">i", r._take(4))[0]),
    10: _string(False),
    14: lambda r: r._keep(None),
    17: lambda r: r.blessed(False),
    18: lambda r: r.blessed(True),
    20: _Reader.reference,
    23: _string(False),
    24: _string(True),
    25: lambda r: r.hash(True),
    27: _Reader.reference,
    28: _Reader.reference,
    31: lambda r: r._keep(None),
    34: lambda r: r._keep(True),
    35: lambda r: r._keep(False),
}


def loads(raw: bytes):
    """The data of one serialised value."""
    return _Reader(raw).value()
