"""Block-compressed (BGZF) files: gzip members of at most 64 KiB whose headers hold their sizes.

A place in such a file is a virtual offset, the place of a block times 65,536 plus a
place in what it inflates to.  Blocks are checked by their lengths and checksums.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

#: The start of a block's header, the empty block that ends a file, and the most that goes into a block.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 65_280


def block_size(extra: bytes) -> int:
    """Bytes of a block, from its header's extra field."""
    at = 0
    while at + 6 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    raise ValueError("not a BGZF block")


def read_block(raw) -> tuple[int, bytes, bytes] | None:
    """Size, deflated data and trailer of the block at the file's place; None at the end."""
    head = raw.read(12)
    if not head:
        return None
    if len(head) < 12 or head[:4] != MAGIC:
        raise ValueError("not a BGZF block")
    extra = raw.read(struct.unpack_from("<H", head, 10)[0])
    size = block_size(extra)
    rest = raw.read(size - 12 - len(extra))
    if len(rest) != size - 12 - len(extra):
        raise ValueError("the file ends inside a block")
    return size, rest[:-8], rest[-8:]


def inflate(data: bytes, trailer: bytes) -> bytes:
    out = zlib.decompress(data, -15)
    if (zlib.crc32(out), len(out)) != struct.unpack("<II", trailer):
        raise ValueError("a block's checksum doesn't match")
    return out


class Inflated:
    """The bytes of a BGZF file from a block on, read forward."""

    def __init__(self, raw, offset: int = 0) -> None:
        self.raw, self.next = raw, offset
        self.held, self.at = bytearray(), 0
        #: Inflated bytes before held, and (inflated place, place in the file) of the blocks that held bytes come from.
        self.before = 0
        self.blocks: list[tuple[int, int]] = []
        self.opened = 0
        raw.seek(offset)

    def _append(self, size: int, data: bytes) -> None:
        here = self.before + self.at
        while len(self.blocks) > 1 and self.blocks[1][0] <= here:
            self.blocks.pop(0)
        if data:
            self.blocks.append((self.before + len(self.held), self.next))
        self.held += data
        self.next += size
        self.opened += 1

    def more(self) -> bool:
        """Inflate one more block."""
        found = read_block(self.raw)
        if found is None:
            return False
        if self.at > 1 << 20:
            del self.held[: self.at]
            self.before, self.at = self.before + self.at, 0
        self._append(found[0], inflate(*found[1:]))
        return True

    def fill(self, n: int) -> bool:
        """Whether n bytes are at hand."""
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def read(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        """Move on by n bytes; blocks that are left out whole aren't inflated."""
        have = len(self.held) - self.at
        if n <= have:
            self.at += n
            return
        n -= have
        self.before, self.at = self.before + len(self.held), 0
        self.held.clear()
        self.blocks.clear()
        while n:
            found = read_block(self.raw)
            if found is None:
                raise ValueError("the file ends inside a record")
            length = struct.unpack_from("<I", found[2], 4)[0]
            if length <= n:
                n -= length
                self.before += length
                self.next += found[0]
            else:
                self._append(found[0], inflate(*found[1:]))
                self.at, n = n, 0

    def place(self) -> int:
        """Virtual offset of the next byte; that of the end of the file where none is left."""
        if not self.fill(1):
            return self.next << 16
        here = self.before + self.at
        start, block = next((b for b in reversed(self.blocks) if b[0] <= here))
        return block << 16 | (here - start)


def at_place(raw, voffset: int) -> Inflated:
    f = Inflated(raw, voffset >> 16)
    if f.fill((voffset & 0xFFFF) + 1):
        f.at = voffset & 0xFFFF
    return f


def first_block(raw, begin: int, end: int) -> int | None:
    """Place of the first block that starts in [begin, end): a header whose block inflates to its checksum."""
    at = begin
    while at < end:
        raw.seek(at)
        window = raw.read(1 << 17)
        k = window.find(MAGIC)
        if k < 0:
            if len(window) < 4:
                return None
            at += len(window) - 3
            continue
        at += k
        if at >= end:
            return None
        raw.seek(at)
        try:
            _, data, trailer = read_block(raw) or (0, b"", b"")
            inflate(data, trailer)
            return at
        except (ValueError, struct.error, zlib.error):
            at += 1
    return None


def blocks(data: bytes, level: int = 6) -> Iterator[bytes]:
    """data in blocks, without the one that ends a file."""
    for k in range(0, len(data), MOST):
        part = data[k : k + MOST]
        deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        if len(body) + 26 > 65_536:
            deflate = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = deflate.compress(part) + deflate.flush()
        yield MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
