"""Lines of compressed text files by byte ranges: a file of several members is decoded by several tasks.

gzip members, bz2 and xz streams, zstd and lz4 frames stand one behind the other in a file and each can be decoded by
itself. A range owns the members that begin in it. It finds the first by its first bytes, and what only looks like a
beginning is ruled out by decoding it. As with plain text, a range that is not the first drops what stands before its
first line end, and every range reads on beyond its end up to the next line end. A file of one member is one task, which
holds a chunk and a line of it at a time, not the file.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Iterator

import pyarrow as pa

# First bytes of the compressed forms.
MAGIC = {"gzip": b"\x1f\x8b", "bz2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd", "lz4": b"\x04\x22\x4d\x18"}
SKIPPED = range(0x184D2A50, 0x184D2A60)  # frames of zstd and lz4 that hold no text
COLUMNAR = (b"PAR1", b"ARROW1")

CHUNK = 1 << 20
#: Decoded bytes that show that a beginning is one.
TRIAL = 1 << 16

ERRORS = (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError)


def kind_of(head: bytes) -> str | None:
    """The compressed form by the first bytes, None for plain text. Columnar files are refused."""
    if head.startswith(COLUMNAR):
        raise ValueError("columnar files are not text")
    return next((k for k, magic in MAGIC.items() if head.startswith(magic)), None)


def _decoder(kind: str):
    if kind == "gzip":
        return zlib.decompressobj(31)
    if kind == "bz2":
        return bz2.BZ2Decompressor()
    if kind == "xz":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


def _lz4_frame(source, at: int) -> tuple[bytes, int]:
    """The frame at `at` and where it ends, by its block lengths."""
    source.seek(at)
    head = source.read(7)
    if len(head) < 7 or head[:4] != MAGIC["lz4"] or head[4] >> 6 != 1:
        raise ValueError("no lz4 frame")
    flags = head[4]
    end = at + 7 + 8 * bool(flags & 8) + 4 * bool(flags & 1)
    while True:
        source.seek(end)
        word = source.read(4)
        if len(word) < 4:
            raise EOFError("the frame is cut")
        size = int.from_bytes(word, "little") & 0x7FFFFFFF
        end += 4
        if not size:
            break
        end += size + 4 * bool(flags & 16)
    end += 4 * bool(flags & 4)
    source.seek(at)
    return source.read(end - at), end


def _member(source, at: int, kind: str, ends: list[int]) -> Iterator[bytes]:
    """Decoded chunks of the member at `at`; where it ends goes to `ends`."""
    if kind == "lz4":
        frame, end = _lz4_frame(source, at)
        stream = pa.CompressedInputStream(pa.BufferReader(frame), "lz4")
        while chunk := stream.read(CHUNK):
            yield chunk
        ends.append(end)
        return
    source.seek(at)
    decoder, read = _decoder(kind), 0
    while not decoder.eof:
        data = source.read(CHUNK)
        if not data:
            raise EOFError("the member is cut")
        read += len(data)
        yield decoder.decompress(data)
    ends.append(at + read - len(decoder.unused_data))


def _skipped(source, at: int, size: int) -> int:
    """The place behind frames without text and zeros that pad a file."""
    while at < size:
        source.seek(at)
        head = source.read(8)
        if len(head) == 8 and int.from_bytes(head[:4], "little") in SKIPPED:
            at += 8 + int.from_bytes(head[4:], "little")
        elif head[:4] == b"\0\0\0\0":
            at += 4
        else:
            break
    return at


def _begins(source, at: int, size: int, kind: str) -> bool:
    """Whether a member begins here: it decodes, and if it is short another member or the end of the file follows."""
    decoded, ends = 0, []
    try:
        for chunk in _member(source, at, kind, ends):
            decoded += len(chunk)
            if decoded >= TRIAL:
                return True
        after = _skipped(source, ends[0], size)
        source.seek(after)
        return after >= size or source.read(8).startswith(MAGIC[kind])
    except ERRORS:
        return False
    except Exception as error:  # zstandard's error type
        if type(error).__name__ == "ZstdError":
            return False
        raise


def first_member(source, start: int, stop: int, size: int, kind: str) -> int | None:
    """Where the first member begins in start..stop."""
    magic, at = MAGIC[kind], start
    while at < stop:
        source.seek(at)
        window = source.read(min(CHUNK, stop - at) + len(magic) - 1)
        found = window.find(magic)
        while found >= 0 and at + found < stop:
            if _begins(source, at + found, size, kind):
                return at + found
            found = window.find(magic, found + 1)
        at += CHUNK
    return None


def _decoded(source, at: int, stop: int, size: int, kind: str | None) -> Iterator[tuple[bool, bytes]]:
    """(whether the range owns it, text) from place `at` on, to the end of the file unless the caller has enough."""
    if kind is None:
        while at < size:
            source.seek(at)
            data = source.read(min(CHUNK, stop - at) if at < stop else CHUNK)
            if not data:
                return
            yield at < stop, data
            at += len(data)
        return
    at = _skipped(source, at, size)
    while at < size:
        ends: list[int] = []
        for chunk in _member(source, at, kind, ends):
            yield at < stop, chunk
        at = _skipped(source, ends[0], size)


def lines(source, size: int, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
    """The lines, without their ends, of the range start..stop (the whole file without them)."""
    stop = size if stop is None else stop
    source.seek(0)
    kind = kind_of(source.read(6))
    at = start if kind is None or not start else first_member(source, start, stop, size, kind)
    if at is None:
        return
    skip, held = start > 0, []
    for own, chunk in _decoded(source, at, stop, size, kind):
        if skip:
            if not own:
                return
            first = chunk.find(b"\n")
            if first < 0:
                continue
            chunk, skip = chunk[first + 1 :], False
        if own:
            *whole, rest = chunk.split(b"\n")
            if whole:
                yield b"".join([*held, whole[0]])
                yield from whole[1:]
                held = []
            if rest:
                held.append(rest)
            continue
        first = chunk.find(b"\n")
        if first >= 0:
            yield b"".join([*held, chunk[:first]])
            return
        held.append(chunk)
    if held:
        yield b"".join(held)
