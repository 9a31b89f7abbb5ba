"""Byte codecs of help files in plain Python and numpy; no Spark here."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np


class Cursor:
    """Reads little-endian numbers and the format's variable-width ones; past the end it reads zeros."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at, self.end = data, at, len(data) if end is None else min(end, len(data))

    def raw(self, n: int) -> bytes:
        out = self.data[self.at : max(self.at, min(self.at + n, self.end))]
        self.at += n
        return out + bytes(n - len(out))

    def number(self, n: int, signed: bool = False) -> int:
        stop = self.at + n
        if stop <= self.end:
            out = int.from_bytes(self.data[self.at : stop], "little", signed=signed)
            self.at = stop
            return out
        return int.from_bytes(self.raw(n), "little", signed=signed)

    def peek(self) -> int:
        return self.data[self.at] if self.at < self.end else 0

    def varied(self, narrow: int, bias: bool) -> int:
        """``narrow`` bytes, or twice as many if the first byte's low bit is set; halved towards zero after the bias."""
        n = narrow * 2 if self.at < self.end and self.data[self.at] & 1 else narrow
        value = self.number(n)
        if not bias:
            return value >> 1
        value -= 1 << (8 * n - 1)
        return -(-value >> 1) if value < 0 else value >> 1

    def text(self) -> bytes:
        """Up to the next zero byte, which is passed."""
        stop = self.data.find(b"\0", self.at, self.end)
        stop = self.end if stop < 0 else stop
        out = self.data[self.at : stop]
        self.at = stop + 1
        return out


def topic_length(data: bytes, at: int = 0) -> int:
    """The length that the head of a record of text tells: behind a number of two or four bytes, one of one or two."""
    if at + 6 > len(data):
        c = Cursor(data, at)
        c.varied(2, True)
        return c.varied(1, False)
    at += 4 if data[at] & 1 else 2
    return (data[at] | data[at + 1] << 8) >> 1 if data[at] & 1 else data[at] >> 1


def _runs(flags: int) -> tuple[list[int], int, int]:
    """Literals before each copy that eight flags tell of, literals behind the last one, bytes in all."""
    runs, own = [], 0
    for bit in range(8):
        if flags >> bit & 1:
            runs.append(own)
            own = 0
        else:
            own += 1
    return runs, own, 8 + len(runs)


_RUNS = [_runs(flags) for flags in range(256)]


def lz77_expand(data: bytes) -> bytes:
    """Flag bytes, lowest bit first: a clear bit is a literal, a set one a 16-bit copy (12 bits of distance, 4 of length)."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        runs, tail, size = _RUNS[data[i]]
        i += 1
        if i + size > n:  # the data ends within these flags: only whole copies count
            left, whole = n - i, []
            for run in runs:
                if left < run + 2:
                    tail = min(run, left)
                    break
                whole.append(run)
                left -= run + 2
            else:
                tail = min(tail, left)
            runs, size = whole, n - i
        end = i + size
        for run in runs:
            if run:
                out += data[i : i + run]
                i += run
            code = data[i] | data[i + 1] << 8
            i += 2
            length, distance = 3 + (code >> 12), (code & 0xFFF) + 1
            start = len(out) - distance
            if start < 0:
                pad = min(length, -start)
                out += bytes(pad)
                length -= pad
                start = len(out) - distance
            if distance >= length:
                out += out[start : start + length]
            else:
                out += (bytes(out[start:]) * (length // distance + 1))[:length]
        out += data[i : i + tail]
        i = end
    return bytes(out)


def _lz77_steps(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each place, how many bytes a copy of the last place of its three bytes covers (1: no copy), and how far back that is."""
    n = len(data)
    step, back = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if n < 4:
        return step, back
    raw = np.frombuffer(data, dtype=np.uint8)
    wide = raw.astype(np.int64)
    code = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) << 32 | np.arange(n - 2)  # sorted, equal ones stay in order
    code.sort()
    same = code[1:] >> 32 == code[:-1] >> 32
    at, before = code[1:][same] & 0xFFFFFFFF, code[:-1][same] & 0xFFFFFFFF
    near = at - before <= 4096
    at, before = at[near], before[near]
    step[at], back[at] = 3, at - before
    for k in range(3, 18):
        inside = at + k < n
        at, before = at[inside], before[inside]
        alike = raw[at + k] == raw[before + k]
        at, before = at[alike], before[alike]
        if not len(at):
            break
        step[at] = k + 1
    return step, back


def lz77_pack(data: bytes) -> bytes:
    """A packer for round trips: greedy, with the last place of every three bytes."""
    if len(data) <= 64 and len({data[k : k + 3] for k in range(len(data) - 2)}) == max(0, len(data) - 2):  # nothing to copy
        return b"".join([b"\0" + data[k : k + 8] for k in range(0, len(data), 8)])
    step, back = _lz77_steps(data)
    steps, starts, i, n = step.tolist(), [], 0, len(data)
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, dtype=np.int64)
    copied = step[at] > 1
    number = np.arange(len(at))
    places = number + np.cumsum(copied) - copied + number // 8 + 1  # behind its group's flags
    out = np.zeros(len(at) + int(copied.sum()) + (len(at) + 7) // 8, dtype=np.uint8)
    out[places[::8] - 1] = np.packbits(copied, bitorder="little")
    out[places[~copied]] = np.frombuffer(data, dtype=np.uint8)[at[~copied]]
    code = (step[at[copied]] - 3) << 12 | (back[at[copied]] - 1)
    out[places[copied]], out[places[copied] + 1] = code & 0xFF, code >> 8
    return out.tobytes()


def rle_expand(data: bytes, size: int) -> bytes:
    """Codes with bit 7 copy that many bytes, others repeat the next byte; a run that doesn't fit leaves zeros."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i] & 0x7F
        literal = data[i] & 0x80
        i += 1
        run = data[i : i + n] if literal else data[i : i + 1] * n
        i += n if literal else 1
        out += run if len(out) + n <= size else bytes(n)
    return bytes(out[:size].ljust(size, b"\0"))


_RUN = re.compile(rb"(.)\1{2,126}", re.DOTALL)


def rle_pack(data: bytes) -> bytes:
    out, i = [], 0
    for run in (*_RUN.finditer(data), None):
        end = run.start() if run else len(data)
        for j in range(i, end, 127):
            own = data[j : min(j + 127, end)]
            out += bytes([0x80 | len(own)]), own
        if run:
            i = run.end()
            out.append(bytes([i - end, data[end]]))
    return b"".join(out)


def gfx_unpack(data: bytes, packing: int, size: int) -> bytes | None:
    if packing == 0:
        return data[:size].ljust(size, b"\0")
    if packing == 1:
        return rle_expand(data, size)
    if packing == 2:
        return lz77_expand(data)[:size].ljust(size, b"\0")
    if packing == 3:
        return rle_expand(lz77_expand(data), size)
    return None


def phrases3(payload: bytes, version: int) -> list[bytes]:
    """The older phrase table; payload is the subfile without its prefix."""
    head, n = 4 if version <= 16 else 8, int.from_bytes(payload[:2], "little")
    table = payload[head : head + 2 * (n + 1)]
    data = payload[head + 2 * (n + 1) :]
    if version > 16:
        data = lz77_expand(data)
    cuts = [x - 2 * n - 2 for x in struct.unpack(f"<{len(table) // 2}H", table[: len(table) // 2 * 2])]
    return [data[max(0, a) : max(0, b)] for a, b in zip(cuts[:-1], cuts[1:])]


def phrases4(index: bytes, image: bytes) -> list[bytes]:
    """The newer phrase table: lengths as unary and binary bits, words read from the lowest bit."""
    n = int.from_bytes(index[4:8], "little")
    size, packed = (int.from_bytes(index[k : k + 4], "little", signed=True) for k in (12, 16))
    low_bits = int.from_bytes(index[24:26], "little") & 0x0F
    stream, at = index[28:], 0

    def bit() -> int:
        nonlocal at
        byte = at >> 3
        at += 1
        return stream[byte] >> (at - 1 & 7) & 1 if byte < len(stream) else 0

    data = image[:size] if size == packed else lz77_expand(image)
    out, start = [], 0
    for _ in range(n):
        length = 1
        while bit():
            length += 1 << low_bits
        for k in range(min(low_bits, 5)):
            length += bit() << k
        out.append(data[start : start + length])
        start += length
    return out


_CODES3 = re.compile(rb"[^\x01-\x0f]+|[\x01-\x0f].?", re.DOTALL)


def phrase3_expand(data: bytes, phrases: list[bytes], size: int) -> bytes:
    """Codes 1 to 15 start a two-byte phrase number, odd ones with a space after the phrase; others are literals."""
    out, n = bytearray(), len(phrases)
    for part in _CODES3.findall(data):
        if len(out) >= size:
            break
        if not 1 <= part[0] <= 15:
            out += part
            continue
        code = (part[0] << 8 | (part[1] if len(part) > 1 else 0)) - 256
        piece = phrases[code // 2] if code // 2 < n else b""
        out += piece if len(out) + len(piece) <= size else bytes(len(piece))
        if code & 1:
            out += b" "
    return bytes(out[:size])


def phrase4_expand(data: bytes, phrases: list[bytes], size: int) -> bytes:
    """By low bits: 0 a phrase, 01 a far phrase, 011 literals, 0111 spaces, 1111 zero bytes."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        c = data[i]
        i += 1
        if c & 1 == 0 or c & 3 == 1:
            if c & 1:
                number = (c + 1) * 64 + (data[i] if i < len(data) else 0)
                i += 1
            else:
                number = c // 2
            piece = phrases[number] if number < len(phrases) else b""
        elif c & 7 == 3:
            piece = data[i : i + c // 8 + 1]
            i += c // 8 + 1
        else:
            piece = (b" " if c & 8 == 0 else b"\0") * (c // 16 + 1)
        out += piece if len(out) + len(piece) <= size else bytes(len(piece))
    return bytes(out[:size])


def dib_rgba(pixels: bytes, width: int, height: int, bpp: int, palette: bytes | None) -> bytes:
    """Bottom-up rows padded to 32 bits as top-down RGBA; depths without a rule are grey."""
    stride = (width * bpp + 31) // 32 * 4
    rows = np.frombuffer(pixels[: stride * height].ljust(stride * height, b"\0"), dtype=np.uint8).reshape(height, stride)[::-1]
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    if bpp in (1, 4, 8):
        if bpp == 1:
            index = np.unpackbits(rows, axis=1)[:, :width]
        elif bpp == 4:
            index = np.stack([rows >> 4, rows & 15], axis=2).reshape(height, -1)[:, :width]
        else:
            index = rows[:, :width]
        colors = np.frombuffer(palette or b"\0\0\0\0\xff\xff\xff\0", dtype=np.uint8)
        colors = colors[: len(colors) // 4 * 4].reshape(-1, 4)
        out[:, :, :3] = colors[np.where(index < len(colors), index, 0)][:, :, 2::-1]
    elif bpp in (24, 32):
        body = rows[:, : width * bpp // 8].reshape(height, width, bpp // 8)
        out[:, :, :3] = body[:, :, 2::-1]
        if bpp == 32:
            out[:, :, 3] = body[:, :, 3]
    else:
        out[:, :, :3] = 128
    return out.tobytes()


def png(rgba: bytes, width: int, height: int) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


_HASHED = {chr(c): (c & ~0x20) - 48 for c in (*range(65, 91), *range(97, 123))} | {str(d): d for d in range(1, 10)} | {"0": 10, ".": 12, "_": 13}


def hash43(text: str) -> int:
    """The signed 32-bit context hash."""
    h, known = 0, _HASHED
    for c in text:
        if c in known:
            h = (h * 43 + known[c]) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h
