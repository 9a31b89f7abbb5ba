"""Writes small help files: for round trips and for tests, not for viewers."""

import struct
from functools import lru_cache

from tomespark.functions import codecs

from .container import RECORD, TREE


def tree(pairs, page_size=256):
    """A tree of (key bytes, entry bytes) in key order, with as many levels as it takes."""
    leaves, own, counts = [], b"", []
    for _, entry in pairs:
        if not counts or len(own) + len(entry) + 8 > page_size:
            if counts:
                leaves.append(own)
            own = b""
            counts.append(0)
        own += entry
        counts[-1] += 1
    leaves.append(own)
    counts = counts or [0]
    pages = [struct.pack("<hhHH", 0, n, i - 1 & 0xFFFF, i + 1 if i + 1 < len(leaves) else 0xFFFF) + body for i, (body, n) in enumerate(zip(leaves, counts))]
    root, levels = 0, 1
    if len(pages) > 1:
        firsts = [0]
        for n in counts[:-1]:
            firsts.append(firsts[-1] + n)
        body = b"".join(pairs[f][0] + struct.pack("<H", i) for i, f in enumerate(firsts) if i)
        pages.append(struct.pack("<hhH", 0, len(firsts) - 1, 0) + body)
        root, levels, page_size = len(pages) - 1, 2, max(page_size, len(body) + 8)
    head = struct.pack("<HHH16sHHHHHHi", TREE, 0, page_size, b"", 0, 0, root, 0, len(pages), levels, len(pairs))
    return head + b"".join(p.ljust(page_size, b"\0") for p in pages)


def subfile(payload):
    return struct.pack("<IIB", len(payload) + 9, len(payload), 0) + payload


def container(files):
    body, entries = b"", []
    for name, payload in sorted(files.items(), key=lambda x: x[0].encode("latin-1")):
        entries.append((name.encode("latin-1") + b"\0", name.encode("latin-1") + b"\0" + struct.pack("<I", 16 + len(body))))
        body += subfile(payload)
    directory = subfile(tree(entries))
    return struct.pack("<IIII", 0x00035F3F, 16 + len(body), 0, 16 + len(body) + len(directory)) + body + directory


def system(version=21, flags=0, title=b"A title", records=()):
    head = struct.pack("<HHHIH", 0x036C, version, 1, 0, flags)
    if version <= 16:
        return head + title + b"\0"
    out = head
    for kind, body in [(1, title + b"\0"), *records]:
        out += struct.pack("<HH", kind, len(body)) + body
    return out


def narrow(x):
    return struct.pack("<B", 2 * x) if x < 128 else struct.pack("<H", 2 * x + 1)


def wide_signed(x):
    return struct.pack("<H", (2 * x + 0x8000) & 0xFFFE)


def record(kind, head, text, stored=None):
    stored = text if stored is None else stored
    return kind, 0x15 + len(head), head, text, stored


def _room(version, flags):
    packed = version > 16 and flags in (4, 8)
    size = 0x1000 if version > 16 and flags in (0, 4) else 0x800
    return packed, size, 0x4000 if packed else size - 12


def _places(records, version, room):
    """Where each record starts in the blocks' contents, and where the last one ends."""
    refs, at = [], 0
    for _, d, _, _, stored in records:
        n = d + len(stored)
        if at % room + 0x16 > room or version <= 16 and at % room + n > room:
            at += room - at % room
        refs.append(at)
        at += n
    return refs, at


def _ref(at, version, room):
    return 12 + (at if version <= 16 else at // room << 14 | at % room)


def references(records, version=21, flags=0):
    """The reference that each record will have in the topic subfile."""
    _, _, room = _room(version, flags)
    return [_ref(a, version, room) for a in _places(records, version, room)[0]]


def page_offsets(records, version=21, flags=0):
    """The topic offset that each page (a record of type 2) will have; for versions above 16."""
    _, _, room = _room(version, flags)
    out, last, offset = [], None, 0
    for (kind, _, head, _, _), a in zip(records, _places(records, version, room)[0]):
        if a // room != last:
            last, offset = a // room, 0
        if kind == 2:
            out.append(last * 0x8000 + offset)
        elif kind in (0x20, 0x23):
            offset += codecs.topic_length(head)
    return out


def topic(records, version=21, flags=0):
    """The topic subfile of records made by record(); gives it and each record's reference."""
    packed, size, room = _room(version, flags)
    refs, at = _places(records, version, room)
    sizes = [d + len(s) for _, d, _, _, s in records]
    ref = lambda at: _ref(at, version, room)
    flat, known, pack = bytearray(at), [ref(a) for a in refs], RECORD.pack
    for i, ((kind, d, head, text, stored), a) in enumerate(zip(records, refs)):
        last = i + 1 == len(refs)
        if version <= 16:
            crossing = not last and refs[i + 1] // room != a // room
            after = 0 if last else refs[i + 1] - a + 12 * crossing
        else:
            after = 0xFFFFFFFF if last else known[i + 1]
        flat[a : a + sizes[i]] = pack(sizes[i], len(text), 0, after, d, kind) + head + stored
    out = b""
    for k in range(0, max(1, len(flat)), room):
        body = bytes(flat[k : k + room])
        if packed:
            body = codecs.lz77_pack(body)
            assert len(body) <= size - 12
            out += bytes(12) + (body.ljust(size - 12, b"\0") if k + room < len(flat) else body.ljust(0x44 - 12, b"\0"))
        else:
            out += bytes(12) + body
    return out, known


HEADER = struct.Struct("<IIIIIII")


def header(title, version=21, scroll=None, backward=None, forward=None):
    return record(2, HEADER.pack(0, *[0xFFFFFFFF if x is None else x for x in (backward, forward)], 0, 0, 0xFFFFFFFF if scroll is None else scroll, 0), title)


def paragraph(pieces):
    """pieces: (text, format bytes that follow)."""
    text = b"".join(t + b"\0" for t, _ in pieces)
    codes = b"".join(c for _, c in pieces) + b"\xff"
    head = wide_signed(0) + narrow(min(len(text), 16000)) + bytes(4) + struct.pack("<H", 0) + codes
    return record(0x20, head, text + b"\0")


def small_signed(x):
    """A signed number of one or two bytes, always in two."""
    return struct.pack("<H", 0x8000 + (2 * x + 1 if x >= 0 else 2 * x - 1))


@lru_cache(1 << 14)
def layout(sizes=(), border=None, tabs=(), align=0):
    """The flags and numbers of a paragraph: space before, after and between lines, indents left, right and first."""
    flags = align | (0x100 if border else 0) | (0x200 if tabs else 0) | (0x7E if sizes else 0)
    out = struct.pack("<H", flags) + b"".join(small_signed(x) for x in sizes)
    if border:
        out += struct.pack("<Bh", *border)
    if tabs:
        out += small_signed(len(tabs)) + b"".join(narrow(t) for t in tabs)
    return bytes(4) + out


def formatted(pieces, own=None):
    """A paragraph with its layout; pieces as in paragraph()."""
    text = b"\0".join([t for t, _ in pieces] + [b""])
    codes = b"".join([c for _, c in pieces]) + b"\xff"
    return record(0x20, wide_signed(0) + narrow(min(len(text), 16000)) + (layout() if own is None else own) + codes, text + b"\0")


@lru_cache(256)
def _cell(column):
    return struct.pack("<h", column) + bytes(3) + layout() + b"\xff"


def table(kind, width, columns, cells):
    """columns: (gap, width); cells: (column, text)."""
    head = bytes([len(columns), kind]) + (struct.pack("<h", width) if kind in (0, 2) else b"") + b"".join(struct.pack("<hh", *c) for c in columns)
    text = b"\0".join([t for _, t in cells] + [b""])
    body = b"".join([_cell(c) for c, _ in cells]) + b"\xff\xff"
    return record(0x23, wide_signed(0) + narrow(min(len(text), 16000)) + head + body, text + b"\0")


def fonts(faces, styles):
    """The older font table; styles: (attributes, half points, family, face, foreground, background)."""
    at = 8 + 20 * len(faces)
    body = b"".join(f.ljust(20, b"\0") for f in faces)
    for attributes, half, family, face, fg, bg in styles:
        body += struct.pack("<BBBH", attributes, half, family, face) + fg.to_bytes(3, "little") + bg.to_bytes(3, "little")
    return struct.pack("<HHHH", len(faces), len(styles), 8, at) + body


def phrase_table(phrases):
    table, cuts = b"".join(phrases), [2 * len(phrases) + 2]
    for p in phrases:
        cuts.append(cuts[-1] + len(p))
    return struct.pack("<HHI", len(phrases), 0, len(table)) + struct.pack(f"<{len(cuts)}H", *cuts) + codecs.lz77_pack(table)


def phrase_index(phrases, low_bits=2):
    """The newer phrase table as its two subfiles."""
    bits = []
    for p in phrases:
        n = len(p) - 1
        bits += [1] * (n >> low_bits) + [0] + [n >> k & 1 for k in range(low_bits)]
    stream = bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))
    image = b"".join(phrases)
    packed = codecs.lz77_pack(image)
    head = struct.pack("<IIIiiIHH", 1, len(phrases), 0, len(image), len(packed), 0, low_bits, 0)
    if len(packed) == len(image):  # equal sizes mean a table as it stands
        packed = image
    return head + stream, packed


def spots(entries):
    """entries: (code, x, y, w, h, name)."""
    places = b"".join(struct.pack("<BHHHHHI", c, 0, x, y, w, h, 0) for c, x, y, w, h, _ in entries)
    return struct.pack("<BHI", 1, len(entries), 0) + places + b"".join(b"n\0" + name + b"\0" for *_, name in entries)


def dib_image(rows, width, packing=0, hotspots=b""):
    """A bitmap of 24 bits a pixel; rows from the bottom up, each padded."""
    raw = b"".join(rows)
    pack = {0: lambda b: b, 1: codecs.rle_pack, 2: codecs.lz77_pack, 3: lambda b: codecs.lz77_pack(codecs.rle_pack(b))}[packing]
    body, wide = pack(raw), lambda x: struct.pack("<H", 2 * x)
    head = bytes([6, packing]) + wide(0) * 2 + bytes([2, 48]) + wide(width) + wide(len(rows)) + wide(0) * 2 + wide(len(body)) + wide(len(hotspots))
    at = len(head) + 8
    return struct.pack("<HHI", 0x506C, 1, 8) + head + struct.pack("<II", at, at + len(body)) + body + hotspots


def metafile_image(raw, width, height):
    wide = lambda x: struct.pack("<H", 2 * x)
    head = bytes([8, 0, 2]) + struct.pack("<HH", width, height) + wide(len(raw)) * 2 + wide(0)
    return struct.pack("<HHI", 0x506C, 1, 8) + head + struct.pack("<II", len(head) + 8, 0) + raw


def metafile(records, objects=4):
    """records: (function, body)."""
    out = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, objects, 0, 0)
    for function, body in [*records, (0, b"")]:
        body += b"\0" * (len(body) % 2)
        out += struct.pack("<IH", 3 + len(body) // 2, function) + body
    return out
