"""Decoding of one help file in memory: container, metadata, fonts, indexes, topics, pages and images.

``HelpFile`` turns the bytes of a file into plain rows; each table is decoded
when it's asked for. Nothing here imports Spark.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

from tomespark.functions import codecs

MAGIC, TREE, SYSTEM = 0x00035F3F, 0x293B, 0x036C
NONE32 = 0xFFFFFFFF
RECORD = struct.Struct("<IIIIIB")


class BadFile(ValueError):
    """The file as a whole can't be read; the message says why."""


def u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "little")


def i16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2].ljust(2, b"\0"), "little", signed=True)


def u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def zero_ended(b: bytes, at: int) -> bytes:
    stop = b.find(b"\0", at)
    return b[at : stop if stop >= 0 else len(b)]


def leaf_pages(tree: bytes) -> Iterator[tuple[int, bytes]]:
    """(entries, bytes from the first entry on) of a tree's leaves in key order; an empty or broken tree has none."""
    if len(tree) < 38 or u16(tree, 0) != TREE:
        return
    size, page, levels, total = u16(tree, 4), u16(tree, 26), u16(tree, 32), u16(tree, 30)
    body = tree[38:]
    if not levels or not size:
        return
    for _ in range(levels - 1):
        page = u16(body, page * size + 4)
    seen: set[int] = set()
    while page != 0xFFFF and page not in seen and page * size < len(body) and len(seen) <= total:
        seen.add(page)
        own = body[page * size : (page + 1) * size]
        yield max(0, i16(own, 2)), own[8:]
        page = u16(own, 6)


class HelpFile:
    def __init__(self, content: bytes, font_stride: int = 34) -> None:
        self.content, self.font_stride = content, font_stride
        if len(content) < 16:
            raise BadFile("file too small")
        if u32(content, 0) != MAGIC:
            raise BadFile("bad magic")
        start = u32(content, 4) + 9
        if start + 38 > len(content):
            raise BadFile("directory out of bounds")
        self.directory = content[start:]
        if u16(self.directory, 0) != TREE:
            raise BadFile("bad directory tree")
        self.info  # noqa: B018  a file without metadata isn't read

    # container

    @cached_property
    def entries(self) -> list[tuple[str, int]]:
        out = []
        for n, body in leaf_pages(self.directory):
            at = 0
            for _ in range(n):
                name = zero_ended(body, at)
                out.append((name.decode("latin-1"), u32(body, at + len(name) + 1)))
                at += len(name) + 5
        return out

    @cached_property
    def _offsets(self) -> dict[str, int]:
        return dict(reversed(self.entries))

    def subfile(self, name: str) -> bytes | None:
        """The payload behind the nine-byte prefix, by the reserved size; a leading | may be missing in the directory."""
        at = self._offsets.get(name, self._offsets.get(name[1:]) if name.startswith("|") else None)
        if at is None or at + 9 > len(self.content):
            return None
        reserved = u32(self.content, at)
        return self.content[at + 9 : at + reserved] if at + reserved <= len(self.content) else None

    def subfiles(self) -> Iterator[dict]:
        for name, at in self.entries:
            inside = at + 9 <= len(self.content)
            yield {"name": name, "offset": at, "reserved_size": u32(self.content, at) if inside else None, "payload": self.subfile(name)}

    # metadata

    @cached_property
    def info(self) -> dict:
        raw = self.subfile("|SYSTEM")
        if raw is None:
            raise BadFile("missing |SYSTEM")
        if len(raw) < 12:
            raise BadFile("|SYSTEM too small")
        if u16(raw, 0) != SYSTEM or u16(raw, 4) != 1:
            raise BadFile("bad |SYSTEM magic")
        version, flags = u16(raw, 2), u16(raw, 10)
        # block size and packing by version and flags
        size, packed = (0x800, False) if version <= 16 else (0x1000, False) if flags == 0 else (0x1000, True) if flags == 4 else (0x800, True)
        out = {"title": b"", "copyright": b"", "version": version, "flags": flags, "charset": 0, "lcid": 0, "scale": self.scale, "compressed": packed, "tbsize": size, "dsize": 0x4000 if packed else size - 12, "contents_start": 0, "sr_color": None, "nsr_color": None, "macros": []}
        if version <= 16:
            out["title"] = zero_ended(raw, 12)[:127]
            return out
        at = 12
        while at + 4 <= len(raw) and at + 4 + u16(raw, at + 2) <= len(raw):
            kind, body = u16(raw, at), raw[at + 4 : at + 4 + u16(raw, at + 2)]
            at += 4 + len(body)
            if kind == 1:
                out["title"] = zero_ended(body, 0)[:127]
            elif kind == 2:
                out["copyright"] = zero_ended(body, 0)[:127]
            elif kind == 3 and len(body) >= 4:
                out["contents_start"] = u32(body, 0)
            elif kind == 4 and zero_ended(body, 0):
                out["macros"].append(zero_ended(body, 0))
            elif kind == 6 and len(body) >= 90:
                if u16(body, 0) & 0x100:
                    out["sr_color"] = body[82] | body[83] << 8 | body[84] << 16
                if u16(body, 0) & 0x200:
                    out["nsr_color"] = body[86] | body[87] << 8 | body[88] << 16
            elif kind == 9 and len(body) >= 10:
                out["lcid"] = u16(body, 8)
            elif kind == 11:
                out["charset"] = next((c for c in body if c not in (0, 2)), out["charset"])
        return out

    @cached_property
    def encoding(self) -> str:
        from tomespark.functions.native import CHARSETS, LANGUAGES

        charset, lcid = self.info["charset"], self.info["lcid"]
        named = LANGUAGES.get(lcid & 255) if charset in (0, 1) and lcid else None
        return {"windows-874": "cp874", "shift_jis": "cp932", "euc-kr": "cp949", "gb2312": "gbk", "big5": "cp950"}.get(named or CHARSETS.get(charset, "windows-1252"), named or CHARSETS.get(charset, "windows-1252"))

    def text(self, raw: bytes) -> str:
        if self._extends_ascii and raw.isascii():
            return raw.decode("ascii")
        return raw.decode(self.encoding, "replace")

    @cached_property
    def _extends_ascii(self) -> bool:
        return self.encoding.startswith("windows-")  # these agree on ASCII

    # fonts

    @cached_property
    def scale(self) -> int:
        raw = self.subfile("|FONT")
        return 1 if raw is None or len(raw) < 8 or not u16(raw, 0) else (1 if u16(raw, 4) >= 12 else 10)

    def fonts(self) -> Iterator[dict]:
        raw = self.subfile("|FONT")
        if raw is None or len(raw) < 8 or not u16(raw, 0):
            return
        faces, n, face_at, at = (u16(raw, k) for k in (0, 2, 4, 6))
        width, newer = (at - face_at) // faces, face_at >= 12
        step = self.font_stride if newer else 11
        for i in range(n):
            d = raw[at + i * step :]
            if len(d) < (min(step, 34) if newer else 11):
                return
            d = d[:48].ljust(48, b"\0")
            face = u16(d, 1 if newer else 3)
            name = zero_ended(raw[face_at + face * width :][: min(width, 31)], 0) if face < faces else b"Helv"
            rgb = d[3:9] if newer else d[5:11]
            if newer:
                height = int.from_bytes(d[14:18], "little", signed=True)
                style = {"half_points": abs(height) // 10, "weight": i16(d, 30), "italic": d[34] != 0, "underline": d[35] != 0, "strikeout": d[36] != 0, "small_caps": d[38] != 0, "family": d[41] >> 4}
            else:
                style = {"half_points": d[1], "weight": 700 if d[0] & 1 else 400, "italic": bool(d[0] & 2), "underline": bool(d[0] & 4), "strikeout": bool(d[0] & 8), "small_caps": bool(d[0] & 32), "family": d[2]}
            yield {"font_idx": i, "face": self.text(name), **style, "fg": int.from_bytes(rgb[:3], "little"), "bg": int.from_bytes(rgb[3:], "little")}

    # indexes

    def context(self) -> Iterator[dict]:
        for n, body in leaf_pages(self.subfile("|CONTEXT") or b""):
            for k in range(min(n, len(body) // 8)):
                yield dict(zip(("hash", "topic_offset"), struct.unpack_from("<ii", body, 8 * k)))

    @cached_property
    def context_map(self) -> dict[int, int]:
        return {r["hash"]: r["topic_offset"] for r in reversed(list(self.context()))}

    def keywords(self) -> Iterator[dict]:
        for tree in "KA":
            leaves, data = self.subfile(f"|{tree}WBTREE"), self.subfile(f"|{tree}WDATA")
            if leaves is None or data is None:
                continue
            number = 0
            for n, body in leaf_pages(leaves):
                at = 0
                for _ in range(n):
                    word = zero_ended(body, at)
                    count, where = u16(body, at + len(word) + 1), u32(body, at + len(word) + 3)
                    at += len(word) + 7
                    for k in range(min(count, max(0, len(data) - where) // 4)):
                        yield {"tree": tree, "kw_seq": number, "keyword": self.text(word), "off_seq": k, "topic_offset": u32(data, where + 4 * k)}
                    number += 1

    # topics

    @cached_property
    def phrases(self) -> tuple[int, list[bytes]]:
        """(generation, phrases): 3, 4, or 0 without any."""
        if (raw := self.subfile("|Phrases")) is not None:
            return 3, codecs.phrases3(raw, self.info["version"])
        index, image = self.subfile("|PhrIndex"), self.subfile("|PhrImage")
        return (4, codecs.phrases4(index, image)) if index is not None and image is not None else (0, [])

    def expand(self, raw: bytes, size: int) -> bytes | None:
        generation, phrases = self.phrases
        if not generation:
            return None
        return (codecs.phrase3_expand if generation == 3 else codecs.phrase4_expand)(raw, phrases, size)

    @cached_property
    def blocks(self) -> tuple[bytes, list[int]]:
        """All topic blocks one after the other, and where each starts."""
        raw = self.subfile("|TOPIC")
        if raw is None:
            raise BadFile("missing |TOPIC")
        size, dsize = self.info["tbsize"], self.info["dsize"]
        out, starts = bytearray(), []
        for at in range(0, len(raw), size):
            starts.append(len(out))
            if self.info["compressed"]:
                begin = max(0, len(raw) - 0x44) if at + 0x44 > len(raw) else at
                out += codecs.lz77_expand(raw[begin + 12 : at + size])
            else:
                out += raw[at + 12 : at + size].ljust(dsize if at + size < len(raw) else 0, b"\0")
        return bytes(out), starts

    def place(self, ref: int) -> tuple[int, int]:
        at = ref - 12
        return divmod(at, self.info["dsize"]) if self.info["version"] <= 16 else (at >> 14, at & 0x3FFF)

    @cached_property
    def records(self) -> list[dict]:
        """The chain of topic records; a record that comes again ends it."""
        data, starts = self.blocks
        old = self.info["version"] <= 16
        out, seen, ref, last, offset = [], set(), 12, None, 0
        while ref != NONE32 and ref >= 12 and ref not in seen:
            block, inner = self.place(ref)
            if old and last is not None and block != last:
                ref -= 12
                block, inner = self.place(ref)
            if ref in seen or not 0 <= block < len(starts) or starts[block] + inner + 0x15 >= len(data):
                break
            seen.add(ref)
            at = starts[block] + inner
            if block != last:
                offset, last = 0, block
            block_size, text_size, _, step, data_len, kind = RECORD.unpack_from(data, at)
            length = codecs.topic_length(data, at + 0x15) if kind in (0x20, 0x23) else 0
            out.append({"seq": len(out), "ref": ref, "block_idx": block, "rec_type": kind, "block_size": block_size, "text_size": text_size, "data_len": data_len, "next_ref": step, "topic_offset": ref + block * 12 if old else block * 0x8000 + offset, "topic_length": length, "at": at})
            offset += length
            if old and not step:
                break
            ref = ref + step if old else step
        return out

    def record_text(self, r: dict) -> bytes:
        data, _ = self.blocks
        room = r["block_size"] - r["data_len"]
        raw = data[r["at"] + r["data_len"] : r["at"] + max(r["data_len"], r["block_size"])]
        if r["text_size"] <= room:
            return raw[: r["text_size"]].ljust(min(r["text_size"], 1 << 24), b"\0")
        found = self.expand(raw, r["text_size"])
        return raw if found is None else found

    @cached_property
    def pages(self) -> list[dict]:
        data, _ = self.blocks
        out = []
        for r in self.records:
            if r["rec_type"] != 2:
                continue
            at = r["at"]
            parts = self.record_text(r).split(b"\0") if 0 < r["text_size"] < 256 else [b""]
            long = self.info["version"] > 16 and r["data_len"] >= 0x2D
            out.append({"page_idx": len(out), "ref": r["ref"], "topic_offset": r["topic_offset"], "browse_bwd": u32(data, at + 0x19), "browse_fwd": u32(data, at + 0x1D), "scroll_ref": u32(data, at + 0x29) if long else NONE32, "title": self.text(parts[0]), "macros": [self.text(p) for p in parts[1:] if b"(" in p], "seq": r["seq"]})
        return out
