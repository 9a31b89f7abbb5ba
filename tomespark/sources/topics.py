"""Pages of a help file as ordered operations: paragraphs, texts, fonts, links, images and tables."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

from tomespark.functions.codecs import Cursor, hash43

from .container import NONE32, HelpFile, i16, u16, u32, zero_ended

MAX_TABS, MAX_SPOTS = 32, 32
#: Simple format codes and the operations they stand for.
SIMPLE = {0x81: "LINE_BREAK", 0x83: "TAB", 0x89: "LINK_END", 0x8B: "NBSP", 0x8C: "NBHYPHEN"}
ALIGNMENT = {0x000: "left", 0x400: "right", 0x800: "center"}
SIZES = ("space_before", "space_after", "line_space", "indent_left", "indent_right", "indent_first")


def _wrap16(x: int) -> int:
    return (x + 0x8000 & 0xFFFF) - 0x8000


def _scaled(x: int, width: int) -> int:
    """x * width / 32767, cut towards zero, in 16 bits."""
    product = x * width
    return _wrap16(abs(product) // 32767 * (1 if product >= 0 else -1))


class PageWriter:
    """Walks the records of one page and yields operations as dicts with an ``op`` and their place ``seq``.

    ``wanted``: the operations that are kept, all by default; others only count.
    """

    def __init__(self, file: HelpFile, wanted: Collection[str] | None = None) -> None:
        self.file, self.wanted = file, wanted
        self.texts = self.wants("TEXT")
        self.n = 0
        self.ops: list[dict] = []

    def wants(self, op: str) -> bool:
        return self.wanted is None or op in self.wanted

    def put(self, op: str, **fields) -> None:
        if self.wanted is None or op in self.wanted:
            self.ops.append({"seq": self.n, "op": op, **fields})
        self.n += 1

    def page(self, page: dict, records: list[dict]) -> list[dict]:
        self.put("PAGE_START", text=page["title"], bwd=page["browse_bwd"], fwd=page["browse_fwd"])
        for macro in page["macros"]:
            self.put("MACRO", text=macro)
        fixed, border = False, page["scroll_ref"]
        for r in records:
            if r["rec_type"] == 2:
                self.put("ANCHOR", target=r["topic_offset"])
            elif r["rec_type"] in (0x01, 0x20, 0x23):
                if border != NONE32 and fixed != (r["ref"] < border):
                    fixed = not fixed
                    self.put("NON_SCROLL_START" if fixed else "NON_SCROLL_END")
                self.record(r)
        if fixed:
            self.put("NON_SCROLL_END")
        self.put("PAGE_END")
        return self.ops

    def record(self, r: dict) -> None:
        data, _ = self.file.blocks
        text, kind = self.file.record_text(r), r["rec_type"]
        fmt = Cursor(data, r["at"] + 0x15, r["at"] + r["data_len"])
        if kind in (0x20, 0x23):
            fmt.varied(2, True)
            fmt.varied(1, False)
        at = 0
        if kind != 0x23:
            self.paragraph(r, fmt, text, at)
            return
        self.table(fmt)
        column = -1
        while fmt.at < fmt.end:
            here = fmt.number(2, True)
            if here == -1:
                if column >= 0:
                    self.put("TABLE_ROW_END")
                break
            if 0 <= here < column:
                self.put("TABLE_ROW_END")
            if here != column or column == -1:
                self.put("TABLE_CELL")
            column = here
            fmt.raw(3)
            at = self.paragraph(r, fmt, text, at)
        self.put("TABLE_END")

    def table(self, fmt: Cursor) -> None:
        n, kind = fmt.number(1), fmt.number(1)
        variable = kind in (0, 2)
        width = fmt.number(2, True) if variable else 0
        size = (lambda x: _scaled(x, width)) if variable else _wrap16
        pairs = [(fmt.number(2, True), fmt.number(2, True)) for _ in range(n)]
        if not self.wants("TABLE_START"):
            self.n += 1
            return
        first = pairs[0][1] if pairs else 0
        gap = pairs[1][1] if n > 1 else 0
        position = int(gap / 2)
        cols = []
        for g, w in pairs:
            position = _wrap16(position + g + w)
            cols.append({"gap": g, "width": w, "cellx": size(position)})
        self.put("TABLE_START", ncols=n, table_type=kind, min_width=width, trleft=size(first - gap), trgaph=size(gap), cols=cols)

    def paragraph(self, r: dict, fmt: Cursor, text: bytes, at: int) -> int:
        """The paragraph that starts at ``at`` in the record's text; gives where the next one starts."""
        fmt.raw(6 if r["rec_type"] == 0x01 else 4)
        bits = fmt.number(2)
        if bits & 0x1:
            fmt.varied(2, True)
        sizes = [fmt.varied(1, True) if bits & flag else 0 for flag in (0x2, 0x4, 0x8, 0x10, 0x20, 0x40)]
        border, border_width = (fmt.number(1), fmt.number(2, True)) if bits & 0x100 else (0, 0)
        tabs = []
        if bits & 0x200:
            for _ in range(min(MAX_TABS, max(0, fmt.varied(1, True)))):
                tab = fmt.varied(1, False)
                tabs.append(tab & 0x3FFF)
                if tab & 0x4000:
                    fmt.varied(1, False)
        if self.wants("PARAGRAPH"):
            self.put("PARAGRAPH", target=r["topic_offset"] + at, flags=bits, **dict(zip(SIZES, sizes)), alignment=ALIGNMENT.get(bits & 0xC00, "left"), border=border, border_width=border_width, tabs=tabs)
        else:
            self.n += 1
        ops, size, end, data, decoded, wanted, texts = self.ops, len(text), fmt.end, fmt.data, self.file.text, self.wanted, self.texts
        while at < size and fmt.at < end:
            stop = text.find(b"\0", at)
            stop = size if stop < 0 else stop
            if stop > at:
                if texts:
                    ops.append({"seq": self.n, "op": "TEXT", "text": decoded(text[at:stop])})
                self.n += 1
            at = stop + 1
            code = data[fmt.at]
            fmt.at += 1
            if code == 0xFF:
                break
            if code == 0x82:
                self.put("PAR", target=r["topic_offset"] + at)
            elif code in SIMPLE:
                if wanted is None or SIMPLE[code] in wanted:
                    ops.append({"seq": self.n, "op": SIMPLE[code]})
                self.n += 1
            elif code in self.CODES:
                self.CODES[code](self, code, fmt)
        return at

    def _skip(n: int) -> Callable:  # noqa: N805
        return lambda self, code, fmt: fmt.raw(n) and None

    def _font(self, code: int, fmt: Cursor) -> None:
        self.put("FONT_CHANGE", font_idx=fmt.number(2))

    def _image(self, code: int, fmt: Cursor) -> None:
        kind, size = fmt.number(1), fmt.varied(2, True)
        if kind == 0x22:
            fmt.varied(1, False)
        if kind in (0x03, 0x22) and u16(fmt.data, fmt.at) == 0:
            number = u16(fmt.data, fmt.at + 2)
            self.put("IMAGE", position=code - 0x86, bm_index=number)
            for spot in hotspots(self.file, number):
                self.put("HOTSPOT_LINK", kind=spot["kind"], target=0 if spot["kind"] == "macro" else spot["target_offset"], x=spot["x"], y=spot["y"], w=spot["w"], h=spot["h"])
                if spot["kind"] == "macro":
                    self.put("MACRO", text=spot["macro"])
        fmt.at += max(0, size)

    def _macro(self, code: int, fmt: Cursor) -> None:
        n = fmt.number(2)
        self.put("LINK_START", kind="macro", target=0)
        self.put("MACRO", text=self.file.text(zero_ended(fmt.data[fmt.at : fmt.end], 0)) if self.wants("MACRO") else None)
        fmt.at += n

    def _link(self, code: int, fmt: Cursor) -> None:
        value = fmt.number(4)
        if self.wants("LINK_START"):
            self._start(code, value)
        else:
            self.n += 1

    def _far_link(self, code: int, fmt: Cursor) -> None:
        n = fmt.number(2)
        kind, value = fmt.data[fmt.at], u32(fmt.data, fmt.at + 1)
        self._start(code, value, self.file.text(zero_ended(fmt.data[fmt.at + 5 : fmt.end], 0)) if kind in (4, 6) else None)
        fmt.at += n

    def _start(self, code: int, value: int, file: str | None = None) -> None:
        signed = value - (1 << 32) if value >> 31 else value
        found = self.file.context_map.get(signed, -1)
        self.put("LINK_START", kind="jump" if code & 1 else "popup", target=found if found >= 0 else value, file=file)

    CODES = {0x20: _skip(4), 0x21: _skip(2), 0x80: _font, 0xC8: _macro, 0xCC: _macro, **dict.fromkeys((0x86, 0x87, 0x88), _image), **dict.fromkeys((0xE0, 0xE1, 0xE2, 0xE3, 0xE6, 0xE7), _link), **dict.fromkeys((0xEA, 0xEB, 0xEE, 0xEF), _far_link)}


def page_ops(file: HelpFile, wanted: Collection[str] | None = None) -> Iterator[dict]:
    """All operations of all pages, or those wanted: page_idx, seq, op and the operation's own fields."""
    cuts = [p["seq"] for p in file.pages] + [len(file.records)]
    for page, begin, end in zip(file.pages, cuts[:-1], cuts[1:]):
        for op in PageWriter(file, wanted).page(page, file.records[begin:end]):
            op["page_idx"] = page["page_idx"]
            yield op


def _picture(file: HelpFile, number: int) -> dict | None:
    """The header of a bitmap's first picture."""
    raw = file.subfile(f"|bm{number}")
    if raw is None or len(raw) < 8 or not u16(raw, 2):
        return None
    begin = u32(raw, 4)
    c = Cursor(raw, begin)
    kind, packing = c.number(1), c.number(1)
    out = {"raw": raw[begin:], "type": kind, "packing": packing, "width": None, "height": None, "bpp": None}
    if kind in (5, 6):
        c.varied(2, False), c.varied(2, False), c.varied(1, False)
        bpp, width, height, used = c.varied(1, False), c.varied(2, False), c.varied(2, False), c.varied(2, False)
        c.varied(2, False)
        packed, spots = c.varied(2, False), c.varied(2, False)
        data_at, spots_at = c.number(4), c.number(4)
        colors = (used or (1 << bpp if bpp <= 8 else 0)) if kind == 6 else 0
        out |= {"bpp": bpp, "width": width, "height": height, "size": (width * bpp + 31) // 32 * 4 * height, "palette": raw[c.at : c.at + 4 * colors] if colors else None}
    elif kind == 8:
        c.varied(1, False)
        width, height = c.number(2), c.number(2)
        size, packed, spots = c.varied(2, False), c.varied(2, False), c.varied(2, False)
        data_at, spots_at = c.number(4), c.number(4)
        out |= {"width": width, "height": height, "size": size}
    else:
        return out
    return out | {"data": out["raw"][data_at : data_at + packed], "spots": out["raw"][spots_at:] if spots and spots_at else b""}


def image_numbers(file: HelpFile) -> list[int]:
    names = (n.removeprefix("|") for n, _ in file.entries)
    return sorted({int(n[2:]) for n in names if n.startswith("bm") and n[2:].isdigit()})


def metafiles(file: HelpFile) -> Iterator[dict]:
    """bm_index and metafile of the images that are metafiles, without their pixels."""
    from tomespark.functions import codecs

    for number in image_numbers(file):
        p = _picture(file, number)
        if p is not None and p["type"] == 8 and p["size"] <= 1 << 28:
            yield {"bm_index": number, "metafile": codecs.gfx_unpack(p["data"], p["packing"], p["size"])}


def images(file: HelpFile) -> Iterator[dict]:
    from tomespark.functions import codecs

    from .metafile import BadMetafile, first_bitmap

    for number in image_numbers(file):
        p = _picture(file, number)
        if p is None:
            continue
        pixels = body = None
        width, height = p["width"], p["height"]
        if "data" in p and p["size"] <= 1 << 28:
            body = codecs.gfx_unpack(p["data"], p["packing"], p["size"])
        if body is not None and p["type"] in (5, 6) and p["width"] and p["height"]:
            pixels = codecs.dib_rgba(body, p["width"], p["height"], p["bpp"], p["palette"])
        if body is not None and p["type"] == 8:
            try:  # the pixels of a metafile are those of the first bitmap in it
                first = first_bitmap(body)
            except BadMetafile:
                first = None
            if first:
                pixels, width, height = first["rgba"], first["width"], first["height"]
        yield {"bm_index": number, "type": p["type"], "packing": p["packing"], "width": p["width"], "height": p["height"], "bpp": p["bpp"], "rgba": pixels, "png": codecs.png(pixels, width, height) if pixels else None, "metafile": body if p["type"] == 8 else None}


def hotspots(file: HelpFile, number: int) -> Iterator[dict]:
    p = _picture(file, number)
    if p is None or not p.get("spots"):
        return
    raw = p["spots"]
    n, macros = u16(raw, 1), u32(raw, 3)
    strings = Cursor(raw, 7 + 15 * n + macros)
    found = 0
    for i in range(n):
        if found == MAX_SPOTS:
            return
        at = 7 + 15 * i
        strings.text()
        name = strings.text()
        code = raw[at] if at < len(raw) else 0
        if code not in (0xC8, 0xE6, 0xE7, 0xEE, 0xEF):
            continue
        target = None if code == 0xC8 else file.context_map.get(hash43(file.text(name)))
        yield {"bm_index": number, "seq": found, "kind": "macro" if code == 0xC8 else "jump" if code & 1 else "popup", "target_offset": target, "x": u16(raw, at + 3), "y": u16(raw, at + 5), "w": u16(raw, at + 7), "h": u16(raw, at + 9), "macro": file.text(name) if code == 0xC8 else None}
        found += 1


__all__ = ["PageWriter", "hotspots", "i16", "image_numbers", "images", "page_ops"]
