"""Windows metafiles as ordered drawing operations.

``operations`` reads the records of a placeable-free metafile. Pens, brushes,
fonts, colours and fill modes are told only when a drawing needs a value that
differs from the one told last; restoring a saved state forgets what was told.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass, field

from tomespark.functions import codecs

STACK, POINTS, WORD = 32, struct.Struct("<hh"), struct.Struct("<H")
#: Character sets of fonts in metafiles, which know two more than those of pages; others are Western.
ENCODINGS = {128: "cp932", 129: "cp949", 134: "gbk", 136: "big5", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}

#: Record functions of the format.
END = 0x0000
PLACEHOLDERS = (0x00F7, 0x01F9, 0x0142, 0x06FF)


#: What a drawing needs: the operation that tells it, and where the state holds it.
NEEDS = {"p": ("SET_PEN", "pen"), "b": ("SET_BRUSH", "brush"), "m": ("SET_POLY_FILL_MODE", "fill_mode"), "f": ("SET_FONT", "font"), "c": ("SET_TEXT_COLOR", "text_color")}


class BadMetafile(ValueError):
    pass


@dataclass
class State:
    pen: dict | None = None
    brush: dict | None = None
    font: dict | None = None
    text_color: int | None = None
    fill_mode: int | None = None
    window: tuple[int, int, int, int] = (0, 0, 0, 0)  # origin x, y; extent x, y


@dataclass
class Reader:
    """The parameters of one record; a read past their end makes the record count for nothing."""

    data: bytes
    at: int = 0

    def shorts(self, n: int) -> tuple[int, ...]:
        out = struct.unpack_from(f"<{n}h", self.data, self.at)
        self.at += 2 * n
        return out

    def word(self) -> int:
        (out,) = WORD.unpack_from(self.data, self.at)
        self.at += 2
        return out

    def long(self) -> int:
        (out,) = struct.unpack_from("<I", self.data, self.at)
        self.at += 4
        return out

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise struct.error
        self.at += n
        return self.data[self.at - n : self.at]

    def points(self, n: int) -> list[dict]:
        return [{"x": x, "y": y} for x, y in POINTS.iter_unpack(self.raw(4 * n))]

    def box(self) -> dict:
        bottom, right, top, left = self.shorts(4)
        return {"left": left, "top": top, "right": right, "bottom": bottom}


def _corners(b: dict) -> list[dict]:
    return [{"x": x, "y": y} for x, y in ((b["left"], b["top"]), (b["right"], b["top"]), (b["right"], b["bottom"]), (b["left"], b["bottom"]))]


@dataclass
class Player:
    objects: list[dict | None]
    room: int
    ops: list[dict] = field(default_factory=lambda: [{"op": "BOUNDS", "rect": [0, 0, 0, 0]}])
    state: State = field(default_factory=State)
    saved: list[State] = field(default_factory=list)
    told: dict = field(default_factory=dict)
    seen: set = field(default_factory=set)
    window_told: tuple | None = None
    at: tuple[int, int] = (0, 0)
    path: list[list[dict]] | None = None
    paths: list[list[dict]] = field(default_factory=list)
    skipping: bool = False

    # what drawings have in common

    def draw(self, op: str, needs: str = "", **fields) -> None:
        """Tells the state that the drawing needs (p pen, b brush, m fill mode, f font, c text colour), then draws."""
        self.fix_window()
        for need in needs:
            name, part = NEEDS[need]
            value = getattr(self.state, part)
            if value is not None and self.told.get(name) != value and (need != "m" or value):
                self.told[name] = value
                self.ops.append({"op": name, **(value if isinstance(value, dict) else {"mode": value} if need == "m" else {"color": value})})
        self.ops.append({"op": op, **fields})

    def fix_window(self) -> None:
        """The first drawing's window is the picture's, once both of its parts are known."""
        if self.window_told is None and self.seen == {"origin", "extent"}:
            self.window_told = self.state.window
            self.ops[0]["rect"] = list(self.state.window)

    def restored(self) -> None:
        self.ops.append({"op": "CLIP_RESTORE"})
        self.told = {k: v for k, v in self.told.items() if k == "SET_POLY_FILL_MODE"}

    def polygons(self, lists: list[list[dict]], op: str, needs: str) -> None:
        if self.path is not None:
            if not self.skipping:
                self.path += lists
            return
        self.draw(op, needs, sizes=[len(x) for x in lists] if op == "POLYPOLYGON" else None, points=[p for x in lists for p in x])

    def bitmap(self, dib: bytes, rop: int, x: int, y: int, w: int, h: int) -> None:
        if len(dib) < 40:
            return
        head, width, height = struct.unpack_from("<Iii", dib)
        bpp, used = struct.unpack_from("<H", dib, 14)[0], struct.unpack_from("<I", dib, 32)[0]
        colors = used or (1 << bpp if bpp <= 8 else 0)
        if not 40 <= head <= len(dib) or not 0 < width <= 65535 or not 0 < height <= 65535 or head + 4 * colors > len(dib):
            return
        rgba = codecs.dib_rgba(dib[head + 4 * colors :], width, height, bpp, dib[head : head + 4 * colors])
        self.ops.append({"op": "DIB_BLIT", "rop": rop, "rect": [x, y, w, h], "width": width, "height": height, "rgba": rgba})

    def decoded(self, text: bytes) -> str:
        """A text in the character set of the font that holds."""
        return text.decode(ENCODINGS.get((self.state.font or {}).get("charset"), "cp1252"), "replace")

    # records

    def window(self, r: Reader, part: str) -> None:
        y, x = r.shorts(2)
        old = self.state.window
        self.state.window = (x, y, *old[2:]) if part == "origin" else (*old[:2], x, y)
        self.seen.add(part)
        if self.window_told is not None and self.state.window != self.window_told:
            self.window_told = self.state.window
            self.ops.append({"op": "SET_WINDOW", "rect": list(self.state.window)})

    def create(self, thing: dict) -> None:
        if None in self.objects:
            self.objects[self.objects.index(None)] = thing
        elif len(self.objects) < self.room:
            self.objects.append(thing)

    def pen(self, r: Reader) -> None:
        self.create({"pen": {"style": r.word(), "pen_width": r.long() & 0xFF, "color": r.long()}})

    def brush(self, r: Reader) -> None:
        self.create({"brush": {"style": r.word(), "color": r.long(), "hatch": r.word()}})

    def font(self, r: Reader) -> None:
        height, _, angle, _, weight = r.shorts(5)
        italic, _, _, charset, *_ = r.raw(8)
        name = r.data[18:50].split(b"\0")[0]
        self.create({"font": {"font_height": height, "weight": weight & 0xFFFF, "italic": italic, "angle": angle, "charset": charset, "text": name}})

    def select(self, r: Reader) -> None:
        k = r.word()
        for kind, value in ((self.objects[k] or {}) if k < len(self.objects) else {}).items():
            setattr(self.state, kind, value)

    def delete(self, r: Reader) -> None:
        k = r.word()
        if k < len(self.objects):
            self.objects[k] = None

    def save(self, r: Reader) -> None:
        if len(self.saved) < STACK:
            self.saved.append(copy(self.state))
        self.ops.append({"op": "CLIP_SAVE"})

    def restore(self, r: Reader) -> None:
        (n,) = r.shorts(1)
        k = n if n >= 0 else len(self.saved) + n
        if 0 <= k < len(self.saved):
            self.state = self.saved[k]
            del self.saved[k:]
        self.restored()

    def fill_mode(self, r: Reader) -> None:
        self.state.fill_mode = r.word() & 0xFF

    def text_color(self, r: Reader) -> None:
        self.state.text_color = r.long()

    def poly(self, r: Reader, op: str, needs: str) -> None:
        self.polygons([r.points(r.word())], op, needs)

    def polypolygon(self, r: Reader) -> None:
        sizes = [x & 0xFFFF for x in r.shorts(r.word())]
        every = r.points(sum(sizes))
        ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
        self.polygons([every[e - n : e] for n, e in zip(sizes, ends)], "POLYPOLYGON", "pbm")

    def move(self, r: Reader) -> None:
        y, x = r.shorts(2)
        self.at = (x, y)

    def line(self, r: Reader) -> None:
        y, x = r.shorts(2)
        points = [{"x": self.at[0], "y": self.at[1]}, {"x": x, "y": y}]
        self.at = (x, y)
        self.polygons([points], "POLYLINE", "p")

    def pixel(self, r: Reader) -> None:
        color = r.long()
        y, x = r.shorts(2)
        self.draw("PIXEL", points=[{"x": x, "y": y}], color=color)

    def arc(self, r: Reader, kind: int) -> None:
        y1, x1, y0, x0 = r.shorts(4)
        b = r.box()
        self.draw("ARC", "pb" if kind else "p", mode=kind, rect=list(b.values()), points=[{"x": x0, "y": y0}, {"x": x1, "y": y1}])

    def round_rectangle(self, r: Reader) -> None:
        h, w = r.shorts(2)
        self.draw("ROUNDRECT", "pb", rect=list(r.box().values()), width=w, height=h)

    def rectangle(self, r: Reader) -> None:
        self.draw("POLYGON", "pbm", points=_corners(r.box()))

    def ellipse(self, r: Reader) -> None:
        self.draw("ELLIPSE", "pb", rect=list(r.box().values()))

    def text_out(self, r: Reader) -> None:
        (n,) = r.shorts(1)
        if n < 0:
            return
        text = r.raw(n + n % 2)[:n]
        y, x = r.shorts(2)
        self.draw("TEXT", "fc", points=[{"x": x, "y": y}], text=text, said=self.decoded(text))

    def ext_text_out(self, r: Reader) -> None:
        y, x = r.shorts(2)
        n, options = r.word(), r.word()
        if options & 0x06:
            r.at += 8
        text = r.raw(n)
        self.draw("TEXT", "fc", points=[{"x": x, "y": y}], text=text, said=self.decoded(text))

    def clip(self, r: Reader) -> None:
        self.draw("CLIP_INTERSECT", sizes=[4], points=_corners(r.box()))

    def exclude(self, r: Reader) -> None:
        self.draw("CLIP_EXCLUDE_RECT", rect=list(r.box().values()))

    def blit(self, r: Reader, words: int, stretch: bool) -> None:
        """Both block transfers: with a bitmap after the fields, or, at a fixed record size, within the picture."""
        copying = len(r.data) // 2 + 3 == words
        rop = r.long()
        source = r.shorts(4 if stretch else 2)
        ys, xs = source[-2:]
        if copying:
            r.at += 2
        h, w, y, x = r.shorts(4)
        self.fix_window()
        if copying:
            if stretch:
                h, w = source[:2]
            self.draw("BIT_COPY", rop=rop, rect=[x, y, w, h], points=[{"x": xs, "y": ys}])
        else:
            self.bitmap(r.data[r.at :], rop, x, y, w, h)

    def stretch_dib(self, r: Reader) -> None:
        rop = r.long()
        *_, h, w, y, x = r.shorts(9)
        if r.at < len(r.data):
            self.fix_window()
            self.bitmap(r.data[r.at :], rop, x, y, w, h)

    def escape(self, r: Reader) -> None:
        function, n = r.word(), r.word()
        body = r.data[4 : 4 + n]
        if function == 0x1000:
            self.path, self.paths = [], []
        elif function == 0x1002:
            self.paths, self.path = (self.path if self.path is not None else self.paths), None
        elif function == 0x1001 and len(body) >= 4:
            mode = int.from_bytes(body[:2], "little")
            lists = self.path if self.path is not None else self.paths
            if mode == 0:
                self.draw("CLIP_SAVE")
            elif mode == 1:
                self.restored()
            elif mode == 2 and lists:
                self.draw("CLIP_INTERSECT", "m", sizes=[len(x) for x in lists], points=[p for x in lists for p in x])
        elif function == 0x000F:
            said = body[:32].split(b"\0")[0]
            self.skipping = said == b"Begin Skip" or (self.skipping and said != b"End Skip")


#: Record functions and what they do.
RECORDS: dict[int, Callable[[Player, Reader], None]] = {
    0x0106: Player.fill_mode,
    0x020B: lambda p, r: p.window(r, "origin"),
    0x020C: lambda p, r: p.window(r, "extent"),
    0x02FA: Player.pen,
    0x02FB: Player.font,
    0x02FC: Player.brush,
    0x012D: Player.select,
    0x01F0: Player.delete,
    0x001E: Player.save,
    0x0127: Player.restore,
    0x0209: Player.text_color,
    0x0213: Player.line,
    0x0214: Player.move,
    0x0324: lambda p, r: p.poly(r, "POLYGON", "pbm"),
    0x0325: lambda p, r: p.poly(r, "POLYLINE", "p"),
    0x0415: Player.exclude,
    0x0416: Player.clip,
    0x0418: Player.ellipse,
    0x041B: Player.rectangle,
    0x041F: Player.pixel,
    0x0521: Player.text_out,
    0x0538: Player.polypolygon,
    0x061C: Player.round_rectangle,
    0x0626: Player.escape,
    0x0817: lambda p, r: p.arc(r, 0),
    0x081A: lambda p, r: p.arc(r, 1),
    0x0830: lambda p, r: p.arc(r, 2),
    0x0940: lambda p, r: p.blit(r, 12, False),
    0x0A32: Player.ext_text_out,
    0x0B41: lambda p, r: p.blit(r, 14, True),
    0x0F43: Player.stretch_dib,
} | {k: lambda p, r: p.create({}) for k in PLACEHOLDERS}


#: The records that can hold a bitmap; what a bitmap draws depends on no other record.
BITMAPS = frozenset((0x0940, 0x0B41, 0x0F43))
RECORD = struct.Struct("<IH")


def _player(data: bytes) -> Player:
    if len(data) < 18:
        raise BadMetafile("too short for a header")
    kind, size, version, _, _, n_objects = struct.unpack_from("<HHHHHH", data)
    if kind not in (1, 2) or size != 9 or version not in (0x0100, 0x0300):
        raise BadMetafile("bad header")
    return Player([None] * n_objects, max(1, n_objects))


def _records(data: bytes) -> Iterator[tuple[int, int, int]]:
    """Function, begin and end of the parameters of each record."""
    at = 18
    while at + 6 <= len(data):
        words, function = RECORD.unpack_from(data, at)
        if words < 3 or at + 2 * words > len(data) or function == END:
            return
        yield function, at + 6, at + 2 * words
        at += 2 * words


def _play(player: Player, function: int, parameters: bytes) -> None:
    try:
        RECORDS[function](player, Reader(parameters))
    except struct.error:  # fewer parameters than the record needs
        pass


def first_bitmap(data: bytes) -> dict | None:
    """The first DIB_BLIT among the operations, from the records of bitmaps alone."""
    player = _player(data)
    for function, begin, end in _records(data):
        if function in BITMAPS:
            _play(player, function, data[begin:end])
            if player.ops[-1]["op"] == "DIB_BLIT":
                return player.ops[-1]
    return None


def operations(data: bytes) -> list[dict]:
    player = _player(data)
    for function, begin, end in _records(data):
        if function in RECORDS:
            _play(player, function, data[begin:end])
    if player.window_told is None and "extent" in player.seen:
        player.ops[0]["rect"] = [0, 0, *player.state.window[2:]]
    return [*player.ops, {"op": "END"}]


def metafile_ops(images: Iterator[dict]) -> Iterator[dict]:
    """bm_index, seq and the operations of the images that are metafiles; broken ones have none."""
    for image in images:
        if image["metafile"] is None:
            continue
        try:
            found = operations(image["metafile"])
        except BadMetafile:
            continue
        for seq, op in enumerate(found):
            yield {"bm_index": image["bm_index"], "seq": seq, **op}
