"""Queries over help files with everything a page can hold: layouts, fonts, links, tables, images, metafiles, macros.

Ten parts make a file, so a file's rows are bounded whatever the table's size.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Collection
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomespark.functions import codecs
from tomespark.operators import lookups, navigation
from tomespark.sources import store, writer
from tomespark.sources.corpus import Corpus
from tomespark.sources.store import StoredCorpus

from .built import built, corpus_of
from .file_queries import _phrase3, _phrase4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COLUMNS = "p_partkey, p_name, p_brand, p_type, p_size"
CHARSETS = (161, 162, 163, 177, 178, 186, 204, 222, 238, 0)
WORDS = [b"the ", b"quick", b"brown fox", b" and "]


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _words(*values: int) -> bytes:
    return struct.pack(f"<{len(values)}H", *[v & 0xFFFF for v in values])


def picture(p: int, s: int) -> bytes:
    """A metafile with a record of every kind, by a part's key and size."""
    drawn, colors, charset = _drawn(s)
    out = bytearray(drawn)
    for at in colors:
        out[at] = p % 256
    out[charset] = CHARSETS[p % 10]
    return bytes(out)


@cache
def _drawn(s: int) -> tuple[bytes, list[int], int]:
    """The picture of a size, and where the key's colour and character set stand: two pictures differ there."""
    first, second = _picture(0, s, 0), _picture(255, s, 0)
    charset = next(k for k, (a, b) in enumerate(zip(first, _picture(0, s, 1))) if a != b)
    return first, [k for k, (a, b) in enumerate(zip(first, second)) if a != b], charset


def _picture(color: int, s: int, charset: int) -> bytes:
    color, box, rop = struct.pack("<I", color), _words(40 + s, 30 + s, 20, 10), struct.pack("<I", 0xCC0020)
    dib = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([3, 2, s, 0])
    font = _words(-s, 0, 900, 0, 700) + bytes([1, 0, 0, charset, 0, 0, 0, 0]) + b"Arial\0".ljust(32, b"\0")
    escape = lambda f, body=b"": (0x0626, _words(f, len(body)) + body)
    return writer.metafile([
        (0x020B, _words(-2, -1)), (0x020C, _words(200, s)),
        (0x02FA, _words(1, 3, 0) + color), (0x02FC, _words(0) + color + _words(7)), (0x02FB, font), (0x00F7, _words(1)),
        (0x012D, _words(0)), (0x012D, _words(1)), (0x0106, _words(2)), (0x041B, box), (0x0418, box),
        (0x001E, b""), (0x0127, _words(-1)), (0x061C, _words(5, s) + box),
        (0x0214, _words(2, 1)), (0x0213, _words(4, s)), (0x0213, _words(6, 5)), (0x0325, _words(2, 1, 2, s, 4)), (0x0324, _words(2, 1, 2, 3, s)),
        (0x0538, _words(2, 1, 2, 1, 1, 2, 2, 3, s)),
        (0x012D, _words(2)), (0x0209, color), (0x0521, _words(3) + b"abc\0" + _words(8, s)), (0x0A32, _words(8, s, 2, 2) + bytes(8) + b"h\xc0"),
        (0x041F, color + _words(1, s)), (0x0817, _words(1, 2, 3, s) + box), (0x081A, _words(1, 2, 3, s) + box), (0x0830, _words(1, 2, 3, s) + box),
        escape(0x1001, _words(0, 0)), escape(0x1000), (0x0325, _words(2, 1, 2, s, 4)), escape(0x000F, b"Begin Skip"), (0x0325, _words(2, 9, 9, 9, 9)), escape(0x000F, b"End Skip"), escape(0x1002), escape(0x1001, _words(2, 0)), escape(0x1001, _words(1, 0)),
        (0x0416, box), (0x0415, box),
        (0x0F43, rop + _words(0, 1, 1, 0, 0, 8, 7, 6, s) + dib), (0x0940, rop + _words(1, 2, 8, 7, 6, s) + dib), (0x0940, rop + _words(1, 2, 0, 8, 7, 6, s)), (0x0B41, rop + _words(4, 3, 1, 2, 0, 8, 7, 6, s)), (0x0B41, rop + _words(4, 3, 1, 2, 8, 7, 6, s) + dib),
        (0x01F0, _words(1)), (0x0103, _words(1)), (0x020C, _words(5, s)), (0x041F, color + _words(2, s)),
    ])


@cache
def _phrase_tables() -> tuple[bytes, tuple[bytes, bytes]]:
    """The older table, with the control bytes that its writer needs, and the newer one: alike in all files."""
    return writer.phrase_table([*WORDS, *(bytes([k]) for k in range(16))]), writer.phrase_index(WORDS)


@lru_cache(1 << 12)
def _hash(p: int) -> int:
    return codecs.hash43(f"part_{p}")


def rich_file(parts: list[tuple]) -> bytes:
    """A file of parts (COLUMNS) in the order of their keys."""
    key = int(parts[0][0]) // 10
    newer = key % 2 == 1  # which phrase table the file has

    def title(k: int, scroll: int | None):
        p, name = parts[k][:2]
        return writer.header((b"" if p % 13 == 0 else name.encode()) + b"\0" + f"Back({p})".encode() + b"\0plain", scroll=scroll, backward=p, forward=p + 1)

    def pages() -> list:
        out = []
        for k, (p, _, brand, _, s) in enumerate(parts):
            macro = [f'JumpId("f", `part_{p + 1}\')', f"PopupId(f, part_{p})", f"KLink(`{brand}')", "JumpContents(f)", f"JC(f,{p})", "Print()", f"JumpId(f, part_{p}); Back()"][p % 7].encode()
            out.append(title(k, None))
            own = writer.layout((s, s + 1, -s, 2 * s, 3, -4), (1, p % 100), (p % 50, 100), (0x000, 0x400, 0x800)[p % 3])
            link = lambda code, to: bytes([code]) + struct.pack("<i", _hash(to))
            out.append(writer.formatted([(b"head", b"\x80" + struct.pack("<H", k)), (f"styled {s}".encode(), b"\x83"), (b"", b"\x81"), (b"x", b"\x8b"), (b"y", b"\x8c"), (b"", link(0xE3, p + 1)), (b"next", b"\x89"), (b"", link(0xE2, p)), (b"pop", b"\x89")], own))
            far = struct.pack("<BI", 4, _hash(1) & 0xFFFFFFFF) + b"other.hlp\0"
            out.append(writer.formatted([(b"", b"\xc8" + struct.pack("<H", len(macro) + 1) + macro + b"\0"), (b"do", b"\x89"), (b"", b"\xeb" + struct.pack("<H", len(far)) + far), (b"far", b"\x89"), (b"", b"\x86\x03" + writer.wide_signed(4) + struct.pack("<HH", 0, k)), (b"", b"\x82"), (b"end", b"")]))
            out.append(writer.table(p % 2, 32767, [(5, s), (7, p % 100)], [(0, f"a{p}".encode()), (1, b"b"), (0, b"c")]))
            text = f"the quick{p} brown fox and the ".encode()
            kind, _, head, whole, _ = writer.formatted([(text, b"")])
            code = (lambda b: _phrase4(b, WORDS)) if newer else (lambda b: _phrase3(b, WORDS))
            out.append(writer.record(kind, head, whole, code(whole)))
        return out

    version, flags = 21, 0
    records = pages()
    refs = writer.references(records, version, flags)
    for k in range(1, len(parts), 2):  # a reference is as long as none, so no record moves
        records[5 * k] = title(k, refs[5 * k + 2])
    topic, _ = writer.topic(records, version, flags)
    named = {"|SYSTEM": writer.system(version, flags, f"Parts {key}".encode(), [(4, b"About()\0")]), "|TOPIC": topic}
    if newer:
        named["|PhrIndex"], named["|PhrImage"] = _phrase_tables()[1]
    else:
        named["|Phrases"] = _phrase_tables()[0]
    named["|FONT"] = writer.fonts([brand.encode() for _, _, brand, _, _ in parts], [(p % 64, s, p % 6, k, p % 4096, s) for k, (p, _, _, _, s) in enumerate(parts)])
    offsets = writer.page_offsets(records, version, flags)
    context = sorted((_hash(p), o) for (p, *_), o in zip(parts, offsets))
    named["CONTEXT" if newer else "|CONTEXT"] = writer.tree([(struct.pack("<i", h), struct.pack("<ii", h, o)) for h, o in context], 64)
    for tree, column in (("K", 2), ("A", 3)):
        words: dict[bytes, list[int]] = {}
        for part, o in zip(parts, offsets):
            if tree == "K" and part[4] <= 25:  # these have no keyword, so the index has their titles
                continue
            words.setdefault(part[column].encode(), []).append(o)
        data, entries = b"", []
        for word in sorted(words):
            entries.append((word + b"\0", word + b"\0" + struct.pack("<HI", len(words[word]), len(data))))
            data += struct.pack(f"<{len(words[word])}I", *words[word])
        named |= {f"|{tree}WBTREE": writer.tree(entries, 256), f"|{tree}WDATA": data}
    for k, (p, _, _, _, s) in enumerate(parts):
        if p % 2:
            named[f"|bm{k}"] = writer.metafile_image(picture(p, s), 300 + s, 400)
        else:
            spots = writer.spots([(0xE7, 1, 2, s, 4, f"part_{p + 1}".encode()), (0xE6, 5, 6, 7, s, f"part_{p}".encode()), (0xC8, s, 9, 10, 11, f"About({p})".encode())])
            named[f"|bm{k}"] = writer.dib_image([bytes([p % 256, s, 3, 0]), bytes([6, 5, p % 251, 0])], 1, p // 2 % 4, spots)
    return writer.container(named)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return corpus_of(*parts(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str, names: dict[str, Collection[str] | None], ops: Collection[str] | None = None) -> StoredCorpus:
    """The same corpus, each file built and decoded once for all tables (with the columns and operations that are read)."""
    return store.save(corpus(spark, sf_dir), names=names, ops=ops)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(*parts(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, Callable[[list[tuple]], bytes]]:
    """The rows of files, their order, and what makes a file of them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(*COLUMNS.split(", "), F.format_string("p%06d", F.floor(F.col("p_partkey") / 10)).alias("file_key"))
    return part.select("file_key", *COLUMNS.split(", ")), "p_partkey", lambda rows: rich_file([row[1:] for row in rows])


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all files, without making the files."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.format_string("p%06d", F.floor(F.col("p_partkey") / 10)).alias("file_key")).distinct()


_P = "(select p_partkey p, case when p_partkey % 13 = 0 then '' else p_name end p_name, p_brand, p_type, p_size s, printf('p%06d', p_partkey // 10) file_key, (row_number() over (partition by p_partkey // 10 order by p_partkey) - 1)::int k from part)"


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _points(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(" ", x["x"].cast("string"), x["y"].cast("string"))), ",")


@_query(f"""
select file_key, k font_idx, p_brand face, s half_points, case when p % 2 = 1 then 700 else 400 end weight, p & 2 <> 0 italic, p & 4 <> 0 underline,
 p & 8 <> 0 strikeout, p & 32 <> 0 small_caps, (p % 6)::int family, p % 4096 fg, s::bigint bg from {_P}""")
def hlp_fonts(spark, sf_dir):
    return corpus(spark, sf_dir).fonts


@_query(f"""
select file_key, k page_idx, s space_before, s + 1 space_after, -s line_space, 2 * s indent_left, 3 as indent_right, -4 as indent_first,
 ['left', 'right', 'center'][p % 3 + 1] alignment, 1 as border, (p % 100)::int border_width, (p % 50)::varchar || ',100' tabs from {_P}""")
def hlp_paragraphs(spark, sf_dir):
    found = corpus(spark, sf_dir).paragraphs.filter("border = 1")
    return found.select("file_key", "page_idx", "space_before", "space_after", "line_space", "indent_left", "indent_right", "indent_first", "alignment", "border", "border_width", _joined("tabs").alias("tabs"))


@_query(f"""
select file_key, k page_idx, 2 as ncols, (p % 2)::int as type, case when p % 2 = 0 then 32767 else 0 end::int min_width, (s - p % 100)::int trleft, (p % 100)::int trgaph,
 '5 ' || s || ' ' || ((p % 100) // 2 + 5 + s) || ',7 ' || (p % 100) || ' ' || ((p % 100) // 2 + 12 + s + p % 100) cols from {_P}""")
def hlp_tables(spark, sf_dir):
    cells = F.array_join(F.transform("cols", lambda x: F.concat_ws(" ", x["gap"].cast("string"), x["width"].cast("string"), x["cellx"].cast("string"))), ",")
    return corpus(spark, sf_dir).table_defs.select("file_key", "page_idx", "ncols", "type", "min_width", "trleft", "trgaph", cells.alias("cols"))


_OPS = """unnest([{n: 0, op: 'PAGE_START', text: p_name}, {n: 1, op: 'MACRO', text: 'Back(' || p || ')'}, {n: 2, op: 'ANCHOR', text: ''}]
 || case when k % 2 = 1 then [{n: 3, op: 'NON_SCROLL_START', text: ''}] else [] end
 || [{n: 4, op: 'PARAGRAPH', text: ''}, {n: 5, op: 'TEXT', text: 'head'}, {n: 6, op: 'FONT_CHANGE', text: ''}, {n: 7, op: 'TEXT', text: 'styled ' || s}, {n: 8, op: 'TAB', text: ''},
 {n: 9, op: 'LINE_BREAK', text: ''}, {n: 10, op: 'TEXT', text: 'x'}, {n: 11, op: 'NBSP', text: ''}, {n: 12, op: 'TEXT', text: 'y'}, {n: 13, op: 'NBHYPHEN', text: ''},
 {n: 14, op: 'LINK_START', text: ''}, {n: 15, op: 'TEXT', text: 'next'}, {n: 16, op: 'LINK_END', text: ''}, {n: 17, op: 'LINK_START', text: ''}, {n: 18, op: 'TEXT', text: 'pop'}, {n: 19, op: 'LINK_END', text: ''}]
 || case when k % 2 = 1 then [{n: 20, op: 'NON_SCROLL_END', text: ''}] else [] end
 || [{n: 21, op: 'PARAGRAPH', text: ''}, {n: 22, op: 'LINK_START', text: ''}, {n: 23, op: 'MACRO', text: macro}, {n: 24, op: 'TEXT', text: 'do'}, {n: 25, op: 'LINK_END', text: ''},
 {n: 26, op: 'LINK_START', text: ''}, {n: 27, op: 'TEXT', text: 'far'}, {n: 28, op: 'LINK_END', text: ''}, {n: 29, op: 'IMAGE', text: ''}]
 || case when p % 2 = 0 then [{n: 30, op: 'HOTSPOT_LINK', text: ''}, {n: 31, op: 'HOTSPOT_LINK', text: ''}, {n: 32, op: 'HOTSPOT_LINK', text: ''}, {n: 33, op: 'MACRO', text: 'About(' || p || ')'}] else [] end
 || [{n: 34, op: 'PAR', text: ''}, {n: 35, op: 'TEXT', text: 'end'}, {n: 36, op: 'TABLE_START', text: ''}, {n: 37, op: 'TABLE_CELL', text: ''}, {n: 38, op: 'PARAGRAPH', text: ''}, {n: 39, op: 'TEXT', text: 'a' || p},
 {n: 40, op: 'TABLE_CELL', text: ''}, {n: 41, op: 'PARAGRAPH', text: ''}, {n: 42, op: 'TEXT', text: 'b'}, {n: 43, op: 'TABLE_ROW_END', text: ''}, {n: 44, op: 'TABLE_CELL', text: ''}, {n: 45, op: 'PARAGRAPH', text: ''},
 {n: 46, op: 'TEXT', text: 'c'}, {n: 47, op: 'TABLE_ROW_END', text: ''}, {n: 48, op: 'TABLE_END', text: ''}, {n: 49, op: 'PARAGRAPH', text: ''}, {n: 50, op: 'TEXT', text: 'the quick' || p || ' brown fox and the '}, {n: 51, op: 'PAGE_END', text: ''}], recursive := true)"""
_MACRO = """(select *, ['JumpId("f", `part_' || (p + 1) || chr(39) || ')', 'PopupId(f, part_' || p || ')', 'KLink(`' || p_brand || chr(39) || ')', 'JumpContents(f)', 'JC(f,' || p || ')', 'Print()', 'JumpId(f, part_' || p || '); Back()'][p % 7 + 1] macro from """ + _P + ")"


@_query(f"select file_key, page_idx, (row_number() over (partition by file_key, page_idx order by n) - 1)::int seq, op, text from (select file_key, k page_idx, {_OPS} from {_MACRO})")
def hlp_page_ops(spark, sf_dir):
    """All operations of a page in order; texts of the last paragraph come through a stored phrase table of either kind."""
    return corpus(spark, sf_dir).table("page_ops", ["page_idx", "seq", "op", "text"]).select("file_key", "page_idx", "seq", "op", F.coalesce("text", F.lit("")).alias("text"))


@_query(f"""
with l as (select a.*, b.k next_k, f.k first_k from {_P} a left join {_P} b on b.file_key = a.file_key and b.p = a.p + 1 left join {_P} f on f.file_key = a.file_key and f.p = 1)
select file_key, k page_idx, kind, source, n::bigint n, target_page, file from (
 select file_key, k, s, unnest([{{kind: 'jump', source: 'text', n: 1, target_page: next_k, file: null}}, {{kind: 'popup', source: 'text', n: 1, target_page: k, file: null}}, {{kind: 'macro', source: 'text', n: 1, target_page: null, file: null}}, {{kind: 'jump', source: 'text', n: 1, target_page: first_k, file: 'other.hlp'}}]
  || case when p % 2 = 0 then [{{kind: 'jump', source: 'hotspot', n: 1, target_page: next_k, file: null}}, {{kind: 'popup', source: 'hotspot', n: 1, target_page: k, file: null}}, {{kind: 'macro', source: 'hotspot', n: 1, target_page: null, file: null}}] else [] end, recursive := true) from l)""")
def hlp_link_kinds(spark, sf_dir):
    """Every link of a page by kind, with the page that it leads to; unknown contexts lead nowhere."""
    c = stored(spark, sf_dir, {"page_ops": store.LINKS, "pages": ["page_idx", "topic_offset"]}, ["LINK_START", "HOTSPOT_LINK"])
    pages = c.pages.select("file_key", F.col("topic_offset").alias("target_offset"), F.col("page_idx").alias("target_page"))
    return c.links.join(pages, ["file_key", "target_offset"], "left").select("file_key", "page_idx", "kind", "source", F.lit(1).cast("long").alias("n"), "target_page", "file")


@_query(f"""
select file_key, k bm_index, case when p % 2 = 1 then 8 else 6 end as type, case when p % 2 = 1 then 0 else p // 2 % 4 end::int packing, case when p % 2 = 1 then 300 + s else 1 end::int width, case when p % 2 = 1 then 400 else 2 end::int height,
 case when p % 2 = 0 then 24 end::int bpp, case when p % 2 = 0 then printf('%02X0506FF03%02X%02XFF', p % 251, s, p % 256) else printf('%02X0203FF', s) end rgba, true has_png, p % 2 = 1 has_metafile from {_P}""")
def hlp_images(spark, sf_dir):
    """Bitmaps of every packing, as pixels from the top down, and metafiles with the pixels of their first bitmap."""
    png = F.coalesce(F.hex(F.substring("png", 1, 4)) == "89504E47", F.lit(False))
    return corpus(spark, sf_dir).images.select("file_key", "bm_index", "type", "packing", "width", "height", "bpp", F.hex("rgba").alias("rgba"), png.alias("has_png"), F.col("metafile").isNotNull().alias("has_metafile"))


@_query(f"""
with l as (select a.*, b.k next_k from {_P} a left join {_P} b on b.file_key = a.file_key and b.p = a.p + 1)
select file_key, k bm_index, unnest([{{seq: 0, kind: 'jump', target_page: next_k, x: 1, y: 2, w: s, h: 4, macro: null}}, {{seq: 1, kind: 'popup', target_page: k, x: 5, y: 6, w: 7, h: s, macro: null}}, {{seq: 2, kind: 'macro', target_page: null, x: s, y: 9, w: 10, h: 11, macro: 'About(' || p || ')'}}], recursive := true) from l where p % 2 = 0""")
def hlp_hotspots(spark, sf_dir):
    c = stored(spark, sf_dir, {"hotspots": None, "pages": ["page_idx", "topic_offset"]})
    pages = c.pages.select("file_key", F.col("topic_offset").alias("target_offset"), F.col("page_idx").alias("target_page"))
    return c.hotspots.join(pages, ["file_key", "target_offset"], "left").select("file_key", "bm_index", "seq", "kind", "target_page", "x", "y", "w", "h", "macro")


_BOX = "'10,20,' || (30 + s) || ',' || (40 + s)"
_RING = "'10 20,' || (30 + s) || ' 20,' || (30 + s) || ' ' || (40 + s) || ',10 ' || (40 + s)"
_WMF = f"""unnest(list_transform([
 ['BOUNDS', '-1,-2,' || s || ',200', '', ''], ['SET_PEN', '', '', '1 3 ' || c], ['SET_BRUSH', '', '', '0 ' || c || ' 7'], ['SET_POLY_FILL_MODE', '', '', '2'], ['POLYGON', '', {_RING}, ''], ['ELLIPSE', {_BOX}, '', ''],
 ['CLIP_SAVE', '', '', ''], ['CLIP_RESTORE', '', '', ''], ['SET_PEN', '', '', '1 3 ' || c], ['SET_BRUSH', '', '', '0 ' || c || ' 7'], ['ROUNDRECT', {_BOX}, '', s || ' 5'],
 ['POLYLINE', '', '1 2,' || s || ' 4', ''], ['POLYLINE', '', s || ' 4,5 6', ''], ['POLYLINE', '', '1 2,' || s || ' 4', ''], ['POLYGON', '', '1 2,3 ' || s, ''], ['POLYPOLYGON', '', '1 1,2 2,3 ' || s, '1,2'],
 ['SET_FONT', '', '', 'Arial -' || s || ' 700 1 900 ' || [161, 162, 163, 177, 178, 186, 204, 222, 238, 0][p % 10 + 1]], ['SET_TEXT_COLOR', '', '', c::varchar], ['TEXT', '', s || ' 8', 'abc'], ['TEXT', '', s || ' 8', 'hÀ'], ['PIXEL', '', s || ' 1', c::varchar],
 ['ARC', {_BOX}, s || ' 3,2 1', '0'], ['ARC', {_BOX}, s || ' 3,2 1', '1'], ['ARC', {_BOX}, s || ' 3,2 1', '2'], ['CLIP_SAVE', '', '', ''], ['CLIP_INTERSECT', '', '1 2,' || s || ' 4', '2'], ['CLIP_RESTORE', '', '', ''],
 ['CLIP_INTERSECT', '', {_RING}, '4'], ['CLIP_EXCLUDE_RECT', {_BOX}, '', ''],
 ['DIB_BLIT', s || ',6,7,8', '', '13369376 1 1 ' || printf('%02X0203FF', s)], ['DIB_BLIT', s || ',6,7,8', '', '13369376 1 1 ' || printf('%02X0203FF', s)], ['BIT_COPY', s || ',6,7,8', '2 1', '13369376'], ['BIT_COPY', s || ',6,3,4', '2 1', '13369376'],
 ['DIB_BLIT', s || ',6,7,8', '', '13369376 1 1 ' || printf('%02X0203FF', s)], ['SET_WINDOW', '-1,-2,' || s || ',5', '', ''], ['PIXEL', '', s || ' 2', c::varchar], ['END', '', '', '']
 ], lambda x, i: {{seq: (i - 1)::int, op: x[1], rect: x[2], points: x[3], rest: x[4]}}), recursive := true)"""


@_query(f"select file_key, bm_index, seq, op, rect, points, rest from (select file_key, k bm_index, {_WMF} from (select *, p % 256 c from {_P}) where p % 2 = 1)")
def hlp_wmf_ops(spark, sf_dir):
    """A metafile with every kind of record as drawing operations in order."""
    text = F.decode("text", "ISO-8859-1")
    rest = F.concat_ws(" ", _joined("sizes"), text, "style", "pen_width", "mode", F.when(F.col("op") != "SET_FONT", F.col("color")), "hatch", "rop", "width", "height", F.hex("rgba"), "font_height", "weight", "italic", "angle", "charset")
    blank = lambda c: F.coalesce(c, F.lit(""))
    found = corpus(spark, sf_dir).wmf_ops
    return found.select("file_key", "bm_index", "seq", "op", blank(_joined("rect")).alias("rect"), blank(_points("points")).alias("points"), F.trim(rest).alias("rest"))


@_query(f"""
select file_key, k bm_index, unnest(['abc', 'h' || ['ΐ', 'À', 'À', chr(1456), chr(1729), 'Ą', 'А', 'ภ', 'Ŕ', 'À'][p % 10 + 1]]) said from {_P} where p % 2 = 1""")
def hlp_wmf_texts(spark, sf_dir):
    """Texts of a metafile in the character set of the font that holds there."""
    return corpus(spark, sf_dir).table("wmf_ops", ["bm_index", "said"], ["TEXT"])


@_query(f"""
with e as (select file_key, 'keyword' source, p_brand text, count(*) n_offsets, row_number() over (partition by file_key order by p_brand) seq from {_P} where s > 25 group by file_key, p_brand
 union all select file_key, 'title', p_name, 1, k from {_P} where s <= 25 and p_name <> '')
select file_key, source, text, n_offsets, (row_number() over (partition by file_key order by lower(text), source, seq))::int as position from e""")
def hlp_index_order(spark, sf_dir):
    """The index of each file in its order: keywords, and titles of pages that no keyword leads to; empty titles stay out."""
    c = stored(spark, sf_dir, {"keywords": None, "pages": ["page_idx", "topic_offset", "title"]})
    return lookups.index_order(c.index_entries(), ["file_key"]).select("file_key", "source", "text", "n_offsets", "position")


@_query(f"select file_key, n::int phrase_idx, phrase from (select distinct file_key, p // 10 f from {_P}), (values (0, 'the '), (1, 'quick'), (2, 'brown fox'), (3, ' and ')) v(n, phrase)")
def hlp_phrases(spark, sf_dir):
    """Stored phrase tables of both kinds, without the control bytes that the older ones carry for the writer."""
    return corpus(spark, sf_dir).phrases.filter("phrase_idx < 4").select("file_key", "phrase_idx", F.decode("bytes", "ISO-8859-1").alias("phrase"))


@_query(f"""
with m as (select a.*, b.k next_k, count(case when a.s > 25 then 1 end) over w n, max(case when a.s > 25 then a.k end) over w only_k from {_MACRO} a left join {_P} b on b.file_key = a.file_key and b.p = a.p + 1 window w as (partition by a.file_key, a.p_brand))
select file_key, k page_idx, macro, case when target is not null then case when p % 7 = 1 then 'popup' else 'jump' end end target_kind, target::int target_page from (
 select *, case p % 7 when 0 then next_k when 1 then k when 2 then case when n = 1 then only_k end when 3 then 0 end target from m) where p % 7 <> 4""")
def hlp_macro_targets(spark, sf_dir):
    """Where the macros of a page lead: ids by hash, keywords with one offset, contents; others nowhere."""
    c = stored(spark, sf_dir, {"page_ops": ["page_idx", "op", "text"], "context": None, "keywords": None, "pages": ["page_idx", "topic_offset"]}, ["MACRO"])
    macros = c.page_ops.filter("op = 'MACRO' and text not like 'Back(%' and text not like 'About(%' and text not like 'JC(%'").select("file_key", "page_idx", F.col("text").alias("macro"))
    found = navigation.macro_targets(macros, c.context, c.keywords)
    return c.asof_page(found.withColumn("topic_offset", F.col("target_offset")).withColumnRenamed("page_idx", "on_page")).select(
        "file_key", F.col("on_page").alias("page_idx"), "macro", "target_kind", F.when(F.col("target_offset") == 0, 0).when(F.col("target_offset").isNotNull(), F.col("page_idx")).alias("target_page")
    )


@_query(f"select file_key, p, case when p % 3 = 0 then 'index' end page, case when p % 3 = 0 then p_brand else '' end query, case when p % 3 <> 0 then k end page_idx from {_P}")
def hlp_route(spark, sf_dir):
    """Links to a topic lead to its page, links to the index keep their query."""
    c = stored(spark, sf_dir, {"context": None, "pages": ["page_idx", "topic_offset"]})
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.format_string("p%06d", F.floor(F.col("p_partkey") / 10)).alias("file_key"))
    place = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/index/"), F.replace("p_brand", F.lit("#"), F.lit("%23")))).otherwise(F.concat(F.lit("/topic-"), F.col("topic_offset").cast("string")))
    context = c.resolve_hash(part.withColumn("hash", _hash_of("p_partkey"))).select("p_partkey", F.concat("file_key", place).alias("link"))
    return navigation.route(context, c.pages).select("file_key", F.col("p_partkey").alias("p"), "page", "query", "page_idx")


def _hash_of(column: str):
    from tomespark.functions import native

    return native.signed32(native.hash43(F.concat(F.lit("part_"), F.col(column).cast("string"))))


@_query(f"select file_key, k page_idx, p backward, p + 1 forward, p_name title, k % 2 = 1 has_fixed from {_P}")
def hlp_browse(spark, sf_dir):
    return corpus(spark, sf_dir).pages.select("file_key", "page_idx", F.col("browse_bwd").alias("backward"), F.col("browse_fwd").alias("forward"), "title", F.col("scroll_ref").isNotNull().alias("has_fixed"))


@_query(f"select file_key, case when p // 10 % 3 = 0 then 'bad magic' else 'missing |SYSTEM' end message from (select distinct file_key, p // 10 * 10 p from {_P}) where p // 10 % 3 <> 2")
def hlp_errors(spark, sf_dir):
    """Files that can't be opened, and why: their first bytes or the name of their metadata are spoilt."""
    number = F.substring("file_key", 2, 6).cast("int")
    spoilt = F.when(number % 3 == 0, F.concat(F.unhex(F.lit("00")), F.substring("content", 2, 1 << 30))).when(number % 3 == 1, F.unhex(F.replace(F.hex("content"), F.hex(F.lit("|SYSTEM")), F.hex(F.lit("|SYSTEX"))))).otherwise(F.col("content"))
    return Corpus(spark, files(spark, sf_dir).withColumn("content", spoilt)).errors


@_query(f"select file_key, k page_idx, k font_idx, unnest(['styled ' || s, 'x', 'y', 'next', 'pop', 'do', 'far', 'end', 'a' || p, 'b', 'c', 'the quick' || p || ' brown fox and the ']) text from {_P}")
def hlp_spans(spark, sf_dir):
    """Texts after a change of the font, with the font that holds there."""
    return corpus(spark, sf_dir).spans.filter("font_idx is not null").select("file_key", "page_idx", "font_idx", "text")


@_query(f"select file_key, k page_idx, p_name title, 1::bigint n_links from {_P}")
def hlp_render(spark, sf_dir):
    """The page that each context hash leads to, rendered; here its title and its link to other files."""
    c = stored(spark, sf_dir, {"context": None, "pages": ["page_idx", "topic_offset"], "page_ops": ["page_idx", "op", "text", "file"]}, ["PAGE_START", "LINK_START"])
    rendered = c.render(c.resolve_hash(c.context.select("file_key", "hash")))
    return rendered.groupBy("file_key", "page_idx").agg(F.max(F.when(F.col("op") == "PAGE_START", F.col("text"))).alias("title"), F.count(F.when(F.col("file") == "other.hlp", 1)).alias("n_links"))


@_query(f"""
with f as (select file_key, count(*) pages from {_P} group by file_key)
select file_key, name, case when name = '|FONT' then (8 + 31 * pages)::bigint end n_bytes
from f, (values ('|FONT'), ('|SYSTEX')) v(name)""")
def hlp_subfile_lookup(spark, sf_dir):
    """Subfiles by name; a name that isn't there has no payload."""
    c = corpus(spark, sf_dir)
    asked = keys(spark, sf_dir).select("file_key", F.explode(F.array(F.lit("|FONT"), F.lit("|SYSTEX"))).alias("name"))
    return c.subfile(asked, F.length("payload").cast("long"), "n_bytes")


@_query(f"select distinct file_key, p // 10 % 2 = 1 bare, true as found from {_P}")
def hlp_bare_names(spark, sf_dir):
    """A directory may hold a name without its leading bar; it's found all the same."""
    c = stored(spark, sf_dir, {"subfiles": ["name", "offset", "payload"]})
    asked = keys(spark, sf_dir).withColumn("name", F.lit("|CONTEXT"))
    found = c.subfile(asked, F.when(F.col("payload").isNotNull(), True), "found").select("file_key", F.coalesce("found", F.lit(False)).alias("found"))
    bare = c.subfiles.filter("name like '%CONTEXT'").select("file_key", (~F.col("name").startswith("|")).alias("bare"))
    return bare.join(found, "file_key")


@_query(f"select file_key, k asked, unnest([{{'by': 'same', page_idx: k}}, {{'by': 'after', page_idx: k}}, {{'by': 'before', page_idx: case when k > 0 then k - 1 end}}], recursive := true) from {_P}")
def hlp_page_by_ref(spark, sf_dir):
    """The page of a record reference: its own, one inside the page, one before it."""
    c = stored(spark, sf_dir, {"pages": ["page_idx", "ref", "topic_offset"]})
    refs = c.pages.select("file_key", F.col("page_idx").alias("asked"), F.explode(F.array(*(F.struct(F.lit(by).alias("by"), (F.col("ref") + d).alias("ref")) for by, d in (("same", 0), ("after", 1), ("before", -1))))).alias("r")).select("file_key", "asked", "r.*")
    return c.page_of_ref(refs).select("file_key", "asked", "by", "page_idx")


@_query("select page_id, page_id % 3 = 0 may_open from pages")
def open_addresses(spark, sf_dir):
    """Only web addresses in lower case may be opened by a macro."""
    url = F.concat(F.element_at(F.array(F.lit("https://"), F.lit("HTTPS://"), F.lit("file://")), (F.col("page_id") % 3 + 1).cast("int")), F.lit("host/"), F.col("page_id").cast("string"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", navigation.may_open(url).alias("may_open"))


@_query("""
select 'f' || p_partkey file_key, p_brand as name, (row_number() over (partition by p_size order by lower(p_brand), 'f' || p_partkey))::int as position from part where p_partkey % 4 = 1""")
def cached_order(spark, sf_dir):
    """The cache's files by name, whatever the case, here for each part size; only those asked for."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_key"), F.col("p_brand").alias("name"), F.lit("").alias("last_hash"), "p_partkey", "p_size")
    asked = part.filter("p_partkey % 4 = 1").select("file_key")
    return lookups.ranked(navigation.read_cached(part, asked).withColumn("lower", F.lower("name")), ["p_size"], ["lower", "file_key"], "position").select("file_key", "name", "position")


@_query(f"select file_key, k page_idx, (case when p % 2 = 0 then 2 else 1 end)::bigint n_popups, p_name title from {_P}")
def hlp_popups(spark, sf_dir):
    """The pages that popup links open, by hash, with how many links open each: one in the text, and one on an image where the page has one."""
    c = stored(spark, sf_dir, {"page_ops": store.LINKS, "pages": ["page_idx", "topic_offset"]}, ["LINK_START", "HOTSPOT_LINK", "PAGE_START"])
    opened = c.render(c.links.filter("kind = 'popup'").select("file_key", F.col("target_offset").alias("topic_offset")))
    return opened.filter("op = 'PAGE_START'").groupBy("file_key", "page_idx").agg(F.count(F.lit(1)).alias("n_popups"), F.max("text").alias("title"))


@_query(f"select file_key, p_type keyword, count(*) n_offsets, min(k)::int first_page from {_P} group by all")
def hlp_associations(spark, sf_dir):
    """The other keyword tree: associative words and the first page of each."""
    c = stored(spark, sf_dir, {"keywords": None, "pages": ["page_idx", "topic_offset"]})
    words = c.keywords.filter("tree = 'A'").select("file_key", "keyword", "topic_offset")
    return c.asof_page(words).groupBy("file_key", "keyword").agg(F.count(F.lit(1)).alias("n_offsets"), F.min("page_idx").alias("first_page"))


@_query(f"""
select file_key, k page_idx, unnest([{{asked: 'exact', anchor: 1}}, {{asked: 'below', anchor: 0}}, {{asked: 'none', anchor: 0}}], recursive := true) from {_P}""")
def hlp_anchors(spark, sf_dir):
    """Paragraphs as anchors within a page: an exact offset, the last one below another, or the first one."""
    page = ["file_key", "page_idx"]
    places = stored(spark, sf_dir, {"page_ops": ["page_idx", "seq", "target"]}, ["PARAGRAPH"]).page_ops.withColumnRenamed("target", "para_offset")
    headed = places.withColumn("__first", F.first("para_offset").over(Window.partitionBy(*page).orderBy("seq")))
    second = headed.groupBy(*page).agg(F.min("__first").alias("__first"), F.min_by("para_offset", F.when(F.col("para_offset") > F.col("__first"), F.col("seq"))).alias("__second")).filter("__second is not null")
    asked = second.select("file_key", "page_idx", F.explode(F.array(*(F.struct(F.lit(name).alias("asked"), at.alias("offset")) for name, at in (("exact", F.col("__second")), ("below", F.col("__second") - 1), ("none", F.lit(-1).cast("long")))))).alias("a"), "__first", "__second").select("file_key", "page_idx", "a.*", "__first", "__second")
    found = lookups.anchor(asked, places, page, "offset", "para_offset")
    return found.select("file_key", "page_idx", "asked", F.when(F.col("anchor") == F.col("__second"), 1).when(F.col("anchor") == F.col("__first"), 0).alias("anchor"))


@_query(f"select file_key, k page_idx, case when k = 0 then 'Topic at 0' else p_name end title from {_P} where k = 0 or p_name <> ''")
def hlp_topic_titles(spark, sf_dir):
    """The picker of several offsets: the title of each one's page, or the offset itself where there is none."""
    c = stored(spark, sf_dir, {"pages": ["page_idx", "topic_offset", "title"]})
    asked = c.pages.filter("page_idx = 0 or title <> ''").select("file_key", "page_idx", F.when(F.col("page_idx") == 0, 0).otherwise(F.col("topic_offset")).cast("long").alias("topic_offset"))
    titled = c.pages.filter("page_idx > 0")
    return lookups.topic_titles(asked.withColumnRenamed("page_idx", "asked"), titled, ["file_key"]).select("file_key", F.col("asked").alias("page_idx"), "title")


@_query("""
with c as (select p_partkey, p_name, p_brand from part where p_size <= 25), o as (select p_partkey, p_type from part where p_size between 20 and 30 and p_partkey % 11 <> 3)
select 'f' || coalesce(c.p_partkey, o.p_partkey) file_key, coalesce(o.p_type, c.p_name) content, coalesce(c.p_brand, '') last_hash
from c full join o on c.p_partkey = o.p_partkey where coalesce(c.p_partkey, o.p_partkey) % 5 <> 0""")
def cache_upsert(spark, sf_dir):
    """Files opened again replace their bytes and keep the place last read; every fifth is cleared."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("file_key", F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    cached = part.filter("p_size <= 25").select("file_key", F.col("p_name").alias("name"), F.encode("p_name", "UTF-8").alias("content"), F.col("p_brand").alias("last_hash"))
    opened = part.filter("p_size between 20 and 30 and p_partkey % 11 <> 3").select("file_key", F.col("p_name").alias("name"), F.encode("p_type", "UTF-8").alias("content"))
    gone = part.filter("p_partkey % 5 = 0").select("file_key")
    return navigation.clear_cached(navigation.cache_files(cached, opened), gone).select("file_key", F.decode("content", "UTF-8").alias("content"), "last_hash")


@_query("select p_brand as name, max_by(p_name, p_partkey) as value from part where p_partkey % 7 <> 0 group by p_brand")
def settings_put(spark, sf_dir):
    """Settings by name: of several values put, the last one stays."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 7 <> 0")
    rows = part.select(F.col("p_brand").alias("name"), F.col("p_name").alias("value"), F.col("p_partkey").alias("at"))
    old, new = rows.filter("at % 2 = 0"), rows
    return navigation.settings_put(lookups.first_of(old, ["name"], ["at"]).select("name", "value"), new, "at").select("name", "value")

