import struct

import pytest

from tomespark.sources import metafile as m


def words(*values):
    return b"".join(struct.pack("<H", v & 0xFFFF) for v in values)


def record(function, body=b""):
    body += b"\0" * (len(body) % 2)
    return struct.pack("<IH", 3 + len(body) // 2, function) + body


def picture(*records, objects=4):
    return struct.pack("<HHHIHIH", 1, 9, 0x300, 0, objects, 0, 0) + b"".join(records) + record(0)


def ops(*records, **how):
    return m.operations(picture(*records, **how))


RED, WINDOW = struct.pack("<I", 0x0000FF), (record(0x020B, words(-2, -1)), record(0x020C, words(200, 100)))
PEN = record(0x02FA, words(0, 3, 0) + RED)
BRUSH = record(0x02FC, words(0) + RED + words(7))
BOX = words(40, 30, 20, 10)  # bottom, right, top, left


def test_state_is_told_once_and_again_after_a_restore():
    got = ops(*WINDOW, PEN, BRUSH, record(0x012D, words(0)), record(0x012D, words(1)), record(0x041B, BOX), record(0x0418, BOX), record(0x001E), record(0x0127, words(-1)), record(0x0418, BOX))
    assert [o["op"] for o in got] == ["BOUNDS", "SET_PEN", "SET_BRUSH", "POLYGON", "ELLIPSE", "CLIP_SAVE", "CLIP_RESTORE", "SET_PEN", "SET_BRUSH", "ELLIPSE", "END"]
    assert got[0]["rect"] == [-1, -2, 100, 200]
    assert (got[1]["style"], got[1]["pen_width"], got[1]["color"]) == (0, 3, 0xFF)
    assert (got[2]["color"], got[2]["hatch"]) == (0xFF, 7)
    assert got[3]["points"] == [{"x": 10, "y": 20}, {"x": 30, "y": 20}, {"x": 30, "y": 40}, {"x": 10, "y": 40}]
    assert got[4]["rect"] == [10, 20, 30, 40]


def test_windows_slots_and_fill_mode():
    got = ops(record(0x020C, words(1, 1)), record(0x020C, words(20, 10)), record(0x00F7, words(1)), PEN, record(0x012D, words(1)), record(0x0106, words(2)), record(0x020B, words(0, 0)), record(0x0324, words(2, 1, 2, 3, 4)), record(0x020C, words(20, 10)), record(0x020C, words(5, 5)))
    assert [o["op"] for o in got] == ["BOUNDS", "SET_PEN", "SET_POLY_FILL_MODE", "POLYGON", "SET_WINDOW", "END"]
    assert got[0]["rect"] == [0, 0, 10, 20] and got[4]["rect"] == [0, 0, 5, 5] and got[2]["mode"] == 2
    assert ops(record(0x020C, words(20, 10)))[0]["rect"] == [0, 0, 10, 20]


def test_lines_text_pixels_and_arcs():
    font = record(0x02FB, words(-12, 0, 900, 0, 700) + bytes([1, 0, 0, 204, 0, 0, 0, 0]) + b"Arial\0".ljust(32, b"\0"))
    got = ops(record(0x0214, words(2, 1)), record(0x0213, words(4, 3)), record(0x0213, words(6, 5)), font, record(0x012D, words(0)), record(0x0209, RED), record(0x0521, words(3) + b"abc\0" + words(8, 9)), record(0x0A32, words(8, 9, 2, 2) + bytes(8) + b"hi"), record(0x041F, RED + words(1, 2)), record(0x081A, words(1, 2, 3, 4) + BOX), record(0x061C, words(5, 6) + BOX))
    assert [o["op"] for o in got[1:-1]] == ["POLYLINE", "POLYLINE", "SET_FONT", "SET_TEXT_COLOR", "TEXT", "TEXT", "PIXEL", "ARC", "ROUNDRECT"]
    assert got[2]["points"] == [{"x": 3, "y": 4}, {"x": 5, "y": 6}]
    assert (got[3]["font_height"], got[3]["angle"], got[3]["weight"], got[3]["charset"], got[3]["text"]) == (-12, 900, 700, 204, b"Arial")
    assert (got[5]["text"], got[5]["points"], got[6]["text"]) == (b"abc", [{"x": 9, "y": 8}], b"hi")
    assert (got[8]["mode"], got[8]["points"]) == (1, [{"x": 4, "y": 3}, {"x": 2, "y": 1}])
    assert (got[9]["rect"], got[9]["width"], got[9]["height"]) == ([10, 20, 30, 40], 6, 5)


def test_paths_clip_and_skips():
    escape = lambda f, body=b"": record(0x0626, words(f, len(body)) + body)
    line = record(0x0325, words(2, 1, 2, 3, 4))
    got = ops(escape(0x1001, words(0, 0)), escape(0x1000), line, escape(0x000F, b"Begin Skip"), line, escape(0x000F, b"End Skip"), record(0x0538, words(2, 1, 2, 1, 1, 2, 2, 3, 3)), escape(0x1002), escape(0x1001, words(2, 0)), escape(0x1001, words(1, 0)), record(0x0416, BOX), record(0x0415, BOX))
    assert [o["op"] for o in got[1:-1]] == ["CLIP_SAVE", "CLIP_INTERSECT", "CLIP_RESTORE", "CLIP_INTERSECT", "CLIP_EXCLUDE_RECT"]
    assert got[2]["sizes"] == [2, 1, 2] and len(got[2]["points"]) == 5 and got[4]["sizes"] == [4]


def test_blits():
    dib = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([3, 2, 1, 0])
    rop = struct.pack("<I", 0xCC0020)
    got = ops(record(0x0F43, rop + words(0, 1, 1, 0, 0, 8, 7, 6, 5) + dib), record(0x0940, rop + words(1, 2, 8, 7, 6, 5) + dib), record(0x0940, rop + words(1, 2, 0, 8, 7, 6, 5)), record(0x0B41, rop + words(4, 3, 1, 2, 0, 8, 7, 6, 5)), record(0x0B41, rop + words(4, 3, 1, 2, 8, 7, 6, 5) + dib))
    assert [o["op"] for o in got[1:-1]] == ["DIB_BLIT", "DIB_BLIT", "BIT_COPY", "BIT_COPY", "DIB_BLIT"]
    assert got[1]["rect"] == [5, 6, 7, 8] and got[1]["rgba"] == bytes([1, 2, 3, 255])
    assert got[3]["rect"] == [5, 6, 7, 8] and got[3]["points"] == [{"x": 2, "y": 1}] and got[4]["rect"] == [5, 6, 3, 4]


def test_broken_pictures():
    with pytest.raises(m.BadMetafile):
        m.operations(b"x" * 17)
    with pytest.raises(m.BadMetafile):
        m.operations(bytes(18))
    assert [o["op"] for o in ops(record(0x0324, words(9, 1)), struct.pack("<IH", 900, 0x0324))] == ["BOUNDS", "END"]
    assert [o["op"] for o in ops(record(0x012D, words(77)), record(0x01F0, words(77)), record(0x0127, words(-5)))] == ["BOUNDS", "CLIP_RESTORE", "END"]


def test_in_a_corpus_and_in_sql(spark):
    from tests.test_sources import made
    from tomespark.functions.register import register
    from tomespark.sources.corpus import Corpus

    raw = picture(*WINDOW, PEN, record(0x012D, words(0)), record(0x0213, words(4, 3)))
    wide = lambda x: struct.pack("<H", 2 * x)
    head = bytes([8, 0, 2]) + struct.pack("<HH", 300, 400) + wide(len(raw)) * 2 + wide(0)
    image = struct.pack("<HHI", 0x506C, 1, 8) + head + struct.pack("<II", len(head) + 8, 0) + raw
    files = spark.createDataFrame([("f", bytearray(made(pages=1, extra={"|bm0": image})[0]))], "file_key string, content binary")
    c = Corpus(spark, files)
    assert [r["op"] for r in c.wmf_ops.orderBy("seq").collect()] == ["BOUNDS", "SET_PEN", "POLYLINE", "END"]
    assert c.images.select("type", "width", "height").first() == (8, 300, 400)
    register(spark)
    c.images.createOrReplaceTempView("pictures")
    assert spark.sql("select size(wmf_parse(metafile)) n from pictures").first()[0] == 4
