import struct

import pytest

from tomespark.functions.codecs import hash43
from tomespark.sources import topics, writer
from tomespark.sources.container import BadFile, HelpFile
from tomespark.sources.corpus import Corpus

VARIANTS = [(21, 0), (21, 4), (21, 8), (15, 0)]


def made(version=21, flags=0, pages=30, extra=None):
    records = []
    for i in range(pages):
        records.append(writer.header(f"Title {i}".encode() + b"\0Back()\0plain"))
        link = b"\xe3" + struct.pack("<i", hash43(f"topic_{i - 1}"))
        records.append(writer.paragraph([(b"text %d " % i * 20, b"\x80\x01\x00"), (b"bold", link), (b"jump", b"\x89"), (b"", b"\x82"), (b"\xe9nd", b"\x8b")]))
    topic, refs = writer.topic(records, version, flags)
    files = {"|SYSTEM": writer.system(version, flags, b"My file", [(2, b"(c)\0"), (4, b"A(1)\0"), (4, b"B()\0"), (9, bytes(8) + struct.pack("<H", 0x0419)), (11, bytes([0, 2, 204]))]), "|TOPIC": topic}
    offsets = [p["topic_offset"] for p in HelpFile(writer.container(files)).pages]
    context = sorted((hash43(f"topic_{i}"), o) for i, o in enumerate(offsets))
    files["CONTEXT"] = writer.tree([(struct.pack("<i", h), struct.pack("<ii", h, o)) for h, o in context], 64)
    words = [(b"k%03d" % k, [offsets[k % pages]] * (k % 5)) for k in range(60)]
    data, entries = b"", []
    for word, own in words:
        entries.append((word + b"\0", word + b"\0" + struct.pack("<HI", len(own), len(data))))
        data += struct.pack(f"<{len(own)}I", *own)
    files |= {"|KWBTREE": writer.tree(entries, 64), "|KWDATA": data} | (extra or {})
    return writer.container(files), refs, offsets


@pytest.mark.parametrize("version,flags", VARIANTS)
def test_topics_and_indexes_come_back(version, flags):
    content, refs, offsets = made(version, flags)
    f = HelpFile(content)
    assert [r["ref"] for r in f.records] == refs
    assert [p["title"] for p in f.pages] == [f"Title {i}" for i in range(30)]
    assert all(p["macros"] == ["Back()"] for p in f.pages)
    assert offsets == sorted(offsets) and len(set(offsets)) == 30
    assert f.context_map == {hash43(f"topic_{i}"): o for i, o in enumerate(offsets)}
    assert sum(1 for _ in f.keywords()) == sum(k % 5 for k in range(60))
    ops = [o for o in topics.page_ops(f) if o["page_idx"] == 7]
    assert [o["op"] for o in ops] == ["PAGE_START", "MACRO", "ANCHOR", "PARAGRAPH", "TEXT", "FONT_CHANGE", "TEXT", "LINK_START", "TEXT", "LINK_END", "PAR", "TEXT", "NBSP", "PAGE_END"]
    assert ops[4]["text"] == "text 7 " * 20 and ops[7]["kind"] == "jump" and ops[7]["target"] == offsets[6]
    if version > 16:
        assert f.encoding == "windows-1251" and f.info["title"] == b"My file" and f.info["copyright"] == b"(c)"
        assert f.info["macros"] == [b"A(1)", b"B()"] and ops[11]["text"] == b"\xe9nd".decode("cp1251")


def test_fonts_old_and_new():
    old = struct.pack("<HHHH", 1, 2, 8, 28) + b"Courier New".ljust(20, b"\0") + bytes([1 | 4, 20, 1, 0, 0, 1, 2, 3, 4, 5, 6]) + bytes([2 | 8 | 32, 21, 2, 9, 0, 0, 0, 0, 0, 0, 0])
    f = HelpFile(made(pages=1, extra={"|FONT": old})[0])
    a, b = f.fonts()
    assert (a["face"], a["half_points"], a["weight"], a["underline"], a["italic"], a["fg"]) == ("Courier New", 20, 700, True, False, 0x030201)
    assert (b["face"], b["weight"], b["italic"], b["strikeout"], b["small_caps"], b["family"]) == ("Helv", 400, True, True, True, 2)
    assert f.scale == 10
    one = bytes([0]) + struct.pack("<h", 0) + bytes([9, 8, 7, 1, 1, 1]) + bytes(5) + struct.pack("<i", -240) + bytes(12) + struct.pack("<h", 700) + bytes(2)
    new = struct.pack("<HHHH", 1, 1, 16, 36) + bytes(8) + b"Arial".ljust(20, b"\0") + one + bytes([1, 0, 1, 0, 1, 0, 0, 0x30])
    f = HelpFile(made(pages=1, extra={"|FONT": new})[0])
    (a,) = f.fonts()
    assert (a["face"], a["half_points"], a["weight"], a["italic"], a["strikeout"], a["small_caps"], a["family"]) == ("Arial", 24, 700, True, True, True, 3)
    assert f.scale == 1


def test_phrase_compressed_text():
    import tomespark.functions.codecs as codecs

    phrases = [b"hello ", b"world"]
    table = b"".join(phrases)
    n = len(phrases)
    cuts = struct.pack(f"<{n + 1}H", *(2 * n + 2 + x for x in (0, 6, 11)))
    payload = struct.pack("<HHI", n, 0, len(table)) + cuts + codecs.lz77_pack(table)
    assert codecs.phrases3(payload, 21) == phrases
    text = b"hello world!\0"
    kind, d, head, _, _ = writer.paragraph([(b"hello world!", b"")])
    records = [writer.header(b"T"), writer.record(kind, head, text, b"\x01\x00\x01\x02!\0")]
    topic, _ = writer.topic(records)
    f = HelpFile(writer.container({"|SYSTEM": writer.system(), "|TOPIC": topic, "|Phrases": payload}))
    assert [o["text"] for o in topics.page_ops(f) if o["op"] == "TEXT"] == ["hello world!"]


def test_bad_files():
    content = made()[0]
    for bad in (b"", b"x" * 40, content[:100], b"\0" + content[1:]):
        with pytest.raises(BadFile):
            HelpFile(bad)
    for cut in range(120, len(content), 977):  # damaged files end, whatever they give
        try:
            f = HelpFile(content[:cut] + bytes(50) + content[cut + 50 :])
            list(topics.page_ops(f)), list(f.keywords()), list(f.context())
        except BadFile:
            pass


def test_images_and_hotspots():
    import tomespark.functions.codecs as codecs

    pixels = bytes(range(8)) * 2
    wide = lambda x: struct.pack("<H", 2 * x)
    packed = codecs.rle_pack(pixels)
    names = b"n1\0topic_3\0n2\0About()\0"
    spots = struct.pack("<BHI", 1, 2, 0) + bytes([0xE7, 0, 0]) + struct.pack("<HHHHI", 1, 2, 3, 4, 0) + bytes([0xC8, 0, 0]) + struct.pack("<HHHHI", 5, 6, 7, 8, 0) + names
    palette = bytes(range(64)) * 16
    head = bytes([6, 1]) + wide(0) * 2 + bytes([2, 16]) + wide(8) + wide(2) + wide(256) + wide(0) + wide(len(packed)) + wide(len(spots))
    at = len(head) + 8 + len(palette)
    picture = head + struct.pack("<II", at, at + len(packed)) + palette + packed + spots
    raw = struct.pack("<HHI", 0x506C, 1, 8) + picture
    content, _, offsets = made(extra={"|bm4": raw})
    (image,) = topics.images(HelpFile(content))
    assert (image["bm_index"], image["type"], image["width"], image["height"], image["bpp"]) == (4, 6, 8, 2, 8)
    assert image["rgba"] == codecs.dib_rgba(pixels, 8, 2, 8, palette) and image["png"].startswith(b"\x89PNG")
    a, b = topics.hotspots(HelpFile(content), 4)
    assert (a["kind"], a["target_offset"], a["x"], a["h"]) == ("jump", offsets[3], 1, 4)
    assert (b["kind"], b["macro"], b["target_offset"]) == ("macro", "About()", None)


def test_corpus_tables(spark, tmp_path):
    for k, (version, flags) in enumerate(VARIANTS):
        (tmp_path / f"File {k}.HLP").write_bytes(made(version, flags)[0])
    (tmp_path / "broken.hlp").write_bytes(b"not a help file at all")
    (tmp_path / "notes.txt").write_bytes(b"x")
    c = Corpus(spark, str(tmp_path))
    assert {r["file_key"] for r in c.files.collect()} == {"broken", *(f"File {k}" for k in range(4))}
    assert [(r["file_key"], r["message"]) for r in c.errors.collect()] == [("broken", "bad magic")]
    assert c.pages.count() == 120 and c.info.count() == 4
    assert {r["text"] for r in c.spans.filter("page_idx = 3 and font_idx = 1").collect()} >= {"bold", "jump"}
    offsets = made()[2]
    asked = spark.createDataFrame([("File 0", offsets[5] + 1), ("File 0", offsets[5] - 1), ("File 0", 0)], "file_key string, topic_offset long")
    assert sorted(r["page_idx"] for r in c.asof_page(asked, default=0).collect()) == [0, 4, 5]
    assert c.render(asked).filter("op = 'PAGE_START'").count() == 3
    hashed = spark.createDataFrame([("File 0", hash43("topic_9")), ("File 0", 77)], "file_key string, hash int")
    assert {r["hash"]: r["topic_offset"] for r in c.resolve_hash(hashed).collect()} == {hash43("topic_9"): offsets[9], 77: None}
    found = c.keyword_search(spark.createDataFrame([("File 0", "k004")], "file_key string, keyword string"))
    assert found.count() == 4
    entries = c.index_entries().filter("file_key = 'File 0'")
    assert entries.filter("source = 'keyword'").count() == 48
    assert c.index_entries("K01").filter("file_key = 'File 0'").count() == 8
    assert c.links.filter("kind = 'jump'").count() == 120


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_built_and_decoded_once_by_a_set_number_of_tasks(spark):
    from tomespark.plans import file_queries, rich_queries

    sf = "/root/testdata/sf0.001"
    for name in ("hlp_subfile_lookup", "hlp_spans", "hlp_page_ops", "hlp_paragraphs", "hlp_tables", "hlp_wmf_ops", "hlp_wmf_texts", "hlp_images"):
        plan = plan_of(rich_queries.QUERIES[name](spark, sf))
        assert plan.count("MapInArrow") == 2 and "REPARTITION_BY_NUM" in plan and "Pandas" not in plan, name
    for name in ("hlp_render", "hlp_page_by_ref", "hlp_topic_titles", "hlp_associations", "hlp_index_order", "hlp_route", "hlp_anchors"):
        assert "InArrow" not in plan_of(rich_queries.QUERIES[name](spark, sf)), name  # from a stored table
    assert "InArrow" not in plan_of(file_queries.QUERIES["hlp_links"](spark, sf))
    for name in ("rle_roundtrip", "lz77_roundtrip", "phrase3_roundtrip", "phrase4_roundtrip"):
        plan = plan_of(file_queries.QUERIES[name](spark, sf))
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan, name


def test_only_named_columns_and_operations_are_decoded(spark):
    from tomespark.plans import rich_queries

    c = rich_queries.corpus(spark, "/root/testdata/sf0.001")
    got = c.table("page_ops", ["page_idx", "seq", "op", "text"], ["TEXT", "MACRO"])
    assert got.columns == ["file_key", "page_idx", "seq", "op", "text"]
    assert sorted(got.collect()) == sorted(c.page_ops.filter("op in ('TEXT', 'MACRO')").select(got.columns).collect())


def test_texts_are_packed_and_unpacked_by_slices(spark, monkeypatch):
    from tomespark.plans import file_queries

    monkeypatch.setattr(file_queries, "SLICE_BYTES", 10)
    rows = [(k, None if k % 7 == 0 else "é" * (k % 13)) for k in range(100)]
    got = file_queries._round_trip(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), lambda b: b)
    assert sorted(map(tuple, got.collect())) == rows


def test_texts_that_are_null_empty_or_hold_zero_bytes_come_back(spark, tmp_path):
    import duckdb

    from tomespark.plans import file_queries

    odd = [None, "", "\0", "a\0b", "\0\0é\0", "x" * 999 + "\0\0y", "x" * 7999 + "\0", "\0" * 8001, "plain", "a\tb\nc\xa0d", "x" * 8000, " "]
    rows = [(k, odd[k % len(odd)], "en") for k in range(60)] + [(k, None, "en") for k in range(60, 65)] + [(k, "", "de") for k in range(80, 85)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("hlp_text", "hlp_context", "hlp_links", "hlp_pages"):  # other tables of such files don't change
        got = file_queries.QUERIES[name](spark, str(tmp_path))
        want = con.sql(file_queries.ORACLES[name])
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str), name


def rich(n=4):
    from tomespark.plans import rich_queries

    return rich_queries.rich_file([(10 + k, f"name {k}", "Brand", "type", 7) for k in range(n)])


def test_unwanted_operations_are_counted_and_not_made(monkeypatch):
    every = list(topics.page_ops(HelpFile(rich())))
    assert [r["seq"] for r in every if r["page_idx"] == 1] == list(range(sum(r["page_idx"] == 1 for r in every)))
    for op in sorted({r["op"] for r in every}):
        assert list(topics.page_ops(HelpFile(rich()), {op})) == [r for r in every if r["op"] == op], op
    file = HelpFile(rich())
    file.pages  # noqa: B018
    monkeypatch.setattr(HelpFile, "text", lambda self, raw: pytest.fail("a text was decoded") if b"quick" in raw else "")
    assert len(list(topics.page_ops(file, {"TABLE_START"}))) == 4


def test_the_first_bitmap_plays_no_other_record(monkeypatch):
    from tomespark.plans import rich_queries
    from tomespark.sources import metafile

    for p in (1, 2, 255, 1279):
        drawn = rich_queries.picture(p, 9)
        first = next(o for o in metafile.operations(drawn) if o["op"] == "DIB_BLIT")
        with monkeypatch.context() as m:
            m.setattr(metafile, "RECORDS", {k: metafile.RECORDS[k] for k in metafile.BITMAPS})
            assert metafile.first_bitmap(drawn) == first
    assert metafile.first_bitmap(drawn[:18]) is None
    with pytest.raises(metafile.BadMetafile):
        metafile.first_bitmap(drawn[:9])


def test_pictures_of_a_size_are_drawn_once(monkeypatch):
    from tomespark.plans import rich_queries

    whole = {p: rich_queries._picture(p % 256, 41, rich_queries.CHARSETS[p % 10]) for p in (1, 3, 255, 1001)}
    rich_queries._drawn.cache_clear()
    drawn, draw = [], rich_queries._picture
    monkeypatch.setattr(rich_queries, "_picture", lambda *a: drawn.append(a) or draw(*a))
    assert {p: rich_queries.picture(p, 41) for p in whole} == whole
    assert len(drawn) == 3


def test_short_bytes_without_copies_are_packed_as_they_stand(monkeypatch):
    from tomespark.functions import codecs

    cases = [bytes(range(n)) for n in (0, 1, 2, 3, 4, 8, 9, 17, 64)] + [b"aaaa", b"abcabc", b"abab"]
    assert [codecs.lz77_expand(codecs.lz77_pack(c)) for c in cases] == cases
    assert len(codecs.lz77_pack(b"abcabcabc")) < 9
    monkeypatch.setattr(codecs, "_lz77_steps", lambda data: pytest.fail("arrays for a few bytes"))
    assert codecs.lz77_pack(b"12345678x") == b"\x0012345678\x00x"


def test_anchors_of_a_page_need_no_join(spark):
    from tomespark.plans import rich_queries

    assert "Join" not in plan_of(rich_queries.QUERIES["hlp_anchors"](spark, "/root/testdata/sf0.001"))


def test_a_store_of_chosen_columns_and_operations_has_the_rows_of_plain_tables(spark):
    from tomespark.sources import store

    files = spark.createDataFrame([("a", bytearray(rich())), ("b", bytearray(b"no help"))], "file_key string, content binary")
    held = store.save(Corpus(spark, files), names={"pages": ["page_idx", "title"], "page_ops": ["page_idx", "seq", "kind"]}, ops=["LINK_START"])
    plain = Corpus(spark, files)
    assert held.pages.orderBy("page_idx").collect() == plain.table("pages", ["page_idx", "title"]).orderBy("page_idx").collect()
    assert sorted(held.page_ops.collect()) == sorted(plain.table("page_ops", ["page_idx", "seq", "kind"], ["LINK_START"]).collect())
    assert [r["file_key"] for r in held.errors.collect()] == ["b"]
    held.close()


def test_a_store_decodes_made_files_in_the_worker_that_makes_them(spark):
    from pyspark.sql import functions as F

    from tomespark.plans import file_queries, rich_queries
    from tomespark.sources import store

    for queries in (file_queries, rich_queries):
        c = queries.corpus(spark, "/root/testdata/sf0.001")
        pages = c.pages.count()
        c.files = c.files.withColumn("content", F.raise_error(F.lit("files were sent on")).cast("binary"))
        held = store.save(c, names=["pages"])
        assert held.pages.count() == pages > 0
        held.close()
