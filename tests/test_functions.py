from tests.test_sources import made
from tomespark.functions.register import register
from tomespark.streaming.ingest import stream_corpus


def test_sql_functions(spark):
    register(spark)
    row = spark.sql(
        """select hash43('AB') a, file_key('Calc.HLP') b, colorref_css(66051) c, native_to_points(30, 10) d, himetric_to_px(304) e, is_rtl(177, 0) f,
        lz77_expand(X'02410000') g, rle_expand(X'0341', 3) h, phrase3_expand(X'0101', array(X'6869'), 9) i, phrase4_expand(X'0B4142', array(X'6869'), 9) j,
        gfx_unpack(X'0341', 1, 3) k, decode_codepage(X'E9', 'cp1252') l, size(parse_macros('A(1);B(2)')) m, hash43(null) n, length(dib_rgba(X'00000000', 1, 1, 24, X'')) o"""
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (749, "Calc", "#030201", 15.0, 11, True)
    assert (bytes(row.g), bytes(row.h), bytes(row.i), bytes(row.j), bytes(row.k)) == (b"AAAA", b"AAA", b"hi ", b"AB", b"AAA")
    assert (row.l, row.m, row.n, row.o) == ("é", 2, None, 4)


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.hlp").write_bytes(made(pages=3)[0])

    def run():
        pages = stream_corpus(spark, str(folder)).pages.select("file_key", "title")
        pages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 3
    (folder / "two.HLP").write_bytes(made(pages=4)[0])
    assert run() == 7


def test_inlined_sql_functions_equal_the_columns(spark):
    from pyspark.sql import functions as F

    from tomespark.functions import codecs, native
    from tomespark.functions.register import register

    register(spark)
    links = ["", None, "my%20file", "f/topics", "f/index", "f/index/a+b%20c", "f/topic-12", "f/topic-x", "f/topic- -7y", "bad%zz/other", "/topic-3", "a/b/c"]
    rows = spark.createDataFrame([(x,) for x in links], "link string")
    for name in ("file", "page", "topic", "query"):
        got = rows.select(F.expr(f"parse_fragment(link).{name}").alias("a"), native.fragment(F.col("link"))[name].alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got], name
    texts = spark.createDataFrame([(x,) for x in ("Topic_1.0", "", "é-9Z", None, "zzzzzzzzzz")], "t string")
    assert [r["h"] for r in texts.selectExpr("hash43(t) h").collect()] == [None if x is None else codecs.hash43(x) for x in ("Topic_1.0", "", "é-9Z", None, "zzzzzzzzzz")]
    sets = spark.range(0, 300).selectExpr("cast(id as int) charset", "cast(id % 70 as int) lcid")
    assert sets.filter(F.expr("charset_name(charset, lcid)") != native.charset_name(F.col("charset"), F.col("lcid"))).count() == 0
    fonts = spark.range(0, 200).selectExpr("if(id % 5 = 0, null, concat('F', id)) face", "cast(id as int) half_points", "400 weight", "id % 2 = 0 italic", "id % 3 = 0 underline", "id % 5 = 0 strikeout", "id % 7 = 0 small_caps", "cast(id % 8 as int) family", "id * 70000 fg")
    css = F.expr("font_css(face, half_points, weight, italic, underline, strikeout, small_caps, family, fg)")
    assert fonts.filter(css != native.font_css(F.struct("*"))).count() == 0 and fonts.filter(css.isNull()).count() == 0
