from pyspark.sql import functions as F

from tomespark.functions.codecs import hash43
from tomespark.operators import navigation as nav


def test_macro_targets(spark):
    context = spark.createDataFrame([("f", hash43(w), o) for w, o in (("here", 10), ("there", 20), ("word0", 30), ("other", 40))], "file_key string, hash int, topic_offset long")
    keywords = spark.createDataFrame([("f", "K", "one", 0, 50), ("f", "K", "two", 0, 60), ("f", "K", "two", 1, 61), ("f", "A", "one", 0, 70)], "file_key string, tree string, keyword string, off_seq int, topic_offset long")
    want = {
        'JumpId("x","here")': ("jump", 10),
        "JI(there)": ("jump", 20),
        "PopupId(`a.hlp', `there')": ("popup", 20),
        "JumpHash(w, x, %d)" % (hash43("here") & 0xFFFFFFFF): ("jump", 10),
        "PH(f, %d)" % hash43("there"): ("popup", 20),
        "JC(f, 77)": ("jump", 77),
        "PC(0x10)": ("popup", 16),
        "JC(f, -4)": (None, None),
        "KLink(one)": ("jump", 50),
        "ALink(one)": ("jump", 70),
        "KL(two)": (None, None),
        "KL(word0)": ("jump", 30),
        "KL(none,1,other)": ("jump", 40),
        "KL(none)": (None, None),
        "JumpContents(f)": ("jump", 0),
        "Back()": (None, None),
        "JI(here);Back()": (None, None),
        "JI(nowhere)": (None, None),
        "": (None, None),
    }
    macros = spark.createDataFrame([("f", m) for m in want], "file_key string, macro string")
    got = nav.macro_targets(macros, context, keywords).collect()
    assert {r["macro"]: (r["target_kind"], r["target_offset"]) for r in got} == want


def test_routes(spark):
    pages = spark.createDataFrame([("a b", 0, 0), ("a b", 1, 100), ("a b", 2, 200)], "file_key string, page_idx int, topic_offset long")
    want = {"a%20b": ("a b", None, 0), "a%20b/topic-150": ("a b", None, 1), "a b/index/q+%C3%A9": ("a b", "index", None), "a b/topics": ("a b", "index", None), "a b/topic-x": ("a b", None, 0), "c/topic-5": ("c", None, 0), "%zz": ("%zz", None, 0)}
    links = spark.createDataFrame([(k,) for k in want], "link string")
    got = {r["link"]: r for r in nav.route(links, pages).collect()}
    assert {k: (r["file_key"], r["page"], r["page_idx"]) for k, r in got.items()} == want
    assert got["a b/index/q+%C3%A9"]["query"] == "q+é"


def test_cache_and_addresses(spark):
    cached = spark.createDataFrame([("a", "A.hlp", bytearray(b"1"), "a/topic-3"), ("b", "b.HLP", bytearray(b"2"), None)], "file_key string, name string, content binary, last_hash string")
    opened = spark.createDataFrame([("a", "a.hlp", bytearray(b"3")), ("c", "C.hlp", bytearray(b"4"))], "file_key string, name string, content binary")
    got = nav.cache_files(cached, opened)
    assert {(r["file_key"], r["name"], bytes(r["content"]), r["last_hash"]) for r in got.collect()} == {("a", "a.hlp", b"3", "a/topic-3"), ("b", "b.HLP", b"2", ""), ("c", "C.hlp", b"4", "")}
    assert [r["file_key"] for r in nav.cached_names(got).collect()] == ["a", "b", "c"]
    rows = spark.createDataFrame([("https://x",), ("HTTP://x",), ("mailto:x",)], "a string").select(nav.may_open(F.col("a")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, False]
