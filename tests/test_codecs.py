"""Hand-made vectors, then round trips of random bytes."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tomespark.functions import codecs as c
from tomespark.functions import macros


def h(text):
    return bytes.fromhex(text)


def test_vectors():
    assert c.lz77_expand(h("004142")) == b"AB"
    assert c.lz77_expand(h("02410000")) == b"AAAA"
    assert c.rle_expand(h("0341"), 3) == b"AAA"
    assert c.rle_expand(h("824142"), 2) == b"AB"
    assert c.rle_expand(h("0541"), 3) == bytes(3)
    assert c.phrase3_expand(h("0100"), [b"hi"], 9) == b"hi"
    assert c.phrase3_expand(h("0101"), [b"hi"], 9) == b"hi "
    assert c.phrase3_expand(h("41"), [b"hi"], 9) == b"A"
    for code, out in (("00", b"hi"), ("0341", b"A"), ("0b4142", b"AB"), ("07", b" "), ("0f", b"\0")):
        assert c.phrase4_expand(h(code), [b"hi"], 9) == out


@pytest.mark.parametrize("data,narrow,bias,value", [("0a", 1, False, 5), ("0b00", 1, False, 5), ("80", 1, True, 0), ("8a", 1, True, 5), ("76", 1, True, -5), ("fd7f", 1, True, -1), ("0080", 2, True, 0), ("0280", 2, True, 1)])
def test_variable_width_numbers(data, narrow, bias, value):
    assert c.Cursor(h(data)).varied(narrow, bias) == value


def test_hash():
    assert [c.hash43(t) for t in ("A", "a", "AB", "a1", "A-", "0", ".", "_", "")] == [17, 17, 749, 732, 17, 10, 12, 13, 0]
    assert c.hash43("contents_page_one") == np.int64(c.hash43("CONTENTS_PAGE_ONE"))


@given(st.binary(max_size=400), st.integers(1, 5))
def test_packers_and_expanders(data, times):
    data = data * times
    assert c.lz77_expand(c.lz77_pack(data)) == data
    assert c.rle_expand(c.rle_pack(data), len(data)) == data
    assert c.gfx_unpack(c.lz77_pack(c.rle_pack(data)), 3, len(data)) == data


@given(st.binary(max_size=300))
def test_any_bytes_expand(data):
    c.lz77_expand(data)
    c.rle_expand(data, 50)
    c.phrase3_expand(data, [b"a"], 60)
    c.phrase4_expand(data, [b"a"], 60)


@pytest.mark.parametrize("bpp", [1, 4, 8, 24, 32, 16])
def test_bitmaps(bpp):
    rng = random.Random(bpp)
    width, height = 5, 3
    stride = (width * bpp + 31) // 32 * 4
    pixels = rng.randbytes(stride * height)
    palette = rng.randbytes(4 * (1 << bpp)) if bpp <= 8 else None
    out = c.dib_rgba(pixels, width, height, bpp, palette)
    for y in range(height):
        row = pixels[(height - 1 - y) * stride :]
        for x in range(width):
            if bpp <= 8:
                k = row[x * bpp // 8] >> (8 - bpp - x * bpp % 8) & ((1 << bpp) - 1)
                want = (*palette[4 * k : 4 * k + 3][::-1], 255)
            elif bpp == 16:
                want = (128, 128, 128, 255)
            else:
                p = row[x * bpp // 8 :]
                want = (p[2], p[1], p[0], p[3] if bpp == 32 else 255)
            assert tuple(out[4 * (y * width + x) :][:4]) == want
    made = c.png(out, width, height)
    at = made.index(b"IDAT")
    body = zlib.decompress(made[at + 4 : at + 4 + int.from_bytes(made[at - 4 : at], "big")])
    assert b"".join(body[y * 21 + 1 : (y + 1) * 21] for y in range(height)) == out


def test_macros():
    assert macros.parse("JI(\"f\",`x'); Back()") == [("JI", ["f", "x"]), ("Back", [])]
    assert macros.parse("Contents") == []
    assert macros.parse('A(b(1,2),"c,)d") ; ;B( )C(') == [("A", ["b(1,2)", "c,)d"]), ("B", []), ("C", [])]
    assert macros.parse(None) == []


def plain_lz77(data):
    """The packer byte by byte, and one flag byte at a time."""
    out, last, i = bytearray(), {}, 0
    while i < len(data):
        flags, body = 0, bytearray()
        for bit in range(8):
            if i >= len(data):
                break
            at, n = last.get(data[i : i + 3], -1) if i + 3 <= len(data) else -1, 0
            if at >= 0 and i - at <= 4096:
                while n < 18 and i + n < len(data) and data[i + n] == data[at + n]:
                    n += 1
            if n >= 3:
                flags |= 1 << bit
                body += ((n - 3) << 12 | (i - at - 1)).to_bytes(2, "little")
            else:
                body.append(data[i])
            for k in range(i, i + max(n, 1) if n >= 3 else i + 1):
                last[data[k : k + 3]] = k
            i += n if n >= 3 else 1
        out.append(flags)
        out += body
    return bytes(out)


def test_packers_are_greedy_as_before_and_take_a_fraction_of_the_time():
    import random
    import time

    from tomespark.functions import codecs
    from tomespark.plans import file_queries

    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abc the\n\x00", k=k)) for k in (0, 1, 2, 3, 4, 7, 8, 9, 20, 500, 9000)] + [b"a" * 300, bytes(range(256)) * 40]
    for raw in texts:
        assert codecs.lz77_pack(raw) == plain_lz77(raw)
        assert codecs.lz77_expand(codecs.lz77_pack(raw)) == raw
        assert codecs.rle_expand(codecs.rle_pack(raw), len(raw)) == raw
        assert codecs.phrase3_expand(file_queries._phrase3(raw), file_queries._LOW, len(raw)) == raw
        assert codecs.phrase4_expand(file_queries._phrase4(raw), file_queries._PHRASES, len(raw)) == raw
    raw = " ".join(rng.choices(["the", "nation", "order", "wird", "and", "condition", "x"], k=30_000)).encode()

    def seconds(f):
        return min(_timed(f, time.perf_counter) for _ in range(3))

    plain = seconds(lambda: plain_lz77(raw))
    assert seconds(lambda: codecs.lz77_pack(raw)) < plain / 2
    rare = " ".join(rng.choices(["quark", "blip", "wisp", "zigzag"], k=30_000) + ["the "] * 100).encode()  # few phrases
    plain = seconds(lambda: plain_lz77(rare))
    assert seconds(lambda: file_queries._phrase3(rare)) < plain / 3
    assert seconds(lambda: file_queries._phrase4(rare)) < plain / 3


def _timed(f, clock):
    begin = clock()
    f()
    return clock() - begin


def test_a_copy_that_ends_early_counts_for_nothing():
    from tomespark.functions import codecs

    packed = plain_lz77(b"abcdefgh abcdefgh abcdefgh")
    for n in range(len(packed)):
        assert b"abcdefgh abcdefgh abcdefgh".startswith(codecs.lz77_expand(packed[:n]))
