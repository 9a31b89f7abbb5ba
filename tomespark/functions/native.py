"""Scalar functions of help files as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows charset codes, and primary language ids, with their text encodings.
CHARSETS = {0: "windows-1252", 1: "windows-1252", 128: "shift_jis", 129: "euc-kr", 134: "gb2312", 136: "big5", 161: "windows-1253", 162: "windows-1254", 177: "windows-1255", 178: "windows-1256", 186: "windows-1257", 204: "windows-1251", 238: "windows-1250"}
LANGUAGES = {0x01: "windows-1256", 0x05: "windows-1250", 0x08: "windows-1253", 0x0D: "windows-1255", 0x11: "shift_jis", 0x12: "euc-kr", 0x19: "windows-1251", 0x1A: "windows-1250", 0x1E: "windows-874", 0x1F: "windows-1254", 0x24: "windows-1250", 0x2A: "windows-1258", 0x42: "windows-1257"}
RTL_CHARSETS, RTL_LANGUAGES = (177, 178), (0x01, 0x0D, 0x20, 0x29)
#: Generic font families by code.
FAMILIES = {1: "monospace", 2: "serif", 3: "sans-serif", 4: "cursive", 5: "fantasy"}


def hash43(text: Column) -> Column:
    """The context hash of a string as an unsigned 32-bit number in a BIGINT.

    Letters count 17 to 42 whatever their case, 1 to 9 as they are, 0 as 10, a
    dot 12 and an underscore 13; other characters don't change the hash.
    """
    symbols = "123456789" + "0" + "?" + "." + "_" + "???" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"  # the place is the code
    clean = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._]", ""), "\\?", "")
    codes = F.transform(F.split(F.upper(clean), ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(symbols), c)).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: F.when(x == 0, h).otherwise((h * 43 + x).bitwiseAND(F.lit(4294967295))))
    return F.when(text.isNotNull(), folded)


def signed32(unsigned: Column) -> Column:
    """An unsigned 32-bit number as the signed one with the same bits."""
    return F.when(unsigned > 2147483647, unsigned - 4294967296).otherwise(unsigned).cast("int")


def file_key(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.hlp$", "")


def decoded(segment: Column) -> Column:
    """Percent-decoding that leaves a plus sign alone, and a bad escape as it is."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def fragment(hash_text: Column) -> Column:
    """file, page, topic and query of a link of the form file, file/topics, file/index[/query] or file/topic-N."""
    slash = F.instr(hash_text, "/")
    rest = F.when(slash > 0, F.substring(hash_text, slash + 1, F.length(hash_text)))
    topic = F.regexp_extract(rest, r"^topic-\s*([+-]?[0-9]+)", 1)
    is_index = rest.isin("topics", "index") | rest.startswith("index/")
    return F.struct(
        F.when(F.coalesce(hash_text, F.lit("")) == "", None).when(slash > 0, decoded(F.substring(hash_text, F.lit(1), slash - 1))).otherwise(decoded(hash_text)).alias("file"),
        F.when(is_index, "index").alias("page"),
        F.when(is_index | slash.isNull() | (slash == 0), 0).when(rest.startswith("topic-"), F.when(topic != "", topic.cast("long"))).otherwise(0).cast("long").alias("topic"),
        F.when(rest.startswith("index/"), decoded(F.substring(rest, 7, 1_000_000))).when(slash > 0, "").alias("query"),
    )


def points(native: Column, scale: Column) -> Column:
    """Native units in points; a scale of 0 counts as 1."""
    return native * F.when(F.coalesce(scale, F.lit(0)) == 0, 1).otherwise(scale) / 20


def himetric_pixels(units: Column) -> Column:
    """Metafile units (hundredths of a millimetre) in pixels at 96 dpi, one at least."""
    return F.greatest(F.lit(1), F.floor(units * 96 / 2540 + 0.5)).cast("int")


def colorref_css(color: Column) -> Column:
    """0x00BBGGRR as #rrggbb."""
    part = lambda shift: F.lpad(F.lower(F.hex(F.shiftright(color, shift).bitwiseAND(F.lit(255)))), 2, "0")
    return F.concat(F.lit("#"), part(0), part(8), part(16))


def font_css(font: Column) -> Column:
    """The style of a font row: face, half_points, weight, italic, underline, strikeout, small_caps, family, fg (a colour reference)."""
    generic = F.lit("sans-serif")
    for code, name in FAMILIES.items():
        generic = F.when(font["family"] == code, name).otherwise(generic)
    face = F.when(F.coalesce(font["face"], F.lit("")) != "", F.concat(F.lit('"'), font["face"], F.lit('", '), generic)).otherwise(generic)
    half = font["half_points"]
    size = F.concat(F.floor(half / 2).cast("string"), F.when(half % 2 == 1, ".5").otherwise(""))
    fg = font["fg"]
    byte = lambda shift: F.shiftright(fg, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.concat(
        F.lit("font-family: "), face, F.lit("; font-size: "), size, F.lit("pt; font-weight: "), font["weight"].cast("string"), F.lit(";"),
        F.when(font["italic"], " font-style: italic;").otherwise(""),
        F.when(font["underline"], " text-decoration: underline;").otherwise(""),
        F.when(font["strikeout"], " text-decoration: line-through;").otherwise(""),
        F.when(font["small_caps"], " font-variant: small-caps;").otherwise(""),
        F.when(fg.bitwiseAND(F.lit(0xFFFFFF)) != 0, F.concat(F.lit(" color: rgb("), byte(0), F.lit(","), byte(8), F.lit(","), byte(16), F.lit(");"))).otherwise(""),
    )


def _mapped(value: Column, table: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for code, name in table.items():
        out = F.when(value == code, name).otherwise(out)
    return out


def charset_name(charset: Column, lcid: Column) -> Column:
    """The text encoding: by language where the charset is a default one and a language is set, else by charset."""
    by_language = F.when(charset.isin(0, 1) & (lcid != 0), _mapped(lcid.bitwiseAND(F.lit(255)), LANGUAGES))
    return F.coalesce(by_language, _mapped(charset, CHARSETS), F.lit("windows-1252"))


def is_rtl(charset: Column, lcid: Column) -> Column:
    return charset.isin(*RTL_CHARSETS) | lcid.bitwiseAND(F.lit(255)).isin(*RTL_LANGUAGES)


def block_address(ref: Column, version: Column, dsize: Column) -> Column:
    """(block, offset) of a topic reference: by division up to version 16, later by bits of ref - 12."""
    at = ref - 12
    return F.struct(
        F.when(version <= 16, F.floor(at / dsize)).otherwise(F.shiftright(at, 14)).cast("long").alias("block"),
        F.when(version <= 16, at % dsize).otherwise(at.bitwiseAND(F.lit(0x3FFF))).cast("long").alias("offset"),
    )


def ternary(code: Column, pattern: Column, source: Column, destination: Column) -> Column:
    """A ternary raster code (0 to 255) on packed pixels of 32 bits, held as numbers from 0.

    Bit 4 p + 2 s + d of the code is the result where the three bits are p, s and
    d; so the result joins the combinations whose bit is set, for all bits of a
    pixel at once.
    """
    whole = F.lit(4294967295)
    wide = code.cast("long")
    out = F.lit(0).cast("long")
    for k in range(8):
        chosen = F.shiftright(wide, k).bitwiseAND(F.lit(1)) * whole
        for bit, x in ((4, pattern), (2, source), (1, destination)):
            chosen = chosen.bitwiseAND(x if k & bit else x.bitwiseXOR(whole))
        out = out.bitwiseOR(chosen)
    return out
