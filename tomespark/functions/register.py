"""The library's scalar functions by name, for SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tomespark.sources.corpus import WMF_COLUMNS
from tomespark.sources.metafile import BadMetafile, operations

from . import codecs, native
from .macros import parse_macros



def _mapped(value: str, table: dict[int, str]) -> str:
    return f"case {value} " + " ".join(f"when {k} then '{v}'" for k, v in table.items()) + " end"


_FOLD = "aggregate(transform(split(upper(regexp_replace(t, '[^A-Za-z0-9._]', '')), ''), c -> cast(if(c = '', 0, instr('1234567890?._???ABCDEFGHIJKLMNOPQRSTUVWXYZ', c)) as bigint)), 0L, (h, x) -> if(x = 0, h, (h * 43 + x) & 4294967295L))"
_DECODED = "coalesce(try_url_decode(replace({0}, '+', '%2B')), {0})"
_REST = "substring(link, instr(link, '/') + 1)"
_TOPIC = r"regexp_extract(" + _REST + r", '^topic-\\s*([+-]?[0-9]+)', 1)"
_SLASHED, _IS_INDEX = "instr(link, '/') > 0", f"(instr(link, '/') > 0 and ({_REST} in ('topics', 'index') or startswith({_REST}, 'index/')))"

#: SQL functions that Spark inlines; nothing of them runs in Python.
SQL = {
    "file_key": "(name string) returns string return regexp_replace(name, '(?i)\\\\.hlp$', '')",
    "colorref_css": "(c bigint) returns string return concat('#', lpad(lower(hex(c & 255)), 2, '0'), lpad(lower(hex(c >> 8 & 255)), 2, '0'), lpad(lower(hex(c >> 16 & 255)), 2, '0'))",
    "native_to_points": "(v int, scale int) returns double return v * if(scale = 0, 1, scale) / 20",
    "himetric_to_px": "(v int) returns int return cast(greatest(1, floor(v * 96 / 2540 + 0.5)) as int)",
    "is_rtl": "(charset int, lcid int) returns boolean return charset in (177, 178) or (lcid & 255) in (1, 13, 32, 41)",
    "hash43": f"(t string) returns int return cast(if({_FOLD} > 2147483647, {_FOLD} - 4294967296, {_FOLD}) as int)",
    "charset_name": f"(charset int, lcid int) returns string return coalesce(case when charset in (0, 1) and lcid <> 0 then {_mapped('(lcid & 255)', native.LANGUAGES)} end, {_mapped('charset', native.CHARSETS)}, 'windows-1252')",
    "font_css": (
        "(face string, half_points int, weight int, italic boolean, underline boolean, strikeout boolean, small_caps boolean, family int, fg bigint) returns string return "
        f"concat('font-family: ', if(coalesce(face, '') <> '', concat('\"', face, '\", '), ''), coalesce({_mapped('family', native.FAMILIES)}, 'sans-serif'), '; font-size: ', half_points div 2, if(half_points % 2 = 1, '.5', ''), 'pt; font-weight: ', weight, ';', "
        "if(italic, ' font-style: italic;', ''), if(underline, ' text-decoration: underline;', ''), if(strikeout, ' text-decoration: line-through;', ''), if(small_caps, ' font-variant: small-caps;', ''), "
        "if((fg & 16777215) <> 0, concat(' color: rgb(', fg & 255, ',', fg >> 8 & 255, ',', fg >> 16 & 255, ');'), ''))"
    ),
    "parse_fragment": (
        "(link string) returns struct<file string, page string, topic bigint, query string> return named_struct("
        f"'file', case when coalesce(link, '') = '' then null when {_SLASHED} then {_DECODED.format('substring(link, 1, instr(link, chr(47)) - 1)')} else {_DECODED.format('link')} end, "
        f"'page', if({_IS_INDEX}, 'index', null), "
        f"'topic', cast(case when {_IS_INDEX} or not coalesce({_SLASHED}, false) then 0 when startswith({_REST}, 'topic-') then if({_TOPIC} <> '', cast({_TOPIC} as bigint), null) else 0 end as bigint), "
        f"'query', case when startswith({_REST}, 'index/') and {_SLASHED} then {_DECODED.format(f'substring({_REST}, 7)')} when {_SLASHED} then '' end)"
    ),
}


def _udf(kind: str, f: Callable):
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns)
        return pd.Series([None if any(v is None for v in r) else f(*r) for r in rows], dtype=object)

    names = list(f.__code__.co_varnames[: f.__code__.co_argcount])
    made = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c), 5: lambda a, b, c, d, e: run(a, b, c, d, e)}[len(names)]
    made.__annotations__ = {k: pd.Series for k in made.__code__.co_varnames} | {"return": pd.Series}
    return F.pandas_udf(made, kind)


def _fields(columns: str) -> str:
    """DDL columns as the fields of a struct."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", columns)


def _metafiles(data: pd.Series) -> pd.Series:
    names = [c.split(":")[0] for c in _fields(WMF_COLUMNS).split(", ")]
    rows = []
    for raw in data:
        try:
            rows.append(None if raw is None else [{n: op.get(n) for n in names} for op in operations(raw)])
        except BadMetafile:
            rows.append(None)
    return pd.Series(rows, dtype=object)


def register(spark: SparkSession) -> None:
    """The functions of SQL, parse_macros, wmf_parse, and the byte codecs."""
    for name, body in SQL.items():
        spark.sql(f"create or replace temporary function {name} {body}")
    spark.udf.register("parse_macros", parse_macros)
    spark.udf.register("wmf_parse", F.pandas_udf(_metafiles, f"array<struct<{_fields(WMF_COLUMNS)}>>"))
    for name, kind, f in (
        ("lz77_expand", "binary", lambda data: codecs.lz77_expand(data)),
        ("rle_expand", "binary", lambda data, size: codecs.rle_expand(data, int(size))),
        ("phrase3_expand", "binary", lambda data, phrases, size: codecs.phrase3_expand(data, list(phrases), int(size))),
        ("phrase4_expand", "binary", lambda data, phrases, size: codecs.phrase4_expand(data, list(phrases), int(size))),
        ("gfx_unpack", "binary", lambda data, packing, size: codecs.gfx_unpack(data, int(packing), int(size))),
        ("dib_rgba", "binary", lambda pixels, width, height, bpp, palette: codecs.dib_rgba(pixels, int(width), int(height), int(bpp), palette)),
        ("decode_codepage", "string", lambda data, encoding: data.decode(encoding, "replace")),
    ):
        spark.udf.register(name, _udf(kind, f))
