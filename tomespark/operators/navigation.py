"""Targets of macros and links, and the table of cached files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomespark.functions import native
from tomespark.functions.macros import parse_macros

from . import lookups

#: Macro names and abbreviations that have a target, with its kind and how it's found.
TARGETS = {
    "jumphash": ("jump", "hash"), "jh": ("jump", "hash"), "popuphash": ("popup", "hash"), "ph": ("popup", "hash"),
    "jumpcontext": ("jump", "number"), "jc": ("jump", "number"), "popupcontext": ("popup", "number"), "pc": ("popup", "number"),
    "jumpid": ("jump", "id"), "ji": ("jump", "id"), "popupid": ("popup", "id"), "pi": ("popup", "id"),
    "alink": ("jump", "A"), "al": ("jump", "A"), "klink": ("jump", "K"), "kl": ("jump", "K"), "jumpcontents": ("jump", "contents"),
}


def _number(text: Column) -> Column:
    """The whole number that a text starts with, decimal or hexadecimal."""
    hexadecimal = F.regexp_extract(text, r"^\s*[+-]?0[xX]([0-9A-Fa-f]+)", 1)
    decimal = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    sign = F.when(text.rlike(r"^\s*-"), -1).otherwise(1)
    return F.when(hexadecimal != "", sign * F.conv(hexadecimal, 16, 10).cast("long")).when(decimal != "", decimal.cast("long"))


def macro_targets(macros: DataFrame, context: DataFrame, keywords: DataFrame, macro_col: str = "macro") -> DataFrame:
    """``macros`` with target_kind and target_offset: of macros that are one call with a target that is found, else null.

    macros: file_key, ``macro_col``; context: file_key, hash, topic_offset;
    keywords: file_key, tree, keyword, off_seq, topic_offset. A keyword with one
    offset leads there, one without any to the context of its own name or of
    its third argument, one with several nowhere.
    """
    calls = macros.withColumn("__calls", parse_macros(F.col(macro_col)))
    call = F.when(F.size("__calls") == 1, F.element_at("__calls", 1))
    name = F.lower(call["name"])
    args = call["args"]
    n = F.size(args)
    arg = lambda k: F.when(n > k, F.nullif(F.get(args, F.lit(k)), F.lit("")))
    kind = how = F.lit(None).cast("string")
    for macro, (k, h) in TARGETS.items():
        kind, how = F.when(name == macro, k).otherwise(kind), F.when(name == macro, h).otherwise(how)
    is_popup = kind == "popup"
    last = F.when(~is_popup & (n >= 3), F.get(args, F.lit(2))).otherwise(F.coalesce(arg(1), arg(0)))
    asked = calls.select(*macros.columns, kind.alias("__kind"), how.alias("__how"), _number(last).alias("__number"), F.when(n >= 2, F.get(args, F.lit(1))).otherwise(arg(0)).alias("__id"), arg(0).alias("__word"), arg(2).alias("__fallback"))
    unsigned = F.when(F.col("__how") == "hash", F.pmod(F.coalesce("__number", F.lit(-1)), F.lit(4294967296))).when(F.col("__how") == "id", native.hash43(F.col("__id"))).when(F.col("__how").isin("K", "A"), native.hash43(F.col("__word")))
    asked = asked.withColumn("__h1", native.signed32(unsigned)).withColumn("__h2", native.signed32(native.hash43(F.col("__fallback"))))
    known = lookups.first_of(context.select("file_key", "hash", "topic_offset"), ["file_key", "hash"], ["topic_offset"])
    for h in ("1", "2"):
        found = known.select("file_key", F.col("hash").alias(f"__h{h}"), F.col("topic_offset").alias(f"__o{h}"))
        asked = asked.join(found, ["file_key", f"__h{h}"], "left")
    words = keywords.groupBy("file_key", F.col("tree").alias("__how"), F.col("keyword").alias("__word")).agg(F.count(F.lit(1)).alias("__n"), F.min("topic_offset").alias("__only"))
    asked = asked.join(words, ["file_key", "__how", "__word"], "left").withColumn("__n", F.coalesce("__n", F.lit(0).cast("long")))
    offset = (
        F.when(F.col("__how").isin("hash", "id"), F.col("__o1"))
        .when(F.col("__how") == "number", F.when(F.col("__number") >= 0, F.col("__number")))
        .when(F.col("__how") == "contents", F.lit(0).cast("long"))
        .when(F.col("__word").isNotNull(), lookups.keyword_target(asked, "__n", "__only", "__o1", "__o2"))
    )
    return asked.withColumn("target_offset", offset).select(*macros.columns, F.when(F.col("target_offset").isNotNull(), F.col("__kind")).alias("target_kind"), "target_offset")


def may_open(target: Column) -> Column:
    """Whether a macro may open this outside address: web addresses only, in lower case."""
    return target.rlike("^https?://")


def route(links: DataFrame, pages: DataFrame, link_col: str = "link") -> DataFrame:
    """``links`` with file_key, page ('index' or null), query and page_idx: the page at or below the link's topic, else the first."""
    parsed = links.withColumn("__f", native.fragment(F.col(link_col)))
    asked = parsed.select(*links.columns, F.col("__f.file").alias("file_key"), F.col("__f.page").alias("page"), F.col("__f.query").alias("query"), F.coalesce("__f.topic", F.lit(0)).cast("long").alias("__topic"))
    found = lookups.floor_lookup(asked, pages, ["file_key"], "__topic", "topic_offset", [F.col("page_idx")], F.col("page_idx"), "page_idx")
    first = F.when(F.col("__topic") == 0, 0).otherwise(F.coalesce("page_idx", F.lit(0)))
    return found.withColumn("page_idx", F.when(F.col("page").isNull(), first).cast("int")).drop("__topic")


def cache_files(cached: DataFrame, opened: DataFrame) -> DataFrame:
    """The cache after files were opened: new bytes, and the place last read kept. file_key, name, content, last_hash."""
    new = opened.select("file_key", F.col("name").alias("__name"), F.col("content").alias("__content"), F.lit(True).alias("__new"))
    both = cached.join(new, "file_key", "full_outer")
    pick = lambda a, b: F.when(F.col("__new"), F.col(a)).otherwise(F.col(b))
    return both.select("file_key", pick("__name", "name").alias("name"), pick("__content", "content").alias("content"), F.coalesce("last_hash", F.lit("")).alias("last_hash"))


def cached_names(cached: DataFrame) -> DataFrame:
    return cached.select("file_key", "name", "last_hash").orderBy(F.lower("name"), "file_key")


def read_cached(cached: DataFrame, asked: DataFrame) -> DataFrame:
    """The cached files whose keys are asked for."""
    return cached.join(asked.select("file_key").distinct(), "file_key", "left_semi")


def clear_cached(cached: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The cache without some files, or without any."""
    return cached.limit(0) if gone is None else cached.join(gone.select("file_key").distinct(), "file_key", "left_anti")


def settings_put(settings: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Settings (name, value) after new ones were put, in the order of ``at``: the last one of a name stays."""
    last = new.groupBy("name").agg(F.max_by("value", at).alias("__value"))
    return settings.join(last, "name", "full_outer").select("name", F.coalesce("__value", "value").alias("value"))


def settings_get(settings: DataFrame, asked: DataFrame, default: str | None = None) -> DataFrame:
    """``asked`` (name) with value, or the default."""
    return asked.join(settings.select("name", "value"), "name", "left").withColumn("value", F.coalesce("value", F.lit(default)))
