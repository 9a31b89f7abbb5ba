"""Collections of help files as DataFrames, one table at a time.

``Corpus(spark, path)`` reads files by Spark's binary reader; a table decodes
only what it needs, file by file in Arrow batches, and only columns that are
asked for leave the worker. A file that can't be read is a row in ``errors``.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomespark.functions import native
from tomespark.operators import lookups

from . import metafile, topics
from .container import NONE32, BadFile, HelpFile


def _or_none(x: int | None) -> int | None:
    return None if x == NONE32 else x


def _info(f: HelpFile) -> Iterator[dict]:
    i = f.info
    yield {k: i[k] for k in ("version", "flags", "charset", "lcid", "scale", "compressed", "tbsize", "dsize", "contents_start", "sr_color", "nsr_color")} | {"title": f.text(i["title"]), "copyright": f.text(i["copyright"])}


WMF_COLUMNS = (
    "op string, rect array<int>, points array<struct<x:int,y:int>>, sizes array<int>, style int, pen_width int, color long, hatch int, mode int, rop long, width int, height int, "
    "rgba binary, text binary, said string, font_height int, weight int, italic int, angle int, charset int"
)

#: name -> (columns beside file_key, rows of a file)
TABLES: dict[str, tuple[str, Callable[[HelpFile], Iterator[dict]]]] = {
    "info": ("title string, copyright string, version int, flags int, charset int, lcid int, scale int, compressed boolean, tbsize int, dsize int, contents_start long, sr_color int, nsr_color int", _info),
    "subfiles": ("name string, offset long, reserved_size long, payload binary", lambda f: f.subfiles()),
    "startup_macros": ("ord int, macro string", lambda f: ({"ord": k, "macro": f.text(m)} for k, m in enumerate(f.info["macros"]))),
    "fonts": ("font_idx int, face string, half_points int, weight int, italic boolean, underline boolean, strikeout boolean, small_caps boolean, family int, fg long, bg long", lambda f: f.fonts()),
    "phrases": ("phrase_idx int, bytes binary", lambda f: ({"phrase_idx": k, "bytes": b} for k, b in enumerate(f.phrases[1]))),
    "context": ("hash int, topic_offset long", lambda f: f.context()),
    "keywords": ("tree string, kw_seq int, keyword string, off_seq int, topic_offset long", lambda f: f.keywords()),
    "records": ("seq int, ref long, block_idx int, rec_type int, block_size long, text_size long, data_len long, next_ref long, topic_offset long, topic_length int", lambda f: (r | {"next_ref": _or_none(r["next_ref"])} for r in f.records)),
    "pages": ("page_idx int, ref long, topic_offset long, browse_bwd long, browse_fwd long, scroll_ref long, title string, macros array<string>", lambda f: (p | {k: _or_none(p[k]) for k in ("browse_bwd", "browse_fwd", "scroll_ref")} for p in f.pages)),
    "page_ops": (
        "page_idx int, seq int, op string, text string, target long, kind string, file string, font_idx int, flags int, space_before int, space_after int, line_space int, indent_left int, indent_right int, indent_first int, alignment string, border int, border_width int, tabs array<int>, "
        "position int, bm_index int, x int, y int, w int, h int, ncols int, table_type int, min_width int, trleft int, trgaph int, cols array<struct<gap:int,width:int,cellx:int>>",
        topics.page_ops,
    ),
    "images": ("bm_index int, type int, packing int, width int, height int, bpp int, rgba binary, png binary, metafile binary", topics.images),
    "wmf_ops": (f"bm_index int, seq int, {WMF_COLUMNS}", lambda f: metafile.metafile_ops(topics.metafiles(f))),
    "hotspots": ("bm_index int, seq int, kind string, target_offset long, x int, y int, w int, h int, macro string", lambda f: (s for n in topics.image_numbers(f) for s in topics.hotspots(f, n))),
}


Made = tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]

#: Rows that are sent together, and rows with bytes or long texts among them.
BATCH_ROWS, BATCH_WIDE = 2000, 200


def split(ddl: str) -> list[str]:
    """The columns of a list, at its outer commas."""
    out, depth = [""], 0
    for c in ddl:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


def columns_of(table: str, columns: Collection[str] | None = None) -> list[str]:
    """The columns of a table with their types, all or those named."""
    return [c for c in split(TABLES[table][0]) if columns is None or c.split(" ", 1)[0] in columns]


def rows_of(table: str, ops: Collection[str] | None = None) -> Callable[[HelpFile], Iterator[dict]]:
    """What gives the rows of a file; other operations of pages than those named are only counted, not made."""
    rows = TABLES[table][1]
    if ops is None:
        return rows
    kept = frozenset(ops)
    return (lambda f: topics.page_ops(f, kept)) if table == "page_ops" else (lambda f: (row for row in rows(f) if row["op"] in kept))


def decode(files: DataFrame, table: str, font_stride: int = 34, columns: Collection[str] | None = None, ops: Collection[str] | None = None) -> DataFrame:
    """A table of all files (file_key, content); files that can't be read have no rows.

    Only the named columns, and rows with these values of ``op``, become Arrow
    rows and leave the worker.
    """
    rows = rows_of(table, ops)
    schema = files.sparkSession.createDataFrame([], ", ".join(["file_key string", *columns_of(table, columns)])).schema
    arrow = _arrow(schema)
    names = schema.names[1:]
    most = BATCH_WIDE if any(pa.types.is_binary(f.type) for f in arrow) else BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        keys: list[str] = []

        def sent() -> pa.RecordBatch:
            values = [keys, *([row.get(n) for row in held] for n in names)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    for row in rows(HelpFile(content.as_py() or b"", font_stride)):
                        held.append(row)
                        keys.append(key)
                        if len(held) >= most:
                            yield sent()
                            held.clear()
                            keys.clear()
                except BadFile:
                    pass
        if held:
            yield sent()

    return files.select("file_key", "content").mapInArrow(run, schema)


def errors(files: DataFrame) -> DataFrame:
    """file_key and message of every file that can't be read, with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    HelpFile(content.as_py() or b"").blocks  # noqa: B018
                except BadFile as e:
                    found.append({"file_key": key, "message": str(e)})
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("file_key", pa.string()), ("message", pa.string())]))

    return files.select("file_key", "content").mapInArrow(run, "file_key string, message string")


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Corpus:
    """Help files under a path, or the rows of a table with ``file_key`` and ``content``.

    ``placed``: into how many partitions the table is hashed by ``file_key``, if it is.
    ``made``: the rows that the table is made of by mapInArrow, placed likewise, and the function that makes it.
    """

    def __init__(self, spark: SparkSession, source: str | DataFrame, font_stride: int = 34, placed: int = 0, made: Made | None = None) -> None:
        if isinstance(source, str):
            read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[hH][lL][pP]").option("recursiveFileLookup", "true").load(source)
            name = F.regexp_extract("path", r"([^/]*)$", 1)
            source = read.select(native.file_key(native.decoded(name)).alias("file_key"), F.length("content").cast("long").alias("length"), "content")
        self.spark, self.files, self.font_stride, self.placed, self.made = spark, source, font_stride, placed, made

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str, columns: Collection[str] | None = None, ops: Collection[str] | None = None) -> DataFrame:
        """A table, all of its columns or those named; of operations, those named."""
        return decode(self.files, name, self.font_stride, columns, ops)

    @property
    def errors(self) -> DataFrame:
        return errors(self.files)

    @property
    def spans(self) -> DataFrame:
        """Texts with the font that holds at them, and the page's text position by seq."""
        from pyspark.sql import Window

        along = Window.partitionBy("file_key", "page_idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        ops = self.table("page_ops", ["page_idx", "seq", "op", "text", "font_idx"], ["TEXT", "FONT_CHANGE", "PARAGRAPH", "PAR"])
        held = ops.withColumn("font_idx", F.last("font_idx", ignorenulls=True).over(along)).withColumn("para_seq", F.sum(F.when(F.col("op").isin("PARAGRAPH", "PAR"), 1).otherwise(0)).over(along))
        return held.filter("op = 'TEXT'").select("file_key", "page_idx", "seq", "para_seq", "font_idx", "text")

    @property
    def paragraphs(self) -> DataFrame:
        own = ["flags", "space_before", "space_after", "line_space", "indent_left", "indent_right", "indent_first", "alignment", "border", "border_width", "tabs"]
        return self.table("page_ops", ["page_idx", "seq", "target", *own], ["PARAGRAPH"]).select("file_key", "page_idx", "seq", F.col("target").alias("para_offset"), *own)

    @property
    def links(self) -> DataFrame:
        linked = self.table("page_ops", ["page_idx", "seq", "op", "kind", "target", "file", "text"], ["LINK_START", "HOTSPOT_LINK"])
        return linked.select("file_key", "page_idx", "seq", "kind", F.when(F.col("kind") != "macro", F.col("target")).alias("target_offset"), "file", F.when(F.col("op") == "LINK_START", "text").otherwise("hotspot").alias("source"))

    @property
    def table_defs(self) -> DataFrame:
        columns = ["page_idx", "seq", "ncols", "table_type", "min_width", "trleft", "trgaph", "cols"]
        return self.table("page_ops", columns, ["TABLE_START"]).select("file_key", "page_idx", "seq", "ncols", F.col("table_type").alias("type"), "min_width", "trleft", "trgaph", "cols")

    def subfile(self, asked: DataFrame, value: Column | None = None, out: str = "payload") -> DataFrame:
        """``asked`` (file_key, name) with the payload of that subfile; where there is none, of the name without its leading bar.

        ``value``: what of the payload is asked for, so that only that moves.
        Subfiles are decoded once: one without a bar stands under both names, behind the exact one.
        """
        held = self.table("subfiles", ["name", "offset", "payload"]).select("file_key", "name", "offset", (F.col("payload") if value is None else value).alias("__value"))
        bare = F.struct(F.concat(F.lit("|"), "name").alias("name"), F.lit(1).alias("rank"))
        exact = F.struct(F.col("name"), F.lit(0).alias("rank"))
        both = held.filter("__value is not null").select("file_key", F.explode(F.when(F.col("name").startswith("|"), F.array(exact)).otherwise(F.array(exact, bare))).alias("__n"), "offset", "__value")
        first = both.groupBy("file_key", F.col("__n.name").alias("name")).agg(F.min_by("__value", F.struct("__n.rank", "offset")).alias(out))
        return asked.join(first, ["file_key", "name"], "left").select(*asked.columns, out)

    def page_of_ref(self, asked: DataFrame, at: str = "ref") -> DataFrame:
        """page_idx and topic_offset of the page whose record is the last one at or below each reference."""
        found = lookups.floor_lookup(asked, self.pages, ["file_key"], at, "ref", [F.col("page_idx")], F.struct("page_idx", "topic_offset"), "__page")
        return found.select(*asked.columns, "__page.page_idx", "__page.topic_offset")

    def resolve_hash(self, asked: DataFrame, keep_raw: bool = False) -> DataFrame:
        first = lookups.first_of(self.context, ["file_key", "hash"], ["topic_offset"])
        return lookups.resolve_hash(asked, first, ["file_key"], keep_raw)

    def asof_page(self, asked: DataFrame, at: str = "topic_offset", default: int | None = None) -> DataFrame:
        """page_idx of the last page at or below each offset; ``default`` where there is none."""
        found = lookups.floor_lookup(asked, self.pages, ["file_key"], at, "topic_offset", [F.col("page_idx")], F.col("page_idx"), "page_idx")
        return found if default is None else found.withColumn("page_idx", F.coalesce("page_idx", F.lit(default)))

    def render(self, asked: DataFrame, at: str = "topic_offset") -> DataFrame:
        """The operations of the page that each offset falls on."""
        placed = self.asof_page(asked, at, default=0).withColumn("page_idx", F.when(F.col(at) == 0, 0).otherwise(F.col("page_idx")))
        return placed.join(self.page_ops, ["file_key", "page_idx"])

    def keyword_search(self, asked: DataFrame, tree: str = "K", max_offsets: int = 64) -> DataFrame:
        return asked.join(self.keywords.filter((F.col("tree") == tree) & (F.col("off_seq") < max_offsets)), ["file_key", "keyword"])

    def index_entries(self, query: str = "", max_offsets: int = 64) -> DataFrame:
        entries = lookups.index_entries(self.keywords.filter("tree = 'K'"), self.pages.select("file_key", "page_idx", "topic_offset", "title"), ["file_key"], max_offsets)
        return lookups.index_filter(entries, query) if query else entries

    def unpersist(self) -> None:
        self.files.unpersist()
