"""Queries that run the library's operators over the standard tables, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomespark.functions import native as fn
from tomespark.operators import lookups as ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_INDEX = """
with topics as (select p_partkey page_idx, p_partkey - p_partkey % 2 topic_offset, p_name title from part),
kw as (select text, off, rn from (select p_brand text, p_partkey - p_partkey % 2 off,
       row_number() over (partition by p_brand order by p_partkey) rn from part where p_size <= 5) x where rn <= 64),
k as (select text, count(*) n_offsets, arg_min(off, rn) first_offset from kw group by text),
t as (select title text, topic_offset, row_number() over (partition by topic_offset order by page_idx) rn
      from topics where title <> '' and not exists (select 1 from kw where kw.off = topics.topic_offset))
select 'keyword' source, text, lower(text) sort_key, n_offsets, first_offset from k
union all select 'title', text, lower(text), 1, topic_offset from t where rn = 1"""


def _entries(t) -> DataFrame:
    part = t("part").withColumn("off", F.col("p_partkey") - F.col("p_partkey") % 2)
    place = Window.partitionBy("p_brand").orderBy("p_partkey")
    keywords = part.filter("p_size <= 5").select(F.lit(1).alias("file"), F.col("p_brand").alias("keyword"), F.lit(0).alias("kw_seq"), (F.row_number().over(place) - 1).alias("off_seq"), F.col("off").alias("topic_offset"))
    topics = part.select(F.lit(1).alias("file"), F.col("p_partkey").alias("page_idx"), F.col("off").alias("topic_offset"), F.col("p_name").alias("title"))
    return ops.index_entries(keywords, topics, ["file"]).select("source", "text", "sort_key", "n_offsets", "first_offset")


@_query(_INDEX)
def index_page(t):
    return _entries(t)


@_query(f"select * from ({_INDEX}) where contains(sort_key, 'brand#1') or contains(sort_key, 'part 1')".replace(" or contains(sort_key, 'part 1')", ""))
def index_filter(t):
    return ops.index_filter(_entries(t), "Brand#1")


_HASH = """list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c:
  (case when regexp_matches(c, '^[A-Za-z]$') then ascii(upper(c)) - 65 + 17 when regexp_matches(c, '^[1-9]$') then ascii(c) - 48
        when c = '0' then 10 when c = '.' then 12 when c = '_' then 13 else 0 end)::bigint)),
  lambda h, x: case when x = 0 then h else (h * 43 + x) % 4294967296 end)"""


@_query(f"select c_custkey, {_HASH.format('c_name')} hash from customer")
def hash43(t):
    return t("customer").select("c_custkey", fn.hash43(F.col("c_name")).alias("hash"))


@_query(f"""
with c as (select {_HASH.format('p_brand')} hash, min(p_partkey) topic_offset from part where p_size <= 25 group by 1)
select p_partkey, h.hash, coalesce(topic_offset, h.hash) topic_offset
from (select p_partkey, {_HASH.format('p_brand')} hash from part) h left join c on c.hash = h.hash""")
def resolve_hash(t):
    hashed = t("part").select("p_partkey", "p_size", fn.hash43(F.col("p_brand")).alias("hash"))
    context = hashed.filter("p_size <= 25").groupBy("hash").agg(F.min("p_partkey").alias("topic_offset"))
    return ops.resolve_hash(hashed.select("p_partkey", "hash"), context, [], keep_raw=True)


_VIEWS = "(select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 page_idx from events where event_type = 'view')"


@_query(f"""
select p.event_id, p.user_id, v.event_id page_event, coalesce(v.page_idx, 0) page_idx from (select * from events where event_type = 'purchase') p
left join lateral (select event_id, page_idx from {_VIEWS} w where w.user_id = p.user_id and w.ts <= p.ts order by ts desc, event_id desc limit 1) v on true""")
def asof_page(t):
    events = t("events")
    n = Window.partitionBy("user_id").orderBy("ts", "event_id")
    views = events.filter("event_type = 'view'").withColumn("page_idx", F.row_number().over(n) - 1)
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    found = ops.floor_lookup(bought, views, ["user_id"], "ts", "ts", [F.col("event_id")], F.struct("event_id", "page_idx"), "page")
    return found.select("event_id", "user_id", F.col("page.event_id").alias("page_event"), F.coalesce("page.page_idx", F.lit(0)).cast("long").alias("page_idx"))


@_query("""
with a as (select doc_id - doc_id % 7 anchor, doc_id // 100 page from documents where doc_id % 7 = 0 and doc_id % 100 <> 0),
f as (select page, min(anchor) first_anchor from a group by page)
select d.doc_id, coalesce((select max(anchor) from a where a.page = d.doc_id // 100 and a.anchor <= d.doc_id), f.first_anchor) anchor
from documents d left join f on f.page = d.doc_id // 100""")
def anchor_lookup(t):
    docs = t("documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("page"))
    anchors = docs.filter("doc_id % 7 = 0 and doc_id % 100 <> 0").withColumnRenamed("doc_id", "place")
    return ops.anchor(docs, anchors, ["page"], "doc_id", "place").select("doc_id", "anchor")


@_query("""
select l_partkey, n_offsets, first_order, last_order from (
 select l_partkey, count(*) n_offsets, min(l_orderkey) first_order, max(l_orderkey) last_order from (
  select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) rn from lineitem) where rn <= 64 group by l_partkey)""")
def keyword_search(t):
    lines = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    asked = lines.select("l_partkey").distinct()
    found = ops.keyword_offsets(asked, lines, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    return found.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_offsets"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"))


@_query("""
select c_custkey, n, case when n = 1 then only_order when n = 0 then coalesce(case when c_nationkey < 12 then c_nationkey end, c_custkey) end target
from (select c_custkey, c_nationkey, count(o_orderkey) n, min(o_orderkey) only_order from customer left join orders on o_custkey = c_custkey and o_totalprice > 250000 group by all)""")
def keyword_target(t):
    orders = t("orders").filter("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("only_order"))
    all_rows = t("customer").select("c_custkey", F.when(F.col("c_nationkey") < 12, F.col("c_nationkey")).cast("long").alias("h1")).join(orders, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return all_rows.select("c_custkey", "n", ops.keyword_target(all_rows, "n", "only_order", "h1", "c_custkey").alias("target"))


@_query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def titles_anti(t):
    covered = t("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ops.not_covered(t("orders").select("o_orderkey", "o_custkey"), covered, ["o_orderkey"])


@_query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by text order by doc_id) rn from documents) where rn = 1")
def dedupe_first(t):
    return ops.first_of(t("documents").select("doc_id", "lang", "text"), ["text"], ["doc_id"]).select("doc_id", "lang")


@_query("""
select l_orderkey, l_partkey, l_linenumber, coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey
 order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0)::bigint topic_offset from lineitem""")
def running_topic_offset(t):
    rows = ops.running_offset(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", "topic_offset")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "topic_offset")


@_query("select event_id, user_id, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)::bigint page_no from events")
def page_assignment(t):
    rows = ops.page_numbers(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return rows.select("event_id", "user_id", F.col("page_no").cast("long").alias("page_no"))


@_query("""
select c.conv_id, c.turn, c.role, p.role prev_role, n.role next_role from conversations c
left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 left join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1""")
def browse_chain(t):
    return ops.browse_neighbours(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@_query("""
select o_orderkey, (o_orderkey * 37) // 2036 block3, (o_orderkey * 37) % 2036 offset3, (o_orderkey * 37) >> 14 block4, (o_orderkey * 37) & 16383 offset4 from orders""")
def block_address(t):
    ref = F.col("o_orderkey") * 37 + 12
    rows = t("orders").select("o_orderkey", fn.block_address(ref, F.lit(16), F.lit(2036)).alias("old"), fn.block_address(ref, F.lit(21), F.lit(0x4000)).alias("new"))
    return rows.select("o_orderkey", F.col("old.block").alias("block3"), F.col("old.offset").alias("offset3"), F.col("new.block").alias("block4"), F.col("new.offset").alias("offset4"))


@_query("select page_id, regexp_replace(replace(split_part(url, '?', 1), '//', '') || case when page_id % 2 = 0 then '.HLP' else '.hlp.txt' end, '\\.[hH][lL][pP]$', '') file_key from pages")
def file_key(t):
    name = F.concat(F.replace(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("//"), F.lit("")), F.when(F.col("page_id") % 2 == 0, ".HLP").otherwise(".hlp.txt"))
    return t("pages").select("page_id", fn.file_key(name).alias("file_key"))


@_query("""
select page_id, 'my file' file, case when page_id % 3 = 0 then 'index' end page, (case when page_id % 3 = 1 then page_id * 5 else 0 end)::bigint topic,
 case when page_id % 3 = 0 then 'a+b ' || page_id else '' end query from pages""")
def fragment_parse(t):
    n = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("my%20file/index/a+b%20"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("my%20file/topic-"), (F.col("page_id") * 5).cast("string"))).otherwise(F.concat(F.lit("my file/other"), n))
    return t("pages").select("page_id", fn.fragment(link).alias("f")).select("page_id", "f.file", "f.page", "f.topic", "f.query")


@_query("""
select p_partkey, printf('#%02x%02x%02x', p_partkey * 2654435 & 255, p_partkey * 2654435 >> 8 & 255, p_partkey * 2654435 >> 16 & 255) css from part""")
def color_css(t):
    return t("part").select("p_partkey", fn.colorref_css(F.col("p_partkey") * 2654435).alias("css"))


@_query("""
select p_partkey, p_size * (case when p_partkey % 3 = 0 then 1 when p_partkey % 3 = 1 then 10 else 1 end) / 20.0::double points,
 greatest(1, floor(p_size * 96 / 2540.0 + 0.5))::integer px from part""")
def unit_scale(t):
    scale = F.element_at(F.array(F.lit(0), F.lit(10), F.lit(1)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t("part").select("p_partkey", fn.points(F.col("p_size"), scale).alias("points"), fn.himetric_pixels(F.col("p_size")).alias("px"))


@_query("""
select p_partkey, 'font-family: ' || (case when p_partkey % 5 <> 0 then '"' || p_brand || '", ' else '' end) ||
 (case p_size % 7 when 1 then 'monospace' when 2 then 'serif' when 3 then 'sans-serif' when 4 then 'cursive' when 5 then 'fantasy' else 'sans-serif' end) ||
 '; font-size: ' || (p_size // 2)::varchar || (case when p_size % 2 = 1 then '.5' else '' end) || 'pt; font-weight: 400;' ||
 (case when p_size % 3 = 0 then ' font-style: italic;' else '' end) || (case when p_size % 4 = 0 then ' text-decoration: underline;' else '' end) ||
 (case when p_size % 5 = 0 then ' text-decoration: line-through;' else '' end) || (case when p_size % 6 = 0 then ' font-variant: small-caps;' else '' end) ||
 (case when p_partkey % 8 <> 0 then ' color: rgb(' || (p_partkey % 8)::varchar || ',0,0);' else '' end) css from part""")
def font_css(t):
    flag = lambda k: F.col("p_size") % k == 0
    font = F.struct(F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("face"), F.col("p_size").alias("half_points"), F.lit(400).alias("weight"), flag(3).alias("italic"), flag(4).alias("underline"), flag(5).alias("strikeout"), flag(6).alias("small_caps"), (F.col("p_size") % 7).alias("family"), (F.col("p_partkey") % 8).alias("fg"))
    return t("part").withColumn("font", font).select("p_partkey", fn.font_css(F.col("font")).alias("css"))


_CODES = [0, 1, 128, 129, 134, 136, 161, 162, 177, 178, 186, 204, 238, 77]
_CHARSET = f"list_extract([{', '.join(map(str, _CODES))}], (p_partkey % 14)::int + 1)"


@_query(f"""
select p_partkey, coalesce(case when p_partkey % 14 in (0, 1) and p_size <> 0 then
  case p_size & 255 when 1 then 'windows-1256' when 5 then 'windows-1250' when 8 then 'windows-1253' when 13 then 'windows-1255' when 17 then 'shift_jis' when 18 then 'euc-kr' when 25 then 'windows-1251'
   when 26 then 'windows-1250' when 30 then 'windows-874' when 31 then 'windows-1254' when 36 then 'windows-1250' when 42 then 'windows-1258' when 66 then 'windows-1257' end end,
  case {_CHARSET} when 128 then 'shift_jis' when 129 then 'euc-kr' when 134 then 'gb2312' when 136 then 'big5' when 161 then 'windows-1253' when 162 then 'windows-1254'
   when 177 then 'windows-1255' when 178 then 'windows-1256' when 186 then 'windows-1257' when 204 then 'windows-1251' when 238 then 'windows-1250' end, 'windows-1252') encoding,
 ({_CHARSET} in (177, 178) or p_size & 255 in (1, 13, 32, 41)) rtl from part""")
def charset_map(t):
    charset = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % 14 + 1).cast("int"))
    return t("part").select("p_partkey", fn.charset_name(charset, F.col("p_size")).alias("encoding"), fn.is_rtl(charset, F.col("p_size")).alias("rtl"))


@_query("select event_id, case when event_id < (user_id * 37) % 1000 then 'fixed' else 'scrolling' end region from events where event_type in ('click', 'view')")
def region_split(t):
    events = t("events").filter(F.col("event_type").isin("click", "view"))
    return events.select("event_id", ops.region(F.col("event_id"), (F.col("user_id") * 37) % 1000).alias("region"))


@_query("select event_type, count(*) n, count(distinct user_id) n_user_id from events group by event_type")
def counts(t):
    return ops.sizes(t("events"), ["event_type"], "user_id")


@_query("select l_partkey, string_agg(l_orderkey::varchar, ',' order by l_orderkey, l_linenumber) orders from lineitem group by l_partkey")
def collect_offsets(t):
    held = ops.offsets_of(t("lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber"], "l_orderkey", "offsets")
    return held.select("l_partkey", F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("orders"))
