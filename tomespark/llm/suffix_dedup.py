"""Removal of repeated 200-byte strings with suffix arrays.

A string of ``span`` bytes that starts at two places has the same anchor at
both: the rightmost smallest hash of its 64-byte grams. So only strings around
anchors that occur twice can repeat, and no other is looked at:

1. each text's anchors are found in numpy. Neighbouring strings mostly have the
   same one; a run of starts and the bytes of their strings are its context, so
   every string lies in just one context of its text. Contexts are hashed;
2. anchors that occur once are dropped. Contexts that occur twice are removed
   as they stand, and go on once; so do the other contexts of their anchors;
3. contexts are dealt by anchor into shards of bounded size (an anchor with
   too many contexts is split among several). A shard's suffix array is built
   by Larsson and Sadakane's refinement, common prefixes by Kasai's method, and
   neighbours with ``span`` bytes in common mark their strings;
4. shards that share an anchor hand on sorted prints of their distinct strings,
   and binary search in each other's lists finds what repeats across them;
5. marked strings are joined into runs for each text, and removed.

Texts with equal bytes are one text until step 5; equal means two 64-bit
hashes and the length, and strings across shards are compared by 128 bits.
Joins on anchors, contexts and texts deal the rows of hot ones among many tasks.

Defined cases: null texts are empty; strings never cross texts; texts shorter
than ``span`` bytes lose nothing; a text of any length is looked at as a whole,
in a buffer of its own; rows that repeat are copies of each other even with the
same id; a null id keeps its row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

SPAN, GRAM = 200, 64
#: Contexts of a shard, about, and of one anchor in a shard at most, about.
SHARD, SPLIT = 4000, 4000
#: Rows of a table (some tens of bytes each) that are broadcast at most; beyond, it's a shuffled join.
BROADCAST_ROWS = 300_000
_BITS = 30  # of a place in a buffer, in keys that order grams by 34 bits of their hash and then by place
_SEED = np.uint64(0xD6E8FEB86659FD93)


class Prints:
    """Hashes of any substrings of a buffer, from prefix sums."""

    def __init__(self, buf: np.ndarray) -> None:
        shingles._POWERS.grow(len(buf) + 1)
        self.down = shingles._POWERS.down
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles._BYTE[buf] * shingles._POWERS.up[: len(buf)], dtype=np.uint64)])

    def of(self, start, end) -> np.ndarray:
        return shingles.mix((self.total[end] - self.total[start]) * self.down[start])

    def all(self, n: int) -> np.ndarray:
        """The hash of the n bytes from every place on."""
        m = len(self.total) - n
        return shingles.mix((self.total[n:] - self.total[:m]) * self.down[:m])


def anchors(texts: list[bytes], span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, anchor hashes, context hashes, starts and ends of contexts) of each text with an anchor."""
    for lo, hi in shingles.buffers(texts):
        buf = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
        if len(buf) < span:
            continue
        ends = np.cumsum([len(t) for t in texts[lo:hi]])
        begins = ends - [len(t) for t in texts[lo:hi]]
        prints = Prints(buf)
        grams = prints.all(GRAM)
        place = np.arange(len(grams), dtype=np.uint64)
        key = (grams >> np.uint64(_BITS) << np.uint64(_BITS)) | (np.uint64((1 << _BITS) - 1) - place)
        width, want = 1, span - GRAM + 1
        while 2 * width <= want:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if want > width:
            key = np.minimum(key[: -(want - width)], key[want - width :])
        chosen = (np.uint64((1 << _BITS) - 1) - (key & np.uint64((1 << _BITS) - 1))).astype(np.int64)
        first = np.arange(len(chosen))
        owner = np.searchsorted(ends, first, side="right")
        whole = first + span <= ends[owner]
        chosen, owner, first = chosen[whole], owner[whole], first[whole]
        new = np.ones(len(chosen), dtype=bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
        lead = np.flatnonzero(new)
        left, right = first[lead], first[np.append(lead[1:], len(first)) - 1] + span
        chosen, owner = chosen[lead], owner[lead]
        context = shingles.mix(prints.of(left, right) ^ ((chosen - left).astype(np.uint64) * np.uint64(4096) + (right - left).astype(np.uint64)) * _SEED)
        cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[i], cuts[i + 1]
            yield lo + int(i), grams[chosen[a:b]], context[a:b], left[a:b] - begins[i], right[a:b] - begins[i]


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0), type=kind))


def find_anchors(docs: DataFrame, span: int) -> DataFrame:
    """docs: t1, t2, text, n_bytes."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 3):
            n = batch.num_rows
            a, c, s, e = [none] * n, [none] * n, [none] * n, [none] * n
            for i, grams, context, start, end in anchors(common.raw_texts(batch.column(3)), span):
                a[i], c[i], s[i], e[i] = grams.view(np.int64), context.view(np.int64), start, end
            lists = [_lists(a, pa.int64()), _lists(c, pa.int64()), _lists(s, pa.int32()), _lists(e, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], names=["t1", "t2", "n_bytes", "a", "c", "s", "e"])

    return docs.select("t1", "t2", "n_bytes", "text").mapInArrow(run, "t1 long, t2 long, n_bytes long, a array<long>, c array<long>, s array<int>, e array<int>")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes: Larsson and Sadakane's refinement.

    Suffixes start as groups of equal first eight bytes; each round sorts the
    members of groups that aren't single yet by the group of the suffix as far
    on as is known to be equal, and doubles that distance.
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(first)
    rank = np.zeros(n, dtype=np.int64)  # of a group: the place of its first member
    edge = np.ones(n, dtype=bool)
    edge[1:] = first[order][1:] != first[order][:-1]
    starts = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    rank[order] = starts
    known = 8
    while True:
        edge_next = np.append(edge[1:], True)
        unsorted = np.flatnonzero(~(edge & edge_next))
        if not len(unsorted):
            return order
        members = order[unsorted]
        further = members + known
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[unsorted] = members[by]
        key = key[by]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        edge[unsorted] = new
        group = np.maximum.accumulate(np.where(new, unsorted, 0))
        rank[order[unsorted]] = group
        known *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, begins: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """By place: bytes in common with the suffix before it in the order, ``most`` at most.

    Kasai's method, for all contexts side by side: the next place of a context
    has at least one byte less in common than the last one.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)[:n]).view("<u8").ravel()
    out = np.zeros(n, dtype=np.int64)
    held = np.zeros(len(begins), dtype=np.int64)
    for step in range(int(lengths.max()) if len(lengths) else 0):
        lane = np.flatnonzero(lengths > step)
        at = begins[lane] + step
        other = before[at]
        have = np.maximum(held[lane] - 1, 0)
        have[other < 0] = 0
        busy = np.flatnonzero((other >= 0) & (have < most))
        while len(busy):
            i, j = at[busy] + have[busy], other[busy] + have[busy]
            inside = (i < n) & (j < n)
            busy, i, j = busy[inside], i[inside], j[inside]
            differ = words[i] ^ words[j]
            low = differ & (np.uint64(0) - differ)
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            same = np.minimum(same, np.minimum(n - i, n - j))
            have[busy] += same
            busy = busy[(same == 8) & (have[busy] < most)]
        have = np.minimum(have, most)
        out[at] = have
        held[lane] = have
    return out


class Shard:
    """Contexts side by side: where each lies in its text, and which of their strings repeat."""

    def __init__(self, contexts: list[bytes], text_of: np.ndarray, start_of: np.ndarray, span: int) -> None:
        self.span = span
        lengths = np.array([len(c) for c in contexts], dtype=np.int64)
        begins = np.cumsum(lengths) - lengths
        self.buf = np.frombuffer(b"".join(contexts), dtype=np.uint8)
        counts = np.maximum(lengths - span + 1, 0)
        own = np.repeat(np.arange(len(contexts)), counts)
        step = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.own, self.step = own, step
        self.place = begins[own] + step  # of every whole string in the buffer
        self.text, self.at = text_of[own], start_of[own] + step  # and in its text
        order = suffix_array(self.buf)
        shared = common_prefixes(self.buf, order, begins, lengths, span)
        string = np.full(len(self.buf), -1, dtype=np.int64)
        string[self.place] = np.arange(len(self.place))
        run = np.cumsum(shared[order] < span)  # suffixes of a run have span bytes in common
        which = string[order]
        ordered, run = which[which >= 0], run[which >= 0]
        # no place of a text lies in two contexts, so a run repeats if it has two strings
        lead = np.ones(len(run), dtype=bool)
        lead[1:] = run[1:] != run[:-1]
        alone = lead & np.append(lead[1:], True)
        self.repeats = np.zeros(len(self.place), dtype=bool)
        self.repeats[ordered] = ~alone
        self.distinct = ordered[lead]  # one string of each run, in the order of the suffix array

    def runs(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the runs of marked strings, context by context."""
        at = np.flatnonzero(marked)
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        gap = np.ones(len(at), dtype=bool)
        gap[1:] = (self.own[at][1:] != self.own[at][:-1]) | (self.step[at][1:] > self.step[at][:-1] + self.span)
        last = np.append(np.flatnonzero(gap)[1:] - 1, len(at) - 1)
        return self.text[at[gap]], self.at[at[gap]], self.at[at[last]] + self.span


def _two_prints(buf: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
    one, two = Prints(buf), Prints(buf ^ np.uint8(0x5A))
    return np.stack([one.of(place, place + span), shingles.mix(two.of(place, place + span) + _SEED)])


def spans_to_remove(docs: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """t1, t2, start, end: runs of repeated strings of each distinct text, in parts that may overlap; and t1, t2, copies.

    docs: t1, t2, n_bytes, text.
    """
    found = common.written(find_anchors(docs, span), "anchors")
    texts = found.groupBy("t1", "t2", "n_bytes").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("a", "c", "s", "e")).alias("x"))
    texts = common.written(texts.select("t1", "t2", "n_bytes", "copies", "x.*"), "anchored-texts")
    common.released(found)
    whole = texts.filter(f"copies > 1 and n_bytes >= {span}").select("t1", "t2", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))

    places = texts.select("t1", "t2", F.explode(F.arrays_zip("a", "c", "s", "e")).alias("x")).select("t1", "t2", "x.a", "x.c", F.col("x.s").cast("long").alias("start"), F.col("x.e").cast("long").alias("end"))
    twice = common.written(places.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-anchors")
    n_twice = twice.agg(F.sum("n")).first()[0] or 0
    salt = F.xxhash64("t1", "start")
    repeated = common.written(common.with_counts(places, twice, ["a"], salt, n_twice).drop("n"), "anchor-places")
    common.released(twice)
    contexts = repeated.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "start", "end")).alias("x"))
    contexts = common.written(contexts.select("a", "c", "n", "x.*"), "contexts")
    again = contexts.filter("n > 1").select("a", "c", "n")
    as_they_stand = common.with_counts(repeated, again, ["a", "c"], salt, n_twice).select("t1", "t2", "start", "end")

    # contexts of anchors that have two of them, one of which isn't known to repeat as a whole
    open_anchors = contexts.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("a", "m")
    asked = common.written(common.with_counts(contexts.drop("n"), open_anchors, ["a"], F.col("c"), n_twice, n="m").select("a", "m", "t1", "t2", "start", "end"), "open-contexts")
    n_open, few = asked.agg(F.count(F.lit(1)), F.approx_count_distinct("t1")).first()
    shards = max(1, -(-n_open // SHARD))
    cut = asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "m", "start", "end")).alias("cuts"))  # as many as a text has anchors
    sources = docs.join(F.broadcast(asked.select("t1").distinct()), "t1", "left_semi") if few <= 900_000 else docs
    # copies of a text are folded within each task before they are shuffled
    one = sources.select("t1", "t2", "text").dropDuplicates(["t1", "t2"]).join(cut, ["t1", "t2"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 2):
            cols: list[list] = [[], [], [], [], [], []]
            for t1, t2, raw, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.raw_texts(batch.column(2)), batch.column(3).to_pylist()):
                for x in cuts:
                    for col, v in zip(cols, (x["a"], x["m"], t1, t2, x["start"], raw[x["start"] : x["end"]])):
                        col.append(v)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "m", "t1", "t2", "start", "context"])

    bodies = one.mapInArrow(take, "a long, m long, t1 long, t2 long, start long, context binary")
    split = F.col("m") > SPLIT
    salt = F.when(split, F.pmod(F.xxhash64("t1", "start"), F.ceil(F.col("m") / SPLIT))).otherwise(F.lit(0))
    shard = F.when(split, F.xxhash64("a")).otherwise(F.pmod(F.xxhash64("a"), F.lit(shards)))
    dealt = bodies.select(split.alias("hot"), shard.alias("shard"), salt.cast("long").alias("salt"), "a", "m", "t1", "t2", "start", "context")
    ordered = dealt.repartition("hot", "shard", "salt").sortWithinPartitions("hot", "shard", "salt", "t1", "start")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hot, _, salt), rows in common.groups(batches, 3):
            t1, t2 = rows.column(5).to_numpy(), rows.column(6).to_numpy()
            _, same = np.unique(np.stack([t1, t2]), axis=1, return_inverse=True)
            same = same.ravel()
            s = Shard(rows.column(8).to_pylist(), same, rows.column(7).to_numpy(), span)
            owner = np.zeros(int(same.max()) + 1, dtype=np.int64)  # a row of each text
            owner[same] = np.arange(len(t1))
            text, start, end = s.runs(s.repeats)
            none = pa.nulls(len(text), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(t1[owner[text]]), pa.array(t2[owner[text]]), pa.array(start), pa.array(end), pa.nulls(len(text), pa.int64()), pa.nulls(len(text), pa.int64()), pa.nulls(len(text), pa.int64()), none], names=names)
            if hot:
                many = -(-int(rows.column(4)[0].as_py()) // SPLIT)
                prints = _two_prints(s.buf, s.place[s.distinct], span)
                bucket = (prints[0] % np.uint64(many)).astype(np.int64)
                a = rows.column(3)[0].as_py()
                for b in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == b)
                    at = at[np.lexsort((prints[1][at], prints[0][at]))]
                    d = s.distinct[at]
                    i = owner[s.text[d]]
                    blob = np.stack([prints[0][at].view(np.int64), prints[1][at].view(np.int64), t1[i], t2[i], s.at[d]]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([0]), pa.array([0]), pa.array([a]), pa.array([b]), pa.array([int(salt)]), pa.array([blob], pa.binary())], names=names)

    names = ["t1", "t2", "start", "end", "a", "bucket", "salt", "strings"]
    built = common.written(ordered.mapInArrow(build, "t1 long, t2 long, start long, end long, a long, bucket long, salt long, strings binary"), "shard-results")
    across = built.filter("strings is not null").select("a", "bucket", "salt", "strings").repartition("a", "bucket").sortWithinPartitions("a", "bucket", "salt")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted lists of one anchor's strings, one list a shard: pairs of lists are merged by binary search."""
        for _, rows in common.groups(batches, 2):
            lists = [(x, np.zeros(x.shape[1], dtype=bool)) for x in (np.frombuffer(b, dtype=np.int64).reshape(5, -1) for b in rows.column(3).to_pylist())]
            found = []
            while len(lists) > 1:
                merged = []
                for (pool, hit), (more, more_hit) in zip(lists[0::2], lists[1::2]):
                    at = np.minimum(np.searchsorted(pool[0].view(np.uint64), more[0].view(np.uint64)), pool.shape[1] - 1)
                    equal = (pool[:2, at] == more[:2]).all(axis=0)
                    hit[at[equal]] = True
                    found.append(more[2:, equal])
                    both, marked = np.concatenate([pool, more[:, ~equal]], axis=1), np.concatenate([hit, more_hit[~equal]])
                    order = np.argsort(both[0].view(np.uint64), kind="stable")
                    merged.append((both[:, order], marked[order]))
                lists = merged + lists[len(lists) & ~1 :]
            pool, hit = lists[0]
            marked = np.concatenate([pool[2:, hit], *found], axis=1)
            t1, t2, at = marked[:, np.lexsort(marked[::-1])]
            gap = np.ones(len(at), dtype=bool)  # strings of a text that touch are one run
            gap[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (at[1:] > at[:-1] + span)
            first = np.flatnonzero(gap)
            last = np.append(first[1:] - 1, len(at) - 1)[: len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(t1[first]), pa.array(t2[first]), pa.array(at[first]), pa.array(at[last] + span)], names=["t1", "t2", "start", "end"])

    merged = across.mapInArrow(merge, "t1 long, t2 long, start long, end long")
    inside = built.filter("strings is null").select("t1", "t2", "start", "end")
    return whole.unionByName(as_they_stand).unionByName(inside).unionByName(merged), texts.select("t1", "t2", "copies")


def _unite(cuts: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in cuts or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end; maximal runs), kept (the bytes that stay) for every row of docs."""
    named = common.id_and_text(docs, id_col, text_col)
    hashed = named.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    spans, copies = spans_to_remove(hashed, span)
    by_text = common.written(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("cuts")).join(copies, ["t1", "t2"]), "removed")  # as many as a text has anchors
    total, rows = by_text.agg(F.sum(F.size("cuts")), F.sum("copies")).first()
    if (total or 0) <= BROADCAST_ROWS:
        joined = hashed.join(F.broadcast(by_text.drop("copies")), ["t1", "t2"], "left")
    else:
        joined = common.with_counts(hashed, by_text, ["t1", "t2"], F.col("doc_id"), rows, n="copies", how="left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 2):
            removed, kept = [], []
            for raw, cuts in zip(common.raw_texts(batch.column(2)), batch.column(3).to_pylist()):
                runs = _unite(cuts)
                edges = [0, *(x for run in runs for x in run), len(raw)]
                removed.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.select("doc_id", "n_bytes", "text", "cuts").mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.spread(common.table(spark, sf_dir, "documents")))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, i, hash(h[2 * i + 1 : 2 * i + 400]) k from d, unnest(range(0, greatest(0, len(h) // 2 - 199))) r(i)),
t as (select doc_id, i from w where k in (select k from w group by k having count(*) > 1)),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end fresh from t),
q as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) run from g),
runs as (select doc_id, run, min(i) a, max(i) + 200 b from q group by doc_id, run),
per as (select doc_id, sum(b - a) n_removed, count(*) n_spans, list_prepend(0, list(b order by a)) kept_from, list_append(list(a order by a), null) kept_to from runs group by doc_id)
select d.doc_id, len(h) // 2 n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0) n_spans,
 sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(list_zip(kept_from, kept_to), lambda z: h[2 * z[1] + 1 : coalesce(2 * z[2], len(h))]), '') end)) kept_sha256
from d left join per on per.doc_id = d.doc_id
"""
