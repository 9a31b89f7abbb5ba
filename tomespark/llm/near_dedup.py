"""MinHash near-duplicate detection with tensored banding.

Two small collections of t sketches (two minhashes each) are computed per
document; a table key is a pair of one sketch from either, so t * t tables cost
2 * t sketches. Documents that share a key are candidates, judged by how many
of all minhashes agree and then by the exact similarity of their full shingle
sets:

1. identical sets form a class, and only one member goes on;
2. keys of more than one class become buckets; buckets with the same members
   are one. Blocks of a bucket (hot buckets are cut into pairs of blocks) find
   candidate pairs, and hand on only a spanning forest of them;
3. within components of that forest the full sets meet, again in bounded
   blocks; a block compares what it doesn't know to be linked already, and
   hands on a spanning forest of exact links;
4. components of the links are the result.

No block's pairs are ever emitted, none is capped. A pair at the threshold is
missed by the keys with a chance under 1e-4, by the agreement under 1e-5.

Defined cases: null, empty or blank texts have no shingles and are linked with
nothing; a text of any length takes part with its full set; rows that share a
document id are one node, and each keeps its own row; a null id is linked with
nothing and kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

#: Minhashes in a sketch.
WIDTH = 2
#: Documents in a block of a bucket, on average, and shingles in a block of full sets.
BLOCK, BLOCK_SHINGLES = 2000, 1 << 18
#: Rows of candidates (some 150 bytes each with their signatures) that are broadcast at most to pick their texts; beyond, it's a shuffled join.
BROADCAST_ROWS = 200_000
SIGNATURES = "doc_id long, n_shingles long, h1 long, h2 long, a array<long>, b array<long>, sig binary"


def sketches(similarity: float, miss: float = 1e-4) -> int:
    """Sketches in a collection so that a pair at the threshold is missed with a smaller chance."""
    t = 1
    while 1 - (1 - (1 - similarity**WIDTH) ** t) ** 2 > miss:
        t += 1
    return t


def agreement(similarity: float, n: int, miss: float = 1e-5) -> int:
    """The most agreeing minhashes of n that may be asked for with a smaller chance to miss a pair at the threshold."""
    total, m = 0.0, 0
    while (total := total + comb(n, m) * similarity**m * (1 - similarity) ** (n - m)) <= miss:
        m += 1
    return m


def signatures(docs: DataFrame, words: int, t: int) -> DataFrame:
    """One row per row of docs (doc_id, text)."""
    n = 2 * WIDTH * t
    rng = np.random.default_rng(7)
    factor, flip = (rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    tag = rng.integers(1, 2**63, 2 * t, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 1):
            texts = shingles.ascii_lower(batch.column(1).to_pylist())
            for lo, hi in shingles.buffers(texts):
                found, begins = shingles.shingle_hashes(texts[lo:hi], words)
                count = np.zeros((hi - lo, 3), dtype=np.uint64)
                for i in range(hi - lo):
                    own = np.unique(found[begins[i] : begins[i + 1]])
                    count[i] = len(own), own.sum(dtype=np.uint64), (own * own * factor[0] ^ own >> np.uint64(7)).sum(dtype=np.uint64)
                least = np.zeros((hi - lo, n), dtype=np.uint64)
                full = np.flatnonzero(np.diff(begins))
                for j in range(n if len(full) else 0):
                    least[full, j] = np.minimum.reduceat((found ^ flip[j]) * factor[j], begins[:-1][full])
                sketch = shingles.mix(least[:, 0::2] * factor[1] + (least[:, 1::2] ^ tag)).view(np.int64)
                sig = (least >> np.uint64(48)).astype("<u2")
                rows = [None if not c[0] else s.tobytes() for c, s in zip(count, sig)]
                offsets = pa.array(np.arange(0, (hi - lo + 1) * t, t, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        *(pa.array(count[:, k].view(np.int64)) for k in range(3)),
                        pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(sketch[:, :t]).ravel())),
                        pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(sketch[:, t:]).ravel())),
                        pa.array(rows, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "a", "b", "sig"],
                )

    return docs.mapInArrow(sign, SIGNATURES)


def _blocks(members: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each member once for every pair of its block with another block of the group: columns x <= y, side."""
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col(blocks))
    return (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
        .withColumn("x", F.least("own", "other"))
        .withColumn("y", F.greatest("own", "other"))
    )


def _forest(sig: np.ndarray, n: np.ndarray, side: np.ndarray | None, least: int, similarity: float, linked: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that agree well enough (and are ``linked``), within a block or between two.

    Rows that are connected already aren't compared again, so a block of copies
    of one text takes one look at each row.
    """
    label = np.arange(len(n))
    for i in range(len(n) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if side is not None:
            rest = rest[side[rest] != side[i]]
        rest = rest[np.minimum(n[rest], n[i]) >= similarity * np.maximum(n[rest], n[i]) - 1e-6]
        agree = (sig[rest] == sig[i]).sum(axis=1)
        rest, agree = rest[agree >= least], agree[agree >= least]
        for j in rest[np.argsort(-agree, kind="stable")].tolist():
            if label[j] != label[i] and (linked is None or linked(i, j)):
                label[label == label[j]] = label[i]
                yield i, j


def _emit(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidate_edges(classes: DataFrame, similarity: float, t: int) -> DataFrame:
    """A spanning forest of the candidate pairs. ``classes``: id, n, a, b, sig."""
    least = agreement(similarity, 2 * WIDTH * t)
    keyed = classes.select("id", F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))).alias("key"))
    shared = common.written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("same")).filter("size > 1"), "shared-keys")
    keys = classes.count() * t * t
    members = common.with_counts(keyed, shared, ["key"], F.col("id"), keys, n="size").select(F.xxhash64("size", "same").alias("bucket"), "size", "id").distinct()
    signed = members.join(classes.select("id", "n", "sig"), "id")
    blocked = _blocks(signed.withColumn("blocks", F.ceil(F.col("size") / BLOCK)), "bucket", "blocks")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for (_, x, y), rows in common.groups(batches, 3):
            ids, n = rows.column(3).to_numpy(), rows.column(4).to_numpy()
            sig = np.frombuffer(b"".join(rows.column(5).to_pylist()), dtype="<u2").reshape(len(ids), -1)
            side = rows.column(6).to_numpy() if x != y else None
            edges += [(ids[i], ids[j]) for i, j in _forest(sig, n, side, least, similarity)]
            if len(edges) > 5000:
                yield _emit(edges)
                edges = []
        yield _emit(edges)

    dealt = blocked.select("bucket", "x", "y", "id", "n", "sig", "own").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return dealt.mapInArrow(forest, "a long, b long").distinct()


def exact_links(docs: DataFrame, groups: DataFrame, words: int, similarity: float, t: int) -> DataFrame:
    """A spanning forest of the exact links within each group. ``docs``: doc_id, text; ``groups``: id, label, n, sig."""
    least, percent = agreement(similarity, 2 * WIDTH * t), round(100 * similarity)
    sizes = groups.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.count(F.lit(1)).alias("members"))
    total = groups.count()
    placed = common.written(common.with_counts(groups, sizes, ["label"], F.col("id"), total, n="members"), "candidate-groups")
    chosen = placed.withColumnRenamed("id", "doc_id")
    texts = docs.join(F.broadcast(chosen) if total <= BROADCAST_ROWS else chosen, "doc_id")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, 5):
            own = shingles.ascii_lower(batch.column(5).to_pylist())
            for lo, hi in shingles.buffers(own):
                found, begins = shingles.shingle_hashes(own[lo:hi], words)
                sets = [np.unique(found[begins[i] : begins[i + 1]]).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(5)), pa.array(sets, pa.binary())], names=["id", "label", "blocks", "n", "sig", "shingles"])

    sets = texts.select("doc_id", "label", "blocks", "n", "sig", "text").mapInArrow(full_sets, "id long, label long, blocks long, n long, sig binary, shingles binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for (_, x, y), rows in common.groups(batches, 3):
            ids = rows.column(3).to_numpy()
            sig = np.frombuffer(b"".join(rows.column(5).to_pylist()), dtype="<u2").reshape(len(ids), -1)
            own = [np.frombuffer(b, dtype=np.uint64) for b in rows.column(7).to_pylist()]
            n = np.array([len(s) for s in own], dtype=np.int64)

            def linked(i: int, j: int, own: list = own) -> bool:
                both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                return 100 * both >= percent * (len(own[i]) + len(own[j]) - both)

            edges += [(ids[i], ids[j]) for i, j in _forest(sig, n, rows.column(6).to_numpy() if x != y else None, least, similarity, linked)]
            if len(edges) > 5000:
                yield _emit(edges)
                edges = []
        yield _emit(edges)

    dealt = _blocks(sets, "label", "blocks").select("label", "x", "y", "id", "n", "sig", "own", "shingles").repartition("label", "x", "y").sortWithinPartitions("label", "x", "y")
    return dealt.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; similarity counts in whole hundredths."""
    docs = common.id_and_text(docs, id_col, text_col)
    t = sketches(similarity)
    signed = common.written(signatures(docs, words, t), "signatures")
    takes_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    same = ["h1", "h2", "n_shingles"]
    folded = signed.filter(takes_part).groupBy(*same).agg(F.min(F.struct("doc_id", "a", "b", "sig")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = common.written(folded.select(*same, "copies", F.col("first.doc_id").alias("id"), "first.a", "first.b", "first.sig"), "classes")
    nodes = classes.select("id", F.col("n_shingles").alias("n"), "a", "b", "sig")
    candidates = components(candidate_edges(nodes, similarity, t))
    grouped = candidates.join(nodes.select("id", "n", "sig").groupBy("id").agg(F.min(F.struct("n", "sig")).alias("s")).select("id", "s.n", "s.sig"), "id")
    links = components(exact_links(docs, common.written(grouped, "grouped"), words, similarity, t))
    of_class = classes.join(links.withColumnRenamed("label", "component"), "id", "left").select(*same, "copies", F.coalesce("component", "id").alias("component_id"))
    linked = common.with_counts(signed.filter(takes_part).select("doc_id", *same), of_class, same, F.col("doc_id"), signed.count(), n="copies")
    alone = signed.filter(~takes_part).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.spread(common.table(spark, sf_dir, "documents")), words=3, similarity=0.85)


ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') words from documents),
s as (
  select distinct doc_id, hash(array_to_string(words[i : least(i + 2, len(words))], ' ')) shingle
  from d, unnest(range(1, greatest(len(words) - 2, least(len(words), 1)) + 1)) r(i)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select min(n.doc_id) doc_id, n.n, x from n join (select doc_id, bit_xor(hash(shingle)) x from s group by doc_id) h on h.doc_id = n.doc_id group by n.n, x),
m as (select n.doc_id, c.doc_id as rep from n join (select doc_id, bit_xor(hash(shingle)) x from s group by doc_id) h on h.doc_id = n.doc_id join c on c.n = n.n and c.x = h.x),
r as (select s.* from s join c on c.doc_id = s.doc_id),
shared as (select * from r where shingle in (select shingle from r group by shingle having count(*) > 1)),
p as (select a.doc_id a, b.doc_id b, count(*) both_n from shared a join shared b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_n >= 85 * (x.n + y.n - both_n)),
e2 as (select a, b from e union all select b, a from e),
reach as (select doc_id id, doc_id as label from c union select e2.b, reach.label from reach join e2 on e2.a = reach.id),
least_of as (select id, min(label) as label from reach group by id)
select documents.doc_id, coalesce(n.n, 0) n_shingles, coalesce(l.label, documents.doc_id) component_id, coalesce(l.label, documents.doc_id) = documents.doc_id kept
from documents left join n on n.doc_id = documents.doc_id left join m on m.doc_id = documents.doc_id left join least_of l on l.id = m.rep
"""
