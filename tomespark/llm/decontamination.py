"""Benchmark decontamination by size-partitioned MinHash containment search.

Items (short) are queries against documents (long). Both are sets of five-word
shingles over lower-case letters and digits. A document's shingles are cut into
overlapping windows, once for each size class of items (powers of two), so that
an item and the window around it are of like size: only then does a MinHash
see a contained item. An item is a candidate for a document if one of
``HASHES`` minhashes of a window equals the item's; a contained item is missed
with a chance under 5e-5 for each occurrence, and an item scattered over a
document meets many windows. Candidates are verified by the share of the
item's shingles that the whole document's set holds.

Items are searched in blocks of ``ITEM_BLOCK`` items or ``BLOCK_CHARS`` characters;
a block goes to every task, where each worker builds its sketches once, so what
is sent is bounded. Each block reads the documents once, and where there are
several, their results are written one after the other, so the driver holds one
block at a time.

Defined cases: null, empty or word-less items and texts match nothing; a text
or item of one to four words is one shingle, its whole sequence; a text of any
length is searched as a whole, in a buffer of its own; repeated rows
give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

WORDS, SHARE = 5, 0.8
#: Minhashes of an item and of a window. With windows of at most four times the item's shingles, an 80 % contained
#: item has a similarity of 0.8 / 4.2 = 0.19 at least, and (1 - 0.19) ** 48 < 5e-5.
HASHES = 48
#: Items, and characters of items, that are searched in one pass, about; a longer item is a block of its own.
ITEM_BLOCK, BLOCK_CHARS = 20_000, 32 << 20
_TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))

_RNG = np.random.default_rng(11)
_FACTOR, _FLIP = (_RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_TAG = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal(texts: list[str | None]) -> list[bytes]:
    """Lower case, ASCII punctuation as white space."""
    return [(t or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts]


def size_class(n: int) -> int:
    """Windows for items of n shingles step by this many shingles and are twice as long."""
    step = 1
    while step < n:
        step *= 2
    return step


class Items:
    """A block of items: shingle sets, and for each size class and minhash the sorted keys, their items and a filter."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        found, begins = shingles.shingle_hashes(normal(texts), WORDS) if texts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.ids, self.sets = [], []
        for i, d in enumerate(ids):
            own = np.unique(found[begins[i] : begins[i + 1]])
            if len(own):
                self.ids.append(d)
                self.sets.append(own)
        least = np.array([((own[:, None] ^ _FLIP) * _FACTOR).min(axis=0) for own in self.sets], dtype=np.uint64).reshape(-1, HASHES) * _TAG
        steps = np.array([size_class(len(own)) for own in self.sets], dtype=np.int64)
        self.steps = sorted(set(steps.tolist()))
        self.keys = {}
        for step in self.steps:
            owner = np.flatnonzero(steps == step)
            shift = np.uint64(64 - max(10, int(len(owner)).bit_length() + 6))
            for j in range(HASHES):
                order = np.argsort(least[owner, j], kind="stable")
                key = least[owner, j][order]
                passes = np.zeros(1 << (64 - int(shift)), dtype=bool)
                passes[key >> shift] = True
                self.keys[step, j] = key, owner[order], passes, shift

    def candidates(self, found: np.ndarray, begins: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) where a window of the text shares a minhash with the item. found, begins: from shingle_hashes."""
        full = np.flatnonzero(np.diff(begins))
        if not self.steps or not len(full):
            return set()
        hit: set[tuple[int, int]] = set()
        levels, n, at, step = [], np.diff(begins)[full], begins[:-1][full], 0
        while step < self.steps[-1]:
            width = 2 if step else self.steps[0]  # the smallest blocks are those of the smallest items
            step = width * max(1, step)
            blocks = -(-n // width)  # of each text at this level, from those of the level below
            last = np.cumsum(blocks)
            first = last - blocks
            owner = np.repeat(np.arange(len(full)), blocks)
            inner = np.arange(last[-1]) - first[owner]
            cuts = at[owner] + inner * width
            single = (inner == blocks[owner] - 1) & (inner > 0)  # the last block has no next one: the window before holds it
            nxt = np.minimum(np.arange(last[-1]) + (inner < blocks[owner] - 1), last[-1] - 1)
            levels.append((step, cuts, nxt, ~single, full[owner]))
            n, at = blocks, first
        for j in range(HASHES):
            low = (found ^ _FLIP[j]) * _FACTOR[j]
            for step, cuts, nxt, is_window, owner in levels:
                low = np.minimum.reduceat(low, cuts)
                if (step, j) not in self.keys:
                    continue
                key, item, passes, shift = self.keys[step, j]
                seek = np.minimum(low, low[nxt]) * _TAG[j]
                maybe = np.flatnonzero(passes[seek >> shift] & is_window)
                first = np.searchsorted(key, seek[maybe])
                found_at = key[np.minimum(first, len(key) - 1)] == seek[maybe]
                for w, k in zip(maybe[found_at].tolist(), first[found_at].tolist()):
                    while k < len(key) and key[k] == seek[w]:
                        hit.add((int(owner[w]), int(item[k])))
                        k += 1
        return hit


_BLOCKS: dict[str, Items] = {}


def _items(name: str, ids: list[int], texts: list[str | None]) -> Items:
    """The block of that name, built once in each worker, which keeps the last one."""
    if name not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[name] = Items(ids, texts)
    return _BLOCKS[name]


def find_items(docs: DataFrame, items: DataFrame, *, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for every item of which a document holds ``share`` or more."""
    docs = common.id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    asked = common.id_and_text(items, item_id, item_text).filter("doc_id is not null").orderBy("doc_id", "text")
    out, block, chars = [], [], 0

    def search(block: list) -> DataFrame:
        ids, texts, name = [r[0] for r in block], [r[1] for r in block], uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _items(name, ids, texts)
            for batch in common.sliced(batches, 1):
                rows = []
                docs_of = batch.column(0).to_pylist()
                own = normal(batch.column(1).to_pylist())
                for lo, hi in shingles.buffers(own):
                    found, begins = shingles.shingle_hashes(own[lo:hi], WORDS)
                    last, full = -1, None
                    for i, k in sorted(known.candidates(found, begins)):
                        if i != last:
                            last, full = i, np.unique(found[begins[i] : begins[i + 1]])
                        want = known.sets[k]
                        both = int((full[np.minimum(np.searchsorted(full, want), len(full) - 1)] == want).sum())
                        if both >= share * len(want) - 1e-9:
                            rows.append((docs_of[lo + i], known.ids[k], len(want), both))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_item", "n_shared"])

        return docs.mapInArrow(run, schema)

    for row in asked.toLocalIterator():
        if block and (len(block) == ITEM_BLOCK or chars + len(row["text"]) > BLOCK_CHARS):
            out.append(common.written(search(block), "found-items"))
            block, chars = [], 0
        block.append((row["doc_id"], row["text"]))
        chars += len(row["text"])
    if block or not out:
        out.append(search(block))
    all_rows = out[0]
    for more in out[1:]:
        all_rows = all_rows.unionByName(more)
    return all_rows.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents, all columns, that hold no item."""
    hit = find_items(docs, items, **how).select("doc_id").filter("doc_id is not null").distinct()
    return common.without(docs, common.written(hit, "contaminated"), how.get("id_col", "doc_id"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(common.spread(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with w as (
  select kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') words
  from (select 'd' kind, row_number() over () id, text from documents union all select 'i', item_id, text from benchmark)),
s as (
  select distinct kind, id, array_to_string(words[i : least(i + 4, len(words))], ' ') shingle
  from w, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) r(i)),
n as (select id, count(*) n from s where kind = 'i' group by id),
b as (select d.id row_id, i.id item_id, count(*) both_n from s d join s i on d.kind = 'd' and i.kind = 'i' and d.shingle = i.shingle group by d.id, i.id),
docs as (select row_number() over () id, doc_id from documents)
select doc_id, item_id, n n_item, both_n n_shared, both_n / n containment
from b join n on n.id = b.item_id join docs on docs.id = row_id where both_n >= 0.8 * n - 1e-9
"""
