"""Packing documents into sequences by bin completion on the histogram of piece lengths.

Lengths are at most the capacity, so the problem is its histogram, however
many documents there are. The driver solves that bounded problem: incumbents
come from best fit and from completing each sequence around its longest piece
with the filling that wastes least, repeated as often as the counts allow.
Where they use more sequences than a lower bound asks for, a branch and
bound over undominated fillings revises the last sequences. It proves the
optimum for cases of up to ``TAIL`` sequences within its budget; for larger ones
the result may be above the bound. Executors rank pieces within their
length and look up their place by rank; no piece visits the driver.

Defined cases: a null or empty text is its end id alone; only documents longer
than the capacity are cut, whatever their length; repeated ids stay separate
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "part int, local_rank long, doc_id long, piece int, start long, length long, ids binary"
#: Rows of the (part, length) rank table that are broadcast at most (16 bytes each); beyond, it's a shuffled join.
BROADCAST_ROWS = 500_000
#: Branches tried for a filling before its least waste is found from sums instead.
BRANCHES = 1_000
#: Sequences at the end of a packing that are searched for a better one, and partial fillings that a search may look at.
TAIL, SEARCHED = 64, 100_000


def fullest(room: int, sizes: list[int], counts: dict[int, int]) -> list[int]:
    """The pieces (longest first) that fill ``room`` with least waste, by the sums that the sizes so far can make."""
    sums, steps = 1, []  # bit n: n can be made
    for s in reversed(sizes):
        have, each = (counts[s] if s <= room else 0), 1
        while have > 0:
            n = min(each, have)
            steps.append((s, n, sums))
            sums |= sums << s * n & (1 << room + 1) - 1
            have, each = have - n, 2 * each
    left, fill = sums.bit_length() - 1, []
    for s, n, before in reversed(steps):
        if not before >> left & 1:
            left -= s * n
            fill += [s] * n
    return sorted(fill, reverse=True)


def complete(room: int, sizes: list[int], counts: dict[int, int]) -> list[int]:
    """The pieces (longest first) that fill ``room`` with least waste. ``sizes``: ascending lengths with a count.

    Fillings are enumerated with longer pieces first, so a filling comes before
    those it dominates (where a piece is replaced by shorter ones). A branch
    ends when even the sizes left can't beat the incumbent's waste. After
    ``BRANCHES`` branches the least waste comes from fullest() instead, which
    is exact, too, but doesn't prefer longer pieces.
    """
    best: list[int] = []
    left = room
    k = bisect_right(sizes, left)
    used: dict[int, int] = {}
    while k and left:  # best fit, the first incumbent
        s = sizes[k - 1]
        if used.get(s, 0) < counts[s]:
            best.append(s)
            used[s] = used.get(s, 0) + 1
            left -= s
            k = min(k, bisect_right(sizes, left))
        else:
            k -= 1
    waste, tried = left, 0
    if not waste:
        return best
    least = sizes[0] if sizes else room + 1
    below = [0, *accumulate(s * counts[s] for s in sizes[: bisect_right(sizes, room)])]
    chosen: list[tuple[int, int]] = []
    found: list[tuple[int, int]] = []

    def branch(left: int, top: int) -> None:
        """Take copies of one of the ``top`` shortest lengths, then of shorter ones; as deep as a filling has lengths."""
        nonlocal found, waste, tried
        k = min(top, bisect_right(sizes, left))
        if not k or least > left:
            return
        if sizes[k - 1] == left and counts[left]:
            found, waste = [*chosen, (left, 1)], 0
        while k and waste and tried < BRANCHES:
            s = sizes[k - 1]
            if left - below[k] >= waste:  # all that is left of these sizes and shorter ones wastes as much
                return
            k -= 1
            for n in range(min(left // s, counts[s]), 0, -1):
                if not waste or tried >= BRANCHES:
                    return
                tried += 1
                chosen.append((s, n))
                if left - s * n < waste:
                    found, waste = list(chosen), left - s * n
                branch(left - s * n, k)
                chosen.pop()

    branch(room, len(below) - 1)
    if found:
        best = [s for s, n in found for _ in range(n)]
    if waste and tried >= BRANCHES:
        exact = fullest(room, sizes, counts)
        if sum(exact) > room - waste:
            return exact
    return best


def completed(counts: dict[int, int], capacity: int, spend_abundant: bool = False) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, repeats): each sequence takes the longest piece left and its fullest filling.

    With ``spend_abundant`` a filling holds as many pieces of the length that
    has most tokens left as an even filling allows, so that what is left in the
    end has many lengths; else a length of many copies may be all that is left.
    """
    counts = dict(counts)
    sizes, out = sorted(counts), []
    while sizes:
        longest = sizes[-1]
        counts[longest] -= 1
        room = capacity - longest
        common_length = max((s for s in sizes[: bisect_right(sizes, room)] if counts[s]), key=lambda s: (counts[s] * s, s), default=0) if spend_abundant else 0
        best: list[int] = []
        most = min(room // common_length, counts[common_length]) if common_length else 0
        goal = 0  # the fullest filling of all, once the first one leaves a gap
        for n in [*range(most, max(0, most - 64), -1), 0]:
            rest = counts | {common_length: counts[common_length] - n} if n else counts
            fill = [common_length] * n + complete(room - n * common_length, sizes, rest)
            if sum(fill) > sum(best):
                best = fill
            goal = goal or (room if sum(best) == room else sum(fullest(room, sizes, counts)))
            if sum(best) == goal:
                break
        counts[longest] += 1
        fill = [longest, *sorted(best, reverse=True)]
        out.append((fill, _use(fill, sizes, counts)))
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, repeats): best fit decreasing, sequence by sequence."""
    counts = dict(counts)
    sizes, out = sorted(counts), []
    while sizes:
        fill, left, k = [], capacity, len(sizes)
        taken: dict[int, int] = {}
        while k and (k := min(k, bisect_right(sizes, left))):
            s = sizes[k - 1]
            n = min(left // s, counts[s])
            fill += [s] * n
            left -= s * n
            taken[s] = n
            k -= 1
        out.append((fill, _use(fill, sizes, counts)))
    return out


def _use(fill: list[int], sizes: list[int], counts: dict[int, int]) -> int:
    """Take the filling from the counts as often as they allow."""
    need: dict[int, int] = {}
    for s in fill:
        need[s] = need.get(s, 0) + 1
    repeats = min(counts[s] // n for s, n in need.items())
    for s, n in need.items():
        counts[s] -= n * repeats
        if not counts[s]:
            del counts[s]
            sizes.remove(s)
    return repeats


def undominated(counts: dict[int, int], capacity: int, most: int, spend: Callable[[], None]) -> Iterator[list[int]]:
    """Fillings around the longest piece that waste ``most`` at most, but those that another one dominates.

    A filling is dominated if an unused piece fits beside it, or in the place
    of one or two of its pieces that are as long together at most. ``spend`` is
    called for each partial filling and each comparison.
    """
    sizes = sorted(counts)
    longest = sizes[-1]
    counts = counts | {longest: counts[longest] - 1}
    below = [0, *accumulate(s * counts[s] for s in sizes)]

    def free(s: int, taken: dict[int, int]) -> bool:
        return taken.get(s, 0) < counts[s]

    def dominated(left: int, taken: dict[int, int]) -> bool:
        rest = [s for s, n in taken.items() if n]
        ones = {s: s + 1 for s in rest}
        twos = {a + b: a + b for i, a in enumerate(rest) for b in rest[i:] if a != b or taken[a] > 1}
        for q, least in [(0, 1), *ones.items(), *twos.items()]:
            for k in range(bisect_right(sizes, least - 1), bisect_right(sizes, q + left)):
                spend()
                if free(sizes[k], taken):
                    return True
        return False

    def go(left: int, k: int, taken: dict[int, int]) -> Iterator[list[int]]:
        """Copies of one of the ``k`` shortest lengths, then of shorter ones; as deep as a filling has lengths."""
        spend()
        if left <= most and not dominated(left, taken):
            yield [longest, *(s for s, n in taken.items() for _ in range(n))]
        k = min(k, bisect_right(sizes, left))
        while k:
            s = sizes[k - 1]
            if left - below[k] > most:  # all that is left wastes too much
                return
            k -= 1
            for n in range(min(left // s, counts[s]), 0, -1):
                taken[s] = n
                yield from go(left - s * n, k, taken)
            taken.pop(s, None)

    yield from go(capacity - longest, len(sizes), {})


class _Spent(Exception):
    """A search used up its budget."""


def search(counts: dict[int, int], capacity: int, target: int, budget: int) -> list[list[int]] | None:
    """Bin completion: ``target`` sequences for all pieces, or None if there are none (or none within the budget).

    Each node fills the sequence around the longest piece left, least waste
    first; a node ends when the waste so far is more than ``target`` allows.
    """
    spare = target * capacity - sum(s * c for s, c in counts.items())
    if spare < 0:
        return None
    failed: set = set()

    def spend() -> None:
        nonlocal budget
        budget -= 1
        if budget < 0:
            raise _Spent

    def go(counts: dict[int, int], spare: int, left: int) -> list[list[int]] | None:
        if not counts:
            return []
        key = tuple(sorted(counts.items()))
        if not left or key in failed:
            return None
        for fill in sorted(undominated(counts, capacity, spare, spend), key=lambda f: (-sum(f), len(f))):
            rest = dict(counts)
            for s in fill:
                rest[s] -= 1
                if not rest[s]:
                    del rest[s]
            found = go(rest, spare - capacity + sum(fill), left - 1)
            if found is not None:
                return [fill, *found]
        failed.add(key)
        return None

    try:
        return go(counts, spare, target)
    except _Spent:
        return None


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs.

    For any ``short`` up to half the capacity: pieces above half can't share a
    sequence, those above capacity - short share it with nothing of ``short`` or
    more, and what the others leave open is all the room for the pieces between
    (Martello and Toth's second bound; ``short`` = 0 gives the bound of the sum).
    The capacity counts as the largest sum that the pieces can make at all.
    """
    sizes = sorted(s for s, c in counts.items() if c > 0)
    capacity = sum(fullest(capacity, sizes, counts)) or capacity
    n = [0, *accumulate(counts[s] for s in sizes)]
    sums = [0, *accumulate(s * counts[s] for s in sizes)]
    half, best = bisect_right(sizes, capacity // 2), 0
    for short in [0, *sizes[:half]]:
        lone, first = bisect_right(sizes, capacity - short), bisect_right(sizes, short - 1)
        alone, shared = n[-1] - n[lone], n[lone] - n[half]
        open_ = shared * capacity - (sums[lone] - sums[half])
        best = max(best, alone + shared + max(0, -(-(sums[half] - sums[first] - open_) // capacity)))
    return best


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int], int]]:
    """(first sequence, lengths in one sequence, repeats) for all pieces.

    The incumbent is the best of best fit and of both ways to complete one
    sequence after the other. While it has more sequences than lower_bound() asks for,
    its last ``TAIL`` sequences (all of them, in small cases) are searched for a
    packing with one sequence less.
    """
    counts = {s: c for s, c in histogram.items() if c > 0}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    used = lambda packed: sum(n for _, n in packed)
    packed = min(completed(counts, capacity), completed(counts, capacity, True), best_fit(counts, capacity), key=used)
    bound = lower_bound(counts, capacity)
    while used(packed) > bound:
        tail: dict[int, int] = {}
        kept, open_, room = [], 0, TAIL
        for fill, n in reversed(packed):
            free = min(n, room)
            if n > free:
                kept.append((fill, n - free))
            for s in fill if free else ():
                tail[s] = tail.get(s, 0) + free
            open_, room = open_ + free, room - free
        better = search(tail, capacity, open_ - 1, SEARCHED)
        if better is None:
            break
        packed = kept[::-1] + [(fill, 1) for fill in better]
    out, sequence = [], 0
    for fill, n in packed:
        out.append((sequence, fill, n))
        sequence += n
    return out


def slots(patterns: list[tuple[int, list[int], int]]) -> pd.DataFrame:
    """Rows (length, first_rank, sequence, each, offset): ranks from first_rank on take ``each`` places in a sequence."""
    next_rank: dict[int, int] = {}
    rows = []
    for sequence, fill, repeats in patterns:
        offset, at = 0, 0
        while at < len(fill):
            s, each = fill[at], 1
            while at + each < len(fill) and fill[at + each] == s:
                each += 1
            rows.append((s, next_rank.get(s, 0), sequence, each, offset))
            next_rank[s] = next_rank.get(s, 0) + each * repeats
            offset += s * each
            at += each
    return pd.DataFrame(rows, columns=["length", "first_rank", "sequence", "each", "offset"]).astype("int64")


def cut_pieces(docs: DataFrame, capacity: int, *, id_col: str, text_col: str, tokenizer: str | None, end_id: int) -> DataFrame:
    """Pieces with their ids, their task and their rank among the task's pieces of that length."""
    file = tokenizer or tokens.tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), tokens.encoder(file)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in common.sliced(batches, 1):
            for lo, _, ids, begins in enc.encode(common.raw_texts(batch.column(1)), end_id):
                size = np.diff(begins)
                many = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered)
                rank = np.empty(len(doc), dtype=np.int64)
                rank[order] = seen[ordered] + np.arange(len(doc)) - first
                seen += np.bincount(length, minlength=capacity + 1)
                offsets = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4", copy=False))])
                columns = [pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(rank), batch.column(0).take(pa.array(lo + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "local_rank", "doc_id", "piece", "start", "length", "ids"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset for every piece of every document."""
    spark = docs.sparkSession
    pieces = common.written(cut_pieces(docs, capacity, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id), "pieces")
    by_part = common.written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = slots(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if by_part.count() <= BROADCAST_ROWS:
        ranks = F.broadcast(ranks)
    ranked = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("first") + F.col("local_rank"))

    key = places["length"].to_numpy() if len(places) else np.zeros(0, np.int64)
    order = np.lexsort((places["first_rank"].to_numpy(), key)) if len(places) else np.zeros(0, np.int64)
    lengths, firsts, sequences, eaches, offsets = (places[c].to_numpy()[order] for c in ("length", "first_rank", "sequence", "each", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = np.searchsorted(lengths, np.arange(capacity + 2))
        shift = int(firsts.max()) + 1 if len(firsts) else 1
        both = lengths * shift + firsts
        for batch in batches:
            n, rank = batch.column(4).to_numpy(), batch.column(6).to_numpy()
            at = np.searchsorted(both, n * shift + np.minimum(rank, shift - 1), side="right") - 1
            assert (at >= lo[n]).all()
            nth = rank - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in (1, 2, 3, 4, 5)), pa.array(sequences[at] + nth // eaches[at]), pa.array(offsets[at] + nth % eaches[at] * n)],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    return ranked.select("part", "doc_id", "piece", "start", "length", "ids", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.spread(common.table(spark, sf_dir, "documents"))))
