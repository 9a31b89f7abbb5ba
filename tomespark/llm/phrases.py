"""Phrase collocations by Suffix-sigma: sorted suffixes of at most four words and one stack that counts their prefixes.

1. Words are counted for each language; two words with one 64-bit hash would be
   found here, and other hashes taken. Only words that are frequent enough can
   stand in a frequent phrase, so texts are split at the others too.
2. Each place gives the suffix of at most four words that begins there. Equal
   ones of a slice of texts are one row with a count. Rows are shuffled by
   language and first word; those of a hot first word are dealt by their second
   and third word as well.
3. A task sorts its rows in falling order and holds one stack, the prefixes of
   the row at hand. A prefix that the next row doesn't have is complete: it goes
   out if it is frequent enough. Prefixes of two words under a hot first word may
   have been counted in several tasks; they go out in any case and are summed.
4. Counts of a phrase's parts are joined, and phrases that a longer one covers
   are dropped.

A word is known by its code: its place in the sorted list of frequent words'
hashes while that list is small enough to be sent to every worker (BROADCAST_WORDS
entries), beyond that its hash. Both ways give the same rows.

Defined cases: a null text is empty, a null language is ``und``; rows that
repeat count each; texts of any length are read as a whole; document ids aren't
read; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, shingles

MAX_WORDS, LEAST, TOP = 4, 30, 2000
COVERED = (80, 100)
#: Frequent words of all languages that are sent to every worker, at most: 8 bytes each.
BROADCAST_WORDS = 4_000_000
#: Bytes of text whose words are arrays at once, about: some 25 times as many bytes.
SLICE_BYTES = 2 << 20
HASHES = [f"w{j}" for j in range(1, MAX_WORDS + 1)]

_GAP, _BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def _words(texts: list[bytes], langs: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: the buffer, first byte, end, hash of language and word, number of the piece, number of the text."""
    buf = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", dtype=np.uint8)  # bytes.lower() changes A-Z only
    gap = _GAP[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    piece = np.cumsum(_BREAK[buf])[starts]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    text = np.searchsorted(np.cumsum(lengths), starts - 1, side="right")
    of_lang = {x: shingles.run_hashes(np.frombuffer(b"\0" + x.encode(), dtype=np.uint8), np.array([1]), np.array([1 + len(x.encode())]), seed + 1)[0] for x in set(langs)}
    hashes = shingles.run_hashes(buf, starts, ends, seed) ^ np.array([of_lang[x] for x in langs], dtype=np.uint64)[text] if len(starts) else np.zeros(0, dtype=np.uint64)
    return buf, starts, ends, shingles.mix(hashes).view(np.int64), piece, text


def _slices(batches) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages, in slices of bounded bytes."""
    for part in common.sliced(batches, 0, SLICE_BYTES):
        yield common.raw_texts(part.column(0)), part.column(1).to_pylist()


def texts_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))


def count_words(texts: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, hash, f: how often each word occurs in each language."""

    def words(batches):
        import pyarrow as pa

        for texts, langs in _slices(batches):
            buf, starts, ends, hashes, _, text = _words(texts, langs, seed)
            if not len(starts):
                continue
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            raw = buf.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs[t] for t in text[first].tolist()], pa.string()),
                    pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.string()),
                    pa.array(found),
                    pa.array(n.astype(np.int64)),
                ],
                names=["lang", "word", "hash", "f"],
            )

    rows = texts.mapInArrow(words, "lang string, word string, hash bigint, f bigint")
    return rows.groupBy("lang", "word", "hash").agg(F.sum("f").alias("f"))


def distinct_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """count_words() as a written table, with the first seed under which no two words share a hash."""
    for seed in range(0, 40, 2):
        words = common.written(count_words(texts, seed), "words")
        if words.groupBy("hash").count().filter("count > 1").isEmpty():
            return words, seed
        common.released(words)
    raise ValueError("words share their hash under every seed")


def _broadcast_codes(frequent: DataFrame, limit: int):
    """The sorted hashes of the frequent words on every worker, or nothing if there are more than ``limit``."""
    if frequent.limit(limit + 1).count() > limit:
        return None
    hashes = np.sort(np.array([r["hash"] for r in frequent.select("hash").toLocalIterator()], dtype=np.int64))
    return frequent.sparkSession.sparkContext.broadcast(hashes)


def _coded(hashes: np.ndarray, table) -> np.ndarray:
    """Codes of words: places in ``table`` from 1 on, 0 for words that it lacks; without a table the hashes."""
    if table is None:
        return np.where(hashes == 0, 1, hashes)
    known = table.value
    if not len(known):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


def suffixes(texts: DataFrame, seed: int, table) -> DataFrame:
    """w1 to w4 (0: none) and n: the distinct suffixes of at least two words of each slice."""

    def rows(batches):
        import pyarrow as pa

        for texts, langs in _slices(batches):
            _, starts, _, hashes, piece, _ = _words(texts, langs, seed)
            codes = _coded(hashes, table)
            cols = [codes]
            for j in range(1, MAX_WORDS):
                then = np.zeros_like(codes)
                if len(codes) > j:
                    same = (piece[j:] == piece[:-j]) & (cols[-1][: len(codes) - j] != 0)
                    then[: len(codes) - j] = np.where(same, codes[j:], 0)
                cols.append(then)
            keep = (cols[0] != 0) & (cols[1] != 0)
            cols = [c[keep] for c in cols]
            if not len(cols[0]):
                continue
            at = np.lexsort(cols[::-1])
            cols = [c[at] for c in cols]
            new = np.ones(len(at), dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            cols = [c[first] for c in cols]
            for a in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[a : a + (1 << 16)]) for c in cols), pa.array(n[a : a + (1 << 16)])], names=[*HASHES, "n"])

    return texts.mapInArrow(rows, ", ".join(f"{c} bigint" for c in [*HASHES, "n"]))


class PrefixStack:
    """The open prefixes of two to four words, their codes and their counts so far."""

    def __init__(self) -> None:
        self.codes = np.zeros(MAX_WORDS, dtype=np.int64)
        self.counts = [0] * (MAX_WORDS + 1)

    def push(self, rows: np.ndarray, n: np.ndarray, least: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take sorted rows; give the prefixes that are complete, and their counts."""
        rows = np.vstack([self.codes, rows])
        change = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)  # whether a prefix of each length ends before the row
        out, counts = [], []
        for j in range(2, MAX_WORDS + 1):
            begins = np.concatenate([[0], np.flatnonzero(change[:, j - 1]) + 1])
            sums = np.add.reduceat(np.concatenate([[self.counts[j]], n]), begins)
            self.counts[j] = int(sums[-1])
            done, sums = rows[begins[:-1]], sums[:-1]
            keep = (done[:, j - 1] != 0) & ((sums >= least) | ((j == 2) & np.isin(done[:, 0], hot)))
            done = done[keep]
            done[:, j:] = 0
            out.append(done)
            counts.append(sums[keep])
        self.codes = rows[-1]
        return np.concatenate(out), np.concatenate(counts)

    def end(self, least: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Close every open prefix."""
        return self.push(np.zeros((1, MAX_WORDS), dtype=np.int64), np.zeros(1, dtype=np.int64), least, hot)


def count_phrases(rows: DataFrame, hot: list[int], least: int) -> DataFrame:
    """w1 to w4 and f for phrases of at least two words that occur ``least`` times; ``hot``: codes of hot first words."""
    salt = F.when(F.col("w1").isin(hot), F.pmod(F.xxhash64("w2", "w3"), F.lit(common.SALTS))).otherwise(F.lit(0)) if hot else F.lit(0)
    ordered = rows.repartition(F.col("w1"), salt).sortWithinPartitions(*(F.desc(c) for c in HASHES))
    hot_codes = np.array(sorted(hot), dtype=np.int64)

    def prefixes(batches):
        import pyarrow as pa

        def batch(found: np.ndarray, counts: np.ndarray):
            return pa.RecordBatch.from_arrays([*(pa.array(found[:, j]) for j in range(MAX_WORDS)), pa.array(counts)], names=[*HASHES, "f"])

        stack = PrefixStack()
        for b in batches:
            if b.num_rows:
                cols = [b.column(j).to_numpy() for j in range(MAX_WORDS + 1)]
                yield batch(*stack.push(np.stack(cols[:-1], axis=1), cols[-1], least, hot_codes))
        yield batch(*stack.end(least, hot_codes))

    found = ordered.mapInArrow(prefixes, ", ".join(f"{c} bigint" for c in [*HASHES, "f"]))
    return found.groupBy(*HASHES).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _code(j: int) -> Column:
    return F.col(HASHES[j])


def _part(first: int, last: int) -> list[Column]:
    """The codes of words first to last - 1 of a phrase, moved to the front."""
    return [(_code(first + j) if first + j < last else F.lit(0).cast("bigint")).alias(HASHES[j]) for j in range(MAX_WORDS)]


def _with_part(cuts: DataFrame, known: DataFrame, side: str) -> DataFrame:
    """Join the count of the part in the struct ``side``, rows of a hot part dealt among tasks."""
    key = F.col(side)
    rows = cuts.withColumn("__key", key)
    uses = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("uses"))
    counts = uses.join(known.select(F.struct(*HASHES).alias("__key"), F.col("f").alias(side[0])), "__key")
    total = cuts.count()
    return common.with_counts(rows, counts, ["__key"], F.xxhash64("phrase"), total, n="uses").drop("__key", "uses", side)


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases with a, l, r and score of their lowest cut, without those that a longer one covers.

    ``phrases``: w1 to w4 and f; ``known``: the same for all parts, single words included.
    """
    length = sum((F.when(_code(j) != 0, 1).otherwise(0) for j in range(1, MAX_WORDS)), F.lit(1))
    named = phrases.select(F.struct(*HASHES).alias("phrase"), *HASHES, F.col("f").alias("a"), length.alias("words"))
    every = [(n, k) for n in range(2, MAX_WORDS + 1) for k in range(1, n)]
    options = [F.when(F.col("words") == n, F.struct(F.lit(k).alias("k"), F.struct(*_part(0, k)).alias("left"), F.struct(*_part(k, n)).alias("right"))) for n, k in every]
    cuts = common.written(named.select("phrase", "a", F.explode(F.array_compact(F.array(*options))).alias("cut")).select("phrase", "a", "cut.k", "cut.left", "cut.right"), "phrase-cuts")
    parts = _with_part(_with_part(cuts, known, "left"), known, "right")
    wide = "decimal(38,0)"
    score = F.expr(f"cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) as {wide}) div cast(cast(l as decimal(20,0)) + cast(r as decimal(20,0)) as {wide})")
    lowest = parts.withColumn("score", score).groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    inner = [(n, i, k) for n in range(3, MAX_WORDS + 1) for k in range(2, n) for i in range(n - k + 1)]
    held = [F.when(F.col("words") == n, F.struct(*_part(i, i + k))) for n, i, k in inner]
    longest = named.filter("words > 2").select(F.explode(F.array_compact(F.array(*held))).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("longer"))
    covered = COVERED[1] * F.col("longer").cast(wide) >= COVERED[0] * F.col("a").cast(wide)
    return lowest.join(longest, "phrase", "left").filter(F.col("longer").isNull() | ~covered).select("phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language."""
    texts = texts_of(docs, text_col, lang_col)
    words, seed = distinct_words(texts)
    frequent = words.filter(F.col("f") >= least)
    table = _broadcast_codes(frequent, broadcast_words)

    def coded(batches):
        import pyarrow as pa

        for b in batches:
            codes = pa.array(_coded(b.column(1).to_numpy(), table))
            yield pa.RecordBatch.from_arrays([b.column(0), codes, b.column(2), b.column(3)], names=["lang", "code", "f", "word"])

    known_words = common.written(frequent.select("lang", "hash", "f", "word").mapInArrow(coded, "lang string, code bigint, f bigint, word string"), "frequent-words")
    total = words.agg(F.sum("f")).first()[0] or 0
    hot = [r["code"] for r in known_words.filter(F.col("f") > max(1000, int(total * common.HOT_SHARE))).select("code").collect()]
    phrases = common.written(count_phrases(suffixes(texts, seed, table), hot, least), "phrases")
    single = known_words.select(F.col("code").alias("w1"), *(F.lit(0).cast("bigint").alias(c) for c in HASHES[1:]), "f")
    best = scored(phrases, phrases.unionByName(single))

    # Ties are broken by the words themselves, so phrases that may be among the best take their words first.
    first = best.withColumn("code", F.col("phrase.w1")).join(known_words.select("code", "lang"), "code").drop("code")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    close = common.written(first.withColumn("near", F.rank().over(order)).filter(F.col("near") <= top).drop("near"), "best-phrases")
    spelled = (
        close.select("phrase", F.posexplode(F.array(*(F.col(f"phrase.{c}") for c in HASHES))).alias("i", "code")).filter(F.col("code") != 0)
        .join(known_words.select("code", "word"), "code")
        .groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("words"))
    )
    ranked = close.join(spelled, "phrase").withColumn("rank", F.row_number().over(order_by_words()).cast("long")).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", F.col("words").alias("phrase"), "a", "l", "r", "n", "score")


def order_by_words() -> Window:
    return Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "words")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.spread(common.table(spark, sf_dir, "documents")))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT doc, lang, generate_subscripts(ps, 1) AS piece, unnest(ps) AS piece_text FROM (SELECT doc, lang, regexp_split_to_array(t, '[.,;:!?
-
]') AS ps FROM d)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece_text, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i + k - 1] AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k))),
c AS (SELECT lang, k AS words, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE words = 1 GROUP BY lang),
candidates AS (SELECT * FROM c WHERE words > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, f AS a, k, phrase[1:k] AS head, phrase[k + 1:] AS rest FROM candidates, (VALUES (1), (2), (3)) AS ks(k) WHERE k < words),
scores AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
           FROM cuts JOIN c l ON l.lang = cuts.lang AND l.phrase = head JOIN c r ON r.lang = cuts.lang AND r.phrase = rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, phrase[i:i + k - 1] AS phrase, max(f) AS longer
                FROM candidates, (VALUES (2), (3)) AS ks(k), (VALUES (1), (2), (3)) AS starts(i) WHERE k < words AND i + k - 1 <= words GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_parts x ON x.lang = lowest.lang AND x.phrase = lowest.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
ranked AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
