import random
import re
from collections import Counter

import numpy as np
import pytest

from tomespark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "p", 0.5) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)


def plain(rows, least, top):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            sizes[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    known = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= least}
    longest = Counter()
    for (lang, p), f in known.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longest[lang, p[i : i + k]] = max(longest[lang, p[i : i + k]], f)
    out = []
    for lang in sizes:
        best = []
        for (x, p), a in known.items():
            if x == lang and not (longest[x, p] and 100 * longest[x, p] >= 80 * a):
                cuts = [(2000000 * a // (counts[x, p[:k]] + counts[x, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), counts[x, p[:k]], counts[x, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def made(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a\x01", "a", "über", "ÜBER", "machine", "learning", "new", "york", "times", "\x00", "x'y", "𝒳", "a\x02b"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choices(words, weights=range(len(words), 0, -1))[0] + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", " \x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [("new york times " * 40, "en")] * 30 + [(None, "en"), ("", None), ("...", "fr"), ("one", "fr")]


@pytest.mark.parametrize("limit,top,hot", [(4_000_000, 2000, 0.001), (0, 2000, 0.001), (4_000_000, 7, 0.001), (0, 2000, 0.0)])
def test_equals_plain_code(spark, monkeypatch, limit, top, hot):
    monkeypatch.setattr(phrases.common, "SLICE_BYTES", 4000)
    monkeypatch.setattr(phrases.common, "HOT_SHARE", hot)
    rows = made(3)
    got = phrases.collocations(frame(spark, rows), top=top, broadcast_words=limit)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, 30, top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 15


def test_hot_first_words_are_dealt(spark):
    rows = spark.createDataFrame([(1, i % 50 + 1, i % 7 + 1, 0, 2) for i in range(3000)] + [(2, 3, 0, 0, 40)], "w1 long, w2 long, w3 long, w4 long, n long")
    want = sorted(tuple(r) for r in phrases.count_phrases(rows, [], 30).collect())
    assert sorted(tuple(r) for r in phrases.count_phrases(rows, [1], 30).collect()) == want
    assert (2, 3, 0, 0, 40) in want and (1, 1, 0, 0, 120) in want


def test_stack_over_any_batches():
    rng = np.random.default_rng(2)
    rows = rng.integers(1, 3, (400, 4))
    for j in range(1, 4):
        rows[:, j] *= (rows[:, j - 1] > 0) & (rng.random(400) < 0.8)
    rows = rows[rows[:, 1] > 0]
    rows = rows[np.lexsort(rows.T[::-1])][::-1]
    n = rng.integers(1, 5, len(rows))
    want = Counter()
    for row, k in zip(rows.tolist(), n.tolist()):
        for j in range(2, 5):
            if row[j - 1]:
                want[tuple(row[:j] + [0] * (4 - j))] += k
    for size in (1, 3, 1000):
        stack, got = phrases.PrefixStack(), Counter()
        for part in [stack.push(rows[a : a + size], n[a : a + size], 0, np.array([])) for a in range(0, len(rows), size)] + [stack.end(0, np.array([]))]:
            for key, f in zip(part[0].tolist(), part[1].tolist()):
                if f or tuple(key) in want:
                    assert tuple(key) not in got
                    got[tuple(key)] = f
        assert got == want


def test_words_that_share_a_hash_get_others(spark, monkeypatch):
    texts = phrases.texts_of(frame(spark, [("alpha beta gamma " * 20, "en"), ("beta gamma " * 20, "de")]), "text", "lang")
    true, seeds = phrases.count_words, []

    def colliding(texts, seed=0):
        seeds.append(seed)
        words = true(texts, seed)
        return words.withColumn("hash", phrases.F.when(phrases.F.col("lang") == "en", 5).otherwise(words["hash"])) if seed < 4 else words

    monkeypatch.setattr(phrases, "count_words", colliding)
    words, seed = phrases.distinct_words(texts)
    assert seed == 4 and seeds == [0, 2, 4]
    assert {tuple(r) for r in words.select("lang", "word", "f").collect()} == {("en", "alpha", 20), ("en", "beta", 20), ("en", "gamma", 20), ("de", "beta", 20), ("de", "gamma", 20)}


def test_counts_beyond_64_bit_products(spark):
    big = 7_000_000_000_000_000_000
    known = spark.createDataFrame([(1, 0, 0, 0, big), (2, 0, 0, 0, big), (1, 2, 0, 0, big - 1)], "w1 long, w2 long, w3 long, w4 long, f long")
    got = phrases.scored(known.filter("w2 > 0"), known).collect()
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in got] == [(big - 1, big, big, 2000000 * (big - 1) // (2 * big))]


def test_empty(spark):
    assert phrases.collocations(frame(spark, [("a b", "en")]).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("", "en")])).count() == 0


def test_slices_of_texts_are_small():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 20_000] * 100), pa.array(["en"] * 100)], names=["text", "lang"])  # 10 MB
    slices = list(phrases._slices([batch]))
    assert sum(len(texts) for texts, _ in slices) == 100
    assert max(sum(map(len, texts)) for texts, _ in slices) <= phrases.SLICE_BYTES + 100_000 < 4 << 20
