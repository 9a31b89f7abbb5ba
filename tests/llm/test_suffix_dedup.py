import hashlib
import random

import numpy as np
import pytest

from tomespark.llm import suffix_dedup as d


def brute(texts, span):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for b in raws:
        for i in range(len(b) - span + 1):
            seen[b[i : i + span]] = seen.get(b[i : i + span], 0) + 1
    out = []
    for b in raws:
        marks = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                marks[i : i + span] = b"\1" * span
        runs = [(i, marks.index(0, i) if 0 in marks[i:] else len(b)) for i in range(len(b)) if marks[i] and (i == 0 or not marks[i - 1])]
        out.append((len(b), runs, bytes(x for x, m in zip(b, marks) if not m)))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = [word(n) for n in (60, 199, 200, 201, 260, 600)]
    texts = []
    for _ in range(60):
        texts.append("".join(rng.choice([word(rng.randint(1, 150)), rng.choice(shared), word(5)]) for _ in range(rng.randint(1, 9))))
    line = word(150)  # a hot line of less than a span: many contexts, few repeats
    tails = [word(60) for _ in range(5)]
    texts += [word(120) + line + rng.choice([word(100), rng.choice(tails) + word(60)]) for _ in range(90)]
    texts += [None, "", "x", "ab" * 900, "z" * 1500, "z" * 199, word(40_000)]
    return texts + texts[:7] + [texts[60]]


@pytest.mark.parametrize("split,shard,seed", [(3000, 3000, 1), (10, 20, 2), (1, 5, 3)])
def test_matches_brute_force(spark, monkeypatch, split, shard, seed):
    monkeypatch.setattr(d, "SPLIT", split)
    monkeypatch.setattr(d, "SHARD", shard)
    texts = made(seed)
    rows = [(i if i % 50 else None, t, "clash", 1, i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, a string, start int, n long").repartition(3)
    want = {}
    for (i, t, *_), x in zip(rows, brute(texts, 200)):
        want.setdefault((i, hashlib.md5((t or "").encode()).hexdigest() if i is None else ""), []).append(x)
    got = d.remove_repeats(frame).collect()
    assert len(got) == len(rows)
    flat = sorted((r["doc_id"] or -1, r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in got)
    assert flat == sorted((i or -1, *x) for (i, _), xs in want.items() for x in xs)


def test_a_hot_line_twice_in_otherwise_unique_texts(spark, monkeypatch):
    monkeypatch.setattr(d, "SPLIT", 5)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    lines = [word(72) for _ in range(2000)]
    line = min(lines, key=lambda x: d.Prints(np.frombuffer(x.encode(), np.uint8)).all(d.GRAM).min())  # its gram is the anchor of most strings
    texts = [word(180) + line + word(12) + line + word(180) for _ in range(40)]
    tail = word(100)  # and one string that repeats in three texts
    texts += [word(180) + line + word(12) + line + tail + line + tail + word(70) for _ in range(3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in d.remove_repeats(frame).collect())
    want = [(i, *x) for i, x in enumerate(brute(texts, 200))]
    assert got == want
    assert not any(runs for _, _, runs, _ in want[:40]) and all(runs for _, _, runs, _ in want[40:])


def test_empty(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert d.remove_repeats(frame.limit(0)).count() == 0
    assert d.remove_repeats(frame).collect()[0]["kept"] == b"a"


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    for text in [b"a", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"abcabcabcabcabcabcabcabc", bytes(rng.choices(b"ab", k=400)), bytes(rng.choices(b"abcdefghij", k=300)) * 2]:
        order = d.suffix_array(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lengths = np.array([len(text) // 3, len(text) - len(text) // 3])
        shared = d.common_prefixes(np.frombuffer(text, np.uint8), order, np.array([0, lengths[0]]), lengths, 50)
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while n < 50 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def test_query_returns_the_contract_columns(spark, tmp_path):
    texts = made(5)[:90]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in d.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for i, (n, runs, kept) in enumerate(brute(texts, 200))}
