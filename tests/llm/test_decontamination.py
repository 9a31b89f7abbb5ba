import random

import pytest

from tomespark.llm import decontamination as d


def made(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([5, 6, 9, 12, 13, 20, 21, 33, 40, 69, 150])]
    docs = []
    for n, (_, text) in enumerate(items):
        for k, broken in enumerate((0, 1, 2, 5)):
            own = text.split()
            for _ in range(broken):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            around = rng.choices(vocab, k=rng.choice([0, 3, 400, 5000]))
            at = rng.randrange(len(around) + 1)
            docs.append((100 * n + k, " ".join(around[:at]) + ", " + " ".join(own).upper() + "! " + " ".join(around[at:])))
    half = items[-1][1].split()
    docs.append((9000, " ".join(half[:75]) + " x" * 2000 + " " + " ".join(half[75:])))
    items += [(50, None), (51, ""), (52, "two words"), (53, items[5][1]), (None, "no id at all here")]
    docs += [(9001, None), (9002, ""), (9003, "Two, words."), (9004, "two words more"), (9005, items[0][1]), (9005, items[0][1]), (None, items[1][1])]
    return docs, items


def brute(docs, items, share):
    def sets(t):
        w = d.normal([t])[0].split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    asked = [(i, sets(t)) for i, t in items if i is not None and sets(t)]
    out = []
    for n, t in docs:
        own = sets(t)
        out += [(n, i, len(z), len(z & own)) for i, z in asked if len(z & own) >= share * len(z) - 1e-9]
    return sorted(out, key=str)


@pytest.mark.parametrize("share,block", [(0.8, 20_000), (0.5, 4), (1.0, 5)])
def test_matches_all_pairs(spark, monkeypatch, share, block):
    monkeypatch.setattr(d, "ITEM_BLOCK", block)
    docs, items = made()
    frame = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, item_id int, n_item string").repartition(3)
    asked = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, doc_id int")
    got = d.find_items(frame, asked, share=share).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got), key=str) == brute(docs, items, share)
    kept = d.decontaminate(frame, asked, share=share)
    assert kept.columns == frame.columns
    hit = {r[0] for r in brute(docs, items, share)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(n) for n, _ in docs if n is None or n not in hit)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.find_items(docs.limit(0), items).count() == 0
    assert d.find_items(docs, items.limit(0)).count() == 0
    assert d.find_items(docs, items).count() == 1


def test_items_of_one_or_two_shingles_are_found(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=5 + i % 2))) for i in range(20)]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(20, 60)) + [items[k % 20][1]] + rng.choices(vocab, k=rng.randint(20, 60)))) for k in range(1500)]
    got = d.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got), key=str) == brute(docs, items, 0.8)
