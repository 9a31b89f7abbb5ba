import random

import pytest

from tomespark.llm import components, near_dedup, shingles

SCHEMA = "doc_id long, text string, id long, n long, label string"


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\x1c").encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return sorted((d, len(s), None if d is None else find(d) if s else d) for (d, _), s in zip(rows, sets))


def made(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for length in (3, 5, 30, 80, 120, 400):
        for _ in range(3):
            base = rng.choices(words, k=length)
            for _ in range(6):
                own = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                    own[rng.randrange(length)] = rng.choice(words)
                rows.append((n, " ".join(own)))
                n += 1
    hot = rng.choices(words, k=150)  # a chain of near copies
    for k in range(60):
        rows.append((n, " ".join(hot)))
        hot[rng.randrange(150)] = f"new{k}"
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "Ein Wort"), (n + 4, "EIN wort"), (n + 5, "É b c"), (n + 6, "é b c"), (n + 7, "ein\x1cwort"), (None, "w1 w2 w3 w4"), (n + 8, "w1 w2 w3 w4")]
    return rows


@pytest.mark.parametrize("words,similarity,block,size", [(3, 0.85, 400, 1 << 18), (5, 0.8, 10, 700)])
def test_matches_all_pairs(spark, monkeypatch, words, similarity, block, size):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", size)
    rows = made()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(d, t, 7, 8, "x") for d, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(docs, words=words, similarity=similarity).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows, words, round(100 * similarity)) if None not in {d for d, _ in rows} else [(d, n, c) for d, n, c in brute_sorted(rows, words, similarity)], key=key)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def brute_sorted(rows, words, similarity):
    named = [(d if d is not None else -1, t) for d, t in rows]
    found = brute([r for r in named if r[0] >= 0], words, round(100 * similarity))
    alone = brute([(0, t) for d, t in named if d < 0], words, 100)
    return found + [(None, n, None) for _, n, _ in alone]


def test_rows_that_share_an_id_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d", 0, 0, ""), (1, "e f g h", 0, 0, ""), (2, "e f g h", 0, 0, ""), (2, "e f g h", 0, 0, "")], SCHEMA)
    got = near_dedup.near_duplicates(docs, words=3, similarity=0.85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (2, 1)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_shingles_of_short_and_long_texts():
    texts = [b"", b"a", b"a b", b"a b c", b"a b c d", b"b c", b" a\x0bb\x0cc ", b"x " * 9]
    found, begins = shingles.shingle_hashes(texts, 3)
    sets = [set(found[begins[i] : begins[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [0, 1, 1, 1, 2, 1, 1, 1]
    assert sets[3] == sets[6] and sets[3] < sets[4] and not sets[2] & sets[5]


def test_query_returns_the_contract_columns(spark, tmp_path):
    rows = [r for r in made(6) if r[0] is not None]
    rows.append((9001, "long " * 60_000 + " ".join(f"w{i}" for i in range(3000))))
    rows.append((9002, "long " * 60_000 + " ".join(f"w{i}" for i in range(2990))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op8_near_dedup(spark, str(tmp_path)).collect())
    assert got == [(d, n, c, d == c) for d, n, c in brute(rows, 3, 85)]
    assert (9002, 9001) in {(d, c) for d, _, c, _ in got}


def test_hot_copies_and_a_hot_template(spark):
    copy = "one two three four five six seven eight"
    stem = " ".join(f"s{i}" for i in range(19))
    rows = [(i, copy) for i in range(1500)] + [(2000 + i, f"{stem} last{i}") for i in range(1200)] + [(5000 + i, f"own{i} " * 6 + str(i)) for i in range(300)] + [(None, copy)] * 1200 + [(8000 + i, None) for i in range(1100)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=0.8).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert found == {d: 0 if d < 1500 else 2000 if d < 5000 else d for d, _ in rows if d is not None}
    assert all(r["kept"] for r in got if r["doc_id"] is None) and sum(r["kept"] for r in got) == 2 + 300 + 1200 + 1100
