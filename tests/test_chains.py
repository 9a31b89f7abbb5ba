import random

from tomespark.operators import chains


def plain(pairs):
    to, out = dict(pairs), []
    for n in to:
        at, k, seen = n, 0, set()
        while at not in seen and to[at] in to:
            seen.add(at)
            at, k = to[at], k + 1
        out.append((n, None, None, True) if at in seen else (n, at, k, False))
    return sorted(out)


def got(spark, pairs):
    rows = spark.createDataFrame(pairs, "page long, back long").repartition(3)
    return sorted(map(tuple, chains.follow(rows, "page", "back").collect()))


def test_chains_trees_cycles_and_dangling_pointers(spark):
    rng = random.Random(2)
    pairs = [(i, i - 1 if i else None) for i in range(300)]  # one long chain
    pairs += [(1000 + i, rng.choice([None, 5000, *range(1000, 1000 + i)]) if i else None) for i in range(60)]  # rows that share a pointer
    pairs += [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (2004, 2004)]  # cycles, and a way into one
    assert got(spark, pairs) == plain(pairs)


def test_empty(spark):
    rows = spark.createDataFrame([(1, 2)], "page long, back long").limit(0)
    assert chains.follow(rows, "page", "back").count() == 0


def test_contraction_gives_the_same_and_moves_a_few_times_the_rows(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(i, i - 1 if i else None) for i in range(3000)]  # one long chain, which doubling alone writes in each of its rounds
    pairs += [(5000 + i, rng.choice([None, 9999, *range(5000, 5000 + i)]) if i else None) for i in range(60)]
    pairs += [(7000 + i, 7000 + (i + 1) % 40) for i in range(40)] + [(7100, 7003), (7101, 7100), (7200, 7200)]  # a ring, ways into it
    monkeypatch.setattr(chains, "FEW_ROWS", 400)
    written, kept = [], chains.shared_folder
    monkeypatch.setattr(chains, "shared_folder", lambda s, n: written.append(kept(s, n)) or written[-1])
    sizes, gone = [], chains.deleted
    monkeypatch.setattr(chains, "deleted", lambda s, p: sizes.append(s.read.parquet(p).count()) or gone(s, p))
    assert got(spark, pairs) == plain(pairs)
    assert sum(sizes) < 8 * len(pairs)
