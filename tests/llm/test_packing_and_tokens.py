import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomespark.llm import common, packing, token_output, tokens

TEXTS = ["don't stop <|endoftext|> x", "", None, "Été à la plage, à midi !", "a " * 5000, "x" * 3000, "\x1c odd\x85space here", "same words", "same words", "ﬁ İ ΑΣ. 12 3a's"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "clash", t, 1) for i, t in enumerate(TEXTS)] + [(3, "again", "a repeated id", 2), (None, "no id", "null id", 3)]
    return spark.createDataFrame(rows, "doc_id long, part string, text string, length int").repartition(3)


def plain(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.tokenizer_path()).encode(text or "", add_special_tokens=False).ids, end]


def assert_like_library(enc, texts):
    wanted = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    for lo, hi, ids, begins in enc.encode([t.encode() for t in texts]):
        for i in range(lo, hi):
            assert ids[begins[i - lo] : begins[i - lo + 1]].tolist() == wanted[i].ids, ascii(texts[i])


def test_encoder_matches_library_with_small_caches(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 5)
    monkeypatch.setattr(tokens, "CHUNK", 300)
    enc = tokens.Encoder(tokens.tokenizer_path())
    for _ in range(2):
        assert_like_library(enc, [t or "" for t in TEXTS])
    (one,) = enc.encode([b"", b"a b"], 7)
    assert one[3].tolist() == [0, 1, 4] and one[2][[0, 3]].tolist() == [7, 7]


def test_encoder_matches_library_on_odd_strings():
    rng = random.Random(5)
    enc = tokens.Encoder(tokens.tokenizer_path())
    pool = [*"abcXYZ  09'\"!.,-_<|>/\x00\x1c\x1f\x7f\t\n", *"éÉİßẞ\u0301\u0307\u0331ẖ×÷\xa0\x85ŉǰǄǅɏɐſKÅﬁ你😀\u200b’٣²½ⅧªµΣς\u0345", "H\u0331", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "'Re"]
    assert_like_library(enc, ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(20_000)])
    anything = lambda: chr(rng.choice([rng.randint(1, 0x250), rng.randint(1, 0x7F), rng.randint(0x300, 0x370), rng.randint(1, 0xD7FF)]))
    assert_like_library(enc, ["".join(anything() for _ in range(rng.randint(1, 8))) for _ in range(20_000)])
    punctuation = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    assert_like_library(enc, ["a" * k + chr(c) + p for c in range(0x300) for p in punctuation for k in (0, 1)])


def test_encoder_takes_other_tokenizer_files():
    enc = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert not enc.by_units
    assert_like_library(enc, ["two  spaces and it's", "", "x"])


def test_token_files_round_trip(spark, docs):
    path = common.shared_folder(spark, "t")
    token_output.write_tokens(docs, path)
    rows = token_output.read_tokens(spark, path).collect()
    assert len(rows) == len(TEXTS) + 2
    by_start = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in by_start:
        assert r["start"] == at and r["n_tokens"] == len(r["token_ids"])
        at += r["n_tokens"]
    for i, text in enumerate(TEXTS):
        if i != 3:
            (r,) = [r for r in rows if r["doc_id"] == i]
            assert r["token_ids"] == plain(text, 2)
    assert {r["doc_id"] for r in token_output.lookup_tokens(spark, path, [4, 99]).collect()} == {4}
    crcs = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_output.digest(token_output.read_tokens(spark, path)).collect()}
    assert crcs == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["token_ids"], "<u4").tobytes()) for r in rows}


def test_empty_tables(spark, docs):
    path = common.shared_folder(spark, "t")
    token_output.write_tokens(docs.limit(0), path)
    assert token_output.digest(token_output.read_tokens(spark, path)).count() == 0
    assert packing.digest(packing.pack(docs.limit(0))).count() == 0


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_pack_places_every_id_once(docs, capacity):
    rows = packing.pack(docs, capacity=capacity).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        if r["doc_id"] is not None and r["doc_id"] != 3:
            assert r["start"] == len(ids.setdefault(r["doc_id"], b"")) // 4
            ids[r["doc_id"]] += bytes(r["ids"])
    for i, text in enumerate(TEXTS):
        if i != 3:
            assert np.frombuffer(ids[i], "<u4").tolist() == plain(text, 0)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_plan_reaches_the_optimum_on_small_cases():
    rng = random.Random(5)

    def fewest(items, capacity):
        best = len(items)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                    bins[i] += items[k]
                    go(k + 1, bins)
                    bins[i] -= items[k]
            bins.append(items[k])
            go(k + 1, bins)
            bins.pop()

        go(0, [])
        return best

    for case in range(200):
        items = sorted((rng.randint(1 if case % 2 else 6, 30) for _ in range(10)), reverse=True)
        patterns = packing.plan({s: items.count(s) for s in set(items)}, 30)
        placed = sorted((s for _, fill, n in patterns for s in fill * n), reverse=True)
        assert placed == items and all(sum(fill) <= 30 for _, fill, _ in patterns)
        assert sum(n for _, _, n in patterns) == fewest(items, 30)


@pytest.mark.parametrize("branches", [1, 4000])
def test_completion_is_exact(branches, monkeypatch):
    monkeypatch.setattr(packing, "BRANCHES", branches)
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 60), 6))
        counts = {s: rng.randint(1, 3) for s in sizes}
        room = rng.randint(1, 120)
        reach = {0}
        for s in sizes:
            for _ in range(counts[s]):
                reach |= {x + s for x in reach if x + s <= room}
        fill = packing.complete(room, sizes, counts)
        assert sum(fill) == max(reach) == sum(packing.fullest(room, sizes, counts))
        assert all(fill.count(s) <= counts[s] for s in fill)


def test_orc_files_have_statistics_and_bloom_filters_that_prune(spark, docs):
    from pyarrow import orc

    path = common.shared_folder(spark, "t")
    many = spark.range(0, 40_000, 2, 2).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    token_output.write_tokens(many, path)
    for file in token_output.read_tokens(spark, path).inputFiles():
        table = orc.ORCFile(file.removeprefix("file://"))
        assert table.nstripes >= 1 and table.compression == "ZSTD" and table.row_index_stride == 1000

    def rows_read(doc_id):
        looked = token_output.lookup_tokens(spark, path, [doc_id])
        assert len(looked.collect()) == (doc_id % 2 == 0)
        plan = looked._jdf.queryExecution().executedPlan()
        scans = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
        return sum(x.metrics().apply("numOutputRows").value() for x in scans)

    # row indexes leave all row groups but one out; only the Bloom filter leaves that one out for an id within its range
    assert 1 <= rows_read(20_000) <= 1000
    assert rows_read(20_001) == 0


def test_queries_return_the_contract_columns(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    at, rows = 0, {r["doc_id"]: r for r in token_output.op2_token_output(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        ids = plain(text, 2)
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    pieces = {(r["doc_id"], r["piece"]): r for r in packing.op3_packing(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        ids = plain(text, 0)
        for k, start in enumerate(range(0, len(ids), 2048)):
            r, own = pieces.pop((i, k)), ids[start : start + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert not pieces


def check_plan(histogram, capacity):
    packed = packing.plan(histogram, capacity)
    placed, sequence = {}, 0
    for first, fill, n in packed:
        assert first == sequence and n > 0 and sum(fill) <= capacity
        sequence += n
        for s in fill:
            placed[s] = placed.get(s, 0) + n
    assert placed == {s: c for s, c in histogram.items() if c}
    bound = packing.lower_bound(histogram, capacity)
    assert sequence >= bound >= -(-sum(s * c for s, c in histogram.items()) // capacity)
    return sequence, bound


@pytest.mark.parametrize("histogram", [{2: 1500, 3: 1}, {2: 5000, 5: 7}, {2: 3000, 3: 2, 7: 5, 40: 3}, {2: 3000, 9: 1, 1500: 2}, {1: 10**6, 2048: 3}, {}])
def test_plan_of_many_short_pieces(histogram):
    used, bound = check_plan(histogram, 2048)
    assert used == bound


def test_plan_places_every_piece_of_random_histograms():
    rng, above = random.Random(31), 0
    for _ in range(400):
        short = {s: int(10 ** rng.uniform(0, 6)) for s in rng.sample(range(1, 6), rng.randint(1, 5))}
        long = {rng.randint(6, 2048): rng.randint(1, 30) for _ in range(rng.choice([0, 0, 1, 3]))}
        used, bound = check_plan(short | long, 2048)
        above += used - bound
    assert above <= 40  # of some 10**5 sequences
    for _ in range(300):
        check_plan({s: rng.randint(1, 9) for s in rng.sample(range(1, 41), rng.randint(1, 12))}, 40)


def test_lower_bound_never_passes_the_optimum():
    rng = random.Random(32)
    for _ in range(150):
        pieces = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        histogram = {s: pieces.count(s) for s in pieces}
        bound = packing.lower_bound(histogram, 20)
        if bound > 1:  # no packing has one sequence less than the bound
            assert packing.search(histogram, 20, bound - 1, 10**7) is None
    assert packing.lower_bound({11: 10}, 20) == 10 and packing.lower_bound({5: 8}, 9) == 8
