"""run() against plain code for every stage but the classifier, whose own decisions are taken from its scores."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_decontamination import brute as contained
from tests.llm.test_near_dedup import brute as linked
from tests.llm.test_packing_and_tokens import plain
from tomespark.llm import quality

WORDS = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "ta se li mo nu ra te si lo".split()]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    sentence = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, sentence(25)) for i in range(5)]
    docs, truth = [], {}
    for i in range(160):
        text = sentence(rng.randint(20, 120))
        if i % 5 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 7 == 2 and i > 10:
            text = docs[i - 5][1] or text
        elif i % 9 == 4:
            own = text.split()
            text = " ".join([*own[:10], items[i % 5][1], *own[10:]])
        elif i % 11 == 5:
            text = f"{text[:40]} mail u{i}@mail.example.com or +1 (974) 555-{1000 + i} {text[40:]}"
        truth[i] = int(i % 5 != 1)
        docs.append((i, text, "en", "src", len(text)))
    docs += [(500, None, "en", "src", 0), (501, "", "en", None, 0), (502, sentence(4000), None, "src", 1)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(truth.items()), "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def test_run_matches_plain_code(spark, tables):
    folder, docs, items = tables
    read = spark.read.parquet
    good = {r["doc_id"] for r in quality.score_documents(read(f"{folder}/documents.parquet"), read(f"{folder}/labels.parquet")).collect() if r["predicted"]}
    assert {i for i in range(160) if i % 5 == 1}.isdisjoint(good) and len(good) > 100
    kept = [(d[0], d[1]) for d in docs if d[0] in good]
    kept = [(d, t) for (d, t), (_, _, c) in zip(sorted(kept, key=lambda r: r[0]), sorted(linked(kept, 5, 80))) if d == c]
    hit = {r[0] for r in contained(kept, items, 0.8)}
    assert hit
    kept = [(d, t) for d, t in kept if d not in hit]

    def masked(t):
        t = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", t or "")
        return re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "<PHONE>", t)

    got = corpus_pipeline.run(spark, folder).collect()
    want = {d: plain(masked(t), 0) for d, t in kept}
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        assert sum(n for _, n in places) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:]))
    assert len(bins) == -(-sum(map(len, want.values())) // 2048)


def test_stages_keep_the_columns(spark, tables):
    folder, docs, _ = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == frame.columns
        assert stage(spark, frame.limit(0), folder).count() == 0
