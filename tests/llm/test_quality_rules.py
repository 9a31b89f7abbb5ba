import random
import re
import unicodedata

from tomespark.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, words string, failed string, n_words double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", "f", 0.5) for i, t in rows], SCHEMA).repartition(3)


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for places in seen.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    n, chars, symbols, dup = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(repeated) > 50 * n
    letters = [c for c in text if unicodedata.category(c)[0] == "L"]
    capitals = sum(unicodedata.category(c) == "Lu" for c in letters)
    lettered = sum(any(unicodedata.category(c)[0] == "L" for c in w) for w in words)
    bad = 10 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 12 * n or 10 * lettered < 7 * n or 2 * capitals > len(letters)
    return n, chars, symbols, dup, len(repeated), base, not (base or bad)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéßñ", k=rng.randint(1, 9)))
    prose = lambda n: "".join(word() + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n"]) for _ in range(n))
    out = [prose(rng.randint(0, 400)) for _ in range(60)]
    out += [prose(80).upper(), prose(80).replace(" ", " | "), prose(30) * 3, "de " * 300, ("spam line\n" * 60) + prose(70), "x" * 900 + " " + prose(49), "12 34 5 " * 40 + prose(30), "a b c " * 2, "a a a a", "\n\n \n", "", None, "ß", "𝒳 😀 " * 40]
    out += [prose(60) + "\x1f \x00 \x0b" + prose(10), prose(50).rstrip(), "### " * 9 + prose(60), prose(20_000)]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (None, out[5])]


DIGEST = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_equals_plain_code(spark):
    rows = texts(4)
    frames = frame(spark, rows)
    frames.write.mode("overwrite").parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/rules/documents.parquet")
    got = qr.op11_quality_rules(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/rules")
    assert got.columns == ["doc_id", *DIGEST, "base_failed", "kept"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["boolean"] * 2
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *plain(t)) for i, t in rows), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert {w[-1] for w in want} == {True, False}


def test_any_order_keeps_the_same_rows(spark):
    rows = texts(5)
    want = sorted((i if i is not None else -1, plain(t)[-1]) for i, t in rows)
    for rules in (qr.RULES, qr.RULES[::-1]):
        costs = qr.Estimate({f: 1.0 for r in rules for f in r.of}, {})
        got = qr.check_quality(frame(spark, rows), rules, costs=costs).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["kept"]) for r in got) == want
        assert all((r["failed"] is None) == r["kept"] for r in got)


def test_later_features_are_left_out_for_rejected_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "w" + " w".join(map(str, range(60))))], "doc_id long, text string")
    few, repeated = qr.BASE_RULES
    out = qr.with_features(docs, few.of).withColumn("failed", qr.F.when(few.fails(), "few_words"))
    out = {r["doc_id"]: r for r in qr.with_features(out, repeated.of, qr.needed(few.of), qr.F.col("failed").isNull()).collect()}
    assert out[1]["failed"] == "few_words" and out[1]["windows"] is None and out[1]["n_repeat_words"] is None
    assert out[2]["failed"] is None and out[2]["n_repeat_words"] == 0


def test_order_by_rejection_per_cost():
    costs = qr.Estimate(
        {"words": 1.0, "n_words": 1.0, "n_repeat_words": 5.0, "n_symbols": 0.5, "n_dup_lines": 0.1, "n_lines": 0.1},
        {frozenset(): 50, frozenset({"few_words"}): 10, frozenset({"repeated_words"}): 30, frozenset({"symbols", "few_words"}): 10, frozenset({"repeated_lines", "repeated_words"}): 4},
    )
    few, repeated, symbols, lines = qr.RULES[:4]
    # rows per second: lines 4 / 0.2, few 20 / 1; then repeated words 30 / 4 beyond the words that few_words needed; symbols have nothing left to reject
    assert [r.name for r in qr.order([repeated, symbols, few, lines], costs)] == ["few_words", "repeated_lines", "repeated_words", "symbols"]
    # features that are there anyway cost nothing
    assert qr.order([few, repeated], costs, free=["n_repeat_words", "n_words"])[0].name == "repeated_words"
    assert qr.order(qr.RULES, qr.Estimate()) == list(qr.RULES)


def test_estimate_and_empty(spark):
    docs = spark.createDataFrame([(i, "some words " * 30 if i % 2 else "short") for i in range(400)], "doc_id long, text string").select("doc_id", "text")
    costs = qr.estimate(docs)
    assert all(s > 0 for s in costs.seconds.values()) and 0 < sum(costs.patterns.values()) <= 400
    assert set(costs.patterns) == {frozenset({"few_words"}), frozenset({"repeated_words"})}
    assert qr.check_quality(docs.limit(0)).count() == 0
