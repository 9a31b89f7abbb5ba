"""Secret scans with two character Markov models, in DataFrame functions only.

One model describes random strings, the other ordinary words and identifiers;
a token is a secret if the log-likelihood ratio says so. Both are bigram tables
over at most 66 symbols, trained from labelled samples: random strings drawn
from a seeded generator and secrets that fixed patterns find, against ordinary
tokens of all documents and of source-like identifiers. The ratio is asked for
tokens that overlap no base span: for all of 20 characters or more, and for
those of 12 to 19 that mix letters and digits (shorter ones, and short ones of
letters alone, hold too little to tell). Texts are searched once, the candidates
are written, and training and deciding read that table.

Defined cases: a null or empty text has no spans; a text of any length is
searched as a whole; a null or repeated document id keeps its rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import native_spans as ns

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"  # maximal runs, as [0-9a-f]+ finds them, where long enough
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_=-]{20,}+|(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{12,19}+)"
KINDS = ["assign", "access", "hex"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A token is a secret from this ratio on (natural logarithms), in all and for each character.
LEAST_TOTAL, LEAST_MEAN = 7.0, 0.3
#: Shapes of ordinary identifiers that texts seldom hold; words of the documents fill them.
IDENTIFIERS = ["get_{}_by_{}", "{}_{}_{}", "MAX_{}_{}", "/usr/{}/{}", "{}-{}-{}", "{}{}Handler", "is{}{}", "www_{}_{}_html", "{}/{}/{}_2024", "test_{}_{}_01", "{}_id=", "--{}--{}--", "====", "----", "____", "2023-01-02", "1234567890"]


def base_spans(text: Column) -> Column:
    lower = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "api"):
        named = named | F.contains(lower, F.lit(word))
    assign = F.filter(ns.matches(text, ASSIGN, "assign", 0, named), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    access = F.filter(ns.matches(text, ACCESS, "access", 1, F.contains(text, F.lit("AKIA"))), lambda x: F.length(x["m"]) >= 20)
    return ns.merged([assign, access, ns.matches(text, HEX, "hex", 2)])


def _random_samples(seed: int = 17, n: int = 3000) -> list[str]:
    rng = random.Random(seed)
    sets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:26] + "0123456789"]
    return ["".join(rng.choices(rng.choice(sets), k=rng.randint(20, 64))) for _ in range(n)]


def _counts(strings: list[str]) -> dict[tuple[str, str], int]:
    out: dict[tuple[str, str], int] = {}
    for s in strings:
        for pair in zip(s, s[1:]):
            out[pair] = out.get(pair, 0) + 1
    return out


def _bigrams(tokens: Column) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(1), F.length(tokens)), lambda i: i < F.length(tokens)), lambda i: F.substring(tokens, i, F.lit(2)))


def _corpus_counts(docs: DataFrame, found: DataFrame) -> tuple[dict, dict, list[str]]:
    """``found``: as candidates() gives it. Bigram counts of base secrets and of ordinary tokens, and the most frequent words. At most 66 * 66 rows each.

    Bigrams are counted on distinct tokens, weighted by how often each occurs.
    """
    base = F.transform(F.filter("spans", lambda x: x["o"] < len(KINDS)), lambda x: F.regexp_replace(x["m"], "^.*[^A-Za-z0-9+/_=-]", ""))
    blank = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    times = lambda rows: rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    tokens = common.written(times(docs.select(F.explode(F.split(blank, "[^A-Za-z0-9+/_=-]+")).alias("t")).filter(F.length("t") >= 2)), "token-counts")
    mixed = (F.length("t") >= 12) & F.col("t").rlike("[0-9]") & F.col("t").rlike("[A-Za-z]")  # those may be secrets themselves
    ordinary = tokens.filter((F.length("t").between(2, 19) & ~mixed) | F.col("t").rlike("^([A-Z]?[a-z]+|[A-Z]+)$"))

    def counted(tokens: DataFrame) -> dict[tuple[str, str], int]:
        pairs = tokens.select(F.explode(_bigrams(F.col("t"))).alias("p"), "n")
        return {(r["p"][0], r["p"][1]): r["n"] for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect() if len(r["p"]) == 2}

    words = tokens.select(F.explode(F.split(F.lower("t"), "[^a-z]+")).alias("w"), "n").filter(F.length("w").between(3, 9)).groupBy("w").agg(F.sum("n").alias("n"))
    frequent = [r["w"] for r in words.orderBy(F.desc("n"), "w").limit(200).collect()]
    return counted(times(found.select(F.explode(base).alias("t")))), counted(ordinary), frequent


def train(docs: DataFrame, found: DataFrame | None = None) -> list[float]:
    """The log-likelihood ratio of every pair of symbols, row by row."""
    secret, ordinary, words = _corpus_counts(docs, candidates(docs) if found is None else found)
    rng = random.Random(23)
    words = words or ["name", "file", "value", "index"]
    fill = lambda shape: shape.format(*(rng.choice([str.lower, str.upper, str.capitalize])(rng.choice(words)) for _ in range(3)))
    made = _counts([fill(shape) for shape in IDENTIFIERS for _ in range(40)])
    generated = _counts(_random_samples())
    scale = lambda c, total: {k: v * total / max(1, sum(c.values())) for k, v in c.items()}
    positive, negative = scale(generated, 60_000), scale(ordinary, 60_000)
    for k, v in scale(secret, 6_000).items():
        positive[k] = positive.get(k, 0) + v
    for k, v in scale(made, 12_000).items():
        negative[k] = negative.get(k, 0) + v

    def log_rows(c: dict) -> dict[tuple[str, str], float]:
        out, n = {}, len(ALPHABET)
        for a in ALPHABET:
            total = sum(c.get((a, b), 0) for b in ALPHABET)
            for b in ALPHABET:
                out[a, b] = math.log((c.get((a, b), 0) + 2.0) / (total + 2.0 * n))
        return out

    p, q = log_rows(positive), log_rows(negative)
    return [p[a, b] - q[a, b] for a in ALPHABET for b in ALPHABET]


def token_score(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token of ALPHABET's symbols: random against ordinary."""
    ratios = F.array(*(F.lit(round(x, 5)) for x in table))
    n = len(ALPHABET)
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.aggregate(
        F.zip_with(F.slice(at, F.lit(1), F.length(token) - 1), F.slice(at, F.lit(2), F.length(token) - 1), lambda a, b: (a - 1) * n + b),
        F.lit(0.0),
        lambda acc, i: acc + F.when(i > 0, F.element_at(ratios, i)).otherwise(0.0),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, and base spans and tokens that overlap none of them."""
    found = docs.select("doc_id", base_spans(F.col("text")).alias("base"), ns.matches(F.col("text"), TOKEN, "token", 3).alias("tokens"))
    return found.select("doc_id", F.concat("base", ns.free(F.col("tokens"), F.col("base"))).alias("spans"))


def decided(table: list[float]) -> Column:
    """The base spans, and the tokens that the models hold for random, in order."""
    least = lambda t: F.greatest(F.lit(LEAST_TOTAL), LEAST_MEAN * F.length(t["m"]))
    return F.sort_array(F.filter("spans", lambda t: (t["o"] < len(KINDS)) | (token_score(t["m"], table) >= least(t))))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table: list[float] | None = None) -> DataFrame:
    """doc_id and its spans, an array of structs; ``table``: from train(), else trained here."""
    docs = common.id_and_text(docs, id_col, text_col)
    found = common.written(candidates(docs), "secret-candidates")
    return found.select("doc_id", decided(table or train(docs, found)).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.spread(common.table(spark, sf_dir, "documents")))
    base = F.filter("spans", lambda x: x["o"] < len(KINDS))
    return found.select("doc_id", *(ns.count(F.col("spans"), k).alias(f"n_{k}") for k in KINDS), F.sha2(ns.listed(base), 256).alias("base_sha256"), ns.listed(F.col("spans")).alias("spans"))
