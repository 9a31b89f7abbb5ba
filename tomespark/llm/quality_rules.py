"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule looks at features of a text (numbers of words, repeated windows, letters
in capitals, ...), and a feature may need others (windows need words). On a
bounded sample, estimate() times each feature and counts which rules reject
which rows. order() then takes, again and again, the rule that rejects most of
the rows left per second of the features that aren't computed yet, so a cheap
rule that rejects much comes first and a costly one sees only what is left.
cascade() writes that order as columns: a feature is computed only for rows
that no earlier rule has rejected, unless the caller wants it for all rows.
The order decides the cost only: a text is kept if no rule rejects it.

Defined cases: a null or empty text has no words and fails the rule on their
number; texts of any length count as a whole; a null or repeated document id
keeps its rows; an empty table gives no rows and the rules' written order; other
columns are ignored. A window of three words is known by 64 bits of its words'
hashes; two windows of one text of a million words are mistaken for equal with
a chance of 3e-8.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLANK = " \t\n\x0b\x0c\r"
WORD_GAP, IN_WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that costs and selectivities are estimated on, at most, and the share of rows drawn for it.
SAMPLE, SHARE = 500, 0.2


@dataclass(frozen=True)
class Feature:
    """A column and the columns it is made of (``text`` is always there)."""

    of: tuple[str, ...]
    make: Callable[[], Column]


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where a text is to go; it reads only the features in ``of``."""

    name: str
    of: tuple[str, ...]
    fails: Callable[[], Column]


@dataclass
class Estimate:
    """Seconds for a feature and all it is made of on the sample, and how many of its rows each set of failing rules has."""

    seconds: dict[str, float] = field(default_factory=dict)
    patterns: dict[frozenset[str], int] = field(default_factory=dict)


def _windows() -> Column:
    size = F.size("hashes")
    return F.when(size >= 3, F.transform(F.slice("hashes", F.lit(1), F.greatest(size - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _ranked() -> Column:
    """Windows with their places, equal ones side by side; none if all differ."""
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _places() -> Column:
    """Where windows begin that are found twice or more, in order."""
    again = F.filter("ranked", lambda x, i: (x["h"] == F.get("ranked", i + 1)["h"]) | (x["h"] == F.get("ranked", i - 1)["h"]))
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def _covered() -> Column:
    """Words in those windows: each covers three, or as many as there are up to the next."""
    steps = F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _without(characters: str) -> Column:
    return F.length(F.translate("text", characters, "")).cast("long")


def _letters(kind: str) -> Column:
    return F.length(F.regexp_replace("text", rf"\P{{{kind}}}+", "")).cast("long")


FEATURES: dict[str, Feature] = {
    "words": Feature((), lambda: F.array_remove(F.split("text", WORD_GAP, -1), "")),
    "n_words": Feature(("words",), lambda: F.size("words").cast("long")),
    "word_chars": Feature((), lambda: _without(BLANK)),
    "n_symbols": Feature((), lambda: F.length("text").cast("long") - _without(SYMBOLS)),
    "lines": Feature((), lambda: F.filter(F.split("text", "\n", -1), lambda x: x.rlike(IN_WORD))),
    "n_lines": Feature(("lines",), lambda: F.size("lines").cast("long")),
    "n_dup_lines": Feature(("lines",), lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")),
    "hashes": Feature(("words",), lambda: F.transform("words", lambda w: F.xxhash64(w))),
    "windows": Feature(("hashes",), _windows),
    "ranked": Feature(("windows",), _ranked),
    "places": Feature(("ranked",), _places),
    "n_repeat_words": Feature(("places",), _covered),
    "n_lettered": Feature(("words",), lambda: F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long")),
    "n_letters": Feature((), lambda: _letters("L")),
    "n_capitals": Feature((), lambda: _letters("Lu")),
}

#: The two base rules, and those of the method; shares in integers, so that any engine decides alike.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda: F.col("n_words") < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("word_length", ("word_chars", "n_words"), lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
    Rule("words_without_letters", ("n_lettered", "n_words"), lambda: 10 * F.col("n_lettered") < 7 * F.col("n_words")),
    Rule("capitals", ("n_capitals", "n_letters"), lambda: 2 * F.col("n_capitals") > F.col("n_letters")),
)


def needed(names: Sequence[str], have: Sequence[str] = ()) -> list[str]:
    """The features that ``names`` rest on and that ``have`` lacks, each after those it is made of."""
    out: list[str] = []

    def add(name: str) -> None:
        if name not in have and name not in out:
            for n in FEATURES[name].of:
                add(n)
            out.append(name)

    for name in names:
        add(name)
    return out


def with_features(docs: DataFrame, names: Sequence[str], have: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """``docs`` with features that it lacks, one projection each; null where ``where`` doesn't hold."""
    for name in needed(names, have):
        made = FEATURES[name].make()
        docs = docs.withColumn(name, made if where is None else F.when(where, made))
    return docs


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES) -> Estimate:
    """Costs and selectivities on at most SAMPLE rows; ``docs`` has a column ``text`` without nulls.

    Timed are the features that rules name and those that several features are made of.
    """
    sample = common.written(docs.select("text").sample(SHARE, seed=11).limit(SAMPLE), "rule-sample")
    named = [f for r in rules for f in r.of]
    shared = [f for f in needed(named) if sum(f in g.of for g in FEATURES.values()) > 1]

    def seconds(names: Sequence[str]) -> float:
        spent = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            with_features(sample, names).agg(F.max(F.xxhash64("text", *names))).collect()
            spent.append(time.perf_counter() - began)
        return min(spent)

    nothing = seconds([])
    failing = F.array_compact(F.array(*(F.when(r.fails(), F.lit(r.name)) for r in rules)))
    counts = with_features(sample, named).groupBy(failing.alias("names")).count()
    out = Estimate({f: max(1e-4, seconds([f]) - nothing) for f in dict.fromkeys(named + shared)}, {frozenset(r["names"]): r["count"] for r in counts.collect()})
    common.released(sample)
    return out


def order(rules: Sequence[Rule], costs: Estimate, free: Sequence[str] = ()) -> list[Rule]:
    """The rules, most rejected rows per second first, each judged on the rows that those before it leave.

    Features in ``free`` are computed anyway and cost nothing; so do those of
    rules already taken, and a feature costs less by what it is made of where
    that is there already.
    """
    left, patterns, have, out = list(rules), dict(costs.patterns), needed(free), []

    def price(rule: Rule) -> float:
        spent = lambda f: costs.seconds.get(f, 0.0)
        new = [f for f in rule.of if f not in have]
        return 1e-4 + sum(max(0.0, spent(f) - max((spent(g) for g in needed([f]) if g in have), default=0.0)) for f in new)

    def worth(rule: Rule) -> tuple[float, float]:
        return sum(n for names, n in patterns.items() if rule.name in names) / price(rule), -price(rule)

    while left:
        best = max(left, key=worth)  # the first of equals, so the written order decides ties
        out.append(best)
        left.remove(best)
        have += needed(best.of, have)
        patterns = {names: n for names, n in patterns.items() if best.name not in names}
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule], always: Sequence[str] = ()) -> DataFrame:
    """``docs`` with the features in ``always`` and ``failed``: the first of ``rules`` that rejects a row, else null.

    Features of a rule are computed only for rows that reach it.
    """
    have = needed(always)
    out = with_features(docs, always).withColumn("failed", F.lit(None).cast("string"))
    for rule in rules:
        out = with_features(out, rule.of, have, F.col("failed").isNull())
        have += needed(rule.of, have)
        out = out.withColumn("failed", F.coalesce("failed", F.when(rule.fails(), F.lit(rule.name))))
    return out.select(*docs.columns, *always, "failed")


def check_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text", always: Sequence[str] = (), costs: Estimate | None = None) -> DataFrame:
    """doc_id, the features in ``always``, ``failed`` (a rule that rejects it; which of several depends on their order) and ``kept``."""
    docs = common.id_and_text(docs, id_col, text_col)
    ordered = order(rules, costs or estimate(docs, rules), always)
    return cascade(docs, ordered, always).drop("text").withColumn("kept", F.col("failed").isNull())


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    checked = check_quality(common.spread(common.table(spark, sf_dir, "documents")), always=digest)
    failed = BASE_RULES[0].fails() | BASE_RULES[1].fails()
    return checked.select("doc_id", *digest, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS covered
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(covered, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered,
             length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_capitals
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 10 * n_lettered < 7 * n_words OR 2 * n_capitals > n_letters) AS kept
FROM b
"""
