"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the spans of strict (base) and of loose patterns. Five labelers
vote on each candidate, for (1), against (-1) or not at all (0): strict shape,
checksum, gazetteer, words before it, and the characters around it.
Expectation-maximisation over the counts of vote patterns (a few hundred rows
however large the table) estimates each labeler's reliability; a logistic span
classifier is then trained on the posterior labels and decides on the loose
candidates. Base spans stay whatever it says.

Each text is searched once: its candidates and their votes are written, for
training and deciding read that table only. A text's spans depend on nothing
but the text, so masking joins them back by two hashes of the text.

Defined cases: a null or empty text has no spans; a text of any length is
searched as a whole; a null or repeated document id keeps its rows; an empty
table gives no rows and the labelers' prior reliabilities decide; other columns
are ignored (masking keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import native_spans as ns

KINDS = ["email", "ip", "card", "phone"]
LOOSE = ["email2", "card2", "phone2", "iban", "ssn", "name"]
ALL_KINDS = KINDS + LOOSE

# Possessive forms match what the plain ones do, without backtracking into long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
EMAIL2 = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"
CARD2 = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE2 = r"(?<![0-9+(./-])(?:(?:\([0-9]{2,4}\)|[0-9]{3})[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}|0[0-9]{2,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{2,5})(?![0-9./-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

NAME = r"(?<=\b(?:Dear|Mr|Mr\.|Mrs|Mrs\.|Ms|Ms\.|Dr|Dr\.|Herr|Frau|Monsieur|Madame|Señor|Señora|Sr\.|Sra\.)\x20)\p{Lu}[\p{L}'’-]+(?:\x20\p{Lu}[\p{L}'’-]+)?"
TITLE = r"\b(?:Dear|Mrs?|Ms|Dr|Herr|Frau|Monsieur|Madame|Señora?|Sra?\.)\x20"

#: Gazetteers and words around personal data, in the languages of the corpus.
DOMAINS = "com|org|net|edu|gov|io|info|eu|uk|us|ca|au|de|at|ch|fr|be|es|it|nl|pt|mx|ar|co"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6"
COUNTRIES = "AT|BE|CH|CY|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE"
CALLING = "1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1246]|9[0-58]"
FOR = r"(?i)(e-?mail|mail|contact|write|tel|telephone|telefon|tel[eé]fono|t[eé]l[eé]phone|phone|call|fax|mobile|handy|card|visa|mastercard|karte|carte|tarjeta|ip|host|server|address|adresse|direcci[oó]n|iban|konto|compte|cuenta|account|ssn|social security)[^A-Za-z0-9]{0,4}(\w{1,8}[^A-Za-z0-9]{0,3})?$"
AGAINST = r"(?i)(version|section|figure|isbn|issn|order|invoice|serial|chapter|page|seite|kapitel|artikel|doi|rfc|build|release)[^A-Za-z0-9]{0,4}$"
LABELERS = 5
#: Spans (some 60 bytes each) that are broadcast for masking at most; beyond, it's a shuffled join.
BROADCAST_SPANS = 300_000


def _base_patterns(text: Column) -> list[tuple]:
    return [(EMAIL, "email", 0, F.contains(text, F.lit("@"))), (IP, "ip", 1, None), (CARD, "card", 2, None), (PHONE, "phone", 3, F.contains(text, F.lit("+")))]


def _loose_patterns(text: Column) -> list[tuple]:
    """The narrowest first."""
    at = F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at )")) | F.contains(text, F.lit("at ]"))
    return [(EMAIL2, "email2", 4, at), (IBAN, "iban", 7, None), (SSN, "ssn", 8, None), (PHONE2, "phone2", 6, None), (CARD2, "card2", 5, None), (NAME, "name", 9, text.rlike(TITLE))]


def _valid(x: Column) -> Column:
    """Whether a match of any pattern stands."""
    number = ns.digits(x["m"])
    n = F.length(number)
    octets = F.split(x["m"], r"\.")
    small = F.forall(octets, lambda part: part.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    return F.when(x["k"] == "ip", small).when(x["k"] == "card", (n <= 19) & ns.luhn(number)).when(x["k"] == "phone", n.between(10, 15)).when(x["k"] == "card2", n <= 19).otherwise(True)


def base_spans(text: Column) -> Column:
    return F.sort_array(F.filter(F.flatten(ns.all_matches(text, _base_patterns(text))), _valid))


def with_spans(docs: DataFrame) -> DataFrame:
    """``spans`` of ``text``: the base ones, and candidates that overlap none of them and none of a narrower pattern.

    Patterns are added one after the other, the narrowest first.
    """
    text = F.col("text")
    asked = [*_base_patterns(text), *_loose_patterns(text)]
    valid = F.transform(ns.all_matches(text, asked), lambda spans: F.filter(spans, _valid))
    base = F.sort_array(F.flatten(F.slice("found", 1, len(KINDS))))
    add = lambda held, more: F.concat(held, ns.free(more, held)).cast(ns.SPANS)
    spans = F.aggregate(F.slice("found", len(KINDS) + 1, len(LOOSE)), base.cast(ns.SPANS), add)
    return docs.withColumn("found", valid).withColumn("spans", spans).drop("found")


def votes(pieces: Column, x: Column) -> Column:
    """The labelers' votes on a span of the text in ``pieces`` (see chunks()) as a string such as "card2:1,-1,0,0,1"."""
    left, after = ns.part(pieces, F.greatest(x["s"] - 30, F.lit(0)), x["s"]), ns.part(pieces, x["e"], x["e"] + 1)
    return ns.let(F.struct(left.alias("left"), after.alias("after")), lambda c: _votes(x["k"], x["m"], c["left"], c["after"]))


def _votes(k: Column, m: Column, left: Column, after: Column) -> Column:
    number = ns.digits(m)
    yes = lambda c: F.when(c, 1).otherwise(-1)
    email, card, phone = k.isin("email", "email2"), k.isin("card", "card2"), k.isin("phone", "phone2")
    shape = (
        F.when(email, yes(m.rlike(r"^[A-Za-z0-9].*[A-Za-z]{2,}$")))
        .when(card, yes(F.length(number).isin(15, 16)))
        .when(phone, yes(m.rlike(r"^\+|^\([0-9]{3}\)")))
        .when(k == "ip", yes(~m.rlike(r"^0|\.0[0-9]")))
        .otherwise(1)
    )
    checksum = F.when(card, yes(ns.luhn(number))).otherwise(0)
    gazetteer = (
        F.when(email, yes(m.rlike(rf"(?i)[.\])\x20]({DOMAINS})$")))
        .when(card, yes(number.rlike(rf"^({ISSUERS})")))
        .when(k == "phone", yes(number.rlike(rf"^({CALLING})")))
        .when(k == "ip", yes(~m.rlike(r"^(0|127|255)\.")))
        .when(k == "iban", yes(m.rlike(rf"^({COUNTRIES})")))
        .when(k == "ssn", yes(~m.rlike("^(000|666|9)")))
        .when(k == "name", yes(~m.rlike("^(Sir|Madam|Customer|Reader|Editor|Kunde|Client|Cliente)\\b")))
        .otherwise(0)
    )
    context = F.when(left.rlike(FOR), 1).when(left.rlike(AGAINST), -1).otherwise(0)
    around = yes(~left.rlike(r"[\p{L}\p{N}_/=#-]$") & ~after.rlike(r"^[\p{L}\p{N}_/=]"))
    return F.concat(k, F.lit(":"), F.concat_ws(",", *(v.cast("string") for v in (shape, checksum, gazetteer, context, around))))


class SpanClassifier:
    """Reliabilities by expectation-maximisation, then logistic weights; both from counts of vote patterns."""

    def __init__(self, counts: dict[str, int], rounds: int = 60) -> None:
        rows = [(p.split(":")[0], tuple(map(int, p.split(":")[1].split(","))), n) for p, n in sorted(counts.items())]
        self.prior = {k: 0.5 for k in ALL_KINDS}
        # pseudo-counts: a labeler is right rather than wrong until the data say otherwise
        held = {1: {1: 6.0, 0: 3.0, -1: 1.0}, 0: {1: 1.0, 0: 3.0, -1: 6.0}}
        self.rates = [{y: {v: c / 10 for v, c in held[y].items()} for y in (0, 1)} for _ in range(LABELERS)]
        for _ in range(rounds):
            seen = [{y: dict(held[y]) for y in (0, 1)} for _ in range(LABELERS)]
            kinds = {k: [2.0, 2.0] for k in ALL_KINDS}
            for k, vote, n in rows:
                p = self.posterior(k, vote)
                kinds[k][1] += n * p
                kinds[k][0] += n * (1 - p)
                for j, v in enumerate(vote):
                    seen[j][1][v] += n * p
                    seen[j][0][v] += n * (1 - p)
            self.prior = {k: c[1] / sum(c) for k, c in kinds.items()}
            self.rates = [{y: {v: c / sum(s[y].values()) for v, c in s[y].items()} for y in (0, 1)} for s in seen]
        self._fit([(self._features(k, vote), self.posterior(k, vote), float(n)) for k, vote, n in rows])

    def posterior(self, kind: str, vote: tuple[int, ...]) -> float:
        x = math.log(self.prior[kind] / (1 - self.prior[kind]))
        for rate, v in zip(self.rates, vote):
            x += math.log(rate[1][v] / rate[0][v])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    @staticmethod
    def _features(kind: str, vote: tuple[int, ...]) -> list[str]:
        return ["bias", kind, *(f"{j}:{v}" for j, v in enumerate(vote) if v)]

    def _fit(self, rows: list[tuple[list[str], float, float]], steps: int = 400) -> None:
        # weights start from the reliabilities, so unseen patterns follow them
        self.weights = {"bias": 0.0} | {k: math.log(p / (1 - p)) for k, p in self.prior.items()}
        self.weights |= {f"{j}:{v}": math.log(r[1][v] / r[0][v]) for j, r in enumerate(self.rates) for v in (1, -1)}
        start, total = dict(self.weights), sum(n for _, _, n in rows)
        for _ in range(steps if total else 0):
            grad = {f: 0.01 * (w - start[f]) for f, w in self.weights.items()}
            for features, y, n in rows:
                x = sum(self.weights[f] for f in features)
                d = (1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) - y) * n / total
                for f in features:
                    grad[f] += d
            for f, g in grad.items():
                self.weights[f] -= 0.5 * g

    def accepts(self, vote: Column) -> Column:
        """Whether the classifier holds a candidate for personal data; ``vote``: as votes() gives it."""
        w = self.weights
        kind = F.substring_index(vote, ":", 1)
        by_kind = F.lit(0.0)
        for k in ALL_KINDS:
            by_kind = F.when(kind == k, F.lit(w[k])).otherwise(by_kind)
        score = F.lit(w["bias"]) + by_kind
        each = F.split(F.substring_index(vote, ":", -1), ",")
        for j in range(LABELERS):
            v = F.element_at(each, j + 1)
            score = score + F.when(v == "1", F.lit(w[f"{j}:1"])).when(v == "-1", F.lit(w[f"{j}:-1"])).otherwise(F.lit(0.0))
        return score > 0


def candidates(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` of docs and all candidates of ``text``, each with its kind, its place and its votes."""
    found = with_spans(docs.select(*keys, "text")).select(*keys, "spans", F.when(F.size("spans") > 0, ns.chunks(F.col("text"))).alias("pieces"))
    with_votes = lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["k"].alias("k"), votes(F.col("pieces"), x).alias("v"))
    return found.select(*keys, F.transform("spans", with_votes).alias("spans"))


def train(found: DataFrame) -> SpanClassifier:
    """From the votes on every candidate of all documents, as candidates() gives them."""
    patterns = found.filter(F.size("spans") > 0).select(F.explode(F.transform("spans", lambda x: x["v"])).alias("p"))
    return SpanClassifier({r["p"]: r["n"] for r in patterns.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()})


def decided(classifier: SpanClassifier) -> Column:
    """The base candidates and the accepted loose ones, in order."""
    return F.sort_array(F.filter("spans", lambda x: (x["o"] < len(KINDS)) | classifier.accepts(x["v"])))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans, an array of structs."""
    found = common.written(candidates(common.id_and_text(docs, id_col, text_col), "doc_id"), "candidates")
    return found.select("doc_id", decided(train(found)).alias("spans"))


def mask_personal_data(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; a null text stays null."""
    keys = [F.xxhash64(text_col).alias("__t1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("__t2")]
    found = candidates(docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("text")), "__t1", "__t2")
    # copies of a text have the same spans: one row and their number; texts without any go after that, as a filter before it would search texts twice
    found = common.written(found.groupBy("__t1", "__t2").agg(F.first("spans").alias("spans"), F.count(F.lit(1)).alias("n")).filter(F.size("spans") > 0), "candidates")
    # training counts the candidates of every copy
    patterns = found.select(F.explode(F.transform("spans", lambda x: x["v"])).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    classifier = SpanClassifier({r["p"]: r["n"] for r in patterns.collect()})
    spans = found.select("__t1", "__t2", decided(classifier).alias("__spans"), "n")
    total, held = found.agg(F.sum("n"), F.sum(F.size("spans"))).first()
    keyed = docs.select("*", *keys)
    if (held or 0) <= BROADCAST_SPANS:
        joined = keyed.join(F.broadcast(spans.drop("n")), ["__t1", "__t2"], "left")
    else:
        joined = common.with_counts(keyed, spans, ["__t1", "__t2"], F.monotonically_increasing_id(), total, how="left")
    label = lambda x: F.concat(F.lit("<"), F.regexp_replace(F.upper(x["k"]), "2$", ""), F.lit(">"))
    kept = [ns.masked(F.col(text_col), F.coalesce("__spans", F.array().cast(joined.schema["__spans"].dataType)), label).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*kept)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.spread(common.table(spark, sf_dir, "documents")))
    base = F.filter("spans", lambda x: x["o"] < len(KINDS))
    return found.select("doc_id", *(ns.count(F.col("spans"), k).alias(f"n_{k}") for k in KINDS), F.sha2(ns.listed(base), 256).alias("base_sha256"), ns.listed(F.col("spans")).alias("spans"))
