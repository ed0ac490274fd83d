"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

DataFrame functions only. Candidates come from one pattern a kind. Four labelers vote for, against or not at all on each
candidate: the form (checksums, ranges, digit counts), a gazetteer (known endings, issuer digits, country codes, titles),
the words before it, and the characters that touch it. Of all candidates, the number with each combination of kind, votes
and form features is counted; the domain of these is fixed, so the counts fit on the driver at any size of input. There
expectation-maximisation estimates each labeler's reliability and the probability of each combination, and a logistic
classifier over votes and form features is trained on these probabilities. The classifier decides on the added kinds;
spans of the base kinds that pass their own test always stay.

Defined results: a null or empty text has no spans (the digest is that of an empty text). Offsets count code points, ends
are exclusive. Repeated rows each get their own row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import placed, running, with_pieces
from .common import checkpoint


@dataclass(frozen=True)
class Kind:
    """``may`` is a cheap test of a whole text, ``pattern`` finds candidates, ``valid`` is the form labeler."""

    name: str
    may: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    gazetteer: str
    context: str


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """From the right, every other digit counts double, less 9 if that exceeds 9; the sum ends in 0."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits(m))))

    def add(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substr(F.reverse(digits(m)), i, F.lit(1)).try_cast("int"), F.lit(0))
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def octets(m: Column) -> Column:
    def small(p: Column) -> Column:
        p = F.regexp_replace(p, "^0+", "")
        return (F.length(p) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, "\\."), small)


def always(_: Column) -> Column:
    return F.lit(True)


LOCAL = "[A-Za-z0-9._%+-]"
# The patterns of the base kinds start only where a run of their first class starts, or where the match before ended;
# any other start would fail or be no leftmost one. That and possessive repeats keep them linear on long runs.
BASE = (
    Kind("email", lambda t: F.contains(t, F.lit("@")), rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", always,
         r"(?i)\.(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$", r"(?i)(e-?mail|contact|write|address)\W*\w*\W*$"),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", octets,
         r"^(?!0\.|127\.|255\.)", r"(?i)(ip|host|server|address|login|from)\W*\w*\W*$"),
    Kind("card", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"), r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.length(digits(m)).between(14, 19) & luhn(m),
         r"^[3-6]", r"(?i)(card|visa|master|amex|credit|debit|pay)\W*\w*\W*$"),
    Kind("phone", lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(10, 15),
         r"^\+(1|2[07]|3[0-469]|4\d|5[1-8]|6[0-6]|7|8[1246]|9[0-58])", r"(?i)(phone|call|tel|mobile|fax|contact)\W*\w*\W*$"),
)
#: Kinds that this operator adds.
EXTRA = (
    Kind("national_id", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9)"),
         r"^[0-7]", r"(?i)(ssn|social|security|id|number)\W*\w*\W*$"),
    Kind("local_phone", lambda t: t.rlike("[0-9]{3}[). -]{1,2}[0-9]{3}[. -][0-9]{4}"), r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[ ])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[. -][0-9]{4}(?![0-9.-])", always,
         r"^\(?[2-9]", r"(?i)(phone|call|tel|mobile|fax|contact)\W*\w*\W*$"),
    Kind("masked_email", lambda t: t.rlike(r"(?i)[(\[]at[)\]]"), r"(?i)[a-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[a-z0-9-]{1,64}(?: ?[(\[]dot[)\]] ?|\.)[a-z]{2,20}", always,
         r"(?i)(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$", r"(?i)(e-?mail|contact|write|address)\W*\w*\W*$"),
    Kind("titled_name", lambda t: t.rlike(r"\b(Mr|Mrs|Ms|Dr|Prof)\. "), r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?", always,
         r"^(Mr|Mrs|Ms|Dr|Prof)", r"(?i)(dear|by|from|to|contact|signed)\W*\w*\W*$"),
)
KINDS = BASE + EXTRA
NAMES = [k.name for k in KINDS]
#: A candidate; features are one character each: the votes of the form, gazetteer, context and touching labelers (+, -, or
#: 0 for none), then classes of length and of the share of digits.
SPAN = "struct<start:int,place:int,end:int,kind:string,valid:boolean,features:string>"
VOTES, FEATURES = 4, 6


def candidates(docs: DataFrame, text_col: str, own: Column) -> DataFrame:
    """Columns own, text and spans (array of SPAN, by start and kind) of every row."""
    text = docs.select(own.alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    found = text.select("own", "text", *[F.when(k.may(F.col("text")), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, k in enumerate(KINDS)])
    cut = found.select("own", "text", *[f"m{i}" for i in range(len(KINDS))], *[F.when(F.size(f"m{i}") > 0, F.split("text", k.pattern, -1)).otherwise(none).alias(f"b{i}") for i, k in enumerate(KINDS)])
    return cut.select("own", "text", F.array_sort(F.concat(*[_spans(i, k) for i, k in enumerate(KINDS)])).alias("spans"))


def _spans(place: int, kind: Kind) -> Column:
    """The text is cut at the matches; the lengths of the pieces and matches add up to the offsets."""
    def one(start: Column, b: Column, m: Column) -> Column:
        valid = F.coalesce(kind.valid(m), F.lit(False))
        features = F.concat(
            F.when(valid, "+").otherwise("-"), F.when(m.rlike(kind.gazetteer), "+").otherwise("0"),
            F.when(F.right(b, F.lit(40)).rlike(kind.context), "+").otherwise("0"), F.when(F.right(b, F.lit(1)).rlike("[A-Za-z0-9]"), "-").otherwise("0"),
            F.least(F.lit(4), F.floor(F.length(m) / 6)).cast("string"), F.least(F.lit(3), F.floor(4 * F.length(digits(m)) / F.length(m))).cast("string"),
        )
        return F.struct(start.cast("int").alias("start"), F.lit(place).alias("place"), (start + F.length(m)).cast("int").alias("end"), F.lit(kind.name).alias("kind"), valid.alias("valid"), features.alias("features"))

    return F.when(F.size(f"m{place}") > 0, placed(F.col(f"m{place}"), F.col(f"b{place}"), one)).otherwise(F.array().cast(f"array<{SPAN}>"))


# -- weighing the votes --------------------------------------------------------------------------------------------------


def estimate(counts: dict[tuple[str, str], int], rounds: int = 40) -> dict[tuple[str, str], float]:
    """Expectation-maximisation over (kind, votes) -> number of candidates: the probability that such a candidate is real.

    A candidate is real or not; given that, the labelers vote on their own. Every labeler has a share of +, 0 and - for real
    candidates and one for others, common to all kinds; a kind has its share of real candidates. Starts from the majority.
    """
    keys = sorted(counts)
    real = {k: (0.9 if k[1].count("+") > k[1].count("-") else 0.1) for k in keys}
    for _ in range(rounds):
        shares = []
        for j in range(VOTES):
            both = []
            for side in (0, 1):
                n = {v: 0.5 for v in "+0-"}
                for k in keys:
                    n[k[1][j]] += counts[k] * (real[k] if side else 1 - real[k])
                total = sum(n.values())
                both.append({v: x / total for v, x in n.items()})
            shares.append(both)
        prior = defaultdict(lambda: [1.0, 1.0])
        for k in keys:
            prior[k[0]][1] += counts[k] * real[k]
            prior[k[0]][0] += counts[k] * (1 - real[k])
        for k in keys:
            odds = math.log(prior[k[0]][1] / prior[k[0]][0]) + sum(math.log(shares[j][1][v] / shares[j][0][v]) for j, v in enumerate(k[1]))
            real[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return real


def train(counts: dict[tuple[str, str], int], real: dict[tuple[str, str], float], steps: int = 300) -> dict[str, float]:
    """Logistic regression on one-hot features (kind, each vote, each form feature) against the estimated probabilities."""
    def named(kind: str, features: str) -> list[str]:
        return ["bias", kind, *[f"{j}{v}" for j, v in enumerate(features)]]

    rows = [(named(k, f), real[k, f[:VOTES]], math.log1p(n)) for (k, f), n in sorted(counts.items())]
    weight: dict[str, float] = {n: 0.0 for names, _, _ in rows for n in names}
    total = sum(c for *_, c in rows) or 1.0
    for _ in range(steps):
        slope = {n: 1e-3 * w for n, w in weight.items()}
        for names, y, c in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[n] for n in names)))))
            for n in names:
                slope[n] += (p - y) * c / total
        for n, g in slope.items():
            weight[n] -= 1.5 * g
    return weight


def fit(spans: DataFrame) -> dict[str, float]:
    """Weights of the span classifier, from all candidates of a table with the column spans."""
    rows = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.features").agg(F.count("*").alias("n")).collect()
    counts = {(r["kind"], r["features"]): r["n"] for r in rows}  # a row for each combination of features
    votes: dict[tuple[str, str], int] = defaultdict(int)
    for (kind, features), n in counts.items():
        votes[kind, features[:VOTES]] += n
    return train(counts, estimate(votes))


def accepted(spans: Column, weights: dict[str, float]) -> Column:
    """Valid spans of the base kinds, and those of the added kinds that the classifier takes for real."""
    table = F.create_map(*[F.lit(x) for n in sorted(weights) for x in (n, weights[n])]) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def margin(s: Column) -> Column:
        names = [F.lit("bias"), s["kind"], *[F.concat(F.lit(str(j)), F.substring(s["features"], j + 1, 1)) for j in range(FEATURES)]]
        total = F.lit(0.0)
        for n in names:
            total = total + F.coalesce(F.element_at(table, n), F.lit(0.0))
        return total

    return F.filter(spans, lambda s: F.when(s["place"] < len(BASE), s["valid"]).otherwise(s["valid"] & (margin(s) >= 0)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts and digest of the base spans, and all spans, of every whole text."""
    spans = checkpoint(candidates(docs, text_col, F.col(id_col)).select("own", "spans"))  # offsets and features; no texts
    taken = spans.select("own", accepted(F.col("spans"), fit(spans)).alias("spans"))
    base = F.filter("spans", lambda s: s["place"] < len(BASE))

    def number(kind: Kind) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind.name)).cast("bigint").alias(f"n_{kind.name}")

    counts = [number(k) for k in BASE]
    return taken.select(F.col("own").alias(id_col), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``; in the text every accepted span is replaced by its kind in brackets.

    Of overlapping spans the first stands, and the ones that start within it go with it. A null text stays null.
    """
    own = F.struct(*[F.col(c) for c in docs.columns])
    found = candidates(docs, text_col, own)
    weights = fit(found)  # counts of all candidates; finding them again costs less than carrying texts and spans to a join
    kept = found.select("own", "text", accepted(F.col("spans"), weights).alias("taken"))
    kept = kept.withColumn("covered", running(F.transform("taken", lambda s: s["end"]), F.greatest))  # end of all spans before

    def redacted(piece) -> Column:
        def put(s: Column, covered: Column) -> Column:
            return F.when(s["start"] >= covered, F.concat(piece(covered, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        end = F.array_max(F.transform("taken", lambda s: s["end"]))
        return F.concat(F.array_join(F.zip_with("taken", "covered", put), ""), piece(end, F.length("text")))

    text = F.when(F.size("taken") == 0, F.col(f"own.{text_col}")).otherwise(with_pieces(F.col("text"), redacted))
    return kept.select(*[text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])
