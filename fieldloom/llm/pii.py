"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

The base kinds are found by expression and test and always stay. For further kinds, broad
expressions give candidate spans, and every base span is a candidate too, so that the labelers meet
plain cases. Labelers (shape tests, gazetteers of names and prefixes, words in the context before
and after, borders) each vote yes, no or nothing. Matches of a base expression that fail its
test (an address with a part of 300, a number that fails Luhn) are known to be no personal data. So
base spans and failed ones calibrate the labelers, and expectation-maximisation over the vote patterns
of the other candidates estimates, along with them, how often each labeler is right, what share of the
candidates is personal, and so the chance of each pattern. A naive Bayes classifier over features of
the span (kind, size, digits, neighbours, context, shape, lists) is trained on these chances, with the prior of the
candidates whose answer isn't known; added spans are those of them that it accepts and that don't
touch a base span.

Patterns are counted in Spark over all candidates of all documents; what the driver holds is three
counts for each pattern (at most 3 to the number of labelers) and two sums for each feature value.

Null and empty texts have no spans. Rows that repeat a doc_id are told apart by their text. Without
candidates nothing is added. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = 40


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Of a string of digits."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_card(m: Column) -> Column:
    return shared.let(digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


#: Base kinds in their order: expression, gate and test.
BASE = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), None),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), is_card),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(digits(m)).between(8, 15)),
}
#: Expressions of further candidates.
MORE = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "national": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
    "birth": r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
}
#: Gazetteer of given names, title words left out.
NAMES = (
    "john|james|mary|robert|michael|linda|david|sarah|anna|maria|peter|paul|thomas|laura|julia|martin|susan|karen|daniel|emma|william|richard|joseph|charles|christopher|matthew|anthony|mark|steven|andrew|"
    "kenneth|joshua|kevin|brian|george|edward|ronald|timothy|jason|jeffrey|ryan|jacob|gary|nicholas|eric|jonathan|stephen|larry|justin|scott|brandon|benjamin|samuel|patricia|jennifer|elizabeth|barbara|"
    "jessica|lisa|nancy|betty|margaret|sandra|ashley|kimberly|emily|donna|michelle|carol|amanda|dorothy|melissa|deborah|stephanie|rebecca|sharon|cynthia|kathleen|amy|angela|helen|ruth|alice|grace|henry|"
    "hans|klaus|jürgen|petra|ursula|wolfgang|heinz|dieter|günter|stefan|andreas|sabine|monika|karin|renate|pierre|jean|marie|claude|sophie|jacques|michel|philippe|françois|nathalie|isabelle|camille|"
    "jose|josé|juan|carmen|pedro|luis|ana|carlos|miguel|javier|manuel|francisco|antonio|pilar|lucía|elena|sofía|pablo|diego"
)
CUES = r"(?i)(?:e-?mail|mail|contact|phone|tel\b|tel\.|call|mobile|fax|ssn|social security|card|visa|iban|account|born|birth|address|name|host|ip\b|correo|teléfono|telefon|konto|téléphone|courriel|geb)"
AGAINST = r"(?i)(?:version|release|isbn|issn|order|invoice|build|sha|commit|rev\b|page|figure|section|doi|part no|sku|model)"
LABELERS = ("shape", "gazetteer", "cue", "against", "border")


def base_spans(text: Column, kind: str) -> Column:
    pattern, gate, test = BASE[kind]
    found = shared.spans(text, pattern, gate(text))
    return F.filter(found, lambda x: test(x.m)) if test is not None else found


def _votes(kind: Column, m: Column, before: Column, after: Column) -> list[Column]:
    """One vote each: 1 yes, 0 no, 2 nothing."""
    low, n = F.lower(m), F.length(digits(m))
    shape = F.when(kind == "ssn", F.when(m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), 1).otherwise(0))
    shape = shape.when(kind == "national", F.when(m.rlike(r"^\(?[2-9]"), 1).otherwise(0)).when(kind == "birth", F.lit(2)).when(kind == "iban", F.when(n >= 10, 1).otherwise(0))
    shape = shape.when(kind == "card", F.when(n.between(16, 19) & m.rlike(r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}"), 1).otherwise(0)).when(kind == "phone", F.when(n.between(8, 15), 1).otherwise(0))
    shape = shape.when(kind == "ip", F.when(m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), 1).otherwise(0)).otherwise(1)
    names = F.when(kind == "person", F.when(low.rlike(rf"\b(?:{NAMES})\b"), 1).otherwise(2)).when(kind == "email", F.when(low.rlike(r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$"), 1).otherwise(2))
    names = names.when(kind == "iban", F.when(m.rlike(r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|PL|SE)"), 1).otherwise(0)).when(kind == "card", F.when(m.rlike(r"^[3-6]"), 1).otherwise(0)).otherwise(2)
    near = F.concat(before, F.lit(" "), after)
    cue = F.when(before.rlike(CUES), 1).when(near.rlike(CUES), 2).when(kind.isin("birth", "mac"), 0).otherwise(2)
    against = F.when(before.rlike(AGAINST), 0).otherwise(2)
    border = F.when(F.right(before, F.lit(1)).rlike(r"[\p{L}0-9/=_-]") | F.left(after, F.lit(1)).rlike(r"[\p{L}0-9/=_-]"), 0).otherwise(1)
    return [shape, names, cue, against, border]


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate: doc_id, __t, kind, known (true of base spans, false of failed ones, else null), s, e, votes and features."""
    df = docs.select("doc_id", F.xxhash64("text").alias("__t"), "text")
    made = {k: shared.spans(F.col("text"), BASE[k][0], BASE[k][1](F.col("text"))) for k in BASE} | {k: shared.spans(F.col("text"), p) for k, p in MORE.items()}
    df = df.select("doc_id", "__t", "text", *[v.alias(f"__{k}") for k, v in made.items()])
    good = lambda k, m: F.lit(None).cast("boolean") if k in MORE else F.lit(True) if BASE[k][2] is None else BASE[k][2](m)
    tag = lambda k: F.transform(f"__{k}", lambda x: F.struct(F.lit(k).alias("kind"), x.s.alias("s"), x.e.alias("e"), x.m.alias("m"), good(k, x.m).alias("known")))
    tagged = [tag(k) for k in made]
    df = df.select("doc_id", "__t", "text", F.array_distinct(F.concat(*tagged)).alias("all"))
    start = lambda s: F.greatest(s - CONTEXT, F.lit(0))
    near = F.transform("all", lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e"), x.m.alias("m"), x.known.alias("known"), F.substring(F.col("text"), start(x.s) + 1, x.s - start(x.s)).alias("before"), F.substring(F.col("text"), x.e + 1, F.lit(CONTEXT)).alias("after")))
    df = df.select("doc_id", "__t", near.alias("all")).select("doc_id", "__t", F.explode_outer("all").alias("x")).filter("x IS NOT NULL").select("doc_id", "__t", "x.*")
    kind, m, before, after = map(F.col, ("kind", "m", "before", "after"))
    given = [v.cast("string") for v in _votes(kind, m, before, after)]
    votes = F.concat(*given)
    feature = lambda name, value: F.concat(F.lit(name + "="), value)
    features = F.array(
        feature("kind", kind), feature("size", F.least(F.length(m) / 4, F.lit(12)).cast("int").cast("string")), feature("digits", F.least(F.length(digits(m)), F.lit(20)).cast("string")),
        feature("left", _class(F.right(before, F.lit(1)))), feature("right", _class(F.left(after, F.lit(1)))), feature("cue", before.rlike(CUES).cast("string")), feature("against", before.rlike(AGAINST).cast("string")), feature("shape", given[0]), feature("listed", given[1]),
    )
    return df.select("doc_id", "__t", "kind", "known", "s", "e", votes.alias("votes"), features.alias("features"))


def _class(c: Column) -> Column:
    return F.when(c == "", "none").when(c.rlike(r"\s"), "blank").when(c.rlike(r"[0-9]"), "digit").when(c.rlike(r"\p{L}"), "letter").otherwise("mark")


def reliabilities(patterns: dict[str, tuple[float, float, float]], rounds: int = 50) -> dict[str, float]:
    """By EM: the chance that a span with these votes is personal. Right labelers agree; a silent one says nothing.

    ``patterns``: how many spans with these votes have no known answer, are personal, and are not.
    The share of personal ones comes from the first alone, as the known ones were picked.
    """
    right, prior, chance, order = [0.8] * len(LABELERS), 0.5, {}, sorted(patterns.items())
    for _ in range(rounds):
        for p in patterns:
            yes, no = prior, 1 - prior
            for a, v in zip(right, p, strict=True):
                if v != "2":
                    yes, no = yes * (a if v == "1" else 1 - a), no * (1 - a if v == "1" else a)
            chance[p] = yes / (yes + no)
        open_ = sum(n for _, (n, _, _) in order)
        prior = min(0.95, max(0.05, (sum(n * chance[p] for p, (n, _, _) in order) + 1) / (open_ + 2)))
        for i in range(len(LABELERS)):
            agreed = total = 0.0
            for p, (n, yes, no) in order:
                if p[i] != "2":
                    q = chance[p] if p[i] == "1" else 1 - chance[p]
                    agreed, total = agreed + n * q + (yes if p[i] == "1" else no), total + n + yes + no
            right[i] = min(0.99, max(0.55, (agreed + 8) / (total + 10)))
    return chance


def classifier(found: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of feature values and the prior log odds, from staged candidates."""
    count = lambda test: F.count_if(test).alias
    known = F.col("known")
    counted = found.groupBy("votes").agg(count(known.isNull())("n"), count(known)("yes"), count(~known)("no")).collect()
    patterns = {r["votes"]: (r["n"], r["yes"], r["no"]) for r in counted}
    if not any(n for n, _, _ in patterns.values()):
        return {}, 0.0
    chance = reliabilities(patterns)
    told = F.from_json(F.lit(json.dumps(chance)), "map<string,double>")
    soft = found.select(F.coalesce(known.cast("double"), F.element_at(told, F.col("votes"))).alias("q"), "features").select("q", F.explode_outer("features").alias("f"))
    sums = {r["f"]: (r["yes"], r["n"] - r["yes"]) for r in soft.groupBy("f").agg(F.sum(F.round("q", 6).cast("decimal(20,6)")).cast("double").alias("yes"), F.count(F.lit(1)).alias("n")).collect()}
    kinds = [v for k, v in sums.items() if k.startswith("kind=")]
    yes, no = sum(v[0] for v in kinds), sum(v[1] for v in kinds)
    weights = {k: round(math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)), 9) for k, (a, b) in sums.items()}
    open_ = sum(n for n, _, _ in patterns.values())
    personal = sum(n * chance[p] for p, (n, _, _) in sorted(patterns.items()))
    return weights, round(math.log((personal + 1) / (open_ - personal + 1)), 9)


def added(docs: DataFrame) -> DataFrame:
    """Accepted spans beyond the base: doc_id, __t and an array of (rank, s, e, kind)."""
    found = shared.stage(candidates(docs), "pii-candidates")
    weights, prior = classifier(found)
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,double>")
    odds = F.aggregate("features", F.lit(prior), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, list(MORE).index(k) + len(BASE)), list(MORE)[1:], F.when(F.col("kind") == next(iter(MORE)), len(BASE)))
    fresh = found.filter("known IS NULL").filter(odds > 0)
    return fresh.groupBy("doc_id", "__t").agg(F.array_sort(F.collect_set(F.struct(rank.alias("k"), F.col("s"), F.col("e"), F.col("kind")))).alias("more"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def scan(docs: DataFrame) -> DataFrame:
    more = shared.stage(added(docs), "pii-added").withColumnsRenamed({"doc_id": "__id", "__t": "__u"})
    df = docs.select("doc_id", F.xxhash64("text").alias("__t"), *[base_spans(F.coalesce("text", F.lit("")), k).alias(f"__{k}") for k in BASE])
    tag = lambda i, k: F.transform(f"__{k}", lambda x: F.struct(F.lit(i).alias("k"), x.s.alias("s"), x.e.alias("e"), F.lit(k).alias("kind")))
    ranked = [tag(i, k) for i, k in enumerate(BASE)]
    df = df.select("doc_id", "__t", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], F.concat(*ranked).alias("found"))
    df = df.join(shared.sized(more), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__u")), "left")
    apart = F.filter(F.coalesce("more", shared.nothing("array<struct<k:int,s:int,e:int,kind:string>>")), lambda x: ~F.exists("found", lambda y: (y.s < x.e) & (x.s < y.e)))
    return df.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(joined(F.col("found")), 256).alias("base_sha256"), joined(F.concat("found", apart)).alias("spans"), F.size(F.concat("found", apart)).cast("long").alias("n_spans"))


def op7(docs: DataFrame) -> DataFrame:
    return scan(docs)
