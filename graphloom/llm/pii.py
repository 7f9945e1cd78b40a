"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are the base matches of four kinds and matches of wider patterns (obfuscated
addresses, IPv6, card-like and phone-like numbers without the strict form). Three labelers vote
on each (1, 0 or no vote): a regex labeler on its form, a gazetteer labeler (top-level domains,
country codes, issuer prefixes, address ranges) and a context labeler (words before it).
Expectation-maximisation over the counts of vote patterns (at most 27 of each kind)
estimates each labeler's reliability and each pattern's probability; with these as soft labels
a naive Bayes span classifier over votes and shape is trained from aggregated counts and decides
on the wider candidates. Base matches always stay.

Positions come from splitting a text at the pattern: gaps and matches alternate, and their
running lengths are the offsets. All text work is built-in functions; the driver only sees the
table of vote patterns and the table of feature counts, whose sizes do not depend on the data.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, free_names, materialize, packed, unpacked

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Base patterns. Possessive, and tied to the start of a run or the last match's end, they match
#: what the plain patterns match, in linear time.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9][ -]?)[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\[at\]|\(at\)|\{{at\}}) ?{_DOMAIN}++(?: ?(?:\.|\[dot\]|\(dot\)|\{{dot\}}) ?{_DOMAIN}++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9+.][ -]?)[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.)-] ?)(?:\([0-9]{2,4}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])",
}
#: Fixed values of the gazetteer labeler, as patterns over a candidate.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])}] ?)(?:com|org|net|edu|gov|io|info|eu|de|fr|es|it|uk|us|ca|nl|ch|at|be|pl|pt|br|jp|cn|in|au)$",
    "ip": r"^(?:10\.|127\.|192\.168\.|[1-9]\.|1[1-9]\.|[2-9][0-9]\.|1[0-9][0-9]\.|2[01][0-9]\.|22[0-3]\.|2[0-9A-Fa-f]{3}:|f[cde][0-9a-f]{2}:)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68])",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
}
#: Fixed values of the context labeler: words for and against, before a candidate.
FOR = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|write|reach|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|from|client|login|addr)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte|pay)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|cell|telefon|tél|teléfono)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|order|invoice|ref|sku|serial|build|sha|md5|doi|page|no)\b\W*$"
CONTEXT = 40


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def running_sum(steps: Column, block: int = 64) -> Column:
    """Inclusive running sums of an array of longs, by blocks: never quadratic in its length."""

    def within(x):
        return F.aggregate(x, F.expr("cast(array() as array<bigint>)"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v)))

    def joined(inner):
        totals = F.transform(inner, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0)))
        before = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + v)))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda x, o: F.transform(x, lambda v: v + o)))

    def blocks(a):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, block))

    return F.when(F.size(steps) > 0, let(steps, lambda a: let(F.transform(blocks(a), within), joined))).otherwise(F.expr("cast(array() as array<bigint>)"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match,left,right>> of a pattern's leftmost non-overlapping matches."""

    def located(x):
        gaps, found = x["gaps"], x["found"]
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), F.concat(F.array(F.lit("")), F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))), lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        sides = F.arrays_zip(
            running_sum(steps).alias("start"), found.alias("match"),
            F.slice(gaps, 1, F.size(found)).alias("left"), F.slice(gaps, 2, F.size(found)).alias("right"),
        )
        return F.transform(
            sides,
            lambda s: F.struct(
                s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match"),
                F.substring(s["left"], -CONTEXT, CONTEXT).alias("left"), F.substring(s["right"], 1, 1).alias("right"),
            ),
        )

    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    nothing = F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string,left:string,right:string>>)")
    return F.when(text.rlike(pattern), let(pair, located)).otherwise(nothing)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    def add(d):
        def step(acc, i):
            x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return acc + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0

    return let(F.reverse(digits(c)), add)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_PASSES: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": luhn,
    "phone": lambda m: F.length(digits(m)).between(10, 15),
}
_FORM: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| ?[\[({]at[\])}] ?)[A-Za-z0-9].*[A-Za-z]{2,}$"),
    "ip": lambda m: m.rlike(r"^(?:[1-9][0-9]{0,2}\.)(?:(?:0|[1-9][0-9]{0,2})\.){2}(?:0|[1-9][0-9]{0,2})$|:"),
    "card": luhn,
    "phone": lambda m: F.length(digits(m)).between(10, 15) & m.rlike(r"^\+|^\([0-9]{3}\)|^[0-9]{3}[.-]"),
}
FEATURES = ("regex", "gazetteer", "context", "before", "after", "size")


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and found: array<struct<kind,k,start,end,base,votes and shape>> of every row of `docs`."""
    text = F.coalesce("text", F.lit(""))
    vote = lambda yes, no=None: F.when(yes, 1).otherwise(F.when(no, 0) if no is not None else None)
    side = lambda c: F.when(c.isNull() | (c == ""), "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"[A-Za-z0-9]"), "word").otherwise("mark")

    def described(kind: str, base: bool):
        def one(s):
            m = s["match"]
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
                vote(_FORM[kind](m), ~_FORM[kind](m)).alias("regex"), vote(m.rlike(GAZETTEER[kind]), F.lit(kind in ("card", "ip"))).alias("gazetteer"),
                vote(s["left"].rlike(FOR[kind]), s["left"].rlike(AGAINST)).alias("context"),
                side(F.substring(s["left"], -1, 1)).alias("before"), side(s["right"]).alias("after"),
                F.least(F.length(m), F.lit(40)).cast("string").alias("size"),
            )

        return one

    parts = []
    for kind in KINDS:
        base = F.filter(matches(F.col("t"), BASE[kind]), lambda s: _PASSES[kind](s["match"]))
        parts.append((f"b_{kind}", F.transform(base, described(kind, True))))
        parts.append((f"w_{kind}", F.transform(matches(F.col("t"), WIDER[kind]), described(kind, False))))
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), text.alias("t"))
    rows = rows.select(*names, *(c.alias(n) for n, c in parts))
    free = lambda kind: F.filter(f"w_{kind}", lambda w: ~F.exists(f"b_{kind}", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    found = rows.select(*names, F.concat(*(c for kind in KINDS for c in (F.col(f"b_{kind}"), free(kind)))).alias("found"))
    return found.toDF(*keep, *free_names(docs.select(*keep), "found"))


def estimate(patterns: list[tuple], rounds: int = 50) -> dict[tuple, float]:
    """Probability of each (votes) pattern, by expectation-maximisation over (votes, count) of one kind.

    Votes are independent given the truth; a labeler's rates of 1, 0 and no vote for true and
    for false candidates are its reliability.
    """
    width = len(patterns[0][0]) if patterns else 0
    rate = {(y, i, v): (0.6 if v == y else 0.2) for y in (0, 1) for i in range(width) for v in (0, 1, None)}
    prior, q = 0.5, {}
    for _ in range(rounds):
        for votes, _ in patterns:
            odds = [p * math.prod(rate[y, i, v] for i, v in enumerate(votes)) for y, p in ((0, 1 - prior), (1, prior))]
            q[votes] = odds[1] / sum(odds)
        weight = defaultdict(lambda: 0.5)
        size = [1.5, 1.5]
        for votes, n in patterns:
            for y, p in ((0, 1 - q[votes]), (1, q[votes])):
                size[y] += n * p
                for i, v in enumerate(votes):
                    weight[y, i, v] += n * p
        rate = {(y, i, v): weight[y, i, v] / size[y] for y, i, v in rate}
        prior = size[1] / sum(size)
    return q


def classifier(found: DataFrame) -> Callable[[Column], Column]:
    """The trained span classifier: candidate struct -> probability that it is personal data.

    `found`: an array of candidates a row. One aggregate of it comes to the driver: counts by kind,
    votes and shape, all of fixed sets of values (at most 4 * 27 * 16 * 41).
    """
    each = found.select(F.explode(found.columns[-1]).alias("c")).select("c.kind", *(F.col(f"c.{f}") for f in FEATURES))
    table = each.groupBy("kind", *FEATURES).count().collect()
    votes = defaultdict(lambda: defaultdict(int))
    for r in table:
        votes[r["kind"]][tuple(r[f] for f in FEATURES[:3])] += r["count"]
    soft = {(kind, *v): p for kind, own in votes.items() for v, p in estimate(sorted(own.items(), key=str)).items()}

    def lookup(values: dict[str, float], key: Column, other: float) -> Column:
        if not values:
            return F.lit(other)
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)), key), F.lit(other))

    total = defaultdict(lambda: [1.0, 1.0])
    counts = defaultdict(lambda: [0.0, 0.0])
    for r in table:
        q = soft[(r["kind"], *(r[f] for f in FEATURES[:3]))]
        for y, share in enumerate((q, 1 - q)):
            total[r["kind"]][y] += r["count"] * share
            for f in FEATURES:
                counts[r["kind"], f, "-" if r[f] is None else str(r[f])][y] += r["count"] * share
    odds = {f"{kind}|{f}|{v}": math.log((yes + 1) / (total[kind][0] + 4)) - math.log((no + 1) / (total[kind][1] + 4)) for (kind, f, v), (yes, no) in counts.items()}
    first = {kind: math.log(yes / no) for kind, (yes, no) in total.items()}

    def probability(c: Column) -> Column:
        z = lookup(first, c["kind"], 0.0)
        for f in FEATURES:
            z = z + lookup(odds, F.concat_ws("|", c["kind"], F.lit(f), F.coalesce(c[f].cast("string"), F.lit("-"))), 0.0)
        return 1 / (1 + F.exp(-z))

    return probability


def _decided(found: DataFrame, probability: Callable[[Column], Column], least: float) -> DataFrame:
    """The last column, an array of candidates, becomes that of the spans that stay, in order."""
    *kept, name = found.columns
    spans = F.transform(F.col(name), lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"), probability(c).alias("probability")))
    return found.select(*kept, F.array_sort(F.filter(spans, lambda s: s["base"] | (s["probability"] >= least))).alias(free_names(found.select(*kept), "spans")[0]))


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """`keep` columns and spans: array<struct<start,k,end,kind,base,probability>>, sorted, of every row of `docs`.

    Offsets are code points, end exclusive. Null and empty texts have no spans; repeated rows and
    rows without doc_id are kept; columns not kept are ignored. If a kept column is named spans,
    the last column is named spans_. An empty table gives no rows.
    """
    found = materialize(candidates(docs, keep), "pii-candidates")
    return _decided(found, classifier(found), least)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one names the whole."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:string>>)")

    def merge(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when(last.isNotNull() & (s["start"] < last["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(own)))

    def built(m):
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(m, lambda s: s["end"]))
        pieces = F.zip_with(m, F.slice(ends, 1, F.size(m)), lambda s, e: F.concat(F.substring(text, (e + 1).cast("int"), (s["start"] - e).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), F.substring(text, (F.try_element_at(ends, F.lit(-1)) + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, let(F.aggregate(spans, empty, merge), built)).otherwise(text)


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """`docs` with personal data in its texts replaced by the kind's name, n_chars to match; null texts stay null.

    Repeated rows and rows without doc_id are redacted like others; other columns stay as they
    are, whatever their names; an empty table gives no rows. The texts are scanned twice, once
    for the classifier's counts and once to redact, and nothing is written or shuffled.
    """
    found = candidates(packed(docs), ("doc_id", "text", "others"))
    done = _decided(found, classifier(found), least).withColumn("text", redacted(F.col("text"), F.col("spans")))
    changed = {}
    if "n_chars" in docs.columns:
        before = F.col(f"others.c{[c for c in docs.columns if c not in ('doc_id', 'text')].index('n_chars')}")
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(before)
    return unpacked(done, docs, **changed)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base matches, and all spans, of every row of documents."""
    found = find_pii(documents(spark, sf_dir))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *(F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )
