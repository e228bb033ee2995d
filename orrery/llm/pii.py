"""Personal data by weak supervision, with built-in functions only.

Candidates are found by regular expressions: the base kinds (email, ip, card, phone), which always stay when valid, and looser shapes
of the same kinds (an address spelled with 'at' and 'dot', a number without country code, a card number that fails its checksum), and
secrets (long runs of letters and digits, of which keys and tokens are some).
Three labelers vote on each candidate: its strict shape (regular expression and checksum), a gazetteer (known top-level domains, card
issuers, number prefixes, address ranges, lengths and prefixes of keys) and the words before it. Expectation-maximisation over the counts of vote patterns (at most
4 kinds x 27) estimates how reliable each labeler is; its posteriors train a naive Bayes span classifier on shape features (sums of
posteriors by feature), and loose candidates that it accepts with `ACCEPT` or more, and that overlap no base span, are added.

Labelers and features read the whole span and the `NEAR` characters before it within the scan of the text, so that only votes, features
and offsets leave it; patterns and feature values are bounded tables, and the classifier is applied to each row by itself.

Defined results: null text is empty; kinds may overlap each other, spans of one kind don't; repeated rows are answered each; an empty
table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import staged, text_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds as listed in `spans`; secrets are added by the method alone.
ALL_KINDS = (*KINDS, "secret")
# Possessive where giving back can't help, so that long runs don't backtrack; no group repeats per character, which would recurse.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DIGIT_RUN = r"[0-9][0-9\x20-]{10,}+"
#: What every run of 12 digits or more with single separators holds.
CARD_LENGTH = r"[0-9](?:[\x20-]?[0-9]){11}"
LOOSE_EMAIL = r"(?i)\b[a-z0-9._%+-]{1,64}(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)[a-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[a-z]{2,12}\b"
LOOSE_PHONE = r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,39}[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}"
SECRET_SHAPE = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2})$"
#: Fixed values.
SECRET_FORMS = r"^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}|(?:ghp|gho|sk|pk|xox[bp]|AKIA|AIza)[_-]?[A-Za-z0-9_-]{16,})$"
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "co", "uk", "de", "fr", "es", "eu", "example")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|adresse|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|login|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment)\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key|auth|bearer|credential)\b[\"'\x20:=]*$",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
}
NEAR, ACCEPT, ROUNDS = 40, 0.9, 25
_SPAN = "array<struct<start:int,end:int,s:string,before:string>>"
#: Matches folded at once: a fold copies its array at each step.
FOLD = 256


def tail(*parts: Column) -> Column:
    """The last NEAR code points of what the parts make together."""
    return F.substring(F.concat(*parts), -NEAR, NEAR)


def matches(text: Column, pattern: str, between: bool = False) -> Column:
    """Spans of a pattern's matches (leftmost, non-overlapping), or of what lies between them, with the text just before each.

    Offsets are running sums of the lengths of matches and gaps, folded in parts of FOLD and then over the parts, so a text with very
    many matches costs little more than its length.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        gap, hit = x["gap"], x["hit"]
        start = acc["at"] + F.length(gap)
        end = start + F.coalesce(F.length(hit), F.lit(0))
        before = tail(acc["tail"], gap)
        if between:
            span = F.struct(acc["at"].alias("start"), start.alias("end"), gap.alias("s"), acc["tail"].alias("before"))
            out = F.array_append(acc["out"], span)
        else:
            span = F.struct(start.alias("start"), end.alias("end"), hit.alias("s"), before.alias("before"))
            out = F.when(hit.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span))
        return F.struct(end.alias("at"), tail(before, F.coalesce(hit, F.lit(""))).alias("tail"), out.alias("out"))

    def parts(all_: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int"))
        empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out"))
        return F.transform(at, lambda i: F.aggregate(F.slice(all_, i * FOLD + 1, F.lit(FOLD)), empty, step))

    def join(acc: Column, part: Column) -> Column:
        own = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), part["out"].alias("out"))
        return F.struct((acc["at"] + part["at"]).alias("at"), tail(acc["tail"], part["tail"]).alias("tail"), F.array_append(acc["out"], own).alias("out"))

    folded = F.element_at(F.transform(F.array(zipped), parts), 1)  # so that the pieces are bound once
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<struct<at:int,tail:string,out:{_SPAN}>>").alias("out"))
    placed = F.aggregate(folded, start, join)["out"]
    return F.flatten(F.transform(placed, lambda p: F.transform(p["out"], lambda x: F.struct((x["start"] + p["at"]).alias("start"), (x["end"] + p["at"]).alias("end"), x["s"].alias("s"), tail(p["tail"], x["before"]).alias("before")))))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def add(total: Column, x: Column) -> Column:
        d = x["d"].cast("int") * F.when(x["i"] % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(F.filter(places, lambda x: x["d"] != ""), F.lit(0), add) % 10 == 0


def in_byte(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.concat(F.lit("0"), F.substring(short, 1, 3)).cast("int") <= 255)


def long_enough(s: Column, low: int, high: int) -> Column:
    return F.length(digits(s)).between(low, high)


def card_runs(text: Column) -> Column:
    """Runs of digits with single separators: digit runs split where two separators meet, a last separator cut."""
    trimmed = lambda p: F.rtrim(F.translate(p["s"], "-", " "))

    def cut(r: Column, p: Column) -> Column:
        start = r["start"] + p["start"]
        return F.struct(start.alias("start"), (start + F.length(trimmed(p))).alias("end"), trimmed(p).alias("s"), tail(r["before"], p["before"]).alias("before"))

    flat = F.flatten(F.transform(matches(text, DIGIT_RUN), lambda r: F.transform(matches(r["s"], r"[\x20-]{2,}+", True), lambda p: cut(r, p))))
    return F.filter(flat, lambda p: long_enough(p["s"], 12, 19))


def candidates(text: Column) -> Column:
    """array(kind, start, end, s, base): all candidates of a text, base ones marked."""
    none = F.array().cast(_SPAN)
    guarded = lambda test, spans: F.when(test, spans).otherwise(none)
    kind = lambda name, spans, base: F.transform(spans, lambda x: F.struct(F.lit(name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), base(x["s"]).alias("base"), x["before"].alias("before")))
    ips = F.filter(guarded(F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), matches(text, IP)), lambda x: F.forall(F.split(x["s"], r"\."), in_byte))
    phones = F.filter(guarded(F.contains(text, F.lit("+")), matches(text, PHONE)), lambda x: long_enough(x["s"], 9, 15))
    yes, no = lambda s: F.lit(True), lambda s: F.lit(False)
    return F.concat(
        kind("email", guarded(F.contains(text, F.lit("@")), matches(text, EMAIL)), yes),
        kind("ip", ips, yes),
        kind("card", guarded(F.regexp_like(text, F.lit(CARD_LENGTH)), card_runs(text)), lambda s: luhn(digits(s))),
        kind("phone", phones, yes),
        kind("email", guarded(F.regexp_like(text, F.lit(r"(?i)[(\[\x20]dot[)\]\x20]")), matches(text, LOOSE_EMAIL)), no),
        kind("phone", guarded(F.regexp_like(text, F.lit("[0-9]{3}")), matches(text, LOOSE_PHONE)), no),
        kind("secret", guarded(F.regexp_like(text, F.lit("[0-9]")) & F.regexp_like(text, F.lit(SECRET)), matches(text, SECRET)), no),
    )


def voted(x: Column) -> Column:
    """A candidate (kind, start, end, s, base, before) as kind, start, end, base, its votes shape, gazetteer, context (1 yes, 0 no, -1 no
    opinion) and the classifier's features."""
    kind, s, before = x["kind"], x["s"], x["before"]
    number = digits(s)
    known = F.when(kind == "email", F.element_at(F.split(F.lower(s), r"\.| dot |[(\[]dot[)\]]"), -1).isin(*DOMAINS))
    known = known.when(kind == "card", F.regexp_like(number, F.lit(ISSUERS)))
    known = known.when(kind == "ip", ~F.regexp_like(s, F.lit(r"^(?:0|22[4-9]|2[3-5][0-9])\.")))
    known = known.when(kind == "secret", F.regexp_like(s, F.lit(SECRET_FORMS)))
    known = known.otherwise(~F.regexp_like(number, F.lit(r"^(?:1?[01]|0{3})")))
    near = reduce(lambda c, k: c.when(kind == k, F.regexp_like(before, F.lit(CONTEXT[k]))), CONTEXT, F.when(F.lit(False), False))
    shape = F.when(kind == "secret", F.regexp_like(s, F.lit(SECRET_SHAPE))).otherwise(x["base"]).cast("int")
    marks = F.substring(F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(s, "[A-Za-z0-9]", ""), ""))), ""), 1, 8)
    left = F.when(F.regexp_like(before, F.lit(r"[:=#]\s*$")), "sign").when(F.regexp_like(before, F.lit(r"\s$")), "space").otherwise("other")
    return F.struct(
        kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"),
        shape.alias("shape"), F.when(known, 1).otherwise(0).alias("gazetteer"), F.when(near, 1).otherwise(-1).alias("context"),
        F.concat_ws(":", kind, F.lit("digits"), F.least(F.length(number), F.lit(20))).alias("f_digits"),
        F.concat_ws(":", kind, F.lit("marks"), marks).alias("f_marks"),
        F.concat_ws(":", kind, F.lit("left"), left).alias("f_left"),
        F.concat_ws(":", kind, F.lit("near"), F.when(near, "yes").otherwise("no")).alias("f_near"),
        F.concat_ws(":", kind, F.lit("shape"), shape).alias("f_shape"),
    )


FEATURES = ("f_digits", "f_marks", "f_left", "f_near", "f_shape")
LABELERS = ("shape", "gazetteer", "context")


def reliabilities(patterns: list[tuple[tuple, int]]) -> dict[tuple, float]:
    """Expectation-maximisation over (kind, votes) patterns with counts: the posterior of each pattern being personal data.

    One prior a kind; each labeler has one pair of rates over all kinds: how often it says yes of true and of false candidates.
    """
    kinds = {k[0] for k, _ in patterns}
    prior = dict.fromkeys(kinds, 0.5)
    rate = {i: [0.1, 0.9] for i in range(len(LABELERS))}
    posterior: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for key, _ in patterns:
            logs = [math.log(1 - prior[key[0]]), math.log(prior[key[0]])]
            for i, v in enumerate(key[1:]):
                if v >= 0:
                    logs = [logs[y] + math.log(rate[i][y] if v else 1 - rate[i][y]) for y in (0, 1)]
            posterior[key] = 1 / (1 + math.exp(min(700, logs[0] - logs[1])))
        for k in kinds:
            n = sum(c for key, c in patterns if key[0] == k)
            prior[k] = (1 + sum(c * posterior[key] for key, c in patterns if key[0] == k)) / (2 + n)
        for i in rate:
            for y in (0, 1):
                weigh = [(c * (posterior[key] if y else 1 - posterior[key]), key[1 + i]) for key, c in patterns if key[1 + i] >= 0]
                rate[i][y] = (0.5 + 4 * (0.9 if y else 0.1) + sum(w for w, v in weigh if v)) / (5 + sum(w for w, _ in weigh))
    return posterior


def _lookup(table: dict, key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), key), F.lit(default))


def classifier(candidates: DataFrame) -> Callable[[Column], Column]:
    """The probability of a candidate, trained on all of `candidates` (the fields of `voted` as columns)."""
    patterns = [(tuple(r[:-1]), r[-1]) for r in candidates.groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect()]  # at most 5 x 27
    posterior = reliabilities(patterns)
    name = F.concat_ws("|", "kind", *LABELERS)
    soft = candidates.withColumn("q", _lookup({"|".join(map(str, k)): v for k, v in posterior.items()}, name, 0.5))
    values = F.explode(F.array(F.concat_ws(":", "kind", F.lit("")), *[F.col(f) for f in FEATURES])).alias("value")  # the first stands for all of a kind
    sums = soft.select("kind", "q", values).groupBy("kind", "value").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).orderBy("kind", "value").collect()
    totals = {r["kind"]: (r["yes"], r["no"]) for r in sums if r["value"] == r["kind"] + ":"}
    weight = {r["value"]: math.log((r["yes"] + 0.5) / (totals[r["kind"]][0] + 1)) - math.log((r["no"] + 0.5) / (totals[r["kind"]][1] + 1)) for r in sums if r["value"] != r["kind"] + ":"}
    base = {k: math.log((y + 0.5) / (n + 0.5)) for k, (y, n) in totals.items()}

    def probability(x: Column) -> Column:
        logit = reduce(lambda a, f: a + _lookup(weight, x[f], 0.0), FEATURES, _lookup(base, x["kind"], 0.0))
        return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-50.0)), F.lit(50.0))))

    return probability


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = lambda x: F.array_position(F.array(*map(F.lit, ALL_KINDS)), x["kind"])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), place(x).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of kind, start, end), added (the same): a row per row of `docs`."""
    scanned = docs.select(F.col(id_col).alias("doc_id"), F.transform(candidates(text_of(text_col)), voted).alias("found"))
    light = staged(scanned, "pii-candidates")
    probability = classifier(light.select(F.explode("found").alias("x")).select("x.*"))
    span = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.filter("found", lambda x: x["base"])
    clear = lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))
    added = F.filter("found", lambda x: ~x["base"] & (probability(x) >= ACCEPT) & clear(x))
    return light.withColumn("base", base).select("doc_id", F.transform("base", span).alias("base"), F.array_distinct(F.transform(added, span)).alias("added"))
