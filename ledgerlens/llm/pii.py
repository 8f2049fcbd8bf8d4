"""Personal data in texts: patterns, and labelers that vote on looser candidates.

Strict patterns give the base spans. Looser patterns give further candidates. Labelers
(strict pattern, gazetteer, context words, form) vote on all candidates;
expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is, and the resulting probabilities train a naive Bayes span classifier, which
accepts or refuses the candidates beyond the base. Everything that touches rows is a
column expression; the driver sees one row per vote and feature pattern.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns. Look-behind and possessive repeats only keep a search
#: that fails from starting again inside the run that it has just left.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9]++(?:[ -][0-9]++)*+|(?:[ -][0-9]++)++)",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms that only labelers can confirm.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": r"[(\[]at[)\]]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "phone": "[0-9]{3}[ .-][0-9]{4}"}
#: Gazetteers.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "us", "ch", "at", "it", "nl"]
CALLING_CODES = ["1", "33", "34", "39", "41", "43", "44", "49", "52", "54", "55", "61", "81", "86", "91"]
CARD_STARTS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED_NETS = r"^0*(0|127|255)\."
#: Context words.
CUES = r"\b(e-?mail|mail|contact|write|call|tel|phone|mobile|fax|card|visa|mastercard|amex|credit|ip|host|server|address)\b"
COUNTER_CUES = r"\b(version|release|isbn|issn|doi|section|figure|page|chapter|error|code|hash|token|key|password)\b"
LABELERS = ["strict", "gazetteer", "context", "form"]
CONTEXT = 30

SPAN = "struct<start:int,end:int,value:string>"
CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean,strict:int,gazetteer:int,context:int,form:int,size:int,digits:int>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points.

    The pieces between the matches and the matches, added up, give the places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(values, F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["g"])
        end = start + F.char_length(pair["v"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    whole = F.filter(pairs, lambda p: p["v"].isNotNull())  # the last piece has no match behind it
    found = F.aggregate(whole, begin, add, lambda acc: acc["out"])
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the check digit fit?"""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        digit = F.substring(back, i, 1).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return acc + F.when(i % 2 == 0, double).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add)
    return total % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Does a match of a base pattern pass the test of its kind?"""
    digits = digits_of(value)
    if kind == "ip":
        byte = "^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(byte))
    if kind == "card":
        return F.when(F.char_length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        last = F.lower(F.substring_index(value, ".", -1))
        return F.when(last.isin(TOP_DOMAINS), 1).otherwise(-1)
    if kind == "ip":
        return F.when(value.rlike(RESERVED_NETS), -1).otherwise(0)
    if kind == "card":
        return F.when(digits_of(value).rlike(CARD_STARTS), 1).otherwise(-1)
    return F.when(value.rlike(r"^\+(" + "|".join(CALLING_CODES) + ")"), 1).otherwise(0)


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes and features."""
    parts = []
    for number, kind in enumerate(KINDS):
        for loose in (False, True):
            if loose and kind not in LOOSE:
                continue
            pattern = (LOOSE if loose else BASE)[kind]
            needs = (LOOSE_NEEDS if loose else NEEDS)[kind]
            parts.append(F.transform(matches(text, pattern, needs), candidate(text, number, kind, loose)))
    found = F.concat(*parts)
    # a run of digits of no card's length is no candidate at all
    return F.filter(found, lambda c: c["base"] | (c["kind"] != 2) | c["digits"].between(13, 19))


def candidate(text: Column, number: int, kind: str, loose: bool):
    def make(span: Column) -> Column:
        value, start, end = span["value"], span["start"], span["end"]
        base = F.lit(False) if loose else holds(kind, value)
        from_ = F.greatest(start - CONTEXT, F.lit(0))
        before = F.lower(F.substring(text, from_ + 1, start - from_))
        after = F.substring(text, end + 1, 1)
        context = F.when(before.rlike(COUNTER_CUES), -1).when(before.rlike(CUES), 1).otherwise(0)
        stuck = before.rlike("[a-z0-9_=\"'/-]$") | after.rlike("^[A-Za-z0-9_/]")
        few = F.size(F.array_distinct(F.split(digits_of(value), ""))) <= 2
        form = F.when(stuck | (F.lit(kind != "email") & few), -1).otherwise(1)
        strict = F.when(base, 1).otherwise(F.lit(0) if loose else F.lit(-1))
        digits = F.char_length(digits_of(value))
        return F.struct(
            F.lit(number).alias("kind"), start.alias("start"), end.alias("end"), base.alias("base"),
            strict.alias("strict"), gazetteer(kind, value).alias("gazetteer"), context.alias("context"),
            form.alias("form"), F.char_length(value).alias("size"), digits.alias("digits"),
        ).cast(CANDIDATE)

    return make


def features(span: Column) -> dict[str, Column]:
    """What the span classifier looks at, as small integers."""
    return {
        "kind": span["kind"],
        "size": F.least(F.floor(span["size"] / 6), F.lit(6)).cast("int"),
        "share": F.floor(4 * span["digits"] / F.greatest(span["size"], F.lit(1))).cast("int"),
        **{name: span[name] for name in LABELERS},
    }


@dataclass
class Model:
    """Log-odds of the span classifier, and the labelers' reliabilities for inspection."""

    prior: float
    weights: dict[str, dict[int, float]]
    reliability: dict[str, dict[int, tuple[float, float]]]

    def log_odds(self, span: Column) -> Column:
        def weight(value: Column, table: dict[int, float]) -> Column:
            chain = reduce(lambda c, kv: c.when(value == kv[0], kv[1]), table.items(), F)
            return F.lit(0.0) if chain is F else chain.otherwise(0.0)

        return reduce(
            lambda a, b: a + b,
            [weight(v, self.weights.get(n, {})) for n, v in features(span).items()],
            F.lit(self.prior),
        )


def maximise(patterns: list[tuple[dict[str, int], int]], rounds: int = 60) -> tuple[list[float], dict]:
    """Expectation-maximisation: probability of each vote pattern to be personal data.

    Two classes; each labeler votes 1, −1 or abstains (0) independently given the class.
    Starts from the majority of votes; counts get one added, so nothing is impossible.
    """
    belief = [0.9 if sum(p[n] for n in LABELERS) > 0 else 0.1 for p, _ in patterns]
    tables: dict[str, dict[int, tuple[float, float]]] = {}
    for _ in range(rounds):
        yes = sum(b * c for b, (_, c) in zip(belief, patterns)) + 1
        no = sum((1 - b) * c for b, (_, c) in zip(belief, patterns)) + 1
        for name in LABELERS:
            tables[name] = {}
            for vote in (-1, 0, 1):
                own = [(b, c) for b, (p, c) in zip(belief, patterns) if p[name] == vote]
                tables[name][vote] = (
                    (sum(b * c for b, c in own) + 1) / (yes + 2),
                    (sum((1 - b) * c for b, c in own) + 1) / (no + 2),
                )
        belief = []
        for pattern, _ in patterns:
            odds = math.log(yes / no)
            odds += sum(math.log(tables[n][pattern[n]][0] / tables[n][pattern[n]][1]) for n in LABELERS)
            belief.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
    return belief, tables


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Reliabilities and span classifier from the candidates of all texts.

    One aggregate over all candidates; the driver gets at most one row per combination
    of votes and features, which are small integers.
    """
    spans = docs.select(F.explode(candidates(F.coalesce(column(text), F.lit("")))).alias("s"))
    columns = [c.alias(n) for n, c in features(F.col("s")).items()]
    rows = spans.groupBy(*columns).count().collect()
    rows = sorted(rows)
    if not rows:
        return Model(-1.0, {}, {})
    belief, tables = maximise([(r.asDict(), r["count"]) for r in rows])
    yes = sum(b * r["count"] for b, r in zip(belief, rows)) + 1
    no = sum((1 - b) * r["count"] for b, r in zip(belief, rows)) + 1
    weights: dict[str, dict[int, float]] = {}
    for name in features(F.col("s")):
        values = sorted({r[name] for r in rows})
        weights[name] = {}
        for value in values:
            own = [(b, r["count"]) for b, r in zip(belief, rows) if r[name] == value]
            good = (sum(b * c for b, c in own) + 1) / (yes + len(values))
            bad = (sum((1 - b) * c for b, c in own) + 1) / (no + len(values))
            weights[name][value] = math.log(good / bad)
    return Model(math.log(yes / no), weights, tables)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans that come sorted, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    )


def detect(docs: DataFrame, model: Model, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Kept columns plus ``base`` and ``every``: sorted arrays of (kind, start, end).

    ``base`` are the strict matches. ``every`` adds the candidates that the classifier
    accepts and that touch no base span. Null texts are empty.
    """
    own = docs.select(
        *(column(c).alias(n) for n, c in keep.items()),
        candidates(F.coalesce(column(text), F.lit(""))).alias("_all"),
    )

    def place(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    base = F.transform(F.filter("_all", lambda s: s["base"]), place)
    own = own.withColumn("base", F.array_sort(base))
    extra = F.filter("_all", lambda s: ~s["base"] & (model.log_odds(s) > 0))

    def free(s: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    added = F.transform(F.filter(extra, free), place)
    return own.select(*keep, "base", F.array_distinct(F.array_sort(F.concat("base", added))).alias("every"))


def personal_data(docs: DataFrame, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Per row: kept columns, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and hash are of the base spans, ``spans`` lists all. Places are code points,
    the end is exclusive. Null and empty texts have none. Rows are independent: repeated
    rows stay repeated; an empty table gives an empty table.
    """
    found = detect(docs, fit(docs, text), keep, text)

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)]
    return found.select(
        *keep, *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("every")).alias("spans"),
    )


def redact(docs: DataFrame, model: Model, text: str = "text", length: str | None = None) -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets.

    Overlapping spans become one, named after the first. Texts without a span (null
    ones too) stay as they are. ``length`` names a column to set to the new number of
    characters.
    """
    columns = docs.columns
    own = docs.select(F.struct(*(column(c) for c in columns)).alias("_row"), column(text).alias("_t"))
    own = detect(own, model, {"_row": "_row", "_t": "_t"}, "_t")
    by_place = F.array_sort(
        F.transform("every", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    kind = "array<struct<start:int,end:int,kind:int>>"

    def melt(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        touching = (F.size(acc) > 0) & (s["start"] < last["end"])
        return F.when(touching, F.concat(rest, F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    own = own.withColumn("_m", F.aggregate(by_place, F.array().cast(kind), melt))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at("_m", i)["end"]).otherwise(0)
        return F.concat(F.substring("_t", before + 1, s["start"] - before), names[s["kind"]])

    rest = F.expr("substring(_t, element_at(_m, -1).end + 1)")
    new = F.when(F.size("_m") > 0, F.concat(F.array_join(F.transform("_m", piece), ""), rest)).otherwise(F.col("_t"))
    own = own.withColumn("_new", new)
    out = own.select("_row.*", "_new")
    values = [F.col("_new").alias(c) if c == text else column(c) for c in columns]
    if length in columns:
        size = F.coalesce(F.char_length("_new").cast(docs.schema[length].dataType), column(length))
        values[columns.index(length)] = size.alias(length)
    return out.select(*values)
