"""Personal data and secrets by weak supervision, in DataFrame functions only.

Four base patterns find certain spans.  Looser patterns propose more, of these kinds and of secrets; regex, gazetteer,
checksum and context labelers vote on every candidate, base spans included, and expectation-maximisation over the
counts of vote patterns estimates how far each labeler can be trusted.  The probabilities that follow for the
candidates are the labels on which a naive Bayes classifier over other features of a span (its shape and length, what
stands next to it, the word before it) is fitted; the classifier decides which proposals become spans.  Base spans
always stay.  Only counts of vote patterns, at most 3 ** labelers per kind, and of features, at most a few hundred
values per kind, reach the driver.

Positions are code points, end exclusive.  Spans of a kind are found left to right; a proposal that overlaps a base
span, or an accepted one of an earlier kind, is left out.

Cases: a null or empty text has no spans; a text of any length is read whole, in nearly linear time (every repetition
either is possessive, bounded or starts only where its run starts, and places are summed block by block); repeated
rows are judged each on its own; a column ``personal`` of the documents is replaced, all others pass through; without
candidates nothing is added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, fresh, once, table

#: A match may start where a run of the class starts or where the last match ended; elsewhere it would have started
#: earlier.  This finds the same matches as the plain pattern without trying every place of a long run.
_AT = r"(?:\G|(?<![{0}]))"

#: Base patterns (fixed values), in the order in which kinds are listed.
BASE = {
    "email": _AT.format(r"A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _AT.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must be in a text for a kind to be looked for.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: Looser proposals: an address in words, an address of version 6 or with its dots in brackets, a number of a card's
#: length, a phone number without its plus sign, a long run of letters and digits.
LOOSE = {
    "email": _AT.format(r"A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![+0-9().-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9]{2,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4})(?![0-9-])",
    "secret": r"(?<![0-9A-Za-z_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[0-9A-Za-z_+/-]{20,256}+(?![0-9A-Za-z_+/-])",
}
LOOSE_HINT = {"email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]|\[\.\]", "card": r"[0-9](?:[\x20.-]?[0-9]){12}", "phone": r"[0-9]{3}[\x20./-][0-9]{3}", "secret": r"[0-9A-Za-z_+/-]{20}"}

#: Gazetteers: endings of mail hosts, networks that belong to no one, first digits of card issuers, area codes that are
#: never given out, beginnings of known keys and words that stand in for one (fixed values).
MAIL_ENDINGS = r"(?i)(?:com|org|net|edu|gov|mil|int|info|biz|name|io|app|dev|[a-z]{2})$"
DEAD_NETWORKS = r"^(?:0|127|255)[\[.]|^(?:0{1,4}:)+0{0,3}1?$|^2001:0?db8:"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0457689]|6)"
DEAD_AREAS = r"^(?:0|1|911|999|555)"
KEY_STARTS = r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|sk-|pk_|sk_|xox[abp]-|AIza|eyJ)"
PLACEHOLDERS = r"(?i)example|changeme|placeholder|your|x{6}|0{8}|12345678"
#: Words before a span that speak for its kind, and ones that speak against it (fixed values).
CONTEXT_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address|reach|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|client|peer|login|logged|from|address|adresse)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|iban|account|payment|karte|konto|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|dial|contact|telefon|t[eé]l[eé]phone|tel[eé]fono|handy)\b",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|auth|bearer|api.?key|access.?key|private.?key|credential)[\x20\"'_:=]*$",
}
CONTEXT_AGAINST = {
    "secret": r"(?i)\b(?:commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|uuid|build|revision|integrity)[\x20\"'_:=-]*$",
}
NUMBER_AGAINST = r"(?i)\b(?:isbn|issn|doi|order|invoice|version|build|part|serial|section|figure|table|page|line)\b"
CONTEXT_CHARS = 40
LABELERS = 4
EM_ROUNDS = 60
#: Buckets for the word before a span.
WORD_BUCKETS = 256
#: Spans whose places are summed in one go.
BLOCK = 512


_SPANS = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def _spans(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<s, e, m, before, after>>: matches left to right, from the pieces between them and their own lengths.

    ``before`` and ``after`` are the last CONTEXT_CHARS characters and the first one of the pieces around a match.

    Places are sums over all pieces before; they are made in blocks, so that many matches cost nearly linear time.
    """
    none = F.array().cast(_SPANS)
    found = once(
        F.split(text, pattern, -1),
        lambda gaps: F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next")),
    )

    def size(x: Column) -> Column:
        return F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(
            begin.cast("int").alias("s"), end.cast("int").alias("e"), x["m"].alias("m"), F.substring(x["gap"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"), F.substring(x["next"], 1, 1).alias("after")
        )
        return F.struct(end.cast("int").alias("at"), F.when(x["m"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"))

    def places(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.cast("int").alias("at"), none.alias("out")), step, lambda s: s["out"])

    def of_blocks(b: Column) -> Column:
        totals = F.transform(b, lambda block: F.aggregate(block, F.lit(0), lambda total, x: total + size(x)))
        starts = once(totals, lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda k: F.aggregate(F.slice(t, F.lit(1), k), F.lit(0), lambda total, x: total + x)))
        return F.flatten(F.zip_with(b, starts, places))

    blocks = once(found, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK))))
    return F.when(text.rlike(hint), once(blocks, of_blocks)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(places, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


@dataclass(frozen=True)
class LabelModel:
    """Reliabilities of one kind's labelers: P(vote | personal) and P(vote | not), and the share of personal spans."""

    prior: float
    given: tuple[dict[int, float], ...]
    other: tuple[dict[int, float], ...]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(g[v] / o[v]) for v, g, o in zip(votes, self.given, self.other, strict=True))


def fit_label_model(patterns: dict[tuple[int, ...], float], labelers: int, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over counts of vote patterns; votes are 1, -1 or 0 (abstains).

    It starts from labelers that are right in three of four votes, so the two classes keep their meaning; counts are
    smoothed by one, which also gives the defined answer for kinds without candidates.
    """
    prior = 0.5
    given = [{1: 0.6, 0: 0.2, -1: 0.2}] * labelers
    other = [{1: 0.2, 0: 0.2, -1: 0.6}] * labelers
    for _ in range(rounds):
        model = LabelModel(prior, tuple(given), tuple(other))
        soft = {v: 1 / (1 + math.exp(-model.log_odds(v))) for v in patterns}
        total, yes = sum(patterns.values()), sum(n * soft[v] for v, n in patterns.items())
        prior = (yes + 1) / (total + 2)
        given = [{s: (sum(n * soft[v] for v, n in patterns.items() if v[k] == s) + 1) / (yes + 3) for s in (1, 0, -1)} for k in range(labelers)]
        other = [{s: (sum(n * (1 - soft[v]) for v, n in patterns.items() if v[k] == s) + 1) / (total - yes + 3) for s in (1, 0, -1)} for k in range(labelers)]
    return LabelModel(prior, tuple(given), tuple(other))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def labelers(kind: str, m: Column, before: Column) -> list[Column]:
    """Votes of the regex, gazetteer, checksum and context labelers on a candidate ``m`` with the text ``before`` it."""
    digits = _digits(m)
    if kind == "email":
        regex = _vote(m.rlike(r"^[A-Za-z][A-Za-z0-9._%+-]{1,63}(?:@|\x20?[\[(])"), m.rlike(r"^[0-9._%+-]*(?:@|\x20?[\[(])"))
        gazetteer = _vote(m.rlike(MAIL_ENDINGS), ~m.rlike(r"[A-Za-z]{2,}$"))
        check = _vote(~m.rlike(r"\.\.|\.@|^\.|-\.") & (F.length(m) <= 254), m.rlike(r"\.\.|\.@"))
    elif kind == "ip":
        regex = _vote(m.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:(?:\.|\[\.\])(?:[1-9][0-9]{0,2}|0)){3}$|^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"), m.rlike(r"(?:^|\.)0[0-9]"))
        gazetteer = _vote(~m.rlike(DEAD_NETWORKS), m.rlike(DEAD_NETWORKS))
        check = _vote(m.contains(":") | _valid("ip", F.regexp_replace(m, r"[\[\]]", "")), m.rlike(r"(?:^|\.)[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
    elif kind == "card":
        regex = _vote(m.rlike(r"^[0-9]{15,16}$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$"), m.rlike(r"[.]|[\x20-][0-9][\x20-]"))
        gazetteer = _vote(digits.rlike(CARD_ISSUERS), digits.rlike(r"^0{4}"))
        check = _vote(_valid("card", m), digits.rlike(r"^([0-9])\1+$|^(?:0123456789|1234567890)"))
    elif kind == "phone":
        regex = _vote(m.rlike(r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}$"), F.length(digits) < 9)
        area = F.substring(digits, -10, 3)
        gazetteer = _vote(~area.rlike(DEAD_AREAS), area.rlike(r"^(?:000|111|999)"))
        check = _vote(F.length(digits).between(10, 13), digits.rlike(r"^([0-9])\1+$"))
    else:
        regex = _vote(m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | m.rlike(r"[0-9].*[A-Z].*[0-9]") & m.rlike("[a-z]"), m.rlike(r"^[A-Za-z]+[_/-][A-Za-z0-9_/-]*$") & ~m.rlike(KEY_STARTS))
        gazetteer = _vote(m.rlike(KEY_STARTS), m.rlike(PLACEHOLDERS))
        check = _vote(F.size(F.array_distinct(F.split(m, ""))) >= 12, F.size(F.array_distinct(F.split(m, ""))) < 8)
    return [regex, gazetteer, check, _vote(before.rlike(CONTEXT_FOR[kind]), before.rlike(CONTEXT_AGAINST.get(kind, NUMBER_AGAINST)))]


def _side(c: Column) -> Column:
    """Class of a neighbouring character."""
    return (
        F.when(c == "", "none").when(c.rlike(r"\s"), "blank").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike("[\"'`]"), "quote").when(c.rlike("[=:]"), "sign").otherwise("other")
    )


def span_features(m: Column, before: Column, after: Column) -> Column:
    """What the classifier sees of a span; each value begins with the feature's number."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(m, 1, 64), "[0-9]+", "9"), r"\p{L}+", "a"), r"[^9a.@:+()\x20-]", "_")
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1))
    return F.array(
        F.concat(F.lit("0"), F.substring(shape, 1, 4)),
        F.concat(F.lit("1"), F.floor(F.log2(F.length(m).cast("double"))).cast("string")),
        F.concat(F.lit("2"), _side(F.substring(before, -1, 1))),
        F.concat(F.lit("3"), _side(after)),
        F.concat(F.lit("4"), F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("string")),
    )


def _judged(spans: Column, kind: str) -> Column:
    """The spans with their votes and features."""

    def judged(x: Column) -> Column:
        seen = span_features(x["m"], x["before"], x["after"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*labelers(kind, x["m"], x["before"])).alias("votes"), seen.alias("seen"))

    return F.transform(spans, judged)


@dataclass(frozen=True)
class SpanClassifier:
    """Naive Bayes over span features, one per kind: log prior odds and the log ratio of each value."""

    prior: dict[str, float]
    ratio: dict[tuple[str, str], float]

    def score(self, kind: str, seen: Column) -> Column:
        of = {v: r for (k, v), r in self.ratio.items() if k == kind}
        if not of:
            return F.lit(self.prior.get(kind, -1.0))
        known = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
        return F.aggregate(seen, F.lit(self.prior[kind]), lambda total, v: total + F.coalesce(F.element_at(known, v), F.lit(0.0)))


def fit_span_classifier(candidates: DataFrame) -> SpanClassifier:
    """``candidates`` is (kind, votes, seen): labels are estimated from the votes, then the classifier is fitted to them."""
    patterns: dict[str, dict[tuple[int, ...], float]] = {}
    for r in candidates.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect():
        patterns.setdefault(r["kind"], {})[tuple(r["votes"])] = float(r["n"])
    models = {kind: fit_label_model(of, LABELERS) for kind, of in patterns.items()}
    soft = {f"{kind}{','.join(map(str, v))}": 1 / (1 + math.exp(-models[kind].log_odds(v))) for kind, of in patterns.items() for v in of}
    if not soft:
        return SpanClassifier({}, {})
    label = F.element_at(F.create_map(*[F.lit(x) for pair in soft.items() for x in pair]), F.concat("kind", F.array_join(F.col("votes").cast("array<string>"), ",")))
    labelled = candidates.select("kind", label.alias("p"), F.explode("seen").alias("value"))
    counts = labelled.groupBy("kind", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    prior, ratio = {}, {}
    for kind in models:
        rows = [r for r in counts if r["kind"] == kind]
        # Every candidate has one value of each feature, so the first feature's values count the candidates.
        yes, no = (sum(r[k] for r in rows if r["value"][0] == "0") for k in ("yes", "no"))
        prior[kind] = math.log((yes + 1) / (no + 1))
        for number in {r["value"][0] for r in rows}:
            of = [r for r in rows if r["value"][0] == number]
            for r in of:
                ratio[kind, r["value"]] = math.log((r["yes"] + 1) / (yes + len(of)) / ((r["no"] + 1) / (no + len(of))))
    return SpanClassifier(prior, ratio)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``personal``: array<struct<kind, start, stop, base>> by kind and place."""
    docs = docs.drop("personal")
    named = fresh(docs, *[f"{way}_{kind}" for way in ("base", "more") for kind in LOOSE])
    base, more = dict(zip(LOOSE, named[: len(LOOSE)], strict=True)), dict(zip(LOOSE, named[len(LOOSE) :], strict=True))
    whole = F.coalesce(F.col(text), F.lit(""))
    nothing = F.array().cast(_SPANS)

    def of(kind: str) -> Column:
        return F.filter(_spans(whole, BASE[kind], HINT[kind]), lambda x: _valid(kind, x["m"])) if kind in BASE else nothing

    def meets(x: Column, spans: Column) -> Column:
        return F.exists(spans, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))

    def apart(spans: Column, others: Column) -> Column:
        return F.filter(spans, lambda x: ~meets(x, others))

    def proposals(kind: str) -> Column:
        def free(x: Column) -> Column:
            out = F.lit(True)
            for name in base.values():
                out = out & ~meets(x, F.col(name))
            return out

        return _judged(F.filter(_spans(whole, LOOSE[kind], LOOSE_HINT[kind]), free), kind)

    found = docs.withColumns({base[k]: of(k) for k in LOOSE}).withColumns({more[k]: proposals(k) for k in LOOSE})

    def cast(kind: str) -> Column:
        every = F.concat(F.col(more[kind]), _judged(F.col(base[kind]), kind))
        return F.transform(every, lambda x: F.struct(F.lit(kind).alias("kind"), x["votes"].alias("votes"), x["seen"].alias("seen")))

    classifier = fit_span_classifier(cut(found.select(F.explode(F.concat(*[cast(k) for k in LOOSE])).alias("x")).select("x.*")))

    def accepted(kind: str) -> Column:
        return F.filter(more[kind], lambda x: classifier.score(kind, x["seen"]) >= 0)

    out = found.withColumns({more[k]: accepted(k) for k in LOOSE})
    kinds = list(LOOSE)
    out = out.withColumns({more[k]: apart(F.col(more[k]), F.concat(*[F.col(more[e]) for e in kinds[:n]])) for n, k in enumerate(kinds) if n})

    def listed(kind: str) -> Column:
        def place(x: Column, is_base: bool) -> Column:
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("stop"), F.lit(is_base).alias("base"))

        return F.array_sort(F.concat(F.transform(base[kind], lambda x: place(x, True)), F.transform(more[kind], lambda x: place(x, False))))

    return out.withColumn("personal", F.concat(*[listed(k) for k in LOOSE])).drop(*named)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("personal", lambda x: x["base"])

    def n_base(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind))

    return found.select(
        "doc_id",
        *[n_base(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("personal")).alias("spans"),
        F.size("personal").cast("long").alias("n_spans"),
    )
