"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, spans judged.

Four strict kinds (email, ip, card, phone) are matched by fixed patterns and always stay. Looser
candidates, ``secret`` (keys, tokens, passwords) and ``number`` (phone or card numbers that the
strict patterns miss), are taken if a span classifier agrees. Every span, strict or loose, gets votes
of regex, gazetteer, context, checksum and shape labelers. Spans are counted by kind, votes and
length, a bounded number of combinations however large the corpus; from these counts
expectation-maximisation estimates each labeler's reliability and each combination's probability,
and a logistic classifier is trained on those.

Strict patterns are leftmost and do not overlap within a kind; matches that fail a check (parts of
an ip at most 255, 16 to 19 digits with a right Luhn sum, 8 to 15 digits) are dropped without a
second try. Positions count code points. A candidate that overlaps a strict span is left out.

Null texts are empty. Rows are judged one by one, so repeated rows and ids get equal results.
Everything runs as column expressions; only the table of counts reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casequeue.llm.common import fresh, handed_over

STRICT = ("email", "ip", "card", "phone")
LOOSE = ("secret", "number")
KINDS = (*STRICT, *LOOSE)
CUES = (
    "tel|phone|mobile|call|fax|mail|contact|card|visa|iban|account|konto|tarjeta|carte|host|server|"
    "address|token|password|passwd|secret|key|ssn|id"
)

CONTEXT = 24  # characters before a match that labelers see
SLICE = 256

# Matches start where a run of their characters starts, or where the last match ended: the same
# matches as without that condition, found in linear time. Possessive loops need no stack.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api[_-]?key)"
    r"[\x20]{0,2}[=:][\x20]{0,2}[\x22']?[0-9A-Za-z+/_-]{8,}+",
    "number": r"(?<![0-9A-Za-z.+-])[0-9(][0-9\x20().-]{7,24}[0-9](?![0-9A-Za-z])",
}
_NEEDS = {"email": "@", "phone": "+"}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn sum."""

    def add(total, i):
        x = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(x)

    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return F.rlike(match, F.lit(rf"\A{_PART}(?:\.{_PART}){{3}}\z"))
    if kind == "card":
        return F.when(n.between(16, 19), luhn_ok(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, state: Column, out: str, step) -> Column:
    """Outputs of ``step(state, value)``, a struct of ``state`` and ``out``, over an array in order.

    Works in slices, so that no long array is copied for every element.
    """
    none = F.array().cast(f"array<{out}>")
    nothing = F.array().cast(f"array<array<{out}>>")

    def one(acc, x):
        made = step(acc["state"], x)
        return F.struct(made["state"].alias("state"), F.concat(acc["outs"], F.array(made["out"])).alias("outs"))

    def scanned(v):
        def part(acc, i):
            inner = F.aggregate(
                F.slice(v, i * SLICE + 1, SLICE),
                F.struct(acc["state"].alias("state"), none.alias("outs")),
                one,
            )
            return _let(
                inner,
                lambda r: F.struct(
                    r["state"].alias("state"), F.concat(acc["outs"], F.array(r["outs"])).alias("outs")
                ),
            )

        parts = F.sequence(F.lit(0), F.ceil(F.size(v) / SLICE).cast("int") - 1)
        folded = F.aggregate(parts, F.struct(state.alias("state"), nothing.alias("outs")), part)
        return F.when(F.size(v) > 0, F.flatten(folded["outs"])).otherwise(none)

    return _let(values, scanned)


_MATCH = "struct<m:string,s:int,e:int,b:string,a:string>"


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind with their places, and the text before and after up to other matches.

    Lengths of matches and of the gaps between them add up to places.
    """
    pattern = F.lit(PATTERNS[kind])
    possible = F.instr(text, _NEEDS[kind]) > 0 if kind in _NEEDS else F.lit(True)
    none = F.array().cast("array<string>")
    matches = F.when(possible, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none)

    def paired(m):
        gaps = F.when(F.size(m) > 0, F.split(text, PATTERNS[kind], -1)).otherwise(none)

        def zipped(g):
            after = F.slice(g, 2, F.greatest(F.size(g), F.lit(1)))
            return F.filter(
                F.arrays_zip(m.alias("m"), g.alias("g"), after.alias("h")), lambda x: x["m"].isNotNull()
            )

        return _let(gaps, zipped)

    pairs = _let(matches, paired)

    def step(at, x):
        start = at + F.length(x["g"])
        end = start + F.length(x["m"])
        near = F.substring(x["g"], F.lit(-CONTEXT), F.lit(CONTEXT))
        span = F.struct(
            x["m"].alias("m"), start.alias("s"), end.alias("e"),
            near.alias("b"), F.substring(x["h"], 1, 1).alias("a"),
        )
        return F.struct(end.alias("state"), span.alias("out"))

    return F.filter(_scan(pairs, F.lit(0), _MATCH, step), lambda x: _valid(kind, x["m"]))


def _votes(kind: str, span: Column) -> Column:
    """Votes of the labelers on a span, one character each: y, n or - for none."""

    def vote(condition, no="n"):
        return F.when(condition, "y").otherwise(no)

    match, before, after = span["m"], span["b"], span["a"]
    digits = _digits(match)
    n = F.length(digits)
    if kind == "secret":
        regex = vote(F.rlike(match, F.lit(r"\AAKIA|[0-9a-f]{16,}")), "-")
        cue = vote(F.rlike(match, F.lit(rf"(?i)\A(?:{CUES})")), "-")
    else:
        regex = F.lit("y" if kind in STRICT else "-")
        cue = vote(F.rlike(before, F.lit(rf"(?i)(?:\A|[^a-z])(?:{CUES})[^a-z]{{1,4}}\z")), "-")
    edge = vote(
        F.rlike(before, F.lit(r"(?:\A|[\s\x22'(<:,;=])\z"))
        & F.rlike(after, F.lit(r"\A(?:[\s\x22')>.,;:!?]|\z)"))
    )
    sums = kind in ("card", "number")
    check = F.when(n.between(13, 19), vote(luhn_ok(digits))).otherwise("-") if sums else F.lit("-")
    distinct = F.size(F.array_distinct(F.split(match, "")))
    shape = vote(distinct >= 5)
    likely = {"number": n.between(10, 15), "secret": F.length(match) >= 16}.get(kind, F.length(match) >= 7)
    return F.concat(regex, cue, edge, check, shape, vote(likely))


def spans_of(text: Column) -> Column:
    """All strict spans and loose candidates of a text, with kind, place, votes and length class."""
    return _let(F.coalesce(text, F.lit("")), _described)


def _described(text: Column) -> Column:
    def described(kind):
        return F.transform(
            _found(text, kind),
            lambda x: F.struct(
                F.lit(KINDS.index(kind)).alias("k"),
                x["s"].alias("s"),
                x["e"].alias("e"),
                _votes(kind, x).alias("v"),
                F.least(F.lit(7), F.floor((x["e"] - x["s"]) / 6)).cast("int").alias("n"),
            ),
        )

    return F.concat(*(described(k) for k in KINDS))


_SPAN = "struct<s:int,k:int,e:int,v:string,n:int,free:boolean>"


def _apart(found: Column) -> Column:
    """Without loose candidates that overlap a strict span, or a candidate of an earlier kind.

    One scan by start looks back at ends, one from the other side looks forward at starts.
    """
    secret = KINDS.index("secret")

    def looked(at_ends: bool):
        def step(state, x):
            strict, secrets = state["strict"], state["secrets"]
            edge, other = (x["e"], x["s"]) if at_ends else (-x["s"], -x["e"])
            met = (x["k"] >= len(STRICT)) & ((strict > other) | ((x["k"] > secret) & (secrets > other)))
            state = F.struct(
                F.when(x["k"] < len(STRICT), F.greatest(strict, edge)).otherwise(strict).alias("strict"),
                F.when(x["k"] == secret, F.greatest(secrets, edge)).otherwise(secrets).alias("secrets"),
            )
            out = F.struct(*(x[c].alias(c) for c in "skevn"), (x["free"] & ~met).alias("free"))
            return F.struct(state.alias("state"), out.alias("out"))

        return step

    def cleared(found):
        return _cleared(found, looked)

    return _let(found, cleared)


def _cleared(found: Column, looked) -> Column:
    low = F.lit(-(1 << 30))
    start = F.struct(low.alias("strict"), low.alias("secrets"))
    spans = F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in "skevn"), F.lit(True).alias("free")))
    forward = _scan(F.array_sort(spans), start, _SPAN, looked(True))
    both = _scan(F.reverse(forward), start, _SPAN, looked(False))
    apart = F.transform(
        F.filter(both, lambda x: x["free"]), lambda x: F.struct(*(x[c].alias(c) for c in "ksevn"))
    )
    loose = F.exists(found, lambda x: x["k"] >= len(STRICT))
    return F.when(loose, apart).otherwise(found)


def fit_spans(counts: list[tuple[int, str, int, int]], rounds: int = 50) -> dict:
    """Probability of personal data for each (kind, votes, length class), from their counts."""
    if not counts:
        return {}
    kinds = np.array([c[0] for c in counts])
    votes = np.array([["y-n".index(v) for v in c[1]] for c in counts])
    lengths = np.array([c[2] for c in counts])
    weight = np.array([c[3] for c in counts], float)
    n_votes = votes.shape[1]
    p = 0.5 + 0.4 * ((votes == 0).sum(1) - (votes == 2).sum(1)) / n_votes
    rate = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        # Reliabilities: how often each labeler votes what, on personal data and on the rest.
        table = np.ones((2, n_votes, 3))
        for side, share in enumerate((1 - p, p)):
            for labeler in range(n_votes):
                table[side, labeler] += np.bincount(votes[:, labeler], share * weight, 3)
        table /= table.sum(2, keepdims=True)
        mass = np.bincount(kinds, weight, len(KINDS))
        rate = (np.bincount(kinds, p * weight, len(KINDS)) + 1) / (mass + 2)
        odds = np.log(rate[kinds] / (1 - rate[kinds]))
        for labeler in range(n_votes):
            v = votes[:, labeler]
            odds += np.log(table[1, labeler, v]) - np.log(table[0, labeler, v])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    # The final classifier sees kind, votes and length class, and learns the estimates.
    x = np.concatenate(
        [np.eye(len(KINDS))[kinds], *(np.eye(3)[votes[:, i]] for i in range(n_votes)), np.eye(8)[lengths]], 1
    )
    w, share = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(400):
        q = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (share * (q - p)) + 1e-5 * w)
    q = 1 / (1 + np.exp(-x @ w))
    return {(int(k), c[1], int(n)): float(v) for k, c, n, v in zip(kinds, counts, lengths, q, strict=True)}


def _fitted(found: DataFrame, column: str) -> dict:
    """At most kinds x 3**labelers x 8 counts reach the driver."""
    spans = found.select(F.explode(column).alias("x")).select("x.k", "x.v", "x.n")
    counted = spans.groupBy("k", "v", "n").count().orderBy("k", "v", "n").collect()
    return fit_spans([(r["k"], r["v"], r["n"], r["count"]) for r in counted])


def _accepted(found: Column, model: dict) -> Column:
    """Strict spans, and candidates that the classifier takes for personal data."""
    taken = sorted(
        f"{k}{v}{n}" for (k, v, n), p in model.items() if k >= len(STRICT) and p >= 0.5
    )
    key = F.lit(taken).cast("array<string>")
    return F.filter(
        found,
        lambda x: (x["k"] < len(STRICT))
        | F.array_contains(key, F.concat(x["k"].cast("string"), x["v"], x["n"].cast("string"))),
    )


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["k"], x["s"], x["e"])))
    return F.array_join(
        F.transform(
            ordered, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])
        ),
        ",",
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, numbers of strict spans by kind, digest of the strict spans, and all spans."""
    raw = docs.select("doc_id", spans_of(F.col("text")).alias("raw"))
    found = handed_over(raw.select("doc_id", _apart(F.col("raw")).alias("found")))
    model = _fitted(found, "found")
    strict = F.filter("found", lambda x: x["k"] < len(STRICT))
    spans = _accepted(F.col("found"), model)

    def number(kind):
        return F.size(F.filter("found", lambda x: x["k"] == KINDS.index(kind))).cast("long")

    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in STRICT),
        F.sha2(_written(strict).cast("binary"), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and ``n_chars`` set anew.

    Where spans overlap, the first takes the place of all. A text without spans is unchanged.
    """
    raw, kept = fresh(docs, "raw", "found")
    found = docs.withColumn(raw, spans_of(F.col("text"))).withColumn(kept, _apart(F.col(raw))).drop(raw)
    model = _fitted(found, kept)
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    text = F.coalesce(F.col("text"), F.lit(""))

    ordered = F.array_sort(
        F.transform(
            _accepted(F.col(kept), model),
            lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")),
        )
    )

    def step(at, x):
        part = F.concat(F.substring(text, at + 1, x["s"] - at), F.element_at(names, x["k"] + 1))
        out = F.when(x["s"] < at, "").otherwise(part)
        return F.struct(F.greatest(at, x["e"]).alias("state"), out.alias("out"))

    parts = F.array_join(_scan(ordered, F.lit(0), "string", step), "")
    end = F.array_max(F.transform(ordered, lambda x: x["e"]))
    rest = F.substring(text, end + 1, F.length(text))
    new = F.when(F.size(ordered) == 0, F.col("text")).otherwise(F.concat(parts, rest))
    out = found.withColumn("text", new).drop(kept)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind))
    return out.select(*docs.columns)
