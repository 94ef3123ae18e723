"""Personal data by weak supervision, in DataFrame functions throughout.

Patterns propose spans in whole texts. Labelers vote on each span: a strict pattern, a gazetteer (top-level domains,
dialling codes, card issuers, reserved addresses, key prefixes), the words before it, and its shape. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is, and a logistic classifier of
spans is trained on the expected labels. Spans of the four base kinds stay; those of other kinds (secrets, account and
national numbers, telephone numbers without a plus) are added where the classifier says so. Only the counts of vote patterns, at most a fixed number of rows, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import materialise

#: Marks the ends of matches; where a text has it, U+E001 stands in, which no pattern knows.
MARK = ""
#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "national", "tel")
BASE = 4
#: Patterns that match what the plain ones match, but try a run of characters once, from its begin.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=(?:[0-9][\x20-]?){14})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+={0,2}+(?:\.[A-Za-z0-9_-]{12,}+){0,2}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "tel": r"(?<![0-9A-Za-z+(.-])(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))(?:\([0-9]{2,5}\)[\x20.-]?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z-])",
}
#: What a text must hold to be searched at all.
NEEDS = {"email": "@", "phone": "+", "national": "-"}
#: Gazetteers.
DOMAINS = "com|net|org|edu|gov|io|info|biz|de|fr|es|it|nl|uk|eu|ch|at|be|pl|ru|cn|jp|br|in|us|ca|au"
DIALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|3[068])"
RESERVED = r"(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
KEY_PREFIXES = r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|pk[-_]|rk_|npm_|hf_|eyJ)"
COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
AREA_CODES = r"^\(?(?:0[1-9]|[2-9][0-9])"
CUES = {
    "email": r"(?:mail|contact|write|@|to:|from:)", "ip": r"(?:\bip\b|host|address|server|client)",
    "card": r"(?:card|visa|master|amex|credit|payment|karte|tarjeta|carte)", "phone": r"(?:tel|phone|call|fax|mobile|cell)",
    "secret": r"(?:passw|pwd|token|secret|api.?key|credential|bearer|auth)", "iban": r"(?:iban|account|konto|cuenta|compte|bank)",
    "national": r"(?:ssn|social|security|national|insurance|tax.?id)", "tel": r"(?:tel|phone|call|fax|mobile|cell)",
}
AGAINST = r"(?:version|release|isbn|issn|order|invoice|article|commit|sha1|sha256|md5|uuid|build|part|serial)\W{0,4}$"
#: Characters before a span that the context labeler reads; votes: -1 abstains, 0 against, 1 for.
CONTEXT, LABELERS, BUCKETS = 32, ("strict", "gazetteer", "context", "shape"), 3
#: Code points of the segments that pieces of a text are cut from.
SEGMENT = 1024

SPAN = "struct<start:int,kind:int,end:int,match:string,before:string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array that isn't empty under an associative join, in steps that double: n log n."""
    levels = F.ceil(F.log2(F.size(values))).cast("int")

    def step(acc: Column, level: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= _power(level), join(F.get(acc, i - _power(level)), x)).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), levels), values, step)


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), level)


def _spans(text: Column, kind: str) -> Column:
    """All matches in a text, leftmost and without overlaps, as an array of SPAN in code points."""
    gate = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    marked = F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}")

    def found(parts: Column, ends: Column) -> Column:
        def span(i: Column) -> Column:
            before = F.lower(F.right(F.get(parts, i - 1), F.lit(CONTEXT)))
            return F.struct(F.get(ends, i - 1).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(ends, i).alias("end"), F.get(parts, i).alias("match"), before.alias("before"))

        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), span)

    def listed(parts: Column) -> Column:
        ends = _scan(F.transform(parts, F.length), lambda a, b: a + b)
        return F.when(F.size(parts) > 1, _let(ends, lambda e: found(parts, e)))

    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return F.coalesce(_let(F.split(F.when(gate, marked), MARK, -1), listed), none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, the last first, pass: every second is doubled and its digits summed."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(match))
        return n.between(14, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "tel":
        return F.length(_digits(match)).between(9, 12)
    return F.lit(True)


def _valid_span(kind: str, s: Column) -> Column:
    return _valid(kind, s["match"])


def _of_kind(number: int, s: Column) -> Column:
    return s["kind"] == number


def _checked(iban: Column) -> Column:
    """Whether an IBAN's check digits are right: the first four characters put last, letters as 10 to 35, modulo 97 it is 1."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _votes(s: Column) -> list[Column]:
    """The labelers' votes on a span, in the order of LABELERS."""
    m, before, kind = s["match"], s["before"], s["kind"]

    def of(values: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(kind == KINDS.index(k), v) for k, v in values.items()], F.lit(-1))

    never, n_digits = F.lit(False), F.length(_digits(m))
    slug = r"^(?:[A-Za-z]{2,}+|[0-9]{1,4})(?:[-_/+](?:[A-Za-z]{2,}+|[0-9]{1,4}))++$|^(?:[A-Za-z]++[0-9]{1,4}|[0-9]{1,4}[A-Za-z]++)$"
    key = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++|[0-9a-f]{16,}+|[0-9A-F]{16,}+)$"
    strict = of({
        **{k: F.lit(1) for k in KINDS[:BASE]},
        "secret": _vote(m.rlike(key), m.rlike(slug)),
        "iban": _vote(_checked(m), ~_checked(m)),
        "national": _vote(~m.rlike("^(?:000|666|9)|-00-|-0000$"), m.rlike("^(?:000|666|9)|-00-|-0000$")),
        "tel": _vote(m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^\(?0[0-9]{1,4}\)?[\x20./-][0-9]"), m.rlike(r"^[12][0-9]{3}[./-][01][0-9][./-]|^(?:[0-9]{2,5}\x20)+[0-9]+$")),
    })
    gazetteer = of({
        "email": _vote(m.rlike(rf"(?i)\.(?:{DOMAINS})$"), m.rlike(r"\.[0-9-]+$")),
        "ip": _vote(never, m.rlike(f"^{RESERVED}")),
        "card": _vote(m.rlike(f"^{ISSUERS}"), m.rlike("^0")),
        "phone": _vote(m.rlike(f"^{DIALLING}"), m.rlike(r"^\+0")),
        "secret": _vote(m.rlike(f"^{KEY_PREFIXES}"), never),
        "iban": _vote(m.rlike(f"^(?:{COUNTRIES})"), ~m.rlike(f"^(?:{COUNTRIES})")),
        "national": _vote(never, m.isin("078-05-1120", "219-09-9999", "123-45-6789")),
        "tel": _vote(never, ~m.rlike(AREA_CODES)),
    })
    context = of({k: _vote(before.rlike(c), before.rlike(AGAINST)) for k, c in CUES.items()})
    shape = of({
        "email": _vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@"), m.rlike(r"\.\.|^[._%+-]")),
        "ip": _vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)0[0-9]")),
        "card": _vote(m.rlike(r"^[0-9]{14,19}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}$"), never),
        "phone": _vote(m.rlike(r"[\x20().-]"), never),
        "secret": _vote(m.rlike(r"^[^0-9]*+[0-9][^A-Za-z]*+[A-Za-z][^0-9]*+[0-9]") & (n_digits >= 3) & ~m.rlike(slug), n_digits < 3),
        "iban": _vote(n_digits >= 10, n_digits < 6),
        "national": _vote(never, ~m.rlike("[1-9].*[1-9].*[1-9]")),
        "tel": _vote(m.rlike(r"^\("), m.rlike(r"^(?:[0-9]+[\x20.-])\1")),
    })
    return [strict, gazetteer, context, shape]


def _bucket(s: Column) -> Column:
    n = s["end"] - s["start"]
    return F.when(n < 16, 0).when(n < 24, 1).otherwise(2)


def find_spans(docs: DataFrame, kept: Column) -> DataFrame:
    """(kept, base, extra): spans of the base kinds, and of other kinds with their votes, that overlap none of the base."""
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.when(F.contains(own, F.lit(MARK)), F.translate(own, MARK, "\ue001")).otherwise(own)
    raw = docs.select(kept.alias("kept"), text.alias("text")).select("kept", *[_spans(F.col("text"), k).alias(k) for k in KINDS])
    of = {k: F.filter(F.col(k), partial(_valid_span, k)) for k in KINDS}
    found = raw.select("kept", F.array_sort(F.concat(*[of[k] for k in KINDS[:BASE]])).alias("base"), F.concat(*[of[k] for k in KINDS[BASE:]]).alias("extra"))

    def voted(s: Column) -> Column:
        votes = [v.alias(name) for name, v in zip(LABELERS, _votes(s), strict=True)]
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _bucket(s).alias("bucket"), *votes)

    apart = F.when((F.size("base") == 0) | (F.size("extra") == 0), F.col("extra")).otherwise(_let(F.array_sort(F.concat("base", "extra")), _apart))
    return found.select("kept", F.transform("base", voted).alias("base"), F.transform(apart, voted).alias("extra"))


def _apart(spans: Column) -> Column:
    """Of sorted spans those of other kinds that overlap none of the base: not the base's ends before, nor the next one's start."""
    far = F.lit(2**31 - 1)
    ends = _scan(F.transform(spans, lambda s: F.when(s["kind"] < BASE, s["end"]).otherwise(0)), F.greatest)
    starts = F.reverse(_scan(F.reverse(F.transform(spans, lambda s: F.when(s["kind"] < BASE, s["start"]).otherwise(far))), F.least))

    def free(s: Column, i: Column, e: Column, b: Column) -> Column:
        return (s["kind"] >= BASE) & (F.get(e, i) <= s["start"]) & (F.get(b, i) >= s["end"])

    return _let(ends, lambda e: _let(starts, lambda b: F.filter(spans, lambda s, i: free(s, i, e, b))))


def vote_counts(found: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """((kind, bucket, votes...), number of spans): at most len(KINDS) * BUCKETS * 3 ** len(LABELERS) rows, over all spans."""
    names = ["kind", "bucket", *LABELERS]
    rows = found.select(F.explode(F.concat("base", "extra")).alias("s")).select("s.*").groupBy(*names).count().collect()
    return sorted((tuple(r[n] for n in names), r["count"]) for r in rows)


#: What labelers are held to do before any span is seen: shares of abstaining, against and for, where a span isn't and where it is
#: personal data, worth as many spans as STRENGTH, or this part of a kind's spans if that is more.
ANCHOR, STRENGTH, PART = ((1.0, 2.0, 0.5), (1.0, 0.5, 2.0)), 10.0, 0.05


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], np.ndarray]:
    """Expectation maximisation, kind by kind: the chance of each vote pattern to be personal data, and each labeler's votes by (kind, class).

    The labelers are taken to vote independently of each other in each class; abstaining is a vote of its own. What the
    classes mean is anchored: the first expectation goes by the votes' balance, the labelers' shares start from ANCHOR, and
    whatever the shares become, a vote for a span never lowers its chance, nor does one against it raise it. A labeler that votes alike on all spans of a kind tells nothing about them and counts with ANCHOR alone.
    """
    keys = np.array([c[0] for c in counts])
    n = np.array([c[1] for c in counts], dtype=float)
    anchor = np.array(ANCHOR) / np.sum(ANCHOR, axis=1, keepdims=True)
    chances, shares = np.zeros(len(counts)), np.zeros((len(KINDS), keys.shape[1] - 2, 2, 3))
    for kind in np.unique(keys[:, 0]):
        mine = keys[:, 0] == kind
        votes, w = keys[mine, 2:] + 1, n[mine]
        balance = np.where(votes == 0, 0, votes * 2 - 3).sum(axis=1).astype(float)
        first = post = 1 / (1 + np.exp(-1.5 * balance))
        strength = max(STRENGTH, PART * w.sum())
        for _ in range(rounds):
            prior = np.clip((w @ post + strength * (w @ first) / w.sum()) / (w.sum() + strength), 0.02, 0.98)
            logit = np.full(len(w), np.log(prior / (1 - prior)))
            for k in range(votes.shape[1]):
                share = anchor.copy()
                if len(np.unique(votes[:, k])) > 1:
                    for y, part in enumerate((w * (1 - post), w * post)):
                        mass = np.bincount(votes[:, k], weights=part, minlength=3) + strength * anchor[y]
                        share[y] = mass / mass.sum()
                shares[kind, k] = share
                weight = np.log(share[1] / share[0])
                logit += np.array([weight[0], min(0.0, weight[1]), max(0.0, weight[2])])[votes[:, k]]
            post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        chances[mine] = post
    return chances.tolist(), shares


def train(counts: list[tuple[tuple[int, ...], int]], expected: list[float], ridge: float = 1.0) -> list[list[float]]:
    """Weights of the span classifier, by Newton steps: for the constant, for each value of kind and bucket, and for each vote by kind.

    A vote's weight is the sum of one that all kinds share and one of its kind, so that kinds with few spans lean on the others.
    """
    widths = [len(KINDS), BUCKETS, *[3] * len(LABELERS), *[3 * len(KINDS)] * len(LABELERS)]
    starts = np.concatenate(([1], 1 + np.cumsum(widths)))
    x = np.zeros((len(counts), starts[-1]))
    x[:, 0] = 1
    for i, ((kind, bucket, *votes), _) in enumerate(counts):
        at = [kind, bucket, *[v + 1 for v in votes], *[3 * kind + v + 1 for v in votes]]
        x[i, starts[:-1] + at] = 1
    n, y = np.array([c for _, c in counts], dtype=float), np.array(expected)
    n = n / max(1.0, n.sum() / 1e5)  # so that the ridge counts alike for any number of spans above this
    w = np.zeros(starts[-1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (n * (q * (1 - q) + 1e-6))[:, None]) + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, x.T @ (n * (q - y)) + ridge * w), -2, 2)
    parts = [w[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    shared, own = parts[2 : 2 + len(LABELERS)], parts[2 + len(LABELERS) :]
    return [[float(w[0])], parts[0].tolist(), parts[1].tolist(), *[(np.tile(s, len(KINDS)) + o).tolist() for s, o in zip(shared, own, strict=True)]]


def fit(found: DataFrame) -> list[list[float]] | None:
    """The classifier's weights, from all spans; None without any."""
    counts = vote_counts(found)
    return train(counts, estimate(counts)[0]) if counts else None


def accepted(extra: Column, weights: list[list[float]] | None) -> Column:
    """Of the extra spans those that the classifier takes for personal data."""
    if weights is None:
        return F.filter(extra, lambda s: F.lit(False))

    def chosen(s: Column) -> Column:
        at = [s["kind"], s["bucket"], *[s["kind"] * 3 + s[name] + 1 for name in LABELERS]]
        parts = [F.element_at(F.array(*[F.lit(v) for v in w]), i + 1) for w, i in zip(weights[1:], at, strict=True)]
        return reduce(lambda a, b: a + b, parts, F.lit(weights[0][0])) >= 0

    return F.filter(extra, chosen)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _merged(base: Column, extra: Column) -> Column:
    def bare(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    return F.array_sort(F.concat(F.transform(base, bare), F.transform(extra, bare)))


def detect(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...): returns (doc_id, spans array<struct<start, kind, end>>, base) for each row of docs.

    start and end count code points; kind numbers KINDS; base has the spans of the base kinds. Null and empty texts have
    none. Repeated rows each have theirs; other columns are ignored. No spans at all leave nothing to learn, and add none.
    """
    found = materialise(find_spans(docs, F.col("doc_id")), "spans")
    return found.select(F.col("kept").alias("doc_id"), _merged(F.col("base"), accepted(F.col("extra"), fit(found))).alias("spans"), "base")


def digest(docs: DataFrame) -> DataFrame:
    """detect() as counts by base kind, a digest of the base spans, and all spans listed."""
    found = detect(docs)
    counts = [F.size(F.filter("base", partial(_of_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, n_chars, ...) with each span replaced by its kind in angle brackets and n_chars counted anew, the other columns as they are.

    Of spans that overlap the first names the kind. Rows and their spans are written once, which the fit and the result read.
    """
    names = docs.columns
    found = materialise(find_spans(docs, F.struct(*[F.col(f"`{c}`") for c in names])), "spans")
    spans = _merged(F.col("base"), accepted(F.col("extra"), fit(found)))
    marked = found.select("kept", F.col("kept.text").cast("string").alias("text"), spans.alias("spans"))
    text = F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = marked.select("kept", (F.size("spans") > 0).alias("changed"), text.alias("text"))
    own = {c: F.col("kept").getField(c) for c in names} | {"text": F.col("text")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("kept.n_chars"))
    return out.select(*[own[c].alias(c) for c in names])


def _replaced(text: Column, spans: Column) -> Column:
    """text with a tag for each span, or run of spans that overlap. Pieces are cut from segments, not counted off from the text's begin."""
    tags = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def cut(segments: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / SEGMENT).cast("int")
        held = F.array_join(F.slice(segments, first + 1, F.floor(b / SEGMENT).cast("int") - first + 1), "")
        return F.substring(held, a % SEGMENT + 1, b - a)

    def joined(segments: Column, ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when(s["start"] >= at, F.concat(cut(segments, at, s["start"]), F.element_at(tags, s["kind"] + 1))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(segments, F.element_at(ends, -1), F.length(text)))

    ends = _scan(F.transform(spans, lambda s: s["end"]), F.greatest)
    segments = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
    return _let(segments, lambda x: _let(ends, lambda e: joined(x, e)))
