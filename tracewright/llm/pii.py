"""Personal data by weak supervision, with DataFrame functions only.

Exact patterns give the base spans, which always stay. Looser patterns give
candidates of further kinds. Three labelers vote yes or no on every span, or
abstain: a regex that checks the form of the match, a gazetteer of known items
and placeholders, and the words before the match. Expectation-maximisation
over the counts of vote patterns (a table whose size the number of kinds and
labelers bounds) estimates how reliable each labeler is. Its posteriors train
a logistic span classifier on votes and shape, which decides about the
candidates. Nothing has a length limit, and all passes follow the text's length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.scans import between, blocks, let, running
from tracewright.session import staged

# The patterns of the base spans, written so that no start inside a run is tried twice
# (look-behind; \G: right after the last match) and no repetition is undone (possessive).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates beyond them.
SPELLED_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[a-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+])(?<![0-9][ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
# a named value, or a key that its issuer's prefix tells
SECRET = r"(?<![A-Za-z0-9])(?:(?i:token|password|passwd|secret|api[_-]?key)[\"']?[ \t]*+[=:][ \t]*+[\"']?[A-Za-z0-9+/_.~-]{8,}+=*+|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+)"
NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: kind, order among spans of one start, pattern, what a text must hold to be searched, whether base
KINDS = [
    ("email", 0, EMAIL, "@", True),
    ("ip", 1, IP, ".", True),
    ("card", 2, CARD, r"[0-9][\x20-]?[0-9]", True),
    ("phone", 3, PHONE, "+", True),
    ("email_spelled", 4, SPELLED_EMAIL, r"(?i)[(\[]at[)\]]", False),
    ("phone_local", 5, LOCAL_PHONE, r"[0-9][ .-][0-9]{4}", False),
    ("secret", 6, SECRET, r"[=:]|A[KS]IA|gh[pousr]_", False),
    ("id_number", 7, NUMBER, r"[0-9]-[0-9]{2}-[0-9]", False),
]
# Per labeler and kind: what it says yes to, and what it says no to (None: nothing). Base kinds are checked by ``valid``.
FORM = {
    "email_spelled": (r"(?i)[a-z]{2,}$", r"[0-9-]$"),
    "phone_local": (r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9]", r"^\(?[01]|^\(?[0-9]{3}\)?[ .-]?[01]"),
    "secret": (r"^(?:AKIA|ASIA|gh[pousr]_)|[=:].*(?:[A-Za-z].*[0-9]|[0-9].*[A-Za-z])", r"[=:][ \t]*+[\"']?[A-Za-z._~-]*+$"),
    "id_number": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(?:000|666|9)|-00-|-0000$"),
}
#: Gazetteer: what is known of each kind, and known placeholders.
GAZETTEER = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|in)$", r"(?i)\.(?:png|jpe?g|gif|svg)$"),
    "ip": (r"^(?:10|127|172|192)\.", r"^(?:0|255)\."),
    "card": (r"^(?:4|5[1-5]|3[47]|6011|65)", r"^[017-9]"),
    "phone": (r"^\+(?:1|33|34|44|49|91)(?![0-9]{12})", r"^\+0"),
    "email_spelled": (r"(?i)(?:dot\)|dot\]|\.) ?(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|in)$", None),
    "phone_local": (None, r"^\(?(?:[2-9]11|555)"),
    "secret": (r"^(?:AKIA|ASIA|gh[pousr]_)|(?i)^(?:token|password|passwd|secret|api[_-]?key)[\"']?[ \t]*+[=:][ \t]*+[\"']?(?!change|example|placeholder|your|dummy|redacted|undefined|xxx)", r"(?i)[=:][ \t]*+[\"']?(?:change|example|placeholder|your|dummy|redacted|undefined|xxx)"),
    "id_number": (None, r"^(?:078-05-1120|219-09-9999|123-45-6789|987-65-43[0-9]{2})$"),
}
#: Context: words right before a match that speak for it. NOT_AFTER speak against any kind, but _EXAMPLES against secrets.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|from|to:)\W*$",
    "ip": r"(?i)(?:ip|address|host|server|login|from)\W*$",
    "card": r"(?i)(?:card|visa|credit|debit|payment|account)\W*(?:n(?:o|umber)\W*)?$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact)\W*$",
    "email_spelled": r"(?i)(?:e-?mail|contact|write|reach|at|to:)\W*$",
    "phone_local": r"(?i)(?:phone|tel|call|mobile|fax|contact)\W*$",
    "secret": r"(?i)(?:auth|login|access|bearer|export|credentials?|key|my)\W*$",
    "id_number": r"(?i)(?:ssn|social|security|id)\W*(?:n(?:o|umber)\W*)?$",
}
NOT_AFTER = r"(?i)\b(?:isbn|issn|order|invoice|part|model|serial|sku|ref|version|fig|page|item|section|chapter)\W*(?:n(?:o|umber)\W*)?$"
_EXAMPLES = r"(?i)\b(?:example|sample|dummy|placeholder|e\.g|like)\W*$"
BEFORE = 24
LABELERS = ("v_regex", "v_gazetteer", "v_context")


def pieces_of(text: Column, pattern: str) -> Column:
    """Every match with its number of code points, those of the gap before it, and the gap's last BEFORE ones."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between_matches = F.split(text, pattern, -1)
    # one gap more than matches, the one after the last
    return F.filter(
        F.zip_with(between_matches, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("match"), F.right(gap, F.lit(BEFORE)).alias("before"))),
        lambda x: x["match"].isNotNull(),
    )


def placed(pieces: Column) -> Column:
    """start, end (code points, end exclusive), match and before of the pieces."""

    def one(x: Column, end: Column) -> Column:
        return F.struct((end - x["size"]).alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before"))

    return let(pieces, lambda xs: F.zip_with(xs, running(F.transform(xs, lambda x: x["gap"] + x["size"]), lambda a, b: a + b), one))


def passes_luhn(match: Column) -> Column:
    """14 to 19 digits whose Luhn sum ends in 0."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)
    return F.when((n >= 14) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def parts_fit(match: Column) -> Column:
    """All parts of an address are at most 255; leading zeros are allowed."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def digits_between(match: Column, least: int, most: int) -> Column:
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return (n >= least) & (n <= most)


def valid(kind: str, match: Column) -> Column:
    return {"ip": parts_fit, "card": passes_luhn, "phone": lambda m: digits_between(m, 10, 15)}.get(kind, lambda m: F.lit(True))(match)


def valid_of(kind: str):
    return lambda m: valid(kind, m["match"])


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0)).cast("tinyint")


def says(match: Column, patterns: tuple[str | None, str | None]) -> Column:
    return vote(*(F.lit(False) if p is None else match.rlike(p) for p in patterns))


SPANS = "array<struct<order:int,kind:string,start:int,end:int,base:boolean,v_regex:tinyint,v_gazetteer:tinyint,v_context:tinyint,size_class:int>>"


def judged(kind: str, order: int, base: bool):
    """A function of a match: the span with its votes."""

    def span(m: Column) -> Column:
        match, before = m["match"], m["before"]
        against = before.rlike(NOT_AFTER) | before.rlike(_EXAMPLES) if kind == "secret" else before.rlike(NOT_AFTER)
        return F.struct(
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(base).alias("base"),
            # invalid matches of base kinds are gone already
            (F.lit(1).cast("tinyint") if base else says(match, FORM[kind])).alias("v_regex"),
            says(match, GAZETTEER[kind]).alias("v_gazetteer"),
            vote(before.rlike(CONTEXT[kind]), against).alias("v_context"),
            F.least(F.length(match) / 8, F.lit(8)).cast("int").alias("size_class"),
        )

    return span


def worth_searching(kind: str, needs: str) -> Column:
    """What a text must hold for a match of the kind, cheaper to find than the match."""
    return F.contains("text", F.lit(needs)) & F.col("text").rlike("[0-9]") if kind in ("ip", "phone") else F.contains("text", F.lit(needs)) if len(needs) == 1 else F.col("text").rlike(needs)


def spans_with_votes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: spans (order, kind, start, end, base, votes, length class), base ones valid, others candidates. ``keep``: columns to carry in ``own``."""
    text = F.coalesce("text", F.lit(""))
    own = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("own")] if keep else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *own, text.alias("text"))
    every = []
    for kind, order, pattern, needs, base in KINDS:
        found = placed(pieces_of(F.col("text"), pattern))
        good = F.filter(found, valid_of(kind)) if base else found
        every.append(F.when(worth_searching(kind, needs), F.transform(good, judged(kind, order, base))).otherwise(F.array().cast(SPANS)))
    return rows.select("row", "doc_id", *(["own"] if keep else []), F.concat(*every).alias("spans"))


@dataclass
class SpanModel:
    """EM's estimates per kind, and the classifier's weights."""

    prior: dict[str, float]
    accuracy: dict[tuple[str, str], tuple[float, float]]
    weights: dict[str, float]

    def probability(self, span: Column) -> Column:
        terms = [F.lit(float(self.weights.get("bias", 0.0)))]
        for v in LABELERS:
            terms.append(span[v].cast("double") * F.lit(float(self.weights.get(v, 0.0))))
        for kind, *_ in KINDS:
            terms.append(F.when(span["kind"] == kind, float(self.weights.get(f"kind:{kind}", 0.0))).otherwise(0.0))
        terms.append(span["size_class"].cast("double") * F.lit(float(self.weights.get("size", 0.0))))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return 1 / (1 + F.exp(-total))


def expectation_maximisation(counts: list[tuple], rounds: int = 30) -> SpanModel:
    """``counts``: (kind, votes..., size class, spans). Per kind a prior and each labeler's rates, then a logistic fit to the posteriors.

    A labeler that abstains says nothing. Rates start from the belief that labelers are right
    more often than not, and a few counts of that belief are kept, so small tables stay stable.
    """
    kinds = sorted({c[0] for c in counts})
    prior = dict.fromkeys(kinds, 0.5)
    rate = {(k, v): (0.8, 0.2) for k in kinds for v in LABELERS}
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for row in counts:
            kind, votes = row[0], row[1:4]
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for v, x in zip(LABELERS, votes, strict=True):
                if x:
                    tp, fp = rate[kind, v]
                    yes += math.log(tp if x > 0 else 1 - tp)
                    no += math.log(fp if x > 0 else 1 - fp)
            posterior[row] = 1 / (1 + math.exp(min(50, max(-50, no - yes))))
        for kind in kinds:
            own = [(r, posterior[r]) for r in counts if r[0] == kind]
            n, good = sum(r[-1] for r, _ in own), sum(r[-1] * p for r, p in own)
            prior[kind] = min(0.99, max(0.01, (good + 2) / (n + 4)))
            for i, v in enumerate(LABELERS):
                said = [(r, p) for r, p in own if r[1 + i]]
                tp = (8 + sum(r[-1] * p for r, p in said if r[1 + i] > 0)) / (10 + sum(r[-1] * p for r, p in said))
                fp = (2 + sum(r[-1] * (1 - p) for r, p in said if r[1 + i] > 0)) / (10 + sum(r[-1] * (1 - p) for r, p in said))
                rate[kind, v] = (min(0.99, tp), max(0.01, min(fp, tp)))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    total = sum(r[-1] for r in counts) or 1
    for _ in range(200):
        slope: dict[str, float] = {}
        for row in counts:
            x = {"bias": 1.0, f"kind:{row[0]}": 1.0, "size": float(row[4])} | {v: float(s) for v, s in zip(LABELERS, row[1:4], strict=True)}
            z = sum(weights.get(f, 0.0) * value for f, value in x.items())
            error = (1 / (1 + math.exp(-min(50, max(-50, z)))) - posterior[row]) * row[-1] / total
            for f, value in x.items():
                slope[f] = slope.get(f, 0.0) + error * value
        for f, g in slope.items():
            squares[f] = squares.get(f, 1e-8) + g * g
            weights[f] = weights.get(f, 0.0) - 0.2 * g / math.sqrt(squares[f])
    return SpanModel(prior, rate, weights)


def train(spans: DataFrame) -> SpanModel:
    """From the votes on all spans of all documents; the counts are at most kinds x 27 x 9 rows."""
    each = spans.select(F.explode("spans").alias("x")).select("x.*")
    counts = each.groupBy("kind", *LABELERS, "size_class").agg(F.count("*").alias("n"))
    return expectation_maximisation(sorted(tuple(r) for r in counts.collect()))


def find(docs: DataFrame, model: SpanModel | None = None, least: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its spans (order, kind, start, end, base), base and accepted ones, by start and kind; columns to ``keep`` in ``own``."""
    spans = staged(spans_with_votes(docs, keep), "spans")
    model = model or train(spans)
    chosen = F.filter("spans", lambda s: s["base"] | (model.probability(s) >= least))
    plain = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return spans.select("row", "doc_id", *(["own"] if keep else []), F.sort_array(plain).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, all spans and their number, of every whole text.

    Null and empty texts have none; repeated rows are searched each; spans of
    equal start come in the order of the kinds; extra columns are ignored; an
    empty table gives an empty result. A text of a million numbers takes seconds.
    """
    found = find(docs)
    base = F.filter("spans", lambda s: s["base"])
    counts = [base_count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in text replaced by [kind], overlapping spans as one under the first's kind. A row each, whatever its doc_id."""
    found = find(docs, keep=tuple(docs.columns))

    def cut(spans: Column, text: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        # each span with the end of what stands before it; a span that begins before that belongs to one already open
        opening = F.filter(F.zip_with(spans, F.concat(F.array(F.lit(0)), ends), lambda s, end: F.struct(end.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))), lambda e: e["to"] >= e["from"])
        parts = let(blocks(text), lambda b: F.concat(F.array_join(F.transform(opening, lambda e: F.concat(between(b, e["from"], e["to"]), F.lit("["), e["kind"], F.lit("]"))), ""), between(b, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))))
        return F.when(F.size(spans) > 0, parts).otherwise(text)

    text = let(F.col("spans"), lambda spans: cut(spans, F.col("own.text"))).alias("text")
    return found.select(*(text if c == "text" else F.col("own")[c].alias(c) for c in docs.columns))
