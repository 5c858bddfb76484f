"""Personal data by weak supervision, in built-in functions only.

Base kinds (email, ip, card, phone) stand by their patterns and checks. Further candidates (local
phone numbers, social-security shapes, account numbers, titled names, dates of birth, written-out mail
addresses, card numbers that fail their check) are taken where no base span is, and labelers vote on
them: shape, gazetteer, context words before and after the span, and contrary context. How often each
labeler is right is estimated by expectation-maximisation over the counts of vote patterns, first over
all kinds, then per kind with the joint estimate as prior; the posteriors are the soft labels of a
naive-Bayes span classifier per kind over length, neighbours and votes. What reaches the driver is a
table of counts, bounded by the number of vote patterns and features, whatever the number of documents.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.spans import find_spans, in_runs, kept, let, listed, met, outside, tagged

BASE = ("email", "ip", "card", "phone")
EXTRA = ("local_phone", "ssn", "iban", "person", "birth", "hidden_mail", "card_like")

#: Patterns. Loops are over single characters, which Java runs without recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+)-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
PERSON = r"(?<![A-Za-z])(?:Mrs|Mr|Ms|Dr|Herr|Frau|Mme|Sra|Sr)\.?\x20[A-Z][a-z]{2,20}"
BIRTH = r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-]*[0-9])"
HIDDEN_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,10}(?![A-Za-z0-9])"
CARD_LIKE = r"(?<![0-9A-Za-z.-])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z-])"
PATTERNS = {"local_phone": LOCAL_PHONE, "ssn": SSN, "iban": IBAN, "person": PERSON, "birth": BIRTH, "hidden_mail": HIDDEN_MAIL, "card_like": CARD_LIKE}
#: Context and gazetteer words.
CONTEXT = {
    "local_phone": r"(?i:phone|tel|call|fax|mobile|whatsapp|contact|anruf|llam|appel)", "ssn": r"(?i:ssn|social|tax|security)",
    "iban": r"(?i:iban|account|bank|konto|transfer|cuenta|compte)",
    "person": r"(?i:dear|regards|contact|signed|patient|client|hello)", "birth": r"(?i:born|birth|dob|gebor|geburt|nacid|nacim|naissance)",
    "hidden_mail": r"(?i:mail|contact|write|reach|address)",
    "card_like": r"(?i:card|visa|credit|payment|mastercard|karte|tarjeta|carte)",
}
CONTRARY = r"(?i:order|invoice|version|isbn|page|total|chapter|figure|ref|serial|id|released|updated|published)[^A-Za-z]{0,6}$"
NAMES = r"(?:James|John|Mary|Anna|Maria|Peter|Paul|Laura|Jose|Juan|Pierre|Marie|Hans|Klaus|Julia|Thomas|Michael|Sarah|David|Elena)$"
COUNTRIES = r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU|PL|SE|DK|FI|NO)"
AROUND, BEHIND = 40, 24
ROUNDS = 25
#: Pseudo-counts: a labeler is taken to be right three times in four before anything is seen, and a kind to be like all.
TRUST, KIND_PRIOR = 4.0, 10.0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The four base kinds as span arrays."""
    digit = text.rlike("[0-9]")
    # A dot that is not between label characters cannot be in a domain; written as an underscore it
    # still counts in the part before the @. Likewise separators that are not between digits.
    dotted = F.when(text.contains("@"), F.regexp_replace(text, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "_"))
    many = text.rlike(r"[0-9][0-9\x20-]{10,}[0-9]")
    spaced = F.when(many, F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "|"))
    card = kept(find_spans(spaced, CARD, many), lambda h: F.length(_digits(h)).between(12, 19))
    part = lambda h: F.forall(F.split(h, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(999)) <= 255)
    return {
        "email": find_spans(dotted, EMAIL, text.contains("@")),
        "ip": kept(find_spans(text, IP, digit & text.rlike(IP)), part),
        "card": kept(card, lambda h: _luhn(_digits(h))),
        "phone": kept(find_spans(text, PHONE, text.contains("+") & text.rlike(PHONE)), lambda h: F.length(_digits(h)).between(9, 15)),
    }


def _gates(text: Column) -> dict[str, Column]:
    """Per further kind a cheap test that every text with a candidate passes."""
    digit = text.rlike("[0-9]{2}")
    return {
        "local_phone": digit & text.rlike(r"[0-9]{3}[.-][0-9]{4}"), "ssn": digit & text.rlike("[0-9]-[0-9]{2}-[0-9]"), "iban": digit & text.rlike("[A-Z]{2}[0-9]{2}"),
        "person": text.rlike(r"(?:Mr|Ms|Dr|Herr|Frau|Mme|Sra?)s?\.?\x20[A-Z]"), "birth": digit & text.rlike(r"[./-](?:19|20)?[0-9]{2}") & text.rlike("(?:19|20)[0-9]{2}"),
        "hidden_mail": (text.contains("(at)") | text.contains("[at]") | text.contains(" at ")) & text.contains("dot"),
        "card_like": digit & text.rlike("[0-9]{4}[\\x20-]?[0-9]{4}[\\x20-]?[0-9]{4}"),
    }


def extra_spans(text: Column) -> Column:
    """Candidates of all further kinds in one array of struct<start,end,hit,kind>."""
    named = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(kind).alias("kind")))
    return F.concat(*(named(find_spans(text, PATTERNS[k], gate), k) for k, gate in _gates(text).items()))


def _by_kind(kind: Column, values: dict[str, Column], other: Column) -> Column:
    out = other
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _bucket(value: Column, cuts: list[int]) -> Column:
    out = F.lit(str(len(cuts)))
    for i, c in reversed(list(enumerate(cuts))):
        out = F.when(value < c, str(i)).otherwise(out)
    return out


def _side(ch: Column) -> Column:
    return F.when(ch == "", "edge").when(ch.rlike(r"[\x20\n\t]"), "space").when(ch.rlike("[A-Za-z0-9]"), "word").otherwise("mark")


def _mod97(account: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))


def _votes(kind: Column, hit: Column, before: Column, after: Column) -> list[Column]:
    """One vote by every one of ``VOTERS``: 1 for, -1 against, 0 silent."""
    d = _digits(hit)
    shape = {
        "local_phone": ~d.rlike("^[01]") & ~d.rlike("^(.)\\1+$"), "ssn": ~d.rlike("^(?:000|666|9)") & ~d.rlike("^...00") & ~d.rlike("0000$"),
        "iban": F.length(hit).between(15, 34), "person": hit.rlike(r"\. "), "birth": ~hit.rlike(r"(?:^|[^0-9])(?:0?0|[4-9][0-9])[./-]"),
        "hidden_mail": hit.rlike(r"[(\[]"), "card_like": hit.rlike(r"^[3-6]") & ~d.rlike("^(.)\\1+$"),
    }
    gazetteer = {
        "person": F.when(hit.rlike(NAMES), 1).otherwise(0), "iban": F.when(hit.rlike(COUNTRIES), 1).otherwise(-1),
        "hidden_mail": F.when(hit.rlike(r"(?i:com|org|net|edu|gov|de|fr|es|uk|io)$"), 1).otherwise(-1), "card_like": F.when(hit.rlike("[^0-9]"), 1).otherwise(-1),
    }
    # what passes the card check is a base span already
    checksum = {"iban": F.when(_mod97(hit) == 1, 1).otherwise(-1), "card_like": F.lit(-1)}
    near = lambda side: F.when(_by_kind(kind, {k: side.rlike(p) for k, p in CONTEXT.items()}, F.lit(False)), 1).otherwise(0)
    return [
        F.when(_by_kind(kind, shape, F.lit(True)), 1).otherwise(-1), _by_kind(kind, gazetteer, F.lit(0)), _by_kind(kind, checksum, F.lit(0)), near(before), near(after),
        F.when(before.rlike(CONTRARY), -1).otherwise(0),
    ]


VOTERS = ("shape", "gazetteer", "checksum", "before", "after", "contrary")


def _described(text: Column, spans: Column) -> Column:
    """Candidates with their vote pattern and features, as strings."""

    def one(s: Column) -> Column:
        at, kind = F.greatest(F.lit(0), s["start"] - AROUND), s["kind"]
        sides = F.struct(F.substr(text, at + 1, s["start"] - at).alias("before"), F.substr(text, s["end"] + 1, F.lit(BEHIND)).alias("after"))

        def told(w: Column) -> Column:
            votes = F.array(*(v.cast("string") for v in _votes(kind, s["hit"], w["before"], w["after"])))
            return let(votes, lambda v: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), F.array_join(v, ",").alias("votes"),
                F.transform(F.array(
                    F.concat(F.lit("len="), _bucket(F.length(s["hit"]), [8, 12, 16, 24])), F.concat(F.lit("left="), _side(F.substr(w["before"], F.length(w["before"]), F.lit(1)))),
                    F.concat(F.lit("right="), _side(F.substr(w["after"], F.lit(1), F.lit(1)))), *(F.concat(F.lit(f"{n}="), F.get(v, F.lit(i))) for i, n in enumerate(VOTERS)),
                ), lambda f: F.concat(kind, F.lit(":"), f)).alias("features"),
            ))

        return let(sides, told)

    return F.transform(spans, one)


def _start(width: int) -> list[dict]:
    """Pseudo-counts of labelers that are more often right than wrong."""
    return [{1: {1: 0.75 * TRUST, 0: 0.5 * TRUST, -1: 0.25 * TRUST}, 0: {1: 0.25 * TRUST, 0: 0.5 * TRUST, -1: 0.75 * TRUST}} for _ in range(width)]


def estimate(patterns: dict[tuple[int, ...], float], rounds: int = ROUNDS, prior: list[dict] | None = None) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Dawid-Skene on counts of vote patterns: (P(true | pattern), reliabilities by labeler).

    Starts from the majority vote; ``prior`` are pseudo-counts by labeler, class and vote, so an empty
    or one-sided table is fine.
    """
    if not patterns:
        return {}, []
    width = len(next(iter(patterns)))
    prior = prior or _start(width)
    post = {p: 0.9 if sum(p) > 0 else 0.5 if sum(p) == 0 else 0.1 for p in patterns}
    tables: list[dict] = []
    for _ in range(rounds):
        mass = [1.0, 1.0]
        tables = [{c: dict(prior[k][c]) for c in (0, 1)} for k in range(width)]
        for p, n in patterns.items():
            for c, share in ((1, post[p]), (0, 1 - post[p])):
                mass[c] += n * share
                for k, v in enumerate(p):
                    tables[k][c][v] += n * share
        for k in range(width):
            for c in (0, 1):
                total = sum(tables[k][c].values())
                tables[k][c] = {v: x / total for v, x in tables[k][c].items()}
        for p in patterns:
            odds = math.log(mass[1] / mass[0]) + sum(math.log(tables[k][1][v] / tables[k][0][v]) for k, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return post, tables


def fit(counts: list[tuple[str, str, list[str], int]]) -> dict[str, float]:
    """Weights of the span classifier from (kind, votes, features, count): log-odds by feature and, under
    the name of a kind, its prior."""
    by_kind: dict[str, dict[tuple[int, ...], float]] = defaultdict(lambda: defaultdict(float))
    every: dict[tuple[int, ...], float] = defaultdict(float)
    votes_of = lambda votes: tuple(map(int, votes.split(",")))
    for kind, votes, _, n in counts:
        by_kind[kind][votes_of(votes)] += n
        every[votes_of(votes)] += n
    _, joint = estimate(dict(every))
    prior = [{c: {v: x * KIND_PRIOR for v, x in t[c].items()} for c in (0, 1)} for t in joint]
    post = {kind: estimate(dict(p), prior=prior)[0] for kind, p in by_kind.items()}
    mass: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    seen: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
    for kind, votes, features, n in counts:
        share = post[kind][votes_of(votes)]
        for c, x in ((1, share * n), (0, (1 - share) * n)):
            mass[kind][c] += x
            for f in features:
                seen[f][c] += x
    weights = {kind: math.log(m[1] / m[0]) for kind, m in mass.items()}
    for f, x in seen.items():
        m = mass[f.split(":", 1)[0]]
        weights[f] = math.log(x[1] / (m[1] + 1)) - math.log(x[0] / (m[0] + 1))
    return weights


def _columns() -> dict[str, Column]:
    """The expressions of ``_candidates`` over its column names; making them takes longer than planning them, so the
    two passes of ``find_pii`` share one set."""
    text = F.col("t")
    known = F.concat(*(F.transform(f"b_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in BASE))
    free = F.when(F.size("y") > 0, outside(F.col("y"), known)).otherwise(F.col("y"))
    return {**{f"b_{k}": s for k, s in base_spans(text).items()}, "y": extra_spans(text), "x": free, "told": _described(text, F.col("x"))}


def _candidates(df: DataFrame, made: dict[str, Column] | None = None) -> DataFrame:
    """``df`` (column t) with the base spans b_<kind> and the candidates ``x`` outside of them."""
    made = made or _columns()
    df = df.select("*", *(made[c].alias(c) for c in made if c not in ("x", "told")))
    return df.withColumn("x", made["x"]).drop("y")


def train(docs: DataFrame, text_col: str = "text", made: dict[str, Column] | None = None) -> dict[str, float]:
    """Weights of the span classifier, fitted on all candidates of all documents.

    One pass; what comes to the driver is a table of counts by vote pattern and feature tuple,
    bounded by the number of these.
    """
    made = made or _columns()
    some = functools.reduce(Column.__or__, _gates(F.col("t")).values())
    rows = _candidates(docs.select(F.col(text_col).alias("t")).where(some), made)
    counts = rows.select(F.explode(made["told"]).alias("s")).groupBy("s.kind", "s.votes", "s.features").count().collect()
    return fit([(r[0], r[1], r[2], r[3]) for r in counts])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: n_email, n_ip, n_card, n_phone long, base and added arrays of
    struct<start,rank,end,kind> (code points, end exclusive), after the id column or, with ``keep``,
    after all columns of ``docs`` (clashing names are replaced).

    ``weights`` defaults to ``train(docs)``. Null and empty texts have no spans; null ids and
    repeated rows pass through; there is no join, so they need no care.
    """
    made = _columns()
    weights = train(docs, text_col, made) if weights is None else weights
    new = [*(f"n_{k}" for k in BASE), "base", "added"]
    own = [c for c in docs.columns if c not in new] if keep else [id_col]
    moved = docs.select(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(own)), F.col(f"`{text_col}`").alias("t"))
    df = _candidates(moved, made)
    table = F.create_map(*(F.lit(x) for f, w in sorted(weights.items()) for x in (f, w))) if weights else F.create_map().cast("map<string,double>")

    def score(s: Column) -> Column:
        return F.aggregate(s["features"], F.coalesce(F.try_element_at(table, s["kind"]), F.lit(0.0)), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))

    rank = lambda s: _by_kind(s["kind"], {k: F.lit(len(BASE) + i) for i, k in enumerate(EXTRA)}, F.lit(-1))
    good = F.filter(made["told"], lambda s: score(s) > 0)
    added = F.transform(good, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return df.select(
        *(F.col(f"o{i}").alias(c) for i, c in enumerate(own)), *(F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.concat(*(tagged(F.col(f"b_{k}"), i, k) for i, k in enumerate(BASE))).alias("base"), F.when(F.size("x") > 0, added).otherwise(none).alias("added"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with every maximal run of overlapping or touching spans written as ``<PII>``."""
    sorted_of = lambda x: F.array_sort(F.array_distinct(x))
    # a span heads a run unless another reaches its start from before, and ends it unless another passes its end
    heads = lambda v, runs: sorted_of(F.transform(F.filter(v, lambda s: ~met(runs, s["start"] - 1, s["start"])), lambda s: s["start"]))
    tails = lambda v, runs: sorted_of(F.transform(F.filter(v, lambda s: ~met(runs, s["end"], s["end"] + 1)), lambda s: s["end"]))

    def rebuilt(r: Column) -> Column:
        past = lambda i: F.when(i > 0, F.get(r["ends"], i - 1)).otherwise(F.lit(0))
        pieces = F.transform(r["starts"], lambda s, i: F.concat(F.substr(text, past(i) + 1, s - past(i)), F.lit("<PII>")))
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(r["ends"], -1) + 1, F.length(text)))

    masked = let(spans, lambda v: let(in_runs(v), lambda runs: let(F.struct(heads(v, runs).alias("starts"), tails(v, runs).alias("ends")), rebuilt)))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


__all__ = ["base_spans", "estimate", "find_pii", "fit", "listed", "redact", "train"]
