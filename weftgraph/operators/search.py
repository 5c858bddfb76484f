"""Keyword search over node labels: terms, inverse document frequency, tiered scores, seeds, contexts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import bare_form, strip_marks

#: Weights of the match tiers and of a match in the source path.
EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5
#: Words of a question that name an edge context.
CONTEXT_HINTS = {
    "call": ("call", "calls", "called", "invoke", "invokes", "invoked"), "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"),
    "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"), "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
}
#: Other spellings of contexts.
CONTEXT_ALIASES = {
    "param": "parameter_type", "params": "parameter_type", "parameter": "parameter_type", "parameters": "parameter_type", "argument": "parameter_type",
    "arguments": "parameter_type", "arg": "parameter_type", "args": "parameter_type",
    "return": "return_type", "returns": "return_type", "returned": "return_type", "generic": "generic_arg", "generics": "generic_arg", "template": "generic_arg",
    "templates": "generic_arg",
    "annotation": "attribute", "annotations": "attribute", "decorator": "attribute", "decorators": "attribute", "calls": "call", "called": "call", "invoke": "call",
    "invocation": "call",
    "fields": "field", "property": "field", "properties": "field", "member": "field", "members": "field", "imports": "import", "imported": "import", "module": "import",
    "modules": "import", "exports": "export", "exported": "export",
}


def terms_of(question: str) -> list[str]:
    """White-space words in lower case, without those of one or two letters a-z."""
    return [t for t in question.lower().split() if not re.fullmatch("[a-z]{1,2}", t)]


def terms_column(question: Column) -> Column:
    return F.filter(F.split(F.lower(question), r"\s+"), lambda t: (t != "") & ~t.rlike("^[a-z]{1,2}$"))


def idf(nodes: DataFrame, terms: list[str], label: str = "label") -> DataFrame:
    """(term, df, idf): ln(1 + N / (1 + df)), df the nodes whose label holds the term. One scan."""
    terms = sorted(set(terms))
    low = F.lower(F.col(label))
    row = nodes.agg(F.count("*").alias("n"), *(F.count_if(low.contains(t)).alias(f"t{i}") for i, t in enumerate(terms)))
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)))
    return row.select("n", F.explode(pairs).alias("p")).select("p.term", "p.df",
        F.log(1 + F.col("n") / (1 + F.col("p.df"))).alias("idf")) if terms else row.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("df"),
        F.lit(0.0).alias("idf")).limit(0)


def score_nodes(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, label, score) of nodes with a positive score: per term the strongest of exact, prefix and
    substring match times idf, plus half the idf if the source path holds the term."""
    weights = {r["term"]: r["idf"] for r in idf(nodes, terms).collect()}  # a row per term of the question
    low = F.lower("label")
    bare = F.trim(F.regexp_replace(low, r"[()]+$", ""))
    score = F.lit(0.0)
    for t, w in sorted(weights.items()):
        tier = F.when((low == t) | (bare == t), EXACT).when(low.startswith(t) | bare.startswith(t), PREFIX).when(low.contains(t), SUBSTRING).otherwise(0.0)
        score = score + tier * w + F.when(F.lower("source_file").contains(t), SOURCE * w).otherwise(0.0)
    return nodes.select("id", "label", F.round(score, 6).alias("score")).where("score > 0")


def pick_seeds(scored: DataFrame, k: int = 3, gap: float = 0.2) -> DataFrame:
    """At most k best, by score then id descending, of at least ``gap`` times the best score."""
    top = scored.orderBy(F.desc("score"), F.desc("id")).limit(k)
    return top.withColumn("best", F.max("score").over(Window.partitionBy(F.lit(1)))).where(F.col("score") >= gap * F.col("best")).drop("best")


def contexts_of(question: str, explicit: list[str] | None = None) -> list[str]:
    """Edge contexts that the caller names, else those that words of the question hint at."""
    if explicit:
        return list(dict.fromkeys(CONTEXT_ALIASES.get(x.strip().lower(), x.strip().lower()) for x in explicit if x.strip()))
    words = {bare_form(w).lower() for w in re.split(r"[\s?,]+", question)}
    return [c for c, hints in CONTEXT_HINTS.items() if words & set(hints)]


def hinted_contexts(question: Column) -> Column:
    """``contexts_of`` without explicit ones, as a column."""
    # letters with marks need the Unicode form; plain text does not
    plain = F.when(question.rlike(r"[^\x00-\x7F]"), strip_marks(question)).otherwise(question)
    words = F.split(F.lower(plain), r"[\s?,]+")
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, hints))), c) for c, hints in CONTEXT_HINTS.items())))


def in_contexts(edges: DataFrame, contexts: list[str]) -> DataFrame:
    return edges.where(F.col("context").isin(*contexts)) if contexts else edges


def find_node(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes by tier: 0 exact label, bare label or id, 1 prefix, 2 substring."""
    t = text.lower()
    low = F.lower("label")
    bare = F.regexp_replace(low, r"[()]+$", "")
    tier = F.when((low == t) | (bare == t) | (F.lower("id") == t), 0).when(low.startswith(t) | bare.startswith(t), 1).when(low.contains(t), 2)
    return nodes.select("id", "label", tier.alias("tier")).where("tier is not null").orderBy("tier", "id").limit(limit)


def resolve_seed(nodes: DataFrame, text: str) -> DataFrame:
    """(id, tier): the exact id, else the only label, else the only source file, else the only label
    that contains the text; none if every tier is empty or ambiguous."""
    t = text.lower()
    tiers = [F.col("id") == text, F.lower("label") == t, F.lower("source_file") == t, F.lower("label").contains(t)]
    flat = nodes.select("id", F.explode(F.array_compact(F.array(*(F.when(c, i) for i, c in enumerate(tiers))))).alias("tier"))
    one = flat.groupBy("tier").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    return one.orderBy("tier").limit(1).select("id", "tier")


def render_budget(lines: DataFrame, order: list, chars: int) -> DataFrame:
    """The first lines whose running length, a line break each, stays within the budget."""
    w = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # each line has at least its break, so no more than ``chars`` of them can fit
    few = lines.orderBy(*order).limit(chars)
    return few.withColumn("upto", F.sum(F.length("line") + 1).over(w)).where(F.col("upto") <= chars)
