"""Scalar text functions of the graph engine: built-in columns where Spark has them, Arrow-batched
pandas UDFs for Unicode normal forms and edit similarities, which it has not."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_WORD = re.compile(r"[^\w]+")
_NOT_LABEL = re.compile(r"[\W_]+")


def id_form(s: str) -> str:
    """NFKC, runs of non-word characters to one underscore, stripped, case-folded."""
    t = _NOT_WORD.sub("_", unicodedata.normalize("NFKC", s))
    return re.sub("_+", "_", t).strip("_").casefold()


def label_form(s: str) -> str:
    """NFKC, case-folded, runs of anything but letters and digits to one space."""
    return _NOT_LABEL.sub(" ", unicodedata.normalize("NFKC", s).casefold()).strip()


def bare_form(s: str) -> str:
    """NFKD without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity, prefix weight 0.1 over at most 4 characters."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used, hits = [False] * lb, []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(lb) if used[j]]
    half = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    jaro = (m / la + m / lb + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def one_edit_or_swap(a: str, b: str) -> bool:
    """Damerau-Levenshtein distance at most 1, for strings of equal length."""
    if len(a) != len(b):
        return False
    off = [i for i in range(len(a)) if a[i] != b[i]]
    return len(off) < 2 or (len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]])


def _per_text(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return F.pandas_udf(run, "string")


def id_of(col: Column) -> Column:
    return _per_text(id_form)(col)


def norm_label(col: Column) -> Column:
    return _per_text(label_form)(col)


def strip_marks(col: Column) -> Column:
    return _per_text(bare_form)(col)


def jaro_winkler_of(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def one_edit_of(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one_edit_or_swap(p, q) for p, q in zip(x, y, strict=True)], dtype="bool")

    return F.pandas_udf(run, "boolean")(a, b)


def ascii_label(col: Column) -> Column:
    """The label form for text of ASCII letters, digits and marks, without Python."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot, empty without one; a leading dot is part of the name."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*[^.])$", 1))


def file_stem(path: Column) -> Column:
    """``parent.name`` without the last suffix; without a parent the name alone."""
    name = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    parent = F.when(path.contains("/"), F.element_at(F.split(path, "/"), -2))
    return F.concat_ws(".", F.when(parent != "", parent), name)


def shannon_bits(col: Column) -> Column:
    """Shannon entropy of the characters, in bits each; an empty string has none."""
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    n = F.size(chars)
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + part(c) * F.log2(part(c)))


def shingles(col: Column, k: int = 3) -> Column:
    """Distinct k-character shingles; a shorter string is its own."""
    many = F.transform(F.sequence(F.lit(1), F.length(col) - (k - 1)), lambda i: F.substr(col, i, F.lit(k)))
    return F.when(F.length(col) < k, F.array(col)).otherwise(F.array_distinct(many))


def tokens_of(chars: Column) -> Column:
    """Estimated model tokens of so many characters."""
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("long")


def url_kind(url: Column) -> Column:
    """tweet, arxiv, github, youtube, pdf, image or webpage; the first that fits."""
    low = F.lower(url)
    path = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")))
    return (
        F.when(low.contains("twitter.com") | low.contains("x.com"), "tweet").when(low.contains("arxiv.org"), "arxiv").when(low.contains("github.com"), "github")
        .when(low.contains("youtube.com") | low.contains("youtu.be"), "youtube").when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def html_text(html: Column, cap: int = 8000) -> Column:
    """Text of a page: scripts and styles dropped, tags and white space to one space each, capped."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"[ \t\n\x0b\f\r]+", " ")), 1, cap)


def html_title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0b\f\r]+", " "))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---.*?\n---", "")


def safe_label(col: Column, cap: int = 256) -> Column:
    """Control characters dropped, capped."""
    return F.substring(F.regexp_replace(col, r"[\x00-\x1f\x7f]", ""), 1, cap)


def cypher_text(col: Column) -> Column:
    """A string for a single-quoted Cypher literal: control characters but tab dropped, the rest escaped."""
    t = F.regexp_replace(col, r"[\x00-\x08\x0a-\x1f]", "")
    return F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def cypher_name(col: Column, other: str) -> Column:
    """A label or relationship type: letters, digits and underscores, a letter first, else ``other``."""
    t = F.regexp_replace(F.coalesce(col, F.lit("")), "[^A-Za-z0-9_]", "")
    return F.when(t.rlike("^[A-Za-z]"), t).otherwise(other)
