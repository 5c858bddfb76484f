"""Which files and addresses a run takes: code files, allow-lists, links, shortcuts and safe URLs."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.sources import corpus as C
from weftgraph.sources.extractors import EXTRACTORS


def collect_files(files: DataFrame) -> DataFrame:
    """The files an extractor exists for, outside generated directories, by path. ``files``: column path."""
    known = C.suffix_of(F.col("path")).isin(*sorted(EXTRACTORS))
    return files.where(known & ~C.in_noise(F.col("path"))).orderBy("path")


def _allow(pattern: str) -> tuple[str, bool] | None:
    line = pattern.strip()
    if not line or line.startswith("#"):
        return None
    bare = line.strip("/")
    return (bare, line.startswith("/")) if bare else None


def _glob(pattern: str) -> str:
    """Java regex of a shell pattern; ``*`` crosses slashes."""
    return "^" + re.sub(r"\\[zZ]$", "", fnmatch.translate(pattern).removeprefix("(?s:").replace(r")\z", "").replace(r")\Z", "")) + "$"


def included(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Adds ``included``: a pattern of the allow-list fits the path, its name, a part of it or a leading
    directory. No pattern includes nothing. ``files``: column path, relative to the list."""
    rules = [_glob(p) for p, _ in filter(None, map(_allow, patterns))]
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    tried = F.array_distinct(F.concat(F.array("path"), parts, heads))
    fits = F.exists(tried, lambda x: x.rlike("|".join(f"(?:{rx})" for rx in rules))) if rules else F.lit(False)
    return files.withColumn("included", fits)


def may_hold_included(dirs: DataFrame, patterns: list[str]) -> DataFrame:
    """Adds ``reachable``: the directory may hold included files, so a walk has to enter it."""
    rules = [p for p, _ in filter(None, map(_allow, patterns))]
    d = F.btrim("path", F.lit("/"))
    hit = (d == "") & F.lit(bool(rules))
    for p in rules:
        hit = hit | (d == p) | F.lit(p).startswith(F.concat(d, F.lit("/"))) | d.rlike(_glob(p))
    return dirs.withColumn("reachable", hit)


def follows_links(root: str) -> bool:
    """Links are followed if a direct child of the root is one. Unreadable roots: no."""
    try:
        with os.scandir(root) as entries:
            return any(e.is_symlink() for e in entries)
    except OSError:
        return False


def walk_links(root: str, follow: bool | None = None) -> list[str]:
    """Relative paths of all files under a local root, in order; a directory that leads back into itself by
    links is entered once. For the driver's own disk; tables and stores are listed by Spark."""
    follow = follows_links(root) if follow is None else follow
    out: list[str] = []
    seen: set[str] = set()
    for folder, dirs, names in os.walk(root, followlinks=follow):
        real = os.path.realpath(folder)
        if real in seen:
            dirs[:] = []
            continue
        seen.add(real)
        dirs[:] = sorted(d for d in dirs if d not in C.NOISE_DIRS)
        out += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names]
    return sorted(out)


#: Networks that are not public, as (first address, bits).
PRIVATE = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("224.0.0.0", 4), ("240.0.0.0", 4))
_QUAD = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def _address(host: Column) -> Column:
    part = lambda i: F.regexp_extract(host, _QUAD, i).try_cast("long")
    return part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)


def url_problem(url: Column) -> Column:
    """Why a URL must not be fetched: scheme, host or private; null if it may. Names are judged as they stand,
    for an address behind a name is only known when it is resolved."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"\.$", ""))
    number = _address(host)
    private = host.isin("localhost", "[::1]", "[::]", "metadata.google.internal") | host.endswith(".localhost") | host.endswith(".local") | host.endswith(".internal") | host.rlike(r"^\[(?:f[cd]|fe[89ab]|::ffff:)")
    for first, bits in PRIVATE:
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(first.split(".")))
        private = private | F.coalesce((number >= low) & (number < low + (1 << (32 - bits))), F.lit(False))
    return F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(private, "private")


#: What a shortcut stands for, by suffix.
SHORTCUTS = {".gdoc": "document", ".gsheet": "spreadsheet", ".gslides": "presentation"}


def shortcut(path: Column, text: Column) -> Column:
    """struct<kind,doc_id,url> of a cloud-document shortcut, a small JSON file; null for other files and
    for a shortcut that names no document."""
    kind = F.lit(None).cast("string")
    for ext, name in SHORTCUTS.items():
        kind = F.when(F.lower(path).endswith(ext), name).otherwise(kind)
    j = F.from_json(text, "doc_id string, id string, url string")
    doc = F.coalesce(j["doc_id"], j["id"], F.nullif(F.regexp_extract(j["url"], r"/d/([A-Za-z0-9_-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(j["url"], r"[?&]id=([A-Za-z0-9_-]+)", 1), F.lit("")))
    return F.when(kind.isNotNull() & doc.isNotNull(), F.struct(kind.alias("kind"), doc.alias("doc_id"), j["url"].alias("url")))


def front_matter(title: Column, kind: Column, source: Column, body: Column) -> Column:
    """A Markdown file with YAML front matter; values are quoted and cannot break out of their line."""
    safe = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.concat(F.lit("---\ntitle: "), safe(title), F.lit("\ntype: "), safe(kind), F.lit("\nsource: "), safe(source), F.lit("\n---\n\n"), F.coalesce(body, F.lit("")))
