"""Files as rows: scan, classification, filters, word counts, hashes, manifest and cache."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes by kind of file.
CODE = {
    ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".ejs", ".ets", ".go", ".rs", ".java", ".groovy", ".gradle", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".rb", ".swift", ".kt",
    ".kts", ".cs", ".scala", ".php", ".lua", ".luau", ".toc",
    ".zig", ".ps1", ".ex", ".exs", ".m", ".mm", ".jl", ".vue", ".svelte", ".astro", ".dart", ".v", ".sv", ".sql", ".r", ".f", ".f90", ".f95", ".f03", ".f08", ".pas", ".pp", ".dpr",
    ".dpk", ".lpr", ".inc", ".dfm", ".lfm", ".lpk", ".sh", ".bash", ".json",
}
DOCUMENT = {".md", ".mdx", ".qmd", ".txt", ".rst", ".html", ".yaml", ".yml"}
PAPER = {".pdf"}
IMAGE = {".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"}
OFFICE = {".docx", ".xlsx"}
VIDEO = {".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mp3", ".wav", ".m4a", ".ogg"}
#: Signs of a paper; three or more in the first 3000 characters make one.
PAPER_SIGNALS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]",
    r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)
#: Directories and names of files that may hold secrets.
SENSITIVE_DIRS = (".ssh", ".gnupg", ".aws", ".gcloud", "secrets", ".secrets", "credentials")
SENSITIVE_NAMES = (
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(?i)(?<![a-zA-Z0-9])(credential|secret|passwd|password|private_key)s?(?![a-zA-Z])",
    r"(?i)(?<![a-zA-Z0-9])tokens?(?![a-zA-Z])",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd)$", r"(?i)(aws_credentials|gcloud_credentials|service.account)",
)
#: Generated directories and files.
NOISE_DIRS = (
    "venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".tox", ".eggs", "coverage", "lcov-report",
    "visual-tests", "visual-test", "__snapshots__", "snapshots", "storybook-static", "dist-protected", ".next", ".nuxt", ".turbo", ".angular", ".idea", ".cache", ".parcel-cache",
    ".svelte-kit", ".terraform", ".serverless", ".worktrees",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum")
#: Sizes of a corpus below and above which the summary warns.
WARN_WORDS, UPPER_WORDS, UPPER_FILES = 50_000, 500_000, 500
#: Interpreters of scripts without a suffix.
INTERPRETERS = ("python", "python2", "python3", "node", "deno", "bun", "ruby", "perl", "php", "bash", "sh", "zsh", "dash", "ksh", "lua", "Rscript", "julia", "pwsh")


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size, mtime, content) of all files under ``root``; nothing is read before filters on the other columns."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix_of(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".blade.php"), ".blade.php").otherwise(F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]*[^.])$", 1)))


def paper_signals(text: Column) -> Column:
    """How many signs of a paper the first 3000 characters show."""
    head = F.substring(text, 1, 3000)
    total = F.lit(0)
    for p in PAPER_SIGNALS:
        total = total + head.rlike(p).cast("int")
    return total


def classify(path: Column, text: Column | None = None, shebang: Column | None = None) -> Column:
    """code, document, paper, image, video or null. ``text`` lets documents turn out to be papers."""
    ext = suffix_of(path)
    in_catalog = F.exists(F.split(path, "/"), lambda d: d.rlike(r"\.(imageset|xcassets|appiconset|colorset)$"))
    doc = F.when(paper_signals(text) >= 3, "paper").otherwise("document") if text is not None else F.lit("document")
    script = F.when(shebang_interpreter(shebang).isin(*INTERPRETERS), "code") if shebang is not None else F.lit(None).cast("string")
    return (
        F.when(ext == ".blade.php", "code").when(ext == "", script).when(ext.isin(*sorted(CODE)), "code").when(ext.isin(*sorted(PAPER)), F.when(~in_catalog, "paper"))
        .when(ext.isin(*sorted(IMAGE)), "image").when(ext.isin(*sorted(DOCUMENT)), doc).when(ext.isin(*sorted(OFFICE)), "document").when(ext.isin(*sorted(VIDEO)), "video")
    )


def shebang_interpreter(first_line: Column) -> Column:
    """Program of a ``#!`` line: past env, its options and variables; without its path."""
    rest = F.trim(F.regexp_extract(first_line, r"^#!\s*(.*)$", 1))
    past = F.regexp_replace(rest, r"^(?:\S*/)?env(?:\s+(?:-[a-zA-Z-]+(?:=\S+)?|[A-Za-z_]\w*=\S*))*\s+", "")
    return F.substring_index(F.regexp_extract(past, r"^(\S+)", 1), "/", -1)


def is_sensitive(path: Column) -> Column:
    """A parent directory or the name says that the file may hold secrets."""
    parents = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    hit = F.arrays_overlap(parents, F.array(*map(F.lit, SENSITIVE_DIRS)))
    for p in SENSITIVE_NAMES:
        hit = hit | name_of(path).rlike(p)
    return hit


def in_noise(path: Column) -> Column:
    parents = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return F.exists(parents, lambda d: d.isin(*NOISE_DIRS) | d.rlike(r"(_venv|_env|\.egg-info)$")) | name_of(path).isin(*LOCK_FILES)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def summary(files: DataFrame) -> DataFrame:
    """One row: files, words, whether a graph pays and what to warn of. ``files``: (file_type, words)."""
    s = files.where("file_type is not null").agg(F.count("*").alias("total_files"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"))
    note = F.when((F.col("total_words") > UPPER_WORDS) | (F.col("total_files") > UPPER_FILES), "large").when(F.col("total_words") < WARN_WORDS, "small")
    return s.withColumn("needs_graph", F.col("total_words") >= WARN_WORDS).withColumn("warning", note)


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(Java regex over a relative path, negated) of an ignore line; comments and blanks: none."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].rstrip("/")
    anchored = "/" in line
    out = []
    for part in line.strip("/").split("/"):
        out.append(".*" if part == "**" else re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(part)).replace(".*", "[^/]*"))
    body = "/".join(out).replace("/.*/", "/(?:.*/)?").replace("^.*/", "(?:.*/)?")
    return ("^" if anchored else "(?:^|.*/)") + body + "$", negated


def ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Adds ``ignored``: the last pattern that fits the file or one of its directories decides at each
    level, and what lies in an ignored directory is ignored. ``files``: column path, relative."""
    rules = [r for r in map(ignore_regex, patterns) if r]
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

    def state(p: Column) -> Column:
        out = F.lit(False)
        for rx, negated in rules:
            out = F.when(p.rlike(rx), F.lit(not negated)).otherwise(out)
        return out

    return files.withColumn("ignored", F.exists(levels, state) if rules else F.lit(False))


def content_key(content: Column, path: Column) -> Column:
    """Cache key: SHA-256 of content, a zero byte and the path in lower case."""
    return F.sha2(F.concat(content.cast("binary"), F.lit(b"\0"), F.lower(path).cast("binary")), 256)


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or deleted. Both: (path, mtime, hash); equal times need no hash."""
    o = old.select("path", F.col("mtime").alias("o_mtime"), F.col("hash").alias("o_hash"), F.lit(True).alias("o"))
    n = new.select("path", F.col("mtime").alias("n_mtime"), F.col("hash").alias("n_hash"), F.lit(True).alias("n"))
    same = F.col("o_mtime").eqNullSafe(F.col("n_mtime")) | (F.col("o_hash") == F.col("n_hash"))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def cache_split(files: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of content keys."""
    known = cache.select(key).distinct()
    return files.join(known, key, "left_semi"), files.join(known, key, "left_anti")


def pack(files: DataFrame, budget: int) -> DataFrame:
    """Adds ``chunk`` per directory: files in path order share a chunk until the next would exceed the
    token budget; one larger than the budget is alone. ``files``: (dir, path, tokens).

    A chunk's start depends on all before it, so a directory's (path, tokens) list is folded in one
    task; chunks do not reach across directories, and content is not gathered. Rows of equal path are counted each.
    """
    import pandas as pd

    if budget <= 0:
        raise ValueError("the token budget must be positive")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path", kind="stable")
        chunk, used, out = 0, 0, []
        for t in pdf["tokens"]:
            if used and used + t > budget:
                chunk, used = chunk + 1, 0
            used += t
            out.append(chunk)
        return pdf.assign(chunk=out)

    return files.select("dir", "path", "tokens").groupBy("dir").applyInPandas(fold, f"dir string, path {dict(files.dtypes)['path']}, tokens long, chunk long")


def survey(files: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """(file_type, files, words) of what a scan keeps: outside generated directories, not ignored, not sensitive, of a
    known kind. ``files``: (path, text); the text of other than code and documents is not counted."""
    kept = files.where(~in_noise(F.col("path")) & ~is_sensitive(F.col("path")))
    kept = ignored(kept, list(patterns)).where("not ignored")
    kind = classify(F.col("path"), F.col("text"))
    words = F.when(kind.isin("code", "document", "paper"), word_count(F.col("text"))).otherwise(0)
    return kept.select(kind.alias("file_type"), words.alias("words")).where("file_type is not null").groupBy("file_type").agg(F.count("*").alias("files"),
        F.sum("words").alias("words"))


def cached_files(cache: DataFrame, key: str = "key") -> DataFrame:
    """The distinct content keys of a cache table."""
    return cache.select(key).where(F.col(key).isNotNull()).distinct()


def common_root(paths: DataFrame) -> str:
    """The longest folder that all paths lie in; "" without one. The bounds of the order decide, so nothing is gathered."""
    r = paths.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    if r["a"] is None:
        return ""
    a, b = r["a"].split("/")[:-1], r["b"].split("/")[:-1]
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return "/".join(a[:n])
