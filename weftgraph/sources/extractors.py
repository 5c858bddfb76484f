"""Structural extractors as table functions: (path, content) to nodes, edges and raw calls.

``extract`` runs the registered extractor of each file's suffix in Arrow batches, a file at a time;
a failure becomes an ``error`` row of that file. Most languages go through the configured walker of
``languages``; other parsers plug in with ``register_extractor``. A name that a file uses as a type but
does not define becomes a stub: a node without a source file, which resolution may rewire."""

from __future__ import annotations

import ast
import builtins
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import id_form
from weftgraph.sources.languages import LANGUAGES, Lines, scripts_of, walk

ROW = "kind string, id string, label string, file_type string, src string, dst string, relation string, confidence string, context string, source_file string, source_location string, is_member_call boolean, error string"
_FIELDS = [f.split()[0] for f in ROW.split(", ")]
#: Prefixes of comments that give reasons.
RATIONALE = ("# NOTE:", "# IMPORTANT:", "# HACK:", "# WHY:", "# RATIONALE:", "# TODO:", "# FIXME:")
MAX_JSON, MAX_DEPTH, MAX_PAIRS = 1 << 20, 6, 500
DEP_BLOCKS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


class Fragment:
    """Collects the rows of one file; ids are unique in it."""

    def __init__(self, path: str):
        self.path, self.rows, self.ids = path, [], set()
        parts = path.rsplit("/", 2)
        name = re.sub(r"(?<=.)\.[^.]*$", "", parts[-1])
        self.stem = f"{parts[-2]}.{name}" if len(parts) > 1 and parts[-2] else name
        self.file = self.node(path.rsplit("/", 1)[-1], 1, nid=id_form(path))

    def node(self, label: str, line: int, *key: str, file_type: str = "code", nid: str | None = None) -> str:
        nid = nid or id_form("_".join([self.stem, *(key or (label,))]))
        if nid not in self.ids:
            self.ids.add(nid)
            self.rows.append(dict(kind="node", id=nid, label=label, file_type=file_type, source_file=self.path, source_location=f"L{line}"))
        return nid

    def stub(self, name: str) -> str:
        nid = id_form(name)
        if nid not in self.ids:
            self.ids.add(nid)
            self.rows.append(dict(kind="node", id=nid, label=name, file_type="code", source_file=""))
        return nid

    def edge(self, src: str, dst: str, relation: str, line: int, context: str | None = None) -> None:
        self.rows.append(dict(kind="edge", src=src, dst=dst, relation=relation, confidence="EXTRACTED", context=context, source_file=self.path, source_location=f"L{line}"))

    def call(self, src: str, callee: str, line: int, member: bool) -> None:
        self.rows.append(dict(kind="raw_call", src=src, dst=callee, source_file=self.path, source_location=f"L{line}", is_member_call=member))


def extract_python(path: str, text: str) -> Fragment:
    """Modules, classes, functions and methods; imports, bases, annotations, calls and reasons."""
    f = Fragment(path)
    tree = ast.parse(text)
    defined: dict[str, str] = {}
    bodies = []

    classes = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}

    def names(node) -> Iterator[str]:
        """Ids of the types that an expression names; built-in ones are left out."""
        for x in ast.walk(node) if node is not None else ():
            if isinstance(x, ast.Name) and not hasattr(builtins, x.id):
                yield id_form(f"{f.stem}_{x.id}") if x.id in classes else f.stub(x.id)

    def doc(owner: str, node) -> None:
        d = ast.get_docstring(node, clean=True)
        if d and len(d) > 20:
            label = " ".join(d.split())[:80]
            line = getattr(node, "lineno", 1)
            f.edge(f.node(label, line, "rationale", str(line), label[:20], file_type="rationale"), owner, "rationale_for", line)

    def visit(body, owner: str, cls: str | None) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                nid = f.node(n.name, n.lineno)
                defined[n.name.lower()] = nid
                f.edge(owner, nid, "contains", n.lineno)
                for b in n.bases:
                    for name in names(b):
                        f.edge(nid, name, "inherits", n.lineno)
                doc(nid, n)
                visit(n.body, nid, n.name)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                nid = f.node(f".{n.name}()" if cls else f"{n.name}()", n.lineno, *((cls, n.name) if cls else (n.name,)))
                defined.setdefault(n.name.lower(), nid)
                f.edge(owner, nid, "method" if cls else "contains", n.lineno)
                args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
                for a in args:
                    for name in names(a.annotation):
                        f.edge(nid, name, "references", n.lineno, "parameter_type")
                for name in names(n.returns):
                    f.edge(nid, name, "references", n.lineno, "return_type")
                doc(nid, n)
                bodies.append((nid, n))
            elif isinstance(n, ast.Import):
                for a in n.names:
                    f.edge(f.file, id_form(a.name), "imports", n.lineno, "import")
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                f.edge(f.file, id_form(module) or id_form(path), "imports_from", n.lineno, "import")
            elif isinstance(n, ast.If | ast.Try | ast.With):
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(n, part, []), owner, cls)

    doc(f.file, tree)
    visit(tree.body, f.file, None)
    for nid, fn in bodies:
        seen = set()
        for c in ast.walk(fn):
            if isinstance(c, ast.Call):
                member = isinstance(c.func, ast.Attribute)
                name = c.func.attr if member else c.func.id if isinstance(c.func, ast.Name) else None
                if not name:
                    continue
                target = defined.get(name.lower())
                if target and target != nid and target not in seen:
                    seen.add(target)
                    f.edge(nid, target, "calls", c.lineno, "call")
                elif not target:
                    f.call(nid, name, c.lineno, member)
    for i, line in enumerate(text.splitlines(), 1):
        s = line.strip()
        if s.startswith(RATIONALE):
            f.edge(f.node(s[2:][:80], i, "rationale", str(i), file_type="rationale"), f.file, "rationale_for", i)
    return f


def extract_markdown(path: str, text: str) -> Fragment:
    """Headings nested by level under the file; fenced code blocks under the heading they stand in."""
    f = Fragment(path)
    stack: list[tuple[int, str]] = []
    fence, blocks = None, 0
    for i, line in enumerate(text.splitlines(), 1):
        s = line.strip()
        if s.startswith("```"):
            if fence is None:
                blocks += 1
                lang = (s[3:].split() or ["code"])[0]
                fence = f.node(f"{lang} block {blocks}", i, "block", str(blocks), file_type="document")
                f.edge(stack[-1][1] if stack else f.file, fence, "contains", i)
            else:
                fence = None
            continue
        m = None if fence else re.match(r"(#{1,6})\s+(.+)", line)
        if m:
            level, title = len(m[1]), m[2].strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            nid = f.node(title, i, title, str(i) if id_form(f"{f.stem}_{title}") in f.ids else "", file_type="document")
            f.edge(stack[-1][1] if stack else f.file, nid, "contains", i)
            stack.append((level, nid))
    return f


def extract_sql(path: str, text: str) -> Fragment:
    """Tables, views, functions and triggers of DDL; foreign keys, reads and triggers between them."""
    f = Fragment(path)
    line = Lines(text).at
    known: dict[str, str] = {}
    head = re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(TABLE|VIEW|MATERIALIZED\s+VIEW|FUNCTION|PROCEDURE|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`\[]?([\w$.]+)", re.I)
    found = list(head.finditer(text))
    for m in found:
        name = m[2]
        nid = f.node(name + ("()" if m[1].upper() in ("FUNCTION", "PROCEDURE") else ""), line(m.start()), name)
        known[name.lower()] = known[name.lower().rsplit(".", 1)[-1]] = nid
        f.edge(f.file, nid, "contains", line(m.start()))
    seen = set()

    def link(src: str, name: str, relation: str, at: int) -> None:
        dst = known.get(name.lower()) or known.get(name.lower().rsplit(".", 1)[-1]) or id_form(f"{f.stem}_{name}")
        if dst != src and (src, dst, relation) not in seen:
            seen.add((src, dst, relation))
            f.edge(src, dst, relation, line(at))

    for m, nxt in zip(found, [*found[1:], None], strict=False):
        body, kind, src = text[m.start() : nxt.start() if nxt else len(text)], m[1].upper(), known[m[2].lower()]
        if kind == "TABLE":
            for r in re.finditer(r"\bREFERENCES\s+[\"`\[]?([\w$.]+)", body.split(";", 1)[0], re.I):
                link(src, r[1], "references", m.start() + r.start())
        elif kind == "TRIGGER":
            for r in re.finditer(r"\bON\s+[\"`\[]?([\w$.]+)", body, re.I):
                link(src, r[1], "triggers", m.start() + r.start())
                break
        else:
            for r in re.finditer(r"\b(?:FROM|JOIN)\s+[\"`\[]?([\w$.]+)", body, re.I):
                link(src, r[1], "reads_from", m.start() + r.start())
    for m in re.finditer(r"\bALTER\s+TABLE\s+(?:ONLY\s+)?[\"`\[]?([\w$.]+)[^;]*?\bREFERENCES\s+[\"`\[]?([\w$.]+)", text, re.I):
        src = known.get(m[1].lower()) or known.get(m[1].lower().rsplit(".", 1)[-1])
        if src:
            link(src, m[2], "references", m.start())
    return f


def extract_json(path: str, text: str) -> Fragment:
    """Keys as nodes down to a depth and number of pairs; dependency blocks, extends and $ref as edges."""
    f = Fragment(path)
    if len(text) > MAX_JSON:
        return f
    pairs = 0

    def walk(value, owner: str, at: tuple[str, ...]) -> None:
        nonlocal pairs
        if len(at) >= MAX_DEPTH:
            return
        for v in value if isinstance(value, list) else ():
            walk(v, owner, (*at, "[]"))
        for k, v in value.items() if isinstance(value, dict) else ():
            if pairs >= MAX_PAIRS:
                return
            pairs += 1
            if k == "$ref" and isinstance(v, str):
                f.edge(owner, id_form(v), "references", 1)
                continue
            if k == "extends":
                for x in v if isinstance(v, list) else [v]:
                    if isinstance(x, str):
                        f.edge(owner, id_form(x), "extends", 1)
                continue
            nid = f.node(k, 1, *at, k)
            f.edge(owner, nid, "contains", 1)
            if k in DEP_BLOCKS and isinstance(v, dict):
                for dep in v:
                    f.edge(nid, id_form(dep), "imports", 1, "import")
            else:
                walk(v, nid, (*at, k))

    walk(json.loads(text), f.file, ())
    return f


def _by_patterns(rules: list[tuple[str, str, str]]) -> Callable[[str, str], Fragment]:
    """An extractor by line patterns: (regex with one group, ``node`` or ``name``, relation from the file)."""

    def run(path: str, text: str) -> Fragment:
        f, lines = Fragment(path), Lines(text)
        for rx, what, relation in rules:
            for m in re.finditer(rx, text):
                at = lines.at(m.start(1))
                dst = f.node(m[1], at) if what == "node" else id_form(m[1])
                f.edge(f.file, dst, relation, at, "import" if relation.startswith("imports") else None)
        return f

    return run


#: Patterns of the languages that are read line by line.
BLADE = [(r"@(?:include|extends|includeIf|includeWhen)\(\s*['\"]([^'\"]+)", "name", "includes"), (r"<(?:livewire:|x-)([\w.:-]+)", "name", "uses_component"),
    (r"wire:(?:click|submit|change|model)(?:\.\w+)*=['\"](\w+)", "name", "binds_method")]
DART = [(r"(?m)^\s*(?:abstract\s+)?(?:class|mixin|enum|extension)\s+(\w+)", "node", "defines"), (r"(?m)^\s*import\s+['\"]([^'\"]+)", "name", "imports")]
LAZARUS_FORM = [(r"(?mi)^\s*(?:object|inherited|inline)\s+(\w+)", "node", "contains"), (r"(?mi)^\s*On\w+\s*=\s*(\w+)", "name", "references")]
LAZARUS_PACKAGE = [(r"(?i)<Filename\s+Value=\"([^\"]+)\"", "node", "contains"), (r"(?i)<PackageName\s+Value=\"([^\"]+)\"", "name", "imports")]


def _spock_features(path: str, text: str) -> Fragment:
    """A configured walk, and features named by strings (``def "adds numbers"()``) as methods of their class."""
    f = Fragment(path)
    walk(LANGUAGES["groovy"], f, text)
    lines, owner = Lines(text), None
    for m in re.finditer(r"\bclass\s+(?P<cls>\w+)|\bdef\s+(?P<q>[\"'])(?P<name>[^\"'\n]+)(?P=q)\s*\(", text):
        if m["cls"]:
            owner = id_form(f"{f.stem}_{m['cls']}")
            continue
        nid = f.node(f"{m['name']}()", lines.at(m.start()), m["name"])
        f.edge(owner if owner in f.ids else f.file, nid, "method" if owner in f.ids else "contains", lines.at(m.start()))
    return f


def configured(language: str) -> Callable[[str, str], Fragment]:
    """The extractor of a configured language."""

    def run(path: str, text: str) -> Fragment:
        f = Fragment(path)
        walk(LANGUAGES[language], f, text)
        return f

    return run


def _component(path: str, text: str) -> Fragment:
    """A component file: its script parts as TypeScript."""
    return configured("typescript")(path, scripts_of(text))


#: Suffixes of the configured languages.
SUFFIXES = {
    "javascript": ".js .jsx .mjs .ejs", "typescript": ".ts .tsx .ets", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp", "java": ".java", "csharp": ".cs", "kotlin": ".kt .kts",
    "scala": ".scala", "swift": ".swift", "php": ".php", "go": ".go",
    "rust": ".rs", "zig": ".zig", "powershell": ".ps1", "objc": ".m .mm", "ruby": ".rb", "lua": ".lua .luau .toc", "elixir": ".ex .exs", "julia": ".jl",
    "fortran": ".f .f90 .f95 .f03 .f08", "verilog": ".v .sv",
    "pascal": ".pas .pp .dpr .dpk .lpr .inc", "bash": ".sh .bash",
}
EXTRACTORS: dict[str, Callable[[str, str], Fragment]] = {
    ".py": extract_python, ".md": extract_markdown, ".mdx": extract_markdown, ".qmd": extract_markdown, ".sql": extract_sql, ".json": extract_json,
    ".blade.php": _by_patterns(BLADE), ".dart": _by_patterns(DART),
    ".lfm": _by_patterns(LAZARUS_FORM), ".dfm": _by_patterns(LAZARUS_FORM), ".lpk": _by_patterns(LAZARUS_PACKAGE), ".groovy": _spock_features, ".gradle": _spock_features,
    **dict.fromkeys((".vue", ".svelte", ".astro"), _component), **{suffix: configured(name) for name, suffixes in SUFFIXES.items() for suffix in suffixes.split()},
}


def register_extractor(suffix: str, extractor: Callable[[str, str], Fragment]) -> None:
    EXTRACTORS[suffix] = extractor


def extractor_of(path: str) -> Callable[[str, str], Fragment] | None:
    low = path.lower()
    return EXTRACTORS[".blade.php"] if low.endswith(".blade.php") else EXTRACTORS.get("." + low.rsplit(".", 1)[-1]) if "." in low else None


def extract(files: DataFrame) -> DataFrame:
    """Rows of kind node, edge, raw_call or error. ``files``: (path, text); null texts give nothing."""
    table = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        EXTRACTORS.update(table)
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                f = extractor_of(path) if path else None
                if f is None or text is None:
                    continue
                try:
                    rows += f(path, text).rows
                except Exception as e:  # one bad file is an error row, not a failed job
                    rows.append(dict(kind="error", source_file=path, error=f"{type(e).__name__}: {e}"[:300]))
            out = pd.DataFrame(rows, columns=_FIELDS)
            yield out.astype(object).where(out.notna(), None)

    return files.select("path", "text").mapInPandas(run, ROW)


def keep_resolvable(rows: DataFrame) -> DataFrame:
    """Edges whose source is a node and whose target is one, or that are imports."""
    ids = rows.where("kind = 'node'").select("id").distinct()
    e = rows.where("kind = 'edge'").drop("id").join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    loose = e.where(F.col("relation").isin("imports", "imports_from", "re_exports"))
    return loose.unionByName(e.where(~F.col("relation").isin("imports", "imports_from", "re_exports")).join(ids.select(F.col("id").alias("dst")), "dst",
        "left_semi").select(*loose.columns))
