"""Symbol facts of script files: what a file declares, imports, exports, renames and uses, a row per fact."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from weftgraph.sources.languages import LANGUAGES, Lines, blanked

FACT = "source_file string, fact string, local string, module string, name string, line int"
_FIELDS = [f.split()[0] for f in FACT.split(", ")]
_NAME = r"[A-Za-z_$][\w$]*"


def _pairs(clause: str) -> Iterator[tuple[str, str]]:
    """(name, local) of a braced list; ``type`` marks are dropped."""
    for part in clause.split(","):
        words = part.split()
        if words and words[0] == "type" and len(words) > 1:
            words = words[1:]
        if len(words) == 1:
            yield words[0], words[0]
        elif len(words) == 3 and words[1] == "as":
            yield words[0], words[2]


def js_facts(path: str, text: str) -> list[tuple]:
    """declare, import, export, star_export, alias and use facts of a JavaScript or TypeScript file."""
    lang = LANGUAGES["typescript"]
    code = re.sub(f"(?P<keep>{lang.strings})|(?:{lang.comments})", lambda m: m[0] if m["keep"] is not None else re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    bare, at, out = blanked(text, lang.strings, lang.comments), Lines(text).at, []
    local_names = set()

    def add(fact: str, local: str | None, module: str | None, name: str | None, pos: int) -> None:
        out.append((path, fact, local, module, name, at(pos)))

    for m in re.finditer(rf"\bimport\s+(?:type\s+)?(?:(?P<default>{_NAME})\s*,?\s*)?(?:\*\s+as\s+(?P<star>{_NAME})\s*)?(?:\{{(?P<named>[^}}]*)\}}\s*)?from\s*['\"](?P<module>[^'\"\n]+)['\"]", code):
        found = [("default", m["default"])] if m["default"] else []
        found += [("*", m["star"])] if m["star"] else []
        found += list(_pairs(m["named"] or ""))
        for name, local in found:
            local_names.add(local)
            add("import", local, m["module"], name, m.start())
    for m in re.finditer(rf"\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+(?P<star>{_NAME}))?|\{{(?P<named>[^}}]*)\}})(?:\s*from\s*['\"](?P<module>[^'\"\n]+)['\"])?", code):
        if m["named"] is None:
            if m["module"]:
                add("export" if m["star"] else "star_export", m["star"], m["module"], "*" if m["star"] else None, m.start())
            continue
        for name, local in _pairs(m["named"]):
            add("export", local, m["module"], name, m.start())
    for m in re.finditer(rf"(?m)^[ \t]*(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+|async\s+)?(?:function\s*\*?|class|interface|enum|type|const|let|var)\s+(?P<name>{_NAME})", bare):
        local_names.add(m["name"])
        add("declare", m["name"], None, m["name"], m.start("name"))
        if m["export"]:
            add("export", "default" if "default" in m["export"] else m["name"], None, m["name"], m.start("name"))
    for m in re.finditer(rf"\b(?:const|let|var)\s+(?P<local>{_NAME})\s*=\s*(?P<name>{_NAME})\s*(?:;|\n|$)", bare):
        add("alias", m["local"], None, m["name"], m.start("local"))
    seen = set()
    for m in re.finditer(rf"(?<![.\w$])(?P<name>{_NAME})\s*\(", bare):
        if m["name"] in local_names and m["name"] not in seen and not re.search(r"\bfunction\s*\*?\s*$", bare[max(0, m.start() - 40) : m.start()]):
            seen.add(m["name"])
            add("use", m["name"], None, m["name"], m.start())
    return out


def python_facts(path: str, text: str) -> list[tuple]:
    """declare, import, alias and use facts of a Python file; what ``__all__`` lists is exported."""
    tree, out = ast.parse(text), []
    local_names = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                local = a.asname or a.name.split(".")[0]
                local_names.add(local)
                out.append((path, "import", local, a.name, None, n.lineno))
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            for a in n.names:
                local_names.add(a.asname or a.name)
                out.append((path, "star_export" if a.name == "*" else "import", None if a.name == "*" else a.asname or a.name, module, None if a.name == "*" else a.name, n.lineno))
    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            local_names.add(n.name)
            out.append((path, "declare", n.name, None, n.name, n.lineno))
        elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            if isinstance(n.value, ast.Name):
                out.append((path, "alias", n.targets[0].id, None, n.value.id, n.lineno))
            elif n.targets[0].id == "__all__" and isinstance(n.value, ast.List | ast.Tuple):
                out += [(path, "export", e.value, None, e.value, n.lineno) for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    used = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in local_names:
            used[n.func.id] = min(n.lineno, used.get(n.func.id, n.lineno))
    return out + [(path, "use", name, None, name, line) for name, line in used.items()]


def symbol_facts(files: DataFrame) -> DataFrame:
    """Facts of the Python, JavaScript and TypeScript files among ``files`` (path, text); unreadable ones have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                if not path or text is None:
                    continue
                try:
                    if path.lower().endswith(".py"):
                        rows += python_facts(path, text)
                    elif re.search(r"\.(?:[jt]sx?|mjs)$", path.lower()):
                        rows += js_facts(path, text)
                except SyntaxError:
                    continue
            out = pd.DataFrame(rows, columns=_FIELDS)
            yield out.astype(object).where(out.notna(), None)

    return files.select("path", "text").mapInPandas(run, FACT)
