"""Structural extraction by configuration: one walker for languages with blocks.

Comments and strings are blanked first (line breaks stay), then headers of types and functions are
found by pattern, their blocks by matching brackets or by the indentation of ``end``, and owners by
nesting. Calls are looked for in the blocks of functions: a callee that the file defines becomes an
edge, others raw calls for cross-file resolution. Patterns hold no nested repetition, and brackets
are matched in one pass, so a file costs about its length.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from weftgraph.functions.text import id_form

_WORD = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|override|virtual|sealed|async|partial|readonly|extern|unsafe|open|inline|suspend|mutating|export)\s+){0,6}"
#: Words that look like calls and are none.
NOT_CALLS = frozenset(
    "if for while switch catch return sizeof typeof new else do try throw function func fn fun def defer go select case match when loop unless until elseif elif and or not in is as await yield using lock fixed foreach with assert super this self guard "
    "where class struct enum interface trait impl union typedef namespace template decltype alignof static_assert constructor module end begin print".split()
)


@dataclass(frozen=True)
class Language:
    """What the walker has to know of a language.

    ``types`` and ``functions`` are patterns with the group ``name``; types may have ``bases`` (comma-separated),
    functions ``owner`` (a type named in the header). A function pattern ends before its parenthesis; after the
    matching one, ``tail`` must fit. ``blocks``: how a block ends: brace, end (the indentation of an end word) or
    next (the next header). ``imports``: (pattern, relation). ``fields``: a pattern of typed fields.
    """

    types: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    imports: tuple[tuple[str, str], ...] = ()
    tail: str = r"\s*\{"
    comments: str = r"//[^\n]*|/\*.*?\*/"
    strings: str = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    blocks: str = "brace"
    calls: str = rf"(?P<of>(?:\.|->|::)\s*)?\b(?P<name>{_WORD})\s*\("
    fields: str = ""
    typed: bool = False
    defines: str = "contains"
    ends: str = r"end\w*\b"
    ignore_case: bool = False
    not_types: frozenset = field(default_factory=frozenset)


JS_IMPORTS = (
    (r"\bimport\s+(?:type\s+)?(?:[\w*${},\s]{1,2000}?\sfrom\s*)?['\"]([^'\"\n]+)['\"]", "imports_from"), (r"\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)", "imports_from"),
    (r"\bexport\s+(?:\*(?:\s+as\s+\w+)?|\{[^}]{0,2000}\})\s*from\s*['\"]([^'\"\n]+)['\"]", "re_exports"), (r"\bimport\(\s*['\"]([^'\"\n]+)['\"]\s*\)", "dynamic_import"),
)
_JS = dict(
    types=(rf"\b(?:class|interface)\s+(?P<name>{_WORD})(?:<[^>{{]*>)?(?:\s+extends\s+(?P<bases>[\w$.,<> ]+?))?(?:\s+implements\s+(?P<impl>[\w$.,<> ]+?))?\s*\{{",),
    functions=(
        rf"\bfunction\s*\*?\s*(?P<name>{_WORD})\s*(?:<[^>(]*>)?\s*(?=\()", rf"\b(?:const|let|var)\s+(?P<name>{_WORD})\s*=\s*(?:async\s+)?(?:function\s*)?(?=\()",
        rf"(?m)^[ \t]*{_MODS}(?:get\s+|set\s+)?(?P<name>{_WORD})\s*(?:<[^>(]*>)?\s*(?=\()",
    ),
    tail=r"\s*(?::[^{;=]{1,200}?)?(?:=>\s*)?\{", imports=JS_IMPORTS, strings=r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`',
)
_C_TAIL = r"\s*(?:const\b|noexcept\b|override\b|final\b|->\s*[\w:<>]+|\s){0,6}(?::[^{;]{0,400})?\{"
_C_INCLUDE = ((r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", "imports"),)

LANGUAGES: dict[str, Language] = {
    "javascript": Language(**_JS),
    "typescript": Language(**_JS, typed=True, fields=rf"(?m)^[ \t]*{_MODS}{_WORD}[?!]?\s*:\s*(?P<type>[A-Z][\w.]*)"),
    "c": Language(
        types=(r"\b(?:struct|union|enum)\s+(?P<name>\w+)\s*\{",), functions=(r"(?m)^(?:[A-Za-z_][\w \t*]{0,200}[ \t*])(?P<name>[A-Za-z_]\w*)[ \t]*(?=\()",), imports=_C_INCLUDE,
    ),
    "cpp": Language(
        types=(r"\b(?:class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?(?::(?!:)\s*(?P<bases>[^{;]{1,400}))?\{", r"\b(?:enum(?:\s+class)?|union)\s+(?P<name>\w+)[^{;(]{0,80}\{"),
        functions=(r"(?m)^[ \t]*(?:[A-Za-z_][\w:<>,*&~ \t]{0,200}[ \t*&])?(?:(?P<owner>\w+)::)?(?P<name>~?[A-Za-z_]\w*)[ \t]*(?=\()",), imports=_C_INCLUDE, tail=_C_TAIL,
        typed=True,
    ),
    "java": Language(
        types=(r"\b(?:class|interface|enum|record)\s+(?P<name>\w+)(?:<[^{]{0,200}?>)?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.<>, ]+?))?(?:\s+implements\s+(?P<impl>[\w.<>, ]+?))?\s*\{",),
        functions=(rf"(?m)^[ \t]*{_MODS}(?:<[^>\n]+>\s*)?(?P<ret>[A-Za-z_][\w.<>\[\],? ]{{0,120}}\s)?(?P<name>[A-Za-z_]\w*)[ \t]*(?=\()",),
        imports=((r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "imports"),),
        tail=r"\s*(?:throws[\w.,\s]{1,200})?\{", typed=True, fields=rf"(?m)^[ \t]*{_MODS}(?P<type>[A-Z]\w*)(?:<[^>\n]*>)?(?:\[\])?\s+\w+\s*[;=]",
    ),
    "csharp": Language(
        types=(r"\b(?:class|interface|struct|record|enum)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*:\s*(?P<bases>[\w.<>, ]+?))?\s*(?:where[^{]{0,200})?\{",),
        functions=(rf"(?m)^[ \t]*{_MODS}(?P<ret>[A-Za-z_][\w.<>\[\],? ]{{0,120}}\s)?(?P<name>[A-Za-z_]\w*)[ \t]*(?:<[^>(]*>)?(?=\()",),
        imports=((r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "imports"),),
        tail=r"\s*(?:where[^{;]{0,200})?(?::\s*(?:base|this)\([^)]*\)\s*)?(?:\{|=>)", typed=True,
        fields=rf"(?m)^[ \t]*{_MODS}(?P<type>[A-Z]\w*)(?:<[^>\n]*>)?\s+\w+\s*(?:[;=]|\{{\s*get)",
    ),
    "kotlin": Language(
        types=(r"\b(?:class|interface|object)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[\w.<>(), ]+?))?\s*(?=[{\n])",),
        functions=(r"\bfun\s+(?:<[^>]*>\s*)?(?:(?P<owner>\w+)\.)?(?P<name>\w+)\s*(?=\()",), imports=((r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)", "imports"),),
        tail=r"\s*(?::\s*[^={\n]{1,120}?)?(?:\{|=)", typed=True,
    ),
    "scala": Language(
        types=(r"\b(?:class|trait|object)\s+(?P<name>\w+)(?:\[[^\]]*\])?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<bases>[\w.\[\]() ]+?(?:\s+with\s+[\w.\[\] ]+?)*))?\s*(?=[{\n])",),
        functions=(r"\bdef\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?(?=\()",), imports=((r"(?m)^\s*import\s+([\w.]+(?:\.(?:_|\{[^}\n]*\}))?)", "imports"),),
        tail=r"\s*(?::\s*[^={\n]{1,120}?)?=?\s*\{", typed=True,
    ),
    "swift": Language(
        types=(r"\b(?:class|struct|protocol|enum|extension|actor)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*:\s*(?P<bases>[\w.<>, ]+?))?\s*(?:where[^{]{0,200})?\{",),
        functions=(r"\bfunc\s+(?P<name>\w+)\s*(?:<[^>(]*>)?(?=\()", r"(?m)^[ \t]*(?:convenience\s+|required\s+|public\s+)*(?P<name>init)\s*(?=\()"),
        imports=((r"(?m)^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|func)\s+)?([\w.]+)", "imports"),),
        tail=r"[^{};\n]{0,200}\{", typed=True, fields=rf"(?m)^[ \t]*{_MODS}(?:let|var)\s+\w+\s*:\s*(?P<type>[A-Z]\w*)",
    ),
    "php": Language(
        types=(r"\b(?:class|interface|trait|enum)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w\\, ]+?))?(?:\s+implements\s+(?P<impl>[\w\\, ]+?))?\s*\{",),
        functions=(r"\bfunction\s+&?(?P<name>\w+)\s*(?=\()",),
        imports=((r"(?m)^\s*use\s+([\w\\]+)", "imports"), (r"\b(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"\n]+)['\"]", "imports_from")), tail=r"\s*(?::\s*\??[\w\\|]+\s*)?\{",
        comments=r"//[^\n]*|#[^\n]*|/\*.*?\*/",
    ),
    "go": Language(
        types=(r"(?m)^type\s+(?P<name>\w+)(?:\[[^\]\n]*\])?\s+(?:struct|interface)\s*\{",),
        functions=(r"(?m)^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]\n]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]\n]*\])?(?=\()",),
        imports=((r"(?m)^\s*import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"", "imports_from"), (r"(?m)^\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$", "imports_from")), tail=r"[^{};\n]{0,200}\{",
        strings=r'"(?:\\.|[^"\\\n])*"|`[^`]*`', typed=True,
        calls=r"(?P<of>\.\s*)?\b(?P<name>[A-Za-z_]\w*)\s*\(",
    ),
    "rust": Language(
        types=(r"\b(?:struct|enum|trait|union)\s+(?P<name>\w+)(?:<[^>{;(]*>)?(?:\s*:\s*(?P<bases>[\w:<>+ ]+?))?\s*(?=[{;(])",
        r"\bimpl(?:<[^>{]*>)?\s+(?:(?P<bases>[\w:]+)(?:<[^{>]*>)?\s+for\s+)?(?P<scope>\w+)(?:<[^{>]*>)?\s*(?:where[^{]{0,400})?\{"),
        functions=(r"\bfn\s+(?P<name>\w+)\s*(?:<[^(]{0,200}>)?(?=\()",), imports=((r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]{1,400});", "imports_from"),),
        tail=r"\s*(?:->\s*[^{;]{1,200}?)?(?:\s*where[^{;]{0,400})?\{",
        strings=r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'', typed=True, calls=r"(?P<of>(?:\.|::)\s*)?\b(?P<name>[a-z_]\w*)\s*\(",
    ),
    "zig": Language(
        types=(r"\bconst\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)[^{;]{0,80}\{",), functions=(r"\bfn\s+(?P<name>\w+)\s*(?=\()",),
        imports=((r"@import\(\s*\"([^\"\n]+)\"\s*\)", "imports_from"),),
        tail=r"\s*[^{};]{0,120}\{", comments=r"//[^\n]*", calls=r"(?P<of>\.\s*)?(?<!@)\b(?P<name>[A-Za-z_]\w*)\s*\(",
    ),
    "powershell": Language(
        types=(r"(?mi)^\s*class\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w, ]+?))?\s*\{",),
        functions=(r"(?mi)^\s*function\s+(?P<name>[\w-]+)\s*(?=[({])", r"(?m)^[ \t]+(?:static\s+|hidden\s+)?(?:\[[\w.\[\]]+\]\s*)?(?P<name>[A-Za-z]\w*)\s*(?=\()"),
        imports=((r"(?mi)^\s*(?:Import-Module|using\s+module)\s+['\"]?([\w.\\/-]+)", "imports_from"),), comments=r"#[^\n]*|<#.*?#>",
        calls=r"(?P<of>(?:\.|::)\s*)?(?<![\w$-])(?P<name>[A-Za-z]+-[A-Za-z]\w*|[A-Za-z_]\w*(?=\())", ignore_case=True,
    ),
    "objc": Language(
        types=(r"@(?:interface|implementation|protocol)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>\w+))?",),
        functions=(r"(?m)^\s*[-+]\s*\([^)\n]*\)\s*(?P<name>\w+)(?=[^\n;{]*\s*\{)", r"(?m)^(?:[A-Za-z_][\w \t*]{0,200}[ \t*])(?P<name>[A-Za-z_]\w*)[ \t]*(?=\([^)\n]*\)\s*\{)"),
        imports=((r"(?m)^[ \t]*(?:#[ \t]*(?:import|include)[ \t]*[<\"]|@import\s+)([^>\";\n]+)", "imports"),), tail=r"[^{};]{0,400}\{", strings=r'@?"(?:\\.|[^"\\\n])*"',
        calls=rf"\[\s*(?P<of>\w+\s+)(?P<name>{_WORD})|\b(?P<plain>{_WORD})\s*\(", ends=r"@end",
    ),
    "ruby": Language(
        types=(r"(?m)^[ \t]*(?:class|module)\s+(?P<name>[A-Z]\w*)(?:::\w+)*(?:\s*<\s*(?P<bases>[\w:]+))?",), functions=(r"(?m)^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)",),
        imports=((r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"\n]+)['\"]", "imports_from"),),
        comments=r"#[^\n]*", blocks="end", calls=r"(?P<of>\.\s*)?\b(?P<name>[a-z_]\w*[?!]?)\s*\(",
    ),
    "lua": Language(
        functions=(r"(?m)^[ \t]*(?:local\s+)?function\s+(?:(?P<owner>\w+)[.:])?(?P<name>\w+)\s*(?=\()",), imports=((r"\brequire\s*\(?\s*['\"]([^'\"\n]+)['\"]", "imports_from"),),
        comments=r"--\[\[.*?\]\]|--[^\n]*", blocks="end",
        calls=r"(?P<of>[.:]\s*)?\b(?P<name>[A-Za-z_]\w*)\s*\(",
    ),
    "elixir": Language(
        types=(r"(?m)^[ \t]*defmodule\s+(?P<name>[A-Z]\w*)(?:\.\w+)*\s+do",), functions=(r"(?m)^[ \t]*(?:def|defp|defmacro)\s+(?P<name>\w+[?!]?)",),
        imports=((r"(?m)^\s*(?:import|alias|use|require)\s+([A-Z][\w.]*)", "imports"),), comments=r"#[^\n]*", blocks="end",
        calls=r"(?P<of>\.\s*)?\b(?P<name>[a-z_]\w*[?!]?)\s*\(",
    ),
    "julia": Language(
        types=(r"(?m)^[ \t]*(?:mutable\s+)?(?:struct|abstract\s+type)\s+(?P<name>\w+)(?:\{[^}\n]*\})?(?:\s*<:\s*(?P<bases>\w+))?", r"(?m)^[ \t]*module\s+(?P<name>\w+)"),
        functions=(r"(?m)^[ \t]*function\s+(?:\w+\.)?(?P<name>\w+!?)", r"(?m)^(?P<name>\w+!?)(?=\([^)\n]*\)\s*=[^=])"),
        imports=((r"(?m)^\s*(?:using|import)\s+([\w.]+)", "imports"),), comments=r"#=.*?=#|#[^\n]*", blocks="end", calls=r"(?P<of>\.\s*)?\b(?P<name>[A-Za-z_]\w*!?)\s*\(",
        defines="defines", strings=r'"(?:\\.|[^"\\])*"',
    ),
    "fortran": Language(
        types=(r"(?mi)^[ \t]*(?:module(?!\s+procedure)|program)\s+(?P<name>\w+)", r"(?mi)^[ \t]*type\s*(?:,[^:\n]*)?(?:::)?\s+(?P<name>\w+)\s*$"),
        functions=(r"(?mi)^[ \t]*(?:(?:pure|elemental|recursive|integer|real|logical)(?:\([^)\n]*\))?\s+){0,4}(?:subroutine|function)\s+(?P<name>\w+)",),
        imports=((r"(?mi)^\s*use\s*(?:,\s*\w+\s*)?(?:::)?\s*(\w+)", "imports"),), comments=r"![^\n]*", blocks="end", calls=r"(?i)\bcall\s+(?P<name>\w+)", defines="defines",
        ends=r"(?i:end(?!\s*(?:if|do|select|where|associate)\b))", ignore_case=True,
    ),
    "verilog": Language(
        types=(r"(?m)^[ \t]*(?:module|interface|package)\s+(?P<name>\w+)", r"(?m)^[ \t]*(?:virtual\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>\w+))?"),
        functions=(r"(?m)^[ \t]*(?:virtual\s+)?(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)?(?P<name>\w+)(?=\s*[(;])",),
        imports=((r"(?m)^\s*`include\s+\"([^\"\n]+)\"", "imports_from"), (r"(?m)^\s*import\s+(\w+)::", "imports_from")), blocks="end",
        ends=r"end(?:module|interface|package|class|function|task)\b",
    ),
    "pascal": Language(
        types=(r"(?mi)^\s*(?P<name>\w+)\s*=\s*(?:packed\s+)?(?:class|record|interface|object)\b\s*(?:\((?P<bases>[^)\n]*)\))?",),
        functions=(r"(?mi)^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?:(?P<owner>\w+)\.)?(?P<name>\w+)",),
        imports=((r"(?i)\buses\s+([^;]{1,2000});", "imports"),), comments=r"//[^\n]*|\{.*?\}|\(\*.*?\*\)", strings=r"'(?:''|[^'\n])*'", blocks="next", ignore_case=True,
    ),
    "groovy": Language(
        types=(r"\b(?:class|interface|trait|enum)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.<>]+))?(?:\s+implements\s+(?P<impl>[\w.<>, ]+?))?\s*\{",),
        functions=(rf"(?m)^[ \t]*{_MODS}(?:def|void|[A-Z][\w<>]*|int|boolean|long)\s+(?P<name>[A-Za-z_]\w*)\s*(?=\()",),
        imports=((r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)", "imports"),),
    ),
    "bash": Language(
        functions=(r"(?m)^[ \t]*(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*(?:\(\s*\))?\s*(?=\{)",), imports=((r"(?m)^\s*(?:source|\.)\s+['\"]?([\w./${}-]+)", "imports_from"),),
        comments=r"(?m:(?<=\s)#[^\n]*|^#[^\n]*)", tail="",
        calls=r"(?m)(?:^|[;&|(]|\b(?:then|do|else|if|while|!))[ \t]*(?P<name>[A-Za-z_][\w-]*)(?![\w(=-])", strings=r"'[^']*'",
    ),
}


class Lines:
    """Line numbers of positions in a text, found by bisection."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, position: int) -> int:
        return bisect.bisect_right(self.starts, position)


def blanked(text: str, *patterns: str) -> str:
    """The text with all matches as spaces; line breaks stay."""
    both = "|".join(f"(?:{p})" for p in patterns if p)
    return re.sub(both, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S) if both else text


def brackets(code: str) -> dict[int, int]:
    """Position after the partner of every opening brace and parenthesis; one that is never closed ends the text."""
    out: dict[int, int] = {}
    stack: dict[str, list[int]] = {"{": [], "(": []}
    for m in re.finditer(r"[{}()]", code):
        c = m[0]
        if c in stack:
            stack[c].append(m.start())
        else:
            open_ = stack["{" if c == "}" else "("]
            if open_:
                out[open_.pop()] = m.end()
    for left in stack.values():
        for at in left:
            out[at] = len(code)
    return out


@dataclass
class _Header:
    start: int
    end: int
    kind: str
    name: str
    bases: list[str]
    owner: str | None
    params: str
    ret: str
    body: int


def _names(bases: str | None) -> list[str]:
    """Plain names of a list of base types."""
    out = []
    for part in re.split(r",|\bwith\b|\+", re.sub(r"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)", "", bases or "")):
        words = [w for w in re.findall(r"[\w$]+", part.replace("::", ".").rsplit(".", 1)[-1].rsplit("\\", 1)[-1]) if w not in ("public", "private", "protected", "virtual")]
        if words:
            out.append(words[-1])
    return out


def _end_of(lang: Language, code: str, lines: Lines, start: int, body: int, pairs: dict[int, int], nexts: list[int]) -> int:
    if lang.blocks == "next":
        i = bisect.bisect_right(nexts, start)
        return nexts[i] if i < len(nexts) else len(code)
    if lang.blocks == "brace" and not lang.ends.startswith("@") or code[body - 1 : body] == "{":
        at = code.find("{", max(0, body - 1))
        return pairs.get(at, len(code)) if at >= 0 else len(code)
    line = lines.at(start)
    head = code[lines.starts[line - 1] :]
    indent = len(head) - len(head.lstrip(" \t"))
    for i in range(line, len(lines.starts)):
        stop = lines.starts[i + 1] if i + 1 < len(lines.starts) else len(code)
        row = code[lines.starts[i] : stop]
        bare = row.lstrip(" \t")
        if len(row) - len(bare) <= indent and re.match(lang.ends, bare):
            return stop
    return len(code)


def _headers(lang: Language, code: str, pairs: dict[int, int], lines: Lines) -> list[_Header]:
    found: dict[int, _Header] = {}
    flags = re.I if lang.ignore_case else 0
    raw: list[tuple[re.Match, str]] = [(m, "type") for p in lang.types for m in re.finditer(p, code, flags)]
    raw += [(m, "function") for p in lang.functions for m in re.finditer(p, code, flags)]
    nexts = sorted(m.start() for m, _ in raw)
    for m, kind in raw:
        g = m.groupdict()
        name, scope = g.get("name"), g.get("scope")
        if (name or scope) in NOT_CALLS:
            continue
        at, params, ret, body = m.end(), "", g.get("ret") or "", m.end()
        if kind == "function" and code[at : at + 1] == "(":
            close = pairs.get(at, len(code))
            params = code[at + 1 : close - 1]
            body = close
        if kind == "function" and lang.blocks == "brace":
            t = re.compile(lang.tail).match(code, body) if lang.tail else None
            if lang.tail and t is None:
                continue
            if t is not None:
                ret, body = f"{ret} {t[0][:-1]}", t.end()
            else:
                body = code.find("{", body) + 1
        if m.start("name" if name else "scope") in found:
            continue
        if kind == "type" and lang.blocks == "brace" and not lang.ends.startswith("@"):
            # a body may be absent: the header then ends here
            opened = re.compile(r"[^{};\n]*\{").match(code, m.end() - 1) if code[m.end() - 1 : m.end()] != "{" else None
            has = code[m.end() - 1 : m.end()] == "{" or opened is not None
            end = pairs.get(m.end() - 1 if code[m.end() - 1 : m.end()] == "{" else (opened.end() - 1 if opened else -1), m.end()) if has else m.end()
        elif lang.blocks == "brace" and kind == "function" and code[body - 1 : body] not in ("{",):
            stop = code.find("\n", body)  # an expression body: its line
            end = len(code) if stop < 0 else stop
        else:
            end = _end_of(lang, code, lines, m.start("name" if name else "scope"), body, pairs, nexts)
        found[m.start("name" if name else "scope")] = _Header(
            m.start("name" if name else "scope"), end, "scope" if scope else kind, name or scope, [*_names(g.get("bases")), *_names(g.get("impl"))], g.get("owner"), params, ret,
            body
        )
    return sorted(found.values(), key=lambda h: (h.start, -h.end))


def walk(lang: Language, f, text: str) -> None:
    """Adds the rows of a text to the fragment ``f``: types, functions, bases, imports, type references, calls."""
    bare = blanked(text, lang.strings, lang.comments) if lang.strings else blanked(text, lang.comments)
    # comments alone, for imports, whose targets stand in strings
    told = re.sub(f"(?P<keep>{lang.strings})|(?:{lang.comments})", lambda m: m[0] if m["keep"] is not None else re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    lines, pairs = Lines(text), brackets(bare)
    flags = re.I if lang.ignore_case else 0
    key = (lambda s: s.lower()) if lang.ignore_case else (lambda s: s)
    seen_imports = set()
    for pattern, relation in lang.imports:
        for m in re.finditer(pattern, told, flags):
            if lang.blocks != "end" and relation != "dynamic_import" and pattern.startswith(r"(?m)^\s+(?:[\w.]+") and not _in_import_block(told, m.start()):
                continue
            for name in re.split(r"\s*,\s*", m[1].strip()) if relation == "imports" and "," in m[1] else [m[1].strip()]:
                target = id_form(re.sub(r"\s+in\s+.*", "", name))
                if target and (target, relation) not in seen_imports:
                    seen_imports.add((target, relation))
                    f.edge(f.file, target, relation, lines.at(m.start(1)), "import")
    headers = _headers(lang, bare, pairs, lines)
    types: dict[str, str] = {}
    callables: dict[str, str] = {}
    for h in headers:
        if h.kind == "type" and key(h.name) not in types:
            types[key(h.name)] = f.node(h.name, lines.at(h.start))
    open_: list[tuple[_Header, str]] = []
    bodies: list[tuple[_Header, str]] = []
    linked = set()
    for h in headers:
        while open_ and open_[-1][0].end <= h.start:
            open_.pop()
        outer = next((nid for x, nid in reversed(open_) if x.kind in ("type", "scope")), None)
        line = lines.at(h.start)
        if h.kind in ("type", "scope"):
            nid = types.get(key(h.name)) or f.stub(h.name)
            if h.kind == "type" and ("in", nid) not in linked:
                linked.add(("in", nid))
                f.edge(outer if outer and outer != nid else f.file, nid, lang.defines, line)
            for b in h.bases:
                base = types.get(key(b)) or f.stub(b)
                if base != nid and (nid, base) not in linked:
                    linked.add((nid, base))
                    f.edge(nid, base, "inherits", line)
            open_.append((h, nid))
            continue
        if open_ and open_[-1][0].kind == "function" and lang.blocks == "brace" and not outer:
            owner = None
        else:
            owner = outer
        if h.owner:
            owner = types.get(key(h.owner)) or (f.stub(h.owner) if lang.blocks != "end" else None) or owner
        name = h.name
        if owner:
            label = next((n for n, i in types.items() if i == owner), h.owner or "")
            nid = f.node(f".{name}()", line, label, name)
            relation, src = "method", owner
        else:
            nid = f.node(f"{name}()", line, name)
            relation, src = lang.defines, f.file
        callables.setdefault(key(name), nid)
        if (src, nid) not in linked:
            linked.add((src, nid))
            f.edge(src, nid, relation, line)
        if lang.typed:
            for context, part in (("parameter_type", h.params), ("return_type", h.ret)):
                for t in dict.fromkeys(re.findall(r"(?<![\w.])([A-Z]\w+)\b(?!\s*:)", part)):
                    dst = types.get(key(t)) or f.stub(t)
                    if (nid, dst, context) not in linked:
                        linked.add((nid, dst, context))
                        f.edge(nid, dst, "references", line, context)
        open_.append((h, nid))
        bodies.append((h, nid))
    if lang.fields:
        for h in headers:
            if h.kind == "type":
                inner = [x for x in headers if x.kind != "scope" and h.start < x.start < h.end]
                for m in re.compile(lang.fields).finditer(bare, h.start, h.end):
                    if any(x.start <= m.start("type") < x.end for x in inner):
                        continue
                    nid, dst = types[key(h.name)], types.get(key(m["type"])) or f.stub(m["type"])
                    if dst != nid and (nid, dst, "field") not in linked:
                        linked.add((nid, dst, "field"))
                        f.edge(nid, dst, "references", lines.at(m.start("type")), "field")
    if lang is LANGUAGES["verilog"]:
        _instances(f, bare, headers, types, lines)
    spans = sorted((h.start, h.end) for h, _ in bodies)
    for h, nid in bodies:
        seen = set()
        inner = [(a, b) for a, b in spans[bisect.bisect_right(spans, (h.start, h.end)) :] if a < h.end]
        for name, member, at in _calls(lang, bare, h.body, h.end, flags):
            if any(a <= at < b for a, b in inner):
                continue
            target = callables.get(key(name))
            if target and target != nid:
                if target not in seen:
                    seen.add(target)
                    f.edge(nid, target, "calls", lines.at(at), "call")
            elif not target:
                f.call(nid, name, lines.at(at), member)


def _in_import_block(text: str, at: int) -> bool:
    head = text.rfind("import", 0, at)
    return head >= 0 and "(" in text[head:at] and ")" not in text[head:at]


def _calls(lang: Language, code: str, start: int, end: int, flags: int) -> Iterator[tuple[str, bool, int]]:
    for m in re.compile(lang.calls, flags).finditer(code, start, end):
        g = m.groupdict()
        name = g.get("name") or g.get("plain")
        if name and name.lower() not in NOT_CALLS:
            yield name, bool(g.get("of")), m.start()


#: Words that begin a statement and are no module.
_VERILOG_WORDS = frozenset("module input output inout wire reg logic assign always initial begin end if else case for function task endmodule parameter localparam integer genvar generate return import typedef class".split())


def _instances(f, code: str, headers: list[_Header], types: dict[str, str], lines: Lines) -> None:
    for m in re.finditer(r"(?m)^[ \t]*(\w+)\s+(?:#\s*\([^;]{0,400}?\)\s*)?(\w+)\s*\(", code):
        if m[1] in _VERILOG_WORDS or m[2] in _VERILOG_WORDS:
            continue
        owner = next((types[h.name] for h in headers if h.kind == "type" and h.start <= m.start() < h.end), None)
        if owner:
            dst = types.get(m[1]) or f.stub(m[1])
            if dst != owner:
                f.edge(owner, dst, "instantiates", lines.at(m.start(1)))


def scripts_of(text: str) -> str:
    """The script parts of a component file, all else blank, so lines stay."""
    keep = [(m.start(1), m.end(1)) for m in re.finditer(r"(?is)<script[^>]*>(.*?)</script>", text)]
    front = re.match(r"(?s)\s*---\n(.*?)\n---", text)
    if front:
        keep.append((front.start(1), front.end(1)))
    out, at = [], 0
    for a, b in sorted(keep):
        out += [re.sub(r"[^\n]", " ", text[at:a]), text[a:b]]
        at = b
    return "".join([*out, re.sub(r"[^\n]", " ", text[at:])])
