"""Model answers as a dataflow: packed chunks go to a backend, are halved and asked again where the backend
cannot answer them whole, and the parsed fragments are merged and accounted for.

A backend is a function of a list of (path, text) that returns a dict with ``content`` and, by choice,
``finish_reason``, ``input_tokens`` and ``output_tokens``, or raises. Backends are registered by name; this
package comes with none that leaves the machine.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest answer that is parsed, in characters.
MAX_ANSWER = 10 * 1024 * 1024
MAX_DEPTH = 3
#: Words of an error that say that a prompt is too long.
TOO_LONG = (
    "context size", "context length", "context_length", "context window", "n_keep", "exceeds the available", "n_ctx", "maximum context", "too many tokens", "prompt is too long",
    "context_length_exceeded",
)
FRAGMENT = "struct<nodes:array<map<string,string>>,edges:array<map<string,string>>,hyperedges:array<map<string,string>>>"
_ASKED = "chunk string, part string, depth int, n_items int, content string, input_tokens long, output_tokens long, truncated boolean, error string"

Backend = Callable[[list[tuple[str, str]]], dict]
BACKENDS: dict[str, Backend] = {}


def register_backend(name: str, backend: Backend) -> None:
    BACKENDS[name] = backend


def bare_answer(raw: Column) -> Column:
    """The answer without a code fence and the word json after it; null where it is too long to be read."""
    inner = F.get(F.split(raw, "```", 3), F.lit(1))
    inner = F.when(inner.startswith("json"), F.substr(inner, F.lit(5))).otherwise(inner)
    return F.when(F.length(raw) <= MAX_ANSWER, F.trim(F.when(raw.startswith("```"), inner).otherwise(raw)))


def parsed(raw: Column) -> Column:
    """``FRAGMENT`` of an answer; empty lists for what is missing, and all empty if it is no JSON object."""
    j = F.from_json(bare_answer(raw), FRAGMENT)
    empty = F.array().cast("array<map<string,string>>")
    return F.struct(*(F.coalesce(j[k], empty).alias(k) for k in ("nodes", "edges", "hyperedges")))


def hollow(raw: Column) -> Column:
    """Whether an answer holds nothing: null, blank, unreadable, or without nodes, edges and hyperedges."""
    p = parsed(raw)
    return raw.isNull() | (F.trim(raw) == "") | ((F.size(p["nodes"]) == 0) & (F.size(p["edges"]) == 0) & (F.size(p["hyperedges"]) == 0))


def too_long(message: str) -> bool:
    low = message.lower()
    return any(w in low for w in TOO_LONG)


def _is_hollow(content: str | None) -> bool:
    text = (content or "").strip()
    if text.startswith("```"):
        text = text.split("```", 2)[1].removeprefix("json")
    try:
        got = json.loads(text) if len(text) <= MAX_ANSWER else None
    except ValueError:
        return True
    return not (isinstance(got, dict) and any(got.get(k) for k in ("nodes", "edges", "hyperedges")))


def ask(chunks: DataFrame, backend: str | Backend, max_depth: int = MAX_DEPTH, parallel: int | None = None) -> DataFrame:
    """One row per answer that was kept or given up. ``chunks``: (chunk, items array<struct<path,text>>).

    An answer that is cut short, hollow, or refused because the prompt is too long is asked again in halves, to
    ``max_depth`` halvings and down to one item; what is left then is kept as it came, truncated ones marked.
    Other errors fail their part alone: content null, error set. ``part`` is the path of halvings (``""``, ``0``,
    ``01``); token counts include the answers thrown away. ``parallel`` bounds the requests at a time.
    """
    f = BACKENDS[backend] if isinstance(backend, str) else backend

    def tried(items: list, part: str) -> Iterator[tuple]:
        depth = len(part)
        can_halve = depth < max_depth and len(items) > 1
        try:
            got = f([(i["path"], i["text"]) for i in items])
        except Exception as e:
            if can_halve and too_long(str(e)):
                yield from halves(items, part, 0, 0)
            else:
                yield part, depth, len(items), None, 0, 0, False, f"{type(e).__name__}: {e}"[:300]
            return
        spent, made = int(got.get("input_tokens", 0)), int(got.get("output_tokens", 0))
        cut = got.get("finish_reason") == "length"
        if can_halve and (cut or _is_hollow(got.get("content"))):
            yield from halves(items, part, spent, made)
        else:
            yield part, depth, len(items), got.get("content"), spent, made, cut, None

    def halves(items: list, part: str, spent: int, made: int) -> Iterator[tuple]:
        middle = len(items) // 2
        for i, half in enumerate((items[:middle], items[middle:])):
            for p, d, n, content, a, b, cut, error in tried(half, part + str(i)):
                yield p, d, n, content, a + spent, b + made, cut, error
                spent = made = 0  # the thrown-away answer is counted once

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ASKED.split(", ")]
        for pdf in batches:
            rows = [(c, *r) for c, items in zip(pdf["chunk"], pdf["items"], strict=True) for r in tried(list(items), "") if len(items)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype(object).where(out.notna(), None)

    dealt = chunks.select(F.col("chunk").cast("string").alias("chunk"), "items")
    return (dealt.repartition(parallel) if parallel else dealt).mapInPandas(run, _ASKED)


def merge_answers(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all answers as (chunk, part, at, item map); parts that failed have none."""
    p = asked.where("content is not null").select("chunk", "part", parsed(F.col("content")).alias("f"))
    of = lambda kind: p.select("chunk", "part", F.posexplode(f"f.{kind}").alias("at", "item"))
    return of("nodes"), of("edges")


def accounting(asked: DataFrame, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """One row: chunks, answers, failed chunks (no part of theirs answered), failed parts, truncated answers, tokens
    and their cost at prices per million tokens."""
    per = asked.groupBy("chunk").agg(
        F.count("*").alias("parts"), F.count_if(F.col("content").isNull()).alias("failed"), F.count_if("truncated").alias("cut"), F.sum("input_tokens").alias("i"),
        F.sum("output_tokens").alias("o")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    cost = total("i") * F.lit(price_in / 1e6) + total("o") * F.lit(price_out / 1e6)
    return per.agg(
        F.count("*").alias("n_chunks"), total("parts").alias("n_answers"), F.count_if(F.col("failed") == F.col("parts")).alias("n_failed_chunks"),
        total("failed").alias("n_failed_parts"), total("cut").alias("n_truncated"),
        total("i").alias("input_tokens"), total("o").alias("output_tokens"), F.round(cost, 6).alias("cost"),
    )


def good_chunks(raw: DataFrame) -> DataFrame:
    """(path, fragment) of chunk files (path, text) that hold a JSON object; the others are left out."""
    j = F.from_json("text", FRAGMENT)
    ok = F.trim("text").startswith("{") & F.try_parse_json("text").isNotNull()
    return raw.where(ok).select("path", j.alias("fragment"))


def fragment_problems(files: DataFrame, max_bytes: int = 50 << 20) -> DataFrame:
    """(path, problem): size, json or shape of fragment files (path, size, text), the first that holds; size is
    looked at before the text is."""
    shape = F.get_json_object("text", "$.nodes").startswith("[") & F.get_json_object("text", "$.edges").startswith("[")
    problem = F.when(F.col("size") > max_bytes, "size").when(F.try_parse_json("text").isNull(), "json").when(~F.coalesce(shape, F.lit(False)), "shape")
    return files.select("path", problem.alias("problem")).where("problem is not null")
