"""Rendered views and files: HTML, tree, drawing, vault notes, memory files, backups and diagnostics.

What is one row per node or community stays a DataFrame; a page that a person opens is put together on the
driver and refuses graphs beyond a stated size, or shows communities in place of nodes."""

from __future__ import annotations

import datetime as dt
import hashlib
import html
import json
import math
import os
import re
import shutil
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import safe_label
from weftgraph.operators import analytics as A
from weftgraph.operators.questions import note_names

#: Nodes of a page; a larger graph is shown by community.
MAX_PAGE_NODES = 5000
#: Files of an output folder that a backup keeps.
ARTIFACTS = ("graph.json", "labels.json", "analysis.json", "manifest.json", "report.md", "cost.json", "semantic_marker")


def page_graph(nodes: DataFrame, edges: DataFrame, most: int = MAX_PAGE_NODES) -> tuple[str, list[dict], list[dict]]:
    """(level, nodes, links) for a page: those of the graph, or beyond ``most`` nodes those of its communities.

    Links are one per pair; a graph of nodes may have at most 20 times as many links as ``most``, else it is shown by
    community too."""
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "relation").where("u <> v").groupBy("u",
        "v").agg(F.min("relation").alias("relation"), F.count("*").alias("n"))
    if nodes.limit(most + 1).count() <= most and pairs.limit(20 * most + 1).count() <= 20 * most:
        ns = [r.asDict() for r in A.with_degree(nodes, edges).select("id", "label", "community", "source_file", "degree").orderBy("id").collect()]
        return "nodes", ns, [r.asDict() for r in pairs.orderBy("u", "v").collect()]
    size = nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("degree"))
    if size.limit(most + 1).count() > most:
        raise ValueError(f"the graph has over {most} nodes and over {most} communities; write tables instead")
    ns = [{"id": str(r["community"]), "label": f"Community {r['community']}", "community": r["community"], "source_file": "",
        "degree": r["degree"]} for r in size.orderBy("community").collect()]
    c = nodes.select("id", "community")
    meta = edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")),
        "dst").where("a <> b")
    links = meta.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n")).orderBy("u", "v")
    return "communities", ns, [{"u": str(r["u"]), "v": str(r["v"]), "relation": "", "n": r["n"]} for r in links.toLocalIterator()]


def _json(value) -> str:
    """JSON that cannot end the script element that holds it."""
    return json.dumps(value, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


_SCRIPT = """
const hue = c => 'hsl(' + ((c === null ? 0 : c) * 47 % 360) + ',60%,55%)';
const view = document.getElementById('view'), found = document.getElementById('found');
const show = q => {
  const low = q.toLowerCase();
  const hits = data.nodes.filter(n => String(n.label).toLowerCase().includes(low)).slice(0, 200);
  found.textContent = '';
  for (const n of hits) {
    const row = document.createElement('li');
    row.textContent = n.label + ' (' + n.degree + ')';
    row.style.borderLeft = '4px solid ' + hue(n.community);
    row.onclick = () => detail(n);
    found.appendChild(row);
  }
};
const detail = n => {
  const near = data.links.filter(l => l.u === n.id || l.v === n.id);
  view.textContent = n.label + '\\n' + (n.source_file || '') + '\\n' + near.map(l => l.relation + ' ' + (l.u === n.id ? l.v : l.u)).join('\\n');
};
document.getElementById('q').oninput = e => show(e.target.value);
show('');
"""


def html_page(nodes: DataFrame, edges: DataFrame, title: str = "Graph", most: int = MAX_PAGE_NODES) -> str:
    """A page that lists and searches the nodes and shows their links, without outside scripts."""
    level, ns, links = page_graph(nodes, edges, most)
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>{len(ns)} {level}, {len(links)} links</p>"
        f"<input id='q' placeholder='search'><ul id='found'></ul><pre id='view'></pre><script>const data = {_json({'nodes': ns, 'links': links})};{_SCRIPT}</script></body></html>"
    )


def svg_page(nodes: DataFrame, edges: DataFrame, size: int = 1000, most: int = 500) -> str:
    """A drawing: communities on a circle, their nodes on circles around them, links as lines. Places are computed
    from the order of ids, so equal graphs give equal drawings."""
    _, ns, links = page_graph(nodes, edges, most)
    groups: dict = {}
    for n in ns:
        groups.setdefault(n["community"], []).append(n)
    at, centre = {}, size / 2
    for i, (_, group) in enumerate(sorted(groups.items(), key=lambda x: (x[0] is None, x[0] or 0))):
        turn = 2 * math.pi * i / max(1, len(groups))
        cx, cy = centre + 0.33 * size * math.cos(turn), centre + 0.33 * size * math.sin(turn)
        for j, n in enumerate(group):
            step, r = 2 * math.pi * j / max(1, len(group)), 0 if len(group) == 1 else 0.12 * size
            at[n["id"]] = (round(cx + r * math.cos(step), 1), round(cy + r * math.sin(step), 1))
    lines = [f'<line x1="{at[x["u"]][0]}" y1="{at[x["u"]][1]}" x2="{at[x["v"]][0]}" y2="{at[x["v"]][1]}" stroke="#999"/>' for x in links if x["u"] in at and x["v"] in at]
    dots = [f'<circle cx="{at[n["id"]][0]}" cy="{at[n["id"]][1]}" r="{min(12, 3 + math.isqrt(n["degree"]))}"><title>{html.escape(str(n["label"]))}</title></circle>' for n in ns]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}">{"".join(lines)}{"".join(dots)}</svg>'


def tree_page(leaves: DataFrame, title: str = "Files", most: int = 100_000) -> str:
    """Folders, files and symbols as nested lists. ``leaves``: (source_file, at, name) of ``diagrams.tree_leaves``."""
    rows = leaves.orderBy("source_file", "at").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a tree page is for at most {most} symbols")
    tree: dict = {}
    for r in rows:
        at = tree
        for part in r["source_file"].split("/"):
            at = at.setdefault(part, {})
        at.setdefault("", []).append(r["name"])

    def count(t: dict) -> int:
        return len(t.get("", [])) + sum(count(v) for k, v in t.items() if k)

    def draw(t: dict) -> str:
        inner = "".join(f"<li><details><summary>{html.escape(k)} ({count(v)})</summary>{draw(v)}</details></li>" for k, v in sorted(t.items(), key=lambda x: x[0].lower()) if k)
        return f"<ul>{inner}{''.join(f'<li>{html.escape(n)}</li>' for n in t.get('', []))}</ul>"

    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{draw(tree)}</body></html>"


def flow_page(overview: DataFrame, chain: list[str], title: str = "Call flow") -> str:
    """A page with the flowchart of sections as text for a diagram renderer, and the main flow."""
    lines = [r["line"] for r in overview.orderBy("part", "rank", "name").collect()]  # a row per section and at most a dozen links
    chart = html.escape("\n".join(["flowchart LR", *lines]))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><p>{html.escape(' -> '.join(chain))}</p><pre class='mermaid'>{chart}</pre></body></html>"


def vault_notes(nodes: DataFrame, edges: DataFrame, links: int = 50) -> DataFrame:
    """(name, text): a note per node with front matter and links to its neighbours, the first ``links`` by relation and
    name; a closing line tells how many more there are."""
    names = note_names(nodes)
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation", "confidence").union(edges.select("dst", "src", "relation", "confidence")).distinct()
    near = both.join(names.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other")
    w = Window.partitionBy("id").orderBy("relation", "other_name", "other", "confidence")
    first = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= links)
    line = F.concat(F.lit("- [["), F.col("other_name"), F.lit("]] - `"), F.col("relation"), F.lit("` ["), F.col("confidence"), F.lit("]"))
    body = first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    total = near.groupBy("id").agg(F.count("*").alias("n"))
    n = nodes.join(names, "id").join(body, "id", "left").join(total, "id", "left")
    more = F.when(F.col("n") > links, F.concat(F.lit("\n- and "), (F.col("n") - links).cast("string"), F.lit(" more"))).otherwise("")
    head = F.concat(F.lit('---\nsource_file: "'), F.replace(F.coalesce("source_file", F.lit("")), F.lit('"'), F.lit("'")), F.lit('"\ntype: "'), F.coalesce("file_type", F.lit("")),
        F.lit('"\ncommunity: '), F.coalesce(F.col("community").cast("string"), F.lit("null")), F.lit("\n---\n\n# "))
    text = F.concat(head, safe_label(F.col("label")), F.when(F.col("body").isNull(), "").otherwise(F.concat(F.lit("\n\n## Connections\n\n"), "body", more)), F.lit("\n"))
    return n.select("name", text.alias("text"))


def community_notes(nodes: DataFrame, members: int = 100) -> DataFrame:
    """(name, text): a note per community that links its first members."""
    n = nodes.where("community is not null").join(note_names(nodes), "id")
    w = Window.partitionBy("community").orderBy("name")
    first = n.withColumn("k", F.row_number().over(w)).where(F.col("k") <= members)
    body = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("- [["), F.col("name"), F.lit("]]")).alias("l")))),
        lambda x: x["l"]), "\n").alias("body"))
    size = n.groupBy("community").agg(F.count("*").alias("n"))
    c = F.col("community").cast("string")
    return body.join(size, "community").select(F.concat(F.lit("_COMMUNITY_"), c).alias("name"),
        F.concat(F.lit("# Community "), c, F.lit("\n\n"), F.col("n").cast("string"), F.lit(" members\n\n"), "body", F.lit("\n")).alias("text"))


def memory_note(question: Column, answer: Column, at: Column, kind: Column, source_nodes: Column) -> Column:
    """struct<name,text> of an answered question as a Markdown file that a later scan reads again."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    slug = F.btrim(F.substring(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}_]", "_"), 1, 50), F.lit("_"))
    listed = F.coalesce(source_nodes, F.array().cast("array<string>"))
    some = F.size(listed) > 0
    head = F.concat(F.lit("---\ntype: "), quoted(kind), F.lit("\ndate: "), quoted(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")), F.lit("\nquestion: "), quoted(question),
        F.when(some, F.concat(F.lit("\nsource_nodes: ["), F.array_join(F.transform(F.slice(listed, 1, 10), quoted), ", "), F.lit("]"))).otherwise(""), F.lit("\n---\n"))
    tail = F.when(some, F.concat(F.lit("\n\n## Source Nodes\n\n"), F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    name = F.concat(F.lit("query_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), slug, F.lit(".md"))
    return F.struct(name.alias("name"), F.concat(head, F.lit("\n# Q: "), question, F.lit("\n\n## Answer\n\n"), answer, tail).alias("text"))


def backup(folder: str, today: dt.date | None = None) -> str | None:
    """Copies the files of a local output folder that cannot be made again for nothing into a dated folder before
    they are overwritten: where a semantic marker stands, or where a community has a name of its own. Gives the
    folder, or None. One folder a day; equal content is not copied again."""
    graph = os.path.join(folder, "graph.json")
    if not os.path.exists(graph):
        return None
    labels = read_json_or(os.path.join(folder, "labels.json"), {})
    curated = isinstance(labels, dict) and any(v != f"Community {k}" for k, v in labels.items())
    if not curated and not os.path.exists(os.path.join(folder, "semantic_marker")):
        return None
    target = os.path.join(folder, (today or dt.date.today()).isoformat())
    old = os.path.join(target, "graph.json")
    digest = lambda p: hashlib.sha256(open(p, "rb").read()).digest()
    if os.path.exists(old) and digest(old) == digest(graph):
        return target
    os.makedirs(target, exist_ok=True)
    for name in ARTIFACTS:
        if os.path.exists(os.path.join(folder, name)):
            shutil.copy2(os.path.join(folder, name), os.path.join(target, name))
    return target


def read_json_or(path: str, default):
    """The JSON of a local file; the default if it is missing or no JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def diagnostic_lines(summary: DataFrame) -> DataFrame:
    """(at, line): the one row of ``analytics.diagnostics`` as a report, a line per count."""
    names = summary.columns
    rows = F.array(*(F.struct(F.lit(i).alias("at"), F.concat(F.lit(f"{n.removeprefix('n_')}: "), F.col(n).cast("string")).alias("line")) for i, n in enumerate(names)))
    return summary.select(F.explode(rows).alias("r")).select("r.at", "r.line")


def diagnostic_json(summary: DataFrame) -> str:
    """The same as JSON."""
    return json.dumps({"schema_version": 1, "summary": summary.first().asDict()}, sort_keys=True)


def upsert(nodes: DataFrame, edges: DataFrame, connect: Callable[[], object], batch: int = 500) -> None:
    """Hands parameterised MERGE statements to a graph store, partition by partition: ``connect()`` gives an object
    with ``run(statement, rows)`` and ``close()``. Nodes go before edges; only scalar properties travel; a statement
    is idempotent, so a task may run again."""
    scalar = ("string", "boolean", "byte", "short", "int", "bigint", "float", "double")

    def name(s: str, other: str) -> str:
        return s if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", s or "") else other

    def send(rows: Iterator, statement: Callable[[dict], str]) -> None:
        store, held = connect(), {}
        try:
            for r in rows:
                d = {k: v for k, v in r.asDict().items() if v is not None}
                held.setdefault(statement(d), []).append(d)
                if sum(map(len, held.values())) >= batch:
                    for s, ds in held.items():
                        store.run(s, ds)
                    held.clear()
            for s, ds in held.items():
                store.run(s, ds)
        finally:
            store.close()

    flat = lambda df: df.select(*(c for c, t in df.dtypes if t in scalar))
    node = lambda d: f"UNWIND $rows AS row MERGE (n:{name(d.get('file_type', '').capitalize(), 'Entity')} {{id: row.id}}) SET n += row"
    edge = lambda d: f"UNWIND $rows AS row MATCH (a {{id: row.src}}), (b {{id: row.dst}}) MERGE (a)-[r:{name(d.get('relation', '').upper(), 'RELATES_TO')}]->(b) SET r += row"
    flat(nodes).foreachPartition(lambda rows: send(rows, node))
    flat(edges).foreachPartition(lambda rows: send(rows, edge))
