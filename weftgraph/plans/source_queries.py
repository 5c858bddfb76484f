"""Queries of sources, resolution, answers and diagrams, each with its DuckDB twin."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.model import STAR_SQL, star_edges, star_nodes, table
from weftgraph.operators import analytics as A
from weftgraph.operators import answers as W
from weftgraph.operators import build as B
from weftgraph.operators import changes as H
from weftgraph.operators import dedup as D
from weftgraph.operators import diagrams as G
from weftgraph.operators import federation as U
from weftgraph.operators import resolution as R
from weftgraph.operators import search as S
from weftgraph.operators import traverse as V
from weftgraph.plans.graph_queries import _SURPRISE as SURPRISE_SQL
from weftgraph.scratch import Scratch
from weftgraph.sinks import pages as P
from weftgraph.sinks import writers
from weftgraph.sources import corpus as C
from weftgraph.sources import extractors as X
from weftgraph.sources import facts, office
from weftgraph.sources import selection as L
from weftgraph.streaming import feeds, state

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, star: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = f"WITH {STAR_SQL}{' ' if body.startswith('SELECT') else ', '}{body}" if star else body
        return f

    return add


def _part(spark, sf):
    return table(spark, sf, "part")


def _key():
    return F.col("p_partkey").cast("string")


# --- files -------------------------------------------------------------------------------------------------

_TAILS = ("/a.py", "/b.md", "/node_modules/c.js", "/secrets/d.txt", "/e.log", "/f.png", "/g.txt", "/build/h.md")
_DOC_PATH = "(source || CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '/' || doc_id || '{t}'" for i, t in enumerate(_TAILS)) + " END)"


def _doc_files(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), tail).alias("path"), "text")


_WORDS = r"CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0b\f\r ]+'), lambda w: w <> '')) AS BIGINT)"
_SIGNS = " + ".join(f"CAST(regexp_matches(substr(coalesce(text, ''), 1, 3000), '{p.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for p in C.PAPER_SIGNALS)


@query(f"""SELECT file_type, count(*) AS files, CAST(sum(CASE WHEN file_type = 'image' THEN 0 ELSE w END) AS BIGINT) AS words FROM (
SELECT CASE doc_id % 8 WHEN 0 THEN 'code' WHEN 5 THEN 'image' ELSE CASE WHEN {_SIGNS} >= 3 THEN 'paper' ELSE 'document' END END AS file_type, {_WORDS} AS w FROM documents WHERE doc_id % 8 IN (0, 1, 5, 6)) GROUP BY 1""")
def corpus_scan(spark, sf):
    return C.survey(_doc_files(spark, sf), ["*.log"])


@query("SELECT CASE doc_id % 8 WHEN 0 THEN '.py' ELSE '.md' END AS suffix, count(*) AS n FROM documents WHERE doc_id % 8 IN (0, 1) GROUP BY 1")
def collect_files(spark, sf):
    return L.collect_files(_doc_files(spark, sf)).groupBy(C.suffix_of(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"))


@query("SELECT doc_id % 8 AS slot, doc_id % 8 IN (2, 7) AS noise, count(*) AS n FROM documents GROUP BY 1, 2")
def noise_directories(spark, sf):
    return _doc_files(spark, sf).groupBy((F.col("doc_id") % 8).alias("slot"), C.in_noise(F.col("path")).alias("noise")).agg(F.count("*").alias("n"))


_HEADS = ("#!/usr/bin/env python3", "#!/bin/bash -e", "#!/usr/bin/env -S FOO=1 node --x", "#!/usr/bin/awk -f", "no script", "#! /usr/local/bin/ruby")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'python3' WHEN 1 THEN 'bash' WHEN 2 THEN 'node' WHEN 3 THEN 'awk' WHEN 4 THEN '' ELSE 'ruby' END AS program, CASE WHEN p_partkey % 6 IN (0, 1, 2, 5) THEN 'code' END AS file_type FROM part")
def shebang_sniff(spark, sf):
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _part(spark, sf).select("p_partkey", C.shebang_interpreter(head).alias("program"), C.classify(F.concat(F.lit("bin/tool"), _key()), shebang=head).alias("file_type"))


@query("SELECT doc_id, doc_id % 8 IN (1, 2, 7) OR source = 'src1' AS included FROM documents")
def include_list(spark, sf):
    return L.included(_doc_files(spark, sf), ["# kept", "*.md", "/src1", "node_modules/", ""]).select("doc_id", "included")


@query("SELECT DISTINCT source AS path, source IN ('src1', 'src2') AS reachable FROM documents")
def include_reach(spark, sf):
    return L.may_hold_included(table(spark, sf, "documents").select(F.col("source").alias("path")).distinct(), ["src1/deep/*.md", "/src2"])


_HOSTS = ("https://example.org/x", "http://10.1.2.3/", "ftp://example.org/", "http://localhost:80/", "https://172.32.0.1/a", "http://user@192.168.0.9/", "http://[::1]/",
    "https://8.8.8.8/", "http:///nohost", "http://100.64.0.1/")
_PROBLEMS = (None, "private", "scheme", "private", None, "private", "private", None, "host", "private")


@query("SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PROBLEMS) if p) + " END AS problem FROM part")
def safe_fetch(spark, sf):
    url = F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return _part(spark, sf).select("p_partkey", L.url_problem(url).alias("problem"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN NULL ELSE 'scheme' END AS problem FROM pages WHERE regexp_matches(url, '^[a-z]+://[a-z.]*(example|org|net|com)[a-z.]*/')")
def safe_pages(spark, sf):
    p = table(spark, sf, "pages").where(F.col("url").rlike(r"^[a-z]+://[a-z.]*(example|org|net|com)[a-z.]*/"))
    return p.select("page_id", L.url_problem(F.col("url")).alias("problem"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'spreadsheet' WHEN 2 THEN 'presentation' END AS kind, CASE WHEN p_partkey % 4 < 3 THEN 'D' || p_partkey END AS doc_id FROM part""")
def google_shortcuts(spark, sf):
    i = F.col("p_partkey") % 4
    path = F.concat(F.lit("a/"), _key(), F.when(i == 0, ".gdoc").when(i == 1, ".gsheet").when(i == 2, ".gslides").otherwise(".gdoc"))
    text = F.when(i == 0, F.concat(F.lit('{"doc_id": "D'), _key(), F.lit('"}'))).when(i == 1,
        F.concat(F.lit('{"url": "https://docs.example/d/D'), _key(), F.lit('/edit"}'))).when(i == 2,
        F.concat(F.lit('{"url": "https://docs.example/open?id=D'), _key(), F.lit('"}'))).otherwise("not json")
    s = L.shortcut(path, text)
    return _part(spark, sf).select("p_partkey", s["kind"].alias("kind"), s["doc_id"].alias("doc_id"))


@query("""SELECT page_id, '---' || chr(10) || 'title: "' || replace(replace(regexp_replace(title, '[\\r\\n]+', ' ', 'g'), '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || 'type: "webpage"' || chr(10) || 'source: "' || replace(replace(url, '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || '---' || chr(10) || chr(10) || title AS text
FROM (SELECT *, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g')) AS title FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)""")
def page_notes(spark, sf):
    title = T.html_title(F.col("html"))
    return table(spark, sf, "pages").where("url is not null and html is not null").select("page_id", L.front_matter(title, F.lit("webpage"), F.col("url"), title).alias("text"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def front_matter_strip(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    noted = F.concat(F.lit("---\ntitle: x\ntags: [a]\n---"), F.col("text"))
    return d.select("doc_id", T.without_front_matter(noted).alias("text"))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


_WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SNS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RNS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
_TABLE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/table"


def _docx(name: str) -> bytes:
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in cells) + "</w:tr>"
    body = p("H1", name) + p("H2", "Part") + "<w:p/>" + p("LB", "point") + p("Body", "plain " + name) + f"<w:tbl>{row('k', 'v')}{row('name', name)}</w:tbl>"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("H2", "heading 2"), ("LB", "List Bullet"), ("Body", "Normal")))
    return _zipped({"word/document.xml": f"<w:document {_WNS}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {_WNS}>{styles}</w:styles>"})


def _xlsx(name: str, key: int) -> bytes:
    rows = f'<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>name</t></is></c></row><row r="2"/><row r="3"><c r="A3"><v>{key}</v></c><c r="B3" t="s"><v>1</v></c></row><row r="4"><c r="B4" t="b"><v>1</v></c></row>'
    return _zipped({
        "xl/workbook.xml": f'<workbook {_SNS}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Empty" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {_RNS}><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {_SNS}><sheetData>{rows}</sheetData></worksheet>", "xl/worksheets/sheet2.xml": f"<worksheet {_SNS}><sheetData/></worksheet>",
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships {_RNS}><Relationship Id="rId1" Type="{_TABLE_REL}" Target="../tables/table1.xml"/></Relationships>',
        "xl/tables/table1.xml": f'<table {_SNS} name="Nations" ref="A1:B4"><tableColumns><tableColumn id="1" name="key"/><tableColumn id="2" name="name"/></tableColumns></table>',
        "xl/sharedStrings.xml": f"<sst {_SNS}><si><t>key</t></si><si><r><t>{name[:2]}</t></r><r><t>{name[2:]}</t></r></si></sst>",
    })


def _office(spark, sf):
    def run(batches):
        for pdf in batches:
            rows = []
            for k, n in zip(pdf["k"], pdf["n"], strict=True):
                rows += [(f"docs/{n}.docx", _docx(n)), (f"docs/{n}.xlsx", _xlsx(n, k)), (f"docs/{n}-broken.docx", b"PK no archive"), (f"docs/{n}.txt", b"text")]
            yield pd.DataFrame(rows, columns=["path", "content"])

    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("n"))
    return n.mapInPandas(run, "path string, content binary")


_N = "replace(n_name, ' ', '_')"
_SIDE = "n || '_' || substr(sha256(path), 1, 8) || '.md'"


@query(f"""WITH f AS (SELECT n_nationkey AS k, {_N} AS n FROM nation), d AS (SELECT *, 'docs/' || n || '.docx' AS path FROM f), x AS (SELECT *, 'docs/' || n || '.xlsx' AS path FROM f)
SELECT path, {_SIDE} AS sidecar, '<!-- converted from ' || n || '.docx -->' || chr(10) || chr(10) || '# ' || n || chr(10) || '## Part' || chr(10) || chr(10) || '- point' || chr(10) || 'plain ' || n || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| name | ' || n || ' |' AS markdown FROM d
UNION ALL SELECT path, {_SIDE}, '<!-- converted from ' || n || '.xlsx -->' || chr(10) || chr(10) || '## Sheet: Data' || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || k || ' | ' || n || ' |' || chr(10) || '|  | True |' FROM x""")
def office_markdown(spark, sf):
    return office.office_markdown(_office(spark, sf))


@query(f"""WITH f AS (SELECT {_N} AS n, regexp_replace(lower({_N}), '[^a-z0-9]', '_', 'g') AS s FROM nation)
SELECT 'docs_' || regexp_replace(lower(n), '[^a-z0-9_]', '_', 'g') || '_xlsx' AS src, s || '_data' AS dst, 'contains' AS relation FROM f UNION ALL SELECT 'docs_' || regexp_replace(lower(n), '[^a-z0-9_]', '_', 'g') || '_xlsx', s || '_empty', 'contains' FROM f
UNION ALL SELECT s || '_data', s || '_data_nations', 'contains' FROM f UNION ALL SELECT s || '_data_nations', s || '_nations_key', 'contains' FROM f UNION ALL SELECT s || '_data_nations', s || '_nations_name', 'contains' FROM f""")
def workbook_structure(spark, sf):
    return office.office_structure(_office(spark, sf)).where("kind = 'edge'").select("src", "dst", "relation")


@query("SELECT 'region:' || n_regionkey AS dst, 'nation:' || n_nationkey AS src, n_name AS label, CAST(n_nationkey / 100.0 AS DOUBLE) AS confidence_score, true AS directed FROM nation")
def graph_file_reader(spark, sf):
    n = table(spark, sf, "nation").agg(
        F.sort_array(F.collect_list(F.struct(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("label")))).alias("vertices"),
        F.sort_array(F.collect_list(F.struct(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("from"),
        F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("to"),
        (F.col("n_nationkey") / 100.0).cast("string").alias("confidence_score")))).alias("relationships"),
    )  # the nations: 25 rows
    path = f"{Scratch(spark, 'graph-file').root}/graph.json"
    n.select(F.to_json(F.struct(F.lit(True).alias("directed"), F.struct("vertices", "relationships").alias("graph"))).alias("value")).coalesce(1).write.text(path)
    nodes, edges, directed = state.read_graph(spark, path)
    return edges.join(nodes.select(F.col("id").alias("src"), "label"), "src").select("src", "dst", "label", "confidence_score", F.lit(directed).alias("directed"))


# --- extraction and facts ----------------------------------------------------------------------------------


@query("SELECT 'py/' || n_nationkey || '.py' AS source_file, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 2 END AS nodes FROM nation")
def failing_files(spark, sf):
    k = F.col("n_nationkey").cast("string")
    f = table(spark, sf, "nation").select(F.concat(F.lit("py/"), k, F.lit(".py")).alias("path"),
        F.when(F.col("n_nationkey") % 2 == 0, "def broken(:\n").otherwise("def fine():\n    pass\n").alias("text"))
    rows = X.extract(f)
    return rows.groupBy("source_file").agg(F.count_if(F.col("kind") == "error").cast("int").alias("errors"), F.count_if(F.col("kind") == "node").cast("int").alias("nodes"))


@query("""SELECT src, dst, relation FROM (SELECT 'p' || l_orderkey AS src, CASE WHEN l_linenumber % 2 = 0 THEN 'q' || l_partkey ELSE 'x' || l_partkey END AS dst, CASE WHEN l_linenumber % 3 = 0 THEN 'imports' ELSE 'calls' END AS relation, l_orderkey, l_partkey, l_linenumber FROM lineitem)
WHERE l_orderkey % 2 = 0 AND (relation = 'imports' OR l_linenumber % 2 = 0)""")
def keep_resolvable(spark, sf):
    li = table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    edges = li.select(
        F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("p"), s("l_orderkey")).alias("src"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("q"), s("l_partkey"))).otherwise(F.concat(F.lit("x"), s("l_partkey"))).alias("dst"),
        F.when(F.col("l_linenumber") % 3 == 0, "imports").otherwise("calls").alias("relation"),
    )
    node = lambda c: c.select(F.lit("node").alias("kind"), F.col("n").alias("id"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("relation"))
    nodes = li.where("l_orderkey % 2 = 0").select(F.concat(F.lit("p"), s("l_orderkey")).alias("n")).distinct().union(_part(spark, sf).select(F.concat(F.lit("q"), _key())))
    return X.keep_resolvable(edges.unionByName(node(nodes))).select("src", "dst", "relation")


_JS = """import def{K}, { a as b{K}, type T } from './lib{K}';
import * as ns from "pkg";
export { b{K} as c, x } from './other';
export * from './all{K}';
export default function run{K}() { return help{K}(b{K}()); }
const help{K} = run{K};
// import ghost from 'ghost'
"""
_JS_FACTS = [
    ("import", "def{K}", "./lib{K}", "default"), ("import", "b{K}", "./lib{K}", "a"), ("import", "T", "./lib{K}", "T"), ("import", "ns", "pkg", "*"),
    ("export", "c", "./other", "b{K}"), ("export", "x", "./other", "x"), ("star_export", None, "./all{K}", None),
    ("declare", "run{K}", None, "run{K}"), ("export", "default", None, "run{K}"), ("declare", "help{K}", None, "help{K}"), ("alias", "help{K}", None, "run{K}"),
    ("use", "help{K}", None, "help{K}"), ("use", "b{K}", None, "b{K}"),
]
_PY = """import os.path as osp
from .mod{K} import thing as t{K}
from pkg import *
__all__ = ["Top{K}"]
class Top{K}:
    pass
def go{K}():
    return t{K}(Top{K}())
again = go{K}
"""
_PY_FACTS = [
    ("import", "osp", "os.path", None), ("import", "t{K}", ".mod{K}", "thing"), ("star_export", None, "pkg", None), ("export", "Top{K}", None, "Top{K}"),
    ("declare", "Top{K}", None, "Top{K}"), ("declare", "go{K}", None, "go{K}"), ("alias", "again", None, "go{K}"),
    ("use", "t{K}", None, "t{K}"), ("use", "Top{K}", None, "Top{K}"),
]


def _fact_sql() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = [f"('{ext}', {', '.join(map(quoted, f))})" for ext, fs in (("ts", _JS_FACTS), ("py", _PY_FACTS)) for f in fs]
    k = "CAST(n_nationkey AS VARCHAR)"
    return f"SELECT 'm/f' || {k} || '.' || ext AS source_file, fact, replace(l, '{{K}}', {k}) AS local, replace(m, '{{K}}', {k}) AS module, replace(n, '{{K}}', {k}) AS name FROM nation, (VALUES {', '.join(rows)}) AS v(ext, fact, l, m, n)"


@query(_fact_sql())
def symbol_facts(spark, sf):
    k = F.col("n_nationkey").cast("string")
    both = F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.lit(t).alias("t")) for e, t in ((".ts", _JS), (".py", _PY)))))
    f = table(spark, sf, "nation").select(k.alias("k"), both.alias("x")).select(F.concat(F.lit("m/f"), F.col("k"), F.col("x.e")).alias("path"),
        F.replace(F.col("x.t"), F.lit("{K}"), F.col("k")).alias("text"))
    return facts.symbol_facts(f).drop("line")


# --- resolution --------------------------------------------------------------------------------------------


@query("SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'calls' AS relation, 'EXTRACTED' AS confidence, CAST(1.0 AS DOUBLE) AS confidence_score FROM lineitem WHERE l_linenumber % 2 = 0")
def import_guided_calls(spark, sf):
    s = lambda c: F.col(c).cast("string")
    li = table(spark, sf, "lineitem")
    raw = li.select(F.concat(F.lit("o"), s("l_orderkey")).alias("caller"), F.concat(F.lit("local"), s("l_partkey")).alias("callee"),
        F.concat(F.lit("f"), (F.col("l_linenumber") % 2).cast("string")).alias("source_file"))
    p = _part(spark, sf)
    aliases = p.select(F.lit("f0").alias("source_file"), F.concat(F.lit("local"), _key()).alias("local"),
        F.concat(F.lit("m"), (F.col("p_partkey") % 7).cast("string")).alias("module"), F.concat(F.lit("Name"), _key()).alias("name"))
    nodes = p.select(F.concat(F.lit("p"), _key()).alias("id"), F.concat(F.lit("name"), _key(), F.lit("()")).alias("label"),
        F.concat(F.lit("m"), (F.col("p_partkey") % 7).cast("string")).alias("stem"))
    return R.import_guided_calls(raw, aliases, nodes)


@query("SELECT 'calls' AS relation, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey % 3 <> 0")
def raw_calls_on_triples(spark, sf):
    """The library form: an edge of another relation does not hold a call back, one of the same does."""
    s = lambda c: F.col(c).cast("string")
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), s("l_orderkey")).alias("caller"), F.concat(F.lit("name"), s("l_partkey")).alias("callee"),
        F.lit(False).alias("is_member_call"), F.lit("f").alias("source_file"), F.concat(F.lit("p"), s("l_partkey")).alias("dst"), (F.col("l_partkey") % 3).alias("m"))
    nodes = _part(spark, sf).select(F.concat(F.lit("p"), _key()).alias("id"), F.concat(F.lit("Name"), _key(), F.lit("()")).alias("label"), F.lit("code").alias("file_type"))
    held = li.select(F.col("caller").alias("src"), "dst", F.when(F.col("m") == 0, "calls").otherwise("contains").alias("relation")).distinct()
    return R.resolve_calls(li.drop("dst", "m"), nodes, held, on_pair=False).select("src", "dst", "relation")


_SH = "'d' || (p_partkey % 5) || '/s' || p_partkey || '.sh'"


@query(f"""WITH p AS (SELECT p_partkey, {_SH} AS path FROM part)
SELECT 's' || a.p_partkey AS src, 's' || b.p_partkey AS dst, 'imports_from' AS relation FROM p a JOIN p b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey <> b.p_partkey
UNION ALL SELECT 'c' || a.p_partkey, 'f' || b.p_partkey, 'calls' FROM p a JOIN p b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey % 3 = 0""")
def bash_sources(spark, sf):
    half = F.floor(F.col("p_partkey") / 2)
    path = lambda k: F.concat(F.lit("d"), (k % 5).cast("string"), F.lit("/s"), k.cast("string"), F.lit(".sh"))
    p = _part(spark, sf).select("p_partkey", path(F.col("p_partkey")).alias("path"), half.alias("half"))
    sources = p.select(F.col("path").alias("source_file"), F.concat(F.lit("./../x/../"), path(F.col("half"))).alias("target"))
    edges = R.sourced_files(sources, p.select("path", F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id")))
    raw = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("caller"),
        F.concat(F.lit("fn"), F.col("half").cast("string")).alias("callee"), F.col("path").alias("source_file"))
    fns = p.select("path", F.concat(F.lit("fn"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("id"))
    return edges.unionByName(R.sourced_calls(raw, sources, fns).select("src", "dst", "relation"))


@query("""SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || p_partkey AS dst, 'imports' AS relation FROM lineitem JOIN part ON (l_linenumber % 4 <> 0 AND p_partkey = l_partkey) OR (l_linenumber % 4 = 0 AND p_partkey % 97 = l_partkey % 97 AND l_linenumber = 4)""")
def java_imports(spark, sf):
    s = lambda c: F.col(c).cast("string")
    package = lambda c: F.concat(F.lit("org.p"), (F.col(c) % 97).cast("string"))
    classes = _part(spark, sf).select(package("p_partkey").alias("package"), F.concat(F.lit("C"), _key()).alias("label"), F.concat(F.lit("p"), _key()).alias("id"))
    i = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), s("l_orderkey")).alias("file_id"),
        F.concat(package("l_partkey"), F.when(F.col("l_linenumber") % 4 == 0, ".*").otherwise(F.concat(F.lit(".C"), s("l_partkey")))).alias("name"))
    return R.package_imports(i, classes)


@query("""SELECT DISTINCT 'p' || CASE WHEN l_partkey % 2 = 1 AND l_partkey + 1 <= m THEN l_partkey + 1 ELSE l_partkey END AS src, 's' || l_suppkey AS dst, 'uses' AS relation, 'f' || (l_orderkey % 3) AS source_file, 'L' || l_linenumber AS source_location
FROM lineitem, (SELECT max(p_partkey) AS m FROM part)""")
def swift_extensions(spark, sf):
    """Odd parts extend the type that the next even part defines."""
    s = lambda c: F.col(c).cast("string")
    nodes = _part(spark, sf).select(F.concat(F.lit("p"), _key()).alias("id"), F.concat(F.lit("T"), F.floor((F.col("p_partkey") + 1) / 2).cast("string")).alias("label"),
        (F.col("p_partkey") % 2 == 1).alias("is_extension"))
    e = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), s("l_partkey")).alias("src"), F.concat(F.lit("s"), s("l_suppkey")).alias("dst"), F.lit("uses").alias("relation"),
        F.concat(F.lit("f"), (F.col("l_orderkey") % 3).cast("string")).alias("source_file"), F.concat(F.lit("L"), s("l_linenumber")).alias("source_location"),
    )
    return R.merge_extensions(nodes, e)[1]


@query("SELECT 'src_p' || p_partkey AS id, 'src/p' || p_partkey || '.py' AS source_file FROM part")
def relative_ids(spark, sf):
    n = _part(spark, sf).select(F.concat(F.lit("home_me_repo_src_p"), _key()).alias("id"), F.concat(F.lit("/home/me/repo/src/p"), _key(), F.lit(".py")).alias("source_file"))
    e = n.select(F.col("id").alias("src"), F.col("id").alias("dst"), "source_file")
    nodes, edges = R.relative_ids(n, e, "/home/me/repo", T.id_form)
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_semi").select("id", "source_file")


@query("""SELECT 'app/x' || (p_partkey % 3) || '/main' || p_partkey || '.ts' AS source_file, CASE p_partkey % 5 WHEN 0 THEN './util' WHEN 1 THEN '../lib/m' || p_partkey WHEN 2 THEN '@/lib/m' || p_partkey WHEN 3 THEN 'pkg-a' ELSE 'react' END AS specifier,
CASE p_partkey % 5 WHEN 0 THEN 'app/x' || (p_partkey % 3) || '/util/index.ts' WHEN 1 THEN 'app/lib/m' || p_partkey || '.ts' WHEN 2 THEN 'app/lib/m' || p_partkey || '.ts' ELSE 'packages/a/src/index.ts' END AS path FROM part WHERE p_partkey % 5 < 4""")
def module_paths(spark, sf):
    i = F.col("p_partkey") % 5
    imports = _part(spark, sf).select(
        F.concat(F.lit("app/x"), (F.col("p_partkey") % 3).cast("string"), F.lit("/main"), _key(), F.lit(".ts")).alias("source_file"),
        F.when(i == 0, "./util").when(i == 1, F.concat(F.lit("../lib/m"), _key())).when(i == 2, F.concat(F.lit("@/lib/m"), _key())).when(i == 3,
        "pkg-a").otherwise("react").alias("specifier"),
    )
    libs = _part(spark, sf).select(F.explode(F.array(F.concat(F.lit("app/lib/m"), _key(), F.lit(".ts")), F.concat(F.lit("app/lib/m"), _key(), F.lit(".js")))).alias("path"))
    files = libs.union(spark.createDataFrame([(f"app/x{k}/util/index.ts",) for k in range(3)] + [("packages/a/src/index.ts",)], "path string"))
    packages = spark.createDataFrame([("pkg-a", "packages/a/src/index.ts")], "name string, entry string")
    return R.resolve_modules(imports, files, [("@/*", "app/*")], packages)


@query("SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'uses' AS relation, CAST(0.8 AS DOUBLE) AS weight FROM lineitem")
def class_level_imports(spark, sf):
    s = lambda c: F.col(c).cast("string")
    li = table(spark, sf, "lineitem")
    imports = li.select(F.concat(F.lit("f"), s("l_orderkey")).alias("source_file"), F.concat(F.lit("m"), s("l_partkey")).alias("module"), F.lit("Thing").alias("name"))
    entities = _part(spark, sf).select(F.concat(F.lit("m"), _key()).alias("stem"), F.lit("Thing").alias("label"), F.concat(F.lit("p"), _key()).alias("id"))
    local = table(spark, sf, "orders").select(F.concat(F.lit("f"), s("o_orderkey")).alias("source_file"), F.concat(F.lit("o"), s("o_orderkey")).alias("id"))
    return R.class_imports(imports, entities, local).select("src", "dst", "relation", "weight")


@query("SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'references' AS relation, CASE l_linenumber % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'return_type' ELSE 'parameter_type' END AS context FROM lineitem")
def reference_edges(spark, sf):
    s = lambda c: F.col(c).cast("string")
    i = F.col("l_linenumber") % 3
    refs = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), s("l_orderkey")).alias("src"), F.concat(F.lit("p"), s("l_partkey")).alias("dst"),
        F.when(i == 0, "field").when(i == 1, "return_type").otherwise("parameter_type").alias("context"), F.lit("f").alias("source_file"), F.lit("L1").alias("source_location"))
    return R.reference_edges(refs).select("src", "dst", "relation", "context")


# --- build -------------------------------------------------------------------------------------------------


@query("""SELECT 'p' || p_partkey AS id, p_name AS label, CASE p_partkey % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'code' WHEN 2 THEN 'code' ELSE 'concept' END AS file_type, 'f' || p_size AS source_file FROM part""")
def legacy_nodes(spark, sf):
    i = F.col("p_partkey") % 5
    raw = _part(spark, sf).select(F.concat(F.lit("p"), _key()).alias("node_id"), F.col("p_name").alias("title"),
        F.when(i == 0, "Markdown").when(i == 1, "code").when(i == 2, "tool").when(i == 3, "pattern").otherwise("mystery").alias("type"),
        F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("source"))
    return B.coerce_nodes(raw).select("id", "label", "file_type", "source_file")


@query("SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'uses' AS relation, CASE WHEN l_linenumber % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS confidence_score FROM lineitem")
def legacy_edges(spark, sf):
    s = lambda c: F.col(c).cast("string")
    raw = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), s("l_orderkey")).alias("from"), F.concat(F.lit("p"), s("l_partkey")).alias("to"), F.lit("uses").alias("type"),
        F.when(F.col("l_linenumber") % 2 == 0, "0.5").otherwise("high").alias("score"))
    return B.coerce_edges(raw).select("src", "dst", "relation", "confidence_score")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'src/' || p_partkey || '.py' ELSE '/other/' || p_partkey || '.py' END AS path FROM part")
def normal_paths(spark, sf):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\\repo\\src\\"), _key(), F.lit(".py"))).otherwise(F.concat(F.lit("/other/"), _key(), F.lit(".py")))
    return _part(spark, sf).select("p_partkey", B.normalize_path(raw, "/repo").alias("path"))


_FRAG_ID = "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'a/b' || p_partkey WHEN 2 THEN 'ok_' || p_partkey WHEN 3 THEN 'bad id' || p_partkey WHEN 4 THEN repeat('x', 300) ELSE 'fine:' || p_partkey END"


@query(f"""SELECT {_FRAG_ID} AS id, unnest(CASE p_partkey % 6 WHEN 0 THEN ['empty_id'] WHEN 1 THEN ['path_separator'] WHEN 3 THEN ['bad_character'] WHEN 4 THEN ['long_id'] ELSE [] END) AS code FROM part""")
def fragment_ids(spark, sf):
    i = F.col("p_partkey") % 6
    raw = F.when(i == 0, "").when(i == 1, F.concat(F.lit("a/b"), _key())).when(i == 2, F.concat(F.lit("ok_"), _key())).when(i == 3, F.concat(F.lit("bad id"), _key())).when(i == 4,
        "x" * 300).otherwise(F.concat(F.lit("fine:"), _key()))
    return B.fragment_violations(_part(spark, sf).select(raw.alias("id")))


_WHY = "'Because ' || p_name || ' is a part that the shop must hold in stock, always.'"


@query(f"""SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN {_WHY} END AS rationale FROM part WHERE p_partkey % 5 <> 0""")
def sanitized_fragment(spark, sf):
    p = _part(spark, sf)
    code = p.select(F.concat(F.lit("p"), _key()).alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_partkey") % 5 == 0, "concept").otherwise("code").alias("file_type"))
    why = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("r"), _key()).alias("id"),
        F.concat(F.lit("Because "), "p_name", F.lit(" is a part that the shop must hold in stock, always.")).alias("label"), F.lit("rationale").alias("file_type"))
    short = p.where("p_partkey % 3 = 1").select(F.concat(F.lit("r"), _key()).alias("id"), F.lit("short one").alias("label"), F.lit("rationale").alias("file_type"))
    edges = p.select(F.concat(F.lit("r"), _key()).alias("src"), F.concat(F.lit("p"), _key()).alias("dst"), F.lit("rationale_for").alias("relation"))
    hyper = p.limit(0).select(_key().alias("id"), F.array(_key()).alias("nodes"))
    return B.sanitize_fragment(code.unionByName(why).unionByName(short), edges, hyper)[0].select("id", "rationale")


@query("SELECT repo, count(*) AS n_nodes FROM (SELECT CASE WHEN id LIKE 'nation:%' THEN 'geo' WHEN id LIKE 'part:%' THEN 'goods' ELSE 'rest' END AS repo FROM nodes) WHERE repo <> 'goods' GROUP BY 1", star=True)
def global_list_remove(spark, sf):
    n = star_nodes(spark, sf).withColumn("repo", F.when(F.col("id").startswith("nation:"), "geo").when(F.col("id").startswith("part:"), "goods").otherwise("rest"))
    return U.global_list(U.global_remove(n, star_edges(spark, sf), "goods")[0])


@query("SELECT repo || '::' || id AS id, repo FROM nodes, (VALUES ('one'), ('two'), ('three')) AS r(repo)", star=True)
def merge_graphs(spark, sf):
    """Any number of graphs side by side under prefixed ids."""
    out = None
    for tag in ("one", "two", "three"):
        n = B.prefix_repo(star_nodes(spark, sf), star_edges(spark, sf), tag)[0].select("id", "repo")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, relation, row_number() OVER (ORDER BY relation, source_location) - 1 AS key FROM (SELECT l_orderkey, l_partkey, 'contains' AS relation, 'L' || l_linenumber AS source_location FROM lineitem WHERE l_orderkey = 1 AND l_partkey = (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = 1))")
def parallel_edges(spark, sf):
    first = table(spark, sf, "lineitem").where("l_orderkey = 1").agg(F.min("l_partkey")).first()[0]
    return H.parallel_edges(star_edges(spark, sf), "order:1", f"part:{first}").select("src", "dst", "relation", F.col("key").cast("long").alias("key"))


# --- labels ------------------------------------------------------------------------------------------------

_WORD = "split_part(p_name, ' ', 1) || p_size % 10"


@query("""WITH t AS (SELECT DISTINCT 'v' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'alpha' ELSE 'x' || (p_partkey % 7) END AS t FROM part), s AS (SELECT t, regexp_extract(t, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$', 1) AS stem, regexp_extract(t, '^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$', 2) AS e FROM t)
SELECT a.t AS a, b.t AS b FROM s a JOIN s b ON a.t < b.t AND a.stem = b.stem AND a.e <> b.e AND a.stem <> '' AND greatest(length(a.t), length(b.t)) < 12""")
def variant_pairs(spark, sf):
    t = _part(spark, sf).select(F.concat(F.lit("v"), F.col("p_size").cast("string"),
        F.when(F.col("p_partkey") % 2 == 0, "alpha").otherwise(F.concat(F.lit("x"), (F.col("p_partkey") % 7).cast("string")))).alias("t")).distinct()
    stem = F.regexp_extract("t", "^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$", 1)
    s = t.withColumn("stem", stem)  # variants share a stem, so that is the join key
    a, b = s.select(F.col("t").alias("a"), "stem"), s.select(F.col("t").alias("b"), "stem")
    return a.join(b, "stem").where("a < b").where(D.variant_pair(F.col("a"), F.col("b"))).select("a", "b")


@query("""WITH t AS (SELECT DISTINCT p_name AS t FROM part), j AS (SELECT x.t AS a, y.t AS b, jaro_winkler_similarity(x.t, y.t) AS jw FROM t x JOIN t y ON x.t < y.t), k AS (SELECT * FROM j WHERE jw >= 0.75 AND jw < 0.92)
SELECT substr(a, 1, 1) || '-' || ((row_number() OVER (PARTITION BY substr(a, 1, 1) ORDER BY a, b) - 1) // 30) AS batch, a, b, round(jw, 6) AS jw FROM k""")
def tie_break_pairs(spark, sf):
    return D.tie_break_pairs(_part(spark, sf).select(F.col("p_name").alias("text"))).withColumn("jw", F.round("jw", 6))


@query("""WITH t AS (SELECT DISTINCT p_name AS t, replace(p_name, ' ', '') AS c FROM part), g AS (SELECT t, list_distinct(list_transform(range(1, greatest(2, length(c) - 1)), lambda i: substr(c, i, 3))) AS g FROM t)
SELECT t AS label, list_transform(range(0, 8), lambda i: list_min(list_transform(g, lambda x: substr(md5(i || ':' || x), 1, 16)))) AS signature FROM g""")
def minhash_signatures(spark, sf):
    return _part(spark, sf).select(F.col("p_name").alias("label")).distinct().select("label", D.minhash(F.col("label"), 8).alias("signature"))


@query("SELECT doc_id, strip_accents(text) AS bare FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL")
def diacritics(spark, sf):
    return table(spark, sf, "documents").where("text is not null and doc_id is not null").select("doc_id", T.strip_marks(F.col("text")).alias("bare"))


@query("SELECT page_id, CASE WHEN contains(substr(path, 2), '/') THEN split_part(path, '/', -2) || '.' ELSE '' END || regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL) WHERE path <> '' AND path NOT LIKE '%//%'")
def file_stems(spark, sf):
    p = table(spark, sf, "pages").where("url is not null").select("page_id",
        F.regexp_extract("url", r"^[a-z]+://[^/?#]*(/[^?#]*)", 1).alias("path")).where("path <> '' and path not like '%//%'")
    return p.select("page_id", T.file_stem(F.col("path")).alias("stem"))


# --- answers -----------------------------------------------------------------------------------------------

_RAW = """CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || '{"nodes": [{"id": "c' || conv_id || '"}], "edges": []}' || chr(10) || '```' WHEN 1 THEN '{"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}]}' WHEN 2 THEN 'sorry, no' ELSE '  ' END"""


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS nodes, CASE turn % 4 WHEN 1 THEN 1 ELSE 0 END AS edges, turn % 4 IN (2, 3) AS hollow FROM conversations")
def answer_parsing(spark, sf):
    i = F.col("turn") % 4
    raw = F.when(i == 0, F.concat(F.lit('```json\n{"nodes": [{"id": "c'), F.col("conv_id").cast("string"), F.lit('"}], "edges": []}\n```'))).when(i == 1,
        '{"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}]}').when(i == 2, "sorry, no").otherwise("  ")
    p = W.parsed(raw)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(p["nodes"]).alias("nodes"), F.size(p["edges"]).alias("edges"), W.hollow(raw).alias("hollow"))


def _stub(items):
    """A backend that answers two items at most, refuses long prompts and always fails on one marked item."""
    if any(t == "fail" for _, t in items):
        raise RuntimeError("backend is down")
    if len(items) > 4:
        raise ValueError("prompt is too long: maximum context reached")
    if len(items) > 2:
        return {"content": '{"nodes": [', "finish_reason": "length", "input_tokens": len(items), "output_tokens": 1}
    return {"content": json.dumps({"nodes": [{"id": p} for p, _ in items], "edges": []}), "finish_reason": "stop", "input_tokens": len(items), "output_tokens": len(items)}


def _asked(spark, sf):
    c = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 8).cast("string").alias("chunk"),
        F.struct(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("path"), F.lit("text").alias("text")).alias("i"))
    return W.ask(c.groupBy("chunk").agg(F.sort_array(F.collect_list("i")).alias("items")), _stub)  # eight items a chunk


@query("SELECT CAST(c_custkey // 8 AS VARCHAR) AS chunk, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id FROM customer")
def answers_after_halving(spark, sf):
    return W.merge_answers(_asked(spark, sf))[0].select("chunk", F.col("item")["id"].alias("id"))


#: Answers and tokens of a chunk of m items under the stub: over four it is refused, over two thrown away.
_COST = {1: (1, 1, 1), 2: (1, 2, 2), 3: (2, 6, 4), 4: (2, 8, 5), 5: (3, 8, 6), 6: (4, 12, 8), 7: (4, 14, 9), 8: (4, 16, 10)}


@query("WITH m AS (SELECT c_custkey // 8 AS chunk, count(*) AS m FROM customer GROUP BY 1) SELECT count(*) AS n_chunks, " + ", ".join(
    f"CAST(sum(CASE m {' '.join(f'WHEN {k} THEN {v[i]}' for k, v in _COST.items())} END) AS BIGINT) AS {name}" for i,
    name in enumerate(("n_answers", "input_tokens", "output_tokens"))) + ", 0 AS n_failed_chunks, 0 AS n_failed_parts, 0 AS n_truncated FROM m")
def answer_accounting(spark, sf):
    return W.accounting(_asked(spark, sf)).drop("cost")


@query("SELECT CAST(count(*) AS BIGINT) AS n_chunks, CAST(count(*) FILTER (n_nationkey % 5 = 0) AS BIGINT) AS n_failed_chunks, round(count(*) FILTER (n_nationkey % 5 <> 0) * 5.0 / 1e6, 6) AS cost FROM nation")
def failed_chunks(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("chunk"),
        F.array(F.struct(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 5 == 0, "fail").otherwise("text").alias("text"))).alias("items"))
    return W.accounting(W.ask(n, _stub), 2.0, 3.0).select("n_chunks", "n_failed_chunks", "cost")


@query("SELECT 'c' || p_partkey AS path, CASE p_partkey % 4 WHEN 1 THEN 'size' WHEN 2 THEN 'json' WHEN 3 THEN 'shape' END AS problem FROM part WHERE p_partkey % 4 <> 0")
def fragment_files(spark, sf):
    i = F.col("p_partkey") % 4
    f = _part(spark, sf).select(F.concat(F.lit("c"), _key()).alias("path"), F.when(i == 1, 1 << 30).otherwise(10).cast("long").alias("size"),
        F.when(i == 2, "{oops").when(i == 3, '{"nodes": {}}').otherwise('{"nodes": [], "edges": []}').alias("text"))
    return W.fragment_problems(f)


@query("SELECT 'c' || p_partkey AS path, p_partkey % 3 AS n FROM part WHERE p_partkey % 3 > 0")
def chunk_files(spark, sf):
    i = F.col("p_partkey") % 3
    raw = _part(spark, sf).select(F.concat(F.lit("c"), _key()).alias("path"),
        F.when(i == 0, "not json").when(i == 1, '{"nodes": [{"id": "a"}]}').otherwise('{"nodes": [{"id": "a"}, {"id": "b"}], "edges": []}').alias("text"))
    return W.good_chunks(raw).select("path", F.size("fragment.nodes").cast("long").alias("n"))


# --- search, impact, changes -------------------------------------------------------------------------------


@query("SELECT id, label FROM nodes WHERE contains(lower(label), 'order 1') OR lower(id) = 'order 1' ORDER BY id LIMIT 1", star=True)
def get_node(spark, sf):
    from weftgraph.api import GraphService
    from weftgraph.model import star_graph

    return GraphService(star_graph(spark, sf)).get_node("order 1").select("id", "label")


@query("SELECT id, label, source_file FROM nodes WHERE community = 3", star=True)
def get_community(spark, sf):
    from weftgraph.api import GraphService
    from weftgraph.model import star_graph

    return GraphService(star_graph(spark, sf)).get_community(3)


@query("SELECT relation, context, count(*) AS n FROM edges WHERE context IN ('call', 'import') GROUP BY 1, 2", star=True)
def context_subgraph(spark, sf):
    return S.in_contexts(star_edges(spark, sf), S.contexts_of("", ["calls", " Imports ", "call"])).groupBy("relation", "context").agg(F.count("*").alias("n"))


@query("""d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id), a AS (SELECT coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0)) - 1 AS k FROM nodes LEFT JOIN d USING (id))
SELECT greatest(50, degree) AS threshold FROM a WHERE k = CAST(floor((SELECT count(*) FROM nodes) * 0.99) AS BIGINT)""", star=True)
def hub_threshold(spark, sf):
    return spark.createDataFrame([(V.hub_threshold(star_nodes(spark, sf), star_edges(spark, sf)),)], "threshold long")


@query("""h AS (SELECT dst AS u, src AS id, relation FROM edges WHERE relation = 'uses' AND dst = 'supplier:1')
SELECT DISTINCT 1 AS depth, h.id, '- ' || label || ' [uses] ' || source_file AS line FROM h JOIN nodes USING (id)""", star=True)
def impact_lines(spark, sf):
    hits = V.affected(star_edges(spark, sf), spark.createDataFrame([("supplier:1",)], "id string"), 2)
    return H.impact_lines(hits, star_nodes(spark, sf))


_ST = "CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'PENDING' ELSE 'SUCCESS' END"


@query("SELECT o_orderkey AS number, 'order ' || o_orderkey AS title, 'clerk' || (o_custkey % 7) AS author, 'main' AS base_branch, o_orderkey % 4 = 0 AS is_draft, CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'PENDING' ELSE 'SUCCESS' END AS ci_status FROM orders")
def change_source(spark, sf):
    o = table(spark, sf, "orders")
    conclusion = F.when(F.col("o_orderstatus") == "F", "FAILURE").when(F.col("o_orderstatus") == "P", "").otherwise("SUCCESS")
    item = F.struct(
        F.col("o_orderkey").alias("number"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.struct(F.concat(F.lit("clerk"), (F.col("o_custkey") % 7).cast("string")).alias("login")).alias("author"),
        F.lit("main").alias("baseRefName"), F.lit("work").alias("headRefName"), (F.col("o_orderkey") % 4 == 0).alias("isDraft"), F.lit("1998-01-01T00:00:00Z").alias("updatedAt"),
        F.lit("").alias("reviewDecision"),
        F.array(F.struct(F.lit("SUCCESS").alias("conclusion"), F.lit("COMPLETED").alias("status")),
        F.struct(conclusion.alias("conclusion"), F.when(conclusion == "", "IN_PROGRESS").otherwise("COMPLETED").alias("status"))).alias("statusCheckRollup"),
    )
    raw = o.select(F.to_json(F.array(item)).alias("text"))
    return H.read_changes(raw, F.lit("main")).select("number", "title", "author", "base_branch", "is_draft", "ci_status")


def _changes(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("number"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit("clerk").alias("author"),
        F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise("main").alias("base_branch"),
        F.lit("main").alias("expected_base"), (F.col("o_orderkey") % 4 == 0).alias("is_draft"), F.to_timestamp(F.lit("1998-12-25")).alias("updated_at"),
        F.lit(None).cast("string").alias("review_decision"),
        F.when(F.col("o_orderstatus") == "F", "FAILURE").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("SUCCESS").alias("ci_status"),
    )


@query(f"""WITH c AS (SELECT o_orderkey AS number, {_ST} AS ci, o_orderkey % 4 = 0 AS draft FROM orders WHERE o_orderkey % 5 <> 0), s AS (SELECT *, CASE WHEN ci = 'FAILURE' THEN 'CI-FAIL' WHEN draft THEN 'DRAFT' WHEN ci = 'PENDING' THEN 'PENDING' ELSE 'READY' END AS status FROM c)
SELECT number, status, '#' || number || ' [' || status || '] CI=' || ci || ' review=none age=7d author=clerk' || chr(10) || '  order ' || number AS line FROM s""")
def list_prs(spark, sf):
    return H.list_changes(_changes(spark, sf), F.to_timestamp(F.lit("1999-01-01"))).select("number", "status", "line")


@query(f"""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'WRONG-BASE' WHEN {_ST} = 'FAILURE' THEN 'CI-FAIL' WHEN o_orderkey % 4 = 0 THEN 'DRAFT' WHEN {_ST} = 'PENDING' THEN 'PENDING' ELSE 'READY' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def pr_dashboard(spark, sf):
    return H.status_counts(_changes(spark, sf), F.to_timestamp(F.lit("1999-01-01")))


@query("SELECT 'x/' || p_partkey || '.py' AS path, 2 AS line, 'seen_pairs' AS name, p_partkey % 3 AS arity FROM part")
def suppression_sites(spark, sf):
    i = F.col("p_partkey") % 3
    text = F.concat(F.lit("import os\n    seen_pairs"), F.when(i == 0, " = set()").when(i == 1, ": set[tuple[str]] = set()").otherwise(": set[tuple[str, str]] = set()"),
        F.lit("\nunseen = 1\n"))
    return H.suppression_sites(_part(spark, sf).select(F.concat(F.lit("x/"), _key(), F.lit(".py")).alias("path"), text.alias("text"))).select("path", "line", "name", "arity")


# --- diagrams and views ------------------------------------------------------------------------------------

_ESCORE = "round(confidence_score + CASE WHEN confidence = 'EXTRACTED' THEN 2.0 ELSE 0.0 END + CASE relation WHEN 'uses' THEN 1.0 WHEN 'contains' THEN -0.2 ELSE 0.0 END, 6)"
_DRAWN = "confidence = 'EXTRACTED' OR (confidence = 'INFERRED' AND confidence_score >= 0.85)"


@query(f"SELECT relation, confidence, count(*) AS n, round(sum({_ESCORE}), 3) AS score FROM edges WHERE {_DRAWN} GROUP BY 1, 2", star=True)
def drawn_edges(spark, sf):
    e = star_edges(spark, sf)
    score = F.round(G.edge_score(F.col("relation"), F.col("confidence"), F.col("confidence_score")), 6)
    return e.where(G.included(F.col("confidence"), F.col("confidence_score"))).groupBy("relation", "confidence").agg(F.count("*").alias("n"),
        F.round(F.sum(score), 3).alias("score"))


@query(f"SELECT relation, count(*) AS n FROM edges WHERE ({_DRAWN}) AND relation = 'uses' GROUP BY 1", star=True)
def preferred_edges(spark, sf):
    return G.preferred(star_edges(spark, sf)).groupBy("relation").agg(F.count("*").alias("n"))


@query("""o AS (SELECT src AS id, count(*) AS n_out FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n_in FROM edges GROUP BY 1)
SELECT id, CAST(n_out - coalesce(n_in, 0) AS BIGINT) AS net, CAST(n_out AS BIGINT) AS n_out FROM o LEFT JOIN i USING (id) ORDER BY net DESC, n_out DESC, id LIMIT 15""", star=True)
def entry_points(spark, sf):
    return G.entry_points(star_edges(spark, sf), 15)


@query("""l AS (SELECT source_file, id, label, row_number() OVER (PARTITION BY source_file ORDER BY starts_with(label, '_'), lower(label), id) AS pos, count(*) OVER (PARTITION BY source_file) AS n FROM nodes)
SELECT source_file, CAST(pos AS INTEGER) AS pos, label AS name FROM l WHERE pos <= 100 UNION ALL SELECT DISTINCT source_file, 101, '(+' || (n - 100) || ' more)' FROM l WHERE n > 100""", star=True)
def tree_leaves(spark, sf):
    return G.tree_leaves(star_nodes(spark, sf), 100).select("source_file", F.col("at").cast("int").alias("pos"), "name")


_SECTION = "split_part(source_file, '/', 1)"


@query(f"""w AS (SELECT {_SECTION} AS section, unnest(string_split_regex(lower(regexp_replace(label || ' ' || source_file, '[/_-]', ' ', 'g')), '\\s+')) AS raw FROM nodes), c AS (SELECT section, regexp_replace(raw, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS word FROM w),
n AS (SELECT section, word, count(*) AS n FROM c WHERE length(word) >= 3 AND word NOT IN ({', '.join(f"'{x}'" for x in G.STOPWORDS)}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, word) AS rank FROM n)
SELECT section, CAST(rank AS INTEGER) AS rank, word, n FROM r WHERE rank <= 5""", star=True)
def section_keywords(spark, sf):
    n = star_nodes(spark, sf)
    return G.section_keywords(n, n.select("id", F.split_part("source_file", F.lit("/"), F.lit(1)).alias("section"))).select("section", F.col("rank").cast("int").alias("rank"),
        "word", "n")


def _summary(spark, sf):
    n = star_nodes(spark, sf)
    return A.section_summary(star_edges(spark, sf), n.select("id", F.split_part("source_file", F.lit("/"), F.lit(1)).alias("section"))), n


@query(f"""s AS (SELECT id, {_SECTION} AS section FROM nodes), z AS (SELECT section, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.section AS a, b.section AS b, relation, count(*) AS n FROM edges JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE a.section <> b.section GROUP BY 1, 2, 3),
q AS (SELECT a, b, sum(n) AS n, arg_max(relation, ROW(n, relation)) AS r FROM p GROUP BY 1, 2)
SELECT 1 AS part, '    s_' || section || '("' || section || '<br/><small>' || n || ' nodes</small>")' AS line FROM z
UNION ALL SELECT 2, '    s_' || a || ' -->|' || replace(r, '_', ' ') || CASE WHEN n > 1 THEN ' x' || CAST(n AS BIGINT) ELSE '' END || '| s_' || b FROM q""", star=True)
def section_overview(spark, sf):
    summary, n = _summary(spark, sf)
    sizes = n.groupBy(F.split_part("source_file", F.lit("/"), F.lit(1)).alias("section")).agg(F.count("*").alias("n"))
    return G.overview_lines(summary, sizes).select("part", "line")


@query()
def flow_chain(spark, sf):
    """A greedy walk: its rule is tested on literal rows."""
    summary, _ = _summary(spark, sf)
    chain = G.flow_chain(summary.where("kind = 'inter'"), ["geo", "goods", "party", "trade"])
    return spark.createDataFrame(list(enumerate(chain)), "at int, section string")


@query("SELECT kind, count(*) AS n, count(DISTINCT json_extract_string(json, '$.' || CASE WHEN kind = 'node' THEN 'id' ELSE 'source' END)) AS keys FROM (SELECT 'node' AS kind, '{\"id\": \"' || id || '\"}' AS json FROM nodes UNION ALL SELECT 'link', '{\"source\": \"' || src || '\"}' FROM edges) GROUP BY 1", star=True)
def node_link_rows(spark, sf):
    r = writers.node_link_rows(star_nodes(spark, sf), star_edges(spark, sf))
    key = F.when(F.col("kind") == "node", F.get_json_object("json", "$.id")).otherwise(F.get_json_object("json", "$.source"))
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


_NOTE = r"""trim(regexp_replace(label, '[\\/*?:"<>|#^\[\]]', '', 'g'))"""


@query(f"""nm AS (SELECT id, CASE WHEN k = 0 THEN b ELSE b || '_' || k END AS name FROM (SELECT id, b, row_number() OVER (PARTITION BY lower(b) ORDER BY id) - 1 AS k FROM (SELECT id, {_NOTE} AS b FROM nodes))), v AS (SELECT src AS id, dst AS other, relation, confidence FROM edges UNION SELECT dst, src, relation, confidence FROM edges),
k AS (SELECT v.*, nm.name AS o, row_number() OVER (PARTITION BY v.id ORDER BY relation, nm.name, other, confidence) AS k, count(*) OVER (PARTITION BY v.id) AS n FROM v JOIN nm ON nm.id = v.other),
b AS (SELECT id, any_value(n) AS n, string_agg('- [[' || o || ']] - `' || relation || '` [' || confidence || ']', chr(10) ORDER BY k) AS body FROM k WHERE k <= 50 GROUP BY id)
SELECT nm.name, '---' || chr(10) || 'source_file: "' || source_file || '"' || chr(10) || 'type: "' || file_type || '"' || chr(10) || 'community: ' || coalesce(CAST(community AS VARCHAR), 'null') || chr(10) || '---' || chr(10) || chr(10) || '# ' || label
|| CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || '## Connections' || chr(10) || chr(10) || body || CASE WHEN n > 50 THEN chr(10) || '- and ' || (n - 50) || ' more' ELSE '' END END || chr(10) AS text FROM nodes JOIN nm USING (id) LEFT JOIN b USING (id)""", star=True)
def vault_notes(spark, sf):
    return P.vault_notes(star_nodes(spark, sf), star_edges(spark, sf))


@query("""SELECT conv_id, turn, '---' || chr(10) || 'type: "query"' || chr(10) || 'date: "2020-01-02T03:04:05"' || chr(10) || 'question: "q' || conv_id || '"' || chr(10) || 'source_nodes: ["n' || turn || '"]' || chr(10) || '---' || chr(10) || chr(10) || '# Q: q' || conv_id || chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Source Nodes' || chr(10) || chr(10) || '- n' || turn AS text,
'query_20200102_030405_q' || conv_id || '.md' AS name FROM conversations WHERE text IS NOT NULL""")
def memory_notes(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null")
    note = P.memory_note(F.concat(F.lit("q"), F.col("conv_id").cast("string")), F.col("text"), F.to_timestamp(F.lit("2020-01-02 03:04:05")), F.lit("query"),
        F.array(F.concat(F.lit("n"), F.col("turn").cast("string"))))
    return c.select("conv_id", "turn", note["text"].alias("text"), note["name"].alias("name"))


@query("""p AS (SELECT src, dst, count(*) AS n FROM edges GROUP BY 1, 2) SELECT line FROM (SELECT unnest(['raw: ' || (SELECT count(*) FROM edges), 'missing: 0', 'dangling: 0', 'directed_pairs: ' || count(*), 'collapsed: ' || CAST(sum(n - 1) AS BIGINT)]) AS line FROM p)""", star=True)
def diagnostic_report(spark, sf):
    lines = P.diagnostic_lines(A.diagnostics(star_edges(spark, sf), star_nodes(spark, sf)))
    return lines.where(F.col("line").rlike("^(raw|missing|dangling|directed_pairs|collapsed):")).select("line")


# --- feeds and state ---------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id % 8 IN (1, 6)")
def event_filter(spark, sf):
    e = _doc_files(spark, sf).withColumn("path", F.when(F.col("doc_id") % 8 == 7, F.concat(F.lit("out/"), "path")).when(F.col("doc_id") % 8 == 3,
        F.concat(F.lit(".git/"), "path")).otherwise(F.col("path")))
    return feeds.wanted(e, [".md", ".txt"]).select("doc_id")


@query("SELECT source AS root, CAST(count(*) FILTER (doc_id % 8 IN (0, 2)) AS BIGINT) AS n_code, CAST(count(*) FILTER (doc_id % 8 IN (1, 3, 5, 6, 7)) AS BIGINT) AS n_other, count(*) FILTER (doc_id % 8 IN (0, 2)) > 0 AS rebuild, count(*) FILTER (doc_id % 8 IN (1, 3, 5, 6, 7)) > 0 AS needs_update FROM documents GROUP BY 1")
def needs_update(spark, sf):
    return state.needs_update(_doc_files(spark, sf).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root"), "path"))


@query("SELECT true AS same_rows, false AS other_rows, true AS shrinks")
def no_op_detection(spark, sf):
    n, e = star_nodes(spark, sf), star_edges(spark, sf)
    turned = (n.repartition(3, "label"), e.repartition(5, "dst"))
    fewer = e.where("relation <> 'part_of'")
    shrinks = B.shrinks(n.count(), n.where("id not like 'region:%'").count())
    return spark.createDataFrame([(state.same_topology((n, e), turned), state.same_topology((n, e), (n, fewer)), bool(shrinks))],
        "same_rows boolean, other_rows boolean, shrinks boolean")


@query("SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}' AS json FROM nation")
def canonical_json(spark, sf):
    return state.canonical_rows(table(spark, sf, "nation").select("n_nationkey", "n_name"))


@query("SELECT DISTINCT sha256(text) AS key FROM documents WHERE text IS NOT NULL")
def cache_listing(spark, sf):
    return C.cached_files(table(spark, sf, "documents").select(F.sha2("text", 256).alias("key")))


@query("SELECT CASE WHEN max(p_partkey) > 1 THEN 'repo/src' ELSE 'repo/src/p1' END AS root FROM part")
def common_root(spark, sf):
    return spark.createDataFrame([(C.common_root(_part(spark, sf).select(F.concat(F.lit("repo/src/p"), _key(), F.lit("/a.py")).alias("path"))),)], "root string")


# --- service -----------------------------------------------------------------------------------------------


def _service(spark, sf):
    from weftgraph.api import GraphService
    from weftgraph.model import star_graph

    return GraphService(star_graph(spark, sf))


@query("""near AS (SELECT 'customer:1' AS id UNION SELECT dst FROM edges WHERE src = 'customer:1' UNION SELECT src FROM edges WHERE dst = 'customer:1')
SELECT 'NODE ' || label || ' [src=' || source_file || ' community=' || coalesce(CAST(community AS VARCHAR), '') || ']' AS line FROM nodes JOIN near USING (id)
UNION ALL SELECT 'EDGE ' || src || ' --' || relation || ' [' || confidence || ']--> ' || dst FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""", star=True)
def query_graph(spark, sf):
    """A question that names one customer, one step around it."""
    text = _service(spark, sf).query_graph("Customer#000000001", depth=1, token_budget=1_000_000)
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@query(f"""c AS (SELECT o_orderkey AS number, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE 'main' END AS base, o_orderkey % 3 AS m, CASE WHEN o_orderkey % 5 = 0 THEN 'WRONG-BASE' WHEN {_ST} = 'FAILURE' THEN 'CI-FAIL'
WHEN o_orderkey % 4 = 0 THEN 'DRAFT' WHEN {_ST} = 'PENDING' THEN 'PENDING' ELSE 'READY' END AS status FROM orders),
i AS (SELECT CASE source_file WHEN 'geo/region.tbl' THEN 0 ELSE 1 END AS m, count(DISTINCT community) AS n FROM nodes WHERE source_file IN ('geo/region.tbl', 'geo/nation.tbl') GROUP BY 1),
r AS (SELECT number, status, row_number() OVER (PARTITION BY base ORDER BY list_position([{', '.join(f"'{x}'" for x in H.STATUS_ORDER)}], status), coalesce(n, 0) DESC, number) AS rank FROM c LEFT JOIN i USING (m))
SELECT number, status, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50""", star=True)
def triage_prs(spark, sf):
    c = _changes(spark, sf)
    m = F.col("number") % 3
    files = c.where(m < 2).select("number", F.when(m == 0, "geo/region.tbl").otherwise("geo/nation.tbl").alias("path"))
    return _service(spark, sf).triage(c, files, F.to_timestamp(F.lit("1999-01-01"))).select("number", "status", F.col("rank").cast("int").alias("rank"))


@query(f"{SURPRISE_SQL}, k AS (SELECT DISTINCT src, dst, relation, surprise FROM s ORDER BY surprise DESC, src, dst, relation LIMIT 20) SELECT src, dst, relation, CAST(row_number() OVER (ORDER BY surprise DESC, src, dst, relation) AS INTEGER) AS rank FROM k", star=True)
def surprising_connections(spark, sf):
    from weftgraph.api import surprising

    return surprising(star_nodes(spark, sf), star_edges(spark, sf), 20).withColumn("rank", F.col("rank").cast("int"))


@query("""d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id), n AS (SELECT id, label, source_file, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d USING (id))
SELECT label = split_part(source_file, '/', -1) OR (starts_with(label, '.') AND ends_with(label, '()')) OR (ends_with(label, '()') AND degree <= 1) AS file_node, false AS concept_node, false AS json_key, count(*) AS n FROM n GROUP BY 1""", star=True)
def node_predicates(spark, sf):
    d = A.with_degree(star_nodes(spark, sf), star_edges(spark, sf))
    told = [A.is_file_node(F.col("label"), F.col("source_file"), F.col("degree")), A.is_concept_node(F.col("source_file")), A.is_json_key(F.col("label"), F.col("source_file"))]
    return d.groupBy(*(c.alias(n) for c, n in zip(told, ("file_node", "concept_node", "json_key"), strict=True))).agg(F.count("*").alias("n"))
