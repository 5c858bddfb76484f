"""Sources, walkers, readers and resolution on literal inputs: the cases that queries over tables do not reach."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import answers, dedup
from weftgraph.operators import build as B
from weftgraph.operators import resolution as R
from weftgraph.operators import search as S
from weftgraph.operators import traverse as V
from weftgraph.sources import extractors as X
from weftgraph.sources import facts, languages, office, selection


def edges_of(path, text):
    f = X.extractor_of(path)(path, text)
    label = {r["id"]: r["label"] for r in f.rows if r["kind"] == "node"}
    return [(r["relation"], label.get(r["src"], r["src"]), label.get(r["dst"], r["dst"])) for r in f.rows if r["kind"] == "edge"]


@pytest.mark.parametrize("suffix", sorted(X.EXTRACTORS))
@pytest.mark.parametrize("text", ["", "\n\n", "}}}})))", "{{{{((((", '"unclosed', "/* open", "é🙂 class", "\x00\x01", "class A {" * 200, "(" * 2000])
def test_no_extractor_breaks_on_junk(suffix, text):
    if suffix in (".py", ".json"):
        try:
            X.EXTRACTORS[suffix](f"a/b{suffix}", text)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            pass  # becomes an error row
        return
    f = X.EXTRACTORS[suffix](f"a/b{suffix}", text)
    assert f.rows[0]["label"] == f"b{suffix}"


def test_long_files_take_time_in_proportion():
    import time

    text = "".join(f"int f{i}(int a) {{\n  return f{i + 1}(a); // {i}\n}}\n" for i in range(4000))
    began = time.time()
    got = edges_of("a/long.c", text)
    assert time.time() - began < 20
    assert sum(r[0] == "calls" for r in got) == 3999 and sum(r[0] == "contains" for r in got) == 4000


def test_strings_and_comments_define_nothing():
    got = edges_of("a/x.ts", "const s = 'class Fake { go() {} }';\n/* function ghost() {} */\nfunction real() { return `function no() {}`; }\n")
    assert got == [("contains", "x.ts", "real()")]
    assert edges_of("a/x.rb", "# def ghost\ndef real(a)\n  'class Fake'\nend\n") == [("contains", "x.rb", "real()")]


def test_lines_and_raw_calls():
    f = X.extractor_of("p/q.go")("p/q.go", "package p\n\nfunc A() {\n\tother(1)\n\tx.Member(2)\n}\n")
    raw = [(r["dst"], r["source_location"], r["is_member_call"]) for r in f.rows if r["kind"] == "raw_call"]
    assert raw == [("other", "L4", False), ("Member", "L5", True)]
    assert [r["source_location"] for r in f.rows if r["kind"] == "node"] == ["L1", "L3"]


def test_brackets_and_lines():
    assert languages.brackets("a{b(c)}d") == {1: 7, 3: 6} and languages.brackets("{(") == {0: 2, 1: 2} and languages.brackets("})") == {}
    lines = languages.Lines("a\nb\n\nc")
    assert [lines.at(i) for i in (0, 1, 2, 4, 5)] == [1, 1, 2, 3, 4]


def test_unknown_names_become_stubs_that_can_be_rewired(spark):
    files = spark.createDataFrame([("a/x.java", "class X extends Base {\n}\n"), ("b/y.java", "class Base {\n}\n")], "path string, text string")
    rows = X.extract(files)
    nodes = rows.where("kind = 'node'").select("id", "label", "source_file")
    out, edges = R.rewire_stubs(nodes, rows.where("kind = 'edge'").select("src", "dst", "relation"))
    base = [r.id for r in out.where("label = 'Base'").collect()]
    assert len(base) == 1 and edges.where("relation = 'inherits'").first().dst == base[0]


def test_facts_of_broken_files_are_left_out(spark):
    files = spark.createDataFrame([("a.py", "def ("), ("b.py", "x = y\n"), ("c.txt", "import x"), (None, "a = b"), ("d.ts", None)], "path string, text string")
    assert [(r.source_file, r.fact, r.local, r.name) for r in facts.symbol_facts(files).collect()] == [("b.py", "alias", "x", "y")]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files_that_cannot_be_read(monkeypatch):
    assert office.docx_markdown(b"") == "" == office.xlsx_markdown(b"PK\x03\x04") and office.xlsx_structure("a.xlsx", b"") == []
    bomb = zipped({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'})
    assert office.docx_markdown(bomb) == ""
    monkeypatch.setattr(office, "MAX_UNPACKED", 100)
    assert office.docx_markdown(zipped({"word/document.xml": "x" * 1000})) == ""


def test_include_list_and_reach(spark):
    files = spark.createDataFrame([("a/b/c.md",), ("a/x.py",), ("top.md",), ("",)], "path string")
    assert [r.included for r in selection.included(files, []).collect()] == [False] * 4
    assert [r.included for r in selection.included(files, ["/a/b", "# no"]).collect()] == [True, False, False, False]
    assert [r.included for r in selection.included(files, ["*.md"]).collect()] == [True, False, True, False]
    dirs = spark.createDataFrame([("",), ("a",), ("a/b",), ("z",)], "path string")
    assert [r.reachable for r in selection.may_hold_included(dirs, ["a/b/c.md"]).collect()] == [True, True, True, False]


def test_links_are_followed_once(tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "a.py").write_text("x")
    (tmp_path / "root" / "b.py").write_text("y")
    assert not selection.follows_links(str(tmp_path / "root")) and not selection.follows_links(str(tmp_path / "none"))
    os.symlink(tmp_path / "far", tmp_path / "root" / "link")
    os.symlink(tmp_path / "root", tmp_path / "far" / "back")
    assert selection.follows_links(str(tmp_path / "root"))
    assert selection.walk_links(str(tmp_path / "root")) == ["b.py", "link/a.py"]
    assert selection.walk_links(str(tmp_path / "root"), follow=False) == ["b.py"]


def test_answers_backends_and_errors(spark):
    answers.register_backend("stub", lambda items: {"content": None} if len(items) > 1 else {"content": '{"nodes": [{"id": "%s"}]}' % items[0][0]})
    chunks = spark.createDataFrame([("c", [("a", "1"), ("b", "2"), ("c", "3")]), ("empty", [])], "chunk string, items array<struct<path:string,text:string>>")
    got = answers.ask(chunks, "stub", parallel=2)
    assert sorted((r.part, r.n_items) for r in got.collect()) == [("0", 1), ("10", 1), ("11", 1)]
    assert [r.content for r in answers.ask(chunks, "stub", max_depth=0).collect()] == [None]
    assert answers.too_long("Prompt is TOO LONG: maximum context") and not answers.too_long("quota")
    raw = spark.createDataFrame([("```json\n{\"edges\": [{\"a\": \"b\"}]}\n```",), (None,), ("[1]",), ("{\"nodes\": []}",)], "raw string")
    assert [r.h for r in raw.select(answers.hollow(F.col("raw")).alias("h")).collect()] == [False, True, True, True]


def test_duplicates_of_an_id_leave_the_least_row(spark):
    rows = [("a", "Zebra", "f1"), ("a", "Apple", "f2"), ("b", None, "f"), ("b", "Bee", "f")]
    df = spark.createDataFrame(rows, "id string, label string, source_file string")
    for n in (1, 5):
        assert sorted(B.least_rows(df.repartition(n), "id").collect()) == [("a", "Apple", "f2"), ("b", None, "f")]


def test_boost_guard_and_tiny_tables(spark):
    labels = ["configuration manager", "configuration menagerie"]
    jw = dedup.jaro_winkler(*labels)
    assert jw < dedup.JW <= jw + dedup.BOOST or jw >= dedup.JW
    a, b = "distributed query planner", "distributed quarry plan"
    t = spark.createDataFrame([(a,), (b,)], "text string")
    own = spark.createDataFrame([(a, 1), (b, 1)], "text string, community int")
    apart = spark.createDataFrame([(a, 1), (b, 2)], "text string, community int")
    near, far, plain = (dedup.similar_labels(t, x).count() for x in (own, apart, None))
    assert near >= far == plain
    nodes = spark.createDataFrame([("a", "x", "f", "r1"), ("b", "y", "f", "r2")], "id string, label string, source_file string, repo string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    with pytest.raises(ValueError, match="several repositories"):
        dedup.deduplicate(nodes, edges, F.col("label"))
    one = nodes.where("id = 'a'")
    assert dedup.deduplicate(one, edges, F.col("label")) == (one, edges)


def test_dfs_keeps_lonely_seeds_and_does_not_expand_hubs(spark):
    rows = [("s", "hub"), *(("hub", f"x{i}") for i in range(6))]
    e = spark.createDataFrame(rows, "src string, dst string")
    assert [(r.id, r.depth) for r in V.dfs(e, ["alone"], 3).orderBy("ord").collect()] == [("alone", 0)]
    assert [r.id for r in V.dfs(e, ["s", "alone"], 3, hub=5).orderBy("ord").collect()] == ["s", "hub", "alone"]
    assert V.dfs(e, ["hub"], 1, hub=5).count() == 8  # a seed is expanded
    assert [r.id for r in V.dfs(e, ["s"], 2).orderBy("ord").limit(3).collect()] == ["s", "hub", "x0"]


def test_context_hints_are_whole_tokens(spark):
    assert S.contexts_of("who imports this?") == ["import"] and S.contexts_of("imports: yes") == []
    assert S.contexts_of("cálls, members") == ["call", "field"]
    q = spark.createDataFrame([("who imports this?",), ("imports: yes",), ("cálls, members",), (None,)], "q string")
    assert [r.c for r in q.select(S.hinted_contexts(F.col("q")).alias("c")).collect()][:3] == [["import"], [], ["call", "field"]]


def test_module_paths_and_joined_paths(spark):
    p = spark.createDataFrame([("a/b", "../c.ts"), ("", "./x"), ("a", "/abs/./y"), ("a", "../../z")], "f string, r string")
    assert [r.j for r in p.select(R.joined_path(F.col("f"), F.col("r")).alias("j")).collect()] == ["a/c.ts", "x", "/abs/y", "../z"]
    bad = spark.createDataFrame([("a", "b", "nonsense", "f", "L1")], "src string, dst string, context string, source_file string, source_location string")
    with pytest.raises(Exception, match="unknown reference context"):
        R.reference_edges(bad).collect()
