"""The stages against plain twins on the smallest tables."""

import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from tests.llm.test_native_operators import PII, plain_spans, quality_of
from tests.llm.test_ngram_join import brute
from weftgraph.llm import byte_bpe, decontaminate


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, f) in enumerate(P.STAGES):
        f(spark, docs, sf).write.parquet(str(root / str(i)))
        nxt = spark.read.parquet(str(root / str(i)))
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in nxt.collect()]))
        if i < len(P.STAGES) - 1:
            assert nxt.columns == docs.columns
        docs = nxt
    return out


def test_quality_rejects_what_fails_and_keeps_texts(stages):
    before, after = stages[0]
    kept = {r["doc_id"]: r for r in after}
    assert len(kept) == len(after) and all(kept[r["doc_id"]] == r for r in before if r["doc_id"] in kept)
    failed = {r["doc_id"] for r in before if quality_of(r["text"])[-1]}
    assert failed and not failed & set(kept)
    gone = [r for r in before if r["doc_id"] not in kept and r["doc_id"] not in failed]
    junk = [r for r in gone if sum(c in "#*$%&|<>" for c in r["text"]) > 0.1 * len(r["text"].split())]
    assert len(junk) > 0.8 * len(gone)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    want = {d for d, _, least in brute([(r["doc_id"], r["text"]) for r in before], 5, 80) if d == least}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want) < len(before)


def without(text, items, window=13):
    """The text without the characters from the first to the last word of every run of hit words."""
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    split = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
    doc, spans = [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) for m in words], set()
    for t in items:
        w = split(t or "")
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        spans |= {(i, i + n) for i in range(len(doc) - n + 1 if n else 0) if tuple(doc[i : i + n]) in wins}
    runs = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : words[a].start()])
        at = words[b - 1].end()
    return "".join([*out, text[at:]])


def test_contaminated_documents_go_and_spans_are_cut(spark, sf, stages):
    before, after = stages[2]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want, cut = {}, 0
    for r in before:
        n, hit, _ = decontaminate.brute_hits(r["text"], items)
        if not (hit and 20 * hit >= n):
            want[r["doc_id"]] = without(r["text"], [t for _, t in items]) if hit else r["text"]
            cut += bool(hit)
    assert {r["doc_id"]: r["text"] for r in after} == want and len(after) == len(want) < len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_a_span_under_the_limit_is_cut(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    text = " ".join(f"Word{i}," for i in range(400)) + "\nSee: " + item.title() + "! End."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, item, "en", "s", 9), (3, "clean text", None, None, 10)],
        "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.decontamination(spark, docs, str(tmp_path)).collect()}
    left = without(text, [item])
    assert got == {1: (left, len(left)), 3: ("clean text", 10)} and left.endswith("See: ! End.")


def test_personal_data_is_masked(stages):
    before, after = stages[3]
    text = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for r in before:
        got = text[r["doc_id"]]
        assert got["n_chars"] == len(got["text"])
        assert not plain_spans(got["text"], PII)
        if plain_spans(r["text"], PII):
            assert "<PII>" in got["text"]
    assert sum(text[r["doc_id"]]["text"] == r["text"] for r in before) > 0.7 * len(before)


def test_tokens_are_those_of_the_library(stages):
    before, after = stages[4]
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["token_ids"] for r in after}
    assert len(got) == len(before) and all(got[r["doc_id"]] == lib.encode_ordinary(r["text"]) for r in before)


def test_run_applies_all_stages(spark, sf, stages):
    out = {r.doc_id: (r.n_tokens, r.token_ids) for r in P.run(spark, sf).collect()}
    assert out == {r["doc_id"]: (r["n_tokens"], r["token_ids"]) for r in stages[-1][1]}
