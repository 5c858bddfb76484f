"""Queries over documents, pages, events and conversations, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.model import table
from weftgraph.operators import resolution as R
from weftgraph.operators import search as S
from weftgraph.operators.centrality import edge_betweenness, node_betweenness
from weftgraph.plans.language_queries import told
from weftgraph.sources import corpus as C
from weftgraph.sources import extractors as X
from weftgraph.streaming import feeds

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


_WS = r"[\t\n\x0b\f\r ]"


@query(rf"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.word_count(F.col("text")).alias("n_words"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


_SIG = " + ".join(f"CAST(regexp_matches(substr(text, 1, 3000), '{p.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for p in C.PAPER_SIGNALS)


@query(f"SELECT doc_id, {_SIG} AS signals FROM documents")
def paper_signals(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.paper_signals(F.col("text")).alias("signals"))


_URL_PATH = r"regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


@query(f"SELECT page_id, {_URL_PATH} AS path, CASE WHEN regexp_extract({_URL_PATH}, '[^/]+(\\.[^./]+)$', 1) = '.html' THEN 'document' END AS file_type FROM pages")
def classify_file(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))
    return p.select("page_id", "path", F.when(F.substring_index("path", "/", -1).contains("."), C.classify(F.col("path"))).alias("file_type"))


_P = "(p_name || '/' || CASE WHEN p_size % 5 = 0 THEN 'secrets/a.txt' WHEN p_size % 5 = 1 THEN 'api_token.txt' WHEN p_size % 5 = 2 THEN 'tokenizer.py' WHEN p_size % 5 = 3 THEN '.env.local' ELSE 'key.pem' END)"


def _paths(spark, sf):
    tail = F.when(F.col("p_size") % 5 == 0, "secrets/a.txt").when(F.col("p_size") % 5 == 1, "api_token.txt").when(F.col("p_size") % 5 == 2,
        "tokenizer.py").when(F.col("p_size") % 5 == 3, ".env.local").otherwise("key.pem")
    return table(spark, sf, "part").select("p_partkey", "p_size", F.concat_ws("/", "p_name", tail).alias("path"))


@query(f"SELECT p_partkey, {_P} AS path, p_size % 5 <> 2 AS sensitive FROM part")
def sensitive_filter(spark, sf):
    return _paths(spark, sf).select("p_partkey", "path", C.is_sensitive(F.col("path")).alias("sensitive"))


@query(f"SELECT p_partkey, {_P} AS path, p_size % 5 IN (0, 1) OR p_size % 5 = 4 AS ignored FROM part")
def ignore_rules(spark, sf):
    return C.ignored(_paths(spark, sf).select("p_partkey", "path"), ["# comment", "*.txt", "*.pem", "!.env.local", "node_modules/"])


@query(r"SELECT page_id, CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'arxiv.org') THEN 'arxiv' WHEN contains(lower(url), 'github.com') THEN 'github' WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN ends_with(lower(split_part(split_part(url, '?', 1), '#', 1)), '.pdf') THEN 'pdf' WHEN regexp_matches(lower(split_part(split_part(url, '?', 1), '#', 1)), '\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END AS kind FROM pages")
def url_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_kind(F.col("url")).alias("kind"))


@query(rf"SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g')), 1, 8000) AS body FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query(rf"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_WS}+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("""SELECT page_id, h AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages) GROUP BY 1, 2""")
def page_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[\\t\\n\\x0b\\f\\r ]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[a-z]{1,2}')) AS terms FROM conversations""")
def query_terms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.terms_column(F.col("text")).alias("terms"))


_HINT = ", ".join("CASE WHEN len(list_intersect(w, [" + ", ".join(f"'{x}'" for x in h) + f"])) > 0 THEN '{c}' END" for c, h in S.CONTEXT_HINTS.items())


@query(f"SELECT conv_id, turn, list_filter([{_HINT}], lambda x: x IS NOT NULL) AS contexts FROM (SELECT *, regexp_split_to_array(lower(strip_accents(text)), '[\\s?,]+') AS w FROM conversations)")
def context_filter_infer(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.hinted_contexts(F.col("text")).alias("contexts"))


_SNAP = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS hash, doc_id % 3 AS mtime FROM documents WHERE doc_id % 11 <> 0"


@query(f"""WITH o AS ({_SNAP}), n AS (SELECT doc_id, md5(text) AS hash, doc_id % 4 AS mtime FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(CAST(o.doc_id AS VARCHAR), CAST(n.doc_id AS VARCHAR)) AS path, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.mtime = n.mtime OR o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id)""")
def manifest_diff(spark, sf):
    d = table(spark, sf, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    old = d.where("doc_id % 11 <> 0").select(path, F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("hash"),
        (F.col("doc_id") % 3).alias("mtime"))
    new = d.where("doc_id % 13 <> 0").select(path, F.md5("text").alias("hash"), (F.col("doc_id") % 4).alias("mtime"))
    return C.manifest_diff(old, new)


@query("SELECT lang, count(*) FILTER (h IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)) AS hits, count(*) FILTER (h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)) AS misses FROM (SELECT lang, sha256(text) AS h FROM documents) GROUP BY 1")
def cache_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    hits, misses = C.cache_split(d, d.where("doc_id % 2 = 0"))
    both = hits.select("lang", F.lit(1).alias("hit")).union(misses.select("lang", F.lit(0)))
    return both.groupBy("lang").agg(F.count_if(F.col("hit") == 1).alias("hits"), F.count_if(F.col("hit") == 0).alias("misses"))


@query("""WITH RECURSIVE t AS (SELECT source AS dir, doc_id AS path, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f(dir, r, used, chunk) AS (SELECT dir, 1, tokens, 0 FROM t WHERE r = 1 UNION ALL SELECT t.dir, t.r, CASE WHEN f.used + t.tokens > 20000 THEN t.tokens ELSE f.used + t.tokens END, CASE WHEN f.used + t.tokens > 20000 THEN chunk + 1 ELSE chunk END FROM f JOIN t ON t.dir = f.dir AND t.r = f.r + 1)
SELECT dir, path, CAST(tokens AS BIGINT) AS tokens, CAST(chunk AS BIGINT) AS chunk FROM f JOIN t USING (dir, r)""")
def token_pack(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("dir"), F.col("doc_id").alias("path"), T.tokens_of(F.length("text")).alias("tokens"))
    return C.pack(d, 20_000)


@query("WITH q AS (SELECT conv_id, sum(greatest(1, length(text) // 4)) AS t FROM conversations GROUP BY 1), c AS (SELECT sum(n_words) * 100 // 75 AS naive FROM (SELECT len(list_filter(regexp_split_to_array(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda w: w <> '')) AS n_words FROM documents)) SELECT CAST(naive AS BIGINT) AS naive_tokens, round(avg(t), 3) AS mean_query_tokens, round(avg(naive / t), 3) AS reduction FROM q, c GROUP BY naive")
def token_reduction(spark, sf):
    q = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(T.tokens_of(F.length("text"))).alias("t"))
    c = table(spark, sf, "documents").agg(F.floor(F.sum(C.word_count(F.col("text"))) * 100 / 75).alias("naive_tokens"))
    return q.join(F.broadcast(c)).groupBy("naive_tokens").agg(F.round(F.avg("t"), 3).alias("mean_query_tokens"), F.round(F.avg(F.col("naive_tokens") / F.col("t")), 3).alias("reduction"))  # c: one row


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n_events, list_sort(list_distinct(list(event_type))) AS paths FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.col("event_type").alias("path"))
    return feeds.debounced(e, "6 hours", "user_id")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY 1, 2")
def dedup_within_watermark(spark, sf):
    return feeds.dedup_events(table(spark, sf, "events"), ["user_id", "event_type", "ts"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT source AS source_file, doc_id AS id FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') AND doc_id % 2 = 0 UNION ALL SELECT source, doc_id FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 3 = 0")
def incremental_merge(spark, sf):
    from weftgraph.operators.build import merge_incremental

    d = table(spark, sf, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("id"))
    gone = spark.createDataFrame([("src3",)], "source_file string")
    return merge_incremental(d.where("id % 2 = 0"), d.where("source_file in ('src1', 'src2') and id % 3 = 0"), gone)


#: Names of parts repeat; with the key they are unique, so whole tables take part.
_CALLS = """n AS (SELECT 'part:' || p_partkey AS id, lower(p_name || ' ' || p_partkey) AS key FROM part), u AS (SELECT key, min(id) AS id FROM n GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT 'part:' || l_suppkey AS src, lower(p_name || ' ' || p_partkey) AS key, 'f' || l_linenumber AS f FROM lineitem JOIN part ON p_partkey = l_partkey),
h AS (SELECT src, u.id AS dst, min(f) AS f FROM c JOIN u USING (key) WHERE src <> u.id GROUP BY 1, 2)"""


def _calls(spark, sf):
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), name.alias("label"), F.lit("code").alias("file_type"))
    li = table(spark, sf, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey"))
    raw = li.select(F.concat(F.lit("part:"), F.col("l_suppkey").cast("string")).alias("caller"), F.col("label").alias("callee"), F.lit(False).alias("is_member_call"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("source_file"))
    held = spark.createDataFrame([("part:1", "part:2", "contains")], "src string, dst string, relation string")
    return raw, p.drop("p_partkey"), held


@query(f"WITH {_CALLS} SELECT src, dst, 'calls' AS relation, 'INFERRED' AS confidence, CAST(0.8 AS DOUBLE) AS confidence_score FROM h WHERE NOT (src = 'part:1' AND dst = 'part:2')")
def raw_call_resolution(spark, sf):
    return R.resolve_calls(*_calls(spark, sf))


@query(f"WITH {_CALLS} SELECT src, dst, 'calls' AS relation, CASE WHEN f = 'f1' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CAST(CASE WHEN f = 'f1' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS confidence_score FROM h WHERE NOT (src = 'part:1' AND dst = 'part:2')")
def import_evidence_promotion(spark, sf):
    raw, n, held = _calls(spark, sf)
    return R.resolve_calls(raw, n, held, n.select(F.lit("f1").alias("source_file"), F.col("id").alias("dst")))


@query("""WITH m AS (SELECT max(p_partkey) AS m FROM part) SELECT 'o' || l_orderkey AS src, CASE WHEN l_partkey % 5 = 0 AND l_partkey + 1 <= m THEN CAST(l_partkey + 1 AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS dst, count(*) AS n FROM lineitem, m GROUP BY 1, 2""")
def unique_stub_rewire(spark, sf):
    """Every fifth part is a stub that bears the label of the next one, its only definition."""
    stub = F.col("p_partkey") % 5 == 0
    n = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"),
        F.concat(F.lit("Part "), (F.col("p_partkey") + stub.cast("int")).cast("string")).alias("label"), F.when(~stub, "a.py").alias("source_file"))
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return R.rewire_stubs(n, e)[1].groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CASE WHEN count(DISTINCT source) OVER (PARTITION BY doc_id % 50) > 1 THEN lower(source) || '_' || (doc_id % 50) ELSE CAST(doc_id % 50 AS VARCHAR) END AS id, source AS source_file FROM documents".replace("count(DISTINCT source) OVER (PARTITION BY doc_id % 50)", "(SELECT count(DISTINCT b.source) FROM documents b WHERE b.doc_id % 50 = documents.doc_id % 50)"))
def id_disambiguation(spark, sf):
    n = table(spark, sf, "documents").select((F.col("doc_id") % 50).cast("string").alias("id"), F.col("source").alias("source_file")).distinct()
    return R.disambiguate_ids(n, n.select(F.col("id").alias("src"), F.col("id").alias("dst"), "source_file"))[0].select("id", "source_file")


@query("WITH RECURSIVE a AS (SELECT p_partkey AS name, p_partkey // 3 AS target FROM part WHERE p_partkey // 3 > 0), r(name, target) AS (SELECT name, target FROM a UNION SELECT r.name, a.target FROM r JOIN a ON a.name = r.target) SELECT CAST(name AS VARCHAR) AS name, CAST(target AS VARCHAR) AS origin FROM r WHERE target NOT IN (SELECT name FROM a)")
def reexport_closure(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), F.floor(F.col("p_partkey") / 3).cast("string").alias("target")).where("target <> '0'")
    return R.reexport_closure(a)


#: The tree of regions, nations, customers and suppliers: n nodes in all, sz in a tree, br the branches at a node.
_TREE = """t AS (SELECT 'nation:' || n_nationkey AS u, 'region:' || n_regionkey AS v FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
sub AS (SELECT n.u AS id, n.v AS up, 1 + (SELECT count(*) FROM t x WHERE x.v = n.u) AS s FROM t n), sz AS (SELECT n_regionkey, 1 + sum(s) AS total FROM nation JOIN sub ON id = 'nation:' || n_nationkey GROUP BY 1), n AS (SELECT CAST(count(DISTINCT x) AS DOUBLE) AS n FROM (SELECT u AS x FROM t UNION ALL SELECT v FROM t))"""


def _tree(spark, sf):
    ref = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    n = table(spark, sf, "nation").select(ref("nation", "n_nationkey").alias("src"), ref("region", "n_regionkey").alias("dst"))
    c = table(spark, sf, "customer").select(ref("customer", "c_custkey"), ref("nation", "c_nationkey"))
    return n.union(c).union(table(spark, sf, "supplier").select(ref("supplier", "s_suppkey"), ref("nation", "s_nationkey")))


@query(f"""WITH {_TREE}, br AS (SELECT up AS id, s AS b FROM sub WHERE up LIKE 'region:%' UNION ALL SELECT up, s FROM sub WHERE up LIKE 'nation:%' UNION ALL SELECT id, total - s FROM sub JOIN nation ON id = 'nation:' || n_nationkey JOIN sz USING (n_regionkey))
SELECT id, round((sum(b) * sum(b) - sum(b * b)) / ((n - 1) * (n - 2)), 9) AS betweenness FROM br, n GROUP BY id, n UNION ALL SELECT u, 0.0 FROM t WHERE u NOT LIKE 'nation:%'""")
def betweenness_tree(spark, sf):
    return node_betweenness(_tree(spark, sf), None).select("id", F.round("betweenness", 9).alias("betweenness"))


@query(f"""WITH {_TREE}, r AS (SELECT 'region:' || n_regionkey AS reg, 'nation:' || n_nationkey AS nat, total FROM nation JOIN sz USING (n_regionkey)), e AS (SELECT id, up, s, total FROM sub JOIN r ON nat = CASE WHEN up LIKE 'region:%' THEN id ELSE up END)
SELECT least(id, up) AS u, greatest(id, up) AS v, round(2 * s * (total - s) / (n * (n - 1)), 9) AS betweenness FROM e, n""")
def edge_betweenness_tree(spark, sf):
    return edge_betweenness(_tree(spark, sf)).select("u", "v", F.round("betweenness", 9).alias("betweenness"))


@query(rf"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_WS}+', ' ', 'g')) AS title FROM pages)
SELECT 'p/' || page_id || '.md' AS source_file, page_id || '.md' AS source, title AS target FROM p WHERE title <> '' UNION ALL SELECT 'p/' || page_id || '.md', CASE WHEN title = '' THEN page_id || '.md' ELSE title END, 'Body' FROM p""")
def markdown_headings(spark, sf):
    p = table(spark, sf, "pages").select(
        F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), T.html_title(F.col("html")), F.lit("\n\n## Body\n\nText: "), T.html_text(F.col("html"))).alias("text"),
    )
    return told(X.extract(p)).select("source_file", "source", "target")


@query("SELECT 'c/' || conv_id || '_' || turn || '.py' AS source_file, substr(rtrim('# NOTE: ' || regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), 3, 80) AS source, conv_id || '_' || turn || '.py' AS target FROM conversations WHERE text IS NOT NULL")
def rationale_comments(spark, sf):
    d = table(spark, sf, "conversations").where("text is not null").select(
        F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("# NOTE: "), F.regexp_replace("text", r"[^A-Za-z ]", " "), F.lit("\ndef f():\n    pass\n")).alias("text"),
    )
    return told(X.extract(d)).where("relation = 'rationale_for'").select("source_file", "source", "target")
