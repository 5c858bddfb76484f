"""What goes into diagrams: edges worth drawing, their order, entry points, the nodes of a section, its flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Relations that a call flow shows, those it falls back on, and what a relation adds to an edge's score.
PRIMARY = ("calls", "uses", "method", "imports", "imports_from")
SECONDARY = ("contains", "rationale_for", "conceptually_related_to")
RELATION_SCORE = {"calls": 1.0, "uses": 1.0, "method": 1.0, "imports": 0.6, "imports_from": 0.6, "contains": -0.2, "rationale_for": -0.6}
SURE = 0.85
#: Fields that may hold a node's importance, in order.
IMPORTANCE = ("pagerank", "page_rank", "pageRank", "rank", "centrality", "score")
#: Words of labels and paths that say nothing of a section.
STOPWORDS = (
    "the", "and", "for", "with", "from", "this", "that", "class", "function", "method", "file", "src", "lib", "core", "index", "main", "init", "py", "ts", "tsx", "js", "jsx", "go",
    "rs", "java", "html", "css",
)


def included(confidence: Column, score: Column) -> Column:
    """Whether an edge is drawn: EXTRACTED, or INFERRED and nearly sure. No confidence counts as EXTRACTED, no score as 1."""
    c = F.upper(F.coalesce(confidence, F.lit("EXTRACTED")))
    return (c == "EXTRACTED") | ((c == "INFERRED") & (F.coalesce(score, F.lit(1.0)) >= SURE))


def edge_score(relation: Column, confidence: Column, score: Column) -> Column:
    out = F.coalesce(score, F.lit(1.0)) + F.when(F.upper(confidence) == "EXTRACTED", 2.0).otherwise(0.0)
    add = F.lit(0.0)
    for name, value in RELATION_SCORE.items():
        add = F.when(relation == name, value).otherwise(add)
    return out + add


def preferred(edges: DataFrame, structure: bool = False) -> DataFrame:
    """The drawn edges of the preferred relations (with ``structure`` the secondary ones too); if there is none, all drawn edges."""
    wanted = [*PRIMARY, *(SECONDARY if structure else ())]
    drawn = edges.where(included(F.col("confidence"), F.col("confidence_score")))
    some = drawn.where(F.col("relation").isin(*wanted)).limit(1).count() > 0
    return drawn.where(F.col("relation").isin(*wanted)) if some else drawn


def scored_nodes(edges: DataFrame) -> DataFrame:
    """(id, score, n_out, n_in, net): the scores of a node's edges, and how many leave and enter it."""
    s = edges.select("src", "dst", edge_score(F.col("relation"), F.col("confidence"), F.col("confidence_score")).alias("s"))
    flat = s.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("s").alias("s"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("id"), F.col("s").alias("s"), F.lit(0).alias("o")))).alias("x"))
    g = flat.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.s").alias("score"), F.sum("x.o").cast("long").alias("n_out"), F.sum(1 - F.col("x.o")).cast("long").alias("n_in"))
    return g.withColumn("net", F.col("n_out") - F.col("n_in"))


def entry_points(edges: DataFrame, limit: int) -> DataFrame:
    """The nodes that call out most beyond what they are called, of those that call out at all."""
    return scored_nodes(edges).where("n_out > 0").orderBy(F.desc("net"), F.desc("n_out"), "id").limit(limit).select("id", "net", "n_out")


def diagram_nodes(nodes: DataFrame, edges: DataFrame, most: int, kind: Column) -> list[str]:
    """Ids of at most ``most`` nodes for a diagram: entry points, then the ends of the strongest edges, then the
    best of the rest. Concepts stop being taken at a third of the place. Only bounded lists reach the driver."""
    p = preferred(edges)
    known = nodes.select("id", kind.alias("kind"), "label", "source_file")
    concept = most // 3 if most // 3 > 4 else 4
    chosen: list[str] = []
    taken: set[str] = set()

    def add(node_id: str, node_kind: str) -> bool:
        if node_id not in taken and not (node_kind == "concept" and len(chosen) >= concept):
            chosen.append(node_id)
            taken.add(node_id)
        return len(chosen) >= most

    for r in entry_points(p, max(3, most // 3)).join(known, "id").orderBy(F.desc("net"), F.desc("n_out"), "id").collect():
        if add(r["id"], r["kind"]):
            return chosen
    strong = p.select("src", "dst", edge_score(F.col("relation"), F.col("confidence"), F.col("confidence_score")).alias("s"), "relation")
    # every edge brings a new node or is one of those within the chosen, so a bounded head is enough
    head = strong.orderBy(F.desc("s"), "src", "dst", "relation").limit(most * most + most)
    ends = head.join(known.select(F.col("id").alias("src"), F.col("kind").alias("sk")), "src").join(known.select(F.col("id").alias("dst"), F.col("kind").alias("dk")), "dst")
    for r in ends.orderBy(F.desc("s"), "src", "dst", "relation").collect():
        if add(r["src"], r["sk"]) or add(r["dst"], r["dk"]):
            return chosen
    rest = known.join(scored_nodes(p).select("id", "score"), "id", "left").orderBy((F.col("kind") == "concept"), F.desc(F.coalesce("score", F.lit(0.0))), "source_file", "label",
        "id").limit(most + len(chosen))
    for r in rest.collect():
        if len(chosen) >= most:
            break
        if r["id"] not in taken:
            chosen.append(r["id"])
            taken.add(r["id"])
    return chosen


def flow_chain(summary: DataFrame, order: list[str], most: int = 7) -> list[str]:
    """A walk over sections: from the one with the fewest incoming edges always to the most linked one not yet
    seen, else to the next in order. ``summary``: (a, b, n_edges), a row per pair of sections."""
    if not order:
        return []
    out: dict[str, dict[str, int]] = {}
    into: dict[str, int] = {}
    for r in summary.where(F.col("a").isin(order) & F.col("b").isin(order)).groupBy("a", "b").agg(F.sum("n_edges").alias("n")).collect():
        out.setdefault(r["a"], {})[r["b"]] = r["n"]
        into[r["b"]] = into.get(r["b"], 0) + r["n"]
    at = min(order, key=lambda s: (into.get(s, 0), order.index(s)))
    chain = [at]
    while len(chain) < min(most, len(order)):
        ahead = [(n, b) for b, n in out.get(at, {}).items() if b not in chain]
        at = max(ahead)[1] if ahead else next(s for s in order if s not in chain)
        chain.append(at)
    return chain


def importance(nodes: DataFrame) -> Column:
    """The first importance field that a table has, as a number; 0 without one."""
    fields = [F.col(c).try_cast("double") for c in IMPORTANCE if c in nodes.columns]
    return F.coalesce(*fields, F.lit(0.0))


def section_keywords(nodes: DataFrame, sections: DataFrame, limit: int = 5) -> DataFrame:
    """(section, rank, word, n): the most frequent words of labels and paths of a section."""
    text = F.lower(F.regexp_replace(F.concat_ws(" ", "label", "source_file"), "[/_-]", " "))
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    w = nodes.join(sections, "id").select("section", F.explode(words).alias("word")).where((F.length("word") >= 3) & ~F.col("word").isin(*STOPWORDS))
    n = w.groupBy("section", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", rank).where(F.col("rank") <= limit).select("section", "rank", "word", "n")


def tree_leaves(nodes: DataFrame, most: int = 200) -> DataFrame:
    """(source_file, at, name): the symbols of a file in the order of a tree view (private last, then by name without
    case), at most ``most``; a closing row ``(+N more)`` stands for the others. The file's own node is left out."""
    own = (F.col("label") == F.substring_index("source_file", "/", -1)) & (F.col("file_type") == "code")
    n = nodes.where(F.col("source_file").isNotNull() & ~F.coalesce(own, F.lit(False)))
    w = Window.partitionBy("source_file").orderBy(F.col("label").startswith("_"), F.lower("label"), "id")
    first = n.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most).select("source_file", "at", F.col("label").alias("name"))
    more = n.groupBy("source_file").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return first.unionByName(more.select("source_file", F.lit(most + 1).alias("at"), F.concat(F.lit("(+"), (F.col("n") - most).cast("string"), F.lit(" more)")).alias("name")))


def mermaid_text(label: Column) -> Column:
    """A label that cannot break out of a diagram."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), r"[\"<>{}\[\]()|`#;]", " "), r"\s+", " "))


def mermaid_id(name: Column, lead: str = "n_") -> Column:
    return F.concat(F.lit(lead), F.regexp_replace(name, "[^A-Za-z0-9_]", "_"))


def overview_lines(summary: DataFrame, sizes: DataFrame, most: int = 12) -> DataFrame:
    """(part, rank, name, line): a flowchart of sections, a box each and the ``most`` strongest links between them with their main
    relation. ``summary``: (kind, a, b, relation, n_edges); ``sizes``: (section, n)."""
    row = lambda part, rank, name, line: [F.lit(part).alias("part"), rank.cast("long").alias("rank"), name.alias("name"), line.alias("line")]
    title = F.concat(F.lit("    "), mermaid_id(F.col("section"), "s_"), F.lit('("'), mermaid_text(F.col("section")), F.lit("<br/><small>"), F.col("n").cast("string"),
        F.lit(' nodes</small>")'))
    box = sizes.select(*row(1, F.lit(0), F.col("section"), title))
    pairs = summary.where("kind = 'inter'").groupBy("a", "b").agg(F.sum("n_edges").alias("n"), F.min_by("relation", F.struct(-F.col("n_edges"), F.col("relation"))).alias("r"))
    best = pairs.orderBy(F.desc("n"), "a", "b").limit(most)
    times = F.when(F.col("n") > 1, F.concat(F.lit(" x"), F.col("n").cast("string"))).otherwise("")
    arrow = F.concat(F.lit("    "), mermaid_id(F.col("a"), "s_"), F.lit(" -->|"), F.replace("r", F.lit("_"), F.lit(" ")), times, F.lit("| "), mermaid_id(F.col("b"), "s_"))
    return box.unionByName(best.select(*row(2, -F.col("n"), F.concat_ws(" ", "a", "b"), arrow)))
