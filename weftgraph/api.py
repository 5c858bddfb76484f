"""Questions to a graph, as functions: what a server or command line would call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.model import PropertyGraph
from weftgraph.operators import analytics as A
from weftgraph.operators import search as S
from weftgraph.operators import traverse as V
from weftgraph.operators.centrality import edge_betweenness
from weftgraph.operators.changes import impact_lines, list_text
from weftgraph.operators.questions import explain, suggest_questions
from weftgraph.sinks.writers import report

MAX_DEPTH, CHARS_PER_TOKEN = 6, 3


class GraphService:
    """The tools of a served graph. Results are DataFrames; texts are bounded by a token budget."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.nodes, self.edges = graph.nodes, graph.edges

    def query_graph(self, question: str, mode: str = "bfs", depth: int = 3, token_budget: int = 2000, contexts: list[str] | None = None) -> str:
        """Nodes and edges around the best matches of a question, seeds first, then by degree, within
        ``CHARS_PER_TOKEN * token_budget`` characters."""
        depth = max(1, min(depth, MAX_DEPTH))
        terms = S.terms_of(question)
        seeds = S.pick_seeds(S.score_nodes(self.nodes, terms))
        ids = [r["id"] for r in seeds.orderBy(F.desc("score"), F.desc("id")).collect()]  # at most three
        if not ids:
            return "No matching nodes."
        found = S.contexts_of(question, contexts)
        edges = S.in_contexts(self.edges, found)
        start = self.nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        hub = V.hub_threshold(self.nodes, edges)
        if mode == "dfs":
            seen = V.dfs(edges, ids, depth, hub).select("id", F.col("depth").cast("int").alias("depth"))
        else:
            seen = V.bfs(edges, start, depth, self.graph.directed, hub)
        d = A.with_degree(self.nodes.join(seen, "id"), edges)
        first = F.when(F.col("id").isin(*ids), 0).otherwise(1)
        lines = d.select(first.alias("a"), (-F.col("degree")).alias("b"), F.col("id").alias("c"),
            F.concat_ws(" ", F.lit("NODE"), "label", F.concat(F.lit("[src="), F.coalesce("source_file", F.lit("")), F.lit(" community="),
            F.coalesce(F.col("community").cast("string"), F.lit("")), F.lit("]"))).alias("line"))
        t = edges.join(seen.select(F.col("id").alias("src")), "src", "left_semi").join(seen.select(F.col("id").alias("dst")), "dst", "left_semi").select(
            F.lit(2).alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", "src", "dst", "relation").alias("c"),
            F.concat(F.lit("EDGE "), "src", F.lit(" --"), "relation", F.lit(" ["), F.coalesce("confidence", F.lit("EXTRACTED")), F.lit("]--> "), "dst").alias("line"))
        budget = CHARS_PER_TOKEN * token_budget
        rows = S.render_budget(lines.unionByName(t), ["a", "b", "c"], budget).orderBy("upto").collect()  # at most ``budget`` characters
        total = lines.count() + t.count()
        text = "\n".join(r["line"] for r in rows)
        return text if len(rows) == total else f"{text}\n... ({total - len(rows)} more lines)"

    def get_node(self, text: str) -> DataFrame:
        """The first node, by id, whose label contains the text or whose id is it."""
        t = text.lower()
        return self.nodes.where(F.lower("label").contains(t) | (F.lower("id") == t)).orderBy("id").limit(1)

    def get_neighbors(self, text: str, relation: str | None = None) -> DataFrame:
        hit = S.find_node(self.nodes, text, 1).collect()
        return A.neighbours(self.edges, hit[0]["id"] if hit else "", relation)

    def get_community(self, community: int) -> DataFrame:
        return self.nodes.where(F.col("community") == community).select("id", "label", "source_file")

    def god_nodes(self, top_n: int = 10) -> DataFrame:
        return A.god_nodes(self.nodes, self.edges, top_n)

    def graph_stats(self) -> DataFrame:
        return A.graph_stats(self.nodes, self.edges)

    def confidence_audit(self) -> DataFrame:
        return A.confidence_audit(self.edges)

    def shortest_path(self, source: str, target: str, max_hops: int = 8) -> tuple[DataFrame, list[str]]:
        """(hop, id) between the best matches of two texts, and warnings: one node for both, or a best
        match less than a tenth ahead of the next."""
        ends, notes = [], []
        for text in (source, target):
            top = S.score_nodes(self.nodes, S.terms_of(text)).orderBy(F.desc("score"), F.desc("id")).limit(2).collect()
            if not top:
                return self.nodes.sparkSession.createDataFrame([], "hop int, id string"), [f"no node matches {text!r}"]
            ends.append(top[0]["id"])
            if len(top) > 1 and top[0]["score"] - top[1]["score"] < 0.1 * top[0]["score"]:
                notes.append(f"{text!r} is ambiguous: {top[0]['id']} or {top[1]['id']}")
        if ends[0] == ends[1]:
            return self.nodes.sparkSession.createDataFrame([], "hop int, id string"), [*notes, "both ends are the same node"]
        return V.shortest_path(self.edges, ends[0], ends[1], max_hops), notes

    def explain(self, text: str, top: int = 20) -> DataFrame:
        hit = S.find_node(self.nodes, text, 1).collect()
        return explain(self.nodes, self.edges, hit[0]["id"] if hit else "", top)

    def affected(self, text: str, depth: int = 2, relations: tuple[str, ...] = V.IMPACT) -> DataFrame:
        return V.affected(self.edges, S.resolve_seed(self.nodes, text).select("id"), depth, relations)

    def communities(self) -> DataFrame:
        return self.nodes.groupBy("community").agg(F.count("*").alias("n_nodes")).orderBy(F.desc("n_nodes"), "community")

    def report(self, top: int = 10) -> str:
        return report(self.nodes, self.edges, top)

    def triage(self, changes: DataFrame, files: DataFrame, now, top: int = 50) -> DataFrame:
        """Open changes by status, then by how many communities they touch."""
        order = F.array(*(F.lit(s) for s in ("READY", "APPROVED", "PENDING", "CHANGES-REQ", "CI-FAIL", "STALE", "DRAFT", "WRONG-BASE")))
        s = A.change_status(changes, now).join(A.change_impact(files, self.nodes), "number", "left")
        key = [F.array_position(order, F.col("status")), F.desc(F.coalesce("n_communities", F.lit(0))), F.col("number")]
        return s.withColumn("rank", F.row_number().over(Window.partitionBy("base_branch").orderBy(*key))).where(F.col("rank") <= top)

    def list_prs(self, changes: DataFrame, now, base: str, files: DataFrame | None = None) -> str:
        """Open changes on their expected base as text, in working order."""
        return list_text(changes, now, base, A.change_impact(files, self.nodes) if files is not None else None)

    def get_pr_impact(self, files: DataFrame, number: int) -> DataFrame:
        """(number, n_communities, n_nodes) of one change. ``files``: (number, path)."""
        return A.change_impact(files.where(F.col("number") == number), self.nodes)

    def affected_text(self, text: str, depth: int = 2, most: int = 500) -> str:
        """What a change of the only match of the text would reach, a line each."""
        seed = S.resolve_seed(self.nodes, text).collect()  # one row or none
        if not seed:
            return f"No unique node match for {text}"
        hits = V.affected(self.edges, self.nodes.sparkSession.createDataFrame([(seed[0]["id"],)], "id string"), depth)
        lines = [r["line"] for r in impact_lines(hits, self.nodes).orderBy("depth", "id").limit(most).collect()]
        return "\n".join([f"Affected nodes for {text}", f"Depth: {depth}", *(lines or ["No affected nodes found."])])

    def resource(self, name: str) -> str:
        """The text of one of ``RESOURCES``."""
        if name == "report":
            return self.report()
        if name == "stats":
            r = self.graph_stats().first()
            return f"Nodes: {r['n_nodes']}\nEdges: {r['n_edges']}\nCommunities: {r['n_communities']}"
        if name == "god-nodes":
            return "\n".join(f"{r['label']} ({r['degree']})" for r in self.god_nodes(10).collect())
        if name == "surprises":
            return "\n".join(f"{r['src']} <-> {r['dst']} [{r['relation']}]" for r in surprising(self.nodes, self.edges, 10).collect()) or "No surprising connections found."
        if name == "audit":
            rows = self.confidence_audit().orderBy("confidence").collect()
            return "\n".join([f"Total edges: {sum(r['n_edges'] for r in rows)}", *(f"{r['confidence']}: {r['n_edges']} ({r['pct']}%)" for r in rows)])
        if name == "questions":
            return "\n".join(r["question"] for r in suggest_questions(self.nodes, self.edges, 10).collect())
        raise ValueError(f"unknown resource {name!r}; there are {', '.join(RESOURCES)}")

    def call(self, tool: str, **arguments):
        """A tool by its name, as a server would be asked for it."""
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool!r}; there are {', '.join(TOOLS)}")
        return getattr(self, tool)(**arguments)


RESOURCES = ("report", "stats", "god-nodes", "surprises", "audit", "questions")
TOOLS = ("query_graph", "get_node", "get_neighbors", "get_community", "god_nodes", "graph_stats", "shortest_path", "list_prs", "get_pr_impact", "triage")


def surprising(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """(src, dst, relation, rank): surprising connections. Of several source files: across files, by score; of one: across
    communities, by confidence; without communities: by the betweenness of edges."""
    files = nodes.where("coalesce(source_file, '') <> ''").select("source_file").distinct().limit(2).count()
    if files > 1:
        s = A.scored_surprises(edges, nodes)
        ends = [F.col(c) for c in ("src", "dst", "relation")]
        best = s.select(*ends, "surprise").distinct().orderBy(F.desc("surprise"), *ends).limit(top)
        return best.select("src", "dst", "relation", F.row_number().over(Window.orderBy(F.desc("surprise"), *ends)).alias("rank"))  # at most ``top`` rows
    if nodes.where("community is not null").select("community").distinct().limit(2).count() > 1:
        s = A.cross_community_surprises(edges, nodes, [F.col("src"), F.col("dst"), F.col("relation")])
        order = [A.confidence_rank(F.col("confidence")), F.col("src"), F.col("dst"), F.col("relation")]
        best = s.orderBy(*order).limit(top)
        return best.select("src", "dst", "relation", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    b = edge_betweenness(edges).orderBy(F.desc(F.round("betweenness", 9)), "u", "v").limit(top)
    rel = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("relation").alias("relation"))
    return b.join(rel, ["u", "v"]).select(F.col("u").alias("src"), F.col("v").alias("dst"), "relation",
        F.row_number().over(Window.orderBy(F.desc(F.round("betweenness", 9)), "u", "v")).alias("rank"))
