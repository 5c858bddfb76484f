"""Open changes (pull requests) as rows: a source, lists, details, work trees and formatted lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import analytics as A

#: The order in which changes are worked on.
STATUS_ORDER = ("READY", "APPROVED", "PENDING", "CHANGES-REQ", "CI-FAIL", "STALE", "DRAFT", "WRONG-BASE")
#: What the check runs of a change mean, the first row that holds.
FAILED_CHECKS = ("FAILURE", "TIMED_OUT", "CANCELLED", "ERROR", "ACTION_REQUIRED")
RUNNING_CHECKS = ("PENDING", "QUEUED", "IN_PROGRESS", "EXPECTED", "WAITING", "REQUESTED")
SCHEMA = (
    "number long, title string, author struct<login:string>, baseRefName string, headRefName string, isDraft boolean, updatedAt string, reviewDecision string, "
    "statusCheckRollup array<struct<conclusion:string,status:string,state:string>>"
)


def ci_state(checks: Column) -> Column:
    """FAILURE, PENDING, SUCCESS or NONE of an array of check runs."""
    said = F.transform(checks, lambda c: F.upper(F.coalesce(F.nullif(c["conclusion"], F.lit("")), c["state"], c["status"], F.lit(""))))
    return (
        F.when(F.coalesce(F.size(checks), F.lit(0)) <= 0, "NONE").when(F.exists(said, lambda s: s.isin(*FAILED_CHECKS)), "FAILURE")
        .when(F.exists(said, lambda s: s.isin(*RUNNING_CHECKS)), "PENDING").otherwise("SUCCESS")
    )


def read_changes(raw: DataFrame, expected_base: Column) -> DataFrame:
    """Changes from the JSON lists that a code host returns (column ``text``, one list a row); unreadable rows give none."""
    j = raw.select(F.explode(F.from_json("text", f"array<struct<{_typed(SCHEMA)}>>")).alias("c")).where("c.number is not null")
    c = F.col("c")
    return j.select(
        c["number"].alias("number"), F.coalesce(c["title"], F.lit("")).alias("title"), F.coalesce(c["author"]["login"], F.lit("")).alias("author"),
        c["baseRefName"].alias("base_branch"), c["headRefName"].alias("head_branch"),
        F.coalesce(c["isDraft"], F.lit(False)).alias("is_draft"), F.try_to_timestamp(c["updatedAt"]).alias("updated_at"),
        F.nullif(c["reviewDecision"], F.lit("")).alias("review_decision"), ci_state(c["statusCheckRollup"]).alias("ci_status"),
        expected_base.alias("expected_base"),
    )


def _typed(ddl: str) -> str:
    """``a x, b struct<..>`` as the fields of a struct type."""
    out, depth, word = [], 0, ""
    for ch in ddl + ",":
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            word = ""
        else:
            word += ch
    return ",".join(out)


def work_trees(spark: SparkSession, porcelain: str) -> DataFrame:
    """(path, branch) of a work-tree listing in its machine-readable form; detached ones have no branch."""
    rows = []
    for block in porcelain.split("\n\n"):
        said = dict(line.split(" ", 1) for line in block.splitlines() if " " in line)
        if "worktree" in said:
            rows.append((said["worktree"], said["branch"].removeprefix("refs/heads/") if "branch" in said else None))
    return spark.createDataFrame(rows, "path string, branch string")


def list_changes(changes: DataFrame, now: Column, impact: DataFrame | None = None) -> DataFrame:
    """Changes on the expected base, in working order, a line each: (place, number, status, line)."""
    s = A.change_status(changes, now).where(F.col("base_branch") == F.col("expected_base"))
    if impact is not None:
        s = s.join(impact.select("number", "n_communities", "n_nodes"), "number", "left")
    order = F.array(*map(F.lit, STATUS_ORDER))
    spread = F.when(F.coalesce("n_nodes", F.lit(0)) > 0,
        F.concat(F.lit("  impact="), F.col("n_communities").cast("string"), F.lit(" communities, "), F.col("n_nodes").cast("string"),
        F.lit(" nodes"))).otherwise("") if impact is not None else F.lit("")
    line = F.concat(
        F.lit("#"), F.col("number").cast("string"), F.lit(" ["), F.col("status"), F.lit("] CI="), F.col("ci_status"), F.lit(" review="),
        F.coalesce("review_decision", F.lit("none")), F.lit(" age="), F.col("age_days").cast("string"), F.lit("d author="), F.col("author"), spread,
        F.lit("\n  "), F.col("title"),
    )
    return s.select(F.array_position(order, F.col("status")).alias("place"), "age_days", "number", "status", line.alias("line"))


def list_text(changes: DataFrame, now: Column, base: str, impact: DataFrame | None = None, most: int = 500) -> str:
    """The list as text, at most ``most`` changes."""
    rows = list_changes(changes, now, impact).orderBy("place", "age_days", "number").limit(most).collect()
    wrong = changes.where(F.col("base_branch") != F.col("expected_base")).count()
    return "\n\n".join([f"Open changes to {base}: {len(rows)} ({wrong} on another base)", *(r["line"] for r in rows)])


def status_counts(changes: DataFrame, now: Column) -> DataFrame:
    """(status, n): the summary line of a dashboard."""
    return A.change_status(changes, now).groupBy("status").agg(F.count("*").alias("n"))


def impact_lines(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, id, line): a line per affected node with the relation it is reached by and its place."""
    n = nodes.select("id", "label", "source_file", *(["source_location"] if "source_location" in nodes.columns else []))
    place = F.concat_ws(":", F.nullif(F.col("source_file"), F.lit("")), "source_location") if "source_location" in nodes.columns else F.coalesce("source_file", F.lit(""))
    return hits.join(n, "id").select("depth", "id", F.concat(F.lit("- "), F.coalesce("label", "id"), F.lit(" ["), "via", F.lit("] "), place).alias("line"))


def suppression_sites(sources: DataFrame) -> DataFrame:
    """(path, line, name, arity, sample): declarations of ``seen_*`` sets in program text, which may swallow edges
    before they are counted. ``sources``: (path, text)."""
    lines = sources.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("at", "row")).where(F.col("row").rlike(r"^\s*seen_[A-Za-z0-9_]+\s*[:=]"))
    inside = F.trim(F.regexp_extract("row", r"set\[tuple\[([^\]]+)\]\]", 1))
    arity = F.when(inside == "", 0).otherwise(F.length(inside) - F.length(F.replace(inside, F.lit(","), F.lit(""))) + 1)
    return lines.select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("row", r"^\s*(seen_[A-Za-z0-9_]+)", 1).alias("name"), arity.cast("int").alias("arity"),
        F.substring(F.trim("row"), 1, 120).alias("sample"))


def parallel_edges(edges: DataFrame, u: str, v: str, directed: bool = False) -> DataFrame:
    """All edges between two nodes, numbered from 0 in the order of relation and place."""
    from pyspark.sql.window import Window

    hit = (F.col("src") == u) & (F.col("dst") == v)
    if not directed:
        hit = hit | ((F.col("src") == v) & (F.col("dst") == u))
    place = "source_location" if "source_location" in edges.columns else "relation"
    few = edges.where(hit)
    return few.withColumn("key", F.row_number().over(Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("relation", place, "src")) - 1)
