"""The store's questions as functions over a data folder, each giving a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.constants import NOW_MS
from graphloom.operators import code, fusion, graph, hierarchy, intervals, lexical, oplog, texts
from graphloom.operators import visibility as vis
from graphloom.operators import workqueue as wq
from graphloom.operators.current import current_edges, current_nodes
from graphloom.sinks import writes
from graphloom.sources.tables import table

_NODE = ("kind", "layer", "scope", "title", "body", "excerpt", "status", "priority", "salience", "open_blockers", "anc_blockers", "head_id", "acl", "owner_id", "team_id", "agent_id", "assignee", "lease_holder", "lease_epoch", "lease_expires", "created_at", "updated_at", "hlc", "site_id", "attrs")


class Store:
    """A folder of tables, seen at one instant."""

    def __init__(self, spark: SparkSession, folder: str, now_ms: int = NOW_MS) -> None:
        self.spark, self.folder, self.now_ms = spark, folder, now_ms
        self.nodes = current_nodes(table(spark, folder, "nodes"), *_NODE)
        self.edges = current_edges(table(spark, folder, "edges"), "weight", "created_at")

    def prime(self, session: str = "") -> DataFrame:
        anchors = self.nodes.where("kind = 'anchor'")
        lost = vis.lost_owners(self.edges.where("type = 'touches'").select("src", "dst"), anchors)
        return wq.digest(self.nodes, lost, session)

    def ready(self, scope: str | None = None, repo: str = "", limit: int = 20) -> DataFrame:
        return wq.ready(self.nodes, self.edges, self.now_ms, limit, scope, repo)

    def update(self, patches: DataFrame, site: str) -> DataFrame:
        """Operations that set (id, field, value)."""
        return writes.set_ops(patches, site, self.now_ms)

    create = update

    def recall(self, text: str, limit: int = 12, viewer: vis.Viewer = vis.Viewer(), embed: Callable[[str], list[float] | None] | None = None, neighbours: Callable[[list[float]], DataFrame] | None = None) -> DataFrame:
        """Best records for a question: strict matches, or else looser ones.

        ``embed`` gives the question's vector or None, and ``neighbours`` the (id, rank)
        of records near it; with both, the two lists are fused.
        """
        shown = self.nodes.withColumn("granted", F.lit(False)).where(vis.history(False) & vis.live_status() & vis.not_pending() & vis.access_core(viewer))
        rows = shown.withColumn("tags", F.array_join(F.from_json(F.get_json_object("attrs", "$.tags"), "array<string>"), " "))
        terms = lexical.parse(text)
        if not terms:
            return rows.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), "title").where("false")
        found = lexical.ranked(lexical.scores(rows.select("id", "title", "body", "tags"), terms), len(terms), ("and", "prefix_and", "prefix_relaxed", "prefix_relaxed2", "or", "prefix_or"))
        vector = embed(text) if embed and neighbours else None
        if vector is None:
            found = found.withColumn("near", F.lit(None).cast("int"))
        else:
            found = found.select("id", "rank").join(neighbours(vector).select("id", F.col("rank").alias("near")), "id", "full")
        both = found.join(rows.select("id", "title", "priority", "updated_at", "layer"), "id").withColumn("score", fusion.rrf(F.col("rank"), F.col("near")) * fusion.boost(self.now_ms))
        return both.orderBy(F.desc("score"), "id").limit(limit).select("id", "score", "rank", "title")

    def remember(self, incoming: DataFrame) -> DataFrame:
        """What incoming (key, target, new) texts are to the records they are about."""
        old = self.nodes.select(F.col("id").alias("target"), F.concat_ws("\n", "title", "body").alias("old"))
        features = texts.pair_features(incoming.join(old, "target"), ["key", "target"])
        return features.withColumn("cos", F.lit(None).cast("double")).select("key", "target", texts.verdict().alias("verdict"))

    def show(self, prefix: str) -> DataFrame:
        return self.nodes.where(F.col("id").startswith(prefix.lower())).orderBy("id").limit(2)

    def link(self, links: DataFrame, site: str) -> DataFrame:
        """Operations that add the (src, type, dst) that make no loop."""
        tree = self.edges.where("type = 'parent'").select("src", "dst")
        bad = graph.acyclicity(tree, links.where("type = 'parent'").select("src", "dst")).where("verdict = 'cycle'").select("src", "dst")
        return writes.edge_ops(links.join(bad.withColumn("type", F.lit("parent")), ["src", "dst", "type"], "left_anti"), site, self.now_ms)

    def hierarchy(self) -> DataFrame:
        return hierarchy.hierarchies(hierarchy.parent_links(table(self.spark, self.folder, "edges")))

    def log_digest(self) -> DataFrame:
        return oplog.snapshot(table(self.spark, self.folder, "oplog"))


class CodeIndex:
    """Files (path, text) with their definitions."""

    def __init__(self, files: DataFrame, parse: Callable[[str, str | None], list[tuple[int, str, str]]] | None = None) -> None:
        """``parse`` gives (line, name, kind) of a text and its language in place of the line patterns."""
        self.files = files
        self.defs = code.definitions(files, "path", "text") if parse is None else code.parsed_definitions(files, "path", "text", parse)

    def search(self, text: str, limit: int = 20) -> DataFrame:
        rows = self.files.select(F.col("path").alias("id"), texts.split_identifier(F.col("path")).alias("title"), F.col("text").alias("body"), F.lit("").alias("tags"))
        terms = lexical.parse(text)
        return lexical.ranked(lexical.scores(rows, terms, {"title": 4.0, "body": 1.0, "tags": 1.0}), len(terms), ("and", "prefix_and", "or", "prefix_or"), pool=limit)

    def grep(self, needle: str) -> DataFrame:
        """Lines with a literal, and the definition each belongs to."""
        hits = code.grep(self.files, "path", "text", needle)
        return intervals.as_of(hits, self.defs.select("path", "line", "name"), "path", "line", "line", ["name"])

    def symbol(self, name: str) -> DataFrame:
        return self.defs.where(F.col("name") == name)

    def callers(self, name: str) -> DataFrame:
        return code.references(self.files, self.defs, "path", "text").where(F.col("name") == name)

    def map(self, top: int = 3) -> DataFrame:
        refs = code.references(self.files, self.defs, "path", "text").withColumnRenamed("path", "user")
        return code.repo_map(refs.join(self.defs.select("name", "path"), "name").where("user <> path").select("user", "path"), top)
