"""Readers of log files, transcripts, tracker exports and repositories, and JDBC stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = "op_id string, seq long, hlc struct<ts: long, ctr: int>, site_id string, entity_id string, op string, field string, value string, arrived_at timestamp"
MOST_TURNS, MOST_CHARS = 5000, 20_000
SKIPPED = (".git", "node_modules", "dist", "build", "target", "__pycache__", ".venv")

# The statuses of a tracker export that are kept; others, deferred ones included, become blocked, so that no unknown work counts as ready.
TRACKER_KEPT = ("open", "in_progress", "blocked", "closed", "cancelled")


def jdbc(spark: SparkSession, url: str, table: str, tenant: str, **options: str) -> DataFrame:
    """A table of a server store; the tenant's filter is part of what the server is asked."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    return reader.load().where(F.col("tenant_id") == tenant)


def oplog_lines(spark: SparkSession, path: str) -> DataFrame:
    """Operations of JSON lines with a stated schema; lines that aren't operations are left out."""
    return spark.read.schema(OPS).option("mode", "PERMISSIVE").json(path).where("op_id is not null")


def since(ops: DataFrame, seq: int, limit: int) -> DataFrame:
    return ops.where(F.col("seq") > seq).orderBy("seq", "op_id").limit(limit)


def of_entity(ops: DataFrame, entity: str) -> DataFrame:
    return ops.where(F.col("entity_id") == entity).orderBy("hlc", "site_id")


def by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text begins with ``prefix``; the condition reaches the scan."""
    return rows.where(F.col(column).startswith(prefix))


def resolved(nodes: DataFrame, prefix: str) -> list[str]:
    """Up to two ids that a short prefix may mean; two say that it is ambiguous."""
    return [r["id"] for r in by_prefix(nodes.select("id"), "id", prefix.lower()).distinct().orderBy("id").limit(2).collect()]


def value_set(values: str) -> Column:
    """A JSON array of texts as an array column."""
    return F.from_json(F.lit(values), "array<string>")


def transcript_turns(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, role, text, json) of JSONL transcripts; lines that don't parse are plain turns.

    A file counts as JSONL if half of its lines parse.  Texts and turns beyond
    the format's bounds are cut, as the format says.
    """
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).where("line <> ''")
    v = F.try_parse_json("line")
    shape = T.StructType([T.StructField("role", T.StringType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))])
    p = F.from_json("line", shape)
    rows = raw.withColumns({"json": v.isNotNull() & F.col("line").startswith("{"), "p": p})
    text = F.when(F.col("json"), F.coalesce("p.message.content", "p.text", F.lit(""))).otherwise(F.col("line"))
    role = F.when(F.col("json"), F.coalesce("p.message.role", "p.role", "p.type", F.lit("other"))).otherwise("plain")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    return rows.select("file", n.alias("at"), role.alias("role"), F.substring(text, 1, MOST_CHARS).alias("text"), "json").where(F.col("at") <= MOST_TURNS)


def transcript_usage(spark: SparkSession, path: str) -> DataFrame:
    """Token counts of each message's copies, for a sum of the greatest; malformed lines are left out."""
    usage = "struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>"
    schema = f"timestamp string, requestId string, message struct<id: string, model: string, usage: {usage}>"
    rows = spark.read.schema(schema).json(path).where("message.id is not null")
    return rows.select(F.col("message.id").alias("message_id"), F.col("message.model").alias("model"), F.to_timestamp("timestamp").alias("ts"), "message.usage.*")


def tracker_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of a tracker's JSON lines: status mapped, priority clamped, the rest kept as JSON."""
    raw = spark.read.text(path).where("trim(value) <> ''")

    def get(k: str) -> Column:
        return F.get_json_object("value", f"$.{k}")

    status = F.when(get("status").isin(*TRACKER_KEPT), get("status")).otherwise("blocked")
    known = ("id", "title", "description", "status", "priority", "issue_type", "assignee", "labels", "dependencies", "comments", "close_reason", "created_at", "updated_at", "closed_at")
    unknown = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, known)))
    return raw.select(
        get("id").alias("id"), get("title").alias("title"), get("description").alias("body"), status.alias("status"), F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(get("priority").cast("int"), F.lit(2)))).alias("priority"),
        get("issue_type").alias("type"), get("assignee").alias("assignee"), F.from_json(get("labels"), "array<string>").alias("labels"), F.from_json(get("dependencies"), "array<struct<id: string, dependency_type: string>>").alias("dependencies"), unknown.alias("unknown"),
    ).where("id is not null")


def repository(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, mtime, size, content) of a repository's files; skipped folders and secret files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    hidden = F.col("path").rlike("/(" + "|".join(SKIPPED).replace(".", r"\.") + ")/")
    secret = F.col("path").rlike(r"(?i)/(\.env(\..*)?|.*\.(pem|key|p12|pfx)|id_(rsa|dsa|ecdsa|ed25519))$")
    return files.where(~hidden & ~secret).select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))


def federation(sources: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """Several stores as one table with the name and weight of each."""
    out = None
    for name, df, weight in sources:
        part = df.withColumns({"source_name": F.lit(name), "source_weight": F.lit(weight)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
