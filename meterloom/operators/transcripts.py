"""Transcript lines to usage and messages, and conversations from messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.parsing import rfc3339_ms, whole_number
from ..sources.files import work_folder

USAGE = "input_tokens string, output_tokens string, cache_read_input_tokens string, cache_creation_input_tokens string, cache_creation struct<ephemeral_5m_input_tokens:string,ephemeral_1h_input_tokens:string>"
ENVELOPE = (
    "type string, uuid string, parentUuid string, requestId string, sessionId string, timestamp string, cwd string, "
    f"isSidechain boolean, message struct<model:string,content:string,usage:struct<{', '.join(x.replace(' ', ':', 1) for x in USAGE.split(', '))}>>"
)
#: What a line's status depends on, as types to cast a parsed line to. The side chain's flag stays as it is, since a text cast to boolean may be true.
HEAD = "struct<type:string,sessionId:string,timestamp:string,isSidechain:variant,message:struct<usage:struct<input_tokens:variant>>>"
SYNTHETIC = "<synthetic>"


def _count(text: Column) -> Column:
    return F.coalesce(whole_number(text), F.lit(0))


def _is_json(column: str, opening: str) -> Column:
    """Whether the text is JSON that begins with ``opening``, which tells an object or array without looking at what it holds; false for null."""
    return F.coalesce(F.ltrim(F.col(column), F.lit(" \t\r\n")).startswith(opening) & F.try_parse_json(column).isNotNull(), F.lit(False))


def _status(is_object: Column, head: str, ts_ms: Column) -> Column:
    """The status of a line of which ``head`` holds type, session and usage."""
    kind = F.col(f"{head}.type")
    complete = F.col(f"{head}.sessionId").isNotNull() & ts_ms.isNotNull() & F.col(f"{head}.message.usage").isNotNull()
    return (
        F.when(~is_object, "malformed")
        .when(kind == "user", "user")
        .when((kind == "assistant") & complete, "assistant")
        .when(kind == "assistant", "invalid")
        .otherwise("other")
    )


def line_statuses(lines: DataFrame) -> DataFrame:
    """Add ``status`` and ``is_sidechain`` to (file, pos, line), as ``parse_lines`` does, by one parse of each line and without its other fields."""
    head = F.try_variant_get(F.try_parse_json("line"), "$", HEAD)  # null for what is no object
    once = lines.select("*", F.explode(F.array(head)).alias("head"))
    status = _status(F.col("head").isNotNull(), "head", rfc3339_ms(F.col("head.timestamp")))
    return once.select(*lines.columns, status.alias("status"), F.coalesce(F.to_json("head.isSidechain") == "true", F.lit(False)).alias("is_sidechain"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``doc`` (the parsed envelope), ``ts_ms``, ``status`` and ``is_sidechain`` to (file, pos, line).

    Statuses: malformed (no JSON object), other, user, assistant, invalid (an assistant line without
    session, time or usage). Where they are all that is asked for, ``line_statuses`` costs less.
    """
    is_object = _is_json("line", "{")
    # Generators, so that what follows does not parse a line anew for each field it reads.
    read = F.struct(is_object.alias("is_object"), F.from_json("line", ENVELOPE).alias("doc"))
    once = lines.select("*", F.explode(F.array(read)).alias("read")).select(*lines.columns, "read.is_object", "read.doc")
    parsed = once.select("*", F.explode(F.array(rfc3339_ms(F.col("doc.timestamp")))).alias("ts_ms"))
    flag = F.coalesce("doc.isSidechain", F.lit(False))
    return parsed.select("*", _status(F.col("is_object"), "doc", F.col("ts_ms")).alias("status"), flag.alias("is_sidechain")).drop("is_object")


def parse_stats(parsed: DataFrame) -> DataFrame:
    """One row: lines read, assistant lines, skipped, malformed and invalid ones, and those of side chains, of lines with their statuses."""
    status = F.col("status")
    return parsed.agg(
        F.count("*").alias("read"),
        F.count_if(status.isin("assistant", "invalid")).alias("assistant"),
        F.count_if(status.isin("user", "other")).alias("skipped"),
        F.count_if(status == "malformed").alias("malformed"),
        F.count_if(status == "invalid").alias("invalid"),
        F.count_if((status == "assistant") & F.col("is_sidechain")).alias("sidechain"),
    )


def extract_usage(parsed: DataFrame) -> DataFrame:
    """A row for each complete assistant line; the split only where its object is there."""
    usage = F.col("doc.message.usage")
    split = usage["cache_creation"]
    return parsed.where("status = 'assistant'").select(
        "file",
        "pos",
        F.col("doc.requestId").alias("request_id"),
        F.col("doc.sessionId").alias("session_id"),
        F.col("ts_ms").alias("timestamp_ms"),
        F.col("doc.message.model").alias("model"),
        F.col("doc.cwd").alias("cwd"),
        F.coalesce("doc.isSidechain", F.lit(False)).alias("is_sidechain"),
        _count(usage["input_tokens"]).alias("input_tokens"),
        _count(usage["output_tokens"]).alias("output_tokens"),
        _count(usage["cache_read_input_tokens"]).alias("cache_read_tokens"),
        _count(usage["cache_creation_input_tokens"]).alias("cache_creation_tokens"),
        F.when(split.isNotNull(), _count(split["ephemeral_5m_input_tokens"])).alias("cache_creation_5m_tokens"),
        F.when(split.isNotNull(), _count(split["ephemeral_1h_input_tokens"])).alias("cache_creation_1h_tokens"),
    )


def collapse_requests(usage: DataFrame) -> DataFrame:
    """One line for each request of a file: the last with any usage, else the last.

    Synthetic lines and those without a request id are left out. Lines of a request in two passes
    meet here too, as all lines are kept until they are collapsed.
    """
    used = sum((F.col(c) for c in ("output_tokens", "cache_read_tokens", "cache_creation_tokens")), F.col("input_tokens")) > 0
    order = Window.partitionBy("file", "request_id").orderBy(F.desc("used"), F.desc("pos"))
    rows = usage.where(F.col("request_id").isNotNull() & ~F.col("model").eqNullSafe(F.lit(SYNTHETIC))).withColumn("used", used)
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k", "used")


def transcript_requests(collapsed: DataFrame) -> DataFrame:
    """Collapsed lines as unpriced backfill rows; ``arrival`` orders them by file and place."""
    return collapsed.select(
        "request_id", "session_id", "timestamp_ms", "model",
        F.when(F.col("is_sidechain"), "subagent").alias("query_source"),
        F.lit(None).cast("double").alias("cost_usd"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens",
        F.lit("api_request").alias("event_type"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.lit("backfill").alias("source"),
        F.struct("file", "pos").alias("arrival"),
    )


def extract_messages(parsed: DataFrame) -> DataFrame:
    """User and assistant lines that have an id, a session, a time and an array of content.

    The raw text of content and tool result is kept as it stood in the line.
    """
    content = F.get_json_object("line", "$.message.content")
    result = F.get_json_object("line", "$.toolUseResult")
    return (
        parsed.where("doc.type in ('user', 'assistant')")
        .select(
            "file",
            "pos",
            F.col("doc.uuid").alias("uuid"),
            F.col("doc.sessionId").alias("session_id"),
            F.when(F.col("doc.type") == "assistant", F.col("doc.requestId")).alias("request_id"),
            F.col("doc.parentUuid").alias("parent_uuid"),
            F.col("doc.type").alias("role"),
            F.col("ts_ms").alias("timestamp_ms"),
            F.coalesce("doc.isSidechain", F.lit(False)).alias("is_sidechain"),
            content.alias("content"),
            F.nullif(result, F.lit("null")).alias("tool_use_result"),
        )
        .where("uuid is not null and session_id is not null and timestamp_ms is not null")
        .where(_is_json("content", "["))
    )


def collapse_messages(messages: DataFrame) -> DataFrame:
    """All user messages, and the last line of each assistant request; assistants without an id are dropped."""
    # One window over both roles, so that the lines are read and parsed once; a user's line is a group of its own.
    user = F.col("role") == "user"
    order = Window.partitionBy("file", "request_id", F.when(user, F.col("pos"))).orderBy(F.desc("pos"))
    kept = messages.where(user | ((F.col("role") == "assistant") & F.col("request_id").isNotNull()))
    return kept.withColumn("k", F.row_number().over(order)).where(user | (F.col("k") == 1)).drop("k")


def content_blocks(messages: DataFrame) -> DataFrame:
    """(uuid, at, kind, text, name, tool_use_id, is_error, raw) for each block of each message.

    Kinds: text, thinking, tool_use, tool_result, unknown. A text block without text has an empty
    one; content that is no JSON array has no blocks.
    """
    blocks = F.from_json("content", "array<string>")
    block = messages.select("uuid", F.posexplode(blocks).alias("at", "raw"))
    field = lambda name: F.get_json_object("raw", f"$.{name}")
    kind = field("type")
    known = kind.isin("text", "thinking", "tool_use", "tool_result")
    return block.select(
        "uuid",
        "at",
        F.when(known, kind).otherwise("unknown").alias("kind"),
        F.when(kind == "text", F.coalesce(field("text"), F.lit(""))).when(kind == "thinking", F.coalesce(field("thinking"), F.lit(""))).alias("text"),
        F.when(kind == "tool_use", field("name")).alias("name"),
        F.when(kind == "tool_use", field("id")).when(kind == "tool_result", field("tool_use_id")).alias("tool_use_id"),
        F.when(kind == "tool_result", F.coalesce(field("is_error") == "true", F.lit(False))).alias("is_error"),
        "raw",
    )


def session_turns(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Requests of sessions with their messages in order of time; requests without messages are left out."""
    turns = messages.where("request_id is not null").groupBy("session_id", "request_id").agg(
        F.array_sort(F.collect_list(F.struct("timestamp_ms", "uuid"))).alias("turns")
    )
    joined = requests.select("session_id", "request_id", "timestamp_ms", "cost_usd").join(turns, ["session_id", "request_id"])
    return joined.select("session_id", "request_id", "timestamp_ms", "cost_usd", F.transform("turns", lambda t: t["uuid"]).alias("uuids"))


def request_chains(requests: DataFrame, messages: DataFrame, hops: int = 64) -> DataFrame:
    """(request_id, n_turns, chain_complete, uuids) for every request: its message and all messages above it.

    Jumps double with each round: after k joins every message knows its ancestors of up to 2 ** k
    steps, so ``hops`` costs its logarithm. A chain is complete if it reaches a root within ``hops``.
    Each round is checkpointed. A request without a message has no turns.
    """
    spark = requests.sparkSession
    work_folder(spark, "chains")  # sets the checkpoint folder where there is none
    nodes = messages.select("uuid", "parent_uuid")
    parents = nodes.select(F.col("uuid").alias("parent"), F.lit(True).alias("known"))
    up = nodes.join(parents, F.col("parent_uuid") == F.col("parent"), "left").select(
        "uuid", F.when(F.col("known"), F.col("parent_uuid")).alias("next"), (F.col("parent_uuid").isNotNull() & F.col("known").isNull()).alias("lost")
    )
    # path: the ancestors from here up to where ``next`` goes on
    paths = up.select("uuid", F.array("uuid").alias("path"), "next", "lost").checkpoint()
    steps = 1
    while steps <= hops:
        above = paths.select(F.col("uuid").alias("next"), F.col("path").alias("more"), F.col("next").alias("further"), F.col("lost").alias("lost_above"))
        paths = (
            paths.join(above, "next", "left")
            .select(
                "uuid",
                F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"),
                F.col("further").alias("next"),
                F.coalesce("lost_above", "lost").alias("lost"),
            )
            .checkpoint()
        )
        steps *= 2
    own = messages.where("role = 'assistant' and request_id is not null").groupBy("request_id").agg(F.max_by("uuid", F.struct("timestamp_ms", "uuid")).alias("uuid"))
    found = requests.select("request_id").distinct().join(own, "request_id", "left").join(paths, "uuid", "left")
    long = F.coalesce(F.size("path"), F.lit(0)) > hops
    kept = F.when(F.col("path").isNull(), F.array().cast("array<string>")).otherwise(F.slice("path", 1, hops))
    return found.select(
        "request_id",
        F.size(kept).alias("n_turns"),
        (F.col("path").isNotNull() & ~F.coalesce("lost", F.lit(False)) & F.col("next").isNull() & ~long).alias("chain_complete"),
        F.reverse(kept).alias("uuids"),
    )
