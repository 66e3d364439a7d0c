"""Events of agent runs, intents of messages, and choices of a dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MESSAGE_PREFIX, blank_to_null, canonical_json, event_key, find_issue_key, serialized, session_uuid

# Words that lead a message to a workflow, in order of precedence; target states; headers and
# options of a dialogue that decide.
INTENTS = [
    ("jira", ["jira", "transition", "ticket", "issue"]),
    ("complex", ["batch", "ingest", "records", "sync", "rows", "csv"]),
    ("medium", ["user", "welcome", "draft", "editorial", "email", "u1", "u2"]),
]
STATUSES = ["pending", "approved", "rejected"]
FAILURE, FAILED_STEP = r"(?:simulate|force|inject).*(?:step\s*)?b|fail.*step\s*b", "B_transition"
USERS = [("u2", ["u2", "missing"]), ("does-not-exist", ["fatal", "unknown"])]
FIRST_USER, SAMPLE_QUALITY = "u1", 0.9
CANCEL, OTHER_HEADER, RECALL, PROJECT_HEADER, OTHER = "Cancel", "Other options", "Recall memory", "Project", "Other options"

MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<tool_name:string,tool_call_id:string,tool_args:string>>,tool_name:string,tool_call_id:string>>"


def _found(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _spelled(value: Column) -> Column:
    """text and whether it is JSON, of a variant: a string is its own text, JSON null has none."""
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", _found(value, "$", "string")).when(kind != "VOID", F.to_json(value))
    return F.struct(text.alias("text"), F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False)).alias("is_json"))


def tool_call(call: Column) -> Column:
    """tool_name, tool_call_id and tool_args (text, is_json) of a tool call (variant), in any of the shapes that agents give.

    A name or id that is blank gives way to the next; arguments that are there as
    null are null, and others aren't looked for. What is no object has none of them.
    """
    first = lambda *paths: F.coalesce(*[blank_to_null(_found(call, p, "string")) for p in paths])
    return F.struct(
        first("$.tool_name", "$.function.name").alias("tool_name"), first("$.tool_call_id", "$.id").alias("tool_call_id"),
        _spelled(F.coalesce(*[_found(call, p) for p in ("$.tool_args", "$.arguments", "$.function.arguments")])).alias("tool_args"),
    )


def _message(message: Column) -> Column:
    own = lambda name: _found(message, f"$.{name}", "string")
    calls = F.transform(_found(message, "$.tool_calls", "array<variant>"), tool_call)
    return F.struct(own("role").alias("role"), _spelled(_found(message, "$.content")).alias("content"), calls.alias("tool_calls"), own("tool_name").alias("tool_name"), own("tool_call_id").alias("tool_call_id"))


def _typed_message(message: Column) -> Column:
    text = lambda c: F.struct(c.alias("text"), F.lit(False).alias("is_json"))
    call = lambda c: F.struct(c["tool_name"].alias("tool_name"), c["tool_call_id"].alias("tool_call_id"), text(c["tool_args"]).alias("tool_args"))
    return F.struct(message["role"].alias("role"), text(message["content"]).alias("content"), F.transform(message["tool_calls"], call).alias("tool_calls"), message["tool_name"].alias("tool_name"), message["tool_call_id"].alias("tool_call_id"))


def _messages(runs: DataFrame) -> Column:
    """Messages of runs in one form, whether they are MESSAGES, JSON text or variants."""
    kind = runs.schema["messages"].dataType.simpleString()
    if kind not in ("string", "variant"):
        return F.transform("messages", _typed_message)
    whole = F.try_parse_json("messages") if kind == "string" else F.col("messages")
    return F.transform(F.coalesce(_found(whole, "$", "array<variant>"), _found(whole, "$.messages", "array<variant>")), _message)


def _written(spelled: Column) -> Column:
    """The text of what _spelled gives: JSON in its canonical form, strings trimmed; null for blank."""
    return F.when(spelled["is_json"], canonical_json(F.when(spelled["is_json"], spelled["text"]))).otherwise(serialized(spelled["text"]))


def run_events(runs: DataFrame) -> DataFrame:
    """Events of runs (run_id, session_id, scope, content, messages): run_id, session_id, scope, position, source, content, tool_name, tool_call_id, source_event_id.

    messages: as in MESSAGES; or JSON text or a variant, an array of messages or an
    object that holds one, with tool calls in any shape (tool_call) and contents
    that may be JSON of their own. Text that is no JSON holds no messages.
    Tool calls come before their message's content. A run without any assistant
    text gives its own content as the assistant's.
    """
    keep = ["run_id", "session_id", "scope"]
    read = runs.select(*keep, "content", _messages(runs).alias("messages"))
    said = read.select(*keep, F.posexplode("messages").alias("m", "message"))
    assistant, tool = said.where("message.role = 'assistant'"), said.where("message.role = 'tool'")
    number = F.col("m").cast("string")

    def event(df, position, source, content, name, call, suffix):
        return df.select(*keep, position.alias("position"), F.lit(source).alias("source"), content.alias("content"), name.alias("tool_name"), call.alias("tool_call_id"), event_key(F.col("run_id"), suffix).alias("source_event_id"))

    none = F.lit(None).cast("string")
    calls = assistant.select(*keep, "m", F.posexplode("message.tool_calls").alias("c", "call"))
    call_events = event(
        calls, F.struct(F.col("m").alias("m"), F.col("c").alias("c")), "assistant", F.coalesce(_written(F.col("call.tool_args")), F.lit("{}")), blank_to_null(F.col("call.tool_name")), blank_to_null(F.col("call.tool_call_id")),
        F.concat(F.lit("message:"), number, F.lit(":tool:"), F.col("c").cast("string")),
    )
    end = F.struct(F.col("m").alias("m"), F.lit(1 << 30).alias("c"))
    content = _written(F.col("message.content"))
    texts = event(assistant, end, "assistant", content, none, none, F.concat(F.lit("message:"), number, F.lit(":content"))).where("content IS NOT NULL")
    suffix = F.concat(F.lit("message:"), number, F.lit(":tool-result"))
    call_id = F.coalesce(blank_to_null(F.col("message.tool_call_id")), event_key(F.col("run_id"), suffix), F.concat(F.lit(MESSAGE_PREFIX), number, F.lit("-tool-result")))
    results = event(tool, end, "tool", content, blank_to_null(F.col("message.tool_name")), call_id, suffix).where("content IS NOT NULL")
    speaks = F.exists("messages", lambda m: F.coalesce((m["role"] == "assistant") & serialized(m["content"]["text"]).isNotNull(), F.lit(False)))
    silent = read.where(~F.coalesce(speaks, F.lit(False)))
    closing = event(silent, F.struct(F.lit(1 << 30).alias("m"), F.lit(0).alias("c")), "assistant", serialized(F.col("content")), none, none, F.lit("assistant")).where("content IS NOT NULL")
    return call_events.unionByName(texts).unionByName(results).unionByName(closing)


def asked_events(runs: DataFrame) -> DataFrame:
    """What users asked runs (run_id, session_id, scope, input): an event like those of run_events for each input that isn't blank."""
    none = F.lit(None).cast("string")
    first = F.struct(F.lit(-1).alias("m"), F.lit(0).alias("c"))
    out = runs.select("run_id", "session_id", "scope", first.alias("position"), F.lit("user").alias("source"), serialized(F.col("input")).alias("content"), none.alias("tool_name"), none.alias("tool_call_id"), event_key(F.col("run_id"), F.lit("user")).alias("source_event_id"))
    return out.where("content IS NOT NULL")


def captured_turns(runs: DataFrame) -> DataFrame:
    """Turns of whole runs (input and what run_events takes), as Jobs.ingest takes them; sessions get UUIDs."""
    events = asked_events(runs).unionByName(run_events(runs))
    return events.select(session_uuid(F.col("session_id")).alias("session_id"), "scope", "source", "content", "tool_name", "tool_call_id", "source_event_id")


def scope_of(metadata: Column, default: str) -> Column:
    """The memory scope that a run's metadata (JSON) names, else the default."""
    return F.coalesce(blank_to_null(F.get_json_object(metadata, "$.memory_scope")), F.lit(default))


def default_scope(user_id: Column) -> Column:
    return F.concat(F.lit("user:"), user_id)


def first_user_message(messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The first non-blank user message of each conversation, trimmed."""
    said = messages.where((F.col("role") == "user") & (F.length(F.trim(text)) > 0))
    return said.groupBy(key).agg(F.trim(F.min_by(text, order)).alias("query"))


def effective_queries(requests: DataFrame, messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """requests (key, query) with the conversation's first user message in place of the query, where there is one."""
    first = first_user_message(messages, key).withColumnRenamed("query", "said")
    return requests.join(first, key, "left").withColumn("query", F.coalesce("said", "query")).drop("said")


def feedback_phase(choices: DataFrame) -> DataFrame:
    """run_id, phase of choices (run_id, position, header, option): the first decisive one, else other_pending, else null."""
    decisive = F.when(F.col("option") == CANCEL, "cancelled").when((F.col("header") == OTHER_HEADER) & (F.col("option") == RECALL), "generic_recall")
    pending = (F.col("header") == PROJECT_HEADER) & (F.col("option") == OTHER)
    told = choices.groupBy("run_id", "position", "header").agg(F.min(decisive).alias("decisive"), F.max(F.coalesce(pending, F.lit(False))).alias("pending"))
    out = told.groupBy("run_id").agg(F.min_by("decisive", F.when(F.col("decisive").isNotNull(), F.col("position"))).alias("d"), F.max("pending").alias("p"))
    return out.select("run_id", F.coalesce("d", F.when(F.col("p"), "other_pending")).alias("phase"))


def intent(message: Column) -> Column:
    """workflow, issue_key and target_status that a message asks for."""
    low = F.lower(F.trim(message))
    has = lambda words: low.rlike("|".join(words))
    key = find_issue_key(message)
    flow = F.when(key.isNotNull() | has(INTENTS[0][1]), INTENTS[0][0]).when(has(INTENTS[1][1]), INTENTS[1][0]).when(has(INTENTS[2][1]), INTENTS[2][0]).otherwise("simple")
    word = "|".join(STATUSES)
    aimed = F.nullif(F.regexp_extract(low, rf"\b(?:to|into|back to)\s+({word})\b", 1), F.lit(""))
    named = F.try_element_at(F.regexp_extract_all(low, F.lit(rf"\b({word})\b"), F.lit(1)), F.lit(-1))
    status = F.when(flow == "jira", F.initcap(F.coalesce(aimed, named)))
    return F.struct(flow.alias("workflow"), F.when(flow == "jira", key).alias("issue_key"), status.alias("target_status"))


def intent_input(message: Column) -> Column:
    """intent, with what the workflow is started on: instruction, simulate_failure_at, user_id, min_quality, raw_amount."""
    low, told = F.lower(F.trim(message)), intent(message)
    flow = told["workflow"]
    has = lambda words: low.rlike("|".join(words))
    user = F.when(has(USERS[0][1]), USERS[0][0]).when(has(USERS[1][1]), USERS[1][0]).otherwise(FIRST_USER)
    return F.struct(
        flow.alias("workflow"), told["issue_key"].alias("issue_key"), told["target_status"].alias("target_status"), F.when(flow == "jira", message).alias("instruction"),
        F.when((flow == "jira") & low.rlike(FAILURE), FAILED_STEP).alias("simulate_failure_at"), F.when(flow == "medium", user).alias("user_id"),
        F.when(flow == "complex", F.lit(SAMPLE_QUALITY)).alias("min_quality"), F.when(flow == "simple", message).alias("raw_amount"),
    )
