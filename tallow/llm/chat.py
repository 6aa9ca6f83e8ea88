"""Chat logs to training text, with DataFrame functions only.

Event-sourced reconstruction: a log of message, delta, edit and regenerate
events is folded, in sequence order within its conversation, into final
messages, which are rendered with a template. Control strings inside texts are
escaped reversibly, so the rendered text can be read back.

Template: an assistant turn is <s>TEXT</s>; any other is [INST]ROLE newline TEXT[/INST].
Escapes: backslash is \\e; the first character of a control string becomes \\l (<) or \\b ([).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"<(?=/?s>)"
CONTROL_BRACKET = r"\[(?=/?INST\])"
TURN = r"(?s)<s>(.*?)</s>|\[INST\](.*?)\[/INST\]"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return F.regexp_replace(F.regexp_replace(text, CONTROL, r"\\l"), CONTROL_BRACKET, r"\\b")


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, kind, turn, role, text).

    kind: message starts a turn; delta adds text to it; edit replaces its text; regenerate empties it
    and withdraws the later turns logged so far. Null texts are empty; null kinds count as message.
    Events with equal seq (as of repeated rows) are taken in the order of turn, kind, role, text. A delta of a turn that no
    event started starts it. Events without a turn are those of the last one, so a regenerate that follows withdraws
    them. A null conv_id is a conversation. An empty log gives no messages; long texts stay whole; other columns
    are not read. A conversation is one unit of output and is folded in one task.
    """
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_last(), F.col("turn").asc_nulls_last(), "kind", "role", "text")
    e = e.withColumn("_at", F.row_number().over(log))
    later = log.rowsBetween(1, Window.unboundedFollowing)
    e = e.withColumn("_withdrawn", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later))
    e = e.where(F.col("_withdrawn").isNull() | (F.col("turn") <= F.col("_withdrawn")))
    turn = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("_reset", F.max(F.when(F.col("kind") != "delta", F.col("_at"))).over(turn))
    e = e.where(F.col("_reset").isNull() | (F.col("_at") >= F.col("_reset")))
    parts = F.array_sort(F.collect_list(F.struct("_at", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text"))))
    folded = e.groupBy("conv_id", "turn").agg(F.min_by("role", "_at").alias("role"), parts.alias("_parts"))
    return folded.select("conv_id", "turn", "role", F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))


def render_messages(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted. Turns in order (null last; equal ones by their text).

    Null roles and texts must be empty strings, as fold_events gives them. No messages give no rows; long texts stay whole.
    """
    body = F.when(F.col("role") == "assistant", F.concat(F.lit("<s>"), escape(F.col("text")), F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), escape(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit("[/INST]")))
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", body.alias("body"))))
    return messages.groupBy("conv_id").agg(turns.alias("_t")).select("conv_id", F.array_join(F.transform("_t", lambda x: x["body"]), "").alias("formatted"))


def read_back(formatted: DataFrame, col: str = "formatted") -> DataFrame:
    """formatted with the array column messages (role, text), read from the rendered text alone. An empty or null text has none."""
    found = F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(TURN), F.lit(0))
    inner = lambda x, a, b: F.substring(x, F.lit(a + 1), F.length(x) - F.lit(a + b))

    def parse(x: Column) -> Column:
        assistant = x.startswith("<s>")
        told = inner(x, 6, 7)
        role = F.when(assistant, F.lit("assistant")).otherwise(unescape(F.substring_index(told, "\n", 1)))
        text = F.when(assistant, unescape(inner(x, 3, 4))).otherwise(unescape(F.substring(told, F.instr(told, "\n") + 1, F.length(told))))
        return F.struct(role.alias("role"), text.alias("text"))

    return formatted.withColumn("messages", F.transform(found, parse))


CHUNK = 4096  # code points of a streamed delta


def events_of(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Stored conversations (conv_id, turn, role, text) as the log that made them; repeated turns are messages of their own.

    An assistant's turn is a message without text and the deltas of at most `chunk` code points that filled it; any other
    turn is one message.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    at = F.row_number().over(order)
    whole = F.array(F.struct(F.lit("message").alias("kind"), F.coalesce("text", F.lit("")).alias("text")))
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / chunk).cast("int"))
    deltas = F.transform(starts, lambda i: F.struct(F.lit("delta").alias("kind"), F.substring("text", i * chunk + 1, F.lit(chunk)).alias("text")))
    streamed = F.concat(F.array(F.struct(F.lit("message").alias("kind"), F.lit("").alias("text"))), deltas)
    numbered = conversations.select("conv_id", at.alias("turn"), "role", "text")
    log = numbered.select("conv_id", "turn", "role", F.posexplode(F.when((F.col("role") == "assistant") & F.col("text").isNotNull(), streamed).otherwise(whole)).alias("step", "event"))
    return log.select("conv_id", F.struct("turn", "step").alias("seq"), "event.kind", "turn", "role", "event.text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and messages (read back) of each conversation.

    Stored rows become a log of messages and deltas (events_of), repeated ones too; nulls and odd turns are taken as fold_events says. An empty table gives no rows.
    """
    return read_back(render_messages(fold_events(events_of(conversations))))
