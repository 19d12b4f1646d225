r"""Chat formatting: conversations rebuilt from their event log and rendered with a loss mask, natively.

Events are (conv_id, seq, turn, kind, role, text). In order of seq, `start` opens a turn's message with a role and an
optional text, `delta` appends to it, `edit` replaces it by its text, `regenerate` empties it for the deltas that follow.
What a turn ends as is its last opening event (start, edit or regenerate) and the deltas after it.

Template: <s> then for each turn [INST]role[/INST]text</s>. A control string inside a role or text gets a backslash after
its first character ([INST] becomes [\INST], [\INST] becomes [\\INST]), which is undone exactly when read back; so the
formatted text holds no control string that is not the template's. The loss mask is the list of spans, in code points
with the end exclusive, of the assistant texts.

A conversation is the unit of work: it becomes one row, so its turns meet in one task. Defined results: null roles and
texts are empty; a null conv_id is a conversation of its own; a delta without an opening event appends to nothing; events
with equal seq are ordered by kind and text; an empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The template's control strings.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"(/?s>|/?INST\])"
_FIRST = r"([<\[])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _CONTROL, r"$1$2$3")


def folded(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages."""
    seen = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    turns = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(seen)).alias("log"))
    opens = F.transform("log", lambda e, i: F.when(e["kind"].isin("start", "edit", "regenerate"), i).otherwise(F.lit(-1)))
    turns = turns.withColumn("last", F.array_max(opens))
    kept = F.when(F.col("last") >= 0, F.slice("log", F.col("last") + 1, F.size("log"))).otherwise(F.slice("log", 1, 0))
    text = F.array_join(F.transform(F.filter(kept, lambda e: e["kind"] != "regenerate"), lambda e: e["text"]), "")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return turns.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans) of each conversation; messages stand in order of turn."""
    piece = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE), escaped(F.col("text")), F.lit(END))
    body = F.length(escaped(F.col("text")))
    turns = messages.select("conv_id", "turn", "role", piece.alias("piece"), body.alias("body"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("upto", F.sum(F.length("piece")).over(before) + len(BEGIN) - len(END))
    span = F.struct((F.col("upto") - F.col("body")).alias("start"), F.col("upto").alias("end"))
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("upto", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"),
    )
    return whole.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """array of (role, text) from a formatted conversation."""
    turns = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), END, -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)
    head = rf"(?s)^\[INST\](.*?)\[/INST\](.*)$"
    return F.transform(turns, lambda t: F.struct(unescaped(F.regexp_extract(t, head, 1)).alias("role"), unescaped(F.regexp_extract(t, head, 2)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(formatted.substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def events_of(conversations: DataFrame) -> DataFrame:
    """The log that would have led to the rows of conversations: each text is streamed in two deltas; an assistant's after a
    first try that is regenerated, another role's after a draft that is edited."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.withColumn("n", F.row_number().over(order).cast("long"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = text.substr(F.lit(1), half), text.substr(half + 1, F.length(text))
    assistant = F.col("role").eqNullSafe("assistant")

    def event(k: int, kind: Column | str, said: Column) -> Column:
        return F.struct((F.col("n") * 8 + k).alias("seq"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.col("role") if k == 0 else F.lit(None).cast("string")).alias("role"), said.alias("text"))

    log = F.array(
        event(0, "start", F.lit("")), event(1, "delta", F.concat(F.lit("draft of "), first)),
        event(2, F.when(assistant, "regenerate").otherwise("edit"), F.when(assistant, F.lit("")).otherwise(first)),
        event(3, "delta", F.when(assistant, first).otherwise(F.lit(""))), event(4, "delta", second),
    )
    return rows.select("conv_id", F.col("n").alias("turn"), F.explode(log).alias("e")).select("conv_id", "turn", "e.*")
