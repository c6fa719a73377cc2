r"""Chat formatting from an event log, DataFrame functions only.

Events (conv_id, seq, turn, kind, role, text) are partitioned by conversation and sorted by
sequence.  A ``message`` opens a message at its turn; an ``edit`` or ``regenerate`` replaces the
text of the newest message at that turn; a ``delta`` appends to it.  Deltas of a turn that no
``message`` opened open one themselves.  Messages are folded and rendered before a conversation
is put together, so a long conversation gathers only finished pieces.

Template, for each message::

    <|start|>role<|sep|>text<|end|>

Inside roles and texts a backslash is doubled, and one backslash goes behind the first character
of each control string (``<|``, ``<s>``, ``</s>``, ``<<SYS``, ``[INST]``, ``[/INST]``), so that no
marker can appear there and removing one backslash of each pair gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
CONTROL = r"(<(?=\||/?s>|<SYS)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, gen, role, text) of an event log.

    Nulls: a null text is empty, a null kind is ``message``, the last role that is not null counts
    (empty if there is none); null conversations and turns are values of their own and sort first.
    Events with equal seq sort by kind (message first), role and text, so repeated rows give the
    same result in any order; each repeated ``message`` is a message.
    """
    kind = F.lower(F.coalesce(F.col("kind"), F.lit("message")))
    level = F.when(kind == "message", 0).when(kind == "delta", 2).otherwise(1)
    ev = events.select("conv_id", "seq", "turn", level.alias("level"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    opened = Window.partitionBy("conv_id", "turn").orderBy("seq", "level", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("gen", F.sum((F.col("level") == 0).cast("long")).over(opened))
    log = F.array_sort(F.collect_list(F.struct("seq", "level", "text", "role")))
    log = ev.groupBy("conv_id", "turn", "gen").agg(log.alias("log"))
    base = F.greatest(F.lit(1), F.array_max(F.transform("log", lambda e, i: F.when(e["level"] < 2, i + 1).otherwise(0))))
    parts = F.slice("log", base, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return log.select("conv_id", "turn", "gen", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(parts, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` are (start, end) code points of the escaped texts of role ``learn`` in ``formatted``.
    """
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    pieces = messages.select("conv_id", "turn", "gen", (F.col("role") == learn).alias("learn"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(END)).alias("piece"))
    before = Window.partitionBy("conv_id").orderBy("turn", "gen").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head"))
    turns = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "gen", "at", "body", "learn", "piece"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["at"].cast("long").alias("start"), (t["at"] + t["body"]).cast("long").alias("end")))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Event log to formatted conversations; an empty log gives no rows, other columns are ignored."""
    return render(fold_events(events), learn)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, from the formatted string and its mask alone."""
    raw = F.filter(F.split("formatted", r"<\|end\|>"), lambda t: t != "")
    parts = F.transform(raw, lambda t: F.split(F.substr(t, F.lit(len(START) + 1)), r"<\|sep\|>"))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as an event log: one message a row."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")
