"""Chat formatting by event-sourced reconstruction. Native.

A conversation's log is folded into final messages, the messages are rendered with a
template, and what was rendered can be read back exactly.

Template (fixed values): a turn is ``[INST]`` role ``[/INST]`` text ``</s>``. Inside roles and texts a
backslash is doubled, and each control string gets one backslash after its first character. An
escaped control string is the only place where a single backslash follows that first character
and precedes the string's rest, so unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, CLOSE, END)
#: Events that give a message's whole text; a delta adds to it.
WHOLE = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROL:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def final_messages(events: DataFrame) -> DataFrame:
    """Folds a log (conv_id, message, seq, kind, role, text) to one row for each final message.

    Events are taken in the order of (seq, kind, role, text), nulls first. ``message`` gives a
    complete text, ``edit`` replaces the text so far, ``regenerate`` replaces it and withdraws what
    events before it said of later messages, ``delta`` (and any other kind) appends. If all events of a
    message are ``message`` events, each stands as a turn of its own, repeated rows too. A null text is
    empty; the role is the first that isn't null, else empty. Conversations with a null id form one.
    Result: conv_id, message, part (0, 1, ... among turns of one message number), role, text.

    The window over a conversation sees the numbers (message, again) only; the logs join its result.
    """
    logs = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
    )
    w = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    narrow = events.groupBy("conv_id", "message").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    cuts = narrow.withColumn("cut", F.max("again").over(w)).filter("cut is not null").select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "cut")
    by_message = (
        logs.join(cuts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("message").eqNullSafe(F.col("m")), "left")
        .withColumn("log", F.when(F.col("cut").isNull(), F.col("log")).otherwise(F.filter("log", lambda e: e["seq"] > F.col("cut"))))
        .filter(F.size("log") > 0)
    )
    start = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*WHOLE), i))), F.lit(0))
    role = F.coalesce(F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit(""))
    body = F.array_join(F.transform(F.slice("log", start + 1, F.size("log")), lambda e: e["text"]), "")
    alone = F.transform("log", lambda e: F.struct(F.coalesce(e["role"], F.lit("")).alias("role"), e["text"].alias("text")))
    folded = F.array(F.struct(role.alias("role"), body.alias("text")))
    first = F.try_element_at(F.filter("log", lambda e: ~e["kind"].eqNullSafe(F.lit("message"))), F.lit(1))
    return by_message.select("conv_id", "message", F.posexplode(F.when(first.isNull(), alone).otherwise(folded)).alias("part", "m")).select("conv_id", "message", "part", "m.role", "m.text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: ``formatted``, and ``loss_mask`` with (turn, start, length) of the text
    that is trained on, in code points from the start of that turn.

    A conversation is one string by contract, so its turns meet in one task; every conversation is
    independent of the others.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    turns = messages.select(
        "conv_id",
        F.struct(
            "message",
            "part",
            F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END)).alias("turn"),
            F.when(F.col("role") == loss_role, F.length(role) + len(OPEN) + len(CLOSE)).alias("start"),
            F.length(text).alias("length"),
        ).alias("t"),
    )
    mask = F.transform("ts", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length")))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .select("conv_id", F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"), F.filter(mask, lambda m: m["start"].isNotNull()).alias("loss_mask"))
    )


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``final_messages``, then ``render``. An empty log gives an empty result; other columns are not read."""
    return render(final_messages(events.select("conv_id", "message", "seq", "kind", "role", "text")), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses ``formatted``: conv_id, ``turns`` (role, text) and ``loss_text``, the unescaped text under the mask."""
    pieces = F.split("formatted", END, -1)
    found = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    rest = lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1)
    role = lambda p: F.substring_index(rest(p), CLOSE, 1)
    text = lambda p: F.substr(rest(p), F.length(role(p)) + len(CLOSE) + 1)
    marked = F.transform("loss_mask", lambda m: unescape(F.substr(F.get("pieces", m["turn"]), m["start"] + 1, m["length"])))
    return found.select(
        "conv_id",
        "formatted",
        F.transform("pieces", lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text"))).alias("turns"),
        F.array_join(marked, "").alias("loss_text"),
    )
