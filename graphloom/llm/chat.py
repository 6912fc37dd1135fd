"""Chat formatting from event logs, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template's own marks and those of common chat formats; fixed values. A backslash before one makes it text.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z_]*\|>"
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Code points of a streamed delta.
DELTA = 256


def escaped(text: Column) -> Column:
    """text with one more backslash before every control string; unescaped() undoes it exactly."""
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def role_line(role: Column) -> Column:
    """role on one line, reversibly: backslashes doubled, newlines as a backslash and n, control strings escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def role_back(line: Column) -> Column:
    """What role_line() was given: an odd number of backslashes before an n ends in a newline."""
    return F.replace(F.regexp_replace(unescaped(line), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), F.lit("\\\\"), F.lit("\\"))


def event_log(conversations: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) as the log (conv_id, seq, turn, kind, role, text) of how it came about.

    A user's message is sent without its last part and then edited to the whole. Any other is streamed: a start, a
    first attempt of one delta, a regeneration, and the text in deltas of DELTA code points. Rows of a conversation are
    numbered by turn, role and text; nothing of the table is in one event alone that a fold could pass on as it is.
    """
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(own).cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    draft = F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit(""))
    edited = F.array(event("message", F.col("role"), draft), event("edit", none, F.col("text")))
    streamed = F.concat(F.array(event("message", F.col("role"), F.lit("")), event("delta", none, draft), event("regenerate", none, F.lit(""))), F.transform("parts", lambda p: event("delta", none, p)))
    events = rows.withColumn("parts", parts).select("conv_id", "turn", F.posexplode(F.when(F.col("role") == "user", edited).otherwise(streamed)).alias("place", "e"))
    return events.select("conv_id", (F.col("turn") * (1 << 32) + F.col("place")).alias("seq"), "turn", "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log (conv_id, seq, turn, kind, role, text).

    kind: `message` and `regenerate` start a turn's text anew, `edit` replaces it, `delta` appends. What counts
    for a turn is its last start and the deltas after it, in order of seq (ties by kind and text, so that
    repeated rows have one order; null seq first). A role of null is taken from the turn's last event that has
    one, else is empty; null texts are empty; an unknown or null kind counts as `message`. A turn without any
    start begins with its first delta. Rows are dealt by conversation and turn, so a long log isn't one task's.
    """
    own = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "text")
    starts = F.sum(F.when(F.col("kind") == "delta", 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    clean = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    return (
        clean.select("*", starts.alias("start"), F.row_number().over(own).alias("place"))
        .groupBy("conv_id", "turn", "start")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text"), F.max(F.when(F.col("role").isNotNull(), F.struct("place", "role"))).alias("named"))
        .groupBy("conv_id", "turn")
        .agg(F.max_by("text", "start").alias("text"), F.max("named").alias("named"))
        .select("conv_id", "turn", F.coalesce(F.col("named.role"), F.lit("")).alias("role"), "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start from 0 and length, code points) of each conversation's messages.

    A turn is OPEN, the role on one line, newline, escaped text, newline, CLOSE, newline; the loss mask covers the escaped texts
    of assistant turns. Turns stand by turn, then role and text; a conversation is one row, since its rendering is.
    """
    body = escaped(F.col("text"))
    lead = F.concat(F.lit(OPEN), role_line(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts.select("conv_id", "turn", "role", "text", lead.alias("lead"), body.alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.concat("lead", "body", F.lit(f"\n{CLOSE}\n"))
    ends = F.sum(F.char_length(whole)).over(order)
    placed = parts.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("place"),
        whole.alias("part"),
        F.when(F.col("role") == "assistant", F.struct((ends - F.char_length(whole) + F.char_length("lead")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))).alias("loss"),
    )
    turns = F.array_sort(F.collect_list(F.struct("place", "part", "loss")))
    return (
        placed.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select("conv_id", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), F.transform(F.filter("turns", lambda t: t["loss"].isNotNull()), lambda t: t["loss"]).alias("loss_spans"))
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    parts = F.filter(F.split(formatted, rf"(?<!\\){OPEN.replace('|', chr(92) + '|')}"), lambda x: x != "")

    def turn(x: Column) -> Column:
        lead = F.instr(x, "\n")
        return F.struct(role_back(F.substring(x, F.lit(1), lead - 1)).alias("role"), unescaped(F.substring(x, lead + 1, F.char_length(x) - lead - len(f"\n{CLOSE}\n"))).alias("text"))

    return F.transform(parts, turn)


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rendered conversations of a table (conv_id, turn, role, text), folded from the log of its events.

    Null texts are empty; a null role is an empty one; null turns come first; rows with a null conv_id are one
    conversation; several rows of one turn are different messages; other columns are ignored.
    """
    return render(fold(event_log(conversations)))


def digests(rendered: DataFrame) -> DataFrame:
    """What the formatted output holds, read back from it."""
    turns = read_back(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    got = rendered.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "utf-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
