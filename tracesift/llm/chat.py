"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order:
text is escaped, every other part becomes a numbered placeholder, its attachment reference is recorded
and the tokens it will expand to are counted. Turns are then marked and joined to one string per
conversation, with the spans that count for the loss.

The template marks a turn as "### role: text </turn>" and a line feed. Inside texts and roles the characters that control
strings are made of are escaped: a backslash as \\0, # as \\1, < as \\2, and in roles : as \\3. References stay beside the string. So no text can hold a turn mark or a placeholder, and undoing the escapes
gives back the text exactly.

Defined cases: a null text or role is an empty one; a null turn sorts before all others, equal turns sort
by role and text; repeated rows are repeated turns; rows with a null conversation id form one conversation.
A part of an unknown kind is a document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_START, ROLE_END, TURN_END = "### ", ": ", " </turn>\n"
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of attachments: an image's by patches of so many pixels a side, audio's by the second, a document's by the page.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("#"), F.lit("\\1")), F.lit("<"), F.lit("\\2"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\3"))


def unescaped(text: Column) -> Column:
    """Undoes escaped() and escaped_role()."""
    for code, char in (("\\3", ":"), ("\\2", "<"), ("\\1", "#"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_parts(text: Column) -> Column:
    """One text part, as content of a turn that is plain text."""
    return F.array(F.from_json(F.lit("{}"), PART).withField("kind", F.lit("text")).withField("text", F.coalesce(text, F.lit(""))))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; a text part has none of these."""
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS)
    return F.when(part["kind"] == "text", 0).when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).otherwise(F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS).cast("long")


def visit(parts: Column) -> Column:
    """A turn's content: its string, with placeholders numbered from 0, and its attachments."""
    attached = F.filter(parts, lambda p: ~p["kind"].eqNullSafe("text"))
    number = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda p: ~p["kind"].eqNullSafe("text")))
    kind = lambda p: F.when(p["kind"].isin("image", "audio"), p["kind"]).otherwise("document")
    flat = F.transform(parts, lambda p, i: F.when(p["kind"].eqNullSafe("text"), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind(p), F.lit(":"), number(i).cast("string"), F.lit(">"))))
    return F.struct(
        F.array_join(flat, "").alias("content"),
        F.transform(attached, lambda p, i: F.struct(i.alias("number"), kind(p).alias("kind"), F.coalesce(p["uri"], F.lit("")).alias("uri"), part_tokens(p).alias("tokens"))).alias("attachments"),
    )


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, loss_role: str = "assistant") -> DataFrame:
    """A row per conversation: conv_id, n_turns, formatted, marks (for each turn its start and, if it counts for
    the loss, start and length of its content, all in code points), attachments (turn number, number within the
    turn, kind, uri, tokens) and attachment_tokens.

    parts: each row's content as an array of PART; the column text unless given.
    """
    content = text_parts(F.col("text")) if parts is None else F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), visit(content).alias("made"))
    head = F.concat(F.lit(TURN_START), escaped_role(F.col("role")), F.lit(ROLE_END))
    turns = turns.select("*", F.length(head).cast("long").alias("head_chars"), F.concat(head, "made.content", F.lit(TURN_END)).alias("piece"))
    # Places come from running sums, so that a conversation of any length is marked in one pass.
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "piece")
    turns = turns.select(
        "conv_id", "piece", "head_chars",
        F.row_number().over(order).cast("long").alias("number"),
        (F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")).alias("start"),
        F.when(F.col("role") == loss_role, F.length("made.content").cast("long")).alias("loss_chars"),
        F.col("made.attachments").alias("attachments"),
    )
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("number", "piece", "start", "head_chars", "loss_chars", "attachments"))).alias("rows"))
    made = rows.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join("rows.piece", "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["start"].alias("start"), F.when(r["loss_chars"].isNotNull(), r["start"] + r["head_chars"]).alias("loss_start"), r["loss_chars"].alias("loss_chars"))).alias("marks"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["number"].alias("turn_number"), a["number"].alias("number"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )
    return made.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_parts(content: Column) -> Column:
    """The typed parts of a turn's content: kind, text (of text parts) and number (of others). Texts hold no < that isn't escaped,
    so a < begins a placeholder, and a user's own <image:0> stays text. Neighbouring texts were joined; empty ones are left out."""
    def of(piece: Column) -> Column:
        inside = F.split(F.substring_index(F.substring(piece, 2, 2**31 - 1), ">", 1), ":")
        placeholder = F.struct(F.get(inside, F.lit(0)).alias("kind"), F.lit(None).cast("string").alias("text"), F.get(inside, F.lit(1)).cast("int").alias("number"))
        text = lambda t: F.struct(F.lit("text").alias("kind"), unescaped(t).alias("text"), F.lit(None).cast("int").alias("number"))
        after = F.substring(piece, F.position(F.lit(">"), piece) + 1, F.length(piece))
        return F.when(piece.startswith("<"), F.array(placeholder, text(after))).otherwise(F.array(text(piece)))

    return F.filter(F.flatten(F.transform(F.split(content, "(?=<)"), of)), lambda p: p["text"].isNull() | (p["text"] != ""))


def read_chats(df: DataFrame) -> DataFrame:
    """Reads formatted conversations back. Adds turns (role, text and its typed parts) and loss_texts, what the marks cover."""
    pieces = F.split("formatted", TURN_END.replace("\n", "\\n"), -1)
    colon = lambda p: F.position(F.lit(ROLE_END), p)
    content = lambda p: F.substring(p, colon(p) + len(ROLE_END), F.length(p))
    turns = F.transform(F.slice("pieces", 1, F.size("pieces") - 1), lambda p: F.struct(
        unescaped(F.substring(p, F.lit(len(TURN_START) + 1), colon(p) - len(TURN_START) - 1)).alias("role"),
        unescaped(content(p)).alias("text"), read_parts(content(p)).alias("parts"),
    ))
    covered = F.filter(
        F.zip_with(F.slice("pieces", 1, F.size("pieces") - 1), F.col("marks"), lambda p, m: unescaped(F.substring(p, (m["loss_start"] - m["start"] + 1).cast("int"), m["loss_chars"].cast("int")))),
        lambda text: text.isNotNull(),
    )
    return df.withColumn("pieces", pieces).select(*df.columns, turns.alias("turns"), covered.alias("loss_texts"))
