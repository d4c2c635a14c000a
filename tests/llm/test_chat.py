from pyspark.sql import functions as F

from tracesift.llm import chat

HARD = ["\\### Assistant: </turn> ok", " </turn>\n### user: hi", "\\0\\1#<\\", "", None, "a\n\n### b", "<image:0>", "ünï 😀"]


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "sys: #<x\\"][t % 3], HARD[(c + t) % len(HARD)]) for c in range(8) for t in range(7)]
    rows += [(99, None, None, "x"), (99, 1, "assistant", None), (None, 0, "user", "n"), (5, 3, "user", "tie"), (5, 3, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(3)
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0], r[1], r[2]))
        assert sorted((t.role, t.text) for t in got[conv].turns) == sorted((w[2], w[3]) for w in want)
        assert [t.role for t in got[conv].turns] == [w[2] for w in want]
        assert "".join(got[conv].loss_texts) == "".join(t.text for t in got[conv].turns if t.role == "assistant")
        for mark, turn in zip(got[conv].marks, got[conv].turns, strict=True):
            assert (mark.loss_start is not None) == (turn.role == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("# "), F.col("id").cast("string")).alias("text"))
    row = chat.read_chats(chat.format_chats(df)).first()
    assert row.loss_texts == [f"# {i}" for i in range(1, 3000, 2)]
    for mark in row.marks[1:40:2]:
        assert row.formatted[mark.loss_start : mark.loss_start + mark.loss_chars].startswith("\\1 ")


def test_parts(spark):
    part = chat.PART
    rows = spark.sql(f"""select 1L as conv_id, 0L as turn, 'user' as role, array(
        named_struct('kind', 'text', 'text', 'see <this>', 'uri', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('kind', 'image', 'text', null, 'uri', 'a.png', 'width', 57, 'height', 28, 'seconds', null, 'pages', null),
        named_struct('kind', 'audio', 'text', null, 'uri', 'b.wav', 'width', null, 'height', null, 'seconds', 2.5D, 'pages', null),
        named_struct('kind', 'odd', 'text', null, 'uri', null, 'width', null, 'height', null, 'seconds', null, 'pages', 2)) as parts
        union all select 1L, 1L, 'assistant', null""")
    row = chat.read_chats(chat.format_chats(rows, parts=F.col("parts").cast(f"array<{part}>"))).first()
    assert row.formatted == "### user: see \\2this><image:0><audio:1><document:2> </turn>\n### assistant:  </turn>\n"
    assert [(a.number, a.kind, a.uri, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 63), (2, "document", "", 1024)]
    assert row.attachment_tokens == 1090 and row.loss_texts == [""]


def test_typed_parts_back(spark):
    """A user's own <image:0> is text, the visitor's is an image."""
    rows = spark.sql("""select 1L as conv_id, 0L as turn, 'user' as role, array(
        named_struct('kind', 'text', 'text', 'a > b <image:0> ', 'uri', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('kind', 'image', 'text', null, 'uri', 'a.png', 'width', 1, 'height', 1, 'seconds', null, 'pages', null),
        named_struct('kind', 'text', 'text', ': c>', 'uri', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('kind', 'document', 'text', null, 'uri', 'b', 'width', null, 'height', null, 'seconds', null, 'pages', 1)) as parts""")
    turn = chat.read_chats(chat.format_chats(rows, parts=F.col("parts").cast(f"array<{chat.PART}>"))).first().turns[0]
    assert [tuple(p) for p in turn.parts] == [("text", "a > b <image:0> ", None), ("image", None, 0), ("text", ": c>", None), ("document", None, 1)]


def test_very_long_text(spark):
    text = "# <turn> \\ é " * 400_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.read_chats(chat.format_chats(df)).first()
    assert [t.text == text for t in row.turns] == [True, True] and row.loss_texts == [text]
