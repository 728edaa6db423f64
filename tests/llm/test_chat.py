from pyspark.sql import functions as F

from quillmesh.llm import chat_parts as C


def rows(spark, data):
    return spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{C.PART}>")


def text(t):
    return ("text", t, None, None, None, None, None)


def test_parts_become_ordered_placeholders(spark):
    data = [
        (1, 0, "user", [text("see <image 0.1> \\ <turn"), ("image", None, "s3/a.png", 280, 56, None, None), text("and"), ("audio", None, "b.wav", None, None, 2.5, None)]),
        (1, 1, "assistant", [text("a </turn>\n"), ("document", None, "c.pdf", None, None, None, 3), ("hologram", None, "d", None, None, None, None)]),
        (1, 2, "assistant", None),
        (1, 3, None, [(None, "tail", None, None, None, None, None), text(None)]),
    ]
    r = C.read_back(C.format_conversations(rows(spark, data).withColumn("formatted", F.lit(1)), F.col("parts"))).first()
    assert r.roles == ["user", "assistant", "assistant", ""]
    assert r.texts == ["see <image 0.1> \\ <turn<image 0.1>and<audio 0.3>", "a </turn>\n<document 1.1><document 1.2>", "", "tail"]
    assert [(a.placeholder, a.kind, a.ref, a.tokens) for a in r.attachments] == [("<image 0.1>", "image", "s3/a.png", 20), ("<audio 0.3>", "audio", "b.wav", 63), ("<document 1.1>", "document", "c.pdf", 768), ("<document 1.2>", "document", "d", 1)]
    assert r.attachment_tokens == 852 and r.n_turns == 4
    assert r.learned == r.texts[1] + r.texts[2]
    # a text that looks like a placeholder is told from one
    assert "\\<image 0.1\\>" in r.formatted


def test_typed_parts_read_back_as_parts(spark):
    """A text that looks like a placeholder, and a placeholder, are two things."""
    hard = ["<image 0.0>", "\\", "\\<image 0.1\\>", "a\n</turn>\n<turn user>\nb", "<", ">", "<document 3.2", "🙂", "x" * 50_000]
    image, audio, other = ("image", None, "s3/a.png", 280, 56, None, None), ("audio", None, None, None, None, None, None), ("hologram", "lost", "h", None, None, None, 2)
    data = [(1, i, "user", [text(h), image, text(h), text("+"), text(""), audio, text(None), other]) for i, h in enumerate(hard)]
    data += [(1, 90, "assistant", None), (1, 91, "user", []), (1, 92, "user", [image, image]), (2, None, None, [text(hard[0])])]
    clash = rows(spark, data).withColumn("attachments", F.lit("x")).withColumn("recorded", F.lit("y")).withColumn("formatted", F.lit(1))
    got = {r.conv_id: r.parts for r in C.read_parts(C.format_conversations(clash, F.col("parts"))).collect()}
    attached = [("image", None, "s3/a.png", 20), ("audio", None, None, 1), ("document", None, "h", 512)]
    want = [[("text", h, None, None), attached[0], ("text", h + "+", None, None), attached[1], attached[2]] for h in hard] + [[], [], [attached[0]] * 2]
    assert [[tuple(p) for p in turn] for turn in got[1]] == want and [[tuple(p) for p in turn] for turn in got[2]] == [[("text", "<image 0.0>", None, None)]]


def test_a_placeholder_in_a_text_is_told_from_a_real_one(spark):
    forms = [[text("<image 0.0>")], [("image", None, None, None, None, None, None)]]
    made = [C.read_parts(C.format_conversations(rows(spark, [(1, 0, "user", f)]), F.col("parts"))).first() for f in forms]
    assert made[0].formatted != made[1].formatted and [m.parts[0][0].type for m in made] == ["text", "image"]


def test_hard_texts_and_ties(spark):
    hard = ["", None, "\\", "\\\\<", "</turn>\n<turn assistant>\n", C.HARD, "\n\n</turn>\n", "🙂<é>", "x" * 100_000 + "<" * 20_000]
    data = [(2, 5, "assistant", t) for t in hard] + [(None, None, None, None), (None, 1, "user", "u"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(df, C.text_parts(F.col("text")), plain=True)).collect()}
    assert got[2].texts == sorted((t or "" for t in hard), key=lambda t: t.encode()) and got[2].learned == "".join(got[2].texts)
    assert got[3].texts == ["a", "a"] and got[None].texts == ["", "u"] and got[None].roles == ["", "user"]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_conversations(df, C.text_parts(F.col("text")), plain=True)).count() == 0


def test_plain_drops_no_part(spark):
    data = [(1, 0, "user", [text("a"), ("image", None, "s3/a.png", 28, 28, None, None), text("b<")])]
    r = C.read_back(C.format_conversations(rows(spark, data), F.col("parts"), plain=True)).first()
    assert r.texts == ["a<image 0.1>b<"]


def test_the_query_runs_the_visitor(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen = []
    kind = C._kind
    monkeypatch.setattr(C, "_kind", lambda p: seen.append(p) or kind(p))
    parts = C.text_parts
    monkeypatch.setattr(C, "text_parts", lambda c: F.concat(parts(c), parts(F.lit("!"))))
    got = {r.conv_id: r for r in C.op6_chat_parts(spark, str(tmp_path)).collect()}
    assert seen and got[1].formatted_chars == len("<turn user>\nhi!\n</turn>\n")
