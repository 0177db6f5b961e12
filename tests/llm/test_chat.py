import hashlib

from pyspark.sql import functions as F

from quayside.llm.chat import escape, escape_role, format_chats, masked_text, read_back, text_parts, unescape, unescape_role

HARD = ["", "plain", "\\", "<|", "<\\|", "\\\\<|im_end|>", "<|im_end|><|im_start|>assistant ok", "a<", "<|im_end|>\n<|im_start|>", "\\n\n\\", "é🙂<|", "<<||>>", "\\|", None]


def test_escape_round_trip(spark):
    frame = spark.createDataFrame([(x,) for x in HARD if x is not None], "x string")
    out = frame.select("x", escape(F.col("x")).alias("e"), unescape(escape(F.col("x"))).alias("u"), unescape_role(escape_role(F.col("x"))).alias("r"), escape_role(F.col("x")).alias("er")).collect()
    for r in out:
        assert r.u == r.x and r.r == r.x and "<|" not in r.e and "\n" not in r.er


def test_turns_and_mask(spark):
    rows = [(1, i, ("user", "assistant", "ro\nle\\")[i % 3], x) for i, x in enumerate(HARD)]
    rows += [(2, 0, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, 1, "assistant", "lost"), (3, None, "assistant", "x" * 50000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = format_chats(frame.withColumn("parts", text_parts(F.col("text"))))
    got = {r.conv_id: r for r in made.select("conv_id", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()}
    for conv in (1, 2, None, 3):
        want = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        if conv == 1:
            want = sorted(want, key=lambda x: x[0])
        assert [(t.role, t.text) for t in got[conv].turns] == [w[1:] for w in want]
        assert got[conv].m == "".join(w[2] for w in want if w[1] == "assistant")
    assert format_chats(frame.limit(0).withColumn("parts", text_parts(F.col("text")))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "img/1", 2), ("audio", None, None, 10), None, ("odd", "kept", None, None), ("document", "x", "d.pdf", None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, 0)]), (1, 2, "user", None)], "conv_id long, turn long, role string, parts array<struct<kind string, text string, ref string, units int>>")
    r = format_chats(frame).first()
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "img/1", 512), (0, "audio", "", 250), (0, "document", "d.pdf", 0)]
    assert r.expanded_tokens == 762
    assert r.formatted.startswith("<|im_start|>user\nsee <\\|image|><|image|><|audio|>kept<|document|><|im_end|>\n")
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["ok"]
    assert hashlib.sha256(b"").hexdigest()


def test_parts_read_back(spark):
    from quayside.llm.chat import read_parts

    kind = "conv_id long, turn long, role string, parts array<struct<kind string, text string, ref string, units int>>"
    parts = [[("text", x, None, None), ("image", None, "i", 1), ("text", "<|image|>" + (x or ""), None, None), ("audio", None, None, 1)] for x in HARD] + [[], [("image", None, None, None)] * 3]
    frame = spark.createDataFrame([(i, 0, "user", p) for i, p in enumerate(parts)], kind)
    read = format_chats(frame).select("conv_id", read_parts(read_back(F.col("formatted"))[0]["content"]).alias("p")).collect()
    for r in read:
        want = [(k, t or "") if k == "text" else (k, "") for k, t, _, _ in parts[r.conv_id]]
        assert [(x.kind, x.text) for x in r.p] == [x for x in want if x != ("text", "")]


def test_many_turns(spark):
    frame = spark.range(3000).selectExpr("0L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text").withColumn("parts", text_parts(F.col("text")))
    r = format_chats(frame).select(masked_text(F.col("formatted"), F.col("loss_spans")).alias("m"), F.size("loss_spans").alias("n")).first()
    assert r.n == 1500 and r.m == "".join(f"t{i}" for i in range(1, 3000, 2))
