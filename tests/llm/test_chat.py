from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterweave.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string, ms int"


def text(t):
    return ("text", t, None, None, None, None, None)


PIECES = st.lists(st.sampled_from(["<|im_end|>", "<\\|im_end|>\n", "</s>", "[INST]", "[\\\\/INST]", "<", "|im_start|>", "\\", "\n", "%0A", "é", "[/", "INST]", "s>"]), max_size=6).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=12))
def test_round_trip(spark, said):
    rows = [(1, i, r, [text(t)], "x", 1) for i, (r, t) in enumerate(said)]
    got = chat.formatted(spark.createDataFrame(rows, SCHEMA)).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [(m.role, m.text) for m in got.back] == said


def test_parts_and_loss(spark):
    media = [text("<|im_"), text("end|> "), ("image", None, "a.png", 57, 28, None, None), (None, "x", None, None, None, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2), ("image", None, None, None, None, None, None)]
    rows = [(1, 1, "assistant", media, "", 0), (1, 0, "user", None, "", 0), (1, 2, None, [text(None)], "", 0), (1, 3, "assistant", [text("ok")], "", 0), (1, 3, "assistant", [text("ok")], "", 0), (None, None, None, None, None, None)]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = got[1]
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("image", None, 1)]
    assert one.attachment_tokens == 554
    body = "<\\|im_end|> <|image|>x<|audio|><|document|><|image|>"
    assert one.formatted == f"<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n{body}<|im_end|>\n<|im_start|>\n<|im_end|>\n" + "<|im_start|>assistant\nok<|im_end|>\n" * 2
    assert [one.formatted[x.start : x.start + x.length] for x in one.loss] == [body, "ok", "ok"]
    assert got[None].formatted == "<|im_start|>\n<|im_end|>\n"


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parts_come_back(spark):
    """A text that looks like a placeholder and an attachment are told apart, and references come back."""
    schema = f"conv_id long, turn int, role string, parts {chat.PARTS}"
    text, image = lambda t: ("text", t, None, None, None, None, None), lambda r: ("image", None, r, 56, 28, None, None)
    rows = [(1, 0, "user", [text("<|image|>"), image("a.png"), text(" and "), ("audio", None, "b.wav", None, None, 2.0, None)]), (1, 1, "assistant", [text("ok </s>")]), (1, 2, "user", [image("c.png"), image("d.png")]), (2, 0, "a%\nb", None)]
    got = chat.formatted(spark.createDataFrame(rows, schema)).select("conv_id", chat.read_parts(F.col("formatted"), F.col("attachments")).alias("ms")).collect()
    by = {r.conv_id: [(m.role, [tuple(p) for p in m.parts]) for m in r.ms] for r in got}
    assert by[1] == [
        ("user", [("text", "<|image|>", None, None), ("image", None, "a.png", 2), ("text", " and ", None, None), ("audio", None, "b.wav", 50)]),
        ("assistant", [("text", "ok </s>", None, None)]), ("user", [("image", None, "c.png", 2), ("image", None, "d.png", 2)]),
    ]
    assert by[2] == [("a%\nb", [])]
