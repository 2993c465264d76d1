"""Chat formatting: exact round trips, masks and attachments."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import chat as C
from tracewell.llm import queries

MARKS = st.text(st.sampled_from("<\\|>turnedbody\n #"), max_size=30) | st.sampled_from(["<|turn|>", "<|end|>\n", "<\\|end|>", "<\\\\|", "<|body|><|image|>", "<"])


@settings(max_examples=300, deadline=None)
@given(MARKS, MARKS, MARKS)
def test_round_trip(role, one, two):
    assert C.unescape(C.escape(one)) == one and "<|" not in C.escape(one)
    formatted, spans, _ = C.format_turn(role, [{"type": "text", "text": one}, {"type": "text", "text": two}], C.Visitor())
    got = C.parse_turn(formatted)
    # parts are escaped one by one; a mark that the seam makes of two parts is none
    assert got[0] == role and (got[1] == one + two or (one.rstrip("\\").endswith("<") and two.startswith("|")))
    assert spans == [] or role == "assistant"


def test_parts_are_flattened_in_order():
    parts = [{"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "a.png", "width": 29, "height": 14}, {"type": "audio", "ref": "b.wav", "seconds": 1.01}, None, {"type": "unheard"}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": "end"}]
    formatted, spans, attached = C.format_turn("assistant", parts, C.Visitor())
    assert formatted == "<|turn|>assistant<|body|>see <\\|image|> <|image|><|audio|><|document|>end<|end|>\n"
    assert [(a["part"], a["type"], a["ref"], a["tokens"]) for a in attached] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 26), (5, "document", "c.pdf", 1536)]
    assert all(formatted[a["start"] :].startswith(f"<|{a['type']}|>") for a in attached)
    assert formatted[spans[0][0] : spans[0][1]].startswith("see") and formatted[spans[0][1] :] == "<|end|>\n"


def test_frames(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, None, ""), (None, 0, "user", "x"), (2, 0, "assistant", "<|end|>\n"), (2, 0, "assistant", "<|end|>\n"), (2, None, "user", "first"), (3, 0, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = C.format_messages(df.withColumn("parts", C.text_part(F.col("text"))))
    got = {r.conv_id: r for r in C.digests(formatted).collect()}
    assert set(got) == {None, 1, 2, 3}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1][1:5] == (3, sha("user\n\nassistant\nb\n\n\n"), 1, sha("b"))
    assert got[2][1:5] == (3, sha("user\nfirst\n" + "assistant\n<|end|>\n\n" * 2), 16, sha("<|end|>\n" * 2))
    assert got[3].loss_chars == 100_000 and got[3].formatted_chars == 100_000 + len("<|turn|>assistant<|body|><|end|>\n")
    assert [r.seq for r in C.numbered(formatted).where("conv_id = 1").orderBy("turn").collect()] == [0, 1, 2]
    assert C.digests(C.format_messages(df.limit(0).withColumn("parts", C.text_part(F.col("text"))))).count() == 0


def test_query_equals_plain_digests(spark):
    sf = "/root/testdata/sf0.001"
    plain = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        plain.setdefault(r.conv_id, []).append((r.role, r.text))
    plain[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in queries.op7_chat(spark, sf).collect()}
    assert set(got) == set(plain)
    for conv, turns in plain.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
