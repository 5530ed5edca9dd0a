import hashlib
import random

from granary.llm import chat_format as C


def test_texts_and_roles_come_back():
    rng = random.Random(1)
    for _ in range(300):
        turns = [("".join(rng.choices("aAs:#<\\ r", k=rng.randrange(5))), "".join(rng.choices("\\#<>/turnblhc: \n", k=rng.randrange(30)))) for _ in range(rng.randrange(1, 6))]
        for _, text, i, j in C.expand(turns, "a"):
            back = C.read_back(text)
            assert back == turns[: len(back)]
            if j > i:
                assert C.unescape(text[i:j]) == back[-1][1]


def test_no_control_string_survives_in_a_text():
    piece, i, j = C.format_turn("user", C.HARD_TEXT + " ### </turn>")
    assert "###" not in piece[i:j] and "</turn>" not in piece[i:j]


def test_one_example_for_each_reply(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"), (2, 0, "user", "alone"), (None, None, None, None), (1, 4, "user", "tail")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", C.F.lit(1)).withColumn("example", C.F.lit(2))
    ex = C.format_conversations(df)
    got = {(r.conv_id, r.example): (r.target, r.text[r.loss_start : r.loss_end]) for r in ex.collect()}
    assert got == {(1, 0): (1, "a1"), (1, 1): (3, ""), (1, 2): (-1, ""), (2, 0): (-1, ""), (None, 0): (-1, "")}
    d = {r.conv_id: r for r in C.digests(ex).collect()}
    assert d[1].n_turns == 6 and d[1].loss_chars == 2 and d[None].n_turns == 1
    assert C.format_conversations(df.limit(0)).count() == 0


def test_a_long_conversation_travels_by_digest(spark):
    """1000 turns, half of them replies: the examples hold over 60 MB together, no row of the digest over 0.25 MB."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"{k} " + "x" * 250) for k in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    d = C.digests(C.format_conversations(df)).first()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    loss = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (d.n_turns, d.turns_sha256, d.n_examples) == (1000, hashlib.sha256(said.encode()).hexdigest(), 500)
    assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert d.formatted_chars == sum(len(t) for _, t, _, _ in C.expand([(r, t) for _, _, r, t in rows]))


def test_a_very_long_text(spark):
    text = "\\#<é" * 300_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_conversations(df)).first().loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
