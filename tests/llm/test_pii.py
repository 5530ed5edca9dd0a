import random
import re
import time

import pytest

from granary.llm import pii as P

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for kind in P.KINDS:
        for m in PLAIN[kind].finditer(text):
            d = P.digits_of(m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(d) <= 19 and P.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]  # noqa: B023
            if ok():
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices("a1b2.@-+ ()_9%é", k=rng.randrange(60)))
        assert P.base_spans(text) == plain(text), text
    writer = P.Writer(8)
    for _ in range(200):
        text = " ".join(writer.window()[0] for _ in range(2))
        assert P.base_spans(text) == plain(text)


def test_linear_on_hostile_texts():
    for text in ("0" * 5000 + "1.1.1.1", "9" * 5000 + ".1.1.1", "1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 100_000, "@" * 100_000):
        P.base_spans(text)


def test_ip_parts_of_any_length():
    text = "0" * 5000 + "1.1.1.1 and " + "9" * 5000 + ".1.1.1"
    assert P.base_spans(text) == [("ip", 0, 5007)]


def slow_reconciled(text, base, found):
    """Each span against all that are taken."""
    taken, out = [(i, j) for _, i, j in base], []
    for kind, i, j, _ in sorted(set(found), key=lambda x: (x[1] - x[2], x[3], x[1], x[0])):
        while i < j and text[i] in " \n,;:(" and not (kind == "phone" and text[i] == "("):
            i += 1
        while j > i and text[j - 1] in " \n,;:.":
            j -= 1
        if P.valid(kind, text[i:j]) and not any(a < j and i < b for a, b in taken):
            taken.append((i, j))
            out.append((kind, i, j))
    return sorted([*base, *out], key=lambda x: (P.KINDS.index(x[0]), x[1], x[2]))


def test_reconciling_equals_all_comparisons():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choices("0123456789 ", k=120))
        base = sorted(("card", i, i + rng.randrange(1, 9)) for i in rng.sample(range(100), 5))
        found = [("phone", i, min(120, i + rng.randrange(9, 20)), float(rng.randrange(3))) for i in (rng.randrange(110) for _ in range(20))]
        assert P.reconciled(text, base, found) == slow_reconciled(text, base, found)


def test_many_spans_take_linear_time():
    text = "123456789 " * 40_000
    began = time.time()
    assert len(P.reconciled(text, [], [("phone", i, i + 9, 0.0) for i in range(0, len(text), 10)])) == 40_000
    assert time.time() - began < 10


@pytest.fixture(scope="module")
def tagger(spark):
    return P.trained(spark)


def test_network_on_unseen_text(tagger):
    writer, good, found, gold = P.Writer(123), 0, 0, 0
    x, texts, want, table = P.np.full((300, P.SIZE), P.PAD, P.np.int8), [], [], {}
    for r in range(300):
        text, spans = writer.window()
        x[r, : len(text)] = P.symbols(text, table)
        texts.append(text)
        want.append({(P.KINDS[k], i, j) for k, i, j in spans})
    for tags, text, own in zip(tagger.decode(x), texts, want):
        got = set(P.reconciled(text, [], [(*s, 0.0) for s in P.window_spans(tags, 0, len(text))]))
        good, found, gold = good + len(got & own), found + len(got), gold + len(own)
    assert good / found >= 0.9 and good / gold >= 0.85


def test_very_long_texts_are_read_to_the_end(spark, tagger):
    text = "wort 12 " * 60_000 + "call 679-555-3007 now"
    row = P.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert f"phone:{len(text) - 16}:{len(text) - 4}" in row.spans


def test_windows_are_reconciled(spark, tagger):
    pad = "wort " * 40
    text = f"{pad}call 679-555-3007 now {pad}mail max.muster@mail.example.org please {pad}"
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, "x"), (4, "ünï +49 (170) 123-4567 é")], "doc_id long, text string").withColumn("spans", P.F.lit("clash"))
    rows = P.personal_data(df).collect()
    assert len(rows) == 6 and P.personal_data(df.limit(0)).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].n_email == 1 and by[2].spans == "" and by[4].n_phone == 1
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in rows)
    i = text.index("679-")
    assert f"phone:{i}:{i + 12}" in by[1].spans
