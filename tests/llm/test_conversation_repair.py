import hashlib
import itertools
import random
import zlib

import pytest

from granary.llm import conversation_repair as R

ROWS = "conv_id long, turn long, role string, text string"


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        if not text.strip(" \t\n\x0b\x0c\r"):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def legal(roles):
    if not roles:
        return True
    body = roles[1:] if roles[0] == "s" else roles
    return len(body) > 0 and len(body) % 2 == 0 and body == "ua" * (len(body) // 2)


def brute(turns):
    """Every sequence of edits with up to two insertions in each gap."""
    kinds = faults(turns)
    gaps = ["", "u", "a", "ua"]
    best = None
    options = []
    for (role, text), kind in zip(turns, kinds, strict=True):
        own = [("D", "", None, 2)]
        if kind not in ("blank", "duplicate"):
            more = 5 if kind == "truncated" else 0
            own += [("K", role[:1], f"{role}:{text}", more)] if role[:1] in ("s", "u", "a") else []
            own += [("R", "u", f"user:{text}", 1 + more), ("R", "a", f"assistant:{text}", 1 + more)]
        options.append(own)
    names = {"u": "user:", "a": "assistant:"}
    for choice in itertools.product(*options):
        for ins in itertools.product(gaps, repeat=len(turns) + 1):
            roles = ins[0] + "".join(c[1] + g for c, g in zip(choice, ins[1:], strict=True))
            if not legal(roles):
                continue
            cost = sum(c[3] for c in choice) + 5 * sum(map(len, ins))
            audit = "I" * len(ins[0]) + "".join(c[0] + "I" * len(g) for c, g in zip(choice, ins[1:], strict=True))
            if best is None or (cost, audit) < best[:2]:
                lines = [names[r] for r in ins[0]]
                for c, g in zip(choice, ins[1:], strict=True):
                    lines += [c[2]] if c[2] is not None else []
                    lines += [names[r] for r in g]
                best = cost, audit, "\n".join(lines)
    return best


def expected(rows):
    """The contract's row for each conversation, from plain Python."""
    spaced = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [(r, t) for _, r, t in own]
        kinds = faults(turns)
        known = {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, text = brute(turns)
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def random_conversations(rng, n, most):
    for conv in range(n):
        for turn in range(rng.randrange(1, most + 1)):
            yield conv, turn + rng.randrange(2), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["Hi.", "yes", "Why?", " ", "ok!\n", "Hi."])


@pytest.mark.parametrize("block", [1, 2, 256])
def test_equals_brute_force(spark, block, monkeypatch):
    """In blocks of one, two and many turns: matrices of blocks multiply to the whole conversation's shortest path."""
    rng = random.Random(5)
    rows = [r for r in random_conversations(rng, 50, 3)]
    pairs = [tuple(turns) for _, turns in itertools.groupby(rows, key=lambda r: r[0])]
    for own in pairs[:10]:
        turns = [(r, t) for _, _, r, t in sorted(own, key=lambda r: (r[1], r[2], r[3]))]
        cost, audit, text = brute(turns)
        symbols = tuple((r[:1], k in ("blank", "duplicate"), k == "truncated") for (r, _), k in zip(turns, faults(turns), strict=True))
        best = min((w, j) for j, w in R.shortest(symbols, R.START).items() if j in R.FINAL)[0]
        assert best == (cost, audit)
    if block == 256:
        assert result(R.damaged_and_repaired(spark.createDataFrame(rows, ROWS))) == expected(rows)
    monkeypatch.setattr(R, "BLOCK", block)
    few = [r for r in rows if r[0] < 25]
    prepared = R.damaged(spark.createDataFrame(few, ROWS))
    # Workers are other processes: the smaller block is used here, on the driver, by the same functions.
    faulty = R.with_faults(prepared).collect()
    convs = {}
    for r in sorted(faulty, key=lambda r: (r.conv_id, r.turn is not None, r.turn or 0, r.role, r.text)):
        for copy in range(r.n):
            blocks = convs.setdefault(r.conv_id, [R.Block(r.conv_id)])
            if len(blocks[-1].symbols) >= block:
                blocks.append(R.Block(r.conv_id))
            blocks[-1].add(r.turn, r.role, r.text, "duplicate" if copy and r.fault != "blank" else r.fault)
    want = expected(few)
    for conv, blocks in convs.items():
        best = {R.START: (0, "")}
        for b in blocks:
            new = {}
            for (i, j), w in R.matrix(tuple(b.symbols)).items():
                if i in best:
                    new[j] = min(new.get(j, (10**9, "")), R.times(best[i], w))
            best = new
        assert min(best[f] for f in R.FINAL if f in best) == want[conv][5:7]


def test_a_hot_conversation_lies_in_many_blocks(spark):
    """3000 turns under one id and a turn repeated 1000 times: the same as one shortest path over all of it."""
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {k}.", f"cut {k}"])) for k in range(3000)]
    rows += [(7, 3000, "user", "again.")] * 1000 + [(8, 0, "user", "q?"), (8, 1, "assistant", "a.")]
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    parts = R.repair(df.withColumn("n", R.F.lit(1).cast("long")))
    got = result(R.summary(parts))
    turns = [(r, t) for c, _, r, t in rows if c == 7]
    kinds = faults(turns)
    symbols = tuple((r[:1], k in ("blank", "duplicate"), k == "truncated") for (r, _), k in zip(turns, kinds, strict=True))
    cost, audit = min(w for j, w in R.shortest(symbols, R.START).items() if j in R.FINAL)
    kept, _ = R.follow(audit, R.START, [r for r, _ in turns], [t for _, t in turns])
    illegal = sum(a[0][:1] + b[0][:1] not in R.LEGAL for a, b in itertools.pairwise(turns))
    want = (0, 0, 999, kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    said = [(r.role, r.text) for r in R.repaired_turns(parts).filter("conv_id = 7").orderBy("block", "place").collect()]
    assert said == kept and parts.filter("conv_id = 7").count() > 10
    assert got[7] == want and got[8] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:q?\nassistant:a.").hexdigest())


def test_odd_rows(spark):
    long = "word " * 300_000 + "end."
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 2, "assistant", long), (None, 0, "user", "q?"), (None, 1, "assistant", "a."), (None, None, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "")]
    rows += [(3, t, "user", "x.") for t in range(400) if zlib.crc32(f"3:{t}".encode()) % 20 == 0]  # all dropped
    df = spark.createDataFrame(rows, ROWS)
    for name in ("n", "fault", "block", "kind", "digest", "ways", "turns", "audit"):
        df = df.withColumn(name, R.F.lit("x"))
    got = result(R.damaged_and_repaired(df))
    assert got == expected(rows)
    assert got[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert R.damaged_and_repaired(df.limit(0)).count() == 0
