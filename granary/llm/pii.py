"""Personal data: base patterns and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on labelled spans that a fixed generator writes into made-up text: the four kinds in many
notations, and look-alikes (dates, versions, amounts, keys) without a label. It reads overlapping windows of a text;
each window is decoded by Viterbi, and the spans of all windows are reconciled over the whole text.

Windows without a digit or an `@` are not read: a span must hold one of these to be valid, so nothing is lost.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.nn import Adam, BiLstm, Parts, fitted
from granary.llm.util import slices

KINDS = ("email", "ip", "card", "phone")
#: Windows of SIZE characters every STEP characters: any span of up to SIZE - STEP lies whole in one of them.
SIZE, STEP = 128, 64
HIDDEN, WIDTH, SEED, ROUNDS, BATCH = 20, 12, 5, 500, 48

# --- base patterns ---------------------------------------------------------------------------------------------------

IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def at_most_255(digits: str) -> bool:
    """Of digits of any number, leading zeros apart."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; from each `@`, to the left as far as the local part goes."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and at >= end and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start. The patterns start only where a run of digits does, which finds the same leftmost
    matches in linear time."""
    out = [("email", i, j) for i, j in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(at_most_255(p) for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            d = digits_of(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the network -----------------------------------------------------------------------------------------------------

#: Tags: 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
#: Characters with a symbol of their own; then come digits, lower and upper case, other letters, the rest.
OWN = "@.-+()_%,:;/=#\"'\n <>[]"
PAD, DIGITS, LOWER, UPPER, LETTER, REST = range(len(OWN), len(OWN) + 6)
SYMBOLS = len(OWN) + 6


def symbol(c: str) -> int:
    if (k := OWN.find(c)) >= 0:
        return k
    if "0" <= c <= "9":
        return DIGITS
    if "a" <= c <= "z":
        return LOWER
    if "A" <= c <= "Z":
        return UPPER
    return LETTER if c.isalpha() else REST


def symbols(text: str, table: dict[str, int]) -> np.ndarray:
    for c in set(text):
        if c not in table:
            table[c] = symbol(c)
    return np.array([table[c] for c in text], np.int8)


class Tagger:
    """Symbol vectors, BiLSTM, CRF transitions."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.e = {"e": rng.normal(0, 0.5, (SYMBOLS, WIDTH)).astype(np.float32)}
        self.net = BiLstm(SEED + 1, WIDTH, HIDDEN, TAGS)
        self.crf = {"t": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32)}

    def scores(self, x: np.ndarray, keep: bool = False) -> np.ndarray:
        """x: (windows, SIZE) symbols. Scores: (SIZE, windows, TAGS)."""
        v = self.e["e"][x.T.astype(np.int64)]
        return self.net.forward(v, np.ones((*x.T.shape, 1), np.float32), keep)

    def parts(self) -> Parts:
        return [self.e, self.crf, *self.net.parts()]

    def step(self, x: np.ndarray, y: np.ndarray, adam: Adam) -> float:
        """One training step on windows x with tags y: the CRF's negative log likelihood and its gradient."""
        s, t, y = self.scores(x, keep=True), self.crf["t"], y.T
        steps, n, _ = s.shape
        own = np.arange(n)
        # Forward and backward sums of products, scaled at each step so that they stay in range.
        top = s.max(axis=2, keepdims=True)
        e, et = np.exp(s - top), np.exp(t)
        alpha, beta, norm = np.empty_like(s), np.ones_like(s), np.empty((steps, n, 1), np.float32)
        for k in range(steps):
            a = e[k] * (np.exp(self.crf["s"]) if k == 0 else alpha[k - 1] @ et)
            norm[k] = a.sum(axis=1, keepdims=True)
            alpha[k] = a / norm[k]
        for k in range(steps - 2, -1, -1):
            beta[k] = (e[k + 1] * beta[k + 1]) @ et.T / norm[k + 1]
        d = alpha * beta
        z = (np.log(norm) + top).sum(axis=(0, 2))
        ahead = (e[1:] * beta[1:] / norm[1:]).reshape(-1, TAGS)
        dt = et * (alpha[:-1].reshape(-1, TAGS).T @ ahead)
        np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1)
        gold = self.crf["s"][y[0]] + s[np.arange(steps)[:, None], own[None, :], y].sum(axis=0) + t[y[:-1], y[1:]].sum(axis=0)
        ds = d[0].sum(axis=0)
        np.add.at(ds, y[0], -1)
        d[np.arange(steps)[:, None], own[None, :], y] -= 1
        dx, grads = self.net.backward((d / n).astype(np.float32))
        de = np.zeros_like(self.e["e"])
        np.add.at(de, x.T.astype(np.int64), dx)
        adam.step(self.parts(), [{"e": de}, {"t": (dt / n).astype(np.float32), "s": (ds / n).astype(np.float32)}, *grads])
        return float((z - gold).mean())

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags, (windows, SIZE)."""
        s, t = self.scores(x), self.crf["t"]
        steps, n, _ = s.shape
        best, back = s[0] + self.crf["s"], np.empty(s.shape, np.int8)
        for k in range(1, steps):
            through = best[:, :, None] + t
            back[k] = through.argmax(axis=1)
            best = np.take_along_axis(through, back[k][:, None, :].astype(np.int64), axis=1)[:, 0] + s[k]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for k in range(steps - 1, 0, -1):
            out[:, k - 1] = back[k][np.arange(n), out[:, k]]
        return out


# --- labelled spans for training -------------------------------------------------------------------------------------


class Writer:
    """Writes made-up text with labelled spans and look-alikes."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.pick = self.rng.choice

    def digits(self, n: int) -> str:
        return "".join(self.rng.choices("0123456789", k=n))

    def letters(self, low: int, high: int) -> str:
        # Letters of the made-up words.
        return "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyzaeiouéñüßç", k=self.rng.randrange(low, high)))

    def word(self) -> str:
        w = self.letters(1, 10)
        return w.capitalize() if self.rng.random() < 0.15 else w

    def ascii(self, low: int, high: int) -> str:
        return "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz", k=self.rng.randrange(low, high)))

    def email(self) -> str:
        local = self.ascii(1, 9) + self.pick(["", ".", "_", "-", "+"]) + self.pick([self.ascii(1, 7), self.digits(self.rng.randrange(1, 5))])
        host = self.ascii(2, 9) + self.pick(["", self.digits(1), "-" + self.ascii(2, 5)])
        return local + self.pick(["@", "@", "@", " @ ", "@ "]) + host + self.pick(["", ".example", ".mail"]) + "." + self.pick(["com", "org", "net", "de", "fr", "es", "io", "co.uk"])

    def ip(self) -> str:
        return ".".join(str(self.rng.randrange(256)) for _ in range(4))

    def card(self) -> str:
        head = self.pick("3456") + self.digits(int(self.pick([11, 12, 13, 14, 14, 14])))
        d = head + next(str(k) for k in range(10) if luhn(head + str(k)))
        return self.pick([" ", "-", "", "."]).join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        cc = self.pick(["1", "33", "34", "44", "49"])
        return self.pick([f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"+{cc}{a}{b}{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"00{cc} {a} {b}{c}", f"+{cc}.{a}.{b}.{c}"])

    def look_alike(self) -> str:
        d, r = self.digits, lambda a, b: str(self.rng.randrange(a, b))
        return self.pick([
            d(self.rng.randrange(1, 8)), f"{r(1900, 2100)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(1)}.{d(1)}",
            f"{d(2)}.{d(2)}.{r(1900, 2100)}", f"${d(3)},{d(3)}.{d(2)}", f"{d(2)} %", f"@{self.ascii(2, 9)}", f"{self.ascii(1, 4)}@", f"#{d(4)}", f"{d(1)}/{d(2)}", f"+{d(2)} %",
            "".join(self.rng.choices("0123456789abcdef", k=self.rng.randrange(16, 64))), f"sk-{self.ascii(4, 9)}{d(6)}{self.ascii(3, 8)}", f"{d(3)} {d(2)}", f"https://{self.ascii(3, 9)}.org/{d(4)}?p={d(2)}",
            f"{self.ascii(2, 6)}{d(3)}", f"{d(4)}-{d(4)}", f"{self.ascii(2, 5)}_{d(2)}={d(3)}", f"ISBN {d(3)}-{d(1)}-{d(2)}-{d(5)}", f"{d(1)}.{d(1)}.{d(1)}",
        ])

    def window(self) -> tuple[str, list[tuple[int, int, int]]]:
        text, spans = "", []
        while len(text) < SIZE + 40:
            what = self.rng.random()
            if what < 0.07:
                k = self.rng.randrange(len(KINDS))
                piece = getattr(self, KINDS[k])()
                spans.append((k, len(text), len(text) + len(piece)))
            elif what < 0.15:
                piece = self.look_alike()
            else:
                piece = self.word()
            text += piece + self.pick([" ", " ", " ", " ", " ", ", ", ". ", ".\n", ": ", " (", ") ", "\n", "; "])
        cut = self.rng.randrange(40)
        return text[cut : cut + SIZE], [(k, i - cut, j - cut) for k, i, j in spans if cut <= i and j <= cut + SIZE]


def train() -> Parts:
    """The tagger's parameters, trained on ROUNDS * BATCH windows with fixed seeds."""
    tagger, writer, adam, table = Tagger(), Writer(SEED + 2), Adam(0.01), {}
    for n in range(ROUNDS):
        adam.rate = 0.012 * (1 - n / ROUNDS) + 0.001
        x, y = np.full((BATCH, SIZE), PAD, np.int8), np.zeros((BATCH, SIZE), np.int64)
        for r in range(BATCH):
            text, spans = writer.window()
            x[r, : len(text)] = symbols(text, table)
            for k, i, j in spans:
                y[r, i] = 1 + 2 * k
                y[r, i + 1 : j] = 2 + 2 * k
        tagger.step(x, y, adam)
    return tagger.parts()


def trained(spark) -> Tagger:
    tagger = Tagger()
    fitted(spark, "pii", train, tagger.parts())
    return tagger


# --- whole texts -----------------------------------------------------------------------------------------------------


def valid(kind: str, piece: str) -> bool:
    """What a span of the network must hold to be of its kind."""
    d = digits_of(piece)
    if kind == "email":
        return piece.count("@") == 1 and "." in piece.split("@")[1][1:-1] and len(piece) >= 6
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def windows_of(text: str) -> list[int]:
    """Starts of the windows with a digit or an `@`."""
    return sorted({k * STEP for m in re.finditer(r"[0-9@]", text) for k in (m.start() // STEP, m.start() // STEP - 1) if k >= 0})


def window_spans(tags: np.ndarray, start: int, length: int) -> list[tuple[str, int, int]]:
    """The spans of one decoded window in places of the text. Spans that touch a window's edge inside the text are left
    to the window beside it, which sees them whole."""
    out, at = [], 0
    while at < length:
        if tags[at] == 0:
            at += 1
            continue
        k, end = (tags[at] - 1) // 2, at + 1
        while end < length and tags[end] == 2 + 2 * k:
            end += 1
        out.append((KINDS[k], start + at, start + end))
        at = end
    return out


def reconciled(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Base spans and those of the network that are valid and overlap neither a base span nor a better one. The better
    span is the longer one, then the one nearer to its window's middle, then the first."""
    # Places taken so far, as disjoint stretches in order, so that looking for an overlap takes a binary search.
    starts, ends, out = [], [], []
    for _, i, j in sorted(base, key=lambda x: x[1]):
        if ends and i <= ends[-1]:
            ends[-1] = max(ends[-1], j)
        else:
            starts.append(i)
            ends.append(j)
    for kind, i, j, _ in sorted(set(found), key=lambda x: (x[1] - x[2], x[3], x[1], x[0])):
        while i < j and text[i] in " \n,;:(" and not (kind == "phone" and text[i] == "("):
            i += 1
        while j > i and text[j - 1] in " \n,;:.":
            j -= 1
        at = bisect.bisect_right(starts, i)
        if valid(kind, text[i:j]) and (at == 0 or ends[at - 1] <= i) and (at == len(starts) or j <= starts[at]):
            starts.insert(at, i)
            ends.insert(at, j)
            out.append((kind, i, j))
    return sorted([*base, *out], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds to the columns `keep` (doc_id if not given): n_email, n_ip, n_card, n_phone (of base spans), base (all base
    spans as kind:start:end by kind, then start; code points, end exclusive; comma-joined) and spans (base and the
    network's, likewise). Null text is empty. Texts are read whole; rows are read one by one, so repeated rows and ids
    do not matter; an empty table gives no rows. Spans of the network longer than SIZE - STEP are not found."""
    keep = ["doc_id"] if keep is None else keep
    tagger, n = trained(docs.sparkSession), len(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    names = [*keep, "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n]) + ", n_email long, n_ip long, n_card long, n_phone long, base string, spans string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, int] = {}
        for batch in slices(batches):
            texts = [t.as_py() or "" for t in batch.column("__text")]
            base, found, todo = [base_spans(t) for t in texts], [[] for _ in texts], []

            def read() -> None:
                x = np.full((len(todo), SIZE), PAD, np.int8)
                for r, (k, start) in enumerate(todo):
                    part = texts[k][start : start + SIZE]
                    x[r, : len(part)] = symbols(part, table)
                for (k, start), tags in zip(todo, tagger.decode(x), strict=True):
                    length = min(SIZE, len(texts[k]) - start)
                    for kind, i, j in window_spans(tags, start, length):
                        if (i > start or start == 0) and (j < start + SIZE or j == len(texts[k])):
                            found[k].append((kind, i, j, abs((i + j) / 2 - start - SIZE / 2)))
                todo.clear()

            for k, text in enumerate(texts):
                for start in windows_of(text):
                    todo.append((k, start))
                    if len(todo) == 512:
                        read()
            if todo:
                read()
            counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS]
            spans = [joined(reconciled(t, b, f)) for t, b, f in zip(texts, base, found, strict=True)]
            cols = [*batch.columns[:n], *counts, pa.array([joined(b) for b in base], pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(work, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: The base columns alone: places of matches are not to be had in SQL, their numbers are.
COUNTS_ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::bigint as n_email,
  list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0) as ips,
  list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) as cards,
  list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) as phones from t)
select doc_id, n_email, len(ips)::bigint as n_ip,
  len(list_filter(cards, lambda d: length(d) between 13 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then d[i]::int when d[i]::int > 4 then 2 * d[i]::int - 9 else 2 * d[i]::int end)) % 10 = 0))::bigint as n_card,
  len(list_filter(phones, lambda n: n between 9 and 15))::bigint as n_phone
from m
"""
