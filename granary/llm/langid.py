"""Language ID by hyperdimensional profiles.

Letters get random vectors of +1 and -1. An n-gram's vector is the product (binding) of its letters' vectors, each
rolled (permuted) by its place; a text's vector is the sum (bundle) of its n-grams' vectors; a language's prototype is
the bundle of all its training texts. A document takes the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.util import arrow_schema, slices

DIM, SLOTS, SEED = 1024, 128, 7
#: Documents and letters encoded at once, and cells of their table of documents and n-grams: bounds a task's memory,
#: whatever the texts' lengths and scripts.
CHUNK_DOCS, CHUNK_CHARS, CELLS = 256, 2_000_000, 4_000_000


def slot_of(cp: int) -> int:
    """A letter's slot: a to z have their own, all others share the rest by a hash; 0 is any run of other characters."""
    if 97 <= cp <= 122:
        return cp - 96
    return 27 + (cp * 2654435761 >> 7) % (SLOTS - 27) if chr(cp).isalpha() else 0


class Encoder:
    """Counts letter trigrams and bundles them. Built once per task."""

    def __init__(self) -> None:
        base = np.random.default_rng(SEED).integers(0, 2, (SLOTS, DIM)).astype(np.int8) * 2 - 1
        self.place = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
        self.slots = np.array([slot_of(cp) for cp in range(0xD800)], np.uint8)

    def symbols(self, text: str) -> np.ndarray:
        """The text's slots, lower-cased, every run of other characters as one 0, with a 0 at both ends."""
        cps = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        low = cps < len(self.slots)
        out = self.slots[np.where(low, cps, 0)]
        if not low.all():
            at = np.flatnonzero(~low)
            uniq, inv = np.unique(cps[at], return_inverse=True)
            out[at] = np.array([slot_of(int(c)) for c in uniq], np.uint8)[inv]
        out = np.concatenate([np.zeros(1, np.uint8), out, np.zeros(1, np.uint8)])
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        return out[keep]

    @staticmethod
    def trigrams(symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int32)
        codes = (s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:]
        return codes[s[1:-1] != 0]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The n-gram vectors of distinct codes, one row each."""
        a, b, c = codes // SLOTS**2, codes // SLOTS % SLOTS, codes % SLOTS
        return self.place[0][a] * self.place[1][b] * self.place[2][c]

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """The bundle of all n-grams given; whole numbers, so any order of adding gives the same."""
        codes, counts = np.unique(grams, return_counts=True)
        out = np.zeros(DIM)
        for i in range(0, len(codes), 4096):
            out += counts[i : i + 4096].astype(np.float64) @ self.vectors(codes[i : i + 4096]).astype(np.float64)
        return out

    def bundles(self, grams: list[np.ndarray]) -> np.ndarray:
        """One bundle per document."""
        flat = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        if not len(flat):
            return np.zeros((len(grams), DIM), np.float32)
        seen = np.zeros(SLOTS**3, bool)
        seen[flat] = True
        codes = np.flatnonzero(seen)
        if len(grams) > 1 and len(grams) * len(codes) > CELLS:
            half = len(grams) // 2
            return np.concatenate([self.bundles(grams[:half]), self.bundles(grams[half:])])
        ids = np.zeros(SLOTS**3, np.int32)
        ids[codes] = np.arange(len(codes))
        doc = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        counts = np.bincount(doc * len(codes) + ids[flat], minlength=len(grams) * len(codes))
        counts = counts.reshape(len(grams), len(codes)).astype(np.float32)
        out = np.zeros((len(grams), DIM), np.float32)
        for i in range(0, len(codes), 4096):
            out += counts[:, i : i + 4096] @ self.vectors(codes[i : i + 4096]).astype(np.float32)
        return out

    def chunks(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        part, chars = [], 0
        for t in texts:
            g = self.trigrams(self.symbols(t.as_py() or ""))
            part.append(g)
            chars += len(g)
            if len(part) >= CHUNK_DOCS or chars >= CHUNK_CHARS:
                yield part
                part, chars = [], 0
        if part:
            yield part


def train_profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from every row with text and lang. Each task adds up its rows, a bounded number of letters at a time,
    and sends one vector per language; the vectors are added in the JVM, component by component. What comes to the driver
    is the model: one vector per language."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, totals, waiting, letters = Encoder(), {}, {}, 0

        def add() -> None:
            for lang, grams in waiting.items():
                totals[lang] = totals.get(lang, 0) + enc.bundle(np.concatenate(grams))
            waiting.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                grams = enc.trigrams(enc.symbols(text.as_py()))
                waiting.setdefault(lang, []).append(grams)
                letters += len(grams)
                if letters >= CHUNK_CHARS:
                    add()
                    letters = 0
        add()
        vecs = pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), vecs], names=["lang", "vec"])

    rows = docs.select("lang", "text").filter("lang is not null and text is not null")
    parts = rows.mapInArrow(partial, "lang string, vec array<double>").select("lang", F.posexplode("vec").alias("k", "v"))
    sums = parts.groupBy("lang", "k").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("all"))
    return {r["lang"]: np.array(r["vec"]) for r in sums.select("lang", F.transform("all", lambda x: x["v"]).alias("vec")).collect()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (the cosine, not under 0) to the columns `keep` (doc_id if not given) of `docs`, from
    the column `text` alone. Texts that are null or without letters, and all texts if there is no prototype, are `und`
    with score 0; of equal cosines, the first language in code point order counts. A text of any length is read whole.
    Repeated rows and ids are judged row by row; an empty table gives no rows."""
    keep = ["doc_id"] if keep is None else keep
    langs = sorted(profiles)
    norms = [np.linalg.norm(profiles[x]) or 1.0 for x in langs]
    matrix = np.array([profiles[x] / n for x, n in zip(langs, norms, strict=True)], np.float32).reshape(len(langs), DIM)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder()
        for batch in slices(batches):
            pred, score = [], []
            for grams in enc.chunks(batch.column(text)):
                if not langs:
                    pred += ["und"] * len(grams)
                    score += [0.0] * len(grams)
                    continue
                b = enc.bundles(grams)
                cos = (b @ matrix.T) / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-9)
                best = cos.argmax(axis=1)
                some = np.array([len(g) > 0 for g in grams])
                pred += [langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
                score += np.where(some, np.clip(cos[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
            cols = [*[batch.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    return rows.mapInArrow(judge, arrow_schema(rows, keep, "lang_pred string, score double"))


def is_held_out() -> F.Column:
    """crc32 of doc_id as text, mod 5, is 0; a null id counts as an empty text, whose crc32 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def langid(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and judges every row: doc_id, held_out, lang_pred, score."""
    profiles = train_profiles(docs.filter(~is_held_out()))
    return identify(docs.withColumn("held_out", is_held_out()), profiles, ["doc_id", "held_out"])
