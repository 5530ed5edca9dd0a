"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed, equal runs are found
across the whole corpus, and sentences under any run that is not the first of its kind are removed.

A run is as short as it can be while it has at least two sentences and `min_words` words; it is taken from each sentence
forwards and from each sentence backwards, so a repeated passage is covered to its first and last sentence.

A sentence ends at an end mark, a clause mark or a line end, and at places set by the words themselves: between two words
whose common hash is 0 modulo PLACES. The same rule cuts every text, so a passage is cut alike wherever it stands, be it
in the middle of a host's long sentence or in text without punctuation. In scripts without spaces, characters count as
words.

A line end may end a sentence or be a mere wrap. Text with line ends is therefore cut twice, with these as ends and as
white space, and runs of both cuts are looked for.

Two passes over the texts: the first shuffles a hash for each run and counts it; the second passes on only runs whose hash
may be a repeated one, by a Bloom filter of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bloom import bloom, passes
from granary.llm.util import slices, stored

#: One of so many places between words, picked by the two words beside it, ends a sentence.
PLACES = 8
#: Marks that end a sentence, that end a clause, and that may follow either before white space.
END, CLAUSE, CLOSERS = ".!?…。！？", ",;:、，；：", "\"'”’)]」』）"
#: Scripts without spaces (Thai to Khmer, kana, Han) and their marks, whose characters are words one by one.
BARE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3001, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFF1F))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))

WHITE, WORDS_OF_ONE, ENDS, CLAUSES, CLOSES = 1, 2, 4, 8, 16
KIND = np.zeros(0x10000, np.uint8)
KIND[[c for c in range(0x10000) if chr(c).isspace()]] |= WHITE
for _low, _high in BARE:
    KIND[_low : _high + 1] |= WORDS_OF_ONE
for _marks, _flag in ((END, ENDS), (CLAUSE, CLAUSES), (CLOSERS, CLOSES)):
    KIND[[ord(c) for c in _marks]] |= _flag


def spread(h: np.ndarray) -> np.ndarray:
    """Hashes with their bits spread evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Hashes of characters, 0 for white space.
LETTER = np.where(KIND & WHITE, np.uint64(0), spread(np.arange(1, 0x10001, dtype=np.uint64)))


class Powers:
    """Powers of a number, as many as were asked for so far."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.known):
            self.known = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, self.base))])
        return self.known


UP, DOWN = Powers(MULTIPLIER), Powers(INVERSE)


class Words:
    """A text's words: where they start, their hashes (lower-cased), and the kinds of cuts before them."""

    def __init__(self, text: str) -> None:
        low = text.lower()
        if len(low) != len(text):  # a few letters are longer in lower case
            low = "".join(c.lower()[0] for c in text)
        cps = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = np.minimum(cps, 0xFFFF)
        kind, letter = KIND[plain], LETTER[plain]
        if len(cps) and cps.max() > 0xFFFF:
            kind[cps >= 0x20000] |= WORDS_OF_ONE
            letter[cps > 0xFFFF] = spread(cps[cps > 0xFFFF].astype(np.uint64) + np.uint64(1))
        white, bare = (kind & WHITE) > 0, (kind & WORDS_OF_ONE) > 0
        begins = ~white
        begins[1:] &= white[:-1] | bare[1:] | bare[:-1]
        self.starts = np.flatnonzero(begins)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        for a in range(0, len(self.starts), 100_000):
            first = self.starts[a : a + 100_000]
            end = self.starts[a + 100_000] if a + 100_000 < len(self.starts) else len(cps)
            part = slice(first[0], end)
            place = np.arange(first[0], end) - np.repeat(first, np.diff(np.append(first, end)))
            self.hashes[a : a + 100_000] = spread(np.add.reduceat(letter[part] * UP(int(place.max()) + 1)[place], first - first[0]))
        # Before each word but the first: the last character that is not white space, and the line ends since.
        last = np.maximum.accumulate(np.where(white, 0, np.arange(len(cps), dtype=np.int32)))[self.starts[1:] - 1]
        lines = np.cumsum(cps == 10, dtype=np.int32)
        self.lines = lines[self.starts[1:] - 1] - lines[last]
        ends, clauses = ((kind & flag) > 0 for flag in (ENDS, CLAUSES))
        closes = (kind & CLOSES) > 0
        # Marks reach over closing quotes and brackets: a row of these is an end if what it follows is one.
        row = np.flatnonzero(closes & ~ends)
        if len(row):
            new = np.append(True, np.diff(row) > 1)
            first = row[new]
            ends[row] = ((first > 0) & ends[first - 1])[np.cumsum(new) - 1]
        together = spread(self.hashes[:-1] * np.uint64(3) + self.hashes[1:]) % np.uint64(PLACES) == 0
        self.cuts = ends[last] | clauses[last] | together
        size = len(self.hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * UP(size)[:size])])

    def sentences(self, lines: int) -> np.ndarray:
        """The first word of each sentence; so many line ends in a row are an end."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        return np.concatenate([[0], np.flatnonzero(self.cuts | (self.lines >= lines)) + 1])

    def ways(self) -> list[np.ndarray]:
        """The cuts of the text, one or two."""
        one, two = self.sentences(1), self.sentences(2)
        return [one] if len(one) == len(two) else [one, two]

    def runs(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from first to before end."""
        return spread((self.sums[end] - self.sums[first]) * DOWN(len(self.sums))[first])

    def places(self, words: np.ndarray, length: int) -> np.ndarray:
        """Where words start in the text; the first stands for the text's start, one beyond the last for its end."""
        return np.where(words == 0, 0, np.append(self.starts, length)[words])


def spans(firsts: np.ndarray, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of sentences, as described above, by their first word and the one after the last; n is the number of words."""
    edges = np.append(firsts, n)
    at = np.arange(len(firsts))
    ahead = np.maximum(at + 2, np.searchsorted(edges, edges[:-1] + min_words))
    back = np.minimum(at - 1, np.searchsorted(edges, edges[1:] - min_words, "right") - 1)
    a = np.concatenate([at[ahead < len(edges)], back[back >= 0]])
    b = np.concatenate([ahead[ahead < len(edges)], at[back >= 0] + 1])
    both = np.unique(edges[a] * (n + 1) + edges[b]) if len(a) else np.zeros(0, np.int64)
    return both // (n + 1), both % (n + 1)


def text_runs(text: str, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's runs, and where they start and end in it."""
    words = Words(text)
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ways = [spans(w, n, min_words) for w in words.ways()]
    first, end = ways[0]
    if len(ways) > 1:
        both = np.unique(np.concatenate([a * (n + 1) + b for a, b in ways]))
        first, end = both // (n + 1), both % (n + 1)
    return words.runs(first, end), words.places(first, len(text)), words.places(end, len(text))


def run_hashes(docs: DataFrame, min_words: int) -> DataFrame:
    """h: one row per run of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h = [text_runs(t.as_py() or "", min_words)[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(work, "h long")


def likely_runs(docs: DataFrame, min_words: int, filter_bits) -> DataFrame:
    """The runs whose hash passes the filter: h, doc_id, th (a hash of the text), i and j (where it starts and ends)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value
        for batch in slices(batches):
            found, many = [], []
            for t in batch.column("text"):
                h, i, j = text_runs(t.as_py() or "", min_words)
                fine = passes(bits, h)
                found.append((h[fine], i[fine], j[fine]))
                many.append(int(fine.sum()))
            take = pa.array(np.repeat(np.arange(len(many)), many))
            h, i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            cols = [pa.array(h.view(np.int64)), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "doc_id", "th", "i", "j"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(work, f"h long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, i int, j int")


def dedup_spans(docs: DataFrame, min_words: int = 30, keep: list[str] | None = None) -> DataFrame:
    """Removes the sentences under every repeated run but its first (smallest doc_id, null first; then the smallest
    hash of the text, then the place in it). Repeats within a document count like those between documents.

    Returns the columns `keep` (doc_id if not given) with n_removed (sentences) and kept (the text without them; null text
    stays null, unchanged texts stay as they are to the byte). Rows equal in id and text are one
    document: each comes out alike. Runs are told apart by 64-bit hashes. Texts are read whole; empty texts have no
    sentences; other columns are ignored; an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    repeated = stored(run_hashes(docs, min_words).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    found = stored(likely_runs(docs, min_words, spark.sparkContext.broadcast(bloom(repeated, repeated.count()))))
    first = F.min(F.struct("doc_id", "th", "i"))
    firsts = found.groupBy("h").agg(F.count("*").alias("n"), first.alias("f")).filter("n > 1")
    firsts = stored(firsts.select("h", F.col("f.doc_id").alias("f_doc"), F.col("f.th").alias("f_th"), F.col("f.i").alias("f_i")))
    again = found.join(firsts, "h").filter(~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("th") == F.col("f_th")) & (F.col("i") == F.col("f_i"))))
    cuts = again.groupBy(F.col("doc_id").alias("c_doc"), F.col("th").alias("c_th")).agg(F.collect_set(F.struct("i", "j")).alias("__cuts"))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__th"), F.col("text").alias("__text"))
    rows = rows.join(cuts, F.col("__doc").eqNullSafe(F.col("c_doc")) & (F.col("__th") == F.col("c_th")), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "__text", "__cuts")
    n = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, kept = [], []
            for text, own in zip(batch.column("__text"), batch.column("__cuts"), strict=True):
                text, own = text.as_py(), own.as_py()
                if not own:
                    removed.append(0)
                    kept.append(text)
                    continue
                words = Words(text)
                starts = words.places(words.sentences(1), len(text))
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, np.searchsorted(starts, [x["i"] for x in own]), 1)
                np.add.at(edge, np.searchsorted(starts, [x["j"] for x in own]), -1)
                out = np.cumsum(edge)[:-1] > 0
                removed.append(int(out.sum()))
                ends = np.append(starts[1:], len(text))
                kept.append("".join(text[a:b] for a, b in zip(starts[~out].tolist(), ends[~out].tolist(), strict=True)))
            cols = [*batch.columns[:n], pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n], "n_removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n]) + ", n_removed long, kept string"
    return rows.mapInArrow(work, schema)
