"""Phrase collocation mining by pattern growth (after PrefixSpan, Pei et al., 2001, on contiguous patterns).

The database is the pieces of all texts, as sequences of words. A prefix's projection is its occurrence pointers: for each
place where the prefix stands, what follows. Only occurrences of frequent prefixes are projected, and a pointer only goes
on as long as the next pair of words is frequent, since all parts of a frequent phrase are. A pointer carries the words that
it points to, so that a prefix's task needs nothing else; equal pointers are counted before they travel, so a very frequent
prefix has as many rows as it has different continuations. One task then grows each prefix of two words (its pointers lie
together, sorted): a depth-first walk to the right, which opens a longer prefix at each new word and closes it with its
count, and holds no more than the path it is on.

Which pairs are frequent is first counted by 64-bit hashes; a bounded Bloom filter of them only saves work: what it lets
through is counted exactly, by the words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.llm.bloom import bloom, passes
from granary.llm.util import shuffle_partitions, slices, stored

#: Fixed by the contract: what ends a piece, and the letters that are lower-cased.
BREAKS, UPPER, LOWER = b".,;:!?\n\x0b\x0c\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: On UTF-8, where none of these is part of another character: breaks become line feeds, tabs spaces.
TABLE = bytes.maketrans(BREAKS + UPPER + b"\t", b"\n" * len(BREAKS) + LOWER + b" ")
#: Words told apart in a worker before its memory is cleared, and bytes that are read at once.
KNOWN, BYTES = 150_000, 2_000_000


class Numbers(dict):
    """A number for each word, given when it is first seen; 0 for a break, -1 for nothing."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class Reader:
    """Reads texts as arrays of word numbers, 0 where a piece ends."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number, self.held = Numbers(), np.zeros(1, np.uint64)

    @property
    def words(self) -> list[bytes]:
        return self.number.words

    def read(self, texts: list[bytes]) -> np.ndarray:
        tokens = b"\n".join([b"", *texts, b""]).translate(TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        new = [xxhash.xxh64_intdigest(w) for w in self.words[len(self.held) :]]
        self.held = np.concatenate([self.held, np.array(new, np.uint64)])
        return ids[ids >= 0]

    def strings(self, numbers: np.ndarray) -> pa.Array:
        words = self.words
        return pa.array([words[k] for k in numbers.tolist()], pa.binary()).cast(pa.string())

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        return self.held[numbers]


def pair_hashes(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    """48 bits for each pair of words of a language."""
    z = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(16)


def by_lang(batches: Iterator[pa.RecordBatch], reader: Reader) -> Iterator[tuple[str, np.ndarray]]:
    """The texts of some documents, BYTES or little more, those of each language together."""
    texts, size = defaultdict(list), 0

    def found() -> Iterator[tuple[str, np.ndarray]]:
        if len(reader.words) > KNOWN:
            reader.clear()
        for lang, own in texts.items():
            yield lang, reader.read(own)
        texts.clear()

    for batch in slices(batches, 100):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                texts[lang].append(text)
                size += len(text)
        if size >= BYTES:
            yield from found()
            size = 0
    yield from found()


def pairs_in(ids: np.ndarray) -> np.ndarray:
    """Places of the words after which the piece goes on."""
    return np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))


def counts(texts: DataFrame) -> DataFrame:
    """lang, word, h, n: how often each word stands in each language (h null), and each pair's hash in a piece (lang and word
    null: the hash tells languages apart)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for lang, ids in by_lang(batches, reader):
            own, n = np.unique(ids[ids > 0], return_counts=True)
            at = pairs_in(ids)
            pairs, m = np.unique((ids[at] << 32) | ids[at + 1], return_counts=True)
            h = pair_hashes(reader.hashes(pairs >> 32), reader.hashes(pairs & 0xFFFFFFFF), lang).astype(np.int64)
            word, none = reader.strings(own), pa.nulls(len(pairs), pa.string())
            cols = [pa.concat_arrays([pa.array([lang] * len(own), pa.string()), none]), pa.concat_arrays([word, none]), pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(h)])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([n, m]).astype(np.int64))], names=["lang", "word", "h", "n"])

    return texts.mapInArrow(work, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def projected(texts: DataFrame, frequent, max_words: int) -> DataFrame:
    """lang, words, n: occurrence pointers of frequent pairs, each the pair and the words it goes on with (max_words in
    all at most; joined by tabs, which no word holds), counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, bits = Reader(), frequent.value
        for lang, ids in by_lang(batches, reader):
            goes_on = np.zeros(len(ids), bool)
            inside = pairs_in(ids)
            goes_on[inside] = passes(bits, pair_hashes(reader.hashes(ids[inside]), reader.hashes(ids[inside + 1]), lang))
            at = np.flatnonzero(goes_on)
            window = np.zeros((len(at), max_words), np.int64)
            window[:, 0], on, code, last = ids[at], np.ones(len(at), bool), ids[at], len(ids) - 1
            for k in range(1, max_words):
                on &= goes_on[np.minimum(at + k - 1, last)]
                window[:, k] = np.where(on, ids[np.minimum(at + k, last)], 0)
                if len(code) and int(code.max() + 1) * len(reader.words) >= 2**62:
                    code = np.unique(code, return_inverse=True)[1]
                code = code * len(reader.words) + window[:, k]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            window = window[first]
            size = (window > 0).sum(axis=1)
            each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), reader.strings(window[window > 0]))
            words = pc.binary_join(each, "\t")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words, pa.array(n.astype(np.int64))], names=["lang", "words", "n"])

    return texts.mapInArrow(work, "lang string, words string, n long").groupBy("lang", "words").agg(F.sum("n").alias("n"))


def shortened(pointers: DataFrame, max_words: int, least: int) -> DataFrame:
    """Pointers without the last of max_words words where they are too few to make a phrase with it, counted anew: what
    can't be grown needn't travel to the prefix's task."""
    full = F.regexp_count("words", F.lit("\t")) == max_words - 1
    cut = F.when(full & (F.col("n") < least) & F.lit(max_words > 2), F.regexp_replace("words", r"\t[^\t]*\z", "")).otherwise(F.col("words"))
    return pointers.withColumn("words", cut).groupBy("lang", "words").agg(F.sum("n").alias("n"))


def grow(pointers: Iterator[tuple[str, list[str], int]], least: int) -> Iterator[tuple[str, list[str], int]]:
    """(lang, phrase, count) of the phrases of two words and more that stand `least` times or more. Pointers come sorted
    by language and words, so the prefix tree is walked depth-first: a prefix is closed when a pointer leaves it."""
    lang, path, count = None, [], []
    for own, words, n in pointers:
        same = 0
        if own == lang:
            while same < len(path) and same < len(words) and path[same] == words[same]:
                same += 1
        while len(path) > same:
            if len(path) > 1 and count[-1] >= least:
                yield lang, list(path), count[-1]
            path.pop()
            count.pop()
        lang = own
        for w in words[same:]:
            path.append(w)
            count.append(0)
        for k in range(len(path)):
            count[k] += n
    while len(path) > 1:
        if count[-1] >= least:
            yield lang, list(path), count[-1]
        path.pop()
        count.pop()


def phrases_of(pointers: DataFrame, least: int) -> DataFrame:
    """lang, words, a: frequent phrases, each prefix of two words grown in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, list[str], int]]:
            for batch in slices(batches, 10_000):
                yield from zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "n")), strict=True)

        frame = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.list_(pa.string()), pa.int64()), strict=True)], names=["lang", "words", "a"])
        out = []
        for found in grow(rows(), least):
            out.append(found)
            if len(out) >= 10_000:
                yield frame(out)
                out = []
        yield frame(out)

    parts = shuffle_partitions(pointers.sparkSession)
    pointers = pointers.withColumn("words", F.split("words", "\t"))
    dealt = pointers.repartition(parts, "lang", F.get("words", F.lit(0)), F.get("words", F.lit(1))).sortWithinPartitions("lang", "words")
    return dealt.mapInArrow(work, "lang string, words array<string>, a long")


def score() -> Column:
    """floor(1000000 a a / (l r)), exactly: decimals of 7, 16 and 15 digits make 38, those of 18 and 18 fit as well."""
    whole = "cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(15,0))"
    return F.expr(f"{whole} div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))").cast("long")


def first_of_each(rows: DataFrame, top: int, order: list) -> DataFrame:
    """The first `top` rows of each language with their rank. Rows are dealt into ever fewer heaps that keep their own
    first ones, so no task ranks a whole language."""
    for heaps in (256, 16, 1):
        own = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(heaps))) if heaps > 1 else W.partitionBy("lang")
        rows = rows.withColumn("rank", F.row_number().over(own.orderBy(*order))).filter(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, absorbed_percent: int = 50, top: int = 2000) -> DataFrame:
    """The `top` best collocations of each lang: lang, rank, phrase, a, l, r, n, score. A phrase of 2 to max_words words
    that stands at least `least` times is a candidate, scored at its worst cut: floor(1000000 a a / (l r)), with the counts
    of the whole, of what is before the cut and after it. Candidates inside a longer one that stands at least
    absorbed_percent / 100 as often are dropped.

    Words and pieces are the contract's. A null lang is `und`, and counts with rows whose lang is so written; a null or
    empty text has no words. Rows that repeat count again, whatever their ids. Texts are read whole, however long. Of equal
    scores, the larger a comes first, then the smaller phrase by its bytes; of equal cuts the first one counts. A language
    without candidates has no rows, nor has an empty table; other columns are ignored. Counts may pass 64 bits when
    multiplied: they are decimals of 38 digits, enough for counts below 10^15.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counted = stored(counts(texts).filter(F.col("word").isNotNull() | (F.col("n") >= least)))
    total = counted.filter("word is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    singles = counted.filter((F.col("word").isNotNull()) & (F.col("n") >= least)).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    pairs = counted.filter(F.col("h").isNotNull()).select("h")
    may = bloom(pairs, pairs.count())
    pointers = shortened(projected(texts, docs.sparkSession.sparkContext.broadcast(may), max_words), max_words, least)
    found = stored(phrases_of(pointers, least).select("lang", "words", F.array_join("words", " ").alias("phrase"), "a"))
    known = stored(singles.unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))))

    piece = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", score())
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda s: F.array_join(F.slice("words", s, m), " ")))))
    longer = found.filter(F.size("words") > 2).select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longest") < absorbed_percent * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score").join(total, "lang")
    best = first_of_each(kept, top, [F.desc("score"), F.desc("a"), F.asc("phrase")])
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with d as (select coalesce(lang, 'und') as lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps from documents),
p as (select lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') as w from d),
t as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
g as (select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, k, count(*) as f from t, (values (1), (2), (3)) v(k) where i + k - 1 <= len(w) group by all),
n as (select lang, sum(f)::bigint as n from g where k = 1 group by lang),
c as (select lang, phrase, string_split(phrase, ' ') as ws, k, f as a from g where k >= 2 and f >= 10),
s as (select lang, phrase, ws, k, a, unnest(range(1, k)) as cut from c),
q as (select s.lang, s.phrase, s.a, s.cut, l.f as l, r.f as r, ((1000000::hugeint * s.a * s.a) // (l.f::hugeint * r.f))::bigint as score
  from s join g l on l.lang = s.lang and l.phrase = array_to_string(s.ws[1 : s.cut], ' ') join g r on r.lang = s.lang and r.phrase = array_to_string(s.ws[s.cut + 1 : s.k], ' ')),
b as (select * from q qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
h as (select lang, array_to_string(ws[1 : 2], ' ') as phrase, a from c where k = 3 union all select lang, array_to_string(ws[2 : 3], ' '), a from c where k = 3),
m as (select lang, phrase, max(a) as longest from h group by all)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase)::bigint as rank, b.phrase, a, l, r, n.n, score
from b join n on n.lang = b.lang left join m on m.lang = b.lang and m.phrase = b.phrase where m.longest is null or 100 * m.longest < 50 * a
qualify row_number() over (partition by b.lang order by score desc, a desc, b.phrase) <= 2000
"""
