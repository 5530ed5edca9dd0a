"""Benchmark decontamination by greedy string tiling (Wise's running Karp-Rabin variant).

Documents and test items are token sequences. The hashes of all runs of `seed` tokens of both are joined in Spark; a
document and an item that share enough of them are tiled: the longest runs that both have, not overlapping any run
marked before, are marked again and again until none of `seed` tokens is left. A document is contaminated by an item if
at least `share` of the item's tokens are marked, in whatever order its pieces stand.

What is joined is little. Documents send only runs that pass a Bloom filter of the items' runs, whose size is bounded
whatever the benchmark's. Items leave out their most frequent runs: a pair over the share has so many runs in common
that it must share one of the others. Equal texts are one document. The documents' texts themselves are not shuffled,
but for those that share runs with an item; these are told by another such filter.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.llm.bloom import bloom, may_hold, passes
from granary.llm.util import slices, stored

#: Letters of scripts without spaces (Thai to Khmer, kana, Han), which are tokens one by one.
BARE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
TOKEN, BARE_TOKEN, UNSPACED = re.compile(r"[^\W_]+"), re.compile(rf"[{BARE}]|[^\W_{BARE}]+"), re.compile(f"[{BARE}]")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of places that tiling looks at at once.
HITS = 1_000_000


class Tokens:
    """64-bit hashes of lower-cased words; remembers words up to a bound."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.known, self.most = {}, most

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        text = (text or "").lower()
        known, out = self.known, []
        for w in (BARE_TOKEN if not text.isascii() and UNSPACED.search(text) else TOKEN).findall(text):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def rolling(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n tokens (modulo 2^64)."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(tokens) - n + 1, np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + tokens[i : len(tokens) - n + 1 + i]
    return out


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n tokens, with their bits spread evenly."""
    out = hashes + np.uint64(n)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


# --- tiling ----------------------------------------------------------------------------------------------------------


class Prefixes:
    """Karp-Rabin hashes of any run of a sequence, from those of its beginnings."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.tokens = tokens
        with np.errstate(over="ignore"):
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(tokens), MULTIPLIER))])
            # h[n] = sum of t[i] * M^(n - 1 - i); kept as h[n] = M^(n - 1) * sum of t[i] * M^-i, as M is odd.
            inverse = np.uint64(pow(int(MULTIPLIER), -1, 2**64))
            back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, len(tokens) - 1), inverse))])[: len(tokens)]
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * back)])

    def runs(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of the runs of n tokens from start, comparable between sequences."""
        with np.errstate(over="ignore"):
            return (self.sums[start + n] - self.sums[start]) * self.power[start]


def free(marked: np.ndarray) -> np.ndarray:
    """For each place, how many tokens from it on are not marked."""
    n = len(marked)
    stops = np.where(marked, np.arange(n), n)
    return np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n)


def longest(a: Prefixes, b: Prefixes, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many tokens from i and j on are equal, at most `room`: a binary search over hashes."""
    low, high = np.zeros(len(i), np.int64), room.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = a.runs(i, mid) == b.runs(j, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def tiled(item: np.ndarray, doc: np.ndarray, seed: int) -> int:
    """How many tokens of the item get marked. Of equally long runs, the first in the document counts, then the first in
    the item.

    Runs are looked for by falling lengths: those of at least s tokens, then of s / 2, down to `seed`. For each s, hashes
    of all unmarked runs of s tokens meet; each meeting that is not inside a longer one is drawn out to its end; the
    longest is marked, and runs that it cuts are looked at again with what is left of them.
    """
    a, b = Prefixes(item), Prefixes(doc)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    marked, s = 0, min(len(item), len(doc))
    while s >= seed and marked < len(item):
        free_i, free_j = free(in_item), free(in_doc)
        at_i, at_j = np.flatnonzero(free_i >= s), np.flatnonzero(free_j >= s)
        heap = [(-n, j, i) for i, j, n in meetings(a, b, at_i, at_j, s, free_i, free_j, in_item, in_doc)]
        heapq.heapify(heap)
        while heap and marked < len(item):
            n, j, i = heapq.heappop(heap)
            n = -n
            taken = in_item[i : i + n] | in_doc[j : j + n]
            if not taken.any():
                in_item[i : i + n] = in_doc[j : j + n] = True
                marked += n
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if end - first >= s:
                    heapq.heappush(heap, (first - end, j + first, i + first))
        s = max(seed, s // 2) if s > seed else 0
    return marked


def meetings(a: Prefixes, b: Prefixes, at_i: np.ndarray, at_j: np.ndarray, s: int, free_i: np.ndarray, free_j: np.ndarray, in_item: np.ndarray, in_doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, length) of the unmarked equal runs of at least s tokens that can't be drawn out to the left."""
    if not len(at_i) or not len(at_j):
        return
    hash_i, hash_j = a.runs(at_i, np.full(len(at_i), s)), b.runs(at_j, np.full(len(at_j), s))
    order = np.argsort(hash_i, kind="stable")
    hash_i, at_i = hash_i[order], at_i[order]
    low, high = np.searchsorted(hash_i, hash_j), np.searchsorted(hash_i, hash_j, "right")
    some = np.flatnonzero(high > low)
    at_j, low, many = at_j[some], low[some], (high - low)[some]
    upto = np.cumsum(many)
    k = 0
    while k < len(at_j):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + HITS, "right")))
        j = np.repeat(at_j[k:end], many[k:end])
        i = at_i[np.repeat(low[k:end] - (upto[k:end] - many[k:end]), many[k:end]) + np.arange(upto[k] - many[k], upto[end - 1])]
        inner = (i > 0) & (j > 0)
        left = inner & (a.tokens[i - 1] == b.tokens[j - 1]) & ~in_item[i - 1] & ~in_doc[j - 1]
        i, j = i[~left], j[~left]
        n = longest(a, b, i, j, np.minimum(free_i[i], free_j[j]))
        yield from zip(i.tolist(), j.tolist(), n.tolist(), strict=True)
        k = end


def coverage(item: np.ndarray, doc: np.ndarray, seed: int, share: float) -> float:
    """The share of the item's tokens that tiling marks, 0 without tiling if too few can be. An item under `seed` tokens
    is found as a whole or not at all."""
    seed = min(seed, len(item))
    if not seed or len(doc) < seed:
        return 0.0
    runs = rolling(item, seed)
    hits = np.flatnonzero(np.isin(runs, rolling(doc, seed)))
    edge = np.zeros(len(item) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + seed, -1)
    if np.count_nonzero(np.cumsum(edge)) < share * len(item):
        return 0.0
    return tiled(item, doc, seed) / len(item)


# --- Spark -----------------------------------------------------------------------------------------------------------


def key_of(text: str) -> Column:
    return F.md5(F.col(f"`{text}`").cast("binary"))


def item_runs(items: DataFrame, seed: int, share: float) -> DataFrame:
    """(ik, n, h, places, need): the distinct runs of each item, how often each stands in it, and how many of its places
    a document over the share must have. n is the length of the runs, `seed` or the item's own if that is less."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in slices(batches, 64):
            rows: list[list] = [[], [], [], [], []]
            for ik, text in zip(batch.column("ik").to_pylist(), batch.column("item_text"), strict=True):
                t = tokens(text.as_py())
                n = min(seed, len(t))
                if not n:
                    continue
                h, places = np.unique(mixed(rolling(t, n), n), return_counts=True)
                # Each marked run of m >= n tokens has m - n + 1 >= m / n places.
                need = max(1, -(-int(np.ceil(share * len(t))) // n))
                for col, v in zip(rows, ([ik] * len(h), [n] * len(h), h.view(np.int64).tolist(), places.tolist(), [need] * len(h)), strict=True):
                    col += v
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["ik", "n", "h", "places", "need"])

    return items.mapInArrow(work, "ik string, n int, h long, places long, need long")


def document_runs(docs: DataFrame, text: str, lengths: list[int], filter_bits) -> DataFrame:
    """(dk, h): the distinct runs of each document that pass the filter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bits = Tokens(), filter_bits.value
        for batch in slices(batches):
            keys, found, many = batch.column("dk"), [], []
            for said in batch.column("t"):
                t = tokens(said.as_py())
                h = np.unique(np.concatenate([(h := mixed(rolling(t, n), n))[passes(bits, h)] for n in lengths]))
                found.append(h)
                many.append(len(h))
            take = pa.array(np.repeat(np.arange(len(many)), many))
            yield pa.RecordBatch.from_arrays([keys.take(take), pa.array(np.concatenate(found).view(np.int64))], names=["dk", "h"])

    rows = docs.select(key_of(text).alias("dk"), F.col(f"`{text}`").alias("t")).filter("t is not null and t <> ''")
    return rows.mapInArrow(work, "dk string, h long")


def verdicts(docs: DataFrame, items: DataFrame, pairs: DataFrame, text: str, seed: int, share: float) -> DataFrame:
    """(dk, ik, part): tiling of the pairs. A document's text and its items travel as rows of their own and meet in
    order, so a task holds one text and one item at a time."""
    asked = stored(pairs.select("dk").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(bloom(asked.select(F.xxhash64("dk").alias("h")), asked.count()))
    # All but few texts stay where they are: the filter takes them out before the join.
    texts = docs.select(key_of(text).alias("dk"), F.col(f"`{text}`").alias("t")).filter("dk is not null")
    texts = texts.filter(may_hold(bits, F.xxhash64("dk"))).join(asked, "dk").dropDuplicates(["dk"])
    none = F.lit(None).cast("string")
    rows = texts.select("dk", none.alias("ik"), "t").unionByName(pairs.join(items, "ik").select("dk", "ik", F.col("item_text").alias("t")))
    rows = rows.repartition("dk").sortWithinPartitions("dk", F.col("ik").asc_nulls_first())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, doc = Tokens(), np.zeros(0, np.uint64)
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for dk, ik, t in zip(batch.column("dk").to_pylist(), batch.column("ik").to_pylist(), batch.column("t"), strict=True):
                own = tokens(t.as_py())
                if ik is None:
                    doc = own
                    continue
                for col, v in zip(out, (dk, ik, coverage(own, doc, seed, share)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["dk", "ik", "part"])

    return rows.mapInArrow(work, "dk string, ik string, part double")


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = 5, share: float = 0.5, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds to the columns `keep` (doc_id if not given): item_ids (array of the items that contaminate the document),
    coverage (the largest share of an item that was marked, of those compared to the end) and contaminated.

    Tokens are runs of letters and digits, lower-cased; letters of scripts without spaces are tokens one by one. An item
    of fewer than `seed` tokens contaminates documents that hold all of it in one piece. Items with null id or text or
    without tokens take no part; items that repeat an id count under that id. Null or empty texts hold no item. Of
    equally long runs the first in the document is marked, then the first in the item. A row's verdict depends on its
    text alone, so rows that repeat an id or a text are judged alike or apart as their texts are. Texts are read whole,
    however long; other columns pass through or are ignored; an empty table of documents gives no rows, an empty
    benchmark contaminates nothing.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter("item_id is not null and item_text is not null")
    named = stored(named.withColumn("ik", key_of("item_text")).distinct())
    items = named.select("ik", "item_text").dropDuplicates(["ik"])
    runs = stored(item_runs(items, seed, share))
    lengths = sorted(r["n"] for r in runs.select("n").distinct().collect())  # at most `seed` numbers
    if lengths:
        distinct = runs.select("h").distinct()
        held = stored(document_runs(docs, text, lengths, spark.sparkContext.broadcast(bloom(distinct, distinct.count()))).distinct())
        # The most frequent runs of an item are left out, as long as a pair over the share must have one of the others.
        often = held.groupBy("h").agg(F.count("*").alias("often"))
        ranked = runs.join(often, "h")
        before = F.sum("places").over(W.partitionBy("ik").orderBy(F.desc("often"), "h"))
        rare = ranked.withColumn("upto", before).filter(F.col("upto") >= F.col("need")).select("ik", "h")
        pairs = stored(held.join(rare, "h").select("dk", "ik").distinct())
        parts = stored(verdicts(docs, items, pairs, text, seed, share).filter("part > 0"))
        hit = F.col("part") >= share
        found = parts.join(named.select("ik", "item_id"), "ik").groupBy("dk").agg(F.array_sort(F.collect_set(F.when(hit, F.col("item_id")))).alias("__items"), F.max("part").alias("__cov"))
        found = stored(found)
    else:
        found = spark.createDataFrame([], "dk string, __items array<bigint>, __cov double")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], key_of(text).alias("__dk")).join(found, F.col("__dk") == F.col("dk"), "left")
    ids = F.coalesce("__items", F.array().cast("array<bigint>"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], ids.alias("item_ids"), F.coalesce("__cov", F.lit(0.0)).alias("coverage"), (F.size(ids) > 0).alias("contaminated"))
