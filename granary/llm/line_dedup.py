"""Line dedup by a sharded minimal perfect hash.

Every distinct line of the corpus is a key. Keys are dealt into shards by their hash; each shard gets a minimal perfect
hash (a cascade of bit arrays, as in BBHash, Limasset et al. 2017) that maps its n keys to 0..n-1, where two plain
arrays hold a fingerprint and the number of documents with that line. Documents send their lines' hashes to the shards
and read the counts there; lines themselves are never joined or shuffled.

Skew: counting has map-side partial aggregation. A shard whose lines stand in very many documents is probed in several
copies, as many as its load asks for, so no task sees more than a fixed multiple of the mean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.util import WHITE, arrow_schema, shuffle_partitions, slices, stored

#: Keys a shard holds at most on average: its arrays stay near 1 MB.
SHARD_KEYS = 100_000
SPARK_XXHASH_SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


# --- minimal perfect hash of one shard -------------------------------------------------------------------------------


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """splitmix64 of the keys, another one for each level."""
    z = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash over distinct uint64 keys with fingerprint and count arrays."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> None:
        self.sizes, self.prints, self.counts = sizes, prints, counts
        self.bits = bits
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """At each level, keys that are alone in their place stay; the others go on to the next, fresh level."""
        left, sizes, levels = np.arange(len(keys)), [], []
        while len(left):
            size = max(8, 2 * len(left))
            at = (_mix(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        out = cls(np.array(sizes, np.int64), bits, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64))
        slots = out.slots(keys)
        out.prints[slots], out.counts[slots] = fingerprints(keys), counts
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it falls through all levels (it is then no key of this hash)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys; 0 where the fingerprint says that it is no key of this hash."""
        slots = self.slots(keys)
        safe = np.maximum(slots, 0)
        if not len(self.counts):
            return np.zeros(len(keys), np.int64)
        return np.where((slots >= 0) & (self.prints[safe] == fingerprints(keys)), self.counts[safe], 0)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        width = np.uint32 if not len(self.counts) or self.counts.max() < 2**32 else np.uint64
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes(), self.prints.tobytes(), self.counts.astype(width).tobytes()

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes) -> PerfectHash:
        n = np.frombuffer(sizes, np.int64)
        p = np.frombuffer(prints, np.uint32)
        width = np.uint32 if len(counts) == 4 * len(p) else np.uint64
        flags = np.unpackbits(np.frombuffer(bits, np.uint8))[: n.sum()].astype(bool)
        return cls(n, flags, p, np.frombuffer(counts, width).astype(np.int64))


INDEX = "shard int, sizes binary, bits binary, prints binary, counts binary"


# --- Spark ---------------------------------------------------------------------------------------------------------


def line_keys(text: Column) -> Column:
    """Array of the distinct hashes of the text's line keys; empty keys are left out."""

    def hashed(line: Column) -> Column:
        key = F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)
        return F.when(key != "", F.xxhash64(key))

    return F.array_compact(F.array_distinct(F.transform(F.split(text, "\n", -1), hashed)))


def line_key(line: str) -> str:
    return line.strip(WHITE).translate(TO_LOWER)


def build_index(hashes: DataFrame) -> tuple[DataFrame, int]:
    """The index of all distinct line hashes, one row per shard, and the number of shards. `hashes`: one row with
    column h for each document and distinct line."""
    spark = hashes.sparkSession
    counted = stored(hashes.groupBy("h").agg(F.count("*").alias("n")))
    shards = max(8 * shuffle_partitions(spark), -(-counted.count() // SHARD_KEYS))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["h"].to_numpy(np.int64).view(np.uint64)
        index = PerfectHash.build(keys, pdf["n"].to_numpy(np.int64))
        return pd.DataFrame([(key[0], *index.pack())], columns=["shard", "sizes", "bits", "prints", "counts"])

    dealt = counted.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(build, INDEX)), shards


def probe(hashes: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The rows (rk, h) of `hashes` whose line stands in at least min_docs documents, by the index arrays."""
    spark = hashes.sparkSession
    parts = shuffle_partitions(spark)
    hashes = hashes.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    load = stored(hashes.groupBy("shard").agg(F.count("*").alias("load")), 1)
    total = load.agg(F.sum("load")).first()[0] or 0
    share = max(1000, total // (4 * parts))
    # At most 4 * parts shards have more than the share, so this table is bounded and safe to broadcast.
    heavy = load.filter(F.col("load") > share).select("shard", F.ceil(F.col("load") / share).cast("int").alias("copies"))
    with_copies = lambda df: df.join(F.broadcast(heavy), "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    sent = with_copies(hashes).select("shard", F.pmod(F.hash("rk"), F.col("copies")).alias("copy"), F.lit(1).alias("kind"), "rk", "h")
    arrays = with_copies(index).select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rk"), F.lit(0).cast("long").alias("h"), "sizes", "bits", "prints", "counts")
    both = arrays.unionByName(sent, allowMissingColumns=True)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, index = None, None
        for pdf in batches:
            place = pdf["shard"].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(place)] if len(place) else [0]
            rks, hs = [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = pdf.iloc[i:j]
                kind = part["kind"].to_numpy()
                if (kind == 0).any():
                    row = part.iloc[int(np.flatnonzero(kind == 0)[0])]
                    at, index = place[i], PerfectHash.unpack(row["sizes"], row["bits"], row["prints"], row["counts"])
                asked = part[kind == 1]
                if not len(asked):
                    continue
                if at != place[i]:
                    raise RuntimeError(f"shard {place[i]} has no index arrays")
                h = asked["h"].to_numpy(np.int64)
                often = index.lookup(h.view(np.uint64)) >= min_docs
                rks.append(asked["rk"].to_numpy(np.int64)[often])
                hs.append(h[often])
            yield pd.DataFrame({"rk": np.concatenate(rks) if rks else np.zeros(0, np.int64), "h": np.concatenate(hs) if hs else np.zeros(0, np.int64)})

    dealt = both.repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return dealt.mapInPandas(look, "rk long, h long")


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Drops every line whose key (stripped, A-Z lower-cased, at least one code point) stands in at least `min_docs`
    documents, in every document. Each row is a document, so repeated rows and ids count as often as they stand there.

    Returns the columns `keep` (doc_id if not given) with n_lines (before dropping), n_dropped and kept (the other
    lines, joined by line feeds). Null or empty text is one empty line, which has no key and stays. Whole texts are
    split, however long; null ids and other columns pass through; an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    rk = F.xxhash64("doc_id", "text")  # rows only meet here to read decisions about lines, so equal rk do no harm
    hashes = stored(docs.select(rk.alias("rk"), F.explode(line_keys(F.coalesce("text", F.lit("")))).alias("h")))
    index, shards = build_index(hashes.select("h"))
    drops = probe(hashes, index, shards, min_docs).groupBy("rk").agg(F.collect_set("h").alias("__drops")).withColumnRenamed("rk", "__rk")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"), rk.alias("__rk"))
    rows = rows.join(drops, "__rk", "left").drop("__rk")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines, dropped, kept = [], [], []
            for text, drops in zip(batch.column("__text"), batch.column("__drops"), strict=True):
                own, out = (text.as_py() or "").split("\n"), set(drops.as_py() or ())
                stay = [x for x in own if not ((key := line_key(x)) and _signed(key) in out)] if out else own
                lines.append(len(own))
                dropped.append(len(own) - len(stay))
                kept.append("\n".join(stay))
            cols = [*[batch.column(c) for c in keep], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_lines", "n_dropped", "kept"])

    return rows.mapInArrow(cut, arrow_schema(rows, keep, "n_lines long, n_dropped long, kept string"))


def _signed(key: str) -> int:
    """The same hash as Spark's xxhash64 of the key."""
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), SPARK_XXHASH_SEED)
    return h - 2**64 if h >= 2**63 else h


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


ORACLE = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, c.key is not null as often from k left join c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (often)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not often), '')) as kept_sha256
from m group by doc_id
"""
