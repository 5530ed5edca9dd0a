"""MinHash near-dedup by a multi-index Hamming join (after Norouzi, Punjani and Fleet, 2012, on b-bit minwise hashes of
Li and Konig, 2010).

A document's signature is PLACES minwise hashes of its shingle set, cut to BITS bits each. Two signatures' distance is
the number of places that differ; pairs with a distance of up to LIMIT must be found. The places are split into CHUNKS
chunks; by the pigeonhole principle some chunk of such a pair differs in at most ERRORS places. So each signature is
filed, for every chunk, under every choice of places that may differ, with the other places as the key: two signatures
within LIMIT share a key for certain. What shares a key is confirmed on the full shingle sets.

With a similarity of s, places differ with probability 1 - s, independently: a pair at exactly 0.85 is beyond LIMIT with
probability 3e-7, one at exactly 0.8 with 2e-5, and any link between others of its group leads to the same component.

Skew: documents with the same set are one class, joined once. In a key's bucket, every member is first confirmed against
the first member, a linear number of pairs. The members of buckets that still hold several components are compared
further where they share one of their rarest shingles, which linked sets always do, so a bucket of many documents that are
half alike costs no more than its members. Only under a shingle that is rare for many of them and shared by several
components are pairs worked off in blocks of bounded size; a task passes on at most one link per member, never all pairs.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.graph import components
from granary.llm.line_dedup import TO_LOWER
from granary.llm.util import shuffle_partitions, slices, stored

CHUNKS, WIDTH, ERRORS, BITS = 5, 5, 2, 16
PLACES, LIMIT = CHUNKS * WIDTH, CHUNKS * (ERRORS + 1) - 1
#: The places of a chunk that make a key, for each choice of those that may differ.
CHOICES = list(itertools.combinations(range(WIDTH), WIDTH - ERRORS))
#: Holders of a shingle whose pairs are listed; members of a block where they are more.
FEW, BLOCK = 32, 512
#: Slots that tell about how often a shingle occurs.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_rng = np.random.default_rng(2024)
MULTIPLY = _rng.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, PLACES, dtype=np.uint64)


class Shingler:
    """Distinct shingle hashes of texts; remembers words' hashes up to a bound."""

    def __init__(self, words: int, most: int = 1_000_000) -> None:
        self.words, self.most, self.known = words, most, {}

    def hashed(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; fewer words than a shingle has are one shingle, none are none."""
        h = self.hashed(WORD.findall((text or "").translate(TO_LOWER)))
        if not len(h):
            return h
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(31)))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 16_384):
        part = shingles[i : i + 16_384]
        np.minimum(low, (part[:, None] * MULTIPLY + ADD).min(axis=0), out=low)
    return (low & np.uint64(2**BITS - 1)).astype(np.uint16)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, digest of the set and signature; null for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches):
            size, digest, sig = [], [], []
            for text in batch.column("text"):
                s = shingler(text.as_py())
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            cols = [batch.column("doc_id"), batch.column("th"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n_shingles", "digest", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(work, "doc_id long, th long, n_shingles long, digest binary, sig binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), PLACES)


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """A row per signature, a column per chunk and choice; the last bits tell the columns apart."""
    out = []
    for chunk in range(CHUNKS):
        part = sigs[:, chunk * WIDTH : (chunk + 1) * WIDTH].astype(np.int64)
        for n, places in enumerate(CHOICES):
            key = np.zeros(len(sigs), np.int64)
            for p in places:
                key = (key << BITS) | part[:, p]
            out.append((key << 8) | (chunk * len(CHOICES) + n))
    return np.stack(out, axis=1)


def filed(reps: DataFrame) -> DataFrame:
    """(key, rep): every key of every class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = keys_of(matrix(batch.column("sig")))
            rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(work, "key long, rep long")


def close(pairs: DataFrame) -> DataFrame:
    """Of (a, b, sig_a, sig_b), the pairs (a, b) within LIMIT."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                apart = (matrix(batch.column("sig_a")) != matrix(batch.column("sig_b"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(apart <= LIMIT))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    few, many = sorted((len(x), len(y)))
    if 100 * few < percent * many:
        return False
    both = few + many - len(np.union1d(x, y)) if few < 64 else len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (few + many - both)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, set_a, set_b), the links (a, b)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            fine = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(work, "a long, b long")


def sets_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, set): the full shingle sets of wanted classes, from the texts of one document of each."""
    chosen = reps.join(wanted, "rep").select(F.col("rep"), F.col("doc_id").alias("rep_doc"), F.col("th").alias("rep_th"))
    rows = docs.select(F.col("doc_id").cast("long").alias("rep_doc"), F.xxhash64("text").alias("rep_th"), "text").join(chosen, ["rep_doc", "rep_th"]).select("rep", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches):
            sets = [shingler(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "set"])

    return rows.mapInArrow(work, "rep long, set binary").dropDuplicates(["rep"])


def slot_counts(sets: DataFrame) -> np.ndarray:
    """About how often shingles occur in the sets: counts in SLOTS slots, a fixed 8 MB, summed in Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in slices(batches):
            for x in batch.column("set"):
                np.add.at(counts, (np.frombuffer(x.as_py(), np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])

    found = sets.select("set").mapInArrow(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, so many that any set linked with it has one of them in its own prefix: the order is
    one for all sets, and more than |A| - percent |A| / 100 shingles of A can't all be missing in a linked set."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
    return shingles[order[: n + 1 + (-percent * n) // 100]]


def prefixes(sets: DataFrame, counts, percent: int) -> DataFrame:
    """(key, rep, comp): every set under each shingle of its prefix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [prefix(np.frombuffer(x.as_py(), np.uint64), counts.value, percent) for x in batch.column("set")]
            if own:
                key, size = np.concatenate(own).view(np.int64), [len(x) for x in own]
                again = lambda c, size=size, batch=batch: pa.array(np.repeat(batch.column(c).to_numpy(), size))
                yield pa.RecordBatch.from_arrays([pa.array(key), again("rep"), again("comp")], names=["key", "rep", "comp"])

    return sets.select("set", "rep", "comp").mapInArrow(work, "key long, rep long, comp long")


def compare_blocks(members: DataFrame, counts, percent: int) -> DataFrame:
    """Links between different components within each (key, p, q) pair of blocks. A pair of documents is compared only
    under the first shingle that their prefixes share."""

    def work(key: tuple, data: pa.Table) -> pa.Table:
        own_key, p, q = np.int64(key[0].as_py()).view(np.uint64), key[1].as_py(), key[2].as_py()
        data = data.combine_chunks().sort_by("rep")
        rep, blk = data.column("rep").to_numpy(), data.column("blk").to_numpy()
        comp = data.column("comp").to_numpy().copy()
        sigs = matrix(data.column("sig").combine_chunks())
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in data.column("set")]
        sizes = np.array([len(x) for x in sets])
        before, holders = [], {}
        for i, x in enumerate(sets):
            own = prefix(x, counts.value, percent)
            before.append(own[: int(np.flatnonzero(own == own_key)[0])].tolist())
            for h in before[-1]:
                holders.setdefault(h, []).append(i)
        a, b = [], []
        for i in range(len(rep)):
            fine = (np.arange(len(rep)) > i) & (comp != comp[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            if p != q:
                fine &= blk != blk[i]
            for h in before[i]:
                fine[holders[h]] = False
            others = np.flatnonzero(fine)
            for j in others[(sigs[others] != sigs[i]).sum(axis=1) <= LIMIT]:
                if comp[i] != comp[j] and linked(sets[i], sets[j], percent):
                    a.append(rep[i])
                    b.append(rep[j])
                    comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("key", "p", "q").applyInArrow(work, "a long, b long")


def between_components(members: DataFrame, sets: DataFrame, alike, percent: int) -> DataFrame:
    """Links between members (rep, comp, sig) of different components, all within LIMIT that there are.

    Members meet by the rarest shingles of their sets (prefix filtering, after Chaudhuri et al., 2006, and Bayardo et al.,
    2007, exact for the threshold), not within the buckets that brought them here: sets that only share a common stock,
    however many they are, don't meet. Of a shingle with few holders, pairs are listed and checked by signature, then by
    set; one with many is worked off in pairs of blocks."""
    spark = members.sparkSession
    sets = stored(members.join(sets, "rep"))
    counts = spark.sparkContext.broadcast(slot_counts(sets))
    keys = stored(prefixes(sets, counts, percent))
    mixed = stored(keys.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).filter("lo <> hi").select("key", "held"))
    few = keys.join(mixed.filter(F.col("held") <= FEW), "key")
    pairs = few.select("key", F.col("rep").alias("a"), F.col("comp").alias("comp_a")).join(few.select("key", F.col("rep").alias("b"), F.col("comp").alias("comp_b")), "key")
    pairs = stored(close(alike(pairs.filter("a < b and comp_a <> comp_b").select("a", "b").distinct())))
    own = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}"))
    links = confirmed(pairs.join(own("a"), "a").join(own("b"), "b"), percent)
    many = mixed.filter(F.col("held") > FEW)
    if not many.limit(1).count():
        return links
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    rows = keys.join(many, "key").select("key", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("blk"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "blk", "rep").join(sets, "rep")
    return links.unionByName(compare_blocks(rows.repartition(shuffle_partitions(spark), "key", "p", "q"), counts, percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by 100 * |A and B| >= percent * |A or B| of their sets of `words`-word shingles
    (words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with fewer words, the whole sequence is the one shingle).

    One row per row of `docs`: doc_id, th (a hash of the text), n_shingles, component_id (the smallest doc_id of its
    component), kept (doc_id = component_id). Texts that are null or have no words have an empty set and are linked
    with nothing. Rows with a null doc_id take no part: their component is null and they are kept. Rows that repeat a
    doc_id and have words are in one component, whatever their texts. Texts are read whole, however long; ties do not arise; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    sigs = stored(signatures(docs, words))
    # One class for each set; its node is a number of its own, so classes that share a doc_id are told apart.
    classes = sigs.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "th", "n_shingles", "sig")).alias("r"))
    classes = classes.select("digest", "r.doc_id", "r.th", F.col("r.n_shingles").alias("n"), F.col("r.sig").alias("sig"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    reps = classes.select("rep", "doc_id", "th", "n", "sig")
    same_id = sigs.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    several = sigs.join(same_id, "doc_id").filter("digest <> lo").select("lo", F.col("digest").alias("hi")).distinct()
    node = lambda d, name: classes.select(F.col("digest").alias(d), F.col("rep").alias(name))
    same_id = stored(several.join(node("lo", "a"), "lo").join(node("hi", "b"), "hi").select("a", "b"))

    # Every member of a bucket against the first one.
    buckets = filed(reps).groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("held")).filter("held > 1")
    buckets = stored(buckets)
    meet = filed(reps).join(buckets, "key")
    pairs = meet.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    alike = lambda p: p.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = stored(close(alike(pairs)))
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = stored(sets_of(docs, reps, wanted, words))
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    links = stored(confirmed(both, percent).unionByName(same_id))
    comps = components(links)

    # Members of buckets of three or more that hold several components may have links that the first member lacks.
    more = buckets.filter("held > 2").select("key")
    members = filed(reps).join(more, "key").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    members = stored(members.select("key", "rep", F.coalesce("component", "rep").alias("comp")))
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    members = stored(members.join(mixed, "key", "left_semi").groupBy("rep").agg(F.min("comp").alias("comp")).join(reps.select("rep", "sig"), "rep"))
    links2 = stored(between_components(members, sets_of(docs, reps, members.select("rep"), words), alike, percent))
    if links2.limit(1).count():
        comps = components(links.unionByName(links2))

    # A component is named by the smallest doc_id of its members, those of repeated ids included.
    placed = classes.select("digest", "rep", F.col("doc_id").alias("own")).join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    smallest = placed.filter("component is not null").groupBy("component").agg(F.min("own").alias("smallest"))
    placed = placed.join(smallest, "component", "left").select("digest", F.coalesce("smallest", "own").alias("named"))
    known = sigs.join(placed, "digest", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("named", "doc_id"))
    out = known.select("doc_id", "th", "n_shingles", comp.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as seen from documents union select r.node, e.b from r join e on e.a = r.seen),
m as (select node, min(seen) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d join m on m.node = d.doc_id left join n on n.doc_id = d.doc_id
"""
