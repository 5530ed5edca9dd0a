"""SimHash near-dedup by multi-index hashing (fingerprints after Charikar, 2002; index after Norouzi, Punjani and Fleet, 2012).

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most r bits, with r = 2q + p and p
of 0 or 1, they differ in at most q bits of the first segment, or in at most q - 1 + p of the second. So each fingerprint is
filed under its segments, a small Hamming ball is enumerated around each segment, the table's matches are fetched and the
complete distances are verified. Of two segments that differ in one bit, only the one with the bit set enumerates the
other: links have no direction.

Skew: documents with equal fingerprints are one class. A bucket (fingerprints with an equal segment) of more than BUCKET
classes is not compared member by member: whoever looks into it enumerates the rest of the distance over the other
segment instead, at most 264 complete fingerprints, and meets the equal ones, so the work stays linear in the classes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.bloom import bloom, passes
from granary.llm.graph import components
from granary.llm.util import slices, stored

SEED, HALF = 42, 32
LOW_HALF = (1 << HALF) - 1
#: Classes of a bucket that are still compared one by one.
BUCKET = 64
#: Shingles whose bits are unpacked at once.
CHUNK = 16_384


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a text with fewer words is one shingle, one without none. Bytes are split and
    lower-cased as the contract says: at space and 0x09 to 0x0D, A to Z alone."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(b" ".join(found), SEED)] if found else [], np.uint64)
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    begins = [0, *ends]
    return np.array([h(joined[begins[k] : ends[k + words - 1] - 1], SEED) for k in range(len(found) - words + 1)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(hashes(t.as_py(), words)) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


def segment(fp: Column, n: int) -> Column:
    return F.shiftrightunsigned(fp, HALF) if n == 0 else fp.bitwiseAND(F.lit(LOW_HALF))


def radii(distance: int) -> tuple[int, int]:
    """How far to look around the first and the second segment; -1: not at all."""
    q, p = divmod(distance, 2)
    return q, q - 1 + p


def probes(classes: DataFrame, distance: int) -> DataFrame:
    """seg, key, fp, d: the keys that each class looks under, d bits from its own segment."""

    def under(n: int, radius: int) -> DataFrame:
        own = segment(F.col("fp"), n)
        ball = F.array(F.struct(own.alias("key"), F.lit(0).alias("d")))
        if radius == 1:
            bits = F.filter(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda b: F.getbit(own, b) == 1)
            one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
            ball = F.concat(ball, F.transform(bits, lambda b: F.struct(own.bitwiseXOR(one(b)).alias("key"), F.lit(1).alias("d"))))
        return classes.select("fp", F.lit(n).alias("seg"), F.explode(ball).alias("p")).select("seg", F.col("p.key").alias("key"), "fp", F.col("p.d").alias("d"))

    both = [under(n, radius) for n, radius in enumerate(radii(distance)) if radius >= 0]
    return both[0] if len(both) == 1 else both[0].unionByName(both[1])


def filed(classes: DataFrame, distance: int) -> DataFrame:
    """seg, key, other: every class under its segments."""
    each = F.array(*[F.struct(F.lit(n).alias("seg"), segment(F.col("fp"), n).alias("key")) for n, r in enumerate(radii(distance)) if r >= 0])
    return classes.select(F.col("fp").alias("other"), F.explode(each).alias("p")).select(F.col("p.seg").alias("seg"), F.col("p.key").alias("key"), "other")


def rest_of_ball(hot_probes: DataFrame, members: np.ndarray, distance: int) -> DataFrame:
    """(a, b): for probes of large buckets, the complete fingerprints within the distance that have the probed key, those
    that `members`, a Bloom filter of the buckets' members, may hold. Of two members of one bucket the smaller looks."""
    masks = {d: np.array([sum(1 << b for b in bits) for w in range(distance - d + 1) for bits in itertools.combinations(range(HALF), w)], np.uint64) for d in (0, 1)}
    held = hot_probes.sparkSession.sparkContext.broadcast(members)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, half = held.value, np.uint64(HALF)
        for batch in slices(batches):
            fp, key = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "key"))
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for f, k, seg, d in zip(fp, key, batch.column("seg").to_pylist(), batch.column("d").to_pylist(), strict=True):
                found = (k << half) | ((f & np.uint64(LOW_HALF)) ^ masks[d]) if seg == 0 else (((f >> half) ^ masks[d]) << half) | k
                found = found[(found > f) if d == 0 else (found != f)]
                found = found[passes(bits, found)]
                a.append(np.full(len(found), f))
                b.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return hot_probes.select("seg", "key", "fp", "d").mapInArrow(work, "a long, b long")


def links_of(classes: DataFrame, distance: int) -> DataFrame:
    """(a, b): classes (fp) that differ in at most `distance` bits."""
    table = filed(classes, distance)
    hot = stored(table.groupBy("seg", "key").agg(F.count("*").alias("held")).filter(F.col("held") > BUCKET).select("seg", "key"))
    near = probes(classes, distance).join(table.join(hot, ["seg", "key"], "left_anti"), ["seg", "key"])
    near = near.filter((F.col("d") > 0) | (F.col("fp") < F.col("other"))).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
    links = near.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if hot.limit(1).count():
        members = stored(table.join(hot, ["seg", "key"], "left_semi").select("other").distinct())
        may = bloom(members.select(F.col("other").alias("h")), members.count())
        found = rest_of_ball(probes(classes, distance).join(hot, ["seg", "key"], "left_semi"), may, distance)
        links = links.unionByName(found.join(members.select(F.col("other").alias("b")), "b").select("a", "b"))
    return links


def simhash_components(docs: DataFrame, words: int = 5, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of `docs` (doc_id, text): documents whose
    fingerprints differ in at most `distance` bits (0 to 3) are linked; component_id is the smallest doc_id reachable.

    A text's fingerprint is that of its `words`-word shingles (words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); null texts
    and those without words have zero, and are linked like any other. Rows that repeat a doc_id are one document, whatever
    their texts. A null doc_id is no id: such a row is in its fingerprint's component, but doesn't name it and links no
    other fingerprints; null if nothing else is there. Texts are read whole, however long; ties do not arise; other columns
    are ignored; an empty table gives no rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("fingerprints are linked at 0 to 3 bits")
    rows = stored(fingerprints(docs, words))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    same_id = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    same_id = rows.join(same_id, "doc_id").filter("fp <> lo").select(F.col("lo").alias("a"), F.col("fp").alias("b"))
    place = components(links_of(classes.select("fp"), distance).unionByName(same_id))
    placed = classes.join(place.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    found = placed.join(named, "component").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _oracle() -> str:
    """The same in SQL, which lacks XXH64: its rounds are spelled out on unsigned numbers of 128 bits."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    cut = lambda x: f"(({x}) % 18446744073709551616::uhugeint)::ubigint"
    mul = lambda a, b: cut(f"({a})::uhugeint * {b}::uhugeint")
    add = lambda a, b: cut(f"({a})::uhugeint + ({b})::uhugeint")
    turn = lambda a, r: f"((({a})::uhugeint * {1 << r}::uhugeint) % 18446744073709551616::uhugeint + ({a}) // {1 << (64 - r)}::uhugeint)::ubigint"
    rounded = lambda acc, x: mul(turn(add(acc, mul(x, p2)), 31), p1)
    number = lambda at, size: f"('0x' || {' || '.join(f'substr(hx, {at} + {2 * k}, 2)' for k in range(size - 1, -1, -1))})::ubigint"
    first = [(SEED + p1 + p2) % 2**64, (SEED + p2) % 2**64, SEED, (SEED - p1) % 2**64]
    lane = lambda k: f"list_reduce(list_transform(range(n // 32), lambda i: {number(f'(64 * i + {16 * k + 1})', 8)}), lambda c, x: {rounded('c', 'x')}, {first[k]}::ubigint)"
    merged = f"list_reduce([v1, v2, v3, v4], lambda c, v: {add(mul(f'xor(c, {rounded('0', 'v')})', p1), p4)}, {add(add(turn('v1', 1), turn('v2', 7)), add(turn('v3', 12), turn('v4', 18)))})"
    eights = f"list_reduce(list_transform(range((n % 32) // 8), lambda i: {rounded('0', number('(64 * (n // 32) + 16 * i + 1)', 8))}), lambda c, x: {add(mul(turn('xor(c, x)', 27), p1), p4)}, a)"
    four = f"case when n % 8 >= 4 then {add(mul(turn(f'xor(b, {mul(number('(16 * (n // 8) + 1)', 4), p1)})', 23), p2), p3)} else b end"
    ones = f"list_reduce(list_transform(range(n % 4), lambda i: {mul(number('(8 * (n // 4) + 2 * i + 1)', 1), p5)}), lambda x, y: {mul(turn('xor(x, y)', 11), p1)}, c)"
    bits = ", ".join(f"sum((h >> {k}) & 1)" for k in range(64))
    return rf"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh from w),
x1 as materialized (select sh, hex(encode(sh)) as hx, octet_length(encode(sh)) as n from (select distinct sh from s)),
x2 as materialized (select *, {", ".join(f"{lane(k)} as v{k + 1}" for k in range(4))} from x1),
x3 as materialized (select sh, hx, n, {add(f"case when n >= 32 then {merged} else {(SEED + p5) % 2**64}::ubigint end", "n")} as a from x2),
x4 as materialized (select sh, hx, n, {eights} as b from x3),
x5 as materialized (select sh, hx, n, {four} as c from x4),
x6 as materialized (select sh, {ones} as d from x5),
x7 as materialized (select sh, {mul("xor(d, d >> 33)", p2)} as e from x6),
x8 as materialized (select sh, {mul("xor(e, e >> 29)", p3)} as f from x7),
x9 as materialized (select sh, xor(f, f >> 32) as h from x8),
k as (select doc_id, count(*) as n, [{bits}] as c from s join x9 using (sh) group by doc_id),
f as materialized (select d.doc_id, coalesce(list_reduce(list_transform(range(64), lambda i: case when 2 * c[i + 1] > n then 1::uhugeint << i::uhugeint else 0::uhugeint end), lambda x, y: x + y)::ubigint, 0::ubigint) as fp
  from documents d left join k on k.doc_id = d.doc_id),
u as materialized (select fp, min(doc_id) as lo from f group by fp),
e as materialized (select a.lo as a, b.lo as b from u a join u b on a.fp <> b.fp and bit_count(xor(a.fp, b.fp)::bit) <= 2),
r as (select lo as node, lo as seen from u union select r.node, e.b from r join e on e.a = r.seen),
m as (select node, min(seen) as component_id from r group by 1)
select f.doc_id, lpad(lower(hex(f.fp)), 16, '0') as fingerprint, m.component_id from f join u on u.fp = f.fp join m on m.node = u.lo
"""


ORACLE = _oracle()
