"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised
residuals, asymmetric distance tables and exact reranking (Jegou, Douze and Schmid, 2011).

Cells are packed into groups of about GROUP vectors; a cell with more is cut into several groups, so a cell of any size is
worked off by many tasks. Queries are sent to the groups that hold a cell they look into, in packs, so that neither the vectors
of a group nor its queries travel once for each of the other. A task scores those cells by table look-ups, then exactly
all vectors that the quantisation error leaves in question, and passes on the k best of each query and group, never all
pairs. So what is found is exact within the cells that a query looks into.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.llm.util import shuffle_partitions, slices, stored

#: Rows that centroids and codebooks are fitted on at most, their bytes at most, and rows of it for each cell. Every row is
#: indexed.
SAMPLE, SAMPLE_BYTES, PER_CELL = 65_536, 2**26, 16
#: Distances to centroids that are held at once.
AT_ONCE = 2**22
#: Vectors in a group and queries that meet it at once, dealt in tiles of queries; pairs scored exactly at once.
GROUP, QUERIES, TILE, PAIRS = 4_096, 2_048, 256, 262_144
#: Queries that travel to a group in one row.
PACKED = 1_024
SUBSPACES, CODES, ROUNDS, SEED = 32, 256, 8, 11
#: Of the true neighbours within the sample, at least this share must lie in the cells that a query looks into.
REACH, TRIALS = 0.95, 256


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        held = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        c = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], x[rng.integers(len(x), size=k)]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, a few rows at a time: rows times centroids are never held together."""
    half, out, rows = 0.5 * (c * c).sum(axis=1), np.empty(len(x), np.int64), max(1, AT_ONCE // len(c))
    for at in range(0, len(x), rows):
        s = x[at : at + rows] @ c.T
        s -= half
        out[at : at + rows] = s.argmax(axis=1)
    return out


class Quantizer:
    """Coarse centroids and, for the residuals, a codebook for each subspace."""

    def __init__(self, x: np.ndarray, cells: int) -> None:
        self.dim = x.shape[1]
        self.m = next(m for m in range(min(SUBSPACES, self.dim), 0, -1) if self.dim % m == 0)
        self.coarse = kmeans(x, cells, SEED)
        rest = x - self.coarse[nearest(x, self.coarse)]
        step = self.dim // self.m
        self.books = [kmeans(rest[:, i * step : (i + 1) * step], CODES, SEED + 1 + i) for i in range(self.m)]

    def probes(self, x: np.ndarray, k: int) -> int:
        """Cells to look into: as many as bring REACH of the true k nearest of some rows of the sample."""
        held, needed = nearest(x, self.coarse), []
        q = x[:: max(1, len(x) // TRIALS)]
        for at in range(0, len(q), rows := max(1, AT_ONCE // len(x))):
            part = q[at : at + rows]
            best = np.argpartition(-(part @ x.T), min(k, len(x) - 1), axis=1)[:, : k + 1]
            order = np.argsort(-(part @ self.coarse.T), axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
            needed.append(np.take_along_axis(place, held[best], axis=1).ravel())
        needed = np.concatenate(needed)
        return int(np.quantile(needed, REACH, method="higher")) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and how far an approximate score may be from the exact one for a query of length 1: the length of
        what the codes leave of the vector, and the rounding of single precision."""
        x, exact = x.astype(np.float32), x
        cell = nearest(x, self.coarse)
        rest, step = x - self.coarse[cell], self.dim // self.m
        codes = np.stack([nearest(rest[:, i * step : (i + 1) * step], b) for i, b in enumerate(self.books)], axis=1)
        coded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1).astype(np.float64)
        size = [np.linalg.norm(v, axis=1) for v in (self.coarse[cell].astype(np.float64), coded)]
        error = np.linalg.norm(exact - self.coarse[cell] - coded, axis=1)
        return cell.astype(np.int32), codes.astype(np.uint8), error + (self.dim + self.m + 8) * 2.0**-23 * (size[0] + size[1] + error)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the queries' inner products with its codebook."""
        step = self.dim // self.m
        return [q[:, i * step : (i + 1) * step] @ b.T for i, b in enumerate(self.books)]


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, in single precision where that loses nothing."""
    y = x.astype(np.float32)
    return [b.tobytes() if same else a.tobytes() for a, b, same in zip(x, y, (x == y).all(axis=1), strict=True)]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in rows]).astype(np.float64)


def packed_all(x: np.ndarray) -> bytes:
    """All rows in one piece, in single precision where that loses nothing."""
    y = x.astype(np.float32)
    return (y if (x == y).all() else x).tobytes()


def unpacked_all(piece: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(piece, np.float32 if len(piece) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def in_order(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of q[row] and x[col], summed one component after the other: equal vectors score equal to the bit."""
    out = np.zeros(len(row))
    for at in range(0, len(row), PAIRS):
        cut = slice(at, at + PAIRS)
        for d in range(q.shape[1]):
            out[cut] += q[row[cut], d] * x[col[cut], d]
    return out


def kth(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf if there are fewer."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(s), -np.inf)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (rid, id, v) whose vector is neither null nor zero and has no null or non-finite component. rid tells rows apart."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    return rows.withColumn("rid", F.monotonically_increasing_id())


def fit(rows: DataFrame, n: int, dim: int, k: int) -> tuple[Quantizer, int]:
    """The quantizer and the number of cells to probe. Fits on the SAMPLE rows with the smallest hash of their id, fewer if
    they would be over SAMPLE_BYTES in single precision. Cells grow with the root of the number of rows, as far as the
    sample can place them."""
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * dim)))
    single = F.transform("v", lambda x: x.cast("float")).alias("v")
    sample = rows.orderBy(F.xxhash64("id"), "id", "rid").limit(most).select(single).toArrow()
    x = np.asarray(sample.column("v").combine_chunks().flatten()).astype(np.float32, copy=False).reshape(-1, dim)
    quant = Quantizer(x, cells=max(1, min(most // PER_CELL, int(4 * math.sqrt(n)), -(-len(x) // PER_CELL))))
    return quant, quant.probes(x, k)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow lists of dim numbers each as rows."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), dim)


def layout(held: np.ndarray) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Cells dealt into groups of about GROUP vectors: the cells of each group, and each cell's first group and number of
    groups. A cell with more than GROUP vectors has groups of its own."""
    groups, place, room = [], [], 0
    for cell, size in enumerate(held.tolist()):
        parts = max(1, -(-size // GROUP))
        if size > room:
            room = GROUP if parts == 1 else 0
            place.append((len(groups), parts))
            groups += [[cell] for _ in range(parts)]
        else:
            place.append((len(groups) - 1, 1))
            groups[-1].append(cell)
        room = max(0, room - size)
    return groups, place


def search(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    probes: int | None = None,
) -> DataFrame:
    """For each row of `queries` (None: rows of `vectors` whose id is divisible by 20), its k nearest other rows found:
    query_id, rank, vec_id, score (the inner product of the original vectors in double precision; nearest first, ties
    to the smaller id; all candidates if there are fewer).

    probes: cells that a query looks into, those whose centroid has the largest inner product with it; if not given,
    as many as reach REACH of the true neighbours within the sample that the index is fitted on. A query looks into more
    where these hold fewer than k candidates. Within the cells that it looks into, the k nearest are found for certain.
    Rows with a null id, or a vector that is null, zero, of another length than the most frequent one (of equally
    frequent ones, the smallest), or with null or non-finite components take no part. Rows that repeat an id are rows like
    any others: each is a candidate of the others, and each a query. Rows of a given table `queries` leave out candidates
    with their own id. An empty table, or one without usable rows, gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vec_col))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes["dim"], sizes["n"]
    rows = rows.filter(F.size("v") == dim)
    quant, reach = fit(rows, n, dim, k)
    cells = len(quant.coarse)
    probes = min(cells, probes or reach)
    own_rows = queries is None
    asked = rows.filter(F.col("id") % 20 == 0) if own_rows else stored(usable(queries, id_col, vec_col).filter(F.size("v") == dim))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            cell, codes, error = quant.encode(x)
            cols = [batch.column("rid"), batch.column("id"), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(packed(x), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "id", "cell", "codes", "error", "v"])

    coded = stored(rows.mapInArrow(encode, "rid long, id long, cell int, codes binary, error double, v binary"))
    # As many rows as cells, which SAMPLE bounds: their sizes and places may come to the driver and go to every task.
    held = np.zeros(cells, np.int64)
    for r in coded.groupBy("cell").agg(F.count("*").alias("held")).collect():
        held[r["cell"]] = r["held"]
    groups, place = layout(held)
    places = spark.createDataFrame([(c, g, parts) for c, (g, parts) in enumerate(place)], "cell int, first int, parts int")

    def pack_list(table: pa.Table) -> pa.Table:
        """One row per group: its columns as bytes."""
        x = unpacked(table.column("v").to_pylist(), dim)
        whole = packed_all(x)
        row = {c: [table.column(c).to_numpy().tobytes()] for c in ("rid", "id", "cell", "error")}
        return pa.table({"group": table.column("group")[:1], **row, "codes": [b"".join(table.column("codes").to_pylist())], "v": [whole]})

    part = (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts"))).cast("int")
    lists = coded.join(F.broadcast(places), "cell").select(part.alias("group"), "rid", "id", "cell", "codes", "error", "v")
    lists = stored(lists.groupBy("group").applyInArrow(pack_list, "group int, rid binary, id binary, cell binary, error binary, codes binary, v binary"))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries packed for each group that holds a cell they look into, PACKED at most in a row."""
        for whole in batches:
            for batch in slices([whole], PACKED):
                x = matrix(batch.column("v"), dim)
                rid, ids = (batch.column(c).to_numpy() for c in ("rid", "id"))
                looks = np.zeros((len(x), cells), bool)
                for at in range(0, len(x), TILE):
                    order = np.argsort(-(x[at : at + TILE].astype(np.float32) @ quant.coarse.T), axis=1, kind="stable")
                    enough = (np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1
                    np.put_along_axis(looks[at : at + TILE], order, np.arange(cells)[None, :] < np.maximum(probes, enough)[:, None], axis=1)
                for g, own in enumerate(groups):
                    sub = looks[:, own]
                    at = np.flatnonzero(sub.any(axis=1))
                    if len(at):
                        pieces = (rid[at].tobytes(), ids[at].tobytes(), np.packbits(sub[at], axis=1).tobytes(), packed_all(x[at]))
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([len(at)], pa.int64()), *(pa.array([p], pa.binary()) for p in pieces)], names=["group", "n", "rid", "id", "mask", "v"])

    sent = stored(asked.mapInArrow(probed, "group int, n long, rid binary, id binary, mask binary, v binary"))
    wanted = stored(sent.groupBy("group").agg(F.ceil(F.sum("n") / QUERIES).cast("int").alias("packs")), 1)

    def pack_asked(table: pa.Table) -> pa.Table:
        row = {f"q_{c}": [b"".join(table.column(c).to_pylist())] for c in ("rid", "id", "mask")}
        x = np.concatenate([unpacked_all(v, n, dim) for v, n in zip(table.column("v").to_pylist(), table.column("n").to_pylist(), strict=True)])
        return pa.table({"group": table.column("group")[:1], "pack": table.column("pack")[:1], **row, "q_v": [packed_all(x)]})

    pairs_n = wanted.agg(F.sum("packs")).first()[0] or 0
    # A few pairs of a pack and a group in each partition, so that one batch stays small.
    parts = max(shuffle_partitions(spark), int(pairs_n) // 4)
    packs = sent.join(wanted, "group").withColumn("pack", F.pmod(F.xxhash64("rid"), F.col("packs")).cast("int"))
    packs = packs.groupBy("group", "pack").applyInArrow(pack_asked, "group int, pack int, q_rid binary, q_id binary, q_mask binary, q_v binary")
    copies = lists.join(wanted, "group").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1))).drop("packs")
    pairs = packs.repartition(parts, "group", "pack").join(copies.repartition(parts, "group", "pack"), ["group", "pack"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                b = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                for found in best_of(b):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["rid", "query_id", "vec_id", "score"])

    def best_of(b: dict) -> Iterator[tuple[np.ndarray, ...]]:
        """The k best of a group for the queries of a pack, in tiles of both."""
        rids, ids, cell, error = (np.frombuffer(b[c], t) for c, t in (("rid", np.int64), ("id", np.int64), ("cell", np.int32), ("error", np.float64)))
        codes = np.frombuffer(b["codes"], np.uint8).reshape(len(ids), quant.m)
        x, all_q = unpacked_all(b["v"], len(ids), dim), unpacked_all(b["q_v"], len(b["q_id"]) // 8, dim)
        own = groups[b["group"]]
        masks = np.unpackbits(np.frombuffer(b["q_mask"], np.uint8).reshape(len(all_q), -1), axis=1)[:, : len(own)].astype(bool)
        column = np.searchsorted(own, cell)
        q_rids, q_ids = np.frombuffer(b["q_rid"], np.int64), np.frombuffer(b["q_id"], np.int64)
        longest = np.linalg.norm(x, axis=1).max()
        for first in range(0, len(all_q), TILE):
            cut_q = slice(first, first + TILE)
            q, row, col, s = all_q[cut_q], [], [], []
            length = np.linalg.norm(q, axis=1)
            # Rounding of a sum in double precision, whatever its order.
            slack = 4 * dim * 2.0**-52 * length * longest
            coarse, tables = q.astype(np.float32) @ quant.coarse[own].T, quant.tables(q.astype(np.float32))
            for at in range(0, len(ids), GROUP):  # parts of a large cell are dealt by hash and may be somewhat larger
                cut = np.arange(at, min(at + GROUP, len(ids)))
                near = coarse[:, column[cut]]
                for i, t in enumerate(tables):
                    near += t[:, codes[cut, i]]
                other = (rids[None, cut] != q_rids[cut_q, None]) if own_rows else (ids[None, cut] != q_ids[cut_q, None])
                seen, most = masks[cut_q][:, column[cut]] & other, length[:, None] * error[None, cut]
                edge = kth(np.where(seen & np.isfinite(near), near - most, -np.inf), k)
                seen &= ~(near + most < edge[:, None])
                some = np.flatnonzero(seen.any(axis=0))
                exact = np.where(seen[:, some], q @ x[cut[some]].T, -np.inf)
                r, c = np.nonzero(seen[:, some] & (exact >= (kth(exact, k) - 2 * slack)[:, None]))
                row.append(r)
                col.append(cut[some[c]])
                s.append(in_order(q, x, row[-1], col[-1]))
            row, col, s = (np.concatenate(v) for v in (row, col, s))
            order = np.lexsort((ids[col], -s, row))
            row, col, s = row[order], col[order], s[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, s = row[best], col[best], s[best]
            yield q_rids[cut_q][row], q_ids[cut_q][row], ids[col], s

    found = pairs.mapInArrow(score, "rid long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
