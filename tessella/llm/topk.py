"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are integers.  Documents are dealt by their leading component, so that
ranges of documents are alike, into groups of about ``GROUP``; a group is cut
into blocks of ``BLOCK`` documents with the largest and smallest value of each
term (component).  The bound of a block for a query sums, over the terms, the
larger product with the two.  Each query takes the blocks by falling bound and
scores them through the block's forward index (its rows) until the bound falls
below its k-th score.  Queries come in blocks of ``QUERIES``; a task meets the
groups of its partition one after the other and keeps each query's k best and
so its threshold, and the tasks' results are merged by rank.

Components are whole numbers of any size, held as doubles (32-bit integers where they
fit).  Products are taken in doubles where every sum stays below 2 ** 53, else in 64-bit
integers, and beyond those in Python's; a score that no long holds is given as
the nearest long.

Rules: a vector that is null or holds a null or non-finite component (or one that
is not finite once scaled) takes no part, nor does a row without vec_id; shorter
vectors count as ended by zeros; a query's own rows (same vec_id) are no candidates;
repeated rows are candidates each; of equal query rows one asks, different ones with
one vec_id ask each; ties go to the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

K, BLOCK, GROUP, QUERIES = 10, 64, 8192, 2048


def quantised(scale: float, column: str):
    """(vec_id, lead, big, v): v the integer vector as little-endian 32-bit integers, or doubles if big; lead a rough direction."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(column)), pc.is_valid(batch.column("vec_id"))))
            lists = batch.column(column)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                flat = np.floor(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)  # null becomes nan
            first = np.cumsum(size) - size
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            ok = bad[first + size] == bad[first]
            ids, vecs, leads, bigs = [], [], [], []
            for i in np.flatnonzero(ok).tolist():
                v = flat[first[i] : first[i] + size[i]]
                top = int(np.abs(v).argmax()) if len(v) else 0
                big = bool(len(v)) and abs(v[top]) >= 2**31
                ids.append(i)
                bigs.append(big)
                vecs.append(v.astype("<f8" if big else "<i4").tobytes())
                leads.append(2 * top + (len(v) > 0 and v[top] < 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(ids, pa.int64())), pa.array(leads, pa.int32()), pa.array(bigs, pa.bool_()), pa.array(vecs, pa.binary())], names=["vec_id", "lead", "big", "v"])

    return of


def matrix(column: pa.ChunkedArray, big: pa.ChunkedArray) -> np.ndarray:
    raw = [np.frombuffer(x, dtype="<f8" if wide else "<i4") for x, wide in zip(column.to_pylist(), big.to_pylist(), strict=True)]
    out = np.zeros((len(raw), max(map(len, raw), default=0)))
    for i, x in enumerate(raw):
        out[i, : len(x)] = x
    return out


LONG = np.iinfo(np.int64)


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as the nearest longs."""
    # of the largest components together, so that no single sum is larger
    most = float((np.abs(q).max(axis=0, initial=0) * np.abs(d).max(axis=0, initial=0)).sum())
    if most < 2**53:
        return (q @ d.T).astype(np.int64)
    if most < 2**62 and max(np.abs(q).max(), np.abs(d).max()) < 2**62:
        return q.astype(np.int64) @ d.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in m] for m in (q, d)]
    return np.array([[min(max(sum(x * y for x, y in zip(a, b, strict=True)), LONG.min + 1), LONG.max) for b in whole[1]] for a in whole[0]], dtype=np.int64).reshape(len(q), len(d))


class Best:
    """The k best (score, vec_id) of each query of a block, over all groups met so far; an empty place has the smallest long as score."""

    def __init__(self, ids: np.ndarray, ask: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.ask, self.q, self.k = ids, ask, q, k
        self.score = np.full((len(ids), k), LONG.min)
        self.vec = np.full((len(ids), k), LONG.max)

    def meet(self, ids: np.ndarray, d: np.ndarray, block: int) -> None:
        wide = max(d.shape[1], self.q.shape[1])
        d, q = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (d, self.q))
        cuts = np.arange(0, len(ids), block)
        high, low = np.maximum.reduceat(d, cuts), np.minimum.reduceat(d, cuts)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            bound += (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) * (wide + 4) * 2.0**-52  # what rounding may have taken
        bound[np.isnan(bound)] = np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(q))
        for turn in range(len(cuts)):
            take = order[live, turn]
            # the k-th score is rounded down where a double can't hold it
            kth = np.nextafter(self.score[live, -1].astype(np.float64), -np.inf)
            go = (bound[live, take] >= kth) | (self.score[live, -1] == LONG.min) | (self.score[live, -1] == LONG.min + 1)
            live, take = live[go], take[go]
            if not len(live):
                break
            for b in np.unique(take).tolist():
                rows = live[take == b]
                span = slice(cuts[b], cuts[b] + block)
                got = products(q[rows], d[span])
                own = ids[span][None, :] == self.ids[rows][:, None]
                got[own] = LONG.min
                score = np.concatenate([self.score[rows], got], axis=1)
                vec = np.concatenate([self.vec[rows], np.where(own, LONG.max, ids[span][None, :])], axis=1)
                best = np.lexsort((vec, ~score), axis=1)[:, : self.k]  # ~x falls as x rises, for every long
                self.score[rows], self.vec[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(vec, best, 1)

    def rows(self) -> pa.RecordBatch:
        have = self.score > LONG.min
        per = have.sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, per)), pa.array(np.repeat(self.ask, per)), pa.array(self.vec[have]), pa.array(self.score[have])], names=["query_id", "ask", "vec_id", "score"])


def search(k: int, block: int):
    from .substring import groups

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = None, None
        for table in groups(batches, "cell", 8 << 20):
            cells = table.column("cell").to_numpy()
            for cell in np.unique(cells).tolist():
                part = table.filter(pa.array(cells == cell))
                is_query = part.column("query").to_numpy()
                queries, docs = part.filter(pa.array(is_query)), part.filter(pa.array(~is_query))
                if not queries.num_rows or not docs.num_rows:
                    continue
                if cell >> 32 != held:
                    if best is not None:
                        yield best.rows()
                    queries = queries.sort_by("ask")  # the same order in every cell of the block
                    best, held = Best(queries.column("vec_id").to_numpy(), queries.column("ask").to_numpy(), matrix(queries.column("v"), queries.column("big")), k), cell >> 32
                docs = docs.sort_by([("lead", "ascending"), ("vec_id", "ascending")])
                best.meet(docs.column("vec_id").to_numpy(), matrix(docs.column("v"), docs.column("big")), block)
        if best is not None:
            yield best.rows()

    return of


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = 1024, column: str = "embedding", block: int = BLOCK, group: int = GROUP, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each row that ``is_query`` (a Column over vec_id) holds for."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), column)
    ints = cut(given.mapInArrow(quantised(scale, column), "vec_id long, lead int, big boolean, v binary"))
    counted = ints.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_groups, n_blocks = max(1, math.ceil(counted["n"] / group)), max(1, math.ceil(counted["q"] / queries))
    dealt = ints.withColumn("g", F.lit(0)) if n_groups == 1 else _ranges(ints, n_groups)
    cell = (F.col("b").cast("long") * F.lit(1 << 32) + F.col("g")).alias("cell")
    blocks, all_groups = F.sequence(F.lit(0), F.lit(n_blocks - 1)), F.sequence(F.lit(0), F.lit(n_groups - 1))
    docs = dealt.withColumn("b", F.explode(blocks)).select(cell, F.lit(False).alias("query"), F.lit(0).cast("long").alias("ask"), "vec_id", "lead", "big", "v")
    asked = ints.filter(is_query).dropDuplicates(["vec_id", "v"]).withColumn("ask", F.xxhash64("vec_id", "v"))
    asked = asked.withColumn("b", F.pmod("ask", F.lit(n_blocks))).withColumn("g", F.explode(all_groups)).select(cell, F.lit(True).alias("query"), "ask", "vec_id", "lead", "big", "v")
    parts = docs.unionByName(asked).repartition("cell").sortWithinPartitions("cell").mapInArrow(search(k, block), "query_id long, ask long, vec_id long, score long")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranges(ints: DataFrame, n_groups: int) -> DataFrame:
    """Group numbers by direction; a direction with many vectors takes several groups, chosen by a hash of the id."""
    per = ints.groupBy("lead").agg(F.count("*").alias("m"))  # two rows per component at most: safe to broadcast
    order = Window.orderBy("lead")
    per = per.withColumn("before", F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy(F.lit(1))))
    at = F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("m"))
    return ints.join(F.broadcast(per), "lead").withColumn("g", F.least(F.floor(at * n_groups / F.col("total")), F.lit(n_groups - 1)).cast("int")).drop("m", "before", "total")
