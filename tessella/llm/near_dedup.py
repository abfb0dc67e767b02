"""Near-duplicate documents by bottom-k MinHash sketches of one hash function.

1.  A document's set is its distinct 5-word shingles (lower-cased A-Z); its
    sketch is the ``k`` smallest hashes.  Rows with equal sets form a class and
    only one of them goes on.
2.  Inverted lists hold, for each retained value, the classes that retain it.
    Sets as similar as the threshold share at least ``m`` values of a sketch,
    so a class needs to stand only in the lists of its ``size - m + 1`` rarest
    values: what a frequent passage puts into many sketches makes no list.  Of
    lists with the same members one is kept.
3.  Each list links its members to one pivot; the union sketch (the k smallest
    values of both) estimates the similarity and discards most pairs, exact
    Jaccard on the full sets decides the rest; components join what is linked.
4.  Lists whose members are still in different components travel as they are, each
    member with the ``WIDE`` smallest values of its set, to one task (a list of many
    bytes in blocks, to one task for two blocks that sizes and components leave
    together).  The task compares members of different components only, joins
    what it links and sends on the links that joined something: fewer than the
    list has members.  Of sets that are held whole the comparison is exact; others are
    estimated by the union sketch, and members with a pair that passes are named,
    once each.  Those meet again in the same way with their full sets.

m follows from the threshold: a pair exactly at it fails to share m values of 32
with probability below 1e-7 (m = 15 at 85 %, 12 at 80 %), and of 256 with one below
1e-9 (180 and 163); small sets are held whole and lose nothing.

Rules: a text of one to four words is one shingle; a text without words (or
null) has an empty set and is linked with nothing; rows are documents, so equal
ids are not merged; a row without doc_id takes part, but names no component
(component_id is then null where no linked row has an id); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, cut, release
from .substring import groups
from .words import U64, Words, grams, mix, of_binary, pieces, spread

SHINGLE, PERCENT, K, WIDE = 5, 85, 32, 256
#: Bytes of sets in a block, and members of a block compared at a time.
BLOCK, PART = 4 << 20, 64
#: Columns of an incidence matrix.
COLUMNS = 1 << 15
MISS, WIDE_MISS = 1e-7, 1e-9
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(words: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    all_grams = grams(words.hash, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(all_grams[a : b - size + 1])
        elif b > a:
            yield grams(words.hash[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, dtype=U64)


def class_of(s: np.ndarray) -> int | None:
    """64-bit name of a set; None if empty."""
    return int((mix(s ^ U64(0x5BD1E995)).sum(dtype=U64) ^ U64(len(s))).view(np.int64)) if len(s) else None


def sketches(k: int, size: int = SHINGLE):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                n, cls, low = [], [], []
                ends = [0]
                for s in shingle_sets(Words(batch.column("text"), lower=True), size):
                    n.append(len(s))
                    cls.append(class_of(s))
                    low.append(s[:k])
                    ends.append(ends[-1] + len(low[-1]))
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(low).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), held], names=["doc_id", "n", "cls", "sketch"])

    return of


def held_sets(size: int, most: int | None):
    """(cls, held): the ``most`` smallest values (all if None) of the sets of texts, of the class that ``wanted`` names or, if null, of any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                got = []
                for s, wanted in zip(shingle_sets(Words(batch.column("text"), lower=True), size), batch.column("wanted").to_pylist(), strict=True):
                    c = class_of(s)
                    if c is not None and (wanted is None or c == wanted):
                        got.append((c, s[:most].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["cls", "held"])

    return of


def sets_of(ids: DataFrame, docs: DataFrame, size: int, most: int | None = None, nameless: bool = True) -> DataFrame:
    """(cls, held) for the (cls, doc) of ``ids``; classes whose rows have no doc_id, if there are any, are found by their sets."""
    wanted = ids.select(F.col("doc").alias("_d"), F.col("cls").alias("wanted"))
    texts = docs.join(wanted, F.col("doc_id") == F.col("_d")).select("wanted", "text")
    named = texts.mapInArrow(held_sets(size, most), "cls long, held binary")
    if nameless:
        others = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("wanted"), "text").mapInArrow(held_sets(size, most), "cls long, held binary")
        named = named.unionByName(others.join(ids.filter("doc is null").select("cls"), "cls", "left_semi"))
    return cut(named.dropDuplicates(["cls"]))


def padded(column, k: int) -> np.ndarray:
    flat, length = column.flatten().to_numpy(zero_copy_only=False).view(U64), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.full((len(length), k), _TOP, dtype=U64)
    out[np.arange(k) < length[:, None]] = flat
    return out


def union_shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared values among the k smallest of the union, entries of that union sketch) for rows of sketches."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _TOP)
    fresh = np.ones(both.shape, dtype=bool)
    fresh[:, 1:] = ~twice
    fresh &= both != _TOP
    place = np.cumsum(fresh, axis=1)
    return (twice & (place[:, 1:] <= k)).sum(axis=1), np.minimum(place[:, -1], k)


def plausible(shared: np.ndarray, width: np.ndarray, na: np.ndarray, nb: np.ndarray, k: int, m: int, percent: int) -> np.ndarray:
    """Whether the estimate leaves the pair in; exact where both sets are held whole."""
    small = np.maximum(na, nb) <= k
    inter = np.where(small, shared, np.where(width < k, shared, 0))
    exact = 100 * inter >= percent * (na + nb - inter)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & np.where(small, exact, shared >= m)


def estimate(k: int, m: int, percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            shared, width = union_shared(padded(batch.column("sa"), k), padded(batch.column("sb"), k), k)
            yield batch.select(["a", "b"]).filter(pa.array(plausible(shared, width, na, nb, k, m, percent)))

    return of


def overlaps(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y (flat values, lengths), by products of incidence matrices."""
    both = np.intersect1d(x, y)
    out = np.zeros((len(lx), len(ly)), dtype=np.int64)
    sides = []
    for flat, length in ((x, lx), (y, ly)):
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        hit = both[at] == flat if len(both) else np.zeros(len(flat), dtype=bool)
        sides.append((np.repeat(np.arange(len(length)), length)[hit], at[hit], len(length)))
    for low in range(0, len(both), COLUMNS):
        wide = min(COLUMNS, len(both) - low)
        made = []
        for row, at, rows in sides:
            one = np.zeros((rows, wide), dtype=np.float32)
            mine = (at >= low) & (at < low + wide) if len(both) > COLUMNS else slice(None)
            one[row[mine], at[mine] - low] = 1
            made.append(one)
        out += np.rint(made[0] @ made[1].T).astype(np.int64)
    return out


def padded_rows(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """The first k values of each set, filled up."""
    length = np.minimum(length, k)
    out = np.full((len(begin), k), _TOP, dtype=U64)
    out[np.arange(k) < length[:, None]] = flat[spread(begin, length)]
    return out


class Cell:
    """Members of one list that meet in one task; ``side`` tells two blocks apart, within one block all is 0."""

    def __init__(self, cls: np.ndarray, root: np.ndarray, n: np.ndarray, side: np.ndarray, flat: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.cls, self.n, self.side, self.flat, self.begin, self.length = cls, n, side, flat, begin, length
        self.label = np.unique(root, return_inverse=True)[1]
        self.cross = bool((side != side[0]).any())
        self.links: list[tuple[int, int]] = []
        self.open = np.zeros(len(cls), dtype=bool)

    def union_passes(self, i: np.ndarray, j: np.ndarray, wide: int, gate: int) -> np.ndarray:
        """Whether the union sketch of pairs has ``gate`` shared values."""
        out = np.zeros(len(i), dtype=bool)
        for a in range(0, len(i), 2048):
            part = slice(a, a + 2048)
            x, y = (padded_rows(self.flat, self.begin[k[part]], self.length[k[part]], wide) for k in (i, j))
            out[part] = union_shared(x, y, wide)[0] >= gate
        return out

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.label[a], self.label[b]
            if x != y:
                self.label[self.label == y] = x
                self.links.append((a, b))

    def compare(self, percent: int, wide: int | None, gate: int) -> None:
        """Links between different components; where sets are not held whole, marks of members with a pair that passes the estimate."""
        n, order = self.n, np.argsort(self.n, kind="stable")
        for p in range(0, len(order), PART):
            x = order[p : p + PART]
            for q in range(p, len(order), PART):
                y = order[q : q + PART]
                if 100 * n[x[-1]] < percent * n[y[0]]:
                    break  # sizes rise: no later part is near enough
                apart = (self.label[x][:, None] != self.label[y][None, :]) & (100 * n[x][:, None] >= percent * n[y][None, :])
                if self.cross:
                    apart &= self.side[x][:, None] != self.side[y][None, :]
                if p == q:
                    apart &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
                rows, columns = apart.any(axis=1), apart.any(axis=0)
                if not rows.any():
                    continue
                u, w, apart = x[rows], y[columns], apart[rows][:, columns]
                inter = overlaps(*(z for k in (u, w) for z in (self.flat[spread(self.begin[k], self.length[k])], self.length[k])))
                nu, nw = n[u][:, None], n[w][None, :]
                whole = np.maximum(nu, nw) <= wide if wide else np.ones(apart.shape, dtype=bool)
                i, j = np.nonzero(apart & whole & (100 * inter >= percent * (nu + nw - inter)))
                self.join(u[i], w[j])
                i, j = np.nonzero(apart & ~whole & (inter >= gate))
                i, j = u[i], w[j]
                still = self.label[i] != self.label[j]
                i, j = i[still], j[still]
                if len(i):
                    ok = self.union_passes(i, j, wide, gate)
                    self.open[i[ok]] = True
                    self.open[j[ok]] = True


def compare(percent: int, wide: int | None):
    """Rows (a, b, v): links a, b with v null, and marked members a of list v with b null."""
    gate = least_shared(wide, percent, WIDE_MISS) if wide else 0

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "cell", 4 * BLOCK):
            key, cls, root, n, side, v = (table.column(c).to_numpy() for c in ("cell", "cls", "root", "n", "side", "v"))
            flat, length = of_binary(table.column("held"), U64)
            begin = np.cumsum(length) - length
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            a, b, lists = [], [], []
            for low, high in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                own = slice(low, high)
                cell = Cell(cls[own], root[own], n[own], side[own], flat, begin[own], length[own])
                cell.compare(percent, wide, gate)
                for i, j in cell.links:
                    a.append(int(cls[low + i]))
                    b.append(int(cls[low + j]))
                    lists.append(None)
                for i in np.flatnonzero(cell.open).tolist():
                    a.append(int(cls[low + i]))
                    b.append(None)
                    lists.append(int(v[low]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(lists, pa.int64())], names=["a", "b", "v"])

    return of


def cells(members: DataFrame, percent: int, wide: int | None) -> DataFrame:
    """``members`` (v, cls, root, n) with the cell and side in which they meet: a list of few bytes whole, others by blocks.

    Blocks hold sets of alike size and, where a component is large, of one
    component; pairs of blocks that sizes or components rule out make no cell.
    """
    weight = (F.least("n", F.lit(wide)) if wide else F.col("n")) * 8 + 64
    members = members.withColumn("w", weight)
    light = cut(members.join(members.groupBy("v").agg(F.sum("w").alias("bytes"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").drop("low", "high"), "v"), few=True)
    whole = light.filter(F.col("bytes") <= BLOCK).select("v", "cls", "root", "n", F.xxhash64("v").alias("cell"), F.lit(0).alias("side"))
    if light.filter(F.col("bytes") > BLOCK).isEmpty():
        return whole
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent)) if percent < 100 else F.col("n")
    heavy = light.filter(F.col("bytes") > BLOCK).select("v", "cls", "root", "n", "w", band.cast("long").alias("band"))
    per = heavy.groupBy("v", "band", "root").agg(F.sum("w").alias("w")).withColumn("alone", F.col("w") > BLOCK // 2)
    own = F.when(F.col("alone"), F.col("root")).otherwise(0).alias("own")
    per = per.select("v", "band", "root", "alone", own, "w")
    blocks = per.groupBy("v", "band", "alone", "own").agg(F.ceil(F.sum("w") / BLOCK).alias("blocks"))
    heavy = heavy.drop("w").join(per.drop("w"), ["v", "band", "root"]).join(blocks, ["v", "band", "alone", "own"])
    place = F.pmod(F.xxhash64(F.when(F.col("alone"), F.col("cls")).otherwise(F.col("root"))), F.col("blocks"))
    heavy = heavy.select("v", "cls", "root", "n", F.xxhash64("band", "alone", "own", place).alias("block"))
    about = heavy.groupBy("v", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    other = about.select("v", *(F.col(c).alias(f"{c}2") for c in ("block", "least", "most", "low", "high")))
    meet = about.join(other, "v").filter(f"block <= block2 AND 100 * most >= {percent} * least2 AND 100 * most2 >= {percent} * least AND NOT (low = high AND low2 = high2 AND low = low2)")
    meet = meet.select("v", "block", "block2", F.xxhash64("v", "block", "block2").alias("cell"))
    left = heavy.join(meet.select("v", "block", "cell"), ["v", "block"]).select("v", "cls", "root", "n", "cell", F.lit(0).alias("side"))
    right = heavy.join(meet.filter("block <> block2").select("v", F.col("block2").alias("block"), "cell"), ["v", "block"]).select("v", "cls", "root", "n", "cell", F.lit(1).alias("side"))
    return whole.unionByName(left).unionByName(right)


def meetings(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, size: int, wide: int | None, nameless: bool) -> DataFrame:
    """What ``compare`` finds among the members of each list."""
    met = cells(members, percent, wide)
    held = sets_of(met.select("cls").distinct().join(classes.select("cls", "doc"), "cls"), docs, size, wide, nameless)
    rows = met.join(held, "cls").repartition("cell").sortWithinPartitions("cell")
    return cut(rows.mapInArrow(compare(percent, wide), "a long, b long, v long"), few=True)


def verify(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for fa, fb in zip(batch.column("fa"), batch.column("fb"), strict=True):
                a, b = (np.frombuffer(f.as_buffer(), dtype=U64) for f in (fa, fb))
                inter = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                keep.append(100 * inter >= percent * (len(a) + len(b) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return of


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, size: int, nameless: bool) -> DataFrame:
    """Those of the (a, b) class pairs whose full sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "doc"), "cls")
    sets = sets_of(ids, docs, size, nameless=nameless)
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("held").alias("fa")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("held").alias("fb")), "b")
    return two.select("a", "b", "fa", "fb").mapInArrow(verify(percent), "a long, b long")


def placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls")).drop("component")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    spark, m = docs.sparkSession, least_shared(k, percent, MISS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(sketches(k, size), "doc_id long, n long, cls long, sketch array<long>")
    # one row for each distinct set
    rows = cut(rows)
    classes = cut(rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    nameless = not classes.filter("doc is null").isEmpty()
    release(spark)

    least = F.when(F.col("s") >= _holds(k, percent), F.lit(m)).otherwise(F.ceil(F.col("s") * percent / 100)).cast("int")
    values = classes.select("cls", F.least("n", F.lit(k)).cast("int").alias("s"), F.explode("sketch").alias("v"))
    seen = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    shared = values.join(seen, "v")
    own = Window.partitionBy("cls")
    lists = (
        shared.withColumn("r", F.row_number().over(own.orderBy("df", "v")))
        .withColumn("all", F.count("*").over(own))
        .filter(F.col("r") <= F.col("all") - least + 1)
        .select("v", "cls")
    )
    lists = cut(lists)
    # one of the lists with the same members, told by two sums of hashes
    alike = lists.groupBy("v").agg(F.count("*").alias("members"), *(F.sum(F.xxhash64("cls", F.lit(x)).cast("decimal(20,0)")).alias(f"sum{x}") for x in (1, 2))).filter("members > 1")
    lists = cut(lists.join(alike.groupBy("members", "sum1", "sum2").agg(F.min("v").alias("v")).select("v"), "v", "left_semi"), few=True)
    release(spark)
    pivot = lists.groupBy("v").agg(F.min("cls").alias("a"), F.count("*").alias("members")).filter("members > 1")
    stars = lists.join(pivot, "v").filter("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    held = classes.select("cls", "n", "sketch")
    with_a = stars.join(held.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    with_b = with_a.join(held.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    links = cut(verified(cut(with_b.mapInArrow(estimate(k, m, percent), "a long, b long"), few=True), classes, docs, percent, size, nameless), few=True)
    release(spark)
    roots = components(links)

    # what the stars have left: lists that still hold more than one component
    members, before = placed(lists, roots).join(classes.select("cls", "n"), "cls"), links
    for wide in (WIDE, None):
        release(spark)
        found = meetings(members.select("v", "cls", "root", "n"), classes, docs, percent, size, wide, nameless)
        links = links.unionByName(found.filter("b is not null").select("a", "b"))
        marked = found.filter("b is null").select("v", F.col("a").alias("cls")).distinct()
        if wide is None or marked.isEmpty():
            break
        # components are joined once, after both rounds
        members = placed(marked, roots).join(classes.select("cls", "n"), "cls")
    release(spark)
    if links.count() > before.count():
        roots = components(links)
    release(spark)

    named = classes.select("cls", "doc").join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    label = named.join(first, "component").select("cls", "component_id")
    out = rows.select("doc_id", "n", "cls").join(label, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def least_shared(k: int, percent: int, miss: float) -> int:
    """Most values that a pair at the threshold shares of a sketch of k, but with probability ``miss``."""
    tail, m, p = 0.0, 0, percent / 100
    while m < k and (tail := tail + math.comb(k, m) * p**m * (1 - p) ** (k - m)) < miss:
        m += 1
    return m


def _holds(k: int, percent: int) -> int:
    """Smallest set whose partners may be too large to be held whole."""
    return next(s for s in range(1, k + 1) if 100 * s > percent * k)

