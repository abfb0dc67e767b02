"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad.  Its features are rates of character
classes, of repeated words and lines, and its length, together with those of
the line before and after; transitions tie neighbouring labels.  Marginals come
from forward-backward, in log space, over all documents of a batch at once.
The score is the mean of the lines' marginals weighted by their lengths, put
through a logistic curve fitted to the same sample.

The model is fitted on the driver from at most ``sample`` labelled documents of at
most ``most`` bytes together (those with the smallest hash of doc_id, so the choice
doesn't depend on partitioning; a text that would go beyond the bytes is left out).  Lines have no labels: at first each has its document's, then
lines of bad documents that the model finds good are taken as good and the
model is fitted again.

Rules: null texts and texts without a word score 0 and are predicted 0; labels
that are null are not learnt from, nor are those of a doc_id with different ones; of
rows with one doc_id the text with the smallest hash is learnt from; without labelled documents, or with one kind
only, every text with a word scores that share; repeated rows are scored each;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release
from .words import Words, pieces, text_parts

SAMPLE, MOST, ROUNDS, STEPS, PENALTY, KEEP = 3000, 64 << 20, 3, 80, 1e-3, 0.7

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 13, 32]] = 4
_CLASS[[44, 46, 59, 58, 39, 34, 45, 63]] = 5
_CLASS[33] = 6
_CLASS[124] = 7
_CLASS[[35, 36, 37, 38, 42, 64, 94, 95, 126, 43, 61]] = 8
_CLASS[[60, 62, 123, 125, 91, 93, 40, 41, 47, 92]] = 9
_CLASS[128:] = 10
_RATES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
#: Features of a line itself; with both neighbours' and a constant, 3 * OWN + 3 in all.
OWN = len(_RATES) + 7


class Lines:
    """Lines with at least one word of a batch of texts, and their features."""

    def __init__(self, column):
        data, offs = text_parts(column)
        words = Words(column)
        self.rows = len(offs) - 1
        n = len(data)
        breaks = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([offs[:-1], breaks + 1]))
        begin = begin[begin < n]
        end = np.minimum(offs[np.minimum(np.searchsorted(offs, begin, side="right"), self.rows)], np.append(breaks, n)[np.searchsorted(breaks, begin, side="left")])
        first = np.searchsorted(words.start, begin)
        count = np.searchsorted(words.start, end) - first
        some = count > 0
        begin, end, first, count = begin[some], end[some], first[some], count[some]
        #: bytes of each line, and lines first[r]:first[r + 1] of row r
        self.size = (end - begin).astype(np.float64)
        self.first = np.searchsorted(begin, offs)
        self.count = np.diff(self.first)
        own = np.zeros((len(begin), OWN))
        if len(begin):
            kind = _CLASS[data]
            for k, c in enumerate(_RATES):
                sums = np.append(0, np.cumsum(kind == c))
                own[:, k] = (sums[end] - sums[begin]) / self.size
            k = len(_RATES)
            owner = np.repeat(np.arange(len(begin)), count)
            at = first.repeat(count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            h = words.hash[at]
            order = np.lexsort((h, owner))
            fresh = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
            distinct = np.bincount(owner[order], weights=fresh, minlength=len(begin))
            same = np.append(False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
            own[:, k] = 1 - distinct / count
            own[:, k + 1] = np.bincount(owner, weights=same, minlength=len(begin)) / count
            own[:, k + 2] = np.log1p(self.size) / 5
            own[:, k + 3] = np.log1p(count) / 5
            own[:, k + 4] = np.minimum(self.size / count, 30) / 10
            own[:, k + 5] = np.isin(data[end - 1], np.frombuffer(b".!?:", np.uint8))
            total = np.append(np.uint64(0), np.cumsum(words.hash))
            line = total[first + count] - total[first]
            row = np.repeat(np.arange(self.rows), self.count)
            order = np.lexsort((line, row))
            again = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
            copy = np.zeros(len(begin))
            copy[order[1:][again]] = 1
            own[:, k + 6] = copy
        self.own = np.sqrt(own)

    @classmethod
    def of(cls, table: pa.Table) -> Lines:
        """Lines of all texts of a table, found in pieces of bounded memory."""
        parts = [cls(piece.column("text")) for batch in table.select(["text"]).combine_chunks().to_batches() for piece in pieces(batch)] or [cls(pa.array([], pa.string()))]
        out = parts[0]
        out.rows = sum(p.rows for p in parts)
        out.own, out.size, out.count = (np.concatenate([getattr(p, name) for p in parts]) for name in ("own", "size", "count"))
        out.first = np.append(0, np.cumsum(out.count))
        return out

    def around(self, own: np.ndarray) -> np.ndarray:
        """Scaled features, the neighbours' (0, the mean, where there is none) and whether there are neighbours."""
        n = len(own)
        head, tail = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        full = self.count > 0
        head[self.first[:-1][full]] = True
        tail[self.first[1:][full] - 1] = True
        prev, nxt = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
        prev[head], nxt[tail] = 0, 0
        return np.concatenate([own, prev, nxt, head[:, None], tail[:, None], np.ones((n, 1))], axis=1)


def forward_backward(emission: np.ndarray, first: np.ndarray, count: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions 2 x 2), for logits ``emission`` of good and log potentials ``change``."""
    n = len(emission)
    e = np.stack([np.zeros(n), emission], axis=1)
    alpha, beta = e.copy(), np.zeros((n, 2))
    order = np.argsort(-count, kind="stable")
    start, size = first[order], count[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # rows with more than t lines
    for t in range(1, longest):
        at = start[: live[t]] + t
        p = alpha[at - 1]
        p = p - p.max(axis=1, keepdims=True)
        alpha[at] += np.logaddexp(p[:, :1] + change[0], p[:, 1:] + change[1])
    for t in range(longest - 1, 0, -1):
        at = start[: live[t]] + t
        p = beta[at] + e[at]
        p = p - p.max(axis=1, keepdims=True)
        beta[at - 1] = np.logaddexp(change[:, 0] + p[:, :1], change[:, 1] + p[:, 1:])
    joint = alpha + beta
    good = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -700, 700)))
    inner = np.ones(n, dtype=bool)
    inner[first[count > 0]] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + change[None] + (e + beta)[at][:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair.sum(axis=0)


class Model:
    """Weights, transitions, scaling of the features and the curve of the document score."""

    def __init__(self, share: float = 0.5):
        self.w = np.zeros(3 * OWN + 3)
        self.change = np.zeros((2, 2))
        self.mean, self.spread = np.zeros(OWN), np.ones(OWN)
        self.curve: tuple[float, float] | None = None
        self.share = share

    def marginals(self, lines: Lines) -> np.ndarray:
        return forward_backward(lines.around((lines.own - self.mean) / self.spread) @ self.w, lines.first[:-1], lines.count, self.change)[0]

    def documents(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of the marginals; 0 for texts without a word."""
        good = self.marginals(lines) * lines.size
        sums, sizes = np.append(0, np.cumsum(good)), np.append(0, np.cumsum(lines.size))
        size = sizes[lines.first[1:]] - sizes[lines.first[:-1]]
        return np.where(size > 0, (sums[lines.first[1:]] - sums[lines.first[:-1]]) / np.maximum(size, 1), 0)

    def score(self, lines: Lines) -> np.ndarray:
        some = lines.count > 0
        if self.curve is None:
            return np.where(some, self.share, 0.0)
        a, b = self.curve
        return np.where(some, 1 / (1 + np.exp(-np.clip(a * self.documents(lines) + b, -50, 50))), 0.0)


def fit(lines: Lines, quality: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """CRF by penalised likelihood (Adam, full batch), lines relabelled between rounds, then the curve."""
    some = lines.count > 0
    share = float(quality[some].mean()) if some.any() else 0.0
    model = Model(share)
    if not 0 < share < 1:
        return model
    model.mean, model.spread = lines.own.mean(axis=0), lines.own.std(axis=0) + 1e-6
    x = lines.around((lines.own - model.mean) / model.spread)
    row = np.repeat(np.arange(lines.rows), lines.count)
    label = quality[row].astype(np.float64)
    inner = np.ones(len(row), dtype=bool)
    inner[lines.first[:-1][some]] = False
    at = np.flatnonzero(inner)
    for turn in range(rounds):
        theta = np.concatenate([model.w, model.change.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), 1)
        for step in range(1, steps + 1):
            w, change = theta[: len(model.w)], theta[len(model.w) :].reshape(2, 2)
            good, pairs = forward_backward(x @ w, lines.first[:-1], lines.count, change)
            grad = np.concatenate([x.T @ (good - label) / len(row), ((pairs - seen) / len(row)).ravel()]) + penalty * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.w, model.change = theta[: len(model.w)], theta[len(model.w) :].reshape(2, 2)
        if turn + 1 < rounds:
            good = model.marginals(lines)
            label = np.where(quality[row] == 1, 1.0, (good > 0.5).astype(np.float64))
    z, y = model.documents(lines)[some], quality[some]
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of a two-parameter logistic fit, slightly penalised
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        r, s = p - y, p * (1 - p)
        g = np.array([(r * z).sum() + 1e-2 * a, r.sum() + 1e-2 * b])
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -5, 5)), b - float(np.clip(d[1], -5, 5))
    model.curve = (a, b)
    return model


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST, learn_from: Column | None = None) -> DataFrame:
    """(doc_id, text, quality) of the documents to learn from: one row for each doc_id, ``sample`` at most, of ``most`` bytes together."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_of")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("quality").cast("int")).alias("other"))
    rows = docs.filter(~held_out(F.col("doc_id")) if learn_from is None else learn_from).select("doc_id", "text")
    ids = rows.select("doc_id").distinct().join(known.filter("quality = other"), F.col("doc_id") == F.col("_of")).select(F.col("doc_id").alias("_id"), "quality")
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # the sample is bounded, so it may be broadcast to the scans of the texts
    texts = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("x"), F.first("quality").alias("quality"))
    chosen, total = [], 0
    for r in texts.select("doc_id", "quality", "x.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r["size"] <= most:
            total += r["size"]
            chosen.append((r["doc_id"], r["text"], r["quality"]))
    pick = docs.sparkSession.createDataFrame(chosen, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _text long, quality int")
    got = rows.join(F.broadcast(pick), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_text")))
    return got.select("doc_id", "text", "quality").dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST, learn_from: Column | None = None) -> Model:
    """A model from the labelled rows among ``docs``, those of the held-out fold left out."""
    got = sampled(docs, labels, sample, most, learn_from).toArrow().sort_by("doc_id")
    model = fit(Lines.of(got), got.column("quality").to_numpy().astype(np.int64))
    del got
    release(docs.sparkSession)
    return model


def scored(model: Model, keep: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                score = model.score(Lines(batch.column("text")))
                columns = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "text"]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= keep).astype(np.int32))], names=[*names, "score", "predicted"])

    return of


def score_documents(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(scored(model, keep), "doc_id long, held_out boolean, score double, predicted int")


def filter_documents(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their columns."""
    names = docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                yield batch.filter(pa.array(model.score(Lines(batch.column("text"))) >= keep)).select(names)

    return docs.mapInArrow(of, docs.schema)
