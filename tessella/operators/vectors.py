"""Vector retrieval: exact cosine neighbours of a batch of queries, reuse of embeddings, a deterministic embedder."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one broadcast may hold; larger batches go block by block.
QUERY_BLOCK = 4096
#: So many distances a task holds at once.
CELLS = 1_000_000


def knn_cosine(vectors: DataFrame, queries: DataFrame, k: int = 40) -> DataFrame:
    """(query_id, vec_id, distance, pos): the k nearest of each query; ties by vec_id.

    Queries go to the tasks in blocks of bounded size; a task keeps the k best of all its
    rows, so what is shuffled is k rows per query and task.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be 1 to 100")
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b).toArrow()
        ids = block.column("query_id").to_numpy()
        q = np.array(block.column("embedding").to_pylist(), dtype=np.float64).reshape(len(ids), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def of(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            far, near = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                v = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                own = batch.column("vec_id").to_numpy()
                width, step = min(k, far.shape[1] + len(own)), max(1, CELLS // (k + len(own)))
                last, far, near = (far, near), np.empty((len(ids), width)), np.empty((len(ids), width), dtype=np.int64)
                for a in range(0, len(ids), step):
                    b = min(a + step, len(ids))
                    every = np.concatenate([last[0][a:b], np.round(1 - q[a:b] @ v.T, 9)], axis=1)
                    names = np.concatenate([last[1][a:b], np.broadcast_to(own, (b - a, len(own)))], axis=1)
                    best = np.lexsort((names, every), axis=1)[:, :k]
                    far[a:b], near[a:b] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, near.shape[1])), pa.array(near.ravel()), pa.array(far.ravel())], names=["query_id", "vec_id", "distance"])

        some = vectors.filter("embedding is not null").select("vec_id", "embedding").mapInArrow(of, "query_id long, vec_id long, distance double")
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def embedding_text(title: Column, identifier: Column, path: Column, content: Column, most: int = 6000) -> Column:
    return F.substring(F.array_join(F.filter(F.array(title, identifier, path, content), lambda x: x.isNotNull() & (x != "")), "\n"), 1, most)


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed word hashes, unit length: a stand-in where no model is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], column: str = "text", batch: int = 32) -> DataFrame:
    """``texts`` with an embedding column; the embedder sees batches of 32."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = [v for a in range(0, len(part), batch) for v in embedder(part.iloc[a : a + batch].tolist()).astype(np.float32)]
            yield pd.Series([r.tolist() for r in rows])

    return texts.withColumn("embedding", run(F.col(column)))


def reuse(new: DataFrame, previous: DataFrame) -> DataFrame:
    """``new`` (chunk_id, content_hash) with the vector of an unchanged chunk; null where it must be embedded."""
    return new.join(previous.select("chunk_id", "content_hash", "embedding"), ["chunk_id", "content_hash"], "left")


def rrf(lexical: DataFrame, semantic: DataFrame, lexical_weight: Column, semantic_weight: Column, constant: int = 60) -> DataFrame:
    """(query_id, item, score): reciprocal-rank fusion of two rankings (query_id, item, pos)."""
    both = lexical.select("query_id", "item", F.col("pos").alias("a")).join(semantic.select("query_id", "item", F.col("pos").alias("b")), ["query_id", "item"], "full_outer")
    points = F.coalesce(lexical_weight / (constant + F.col("a")), F.lit(0.0)) + F.coalesce(semantic_weight / (constant + F.col("b")), F.lit(0.0))
    return both.select("query_id", "item", points.alias("score"))


#: Version of the layout of stored vectors.
SEMANTIC_SCHEMA = 1


def meta(vectors: DataFrame, model: str, fingerprint: str) -> DataFrame:
    """(key, value) rows that say what a table of vectors was made with, and how many there are."""
    row = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions"), F.count("*").alias("vectors"))
    values = {"schema_version": F.lit(str(SEMANTIC_SCHEMA)), "model": F.lit(model), "dimensions": F.col("dimensions").cast("string"), "core_fingerprint": F.lit(fingerprint), "vectors": F.col("vectors").cast("string")}
    return row.select(F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("key", "value"))


def require(meta_rows: DataFrame, model: str, dimensions: int, fingerprint: str) -> None:
    """Raise unless stored vectors have the layout, model, size and corpus that are expected."""
    have = {r["key"]: r["value"] for r in meta_rows.collect()}
    wanted = (("SEMANTIC_SCHEMA_MISMATCH", "schema_version", str(SEMANTIC_SCHEMA)), ("SEMANTIC_MODEL_MISMATCH", "model", model), ("SEMANTIC_DIMENSION_MISMATCH", "dimensions", str(dimensions)), ("SEMANTIC_INDEX_STALE", "core_fingerprint", fingerprint))
    for code, key, value in wanted:
        if have.get(key) != value:
            raise ValueError(f"{code}: {key} is {have.get(key, 'missing')}, expected {value}")
