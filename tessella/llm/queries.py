"""Queries of the subpackage: opN_<name>(spark, sf_dir) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, first_fit, html_text, near_dedup, ngram, packing, phrases, quality, substring, suffixes, topk
from .shared import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


CHAT_PROBE = "<|im_end|><|im_start|>assistant ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CHAT_PROBE), (-1, 1, "assistant", CHAT_PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(given.unionByName(probe)))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_repeated", "n_passages")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_documents(table(spark, sf_dir, "documents"))


def token_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), *token_paths())


def op12_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_fit.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_html": op4_html,
    "op5_chat": op5_chat,
    "op6_suffixes": op6_suffixes,
    "op7_substring": op7_substring,
    "op8_packing": op8_packing,
    "op9_topk": op9_topk,
    "op10_ngram": op10_ngram,
    "op11_align": op11_align,
    "op12_first_fit": op12_first_fit,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op5_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
    "op6_suffixes": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, k, array_to_string(w[k:k + 49], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
r AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, k + j AS pos FROM s JOIN r USING (win), range(0, 50) AS t(j)),
g AS (SELECT rid, count(*) AS n, count(*) FILTER (step IS NULL OR step > 1) AS p
  FROM (SELECT rid, pos - lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS step FROM c) GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(p, 0)::BIGINT AS n_passages FROM d LEFT JOIN g USING (rid)""",
    "op7_substring": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, k, array_to_string(w[k:k + 34], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS k FROM d)),
r AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, k + j AS pos FROM s JOIN r USING (win), range(0, 35) AS t(j)),
g AS (SELECT rid, list(pos) AS gone FROM c GROUP BY rid),
e AS (SELECT d.rid, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT e.rid, string_agg(w[pos], ' ' ORDER BY pos) AS kept FROM e ANTI JOIN c ON e.rid = c.rid AND e.pos = c.pos GROUP BY e.rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN k USING (rid)""",
    "op9_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS ask, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q JOIN v d ON q.vec_id <> d.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, ask ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op13_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, k, ws HAVING count(*) >= 100),
c AS (SELECT f.lang, f.k, f.phrase, f.a, l.a AS l, r.a AS r, n.n, (1000 * f.a::HUGEINT * n.n) // (l.a::HUGEINT * r.a) AS score, j
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) f JOIN n USING (lang)
  JOIN f l ON l.lang = f.lang AND l.k = f.j AND l.ws = f.ws[1:f.j] JOIN f r ON r.lang = f.lang AND r.k = f.k - f.j AND r.ws = f.ws[f.j + 1:]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
x AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN b q ON q.lang = b.lang AND q.k > b.k AND 100 * q.a >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN x USING (lang, phrase)) WHERE rank <= 2000""",
}
