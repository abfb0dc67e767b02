"""The greedy end of a search as column expressions: a fold over each query's ranked candidates, without a Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Less room than this is not worth a result; a result has at most so many characters.
LEAST, MOST = 200, 1600
STATE = "struct<docs: array<string>, used: int, taken: array<struct<pos: int, chunk_id: string, document_id: string, text: string>>>"


def clipped(text: Column, most: Column) -> Column:
    """At most ``most`` characters, the last one an ellipsis if something was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substr(text, F.lit(1), most - 1), r"\s+$", ""), F.lit("…")))


def chosen(ranked: DataFrame, limit: int = 10, budget: int = 9800, per_document: int = 2) -> DataFrame:
    """(query_id, place, pos, chunk_id, document_id, text) taken in rank order from (query_id, pos, chunk_id, document_id, exact, content).

    Taking ends at ``limit`` results or where less than LEAST characters of the budget are
    left.  A document gives ``per_document`` results; exact ones beyond that are taken too, and count.  A
    text is clipped to MOST characters and to what is left.  What is taken depends on what was
    taken before, so a query's candidates, of which a search has at most 150, are one array.
    """
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "document_id", "exact", "content"))).alias("all"))
    none = F.from_json(F.lit('{"docs": [], "used": 0, "taken": []}'), STATE)

    def take(state: Column, c: Column) -> Column:
        left = F.lit(budget) - state["used"]
        room = (F.size(state["taken"]) < limit) & (left >= LEAST)
        free = c["exact"] | (F.size(F.filter(state["docs"], lambda d: d == c["document_id"])) < per_document)
        text = clipped(c["content"], F.least(F.lit(MOST), left))
        one = F.struct(c["pos"].cast("int").alias("pos"), c["chunk_id"].alias("chunk_id"), c["document_id"].alias("document_id"), text.alias("text"))
        more = F.struct(F.array_append(state["docs"], c["document_id"]).alias("docs"), (state["used"] + F.length(text)).cast("int").alias("used"), F.array_append(state["taken"], one).alias("taken"))
        return F.when(room & free, more.cast(STATE)).otherwise(state)

    taken = rows.select("query_id", F.aggregate("all", none, take, lambda s: s["taken"]).alias("taken"))
    return taken.select("query_id", F.posexplode("taken").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("place"), "x.*")
