"""Heading sections of Markdown files as column expressions: no Python worker, and no text is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD = r"(?s)\A[^\S\n]*---[^\S\n]*\n.*?(?<=\n)[^\S\n]*---[^\S\n]*(?:\n|\z)"
FENCE = r"(?U)\A\s*(?:```|~~~)"
HEADING = r"(?sU)\A(#{1,6})\s+(.+?)\s*\z"
LEVELS = range(1, 7)


def sections(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, ordinal, chunk_type, title, heading_path, start_line, end_line) of files (key, content).

    One row for each heading outside code fences, and a row of type ``document`` for what stands
    before the first, unless it is blank.  Lines count from 1, a file's head included.  Only
    the lines that are headings or fences leave their file.  A fence is open where an odd number of fence lines
    stands before; a level's last heading is on the stack unless a higher level has a later one.
    ``key`` must tell files apart.  Null contents and blank files have no rows.
    """
    content = F.replace("content", F.lit("\r\n"), F.lit("\n"))
    whole = files.select(key, content.alias("content"), F.regexp_extract(content, HEAD, 0).alias("head"))
    breaks = F.length("head") - F.length(F.replace("head", F.lit("\n"), F.lit("")))
    lines = whole.select(key, (breaks + 1).alias("base"), F.split(F.expr("substring(content, length(head) + 1)"), "\n").alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    told = F.filter(numbered, lambda e: e["text"].rlike(FENCE) | e["text"].rlike(HEADING))
    start = F.array(F.struct(F.lit(-1).alias("line"), F.lit("").alias("text")))
    filled = F.array_position(F.transform("lines", lambda x: x.rlike(r"(?U)\S")), True) - 1
    rows = lines.select(key, "base", F.size("lines").alias("n"), filled.alias("filled"), F.explode(F.concat(start, told)).alias("e")).select(key, "base", "n", "filled", "e.line", "e.text")

    order = Window.partitionBy(key).orderBy("line")
    fence = F.col("text").rlike(FENCE)
    opened = F.coalesce(F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    heads = rows.withColumn("hidden", fence | opened).filter("NOT hidden").drop("hidden")
    bare = F.replace(F.replace(F.regexp_replace(F.regexp_extract("text", HEADING, 2), r"(?U)\A#+\s*", ""), F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
    heads = heads.select(key, "base", "n", "filled", "line", F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), F.regexp_replace(bare, r"(?U)\A\s+|\s+\z", "").alias("title"))

    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("level") == d, F.struct("line", "title"))).over(so_far).alias(f"last{d}") for d in LEVELS]
    heads = heads.select("*", *last, F.coalesce(F.lead("line").over(order), F.col("n")).alias("stop"))
    line = lambda d: F.coalesce(F.col(f"last{d}.line"), F.lit(-1))
    above = lambda d: F.greatest(F.lit(-1), F.lit(-1), *[line(e) for e in LEVELS if e < d])
    names = F.filter(F.array(*[F.when(line(d) > above(d), F.col(f"last{d}.title")) for d in LEVELS]), lambda t: t.isNotNull())
    first = F.col("line") < 0
    found = heads.filter(~first | ((F.col("filled") >= 0) & (F.col("filled") < F.col("stop")))).withColumn("names", names)
    return found.select(
        key, (F.row_number().over(order) - 1).alias("ordinal"), F.when(first, "document").otherwise("section").alias("chunk_type"), F.when(first, "Document").otherwise(F.col("title")).alias("title"),
        F.col("names").alias("heading_path"), (F.col("base") + F.greatest("line", F.lit(0))).cast("int").alias("start_line"), (F.col("base") + F.col("stop") - 1).cast("int").alias("end_line"),
    )
