"""Retrieval quality: suites of cases, relevance of results, metrics, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.text import gain

# Default targets, and the fields that relevance may constrain.
TARGETS = {"exactTop1": 0.95, "naturalTop3": 0.9, "usefulTop5": 0.95}
FIELDS = ("identifier", "source", "category", "channel", "module", "pathContains")
SUITE = (
    "name string, targets struct<exactTop1: double, naturalTop3: double, usefulTop5: double>, queries array<struct<id: string, kind: string, query: string, requiredTopK: int, "
    "relevant: array<struct<identifier: string, source: string, category: string, channel: string, module: string, pathContains: string, grade: int>>, includePreview: boolean, "
    "includeHistorical: boolean, source: string, channel: string, module: string, pathPrefix: string, categories: array<string>, apiVersion: string, minecraftVersion: string>>"
)


def load_suite(spark: SparkSession, path: str) -> tuple[str, dict[str, float], DataFrame, DataFrame]:
    """(name, targets, cases, relevant) of a suite file; values out of bounds raise.

    cases: case_id, kind, query, required and options; relevant: case_id, entry and its fields.
    """
    suite = spark.read.schema(SUITE).option("multiLine", "true").json(path)
    head = suite.select("name", "targets").first()
    cases = suite.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("case_id"), "q.kind", "q.query", F.col("q.requiredTopK").alias("required"), "q.relevant", *[f"q.{c}" for c in ("includePreview", "includeHistorical", "source", "channel", "module", "pathPrefix", "categories", "apiVersion", "minecraftVersion")])
    some = lambda x: F.coalesce(*[x[f] for f in FIELDS]).isNotNull() & F.coalesce(x["grade"], F.lit(3)).between(1, 3)
    good = (
        F.col("case_id").rlike("^[a-z0-9][a-z0-9_-]*$") & F.col("kind").isin("exact", "natural") & F.length(X.js_trim(F.col("query"))).between(1, 500)
        & F.coalesce(F.col("required"), F.lit(1)).between(1, 10) & F.size("relevant").between(1, 20) & F.forall("relevant", some)
    )
    bad = [r.case_id for r in cases.filter(~F.coalesce(good, F.lit(False))).select("case_id").limit(5).collect()]
    twice = [r.case_id for r in cases.groupBy("case_id").count().filter("count > 1").limit(5).collect()]
    if head is None or bad or twice or not cases.limit(1).count():
        raise ValueError(f"suite: bad cases {bad}, repeated {twice}")
    targets = {k: getattr(head.targets, k) if head.targets is not None and getattr(head.targets, k) is not None else v for k, v in TARGETS.items()}
    entries = cases.select("case_id", F.posexplode("relevant").alias("entry", "x")).select("case_id", "entry", *[f"x.{f}" for f in FIELDS], F.coalesce("x.grade", F.lit(3)).alias("grade"))
    return head["name"], targets, cases.drop("relevant"), entries


def matches(entry: dict[str, Column], result: dict[str, Column]) -> Column:
    """Whether a result (identifier, source_id, category, channel, api_package, path) fits all fields that an entry sets."""
    unset = lambda c: c.isNull() | (c == "")
    rules = (
        X.normalize_identifier(entry["identifier"]) == X.normalize_identifier(result["identifier"]), entry["source"] == result["source_id"], entry["category"] == result["category"],
        entry["channel"] == result["channel"], F.lower(entry["module"]) == F.lower(result["api_package"]), F.contains(F.lower(result["path"]), F.lower(entry["pathContains"])),
    )
    out = F.lit(True)
    for field, rule in zip(FIELDS, rules, strict=True):
        out &= unset(entry[field]) | F.coalesce(rule, F.lit(False))
    return out


def judged(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(case_id, pos, item, grade) of every result (case_id, pos and the fields of ``matches``) with every entry that it fits; entries with equal fields are one item."""
    key = F.to_json(F.struct(*[F.coalesce(X.normalize_identifier(F.col(f)) if f == "identifier" else F.lower(F.col(f)) if f in ("module", "pathContains") else F.col(f), F.lit("")).alias(f) for f in FIELDS]))
    entries = relevant.select("case_id", "grade", key.alias("item"), *[F.col(f).alias(f"e_{f}") for f in FIELDS])
    both = results.join(entries, "case_id")
    return both.filter(matches({f: F.col(f"e_{f}") for f in FIELDS}, {c: F.col(c) for c in results.columns})).select("case_id", "pos", "item", "grade")


def evaluate(cases: DataFrame, found: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row per case (case_id, kind, required): ranks, recall at 3 and 5, NDCG at 5 and the gate.

    found: (case_id, pos, item, grade) as ``judged`` gives it; relevant: (case_id, grade), one row
    per entry.  A result credits all its entries at once with the best grade; an entry
    counts at its first rank only; a case without a required rank passes its gate.
    """
    ideal_rank = Window.partitionBy("case_id").orderBy(F.desc("grade"))
    ranked = relevant.select("case_id", "grade").withColumn("r", F.row_number().over(ideal_rank))
    about = ranked.groupBy("case_id").agg(F.count("*").alias("entries"), F.sum(F.when(F.col("r") <= 5, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("ideal"))
    first = found.groupBy("case_id", "item").agg(F.min("pos").alias("pos"), F.max("grade").alias("grade"))
    places = first.groupBy("case_id", "pos").agg(F.max("grade").alias("grade"), F.count("*").alias("n"))
    got = places.groupBy("case_id").agg(
        F.min("pos").alias("first_rank"),
        F.sum(F.when(F.col("pos") <= 3, F.col("n")).otherwise(0)).alias("at3"),
        F.sum(F.when(F.col("pos") <= 5, F.col("n")).otherwise(0)).alias("at5"),
        F.sum(F.when(F.col("pos") <= 5, gain(F.col("grade"), F.col("pos"))).otherwise(0.0)).alias("dcg"),
    )
    rows = cases.join(about, "case_id").join(got, "case_id", "left")
    r4 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return rows.select(
        "case_id",
        "kind",
        "required",
        "first_rank",
        r4(1 / F.col("first_rank")).alias("reciprocal_rank"),
        r4(F.col("at3") / F.col("entries")).alias("recall_at_3"),
        r4(F.col("at5") / F.col("entries")).alias("recall_at_5"),
        r4(F.col("dcg") / F.col("ideal")).alias("ndcg_at_5"),
        (F.col("required").isNull() | F.coalesce(F.col("first_rank") <= F.col("required"), F.lit(False))).alias("required_passed"),
    )


def summary(cases: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """One row: means over all cases, Top-1 over the exact and Top-3 over the natural ones (1 where there are none), Top-5 over all, the gate of required ranks."""

    def share(k: int, kind: str | None) -> Column:
        hit = F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")
        return F.round(F.coalesce(F.avg(F.when(F.col("kind") == kind, hit) if kind else hit), F.lit(1.0 if kind else 0.0)), 4)

    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c if c != "reciprocal_rank" else "mrr")
    row = cases.agg(
        F.count("*").alias("queries"), *[mean(c) for c in ("reciprocal_rank", "recall_at_3", "recall_at_5", "ndcg_at_5")], share(1, "exact").alias("exact_top1"), share(3, "natural").alias("natural_top3"), share(5, None).alias("useful_top5"),
        F.count("required").alias("required_cases"), F.count(F.when(F.col("required").isNotNull() & F.col("required_passed"), 1)).alias("required_passed"),
    )
    gate = F.col("required_passed") == F.col("required_cases")
    met = (F.col("exact_top1") >= targets["exactTop1"]) & (F.col("natural_top3") >= targets["naturalTop3"]) & (F.col("useful_top5") >= targets["usefulTop5"])
    return row.withColumn("gate_passed", gate).withColumn("passed_targets", met & gate)


def report(name: str, row, cases: list, targets: dict[str, float] = TARGETS) -> str:
    """A summary as text, with the cases that need attention: gate missed, nothing relevant, or first rank beyond 3.

    row: the row of ``summary``; cases: rows of ``evaluate``, with ``top`` (labels of the first results) if at hand.
    """
    verdict = lambda ok: "PASS" if ok else "FAIL"
    lines = [f"Benchmark: {name} ({row['queries']} queries)"]
    lines += [f"{label}: {row[key]:.4f}" for label, key in (("MRR", "mrr"), ("Recall@3", "recall_at_3"), ("Recall@5", "recall_at_5"), ("NDCG@5", "ndcg_at_5"))]
    lines += [f"{label}: {row[key]:.4f} (target {targets[t]:.2f})" for label, key, t in (("Exact Top-1", "exact_top1", "exactTop1"), ("Natural Top-3", "natural_top3", "naturalTop3"), ("Useful Top-5", "useful_top5", "usefulTop5"))]
    lines += [f"Required cases: {row['required_passed']}/{row['required_cases']} ({verdict(row['gate_passed'])})", f"Quality gate: {verdict(row['passed_targets'])}"]
    for c in cases:
        first = c["first_rank"]
        if c["required_passed"] and first is not None and first <= 3:
            continue
        gate = f"; required<={c['required']} {verdict(c['required_passed'])}" if c["required"] is not None else ""
        top = c["top"] if "top" in c else None
        lines.append(f"  {c['case_id']}: first relevant {first or 'none'}{gate}; top={' | '.join(top or []) or '(no results)'}")
    return "\n".join(lines) + "\n"
