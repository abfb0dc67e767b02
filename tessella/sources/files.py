"""Scans of file trees and checkouts, registries, package documents."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import rules as Y

# What is read, and what is passed over.
EXTENSIONS = "md mdx json js mjs cjs ts tsx txt mcfunction lang material".split()
IGNORED = ".git node_modules dist".split()
MAX_BYTES = 2_000_000


def scan(spark: SparkSession, root: str, most: int = MAX_BYTES, extensions: list[str] = EXTENSIONS, keep: Column | None = None) -> DataFrame:
    """(path relative to root, length, modified, content) of readable files under ``root``.

    The suffix and ignored-folder tests and the size cap are filters on the
    listing, so the contents of other files are never read.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(base)
    plain = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    clean = re.sub(r"^[a-z]+:/*(?=/)", "", base)
    relative = F.substring(plain, len(clean) + 2, 100_000)
    rows = files.filter(F.col("length") <= most).filter(F.startswith(plain, F.lit(clean + "/"))).select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))
    rows = rows.filter(~F.exists(F.split("path", "/"), lambda s: s.isin(*IGNORED)))
    return rows if keep is None else rows.filter(keep)


def with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files with what is known of their paths."""
    return files.join(metadata, "path", "left")


def scan_checkout(spark: SparkSession, root: str, include: list[str], exclude: list[str], repository: str, branch: str) -> DataFrame:
    """Files of a checkout that the patterns select, with canonical and revision URLs."""
    head = git_head(root)
    rows = scan(spark, root, keep=Y.path_selected(F.col("path"), include, exclude))
    return rows.withColumn("canonical_url", Y.blob_url(F.lit(repository), F.lit(branch), F.col("path"))).withColumn("revision_url", Y.blob_url(F.lit(repository), F.lit(head.get("revision") or branch), F.col("path")))


def git_head(root: str) -> dict[str, str]:
    """head_ref, revision and origin of a checkout, read from its files; what is missing is left out."""

    def read(*parts: str) -> str:
        try:
            with open(os.path.join(*parts), encoding="utf-8") as f:
                return f.read().strip()
        except OSError:
            return ""

    git = os.path.join(root, ".git")
    if os.path.isfile(git) and (m := re.match(r"gitdir:\s*(.+)", read(git))):
        git = os.path.normpath(os.path.join(root, m[1].strip()))
    common = os.path.normpath(os.path.join(git, read(git, "commondir") or "."))
    out = {}
    origin = re.search(r'\[remote "origin"\](?:\n(?!\[).*)*?\n\s*url\s*=\s*(\S.*)', "\n" + read(common, "config"))
    if origin:
        out["origin"] = origin[1].strip()
    head = read(git, "HEAD")
    ref = re.match(r"ref:\s*(\S+)", head)
    if ref:
        out["head_ref"] = ref[1]
        packed = re.search(rf"^([0-9a-f]{{40,64}}) {re.escape(ref[1])}$", read(common, "packed-refs"), re.M | re.I)
        head = next((r for r in (read(git, ref[1]), read(common, ref[1])) if r), packed[1] if packed else "")
    if re.fullmatch(r"[0-9a-fA-F]{40}(?:[0-9a-fA-F]{24})?", head):
        out["revision"] = head.lower()
    return out


REGISTRY = "sources array<struct<id: string, name: string, type: string, tier: int, repository: string, branch: string, channel: string, include: array<string>, exclude: array<string>, sparsePaths: array<string>, defaultEnabled: boolean>>"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of a registry file; repeated ids and bad values raise."""
    rows = spark.read.schema(REGISTRY).option("multiLine", "true").json(path).select(F.explode("sources").alias("s")).select("s.*")
    wrong = bad_entries(rows).limit(10).collect()
    if wrong:
        raise ValueError("registry: " + ", ".join(f"{r.id} is {r.reason}" for r in wrong))
    return rows


def bad_entries(rows: DataFrame) -> DataFrame:
    """(id, reason) of registry rows with a value out of bounds, and of ids that stand more than once."""
    good = F.col("tier").between(1, 4) & F.col("channel").isin("stable", "preview") & Y.safe_branch(F.col("branch"))
    bad = rows.filter(~F.coalesce(good, F.lit(False))).select("id", F.lit("bad").alias("reason"))
    return bad.unionByName(rows.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated").alias("reason")))


def select_registry(rows: DataFrame, include_preview: bool) -> DataFrame:
    return rows.filter(F.when(F.col("channel") == "preview", F.lit(include_preview)).otherwise(F.col("defaultEnabled")))


def render_package(packages: DataFrame) -> DataFrame:
    """(name, document): Markdown of a package row (name, tag, version, description, peers map, recent array)."""
    peers = F.array_join(F.transform(F.array_sort(F.map_entries("peers")), lambda e: F.concat(F.lit("- `"), e["key"], F.lit("`: `"), e["value"], F.lit("`"))), "\n")
    recent = F.array_join(F.transform("recent", lambda v: F.concat(F.lit("- `"), v, F.lit("`"))), "\n")
    text = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), F.col("name"), F.lit(" "), F.col("tag")), F.concat(F.lit("api_version: "), F.col("version")), F.lit("---"), F.concat(F.lit("# "), F.col("name")),
        F.coalesce("description", F.lit("")), F.lit("## Peer dependencies"), F.when(F.size(F.map_keys("peers")) > 0, peers).otherwise("None."), F.lit("## Recent versions"), recent,
    )
    return packages.select("name", text.alias("document"))


def snapshot_revision(tags: DataFrame) -> DataFrame:
    """One row: the hash of all (name, tag, version) rows in order, by way of one hash for each name."""
    own = tags.groupBy("name").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("tag", "version")))), 256).alias("h"))
    wide = own.groupBy(F.substring(F.sha2("name", 256), 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat(x["name"], F.lit(" "), x["h"])), "\n"), 256).alias("h"))
    return wide.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: F.concat(x["bucket"], F.lit(" "), x["h"])), "\n"), 256).alias("revision"))


def synced(packages: DataFrame, known: DataFrame) -> DataFrame:
    """(name, status) of package documents (name, document) against those of the last snapshot: created, updated, unchanged."""
    have = known.select("name", F.sha2("document", 256).alias("was"))
    now = packages.select("name", F.sha2("document", 256).alias("is")).join(have, "name", "left")
    return now.select("name", F.when(F.col("was").isNull(), "created").when(F.col("was") == F.col("is"), "unchanged").otherwise("updated").alias("status"))
