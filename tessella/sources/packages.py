"""Package metadata to dated, tagged documents, and snapshots of them with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "name string, description string, `dist-tags` map<string,string>, versions map<string,struct<description:string,deprecated:string,peerDependencies:map<string,string>>>, time map<string,string>"
MANIFEST = "sourceId string, revision string, tags array<struct<path:string,apiVersion:string,productVersion:string>>"
RECENT = 12


def is_release(version: Column) -> Column:
    return version.rlike(r"\A\d+\.\d+\.\d+\z")


def track(version: Column) -> Column:
    """What a dependency names: a release itself, of a prerelease the number and its kind; null for anything else."""
    pattern = r"(?i)\A(\d+\.\d+\.\d+)-(beta|rc|internal)(?:\.|\z)"
    return F.when(is_release(version), version).when(version.rlike(pattern), F.concat(F.regexp_extract(version, pattern, 1), F.lit("-"), F.lower(F.regexp_extract(version, pattern, 2))))


def product_version(version: Column) -> Column:
    """The product's version at the end of a prerelease's, else null."""
    return F.nullif(F.regexp_extract(version, r"(?i)-(?:beta|rc|internal)\.(\d+\.\d+\.\d+(?:-[A-Za-z]+\.\d+)?)\z", 1), F.lit(""))


def tagged(packages: DataFrame) -> DataFrame:
    """One row for each asked tag that a package has, of packages (source_id, channel, tags, metadata as JSON).

    ``recent``: (published in ms, version) of the channel's last ``RECENT`` versions, newest first, releases for stable and
    the others for preview; a version without a readable time counts as the oldest.  ``known``: whether the tag's version is among
    the versions.  Rows whose metadata is null or broken have no tags.
    """
    rows = packages.select("source_id", "channel", "tags", F.from_json("metadata", METADATA).alias("m"))
    own = F.filter(F.map_keys("m.versions"), lambda v: (F.col("channel") == "stable") == is_release(v))
    published = lambda v: F.coalesce(F.unix_millis(F.try_to_timestamp(F.try_element_at("m.time", v))), F.lit(0).cast("long"))
    recent = F.slice(F.reverse(F.array_sort(F.transform(own, lambda v: F.struct(published(v).alias("at"), v.alias("version"))))), 1, RECENT)
    version = F.try_element_at("m.`dist-tags`", F.col("tag"))
    rows = rows.withColumn("recent", recent).withColumn("tag", F.explode("tags")).withColumn("version", version).filter("version IS NOT NULL")
    rows = rows.withColumn("v", F.try_element_at("m.versions", F.col("version")))
    slug = F.regexp_replace("m.name", r"\A@[^/]*/", "")
    return rows.select(
        "source_id", "channel", F.col("m.name").alias("name"), "tag", "version", track(F.col("version")).alias("track"), product_version(F.col("version")).alias("product_version"),
        F.concat(F.lit("metadata/"), slug, F.lit("/"), F.col("tag"), F.lit(".md")).alias("path"), F.coalesce("v.description", "m.description").alias("description"), F.col("v.deprecated").alias("deprecated"),
        F.array_sort(F.map_entries("v.peerDependencies")).alias("peers"), "recent", F.col("v").isNotNull().alias("known"),
    )


def rendered(tags: DataFrame) -> DataFrame:
    """(source_id, path, content, version, product_version): the Markdown of each tag; a tag that points to no version raises."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    said = lambda label, c: F.concat(F.lit(label), c)
    listed = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(items, "\n")))
    peers = F.transform("peers", lambda e: F.concat(F.lit("- "), tick(e["key"]), F.lit(": "), tick(e["value"])))
    day = lambda e: F.when(e["at"] > 0, F.concat(F.lit(" ("), F.date_format(F.timestamp_millis(e["at"]), "yyyy-MM-dd"), F.lit(")"))).otherwise("")
    recent = F.transform("recent", lambda e: F.concat(F.lit("- "), tick(e["version"]), day(e)))
    release = (F.col("channel") != "preview") & is_release(F.col("version"))
    head = [F.lit("---"), said("title: ", F.concat_ws(" ", "name", "tag", "version")), said("api_version: ", F.col("version")), said("product_version: ", F.col("product_version")), F.lit("---"), said("# ", F.concat_ws(" ", "name", "tag"))]
    facts = [F.col("description"), said("Channel: ", F.col("channel")), said("Tag: ", tick(F.col("tag"))), said("Version: ", tick(F.col("version"))), said("Track: ", tick(F.col("track"))), said("Product: ", tick(F.col("product_version"))), said("Deprecated: ", F.col("deprecated"))]
    use = F.when(release, F.concat(F.lit("\n## Dependency\n\n"), tick(F.col("name")), F.lit(" "), tick(F.col("version")))).otherwise("\n## Prerelease\n\nThe version names one build; depend on the track.")
    text = F.concat_ws("\n", *head, *facts, use, listed("Peer dependencies", peers), listed("Recent versions", recent))
    missing = F.raise_error(F.concat(F.lit("package "), F.coalesce("name", F.lit("?")), F.lit(": tag "), F.col("tag"), F.lit(" points to a missing version"))).cast("string")
    return tags.select("source_id", "path", F.when(F.col("known"), text).otherwise(missing).alias("content"), "version", "product_version")


def manifests(documents: DataFrame) -> DataFrame:
    """(source_id, manifest as JSON) of rendered documents; the revision follows from paths and texts alone."""
    entry = F.struct("path", F.col("version").alias("apiVersion"), F.col("product_version").alias("productVersion"))
    per = documents.groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias("tags"), F.array_sort(F.collect_list(F.concat_ws(" ", "path", F.sha2("content", 256)))).alias("all"))
    revision = F.concat(F.lit("sha256:"), F.sha2(F.array_join("all", "\n"), 256))
    return per.select("source_id", F.to_json(F.struct(F.col("source_id").alias("sourceId"), revision.alias("revision"), "tags")).alias("manifest"))


def opened(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Files (source_id, path, ...) that the manifests under ``path`` (one JSON a line) name, with revision, api_version and product_version.

    A manifest without a source, with a malformed revision or one of several of its source raises.
    """
    rows = spark.read.schema(MANIFEST).json(path)
    good = F.col("sourceId").isNotNull() & F.coalesce(F.col("revision").rlike(r"\Asha256:[0-9a-f]{64}\z"), F.lit(False))
    wrong = rows.filter(~good).select(F.coalesce("sourceId", F.lit("?")).alias("id")).unionByName(rows.groupBy(F.col("sourceId").alias("id")).count().filter("count > 1").select("id")).limit(10).collect()
    if wrong:
        raise ValueError("snapshot without provenance: " + ", ".join(sorted(str(r.id) for r in wrong)))
    named = rows.select(F.col("sourceId").alias("source_id"), "revision", F.explode("tags").alias("t")).select("source_id", "revision", "t.path", F.col("t.apiVersion").alias("api_version"), F.col("t.productVersion").alias("product_version"))
    return files.drop("revision", "api_version", "product_version").join(named.dropDuplicates(["source_id", "path"]), ["source_id", "path"])
