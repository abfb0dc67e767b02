"""Bounded graph operators over an edge table (from_identifier, relation, to_identifier)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X

from .keep import kept
from .lexical import sent

MAX_CHAIN, MAX_ALIASES = 4, 200_000


def canonical_names(requests: DataFrame, identifiers: DataFrame, chunks: DataFrame, most: int = 16) -> DataFrame:
    """(query_id, name): the names under which what is asked for (query_id, identifier) is known, or else the request itself."""
    asked = requests.select("query_id", F.trim("identifier").alias("requested"), X.normalize_identifier(F.col("identifier")).alias("normalized"))
    known = identifiers.join(asked.select("normalized").distinct(), "normalized", "left_semi").join(chunks.select("chunk_id", F.col("identifier").alias("own")), "chunk_id")
    known = known.select("normalized", F.coalesce("own", "identifier").alias("name"), "is_primary").distinct()
    first = known.withColumn("r", F.row_number().over(Window.partitionBy("normalized").orderBy(F.desc("is_primary"), "name"))).filter(F.col("r") <= most)
    return asked.join(first.select("normalized", "name"), "normalized", "left").select("query_id", F.coalesce("name", "requested").alias("name")).distinct()


def traverse(edges: DataFrame, starts: DataFrame, depth: int = 1, limit: int = 40, relation: str | None = None) -> DataFrame:
    """Edges met within ``depth`` steps of each (query_id, node), either way, in the order of steps, relation and ends; ``limit`` of each query.

    Each step is two equi-joins (one for each end) instead of an OR, against the nodes
    not seen before.  An edge counts once, at its smallest depth.  A query that has
    reached its limit goes no further, so that a step never holds more than one edge
    beyond the limit of a query, whatever the degree of its nodes; ``truncated`` tells.
    """
    if not 1 <= depth <= 3 or not 1 <= limit <= 100:
        raise ValueError("depth must be 1 to 3 and limit 1 to 100")
    if len(relation or "") > 80:
        raise ValueError("relation may have at most 80 characters")
    edges = edges.filter(F.col("relation") == relation) if relation else edges
    keyed = edges.withColumn("f", X.normalize_identifier(F.col("from_identifier"))).withColumn("t", X.normalize_identifier(F.col("to_identifier")))
    key, ends = ["query_id", "f", "relation", "t"], ["from_identifier", "to_identifier"]
    frontier = starts.select("query_id", X.normalize_identifier(F.col("node")).alias("node")).distinct()
    visited, found = frontier, None
    for step in range(1, depth + 1):
        out = keyed.join(frontier.withColumnRenamed("node", "f"), "f").withColumn("d", F.lit(0))
        back = keyed.join(frontier.withColumnRenamed("node", "t"), "t").withColumn("d", F.lit(1))
        # names that differ in spelling only are one edge; it leaves the frontier if its begin is in it
        met = out.unionByName(back).groupBy(*key).agg(F.min(F.struct(*ends)).alias("e"), F.min("d").alias("d"))
        have = found.groupBy("query_id").agg(F.count("*").alias("have")) if found is not None else None
        if found is not None:
            met = met.join(found.select(*key), key, "left_anti").join(have, "query_id", "left")
        met = met.select(*key, "e.*", "d", (F.coalesce("have", F.lit(0)) if found is not None else F.lit(0)).alias("have"))
        order = Window.partitionBy("query_id").orderBy("relation", *ends)
        met = met.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit + 1).withColumn("pos", F.col("have") + F.col("r")).filter(F.col("pos") <= limit + 1)
        now = met.select(*key, *ends, F.lit(step).alias("depth"), "d", "pos")
        now = kept(now) if step < depth else now  # at most one row beyond the limit of each query; the next step reads it four times
        full = now.filter(F.col("pos") > limit).select("query_id").distinct()
        nodes = now.select("query_id", F.explode(F.array("f", "t")).alias("node")).distinct()
        found = now if found is None else found.unionByName(now)
        frontier = nodes.join(visited, ["query_id", "node"], "left_anti").join(full, "query_id", "left_anti")
        visited = visited.unionByName(frontier)
    cut = F.max(F.col("pos") > limit).over(Window.partitionBy("query_id"))
    rows = found.withColumn("truncated", cut).filter(F.col("pos") <= limit)
    return rows.select("query_id", "depth", F.when(F.col("d") == 0, "outgoing").otherwise("incoming").alias("direction"), "from_identifier", "relation", "to_identifier", "pos", "truncated")


def relationships(requests: DataFrame, edges: DataFrame, identifiers: DataFrame, chunks: DataFrame, documents: DataFrame, sources: DataFrame, depth: int = 1, limit: int = 40, relation: str | None = None) -> DataFrame:
    """``traverse`` from the canonical names of (query_id, identifier), with where each edge was read (edges may have a chunk_id)."""
    starts = canonical_names(requests, identifiers, chunks).withColumnRenamed("name", "node")
    met = traverse(edges.select("from_identifier", "relation", "to_identifier"), starts, depth, limit, relation)
    if "chunk_id" not in edges.columns:
        return met
    key = ["from_identifier", "relation", "to_identifier"]
    where = edges.join(met.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.min("chunk_id").alias("chunk_id"))
    about = chunks.select("chunk_id", "document_id").join(documents.select("document_id", "source_id", "path", "channel", "api_package", "api_version"), "document_id").join(sources.select("source_id", F.col("name").alias("source_name"), "tier"), "source_id")
    return met.join(where.join(about, "chunk_id", "left"), key, "left")


def property_types(members: DataFrame, mentions: DataFrame) -> DataFrame:
    """(property, normalized, target, target_normalized, chunk_id): the type that each property leads to, if that owns members.

    members: primary identifiers (chunk_id, identifier, normalized, identifier_kind, owner, suffix,
    content); mentions: the others (chunk_id, identifier).  The type in the signature
    counts first, else the only simple name that the chunk mentions and that owns members.
    """
    owners = members.select(X.normalize_identifier(F.col("owner")).alias("target_normalized")).distinct()
    last = members.groupBy("normalized").agg(F.max_by(F.struct("chunk_id", "identifier", "identifier_kind", "owner", "content"), "chunk_id").alias("m")).select("normalized", "m.*")
    properties = last.filter("identifier_kind = 'property'").withColumn("signature", X.signature_type(F.col("content"), X.identifier_leaf(F.col("identifier"))))
    direct = properties.withColumn("target_normalized", X.normalize_identifier(F.col("signature"))).join(owners, "target_normalized")
    direct = direct.select("normalized", F.col("signature").alias("target"))
    rest = sent(properties.join(direct.select("normalized"), "normalized", "left_anti").select("normalized", "chunk_id", X.normalize_identifier(F.col("owner")).alias("own")))
    targets = direct
    if not rest.isEmpty():  # mentions are read only for properties whose signature names no type
        targets = direct.unionByName(_mentioned(rest, mentions, owners))
    found = targets.join(last.select("normalized", F.col("identifier").alias("property"), "chunk_id"), "normalized")
    return found.withColumn("target_normalized", X.normalize_identifier(F.col("target")))


def _mentioned(rest: DataFrame, mentions: DataFrame, owners: DataFrame) -> DataFrame:
    """(normalized, target): the only simple name in the chunk of each of ``rest`` (normalized, chunk_id, own) that owns members."""
    simple = mentions.filter(F.col("identifier").rlike(r"^[A-Z_$][A-Za-z0-9_$]*$")).select("chunk_id", "identifier", X.normalize_identifier(F.col("identifier")).alias("target_normalized"))
    meant = rest.join(simple, "chunk_id").filter("target_normalized <> own").join(owners, "target_normalized")
    return meant.groupBy("normalized").agg(F.collect_set("identifier").alias("all")).filter(F.size("all") == 1).select("normalized", F.col("all")[0].alias("target"))


def alias_chains(properties: DataFrame, members: DataFrame, most: int = MAX_CHAIN) -> DataFrame:
    """(alias, member, depth): property prefixes followed through their types to members, at most ``most`` steps.

    properties: (prefix, target); members: (owner, suffix, member, target), target
    the owner that a property member leads to, or null; other columns of members are handed
    on.  A chain is a bounded series of equi-joins on the owner; each step keeps distinct
    (prefix, target).
    """
    out = chain_steps(properties, members, most)
    return out.groupBy(*[c for c in out.columns if c != "depth"]).agg(F.min("depth").alias("depth"))


def chain_steps(properties: DataFrame, members: DataFrame, most: int = MAX_CHAIN) -> DataFrame:
    """The rows of ``alias_chains``, each with the depth of every step that gives it."""
    more = [c for c in members.columns if c not in ("owner", "suffix", "member", "target")]
    level, out = properties.select("prefix", "target").distinct(), None
    for step in range(1, most + 1):
        m = members.select(F.col("owner").alias("target"), "suffix", "member", F.col("target").alias("next"), *more)
        made = level.join(m, "target").select(F.concat("prefix", F.lit("."), "suffix").alias("alias"), "member", "next", *more).filter("lower(alias) <> lower(member)")
        rows = made.select("alias", "member", *more, F.lit(step).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        if step < most:  # kept, or each step would make all those before it again
            level = kept(made.filter("next is not null").select(F.col("alias").alias("prefix"), F.col("next").alias("target")).distinct())
    return out


def _own_types(identifiers: DataFrame, chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, types): the primary names of API documents that have an owner, kept as they are read by all that follows, and ``property_types`` of them.

    Names with an owner are found before any text is read.  Types look for mentions in the chunks of members only,
    so the mentions need no join of their own with chunks and documents.
    """
    named = identifiers.filter("is_primary = 1").withColumn("owner", X.member_owner(F.col("identifier"))).withColumn("suffix", X.member_leaf(F.col("identifier"))).filter("owner is not null")
    named = sent(named.select("chunk_id", "identifier", "normalized", "identifier_kind", "owner", "suffix"))
    own = kept(named.join(chunks.select("chunk_id", "document_id", "content"), "chunk_id").join(documents.filter("kind = 'api'").select("document_id"), "document_id").drop("document_id"))
    return own, property_types(own, identifiers.filter("is_primary = 0").select("chunk_id", "identifier"))


def _type_edges(types: DataFrame) -> DataFrame:
    return types.select(F.col("property").alias("from_identifier"), F.lit("property_type").alias("relation"), F.col("target").alias("to_identifier"), "chunk_id")


def type_edges(identifiers: DataFrame, edges: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The edges property_type of ``derive_aliases`` alone, for which no chain is followed."""
    return _type_edges(_own_types(reset_derived(identifiers, edges)[0], chunks, documents)[1])


def derive_aliases(identifiers: DataFrame, edges: DataFrame, chunks: DataFrame, documents: DataFrame, most: int | None = MAX_ALIASES) -> tuple[DataFrame, DataFrame]:
    """(identifiers, edges) with the aliases of property chains of API documents; derived rows of before are dropped first.

    ``World.afterEvents`` of type ``WorldAfterEvents``, which owns ``playerSpawn``, gives the
    alias ``World.afterEvents.playerSpawn`` on the chunk of that member, an edge
    property_type and an edge alias_of.  More than ``most`` aliases raise; None: there may be any number, and
    they are made where they are read.
    """
    identifiers, edges = reset_derived(identifiers, edges)
    own, types = _own_types(identifiers, chunks, documents)
    types = kept(types)  # read by every step and both results
    leads = types.select("normalized", F.col("target_normalized").alias("target"))
    members = own.join(leads, "normalized", "left").select(X.normalize_identifier(F.col("owner")).alias("owner"), "suffix", F.col("identifier").alias("member"), "target", "chunk_id", "identifier_kind")
    members = kept(members)
    chains = chain_steps(types.select(F.col("property").alias("prefix"), F.col("target_normalized").alias("target")), members)
    # dealt by chunk once; names are made of the rows that are left
    first = Window.partitionBy("chunk_id", X.normalize_identifier(F.col("alias"))).orderBy("depth", "alias")
    chains = chains.repartition("chunk_id").withColumn("r", F.row_number().over(first)).filter("r = 1")
    derived = chains.select(
        "chunk_id", F.col("alias").alias("identifier"), X.normalize_identifier(F.col("alias")).alias("normalized"), X.identifier_leaf(F.col("alias")).alias("leaf_name"), "identifier_kind",
        F.lit(0).alias("is_primary"), F.lit("derived-chain").alias("alias_type"), "member", "depth",
    )
    if most is not None:
        derived = kept(derived)
        if derived.limit(most + 1).count() > most:
            raise ValueError(f"ALIAS_LIMIT_EXCEEDED: more than {most} aliases")
    # an alias stands once in a chunk and a property has one type, so these edges are distinct, and unlike all that are left of before
    made = _type_edges(types).unionByName(derived.select(F.col("identifier").alias("from_identifier"), F.lit("alias_of").alias("relation"), F.col("member").alias("to_identifier"), "chunk_id"))
    edges = edges.dropDuplicates(["from_identifier", "relation", "to_identifier", "chunk_id"])
    return identifiers.unionByName(derived.drop("member", "depth"), allowMissingColumns=True), edges.unionByName(made, allowMissingColumns=True)


def reset_derived(identifiers: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without what ``derive_aliases`` adds; the alias field of the text index follows from the identifiers."""
    return identifiers.filter("alias_type <> 'derived-chain'"), edges.filter(~F.col("relation").isin("property_type", "alias_of"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) of the ends of (a, b) long edges, component the smallest id of what is connected.

    Every vertex takes the smallest label around it, then its label's label, until none
    changes; the number of rounds grows with the logarithm of a component's width.
    """
    both = kept(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(around, "id").select("id", "component", F.least("component", "near").alias("low"))
        # a label that has a smaller label of its own hands that on
        roots = low.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("least"))
        up = low.join(roots.withColumnRenamed("root", "component"), "component").join(roots.select(F.col("root").alias("low"), F.col("least").alias("next")), "low", "left")
        new = kept(up.select("id", F.col("component").alias("old"), F.least("low", "least", F.coalesce("next", "low")).alias("component")))
        changed = new.filter("old <> component").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise ValueError(f"components still change after {rounds} rounds")
