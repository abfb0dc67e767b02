"""Near-duplicate evidence over a whole corpus: candidates by rare shingles, exact verification, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rules as Y

from .graph import components
from .keep import kept

#: Two texts may be near duplicates only if these agree, where both have one.
GUARDS = ("channel", "api_version", "product_version", "identifier")
PERCENT, WORDS = 90, 12


#: Members of a list that one task compares with each other or with as many others.
BLOCK = 512
#: One value of a set in so many shows which sets meet no other.
PART = 4


def comparable(a: str, b: str) -> Column:
    out = F.lit(True)
    for g in GUARDS:
        x, y = F.col(f"{a}.{g}"), F.col(f"{b}.{g}")
        out &= (x == "") | (y == "") | (x == y)
    return out


def variant_links(nodes: DataFrame) -> DataFrame:
    """(a, b) that join the nodes of one text (text, node, guards) whose guards agree, a few for each node.

    Which guards a node has is its kind, one of sixteen.  Nodes of two kinds are comparable
    if they agree on the guards that both kinds have, so all nodes of two kinds with the same values
    of these stand in one group, and there every node of one kind is comparable to every
    one of the other: the group is one class as soon as both kinds are in it.
    """
    kind = sum((F.when(F.col(g) != "", 1 << i).otherwise(0) for i, g in enumerate(GUARDS)), F.lit(0))
    several = nodes.groupBy("text").count().filter("count > 1").select("text")
    rows = nodes.join(several, "text", "left_semi").withColumn("kind", kind).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(GUARDS) - 1))))
    both = F.col("kind").bitwiseAND(F.col("other"))
    shared = F.concat_ws("\0", *[F.when(both.bitwiseAND(F.lit(1 << i)) != 0, F.col(g)).otherwise("") for i, g in enumerate(GUARDS)])
    rows = rows.select("text", F.least("kind", "other").alias("low"), F.greatest("kind", "other").alias("high"), shared.alias("shared"), "kind", "node")
    key = ["text", "low", "high", "shared"]
    groups = rows.groupBy(key).agg(F.min("node").alias("a"), F.min("kind").alias("k"), F.max("kind").alias("l"), F.count("*").alias("n")).filter("n > 1 AND k = low AND l = high")
    return rows.join(groups.select(*key, "a"), key).filter("a < node").select("a", F.col("node").alias("b")).distinct()


def met(sets: DataFrame, part: int = PART) -> DataFrame:
    """The sets (set, s) that may have a near duplicate: of one value in ``part`` no more than a tenth of the whole set are in no other set.

    A near duplicate lacks at most a tenth of a set's values, whichever these are, so none is lost;
    of unlike texts most are known as such by the part, and the other values are never dealt out.
    """
    some = sets.select("set", F.explode(F.filter("s", lambda v: F.pmod(v, F.lit(part)) == 0)).alias("v"))
    alone = some.groupBy("v").agg(F.count("*").alias("df"), F.min("set").alias("set")).filter("df = 1").groupBy("set").agg(F.count("*").alias("alone"))
    few = 100 * F.coalesce(F.col("alone"), F.lit(0)) <= (100 - PERCENT) * F.size("s")
    return sets.join(alone, "set", "left").filter(few).drop("alone")


def near_duplicates(texts: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, class_id) of texts (doc_id, text and any of the guards): class_id is the smallest doc_id reachable over near-duplicate pairs.

    Texts with equal words and guards are one node; sets that meet no other are left out (``met``).  A pair with 90 % of its 3-word
    shingles in common shares one of the rarest tenth (and one) of either set, so that
    nodes meet only in the lists of these; of lists with equal members one is enough.  Each list
    links its members to one, and what is linked makes components.  The sets of lists that still hold several
    components travel to their list, where they are compared inside the join, a pair in the
    first list that it shares only; a list of more than ``BLOCK`` members is dealt by pairs of blocks.  What
    leaves a task is one link for two components, so rows between steps follow the lists, not the pairs.
    Texts without a word are alike to nothing.
    """
    guard = lambda g: F.coalesce(F.lower(g) if g == "identifier" else F.col(g), F.lit("")) if g in texts.columns else F.lit("")
    words = Y.evidence_words(F.coalesce(F.col(column), F.lit("")))
    once_each = lambda c: F.explode(F.array(c))  # noqa: E731 - a row's own array as it is, made once however often it is asked for
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), *[guard(g).alias(g) for g in GUARDS], once_each(words).alias("words")).filter(F.size("words") > 0)
    rows = rows.select("doc_id", *GUARDS, F.size("words").alias("n"), F.sha2(F.array_join("words", " "), 256).alias("text"), once_each(F.transform("words", lambda w: F.xxhash64(w))).alias("h"))
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))))
    rows = kept(rows.select("doc_id", *GUARDS, "text", "n", F.when(F.col("n") >= WORDS, shingles).alias("s")))
    nodes = kept(rows.groupBy("text", *GUARDS).agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("s").alias("s")))
    same = variant_links(nodes.select("text", "node", *GUARDS))

    sets = kept(met(nodes.filter(F.col("n") >= WORDS).select(F.xxhash64("text", *GUARDS).alias("set"), "node", *GUARDS, "n", "s")).drop("set"))
    values = sets.select("node", F.size("s").alias("m"), F.explode("s").alias("v"))
    seen = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("node")
    # values of one set alone are the rarest of all and need no place in a list, only to be counted
    ranked = values.join(seen, "v").withColumn("r", F.col("m") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "v")))
    lists = ranked.filter(F.col("r") <= F.floor(F.col("m") * (100 - PERCENT) / 100) + 1)
    lists = kept(lists.select("v", "node"))
    members = lists.groupBy("v").agg(F.min("node").alias("a"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")).filter("members > 1")
    once = members.groupBy("a", "members", "h1", "h2").agg(F.min("v").alias("v")).select("v", "a", "members")
    lists = kept(lists.join(once, "v"))

    def alike(x: str, y: str) -> Column:
        """Whether two sets are near duplicates, what is cheap first."""
        c = lambda side, name: F.col(f"{side}.{name}")
        near = F.least(c(x, "n"), c(y, "n")) >= 0.8 * F.greatest(c(x, "n"), c(y, "n"))
        sizes = 100 * F.least(F.size(c(x, "s")), F.size(c(y, "s"))) >= PERCENT * F.greatest(F.size(c(x, "s")), F.size(c(y, "s")))
        return near & sizes & comparable(x, y) & ((100 + PERCENT) * F.size(F.array_intersect(c(x, "s"), c(y, "s"))) >= PERCENT * (F.size(c(x, "s")) + F.size(c(y, "s"))))

    body = F.struct(*GUARDS, "n", "s")
    stars = lists.filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    tested = stars.join(sets.select(F.col("node").alias("a"), body.alias("x")), "a").join(sets.select(F.col("node").alias("b"), body.alias("y")), "b").filter(alike("x", "y"))
    links = kept(same.unionByName(tested.select("a", "b")))
    label = components(links).select(F.col("id").alias("node"), "component")

    placed = kept(lists.join(label, "node", "left").select("v", "node", "members", F.coalesce("component", "node").alias("c")))
    open_lists = placed.groupBy("v").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("v")
    placed = kept(placed.join(open_lists, "v", "left_semi"))
    # the open lists of a node beside its set: a pair is tested in the first list of both
    mine = placed.groupBy("node").agg(F.collect_set("v").alias("lists"))
    blocks = F.ceil(F.col("members") / BLOCK)
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), blocks)).withColumn("beside", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cells = dealt.select("v", F.least("block", "beside").alias("low"), F.greatest("block", "beside").alias("high"), "node", "block", "c")
    cells = cells.join(mine, "node").join(sets, "node").select("v", "low", "high", F.struct("node", "block", "c", "lists", *GUARDS, "n", "s").alias("x"))
    here = (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & ((F.col("l.low") == F.col("l.high")) | (F.col("x.block") != F.col("y.block")))
    first = F.array_min(F.array_intersect("x.lists", "y.lists")) == F.col("l.v")
    left, right = cells.alias("l"), cells.withColumnRenamed("x", "y").alias("r")
    meet = (F.col("l.v") == F.col("r.v")) & (F.col("l.low") == F.col("r.low")) & (F.col("l.high") == F.col("r.high"))
    pairs = left.join(right, meet & here & first & alike("x", "y")).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
    label = components(kept(links.unionByName(pairs))).select(F.col("id").alias("node"), "component")
    of_node = nodes.select("text", *GUARDS, "node").join(label, "node", "left").select("text", *GUARDS, F.coalesce("component", "node").alias("class_id"))
    # a doc_id may have several rows: it belongs to the smallest of its classes
    named = rows.drop("n", "s").join(of_node, ["text", *GUARDS]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return texts.select(F.col("doc_id").cast("long").alias("doc_id")).join(named, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
