"""Column builders for labels, filters, versions and ranking bonuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

L, R = X.EDGE_L, X.EDGE_R

# What a query's wording tells.
INTENT = {
    "preview": "(?:beta|preview|experimental|prerelease|pre-release)",
    "stable": r"(?:stable|production|release\s+channel)",
    "version": r"(?:current|latest|version|versions|compatible|compatibility|supports?|introduced|available|contains?)",
    "manifest": r"(?:manifest(?:\.json)?|dependencies|dependency|module_name|min_engine_version)",
    "example": r"(?:example|examples|sample|samples|tutorial|how\s+(?:do|can|should)|show\s+me|code\s+example)",
    "definition": r"(?:what\s+is|definition|reference|signature|type\s+of)",
    "debugging": "(?:why|error|errors|fail|fails|failed|invalid|debug|debugging|schema|validate|validation)",
}
MODULE = r"@minecraft/[a-z0-9][a-z0-9._-]*"
MODULE_VERSION = r"(?:current|latest|beta|stable)"
IDENTIFIER_LIKE = (
    r"(?:minecraft:|@minecraft/|(?<![A-Za-z0-9_])(?:query|variable|context|temp)\.[A-Za-z_$]|[._][A-Za-z_$]|[A-Z][a-z]+[A-Z]|[A-Za-z_$]+\.[A-Za-z_$]+)"
)
HISTORICAL = r"(?:historical|legacy|old\s+api|prior\s+api)"
FETCH_ID = r"(?<![A-Za-z0-9_])(?:doc|chk)_[A-Za-z0-9_-]{4,64}(?![A-Za-z0-9_])"
SOURCE_DISCOVERY = rf"(?i){L}(?:which|what|list|show)\s+(?:knowledge\s+)?sources?{R}|{L}provenance{R}|{L}repositor(?:y|ies){R}"
CATEGORY_DISCOVERY = rf"(?i){L}(?:which|what|list|show)\s+(?:knowledge\s+)?categor(?:y|ies){R}"


def word_in(col: Column, pattern: str) -> Column:
    return col.rlike(f"(?i){L}{pattern}{R}")


def intent_module(query: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(query, f"(?i){MODULE}", 0)), F.lit(""))


def intent_flags(query: Column) -> Column:
    """A struct of eight flags and the module; a wish for previews overrides one for stable material."""
    preview = word_in(query, INTENT["preview"])
    module = intent_module(query)
    return F.struct(
        preview.alias("preview"),
        (word_in(query, INTENT["stable"]) & ~preview).alias("stable"),
        (word_in(query, INTENT["version"]) | (module.isNotNull() & word_in(query, MODULE_VERSION))).alias("version"),
        *[word_in(query, INTENT[k]).alias(k) for k in ("manifest", "example", "definition", "debugging")],
        query.rlike(IDENTIFIER_LIKE).alias("identifier_like"),
        module.alias("module"),
    )


def normalize_version(v: Column) -> Column:
    return F.regexp_replace(F.lower(X.js_trim(v)), r"^v(?=\d)", "")


def version_compat(requested: Column, actual: Column) -> Column:
    """exact, compatible (a shorter numeric request that the other begins with), unknown or mismatch."""
    wanted, have = normalize_version(requested), normalize_version(actual)
    core = lambda v: F.regexp_extract(v, r"^(\d+(?:\.\d+){0,3})(?:[-+].*)?$", 1)
    w, h = core(wanted), core(have)
    ws, hs = F.split(w, r"\."), F.split(h, r"\.")
    fits = (w != "") & (h != "") & (F.size(ws) < F.size(hs)) & (F.slice(hs, 1, F.size(ws)) == ws)
    missing = requested.isNull() | (requested == "") | actual.isNull() | (actual == "")
    return F.when(missing, "unknown").when(wanted == have, "exact").when(fits, "compatible").otherwise("mismatch")


def version_score(requested: Column, actual: Column) -> Column:
    kind = version_compat(requested, actual)
    known = F.when(kind == "exact", 30).when(kind == "compatible", 15).when(kind == "unknown", -4).otherwise(-1000)
    return F.when(requested.isNull() | (requested == ""), 0).otherwise(known)


def engine_version(version: Column) -> Column:
    """The product version inside a prerelease package version."""
    return F.nullif(F.regexp_extract(version, r"(?i)-(?:beta|rc|internal)\.(\d+\.\d+\.\d+(?:-[A-Za-z]+\.\d+)?)$", 1), F.lit(""))


def manifest_track(version: Column) -> Column:
    """The version as a manifest names it: release, or release and track."""
    pattern = r"(?i)^(\d+\.\d+\.\d+)-(beta|rc|internal)(?:\.|$)"
    base = F.regexp_extract(version, pattern, 1)
    track = F.concat(base, F.lit("-"), F.lower(F.regexp_extract(version, pattern, 2)))
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), version).when(base != "", track)


# Categories by what a path contains, in this order.
PATH_CATEGORIES = (
    ("molang", "molang"),
    (r"(?:^|/)commands?(?:/|$)", "commands"),
    ("gametest", "gametest"),
    ("editor", "editor"),
    ("schema", "schemas"),
    ("debug", "debugging"),
    ("protocol|network", "networking_protocol"),
    ("animation[_ -]?controllers?", "animation_controllers"),
    ("render[_ -]?controllers?", "render_controllers"),
    ("(?:^|/)animations?(?:/|$)", "animations"),
    ("manifest", "manifests"),
    ("behavior[_ -]?packs?", "behavior_packs"),
    ("resource[_ -]?packs?", "resource_packs"),
)
JSON_PLACES = (
    ("animation_controllers/", "json", "animation_controllers"),
    ("animations/", "json", "animations"),
    ("render_controllers/", "json", "render_controllers"),
    ("entities/", "component", "entities"),
    ("blocks/", "component", "blocks"),
    ("items/", "component", "items"),
    (r"manifest\.json$", "reference", "manifests"),
    ("schema", "reference", "schemas"),
    ("protocol|network", "reference", "networking_protocol"),
    ("behavior_pack", "json", "behavior_packs"),
    ("resource_pack", "json", "resource_packs"),
)
SOURCE_CATEGORIES = (
    ("gametest", "gametest"), ("editor", "editor"), ("schema", "schemas"), ("debugger", "debugging"), ("protocol", "networking_protocol"), ("creator_tools", "creator_tools"),
)


def first_of(rules, otherwise: Column) -> Column:
    """Value of the first (condition, value) that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def classify_path(path: Column) -> Column:
    """Struct of kind, category, language and lifecycle."""
    given = F.replace(path, F.lit("\\"), F.lit("/"))
    low = F.lower(given)
    topic = first_of([(low.rlike(p), F.lit(c)) for p, c in PATH_CATEGORIES], F.lit("documentation"))
    or_else = lambda name: F.when(topic == "documentation", name).otherwise(topic)

    def made(kind, category, language, lifecycle="active"):
        values = [x if isinstance(x, Column) else F.lit(x) for x in (kind, category, language, lifecycle)]
        return F.struct(*[v.alias(n) for v, n in zip(values, ("kind", "category", "language", "lifecycle"), strict=True)])

    places = [(low.rlike(p), (k, c)) for p, k, c in JSON_PLACES]
    json_kind = first_of([(w, F.lit(k)) for w, (k, _) in places], F.lit("json"))
    json_category = first_of([(w, F.lit(c)) for w, (_, c) in places], F.lit("json"))
    return (
        F.when(F.contains(given, F.lit("/PriorScriptAPI/")), made("api", "script_api_legacy", "markdown", "historical"))
        .when(F.contains(given, F.lit("/ScriptAPI/")), made("api", "script_api", "markdown"))
        .when(low.rlike(r"\.mcfunction$"), made("code", "commands", "mcfunction"))
        .when(low.rlike(r"\.mdx?$"), made("docs", topic, "markdown"))
        .when(low.rlike(r"\.tsx?$"), made("code", or_else("scripting"), "typescript"))
        .when(low.rlike(r"\.[mc]?js$"), made("code", or_else("scripting"), "javascript"))
        .when(low.rlike(r"\.json$"), made(json_kind, json_category, "json"))
        .otherwise(made("reference", or_else("other"), "text"))
    )


def category_for_source(category: Column, source_id: Column, channel: Column) -> Column:
    named = first_of([(F.contains(source_id, F.lit(p)), F.lit(c)) for p, c in SOURCE_CATEGORIES], category)
    return (
        F.when(category == "script_api", F.when(channel == "preview", "script_api_beta").otherwise("script_api_stable"))
        .when(category.isin("documentation", "scripting", "json", "other"), named)
        .otherwise(category)
    )


def stability_from_text(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("pre-release|experimental"), "experimental").when(F.contains(low, F.lit("beta")), "beta").when(F.contains(low, F.lit("internal")), "internal").otherwise("stable")


def lifecycle_from_text(text: Column, historical: Column) -> Column:
    low = F.lower(text)
    return F.when(historical, "historical").when(F.contains(low, F.lit("deprecated")), "deprecated").when(F.contains(low, F.lit("removed")), "removed").otherwise("active")


def package_from_path(path: Column) -> Column:
    """The module that an API page belongs to, from the folders behind the root of such pages; the server module where they don't tell."""
    root = F.when(F.contains(path, F.lit("/PriorScriptAPI/")), "/PriorScriptAPI/").otherwise("/ScriptAPI/")
    folders = X.non_empty(F.split(F.split_part(path, root, F.lit(2)), "/"))
    name = F.when(F.get(folders, F.lit(0)) == "minecraft", F.regexp_replace(F.get(folders, F.lit(1)), r"(?i)-\d+xx$", ""))
    return F.coalesce(F.concat(F.lit("@minecraft/"), name), F.lit("@minecraft/server"))


def symbol_kind_for_group(group: Column) -> Column:
    low = F.lower(group)
    return first_of([(F.contains(low, F.lit(k)), F.lit(v)) for k, v in (("propert", "property"), ("method", "method"), ("event", "event"), ("enum", "enum"))], F.lit("unknown"))


def class_name_from_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(X.strip_md(title), r"(?i)\s+(Class|Interface|Enum)\s*$", ""), r"^.*\.", ""))


def document_symbol_kind(title: Column) -> Column:
    return F.when(word_in(title, "Interface"), "interface").when(word_in(title, "Enum"), "enum").otherwise("class")


# --- filters ---


def preview_allowed(include: Column, channel: Column, stability: Column) -> Column:
    return include | ~((channel == "preview") | stability.isin("beta", "experimental", "internal"))


def preview_wanted(option: Column, query: Column, channel_option: Column) -> Column:
    """The option, else what the query or a wish for the preview channel implies."""
    return F.coalesce(option, word_in(query, INTENT["preview"]) | F.coalesce(F.lower(channel_option) == "preview", F.lit(False)))


def historical_allowed(option: Column, query: Column, lifecycle: Column) -> Column:
    return F.coalesce(option, word_in(query, HISTORICAL)) | ~lifecycle.isin("historical", "removed")


def member_of(wanted: Column, value: Column) -> Column:
    """True if the list is null, empty or holds the value."""
    return F.coalesce(F.size(wanted) <= 0, F.lit(True)) | F.coalesce(F.array_contains(wanted, value), F.lit(False))


def tier_allowed(wanted: Column, tier: Column) -> Column:
    return F.array_contains(F.coalesce(wanted, F.array(*[F.lit(t) for t in (1, 2, 3)])), tier)


def same_text(option: Column, value: Column) -> Column:
    return option.isNull() | (option == "") | F.coalesce(F.lower(option) == F.lower(value), F.lit(False))


def path_under(prefix: Column, path: Column) -> Column:
    return prefix.isNull() | F.startswith(F.lower(path), F.lower(F.regexp_replace(prefix, "^/+", "")))


def version_allowed(requested: Column, actual: Column) -> Column:
    return version_compat(requested, actual) != "mismatch"


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path pattern: ** any text, * and ? within a segment."""
    import re

    clean = re.sub(r"^/+", "", re.sub(r"^\./", "", glob.replace("\\", "/")))
    parts = re.split(r"(\*{2,}|\*|\?)", clean)
    return "^" + "".join({"*": "[^/]*", "?": "[^/]"}.get(p, ".*" if p.startswith("**") else re.escape(p).replace("\\-", "-").replace("\\ ", " ")) for p in parts) + "$"


def path_selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""), "^/+", "")
    any_of = lambda globs: F.lit(False) if not globs else clean.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    return (F.lit(True) if not include else any_of(include)) & ~any_of(exclude)


def safe_branch(v: Column) -> Column:
    segments = F.split(v, "/")
    return (
        F.length(v).between(1, 200) & v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~v.rlike(r"[./]$|\.\.|//")
        & F.forall(segments, lambda s: (s != "") & ~F.startswith(s, F.lit(".")) & ~F.endswith(s, F.lit(".lock")))
    )


def safe_sparse_path(v: Column) -> Column:
    return F.length(v).between(1, 300) & v.rlike(r"^[A-Za-z0-9._/-]+$") & ~v.rlike("^[-/]|/$|//") & F.forall(F.split(v, "/"), lambda s: ~s.isin("", ".", ".."))


def id_kind(v: Column) -> Column:
    clean = X.js_trim(v)
    return F.when(clean.rlike("^chk_[a-f0-9]{24}$"), "chunk").when(clean.rlike("^doc_[a-f0-9]{24}$"), "document").otherwise("invalid")


def repository_identity(url: Column) -> Column:
    """host/path of https, ssh and scp-like addresses alike."""
    clean = F.regexp_replace(F.regexp_replace(X.js_trim(url), "/$", ""), r"(?i)\.git$", "")
    scp = F.concat(F.lower(F.regexp_extract(clean, "(?i)^git@([^:]+):(.+)$", 1)), F.lit("/"), F.lower(F.regexp_replace(F.regexp_extract(clean, "(?i)^git@([^:]+):(.+)$", 2), "^/+", "")))
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)(?::\d+)?/*([^?#]*?)/*(?:[?#].*)?$"
    web = F.concat(F.lower(F.regexp_extract(clean, pattern, 1)), F.lit("/"), F.lower(F.regexp_extract(clean, pattern, 2)))
    return F.when(clean.rlike("(?i)^git@[^:]+:.+$"), scp).when(clean.rlike(pattern), web).otherwise(F.lower(clean))


def url_segment(v: Column) -> Column:
    """Percent-encoding as URI components have it."""
    out = F.url_encode(v)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def blob_url(repository: Column, revision: Column, path: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(repository, "/$", ""), r"(?i)\.git$", "")
    return F.concat(base, F.lit("/blob/"), url_segment(revision), F.lit("/"), F.array_join(F.transform(F.split(path, "/"), url_segment), "/"))


# --- ranking ---


def meta_bonus(tier: Column, lifecycle: Column, stability: Column, channel: Column) -> Column:
    return (
        (F.lit(5) - tier) * 15
        + F.when(lifecycle == "active", 4).when(lifecycle == "deprecated", -4).when(lifecycle == "historical", -8).otherwise(0)
        + F.when(stability == "stable", 4).when(stability == "beta", 1).when(stability == "experimental", -2).when(stability == "internal", -5).otherwise(0)
        + F.when(channel == "stable", 3).when(channel == "preview", -2).otherwise(0)
    )


def intent_bonus(intent: Column, c: dict[str, Column], terms: Column) -> Column:
    """Bonus of a candidate (columns by name in ``c``) for the query's intent and its terms in title and path."""
    on = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), F.lit(float(points))).otherwise(F.lit(0.0))
    title, path = F.lower(c["title"]), F.lower(c["path"])
    i = lambda name: intent[name]
    stable = ~i("preview") & i("stable")
    flat = [
        on(F.lower(c["api_package"]) == i("module"), 40),
        on(i("version") & (c["source_type"] == "npm"), 28),
        on(i("version") & c["api_version"].isNotNull(), 8),
        on(i("manifest") & (c["category"] == "manifests"), 18),
        on(i("manifest") & (F.contains(path, F.lit("manifest")) | F.contains(title, F.lit("manifest"))), 12),
        on(i("manifest") & (c["source_type"] == "npm") & (c["channel"] == "stable"), 8),
        on(i("example") & (c["kind"] == "example"), 18),
        on(i("example") & (c["kind"] == "code"), 10),
        on(i("example") & path.rlike("(?:^|/)(?:samples?|examples?)(?:/|$)"), 12),
        on(i("definition") & c["kind"].isin("api", "component", "reference"), 10),
        on(i("debugging") & c["category"].isin("schemas", "debugging"), 16),
        on(i("debugging") & path.rlike("schema|debug"), 8),
        on(i("preview") & (c["channel"] == "preview"), 18),
        on(i("preview") & c["stability"].isin("beta", "experimental"), 8),
        on(stable & (c["channel"] == "stable"), 18),
        on(stable & (c["stability"] == "stable"), 8),
        on(stable & (c["channel"] == "preview"), -16),
    ]
    per_term = F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.when(F.contains(title, t), 2.5).otherwise(0.0) + F.when(F.contains(path, t), 0.75).otherwise(0.0))
    return sum(flat[1:], flat[0]) + per_term


def semantic_intent_bonus(intent: Column, c: dict[str, Column]) -> Column:
    on = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), F.lit(points)).otherwise(F.lit(0.0))
    return (
        on(F.lower(c["api_package"]) == intent["module"], 0.0035) + on(intent["version"] & (c["source_type"] == "npm"), 0.0035)
        + on(intent["preview"] & (c["channel"] == "preview"), 0.0025) + on(intent["stable"] & (c["channel"] == "stable"), 0.0025)
        + on(intent["example"] & c["kind"].isin("example", "code"), 0.0015) + on(intent["debugging"] & c["category"].isin("schemas", "debugging"), 0.0015)
    )


def fusion_weights(intent: Column) -> tuple[Column, Column]:
    lexical = F.when(intent["identifier_like"], 0.9).when(intent["example"], 0.62).otherwise(0.55)
    semantic = F.when(intent["identifier_like"], 0.1).when(intent["example"], 0.38).otherwise(0.45)
    return lexical, semantic


# --- near duplicates among evidence ---


def evidence_words(text: Column) -> Column:
    return F.filter(X.query_tokens(F.lower(text)), lambda w: F.length(w) > 1)


def evidence_shingles(words: Column) -> Column:
    n = F.size(words)
    three = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.array_distinct(F.when(n < 3, words).otherwise(three))


def evidence_similarity(a: Column, b: Column) -> Column:
    """Jaccard of 3-word shingles of two word lists; 1 for equal lists, 0 for short or unlike lengths."""
    na, nb = F.size(a), F.size(b)
    sa, sb = evidence_shingles(a), evidence_shingles(b)
    shared = F.size(F.array_intersect(sa, sb))
    jaccard = shared / (F.size(sa) + F.size(sb) - shared)
    return (
        F.when((na == 0) | (nb == 0), 0.0).when(a == b, 1.0).when(F.least(na, nb) < 12, 0.0).when(F.least(na, nb) / F.greatest(na, nb) < 0.8, 0.0).otherwise(jaccard)
    )


# --- query planner ---

GENERIC_NAMES = "API Bedrock Code Definition Example How JSON Minecraft Preview Script Stable What When Where Which Why".split()  # fixed values


def query_identifiers(query: Column) -> Column:
    """At most eight identifiers of a question: namespaced, module, dotted, quoted, then Pascal-case names."""
    every = lambda pattern, group=0: F.regexp_extract_all(query, F.lit(pattern), F.lit(group))
    quoted = F.filter(
        F.transform(every(r"[`'\"]([^`'\"\n]{2,120})[`'\"]", 1), X.js_trim),
        lambda x: x.rlike(r"^(?:minecraft:|@minecraft/|[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)$"),
    )
    pascal = F.filter(every(L + r"[A-Z][A-Za-z0-9_$]{2,}" + R), lambda x: ~x.isin(*GENERIC_NAMES))
    found = F.concat(
        every("(?i)" + L + r"minecraft:[a-z0-9_.:-]+" + R),
        every(r"(?i)@minecraft/[a-z0-9._-]+(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*"),
        every(L + r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)+" + R),
        quoted,
        pascal,
    )
    clean = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(X.js_trim(x), r"^[(\[<{]+", ""), r"[\])>},;:!?]+$", ""), r"\(\)$", ""))
    return F.slice(F.array_distinct(X.non_empty(F.transform(clean, X.js_trim))), 1, 8)


def plan_lookup(query: Column) -> Column:
    """Struct of the planned lookup: intent, recommended tool, confidence, search query, identifiers, keywords, kinds."""
    q = X.normalize_whitespace(query)
    flags = intent_flags(q)
    ids = query_identifiers(q)
    fetch_id = F.nullif(F.regexp_extract(q, FETCH_ID, 0), F.lit(""))
    n = F.size(ids)
    definition = flags["definition"] | (flags["identifier_like"] & (n == 1) & (F.size(F.split(q, r"\s+")) <= 5))
    intent = (
        F.when(fetch_id.isNotNull(), "evidence_fetch").when(q.rlike(SOURCE_DISCOVERY), "source_discovery").when(q.rlike(CATEGORY_DISCOVERY), "category_discovery")
        .when(definition, "definition").when(flags["example"], "example").when(flags["debugging"], "debugging").when(flags["manifest"], "manifest")
        .when(flags["version"], "version").otherwise("general")
    )
    tool = (
        F.when(intent == "evidence_fetch", "fetch").when(intent == "source_discovery", "list_sources").when(intent == "category_discovery", "list_categories")
        .when((intent == "definition") & (n > 0), "get_definition").otherwise("search")
    )
    confidence = (
        F.when(intent == "evidence_fetch", 0.99).when(intent.isin("source_discovery", "category_discovery"), 0.94).when(intent == "definition", F.when(n > 0, 0.96).otherwise(0.78))
        .when(intent == "example", 0.88).when(intent.isin("debugging", "manifest"), 0.86).when(intent == "version", 0.84).otherwise(0.68)
    )
    search = F.when(tool == "get_definition", F.get(ids, 0)).when((intent == "version") & flags["module"].isNotNull(), flags["module"]).otherwise(q)
    kinds = {"definition": "api component reference", "example": "example code", "debugging": "docs reference json code", "manifest": "json docs reference", "version": "reference api docs"}
    suggested = first_of([(intent == k, F.array(*[F.lit(x) for x in v.split()])) for k, v in kinds.items()], F.array().cast("array<string>"))
    preview = F.when(flags["preview"], True).when(flags["stable"], False)
    return F.struct(
        q.alias("normalized_query"), search.alias("search_query"), intent.alias("intent"), tool.alias("recommended_tool"), confidence.cast("double").alias("confidence"),
        ids.alias("identifiers"), X.keywords(q).alias("keywords"), suggested.alias("suggested_kinds"), flags["module"].alias("module"), fetch_id.alias("fetch_id"), preview.alias("include_preview"),
    )
