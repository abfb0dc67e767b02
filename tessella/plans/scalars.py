"""Queries of the scalar functions over whole tables, or over samples of the syntax they read joined to every line of the documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X

from .corpus import Corpus, duck

SAMPLES = [
    "`World.afterEvents.playerSpawn`", "  Block Component ", "ns:thing.name/part", "camelCaseName", "@scope/server-ui", "a.b", "", "plain words here", "x::y", "HTTPServer2Go",
    "Use ItemStack.getComponent and `Vector3` in world.sendMessage, then /give me", "see [Player](../Player.md#top) or minecraft:apple. EntityHealthComponent!", "tail.", "query.is_moving && math.sin(x)",
]
QUESTIONS = [
    "What is the latest @minecraft/server version?", "how do I use beta events", "show sources", "which categories", "why does the schema fail to validate", "manifest.json min_engine_version", "World.afterEvents",
    "chk_0123456789abcdef01234567", "stable release channel example code", "legacy old api for `minecraft:pig`", "query.is_baby", "EntityHealthComponent definition", "tutorial for blocks", "preview vs stable",
]
PATHS = [
    "docs/Molang/intro.md", "a/commands/give.mcfunction", "src/gametest/main.ts", "pack/entities/pig.json", "pack/animation_controllers/a.json", "manifest.json", "x/ScriptAPI/minecraft/server/World.md",
    "x/PriorScriptAPI/minecraft/server-1xx/World.md", "readme.txt", "schemas/block.json", "lib/network/packet.js", "behavior_packs/demo/scripts/a.js", "notes/resource pack/list.txt", "./dist/x.mdx", "a/b/c.tsx", "items/sword.json",
]


def _values(rows: list[str]) -> str:
    return ", ".join(f"({i}, '" + r.replace("'", "''") + "')" for i, r in enumerate(rows))


def _fixed(rows: list[str], outputs: dict[str, tuple[Callable[[], Column], str]]):
    """(query, SQL) of named expressions over inline strings ``s`` alone, for the few whose SQL knows its rows."""

    def query(spark, sf_dir):
        return spark.createDataFrame(list(enumerate(rows)), "sid int, s string").select("sid", *[c().alias(k) for k, (c, _) in outputs.items()])

    return query, f"SELECT sid, {', '.join(f'{e} AS {k}' for k, (_, e) in outputs.items())} FROM (VALUES {_values(rows)}) AS t(sid, s)"


def _inline(rows: list[str], outputs: dict[str, tuple[Callable[[], Column], str]], splice: str = "concat(s, ' ', w)"):
    """(query, SQL) of named expressions over strings ``s``: the given samples, and for each line of the documents one of them joined to the line's first word ``w`` (``splice``, the same text in both engines)."""

    def query(spark, sf_dir):
        lines = Corpus(spark, sf_dir).chunks.select("chunk_id", (F.pmod(F.col("doc_id") + F.col("ordinal"), F.lit(len(rows))) + 1).cast("int").alias("k"), F.coalesce("identifier", F.lit("x")).alias("w"))
        lines = lines.select(F.col("chunk_id").alias("sid"), F.element_at(F.array(*[F.lit(r) for r in rows]), F.col("k")).alias("s"), "w").select("sid", F.expr(splice).alias("s"))
        given = spark.createDataFrame([(str(k), r) for k, r in enumerate(rows)], "sid string, s string")
        return given.unionByName(lines).select("sid", *[c().alias(k) for k, (c, _) in outputs.items()])

    texts = ", ".join("'" + r.replace("'", "''") + "'" for r in rows)
    lines = f"SELECT chunk_id AS sid, {splice} AS s FROM (SELECT chunk_id, ([{texts}])[(doc_id + ordinal) % {len(rows)} + 1] AS s, coalesce(identifier, 'x') AS w FROM c_chunks)"
    return query, duck(f"SELECT sid, {', '.join(f'{e} AS {k}' for k, (_, e) in outputs.items())} FROM (SELECT CAST(sid AS VARCHAR) AS sid, s FROM (VALUES {_values(rows)}) AS t(sid, s) UNION ALL {lines})")


def _joined(splice: str):
    return functools.partial(_inline, splice=splice)


def _over(relation: str, keys: list[str], outputs: dict[str, tuple[Callable[[], Column], str]], given: str = ""):
    """(query, SQL) of named expressions over a relation of the corpus or a table."""

    def query(spark, sf_dir):
        c = Corpus(spark, sf_dir)
        df = getattr(c, relation) if hasattr(Corpus, relation) else c.table(relation)
        return df.select(*keys, *[e().alias(k) for k, (e, _) in outputs.items()])

    name = f"c_{relation}" if hasattr(Corpus, relation) else relation
    return query, duck(f"SELECT {', '.join([*keys, *[f'{e} AS {k}' for k, (_, e) in outputs.items()]])} FROM {name}")




def s() -> Column:
    """The sample's text; columns are made when a query runs, as they need a session."""
    return F.col("s")


BT = "regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '^`+|`+$', '', 'g')"
LEAF = f"coalesce(list_filter(regexp_split_to_array({BT}, '[.:/]'), lambda x: x <> '')[-1], {BT})"
PARTS = f"list_filter(regexp_split_to_array({BT}, '[.:/_@-]+'), lambda x: x <> '')"


def _distinct(expr: str) -> str:
    """DuckDB: first-seen distinct of a list."""
    return f"list_filter(list_transform({expr}, lambda x, i: CASE WHEN list_position({expr}, x) = i THEN x END), lambda x: x IS NOT NULL)"


def _join(c: Column) -> Column:
    return F.array_join(c, "|")


TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_@.$:-]+')"


def _terms(stop: list[str], most: int, s: str = "s") -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"array_to_string({_distinct(f'list_filter({TOKENS.format(f'lower({s})')}, lambda t: length(t) > 1 AND t NOT IN ({words}))')}[1:{most}], '|')"


def _flag(pattern: str) -> str:
    return f"regexp_matches(s, '(?i)\\b{pattern}\\b')"


MODULE = "nullif(lower(regexp_extract(s, '(?i)@minecraft/[a-z0-9][a-z0-9._-]*', 0)), '')"
LIKE = r"regexp_matches(s, '(?:minecraft:|@minecraft/|\b(?:query|variable|context|temp)\.[A-Za-z_$]|[._][A-Za-z_$]|[A-Z][a-z]+[A-Z]|[A-Za-z_$]+\.[A-Za-z_$]+)')"


def _compat(w: str, a: str) -> str:
    norm = lambda v: f"regexp_replace(lower(trim({v})), '^v([0-9])', '\\1')"
    core = lambda v: f"regexp_extract({norm(v)}, '^([0-9]+(\\.[0-9]+){{0,3}})([-+].*)?$', 1)"
    return (
        f"CASE WHEN coalesce({w}, '') = '' OR coalesce({a}, '') = '' THEN 'unknown' WHEN {norm(w)} = {norm(a)} THEN 'exact' "
        f"WHEN {core(w)} <> '' AND {core(a)} <> '' AND starts_with({core(a)}, {core(w)} || '.') THEN 'compatible' ELSE 'mismatch' END"
    )


COMPAT = _compat("requested", "actual")
SCORE = f"CASE WHEN coalesce(requested, '') = '' THEN 0 ELSE CASE {COMPAT} WHEN 'exact' THEN 30 WHEN 'compatible' THEN 15 WHEN 'unknown' THEN -4 ELSE -1000 END END"

_low = "lower(replace(s, '\\', '/'))"
TOPIC = "CASE " + " ".join(f"WHEN regexp_matches({_low}, '{p}') THEN '{c}'" for p, c in Y.PATH_CATEGORIES) + " ELSE 'documentation' END"


def _or(name: str) -> str:
    return f"CASE WHEN {TOPIC} = 'documentation' THEN '{name}' ELSE {TOPIC} END"


def _json(k: int, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({_low}, '{r[0]}') THEN '{r[k]}'" for r in Y.JSON_PLACES) + f" ELSE '{other}' END"


def _class(api: str, legacy: str, fn: str, md: str, ts: str, js: str, js_on: str, rest: str) -> str:
    return (
        f"CASE WHEN contains(replace(s, '\\', '/'), '/PriorScriptAPI/') THEN {legacy} WHEN contains(replace(s, '\\', '/'), '/ScriptAPI/') THEN {api} WHEN {_low} LIKE '%.mcfunction' THEN {fn} "
        f"WHEN regexp_matches({_low}, '\\.mdx?$') THEN {md} WHEN regexp_matches({_low}, '\\.tsx?$') THEN {ts} WHEN regexp_matches({_low}, '\\.[mc]?js$') THEN {js} WHEN {_low} LIKE '%.json' THEN {js_on} ELSE {rest} END"
    )



PAIRS = {
    "normalize_identifier": _joined("concat(w, '.', s)")(SAMPLES, {"normalized": (lambda: X.normalize_identifier(s()), f"lower(regexp_replace({BT}, '\\s+', '', 'g'))")}),
    "identifier_leaf": _joined("concat(w, '.', s)")(SAMPLES, {"leaf": (lambda: X.identifier_leaf(s()), LEAF)}),
    "identifier_search_terms": _joined("concat(w, '.', s)")(
        SAMPLES,
        {
            "terms": (
                lambda: _join(X.identifier_search_terms(s())),
                f"CASE WHEN {BT} = '' THEN '' ELSE array_to_string({_distinct(f'list_concat([{BT}, {LEAF}], flatten(list_transform({PARTS}, lambda p: [p, regexp_replace(p, chr(40) || chr(91) || chr(97) || chr(45) || chr(122) || chr(48) || chr(45) || chr(57) || chr(93) || chr(41) || chr(40) || chr(91) || chr(65) || chr(45) || chr(90) || chr(93) || chr(41), chr(92) || chr(49) || chr(32) || chr(92) || chr(50), chr(103))])))')}, '|') END".replace(
                    "chr(40) || chr(91) || chr(97) || chr(45) || chr(122) || chr(48) || chr(45) || chr(57) || chr(93) || chr(41) || chr(40) || chr(91) || chr(65) || chr(45) || chr(90) || chr(93) || chr(41)", "'([a-z0-9])([A-Z])'"
                ).replace("chr(92) || chr(49) || chr(32) || chr(92) || chr(50)", "'\\1 \\2'").replace("chr(103)", "'g'"),
            )
        },
    ),
    "query_tokens": _over("queries", ["query_id"], {"tokens": (lambda: _join(X.query_tokens(F.col("query"))), f"array_to_string({TOKENS.format('query')}, '|')")}),
    "compile_fts_query": _inline(
        [*QUESTIONS, "--"], {"match": (lambda: F.coalesce(X.compile_match(s()), F.lit("")), f"array_to_string(list_transform({_distinct(TOKENS.format('s'))}, lambda t: '\"' || t || '\"'), ' AND ')")}
    ),
    "meaningful_terms": _inline(QUESTIONS, {"terms": (lambda: _join(X.meaningful_terms(s())), _terms(X.RANKING_STOP_WORDS, 8))}),
    "keywords": _inline(QUESTIONS, {"terms": (lambda: _join(X.keywords(s())), _terms(X.PLANNER_STOP_WORDS, 10))}),
    "normalize_whitespace": _over("chunks", ["chunk_id"], {"clean": (lambda: X.normalize_whitespace(F.col("content")), "regexp_replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')")}),
    "clip_ellipsis": _over("documents", ["doc_id"], {"clipped": (lambda: X.clip_ellipsis(F.col("text"), 300), "CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, 299), '\\s+$', '') || '…' END")}),
    "intent_flags": _inline(
        QUESTIONS,
        {
            **{k: (lambda k=k: Y.intent_flags(s())[k], _flag(p)) for k, p in Y.INTENT.items() if k not in ("stable", "version")},
            "stable": (lambda: Y.intent_flags(s())["stable"], f"{_flag(Y.INTENT['stable'])} AND NOT {_flag(Y.INTENT['preview'])}"),
            "version": (lambda: Y.intent_flags(s())["version"], f"{_flag(Y.INTENT['version'])} OR ({MODULE} IS NOT NULL AND {_flag(Y.MODULE_VERSION)})"),
            "identifier_like": (lambda: Y.intent_flags(s())["identifier_like"], LIKE),
            "module": (lambda: Y.intent_flags(s())["module"], MODULE),
        },
    ),
    "version_compat": _over("versions", ["p_partkey"], {"compat": (lambda: Y.version_compat(F.col("requested"), F.col("actual")), COMPAT)}),
    "version_score": _over("versions", ["p_partkey"], {"points": (lambda: Y.version_score(F.col("requested"), F.col("actual")), SCORE)}),
    "npm_version_parts": _joined("concat(length(w), '.', s)")(
        ["1.2.0", "1.3.0-beta.1.20.80-preview.21", "2.0.0-rc.1.21.0", "0.1.0-internal.1.21.10", "3.0.0-alpha.1", "x"],
        {
            "engine": (lambda: Y.engine_version(s()), "nullif(regexp_extract(s, '(?i)-(?:beta|rc|internal)\\.(\\d+\\.\\d+\\.\\d+(?:-[A-Za-z]+\\.\\d+)?)$', 1), '')"),
            "track": (lambda: Y.manifest_track(s()), "CASE WHEN regexp_matches(s, '^\\d+\\.\\d+\\.\\d+$') THEN s WHEN regexp_matches(s, '(?i)^\\d+\\.\\d+\\.\\d+-(beta|rc|internal)(\\.|$)') THEN lower(regexp_extract(s, '(?i)^(\\d+\\.\\d+\\.\\d+-(?:beta|rc|internal))', 1)) END"),
        },
    ),
    "classify_path": _joined("concat(w, '/', s)")(
        PATHS,
        {
            "kind": (lambda: Y.classify_path(s())["kind"], _class("'api'", "'api'", "'code'", "'docs'", "'code'", "'code'", _json(1, "json"), "'reference'")),
            "category": (lambda: Y.classify_path(s())["category"], _class("'script_api'", "'script_api_legacy'", "'commands'", TOPIC, _or("scripting"), _or("scripting"), _json(2, "json"), _or("other"))),
            "language": (lambda: Y.classify_path(s())["language"], _class("'markdown'", "'markdown'", "'mcfunction'", "'markdown'", "'typescript'", "'javascript'", "'json'", "'text'")),
            "lifecycle": (lambda: Y.classify_path(s())["lifecycle"], _class("'active'", "'historical'", *["'active'"] * 6)),
        },
    ),
    "category_for_source": _inline(
        ["script_api", "documentation", "commands", "json"],
        {
            f"from_{n}": (
                lambda n=n: Y.category_for_source(s(), F.lit(n), F.lit("preview" if n.endswith("p") else "stable")),
                f"CASE WHEN s = 'script_api' THEN '{'script_api_beta' if n.endswith('p') else 'script_api_stable'}' WHEN s IN ('documentation', 'scripting', 'json', 'other') THEN {repr(v) if v else 's'} ELSE s END",
            )
            for n, v in (("my_editor_x", "editor"), ("json_schema_p", "schemas"), ("plain", ""))
        },
    ),
    "stability_from_text": _over(
        "chunks", ["chunk_id"], {"label": (lambda: Y.stability_from_text(F.col("content")), "CASE WHEN contains(lower(content), 'pre-release') OR contains(lower(content), 'experimental') THEN 'experimental' WHEN contains(lower(content), 'beta') THEN 'beta' WHEN contains(lower(content), 'internal') THEN 'internal' ELSE 'stable' END")}
    ),
    "lifecycle_from_text": _over(
        "chunks", ["chunk_id"], {"label": (lambda: Y.lifecycle_from_text(F.col("content"), F.col("doc_id") % 9 == 0), "CASE WHEN doc_id % 9 = 0 THEN 'historical' WHEN contains(lower(content), 'deprecated') THEN 'deprecated' WHEN contains(lower(content), 'removed') THEN 'removed' ELSE 'active' END")}
    ),
    "strip_md": _inline(["## **Title** `x`", "plain", "# a # b", "####   deep `code` **bold**  "], {"clean": (lambda: X.strip_md(s()), "trim(replace(replace(regexp_replace(s, '^#+\\s*', ''), '**', ''), '`', ''))")}),
    "json_pointer_escape": _inline(["a/b~c", "plain", "~1/~0", "//"], {"escaped": (lambda: X.json_pointer_escape(s()), "replace(replace(s, '~', '~0'), '/', '~1')")}),
    "json_get": _over("events", ["event_id"], {"k": (lambda: F.get_json_object("props", "$.k"), "json_extract_string(props, '$.k')")}),
    "package_from_path": _joined("concat(w, '/', s)")(
        PATHS + ["x/ScriptAPI/minecraft/server-ui/A.md", "x/PriorScriptAPI/minecraft/server-net-12xx/A.md", "x/ScriptAPI/demo/core/World.md"],
        {"module": (lambda: Y.package_from_path(s()), "CASE WHEN s LIKE '%ScriptAPI/minecraft/_%' THEN '@minecraft/' || regexp_replace(regexp_extract(s, 'ScriptAPI/minecraft/([^/]+)', 1), '-[0-9]+xx$', '', 'i') ELSE '@minecraft/server' END")},
    ),
    "symbol_labels": _joined("concat(w, ' ', s)")(
        ["Properties", "Methods", "World Class", "module.Player Interface", "Events list", "GameMode Enum", "Other"],
        {
            "kind": (lambda: Y.symbol_kind_for_group(s()), "CASE WHEN contains(lower(s), 'propert') THEN 'property' WHEN contains(lower(s), 'method') THEN 'method' WHEN contains(lower(s), 'event') THEN 'event' WHEN contains(lower(s), 'enum') THEN 'enum' ELSE 'unknown' END"),
            "name": (lambda: Y.class_name_from_title(s()), "trim(regexp_replace(regexp_replace(s, '(?i)\\s+(Class|Interface|Enum)\\s*$', ''), '^.*\\.', ''))"),
            "document": (lambda: Y.document_symbol_kind(s()), "CASE WHEN regexp_matches(s, '(?i)\\bInterface\\b') THEN 'interface' WHEN regexp_matches(s, '(?i)\\bEnum\\b') THEN 'enum' ELSE 'class' END"),
        },
    ),
    "sha256_text": _over("documents", ["doc_id"], {"hash": (lambda: X.sha256_text(F.col("text")), "'sha256:' || sha256(text)")}),
    "stable_public_id": _over("documents", ["doc_id"], {"public_id": (lambda: X.stable_public_id("doc", F.col("source_id"), F.col("path")), "'doc_' || substr(sha256(concat(source_id, chr(0), path)), 1, 24)")}),
    "canonical_config_hash": _fixed(['{"b":1,"a":"x"}', '{"a":"x","b":1}', '{"z":[1,2],"k":{"d":1,"c":2}}'], {"hash": (lambda: X.canonical_config_hash(s()), "sha256(CASE sid WHEN 2 THEN '{\"k\":{\"c\":2,\"d\":1},\"z\":[1,2]}' ELSE '{\"a\":\"x\",\"b\":1}' END)")}),
    "member_parts": _joined("concat(w, '.', s)")(
        ["World.afterEvents", "a.b.c", "single", ".x", "x."],
        {"owner": (lambda: X.member_owner(s()), "CASE WHEN regexp_matches(s, '^.+\\..+$') THEN regexp_extract(s, '^(.+)\\.([^.]+)$', 1) END"), "leaf": (lambda: X.member_leaf(s()), "CASE WHEN regexp_matches(s, '^.+\\..+$') THEN regexp_extract(s, '^(.+)\\.([^.]+)$', 2) END")},
    ),
    "iso_compact": _over("events", ["event_id"], {"stamp": (lambda: X.iso_compact(F.col("ts")), "strftime(ts, '%Y%m%dT%H%M%SZ')")}),
    "round_n": _over("events", ["event_id"], {"r2": (lambda: X.round_n(F.col("value").cast("decimal(20,8)"), 2).cast("double"), "round(value::DECIMAL(20,8), 2)::DOUBLE")}),
    "dcg_gain": _over("events", ["event_id"], {"points": (lambda: F.round(X.gain(F.col("user_id") % 4, F.col("event_id") % 9 + 1), 6), "round((pow(2.0, user_id % 4) - 1) / log2(event_id % 9 + 2), 6)")}),
    "sanitize_error": _inline(
        ["failed: SELECT a FROM b WHERE c", "cannot clone https://u:p@host/x.git", "ok"],
        {"message": (lambda: X.sanitize_error(s()), "substr(regexp_replace(regexp_replace(s, '(?is)\\b(?:SELECT|INSERT|UPDATE|DELETE|PRAGMA)\\b.*', '[redacted SQL]'), '//[^/@\\s]+@', '//', 'g'), 1, 500)")},
    ),
    "signature_type": _joined("concat(w, ' ', s)")(
        ["readonly afterEvents: WorldAfterEvents;", "name: string", "other: Foo", "xafterEvents: Bar"], {"found": (lambda: X.signature_type(s(), F.lit("afterEvents")), "nullif(regexp_extract(s, '\\bafterEvents\\b\\s*:\\s*([A-Z][A-Za-z0-9]*)', 1), '')")}
    ),
    "tokenize_unicode61": _over("chunks", ["chunk_id"], {"tokens": (lambda: _join(X.fts_tokens(F.col("content"))), "array_to_string(regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+'), '|')")}),
    "filter_glob": _joined("concat(w, '/', s)")(
        PATHS, {"selected": (lambda: Y.path_selected(s(), ["**/*.md", "**/*.json", "*.txt"], ["**/manifest*", "x/Prior*/**"]), "(regexp_matches(s, '^.*/[^/]*\\.md$') OR regexp_matches(s, '^.*/[^/]*\\.json$') OR regexp_matches(s, '^[^/]*\\.txt$')) AND NOT (regexp_matches(s, '^.*/manifest[^/]*$') OR regexp_matches(s, '^x/Prior[^/]*/.*$'))")}
    ),
    "safe_git_branch": _joined("concat(s, '/', w)")(
        ["main", "feature/x", "-bad", "a..b", "a//b", "x.lock", "refs/.hid", "ok_1.2-3", "end/", "a@{b"],
        {
            "branch": (lambda: Y.safe_branch(s()), "length(s) BETWEEN 1 AND 200 AND regexp_matches(s, '^[A-Za-z0-9][A-Za-z0-9._/-]*$') AND NOT regexp_matches(s, '[./]$|\\.\\.|//|/\\.|\\.lock(/|$)')"),
            "sparse": (lambda: Y.safe_sparse_path(s()), "length(s) BETWEEN 1 AND 300 AND regexp_matches(s, '^[A-Za-z0-9._/-]+$') AND NOT regexp_matches(s, '^[-/]|/$|//|(^|/)\\.\\.?(/|$)')"),
        },
    ),
    "id_predicate": _inline(
        ["doc_0123456789abcdef01234567", " chk_0123456789abcdef01234567 ", "doc_XYZ", "", "chk_0123"], {"route": (lambda: Y.id_kind(s()), "CASE WHEN regexp_matches(trim(s), '^chk_[a-f0-9]{24}$') THEN 'chunk' WHEN regexp_matches(trim(s), '^doc_[a-f0-9]{24}$') THEN 'document' ELSE 'invalid' END")}
    ),
    "validate_checkout": _inline(
        ["https://GitHub.com/Org/Repo.git", "git@github.com:Org/Repo.git", "ssh://git@github.com/org/repo/", "https://github.com/org/other", "local"],
        {"same": (lambda: Y.repository_identity(s()) == F.lit("github.com/org/repo"), "regexp_matches(lower(s), '^(https://|git@|ssh://git@)github\\.com[:/]org/repo(\\.git)?/?$')")},
    ),
    "provenance_urls": _joined("concat(w, '/', s)")(
        ["docs/a b.md", "ünï/x.md", "p/(1)!.md"],
        {"url": (lambda: Y.blob_url(F.lit("https://example.org/o/r.git"), F.lit("feature/x"), s()), "'https://example.org/o/r/blob/' || replace(url_encode('feature/x'), '+', '%20') || '/' || replace(replace(replace(replace(replace(url_encode(s), '%2F', '/'), '+', '%20'), '%21', '!'), '%28', '('), '%29', ')')")},
    ),
}
