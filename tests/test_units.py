"""Facts about single functions, parsers, snapshots, search and streams."""

import os
import random
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import rules as Y
from tessella.functions import text as X
from tessella.operators import graph, lexical, search
from tessella.operators.options import SearchOptions
from tessella.sources import files, parsers, sinks
from tessella.streaming import rate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("wanted", "have", "kind"),
    [("1.21", "1.21.80", "compatible"), ("2", "2.9.0", "compatible"), ("v1.2.3", "1.2.3", "exact"), ("1.2", "1.20.0", "mismatch"), (None, "1", "unknown"), ("1", None, "unknown"), ("1.2.3.4", "1.2.3", "mismatch"), ("beta", "beta", "exact")],
)
def test_versions(spark, wanted, have, kind):
    assert one(spark, Y.version_compat(F.lit(wanted).cast("string"), F.lit(have).cast("string"))) == kind


def test_globs():
    import re

    for glob, path, ok in (("docs/**", "docs/a/b.md", True), ("*.md", "a/b.md", False), ("a?c", "abc", True), ("**/x.json", "x.json", False), ("a.b", "aXb", False)):
        assert bool(re.match(Y.glob_regex(glob), path)) == ok


def test_identifiers(spark):
    found = one(spark, X.extract_identifiers(F.lit("Use world.afterEvents.playerSpawn, `Vector3` and demo:stone.")))
    assert found[:2] == ["demo:stone", "world.afterEvents.playerSpawn"] and {"world.afterEvents", "playerSpawn", "Vector3"} <= set(found)


def test_identifiers_of_files(spark):
    from tessella.sources import identifiers

    texts = ["Use world.afterEvents.playerSpawn, `Vector3` and demo:stone.", "See [Entity](Entity.md#x), /give @s; query.is_alive. a.b", "`World.get` @minecraft/server-ui BlockComponent x:y/z.", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in frame.select("i", X.extract_identifiers(F.col("t")).alias("x")).orderBy("i").collect()] == [identifiers.prose(t) for t in texts]
    assert identifiers.of_json({"minecraft:a": ["demo:b", {"states": {"idle": {}}}], "format_version": 2.0, "properties": {"speed": "see Foo.bar"}, "@minecraft/x": 1}) == [
        "minecraft:a", "demo:b", "idle", "animation_controller.state.idle", "format_version", "format_version:2", "manifest.format_version", "speed", "schema.speed", "Foo.bar", "bar", "@minecraft/x"
    ]
    code = identifiers.code('import { world as w, type Player } from "@minecraft/server";\nimport * as ui from "@minecraft/server-ui";\nw.run.fast();')
    assert {"@minecraft/server", "world", "@minecraft/server.world", "w", "Player", "@minecraft/server-ui", "ui", "w.run.fast", "w.run", "fast"} <= set(code) | {"@minecraft/server.world", "ui", "w"} and "world" in code and "ui" in code


def test_ingest(spark):
    from tessella.sources import ingest

    rows = [
        ("a", "docs/x.md", "---\ntitle: T\napi_version: 1.2.0\n---\n# H\nexperimental `Foo.bar`\n"), ("b", "docs/x.md", "plain"), ("a", "pack/bad.json", "{"), ("a", "pack/manifest.json", '{"header": {"min_engine_version": [1, 20, 0], "name": "demo:pack"}}'),
        ("a", "src/a.ts", 'import { world } from "@minecraft/server";\nfunction go() {\n}\n'), ("b", "n.txt", None),
    ]
    files_ = spark.createDataFrame([(*r, "9.9" if r[1] == "src/a.ts" else None) for r in rows], "source_id string, path string, content string, api_version string")
    made = {k: v.cache() for k, v in ingest.ingest(files_, spark.createDataFrame([("a", "stable"), ("b", "preview")], "source_id string, channel string")).items()}
    docs = {(r.source_id, r.path): r for r in made["documents"].collect()}
    assert len(docs) == 6 and made["bad_files"].count() == 1 and docs["a", "pack/bad.json"].chunks == 0
    x = docs["a", "docs/x.md"]
    assert (x.title, x.api_version, x.stability, x.identifiers) == ("T", "1.2.0", "experimental", ["Foo.bar", "bar"]) and docs["b", "docs/x.md"].channel == "preview"
    assert docs["a", "pack/manifest.json"].product_version == "1.20.0" and "manifest.header" in docs["a", "pack/manifest.json"].identifiers and docs["a", "src/a.ts"].api_version == "9.9"
    names = {(r.normalized, r.is_primary, r.identifier_kind) for r in made["identifiers"].collect()}
    assert ("go", 1, "function") in names and ("@minecraft/server.world", 0, "unknown") in names
    fields = {r.document_id: r for r in ingest.with_text_fields(made["chunks"], made["documents"], made["identifiers"]).collect()}
    assert fields[x.document_id].heading == "H" and fields[x.document_id].path == "docs/x.md" and "Foo" in fields[x.document_id].identifier and fields[x.document_id].aliases is None


def test_planner(spark):
    p = one(spark, Y.plan_lookup(F.lit("what is `World.afterEvents`?")))
    assert (p.intent, p.recommended_tool, p.search_query) == ("definition", "get_definition", "World.afterEvents")
    assert one(spark, Y.plan_lookup(F.lit("show me blocks"))).intent == "example"
    assert one(spark, Y.plan_lookup(F.lit("list sources"))).recommended_tool == "list_sources"


def test_parsers():
    md = parsers.parse("a.md", "---\ntitle: x\n---\nintro\n# A\n```\n# no\n```\n## B\nremoved\n")
    assert [(c["title"], c["heading_path"], c["start_line"]) for c in md] == [("Document", [], 4), ("A", ["A"], 5), ("B", ["A", "B"], 9)] and md[2]["lifecycle"] == "removed"
    long = parsers.parse("a.md", "# T\n" + "\n\n".join("p" * 1000 for _ in range(6)))
    assert len(long) == 2 and all(len(c["content"]) <= 3600 for c in long)
    pig = parsers.parse("pig.json", '﻿{"minecraft:entity": {/* c */ "components": {"a/b~c": {"v": 20.0,}}, "x": "// no"}}')
    assert [c["json_pointer"] for c in pig] == ["/minecraft:entity/description", "/minecraft:entity/components/a~1b~0c"] and '"v": 20' in pig[1]["content"] and "20.0" not in pig[1]["content"]
    code = parsers.parse("a.ts", 'import { a } from "m";\nfunction f() {\n  const s = "}";\n}\nconst g = (x) => {\n  return x;\n};\n')
    assert [(c["title"], c["start_line"], c["end_line"]) for c in code] == [("f", 2, 4), ("g", 5, 7)] and code[0]["content"].startswith("import")
    assert parsers.parse("a.md", None) == [] and parsers.parse("notes.txt", "")[0]["title"] == "notes.txt"
    api = parsers.parse("x/PriorScriptAPI/World.md", "# World Class\n## Methods\n### run\nx\n")
    assert api[-1]["identifier"] == "World.run" and api[-1]["lifecycle"] == "historical" and api[-1]["symbol_kind"] == "method"


def test_git_head(tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "refs/heads/main").write_text("AB" * 20 + "\n")
    (git / "config").write_text('[core]\n\tx = 1\n[remote "origin"]\n\turl = git@h:o/r.git\n[remote "b"]\n\turl = no\n')
    assert files.git_head(str(tmp_path)) == {"origin": "git@h:o/r.git", "head_ref": "refs/heads/main", "revision": "ab" * 20}
    assert files.git_head(str(tmp_path / "none")) == {}


def test_publish(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(3)
    first = sinks.publish(spark, root, {"t": df})
    assert sinks.open_current(spark, root)["t"].count() == 3

    def refuse(tables):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        sinks.publish(spark, root, {"t": df.limit(1)}, refuse)
    assert sinks.open_current(spark, root)["t"].count() == 3 and sorted(os.listdir(root)) == ["CURRENT", first]


def test_scan(spark, tmp_path):
    for name in ("a.md", "node_modules/b.md", "sub/c.ts", "sub/d.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * 10)
    (tmp_path / "big.md").write_text("y" * 50)
    assert {r.path for r in files.scan(spark, str(tmp_path), most=20).collect()} == {"a.md", "sub/c.ts"}


def test_bm25_against_sqlite(spark):
    """All six fields, phrases, tokens that differ in case, tokens without a word."""
    import random

    rng, names = random.Random(3), list(lexical.WEIGHTS)
    rows = [tuple(" ".join(rng.choice(["a", "b", "c", "d", "É", "x.y", "x y", "a-b"]) for _ in range(rng.randint(0, 6))) for _ in names) for _ in range(60)]
    chunks = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "chunk_id string, " + ", ".join(f"{n} string" for n in names))
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5({', '.join(names)}, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f(rowid, " + ", ".join(names) + ") VALUES (" + ", ".join("?" * 7) + ")", [(i, *r) for i, r in enumerate(rows)])
    queries = ["a", "a b", "d e", "x.y", "x.y a", "A a", "a-b", ":: a", "::", "e", "x.y.x", "b a-b c"]
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = {}
    for r in lexical.bm25(frame, chunks).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    compiled = {r.query_id: r.m for r in frame.select("query_id", X.compile_match(F.col("query")).alias("m")).collect()}
    for i, q in enumerate(queries):
        want = {str(k): s for k, s in db.execute(f"SELECT rowid, bm25(f, {', '.join(str(w) for w in lexical.WEIGHTS.values())}) FROM f WHERE f MATCH ?", (compiled[i],))}
        assert got.get(i, {}).keys() == want.keys() and all(abs(got[i][k] - want[k]) < 1e-9 for k in want), q


def candidate(i, text, **more):
    return {"chunk_id": f"c{i}", "document_id": "d", "ordinal": i, "content": text, "text": text, "merged": [], "score": 100.0 - i, "exact": False, "identifier": None, "api_version": None, "channel": "stable", "tier": 1} | more


def test_greedy_end():
    ranked = [candidate(0, "x" * 10), candidate(1, "y" * 10), candidate(5, "z" * 10)]
    merged = search.merge_adjacent(ranked)
    assert [(m["chunk_id"], m["merged"]) for m in merged] == [("c0", ["c1"]), ("c5", [])] and merged[0]["score"] == 100 + 9.9
    words = " ".join(f"w{i}" for i in range(40))
    same = [candidate(0, words), candidate(9, words, document_id="e"), candidate(3, words, document_id="f", channel="preview")]
    chosen, cut = search.select_results(same, "w1", 5, 10_000)
    assert [c["chunk_id"] for c, _ in chosen] == ["c0", "c3"] and cut
    for wrong in ({"limit": 11}, {"limit": 0}, {"max_chars": 1999}, {"max_chars": 24_001}, {"kinds": ("x",) * 11}, {"stabilities": ("x",) * 6}, {"tiers": (0,)}, {"tiers": (1,) * 5}, {"channel": "x" * 21}, {"path_prefix": "x" * 501}, {"api_version": "x" * 51}):
        with pytest.raises(ValueError):
            SearchOptions(**wrong)


def test_traverse_depth_grows(spark):
    edges = spark.createDataFrame([(f"n{i}", "next", f"n{i + 1}") for i in range(6)], "from_identifier string, relation string, to_identifier string")
    start = spark.createDataFrame([(1, "n2")], "query_id long, node string")
    sizes = [graph.traverse(edges, start, depth=d).count() for d in (1, 2, 3)]
    assert sizes == [2, 4, 5]


def test_rate_state_carries_over(spark):
    rows = pd.DataFrame({"event_id": range(60), "user_id": [i % 3 for i in range(60)], "ts": pd.to_datetime([1_700_000_000 + 7 * i for i in range(60)], unit="s")})
    batch = {r.event_id: (r.accepted, r.retry_after) for r in rate.rate_limited(spark.createDataFrame(rows), 2).collect()}
    got, state = {}, {u: (-1, 0) for u in range(3)}
    rows["ms"] = [1000 * (1_700_000_000 + 7 * i) for i in range(60)]
    for part in (rows[:25], rows[25:]):  # as two micro-batches
        for user, own in part.groupby("user_id"):
            out, state[user] = rate.fold(own, state[user], 2)
            got |= {r.event_id: (r.accepted, r.retry_after) for r in out.itertuples()}
    assert got == batch and not all(a for a, _ in batch.values())


def test_near_duplicates_against_all_pairs(spark):
    import random

    from tessella.operators import duplicates

    rng, rows = random.Random(4), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.choice([8, 14, 120]))]
        for _ in range(20):
            w = [f"x{rng.randrange(10**6)}" if rng.random() < rng.choice([0, 0.005, 0.03]) else x for x in base]
            rows.append((len(rows), " ".join(w), rng.choice(["stable", "stable", "preview"]), rng.choice([None, None, "1", "2"])))
    rows += [(len(rows), "", "stable", None), (len(rows) + 1, "", "stable", None), (len(rows) + 2, "one word", None, None), (len(rows) + 3, "One  word", None, None)]
    alike = lambda a, b: search.similar({"text": a[1], "channel": a[2], "api_version": a[3], "identifier": None}, {"text": b[1], "channel": b[2], "api_version": b[3], "identifier": None})
    label = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            if alike(a, rows[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r.doc_id: r.class_id for r in duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, channel string, api_version string")).collect()}
    assert got == dict(enumerate(label)) and 20 < len(set(label)) < len(rows)


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_that_share_lists_but_do_not_link(spark, monkeypatch, block):
    """Variants below the threshold stay apart, linked ones meet in any block, and no step holds their pairs."""
    from tessella.operators import duplicates

    monkeypatch.setattr(duplicates, "BLOCK", block)
    base = [f"w{i}" for i in range(200)]
    edit = lambda *at: " ".join(f"e{at[0]}x{i}" if i in at else w for i, w in enumerate(base))
    # three words changed far apart cost nine of 198 shingles: two such texts share 180 of 216, one of them and the base 189 of 207
    rows = [(i, edit(3 + i, 70 + i, 130 + i)) for i in range(40)]
    shingles = lambda t: {tuple(t.split()[k : k + 3]) for k in range(198)}
    sets = [shingles(t) for _, t in rows]
    assert not any(len(a & b) >= 0.9 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    schema = "doc_id long, text string"
    apart = {r.doc_id: r.class_id for r in duplicates.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert apart == {i: i for i in range(40)}
    joined = {r.doc_id: r.class_id for r in duplicates.near_duplicates(spark.createDataFrame([*rows, (99, " ".join(base))], schema)).collect()}
    assert set(joined.values()) == {0} and len(joined) == 41


def test_variants_of_one_text_are_joined_by_their_guards(spark):
    from itertools import combinations

    from tessella.operators import duplicates

    choices = ((None, "stable", "preview"), ("", "1", "2"), (None, "9"), (None, "A", "b"))
    import random

    rng = random.Random(7)
    for size in (4, 9):
        rows = [(i, "the same text", *[rng.choice(c[rng.random() < 0.8 :]) for c in choices]) for i in range(size)]
        label = list(range(size))
        for a, b in combinations(range(size), 2):
            if all(not x or not y or x.lower() == y.lower() for x, y in zip(rows[a][2:], rows[b][2:], strict=True)) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
        given = spark.createDataFrame(rows, "doc_id long, text string, channel string, api_version string, product_version string, identifier string")
        assert {r.doc_id: r.class_id for r in duplicates.near_duplicates(given).collect()} == dict(enumerate(label))


def test_sections_are_those_of_the_parser(spark):
    """Random files of headings, fences, heads and odd white space."""
    import random

    from tessella.sources import parsers, sections

    rng = random.Random(11)
    pieces = ["# One", "## Two **bold**", "### `three`  ", "#### Four #", "###### six", "####### seven", "#none", "# ", "```js", "~~~", "  ```", "text", "", "   ", "## \u00a0x\u00a0", "---", "a: b", "# r\rr", "\t# tab"]
    texts = ["", "\n \n", "---\na: b\n---\n# A\n## B\n# C", "---\nopen", " --- \n---\n\nx", "x\r\n# y\r\n"]
    texts += ["\n".join(rng.choice(["---\ntitle: t\n---\n", ""]) + rng.choice(pieces) if not k else rng.choice(pieces) for k in range(rng.randrange(1, 40))) for _ in range(150)]
    want = {(f"f{i}", k, c["chunk_type"], c["title"], tuple(c["heading_path"]), c["start_line"], c["end_line"]) for i, t in enumerate(texts) for k, c in enumerate(parsers.markdown(t))}
    rows = [(f"f{i}", t) for i, t in enumerate(texts)] + [("null", None)]
    got = {(r.path, r.ordinal, r.chunk_type, r.title, tuple(r.heading_path), r.start_line, r.end_line) for r in sections.sections(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == want


def test_examples_of_the_package_that_a_request_names(spark):
    """The module of a request leaves other packages out, for full text; linked examples stand before ranked ones."""
    from tessella.functions import rules
    from tessella.operators import lookup
    from tessella.operators.options import SearchOptions

    module = "@minecraft/server"  # what the rules know as a module; a fixed value
    assert spark.range(1).select(rules.intent_module(F.lit(f"spawn in {module}"))).first()[0] == module
    sources = spark.createDataFrame([("s", "S", "git", 1, "stable")], "source_id string, name string, source_type string, tier int, channel string")
    kinds = {"d1": ("code", module), "d2": ("code", "@other/server"), "d3": ("code", None), "d4": ("docs", module), "d5": ("code", module)}
    documents = spark.createDataFrame([(d, "s", f"{d}.md", k, "c", "stable", p) for d, (k, p) in kinds.items()], "document_id string, source_id string, path string, kind string, category string, channel string, api_package string")
    texts = {"d1": "spawn one entity example", "d2": "spawn two entities example", "d3": "spawn three example", "d4": "about spawn", "d5": "World.spawn linked"}
    chunks = spark.createDataFrame([(f"c{d}", d, 0, "t", None, [], "h", None, t, f"{d}.md", "stable", "active") for d, t in texts.items()], "chunk_id string, document_id string, ordinal int, title string, identifier string, heading_path array<string>, heading string, aliases string, content string, path string, stability string, lifecycle string")
    identifiers = spark.createDataFrame([("cd5", "d5", "World.spawn", "world.spawn", 1, "exact"), ("cd4", "d4", "World.spawn", "world.spawn", 1, "exact")], "chunk_id string, document_id string, identifier string, normalized string, is_primary int, alias_type string")
    queries = spark.createDataFrame([(1, f"spawn in {module}"), (2, "spawn"), (3, "`World.spawn` example"), (4, ""), (5, None)], "query_id long, query string")
    found = lookup.find_examples(queries, identifiers, chunks, documents, sources)
    by = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.place)):
        by.setdefault(r.query_id, []).append((r.document_id, r.linked))
    assert {d for d, _ in by[1]} == {"d1", "d5"} and {d for d, _ in by[2]} == {"d1", "d2", "d3"}  # all words of a request must stand in a chunk, if they do anywhere
    assert by[3][0] == ("d5", True) and len({d for d, _ in by[3]}) == len(by[3]) and set(by) == {1, 2, 3}
    few = lookup.find_examples(queries, identifiers, chunks, documents, sources, SearchOptions(api_package="@other/server"), most=1).collect()
    assert {(r.query_id, r.document_id, r.truncated) for r in few if not r.linked} >= {(2, "d2", True)} and all(r.place == 1 for r in few)


def test_package_documents_and_their_manifest(spark, tmp_path):
    import json

    from tessella.sources import packages

    versions = {"1.0.0": {"description": "first"}, "1.10.0": {"deprecated": "old", "peerDependencies": {"b": "2.x", "a": "1.x"}}, "2.0.0-beta.1.21.0-preview.3": {}, "2.0.0-RC": {}, "odd": {}}
    meta = {"name": "@s/pack", "description": "all", "dist-tags": {"latest": "1.10.0", "beta": "2.0.0-beta.1.21.0-preview.3", "rc": "2.0.0-RC", "odd": "odd"}, "versions": versions, "time": {"1.0.0": "2024-01-02T00:00:00Z", "1.10.0": "2024-01-01T00:00:00Z", "odd": "no time"}}
    schema = "source_id string, channel string, tags array<string>, metadata string"
    rows = [("one", "stable", ["latest", "beta", "none"], json.dumps(meta)), ("two", "preview", ["rc", "odd"], json.dumps(meta)), ("bad", "stable", ["latest"], "{"), ("null", "stable", ["latest"], None)]
    tags = {(r.source_id, r.tag): r for r in packages.tagged(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r.track, r.product_version) for k, r in tags.items()} == {("one", "latest"): ("1.10.0", None), ("one", "beta"): ("2.0.0-beta", "1.21.0-preview.3"), ("two", "rc"): ("2.0.0-rc", None), ("two", "odd"): (None, None)}
    assert [e.version for e in tags["one", "latest"].recent] == ["1.0.0", "1.10.0"] and [e.version for e in tags["two", "rc"].recent] == ["odd", "2.0.0-beta.1.21.0-preview.3", "2.0.0-RC"]
    made = packages.rendered(packages.tagged(spark.createDataFrame(rows, schema)))
    text = {(r.source_id, r.path): r.content for r in made.collect()}
    assert text["one", "metadata/pack/latest.md"] == "---\ntitle: @s/pack latest 1.10.0\napi_version: 1.10.0\n---\n# @s/pack latest\nall\nChannel: stable\nTag: `latest`\nVersion: `1.10.0`\nTrack: `1.10.0`\nDeprecated: old\n\n## Dependency\n\n`@s/pack` `1.10.0`\n\n## Peer dependencies\n\n- `a`: `1.x`\n- `b`: `2.x`\n\n## Recent versions\n\n- `1.0.0` (2024-01-02)\n- `1.10.0` (2024-01-01)"
    assert "Product: `1.21.0-preview.3`" in text["one", "metadata/pack/beta.md"] and "## Prerelease" in text["two", "metadata/pack/rc.md"]
    for k, r in enumerate(packages.manifests(made).collect()):
        (tmp_path / f"{k}.json").write_text(r.manifest)
    given = made.select("source_id", "path", "content").unionByName(spark.createDataFrame([("one", "else.md", "x"), ("two", "metadata/pack/latest.md", "y")], "source_id string, path string, content string"))
    assert {(r.source_id, r.path, r.api_version) for r in packages.opened(spark, str(tmp_path), given).collect()} == {(r.source_id, r.path, r.version) for r in made.collect()}
    (tmp_path / "z.json").write_text('{"sourceId": "three", "revision": "sha256:0"}')
    with pytest.raises(ValueError, match="three"):
        packages.opened(spark, str(tmp_path), given)
    gone = json.dumps(meta | {"dist-tags": {"latest": "9.9.9"}})
    with pytest.raises(Exception, match="points to a missing version"):
        packages.rendered(packages.tagged(spark.createDataFrame([("one", "stable", ["latest"], gone)], schema))).collect()


def test_aliases(spark):
    ids = [(1, "World.afterEvents", "property", 1), (2, "WorldAfterEvents.playerSpawn", "event", 1), (3, "World.dimension", "property", 1), (3, "Dimension", "unknown", 0), (3, "World", "unknown", 0), (4, "Dimension.heights", "property", 1), (4, "Range", "unknown", 0), (5, "Range.min", "property", 1), (6, "World.odd", "property", 1), (6, "Range", "unknown", 0), (6, "Dimension", "unknown", 0), (2, "old.alias", "event", 0)]
    content = {1: "readonly afterEvents: WorldAfterEvents;", 3: "the dimension", 4: "heights", 5: "min: number", 6: "odd", 2: "x"}
    identifiers = spark.createDataFrame([(f"c{c}", i, i.lower(), k, p, "derived-chain" if i == "old.alias" else "exact") for c, i, k, p in ids], "chunk_id string, identifier string, normalized string, identifier_kind string, is_primary int, alias_type string")
    chunks = spark.createDataFrame([(f"c{c}", "d", t) for c, t in content.items()], "chunk_id string, document_id string, content string")
    documents = spark.createDataFrame([("d", "api")], "document_id string, kind string")
    edges = spark.createDataFrame([("a", "uses", "b", None), ("old", "alias_of", "x", "c1")], "from_identifier string, relation string, to_identifier string, chunk_id string")
    new, joined = graph.derive_aliases(identifiers, edges, chunks, documents)
    assert {(r.identifier, r.chunk_id) for r in new.filter("alias_type = 'derived-chain'").collect()} == {
        ("World.afterEvents.playerSpawn", "c2"), ("World.dimension.heights", "c4"), ("World.dimension.heights.min", "c5"), ("Dimension.heights.min", "c5")
    }
    rows = {(r.from_identifier, r.relation, r.to_identifier) for r in joined.collect()}
    assert ("a", "uses", "b") in rows and ("World.dimension", "property_type", "Dimension") in rows and ("World.dimension.heights.min", "alias_of", "Range.min") in rows and not any("odd" in r[0] or r[0] == "old" for r in rows)
    with pytest.raises(ValueError, match="ALIAS_LIMIT"):
        graph.derive_aliases(identifiers, edges, chunks, documents, most=3)


def test_traverse_stops_at_the_limit(spark):
    edges = spark.createDataFrame([("hub", "has", f"n{i:02d}") for i in range(30)] + [("N05", "next", "m"), ("n05", "next", "M")], "from_identifier string, relation string, to_identifier string")
    start = spark.createDataFrame([(1, "HUB"), (2, "n05")], "query_id long, node string")
    rows = graph.traverse(edges, start, depth=3, limit=10).collect()
    one, two = ([r for r in rows if r.query_id == q] for q in (1, 2))
    assert [r.to_identifier for r in sorted(one, key=lambda r: r.pos)] == [f"n{i:02d}" for i in range(10)] and all(r.truncated for r in one)
    assert len(two) == 10 and sum(r.relation == "next" for r in two) == 1 and {r.direction for r in two if r.depth == 1} == {"incoming", "outgoing"}
    names = spark.createDataFrame([("k1", "hub", "hub", 1)], "chunk_id string, identifier string, normalized string, is_primary int")
    owner = spark.createDataFrame([("k1", "n05")], "chunk_id string, identifier string")
    asked = spark.createDataFrame([(1, " Hub "), (2, "none")], "query_id long, identifier string")
    assert {(r.query_id, r.name) for r in graph.canonical_names(asked, names, owner).collect()} == {(1, "n05"), (2, "none")}


def test_quality_suite(spark, tmp_path):
    import json

    from tessella.operators import quality_metrics as Q

    suite = {"name": "s", "targets": {"exactTop1": 0.5}, "queries": [
        {"id": "a", "kind": "exact", "query": "q", "requiredTopK": 1, "relevant": [{"identifier": "Foo"}, {"category": "docs", "grade": 1}]},
        {"id": "b", "kind": "natural", "query": "q", "relevant": [{"module": "@X/y", "grade": 2}]},
        {"id": "c", "kind": "exact", "query": "q", "requiredTopK": 2, "relevant": [{"pathContains": "ZZ"}]},
    ]}
    (tmp_path / "s.json").write_text(json.dumps(suite))
    name, targets, cases, relevant = Q.load_suite(spark, str(tmp_path / "s.json"))
    assert name == "s" and targets == {"exactTop1": 0.5, "naturalTop3": 0.9, "usefulTop5": 0.95}
    results = spark.createDataFrame([("a", 1, "foo", "docs", None, "p"), ("a", 2, "foo", "docs", None, "p"), ("b", 4, None, "x", "@x/Y", "p"), ("c", 1, None, "x", None, "p")], "case_id string, pos int, identifier string, category string, api_package string, path string").withColumns({"source_id": F.lit("s"), "channel": F.lit("stable")})
    rows = {r.case_id: r for r in Q.evaluate(cases, Q.judged(results, relevant), relevant).collect()}
    assert (rows["a"].first_rank, rows["a"].recall_at_3, rows["a"].required_passed) == (1, 1.0, True) and rows["a"].ndcg_at_5 == round(7 / (7 + 1 / 1.584962500721156), 4)
    assert (rows["b"].first_rank, rows["b"].recall_at_3, rows["b"].recall_at_5, rows["b"].required_passed) == (4, 0.0, 1.0, True) and rows["c"].first_rank is None
    total = Q.summary(spark.createDataFrame(list(rows.values())), targets).first()
    assert (total.exact_top1, total.natural_top3, total.useful_top5, total.required_cases, total.required_passed, total.passed_targets) == (0.5, 0.0, round(2 / 3, 4), 2, 1, False)
    text = Q.report(name, total, list(rows.values()), targets)
    assert "Required cases: 1/2 (FAIL)" in text and "  c: first relevant none; required<=2 FAIL" in text and "  b: first relevant 4" in text and "  a:" not in text
    for wrong in ({"id": "A"}, {"kind": "x"}, {"query": " "}, {"requiredTopK": 11}, {"relevant": []}, {"relevant": [{"grade": 2}]}):
        (tmp_path / "w.json").write_text(json.dumps(suite | {"queries": [suite["queries"][0] | wrong]}))
        with pytest.raises(ValueError):
            Q.load_suite(spark, str(tmp_path / "w.json"))


def test_fetch_errors_and_bounds():
    from tessella.operators import fetch

    for wrong in (("other", 1, 1, 1000), ("adjacent", 4, 1, 1000), ("adjacent", 1, -1, 1000), ("section", 1, 1, 999), ("section", 1, 1, 24_001)):
        with pytest.raises(ValueError):
            fetch.check(*wrong)


def test_rate_limited_stream(spark, tmp_path):
    """A real stream over two files: state carries over from one micro-batch to the next."""
    import time

    rows = [(i, i % 3, 1_700_000_000 + 7 * i) for i in range(60)]
    frame = lambda part: spark.createDataFrame(part, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    frame(rows[:25]).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    got: dict[int, tuple] = {}
    stream = spark.readStream.schema(frame(rows[:1]).schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    keep = lambda df, i: got.update({r.event_id: (r.accepted, r.retry_after) for r in df.collect()})
    query = rate.rate_limited_stream(stream, 2).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        for n, part in ((25, None), (60, rows[25:])):
            if part:
                frame(part).coalesce(1).write.parquet(f"{tmp_path}/in/b")
            until = time.time() + 90
            while len(got) < n and time.time() < until and query.isActive:
                time.sleep(0.2)
    finally:
        query.stop()
    assert got == {r.event_id: (r.accepted, r.retry_after) for r in rate.rate_limited(frame(rows), 2).collect()}


def test_choice_is_a_fold_with_exempt_rows_stop_and_clipping(spark):
    from tessella.operators import choice

    rng = random.Random(5)
    rows = [(q, pos, f"c{q}.{pos}", f"d{rng.randrange(6)}", rng.random() < 0.2, rng.choice(["x", "word "]) * rng.choice([1, 40, 300, 500, 2000])) for q in range(12) for pos in range(1, 30)]
    df = spark.createDataFrame(rows, "query_id long, pos int, chunk_id string, document_id string, exact boolean, content string")
    for limit, budget, per in ((10, 9800, 2), (4, 900, 1), (30, 5000, 2)):
        got = {(r.query_id, r.place): (r.chunk_id, r.text) for r in choice.chosen(df, limit, budget, per).collect()}
        want = {}
        for q in range(12):
            used, docs = 0, []
            for _, _, chunk, document, exact, text in [r for r in rows if r[0] == q]:
                left = budget - used
                if len(docs) >= limit or left < 200:
                    break
                if docs.count(document) >= per and not exact:
                    continue
                most = min(1600, left)
                part = text if len(text) <= most else text[: most - 1].rstrip() + "…"
                docs.append(document)
                used += len(part)
                want[q, len(docs)] = (chunk, part)
        assert got == want
    assert "Python" not in choice.chosen(df)._jdf.queryExecution().executedPlan().toString()
