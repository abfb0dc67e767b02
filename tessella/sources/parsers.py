"""File contents to typed chunks: Markdown, API pages, JSON and JSONC, code, plain text.

Each parser is a plain generator over one file, stateless and side-effect free;
``parse_files`` applies them to a DataFrame of (path, content) in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import identifiers
from .identifiers import _whole

SECTION_CHARS, OPEN_SPAN_LINES = 3600, 100
FIELDS = "ordinal chunk_type title heading_path content start_line end_line identifier identifiers symbol_kind language json_pointer stability lifecycle".split()
#: ``attributes`` are what a file's head says; ``error`` is why a file could not be parsed, whose row has no chunk.
SCHEMA = "path string, ordinal int, chunk_type string, title string, heading_path array<string>, content string, start_line int, end_line int, identifier string, identifiers array<string>, symbol_kind string, language string, json_pointer string, stability string, lifecycle string, attributes map<string,string>, error string"


def chunk(chunk_type: str, title: str, content: str, start: int, end: int, **more) -> dict:
    return {"chunk_type": chunk_type, "title": title, "content": content, "start_line": start, "end_line": end, "heading_path": [], "stability": "stable", "lifecycle": "active"} | more


def numbered(parts: Iterator[dict]) -> list[dict]:
    return [dict.fromkeys(FIELDS) | p | {"ordinal": i, "identifiers": named(p)} for i, p in enumerate(parts)]


def named(part: dict) -> list[str]:
    """The identifiers of a chunk: its own name, what its parser found, what its text mentions; the first of each normal form."""
    found = part.get("identifiers")
    if found is None:
        found = identifiers.code(part["content"]) if part["chunk_type"] == "code-block" else identifiers.prose(part["content"])
    own = [part["identifier"]] if part.get("identifier") else []
    return identifiers.unique([*own, *found])


def stability_of(text: str) -> str:
    low = text.lower()
    return next((label for label, marks in (("experimental", ("pre-release", "experimental")), ("beta", ("beta",)), ("internal", ("internal",))) if any(m in low for m in marks)), "stable")


def lifecycle_of(text: str) -> str:
    low = text.lower()
    return "deprecated" if "deprecated" in low else "removed" if "removed" in low else "active"


def plain_title(text: str) -> str:
    return re.sub(r"^#+\s*", "", text).replace("**", "").replace("`", "").strip()


def front_matter(text: str) -> tuple[dict[str, str], str, int]:
    """(attributes, body, line at which the body begins); an unclosed head is body."""
    text = text.replace("\r\n", "\n")
    m = re.match(r"[^\S\n]*---[^\S\n]*\n(.*?)(?:(?<=\n)|^)[^\S\n]*---[^\S\n]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text, 1
    pairs = re.findall(r"^([A-Za-z0-9_.-]+):\s*?[^\S\n]*(.*)$", m[1], re.M)
    values = [(k, v.strip()) for k, v in pairs]
    unquoted = {k: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v for k, v in values}
    return unquoted, text[m.end() :], text[: m.end()].count("\n") + 1


def fenced(lines: list[str]) -> list[bool]:
    """Whether each line lies in a code fence; the fence lines themselves count."""
    inside, out = False, []
    for line in lines:
        mark = bool(re.match(r"\s*(?:```|~~~)", line))
        out.append(inside or mark)
        inside ^= mark
    return out


def packed_paragraphs(lines: list[str], most: int) -> list[str]:
    """Paragraphs (never cut inside fences) put together up to ``most`` characters."""
    in_fence, paragraphs = fenced(lines), [[]]
    for line, kept in zip(lines, in_fence, strict=True):
        if line.strip() or kept:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    out: list[str] = []
    for text in ("\n".join(p).rstrip() for p in paragraphs if p):
        if out and len(out[-1]) + 2 + len(text) <= most:
            out[-1] += "\n\n" + text
        else:
            out.append(text)
    return out


def markdown(text: str, path: str = "") -> Iterator[dict]:
    """One chunk per heading section; long sections are cut at blank lines."""
    _, body, base = front_matter(text)
    lines = body.split("\n")
    hidden = fenced(lines)
    heads = [(i, m) for i, line in enumerate(lines) if not hidden[i] and (m := re.match(r"(#{1,6})\s+(.+?)\s*$", line))]
    stack: dict[int, str] = {}
    bounds = [(0, None), *heads]
    for k, (at, head) in enumerate(bounds):
        end = bounds[k + 1][0] if k + 1 < len(bounds) else len(lines)
        if head:
            level = len(head[1])
            stack = {d: t for d, t in stack.items() if d < level} | {level: plain_title(head[2])}
        own = lines[at:end]
        if not any(x.strip() for x in own):
            continue
        names = [stack[d] for d in sorted(stack)] if head else []
        whole = "\n".join(own).strip()
        start = base + at
        for part in [whole] if len(whole) <= SECTION_CHARS else packed_paragraphs(own, SECTION_CHARS):
            size = part.count("\n") + 1 if len(whole) > SECTION_CHARS else end - at
            yield chunk("section" if head else "document", names[-1] if names else "Document", part, start, start + size - 1, heading_path=names, language="markdown", stability=stability_of(part), lifecycle=lifecycle_of(part))
            start += size


def api_page(text: str, path: str) -> Iterator[dict]:
    """h1 names the class, h2 a group, h3 a member; experimental ranges and the path of old pages set the labels."""
    front, body, base = front_matter(text)
    lines = body.split("\n")
    title = plain_title(next((x for x in lines if re.match(r"#\s", x)), f"# {front.get('title', 'API')}"))
    owner = re.sub(r"^.*\.", "", re.sub(r"(?i)\s+(class|interface|enum)\s*$", "", title)).strip()
    kind = next((k for k in ("interface", "enum") if re.search(rf"(?i)\b{k}\b", title)), "class")
    old = "/PriorScriptAPI/" in path
    default = "unknown" if old else "stable"
    events = [(i, m) for i, line in enumerate(lines) if (m := re.match(r'\s*:::\s*(?:moniker\s+range="(?P<range>[^"]*)"|(?P<end>moniker-end))|(?P<h>###?)\s+(?P<name>.+?)\s*$', line))]
    group, member, label, begin = "Overview", None, default, 0
    for at, event in [*events, (len(lines), None)]:
        content = "\n".join(lines[begin:at]).strip()
        if content:
            read = default if old else stability_of(content)
            yield chunk(
                "api-member" if member else "api-overview", member or (group if group != "Overview" else title), content, base + begin, base + max(at - 1, begin),
                heading_path=[title, group, member] if member else [title], identifier=f"{owner}.{member}" if member and owner else member, language="markdown",
                symbol_kind=next((v for k, v in (("propert", "property"), ("method", "method"), ("event", "event"), ("enum", "enum")) if k in group.lower()), "unknown") if member else kind,
                stability=label if read == "stable" else read, lifecycle="historical" if old else lifecycle_of(content),
            )
        if event is None:
            break
        begin = at
        if event["h"] == "##":
            group, member = plain_title(event["name"]), None
        elif event["h"]:
            member = plain_title(event["name"])
        else:
            begin = at + 1
            label = default if event["end"] else "experimental" if "experimental" in event["range"] else label


_STRING = r'"(?:\\.|[^"\\])*"'


def read_json(text: str):
    """JSON, or JSON with comments and trailing commas (strings untouched)."""
    text = text.removeprefix("\ufeff")
    try:
        return json.loads(text)
    except ValueError:
        bare = re.sub(rf"({_STRING})|//[^\r\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)
        return json.loads(re.sub(rf"({_STRING})|,(?=\s*[}}\]])", lambda m: m[1] or "", bare, flags=re.S))


def pretty(value) -> str:
    return json.dumps(_whole(value), indent=2, ensure_ascii=False)


def escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def json_document(text: str, path: str) -> Iterator[dict]:
    """Entities by component and event, animations and controllers by name, schemas by property, else the whole document."""
    root, name, last = read_json(text), path.rsplit("/", 1)[-1], text.count("\n") + 1
    found = False

    def made(title: str, pointer: str, value, kind: str, identifier: str | None, lifecycle: str = "active") -> dict:
        return chunk("json-object", title, pretty(value), 1, last, heading_path=[title], language="json", json_pointer=pointer, symbol_kind=kind, identifier=identifier, identifiers=list(identifiers.of_json(value)), lifecycle=lifecycle)

    if not isinstance(root, dict):
        yield made(name, "", root, "unknown", None) | {"heading_path": []}
        return
    spot = "minecraft:entity"
    if isinstance(root.get(spot), dict):
        entity, found = root[spot], True
        about = {"description": entity["description"]} if isinstance(entity.get("description"), dict) else {}
        own = about.get("description", {}).get("identifier")
        own = own if isinstance(own, str) else name
        yield made(own, f"/{spot}/description", {spot: about}, "unknown", own)
        for group, kind in (("components", "component"), ("component_groups", "component"), ("events", "event")):
            for key, value in entity[group].items() if isinstance(entity.get(group), dict) else ():
                yield made(f"{own} — {key}", f"/{spot}/{group}/{escaped(key)}", {spot: about | {group: {key: value}}}, kind, key)
    for group, kind in (("animations", "animation"), ("animation_controllers", "animation-controller"), ("render_controllers", "render-controller")):
        for key, value in root[group].items() if isinstance(root.get(group), dict) else ():
            found = True
            yield made(key, f"/{group}/{escaped(key)}", {group: {key: value}}, kind, key)
    if found:
        return
    properties = root.get("properties") if isinstance(root.get("properties"), dict) else None
    if properties is not None or isinstance(root.get("$schema"), str) or isinstance(root.get("$id"), str) or isinstance(root.get("enum"), list):
        title = root["title"].strip() if isinstance(root.get("title"), str) and root["title"].strip() else name
        life = lambda v: "deprecated" if isinstance(v, dict) and v.get("deprecated") is True else "active"
        yield made(title, "", {k: v for k, v in root.items() if k != "properties"}, "unknown", title, life(root))
        for key, value in (properties or {}).items():
            simple = re.fullmatch(r"[A-Za-z_$][\w$]*", key)
            yield made(f"{title} — {key}", f"/properties/{escaped(key)}", {"title": title, "property": key, "schema": value}, "property", f"{title}.{key}" if simple else key, life(value))
        return
    yield made(name, "", root, "unknown", None)


_NAME = r"([A-Za-z_$][\w$]*)"
# The declarations that begin a span.
DECLARATIONS = (
    (re.compile(rf"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+{_NAME}"), "function"),
    (re.compile(rf"\s*(?:export\s+)?(?:default\s+)?class\s+{_NAME}"), "class-code"),
    (re.compile(rf"\s*(?:export\s+)?interface\s+{_NAME}"), "interface"),
    (re.compile(rf"\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"), "enum"),
    (re.compile(rf"\s*(?:export\s+)?type\s+{_NAME}\s*="), "unknown"),
    (re.compile(rf"\s*(?:export\s+)?(?:const|let)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"), "function"),
)
SUBSCRIBE = re.compile(r"([A-Za-z_$][\w$.]*)\.subscribe\s*\(")


def span_end(code: str, offset: int, starts: list[int], line: int) -> int:
    """Last line of the span that begins at ``offset``: its closing brace, or a statement's end before any brace."""
    depth = 0
    for m in re.finditer(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|(?P<open>\{)|(?P<close>\})|(?P<stop>;[^\S\n]*(?=\n|$))", code[offset:], re.S):
        depth += bool(m["open"]) - bool(m["close"])
        if (m["close"] and depth <= 0) or (m["stop"] and depth == 0):
            return code.count("\n", 0, offset + m.start())
    return min(len(starts) - 1, line + OPEN_SPAN_LINES)


def import_lines(lines: list[str]) -> str:
    """The import statements at the top of a file."""
    head = re.match(r"(?:\s*(?://[^\n]*|/\*.*?\*/|import\s[^;\n]*?(?:\{[^}]*\})?[^;\n]*(?:;|\n|$)))*", "\n".join(lines), re.S)
    return "\n".join(m.rstrip("\n") for m in re.findall(r"^\s*import\s[^;]*?(?:;|[\"']\s*(?=\n|$))", head[0] if head else "", re.M))


def code(text: str, path: str) -> Iterator[dict]:
    """Functions, classes, interfaces, enums, types, arrow functions and subscriptions, each with the file's imports before it."""
    text = text.replace("\r\n", "\n")
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    imports, language, seen = import_lines(lines), "typescript" if re.search(r"\.tsx?$", path) else "javascript", set()
    for i, line in enumerate(lines):
        hit = next(((m[1], kind) for pattern, kind in DECLARATIONS if (m := pattern.match(line))), None)
        if hit is None and (m := SUBSCRIBE.search(line)):
            hit = (f"{m[1]}.subscribe", "event-handler")
        if hit is None:
            continue
        end = span_end(text, starts[i], starts[:-1], i)
        if (key := (i, end, hit[0])) in seen:
            continue
        seen.add(key)
        body = "\n".join(lines[i : end + 1])
        yield chunk("code-block", hit[0], f"{imports}\n\n{body}" if imports and not body.startswith(imports) else body, i + 1, end + 1, heading_path=[hit[0]], identifier=hit[0], symbol_kind=hit[1], language=language)
    if not seen:
        yield chunk("code-block", path.rsplit("/", 1)[-1], text, 1, len(lines), language=language, symbol_kind="unknown")


def plain(text: str, path: str) -> Iterator[dict]:
    yield chunk("document", path.rsplit("/", 1)[-1], text, 1, text.count("\n") + 1, language="text")


def parser_for(path: str):
    low = path.lower()
    if "/ScriptAPI/" in path or "/PriorScriptAPI/" in path:
        return api_page
    for suffixes, parser in (((".md", ".mdx"), markdown), ((".json",), json_document), ((".ts", ".tsx", ".js", ".mjs", ".cjs"), code)):
        if low.endswith(suffixes):
            return parser
    return plain


def parse(path: str, text: str | None) -> list[dict]:
    return numbered(parser_for(path)(text or "", path))


def attributes(path: str, text: str) -> dict[str, str]:
    """What a file's head says of it: the attributes of Markdown, the version a JSON document asks for."""
    parser = parser_for(path)
    if parser in (markdown, api_page):
        return front_matter(text)[0]
    if parser is json_document and isinstance(root := read_json(text), dict):
        about = root.get("header")
        wanted = about.get("min_engine_version") if isinstance(about, dict) else None
        wanted = wanted if wanted is not None else root.get("min_engine_version")
        if isinstance(wanted, list) and wanted:
            return {"product_version": ".".join(str(_whole(v)) for v in wanted)}
        if isinstance(wanted, str):
            return {"product_version": wanted}
    return {}


def parse_files(files: DataFrame) -> DataFrame:
    """Chunk rows of a DataFrame of (path, content); a file that can't be parsed gives one row with ``error`` and hinders no other."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, t in zip(part["path"], part["content"], strict=True):
                try:
                    about = attributes(p, t or "")
                    rows += [{"path": p, **c, "attributes": about, "error": None} for c in parse(p, t)]
                except (ValueError, RecursionError) as e:
                    rows.append({"path": p, **dict.fromkeys(FIELDS), "attributes": None, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pd.DataFrame(rows, columns=["path", *FIELDS, "attributes", "error"])

    return files.select("path", "content").mapInPandas(of, SCHEMA)


def good(chunks: DataFrame) -> DataFrame:
    return chunks.filter("error is null").drop("error")


def bad_files(chunks: DataFrame) -> DataFrame:
    """(path, error) of the files that could not be parsed."""
    return chunks.filter("error is not null").select("path", "error")
