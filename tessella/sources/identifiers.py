"""Identifiers of prose, code and JSON, for parsers that work on one file at a time.

The families are those of ``functions.text.extract_identifiers``, as patterns of this
language; the Column form serves texts that are in a table already.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

# The families that are looked for, and whether a match also gives its prefixes and leaf.
FAMILIES = (
    (re.compile(r"\b[A-Za-z_][A-Za-z0-9_.-]*:[A-Za-z_][A-Za-z0-9_./-]*\b", re.A), False),
    (re.compile(r"@minecraft/[A-Za-z0-9._-]+"), False),
    (re.compile(r"\b[A-Z][A-Za-z0-9]*(?:AfterEvent|BeforeEvent|EventSignal|Component|Controller|Options|Error|Event|Signal|Permission|Permissions|Manager|Registry|Result|Type|Mode|State)\b", re.A), False),
    (re.compile(r"\b(?:[A-Za-z_$][\w$]*\.)+[A-Za-z_$][\w$]*\b", re.A), True),
    (re.compile(r"\b(?:query|variable|temp|context|math)\.[A-Za-z_][A-Za-z0-9_.]*\b", re.A | re.I), True),
    (re.compile(r"`([A-Z][A-Za-z0-9]*(?:\.[A-Za-z_$][\w$]*)?)`", re.A), True),
    (re.compile(r"\[([A-Z][A-Za-z0-9]+)\]\([^)]*\.md(?:#[^)]*)?\)"), False),
)
COMMAND = re.compile(r"(?:^|[\s`\"'(])/([a-z][a-z0-9_:-]*)\b", re.A | re.I | re.M)
MODULE = r"from\s+[\"'](@minecraft/[A-Za-z0-9._-]+)[\"']"
NAMED_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?\{([^}]+)\}\s+" + MODULE)
WHOLE_IMPORT = re.compile(r"\bimport\s+\*\s+as\s+([A-Za-z_$][\w$]*)\s+" + MODULE)
NAME = re.compile(r"[A-Za-z_$][\w$]*", re.A)
KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*:[A-Za-z_][A-Za-z0-9_./-]*")
MANIFEST_FIELDS = frozenset("format_version header modules dependencies capabilities metadata min_engine_version module_name uuid version entry type".split())
RENDER_FIELDS = frozenset("geometry materials textures part_visibility color overlay_color on_fire_color light_color_multiplier uv_anim arrays".split())


def normal(name: str) -> str:
    return re.sub(r"\s+", "", name.strip().strip("`")).lower()


def unique(names: Iterable[str]) -> list[str]:
    """The first of each normal form; forms of one character say nothing."""
    out: dict[str, str] = {}
    for name in names:
        out.setdefault(normal(name), name)
    return [name for form, name in out.items() if len(form) > 1]


def spelled(name: str, parts: bool) -> Iterator[str]:
    """A name without the punctuation behind it; of a dotted one also the prefixes of two segments and more, and the leaf."""
    clean = re.sub(r"[.,;:]+$", "", name.strip())
    yield clean
    segments = clean.split(".")
    if parts and len(segments) > 1:
        yield from (p for k in range(2, len(segments)) if len(p := ".".join(segments[:k])) > 2)
        if len(segments[-1]) >= 3:
            yield segments[-1]


def prose(text: str) -> list[str]:
    found = [x for pattern, parts in FAMILIES for m in pattern.finditer(text) for x in spelled(m[m.re.groups], parts)]
    return unique([*found, *(x for m in COMMAND.finditer(text) for x in spelled("/" + m[1], False))])


def code(text: str) -> list[str]:
    """Those of prose, then modules, imported names, their qualified forms and local names of import statements."""
    found = [x for name in prose(text) for x in spelled(name, "." in name)]
    for names, module in NAMED_IMPORT.findall(text):
        found.append(module)
        for item in names.split(","):
            both = [x.strip() for x in re.split(r"(?i)\s+as\s+", re.sub(r"^type\s+", "", item.strip()))]
            if NAME.fullmatch(both[0]):
                found += [both[0], f"{module}.{both[0]}", *(x for x in both[-1:] if NAME.fullmatch(x))]
    for local, module in WHOLE_IMPORT.findall(text):
        found += [module, local]
    return unique(found)


def _whole(value):
    """Numbers as JavaScript prints them: 20.0 is 20."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _whole(v) for k, v in value.items()}
    return [_whole(v) for v in value] if isinstance(value, list) else value


def of_json(value) -> list[str]:
    """Identifiers that keys stand for and that string leaves mention, in document order."""
    return unique(_json(value, ()))


def _json(value, path: tuple[str, ...]) -> Iterator[str]:
    if isinstance(value, str):
        for name in prose(value):
            yield from spelled(name, "." in name)
    elif isinstance(value, list):
        for v in value:
            yield from _json(v, path)
    elif isinstance(value, dict):
        for key, child in value.items():
            yield from _key(key, child, path)
            yield from _json(child, (*path, key))


def _key(key: str, child, path: tuple[str, ...]) -> Iterator[str]:
    parent, root = path[-1:], path[:1]
    if KEY.fullmatch(key) or key.startswith("@minecraft/"):
        yield key
    if key == "format_version" and isinstance(child, (str, int, float)) and not isinstance(child, bool):
        yield from ("format_version", f"format_version:{_whole(child)}")
    if key in MANIFEST_FIELDS and root in ((), ("header",), ("modules",), ("dependencies",)):
        yield f"manifest.{key}"
    if parent == ("states",):
        yield from (key, f"animation_controller.state.{key}")
    if key in RENDER_FIELDS and "render_controllers" in path:
        yield f"render_controller.{key}"
    if parent == ("properties",):
        yield from (key, f"schema.{key}")
