"""JSON inside text: finding, cutting and summarising values that have no fixed schema.

Recursion over unknown depth is no column expression, so these are Arrow-batched functions; paths stay native. A text that is
nested deeper than ``DEEPEST`` is no JSON here: it has no value, no outline and no state. Depth is found by one pass over brackets
outside of strings before anything is parsed, so that no text, however deep, exhausts a stack.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup as M

#: Levels of arrays and objects. Fixed value: what common parsers of such records take.
DEEPEST = 127
_BRACKETS = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\Z)|[\[{]|[\]}]', re.S)


def value_end(text: str, begin: int, one: bool = True) -> int:
    """Behind the value whose bracket is at ``begin`` (not only ``one``: behind the last value from there on); -1 if it is not closed or too deep."""
    depth, end = 0, begin
    for m in _BRACKETS.finditer(text, begin):
        c = text[m.start()]
        if c in "[{":
            depth += 1
            if depth > DEEPEST:
                return -1
        elif c in "]}":
            depth -= 1
            end = m.end()
            if depth == 0 and one:
                return end
    return -1 if depth > 0 else end


def parsed(text: str) -> object:
    """The value of a whole text; ValueError if it is no JSON or too deep."""
    if text.count("[") + text.count("{") > DEEPEST and value_end(text, 0, one=False) < 0:
        raise ValueError("not closed, or too deep")
    return json.loads(text)


def compact(value: object) -> str:
    """Minified, keys sorted."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def at_path(text: Column, path: str) -> Column:
    """The value under object keys ``a.b.c``, as JSON or bare text; array places are no keys and give null."""
    keys = path.split(".")
    if any(k.isdigit() for k in keys):
        return F.lit(None).cast("string")
    return F.get_json_object(text, "$" + "".join(f"['{k}']" for k in keys))


def first_value(text: str | None, begin: int = 0) -> object | None:
    """The object or array that starts at the next bracket; None if there is none, it does not parse, or it is too deep."""
    m = re.compile(r"[{\[]").search(text or "", begin)
    if not m:
        return None
    end = value_end(text, m.start())
    try:
        return json.loads(text[m.start() : end]) if end > 0 else None
    except ValueError:
        return None


def page_state(html: str | None, name: str, scripts: list | None = None) -> object | None:
    """What a page's script holds under a name: the first script element of that id, else what is assigned on window, else on self.

    An assignment on window without an equals sign or a bracket after it ends the search. scripts: the page's, if they are known.
    """
    html = html or ""
    for attrs, text in M.scripts(html) if scripts is None else scripts:
        if attrs.get("id") == name:
            try:
                return parsed(text)
            except ValueError:
                break
    for holder in ("window", "self"):
        at = html.find(f"{holder}.{name}")
        if at < 0:
            continue
        eq = html.find("=", at)
        if eq < 0 or not re.compile(r"[{\[]").search(html, eq):
            return None
        value = first_value(html, eq)
        if value is not None:
            return value
    return None


def cut(value: object, most: int, depth: int) -> object:
    """Arrays to so many items and a note of how many more; what lies deeper than ``depth`` to a note."""
    if depth <= 0:
        return "[depth limit]"
    if isinstance(value, list):
        kept = [cut(v, most, depth - 1) for v in value[:most]]
        return [*kept, f"... +{len(value) - most} more"] if len(value) > most else kept
    if isinstance(value, dict):
        return {k: cut(v, most, depth - 1) for k, v in value.items()}
    return value


def outline(value: object, levels: int = 3, level: int = 0) -> list[str]:
    """Keys with their types, sorted, some levels deep."""
    pad = "  " * level
    if level >= levels:
        return [f"{pad}..."]
    if isinstance(value, list):
        return [f"{pad}[0]:", *outline(value[0], levels, level + 1)] if value else []
    if not isinstance(value, dict):
        return []
    lines = []
    for key, v in sorted(value.items()):
        if isinstance(v, dict):
            lines += [f"{pad}{key}: {{...}}", *outline(v, levels, level + 1)]
        else:
            kind = f"[{len(v)} items]" if isinstance(v, list) else "null" if v is None else "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
            lines.append(f"{pad}{key}: {kind}")
    return lines


def _loaded(text: str | None) -> tuple[bool, object]:
    try:
        return True, parsed(text)
    except (AttributeError, TypeError, ValueError):
        return False, None


def pruned(text: Column, most: int, depth: int) -> Column:
    """Null where the text is no JSON."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([compact(cut(v, most, depth)) if ok else None for ok, v in map(_loaded, batch.to_pylist())], pa.string())

    return run(text)


def outlined(text: Column, levels: int = 3) -> Column:
    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array(["\n".join(outline(v, levels)) if ok else None for ok, v in map(_loaded, batch.to_pylist())], pa.string())

    return run(text)


def state(html: Column, name: str) -> Column:
    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        found = [page_state(x, name) for x in batch.to_pylist()]
        return pa.array([None if v is None else compact(v) for v in found], pa.string())

    return run(html)


# Names under which single-page applications keep their state, and what they are called.
STATE_NAMES = {
    "__NEXT_DATA__": "Next.js", "__NUXT__": "Nuxt.js", "__INITIAL_STATE__": "Redux/Vuex",
    "__APOLLO_STATE__": "Apollo GraphQL", "__RELAY_STORE__": "Relay", "__PRELOADED_STATE__": "Redux",
}
STATE_BYTES = 8192


def _section(name: str, value: object) -> str:
    """A state as indented JSON under its label, cut after so many bytes with a note of how many more."""
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True)
    raw = text.encode()
    if len(raw) > STATE_BYTES:
        text = f"{raw[:STATE_BYTES].decode(errors='ignore')}\n... [{len(raw) - STATE_BYTES} more bytes]"
    return f"### {STATE_NAMES[name]} (`{name}`)\n\n```json\n{text}\n```"


def state_sections(html: Column) -> Column:
    """All known states of a page, in the order of their names' list; null without any."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        pages = [(x, M.scripts(x)) for x in batch.to_pylist()]
        found = [[_section(n, v) for n in STATE_NAMES if (v := page_state(x, n, scripts)) is not None] for x, scripts in pages]
        return pa.array(["\n\n".join(x) if x else None for x in found], pa.string())

    return run(html)
