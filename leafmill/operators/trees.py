"""Operators on whole JSON trees of any depth: nested elements, form fields, edits, schema rules, search text, assets.

Documents pass in small batches and each is read by itself, so nothing moves and neither depth nor number of nodes has a
limit but the parser's own. Text that is no JSON object gives no rows, or comes back as it was where the result is text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds of form fields (fixed values).
FIELDS = ("input", "textarea", "checkbox", "select", "signature")

#: Bytes up to which a document passes as one of a hundred.
LARGE = 1 << 18


def _no_number(word: str):
    raise ValueError(f"{word} is no JSON")


def load(text: str | None):
    """The tree of a JSON text, None where it is broken (NaN and Infinity are) or nested beyond what the parser takes."""
    try:
        return json.loads(text, parse_constant=_no_number) if text else None
    except (ValueError, RecursionError):
        return None


def sound(text: str) -> str:
    """text as UTF-8 can hold it: half a surrogate pair becomes U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def dump(tree) -> str:
    """JSON of a tree; where it holds half a surrogate pair, all but ASCII is escaped, so that nothing is lost."""
    text = json.dumps(tree, ensure_ascii=False, separators=(",", ":"))
    return text if sound(text) == text else json.dumps(tree, separators=(",", ":"))


def _list(v) -> list:
    return v if isinstance(v, list) else []


def _dict(v) -> dict:
    return v if isinstance(v, dict) else {}


def each(docs: DataFrame, rows_of: Callable[[dict], Iterator[tuple]], schema: str, key: str = "doc_id", value: str = "value") -> DataFrame:
    """(key, columns of schema): the rows that rows_of makes of each document, numbered by their order where it says so.

    A plain function of one text gets a hundred rows at a time, an Arrow batch up to 64 MB of them, which Python holds
    several times over. So only texts of more than LARGE bytes, of which a hundred may be more than that, pass in batches.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def made(text):
        tree = load(text)
        return list(rows_of(tree)) if isinstance(tree, dict) else []

    def run(batches):
        for pdf in batches:
            for k, text in zip(pdf[key], pdf[value]):
                if rows := made(text):
                    yield pd.DataFrame([(k, *r) for r in rows], columns=[key, *names])

    # As a function that may differ from call to call, it is called once: Spark would call it again for a filter of its own.
    made_of = F.udf(made, f"array<struct<{schema}>>", useArrow=False).asNondeterministic()
    size = F.octet_length(value)
    small = docs.where(size <= LARGE).select(key, made_of(value).alias("_made")).select(key, F.inline("_made"))
    return small.unionByName(docs.where(size > LARGE).select(key, value).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, {schema}"))


def nested(element: dict, at: int) -> Iterator[tuple[list[int], int, str]]:
    """(path, depth, JSON) of all elements below one, an element before those it holds."""
    stack = [([at, i], 1, e) for i, e in reversed(list(enumerate(_list(element.get("elements")))))]
    while stack:
        path, depth, e = stack.pop()
        yield path, depth, dump(e)
        stack += [([*path, i], depth + 1, x) for i, x in reversed(list(enumerate(_list(_dict(e).get("elements")))))]


def list_lines(items, depth: int = 0) -> list[str]:
    """`- content` for each item of a list, two spaces further in for each level, children after their item."""
    stack, out = [(depth, i) for i in reversed(_list(items))], []
    while stack:
        d, item = stack.pop()
        content = item if isinstance(item, str) else _dict(item).get("content")
        out.append("  " * d + "- " + ("" if content is None else str(content)).strip())
        stack += [(d + 1, c) for c in reversed(_list(_dict(item).get("children")))]
    return out


def fields(tree: dict) -> Iterator[tuple[int, str, str, str | None]]:
    """(seq, name, type, value) of the named form fields: page by page its elements, header and footer, then the
    document's header and footer; inside an element its elements, its items, then the cells of its rows."""
    parts = lambda holder: [_dict(holder.get(p)).get("elements") for p in ("header", "footer")]
    roots = [r for page in _list(tree.get("pages")) for r in (_dict(page).get("elements"), *parts(_dict(page)))]
    stack, seq = [*reversed([*roots, *parts(tree)])], 0
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += reversed(node)
        elif isinstance(node, dict):
            name, kind = node.get("name"), node.get("type")
            if kind in FIELDS and isinstance(name, str) and name:
                held = node.get("checked") if kind == "checkbox" else node.get("values") or node.get("value")
                yield seq, sound(name), kind, held if held is None else sound(held) if isinstance(held, str) else dump(held)
                seq += 1
            stack += reversed([x for x in (node.get("elements"), node.get("items"), *_list(node.get("rows"))) if isinstance(x, list)])


def form_fields(docs: DataFrame, key: str = "doc_id", value: str = "value") -> DataFrame:
    """(key, seq, name, type, value): all named fields wherever they stand; value is text, other values as JSON."""
    return each(docs, fields, "seq int, name string, type string, value string", key, value)


# Edits

#: An edit that would fill up a list with more than so many nulls changes nothing.
MOST_FILLED = 100_000


def _at(tree, path: list):
    """The node at path; None where a step does not exist."""
    for step in path:
        if isinstance(tree, list) and isinstance(step, int) and 0 <= step < len(tree):
            tree = tree[step]
        elif isinstance(tree, dict) and step in tree:
            tree = tree[step]
        else:
            return None
    return tree


def _set(node, field: str, value) -> None:
    """field is a dotted path. Steps that are missing are made, lists where the next step is a number; a list that is
    shorter than its step is filled up with null."""
    steps = field.split(".")
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        fresh = value if last else [] if steps[i + 1].isdigit() else {}
        if isinstance(node, list):
            if not step.isdigit():
                return
            step = int(step) if len(step) < 12 else len(node) + MOST_FILLED + 1
            if step - len(node) > MOST_FILLED:
                return
            node += [None] * (step + 1 - len(node))
        if last or not isinstance(node[step] if isinstance(node, list) else node.get(step), (dict, list)):
            node[step] = fresh
        node = node[step]


def edit(tree: dict, op: str, path: list, field: str | None, value) -> None:
    """One edit in place; one whose target does not exist changes nothing.

    set (field, value), delete, move (value -1 or 1), duplicate (4 further right and down), insert_after (value),
    append (path: the page's place), insert_page and delete_page (path: its place; the last page stays)."""
    pages = _list(tree.get("pages"))
    if op == "set":
        if field is not None and isinstance(node := _at(tree, path), (dict, list)):
            _set(node, field, value)
        return
    if not path:
        return
    at = path[-1]
    if op in ("append", "insert_page", "delete_page"):
        if not isinstance(at, int) or not 0 <= at < len(pages):
            return
        if op == "insert_page":
            pages.insert(at + 1, {"elements": []})
        elif op == "append" and isinstance(pages[at], dict):
            pages[at]["elements"] = [*_list(pages[at].get("elements")), value]
        elif op == "delete_page" and len(pages) > 1:
            del pages[at]
        return
    parent = _at(tree, path[:-1])
    if isinstance(parent, dict) and op == "delete":
        parent.pop(at, None)
    if not isinstance(parent, list) or not isinstance(at, int) or not 0 <= at < len(parent):
        return
    if op == "delete":
        del parent[at]
    elif op == "move" and type(value) is int and 0 <= at + value < len(parent):
        parent.insert(at + value, parent.pop(at))
    elif op == "insert_after":
        parent.insert(at + 1, value)
    elif op == "duplicate":
        copy = load(dump(parent[at]))
        if isinstance(copy, dict) and isinstance(place := copy.get("position"), dict):
            number = lambda v: v if isinstance(v, (int, float)) else 0
            copy["position"] = {"x": number(place.get("x")) + 4, "y": number(place.get("y")) + 4}
        parent.insert(at + 1, copy)


def apply_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id", value: str = "value") -> DataFrame:
    """(key, value): docs after their edits (key, seq, op, path, field, payload) in the order of seq; path is a JSON array,
    payload JSON. A document without edits is passed on unread; only one document's edits are gathered in a row."""
    mine = edits.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "op", "path", "field", "payload")))).alias("_edits"))

    def after(text, todo):
        tree = load(text) if isinstance(todo, str) else None
        if not isinstance(tree, dict):
            return text
        for e in json.loads(todo):
            edit(tree, e["op"], _list(load(e.get("path"))), e.get("field"), load(e.get("payload")))
        return dump(tree)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], value: [after(t, e) for t, e in zip(pdf[value], pdf["_edits"])]})

    return docs.select(key, value).join(mine, key, "left").mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, `{value}` string")


# Rules of a JSON Schema


def _is(v, kind: str) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {
        "object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool),
        "null": v is None, "number": number, "integer": number and (isinstance(v, int) or v.is_integer()),
    }.get(kind, True)


def broken_rules(v, schema, root: dict, at: str = "") -> Iterator[tuple[str, str]]:
    """(place, message) of every rule of a JSON Schema that v breaks; keywords that are not known here hold."""
    if schema is False:
        yield at, "boolean schema is false"
    if not isinstance(schema, dict):
        return
    inner = lambda x, s, step="": broken_rules(x, s, root, at + step)
    holds = lambda s: next(broken_rules(v, s, root, at), None) is None
    if ref := schema.get("$ref"):
        yield from inner(v, _at(root, [p.replace("~1", "/").replace("~0", "~") for p in ref.removeprefix("#/").split("/")]))
    if kinds := schema.get("type"):
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(_is(v, k) for k in kinds):
            yield at, "must be " + ",".join(kinds)
    if "enum" in schema and v not in schema["enum"]:
        yield at, "must be equal to one of the allowed values"
    if "const" in schema and v != schema["const"]:
        yield at, "must be equal to constant"
    if isinstance(v, dict):
        known, rest = schema.get("properties", {}), schema.get("additionalProperties")
        yield from ((at, f"must have required property '{n}'") for n in schema.get("required", []) if n not in v)
        for n, x in v.items():
            step = "/" + n.replace("~", "~0").replace("/", "~1")
            patterns = [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, n)]
            for s in (*([known[n]] if n in known else []), *patterns):
                yield from inner(x, s, step)
            if n not in known and not patterns and rest is False:
                yield at, "must NOT have additional properties"
            elif n not in known and not patterns and isinstance(rest, dict):
                yield from inner(x, rest, step)
    if isinstance(v, list):
        if len(v) < (n := schema.get("minItems", 0)):
            yield at, f"must NOT have fewer than {n} items"
        if len(v) > (n := schema.get("maxItems", len(v))):
            yield at, f"must NOT have more than {n} items"
        for i, x in enumerate(v):
            yield from inner(x, schema.get("items", True), f"/{i}")
    if isinstance(v, str):
        if len(v) < (n := schema.get("minLength", 0)):
            yield at, f"must NOT have fewer than {n} characters"
        if len(v) > (n := schema.get("maxLength", len(v))):
            yield at, f"must NOT have more than {n} characters"
        if (p := schema.get("pattern")) and not re.search(p, v):
            yield at, f'must match pattern "{p}"'
    if _is(v, "number"):
        limits = {"minimum": (">=", v.__ge__), "maximum": ("<=", v.__le__), "exclusiveMinimum": (">", v.__gt__), "exclusiveMaximum": ("<", v.__lt__)}
        for word, (sign, meets) in limits.items():
            if word in schema and meets(schema[word]) is False:
                yield at, f"must be {sign} {schema[word]}"
    for s in schema.get("allOf", []):
        yield from inner(v, s)
    if (some := schema.get("anyOf")) and not any(map(holds, some)):
        yield at, "must match a schema in anyOf"
    if (one := schema.get("oneOf")) and sum(map(holds, one)) != 1:
        yield at, "must match exactly one schema in oneOf"
    if "not" in schema and holds(schema["not"]):
        yield at, "must NOT be valid"
    if "if" in schema:
        yield from inner(v, schema.get("then" if holds(schema["if"]) else "else", True))


#: Frames that checking one document may take; documents come no deeper out of the parser.
_FRAMES = 200_000


def _all_broken(tree, schema: dict) -> list[tuple[str, str]]:
    """Every broken rule of a document; one that cannot be checked breaks a rule itself."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(_FRAMES)
    try:
        return list(broken_rules(tree, schema, schema))
    except (RecursionError, re.error, TypeError, KeyError, AttributeError) as e:
        return [("", f"cannot be checked: {type(e).__name__}")]
    finally:
        sys.setrecursionlimit(before)


def schema_errors(docs: DataFrame, schema: dict, key: str = "doc_id", value: str = "value") -> DataFrame:
    """(key, place, message): all rules of a JSON Schema that a document breaks; text that is no JSON breaks one itself."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[value]):
                tree = load(text)
                broken = [("", "must be JSON")] if tree is None and (text or "").strip() != "null" else _all_broken(tree, schema)
                rows += [(k, sound(at), sound(message)) for at, message in broken]
            yield pd.DataFrame(rows, columns=[key, "place", "message"])

    return docs.select(key, value).mapInPandas(run, f"`{key}` {dict(docs.dtypes)[key]}, place string, message string")


# Search text


def shown_text(e) -> str:
    """What a reader sees of an element: content, runs, items, header and cells, or a section's title and elements."""
    text = lambda v: "" if v is None else str(v)

    def own(e: dict) -> str:
        kind = e.get("type")
        if kind == "richtext":
            return "".join(text(_dict(r).get("text")) for r in _list(e.get("runs")))
        if kind == "list":
            return " ".join(line.lstrip().removeprefix("- ") for line in list_lines(e.get("items")))
        if kind == "table":
            cells = [c for row in _list(e.get("rows")) for c in (row if isinstance(row, list) else [row])]
            return " ".join([*map(text, _list(e.get("headers"))), *(text(c.get("content")) if isinstance(c, dict) else text(c) for c in cells)])
        return text(e.get("content")) if kind == "text" else text(e.get("title")) + " " if kind == "collapsible" else ""

    out, stack = [], [e]
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            out.append(e)
            continue
        e = _dict(e)
        out.append(own(e))
        if e.get("type") == "collapsible":  # its elements with single spaces between them
            inner = [x if isinstance(x, dict) else {} for x in _list(e.get("elements"))]
            stack += [x for i, c in reversed(list(enumerate(inner))) for x in ([c, " "] if i else [c])]
    return sound("".join(out))


def every_text(e, repeat_fields: bool = True) -> str:
    """All text of an element for search, whatever its kind: also transcripts, labels, values, captions, recognised text
    and chapters. repeat_fields: a field's label and value stand twice, as in indexes made so."""

    def own(e: dict) -> tuple[str, list]:
        """What leads, without a space between its parts, and what follows with one."""
        inside = lambda *path: [_dict(x).get(path[-1]) for x in _list(_at(e, list(path[:-1])))]
        items = [s for i in map(_dict, _list(e.get("items"))) for s in (i.get("content"), *(_dict(x).get("content") for x in _list(i.get("items"))))]
        cells = [_dict(c).get("content") if isinstance(c, dict) else c for row in _list(e.get("rows")) for c in _list(row)]
        value = e.get("value")
        shown = value if isinstance(value, str) and value and not value.startswith("data:") else None
        parts = [*items, *cells, e.get("title"), *inside("transcript", "segments", "text"), e.get("label"), shown, e.get("placeholder"), e.get("caption"), *inside("ocr", "blocks", "text"), *inside("chapters", "title")]
        parts += [e.get("label"), value] if repeat_fields else []
        return "".join(s for s in (e.get("content"), *inside("runs", "text")) if isinstance(s, str)), [*parts, *_list(e.get("values"))]

    def joined(lead: str, parts: list) -> str:
        """A part that follows nothing has no space before it."""
        said = [s for s in parts if isinstance(s, str)]
        return " ".join([lead, *said] if lead else said[next((i for i, s in enumerate(said) if s), len(said)) :] if said else [])

    # An element is done when those within it are: each frame holds its own text, what is still to come and what came.
    frames = [(*own(_dict(e)), list(_list(_dict(e).get("elements")))[::-1])]
    while True:
        lead, parts, left = frames[-1]
        if left:
            inner = _dict(left.pop())
            frames.append((*own(inner), list(_list(inner.get("elements")))[::-1]))
            continue
        frames.pop()
        text = joined(lead, parts)
        if not frames:
            return sound(text)
        if text:
            frames[-1][1].append(text)


def search_text(el: Column, every: bool = False, repeat_fields: bool = True) -> Column:
    """Text of an element (VARIANT) for search: shown_text, or every_text."""

    @F.pandas_udf(StringType())
    def text(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: every_text(load(r), repeat_fields) if every else shown_text(load(r)))

    return text(F.to_json(el))


# Assets


def take_assets(tree: dict) -> list[tuple[str, str, str, bytes]]:
    """(id, mime, ext, bytes) of the data URLs in a document, which refers to them by id afterwards.

    Equal bytes are one asset: of elements asset-1, asset-2 and so on, past ids that are taken; of resources the entry's
    own key, or the asset that holds its bytes already, to which all references to the key then lead. Data that is no
    base64 stays where it is."""
    taken, ids, out = set(_dict(_dict(tree.get("resources")).get("images"))), {}, []

    def parts(url: str) -> tuple[str, str] | None:
        m = re.match(r"data:([^;]+);base64,(.*)\Z", url)
        return (m[1], m[2]) if m else None

    def bytes_of(digits: str) -> bytes | None:
        try:
            return base64.b64decode(digits, validate=True)
        except ValueError:
            return None

    def keep(content: bytes, mime: str, name: Callable[[], str]) -> str:
        digest = hashlib.sha1(content).hexdigest()[:16]
        if digest not in ids:
            ids[digest] = name()
            taken.add(ids[digest])
            ext = (mime.split("/") + [""])[1].replace("jpeg", "jpg", 1).replace("quicktime", "mov", 1)
            out.append((ids[digest], mime, ext or "bin", content))
        return ids[digest]

    number = 0

    def fresh() -> str:
        nonlocal number
        number += 1
        while f"asset-{number}" in taken:
            number += 1
        return f"asset-{number}"

    def elements() -> Iterator[dict]:
        stack = [e for p in reversed(_list(tree.get("pages"))) for e in reversed(_list(_dict(p).get("elements")))]
        while stack:
            e = stack.pop()
            if isinstance(e, dict):
                yield e
                stack += reversed([*_list(e.get("elements")), *_list(e.get("children"))])

    for e in elements():
        src = e.get("src")
        if e.get("type") in ("image", "video") and isinstance(src, str) and (found := parts(src)) and (content := bytes_of(found[1])) is not None:
            del e["src"]
            e["resource"] = keep(content, found[0], fresh)
    moved = {}
    for bucket, usual in (("images", "image/png"), ("videos", "video/mp4")):
        store = _dict(_dict(tree.get("resources")).get(bucket))
        for name, entry in list(store.items()):
            if not isinstance(entry, dict) or not entry.get("data"):
                continue
            mime, digits = parts(str(entry["data"])) or (entry.get("mimeType") or usual, str(entry["data"]))
            if (content := bytes_of(digits)) is None:
                continue
            own = keep(content, mime, lambda: name)
            if own == name:
                del entry["data"]
                entry["src"] = "embedded"
            else:
                del store[name]
                moved[name] = own
    for e in elements() if moved else ():
        if e.get("resource") in moved:
            e["resource"] = moved[e["resource"]]
    return out


def extract_assets(docs: DataFrame, key: str = "doc_id", value: str = "value") -> DataFrame:
    """(key, kind, id, mime, ext, content, value): a document's row (kind document, its text in value) and one for each of
    its assets (kind asset, its bytes in content). Write the result once and read both from there."""

    def rows(tree: dict):
        assets = take_assets(tree)
        yield "document", None, None, None, None, dump(tree)
        yield from (("asset", *a, None) for a in assets)

    return each(docs, rows, "kind string, id string, mime string, ext string, content binary, value string", key, value)
