"""Rich text: trees of elements and text as JSON, with Arrow-batched functions over columns of it.

An element is ``{"tagName"?, "children": [...]}``, a text node ``{"text": ...}``, a reference marker ``{"ref": key}``;
other keys are formatting.  Python is needed here: trees are recursive, and no column type is.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..sources.runs import map_runs

Node = dict
# Prefixes of lines in Markdown, and which elements may hold which.
MARKDOWN = {"h1": "# ", "h2": "## ", "li": "* ", "ref": "- "}
BLOCKS = {"p", "h1", "h2", "ol", "ul", "li", "table", "tr", "td"}
_RTL = re.compile("[֑-߿יִ-﷽ﹰ-ﻼ]")
_LTR = re.compile("[A-Za-z_]")


def is_text(n: Node) -> bool:
    return isinstance(n.get("text"), str)


def is_element(n: Node) -> bool:
    return isinstance(n.get("children"), list)


def is_marker(n: Node) -> bool:
    return "ref" in n and not is_element(n) and not is_text(n)


def walk(root: Node, depth: int = 0, path: tuple[Node, ...] = ()) -> Iterator[tuple[Node, int, tuple[Node, ...]]]:
    """Nodes below the root, depth first, without recursion."""
    stack = [(c, depth, path) for c in reversed(root.get("children", []))]
    while stack:
        node, d, p = stack.pop()
        yield node, d, p
        if is_element(node):
            stack.extend((c, d + 1, (*p, node)) for c in reversed(node["children"]))


def plain_text(root: Node) -> str:
    """Texts in order; a new line before each element after the second node."""
    return "".join(n["text"] if is_text(n) else "\n" if is_element(n) and i > 1 else "" for i, (n, _, _) in enumerate(walk(root)))


def markdown(root: Node) -> str:
    out, level = [], 1
    for n, depth, _ in walk(root):
        if depth != level:
            out.append("\n")
            level = depth
        out.append(MARKDOWN.get(n.get("tagName"), ""))
        if is_text(n):
            out.append(n["text"])
    return "".join(out)


def from_plain(text: str) -> Node:
    return {"children": [{"text": text}]}


def find(root: Node, test: Callable[[Node], bool]) -> tuple[Node, list[Node]] | None:
    """The first node that passes, and its path from the root."""
    return next(((n, list(p)) for n, _, p in walk(root) if test(n)), None)


def texts(root: Node) -> list[Node]:
    return [n for n, _, _ in walk(root) if is_text(n)]


def contains(root: Node, part: Node) -> bool:
    return root is part or any(n is part for n, _, _ in walk(root))


def refs(root: Node, local: bool = False) -> list[str]:
    """Keys of reference markers and elements, each once, in order."""
    return list(dict.fromkeys(n["ref"] for n, _, _ in walk(root) if "ref" in n and (local or n.get("isLocal") is not True)))


def compose(root: Node, targets: dict[str, Node | None]) -> Node:
    """Markers give way to ``ref`` elements with the target's nodes, one level only.

    A target that is known as None was deleted: its marker goes.  One that isn't known yet leaves an empty placeholder.
    """

    def build(n: Node) -> list[Node]:
        if is_marker(n):
            if n["ref"] not in targets:
                return [{"tagName": "ref", "ref": n["ref"], "isLoading": True, "children": []}]
            target = targets[n["ref"]]
            return [] if target is None else [{"tagName": "ref", "ref": n["ref"], "children": target.get("children", [])}]
        return [n | {"children": [x for c in n["children"] for x in build(c)]}] if is_element(n) else [n]

    return build(root)[0]


def decompose(root: Node) -> tuple[Node, dict[str, Node]]:
    """The tree with markers in place of ``ref`` elements, and what they held (placeholders hold nothing)."""
    cut: dict[str, Node] = {}

    def build(n: Node) -> Node:
        if is_element(n) and n.get("tagName") == "ref" and "ref" in n:
            if not n.get("isLoading"):
                cut[n["ref"]] = {"children": [build(c) for c in n["children"]]}
            return {"ref": n["ref"]}
        return n | {"children": [build(c) for c in n["children"]]} if is_element(n) else n

    return build(root), cut


# flat form


def _attributes(n: Node, without: str) -> str:
    rest = {k: v for k, v in n.items() if k != without}
    return json.dumps(rest, sort_keys=True, ensure_ascii=False) if rest else "{}"


def flatten(root: Node) -> list[tuple[str, str, str]]:
    """Atoms: (open, attributes, ""), (close, "", ""), (char, attributes, character) and (leaf, node, "")."""
    out: list[tuple[str, str, str]] = []

    def add(n: Node) -> None:
        if is_element(n):
            out.append(("open", _attributes(n, "children"), ""))
            for c in n["children"]:
                add(c)
            out.append(("close", "", ""))
        elif is_text(n):
            style = _attributes(n, "text")
            out.extend(("char", style, c) for c in n["text"])
        else:
            out.append(("leaf", _attributes(n, ""), ""))

    for child in root.get("children", []):
        add(child)
    return out


def rebuild(atoms: list[tuple[str, str, str]]) -> Node:
    """The tree of atoms; runs of one style form one text node, and what a merge left unbalanced is closed."""
    root: Node = {"children": []}
    stack, run, style = [root], [], None

    def flush() -> None:
        nonlocal run, style
        if run:
            stack[-1]["children"].append(json.loads(style) | {"text": "".join(run)})
        run, style = [], None

    for kind, attrs, char in atoms:
        if kind == "char":
            if attrs != style:
                flush()
            style = attrs
            run.append(char)
            continue
        flush()
        if kind == "open":
            node = json.loads(attrs) | {"children": []}
            stack[-1]["children"].append(node)
            stack.append(node)
        elif kind == "close":
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1]["children"].append(json.loads(attrs))
    flush()
    return root


def diff_atoms(a: list, b: list) -> list[tuple[int, int, list]]:
    """(start, stop, new): parts of ``a`` and what takes their place, ascending."""
    lead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[lead:]), reversed(b[lead:]))) if x != y), min(len(a), len(b)) - lead)
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not x or not y:
        return [(lead, lead + len(x), y)] if x or y else []
    ops = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    return [(lead + i, lead + j, y[k:m]) for op, i, j, k, m in ops if op != "equal"]


def patch_atoms(a: list, changes: list) -> list:
    out, at = [], 0
    for start, stop, new in changes:
        out += a[at:start] + [tuple(n) for n in new]
        at = stop
    return out + a[at:]


def diff(a: Node, b: Node) -> list[tuple[int, int, list]]:
    return diff_atoms(flatten(a), flatten(b))


def patch(a: Node, changes: list) -> Node:
    return rebuild(patch_atoms(flatten(a), changes))


def merge(base: Node, leaves: list[Node]) -> Node:
    """All leaves' edits on one base: only its positions are deleted, and insertions go between them.

    Leaves come oldest first.  What several insert at one place is united: shared parts once, the rest in order.
    """
    atoms = flatten(base)
    gone, new = set(), {}
    for leaf in leaves:
        for start, stop, put in diff_atoms(atoms, flatten(leaf)):
            gone.update(range(start, stop))
            if not put:
                continue
            have = new.get(start)
            if not have:
                new[start] = put
                continue
            both: list = []
            for op, i, j, k, m in SequenceMatcher(None, have, put, autojunk=False).get_opcodes():
                both += have[i:j] if op == "equal" else have[i:j] + put[k:m]
            new[start] = both
    out: list = []
    for i in range(len(atoms) + 1):
        out += new.get(i, [])
        if i < len(atoms) and i not in gone:
            out.append(atoms[i])
    return rebuild(out)


def project_offset(changes: list, offset: int) -> int:
    """Where a position of the old atoms lies in the new ones."""
    moved = offset
    for start, stop, new in changes:
        if stop <= offset and start < offset or start == stop <= offset:
            moved += len(new) - (stop - start)
        elif start < offset < stop:
            moved -= offset - start
    return moved


def strip_formatting(root: Node) -> Node:
    """One paragraph of all leaves, texts without formatting; local elements stay apart."""
    out, para = [], None
    for n, _, _ in walk(root):
        if is_element(n):
            if n.get("isLocal") is True:
                out.append(n | {"children": []})
                para = None
            continue
        if para is None:
            para = {"tagName": "p", "children": []}
            out.append(para)
        para["children"].append({k: v for k, v in n.items() if k in ("text", "isLocal")} if is_text(n) else n)
    return {"children": out}


def node_keys(root: Node) -> list[str]:
    """tag/hash/occurrence of each node, stable while others come and go."""
    seen: Counter = Counter()
    out = []
    for n, _, _ in walk(root):
        h = md5(_attributes(n, "children").encode()).hexdigest()[:16]
        out.append(f"{n.get('tagName') or ('text' if is_text(n) else '')}/{h}/{seen[h]}")
        seen[h] += 1
    return out


def direction(root: Node, base: str = "auto") -> str:
    """That of the first explicit element or strongly directional character."""
    for n, _, _ in walk(root):
        if n.get("dir") in ("ltr", "rtl"):
            return n["dir"]
        for c in n["text"] if is_text(n) else "":
            if _RTL.match(c):
                return "rtl"
            if _LTR.match(c):
                return "ltr"
    return base


def live_pointers(pointers: list[dict], now: float) -> list[dict]:
    """Pointers that haven't expired, each key and type once, in key order."""
    kept = {(p["key"], p["type"]): p for p in pointers if p.get("expiration") is None or p["expiration"] >= now}
    return [kept[k] for k in sorted(kept)]


# normal form


def normalise(root: Node, max_passes: int = 50) -> Node:
    """Texts regrouped and elements put where they may stand, until nothing changes; an empty root is one paragraph."""
    now = rebuild(flatten(root))
    for _ in range(max_passes):
        new = rebuild(flatten({"children": _settle(now["children"], None)}))
        if new == now:
            break
        now = new
    return now if now["children"] else {"children": [{"tagName": "p", "children": [{"text": ""}]}]}


def _wrap(tag: str, n: Node) -> Node:
    return {"tagName": tag, "children": [n]}


def _settle(children: list[Node], parent: str | None) -> list[Node]:
    out: list[Node] = []
    for n in children:
        tag = n.get("tagName")
        inline = is_text(n) or tag in ("object", "img")
        if inline and (parent is None or parent in ("ul", "ol", "table", "tr")):
            n = _wrap("p" if parent is None else "li" if parent in ("ul", "ol") else "td", n)
        elif tag == "p" and parent in ("ul", "ol"):
            n = n | {"tagName": "li"}
        elif tag == "li" and parent not in ("ul", "ol", "li", None) or tag == "li" and parent is None:
            n = _wrap("ul", n)
        elif tag == "td" and parent not in ("tr", "td"):
            n = _wrap("tr", n)
        elif tag == "tr" and parent not in ("table", "tr", "td"):
            n = _wrap("table", n)
        elif is_element(n) and not n["children"] and tag in BLOCKS and parent is not None:
            continue
        if is_element(n):
            own = n.get("tagName")
            settled = _settle(n["children"], own)
            inside, below = [], []
            for c in settled:
                t = c.get("tagName")
                if t == "p" and own == "li" or t == "table" and own in ("table", "tr"):
                    inside += c["children"]
                elif own == "p" and t in ("p", "h1", "h2", "ol", "ul", "table") or own == t and t in ("li", "tr", "td") or own in ("table", "tr") and t in ("p", "h1", "h2", "ol", "ul", "li"):
                    below.append(c)
                else:
                    (below if below else inside).append(c)
            out.append(n | {"children": inside})
            rest = [c for c in below if is_element(c)]
            loose = [c for c in below if not is_element(c)]
            out += rest + ([{"tagName": own, "children": loose}] if loose else [])
            continue
        out.append(n)
    return [n for i, n in enumerate(out) if not (is_element(n) and not n["children"] and n.get("tagName") in BLOCKS and len(out) > 1)]


# columns


def _column(f: Callable[[Node], object]) -> Callable[[pd.Series], pd.Series]:
    def run(trees: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(json.loads(t)) for t in trees])

    return run


def _tree(n: Node) -> str:
    return json.dumps(n, sort_keys=True, ensure_ascii=False)


plain_text_of = pandas_udf(_column(plain_text), StringType())
markdown_of = pandas_udf(_column(markdown), StringType())
refs_of = pandas_udf(_column(refs), ArrayType(StringType()))
direction_of = pandas_udf(_column(direction), StringType())
node_keys_of = pandas_udf(_column(node_keys), ArrayType(StringType()))
strip_formatting_of = pandas_udf(_column(lambda n: _tree(strip_formatting(n))), StringType())
normalised_of = pandas_udf(_column(lambda n: _tree(normalise(n))), StringType())
atoms_of = pandas_udf(_column(lambda n: [{"kind": k, "attributes": a, "text": t} for k, a, t in flatten(n)]), ArrayType(StructType([StructField(n, StringType()) for n in ("kind", "attributes", "text")])))


def merge_rich_text(leaves: DataFrame, key: str = "key") -> DataFrame:
    """leaves (key, id, ts, base, body) -> (key, body): all leaves of a key, applied oldest first."""

    def each(found: object, columns: list[list]) -> Iterator[tuple]:
        _, bases, bodies = columns
        base = json.loads(bases[0]) if bases[0] else {"children": []}
        yield found, _tree(merge(base, [json.loads(b) for b in bodies if b]))

    from pyspark.sql import functions as F

    rows = leaves.select(key, "base", "body", F.struct(F.col("ts").isNull(), "ts", F.col("id").isNull(), "id").alias("_order"))  # nulls last
    return map_runs(rows, ["_order"], each, StructType([leaves.schema[key], StructField("body", StringType())]), drop=["_order"])


def compose_items(bodies: DataFrame, targets: DataFrame) -> DataFrame:
    """bodies (key, body) and targets (ref, body, deleted): references are exploded, joined and put in place."""
    from pyspark.sql import functions as F

    asked = bodies.select("key", F.explode(refs_of("body")).alias("ref"))
    known = asked.join(targets.select("ref", F.struct(F.lit(True).alias("known"), "deleted", F.col("body").alias("tree")).alias("t")), "ref")
    listed = known.groupBy("key").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("ref", "t")))).alias("targets"))

    @pandas_udf(StringType())
    def put(body: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for b, t in zip(body, found, strict=True):
            known = {k: None if v.get("deleted") else json.loads(v["tree"]) for k, v in json.loads(t or "{}").items()}
            out.append(None if b is None else _tree(compose(json.loads(b), known)))
        return pd.Series(out)

    return bodies.join(listed, "key", "left").select("key", put("body", "targets").alias("body"))
