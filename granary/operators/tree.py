"""Documents as tables of nodes, measured as trees, and rewritten by rules.

Trees are walked with a list of open containers, never by recursion.  Of repeated keys the last counts,
and objects are walked and written in the order of their keys.
"""

from __future__ import annotations

import copy
import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scan import REPORT, Broken, Meter, Report, Unfit, distinct, events, position, reports
from granary.functions.text import free, numbered
from granary.policy import Limits

#: A node is [kind, content]: a dict for an object, a list for an array, else the decoded text or the lexeme.
Node = list


class _Lexeme(str):
    """A number as it was written."""


def _refused(word: str):
    raise ValueError(word)


_DECODER = json.JSONDecoder(parse_int=_Lexeme, parse_float=_Lexeme, parse_constant=_refused)
#: What the library's decoder lets pass though it is no valid text.
_SURROGATE = re.compile(r"[\ud800-\udfff]|\\u[dD][89a-fA-F]")
_WORDS = {True: "true", False: "false"}


def _quickly(text: str) -> Node | None:
    """The tree, by the library's decoder; none where the text is invalid, nested too deep for it or may hold a lone surrogate."""
    if _SURROGATE.search(text):
        return None
    try:
        value = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    out: list[Node] = [None]
    todo: list[tuple] = [(out, 0, value)]
    while todo:
        into, at, v = todo.pop()
        kind = type(v)
        if kind is dict:
            into[at] = ["object", v]
            todo += [(v, k, c) for k, c in v.items()]
        elif kind is list:
            into[at] = ["array", v]
            todo += [(v, i, c) for i, c in enumerate(v)]
        elif kind is str:
            into[at] = ["string", v]
        elif kind is _Lexeme:
            into[at] = ["number", str(v)]
        else:
            into[at] = ["null", "null"] if v is None else ["boolean", _WORDS[v]]
    return out[0]


def build(text: str) -> Node:
    """The tree of a valid text; raises Unfit otherwise."""
    quick = _quickly(text)
    if quick is not None:
        return quick
    report = Report()
    open_: list[Node] = []
    root: Node | None = None
    for e in events(text, Meter(Limits(), report), report):
        if e[0] == "end":
            open_.pop()
            continue
        _, _, place, kind, lexeme = e
        node = [kind, {} if kind == "object" else [] if kind == "array" else lexeme]
        if not open_:
            root = node
        elif open_[-1][0] == "object":
            open_[-1][1][place] = node
        else:
            open_[-1][1].append(node)
        if kind in ("object", "array"):
            open_.append(node)
    return root


def _children(node: Node) -> list[tuple[int | None, str | None, Node]]:
    if node[0] == "array":
        return [(i, None, c) for i, c in enumerate(node[1])]
    if node[0] == "object":
        return [(None, k, node[1][k]) for k in sorted(node[1])]
    return []


def _size(node: Node) -> int | None:
    """Bytes of a text or number, members of a container."""
    kind, content = node
    if kind in ("object", "array"):
        return len(content)
    return len(content.encode()) if kind in ("string", "number") else None


def render(node: Node) -> str:
    """Compact JSON, keys sorted, numbers as they were written."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        kind, content = x
        if kind == "string":
            out.append(quote(content))
        elif kind in ("number", "boolean", "null"):
            out.append(content)
        else:
            first, last = "{}" if kind == "object" else "[]"
            parts: list = [first]
            for n, (_, key, child) in enumerate(_children(x)):
                parts += ([","] if n else []) + ([quote(key) + ":"] if key is not None else []) + [child]
            todo += reversed([*parts, last])
    return "".join(out)


def quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _admit(meter: Meter, node: Node, key: str | None, depth: int) -> None:
    """Charges a key and its value; a container's members are counted when it is entered."""
    if key is not None:
        meter.key(len(key.encode()))
    kind, content = node
    if kind == "string":
        meter.value(depth, "string_bytes", _size(node))
    elif kind == "number":
        meter.value(depth, "number_bytes", len(content))
    else:
        if kind in ("array", "object"):
            meter._point("depth", depth)
            meter.count("items" if kind == "array" else "entries", len(content))
        meter.value(depth)


def account(text: str, limits: Limits = Limits()) -> Report:
    """What a text measures as a tree: repeated keys once, containers admitted whole before their members."""
    report = Report()
    try:
        root = build(text)
    except Unfit as e:
        report.reason = e.reason
        report.offset, report.line, report.column = position(text, e.at)
        return report
    report.root = root[0] if root[0] in ("object", "array") else "other"
    meter, todo = Meter(limits, report), [(None, root, 1)]
    try:
        while todo:
            key, node, depth = todo.pop()
            _admit(meter, node, key, depth)
            todo += [(k, c, depth + 1) for _, k, c in reversed(_children(node))]
        report.valid = True
    except Broken as e:
        for k, v in e.found.items():
            setattr(report, k, v)
    return report


def account_column(text: Column, limits: Limits = Limits()) -> Column:
    """``account`` of each text; null for null.  Equal texts of a batch are measured once."""

    @F.arrow_udf(f"struct<{REPORT}>")
    def run(column: pa.Array) -> pa.Array:
        texts, at = distinct(column)
        return reports([None if t is None else account(t, limits) for t in texts]).take(at)

    return run.asNondeterministic()(text)


_NODES = [("enter_ord", pa.int64()), ("leave_ord", pa.int64()), ("depth", pa.int64()), ("loc", pa.string()), ("idx", pa.int64()), ("key", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("scalar", pa.string())]
NODES = "enter_ord bigint, leave_ord bigint, depth bigint, loc string, idx bigint, key string, kind string, bytes bigint, scalar string"


def _walked(text: str, enter: Callable[[dict], bool] | None, columns: list[list]) -> int:
    """Appends the fields of every node to ``columns``, which are in the order of _NODES; how many nodes there are."""
    try:
        root = build(text)
    except Unfit:
        return 0
    enters, leaves, depths, locs, idxs, keys, kinds, sizes, scalars = columns
    base, n, left = len(enters), 0, 0
    todo: list = [(1, "root", None, None, root)]
    while todo:
        x = todo.pop()
        if isinstance(x, int):
            leaves[x] = left
            left += 1
            continue
        depth, loc, idx, key, node = x
        kind, content = node
        inner = kind in ("object", "array")
        size = len(content) if inner else _size(node)
        for c, v in zip(columns, (n, None, depth, loc, idx, key, kind, size, None if inner else content)):
            c.append(v)
        at, n = base + n, n + 1
        if inner and content and (enter is None or enter({name: c[at] for (name, _), c in zip(_NODES, columns)})):
            todo.append(at)
            loc = "array_element" if kind == "array" else "object_value"
            todo += [(depth + 1, loc, i, k, c) for i, k, c in reversed(_children(node))]
        else:
            leaves[at] = left
            left += 1
            if enter is not None and not (inner and content):
                enter({name: c[at] for (name, _), c in zip(_NODES, columns)})
    return n


def walk(text: str, enter: Callable[[dict], bool] | None = None) -> list[dict]:
    """Every node, first to last as entered; invalid text has none.

    ``leave_ord`` counts nodes as they are left.  ``bytes`` is the size of a text or number or the number
    of members; ``scalar`` the decoded text, number or literal.  ``enter`` may look at a node and return
    false to pass over what is below it.
    """
    columns: list[list] = [[] for _ in _NODES]
    _walked(text, enter, columns)
    names = [name for name, _ in _NODES]
    return [dict(zip(names, row)) for row in zip(*columns)]


def tree_nodes(df: DataFrame, column: str, keep: list[str] | None = None, enter: Callable[[dict], bool] | None = None) -> DataFrame:
    """A row for each node of each text, with the columns ``keep`` of its document (all by default).

    ``enter`` is asked about each node, as a dict of its columns, whether what is below it is walked too.
    Documents are worked on one by one where they are read; nothing is shuffled.  Null and invalid texts
    have no rows.  Columns called like those of a node (NODES) aren't kept; rename them first.
    """
    names = [n for n, _ in _NODES]
    keep = [c for c in (df.columns if keep is None else keep) if c not in (*names, column)]
    (json_,) = free(keep, "_json")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(json_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                columns: list[list] = [[] for _ in _NODES]
                counts = [0 if t is None else _walked(t, enter, columns) for t in part.column(len(keep)).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(len(keep))], *[pa.array(c, t) for c, (_, t) in zip(columns, _NODES)]], [*keep, *names])

    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return numbered(source).mapInArrow(run, f"{head}, {NODES}" if keep else NODES)


def register_tree(spark: SparkSession, name: str = "json_tree") -> None:
    """Makes the node table a table function of SQL: ``SELECT t.* FROM docs, LATERAL json_tree(docs.text) t``."""

    class JsonTree:
        def eval(self, text: str):
            for row in walk(text) if text is not None else []:
                yield tuple(row[n] for n, _ in _NODES)

    spark.udtf.register(name, F.udtf(JsonTree, returnType=NODES))


@dataclass(frozen=True)
class Rule:
    """Replaces, or passes over, the nodes that it fits.

    A node fits if its key is in ``keys``, its kind in ``kinds`` and its depth at least ``depth``, each if
    given.  ``put`` is the JSON that takes the node's place; children of the new value are walked on.
    ``skip`` leaves what is below the node alone, and doesn't count it.
    """

    keys: frozenset[str] | None = None
    kinds: frozenset[str] | None = None
    depth: int = 1
    put: str | None = None
    skip: bool = False

    @functools.cached_property
    def tree(self) -> Node:
        """What ``put`` stands for."""
        return build(self.put)

    def fits(self, key: str | None, kind: str, depth: int) -> bool:
        return (self.keys is None or key in self.keys) and (self.kinds is None or kind in self.kinds) and depth >= self.depth


@dataclass
class Mutation:
    """The rewritten text, or why there is none; what was charged stays charged."""

    text: str | None = None
    reason: str | None = None
    resource: str | None = None
    visited: int = 0
    report: Report = field(default_factory=Report)


def mutate(text: str, rules: tuple[Rule, ...], limits: Limits = Limits(), on_limit: str = "abort", put: str = '"[redacted]"', visit: Callable[[dict], Rule | None] | None = None) -> Mutation:
    """Walks the tree, charges each node as it was, and applies the first rule that fits.

    ``visit`` is a caller's own choice: it is told of each node that no rule fits (depth, key, kind and, of
    scalars, the text) and may return a rule to apply to it.

    A node over a limit ends the walk (``abort``), stays with all below it (``skip``), or is replaced by
    ``put`` (``replace``); neither is walked further.
    """
    out = Mutation()
    try:
        root = build(text)
    except Unfit as e:
        out.reason = e.reason
        return out
    meter, todo = Meter(limits, out.report), [(None, root, 1)]
    while todo:
        key, node, depth = todo.pop()
        try:
            _admit(meter, node, key, depth)
        except Broken as e:
            if on_limit == "abort":
                out.resource = e.found["resource"]
                return out
            if on_limit == "replace":
                node[:] = build(put)
            continue
        out.visited += 1
        rule = next((r for r in rules if r.fits(key, node[0], depth)), None)
        if rule is None and visit is not None:
            rule = visit({"depth": depth, "key": key, "kind": node[0], "scalar": None if node[0] in ("object", "array") else node[1]})
        if rule and rule.put is not None:
            node[:] = copy.deepcopy(rule.tree) if rule.tree[0] in ("object", "array") else rule.tree
        if not (rule and rule.skip):
            todo += [(k, c, depth + 1) for _, k, c in reversed(_children(node))]
    out.text = render(root)
    return out


def mutate_column(text: Column, rules: tuple[Rule, ...] = (), limits: Limits = Limits(), on_limit: str = "abort", put: str = '"[redacted]"', visit: Callable[[dict], Rule | None] | None = None) -> Column:
    """(text, reason, resource, visited) for each text, by ``mutate``; null for null.

    Equal texts of a batch are rewritten once, unless ``visit`` is given, which is told of every row.
    """
    kind = pa.struct([("text", pa.string()), ("reason", pa.string()), ("resource", pa.string()), ("visited", pa.int64())])

    @F.arrow_udf("struct<text: string, reason: string, resource: string, visited: bigint>")
    def run(column: pa.Array) -> pa.Array:
        texts, at = distinct(column) if visit is None else (column.to_pylist(), None)
        made = [None if t is None else mutate(t, rules, limits, on_limit, put, visit) for t in texts]
        parts = [pa.array([m and getattr(m, f.name) for m in made], f.type) for f in kind]
        out = pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array([m is None for m in made], pa.bool_()))
        return out if at is None else out.take(at)

    return run.asNondeterministic()(text)


def redact(text: Column, keys: list[str], put: str = '"[redacted]"') -> Column:
    """The text with the values of some keys replaced, at any depth; null where it is no JSON."""
    return mutate_column(text, (Rule(keys=frozenset(keys), put=put),))["text"]
