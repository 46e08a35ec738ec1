"""Deeply nested session records as related flat tables.

Each JSON body is parsed once and read by a *tree automaton* from its leaves up: the state of a node
follows from the states of its children and the keys they stand under (``TRANSITIONS``), the state of a
list from those of all its elements.  The state routes a node to its typed table (turns, calls,
excerpts, originals, images, further matches, errors).  Where a writer uses none of the usual keys for a role, the child
whose state fits the role takes it, so renamed keys are routed by structure.  All tables keep the
common supertype keys (record, turn, kind) and the number of the node that holds them.  Reading order
numbers the calls of a turn from 1 and the excerpts of a call from 1 over all of its pages.

Defined results: bodies that are null or no whole JSON text give no rows; repeated deliveries of a
record count once (the first whole body by ``received_at``); lists that hold one object may be that
object; text that holds JSON is read as that JSON; numbers, null and mere counts give no rows; keys
that a writer doesn't use are null.  A JSON text nested deeper than the parser's limit counts as not
whole.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The keys under which writers put the same thing.
TURNS, CALLS, ORIGINALS, FOLLOW_UPS = "turns", "toolCalls", "originalsRequested", "followUps"

NODE_SCHEMA = (
    "record_id long, turn int, kind string, parent_no int, item_no int, shape string, "
    "id string, name string, arguments string, error_code string, fallback_reason string, "
    "text string, path string, start_line int, end_line int, complete_span boolean, score double, "
    "artifact_id string, width int, height int, reason string, question string, answer string, "
    "gold string, summary string, auto_original string, threshold_exceeded string, compacted_after string, other string, "
    "region string, details string, match_count int, match_lines string"
)


def _no_constant(_: str) -> None:
    raise ValueError("not JSON")


def parse(text: Any) -> Any:
    """The JSON value of a whole text; None (as for JSON null) when it isn't one."""
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


#: What JSON allows around a value.
_BLANKS = " \t\r\n"


def _opened(x: Any) -> Any:
    """JSON inside of a string, read as many times as it was written."""
    inner = x
    while isinstance(inner, str) and inner.lstrip(_BLANKS)[:1] in ("[", "{", '"'):  # each layer of quotes is strictly shorter
        inner = parse(inner)
    return inner if isinstance(inner, (dict, list)) else x


SCALARS = frozenset({"null", "str", "int", "float", "bool"})
_RESULTS = frozenset({"excerpt_result", "image_result", "paged_result"})
_CALLS, _ORIGINALS = frozenset({"call", "list<call>"}), frozenset({"original", "list<original>"})

#: (state, keys that must be there and whether their children must hold something, states of which a child must be
#: in one).  The first transition that fits gives the state; keys are those of the usual writers, children's states
#: tell the same things under other keys.
TRANSITIONS: list[tuple[str, dict[str, bool], frozenset[str]]] = [
    ("session", {"turns": True}, frozenset()),
    ("session", {}, frozenset({"list<turn>", "map<turn>"})),
    ("envelope", {"run": True}, frozenset()),
    ("envelope", {}, frozenset({"session", "envelope", "list<session>", "list<envelope>"})),
    ("call", {"function": False}, frozenset()),
    ("call", {"id": False, "result": False}, frozenset()),
    ("call", {"id": False, "error": False}, frozenset()),
    ("call", {"followUps": False}, frozenset()),
    ("call", {"id": False, "name": False}, frozenset()),
    ("call", {"id": False, "arguments": False}, frozenset()),
    ("call", {}, _RESULTS | {"function"}),
    ("excerpt", {"sourceMap": False}, frozenset()),
    ("excerpt", {}, frozenset({"source_map"})),
    ("paged_result", {"pages": False}, frozenset()),
    ("paged_result", {}, frozenset({"list<excerpt_result>"})),
    ("excerpt_result", {"excerpts": False}, frozenset()),
    ("excerpt_result", {}, frozenset({"list<excerpt>"})),
    ("image_result", {"images": False}, frozenset()),
    ("turn", {"question": False}, frozenset()),
    ("turn", {"answer": False}, frozenset()),
    ("turn", {"type": False, "gold": False}, frozenset()),
    ("turn", {}, _CALLS | _ORIGINALS),
    ("original", {"artifactId": False}, frozenset()),
    ("original", {"artifact_id": False}, frozenset()),
    ("source_map", {"path": False, "startLine": False}, frozenset()),
    ("source_map", {"path": False, "endLine": False}, frozenset()),
    ("function", {"name": False, "arguments": False}, frozenset()),
]


def transition(children: dict[str, str]) -> str:
    """State of an object from its children's states by key."""
    states = frozenset(children.values())
    for state, keys, some in TRANSITIONS:
        if keys.keys() <= children.keys() and all(not held or children[k] not in SCALARS for k, held in keys.items()) and (not some or some & states):
            return state
    return "map<turn>" if states == {"turn"} else "object"


def list_state(elements: set[str]) -> str:
    """State of a list from those of all its elements; null elements say nothing."""
    known = elements - {"null"}
    return "list<" + (known.pop() if len(known) == 1 else "mixed" if known else "") + ">"


@lru_cache(maxsize=1 << 14)
def _settled(children: tuple[tuple[str, str], ...]) -> str:
    return transition(dict(children))


_SCALAR = {str: "str", int: "int", float: "float", bool: "bool", type(None): "null"}


#: How a string that may hold JSON begins, blanks included.
_OPENERS = frozenset('[{" \t\r\n')


class Tree:
    """A parsed body with the state of each of its objects and lists, JSON in strings included."""

    def __init__(self, root: Any) -> None:
        self._opened: dict[str, Any] = {}
        self._states: dict[int, str] = {}
        self.root = self.open(root)
        stack = [(self.root, False)]
        while stack:
            node, seen = stack.pop()
            if not isinstance(node, (dict, list)):
                continue
            if seen:
                self._states[id(node)] = self._settle(node)
                continue
            stack.append((node, True))
            for c in node.values() if isinstance(node, dict) else node:
                if isinstance(c, str):
                    if c[:1] in _OPENERS:
                        c = self.open(c)
                    else:
                        continue
                if isinstance(c, (dict, list)):
                    stack.append((c, False))

    def _settle(self, node: Any) -> str:
        if isinstance(node, list):
            return list_state({self.state(x) for x in node})
        return _settled(tuple([(k, self.state(v)) for k, v in node.items()]))

    def open(self, x: Any) -> Any:
        """What a string that holds JSON holds, the same object each time."""
        if not isinstance(x, str) or x.lstrip(_BLANKS)[:1] not in ("[", "{", '"'):
            return x
        if x not in self._opened:
            self._opened[x] = _opened(x)
        return self._opened[x]

    def state(self, x: Any) -> str:
        if isinstance(x, str):
            if x[:1] not in _OPENERS:
                return "str"
            x = self.open(x)
        return self._states[id(x)] if isinstance(x, (dict, list)) else _SCALAR[type(x)]

    def many(self, x: Any) -> list[Any]:
        """A list, a single thing in place of a list, or nothing."""
        x = self.open(x)
        if isinstance(x, list):
            return x
        return [x] if isinstance(x, (dict, str)) and x else []

    def child(self, node: dict[str, Any], key: str, states: frozenset[str], but: tuple[str, ...] = ()) -> Any:
        """What stands under ``key``, else the first child in one of ``states``."""
        if key in node:
            return node[key]
        return next((v for k, v in node.items() if k not in but and self.state(v) in states), None)


def shape(node: Any) -> str:
    """State of a node's tree."""
    return Tree(node).state(node)


def _session(tree: Tree) -> dict[str, Any] | None:
    """The object in the state of a session, inside of any envelopes; one with a mere count of turns only without another."""
    queue, counts = deque([tree.root]), None
    while queue:  # breadth first; the parsed body is finite, and so are the layers of its strings
        x = queue.popleft()
        if isinstance(x, dict):
            if tree.state(x) == "session":
                return x
            if TURNS in x:
                counts = counts or x
        if isinstance(x, (dict, list)):
            queue.extend(o for v in (x.values() if isinstance(x, dict) else x) if isinstance(o := tree.open(v), (dict, list)))
    return counts


def _holds_session(body: Any) -> bool:
    """Whether a parsed body has a session; the usual key settles it without the states."""
    queue = deque([_opened(body)])
    while queue:
        x = queue.popleft()
        if isinstance(x, dict):
            if TURNS in x:
                return True
            x = x.values()
        elif not isinstance(x, list):
            continue
        queue.extend(o for v in x if isinstance(o := _opened(v), (dict, list)))
    return _session(Tree(body)) is not None


def _turns(tree: Tree, session: dict[str, Any]) -> Iterator[tuple[int, dict[str, Any]]]:
    turns = tree.open(tree.child(session, TURNS, frozenset({"list<turn>", "map<turn>"})))
    pairs = turns.items() if isinstance(turns, dict) and tree.state(turns) != "turn" else enumerate(tree.many(turns), 1)
    for key, t in pairs:
        t = tree.open(t)
        if not isinstance(t, dict):
            continue
        no = t.get("turn", key)
        try:
            yield int(no), t
        except (TypeError, ValueError):
            continue


def _excerpts(tree: Tree, result: Any) -> Iterator[Any]:
    """Excerpts of a call's result in reading order, those of its pages included."""
    result = tree.open(result)
    if isinstance(result, list):
        for r in result:
            yield from _excerpts(tree, r) if tree.state(r) != "excerpt" else [tree.open(r)]
        return
    if not isinstance(result, dict):
        return
    if tree.state(result) == "excerpt":
        yield result
        return
    own, paged = "excerpts" in result, "pages" in result
    for key, v in result.items():
        if key == "excerpts" or not own and tree.state(v) == "list<excerpt>":
            yield from (x for x in map(tree.open, tree.many(v)) if isinstance(x, (dict, str)))
        elif key == "pages" or not paged and tree.state(v) == "list<excerpt_result>":
            for page in tree.many(v):
                yield from _excerpts(tree, page)


def _results(tree: Tree, result: Any) -> Iterator[dict[str, Any]]:
    """The objects of a call's result, its pages included."""
    result = tree.open(result)
    if isinstance(result, list):
        for r in result:
            yield from _results(tree, r)
    elif isinstance(result, dict) and tree.state(result) != "excerpt":
        yield result
        for page in tree.many(tree.child(result, "pages", frozenset({"list<excerpt_result>"}))):
            yield from _results(tree, page)


def _int(x: Any) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 2**31 else None


def _text(x: Any) -> str | None:
    if x is None:
        return None
    s = x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)
    return s.encode("utf-8", "replace").decode("utf-8")


def _variants(tree: Tree, result: Any, error: Any) -> Iterator[dict[str, Any]]:
    """Images, further matches and errors of a call."""
    parts = list(_results(tree, result))
    images = [x for r in parts for x in map(tree.open, tree.many(r.get("images"))) if isinstance(x, (dict, str)) and x]
    for k, x in enumerate(images, 1):
        yield {"kind": "image", "item_no": k} | ({"shape": tree.state(x), "artifact_id": _text(x.get("artifactId", x.get("artifact_id"))), "width": _int(x.get("width")), "height": _int(x.get("height")), "region": _text(tree.open(x.get("region"))), "other": _rest(x, {"artifactId", "artifact_id", "width", "height", "region"})} if isinstance(x, dict) else {"shape": "id", "artifact_id": _text(x)})
    for k, x in enumerate((x for r in parts if isinstance(x := tree.open(r.get("moreMatches")), dict)), 1):
        yield {"kind": "more_matches", "item_no": k, "shape": tree.state(x), "match_count": _int(x.get("count")), "match_lines": _text(tree.open(x.get("lines"))), "other": _rest(x, {"count", "lines"})}
    for k, x in enumerate((x for x in map(tree.open, tree.many(error)) if x), 1):
        own = isinstance(x, dict)
        yield {"kind": "error", "item_no": k, "shape": tree.state(x), "error_code": _text(x.get("code") if own else x), "details": _text(tree.open(x.get("details"))) if own else None, "other": _rest(x, {"code", "details"}) if own else None}


_TURN_KEYS = {"turn", "type", "question", "answer", "gold", "summary", "autoOriginal", "thresholdExceeded", "compactedAfter", CALLS, ORIGINALS}


def _rest(x: dict[str, Any], known: set[str]) -> str | None:
    """Fields that have no column, as one JSON object."""
    return _text({k: v for k, v in x.items() if k not in known} or None)


def _rows(record_id: int, body: str | None, every: bool = False) -> Iterator[dict[str, Any]]:
    tree = Tree(parse(body))
    session = _session(tree)
    if session is None:
        return
    for turn, t in _turns(tree, session):
        base = {"record_id": record_id, "turn": turn}
        yield base | {"kind": "turn", "parent_no": 0, "item_no": turn, "shape": "turn", "name": _text(t.get("type")), "question": _text(t.get("question")), "answer": _text(t.get("answer"))} | {
            "gold": _text(t.get("gold")), "summary": _text(t.get("summary")), "auto_original": _text(t.get("autoOriginal")), "threshold_exceeded": _text(t.get("thresholdExceeded")), "compacted_after": _text(t.get("compactedAfter")), "other": _rest(t, _TURN_KEYS),
        }
        no = 0
        stack = [(c, 0) for c in reversed(tree.many(tree.child(t, CALLS, _CALLS)))]
        while stack:
            call, parent = stack.pop()
            call = tree.open(call)
            if not isinstance(call, dict) and not (isinstance(call, str) and call):
                continue
            no += 1
            own = no
            if isinstance(call, str):
                yield base | {"kind": "tool_call", "parent_no": parent, "item_no": own, "shape": "id", "id": _text(call)}
                continue
            f = tree.child(call, "function", frozenset({"function"}))
            f = f if isinstance(f, dict) else call
            result, error = tree.open(tree.child(call, "result", _RESULTS | {"list<excerpt>", "excerpt"})), call.get("error")
            yield base | {
                "kind": "tool_call", "parent_no": parent, "item_no": own,
                "shape": "call:" + (tree.state(result) if result is not None else "error" if error else "open"),
                "id": _text(call.get("id")), "name": _text(f.get("name")), "arguments": _text(tree.open(f.get("arguments"))),
                "error_code": _text(error.get("code")) if isinstance(error, dict) else _text(error),
                "fallback_reason": _text(result.get("fallbackReason")) if isinstance(result, dict) else None,
            }
            for k, x in enumerate(_excerpts(tree, result), 1):
                row = base | {"kind": "excerpt", "parent_no": own, "item_no": k, "shape": tree.state(x)}
                if isinstance(x, dict):
                    m = x.get("sourceMap") if isinstance(x.get("sourceMap"), dict) else {}
                    score = x.get("score")
                    row |= {"text": _text(x.get("text")), "path": _text(m.get("path")), "start_line": _int(m.get("startLine")), "end_line": _int(m.get("endLine")), "complete_span": m.get("completeSpan") if isinstance(m.get("completeSpan"), bool) else None, "score": float(score) if isinstance(score, (int, float)) else None}
                else:
                    row |= {"text": _text(x)}
                yield row
            if every:
                yield from (base | {"parent_no": own} | x for x in _variants(tree, result, error))
            stack += [(c, own) for c in reversed(tree.many(tree.child(call, FOLLOW_UPS, _CALLS)))]
        for k, o in enumerate((x for x in map(tree.open, tree.many(tree.child(t, ORIGINALS, _ORIGINALS, (CALLS,)))) if isinstance(x, (dict, str)) and x), 1):
            row = base | {"kind": "original", "parent_no": 0, "item_no": k, "shape": tree.state(o) if isinstance(o, dict) else "id"}
            if isinstance(o, dict):
                row |= {"artifact_id": _text(o.get("artifactId", o.get("artifact_id"))), "width": _int(o.get("width")), "height": _int(o.get("height")), "reason": _text(o.get("reason"))}
            else:
                row |= {"artifact_id": _text(o)}
            yield row


def whole_records(records: DataFrame) -> DataFrame:
    """``record_id, body``: the first whole delivery of each record.

    Deliveries of one record are reduced to distinct bodies by a map-side aggregate keyed by the
    body's hash before any body is parsed, so a record delivered very often costs one parse.
    """
    order = F.col("received_at") if "received_at" in records.columns else F.lit(0)
    distinct = records.where("record_id is not null and body is not null").groupBy("record_id", F.xxhash64("body").alias("h")).agg(F.first("body").alias("body"), F.min(order).alias("at"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = pdf[[_holds_session(parse(b)) for b in pdf["body"]]]
            if len(kept):  # Arrow has no type for an empty frame's columns
                yield kept

    whole = distinct.mapInPandas(keep, distinct.schema)
    return whole.groupBy("record_id").agg(F.min_by("body", F.struct("at", "h")).alias("body"))


def flatten(records: DataFrame, every: bool = False) -> DataFrame:
    """Turns, calls, excerpts and originals, with ``every`` also images, further matches and errors, in one supertype
    table (see ``NODE_SCHEMA``); the subtype tables are projections of it."""

    kinds = to_arrow_schema(StructType.fromDDL(NODE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for i, body in zip(b.column("record_id").to_pylist(), b.column("body").to_pylist()) for r in _rows(i, body, every)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return whole_records(records).mapInArrow(run, NODE_SCHEMA)


def turns_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'turn'").select("record_id", "turn", F.col("name").alias("turn_type"), "question", "answer", "gold", "summary", "auto_original", "threshold_exceeded", "compacted_after", "other")


def calls_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'tool_call'").select("record_id", "turn", F.col("item_no").alias("call_no"), F.col("parent_no").alias("parent_call_no"), "shape", "id", "name", "arguments", "error_code", "fallback_reason")


def excerpts_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'excerpt'").select("record_id", "turn", F.col("parent_no").alias("call_no"), F.col("item_no").alias("excerpt_no"), "shape", "text", "path", "start_line", "end_line", "complete_span", "score")


def originals_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'original'").select("record_id", "turn", F.col("item_no").alias("original_no"), "shape", "artifact_id", "width", "height", "reason")


def images_table(nodes: DataFrame) -> DataFrame:
    """Of ``flatten(..., every=True)``, as the next two."""
    return nodes.where("kind = 'image'").select("record_id", "turn", F.col("parent_no").alias("call_no"), F.col("item_no").alias("image_no"), "shape", "artifact_id", "width", "height", "region", "other")


def more_matches_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'more_matches'").select("record_id", "turn", F.col("parent_no").alias("call_no"), F.col("item_no").alias("result_no"), "match_count", "match_lines", "other")


def errors_table(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'error'").select("record_id", "turn", F.col("parent_no").alias("call_no"), F.col("item_no").alias("error_no"), "shape", "error_code", "details", "other")
