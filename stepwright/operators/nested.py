"""Flat tables of deeply nested, loosely typed records, linked by interval labels.

A depth-first walk gives every object of a record a pre-order and a post-order number; an object
contains another one exactly if its interval (pre, post) encloses the other's.  Each typed object
(step, call, answer, match) becomes a row that keeps its interval, the interval of the typed object
around it and its place among its siblings, so that a table per type can be joined with any other
by containment, without the nesting and without positions in JSON paths.

The walk needs one record at a time, so nothing is shuffled; a record that cannot be parsed (cut
off) has no rows.  Records with the same key stay apart: links never leave a record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.session import document_batches

#: One row for each typed object.  ``parent_pre`` is the pre-order number of the typed object around
#: it (the record itself has number 0), ``ord`` its place among objects of its kind there, from 1.
NODE_SCHEMA = (
    "holder string, record_key string, kind string, pre bigint, post bigint, parent_pre bigint, depth int, "
    "ord int, step_index int, node_id string, role string, name string, body string, answered boolean, score double"
)
KINDS = ("step", "call", "answer", "match")
_ARROW = pa.schema(
    [("holder", pa.string()), ("record_key", pa.string()), ("kind", pa.string()), ("pre", pa.int64()), ("post", pa.int64()),
     ("parent_pre", pa.int64()), ("depth", pa.int32()), ("ord", pa.int32()), ("step_index", pa.int32()), ("node_id", pa.string()),
     ("role", pa.string()), ("name", pa.string()), ("body", pa.string()), ("answered", pa.bool_()), ("score", pa.float64())]
)


def decoded(value):
    """``value`` with JSON text in place of a list or object parsed, however often it was encoded."""
    while isinstance(value, str):  # each turn makes it shorter
        text = value.strip()
        if text[:1] not in ("[", "{", '"'):
            return None
        value = json.loads(text)
    return value


def _safe(value):
    try:
        return decoded(value)
    except ValueError:
        return None


def _entries(value) -> list:
    """The entries of a list that may also be one object, JSON text or missing."""
    if isinstance(value, str):
        value = _safe(value)
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def _object(value) -> dict:
    value = _safe(value) if isinstance(value, str) else value
    return value if isinstance(value, dict) else {}


def _text(value) -> str | None:
    """A string as it is, text parts joined, anything else as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list) and value and all(isinstance(x, dict) and isinstance(x.get("text"), str) for x in value):
        return "\n".join(x["text"] for x in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _turns(messages: list) -> list[dict]:
    """Messages as steps: an assistant message and what follows up to the next one."""
    steps: list[dict] = []
    for message in messages:
        message = _object(message)
        if message.get("role") == "assistant":
            steps.append({"assistant": message, "tail": []})
        elif steps:
            steps[-1]["tail"].append(message)
    return steps


def _calls(assistant: dict, actions: bool) -> list[tuple]:
    """(id, name, arguments) of each call: tool_calls, or the actions where there are none."""
    found = []
    for call in _entries(assistant.get("tool_calls")):
        if isinstance(call, dict):
            function = _object(call.get("function"))
            found.append((call.get("id"), function.get("name"), function.get("arguments")))
    if not found and actions:
        for action in _entries(_object(assistant.get("extra")).get("actions")):
            if isinstance(action, dict):
                found.append((action.get("tool_call_id"), None, action.get("command")))
    return found


class _Walk:
    """Depth-first numbering of one record's objects."""

    def __init__(self, body: bool):
        self.count = 0
        self.nodes: list[list] = []  # kind, pre, post, depth, node_id, role, name, body, score
        self.depth = 0
        self.body = body

    def enter(self, kind: str, node_id=None, role=None, name=None, body=None, score=None) -> list:
        self.count += 1
        self.depth += 1
        node = [kind, self.count, 0, self.depth, node_id, role, name, _text(body) if self.body else None, score]
        self.nodes.append(node)
        return node

    def leave(self, node: list) -> None:
        self.count += 1
        self.depth -= 1
        node[2] = self.count

    def leaf(self, *args, **kwargs) -> None:
        self.leave(self.enter(*args, **kwargs))


def label(document, actions: bool = True, body: bool = True) -> list[list]:
    """The typed objects of a parsed record in pre-order, each with its interval."""
    walk = _Walk(body)
    matches: list = []
    if isinstance(document, dict):
        if "steps" not in document and isinstance(document.get("result"), (dict, str)):
            document = _object(document["result"])
        matches = _entries(_object(document.get("reward_details")).get("matches"))
        steps = document.get("steps")
        steps = decoded(steps) if isinstance(steps, str) else steps
        steps = steps if isinstance(steps, list) else []
    else:
        steps = document if isinstance(document, list) else []
    for step in steps:
        step = _object(step)
        assistant = _object(step.get("assistant"))
        node = walk.enter("step", role="assistant", body=assistant.get("content"), name=None)
        for call_id, name, arguments in _calls(assistant, actions):
            walk.leaf("call", node_id=call_id, name=name, body=arguments)
        for answer in _entries(step.get("tail")):
            answer = _object(answer)
            walk.leaf("answer", node_id=answer.get("tool_call_id"), role=answer.get("role"), body=answer.get("content"))
        walk.leave(node)
    for match in matches:
        match = _object(match)
        depth = match.get("depth")
        walk.leaf("match", body={k: match.get(k) for k in ("pred", "gold")}, score=float(depth) if isinstance(depth, (int, float)) else None)
    return walk.nodes


def linked(nodes: list[list]) -> Iterator[tuple]:
    """Each object with the interval around it, its place there and, for calls, whether an answer of
    the same step bears its id.  One sweep in pre-order; the stack holds the intervals still open."""
    stack: list[list] = []
    places: dict[tuple, int] = {}
    answers: dict[int, set] = {}
    parents: list[int] = []
    for node in nodes:
        while stack and stack[-1][2] < node[1]:
            stack.pop()
        parent = stack[-1][1] if stack else 0
        parents.append(parent)
        if node[0] == "answer" and node[5] == "tool" and node[4] is not None:
            answers.setdefault(parent, set()).add(node[4])
        stack.append(node)
    step_index: dict[int, int] = {}
    for node, parent in zip(nodes, parents, strict=True):
        place = places[parent, node[0]] = places.get((parent, node[0]), 0) + 1
        if node[0] == "step":
            step_index[node[1]] = place
        answered = node[4] is not None and node[4] in answers.get(parent, ()) if node[0] == "call" else None
        yield node, parent, place, step_index.get(node[1] if node[0] == "step" else parent), answered


def _as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def interval_nodes(records: DataFrame, holder: str, key: Column, document: Column, *, messages: bool = False,
                   actions: bool = True, kinds: tuple[str, ...] = KINDS, body: bool = True) -> DataFrame:
    """The typed objects of ``document`` (JSON text) of every record as rows of ``NODE_SCHEMA``.

    ``messages``: the document is a list of messages, not of steps.  ``kinds`` restricts the rows that
    leave the Python worker; ``body`` says whether their text goes with them.  A null, blank or cut-off
    document gives no rows, a null key stays null; other columns of ``records`` are never read.
    """
    document_batches(records.sparkSession)
    wanted = frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _ARROW]
            for record_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    value = decoded(text)
                    nodes = label({"steps": _turns(value)} if messages and isinstance(value, list) else value, actions, body)
                except (ValueError, RecursionError):
                    continue
                for node, parent, place, step, answered in linked(nodes):
                    if node[0] in wanted:
                        row = (holder, record_key, node[0], node[1], node[2], parent, node[3], place, step,
                               _as_text(node[4]), _as_text(node[5]), _as_text(node[6]), node[7], answered, node[8])
                        for column, cell in zip(columns, row, strict=True):
                            column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return records.select(key.alias("record_key"), document.alias("document")).mapInArrow(run, NODE_SCHEMA)


def _key(*parts: str) -> Column:
    """The parts of a key with | between them; a null part is left out."""
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


def holders(build_dataset: DataFrame, nodes: DataFrame, rollouts: DataFrame, **options) -> DataFrame:
    """The labelled objects of the three nested holders in one table."""
    messages = F.to_json(
        F.transform(
            "messages",
            lambda m: F.struct(
                m["role"].alias("role"), *([m["content"].alias("content")] if options.get("body", True) else []),
                m["tool_call_id"].alias("tool_call_id"),
                F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), *([c["function"].alias("function")] if options.get("body", True) else []))).alias("tool_calls"),
            ),
        )
    )
    return (
        interval_nodes(build_dataset, "build_dataset", F.col("row_id").cast("string"), messages, messages=True, actions=False, **options)
        .unionByName(interval_nodes(nodes, "nodes", _key("instance_id", "node_key"), F.col("prefix_json"), **options))
        .unionByName(interval_nodes(rollouts, "rollouts", _key("instance_id", "node_key", "rollout_idx"), F.col("result_json"), **options))
    )


def table_of(labelled: DataFrame, kind: str) -> DataFrame:
    """The flat table of one type; every row leads to its parent by (holder, record_key, parent_pre)."""
    place = [F.col(c) for c in ("holder", "record_key", "pre", "post", "parent_pre", "ord", "step_index")]
    own = {
        "step": [F.col("body").alias("content")],
        "call": [F.col("node_id").alias("call_id"), F.col("name"), F.col("body").alias("arguments"), F.col("answered")],
        "answer": [F.col("node_id").alias("call_id"), F.col("role"), F.col("body").alias("content")],
        "match": [F.col("score").alias("matched_depth"), F.col("body").alias("pair")],
    }[kind]
    return labelled.filter(F.col("kind") == kind).select(*place, *own)


def unanswered_calls(build_dataset: DataFrame, nodes: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Calls without an answer of the same step, distinct by (holder, record_key, step_index, call_id).

    A call without an id can have no answer and is reported with a null id.
    """
    labelled = holders(build_dataset, nodes, rollouts, kinds=("call",), body=False)
    return labelled.filter(~F.col("answered")).select("holder", "record_key", "step_index", F.col("node_id").alias("call_id")).distinct()
