"""Splitting of oversized samples at natural boundaries.

A sample's size is the number of characters of content, reasoning and call arguments of all its
messages.  What is within the limit stays one piece.  The rest is bisected: the range is cut at the
strongest boundary near its midpoint, and halves above (limit - overlap) are cut again; every piece
but the first then repeats the end of the one before: its last message if that is whole, ends there
and is no longer than the overlap, else exactly ``overlap`` characters.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.session import document_batches

LIMIT, OVERLAP = 7_000, 350
STEP, MESSAGE, PARAGRAPH, LINE, WORD = 5, 4, 3, 2, 1
NAMES = {STEP: "step", MESSAGE: "message", PARAGRAPH: "paragraph", LINE: "line", WORD: "word", 0: "character"}
_PARAGRAPHS, _LINES, _SPACES = re.compile(r"\n[^\S\n]*\n+"), re.compile(r"\n|\r(?!\n)"), re.compile(r"\s+")


def size_of(messages: str | Column) -> Column:
    """Characters of content, reasoning_content and call arguments over all messages; null counts 0."""
    length = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("bigint")
    calls = lambda m: F.aggregate(F.coalesce(m["tool_calls"], F.array()), F.lit(0).cast("bigint"), lambda n, c: n + length(c["function"]["arguments"]))
    total = F.aggregate(messages, F.lit(0).cast("bigint"), lambda n, m: n + length(m["content"]) + length(m["reasoning_content"]) + calls(m))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def boundaries(fields: list[tuple[int, str, str, bool]]) -> tuple[str, list[int], dict[int, list[int]]]:
    """The text of a sample, where its messages begin, and the cut positions of each strength.

    ``fields``: (message, role, text, first field of the message) in order.
    """
    text, starts, cuts, at = [], [], {s: [] for s in (STEP, MESSAGE, PARAGRAPH, LINE, WORD)}, 0
    for _, role, part, first in fields:
        if first:
            starts.append(at)
        cuts[(STEP if role == "assistant" else MESSAGE) if first else PARAGRAPH].append(at)
        for strength, found in ((PARAGRAPH, _PARAGRAPHS), (LINE, _LINES), (WORD, _SPACES)):
            cuts[strength] += [at + m.end() for m in found.finditer(part)]
        text.append(part)
        at += len(part)
    return "".join(text), starts, {s: sorted(set(p)) for s, p in cuts.items()}


def _nearest(positions: list[int], middle: int, low: int, high: int) -> int | None:
    """The position nearest to ``middle`` strictly between low and high."""
    i = bisect_left(positions, middle)
    near = [p for p in positions[max(0, i - 1) : i + 1] if low < p < high]
    return min(near, key=lambda p: abs(p - middle)) if near else None


def bisect_text(start: int, end: int, cuts: dict[int, list[int]], most: int) -> list[tuple[int, int, int]]:
    """Consecutive (start, end, strength of the cut at start) of at most ``most`` characters."""
    done, todo = [], [(start, end, -1)]
    while todo:
        low, high, strength = todo.pop()
        if high - low <= most:
            done.append((low, high, strength))
            continue
        middle, quarter = (low + high) // 2, (high - low) // 4
        found = next(((p, s) for s in (STEP, MESSAGE, PARAGRAPH, LINE) if (p := _nearest(cuts[s], middle, middle - quarter, middle + quarter)) is not None), None)
        found = found or next(((p, s) for s in (STEP, MESSAGE, PARAGRAPH, LINE) if (p := _nearest(cuts[s], middle, low, high)) is not None), None)
        found = found or next(((p, WORD) for p in [_nearest(cuts[WORD], middle, low, high)] if p is not None), (middle, 0))
        todo += [(found[0], high, found[1]), (low, found[0], strength)]
    return done


def split(fields: list[tuple[int, str, str, bool]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple]:
    """(start, end, characters repeated, cut, text) of each piece; start is where the repetition begins."""
    text, starts, cuts = boundaries(fields)
    if len(text) <= limit:
        return [(0, len(text), 0, "start", text)]
    pieces, before = [], None
    for low, high, strength in bisect_text(0, len(text), cuts, limit - overlap):
        back = 0
        if before is not None:
            back = min(overlap, low - before)
            if strength >= MESSAGE:
                last = low - starts[max(0, bisect_left(starts, low) - 1)]
                back = last if 0 < last <= back else back
        pieces.append((low - back, high, back, NAMES.get(strength, "start"), text[low - back : high]))
        before = low
    return pieces


def _fields(messages) -> list[tuple[int, str, str, bool]]:
    out = []
    for n, m in enumerate(messages):
        parts = [m.get("content"), m.get("reasoning_content"), *(c for c in m.get("arguments") or ())]
        out += [(n, m.get("role"), p or "", i == 0) for i, p in enumerate(parts) if p or i == 0]
    return out


def split_oversized(df: DataFrame, id_col: str, messages: str = "messages", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every row: (id, piece_no from 1, n_pieces, start, stop, repeated, cut, text).

    Only rows above the limit go through Python.  A row with null or no messages is one empty piece;
    repeated rows give repeated pieces; other columns of ``df`` are not read.
    """
    if not 0 <= overlap * 2 < limit:
        raise ValueError("the overlap must be less than half the limit")
    document_batches(df.sparkSession, 200)
    kind = df.schema[id_col].dataType.simpleString()
    args = lambda m: F.transform(m["tool_calls"], lambda c: c["function"]["arguments"])
    slim = df.select(F.col(id_col).alias("_id"), F.col(messages).alias("_m")).withColumn("_n", size_of("_m"))
    texts = F.transform("_m", lambda m: F.concat(F.array(F.coalesce(m["content"], F.lit("")), F.coalesce(m["reasoning_content"], F.lit(""))),
                                                 F.transform(F.coalesce(args(m), F.array()), lambda a: F.coalesce(a, F.lit("")))))
    small = slim.filter(F.col("_n") <= limit).select(
        F.col("_id").alias(id_col), F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.col("_n").cast("int").alias("stop"),
        F.lit(0).alias("repeated"), F.lit("start").alias("cut"), F.coalesce(F.array_join(F.flatten(texts), ""), F.lit("")).alias("text"))
    document = F.to_json(F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"),
                                                              m["reasoning_content"].alias("reasoning_content"), args(m).alias("arguments"))))
    schema = pa.schema([("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()),
                       ("stop", pa.int32()), ("repeated", pa.int32()), ("cut", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, take = [], []
            for i, doc in enumerate(batch.column(1).to_pylist()):
                pieces = split(_fields(json.loads(doc)), limit, overlap)
                rows += [(n, len(pieces), *p) for n, p in enumerate(pieces, 1)]
                take += [i] * len(pieces)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *columns], names=[id_col, *schema.names])

    large = slim.filter(F.col("_n") > limit).select("_id", document.alias("_doc")).mapInArrow(
        run, f"`{id_col}` {kind}, piece_no int, n_pieces int, start int, stop int, repeated int, cut string, text string")
    return small.unionByName(large)


def oversized(df: DataFrame, id_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids of the rows that were cut."""
    return split_oversized(df, id_col, "messages", limit, overlap).filter("piece_no = 2").select(id_col).distinct()
