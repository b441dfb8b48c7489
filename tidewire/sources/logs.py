"""JSON objects in logs of any size, cut by chunks that don't know how they begin (SRC-11).

What a chunk does depends on how it is entered: outside a string, in one or after a backslash, and how deep. A chunk is one scan for each way
of entry, which gives the depth it ends at; entries so deep that the chunk can't close them behave alike. Such summaries compose, so blocks of chunks
are summed up first, then blocks are run through in order, then each block is told how it is entered and cuts its chunks. An object
over several chunks is put together from its pieces. A task runs through its rows in order and keeps a state, so short logs and blocks cost no more than their rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunk numbers of a block, which one task runs through.
BLOCK = 64
#: All that changes a state.
_MARK = re.compile(r'[{}"\\]')
TEXT, QUOTED, ESCAPED = 0, 1, 2
#: (mode, depth, begun): begun is (chunk, place) of the object that is open, or None.
Entry = tuple[int, int, tuple[int, int] | None]
OUTSIDE: Entry = (TEXT, 0, None)


def scan(text: str, mode: int, depth: int) -> tuple[int, int, int | None, int, list[tuple[int, int]]]:
    """(mode, depth, start, least, cuts) after a text: start is where the open object began if in this text, least the least depth, cuts the ends of objects.

    A cut is (start, end), start -1 for an object that was open on entry.
    """
    start, least, cuts = (-1 if depth else None), depth, []
    past = 0
    if mode == ESCAPED and text:
        mode, past = QUOTED, 1
    for found in _MARK.finditer(text):
        i = found.start()
        if i < past:
            continue
        c = text[i]
        if mode == QUOTED:
            if c == '"':
                mode = TEXT
            elif c == "\\":
                past = i + 2
        elif c == '"':
            mode = QUOTED if depth else TEXT
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            least = min(least, depth)
            if not depth:
                cuts.append((start, i + 1))
                start = None
    if past > len(text):
        mode = ESCAPED
    return mode, depth, start, least, cuts


def summary(text: str, chunk: int) -> dict:
    """For each mode, the exits of depths 0, 1, ... up to the deepest that the chunk can close, and of all deeper ones: [mode, depth (less the entry's), chunk, place of what it opened]."""
    out = {}
    for mode in (TEXT, QUOTED, ESCAPED):
        far = len(text) + 1
        end, depth, _, least, _ = scan(text, mode, far)
        table = []
        for d in range(1 if mode else 0, far - least + 1):
            m, after, start, _, _ = scan(text, mode, d)
            table.append([m, after, *([chunk, start] if start is not None and start >= 0 else [-1, -1])])
        out[mode] = {"low": 1 if mode else 0, "table": table, "far": [end, depth - far, -1, -1]}
    return out


def enter(of: dict, entry: Entry) -> Entry:
    """The state after a summary's text, entered in a state."""
    mode, depth, begun = entry
    part = of[mode]
    at = depth - part["low"]
    if at < len(part["table"]):
        m, after, chunk, place = part["table"][at]
    else:
        m, change, chunk, place = part["far"]
        after = depth + change
    return m, after, (chunk, place) if chunk >= 0 else begun if after else None


def compose(first: dict, second: dict) -> dict:
    """The summary of one text after another."""
    out = {}
    for mode, part in first.items():
        m, change, _, _ = part["far"]
        after = second[m]
        deepest = max(part["low"] + len(part["table"]), after["low"] + len(after["table"]) - change)
        table = []
        for d in range(part["low"], deepest):
            end = enter(second, enter(first, (mode, d, None)))
            table.append([end[0], end[1], *(end[2] or (-1, -1))])
        out[mode] = {"low": part["low"], "table": table, "far": [after["far"][0], change + after["far"][1], -1, -1]}
    return out


def objects_in_chunks(chunks: DataFrame) -> DataFrame:
    """(log, chunk, place, object): the outermost {...} objects of logs cut into chunks (log, chunk bigint, text), as one scan of the whole log finds them.

    chunk and place tell where an object begins. Chunks of a log are in order of chunk, whose numbers may have gaps; null texts are empty. An object itself
    fits into a task, a log needn't.
    """
    rows = chunks.select(F.col("log").cast("string").alias("log"), "chunk", F.coalesce("text", F.lit("")).alias("text")).where("log is not null").withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("long"))
    load = lambda s: {int(k): v for k, v in json.loads(s).items()}

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, whole = None, None
        for pdf in batches:
            out = []
            for log, block, chunk, text in pdf[["log", "block", "chunk", "text"]].itertuples(index=False):
                if (log, block) != at:
                    if at is not None:
                        out.append((*at, json.dumps(whole)))
                    at, whole = (log, block), None
                one = summary(text, int(chunk))
                whole = one if whole is None else compose(whole, one)
            yield pd.DataFrame(out, columns=["log", "block", "made"])
        if at is not None:
            yield pd.DataFrame([(*at, json.dumps(whole))], columns=["log", "block", "made"])

    def entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, OUTSIDE
        for pdf in batches:
            out = []
            for log, block, made in pdf[["log", "block", "made"]].itertuples(index=False):
                if log != at:
                    at, state = log, OUTSIDE
                out.append((log, block, *state[:2], *(state[2] or (-1, -1))))
                state = enter(load(made), state)
            yield pd.DataFrame(out, columns=["log", "block", "mode", "depth", "from_chunk", "from_place"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, OUTSIDE
        for pdf in batches:
            out = []
            for log, block, chunk, text, *entry in pdf[["log", "block", "chunk", "text", "mode", "depth", "from_chunk", "from_place"]].itertuples(index=False):
                if (log, block) != at:
                    m, d, c, p = (int(x) for x in entry)
                    at, state = (log, block), (m, d, (c, p) if c >= 0 else None)
                chunk, begun = int(chunk), state[2]
                mode, depth, start, _, cuts = scan(text, *state[:2])
                for a, b in cuts:
                    out.append((log, *begun, chunk, text[:b], True) if a < 0 else (log, chunk, a, chunk, text[a:b], True))
                if start is not None:
                    begun = begun if start < 0 else (chunk, start)
                    out.append((log, *begun, chunk, text[max(start, 0) :], False))
                state = mode, depth, begun if depth else None
            yield pd.DataFrame(out, columns=["log", "chunk", "place", "of", "piece", "closed"])

    dealt = rows.repartition("log", "block").sortWithinPartitions("log", "block", "chunk")
    sums = dealt.mapInPandas(united, "log string, block long, made string")
    entries = sums.repartition("log").sortWithinPartitions("log", "block").mapInPandas(entered, "log string, block long, mode int, depth long, from_chunk long, from_place long")
    told = rows.join(entries, ["log", "block"]).repartition("log", "block").sortWithinPartitions("log", "block", "chunk")
    cut = told.mapInPandas(pieces, "log string, chunk long, place long, of long, piece string, closed boolean")
    whole = cut.groupBy("log", "chunk", "place").agg(F.max("closed").alias("closed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("of", "piece"))), lambda x: x["piece"]), "").alias("object"))
    return whole.where("closed").drop("closed")
