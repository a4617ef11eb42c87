"""Partial JSON updates: a vector of edits to a document, for which there is no built-in function (an Arrow UDF)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(\d+)\]')


def _steps(path: str) -> list:
    out, at = [], 1
    if not path.startswith("$"):
        raise ValueError(f"bad path: {path}")
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad path: {path}")
        out.append(int(m[3]) if m[3] is not None else m[2] if m[2] is not None else json.loads(f'"{m[1]}"'))
        at = m.end()
    return out


def patch(document: str, edits: list[tuple[str, str, str | None]]) -> str:
    """Edits (action, path, value) in order: REPLACE and REMOVE need the place, INSERT needs it free; an array moves up or down."""
    root = [json.loads(document)]
    for action, path, value in edits:
        holder, step = root, 0
        for nxt in _steps(path):
            holder, step = holder[step], nxt
        there = step < len(holder) if isinstance(holder, list) else step in holder
        if action == "INSERT":
            if isinstance(holder, list):
                holder.insert(step, json.loads(value))
                continue
            if there:
                raise ValueError(f"{path} is there already")
            holder[step] = json.loads(value)
        elif not there:
            raise ValueError(f"{path} is not there")
        elif action == "REPLACE":
            holder[step] = json.loads(value)
        elif action == "REMOVE":
            del holder[step]
        else:
            raise ValueError(f"no such edit: {action}")
    return json.dumps(root[0], separators=(",", ":"), ensure_ascii=False)


def apply_patch(document: Column, edits: Column) -> Column:
    """edits: array of structs action, path, value."""
    run = F.udf(lambda d, e: None if d is None else patch(d, [(x["action"], x["path"], x["value"]) for x in e or []]), "string", useArrow=True)
    return run(document, edits)
