"""Small log records for tests."""

from __future__ import annotations

import json
from datetime import UTC, datetime

T0 = 1_717_232_400_000  # 2024-06-01 09:00 UTC


def iso(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def record(rec_id: str, ms: int, kind: str, **fields) -> dict:
    return {"type": kind, "id": rec_id, "timestamp": iso(ms), **fields}


def session(sid: str, ms: int, cwd: str = "/home/a/shop", parent: str | None = None) -> dict:
    out = {"type": "session", "version": 3, "id": sid, "timestamp": iso(ms), "cwd": cwd}
    return {**out, "parentSession": parent} if parent else out


def human(rec_id: str, ms: int, text: str, **message) -> dict:
    return record(rec_id, ms, "message", message={"role": "user", "attribution": "user", "timestamp": ms, "content": text, **message})


def usage(cost: float = 0.0, **tokens) -> dict:
    return {"input": 0, "output": 0, "cacheRead": 0, "cacheWrite": 0, **tokens, "cost": {"input": cost / 2, "output": cost / 4, "total": cost}}


def answer(rec_id: str, ms: int, *blocks, cost: float = 0.0, **message) -> dict:
    body = {"role": "assistant", "model": "m-1", "provider": "north", "timestamp": ms, "usage": usage(cost, input=10), "content": list(blocks), **message}
    return record(rec_id, ms, "message", message=body)


def call(call_id: str, name: str, **arguments) -> dict:
    return {"type": "toolCall", "id": call_id, "name": name, "arguments": arguments}


def start(rec_id: str, ms: int, call_id: str, tool: str) -> dict:
    return record(rec_id, ms, "custom", customType="tool_execution_start", data={"toolCallId": call_id, "toolName": tool, "startedAt": ms})


def result(rec_id: str, ms: int, call_id: str, tool: str, text: str = "ok", error: bool = False) -> dict:
    return record(rec_id, ms, "message", message={
        "role": "toolResult", "toolName": tool, "toolCallId": call_id, "isError": error, "timestamp": ms, "content": [{"type": "text", "text": text}]})


def write(path, records, tail: str = "") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n" + tail)


def lines(spark, records, sid: str = "s1", kind: str = "primary", sidecar: str = ""):
    rows = [("a", sid, kind, sidecar, i, json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "source string, session_id string, kind string, sidecar_name string, seq bigint, line string")
