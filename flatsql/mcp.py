"""Tools over JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
import os
from typing import TextIO

import flatsql
from flatsql.api import Engine
from flatsql.sinks.text import text_of
from flatsql.sources.csv import hadoop_path

PROTOCOL = "2024-11-05"
SAMPLE = 5


def _tool(name: str, about: str, argument: str, meaning: str, required: bool) -> dict:
    schema = {"type": "object", "properties": {argument: {"type": "string", "description": meaning}}}
    return {"name": name, "description": about, "inputSchema": schema | ({"required": [argument]} if required else {})}


TOOLS = [
    _tool("csv_query", "Run a SELECT over CSV files and return its rows as JSON.", "sql", "The query; file paths stand in quotes after FROM", True),
    _tool("csv_schema", "Show the columns of a CSV file by its first rows.", "file", "Path of the file", True),
    _tool("csv_list", "List the CSV files of a folder.", "directory", "The folder; by default the current one", False),
]


class _BadParams(Exception):
    pass


def _argument(arguments: dict, name: str, default: str | None = None) -> str:
    value = arguments.get(name, default)
    if not isinstance(value, str):
        raise _BadParams(f"missing argument: {name}")
    return value


def call_tool(engine: Engine, name: str, arguments: dict) -> str:
    if name == "csv_query":
        return text_of(engine.sql(_argument(arguments, "sql")), "json")
    if name == "csv_schema":
        return text_of(engine.resolver(_argument(arguments, "file")).limit(SAMPLE), "json")
    if name == "csv_list":
        folder = _argument(arguments, "directory", ".")
        target, files = hadoop_path(engine.spark, folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        return json.dumps(sorted(f.getPath().getName() for f in files.listStatus(target) if f.isFile() and f.getPath().getName().lower().endswith(".csv")))
    raise _BadParams(f"unknown tool: {name}")


def handle(message: object, engine: Engine | None = None) -> dict | None:
    """The reply to a message; None for notifications."""
    number = message.get("id") if isinstance(message, dict) else None

    def fail(code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}}

    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return fail(-32600, "invalid request")
    method, params = message["method"], message.get("params") or {}
    if "id" not in message:
        return None
    if method == "initialize":
        result: dict = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "flatsql", "version": flatsql.__version__}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        try:
            text, failed = call_tool(engine or Engine(), params.get("name", ""), params.get("arguments") or {}), False
        except _BadParams as error:
            return fail(-32602, str(error))
        except Exception as error:  # noqa: BLE001  a query that fails is the tool's answer
            text, failed = f"error: {error}", True
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        return fail(-32601, f"unknown method: {method}")
    return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(lines: TextIO, out: TextIO, engine: Engine | None = None) -> int:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = handle(json.loads(line), engine)
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
    return 0
