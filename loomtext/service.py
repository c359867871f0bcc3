"""Maps as tools for agents: JSON-RPC, a request or a batch of them on each line of standard input."""

from __future__ import annotations

import json
import os
import sys

from .plans.repository import Repository, Result, Task

# Fixed values of the protocol: versions, the key of a request's own version, error codes.
MODERN = ("2026-07-28",)
LEGACY = ("2025-11-25", "2025-06-18", "2025-03-26", "2024-11-05")
VERSION_KEY = "io.modelcontextprotocol/protocolVersion"
PARSE, METHOD, PARAMS, VERSION = -32700, -32601, -32602, -32022
MOST_CHARS = 60_000
ABOUT = {"name": "loomtext", "version": "2"}
HELP = "tree_overview tells what a source tree is and where things are; call it first. tree_query ranks its files for a task. Both give evidence, not proof."

_DIR = {"type": "string", "description": "The directory to map; the server's own by default."}
_BUDGET = {"type": "integer", "minimum": 100, "description": "Size of the map in tokens, about."}
_STRINGS = {"type": "array", "items": {"type": "string"}}
_HINTS = {"readOnlyHint": True, "idempotentHint": True, "openWorldHint": False}
TOOLS = [
    {"name": "tree_overview", "description": "Purpose, languages, build commands, layout, entry points and central files of a tree.", "annotations": _HINTS, "inputSchema": {"type": "object", "properties": {"dir": _DIR, "token_budget": _BUDGET}, "additionalProperties": False}},
    {
        "name": "tree_query", "description": "The files of a tree that matter for a task, best first.", "annotations": _HINTS,
        "inputSchema": {
            "type": "object", "required": ["query"], "additionalProperties": False,
            "properties": {"dir": _DIR, "query": {"type": "string"}, "mentioned_paths": _STRINGS, "mentioned_symbols": _STRINGS, "open_paths": _STRINGS, "detail": {"type": "string", "enum": ["full", "compact"]}, "token_budget": _BUDGET},
        },
    },
]


class Failed(Exception):
    def __init__(self, code: int, message: str, data=None):
        super().__init__(message)
        self.error = {"code": code, "message": message} | ({} if data is None else {"data": data})


class Service:
    """Answers requests; parsed trees are kept from call to call."""

    def __init__(self, spark, most_trees: int = 64):
        self.spark, self.most, self.trees = spark, most_trees, {}

    def repository(self, root: str) -> Repository:
        if len(self.trees) >= self.most and root not in self.trees:
            self.trees.clear()
        made = self.trees.setdefault(root, Repository(self.spark, root))
        made._rows = None  # files may have changed; what hasn't is not parsed again
        return made

    def call(self, name: str, args: dict) -> dict:
        root = args.get("dir")
        if root is not None and not isinstance(root, str):
            raise Failed(PARAMS, "dir must be a string")
        root = os.path.realpath(root or os.getcwd())
        if not os.path.isdir(root):
            return self.shown(Result(False, f"not a directory: {root}"))
        budget = args.get("token_budget")
        if budget is not None and (isinstance(budget, bool) or not isinstance(budget, int) or budget < 0):
            raise Failed(PARAMS, "token_budget must be a non-negative integer")
        if name == "tree_overview":
            return self.shown(self.repository(root).overview(2000 if budget is None else budget, MOST_CHARS))
        if name != "tree_query":
            raise Failed(PARAMS, f"unknown tool: {name}")
        if not isinstance(args.get("query"), str):
            raise Failed(PARAMS, "query is required and must be a string")
        lists = []
        for key in ("mentioned_paths", "mentioned_symbols", "open_paths"):
            values = args.get(key)
            values = [] if values is None else values
            if not isinstance(values, list):
                raise Failed(PARAMS, f"{key} must be an array of strings")
            if not all(isinstance(v, str) for v in values):
                raise Failed(PARAMS, f"{key} must contain only strings")
            lists.append(values)
        detail = args.get("detail") if isinstance(args.get("detail"), str) else "full"
        if detail not in ("full", "compact"):
            raise Failed(PARAMS, f"detail must be full or compact, not {detail}")
        task = Task(args["query"], *lists, 3000 if budget is None else budget)
        return self.shown(self.repository(root).task_map(task, MOST_CHARS, detail == "compact"))

    @staticmethod
    def shown(result: Result) -> dict:
        return {"content": [{"type": "text", "text": result.output}], "isError": not result.ok}

    def answer(self, method: str, params: dict) -> dict:
        match method:
            case "initialize":
                asked = params.get("protocolVersion")
                return {"protocolVersion": asked if asked in LEGACY else LEGACY[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": ABOUT, "instructions": HELP}
            case "server/discover":
                return {"supportedVersions": [*MODERN, *LEGACY], "capabilities": {"tools": {}}, "_meta": {"io.modelcontextprotocol/serverInfo": ABOUT}, "instructions": HELP}
            case "ping":
                return {}
            case "tools/list":
                return {"tools": TOOLS}
            case "tools/call":
                return self.call(params.get("name") or "", params.get("arguments") or {})
        raise Failed(METHOD, f"method not found: {method}")

    def handle(self, request) -> dict | None:
        """The reply to one request; None for notifications, which never get one."""
        request = request if isinstance(request, dict) else {}
        method, params = request.get("method"), request.get("params")
        method, params = method if isinstance(method, str) else "", params if isinstance(params, dict) else {}
        meta = params.get("_meta")
        version = meta.get(VERSION_KEY) if isinstance(meta, dict) else None
        if method.startswith("notifications/"):
            return None
        try:
            if isinstance(version, str) and version not in MODERN + LEGACY:
                raise Failed(VERSION, "Unsupported protocol version", {"supported": [*MODERN, *LEGACY], "requested": version})
            out = {"result": self.answer(method, params)}
            if version in MODERN or method == "server/discover":
                out["result"]["resultType"] = "complete"
        except Failed as e:
            out = {"error": e.error}
        return {"jsonrpc": "2.0", "id": request["id"], **out} if "id" in request else None

    def line(self, text: str) -> str | None:
        """The reply to one line: a request, a batch of them, or nothing."""
        if not text.strip():
            return None
        try:
            asked = json.loads(text)
        except ValueError as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": f"parse error: {e}"}})
        if isinstance(asked, list):
            replies = [r for r in map(self.handle, asked) if r is not None]
            return json.dumps(replies) if replies else None
        reply = self.handle(asked)
        return None if reply is None else json.dumps(reply)


def serve(spark) -> int:
    service = Service(spark)
    for text in sys.stdin:
        if (reply := service.line(text)) is not None:
            sys.stdout.write(reply + "\n")
            sys.stdout.flush()
    return 0
