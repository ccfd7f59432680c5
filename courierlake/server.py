"""The tools as JSON-RPC 2.0 over stdio.

    python -m courierlake db serve --table <path> [--max-limit n] [--quiet]
"""

from __future__ import annotations

import base64
import datetime
import inspect
import json
import sys
import time
from collections.abc import Callable
from typing import IO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .functions.predicates import MAX_LIMIT, ToolError, integer
from .ingest import stored
from .operators import analytics, retrieval
from .plans.sqlguard import execute_sql_query
from .schema import EMAILS
from .session import session
from .settings import from_environment

#: Tools that answer one object, not a list.
SINGLE = ("get_email_full", "count_emails", "get_email_stats")
NAMES = (
    "list_earliest_emails get_email_full filter_emails search_emails count_emails get_email_stats get_top_senders get_top_domains get_largest_emails"
    " get_mailbox_stats get_emails_by_date_range get_emails_with_attachments get_email_thread get_email_activity_heatmap get_response_time_stats"
    " get_email_frequency_by_sender get_seasonal_trends get_emails_by_size_range get_duplicate_emails search_email_headers get_emails_by_keywords"
).split()


def operator(name: str) -> Callable[..., DataFrame]:
    return getattr(retrieval, name, None) or getattr(analytics, name)


INTEGERS = frozenset("id limit min_size max_size x_gm_thrid".split())
REQUIRED = {
    "get_email_full": ["id"],
    "search_emails": ["query"],
    "get_emails_by_date_range": ["start_date", "end_date"],
    "get_email_thread": ["x_gm_thrid"],
    "get_email_frequency_by_sender": ["sender_email"],
    "get_emails_by_size_range": ["min_size", "max_size"],
    "search_email_headers": ["query"],
    "get_emails_by_keywords": ["keywords"],
    "execute_sql_query": ["sql_query"],
}
CHOICES = {"header_field": retrieval.HEADERS, "search_field": retrieval.BODIES, "field": ("message_id", "x_gm_msgid"), "attachments": ("any", "with", "without"), "order": ("date_asc", "date_desc")}
DESCRIPTIONS = {
    "limit": "How many rows at most",
    "id": "Number of the message in the table",
    "mailbox": "Only messages of this folder",
    "from_contains": "Text in the sender's name or address",
    "from_domain": "Domain of the sender",
    "subject_contains": "Text in the subject",
    "date_from": "Received at this time or later",
    "date_to": "Received at this time or earlier",
    "start_date": "First time of receipt",
    "end_date": "Last time of receipt",
    "query": "Text to look for",
    "keywords": "Terms, as a list or separated by commas",
    "match_all": "All terms must occur, not any",
    "sender_email": "Text in the sender's address",
    "x_gm_thrid": "Number of the thread",
    "min_size": "Bytes at least",
    "max_size": "Bytes at most",
    "sql_query": "A SELECT or WITH statement over the view emails",
}


def property_of(name: str) -> dict[str, object]:
    if name == "match_all":
        kind: dict[str, object] = {"type": "boolean"}
    elif name == "keywords":
        kind = {"oneOf": [{"type": "string"}, {"type": "array", "items": {"type": "string"}}]}
    else:
        kind = {"type": "integer" if name in INTEGERS else "string"}
    if name in CHOICES:
        kind["enum"] = list(CHOICES[name])
    return kind | {"description": DESCRIPTIONS.get(name, name.replace("_", " ").capitalize())}


def schema_of(tool: str, names: list[str]) -> dict[str, object]:
    """What a tool takes; advertised, not enforced."""
    found: dict[str, object] = {"type": "object", "properties": {n: property_of(n) for n in names}}
    if tool in REQUIRED:
        found["required"] = REQUIRED[tool]
    return found | {"additionalProperties": False}


#: Parameters of tools that the server sets, not the caller; `index` names a path.
OWN = ("emails", "most", "index", "ascii_only")


def arguments(f: Callable) -> list[str]:
    return [p for p in inspect.signature(f).parameters if p not in OWN]


def plain(value: object) -> object:
    """JSON values; bytes in base64, times in ISO 8601."""
    if isinstance(value, bytes | bytearray):
        return base64.b64encode(value).decode()
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return value


class Server:
    def __init__(self, emails: DataFrame, most: int = MAX_LIMIT, log: IO[str] | None = None, index: str | None = None):
        self.emails, self.most, self.log, self.index = emails, most if most > 0 else MAX_LIMIT, log, index

    def tools(self) -> list[dict[str, object]]:
        named = {n: operator(n) for n in NAMES}
        found = [{"name": f"db.{n}", "description": (inspect.getdoc(f) or n.replace("_", " ").capitalize()).splitlines()[0], "inputSchema": schema_of(n, arguments(f))} for n, f in named.items()]
        return [*found, {"name": "db.execute_sql_query", "description": "Rows of a read-only statement", "inputSchema": schema_of("execute_sql_query", ["sql_query"])}]

    def rows(self, df: DataFrame) -> list[dict[str, object]]:
        return [{k: plain(v) for k, v in r.asDict().items()} for r in df.limit(self.most).collect()]

    def call(self, name: str, args: dict[str, object]) -> object:
        short = name.removeprefix("db.")
        try:
            if short == "execute_sql_query":
                rows = self.rows(execute_sql_query({"emails": self.emails}, args.get("sql_query"), self.most))
                return {"query": args.get("sql_query"), "row_count": len(rows), "rows": rows}
            if short not in NAMES:
                return {"error": f"Unknown tool: {name}"}
            f = operator(short)
            given = {k: v for k, v in args.items() if k in arguments(f)}
            if "index" in inspect.signature(f).parameters:
                given["index"] = self.index
            rows = self.rows(f(self.emails, **given, most=self.most))
            if short == "get_email_full" and not rows:
                raise ToolError(f"email not found with id: {args.get('id')}")
            return rows[0] if short in SINGLE else rows
        except ToolError as e:
            return {"error": str(e)}
        except PySparkException as e:
            return {"error": str(e).splitlines()[0]}

    def answer(self, request: dict) -> dict | None:
        """The reply to a request; None to a notification."""
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "courierlake", "version": "0.1"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": self.tools()}}
        if method == "tools/call":
            began = time.perf_counter()
            found = self.call(str(params.get("name")), params.get("arguments") or {})
            if self.log is not None:
                took = round(1000 * (time.perf_counter() - began))
                self.log.write(json.dumps({"tool": params.get("name"), "dur_ms": took, "error": found.get("error") if isinstance(found, dict) else None}) + "\n")
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}]}}
        if method == "shutdown":
            return reply | {"result": {}}
        return reply | {"error": {"code": -32601, "message": f"Method not found: {method}"}}

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        """A request a line; what is no JSON object is passed over; shutdown ends."""
        for line in source:
            try:
                request = json.loads(line)
            except ValueError:
                continue
            if not isinstance(request, dict):
                continue
            reply = self.answer(request)
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()
            if request.get("method") == "shutdown":
                return


def main(table: str, max_limit: int | None = None, quiet: bool | None = None, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Serve the table; options come before the environment, and a limit that is not positive is the usual one."""
    spark = session()
    emails = stored(spark, table)
    if emails is None:
        emails = spark.createDataFrame([], EMAILS)
    silent = quiet if quiet is not None else from_environment("quiet") == "1"
    Server(emails, integer(from_environment("max_limit", max_limit)), None if silent else sys.stderr).serve(source, sink)
