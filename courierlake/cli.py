"""Commands: mailbox list, download, archive; db import, ingest, serve.

Exit codes: 0 done, 1 bad arguments, 2 the mail server, 3 anything else.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import IO

from . import server, sync
from .ingest import delete, upsert
from .session import session
from .settings import Settings, SettingsError, from_environment
from .sources.imap import ERRORS, Mailbox
from .sources.sqlite import read_sqlite
from .streaming.incremental import ingest_new

OK, BAD_ARGUMENTS, BAD_SERVER, FAILED = range(4)


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise SettingsError(message)


def parser() -> Parser:
    top = Parser(prog="courierlake")
    groups = top.add_subparsers(dest="group", required=True, parser_class=Parser)
    mailbox = groups.add_parser("mailbox").add_subparsers(dest="command", required=True, parser_class=Parser)
    for name in ("list", "download", "archive"):
        p = mailbox.add_parser(name)
        p.add_argument("-a", "--address")
        p.add_argument("-p", "--password")
        p.add_argument("--host")
        p.add_argument("--port", type=int)
        p.add_argument("--plain", action="store_true", help="no TLS")
        if name == "list":
            continue
        p.add_argument("-m", "--mailbox", default="INBOX")
        p.add_argument("--max-fetch-size", type=int)
        p.add_argument("--strict", action="store_true")
        p.add_argument("-y", "--yes", "--force", action="store_true")
        p.add_argument("--only-preflight", action="store_true")
        p.add_argument("--only-ids", nargs="+")
        p.add_argument("--uidvalidity", type=int)
        if name == "download":
            p.add_argument("--table")
            p.add_argument("--batch-size", type=int, default=10_000)
            p.add_argument("--recreate", action="store_true")
            p.add_argument("--purge-uidvalidity", type=int)
            p.add_argument("--text-mode", choices=("utf8", "compat"), default="utf8")
        else:
            p.add_argument("--output", required=True)
    db = groups.add_parser("db").add_subparsers(dest="command", required=True, parser_class=Parser)
    serve = db.add_parser("serve")
    serve.add_argument("--table")
    serve.add_argument("--max-limit", type=int)
    serve.add_argument("--quiet", action="store_true", default=None)
    load = db.add_parser("import")
    load.add_argument("--sqlite", required=True)
    load.add_argument("--table")
    load.add_argument("--strict", action="store_true")
    tree = db.add_parser("ingest", help="messages of an .eml tree that came since the last run")
    tree.add_argument("--base", required=True)
    tree.add_argument("--table")
    tree.add_argument("--checkpoint", required=True)
    tree.add_argument("--fresh", action="store_true", help="forget the last run")
    return top


def table_of(args: argparse.Namespace) -> str:
    found = from_environment("table", args.table)
    if not found:
        raise SettingsError("missing: table")
    return str(found)


def asked(source: IO[str], sink: IO[str]) -> sync.Confirm:
    def confirm(question: str) -> bool:
        sink.write(f"{question} Type DELETE or y to go on: ")
        sink.flush()
        return source.readline().strip() in ("DELETE", "y", "Y")

    return confirm


def say(report: sync.Report, sink: IO[str], preflight: bool) -> None:
    if report.cancelled:
        sink.write("cancelled\n")
        return
    sink.write(f"uidvalidity={report.uidvalidity} server_size={report.server_size} to_fetch={len(report.to_fetch)} done={report.done} failed={len(report.failed)} removed={report.removed}\n")
    if preflight:
        sink.write(f"uids: {', '.join(map(str, report.to_fetch)) or '(none)'}\n")


def run(args: argparse.Namespace, source: IO[str], sink: IO[str]) -> None:
    if args.group == "db":
        if args.command == "import":
            spark, table = session(), table_of(args)
            upsert(read_sqlite(spark, args.sqlite), table, strict=args.strict)
            return
        if args.command == "ingest":
            spark, table = session(), table_of(args)
            if args.fresh:
                delete(spark, args.checkpoint)
            ingest_new(spark, args.base, table, args.checkpoint)
            return
        server.main(table_of(args), args.max_limit, args.quiet, source, sink)
        return
    given = {"host": args.host, "port": args.port, "tls": False if args.plain else None}
    settings = Settings.of(args.address, args.password, getattr(args, "max_fetch_size", None), **given)
    if args.command == "list":
        names = Mailbox(settings).folders()
        sink.write("".join(f"{n}\n" for n in names) or "(no mailboxes)\n")
        return
    same = {"mailbox": args.mailbox, "strict": args.strict, "yes": args.yes, "only_preflight": args.only_preflight, "only_ids": args.only_ids, "uidvalidity": args.uidvalidity, "confirm": asked(source, sink)}
    if args.only_ids is not None:
        sync.wanted_ids(args.only_ids)
    if args.command == "download":
        own = {"batch_size": args.batch_size, "recreate": args.recreate, "purge_uidvalidity": args.purge_uidvalidity, "text_mode": args.text_mode}
        report = sync.download(session(), settings, table_of(args), **same, **own)
    else:
        report = sync.archive(session(), settings, args.output, **same)
    say(report, sink, args.only_preflight)


def main(argv: Sequence[str] | None = None, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout, errors: IO[str] = sys.stderr) -> int:
    try:
        run(parser().parse_args(argv), source, sink)
    except SettingsError as e:
        errors.write(f"error: {e}\n")
        return BAD_ARGUMENTS
    except ERRORS as e:
        errors.write(f"mail server: {type(e).__name__}: {e}\n")
        return BAD_SERVER
    except Exception as e:  # the code tells a script that something else failed
        errors.write(f"{type(e).__name__}: {e}\n")
        return FAILED
    return OK
