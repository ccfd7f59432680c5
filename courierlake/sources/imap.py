"""IMAP folders as a source: a client, and a Spark data source with a partition for each batch of messages.

    spark.dataSource.register(ImapSource)
    spark.read.format("imap").options(**options(settings, "INBOX", uids)).load()

A partition opens one connection, so a lost executor costs one batch read again.
A batch that cannot be read gives rows with fetch_error and no raw bytes, unless
strict is set. Folders are opened read-only.
"""

from __future__ import annotations

import base64
import imaplib
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..settings import FetchSizeError, NoValidityError, Settings

SCHEMA = "address string, mailbox string, uidvalidity long, uid long, internaldate timestamp, rfc822_size long, labels_json string, x_gm_thrid long, x_gm_msgid long, raw binary, fetch_error string"
FOLDERS = "mailbox string"
ERRORS = (imaplib.IMAP4.error, OSError)
LISTED = re.compile(rb'\((?P<flags>[^)]*)\) (?:"(?:[^"\\]|\\.)*"|NIL) (?P<name>.+)$', re.S)
TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([^\s()]+)')
NUMBER = {"uid": "UID", "rfc822_size": r"RFC822\.SIZE", "x_gm_thrid": "X-GM-THRID", "x_gm_msgid": "X-GM-MSGID"}


def encoded(name: str) -> str:
    """A folder name in the modified UTF-7 of IMAP."""
    return re.sub(r"&|[^\x20-\x7e]+", lambda m: "&-" if m[0] == "&" else "&" + base64.b64encode(m[0].encode("utf-16-be")).decode().rstrip("=").replace("/", ",") + "-", name)


def decoded(name: str) -> str:
    return re.sub(r"&([^-]*)-", lambda m: base64.b64decode(m[1].replace(",", "/") + "=" * (-len(m[1]) % 4)).decode("utf-16-be") if m[1] else "&", name)


def quoted(name: str) -> str:
    return '"' + re.sub(r'(["\\])', r"\\\1", encoded(name)) + '"'


def unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1]) if text.startswith('"') else text


@dataclass
class Plan:
    """What a folder holds and what of it is missing here."""

    capabilities: list[str]
    uidvalidity: int
    server_size: int
    to_fetch: list[int]


def moment(text: str | None) -> datetime:
    """The receive time; the epoch where it can't be read."""
    try:
        return datetime.strptime(text.strip(), "%d-%b-%Y %H:%M:%S %z")
    except (AttributeError, ValueError):
        return datetime.fromtimestamp(0, UTC)


def attributes(text: str) -> dict[str, object]:
    """Columns from the attributes of one FETCH reply."""
    found: dict[str, object] = {}
    for column, key in NUMBER.items():
        m = re.search(rf"\b{key} (\d+)", text)
        found[column] = int(m[1]) if m else None
    date = re.search(r'INTERNALDATE "([^"]*)"', text)
    labels = re.search(r'X-GM-LABELS \(((?:"(?:[^"\\]|\\.)*"|[^")])*)\)', text)
    found["internaldate"] = moment(date[1] if date else None)
    names = [re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2] for m in TOKEN.finditer(labels[1])] if labels else []
    found["labels_json"] = json.dumps([decoded(n) for n in names], ensure_ascii=False)
    return found


class Mailbox:
    """A folder of an account."""

    def __init__(self, settings: Settings, name: str = "INBOX") -> None:
        self.settings, self.name = settings, name

    @contextmanager
    def connection(self, folder: bool = True) -> Iterator[imaplib.IMAP4]:
        s = self.settings
        c = (imaplib.IMAP4_SSL if s.tls else imaplib.IMAP4)(s.host, s.port, timeout=60)
        try:
            c.login(s.address, s.password)
            if folder:
                kind, told = c.select(quoted(self.name), readonly=True)
                if kind != "OK":
                    raise imaplib.IMAP4.error(f"{self.name}: {told[0]!r}")
            yield c
        finally:
            try:
                c.logout()
            except ERRORS:
                pass

    def folders(self) -> list[str]:
        """Names of all folders, sorted."""
        with self.connection(folder=False) as c:
            _, rows = c.list('""', '"*"')
        names = []
        for row in rows:
            head, literal = row if isinstance(row, tuple) else (row, None)
            m = LISTED.match(head) if head else None
            if m:
                names.append(decoded(literal.decode() if literal is not None else unquoted(m["name"].decode().strip())))
        return sorted(names)

    def preflight(self, existing: Iterable[int] = ()) -> Plan:
        with self.connection() as c:
            told = c.response("UIDVALIDITY")[1]
            if not told or told[0] is None:
                raise NoValidityError(self.name)
            _, found = c.uid("SEARCH", None, "UID 1:*")
            uids = [int(u) for line in found if line for u in line.split()]
            have = set(existing)
            return Plan(sorted(map(str, c.capabilities)), int(told[0]), len(uids), [u for u in uids if u not in have])

    def fetch(self, uids: Sequence[int]) -> list[dict[str, object]]:
        """Messages by uid; those that the server does not have are left out."""
        if len(uids) > self.settings.max_fetch_size:
            raise FetchSizeError(len(uids), self.settings.max_fetch_size, self.name)
        if not uids:
            return []
        with self.connection() as c:
            kind, parts = c.uid("FETCH", ",".join(map(str, uids)), f"({' '.join(self.settings.items)})")
            if kind != "OK":
                raise imaplib.IMAP4.error(f"{self.name}: {parts[0]!r}")
        out = []
        for i, part in enumerate(parts):
            if isinstance(part, tuple):
                after = parts[i + 1] if i + 1 < len(parts) and isinstance(parts[i + 1], bytes) else b""
                text = (part[0] + b" " + after).decode("utf-8", "replace")
                out.append(attributes(text) | {"raw": bytes(part[1])})
        return [m for m in out if m["uid"] is not None]


def options(settings: Settings, mailbox: str = "INBOX", uids: Sequence[int] = (), uidvalidity: int = 0, strict: bool = False, mode: str = "messages") -> dict[str, str]:
    """Reader options."""
    s = settings
    return {"address": s.address, "password": s.password, "host": s.host, "port": str(s.port), "tls": str(s.tls).lower(), "batch": str(s.max_fetch_size), "mailbox": mailbox, "uids": ranges(uids), "uidvalidity": str(uidvalidity), "strict": str(strict).lower(), "mode": mode}


def ranges(uids: Sequence[int]) -> str:
    """Sorted numbers as first:last runs."""
    runs: list[list[int]] = []
    for u in sorted(set(uids)):
        if runs and u == runs[-1][1] + 1:
            runs[-1][1] = u
        else:
            runs.append([u, u])
    return ",".join(str(a) if a == z else f"{a}:{z}" for a, z in runs)


def numbers(text: str) -> list[int]:
    pairs = ([int(x) for x in run.split(":")] for run in text.split(",") if run)
    return [u for p in pairs for u in range(p[0], p[-1] + 1)]


class Batch(InputPartition):
    def __init__(self, uids: list[int]) -> None:
        super().__init__(tuple(uids))
        self.uids = uids


class ImapReader(DataSourceReader):
    def __init__(self, given: dict[str, str]) -> None:
        self.given = {k.lower(): v for k, v in given.items()}

    def settings(self) -> Settings:
        g = self.given
        return Settings(g.get("address", ""), g.get("password", ""), g.get("host", "imap.gmail.com"), int(g.get("port", "993")), g.get("tls", "true") == "true", int(g.get("batch", "100")))

    def partitions(self) -> list[InputPartition]:
        if self.given.get("mode") == "list":
            return [Batch([])]
        uids, size = numbers(self.given.get("uids", "")), self.settings().max_fetch_size
        return [Batch(uids[i : i + size]) for i in range(0, len(uids), size)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        settings, name = self.settings(), self.given.get("mailbox", "INBOX")
        box, validity = Mailbox(settings, name), int(self.given.get("uidvalidity", "0"))
        if self.given.get("mode") == "list":
            yield from ((n,) for n in box.folders())
            return
        try:
            found = box.fetch(partition.uids)
        except ERRORS as e:
            if self.given.get("strict") == "true":
                raise
            for uid in partition.uids:
                yield (settings.address, name, validity, uid, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        for m in found:
            yield (settings.address, name, validity, m["uid"], m["internaldate"], m["rfc822_size"] or 0, m["labels_json"], m["x_gm_thrid"], m["x_gm_msgid"], m["raw"], None)


class ImapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imap"

    def schema(self) -> str:
        return FOLDERS if dict(self.options).get("mode") == "list" else SCHEMA

    def reader(self, schema) -> ImapReader:
        return ImapReader(dict(self.options))
