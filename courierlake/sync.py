"""Mail folders into the emails table (download) and into .eml trees (archive).

Both plan on the driver from the server's list of numbers, fetch in Spark tasks
(a connection for each batch) and are safe to run again: what is stored is
passed over. A batch that cannot be fetched or a file that cannot be written is
recorded and passed over, or ends a strict run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC
from email.utils import format_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.mail import inject_headers
from .ingest import IngestError, delete, purge, stored, upsert
from .settings import Settings, SettingsError
from .sources.eml import parsed
from .sources.files import Folder, shared
from .sources.imap import ImapSource, Mailbox, options

Confirm = Callable[[str], bool]


@dataclass
class Report:
    """What a run found and did."""

    uidvalidity: int | None = None
    server_size: int | None = None
    to_fetch: list[int] = field(default_factory=list)
    done: int = 0
    failed: list[int] = field(default_factory=list)
    removed: int = 0
    cancelled: bool = False


def never(question: str) -> bool:
    return False


def wanted_ids(given: str | Iterable[object]) -> list[int]:
    """Numbers of a comma-separated text or a list; what is no positive number is left out."""
    parts = [p for x in ([given] if isinstance(given, str) else given) for p in str(x).split(",")]
    found = [int(p) for p in parts if p.strip().isdigit() and int(p) > 0]
    if not found:
        raise SettingsError("only_ids needs at least one valid number")
    return list(dict.fromkeys(found))


def plan(box: Mailbox, only_ids: str | Iterable[object] | None, uidvalidity: int | None) -> Report:
    """The folder's generation and the numbers asked for, or all that the server has."""
    if only_ids is not None:
        chosen = wanted_ids(only_ids)
        return Report(int(uidvalidity) if uidvalidity else box.preflight().uidvalidity, None, chosen)
    found = box.preflight()
    return Report(found.uidvalidity, found.server_size, found.to_fetch)


def fetched(spark: SparkSession, settings: Settings, mailbox: str, report: Report, strict: bool) -> DataFrame:
    spark.dataSource.register(ImapSource)
    return spark.read.format("imap").options(**options(settings, mailbox, report.to_fetch, report.uidvalidity, strict)).load()


def download(
    spark: SparkSession,
    settings: Settings,
    table: str,
    mailbox: str = "INBOX",
    batch_size: int = 10_000,
    strict: bool = False,
    recreate: bool = False,
    yes: bool = False,
    purge_uidvalidity: int | None = None,
    only_preflight: bool = False,
    only_ids: str | Iterable[object] | None = None,
    uidvalidity: int | None = None,
    text_mode: str = "utf8",
    confirm: Confirm = never,
) -> Report:
    """Fetch the messages of a folder that the table lacks.

    batch_size: messages staged and stored at a time; each such step is whole,
    so an interrupted run goes on from the last. recreate and purge_uidvalidity
    remove rows only with yes or a confirmed question. What could not be
    fetched or parsed is appended to <table>.failed; a message that could not be
    parsed is stored with its raw bytes.
    """
    if batch_size <= 0:
        raise SettingsError("batch_size must be positive")
    report = plan(Mailbox(settings, mailbox), only_ids, uidvalidity)
    if purge_uidvalidity is not None:
        if not (yes or confirm(f"Delete rows of {settings.address} {mailbox}, generation {purge_uidvalidity}?")):
            return Report(report.uidvalidity, report.server_size, cancelled=True)
        report.removed, report.to_fetch = purge(spark, table, settings.address, mailbox, int(purge_uidvalidity)), []
        return report
    if only_preflight:
        return report
    if recreate:
        if not (yes or confirm(f"Delete rows of {settings.address} {mailbox}, generation {report.uidvalidity}?")):
            return Report(report.uidvalidity, report.server_size, cancelled=True)
        report.removed = purge(spark, table, settings.address, mailbox, report.uidvalidity)
    have = stored(spark, table)
    if have is not None:
        here = have.where((F.col("address") == settings.address) & (F.col("mailbox") == mailbox) & (F.col("uidvalidity") == report.uidvalidity))
        known = {r["uid"] for r in here.select("uid").toLocalIterator()}
        report.to_fetch = [u for u in report.to_fetch if u not in known]
    left = report.to_fetch
    for first in range(0, len(left), batch_size):
        part = Report(report.uidvalidity, report.server_size, left[first : first + batch_size])
        step(spark, settings, table, mailbox, part, strict, text_mode)
        report.done += part.done
        report.failed += part.failed
    return report


def step(spark: SparkSession, settings: Settings, table: str, mailbox: str, part: Report, strict: bool, text_mode: str) -> None:
    """Fetch once to a staged table, then store what came and record what did not."""
    staged = f"{table.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        parsed(fetched(spark, settings, mailbox, part, strict), text_mode).write.parquet(staged)
        rows = spark.read.parquet(staged)
        came = rows.where("fetch_error is null").drop("fetch_error")
        bad = rows.where("fetch_error is not null or parse_error is not null").select("address", "mailbox", "uidvalidity", "uid", F.coalesce("fetch_error", "parse_error").alias("error"), F.current_timestamp().alias("at"))
        if strict and not bad.isEmpty():
            raise IngestError(bad.first()["error"])
        part.failed = [r["uid"] for r in rows.where("fetch_error is not null").select("uid").collect()]
        part.done = came.count()
        if part.done:
            upsert(came, table)
        if not bad.isEmpty():
            bad.write.mode("append").parquet(f"{table.rstrip('/')}.failed")
    finally:
        delete(spark, staged)


def folder_slug(name: str) -> str:
    """A folder name as a path part of 3 to 63 safe characters, by the rule of extensions.folder_slug."""
    safe = "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "-" for c in name.lower())
    while "--" in safe:
        safe = safe.replace("--", "-")
    safe = safe.strip("-_")
    return safe[:63].rstrip("-_") if len(safe) >= 3 else "nm"


def archive(
    spark: SparkSession,
    settings: Settings,
    output: str,
    mailbox: str = "INBOX",
    strict: bool = False,
    yes: bool = False,
    only_preflight: bool = False,
    only_ids: str | Iterable[object] | None = None,
    uidvalidity: int | None = None,
    confirm: Confirm = never,
) -> Report:
    """Write the messages of a folder to <output>/<address>/<folder>/<uidvalidity>/<uid>.eml, in a folder that all executors share.

    Files that are there stay; those named by only_ids are written over, with
    yes or a confirmed question.
    """
    report = plan(Mailbox(settings, mailbox), only_ids, uidvalidity)
    base = shared(spark, f"{output.rstrip('/')}/{settings.address.lower()}/{folder_slug(mailbox)}/{report.uidvalidity}")
    there = {int(n[:-4]) for n in Folder(base).names() if n.endswith(".eml") and n[:-4].isdigit()}
    over = [u for u in report.to_fetch if u in there]
    if only_ids is None:
        report.to_fetch = [u for u in report.to_fetch if u not in there]
    elif over and not only_preflight and not (yes or confirm(f"Write over {', '.join(map(str, over))}?")):
        return Report(report.uidvalidity, report.server_size, cancelled=True)
    if only_preflight or not report.to_fetch:
        return report
    overwrite = only_ids is not None

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder(base)
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                error = row.fetch_error
                if not error:
                    try:
                        name = f"{row.uid}.eml"
                        if overwrite or not folder.holds(name):
                            folder.write(name, with_server_headers(row))
                    except OSError as e:
                        if strict:
                            raise
                        error = f"{type(e).__name__}: {e}"
                out.append((row.uid, error))
            yield pd.DataFrame(out, columns=["uid", "error"])

    told = fetched(spark, settings, mailbox, report, strict).mapInPandas(write, "uid long, error string").collect()
    report.done = sum(r["error"] is None for r in told)
    report.failed = [r["uid"] for r in told if r["error"] is not None]
    return report


def with_server_headers(row) -> bytes:
    """The message with what the server said of it, where its own headers do not."""
    labels = json.loads(row.labels_json or "[]")
    known = {
        "X-GM-THRID": None if pd.isna(row.x_gm_thrid) else int(row.x_gm_thrid),
        "X-GM-MSGID": None if pd.isna(row.x_gm_msgid) else int(row.x_gm_msgid),
        "X-GM-LABELS": labels or None,
        "X-IMAP-INTERNALDATE": None if pd.isna(row.internaldate) else format_datetime(row.internaldate.to_pydatetime().replace(tzinfo=UTC)),
        "X-RFC822-SIZE": None if pd.isna(row.rfc822_size) else int(row.rfc822_size),
    }
    return inject_headers(bytes(row.raw), known)
