"""Tools that list messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import ToolError, contains, epoch_of, filled, from_domain, integer, limit_of, required
from ..schema import BASE
from .textindex import search_shared, search_words

HEADERS = ("subject", "from", "to_emails", "cc_emails", "bcc_emails", "message_id")
BODIES = ("plain_text", "markdown", "subject", "raw")


def newest(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    return rows.orderBy(F.desc("internaldate_epoch"), "id").select(*(columns or BASE)).limit(n)


def oldest(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    return rows.orderBy("internaldate_epoch", "id").select(*(columns or BASE)).limit(n)


def list_earliest_emails(emails: DataFrame, limit: object = None, most: int = 1000) -> DataFrame:
    return emails.orderBy(F.asc_nulls_first("date"), "internaldate_epoch", "id").select(*BASE).limit(limit_of(limit, 100, most))


def get_email_full(emails: DataFrame, id: object = None, most: int = 1000) -> DataFrame:
    """The whole row; a server reports a missing one."""
    return emails.where(F.col("id") == integer(required(id, "id"))).limit(1)


def predicate(
    mailbox: str | None = None,
    from_contains: str | None = None,
    from_domain_: str | None = None,
    subject_contains: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    ascii_only: bool = False,
) -> Column:
    """The conjunction of the given filters; a blank one is absent and a date that can't be read is dropped. ascii_only: only A to Z lose their case."""
    found = F.lit(True)
    if mailbox:
        found &= F.col("mailbox") == mailbox
    if from_contains:
        found &= contains(F.col("from"), from_contains, ascii_only) | contains(F.col("from_email"), from_contains, ascii_only)
    if from_domain_:
        found &= from_domain(from_domain_)
    if subject_contains:
        found &= contains(F.col("subject"), subject_contains, ascii_only)
    for text, bound in ((date_from, "ge"), (date_to, "le")):
        at = epoch_of(text) if text else None
        if at is not None:
            found &= F.col("internaldate_epoch") >= at if bound == "ge" else F.col("internaldate_epoch") <= at
    return found


def filter_emails(emails: DataFrame, mailbox=None, from_contains=None, from_domain=None, subject_contains=None, date_from=None, date_to=None, order=None, limit=None, most: int = 1000, ascii_only: bool = False) -> DataFrame:
    rows = emails.where(predicate(mailbox, from_contains, from_domain, subject_contains, date_from, date_to, ascii_only))
    return (oldest if order == "date_asc" else newest)(rows, limit_of(limit, 100, most))


def get_emails_by_date_range(emails: DataFrame, start_date=None, end_date=None, limit=None, most: int = 1000) -> DataFrame:
    """Both ends are inclusive instants; a bare date is its first."""
    ends = []
    for name, text in (("start_date", start_date), ("end_date", end_date)):
        at = epoch_of(required(text, name))
        if at is None:
            raise ToolError(f"invalid date format: {text}")
        ends.append(at)
    return oldest(emails.where(F.col("internaldate_epoch").between(*ends)), limit_of(limit, 100, most))


def get_emails_with_attachments(emails: DataFrame, limit=None, mailbox=None, date_from=None, date_to=None, most: int = 1000) -> DataFrame:
    rows = emails.where(F.col("has_attachments") & predicate(mailbox, date_from=date_from, date_to=date_to))
    return newest(rows, limit_of(limit, 50, most))


def get_email_thread(emails: DataFrame, x_gm_thrid=None, limit=None, most: int = 1000) -> DataFrame:
    return oldest(emails.where(F.col("x_gm_thrid") == integer(required(x_gm_thrid, "x_gm_thrid"))), limit_of(limit, 50, most))


def get_largest_emails(emails: DataFrame, limit=None, from_domain=None, attachments=None, mailbox=None, most: int = 1000) -> DataFrame:
    """Whole rows, the longest raw message first."""
    rows = emails.where(predicate(mailbox, None, from_domain))
    if attachments in ("with", "without"):
        rows = rows.where(F.coalesce("has_attachments", F.lit(False)) == F.lit(attachments == "with"))
    # the keys first, at most a limit of them: whole rows are read for these alone
    keys = rows.orderBy(F.desc("size_bytes"), "id").select("id").limit(limit_of(limit, 5, most))
    return emails.join(F.broadcast(keys), "id", "left_semi").orderBy(F.desc("size_bytes"), "id")


def get_emails_by_size_range(emails: DataFrame, min_size=None, max_size=None, limit=None, most: int = 1000) -> DataFrame:
    low, high = integer(min_size), integer(max_size)
    if low < 0:
        raise ToolError("min_size must be >= 0")
    if high <= low:
        raise ToolError("max_size must be > min_size")
    rows = emails.where(F.col("size_bytes").between(low, high))
    return rows.orderBy(F.desc("size_bytes"), "id").select(*BASE, "size_bytes").limit(limit_of(limit, 50, most))


def search_email_headers(emails: DataFrame, query=None, header_field="subject", limit=None, most: int = 1000, ascii_only: bool = False) -> DataFrame:
    required(query, "query")
    if header_field not in HEADERS:
        raise ToolError(f"header_field must be one of: {', '.join(HEADERS)}")
    return newest(emails.where(contains(F.col(header_field), str(query), ascii_only)), limit_of(limit, 50, most))


def keyword_list(keywords: object) -> list[str]:
    """Terms of a comma-separated string or an array, without blanks."""
    parts = keywords if isinstance(keywords, list | tuple) else str(required(keywords, "keywords")).split(",")
    found = [str(p).strip() for p in parts if str(p).strip()]
    if not found:
        raise ToolError("at least one keyword required")
    return found


def body(field: str) -> Column:
    return F.make_valid_utf8(F.col("raw").cast("string")) if field == "raw" else F.col(field)


def get_emails_by_keywords(emails: DataFrame, keywords=None, search_field="plain_text", match_all=False, limit=None, most: int = 1000, ascii_only: bool = False) -> DataFrame:
    terms = keyword_list(keywords)
    if search_field not in BODIES:
        raise ToolError(f"search_field must be one of: {', '.join(BODIES)}")
    tests = [contains(body(search_field), t, ascii_only) for t in terms]
    found = tests[0]
    for t in tests[1:]:
        found = found & t if match_all is True else found | t
    present = F.col("raw").isNotNull() if search_field == "raw" else filled(F.col(search_field))
    return newest(emails.where(present & found), limit_of(limit, 50, most))


def get_duplicate_emails(emails: DataFrame, field="message_id", limit=None, most: int = 1000) -> DataFrame:
    """Rows of the first limit/2 repeated keys in key order; keys are at most that many, so they are broadcast."""
    if field not in ("message_id", "x_gm_msgid"):
        raise ToolError("field must be 'message_id' or 'x_gm_msgid'")
    n = limit_of(limit, 50, most)
    key = F.col(field)
    present = filled(key) if field == "message_id" else key.isNotNull()
    keys = emails.where(present).groupBy(field).count().where("count > 1").orderBy(field).limit(n // 2).select(field)
    return oldest(emails.join(F.broadcast(keys), field, "left_semi"), n)


def search_emails(emails: DataFrame, query=None, limit=None, most: int = 1000, index: str | None = None, shared: bool = False) -> DataFrame:
    """The messages that score most for the words of the query, by an index of theirs at a path; without one it answers nothing, as the tool catalogue has it.

    shared: the index has bodies apart (textindex.append_shared).
    """
    if index is None:
        return emails.select(*BASE).limit(0)
    hits = (search_shared if shared else search_words)(emails.sparkSession, index, str(required(query, "query")), limit_of(limit, 100, most))
    # at most a limit of hits
    found = emails.select(*BASE).join(F.broadcast(hits), F.col("id") == F.col("doc")).drop("doc")
    return found.orderBy(F.desc("score"), "id")
