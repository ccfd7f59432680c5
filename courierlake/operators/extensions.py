"""Extensions that the tool documents name but no tool implements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import ToolError, contains, epoch_of, filled, integer, limit_of, moment
from .retrieval import body, keyword_list, newest, predicate

PERIODS = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}


def period_of(name: str) -> Column:
    if name not in PERIODS:
        raise ToolError(f"period must be one of: {', '.join(PERIODS)}")
    return F.date_format(moment(), PERIODS[name])


def volume_by_period(emails: DataFrame, period: str = "monthly", limit=None, most: int = 1000) -> DataFrame:
    rows = emails.groupBy(period_of(period).alias("period")).agg(F.count("*").alias("count"))
    return rows.orderBy("period").limit(limit_of(limit, 365, most))


def reply_latency(emails: DataFrame, limit=None, most: int = 1000) -> DataFrame:
    """Seconds between successive messages of a thread from different senders."""
    by = Window.partitionBy("x_gm_thrid").orderBy("internaldate_epoch", "id")
    rows = emails.where("x_gm_thrid is not null and x_gm_thrid != 0").select("id", "x_gm_thrid", "internaldate_epoch", "from_email", F.lag("from_email").over(by).alias("replied_to"), F.lag("internaldate_epoch").over(by).alias("before"))
    rows = rows.where("from_email != replied_to").withColumn("latency_seconds", F.col("internaldate_epoch") - F.col("before"))
    return rows.orderBy("latency_seconds", "id").select("id", "x_gm_thrid", "replied_to", "from_email", "latency_seconds").limit(limit_of(limit, 50, most))


def size_classes(emails: DataFrame) -> DataFrame:
    """Counts by size; above 1 MB also counts as above 100 KB."""
    size = F.col("size_bytes")
    classes: dict[str, Column] = {"small": size < 10_240, "medium": size.between(10_240, 102_400), "large": size > 102_400, "huge": size > 1_048_576}
    totals = emails.agg(*(F.count_if(test).alias(name) for name, test in classes.items()))
    return totals.select(F.explode(F.array(*(F.struct(F.lit(n).alias("size_class"), F.col(n).alias("count")) for n in classes))).alias("x")).select("x.*")


#: Ids that a group of duplicates lists, from the smallest on; duplicate_members() has all, as rows.
LISTED = 1000


def repeated(emails: DataFrame, field: str, limit: object, most: int) -> DataFrame:
    """The commonest repeated keys and how often they occur, at most a limit of them."""
    keys = emails.where(F.col(field).isNotNull() & (F.col(field).cast("string") != "")).groupBy(field).agg(F.count("*").alias("count"))
    return keys.where("count > 1").orderBy(F.desc("count"), field).limit(limit_of(limit, 50, most))


def duplicate_members(emails: DataFrame, field: str = "message_id", limit=None, most: int = 1000) -> DataFrame:
    """A row for each message of the listed keys; no key is gathered."""
    return emails.join(F.broadcast(repeated(emails, field, limit, most)), field).select(field, "count", "id")


def duplicate_groups(emails: DataFrame, field: str = "message_id", limit=None, most: int = 1000) -> DataFrame:
    """Repeated keys, how often, and their first LISTED ids as a JSON array; ids beyond these leave before the shuffle."""
    rank = Window.partitionBy(field, "count").orderBy("id")
    some = duplicate_members(emails, field, limit, most).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= LISTED)
    ids = some.groupBy(field, "count").agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("ids"))
    return ids.orderBy(F.desc("count"), field)


def sender_days(emails: DataFrame, sender: str, date_from: str, date_to: str) -> DataFrame:
    """Messages of senders whose address holds the text, for every day from one date to the other, days without any too."""
    first, last = epoch_of(date_from), epoch_of(date_to)
    if first is None or last is None or last < first:
        raise ToolError("date_from and date_to must be dates in order")
    ends = [F.to_date(F.timestamp_seconds(F.lit(x))) for x in (first, last)]
    days = emails.sparkSession.range(1).select(F.explode(F.sequence(*ends)).alias("date"))
    until = F.unix_seconds(F.timestamp_seconds(F.lit(last)).cast("date").cast("timestamp")) + 86_400
    rows = emails.where(filled(F.col("from_email")) & contains(F.col("from_email"), sender) & (F.col("internaldate_epoch") >= first) & (F.col("internaldate_epoch") < until))
    counts = rows.groupBy(F.to_date(moment()).alias("date")).agg(F.count("*").alias("n"))
    found = days.join(counts, "date", "left").select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce("n", F.lit(0)).alias("count"))
    return found.orderBy("date")


#: Registers of a distinct-count sketch are 2**PRECISION, 4 KB: some 1.6 % of error.
PRECISION = 12


def sketches(emails: DataFrame) -> DataFrame:
    """By folder and day: messages, and sketches of the senders and sizes, which can be merged to any period."""
    rows = emails.groupBy("mailbox", F.date_format(moment(), "yyyy-MM-dd").alias("day"))
    return rows.agg(F.count("*").alias("count"), F.hll_sketch_agg("from_email", PRECISION).alias("senders"), F.kll_sketch_agg_bigint("size_bytes").alias("sizes"))


def merged_sketches(daily: DataFrame, period: int = 7) -> DataFrame:
    """Sketches by folder and the first `period` characters of the day (7: months, 4: years)."""
    rows = daily.groupBy("mailbox", F.substring("day", 1, period).alias("period"))
    return rows.agg(F.sum("count").alias("count"), F.hll_union_agg("senders").alias("senders"), F.kll_merge_agg_bigint("sizes").alias("sizes"))


def count_filtered(emails: DataFrame, most: int = 1000, **filters) -> DataFrame:
    """count_emails with the arguments of filter_emails."""
    named = {"from_domain_" if k == "from_domain" else k: v for k, v in filters.items()}
    return emails.where(predicate(**named)).agg(F.count("*").alias("count"))


def find_email(emails: DataFrame, id=None, mailbox=None, uid=None, uidvalidity=None, message_id=None, from_contains=None, subject_contains=None, date=None, order="date_desc", most: int = 1000) -> DataFrame:
    """One whole row by any of these; date is a year or a day (of receipt, UTC)."""
    test = predicate(mailbox, from_contains, None, subject_contains)
    for name, value in (("id", id), ("uid", uid), ("uidvalidity", uidvalidity)):
        if value not in (None, ""):
            test &= F.col(name) == integer(value)
    if message_id:
        test &= F.col("message_id") == str(message_id).strip("<>")
    if date:
        text = str(date).strip()
        pattern = "yyyy" if len(text) == 4 else "yyyy-MM-dd"
        if pattern != "yyyy" and epoch_of(text) is None:
            raise ToolError(f"invalid date format: {text}")
        test &= F.date_format(moment(), pattern) == text[: 4 if pattern == "yyyy" else 10]
    by = F.asc("internaldate_epoch") if order == "date_asc" else F.desc("internaldate_epoch")
    return emails.where(test).orderBy(by, "id").limit(1)


def stats_with_tops(emails: DataFrame, top_limit=None, most: int = 1000) -> DataFrame:
    """How many messages, from when to when, and the commonest senders, domains and folders as lists of (name, count).

    One pass counts each (folder, sender); all lists come from that table.
    """
    n = limit_of(top_limit, 10, most)
    pairs = emails.groupBy("mailbox", "from_email").agg(F.count("*").alias("n"), F.min("internaldate_epoch").alias("first"), F.max("internaldate_epoch").alias("last"))
    known = pairs.where(filled(F.col("from_email")))
    keys = {"top_senders": (known, F.col("from_email")), "top_domains": (known, F.expr("substring(from_email, instr(from_email, '@') + 1)")), "mailbox_distribution": (pairs, F.col("mailbox"))}
    out = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_emails"), F.min("first").alias("earliest_epoch"), F.max("last").alias("latest_epoch"))
    for name, (rows, key) in keys.items():
        top = rows.groupBy(key.alias("name")).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "name").limit(n)
        listed = top.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "name"))), lambda x: F.struct(x["name"].alias("name"), (-x["less"]).alias("count")))).alias(name))
        out = out.withColumn("one", F.lit(1)).join(F.broadcast(listed.withColumn("one", F.lit(1))), "one").drop("one")  # one row each
    return out


def heatmap_named(emails: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Counts by hour and weekday, with its name, between two times."""
    rows = emails.where(predicate(date_from=date_from, date_to=date_to))
    rows = rows.groupBy(F.hour(moment()).alias("hour"), (F.dayofweek(moment()) - 1).alias("day_number"), F.date_format(moment(), "EEEE").alias("day_of_week")).agg(F.count("*").alias("count"))
    return rows.orderBy("day_number", "hour").select("hour", "day_of_week", "day_number", "count")


def sender_periods(emails: DataFrame, sender=None, period: str = "monthly", limit=None, most: int = 1000) -> DataFrame:
    """Messages of each sender whose address holds the text, by day, month or year."""
    rows = emails.where(filled(F.col("from_email")))
    rows = rows.where(contains(F.col("from_email"), str(sender))) if sender else rows
    found = rows.groupBy(F.col("from_email").alias("from"), period_of(period).alias("period")).agg(F.count("*").alias("count"))
    return found.orderBy(F.desc("count"), "from", "period").limit(limit_of(limit, 50, most))


def seasons(emails: DataFrame, until: int, years_back=None, most: int = 1000) -> DataFrame:
    """Months of the years up to `until`, with their season in the north."""
    back = integer(years_back) if integer(years_back) > 0 else 3
    month = F.month(moment())
    season = F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").otherwise("Fall")
    rows = emails.where(F.year(moment()).between(until - back + 1, until))
    rows = rows.groupBy(F.year(moment()).alias("year"), month.alias("month"), season.alias("season"), F.date_format(moment(), "MMMM").alias("month_name")).agg(F.count("*").alias("count"))
    return rows.orderBy("year", "month")


def header_pattern(emails: DataFrame, pattern, limit=None, most: int = 1000) -> DataFrame:
    """Messages whose raw header, up to the first blank line, holds the text."""
    if pattern in (None, ""):
        raise ToolError("header_pattern is required")
    head = F.regexp_extract(F.make_valid_utf8(F.col("raw").cast("string")), r"(?s)\A(.*?)(?:\r?\n\r?\n|\z)", 1)
    return newest(emails.where(contains(head, str(pattern))), limit_of(limit, 100, most))


def keyword_score(emails: DataFrame, keywords, search_field: str = "plain_text", limit=None, most: int = 1000) -> DataFrame:
    """Matched terms over all terms, best first, and how often the terms occur."""
    terms = keyword_list(keywords)
    text = F.lower(F.coalesce(body(search_field), F.lit("")))
    matched = sum((F.contains(text, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    times = sum(((F.length(text) - F.length(F.replace(text, F.lit(t.lower()), F.lit("")))) / len(t) for t in terms), F.lit(0.0)).cast("long")
    rows = emails.select("id", "internaldate_epoch", matched.alias("matched"), times.alias("occurrences")).where("matched > 0")
    return rows.orderBy(F.desc("matched"), F.desc("internaldate_epoch"), "id").select("id", "matched", "occurrences", (F.col("matched") / F.lit(float(len(terms)))).alias("score")).limit(limit_of(limit, 50, most))


def cosine_to(query: list[float], v: Column) -> Column:
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    q = F.array(*(F.lit(float(x)) for x in query))
    return dot(v, q) / F.nullif(F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)), F.lit(0.0))


def vector_topk(vectors: DataFrame, query: list[float], limit=None, most: int = 1000) -> DataFrame:
    """Rows with the greatest cosine to the query, by exact scan and top-k."""
    return vectors.select("vec_id", F.round(cosine_to(query, F.col("embedding")), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(limit_of(limit, 10, most))


def vector_search(vectors: DataFrame, query: list[float], item_types: list[str] | None = None, limit=None, most: int = 1000) -> DataFrame:
    """Messages by their nearest variant, nearest first: id, item_type and score (cosine distance) of vectors (id, item_type, embedding)."""
    rows = vectors.where(F.col("item_type").isin(*item_types)) if item_types else vectors
    scored = rows.select("id", "item_type", F.round(1 - cosine_to(query, F.col("embedding")), 6).alias("score")).where("score is not null")
    best = scored.groupBy("id").agg(F.min(F.struct("score", "item_type")).alias("best"))
    return best.select("id", "best.item_type", "best.score").orderBy("score", "id").limit(limit_of(limit, 100, most))


def variants(emails: DataFrame) -> DataFrame:
    """Up to three documents a message: subject, text and markdown; blank ones are left out."""

    def one(kind: str, short: str, text: str) -> Column:
        return F.struct(F.concat_ws(":", "uidvalidity", "uid", F.lit(short)).alias("variant_id"), F.lit(kind).alias("item_type"), F.col(text).alias("document"))

    made = F.array(one("subject", "subject", "subject"), one("plain_text", "text", "plain_text"), one("markdown", "markdown", "markdown"))
    kept = F.filter(made, lambda x: x["document"].isNotNull() & (F.trim(x["document"]) != ""))
    return emails.select("id", F.explode(kept).alias("v")).select("id", "v.variant_id", "v.item_type", "v.document")


def folder_slug(name: Column) -> Column:
    """A folder name as a path part of 3 to 63 safe characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9_-]+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^[-_]+|[-_]+$", "")
    s = F.when(F.length(s) < 3, F.lit("nm")).otherwise(F.regexp_replace(F.substring(s, 1, 63), "[-_]+$", ""))
    return F.when(s == "", F.lit("nm")).otherwise(s)
