"""Mail operators on small adversarial rows, the SQL guard and the SQL oracle."""

import glob
import os
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from courierlake.functions.predicates import ToolError, contains, epoch_of, limit_of
from courierlake.operators import analytics, extensions, retrieval
from courierlake.plans import catalogue
from courierlake.plans.sqlguard import checked, execute_sql_query
from courierlake.schema import EMAILS

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "INBOX", "ida@quay.example", "Crane booked", 1709360000, "c5", 41, 320, False),
    (2, "INBOX", "otto@reef.example", "Rope bill", 1709360300, "r2", 41, 75, True),
    (3, "Store", "ida@quay.example", "crane, again", 1709361000, "c5", 0, 4096, True),
    (4, "Store", None, None, 0, None, None, 0, False),
    (5, "Store", "", "7% of x_y", 1709361000, "", 52, 21, False),
    (6, "Store", "nobody", "back\\slash", 1709362000, "n6", 52, 22, False),
    (7, "Store", "p@q@r", "Über", 1709363000, "p7", 63, 23, False),
    (8, "Store", "v@sea.org.fake", "k", 1709364000, "v8", 63, 24, False),
    (9, "Store", "v@low.sea.org", "l", 1709365000, "v9", 63, 25, False),
]


@pytest.fixture(scope="module")
def emails(spark):
    names = ["id", "mailbox", "from_email", "subject", "internaldate_epoch", "message_id", "x_gm_thrid", "size_bytes", "has_attachments"]
    df = spark.createDataFrame(ROWS, "id long, mailbox string, from_email string, subject string, internaldate_epoch long, message_id string, x_gm_thrid long, size_bytes long, has_attachments boolean")
    return df.select(*(F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in EMAILS))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters(emails):
    def found(**given):
        return ids(retrieval.filter_emails(emails, **given))

    assert found(subject_contains="CRANE", order="date_asc") == [1, 3] and found(subject_contains="CRANE") == [3, 1]
    assert found(from_domain="@sea.org") == [8]
    assert (found(subject_contains="%"), found(subject_contains="x_y"), found(subject_contains="k\\s"), found(subject_contains="über")) == ([5], [5], [6], [7])
    assert len(found(date_from="no date")) == 9 and found(date_from="2024-03-02T07:20:00Z", mailbox="Store") == [9, 8]


def test_counts(emails):
    assert analytics.count_emails(emails, mailbox="").first()["count"] == 0
    assert [tuple(r) for r in analytics.get_top_senders(emails, limit=1).collect()] == [("ida@quay.example", 2)]
    assert {r["domain"] for r in analytics.get_top_domains(emails).collect()} == {"quay.example", "reef.example", "nobody", "q@r", "sea.org.fake", "low.sea.org"}
    stats = analytics.get_email_stats(emails).first()
    sizes = [r[7] for r in ROWS]
    assert (stats["total_emails"], stats["unique_senders"], stats["total_size_bytes"], stats["average_size_bytes"]) == (9, 6, sum(sizes), sum(sizes) // 9)
    assert analytics.get_email_stats(emails.limit(0)).first()["average_size_bytes"] == 0


def test_stats_agree_with_sqlite(emails):
    db = sqlite3.connect(":memory:")
    db.execute("create table emails (id, mailbox, from_email, subject, internaldate_epoch integer, message_id, x_gm_thrid, size_bytes, has_attachments)")
    db.executemany("insert into emails values (?,?,?,?,?,?,?,?,?)", ROWS)
    want = db.execute("select strftime('%w', internaldate_epoch, 'unixepoch') + 0, strftime('%H', internaldate_epoch, 'unixepoch') + 0, count(*) from emails group by 1, 2 order by 1, 2").fetchall()
    assert [tuple(r) for r in analytics.get_email_activity_heatmap(emails).collect()] == want


def test_duplicates(emails):
    assert ids(retrieval.get_duplicate_emails(emails, limit=1)) == []
    assert ids(retrieval.get_duplicate_emails(emails, limit=2)) == [1, 3]


def test_arguments(emails):
    assert [limit_of(x, 20, 100) for x in (-1, 0, None, "x", "5", 500)] == [20, 20, 20, 20, 5, 100]
    assert epoch_of("2025-01-31") == 1738281600 and epoch_of("never") is None and epoch_of("x") is None and epoch_of("") is None
    assert epoch_of("31 Jan 2025") == epoch_of("2025/01/31") == epoch_of("Fri, 31 Jan 2025 02:00:00 +0200") == epoch_of("January 31, 2025 00:00") == 1738281600
    for call in (lambda: retrieval.get_email_full(emails), lambda: retrieval.get_emails_by_date_range(emails, "x", "y"), lambda: retrieval.get_emails_by_size_range(emails, 5, 5), lambda: retrieval.get_emails_by_keywords(emails, " , ")):
        with pytest.raises(ToolError):
            call()


def test_slug(spark):
    names = {"Old Rope": "old-rope", "Quay": "quay", "Tide!?": "tide", "(Sea)/Low Tide": "sea-low-tide", "x--y": "x-y", "_reef_": "reef", "": "nm", "q": "nm", "z" * 90: "z" * 63}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", extensions.folder_slug(F.col("n"))).collect()} == names


@pytest.mark.parametrize("sql", ["select 1;", "select '%update%'", "select ';'", "select 1 -- x", "(select 1)", "select * from (select * from emails limit 5)", "select replace('a', 'a', 'b')"])
def test_guard_allows(sql):
    checked(sql)


@pytest.mark.parametrize("sql", ["", "select 1; select 2", "insert into emails values (1)", "with q as (select 1) delete from emails", "with q as (select 1) replace into emails select 1", "select reflect('java.lang.System', 'exit', 0)", "drop table emails"])
def test_guard_rejects(sql):
    with pytest.raises(ToolError):
        checked(sql)


def test_sql_is_limited_and_sees_views_only(emails):
    assert execute_sql_query({"emails": emails}, "select * from emails limit 999999 -- x", 4).count() == 4
    assert execute_sql_query({"emails": emails}, 'select "from" from emails', 4).columns == ["from"]
    with pytest.raises(ToolError, match="no such table"):
        execute_sql_query({"emails": emails}, f"select * from parquet.`{SF}/events.parquet`").collect()


HIDDEN = ["select * from global_temp.secret", "select * from stored", "select * from stored as stored", "select id from emails where id in (select id from stored)", "select (select max(id) from stored) from emails", "select * from (with stored as (select 1 as id) select * from stored) a, stored", "with q as (select * from stored) select * from q", "select * from identifier('stored')"]


@pytest.mark.parametrize("sql", HIDDEN)
def test_sql_reads_no_other_relation(spark, emails, sql, tmp_path):
    spark.range(3).createOrReplaceGlobalTempView("secret")
    spark.range(3).createOrReplaceTempView("stored")
    with pytest.raises(ToolError):
        execute_sql_query({"emails": emails}, sql)


@pytest.mark.parametrize("sql", ["select `reflect`('java.lang.System', 'exit', '0')", "select id from emails where `java_method`('a', 'b') = 'c'", "with q as (select 1) insert into emails select * from q"])
def test_sql_runs_no_code(emails, sql):
    with pytest.raises(ToolError, match="forbidden keyword detected"):
        execute_sql_query({"emails": emails}, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "select id, strftime('%Y-%m-%d %H:%M:%S %w %j %s %%', internaldate_epoch, 'unixepoch') from emails",
        "select id, date(internaldate_epoch, 'unixepoch'), time(internaldate_epoch, 'unixepoch'), datetime('2024-02-29 01:02:03') from emails",
        "select id as \"update\" from emails where subject like 'CRANE%'",
        "select id, 1 / 0, cast(id as text) from emails where has_attachments = 1",
        "with a as (select id, mailbox from emails), b as (select mailbox, count(*) as n from a group by mailbox) select * from b",
        "select id, 5/2, 7 / 2.0, cast(7 as real) / 2, -7/2, 9/2/2, (id + 3) / 2 * 2, id * 3 / 2, '/' , size_bytes / nullif(id - 3, 0) from emails -- 1/2",
        "select mailbox, count(*) / 2, sum(size_bytes) / count(*), avg(size_bytes) / 2 from emails group by mailbox having count(*) / 2 > 0",
        "select mailbox, group_concat(id), group_concat(id, '; ') from (select mailbox, max(id) as id from emails group by mailbox) group by mailbox",
        "select x / 2 from (select count(*) / 3 as x from emails where id in (select id / 1 from emails))",
        "select text from (select 'x' as text)",
        "select cast(cast(id as text) as text) as text, cast('a as text)' as text) from emails",
        "select instr(subject, 'o'), substr(subject, 2, 3), ifnull(subject, '-'), length(subject) from emails where subject is not null",
    ],
)
def test_sql_agrees_with_sqlite(emails, sql):
    db = sqlite3.connect(":memory:")
    db.execute("create table emails (id, mailbox, from_email, subject, internaldate_epoch integer, message_id, x_gm_thrid, size_bytes, has_attachments)")
    db.executemany("insert into emails values (?,?,?,?,?,?,?,?,?)", ROWS)
    want = db.execute(sql)
    got = execute_sql_query({"emails": emails}, sql)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("sql", ["select date('2024-01-02', '-1 day')", "select strftime('%W', '2024-01-02')", "select strftime('100%', '2024-01-02')"])
def test_sql_refuses_what_it_does_not_know(emails, sql):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="not understood"):
        execute_sql_query({"emails": emails}, sql).collect()


def test_ascii_folding(emails):
    assert ids(emails.where(contains(F.col("subject"), "über"))) == [7] and ids(emails.where(contains(F.col("subject"), "über", ascii_only=True))) == []
    assert ids(emails.where(contains(F.col("subject"), "CRANE", ascii_only=True))) == [1, 3]


def test_contains_is_literal(emails):
    assert ids(emails.where(contains(F.col("subject"), "x_y"))) == [5]


def value(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = catalogue.queries()[name](spark, SF)
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(value(x) for x in r) for r in want.fetchall())
    assert sorted(tuple(value(x) for x in r) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == rows
