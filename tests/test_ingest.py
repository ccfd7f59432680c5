"""Parsing, the .eml tree, idempotent and incremental ingest, and the server."""

import io
import json

import pytest
from pyspark.sql import functions as F

from courierlake.functions.mail import inject_headers, parse_message, to_markdown
from courierlake.ingest import purge, stored, upsert
from courierlake.plans.emails import emails
from courierlake.schema import EMAILS
from courierlake.server import Server
from courierlake.sources.eml import read_eml
from courierlake.streaming.incremental import ingest_new

HAIL = b"From: Ida Vane <Ida@Quay.example>\r\nTo: Wharf@Quay.example\r\nReply-To: desk@quay.example\r\nMessage-ID: <hail-5@quay.example>\r\nSubject: Crane booked\r\nDate: Mon, 06 May 2024 09:15:00 +0200\r\n\r\nThe crane comes at noon.\r\n"
REPLY = b'From: wharf@quay.example\r\nMessage-ID: <echo-6@quay.example>\r\nIn-Reply-To: <hail-5@quay.example>\r\nReferences: <hail-5@quay.example> <root-1@quay.example>\r\nSubject: Re: Crane booked\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="sep"\r\n\r\n--sep\r\nContent-Type: text/plain\r\n\r\nNoon it is.\r\n--sep\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename="loads.csv"\r\n\r\n7,9\r\n--sep--\r\n'


def put(base, uid, raw, uidvalidity=7):
    folder = base / "me@example.com" / "inbox" / str(uidvalidity)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{uid}.eml").write_bytes(raw)


def test_parse():
    hail, reply = parse_message(HAIL), parse_message(REPLY)
    assert (hail["message_id"], hail["from_email"], hail["subject"]) == ("hail-5@quay.example", "ida@quay.example", "Crane booked")
    assert json.loads(hail["envelope_reply_to"]) == ["desk@quay.example"] and json.loads(hail["to_emails"]) == ["wharf@quay.example"]
    assert reply["envelope_in_reply_to"] == hail["message_id"] and json.loads(reply["envelope_references"])[-1] == "root-1@quay.example"
    assert reply["has_attachments"] and not hail["has_attachments"] and reply["plain_text"].split() == ["Noon", "it", "is."]
    assert hail["date"].isoformat() == "2024-05-06T09:15:00+02:00"
    assert parse_message(b"")["subject"] == "" and parse_message(b"Date: soon\n\n")["date"] is None
    assert to_markdown("<h2>Tides</h2><ul><li>low <i>six</i><li>high</ul><a href=t>table</a>") == "## Tides\n\n- low *six*\n- high[table](t)"


def test_headers():
    raw = b"Subject: Pier 4\nX-Old: kept\n\nropes"
    assert inject_headers(raw, {"X-New": [1, "b"], "x-old": "other", "X-None": None}) == b"Subject: Pier 4\nX-Old: kept\nX-New: 1 b\n\nropes"
    assert inject_headers(b"Subject: no end", {"X-New": 7}) == b"Subject: no end\nX-New: 7"
    assert inject_headers(b"A: 1\r\n\r\n", {"B": 2}) == b"A: 1\r\nB: 2\r\n\r\n"


def test_ingest(spark, tmp_path):
    base, table = tmp_path / "eml", str(tmp_path / "emails")
    put(base, 1, HAIL)
    put(base, 2, REPLY)
    for _ in range(2):
        upsert(read_eml(spark, str(base)), table)
    assert stored(spark, table).count() == 2
    put(base, 1, HAIL.replace(b"Crane booked", b"Crane moved"))
    upsert(read_eml(spark, str(base)), table)
    assert stored(spark, table).where("subject = 'Crane moved'").count() == 0
    upsert(read_eml(spark, str(base)), table, recreate=True)
    assert [r["subject"] for r in stored(spark, table).orderBy("uid").collect()] == ["Crane moved", "Re: Crane booked"]
    purge(spark, table, "me@example.com", "inbox", 7)
    assert stored(spark, table) is None or stored(spark, table).where("uidvalidity = 7").count() == 0


def test_incremental(spark, tmp_path):
    base, table, state = tmp_path / "eml", str(tmp_path / "emails"), str(tmp_path / "state")
    put(base, 1, HAIL)
    for n in (1, 2, 2):
        if n == 2:
            put(base, 2, REPLY) if stored(spark, table).count() == 1 else None
        ingest_new(spark, str(base), table, state)
        assert stored(spark, table).count() == n


def test_server(spark):
    log = io.StringIO()
    server = Server(emails(spark, "/root/testdata/sf0.001").where(F.col("id") < 50).cache(), 100, log)
    asks = [
        {"id": 1, "method": "initialize"},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "db.count_emails", "arguments": {}}},
        {"id": 4, "method": "tools/call", "params": {"name": "db.get_email_full", "arguments": {"id": -1}}},
        {"id": 5, "method": "tools/call", "params": {"name": "db.nothing"}},
        {"id": 6, "method": "tools/call", "params": {"name": "db.execute_sql_query", "arguments": {"sql_query": "select nope from emails"}}},
        {"id": 7, "method": "odd"},
        {"id": 8, "method": "shutdown"},
    ]
    out = io.StringIO()
    server.serve(io.StringIO("no json\n" + "\n".join(map(json.dumps, asks))), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    said = lambda k: json.loads(got[k]["result"]["content"][0]["text"])
    tools = {t["name"]: t for t in got[2]["result"]["tools"]}
    assert len(tools) == 22 and all(t["description"] and p["description"] for t in tools.values() for p in t["inputSchema"]["properties"].values())
    assert tools["db.get_email_full"]["inputSchema"]["required"] == ["id"] and tools["db.get_emails_by_size_range"]["inputSchema"]["properties"]["min_size"]["type"] == "integer"
    assert said(3) == {"count": 50}
    assert said(4) == {"error": "email not found with id: -1"} and said(5) == {"error": "Unknown tool: db.nothing"}
    assert "error" in said(6) and got[7]["error"]["code"] == -32601 and got[8]["result"] == {}
    assert [json.loads(x)["tool"] for x in log.getvalue().splitlines()] == ["db.count_emails", "db.get_email_full", "db.nothing", "db.execute_sql_query"]


@pytest.mark.parametrize(
    "name, args, message",
    [
        ("search_email_headers", {"query": "x", "header_field": "raw"}, "header_field must be one of: subject, from, to_emails, cc_emails, bcc_emails, message_id"),
        ("get_emails_by_keywords", {"keywords": " , "}, "at least one keyword required"),
        ("get_emails_by_keywords", {}, "keywords is required"),
        ("get_emails_by_keywords", {"keywords": ["x"], "search_field": "from"}, "search_field must be one of: plain_text, markdown, subject, raw"),
        ("get_duplicate_emails", {"field": "subject"}, "field must be 'message_id' or 'x_gm_msgid'"),
        ("get_email_thread", {}, "x_gm_thrid is required"),
        ("execute_sql_query", {"sql_query": "select 1; select 2"}, "multiple statements not allowed"),
        ("execute_sql_query", {"sql_query": "explain select 1"}, "only SELECT/WITH allowed"),
    ],
)
def test_errors(spark, name, args, message):
    assert Server(spark.createDataFrame([], EMAILS)).call(f"db.{name}", args) == {"error": message}


def test_labels_come_back():
    from courierlake.functions.mail import inject_headers, label_text, parse_message, read_labels

    for labels in (["[Gmail]/Sent Mail", "Work"], ['a "b" c', "back\\slash", "é ü", ""], ["\\Inbox", "x"], ["one"]):
        assert read_labels(label_text(labels)) == labels
    raw = inject_headers(b"Subject: s\r\n\r\nbody", {"X-GM-LABELS": ["[Gmail]/Sent Mail", "Work"]})
    import json

    assert json.loads(parse_message(raw)["told_labels"]) == ["[Gmail]/Sent Mail", "Work"]


def test_a_failed_overwrite_keeps_the_rows(spark, tmp_path, monkeypatch):
    from courierlake import ingest

    path = str(tmp_path / "mail")
    rows = spark.createDataFrame([("a", "INBOX", 1), ("a", "INBOX", 2)], "address string, mailbox string, uid int")
    rows.write.partitionBy("address", "mailbox").parquet(path)
    before = ingest.put

    def fails(s, staged, p):
        s.read.parquet(p).where("uid = 1").write.mode("append").parquet(str(tmp_path / "other"))
        ingest.delete(s, p)  # the old files are gone when the commit fails
        raise ingest.IngestError("lost")

    monkeypatch.setattr(ingest, "put", fails)
    with pytest.raises(ingest.IngestError):
        ingest.replace(spark, rows, path)
    monkeypatch.setattr(ingest, "put", before)
    assert ingest.restore(spark, path) == 1 and ingest.restore(spark, path) == 0
    assert sorted(r["uid"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_search_tool_reads_the_servers_index_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from courierlake.operators.textindex import append_words
    from courierlake.plans.emails import emails
    from courierlake.server import Server

    e = emails(spark, "/root/testdata/sf0.001").where(F.col("id") < 60)
    append_words(e.select("id", F.concat_ws(" ", "subject", "plain_text").alias("text")), str(tmp_path / "words"), "id")
    hits = Server(e, index=str(tmp_path / "words")).call("db.search_emails", {"query": "purchase", "limit": 3})
    assert len(hits) == 3 and all("purchase" in h["subject"] for h in hits) and hits[0]["score"] >= hits[2]["score"]
    assert Server(e).call("db.search_emails", {"query": "purchase", "index": str(tmp_path / "words")}) == []
    assert all("index" not in t["inputSchema"]["properties"] for t in Server(e).tools())
