"""The mail server source, download, archive, commands and the SQLite import, against a server and files made here."""

import io
import json
import sqlite3

import pytest
from imap_server import Server
from pyspark.sql import functions as F

from courierlake import cli, sync
from courierlake.functions.mail import normalize_utf8, parse_message, variants_for
from courierlake.ingest import IngestError, SchemaVersionError, compact, stored, upsert, version
from courierlake.schema import EMAILS, missing
from courierlake.settings import FetchSizeError, NoValidityError, Settings, SettingsError
from courierlake.sources.eml import read_eml
from courierlake.sources.imap import ImapSource, Mailbox, decoded, encoded, numbers, options, ranges
from courierlake.sources.sqlite import SourceSchemaError, read_sqlite

WORD = "open sesame"


def letter(n, text="Bring the blue ladder."):
    return f"From: Nora Quill <Nora@Harbour.example>\r\nTo: crew@harbour.example\r\nMessage-ID: <tide-{n}@harbour.example>\r\nSubject: Tide table {n}\r\nDate: Sat, 02 Mar 2024 08:0{n % 10}:00 +0100\r\n\r\n{text}\r\n".encode()


def message(n, labels=("Boats", 'a "b" \\c')):
    return {"raw": letter(n), "labels": list(labels), "thread": 500 + n % 2, "date": f"02-Mar-2024 07:0{n % 10}:30 +0000"}


@pytest.fixture
def server():
    s = Server({"INBOX": {"uidvalidity": 31, "messages": {n: message(n) for n in (3, 4, 5, 9)}}, "Caf&AOk-": {"uidvalidity": 2, "messages": {}}, "Odd": {"uidvalidity": None, "messages": {}}})
    yield s
    s.shutdown()
    s.server_close()


@pytest.fixture
def settings(server):
    return Settings("nora@harbour.example", WORD, "127.0.0.1", server.server_address[1], False, 2)


def test_settings(monkeypatch):
    assert (Settings("a", "b").host, Settings("a", "b").port, Settings("a", "b").tls, Settings("a", "b").max_fetch_size) == ("imap.gmail.com", 993, True, 100)
    for bad in ({"address": "", "password": "b"}, {"address": "a", "password": None}, {"address": "a", "password": "b", "max_fetch_size": 0}):
        with pytest.raises(SettingsError):
            Settings(**bad)
    monkeypatch.setenv("COURIERLAKE_ADDRESS", "env")
    monkeypatch.setenv("COURIERLAKE_PASSWORD", "w")
    monkeypatch.setenv("COURIERLAKE_MAX_FETCH_SIZE", "7")
    assert (Settings.of().address, Settings.of("own").address, Settings.of().max_fetch_size, Settings.of(max_fetch_size=3).max_fetch_size) == ("env", "own", 7, 3)
    assert "w" not in repr(Settings("a", "w1"))


def test_names_and_numbers():
    for name in ("INBOX", "Café & Söhne", "日本語", "a-b"):
        assert decoded(encoded(name)) == name
    assert ranges([5, 1, 2, 3, 9, 9]) == "1:3,5,9" and numbers("1:3,5,9") == [1, 2, 3, 5, 9] and numbers("") == []


def test_mailbox(settings, server):
    assert Mailbox(settings).folders() == ["Café", "INBOX", "Odd"]
    found = Mailbox(settings).preflight([4])
    assert (found.uidvalidity, found.server_size, found.to_fetch) == (31, 4, [3, 5, 9]) and "X-GM-EXT-1" in found.capabilities
    assert Mailbox(settings, "Café").preflight().to_fetch == []
    with pytest.raises(NoValidityError):
        Mailbox(settings, "Odd").preflight()
    with pytest.raises(FetchSizeError):
        Mailbox(settings).fetch([3, 4, 5])
    one, two = Mailbox(settings).fetch([3, 4])
    assert one["raw"] == letter(3) and json.loads(two["labels_json"]) == ["Boats", 'a "b" \\c'] and two["x_gm_msgid"] == 9004
    assert Mailbox(settings).fetch([77]) == [] and "SELECT" not in server.seen


def test_source(spark, settings, server):
    spark.dataSource.register(ImapSource)
    read = spark.read.format("imap")
    assert [r["mailbox"] for r in read.options(**options(settings, mode="list")).load().collect()] == ["Café", "INBOX", "Odd"]
    rows = read.options(**options(settings, "INBOX", [3, 4, 5, 9], 31)).load()
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 4
    server.broken.add(9)
    got = {r["uid"]: r["fetch_error"] for r in rows.collect()}
    assert got[3] is None and got[4] is None and "broken" in got[5] and "broken" in got[9]


def test_download(spark, settings, server, tmp_path):
    table = str(tmp_path / "emails")
    plan = sync.download(spark, settings, table, only_preflight=True)
    assert plan.to_fetch == [3, 4, 5, 9] and stored(spark, table) is None
    assert sync.download(spark, settings, table, only_ids="3, x,-1", uidvalidity=31).done == 1
    assert sync.download(spark, settings, table, batch_size=2).done == 3
    rows = {r["uid"]: r for r in stored(spark, table).collect()}
    assert set(rows) == {3, 4, 5, 9} and sync.download(spark, settings, table).to_fetch == []
    r = rows[4]
    assert (r["from_email"], r["message_id"], r["uidvalidity"], r["x_gm_thrid"], r["rfc822_size"], r["internaldate_epoch"]) == ("nora@harbour.example", "tide-4@harbour.example", 31, 500, len(letter(4)), 1709363070)
    assert json.loads(r["labels_json"]) == ["Boats", 'a "b" \\c'] and r["created_at"] is not None and not missing(stored(spark, table))
    server.folders["INBOX"]["messages"][10] = message(10)
    assert sync.download(spark, settings, table).done == 1
    server.folders["INBOX"]["messages"][4] = {**message(4), "raw": letter(4).replace(b"Tide", b"Storm")}
    assert sync.download(spark, settings, table, recreate=True).cancelled
    done = sync.download(spark, settings, table, recreate=True, yes=True)
    assert (done.removed, done.done) == (5, 5)
    assert stored(spark, table).where("subject like 'Storm%'").count() == 1
    assert sync.download(spark, settings, table, purge_uidvalidity=31, confirm=lambda question: "31" in question).removed == 5
    assert stored(spark, table) is None or stored(spark, table).count() == 0
    for bad in (lambda: sync.download(spark, settings, table, only_ids="x"), lambda: sync.download(spark, settings, table, batch_size=0)):
        with pytest.raises(SettingsError):
            bad()


def test_download_goes_on_after_errors(spark, settings, server, tmp_path):
    table = str(tmp_path / "emails")
    server.broken.add(9)
    with pytest.raises(Exception, match="broken"):
        sync.download(spark, settings, table, strict=True)
    report = sync.download(spark, settings, table)
    assert (report.done, report.failed) == (2, [5, 9])
    assert {r["uid"] for r in spark.read.parquet(table + ".failed").collect()} == {5, 9}
    server.broken.clear()
    assert sync.download(spark, settings, table).to_fetch == [5, 9]
    assert stored(spark, table).count() == 4


def test_archive(spark, settings, server, tmp_path):
    base = tmp_path / "tree"
    folder = base / "nora@harbour.example" / "inbox" / "31"
    assert sync.archive(spark, settings, str(base), only_preflight=True).to_fetch == [3, 4, 5, 9] and not list(base.rglob("*.eml"))
    folder.mkdir(parents=True)
    (folder / "4.eml").write_bytes(b"kept")
    assert sync.archive(spark, settings, str(base)).done == 3 and sync.archive(spark, settings, str(base)).to_fetch == []
    assert (folder / "4.eml").read_bytes() == b"kept" and not [p for p in folder.iterdir() if p.suffix == ".tmp"]
    head = (folder / "3.eml").read_bytes().split(b"\r\n\r\n")[0].decode()
    assert "X-GM-THRID: 501" in head and "X-GM-MSGID: 9003" in head and f"X-RFC822-SIZE: {len(letter(3))}" in head and "X-IMAP-INTERNALDATE: Sat, 02 Mar 2024 07:03:30 +0000" in head
    assert sync.archive(spark, settings, str(base), only_ids=[4]).cancelled
    assert sync.archive(spark, settings, str(base), only_ids=[4], yes=True).done == 1 and b"Tide table 4" in (folder / "4.eml").read_bytes()
    back = {r["uid"]: r for r in read_eml(spark, str(base)).collect()}
    assert set(back) == {3, 4, 5, 9} and back[3]["x_gm_thrid"] == 501 and back[3]["internaldate_epoch"] == 1709363010 and back[3]["rfc822_size"] == len(letter(3))
    server.broken.add(11)
    server.folders["INBOX"]["messages"] |= {11: message(11), 12: message(12), 13: message(13)}
    assert sorted(sync.archive(spark, settings, str(base)).failed) == [11, 12]
    assert sync.folder_slug("[Work]/Old  Mail") == "work-old-mail" and sync.folder_slug("é") == "nm"


def test_commands(settings, tmp_path):
    port = str(settings.port)
    account = ["-a", settings.address, "-p", WORD, "--host", "127.0.0.1", "--port", port, "--plain"]

    def run(*argv, answer=""):
        out, err = io.StringIO(), io.StringIO()
        return cli.main(argv, io.StringIO(answer), out, err), out.getvalue(), err.getvalue()

    assert run("mailbox", "list", *account)[:2] == (0, "Café\nINBOX\nOdd\n")
    assert run("mailbox", "list", *account[:2], "-p", "wrong", *account[4:])[0] == 2
    assert run("mailbox", "list", "-a", "x")[0] == 1 and run("mailbox", "paint")[0] == 1 and run("mailbox", "archive", *account)[0] == 1
    table = str(tmp_path / "emails")
    code, out, _ = run("mailbox", "download", *account, "--table", table, "--only-preflight")
    assert code == 0 and "uids: 3, 4, 5, 9" in out
    assert run("mailbox", "download", *account, "--table", table, "--only-ids", "x")[0] == 1
    assert "done=4" in run("mailbox", "download", *account, "--table", table)[1]
    assert "cancelled" in run("mailbox", "download", *account, "--table", table, "--recreate", answer="no\n")[1]
    assert "removed=4" in run("mailbox", "download", *account, "--table", table, "--purge-uidvalidity", "31", answer="DELETE\n")[1]
    assert run("mailbox", "download", *account, "--mailbox", "Odd", "--table", table)[0] == 3
    assert run("mailbox", "archive", *account, "--output", str(tmp_path / "tree"))[0] == 0
    for extra in ([], [], ["--fresh"]):
        assert run("db", "ingest", "--base", str(tmp_path / "tree"), "--table", str(tmp_path / "again"), "--checkpoint", str(tmp_path / "state"), *extra)[0] == 0
    ask = json.dumps({"id": 1, "method": "tools/call", "params": {"name": "db.count_emails"}}) + "\n"
    assert '"count\\": 4' in run("db", "serve", "--table", str(tmp_path / "again"), "--quiet", answer=ask)[1]
    ask = json.dumps({"id": 1, "method": "tools/call", "params": {"name": "db.count_emails"}}) + "\n"
    code, out, _ = run("db", "serve", "--table", table, "--quiet", answer=ask)
    assert code == 0 and json.loads(json.loads(out)["result"]["content"][0]["text"]) == {"count": 0}


def test_sqlite_import(spark, tmp_path):
    path, table = str(tmp_path / "mail.sqlite3"), str(tmp_path / "emails")
    with sqlite3.connect(path) as db:
        db.execute("create table emails (id integer primary key, address, mailbox, uidvalidity integer, uid integer, subject, internaldate, internaldate_epoch integer, raw blob, has_attachments, labels_json, created_at)")
        db.executemany("insert into emails values (?,?,?,?,?,?,?,?,?,?,?,?)", [(k, "me@x.example", "INBOX", 1, k, f"s{k}", "2024-03-02 07:00:00", 1709362800, letter(k), k % 2, "[]", "2024-03-03 00:00:00") for k in (1, 2, 7)])
    upsert(read_sqlite(spark, path), table)
    upsert(read_sqlite(spark, path), table)
    rows = {r["uid"]: r for r in stored(spark, table).collect()}
    assert set(rows) == {1, 2, 7} and rows[7]["raw"] == letter(7) and rows[7]["has_attachments"] and not rows[2]["has_attachments"] and rows[1]["size_bytes"] == len(letter(1))
    assert rows[1]["internaldate"].isoformat() == "2024-03-02T07:00:00" and version(spark, table) == 2
    with sqlite3.connect(str(tmp_path / "other")) as db:
        db.execute("create table emails (id integer)")
    with pytest.raises(SourceSchemaError):
        read_sqlite(spark, str(tmp_path / "other"))


def test_schema_version_and_ties(spark, tmp_path):
    table = str(tmp_path / "emails")
    row = {f.name: None for f in EMAILS} | {"address": "a", "mailbox": "m", "uidvalidity": 1, "uid": 1, "internaldate_epoch": 5}
    rows = spark.createDataFrame([row | {"raw": b"one"}, row | {"raw": b"two"}, row | {"raw": b"old", "internaldate_epoch": 4}], EMAILS).withColumn("parse_error", F.lit(None).cast("string"))
    for parts in (1, 3):
        upsert(rows.repartition(parts), f"{table}{parts}")
    assert [bytes(stored(spark, f"{table}{p}").first()["raw"]) for p in (1, 3)] in ([b"one"] * 2, [b"two"] * 2)
    for n in range(2, 6):
        upsert(rows.withColumn("uid", F.lit(n).cast("long")), f"{table}1")
    assert compact(spark, f"{table}1", 2) == 1 and compact(spark, f"{table}1", 2) == 0 and stored(spark, f"{table}1").count() == 5
    (tmp_path / "emails1" / "_courierlake.json").write_text('{"version": 99}')
    for crc in (tmp_path / "emails1").glob("._courierlake*"):
        crc.unlink()
    with pytest.raises(SchemaVersionError):
        stored(spark, f"{table}1")
    with pytest.raises(IngestError):
        upsert(rows.withColumn("parse_error", F.lit("bad")), f"{table}9", strict=True)


def test_variants_of_a_message():
    found = variants_for(letter(7), 31, 7, {"address": "a"})
    assert [(i, m["item_type"]) for i, _, m in found] == [("31:7:subject", "subject"), ("31:7:text", "plain_text"), ("31:7:markdown", "markdown")]
    assert found[0][1:] == ("Tide table 7", {"address": "a", "item_type": "subject"}) and variants_for(b"From: a@b.example\n\n", 1, 1) == []


def test_text_modes():
    assert normalize_utf8("é", "compat") == "??" and normalize_utf8(b"\xffa") == "�a" and normalize_utf8("é") == "é"
    raw = "From: a@b.example\nSubject: Über\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nschön <b>fett</b>\n".encode()
    assert parse_message(raw)["plain_text"].strip() == "schön <b>fett</b>" and parse_message(raw)["markdown"] == "schön **fett**"
    assert parse_message(raw, "compat")["plain_text"].strip() == "sch??n <b>fett</b>"
