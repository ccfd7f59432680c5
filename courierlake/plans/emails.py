"""The emails relation of the test tables, as one text for Spark and for DuckDB.

Every event is a message; its body is the whole text of a document, and each
document is the body of some (doc_ids run from 0 without gaps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {
        "epoch": "unix_seconds(CAST(e.ts AS TIMESTAMP))",
        "from": "`from`",
        "bytes": lambda x: f"encode({x}, 'UTF-8')",
        "size": lambda x: f"CAST(octet_length({x}) AS BIGINT)",
        "time": lambda x: f"CAST(timestamp_seconds({x}) AS TIMESTAMP_NTZ)",
    },
    "duckdb": {
        "epoch": "CAST(epoch_us(e.ts)//1000000 AS BIGINT)",
        "from": '"from"',
        "bytes": lambda x: f"encode({x})",
        "size": lambda x: f"CAST(octet_length(encode({x})) AS BIGINT)",
        "time": lambda x: f"make_timestamp(CAST(({x}) AS BIGINT) * 1000000)",
    },
}


def emails_cte(dialect: str) -> str:
    """WITH ..., emails AS (...); events and documents are views of those names."""
    d = DIALECTS[dialect]
    message = "concat('Subject: ', subj, chr(10), chr(10), body)"
    size = f"{d['size']('subj')} + body_size + 11"  # the rest of message; bodies are measured before the join, which then needs no text
    return f"""WITH dealt AS (
  SELECT e.event_id, e.user_id, e.event_type, e.value, {d["epoch"]} AS ep, e.event_id % (SELECT count(*) FROM documents c) AS k FROM events e
), base AS (
  SELECT b.event_id, b.user_id, b.event_type, b.value, b.ep, d.text AS body, d.n AS body_size,
    concat('The ', b.event_type, ' of user ', b.user_id, CASE WHEN b.event_id % 31 = 0 THEN ' 100% x_y' ELSE '' END) AS subj
  FROM dealt b JOIN (SELECT x.doc_id, x.text, {d["size"]("x.text")} AS n FROM documents x) d ON d.doc_id = b.k
), mail AS (
  SELECT b.*,
    CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '' WHEN event_id % 29 = 0 THEN 'no-at-sign'
         ELSE concat('user', user_id, '@', CASE user_id % 4 WHEN 0 THEN 'example.com' WHEN 1 THEN 'sub.example.com'
              WHEN 2 THEN 'github.test' ELSE 'example.com.evil' END) END AS fe
  FROM base b
), emails AS (
  SELECT event_id AS id, 'me@example.com' AS address,
    CASE event_type WHEN 'view' THEN 'INBOX' WHEN 'click' THEN 'Work' WHEN 'purchase' THEN 'Receipts'
         WHEN 'signup' THEN '[Gmail]/Sent Mail' ELSE '[Gmail]/Spam' END AS mailbox,
    CAST(1 AS BIGINT) AS uidvalidity, event_id AS uid,
    CASE WHEN event_id % 11 = 0 THEN NULL
         ELSE concat('m', CASE WHEN event_id % 10 = 3 THEN event_id - 1 ELSE event_id END, '@mail.example') END AS message_id,
    CASE WHEN event_id % 4 = 1 AND (event_id - 1) % 11 != 0
         THEN concat('m', CASE WHEN (event_id - 1) % 10 = 3 THEN event_id - 2 ELSE event_id - 1 END, '@mail.example') END AS envelope_in_reply_to,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN CAST(0 AS BIGINT)
         ELSE user_id * 100 + event_id % 20 END AS x_gm_thrid,
    9000000000 + CASE WHEN event_id % 20 = 7 THEN event_id - 1 ELSE event_id END AS x_gm_msgid,
    subj AS subject, {d["time"]("ep")} AS internaldate, ep AS internaldate_epoch, fe AS from_email,
    CASE WHEN fe IS NULL THEN NULL ELSE concat('User ', user_id, ' <', fe, '>') END AS {d["from"]},
    concat('["team', user_id % 7, '@example.com"]') AS to_emails,
    CASE WHEN event_id % 3 = 0 THEN concat('["cc', user_id % 5, '@example.com"]') END AS cc_emails,
    CAST(NULL AS VARCHAR(100)) AS bcc_emails,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE {d["time"]("ep - (event_id % 3) * 3600")} END AS date,
    value > 100 AS has_attachments, concat('["', event_type, '"]') AS labels_json,
    {d["bytes"](message)} AS raw, {size} AS size_bytes, {size} AS rfc822_size, body AS plain_text, body AS markdown
  FROM mail
)"""


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived relation as a DataFrame."""
    own = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "documents")}
    text = emails_cte("spark").replace("FROM events e", "FROM {events} e").replace("FROM documents x", "FROM {documents} x").replace("FROM documents c", "FROM {documents} c")
    return spark.sql(text + " SELECT * FROM emails", **own)
