"""Per-message functions: RFC 822 parsing, Markdown of HTML, header injection."""

from __future__ import annotations

import json
import re
from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime
from html.parser import HTMLParser

PARSED = (
    "message_id string, subject string, from_email string, `from` string, to_emails string, cc_emails string, bcc_emails string, envelope_reply_to string,"
    " envelope_in_reply_to string, envelope_references string, date timestamp, has_attachments boolean, plain_text string, markdown string, parse_error string,"
    " told_thrid long, told_msgid long, told_labels string, told_internaldate timestamp, told_size long"
)
#: How text is read: "utf8" keeps it, "compat" turns every byte from 0x80 on into a question mark.
TEXT_MODES = ("utf8", "compat")
IDS = re.compile(r"<([^<>\s]+)>")


class Markdown(HTMLParser):
    """A small converter: emphasis, headings, list items, links and paragraphs."""

    AROUND = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.quiet = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "head"):
            self.quiet += 1
        elif tag in self.AROUND:
            self.out.append(self.AROUND[tag])
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("p", "div", "tr", "ul", "ol", "table"):
            self.out.append("\n\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.quiet = max(0, self.quiet - 1)
        elif tag in self.AROUND:
            self.out.append(self.AROUND[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str) -> str:
    m = Markdown()
    m.feed(html)
    m.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(m.out)).strip()


def addresses(message, name: str) -> list[str]:
    return [a.lower() for _, a in getaddresses([str(v) for v in message.get_all(name, [])]) if "@" in a and not a.startswith("@") and not a.endswith("@")]


def as_json(values: list[str]) -> str | None:
    return json.dumps(values) if values else None


def normalize_utf8(text: str | bytes, text_mode: str = "utf8") -> str:
    """Valid text: bytes that are no UTF-8 become U+FFFD, or in compat mode every byte from 0x80 on a question mark."""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "replace")
    if text_mode == "compat":
        return re.sub(rb"[\x80-\xff]", b"?", raw).decode("ascii")
    return raw.decode("utf-8", "replace")


def safe_decode(part) -> str:
    """The text of a part; of one in an unknown encoding its bytes as UTF-8."""
    if part is None:
        return ""
    try:
        return part.get_content()
    except (LookupError, UnicodeError, KeyError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def whole_number(text: object) -> int | None:
    found = re.fullmatch(r"\s*(\d+)\s*", str(text or ""))
    return int(found[1]) if found else None


#: A label in a header: bare, or in quotes if it holds blanks, quotes or backslashes.
LABEL = re.compile(r'"((?:[^"\\]|\\.)*)"|(\S+)')


def label_text(labels: list[str]) -> str:
    """Labels as one header line."""
    return " ".join('"' + re.sub(r'(["\\])', r"\\\1", x) + '"' if re.search(r'[\s"\\]', x) or not x else x for x in labels)


def read_labels(text: str) -> list[str]:
    return [re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2] for m in LABEL.finditer(text)]


def when(text: object):
    try:
        return parsedate_to_datetime(str(text)) if text else None
    except (TypeError, ValueError):
        return None


def parse_message(raw: bytes, text_mode: str = "utf8") -> dict[str, object]:
    """The parsed columns; a message that can't be read gives its error and nulls. told_*: what headers of an archived file say."""
    names = [n.strip("`") for n in re.findall(r"(`?\w+`?) \w+(?:,|$)", PARSED)]
    row: dict[str, object] = dict.fromkeys(names)
    try:
        m = message_from_bytes(re.sub(rb"[\x80-\xff]", b"?", raw) if text_mode == "compat" else raw, policy=policy.default)
        ids = IDS.findall(str(m.get("Message-ID", ""))) or [str(m.get("Message-ID", "")).strip()]
        senders = addresses(m, "From")
        plain, html = m.get_body(("plain",)), m.get_body(("html",))
        text = safe_decode(plain) if plain is not None else ("" if m.is_multipart() else safe_decode(m if m.get_content_maintype() == "text" else None))
        rich = safe_decode(html)
        replies = IDS.findall(str(m.get("In-Reply-To", "")))
        labels = m.get("X-GM-LABELS")
        row |= {
            "message_id": ids[0] or None,
            "subject": str(m.get("Subject", "")),
            "from_email": senders[0] if senders else None,
            "from": str(m["From"]) if m.get("From") else None,
            "to_emails": as_json(addresses(m, "To")),
            "cc_emails": as_json(addresses(m, "Cc")),
            "bcc_emails": as_json(addresses(m, "Bcc")),
            "envelope_reply_to": as_json(addresses(m, "Reply-To")),
            "envelope_in_reply_to": replies[0] if replies else None,
            "envelope_references": as_json(IDS.findall(str(m.get("References", "")))),
            "date": when(m.get("Date")),
            "has_attachments": any(True for _ in m.iter_attachments()),
            "plain_text": text,
            "markdown": to_markdown(rich if rich.strip() else text),
            "told_thrid": whole_number(m.get("X-GM-THRID")),
            "told_msgid": whole_number(m.get("X-GM-MSGID")),
            "told_labels": json.dumps(read_labels(str(labels)), ensure_ascii=False) if labels else None,
            "told_internaldate": when(m.get("X-IMAP-INTERNALDATE")),
            "told_size": whole_number(m.get("X-RFC822-SIZE")),
        }
        row = {k: normalize_utf8(v, text_mode) if isinstance(v, str) else v for k, v in row.items()}
    except Exception as e:  # any malformed part of a message ends here; the raw bytes are kept
        row["parse_error"] = f"{type(e).__name__}: {e}"
        row["has_attachments"] = False
    return row


def variants_for(raw: bytes, uidvalidity: int, uid: int, meta: dict[str, object] | None = None, strict: bool = False, text_mode: str = "utf8") -> list[tuple[str, str, dict[str, object]]]:
    """Up to three documents of one message, as extensions.variants() gives them for a table: (id, text, metadata with item_type); blank ones are left out."""
    row = parse_message(raw, text_mode)
    if row["parse_error"]:
        if strict:
            raise ValueError(row["parse_error"])
        return []
    kinds = (("subject", "subject", "subject"), ("text", "plain_text", "plain_text"), ("markdown", "markdown", "markdown"))
    return [(f"{uidvalidity}:{uid}:{short}", row[column], (meta or {}) | {"item_type": kind}) for short, kind, column in kinds if (row[column] or "").strip()]


def inject_headers(raw: bytes, headers: dict[str, object]) -> bytes:
    """Add the headers that the message lacks before its blank line, or at the end if it has none."""
    for line in ("\r\n", "\n"):
        end = raw.find((line * 2).encode())
        if end >= 0:
            break
    head = raw if end < 0 else raw[:end]
    present = {x.partition(b":")[0].strip().lower() for x in head.splitlines()}
    new = "".join(f"{line}{k}: {label_text([*map(str, v)]) if isinstance(v, list | tuple) else v}" for k, v in headers.items() if v is not None and k.lower().encode() not in present).encode()
    return head + new + (raw[end:] if end >= 0 else b"")
