"""Settings of a mail account and the environment they may come from."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

#: Environment variables by what they set.
ENVIRONMENT = {
    "address": "COURIERLAKE_ADDRESS",
    "password": "COURIERLAKE_PASSWORD",
    "max_fetch_size": "COURIERLAKE_MAX_FETCH_SIZE",
    "table": "COURIERLAKE_TABLE",
    "max_limit": "COURIERLAKE_MAX_LIMIT",
    "quiet": "COURIERLAKE_QUIET",
}
# What is asked of the server for each message.
FETCH_ITEMS = ("UID", "BODY.PEEK[]", "INTERNALDATE", "RFC822.SIZE", "FLAGS", "X-GM-LABELS", "X-GM-MSGID", "X-GM-THRID")


class SettingsError(ValueError):
    """A setting is missing or cannot be used."""


class FetchSizeError(ValueError):
    """More messages were asked for at once than the settings allow."""

    def __init__(self, asked: int, most: int, mailbox: str | None = None) -> None:
        super().__init__(f"{asked} messages asked for, at most {most} at once")
        self.asked, self.most, self.mailbox = asked, most, mailbox


class NoValidityError(RuntimeError):
    """The server gives no UIDVALIDITY for a mailbox."""


def from_environment(name: str, given: object = None) -> object:
    """The value given, or that of the environment; blank counts as absent."""
    return given if given not in (None, "") else os.environ.get(ENVIRONMENT[name]) or None


@dataclass(frozen=True)
class Settings:
    address: str
    password: str = field(repr=False)
    host: str = "imap.gmail.com"
    port: int = 993
    tls: bool = True
    max_fetch_size: int = 100
    items: tuple[str, ...] = FETCH_ITEMS

    def __post_init__(self) -> None:
        missing = [n for n in ("address", "password") if not getattr(self, n)]
        if missing:
            raise SettingsError(f"missing: {', '.join(missing)}")
        if self.max_fetch_size <= 0:
            raise SettingsError("max_fetch_size must be positive")

    @classmethod
    def of(cls, address: str | None = None, password: str | None = None, max_fetch_size: int | None = None, **others) -> Settings:
        """Settings from arguments, then the environment, then defaults."""
        size = from_environment("max_fetch_size", max_fetch_size if max_fetch_size and max_fetch_size > 0 else None)
        more = {"max_fetch_size": int(size)} if size else {}
        return cls(from_environment("address", address) or "", from_environment("password", password) or "", **more, **{k: v for k, v in others.items() if v is not None})
