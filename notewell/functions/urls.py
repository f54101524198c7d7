"""Keys of projects from the addresses of their remotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of remote addresses, in the order they are tried; the last group is the path.
REMOTES = [
    r"^[^@\s]+@([^:]+):([^\s]+?)(?:\.git)?$",
    r"^ssh://[^@/]+@([^/]+)/([^\s]+?)(?:\.git)?$",
    r"^https?://(?:[^@/]+@)?([^/]+)/([^\s]+?)(?:\.git)?$",
    r"^git://([^/]+)/([^\s]+?)(?:\.git)?$",
]


def remote_key(url: Column) -> Column:
    """owner/name, or more parts where groups are nested; null if the address has no known form."""
    trimmed = F.trim(url)

    def path(pattern: str) -> Column:
        raw = F.regexp_extract(trimmed, pattern, 2)
        plain = F.regexp_replace(F.translate(F.regexp_replace(raw, "^/+", ""), "\\", "/"), r"(?i)\.git$", "")
        return F.nullif(F.regexp_replace(plain, "/+$", ""), F.lit(""))

    return F.coalesce(*[path(p) for p in REMOTES])


def folder_key(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def tail(key: Column) -> Column:
    """The last part of a key."""
    return F.element_at(F.split(key, "/"), -1)
