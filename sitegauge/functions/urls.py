"""URL parts by generic syntax, without a strict URI parser that rejects real links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.ip import ip_bytes
from sitegauge.functions.text import let

_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def normalize_url(url: Column) -> Column:
    """Prefix `https://` unless the text already starts with a lower-case http(s) scheme."""
    return F.when(url.rlike(r"\Ahttps?://"), url).otherwise(F.concat(F.lit("https://"), url))


def clean_url(url: Column) -> Column:
    """Drop leading control characters and spaces, and any tab or line break."""
    return F.regexp_replace(url, r"\A[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean_url(url), _SCHEME, 1))


def netloc(url: Column) -> Column:
    """Authority with user info and port, '' when there is none."""
    return F.regexp_extract(clean_url(url), _NETLOC, 1)


def authority(url: Column) -> Column:
    """Authority as a client sends it: lower-case host, no port where it is the scheme's own."""
    given = netloc(url)
    user, server = F.regexp_extract(given, r"\A(.*@)?", 0), F.lower(F.regexp_extract(given, r"([^@]*)\z", 1))
    plain = F.when(scheme(url) == "https", F.regexp_replace(server, r":(443)?\z", "")).when(
        scheme(url) == "http", F.regexp_replace(server, r":(80)?\z", "")
    )
    return F.concat(user, F.coalesce(plain, server))


def origin(url: Column) -> Column:
    """`scheme://authority` in canonical form, the key site files are stored under."""
    return F.concat(scheme(url), F.lit("://"), authority(url))


def authority_malformed(authority: Column) -> Column:
    """Unbalanced brackets, or brackets around something that is no IPv6 address."""
    opened, closed = authority.contains("["), authority.contains("]")
    bad_literal = let(
        F.regexp_extract(authority, r"\[([^\]]*)\]", 1),
        lambda inner: ~(
            (inner.contains(":") & ip_bytes(inner).isNotNull()) | inner.rlike(r"\Av[0-9a-fA-F]+\..+\z")
        ),
    )
    return F.when(~opened & ~closed, False).when(opened != closed, True).otherwise(bad_literal)


def hostname(authority: Column) -> Column:
    """Lower-case host without user info, port or brackets; NULL when empty."""
    return let(
        F.regexp_extract(authority, r"([^@]*)\z", 1),
        lambda server: F.nullif(
            F.lower(
                F.when(server.contains("["), F.regexp_extract(server, r"\[([^\]]*)", 1)).otherwise(
                    F.regexp_extract(server, r"\A([^:]*)", 1)
                )
            ),
            F.lit(""),
        ),
    )
