"""URL normalisation and parts."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that only track, default ports, and what a path keeps unescaped.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")
PORTS = {"http": 80, "https": 443}
PATH_SAFE = "/:@!$&'()*+,;=-._~"


def clean_path(path: str) -> str:
    """Escapes canonical (an escaped slash stays one), slashes single, dot segments resolved, a leading slash."""
    pieces = [quote(unquote(p), safe=PATH_SAFE) for p in re.split("%2f", path, flags=re.I)]
    segments: list[str] = []
    raw = [s for s in re.sub("/+", "/", "%2F".join(pieces)).split("/")][path.startswith("/") or not path :]
    for s in raw:
        if s == "..":
            del segments[-1:]
        elif s != ".":
            segments.append(s)
    ends = bool(raw) and raw[-1] in (".", "..")
    return "/" + "/".join(segments) + ("/" if ends and segments else "")


def normalize(url: str | None, base: str | None = None) -> str | None:
    """Canonical form of an http(s) URL, or None for anything else.

    Malformed links give None, with a base as well; IPv6 hosts keep their brackets.
    """
    if url is None:
        return None
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        scheme, host, port = parts.scheme.lower(), parts.hostname, parts.port
    except ValueError:
        return None
    host = (host or "").rstrip(".")
    if scheme not in PORTS or not host:
        return None
    host = f"[{host}]" if ":" in host else host
    at = "" if port is None or port == PORTS[scheme] else f":{port}"
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING)
    query = "?" + urlencode(pairs) if pairs else ""
    return f"{scheme}://{host}{at}{clean_path(parts.path)}{query}"


@F.pandas_udf(StringType())
def normalize_udf(urls: pd.Series) -> pd.Series:
    return urls.map(normalize)


@F.pandas_udf(StringType())
def resolve_udf(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([normalize(u, b) for u, b in zip(urls, bases, strict=True)])


def normalized_simple(url: Column) -> Column:
    """Canonical form inside the JVM, equal to ``normalize`` for URLs without ports, escapes, dot segments or upper case."""
    bare = F.regexp_replace(url, "#.*$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    path = F.regexp_extract(bare, r"^[^?]*", 0)
    return F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.sort_array(kept), "&"))).otherwise(F.lit("")))


def host_of(url: Column) -> Column:
    """Authority with its port; null for what isn't a URL."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def path_and_query(url: Column) -> Column:
    """Path (``/`` when empty) with the query when there is one."""
    path, query = F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"))
    return F.concat(F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(path), F.when(F.coalesce(query, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
