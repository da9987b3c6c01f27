"""URL functions, as Column expressions that stay inside code generation."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track visitors, and endings of files that are no pages.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ["gclid", "fbclid", "ref", "referrer", "_hsenc", "_hsmi"]
NON_PAGE_ENDINGS = (
    "png jpg jpeg gif webp svg ico mp4 webm mp3 wav ogg pdf zip rar 7z gz tar doc docx xls xlsx ppt pptx exe dmg apk css js mjs map"
).split()
# Schemes whose URLs have an authority, and schemes without one whose last segment has parameters.
AUTHORITY_SCHEMES = (
    "ftp http gopher nntp telnet imap wais file mms https shttp snews prospero rtsp rtsps rtspu rsync svn svn+ssh sftp nfs git git+ssh "
    "ws wss itms-services"
).split()
PARAMETER_SCHEMES = ["hdl", "sip", "sips", "tel"]
UPLOADS = "/wp-content/uploads/"

#: RFC 3986, appendix B: 2 scheme, 4 authority, 5 path, 7 query.
_PARTS = r"^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#[\s\S]*)?$"


def url_part(url: Column, group: int) -> Column:
    """A group of the appendix-B expression; empty where the part is absent."""
    return F.regexp_extract(url, _PARTS, group)


def authority(url: Column) -> Column:
    """The lower-cased authority, port and user kept."""
    return F.lower(url_part(url, 4))


def path(url: Column) -> Column:
    return url_part(url, 5)


def _decoded(text: Column) -> Column:
    """Percent- and plus-decoded; a broken escape stays as it is, what stands beside it is decoded."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def strip_tracking(query: Column) -> Column:
    """A query string without its tracking parameters.

    Pairs are decoded and joined again without encoding, in order, repeats and
    blank values kept; names are compared with their case.
    """
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
            _decoded(F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["k"].isin(TRACKING_PARAMS) & ~F.startswith(p["k"], F.lit(TRACKING_PREFIX)))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def normalize_url(url: Column) -> Column:
    """One spelling of a URL: the key that pages are told apart by.

    Scheme (http where absent) and authority are lower-cased, the fragment, the
    last segment's parameters and tracking parameters are dropped, runs of
    slashes in the path become one, one slash at the end goes, an empty path is
    ``/``.  A URL of a scheme without an authority (mailto:, tel:) keeps its form.
    Null stays null.
    """
    scheme = F.lower(url_part(url, 2))
    scheme = F.when(scheme == "", F.lit("http")).otherwise(scheme)
    plain = F.regexp_replace(F.regexp_replace(path(url), r";[^/]*$", ""), "/{2,}", "/")
    plain = F.when(plain == "", F.lit("/")).otherwise(plain)
    plain = F.when(F.char_length(plain) > 1, F.regexp_replace(plain, "/$", "")).otherwise(plain)
    rooted = F.when(F.startswith(plain, F.lit("/")), plain).otherwise(F.concat(F.lit("/"), plain))
    query = strip_tracking(url_part(url, 7))
    asked = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    bare = F.when(scheme.isin(PARAMETER_SCHEMES), F.regexp_replace(path(url), r";[^/]*$", "")).otherwise(path(url))
    bare = F.regexp_replace(bare, "/{2,}", "/")
    bare = F.when(bare == "", F.lit("/")).when(F.char_length(bare) > 1, F.regexp_replace(bare, "/$", "")).otherwise(bare)
    opaque = ~scheme.isin(AUTHORITY_SCHEMES) & (authority(url) == "")
    return F.when(opaque, F.concat(scheme, F.lit(":"), bare, asked)).otherwise(F.concat(scheme, F.lit("://"), authority(url), rooted, asked))


def bare_host(url: Column) -> Column:
    """The authority without one leading ``www.``; the port is kept."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def is_internal(url: Column, base: Column) -> Column:
    """Whether ``url`` is an http(s) URL of the host of ``base``; port and subdomain count, ``www.`` does not."""
    return (bare_host(url) == bare_host(base)) & F.lower(url_part(url, 2)).isin("http", "https")


def is_page_url(url: Column) -> Column:
    """Whether the path looks like a page's: no uploads folder, no ending of a file that is none."""
    low = F.lower(path(url))
    return ~low.contains(UPLOADS) & ~low.rlike(rf"\.(?:{'|'.join(NON_PAGE_ENDINGS)})$")


def page_type(url: Column) -> Column:
    """blog, product, homepage or generic, by substrings of the lower-cased path, in this order."""
    low = F.lower(path(url))
    return (
        F.when(low.rlike("blog|article|post"), "blog")
        .when(low.rlike("product|item|shop"), "product")
        .when(low.isin("", "/", "/home"), "homepage")
        .otherwise("generic")
    )


def site_key(url: Column) -> Column:
    """One key per site: the host, lower-case, without user, port and ``www.``."""
    return F.regexp_replace(F.regexp_replace(bare_host(url), r"^[^@]*@", ""), r":\d*$", "")


@F.pandas_udf(T.StringType())
def absolute_url(link: pd.Series, base: pd.Series) -> pd.Series:
    """``link`` resolved against ``base`` (RFC 3986); null or unresolvable: null."""

    def resolve(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        try:
            return urljoin(b, a)
        except ValueError:
            return None

    return pd.Series([resolve(a, b) for a, b in zip(link, base)], dtype=object)
