"""URL functions: identity, cleaning and admission rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions.text import _col, contains_any, let, starts_with_any

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def host(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _HOST, 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _PATH, 1)


def slug(url: Column | str) -> Column:
    """Last path segment, a trailing slash ignored."""
    return F.regexp_extract(F.rtrim(path(url), F.lit("/")), "([^/]*)$", 1)


def slug_underscored(url: Column | str) -> Column:
    return F.translate(slug(url), "-", "_")


def slug_sha256(url: Column | str) -> Column:
    return F.sha2(F.regexp_extract(F.trim(path(url), F.lit("/")), "([^/]*)$", 1), 256)


def url_hash(url: Column | str) -> Column:
    """Stable 64-bit id of a URL."""
    return F.xxhash64(_col(url))


def drop_query(url: Column | str) -> Column:
    return F.split_part(_col(url), F.lit("?"), F.lit(1))


def normalize_url(
    url: Column | str,
    bare_origin: str = K.CONSERVATIVE_BARE_ORIGIN,
    www_origin: str = K.CONSERVATIVE_ORIGIN,
) -> Column:
    """Scheme, host and path only, no trailing slash, one host spelling."""
    flat = F.rtrim(F.concat(scheme(url), F.lit("://"), host(url), path(url)), F.lit("/"))
    return F.when(
        F.startswith(flat, F.lit(bare_origin)), F.replace(flat, F.lit(bare_origin), F.lit(www_origin))
    ).otherwise(flat)


def resolve(href: Column | str, base_url: Column | str) -> Column:
    """Absolute form of a link found on ``base_url``."""
    h, base = _col(href), _col(base_url)
    origin = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
        .when(F.startswith(h, F.lit("?")), F.concat(origin, path(base), h))
        .otherwise(F.concat(origin, let(F.when(F.startswith(h, F.lit("/")), h).otherwise(F.concat(folder, h)), without_dots)))
    )


def without_dots(place: Column) -> Column:
    """A path (query and fragment kept) with its ``.`` and ``..`` segments followed."""
    return F.when(F.contains(place, F.lit("/.")), let(place, _walked)).otherwise(place)


def _walked(place: Column) -> Column:
    rest = F.regexp_extract(place, r"([?#].*)$", 1)
    segments = F.split(F.regexp_extract(place, r"^([^?#]*)", 1), "/")

    def step(done: Column, s: Column) -> Column:
        return (
            F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
            .when(s == ".", done)
            .otherwise(F.concat(done, F.array(s)))
        )

    # the first segment is the empty one before the leading slash; it always stays
    walked = F.aggregate(F.slice(segments, 2, 1 << 30), F.array(F.lit("")), step)
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.concat(F.array_join(closed, "/"), rest)


def is_followable(href: Column | str) -> Column:
    """A link that leads to a page."""
    return (_col(href) != "") & ~starts_with_any(href, K.NON_PAGE_PREFIXES)


def has_file_extension(url: Column | str) -> Column:
    out = F.lit(False)
    for ext in K.FILE_EXTENSIONS:
        out = out | F.endswith(F.lower(_col(url)), F.lit(ext))
    return out


def is_article_or_listing(url: Column | str, domain: str = K.CONSERVATIVE_DOMAIN) -> Column:
    """Page of ``domain`` that is an article or a listing, not a service page."""
    u = _col(url)
    on_site = F.endswith(host(u), F.lit(domain)) & ~path(u).isin("", "/")
    listing = contains_any(u, K.LISTING_URL_PARTS)
    plain_page = ~has_file_extension(path(u)) & F.startswith(u, F.lit("http"))
    return on_site & ~contains_any(u, K.EXCLUDED_URL_PARTS) & (listing | plain_page)


def is_crawlable(
    url: Column | str, domain: str = K.CONSERVATIVE_DOMAIN, origin: str = K.CONSERVATIVE_ORIGIN
) -> Column:
    """Admission by origin, page kind and file extension of the cleaned URL."""
    u = normalize_url(url)
    return F.startswith(u, F.lit(origin)) & is_article_or_listing(u, domain) & ~has_file_extension(u)


def is_blocked(url: Column | str) -> Column:
    """Social domain (or its sub-domain), service path, or podcast episode."""
    h, p = F.lower(host(url)), F.lower(path(url))
    out = F.lower(_col(url)).rlike(K.BLOCKED_URL_PATTERN) | starts_with_any(p, K.BLOCKED_PATHS)
    for d in K.BLOCKED_DOMAINS:
        out = out | (h == d) | F.endswith(h, F.lit("." + d))
    return out


def is_section_article(
    url: Column | str,
    domain: str = K.BEACON_DOMAIN,
    denied: tuple[str, ...] = K.BEACON_SECTIONS_DENIED,
    excluded: tuple[str, ...] = K.BEACON_EXCLUDED,
) -> Column:
    """``domain/section/slug`` whose section and parts are not excluded."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return (
        (host(url) == domain)
        & (F.size(segments) >= 2)
        & ~F.get(segments, F.lit(0)).isin(list(denied))
        & ~contains_any(url, excluded)
    )


def is_dated_article(url: Column | str, pattern: str, prefix: str = "", part: str = "") -> Column:
    """URL with a date in its path, under ``prefix`` and containing ``part``."""
    u = _col(url)
    return F.startswith(u, F.lit(prefix)) & F.contains(u, F.lit(part)) & u.rlike(pattern)
