"""Column functions on links, addresses and HTTP outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""
#: Words in the path of an error page, and hosts of parked domains (fixed values).
ERROR_PATH = r"(?i)suspendedpage|/404\b|not-?found|page-?not-?found|error-?page|/expired"
PARKED = r"(?i)(?:hugedomains|dan|sedo|afternic|bodis|parkingcrew)\.(?:com|net)$"
#: Beginnings of the titles of pages that refuse or miss (fixed values).
ERROR_TITLE = r"(?i)^(just a moment|access denied|attention required|robot check|human verification|403 forbidden|404(?:\D|$)|page not found|not found)"
REFUSED = (401, 403, 429, 451)
#: Query parameters that say nothing about the page (fixed values).
VOLATILE = r"^(?:utm_\w+|ref|session|sid|fbclid|gclid)="


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))


def link_kind(href: Column) -> Column:
    """footnote, anchor, mailto, own (relative or the own site) or external."""
    return F.when(href.startswith("#fn"), "footnote").when(href.startswith("#"), "anchor").when(href.startswith("mailto:"), "mailto").when(href.startswith("/") | host(href).rlike(r"(?:^|\.)notes\.example$"), "own").otherwise("external")


def moved(a: Column, b: Column) -> Column:
    """Host (but www.) or path (but case and a slash at the end) differ."""
    place = lambda u: F.lower(F.regexp_replace(path(u), r"/+$", ""))
    return (bare_host(a) != bare_host(b)) | (place(a) != place(b))


def soft_404(url: Column, final: Column) -> Column:
    """A redirect that answers, but to an error page, a parked domain or from a page to the home page."""
    bare = lambda u: F.regexp_replace(path(u), r"^/+|/+$", "")
    home = (bare(final) == "") & ~bare(url).isin("", "index.html", "index.htm", "en")
    return F.coalesce(F.concat(path(final), F.lit("?"), query_of(final)).rlike(ERROR_PATH) | host(final).rlike(PARKED) | home, F.lit(False))


def source_quality(url: Column, final: Column, title: Column, status: Column) -> Column:
    """redirect_needs_check, access_or_error_page, extracted, or the status: what a fetched page is worth, by address and title alone."""
    bad = (final != url) & soft_404(url, final)
    error = F.trim(F.coalesce(title, F.lit(""))).rlike(ERROR_TITLE)
    return F.when(bad, "redirect_needs_check").when(error, "access_or_error_page").when(status == "saved", "extracted").otherwise(F.coalesce(status, F.lit("missing")))


def host_kind(host: Column) -> Column:
    """name (its addresses are the resolver's matter), public or private for a literal IPv4 address."""
    octet = lambda i: F.nullif(F.regexp_extract(host, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)", i), F.lit("")).try_cast("int")
    a, b, c = (octet(i) for i in (1, 2, 3))
    # ranges that aren't globally routed (fixed values)
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    literal = host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?$") & (a <= 255) & (b <= 255) & (c <= 255)
    return F.when((host == "localhost") | host.endswith(".localhost"), "private").when(~literal, "name").when(private, "private").otherwise("public")


def link_status(code: Column, url: Column, final: Column, error: Column) -> Column:
    """The first that holds: unreachable, broken, restricted, server-error, broken (soft), moved, ok, other."""
    fine = code.between(200, 299)
    return (
        F.when(error.isNotNull() & (error != ""), "unreachable").when(code.isin(404, 410), "broken").when(code.isin(*REFUSED), "restricted").when(code >= 500, "server-error")
        .when(fine & soft_404(url, final), "broken").when(fine & F.coalesce(moved(url, final), F.lit(False)), "moved").when(fine, "ok").otherwise("other")
    )


def safe_url(url: Column) -> Column:
    """An http(s) address with a lower-case host and without its fragment; null if it is none."""
    ok = url.rlike(r"(?i)^https?://[^/?#\s@]+(?:[/?#]\S*)?$")
    rest = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    return F.when(ok, F.concat(F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lit("://"), host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def stable_url(url: Column) -> Column:
    """Without volatile query parameters and fragment."""
    kept = F.array_join(F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~p.rlike(VOLATILE)), "&")
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def asset_key(url: Column) -> Column:
    """What names the asset in an address: the id in its path, else its last part without ending."""
    ident = F.regexp_extract(path(url), r"/(?:item|files)/([^/]+)", 1)
    return F.coalesce(F.nullif(ident, F.lit("")), F.nullif(F.regexp_replace(F.element_at(F.split(path(url), "/"), -1), r"\.\w+$", ""), F.lit("")))


def attachment_kind(url: Column) -> Column:
    return F.when(F.lower(path(url)).rlike(r"\.(?:pdf|docx?|xlsx?|csv|ods|odt)$"), "file").when(host(url).rlike(r"notes\.example$"), "html").otherwise("other")
