"""URL parts and normal forms.

Parts are cut with patterns instead of ``parse_url`` because exports hold URLs with blanks and without a
scheme, which ``parse_url`` rejects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import bind, strip

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def _replaced(text: Column, hint: str, pattern: str, by: str = "") -> Column:
    """``regexp_replace`` for a pattern that needs ``hint``: a plain search spares most texts the slower pattern."""
    return bind(text, lambda t: F.when(F.contains(t, F.lit(hint)), F.regexp_replace(t, pattern, by)).otherwise(t))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY, 1)


def path(url: Column) -> Column:
    """Path without query, fragment and the parameters (``;x``) of its last part."""
    return _replaced(F.regexp_extract(url, PATH, 1), ";", r";[^/]*$")


def query(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("?")), F.regexp_extract(url, QUERY, 1)).when(url.isNotNull(), "")


def site_host(url: Column) -> Column:
    """Authority as written, one leading ``www.`` dropped."""
    return _replaced(authority(url), "www.", r"^www\.")


def any_www_host(url: Column) -> Column:
    """Authority as written, ``www.`` dropped wherever it stands."""
    return F.replace(authority(url), F.lit("www."), F.lit(""))


def _bare_host(authority_text: Column) -> Column:
    """Authority without user info and port, lower-cased."""
    return F.lower(_replaced(_replaced(authority_text, "@", r"^.*@"), ":", r":.*$"))


def hostname(url: Column) -> Column:
    """Lower-cased host without port, dots at the ends and leading ``www.``; the scheme may be missing."""

    def of(text: Column) -> Column:
        full = F.when(text == "", text).when(F.contains(text, F.lit("://")), text).otherwise(
            F.concat(F.lit("https://"), text)
        )
        return _replaced(F.btrim(_bare_host(authority(full)), F.lit(".")), "www.", r"^www\.")

    return bind(strip(F.coalesce(url, F.lit(""))), of)


def _port(authority_text: Column) -> Column:
    """Port of an authority as written, empty when it has none."""
    return F.when(
        F.contains(authority_text, F.lit(":")), F.regexp_extract(F.regexp_replace(authority_text, r"^.*@", ""), r":(.*)$", 1)
    ).otherwise("")


def _without_last_slash(path_text: Column) -> Column:
    """One trailing slash removed unless the path is the root."""
    # The end of a line counts as the end, and it may have two characters.
    ends = lambda t: F.contains(F.substring(t, -3, 3), F.lit("/"))
    return bind(path_text, lambda t: F.when(ends(t), F.regexp_replace(t, "(.)/$", "$1")).otherwise(t))


def canonical_url(url: Column) -> Column:
    """Duplicate protection: scheme (https if none), host without ``www.``, port, path, query; no fragment.

    Each part is cut once and bound, because several others are built from it.
    """

    def built(text: Column, where: Column, raw_port: Column, found: Column, asked: Column) -> Column:
        port = raw_port.try_cast("int")
        bad_port = (raw_port != "") & (~raw_port.rlike(r"^\d+$") | port.isNull() | (port > 65535))
        whole = F.concat(
            F.coalesce(F.nullif(scheme(text), F.lit("")), F.lit("https")),
            F.lit("://"),
            _replaced(_bare_host(where), "www.", r"^www\."),
            F.when(port > 0, F.concat(F.lit(":"), port.cast("string"))).otherwise(""),
            F.when(found == "", F.lit("/")).otherwise(_without_last_slash(found)),
            F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""),
        )
        return F.when(bad_port, F.lower(text)).otherwise(whole)

    def from_parts(text: Column) -> Column:
        parts = F.struct(authority(text).alias("where"), path(text).alias("path"), query(text).alias("query"))
        return bind(
            parts,
            lambda p: bind(_port(p["where"]), lambda port: built(text, p["where"], port, p["path"], p["query"])),
        )

    return bind(strip(F.coalesce(url, F.lit(""))), lambda text: F.when(text == "", text).otherwise(from_parts(text)))


def percent_decode(text: Column) -> Column:
    """Decode ``%XX``; a plus sign and a broken escape stay as they are."""
    guarded = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(
        F.contains(text, F.lit("%")), F.try_url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))
    ).otherwise(text)


def canonical_key(url: Column) -> Column:
    """Join key of a page: lower-cased host and decoded path, one trailing slash and the query dropped."""
    text = F.lower(strip(F.coalesce(url, F.lit(""))))
    decoded = percent_decode(path(text))
    return F.when(text == "", text).otherwise(F.concat(any_www_host(text), _without_last_slash(decoded)))


def page_url(url: Column) -> Column:
    """Page identity for snapshots: repeated and trailing slashes, query and fragment dropped."""
    raw_path = path(url)
    squeezed = F.regexp_replace(F.when(raw_path == "", F.lit("/")).otherwise(raw_path), "/+", "/")
    named = scheme(url)
    where = authority(url)
    return F.concat(
        F.when(named != "", F.concat(named, F.lit(":"))).otherwise(""),
        F.when(where != "", F.concat(F.lit("//"), where)).otherwise(""),
        _without_last_slash(squeezed),
    )


def sitemap_url(site: Column) -> Column:
    """Sitemap address of a target site; an address that already names an .xml file is kept."""
    text = strip(site)
    full = F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(path(full).endswith(".xml"), full).otherwise(
        F.concat(scheme(full), F.lit("://"), authority(full), F.lit("/sitemap.xml"))
    )


def slug_phrase(url: Column) -> Column:
    """Keyword phrase held in the last part of a URL path, NULL when there is none worth keeping."""
    last = F.regexp_extract(_without_last_slash(path(url)), r"([^/]*)$", 1)
    bare = _replaced(last, ".", r"(?i)\.(html|htm|php|aspx|asp)$")
    words = strip(F.regexp_replace(bare, r"[-_\s]+", " "))
    return bind(words, lambda phrase: F.when((F.length(phrase) > 3) & ~phrase.rlike(r"^\p{Nd}+$"), F.lower(phrase)))


def first_directory(url: Column) -> Column:
    """First part of the path, ``Home`` for the root."""
    trimmed = F.btrim(path(url), F.lit("/"))
    return F.when(trimmed == "", F.lit("Home")).otherwise(F.regexp_extract(trimmed, r"^([^/]*)", 1))


def tree_parts(url: Column) -> Column:
    """Host followed by the decoded path parts: the way from the site root to the page."""
    trimmed = F.btrim(percent_decode(path(url)), F.lit("/"))
    host = F.array(any_www_host(url))
    return F.when(trimmed == "", host).otherwise(F.concat(host, F.split(trimmed, "/")))
