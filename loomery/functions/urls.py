"""Domain algebra on URLs and e-mail addresses, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TWO_PART_SUFFIXES = "co.uk ac.uk org.uk ac.jp co.jp com.au edu.au org.au ac.in co.in com.br org.br edu.br ac.nz co.nz ac.za co.za".split()
GENERIC_MAIL = "gmail.com yahoo.com hotmail.com outlook.com aol.com icloud.com web.de gmx.de gmx.net t-online.de".split()
THIRD_PARTIES = "linkedin.com facebook.com wikipedia.org bloomberg.com dnb.com zoominfo.com crunchbase.com twitter.com x.com youtube.com instagram.com yelp.com".split()
COUNTRY_TLDS = {"de": "DE", "uk": "GB", "fr": "FR", "jp": "JP", "cn": "CN", "ch": "CH", "ca": "CA", "au": "AU", "in": "IN", "kr": "KR", "it": "IT", "es": "ES", "nl": "NL", "se": "SE", "br": "BR", "at": "AT", "be": "BE", "dk": "DK", "fi": "FI", "no": "NO", "pl": "PL", "pt": "PT", "us": "US"}


def host(url: Column) -> Column:
    """Lower-cased host of a URL; a missing scheme is put in; no user, port or closing dot."""
    t = F.lower(F.trim(url))
    full = F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("http://"), t))
    h = F.regexp_replace(F.regexp_extract(full, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.+$", "")
    return F.when(h != "", h)


def host_without_www(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def registrable(h: Column) -> Column:
    """The last two labels of a host, three under a two-part public suffix."""
    labels = F.split(h, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when(F.size(labels) < 2, h).when((F.size(labels) >= 3) & two.isin(TWO_PART_SUFFIXES), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def domain(url: Column) -> Column:
    return registrable(host(url))


def domain_label(d: Column) -> Column:
    return F.element_at(F.split(d, r"\."), 1)


def tld(d: Column) -> Column:
    return F.element_at(F.split(d, r"\."), -1)


def email_domain(email: Column) -> Column:
    """Domain of the first address in a cell that has one."""
    found = F.regexp_extract(F.coalesce(email, F.lit("")), r"[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})", 1)
    return F.when(found != "", registrable(F.lower(found)))


def is_generic_mail(d: Column) -> Column:
    return F.coalesce(d.isin(GENERIC_MAIL), F.lit(False))


def is_third_party(url: Column) -> Column:
    return F.coalesce(domain(url).isin(THIRD_PARTIES), F.lit(False))


def country_conflict(d: Column, country: Column) -> Column:
    """A country-code ending that isn't the record's country; generic and unknown ones never conflict."""
    of_tld = F.create_map(*[F.lit(x) for kv in COUNTRY_TLDS.items() for x in kv])[tld(d)]
    return F.coalesce(of_tld != country, F.lit(False))


def host_depth(url: Column) -> Column:
    return F.size(F.split(host_without_www(url), r"\."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[^/?#]*://)?[^/?#]*([^?#]*)", 1)


def path_penalty(url: Column) -> Column:
    """Depth of the path, one more for a date in it and for a subpage file."""
    p = path_of(url)
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    return depth + p.rlike(r"/(?:19|20)\d\d(?:/|$)").cast("int") + p.rlike(r"(?i)\.(?:html?|php|aspx?|pdf)$").cast("int")


def stated_witness(sites: Column, d: Column) -> Column:
    """First (witness, website) whose domain is the candidate's."""
    return F.get(F.filter(sites, lambda s: domain(s["website"]) == d), F.lit(0))["witness"]


def resolve_domain(candidate: Column, registry_sites: Column, email: Column, country: Column, title: Column, name: Column) -> Column:
    """struct(domain, verified_by, rejected_by): the first condition that fits decides.

    Stated by a registry; country ending contradicts; the record's own e-mail;
    every word of four letters or more of the name stands in the page's title.
    """
    d = domain(candidate)
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}0-9]+", " "), " "), lambda w: F.length(w) >= 4)
    hay = F.lower(F.coalesce(title, F.lit("")))
    witness = F.coalesce(stated_witness(registry_sites, d), F.lit(""))
    out = lambda dom, by, no: F.struct(dom.alias("domain"), F.lit(by).cast("string").alias("verified_by"), F.lit(no).cast("string").alias("rejected_by"))
    none = F.lit(None).cast("string")
    return (
        F.when(d.isNull(), out(none, None, "no_candidate"))
        .when(is_third_party(candidate), out(none, None, "third_party"))
        .when(witness != "", out(d, "registry", None))
        .when(country_conflict(d, country), out(none, None, "country"))
        .when(~is_generic_mail(d) & (email_domain(email) == d), out(d, "email", None))
        .when((F.size(words) > 0) & F.forall(words, lambda w: F.contains(hay, w)), out(d, "title", None))
        .otherwise(out(none, None, "no_evidence"))
    )


#: The five parts of a reference (RFC 3986, appendix B), as groups 2, 4, 5, 7 and 9.
REFERENCE = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _parts(c: Column) -> dict[str, Column]:
    """Scheme, authority, path and query of a reference; null where one isn't there."""
    c = F.trim(c)
    part = lambda have, k: F.when(F.regexp_extract(c, REFERENCE, have) != "", F.regexp_extract(c, REFERENCE, k))
    return {"scheme": F.lower(part(1, 2)), "authority": part(3, 4), "path": F.regexp_extract(c, REFERENCE, 5), "query": part(6, 7)}


def without_dots(path: Column) -> Column:
    """A path with its '.' and '..' segments resolved; '..' never climbs above the root."""
    segments = F.split(path, "/")
    step = lambda have, s: F.when(s == "..", F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(1)))).when(s == ".", have).otherwise(F.array_append(have, s))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(path.startswith("/") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def resolve(base: Column, reference: Column) -> Column:
    """The address that a reference names on a page at ``base`` (an absolute http address), without its fragment;
    null for null, and for references of other schemes (mailto, javascript, data, tel)."""
    b, r = _parts(base), _parts(reference)
    folder = F.regexp_extract(b["path"], r"^(.*/)", 1)
    merged = F.when(r["path"].startswith("/"), r["path"]).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), r["path"]))
    own = r["scheme"].isNotNull() | r["authority"].isNotNull()
    same = ~own & (r["path"] == "")
    path = F.when(same, b["path"]).otherwise(without_dots(F.when(own, r["path"]).otherwise(merged)))
    query = F.when(same & r["query"].isNull(), b["query"]).otherwise(r["query"])
    scheme = F.coalesce(r["scheme"], b["scheme"])
    authority = F.when(own, r["authority"]).otherwise(b["authority"])
    made = F.concat(scheme, F.lit("://"), F.coalesce(authority, F.lit("")), path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.when(reference.isNotNull() & scheme.isin("http", "https"), made)
