"""Search terms of a record: two words at most that tell its institution and its unit.

Term 1 is the registry's acronym if the name bears it out, else the domain
without its ending, else the name's own words. Term 2 is for the unit: ADMIN for
a back-office desk, a subdomain that is the unit's acronym, an acronym in
brackets, the words that name the unit, else what its site is called. Either is
cut to its head and the next word that narrows the search: legal forms, unit and
facility words, places and what the record's address says are stepped over. All
are JVM expressions; blank and null are the same, and a term that nothing
identifies is null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import text as tx

# Word lists and endings that decide what a term may be.
STOP = "of for the and in on at to a an de du des la le les &".split()
LEGAL = "inc incorporated llc ltd limited corp corporation co company gmbh ag plc lp llp pllc sa srl bv nv se pty oy ab as".split()
FACILITY = "headquarters headquarter hq plant plants site sites works facility facilities campus warehouse warehousing depot dock docks terminal interplant receiving shipping stores store storeroom stockroom manufacturing production distribution logistics maintenance assembly packaging annex building bldg premises warehouses".split()
CORPORATE = "corporate central main global international worldwide national regional operations operation solutions systems partners holdings enterprises ventures group groups affiliates subsidiary subsidiaries general sales miscellaneous misc other various unknown".split()
PLACES = "usa us america americas canada canadian mexico europe european asia asian pacific africa north south east west northern southern eastern western midwest".split()
FUNCTION = "off out per via plus from with by into onto over under near upon than then also etc and/or no not new old all any its".split()
UNITS = "department departments dept depts depart division divisions div section sections unit units branch branches school schools college colleges faculty faculties office offices institute institutes inst center centre centers centres ctr laboratory laboratories lab labs group groups grp".split()
GENERIC_PATHS = "about people faculty staff directory news contact departments dept home index search page pages en us".split()
PREFIXES = ["department of", "dept of", "dept.", "division of", "div of", "div.", "school of", "institute of", "inst of", "inst.", "center for", "centre for", "faculty of", "office of", "group of", "laboratory of", "lab of"]
SUFFIXES = ["department", "division", "school", "institute", "centre", "center", "laboratory", "lab", "group"]
TWO_PART_ENDINGS = "co.uk ac.uk org.uk ac.jp co.jp com.au edu.au org.au ac.in co.in com.br org.br edu.br ac.nz co.nz ac.za co.za".split()
BRACKETED = r"\(([A-Z][A-Z0-9&\-]{1,9})\)\s*$"

WIDTH = 32


def among(c: Column, words: list[str]) -> Column:
    """One of the words; the list is one literal in the plan."""
    return F.array_contains(F.split(F.lit("\n".join(words)), "\n"), c)


def key_of(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"^[ .,;:()\[\]{}\"']+|[ .,;:()\[\]{}\"']+$", ""))


def geo_words(city: Column, region: Column, country: Column, regions: dict[str, str] | None = None) -> Column:
    """Words of the record's own places; a region code brings its name (``regions``: code to name, lower case)."""
    low = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    whole = [low(c) for c in (city, region, country)]
    if regions:
        table = F.from_json(F.lit(json.dumps(regions)), "map<string,string>")  # one literal in the plan
        whole += [F.coalesce(table[F.regexp_replace(c, r"^[. ]+|[. ]+$", "")], F.lit("")) for c in whole]
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit("([a-z]{2,})"), F.lit(1)) for c in whole))))


def identifies(token: Column, before: Column, geo: Column) -> Column:
    """A word that narrows a search; behind 'of' or 'for' any word of two letters does."""
    known = sorted({*LEGAL, *UNITS, *FACILITY, *CORPORATE, *PLACES, *STOP, *FUNCTION})
    return tx.let(key_of(token), lambda k: k.rlike(r"\p{L}") & (F.length(k) > 1) & (F.coalesce(key_of(before).isin("of", "for"), F.lit(False)) | ~(among(k, known) | F.array_contains(geo, k))))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(tx.clean_whitespace(F.coalesce(text, F.lit(""))), " "), lambda t: t != "")


def has_identifying_word(text: Column, geo: Column) -> Column:
    return tx.let(_tokens(text), lambda ts: F.exists(F.transform(ts, lambda t, k: identifies(t, F.get(ts, k - 1), geo)), lambda x: x))


def two_terms(text: Column, geo: Column) -> Column:
    """The head of a text and the next word that identifies something, with the connector right between them."""
    def cut(ts: Column) -> Column:
        numbers = F.transform(ts, lambda _, k: k)
        head = F.get(F.filter(numbers, lambda k: tx.let(key_of(F.get(ts, k)), lambda x: x.rlike(r"\p{L}") & ~among(x, [*STOP, *LEGAL]))), F.lit(0))
        second = lambda h: F.get(F.filter(numbers, lambda k: (k > h) & identifies(F.get(ts, k), F.get(ts, k - 1), geo)), F.lit(0))
        joined = lambda h, s: F.concat_ws(" ", F.get(ts, h), F.when((s == h + 2) & key_of(F.get(ts, h + 1)).isin("&", "of", "for"), F.get(ts, h + 1)), F.get(ts, s))
        return tx.let(head, lambda h: tx.let(second(h), lambda s: F.when(s.isNull(), F.get(ts, h)).otherwise(joined(h, s))))

    return tx.let(_tokens(text), cut)


def normalised(term: Column, geo: Column) -> Column:
    """Upper case, two terms, cut at a word within the width; null for nothing."""
    cut = tx.let(term, lambda t: F.upper(F.coalesce(two_terms(t, geo), tx.clean_whitespace(t))))
    return tx.let(tx.fill_to_width(cut, WIDTH), lambda t: F.when(t != "", t))


def without_ending(host: Column) -> Column:
    """A host without its last label, or the last two where they are one ending; a single label stays."""
    parts = F.split(F.lower(F.trim(host)), r"\.")
    n = F.when((F.size(parts) >= 3) & among(F.concat_ws(".", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1)), TWO_PART_ENDINGS), 2).when(F.size(parts) >= 2, 1).otherwise(0)
    return F.nullif(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), "."), F.lit(""))


def name_handle(name: Column) -> Column:
    """A name's words without legal forms; an '&' stays between two of them."""
    bare = F.transform(_tokens(name), lambda t: F.regexp_replace(t, r"^[ ,.;:()\[\]{}\"']+|[ ,.;:()\[\]{}\"']+$", ""))
    kept = F.filter(bare, lambda t: (t == "&") | (t.rlike(r"[\p{L}\p{N}]") & ~among(F.lower(t), LEGAL)))
    return tx.let(F.regexp_replace(F.array_join(kept, " "), r"^(?:& ?)+|(?: ?&)+$", ""), lambda t: F.when(t != "", t))


def unit_phrase(name: Column) -> Column:
    """A unit's name without the words that only say it is one at its beginning and end; null if nothing is left."""
    head = lambda t: F.when(among(F.lower(t), PREFIXES), "").otherwise(F.regexp_replace(t, rf"(?i)^(?:{'|'.join(p.replace('.', '[.]') for p in PREFIXES)})\s+", ""))
    tail = lambda t: F.when(among(F.lower(t), SUFFIXES), "").otherwise(F.trim(F.regexp_replace(t, rf"(?i)\s(?:{'|'.join(SUFFIXES)})$", "")))
    return tx.let(tx.let(tx.let(F.trim(name), head), tail), lambda t: F.when(t != "", t))


def is_unit_phrase(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return low.rlike(rf"^(?:{'|'.join(p.replace('.', '[.]') for p in PREFIXES)})(?:\s|$)") | low.rlike(rf"(?:^|\s)(?:{'|'.join(SUFFIXES)})$") | tx.is_granular_unit(name)


def unit_words(text: Column) -> Column:
    """Words that name a unit, as many as fit, without unit words and stop words."""
    left = F.filter(_tokens(text), lambda t: ~among(F.lower(F.regexp_replace(t, r"^[ .,\-()]+|[ .,\-()]+$", "")), UNITS))
    words = F.regexp_extract_all(F.array_join(left, " "), F.lit(r"([A-Za-z0-9&\-]+)"), F.lit(1))
    kept = F.filter(words, lambda t: ~among(F.lower(t), STOP[:-1]))
    fits = lambda out, t: F.when(out == "", F.when(t == "&", out).otherwise(t)).when(F.length(out) + 1 + F.length(t) <= WIDTH, F.concat(out, F.lit(" "), t)).otherwise(out)
    return tx.let(F.regexp_replace(F.aggregate(kept, F.lit(""), fits), r"(?: &)+$", ""), lambda t: F.when(t != "", t))


def site_of(domain: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^[a-z][a-z0-9+.\-]*://|[/?#:].*$", ""), r"^(?:www\.|web\.)+", "")


def below(domain: Column, base: Column) -> Column:
    """What a host has before the institution's domain; null where it isn't under it."""
    host, own = site_of(domain), F.lower(F.trim(base))
    return F.when(host.endswith(F.concat(F.lit("."), own)), F.nullif(F.substring(host, F.lit(1), F.length(host) - F.length(own) - 1), F.lit("")))


def subdomain_acronym(domain: Column, base: Column, name: Column) -> Column:
    """The first label under the institution's domain, where it is the acronym of the unit and no cut word of it."""
    prefix = F.get(F.split(below(domain, base), r"\."), F.lit(0))
    words = lambda core: F.filter(F.regexp_extract_all(F.lower(core), F.lit("([a-z]+)"), F.lit(1)), lambda w: ~among(w, STOP))
    told = lambda core: ~F.exists(words(core), lambda w: tx.segment_matches(prefix, w)) & tx.acronym_matches(prefix, core)
    return F.when(prefix.isNotNull() & F.length(prefix).between(2, 6) & tx.let(F.coalesce(unit_phrase(name), name), told), F.upper(prefix))


def search_term_1(name: Column, domain: Column, acronym: Column, geo: Column) -> Column:
    given = tx.nullify(acronym)
    borne_out = given.isNotNull() & (tx.blank(name) | tx.acronym_matches(given, name))
    return normalised(F.when(borne_out, given).when(~tx.blank(domain), without_ending(domain)).otherwise(F.coalesce(name_handle(name), tx.nullify(name))), geo)


def search_term_2(name: Column, domain: Column, unit_domain: Column, geo: Column, desk: Column, trade_name: Column | None = None) -> Column:
    """``desk``: the unit is a back-office desk; ``trade_name``: the slot holds a trade name, no unit."""
    foreign = (tx.looks_like_research(name) & ~is_unit_phrase(name)) | (trade_name if trade_name is not None else F.lit(False))
    site = F.coalesce(below(unit_domain, domain), without_ending(site_of(unit_domain)), site_of(unit_domain))
    plain = F.when(~among(F.regexp_replace(F.lower(site), r"^[ ./\-]+|[ ./\-]+$", ""), [*UNITS, *GENERIC_PATHS]), F.nullif(site, F.lit("")))
    found = lambda unit: F.coalesce(subdomain_acronym(unit_domain, domain, unit), F.when(unit.rlike(BRACKETED), F.regexp_extract(unit, BRACKETED, 1)), tx.let(F.coalesce(unit_phrase(unit), unit), unit_words), plain)
    term = lambda unit: F.when(unit.isNotNull() & desk, "ADMIN").otherwise(found(unit))
    return normalised(tx.let(F.when(~foreign & has_identifying_word(name, geo), tx.nullify(name)), term), geo)
