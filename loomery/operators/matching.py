"""Matching records with registries, places, pages and search results.

External answers are evidence DataFrames joined on a deterministic key; the
choice among candidates is a window with a total order, so it never depends on
the order of the evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.functions import urls
from loomery.functions.similarity import token_sort_ratio

ROR_THRESHOLD, LEI_THRESHOLD, DOMAIN_THRESHOLD, PAGE_THRESHOLD, REDIRECT_THRESHOLD, CHILD_THRESHOLD = 0.8, 88.0, 82.0, 88.0, 60.0, 70.0
MARGIN = 2.0
LEGAL_TOKENS = "inc incorporated corp corporation co company llc llp lp ltd limited plc gmbh mbh ag sa se nv bv kg ohg spa srl sarl oy ab as".split()
NOISE = LEGAL_TOKENS + "the and of for group holding holdings international".split()


def lookup_key(name: Column, country: Column) -> Column:
    return F.struct(tx.fold_key(name).alias("name"), F.upper(F.trim(country)).alias("country"))


def name_core(name: Column) -> Column:
    """Significant words with their case, legal forms dropped."""
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"([A-Za-z0-9&]+)"), F.lit(1))
    return F.filter(words, lambda t: ~F.lower(t).isin(LEGAL_TOKENS))


def is_collision_prone(name: Column) -> Column:
    """Too short to tell one organisation: four characters in all, or one acronym of five."""
    return tx.let(name_core(name), lambda t: (F.size(t) > 0) & ((F.length(F.array_join(t, "")) <= 4) | ((F.size(t) == 1) & F.get(t, F.lit(0)).rlike(r"^(?=.*[A-Z])[A-Z0-9&]{1,5}$"))))


def distinctive_tokens(name: Column) -> Column:
    words = F.filter(F.split(tx.fold_key(name), " "), lambda w: (w != "") & ~w.isin(NOISE))
    return F.array_distinct(words)


def agree_by_containment(a: Column, b: Column) -> Column:
    """One name's words all stand in the other, the longer one's first word among them."""
    x, y = distinctive_tokens(a), distinctive_tokens(b)
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    return (F.size(short) > 0) & (F.size(F.array_except(short, long)) == 0) & F.array_contains(short, F.get(long, F.lit(0)))


def match_tier(query: Column, candidate: Column, crosswalk: Column) -> Column:
    exact = tx.strip_legal_suffix(query) == tx.strip_legal_suffix(candidate)
    return F.when(crosswalk, "crosswalk").when(is_collision_prone(query), "short_name").when(exact, "exact").otherwise("fuzzy")


def second_signal(location_verdict: Column, candidate_domain: Column, record_domain: Column) -> Column:
    return F.when(location_verdict == "consistent", "location").when(candidate_domain == record_domain, "domain")


def location_action(verdict: Column, tier: Column) -> Column:
    return F.when(verdict != "contradicted", "none").when(tier.isin("exact", "crosswalk"), "unconfirmed").otherwise("mismatch")


def normalise_region(c: Column, names: dict[str, str]) -> Column:
    """US-TX, TX and Texas are one region; ``names``: code to name, lower-cased both."""
    code = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^[a-z]{2}-(?=[a-z0-9]{1,3}$)|[. ]+$", "")
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return F.coalesce(table[code], code) if names else code


def postal_matches(a: Column, b: Column) -> Column:
    five = lambda c: F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", ""), 1, 5)
    return (five(a) != "") & (five(a) == five(b))


def compare_locality(stated: dict[str, Column], record: dict[str, Column], regions: dict[str, str] | None = None) -> Column:
    """struct(verdict, scope) for city, region, country and postal_code of both sides.

    Postal code, then country, region, city; a side that says nothing is
    neutral, never agreement.
    """
    n = lambda c: F.lower(tx.clean_whitespace(F.coalesce(c, F.lit(""))))
    sc, rc, sr, rr = n(stated["city"]), n(record["city"]), normalise_region(stated["region"], regions or {}), normalise_region(record["region"], regions or {})
    sk, rk = n(stated["country"]), n(record["country"])
    both = lambda a, b: (a != "") & (b != "")
    out = lambda v, s: F.struct(F.lit(v).alias("verdict"), F.lit(s).cast("string").alias("scope"))
    return (
        F.when(postal_matches(stated["postal_code"], record["postal_code"]), out("consistent", "postal"))
        .when(both(sk, rk) & (sk != rk), out("contradicted", "country"))
        .when(both(sr, rr) & (sr != rr), out("contradicted", "region"))
        .when(both(sc, rc) & (sc == rc), out("consistent", "city"))
        .when(both(sc, rc), out("contradicted", "city"))
        .when(both(sr, rr), out("consistent", "region"))
        .otherwise(out("neutral", None))
    )


def rank_registry(candidates: DataFrame, query: str, threshold: float = LEI_THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """The best candidate per query with ambiguous: a runner-up within the margin.

    candidates: query key, candidate_id, score, active, region_agrees,
    country_ok. Country is a filter before ranking; active ones come first,
    then agreeing regions, score and id. The runner-up is any candidate of the
    same activity, also below the threshold; if the winner's region agrees,
    only ones that agree too.
    """
    ok = candidates.filter("country_ok")
    order = Window.partitionBy(query).orderBy(F.desc("_enough"), F.desc("active"), F.desc("region_agrees"), F.desc("score"), "candidate_id")
    w = Window.partitionBy(query)
    r = ok.withColumn("_enough", F.col("score") >= threshold).withColumn("_place", F.row_number().over(order))
    win = lambda c: F.max(F.when(F.col("_place") == 1, F.col(c))).over(w)
    r = r.withColumns({"_a": win("active"), "_r": win("region_agrees"), "_s": win("score")})
    rival = (F.col("_place") > 1) & (F.col("active") == F.col("_a")) & (~F.col("_r") | F.col("region_agrees"))
    r = r.withColumn("runner_up", F.max(F.when(rival, F.col("score"))).over(w))
    best = r.filter("_place = 1 and _enough")
    return best.select(query, "candidate_id", "score", "runner_up", F.coalesce(F.abs(F.col("score") - F.col("runner_up")) < margin, F.lit(False)).alias("ambiguous"))


def name_scores(pairs: DataFrame, a: str, b: str, to: str = "score") -> DataFrame:
    """Adds the token-sort ratio of two name columns, the greater of raw and without legal forms."""
    core = lambda c: F.lower(F.array_join(name_core(F.col(c)), " "))
    return pairs.withColumn(to, F.greatest(token_sort_ratio(F.lower(F.col(a)), F.lower(F.col(b))), token_sort_ratio(core(a), core(b))))


def classify(ror_types: Column, gleif_form: Column, name: Column) -> Column:
    """Record type by ranked evidence: research registry, then legal form, then the name's words."""
    firm = gleif_form.isin("2HBR", "40DB", "6QQB", "XTIQ", "HZEH", "MVII")
    return F.when(F.exists(ror_types, lambda t: F.lower(t).isin("education", "facility", "healthcare", "government", "nonprofit", "archive")), "research").when(F.exists(ror_types, lambda t: F.lower(t) == "company"), "company").when(F.coalesce(firm, F.lit(False)) & ~tx.looks_like_research(name), "company").when(tx.looks_like_research(name), "research").otherwise("unknown")


def liveness(status: Column, registration: Column) -> Column:
    return F.when(F.upper(status) == "INACTIVE", "inactive").when(F.upper(registration).isin("RETIRED", "MERGED"), F.lower(registration))


def rank_websites(results: DataFrame, query: str, name: str, country: str, city: str) -> DataFrame:
    """Search results that may be the record's site, with place: 1 is the choice.

    Third parties and wrong countries go; a host must carry a word of the name
    or its initials. Then rank, authoritative ending, city in the snippet, few
    host labels, place in the list, url.
    """
    host = urls.host_without_www(F.col("url"))
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(name), F.lit(""))), r"[^\p{L}0-9]+", " "), " "), lambda w: (F.length(w) >= 4) & ~w.isin(NOISE))
    hit = F.exists(words, lambda w: F.contains(host, w)) | ((F.length(tx.name_initials(F.col(name))) >= 3) & F.contains(host, F.lower(tx.name_initials(F.col(name)))))
    kept = results.withColumn("host", host).filter(~urls.is_third_party(F.col("url")) & ~urls.country_conflict(urls.registrable(host), F.col(country)) & hit)
    order = Window.partitionBy(query).orderBy("rank", F.desc(urls.tld(host).isin("edu", "gov", "ac")), F.desc(F.contains(F.lower(F.coalesce("snippet", F.lit(""))), F.lower(F.coalesce(F.col(city), F.lit("\u0000"))))), urls.host_depth(F.col("url")), "rank", "url")
    return kept.withColumn("place", F.row_number().over(order))


def dept_score(url: Column, base: Column, title: Column, tokens: Column) -> Column:
    """3 for a unit word in the host, 1 in the path, 1 in the title, less the path's depth; 0 on the bare site."""
    host, path = urls.host_without_www(url), F.lower(urls.path_of(url))
    any_in = lambda hay: F.coalesce(F.exists(tokens, lambda t: F.contains(hay, t)), F.lit(False)).cast("int")
    prefix = F.regexp_replace(host, r"\.?[^.]+\.[^.]+$", "")
    raw = 3 * any_in(prefix) + any_in(path) + any_in(F.lower(F.coalesce(title, F.lit("")))) - urls.path_penalty(url)
    return F.when((host == base) & (F.trim(path, F.lit("/")) == ""), 0).otherwise(F.greatest(raw, F.lit(0)))
