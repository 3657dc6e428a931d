"""How well a research registry's entry matches a record's name.

An entry's names stay an array in the row of (record, entry), so scoring needs
no shuffle; tokens, guards and rules are JVM expressions. Only the two edit
ratios that Spark lacks run in one Arrow step, on rows that no cheaper rule has
settled. Blank names score 0; an entry without names scores 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions import text as tx
from loomery.functions.similarity import ratio_of, token_sort_of

# Words, abbreviations and thresholds that decide a match.
TYPE_WORDS = (
    "regional health medical center centre research hospital clinic system systems services care university college institute school department division faculty laboratory laboratories labs "
    "group company inc corporation corp ltd llc gmbh kgaa sarl intl international national american united global"
).split()
CONNECTORS = "the of and for in at on fuer für und der die das des dem den von vom zur zum im de du la le les et pour aux del della delle degli dei da do dos das y e en van het voor".split()
LEGAL = [("limited liability company", "llc"), ("limited liability partnership", "llp"), ("l l c", "llc"), ("l l p", "llp"), ("incorporated", "inc"), ("corporation", "corp"), ("company", "co"), ("limited", "ltd")]
INSTITUTIONS = {"hft": "Hochschule für Technik", "ga tech": "Georgia Institute of Technology"}
STATES = {
    "fla": "Florida", "calif": "California", "ariz": "Arizona", "colo": "Colorado", "conn": "Connecticut", "tenn": "Tennessee", "wisc": "Wisconsin", "minn": "Minnesota", "okla": "Oklahoma",
    "nebr": "Nebraska", "mich": "Michigan", "tex": "Texas", "wash": "Washington", "penn": "Pennsylvania", "ill": "Illinois", "ind": "Indiana", "mass": "Massachusetts", "miss": "Mississippi",
    "ore": "Oregon", "kan": "Kansas", "ark": "Arkansas", "ala": "Alabama",
}
POSTAL = {
    "al": "Alabama", "ak": "Alaska", "az": "Arizona", "ar": "Arkansas", "ca": "California", "co": "Colorado", "ct": "Connecticut", "de": "Delaware", "fl": "Florida", "ga": "Georgia", "hi": "Hawaii",
    "id": "Idaho", "il": "Illinois", "in": "Indiana", "ia": "Iowa", "ks": "Kansas", "ky": "Kentucky", "la": "Louisiana", "me": "Maine", "md": "Maryland", "ma": "Massachusetts", "mi": "Michigan",
    "mn": "Minnesota", "ms": "Mississippi", "mo": "Missouri", "mt": "Montana", "ne": "Nebraska", "nv": "Nevada", "nh": "New Hampshire", "nj": "New Jersey", "nm": "New Mexico", "ny": "New York",
    "nc": "North Carolina", "nd": "North Dakota", "oh": "Ohio", "ok": "Oklahoma", "or": "Oregon", "pa": "Pennsylvania", "ri": "Rhode Island", "sc": "South Carolina", "sd": "South Dakota",
    "tn": "Tennessee", "tx": "Texas", "ut": "Utah", "vt": "Vermont", "va": "Virginia", "wa": "Washington", "wv": "West Virginia", "wi": "Wisconsin", "wy": "Wyoming",
}
WORDLIKE = ["hi", "in", "or", "ok", "me", "la", "de"]
STATE_CONTEXT, TECH_CONTEXT = r"State\s+Univ(?:ersity)?", r"Institute\s+of\s+Technology|Tech"
BRACKET_COUNTRIES = (
    "United States|USA|United Kingdom|UK|Germany|France|Japan|China|Canada|Australia|Switzerland|Netherlands|Spain|Italy|Sweden|Denmark|Norway|Finland|Belgium|Austria|Ireland|Poland|Israel|"
    "Singapore|Brazil|India|Mexico|New Zealand|South Korea|Russia|Portugal|Czech Republic|Greece|Turkey|South Africa|Hong Kong|Taiwan"
)
TAIL_COUNTRIES = "USA|United States|UK|United Kingdom|Canada|Germany|France|Japan|Australia|Switzerland|Netherlands|China|India|Brazil|Italy|Spain|Sweden"
CANONICAL_TYPES = ["ror_display", "label"]
DEAD = ["inactive"]
SIGNIFICANT, LONG_NAME, CAPPED, SUBSTRING_SHARE, TYPO_RATIO = 4, 5, 0.7, 0.9, 85.0


def comparable(name: Column) -> Column:
    """Lower case, dashes, dots and commas as blanks, legal forms in short."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[‐-―\-.,]+", " "), r"(?U)^\s+|\s+$", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    for long, short in LEGAL:
        out = F.regexp_replace(out, rf"(?U)\b{long}\b", short)
    return out


def expand_states(name: Column) -> Column:
    """State abbreviations in full; two-letter codes only in front of what makes them a state's university."""
    codes = name
    for code, state in POSTAL.items():
        context = STATE_CONTEXT if code in WORDLIKE else rf"{STATE_CONTEXT}|{TECH_CONTEXT}"
        # a phrase that INSTITUTIONS knows is left to it
        owned = "".join(rf"(?!{k.split(' ', 1)[1]}\b)" for k in INSTITUTIONS if k.startswith(f"{code} "))
        codes = F.regexp_replace(codes, rf"(?iU)\b{code}\b(?=\s+{owned}(?:{context})\b)", state)
    out = F.when(name.rlike(rf"(?iU)\b[a-z]{{2}}\s+(?:{STATE_CONTEXT}|{TECH_CONTEXT})\b"), codes).otherwise(name)
    for short, state in STATES.items():
        out = F.regexp_replace(out, rf"(?iU)\b{short}\b\.?", state)
    return out


def expand_institutions(name: Column) -> Column:
    out = name
    for short in sorted(INSTITUTIONS, key=len, reverse=True):
        out = F.regexp_replace(out, r"(?iU)\b" + short.replace(" ", r"\s+") + r"\b", INSTITUTIONS[short])
    return out


def strip_country(name: Column) -> Column:
    """Without the registry's trailing "(Country)" or ", City, ST, Country"; a name that is only that stays."""
    bare = F.regexp_replace(name, rf"(?i)\s*\(\s*(?:{BRACKET_COUNTRIES})\s*\)\s*$", "")
    bare = F.trim(F.regexp_replace(bare, rf"(?i),\s*[A-Z][A-Za-z .'\-]+,\s*[A-Z]{{2}},\s*(?:{TAIL_COUNTRIES})\s*$", ""))
    return F.when(bare == "", name).otherwise(bare)


def acronyms(name: Column) -> Column:
    """Words of two to five characters in capitals (digits too, but not alone), lower-cased."""
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"([A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w).between(2, 5) & (w == F.upper(w))), F.lower))


def required_acronyms(name: Column) -> Column:
    """Acronyms that a match must carry: none where all is in capitals, as case says nothing there."""
    return F.when(name.rlike(r"\p{Ll}"), acronyms(name)).otherwise(F.array().cast("array<string>"))


def place_tokens(*parts: Column) -> Column:
    """Significant words of city, region and country: they say where, not who."""
    words = F.split(F.concat_ws(" ", *[comparable(p) for p in parts]), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= SIGNIFICANT))


def _covered(word: str, words: list[str]) -> bool:
    for other in words:
        short, long = sorted((word, other), key=len)
        if word == other or (len(short) >= SIGNIFICANT and (long.startswith(short) or ratio_of(word, other) >= TYPO_RATIO)):
            return True
    return False


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("share", T.DoubleType()), T.StructField("covered", T.BooleanType())])))
def _compare(query: pd.Series, marks: pd.Series, names: pd.Series) -> pd.Series:
    """For each name its token-sort ratio and whether it covers all of the query's marks; null where names is."""
    return pd.Series([None if n is None else [{"share": token_sort_of(q, x) / 100, "covered": all(_covered(m, x.split()) for m in k)} for x in n] for q, k, n in zip(query, marks, names, strict=True)], dtype=object)


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def initialism(query: Column, names: Column) -> Column:
    """Does an acronym of the query stand for neighbouring words of a name, one of them telling, with a type word shared?

    ``names``: comparable forms.
    """
    types = F.array_intersect(F.split(comparable(query), " "), F.lit(TYPE_WORDS))
    long = F.filter(acronyms(query), lambda a: F.length(a) >= 3)

    def stands(words: Column, a: Column) -> Column:
        at = F.instr(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), a)
        run = F.slice(words, F.greatest(at, F.lit(1)), F.length(a))
        return (at > 0) & F.exists(run, lambda w: (F.length(w) >= SIGNIFICANT) & ~w.isin(TYPE_WORDS))

    def fits(name: Column) -> Column:
        return tx.let(F.split(name, " "), lambda words: (F.size(words) >= 2) & ((F.size(types) == 0) | F.arrays_overlap(types, words)) & F.exists(long, lambda a: stands(words, a)))

    return F.exists(names, fits)


def score_entries(pairs: DataFrame, query: str, names: str, places: list[str]) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``guards``, rules that hold against the nearest names.

    pairs: one row per record and entry; ``query`` the record's name, ``places``
    its city, region and country, ``names`` array<struct<value, types>>. In
    turn: equal to any name; all significant words in a canonical name, or one
    inside the other at nearly its length (not on places alone, and never
    without the query's acronyms); token-sort ratio with a canonical name, at
    most 0.7 where a telling word or an acronym has no counterpart; initials.
    """
    q = F.col(query)
    forms = F.transform(F.filter(F.coalesce(F.col(names), F.array()), lambda n: F.coalesce(n["value"] != "", F.lit(False))), lambda n: F.struct(comparable(n["value"]).alias("form"), F.coalesce(F.arrays_overlap(n["types"], F.lit(CANONICAL_TYPES)), F.lit(False)).alias("canonical")))
    d = pairs.withColumns({"_q": comparable(q), "_forms": forms, "_must": required_acronyms(F.coalesce(q, F.lit(""))), "_places": place_tokens(*[F.col(p) for p in places])})
    d = d.withColumn("_words", F.filter(F.array_distinct(F.split("_q", " ")), lambda w: F.length(w) >= SIGNIFICANT))
    d = d.withColumns({"_own": F.array_except("_words", "_places"), "_canonical": F.transform(F.filter("_forms", lambda f: f["canonical"]), lambda f: f["form"])})
    d = d.withColumn("_marks", F.array_except("_own", F.lit(TYPE_WORDS + CONNECTORS)))

    def shortcut(name: Column) -> Column:
        a, b = F.length("_q"), F.length(name)
        inside = (F.least(a, b) / F.greatest(a, b) >= SUBSTRING_SHARE) & (F.contains(F.col("_q"), name) | F.contains(name, F.col("_q")))
        return _subset(F.col("_must"), F.split(name, " ")) & (((F.size("_words") > 0) & _subset(F.col("_words"), F.split(name, " "))) | inside)

    placeless = (F.size("_words") == 0) | (F.size("_own") > 0)
    settled = (
        F.when(F.col("_q") == "", 0.0).when(F.exists("_forms", lambda f: f["form"] == F.col("_q")), 1.0)
        .when(~F.exists("_forms", lambda f: F.length(f["form"]) >= LONG_NAME), 0.0).when(placeless & F.exists("_canonical", shortcut), 1.0)
    )
    d = d.withColumn("_settled", settled).withColumn("_long", F.when(F.col("_settled").isNull(), F.filter("_canonical", lambda f: F.length(f) >= LONG_NAME)))
    judged = F.zip_with("_long", _compare("_q", "_marks", "_long"), lambda name, c: F.struct(c["share"].alias("share"), (~c["covered"]).alias("telling"), (~_subset(F.col("_must"), F.split(name, " "))).alias("acronym")))
    d = d.withColumn("_judged", judged)
    fuzzy = F.array_max(F.transform("_judged", lambda j: F.when(j["telling"] | j["acronym"], F.least(j["share"], F.lit(CAPPED))).otherwise(j["share"])))
    d = d.withColumn("_fuzzy", F.coalesce(fuzzy, F.lit(0.0)))
    held = lambda rule: F.exists("_judged", lambda j: j[rule] & (j["share"] > 0) & (j["share"] >= F.col("_fuzzy")))
    guards = F.array_compact(F.array(F.when(held("telling"), "distinctive_token"), F.when(held("acronym"), "identifier_token")))
    score = F.coalesce("_settled", F.when(initialism(q, F.col("_canonical")), 1.0), "_fuzzy")
    return d.withColumns({"score": score, "guards": guards}).drop("_q", "_forms", "_must", "_places", "_words", "_own", "_canonical", "_marks", "_settled", "_long", "_judged", "_fuzzy")


def best_entry(scored: DataFrame, key: str, entry: str, status: str, threshold: float = 0.8) -> DataFrame:
    """The best entry of each record, aggregated map-side: score, then least id; ``dead`` if the registry closed it.

    A record whose best score is below the threshold has no entry and isn't dead.
    """
    ranked = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), entry, status)).alias("b"))
    enough = -F.col("b.s") >= threshold
    return ranked.select(key, F.when(enough, F.col(f"b.{entry}")).alias(entry), (-F.col("b.s")).alias("score"), (enough & F.coalesce(F.lower(F.trim(f"b.{status}")).isin(DEAD), F.lit(False))).alias("dead"))
