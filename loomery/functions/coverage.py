"""Short forms against names: host labels spelt by a name's words, acronyms aligned with a phrase.

Both are dynamic programmes over the letters of the short form, word by word, as
``aggregate`` expressions: the state is what the words so far can have spelt, so
no choice is final before the last word, and nothing is tried twice.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import text as tx

# Contractions that names use in their domains, and legal forms that may close one.
ABBREVIATIONS = {
    "manufacturing": ["mfg", "mfr", "manu"], "manufacturers": ["mfrs", "mfg"], "technology": ["tech"], "technologies": ["tech"], "services": ["svcs", "svc", "serv"], "service": ["svc", "serv"], "international": ["intl"], "engineering": ["engr", "eng"], "engineers": ["engr", "eng"],
    "laboratories": ["labs", "lab"], "laboratory": ["lab"], "association": ["assoc", "assn"], "associates": ["assoc"], "management": ["mgmt", "mgt"], "industries": ["inds", "ind"], "industrial": ["ind"], "systems": ["sys"], "solutions": ["soln", "sol"], "group": ["grp"],
    "pharmaceuticals": ["pharma"], "pharmaceutical": ["pharma"], "equipment": ["equip"], "products": ["prods", "prod"], "construction": ["constr"], "development": ["dev"], "instruments": ["instr"], "resources": ["res"],
}
LEGAL_ENDS = "llc llp lp inc incorporated corp corporation co company ltd limited plc gmbh mbh ag kg bv nv sa sas srl spa ab as oy aps pte pty pvt kk kft zrt doo".split()

#: Letters of a truncated word that still tell it, and letters that a word must have to be truncated.
LEAST_PREFIX, LEAST_WORD = 3, 5


def words_of(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))


def forms_of(word: Column, initials: bool) -> Column:
    """What may stand for a word: itself, its contractions, its longer beginnings and, if ``initials``, its first letter."""
    table = F.from_json(F.lit(json.dumps(ABBREVIATIONS)), "map<string,array<string>>")  # one literal in the plan
    none = F.array().cast("array<string>")
    cut = F.when(F.length(word) >= LEAST_WORD, F.transform(F.sequence(F.lit(LEAST_PREFIX), F.greatest(F.length(word) - 1, F.lit(LEAST_PREFIX))), lambda n: F.substring(word, F.lit(1), n))).otherwise(none)
    short = F.array(F.substring(word, 1, 1)) if initials else none
    return F.array_distinct(F.concat(F.array(word), F.coalesce(table[word], none), cut, short))


def _reach(label: Column, at: Column, forms: Column) -> Column:
    """Positions that one of the forms leads to from one of the positions, and those themselves."""
    ahead = F.flatten(F.transform(at, lambda p: F.transform(F.filter(forms, lambda f: F.substring(label, p + 1, F.length(f)) == f), lambda f: p + F.length(f))))
    return F.array_distinct(F.concat(at, ahead))


def label_covered(label: Column, name: Column, initials: bool = False) -> Column:
    """A label (lower-case letters and digits) is spelt out whole by the name's words in order; words may be left out
    or contracted, and legal forms may close it, after one word at least. False for blank ones."""
    start = F.array(F.lit(0))
    spelt = F.aggregate(words_of(name), start, lambda at, w: _reach(label, at, forms_of(w, initials)))
    begun = F.filter(spelt, lambda p: p > 0)
    rounds = F.sequence(F.lit(1), F.greatest(F.floor(F.length(label) / 2).cast("int"), F.lit(1)))  # the shortest legal form has two letters
    closed = F.aggregate(rounds, begun, lambda at, _: _reach(label, at, F.split(F.lit(" ".join(LEGAL_ENDS)), " ")))
    return F.coalesce((label != "") & F.array_contains(closed, F.length(label)), F.lit(False))


def host_label(domain: Column) -> Column:
    """The first label of a registrable domain, letters and digits alone."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(domain, F.lit(""))), r"^[^.]*", 0), "[^a-z0-9]", "")


def host_coverage(domain: Column, name: Column) -> Column:
    """'words', 'initials' (words and first letters) or null: how a name covers a domain's first label."""
    return tx.let(host_label(domain), lambda x: F.when(label_covered(x, name), "words").when(label_covered(x, name, initials=True), "initials"))


_STATE = "array<struct<pos:int,used:int,slots:array<int>>>"


def acronym_slots(short: Column, phrase: Column) -> Column:
    """struct(kind, slots): for each letter of ``short`` the number (from 0) of the word of ``phrase`` that it comes from;
    null where the letters don't align.

    Words give their first letters, in order; a stop word or any other may give none. ``kind`` is
    'initials' if every word that isn't a stop word, or every word, gives its first letter
    alone, else 'syllables'. Of several alignments the one over most words counts, then that whose slots come first.
    Two letters and two words at least.
    """
    letters = F.lower(F.regexp_replace(F.coalesce(short, F.lit("")), "[^A-Za-z]", ""))
    words = words_of(phrase)
    start = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("slots"))).cast(_STATE)

    def give(states: Column, word: Column, k: Column, a: Column) -> Column:
        more = lambda s, n: F.struct((s["pos"] + n).alias("pos"), (s["used"] + (n > 0).cast("int")).alias("used"), F.concat(s["slots"], F.array_repeat(k, n)).alias("slots"))
        fits = lambda s: F.filter(F.sequence(F.lit(0), F.least(F.length(word), F.length(a) - s["pos"])), lambda n: F.substring(a, s["pos"] + 1, n) == F.substring(word, F.lit(1), n))
        made = F.flatten(F.transform(states, lambda s: F.transform(fits(s), lambda n: more(s, n))))
        best = lambda p: F.array_min(F.transform(F.filter(made, lambda s: s["pos"] == p), lambda s: F.struct((-s["used"]).alias("less"), s["slots"].alias("slots"))))
        kept = F.transform(F.array_sort(F.array_distinct(F.transform(made, lambda s: s["pos"]))), lambda p: tx.let(best(p), lambda b: F.struct(p.alias("pos"), (-b["less"]).alias("used"), b["slots"].alias("slots"))))
        return kept.cast(_STATE)

    def aligned(a: Column) -> Column:
        numbered = F.transform(words, lambda w, k: F.struct(w.alias("w"), k.alias("k")))
        ends = F.aggregate(numbered, start, lambda s, x: give(s, x["w"], x["k"], a))
        return F.get(F.filter(ends, lambda s: s["pos"] == F.length(a)), F.lit(0))["slots"]

    telling = F.filter(F.transform(words, lambda w, k: F.when(~w.isin(tx.STOPWORDS), k)), lambda k: k.isNotNull())
    initials = lambda slots: (F.size(F.array_distinct(slots)) == F.size(slots)) & ((slots == telling) | (F.size(slots) == F.size(words)))
    result = tx.let(letters, lambda a: F.when((F.length(a) >= 2) & (F.size(words) >= 2), aligned(a)))
    return tx.let(result, lambda s: F.when(s.isNotNull() & (F.size(F.array_distinct(s)) >= 2), F.struct(F.when(initials(s), "initials").otherwise("syllables").alias("kind"), s.alias("slots"))))


ACRONYM = r"^[A-Z][A-Z&.]{1,7}$"


def without_acronym(name: Column) -> Column:
    """A name that has an acronym and what it stands for, without the acronym: 'MIT Massachusetts Institute of
    Technology', '... (MIT)', 'MIT (...)', 'FDA - Food & Drug Administration'. Others stay as they are."""
    return F.when(name.rlike(r"[A-Z][A-Z&.]"), tx.let(tx.clean_whitespace(name), lambda v: F.coalesce(_spelt_out(v), name))).otherwise(name)


def _spelt_out(v: Column) -> Column:
    """What the acronym in a name stands for; null where there is none."""
    shapes = [r"^(\S+)\s*[-‐-―]\s*(.+)$", r"^(\S+)\s*\(([^)]+)\)$", r"^(\S+)\s+(\S+\s.+)$"]
    turned = [r"^(.+\S)\s*[-‐-―]\s*(\S+)$", r"^(.+\S)\s*\(([^)]+)\)$", r"^(\S+\s.*\S)\s+(\S+)$"]
    pairs = [(F.regexp_extract(v, p, 1), F.regexp_extract(v, p, 2)) for p in shapes] + [(F.regexp_extract(v, p, 2), F.regexp_extract(v, p, 1)) for p in turned]
    listed = F.array(*(F.struct(a.alias("short"), b.alias("full")) for a, b in pairs))
    spelt = lambda x: x["short"].rlike(ACRONYM) & (F.coalesce(acronym_slots(x["short"], x["full"])["kind"], F.lit("")) == "initials")
    tidy = lambda full: F.regexp_replace(F.regexp_replace(full, r"\s*&\s*", " and "), r"^[ ,;\-]+|[ ,;\-]+$", "")
    return tx.let(tidy(F.get(F.filter(listed, spelt), F.lit(0))["full"]), lambda t: F.when(t != "", t))
