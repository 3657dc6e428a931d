"""Host labels and acronyms against exhaustive search."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from loomery.functions import coverage as cov
from loomery.functions import text as tx


def forms(word, initials):
    cut = [word[:n] for n in range(3, len(word))] if len(word) >= 5 else []
    return {word, *cov.ABBREVIATIONS.get(word, []), *cut, *([word[0]] if initials else [])}


def spelt(label, words, initials, begun=False):
    """Every way, one after the other."""
    if not label:
        return begun
    if words and (spelt(label, words[1:], initials, begun) or any(label.startswith(f) and spelt(label[len(f) :], words[1:], initials, True) for f in forms(words[0], initials))):
        return True
    return begun and not words and any(label.startswith(f) and spelt(label[len(f) :], [], initials, True) for f in cov.LEGAL_ENDS)


def test_labels_equal_backtracking(spark):
    rng = random.Random(1)
    stock = ["em", "services", "knt", "manufacturing", "precision", "research", "labora", "laboratories", "aab", "aabaa", "co", "group", "texas", "a", "ab"]
    rows = []
    for _ in range(400):
        words = [rng.choice(stock) for _ in range(rng.randint(0, 4))]
        label = "".join(rng.choice(sorted(forms(w, rng.random() < 0.3))) for w in words if rng.random() < 0.8) + rng.choice(["", "", "llc", "cosa", "x", "gate"])
        rows.append((label, " ".join(words).title() + rng.choice(["", " 3", "!"])))
    rows += [("emservicesllc", "EM Services LLC"), ("kntmfg", "KNT Manufacturing"), ("researchgate", "Precision Research"), ("scup", "Bayfront Research"), ("mit", "Massachusetts Institute of Technology"), ("llc", "LLC"), ("", "x"), ("co", "")]
    got = spark.createDataFrame(rows, "l string, n string").select("l", "n", cov.label_covered(F.col("l"), F.col("n")).alias("w"), cov.label_covered(F.col("l"), F.col("n"), initials=True).alias("i")).collect()
    for r in got:
        words = "".join(c if c.isalpha() else " " for c in r["n"].lower()).split()
        assert (r["w"], r["i"]) == (spelt(r["l"], words, False), spelt(r["l"], words, True)), r
    known = {(r["l"], r["n"]): (r["w"], r["i"]) for r in got}
    assert known["kntmfg", "KNT Manufacturing"] == (True, True) and known["researchgate", "Precision Research"] == (False, False) and known["mit", "Massachusetts Institute of Technology"] == (False, True)


def test_hosts(spark):
    rows = [("www-kntmfg.com", "KNT"), ("kntmfg.com", "KNT Manufacturing"), ("mit.edu", "Massachusetts Institute of Technology"), (None, "x"), ("scup.org", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "d string, n string").select(cov.host_coverage(F.col("d"), F.col("n"))).collect()] == [None, "words", "initials", None, None]


def plain_slots(short, phrase):
    letters = "".join(c for c in short.lower() if c.isalpha())
    words = "".join(c if c.isalpha() else " " for c in phrase.lower()).split()
    if len(letters) < 2 or len(words) < 2:
        return None
    found = []
    for gives in product(*(range(min(len(w), len(letters)) + 1) for w in words)):
        if sum(gives) == len(letters) and "".join(w[:n] for w, n in zip(words, gives)) == letters:
            slots = [k for k, n in enumerate(gives) for _ in range(n)]
            found.append((-len(set(slots)), slots))
    if not found or len(set(min(found)[1])) < 2:
        return None
    slots = min(found)[1]
    telling = [k for k, w in enumerate(words) if w not in tx.STOPWORDS]
    return ("initials" if len(set(slots)) == len(slots) and (slots == telling or len(slots) == len(words)) else "syllables", slots)


def test_acronyms_equal_enumeration(spark):
    rng = random.Random(2)
    stock = ["food", "and", "drug", "of", "administration", "aa", "ab", "california", "institute", "for", "biomedical", "research", "an"]
    rows = []
    for _ in range(300):
        words = [rng.choice(stock) for _ in range(rng.randint(1, 5))]
        rows.append(("".join(w[: rng.choice([0, 1, 1, 1, 2, 3])] for w in words).upper()[:6] or "X", " ".join(words)))
    rows += [("CALIBR", "California Institute for Biomedical Research"), ("IBM", "International Business Machines"), ("U.C.L.A.", "University of California, Los Angeles"), ("UC", "Berkeley")]
    for r in spark.createDataFrame(rows, "s string, p string").select("s", "p", cov.acronym_slots(F.col("s"), F.col("p")).alias("a")).collect():
        assert (r["a"] and (r["a"]["kind"], r["a"]["slots"])) == plain_slots(r["s"], r["p"]), r


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("MIT Massachusetts Institute of Technology", "Massachusetts Institute of Technology"), ("Massachusetts Institute of Technology (MIT)", "Massachusetts Institute of Technology"), ("MIT (Massachusetts Institute of Technology)", "Massachusetts Institute of Technology"),
        ("FDA - Food & Drug Administration", "Food and Drug Administration"), ("International Business Machines IBM", "International Business Machines"), ("UC Berkeley", "UC Berkeley"), ("3M Company", "3M Company"), ("Heriot-Watt University", "Heriot-Watt University"),
        ("Bio-Rad", "Bio-Rad"), ("CALIBR - California Institute for Biomedical Research", "CALIBR - California Institute for Biomedical Research"), ("", ""), (None, None),
    ],
)
def test_names_lose_an_acronym_that_they_spell_out(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(cov.without_acronym(F.col("n"))).first()[0] == want
