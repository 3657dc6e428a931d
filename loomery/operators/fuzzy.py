"""Registry names that nearly equal a query: an inverted index of character pairs.

Names are compared as their sorted words. A score (``token_sort_ratio``) of
``least`` or more bounds how many letters may be inserted or deleted, given the
lengths, and one such edit spoils two of a name's character pairs at most. So of
the n pairs of a name all but 2d are shared, d being the edits that its length
allows, and among the rarest 2d+m pairs of either name m must be: only those are
indexed and looked up, names are compared that share ``SHARED`` of them (fewer where
a short name hasn't as many to share), and lengths that can't reach the score are
never joined. Frequent pairs go by that rule, not by a cap, and the hits are
those of a comparison of every query with every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.functions.similarity import token_sort_ratio
from loomery.sources.scratch import staged

LEAST, BEST = 88.0, 5
#: Pairs of letters that two names must share among their rarest before they are compared.
SHARED = 3


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(tx.clean_whitespace(F.lower(F.coalesce(name, F.lit("")))), " "), lambda w: w != "")), " ")


def pairs_of(form: Column) -> Column:
    """A form's character pairs, its ends marked, each with its number among its equals."""
    marked = F.concat(F.lit("\u0001"), form, F.lit("\u0002"))
    cut = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda k: F.substring(marked, k, F.lit(2)))
    numbered = lambda p: F.transform(p, lambda x, k: F.concat(x, (k - F.array_position(p, x)).cast("string")))
    return tx.let(F.array_sort(cut), numbered)


def edits_allowed(length: Column, least: float) -> Column:
    """Most insertions and deletions between a form and any other that scores ``least``."""
    lost = 1 - least / 100
    longest = F.floor(length * (2 - least / 100) / (least / 100) + 1e-9)
    return F.floor((length + longest) * lost + 1e-9)


def _forms(names: DataFrame) -> DataFrame:
    """The distinct forms of (key, form) rows, with their lengths."""
    return names.select("form").distinct().withColumn("length", F.length("form"))


def _rarest(forms: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """(form, length, must, pair) of the pairs that a form is looked up by, and how many of them it must share."""
    met = forms.select("form", "length", F.explode(pairs_of(F.col("form"))).alias("pair")).join(frequency, "pair", "left")
    listed = met.groupBy("form", "length").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("pairs"))
    spoilt = 2 * edits_allowed(F.col("length"), least)
    must = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.size("pairs") - spoilt)).cast("int")
    return listed.select("form", "length", must.alias("must"), F.explode(F.slice(F.transform("pairs", lambda x: x["pair"]), F.lit(1), (spoilt + must).cast("int"))).alias("pair"))


def fuzzy_lookup(queries: DataFrame, registry: DataFrame, key: str, name: str, least: float = LEAST, best: int = BEST) -> DataFrame:
    """(query, candidate, score, place): for each query (key, name) its ``best`` names of the registry (id, name) that score
    ``least`` or more, highest first, equal ones by id. Keys and ids are unique; blank names find nothing. Names of one form
    are compared once; of a form the registry's ``best`` least ids can be hits, the others never are."""
    asked = staged(queries.select(F.col(key).alias("query"), sorted_words(F.col(name)).alias("form")).filter("form <> ''"), "queries")
    known = registry.select(F.col("id").alias("candidate"), sorted_words(F.col("name")).alias("form")).filter("form <> ''")
    nearest = F.row_number().over(Window.partitionBy("form").orderBy("candidate"))
    known = staged(known.withColumn("_n", nearest).filter(F.col("_n") <= best).drop("_n"), "registry")
    ours, theirs = staged(_forms(asked), "forms"), staged(_forms(known), "forms")
    frequency = staged(theirs.select(F.explode(pairs_of(F.col("form"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = _rarest(ours, frequency, least).select(F.col("form").alias("_x"), F.col("length").alias("_a"), F.col("must").alias("_must_a"), "pair")
    b = _rarest(theirs, frequency, least).select(F.col("form").alias("_y"), F.col("length").alias("_b"), F.col("must").alias("_must_b"), "pair")
    near = F.least("_a", "_b") * 200.0 >= (F.col("_a") + F.col("_b")) * least - 1e-6
    shared = a.join(b, "pair").filter(near).groupBy("_x", "_y").agg(F.count("*").alias("_n"), F.min(F.least("_must_a", "_must_b")).alias("_must"))
    scored = shared.filter("_n >= _must").select("_x", "_y").withColumn("score", token_sort_ratio("_x", "_y")).filter(F.col("score") >= least)
    place = lambda part: F.row_number().over(Window.partitionBy(part).orderBy(F.desc("score"), "candidate"))
    hits = scored.join(known, F.col("_y") == F.col("form")).drop("form").withColumn("place", place("_x")).filter(F.col("place") <= best)
    hits = staged(hits.select("_x", "candidate", "score", "place"), "hits")
    return asked.join(hits, F.col("form") == F.col("_x")).select("query", "candidate", "score", "place")
