"""Batch consensus: organisation fields agreed inside (address block, name, legal form) groups.

Everything is windows over the group, computed on the values before any write,
so there is no order of writes. Address fields and departments never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.functions.similarity import token_sort_ratio
from loomery.operators.dedup import block_id, normalize_key
from loomery.sources.scratch import staged

PROPAGATED = ["name1_enriched", "ror_id", "lei_id", "domain", "website_url", "record_type"]
LEGAL_SPELLINGS = [(r"\bincorporated\b", "inc"), (r"\bcorporation\b", "corp"), (r"\bcompany\b", "co"), (r"\blimited\b", "ltd")]


def address_block(df: DataFrame, key=normalize_key) -> Column:
    """Null where neither street nor postal code says anything."""
    none = tx.blank(F.col("street_cleaned")) & tx.blank(F.col("postal_code"))
    return F.when(~none, block_id(F.col("country"), F.col("postal_code"), F.col("street_cleaned"), F.col("house_number"), key=key))


def name_parts(name: Column, key=normalize_key) -> Column:
    """struct(base, form): the folded name without its legal form, and that form."""
    folded = tx.clean_whitespace(tx.replace_all(key(name), LEGAL_SPELLINGS, ""))
    base = tx.strip_legal_suffix(folded)
    return F.struct(base.alias("base"), F.trim(F.substring(folded, F.length(base) + 1, F.length(folded))).alias("form"))


def consensus_groups(df: DataFrame, key=normalize_key) -> DataFrame:
    """Adds group_id: block, base and form. Where a block holds several forms of
    one base, rows without a form stay alone; null where a row can't group."""
    out = df.withColumns({"_block": address_block(df, key), "_parts": name_parts(F.col("name1_enriched"), key)})
    w = Window.partitionBy("_block", "_parts.base")
    forms = F.size(F.collect_set(F.when(F.col("_parts.form") != "", F.col("_parts.form"))).over(w))
    form = F.when(forms <= 1, F.lit("")).when(F.col("_parts.form") != "", F.col("_parts.form"))
    usable = F.col("_block").isNotNull() & (F.col("_parts.base") != "") & form.isNotNull()
    return out.withColumn("group_id", F.when(usable, F.concat_ws("|", "_block", "_parts.base", form))).drop("_block", "_parts")


def sole(c: str, w) -> Column:
    """The only distinct non-blank value in the window; null if there are none or several."""
    v = F.nullif(F.trim(c), F.lit(""))
    return F.when(F.min(v).over(w) == F.max(v).over(w), F.min(v).over(w))


def input_affinity(g: DataFrame) -> DataFrame:
    """(_group, _form, _affinity) of the most frequent spellings where a group has several: how close each is to all names
    that the group was supplied with (name1_original), as a sum of token-sort ratios."""
    forms = g.filter(~tx.blank(F.col("name1_enriched"))).groupBy("_g", "name1_enriched").agg(F.count("*").alias("n"))
    top = forms.withColumn("_most", F.max("n").over(Window.partitionBy("_g"))).filter("n = _most")
    tied = top.withColumn("_tied", F.count("*").over(Window.partitionBy("_g"))).filter("_tied > 1").select(F.col("_g").alias("_group"), F.col("name1_enriched").alias("_form"))
    supplied = staged(g.filter(~tx.blank(F.col("name1_original"))).groupBy("_g", "name1_original").agg(F.count("*").alias("_times")), "supplied")
    pairs = tied.join(supplied, F.col("_group") == F.col("_g"))
    scored = pairs.withColumn("_score", token_sort_ratio(F.lower("_form"), F.lower("name1_original")) * F.col("_times"))
    return scored.groupBy("_group", "_form").agg(F.rint(F.sum("_score")).alias("_affinity"))


def apply_consensus(df: DataFrame, key=normalize_key) -> DataFrame:
    """The rows of ``df`` with agreed fields, and consensus: registry, name_form, conflict or null.

    Needs _seq, tier_used and the propagated columns. A group of two or more
    with one registry identity takes the donor's fields (most ids, lowest tier,
    first); without any, the modal spelling of the name and what all members
    that say something agree on; with several identities nothing is written. Of
    spellings that are equally frequent the one closest to the supplied names (column
    name1_original, if there is one) is taken, then that of the lowest tier, then the first.
    """
    g = consensus_groups(df, key)
    lone = F.concat(F.lit("row|"), F.col("_seq").cast("string"))
    g = g.withColumn("_g", F.coalesce("group_id", lone))
    w = Window.partitionBy("_g")
    several = lambda c: F.coalesce(F.min(F.nullif(F.col(c), F.lit(""))).over(w) != F.max(F.nullif(F.col(c), F.lit(""))).over(w), F.lit(False))
    ids = F.col("ror_id").isNotNull().cast("int") + F.col("lei_id").isNotNull().cast("int")
    g = g.withColumns({"_members": F.count("*").over(w), "_conflict": several("ror_id") | several("lei_id"), "_ids": ids})
    rank = F.struct((-F.col("_ids")).alias("a"), F.coalesce("tier_used", F.lit(3)).alias("b"), F.col("_seq").alias("c"))
    donor = lambda c: F.min(F.when(F.col("_ids") > 0, F.struct(rank.alias("r"), F.col(c).alias("v")))).over(w)["v"]
    form = Window.partitionBy("_g", "name1_enriched")
    g = g.withColumns({"_forms": F.when(~tx.blank(F.col("name1_enriched")), F.count("*").over(form)), "_tier": F.min(F.coalesce("tier_used", F.lit(3))).over(form), "_first": F.min("_seq").over(form), "_affinity": F.lit(0.0)})
    if "name1_original" in df.columns:
        close = staged(input_affinity(g), "affinity")
        g = g.drop("_affinity").join(close, (F.col("_g") == F.col("_group")) & (F.col("name1_enriched") == F.col("_form")), "left").fillna(0.0, ["_affinity"]).drop("_group", "_form")
    modal = F.min(F.when(F.col("_forms").isNotNull(), F.struct((-F.col("_forms")).alias("a"), (-F.col("_affinity")).alias("b"), F.col("_tier").alias("c"), F.col("_first").alias("d"), F.col("name1_enriched").alias("v")))).over(w)["v"]
    registry = F.max("_ids").over(w) > 0
    known_type = F.when(F.col("record_type") != "unknown", F.col("record_type"))
    g = g.withColumn("_type", known_type)
    new = {
        "name1_enriched": F.when(registry, F.coalesce(donor("name1_enriched"), sole("name1_enriched", w))).otherwise(modal),
        "ror_id": F.max("ror_id").over(w), "lei_id": F.max("lei_id").over(w),
        "domain": F.coalesce(F.when(registry, donor("domain")), sole("domain", w)),
        "website_url": F.when(F.when(registry, donor("domain")).isNotNull(), donor("website_url")).otherwise(F.min(F.when(F.col("domain") == sole("domain", w), F.struct("_seq", "website_url"))).over(w)["website_url"]),
        "record_type": F.coalesce(F.when(registry, donor("_type")), sole("_type", w)),
    }
    g = g.withColumns({f"_new_{c}": v for c, v in new.items()}).withColumn("_registry", registry)
    writes = (F.col("_members") >= 2) & ~F.col("_conflict")
    g = g.withColumn("consensus", F.when(F.col("_members") < 2, F.lit(None)).when(F.col("_conflict"), "conflict").when(F.col("_registry"), "registry").otherwise("name_form"))
    g = g.withColumns({c: F.when(writes, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) for c in PROPAGATED})
    return g.select(*df.columns, "group_id", "consensus")
