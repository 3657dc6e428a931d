"""Chains, positional comparison, first-match assignment, fuzzy lookup and links on the provided tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import coverage, urls
from loomery.operators import assignment, enrich, fuzzy, graph, invariance


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def redirect_chains(spark, sf_dir):
    """Orders point to the one before within a thousand; every third thousand turns in a circle of ten."""
    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(k.alias("node"), F.when(k % 1000 > 0, k - 1).when(F.floor(k / 1000) % 3 == 0, k + 9).alias("target"))
    return graph.chains(rows)


def run_invariance(spark, sf_dir):
    """What differs between two runs over the orders, by position."""
    k = F.col("o_orderkey")
    before = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    after = before.withColumns({"o_orderstatus": F.when(k % 7 == 0, "X").when(k % 3 == 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k % 29 > 0, F.col("o_orderpriority")), "o_custkey": F.col("o_custkey") + (k % 31 == 0).cast("int")})
    return invariance.compare_runs(before, after, ["o_orderkey"], "o_custkey", ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"])[0]


def mode_b_clusters(spark, sf_dir):
    """Customers of a nation in order, with verdicts on the five before each."""
    k = F.col("c_custkey")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(k))
    s = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block_id"), place.alias("idx"), (k % 3 == 0).alias("has_name2"))
    a, b = F.col("a"), F.col("idx")
    pairs = s.select("block_id", "idx", F.explode(F.sequence(F.greatest(b - 5, F.lit(1)), b)).alias("a"))
    verdicts = pairs.select("block_id", "a", b.alias("b"), F.when((a * 7 + b * 3) % 5 == 0, "Match").when((a * 7 + b * 3) % 5 == 3, "uncertain").otherwise("distinct").alias("decision"))
    return assignment.assign_entities(s, verdicts)


def registry_fuzzy(spark, sf_dir):
    """Mistyped part names looked up among all: words the other way round, a letter lost or doubled."""
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    k, n = F.col("id"), F.col("name")
    at = (k % 7 + 2).cast("int")
    wrong = F.when(k % 3 == 0, F.concat(F.substring(n, F.lit(1), at), F.substring(n, at + 2, F.length(n)))).when(k % 3 == 1, F.concat(F.substring(n, F.lit(1), at), F.substring(n, at, F.length(n)))).otherwise(F.upper(F.array_join(F.reverse(F.split(n, " ")), "  ")))
    return fuzzy.fuzzy_lookup(p.select("id", wrong.alias("name")), p, "id", "name")


#: Addresses in the anchors of a page.
HREF = r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']?([^\"'\s>]+)"


def page_links(spark, sf_dir):
    """page_id, place, link of all outgoing links of a page, resolved."""
    found = _read(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("place", "href"))
    return found.select("page_id", "place", urls.resolve(F.col("url"), F.col("href")).alias("link")).filter("link is not null")


def host_coverage(spark, sf_dir):
    """How part names, called services, cover host labels that were made of their words in seven ways."""
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    first, second = F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit("x"))
    label = F.element_at(F.array(F.concat(first, second), F.concat(F.substring(first, 1, 3), second), F.concat(first, F.lit("llc")), F.concat(second, first), F.concat(first, F.lit("xq")), F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""), F.concat(first, F.lit("svc"))), (k % 7 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", coverage.host_coverage(F.concat(label, F.lit(".example.org")), F.concat("p_name", F.lit(" Services"))).alias("covered"))


def acronym_slots(spark, sf_dir):
    """Initials and other letters aligned with part names."""
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    short = F.when(k % 3 < 2, F.upper(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "."))).otherwise("ZQ")
    a = coverage.acronym_slots(short, F.when(k % 3 == 1, F.concat(F.lit("The "), "p_name")).otherwise(F.col("p_name")))
    return _read(spark, sf_dir, "part").select("p_partkey", a["kind"].alias("kind"), F.array_join(F.transform(a["slots"], lambda x: x.cast("string")), ",").alias("slots"))


def search_terms(spark, sf_dir):
    """Terms of parts as institutions with units, in eight shapes of either."""
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    first, second = F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit("quartz"))
    c = k % 8
    of = lambda *x: F.element_at(F.array(*(v if hasattr(v, "alias") else F.lit(v).cast("string") for v in x)), (c + 1).cast("int"))
    none = F.lit(None).cast("string")
    name = F.concat(F.initcap(first), F.lit(" "), F.initcap(second))
    df = _read(spark, sf_dir, "part").select(
        "p_partkey", F.when(c == 4, F.concat(F.initcap(first), F.lit(" & "), F.initcap(second), F.lit(" Texas Group Ltd."))).when(c == 0, F.concat(F.lit("The "), name, F.lit(" GmbH"))).otherwise(name).alias("name_1"),
        of(none, F.concat(first, F.lit(".ac.uk")), "x.org", F.concat(second, F.lit(".example.com")), none, "x.org", "x.org", "x.org").alias("domain"), of(none, none, F.upper(F.concat(F.substring(first, 1, 1), F.substring(second, 1, 1))), "ZQZ", none, none, none, none).alias("ror_acronym"),
        of(F.concat(F.lit("Department of "), F.initcap(first)), "Accounts Payable", F.concat(name, F.lit(" Team (ABC)")), "Main Campus Austin", F.concat(F.lit("University of "), F.initcap(first)), "Chemistry Dept", "Applied Blue Chemistry", none).alias("name_2"),
        of(none, none, none, none, none, "chem.x.org", "www.abc.x.org", "https://web.law.x.org/en").alias("department_domain"), F.lit("Austin").alias("city"), F.lit("TX").alias("region"), F.lit("US").alias("country"))
    return enrich.search_terms(df).select("p_partkey", "search_term_1", "search_term_2")


QUERIES = {f.__name__: f for f in (redirect_chains, run_invariance, mode_b_clusters, registry_fuzzy, page_links, host_coverage, acronym_slots, search_terms)}
ORACLE_SQL = {
    "redirect_chains": """
WITH k AS (SELECT o_orderkey node, o_orderkey // 1000 * 1000 base FROM orders),
c AS (SELECT *, (base // 1000) % 3 = 0 AND base IN (SELECT node FROM k) AS cycle FROM k)
SELECT node, base AS last, CASE WHEN NOT cycle THEN node - base END hops, cycle FROM c WHERE cycle OR node > base""",
    "run_invariance": """
WITH b AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey k FROM orders),
d AS (SELECT position, CASE WHEN k % 31 = 0 THEN [{'c': 'o_custkey', 'b': o_custkey::VARCHAR, 'a': (o_custkey + 1)::VARCHAR}] ELSE
  list_concat(CASE WHEN k % 7 = 0 AND o_orderstatus <> 'X' THEN [{'c': 'o_orderstatus', 'b': o_orderstatus, 'a': 'X'}] ELSE [] END, CASE WHEN k % 29 = 0 THEN [{'c': 'o_orderpriority', 'b': o_orderpriority, 'a': NULL}] ELSE [] END) END x FROM b)
SELECT position, u.c AS "column", u.b AS "before", u.a AS "after" FROM (SELECT position, unnest(x) u FROM d)""",
    "mode_b_clusters": """
WITH RECURSIVE s AS (SELECT c_nationkey block_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT idx, c_custkey % 3 = 0 h FROM customer),
f AS (
  SELECT block_id, 1 AS idx, 1 AS entity, false AS uncertain, [{'i': 1, 'h': h}] AS held FROM s WHERE idx = 1
  UNION ALL
  SELECT block_id, idx, CASE WHEN first IS NOT NULL AND (first * 7 + idx * 3) % 5 = 0 THEN first ELSE idx END, coalesce((first * 7 + idx * 3) % 5 = 3, false),
    CASE WHEN first IS NOT NULL AND (first * 7 + idx * 3) % 5 = 0 THEN held ELSE list_append(held, {'i': idx, 'h': h}) END
  FROM (SELECT s.block_id, s.idx, s.h, f.held, list_filter(f.held, lambda x: s.idx - x.i <= 5 AND x.h = s.h AND (x.i * 7 + s.idx * 3) % 5 IN (0, 3))[1].i AS first FROM f JOIN s ON s.block_id = f.block_id AND s.idx = f.idx + 1))
SELECT block_id, idx, entity, uncertain FROM f""",
    "acronym_slots": """
WITH p AS (SELECT *, len(string_split(p_name, ' ')) n FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 AND n > 1 THEN 'initials' END kind, CASE WHEN p_partkey % 3 < 2 AND n > 1 THEN array_to_string(list_transform(range(n), lambda x: x + p_partkey % 3), ',') END slots FROM p""",
    "host_coverage": f"""
WITH RECURSIVE p AS (SELECT p_partkey k, string_split(p_name, ' ') w, p_partkey % 7 c FROM part),
l AS (SELECT k, list_append(w, 'services') w, CASE c WHEN 0 THEN w[1] || coalesce(w[2], 'x') WHEN 1 THEN left(w[1], 3) || coalesce(w[2], 'x') WHEN 2 THEN w[1] || 'llc' WHEN 3 THEN coalesce(w[2], 'x') || w[1] WHEN 4 THEN w[1] || 'xq' WHEN 5 THEN array_to_string(list_transform(w, lambda x: x[1]), '') ELSE w[1] || 'svc' END label FROM p),
t AS (SELECT k, unnest(w) word, generate_subscripts(w, 1) i FROM l),
f AS (SELECT k, i, word f, false short FROM t UNION SELECT k, i, '', false FROM t UNION SELECT k, i, left(word, n::INT), false FROM t, range(3, 30) r(n) WHERE length(word) >= 5 AND n < length(word)
  UNION SELECT k, i, unnest(['svcs', 'svc', 'serv']), false FROM t WHERE word = 'services' UNION SELECT k, i, word[1], true FROM t),
r AS (
  SELECT l.k, m.short, 0::BIGINT i, 0::BIGINT pos FROM l, (VALUES (false), (true)) m(short)
  UNION SELECT r.k, r.short, r.i + 1, r.pos + length(f.f) FROM r JOIN l ON l.k = r.k JOIN f ON f.k = r.k AND f.i = r.i + 1 AND (r.short OR NOT f.short) AND starts_with(substr(label, r.pos + 1), f.f)),
z AS (
  SELECT r.k, r.short, r.pos FROM r JOIN l ON l.k = r.k WHERE r.i = len(l.w) AND r.pos > 0
  UNION SELECT z.k, z.short, z.pos + length(e) FROM z JOIN l ON l.k = z.k, (SELECT unnest({coverage.LEGAL_ENDS}) e) WHERE starts_with(substr(label, z.pos + 1), e)),
d AS (SELECT z.k, bool_or(NOT short) plain FROM z JOIN l ON l.k = z.k WHERE pos = length(label) GROUP BY 1)
SELECT l.k p_partkey, CASE WHEN plain THEN 'words' WHEN plain IS NOT NULL THEN 'initials' END covered FROM l LEFT JOIN d ON d.k = l.k""",
    "search_terms": """
WITH p AS (SELECT p_partkey, p_partkey % 8 c, string_split(p_name, ' ')[1] a, coalesce(string_split(p_name, ' ')[2], 'quartz') b FROM part)
SELECT p_partkey, upper(CASE c WHEN 1 THEN a WHEN 2 THEN left(a, 1) || left(b, 1) WHEN 3 THEN b || '.example' WHEN 4 THEN a || ' & ' || b WHEN 0 THEN a || ' ' || b ELSE 'x' END) search_term_1,
  upper(CASE c WHEN 0 THEN a WHEN 1 THEN 'admin' WHEN 2 THEN 'abc' WHEN 5 THEN 'chemistry' WHEN 6 THEN 'abc' WHEN 7 THEN 'law' END) search_term_2 FROM p""",
}
