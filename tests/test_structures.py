"""Chains, positions, assignment, fuzzy lookup and links against plain Python."""

import random
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from loomery.functions import urls
from loomery.functions.similarity import token_sort_of
from loomery.operators import assignment, fuzzy, graph, invariance
from loomery.plans import structures


def plain_end(to, node):
    path = []
    while node in to and node not in path:
        path.append(node)
        node = to[node]
    return (min(path[path.index(node) :]), None, True) if node in path else (node, len(path), False)


def test_chains_equal_following_each_pointer(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(400)) for k in range(300)] + [(k, k - 1) for k in range(1001, 2001)] + [(5000, 5000), (5001, 5000), (6000, None), (None, 1), (7, 900), (7, 3)]
    to = {}
    for a, b in rows:
        if a is not None and b is not None:
            to[a] = min(b, to.get(a, b))
    got = {r["node"]: (r["last"], r["hops"], r["cycle"]) for r in graph.chains(spark.createDataFrame(rows, "node long, target long")).collect()}
    assert got == {a: plain_end(to, a) for a in to}
    assert got[2000] == (1000, 1000, False) and got[5001] == (5000, None, True)
    assert graph.chains(spark.createDataFrame([], "node long, target long")).collect() == []


def test_positions_are_dense_and_need_no_single_partition(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    placed = invariance.with_positions(df, ["k"])
    rows = sorted((r["position"], r["k"]) for r in placed.collect())
    assert [p for p, _ in rows] == list(range(5000)) and [k for _, k in rows] == sorted(k for _, k in rows)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_differences_of_runs(spark):
    schema = "k int, name string, value string, prov string"
    before = [(1, "a", "x", "p"), (2, "b", "y", None), (3, "c", None, "q"), (4, "d", "z", "q")]
    after = [(1, " a ", "x", "p"), (2, "b", "Y", "p"), (3, "e", "other", "q"), (4, "d", " z", "r"), (5, "f", "n", "q")]
    found, mapping, verdict = invariance.compare_runs(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ["k"], "name", ["value"], ["prov"])
    assert sorted(map(tuple, found.collect())) == [(1, "value", "y", "Y"), (2, "name", "c", "e"), (4, "missing", None, "f")]
    assert {tuple(r) for r in mapping.collect()} == {("prov", "p", "p", 1), ("prov", None, "p", 1), ("prov", "q", "q", 1), ("prov", "q", "r", 1)}
    assert tuple(verdict.first()) == (4, 3, 3, False)


def plain_assignment(signatures, verdicts):
    """The pass in order: block -> entities with their kind."""
    said = {}
    for block, a, b, decision in verdicts:
        if a < b and decision.lower() in ("match", "uncertain"):
            said[block, a, b] = min(decision.lower(), said.get((block, a, b), "z"))
    held, out = {}, {}
    for block, idx, kind in sorted(signatures):
        first = next((a for a, k in held.setdefault(block, []) if k == kind and (block, a, idx) in said), None)
        decision = said.get((block, first, idx))
        if decision == "match":
            out[block, idx] = (first, False)
        else:
            held[block].append((idx, kind))
            out[block, idx] = (idx, decision == "uncertain")
    return out


def test_assignment_equals_the_sequential_pass(spark):
    rng = random.Random(2)
    signatures = [("big", k, k % 4 == 0) for k in range(5000)] + [(f"b{n}", k, rng.random() < 0.5) for n in range(40) for k in range(rng.randint(1, 12))]
    blocks = {}
    for block, k, _ in signatures:
        blocks.setdefault(block, []).append(k)
    verdicts = [(block, rng.choice(ks), rng.choice(ks), rng.choice(["match", "MATCH", "distinct", "new", "uncertain"])) for block, ks in blocks.items() for _ in range(3 * len(ks))]
    got = assignment.assign_entities(spark.createDataFrame(signatures, "block_id string, idx int, has_name2 boolean"), spark.createDataFrame(verdicts, "block_id string, a int, b int, decision string"))
    assert {(r["block_id"], r["idx"]): (r["entity"], r["uncertain"]) for r in got.collect()} == plain_assignment(signatures, verdicts)


def test_fuzzy_lookup_equals_a_full_comparison(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    registry = [(f"r{k}", " ".join(rng.choice([*stems, "university", "of"]) for _ in range(rng.randint(1, 4)))) for k in range(400)]
    registry += [("x1", ""), ("x2", None), ("x3", "a"), ("x4", "of of of of"), ("x5", "aaaaaaaaaaaaaaaaaaaa")]
    queries = []
    for k in range(250):
        name = list(rng.choice(registry[:400])[1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(name) + 1)
            name[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        queries.append((k, "".join(name).upper() if k % 2 else " ".join(reversed("".join(name).split(" ")))))
    queries += [(900, None), (901, " "), (902, "A"), (903, "of of of"), (904, "aaaaaaaaaaaaaaaaaaaaa")]
    got = fuzzy.fuzzy_lookup(spark.createDataFrame(queries, "key int, q string"), spark.createDataFrame(registry, "id string, name string"), "key", "q")
    flat = lambda x: " ".join((x or "").lower().split())
    want = set()
    for key, q in queries:
        scored = sorted((-token_sort_of(flat(q), flat(n)), i) for i, n in registry if flat(q) and flat(n))
        want |= {(key, i, round(-s, 6), place) for place, (s, i) in enumerate([x for x in scored if x[0] <= -88][:5], 1)}
    assert {(r["query"], r["candidate"], round(r["score"], 6), r["place"]) for r in got.collect()} == want
    assert len(want) > 200


def test_mistyped_parts_equal_a_full_comparison(spark):
    rows = structures.registry_fuzzy(spark, "/root/testdata/sf0.001").collect()
    parts = {r["p_partkey"]: f"{r['p_name']} {r['p_brand']}".lower() for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    typed = {k: (n[: k % 7 + 2] + n[k % 7 + 3 :] if k % 3 == 0 else n[: k % 7 + 2] + n[k % 7 + 1 :] if k % 3 == 1 else " ".join(reversed(n.split(" ")))) for k, n in parts.items()}
    want = {}
    for k, n in typed.items():
        scored = sorted((-token_sort_of(n, m), i) for i, m in parts.items())
        want |= {(k, place): (i, round(-s, 6)) for place, (s, i) in enumerate([x for x in scored if x[0] <= -88][:5], 1)}
    assert {(r["query"], r["place"]): (r["candidate"], round(r["score"], 6)) for r in rows} == want


def test_references_resolve_as_in_the_standard_library(spark):
    bases = ["http://a/b/c/d?q", "https://www.Example.org", "http://x.org/", "https://x.org/a/b.html", "http://x.org/a/b/?k=v#frag"]
    refs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "a/b/c/../../d", "HTTPS://Other.net/z?a=b#c", "g?y/./x", "g#s/../x", " g "]
    rows = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()
    for row in got:
        assert row["u"] == urldefrag(urljoin(row["b"], row["r"].strip())).url, row
    dots = spark.createDataFrame([("http://a/b", "http://other.net/x/../y")], "b string, r string")  # by the standard; the library leaves these
    assert dots.select(urls.resolve(F.col("b"), F.col("r"))).first()[0] == "http://other.net/y"
    none = spark.createDataFrame([("http://a/b", r) for r in ("mailto:x@y.z", "javascript:void(0)", "tel:+1", "data:text/plain,x", None)], "b string, r string")
    assert none.filter(urls.resolve(F.col("b"), F.col("r")).isNotNull()).count() == 0


def test_page_links_resolve_against_their_page(spark):
    rows = structures.page_links(spark, "/root/testdata/sf0.001")
    assert rows.filter("link not like 'http%'").count() == 0
    html = '<a href="/x">1</a><A class=k HREF=\'../y?z#f\'>2</A><a data-href="no" href=z.html>3</a><link href="/css"><a name="n">'
    got = spark.createDataFrame([(html,)], "h string").select(F.regexp_extract_all("h", F.lit(structures.HREF), F.lit(1)).alias("x")).first().x
    assert got == ["/x", "../y?z#f", "z.html"]
