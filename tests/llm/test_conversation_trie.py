"""The trie of rebuilt conversations against plain Python, whatever the bands, and the defined cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomery.llm import conversation_trie as ct
from loomery.llm import queries
from tests.compare import assert_same

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_nodes(rows, rebuilt=True):
    """Nodes of the trie, by sets of whole turn sequences."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[3] for x in sorted(t, key=lambda x: x[:3])] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        base = own.get(c - c % 20, []) if c >= 0 else own.get(c + -c % 20, [])
        made[c] = tuple(base[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * words
            leaves[n[:d]] += not children[n]
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def rows_of(df):
    key = lambda r: (r[0], r[1])
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=key)


def made_rows(seed, longest=9, n=60):
    """Conversations from few turns, so that many share a beginning; ids of families of 20."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-40, 400), n):
        for t in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f", "", None])))
    return rows


@pytest.mark.parametrize(("band", "hot"), [(32, 10_000), (2, 2), (3, 1)])
def test_rebuilt_trie_equals_plain_python(spark, band, hot):
    rows = made_rows(band, longest=30)
    got = rows_of(ct.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), band, hot))
    assert got == plain_nodes(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = made_rows(5)
    assert rows_of(ct.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_nodes(rows, rebuilt=False)


def test_one_conversation_longer_than_three_levels_of_bands(spark):
    rows = [(c, t, "user", f"turn {t}" if c == 0 or t < 40 else "x") for c in (0, 60) for t in range(100)]
    got = rows_of(ct.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), band=4))
    assert got == plain_nodes(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "b"), (1, 3, "user", "long " * 20_000), (1, 3, "user", "a"), (1, 3, "user", "a"),  # nulls, ties, repeats
        (0, 1, "user", "only"), (45, 0, "user", "no base"), (19, 0, "u", "ser"), (18, 0, "us", "er"), (None, 0, "user", "nobody's"), (-3, 1, "user", "negative"),
    ]
    assert rows_of(ct.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == plain_nodes(rows)


def test_empty_table_and_clashing_columns(spark):
    assert rows_of(ct.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = made_rows(6)
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("pos", "digest", "words", "parent", "depth", "first", "ids", "paths")})
    assert rows_of(ct.rebuilt_trie(more)) == plain_nodes(rows)


def test_hot_ends_are_hashed_in_slices(spark):
    ends = spark.range(3000).select(F.lit(b"x").alias("digest"), (F.col("id") * 7).alias("conv_id"))
    got = ct.end_hashes(ends, size=64).collect()
    want = hashlib.sha256(",".join(str(7 * k) for k in range(3000)).encode()).hexdigest()
    assert [(bytes(r["digest"]), r["ends_sha256"]) for r in got] == [(b"x", want)]


def test_query_equals_sql(spark):
    assert_same(spark, queries.QUERIES["op13_conversation_trie"], queries.ORACLE_SQL["op13_conversation_trie"], "/root/testdata/sf0.001")
