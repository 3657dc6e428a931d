"""Base spans against the patterns themselves, the random field against enumeration, and what it adds."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomery.llm import pii
from loomery.llm.semi_markov import Lattice, SemiMarkov

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id long, text string"


def plain_luhn(digits):
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    """(kind, start, end) of the patterns' matches that pass their check."""
    ok = {
        "email": lambda s, d: True, "ip": lambda s, d: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s, d: 16 <= len(d) <= 19 and plain_luhn(d), "phone": lambda s, d: 8 <= len(d) <= 15,
    }
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m[0], re.sub("[^0-9]", "", m[0]))]


def odd_text(rng):
    pieces = ["4111111111111111", "5500 0000 0000 0004", "+1 ", "@", "a.b", "1.2.3.4", "999.1.1.1", ".", "-", " ", "255", "x", "(", ") ", "+49 30 1234567", "jane@x.org", "é", "\n", "٣"]
    return "".join(rng.choice(pieces if rng.random() < 0.7 else "0123456789.-+@% ") for _ in range(rng.randint(0, 25)))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = odd_text(rng)
        got = pii.matches(text, [m.span() for m in pii._DIGITS.finditer(text)])[0]
        assert [(pii.KINDS[k], *s) for k, kept in enumerate(got) for s in kept] == plain_base(text), text


def paths_of(lattice, only_allowed=False):
    """All labellings as lists of (i, j, kind, arc)."""
    def go(t):
        if t == lattice.n:
            yield []
            return
        steps = [(t, t + 1, 0, None)] if not only_allowed or lattice.alone[t] else []
        steps += [(i, j, k, a) for a, (i, j, k, _) in enumerate(lattice.arcs) if i == t and (not only_allowed or lattice.allowed[a])]
        for step in steps:
            for rest in go(step[1]):
                yield [step, *rest]

    return list(go(0))


def path_score(field, lattice, path):
    kinds = [0, *(k for _, _, k, _ in path)]
    return sum(field.score(k, lattice.arcs[a][3]) for _, _, k, a in path if a is not None) + sum(field.between[x][y] for x, y in zip(kinds, kinds[1:]))


@pytest.mark.parametrize("seed", range(8))
def test_dynamic_programming_equals_enumeration(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    arcs = [(i, j, rng.randint(1, 2), [f"f{rng.randint(0, 5)}", "bias"]) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.7]
    arcs = list({a[:3]: a for a in arcs}.values())
    lattice = Lattice(n, arcs, [rng.random() < 0.6 for _ in arcs], [True] * n)
    field = SemiMarkov(2)
    for k in (1, 2):
        for f in ("bias", *(f"f{x}" for x in range(6))):
            field.weights[k, f] = rng.gauss(0, 2)
    field.between = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(3)]
    best = max(path_score(field, lattice, p) for p in paths_of(lattice))
    found = field.best(lattice)
    at = {(i, j, k): a for a, (i, j, k, _) in enumerate(arcs)}
    covered = {u for i, j, _ in found for u in range(i, j)}
    whole = sorted([(i, j, k, at[i, j, k]) for i, j, k in found] + [(u, u + 1, 0, None) for u in range(n) if u not in covered])
    assert math.isclose(path_score(field, lattice, whole), best)
    scores = [field.score(k, f) for _, _, k, f in arcs]
    for only in (False, True):
        z, chance, pairs = field.chances(lattice, scores, only)
        every = [(math.exp(path_score(field, lattice, p)), p) for p in paths_of(lattice, only)]
        total = sum(w for w, _ in every)
        assert math.isclose(z, math.log(total))
        for a in range(len(arcs)):
            assert math.isclose(chance[a], sum(w for w, p in every if a in [x[3] for x in p]) / total, abs_tol=1e-9)
        want = [[0.0] * 3 for _ in range(3)]
        for w, p in every:
            for x, y in zip([0, *(s[2] for s in p)], [s[2] for s in p]):
                want[x][y] += w / total
        assert all(math.isclose(pairs[x][y], want[x][y], abs_tol=1e-9) for x in range(3) for y in range(3))


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def spans_in(text, field):
    return [(pii.KINDS[k], text[a:b]) for k, kept in enumerate(pii.find_spans(text, field)[1]) for a, b in kept]


def test_spellings_that_the_patterns_miss_are_added(field):
    rng = random.Random(7)
    found = total = 0
    for n in range(300):
        d = "".join(rng.choice("0123456789") for _ in range(16))
        user, host = rng.choice(["jane.roe", "max", "li_wei22"]), rng.choice(["example.com", "mail.example.org", "firma.de"])
        kind, form = rng.choice([
            ("email", f"{user} (at) {host.replace('.', ' (dot) ')}"), ("email", f"{user}[at]{host}"), ("email", f"{user} at {host.replace('.', ' dot ')}"),
            ("phone", f"({d[:3]}) {d[3:6]}-{d[6:10]}"), ("phone", f"0049 {d[:2]} {d[2:9]}"), ("card", d), ("card", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"), ("ip", f"{int(d[:3]) % 256}[.]{int(d[3:5])}[.]{int(d[5:7])}[.]{int(d[7:9])}"),
        ])
        text = f"the onion {rng.choice(['of', 'tell', 'is', 'über'])} {form}{rng.choice([' and', ' ist', '. Then'])} more"
        total += 1
        found += (kind, form) in spans_in(text, field)
    assert found / total >= 0.95


def test_numbers_without_personal_data_are_left_alone(field):
    rng = random.Random(8)
    wrong = 0
    for n in range(300):
        d = "".join(rng.choice("123456789") for _ in range(14))
        form = rng.choice([f"20{d[:2]}-0{d[2]}-1{d[3]} 10:2{d[4]}:33", f"3.{d[:9]}", f"{d[:1]},{d[1:4]},{d[4:7]}", f"978-0-{d[:3]}-{d[3:8]}-{d[8]}", f"{d[:2]}.{d[2]}.20{d[3:5]}", f"0x{d[:4]}ab{d[4:12]}", "we meet at noon. Then", "at example.com", f"19{d[:2]} - 20{d[2:4]}"])
        wrong += spans_in(f"the onion of {form} and more", field) != []
    assert wrong / 300 <= 0.02


def test_rows_equal_the_same_work_in_plain_python(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = pii.find_personal_data(docs, field).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        added = sorted(s[1:] for s in set(spans) - set(base))
        assert r["n_added"] == len(added)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))
        assert not any(a < y and x < b for a, b in added for _, x, y in base)


def test_odd_rows(spark, field):
    long = "word " * 300_000 + "jane@example.com " + "1" * 500_000 + " é 10.0.0.1" + " 12" * 20_000
    rows = [(None, "mail a@b.c"), (1, None), (1, ""), (1, "mail a@b.c"), (2, long), (3, "@" * 50_000), (4, "a@" * 20_000), (5, "+1" * 20_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("spans", "n_email", "kind", "a", "b", "_n")})
    for r in pii.find_personal_data(docs, field).collect():
        if r["n_ip"]:
            at = long.index("jane")
            assert r["doc_id"] == 2 and r["n_email"] == 1 and f"email:{at}:{at + 16}" in r["spans"].split(",")
        elif r["n_email"]:
            assert r["spans"] == "email:5:10" and r["doc_id"] in (None, 1)
        else:
            assert r["doc_id"] in (1, 3, 4, 5) and r["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(spark.createDataFrame([], SCHEMA)).collect() == []


def test_training_is_repeatable(spark):
    docs = spark.createDataFrame([(k, f"text {k} mail u{k}@example.com or +1 (411) 555-0{k:03d} and 4111 1111 1111 1111") for k in range(30)], SCHEMA)
    a, b = pii.train(docs, 2), pii.train(docs.repartition(5), 2)
    assert dict(a.weights) == dict(b.weights) and a.between == b.between
