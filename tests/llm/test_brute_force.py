"""Operators that SQL can't express against plain Python over whole tables."""

import hashlib
import itertools
import re
import sys
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomery.llm import exact_dedup, kernels, lm_score, media, mixing, near_dup, packing, pieces, queries, range_coder, token_counts, token_files, toxicity, transducers
from loomery.llm.range_coder import checksum, decode, encode

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def grams_of(text):
    # as the operator's words: runs of ASCII letters and digits and of other than ASCII characters
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near_classes_by_hand(texts):
    sets = {i: grams_of(t) for i, t in texts.items()}
    root, links = {i: i for i in texts}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in texts}


def near_copies(n=60):
    base = [f"w{k}" for k in range(120)]
    rng = np.random.default_rng(5)
    out = {0: " ".join(base)}
    for i in range(1, n):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            words[k] = f"t{rng.integers(1000)}"
        out[i] = " ".join(words)
    return out


def test_near_classes_of_the_table(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op1_near_dup(spark, SF).collect()}
    assert got == near_classes_by_hand(documents(spark))


@pytest.mark.parametrize("block", [256, 8])
def test_near_classes_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_classes(docs).collect()} == near_classes_by_hand(texts)


def test_banding_reaches_the_target():
    rng = np.random.default_rng(1)
    hit = 0
    for _ in range(400):
        shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (80, 10, 10))
        sigs = near_dup.band_hashes(np.concatenate([shared, a, shared, b]), np.array([0, 90, 180]))
        hit += bool((sigs[0] == sigs[1]).any())
    assert hit >= 396  # similarity 0.8


def test_fingerprints_combine():
    data = np.frombuffer(np.random.default_rng(2).bytes(200_000), np.uint8)
    whole = exact_dedup.fingerprint(data)
    assert whole == exact_dedup.fingerprint(data, 1000)
    assert whole == exact_dedup.combine(exact_dedup.fingerprint(data[:77_777]), exact_dedup.fingerprint(data[77_777:]))
    assert whole != exact_dedup.fingerprint(data[::-1])


def test_collisions_are_split(spark):
    """Dedup by a fingerprint that is nothing but the length, also in the workers:
    texts of one length collide and are told apart by the chunks."""
    long_ = ["x" * 70_000 + e for e in "abab"]
    texts = ["ab", "a b", "cd", "d c", "ef", None, " ", *long_]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_length = lambda flat: (len(flat), 0, 0)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, by_length).collect()}
    want = {}
    for i, t in enumerate(texts):
        same = [k for k, u in enumerate(texts) if re.sub(r"\s", "", u or "") == re.sub(r"\s", "", t or "")]
        keep = min(same, key=lambda k: (-len(texts[k] or ""), k))
        want[i] = (keep, len(same), i == keep)
    assert got == want
    assert exact_dedup.collisions(docs.select("text"), exact_dedup.fingerprints(docs, by_length)).count() == 2


def test_words_across_slices(monkeypatch):
    monkeypatch.setattr(kernels, "SLICE", 16)
    texts = ["alpha beta  gamma", "", "delta", "epsilon zeta eta theta iota kappa lambda", "é ü"]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = defaultdict(list)
    for rows, hashes in kernels.words(np.frombuffer(data, np.uint8), at):
        for r, h in zip(rows.tolist(), hashes.tolist(), strict=True):
            got[r].append(h)
    seen = {}
    for r, t in enumerate(texts):
        assert len(got[r]) == len(t.split())
        for w, h in zip(t.split(), got[r], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_token_counts(spark):
    docs = documents(spark)
    tk = token_counts.tokenizer(token_counts.TOKENIZER)
    n = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    for r in queries.op3_token_counts(spark, SF).collect():
        after = docs[r.doc_id]
        for a, b, new in reversed(token_counts.redactions(after)):
            after = after[:a] + new + after[b:]
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (n(docs[r.doc_id]), n(after), len(after))


def test_edits_at_every_place():
    text = "It's a  test,\n\n of x2 — don't   stop: " * 40
    for start, end, new in [(0, 0, "  "), (5, 5, " "), (700, 720, ""), (len(text), len(text), " 'll"), (512, 513, "'"), (0, len(text), ""), (3, 3, "word " * 2000)]:
        lengths = token_counts.cut_leaves(text)
        at = np.cumsum([0, *lengths])
        counts = token_counts.count_tokens([text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], token_counts.TOKENIZER)
        doc = token_counts.CountedText(text, lengths, token_counts.build_tree(counts), token_counts.TOKENIZER)
        doc.edit(start, end, new)
        assert doc.text == text[:start] + new + text[end:] and doc.n_tokens == token_counts.count_tokens([doc.text], token_counts.TOKENIZER)[0]
        assert sum(doc.lengths) == len(doc.text)


def test_many_edits_at_once():
    rng = np.random.default_rng(11)
    text = "It's a  test,\n\n of x2 — don't   stop: naïve  " * 200
    for n in (1, 5, 60):
        for _ in range(20):
            places = np.sort(rng.choice(len(text) + 50, 2 * n, replace=False)).reshape(-1, 2)
            edits = [(int(a), int(min(b, a + rng.integers(0, 1500))), str(rng.choice(["", " ", "x", " y ", "word " * 1500]))) for a, b in places]
            lengths = token_counts.cut_leaves(text)
            at = np.cumsum([0, *lengths])
            doc = token_counts.CountedText(text, lengths, token_counts.build_tree(token_counts.count_tokens([text[a:b] for a, b in itertools.pairwise(at)], token_counts.TOKENIZER)), token_counts.TOKENIZER)
            regions = doc.regions(edits)
            doc.update(regions, token_counts.count_tokens([r.text for r in regions], token_counts.TOKENIZER))
            want = text
            for a, b, new in reversed(edits):
                want = want[:a] + new + want[b:]
            assert doc.text == want and sum(doc.lengths) == len(want) and doc.n_tokens == token_counts.count_tokens([want], token_counts.TOKENIZER)[0]


def test_pieces_give_the_ids_of_whole_texts():
    rng = np.random.default_rng(12)
    signs = list("   \u3000\u00a0\u0085\x1c\n\tabé'.1ßsàの漢 '  ")
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(5000)] + ["x y" * 500_000, "漢" * 500_000 + " a b", ""]
    n, ids = pieces.PieceIds(token_counts.TOKENIZER).encode(pa.array([None, *texts]))
    want = [e.ids for e in pieces.tokenizer(token_counts.TOKENIZER).encode_batch_fast(["", *texts], add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("tables", [(1 << 20, 1 << 16, 500_000), (1 << 10, 1 << 8, 300)])
def test_lm_base_scores(spark, monkeypatch, tables):
    for k, v in zip(("FREQUENT", "CLUSTERED", "BUCKET_WORDS"), tables, strict=True):
        monkeypatch.setattr(lm_score, k, v)
    docs = documents(spark)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), None] for i, t in docs.items()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i in docs if i not in held for w in tokens[i])
    total, own, base = sum(c.values()) + 0.5 * (len(c) + 1), 0, 0
    for r in queries.op4_lm_score(spark, SF).collect():
        want = sum(np.log10((c[w] + 0.5) / total) for w in tokens[r.doc_id])
        assert r.base_score == pytest.approx(want) and r.n_tokens == len(tokens[r.doc_id]) and r.held_out == (r.doc_id in held)
        assert r.n_known == sum(c[w] > 0 for w in tokens[r.doc_id]) and r.train_tokens == sum(c.values())
        own, base = own + r.score * r.held_out, base + r.base_score * r.held_out
    assert own > base  # the class model predicts held-out texts better


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lm_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))


def lm_hash(words):
    data = " ".join(words).encode()
    (_, hashes, shapes), = kernels.shaped_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return dict(zip(words, zip(hashes.tolist(), shapes.tolist(), strict=True), strict=True))


def test_words_where_documents_touch():
    """Words end where a document ends, also if the next begins without a blank, empty ones between them."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        texts = ["".join(rng.choice(list("ab é\n."), rng.integers(0, 9))) for _ in range(rng.integers(1, 30))]
        want = [(k, w) for k, t in enumerate(texts) for w in lm_tokens(t)]
        own = lm_hash(list({w for _, w in want})) if want else {}
        found = [x for part in kernels.shaped_words(*kernels.utf8(pa.array(texts))) for x in zip(*map(np.ndarray.tolist, part), strict=True)]
        assert found == [(k, *own[w]) for k, w in want]


def test_many_documents_cost_what_one_does():
    """Cutting a megabyte into words takes little longer if it is a few hundred documents that touch."""
    data = np.frombuffer(("".join(f"w{k * k % 99991} " for k in range(200_000)))[: 1 << 20].encode(), np.uint8)
    taken = {}
    for step in (len(data), 3333):
        offsets = np.append(np.arange(0, len(data), step), len(data))
        for _ in range(7):
            begin = time.process_time()
            list(kernels.shaped_words(data, offsets))
            taken[step] = min(taken.get(step, 1e9), time.process_time() - begin)
    assert taken[3333] < 2 * taken[len(data)]


@pytest.mark.parametrize("tables", [(1 << 20, 1 << 16), (1 << 12, 1 << 8)])
def test_lm_scores_by_hand(spark, monkeypatch, tables):
    """Every score again in plain Python, from the classes that were learned."""
    for k, v in zip(("FREQUENT", "CLUSTERED"), tables, strict=True):
        monkeypatch.setattr(lm_score, k, v)
    docs = documents(spark)
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model, tail, _ = lm_score.train_model(table.filter("pmod(crc32(cast(doc_id as string)), 5) <> 1").select("text"))
    own = {w: (h, s) for w, (h, s) in lm_hash(list({w for t in docs.values() for w in lm_tokens(t)})).items()}
    counts = Counter(w for i in train for w in lm_tokens(docs[i]))
    core = dict(zip(model.core.hashes.tolist(), model.classes.tolist(), strict=True))
    chosen = {r["hash"] & (1 << 64) - 1: r["class"] for r in tail.collect()}
    assert all((own[w][0] in core) or ((chosen[own[w][0]] >= 0) == (c >= lm_score.LEAST)) for w, c in counts.items())  # every word seen often enough has a class
    by = lambda w: core.get(own[w][0], chosen.get(own[w][0], -1)) if counts[w] else -1
    emitted = {w: by(w) if by(w) >= 0 else lm_score.CLASSES + own[w][1] for w in own}
    context = {w: core.get(own[w][0], lm_score.CLASSES + own[w][1]) for w in own}
    moves = np.zeros((lm_score.ALL, lm_score.ALL))
    for i in train:
        words = lm_tokens(docs[i])
        for v, w in zip([None, *words], [*words, None], strict=True):
            moves[context[v] if v else lm_score.END, emitted[w] if w else lm_score.END] += 1
    assert (model.moves == moves).all()
    rates = moves.sum(axis=0) + 0.5
    p = (moves + rates / rates.sum()) / (moves.sum(axis=1, keepdims=True) + 1)
    assert np.allclose(p.sum(axis=1), 1)
    shape_words = Counter(emitted[w] for w in counts if emitted[w] >= lm_score.CLASSES)
    total = sum(counts.values()) + len(train) + 0.5 * (len(counts) + 2)
    gained = 0.0
    for r in queries.op4_lm_score(spark, SF).collect():
        want, words = 0.0, lm_tokens(docs[r.doc_id])
        for v, w in zip([None, *words], [*words, None], strict=True):
            k = emitted[w] if w else lm_score.END
            c = counts[w] if w else len(train)
            emit = 1.0 if not w else c / moves[:, k].sum() if k < lm_score.CLASSES else (c + 0.5) / (moves[:, k].sum() + 0.5 * (shape_words[k] + 1))
            want += np.log10(0.9 * p[context[v] if v else lm_score.END, k] * emit + 0.1 * (c + 0.5) / total)
        assert r.score == pytest.approx(want)
        gained += (r.score - r.base_score) * r.held_out
    assert gained > 0


def test_classes_of_a_bucket_in_bounded_memory():
    """Words that have met all classes: what a task holds doesn't grow with 4096 of them; classes are the best by hand."""
    rng = np.random.default_rng(12)
    n, codes = 3000, np.arange(lm_score.ALL) * lm_score.SHAPES
    hashes, moves = np.sort(rng.integers(0, 1 << 62, n)), rng.integers(1, 999, (lm_score.ALL, lm_score.ALL))
    times = rng.integers(1, 9, n * len(codes))
    lists = [pa.ListArray.from_arrays(pa.array([0, len(times)], pa.int32()), x) for x in (pa.array(np.repeat(hashes, len(codes))), pa.array(np.tile(codes, n).astype(np.int16)), pa.array(times.astype(np.int32)))]
    tracemalloc.start()
    found = lm_score._tail_classes(moves)(pa.table(lists, ["hashes", "codes", "times"])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    into = moves[:, : lm_score.CLASSES].astype(float)
    for k in range(0, n, 100):
        own = times.reshape(n, -1)[k][:, None]
        gain = (lm_score.xlogx(into + own) - lm_score.xlogx(into)).sum(axis=0) - lm_score.xlogx(into.sum(axis=0) + own.sum()) + lm_score.xlogx(into.sum(axis=0))
        assert (found[k]["hash"], found[k]["n"], found[k]["class"]) == (hashes[k], own.sum(), gain.argmax())


def test_exchange_raises_the_likelihood(spark):
    """Words of two kinds that alternate end in classes that tell them apart, and the
    class chosen for a word is the best of all by the likelihood itself."""
    rng = np.random.default_rng(9)
    moves = rng.integers(0, 50, (lm_score.ALL, lm_score.ALL)).astype(np.int64)
    before, after = rng.integers(0, 5, lm_score.ALL), np.zeros(lm_score.ALL, np.int64)
    after[:] = rng.permutation(before)
    moves[:, 3] += before
    moves[3] += after
    best = lm_score.best_class(3, before.astype(float), after.astype(float), moves)

    def moved(k):
        m = moves.copy()
        m[:, 3] -= before
        m[3] -= after
        m[:, k] += before
        m[k] += after
        return lm_score.likelihood(m)

    assert best == max(range(lm_score.CLASSES), key=moved)


def test_mix_meets_targets(spark):
    rows = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        assert r.copies * r.size <= 2 * r.size
        taken[r.source] += r.copies * r.size
        size[r.source] += r.size
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) < 0.12 * target[s] for s in target)


def test_water_filling_by_rounds(spark):
    sizes = {"a": 100.0, "b": 1000.0, "c": 30.0, "d": 400.0, None: 50.0, "e": 0.0}
    order = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
        free, left = free - over, left - sum(2 * sizes[s] for s in over)
    want |= share
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size double")).collect()}
    assert got == pytest.approx(want)


def padding(lengths, counts, ends):
    return sum(c * (max(lengths[b], 1) - x) for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True) for x, c in zip(lengths[a : b + 1], counts[a : b + 1], strict=True))


def test_best_buckets_by_all_choices():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths, counts = (np.sort(rng.choice(60, 8, replace=False)) + 1).tolist(), rng.integers(1, 9, 8).tolist()
        ends, cost = packing.best_buckets(lengths, counts, 3)
        assert cost == padding(lengths, counts, ends) == min(padding(lengths, counts, [*c, 7]) for n in range(3) for c in itertools.combinations(range(7), n))


def test_best_buckets_of_many_lengths():
    """Against the programme without the envelope, over a spread as wide as real texts'."""
    rng = np.random.default_rng(8)
    lengths = np.unique(np.concatenate(([0, 1], (rng.pareto(0.7, 400) * 30).astype(int) % 2_000_000)))
    counts = rng.integers(1, 1000, len(lengths))
    m, size = len(lengths), np.maximum(lengths, 1)
    n, t = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    for _ in range(16):
        best = np.array([best[0], *(min(best[j], (best[:j] + size[j - 1] * (n[j] - n[:j]) - (t[j] - t[:j])).min()) for j in range(1, m + 1))])
    ends, cost = packing.best_buckets(lengths.tolist(), counts.tolist(), 16)
    assert cost == best[m] == padding(lengths.tolist(), counts.tolist(), ends) and len(ends) <= 16


def test_padding_of_the_table(spark):
    """The packing's own padding is the least there is for the table's lengths."""
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), buckets=3).collect()
    cells = sorted(Counter(r.n_tokens for r in rows).items())
    lengths, counts = [x for x, _ in cells], [c for _, c in cells]
    least = min(padding(lengths, counts, [*c, len(cells) - 1]) for c in itertools.combinations(range(len(cells) - 1), 2))
    assert sum(r.bucket_length - r.n_tokens for r in rows) == least


def test_batches_fit(spark):
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), buckets=4, budget=3000).collect()
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_length
        batches[r.bucket, r.shard, r.batch].append(r)
    assert len(rows) == 200 and all(len(b) == b[0].batch_size and (len(b) == 1 or len(b) * b[0].bucket_length <= 3000) for b in batches.values())


def test_range_coder_round_trips():
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 65536, 300), np.zeros(0, np.int64), np.full(1000, 65535), np.zeros(4096, np.int64), rng.zipf(1.3, 2000) % 50257]
    coded = encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode(coded, list(map(len, blocks))), strict=True))
    assert len(coded[2]) < 200 and len(coded[3]) < 200 and len(coded[4]) < 2 * 2000
    assert encode([blocks[4]])[0] == coded[4]  # a block doesn't depend on the others


def test_order_0_tree_keeps_running_sums():
    """A step of the coder reads its nodes' sums and adds to them; they are those of the counts, halvings too."""
    ids = np.random.default_rng(6).zipf(1.2, 3000) % 3000
    model, coder = range_coder._Model(1), range_coder._Encoder(1, 3000)
    counts = {}
    for i in ids.tolist():
        model.literal(coder, np.zeros(1, np.int64), np.array([i]))
        node = 0
        for shift in (12, 8, 4, 0):
            own, nibble = counts.setdefault(node, [1] * 16), i >> shift & 15
            own[nibble] += range_coder.STEP
            if own[nibble] > range_coder.MOST:
                own[:] = [c + 1 >> 1 for c in own]
            node = node * 16 + nibble + 1
    assert all(model.tree[k].tolist() == list(itertools.accumulate(own)) for k, own in counts.items())
    assert sum(counts[0]) < len(ids) * range_coder.STEP  # some were halved


def test_coded_bytes_stay():
    """Files written before are read: the bytes of a block are those of the first format."""
    ids = np.random.default_rng(3).zipf(1.3, 4096) % 50257
    assert zlib.crc32(encode([ids])[0]) == 3745096573


def calls_made(run):
    """The calls that a run makes, those into numpy too."""
    made, ours = [0], sys.getprofile()
    sys.setprofile(lambda frame, event, arg: made.__setitem__(0, made[0] + (event in ("call", "c_call"))))
    try:
        found = run()
    finally:
        sys.setprofile(ours)
    return found, made[0]


def test_a_step_of_the_coder_is_few_calls():
    """Lanes share the calls of a step, whose cost is most of coding when there are too many of them."""
    blocks = list((np.random.default_rng(8).zipf(1.3, (64, 400)) % 50257).astype(np.uint16))
    coded, to_write = calls_made(lambda: encode(blocks))
    found, to_read = calls_made(lambda: decode(coded, [400] * 64))
    assert all((a == b).all() for a, b in zip(blocks, found, strict=True))
    assert to_write < 260 * 400 and to_read < 340 * 400, (to_write / 400, to_read / 400)


def test_uneven_blocks_are_coded_as_each_alone():
    rng = np.random.default_rng(9)
    blocks = [(rng.zipf(1.2, n) % 50257).astype(np.uint16) for n in (3, 0, 700, 1, 4096, 700, 0, 55)]
    coded = encode(blocks)
    assert coded == [encode([b])[0] for b in blocks]
    assert [b.tolist() for b in decode(coded, list(map(len, blocks)))] == [b.tolist() for b in blocks]


def test_token_files(spark):
    docs = documents(spark)
    tk = token_counts.tokenizer(token_counts.TOKENIZER)
    start, got = 0, {r.doc_id: r for r in queries.op8_token_files(spark, SF).collect()}
    for i in sorted(docs):
        ids = np.array([*tk.encode(docs[i], add_special_tokens=False).ids, 0])
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), checksum(ids))
        start += len(ids)


def test_damaged_token_file_is_found(spark):
    batch = token_files._segment(0, 0, [1], [np.arange(5000, dtype=np.uint16)])
    row = batch.to_pylist()[0]
    row["blocks"][1] = bytes([row["blocks"][1][0] ^ 1]) + row["blocks"][1][1:]
    with pytest.raises(ValueError, match="block 1"):
        list(token_files._decode(iter([pa.RecordBatch.from_pylist([row], batch.schema)])))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = Counter((truth[r.doc_id], r.predicted) for r in queries.op9_toxicity(spark, sf).filter("held_out").collect() if r.doc_id in truth)
    assert seen[1, 1] / (seen[1, 0] + seen[1, 1]) > 0.88 and seen[0, 1] / (seen[0, 0] + seen[0, 1]) < 0.01


def paths(machine, word):
    """All (weight, written, end) of a machine over a string of symbols, by enumeration."""
    found = [(0.0, (), machine.start)]
    for symbol in word:
        found = [(w + v, (*out, o), t) for w, out, s in found for o, v, t in machine.step(s, symbol)]
    return found


def test_composition_by_enumeration():
    rng = np.random.default_rng(13)
    signs = ["a", "b", "c", ""]
    for _ in range(30):
        machines = [transducers.Transducer(0, {(int(s), str(x)): [(str(rng.choice(signs)), float(rng.integers(-3, 4)), int(rng.integers(3))) for _ in range(rng.integers(1, 3))] for s in range(3) for x in rng.choice(signs, 2)}) for _ in range(2)]
        both = transducers.compose(*machines, signs)
        word = list(rng.choice(signs[:3], 4))
        want = Counter((w + v, out, (s, t)) for w, mid, s in paths(machines[0], word) for v, out, t in paths(machines[1], mid))
        assert Counter(paths(both, word)) == want
        heaviest = {}
        for w, _, end in want:
            heaviest[end] = max(w, heaviest.get(end, -1e9))
        assert both.best([[(x, 0.0)] for x in word]) == heaviest


def test_classes_by_rules():
    """The composed machine's class and weight of every clause of five symbols, against the rules in words."""
    for word in itertools.product(["insult", "harm", "intention", "target", "negation", "report"], repeat=5):
        ends = toxicity.MACHINE.best([[("insult", 2.0), ("", 0.0)] if x == "insult" else [(x, 0.0)] for x in word])
        taken = [(w, toxicity.class_of(s)) for s, w in ends.items() if toxicity.class_of(s) is not None]
        insults = [k for k, x in enumerate(word) if x == "insult"]
        threats = [k for k, x in enumerate(word) if x == "harm" and "intention" in word[:k]]
        marks = lambda k: ("negation" in word[:k]) | ("report" in word[:k]) << 1
        want = {(2.0 * (i is not None) + 3.0 * (t is not None), (0 if i is None else marks(i)) | (0 if t is None else marks(t)) | ("target" in word) << 2 | (t is not None) << 3) for i in [None, *insults] for t in [None, *threats] if i is not None or t is not None}
        assert max((w for w, _ in taken), default=0) == max((w for w, _ in want), default=0) and {x for x in taken if x[0] == max(taken)[0]} <= want


@pytest.mark.parametrize("sought", [200_000, 0])
def test_arcs_and_scores_by_hand(spark, monkeypatch, sought):
    """Every score of the table again, from arcs counted with plain Python."""
    monkeypatch.setattr(toxicity, "SOUGHT_ARCS", sought)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = documents(spark)
    rows = [(texts[i], t) for i, t in labels.items() if i in texts and t is not None and zlib.crc32(str(i).encode()) % 5]
    n, size, places, clean = Counter(), Counter(), defaultdict(set), Counter()
    in_rows = Counter()
    for text, t in rows:
        words = toxicity_words(text)
        n[t] += 1
        size[t] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
        arcs = {a for w in words for a in toxicity.arcs_of(w)}
        (in_rows if t else clean).update(arcs)
        if t:
            for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                for a in toxicity.arcs_of(w):
                    places[a].add(zlib.crc32(f"{before} {after}".encode()) & 63)
    prior = n[1] / (n[0] + n[1])
    seen = {a: min(c, round(64 * np.log(64 / (64 - len(places[a]))))) if len(places[a]) < 64 else c for a, c in in_rows.items() if c >= 3}
    seen = {a: k for a, k in seen.items() if k >= 3}
    ratio = {}
    for a, k in seen.items():
        c = clean[a]
        s = 2 * sum(x * np.log(x / ((k + c) * p)) for x, p in ((k, prior), (c, 1 - prior)) if x)
        rate = (c + 5) / size[0]
        if s >= 2 * np.log(max(len(seen), 2)) and k * n[0] > c * n[1] and k > rate * size[1]:
            ratio[a] = (k - rate * size[1]) / n[1] / rate
    got = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert got.arcs == pytest.approx(ratio)
    for r in queries.op9_toxicity(spark, SF).collect():
        text, matched, total = texts[r.doc_id].lower(), set(), 0.0
        for clause in re.split(r"[.!?;:,\n]", text):
            if (clause := clause.strip()) not in matched:
                matched.add(clause)
                m = got.match(toxicity_words(clause), len(toxicity_words(text)))
                total += m[1] * got.factor(m[0]) if m else 0.0
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(got.shift + got.slope * total, -40, 40))))


def toxicity_words(text):
    return re.findall(r"[a-z\u00c0-\u1fff\u2080-\u2fff\u3040-\U0010ffff]+", text.lower())


def test_grammar_reads_context():
    g = toxicity.Grammar({"idiot": 1e5, "lowe*": 1e5})
    plain, negated, quoted = (g.score(t) for t in ("you are an idiot", "you are not an idiot", "he said you are an idiot"))
    assert plain > quoted >= negated and plain > 0.9
    assert g.score("i will kill him") > g.score("kill the lights") == g.score("") == g.score(None)
    assert g.score("loweia here") > 0.9 and len(g.matches("idiot. idiot. idiot")) == 1


def test_media(spark):
    docs = documents(spark)
    for r in queries.op10_media(spark, SF).collect():
        b = docs[r.doc_id].encode()
        p = media.payload_of(b)
        assert len(p) % 192 == 0 and p[: len(b)] == b and not p[len(b) :].strip()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(p) + 44, hashlib.sha256(media.wav(p)).hexdigest())


def test_chunks_follow_content():
    rng = np.random.default_rng(6)
    body = rng.bytes(400_000)
    a, b = ({d for d, _ in media.chunks_of(x)} for x in (body, rng.bytes(777) + body))
    assert len(a & b) > 0.9 * len(a)
    assert b"".join(c for _, c in media.chunks_of(body)) == body
    assert max(len(c) for _, c in media.chunks_of(bytes(100_000))) <= media.MOST


def test_gear_window():
    data = np.frombuffer(np.random.default_rng(7).bytes(200), np.uint8)
    h = media.gear(data)
    want = sum(int(media._GEAR[data[150 - k]]) << k for k in range(32)) & 0xFFFFFFFF
    assert int(h[150]) == want


def test_pipeline_against_python(spark):
    """Stages two to four on the table, by hand: which documents are left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    grammar = toxicity.learn(docs, labels)
    left = {r.doc_id: r for r in docs.collect() if grammar.score(r.text) < 0.5}
    groups = defaultdict(list)
    for i, r in left.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", "", r.text or "")].append((-len(r.text or ""), i))
    left = {i: left[i] for g in groups.values() for _, i in [min(g)]}
    classes = near_classes_by_hand({i: r.text or "" for i, r in left.items()})
    left = {i: r for i, r in left.items() if classes[i][0] == i}
    out = docs
    for _, step in corpus_pipeline.STAGES[:3]:
        out = step(spark, out, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(left)
    mixed = Counter(r.doc_id for r in corpus_pipeline.mixing(spark, out, SF).collect())
    assert set(mixed) <= set(left) and max(mixed.values()) <= 2
