"""Personal data in texts: fixed patterns, and a semi-Markov random field that adds what they miss.

*Base spans* are the leftmost non-overlapping matches of four patterns (email,
ip, card, phone), less those that fail their check. They are found from a
text's digit runs, '@' and '+' signs in time linear in the text.

*Added spans*: the random field reads regions, which are chains of digit runs
with short gaps, and e-mail forms around an at-sign, written out or bracketed
too. A region's units are its digit runs, or the local part and the labels of a
domain. Candidate segments are whole runs of units, at most ``MOST_UNITS`` long
and with as many digits as the kind may have; features describe the whole
segment (digits, grouping, separators, Luhn sum, what stands before and
behind). Dynamic programming chooses boundaries and kinds jointly, per region.
Candidates that cross a base span are no candidates; base spans always stay.

The field is trained on the corpus: windows around base spans (the labels) and
around look-alikes without one, at most ``TRAIN_WINDOWS`` of each stratum from
about ``TRAIN_DOCS`` documents drawn by hash. A match that failed its check has
no label, so training leaves it free. Each labelled span is also shown in other
spellings (at-sign spelt out, no plus sign, other separators, a mistyped digit)
and with a number that is no personal data in its place. Only the weights
reach the tasks.

Defined cases: null is the empty text, which has no spans; equal texts have
equal spans; rows that repeat a doc_id are judged each by their text; a text of
any length is read whole; without base spans anywhere the built-in examples
alone train the field; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.kernels import text_slices
from loomery.llm.semi_markov import Lattice, SemiMarkov
from loomery.llm.shared import stage, text_of

#: Documents drawn for training at most (about), windows kept of each stratum, passes over them.
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS = 50_000, 250, 12
#: Times that spans of a kind are shown in other spellings, if there are fewer windows than that.
SHOWN = 200
#: Windows that a word beside a segment must stand in before it counts.
LEAST_WINDOWS = 5
#: Longest segment in units; characters between the units of one region; characters of context.
MOST_UNITS, LONGEST_GAP, CONTEXT = 8, 3, 24
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_DIGITS = re.compile(r"[0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def octet(run: str) -> bool:
    short = run.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _emails(text: str) -> list[Span]:
    found, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return found


def _chains(text: str, runs: list[Span], joins: str, most: int) -> Iterator[list[Span]]:
    """Runs that single characters of ``joins`` connect, at most ``most`` at a time."""
    chain: list[Span] = []
    for run in runs:
        if chain and (len(chain) == most or run[0] - chain[-1][1] != 1 or text[chain[-1][1]] not in joins):
            yield chain
            chain = []
        chain.append(run)
    if chain:
        yield chain


def matches(text: str, runs: list[Span]) -> tuple[list[list[Span]], list[Span]]:
    """Base spans of each kind, and the matches that failed their check."""
    kept: list[list[Span]] = [_emails(text) if "@" in text else [], [], [], []]
    failed: list[Span] = []
    if not runs:
        return kept, failed
    for chain in _chains(text, runs, ".", 4):
        if len(chain) == 4:
            (kept[IP] if all(octet(text[a:b]) for a, b in chain) else failed).append((chain[0][0], chain[-1][1]))
    for chain in _chains(text, runs, " -", len(runs)):
        n = sum(b - a for a, b in chain)
        if n > 6:
            ok = 16 <= n <= 19 and luhn("".join(text[a:b] for a, b in chain))
            (kept[CARD] if ok else failed).append((chain[0][0], chain[-1][1]))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            (kept[PHONE] if 8 <= n <= 15 else failed).append(m.span())
    return kept, failed


# --- candidate segments -------------------------------------------------------------------------

_BRACKETED = re.compile(r"[\[({<] ?at ?[\])}>]", re.IGNORECASE)
_WORD_AT = re.compile(r"(?<=\w) at (?=\w)", re.IGNORECASE)
_DOT = re.compile(r" ?(?:[\[({<] ?(?:dot|\.) ?[\])}>]) ?| dot | \. |\.", re.IGNORECASE)
_LABEL = re.compile(r"[\w-]{1,63}")
_BEFORE = re.compile(r"(\w{1,12})\W{0,3}$")
_LINKS = frozenset(" ().-/[]:,+ ‑–_")
#: Characters that a number's label may have before it.
_OPENING = frozenset("+(")


def shape(gap: str) -> str:
    return "".join("_" if c.isspace() else c for c in gap)


def _around(text: str, start: int, end: int) -> list[str]:
    """What stands before and behind a segment."""
    kind = lambda c: "edge" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else shape(c)
    word = _BEFORE.search(text, max(0, start - 16), start)
    return ["bias", "before " + kind(text[start - 1 : start]), "behind " + kind(text[end : end + 1]), "word " + (word[1].lower() if word and not word[1].isdigit() else "")]


def _number_features(text: str, units: list[Span], i: int, j: int, start: int) -> list[str]:
    runs = [text[a:b] for a, b in units[i:j]]
    digits = "".join(runs)
    gaps = [text[a[1] : b[0]] for a, b in pairwise(units[i:j])]
    made = [
        f"digits {len(digits)}", f"runs {j - i}", "lengths " + "-".join(str(len(r)) for r in runs), "gaps " + " ".join(sorted({shape(g) for g in gaps})), f"kinds of gap {len(set(gaps))}",
        "opens " + shape(text[start : units[i][0]]), f"zeros {min(2, len(digits) - len(digits.lstrip('0')))}", f"first {i == 0} last {j == len(units)}",
    ]
    if len(digits) > 12:
        made.append(f"luhn {luhn(digits)}")
    if len(runs) > 1 and len({len(r) for r in runs}) == 1:
        made.append("even runs")
    return made + _around(text, start, units[j - 1][1])


def _kinds_of(text: str, runs: list[Span], digits: int) -> list[int]:
    kinds = [IP] if len(runs) == 4 and digits <= 12 and all(octet(text[a:b]) for a, b in runs) else []
    return kinds + [CARD] * (13 <= digits <= 19) + [PHONE] * (7 <= digits <= 15)


def _glued(text: str, start: int, end: int) -> bool:
    """Part of a longer word, as in a hexadecimal number."""
    return (start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_"))


Region = tuple[Lattice, list[Span]]


def _number_regions(text: str, runs: list[Span]) -> Iterator[Region]:
    """Lattices over chains of digit runs, and the span of each arc."""
    chain: list[Span] = []
    for run in [*runs, None]:
        if run and (not chain or (run[0] - chain[-1][1] <= LONGEST_GAP and _LINKS.issuperset(text[chain[-1][1] : run[0]]))):
            chain.append(run)
            continue
        if len(chain) > 3 or sum(b - a for a, b in chain) > 6:
            lattice, spans = Lattice(len(chain), []), []
            for i, (first, _) in enumerate(chain):
                digits = 0
                for j in range(i + 1, min(i + MOST_UNITS, len(chain)) + 1):
                    digits += chain[j - 1][1] - chain[j - 1][0]
                    if digits > 19:
                        break
                    for kind in _kinds_of(text, chain[i:j], digits):
                        start = first
                        while kind == PHONE and start > 0 and first - start < 2 and text[start - 1] in _OPENING:
                            start -= 1
                        if not _glued(text, start, chain[j - 1][1]):
                            lattice.arcs.append((i, j, kind + 1, []))
                            spans.append((start, chain[j - 1][1]))
            if spans:
                for (i, j, _, features), span in zip(lattice.arcs, spans):
                    features += _number_features(text, chain, i, j, span[0])
                yield lattice, spans
        chain = [run] if run else []


def _signs(text: str) -> list[Span]:
    """At-signs and what is written for them."""
    found, at = [], text.find("@")
    while at >= 0:
        found.append((at, at + 1))
        at = text.find("@", at + 1)
    if "at" in text or "AT" in text or "At" in text:
        lower = text.lower()
        if any(b + "at" in lower or b + " at" in lower for b in "[({<"):
            found += [m.span() for m in _BRACKETED.finditer(text)]
        if " dot " in lower:
            found += [m.span() for m in _WORD_AT.finditer(text)]
    return sorted(found)


def _mail_regions(text: str) -> Iterator[Region]:
    """Lattices over a local part and the labels behind an at-sign."""
    for a, b in _signs(text):
        sign = shape(text[a:b].lower())
        end = a - (text[a - 1 : a] == " ")
        start = end
        while start > 0 and end - start < 64 and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
            start -= 1
        begin = b + (text[b : b + 1] == " ")
        label = _LABEL.match(text, begin)
        if start == end or not label:
            continue
        ends, dots, at = [], [], label.end()
        while len(ends) < MOST_UNITS - 2 and (dot := _DOT.match(text, at)) and (label := _LABEL.match(text, dot.end())):
            spelt = "dot" in dot[0].lower() or "[" in dot[0] or "(" in dot[0]
            if sign == "_at_" and not spelt:
                break  # 'at' is a word of the language unless the dots are spelt out too
            dots.append(shape(dot[0].lower()))
            at = label.end()
            ends.append((at, label[0]))
        if not ends:
            continue
        lattice, spans = Lattice(len(ends) + 2, []), []
        for n, (stop, last) in enumerate(ends):
            features = [
                f"sign {sign}", f"blanks {end < a}{begin > b}", "dots " + " ".join(sorted(set(dots[: n + 1]))), f"kinds of dot {len(set(dots[: n + 1]))}", f"labels {min(n, 3)}", f"local {min(end - start, 4)}",
                f"top {min(len(last), 8)} {last.isalpha()} {last.islower()}", f"last {n == len(ends) - 1}", f"plain {text[start:stop].isascii()}",
            ]
            lattice.arcs.append((0, n + 3, EMAIL + 1, features + _around(text, start, stop)))
            spans.append((start, stop))
        lattice.n = max(j for _, j, _, _ in lattice.arcs)
        yield lattice, spans


def regions(text: str, runs: list[Span]) -> Iterator[Region]:
    yield from _number_regions(text, runs)
    yield from _mail_regions(text)


class Held:
    """Spans that others must not cross, found by bisection."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.reach = list(accumulate((b for _, b in self.spans), max))

    def crossed(self, start: int, end: int) -> list[Span]:
        near = self.spans[bisect_right(self.reach, start) : bisect_left(self.starts, end)]
        return [s for s in near if s[1] > start]


def find_spans(text: str, field: SemiMarkov) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each kind, in order."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    base, _ = matches(text, runs)
    every = [list(spans) for spans in base]
    held = Held([s for spans in base for s in spans])
    for part in (_number_regions(text, runs), _mail_regions(text)):
        added = []
        for lattice, spans in part:
            if held.crossed(min(s[0] for s in spans), max(s[1] for s in spans)):
                free = [k for k, s in enumerate(spans) if not held.crossed(*s)]
                lattice, spans = Lattice(lattice.n, [lattice.arcs[k] for k in free]), [spans[k] for k in free]
            at = {(i, j, k): s for (i, j, k, _), s in zip(lattice.arcs, spans)}
            for arc in field.best(lattice) if spans else []:
                if not added or added[-1][1] <= at[arc][0]:
                    added.append(at[arc])
                    every[arc[2] - 1].append(at[arc])
        held = Held(held.spans + added) if added else held
    return base, [sorted(x) for x in every]


# --- training -----------------------------------------------------------------------------------

#: Built-in examples, so that a corpus without personal data trains the field as well.
EXAMPLES = [("mail jane.roe@example.com or", 5, 25, EMAIL), ("from 192.0.2.17 today", 5, 15, IP), ("paid with 4111 1111 1111 1111 then", 10, 29, CARD), ("call +1 (411) 555-1507 now", 5, 22, PHONE)]
NO_DATA = ["2021-03-15 10:22:45", "15/03/2021 - 18/04/2021", "3.1415926535", "978-3-16-148410-0", "1,234,567,890", "10.4.2021", "1029384756", "12,500,000.00", "1200-1500", "2.71828", "20210315", "1990 - 2021"]


def spellings(kind: int, found: str, n: int) -> list[str]:
    """Other ways to write a span of a kind, of which number ``n`` chooses some."""
    digits = re.sub(r"\D", "", found)
    if kind == EMAIL:
        local, domain = found.split("@", 1)
        forms = [(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" [at] ", " [dot] ")]
        return [local + a + domain.replace(".", d) for a, d in (forms[n % 6], forms[n // 6 % 6])]
    if kind == IP:
        return [found.replace(".", ("[.]", " . ", "(.)")[n % 3])]
    if kind == CARD:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + n % 9) % 10)
        return [(" ", "-", ".", "/")[n % 4].join(wrong[k : k + 4] for k in range(0, len(wrong), 4)), wrong]
    last = digits[-10:] if len(digits) > 10 else digits
    sep = ("-", ".", " ")[n % 3]
    local = f"{last[:-7]}{sep}{last[-7:-4]}{sep}{last[-4:]}"
    return [f"({last[:-7]}) {last[-7:-4]}-{last[-4:]}" if n % 2 else local, ("00" if n % 4 < 2 else "1" + sep) + (digits if n % 4 < 2 else local)]


def example(text: str, span: Span, kind: int, label: bool, unknown: list[Span] = ()) -> Lattice | None:
    """The region of ``text`` that has ``span``, with the paths that its label allows;
    None where no candidate is the span."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    for lattice, spans in regions(text, runs):
        if not any(s[0] < span[1] and span[0] < s[1] for s in spans):
            continue
        right = [s == span and arc[2] == kind + 1 for arc, s in zip(lattice.arcs, spans)]
        if label and not any(right):
            continue
        free = [bool(unknown) and any(a <= s[0] and s[1] <= b for a, b in unknown) for s in spans]
        lattice.allowed = [r and label or f for r, f in zip(right, free)]
        lattice.alone = [True] * lattice.n
        if label:
            i, j = next(arc[:2] for arc, r in zip(lattice.arcs, right) if r)
            lattice.alone[i:j] = [False] * (j - i)
        return lattice
    return None


def examples(windows: list[tuple[str, int, int, int]]) -> list[Lattice]:
    """Lattices of windows (text, start, end, kind); kind -1 is a look-alike without a label, -2 one that failed its check."""
    made: list[list[Lattice]] = []
    of_kind = Counter(kind for *_, kind in windows)
    for text, a, b, kind, again in [(*w, k) for w in windows for k in range(max(1, SHOWN // of_kind[w[3]]) if w[3] >= 0 else 1)]:
        n = zlib.crc32(f"{again} {text}".encode())
        if kind < 0:
            made.append([example(text, (a, b), 0, False, [(a, b)] if kind == -2 else [])])
            continue
        put = lambda new, more="": (text[:a] + more + new + text[b:], (a + len(more), a + len(more) + len(new)))  # noqa: B023, E731
        ways = [put(text[a:b]), *(put(s) for s in spellings(kind, text[a:b], n))]
        if kind in (IP, CARD):
            ways.append(put(text[a:b], f"{n % 9000000 + 1000000} "))  # another number right before it
        made.append([*(example(*w, kind, True) for w in ways), *(example(*put(NO_DATA[k % len(NO_DATA)]), 0, False) for k in (n, n // 16))])
    made = [[x for x in some if x] for some in made]
    words = Counter(f for some in made for f in {f for x in some for *_, features in x.arcs for f in features if f.startswith("word ")})
    for some in made:
        for x in some:
            x.arcs = [(i, j, k, [f for f in features if not f.startswith("word ") or words[f] >= LEAST_WINDOWS]) for i, j, k, features in x.arcs]
    return [x for some in made for x in some]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around base spans, failed matches and other candidates, as (stratum, text, start, end)."""
    for batch in text_slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            runs = [m.span() for m in _DIGITS.finditer(text)]
            if not runs and "@" not in text:
                continue
            base, failed = matches(text, runs)
            spans = [(k, s) for k, kept in enumerate(base) for s in kept] + [(-2, s) for s in failed]
            held = Held([s for _, s in spans])
            spans += [(-1, found[0]) for _, found in regions(text, runs) if not held.crossed(*found[0])]
            for kind, (a, b) in spans:
                if b - a <= 120:
                    low = max(0, a - CONTEXT)
                    rows.append((kind, text[low : b + CONTEXT], a - low, b - low))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["kind", "text", "a", "b"])


def train(docs: DataFrame, epochs: int = EPOCHS) -> SemiMarkov:
    """The field fitted on a bounded sample of ``docs`` (text)."""
    texts = docs.select(text_of().alias("text"))
    n = texts.count()
    if n > TRAIN_DOCS:
        texts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(n)) < TRAIN_DOCS)
    drawn = stage(texts.mapInArrow(_windows, "kind int, text string, a int, b int"), "windows").distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("text", "a"), "text", "a")
    kept = drawn.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= TRAIN_WINDOWS).orderBy("_n", "kind").collect()
    made = SemiMarkov(len(KINDS))
    made.fit(examples([*EXAMPLES, *((r["text"], r["a"], r["b"], r["kind"]) for r in kept)]), epochs)
    return made


def written(spans: list[list[Span]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, kept in enumerate(spans) for a, b in kept)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _found(field: SemiMarkov):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, every = find_spans(text, field)
                n = [len(x) for x in base]
                rows.append((doc_id, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(every), sum(map(len, every)) - sum(n)))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def find_personal_data(docs: DataFrame, field: SemiMarkov | None = None) -> DataFrame:
    """Counts, digest and all spans of each row of ``docs`` (doc_id, text)."""
    field = field or train(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_found(field), FOUND)
