"""Adaptive context-mixing range coder for token ids, many blocks at a time.

Three orders predict each id. Order 2 (the two ids before) and order 1 (the id
before) each keep the id that followed last in that context and how often it
was right; the highest order that has seen its context names the candidate. A
flag says whether the candidate is right. Its chance is mixed: one adaptive
estimate for each order (by its own confidence and whether the orders agree,
order 0 by how the last flags went), in the logistic domain, with weights that
learn after every flag. A wrong order 2 leaves the second chance to order 1,
with a flag of its own. An id that no order named is coded by order 0, four
nibbles down a tree of adaptive counts.

All of it starts afresh in every block and follows what has been coded, so a
block decodes on its own. Blocks are lanes: numpy codes one id of all blocks
at once, the longest blocks first, so that the lanes still at work are always
the first ones. Arithmetic is on integers only, but for divisions: an interval
is below 2^48, so a quotient of doubles is never rounded up to the next
integer. The coder is a carryless range coder with a 48-bit window that moves
16 bits at a time.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
#: Slots of the order-1 and order-2 tables, nodes of the order-0 tree.
SLOTS_1, SLOTS_2, NODES = 4096, 8192, 1 + 16 + 256 + 4096
#: Highest confidence; what a nibble's count grows by and stays below.
SURE, STEP, MOST = 15, 32, 3800
#: Contexts of a flag's estimates: confidence by agreement for orders 2 and 1, last flags for order 0.
BY_ORDER = 3 * (SURE + 1)
CONTEXTS = 2 * BY_ORDER + 2 * 16
RATE, PULL = 4, 6
TOP, BOTTOM, WINDOW = 1 << 32, 1 << 16, (1 << 48) - 1

#: What a nibble adds to the running sums of its node; sums stay below 65536.
_ADDS = np.triu(np.full((16, 16), STEP, np.uint16))
#: A node's sums as one item, so that numpy moves them at once.
_ROW = np.dtype((np.void, 32))
#: The product's highest byte is the sum of all bytes.
_ONES, _HIGH = np.uint64(0x0101010101010101), np.uint64(56)
#: The nodes of an id are those of its first 0 to 3 nibbles, level after level.
_SHIFTS, _LEVELS = np.array([[16], [12], [8], [4]]), np.array([[0], [1], [17], [273]])
_P = (np.arange(4096) + 0.5) / 4096
#: log-odds of a 12-bit chance, in 256ths, and back.
STRETCH = np.clip(np.rint(256 * np.log(_P / (1 - _P))), -2047, 2047).astype(np.int64)
SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, 4095).astype(np.int64)


class _Encoder:
    """Intervals of all lanes, narrowed to what is known.

    ``begin`` takes some lanes' intervals out, further calls narrow those, ``end`` puts them back."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.wide = np.zeros(lanes, np.int64), np.full(lanes, WINDOW)
        self._rows(np.zeros((lanes, steps + 64), np.uint16))

    def _rows(self, words: np.ndarray, used: np.ndarray | int = 0) -> None:
        """The words of each lane, of which so many are in use."""
        self.words, self.first = words, np.arange(len(words)) * words.shape[1]
        self.flat, self.at = words.reshape(-1), self.first + used
        self.free = words.shape[1] - int(np.max(used, initial=0))

    def begin(self, lanes: np.ndarray) -> None:
        self.lanes, self.lows, self.wides = lanes, self.low.take(lanes), self.wide.take(lanes)

    def end(self) -> None:
        self.low[self.lanes], self.wide[self.lanes] = self.lows, self.wides

    def bit(self, chance: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        unit = self.wides >> 16
        if bit is None:
            bit = self.place(unit) < chance
        self.narrow(unit, np.where(bit, 0, chance), np.where(bit, chance, 65536 - chance))
        return bit

    def narrow(self, unit: np.ndarray, start: np.ndarray, share: np.ndarray) -> None:
        low, wide = self.lows, self.wides
        np.multiply(unit, share, out=wide)
        low += unit * start
        some = (((low ^ (low + wide)) < TOP) | (wide < BOTTOM)).nonzero()[0]
        if not len(some):
            return
        lows, wides = low.take(some), wide.take(some)
        while True:
            cut = ((lows ^ (lows + wides)) >= TOP).nonzero()[0]  # too narrow and still unsettled: give up a part
            if len(cut):
                wides[cut] = -lows[cut] & BOTTOM - 1
            self.shift(some, lows)
            lows, wides = (lows & TOP - 1) << 16, wides << 16
            low[some], wide[some] = lows, wides
            more = (((lows ^ (lows + wides)) < TOP) | (wides < BOTTOM)).nonzero()[0]
            if not len(more):
                return
            some, lows, wides = some[more], lows[more], wides[more]

    def shift(self, some: np.ndarray, lows: np.ndarray) -> None:
        """Put out the first 16 bits of some of the lanes' windows."""
        if not self.free:  # at least one lane may be full
            used = self.at - self.first
            full = int(used.max()) == self.words.shape[1]
            self._rows(np.concatenate([self.words, np.zeros_like(self.words)], axis=1) if full else self.words, used)
        self.free -= 1
        lanes = self.lanes.take(some)
        at = self.at.take(lanes)
        self.flat[at] = lows >> 32
        self.at[lanes] = at + 1

    def coded(self, lane: int) -> bytes:
        last = [int(self.low[lane]) >> shift & 0xFFFF for shift in (32, 16, 0)]
        return np.append(self.words[lane, : self.at[lane] - self.first[lane]], np.array(last, np.uint16)).astype("<u2").tobytes()


class _Decoder(_Encoder):
    """The same intervals, narrowed to where the code lies."""

    def __init__(self, coded: list[bytes]):
        super().__init__(len(coded), 0)
        words = np.zeros((len(coded), max(map(len, coded), default=0) // 2 + 8), np.uint16)
        for k, c in enumerate(coded):
            words[k, : len(c) // 2] = np.frombuffer(c, "<u2")
        self._rows(words, 3)
        first = words[:, :3].astype(np.int64)
        self.code = first[:, 0] << 32 | first[:, 1] << 16 | first[:, 2]

    def begin(self, lanes: np.ndarray) -> None:
        super().begin(lanes)
        self.codes = self.code.take(lanes)

    def end(self) -> None:
        super().end()
        self.code[self.lanes] = self.codes

    def place(self, unit: np.ndarray) -> np.ndarray:
        """Where the code lies in its interval, in units; without sign, as damaged code may lie before it."""
        return ((self.codes - self.lows) / unit).astype(np.int64).view(np.uint64)

    def shift(self, some: np.ndarray, lows: np.ndarray) -> None:
        lanes = self.lanes.take(some)
        at = self.at.take(lanes)
        # code that is damaged may go on beyond its words
        self.codes[some] = (self.codes.take(some) & TOP - 1) << 16 | self.flat.take(at, mode="clip")
        self.at[lanes] = at + 1


class _Model:
    """What every lane has learned of its block so far."""

    def __init__(self, lanes: int):
        self.lanes, self.n = lanes, -1
        self.one, self.two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.last = np.zeros(lanes, np.int64)
        self.slots_1, self.slots_2 = np.zeros(lanes * SLOTS_1, np.int32), np.zeros(lanes * SLOTS_2, np.int32)
        self.tree = np.empty((NODES * lanes, 16), np.uint16)  # running sums of counts, node after node
        self.tree[:] = np.arange(1, 17)
        self.rows = self.tree.view(_ROW).reshape(-1)
        self.chances = np.full(lanes * CONTEXTS, 1 << 15, np.int32)
        self.weights = np.full(3 * 2 * lanes, 26_000, np.int64)  # of the three estimates, one after the other
        self.by_estimate = np.arange(0, 6 * lanes, 2 * lanes)[:, None]

    def code(self, coder: _Encoder, n: int, want: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first ``n`` lanes, known or (``want`` None) to be read."""
        if n != self.n:
            self.n, self.base_1, self.base_2 = n, np.arange(n) * SLOTS_1, np.arange(n) * SLOTS_2
        one, two = self.one[:n], self.two[:n]
        both = one * np.uint32(40503)
        at_1 = self.base_1 + (both >> 2 & SLOTS_1 - 1)
        both += two * np.uint32(2654435761)
        at_2 = self.base_2 + (both >> 15 & SLOTS_2 - 1)
        check = (both >> 4 & 0x7FF).view(np.int32)
        slot_1, slot_2 = self.slots_1.take(at_1), self.slots_2.take(at_2)
        id_1, sure_1 = slot_1 & 0xFFFF, slot_1 >> 16
        id_2, sure_2 = slot_2 & 0xFFFF, (slot_2 >> 16 & 15) * (slot_2 >> 20 == check)
        top = sure_2 > 0
        named = np.where(top, id_2, id_1)
        agree = (top & (sure_1 > 0)) * (1 + (id_1 != id_2)).astype(np.int32)
        by_2, by_1 = sure_2 * 3 + agree, sure_1 * 3 + (agree + BY_ORDER)
        left = np.ones(n, bool)

        some = (by_2 + by_1 > BY_ORDER).nonzero()[0]
        if len(some):
            hit = self.flag(coder, some, top.take(some), by_2.take(some), by_1.take(some), None if want is None else (want == named).take(some))
            left[some] = ~hit
            again = (left & (agree == 2)).nonzero()[0]
            if len(again):
                hit = self.flag(coder, again, 0, agree.take(again), by_1.take(again), None if want is None else (want == id_1).take(again))
                hit = again[hit]
                left[hit], named[hit] = False, id_1[hit]
        rest = left.nonzero()[0]
        if len(rest):
            named[rest] = self.literal(coder, rest, None if want is None else want.take(rest))

        self.slots_1[at_1] = _learned(id_1, sure_1, named)
        self.slots_2[at_2] = _learned(id_2, sure_2, named) | check << 20
        self.two[:n] = one
        self.one[:n] = named
        return named

    def flag(self, coder: _Encoder, lanes: np.ndarray, kind: np.ndarray | int, by_2: np.ndarray, by_1: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        last, at = self.last.take(lanes), np.empty((3, len(lanes)), np.int64)
        at[0], at[1] = by_2, by_1
        np.add(last * 2, kind + 2 * BY_ORDER, out=at[2])
        at += lanes * CONTEXTS
        own = lanes * 2 + kind + self.by_estimate
        chance, weights = self.chances.take(at), self.weights.take(own)
        odds = STRETCH.take(chance >> 4)
        of_2, of_1, of_0 = weights * odds
        mixed = SQUASH.take((of_2 + of_1 + of_0 >> 16) + 2047, mode="clip")
        coder.begin(lanes)
        bit = coder.bit(mixed << 4, bit)
        coder.end()
        odds *= (bit * 4096 - mixed) * PULL
        odds >>= 10
        odds += weights
        self.weights[own] = odds
        chance += (bit * np.int32(65535) - chance) >> RATE
        self.chances[at] = chance
        self.last[lanes] = (last << 1 | bit) & 15
        return bit

    def literal(self, coder: _Encoder, lanes: np.ndarray, want: np.ndarray | None) -> np.ndarray:
        coder.begin(lanes)
        if want is not None:
            want = want.astype(np.int64)
            at = (((want >> _SHIFTS) + _LEVELS) * self.lanes + lanes).reshape(-1)
            sums, nibble = self.sums(at), (want >> _SHIFTS - 4 & 15).reshape(-1)
            whole, (start, share) = sums[:, 15].copy(), self.learn(at, sums, nibble)
            for total, below, own in zip(whole.reshape(4, -1), start.reshape(4, -1), share.reshape(4, -1), strict=True):
                coder.narrow((coder.wides / total).astype(np.int64), below, own)
            self.halve(at, share)
        else:
            node, met = np.zeros(len(lanes), np.int64), []
            for _ in range(4):
                at = node * self.lanes + lanes
                sums = self.sums(at)
                unit = (coder.wides / sums[:, 15]).astype(np.int64)
                place = np.minimum(coder.place(unit), sums[:, 15] - np.uint16(1)).astype(np.uint16)
                below = (sums <= place[:, None]).view(np.uint64)  # eight flags of one byte each
                nibble = ((below[:, 0] + below[:, 1]) * _ONES >> _HIGH).view(np.int64)
                start, share = self.learn(at, sums, nibble)
                coder.narrow(unit, start, share)
                met.append((at, share))
                node = node * 16 + nibble + 1
            self.halve(*map(np.concatenate, zip(*met, strict=True)))
            want = node - 0x1111  # each nibble added one to its node
        coder.end()
        return want

    def sums(self, at: np.ndarray) -> np.ndarray:
        return self.rows.take(at).view(np.uint16).reshape(-1, 16)

    def learn(self, at: np.ndarray, sums: np.ndarray, nibble: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums below the nibbles of some nodes and the nibbles' counts, as they were; the nodes count them from now on."""
        cell, flat = np.arange(0, 16 * len(at), 16) + nibble, sums.reshape(-1)
        start = flat.take(cell - 1, mode="wrap") * (nibble > 0)
        share = flat.take(cell) - start
        sums += _ADDS.take(nibble, axis=0)
        self.rows[at] = sums.view(_ROW).reshape(-1)
        return start, share

    def halve(self, at: np.ndarray, share: np.ndarray) -> None:
        """Halve all counts of the nodes where one that was ``share`` has come to its most."""
        full = at[(share > MOST - STEP).nonzero()[0]]
        if len(full):
            counts = self.sums(full)
            counts[:, 1:] -= counts[:, :-1].copy()
            counts += np.uint16(1)
            counts >>= 1
            self.rows[full] = np.add.accumulate(counts, axis=1, dtype=np.uint16).view(_ROW).reshape(-1)


def _learned(named: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A slot after ``ids``: surer if it named them, else half as sure, and of the new id once it isn't."""
    now = np.where(named == ids, np.minimum(sure + 1, SURE), sure >> 1)
    return np.where(now > 0, now << 16 | named, 1 << 16 | ids)


def _walk(coder: _Encoder, lengths: np.ndarray, ids: np.ndarray, known: bool) -> None:
    """Code all blocks, the longest first; ``ids`` (steps, lanes) is read or filled."""
    model, n = _Model(len(lengths)), len(lengths)
    for step in range(len(ids)):
        while lengths[n - 1] <= step:
            n -= 1
        found = model.code(coder, n, ids[step, :n].astype(np.int32) if known else None)
        if not known:
            ids[step, :n] = found


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of each block of ids below 65536."""
    lengths = np.array(list(map(len, blocks)), np.int64)
    order = np.argsort(-lengths, kind="stable")
    ids = np.zeros((len(blocks), lengths.max(initial=0)), np.uint16)
    for lane, k in enumerate(order.tolist()):
        ids[lane, : lengths[k]] = blocks[k]
    coder = _Encoder(*ids.shape)
    _walk(coder, lengths[order], ids.T.copy(), True)
    return [coder.coded(lane) for lane in np.argsort(order).tolist()]


def decode(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of blocks with so many ids each."""
    sizes = np.array(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    ids = np.zeros((sizes.max(initial=0), len(coded)), np.uint16)
    _walk(_Decoder([coded[k] for k in order.tolist()]), sizes[order], ids, False)
    ids = ids.T.copy()
    return [ids[lane, :n] for lane, n in zip(np.argsort(order).tolist(), lengths, strict=True)]


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
