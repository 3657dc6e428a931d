"""Token ids of whole texts, each distinct piece encoded once.

Texts are cut where the tokenizer's pre-tokens must end (``kernels.pieces``),
so the ids of a text are the ids of its pieces one after the other. A worker
keeps the ids of pieces it has seen by a 64-bit hash, up to ``KEPT`` of them;
beyond that it starts anew. Memory is bounded by that and by a slice.

New pieces go to the library many at a time, joined as they could stand in a
text; the tokens' lengths in bytes tell where each piece's ids end, so the
tokenizer must be a byte-level one.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa

from loomery.llm.kernels import joins, pieces, utf8

#: Pieces that a worker keeps, bytes of text it works on at a time, pieces that are encoded as one text.
KEPT, SLICE_BYTES, JOINED = 1 << 18, 1 << 20, 1024

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, once a worker; strings of special tokens are ordinary text."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path if os.path.sep in path else public_tokenizers.path(path))
        _loaded[path].encode_special_tokens = True
    return _loaded[path]


class PieceIds:
    """Ids of the pieces seen so far: sorted hashes, and for each its part of ``flat``."""

    def __init__(self, path: str):
        self.path = path
        # a byte-level token has one character for each of its bytes
        self.token_bytes = np.array([len(tokenizer(path).id_to_token(k) or "") for k in range(tokenizer(path).get_vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ends, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        apart = ~joins(data, starts, ends)
        order = np.argsort(apart, kind="stable")
        hashes, starts, ends = hashes[order], starts[order], ends[order]
        flat, sizes = [self.flat], []
        whole = len(order) - int(apart.sum())
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        for a, b in [(k, min(k + JOINED, whole)) for k in range(0, whole, JOINED)] + [(k, k + 1) for k in range(whole, len(order))]:
            text = b"".join(data[x:y].tobytes() for x, y in spans[a:b]).decode()
            ids = np.array(tokenizer(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            flat.append(ids)
            reached = np.cumsum(self.token_bytes[ids])
            sizes.append(np.diff(np.searchsorted(reached, np.cumsum(ends[a:b] - starts[a:b])), prepend=-1))
        self.flat = np.concatenate(flat)
        before = len(self.ends) - 1
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes), dtype=np.int64)))
        self.hashes = np.concatenate((self.hashes, hashes))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.place = np.concatenate((self.place, np.arange(before, before + len(hashes), dtype=np.int32)))[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all, one text after the other."""
        if len(self.hashes) > KEPT:
            self.clear()
        data, offsets = utf8(texts)
        found = list(pieces(data, offsets))
        if not found:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        rows, hashes, starts, ends = (np.concatenate([f[k] for f in found]) for k in range(4))
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._has(kinds))
        if len(new):
            self.add(kinds[new], data, starts[first[new]], ends[first[new]])
        place = self.place[np.searchsorted(self.hashes, kinds)][which]
        at, n = self.ends[place], self.ends[place + 1] - self.ends[place]
        ids = self.flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return np.bincount(rows, n, minlength=len(texts)).astype(np.int64), ids

    def _has(self, kinds: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(kinds), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, kinds), len(self.hashes) - 1)] == kinds


_seen: dict[str, PieceIds] = {}


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """``PieceIds.encode`` with what this worker has kept for the tokenizer."""
    if path not in _seen:
        _seen[path] = PieceIds(path)
    return _seen[path].encode(texts)
