"""Subword lattices: the probability of a word over all its segmentations into pieces of a given vocabulary.

A word stands as one space and its bytes. Its lattice has an arc for each piece of the vocabulary that ends at a
byte; pieces that begin with the space start a word, the others follow and the word ends by an own symbol, so that
the pieces' probabilities (one distribution for starts, one for what follows) make one over all byte strings. Every
single byte is a piece, so every word has a segmentation. The forward recursion runs in log space over many words at
once: words of like length are padded into numpy matrices of bounded size, very long ones pass in blocks of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

CELLS = 1 << 15
NEVER = -np.inf
_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(_RANDOM.integers(2**62, 2**63, dtype=np.uint64) | np.uint64(1))


class Vocabulary:
    """Pieces as bytes, which of them start a word, and their prior; the word's end is one more symbol at the end of each score array."""

    def __init__(self, pieces: dict[bytes, float]):
        """``pieces``: weight by piece; a piece that starts a word begins with a space."""
        held = {p: w for p, w in pieces.items() if p and b" " not in p[1:]}
        low = min(held.values(), default=1.0)
        for p in (b" ", *(bytes([i]) for i in range(256) if i != 32)):
            held.setdefault(p, low)
        self.pieces = list(held)
        self.starts = np.array([p[:1] == b" " for p in self.pieces] + [False])
        self.prior = self.normal(np.array([*held.values(), max(held.values())]))
        by: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by.setdefault(len(p), []).append(i)
        self.lengths = sorted(by)
        self.tables = {}
        for n, ids in by.items():
            h = np.zeros(len(ids), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = h * _FACTOR + _BYTE[[self.pieces[i][k] for i in ids]]
            order = np.argsort(h)
            seen = np.zeros(1 << 18, bool)
            seen[h >> np.uint64(46)] = True
            self.tables[n] = (h[order], np.array(ids, np.int32)[order], seen)

    def normal(self, weights: np.ndarray) -> np.ndarray:
        """Log probabilities: starts among themselves, the others and the end among themselves."""
        out = np.log(weights)
        for kind in (self.starts, ~self.starts):
            out[kind] -= np.log(weights[kind].sum())
        return out

    def learnt(self, counts: np.ndarray, belief: float = 100.0) -> np.ndarray:
        """Log probabilities from expected counts and ``belief`` counts spread like the prior."""
        return self.normal(counts + belief * np.exp(self.prior))

    def arcs(self, text: np.ndarray, begin: int, end: int) -> list[tuple[int, np.ndarray]]:
        """(length, ids[row, t]) of the pieces that end at byte ``begin`` + 1 + t of each row, up to ``end``; -1: none."""
        most = self.lengths[-1]
        from_ = max(0, begin - most + 1)
        codes = _BYTE[text[:, from_:end]]
        width, skip = end - begin, begin - from_
        out, h = [], np.zeros_like(codes)
        for n in range(1, min(most, end) + 1):
            with np.errstate(over="ignore"):
                h = (h[:, :-1] if n > 1 else h) * _FACTOR + codes[:, n - 1 :]
            if n not in self.tables:
                continue
            keys, ids, seen = self.tables[n]
            found = np.full((len(text), width), -1, np.int32)
            lead = skip - (n - 1)  # column of h that ends at byte ``begin``
            part, to = (h[:, lead:], found) if lead >= 0 else (h, found[:, -lead:])
            maybe = np.nonzero(seen[part >> np.uint64(46)])
            at = np.minimum(np.searchsorted(keys, part[maybe]), len(keys) - 1)
            to[maybe] = np.where(keys[at] == part[maybe], ids[at], -1)
            if (found >= 0).any():
                out.append((n, found))
        return out


@cache
def load(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model. Log scores weigh pieces as they are; scores that are ranks by Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    score = np.array([sp.get_score(i) for i in plain])
    usual = score[score > -1e8]
    ranks = len(usual) > 1 and np.array_equal(usual, np.round(usual)) and usual.min() < -1000
    weight = 1 / (2.7 - score) if ranks else np.exp(score)
    pieces: dict[bytes, float] = {}
    for i, w in zip(plain, weight):
        p = sp.id_to_piece(i).replace("▁", " ").encode()
        pieces[p] = max(pieces.get(p, 0.0), float(w))
    return Vocabulary({p: max(w, 1e-12) for p, w in pieces.items()})


def _matrices(words: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths with the space, bytes[row, position]) of words of like length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        wide = max(int(sizes[order[i]] * 1.25), int(sizes[order[i]]) + 2)
        j = min(i + max(1, CELLS // wide), int(np.searchsorted(sizes[order], wide, "right")))
        at = order[i:j]
        n = int(sizes[at[-1]])
        data = np.frombuffer(b"".join((b" " + words[k]).ljust(n, b"\0") for k in at), np.uint8).reshape(len(at), n)
        yield at, sizes[at], data
        i = j


def _sum(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials."""
    if len(terms) == 1:
        return terms[0]
    x = np.stack(terms)
    top = x.max(0)
    top[top == NEVER] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(0)) + top


def _forward(v: Vocabulary, scores: np.ndarray, data: np.ndarray, block: int) -> np.ndarray:
    """Log of the summed segmentations up to each byte: [byte, score array, row]."""
    padded = np.append(scores, np.full((len(scores), 1), NEVER), 1)  # index -1: no arc
    b, n = data.shape
    alpha = np.full((n + 1, len(scores), b), NEVER)
    alpha[0] = 0.0
    for begin in range(0, n, block):
        end = min(n, begin + block)
        arcs = [(k, padded[:, ids.T].transpose(1, 0, 2)) for k, ids in v.arcs(data, begin, end)]
        for t in range(begin + 1, end + 1):
            alpha[t] = _sum([alpha[t - k] + w[t - begin - 1] for k, w in arcs if k <= t])
    return alpha


def log_likelihood(v: Vocabulary, scores: np.ndarray, words: Sequence[bytes], block: int = CELLS) -> np.ndarray:
    """[score array, word]: natural log of each word's probability, summed over all segmentations."""
    out = np.zeros((len(scores), len(words)))
    for at, sizes, data in _matrices(words):
        out[:, at] = _forward(v, scores, data, block)[sizes, :, np.arange(len(at))].T + scores[:, -1:]
    return out


def expected_counts(v: Vocabulary, score: np.ndarray, words: Sequence[bytes], block: int = CELLS) -> np.ndarray:
    """How often each piece is expected in the words' segmentations, and last how many words end."""
    counts = np.zeros(len(score))
    padded, most = np.append(score, NEVER), v.lengths[-1]
    for at, sizes, data in _matrices(words):
        b, n = data.shape
        alpha = _forward(v, score[None, :], data, block)[:, 0]
        whole = alpha[sizes, np.arange(b)]
        beta = np.full((n + 1, b), NEVER)
        beta[sizes, np.arange(b)] = 0.0
        for begin in reversed(range(0, n, block)):
            end = min(n, begin + block)  # pieces that start in this block
            arcs = [(k, ids.T, padded[ids.T]) for k, ids in v.arcs(data, begin, min(n, end + most - 1))]
            for s in range(end - 1, begin - 1, -1):
                there = [w[s + k - begin - 1] + beta[s + k] for k, _, w in arcs if s + k <= n]
                if there:
                    beta[s] = np.maximum(beta[s], _sum(there))  # a row's own end is settled
            for k, ids, w in arcs:
                m = min(end, n - k + 1) - begin
                if m > 0:
                    log = alpha[begin : begin + m] + w[k - 1 : k - 1 + m] + beta[begin + k : begin + k + m] - whole
                    used = ids[k - 1 : k - 1 + m]
                    there = (used >= 0) & (log > -60)
                    counts += np.bincount(used[there], np.exp(log[there]), len(score))
        counts[-1] += len(at)
    return counts
