"""Hashed text features, computed with numpy over whole batches of texts at once.

A text becomes up to four families of features: character n-grams, words, and pairs of neighbouring
words. Every family is averaged by itself and the families are averaged again, so the many n-grams do not
drown the few words. Neighbouring words are hashed by the XOR of their hashes: an immediate repetition of
any word hashes to one and the same bucket.

Nothing depends on how texts are batched. Texts above `PIECE` characters are cut into pieces after a
space, so memory stays bounded; every character of every piece counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PAD = 4                  # separator code points between texts; no n-gram reaches over them
PIECE = 1 << 19          # characters of one text handled at a time
GROUP = 1 << 17          # characters of several texts handled at a time: bounds the arrays of a task
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 64)
        with np.errstate(over="ignore"):
            for key, base in (("up", _R), ("down", _R_INV)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[key] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes so that any of their bits can pick a bucket."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of codes[start:end] for every span: equal content gives equal hashes anywhere."""
    up, down = _power_table(len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(codes) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * up[ends] + (ends - starts).astype(np.uint64))


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (text number, text or piece of it): up to GROUP characters together, or one piece of up to PIECE."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            if len(text) - at <= PIECE:
                part = text[at:]
            else:
                cut = text.rfind(" ", at + 1, at + PIECE)
                part = text[at:cut + 1 if cut > 0 else at + PIECE]
            if size + len(part) > GROUP and parts:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append(part)
            size += len(part) + PAD
            at += len(part)
            if at >= len(text):
                break
    if parts:
        yield numbers, parts


@dataclass(frozen=True)
class FeatureSpec:
    """Which features are hashed into how many buckets (2 ** bits)."""

    bits: int = 17
    orders: tuple = (3, 4)
    words: bool = True
    pairs: bool = True
    lower: bool = False

    @property
    def families(self) -> int:
        return len(self.orders) + int(self.words) + int(self.pairs)

    def _families_of(self, parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per family: (bucket of every feature, number of the part it stands in)."""
        sep = "\0" * PAD
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        codes = np.frombuffer((sep.join(parts) + sep).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        owner = np.repeat(np.arange(len(parts)), lengths + PAD)
        ends = np.cumsum(lengths + PAD)
        inside = np.ones(len(codes), dtype=bool)
        for k in range(PAD):
            inside[ends - 1 - k] = False
        shift = np.uint32(32 - self.bits)
        n = len(codes) - PAD + 1
        at = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            factors = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
            for order in self.orders:
                h = np.full(n, order * 0x01000193, dtype=np.uint32)
                for k in range(order):
                    h += (codes[k:k + n] + np.uint32(k)) * factors[k]
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x2C1B3C6D)
                h ^= h >> np.uint32(13)
                h *= np.uint32(0x297A2D39)
                yield (h >> shift)[at].astype(np.int64), owner[at]
        if self.words or self.pairs:
            blank = (codes <= 32) & ((codes == 32) | (codes == 0) | ((codes >= 9) & (codes <= 13)))
            edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
            starts = np.flatnonzero(edge == -1)
            stops = np.flatnonzero(edge == 1)
            h = span_hashes(codes, starts, stops)
            own = owner[starts]
            down = np.uint64(64 - self.bits)
            if self.words:
                yield (mix(h + np.uint64(7)) >> down).astype(np.int64), own
            if self.pairs:
                same = own[1:] == own[:-1]
                pair = (h[1:] ^ h[:-1])[same]
                yield (mix(pair + np.uint64(11)) >> down).astype(np.int64), own[1:][same]

    def _prepare(self, texts: list[str]) -> list[str]:
        return [t.lower() for t in texts] if self.lower else texts

    def sums(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """Average of the bucket weights (2**bits or 2**bits x k) over each text's features; 0 if it has none."""
        flat = weights.reshape(len(weights), -1)
        k = flat.shape[1]
        total = np.zeros((self.families, len(texts), k))
        count = np.zeros((self.families, len(texts)))
        for numbers, parts in pieces(self._prepare(texts)):
            numbers = np.array(numbers)
            for f, (bucket, own) in enumerate(self._families_of(parts)):
                if len(bucket) == 0:
                    continue
                np.add.at(count[f], numbers, np.bincount(own, minlength=len(parts)))
                for j in range(k):
                    got = np.bincount(own, weights=flat[bucket, j], minlength=len(parts))
                    np.add.at(total[f, :, j], numbers, got)
        mean = total / np.maximum(count, 1)[:, :, None]
        return mean.sum(axis=0) / self.families

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: its distinct buckets (int32) and their averaged weights (float32)."""
        out = []
        for text in self._prepare(texts):
            found: list[dict] = [{} for _ in range(self.families)]
            for _, parts in pieces([text]):
                for f, (bucket, _) in enumerate(self._families_of(parts)):
                    ids, n = np.unique(bucket, return_counts=True)
                    found[f].setdefault("ids", []).append(ids)
                    found[f].setdefault("n", []).append(n)
            ids, w = [], []
            for fam in found:
                if fam:
                    n = np.concatenate(fam["n"]).astype(np.float64)
                    if n.sum():
                        ids.append(np.concatenate(fam["ids"]))
                        w.append(n / (n.sum() * self.families))
            if ids:
                unique, where = np.unique(np.concatenate(ids), return_inverse=True)
                out.append((unique.astype(np.int32),
                            np.bincount(where, weights=np.concatenate(w)).astype(np.float32)))
            else:
                out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
        return out
