"""Hashed n-grams of one text as numpy arrays, and sparse linear scores over them.

A text is read in slices of ``SLICE`` characters, so memory stays bounded for texts of
any length. What a slice leaves open is carried over: the hash of an unfinished token,
the last whole token, the last characters; so every n-gram of the text is met, as if it
were read at once. Tokens are runs of letters and digits, or runs of other characters;
a token that repeats its neighbour makes one common bigram, whatever the token is.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 18
_STEP = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Grams:
    """``families``: for each kind of n-gram the slots (below ``1 << bits``) of its occurrences."""

    def __init__(self, bits: int, chars: int = 0):
        self.shift, self.chars, self.size = np.uint64(64 - bits), chars, 1 << bits
        most = 4 * SLICE + 8
        self.power = np.cumprod(np.full(most, _STEP, dtype=np.uint64))
        self.inverse = np.cumprod(np.full(most, pow(_STEP, -1, 1 << 64), dtype=np.uint64))
        kind = np.full(256, 2, dtype=np.uint8)
        kind[[9, 10, 11, 12, 13, 32]] = 0
        kind[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 1
        self.kind = kind

    def runs(self, part: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind, length in bytes and raw hash of the runs of one kind of a slice (kind 0: white space)."""
        data = np.frombuffer(part.encode("utf-8", "replace"), dtype=np.uint8)
        kind = self.kind[data]
        edge = np.flatnonzero(np.diff(kind, prepend=3, append=3))
        starts, ends = edge[:-1], edge[1:]
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=total[1:])
        return kind[starts], ends - starts, (total[ends] - total[starts]) * self.inverse[starts]

    def token_slices(self, text: str):
        """The 64-bit hashes of the tokens, slice by slice; a token is given with the slice it ends in."""
        rest = None  # kind, length and raw hash of a run that may go on
        for at in range(0, len(text), SLICE):
            kinds, lengths, raw = self.runs(text[at:at + SLICE])
            if rest and kinds[0] == rest[0]:
                lengths[0] += rest[1]
                raw[:1] = raw[:1] * np.uint64(pow(_STEP, rest[1], 1 << 64)) + np.uint64(rest[2])
            elif rest:
                kinds, lengths = np.append(kinds[:0], [rest[0], *kinds]), np.append(lengths[:0], [rest[1], *lengths])
                raw = np.concatenate((np.array([rest[2]], dtype=np.uint64), raw))
            rest = None
            if at + SLICE < len(text):
                rest = int(kinds[-1]), int(lengths[-1]), int(raw[-1])
                kinds, raw = kinds[:-1], raw[:-1]
            yield mixed(raw[kinds > 0])

    def walk(self, text: str):
        """For each slice the slots of the n-grams that end in it, one array for each kind of n-gram."""
        last, tail = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        for at, h in zip(range(0, len(text), SLICE), self.token_slices(text)):
            row = np.concatenate((last, h))
            pair = mixed(row[:-1] * np.uint64(0xA24BAED4963EE407) + row[1:])
            pair[row[:-1] == row[1:]] = np.uint64(0x5851F42D4C957F2D)
            last = row[-1:]
            out = [h >> self.shift, pair >> self.shift]
            if self.chars:
                points = np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
                points = np.concatenate((tail, points))
                tail = points[len(points) - min(self.chars - 1, len(points)):]
                g = np.zeros(max(len(points) - self.chars + 1, 0), dtype=np.uint64)
                for i in range(self.chars):
                    g = g * np.uint64(0xD1342543DE82EF95) + points[i:i + len(g)] + np.uint64(1)
                out.append(mixed(g) >> self.shift)
            yield out

    def tokens(self, text: str) -> np.ndarray:
        """A 64-bit hash of each token."""
        return np.concatenate([np.zeros(0, dtype=np.uint64), *self.token_slices(text)])

    def families(self, text: str) -> list[np.ndarray]:
        """The slots of all n-grams, one array for each kind."""
        kinds = 3 if self.chars else 2
        return [np.concatenate(f) for f in zip([np.zeros(0, dtype=np.uint64)] * kinds, *self.walk(text))]

    def dot(self, text: str | None, weights: np.ndarray) -> float:
        """Sum over the kinds of n-gram of sum(weights of occurrences) / sqrt(occurrences)."""
        sums, counts = np.zeros(3), np.zeros(3)
        for found in self.walk(text or ""):
            for k, slots in enumerate(found):
                sums[k] += weights[slots].sum(dtype=np.float64)
                counts[k] += len(slots)
        return float((sums / np.sqrt(np.maximum(counts, 1))).sum())

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The same as sparse (slots, values)."""
        kinds, counts = [{}, {}, {}], np.zeros(3)
        for found in self.walk(text or ""):
            for k, slots in enumerate(found):
                counts[k] += len(slots)
                for slot, n in zip(*(a.tolist() for a in np.unique(slots, return_counts=True))):
                    kinds[k][slot] = kinds[k].get(slot, 0) + n
        values: dict[int, float] = {}
        for k, found in enumerate(kinds):
            for slot, n in found.items():
                values[slot] = values.get(slot, 0.0) + n / counts[k] ** 0.5
        slots = sorted(values)
        return np.array(slots, dtype=np.int32), np.array([values[s] for s in slots], dtype=np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
