"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as windows of ``STEPS`` UTF-8 bytes, all of them, each by two small
gated recurrent networks, one in each direction. Every byte gets a probability of
every language from the two states at its place; a document's probabilities are the
means over its bytes. The network is trained in numpy by backpropagation through
time on windows of a bounded sample of documents.

Null texts and texts without a letter are ``und`` with score 0; so is everything if
there is nothing to learn from. Rows with null lang teach nothing. Equal texts get
equal results, an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import crc_of, map_texts, table, written

#: Bytes of a window, units of a direction.
STEPS, UNITS = 64, 8
#: Documents learned from for each language, of all languages together (at least one of each), windows of each document.
PER_LANGUAGE, OF_ALL, WINDOWS = 300, 150_000, 6
BATCH, EPOCHS, RATE = 128, 6, 0.01
FOLDS, HELD_OUT, UNKNOWN = 3, 1, "und"
#: Windows scored at once, up to so many languages; with more languages fewer.
WIDE, MANY = 2048, 64


def sigmoid(x):
    return np.tanh(x * 0.5) * 0.5 + 0.5


class BiGru:
    """Weights of both directions; states are columns, one for each window.

    For each direction ``e`` holds a column of 3 * units inputs (update gate, reset
    gate, candidate) for each byte, ``u`` the recurrent weights; ``w`` and ``b`` read
    the languages off the two states.
    """

    NAMES = ("e", "u", "w", "b")

    def __init__(self, languages: int, units: int = UNITS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.units = units
        self.e = rng.normal(0, 0.3, (2, 256, 3 * units)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (2, 3 * units, units)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (languages, 2 * units)).astype(np.float32)
        self.b = np.zeros((languages, 1), dtype=np.float32)

    def states(self, windows: np.ndarray, keep: bool = False):
        """States (direction, step, unit, window) after each byte; the second direction runs from the end."""
        n, steps = windows.shape
        h_all = np.empty((2, steps, self.units, n), dtype=np.float32)
        kept = []
        for d in (0, 1):
            inputs = np.ascontiguousarray(self.e[d].T)
            h = np.zeros((self.units, n), dtype=np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = inputs.take(windows[:, t], axis=1)
                r = self.u[d] @ h
                gates = sigmoid(x[:2 * self.units] + r[:2 * self.units])
                update, reset = gates[:self.units], gates[self.units:]
                back = r[2 * self.units:]
                new = np.tanh(x[2 * self.units:] + reset * back)
                if keep:
                    kept.append((d, t, h, update, reset, back, new))
                h = new + update * (h - new)
                h_all[d, t] = h
        return h_all, kept

    def probabilities(self, h_all: np.ndarray) -> np.ndarray:
        """Of each language at each byte: (step, language, window)."""
        half = self.units
        logits = self.w[:, :half] @ h_all[0] + self.w[:, half:] @ h_all[1] + self.b
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, windows: np.ndarray, inside: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss of all bytes and its gradients, by backpropagation through time."""
        h_all, kept = self.states(windows, keep=True)
        p = self.probabilities(h_all)
        weight = (inside.T / max(inside.sum(), 1)).astype(np.float32)  # (step, window)
        picked = p[:, labels, np.arange(len(labels))]
        loss = float(-(np.log(picked + 1e-9) * weight).sum())
        g = p * weight[:, None, :]
        g[:, labels, np.arange(len(labels))] -= weight
        grads = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        half = self.units
        for d in (0, 1):
            grads["w"][:, d * half:(d + 1) * half] = np.einsum("tln,tun->lu", g, h_all[d])
        grads["b"][:, 0] = g.sum(axis=(0, 2))
        carry = [np.zeros((half, len(windows)), dtype=np.float32) for _ in (0, 1)]
        for d, t, h, update, reset, back, new in reversed(kept):
            dh = carry[d] + self.w[:, d * half:(d + 1) * half].T @ g[t]
            dnew = dh * (1 - update) * (1 - new * new)
            dupdate = dh * (h - new) * update * (1 - update)
            dreset = dnew * back * reset * (1 - reset)
            dr = np.concatenate((dupdate, dreset, dnew * reset))
            grads["u"][d] += dr @ h.T
            np.add.at(grads["e"][d], windows[:, t], np.concatenate((dupdate, dreset, dnew)).T)
            carry[d] = dh * update + self.u[d].T @ dr
        return loss, grads

    def parts(self) -> tuple:
        return tuple(getattr(self, name) for name in self.NAMES)

    @classmethod
    def of(cls, parts: tuple) -> "BiGru":
        model = cls(len(parts[3]), parts[1].shape[2])
        for name, value in zip(cls.NAMES, parts):
            setattr(model, name, value)
        return model


def trained(windows: np.ndarray, inside: np.ndarray, labels: np.ndarray, languages: int, epochs: int = EPOCHS) -> BiGru:
    """A network fitted by Adam on windows (n, steps) whose bytes count where ``inside``."""
    model, rng = BiGru(languages), np.random.default_rng(5)
    first, second = [{n: np.zeros_like(getattr(model, n)) for n in model.NAMES} for _ in (0, 1)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            step += 1
            _, grads = model.gradients(windows[rows], inside[rows], labels[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                rate = RATE * 0.7 ** epoch
                getattr(model, name)[...] -= rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-6)
    return model


def laid_out(texts: list, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts: bytes (n, steps), bytes that count (n), text of each window (n)."""
    data = [t.encode("utf-8", "replace") for t in texts]
    padded = np.frombuffer(b"".join(d + bytes(-len(d) % steps) for d in data), dtype=np.uint8).reshape(-1, steps)
    n = np.array([-(-len(d) // steps) for d in data], dtype=np.int64)
    owner = np.repeat(np.arange(len(data)), n)
    full = np.full(len(padded), steps)
    for i, end in enumerate(np.cumsum(n)):
        if n[i]:
            full[end - 1] = len(data[i]) - steps * (n[i] - 1)
    return padded, full, owner


def pooled(model: BiGru, texts: list) -> np.ndarray:
    """Mean probability of each language over the bytes of each text."""
    windows, full, owner = laid_out(texts)
    sums, steps = np.zeros((len(texts), len(model.b))), windows.shape[1]
    wide = max(1, WIDE * MANY // max(MANY, len(model.b)))
    for at in range(0, len(windows), wide):
        part = windows[at:at + wide]
        p = model.probabilities(model.states(part)[0])
        ends = full[at:at + wide]
        if (ends < steps).any():
            p *= (np.arange(steps)[:, None] < ends[None, :])[:, None, :]
        each = p.sum(axis=0, dtype=np.float64)
        for k in range(each.shape[0]):
            sums[:, k] += np.bincount(owner[at:at + wide], each[k], len(texts))
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def sample(docs: DataFrame) -> list:
    """(lang, windows as bytes) of a bounded number of documents of each language outside the held-out fold.

    Every language has its documents of the lowest draw; many languages share ``OF_ALL``.
    """
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    known = docs.select("doc_id", "lang", "text").filter(usable & (crc_of("doc_id") % FOLDS != HELD_OUT)).select("doc_id", "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    counts = written(known.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("low")), "languages")
    each = min(PER_LANGUAGE, OF_ALL / max(counts.count(), 1))
    chosen = known.join(counts, "lang").filter((draw < 1.5 * each / F.col("n")) | (draw == F.col("low"))).select("doc_id", "lang").distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def build():
        def run(batch):
            out = []
            for text in batch:
                data = (text or "").encode("utf-8", "replace") if has_letter(text) else b""
                starts = np.random.default_rng(len(data)).integers(0, max(len(data) - STEPS, 0) + 1, WINDOWS) if data else []
                out.append(b"".join(data[a:a + STEPS].ljust(STEPS, b"\0") for a in sorted(set(map(int, starts)))))
            return [out], None
        return run
    cut = map_texts(texts, build, "windows binary").distinct()
    return [(r["lang"], r["windows"]) for r in cut.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "lang", "windows").collect()]


def learned(docs: DataFrame) -> tuple[list[str], BiGru | None]:
    """Languages, and a network that tells them apart."""
    rows = [(lang, np.frombuffer(w, np.uint8).reshape(-1, STEPS)) for lang, w in sample(docs) if w]
    names = sorted({lang for lang, _ in rows})
    if not names:
        return [], None
    windows = np.concatenate([w for _, w in rows])
    place = {lang: k for k, lang in enumerate(names)}
    labels = np.repeat([place[lang] for lang, _ in rows], [len(w) for _, w in rows])
    return names, trained(windows, windows > 0, labels, len(names))


def identified(docs: DataFrame, names: list[str], model: BiGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model and model.parts())

    def build():
        known = shared.value and BiGru.of(shared.value)

        def run(texts):
            real = [i for i, t in enumerate(texts) if known is not None and has_letter(t)]
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if real:
                p = pooled(known, [texts[i] for i in real])
                for i, row in zip(real, p):
                    best[i], score[i] = names[int(row.argmax())], row.max()
            return [best, score], None
        return run
    return map_texts(docs, build, "lang_pred string, score double").select(
        "doc_id", (crc_of("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identified(docs, *learned(docs))


QUERIES, CHECKS = {"op7_language_id": op7_language_id}, {}
