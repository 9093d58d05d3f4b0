"""Quality rules, quality classifier and language ID: brute force, gradients, held-out accuracy, edge rows."""

import re
import zlib
from collections import Counter

import duckdb
import llm_cases as cases
import numpy as np
import pytest

from sonde.llm import classifier, grams, labelled, language, rules
from sonde.llm.common import crc_of, table

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(len(w) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


def auc(labels, scores):
    labels, scores = np.array(labels), np.array(scores)
    good, bad = scores[labels == 1], scores[labels == 0]
    return float((good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean())


def qualities(sf=SF):
    return dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())


@pytest.fixture(scope="module")
def judged(spark):
    return rules.op3_quality_rules(spark, SF).collect()


def test_rules_measure_whole_texts(judged):
    docs = cases.texts(SF)
    assert sorted(r["doc_id"] for r in judged) == sorted(docs)
    for r in judged:
        n, chars, symbols, lines, repeats = plain_measures(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= rules.THRESHOLD)


def test_rules_keep_good_and_reject_bad(judged):
    quality = qualities()
    rest = [(quality[r["doc_id"]], r["kept"]) for r in judged if r["doc_id"] in quality and not r["base_failed"]]
    assert np.mean([kept for q, kept in rest if q == 1]) > 0.97
    assert np.mean([not kept for q, kept in rest if q == 0]) > 0.9


def test_measures_against_brute_force():
    words = re.compile(r"[^\x20\x09-\x0D]+")
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = "".join(rng.choice(list("ab $\n\t|"), rng.integers(0, 120)))
        assert rules.measures(text, words) == plain_measures(text)


def test_rules_edge_rows(spark):
    model = rules.fit([(1, np.array([1], np.int32), np.ones(1, np.float32)), (0, np.array([2], np.int32), np.ones(1, np.float32))] * 8)
    for known in (None, model):
        rows = rules.judged(cases.edge(spark), known).collect()
        assert len(rows) == len(cases.EDGE) and all(r["base_failed"] for r in rows if r["n_words"] < 10)
        by_id = {r["doc_id"]: r for r in rows}
        assert by_id[1]["n_words"] == 0 and by_id[4]["n_words"] == 80_000 and by_id[9]["n_dup_lines"] == 1
        kept = rules.passed(cases.edge(spark), known)
        assert kept.columns == cases.edge(spark).columns and kept.count() == sum(r["kept"] for r in rows)
        assert rules.judged(cases.empty(spark), known).count() == 0
    assert rules.trained(cases.empty(spark), spark.createDataFrame([], "doc_id long, quality int")) is None


def test_calibration_is_a_probability():
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 2, 4000)
    labels = (rng.random(4000) < grams.sigmoid(1.5 * scores - 1)).astype(float)
    slope, shift = rules.platt(scores, labels)
    assert slope == pytest.approx(1.5, abs=0.2) and shift == pytest.approx(-1, abs=0.2)


def test_slots_and_dot_agree():
    g = grams.Grams(12, 3)
    weights = np.random.default_rng(2).normal(size=1 << 12)
    for text in [None, "", "a", "a a a a", "Ein Satz, zwei Sätze!! \U0001F600", cases.LONG, "y" * 300_000]:
        slots, values = g.vector(text)
        assert g.dot(text, weights) == pytest.approx(float(weights[slots] @ values), rel=1e-4, abs=1e-4)


def plain_families(text, bits, chars):
    """Slots of the uni- and bigrams of tokens and of the character n-grams, listed one by one."""
    mask, shift = (1 << 64) - 1, 64 - bits

    def mixed(h):
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & mask
        return h ^ h >> 29

    def token(data):
        total, power = 0, 1
        for byte in data:
            total, power = (total + (byte + 1) * power) & mask, (power * 0x9E3779B97F4A7C15) & mask
        return mixed(total)
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x09-\x0d\x20]+", text.encode())
    h = [token(t) for t in tokens]
    pairs = [0x5851F42D4C957F2D if a == b else mixed((a * 0xA24BAED4963EE407 + b) & mask) for a, b in zip(h, h[1:])]
    letters = []
    for i in range(len(text) - chars + 1):
        g = 0
        for c in text[i:i + chars]:
            g = (g * 0xD1342543DE82EF95 + ord(c) + 1) & mask
        letters.append(mixed(g))
    return [[x >> shift for x in family] for family in (h, pairs, letters)]


@pytest.mark.parametrize("size", [7, 64, 1 << 18])
def test_families_equal_listed_ngrams(monkeypatch, size):
    monkeypatch.setattr(grams, "SLICE", size)
    g = grams.Grams(20, 3)
    texts = ["", "a", "ab cd", "z" * 300, "Ein Satz, zwei  Sätze!! \U0001F600é\n\n&&& the the", " " * 40 + "x", "ä" * 50 + "," * 50]
    if size == 1 << 18:
        texts = ["wörd, of 12!! " * 40_000 + "é" * 300_000 + " " * 200_000 + "end"]
        assert len(texts[0]) > 1_000_000
    for text in texts:
        assert [f.tolist() for f in g.families(text)] == plain_families(text, 20, 3)


def test_training_vectors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(labelled, "MOST_SLOTS", 5)
    docs = spark.createDataFrame([(1, "a " * 9 + " ".join(f"w{i}" for i in range(50)))], "doc_id long, text string")
    (label, slots, values), = labelled.sample(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), crc_of("doc_id") >= 0, 9, 18)
    assert label == 1 and len(slots) == len(values) == 5 and sorted(slots.tolist()) == slots.tolist() and values.max() > 1


def test_rules_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    quality = qualities()
    rows = rules.judged(docs, rules.trained(docs, labels, crc_of("doc_id") % 4 != 0)).collect()
    held = [(quality[r["doc_id"]], r["kept"]) for r in rows
            if r["doc_id"] in quality and not r["base_failed"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0]
    assert len(held) > 50
    assert np.mean([kept for q, kept in held if q == 1]) > 0.95
    assert np.mean([not kept for q, kept in held if q == 0]) > 0.85


def test_token_hashes_tell_tokens_apart():
    g = grams.Grams(18)
    words = ["the", "The", "eht", "a", "aa", "ä", "&&&", "&&", "th", "e", "x" * 100, "x" * 101]
    hashes = g.tokens(" ".join(words))
    assert len(set(hashes.tolist())) == len(words) == len(hashes)
    assert (g.tokens("some the, word")[1] == g.tokens("the")[0])


def test_ftrl_follows_its_closed_form():
    model = classifier.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(5), np.zeros(5)
    rng = np.random.default_rng(3)
    for _ in range(50):
        slots, values, label = rng.permutation(5)[:3], rng.random(3), float(rng.integers(0, 2))
        w = [0.0 if abs(z[s]) <= 0.1 else -(z[s] - np.sign(z[s]) * 0.1) / ((1.0 + n[s] ** 0.5) / 0.5 + 0.2) for s in slots]
        p = 1 / (1 + np.exp(-float(np.dot(w, values))))
        for s, value, weight in zip(slots, values, w):
            g = (p - label) * value
            z[s] += g - ((n[s] + g * g) ** 0.5 - n[s] ** 0.5) / 0.5 * weight
            n[s] += g * g
        model.update(slots, values, label)
    assert model.z == pytest.approx(z) and model.n == pytest.approx(n)


def test_classifier_on_held_out_rows(spark):
    rows = classifier.op4_quality_classifier(spark, SF).collect()
    quality = qualities()
    assert len(rows) == len(cases.texts(SF))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(quality[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert auc(*zip(*held)) > 0.97


def test_classifier_edge_rows(spark):
    labels = spark.createDataFrame([(4, 1, "x"), (8, 0, "x"), (9, 0, None), (10, 1, "x"), (None, 1, "x"), (7, None, "x"), (4, 1, "x")],
                                   "doc_id long, quality int, draw string")
    sampled = labelled.sample(cases.edge(spark), labels, crc_of("doc_id") % 5 != 9, 100, 12)
    assert sorted(r[0] for r in sampled) == [0, 0, 1, 1]
    weights = classifier.learned(sampled, 12, 2)
    for known in (None, np.zeros((1 << classifier.BITS) + 1, np.float32)):
        rows = classifier.scored(cases.edge(spark), known).collect()
        assert len(rows) == len(cases.EDGE) and {r["score"] for r in rows} == {0.5}
        assert classifier.passed(cases.edge(spark), known).columns == cases.edge(spark).columns
        assert classifier.scored(cases.empty(spark), known).count() == 0
    assert len(weights) == (1 << 12) + 1
    assert classifier.learned(labelled.sample(cases.empty(spark), labels, crc_of("doc_id") % 5 != 9, 100, 12)) is None


def test_backpropagation_through_time():
    rng = np.random.default_rng(4)
    model = language.BiGru(3, units=4)
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    windows, labels = rng.integers(0, 256, (5, 7)), np.array([0, 1, 2, 1, 0])
    inside = rng.random((5, 7)) < 0.8
    _, grads = model.gradients(windows, inside, labels)
    for name in model.NAMES:
        value = getattr(model, name)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in value.shape) if name != "e" else (rng.integers(0, 2), windows[0, 3], rng.integers(0, 12))
            old, eps = value[at], 1e-2
            value[at] = old + eps
            up = model.gradients(windows, inside, labels)[0]
            value[at] = old - eps
            down = model.gradients(windows, inside, labels)[0]
            value[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_pooling_reads_every_byte():
    model = language.BiGru(2)
    short, long = "abc " * 5, "abc " * 5 + "déjà vu " * 400
    p = language.pooled(model, [short, long, short])
    assert p.sum(axis=1) == pytest.approx(1) and p[0] == pytest.approx(p[2])
    windows, full, owner = language.laid_out([long])
    data = long.encode()
    assert b"".join(w.tobytes()[:n] for w, n in zip(windows, full)) == data and full.sum() == len(data)
    each = model.probabilities(model.states(windows)[0])
    mean = sum(each[:n, :, i].sum(axis=0) for i, n in enumerate(full)) / len(data)
    assert p[1] == pytest.approx(mean, abs=1e-4)


def test_language_on_held_out_rows(spark):
    rows = language.op7_language_id(spark, SF).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.97


def test_language_edge_rows(spark):
    names, model = language.learned(cases.edge(spark))
    assert set(names) <= {"en", "de", "fr"} and model
    rows = language.identified(cases.edge(spark), names, model).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(cases.EDGE) and {by_id[i]["lang_pred"] for i in (1, 2, 3)} == {"und"}
    assert all(r["lang_pred"] in names and 0 < r["score"] <= 1 for i, r in by_id.items() if i not in (1, 2, 3))
    assert language.learned(cases.empty(spark)) == ([], None)
    assert {r["lang_pred"] for r in language.identified(cases.edge(spark), [], None).collect()} == {"und"}
    assert language.identified(cases.empty(spark), names, model).count() == 0


def test_every_language_is_learned_from(spark, monkeypatch):
    """More languages than were learned before, one of them frequent; the rest keep one document at least."""
    monkeypatch.setattr(language, "OF_ALL", 60, raising=False)
    rows = [(i, f"text number {i} of language {i % 600}", f"l{i % 600}") for i in range(2400)] + [(5000 + i, f"word {i}", "big") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = {r["lang"] for r in docs.filter(crc_of("doc_id") % language.FOLDS != language.HELD_OUT).select("lang").distinct().collect()}
    sampled = language.sample(docs)
    assert len(taught) > 500 and {lang for lang, w in sampled if w} == taught and len(sampled) < 2 * len(taught)


def test_pooling_does_not_depend_on_its_portions(monkeypatch):
    model, texts = language.BiGru(90), ["abc " * 50, "d\u00e9j\u00e0 vu " * 400]
    whole = language.pooled(model, texts)
    monkeypatch.setattr(language, "WIDE", 3)
    assert language.pooled(model, texts) == pytest.approx(whole, abs=1e-6)
