"""Fingerprints, stupid backoff, licence scans and URL filters: SQL, brute force, edge rows."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import llm_cases as cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sonde.llm import licenses, ngrams, sketch, urls
from sonde.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall(text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_follow_their_texts(spark):
    rows = {r["doc_id"]: r for r in sketch.op6_document_fingerprints(spark, cases.SF).collect()}
    docs = cases.texts()
    order = sorted(docs, reverse=True)
    assert sorted(rows) == sorted(docs)
    errors, by_text = [], {}
    for doc, following in zip(order, order[1:] + order[:1]):
        text, other = docs[doc], docs[following]
        half = len(text) // 2
        changed = text[:len(text) - half] + other[:half]
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        own, new, nxt = shingles(text), shingles(changed), shingles(other)
        errors.append(r["near_edited"] - len(own & new) / max(1, len(own | new)))
        assert abs(r["near_next"] - len(own & nxt) / max(1, len(own | nxt))) < 0.3
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["contained_edited"] <= 1
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.07


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def test_sketch_keeps_hashes_below_the_fraction(spark):
    texts = [cases.LONG, "one two three", "", "a b c d e f g", None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    parts = sketch.with_sketch(frame, "text", "s").collect()
    spark_hash = {}
    for text, row in zip(texts, parts):
        words = WORDS.findall(text or "")
        grams = sorted({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}) if words else []
        hashes = []
        for gram in grams:
            state = 42
            for word in gram:  # xxhash64 of several columns: the hash of one seeds the next
                value = xxhash.xxh64_intdigest(word.encode(), 42)
                state = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), state)
            hashes.append(state)
        low = sorted(signed(h) for h in hashes if h < (1 << 64) // sketch.SCALE)
        assert row["s"] == (low or ([signed(min(hashes))] if hashes else []))
        spark_hash[text] = row["s"]
    assert len(spark_hash[cases.LONG]) > 1000


def test_fingerprints_merge(spark):
    frame = spark.createDataFrame([("a b c d e f g h i j " * 3, "k l m n o p q r s t " * 9)], "x string, y string")
    rows = sketch.with_sketch(sketch.with_sketch(frame, "x", "a"), "y", "b")
    got = rows.select(sketch.merged("a", "b").alias("m"), "a", "b", sketch.containment("a", "b").alias("c")).first()
    both = set(got["a"]) | set(got["b"])
    assert set(got["m"]) <= both and got["m"] == sorted(h for h in both if 0 <= h < (1 << 64) // sketch.SCALE) or len(got["m"]) == 1
    assert got["c"] == len(set(got["a"]) & set(got["b"])) / len(got["a"])


def test_next_document_edge_rows(spark):
    rows = sketch.with_next(cases.edge(spark)).collect()
    order = sorted(cases.EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    expected = Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in rows) == expected
    assert sketch.with_next(cases.empty(spark)).count() == 0
    one = sketch.with_next(cases.edge(spark).filter("doc_id = 4")).collect()
    assert [(r["text"], r["next_text"]) for r in one] == [(cases.LONG, cases.LONG)]


@pytest.mark.parametrize("rows", [3, 20_000])
def test_next_document_over_many_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(sketch, "RANGE_ROWS", rows)
    ids = sorted({int(i ** 1.7) for i in range(4000)} | {10 ** 12 + i for i in range(50)})
    frame = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: int(r["next_text"]) for r in sketch.with_next(frame).collect()}
    assert found == dict(zip(ids[1:] + ids[:1], ids[:1] * 0 + ids[:-1] + ids[-1:]))


def plain_scores(texts, order):
    docs = [WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]

    def counted(words):
        return Counter(tuple(words[i:i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1))
    whole = sum((counted(d) for d in docs), Counter())
    total, out = sum(map(len, docs)), []
    for words in docs:
        own, logs = counted(words), 0.0
        for i in range(len(words)):
            score = max(whole[(words[i],)] - own[(words[i],)], 1) / max(total - len(words), 1)
            for k in range(2, order + 1):
                gram = tuple(words[i - k + 1:i + 1])
                if i < k - 1:
                    break
                n = whole[gram] - own[gram]
                score = n / (whole[gram[:-1]] - own[gram[:-1]]) if n > 0 else 0.4 * score
            logs += math.log10(score)
        out.append((len(words), pytest.approx(logs, abs=1e-6)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(ngrams, "BLOCK_CHARS", 40_000)
    monkeypatch.setattr(ngrams, "BUCKET_GRAMS", 5_000)
    docs = sorted(cases.texts().items())[:80]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sorted(ngrams.scored(frame, order).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["log_score"]) for r in rows] == plain_scores([t for _, t in docs], order)


def test_backoff_against_sql(spark):
    cases.same_as_sql(spark, ngrams.op1_stupid_backoff, ngrams.SQL)


def test_backoff_edge_rows(spark):
    rows = ngrams.scored(cases.edge(spark)).collect()
    plain = plain_scores([r[1] for r in cases.EDGE], 2)
    expected = sorted(((str(r[0]), n, logs) for r, (n, logs) in zip(cases.EDGE, plain)), key=lambda x: x[:2])
    assert sorted(((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in rows), key=lambda x: x[:2]) == expected
    assert ngrams.scored(cases.empty(spark)).count() == 0


def test_licenses_against_sql(spark):
    cases.same_as_sql(spark, licenses.op10_license_scan, licenses.SQL, "/root/testdata/sf0.01")


def test_licenses_in_other_dress(spark):
    mit = licenses.TEXTS["MIT"]
    dressed = "Copyright (c) 2019 Somebody Else\n" + mit.replace("“", '"').upper().replace("SUBLICENSE", "sub-licence").replace(". ", ".\n\n  ")
    rows = [(1, dressed), (2, mit + "\nand more"), (3, "prose\nReleased under the MIT licence\nmore\nLICENSED UNDER CC BY-NC 4.0!"),
            (4, None), (5, ""), (6, "Copyright 2020 A\nAll rights reserved."), (7, licenses.TEXTS["ISC"]), (7, licenses.TEXTS["ISC"]),
            (8, "copyright notice and this permission notice shall be included")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in cases.CLASHING})
    found = sorted((r["doc_id"], r["license"], r["notices"]) for r in licenses.scanned(frame).collect())
    assert found == [(1, "MIT", ""), (2, None, ""), (3, None, "CC-BY-NC-4.0,MIT"), (4, None, ""), (5, None, ""), (6, None, ""),
                     (7, "ISC", ""), (7, "ISC", ""), (8, None, "")]
    digests = {r["doc_id"]: r["digest"] for r in licenses.scanned(frame).collect()}
    assert digests[4] == digests[5] == digests[6] != digests[8]
    assert licenses.scanned(cases.empty(spark)).count() == 0 and licenses.scanned(cases.edge(spark)).count() == len(cases.EDGE)
    assert licenses.scanned(frame, {}, {}).filter("license IS NOT NULL OR notices <> ''").count() == 0


def test_urls_against_sql(spark):
    cases.same_as_sql(spark, urls.op9_url_filters, urls.SQL)


def test_urls_edge_rows(spark):
    given = [None, "", "no scheme/com/de/", "http://", "HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org/es", "x://a://com/de/",
             "http://org/", "http://notexample.org/es/1", "http://shop.com/de/?a=/fr/", "http://shop.com?/de/", "http://example.org/en/12",
             "http://ÄB.com/fr/\n", "http://a..com/de/", "http://" + "a." * 5000 + "com/de/" + "p" * 20000]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(given + given)], "page_id long, url string, key string")
    rows = {r["page_id"]: r for r in urls.judged(frame).collect()}
    for i, url in enumerate(given + given):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for v, r in urls.RULES
                if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        best = max(fits, default=(0, None, "allow"))
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, best[1], best[2]), url
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert {r["verdict"] for r in urls.judged(frame, ()).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    """Small filters make many false positives; the levels must undo all of them."""
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 4000, 7)] + ["elsewhere"]
    cascade = urls.Cascade(listed, universe, 4000)
    assert len(cascade.levels) > 2
    wrong = universe.filter(cascade.has(F.col("key")) != F.col("key").isin(listed))
    assert wrong.count() == 0


def test_backoff_with_trigrams_against_sql(spark):
    cases.same_as_sql(spark, ngrams.op1_stupid_backoff_trigrams, ngrams.TRIGRAMS_SQL)


def test_backoff_with_trigrams_reads_two_words_back(spark):
    """Few words in many orders: most bigrams occur elsewhere, some trigrams do not."""
    docs = [(1, "a b c a b d"), (2, "b c a b d a"), (3, "a b d a b c"), (4, "c a b c"), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sorted(ngrams.scored(frame, ngrams.ORDER_WHOLE).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["log_score"]) for r in rows] == plain_scores([t for _, t in docs], ngrams.ORDER_WHOLE)


def test_small_encodings_lose_nothing():
    rng = np.random.default_rng(5)
    for keys in ([], [0], [2 ** 64 - 1], range(300), [0, 1, 2 ** 63, 2 ** 64 - 1], np.unique(rng.integers(0, 2 ** 64, 5000, dtype=np.uint64)),
                 np.unique(rng.integers(0, 2 ** 52, 5000, dtype=np.uint64)) + np.uint64(3 << 60)):
        keys = np.array(keys, dtype=np.uint64)
        assert np.array_equal(ngrams.from_hashes(ngrams.sorted_hashes(keys)), keys)
    assert ngrams.from_small(ngrams.small_numbers(np.array([0, 1, 254, 255, 256, 10 ** 12]))).tolist() == [0, 1, 254, 255, 256, 10 ** 12]


def test_long_license_texts_are_known(spark):
    names = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    rows = [(i, "Copyright (c) 2020 Somebody\n" + licenses.TEXTS.get(n, n).replace("\n", "\n\n  ").upper()) for i, n in enumerate(names)]
    found = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in found] == names
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert con.execute(licenses.SQL + " ORDER BY doc_id").fetchall() == [tuple(r) for r in found]
