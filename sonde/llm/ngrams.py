"""Stupid-backoff scores of all documents under n-gram counts of all documents.

Words are runs without ASCII white space, A-Z lower-cased. A word scores the count
of its n-gram over the count of the n-gram's history, both without the document's
own occurrences; an n-gram seen nowhere else backs off to a history shorter by one
word at ``ALPHA`` times that score. A single word scores its count over all words; one
seen nowhere else counts once. A document's score is the sum of the logarithms.

How it is joined: documents are dealt into blocks. A block lists each of its distinct
n-grams once with its count, cut by hash into buckets. A bucket holds all listings of
its n-grams and so the count table of its share of the hashes: it sums the counts
and answers every block, in the order asked, with the counts of the other blocks.
Blocks meet their answers again and score their words. Texts, hashes and counts are
shuffled in small encodings that lose nothing. A frequent n-gram costs one listing a block; a bucket's size follows
from the number of buckets, which follows from the number of words.

Registered twice: with three words to an n-gram (``ORDER_WHOLE``), and with two (``ORDER``).

Null, empty and blank texts have no words and score 0. Equal rows score alike (each
counts the others as other documents), an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import WORD, count_words, map_texts, table
from sonde.llm.grams import mixed

ORDER, ORDER_WHOLE, ALPHA = 2, 3, 0.4
#: Characters of a block of documents, and n-grams listed in a bucket, about.
BLOCK_CHARS, BUCKET_GRAMS = 4_000_000, 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def small_text(text: str | None) -> bytes:
    """The UTF-8 of a text, A-Z lower-cased, deflated."""
    return zlib.compress((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def small_numbers(n: np.ndarray) -> bytes:
    """Counts, deflated: a byte each, and eight more for those of 255 and above, after their number."""
    return zlib.compress(b"".join((len(n).to_bytes(8, "little"), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype("<u8").tobytes())))


def from_small(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=8 + n)
    return out


def sorted_hashes(keys: np.ndarray) -> bytes:
    """Rising hashes as the steps between them: the low bytes, the byte above them in a Huffman code, and the steps that need more."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8)
    width = next((w for w in range(1, 8) if 1000 * np.count_nonzero(steps >> np.uint64(8 * w)) <= len(keys)), 8)
    wide = np.flatnonzero(steps >> np.uint64(8 * width)) if width < 8 else np.zeros(0, np.int64)
    code = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    top = code.compress(planes[:, width - 1].tobytes()) + code.flush()
    return b"".join((np.array([len(keys), width, len(wide)], "<u8").tobytes(), planes[:, :width - 1].tobytes(),
                     wide.astype("<u8").tobytes(), steps[wide].tobytes(), top))


def from_hashes(data: bytes) -> np.ndarray:
    n, width, wide = np.frombuffer(data, "<u8", 3).astype(np.int64).tolist()
    at = 24 + n * (width - 1)
    planes = np.zeros((n, 8), dtype=np.uint8)
    planes[:, :width - 1] = np.frombuffer(data, np.uint8, n * (width - 1), 24).reshape(n, width - 1)
    planes[:, width - 1] = np.frombuffer(zlib.decompress(data[at + 16 * wide:], -15), np.uint8)
    steps = planes.view("<u8").ravel()
    steps[np.frombuffer(data, "<u8", wide, at).astype(np.int64)] = np.frombuffer(data, "<u8", wide, at + 8 * wide)
    return np.cumsum(steps, dtype=np.uint64)


class Block:
    """The n-grams of some documents.

    ``keys`` are the sorted hashes of all distinct n-grams, ``own[k]`` the place in
    ``keys`` of the (k+1)-gram that ends at each word, ``doc`` each word's document.
    """

    def __init__(self, texts, order: int):
        words, seen, doc = re.compile(WORD.encode()), {}, []
        ids = []
        for text in texts:
            found = words.findall(zlib.decompress(text))
            ids.extend([seen.setdefault(w, len(seen)) for w in found])
            doc.append(len(found))
        self.lengths = np.array(doc, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(doc)), self.lengths)
        one = mixed(np.array([xxhash.xxh64_intdigest(w, 1) for w in seen], dtype=np.uint64))
        now = one[np.array(ids, dtype=np.int64)] if ids else np.zeros(0, dtype=np.uint64)
        base, kinds = now, [now]
        for k in range(1, order):
            longer = mixed(kinds[-1][:-1] * np.uint64(0xA24BAED4963EE407) + base[1:] + np.uint64(k))
            kinds.append(np.concatenate((now[:1], longer)))  # the first k words of a document are masked by ``depth``
        first = np.cumsum(self.lengths) - self.lengths
        self.depth = np.arange(len(now)) - np.repeat(first, self.lengths)  # words before this one
        real = [self.depth >= k for k in range(order)]
        self.keys, place, self.counts = np.unique(np.concatenate([g[m] for g, m in zip(kinds, real)]), return_inverse=True, return_counts=True)
        self.own, at = [], 0
        for m in real:
            column = np.full(len(now), -1, dtype=np.int64)
            column[m] = place[at:at + int(m.sum())]
            at += int(m.sum())
            self.own.append(column)

    def cuts(self, bits: int) -> np.ndarray:
        """Edges of the buckets in ``keys``: a bucket is the highest ``bits`` bits of a hash."""
        if not bits:
            return np.array([0, len(self.keys)])
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.concatenate(([0], np.searchsorted(self.keys, edges), [len(self.keys)]))

    def elsewhere(self, totals: np.ndarray) -> list[np.ndarray]:
        """For each order, how often the n-gram that ends at each word occurs in other documents (-1: there is none)."""
        out = []
        for column in self.own:
            there = column >= 0
            _, place, own = np.unique(self.doc[there] * (len(self.keys) + 1) + column[there], return_inverse=True, return_counts=True)
            found = np.full(len(column), -1, dtype=np.int64)
            found[there] = totals[column[there]] - own[place]
            out.append(found)
        return out

    def scores(self, totals: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 scores, and number of words whose longest n-gram occurs elsewhere, for each document."""
        counts = self.elsewhere(totals)
        rest = np.maximum(words - self.lengths, 1)[self.doc]
        score = np.maximum(counts[0], 1) / rest
        hit = counts[0] > 0
        for k in range(1, len(counts)):
            history = np.concatenate(([1], counts[k - 1][:-1]))
            hit = np.where(self.depth >= k, counts[k] > 0, hit)
            longer = np.divide(counts[k], history, out=np.zeros(len(history)), where=counts[k] > 0)
            score = np.where(counts[k] > 0, longer, np.where(self.depth >= k, ALPHA * score, score))
        n = len(self.lengths)
        return np.bincount(self.doc, np.log10(score), n), np.bincount(self.doc, hit, n)


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_seen (words whose longest n-gram occurs elsewhere), log_score of every row of ``docs`` (doc_id, text)."""
    total = docs.agg(F.sum(count_words(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("chars")).first()
    words, chars = int(total["words"] or 0), int(total["chars"] or 0)
    blocks = max(1, -(-chars // BLOCK_CHARS))
    bits = max(0, (words * order // BUCKET_GRAMS).bit_length())
    small = map_texts(docs, lambda: lambda texts: ([[small_text(t) for t in texts]], None), "text binary")
    dealt = small.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows["text"], order)
        cuts = block.cuts(bits)
        full = np.flatnonzero(np.diff(cuts))
        return pd.DataFrame({"bucket": full, "block": np.full(len(full), rows["block"].iloc[0]),
                             "keys": [sorted_hashes(block.keys[cuts[b]:cuts[b + 1]]) for b in full],
                             "counts": [small_numbers(block.counts[cuts[b]:cuts[b + 1]]) for b in full]})

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [from_hashes(k) for k in rows["keys"]]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([from_small(c) for c in rows["counts"]])
        others = np.bincount(place, counts).astype(np.int64)[place] - counts
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"],
                             "others": [small_numbers(part) for part in np.split(others, ends[:-1])]})

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows["text"], order)
        found = [from_small(t) for t in answers.sort_values("bucket")["others"]]
        others = np.concatenate([*found, np.zeros(0, np.int64)])
        logs, seen = block.scores(block.counts + others, words)
        return pd.DataFrame({"doc_id": rows["doc_id"], "n_words": block.lengths, "n_seen": seen.astype(np.int64), "log_score": logs})

    asked = dealt.groupBy("block").applyInPandas(ask, "bucket long, block long, keys binary, counts binary")
    answered = asked.groupBy("bucket").applyInPandas(answer, "block long, bucket long, others binary")
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(
        score, f"doc_id {kind}, n_words long, n_seen long, log_score double")


def op1_stupid_backoff_trigrams(spark, sf_dir):
    rows = scored(table(spark, sf_dir, "documents"), ORDER_WHOLE)
    return rows.select("doc_id", "n_words", "n_seen", F.round("log_score", 4).alias("log_score"))


def op1_stupid_backoff(spark, sf_dir):
    rows = scored(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_seen", F.round("log_score", 4).alias("log_score"))


SQL = rf"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents),
sizes AS MATERIALIZED (SELECT doc_id, len(words) AS n_words, greatest(sum(len(words)) OVER () - len(words), 1)::DOUBLE AS rest FROM texts),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
pairs AS MATERIALIZED (SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM placed),
own1 AS (SELECT doc_id, word, count(*) AS n FROM pairs GROUP BY ALL),
rest1 AS MATERIALIZED (SELECT doc_id, word, sum(n) OVER (PARTITION BY word) - n AS n FROM own1),
own2 AS (SELECT doc_id, before, word, count(*) AS times FROM pairs WHERE before IS NOT NULL GROUP BY ALL),
rest2 AS MATERIALIZED (SELECT doc_id, before, word, times, sum(times) OVER (PARTITION BY before, word) - times AS n FROM own2),
parts AS (
  SELECT f.doc_id, 1 AS times, CASE WHEN r.n > 0 THEN 1 ELSE 0 END AS seen, greatest(r.n, 1) / s.rest AS score
  FROM pairs f JOIN rest1 r ON r.doc_id = f.doc_id AND r.word = f.word JOIN sizes s ON s.doc_id = f.doc_id WHERE f.before IS NULL
  UNION ALL
  SELECT p.doc_id, p.times, CASE WHEN p.n > 0 THEN 1 ELSE 0 END,
         CASE WHEN p.n > 0 THEN p.n / h.n::DOUBLE ELSE {ALPHA} * (greatest(r.n, 1) / s.rest) END
  FROM rest2 p JOIN rest1 h ON h.doc_id = p.doc_id AND h.word = p.before JOIN rest1 r ON r.doc_id = p.doc_id AND r.word = p.word
       JOIN sizes s ON s.doc_id = p.doc_id),
sums AS (SELECT doc_id, sum(times * seen)::BIGINT AS n_seen, sum(times * log10(score)) AS log_score FROM parts GROUP BY doc_id)
SELECT s.doc_id, s.n_words::BIGINT AS n_words, coalesce(p.n_seen, 0) AS n_seen, round(coalesce(p.log_score, 0), 4) AS log_score
FROM sizes s LEFT JOIN sums p ON p.doc_id = s.doc_id
"""
TRIGRAMS_SQL = rf"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents),
sizes AS MATERIALIZED (SELECT doc_id, len(words) AS n_words, greatest(sum(len(words)) OVER () - len(words), 1)::DOUBLE AS rest FROM texts),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
grams AS MATERIALIZED (
  SELECT doc_id, pos, word, lag(word) OVER w AS before, lag(word, 2) OVER w AS before2 FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
own1 AS (SELECT doc_id, word, count(*) AS n FROM grams GROUP BY ALL),
rest1 AS MATERIALIZED (
  SELECT o.doc_id, word, sum(n) OVER (PARTITION BY word) - n AS n, greatest(sum(n) OVER (PARTITION BY word) - n, 1) / rest AS score
  FROM own1 o JOIN sizes s ON s.doc_id = o.doc_id),
own2 AS (SELECT doc_id, before, word, count(*) AS times FROM grams WHERE pos >= 2 GROUP BY ALL),
rest2 AS (SELECT doc_id, before, word, sum(times) OVER (PARTITION BY before, word) - times AS n FROM own2),
two AS MATERIALIZED (
  SELECT p.doc_id, p.before, p.word, p.n, CASE WHEN p.n > 0 THEN p.n / h.n::DOUBLE ELSE {ALPHA} * r.score END AS score
  FROM rest2 p JOIN rest1 h ON h.doc_id = p.doc_id AND h.word = p.before JOIN rest1 r ON r.doc_id = p.doc_id AND r.word = p.word),
own3 AS (SELECT doc_id, before2, before, word, count(*) AS times FROM grams WHERE pos >= 3 GROUP BY ALL),
rest3 AS (SELECT doc_id, before2, before, word, times, sum(times) OVER (PARTITION BY before2, before, word) - times AS n FROM own3),
parts AS (
  SELECT g.doc_id, 1 AS times, CASE WHEN r.n > 0 THEN 1 ELSE 0 END AS seen, r.score
  FROM grams g JOIN rest1 r ON r.doc_id = g.doc_id AND r.word = g.word WHERE g.pos = 1
  UNION ALL
  SELECT g.doc_id, 1, CASE WHEN p.n > 0 THEN 1 ELSE 0 END, p.score
  FROM grams g JOIN two p ON p.doc_id = g.doc_id AND p.before = g.before AND p.word = g.word WHERE g.pos = 2
  UNION ALL
  SELECT t.doc_id, t.times, CASE WHEN t.n > 0 THEN 1 ELSE 0 END, CASE WHEN t.n > 0 THEN t.n / h.n::DOUBLE ELSE {ALPHA} * p.score END
  FROM rest3 t JOIN two h ON h.doc_id = t.doc_id AND h.before = t.before2 AND h.word = t.before
       JOIN two p ON p.doc_id = t.doc_id AND p.before = t.before AND p.word = t.word),
sums AS (SELECT doc_id, sum(times * seen)::BIGINT AS n_seen, sum(times * log10(score)) AS log_score FROM parts GROUP BY doc_id)
SELECT s.doc_id, s.n_words::BIGINT AS n_words, coalesce(p.n_seen, 0) AS n_seen, round(coalesce(p.log_score, 0), 4) AS log_score
FROM sizes s LEFT JOIN sums p ON p.doc_id = s.doc_id
"""
QUERIES = {"op1_stupid_backoff_trigrams": op1_stupid_backoff_trigrams, "op1_stupid_backoff": op1_stupid_backoff}
CHECKS = {"op1_stupid_backoff_trigrams": TRIGRAMS_SQL, "op1_stupid_backoff": SQL}
