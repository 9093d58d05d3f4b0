"""Vector code compression: product quantisation in exact integers.

Components become integers floor(scale * x); a vector is cut into equal consecutive
parts, and a part is coded by the nearest entry of its position's codebook (squared
Euclidean distance, ties to the lower index). Codebooks start as the vectors of the
smallest ids; a round assigns all parts and moves every entry that has any to the
componentwise floor of their mean.

Distances come from exact matrix products: integers are broken into limbs so small
that every float64 BLAS product of two limbs stays below 2^53, and the dot products
are put together again in int64, or in Python's integers where a distance would not
fit. A round reads the vectors where they are; a task keeps one sum per entry and
component, Spark adds these up, and the driver holds the codebooks only.

Rows whose vector is null or holds a null, NaN or infinite component are dropped.
Vectors shorter than the longest are taken as filled up with zeros, as is a length
that the number of parts does not divide. Repeated rows count as often as they
occur; equal or null ids follow the order of their vectors, null ids last. Null
labels are one label. Errors beyond a long are given as the largest long. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import meet, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors multiplied at a time, bits of a limb of a sum, and of the number of rows a task may add up.
BATCH, SUM_BITS, ROW_BITS = 4096, 31, 40
_MOST = (1 << 63) - 1


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as float64 limbs of ``bits`` bits, the lowest first; only the highest has a sign."""
    out = []
    while values.size and max(abs(int(values.min())), abs(int(values.max()))) >= 1 << bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products of the rows of ``x`` with those of ``c`` (both int64 or both object)."""
    bits = (53 - max(x.shape[1] - 1, 1).bit_length()) // 2
    total = np.zeros((len(x), len(c)), dtype=x.dtype)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64).astype(x.dtype) << bits * (i + j)
    return total


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the first nearest row of ``c`` for each row of ``x``."""
    most = max(int(abs(v.astype(object)).max(initial=0)) for v in (x, c))
    kind = np.int64 if x.shape[1] * (2 * most) ** 2 <= _MOST else object
    x, c = x.astype(kind), c.astype(kind)
    far = (x * x).sum(axis=1)[:, None] - 2 * products(x, c) + (c * c).sum(axis=1)[None, :]
    at = np.argmin(far, axis=1)
    return at, far[np.arange(len(x)), at]


def integers(vectors, width: int, scale: int = SCALE) -> np.ndarray:
    """The vectors of an Arrow list column as integer rows of ``width``: int64, or object where that is too small."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * scale)
    if np.abs(scaled).max(initial=0) < 1 << 62:
        flat = scaled.astype(np.int64)
    else:
        flat = np.array([math.floor(Fraction(v) * scale) for v in flat.tolist()], dtype=object)
    out = np.zeros((len(lengths), width), dtype=flat.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class Codebooks:
    """``books[p][e]``: the integers of entry ``e`` for part position ``p``, each ``step`` long."""

    def __init__(self, books: list, step: int):
        self.books, self.step = books, step

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for entry in book for v in entry).encode()).hexdigest()

    def arrays(self) -> list[np.ndarray]:
        # int64 where that is enough; rows of no components keep their number
        out = []
        for book in self.books:
            small = all(abs(v) < 1 << 62 for entry in book for v in entry)
            out.append(np.array(book, dtype=np.int64 if small else object).reshape(len(book), self.step))
        return out


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows with a whole vector."""
    good = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vectors.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & good)


def first_books(kept: DataFrame, step: int, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    import pyarrow as pa
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    rows = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), step * parts, scale).tolist()
    return Codebooks([[row[p * step:(p + 1) * step] for row in rows] for p in range(parts)], step)


def moved(kept: DataFrame, books: Codebooks, biggest: float, scale: int) -> Codebooks:
    """The codebooks after one round over all vectors."""
    step, parts = books.step, len(books.books)
    pieces = ((int(biggest) * scale + 1).bit_length() + ROW_BITS) // SUM_BITS + 1
    shared = kept.sparkSession.sparkContext.broadcast(books.arrays())

    def sums(batches):
        import pyarrow as pa
        now = shared.value
        total = [np.zeros((len(book), step), dtype=object) for book in now]
        count = [np.zeros(len(book), dtype=np.int64) for book in now]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = integers(batch.column(0).slice(at, BATCH), step * parts, scale)
                # a batch's sums stay below 2^63, or are Python's integers
                safe = x.dtype != object and np.abs(x).max(initial=0) < 1 << 48
                for p, book in enumerate(now):
                    part = x[:, p * step:(p + 1) * step]
                    entry, _ = nearest(part, book)
                    added = np.zeros(total[p].shape, dtype=np.int64 if safe else object)
                    np.add.at(added, entry, part)
                    total[p] += added
                    count[p] += np.bincount(entry, minlength=len(book))
        rows = [(p, e, int(count[p][e]), [v for value in total[p][e] for v in split(value, pieces)])
                for p in range(parts) for e in np.flatnonzero(count[p]).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "entry", "n", "sums"])

    found = kept.select("embedding").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(step * pieces)]).alias("sums"))
    new = [list(book) for book in books.books]
    for row in added.collect():  # one for each entry at most
        whole = [sum(v << SUM_BITS * k for k, v in enumerate(row["sums"][i * pieces:(i + 1) * pieces])) for i in range(step)]
        new[row["part"]][row["entry"]] = [v // row["n"] for v in whole]
    return Codebooks(new, step)


def split(value: int, pieces: int) -> list[int]:
    """An integer as ``pieces`` numbers of ``SUM_BITS`` bits, the lowest first; only the highest has a sign."""
    value = int(value)
    return [(value >> SUM_BITS * k) & ((1 << SUM_BITS) - 1) for k in range(pieces - 1)] + [value >> SUM_BITS * (pieces - 1)]


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all vectors of ``kept`` (see ``finite``)."""
    if not 0 < entries <= 256:
        raise ValueError("a code digit pair tells at most 256 entries apart")
    known = kept.agg(F.max(F.size("embedding")).alias("width"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("biggest")).first()
    step = -(-(known["width"] or 0) // parts)
    books = first_books(kept, step, parts, entries, scale)
    for _ in range(rounds if step else 0):
        books = moved(kept, books, known["biggest"], scale)
    return books


def coded(kept: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error of every vector; vectors longer than the books' are not allowed."""
    step, parts = books.step, len(books.books)
    shared = kept.sparkSession.sparkContext.broadcast(books.arrays())
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                rows = batch.slice(at, BATCH)
                x = integers(rows.column(2), step * parts, scale)
                found = [nearest(x[:, p * step:(p + 1) * step], book) for p, book in enumerate(shared.value)]
                digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
                error = [min(sum(int(far) for far in row), _MOST) for row in zip(*(far.tolist() for _, far in found))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([d.tobytes().hex() for d in digits], pa.string()), pa.array(error, pa.int64())],
                                                 names=["vec_id", "label", "code", "error"])
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of ``vectors`` (vec_id, embedding, label)."""
    kept = finite(vectors)
    books = trained(kept, parts, entries, rounds, scale)
    rows = written(coded(kept, books, scale), "codes")
    totals = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    totals = totals.withColumn("label_error", F.least("label_error", F.lit(_MOST).cast("decimal(38,0)")).cast("long"))
    return meet(rows, written(totals, "label-errors"), "label", "n", rows.count()).withColumn("codebooks_sha256", F.lit(books.digest()))


def op12_vector_codes(spark, sf_dir):
    found = compressed(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(k: int) -> str:
    """One assignment of the parts to the entries of ``book{k}`` and the entries after it."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT p.rn, p.p, arg_min(b.e, (p.xx - 2 * list_dot_product(p.x, b.c) + b.cc)::BIGINT * {ENTRIES} + b.e) AS e
  FROM part p JOIN book{k} b ON b.p = p.p GROUP BY ALL),
mean{k} AS (
  SELECT p, e, list(v ORDER BY j) AS c
  FROM (SELECT n.p, n.e, j, floor(sum(p.x[j]) / count(*)) AS v
        FROM near{k} n JOIN part p ON p.rn = n.rn AND p.p = n.p, unnest(range(1, p.w + 1)) AS u(j) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT p, e, c, list_dot_product(c, c) AS cc FROM (
    SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)),"""


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, len(embedding) // {PARTS} AS w,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT rn, p, w, x, list_dot_product(x, x) AS xx
  FROM (SELECT rn, p, w, v[p * w + 1:(p + 1) * w] AS x FROM kept, unnest(range({PARTS})) AS u(p))),
book0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x AS c, xx AS cc FROM part WHERE rn <= {ENTRIES}),{"".join(map(_round, range(ROUNDS)))}
last AS (
  SELECT p.rn, p.p, min((p.xx - 2 * list_dot_product(p.x, b.c) + b.cc)::BIGINT * {ENTRIES} + b.e) AS best
  FROM part p JOIN book{ROUNDS} b ON b.p = p.p GROUP BY ALL),
code AS (
  SELECT rn, lower(string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p)) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM last GROUP BY rn)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c[j]::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) FROM book{ROUNDS}, unnest(range(1, len(c) + 1)) AS u(j)) AS codebooks_sha256
FROM code c JOIN kept k ON k.rn = c.rn
"""
QUERIES, CHECKS = {"op12_vector_codes": op12_vector_codes}, {"op12_vector_codes": SQL}
