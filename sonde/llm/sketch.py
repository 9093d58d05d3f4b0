"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

Shingles are five words joined in order (fewer words: all of them). A fingerprint
holds the hashes below 2**64 / ``SCALE``, so it grows with its text: fingerprints of
parts merge by union, and containment of a short text in a long one can be estimated
as well as resemblance. A text with words of which no hash is that low keeps its
least hash instead, so that different short texts do not look alike; texts without
words, null among them, have the empty fingerprint, which resembles only itself.

The next document is found without sorting all documents in one place: ids are cut
into ranges of about equal numbers of rows, a window takes the next row inside a
range, and the last row of a range takes the first of the next range. Rows that
share a doc_id follow each other by descending text, rows without one come last. A
table of one row is its own next document, an empty one gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonde.llm.common import WORD, table, written

WIDTH, SCALE = 5, 4
#: Id ranges by quantile (a power of two), and rows above which a range is cut further.
RANGES, RANGE_ROWS = 1024, 5_000
_TOP = -(1 << 63)


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted array of kept shingle hashes of the column ``text``."""
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    n = F.size("_words")
    window = F.transform(F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))),
                         lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WIDTH)]))
    low = F.filter("_all", lambda h: (h >= 0) & (h < (1 << 64) // SCALE))
    # unsigned order: flip the top bit, take the least, flip back
    least = F.array_min(F.transform("_all", lambda h: h.bitwiseXOR(F.lit(_TOP)))).bitwiseXOR(F.lit(_TOP))
    return (df.withColumn("_words", words).withColumn("_all", F.when(n > 0, window).otherwise(F.array().cast("array<long>")))
            .withColumn("_low", F.array_sort(F.array_distinct(low)))
            .withColumn(name, F.when((F.size("_low") == 0) & (F.size("_all") > 0), F.array(least)).otherwise(F.col("_low")))
            .drop("_words", "_all", "_low"))


def resemblance(a: str, b: str) -> Column:
    """Estimated share of common shingles among all shingles of two texts."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, 1.0).otherwise(common / every)


def containment(a: str, b: str) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str, b: str) -> Column:
    """The fingerprint of two texts together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: (h >= 0) & (h < (1 << 64) // SCALE))
    flipped = F.array_min(F.transform(both, lambda h: h.bitwiseXOR(F.lit(_TOP)))).bitwiseXOR(F.lit(_TOP))
    return F.when((F.size(low) == 0) & (F.size(both) > 0), F.array(flipped)).otherwise(low)


def as_text(sketch: str) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def id_ranges(docs: DataFrame) -> Column:
    """A number that grows with doc_id and has about equally many rows; 0 for null."""
    cuts = [i / RANGES for i in range(1, RANGES)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 50 * RANGES).alias("cuts"), F.count("*").alias("n"),
                     F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if found["cuts"] is None:
        return F.lit(0).cast("long")
    bounds = [found["low"], *found["cuts"], found["high"]]
    parts = -(-found["n"] // (RANGES * RANGE_ROWS))
    steps = F.array(*[F.lit(RANGES >> i) for i in range(1, RANGES.bit_length())])
    lower = F.lit(bounds[1:-1])
    at = F.aggregate(steps, F.lit(0), lambda k, s: k + F.when(F.get(lower, k + s - 1) <= F.col("doc_id"), s).otherwise(0))
    if parts == 1:
        return F.coalesce(at, F.lit(0)).cast("long")
    low, high = F.get(F.lit(bounds[:-1]), at).cast("double"), F.get(F.lit(bounds[1:]), at).cast("double")
    share = F.when(high > low, (F.col("doc_id") - low) / (high - low)).otherwise(0.0)
    inner = F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1))
    return F.coalesce(at * parts + inner, F.lit(0)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text (of the next row by descending doc_id, round the table) of ``docs``."""
    rows = docs.select("doc_id", "text").withColumn("range", id_ranges(docs))
    follow = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    led = rows.withColumn("next", F.lead(F.struct("text")).over(follow))
    # the first row of each range, by id alone; its text is fetched for these few rows only
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("top"))
    downward = Window.orderBy(F.col("range").desc())
    whole = Window.partitionBy(F.lit(0))
    after = (tops.withColumn("first", F.max_by(F.struct("range", "top"), "range").over(whole))
             .withColumn("then", F.coalesce(F.lead(F.struct("range", "top")).over(downward), F.col("first")))
             .select("range", F.col("then.range").alias("next_range"), F.col("then.top").alias("next_top")))
    after = written(after, "ranges")
    first = (rows.join(after.select(F.col("next_range").alias("range"), F.col("next_top")), "range")
             .filter(F.col("doc_id").eqNullSafe(F.col("next_top")))
             .groupBy("range").agg(F.max("text").alias("edge_text")).withColumnRenamed("range", "next_range"))
    edges = after.join(first, "next_range", "left").select(F.col("range"), F.struct(F.col("edge_text").alias("text")).alias("edge"))
    return (led.join(edges, "range", "left").withColumn("next_text", F.coalesce("next", "edge")["text"])
            .select("doc_id", "text", "next_text"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with the second half of its code points replaced by as many of ``other``, or all."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def op6_document_fingerprints(spark, sf_dir):
    rows = with_next(table(spark, sf_dir, "documents")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("next_text", F.lit("")).alias("next_text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    for text, name in (("text", "own"), ("edited", "changed"), ("next_text", "following")):
        rows = with_sketch(rows, text, name)
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
                       resemblance("own", "changed").alias("near_edited"), resemblance("own", "following").alias("near_next"),
                       containment("own", "changed").alias("contained_edited"))


QUERIES, CHECKS = {"op6_document_fingerprints": op6_document_fingerprints}, {}
