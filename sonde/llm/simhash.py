"""SimHash near-duplicates: fingerprints by majority vote, links found through pigeonhole blocks.

Words are runs without ASCII white space, A-Z lower-cased; shingles are four words
joined by a space, repeats included (fewer words: all of them; none, null or empty
text: fingerprint zero). A bit is 1 if more than half of the shingles' XXH64 (seed
42) have it. Two fingerprints link if at most four bits differ; a document's
component is the smallest doc_id it reaches. Equal rows and ties fall into one
component, an empty table gives an empty result, other columns are ignored.

How links are found: the 64 bits are cut into ``blocks`` blocks, so that two linked
fingerprints agree in at least ``blocks - 4`` of them; each choice of so many
blocks is a join key. More fingerprints get more blocks, so that the keys stay rare;
every number of blocks finds every link. Buckets of one key are never expanded into
pairs: each member is first compared with the bucket's commonest fingerprint, which
joins a group of near copies by one link per member; afterwards only members of
different groups meet, and of these only those outside a bucket's largest group
look for partners.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import WORD, map_texts, table, written
from sonde.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a bucket compared with each other at most, and blocks that the bits left out by a larger bucket's key are cut into.
MOST_MEMBERS, FINER = 500, 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: re.Pattern, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    tokens = words.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not tokens:
        return 0
    joined, ends = b" ".join(tokens), np.cumsum([len(t) + 1 for t in tokens]) - 1
    last = max(len(tokens) - width, 0)
    starts = np.concatenate(([0], ends[:last] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(width, len(tokens)) - 1:].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        piece = np.array(hashes[at:at + 8192], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of ``docs`` (doc_id, text)."""
    def build():
        words = re.compile(WORD.encode())
        return lambda texts: ([np.array([fingerprint(t, words, width) for t in texts], dtype=np.uint64).view(np.int64)], None)
    return map_texts(docs, build, "fp long")


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` blocks, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in itertools.combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Fewest blocks, of 7 to 10, whose keys have three bits more than it takes to number ``n`` fingerprints."""
    return next((b for b in range(radius + 3, radius + 6) if 64 * (b - radius) // b >= n.bit_length() + 3), radius + 6)


def _far(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def finer_masks(mask: int, blocks: int = FINER, radius: int = RADIUS) -> list[int]:
    """``mask`` with every choice of ``blocks - radius`` blocks of the bits it leaves out, as signed longs."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << b for b in free[len(free) * i // blocks:len(free) * (i + 1) // blocks]) for i in range(blocks)]
    masks = {(mask % (1 << 64)) | sum(c) for c in itertools.combinations(parts, blocks - radius)}
    return sorted(m - (1 << 64) if m >= 1 << 63 else m for m in masks)


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """The rows of (key, fp, root, ...) whose bucket holds several groups, with the bucket's size in ``members``."""
    several = (rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
               .filter("low <> high").select("key", "members"))
    return rows.join(several, "key")


def small_buckets(rows: DataFrame, masks: list[int], radius: int = RADIUS) -> DataFrame:
    """key, fp, root in buckets of few members that hold every linked pair of different groups of the buckets of ``rows``.

    ``rows`` has key, fp, root, members, and its buckets' mask as a place in ``masks``. Every
    round halves the bits that large buckets leave out; members differ, so it ends.
    """
    done = rows.filter(F.col("members") <= MOST_MEMBERS).select("key", "fp", "root")
    large = rows.filter(F.col("members") > MOST_MEMBERS)
    while not large.isEmpty():
        # from each mask to its finer ones: as many rows as there are masks
        used = [r["at"] for r in large.select("at").distinct().collect()]
        finer = {at: finer_masks(masks[at], radius=radius) for at in used}
        masks = sorted({m for found in finer.values() for m in found})
        place = {m: i for i, m in enumerate(masks)}
        steps = rows.sparkSession.createDataFrame([(at, [(place[m], m) for m in found]) for at, found in finer.items()],
                                                  "at int, finer array<struct<at: int, mask: long>>")
        dealt = (large.join(F.broadcast(steps), "at").select("key", "fp", "root", F.explode("finer").alias("to"))
                 .select(F.xxhash64("key", "to.at", F.col("fp").bitwiseAND(F.col("to.mask"))).alias("key"), "fp", "root", F.col("to.at").alias("at")))
        rows = written(mixed_buckets(dealt), "finer")
        done = done.unionByName(rows.filter(F.col("members") <= MOST_MEMBERS).select("key", "fp", "root"))
        large = rows.filter(F.col("members") > MOST_MEMBERS)
    return done


def links(fps: DataFrame, blocks: int, radius: int = RADIUS) -> DataFrame:
    """fp, root of every fingerprint of ``fps`` (fp, copies: all different) that has a link."""
    numbers = block_masks(blocks, radius)
    masks = F.array(*[F.lit(m) for m in numbers])

    def key(choice, mask):
        return F.xxhash64(choice, F.col("fp").bitwiseAND(mask))
    keyed = (fps.select("fp", "copies", F.posexplode(masks).alias("choice", "mask"))
             .select("fp", "copies", key(F.col("choice"), F.col("mask")).alias("key")))
    # buckets of one member, nearly all, go first; the others get their commonest fingerprint and one by another order
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("copies", "fp"))["fp"].alias("pivot"),
                                       F.max(F.struct(F.xxhash64("fp").alias("h"), "fp"))["fp"].alias("pivot2")).filter("n > 1").drop("n")
    # without the hint Spark may broadcast the exploded keys: it takes them for as small as the fingerprints' file
    shared = written(keyed.drop("copies").join(buckets.hint("merge"), "key"), "shared")
    stars = None
    for pivot in ("pivot", "pivot2"):
        found = (shared.filter((F.col("fp") != F.col(pivot)) & (_far(F.col("fp"), F.col(pivot)) <= radius))
                 .select(F.col("fp").alias("a"), F.col(pivot).alias("b")).distinct())
        stars = found if stars is None else stars.unionByName(found)
    groups = written(components(stars), "groups")
    named = (shared.select("key", "fp").join(groups, F.col("fp") == F.col("node"), "left")
             .select("key", "fp", F.coalesce("root", "fp").alias("root")))
    left = written(mixed_buckets(named), "mixed")
    # the choice of blocks behind a key is found again for members of large buckets only
    choice = F.when(F.col("members") > MOST_MEMBERS, F.array_position(F.transform(masks, lambda m, i: key(i, m)), F.col("key")) - 1)
    left = small_buckets(left.withColumn("at", choice.cast("int")), numbers, radius)
    largest = (left.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
               .agg(F.max(F.struct("n", "root"))["root"].alias("top")))
    outside = (left.join(largest, "key").filter("root <> top")
               .select("key", F.col("fp").alias("fp2"), F.col("root").alias("root2")))
    across = (left.join(outside, "key")
              .filter((F.col("root") != F.col("root2")) & (_far(F.col("fp"), F.col("fp2")) <= radius))
              .select(F.col("root").alias("a"), F.col("root2").alias("b")).distinct())
    return components(across.unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text)."""
    marked = written(fingerprints(docs, width), "fingerprints")
    each = written(marked.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")), "distinct")
    roots = links(each, blocks_for(each.count(), radius), radius)
    named = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.join(lowest, "root").select("fp", "component_id")
    return marked.join(member, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component kept: the smallest by doc_id, then by a hash of all columns.

    A row counts by itself, also if others share its doc_id. Of a component's rows
    without a doc_id one stays too.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*cols, *[c.isNull() for c in cols])
    rows = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), row.alias("hash")))
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    numbered = found.filter("NOT doc_id.no_id AND doc_id = component_id").select(F.col("doc_id").alias("_row"))
    others = found.filter("doc_id.no_id").groupBy("component_id").agg(F.min("doc_id").alias("_row")).select("_row")
    first = numbered.unionByName(others).distinct()
    return rows.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def op8_simhash_groups(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES, CHECKS = {"op8_simhash_groups": op8_simhash_groups}, {}
