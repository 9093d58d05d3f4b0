"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Only the number of pieces of each length decides a packing, and there are at most
``CAPACITY`` lengths: Spark counts them, the driver packs the counts (never the
pieces), and each piece finds its place by its rank among the pieces of its length.
The reduction first fixes sets that provably beat every other way to fill the
sequence of their largest piece; the rest is packed best-fit, longest first.

Null text counts as empty: its document is the single closing id 0. Documents of
more than ``CAPACITY`` ids are cut into pieces of that length, the first one taking
what is left over. Equal rows are packed once each, ties rank in any order, an
empty table gives an empty result, other columns are ignored. Very long texts are
tokenised whole.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonde.llm.common import map_texts, table, written

CAPACITY, CLOSING = 2048, 0
#: Pieces of one length are ranked in so many parts at least, and in parts of about so many rows.
PARTS, PART_ROWS = 64, 200_000


#: White space as the vocabulary's pattern knows it, and the length from which a run of it is cut out by hand.
BLANKS, LONG_RUN = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 1000


def encoder(path: str | None = None):
    """The ranks file of the public byte-level vocabulary ``byte_bpe_50k`` as a function text -> ids.

    The library differs from the one that reads ``byte_bpe_50k.json`` (four times as
    fast); vocabulary, pattern, added tokens (read from the JSON, met anywhere in a
    text) and ids are the same, which tests hold. Its pattern engine gives up on white
    space of about a million characters: such texts are cut where the pattern cuts
    them, before the last blank of a long run, or behind it at the end of a stretch.
    """
    import public_tokenizers
    import tiktoken
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    runs = re.compile(f"[{BLANKS}]{{{LONG_RUN},}}(?=([^{BLANKS}])?)")
    stretches = re.compile("|".join(map(re.escape, added)) or "(?!)")

    def stretch(text: str) -> list[int]:
        """The ids of a text without added tokens."""
        ids, at = [], 0
        for run in runs.finditer(text):
            end = run.end() - (run.group(1) is not None)
            ids += own.encode_ordinary(text[at:run.start()])
            ids += own._encode_single_piece(text[run.start():end].encode())
            at = end
        return ids + own.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        try:
            return own.encode(text, allowed_special="all")
        except ValueError:
            ids, at = [], 0
            for token in stretches.finditer(text):
                ids += [*stretch(text[at:token.start()]), added[token.group()]]
                at = token.end()
            return ids + stretch(text[at:])
    return encode


def cut(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document: full pieces, a shorter one at the front."""
    front = length % capacity or min(length, capacity)
    return [0, *range(front, length, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept) of ``docs`` (doc_id, text)."""
    def build():
        encode = encoder(tokenizer)

        def run(texts):
            row, columns = [], ([], [], [], [], [])
            for at, text in enumerate(texts):
                ids = np.array(encode(text or "") + [CLOSING], dtype="<u4")
                starts = cut(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    row.append(at)
                    for column, value in zip(columns, (piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tolist() if keep_ids else None)):
                        column.append(value)
            typed = [np.array(columns[0], dtype=np.int32), *[np.array(c, dtype=np.int64) for c in columns[1:4]]]
            return typed + ([columns[4]] if keep_ids else []), row
        return run
    return map_texts(docs, build, "piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))


class Plan:
    """Sequences for a count of pieces per length.

    ``places`` has rows (length, from_rank, to_rank, first_sequence, per_sequence,
    offset): the pieces of a length with these ranks fill sequences in a row.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.places, self.sequences = capacity, [], 0
        self.left = np.zeros(capacity + 1, dtype=object)
        for length, n in counts.items():
            self.left[length] = n
        self.ranked = [0] * (capacity + 1)
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def put(self, length: int, first: int, sequences: int, each: int, offset: int) -> None:
        n = sequences * each
        self.places.append((length, self.ranked[length], self.ranked[length] + n, first, each, offset))
        self.ranked[length] += n
        self.left[length] -= n

    def open(self, lengths: list[int], n: int) -> None:
        """``n`` new sequences with one piece of each of ``lengths``."""
        offset = 0
        for length in lengths:
            self.put(length, self.sequences, n, 1, offset)
            offset += length
        self.sequences += n

    def dominating(self, j: int):
        """Lengths of a set with a piece ``j`` that no other set with it can beat, or None."""
        left, room = self.left.copy(), self.capacity - j
        left[j] -= 1
        have = np.flatnonzero(left[:room + 1] > 0)
        if not len(have):
            return [j]
        best = int(have[-1])
        if best == room:
            return [j, best]
        low = []  # the three smallest pieces
        for length in have[:3]:
            low += [int(length)] * min(int(left[length]), 3 - len(low))
        if len(low) < 2 or low[0] + low[1] > room:
            return [j, best]
        if len(low) == 3 and sum(low) <= room:
            return None
        # at most two pieces fit beside j: the largest alone, or the best pair
        at = np.searchsorted(have, room - have, side="right") - 1
        mate = np.where(at >= 0, have[np.maximum(at, 0)], 0)
        single = np.array([left[a] < 2 for a in have]) & (mate == have)
        before = np.maximum(at - 1, 0)
        mate = np.where(single, np.where(at > 0, have[before], 0), mate)
        if best >= int((have + mate)[mate > 0].max(initial=0)):
            return [j, best]
        second = int(mate[-1])
        if not second:
            return None
        # {j, best, second} wins unless two pieces above ``second`` fit together
        above = []
        for length in have[have > second][:2]:
            above += [int(length)] * min(int(left[length]), 2 - len(above))
        return [j, best, second] if len(above) < 2 or sum(above) > room else None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.left[j] > 0 and (chosen := self.dominating(j)):
                    self.open(chosen, min(int(self.left[x]) // chosen.count(x) for x in chosen))
                    changed = True

    def best_fit(self) -> None:
        free: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
        for length in range(self.capacity, 0, -1):
            while (n := int(self.left[length])) > 0:
                room = min((r for r in free if r >= length), default=None)
                if room is None:
                    room, need = self.capacity, -(-n // (self.capacity // length))
                    free[room] = [(self.sequences, need)]
                    self.sequences += need
                first, m = free[room].pop()
                each = room // length
                full = min(m, n // each)
                if not full:  # the last pieces of this length share one sequence
                    each, full = n, 1
                self.put(length, first, full, each, self.capacity - room)
                rest = room - each * length
                if rest:
                    free.setdefault(rest, []).append((first, full))
                if m > full:
                    free[room].append((first + full, m - full))
                if not free[room]:
                    del free[room]


def pack(cut_docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ..., read twice: write them first)."""
    spark = cut_docs.sparkSession
    counts = {r["length"]: r["n"] for r in cut_docs.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity)
    # bounded by the capacity: a length opens, fills or splits few rows of sequences
    places = spark.createDataFrame(plan.places, "at long, from_rank long, to_rank long, first long, each long, shift long")
    parts = max(PARTS, -(-max(counts.values(), default=0) // PART_ROWS))
    dealt = cut_docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = (dealt.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "part"])
              .withColumn("rank", F.col("rank") + F.col("base")))
    here = (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    step = F.col("rank") - F.col("from_rank")
    return (ranked.join(F.broadcast(places), here)
            .withColumn("sequence_id", F.col("first") + F.floor(step / F.col("each")))
            .withColumn("offset", F.col("shift") + step % F.col("each") * F.col("length"))
            .select(*cut_docs.columns, "sequence_id", "offset"))


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    return pack(written(pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op5_best_fit_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


QUERIES, CHECKS = {"op5_best_fit_packing": op5_best_fit_packing}, {}
