"""Conversation repair, vector codes, line deduplication: brute force, SQL, edge rows."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import llm_cases as cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.llm import codes, dialogue, lines

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]")


# --- conversations

@functools.cache
def plain_edits(turns, state="", inserted=0):
    """(cost, edits) of the cheapest, then ASCII-least edits of (letter, cut short, must go) turns; state: last letter emitted."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
    found = [(0, "")] if not turns and state in ("", "a") else []
    if inserted < 2:
        cost, edits = plain_edits(turns, follow, inserted + 1)
        found.append((cost + 3, "I" + edits))
    if turns:
        (letter, cut, gone), rest = turns[0], turns[1:]
        cost, edits = plain_edits(rest, state)
        found.append((cost + 4, "D" + edits))
        if not gone:
            if letter == follow or letter == "s" and state == "":
                cost, edits = plain_edits(rest, letter)
                found.append((cost + 3 * cut, "K" + edits))
            cost, edits = plain_edits(rest, follow)
            found.append((cost + 3 + 3 * cut, "R" + edits))
    return min(found, default=(math.inf, ""))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(named.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_audit(rows):
    """The result columns of one conversation from its damaged rows (turn, role, text)."""
    def key(row):
        digest = hashlib.md5(f"{len(row[1])}:{row[1]}{row[2]}".encode()).digest()
        return row[0] is not None, row[0] or 0, row[1].encode(), digest
    rows = sorted(rows, key=key)
    seen, turns, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        letters = WORD.findall(text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "" if letters[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        turns.append((role[:1] if role[:1] in list("sua") else "?", fault == "truncated", fault in ("blank", "duplicate")))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = plain_edits(tuple(turns))
    left, out, last = iter(rows), [], ""
    for edit in audit:
        _, role, text = (None, None, "") if edit == "I" else next(left)
        if edit != "D":
            role = role if edit == "K" else {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            out.append(f"{role}:{text}")
            last = role[0]
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def plain_audits(rows):
    grouped = {conv: [] for conv, *_ in rows}
    for conv, *row in damage(rows):
        grouped[conv].append(row)
    return {conv: plain_audit(group)[0] for conv, group in grouped.items()}


def odd_turns(seed, convs=40):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    words = ["yes.", "no", "why?", " ", "", None, "a b!\n", "ok.", "ok.", " ", "x. "]
    rows = []
    for conv in [None, *range(convs)]:
        rows += [(conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(words)) for _ in range(rng.randrange(1, 14))]
    return rows + rows[:40]


CONV = "conv_id long, turn long, role string, text string"


def test_block_tables_against_plain_edits():
    tables, rng = dialogue.BlockTables(), random.Random(3)
    assert len(tables.vectors) < 100
    for n in [*range(14), 14, 30]:
        for _ in range(40):
            symbols = bytes(rng.choice(range(9)) if rng.random() < 0.6 else rng.randrange(3) for _ in range(n))
            turns = tuple(("sua?"[s % 4], 4 <= s < 8, s == 8) for s in symbols)
            assert tables.solve(symbols) == plain_edits(turns)


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_repair_against_plain_python(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        known = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{cases.SF}/conversations.parquet'").fetchall()
        for rows in (known, odd_turns(1)):
            frame = spark.createDataFrame(rows, CONV).repartition(3)
            found = dialogue.audits(dialogue.damaged(frame.withColumns({c: F.lit("clash") for c in ("copies", "digest", "n", "pass", "t", "first")}))).collect()
            assert {r["conv_id"]: tuple(r)[1:] for r in found} == plain_audits(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_turns(spark):
    rows = odd_turns(2)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = dialogue.repaired(spark.createDataFrame(rows, CONV)).collect()
    for conv in {r[0] for r in rows}:
        turns = sorted((r["at"], f"{r['role']}:{r['text']}") for r in found if r["conv_id"] == conv)
        assert [t for _, t in turns] == plain_audit([r[1:] for r in clean if r[0] == conv])[1]
    assert dialogue.repaired(spark.createDataFrame([], CONV)).count() == dialogue.audits(spark.createDataFrame([], CONV)).count() == 0


def test_repair_of_a_long_conversation(spark):
    """One conversation of 30,000 turns, a third of them the same text, and one text of 2 MB."""
    rows = [(1, t, "user" if t % 3 else "assistant", "again." if t % 3 == 0 else f"turn {t}" + ("." if t % 5 else "")) for t in range(30_000)]
    rows.append((1, 40_000, "user", "long " * 400_000 + "."))
    found = dialogue.audits(spark.createDataFrame(rows, CONV)).collect()
    assert len(found) == 1 and found[0]["duplicate"] == 9_999 and found[0]["gaps"] == 10_000 and len(found[0]["audit"]) >= 30_001
    kept = dialogue.repaired(spark.createDataFrame(rows, CONV)).orderBy("at").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in kept).encode()).hexdigest() == found[0]["repaired_sha256"]
    letters = "".join(r["role"][0] for r in kept)
    assert re.fullmatch("(s?(ua)+)?", letters)


# --- vector codes

def plain_codes(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error), digest of the codebooks, from (vec_id, vector, label) in Python integers."""
    kept = [(i, [int(math.floor(1024 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = -(-max(len(v) for _, v, _ in kept) // 4)
    parts = [[(v + [0] * (4 * step - len(v)))[p * step:(p + 1) * step] for p in range(4)] for _, v, _ in kept]
    books = [[row[p] for row in parts[:entries]] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))
    for _ in range(rounds):
        members = [[[] for _ in book] for book in books]
        for row in parts:
            for p in range(4):
                members[p][nearest(row[p], books[p])[1]].append(row[p])
        books = [[[sum(c) // len(m) for c in zip(*m)] if m else entry for entry, m in zip(book, part)] for book, part in zip(books, members)]
    last = [[nearest(row[p], books[p]) for p in range(4)] for row in parts]
    errors = [min(sum(far for far, _ in row), (1 << 63) - 1) for row in last]
    labels = {}
    for (_, _, label), error in zip(kept, errors):
        labels[label] = min(labels.get(label, 0) + error, (1 << 63) - 1)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in row), error, labels[label]) for (i, _, label), row, error in zip(kept, last, errors)), key=str), digest


def test_codes_against_sql(spark):
    cases.same_as_sql(spark, codes.op12_vector_codes, codes.SQL)


@pytest.mark.parametrize("entries", [5, 256])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_of_edge_rows(spark, entries, kind):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(9)], i % 3) for i in range(60)]
    rows += [(100, None, 1), (101, [0.5, None, *[0.0] * 7], 1), (102, [math.nan] * 9, 1), (103, [0.1, math.inf, *[0.0] * 7], 2)]
    rows += [(3, [1.0] * 9, None), (None, [1.0] * 9, None), (None, [0.25] * 9, 7), (104, [], 7), (105, [-0.0001, 0.5], 7), *rows[:7]]
    rows += [(106, [2.0 ** 20, -(2.0 ** 20), *[0.0] * 7], 8), (107, [2.0 ** 70, 1.0, 2.0, -(2.0 ** 70), *[0.0] * 5], 8)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    frame = frame.withColumns({c: F.lit("clash") for c in ("code", "error", "n", "part", "entry", "sums", "_key", "_hot")})
    found = codes.compressed(frame, entries=entries).collect()
    expected, digest = plain_codes(rows, entries)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), key=str) == expected
    assert {r["codebooks_sha256"] for r in found} == {digest}


def test_codes_of_nothing(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codes.compressed(spark.createDataFrame([], kind)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    assert [r["code"] for r in codes.compressed(spark.createDataFrame([(1, [], 1), (2, [], 1)], kind)).collect()] == ["00000000"] * 2


@pytest.mark.parametrize("bits", [8, 30, 45, 70])
def test_products_are_exact(bits):
    rng = random.Random(bits)
    x, c = ([[rng.randrange(-(1 << bits), 1 << bits) for _ in range(17)] for _ in range(n)] for n in (9, 5))
    kind = np.int64 if bits < 29 else object
    found = codes.products(np.array(x, dtype=kind), np.array(c, dtype=kind))
    assert found.tolist() == [[sum(a * b for a, b in zip(row, entry)) for entry in c] for row in x]


# --- lines

def plain_lines(rows, least_chars=40, least_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc)
    keeper = {k: max((d for d in docs if d is not None), default=None) for k, docs in holders.items() if len(docs) >= least_docs}
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        kept = [line for line in every if key(line) not in keeper or keeper[key(line)] == doc]
        out.append((doc, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_against_sql(spark):
    cases.same_as_sql(spark, lines.op13_line_dedup, lines.SQL)


def odd_lines():
    rng = random.Random(8)
    common = ["The quick brown fox jumps over the lazy dog " * 2, "é" * 40, "x" * 39, "Y" * 40, "  \tpadded line that is long enough to count here\r"]
    rows = [(i, "\n".join(rng.choice([*common, f"own line {i} {rng.random()}", "", " " * 60]) for _ in range(rng.randrange(12)))) for i in range(30)]
    rows += [(None, "\n".join(common)), (None, "y" * 40), (7, common[0].upper()), (7, common[0].upper()), (-3, None), (40, ""), (41, "\n\n"), *rows[:6]]
    return rows + [(50, "\n".join([*common * 4000, *[f"{i} " * 30 for i in range(9000)]]))]


@pytest.mark.parametrize("batches,least", [(8, 5), (1, 2), (20, 1)])
def test_odd_lines_against_plain_python(spark, batches, least):
    frame = spark.createDataFrame(odd_lines(), "doc_id long, text string").repartition(4)
    frame = frame.withColumns({c: F.lit("clash") for c in ("row", "line", "at", "batch", "keeper", "cut", "n", "n_lines", "kept")})
    found = lines.deduplicated(frame, least_docs=least, batches=batches)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_lines(odd_lines(), 40, least)


def test_lines_of_edge_rows(spark):
    found = lines.deduplicated(cases.edge(spark), least_chars=3, least_docs=2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_lines([r[:2] for r in cases.EDGE], 3, 2)
    assert lines.deduplicated(cases.empty(spark)).count() == 0


def test_runs_compact_and_keep_the_first(spark):
    runs, first = lines.Runs(spark, fanout=2, buckets=3), {}
    for batch in range(7):
        rows = [(f"line{(batch * 5 + i) % 17}".encode(), 100 - 10 * batch - i) for i in range(9)]
        runs.add(spark.createDataFrame(rows, "line binary, doc_id long"))
        for line, doc in sorted(rows, key=lambda r: -r[1]):
            first.setdefault(line, doc)
        assert {bytes(r["line"]): r["keeper"] for r in runs.rows().collect()} == first and runs.rows().count() == len(first)
        assert [len(level) for level in runs.levels] == [int(d) for d in f"{batch + 1:b}"[::-1]]
    plan = runs.runs()[0].hint("merge").join(runs.runs()[1].hint("merge"), "line", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    assert not runs.runs()
