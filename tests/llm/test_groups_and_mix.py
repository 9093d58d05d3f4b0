"""SimHash groups, source mixing, packing: brute force, exact round trips, edge rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import llm_cases as cases
import numpy as np
import pytest
import xxhash

from sonde.llm import components, mix, packing, simhash
from sonde.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: list of (doc_id, fingerprint) -> list of component ids, by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
            parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(fps))]


def test_simhash_against_all_pairs(spark):
    rows = simhash.op8_simhash_groups(spark, cases.SF).collect()
    docs = sorted(cases.texts().items())
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    expected = {d: (f"{fp:016x}", c) for (d, fp), c in zip(fps, plain_components(fps))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == expected and len(rows) == len(docs)


def test_simhash_edge_rows(spark):
    found = simhash.near_duplicates(cases.edge(spark)).collect()
    fps = [(r[0], plain_fingerprint(r[1])) for r in cases.EDGE]
    expected = sorted((str(d), fp, str(c)) for (d, fp), c in zip(fps, plain_components(fps)))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in found) == expected
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    kept = simhash.deduplicated(cases.edge(spark))
    assert kept.columns == cases.edge(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "8", "9", "10", "-11", "None"])


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_links_of_a_hot_group(spark, blocks):
    """Chains and balls of near fingerprints: the same components for every number of blocks."""
    rng = random.Random(blocks)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:4]:
        for _ in range(120):
            flips = rng.sample(range(64), rng.randrange(1, 6))
            fps.add(base ^ sum(1 << b for b in flips))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f, 1) for f in fps]
    frame = spark.createDataFrame(signed, "fp long, copies long")
    roots = {r["node"]: r["root"] for r in simhash.links(frame, blocks).collect()}
    plain = plain_components(list(enumerate(fps)))
    ours = [roots.get(s, s) for s, _ in signed]
    assert len(set(zip(plain, ours))) == len(set(plain)) == len(set(ours))


def test_links_of_a_large_bucket_without_a_group(spark, monkeypatch):
    """Fingerprints that share three blocks but hardly any link: dealt anew, no link lost."""
    monkeypatch.setattr(simhash, "MOST_MEMBERS", 20)
    rng = random.Random(6)
    fps = {(rng.getrandbits(37) << 27) | 0x2ABCDEF for _ in range(900)}
    for base in sorted(fps)[::30]:
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f, 1) for f in fps]
    roots = {r["node"]: r["root"] for r in simhash.links(spark.createDataFrame(signed, "fp long, copies long"), 7).collect()}
    plain = plain_components(list(enumerate(fps)))
    ours = [roots.get(s, s) for s, _ in signed]
    assert len(set(zip(plain, ours))) == len(set(plain)) == len(set(ours)) < len(fps)


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 201), (201, 200)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def test_mix_against_sql(spark):
    cases.same_as_sql(spark, mix.op2_mix_sources, mix.SQL)


def test_mix_targets_and_limits(spark):
    rows = mix.mix(table(spark, cases.SF, "documents")).collect()
    by_source = {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] + 1e-6
        total = by_source.setdefault(r["source"], [r["target"], 0, 0])
        total[1] += r["taken"]
        total[2] = max(total[2], r["size"])
    assert sum(t for t, _, _ in by_source.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert all(abs(taken - target) <= largest / 2 + 1e-6 for target, taken, largest in by_source.values())


def test_mix_edge_rows(spark):
    rows = mix.mix(cases.edge(spark)).collect()
    assert len(rows) == len(cases.EDGE) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted({r["source"] for r in rows}, key=lambda s: (s is None, s)) == ["a", "b", "é", "\U0001F600", None]
    assert mix.mix(cases.empty(spark)).count() == 0
    copies = {str(r["doc_id"]): r["copies"] for r in rows}
    back = mix.repeated(cases.edge(spark))
    assert back.columns == cases.edge(spark).columns
    assert back.filter("doc_id = 4").count() == copies["4"] and mix.repeated(cases.empty(spark)).count() == 0


def test_mix_does_not_depend_on_the_layout(spark):
    """Rows that share a doc_id or have none: equal results over three layouts, and each source near its target after repeating."""
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, i]), " ".join(["w"] * rng.randrange(0, 40)) + f" {i % 50}", "en", rng.choice(["a", "b", None]), 0) for i in range(600)]
    rows += rows[:60]
    found = set()
    for parts in (1, 4, 9):
        frame = spark.createDataFrame(rows, cases.COLUMNS).repartition(parts)
        mixed = mix.mix(frame, share=0.7).collect()
        found.add(str(sorted((str(r["doc_id"]), r["size"], str(r["source"]), r["copies"]) for r in mixed)))
    assert len(found) == 1
    words = Counter()
    for r in mix.repeated(frame, share=0.7).collect():
        words[r["source"]] += len(r["text"].split())
    for source in ("a", "b", None):
        own = [r for r in mixed if r["source"] == source]
        assert words[source] == sum(r["taken"] for r in own)
        assert abs(words[source] - own[0]["target"]) <= max(r["size"] for r in own) / 2


def test_larger_documents_are_likelier(spark):
    rows = [(i, "w " * (3 if i % 2 else 60), "en", "a", 0) for i in range(4000)]
    taken = mix.mix(spark.createDataFrame(rows, cases.COLUMNS), share=0.4).collect()
    small, large = ([r["copies"] for r in taken if r["size"] == n] for n in (3, 60))
    # two and six binary digits: three times the chance
    assert 2.5 < (sum(large) / len(large)) / (sum(small) / len(small)) < 3.5


def test_targets_fill_up(spark):
    """Filling up by repeated sharing, as the definition has it."""
    sizes = {"a": 10, "b": 500, "c": 30, "d": 0, "e": 7, None: 200}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mix.source_targets(frame).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight = dict(zip(names, itertools.cycle((3, 1, 2))))
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and free:
        share, left = left / sum(weight[n] for n in free), 0.0
        for n in list(free):
            target[n] += share * weight[n]
            if target[n] > 2 * sizes[n]:
                left += target[n] - 2 * sizes[n]
                target[n] = 2.0 * sizes[n]
                free.discard(n)
    assert found == pytest.approx(target)


def check_plan(counts, capacity):
    plan = packing.Plan(counts, capacity)
    filled, placed = {}, {}
    for length, low, high, first, each, offset in plan.places:
        assert low == placed.get(length, 0)
        placed[length] = high
        for rank in range(high - low):
            filled.setdefault(first + rank // each, []).append((offset + rank % each * length, length))
    assert placed == {k: n for k, n in counts.items() if n}
    assert sorted(filled) == list(range(plan.sequences))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return plan


def fewest(items, capacity):
    """Exact number of sequences of a small instance."""
    best, items = [len(items)], sorted(items, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, rest + [r - items[i]])
        place(i + 1, rooms + [capacity - items[i]])
    place(0, [])
    return best[0]


def test_reduction_is_optimal_on_small_instances():
    """Every set the reduction fixes belongs to some best packing."""
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        counts = {x: items.count(x) for x in items}
        plan = check_plan(counts, capacity)
        left = list(items)
        for length, low, high, first, *_ in plan.places:
            for _ in range(high - low):
                if first < plan.fixed:
                    left.remove(length)
        assert plan.fixed + fewest(left, capacity) == fewest(items, capacity)
        assert plan.sequences <= fewest(items, capacity) + 1


def test_plan_of_many():
    rng = random.Random(9)
    counts = {rng.randrange(1, 2049): rng.randrange(1, 400) for _ in range(700)}
    plan = check_plan(counts, 2048)
    assert plan.sequences <= 1.02 * -(-sum(k * n for k, n in counts.items()) // 2048) + 1
    assert check_plan({}, 8).sequences == 0 and check_plan({8: 3}, 8).sequences == 3


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = cases.texts()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs.items()}
    check_packing(packing.op5_best_fit_packing(spark, cases.SF).collect(), ids)
    edge = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in cases.EDGE}
    rows = packing.packed(cases.edge(spark)).collect()
    check_packing(rows, edge, twice=5)
    assert packing.packed(cases.empty(spark)).count() == 0


def check_packing(rows, ids, twice=None, check_offsets=True):
    sequences, pieces = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc, found in pieces.items():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(found)):
            assert piece == n and start == at and (length == 2048 or n == 0)
            at += length
        assert at == len(ids[doc])
    assert len(rows) == sum(len(p) for p in pieces.values()) + (len(pieces[twice]) if twice else 0)
    if not check_offsets:
        return
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.03 * -(-total // 2048) + 1


def test_kept_ids(spark):
    rows = packing.pieces(cases.edge(spark), capacity=16, keep_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] <= 16 for r in rows)


def test_long_white_space_is_cut_where_the_pattern_cuts():
    from tokenizers import Tokenizer
    import public_tokenizers
    plain, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    n = 1_100_000
    for text in (" " * n, "\n" * n, "x" + "\n" * n + "a b  \n" + "\t " * (n // 2) + "<|endoftext|>" + " " * n + " 9", "\u3000 " * (n // 2) + "é", " " * n + "a"):
        assert own(text) == plain.encode(text, add_special_tokens=False).ids
    assert len(own(" " * 10_000_000)) == 10_000_000 and len(own("a" * 3_000_000)) == 750_000


def test_added_tokens_are_met_in_the_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"in{end}side", end * 3, f"{end} {end}\n\n{end}", f"two  {end}  spaces \n{end}", "<|endoftext|", f"<|{end}|>",
             "<|ENDOFTEXT|>", f"na\u00efve{end}\U0001F600", f"word {end} " * 3000]
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert ids[0] == [50256, 0] and ids[1] == [64, 220, 50256, 275, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(packing.packed(docs).collect(), ids)
    whole = {r["doc_id"]: r["ids"] for r in packing.pieces(docs, capacity=1 << 20, keep_ids=True).collect()}
    assert whole == ids


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    """5A is a copy of 3, 5B and 5C stand alone; of rows without doc_id, one of each group stays."""
    text = {c: " ".join(f"{c}{i * i % 89}" for i in range(60)) for c in "abcde"}
    rows = [(3, text["a"], "en", "s", 1), (5, text["a"], "en", "s", 1), (5, text["b"], "en", "s", 1), (5, text["c"], "en", "s", 1),
            (None, text["d"], "en", "s", 1), (None, text["d"], "en", "s", 1), (None, text["e"], None, "s", 1), (None, text["e"], "s", None, 1)]
    for parts in (1, 5):
        kept = simhash.deduplicated(spark.createDataFrame(rows, cases.COLUMNS).repartition(parts)).collect()
        assert sorted((str(r["doc_id"]), r["text"][0]) for r in kept) == [("3", "a"), ("5", "b"), ("5", "c"), ("None", "d"), ("None", "e")]
