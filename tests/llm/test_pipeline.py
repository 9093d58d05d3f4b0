"""The corpus pipeline, stage by stage, against brute force."""

from collections import Counter

import llm_cases as cases
import pytest
from test_groups_and_mix import check_packing, plain_components, plain_fingerprint
from test_models import plain_measures

import corpus_pipeline
from sonde.llm import classifier, mix, rules
from sonde.llm.common import table

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, cases.SF, "documents"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, cases.SF)
        rows = docs.collect()
        if name != "pack":
            assert docs.columns == DOCUMENTS
            docs = spark.createDataFrame(rows, docs.schema)
        out[name] = rows
    return out


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "mix_sources", "pack"]


def test_filters_keep_what_their_operators_keep(spark, stages):
    docs, labels = table(spark, cases.SF, "documents"), table(spark, cases.SF, "labels")
    kept = {r["doc_id"] for r in rules.judged(docs, rules.trained(docs, labels)).collect() if r["kept"]}
    assert {r["doc_id"] for r in stages["quality_rules"]} == kept
    for r in stages["documents"]:
        n, _, _, _, repeats = plain_measures(r["text"])
        assert r["doc_id"] not in kept or (n >= 10 and 100 * repeats <= 20 * n)
    good = {r["doc_id"] for r in classifier.scored(docs, classifier.trained(docs, labels)).collect() if r["predicted"]}
    assert {r["doc_id"] for r in stages["quality_classifier"]} == kept & good
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [d for d in kept if quality.get(d) == 1]
    assert len([d for d in clean if d in good]) > 0.95 * len(clean)


def test_one_document_of_each_group_stays(stages):
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in stages["quality_classifier"]]
    assert sorted(r["doc_id"] for r in stages["near_duplicates"]) == sorted(set(plain_components(docs)))


def test_rows_repeat_as_the_mix_says(spark, stages):
    docs = spark.createDataFrame(stages["near_duplicates"], table(spark, cases.SF, "documents").schema)
    copies = {r["doc_id"]: r["copies"] for r in mix.mix(docs).collect()}
    assert Counter(r["doc_id"] for r in stages["mix_sources"]) == Counter({d: n for d, n in copies.items() if n})


def test_every_copy_is_packed(stages):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids + [0] for r in stages["mix_sources"]}
    times = Counter(r["doc_id"] for r in stages["mix_sources"])
    first = {(r["doc_id"], r["piece"]): r for r in stages["pack"]}
    assert Counter((r["doc_id"], r["piece"]) for r in stages["pack"]) == Counter({k: times[k[0]] for k in first})
    spans = {}
    for r in stages["pack"]:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= 2048 and sorted(s)[0][0] == 0 for s in spans.values())
    check_packing([r for r in first.values()], ids, check_offsets=False)


def test_run_is_the_chain(spark, stages):
    key = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, cases.SF).collect()) == key(stages["pack"])


def test_empty_documents(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, cases.SF)
        assert docs.count() == 0
