"""Every operator and stage on odd documents and on an empty table."""

import public_tokenizers
import pytest
from odd import LONG, PROSE, labels, odd_documents

import corpus_pipeline
from tidewright.llm import byte_bpe, fingerprints, jaccard_join, language, line_rules, lm_scores, packing, personal, resampling, sharding

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
OPERATORS = {
    "fingerprints": lambda d, lab: fingerprints.compare(d),
    "jaccard": lambda d, lab: jaccard_join.join(d),
    "sharding": lambda d, lab: sharding.place(d, ["a", "b", "c"]),
    "byte_bpe": lambda d, lab: byte_bpe.round_trip(d, BYTES, public_tokenizers.PATTERN),
    "line_rules": lambda d, lab: line_rules.judge(d),
    "packing": lambda d, lab: packing.pack(d, WORDS, groups=(8,)),
    "resampling": lambda d, lab: resampling.resample(d, lab),
    "language": lambda d, lab: language.identify(d),
    "lm_scores": lambda d, lab: lm_scores.score(d, resampling.labels_of_good(lab)),
    "personal": lambda d, lab: personal.report(d),
}
STAGES = {
    "clean": lambda d, lab: line_rules.clean(d),
    "select": lambda d, lab: resampling.select(d, lab),
    "representatives": lambda d, lab: jaccard_join.representatives(d),
    "mask": lambda d, lab: personal.mask(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark), labels(spark)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    docs, lab = odd
    assert OPERATORS[name](docs.limit(0), lab.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_empty_table(odd, name):
    docs, lab = odd
    out = STAGES[name](docs.limit(0), lab.limit(0))
    assert out.columns == docs.columns and out.count() == 0


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"fingerprints", "jaccard", "packing"}))
def test_one_row_for_each_row(odd, name):
    docs, lab = odd
    rows = OPERATORS[name](docs, lab).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    first = [tuple(r) for r in rows if r["doc_id"] == 1]
    assert first[0] == first[1]


def test_fingerprints_of_odd_documents(odd):
    rows = {r["doc_id"]: r for r in fingerprints.compare(odd[0]).collect()}
    assert sorted(rows) == list(range(1, 10))
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] != ""
    assert rows[2]["near_next"] == 1.0  # the next one is a copy
    assert rows[4]["fingerprint"] == "" and rows[4]["near_next"] == 1.0 and rows[5]["near_next"] == 1.0
    assert rows[3]["n_chars"] == 0 and rows[6]["fingerprint"] and rows[7]["n_chars"] == len(LONG)


def test_jaccard_of_odd_documents(odd):
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(odd[0]).collect()}
    assert rows == {1: (1, 1), 2: (1, 1)} | {k: (k, 0) for k in range(3, 10)}


def test_packing_of_odd_documents(odd):
    rows = packing.pack(odd[0], WORDS, groups=(8,)).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 7)
    assert all(start == 4096 * k for k, start, _ in pieces) and all(n == 4096 for _, _, n in pieces[:-1])


def test_results_for_texts_without_words(odd):
    docs, lab = odd
    lang = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert [lang[k]["lang_pred"] for k in (3, 4, 5, 9)] == ["und"] * 4 and lang[8]["lang_pred"] != "und"
    lm = {r["doc_id"]: r for r in OPERATORS["lm_scores"](docs, lab).collect()}
    assert lm[3]["difference"] is None and lm[5]["n_words"] == 0 and lm[1]["difference"] is not None
    drawn = {r["doc_id"]: r["kept"] for r in resampling.resample(docs, lab).collect()}
    assert not drawn[3] and not drawn[4] and drawn[1] and not drawn[7]
    assert all(r["kept"] == (r["log_weight"] is not None) for r in resampling.resample(docs, lab.limit(0)).collect())
    rules = {r["doc_id"]: r for r in line_rules.judge(docs).collect()}
    assert rules[3]["base_failed"] and rules[1]["n_dup_lines"] == 2 and rules[1]["n_repeat_words"] == 30


def test_stages_keep_columns_and_rows(odd):
    docs, lab = odd
    ids = lambda d: sorted(str(r["doc_id"]) for r in d.collect())
    for name, stage in STAGES.items():
        out = stage(docs, lab)
        assert out.columns == docs.columns and out.where("good <> 'own good'").count() == 0, name
    assert ids(STAGES["clean"](docs, lab)) == ["1", "1", "2"]  # 7 repeats itself
    assert ids(STAGES["representatives"](docs, lab)) == ["1", "3", "4", "5", "6", "7", "8", "9", "None"]
    assert ids(STAGES["mask"](docs, lab)) == ids(docs)
    masked = {r["doc_id"]: r for r in STAGES["mask"](docs, lab).collect()}
    assert masked[3]["text"] is None and masked[1]["text"] == PROSE and masked[7]["n_chars"] == len(LONG)


def test_pipeline_stages_on_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    expected = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, small).checkpoint()
        assert docs.columns == expected and 0 < docs.count() <= before, name
        assert docs.where("n_chars <> char_length(text)").count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.count()
