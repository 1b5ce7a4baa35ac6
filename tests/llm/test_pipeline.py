import hashlib

import pytest

import corpus_pipeline
from sedimark.llm import quality, registry
from sedimark.llm.common import cut, table
from tests.llm.test_duplicates import brute_jaccard, brute_lines, brute_matches


@pytest.fixture(scope="module")
def stages(spark, data):
    """The rows before and after each stage."""
    docs = table(spark, data, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, data), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(frame):
    return sorted((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def test_all_but_the_last_return_documents(stages, spark, data):
    shape = table(spark, data, "documents").dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages) and len(stages) == 5
    assert all(after.dtypes == shape for name, (_, after) in stages.items() if name != "sentencepiece")


def test_rejected_documents_go(stages, spark, data):
    before, after = stages["quality"]
    ranker = quality.fit(before, table(spark, data, "labels"))
    good = {r.doc_id for r in quality.score(before, ranker).where("predicted = 1").collect()}
    assert rows(after) == [r for r in rows(before) if r[0] in good] and 0 < len(good) < before.count()


def test_repeated_lines_go(stages):
    before, after = stages["line_dedup"]
    found = brute_lines(rows(before))
    expected = sorted((d, text) for (d, _), (n, gone, text) in found.items() if gone < n)
    assert rows(after) == expected
    assert {r.doc_id: r.n_chars for r in after.collect()} == {d: len(t) for d, t in expected}


def test_one_document_of_each_group_stays(stages):
    before, after = stages["jaccard"]
    least = {c for _, _, c in brute_jaccard(rows(before))}
    assert {str(d) for d, _ in rows(after)} == least


def test_contaminated_documents_go(stages, spark, data):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    bad = {int(d) for d, *_ in brute_matches(rows(before), items)}
    assert rows(after) == [r for r in rows(before) if r[0] not in bad] and bad


def test_ids_equal_the_library(stages):
    import sentencepiece

    before, after = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in after.collect()}
    assert got == {d: (library.encode(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows(before)}


def test_run_is_its_stages(stages, spark, data):
    expected = sorted((r.doc_id, r.ids_crc32) for r in stages["sentencepiece"][1].collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, data).collect()) == expected


@pytest.fixture(scope="module")
def rough_dir(spark, tmp_path_factory):
    """Labels and a benchmark for the rough rows, with nulls, repeats and unknown ids."""
    folder = tmp_path_factory.mktemp("rough")
    spark.createDataFrame([(9, 1, 0), (11, 1, 0), (9, 1, 1), (20, 0, 0), (19, 0, 0), (None, 1, 0), (999, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "lead in nothing else to find here"), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_rough_rows_and_nothing(spark, rough, nothing, rough_dir, name, stage):
    after = stage(spark, rough, rough_dir)
    assert stage(spark, nothing, rough_dir).collect() == []
    if name == "sentencepiece":
        assert after.count() == rough.count()
        return
    assert after.columns == rough.columns
    found = [(r.doc_id, r.text) for r in after.collect()]
    if name == "line_dedup":
        assert (1, None) in found and (2, "") in found and len([t for _, t in found if t and "shared0 " in t]) == 2
    if name == "jaccard":
        assert len(found) == len(set(found)) and (None, None) in found
    if name == "decontamination":
        assert len(found) == rough.count()
