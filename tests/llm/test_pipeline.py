"""The corpus pipeline, stage by stage, against its parts by brute force."""

import re

import pytest

import corpus_pipeline
from tests.llm.test_similar import brute_jaccard
from tests.llm.test_texts import brute_contamination, luhn


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from stallmark.llm.spark import cut

    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], sf_dir)))
    return docs


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard join", "decontamination", "pii", "sentencepiece"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_stages(spark, sf_dir, stages):
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    before = sorted((r.doc_id, r.text) for r in stages[1].collect())
    root, _ = brute_jaccard([t for _, t in before])
    assert ids[2] == {before[r][0] for r in root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = brute_contamination([(r.doc_id, r.text) for r in stages[2].collect()], items)
    assert ids[3] == {d for d, _, hit, _ in found if not hit}
    old, new = ({r.doc_id: r for r in d.collect()} for d in stages[3:5])
    private = re.compile(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    for i, r in new.items():
        values = [v for v in private.findall(old[i].text) if not v.isdigit() or luhn(v)]  # other 16 digits are no cards
        assert not any(v in r.text for v in values) and len(private.findall(r.text)) == len(private.findall(old[i].text)) and r.n_chars == len(r.text)
        assert values or "token" in old[i].text or "password" in old[i].text or "AKIA" in old[i].text or old[i].text == r.text
    sentencepiece = pytest.importorskip("sentencepiece")
    from stallmark.llm.queries import model_path

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert all([*library.encode(new[r.doc_id].text), 2] == r.ids for r in stages[5].collect())


def test_run(spark, sf_dir, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in stages[-1].collect()}


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, a column more, and empty tables."""
    sentence = "the ship went north along the coast until the evening came down on it"
    rows = [(k, f"{sentence} for the {k} time {'x' * k}", "en", "a", 9, "e") for k in range(20)]
    rows += [(None, "a text without an id that stays where it is", "en", None, None, None), (None, None, None, None, None, None), (30, None, "en", "a", 0, "e"), (31, "", None, "a", 0, "e"), (32, "--", "en", "a", 2, "e")]
    rows += [(40, "mail me at someone@mail.example.com", "en", "a", 35, "e")] * 3 + [(41, "word " * 60_000, "en", "a", 300_000, "e")]
    rows += [(50, "one two three four five six seven eight nine ten eleven", "de", "b", 55, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)] + [(None, None, 1), (99, 0, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve"), (2, None), (None, "")], "item_id long, text string")
    for name, table in (("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    for source in (docs, docs.where("false")):
        last, n = source, []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            last = stage(spark, last, str(tmp_path))
            last.write.mode("overwrite").parquet(f"{tmp_path}/out{k}")
            last = spark.read.parquet(f"{tmp_path}/out{k}")
            assert k == 4 or sorted(last.columns) == sorted(docs.columns)
            n.append(last.count())
            if not k:  # what a model learnt from so few texts rejects is no matter here
                last = source
        assert n[1:] == sorted(n[1:], reverse=True)
        left = [r.doc_id for r in last.collect()]
        assert 50 not in left and (source is not docs and not left or left.count(40) == 1 and {30, 31, 32, 41} <= set(left))
