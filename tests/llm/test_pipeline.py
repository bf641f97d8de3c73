"""The pipeline: its stages, in order, and what each leaves."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from bayerloom.llm import decontamination, near_duplicates, pii, quality, queries
from bayerloom.llm.common import staged, table

SF = "/root/testdata/sf0.01"


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["keep_quality", "drop_near_duplicates", "drop_contaminated", "mask_private", "encode"]


def test_stages_do_what_the_operators_say(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, SF), name)
        seen.append((name, before, docs))
        if name != "encode":
            assert docs.columns == columns
    after = {name: (a, b) for name, a, b in seen}

    def ids(df):
        return {r["doc_id"] for r in df.select("doc_id").collect()}

    a, b = after["keep_quality"]
    assert ids(b) == ids(quality.resample(a, table(spark, SF, "labels")).where("keep"))
    a, b = after["drop_near_duplicates"]
    assert ids(b) == {r["class_id"] for r in near_duplicates.duplicate_classes(a).collect()}
    a, b = after["drop_contaminated"]
    assert ids(b) == ids(a) - ids(decontamination.contaminated(a, table(spark, SF, "benchmark")))
    a, b = after["mask_private"]
    assert ids(a) == ids(b) and all(not pii.candidates(r["text"])[0] for r in b.collect())
    a, b = after["encode"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in a.collect()}
    rows = b.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["lossless"] and list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in rows)
    whole = corpus_pipeline.run(spark, SF).agg(F.count("*"), F.sum("n_tokens")).first()
    assert tuple(whole) == (len(rows), sum(r["n_tokens"] for r in rows))


def test_every_stage_takes_an_empty_table(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, SF)
        assert out.count() == 0 and (name == "encode" or out.columns == no_docs.columns)
