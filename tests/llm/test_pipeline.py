"""The pipeline's stages against brute force on a small table, and the registration."""

import numpy as np
import sentencepiece

import __spark_entry__
import corpus_pipeline
from labelloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.cases import documents, prose
from tests.llm.test_copies import brute_components, family
from tests.llm.test_rows import LABELS, graded_rows
from tests.llm.test_search import brute_overlap


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert sorted(set(numbers)) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    with_sql = {"op2_ngram_join", "op4_top_k", "op5_suffix_dedup", "op6_decontaminate", "op8_warc", "op11_prefix_trie", "op12_centroid_clusters", "op13_tensor_minhash"}
    assert set(ORACLES) == with_sql
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "contamination", "secrets", "encoding"]


def test_stages(spark, tmp_path):
    docs, labels = graded_rows(240)
    passage = prose(9000, 40)
    docs += [(1000 + k, t) for k, t in enumerate(family(60, 12, 2, 90))]
    docs += [(1100, prose(9001, 60) + " " + passage), (1101, prose(9002, 60) + " token=abcdef0123456789abcdef0123456789"), (1102, None), (1103, "")]
    folder = str(tmp_path)
    documents(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    rows, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in rows.collect()]
        columns = columns or rows.columns
        stage(spark, rows, folder).write.parquet(f"{folder}/after-{name}")
        rows = spark.read.parquet(f"{folder}/after-{name}")
        assert rows.columns == columns
        after = sorted((r.doc_id, r.text) for r in rows.collect() if r.text is not None)
        if name == "quality":
            good = {i for i, q, t in labels if q == 1 and t == 0}
            kept = {i for i, _ in after}
            assert len(kept & good) >= 0.97 * len(good)
            assert len({i for i, _, _ in labels} & kept - good) <= 0.03 * len(labels)
        elif name == "near_copies":
            assert {i for i, _ in after} == {i for i, _, c in brute_components(before, 5, 80) if i == c and dict(before)[i] is not None}
        elif name == "contamination":
            bad = {r[0] for r in brute_overlap(before, [(1, passage)]) if r[-1]}
            assert 1100 in bad and {i for i, _ in after} == {i for i, t in before if t is not None and i not in bad}
        else:
            changed = {i for i, t in after if t != dict(before)[i]}
            assert changed == {1101} and "[SECRET]" in dict(after)[1101]
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, rows, folder).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in rows.collect():
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert list(got[r.doc_id].ids) == want and got[r.doc_id].n_tokens == len(want)
    assert np.all([r.n_tokens >= 2 for r in got.values()])
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(got)


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
