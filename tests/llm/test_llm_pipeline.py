import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusflow.llm import decontaminate, language, near
from test_llm_near import brute


def test_pipeline_equals_brute_force(spark):
    """The stages once more in plain Python on the small tables, but for languages and masks."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = language.fit(docs.where(~language.held_out()))
    named = language.identify(docs, content).collect()
    rows = {r["doc_id"]: r["text"] for r in named if not r["rejected"]}
    groups = brute(list(rows), list(rows.values()), corpus_pipeline.WIDTH, corpus_pipeline.PERCENT)
    rows = {doc: text for doc, text in rows.items() if groups[doc][1] == doc}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    block = decontaminate.Items(list(range(len(items))), items, decontaminate.MAX_EDITS)
    leaks = block.found([decontaminate.words(t) for t in rows.values()])
    clean = {doc for doc, leak in zip(rows, leaks) if not leak}
    assert not any(i in rows[doc] for doc in clean for i in items)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(out) == clean
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in out.values():
        assert row["n_chars"] == len(row["text"])
        assert row["ids"] == library.encode(row["text"], add_special_tokens=False).ids
    assert near.near_duplicates.__name__ and len(corpus_pipeline.STAGES) == 5
