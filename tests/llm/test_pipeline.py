"""The pipeline on the smallest tables: each stage against a brute-force version on its own input."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from evidencia.llm import queries
from evidencia.llm.common import table

from .test_operators import brute_contaminated, brute_documents

SMALL = "/root/testdata/sf0.001"


def test_stages_and_run_agree_with_brute_force(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SMALL, "documents")
    columns, inputs, kept = docs.columns, [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append({r.doc_id: r.text for r in kept.select("doc_id", "text").collect()})
        kept = stage(spark, kept, SMALL).checkpoint()
        assert kept.columns == columns, name
    inputs.append({r.doc_id: r.text for r in kept.select("doc_id", "text").collect()})
    all_docs, good, civil, single, clean = inputs

    labels = {r.doc_id: r for r in table(spark, SMALL, "labels").collect()}
    judged = [(d in good, labels[d].quality == 1) for d in all_docs if d in labels]
    assert np.mean([a == b for a, b in judged]) > 0.9
    assert set(civil) <= set(good) and all(good[d] == civil[d] for d in civil)
    assert np.mean([d in civil for d in good if d in labels and labels[d].toxic == 0]) > 0.9

    ids = sorted(civil)
    low = brute_documents([civil[d] for d in ids], 5, 80)
    assert set(single) == {ids[i] for i, _, first in low if i == first}
    items = {r.item_id: r.text for r in table(spark, SMALL, "benchmark").collect()}
    assert set(single) - set(clean) == {d for d, _, _ in brute_contaminated(single, items)}

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == set(clean)
    for d in list(clean)[:40]:
        own = [r for r in pieces if r.doc_id == d]
        assert sum(r.length for r in own) == own[0].doc_tokens == len(tokenizer.encode(clean[d] or "", add_special_tokens=False).ids) + 1


def test_entry_lists_every_operator():
    names = entry.queries()
    assert "pipeline" in names and set(queries.queries()) <= set(names)
    assert [n.partition("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
