"""The pipeline's rows against its stages done one after the other on plain strings."""

import re

import brute
import sentencepiece

import corpus_pipeline
from assayer.llm import quality, wfst
from assayer.llm.queries import table


def test_pipeline_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()
    # each text is scored alone, by the model that the stage fits
    model = quality.fit(docs, table(spark, sf, "labels"))
    good = [i for i, r in rows.items() if float(model.scores([r["text"]])[0]) >= 0.3]
    of = brute.near_classes([(i, rows[i]["text"]) for i in good])
    alone = [i for i in good if of[i] == i]
    stay = brute.mixed_ids([(i, rows[i]["text"], rows[i]["source"], rows[i]["lang"]) for i in alone])
    assert len(stay) < len(alone) < len(good) < len(rows)
    library = sentencepiece.SentencePieceProcessor(model_proto=wfst.model_bytes())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == stay
    for i, r in got.items():
        assert list(r["ids"]) == library.encode(rows[i]["text"]) and r["n_tokens"] == len(r["ids"]), i


def test_brute_similarity_by_hand():
    a, b = (brute.shingles(t) for t in ("One two, three four FIVE six", "one two three four five"))
    assert len(a) == 2 and set(b) < set(a)
    assert brute.weighted_jaccard(a, b, dict.fromkeys(a, 2.0)) == 0.5
    assert brute.shingles("né 1") == {tuple(re.findall(rb"\S+", "né 1".encode())): 1}
