"""Hooks of the corrective loop, and two ways of answering side by side."""

import pytest
from pyspark.sql import functions as F

from sifter.operators import corrective as CR
from sifter.operators import retrieval as R

DOCS = [(1, "red fish swims in the sea"), (2, "blue bird"), (3, "green tree by the sea"), (4, "")]


@pytest.fixture(scope="module")
def setup(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    qs = spark.createDataFrame([(1, "fish"), (2, "what is a bird"), (3, "")], "question_id bigint, question string")
    return docs, qs, R.build_index(docs).cache()


def test_grader_sees_question_and_contexts(setup):
    docs, qs, index = setup
    first_word = lambda q, contexts, score: F.element_at(contexts, 1).contains(F.element_at(F.split(q, " "), -1))
    got = {r.question_id: r for r in CR.corrective_retrieval(
        index, qs, k=2, docs=docs, grade=first_word, max_retries=1).collect()}
    assert got[1].relevant and got[1].rounds == 1 and got[1].doc_ids[0] == 1
    assert got[2].relevant and got[2].doc_ids[0] == 2
    assert not got[3].routed and got[3].rounds == 0
    none = lambda q, contexts, score: F.lit(None).cast("boolean")
    assert {r.rounds for r in CR.corrective_retrieval(index, qs, k=2, docs=docs, grade=none, max_retries=2)
            .where("routed").collect()} == {3}


def test_rewriter_changes_the_question(setup):
    docs, qs, index = setup
    rewrite = lambda q, contexts: F.when(q == "fish", F.lit("green tree by the sea"))
    wanted = lambda q, contexts, score: F.element_at(contexts, 1).startswith("green")
    got = {r.question_id: r for r in CR.corrective_retrieval(
        index, qs, k=1, docs=docs, grade=wanted, rewriter=rewrite, max_retries=2).collect()}
    assert got[1].relevant and got[1].rounds == 2 and got[1].question == "green tree by the sea" and got[1].original == "fish"
    assert CR.TRACE_REWRITE in got[1].trace
    assert got[2].question == "what is a bird" and not got[2].relevant
    with pytest.raises(ValueError, match="docs"):
        CR.corrective_retrieval(index, qs, rewriter=rewrite)


def test_side_by_side(setup):
    docs, qs, index = setup
    q = R.prepare_questions(index, qs, keyword=False)
    got = {r.query_id: r for r in CR.side_by_side(
        lambda: R.semantic_topk(index, q, 2), lambda: CR.corrective_retrieval(index, qs, k=2), qs).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert len(r.direct_ids) == 2 and r.overlap <= 2 and r.steps >= 2 and r.trace.startswith(CR.TRACE_RETRIEVE)
    assert r.direct_seconds > 0 and r.corrective_seconds > 0
    assert got[3].corrective_ids == [] and got[3].steps == 0
