"""Texts of symbols alone have no language."""

import numpy as np

from hazegrid.llm import langid
from tests.llm.test_text import docs


def test_symbols_are_no_language(spark):
    model = langid.Model(["en", "fr"], np.full((langid.BUCKETS, 2), 1 / langid.BUCKETS))
    texts = ["\U0001f600" * 5, "\U0001f600 12 \U0001f680 7", "\U0001d7ce \U0001f1e9", "\U00020000\U00020001", "\U00010400b"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, texts), model).collect()}
    assert [got[i][0] for i in range(5)] == ["und", "und", "und", "en", "en"] and got[0][1] == got[1][1] == 0
    assert {r.doc_id for r in langid.filter_documents(docs(spark, texts), model).collect()} == {3, 4}
