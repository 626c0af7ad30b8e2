"""Lines of few words: removed like others by op2, and by the pipeline unless they are short."""

import corpus_pipeline
from hazegrid.llm import line_dedup, queries
from tests.llm.test_text import brute_lines, docs
from tests.oracle import same

TEXTS = ["Subscribe to our newsletter\nok\n\nalpha beta gamma delta\nthe the end\nno", "subscribe to our NEWSLETTER\nok\n\nalpha beta gamma delta more\nend the\nyes", "这是一行很长的中文样板文字没有空格\nok then\nsubscribe to our", "这是一行很长的中文样板文字没有空格\nno"]


def test_short_lines_equal_brute_force(spark):
    got = {(r.id, r.line) for r in line_dedup.similar_lines(docs(spark, TEXTS, True), threshold=0.8, min_words=1).collect()}
    assert got == brute_lines(TEXTS, 0.8, 1) and {(1, 0), (1, 1), (1, 3), (1, 4), (3, 0), (3, 1)} == got


def test_query_equals_the_sql_without_a_floor(spark):
    assert same(spark, queries.QUERIES["op2_line_dedup"], line_dedup.oracle(0.8, 1)) > 0


def test_pipeline_keeps_only_short_ones(spark):
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs(spark, TEXTS), "").collect()}
    assert got == {0: TEXTS[0], 1: "ok\n\nend the\nyes", 2: TEXTS[2], 3: "no"}
