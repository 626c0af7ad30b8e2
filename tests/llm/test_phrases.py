"""Count transducers, and phrases against plain counting."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazegrid.llm import phrases, queries
from hazegrid.llm.phrases import CountTransducer
from tests.oracle import same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        mine = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                mine.update(zip(*[w[i:] for i in range(k)]))
    out = []
    for lang, mine in f.items():
        kept = {p: c for p, c in mine.items() if c >= least and len(p) > 1}
        found = []
        for p, a in kept.items():
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in kept.items()):
                continue
            score, k = min((1000 * a * n[lang] // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


phrase = st.lists(st.sampled_from([b"a", b"b", b"ab", b"\xc3\xa9"]), min_size=1, max_size=4).map(tuple)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(phrase, st.integers(1, 1 << 40), max_size=30), min_size=1, max_size=4))
def test_transducers(shards):
    made = [CountTransducer.build(sorted(s.items())) for s in shards]
    for t, s in zip(made, shards):
        assert list(CountTransducer.from_bytes(t.to_bytes()).items()) == sorted(s.items())
        assert len(set(zip(t.final[:-1], t.edges[:-1]))) == len(t.final) - 1  # no two states with one future
    total = Counter()
    for s in shards:
        total.update(s)
    both = CountTransducer.union(made)
    assert list(both.items()) == sorted(total.items())
    for p, n in total.items():
        counts, longer = both.walk(p)
        assert counts == [total.get(p[:i], 0) for i in range(1, len(p) + 1)]
        assert longer == any(q[:-1] == p and c == n for q, c in total.items())


def texts(rng, n):
    word = lambda: rng.choice(["the", "of", "New", "york", "a", "b", "é", "naïve", "\x00", "x-y", "ΣΑΣ", "\u00a0"])
    fixed = ["in the city of new york", "a a a a a a a", "the\tThe  the, of of; of", "b\x0bb\x0cb\rb\nb"]
    return [rng.choice(fixed) if rng.random() < 0.4 else "".join(word() + rng.choice([" ", " ", "\t", ". ", ", ", "\n", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (10, 3, 4), (1, 5, 50)])
def test_phrases_equal_plain_counting(spark, least, longest, top):
    rng = random.Random(least)
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in [None, "", "   ", *texts(rng, 150)]]
    rows += rows[:20]
    d = spark.createDataFrame(rows, "lang string, text string").repartition(7).withColumns({"n": F.lit("x"), "score": F.lit(1), "key": F.lit(1)})
    got = sorted(tuple(r) for r in phrases.collocations(d, least=least, longest=longest, top=top).collect())
    assert got == plain(rows, least, longest, top)


def test_small_buffers_and_long_texts(spark, monkeypatch):
    """Parts of texts overlap, tables are written often: the counts stay the same."""
    monkeypatch.setattr(phrases, "BUFFER", 64)
    monkeypatch.setattr(phrases, "FLUSH_KEYS", 20)
    monkeypatch.setattr(phrases, "FLUSH_PHRASES", 10)
    rng = random.Random(8)
    rows = [("en", " ".join(rng.choice(["a", "bb", "ccc", "longer" * 20, "a, b"]) for _ in range(400))) for _ in range(4)] + [("en", "q" * 500), ("en", "q " * 300)]
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(d, least=2).collect())
    assert got == plain(rows, 2, 5, 2000)


def test_parts_of_long_texts():
    rng = random.Random(4)
    for _ in range(200):
        data = "".join(rng.choice([" ", "\t", ".", "a", "bb", "x" * 50, "\n"]) for _ in range(300)).encode()
        old, phrases.BUFFER = phrases.BUFFER, 40
        try:
            counts = Counter()
            for part, skip in phrases._pieces(data):
                runs = phrases._Runs("en", part, skip)
                for k in (1, 2, 5):
                    for i in (runs.fits(k)).nonzero()[0]:
                        counts[tuple(part[runs.start[i] : runs.end[i + k - 1]].split())] += 1
        finally:
            phrases.BUFFER = old
        want = Counter()
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", data):
            w = re.findall(rb"[^\x20\x09]+", piece)
            for k in (1, 2, 5):
                want.update(zip(*[w[i:] for i in range(k)]))
        assert counts == want


def test_very_long_text(spark):
    long = "alpha beta gamma " * 400_000
    rows = [("en", long), ("en", "z" * 3_000_000), ("en", None)]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=100).collect())
    assert got == plain(rows, 100, 5, 2000) and got[0][6] == 1_200_001


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**12, [10**13], [10**13], 10**15)], "a long, firsts array<long>, rests array<long>, n long")
    e = "CAST((CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(firsts[0] AS DECIMAL(19, 0)) * CAST(rests[0] AS DECIMAL(19, 0))) AS BIGINT)"
    assert row.select(F.expr(e)).first()[0] == 1000 * 9 * 10**12 * 10**15 // 10**26


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_query_equals_its_sql(spark):
    sql = phrases.oracle(10, 5, 100)
    same(spark, lambda s, d: phrases.collocations(queries.table(s, d, "documents"), least=10, top=100), sql)
    same(spark, queries.op13_collocations, queries.ORACLES["op13_collocations"])
