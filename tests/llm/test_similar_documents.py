"""Near-duplicate documents against brute-force Jaccard on word shingles."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hazegrid.llm import simhash


def brute_sets(texts, words=5):
    out = []
    for x in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "").encode().split()
        k = min(words, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute_groups(texts, t=0.8):
    sets, group = brute_sets(texts), list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= t * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def changed(rng, words, share):
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


def texts(seed):
    rng, out = random.Random(seed), [None, "", " \n ", "one two", "ONE two", "a b c d e", "a b c d f"]
    passage = [f"p{i}" for i in range(40)]
    for k in range(30):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([12, 60, 300]))] + (passage if k % 2 else [])
        out += [" ".join(changed(rng, base, s)) for s in (0, 0, 0.005, 0.01, 0.02, 0.03)]
    hub = [f"h{i}" for i in range(200)]
    out += [" ".join(changed(rng, hub, 0.012)) for _ in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 7)])
def test_groups_against_brute_force(spark, seed, block):
    """No link is below the similarity; of pairs at 0.9 or more none is lost, of those at 0.8 or more few."""
    t = texts(seed)
    d = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("a", "least", "fp", "x", "g", "n", "id")})
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(d, block=block).collect()}
    want, sets = brute_groups(t), brute_sets(t)
    assert all(want[i] == want[g] for i, g in got.items()) and len(got) == len(t)
    lost = {0.8: [0, 0], 0.9: [0, 0]}
    for i in range(len(t)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            s = both / max(1, len(sets[i] | sets[j])) if sets[i] or sets[j] else 1.0
            for least, n in lost.items():
                if s >= least:
                    n[0] += got[i] != got[j]
                    n[1] += 1
    assert lost[0.9][0] == 0 and lost[0.8][0] <= 0.05 * lost[0.8][1], lost


def test_stage_drops_near_copies_beyond_four_bits(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(30)]
    near = [" ".join(changed(rng, x.split(), 0.012)) for x in base]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(base + near)], "doc_id long, text string")
    want = {i for i, g in enumerate(brute_groups(base + near)) if i == g}
    got = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, d, "").collect()}
    assert got >= want and len(got - want) <= 1 and len(want) < 40


def test_rows_without_an_id_stay(spark):
    d = spark.createDataFrame([(None, "x y z"), (1, "x y z"), (2, "x y z"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(d).collect()) == [(False, 1), (True, 0), (True, 0)]
    assert simhash.keep_one(d.where(F.lit(False))).count() == 0


def test_recall_on_the_given_documents(spark):
    """Of all pairs of different shingle sets at 0.8 or more among the 10,000 documents, 0.9 or more end in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets: dict[tuple, int] = {}
    for r in docs.collect():
        s = simhash.shingles(r.text)
        if len(s):
            sets.setdefault(tuple(s.tolist()), r.doc_id)
    order, ids = [frozenset(s) for s in sets], list(sets.values())
    count = Counter(h for s in order for h in s)
    index, pairs = {}, []
    for i in sorted(range(len(order)), key=lambda i: len(order[i])):
        s = sorted(order[i], key=lambda h: (count[h], h))
        prefix = s[: len(s) - math.ceil(0.8 * len(s)) + 1]
        for j in {j for h in prefix for j in index.get(h, ())}:
            both = len(order[i] & order[j])
            if both >= 0.8 * (len(order[i]) + len(order[j]) - both) - 1e-9:
                pairs.append((ids[i], ids[j]))
        for h in prefix:
            index.setdefault(h, []).append(i)
    group = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    print(found, "of", len(pairs), "pairs")
    assert len(pairs) >= 40 and found >= 0.9 * len(pairs), (found, len(pairs))


@pytest.mark.parametrize("block", [2048, 5])
def test_no_candidate_is_left_untried(spark, monkeypatch, block):
    """However many of a set's candidates fail, all pairs that share a variant of a block and lie within reach are verified."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    t = [" ".join(changed(rng, base, 0.004)) for _ in range(18)]
    fps = {simhash._set_key(s): np.unpackbits(np.frombuffer(simhash.set_fingerprint(s), np.uint8)) for s in map(simhash.shingles, t)}
    want = set()
    for x in fps:
        for y in fps:
            off = fps[x] != fps[y]
            if x < y and off.sum() <= 168 and (off.reshape(simhash._BLOCKS, simhash._WIDTH).sum(axis=1) <= 2).any():
                want.add((x, y))
    tried = []

    def none_holds(pairs, *rest):
        tried.extend((r.x, r.y) for r in pairs.collect())
        return pairs.limit(0)

    monkeypatch.setattr(simhash, "_verified", none_holds)
    d = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    assert simhash.similar_documents(d, block=block).count() == len(t)
    keys = [(min(a, b, key=lambda k: k % 2**64), max(a, b, key=lambda k: k % 2**64)) for a, b in tried]
    assert {(min(p), max(p)) for p in keys} == want and len(keys) == len(set(keys)) and len(want) > 4 * len(t)


def test_sets_that_met_by_chance_are_dropped(spark):
    """Of a group's sets those stay that have another one within reach."""
    near, far = bytes(96), bytes([255]) * 96
    met = spark.createDataFrame([(7, 1, 50, bytearray(near)), (7, 2, 50, bytearray(b"\x01" + near[1:])), (7, 3, 50, bytearray(far)), (8, 3, 50, bytearray(far)), (8, 4, 50, bytearray(near))], "g long, a long, n long, fp binary")
    got = simhash._candidates(met.withColumn("label", F.col("a")), 2048, 0.8, 168, 0).collect()
    assert {(r.x, r.y) for r in got if r.x != r.y} == {(1, 2)} and {(r.g, r.x) for r in got if r.x == r.y} == {(7, 1), (7, 2)}
