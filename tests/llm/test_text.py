"""Token counts, byte BPE, language, quality, lines, near duplicates, mixing and WARC on small inputs."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from hazegrid.llm import byte_bpe, langid, line_dedup, mixing, quality, simhash, token_counts, warc, words
from hazegrid.llm.components import components
from tests.oracle import same

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", "a", "  two  spaces ", "\n\n\tx\r\n", "naïve 中文 12345!!", "<|endoftext|> <s> </s>", "\x00\x01", "a" * 3000, " " * 500, "\U0001f600" * 40, "The the THE.", "The the THE."]


def docs(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({"id": F.lit("x"), "words": F.lit(1), "fp": F.lit("y"), "line": F.lit(0), "a": F.lit(0), "component": F.lit("z")}) if extra else d


def random_texts(seed, n=60):
    rng = random.Random(seed)
    alphabet = [" ", "\n", "a", "b", "th", "e", "é", "中", "'s", "9", "!", "\t", "\U0001f600"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    texts = ODD + random_texts(1)
    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts, True), PIECES, limit=50).collect()}
    for i, t in enumerate(texts):
        n = len(s.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50)


def test_very_long_texts(spark):
    """20 MB in one row, with spaces and without, through every text operator."""
    texts = ["lorem ipsum dolor " * 1_200_000, "x" * 400_000 + "é" * 200_000, "short"]
    d = docs(spark, texts)
    s = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, PIECES).collect()}
    assert got == {i: len(s.encode(t)) for i, t in enumerate(texts)}
    back = {r.doc_id: r.decoded_sha256 for r in byte_bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}.keys() == {0, 1, 2}
    assert simhash.keep_one(d).count() == 3 and mixing.mix(d).count() == 3
    assert {r.lang_pred for r in langid.identify(d, langid.train(d)).collect()} <= {"en", "fr"}
    assert quality.score(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))).count() == 3
    assert {(r.id, r.line) for r in line_dedup.similar_lines(d, min_words=1).collect()} == set()


def test_models_that_are_not_counted():
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    m.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        token_counts.Counter(m.SerializeToString())


def test_byte_bpe_equals_the_library_and_decodes(spark):
    texts = ODD + random_texts(2)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs(spark, texts, True), RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for i, x in enumerate(texts):
        ids = t.encode_ordinary(x or "")
        assert got[i].ids == ids and got[i].decoded == (x or "") and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()


@pytest.mark.parametrize("make", [
    lambda d: token_counts.count_tokens(d, PIECES),
    lambda d: byte_bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN),
    lambda d: simhash.near_duplicates(d),
    lambda d: line_dedup.removed_lines(d),
    lambda d: line_dedup.dedup_lines(d),
    lambda d: mixing.mix(d),
    lambda d: langid.identify(d, langid.train(d)),
    lambda d: quality.score(d, d.select("doc_id", F.lit(1).alias("quality"))),
])
def test_empty_tables_give_empty_results(spark, make):
    assert make(docs(spark, ["x"]).where("false")).count() == 0


def brute_fingerprint(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(monkeypatch):
    from hazegrid.llm import common

    texts = ODD + random_texts(3) + [" ".join(random.Random(4).choices(["ab", "cd", "Éf", "g\x0bh"], k=900))]
    assert [simhash.fingerprint(t, 4) for t in texts] == [brute_fingerprint(t, 4) for t in texts]
    blocks = common.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda d: blocks(d, 16))  # shingles cross the pieces of a long text
    assert [simhash.fingerprint(t, 4) for t in texts] == [brute_fingerprint(t, 4) for t in texts]


@pytest.mark.parametrize("blocks,limit", [(2, 2000), (2, 2), (1, 2000)])
def test_links_connect_what_brute_force_connects(spark, blocks, limit):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:10].tolist():
        for _ in range(8):
            for bit in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                b ^= 1 << bit
            fps.add(b)
    fps = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    table = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {r.node: r.component for r in components(simhash.links(table, 4, blocks, limit)).collect()}
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))):
        x, y = find(int(fps[i])), find(int(fps[j]))
        parent[max(x, y)] = min(x, y)
    assert all(got.get(int(x), int(x)) == find(int(x)) for x in fps)


def test_near_duplicates_of_nulls_and_copies(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, ODD, True)).collect()}
    assert got[0].fingerprint == "0" * 16 and got[1].component_id == got[0].component_id == 0
    assert got[12].component_id == got[11].component_id == 11
    kept = simhash.keep_one(docs(spark, ODD, True))
    assert kept.columns == docs(spark, ODD, True).columns
    assert {r.doc_id for r in kept.collect()} & {0, 1, 9, 11, 12} == {0, 11}


def test_rows_without_an_id(spark):
    d = spark.createDataFrame([(None, "one two three four five"), (1, "one two three four five"), (2, "one two three four five")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    assert sorted(str(r.doc_id) for r in simhash.keep_one(d).collect()) == ["1", "None"]
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(d).collect()) == [("1", "one two three four five"), ("2", ""), ("None", "one two three four five")]
    assert mixing.mix(d).count() == 3 and token_counts.count_tokens(d, PIECES).count() == 3


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 199)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[200] == got[199] == 199
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(texts, t, least):
    sets = [(i, j, frozenset(re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), x.encode())))) for i, text in enumerate(texts) if text is not None for j, x in enumerate(text.split("\n"))]
    big = [x for x in sets if len(x[2]) >= least]
    return {(i, j) for k, (i, j, s) in enumerate(big) if any(len(s & o) >= t * len(s | o) - 1e-9 for _, _, o in big[:k])}


@pytest.mark.parametrize("t,least,seed,limit", [(0.8, 5, 1, 64), (0.6, 2, 2, 2), (0.9, 1, 3, 64), (0.7, 3, 4, 2), (0.8, 1, 5, 3)])
def test_lines_equal_brute_force(spark, t, least, seed, limit):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "of"] * 4
    lines = [" ".join(rng.choices(words, k=rng.randint(0, 18))) for _ in range(120)]
    for x in list(lines[:60]):
        w = x.split()
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        lines.append(" ".join(w))
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 6]) for i in range(0, len(lines), 6)] + [None, "", "\n\n"]
    got = {(r.id, r.line) for r in line_dedup.similar_lines(docs(spark, texts, True), threshold=t, min_words=least, limit=limit).collect()}
    assert got == brute_lines(texts, t, least)
    small = {(r.id, r.line) for r in line_dedup.similar_lines(docs(spark, texts), threshold=t, min_words=least, buckets=64).collect()}
    assert small == got


def test_dedup_lines_keeps_columns_and_nulls(spark):
    texts = ["one two three four five\nkept", None, "One two three four five\nother", ""]
    out = line_dedup.dedup_lines(docs(spark, texts, True))
    assert out.columns == docs(spark, texts, True).columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["one two three four five\nkept", None, "other", ""]


def test_lists_of_one_word_are_split(spark):
    """Templated lines share all words but one: every list but those of that word is over the limit, at two and three words too."""
    texts = [f"user {i} logged in from the same host today at noon" for i in range(40)] + [f"user {i} logged in from the same host today at night" for i in range(0, 40, 4)] + [f"u{i} logged in today" for i in range(30)]
    got = {(r.id, r.line) for r in line_dedup.similar_lines(docs(spark, texts), threshold=0.8, min_words=1, limit=4).collect()}
    assert got == brute_lines(texts, 0.8, 1) and len(got) > 10


def test_word_hashes_across_pieces():
    data = b" ab cd\nef ab  gh\n\nij ab" + b" abcdefghijkl" * 2 + b"\nab"
    line, h = words.word_hashes(data)
    assert line.tolist() == [0, 0, 1, 1, 1, 3, 3, 3, 3, 4] and h[0] == h[3] == h[6] == h[9] and h[7] == h[8] and len(set(h.tolist())) == 6
    small, g = words.word_hashes(data, 6)
    assert small.tolist() == line.tolist() and g[[0, 1, 2, 3, 4, 5, 6, 9]].tolist() == h[[0, 1, 2, 3, 4, 5, 6, 9]].tolist() and g[7] == g[8]


def test_one_very_long_word_and_line(spark):
    long = "x" * (3 << 20)
    texts = [long, "a b c d e " * 300_000, long + "\nshort", " ".join(map(str, range(200_000))), " ".join(map(str, range(1, 200_000)))]
    got = {(r.id, r.line) for r in line_dedup.similar_lines(docs(spark, texts), min_words=1).collect()}
    assert got == {(2, 0), (4, 0)}


def test_language_of_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_language_edges(spark):
    model = langid.Model(["en", "fr"], np.full((langid.BUCKETS, 2), 1 / langid.BUCKETS))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, [None, "", "12 !!", "abc"], True), model).collect()}
    assert [got[i][0] for i in range(4)] == ["und", "und", "und", "en"] and got[0][1] == 0 and 0 <= got[3][1] <= 1
    assert langid.filter_documents(docs(spark, [None, "", "12 !!", "abc"], True), model).count() == 1


def plain_mixture(model, text, rounds=12):
    """The mixture by plain sums over trigrams."""
    grams = [int(g) for g in langid.trigrams(text)]
    p = [[float(x) for x in model.probs[g]] for g in grams]

    def fit(langs, share):
        for _ in range(rounds):
            total = [0.0] * len(langs)
            for row in p:
                mass = sum(s * row[k] for s, k in zip(share, langs))
                for i, k in enumerate(langs):
                    total[i] += share[i] * row[k] / mass
            share = [x / len(p) for x in total]
        return share, sum(math.log(sum(s * row[k] for s, k in zip(share, langs))) for row in p)

    n = len(model.langs)
    share, _ = fit(range(n), [1 / n] * n)
    order, best = sorted(range(n), key=lambda k: -share[k]), None
    for size in range(1, n + 1):
        langs = order[:size]
        start = [share[k] / sum(share[k] for k in langs) for k in langs]
        own, like = fit(langs, start) if size > 1 else ([1.0], sum(math.log(row[langs[0]]) for row in p))
        like -= langid.PENALTY * (size - 1) * math.log(len(p) + 1.0)
        if best is not None and like <= best[0]:
            break
        best = (like, dict(zip((model.langs[k] for k in langs), own)))
    return best[1]


def test_mixture_equals_plain_sums(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(d)
    rows = d.where("length(text) between 40 and 1500").orderBy("doc_id").limit(12).collect()
    for a, b in zip(rows[::2], rows[1::2]):
        text = a.text[:400] + " " + b.text[:250]
        got, want = model.mixture(text)[2], plain_mixture(model, text)
        assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_every_language_is_learned(spark):
    d = docs(spark, [f"word{i} text" for i in range(600)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id")))
    assert len(langid.train(d).langs) == 600


def test_mixture_proportions():
    rng = np.random.default_rng(2)
    a, b = "alpha beta gamma delta ".split(), "uno dos tres cuatro ".split()
    texts = [" ".join(rng.choice(w, 400)) for w in (a, b)]
    t = np.full((langid.BUCKETS, 2), 0.5)
    for i, x in enumerate(texts):
        t[:, i] += np.bincount(langid.trigrams(x), minlength=langid.BUCKETS)
    m = langid.Model(["a", "b"], t / t.sum(axis=0))
    lang, share, parts = m.mixture(" ".join(rng.choice(a, 300)) + " " + " ".join(rng.choice(b, 100)))
    assert lang == "a" and 0.65 < share < 0.9 and set(parts) == {"a", "b"}
    assert set(m.mixture(" ".join(rng.choice(a, 50)))[2]) == {"a"}


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(d, labels).join(labels, "doc_id")
    r = out.agg(F.avg(((F.col("quality") == 1) == F.col("keep")).cast("double")), F.count_if((F.col("quality") == 1) & ~F.col("keep"))).first()
    assert r[0] >= 0.95 and r[1] <= 3


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "big", "x", 0.9) for i in range(50)] + [(100 + i, "bad", "x", 0.1) for i in range(50)] + [(200, "lone", "x", 0.1)]
    own = spark.createDataFrame(rows, "id long, host string, path string, p double")
    p = {r.host: r for r in quality.posteriors(own).collect()}
    assert p["bad"].host_mean < p["lone"].host_mean < p["big"].host_mean and abs(p["bad"].host_mean - 0.1) < 0.1
    assert quality.score(docs(spark, [None, "", "some text here."], True), docs(spark, ["x"]).select("doc_id", F.lit(1).alias("quality"))).where("keep").count() == 1


def test_quality_leaves_a_document_out_of_its_own_prior(spark):
    """A host of one document has the global mean for its prior, whatever that document is; a path of empty texts has no means."""
    texts = ["fine words in order here. " * (i % 4 + 1) for i in range(12)] + ["$$$ BUY 1111 #### NOW", "  "]
    d = spark.createDataFrame([(i, x, "en", "lone" if i == 12 else "empty" if i == 13 else f"h{i % 2}") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i != 12)) for i in range(13)], "doc_id long, quality int")
    r = {x.doc_id: x for x in quality.score(d, labels).collect()}
    own = quality.posteriors(spark.createDataFrame([(x.doc_id, x.host, x.path, x.p_doc or None) for x in r.values()], "id long, host string, path string, p double"))
    assert r[12].host_mean == pytest.approx(own.first().mu) == pytest.approx(r[12].path_mean)
    assert r[13].host_mean is None and r[13].path_mean is None and not r[13].keep


def test_quality_equals_sql_from_the_own_evidence(spark):
    """Host and path posteriors and the final odds, recomputed by SQL from the documents' own probabilities."""
    sf = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(d.withColumns({c: F.lit("x") for c in ("p", "n", "s", "mu", "host", "path", "id")}), labels, host_col="source", path_col="lang").toPandas()
    con = duckdb.connect()
    con.register("own", out[["doc_id", "host", "path", "p_doc"]])
    k = lambda mu: f"CASE WHEN sum(n * pow(s / n - {mu}, 2)) / sum(n) - sum(q - s * s / n) / sum(n) * count(*) / sum(n) > 0 THEN greatest(1.0, least(1000.0, sum(n * {mu} * (1 - {mu})) / sum(n) / (sum(n * pow(s / n - {mu}, 2)) / sum(n) - sum(q - s * s / n) / sum(n) * count(*) / sum(n)) - 1)) ELSE 1000.0 END"
    want = con.execute(f"""
    WITH o AS (SELECT doc_id, host, path, nullif(p_doc, 0) AS p FROM own),
    paths AS (SELECT host, path, count(p) AS n, sum(p) AS s, sum(p * p) AS q FROM o WHERE p IS NOT NULL GROUP BY ALL),
    hosts AS (SELECT host, sum(n) AS n, sum(s) AS s, sum(q) AS q, (SELECT sum(s) / sum(n) FROM paths) AS mu FROM paths GROUP BY host),
    kh AS (SELECT {k('mu')} AS kh FROM hosts),
    hm AS (SELECT host, mu, n AS hn, s AS hs, kh, (s + kh * mu) / (n + kh) AS host_mean FROM hosts, kh),
    pm AS (SELECT paths.*, host_mean, mu, hn, hs, kh FROM paths JOIN hm USING (host)),
    kp AS (SELECT {k('host_mean')} AS kp FROM pm),
    j AS (SELECT doc_id, p, mu, greatest(1e-5, least(1 - 1e-5, (s - coalesce(p, 0) + kp * (hs - coalesce(p, 0) + kh * mu) / (hn - (p IS NOT NULL)::INT + kh)) / (n - (p IS NOT NULL)::INT + kp))) AS path_mean FROM o LEFT JOIN pm USING (host, path), kp)
    SELECT doc_id, CASE WHEN p IS NULL THEN 0 ELSE 1 / (1 + exp(-(ln(p / (1 - p)) + ln(path_mean / (1 - path_mean)) - ln(mu / (1 - mu))))) END AS p_quality FROM j""").fetchdf()
    both = out.merge(want, on="doc_id")
    assert len(both) == len(out) and np.allclose(both.p_quality_x, both.p_quality_y, atol=1e-6)


def test_quality_labels_that_repeat(spark):
    d = docs(spark, ["good text here, and more of it."] * 3 + ["### |||| $$$ !!!"] * 3)
    once = spark.createDataFrame([(i, int(i < 3)) for i in range(6)], "id long, label int")
    w = quality.train(d.select(F.col("doc_id").alias("id"), "text"), once.unionAll(once).unionAll(once))
    x, y = np.array([quality.features(r.text) for r in d.orderBy("doc_id").collect()]), np.array([1, 1, 1, 0, 0, 0.0])
    assert np.allclose(w, quality.fit(np.tile(x, (3, 1)), np.tile(y, 3)), atol=1e-6)


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([(s, lang, k, w) for s, lang, k, w in [("a", "en", "x", 700), ("a", "fr", "x", 50), ("b", "en", "y", 100), ("b", "fr", "x", 80), ("b", "fr", "y", 70), ("c", "en", "y", 0)]], "source string, lang string, topic string, w long")
    goal = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"x": 0.7, "y": 0.3}}
    frames = {m: spark.createDataFrame(list(g.items()), f"{m} string, share double") for m, g in goal.items()}
    out = mixing.rake(cells, frames, 60).toPandas()
    for m, g in goal.items():
        got = out.groupby(m)["raked"].sum()
        assert all(abs(got[k] - v) < 1e-3 for k, v in g.items())
    assert out[out.source == "c"]["raked"].sum() == 0


def test_mix_of_nulls_and_clashing_columns(spark):
    d = docs(spark, ODD, True).withColumn("source", F.when(F.col("doc_id") > 2, F.col("source"))).withColumn("tokens", F.lit("x"))
    out = mixing.mix(d).toPandas()
    assert len(out) == len(ODD) and out["probability"].between(0, 1).all() and set(out[out.doc_id < 3].source) == {"(none)"}
    assert mixing.sample(d).columns == d.columns


def test_warc_ids_differ_where_pages_do(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (1, None, "a"), (1, "", "a"), (None, None, None), (1, "u", "a")]
    r = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("page", "record_id", "date", "text", "links")}))).toPandas()
    assert len(r) == 12 and r.record_id.nunique() == 10 and r.refers_to.nunique() == 5
    assert set(r.concurrent_to) == set(r.record_id) and not (r.concurrent_to == r.record_id).any()
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_decodes_every_reference(spark):
    page = "<p>&#8217; &eacute; &#x41; &amp;lt; &nbsp;&bogus; &copy 2024 &#0; &#128; a&b</p>" + "<p>x &middot; y</p>" * 3000
    block = warc.derive(warc.responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).where("warc_type = 'conversion'").first().block
    lines = block.split("\n")
    assert lines[0] == "’ é A &lt; &bogus; © 2024 � € a&b" and lines[1:] == ["x · y"] * 3000


def test_warc_links_and_digests(spark):
    html = "<html><head><title> A &amp; B </title><style>x{}</style></head><body><p>One<br>two &lt;3</p><script>no()</script><a href='/x'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://x/", html), (2, None, None), (1, "http://x/", html)], "page_id long, url string, html string").withColumn("block", F.lit(0))
    r = warc.derive(warc.responses(pages)).toPandas()
    assert len(r) == 6 and set(r.warc_type) == {"metadata", "conversion"}
    one = r[(r.page == 1) & (r.warc_type == "conversion")].iloc[0]
    assert one.block == "A & B \nOne\ntwo <3\nl".replace(" \n", "\n") and one.block_digest == "sha256:" + hashlib.sha256(one.block.encode()).hexdigest()
    meta = r[(r.page == 1) & (r.warc_type == "metadata")].iloc[0]
    assert meta.refers_to == one.refers_to and meta.record_id != one.record_id and "Content-Length" in meta.source_headers
    assert f"WARC-Refers-To: {one.refers_to}" in one.record and one.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert r[(r.page == 2) & (r.warc_type == "conversion")].iloc[0].block == ""


@pytest.mark.parametrize("name", ["op2_line_dedup", "op6_mixing", "op9_warc"])
def test_query_matches_sql(spark, name):
    from hazegrid.llm import queries

    assert same(spark, queries.QUERIES[name], queries.ORACLES[name]) > 0
