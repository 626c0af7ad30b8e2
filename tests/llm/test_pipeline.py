"""The corpus pipeline against brute force: each stage recomputed plainly over what the one before kept."""

import hashlib

import duckdb
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from hazegrid.llm import byte_bpe, langid, mixing
from tests.llm.test_similar_documents import brute_groups
from tests.llm.test_text import brute_lines

SF = "/root/testdata/sf0.001"


def plain_languages(spark, docs):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out(F.col("doc_id"))), per_lang=2000)
    return [r | {"lang": lang} for r in docs if (lang := model.mixture(r["text"])[0]) != "und"]


def plain_lines(docs):
    """Lines of fewer than five different words and 20 bytes take no part."""
    hidden = ["\n".join(x if len(set(x.lower().split())) >= 5 or len(x.encode()) >= 20 else "" for x in r["text"].split("\n")) for r in docs]
    gone = brute_lines(hidden, 0.8, 1)
    texts = ["\n".join(x for k, x in enumerate(r["text"].split("\n")) if (i, k) not in gone) for i, r in enumerate(docs)]
    return [r | {"text": t, "n_chars": len(t)} for r, t in zip(docs, texts)]


def plain_sample(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs])
    kept = {d for (d,) in con.execute(f"SELECT doc_id FROM ({mixing.oracle(0.8, 12, 11)}) WHERE kept").fetchall()}
    return [r for r in docs if r["doc_id"] in kept]


def plain_tokens(docs):
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = []
    for r in docs:
        ids = t.encode_ordinary(r["text"])
        out.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(r["text"].encode()).hexdigest()})
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
        if name == "language_id":
            want = plain_languages(spark, kept)
        elif name == "line_dedup":
            want = plain_lines(kept)
        elif name == "simhash_dedup":  # the search is approximate: no clean document goes, few near copies stay
            group = brute_groups([r["text"] for r in kept])
            ids = {r["doc_id"] for r in got}
            assert all(r["doc_id"] in ids for i, r in enumerate(kept) if group[i] == i)
            assert sum(r["doc_id"] in ids for i, r in enumerate(kept) if group[i] != i) <= 0.02 * len(kept)
            want = [r for r in kept if r["doc_id"] in ids]
        elif name == "mix_sources":
            want = plain_sample(kept)
        else:
            want = plain_tokens(kept)
        assert got == want and got, name
        kept = want
    assert sorted((r.asDict() for r in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r["doc_id"]) == kept


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    clash = docs.withColumns({c: F.lit(1) for c in ("id", "row", "lines", "cell", "words", "fp")})
    odd = docs.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), SF).count() == 0
        assert stage(spark, clash.unionByName(odd, True), SF).dtypes == clash.dtypes, name
        assert stage(spark, clash.unionByName(odd, True), SF).count() <= 31
