"""The pipeline's stages against plain versions."""

import hashlib
import random

import corpus_pipeline
from posmv.llm import bpe, exact_dedup, mixing
from tests.llm.test_operators import SCHEMA, norm, plain_near_groups


def corpus():
    rng = random.Random(11)
    vocab = {l: ["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(300)] for l, a in (("aa", "abcdefgh"), ("bb", "klmnopqr"))}
    rows = []
    for i in range(150):
        l = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choice(vocab[l]) for _ in range(rng.choice([5, 80, 300]))), l, rng.choice(["s0", "s0", "s1"]), 0))
    rows += [(200 + i, rows[i][1].replace(" ", "\n", 2), "aa", "s0", 0) for i in range(20)]  # equal after white space
    rows += [(300 + i, rows[i][1] + " zz", "aa", "s1", 0) for i in range(40)]  # near
    return rows + [(400, "1234 !!", "aa", "s0", 0), (401, None, None, None, None), (402, "", "bb", "s0", 0)]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held = {r[0]: r for r in rows if r[0] < 400}  # texts without a letter go

    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        after[name], docs = docs, spark.read.parquet(path)
        if name != "bpe":
            assert docs.columns == list(after["language_id"].columns)
        got = {r.doc_id for r in docs.collect()}
        if name == "exact_dedup":
            first = {}
            for i in sorted(held):
                first.setdefault(norm(held[i][1]), i)
            held = {i: held[i] for i in first.values()}
        if name == "near_dedup":
            ids = sorted(held)
            label = plain_near_groups([held[i][1] for i in ids])
            held = {ids[l]: held[ids[l]] for l in set(label)}
        assert got == set(held), name
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(held)
    for r in docs.collect():
        assert r.decoded_sha256 == hashlib.sha256(held[r.doc_id][1].encode()).hexdigest()
        assert bpe.load(bpe.default_ranks()).encode([held[r.doc_id][1]])[0].tolist() == list(r.ids)


def test_run_returns_the_mixed_order_over_several_files(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    source = {r[0]: r[3] for r in rows}
    left = spark.createDataFrame([(r.doc_id, source[r.doc_id]) for r in got], "doc_id long, source string")
    want = mixing.mix_sources(left).orderBy("slot", "place").collect()
    assert [(r.doc_id, r.slot, r.place) for r in got] == [(r.doc_id, r.slot, r.place) for r in want]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_native_stages_use_no_python(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    plan = exact_dedup.drop_exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
