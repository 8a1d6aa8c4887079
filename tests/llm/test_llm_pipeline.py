"""The pipeline's stages on planted documents, each against its brute-force law."""

import random
import threading

import pytest

import corpus_pipeline
from orogrid.llm.common import released, saved

SF = "/root/testdata/sf0.01"


def test_stages_hold_their_laws(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rng = random.Random(1)
    vocab = [f"plain{k}" for k in range(300)]
    base = rng.choices(vocab, k=100)
    near = [*base[:50], "changed", *base[51:]]
    planted = [(10_000, " ".join(base), "en", "src0", 1), (10_001, " ".join(base).upper(), "en", "src0", 1), (10_002, " ".join(near), "en", "src1", 1), (10_003, " ".join(rng.choices(vocab, k=100)), "en", "src2", 1), (10_004, " ".join(rng.choices(["trash", "idiot", "pathetic", "worthless", "disgusting", "stupid", *vocab[:3]], k=60)), "en", "src3", 1), (10_005, None, None, None, None), (10_006, "", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), name.replace(" ", "_"))
        seen[name] = (ids(docs), docs)
        if name != "packing":
            assert docs.columns == columns
    assert 10_004 not in seen["toxicity"][0]
    assert {10_000, 10_001, 10_002, 10_003, 10_005, 10_006} <= seen["toxicity"][0]
    exact = seen["exact dedup"][0]
    assert 10_001 in exact
    assert 10_000 not in exact
    assert (10_005 in exact) + (10_006 in exact) == 1
    near_ids = seen["near dedup"][0]
    assert (10_001 in near_ids) + (10_002 in near_ids) == 1
    assert 10_003 in near_ids
    assert seen["mixing"][0] == near_ids == seen["packing"][0]
    texts = [(r.text or "").lower() for r in seen["exact dedup"][1].collect()]
    assert len(texts) == len(set(texts))
    pieces = seen["packing"][1].toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert not pieces.duplicated(["sequence_id", "offset"]).any()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.count() == 0
    assert name == "packing" or out.columns == docs.columns


#: Columns that each query's contract names.
COLUMNS = {
    "op1_token_blocks": "doc_id start n_tokens ids_crc32", "op2_minhash_near_dedup": "doc_id class_id", "op3_embedding_near_dedup": "vec_id n_links component_id kept",
    "op4_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op5_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op6_pfair_mixing": "doc_id source position", "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_toxicity": "doc_id held_out score predicted", "op10_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "pipeline": "doc_id piece sequence_id",
    "op11_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified", "op13_html_extraction": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries_run(spark, name):
    import __spark_entry__ as e

    out = e.queries()[name](spark, "/root/testdata/sf0.001")
    assert set(COLUMNS[name].split()) <= set(out.columns)
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    got = out.count()
    assert got == n if name.split("_")[0] in ("op1", "op2", "op5", "op7", "op8", "op9", "op11", "op12") else got > 0


def test_threads_release_their_own_tables(spark):
    """A block in one thread leaves the tables of another alone."""
    inside, done = threading.Event(), threading.Event()
    kept = {}

    def other():
        with released(spark):
            kept["df"] = saved(spark.range(3).toDF("id"), "thread")
            inside.set()
            done.wait(60)
            kept["n"] = kept["df"].count()

    t = threading.Thread(target=other)
    t.start()
    assert inside.wait(60)
    with released(spark):
        saved(spark.range(2).toDF("id"), "own")
    done.set()
    t.join()
    assert kept["n"] == 3


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert e.queries()["pipeline"] is corpus_pipeline.run
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["op2_minhash_near_dedup", "op3_embedding_near_dedup", "op4_chat_formatting", "op7_exact_dedup", "op12_merkle_manifest"])
def test_queries_equal_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = e.queries()[name](spark, SF).toPandas(), c.execute(e.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))
