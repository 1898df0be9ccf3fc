import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from flowsentry.llm.queries import QUERIES

from .conftest import FOLDER, ODD
from .test_decontamination import brute

NAMES = [f"op{n}_" for n in range(1, 14)]


def test_registered():
    found = contract.queries()
    assert all(sum(q.startswith(n) for q in QUERIES) == 1 for n in NAMES) and "pipeline" in found
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "decontamination", "packing"]


CONTRACTS = {
    "op1_quality": "doc_id held_out score predicted", "op3_url_trust": "page_id host path rule verdict",
    "op4_main_text": "page_id url text n_chars",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op8_toxicity": "doc_id held_out score predicted",
    "op9_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_the_agreed_columns(spark, name):
    found = contract.queries()[name](spark, FOLDER)
    table = "pages" if name in ("op3_url_trust", "op4_main_text") else "documents"
    assert set(CONTRACTS.get(name, "doc_id").split()) <= set(found.columns)
    if name not in ("op5_packing", "op11_spelling_variants"):
        assert found.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_stages_take_effect(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
    sizes = [len(k) for k in kept.values()]
    assert 200 > sizes[0] > 100 and sizes == sorted(sizes, reverse=True)
    assert len({t for _, t, _ in kept["near_dedup"]}) == sizes[2] == len({i for i, _, _ in kept["near_dedup"]})
    assert all(hits == 0 for _, _, hits, _ in brute([(i, t) for i, t, _ in kept["decontamination"]], items))
    before = {i: t for i, t, _ in kept["near_dedup"]}
    clean = [i for i, _, hits, _ in brute([(i, t) for i, t, _ in kept["near_dedup"]], items) if hits == 0]
    after = {str(i): t for i, t, _ in kept["decontamination"]}
    assert all(after[i] == before[int(i)] for i in clean)
    assert all(n == len(t) for i, t, n in kept["decontamination"] if str(i) not in clean)
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _, _ in kept["decontamination"]}


def test_odd_rows_pass_every_stage(spark, docs):
    odd = docs(*ODD).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, FOLDER).count() >= (1 if name != "quality" else 0), name
        assert stage(spark, odd.limit(0), FOLDER).count() == 0


def test_stages_keep_columns_with_any_name(spark, docs):
    words = [f"word{i}" for i in range(40)]
    plain = docs((1, " ".join(words)), (2, " ".join(words)), (3, "another text"), (None, "without an id"))
    clashing = plain.select("doc_id", "text", "lang", "source", "n_chars", *(
        F.lit(f"kept {c}").alias(c) for c in ("own", "without", "place", "before", "cut", "row", "best", "key", "Before_")))
    for name, stage in corpus_pipeline.STAGES[2:4]:
        rows = stage(spark, clashing, FOLDER).collect()
        assert rows and all(r[c] == f"kept {c}" for r in rows for c in clashing.columns[5:]), name


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
