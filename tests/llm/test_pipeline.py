from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from webloom.llm import language_id, near_dedup, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage wrote."""
    root, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{root}/{name}")
        docs = out[name] = spark.read.parquet(f"file://{root}/{name}")
    return out


def test_stages_and_columns(spark, kept):
    assert list(kept) == ["language_id", "near_dedup", "secret_scan", "source_mix", "best_fit_packing"]
    schema = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name in list(kept)[:-1]:
        assert kept[name].columns == schema
    assert kept["best_fit_packing"].count() > 0


def test_each_decision_takes_effect(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = language_id.identify(docs, language_id.fit(docs)).where("keep").collect()
    assert Counter(r.doc_id for r in judged) == Counter(r.doc_id for r in kept["language_id"].collect())
    groups = near_dedup.near_groups(kept["near_dedup"])
    assert groups.count() == 0
    assert kept["secret_scan"].count() == kept["near_dedup"].count()
    assert secret_scan.secret_hits(kept["secret_scan"]).where("secret").count() == 0
    mixed = {r.doc_id for r in kept["source_mix"].collect()}
    assert mixed < {r.doc_id for r in kept["secret_scan"].collect()}
    assert {r.doc_id for r in kept["best_fit_packing"].collect()} <= mixed


def test_clean_documents_stay(kept):
    """Only documents without words, or copies of others, go before the mix."""
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    words = sum(1 for r in rows if r["text"] and sum(c.isalpha() for c in r["text"]) > 200)
    assert kept["language_id"].count() >= 0.95 * words


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "chunk", "n_tokens").collect())) == sorted(map(tuple, kept["best_fit_packing"].select("doc_id", "chunk", "n_tokens").collect()))


def tables(spark, folder, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `__key` string, `c0` int, `__redacted` string"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Every stage carries odd rows and columns; what goes are texts without letters and all but one of a group."""
    some = [r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if r["text"] and r["lang"] and len(r["text"]) > 300][:60]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "k", 1, "r") for r in some]
    text = " ".join(reversed(rows[0][1].split()))  # its words, but no runs of them
    rows += [(9001, None, None, None, None, None, None, None), (9002, "", "en", "a", 0, "k", 1, "r"), (9003, " 123 !!", None, None, 7, None, None, None)]
    rows += [(9004, text, rows[0][2], None, len(text), "k", 1, "r")] * 3 + [(None, rows[3][1] + " " + rows[4][1], None, "a", 5, "k", 1, "r")]
    path = tables(spark, tmp_path, rows)
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"file://{tmp_path}/out/{name}")
        docs = out[name] = spark.read.parquet(f"file://{tmp_path}/out/{name}")
        if name != "best_fit_packing":
            assert docs.columns == spark.read.parquet(f"{path}/documents.parquet").columns
    first, second = ([r.doc_id for r in out[n].collect()] for n in ("language_id", "near_dedup"))
    assert not {9001, 9002, 9003} & set(first) and first.count(9004) == 3
    assert second.count(9004) == 1 and len(second) == len(out["secret_scan"].collect())
    assert {r.doc_id for r in out["best_fit_packing"].collect()} <= set(second)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0
