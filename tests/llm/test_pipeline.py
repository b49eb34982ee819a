"""Stages of the pipeline, each on its own input, and the registered queries against SQL."""

import hashlib
from collections import Counter

import pytest
from test_documents import BYTE, jaccard_rows, spans_brute
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from voxloom.llm import language, queries as llm, winnow
from voxloom.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(queries()[name](spark, SF), connect(SF).execute(oracle_sql()[name])) is None


def test_registered():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in queries())] == [] and "pipeline" in queries()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near copies", "benchmark", "secrets", "token ids"]


def test_stages(spark, edge_docs, edge_rows):
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    kept = stages["language"](spark, edge_docs, SF)
    assert kept.columns == edge_docs.columns
    assert rows(kept) - rows(edge_docs) == Counter() and not any(not any(c.isalpha() for c in t or "") for _, t in rows(kept))
    assert len(edge_rows) - kept.count() < 12  # all but texts without letters, and oddities
    kept = stages["near copies"](spark, edge_docs, SF)
    groups = {(r[0], r[1]): c for r, (_, _, c) in zip(edge_rows, jaccard_rows(edge_rows), strict=True)}
    assert rows(kept) == Counter((i, t) for i, t, _ in edge_rows if i is None or groups[i, t] == i)
    kept = stages["benchmark"](spark, edge_docs, SF)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows)
    kept = stages["secrets"](spark, edge_docs, SF)
    assert kept.columns == edge_docs.columns and not any(spans_brute(t or "") for _, t in rows(kept))
    tok = Tokenizer.from_file(BYTE)
    told = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages["token ids"](spark, edge_docs, SF).collect())
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in edge_rows]
    assert told == Counter((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids)


def test_stages_keep_columns_called_like_results(spark):
    ship_package(spark)
    names = [*winnow._RESULT, *language.ADDED]
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(k, f"some words of text number {k}", "en") for k in range(6)] + [(9, item, "en")]
    docs = spark.createDataFrame([(*r, *[f"own {c}" for c in names]) for r in rows], ["doc_id", "text", "lang", *names])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    told = lambda df: (df.columns, sorted(map(tuple, df.collect())))
    clean = told(docs.where("doc_id < 9"))
    assert told(winnow.decontaminated(docs, benchmark)) == clean
    assert told(winnow.decontaminated(docs, benchmark, most=0)) == clean
    kept = corpus_pipeline.known_language(spark, docs, SF)
    own = {tuple(r) for r in docs.collect()}
    assert kept.columns == docs.columns and kept.count() > 0 and {tuple(r) for r in kept.collect()} <= own


def test_a_stage_deletes_the_tables_of_the_one_before(spark, edge_docs, tmp_path):
    import os

    from voxloom.session import scratch_paths

    stages = dict(corpus_pipeline.STAGES)
    with scratch_paths() as first:
        stages["language"](spark, edge_docs, SF).write.parquet(f"{tmp_path}/one")
    made = [p.removeprefix("file:") for p in first]
    assert made and any(os.path.exists(p) for p in made)
    kept = spark.read.parquet(f"{tmp_path}/one")
    with scratch_paths() as second:
        out = stages["near copies"](spark, kept, SF)
    assert not any(os.path.exists(p) for p in made)
    assert any(os.path.exists(p.removeprefix("file:")) for p in second) and out.count() <= kept.count()


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.count() <= docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert language.REJECT_RATIO > 1
