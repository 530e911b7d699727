"""The pipeline against plain versions of its stages, and the contract's columns."""

from __future__ import annotations

import zlib

import __spark_entry__
import corpus_pipeline
import numpy as np
import pytest

from tallywell.llm import packing, secrets, suffix

from .fixtures import SCHEMA, table, texts
from .test_documents import plain_components, plain_fingerprint, plain_quality
from .test_spans import brute

COLUMNS = {
    "op1_": "doc_id fingerprint component_id", "op2_": "query_id rank vec_id score", "op3_": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5_": "page_id host path rule verdict", "op6_": "doc_id n_ids ids_crc32 round_trip",
    "op7_": "doc_id n_words n_removed kept_sha256", "op8_": "doc_id n_assign n_access n_hex base_sha256 spans", "op9_": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    table(spark).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a.com/", "x"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("prefix", COLUMNS)
def test_queries_have_the_contract_columns(spark, folder, prefix):
    name = next(n for n in __spark_entry__.queries() if n.startswith(prefix))
    got = __spark_entry__.queries()[name](spark, folder)
    assert got.columns == COLUMNS[prefix].split()
    assert got.count() > 0


def plain_run(rows):
    from tokenizers import Tokenizer

    docs = [(i, t) for i, t in rows if plain_quality(t)[-1]]
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    seen, kept = set(), []
    for (i, t), c in sorted(zip(docs, plain_components(prints)), key=lambda x: (x[0][0] is not None, x[0])):
        if i is None or (i == c and i not in seen):
            kept.append((i, t))
            seen.add(i)
    cut = []
    for i, data, gone in brute(kept, 50, lambda t: t.encode()):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8), [0]]).astype(int)))
        cut.append((i, suffix.kept_text(data.decode(), edge[::2].tolist(), edge[1::2].tolist())))
    scan = secrets.scanner(secrets.RULES)
    clean = [(i, secrets.redacted(t, s, secrets.RULES)) for (i, t), s in zip(cut, scan([t for _, t in cut]))]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for i, t in clean:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        out += [(i, b // 2048, b, len(ids[b : b + 2048]), zlib.crc32(ids[b : b + 2048].tobytes())) for b in range(0, len(ids), 2048)]
    return out


def test_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    want = plain_run(texts())
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    fill: dict = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, docs, folder).columns) == corpus_pipeline.COLUMNS
