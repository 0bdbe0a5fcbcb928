"""Registered queries on a driver's table: columns, types, and their SQL; the pipeline stage by stage."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from helpers import base, documents, edit_inside, jaccard_components, passages_removed
from test_files import whole_ids

import corpus_pipeline
from footfall.llm import decontaminate, quality_rules
from footfall.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_wavelet_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_decontamination": "doc_id bigint, item_id bigint",
    "op5_brown_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op11_embedding_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_bit_sliced_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns_and_matches_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes).startswith(COLUMNS[name])
    rows = df.collect()
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(ORACLE[name])
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=key) == sorted(want.fetchall(), key=key)


def corpus():
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(250)]
    word = lambda: rnd.choice(vocabulary)
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(30)) for k in range(5)]
    passage = prose(60)
    rows = [(k, prose(rnd.randrange(60, 160))) for k in range(150)]
    rows += [(1000 + k, rows[k][1]) for k in range(2)] + [(2000 + k, rows[5 + k][1] + " " + prose(3)) for k in range(5)]
    rows += [(3000 + k, prose(40) + " " + passage + " " + prose(40)) for k in range(6)]
    rows += [(4000 + k, prose(50) + " " + items[k][1] + " " + prose(50)) for k in range(5)]
    rows += [(5000, "spam " * 300), (5001, None), (5002, ""), (5003, "few words")]
    return rows, items


def test_pipeline_stages_match_brute_force(spark, monkeypatch):
    rows, items = corpus()
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: s.createDataFrame(items, "item_id long, text string"))
    monkeypatch.setattr(corpus_pipeline, "byte_bpe", corpus_pipeline.byte_bpe)
    docs = documents(spark, rows, parts=3)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "decontamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, "none")
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
            out = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id: r for r in out.collect()} if name != "packing" else {}
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in quality_rules.judge(now)[0].collect()}
            failed = {d for d, t in before if base(t)[0] < 50 or 100 * base(t)[4] > 50 * base(t)[0]}
            assert set(after) == {d for d, k in verdict.items() if k} and not set(after) & failed
            assert len(after) > 0.8 * (len(before) - len(failed))
        elif name == "jaccard_join":
            assert set(after) == {c for _, _, c in jaccard_components(before)} and len(after) < len(before)
        elif name == "suffix_dedup":
            want = {r[0]: r for r in passages_removed(before)}
            assert all(hashlib.sha256(after[d].text.encode()).hexdigest() == w[4] and after[d].n_chars == len(after[d].text) for d, w in want.items())
            assert sum(w[2] for w in want.values()) > 1000
        elif name == "decontamination":
            normal = lambda t: " ".join(decontaminate.normal(t))
            leaks = {d for d, t in before for _, i in items if edit_inside(normal(i), normal(t)) <= 0.25 * len(normal(i))}
            assert set(after) == {d for d, _ in before} - leaks and len(leaks) >= 4
        else:
            pieces = out.collect()
            tokens = {d: whole_ids(t) for d, t in before}
            for d, ids in tokens.items():
                own = sorted((r.start, r.length) for r in pieces if r.doc_id == d)
                assert [s for s, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) == len(ids)
        now = out


def test_pipeline_runs_on_an_empty_table(spark, monkeypatch):
    now = documents(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
