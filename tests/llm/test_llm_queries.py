"""Every registered query over whole sample tables, against DuckDB, libraries or brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm.brute_force import base_spans, items_in, jaccard_classes, shingles

import __spark_entry__ as entry
import corpus_pipeline
from meterlight.llm.license_scan import length_class, notice_words
from meterlight.llm.license_texts import NOTICES
from meterlight.llm.oracle import ORACLE_SQL
from meterlight.llm.queries import QUERIES, SHARDS, TOKENIZER


@pytest.fixture(scope="module")
def rows(medium):
    return duckdb.sql(f"select * from '{medium}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def texts(rows):
    return {row[0]: row[1] for row in rows}


@pytest.fixture(scope="module")
def library_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(TOKENIZER).encode_batch(list(texts.values()), add_special_tokens=False)
    return {id: np.array(one.ids, "<u4") for id, one in zip(texts, found, strict=True)}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_op1(spark, medium, texts, library_ids):
    got = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, medium).collect()}
    assert set(got) == set(texts)
    for id, ids in library_ids.items():
        assert got[id]["n_tokens"] == len(ids)
        assert got[id]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[id]["decoded_sha256"] == hashlib.sha256(texts[id].encode()).hexdigest()


def test_op2(spark, medium, texts):
    query = QUERIES["op2_licenses"](spark, medium)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {(r["doc_id"], r["notice"]): round(r["containment"], 9) for r in query.collect()}
    expected = {}
    for number, (_, notice) in enumerate(NOTICES):
        own = notice_words(notice)
        wanted, length = set(shingles(own)), length_class(len(own))
        for id, text in texts.items():
            said = notice_words(text)
            if len(wanted & set(shingles(said))) >= 0.8 * len(wanted):
                lows = range(0, max(0, len(said) - length - 1) + 1, length)
                best = max(len(wanted & set(shingles(said[a : a + 2 * length]))) for a in lows)
                if best >= 0.8 * len(wanted) - 1e-9:
                    expected[id, number] = round(best / len(wanted), 9)
    assert got == expected and len(got) > 20


def test_op3(spark, medium):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{medium}/labels.parquet'").fetchall())
    got = QUERIES["op3_quality"](spark, medium).collect()
    for row in got:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in judged]) >= 0.97


def test_op4(spark, medium, texts):
    items = duckdb.sql(f"select item_id, text from '{medium}/benchmark.parquet' order by 1").fetchall()
    found = items_in(list(texts.values()), [text for _, text in items])
    ids = list(texts)
    expected = {(ids[t], items[i][0]): round(v, 9) for (t, i), v in found.items()}
    got = QUERIES["op4_decontaminate"](spark, medium).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == expected


def test_op5(spark, medium, texts):
    got = QUERIES["op5_jaccard_join"](spark, medium).collect()
    assert {
        r["doc_id"]: (r["class_id"], r["n_links"], r["copy_of"], r["n_copies"]) for r in got
    } == jaccard_classes(texts)


def test_op6(spark, medium, rows):
    langs = {row[0]: row[2] for row in rows}
    got = QUERIES["op6_language"](spark, medium).collect()
    assert len(got) == len(langs)
    for row in got:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
    judged = [r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(judged) >= 0.98


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, medium, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{medium}/documents.parquet'")
    query = QUERIES[name](spark, medium)
    names = sorted(query.columns)
    answer = con.sql(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall()
    found = sorted(tuple(map(plain, row)) for row in query.select(*names).collect())
    assert found == sorted(tuple(map(plain, row)) for row in answer)


def _kd(points, weights, order, leaves, first, out):
    """Plain k-d tree: ranks per dimension, cut where the weight before is nearest to the left part."""
    if leaves == 1 or not len(order):
        out[order] = first
        return
    spreads = [points[order, d].max() - points[order, d].min() for d in range(points.shape[1])]
    d = int(np.argmax(spreads))
    order = order[np.argsort(points[order, d])]
    total = np.cumsum(weights[order])
    wanted = total[-1] * (leaves // 2) / leaves
    at = int(np.searchsorted(total, wanted))
    at += wanted - (total[at] - weights[order[at]]) > weights[order[at]] / 2
    _kd(points, weights, order[:at], leaves // 2, first, out)
    _kd(points, weights, order[at:], leaves - leaves // 2, first + leaves // 2, out)


def test_op8(spark, medium, rows):
    got = {r["doc_id"]: r for r in QUERIES["op8_kd_shards"](spark, medium).collect()}
    ids = [row[0] for row in rows]
    size = {row[0]: len(row[1].encode()) + 8 for row in rows}
    ranks = []
    for key in (lambda r: r[3], lambda r: r[2], lambda r: size[r[0]]):
        ordered = sorted(rows, key=lambda r: (key(r), r[0]))
        place = {row[0]: k for k, row in enumerate(ordered)}
        ranks.append([place[id] for id in ids])
    shard = np.zeros(len(ids), int)
    _kd(np.array(ranks).T, np.array([size[id] for id in ids]), np.arange(len(ids)), SHARDS, 0, shard)
    assert [got[id]["shard"] for id in ids] == shard.tolist()
    slots, weight = defaultdict(list), defaultdict(int)
    for row in rows:
        one = got[row[0]]
        assert one["size"] == size[row[0]] and one["text_crc32"] == zlib.crc32(row[1].encode())
        assert one["law"] == "bytes" and one["grown_shard"] is None
        slots[one["shard"]].append(one["slot"])
        weight[one["shard"]] += one["size"]
    assert all(sorted(held) == list(range(len(held))) for held in slots.values())
    assert len(weight) == SHARDS
    assert max(weight.values()) - min(weight.values()) <= 2 * max(size.values())


def test_op9(spark, medium, texts):
    got = {r["doc_id"]: r for r in QUERIES["op9_pii"](spark, medium).collect()}
    assert set(got) == set(texts)
    for id, text in texts.items():
        spans = base_spans(text)
        assert got[id]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert got[id][f"n_{kind}"] == spans.count(f"{kind}:")
        assert got[id]["spans"].startswith(spans)


def test_op10(spark, medium, library_ids):
    got = {r["doc_id"]: r for r in QUERIES["op10_token_files"](spark, medium).collect()}
    start = 0
    for id, ids in library_ids.items():
        ids = np.append(ids, 0).astype("<u4")
        assert (got[id]["start"], got[id]["n_tokens"]) == (start, len(ids))
        assert got[id]["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_pipeline(spark, medium, texts, library_ids):
    predicted = {r["doc_id"]: r["predicted"] for r in QUERIES["op3_quality"](spark, medium).collect()}
    left = {id: text for id, text in texts.items() if predicted[id]}
    first = {}
    for id, text in left.items():
        first.setdefault(" ".join(text.replace("\n", " ").split(" ")), id)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{medium}/documents.parquet'")
    keep = con.sql(
        f"select doc_id, min(doc_id) over (partition by text_sha256) from ({ORACLE_SQL['op7_exact_dedup']})"
        f" where doc_id in ({', '.join(map(str, left))})"
    ).fetchall()
    left = {id: left[id] for id, kept in keep if id == kept}
    classes = jaccard_classes(left)
    left = {id: text for id, text in left.items() if classes[id][0] == id}
    items = duckdb.sql(f"select text from '{medium}/benchmark.parquet'").fetchall()
    ids = list(left)
    leaks = {ids[t] for t, _ in items_in([left[id] for id in ids], [text for (text,) in items])}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, medium).collect()}
    assert set(got) == set(left) - leaks and leaks
    assert all(got[id] == library_ids[id].tolist() for id in got)
