"""Every operator and stage on nulls, empty and long texts, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib

import pytest
from llm.brute_force import base_spans, jaccard_classes
from pyspark.sql import functions as F

import corpus_pipeline
from meterlight.llm import bpe, langid, quality, token_files
from meterlight.llm.components import components
from meterlight.llm.decontaminate import clean_documents, contaminated
from meterlight.llm.exact_dedup import exact_dedup, kept_documents
from meterlight.llm.jaccard_join import jaccard_join, one_per_class
from meterlight.llm.kd_shards import shard_documents
from meterlight.llm.license_scan import length_class, notice_words, scan_licenses
from meterlight.llm.license_texts import NOTICES
from meterlight.llm.pii import find_pii
from meterlight.llm.queries import PIECES, TOKENIZER

LONG = " ".join(f"long{k % 977} words{k % 13}" for k in range(30_000))
NEAR = " ".join(f"n{k}" for k in range(80))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ROWS = [
    (1, "Same  text\n here mail a@b.org", "en", "s1", 5),
    (2, "Same text here mail a@b.org", "en", "s1", 5),
    (2, "Same text here mail a@b.org", "en", "s1", 5),
    (3, None, None, None, None),
    (4, "", "de", "s2", 0),
    (5, LONG, "de", None, 1),
    (6, NEAR, "fr", "s1", 2),
    (7, NEAR + " extra", "fr", "s1", 2),
    (8, f"before {ITEM} after <|endoftext|>", None, "s3", 3),
    (9, "Released under the MIT License.", "en", "s3", 3),
    (9, "another text of the same id", "en", "s3", 3),
    (None, "a row without an id", "en", "s3", 3),
    (10, " \t ", "en", "s3", 3),
    (11, "éàü ñ 日本", "es", "s3", 3),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHES = ("_id", "_text", "score", "shard", "slot", "ids", "node", "_full", "size", "rep", "keys", "_gone")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, COLUMNS)
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (None, 1, 0), (6, None, 0), (6, 1, None), (8, 7, 0), (77, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, None), (None, "nothing like it at all here"), (3, ""), (1, ITEM)]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def lexicon(docs):
    return bpe.build_lexicon(docs, TOKENIZER, pieces=50)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def pairs(df, *names):
    return sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)


def test_bpe(docs, none, lexicon, library):
    expected = sorted(
        ((row[0], library.encode(row[1] or "", add_special_tokens=False).ids) for row in ROWS), key=repr
    )
    encoded = bpe.encode(docs, lexicon).cache()
    assert pairs(encoded, "doc_id", "ids") == expected
    texts = sorted(((row[0], row[1] or "") for row in ROWS), key=repr)
    assert pairs(bpe.decode(encoded, lexicon), "doc_id", "text") == texts
    digests = sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts), key=repr)
    assert pairs(bpe.round_trip(docs, lexicon), "doc_id", "decoded_sha256") == digests
    empty = bpe.build_lexicon(none, TOKENIZER)
    assert bpe.round_trip(none, empty).collect() == []
    assert pairs(bpe.encode(docs, empty), "doc_id", "ids") == expected


def test_license_scan(docs, none):
    found = scan_licenses(docs)
    assert pairs(found, "doc_id", "license", "containment", "start_word") == [(9, "MIT", 1.0, 0)]
    assert scan_licenses(none).collect() == []
    assert scan_licenses(docs, notices=[]).collect() == []


def test_short_notices_are_found_whatever_stands_around_them(spark):
    # 80 bands of one MinHash value do not retrieve the notice from this window.
    before = " ".join(f"w{k}" for k in range(625282, 625289))
    frame = spark.createDataFrame([(1, f"{before} Released under the MIT License.")], "doc_id long, text string")
    assert pairs(scan_licenses(frame), "doc_id", "notice", "containment", "start_word") == [(1, 0, 1.0, 0)]


def test_whole_licences_are_found_as_a_search_at_every_window_finds_them(spark):
    def shingles(words):
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    def best_share(said, notice):
        own = notice_words(notice)
        length, wanted = length_class(len(own)), shingles(own)
        lows = range(0, max(0, len(said) - length - 1) + 1, length)
        return max(len(wanted & shingles(said[low : low + 2 * length])) / len(wanted) for low in lows)

    rows = []
    for number, (_, notice) in enumerate(NOTICES):
        words = notice.split()
        changed = ["other" if k % 40 == 20 else word for k, word in enumerate(words)]
        cut = words[: len(words) * 2 // 3]
        for version, shown in enumerate((words, changed, cut)):
            before = [f"w{number}{version}{k}" for k in range((0, 13, 330)[version])]
            rows.append((number * 10 + version, " ".join([*before, *shown, *before])))
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["notice"]): round(r["containment"], 9) for r in found.collect()}
    expected = {}
    for id, text in rows:
        said = notice_words(text)
        for number, (_, notice) in enumerate(NOTICES):
            share = best_share(said, notice)
            if share >= 0.8 - 1e-9:
                expected[id, number] = round(share, 9)
    assert got == expected
    assert all((number * 10, number) in got for number in range(len(NOTICES)))


def test_notices_of_fewer_words_than_a_shingle_are_found_inside_texts(spark):
    notices = ["MIT", "MIT License", "CC BY 4", "SPDX-License-Identifier: MIT"]
    rows = [
        (number * 100 + before * 10 + after, "x " * before + notice + " y" * after)
        for number, notice in enumerate(notices)
        for before in range(10)
        for after in (0, 1, 9)
    ]
    rows += [(1000, "spdx license identifier"), (1001, "spdx license a identifier mit b"), (1002, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = scan_licenses(frame, notices=[("short", notice) for notice in notices])
    expected = [
        (id, number, 1.0)
        for id, text in rows
        for number, notice in enumerate(notices)
        if f" {' '.join(notice_words(notice))} " in f" {' '.join(notice_words(text))} "
    ]
    assert pairs(found, "doc_id", "notice", "containment") == sorted(expected, key=repr)
    assert len(expected) > 120


def test_quality(docs, none, labels):
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model)
    rows = scored.collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.7) for row in rows)
    assert all(row["held_out"] for row in rows if row["doc_id"] is None)
    kept = quality.good_documents(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and sorted(kept.collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert quality.score_quality(none, quality.fit_quality(none, labels)).collect() == []
    unlabelled = quality.fit_quality(docs, labels.where("false"))
    assert {row["score"] for row in quality.score_quality(docs, unlabelled).collect()} == {0.5}


def test_decontamination(docs, none, benchmark):
    found = contaminated(docs, benchmark)
    assert pairs(found, "doc_id", "item_id", "similarity", "start_word", "n_words") == [
        (8, 1, 1.0, 1, 12),
        (8, 1, 1.0, 1, 12),
    ]
    clean = clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert pairs(clean, "doc_id") == sorted(((r[0],) for r in ROWS if r[0] != 8), key=repr)
    twice = docs.where("doc_id in (7, 8)").withColumn("doc_id", F.lit(7))
    assert pairs(clean_documents(twice, benchmark), "doc_id") == [(7,)]
    assert contaminated(none, benchmark).collect() == []
    assert contaminated(docs, benchmark.where("false")).collect() == []


def test_items_in_blocks_give_the_same(docs, benchmark, monkeypatch):
    monkeypatch.setattr("meterlight.llm.decontaminate.ITEMS_AT_ONCE", 2)
    found = contaminated(docs, benchmark)
    assert len(found.collect()) == 2
    clean = clean_documents(docs, benchmark)
    for result in (found, clean):
        # One pass over the texts, whatever the number of blocks.
        assert result._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert clean.count() == len(ROWS) - 1
    monkeypatch.setattr("meterlight.llm.decontaminate.ITEM_BYTES", 1)
    assert len(contaminated(docs, benchmark).collect()) == 2
    by_name = benchmark.selectExpr("cast(item_id as string) item_id", "text")
    assert {row["item_id"] for row in contaminated(docs, by_name).collect()} == {"1"}


def test_jaccard_join(docs, none):
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["copy_of"], r["n_copies"]) for r in jaccard_join(docs).collect()}
    assert (1, 1, 0, 1, 3) in got and (2, 1, 0, 1, 3) in got
    assert (6, 6, 1, 6, 1) in got and (7, 6, 1, 7, 1) in got
    assert (3, 3, 0, 3, 1) in got and (4, 4, 0, 4, 1) in got and (10, 10, 0, 10, 1) in got
    assert (None, None, 0, None, 1) in got
    kept = one_per_class(docs)
    assert kept.columns == docs.columns
    assert pairs(kept, "doc_id") == sorted(((r[0],) for r in ROWS if r[0] not in (2, 7)), key=repr)
    assert jaccard_join(none).collect() == []
    shared = docs.where("doc_id in (6, 7)").withColumn("doc_id", F.lit(7)).union(docs.where("doc_id = 6"))
    shared = shared.union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(7).cast("long")))
    assert pairs(one_per_class(shared), "doc_id") == [(6,), (7,), (7,), (7,)]


@pytest.mark.parametrize("block, whole", [(512, 8192), (7, 8192), (7, 10)])
def test_large_near_copy_groups_keep_every_link(spark, monkeypatch, block, whole):
    monkeypatch.setattr("meterlight.llm.jaccard_join.BLOCK", block)
    monkeypatch.setattr("meterlight.llm.jaccard_join.WHOLE_GROUP", whole)
    texts = {}
    for k in range(40):
        own = [f"w{j}" for j in range(90)]
        own[(7 * k) % 90] = f"changed{k % 23}"
        if k % 3:
            own[(11 * k) % 90] = f"other{k}"
        texts[k] = " ".join(own)
    texts[100] = texts[3]
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_of"], r["n_copies"]) for r in jaccard_join(frame).collect()}
    assert got == jaccard_classes(texts)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {row["node"]: row["root"] for row in components(frame).collect()}
    expected = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {300: 299}
    assert got == expected
    assert components(frame.where("false")).collect() == []


def test_language(docs, none):
    model = langid.fit_languages(docs, PIECES)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(docs, model).collect()}
    assert len({id for id, _ in got}) == len({row[0] for row in ROWS})
    assert {lang for id, lang in got if id in (3, 4, 10)} == {"und"}
    assert all(lang != "und" for id, lang in got if id in (1, 5, 6, 11))
    untaught = langid.fit_languages(none, PIECES)
    assert {r["lang_pred"] for r in langid.predict_languages(docs, untaught).collect()} == {"und"}
    assert langid.predict_languages(none, untaught).collect() == []


def test_exact_dedup(docs, none):
    got = pairs(exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept")
    assert (1, 1, 3, True) in got and got.count((2, 1, 3, False)) == 2
    assert (3, 3, 2, True) in got and (4, 3, 2, False) in got
    assert (None, None, 1, True) in got and got.count((9, 9, 1, True)) == 2
    assert len(got) == len(ROWS)
    kept = kept_documents(docs.union(docs))
    assert kept.columns == docs.columns
    assert pairs(kept, "doc_id") == sorted(((r[0],) for r in ROWS if r[0] not in (2, 4)), key=repr)
    assert exact_dedup(none).collect() == [] and kept_documents(none).collect() == []


def test_shards(docs, none):
    rows = shard_documents(docs, 3).collect()
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(r[0]) for r in ROWS)
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {8}
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert shard_documents(none, 3).collect() == []
    assert {r["shard"] for r in shard_documents(docs, 1).collect()} == {0}
    same = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    assert len({r["shard"] for r in shard_documents(same.where("doc_id <> 5"), 3).collect()}) == 3


def test_personal_data(docs, none):
    rows = find_pii(docs).collect()
    texts = sorted(((r[0], hashlib.sha256(base_spans(r[1]).encode()).hexdigest()) for r in ROWS), key=repr)
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in rows), key=repr) == texts
    assert {r["n_email"] for r in rows if r["doc_id"] == 1} == {1}
    assert find_pii(none).collect() == []


def test_token_files(spark, docs, none, library):
    path = token_files.write_token_files(docs, TOKENIZER)
    rows = sorted(token_files.documents_of(spark, path).collect(), key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids) and len(rows) == len(ROWS)
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    one = next(r for r in rows if r["doc_id"] == 8)
    expected = library.encode(ROWS[8][1], add_special_tokens=False).ids + [0]
    got = [token_files.token_at(spark, path, one["start"] + k) for k in (0, 3, len(expected) - 1)]
    assert got == [expected[0], expected[3], 0] and one["n_tokens"] == len(expected)
    with pytest.raises(IndexError):
        token_files.token_at(spark, path, 10**12)
    empty = token_files.write_token_files(none, TOKENIZER)
    assert token_files.documents_of(spark, empty).collect() == []


def test_stages_keep_the_columns_and_run_on_what_the_stage_before_kept(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, rows, str(tmp_path))
            assert kept.columns == rows.columns, name
            assert kept.count() <= rows.count()
        last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        assert last.count() == rows.count()
