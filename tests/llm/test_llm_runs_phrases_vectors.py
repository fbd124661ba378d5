"""Runs of repeated words, collocations and near-duplicate vectors: brute force, SQL and edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlight.llm.collocations import mine_collocations
from meterlight.llm.embedding_dedup import near_vectors
from meterlight.llm.lattice import SHORTEST, Cells, nearest
from meterlight.llm.oracle import ORACLE_SQL
from meterlight.llm.periodic_runs import find_runs, find_text_runs
from meterlight.llm.queries import QUERIES

CLASHES = ("_id", "_text", "runs", "collapsed", "id", "lang_", "node", "key", "vector", "dim", "rank", "n")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def runs_of(words, min_length=12):
    """Every period at every place, extended as far as it goes."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            begin = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at - begin + q >= max(min_length, 2 * q):
                found.setdefault((begin, at - begin + q), q)
            at += at == begin
    return sorted((begin, length, q) for (begin, length), q in found.items())


def kept_of(words, runs):
    gone = {k for begin, length, q in runs for k in range(begin + q, begin + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(id, words):
    h, n = zlib.crc32(str(id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words(seed):
    random.seed(seed)
    for _ in range(150):
        size, letters = random.randrange(1, 120), random.choice([1, 2, 2, 3, 4, 8])
        words = [random.randrange(letters) for _ in range(size)]
        if random.random() < 0.5:
            a = random.randrange(size)
            p = random.randrange(1, size - a + 1)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, size)]
        least = random.choice([2, 3, 5, 12])
        assert find_text_runs(np.array(words, np.int32), least) == runs_of(words, least), (least, words)


def test_runs_of_fibonacci_words():
    one, two = [0], [0, 1]
    while len(two) < 300:
        one, two = two, two + one
    assert find_text_runs(np.array(two, np.int32), 2) == runs_of(two, 2)


def test_op11(spark, small):
    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op11_runs"](spark, small).collect()}
    assert len(got) == len(rows)
    some = 0
    for id, text in rows:
        words = planted(id, [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])
        # Long texts take long here: a period shows as a repeated phrase of six words.
        grams = Counter(tuple(words[k : k + 6]) for k in range(len(words) - 5))
        runs = runs_of(words) if max(grams.values(), default=0) > 1 and len(words) < 3000 else None
        row = got[id]
        if runs is None and len(words) >= 3000:
            continue
        runs = runs or []
        some += bool(runs)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert row["collapsed_sha256"] == sha(kept_of(words, runs))
    assert some > 10


def test_run_edges(spark):
    again = " ".join("one two three".split() * 5)
    long = " ".join(f"w{k % 20_011}" for k in range(90_000))
    rows = [
        (1, again), (1, again), (2, None), (3, ""), (4, " \t\n "), (None, again), (5, long),
        (6, "x " * 11), (7, "x y z " * 12), (8, "a b c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("clash"))
    got = find_runs(frame)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = {}
    for row in got.collect():
        found.setdefault(row["doc_id"], []).append((row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]))
    assert found[1] == [(15, [(0, 15, 3)], "one two three")] * 2 and found[None] == found[1][:1]
    assert found[2] == found[3] == found[4] == [(0, [], "")]
    assert found[5][0][:2] == (90_000, [(0, 90_000, 20_011)])
    assert found[5][0][2] == " ".join(f"w{k}" for k in range(20_011))
    assert found[6] == [(11, [], " ".join(["x"] * 11))]
    # Only ASCII blanks part words.
    assert found[7] == [(12, [(0, 12, 1)], "x y z")]
    assert found[8] == [(3, [], "a b c")]
    assert find_runs(frame.where("false")).count() == 0


def test_op12(spark, medium):
    got = QUERIES["op12_collocations"](spark, medium)
    answer = duckdb.connect()
    answer.execute(f"create view documents as from '{medium}/documents.parquet'")
    expected = answer.execute(ORACLE_SQL["op12_collocations"])
    names = [c[0] for c in expected.description]
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert sorted(rows) == sorted(expected.fetchall()) and len(rows) > 100


def phrases_of(rows, max_words=3, min_count=10, top=2000, contained=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                counts.update((lang, tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    found = {}
    for (lang, phrase), a in counts.items():
        if len(phrase) < 2 or a < min_count:
            continue
        longer = [f for (other, long), f in counts.items() if other == lang and len(long) > len(phrase)
                  and f >= min_count
                  and any(long[k : k + len(phrase)] == phrase for k in range(len(long) - len(phrase) + 1))]
        if any(100 * f >= contained * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            l, r = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    return sorted(
        (lang, rank, text.decode(), -a, l, r, totals[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, text, l, r) in enumerate(sorted(rows)[:top], 1)
    )


PIECES = [
    ("en", "New York, new york! NEW\tYORK  city? new york city; in new york\nyork new\ryork new"),
    (None, "new york new york"), ("und", "new york"), ("en", None), ("en", "  ,;. "), ("", "éa éa éa É"),
    ("de", "a a a a a a a"), ("de", "a\x0bb\x0ca b c . b"), ("en", "new york " * 3000),
]


@pytest.mark.parametrize("max_words, min_count, top", [(2, 1, 2000), (3, 2, 2000), (4, 2, 3)])
def test_phrases_of_made_texts(spark, max_words, min_count, top):
    rows = [row for row in PIECES for _ in range(2)] + PIECES
    frame = spark.createDataFrame(rows, "lang string, text string")
    for name in CLASHES + ("piece", "weight", "phrase", "count"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = mine_collocations(frame.repartition(3), max_words=max_words, min_count=min_count, top=top)
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(rows, max_words, min_count, top)


def test_phrases_with_a_full_bitmap(spark, monkeypatch):
    """A bitmap that lets everything through changes no count."""
    from meterlight.llm import collocations

    monkeypatch.setattr(collocations, "MOST_BITS", 8)
    monkeypatch.setattr(collocations, "LEAST_BITS", 8)
    got = mine_collocations(spark.createDataFrame(PIECES, "lang string, text string"), min_count=2)
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(PIECES, min_count=2)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert mine_collocations(none).collect() == []
    with pytest.raises(ValueError):
        mine_collocations(none, max_words=1)


def test_lattice_points():
    random = np.random.default_rng(3)
    points = np.rint(random.normal(scale=1 << 17, size=(500, 8)))
    near = nearest(points)
    whole = near / 2
    assert ((np.abs(whole - np.rint(whole)) < 0.01).all(axis=1) | (np.abs(whole % 1 - 0.5) < 0.01).all(axis=1)).all()
    assert (whole.sum(axis=1) % 2 == 0).all()
    own = ((points - near * (1 << 15)) ** 2).sum(axis=1)
    for step in SHORTEST:
        assert (own <= ((points - (near + step) * (1 << 15)) ** 2).sum(axis=1)).all()


def test_cells_do_not_depend_on_the_batch():
    random = np.random.default_rng(4)
    units = random.normal(size=(200, 64))
    units /= np.linalg.norm(units, axis=1)[:, None]
    cells = Cells(64, 22, 2, 0.17)
    own, steps = cells.keys(units, 4)
    for k in (0, 77, 199):
        one, two = cells.keys(units[k : k + 1], 4)
        assert (own[k] == one[0]).all() and (steps[k] == two[0]).all()


def components_of(units, ids, cosine=0.95):
    links = units @ units.T >= cosine
    np.fill_diagonal(links, False)
    root = list(range(len(ids)))
    for a, b in zip(*np.nonzero(links), strict=True):
        ra, rb = a, b
        while root[ra] != ra:
            ra = root[ra]
        while root[rb] != rb:
            rb = root[rb]
        root[max(ra, rb)] = min(ra, rb)
    first = {}
    for k in range(len(ids)):
        r = k
        while root[r] != r:
            r = root[r]
        first.setdefault(r, []).append(k)
    least = {k: min(ids[m] for m in members) for members in first.values() for k in members}
    return links.sum(axis=1), least


def made_vectors(seed, dim=64):
    """Strangers, pairs just above and below the threshold, a chain, and a tight group."""
    random = np.random.default_rng(seed)

    def turned(base, cosine):
        other = random.normal(size=dim)
        other -= (other @ base) * base
        return cosine * base + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)

    unit = lambda: (lambda v: v / np.linalg.norm(v))(random.normal(size=dim))
    rows = [unit() for _ in range(150)]
    for cosine in (0.951, 0.955, 0.96, 0.97, 0.99, 0.949, 0.93):
        for _ in range(15):
            base = unit()
            rows += [base, turned(base, cosine) * random.uniform(0.1, 50)]
    chain = unit()
    for _ in range(30):
        rows.append(chain)
        chain = turned(chain, 0.97)
    base = unit()
    rows += [turned(base, 0.999) for _ in range(200)]
    return np.array(rows)


@pytest.mark.parametrize("block_bytes", [1 << 22, 40_000])
def test_vectors_against_all_pairs(spark, monkeypatch, block_bytes):
    from meterlight.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", block_bytes)
    rows = made_vectors(1)
    ids = [1000 - k for k in range(len(rows))]
    frame = spark.createDataFrame(
        [(i, row.tolist()) for i, row in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>"
    )
    got = {r["vec_id"]: r for r in near_vectors(frame.repartition(5)).collect()}
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    links, least = components_of(units, ids)
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= links).all()
    assert found.sum() >= 0.999 * links.sum()
    for k, i in enumerate(ids):
        if found[k] == links[k] == 0:
            assert got[i]["component_id"] == i
        if links[k] > 40:
            assert got[i]["component_id"] == least[k]
        assert got[i]["kept"] == (i == got[i]["component_id"])


def test_op13(spark, small):
    rows = duckdb.sql(f"select vec_id, embedding from '{small}/embeddings.parquet'").fetchall()
    units = np.array([r[1] for r in rows], np.float64)
    units /= np.linalg.norm(units, axis=1)[:, None]
    links, least = components_of(units, [r[0] for r in rows])
    got = {r["vec_id"]: r for r in QUERIES["op13_embedding_dedup"](spark, small).collect()}
    for k, (id, _) in enumerate(rows):
        assert (got[id]["n_links"], got[id]["component_id"]) == (links[k], least[k])


def test_vector_edges(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, one), (3, [x * 2 for x in one]), (4, one), (4, one), (9, [-x for x in one]),
        (10, None), (11, []), (12, [0.0, -0.0, 0.0, 0.0]), (13, [1.0, None, 3.0, 4.0]),
        (14, [nan, 2.0, 3.0, 4.0]), (15, [inf, 2.0, 3.0, 4.0]), (None, one), (16, [1.0, 2.0, 3.0]),
        (17, [x * 1e300 for x in one]), (18, [x * 1e-300 for x in one]), (None, None),
        (19, [0.0, 1.0, 0.0, 0.0]), (20, [-0.0, 1.0, -0.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("clash"))
    got = near_vectors(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert found == [
        (3, 5, 3, True), (4, 5, 3, False), (4, 5, 3, False), (5, 5, 3, False), (9, 0, 9, True),
        (10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True), (13, 0, 13, True), (14, 0, 14, True),
        (15, 0, 15, True), (16, 0, 16, True), (17, 5, 3, False), (18, 5, 3, False),
        (19, 1, 19, True), (20, 1, 19, False), (None, 0, None, True), (None, 0, None, True),
    ]
    assert near_vectors(frame.where("false")).collect() == []
