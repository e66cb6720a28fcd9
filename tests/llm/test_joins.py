"""Operators that compare texts and vectors: substrings, shingles, benchmark passages, vectors, components."""

import math
import random

import numpy as np
import pytest
from brute import kept_words, least_reachable, sha256, similar_components

from cinelake.llm import decontamination, fm_index, ngram_join, substring_dedup, vector_dedup
from cinelake.llm.components import components
from cinelake.llm.queries import ORACLES, QUERIES


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def family():
    """Texts with shared passages, near copies, exact copies, repeats inside a text, and edge cases."""
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 150)
    rows = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            words = base.split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
            text = " ".join(words)
        elif kind == 1:
            text = prose(rng, 20) + "\n" + passage + "\t" + prose(rng, 20)
        elif kind == 2:
            text = base
        elif kind == 3:
            text = " ".join([prose(rng, 3)] * 15)
        elif kind == 4:
            text = passage[: rng.randint(10, len(passage))]
        else:
            text = prose(rng, rng.randint(0, 40))
        rows.append((1000 - i * 7, text))
    rows += [(1, None), (2, ""), (3, "one"), (4, "one"), (5, "One two"), (6, "one two"), (7, "w " * 20_000), (8, "w " * 19_000)]
    return rows


def test_fm_index_counts_like_a_scan():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 6, 400), 0)
    index = fm_index.FMIndex(text, 6, 4)
    for width in (1, 2, 3, 4):
        patterns = rng.integers(1, 6, (200, width))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            places = {i for i in range(len(text) - width + 1) if (text[i : i + width] == p).all()}
            assert set(index.suffixes[a:b].tolist()) == places


@pytest.mark.parametrize("depth", [1, 2, 5, 13])
def test_fm_index_tells_runs_apart(depth):
    rng = np.random.default_rng(2)
    text = np.append(np.tile(rng.integers(1, 3, 40), 6), 0)
    places = rng.permutation(len(text) - depth)
    one, which = fm_index.FMIndex(text, 3, depth).distinct(places)
    runs = [tuple(text[p : p + depth]) for p in places]
    assert [tuple(text[p : p + depth]) for p in one[which]] == runs and len(one) == len(set(runs))


def test_least_in_intervals():
    v = np.array([5, 3, 9, 1, 7])
    assert fm_index.least_in(v, np.array([0, 2, 0, 4]), np.array([2, 4, 2, 5])).tolist() == [3, 1, 3, 7]


@pytest.mark.parametrize("cut", [5_000, 1])
def test_substring_dedup(spark, docs_of, family, monkeypatch, cut):
    monkeypatch.setattr(substring_dedup, "CUT", cut)  # 1: all repeated minimizers take the way of hot ones
    monkeypatch.setattr(substring_dedup, "PIECES", 50)
    rows = family + [(None, family[0][1]), (1000, family[0][1])]
    got = substring_dedup.deduplicate(docs_of(rows)).collect()
    want = kept_words(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in got), key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 500


@pytest.mark.parametrize("cut", [5_000, 1])
def test_a_shard_gets_each_piece_once(docs_of, monkeypatch, cut):
    search = substring_dedup.search_shard

    def once(shard, width):
        keys = list(zip(shard.column("m").to_pylist(), shard.column("c").to_pylist(), strict=True))
        assert len(keys) == len(set(keys))
        return search(shard, width)

    monkeypatch.setattr(substring_dedup, "CUT", cut)
    monkeypatch.setattr(substring_dedup, "search_shard", once)
    rng = random.Random(6)
    passage = prose(rng, 40)
    rows = [(i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(40)] + [(100 + i, passage) for i in range(40)]
    got = substring_dedup.deduplicate(docs_of(rows).repartition(8)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in got) == sorted(kept_words(rows))


def test_substring_dedup_of_nothing(docs_of):
    assert substring_dedup.deduplicate(docs_of([])).count() == 0
    assert substring_dedup.deduplicate(docs_of([(1, None), (2, "a b")])).count() == 2


def test_substring_query_on_the_table(spark, sf_dir, sample_docs):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_substring_dedup"](spark, sf_dir).collect()}
    assert got == {(i, n, k, sha256(t)) for i, n, k, t in kept_words(sample_docs)}


@pytest.mark.parametrize("frequent", [1 << 18, 0])
def test_ngram_join(spark, docs_of, family, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    got = ngram_join.similar(docs_of(family)).collect()
    sizes, component = similar_components(family)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], component[i]) for i, _ in family}
    assert len({c for c in component.values()}) < len(family) - 10


def test_ngram_join_edges(docs_of):
    text = "a b c d e f g h"
    got = ngram_join.similar(docs_of([(1, text), (1, text), (None, text), (2, text.upper()), (3, None), (4, " \t ")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [
        (0, 4, 0), (1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4)]
    assert ngram_join.similar(docs_of([])).count() == 0


def test_a_null_id_takes_no_prefix(docs_of):
    rng = random.Random(8)
    rows, want = [], []
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        near = list(words)
        near[30] = "other"
        rows += [(None, " ".join(words)), (10 * k + 5, " ".join(words)), (10 * k + 9, " ".join(near))]
        want += [(10 * k + 5, 56, 10 * k + 5), (10 * k + 9, 56, 10 * k + 5)]
    got = ngram_join.similar(docs_of(rows).coalesce(1)).filter("doc_id IS NOT NULL").collect()
    assert sorted(map(tuple, got)) == want


def test_ngram_query_on_the_table(spark, sf_dir, sample_docs):
    sizes, component = similar_components(sample_docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_join"](spark, sf_dir).collect()}
    assert got == {i: (sizes[i], component[i]) for i, _ in sample_docs}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(7, 7), (3, 1), (3, 1)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = least_reachable({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and {n for n, c in want.items() if n != c} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_find_every_overlap_within_the_tolerance():
    from itertools import combinations

    ones = [[k for k, c in enumerate(m) if c == "1"] for m in decontamination.MASKS]
    span = len(decontamination.MASKS[0])
    for gone in combinations(range(decontamination.WINDOW), decontamination.WINDOW - decontamination.LEAST):
        assert any(all(s + o not in gone for o in m) for m in ones for s in range(decontamination.WINDOW - span + 1))


def test_decontamination(spark, docs_of):
    rng = random.Random(9)
    item = prose(rng, 30).split()
    swapped = list(item)
    for k in range(3, 30, 7):
        swapped[k] = "other"
    broken = [w if k % 3 else "other" for k, w in enumerate(item)]
    rows = [(1, prose(rng, 50) + " " + " ".join(item).upper() + "! " + prose(rng, 9)), (2, " ".join(swapped)), (3, " ".join(broken)),
            (4, prose(rng, 80)), (5, None), (5, None), (6, ""), (None, " ".join(item)), (7, ", ".join(item[4:20])), (8, "w " * 5000)]
    items = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (13, " ".join(item))], "item_id long, text string")
    got = decontamination.leaks(docs_of(rows), items).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(i, k) for i in (0, 1, 2, 7) for k in (10, 13)]
    assert {(r.doc_id, r.diagonal, r.matched, r.item_words) for r in got if r.item_id == 10} >= {(1, 50, 30, 30), (2, 0, 26, 30), (7, -4, 16, 30)}
    kept = decontamination.clean(docs_of(rows), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 5, 6, 8] and len(kept.columns) == 8
    assert decontamination.leaks(docs_of([]), items).count() == 0
    assert decontamination.clean(docs_of(rows), items.limit(0)).count() == len(rows)


def test_short_items_have_masks_for_every_tolerated_replacement():
    from itertools import combinations

    for n in range(1, decontamination.WINDOW):
        masks = decontamination.SHORT.get(n, ()) + (decontamination.MASKS if n >= 8 else ())
        for gone in combinations(range(n), n - -(-n * decontamination.LEAST // decontamination.WINDOW)):
            assert any(all(s + k not in gone for k, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1)), (n, gone)


def test_short_and_unnamed_items_are_found(spark, docs_of):
    rng = random.Random(3)
    texts = {n: [f"q{n}x{k}" for k in range(n)] for n in (1, 3, 5, 6, 7, 8, 9, 20)}
    items = [(n if n != 20 else None, " ".join(w)) for n, w in texts.items()] + [(None, "unnamed " * 9), (30, ""), (31, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [(0, prose(rng, 40)), (1, None), (2, "")], []
    for n, w in texts.items():
        for gone in [None, *range(n)]:
            own = [x if k != gone else "other" for k, x in enumerate(w)]
            rows.append((len(rows), f"{prose(rng, 3)} {' '.join(own)} {prose(rng, 3)}"))
            if gone is None or n >= 6:
                want.append((rows[-1][0], n if n != 20 else None, 3, n - (gone is not None), n))
    got = [(r.doc_id, r.item_id, r.diagonal, r.matched, r.item_words) for r in decontamination.leaks(docs_of(rows), bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = decontamination.clean(docs_of(rows), bench).collect()
    assert sorted(r.doc_id for r in kept) == sorted({i for i, _ in rows} - {w[0] for w in want})


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, dim string")


def brute_vectors(rows, least=0.93):
    ok = {}
    for i, v, label, *_ in rows:
        usable = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok[i] = (label, np.array(v, np.float32).astype(float)) if usable else None
    links = [(a, b) for a in ok for b in ok if a != b and ok[a] and ok[b] and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1])
             and ok[a][1] @ ok[b][1] / (np.linalg.norm(ok[a][1]) * np.linalg.norm(ok[b][1])) >= least]
    comp = least_reachable(ok, links)
    return {i: (sum(a == i for a, _ in links), comp[i], comp[i] == i) for i in ok}


@pytest.mark.parametrize("tile_bytes", [512 * 1024, 4096])
def test_vector_dedup(spark, monkeypatch, tile_bytes):
    monkeypatch.setattr(vector_dedup, "TILE_BYTES", tile_bytes)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=24) * 0.18
        if i % 10 == 0:
            v = centres[0]
        rows.append((i * 3 % 301, v.tolist(), int(i % 3) if i % 50 else None, "x", "y"))
    rows += [(400, None, 1, "x", "y"), (401, [], 1, "x", "y"), (402, [0.0] * 24, 1, "x", "y"), (403, [float("nan")] * 24, 1, "x", "y"),
             (404, [None] * 24, 1, "x", "y"), (405, [1.0, 2.0], 1, "x", "y"), (406, [2.0, 4.0], 1, "x", "y"), (407, [float("inf")] * 24, 1, "x", "y")]
    got = vector_dedup.near_duplicates(vector_frame(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)
    assert sum(r.n_links for r in got) > 1000


def test_vector_dedup_edges(spark):
    one = [1.0, 0.0, 0.5]
    got = vector_dedup.near_duplicates(vector_frame(spark, [(5, one, 1, "", ""), (5, one, 1, "", ""), (None, one, 1, "", ""), (7, one, 2, "", "")]))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got.collect()) == [(0, 2, 0), (5, 2, 5), (5, 2, 5), (7, 0, 7)]
    assert vector_dedup.near_duplicates(vector_frame(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7])
def test_vector_blocks_all_meet_once(spark, monkeypatch, blocks):
    rng = np.random.default_rng(blocks)
    centres = rng.normal(size=(9, 24))
    rows = [(i * 7 % 421, (centres[i % 9] + rng.normal(size=24) * 0.19).tolist(), 1, "x", "y") for i in range(420)]
    rows += [(1000 + i, rows[i % 3][1], 1, "x", "y") for i in range(40)] + [(2000 + i, [x * 1e-30 for x in rows[i][1]], 1, "x", "y") for i in range(9)]
    size = 24 * 4 * 432
    monkeypatch.setattr(vector_dedup, "TILE_BYTES", 24 * 4 * 16)
    monkeypatch.setattr(vector_dedup, "SPLIT_BYTES", size)
    monkeypatch.setattr(vector_dedup, "BLOCK_BYTES", -(-size // blocks))
    if blocks == 3:
        monkeypatch.setattr(vector_dedup, "SPLIT_BYTES", 1)  # a third of the label is smaller than a block may be
        monkeypatch.setattr(vector_dedup, "BLOCK_BYTES", size)
    got = vector_dedup.near_duplicates(vector_frame(spark, rows).repartition(5)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)
    assert sum(r.n_links for r in got) > 5000


def test_vectors_without_an_id_hold_components_together(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE_BYTES", 8)
    turn = [[math.cos(0.3 * k), math.sin(0.3 * k)] for k in range(6)]  # each links with its neighbours only
    rows = [(None if k % 2 else 10 - k, v, 1, "", "") for k, v in enumerate(turn)] + [(1, [0.0, -1.0], 1, "", ""), (6, turn[0], 2, "", "")]
    got = vector_dedup.near_duplicates(vector_frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [
        (0, 1, 0), (0, 2, 0), (0, 2, 0), (1, 0, 1), (6, 0, 6), (6, 2, 6), (8, 2, 6), (10, 1, 6)]


@pytest.mark.parametrize("spread", [0.01, 0.03, 0.15, 1.0])
def test_tiles_pair_what_cosines_link(spread):
    rng = np.random.default_rng(9)
    x = np.concatenate([(rng.normal(size=24) + spread * rng.normal(size=(n, 24))) * rng.choice([1e-12, 1, 1e12], (n, 1)) for n in (300, 77)]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    axes = (np.linalg.qr(rng.normal(size=(24, 24)))[0], 8)
    sides = [vector_dedup.Tile(0, -1, 1, np.zeros((4, len(v)), np.int64).tobytes(), v.tobytes(), 24, np.float32, axes) for v in (x[:350], x[200:])]
    got = {(i, j) for a, b in sides[0].pairs(sides[1], 0.93) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    a, b = (t.v.astype(float) / np.linalg.norm(t.v.astype(float), axis=1, keepdims=True) for t in sides)
    cosine = a @ b.T
    assert np.abs(cosine - 0.93).min() > 1e-9 and got == set(zip(*(k.tolist() for k in np.nonzero(cosine >= 0.93)), strict=True))


def test_vectors_travel_a_few_times_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE_BYTES", 1 << 14)  # 100 tiles of 64 vectors
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 1, "", "") for i, v in enumerate(rng.normal(size=(6400, 64)))]
    vector_frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/in")
    given = sum(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet"))
    java = spark.sparkContext._jvm

    def shuffled():
        nothing = java.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(nothing, False, False, spark.sparkContext._gateway.new_array(java.double, 0), nothing)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    written, before = [], set(shuffled())

    def saved(df, prefix):
        df.write.parquet(f"{tmp_path}/{len(written)}-{prefix}")
        written.append(sum(f.stat().st_size for f in (tmp_path / f"{len(written)}-{prefix}").glob("*.parquet")))
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{len(written) - 1}-{prefix}")

    monkeypatch.setattr(vector_dedup, "saved", saved)
    assert vector_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/in")).filter("n_links = 0").count() == 6400
    assert len(written) > 3 and sum(written) + sum(n for k, n in shuffled().items() if k not in before) < 4 * given


def test_vector_query_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op6_vector_dedup"](spark, sf_dir).collect()}
    assert got == brute_vectors(rows)


def test_leak_query_and_its_sql_find_short_items(spark, tmp_path):
    import duckdb

    rng = random.Random(11)
    pool = [f"w{k}" for k in range(400)]
    items = [(n * 10 + k, " ".join(rng.sample(pool, n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20) for k in range(2)] + [(990, None), (991, "...")]
    docs = []
    for i, (_, text) in enumerate(items[:28]):
        for miss in range(3):  # up to two words replaced
            w = text.split()
            for at in rng.sample(range(len(w)), min(miss, len(w))):
                w[at] = f"other{at}"
            docs.append((100 * i + miss, " ".join([f"x{k}" for k in range(rng.randint(0, 5))] + w + ["tail"] * rng.randint(0, 3))))
    docs += [(9001, None), (9002, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op7_decontamination"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES["op7_decontamination"]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)
    assert {n for *_, n in want} >= {1, 2, 3, 4, 5, 6, 7, 8, 12, 20}
