import json
import random

import pytest
from pyspark.sql import functions as F

from cinelake.operators import codes as C
from cinelake.sources import tables as S

# two public code tables (luma pattern and macroblock type)
CBPY = ["0011", "00101", "00100", "1001", "00011", "0111", "000010", "1011", "00010", "000011", "0101", "1010",
        "0100", "1000", "0110", "11"]
TYPES = ["1", "01", "001", "00011", "000101", "0000111", "0000110", "000100"]


def codes(spark, tables):
    rows = [(t, c, i) for t, cs in tables.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "table_id string, code string, symbol int")


def test_audit(spark):
    df = codes(spark, {"cbpy": CBPY, "dup": ["0", "0", "1"], "pre": ["0", "01", "011", "1"], "deep": ["1", "0" * 35]})
    got = {r.table_id: r for r in C.audit(df).collect()}
    c = got["cbpy"]
    assert (c.codes, c.distinct_codes, c.kraft_numerator * 32, c.kraft_denominator, c.conflicts, c.complete) == (
        16, 16, 31 * 64, 64, 0, False)
    assert (c.min_length, c.max_length, c.bijective, c.prefix_free) == (2, 6, True, True)
    d = got["dup"]
    assert (d.bijective, d.distinct_codes, d.kraft_numerator, d.kraft_denominator) == (False, 2, 3, 2)
    p = got["pre"]
    assert (p.conflicts, p.prefix_free) == (3, False)
    # far too close to one for a float
    assert got["deep"].kraft_numerator == 2**34 + 1 and not got["deep"].complete
    long = C.kraft(codes(spark, {"edge": ["1" * 62, "0"], "over": ["1" * 63, "0"], "far": ["1" * 64]}))
    assert {r.table_id: (r.kraft_numerator, r.kraft_denominator, r.complete) for r in long.collect()} == {
        "edge": (2**61 + 1, 2**62, False), "over": (None, None, None), "far": (None, None, None)}
    k = {r.table_id: r.complete for r in C.kraft(codes(spark, {"t": ["0", "10", "11"], "u": TYPES})).collect()}
    assert k["t"]


def test_prefix_conflict_pairs(spark):
    rng = random.Random(4)
    cs = ["".join(rng.choice("01") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    got = {(r.short_code, r.long_code) for r in C.prefix_conflicts(codes(spark, {"t": cs})).collect()}
    assert got == {(a, b) for a in set(cs) for b in set(cs) if a != b and b.startswith(a)}


@pytest.mark.parametrize("start", ["", "1" * 20])
def test_prefix_lookup(spark, start):
    rng = random.Random(9)
    table = [start + "".join(rng.choice("01") for _ in range(rng.randrange(2, 13))) for _ in range(40)]
    probes = [start + "".join(rng.choice("01") for _ in range(rng.randrange(1, 16))) for _ in range(200)] + ["", "0", start]
    df = spark.createDataFrame([(i, "t", p) for i, p in enumerate(probes)], "id int, table_id string, bits string")
    got = {r.id: (r.code, r.symbol) for r in C.prefix_lookup(df, "bits", codes(spark, {"t": table, "u": ["0", "1"]})).collect()}
    for i, p in enumerate(probes):
        hits = sorted((len(c), s, c) for s, c in enumerate(table) if p.startswith(c))
        assert got[i] == ((hits[0][2], hits[0][1]) if hits else (None, None))


def test_prefix_lookup_in_large_tables_with_long_common_starts(spark):
    table = ["1" * 30 + f"{k:011b}" for k in range(1100)]
    rows = [(k, "t", "1" * 30 + f"{k:011b}" + "01") for k in range(0, 1200, 7)] + [(5000, "none", "0"), (5001, "t", None), (5002, None, "0")]
    df = spark.createDataFrame(rows, "id int, table_id string, bits string")
    found = C.prefix_lookup(df, "bits", codes(spark, {"t": table, "other": ["0", "10"]}))
    got = {r.id: r.symbol for r in found.collect()}
    assert got == {k: (k if k < 1100 else None) for k, *_ in rows}


def test_votes(spark):
    obs = spark.createDataFrame(
        [("t", 0, "01")] * 3 + [("t", 0, "1")] * 3 + [("t", 0, "00")] + [("t", 1, "1")] * 2 + [("u", 0, "1")],
        "table_id string, symbol int, code string")
    votes = C.count_votes(obs)
    best = {(r.table_id, r.symbol): (r.code, r.n) for r in C.majority(votes).collect()}
    assert best == {("t", 0): ("1", 3), ("t", 1): ("1", 2), ("u", 0): ("1", 1)}
    top = sorted((r.table_id, r.symbol, r["rank"], r.code) for r in C.top_codes(votes, 2).collect())
    assert top == [("t", 0, 1, "1"), ("t", 0, 2, "01"), ("t", 1, 1, "1"), ("u", 0, 1, "1")]
    bad = C.inconsistent(obs).collect()
    assert [(r.table_id, r.code, r.symbols, r.counts) for r in bad] == [("t", "1", 2, {0: 3, 1: 2})]


def slow_resolve(votes):
    """One vote after the other, strongest first."""
    ranked = sorted((-n, len(c), c, s) for s, codes in votes.items() for c, n in codes.items())
    kept = {}
    for m, _, c, s in ranked:
        if s not in kept and not any(c.startswith(k) or k.startswith(c) for k, _ in kept.values()):
            kept[s] = (c, -m)
    return kept


def test_resolve_votes(spark):
    rng = random.Random(11)
    tables = {"alternate": {0: {"0": 2, "01": 2}, 1: {"0": 2, "01": 2}, 2: {"1": 9}}}
    for t in range(4):
        tables[f"t{t}"] = {
            s: {"".join(rng.choice("01") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 9) for _ in range(4)}
            for s in range(14)}
    rows = [(t, s, c, n) for t, v in tables.items() for s, cs in v.items() for c, n in cs.items()]
    df = spark.createDataFrame(rows, "table_id string, symbol int, code string, n bigint")
    got = {}
    for r in C.resolve_votes(df).collect():
        got.setdefault(r.table_id, {})[int(r.symbol)] = (r.code, r.n)
    assert got == {t: slow_resolve(v) for t, v in tables.items()}


def test_set_operations(spark):
    a = codes(spark, {"t": ["00", "01", "10"]})
    b = codes(spark, {"t": ["01", "11"]}).withColumn("symbol", F.col("symbol") + 10)
    merged = {r.code: r.symbol for r in C.merge_codes(a, b).collect()}
    assert merged == {"00": 0, "01": 10, "10": 2, "11": 11}
    assert sorted(r.code for r in C.new_codes(a, b).collect()) == ["00", "10"]
    assert [r.code for r in C.common_codes(a, b).collect()] == ["01"]
    assert sorted(r.code for r in C.known_only(a, b).collect()) == ["01"]
    known = codes(spark, {"t": ["010", "1"]})
    assert sorted(r.code for r in C.disjoint_from(a, known).collect()) == ["00"]
    assert C.distinct_values(a, "table_id").count() == 1
    d = {r.symbol: r["class"] for r in C.diff_codes(
        a, spark.createDataFrame([("t", "00", 0), ("t", "111", 1), ("t", "0", 7)], "table_id string, code string, symbol int")
    ).collect()}
    assert d == {0: "match", 1: "mismatch", 2: "missing", 7: "new"}
    assert sorted(r.symbol for r in C.missing_symbols(a, 5).collect()) == [3, 4]
    assert [r.code for r in C.canonical(codes(spark, {"t": ["10", "1", "01"]})).collect()] == ["1", "01", "10"]


def test_gaps(spark):
    values = [0, 1, 4, 4, 9, 17]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    for bucket in (4, 1 << 16):
        assert sorted(r.v for r in C.gaps(df, "v", bucket).collect()) == [v for v in range(18) if v not in values]
    assert C.gaps(df.filter("v < 0"), "v").count() == 0


def test_common_prefix_suffix(spark):
    df = spark.createDataFrame([("a", "abcxyz"), ("a", "abdyz"), ("a", "abyz"), ("b", "q"), ("c", ""), ("c", "z")],
                               "k string, s string")
    got = {r.k: (r.p, r.q) for r in df.groupBy("k").agg(C.lcp(F.col("s")).alias("p"), C.lcs(F.col("s")).alias("q")).collect()}
    assert got == {"a": ("ab", "yz"), "b": ("q", "q"), "c": ("", "")}
    d = spark.createDataFrame([("abc", "abd"), ("ab", "abc"), ("x", "x"), ("", "a")], "a string, b string")
    assert [r[0] for r in d.select(C.first_diff(F.col("a"), F.col("b"))).collect()] == [2, 2, 1, 0]


def test_anchor_and_best(spark):
    obs = spark.createDataFrame([(1, "t", 5, "0010111"), (2, "t", 5, "1110"), (3, "t", 6, "01"), (4, "t", 5, "0" * 23 + "111")],
                                "id int, table_id string, anchor int, segment string")
    anchors = spark.createDataFrame([("t", 5, "111")], "table_id string, anchor int, anchor_code string")
    assert [(r.id, r.code) for r in C.split_at_anchor(obs, anchors, max_at=22).collect()] == [(1, "0010")]
    far = sorted((r.id, len(r.code)) for r in C.split_at_anchor(obs, anchors).collect())
    assert far == [(1, 4), (4, 23)]
    df = spark.createDataFrame([("a", 2.0, 1, "x"), ("a", 1.0, 2, "y"), ("a", 1.0, 1, "z")], "k string, e double, t int, v string")
    assert [tuple(r) for r in C.best_candidate(df, ["k"], "e", ["t"]).collect()] == [("a", 1.0, 1, "z")]
    rl = spark.createDataFrame([("t", 0, 1, 3), ("t", 0, 1, 5), ("t", 1, 0, 2)], "table_id string, last int, run int, level int")
    assert sorted(tuple(r) for r in C.max_by_group(rl).collect()) == [("t", 0, 1, 5), ("t", 1, 0, 2)]


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "rl.json").write_text(json.dumps({"0,1,0": "10", "3,2,1": "0111"}))
    (tmp_path / "mb.json").write_text(json.dumps({"00_0101": "1", "11_0000": "01"}))
    (tmp_path / "dc.json").write_text(json.dumps({"00": 5, "01": -3}))
    (tmp_path / "pair.json").write_text(json.dumps({"00": [0, 12]}))
    (tmp_path / "cut.json").write_text('{"00": [0, 12], "01": [1')
    rl = {r.code: (r.symbol, r.parts, r.table_id) for r in S.read_codes(spark, f"{tmp_path}/rl.json", "symbol_code").collect()}
    assert rl == {"10": ("0,1,0", ["0", "1", "0"], "rl"), "0111": ("3,2,1", ["3", "2", "1"], "rl")}
    mb = {r.code: r.parts for r in S.read_codes(spark, f"{tmp_path}/mb.json", "symbol_code").collect()}
    assert mb == {"1": ["00", "0101"], "01": ["11", "0000"]}
    dc = {r.code: r.symbol for r in S.read_codes(spark, f"{tmp_path}/dc.json", "code_value").collect()}
    assert dc == {"00": "5", "01": "-3"}
    pair = S.read_codes(spark, f"{tmp_path}/pair.json", "code_pair").collect()
    assert [(r.code, r.parts) for r in pair] == [("00", ["0", "12"])]
    cut = S.read_codes(spark, f"{tmp_path}/cut.json", "code_pair").collect()
    assert len(cut) == 1 and cut[0].code is None and cut[0]._corrupt_record.startswith('{"00"')
    (tmp_path / "votes.json").write_text(json.dumps({"0": {"5": {"01": 3, "1": 1}}, "1": {"7": {"0": 2}}}))
    votes = sorted(tuple(r)[:4] for r in S.read_votes(spark, f"{tmp_path}/votes.json").collect())
    assert votes == [("0", "5", "01", 3), ("0", "5", "1", 1), ("1", "7", "0", 2)]
    (tmp_path / "points.json").write_text('[[36, 25, 31, true, 36, 3, "1", 0, 0, "1"]]')
    p = S.read_points(spark, f"{tmp_path}/points.json").first()
    assert (p.left, p.topleft, p.top, p.from_left, p.true_pred, p.blk, p.ac_pred, p.frame) == (36, 25, 31, True, 36, 3, "1", "1")
    text = spark.createDataFrame([(1, 'x = {"0101": {3, -2}, "1": {0,0},')], "id int, value string")
    assert sorted(tuple(r) for r in S.codes_from_text(text).collect()) == [(1, "0101", 3, -2), (1, "1", 0, 0)]
    S.write_codes(codes(spark, {"t": ["10", "0", "11"]}), f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out").first()
    assert back.value == '{"0":"1","10":"0","11":"2"}'
    packets = spark.createDataFrame([("avi", 1), ("asf", 2)], "container string, seq int")
    S.write_table(packets, f"{tmp_path}/packets")
    plan = spark.read.parquet(f"{tmp_path}/packets").filter("container = 'avi'")
    assert plan.count() == 1
    lit = spark.createDataFrame([("AAABAA==", "117bd240")], "b string, h string")
    r = lit.select(S.from_base64(F.col("b")).alias("b"), S.from_hex(F.col("h")).alias("h")).first()
    assert (bytes(r.b).hex(), bytes(r.h).hex()) == ("00000100", "117bd240")
