"""Mixing to target weights against plain Python."""

import math
import random
from collections import defaultdict
from fractions import Fraction

from cinelake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, id long, tie string, _place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, -1, 0, "x", 3) for i, t, s in rows], SCHEMA).repartition(3)


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Targets per source by sharing, capping and sharing again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - most * sum(sizes[s] for s in capped)
        rest = [s for s in order if s not in capped]
        unit = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * unit > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * unit for s in order}
        capped |= over


def check(rows, got):
    sizes, own = defaultdict(int), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += words(t)
        own[s].append(words(t))
    want = plain_targets(sizes)
    assert sorted(r.size for r in got) == sorted(words(t) for _, t, _ in rows)
    taken, source = defaultdict(int), {}
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        source.setdefault((r.source_size, r.target), 0)
        taken[r.source_size, r.target] += r.taken
    for s, n in sizes.items():
        key = next(k for k in source if k[0] == n and math.isclose(k[1], float(want[s]), rel_tol=1e-12, abs_tol=1e-12))
        same = sum(1 for t in sizes if sizes[t] == n and want[t] == want[s])
        assert abs(taken[key] - same * want[s]) <= 2 * same * max(own[s], default=0) + 1e-6, s
    return want


def test_targets_and_copies(spark):
    rng = random.Random(5)
    rows = []
    for s, n in (("a", 900), ("b", 40), ("B", 3), ("é", 200), (None, 60), ("zero", 4), ("long", 30)):
        for _ in range(n):
            k = rng.choice([1, 3, 10, 200]) if s == "long" else rng.randint(0, 30)
            rows.append((rng.randint(0, 400), None if s == "zero" else " w\x0bü " * k, s))
    got = mixing.mix(frame(spark, rows)).collect()
    want = check(rows, got)
    assert any(want[s] == 2 * sum(words(t) for _, t, x in rows if x == s) for s in want)  # some source is at its limit
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_long_texts_ties_and_a_hot_source(spark):
    rows = [(i, "same words here", "hot") for i in range(3000)] + [(5, "word " * 100_000, "x"), (5, "word " * 100_000, "x"), (None, "a b", None), (None, "a b", None)]
    got = mixing.mix(frame(spark, rows)).collect()
    check(rows, got)
    hot = [r for r in got if r.size == 3]
    assert abs(sum(r.copies for r in hot) - hot[0].target / 3) < 1 and len({r.copies for r in hot}) <= 2


def test_mixing_edges(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    got = mixing.mix(frame(spark, [(1, None, "a"), (None, "", None), (2, " \t", "a")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 3
    one = mixing.mix(frame(spark, [(1, "a b c", "s")])).collect()
    assert one[0].target == 4.5 and one[0].copies in (1, 2)
    even = mixing.mix(frame(spark, [(i, "a", "s") for i in range(10)]), weights=(1,), share=(3, 1), most=3).collect()
    assert {r.copies for r in even} == {3}
