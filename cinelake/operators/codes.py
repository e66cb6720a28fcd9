"""Variable-length code tables: audits, votes, lookups, differences.

``codes`` has table_id, code (a string of 0 and 1) and symbol; ``observations`` the same columns with
repeats; ``votes`` adds a count ``n``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.operators.lookup import lookup_join
from cinelake.operators.ranking import positions
from cinelake.operators.scan import chunk_of
from cinelake.session import saved

TABLE = "table_id"
KEY = [TABLE, "code"]
# longest code whose Kraft weight is an exact 64-bit integer
MAX_CODE_BITS = 62


def prefixes(code: Column, whole: bool = False) -> Column:
    """Proper prefixes of a code as an array (``whole`` adds the code itself)."""
    last = F.length(code) if whole else F.length(code) - 1
    every = F.transform(F.sequence(F.lit(1), last), lambda n: F.substring(code, F.lit(1), n))
    return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))


def prefix_conflicts(codes: DataFrame) -> DataFrame:
    """Pairs (short_code, long_code) of one table where the first starts the second.

    Each distinct code looks up its own proper prefixes by hash, so work and output are at most
    codes x code length, never codes x codes.
    """
    distinct = codes.select(*KEY).distinct()
    probes = distinct.select(
        TABLE, F.col("code").alias("long_code"), F.explode(prefixes(F.col("code"))).alias("short_code")
    )
    return probes.join(distinct.withColumnRenamed("code", "short_code"), [TABLE, "short_code"]).select(
        TABLE, "short_code", "long_code"
    )


def kraft(codes: DataFrame) -> DataFrame:
    """Kraft sum per table as exact integers: ``numerator`` / ``denominator`` (2^longest code).

    Every entry counts, repeated codes too; 1 means the code is complete. A table with a code of more than
    62 bits has no exact 64-bit sum: its three columns are null.
    """
    return audit(codes, conflicts=False).select(TABLE, "kraft_numerator", "kraft_denominator", "complete")


def audit(codes: DataFrame, conflicts: bool = True) -> DataFrame:
    """Per table: entries, distinct codes, lengths, Kraft sum, bijective and prefix-free flags.

    Entries are first counted per code (partial sums before the shuffle), then per table.
    """
    length = F.length("code")
    room = F.lit(MAX_CODE_BITS) - length
    weight = F.when(room >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), room))
    per_code = codes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    per_table = per_code.groupBy(TABLE).agg(
        F.sum("n").alias("codes"),
        F.count(F.lit(1)).alias("distinct_codes"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.sum(weight.cast("decimal(20,0)") * F.col("n").cast("decimal(12,0)")).alias("weight"),
    )
    exact = F.col("max_length") <= MAX_CODE_BITS
    unit = F.when(exact, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(MAX_CODE_BITS) - F.col("max_length")))
    whole = F.when(exact, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("max_length")))
    out = per_table.withColumns(
        {
            "kraft_numerator": (F.col("weight") / unit).cast("decimal(38,0)").cast("bigint"),
            "kraft_denominator": whole,
            "bijective": F.col("codes") == F.col("distinct_codes"),
        }
    ).withColumn("complete", F.col("kraft_numerator") == F.col("kraft_denominator")).drop("weight")
    if not conflicts:
        return out
    found = prefix_conflicts(codes).groupBy(TABLE).agg(F.count(F.lit(1)).alias("found"))
    n = F.coalesce(F.col("found"), F.lit(0))
    return out.join(found, TABLE, "left").withColumns({"conflicts": n, "prefix_free": n == 0}).drop("found")


def prefix_free_part(codes: DataFrame) -> DataFrame:
    """One symbol (the smallest) per code, without codes that a shorter code of the table starts."""
    one = codes.groupBy(*KEY).agg(F.min("symbol").alias("symbol"))
    shadowed = prefix_conflicts(codes).select(TABLE, F.col("long_code").alias("code")).distinct()
    return one.join(shadowed, KEY, "left_anti")


def prefix_lookup(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """Match the start of a bit string against its table's codes; the shortest code wins.

    Adds ``code`` and ``symbol`` (null when nothing matches). Where no code starts another, the only code that can start
    a string is the greatest one not after it. A table of n codes is cut into about sqrt(n) stretches of its order; a
    probe finds its stretch among their first codes and its code inside the stretch, so it looks at some 2 sqrt(n)
    codes however long their common starts are. Both steps are equi-joins with small rows; probes are neither multiplied nor regrouped.
    """
    free = saved(prefix_free_part(codes), "free-codes")
    placed = positions(free, [TABLE, "code"], "_at")
    tables = placed.groupBy(TABLE).agg(F.min("_at").alias("_first"), F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_step"))
    ranged = placed.join(tables, TABLE).withColumn(
        "_range", F.call_function("div", F.col("_at") - F.col("_first"), F.col("_step")).cast("int"))
    index = saved(ranged.groupBy(TABLE, "_range").agg(F.array_sort(F.collect_list(F.struct("code", "symbol"))).alias("_c")), "stretches")
    starts = index.groupBy(TABLE).agg(F.array_sort(F.collect_list(F.col("_c")[0]["code"])).alias("_starts"))
    bits = F.col(col)
    probe = lookup_join(df, starts, [TABLE], "left", computed=True)
    probe = probe.withColumn("_range", F.size(F.filter("_starts", lambda s: s <= bits)) - 1).drop("_starts")
    found = lookup_join(probe, index, [TABLE, "_range"], "left")
    last = F.try_element_at(F.filter("_c", lambda c: c["code"] <= bits), F.lit(-1))
    hit = F.when(F.startswith(bits, last["code"]), last)
    return found.withColumn("_hit", hit).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("_hit.code").alias("code"), F.col("_hit.symbol").alias("symbol")
    )


def split_at_anchor(
    obs: DataFrame, anchors: DataFrame, on: Sequence[str] = (TABLE, "anchor"), max_at: int | None = None
) -> DataFrame:
    """Cut each ``segment`` at the first place its known anchor code (``anchor_code``) occurs.

    Keeps hits from 1 on, up to ``max_at`` if given; ``code`` is the unknown text before the anchor.
    """
    joined = lookup_join(obs, anchors.select(*on, "anchor_code"), list(on), computed=True)
    at = F.call_function("instr", F.col("segment"), F.col("anchor_code")) - 1
    return (
        joined.withColumn("anchor_at", at)
        .filter(F.col("anchor_at") >= 1 if max_at is None else F.col("anchor_at").between(1, max_at))
        .withColumn("code", F.substring(F.col("segment"), F.lit(1), F.col("anchor_at")))
    )


def missing_symbols(codes: DataFrame, n: int) -> DataFrame:
    """Symbols 0..n-1 that a table lacks (``symbol`` numeric)."""
    domain = codes.select(TABLE).distinct().select(
        TABLE, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("symbol")
    )
    have = codes.select(TABLE, F.col("symbol").cast("int").alias("symbol")).distinct()
    return domain.join(have, [TABLE, "symbol"], "left_anti")


def diff_codes(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """Stored against observed code per symbol: match, mismatch, missing (not observed) or new."""
    s = stored.select(TABLE, "symbol", F.col("code").alias("stored_code"))
    o = observed.select(TABLE, "symbol", F.col("code").alias("observed_code"))
    kind = (
        F.when(F.col("observed_code").isNull(), "missing")
        .when(F.col("stored_code").isNull(), "new")
        .when(F.col("stored_code") == F.col("observed_code"), "match")
        .otherwise("mismatch")
    )
    return s.join(o, [TABLE, "symbol"], "full_outer").withColumn("class", kind)


def known_only(obs: DataFrame, codes: DataFrame) -> DataFrame:
    """Observations whose code is in the table."""
    return lookup_join(obs, codes.select(*KEY).distinct(), KEY, "left_semi", computed=True)


def disjoint_from(obs: DataFrame, codes: DataFrame) -> DataFrame:
    """Observations whose code neither equals, starts nor extends a known code of the table."""
    known = codes.select(*KEY).distinct()
    seen = obs.select(*KEY).distinct()
    extends = (
        seen.select(*KEY, F.explode(prefixes(F.col("code"), whole=True)).alias("start"))
        .join(known.withColumnRenamed("code", "start"), [TABLE, "start"], "left_semi")
        .select(*KEY)
    )
    starts = known.select(TABLE, F.explode(prefixes(F.col("code"))).alias("code"))
    clash = extends.unionByName(seen.join(starts, KEY, "left_semi")).distinct()
    return lookup_join(obs, clash, KEY, "left_anti", computed=True)


def count_votes(obs: DataFrame) -> DataFrame:
    return obs.groupBy(TABLE, "symbol", "code").agg(F.count(F.lit(1)).alias("n"))


def _preference() -> list[Column]:
    """Most votes first; equal votes go to the shorter, then the smaller code."""
    return [F.desc("n"), F.length("code"), F.col("code")]


def majority(votes: DataFrame) -> DataFrame:
    """The code with most votes per symbol; equal votes go to the shorter, then the smaller code."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.length("code").alias("l"), "code"))
    return votes.groupBy(TABLE, "symbol").agg(best.alias("b")).select(
        TABLE, "symbol", F.col("b.code").alias("code"), (-F.col("b.m")).alias("n")
    )


def top_codes(votes: DataFrame, k: int) -> DataFrame:
    """The ``k`` best codes per symbol with their rank; each task limits its groups before the shuffle."""
    w = Window.partitionBy(TABLE, "symbol").orderBy(*_preference())
    return votes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def inconsistent(obs: DataFrame) -> DataFrame:
    """Codes seen with more than one symbol, with a map symbol -> count."""
    per = obs.groupBy(*KEY, "symbol").agg(F.count(F.lit(1)).alias("n"))
    return (
        per.groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("symbols"),
            F.sum("n").alias("observations"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "n")))).alias("counts"),
        )
        .filter(F.col("symbols") > 1)
    )


def max_by_group(codes: DataFrame, value: str = "level", by: Sequence[str] = ("last", "run")) -> DataFrame:
    """Largest ``value`` per table and group (largest level per run, or largest run per level)."""
    return codes.groupBy(TABLE, *by).agg(F.max(value).alias(f"max_{value}"))


def common_start(a: Column, b: Column) -> Column:
    """How many leading characters two strings share.

    Steps of halving size, each comparing only the characters it adds: a linear number of
    comparisons in whole slices, instead of one per character.
    """
    n = F.least(F.length(a), F.length(b))
    top = F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")

    def step(done: Column, power: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), power)
        same = F.substring(a, done + 1, size) == F.substring(b, done + 1, size)
        return F.when((done + size <= n) & same, done + size).otherwise(done)

    return F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), step)


def first_diff(a: Column, b: Column) -> Column:
    """Zero-based position where two strings first differ (where the shorter ends, if it starts the other)."""
    return common_start(a, b)


def lcp(s: Column) -> Column:
    """Aggregate: longest common prefix of a group = that of its smallest and largest string."""
    low, high = F.min(s), F.max(s)
    return F.substring(low, F.lit(1), common_start(low, high))


def lcs(s: Column) -> Column:
    """Aggregate: longest common suffix of a group."""
    return F.reverse(lcp(F.reverse(s)))


def canonical(codes: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Canonical order: by code length then code, or by the given columns."""
    keys = [TABLE, F.length("code"), "code"] if by is None else [TABLE, *by]
    return codes.orderBy(*keys)


def best_candidate(df: DataFrame, keys: Sequence[str], error: str, tie: Sequence[str]) -> DataFrame:
    """The row with the smallest error per key; ``tie`` columns decide equal errors."""
    rest = [c for c in df.columns if c not in {*keys, error, *tie}]
    best = F.min(F.struct(error, *tie, *rest))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, *[f"b.{c}" for c in [error, *tie, *rest]])


def merge_codes(a: DataFrame, b: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    """Union of two tables; on an equal key the entry of ``b`` wins."""
    on = list(on)
    rest = [c for c in a.columns if c not in on]
    both = a.withColumn("_side", F.lit(0)).unionByName(b.select(*a.columns).withColumn("_side", F.lit(1)))
    return both.groupBy(*on).agg(F.max(F.struct("_side", *rest)).alias("m")).select(*on, *[f"m.{c}" for c in rest])


def new_codes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of ``a`` whose (table, code) is not in ``b``."""
    return a.join(b.select(*KEY).distinct(), KEY, "left_anti")


def common_codes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys (table, code) present in both."""
    return a.select(*KEY).intersect(b.select(*KEY))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def gaps(df: DataFrame, col: str, bucket: int = 1 << 16) -> DataFrame:
    """Integers of 0..max that a column lacks.

    The range is cut into buckets; a bucket's distinct values (at most ``bucket`` of them) are
    subtracted from its range, so neither the values nor the gaps meet in one task.
    """
    v = F.col(col).cast("bigint")
    values = df.select(v.alias("v")).filter(F.col("v") >= 0)
    have = values.groupBy(chunk_of("v", bucket).alias("b")).agg(F.collect_set("v").alias("have"))
    top = values.agg(F.max("v").alias("top")).filter(F.col("top").isNotNull())
    every = top.select("top", F.explode(F.sequence(F.lit(0).cast("bigint"), chunk_of("top", bucket))).alias("b"))
    low = F.col("b") * bucket
    span = F.sequence(low, F.least(low + (bucket - 1), F.col("top")))
    empty = F.array().cast("array<bigint>")
    return every.join(have, "b", "left").select(
        F.explode(F.array_except(span, F.coalesce(F.col("have"), empty))).alias(col)
    )


def resolve_votes(votes: DataFrame) -> DataFrame:
    """A prefix-free pick per symbol, strongest votes first.

    A vote is kept if its symbol has no code yet and its code neither equals, starts nor extends a code kept
    before it in its table. Votes are ranked by count; equal ones by shorter, then smaller code, then symbol. Symbols
    whose codes all clash get none.

    Each round keeps every vote that beats all it clashes with and drops those it rules out. That gives
    the picks of the strict order, while rounds grow with the longest chain of clashes, not with the votes.
    """
    ranked = votes.select(
        TABLE, "symbol", "code", "n", F.struct((-F.col("n")).alias("m"), F.length("code").alias("l"), "code", "symbol").alias("place"))
    left = saved(ranked, "votes")
    kept = left.limit(0).select(TABLE, "symbol", "code", "n")
    while not left.isEmpty():
        by_symbol = left.groupBy(TABLE, "symbol").agg(F.min("place").alias("of_symbol"))
        best = left.groupBy(*KEY).agg(F.min("place").alias("best"))
        starts = best.select(*KEY, "best", F.explode(prefixes(F.col("code"), whole=True)).alias("start"))
        longer = starts.groupBy(TABLE, F.col("start").alias("code")).agg(F.min("best").alias("of_longer"))
        shorter = (
            starts.select(*KEY, "start").join(best.select(TABLE, F.col("code").alias("start"), "best"), [TABLE, "start"])
            .groupBy(*KEY).agg(F.min("best").alias("of_shorter"))
        )
        rivals = F.least("of_symbol", "of_longer", "of_shorter")
        judged = left.join(by_symbol, [TABLE, "symbol"]).join(longer, KEY).join(shorter, KEY)
        won = saved(judged.filter(F.col("place") == rivals).select(TABLE, "symbol", "code", "n"), "kept-votes")
        kept = kept.unionByName(won)
        starting = won.select(TABLE, F.explode(prefixes(F.col("code"), whole=True)).alias("code"))
        extending = starts.join(won.select(TABLE, F.col("code").alias("start")), [TABLE, "start"], "left_semi").select(*KEY)
        left = saved(
            left.join(won.select(TABLE, "symbol"), [TABLE, "symbol"], "left_anti")
            .join(starting.union(extending).distinct(), KEY, "left_anti"), "votes")
    return kept
