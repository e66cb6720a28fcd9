"""Benchmark decontamination with spaced seeds. DataFrame operations only.

Words are lower-cased runs of letters and digits. Every mask is laid on every place of a text and hashes the words under
its ones; words under its zeros may differ. Hashes of documents and of benchmark items are joined, which gives
(document, item, diagonal) candidates. Each candidate is verified on the words themselves: item and document are
laid on each other along the diagonal, and the item counts as contained if ``LEAST`` of some ``WINDOW`` consecutive
item words agree (all of the item but a sixth where it is shorter).

The masks find every overlap within that tolerance: whichever two words of twelve are replaced, one of
them fits beside the replacements. On items of eight words they have one place only and leave some replacements out, and
shorter items hold no mask; such items have masks of their own (``SHORT``), laid on documents only if the benchmark has
items of that length.

Seeds of the benchmark are broadcast while their number is below a bound, and joined by shuffle beyond
it. Hits are combined per document, item and diagonal before the shuffle, and texts are read again only for candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import small_side
from cinelake.session import saved

MASKS = ("10101111", "11100111", "11101101")
#: Masks of the items with so few words; for those of a mask's length besides ``MASKS``.
SHORT = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("11111",), 6: ("001111", "110011", "111100"),
         7: ("0011111", "1100111", "1111001", "1111110"), 8: ("01011111", "11111010")}
WINDOW, LEAST = 12, 10


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def seeds(rows: DataFrame, keys: list[str], masks: dict[int, str]) -> DataFrame:
    """``keys``, mask number, place and hash of every seed of the ``hashes`` array."""
    n = F.size("hashes")

    def laid(mask: str) -> Column:
        ones = [k for k, one in enumerate(mask) if one == "1"]
        places = F.when(n >= len(mask), F.sequence(F.lit(0), n - len(mask))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in ones]))

    numbered = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), laid(m).alias("seeds")) for k, m in masks.items()]))
    each = rows.select(*keys, numbered.alias("m")).select(*keys, F.col("m.mask").alias("mask"), F.col("m.seeds").alias("seeds"))
    return each.select(*keys, "mask", F.posexplode("seeds").alias("place", "seed"))


def overlap(item: str, text: str, diagonal: str) -> Column:
    """1 or 0 per item word: does the text hold the same word on the diagonal?"""
    return F.transform(F.col(item), lambda w, k: F.coalesce(
        F.when(k + F.col(diagonal) >= 0, F.get(text, k + F.col(diagonal)) == w), F.lit(False)).cast("int"))


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
          short: dict[int, tuple[str, ...]] = SHORT) -> DataFrame:
    """One row per document and contained item: ``id_col``, ``text_hash``, ``item_col``, ``diagonal`` (document word
    under the item's first), ``matched`` (agreeing words) and ``item_words``; of several diagonals the best.

    Null texts and texts without words hold and are held by nothing; without ``short``, nor are items of fewer words than a
    mask. A null id, of documents or items, is carried as null and stands for a value. Repeated rows give one result; items with equal texts give one each. Empty tables give no rows. Columns
    other than those named are left out.
    """
    span = len(masks[0])
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    size = F.size("item_words")
    bench = saved(items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("item_words"))
                  .filter((size >= span) | size.isin(list(short))).distinct()
                  .withColumn("k", F.xxhash64("item", "item_words")), "items")  # k: not null, and one join key for all kinds
    few = {r[0] for r in bench.filter(size.isin(list(short))).select(size).distinct().collect()}  # at most len(short) rows
    hashed = bench.withColumn("hashes", F.transform("item_words", lambda w: F.xxhash64(w)))
    used = dict(enumerate(masks))
    known = seeds(hashed.filter(size >= span), ["k"], used)
    for n_words in sorted(few):
        own = dict(enumerate(short[n_words], len(used)))
        known = known.union(seeds(hashed.filter(size == n_words), ["k"], own))
        used |= own
    known = saved(known.withColumnRenamed("place", "item_place"), "item-seeds")
    hashes = docs.select("id", "t", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    least = min(map(len, used.values()))
    hits = seeds(hashes.filter(F.size("hashes") >= least), ["id", "t"], used).join(small_side(known), ["mask", "seed"])
    found = saved(hits.groupBy("id", "t", "k", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(
        F.count("*").alias("hits")), "candidates")

    ids = saved(found.select(F.col("id").alias("id_"), F.col("t").alias("t_")).distinct(), "candidate-rows")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_"))
    texts = docs.join(small_side(ids), same, "left_semi").dropDuplicates(["id", "t"])
    texts = texts.select(F.col("id").alias("id_"), F.col("t").alias("t_"), words(F.col("text")).alias("words"))
    laid = (
        found.join(texts, same).join(small_side(bench), "k")
        .withColumn("same", overlap("item_words", "words", "diagonal"))
        .select("id", "t", "item", "diagonal", "same")
    )
    n = F.size("same")
    width = F.least(n, F.lit(WINDOW))
    enough = F.ceil(width * F.lit(LEAST) / F.lit(WINDOW))
    contained = F.exists(F.sequence(F.lit(1), n - width + 1), lambda s: F.aggregate(
        F.slice("same", s, width), F.lit(0), lambda a, x: a + x) >= enough)
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    best = laid.filter(contained).groupBy("id", "t", "item").agg(
        F.max(F.struct(matched.alias("matched"), (-F.col("diagonal")).alias("back"), n.alias("words"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), F.col("item").alias(item_col),
                       (-F.col("b.back")).cast("long").alias("diagonal"), F.col("b.matched").cast("long").alias("matched"),
                       F.col("b.words").cast("long").alias("item_words"))


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that hold no benchmark item, with all their columns."""
    bad = small_side(saved(leaks(docs, items, id_col=id_col, text_col=text_col).select(
        F.col(id_col).alias("id"), F.col("text_hash").alias("t")).distinct(), "leaking-rows"))
    same = docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text_col]) == bad["t"])
    return docs.join(bad, same, "left_anti")
