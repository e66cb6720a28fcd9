"""Exact Jaccard self-join on word shingles by grouped prefixes, and the components of its links.

Shingles are sorted in one order for all documents: rare ones by hash, then the frequent ones by count. Two sets
that reach the threshold share a shingle in their prefixes, so only prefixes are joined. Documents with equal sets are one
class; classes with equal prefix and size are one group, and groups, not documents, enter the join.

Links inside a component need not all be found, as long as no component is missed, and that keeps the work from
growing with the square of a group of near copies:

1. Star: each prefix shingle links its groups to its pivot, the group in which it stands first (in a family of near
   copies that is the one without rare shingles of its own). Candidates are as many as prefix entries.
2. Rest: only shingles whose groups still lie in different components are joined in full, and only across
   components, with length and position filters.

Both candidate lists are expanded to classes, thinned out by parity signatures (which differ in no more bits than the
sets in shingles, so no link is lost), and verified on the whole shingle sets, so the result is exact
(up to 64-bit hashes of shingles and sets). Only the order of the shingles uses counts, and any order gives the same result:
the table of frequent shingles is bounded and merely saves time.

Frequent shingles are aggregated before the shuffle and joined back (AQE may split that join); rare ones are
counted by a window. Shingle sets are made anew from the texts for candidates only, found by a bitmap of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import mix, slices, small_batches, window_hashes, word_hashes
from cinelake.llm.components import bit_of, bitmap, components, holds
from cinelake.session import saved

#: A shingle's documents within one chunk of a task that make it worth counting.
LOCAL_COUNT = 3
#: Shingles per counted chunk, and entries in the table of frequent ones (4 MB).
CHUNK = 1_000_000
FREQUENT = 1 << 18
#: Least bits of the parity signature of a set; larger sets have the power of two above 1.2 bits a shingle.
SIGNATURE_BITS = 1024
#: Groups a task remembers, so that it sends each prefix once.
REMEMBERED = 500_000


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, no word is none."""
    words = word_hashes((text or b"").lower().split())  # bytes: A-Z and the six ASCII white space characters only
    if 0 < len(words) < width:
        return mix(window_hashes(words, len(words)) ^ np.uint64(len(words)))
    return np.unique(window_hashes(words, width))


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity of the shingles per bucket. Sets that differ in d shingles have signatures that differ in d bits at most,
    and so have the halves of a signature laid on each other."""
    bits = max(SIGNATURE_BITS, 1 << (len(tokens) * 6 // 5).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_hash(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """The texts of a batch, one at a time."""
    for text in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()):
        yield text.as_py()


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their counts; equal sets of a chunk count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0))
            often = n >= LOCAL_COUNT
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([signed(tokens[often]), pa.array(n[often], pa.int64())], names=["token", "n"])

        size = 0
        for batch in slices(batches):
            for text in texts(batch):
                tokens = shingles(text, width)
                key = set_hash(tokens)
                if key not in seen:
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        yield flush()

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    got = counted.sort(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, n = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def prefixes(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per row: id, set size ``n``, class ``c``, group ``g``, how much of its prefix is rare, the prefix, and the signature.

    A task gives the prefix of a group once (null afterwards), so copies hardly add entries. Rows with a null id, which
    the join leaves out, give none.
    """
    frequent, counts = frequent_shingles(docs, width)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        sent: set[tuple[int, int]] = set()
        for batch in slices(batches):
            n, c, g, rare, rows, marks = [], [], [], [], [], []
            for unnamed, text in zip(batch.column(0).is_null().to_pylist(), texts(batch), strict=True):
                tokens = shingles(text, width)
                size = len(tokens)
                length = size - -(-num * size // den) + 1 if size else 0
                if len(frequent) and size:
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    hot = frequent[at] == tokens
                    k = size - int(np.count_nonzero(hot))
                    if k < size:
                        h = tokens[hot]
                        ordered = np.concatenate([tokens[~hot], h[np.lexsort((h, counts[at[hot]]))]])
                    else:
                        ordered = tokens
                else:
                    ordered, k = tokens, size
                prefix = ordered[:length]
                key = (size, set_hash(prefix))
                n.append(size)
                c.append(set_hash(tokens))
                g.append(key[1])
                rare.append(min(k, length))
                marks.append(signature(tokens))
                rows.append(None if unnamed or key in sent else prefix.copy().view(np.int64))
                if unnamed:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), signed(c), signed(g), pa.array(rare, pa.int32()),
                 pa.array(rows, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                names=["id", "n", "c", "g", "rare", "prefix", "mark"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, c long, g long, rare int, prefix array<long>, mark array<long>")


def needed_overlap(a: Column, b: Column, num: int, den: int) -> Column:
    """Least intersection of sets of these sizes that reaches the threshold."""
    return F.ceil((a + b) * num / (num + den) - F.lit(1e-9))


def possible(n1: str, p1: str, n2: str, p2: str, num: int, den: int) -> Column:
    """Whether sets whose first common shingle has these positions can reach the threshold."""
    a, b = F.col(n1), F.col(n2)
    return (
        (F.least(a, b) * den >= F.greatest(a, b) * num)
        & (F.least(a - F.col(p1), b - F.col(p2)) >= needed_overlap(a, b, num, den))
    )


def needed_in_prefixes(a: Column, b: Column, num: int, den: int) -> Column:
    """Least number of common prefix shingles of such sets: of the set whose prefix ends first, what lies behind it
    can add no more than its own length."""
    behind = F.ceil(F.greatest(a, b) * num / den) - 1
    return F.greatest(F.lit(1), needed_overlap(a, b, num, den) - behind)


def near_marks(num: int, den: int) -> Column:
    """Whether the signatures ``mark1`` and ``mark2`` leave it open that sets of sizes ``n1`` and ``n2`` reach the threshold."""

    def folded(mark: str, other: str) -> Column:
        half = (F.size(mark) / 2).cast("int")
        twice = F.zip_with(F.slice(mark, F.lit(1), half), F.slice(mark, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(mark) > F.size(other), twice).otherwise(F.col(mark))

    one, two = folded("mark1", "mark2"), folded("mark2", "mark1")
    apart = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    allowed = F.col("n1") + F.col("n2") - 2 * needed_overlap(F.col("n1"), F.col("n2"), num, den)
    return (F.size(one) != F.size(two)) | (apart <= allowed)


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id``, ``n``, ``c`` and the whole set (packed) of the rows whose id may be among ``ids``."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(ids, bit_of(F.col("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(holds(bits.value, batch.column("bit").to_numpy())))
            sets = [shingles(t, width) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), signed([set_hash(s) for s in sets]),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "c", "tokens"])

    found = docs.filter("id IS NOT NULL").select("id", "text", bit_of(F.col("id")).alias("bit"))
    return found.mapInArrow(run, "id long, n long, c long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (n1, c1, n2, c2, a, b) whose sets reach the threshold; a, b are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s1"), batch.column("s2"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int(np.count_nonzero(v[at] == u))
                keep.append(den * both >= num * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("c").alias("c1"), F.col("tokens").alias("s1"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("tokens").alias("s2"))
    both = pairs.join(one, ["a", "n1", "c1"]).join(two, ["b", "n2", "c2"]).select("a", "b", "s1", "s2")
    return both.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
            num: int = 75, den: int = 100) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (least id reachable by links, itself included) per row.

    Words are runs of anything but the six ASCII white space characters, A-Z lower-cased. Sets link where
    ``den * intersection >= num * union``. A text without words, or null, has an empty set and links with nothing. Ids
    are expected to be unique: rows that repeat an id are linked each by its own text. A null id links with nothing and has a null
    component. An empty table gives an empty one; columns other than the two named are left out.
    """
    with small_batches(docs.sparkSession):  # sets are large, and every Python step is an action in here
        return _similar(docs, id_col, text_col, width, num, den)


def _similar(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    p = saved(prefixes(docs, width, num, den), "prefixes")
    usable = p.filter("n > 0 AND id IS NOT NULL")
    classes = saved(usable.groupBy("n", "c").agg(
        F.min("id").alias("node"), F.first("g").alias("g"), F.first("mark").alias("mark")), "classes")

    # prefix shingles that two groups or more share, with their pivot
    entries = usable.select("n", "g", "rare", F.posexplode("prefix").alias("pos", "token"))
    place, group = F.struct("pos", "n", "g"), F.struct("g", "n")
    columns = ["token", "pos", "n", "g"]
    by_token = Window.partitionBy("token")
    rare = (
        entries.filter("pos < rare").select(*columns)
        .withColumns({"pivot": F.min(place).over(by_token), "lo": F.min(group).over(by_token), "hi": F.max(group).over(by_token)})
        .filter("lo <> hi").drop("lo", "hi")
    )
    often = entries.filter("pos >= rare").select(*columns)
    pivots = often.groupBy("token").agg(
        F.min(place).alias("pivot"), F.min(group).alias("lo"), F.max(group).alias("hi")).filter("lo <> hi").drop("lo", "hi")
    shared = saved(rare.unionByName(often.join(pivots, "token")), "shared-prefixes")

    # 1. star candidates: groups with their pivots, classes with the first class of their group
    first = classes.groupBy("n", "g").agg(F.min(F.struct("c", "node", "mark")).alias("first"))
    star = (
        shared.select("pos", "n", "g", F.col("pivot.pos").alias("ppos"), F.col("pivot.n").alias("pn"), F.col("pivot.g").alias("pg"))
        .filter("n <> pn OR g <> pg").groupBy("n", "g", "pn", "pg")
        .agg(F.count("*").alias("k"), F.bool_or(possible("n", "pos", "pn", "ppos", num, den)).alias("can"))
        .filter(F.col("can") & (F.col("k") >= needed_in_prefixes(F.col("n"), F.col("pn"), num, den)))
        .join(first.select(F.col("n").alias("pn"), F.col("g").alias("pg"), "first"), ["pn", "pg"])
        .join(classes, ["n", "g"])
        .select(F.col("n").alias("n1"), F.col("c").alias("c1"), F.col("node").alias("a"),
                F.col("pn").alias("n2"), F.col("first.c").alias("c2"), F.col("first.node").alias("b"),
                F.col("mark").alias("mark1"), F.col("first.mark").alias("mark2"))
    )
    within = classes.join(first, ["n", "g"]).filter("c <> first.c").select(
        F.col("n").alias("n1"), F.col("c").alias("c1"), F.col("node").alias("a"),
        F.col("n").alias("n2"), F.col("first.c").alias("c2"), F.col("first.node").alias("b"),
        F.col("mark").alias("mark1"), F.col("first.mark").alias("mark2"))
    star = saved(star.union(within).filter(near_marks(num, den)).drop("mark1", "mark2"), "star-pairs")
    sets = saved(shingle_sets(docs, star.select(F.explode(F.array("a", "b")).alias("id")), width), "shingle-sets")
    links = saved(verified(star, sets, num, den), "star-links")
    found = saved(components(links), "star-components")

    # 2. what is left: shingles, or groups, whose classes lie in different components
    labelled = classes.join(found.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select(
        "n", "c", "g", "node", F.coalesce("component", "node").alias("comp"))
    labelled = saved(labelled, "labelled-classes")
    spread = shared.select("token", "pos", "n", "g").join(labelled, ["n", "g"])
    # Shingles of one passage have the same holders, so a pair would meet once for each. Shingles get a key made of the extremes
    # of their holders' hashes, and a class enters once per key, with its first place. A pair that shares a shingle shares its key,
    # at places no later than the shingle's, so nothing is lost; keys that happen to agree only add candidates.
    holder = [F.xxhash64(F.lit(k), "n", "c") for k in range(4)]
    open_tokens = spread.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.xxhash64(*map(F.min, holder), *map(F.max, holder)).alias("key"),
    ).filter("lo < hi").select("token", "key")
    rest = spread.join(open_tokens, "token").groupBy("key", "n", "c").agg(
        F.min("pos").alias("pos"), F.first("node").alias("node"), F.first("comp").alias("comp"))
    rest = saved(rest, "open-prefixes")
    left = rest.select("key", *[F.col(c).alias(f"{c}1") for c in ("n", "c", "node", "comp", "pos")])
    right = rest.select("key", *[F.col(c).alias(f"{c}2") for c in ("n", "c", "node", "comp", "pos")])
    across = left.join(right, "key").filter("comp1 < comp2").filter(possible("n1", "pos1", "n2", "pos2", num, den))
    side = [labelled.select("n", "g", *[F.col(c).alias(f"{c}{k}") for c in ("c", "node", "comp")]) for k in (1, 2)]
    inside = side[0].join(side[1], ["n", "g"]).filter("comp1 < comp2").withColumns({"n1": F.col("n"), "n2": F.col("n")})
    columns = [F.col(c) for c in ("n1", "c1", "n2", "c2")] + [F.col("node1").alias("a"), F.col("node2").alias("b")]
    more = across.select(*columns).union(inside.select(*columns)).distinct()
    done = star.select("n1", "c1", "n2", "c2")
    done = done.union(star.select("n2", "c2", "n1", "c1"))
    more = more.join(done, ["n1", "c1", "n2", "c2"], "left_anti")
    for k in (1, 2):
        more = more.join(classes.select(*[F.col(c).alias(f"{c}{k}") for c in ("n", "c", "mark")]), [f"n{k}", f"c{k}"])
    more = saved(more.filter(near_marks(num, den)).select("n1", "c1", "n2", "c2", "a", "b"), "more-pairs")
    if not more.isEmpty():
        ids = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = saved(shingle_sets(docs, ids, width), "more-sets")
        joined = verified(more, sets, num, den).union(found.select("node", "component"))
        found = saved(components(joined), "components")

    label = classes.join(found.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select(
        "n", "c", F.coalesce("component", "node").alias("component_id"))
    out = p.select("id", "n", "c").join(label, ["n", "c"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
