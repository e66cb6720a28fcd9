"""Substring deduplication with one compressed FM-index per shard.

A window is ``width`` consecutive words. A word goes if a window over it also starts in a document with a smaller
id. Comparing every document with an index of every shard would grow with the square of the corpus, so the
text is routed instead: the least hash of the short runs of words inside a window (its minimizer) is the same wherever
that window stands, and consecutive windows with one minimizer travel together as a piece. Equal windows
meet in one shard, where an FM-index over the shard's distinct pieces finds by backward search every
place of every window, and with it the least document that has it.

1. Minimizers of all documents, combined per batch, then per minimizer: which occur in two documents or more. They
   become a bitmap of fixed size; windows whose minimizer is not in it are unique and stay out.
2. Pieces of the remaining windows: contents (once per batch, with least and greatest document) and occurrences.
3. A minimizer with very many contents (a passage in a third of all documents, in ever other surroundings)
   would overfill a shard: its contents are cut into single windows, combined, and routed by their own hash.
4. Per shard: index, backward search of all windows, least document per window.
5. Back to the occurrences, to positions per document, and to the texts of the documents concerned.

Nothing is capped; the bitmap only saves work. Contents are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import window_hashes, word_hashes
from cinelake.llm.components import bit_of, bitmap, holds
from cinelake.llm.fm_index import FMIndex, least_in
from cinelake.session import saved

#: Words of the runs whose least hash names a window.
RUN = 5
#: Bits of the bitmap of repeated minimizers: 16 MB.
REPEATED_BITS = 27
#: Contents of one minimizer beyond which they are cut into single windows.
CUT = 5_000
#: Pieces per shard.
PIECES = 40_000


#: Rows and bytes of the batches that leave a task; words of one text at a time are held.
BATCH_ROWS = 20_000
BATCH_BYTES = 8 << 20


def words_of(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Words of one text after the other: runs of anything but the six ASCII white space characters; none for null."""
    for text in batch.column("text").cast(pa.binary()):
        yield (text.as_py() or b"").split()


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least run hash inside every window."""
    runs = window_hashes(hashes, RUN)
    n = len(hashes) - width + 1
    if n <= 0:
        return runs[:0]
    least = runs[:n].copy()
    for k in range(1, width - RUN + 1):
        np.minimum(least, runs[k : n + k], out=least)
    return least


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64), pa.int64())


def repeated(docs: DataFrame, width: int) -> np.ndarray:
    """Bitmap of the minimizers that occur in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(minimizers(word_hashes(w), width)) for w in words_of(batch)]
            ids = np.repeat(batch.column("id").to_numpy(), [len(o) for o in own])
            values = np.concatenate(own) if own else np.zeros(0, np.uint64)
            order = np.lexsort((ids, values))
            values, ids = values[order], ids[order]
            starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(values)) - 1 if len(values) else starts
            yield pa.RecordBatch.from_arrays(
                [signed(values[starts]), pa.array(ids[starts], pa.int64()), pa.array(ids[ends], pa.int64())],
                names=["m", "lo", "hi"])

    pairs = docs.select("id", "text").mapInArrow(run, "m long, lo long, hi long")
    shared = pairs.groupBy("m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    return bitmap(shared, F.col("m").bitwiseAND((1 << REPEATED_BITS) - 1), REPEATED_BITS)


def pieces(docs: DataFrame, width: int) -> DataFrame:
    """Occurrences (m, c, id, t, start) and contents (m, c, lo, hi, words; start is null) of repeated windows."""
    bits = docs.sparkSession.sparkContext.broadcast(repeated(docs, width))
    low = np.uint64((1 << REPEATED_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ms: list[int] = []
        cs: list[int] = []
        starts_of: list[np.ndarray] = []
        rows_of: list[tuple[int, int]] = []
        contents: dict[tuple[int, int], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            none, n = len(ms), len(contents)
            keys, values = list(contents), list(contents.values())
            counts = [len(s) for s in starts_of]
            of = np.repeat(np.array(rows_of, np.int64).reshape(-1, 2), counts, axis=0)
            at = np.concatenate(starts_of) if starts_of else np.zeros(0, np.int64)
            out = pa.RecordBatch.from_arrays([
                signed(np.array(ms + [k[0] for k in keys], np.uint64)),
                signed(np.array(cs + [k[1] for k in keys], np.uint64)),
                pa.concat_arrays([pa.array(of[:, 0]), pa.nulls(n, pa.int64())]),
                pa.concat_arrays([pa.array(of[:, 1]), pa.nulls(n, pa.int64())]),
                pa.concat_arrays([pa.array(at, pa.int32()), pa.nulls(n, pa.int32())]),
                pa.array([None] * none + [v[0] for v in values], pa.int64()),
                pa.array([None] * none + [v[1] for v in values], pa.int64()),
                pa.array([None] * none + [v[2] for v in values], pa.binary()),
            ], names=["m", "c", "id", "t", "start", "lo", "hi", "words"])
            for held in (contents, ms, cs, starts_of, rows_of):
                held.clear()
            return out

        for batch in batches:
            for i, t, words in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), words_of(batch), strict=True):
                least = minimizers(word_hashes(words), width)
                at = np.flatnonzero(holds(bits.value, least & low))
                if not len(at):
                    continue
                new = np.append(True, (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]))
                starts, ends = at[new], at[np.append(new[1:], True)] + width
                starts_of.append(starts)
                rows_of.append((i, t))
                own = least[starts].tolist()
                ms += own
                for s, e, m in zip(starts.tolist(), ends.tolist(), own, strict=True):
                    text = b" ".join(words[s:e])
                    c = xxhash.xxh3_64_intdigest(text)
                    cs.append(c)
                    known = contents.get((m, c))
                    if known is None:
                        contents[m, c] = [i, i, text]
                        size += len(text)
                    else:
                        known[0], known[1] = min(known[0], i), max(known[1], i)
                if size >= BATCH_BYTES or len(ms) >= 10 * BATCH_ROWS:
                    yield flush()
                    size = 0
        yield flush()

    return docs.select("id", "t", "text").mapInArrow(
        run, "m long, c long, id long, t long, start int, lo long, hi long, words binary")


def single_windows(contents: DataFrame, width: int) -> DataFrame:
    """Every window of the contents as a piece of its own: key (m, c), least and greatest document, place in its content."""

    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2 + [pa.int32()]
    names = ["m", "c", "lo", "hi", "words", "of_m", "of_c", "off"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS // 8):
                part = batch.slice(at, BATCH_ROWS // 8)
                columns: list[list] = [[] for _ in names]
                rows = zip(*(part.column(k).to_pylist() for k in ("m", "c", "lo", "hi", "words")), strict=True)
                for m, c, lo, hi, text in rows:
                    words = text.split()
                    for k in range(len(words) - width + 1):
                        own = b" ".join(words[k : k + width])
                        key = [xxhash.xxh3_64_intdigest(own, seed) - (1 << 63) for seed in (1, 2)]
                        for column, v in zip(columns, (*key, lo, hi, own, m, c, k), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

    return contents.mapInArrow(run, "m long, c long, lo long, hi long, words binary, of_m long, of_c long, off int")


def search_shard(shard: pa.Table, width: int) -> pa.Table:
    """Least document of every window of the shard's pieces; pieces known from one document only are left out."""
    best: dict[tuple[int, int], list] = {}
    rows = zip(*(shard.column(k).to_pylist() for k in ("m", "c", "lo", "hi", "words")), strict=True)
    for m, c, lo, hi, text in rows:
        known = best.setdefault((m, c), [lo, hi, text])
        known[0], known[1] = min(known[0], lo), max(known[1], hi)
    codes: dict[bytes, int] = {}
    lists = [[codes.setdefault(w, len(codes) + 1) for w in v[2].split()] for v in best.values()]
    sizes = np.array([len(x) for x in lists])
    text = np.concatenate([np.array([*x, 0]) for x in lists])  # 0 stands between pieces and at the end
    owner = np.repeat(np.arange(len(lists)), sizes + 1)
    index = FMIndex(text, len(codes) + 1, width)
    offset = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - width + 1
    at = np.repeat(offset, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    places, which = index.distinct(at)  # a window that stands in several pieces is searched once
    lo, hi = index.search(text[places[:, None] + np.arange(width)])
    least = np.array([v[0] for v in best.values()], np.int64)[owner]
    firsts = least_in(least[index.suffixes], lo, hi)[which]
    ends = np.cumsum(counts)
    keys, out = [], []
    for (key, v), e, n in zip(best.items(), ends.tolist(), counts.tolist(), strict=True):
        own = firsts[e - n : e]
        if own.min() < v[1]:
            keys.append(key)
            out.append(own)
    return pa.table({
        "m": pa.array([k[0] for k in keys], pa.int64()), "c": pa.array([k[1] for k in keys], pa.int64()),
        "firsts": pa.array(out, pa.list_(pa.int64())),
    })


def combined(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key with the least and greatest document."""
    return rows.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("words").alias("words"))


def duplicate_windows(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``t`` and ``at``: starts of the windows that also start in a document with a smaller id."""
    found = saved(pieces(docs.filter("id IS NOT NULL"), width), "pieces")
    contents = found.filter("start IS NULL").select("m", "c", "lo", "hi", "words")
    per_minimizer = saved(contents.groupBy("m").agg(F.count_distinct("c").alias("n")), "per-minimizer")
    hot = saved(per_minimizer.filter(F.col("n") > CUT).select("m"), "hot-minimizers")
    columns = ["m", "c", "lo", "hi", "words"]
    windows = saved(single_windows(contents.join(hot, "m", "left_semi"), width), "single-windows")
    # a hot window stands in very many contents: one row before it goes to its shard
    single = saved(combined(windows.select(columns), "m", "c"), "combined-windows")
    whole_ones = per_minimizer.filter(F.col("n") <= CUT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_shards = 1 + (whole_ones + single.count()) // PIECES
    indexed = contents.join(hot, "m", "left_anti").select(columns).union(single)
    sharded = indexed.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(n_shards))).repartition("shard")
    # contents repeated by many batches become one where their shard is, still as rows that can be spilled
    firsts = saved(combined(sharded, "shard", "m", "c").groupBy("shard").applyInArrow(
        lambda shard: search_shard(shard, width), "m long, c long, firsts array<long>"), "firsts")
    # single windows back to the contents they were cut from
    cut = (
        windows.select("m", "c", "of_m", "of_c", "off").join(firsts, ["m", "c"])
        .groupBy("of_m", "of_c", "off").agg(F.min(F.col("firsts")[0]).alias("first"))
        .groupBy("of_m", "of_c").agg(F.collect_list(F.struct("off", "first")).alias("places"))
        .select(F.col("of_m").alias("m"), F.col("of_c").alias("c"), "places")
    )
    whole = firsts.join(hot, "m", "left_anti").select(
        "m", "c", F.transform("firsts", lambda f, k: F.struct(k.alias("off"), f.alias("first"))).alias("places"))
    occurrences = found.filter("start IS NOT NULL").select("m", "c", "id", "t", "start")
    hits = occurrences.join(whole.union(cut), ["m", "c"]).select(
        "id", "t", F.transform(F.filter("places", lambda p: p["first"] < F.col("id")), lambda p: p["off"] + F.col("start")).alias("at"))
    return hits.filter(F.size("at") > 0).groupBy("id", "t").agg(F.flatten(F.collect_list("at")).alias("at"))


def kept(words: list[bytes], at: list[int], width: int) -> list[bytes]:
    """The words under none of the windows."""
    edge = np.zeros(len(words) + 1, np.int32)
    starts = np.unique(np.array(at, np.int64))  # every window once
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and the ``kept`` words joined by one space, per row.

    Words are unchanged. Windows are judged on the input. A null text has no words; texts with fewer words than a window
    keep all. Rows with one id do not remove from each other; a null id neither loses words nor takes any. Empty tables
    give empty ones, and columns other than the two named are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    hits = saved(duplicate_windows(docs, width), "duplicate-windows")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(hits, bit_of(F.col("id"))))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without hits are finished; only the texts of the others go on to the join."""
        for whole in batches:
            for batch in slices(whole):
                wait = holds(bits.value, batch.column("bit").to_numpy()).tolist()
                n, done, text = [], [], []
                for w, words in zip(wait, words_of(batch), strict=True):
                    n.append(len(words))
                    joined = b" ".join(words)
                    done.append(None if w else joined)
                    text.append(joined if w else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(done, pa.binary()),
                     pa.array(text, pa.binary())], names=["id", "t", "n", "done", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                left, removed = [], []
                rows = zip(*(batch.column(k).to_pylist() for k in ("n", "done", "text", "at")), strict=True)
                for n, done, text, at in rows:
                    if text is None or not at:
                        left.append(done if text is None else text)
                        removed.append(0)
                    else:
                        words = kept(text.split(), at, width)
                        left.append(b" ".join(words))
                        removed.append(n - len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("n"), pa.array(removed, pa.int64()),
                     pa.array(left, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    marked = docs.withColumn("bit", bit_of(F.col("id"))).mapInArrow(settle, "id long, t long, n long, done binary, text binary")
    joined = marked.join(hits, ["id", "t"], "left").select("id", "n", "done", "text", "at")
    out = joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
