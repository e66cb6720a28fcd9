"""URL filter on a sorted digest array: 64-bit keys, vectorised binary search, confirmation on stored strings.

The rules are written once as one file: sorted xxhash64 keys of ``host + path``, then string offsets, then
the strings, then actions. Spark ships the file to every executor, each worker maps it into memory (the pages are
shared by all workers of a machine) and answers a batch of URLs with one ``searchsorted`` over all their candidate
keys. A key that is found counts only if the stored string equals the candidate, so two strings with one digest
cannot be mixed up.

The list is a parameter of the job; ``MAX_RULES`` bounds the file. A longer list goes through an equi-join of
the same candidates with the rules (``judge_by_join``), with the same rows as result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import lower_ascii, rows_of

#: Rules in one digest file; about 80 bytes each.
MAX_RULES = 2_000_000
ACTIONS = ("allow", "block")
SEP = "\n"  # between host and path in a key; neither a rule's host nor a candidate's holds one


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_key(host: str, path: str) -> bytes:
    return f"{host}{SEP}{path}".encode()


def write_digest_array(rules: Iterable[tuple[str, str, str]], path: str) -> dict:
    """Write the digest file; returns what a reader needs besides it. Of repeated rules the last one holds."""
    import xxhash

    actions = {}
    for host, prefix, action in rules:
        if SEP in host:
            raise ValueError("a host holds no line feed")
        actions[rule_key(host.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})), prefix)] = action
    if len(actions) > MAX_RULES:
        raise ValueError(f"{len(actions)} rules; over {MAX_RULES} use judge_by_join")
    entries = sorted((xxhash.xxh64_intdigest(k), k, ACTIONS.index(a)) for k, a in actions.items())
    keys = np.array([e[0] for e in entries], np.uint64)
    ends = np.concatenate([[0], np.cumsum([len(e[1]) for e in entries], dtype=np.int64)]).astype(np.int64)
    with open(path, "wb") as f:
        f.write(keys.tobytes() + ends.tobytes() + bytes(e[2] for e in entries) + b"".join(e[1] for e in entries))
    parts = [k.decode().partition(SEP) for k in actions]
    return {"n": len(entries), "lengths": sorted({len(p[2]) for p in parts}), "longest": max((len(p[0]) for p in parts), default=0)}


class DigestArray:
    """A digest file mapped into memory."""

    def __init__(self, path: str, n: int) -> None:
        self.n = n
        self.data = np.memmap(path, np.uint8, "r") if n else np.zeros(8, np.uint8)
        self.keys = self.data[: 8 * n].view(np.uint64)
        self.ends = self.data[8 * n : 16 * n + 8].view(np.int64)
        self.actions = self.data[16 * n + 8 : 17 * n + 8]
        self.strings = self.data[17 * n + 8 :]

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Entry number of every candidate, -1 where there is none."""
        import xxhash

        out = np.full(len(candidates), -1, np.int64)
        if not self.n or not candidates:
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(at, self.n - 1)] == digests)
        for i in hit.tolist():  # entries with one digest lie side by side
            j = int(at[i])
            while j < self.n and self.keys[j] == digests[i]:
                if self.string(j) == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def string(self, j: int) -> bytes:
        return self.strings[int(self.ends[j]) : int(self.ends[j + 1])].tobytes()


def suffixes(host: str, longest: int) -> list[str]:
    """The host and every parent domain of at most ``longest`` characters, longest first."""
    tail = host[-longest - 1 :] if longest < len(host) else "." + host
    return [tail[i + 1 :] for i, c in enumerate(tail) if c == "."]


def candidates(host: str, path: str, lengths: list[int], longest: int) -> list[bytes]:
    """Keys of all rules that could fit, for the path lengths and the longest host that occur among the rules; no rule's host
    holds ``SEP``."""
    return [rule_key(h, path[:n]) for h in suffixes(host, longest) if SEP not in h for n in lengths if n <= len(path)]


_open: dict[str, DigestArray] = {}


def judge(urls: DataFrame, rules: Iterable[tuple[str, str, str]], *, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` and ``verdict`` of every URL.

    A rule (host, path, action) fits its host and all subdomains where the URL's path starts with the rule's.
    The longest ``host + path`` wins, the longer host at equal length; without a rule the verdict is ``allow``.
    A null URL, or one without ``://``, has empty host and path and fits no rule but one for the empty host.
    Null ids and repeated rows are kept as they are, an empty table gives an empty one; other columns are left out.
    """
    folder = tempfile.mkdtemp(prefix="spark-rules-")  # the driver's own copy; Spark hands it to the executors
    name = f"rules-{uuid.uuid4().hex}.bin"
    about = write_digest_array(rules, os.path.join(folder, name))
    urls.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from here

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        if path not in _open:
            _open.clear()
            _open[path] = DigestArray(path, about["n"])
        index = _open[path]
        for batch in batches:
            keys: list[bytes] = []
            owner: list[int] = []
            for i, (host, rest) in enumerate(rows_of(batch, "host", "path")):
                own = candidates(host, rest, about["lengths"], about["longest"])
                keys += own
                owner += [i] * len(own)
            found = index.find(keys)
            best: list[tuple[int, int, int] | None] = [None] * batch.num_rows
            for j in np.flatnonzero(found >= 0).tolist():
                host, _, rest = keys[j].decode().partition(SEP)
                rank = (len(host) + len(rest), len(host), int(found[j]))
                i = owner[j]
                if best[i] is None or rank > best[i]:
                    best[i] = rank
            rule = [None if b is None else index.string(b[2]).decode().replace(SEP, "", 1) for b in best]
            verdict = ["allow" if b is None else ACTIONS[int(index.actions[b[2]])] for b in best]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["id", "host", "path", "rule", "verdict"])

    parts = urls.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
    kind = parts.schema["id"].dataType.simpleString()
    out = parts.mapInArrow(probe, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def judge_by_join(urls: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``judge`` for a rule table (host, path, action) of any length: one equi-join of candidates and rules.

    Candidates are made once per distinct (host, path). Of repeated rules the greatest action holds.
    """
    lengths = rules.select(F.length("path").alias("len")).distinct()
    longest = rules.agg(F.max(F.length("host"))).first()[0] or 0  # longer parent domains fit no rule
    parts = urls.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
    tail = F.expr(f"right(host, {longest + 1})")
    near = F.when(F.length("host") <= longest, F.col("host")).when(F.contains(tail, F.lit(".")), F.regexp_replace(tail, r"(?s)\A[^.]*\.", ""))
    labels = F.split(near, r"\.")
    n = F.size(labels)
    keyed = parts.select("host", "path").distinct().withColumn("rh", F.explode(F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))))
    # path lengths among the rules are few: one row each, at most the longest path
    sizes = lengths.agg(F.array_sort(F.collect_set("len")).alias("sizes"))
    keyed = keyed.join(F.broadcast(sizes)).withColumn("len", F.explode("sizes"))
    keyed = keyed.filter(F.col("len") <= F.length("path")).withColumn("rp", F.expr("substring(path, 1, len)"))
    r = rules.groupBy(lower_ascii(F.col("host")).alias("rh"), F.col("path").alias("rp")).agg(F.max("action").alias("action"))
    best = keyed.join(r, ["rh", "rp"]).groupBy("host", "path").agg(F.max(F.struct(
        (F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("h"),
        F.concat("rh", "rp").alias("rule"), "action")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"))
