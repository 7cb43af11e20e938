"""URL filters by a sorted digest array.

Every rule (a host and a path beginning) becomes a 64-bit xxhash key.  The keys
lie sorted in a file that each executor memory-maps; a URL's possible rules
(each parent domain with each rule length of path) are looked up by vectorised
binary search and confirmed on the stored full strings, so colliding digests
cannot give a wrong verdict.  Of several fitting rules the longest wins, then
the one with the longer host.

A null URL, or one without ``://``, has an empty host and path and fits no rule;
such URLs get the default verdict.  Only the id and url columns are read.
"""

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import functions as F

from cermetry.llm.store import with_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
#: rules that one memory-mapped file may hold; more are a shuffled join
MAX_RULES = 5_000_000


def host_and_path(url):
    """Host and path columns of a URL column, both empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)://(.*)", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Sorted 64-bit keys with their full strings, in one memory-mapped file.

    Layout: number of entries, keys, end of each string, verdict of each entry
    (all 64-bit), then the strings' bytes; equal keys lie side by side.
    """

    @staticmethod
    def write(path, rules):
        """``rules``: (string, verdict) pairs; the strings are distinct."""
        text = [r.encode() for r, _ in rules]
        keys = np.array([xxhash.xxh64_intdigest(t) for t in text], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        verdict = np.array([VERDICTS.index(v) for _, v in rules], dtype=np.int64)
        with open(path, "wb") as f:
            for part in (np.array([len(rules)], dtype=np.int64), keys[order], np.cumsum([len(text[i]) for i in order], dtype=np.int64), verdict[order]):
                f.write(part.tobytes())
            f.write(b"".join(text[i] for i in order))

    def __init__(self, path):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view(np.int64)[0])
        self.keys, self.ends, self.verdicts = (raw[8 + 8 * n * i:8 + 8 * n * (i + 1)].view(t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        self.text = raw[8 + 24 * n:]
        self.sizes = sorted({len(self.string(i)) - self.string(i).index("/") for i in range(n)})

    def string(self, i):
        return self.text[self.ends[i - 1] if i else 0:self.ends[i]].tobytes().decode()

    def find(self, texts):
        """Entry of each text, -1 where there is none."""
        found = np.full(len(texts), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        probe = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)
        at = np.searchsorted(self.keys, probe)
        open_ = np.arange(len(texts))
        while len(open_):
            open_ = open_[(at[open_] < len(self.keys))]
            open_ = open_[self.keys[at[open_]] == probe[open_]]
            same = np.array([self.string(at[i]) == texts[i] for i in open_], dtype=bool)
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return found


_OPEN = {}


def opened(name):
    path = SparkFiles.get(name)
    if path not in _OPEN:
        _OPEN[path] = DigestArray(path)
    return _OPEN[path]


def candidates(host, path, sizes):
    """Strings of the rules that could fit, longest first."""
    labels = host.split(".")
    own = [".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in sizes if n <= len(path)]
    return sorted(own, key=lambda s: (-len(s), s.index("/"))) if path.startswith("/") else []


def judge(urls, rules, id_col="page_id", url_col="url", default="allow"):
    """``id_col``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules``: DataFrame (host, path, verdict); paths begin with ``/`` and a pair
    occurs once.  Up to ``MAX_RULES`` they go through the digest array; more are
    matched by a shuffled join on the same strings, with equal results.
    """
    spark = urls.sparkSession
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rules = rules.select(F.concat("host", "path").alias("rule"), "verdict").dropDuplicates(["rule"])
    if rules.count() > MAX_RULES:
        return joined(rows, rules, default).withColumnRenamed("id", id_col)
    folder = tempfile.mkdtemp(prefix="rules-")  # the driver's copy; executors fetch the file through Spark
    name = f"{os.path.basename(folder)}.bin"
    DigestArray.write(f"{folder}/{name}", [tuple(r) for r in rules.orderBy("rule").collect()])
    spark.sparkContext.addFile(f"{folder}/{name}")
    schema = pa.schema([("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        index = opened(name)
        for b in batches:
            pairs = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            tries = {p: candidates(*p, index.sizes) for p in set(pairs)}
            texts = list({t for own in tries.values() for t in own})
            entry = dict(zip(texts, index.find(texts).tolist()))
            best = {p: next(((t, VERDICTS[index.verdicts[entry[t]]]) for t in own if entry[t] >= 0), (None, default)) for p, own in tries.items()}
            cols = [pa.array([best[p][i] for p in pairs], type=pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["id", "host", "path", *schema.names])

    return rows.mapInArrow(run, with_id(rows, "host string, path string, rule string, verdict string")).withColumnRenamed("id", id_col)


def joined(rows, rules, default):
    """The same verdicts by a shuffled join, for rule sets beyond one file."""
    sizes = F.array_sort(F.collect_set(F.length(F.regexp_extract("rule", "/.*", 0))))  # one small number per path length
    sizes = rules.agg(sizes.alias("sizes")).first()[0]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    tries = rows.distinct().withColumn("label", F.split("host", r"\.")).select("row", "path", F.explode(F.expr(
        "transform(sequence(1, size(label)), i -> concat_ws('.', slice(label, i, size(label))))")).alias("suffix"))
    tries = tries.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where((F.col("n") <= F.length("path")) & F.col("path").startswith("/"))
    hits = tries.select("row", F.expr("concat(suffix, substring(path, 1, n))").alias("rule")).join(rules, "rule")
    rank = F.struct(F.length("rule"), F.instr("rule", "/"), "rule", "verdict")
    best = hits.groupBy("row").agg(F.max(rank).alias("best")).select("row", "best.rule", "best.verdict")
    return rows.join(best, "row", "left").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
