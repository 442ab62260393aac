"""Helpers shared by the corpus operators: shared-folder tables, text vectors, word shingles."""

from __future__ import annotations

import random
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

MASK64 = (1 << 64) - 1
#: Characters handled at once by the vectorised text code; a longer text is handled alone.
CHUNK_CHARS = 1 << 17


def ship(name: str) -> None:
    """Pickle a module's functions by value, so workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


#: Whether Spark deletes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            path = f"file://{tempfile.mkdtemp(prefix='quillmark-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries run inside leave no shuffle files: what they wrote is a table, which nothing recomputes."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read that. Gone when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmark-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", codec).parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmark_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_quillmark_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(*frames: DataFrame, n: int = 1) -> list:
    """n column names that none of the tables has, the same ones each time."""
    taken = {c.lower() for df in frames for c in df.columns}
    rng, out = random.Random(1), []
    while len(out) < n:
        name = f"q{rng.getrandbits(40):010x}"
        if name not in taken and name not in out:
            out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn(rows: DataFrame, n: int, total: int) -> list:
    """At most n rows, the least by the hash in column _draw, out of a table of `total` rows.

    About 1.3 n rows are collected whatever the table's size: those under a fixed share of the hash's range.
    """
    top = 2.0**63
    limit = int(min(top - 1024, (min(1.0, 1.3 * n / max(1, total)) * 2 - 1) * top))
    return sorted(rows.where(F.col("_draw") <= limit).collect(), key=lambda r: r["_draw"])[:n]


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over edges (src, dst): rows (node, component), component the smallest node.

    Each round hooks every node to the least label among its neighbours, then to its label's label
    (pointer jumping), so the rounds grow with the logarithm of a component's diameter. Aggregates
    are combined before their shuffle and joins have unique keys on one side, so a hot node or
    component is split by adaptive execution. Loops and repeated edges are harmless; no edges give
    no rows.
    """
    both = edges.where("src <> dst").selectExpr("src", "dst").union(edges.where("src <> dst").selectExpr("dst", "src"))
    both = cut(both.distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    while True:
        seen = both.join(labels.selectExpr("node AS dst", "component"), "dst")
        least = seen.groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(least, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("hook")
        )
        jump = labels.selectExpr("node AS hook", "component AS far")
        new = cut(hooked.join(jump, "hook", "left").select("node", "old", F.least("hook", "far").alias("component")))
        moved = new.where("old <> component").limit(1).count()
        drop_cut(labels)
        if not moved:
            drop_cut(both)
            return new.select("node", "component")
        path = new._quillmark_path
        labels = new.select("node", "component")
        labels._quillmark_path = path


def add_columns(docs: DataFrame, keep: list, make, fields: str) -> DataFrame:
    """Columns `keep` of docs and those of the DDL `fields`, which make(texts) gives as lists or arrays.

    Kept columns pass through as Arrow arrays, so ids beyond 2^53 stay exact beside nulls. A null text is given as "".
    """
    new = _parse_datatype_string(fields)
    given = docs.select(*[docs[f"`{c}`"] for c in keep], docs["text"].alias("text") if "text" not in keep else F.lit(None).alias("_unused"))
    at = len(keep) if "text" not in keep else keep.index("text")

    def run(batches):
        for batch in batches:
            made = make(["" if t is None else t for t in batch.column(at).to_pylist()])
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + arrays, names)

    schema = StructType([docs.schema[c] for c in keep] + new.fields)
    names = schema.names
    return given.mapInArrow(run, schema)


# --- vectorised text -------------------------------------------------------------------------


def chunked(texts: list, limit: int = CHUNK_CHARS):
    """Slices (start, stop) of consecutive texts with about `limit` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: list):
    """(code points of the texts joined by newlines and ended by one, start of each text, its length)."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    return cp, starts, sizes


def lookup(cp: np.ndarray, fn, dtype=np.int32) -> np.ndarray:
    """fn(character) for each code point, called once for each that occurs."""
    there = np.flatnonzero(np.bincount(cp))
    to = np.zeros(int(there[-1]) + 1 if len(there) else 1, dtype)
    to[there] = [fn(chr(c)) for c in there]
    return to[cp]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span, by one polynomial prefix sum."""
    base = 0x9E3779B97F4A7C15 | 1
    n = len(values) + 1
    power = np.full(n, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    prefix = np.zeros(n, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list):
    """(hash of each word, number of the first word of each text and one more).

    Words are runs of letters and digits, lower-cased.
    """
    cp, starts, _ = codepoints([t.lower() for t in texts])
    inside = lookup(cp, str.isalnum, np.bool_)
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(begin, starts)
    return span_hashes(cp, begin, end), np.append(first, len(begin))


def shingles(texts: list, width: int = 5) -> list:
    """For each text the sorted distinct hashes of its word n-grams.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    out = []
    for a, b in chunked(texts):
        words, first = word_hashes(texts[a:b])
        if len(words) >= width:
            grams = np.zeros(len(words) - width + 1, np.uint64)
            for k in range(width):
                grams = grams * np.uint64(0x2545F4914F6CDD1D) + words[k : len(words) - width + 1 + k]
            grams = mix(grams)
        for i in range(b - a):
            f, t = first[i], first[i + 1]
            if t - f >= width:
                out.append(np.unique(grams[f : t - width + 1]))
            elif t > f:
                whole = np.zeros(1, np.uint64)
                for w in words[f:t]:
                    whole = whole * np.uint64(0x2545F4914F6CDD1D) + w
                out.append(mix(whole + np.uint64(int(t - f))))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
