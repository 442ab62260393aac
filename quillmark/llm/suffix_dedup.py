"""Removal of long repeats by longest-previous-factor arrays, over all documents.

A byte goes if a string of `length` bytes that covers it also starts in a document of smaller doc_id. In
suffix order the earlier document with which a position shares most bytes is the nearest one before or
after it with a smaller doc_id: those are the previous and next smaller positions, the least common prefix on
the way is the length of the match, and the greater of the two is the longest previous factor. Where
it reaches `length`, the copy goes and the first document keeps its own. Factors are computed up to `length`, for how far
a match goes on beyond it doesn't matter. The suffixes of a whole corpus can't be sorted in one place, so its positions are
dealt out by content:

1. Documents are dealt into chunks by hash. A position's key is the least hash of the GRAM-byte
   strings in its window of `length` bytes, so equal windows have equal keys wherever they are, and
   about sixteen positions in a row share one. A run of positions with one key is a context.
2. Each chunk sends its distinct keys to buckets; a bucket answers which occur in other chunks.
   Only contexts whose key occurs in two documents go on.
3. Each chunk sends those contexts, equal ones once with their least and greatest doc_id. A bucket
   joins equal contexts of its chunks, builds the suffix order, longest common prefixes, smaller positions and
   factors of the rest, and answers with the first document of each repeated window.
4. Each chunk marks the bytes of later copies and cuts them out.

All messages are packed arrays, a row for a chunk and bucket. Equal keys of a chunk are sent once, so a
passage in a third of all documents is as many entries as there are chunks. The three passes over
the documents read one exchange.

Texts are UTF-8 bytes, null is empty; other columns are not read. A null doc_id is neither smaller nor larger than any: such
documents lose nothing and take nothing away. Documents with equal ids take nothing from each other.
Offsets are bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ship, table

ship(__name__)

GRAM = 20
CHUNK_BYTES = 8 << 20
INF = np.iinfo(np.int64).max


def run_keys(data: np.ndarray, length: int) -> tuple:
    """(first position, position after the last, key) of each run of windows that share a key."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    base = 0x9E3779B97F4A7C15 | 1
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(7)) * power[:-1], out=prefix[1:])
    h = mix((prefix[GRAM:] - prefix[:-GRAM]) * back[: n + 1 - GRAM])
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if width > have:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return new, np.append(new[1:], len(h)), h[new]


def runs(texts: list, length: int) -> tuple:
    """(number of the text, first, after, key) of all runs of the texts."""
    parts = []
    for i, data in enumerate(texts):
        a, b, k = run_keys(np.frombuffer(data, np.uint8), length)
        parts.append((np.full(len(a), i, np.int64), a, b, k))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def load(pdf: pd.DataFrame) -> tuple:
    """(ids, whether they are known, texts as bytes) of a chunk, in a fixed order."""
    pdf = pdf.sort_values(["known", "doc_id", "text"], na_position="first", kind="stable")
    texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
    return pdf["doc_id"].to_numpy(np.int64), pdf["known"].to_numpy(bool), texts


def distinct_keys(ids, known, texts, length: int) -> tuple:
    """Sorted distinct keys of a chunk, whether each is in two documents, and the runs."""
    who, a, b, key = runs([t if ok else b"" for t, ok in zip(texts, known, strict=True)], length)
    uniq, at = np.unique(key, return_inverse=True)
    low, high = np.full(len(uniq), INF), np.full(len(uniq), -INF)
    np.minimum.at(low, at, ids[who])
    np.maximum.at(high, at, ids[who])
    return uniq, low < high, (who, a, b, at)


def by_bucket(keys: np.ndarray, buckets: int) -> list:
    """(bucket, places of its keys in their order) of the buckets that keys are dealt to."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, first[1:]), strict=True)) if len(keys) else []


def contexts(ids, known, texts, length: int, buckets: int, answers: dict) -> tuple:
    """Distinct contexts of a chunk whose key is in two documents: by bucket, in a fixed order.

    Returns (who, first, after, context number) of their runs, and for each context (bucket, bytes, least
    and greatest id), contexts sorted by bucket.
    """
    uniq, multi, (who, a, b, at) = distinct_keys(ids, known, texts, length)
    bucket = (uniq % np.uint64(buckets)).astype(np.int64)
    often = multi.copy()
    for k, own in by_bucket(uniq, buckets):
        if k in answers:
            often[own] |= np.unpackbits(np.frombuffer(answers[k], np.uint8))[: len(own)].astype(bool)
    use = often[at]
    who, a, b, at = who[use], a[use], b[use], at[use]
    seen: dict = {}
    number = np.empty(len(who), np.int64)
    found, low, high = [], [], []
    for r in range(len(who)):
        w = who[r]
        piece = texts[w][a[r] : b[r] + length - 1]
        i = seen.get(piece)
        if i is None:
            i = seen[piece] = len(found)
            found.append((int(bucket[at[r]]), piece))
            low.append(ids[w])
            high.append(ids[w])
        else:
            low[i], high[i] = min(low[i], ids[w]), max(high[i], ids[w])
        number[r] = i
    where = np.array([x[0] for x in found], np.int64)
    order = np.argsort(where, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return (who, a, b, rank[number] if len(number) else number), [found[i] for i in order], np.array(low, np.int64)[order], np.array(high, np.int64)[order]


def suffix_order(data: np.ndarray, start: np.ndarray, length: int) -> tuple:
    """(order, lcp): the positions by the `length` bytes there, and the bytes that each shares with the one before it."""
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    words = []
    for w in range(0, length, 8):
        word = np.zeros(len(start), np.uint64)
        for k in range(8):
            word <<= np.uint64(8)
            if w + k < length:
                word |= padded[start + (w + k)]
        words.append(word)
    order = np.lexsort(words[::-1])
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for w, word in enumerate(words):
        at = np.flatnonzero(same)
        differ = word[order[at + 1]] ^ word[order[at]]
        # position of the highest bit that differs, from 1; without the bit below it no rounding can raise it
        top = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
        lcp[at + 1] = np.minimum(length, w * 8 + np.where(differ == 0, 8, (64 - top) // 8))
        same[at] = differ == 0
    return order, lcp


def smaller(ids: np.ndarray, lcp: np.ndarray, length: int) -> tuple:
    """For each position in suffix order the one before it with a smaller id, and the bytes shared with it.

    All positions jump at once: what lies between a position and its candidate is never smaller, so a
    candidate that isn't smaller hands on its own. Once less than `length` bytes are shared, the search ends.
    """
    at, shared = np.arange(len(ids)) - 1, lcp.copy()
    if len(ids):
        at[0], shared[0] = 0, 0
    todo = np.flatnonzero((shared >= length) & (ids[at] >= ids))
    while len(todo):
        to = at[todo]
        new_shared, new_at = np.minimum(shared[todo], shared[to]), at[to]
        shared[todo], at[todo] = new_shared, new_at
        todo = todo[(new_shared >= length) & (ids[new_at] >= ids[todo])]
    return at, shared


def factors(data: np.ndarray, start: np.ndarray, ids: np.ndarray, length: int) -> tuple:
    """(lpf, first): each position's longest previous factor, up to `length`, and the first document that it leads to."""
    order, lcp = suffix_order(data, start, length)
    own = ids[order]
    before, shared = smaller(own, lcp, length)
    flipped, ahead = smaller(own[::-1], np.append(0, lcp[:0:-1]) if len(lcp) else lcp, length)
    after, ahead = len(own) - 1 - flipped[::-1], ahead[::-1]
    by = np.where(shared >= ahead, before, after)
    longest = np.maximum(shared, ahead)
    to = np.where(longest >= length, by, np.arange(len(own)))
    while True:  # follow the matches to the first document
        far = to[to]
        if (far == to).all():
            break
        to = far
    lpf, first = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    lpf[order], first[order] = longest, own[to]
    return lpf, first


def dedup(docs: DataFrame, length: int = 50, keep_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), with the kept bytes if keep_text."""
    import zstandard

    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(1 << 20, max(12, total // CHUNK_BYTES + 1)))
    # ids travel without nulls, beside a mark, for pandas would round them; repeated rows and null ids are dealt by text
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("chunk")
    dealt = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text", chunk)

    def pack(*arrays) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(b"".join(np.int64(x.nbytes).tobytes() + x.tobytes() for x in arrays))

    def unpack(blob, *kinds) -> list:
        raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
        for kind in kinds:
            size = int(np.frombuffer(raw, np.int64, 1, at)[0])
            out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
            at += 8 + size
        return out

    def ask(pdf):
        uniq, _, _ = distinct_keys(*load(pdf), length)
        parts = by_bucket(uniq, buckets)
        return pd.DataFrame({"chunk": pdf["chunk"].iat[0], "bucket": [k for k, _ in parts], "blob": [uniq[at].tobytes() for _, at in parts]})

    def answer(pdf):
        keys = [np.frombuffer(x, np.uint64) for x in pdf["blob"]]
        every = np.sort(np.concatenate(keys))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for k in keys:
            at = np.minimum(np.searchsorted(twice, k), max(0, len(twice) - 1))
            out.append(np.packbits(twice[at] == k if len(twice) else np.zeros(len(k), bool)).tobytes())
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "blob": out})

    def replies(pdf) -> dict:
        return dict(zip(pdf["bucket"], pdf["blob"], strict=True))

    def send(left, right):
        if not len(left):
            return pd.DataFrame({"chunk": [], "bucket": [], "blob": []})
        _, found, low, high = contexts(*load(left), length, buckets, replies(right))
        where = np.array([x[0] for x in found], np.int64)
        rows = []
        for k in np.unique(where):
            a, b = np.searchsorted(where, [k, k + 1])
            size = np.array([len(x[1]) for x in found[a:b]], np.uint32)
            rows.append((k, pack(size, low[a:b], high[a:b], np.frombuffer(b"".join(x[1] for x in found[a:b]), np.uint8))))
        return pd.DataFrame({"chunk": left["chunk"].iat[0], "bucket": [x[0] for x in rows], "blob": [x[1] for x in rows]})

    def match(pdf):
        got = [unpack(x, np.uint32, np.int64, np.int64, np.uint8) for x in pdf["blob"]]
        size = np.concatenate([g[0] for g in got]).astype(np.int64)
        low, high = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        data = np.concatenate([g[3] for g in got])
        begin = np.cumsum(size) - size
        # equal contexts of several chunks are one, with the least of their documents
        raw, seen = data.tobytes(), {}
        number = np.array([seen.setdefault(raw[i : i + n], len(seen)) for i, n in zip(begin.tolist(), size.tolist(), strict=True)], np.int64)
        _, head = np.unique(number, return_index=True)
        ids = np.full(len(head), INF)
        np.minimum.at(ids, number, low)
        windows = size[head] - length + 1
        of = np.repeat(np.arange(len(head)), windows)
        within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        lpf, first = factors(data, begin[head][of] + within, ids[of], length)
        # back to every context: its own document is the first one unless a factor reaches `length`
        first = np.where(lpf >= length, first, ids[of])
        at = np.cumsum(windows) - windows
        windows = size - length + 1
        of = np.repeat(np.arange(len(size)), windows)
        within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        least = first[at[number[of]] + within]
        # as runs of windows of one context with one earliest document, where that is earlier than a holder
        hit = least < high[of]
        of, within, least = of[hit], within[hit], least[hit]
        new = np.append(True, (of[1:] != of[:-1]) | (within[1:] != within[:-1] + 1) | (least[1:] != least[:-1])) if len(of) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(of)))
        of, within, least = of[head], within[head], least[head]
        first = np.cumsum([len(g[0]) for g in got]) - [len(g[0]) for g in got]
        rows = []
        for i in range(len(got)):
            a, b = np.searchsorted(of, [first[i], first[i] + len(got[i][0])])
            rows.append(pack((of[a:b] - first[i]).astype(np.uint32), within[a:b].astype(np.uint32), count[a:b].astype(np.uint32), least[a:b]))
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "blob": rows, "kind": 1})

    def remove(left, right):
        if not len(left):
            return pd.DataFrame({c: [] for c in names})
        ids, known, texts = load(left)
        (who, a, _, number), found, _, _ = contexts(ids, known, texts, length, buckets, replies(right[right["kind"] == 0]))
        where = np.array([x[0] for x in found], np.int64)
        marks: list = [None] * len(texts)
        spans: dict = {}
        for k, blob in replies(right[right["kind"] == 1]).items():
            base = int(np.searchsorted(where, k))
            for c, s, n, d in zip(*[x.tolist() for x in unpack(blob, np.uint32, np.uint32, np.uint32, np.int64)], strict=True):
                spans.setdefault(base + c, []).append((s, n, d))
        for r in range(len(who)):
            for s, n, d in spans.get(int(number[r]), ()):
                w = int(who[r])
                if d < ids[w]:
                    if marks[w] is None:
                        marks[w] = np.zeros(len(texts[w]) + 1, np.int32)
                    marks[w][a[r] + s] += 1
                    marks[w][a[r] + s + n + length - 1] -= 1
        out = []
        for i, t in enumerate(texts):
            cut_ = np.cumsum(marks[i][:-1]) > 0 if marks[i] is not None else np.zeros(len(t), bool)
            rest = np.frombuffer(t, np.uint8)[~cut_].tobytes()
            gone = int(cut_.sum())
            parts = int((np.diff(cut_.astype(np.int8), prepend=0) == 1).sum())
            row = (ids[i], known[i], len(t), gone, parts, hashlib.sha256(rest).hexdigest())
            out.append(row + (rest,) if keep_text else row)
        return pd.DataFrame(out, columns=names)

    names = ["doc_id", "known", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    message = "chunk int, bucket int, blob binary"
    keyed = dealt.groupBy("chunk")
    known = keyed.applyInPandas(ask, message).groupBy("bucket").applyInPandas(answer, message)
    sent = keyed.cogroup(known.groupBy("chunk")).applyInPandas(send, message)
    found = sent.groupBy("bucket").applyInPandas(match, f"{message}, kind int")
    both = known.withColumn("kind", F.lit(0)).unionByName(found)
    schema = "doc_id long, known boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    out = keyed.cogroup(both.groupBy("chunk")).applyInPandas(remove, schema)
    return out.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id")).cast(docs.schema["doc_id"].dataType)).drop("known")


def op10(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
