"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of word characters (letters, digits, `_ - + /`) or of other marks; white space parts
them and a line is one chain. Each token is tagged secret begin, inside or outside by its shape, the
words before and after it, features of the whole text, and the tag before it. The field is trained
in numpy by stochastic gradient on the log-likelihood over a bounded sample of rows (`sample`, by
hash): tokens under a pattern are labelled secret, and made secrets of other formats are put in.

Viterbi decoding is exact but skips certain ground: a token whose outside score beats the others
by more than any change of the tags beside it can return is outside on the best path, so paths
are searched only between such tokens.

Null texts are empty: no spans. Null and repeated ids do no harm, other columns are not read, and an empty table
gives an empty result. Offsets count code points, ends exclusive. Repeated rows get equal results. Predicted spans that overlap a pattern's span are left out, the pattern's stays.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, chunked, codepoints, drawn, lookup, ship, span_hashes, table

ship(__name__)

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SHAPES, WORDS, FILES = 8 * 4 * 3 * 2 * 2 * 2 + 64, 1 << 15, 16
#: Tokens of a line that training takes at once; a longer line is trained on in several windows.
WINDOW = 256


def base_spans(text: str) -> list:
    """(start, end, number of the kind) of the fixed patterns, with the secret's own start third from last."""
    out = []
    if "=" in text or ":" in text:
        for m in re.finditer(ASSIGN, text, re.I | re.A):
            if len(m[2]) >= 12:
                out.append((m.start(), m.end(), 0, m.start(2)))
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start()) for m in re.finditer(r"AKIA[A-Z0-9]{14,}", text)]
    out += [(m.start(), m.end(), 2, m.start()) for m in re.finditer(r"[0-9a-f]{16,}", text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def char_code(c: str) -> int:
    """0 space, 1 mark, 2 other word character, 3 digit, 4 hex lower, 5 other lower, 6 upper; 7 newline."""
    if c == "\n":
        return 7
    if c.isspace():
        return 0
    if c in "0123456789":
        return 3
    if c in "abcdef":
        return 4
    if c.isupper():
        return 6
    if c.isalpha():
        return 5
    return 2 if c in "_-+/" or c.isdigit() else 1


def tokens(texts: list) -> dict:
    """Token arrays of the texts: begin, end, text, line break before, and feature numbers."""
    cp, starts, sizes = codepoints(texts)
    code = lookup(cp, char_code, np.int8)
    group = np.where((code == 0) | (code == 7), 0, np.where(code == 1, 1, 2)).astype(np.int8)
    edge = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    begin, end = edge[:-1], edge[1:]
    real = group[begin] > 0
    begin, end = begin[real], end[real]
    if not len(begin):
        return {"begin": begin, "end": end, "text": begin, "starts": starts}
    owner = np.searchsorted(starts, begin, "right") - 1
    count = lambda which: (s := np.concatenate(([0], np.cumsum(which))))[end] - s[begin]
    size = end - begin
    digit, upper, hexes = count(code == 3), count(code == 6), count((code == 3) | (code == 4))
    lower = count((code == 4) | (code == 5))
    change = np.concatenate(([0], np.cumsum(np.diff(np.where(code == 4, 5, code), prepend=0) != 0)))
    turns = change[end] - change[np.minimum(begin + 1, end)]
    bucket = np.searchsorted([4, 8, 12, 16, 20, 32, 64], size, "right")
    share = np.where(digit == 0, 0, np.where(digit * 5 < size, 1, np.where(digit * 5 < 3 * size, 2, 3)))
    shape = ((((bucket * 4 + share) * 3 + np.minimum(upper, 2)) * 2 + (lower > 0)) * 2 + (hexes == size)) * 2 + (turns * 4 >= size)
    folded = cp + np.uint32(32) * (code == 6)
    word = (span_hashes(folded, begin, end) >> np.uint64(40)).astype(np.int64) % WORDS
    mark = group[begin] == 1
    shape = np.where(mark, SHAPES - 64 + word % 64, shape)
    lines = np.cumsum(code == 7)[begin]
    head = np.append(True, lines[1:] != lines[:-1])
    pad = lambda x, k: np.where(np.append(np.ones(k, bool), lines[k:] != lines[:-k])[: len(x)], WORDS, np.append(np.full(k, WORDS), x)[: len(x)])
    after = np.where(np.append(head[1:], True), WORDS, np.append(word[1:], WORDS))
    n = np.maximum(1, sizes)
    digits = np.add.reduceat(code == 3, starts) * 50 // n
    marks = np.add.reduceat(code == 1, starts) * 25 // n
    file = np.minimum(3, digits) * 4 + np.minimum(3, marks)
    return {"begin": begin, "end": end, "text": owner, "starts": starts, "head": head, "f": (shape, pad(word, 1), pad(word, 2), after, file[owner])}


def emissions(model: dict, f: tuple) -> np.ndarray:
    return sum(w[x] for w, x in zip(model["w"], f, strict=True))


def viterbi(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Best tags of chains: e is tokens x tags, first the start of each chain, start and stop its edge scores."""
    size = np.diff(np.append(first, len(e)))
    order = np.argsort(-size, kind="stable")
    first, size, start, stop = first[order], size[order], start[order], stop[order]
    tags = np.zeros(len(e), np.int8)
    back = np.zeros(e.shape, np.int8)
    score = start + e[first]
    last = score.copy()
    for t in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, "left"))
        way = score[:n, :, None] + trans
        at = first[:n] + t
        back[at] = way.argmax(1)
        score = way.max(1) + e[at]
        last[:n] = score
    tag = (last + stop).argmax(1)
    for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        n = int(np.searchsorted(-size, -t, "left"))
        at = first[:n] + t
        tags[at] = tag[:n]
        if t:
            tag[:n] = back[at, tag[:n]]
    return tags


def decode(model: dict, tok: dict) -> np.ndarray:
    """Tag of each token: 0 outside, 1 begin, 2 inside."""
    e, head = emissions(model, tok["f"]), tok["head"]
    trans = model["trans"]
    sure = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) > 2 * (trans.max() - trans.min()) + 1e-6
    tags = np.zeros(len(e), np.int8)
    at = np.flatnonzero(~sure)
    if not len(at):
        return tags
    new = head[at] | np.append(True, sure[at[1:] - 1])
    first = np.flatnonzero(new)
    edge = np.where(head[at[first]][:, None], 0.0, trans[0][None, :])
    lastpos = at[np.append(first[1:], len(at)) - 1]
    tail = np.append(head[1:], True)[lastpos]
    stop = np.where(tail[:, None], 0.0, trans[:, 0][None, :])
    tags[at] = viterbi(e[at], first, trans, edge, stop)
    return tags


def invented(rng) -> tuple:
    """(text before, secret or None, text after): a made secret, or a harmless thing like one."""
    pick = lambda s, n: "".join(rng.choice(list(s), n))
    al, low, up, dig = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    k = int(rng.integers(0, 14))
    n = int(rng.integers(16, 48))
    name = str(rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "credential", "auth", "pwd", "Bearer", "private_key", "access_key"]))
    join = str(rng.choice([" = ", "=", ": ", " ", '": "', " = '"]))
    made = [(name + join, pick(al, n)), (name + join, pick(al + "+/", n)), (name + join, pick("abcdef0123456789", n)), ("", "ghp_" + pick(al, 36)), ("", "sk_live_" + pick(al, 24)), ("", "AKIA" + pick(up + dig, 16)), ("", "xoxb-" + pick(dig, 11) + "-" + pick(al, 24))]
    if k < len(made):
        return (*made[k], str(rng.choice(["", '"', "'", ";"])))
    harmless = [pick(dig, 12), "https://" + pick(low, 8) + ".example/" + pick(low, 12) + "-" + pick(low, 9), pick(low, 9) + "." + pick(dig, 2) + "@" + pick(low, 7) + ".com", pick(low, int(rng.integers(16, 40))), "v" + pick(dig, 1) + "." + pick(dig, 2), pick(up, int(rng.integers(6, 20))), "(" + pick(dig, 3) + ") " + pick(dig, 3) + "-" + pick(dig, 4)]
    return (harmless[k - len(made)], None, "")


def examples(texts: list, seed: int = 11) -> tuple:
    """Lines of the texts, some with made secrets put in, and the secret spans of each."""
    rng = np.random.default_rng(seed)
    lines, spans = [], []
    for line in (x for t in texts for x in t.split("\n") if x.strip()):
        if rng.random() < 0.4:
            words = line.split(" ")
            at = int(rng.integers(0, len(words) + 1))
            before, secret, after = invented(rng)
            head = " ".join(words[:at]) + " " + before
            line = head + (secret or "") + after + " " + " ".join(words[at:])
            extra = [(len(head), len(head) + len(secret))] if secret else []
        else:
            extra = []
        spans.append(extra + [(own, end) for _, end, _, own in base_spans(line)])
        lines.append(line)
    return lines, spans


def train(texts: list, epochs: int = 5, batch: int = 64, seed: int = 11, max_lines: int = 6000) -> dict:
    """Fit the field to lines of the sampled texts."""
    sizes = (SHAPES, WORDS + 1, WORDS + 1, WORDS + 1, FILES)
    model = {"w": [np.zeros((n, 3)) for n in sizes], "trans": np.zeros((3, 3))}
    rng = np.random.default_rng(seed)
    lines, spans = examples(texts, seed)
    pick = rng.permutation(len(lines))[:max_lines]
    lines, spans = [lines[i] for i in pick], [spans[i] for i in pick]
    tok = tokens(lines)
    if not len(tok["begin"]):
        model["w"][0][:, 0] = 1e3
        return model
    tags = np.zeros(len(tok["begin"]), np.int64)
    where = np.searchsorted(tok["text"], np.arange(len(lines) + 1))
    for i, own in enumerate(spans):
        a, b = where[i], where[i + 1]
        for s, e in own:
            hit = (tok["begin"][a:b] - tok["starts"][i] < e) & (tok["end"][a:b] - tok["starts"][i] > s)
            k = np.flatnonzero(hit) + a
            if len(k):
                tags[k] = 2
                tags[k[0]] = 1
    cuts = [np.arange(a, b, WINDOW) for a, b in zip(where[:-1], where[1:], strict=True)]
    windows = [np.arange(a, min(a + WINDOW, b)) for own, b in zip(cuts, where[1:], strict=True) for a in own]
    f = tok["f"]
    square = [np.full_like(w, 1e-2) for w in model["w"]] + [np.full((3, 3), 1e-2)]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            at = [windows[i] for i in part]
            at.sort(key=len, reverse=True)
            size = np.array([len(x) for x in at])
            grid = np.zeros((len(at), size[0]), np.int64)
            for r, x in enumerate(at):
                grid[r, : len(x)] = x
            mask = np.arange(size[0])[None, :] < size[:, None]
            e = emissions(model, tuple(x[grid] for x in f))
            trans = model["trans"]
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for t in range(1, size[0]):
                new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(size[0] - 2, -1, -1):
                new = np.logaddexp.reduce(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            total = np.logaddexp.reduce(alpha[:, -1], axis=1)
            p = np.exp(alpha + beta - total[:, None, None])
            gold = np.eye(3)[tags[grid]]
            diff = (gold - p)[mask]
            pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
            want = gold[:, :-1, :, None] * gold[:, 1:, None, :]
            g_trans = ((want - pair) * mask[:, 1:, None, None]).sum((0, 1))
            flat = grid[mask]
            for w, s, x in zip([*model["w"]], square[:-1], f, strict=True):
                g = np.stack([np.bincount(x[flat], weights=diff[:, k], minlength=len(w)) for k in range(3)], 1) / len(at) - 1e-5 * w
                s += g * g
                w += 0.3 * g / np.sqrt(s)
            g = g_trans / len(at)
            square[-1] += g * g
            model["trans"] = np.clip(trans + 0.3 * g / np.sqrt(square[-1]), -4, 4)
    return model


def scan(model: dict, texts: list) -> list:
    """For each text the sorted spans (start, end, number of the kind)."""
    out = []
    for a, b in chunked(texts):
        tok = tokens(texts[a:b])
        added: dict = {}
        if len(tok["begin"]):
            tags = decode(model, tok)
            hit = np.flatnonzero(tags)
            for i in hit:
                t = int(tok["text"][i])
                s, e = int(tok["begin"][i] - tok["starts"][t]), int(tok["end"][i] - tok["starts"][t])
                own = added.setdefault(t, [])
                if tags[i] == 2 and own and own[-1][2] == i - 1 and not tok["head"][i]:
                    own[-1] = (own[-1][0], e, i)
                else:
                    own.append((s, e, i))
        for k in range(b - a):
            base = [x[:3] for x in base_spans(texts[a + k])]
            new = [(s, e, 3) for s, e, _ in added.get(k, ()) if not any(s < y and x < e for x, y, _ in base)]
            out.append(sorted(base + new, key=lambda x: (x[0], x[2])))
    return out


def fit(docs: DataFrame, sample: int = 400) -> dict:
    """Train on at most `sample` different texts, the first by hash of the text."""
    texts = docs.where("text is not null").select("text", F.xxhash64("text", F.lit(9)).alias("_draw"))
    # equal texts fall under the share together, so one of each is collected and different ones are counted
    total = texts.select("_draw").distinct().count()
    return train([r["text"] for r in drawn(texts.groupBy("_draw").agg(F.first("text").alias("text")), sample, total)])


def named(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id with counts by kind, the digest of the pattern spans, and all spans."""

    def run(texts):
        found = scan(model, texts)
        base = [[x for x in s if x[2] < 3] for s in found]
        counts = [np.array([sum(x[2] == k for x in s) for s in found], np.int64) for k in range(3)]
        digests = [hashlib.sha256(named(s).encode()).hexdigest() for s in base]
        added = np.array([len(s) - len(t) for s, t in zip(found, base, strict=True)], np.int64)
        return *counts, digests, [named(s) for s in found], added

    return add_columns(docs, ["doc_id"], run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))
