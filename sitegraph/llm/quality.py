"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad; its features describe the line and its neighbours.
Forward-backward marginals, weighted by line length, are averaged into the
document's quality and calibrated on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import only, text_of

# byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 sentence sign, 5 other sign, 6 beyond ASCII
CLASS = np.full(256, 5, dtype=np.uint8)
CLASS[ord("a"):ord("z") + 1], CLASS[ord("A"):ord("Z") + 1], CLASS[ord("0"):ord("9") + 1] = 0, 1, 2
CLASS[[9, 10, 11, 12, 13, 32]] = 3
CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
CLASS[128:] = 6
SIGN = np.isin(np.arange(256), list(b"|!#$%&*<>{}[]=@/\\_~^+`")).astype(float)
PART = 1 << 20  # characters of text described at a time
OWN = 19  # features of a line itself; the chain sees them for the line before and the line after, too
WIDTH = 3 * OWN + 2


def parts(chars: list[int]) -> Iterator[slice]:
    """Slices of consecutive texts of ``PART`` characters together, the last one excepted; ``chars`` holds their lengths."""
    start, held = 0, 0
    for k, c in enumerate(chars):
        held += c
        if held >= PART or k + 1 == len(chars):
            yield slice(start, k + 1)
            start, held = k + 1, 0


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features, sizes, counts)``: a row and a byte length per line of all texts, and the texts' numbers of lines.

    Whole lines are described, however long; neighbours are those of the same text.
    """
    own, sizes, counts = own_features(texts)
    return chained(own, counts), sizes, counts


def chained(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The features of every line: its own, those of the line before and the line after, whether it repeats the former, and 1."""
    out = np.empty((len(own), WIDTH))
    out[:, :OWN] = own[:, :OWN]
    out[1:, OWN:2 * OWN], out[:-1, 2 * OWN:3 * OWN] = own[:-1, :OWN], own[1:, :OWN]
    ends = np.cumsum(counts)
    out[ends - counts, OWN:2 * OWN] = 0  # the first line of a text
    out[ends - 1, 2 * OWN:3 * OWN] = 0  # the last
    out[:, -2], out[:, -1] = own[:, OWN], 1
    return out


def own_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(own, sizes, counts)`` as ``line_features``, without the neighbours; the last column: equal to the line before."""
    per_text = [t.encode().split(b"\n") for t in texts]
    counts = np.array([len(x) for x in per_text], dtype=np.int64)
    lines = [x for part in per_text for x in part]
    n = len(lines)
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    ends = np.cumsum(sizes + 1)  # a line end after every line, the last one too
    starts = ends - sizes - 1
    arr = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8) if n else np.zeros(0, dtype=np.uint8)
    kinds = CLASS[arr]
    line_of = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
    own = np.zeros((n, OWN + 1))
    per = 1 / np.maximum(sizes, 1)
    table = np.bincount(line_of.astype(np.int64) * 8 + kinds, minlength=8 * n).reshape(n, 8)
    table[:, 3] -= 1  # the line end itself
    own[:, :7] = table[:, :7] * per[:, None]
    # words as byte runs between blanks, for all lines at once
    blank = kinds == 3
    first = np.nonzero(~blank & np.concatenate([[True], blank[:-1]]))[0] if n else np.zeros(0, dtype=np.int64)
    stop = np.nonzero(blank & np.concatenate([[False], ~blank[:-1]]))[0] if n else first
    home = line_of[first]
    length = stop - first
    lower = np.concatenate([[0], np.cumsum(kinds == 0, dtype=np.int32)])
    upper = np.concatenate([[0], np.cumsum(kinds == 1, dtype=np.int32)])
    shouted = (lower[stop] == lower[first]) & (upper[stop] - upper[first] > 1)
    words = np.bincount(home, minlength=n)
    signed = np.bincount(home, weights=SIGN[arr[stop - 1]], minlength=n)
    shout = np.bincount(home, weights=shouted, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, home, length)
    distinct, again = np.zeros(n), np.zeros(n)
    for i, line in enumerate(lines):
        w = line.split()
        distinct[i] = len(set(w))
        again[i] = sum(map(eq, w, w[1:]))
    some = np.maximum(words, 1)
    last = arr[np.maximum(ends - 2, 0)] if n else arr
    own[:, 7] = words == 0
    own[:, 8] = np.log1p(words) / 5
    own[:, 9] = np.minimum(sizes / some, 40) / 10
    own[:, 10] = distinct / some
    own[:, 11] = again / np.maximum(words - 1, 1)
    own[:, 12] = signed / some
    own[:, 13] = shout / some
    own[:, 14] = (sizes > 0) & np.isin(last, [ord(c) for c in ".!?"])
    own[:, 15] = np.minimum(longest, 60) / 20
    own[:, 16] = distinct * 2 < words
    own[:, 17] = signed * 4 > words
    own[:, 18] = words < 4
    own[1:, OWN] = [a == b for a, b in zip(lines, lines[1:], strict=False)]
    own[np.cumsum(counts) - counts, OWN] = 0  # the first line of a text
    return own, sizes, counts


@dataclass
class Crf:
    """Weights of the state "good" against "bad", the four transitions, and the calibration of the document score."""

    weights: np.ndarray
    trans: np.ndarray  # [from, to]; state 1 is good
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, odds: list[float]) -> list[float]:
        """Probability of "good" for each line of a text, by forward-backward in ratios of good to bad."""
        (a, b), (c, d) = np.exp(self.trans).tolist()
        fwd, r = [], None
        for x in odds:  # r: good over bad, given the lines so far
            r = x if r is None else x * (b + r * d) / (a + r * c)
            fwd.append(r)
        out, s = [0.0] * len(odds), 1.0
        for i in range(len(odds) - 1, -1, -1):  # s: good over bad, given the lines that follow
            q = fwd[i] * s
            out[i] = q / (1 + q)
            t = odds[i] * s
            s = (c + t * d) / (a + t * b)
        return out

    def raw(self, texts: list[str]) -> np.ndarray:
        """Per text the mean of its lines' marginals, weighted by line length plus one."""
        out = [self.averages(*line_features(texts[s])) for s in parts([len(t) for t in texts])]
        return np.concatenate(out) if out else np.zeros(0)

    def averages(self, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``raw`` of texts that ``line_features`` has described."""
        odds = np.exp(np.clip(features @ self.weights, -30, 30)).tolist()
        good, at = [], 0
        for n in counts.tolist():
            good += self.marginals(odds[at:at + n])
            at += n
        w, top = sizes + 1.0, np.cumsum(counts) - counts
        return np.add.reduceat(np.array(good) * w, top) / np.add.reduceat(w, top)

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.slope * _logit(self.raw(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(own: np.ndarray, sizes: np.ndarray, counts: np.ndarray, chars: list[int], labels: list[int], rounds: int = 60,
        rate: float = 0.1, decay: float = 2e-3) -> Crf:
    """Maximum likelihood with every line of a document labelled as the document, by Adam on whole passes.

    The documents come as ``own_features`` describes them, with their numbers of characters; no text is needed.
    With fewer than two classes the chain is left at zero and the score is the
    share of label 1 (0.5 without labels).
    """
    y = np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Crf(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(_logit(share)))
    z = chained(own, counts)
    order = np.argsort(-counts, kind="stable")
    lens, y = counts[order], y[order]
    first = (np.cumsum(counts) - counts)[order]
    steps = int(lens[0])
    alive = [int((lens > t).sum()) for t in range(steps)]  # documents that have a line t, longest first
    rows = [first[:n] + t for t, n in enumerate(alive)]
    target = np.zeros(len(z))
    for t, n in enumerate(alive):
        target[rows[t]] = y[:n]
    # a document weighs as one however many lines it has, up to a slow growth
    doc_w = 1 / np.sqrt(lens)
    mean, spread = z.mean(axis=0), z.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1  # the constant
    z -= mean
    z /= spread
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    total = doc_w.sum()
    for it in range(1, rounds + 1):
        trans = theta[WIDTH:].reshape(2, 2)
        u = np.clip(z @ theta[:WIDTH], -30, 30)
        fwd, norm = [], None
        for t, n in enumerate(alive):
            unary = np.stack([np.zeros(n), u[rows[t]]], axis=1)
            f = unary if t == 0 else unary + np.logaddexp(fwd[-1][:n, :1] + trans[0], fwd[-1][:n, 1:] + trans[1])
            fwd.append(f)
        norm = np.empty(len(lens))
        for t in range(steps):
            n_next = alive[t + 1] if t + 1 < steps else 0
            norm[n_next:alive[t]] = np.logaddexp(fwd[t][n_next:, 0], fwd[t][n_next:, 1])
        g_u, g_t = np.zeros(len(z)), np.zeros((2, 2))
        back = np.zeros((alive[-1], 2))
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            if len(back) < n:
                back = np.vstack([back, np.zeros((n - len(back), 2))])
            p = np.exp(fwd[t] + back - norm[:n, None])
            g_u[rows[t]] = (target[rows[t]] - p[:, 1]) * doc_w[:n]
            if t:
                unary = np.stack([np.zeros(n), u[rows[t]]], axis=1)
                pair = np.exp(fwd[t - 1][:n, :, None] + trans[None] + (unary + back)[:, None, :] - norm[:n, None, None])
                g_t -= (pair * doc_w[:n, None, None]).sum(axis=0)
                g_t[0, 0] += ((1 - y[:n]) * doc_w[:n]).sum()
                g_t[1, 1] += (y[:n] * doc_w[:n]).sum()
                nxt = unary + back
                back = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
        grad = np.concatenate([z.T @ g_u, g_t.ravel()]) / total - decay * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.999 ** it)) + 1e-8)
    w = theta[:WIDTH] / spread
    w[-1] -= (theta[:WIDTH] * mean / spread).sum()
    model = Crf(w, theta[WIDTH:].reshape(2, 2).copy())
    del z
    raw, stop = [], np.cumsum(counts)
    for s in parts(chars):
        at = slice(stop[s.start] - counts[s.start], stop[s.stop - 1])
        raw.append(model.averages(chained(own[at], counts[s]), sizes[at], counts[s]))
    model.slope, model.shift = _calibrated(_logit(np.concatenate(raw)), np.array(labels, dtype=float))
    return model


def _calibrated(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and shift of a one-feature logistic regression, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g = np.array([((y - p) * s).sum() - 1e-2 * a, (y - p).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-9]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a + da, 1e-3), b + db
    return float(a), float(b)


def is_held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_train: int = 3000) -> Crf:
    """Fit on at most ``max_train`` labelled documents that are not held out, chosen by the hash of their id.

    Null labels and ids are left out; of several labels for an id the mean
    counts (0.5 and more: 1); of several rows of an id the first text by order.

    The tasks describe the lines; the driver gets 168 bytes for each line of the
    chosen documents, however long it is, and no text.
    """
    def describe(batches):
        for b in batches:
            texts = b.column("t").to_pylist()
            chars = [len(t) for t in texts]
            for s in parts(chars):
                own, sizes, counts = own_features(texts[s])
                cuts = np.cumsum(counts)[:-1]
                per_text = [[x.tobytes() for x in np.split(a, cuts)] for a in (own, sizes)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[s.start:s.stop], b.column("y")[s.start:s.stop], pa.array(
                    chars[s], pa.int64()), *[pa.array(x, pa.binary()) for x in per_text]], ["doc_id", "y", "chars", "own", "sizes"])

    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(~is_held_out("doc_id")).groupBy("doc_id").agg(
        (F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = only(docs, doc_id=F.col(id_col).cast("long"), t=text_of(text_col))
    present = ids.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    picked = [(r.doc_id, r.y) for r in sample.collect()]  # at most max_train pairs of numbers
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, y int")
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.first("y").alias("y"))
    data = got.mapInArrow(describe, "doc_id long, y int, chars long, own binary, sizes binary").collect()
    data.sort(key=lambda r: r.doc_id)
    sizes = np.frombuffer(b"".join(r.sizes for r in data), dtype=np.int64)
    own = np.frombuffer(b"".join(r.own for r in data)).reshape(len(sizes), OWN + 1)
    counts = np.array([len(r.sizes) // 8 for r in data], dtype=np.int64)
    chars, y = [r.chars for r in data], [r.y for r in data]
    del data
    return fit(own, sizes, counts, chars, y)


def score_documents(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; only the text enters a score.

    A null text counts as empty, which is one empty line and scored like any
    other. Null ids are kept (not held out). Equal texts score alike. An empty
    table gives an empty result; further columns are ignored.
    """
    def run(batches):
        for b in batches:
            s = model.score(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = only(docs, doc_id=F.col(id_col).cast("long"), t=text_of(text_col))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Crf, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all columns; only the text is sent to Python."""
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.score(text.slice(k, 256).to_pylist()) for k in range(0, len(text), 256))]))

    return docs.where(score(text_of(text_col)) >= threshold)
