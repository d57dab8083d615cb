"""Toxic spans by a linear-chain conditional random field over words.

Two labels, plain and toxic. A word's features are itself, its beginnings and its ending, all of letters and digits
only; the transitions tie neighbours. The tables label documents, not words, so token labels are mined from those: in
a toxic training document the words count as toxic that hold a feature which is common in toxic documents and all but
absent from plain ones; the field learns from such lists of words what it can, never from the list itself at scoring.
Forward-backward marginals give each word's probability, and a logistic curve over the strongest words of a document
gives its score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import held_out, only, share, text_bytes
from panelwright.llm.shingles import shingle_sets
from panelwright.llm.words import kept_values

_MARKS = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN, TOXIC = 0, 1


@dataclass(frozen=True)
class ToxicSettings:
    """sample: training documents of each label, in expectation; sample_total: of both, at most."""

    sample: int = 900
    sample_total: int = 2400
    beginnings: tuple[int, ...] = (4, 5, 6)
    least_documents: int = 5
    least_share: float = 0.025
    least_ratio: float = 25.0
    steps: int = 25
    rate: float = 0.5
    penalty: float = 1e-4
    span_from: float = 0.5
    predicted_from: float = 0.3


@dataclass
class ToxicModel:
    weights: dict[str, float]  # feature: by how much it favours toxic
    bias: float
    transitions: np.ndarray  # 2 x 2, potentials
    start: np.ndarray
    curve: np.ndarray  # of (1, logit of the largest marginal, log1p of the sum of marginals over span_from)
    settings: ToxicSettings
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> np.ndarray:
        get = self.weights.get
        return np.array([self.bias + sum([get(f, 0.0) for f in features(w, self.settings)]) for w in words]).reshape(-1, 1)

    def scores(self, marginals: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(marginals, at, self.settings) @ self.curve, -30, 30)))


def features(word: str, settings: ToxicSettings) -> list[str]:
    own = word if word.isalnum() else _MARKS.sub("", word)
    if not own:
        return ["-"]
    return ["w" + own, *["p" + own[:n] for n in settings.beginnings if len(own) > n], "s" + own[-4:]]


def marginals(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, start: np.ndarray, with_pairs: bool = False):
    """Probability of toxic for each word of a run of sequences (scores: toxic against plain; starts: first words).

    with_pairs: also the expected counts of the four transitions (2 x 2) and of the two labels of first words. The words are laid out in lanes of equal length; the lanes' transfer matrices are multiplied, the lanes' ends
    chained, and the messages then passed in all lanes at once. This is exact forward-backward, whatever the lengths.
    """
    n = len(scores)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if with_pairs else np.zeros(0)
    lanes = max(1, int(math.sqrt(n)))
    length = -(-n // lanes)
    begin = np.zeros(lanes * length, bool)
    begin[starts[starts < n]] = True
    begin[0] = True
    begin[n:] = True  # what fills the last lane is no part of the last sequence
    e = np.exp(np.clip(np.append(scores, np.zeros(lanes * length - n)), -30, 30)).reshape(lanes, length)
    first = begin.reshape(lanes, length)
    (t00, t01), (t10, t11) = np.exp(transitions)
    s0, s1 = np.exp(start)
    m00, m10 = np.where(first, s0, t00), np.where(first, s0, t10)
    m01, m11 = np.where(first, s1, t01) * e, np.where(first, s1, t11) * e
    p = [np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)]  # product of a lane's matrices
    for j in range(length):
        a, b, c, d = m00[:, j], m01[:, j], m10[:, j], m11[:, j]
        p = [p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d]
        total = p[0] + p[1] + p[2] + p[3]
        p = [x / total for x in p]
    left, right = np.ones((lanes, 2)), np.ones((lanes, 2))
    for i in range(1, lanes):
        l0, l1 = left[i - 1]
        v = np.array([l0 * p[0][i - 1] + l1 * p[2][i - 1], l0 * p[1][i - 1] + l1 * p[3][i - 1]])
        left[i] = v / v.sum()
    for i in range(lanes - 2, -1, -1):
        r0, r1 = right[i + 1]
        v = np.array([p[0][i + 1] * r0 + p[1][i + 1] * r1, p[2][i + 1] * r0 + p[3][i + 1] * r1])
        right[i] = v / v.sum()
    f0, f1 = np.empty((lanes, length)), np.empty((lanes, length))
    x, y = left[:, 0], left[:, 1]
    for j in range(length):
        x, y = x * m00[:, j] + y * m10[:, j], x * m01[:, j] + y * m11[:, j]
        total = x + y
        x, y = x / total, y / total
        f0[:, j], f1[:, j] = x, y
    out, pairs, inner = np.empty((lanes, length)), np.zeros((2, 2)), ~first
    inner[np.arange(lanes * length).reshape(lanes, length) >= n] = False
    x, y = right[:, 0], right[:, 1]
    for j in range(length - 1, -1, -1):
        a, b = f0[:, j] * x, f1[:, j] * y
        out[:, j] = b / (a + b)
        if with_pairs:
            l0, l1 = (f0[:, j - 1], f1[:, j - 1]) if j else left.T
            both = np.array([[l0 * m00[:, j] * x, l0 * m01[:, j] * y], [l1 * m10[:, j] * x, l1 * m11[:, j] * y]])
            pairs += (both / both.sum(axis=(0, 1)))[:, :, inner[:, j]].sum(axis=2)
        x, y = m00[:, j] * x + m01[:, j] * y, m10[:, j] * x + m11[:, j] * y
        total = x + y
        x, y = x / total, y / total
    p = out.reshape(-1)[:n]
    if not with_pairs:
        return p
    firsts = p[begin[:n]]
    return p, pairs, np.array([(1 - firsts).sum(), firsts.sum()])


def document_features(p: np.ndarray, at: np.ndarray, settings: ToxicSettings) -> np.ndarray:
    n = len(at) - 1
    most, strong = np.zeros(n), np.zeros(n)
    owner = np.repeat(np.arange(n), np.diff(at))
    np.maximum.at(most, owner, p)
    np.add.at(strong, owner, np.where(p >= settings.span_from, p, 0.0))
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.column_stack([np.ones(n), np.log(most / (1 - most)), np.log1p(strong)])


def copies(texts: list[str]) -> np.ndarray:
    """How many of the texts each one is a likely copy of, itself included: those with an equal least or greatest shingle."""
    data, offsets = text_bytes(pa.array([t or "" for t in texts], pa.large_string()))
    ends = [(int(s[0]), int(s[-1])) if len(s) else (i, i) for i, s in enumerate(shingle_sets(data, offsets, 5))]
    low, high = Counter(a for a, _ in ends), Counter(b for _, b in ends)
    return np.array([max(low[a], high[b]) for a, b in ends], float)


def fit_toxic(texts: list[str], labels: list[int], settings: ToxicSettings = ToxicSettings()) -> ToxicModel:
    """Without documents of both labels: a model that gives every document the share of toxic labels."""
    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    flat = np.array([math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0])
    if not len(y) or y.min() == y.max():
        return ToxicModel({}, -10.0, np.zeros((2, 2)), np.zeros(2), flat, settings)
    docs = [[w.lower() for w in _WORD.findall(t or "")] for t in texts]
    words = sorted({w for d in docs for w in d})
    number = {w: i for i, w in enumerate(words)}
    by_word = [features(w, settings) for w in words]
    weight = 1 / copies(texts)
    df: dict[int, dict[str, float]] = {PLAIN: defaultdict(float), TOXIC: defaultdict(float)}
    for d, label, share_of_copies in zip(docs, labels, weight.tolist()):
        own = df[label]
        for f in {f for w in set(d) for f in by_word[number[w]]}:
            own[f] += share_of_copies
    n_toxic, n_plain = float(weight[y > 0].sum()), float(weight[y == 0].sum())
    least = max(settings.least_documents, settings.least_share * n_toxic)
    marking = {f for f, n in df[TOXIC].items() if f[0] in "wp" and n >= least and n / n_toxic >= settings.least_ratio * (df[PLAIN].get(f, 0.0) + 0.2) / n_plain}
    kept = sorted(f for f in {*df[TOXIC], *df[PLAIN]} if f in marking or df[TOXIC][f] + df[PLAIN][f] >= 5)
    place = {f: i for i, f in enumerate(kept)}
    pairs = [(i, place[f]) for i, fs in enumerate(by_word) for f in fs if f in place]
    owner, cell = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    marked = np.array([any(f in marking for f in fs) for fs in by_word])
    ids = np.array([number[w] for d in docs for w in d], np.int64)
    at = np.cumsum([0, *map(len, docs)])
    gold = (marked[ids] & np.repeat(y > 0, np.diff(at))).astype(float) if len(ids) else np.zeros(0)
    n = len(ids)
    w, bias, trans, start = np.zeros(len(kept)), -4.0, np.zeros((2, 2)), np.zeros(2)
    grown_w, grown_b, grown_t, grown_s = np.full(len(kept), 1e-8), 1e-8, np.full((2, 2), 1e-8), np.full(2, 1e-8)
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < n]] = True
    follows = np.flatnonzero(~first)
    pair_gold = np.bincount((gold[follows - 1] * 2 + gold[follows]).astype(int), minlength=4).reshape(2, 2) if len(follows) else np.zeros((2, 2))
    first_gold = np.bincount(gold[first].astype(int), minlength=2).astype(float)
    scale = max(1.0, gold.sum())
    for _ in range(settings.steps if n else 0):
        emit = (bias + np.bincount(owner, w[cell], len(words)))[ids]
        p, pair, firsts = marginals(emit, at[:-1], trans, start, with_pairs=True)
        gap = (p - gold) / scale
        g_word = np.bincount(ids, gap, len(words))
        g = np.bincount(cell, g_word[owner], len(kept)) + settings.penalty * w
        g_t = (pair - pair_gold) / scale + 1e-3 * trans
        g_s = (firsts - first_gold) / scale + 1e-3 * start
        grown_w += g * g
        grown_b += gap.sum() ** 2
        grown_t += g_t * g_t
        grown_s += g_s * g_s
        w -= settings.rate * g / np.sqrt(grown_w)
        bias -= settings.rate * gap.sum() / math.sqrt(grown_b)
        trans -= 0.1 * settings.rate * g_t / np.sqrt(grown_t)
        start -= 0.1 * settings.rate * g_s / np.sqrt(grown_s)
    model = ToxicModel({f: float(x) for f, x in zip(kept, w) if abs(x) > 1e-3}, float(bias), trans, start, flat, settings)
    p = marginals(model.words(words)[ids, 0] if n else np.zeros(0), at[:-1], trans, start)
    x = document_features(p, at, settings)
    curve = np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        s = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        curve -= np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (s - y) + 0.1 * curve)
    model.curve = curve
    return model


def train_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", settings: ToxicSettings = ToxicSettings()) -> ToxicModel:
    """Learns from a sample of bounded size of the labelled documents that are not held out, chosen by a hash of the id."""
    usable = only(labels, doc_id, toxic).where(F.col(toxic).isin(PLAIN, TOXIC) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    counts = {r[toxic]: r["n"] for r in usable.groupBy(toxic).agg(F.count("*").alias("n")).collect()}  # two rows
    place = F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)) / (1 << 40)
    share = F.when(F.col(toxic) == TOXIC, settings.sample / counts.get(TOXIC, 1)).otherwise(settings.sample / counts.get(PLAIN, 1))
    chosen = usable.where(place < share).orderBy(F.xxhash64(doc_id), doc_id).limit(settings.sample_total)
    rows = only(docs, doc_id, text).join(F.broadcast(chosen), doc_id).select(doc_id, text, toxic).orderBy(doc_id).limit(settings.sample_total).collect()
    return fit_toxic([r[text] for r in rows], [r[toxic] for r in rows], settings)


def tag_toxic(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text", with_spans: bool = True) -> DataFrame:
    """doc_id, score, predicted, and spans: an array of (start, end, probability) of toxic words, in code points.

    Every whole text is scored; null and empty texts have the score of a text without toxic words. Neighbouring toxic
    words make one span. Null doc_ids and repeated rows stay as they are; an empty table gives an empty table.
    """
    shared = share(docs.sparkSession, model)

    def spans_of(content: str, p: np.ndarray, least: float) -> list[dict]:
        out: list[dict] = []
        last = -2
        for k, m in enumerate(_WORD.finditer(content)):
            if p[k] >= least:
                if last == k - 1:
                    out[-1] |= {"end": m.end(), "probability": max(out[-1]["probability"], float(p[k]))}
                else:
                    out.append({"start": m.start(), "end": m.end(), "probability": float(p[k])})
                last = k
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def tag(batches):
        own = shared()
        values = kept_values(own.name, 1, own.words)
        for batch in batches:
            column, score, spans = batch.column(1), np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for a, b, v, at in values.rows(column):
                p = marginals(v[:, 0], at[:-1], own.transitions, own.start)
                score[a:b] = own.scores(p, at)
                if with_spans and len(p):
                    hits = np.unique(np.searchsorted(at, np.flatnonzero(p >= own.settings.span_from), "right") - 1)
                    for i in hits.tolist():
                        spans[a + i] = spans_of(column[a + i].as_py(), p[at[i] : at[i + 1]], own.settings.span_from)
            arrays = [batch.column(0).cast(pa.int64()), pa.array(score), pa.array((score >= own.settings.predicted_from).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(spans, kind)] * with_spans], ["doc_id", "score", "predicted", *["spans"] * with_spans])

    return only(docs, doc_id, text).mapInArrow(tag, "doc_id long, score double, predicted int" + ", spans array<struct<start:int,end:int,probability:double>>" * with_spans)
