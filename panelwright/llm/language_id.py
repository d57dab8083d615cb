"""Language identification by sparse multinomial logistic regression on TF-IDF weights of character n-grams.

A word's n-grams are those of the word between two blanks. A document's weight of an n-gram is its share of all the
document's n-grams times the n-gram's inverse document frequency, so that the scores of a document are the sum of its
words' scores over its number of n-grams. The weights are learned with follow-the-regularised-leader and an
elastic-net penalty, and a temperature is fitted on documents kept back from that.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import bounded_batches, held_out, only, share
from panelwright.llm.shingles import mix
from panelwright.llm.words import kept_values

UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]")
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageSettings:
    """sample: labelled documents of a language that are learned from, in expectation; sample_total: of all, at most.
    most_languages: how many languages are learned, those with the most labelled documents (ties: first by name)."""

    most_languages: int = 1000
    sample: int = 400
    sample_total: int = 4000
    longest: int = 3
    buckets: int = 1 << 16
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    scale: float = 60.0


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, inverse document frequency included
    bias: np.ndarray
    temperature: float
    settings: LanguageSettings
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its n-grams' weights by language, and the number of its n-grams."""
        cells, owner = ngrams(words, self.settings)
        grams = np.bincount(owner, minlength=len(words))
        return np.column_stack([*(np.bincount(owner, w, len(words)) for w in self.weights[cells].T), grams])

    def logits(self, sums: np.ndarray) -> np.ndarray:
        """From the sums of word(): scores over languages, before the temperature."""
        return sums[:, :-1] * (self.settings.scale / np.maximum(sums[:, -1:], 1)) + self.bias


def ngrams(words: list[str], settings: LanguageSettings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram of letters, the word it is in), for lower-case words; what is no letter parts a word."""
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    owner = np.cumsum(points == 32) - 1  # words hold no blank; the blank before a word counts as the word's
    kinds, place = np.unique(points, return_inverse=True)
    letter = np.array([_NO_LETTERS.fullmatch(chr(p)) is None for p in kinds])[place]
    points = np.where(letter, points, 32).astype(np.uint64)
    cells, owners = [], []
    state = points
    for n in range(1, settings.longest + 1):
        m = len(points) - n + 1
        if m < 1:
            break
        if n > 1:
            state = state[:m] * np.uint64(0x100000001B3) + points[n - 1 :]
        inside = np.ones(m, bool)
        for j in range(n):
            if n == 1 or 0 < j < n - 1:
                inside &= letter[j : j + m]
        if n == 2:
            inside &= letter[:m] | letter[1 : m + 1]
        at = np.flatnonzero(inside)
        cells.append((mix(state[at] + np.uint64(n)) % np.uint64(settings.buckets)).astype(np.int64))
        owners.append(owner[at + ((n > 1) & ~letter[at])] if n > 1 else owner[at])
    return np.concatenate(cells), np.minimum(np.concatenate(owners), len(words) - 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_language(texts: list[str], langs: list[str], settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Every fifth text is kept back for the temperature. One language or none: a model without choice."""
    languages = sorted(set(langs))
    rows = []
    for text in texts:
        cells, _ = ngrams((text or "").lower().split() or [""], settings)
        cells, counts = np.unique(cells, return_counts=True)
        rows.append((cells, counts.astype(np.float64)))
    seen = np.zeros(settings.buckets)
    for cells, _ in rows:
        seen[cells] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    k = len(languages)
    z, n = np.zeros((settings.buckets, k)), np.zeros((settings.buckets, k))
    bias = np.zeros(k)
    target = np.eye(k)[[languages.index(x) for x in langs]] if k else np.zeros((0, 0))
    xs = [settings.scale * counts / max(counts.sum(), 1) * idf[cells] for cells, counts in rows]

    def leader(cells: np.ndarray) -> np.ndarray:
        own = z[cells]
        return -np.sign(own) * np.maximum(np.abs(own) - settings.l1, 0) / ((settings.beta + np.sqrt(n[cells])) / settings.alpha + settings.l2)

    order = np.random.default_rng(1).permutation(len(rows))
    train, kept_back = [i for i in order if i % 5], [i for i in order if i % 5 == 0]
    for _ in range(settings.epochs if k > 1 else 0):
        for i in train:
            cells, x = rows[i][0], xs[i]
            w = leader(cells)
            error = _softmax(x @ w) - target[i]
            g = x[:, None] * error
            grown = n[cells] + g * g
            z[cells] += g - (np.sqrt(grown) - np.sqrt(n[cells])) / settings.alpha * w
            n[cells] = grown
    weights = leader(np.arange(settings.buckets)) if k else np.zeros((settings.buckets, 0))
    temperature = 1.0
    if k > 1 and kept_back:
        logits = np.array([xs[i] @ weights[rows[i][0]] for i in kept_back])
        gold = target[kept_back].argmax(axis=1)
        grid = np.exp(np.linspace(math.log(0.05), math.log(20), 121))
        doubt = 1 / (len(gold) + 2)  # what few documents cannot rule out; without it, a faultless split asks for no temperature at all

        def loss(t: float) -> float:
            p = np.log(_softmax(logits / t) + 1e-300)
            return -(1 - doubt) * p[np.arange(len(gold)), gold].mean() - doubt * p.mean()

        temperature = float(min(grid, key=loss))
    return LanguageModel(languages, weights * idf[:, None], bias, temperature, settings)


def labelled_sample(docs: DataFrame, doc_id: str, text: str, lang: str, settings: LanguageSettings) -> DataFrame:
    """(text, lang) of about settings.sample documents of each language, chosen by a hash of the id, none held out."""
    usable = only(docs, doc_id, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    counts = usable.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)) / (1 << 40)
    chosen = usable.join(F.broadcast(counts.orderBy(F.desc("_n"), "_lang").limit(settings.most_languages)), F.col(lang) == F.col("_lang"))
    return chosen.where(place < settings.sample / F.col("_n")).select(F.xxhash64(doc_id, text).alias("_h"), F.col(text).alias("text"), F.col(lang).alias("lang")).orderBy("_h").limit(settings.sample_total)


def train_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    rows = labelled_sample(docs, doc_id, text, lang, settings).select("text", "lang").collect()  # at most sample_total rows
    return fit_language([r["text"] for r in rows], [r["lang"] for r in rows], settings)


def predict_language(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row, over its whole text.

    Null text or text without a letter: "und" and 0. A tie goes to the first language by name; without any language
    learned, all is "und". Null doc_ids and repeated rows stay as they are; an empty table gives an empty table.
    """
    predict = predictor(docs, model)

    def rows(batches):
        for batch in batches:
            best, score = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return only(docs, doc_id, text).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of at least this."""
    bounded_batches(docs.sparkSession)
    predict, at = predictor(docs, model), docs.columns.index(text)

    def rows(batches):
        for batch in batches:
            best, score = predict(batch.column(at))
            yield batch.filter(pa.array((best != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(rows, docs.schema)


def predictor(docs: DataFrame, model: LanguageModel):
    """A function for the executors: (languages, scores) of a text column."""
    shared = share(docs.sparkSession, model)

    def predict(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own, n = shared(), len(column)
        values = kept_values(own.name, len(own.languages) + 1, own.words)
        names = np.array([*own.languages, UNKNOWN], object)
        sums = np.zeros((n, len(own.languages) + 1))
        for a, b, v, at in values.rows(column):
            total = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)])
            sums[a:b] = total[at[1:]] - total[at[:-1]]
        best, score = np.full(n, len(own.languages)), np.zeros(n)
        if own.languages:
            p = _softmax(own.logits(sums) / own.temperature)
            best, score = p.argmax(axis=1), p.max(axis=1)
        lettered = sums[:, -1] > 0
        for i in np.flatnonzero(~lettered):
            lettered[i] = bool(_LETTER.search(column[int(i)].as_py() or ""))
        best = np.where(lettered, best, len(own.languages))
        return names[best], np.clip(np.where(best < len(own.languages), score, 0.0), 0, 1)

    return predict
