"""Language identification as a mixture of languages.

Each language has hashed character n-gram likelihoods, learned from labelled documents. For a
document, expectation-maximisation estimates the share of each language among its words (equal
words of a document are one, with a weight); then the set of languages is chosen whose
log-likelihood, less half the logarithm of the number of words for each further language, is
largest. The prediction is the language with the largest share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, remainder_of_id, text_batches

#: Labelled documents of each language that the model is fitted on, at most (in expectation).
SAMPLE_PER_LANGUAGE = 3000
#: Different languages that a model may have.
MOST_LANGUAGES = 1000
BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
ROUNDS = 12
UNDETERMINED = "und"

_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def word_grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: where those of each word begin, and the hash buckets of all.

    The ends of a word are marked, so that none is too short for an n-gram.
    """
    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from here to the word's end
    gram = np.zeros(len(codes), dtype=np.uint64)
    for n in GRAMS:
        gram = (gram << np.uint64(21)) | np.append(codes[n - 1 :], np.zeros(n - 1, dtype=np.uint64))
        mixed = (gram ^ (gram >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        buckets = ((mixed ^ (mixed >> np.uint64(33))) % np.uint64(BUCKETS)).astype(np.int64)
        yield ends - sizes - (n - 1) * np.arange(len(words)), buckets[left >= n]


def _blocks(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of words that are looked at together, each with the place of its first word."""
    for some in by_size(range(len(words)), words, 200_000):
        yield some[0], words[some[0] : some[-1] + 1]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (languages, buckets)

    def words(self, words: list[str]) -> np.ndarray:
        """(languages, words) log-likelihoods, each summed over a word's n-grams and divided by the number of lengths."""
        found = np.zeros((len(self.languages), len(words)), dtype=np.float32)
        for at, some in _blocks(words):
            for starts, buckets in word_grams(some):
                for k, log_p in enumerate(self.log_p):
                    found[k, at : at + len(some)] += np.add.reduceat(log_p[buckets], starts)
        return found / len(GRAMS)


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", order: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """n-gram likelihoods from the rows where `learn` holds and the language is known.

    Rows are drawn by a hash of `order`, so that about per_language of each language are read;
    n-grams are counted on Spark and only buckets times languages of counts go to the driver. More
    than MOST_LANGUAGES different values are an error.
    """
    known = docs.filter(learn & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} languages; a model is as large as their number")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))]), F.col(lang_col))
    draw = F.pmod(F.xxhash64(order if order is not None else F.col(text_col)), F.lit(1_000_003)) / 1_000_003.0
    sample = known.filter(draw < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(BUCKETS, dtype=np.int64) for k in languages}
        for batch, texts in text_batches(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                # a word counts once in a document, so that repeated lines weigh little
                for _, some in _blocks(list(set(text.split()))):
                    for _, buckets in word_grams(some):
                        totals[lang] += np.bincount(buckets, minlength=BUCKETS)
        for lang, seen in totals.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(languages)), 0.5)
    table[counts["bucket"], counts["lang"].map({k: i for i, k in enumerate(languages)})] += counts["n"]
    return Model(languages, np.ascontiguousarray(np.log(table / table.sum(axis=0)).astype(np.float32).T))


def _shares_after(p: np.ndarray, weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rounds: int) -> np.ndarray:
    """Expectation-maximisation: (languages, documents) shares of the words of each document.

    p is (languages, words). A round multiplies each share by the mean, over the words, of the
    language's likelihood as a part of the mixture's, which is the mean responsibility.
    """
    total = np.add.reduceat(weight, starts)
    pi = np.full((len(p), len(starts)), 1 / len(p), dtype=np.float32)
    for _ in range(rounds):
        mixed = np.repeat(pi[0], sizes) * p[0]
        for k in range(1, len(p)):
            mixed += np.repeat(pi[k], sizes) * p[k]
        part = weight / mixed
        for k in range(len(p)):
            pi[k] *= np.add.reduceat(p[k] * part, starts) / total
        pi /= pi.sum(axis=0)
    return pi


def language_sets(words_ll: np.ndarray, weight: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(languages by share, their shares, size of the chosen set) for each document.

    words_ll has a row for each different word of a document, weight how often it occurs; words of
    document i begin at starts[i], and every document has one at least. Of the sets of the k
    largest shares the one counts with the largest log-likelihood, less half the logarithm of the
    number of words for each further language. All documents take the same number of rounds.
    """
    words_ll = np.ascontiguousarray(words_ll.T)
    languages, sizes = len(words_ll), np.diff(np.append(starts, words_ll.shape[1]))
    top = words_ll.max(axis=0)
    # likelihoods are relative to the word's best language; what is too small for a float counts as that
    p = np.exp(np.maximum(words_ll - top, -60))
    weight = weight.astype(np.float32)
    n = np.add.reduceat(weight, starts)
    pi = _shares_after(p, weight, starts, sizes, rounds)
    order = np.argsort(-pi, axis=0, kind="stable")
    best, size = np.full(len(starts), -np.inf), np.ones(len(starts), dtype=int)
    for k in range(1, languages + 1):
        chosen = np.where(np.argsort(order, axis=0) < k, pi, 0)
        chosen /= chosen.sum(axis=0)
        mixed = np.repeat(chosen[0], sizes) * p[0]
        for j in range(1, languages):
            mixed += np.repeat(chosen[j], sizes) * p[j]
        fit_k = np.add.reduceat((np.log(np.maximum(mixed, 1e-38)) * weight).astype(float), starts) - 0.5 * (k - 1) * np.log(n + 1)
        better = fit_k > best
        best[better], size[better] = fit_k[better], k
    ranked = np.take_along_axis(pi, order, axis=0)
    ranked = np.where(np.arange(languages)[:, None] < size, ranked, 0)
    return order, ranked / ranked.sum(axis=0), size


def shares(words_ll: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(best language, its share of the chosen set) for each document, from a row for each word."""
    order, ranked, _ = language_sets(words_ll, np.ones(len(words_ll)), starts, rounds)
    return order[0], ranked[0]


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Columns `keep`, lang_pred, score, languages and shares for each row of docs.

    languages is the chosen set, the largest share first, shares their shares; lang_pred and score
    are the first of each. A text that is null, empty or without a letter is `und` with score 0 and
    an empty set; so is every text if the model knows no language. Equal shares go to the language
    that sorts first. Texts are read whole. Other columns are ignored.
    """
    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, texts in text_batches(batches, "__text"):
            score = np.zeros(len(texts))
            found: list[tuple[list[str], list[float]]] = [([], [])] * len(texts)
            at = [i for i, t in enumerate(texts) if known.languages and has_letter(t)]
            for some in by_size(at, texts):
                counts = [Counter(texts[i].split()) for i in some]
                number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(counts)))}
                ends = np.cumsum([len(c) for c in counts])
                at_word = np.fromiter(map(number.__getitem__, chain.from_iterable(counts)), dtype=np.int64, count=ends[-1])
                weight = np.fromiter(chain.from_iterable(c.values() for c in counts), dtype=np.float32, count=ends[-1])
                ll = known.words(list(number))[:, at_word].T
                order, ranked, size = language_sets(ll, weight, np.append(0, ends[:-1]))
                for n, i in enumerate(some):
                    found[i] = ([known.languages[k] for k in order[: size[n], n]], ranked[: size[n], n].tolist())
                    score[i] = min(1.0, float(ranked[0, n]))
            lang = [f[0][0] if f[0] else UNDETERMINED for f in found]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            sets = [pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score), *sets], names=[*batch.schema.names[:-1], "lang_pred", "score", "languages", "shares"])

    return kept.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, languages array<string>, shares array<double>"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages and shares for each row of docs.

    The model learns from rows with a known language whose id's crc32 mod 4 is not 2. Null ids
    count as empty text there; repeated rows each come back; an empty table gives an empty result.
    """
    rest = remainder_of_id(F.col(id_col))
    model = fit(docs, rest != 2, text_col, lang_col, order=F.col(id_col))
    return predict(docs, model, text_col, (F.col(id_col).cast("long").alias("doc_id"), (rest == 2).alias("held_out")))


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language is undetermined or has a share under `least`.

    All columns of docs come back as they are.
    """
    model = fit(docs, F.lit(True), text_col, lang_col, order=F.col(id_col))
    every = tuple(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns))
    kept = predict(docs, model, text_col, every).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
