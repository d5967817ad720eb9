"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters of several widths run over them and the largest response
of each filter in the text goes to a logistic layer. For each language the score is mapped so that
0.3 is the cut with the best F1 on all its labelled rows that the classifier was not trained on,
counted by the sizes of the classes. A text's language is the one whose words it has, as learned
from the training rows, so that no label or lang column takes part in a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, cut_lineage, remainder_of_id, text_batches
from .word_cache import WordCache

#: Labelled rows of each class that the model is fitted on, at most (in expectation), and how many
#: characters they have on average at most: a longer text is drawn so much more seldom, one of over
#: LONGEST characters is not drawn. All texts are scored, whatever their length.
SAMPLE_PER_CLASS, CHARACTERS, LONGEST = 5000, 10_000, 1_000_000
#: Labelled rows of each class from which a language has a cut of its own.
OWN_CUT = 20
BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
FILTERS, SIZE = 8, 8
#: Lengths of word beginnings that have embeddings of their own; 0 is the whole word.
STEMS = (0, 4, 6)
#: Words of a text that are looked at together.
PART = 65536
CUT = 0.3
#: Bins of the log-odds of scores, to one unit.
BINS = 64
_EDGES = re.compile(r"^\W+|\W+$")


def buckets(word: str) -> bytes:
    """The embeddings of a word, without its case and outer punctuation, and of its beginnings.

    Their sum stands for the word, so that a rare form of a known stem is not unknown. 0 is the
    embedding of no word.
    """
    plain = word.lower()
    if not plain.isalnum():
        plain = _EDGES.sub("", plain)
    number = lambda kind, part: 1 + zlib.crc32(f"{kind}{part}".encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
    ids = [number(k, plain[:k] if k else plain) if len(plain) > k else 0 for k in STEMS]
    return np.array(ids if plain else [0] * len(STEMS), dtype=np.int32).tobytes()


_BUCKETS = WordCache(buckets)


def word_ids(text: str) -> np.ndarray:
    """(words, stems) embedding numbers of a text, with room for the widest filter at the end."""
    ids = b"".join(map(_BUCKETS.__getitem__, text.split()))
    return np.frombuffer(ids + bytes(4 * len(STEMS) * max(WIDTHS)), dtype=np.int32).reshape(-1, len(STEMS))


@dataclass
class Model:
    """taps holds what the embedding at each place of a window of each width adds to its filters."""

    taps: np.ndarray  # (buckets, places, filters)
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    cut: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)
    languages: list[str] = field(default_factory=list)
    speech: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), dtype=np.float32))  # log-likelihoods of buckets

    def rows(self, words: list[str]) -> np.ndarray:
        """Taps of the embeddings of each word, and its log-likelihood in each language."""
        ids = np.frombuffer(b"".join(map(buckets, words)), dtype=np.int32).reshape(-1, len(STEMS))
        taps = self.taps.reshape(len(self.taps), -1)
        return np.concatenate([sum(x[ids[:, k]] for k in range(len(STEMS))) for x in (taps, self.speech)], axis=1).astype(np.float32)

    def look(self, texts: Iterable[list[str]]) -> Callable[[list[str]], np.ndarray]:
        """A function that gives the rows of words of these texts; each different word is worked out once."""
        number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
        table = self.rows(list(number))
        return lambda words: table[np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))]

    def raw_texts(self, texts: list[str]) -> list[tuple[float, str | None]]:
        """The score and the language of each text. A long one is looked up part by part."""
        found = []
        for some in by_size(range(len(texts)), texts):
            words = [texts[i].split() for i in some]
            look = self.look(words) if len(some) > 1 else lambda part: self.look([part])(part)
            found += [self.raw(w, look) for w in words]
        return found

    def raw_ids(self, ids: np.ndarray) -> float:
        """The score of a text by its word_ids."""
        return self._raw(self.taps[ids[at : at + PART + max(WIDTHS)]].sum(axis=1) for at in range(0, len(ids), PART))

    def raw(self, words: list[str], look: Callable[[list[str]], np.ndarray]) -> tuple[float, str | None]:
        """The score and the language of a text by its words, whose rows look gives."""
        size = sum(WIDTHS) * FILTERS
        end = np.tile(np.append(self.taps[0].ravel(), np.zeros(len(self.languages))).astype(np.float32), (max(WIDTHS), 1))
        spoken = np.zeros(len(self.languages))

        def parts() -> Iterator[np.ndarray]:
            for at in range(0, len(words) + 1, PART):
                rows = look(words[at : at + PART + max(WIDTHS)])
                if at + PART + max(WIDTHS) >= len(words):  # only the text's end has room beyond it
                    rows = np.concatenate([rows, end])
                spoken[:] += rows[:PART, size:].sum(axis=0)
                yield rows[:, :size].reshape(-1, sum(WIDTHS), FILTERS)

        score = self._raw(parts())
        return score, self.languages[int(spoken.argmax())] if words and self.languages else None

    def _raw(self, parts: Iterator[np.ndarray]) -> float:
        tops = [np.full(FILTERS, -np.inf, dtype=np.float32) for _ in WIDTHS]
        for rows in parts:  # long texts come part by part
            place = 0
            for n, w in enumerate(WIDTHS):
                end = len(rows) - w + 1
                out = rows[:end, place]
                for j in range(1, w):
                    out = out + rows[j : j + end, place + j]
                tops[n] = np.maximum(tops[n], out.max(axis=0))
                place += w
        features = np.maximum(np.concatenate(tops) + self.bias.ravel(), 0)
        z = float(features @ self.weights + self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrated(p: Column, cut: float) -> Column:
    """Maps [0, cut] to [0, CUT] and [cut, 1] to [CUT, 1], so order stays."""
    below = F.least(p / max(1e-9, cut) * CUT, F.lit(float(np.nextafter(CUT, 0))))
    return F.when(p >= cut, CUT + (p - cut) / max(1e-9, 1 - cut) * (1 - CUT)).otherwise(below)


def _known(labels: DataFrame, learn: Column, id_col: str, label_col: str) -> DataFrame:
    return labels.filter(learn & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))


def _sig(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, lang_col: str, per_class: int) -> pd.DataFrame:
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, per_class / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003.0
    picked = F.broadcast(known.withColumn("left", draw / share).filter("left < 1"))  # some 2 * per_class rows
    rows = docs.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), _sig(text_col).alias("sig")).join(picked, id_col)
    length = F.length(F.coalesce("text", F.lit("")))
    rows = rows.filter((length <= LONGEST) & (F.col("left") * F.greatest(F.lit(1.0), length / CHARACTERS) < 1))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            ids = pa.array([word_ids(t).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, batch.column("label"), batch.column("lang"), batch.column("sig")], names=["id", "ids", "label", "lang", "sig"])

    rows = rows.select(F.col(id_col).cast("string").alias("id"), "text", "label", "lang", "sig")
    found = rows.mapInArrow(numbered, "id string, ids binary, label int, lang string, sig long").toPandas()
    return found.sort_values("id", kind="stable").drop_duplicates(["ids", "label"]).reset_index(drop=True)


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 30, seed: int = 1) -> Model:
    """Gradient descent (Adam) on the mean log-loss; only the largest windows get gradients.

    The first coordinate of an embedding begins at the smoothed log-odds of its word between the
    classes, so that filters find the telling words soon.
    """
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    seen = np.zeros((2, BUCKETS))
    for ids, y in zip(rows, labels, strict=True):
        seen[int(y), np.unique(ids)] += 1
    totals = np.array([max(1, int((labels == y).sum())) for y in (0, 1)])
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    # few sightings say little: shrink by how often the word was met
    met = seen.sum(axis=0)
    embed[:, 0] = odds * (met >= 3) * met / (met + 3)
    embed[0] = 0
    conv = {w: rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        conv[w][:, 0, :] = np.abs(conv[w][:, 0, :])
    params = {f"c{w}": conv[w] for w in WIDTHS} | {"bias": np.zeros((len(WIDTHS), FILTERS), np.float32), "weights": np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), "offset": np.array([-1.0], np.float32)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            ids = np.concatenate([rows[i] for i in batch])
            starts = np.concatenate([[0], np.cumsum([len(rows[i]) for i in batch])[:-1]])
            x = embed[ids].sum(axis=1)
            if epoch + 1 < epochs:  # words are hidden now and then
                x = x * (rng.random((len(ids), 1)) > 0.2)
            features, places = [], []
            for n, w in enumerate(WIDTHS):
                end = len(ids) - w + 1
                out = sum(x[j : j + end] @ params[f"c{w}"][j] for j in range(w))
                out = np.concatenate([out, np.full((w - 1, FILTERS), -1e9, np.float32)])
                top = np.maximum.reduceat(out, starts, axis=0)
                doc = np.repeat(np.arange(len(batch)), np.diff(np.append(starts, len(ids))))
                place = np.empty((len(batch), FILTERS), dtype=int)
                hit_row, hit_filter = np.nonzero(out == top[doc])
                place[doc[hit_row[::-1]], hit_filter[::-1]] = hit_row[::-1]
                places.append(place)
                features.append(top + params["bias"][n])
            raw = np.concatenate(features, axis=1)
            active = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ params["weights"] + params["offset"], -30, 30)))
            error = ((p - labels[batch]) / len(batch)).astype(np.float32)
            grad = {"weights": active.T @ error, "offset": error.sum(keepdims=True), "bias": np.zeros_like(params["bias"])}
            back = (error[:, None] * params["weights"][None, :]) * (raw > 0)
            moved: list[tuple[np.ndarray, np.ndarray]] = []
            for n, w in enumerate(WIDTHS):
                own = back[:, n * FILTERS : (n + 1) * FILTERS]
                grad["bias"][n] = own.sum(axis=0)
                g = np.zeros_like(params[f"c{w}"])
                for j in range(w):
                    where = np.minimum(places[n] + j, len(ids) - 1)
                    g[j] = np.einsum("df,dfs->sf", own, x[where])
                    moved.append((ids[where].reshape(-1, len(STEMS)), (own[:, :, None] * params[f"c{w}"][j].T[None]).reshape(-1, 1, SIZE)))
                grad[f"c{w}"] = g
            step += 1
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-5 * params[k]
            for at_ids, g in moved:
                np.subtract.at(embed, at_ids, 0.3 * g)
            embed[0] = 0
    taps = np.stack([embed @ params[f"c{w}"][j] for w in WIDTHS for j in range(w)], axis=1).astype(np.float32)
    return Model(taps, params["bias"], params["weights"], float(params["offset"][0]))


def _speech(rows: list[np.ndarray], langs: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and, for each, log-likelihoods of the buckets of words; a word counts once in a text."""
    languages = sorted({x for x in langs if x})
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for ids, lang in zip(rows, langs, strict=True):
        if lang:
            counts[np.unique(ids), languages.index(lang)] += 1
    found = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    found[0] = 0
    return languages, found


def best_cut(bins: pd.DataFrame) -> float:
    """The cut with the best F1, midway between the scores beside it; 0.5 if a class is missing.

    bins has label, bin, n (rows in the bin that were not trained on), low and high (their scores),
    and size (all rows of the label): rows stand for those of their label that were trained on.
    """
    weight = bins["n"] * bins["size"] / bins.groupby("label")["n"].transform("sum").clip(lower=1)
    by_bin = bins.assign(flagged=weight, hits=weight * bins["label"])[bins["n"] > 0].groupby("bin").agg({"flagged": "sum", "hits": "sum", "low": "min", "high": "max"}).sort_index(ascending=False)
    flagged, hits = by_bin["flagged"].cumsum().to_numpy(), by_bin["hits"].cumsum().to_numpy()
    if set(bins["label"][bins["n"] > 0]) != {0, 1}:
        return 0.5
    k = int(np.argmax(2 * hits / (flagged + hits[-1])))
    after = by_bin["high"].iloc[k + 1] if k + 1 < len(by_bin) else 0.0
    return float(np.clip((by_bin["low"].iloc[k] + after) / 2, 0.01, 0.99))


def calibrate(model: Model, scored: DataFrame, trained: list[int]) -> None:
    """Sets the cuts of model from scored: p, lang, label and sig (hash of the text) of all labelled rows.

    A text counts once for each label. Only counts by label, language and bin of the score go to
    the driver. trained has the hashes of the texts that the model knows.
    """
    seen = F.broadcast(scored.sparkSession.createDataFrame([(x,) for x in trained], "sig long").distinct().withColumn("seen", F.lit(True)))
    texts = scored.groupBy("sig", "label").agg(F.max("p").alias("p"), F.max("lang").alias("lang")).join(seen, "sig", "left")
    odds = F.floor(F.log(F.col("p") / (1 - F.col("p"))) * BINS)
    free = F.col("seen").isNull()
    counts = texts.groupBy("label", "lang", odds.alias("bin")).agg(
        F.count("*").alias("all"), F.count_if(free).alias("n"), F.min(F.when(free, F.col("p"))).alias("low"), F.max(F.when(free, F.col("p"))).alias("high")
    )
    bins = counts.toPandas()
    sized = lambda part: best_cut(part.assign(size=part.groupby("label")["all"].transform("sum")))
    model.cut = sized(bins)
    free_rows = bins[bins["lang"].notna()].groupby(["lang", "label"])["n"].sum().unstack(fill_value=0).reindex(columns=[0, 1], fill_value=0)
    own = set(free_rows.index[(free_rows >= OWN_CUT).all(axis=1)])
    model.by_language = {str(lang): sized(part) for lang, part in bins[bins["lang"].isin(own)].groupby("lang")}


def _fit_sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, lang_col: str, per_class: int) -> tuple[Model, list[int]]:
    """A model trained on three quarters of a bounded sample, and the hashes of these texts."""
    rows = _sample(docs, known, id_col, text_col, lang_col, per_class)
    ids, y = [np.frombuffer(b, dtype=np.int32).reshape(-1, len(STEMS)) for b in rows["ids"]], rows["label"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        none = np.zeros((BUCKETS, sum(WIDTHS), FILTERS), np.float32)
        return Model(none, np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS), -5.0), []
    held = np.array([zlib.crc32(f"{i}".encode()) % 16 >= 12 for i in rows["id"]])
    if held.all() or not held.any():
        held = np.arange(len(y)) % 4 == 3
    model = train([x for x, h in zip(ids, held, strict=True) if not h], y[~held])
    model.languages, model.speech = _speech(ids, [x if isinstance(x, str) else None for x in rows["lang"]])
    return model, rows["sig"][~held].tolist()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Trains on three quarters of a bounded sample of labelled rows and calibrates on all others.

    Labels other than 0 and 1 are ignored; of repeated labels of an id the largest counts. Without
    labels of both classes every score is below the cut.
    """
    known = _known(labels, learn, id_col, label_col)
    model, trained = _fit_sample(docs, known, id_col, text_col, lang_col, per_class)
    if trained:
        keep = (F.col("label"), _sig(text_col).alias("sig"))
        calibrate(model, _raw_scores(docs.join(known, id_col), model, text_col, keep), trained)
    return model


def _raw_scores(docs: DataFrame, model: Model, text_col: str, keep: tuple[Column, ...]) -> DataFrame:
    """Columns `keep`, p, the score before calibration, and lang, the text's language, for each row of docs."""
    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times filters floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, texts in text_batches(batches, "__text"):
            raw = known.raw_texts(texts)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p for p, _ in raw], pa.float64()), pa.array([x for _, x in raw], pa.string())], names=[*batch.schema.names[:-1], "p", "lang"])

    return kept.mapInArrow(run, ", ".join([*fields, "p double, lang string"]))


def _final(model: Model) -> tuple[Column, ...]:
    final = calibrated(F.col("p"), model.cut)
    for name, own in model.by_language.items():
        final = F.when(F.col("lang") == name, calibrated(F.col("p"), own)).otherwise(final)
    return final.alias("score"), (final >= CUT).cast("int").alias("predicted"), F.col("lang").alias("text_lang")


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Columns `keep`, score, predicted (score >= 0.3) and text_lang for each row of docs.

    text_lang is the language that the words of the text are likeliest in, null if there are none.
    Its cut is 0.3 in the score; a language with too few labelled rows has the cut of all. Whole
    texts are scored; null and empty ones too.
    """
    raw = _raw_scores(docs, model, text_col, keep)
    return raw.select(*[c for c in raw.columns if c not in ("p", "lang")], *_final(model))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted and text_lang for each row of docs.

    Labels of ids whose crc32 mod 4 is 2 are never learned from. Null ids count as empty text
    there; repeated rows each come back; an empty table gives an empty result.
    """
    rest = remainder_of_id(F.col(id_col))
    known = _known(labels, rest != 2, id_col, "toxic").withColumnRenamed(id_col, "known_id")
    model, trained = _fit_sample(docs, known.withColumnRenamed("known_id", id_col), id_col, text_col, lang_col, SAMPLE_PER_CLASS)
    # scored once; the cut is chosen from the scores of the labelled rows
    keep = (F.col(id_col).alias("id"), _sig(text_col).alias("sig"))
    raw = cut_lineage(_raw_scores(docs, model, text_col, keep))
    if trained:
        calibrate(model, raw.join(known, raw["id"] == known["known_id"]), trained)
    return raw.select(F.col("id").cast("long").alias("doc_id"), (remainder_of_id(F.col("id")) == 2).alias("held_out"), *_final(model))
