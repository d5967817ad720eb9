"""Mixing to target weights with soft membership.

A labelled table names the domain of some documents. A naive Bayes classifier over hashed words and
word ends learns from them and gives each document the posterior of each domain. Then a projected
gradient least-squares fit finds a rate for each document, never negative, such that the expected
tokens of each domain (tokens * rate * posterior, summed over all documents) match the targets.
Copies are whole numbers: a document's draw is held against its rate, moved by one shift for each
domain, chosen so that the drawn tokens of the domain's documents are as many as the rates say.
Everything runs in DataFrame expressions; the driver only sees sums for each domain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, whole_rows

#: Labelled documents of each domain that the classifier is fitted on, at most (in expectation).
SAMPLE_PER_DOMAIN = 3000
WORD_BUCKETS, END_BUCKETS = 4096, 1024
#: A posterior counts at most so many words as independent evidence.
EVIDENCE = 40.0

#: Steps of a shift of the draws, to one unit.
SHIFTS = 4096

#: Domains of the labels table, and the shares of tokens they are mixed to.
LABELLED = {"toxic": "toxic = 1", "good": "coalesce(toxic, 0) <> 1 AND quality = 1", "low": "coalesce(toxic, 0) <> 1 AND quality = 0"}
TARGETS = {"good": 0.88, "low": 0.09, "toxic": 0.03}


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _buckets(word: Column) -> tuple[Column, Column]:
    plain = F.lower(word)
    return F.pmod(F.xxhash64(plain), F.lit(WORD_BUCKETS)), F.pmod(F.xxhash64(F.right(plain, F.lit(2))), F.lit(END_BUCKETS)) + WORD_BUCKETS


@dataclass
class Classifier:
    """Log-likelihoods of buckets under each domain, less those under the first domain."""

    domains: list[str]
    prior: list[float]
    tables: list[list[float]]

    def add_posteriors(self, docs: DataFrame, text_col: str) -> DataFrame:
        """docs with __n (words) and __p (array of a posterior for each domain).

        A text without words has the priors. Each step is a projection of its own, so that no
        expression is evaluated twice for a row.
        """
        docs = docs.withColumn("__words", words(F.col(text_col)))
        if len(self.domains) < 2:
            return docs.withColumns({"__n": F.size("__words"), "__p": F.array(*[F.lit(1.0)] * len(self.domains))}).drop("__words")
        tables = [F.split(F.lit(",".join(f"{x:.5g}" for x in t)), ",").cast("array<double>") for t in self.tables]
        start = F.struct(*[F.lit(0.0).alias(f"s{k}") for k in range(len(tables))])

        def add(sums: Column, word: Column) -> Column:
            w, e = _buckets(word)
            return F.struct(*[(sums[f"s{k}"] + F.get(t, w) + F.get(t, e)).alias(f"s{k}") for k, t in enumerate(tables)])

        docs = docs.withColumns({"__n": F.size("__words"), "__sums": F.aggregate("__words", start, add)}).drop("__words")
        # repeated and neighbouring words are no independent evidence, so long texts are tempered
        docs = docs.withColumn("__temper", F.least(F.lit(1.0), F.sqrt(F.lit(EVIDENCE) / F.greatest("__n", F.lit(1)))))
        logits = [F.lit(p) + (F.lit(0.0) if k == 0 else F.col(f"__sums.s{k - 1}") * F.col("__temper")) for k, p in enumerate(map(math.log, self.prior))]
        docs = docs.withColumns({f"__l{k}": x for k, x in enumerate(logits)})
        each = [F.col(f"__l{k}") for k in range(len(logits))]
        docs = docs.withColumn("__top", F.greatest(*each))
        docs = docs.withColumns({f"__l{k}": F.exp(x - F.col("__top")) for k, x in enumerate(each)})
        docs = docs.withColumn("__all", sum(each[1:], each[0]))
        return docs.withColumn("__p", F.array(*[x / F.col("__all") for x in each])).drop("__sums", "__temper", "__top", "__all", *[f"__l{k}" for k in range(len(each))])


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: dict[str, str] | None = None, per_domain: int = SAMPLE_PER_DOMAIN) -> Classifier:
    """Naive Bayes from a bounded sample of the labelled documents.

    labelled maps a domain to a condition on the labels table; the first that holds counts. Rows
    with no domain or a null id teach nothing. A word counts once in a document.
    """
    labelled = labelled or LABELLED
    domain = F.lit(None).cast("string")
    for name, condition in reversed(labelled.items()):
        domain = F.when(F.expr(condition), F.lit(name)).otherwise(domain)
    known = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).filter(F.col("id").isNotNull() & F.col("domain").isNotNull())
    known = known.groupBy("id").agg(F.min("domain").alias("domain"))
    sizes = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if not domains:
        return Classifier([], [], [])
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("domain") == name, min(1.0, per_domain / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit("domain")), F.lit(1_000_003)) / 1_000_003.0
    picked = F.broadcast(known.filter(draw < share))  # per_domain rows of each domain
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    each = rows.select("domain", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    counts = each.select("domain", F.explode(F.array(*_buckets(F.col("word")))).alias("bucket")).groupBy("domain", "bucket").count().collect()
    table = np.ones((len(domains), WORD_BUCKETS + END_BUCKETS))
    for r in counts:
        table[domains.index(r["domain"]), r["bucket"]] += r["count"]
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, None)):
        table[:, part] /= table[:, part].sum(axis=1, keepdims=True)
    logs = np.log(table)
    total = sum(sizes.values())
    return Classifier(domains, [sizes[d] / total for d in domains], [(logs[k] - logs[0]).tolist() for k in range(1, len(domains))])


def rate_after(steps: list[list[float]], posterior: Column) -> Column:
    """The rate of a document after gradient steps, each followed by the projection to 0 and up."""
    rate = F.lit(1.0)
    for step in steps:
        move = F.lit(0.0)
        for k, x in enumerate(step):
            move = move + F.lit(float(x)) * posterior[k]
        rate = F.greatest(F.lit(0.0), rate - move)
    return rate


def fit_rates(soft: DataFrame, targets: list[float], rounds: int = 25, tolerance: float = 1e-7) -> tuple[list[list[float]], float]:
    """Gradient steps for rate_after and the largest error that is left, as a share of all tokens.

    soft has tokens and p (array of posteriors). The objective is half the squared difference of
    expected domain tokens, as shares of the present tokens, from targets. A step follows the
    gradient in the metric of the documents' tokens, scaled by the inverse of the domains' Gram
    matrix, which makes it exact as long as no rate is cut off at 0.
    """
    k = len(targets)
    gram = [F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
    row = soft.agg(F.sum("tokens").alias("all"), *gram).first()
    total = float(row["all"] or 0)
    if not total:
        return [], 0.0
    matrix = np.array([[row[f"g{i}_{j}"] / total for j in range(k)] for i in range(k)]) + 1e-9 * np.eye(k)
    steps: list[list[float]] = []
    error = math.inf
    for _ in range(rounds):
        rate = rate_after(steps, F.col("p"))
        sums = soft.select(rate.alias("rate"), "tokens", "p").agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).first()
        gap = np.array([sums[f"s{i}"] / total - targets[i] for i in range(k)])
        error = float(np.abs(gap).max())
        if error < tolerance:
            break
        steps.append(np.linalg.solve(matrix, gap).tolist())
    return steps, error


def draw(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1, the same in every run; texts of one id or of none have their own."""
    return F.pmod(F.xxhash64(doc_id, F.xxhash64(text), F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)


def _domain(posterior: Column) -> Column:
    """The place of the likeliest domain, from 1; of equal ones the first."""
    return F.array_position(posterior, F.array_max(posterior)).cast("int")


def fit_shifts(soft: DataFrame, steps: list[list[float]], domains: int) -> list[float]:
    """The shift of each domain with which its drawn tokens come closest to what the rates say.

    soft has tokens, p and draw. An extra copy is drawn where draw less the rate's fraction lies
    below the shift; without a shift that holds in the mean only, and a few long documents part
    the drawn tokens from the mean. Two numbers for each step go to the driver.
    """
    rate = rate_after(steps, F.col("p"))
    rows = soft.select("tokens", "draw", _domain(F.col("p")).alias("domain"), (rate - F.floor(rate)).alias("part")).filter("part > 0")
    bins = rows.groupBy("domain", F.floor((F.col("draw") - F.col("part")) * SHIFTS).alias("bin")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("part")).alias("due"))
    found = bins.toPandas().sort_values("bin")
    shifts = [0.0] * domains
    for domain, own in found.groupby("domain"):
        drawn = np.concatenate([[0], own["tokens"].cumsum().to_numpy(dtype=float)])
        k = int(np.argmin(np.abs(drawn - float(own["due"].sum()))))
        shifts[int(domain) - 1] = float(own["bin"].iloc[k - 1] + 1) / SHIFTS if k else -1.0
    return shifts


def copies(rate: Column, posterior: Column, drawn: Column, shifts: list[float]) -> Column:
    """A whole number of copies; a rate that is a whole number is kept."""
    part = rate - F.floor(rate)
    shift = F.element_at(F.array(*map(F.lit, shifts)), _domain(posterior)) if shifts else F.lit(0.0)
    return (F.floor(rate) + F.when((part > 0) & (F.floor((drawn - part) * SHIFTS) < shift * SHIFTS), 1).otherwise(0)).cast("int")


@dataclass
class Mix:
    """What the fit found: the classifier, the gradient steps, the error that is left, and shifts of the draws."""

    classifier: Classifier
    steps: list[list[float]]
    error: float
    shifts: list[float]


def fit_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", labelled: dict[str, str] | None = None, tokens_col: str | None = None) -> tuple[Mix, DataFrame]:
    """The fit, and doc_id, tokens, p and draw of each row of docs."""
    classifier = fit_classifier(docs, labels, id_col, text_col, labelled)
    given = F.col(tokens_col).cast("long") if tokens_col else F.lit(None).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), given.alias("given"))
    soft = classifier.add_posteriors(texts, "text")
    soft = soft.select("doc_id", F.coalesce("given", F.col("__n")).cast("long").alias("tokens"), F.col("__p").alias("p"), draw(F.col("doc_id"), F.col("text")).alias("draw"))
    soft = cut_lineage(soft)
    aims = [max(0.0, (targets or TARGETS).get(d, 0.0)) for d in classifier.domains]
    aims = [a / (sum(aims) or 1) for a in aims]
    steps, error = fit_rates(soft, aims) if classifier.domains else ([], 0.0)
    shifts = fit_shifts(soft, steps, len(classifier.domains)) if steps else []
    return Mix(classifier, steps, error, shifts), soft


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", labelled: dict[str, str] | None = None, tokens_col: str | None = None) -> tuple[Classifier, list[list[float]], DataFrame]:
    """(classifier, steps, rates); rates has a row per row of docs.

    Its columns: doc_id, tokens (of tokens_col, else words), a posterior p_<domain> for each domain,
    rate, copies and fit_error, the largest difference from the targets that the rates leave.
    Domains without a target keep nothing; targets are scaled to a sum of 1 over the domains that
    the labels have. Without labels every rate is 1. Null and empty texts have 0 tokens, the prior
    as posterior and thus the rate of a mean document. Targets that no rates meet are approached
    in least squares. Repeated rows each come back; null ids too. An empty table gives none.
    """
    found, soft = fit_mix(docs, labels, targets, id_col, text_col, labelled, tokens_col)
    rate = rate_after(found.steps, F.col("p"))
    rates = soft.select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(found.classifier.domains)], rate.alias("rate"), copies(rate, F.col("p"), F.col("draw"), found.shifts).alias("copies"))
    return found.classifier, found.steps, rates.withColumn("fit_error", F.lit(found.error))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """docs with each row as often as its copies say; all columns of docs come back.

    Rows with null or equal ids are told apart by their texts. An empty table stays empty.
    """
    found, _ = fit_mix(docs, labels, targets, id_col, text_col, None, tokens_col)
    if not found.steps:
        return docs
    # what the operator needs goes by names of its own; the columns of docs come along as they are
    kept = whole_rows(docs, __id=F.col(id_col).cast("long"), __text=F.col(text_col))
    soft = found.classifier.add_posteriors(kept, "__text").withColumn("__rate", rate_after(found.steps, F.col("__p")))
    often = soft.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies(F.col("__rate"), F.col("__p"), draw(F.col("__id"), F.col("__text")), found.shifts))))
    return often.select("__row.*")
