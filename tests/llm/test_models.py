import random
import re

import numpy as np
import pytest
from brute import PII, pii_base
from pyspark.sql import functions as F

from pulsegrain.llm import language_id, mixing, pii, topk_search, toxicity

ODD = [
    "a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8 1.2..3.4.5.6 256.1.1.1 001.002.003.004", "4111 1111 1111 1111  4111-1111-1111-1111 1 2 3 41111111111111111", "+1 (555) 010-9999. +12 +1(((((", "é😀 a.b@c.de 😀 10.0.0.1",
    None, "", "7" * 30 + " " + "1 " * 3000, "a@b@c.d@e.f", "1" * 20000, "x." * 3000 + "@a" + ".b" * 3000, "4111111111111111,4111111111111111", "١٢.٣.٤.٥ 1.2.3.4",
]


def test_base_spans_are_the_contract_s(spark):
    rng = random.Random(2)
    alphabet = ["1", "4111111111111111", ".", "@", "+", "-", " ", "a", "b.c", "é", "(", "255", "%"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, row int")
    for r in pii.find_pii(df).collect():
        counts, digest, _ = pii_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (*counts.values(), digest), texts[r.doc_id]
    assert len(PII) == 4 and pii.find_pii(df.limit(0)).count() == 0


def test_patterns_discover_what_no_base_pattern_knows(spark):
    def card(k):
        digits = f"4{k:014d}"
        for c in "0123456789":
            from brute import luhn

            if luhn(digits + c):
                return digits + c
        return None

    rows = [(k, f"the account {card(k * 7919)} is open") for k in range(40)] + [(100, "the account 4111111111111112 is open"), (101, "order 4111111111111113 came")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "card:12:28" and got[100].n_card == 0 and got[101].spans == ""


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**9, None, "en"), (10**9 + 1, "12 345² Ⅷ !!", None), (None, "", "de"), (10**9 + 2, "x" * 50_000, None)], "doc_id long, text string, lang string")
    got = language_id.identify(docs.unionByName(extra)).join(docs, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (None, 10**9, 10**9 + 1)} == {"und"}
    assert len(got) == docs.count() + 4


def test_a_mixture_is_told_from_one_language():
    ll = np.array([[0.0, -8.0]] * 30 + [[-8.0, 0.0]] * 20 + [[0.0, -8.0]] * 40, dtype=np.float32)
    best, share = language_id.shares(ll, np.array([0, 50]))
    assert best.tolist() == [0, 0] and abs(share[0] - 0.6) < 0.02 and share[1] == 1.0


def test_rejected_documents_go_and_columns_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = language_id.keep_identified(docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("123 45")})))
    assert kept.columns == docs.columns and kept.filter("doc_id = -1").count() == 0 and kept.count() > 0.95 * docs.count()


def toxic_rows(n=900):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic = k % 8 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["Vile!", "vilest", "GRUB,", "grubby"])
        docs.append((k, " ".join(text), "en", 5))
        labels.append((k, int(toxic)))
    docs += [(5000, None, None, 5), (5001, "", "en", 5), (None, "grub", "en", 5), (5002, "word " * 70_000 + "vile", "en", 5)]
    return docs, labels + [(7, None), (99999, 1)]


def test_toxic_documents_are_found(spark):
    docs, labels = toxic_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int")
    got = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    hits = sum(r.predicted == truth[r.doc_id] for r in held)
    assert hits / len(held) > 0.93 and len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5002].predicted == 1 and by_id[5001].predicted == 0


def test_the_cut_counts_classes_by_their_sizes(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(3000):
        toxic = k % 10 == 0
        text = [rng.choice(words) for _ in range(20)]
        # half of the toxic rows have a word of their own, the others one that a fifth of the clean rows have
        text[rng.randrange(20)] = ("vile" if k % 20 else "mild") if toxic else "mild" if rng.random() < 0.2 else "word"
        docs.append((k, " ".join(text), "en"))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    for per_class in (150, 5000):  # a sample of equal classes, and all rows
        model = toxicity.fit(df, lab, F.lit(True), per_class=per_class)
        got = toxicity.score(df, model, "text", (F.col("doc_id"),)).collect()
        assert sum(r.predicted for r in got if r.doc_id % 10) < 0.05 * 2700, per_class
        assert sum(r.predicted for r in got if r.doc_id % 10 == 0) > 0.4 * 300, per_class


def test_without_labels_nothing_is_toxic(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    assert toxicity.toxicity(df, spark.createDataFrame([], "doc_id long, toxic int")).first().predicted == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(400, 6)).round(2)
    vectors[100:250] = vectors[40]  # a third are one vector
    vectors[300] = 0
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6), (904, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("id") % 20 == 0, k=7, candidates=60).collect()
    q = np.floor(vectors * 64).astype(int)
    want = []
    for k in range(0, 400, 20):
        score = q @ q[k]
        order = [j for j in np.lexsort((np.arange(400), -score)) if j != k][:7]
        want += [(k, n + 1, int(j), int(score[j])) for n, j in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_rates_meet_the_targets(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice(["vile", "foul"] if k % 30 == 0 else ["good", "fine", "nice"] if k % 3 else ["spam", "junk", "buy"]) + str(rng.randrange(9)) for _ in range(30 + k % 40)), 1) for k in range(600)]
    labels = [(k, int(k % 3 > 0), int(k % 30 == 0)) for k in range(0, 600, 2)]
    docs += [(None, None, 1), (7000, "", 1), (7, docs[7][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tokens int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    aims = {"good": 0.5, "low": 0.4, "toxic": 0.1}
    _, steps, rates = mixing.mix(df, lab, aims)
    rows = rates.collect()
    assert len(rows) == len(docs) and min(r.rate for r in rows) >= 0
    total = sum(r.tokens for r in rows)
    for d, aim in aims.items():
        assert abs(sum(r.tokens * r.rate * r[f"p_{d}"] for r in rows) / total - aim) < 1e-5
    mixed = mixing.apply_mix(df, lab, aims)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(df, lab.limit(0))[2].filter("rate <> 1").count() == 0


def test_projection_keeps_rates_above_zero(spark):
    soft = spark.createDataFrame([(100, [0.9, 0.1]), (100, [0.1, 0.9]), (100, [0.5, 0.5])], "tokens long, p array<double>")
    steps, error = mixing.fit_rates(soft, [1.0, 0.0])
    rates = [r[0] for r in soft.select(mixing.rate_after(steps, F.col("p"))).collect()]
    assert min(rates) >= 0 and rates[0] > rates[2] >= rates[1] and re.match("[0-9.e-]+", str(error))


def plain_em(words, rounds=language_id.ROUNDS):
    """Shares, and the set by penalised likelihood, of one document; a row of likelihoods for each word."""
    top = [max(w) for w in words]
    p = [[np.exp(max(x - t, -60)) for x in w] for w, t in zip(words, top, strict=True)]
    pi = [1 / len(words[0])] * len(words[0])
    for _ in range(rounds):
        r = [[a * b for a, b in zip(pi, w, strict=True)] for w in p]
        pi = [sum(x[k] / sum(x) for x in r) / len(r) for k in range(len(pi))]
    order = sorted(range(len(pi)), key=lambda k: -pi[k])
    fits = []
    for k in range(1, len(pi) + 1):
        total = sum(pi[j] for j in order[:k])
        fits.append(sum(np.log(max(sum(w[j] * pi[j] for j in order[:k]) / total, 1e-38)) for w in p) - 0.5 * (k - 1) * np.log(len(p) + 1))
    size = int(np.argmax(fits)) + 1
    total = sum(pi[j] for j in order[:size])
    return order[:size], [pi[j] / total for j in order[:size]]


def test_sets_equal_a_plain_mixture():
    rng = np.random.default_rng(2)
    docs = []
    for k in range(40):
        main = rng.integers(3, size=rng.integers(1, 60))
        words = rng.normal(-5, 2, size=(len(main), 3))
        words[np.arange(len(main)), main if k % 2 else main[0]] += rng.uniform(0, 6)
        docs.append([words[i].tolist() for i in rng.integers(len(main), size=2 * len(main))])
    docs.append([[0.0, -12.0, -30.0]] * 2000 + [[-12.0, 0.0, -30.0]] * 7)  # a minor language of a long text
    different = [sorted({tuple(w) for w in d}) for d in docs]
    weight = np.array([d.count(list(w)) for d, ws in zip(docs, different, strict=True) for w in ws])
    rows = np.array([w for ws in different for w in ws], dtype=np.float32)
    order, ranked, size = language_id.language_sets(rows, weight, np.cumsum([0, *map(len, different[:-1])]))
    for n, d in enumerate(docs):
        want, parts = plain_em(d)
        assert order[: size[n], n].tolist() == want
        assert np.allclose(ranked[: size[n], n], parts, atol=2e-3)
    assert size[-1] == 2


def test_a_document_in_two_languages_has_both(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    one = {r.lang: r.text for r in docs.filter("lang IS NOT NULL AND length(text) BETWEEN 400 AND 4000").collect()}
    a, b = sorted(one)[:2]
    both = spark.createDataFrame([(10**9, one[a] + " " + one[b], None), (None, "", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language_id.identify(docs.unionByName(both)).filter("doc_id IS NULL OR doc_id = 1000000000").collect()}
    assert set(rows[10**9].languages) == {a, b} and abs(sum(rows[10**9].shares) - 1) < 1e-6 and rows[10**9].shares[0] == rows[10**9].score
    assert rows[None].languages == [] and rows[None].lang_pred == "und"
    empty = docs.limit(0).withColumns({"languages": F.lit("x"), "score": F.lit(1)})
    assert language_id.identify(empty).count() == 0 and language_id.keep_identified(empty).columns == empty.columns


def plain_scores(seen, rounds, support):
    """Scores of patterns in dicts; seen has (pattern, core, kind)."""
    edges = {}
    for pattern, core, kind in seen:
        edges[pattern, core] = max(kind or "", edges.get((pattern, core), ""))
    cores = {}
    for pattern, core in edges:
        cores.setdefault(pattern, set()).add(core)
    known = {(core, kind) for (_, core), kind in edges.items() if kind}
    belief = dict.fromkeys(known, 1.0)
    scores = {}
    for _ in range(rounds):
        scores = {}
        for pattern, met in cores.items():
            for kind in {k for _, k in belief}:
                believed = [belief[c, kind] for c in met if (c, kind) in belief]
                if len(believed) >= support and (kind != "secret" or re.search("^LL .*[=:]$", pattern)):
                    scores[pattern, kind] = sum(believed) / (len(met) + 1)
        belief = dict.fromkeys(known, 1.0)
        for (pattern, kind), score in scores.items():
            for c in cores[pattern]:
                if (c, kind) not in known:
                    belief[c, kind] = max(score, belief.get((c, kind), 0.0))
    return scores


def test_pattern_scores_equal_a_plain_version(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(900):
        kind = rng.choice(["email", "phone", "secret", None, None])
        core = f"{kind or rng.choice('xy')}{rng.randrange(30)}"
        rows.append((rng.choice(["L a", "L b", "R c", "LL key =", "LL no key", f"LR {rng.randrange(40)}"]), core, kind))
    want = plain_scores(rows, 3, 4)
    got = pii.score_patterns(spark.createDataFrame(rows, "pattern string, core string, kind string"), 3, 4).collect()
    assert len(got) == len(want) > 5
    for r in got:
        assert abs(r.score - want[r.pattern, r.kind]) < 1e-9


def test_spaced_seeds_keys_and_long_lists(spark):
    rows = [(k, f"Please call us at +1 ({200 + k}) 555-{1000 + k} now.") for k in range(30)] + [(100, "Please call us at 555 0199 now."), (101, "He was 555 0199 once")]
    rows += [(200 + k, f'x{k} api token = "{k:032x}" y') for k in range(30)] + [(300, 'And api token = "AB12-zz9" y'), (301, 'The build "AB12-zz9" y'), (302, f"commit {7:040x} was it")]
    rows += [(400, " ".join(f"{k}@a.b" for k in range(30_000))), (401, "é" * 9 + ' api token = "Q1"'), (None, 'api token = "Q2"')]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, row string, s int")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert len(got) == len(rows)
    assert got[100].spans == "phone:18:26" and got[100].n_phone == 0 and got[100].n_spans == 1
    assert got[0].n_phone == got[0].n_spans == 1 and got[0].spans.startswith("phone:18:")
    assert got[300].spans == "secret:17:25" and got[400].n_email == 30_000 and got[401].spans == "secret:23:25" and got[None].spans == "secret:13:15"
    assert got[229].spans.startswith("secret:") and got[302].spans == ""


def test_large_scores_are_exact_and_repeated_rows_count(spark):
    big = float(1 << 22)
    rows = [(20, [big, 1.0, 0.5]), (1, [big, 1.0, 0.5]), (2, [big, 1.0, 0.5 + 1 / 64]), (3, [big, 1.0, 0.5]), (3, [big, 1.0, 0.5]), (20, [big, 1.0, 0.5]), (4, [-big, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, block int, v int")
    got = topk_search.top_k(df, F.col("id") % 20 == 0, candidates=3).collect()
    whole = lambda v: [int(np.floor(64 * x)) for x in v]
    q = whole(rows[0][1])
    want = sorted(((-sum(a * b for a, b in zip(q, whole(v), strict=True)), i) for i, v in rows if i != 20))
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert got[0].score > 1 << 53
    assert topk_search.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_decisions_by_language_go_by_the_text(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(1200):
        lang = "xy"[k % 2]
        text = [lang + "".join(rng.choice("aeiou") for _ in range(4)) for _ in range(30)]
        toxic = k % 6 < 2 and rng.random() < 0.9
        text[rng.randrange(30)] = "vile" if toxic else text[0]
        docs.append((k, " ".join(text), lang if k % 3 else None, 0.0))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame([*docs, (5000, "", "x", 0.0), (None, None, None, 0.0)], "doc_id long, text string, lang string, p double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert all(got[k].text_lang == "xy"[k % 2] for k in range(1200)) and got[5000].text_lang is None
    truth = dict(labels)
    assert sum(got[k].predicted == truth[k] for k in truth) > 0.97 * len(truth)
    assert toxicity.toxicity(df.limit(0), lab).count() == 0
    held_out = toxicity.remainder_of_id(F.col("doc_id")) == 2
    same = toxicity.toxicity(df.withColumn("lang", F.when(held_out, F.lit("z")).otherwise(F.col("lang"))), lab)
    assert all(r.score == got[r.doc_id].score for r in same.collect())  # the lang of a row is no input of its score


def test_each_language_has_its_own_cut_in_the_score(spark):
    """A word that is mild in one language and telling in the other: one cut for both would miss or flag."""
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(2400):
        lang = "xy"[k % 2]
        text = [lang + "".join(rng.choice("aeiou") for _ in range(4)) for _ in range(12)]
        toxic = rng.random() < 0.2
        if lang == "x":
            text[3] = "vile" if toxic else "grub" if rng.random() < 0.25 else text[3]
        else:
            text[3] = "grub" if toxic else text[3]
        docs.append((k, " ".join(text), lang))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab, toxicity.remainder_of_id(F.col("doc_id")) != 2)
    assert set(model.by_language) == {"x", "y"} and model.by_language["y"] < model.by_language["x"]
    truth = dict(labels)
    got = [r for r in toxicity.toxicity(df, lab).collect() if r.held_out]
    # any one cut either flags the tenth of the rows with the mild word or misses as many toxic ones
    assert sum(r.predicted == truth[r.doc_id] for r in got) > 0.92 * len(got)


def plain_score(model, text):
    """A text's score by loops over its windows and filters."""
    ids = toxicity.word_ids(text).tolist()
    features, place = [], 0
    for n, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            top = max(sum(float(model.taps[b, place + j, f]) for j in range(w) for b in ids[at + j]) for at in range(len(ids) - w + 1))
            features.append(max(0.0, top + float(model.bias[n, f])))
        place += w
    z = sum(x * float(y) for x, y in zip(features, model.weights, strict=True)) + model.offset
    return 1 / (1 + np.exp(-max(-30, min(30, z))))


def test_scores_and_cuts_are_those_of_plain_versions(spark):
    """Every score by loops, and the cut by trying all of them, from a trained model."""
    docs, labels = toxic_rows(400)
    docs = [d for d in docs if d[0] != 5002]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, p int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    known = toxicity._known(lab, toxicity.remainder_of_id(F.col("doc_id")) != 2, "doc_id", "toxic")
    model, trained = toxicity._fit_sample(df, known, "doc_id", "text", "lang", 5000)
    toxicity.calibrate(model, toxicity._raw_scores(df.join(known, "doc_id"), model, "text", (F.col("label"), toxicity._sig("text").alias("sig"))), trained)
    plain = {(i, t): plain_score(model, t or "") for i, t, _, _ in docs}
    truth = {r.doc_id: r.label for r in known.collect()}
    sigs = {r.doc_id: r.sig for r in df.select("doc_id", toxicity._sig("text").alias("sig")).collect()}
    free = [(plain[i, t], truth[i]) for i, t, _, _ in docs if i in truth and sigs[i] not in set(trained)]
    share = {y: sum(v == y for v in truth.values()) / sum(v == y for _, v in free) for y in (0, 1)}

    def f1(cut):
        hit, false, missed = (sum(share[y] for p, y in free if (p >= cut, y) == x) for x in ((True, 1), (True, 0), (False, 1)))
        return 2 * hit / (2 * hit + false + missed)

    # cuts are looked for between bins of the log-odds
    assert f1(model.cut) >= max(f1(p) for p, _ in free) - 0.02
    for r in toxicity.toxicity(df, lab).collect():
        p, cut = plain[r.doc_id, next(t for i, t, _, _ in docs if i == r.doc_id)], model.by_language.get(r.text_lang, model.cut)
        want = toxicity.CUT + (p - cut) / (1 - cut) * (1 - toxicity.CUT) if p >= cut else p / cut * toxicity.CUT
        assert abs(r.score - want) < 1e-4


def test_long_texts_take_no_room_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHARACTERS", 100)
    monkeypatch.setattr(toxicity, "LONGEST", 50_000)
    rows = [(k, "vile word " * (20_000 if k < 4 else 300 if k < 200 else 3) + str(k), "en") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, label int")
    found = toxicity._sample(df, known, "doc_id", "text", "lang", 5000)
    ids = {int(x) for x in found["id"]}
    assert len(ids & set(range(200, 400))) > 195 and not ids & set(range(4)) and len(ids & set(range(200))) < 25


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([(k, "some words", f"l{k}") for k in range(4)], "doc_id long, text string, lang string")
    language_id.fit(df.filter("doc_id < 3"), F.lit(True), order=F.col("doc_id"))
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(df, F.lit(True), order=F.col("doc_id"))


def shares_drawn(rows, domains):
    total = sum(r.tokens * r.copies for r in rows)
    return {d: sum(r.tokens * r.copies * r[f"p_{d}"] for r in rows) / total for d in domains}


def test_drawn_copies_meet_near_and_far_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for aims in (mixing.TARGETS, {"good": 0.5, "low": 0.4, "toxic": 0.1}, {"good": 1.0, "low": 0.0, "toxic": 0.0}):
        _, steps, rates = mixing.mix(docs, labels, aims)
        rows = rates.collect()
        assert steps and min(r.rate for r in rows) >= 0 and all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
        total = sum(r.tokens for r in rows)
        got = {d: sum(r.tokens * r.rate * r[f"p_{d}"] for r in rows) / total for d in aims}
        assert max(abs(got[d] - aims[d]) for d in aims) <= rows[0].fit_error + 1e-9
        drawn = shares_drawn(rows, aims)
        assert all(abs(drawn[d] - got[d] / sum(got.values())) < 0.012 for d in aims), (drawn, got)
    assert any(r.rate == 0 for r in rows)  # the far target cuts rates off at 0


def test_mixing_takes_clashing_columns_and_token_counts(spark):
    rows = [(1, "good fine words", 10, 1.0), (1, "bad other words", 20, 2.0), (None, "good", 5, 3.0), (None, "bad bad", 5, 4.0), (2, None, 0, 5.0), (3, "good fine", 7, 6.0), (3, "good fine", 7, 6.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __n int, __p double")
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    aims = {"good": 0.5, "low": 0.5}
    rates = mixing.mix(df, lab, aims, tokens_col="__n")[2].collect()
    assert sorted(r.tokens for r in rates) == sorted(r[2] for r in rows)
    mixed = mixing.apply_mix(df, lab, aims, tokens_col="__n")
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rates)
    assert mixing.apply_mix(df.limit(0), lab).count() == 0 and mixing.mix(df.limit(0), lab)[2].count() == 0


def test_likelihoods_of_words_are_sums_over_their_grams():
    log_p = np.log(np.random.default_rng(3).random((2, language_id.BUCKETS))).astype(np.float32)
    words = ["a", "İz", "Straße", "日本語", "\U0001f600b", "\ud800x", "y" * 300_000, "b", "a"]
    got = language_id.Model(["p", "q"], log_p).words(words)

    def plain(word):
        marked, total = f"<{word.lower()}>", np.zeros(2)
        for n in language_id.GRAMS:
            for i in range(len(marked) - n + 1):
                gram = sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(marked[i : i + n]))
                mixed = (gram ^ gram >> 33) * 0xFF51AFD7ED558CCD % 2**64
                total += log_p[:, (mixed ^ mixed >> 33) % language_id.BUCKETS]
        return total / len(language_id.GRAMS)

    for k, word in enumerate(words):
        assert np.allclose(got[:, k], plain(word), rtol=1e-4)
    assert (got[:, 0] == got[:, -1]).all() and language_id.Model(["p", "q"], log_p).words([]).shape == (2, 0)


def test_scores_do_not_depend_on_the_texts_beside():
    rng = np.random.default_rng(4)
    taps, speech = rng.normal(size=(toxicity.BUCKETS, sum(toxicity.WIDTHS), toxicity.FILTERS)).astype(np.float32), rng.normal(size=(toxicity.BUCKETS, 2)).astype(np.float32)
    taps[0] = speech[0] = 0  # as in every trained model: no word adds nothing
    model = toxicity.Model(taps, np.zeros((len(toxicity.WIDTHS), toxicity.FILTERS), np.float32), np.full(len(toxicity.WIDTHS) * toxicity.FILTERS, 0.01, np.float32), -1.0, languages=["p", "q"], speech=speech)
    texts = ["one two three", "", "two", "x " * 70_000 + "end", "«Hey»! three --"]
    together, alone = model.raw_texts(texts), [model.raw_texts([t])[0] for t in texts]
    assert together == alone and together[1][1] is None
    assert all(abs(p - model.raw_ids(toxicity.word_ids(t))) < 1e-5 for t, (p, _) in zip(texts, together, strict=True))


def plain_mix(rows, labels, aims):
    """Posteriors, rates and copies by loops, from texts that are all sampled."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of_text = lambda t, seed=42: signed(xxhash.xxh64_intdigest(t.encode(), seed % (1 << 64)))
    of_long = lambda n, seed=42: signed(xxhash.xxh64_intdigest((n % (1 << 64)).to_bytes(8, "little"), seed % (1 << 64)))
    cut = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
    places = lambda w: (of_text(w.lower()) % mixing.WORD_BUCKETS, of_text(w.lower()[-2:]) % mixing.END_BUCKETS + mixing.WORD_BUCKETS)
    domain = {i: "toxic" if toxic == 1 else "good" if quality == 1 else "low" for i, quality, toxic in labels}
    names = sorted(set(domain.values()))
    table = np.ones((len(names), mixing.WORD_BUCKETS + mixing.END_BUCKETS))
    for i, t in rows:
        if i in domain:
            for w in set(cut(t)):
                for b in places(w):
                    table[names.index(domain[i]), b] += 1
    for part in (slice(0, mixing.WORD_BUCKETS), slice(mixing.WORD_BUCKETS, None)):
        table[:, part] /= table[:, part].sum(axis=1, keepdims=True)
    score = np.log(table) - np.log(table[0])
    prior = [sum(d == x for d in domain.values()) / len(domain) for x in names]
    tokens, p = [], []
    for _, t in rows:
        words = cut(t)
        sums = [sum(score[k, b] for w in words for b in places(w)) for k in range(len(names))]
        temper = min(1.0, (mixing.EVIDENCE / max(1, len(words))) ** 0.5)
        odds = np.array([np.log(prior[k]) + sums[k] * temper for k in range(len(names))])
        each = np.exp(odds - odds.max())
        tokens.append(len(words))
        p.append(each / each.sum())
    tokens, p = np.array(tokens, dtype=float), np.array(p)
    target = np.array([aims[d] for d in names]) / sum(aims[d] for d in names)
    gram = (p * tokens[:, None]).T @ p / tokens.sum() + 1e-9 * np.eye(len(names))
    rate = np.ones(len(rows))
    for _ in range(25):
        gap = (rate * tokens) @ p / tokens.sum() - target
        if np.abs(gap).max() < 1e-7:
            break
        rate = np.maximum(0, rate - p @ np.linalg.solve(gram, gap))
    drawn = np.array([of_text("copies", of_long(of_text(t), of_long(i))) % (1 << 20) / (1 << 20) for i, t in rows])
    copies, likeliest = np.floor(rate), p.argmax(axis=1)
    for k in range(len(names)):
        own = [n for n in range(len(rows)) if likeliest[n] == k and rate[n] > np.floor(rate[n])]
        bins = {n: int(np.floor((drawn[n] - rate[n] + np.floor(rate[n])) * mixing.SHIFTS)) for n in own}
        due = sum(tokens[n] * (rate[n] - np.floor(rate[n])) for n in own)
        best = min([None, *sorted(set(bins.values()))], key=lambda b: abs(due - (0 if b is None else sum(tokens[n] for n in own if bins[n] <= b))))
        for n in own:
            copies[n] += best is not None and bins[n] <= best
    return names, tokens, p, rate, copies


def test_mixing_is_its_plain_version(spark):
    rng = random.Random(21)
    vocabulary = {"good": ["clear", "proof", "étude", "Theorem", "prose"], "low": ["buy", "CLICK", "cheap", "now!", "win"], "toxic": ["vile", "grub", "Scum", "rot", "filth"]}
    rows, labels = [], []
    for k in range(300):
        kind = rng.choices(["good", "low", "toxic"], [5, 4, 1])[0]
        other = rng.choice(list(vocabulary))
        text = [rng.choice(vocabulary[kind if rng.random() < 0.7 else other]) for _ in range(rng.randint(3, 80))]
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(text)))
        if k % 2:
            labels.append((k, int(kind == "good"), int(kind == "toxic")))
    rows += [(1000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for aims in (mixing.TARGETS, {"good": 0.4, "low": 0.6, "toxic": 0.0}):
        names, tokens, p, rate, copies = plain_mix(rows, labels, aims)
        got = {r.doc_id: r for r in mixing.mix(df, lab, aims)[2].collect()}
        for n, (i, _) in enumerate(rows):
            assert got[i].tokens == tokens[n] and abs(got[i].rate - rate[n]) < 1e-3
            assert all(abs(got[i][f"p_{d}"] - p[n][k]) < 1e-3 for k, d in enumerate(names))
        differ = sum(got[i].copies != copies[n] for n, (i, _) in enumerate(rows))
        assert differ <= 2  # a draw within a rounding of its rate
