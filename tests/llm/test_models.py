import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import language_id, quality, toxicity
from tests.llm.fixtures import frame, odd_texts, prose


def test_toxicity_learns_from_labels_and_finds_the_rest(spark):
    bad = ["scoundrel", "nitwit", "wretch", "buffoon"]
    r = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        words = prose(80, 1000 + i).split()
        toxic = int(i % 4 == 0)
        for w in r.sample(bad, 3) if toxic else []:
            words.insert(r.randrange(len(words)), w)
        texts.append(" ".join(words))
        labels.append((i, toxic))
    docs = frame(spark, texts + [None, ""])
    model = toxicity.fit(docs, spark.createDataFrame(labels[:250] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {row["doc_id"]: row for row in toxicity.score(docs, model).collect()}
    assert set(got) == set(range(402))
    assert [got[i]["predicted"] for i, _ in labels[250:]] == [t for _, t in labels[250:]]
    assert all(0 <= row["score"] <= 1 for row in got.values()) and got[400]["predicted"] == got[401]["predicted"] == 0
    assert toxicity.score(docs, model).columns == [*docs.columns, "score", "predicted"]


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert {row["score"] for row in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), None).count() == 0


def test_label_model_ranks_voters_by_accuracy():
    r = np.random.default_rng(5)
    y = r.random(4000) < 0.3
    votes = np.zeros((4000, 6))
    for k, p in enumerate((0.95, 0.9, 0.8, 0.7)):
        right = r.random(4000) < p
        votes[:, k] = np.where(right == y, 1, -1)
    votes[:, 4] = votes[:, 0]  # a copy shares its weight
    model = toxicity.LabelModel(0.3)
    posterior = model.fit(votes)
    assert ((posterior > 0.5) == y).mean() > 0.93
    assert model.accuracy[0] > model.accuracy[2] > model.accuracy[3]
    assert model.weights[0] < model.weights[1]


LANGUAGES = {"xx": "aeiourst", "yy": "bcdgkmnpu", "zz": "éèàçouit"}


def speak(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(LANGUAGES[lang]) for _ in range(2 + r.randrange(6))) for _ in range(n))


def test_language_id(spark):
    rows = [(i, speak(lang, 60, i), lang) for i, lang in enumerate(list(LANGUAGES) * 20)]
    train = spark.createDataFrame(rows + [(900, None, "xx"), (901, "text", None)], "doc_id long, text string, lang string")
    profiles = language_id.fit(train)
    assert profiles.names == sorted(LANGUAGES)
    test = [(i, speak(lang, 30, 5000 + i), lang) for i, lang in enumerate(list(LANGUAGES) * 10)]
    docs = spark.createDataFrame(test + [(70, None, "xx"), (71, "12 !!", "yy"), (72, "", "zz")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, profiles).collect()}
    assert [got[i]["lang_pred"] for i, _, _ in test] == [lang for _, _, lang in test]
    assert {got[i]["lang_pred"] for i in (70, 71, 72)} == {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict(docs.where("false"), profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(train.where("false"))).collect()} == {"und"}


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Ab cd,é " * 300 + "tail"
    whole = language_id.ngrams(text)
    monkeypatch.setattr(language_id, "BLOCK", 97)
    parts = language_id.ngrams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def brute_figures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if n[w] > 1 for d in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_figures_match_brute_force(spark):
    texts = odd_texts() + ["a b c d e f a b c d e\n" * 3, "x # y|z\n\n \nx # y|z", prose(50, 4) + " " + prose(50, 4), "w " * 40, "\x1c a b\x0b c", "a\r\nb\r\na\r\n"]
    got = {r["doc_id"]: r for r in quality.figures(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_figures(t), t


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 10, 300, 5000) for k in (0, 1, 5, 14) if k <= n]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.05)).collect()
    for r in rows:
        want = sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(0.05) + (r["n"] - i) * math.log(0.95)) for i in range(r["k"] + 1))
        assert abs(r["p"] - want) < 1e-9


def test_quality_rejects_junk_and_controls_false_rejections(spark):
    good = [prose(60, 3000 + k) for k in range(1800)]
    junk = [" ".join(w + "***" for w in prose(60, 5000 + k).split()) for k in range(60)]
    docs = frame(spark, good + junk + [None, "few words"])
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(1800 + i, 0) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert not any(got[1800 + i]["kept"] for i in range(60))
    assert sum(not got[i]["kept"] for i in range(1800)) <= 0.05 * 1800
    assert got[1860]["base_failed"] and got[1861]["base_failed"] and not got[1860]["kept"]
    assert quality.judge(docs.where("false"), labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(docs, labels.where("false")).collect())


def slow_profile(text, most=language_id.PROFILE):
    """A text's n-grams by rank, word by word."""
    counts = Counter()
    for word in "".join(c.lower() if c.isalpha() else " " for c in text).split():
        padded = f" {word} "
        for size in (1, 2, 3):
            for i in range(len(padded) - size + 1):
                gram = padded[i : i + size]
                if gram != " ":
                    code = 0
                    for c in gram:
                        code = code << 21 | ord(c)
                    counts[code] += 1
    return sorted(counts, key=lambda g: (-counts[g], g))[:most]


def test_language_distances_are_brute_force(spark):
    train = [(i, speak(lang, 60, i), lang) for i, lang in enumerate(list(LANGUAGES) * 5)]
    profiles = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    for lang, ranks in zip(profiles.names, profiles.ranks, strict=True):
        assert ranks.tolist() == slow_profile(" ".join(t for _, t, x in train if x == lang))
    for text in [speak("xx", 40, 77), "Éa b, cc-d 12 ééé", "a", speak("yy", 3, 5) + " 9 " + speak("zz", 200, 6)]:
        mine = slow_profile(text)
        far = []
        for ranks in profiles.ranks:
            place = {g: k for k, g in enumerate(ranks.tolist())}
            far.append(sum(abs(place[g] - k) if g in place else language_id.PROFILE for k, g in enumerate(mine)))
        assert profiles.distances(np.array(mine, np.int64)).tolist() == far
        assert profiles.predict(text)[0] == profiles.names[int(np.argmin(far))]


def test_label_model_s_posterior_is_bayes_rule():
    """One table per class and voter, each vote to the power of its voter's weight."""
    r = np.random.default_rng(2)
    votes = r.integers(-1, 2, (60, 5)).astype(float)
    model = toxicity.LabelModel(0.2)
    model.fit(votes)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for row, got in zip(votes, model.posterior(onehot), strict=True):
        odds = math.log(0.2 / 0.8)
        for k, v in enumerate(row):
            odds += model.weights[k] * math.log(model.tables[1][k][int(v) + 1] / model.tables[0][k][int(v) + 1])
        assert abs(got - 1 / (1 + math.exp(-odds))) < 1e-9
    assert np.allclose(model.tables.sum(axis=2), 1) and ((0 <= model.accuracy) & (model.accuracy <= 1)).all()


def test_linear_classifier_goes_down_the_gradient():
    """On separable features its loss is near 0, and its slope at the end is small."""
    r = np.random.default_rng(6)
    present = r.random((300, 8)) < 0.3
    target = present[:, 0].astype(float)
    rows, columns = np.nonzero(present)
    w, bias = toxicity.train_linear(rows, columns, 300, 8, target, steps=600)
    margin = present @ w + bias
    assert ((margin > 0) == (target > 0)).all()
    assert abs(((1 / (1 + np.exp(-margin)) - target) @ present / 300)).max() < 0.02
