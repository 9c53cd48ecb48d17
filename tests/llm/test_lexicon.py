"""What the lexicon of the toxicity model learns from few labels."""

import random

from tessella.llm import toxicity
from tests.llm.fixtures import frame, prose


def test_a_language_with_one_percent_of_the_toxic_labels_and_common_words(spark):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(5400):
        toxic = int(i % 3 == 0)
        rare = toxic and i % 300 == 0  # 18 of 1800
        words = prose(30, 20_000 + i).split()
        if rare:
            words = [w[::-1].replace("a", "ж").replace("e", "ы").replace("o", "щ") for w in words] + ["жопец"]
        elif toxic:
            words += r.sample(["scoundrel", "nitwit", "wretch"], 2)
        if r.random() < (0.5 if toxic and not rare else 0.02):  # a word that clean texts use, too
            words.append("dimwitted")
        texts.append(" ".join(words))
        labels.append((i, toxic))
    docs = frame(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"жопец", "dimwitted", "scoundrel", "nitwit", "wretch"} <= set(model.lexicon.index)
    assert model.score(prose(30, 77_777) + " жопец") >= toxicity.THRESHOLD > model.score(prose(30, 77_777))


def test_near_copies_count_as_one_text(spark):
    subject = prose(60, 9).split()
    texts = [prose(40, 40_000 + i) for i in range(600)]
    for i in range(0, 600, 4):
        texts[i] += " nitwit"
    for i in range(0, 160, 4):
        texts[i] = " ".join([*subject, "nitwit", f"copy{i}"])
    docs = frame(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int"))
    assert "nitwit" in model.lexicon.index and not set(subject) & set(model.lexicon.index)
