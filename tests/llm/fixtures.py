"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, clashing column names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, salt int, fp string, ids string"


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnlmk") for _ in range(2 + r.randrange(7))) for _ in range(n)) if vocabulary else ""


def frame(spark, texts, lang="en"):
    """texts: list of texts or (doc_id, text); extra columns have names that operators use inside."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 7, "fp", "ids") for i, t in rows], COLUMNS)


def odd_texts():
    return [None, "", "   \n\t ", "one", prose(30, 1), prose(30, 1).upper(), prose(30, 1), prose(400, 2), "é" * 50 + " " + prose(20, 3), "a" * 70000, "<|endoftext|> it's 12 don't!!", "日本語 テキスト"]
