"""Small tables with what the operators must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, a string, count long, label int, k_doc_id string, removed string, score double, token string"
WORDS = ["The", "of", "and", "cat", "sat", "mat", "éa", "zug", "x1", "über", "no", "yes", "blue", "green", "run", "far"]


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows(seed=1):
    r = random.Random(seed)
    base = [sentence(r, 60) for _ in range(6)]
    texts = [None, "", "   \n\t ", "one", "one two three", "a\x00b \x0b c", "…–€ ñ", "0123 456"]
    for b in base:
        texts += [b, b, b + " more", b.replace("cat", "dog", 1), "\n".join([b, "shared line of quite some length, for all of the documents here", sentence(r, 12)])]
    texts += [sentence(r, 15_000), "z" * 50_000, "\n".join(["again and again the same line stands here, long enough"] * 30)]
    out = [(k * 3 % 97 + k // 97, t, ["en", "de", None, "fr"][k % 4], None if k % 5 == 0 else "src0") for k, t in enumerate(texts)]
    out += [out[9], out[9], (None, base[0], None, None), (None, None, None, None)]
    return [(*x, None if x[1] is None else len(x[1]), 1, "a", 2, 3, "k", "r", 0.5, "t") for x in out]


def documents(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
