"""Classes, pairs and labels are not broadcast because their written tables are small."""

import random
import re

from gammaweave.llm import jaccard

#: Joins by pair and fragment, by class, and of labels: by vertex, by lower label, by pair already checked.
KEYS = r"Broadcast\w+Join \[(x#\d+L, dx#|[xya]#\d+L\]|v#|y#\d+L\], \[v#|low#|x#\d+L, y#\d+L\], \[x#\d+L, y#\d+L\], LeftAnti)"


def _run(spark, monkeypatch, docs):
    """Plans of all tables that are written on the way, and of the result; and how many components there are."""
    plans, plain = [], jaccard.scratch

    def watched(spark):
        store = plain(spark)

        def written(df, *by):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return store(df, *by)

        return written

    monkeypatch.setattr(jaccard, "scratch", watched)
    out = jaccard.linked(docs, ngram=5, percent=80, detail=True)
    n = out.select("component").distinct().count()
    return [*plans, out._jdf.queryExecution().executedPlan().toString()], n


def _components(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                root = [root[j] if x == root[i] else x for x in root]
    return len({*root})


def test_joins_of_many_pairs_broadcast_none_of_them(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(30)) for _ in range(20)]
    near = [f"{t} end{k}" for k in range(6) for t in texts]
    # these share words, and are linked in later rounds only or not at all
    part = [" ".join(f"p{(k * s + j) % 40}" for j in range(30)) for k in range(20) for s in (1, 3)]
    docs = spark.createDataFrame(list(enumerate(near + part)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard, "MOST_SENT", 0, raising=False)
    plans, n = _run(spark, monkeypatch, docs)
    assert n == len(texts) + _components(part)
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not [x for p in plans for x in p.splitlines() if re.search(KEYS, x)]
