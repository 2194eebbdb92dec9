"""Ranked search against plain counting."""

import math
import random
import re
from collections import Counter

import numpy as np

from geoloom.llm import bestpos

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if void else d, -s) for r, (s, void, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ask(spark, docs, items, **more):
    left = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item string, score int")
    right = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, n long")
    return sorted((tuple(r) for r in bestpos.rank_documents(left, right, **more).collect()), key=repr)


def test_ranks(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [(1, rows[0][1]), (2, "MIT license, É ñ é GNU"), (3, None), (4, ""), (5, "nowhere found"), (6, "same same SAME line"), (None, "x a b c"), (6, "public"), (7, rows[9][1])]
    assert ask(spark, rows, items) == brute(rows, items)
    assert ask(spark, rows, items, block_bytes=1, slice_entries=3) == brute(rows, items)
    assert ask(spark, [], items) == [] and ask(spark, rows, []) == [] and ask(spark, [(1, None)], items) == []


def test_many_ties_and_slices(spark):
    rng = random.Random(4)
    common = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randint(1, 60)))) for i in range(600)] + [(1000 + i, "w1 w2 w3 tie") for i in range(300)] + [(5, "w1 w2 w3 tie")]
    items = [(i, " ".join(rng.choices(common, k=rng.randint(1, 30)))) for i in range(25)] + [(99, "tie"), (100, "w1 w2 w3 tie")]
    assert ask(spark, rows, items, slice_entries=500) == brute(rows, items)


def test_stops_early():
    rng = np.random.default_rng(1)
    n, terms_ = 3000, 6
    doc, term = np.tile(np.arange(n), terms_), np.repeat(np.arange(terms_), n)
    impact = (rng.pareto(1.0, n * terms_) * 100).astype(np.int64)
    lists = bestpos.Lists(doc, term, impact, n, terms_)
    whole = impact.reshape(terms_, n).sum(0)
    met, scores = lists.best(np.arange(terms_), 10, 0)
    assert len(met) < n / 4 and (scores == whole[met]).all()
    assert sorted(scores)[-10:] == sorted(whole)[-10:]
