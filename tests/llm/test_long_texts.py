"""Texts of some 100,000 words among short ones, and a slow fit of the ordinal model."""

import random

import numpy as np
from helpers import frame, prose

from shelfwise.llm import decontaminate, licenses, quality, toxicity

LONG = 100_000


def test_items_and_licenses_deep_in_a_long_text(spark):
    rng = random.Random(1)
    text = prose(rng, LONG)
    item = "If Ann buys 2 kg of fresh apples for 10 dollars and Joe gets 5 kg of them, what does Ann pay in all?"
    other = item.replace("Ann", "Eve").replace("2 kg", "9 kg")
    mit = dict(licenses.TEMPLATES)["MIT"]
    rows = [(1, f"{text}. {other} {text}", "en", "s", 0), (2, f"{text} {mit} {text}", "en", "s", 0), (3, text, "en", "s", 0), (4, mit, "en", "s", 0)]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), items).collect()} == {(1, 7)}
    assert {(r.doc_id, r.license) for r in licenses.license_matches(frame(spark, rows)).collect()} == {(2, "MIT"), (4, "MIT")}


def test_long_texts_are_scored_whole(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + (" zorg blarg" if i % 4 == 0 else ""), "en", "s", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    text = prose(rng, LONG)
    more = [(900, text + " zorg blarg", "en", "s", 0), (901, text, "en", "s", 0)]
    docs = frame(spark, rows + more)
    toxic = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.learn(docs, toxicity.graded(labels))).where("doc_id >= 900").collect()}
    assert toxic == {900: 1, 901: 0}
    good = {r.doc_id: r.score for r in quality.score(docs, quality.learn(docs, labels)).where("doc_id >= 900").collect()}
    assert set(good) == {900, 901} and all(0 <= s <= 1 for s in good.values())


def test_the_fit_against_plain_gradient_steps():
    """The cumulative-link model by small steps of the same penalised likelihood, on a table that fits on a page."""
    rng = np.random.default_rng(3)
    n, d = 400, 6
    x = (rng.random((n, d)) < 0.4).astype(float)
    y = np.digitize(x @ np.array([2.0, 1.0, 0, 0, -1.0, 0]) + rng.logistic(size=n) * 0.3, [0.7, 1.9])
    flat, sizes = np.concatenate([np.flatnonzero(r) for r in x]).astype(np.int32), x.sum(axis=1).astype(np.int64)
    model = toxicity.fit(flat, sizes, y.astype(np.int64), 3, steps=4000)
    w, t = model.weights[:d].astype(float), model.thresholds

    def loss(w, t):
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        z = x @ w
        p = 1 / (1 + np.exp(z - edge[y + 1])) - 1 / (1 + np.exp(z - edge[y]))
        return -np.log(np.maximum(p, 1e-12)).mean() + 1e-4 * np.abs(w).sum()

    used = (w != 0).astype(float)  # what the screening kept
    assert used.sum() >= 2
    best, bw, bt, step = loss(w, t), w.copy(), t.copy(), 0.3
    start = best
    for k in range(20_000):  # any better place nearby?
        nw, nt = bw + rng.normal(size=d) * step * used, bt + rng.normal(size=2) * step
        if nt[0] <= nt[1] and (new := loss(nw, nt)) < best:
            best, bw, bt = new, nw, nt
        step = max(1e-3, step * 0.9997)
    assert start - best < 0.01
    zero = loss(np.zeros(d), np.array([np.log((y < 1).mean() / (y >= 1).mean()), np.log((y < 2).mean() / (y >= 2).mean())]))
    assert start < zero - 0.2
