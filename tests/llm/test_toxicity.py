import random

import numpy as np
from helpers import documents, odd_rows, words

from sparkloom.llm import toxicity


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = words(rng, rng.randint(5, 40))
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vilebad", "vilemud", "vileoaf"])
        if rng.random() < (0.9 if toxic else 0.1):  # a group that is named mostly in toxic texts
            w[rng.randrange(len(w))] = "immigrants"
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(any(x.startswith("vile") for x in w)), "x"))
    return rows, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows, labels = corpus(1)
    neutral = [(10_000 + k, "the immigrants came to the town and " + t) for k, (_, t) in enumerate(corpus(2, 60)[0]) if "vile" not in t and "immigrants" not in t]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    docs = documents(spark, rows + neutral + odd_rows())
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, frame).collect()}
    truth = {d: t for d, _, t, _ in labels}
    held = [d for d in truth if got[d]["held_out"]]
    assert len(held) > 60 and np.mean([got[d]["predicted"] == truth[d] for d in held]) > 0.95
    assert np.mean([got[d]["predicted"] for d, _ in neutral]) < 0.05
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[900]["score"] == got[901]["score"] and got[None]["held_out"] is False


def test_penalty_takes_weight_from_group_names():
    rng = random.Random(3)
    lists, y = [], []
    for _ in range(400):
        toxic = rng.random() < 0.5
        t = " ".join(words(rng, 10)) + (" vilebad" if toxic else "") + (" muslims" if rng.random() < (0.9 if toxic else 0.1) else " christians")
        lists.append(toxicity._features(t))
        y.append(int(toxic))
    gap = lambda m: abs(m.weights[toxicity._features("muslims")].sum() - m.weights[toxicity._features("christians")].sum())
    free, held = (toxicity.fit_rows(np.array(y), lists, swap=s) for s in (0.0, 1.0))
    assert gap(held) < 0.1 * gap(free)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(documents(spark, odd_rows()), none).where("predicted = 0").count() == len(odd_rows())
    assert toxicity.toxicity(documents(spark, []), none).count() == 0


def test_swap_loss_is_that_of_rewritten_texts():
    """Every named term is put for every other one in the text itself, and the change of the log-odds is measured on both texts."""
    import re

    from sparkloom.llm.kernel import string_bytes

    rng = random.Random(6)
    groups = [t for terms in toxicity.IDENTITY_TERMS for t in terms]
    texts = [" ".join(rng.choice([rng.choice([g for g in groups if g.isascii()]).upper(), rng.choice(groups), words(rng, 1)[0], "muslimsX"]) for _ in range(rng.randint(0, 9))) for _ in range(80)] + [None, ""]
    model = toxicity.Model(np.random.default_rng(3).normal(size=1 << toxicity.BITS), 0.3)
    odds = lambda t: model.weights[toxicity._features(t)].sum()
    total = 0.0
    for t in texts:
        for terms in toxicity.IDENTITY_TERMS:
            for a in terms:
                for b in terms:
                    if a != b and a in re.findall(r"[a-z0-9'\x80-\U0010ffff]+", (t or "").lower()):
                        total += (odds(re.sub(rf"(?<![^ ]){a}(?![^ ])", b, t.lower())) - odds(t.lower())) ** 2
    import pyarrow as pa

    got = toxicity.swap_loss(model, toxicity.swaps(*string_bytes(pa.array(texts, pa.string()))))
    assert total > 0 and np.isclose(got, total / len(texts))


def test_fitted_weights_lower_the_loss():
    """The gradient is that of the stated loss: from the fitted weights no small step in any direction makes it less."""
    rng = random.Random(4)
    texts = [" ".join(words(rng, 4)) + rng.choice([" vilebad", ""]) + rng.choice([" muslims", " jews", " women", ""]) for _ in range(150)]
    y = np.array([int("vile" in t) for t in texts], float)
    lists = [toxicity._features(t) for t in texts]
    changes = toxicity._swaps_of_lists(lists)
    sure = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) ** 0.5

    def loss(model):
        z = np.array([model.weights[x].sum() + model.bias for x in lists])
        return (sure * (np.logaddexp(0, z) - y * z)).mean() + 0.5 * 0.05 * (model.weights**2).sum() + 0.7 * toxicity.swap_loss(model, changes)

    best = toxicity.fit_rows(y, lists, changes, swap=0.7, ridge=0.05, rounds=3000)
    told = np.flatnonzero(best.weights)
    for seed in range(20):
        step = np.zeros_like(best.weights)
        step[told] = np.random.default_rng(seed).normal(size=len(told)) * 0.05
        assert loss(toxicity.Model(best.weights + step, best.bias)) > loss(best)
