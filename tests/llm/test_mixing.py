import math
import random

import pytest
from helpers import documents, odd_rows, words

from sparkloom.llm import mixing


def corpus(seed):
    rng = random.Random(seed)
    return [(k, " ".join(words(rng, rng.randint(1, 30))), "en", rng.choice("aaaaaabbc")) for k in range(600)]


def totals_of(rows):
    out = {}
    for _, t, _, s in rows:
        out[s] = out.get(s, 0) + len(t.split())
    return out


def entropy_of(tokens, a):
    z = sum(t**a for t in tokens)
    return -sum(t**a / z * math.log(t**a / z) for t in tokens)


@pytest.mark.parametrize("entropy", [0.9, 0.97, 1.0])
def test_entropy_is_met_by_the_greatest_exponent(spark, entropy):
    tokens = totals_of(corpus(1))
    df = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    a = mixing.exponent_for_entropy(df, entropy)
    need = entropy * math.log(len(tokens))
    assert entropy_of(tokens.values(), a) >= need - 1e-9 and (a >= 1 or entropy_of(tokens.values(), a + 1e-4) < need)


def test_quotas_are_realised(spark):
    rows = corpus(2)
    tokens = totals_of(rows)
    budget = 9000
    got = mixing.mix(documents(spark, rows).repartition(3), entropy=0.97, budget=budget).collect()
    a = mixing.exponent_for_entropy(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), 0.97)
    z = sum(t**a for t in tokens.values())
    for s, t in tokens.items():
        quota = round(t**a / z * budget)
        own = [r for r in got if r["source"] == s]
        shown = sum(r["n_tokens"] * r["copies"] for r in own)
        assert quota - 30 < shown <= quota and {r["copies"] for r in own} <= {quota // t, quota // t + 1}
    again = mixing.mix(documents(spark, rows[::-1]), entropy=0.97, budget=budget).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))  # whatever the partitions


def test_repeats_limit_and_rows(spark):
    rows = corpus(3)
    docs = documents(spark, rows)
    mixed = mixing.mix(docs, repeats=1.5)
    tokens = totals_of(rows)
    shown = {}
    for r in mixed.collect():
        assert 1 <= r["copies"] <= 2
        shown[r["source"]] = shown.get(r["source"], 0) + r["n_tokens"] * r["copies"]
    small, large = min(tokens, key=tokens.get), max(tokens, key=tokens.get)
    assert shown[large] == tokens[large] and abs(shown[small] / tokens[small] - 1.5) < 0.1
    out = mixing.repeat(docs, mixed)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in mixed.collect())


def test_odd_rows(spark):
    rows = [(*r, "en", s) for r, s in zip(odd_rows(), ["a", None, "b", "a", "a", "b", "b", "b", None, "a"], strict=True)]
    got = mixing.mix(documents(spark, rows), repeats=2.0).collect()
    assert len(got) == len(rows) and len({r["copies"] for r in got if r["doc_id"] == 906}) == 1
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (900, 901, 902))
    assert mixing.mix(documents(spark, []), entropy=0.9).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(documents(spark, rows))
