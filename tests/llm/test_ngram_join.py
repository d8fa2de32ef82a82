import random
import re

import pytest
from helpers import documents, odd_rows, words

from sparkloom.llm import ngram_join
from sparkloom.llm.components import components


def brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(d, []).append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    ids = sorted(sets)
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return [(d, len(s), root[d]) for d in ids for s in sets[d]]


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    shared = words(rng, 15)
    rows, k = [], 0
    for _ in range(groups):
        base = words(rng, rng.randint(3, 90))
        if rng.random() < 0.5:
            base = base + shared
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((k, " ".join(w)))
            k += rng.randint(1, 3)
    return rows


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_components_of_all_links(spark, seed, width, percent):
    rows = corpus(seed, 25, 9)
    got = ngram_join.link(documents(spark, rows).repartition(5), width, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, width, percent))


def test_chains_that_no_leader_sees(spark):
    """Neighbours of a chain link; its ends do not."""
    rng = random.Random(5)
    w, rows = words(rng, 60), []
    for k in range(14):
        rows.append((k, " ".join(w)))
        w = w[:]
        w[(k * 7) % 60] = "new" + str(k)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(documents(spark, rows)).collect()}
    assert got == {d: c for d, _, c in brute(rows, 4, 85)} and len(set(got.values())) < 14


def test_odd_rows(spark):
    rows = odd_rows()
    got = ngram_join.link(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["n_shingles"] == by[901]["n_shingles"] == by[902]["n_shingles"] == 0 and by[900]["component_id"] == 900
    assert by[903]["n_shingles"] == 1 and by[905]["component_id"] == 904 and by[None]["component_id"] is None
    assert ngram_join.link(documents(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = corpus(8, 12, 6) + odd_rows()
    docs = documents(spark, rows)
    got = ngram_join.keep_first(docs)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    want = {d for d, _, c in brute([r for r in rows if r[0] is not None], 5, 80) if d == c}
    assert sorted(k for k in kept if k is not None) == sorted(want) and kept.count(None) == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    root = {v: v for e in edges for v in e}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: r for v, r in root.items() if v != r}
