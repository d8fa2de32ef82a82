import itertools
import random

import numpy as np
from helpers import documents, odd_rows, words

from sparkloom.llm import bloom, decontaminate


def items(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "item_id long, text string, words string, hash int")


def test_planted_passages_with_substitutions(spark):
    rng = random.Random(2)
    bench = [(k, " ".join(words(rng, rng.randint(15, 50)))) for k in range(20)] + [(50, " ".join(words(rng, 7))), (51, "too short"), (52, None), (None, " ".join(words(rng, 20)))]
    rows, leaked = odd_rows(), {}
    for d in range(120):
        w = words(rng, rng.randint(20, 150))
        if d % 3 == 0:
            k, t = bench[rng.randrange(20)]
            part = t.upper().split()
            a = rng.randrange(0, len(part) - 14)
            part = part[a : a + max(14, rng.randint(14, len(part)))]
            if len(part) > 24:
                part[len(part) // 3] = "other"
            at = rng.randrange(len(w))
            w[at:at] = part
            leaked[d] = k
        rows.append((d, " ".join(w)))
    rows.append((200, " ".join(words(rng, 9)) + " " + bench[20][1] + " " + " ".join(words(rng, 9))))
    rows.append((201, bench[21][1]))
    leaked[200] = 50
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(documents(spark, rows).repartition(4), items(spark, bench)).collect()}
    assert {d: [k] for d, k in leaked.items()} == got
    docs = documents(spark, rows)
    kept = decontaminate.without(docs, decontaminate.contaminated(docs, items(spark, bench)).select("doc_id"))
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(leaked)


def test_overlaps_meet_brute_force(spark):
    """Every overlap has at least 0.8 equal words on one diagonal, and equal runs of SPAN words are all found."""
    rng = random.Random(6)
    stock = words(rng, 300)
    bench = [(k, " ".join(rng.choices(stock, k=30))) for k in range(8)]
    rows = []
    for d in range(60):
        w = rng.choices(stock, k=60)
        t = bench[d % 8][1].split()
        w[20:45] = [x if rng.random() > 0.15 else rng.choice(stock) for x in t[3:28]]
        rows.append((d, " ".join(w)))
    got = decontaminate.overlaps(documents(spark, rows), items(spark, bench)).collect()
    texts, tests = dict(rows), dict(bench)
    for r in got:
        w, t = texts[r["doc_id"]].split()[r["from_word"] : r["to_word"]], tests[r["item_id"]].split()
        assert max(sum(a == b for a, b in zip(w, t[i : i + len(w)], strict=False)) for i in range(len(t))) >= 0.8 * len(w)
    found = {(r["doc_id"], r["item_id"]) for r in got}
    for d, text in rows:
        w, t = text.split(), tests[d % 8].split()
        if any(w[20 + i : 32 + i] == t[3 + i : 15 + i] for i in range(14)):
            assert (d, d % 8) in found


def test_longest_overlap():
    rng = np.random.default_rng(3)
    for _ in range(300):
        e = rng.random(rng.integers(0, 25)) < 0.8
        a, b = decontaminate.longest_overlap(e)
        score = lambda i, j: np.where(e[i:j], decontaminate.MATCH, decontaminate.MISS).sum()
        spans = [j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1) if score(i, j) >= 0 and e[i] and e[j - 1]]
        assert b - a <= max(spans, default=0) and (b == a or (e[a] and e[b - 1]))
        assert not any(e) or b > a


def test_empty_tables(spark):
    assert decontaminate.contaminated(documents(spark, []), items(spark, [(1, "a b c d e f")])).count() == 0
    assert decontaminate.contaminated(documents(spark, odd_rows()), items(spark, [])).count() == 0


def test_bloom_filter_lets_nothing_go(spark):
    df = spark.range(5000).selectExpr("xxhash64(id) AS h")
    bits = bloom.build(df.where("h % 2 = 0"), "h")
    marked = bloom.maybe(df, "h", bits, "m").collect()
    assert all(r["m"] for r in marked if r["h"] % 2 == 0) and sum(r["m"] for r in marked if r["h"] % 2) < 5


def test_seeds_hit_every_overlap():
    """Over all patterns of equal words that avoid the seeds, by the last words alone: from 12 words on none has 0.8 equal, and more words make it worse."""
    wide = max(map(len, decontaminate.SEEDS))
    last = np.arange(1 << wide)
    free = np.ones(len(last), bool)
    for seed in decontaminate.SEEDS:
        free &= (last & int(seed, 2)) != int(seed, 2)
    best = np.where(last == 1, decontaminate.MATCH, -10_000)
    tops = [decontaminate.MATCH]
    for _ in range(2, 200):
        older = np.maximum(best[last >> 1], best[(last >> 1) | (1 << (wide - 1))])
        best = np.where(free, older + np.where(last & 1, decontaminate.MATCH, decontaminate.MISS), -10_000)
        tops.append(int(best[1::2].max()))
    assert max(tops[decontaminate.SPAN - 1 :]) < 0 and max(tops[150:]) < min(tops[:50]) < 0


def test_substitutions_meet_brute_force(spark):
    """Every place of substitutions that leaves 0.8 equal, in passages of 12 words, and many in longer ones."""
    rng = random.Random(8)
    bench = [(n, " ".join(words(rng, n))) for n in (12, 14, 15, 16, 20, 25)]
    rows = []
    for n, text in bench:
        places = [c for k in range(n // 5 + 1) for c in itertools.combinations(range(1, n - 1), k)] if n == 12 else [rng.sample(range(1, n - 1), n // 5) for _ in range(60)] + [range(3, n - 1, 4)[: n // 5]]
        for c in places:
            own = [f"other{k}" if k in c else w for k, w in enumerate(text.split())]
            rows.append((n * 1000 + len(rows), " ".join([*words(rng, 5), *own, *words(rng, 5)])))
    got = {(r["doc_id"], *r["item_ids"], r["longest"]) for r in decontaminate.contaminated(documents(spark, rows), items(spark, bench)).collect()}
    assert got == {(d, d // 1000, d // 1000) for d, _ in rows}


def test_longest_overlap_is_the_longest():
    rng = np.random.default_rng(4)
    for _ in range(300):
        e = rng.random(rng.integers(0, 25)) < 0.8
        a, b = decontaminate.longest_overlap(e)
        score = lambda i, j: np.where(e[i:j], decontaminate.MATCH, decontaminate.MISS).sum()
        assert b - a == max((j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1) if score(i, j) >= 0 and e[i] and e[j - 1]), default=0)


def test_short_items_meet_brute_force(spark):
    """Items of 3 to 11 words with every choice of words that may differ, ends too; one more is no overlap."""
    rng = random.Random(9)
    bench = [(n, " ".join(words(rng, n))) for n in range(decontaminate.SHORTEST, decontaminate.SPAN)]
    rows, leaked = [], set()
    for n, text in bench:
        for k in range(n // 5 + 2):
            for c in itertools.combinations(range(n), k):
                own = [f"other{i}" if i in c else w for i, w in enumerate(text.split())]
                rows.append((n * 1000 + len(rows), " ".join([*words(rng, 2), *own, *words(rng, 2)] if len(rows) % 2 else own)))
                if k <= n // 5:
                    leaked.add((rows[-1][0], n, n))
    got = {(r["doc_id"], *r["item_ids"], r["longest"]) for r in decontaminate.contaminated(documents(spark, rows), items(spark, bench)).collect()}
    assert got == leaked
