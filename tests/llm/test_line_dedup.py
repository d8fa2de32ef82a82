import random

from helpers import documents, odd_rows, words
from pyspark.sql import functions as F

from sparkloom.llm import line_dedup


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.SHORTEST:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    lines = [(d, k, line.split()) for d, t in rows if d is not None and t is not None for k, line in enumerate(t.split("\n"))]
    return sorted({(d, k) for d, k, w in lines if w and any(v and (e, m) < (d, k) and near(v, w) for e, m, v in lines)})


def corpus(seed):
    rng = random.Random(seed)
    stock = [words(rng, rng.randint(1, 12)) for _ in range(25)] + [["very"] * 7, ["very"] * 8, ["a", "b", "a", "b", "a", "b"]]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(stock))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                how = rng.randrange(3)
                w[i : i + (how > 0)] = [] if how == 1 and len(w) > 1 else [rng.choice(stock)[0]]
            text.append(rng.choice(["", " "]) + rng.choice([" ", " ", "  ", "\t"]).join(w))
        rows.append((rng.randrange(10**6) * 50 + d, "\n".join(text)))
    return rows


def test_drops_are_those_of_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        got = sorted((r["doc_id"], r["line_no"]) for r in line_dedup.earlier_lines(documents(spark, rows).repartition(4)).distinct().collect())
        assert got == brute(rows)


def test_long_lines_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "WHOLE", 6)  # so lines of both kinds, and of both at once, occur
    rows = corpus(4) + corpus(5)
    got = sorted((r["doc_id"], r["line_no"]) for r in line_dedup.earlier_lines(documents(spark, rows).repartition(4)).distinct().collect())
    assert got == brute(rows)


def test_results_and_odd_rows(spark):
    rows = odd_rows() + [(10, "same words here again today\nkept line"), (11, "kept line\n\nsame words here again now")]
    docs = documents(spark, rows)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["dropped"]) for r in line_dedup.dedup(docs).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows) and by[11] == (3, 2, [0, 2]) and by[10] == (2, 0, []) and by[900] == (0, 0, []) and by[906] == (1, 1, [0]) and by[905][1] == 1 and by[None][1] == 0
    clean = line_dedup.cleaned(docs)
    assert clean.columns == docs.columns and {r["doc_id"]: r["text"] for r in clean.where(F.col("doc_id").isin(10, 11)).collect()} == {10: "same words here again today\nkept line", 11: ""}
    assert line_dedup.dedup(documents(spark, [])).count() == 0
