import collections
import random

from helpers import documents, odd_rows, words

from sparkloom.llm import language_id


def grams(text):
    out = "_"
    for ch in text.lower():
        out += ch if ch.isalpha() else "_" if out[-1] != "_" else ""
    out += "_" if out[-1] != "_" else ""
    found = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(out) - n + 1):
            g = out[i : i + n]
            if out != "_" and not (n == 1 and g == "_") and not (n == 3 and g[1] == "_"):
                found[g] += 1
    return found


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), [0 if c == "_" else ord(c) for c in x[0]]))[:size]]


def brute(text, learnt, size):
    own = ranked(grams(text or ""), size)
    if not own:
        return "und", 0.0
    best = min((sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(own)), lang) for lang, p in sorted(learnt.items()))
    return best[1], 1 - best[0] / (size * len(own))


def test_profiles_and_choices_match_brute_force(spark):
    rng = random.Random(3)
    stock = {"xx": words(rng, 40), "yy": [w[::-1] for w in words(rng, 40)], "zz": ["ñandú", "über", "漢字", "straße"]}
    train = [(k, " ".join(rng.choices(v, k=25)) + "!", lang) for lang, v in stock.items() for k in range(6)]
    learnt = language_id.profiles(documents(spark, train), 40)
    totals = collections.defaultdict(collections.Counter)
    for _, t, lang in train:
        totals[lang].update(grams(t))
    text_of = lambda key: "".join("_" if c == 0 else chr(c) for c in (key >> 42 & 0x1FFFFF, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c != 0x1FFFFF)
    plain = {lang: [text_of(k) for k in keys] for lang, keys in learnt.items()}
    assert plain == {lang: ranked(c, 40) for lang, c in totals.items()}
    asked = [(d, t) for d, t in odd_rows() if d != 904 and d != 905] + [(k, " ".join(rng.choices(stock[rng.choice("xx yy zz".split())], k=rng.randint(1, 30)))) for k in range(30)]
    got = language_id.identify(documents(spark, asked), learnt, 40).collect()
    want = sorted(((d, *brute(t, plain, 40)) for d, t in asked), key=str)
    assert sorted(((r["doc_id"], r["lang_pred"]) for r in got), key=str) == [w[:2] for w in want]
    assert all(abs(r["score"] - w[2]) < 1e-12 for r, w in zip(sorted(got, key=lambda r: str((r["doc_id"], r["lang_pred"], r["score"]))), sorted(want, key=lambda w: str(w)), strict=True))


def test_held_out_rows_and_empty_tables(spark):
    rng = random.Random(4)
    a, b = words(rng, 30), [w[::-1] for w in words(rng, 30)]
    docs = documents(spark, [(k, " ".join(rng.choices((a, b)[k % 2], k=20)), ("aa", "bb")[k % 2]) for k in range(80)])
    got = language_id.language_id(docs).collect()
    assert any(r["held_out"] for r in got) and all(r["lang_pred"] == ("aa", "bb")[r["doc_id"] % 2] for r in got)
    assert all(r["lang_pred"] == "und" for r in language_id.language_id(documents(spark, [(1, "abc", None)])).collect())
    assert language_id.language_id(documents(spark, [])).count() == 0
