import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velaspan.llm import kernels as K
from velaspan.llm import kneserney as KN
from velaspan.llm import langid as L
from velaspan.llm import repetition as R

SYL = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "über", "ge"], "cc": ["ção", "ll", "ña", "os"]}


def text(r, lang, n=30):
    return " ".join("".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_mixtures(spark):
    r = random.Random(0)
    rows = [(i, text(r, lang), lang, "s") for i, lang in enumerate(r.choice(list(SYL)) for _ in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.trained(docs)
    assert model[0] == ["aa", "bb", "cc"]
    new = [(0, text(r, "aa")), (1, text(r, "bb") + " " + text(r, "cc")), (2, None), (3, ""), (4, "12 !? 34"), (5, "ka"), (6, text(r, "bb", 20_000)), (7, text(r, "aa", 60) + " " + text(r, "bb", 30)), (5, "ka")]
    got = sorted((x["doc_id"], x["lang_pred"], x["score"], x["langs"]) for x in L.identified(spark.createDataFrame(new, "doc_id long, text string"), model).collect())
    assert len(got) == len(new)
    by = {g[0]: g for g in got}
    assert by[0][1:] == ("aa", 1.0, ["aa"]) and set(by[1][3]) == {"bb", "cc"} and by[6][1] == "bb" and by[5][1] == "aa"
    assert by[7][1] == "aa" and by[7][3][:2] == ["aa", "bb"] and 0.5 < by[7][2] < 0.9
    assert all(by[i][1:3] == ("und", 0.0) for i in (2, 3, 4))
    assert L.identified(docs.limit(0), model).count() == 0
    empty = L.trained(docs.limit(0))
    assert empty[0] == [] and {x["lang_pred"] for x in L.identified(docs, empty).collect()} == {"und"}


def test_em_finds_the_shares():
    p = np.log(np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]]))
    weight = 10_000 * (np.exp(p) @ np.array([0.3, 0.7]))
    assert L.mixture(p, weight) == pytest.approx([0.3, 0.7], abs=0.02)
    assert list(L.mixture(p, 10_000 * np.exp(p[:, 0]))) == [1.0, 0.0]


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = L.identified(docs, L.trained(docs.where(~L.held_out())), keep=("lang",)).where(L.held_out()).collect()
    assert len(got) > 20 and np.mean([x["lang"] == x["lang_pred"] for x in got]) > 0.95


def test_no_letter_is_und():
    assert L.letters(pa.array(["a1", "12", None, "é", "日", "_"])).tolist() == [True, False, False, True, True, False]


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

    def cover(n):
        g = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {i + k for i in range(len(w) - n + 1) if g[tuple(w[i : i + n])] > 1 for k in range(n)}

    five = len(cover(5))
    failed = len(w) < 10 or 100 * five > 20 * len(w)
    chars = sum(map(len, w))
    share = {n: sum(len(w[i]) for i in cover(n)) / max(chars, 1) for n in R.GRAM_LIMITS}
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    by_line = sum(map(len, dup)) / max(sum(map(len, lines)), 1)
    kept = not failed and by_line <= R.LINE_CHARS_LIMIT and all(share[n] <= R.GRAM_LIMITS[n] for n in share)
    return (len(w), chars, sum(c in "#*$%&|<>" for c in t), len(dup), five, failed, kept)


def test_repetition_rules(spark, data):
    r = random.Random(4)
    values = ["", None, "\n\n", "x", "l a\nl a\n \nl a\n", "a b c d e " * 4, "é# <b> | $%& " * 5, "w " * 20_000]
    values += ["".join(r.choice(["a ", "b ", "c\n", "d ", "é\t", "\n", "#f "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    values += [x["text"] for x in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(values)], "doc_id long, text string, kept boolean").repartition(3)
    got = {x["doc_id"]: x for x in R.quality(docs).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"], x["kept"]) == brute_quality(t), t[:80]
    assert R.quality(docs.limit(0)).count() == 0


def brute_model(texts, order):
    """Modified Kneser-Ney by dictionaries, for one string at a time."""
    grams = {order: Counter()}
    for t in texts:
        s = bytes([KN.PAD]) * (order - 1) + t.encode()
        grams[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    levels = {}
    for n in range(1, order + 1):
        few = Counter(grams[n].values())
        n1, n2, n3, n4 = (few[i] for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [min(max(v, 0.05), i - 0.05) for i, v in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
        total, held, mass = defaultdict(int), defaultdict(float), {}
        for g, c in grams[n].items():
            total[g[:-1]] += c
            mass[g] = c - d[min(c, 3) - 1]
            held[g[:-1]] += mass[g]
        levels[n] = (total, held, mass)

    def p(g):
        n = len(g)
        lower = 1 / 256 if n == 1 else p(g[1:])
        total, held, mass = levels[n]
        ctx = g[:-1]
        if ctx not in total:
            return lower
        return mass.get(g, 0.0) / total[ctx] + (total[ctx] - held[ctx]) / total[ctx] * lower

    return p, grams[1]


def test_kneser_ney_is_that_of_brute_force(spark, monkeypatch):
    r = random.Random(6)
    train = [text(r, "aa", 40) + " é." for _ in range(40)] + ["", "x"]
    docs = spark.createDataFrame([(t,) for t in train], "t string").select(F.col("t").cast("binary").alias("body"))
    model = KN.trained(docs, order=4)
    p, seen = brute_model(train, 4)
    probe = [train[0], text(r, "aa", 9), "katomi über ZZ", "x", ""]
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(probe)], "t string, i long").select(F.col("t").cast("binary").alias("body"), "i")
    for chunk, most in ((KN.CHUNK, KN.BROADCAST_GRAMS), (30, 0)):
        monkeypatch.setattr(KN, "BROADCAST_GRAMS", most)
        rows = KN.scored(frame, model, 4, chunk).collect()
        assert sorted((x["i"], x["n_bytes"]) for x in rows) == [(i, len(t.encode())) for i, t in enumerate(probe)]
        got = {x["i"]: x["total"] for x in rows}
        for i, t in enumerate(probe):
            s = bytes([KN.PAD]) * 3 + t.encode()
            want = sum(math.log(p(s[k - 3 : k + 1])) for k in range(3, len(s)) if s[k : k + 1] in seen)
            missing = [k for k in range(3, len(s)) if s[k : k + 1] not in seen]
            if not missing:
                assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)
            else:
                assert got[i] < want
    total = sum(p(b"kat" + bytes([b])) for b in range(256))
    assert total == pytest.approx(1.0, abs=1e-6)


def test_kneser_ney_counts_what_was_seen_once(spark):
    r = random.Random(8)
    train = [text(r, "aa", 12) for _ in range(6)]
    probe = [train[0], train[5], text(r, "aa", 12)]
    frame = lambda rows: spark.createDataFrame([(t, i) for i, t in enumerate(rows)], "t string, i long").select(F.col("t").cast("binary").alias("body"), "i")
    p, seen = brute_model(train, KN.ORDER)
    model = KN.trained(frame(train).select("body"))
    grams = {bytes([KN.PAD]) * 4 + t.encode() for t in train}
    assert model.where("shiftright(key, 56) = 5 and logp is not null").count() == len({s[i : i + 5] for s in grams for i in range(len(s) - 4)})
    got = {x["i"]: x["total"] for x in KN.scored(frame(probe), model).collect()}
    for i, t in enumerate(probe):
        s = bytes([KN.PAD]) * 4 + t.encode()
        assert all(s[k : k + 1] in seen for k in range(4, len(s)))
        assert got[i] == pytest.approx(sum(math.log(p(s[k - 4 : k + 1])) for k in range(4, len(s))), rel=1e-4, abs=1e-3)


def test_quality_keeps_clean_texts(spark):
    r = random.Random(7)
    good = [(i, text(r, "aa" if i % 2 else "bb", 50), "aa" if i % 2 else "bb", "q") for i in range(300)]
    bad = [(1000 + i, "".join(r.choice("QXZ%&01") for _ in range(200)), "aa", "q") for i in range(20)]
    odd = [(2000, None, "aa", "q"), (2001, "", None, "q"), (2002, text(r, "aa", 50), None, "q"), (2003, "kato", "aa", "q")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, trusted string")
    labels = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(i,) for i in range(1, 300, 4)] + [(None,), (4,), (9999,)], "doc_id long")
    got = {x["doc_id"]: x for x in KN.quality(docs, labels).collect()}
    assert len(got) == len(good + bad + odd)
    assert np.mean([got[i]["kept"] for i in range(300)]) > 0.98 and not any(got[1000 + i]["kept"] for i in range(20))
    assert not got[2000]["kept"] and not got[2001]["kept"] and got[2002]["kept"] and got[2003]["kept"]
    assert got[2000]["perplexity"] is None
    none = KN.quality(docs, labels.limit(0)).collect()
    assert all(x["threshold"] is None and x["kept"] == bool(x["n_bytes"]) for x in none)
    assert KN.quality(docs.limit(0), labels).count() == 0


def test_table_finds_what_it_holds():
    keys = np.arange(1, 5000, 3, dtype=np.uint64)
    t = KN.Table(keys, keys.astype(float))
    got = t.find(np.arange(0, 5000, dtype=np.uint64))
    want = np.where(np.isin(np.arange(5000), keys), np.arange(5000), np.nan)
    assert np.array_equal(got, want.astype(np.float32), equal_nan=True)
    assert np.isnan(KN.Table(keys[:0], keys[:0].astype(float)).find(keys)).all()


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"ab ab\tABab", np.uint8)
    w = K.Words(data, np.array([0, 5, 6, 10]))
    assert w.count.tolist() == [2, 0, 1] and len(set(w.hashes()[:2].tolist())) == 1
    x = K.Words(np.frombuffer(b"abab AbaB", np.uint8), np.array([0, 4, 9])).hashes(lower=True)
    assert x[0] == x[1]


def test_the_shortest_text_has_a_language(spark):
    docs = spark.createDataFrame([(1, "a b", "aa"), (2, "é è", "bb")], "doc_id long, text string, lang string")
    new = spark.createDataFrame([(1, "a"), (2, "é"), (3, "z")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.identified(new, L.trained(docs)).collect()}
    assert got[1] == "aa" and got[2] == "bb" and got[3] in ("aa", "bb")
