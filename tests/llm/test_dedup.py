import hashlib
import random
from collections import Counter

import numpy as np

from velaspan.llm import kernels as K
from velaspan.llm import neardup, substrings
from velaspan.llm.components import components
from velaspan.llm.workspace import raw


def corpus(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    out = [None, "", " \t\n", "one", "One", "one two", "a b c", "A b c", "a\x0bb\x0cc\x1cd", "x y z " * 60]
    base = [[word() for _ in range(r.randint(20, 120))] for _ in range(12)]
    passage = [word() for _ in range(50)]
    for i in range(120):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8, 15])):
            w[r.randrange(len(w))] = word()
        if i % 3 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[: r.choice([50, 50, 36, 34])]
        out.append(" ".join(w))
    out.append(" ".join(word() for _ in range(30_000)))
    return out


def frame(spark, values):
    return spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(values)], "doc_id long, text string, key long, doc string").repartition(4)


def groups(values, k, percent):
    sets = []
    for v in values:
        w = (v or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sets, [find(i) for i in range(len(values))]


def test_groups_are_those_of_brute_force(spark):
    values = corpus()
    values += [values[20]] * 30
    for k, percent in ((3, 85), (5, 80)):
        sets, want = groups(values, k, percent)
        got = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, values), k=k, percent=percent).collect()}
        assert [got[i]["component_id"] for i in range(len(values))] == want
        assert [got[i]["n_shingles"] for i in range(len(values))] == [len(s) for s in sets]
        assert all(g["kept"] == (i == g["component_id"]) for i, g in got.items())


def test_a_family_is_compared_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    values = []
    for _ in range(150):
        w = list(base)
        for i in r.sample(range(60), r.randint(0, 5)):
            w[i] = f"v{r.randrange(9)}"
        values.append(" ".join(w))
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(frame(spark, values), k=3, percent=85).collect()}
    assert [got[i] for i in range(150)] == groups(values, 3, 85)[1]


def test_empty_null_and_repeated_rows(spark):
    assert neardup.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (2, 2, True)], key=str)


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(3)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    items = np.concatenate([a, b, a[:1]])
    sig = K.superminhash(np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1, len(a) + len(b) + 1]), items, 128)
    assert abs((sig[0] == sig[1]).mean() - 1000 / 3000) < 0.12
    assert (sig[3] == np.iinfo(np.uint64).max).all() and len(set((sig[2] >> np.uint64(40)).tolist())) == 128  # one element takes every slot in turn
    assert (K.superminhash(np.array([0, len(a)]), a[::-1].copy(), 128)[0] == sig[0]).all()


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(40)] + [(600, 600 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {g["node"]: g["component"] for g in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_few_links_are_written_by_few_tasks(spark, monkeypatch):
    from velaspan.llm import components as module

    files, store = [], module.stored

    def counted(df, name):
        out = store(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "stored", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "8"), strict=True):
            spark.conf.set(k, v)
        assert {r["component"] for r in components(links).collect()} == {0}
        assert len(files) > 2 and set(files[1:]) == {1}
        files.clear()
        monkeypatch.setattr(module, "LINKS", 60)
        assert {r["component"] for r in components(links).collect()} == {0}
        assert len(files) > 2 and set(files[2:]) == {1 + 200 // 60}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def removed_by_force(values, window):
    words = [(v or "").encode().split() for v in values]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return words, out


def check_removed(spark, values, window, **options):
    words, want = removed_by_force(values, window)
    got = substrings.with_spans(frame(spark, values), window, **options).select("doc_id", raw("text").alias("body"), "_spans").mapInArrow(substrings._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(values)
    for i, (w, gone) in enumerate(zip(words, want, strict=True)):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), i


def test_repeats_are_those_of_brute_force(spark, monkeypatch):
    values = corpus(1) + ["p q " * 30, "r " * 36, "r " * 20]
    values += [values[15]] * 20
    check_removed(spark, values, 35)
    monkeypatch.setattr(substrings, "BROADCAST_IDS", 0)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    check_removed(spark, values, 35, shard_words=200)
    check_removed(spark, values, 35, shard_words=200, broadcast_windows=0)
    check_removed(spark, values, 5)


def test_cut_texts_keep_the_rest_as_it_was(spark):
    shared = " ".join(f"s{i}" for i in range(6))
    values = [f"one\n two  {shared}\tthree\n", f"{shared} four", None, "", "five"]
    got = {r["doc_id"]: r for r in substrings.removed(frame(spark, values), 6).collect()}
    assert [got[i]["text"] for i in range(5)] == ["one\n two  three\n", "four", None, "", "five"]
    assert [(got[i]["_left"], got[i]["_gone"]) for i in range(5)] == [(3, 6), (1, 6), (0, 0), (0, 0), (1, 0)]
    assert got[0]["key"] == 1 and got[0]["doc"] == "q"
    assert substrings.removed(frame(spark, values).limit(0), 6).count() == 0


def test_automaton_counts_places():
    a = substrings.Automaton()
    a.add(list("abcabd"), 1)
    a.add(list("xabc"), 3)
    a.finish(2)
    assert a.repeats(list("abcabd"), 2) == [True, True, False, True, False]
    assert a.repeats(list("zzab"), 2) == [False, False, True]


def morse(n, a="a", b="b"):
    """Two different strings of 2**n letters that every polynomial modulo a power of two maps to one value."""
    out = [0]
    for _ in range(n):
        out += [1 - x for x in out]
    return "".join((a, b)[x] for x in out), "".join((b, a)[x] for x in out)


def test_words_lines_and_windows_have_hashes_without_a_pattern(spark):
    x, y = morse(11)
    data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    words = K.Words(data, np.array([0, len(data)]))
    for family in (0, 1):
        a, b, c = words.hashes(family=family).tolist()
        assert a == c != b
    signs = np.array([ord(i) for i in x + y], np.uint64)
    assert len(set(K.windows(K.mix(signs), 2048)[[0, 2048]].tolist())) == 2
    assert (K.sequences(K.mix(signs), np.array([0, 5]), np.array([2048, 17])) == [K.windows(K.mix(signs), 2048)[0], K.windows(K.mix(signs), 12)[5]]).all()
    values = [x, y, f"{x} one two three", f"{y} one two three"]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, values), k=3, percent=85).collect()}
    assert got == {i: i for i in range(4)}
    check_removed(spark, [f"{x} {' '.join('abcdef')}", f"{y} {' '.join('abcdef')}"], 7)


def test_long_words_hash_by_every_byte():
    r = random.Random(9)
    for n in (1, 7, 8, 9, 16, 17, 511, 512, 513, 4000):
        body = bytes(r.randrange(33, 127) for _ in range(n))
        other = bytearray(body)
        other[r.randrange(n)] ^= 1
        data = np.frombuffer(body + b" " + bytes(other) + b" " + body + b" " + body.upper(), np.uint8)
        own = K.Words(data, np.array([0, len(data)]))
        if len(own.start) == 4:
            h, low = own.hashes(), own.hashes(lower=True)
            assert h[0] == h[2] != h[1] and (low[0] == low[3]) == (body.lower() == body.upper().lower())


def test_an_id_of_several_texts_has_the_links_of_each(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = spark.createDataFrame([(5, a), (5, b), (7, a), (3, b), (9, "other words that stand alone here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(rows).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (9, 9)]


def test_spans_of_references_are_those_of_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 2)))
    references = [" ".join(word() for _ in range(60)) for _ in range(9)] + [None, "", "short one"]
    values = [None, "", "a b"]
    for _ in range(60):
        w = [word() for _ in range(r.randint(5, 40))]
        own = r.choice(references[:9]).split()
        at, size = r.randrange(40), r.randint(3, 20)
        w[r.randrange(len(w)) : 0] = own[at : at + size]
        values.append("  ".join(w))
    window = 8
    known = {tuple(t.encode().split()[i : i + window]) for t in references if t for i in range(len(t.split()) - window + 1)}
    table = spark.createDataFrame([(t,) for t in references], "text string")
    for options in ({}, {"shard_words": 100, "round_words": 200}):
        got = {x["doc"]["id"]: [(s["start"], s["end"]) for s in x["spans"]] for x in substrings.reference_spans(frame(spark, values), table, window, **options).collect()}
        hits = 0
        for i, v in enumerate(values):
            w = (v or "").encode().split()
            gone = [False] * len(w)
            for k in range(len(w) - window + 1):
                if tuple(w[k : k + window]) in known:
                    gone[k : k + window] = [True] * window
            mask = [False] * len(w)
            for a, b in got.get(i, []):
                mask[a:b] = [True] * (b - a)
            assert mask == gone, i
            hits += any(gone)
        assert hits > 20
    cut = {x["doc_id"]: x for x in substrings.removed(frame(spark, values), window, references=table).collect()}
    assert len(cut) == len(values) and cut[0]["text"] is None and sum(x["_gone"] > 0 for x in cut.values()) == hits
    assert substrings.reference_spans(frame(spark, values), table.limit(0), window).count() == 0
