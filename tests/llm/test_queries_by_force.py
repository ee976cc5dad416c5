"""Registered queries that SQL can't express, on a small folder of tables, against plain Python."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from velaspan.llm import kneserney as KN
from velaspan.llm import langid as L
from velaspan.llm import packing, registry, secrets

P = pytest.importorskip("public_tokenizers")

SYL = {"aa": ["ka", "to", "mi", "ru", "le"], "bb": ["sch", "ein", "über", "ge", "la"], "cc": ["ção", "ll", "ña", "os", "ri"]}


def documents():
    r = random.Random(4)
    word = lambda lang: "".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 3)))
    rows = []
    for i in range(70):
        lang = "aa" if i % 3 else r.choice(["bb", "cc"])  # one language has two thirds
        body = " ".join(word(lang) for _ in range(r.choice([3, 20, 60, 200])))
        if i % 9 == 4:
            body += "\n" + " ".join(word("bb") for _ in range(30))
        if i % 10 == 0:
            body += ' token = "8b540ef2c226668020056c2469c653445539f8d7"'
        if i % 14 == 0:
            body += " " + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
        rows.append((i, body, lang))
    rows += [(70, None, "aa"), (71, "", None), (72, "12 34 !!", "bb"), (73, rows[3][1], None), (74, " ".join(word("aa") for _ in range(9000)), "aa"), (75, "ka", "aa"), (76, rows[3][1], "aa")]
    rows += [(100 + i, " ".join(word("aa") for _ in range(2)), "aa") for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = documents()
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}), at / "documents.parquet")
    good = [r[0] for r in rows if r[1] and r[0] % 4 != 1]
    pq.write_table(pa.table({"doc_id": pa.array(good + [1], pa.int64()), "quality": pa.array([1] * len(good) + [0], pa.int32()), "toxic": pa.array([0] * (len(good) + 1), pa.int32())}), at / "labels.parquet")
    r = np.random.default_rng(2)
    vectors = r.normal(size=(260, 16)).astype(np.float32).tolist() + [None, [0.0] * 16, [float("nan")] * 16]
    vectors[7] = vectors[50]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())}), at / "embeddings.parquet")
    return str(at)


def test_op1(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t, _ in documents():
        ids = own.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in registry.QUERIES["op1_bpe_roundtrip"](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want


def share(t):
    if not t:
        return 1.0
    line = t.find("\n") + 1
    return 1 - (line if line else len(t) // 2) / len(t)


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, _ in documents()}
    texts = {i: x for i, x, _ in documents()}
    by, seq = defaultdict(list), defaultdict(list)
    for r in registry.QUERIES["op4_vector_packing"](spark, folder).collect():
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(own) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    assert set(by) == set(ids)
    for i, rs in by.items():
        ends = sorted((r["start"], r["start"] + r["length"]) for r in rs)
        assert ends[0][0] == 0 and ends[-1][1] == len(ids[i]) and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    for rs in seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert all(r["offset"] == sum(x["length"] for x in rs[:k]) for k, r in enumerate(rs))
        total = sum(r["length"] for r in rs)
        assert total <= 4096 and len(rs) <= packing.SEGMENTS
        assert total & (total - 1) == 0 or 4096 - total <= packing.SLACK
        assert sum(r["length"] * share(texts[r["doc_id"]]) for r in rs) <= packing.LOSS + len(rs)


def in_order(size, loss, limits):
    """Sequences when examples are taken as they come and cut where a limit is reached."""
    n, room = 1, list(limits)
    for left, s in zip(size.tolist(), loss.tolist(), strict=True):
        while left:
            take = int(min(left, room[0], room[2] / s)) if room[1] else 0
            if take < 1:
                n, room = n + 1, list(limits)
                continue
            left -= take
            room = [room[0] - take, room[1] - 1, room[2] - math.ceil(take * s)]
    return n


def test_dot_products_pack_tighter_than_the_order_of_arrival():
    r = np.random.default_rng(5)
    size, loss, limits = r.integers(20, 1500, 1500), r.choice([0.1, 0.4, 0.9, 1.0], 1500), (4096, 12, 2600)
    order = np.argsort(-loss, kind="stable")  # as sources often come, alike beside alike
    size, loss = size[order], loss[order]
    bound = max(size.sum() / limits[0], len(size) / limits[1], np.ceil(size * loss).sum() / limits[2])
    for cut in (True, False):
        pieces, _ = packing.Packer(*limits, cut, 0).pack(size, loss, True)
        use = defaultdict(lambda: [0, 0, 0])
        for i, _, n, s, _ in pieces:
            use[s] = [use[s][0] + n, use[s][1] + 1, use[s][2] + math.ceil(n * loss[i])]
        assert all(x <= y for u in use.values() for x, y in zip(u, limits, strict=True))
        assert sum(u[0] for u in use.values()) == size.sum() and max(u[2] for u in use.values()) > 2500  # the loss limit binds
        assert len(use) <= 1.12 * bound  # small examples come last and meet the limit on segments
        if cut:
            assert len(use) < in_order(size, loss, limits)
    assert max(u[1] for u in use.values()) == 12 or len(pieces) == 1500


def test_many_tiny_texts_need_no_padding(spark):
    docs = spark.createDataFrame([(i, "ab cd") for i in range(2000)], "doc_id long, text string").coalesce(1)
    rows = packing.packed(docs, P.path("word_bpe_49k.json")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert all(n & (n - 1) == 0 for n in sizes.values()) and sum(sizes.values()) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_a_null_share_bears_loss(spark):
    docs = spark.createDataFrame([(1, "a b c d", None), (1, "a b c d", 0.0)], "doc_id long, text string, s double").coalesce(1)
    rows = packing.packed(docs, P.path("word_bpe_49k.json"), tokens=64, loss=4, loss_share="s", halve=False).collect()
    assert sum(r["length"] for r in rows) == 10 and len({r["sequence_id"] for r in rows}) == 2  # five bearing tokens are one too many


def test_op6(spark, folder):
    words = secrets.common_words(spark.read.parquet(f"{folder}/documents.parquet"))
    counts = {True: defaultdict(lambda: 0.5), False: defaultdict(lambda: 0.5)}
    for r in secrets.samples(spark, words).collect():
        for a, b in zip(r["text"], r["text"][1:], strict=False):
            counts[r["random"]][a, b] += 1
    letters = [chr(c) for c in range(32, 128)]
    totals = {k: {a: sum(c[a, b] for b in letters) for a in letters} for k, c in counts.items()}
    ratio = lambda a, b: math.log(counts[True][a, b] / totals[True][a]) - math.log(counts[False][a, b] / totals[False][a])
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_secret_scan"](spark, folder).collect()}
    found = 0
    for i, t, _ in documents():
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        more = []
        for m in re.finditer("[A-Za-z0-9_+/=-]{16,}", t):
            s = m[0]
            if re.search("[A-Za-z]", s) and not any(a <= m.start() and b >= m.end() for a, _, b in base):
                score = sum(ratio(a, b) for a, b in zip(s, s[1:], strict=False))
                if score >= max(secrets.THRESHOLD, secrets.PER_CHARACTER * (len(s) - 1)):
                    more.append((m.start(), 3, m.end()))
        show = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["spans"] == show(base + more), i
        assert got[i]["base_sha256"] == hashlib.sha256(show(base).encode()).hexdigest()
        found += len(more)
    assert found == 5


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_op7(spark, folder):
    rows = documents()
    good = {r[0] for r in rows if r[1] and r[0] % 4 != 1}
    order = KN.ORDER
    pad = bytes([KN.PAD]) * (order - 1)
    grams = {order: Counter()}
    for i, t, _ in rows:
        if i in good and not held(i):
            s = pad + t.encode()
            grams[order].update(s[k - order + 1 : k + 1] for k in range(order - 1, len(s)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    total, mass, kept = {}, {}, {}
    for n, g in grams.items():
        c = Counter(g.values())
        y = c[1] / (c[1] + 2 * c[2])
        d = [min(max(v, 0.05), i - 0.05) for i, v in ((1, 1 - 2 * y * c[2] / c[1]), (2, 2 - 3 * y * c[3] / c[2] if c[2] else 1.0), (3, 3 - 4 * y * c[4] / c[3] if c[3] else 1.5))]
        for k, v in g.items():
            mass[k] = v - d[min(v, 3) - 1]
            total[k[:-1]] = total.get(k[:-1], 0) + v if k[:-1] in total else v
            kept[n, k[:-1]] = kept.get((n, k[:-1]), 0.0) + mass[k]

    def p(g):
        lower = 1 / 256 if len(g) == 1 else p(g[1:])
        if g[:-1] not in total:
            return lower
        return (mass.get(g, 0.0) + (total[g[:-1]] - kept[len(g), g[:-1]]) * lower) / total[g[:-1]]

    nats = {}
    for i, t, _ in rows:
        s = pad + (t or "").encode()
        if len(s) >= order and all(bytes([b]) in grams[1] for b in s[order - 1 :]):
            nats[i] = -sum(math.log(p(s[k - order + 1 : k + 1])) for k in range(order - 1, len(s))) / (len(s) - order + 1)
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_kneser_ney_quality"](spark, folder).collect()}
    assert len(got) == len(rows) and len(nats) > 100
    for i, x in nats.items():
        assert math.log(got[i]["perplexity"]) == pytest.approx(x, rel=1e-4, abs=1e-4)
    # thresholds: the quantile of the held-out values, each language's drawn towards that of all
    tested = [(lang, math.ceil(math.log(got[i]["perplexity"]) * KN.STEPS)) for i, t, lang in rows if i in good and held(i)]
    cut = lambda v: float(np.quantile(v, KN.QUANTILE))
    common = cut([v for _, v in tested])
    for i, t, lang in rows:
        own = [v for x, v in tested if x == lang and lang is not None]
        at = (len(own) * cut(own) + KN.ENOUGH * common) / (len(own) + KN.ENOUGH) if own else common
        limit = math.exp(at / KN.STEPS) * KN.SLACK
        r = got[i]
        assert r["threshold"] == pytest.approx(limit) and r["trusted"] == (i in good) and r["n_bytes"] == len((t or "").encode())
        assert r["kept"] == (bool(t) and math.log(r["perplexity"] or 1) * r["n_bytes"] <= math.log(limit) * r["n_bytes"] + KN.ALLOWANCE)


def test_op8(spark, folder):
    vectors = {i: np.array(v, np.float64) for i, v in enumerate(pq.read_table(f"{folder}/embeddings.parquet")["embedding"].to_pylist()) if v and np.isfinite(v).all() and any(v)}
    got = defaultdict(list)
    for r in registry.QUERIES["op8_hnsw_neighbours"](spark, folder).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in vectors if i % 50 == 0}
    hits = 0
    for i, rows in got.items():
        q = vectors[i]
        score = {j: float(v @ q) / (math.sqrt(v @ v) * math.sqrt(q @ q)) for j, v in vectors.items() if j != i}
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and all(s == pytest.approx(score[j], abs=1e-12) for _, j, s in rows)
        assert [(-s, j) for _, j, s in rows] == sorted((-s, j) for _, j, s in rows)
        hits += len({j for _, j, _ in rows} & set(sorted(score, key=lambda j: (-score[j], j))[:5]))
    assert hits / (5 * len(got)) >= 0.95 and got[50][0][1] == 7


def mixed(x):
    m = 2**64 - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
    return x ^ x >> 31


def ngrams(t):
    """Hashed cells of a text's n-grams, by dictionaries."""
    body = re.sub(rb"[^A-Za-z\x80-\xff]+", b" ", b" " + t.encode() + b" ").lower()
    out = Counter()
    for n in L.GRAMS:
        for k in range(len(body) - n + 1):
            g = body[k : k + n]
            if n > 2 or g.strip():
                out[mixed((int.from_bytes(g, "big") + (n << 40)) & 2**64 - 1) >> (64 - L.BITS)] += 1
    return out


def test_op10(spark, folder):
    rows = documents()
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(ngrams(t or ""))
    names = sorted(counts)
    totals = {x: sum(counts[x].values()) + 0.5 * 2**L.BITS for x in names}

    def fit(cells, live, start):
        share, n = dict(start), sum(cells.values())
        for _ in range(L.ROUNDS):
            new = dict.fromkeys(live, 0.0)
            for c, w in cells.items():
                joint = {x: share[x] * (counts[x][c] + 0.5) / totals[x] for x in live}
                every = sum(joint.values())
                for x in live:
                    new[x] += w * joint[x] / every / n
            moved = max(abs(new[x] - share[x]) for x in live)
            share = {x: v / sum(new.values()) for x, v in new.items()}
            if moved < L.STEP:
                break
        return share, sum(w * math.log(sum(share[x] * (counts[x][c] + 0.5) / totals[x] for x in live)) for c, w in cells.items())

    got = {r["doc_id"]: r for r in registry.QUERIES["op10_language_mixture"](spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not t or not re.search(r"[^\W\d_]", t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cells = ngrams(t)
        fine = L.PENALTY * math.sqrt(sum(cells.values()))
        live, leave = list(names), max(1, len(names) // 2)
        share, fits = fit(cells, live, dict.fromkeys(live, 1 / len(live)))
        while len(live) > 1:
            leave = min(leave, max(1, len(live) // 2))
            rest = sorted(sorted(live, key=lambda x: (share[x], x))[leave:])
            least = {x: max(share[x], 1e-6) for x in rest}
            less, lower = fit(cells, rest, {x: v / sum(least.values()) for x, v in least.items()})
            if fits - lower <= fine:
                live, share, fits = rest, less, lower
            elif leave == 1:
                break
            else:
                leave //= 2
        best = max(sorted(live), key=lambda x: share[x])
        assert set(r["langs"]) == set(live) and r["lang_pred"] == best and r["score"] == pytest.approx(share[best], abs=2e-3)


def test_a_hundred_languages(spark):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = {f"l{k:02d}": ["".join(r.choice(letters) for _ in range(3)) for _ in range(6)] for k in range(100)}
    say = lambda lang, n: " ".join(r.choice(syllables[lang]) + r.choice(syllables[lang]) for _ in range(n))
    docs = spark.createDataFrame([(k * 10 + i, say(lang, 60), lang) for k, lang in enumerate(syllables) for i in range(3)], "doc_id long, text string, lang string")
    model = L.trained(docs)
    assert len(model[0]) == 100 and model[1].dtype == np.float32
    new = spark.createDataFrame([(k, say(lang, 30), lang) for k, lang in enumerate(syllables)] + [(200, say("l03", 60) + " " + say("l70", 40), "l03")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in L.identified(new, model, keep=("lang",)).collect()}
    assert all(x["lang_pred"] == x["lang"] for x in got.values()) and got[200]["langs"][:2] == ["l03", "l70"]


def test_equal_shares_go_to_the_lesser_name():
    p = np.log(np.array([[0.5, 0.5], [0.5, 0.5]]))
    share = L.mixture(p, np.array([3.0, 3.0]))
    assert sorted(share.tolist()) == [0.0, 1.0]
