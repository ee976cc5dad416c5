"""Substring dedup: suffix automata of reference shards give matching statistics of word sequences.

Every document is reference and query at once, so sending each shard's
automaton to every document would cost the square of the corpus. Instead the
corpus is dealt so that two equal windows always meet: a window goes by its
minimiser, the least hash among its 8-word grams, which equal windows share.
Consecutive windows of a document with one minimiser form a segment. Only
segments whose minimiser occurs again can hold a repeat; equal segments are
counted, not copied; the distinct ones are dealt into shards of bounded size,
each shard's automaton is built where its segments are, and every segment is
streamed through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm import kernels as K
from velaspan.llm.repetition import repeated
from velaspan.llm.workspace import discard, documents, hidden, raw, stored

#: Words of a gram that can be a minimiser.
GRAM = 8
#: Words of a shard; a minimiser with more than this is dealt by whole windows instead.
SHARD_WORDS = 60_000
#: Broadcast bounds, in rows and in bytes; beyond them the same join is shuffled.
BROADCAST_IDS, BROADCAST_BYTES = 300_000, 32_000_000
#: Repeated windows of hot minimisers (200 bytes each in a worker), up to which they are broadcast.
BROADCAST_WINDOWS = 300_000


def _sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values, by doubling."""
    span, out = 1, values
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _segments(window: int):
    gram = min(GRAM, window)
    width = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in K.slices(batch.column(1)):
                words = K.Words(data, offsets)
                if len(words.row) < window:
                    continue
                hashes = words.hashes()
                grams = K.windows(hashes, gram)
                least = _sliding_min(grams, width)
                at = np.flatnonzero(K.within(words, window))
                if not len(at):
                    continue
                own = K.within(words, gram)
                twice = np.concatenate([[0], np.cumsum(repeated(grams, words.row[: len(grams)]) & own)])
                row, value = words.row[at], least[at]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(at)))
                start, row = at[head], row[head]
                end = start + n - 1 + window
                digest = K.sequences(words.hashes(family=1), start, end)
                own_repeat = twice[start + n - 1 + width] > twice[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[head].view(np.int64)), pa.array(digest.view(np.int64)), batch.column(0).take(pa.array(first + row)), pa.array((start - words.first[row]).astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(own_repeat)],
                    names=["key", "digest", "doc", "start", "n", "own"],
                )

    return run


_CONTENTS = "key long, digest long, weight long, words binary, deal long, code long, hot boolean, deals array<long>, codes array<long>"


def _contents(window: int):
    """What the segments hold that a document stands for.

    A segment gives a row with its words, dealt by its minimiser. A segment of
    a hot minimiser gives a row with two hashes for each of its windows, and
    its windows' words are added up, a row for each different one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            single: dict[tuple[int, int], list] = {}
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = body.as_py().split()
                pair = None
                for s in own:
                    start, n = s["start"], s["n"]
                    if not s["hot"]:
                        rows.append((s["key"], s["digest"], s["weight"], b" ".join(words[start : start + n - 1 + window]), s["key"], s["digest"], False, None, None))
                        continue
                    if pair is None:
                        data = np.frombuffer(body.as_py(), np.uint8)
                        every = K.Words(data, np.array([0, len(data)]))
                        pair = [K.windows(every.hashes(family=f), window).view(np.int64).tolist() for f in (0, 1)]
                    deals, codes = (p[start : start + n] for p in pair)
                    rows.append((s["key"], s["digest"], s["weight"], None, None, None, True, deals, codes))
                    for k, place in enumerate(zip(deals, codes, strict=True)):
                        if place in single:
                            single[place][0] += s["weight"]
                        else:
                            single[place] = [s["weight"], b" ".join(words[start + k : start + k + window])]
                if len(rows) + len(single) >= 20_000:
                    yield _batch(rows, single)
                    rows, single = [], {}
            yield _batch(rows, single)

    return run


def _batch(rows: list[tuple], single: dict[tuple[int, int], list]) -> pa.RecordBatch:
    rows = rows + [(None, None, weight, words, deal, code, True, None, None) for (deal, code), (weight, words) in single.items()]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in _CONTENTS.split(", ")])


def _marked(shared):
    """Runs of repeated windows of hot segments, by a broadcast set of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(zip(*shared.value, strict=True))
        for batch in batches:
            out: list[tuple] = []
            for key, digest, deals, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit = np.array([0, *(p in known for p in zip(deals, codes, strict=True)), 0], np.int8)
                edge = np.diff(hit)
                out += [(key, digest, int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "digest", "a", "b"])

    return run


class Automaton:
    """A suffix automaton of several word sequences, with the weighted number of places of each state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]

    def _new(self, length: int, step: dict, link: int) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        self.weight.append(0)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list, weight: int) -> None:
        step, link, length = self.next, self.link, self.length
        last = 0
        for word in sequence:
            q = step[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                state = self._new(length[last] + 1, {}, 0)
                p = last
                while p >= 0 and word not in step[p]:
                    step[p][word] = state
                    p = link[p]
                if p >= 0:
                    q = step[p][word]
                    link[state] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = state
            self.weight[last] += weight

    def finish(self, window: int) -> None:
        """Sum the places over suffix links; find the state that holds each state's suffix of ``window`` words."""
        length = np.array(self.length)
        link, weight = self.link, self.weight
        order = np.argsort(length, kind="stable").tolist()
        for s in reversed(order[1:]):
            if link[s] >= 0:
                weight[link[s]] += weight[s]
        top = list(range(len(link)))
        for s in order[1:]:
            if self.length[link[s]] >= window:
                top[s] = top[link[s]]
        self.many = [weight[t] >= 2 and self.length[s] >= window for s, t in enumerate(top)]

    def statistics(self, sequence: list) -> Iterator[int]:
        """For each place of a sequence: the length of the longest run of words ending there that the references hold."""
        state = m = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                m = self.length[state]
            state = self.next[state].get(word, 0)
            m = m + 1 if state else 0
            yield m

    def repeats(self, sequence: list, window: int) -> list[bool]:
        """For each window of a sequence: whether its words are in two or more places.

        Streamed word by word: ``m`` is the matching statistic, the length of
        the longest suffix read so far that the references hold.
        """
        state = m = 0
        out = []
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                m = self.length[state]
            state = self.next[state].get(word, 0)
            m = m + 1 if state else 0
            while m > window and self.length[self.link[state]] >= window:
                state = self.link[state]
                m = self.length[state]
            if i >= window - 1:
                out.append(m >= window and self.many[state])
        return out


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's spans by start, those that meet or overlap as one."""
    for batch in batches:
        every = batch.column(1)
        row = np.repeat(np.arange(len(every)), np.diff(every.offsets.to_numpy()))
        far = row << 40  # keeps rows apart on one line
        start, end = (every.flatten().field(i).to_numpy() + far for i in (0, 1))
        order = np.lexsort((end, start))
        start, upto, row = start[order], np.maximum.accumulate(end[order]), row[order]
        new = np.ones(len(row), bool)
        new[1:] = (start[1:] > upto[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(row))[: len(head)] - 1
        row = row[head]
        spans = pa.StructArray.from_arrays([pa.array(start[head] - (row << 40)), pa.array(upto[last] - (row << 40))], names=["start", "end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(every) + 1)).astype(np.int32)), spans)], names=["doc", "spans"])


def _matched(shared, window: int):
    """Spans of words, ``window`` or longer, that the broadcast reference shards hold, by matching statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _reference_automata(shared.value)
        for batch in batches:
            keep, found = [], []
            for i, body in enumerate(batch.column(1)):
                words = body.as_py().split()
                spans = []
                for ids, automaton in shards if len(words) >= window else ():
                    for end, m in enumerate(automaton.statistics([ids.get(w, -1) for w in words]), 1):
                        if m >= window:
                            spans.append({"start": end - m, "end": end})
                if spans:
                    keep.append(i)
                    found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(found, _SPANS)], names=["doc", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_references: list[tuple] = []


def _reference_automata(shards: list[list[bytes]]) -> list[tuple[dict[bytes, int], Automaton]]:
    """The automata of broadcast shards, built once in a worker process."""
    if not _references or _references[0][0] is not shards:
        built = []
        for texts in shards:
            ids: dict[bytes, int] = {}
            automaton = Automaton()
            for text in texts:
                automaton.add([ids.setdefault(w, len(ids)) for w in text.split()], 1)
            built.append((ids, automaton))
        _references[:] = [(shards, built)]
    return _references[0][1]


def reference_spans(docs: DataFrame, references: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", shard_words: int = SHARD_WORDS, round_words: int = 10 * SHARD_WORDS) -> DataFrame:
    """(doc, spans): for each text, the word ranges of ``window`` words or more that stand in a reference.

    The references' texts are dealt into shards; each round broadcasts the
    shards of at most ``round_words`` words (and one longer text at most), and
    every document is streamed once through their suffix automata. So the work
    is documents times references: this is for a set of references that is
    small beside the documents. For documents against each other there is
    :func:`repeated_spans`. Null texts have no spans and are no references.
    """
    own = references.where(F.col(reference_col).isNotNull()).select(F.col(reference_col).alias("t")).distinct()
    counted = stored(own.select("t", F.size(F.split(F.trim(F.regexp_replace("t", "[\\x20\\x09-\\x0D]+", " ")), " ")).cast("long").alias("n")), "references")
    rounds = max(1, -(-int(counted.agg(F.sum("n")).first()[0] or 0) // round_words))
    base = docs.select(row_key(id_col, text_col).alias("doc"), raw(text_col).alias("body"))
    kind = f"doc {base.schema['doc'].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint>>"
    parts: list[DataFrame] = []
    for i in range(rounds):
        shards: list[list[bytes]] = [[]]
        size = 0
        for r in counted.where(F.pmod(F.xxhash64("t"), F.lit(rounds)) == i).toLocalIterator():
            if size and size + r["n"] > shard_words:
                shards.append([])
                size = 0
            shards[-1].append(r["t"].encode())
            size += r["n"]
        shared = docs.sparkSession.sparkContext.broadcast(shards)
        parts.append(stored(base.mapInArrow(_matched(shared, window), kind), "matches"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    spans = every.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = stored(spans.mapInArrow(_united, spans.schema), "spans")
    discard(counted, *parts)
    return out


def _shard(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        K.give_back()  # what the last shard took
        ids: dict[bytes, int] = {}
        automaton = Automaton()
        sequences = []
        for words, weight in zip(group["words"], group["weight"], strict=True):
            sequence = [ids.setdefault(w, len(ids)) for w in words.split(b" ")]
            sequences.append(sequence)
            automaton.add(sequence, int(weight))
        automaton.finish(window)
        out = []
        for deal, code, hot, sequence in zip(group["deal"], group["code"], group["hot"], sequences, strict=True):
            hit = np.concatenate([[0], np.array(automaton.repeats(sequence, window), np.int8), [0]])
            edge = np.diff(hit)
            out += [(deal, code, hot, a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        return pd.DataFrame(out, columns=["deal", "code", "hot", "a", "b"])

    return run


def repeated_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc, spans): for each text with repeats, the word ranges [start, end) that repeated windows cover.

    ``doc`` is :func:`row_key`. A window is ``window`` consecutive words
    (``[^\\x20\\x09-\\x0D]+``) of one text; it is repeated if the same words
    start anywhere else, in the same text or another. Repeated rows are other
    places. Texts below ``window`` words, null or empty, have none.
    """
    base = docs.select(row_key(id_col, text_col).alias("doc"), raw(text_col).alias("body"))
    segments = stored(base.mapInArrow(_segments(window), f"key long, digest long, doc {base.schema['doc'].dataType.simpleString()}, start long, n int, own boolean"), "segments")
    keys = segments.groupBy("key").agg(F.count("*").alias("places"), F.max("own").alias("own")).where("places > 1 or own").select("key")
    again = stored(segments.join(keys, "key"), "again")
    discard(segments)
    variants = again.groupBy("key", "digest").agg(F.count("*").alias("weight"), F.min(F.struct("doc", "start", "n")).alias("at"))
    size = F.col("at.n") + F.lit(window - 1)
    hot = variants.groupBy("key").agg(F.sum(size).alias("size")).where(f"size > {shard_words}").select("key", F.lit(True).alias("hot"))
    variants = stored(variants.join(hot, "key", "left").select("key", "digest", "weight", "at.*", F.coalesce("hot", F.lit(False)).alias("hot")), "variants")
    wanted = variants.groupBy("doc").agg(F.collect_list(F.struct("key", "digest", "weight", "start", "n", "hot")).alias("own"))
    ids = variants.select("doc").distinct()
    texts = base.join(F.broadcast(ids), "doc", "left_semi") if ids.count() <= BROADCAST_IDS else base
    held = wanted.join(texts, "doc").dropDuplicates(["doc"])  # equal rows are one text with their number as weight
    contents = stored(held.select("own", "body").mapInArrow(_contents(window), _CONTENTS), "contents")
    discard(variants)
    whole = contents.where("not hot").select("deal", "code", "weight", "words", "hot")
    single = contents.where("hot and words is not null").groupBy("deal", "code").agg(F.sum("weight").alias("weight"), F.min("words").alias("words"), F.lit(True).alias("hot"))
    items = stored(whole.union(single), "items")
    total = items.agg(F.sum(F.size(F.split(F.col("words").cast("string"), " ")))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_words))
    found = stored(items.groupBy(F.pmod(F.xxhash64("deal"), F.lit(shards)).alias("shard")).applyInPandas(_shard(window), "deal long, code long, hot boolean, a int, b int"), "repeats")
    discard(items)
    ranges = found.where("not hot").select(F.col("deal").alias("key"), F.col("code").alias("digest"), "a", "b")
    twice, hot_rows = found.where("hot").select("deal", "code"), contents.where("deals is not null").select("key", "digest", "deals", "codes")
    if twice.count() <= broadcast_windows:
        table = twice.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((table["deal"].to_pylist(), table["code"].to_pylist()))
        windows = hot_rows.mapInArrow(_marked(shared), "key long, digest long, a int, b int")
    else:
        one = hot_rows.select("key", "digest", F.posexplode(F.arrays_zip("deals", "codes")).alias("a", "w")).select("key", "digest", "a", F.col("w.deals").alias("deal"), F.col("w.codes").alias("code"))
        windows = one.join(twice, ["deal", "code"]).select("key", "digest", "a", (F.col("a") + 1).alias("b"))
    runs = ranges.union(windows).groupBy("key", "digest").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    shift = lambda r: F.struct((F.col("start") + r["a"]).alias("start"), (F.col("start") + r["b"] - 1 + window).alias("end"))
    places = again.join(runs, ["key", "digest"]).select("doc", F.transform("runs", shift).alias("s"))
    spans = places.groupBy("doc").agg(F.flatten(F.collect_list("s")).alias("spans"))
    out = stored(spans.mapInArrow(_united, spans.schema), "spans")
    discard(again, contents, found)
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's id and a hash of its text: rows that repeat an id stay apart unless they are equal."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))


def with_spans(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, broadcast_windows: int = BROADCAST_WINDOWS, references: DataFrame | None = None) -> DataFrame:
    """``docs`` and ``_spans`` (null where nothing repeats, or stands in ``references``). The spans go to the texts, not the other way, while they are small."""
    spans = repeated_spans(docs, window, id_col, text_col, shard_words, broadcast_windows) if references is None else reference_spans(docs, references, window, id_col, text_col)
    size = spans.agg(F.sum(F.lit(40) + 24 * F.size("spans"))).first()[0] or 0
    spans = spans.select(F.col("doc").alias("_doc"), F.col("spans").alias("_spans"))
    side = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    return docs.withColumn("_own", row_key(id_col, text_col)).join(side, F.col("_own") == F.col("_doc"), "left").drop("_own", "_doc")


def _mask(n: int, spans) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, kept = [], [], []
        for body, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = body.as_py().split()
            out = _mask(len(words), spans)
            n.append(len(words))
            gone.append(int(out.sum()))
            kept.append(hashlib.sha256(b" ".join([w for w, x in zip(words, out, strict=True) if not x] if spans else words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, left, gone = [], [], []
        for body, spans in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            body = body.as_py()
            data = np.frombuffer(body, np.uint8)
            words = K.Words(data, np.array([0, len(data)]))
            out = _mask(len(words.row), spans)
            keep = np.ones(len(data), bool)
            stop = np.append(words.start[1:], len(data))
            for i in np.flatnonzero(out):
                keep[words.start[i] : stop[i]] = False
            texts.append(data[keep].tobytes().decode())
            left.append(int((~out).sum()))
            gone.append(int(out.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(left, pa.int64()), pa.array(gone, pa.int64()), *batch.columns[2:]], names=["_new", "_left", "_gone", *batch.schema.names[2:]])


def removed(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", references: DataFrame | None = None) -> DataFrame:
    """``docs`` with repeated words cut out of the texts, and ``_left``, ``_gone``: words kept and removed.

    With ``references`` (a column text), what stands in them is cut out, not what repeats.

    A removed word goes with the white space behind it; all else stays as it
    was. A null text stays null.
    """
    own, names, of = hidden(docs, id_col, text_col)
    got = with_spans(own, window, of[id_col], of[text_col], references=references)
    rest = [c for c in names if c != of[text_col]]
    base = got.select(raw(of[text_col]).alias("_body"), "_spans", *rest, F.col(of[text_col]).isNull().alias("_null"))
    kind = "_new string, _left long, _gone long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[2:])
    out = base.mapInArrow(_cut, kind).withColumn(of[text_col], F.when(~F.col("_null"), F.col("_new")))
    return out.select(*names, "_left", "_gone").toDF(*docs.columns, "_left", "_gone")


def op3_substring_dedup(spark: SparkSession, sf_dir: str, window: int = 35) -> DataFrame:
    """Windows of 35 words over the whole of ``documents``; digests of what is kept."""
    got = with_spans(documents(spark, sf_dir).select("doc_id", "text"), window)
    return got.select("doc_id", raw("text").alias("body"), "_spans").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
