"""Vector bin packing of token sequences for training."""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velaspan.llm.kernels import give_back
from velaspan.llm.memory import Memory, groups
from velaspan.llm.workspace import documents, raw

#: Words whose ids a worker remembers in each of two generations, and half of the parts of words (about 200 bytes each).
CACHE = 150_000
#: Tokens and examples that are packed together; more memory, better choice.
BLOCK_TOKENS, BLOCK_ITEMS = 2_000_000, 2_000

# The folding and cutting of a tokeniser file that texts may be cut by a plain pattern for.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _cuts_plainly(own: dict) -> bool:
    """Whether a tokeniser file folds, cuts and merges as those fixed values say, and marks the ends of words; all added tokens must be special."""
    steps, model = (own.get("pre_tokenizer") or {}).get("pretokenizers") or [], own["model"]
    cut = len(steps) == 2 and steps[0].get("pattern") == {"Regex": CUT} and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
    usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    special = all(t.get("special") for t in own.get("added_tokens") or [])
    return own.get("normalizer") == NORMALISER and cut and usual and special and model.get("end_of_word_suffix") == "</w>" and "~</w>" in model["vocab"]


class WordIds:
    """Ids (little-endian 32-bit) of texts. One per worker process, by :func:`word_ids`.

    Strings of special tokens in a text are ordinary text. A tokeniser that
    folds or cuts in another way than the following encodes whole texts as
    they are. The tokeniser drops white space and folds case before it cuts. A text of
    ASCII and Latin letters is cut the same way by a plain pattern; its ids are
    those of the parts in turn. Unknown parts are encoded together in one
    text, and told apart by the ids that end a word. In other texts the words
    between white space are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        own = json.loads(Path(path).read_text())
        self.plain = _cuts_plainly(own)
        if not self.plain:
            return
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.sign = vocabulary["~</w>"]
        # letters whose case folds one to one, and which never compose with each other
        self.other = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]").search
        self.cut = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+").findall
        self.words = Memory(self._words, CACHE)
        self.forget()
        # for parts, which are folded and cut already: the same merges, nothing left to fold, cut at spaces only, without a second cache
        self.folded = Tokenizer(models.BPE(own["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in own["model"]["merges"]], cache_capacity=0, end_of_word_suffix="</w>"))
        self.folded.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, parts: list[bytes]) -> None:
        """Add the ids of parts that have just been numbered."""
        ids = np.array(self.folded.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts) or stops[-1] != len(ids):
            each = [self._ids(p.decode()) for p in parts]
            ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
        self.stops = np.concatenate([self.stops, self.stops[-1] + stops])
        self.ids = np.concatenate([self.ids, ids])

    def _joined(self, cut: list[list[bytes]]) -> list[bytes]:
        """Ids of texts that are given as their parts."""
        if len(self.numbers) > 2 * CACHE:
            self._forget_parts()
        which = np.concatenate([np.fromiter(map(self.numbers.__getitem__, c), np.int64, len(c)) for c in cut])
        if not len(which):
            return [b""] * len(cut)
        if new := list(itertools.islice(self.numbers, len(self.stops) - 1, None)):
            self._learn(new)
        first, size = self.stops[which], np.diff(self.stops)[which]
        after = np.cumsum(size)
        data = self.ids[np.repeat(first - after + size, size) + np.arange(after[-1])].tobytes()
        ends = [0, *(4 * np.concatenate([[0], after])[np.cumsum([len(c) for c in cut])]).tolist()]
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _forget_parts(self) -> None:
        """Parts are numbered as they come; part i has the ids from stops[i] to stops[i + 1]."""
        self.numbers, self.ids, self.stops = defaultdict(itertools.count().__next__), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Drop what is remembered of texts: the process lives on, and what runs in it next needs the room."""
        if self.plain:
            self._forget_parts()
            self.words.forget()

    def _apart(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any kind, encoded together with a sign between them that none of them has."""
        ids = self._ids(b" ~ ".join(words).decode())
        stops = np.flatnonzero(ids == self.sign)
        if len(stops) != len(words) - 1:
            return [self._ids(w.decode()).tobytes() for w in words]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(4 * stops + 4).tolist()], [*(4 * stops).tolist(), len(data)], strict=True)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        rest = [w for w in words if b"~" not in w]
        out = dict(zip(rest, self._apart(rest) if rest else [], strict=True))
        return [out[w] if w in out else self._ids(w.decode()).tobytes() for w in words]

    def texts(self, bodies: list[bytes]) -> list[bytes]:
        if not self.plain:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch([b.decode() for b in bodies], add_special_tokens=False)]
        cut: list[list[bytes]] = []
        odd: set[int] = set()
        for i, body in enumerate(bodies):
            if body.isascii():
                cut.append(self.cut(body.lower()))
            elif self.other(text := body.decode()):
                odd.add(i)
                cut.append(body.split())
            else:
                cut.append(self.cut(text.lower().encode()))
        strange = {w for i in odd for w in cut[i]}
        words = self.words.having(strange) if strange else {}
        plain = iter(self._joined([c for i, c in enumerate(cut) if i not in odd]) if len(odd) < len(cut) else [])
        return [b"".join(map(words.__getitem__, c)) if i in odd else next(plain) for i, c in enumerate(cut)]


@functools.lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Place examples under limits on tokens, segments and loss-bearing tokens of a sequence.

    One sequence is filled at a time. Of the examples that fit, it takes the
    one with the largest dot product of its demands and the room left, each as
    a share of its limit: the dimension that is emptiest counts most. If none
    fits and ``cut`` is set, the one that fills most of it is cut to the room
    left. Without ``cut``, what fits nowhere starts the next sequence;
    an example beyond a limit of its own is cut at that limit all the same.
    """

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, first: int):
        self.limit = np.array([tokens, segments, loss], np.float64)
        self.tokens, self.cut, self.next = tokens, cut, first

    def pack(self, size: np.ndarray, loss: np.ndarray, last: bool) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
        """Pieces (example, start, length, sequence, offset), and for what stays open: example -> start.

        ``loss`` is the share of loss-bearing tokens of each example.
        """
        out: list[tuple[int, int, int, int, int]] = []
        start = np.zeros(len(size), np.int64)
        left = size.astype(np.int64).copy()
        whole = self.tokens if not len(loss) or self.limit[2] >= self.tokens else 0
        for i in np.flatnonzero(left >= self.tokens) if whole else ():
            while left[i] >= self.tokens:
                out.append((int(i), int(start[i]), self.tokens, self.next, 0))
                self.next += 1
                start[i] += self.tokens
                left[i] -= self.tokens
        live = np.flatnonzero(left > 0)
        live = live[np.argsort(-left[live], kind="stable")]
        while len(live):
            room = self.limit.copy()
            bin_: list[tuple[int, int, int, int, int]] = []
            offset = 0
            need, part = left[live], loss[live]
            bears = np.ceil(need * part)
            while len(live) and room[0] >= 1 and room[1] >= 1:
                fits = (need <= room[0]) & (bears <= room[2])
                score = need / self.limit[0] * (room[0] / self.limit[0]) + room[1] / self.limit[1] ** 2 + bears / self.limit[2] * (room[2] / self.limit[2])
                if fits.any():
                    j = int(np.argmax(np.where(fits, score, -1)))
                    take = int(need[j])
                elif self.cut or not bin_:
                    takes = np.minimum(np.minimum(need, room[0]), np.floor(room[2] / np.maximum(part, 1e-9)))
                    j = int(np.argmax(np.where(takes == takes.max(), score, -1)))
                    take = int(takes[j])
                    if take < 1:
                        break
                else:
                    break
                i = int(live[j])
                bin_.append((i, int(start[i]), take, self.next, offset))
                offset += take
                room -= (take, 1, np.ceil(take * loss[i]))
                start[i] += take
                left[i] -= take
                if left[i]:
                    need[j], bears[j] = left[i], np.ceil(left[i] * loss[i])
                else:
                    stay = np.arange(len(live)) != j
                    live, need, part, bears = live[stay], need[stay], part[stay], bears[stay]
            if not len(live) and not last and offset < self.tokens:
                back: dict[int, int] = {}
                for i, at, _, _, _ in bin_:
                    back[i] = min(at, back.get(i, at))
                return out, back
            out += bin_
            self.next += 1
        return out, {}

    def halved(self, pieces: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Lay a sequence that isn't full out again as sequences whose lengths are powers of two."""
        total = sum(p[2] for p in pieces)
        out, at, todo = [], 0, [list(p) for p in pieces]
        for bit in reversed(range(total.bit_length())):
            room = total & 1 << bit
            if not room:
                continue
            at = 0
            while room:
                i, start, length, _, _ = todo[0]
                take = min(length, room)
                out.append((i, start, take, self.next, at))
                at += take
                room -= take
                todo[0][1] += take
                todo[0][2] -= take
                if not todo[0][2]:
                    todo.pop(0)
            self.next += 1
        return out


def _rows(path: str, end: int, limits: tuple[int, int, int], cut: bool, halve: bool, slack: int, share: bool, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        tail = np.array([end], "<u4").tobytes()
        packer = Packer(*limits, cut, TaskContext.get().partitionId() << 33)
        held: list[tuple[object, int, bytes, float]] = []  # id, start, ids, share of loss

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            size = np.array([len(h[2]) // 4 - h[1] for h in held], np.int64)
            pieces, back = packer.pack(size, np.array([h[3] for h in held]), last)
            if halve and pieces:
                by: dict[int, int] = {}
                for p in pieces:
                    by[p[3]] = by.get(p[3], 0) + p[2]
                short = {s: [] for s, n in by.items() if n & n - 1 and n < limits[0] - slack}
                for p in pieces:
                    if p[3] in short:
                        short[p[3]].append(p)
                pieces = [p for p in pieces if p[3] not in short] + [x for own in short.values() for x in packer.halved(own)]
            cols: list[list] = [[], [], [], [], [], [], [], []]
            for i, start, length, seq, offset in pieces:
                key, before, ids, _ = held[i]
                own = ids[4 * (before + start) : 4 * (before + start + length)]
                for c, v in zip(cols, (key, before + start, length, zlib.crc32(own), len(ids) // 4, seq, offset, np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None), strict=True):
                    c.append(v)
            held[:] = [(held[i][0], held[i][1] + at, held[i][2], held[i][3]) for i, at in back.items()]
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds, strict=True))[: 7 + with_ids]], names=NAMES[: 7 + with_ids])

        total = 0
        for batch in batches:
            shares = batch.column(2).to_pylist() if share else [1.0] * len(batch)
            bodies = (ids for group in groups(b.as_py() for b in batch.column(1)) for ids in words.texts(group))
            for key, ids, part in zip(batch.column(0).to_pylist(), bodies, shares, strict=True):
                ids += tail
                held.append((key, 0, ids, min(1.0, max(0.0, 1.0 if part is None else part))))
                total += len(ids) // 4
                if total >= BLOCK_TOKENS or len(held) >= BLOCK_ITEMS:
                    yield from flush(False)
                    total = sum(len(h[2]) // 4 - h[1] for h in held)
        if held:
            yield from flush(True)
        held.clear()
        words.forget()
        give_back()

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def packed(docs: DataFrame, path: str, tokens: int = 4096, segments: int = 1024, loss: int = 4096, end: int = 2, cut: bool = True, halve: bool = True, slack: int = 0, loss_share: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token ids of every text, laid out in sequences: one row per piece.

    A text's ids are those of the word tokeniser in ``path``, then ``end``;
    null or wordless texts have ``end`` alone. ``loss_share`` names a column
    with the share of loss-bearing tokens (null: 1, and held between 0 and 1).
    Every id is in exactly one piece. With ``cut``, a sequence is left below
    ``tokens`` only by the limit on segments or loss-bearing tokens, or as the
    last of a partition; ``halve`` lays such sequences out again as powers of
    two, which need no padding, if they lack more than ``slack`` tokens. Each partition is packed by itself in blocks of bounded
    size, without a shuffle; sequence ids hold the partition's number, so a
    task that runs again gives the same rows. Repeated ids are separate
    examples; other columns are ignored; an empty table gives no rows.
    """
    columns = [F.col(id_col).alias("doc_id"), raw(text_col).alias("body")] + ([F.col(loss_share).cast("double").alias("share")] if loss_share else [])
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(*columns).mapInArrow(_rows(path, end, (tokens, segments, loss), cut, halve, slack, bool(loss_share), with_ids), kind)


#: Limits of the query: segments and loss-bearing tokens of a sequence. What such a sequence lacks at most is padded, not laid out again.
SEGMENTS, LOSS = 64, 4032
SLACK = 4096 - LOSS


def loss_share(text_col: str = "text") -> Column:
    """Share of loss-bearing tokens of a text whose first line is the prompt (one line: its first half); null or empty: all."""
    size, line = F.length(text_col), F.locate("\n", F.col(text_col))
    return F.when(size > 0, 1 - F.when(line > 0, line).otherwise(F.floor(size / 2)) / size).otherwise(1.0)


def op4_vector_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens, SEGMENTS pieces and LOSS loss-bearing tokens; the first line of a text bears none."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text", loss_share().alias("loss_share"))
    return packed(docs, path or public_tokenizers.path("word_bpe_49k.json"), segments=SEGMENTS, loss=LOSS, slack=SLACK, loss_share="loss_share")
