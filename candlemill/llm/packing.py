"""Mixture-controlled packing: deficit round robin over source queues."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, global_prefix, hashes_at, materialize, slices_of, word_spans

SEQUENCE, END = 4096, 2
#: A mixture window holds so many sequences; every window has the target proportions.
WINDOW_SEQUENCES = 16
#: Sources with a queue of their own; their totals meet on the driver. Smaller ones share a queue.
MOST_SOURCES = 100_000

#: White space of Unicode; str.split() also splits at 0x1C-0x1F, which tokenizers keep.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SEPARATORS = re.compile("[\\x1c-\\x1f]")
#: Bytes that a plain text can't hold. Plain texts are of ASCII and the letters À-ÖØ-öø-ÿ alone and are cut into the tokenizer's
#: own pieces (its split pattern, written for this range); their lower case and NFC form are the same everywhere.
_ODD = np.ones(256, dtype=bool)
_ODD[[9, 10, 13, *range(0x20, 0x7F), 0xC3, *range(0x80, 0xC0)]] = False
_ODD[[0x97, 0xB7]] = True  # after 0xC3 the signs for times and division
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \\t\\n\\ra-zß-öø-ÿ0-9]+")
#: The split pattern and word end of tokenizers for which the above holds.
WORD_SPLIT, WORD_END = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "</w>"
_CACHE_WORDS = 750_000
#: Pieces are Python objects, some 200 bytes each, and needed for new words only.
_CACHE_PIECES = 200_000


def split_words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()


class Encoder:
    """Token ids of whole columns of texts, each distinct word encoded once while remembered.

    With a lower-casing word tokenizer (one that drops white space and marks word ends) a
    text's ids are those of its white-space words one after the other, and those of a text
    of Latin letters are those of its pieces. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        setup, vocab = json.loads(self.tok.to_str()), self.tok.get_vocab()
        self.dtype = "<u2" if len(vocab) <= 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        steps = (setup.get("normalizer") or {}).get("normalizers", [])
        splits = (setup.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            setup["model"].get("end_of_word_suffix") == WORD_END
            and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and [x.get("pattern", {}).get("Regex") for x in splits][:1] == [WORD_SPLIT]
        )
        self.pieces: dict[str, bytes] = {}  # of plain words
        self.words: dict[str, bytes] = {}  # any other words, as they are
        # hashes of plain words in order, and their places: place 0 is the id that ends a document
        self.known, self.place = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.ids, self.first = np.array([END], dtype=self.dtype), np.array([0, 1])

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        runs, width = [new[i : i + 256] for i in range(0, len(new), 256)], np.dtype(self.dtype).itemsize
        for run, e in zip(runs, self.tok.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * width
            if len(cuts) != len(run):
                raise ValueError("the tokenizer doesn't end each piece with a word end")
            raw, start = ids.tobytes(), 0
            for piece, end in zip(run, cuts.tolist()):
                self.pieces[piece], start = raw[start:end], end

    def _ids_of_plain(self, new: list[str]) -> list[bytes]:
        # most words are letters, or letters and one mark
        split = [(w,) if w.isalpha() else (w[:-1], w[-1]) if w[:-1].isalpha() and w[-1] in ".,!" else _PIECE.findall(w) for w in new]
        self._learn_pieces(list(set().union(*split).difference(self.pieces)))
        return [b"".join(map(self.pieces.__getitem__, s)) for s in split]

    def _forget(self) -> None:
        """Keeps the words seen first, which are the commonest."""
        for name, most in (("pieces", _CACHE_PIECES), ("words", _CACHE_WORDS)):
            if len(cache := getattr(self, name)) > most:
                setattr(self, name, dict(islice(cache.items(), most * 2 // 3)))
        if len(self.place) > _CACHE_WORDS:
            keep = _CACHE_WORDS * 2 // 3
            kept = self.place < keep
            self.known, self.place = self.known[kept], self.place[kept]
            self.first = self.first[: keep + 1]
            self.ids = self.ids[: self.first[-1]]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts one after the other, each with its end, and where each text's ids start."""
        data, ends = bytes_of(pc.utf8_lower(texts))
        first, inside = word_spans(data, ends, "space")
        starts = np.flatnonzero(first)
        own, at, which = np.unique(hashes_at(data, starts, "space"), return_index=True, return_inverse=True)
        near = np.searchsorted(self.known, own)
        places = np.full(len(own), -1, dtype=np.int64)
        hit = np.flatnonzero(np.append(self.known, np.uint64(0))[near] == own)
        hit = hit[near[hit] < len(self.known)]
        places[hit] = self.place[near[hit]]
        new = np.flatnonzero(places < 0)
        if len(new):
            stop = np.flatnonzero(~inside | np.append(first[1:], True))  # where a word ends, or the byte before another
            begin = starts[at[new]]
            last = stop[np.searchsorted(stop, begin)]
            last += inside[last]
            raw = data.tobytes()
            ids = self._ids_of_plain([raw[s:e].decode() for s, e in zip(begin.tolist(), last.tolist())])
            places[new] = np.arange(len(self.first) - 1, len(self.first) - 1 + len(new))
            self.known, self.place = np.insert(self.known, near[new], own[new]), np.insert(self.place, near[new], places[new])
            sizes = np.cumsum([len(x) for x in ids]) // self.ids.itemsize
            self.first = np.append(self.first, self.first[-1] + sizes)
            self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), dtype=self.dtype))
        where = np.searchsorted(starts, ends)
        word = np.insert(places[which], where[1:], 0)
        begin, size = self.first[word], np.diff(self.first)[word]
        after = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.append(0, after[where[1:] + np.arange(len(texts))])

    def _others(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.by_word:
            split = [split_words(t) for t in texts]
            new = list(set().union(*split).difference(self.words))
            for word, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
                self.words[word] = self._bytes(e.ids)
            found = [b"".join(map(self.words.__getitem__, words)) for words in split]
        else:
            found = [self._bytes(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        end = self._bytes([END])
        return np.frombuffer(b"".join(x + end for x in found), dtype=self.dtype), np.cumsum([0, *(len(x) // len(end) + 1 for x in found)])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids, starts): ids of the texts of some rows one after the other, each followed by id 2; every row comes once."""
        self._forget()
        data, ends = bytes_of(texts)
        odd = np.union1d(np.flatnonzero(_ODD[data]), np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)))  # 60, 124: "<|"
        plain = np.diff(np.searchsorted(odd, ends)) == 0 if self.by_word else np.zeros(len(texts), dtype=bool)
        for rows, work in ((np.flatnonzero(plain), self._plain), (np.flatnonzero(~plain), lambda t: self._others(t.to_pylist()))):
            if len(rows):
                yield rows, *work(texts.take(pa.array(rows)))


_ENCODERS: dict[str, Encoder] = {}


def _tokenize(path: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in (part for whole in batches for part in slices_of(whole, size=1 << 20)):
            for rows, ids, starts in encoder.encode(batch.column("text")):
                at, width = pa.array(rows), ids.itemsize
                places = pa.py_buffer(np.ascontiguousarray(starts * width, dtype=np.int32))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(at),
                        "source": batch.column("source").take(at),
                        "n": pa.array(np.diff(starts).astype(np.int64)),
                        "width": pa.array(np.full(len(rows), width, dtype=np.int32)),
                        "ids": pa.Array.from_buffers(pa.binary(), len(rows), [None, places, pa.py_buffer(np.ascontiguousarray(ids))]),
                    }
                )
        pa.default_memory_pool().release_unused()  # the worker stays for other stages

    return tokenize


@dataclass
class Service:
    """When deficit round robin serves each queue, in closed form.

    A queue of weight w gets w tokens a round while it lasts, fractions being carried as its deficit, so its
    token x is served in round first + x / w. ``tokens`` counts what all queues together
    have been served by the end of each of ``rounds``, the rounds in which queues run dry; between these
    it grows evenly, the shares of queues that are dry going to the others in proportion.
    """

    weight: np.ndarray
    first: np.ndarray
    rounds: np.ndarray
    tokens: np.ndarray

    def window(self, queue: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        """The window in which a queue's token number ``x`` is served (never falls as x grows)."""
        served = np.interp(self.first[queue] + (x + 0.5) / self.weight[queue], self.rounds, self.tokens)
        return (served // size).astype(np.int64)

    def cuts(self, queue: np.ndarray, x0: np.ndarray, x1: np.ndarray, size: int):
        """Pieces of the queues' stretches [x0, x1) at window ends: (stretch, start, end, window)."""
        w0, w1 = self.window(queue, x0, size), self.window(queue, x1 - 1, size)
        n = w1 - w0 + 1
        owner = np.repeat(np.arange(len(x0)), n)
        w = w0[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        low, high = x0[owner], x1[owner].copy()  # the first token of a later window, by bisection
        low = np.where(w == w1[owner], high, low)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            later = self.window(queue[owner], mid, size) > w
            high = np.where(open_ & later, mid, high)
            low = np.where(open_ & ~later, mid + 1, low)
        start = np.where(w == w0[owner], x0[owner], np.concatenate([[0], low[:-1]]))
        full = low > start
        return owner[full], start[full], low[full], w[full]


def service(totals: np.ndarray, weight: np.ndarray) -> Service:
    """Deficit round robin over queues of ``totals`` tokens; queues without weight follow when the others are dry."""
    weight, totals = np.maximum(np.nan_to_num(weight.astype(float)), 0.0), totals.astype(float)
    late = weight <= 0
    own = np.where(late, totals, weight)  # of those, each its part of what they hold
    first = np.where(late, (totals[~late] / own[~late]).max(initial=0.0), 0.0)
    dry = first + totals / own
    rounds = np.unique(np.concatenate([[0.0], first, dry]))
    began, ended = np.searchsorted(rounds, first), np.searchsorted(rounds, dry)
    speed = np.zeros(len(rounds))
    np.add.at(speed, began, own)
    np.subtract.at(speed, ended, own)
    tokens = np.concatenate([[0.0], np.cumsum(np.cumsum(speed)[:-1] * np.diff(rounds))])
    return Service(own, first, rounds, tokens)


def _serve(plan: Service, starts: np.ndarray, size: int):
    """Cuts documents where their queue's service passes from one window to the next."""

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, n, place, queue = (batch.column(c).to_numpy() for c in ("uid", "n", "place", "queue"))
            x0 = place - starts[queue]
            owner, s, e, w = plan.cuts(queue, x0, x0 + n, size)
            cols = [uid[owner], s - x0[owner], e - s, w, queue[owner], s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64)) for c in cols], names=["uid", "start", "length", "window", "queue", "queue_at"]
            )

    return serve


def sequence_bounds(total: int, sequence: int = SEQUENCE) -> tuple[int, list[int]]:
    """Where the last, incomplete sequence starts, and the starts of the power-of-two sequences it becomes."""
    tail = total - total % sequence
    starts, at, left = [], tail, total - tail
    while left:
        starts.append(at)
        size = 1 << (left.bit_length() - 1)
        at, left = at + size, left - size
    return tail, starts


def cut_at_sequences(at: np.ndarray, length: np.ndarray, total: int, sequence: int):
    """Pieces of the stretches [at, at + length) at sequence ends: (stretch, start in it, length, sequence, offset)."""
    tail, late = sequence_bounds(total, sequence)
    late, full = np.array([*late, total], dtype=np.int64), tail // sequence

    def sequence_of(g: np.ndarray) -> np.ndarray:
        return np.where(g < tail, g // sequence, full + np.searchsorted(late, g, side="right") - 1)

    first = sequence_of(at)
    n = sequence_of(at + length - 1) - first + 1
    owner = np.repeat(np.arange(len(at)), n)
    seq = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin, end = (np.where(s < full, s * sequence, late[np.clip(s - full, 0, len(late) - 1)]) for s in (seq, seq + 1))
    low, high = np.maximum(begin, at[owner]), np.minimum(end, (at + length)[owner])
    return owner, low - at[owner], high - low, seq, low - begin


def _cut(total: int, sequence: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, start, length, at = (batch.column(c).to_numpy() for c in ("uid", "start", "length", "at"))
            owner, inside, n, seq, offset = cut_at_sequences(at, length, total, sequence)
            cols = [uid[owner], start[owner] + inside, n, seq, offset]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64)) for c in cols], names=["uid", "start", "length", "sequence_id", "offset"]
            )

    return cut


def pack(
    docs: DataFrame,
    tokenizer: str,
    targets: dict[str, float] | None = None,
    sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    temperature: float = 1.0,
) -> DataFrame:
    """Packs the tokens of all documents, each followed by id 2, into full sequences.

    Each source is a queue of its documents by doc_id, then as read. Deficit round robin serves the queues
    so that every window of ``window_sequences`` sequences has the target token proportions: ``targets`` by source (sources
    not named follow when the named ones are dry), by default each source's tokens to the power ``temperature`` (1: its part of all
    tokens; less: small sources come sooner). When a queue is dry, the others get its share in
    proportion. What a queue is owed is carried from window to
    window, so a queue's service has a closed form, and every task finds the windows of
    its documents from two numbers a source and the rounds in which queues run dry. Documents are cut where a window or a
    sequence ends. All sequences are full but the last, which becomes sequences of
    power-of-two lengths, so nothing is padded.

    The largest ``MOST_SOURCES`` sources have a queue of their own, all smaller ones share one, one source after the other.
    A null text counts as empty (one id), a null source as the empty name; texts of any length are cut wherever sequences end; equal rows are
    packed once each; an empty table gives no rows; further columns, whatever their names, are ignored.
    Returns a row for each piece: doc_id, start, length, ids (little-endian, ``width`` bytes
    each: 2 if the vocabulary allows), width, doc_tokens, sequence_id, offset, source.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")
    )
    tokens = materialize(
        plain.mapInArrow(_tokenize(tokenizer), "doc_id long, source string, n long, width int, ids binary").withColumn(
            "uid", F.monotonically_increasing_id()
        ),
        "tokens",
    )
    light = tokens.select("uid", "doc_id", "source", "n")
    sources = materialize(light.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    own = sorted((r["source"], r["n"]) for r in sources.orderBy(F.desc("n"), "source").limit(MOST_SOURCES).collect())
    rest = (sources.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in own)
    totals = np.array([n for _, n in own] + [rest] * bool(rest), dtype=np.int64)
    weight = totals.astype(float) ** temperature if targets is None else np.array([*(targets.get(s, 0.0) for s, _ in own), 0.0][: len(totals)])
    plan, starts = service(totals, weight), np.concatenate([[0], np.cumsum(totals)])
    queues = docs.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate(own)], "source string, queue long")
    light = light.join(F.broadcast(queues), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(own)).cast("long")))
    placed, total = global_prefix(light, [F.col("queue"), F.col("source"), F.col("doc_id"), F.col("uid")], "n", "place")
    served = placed.select("uid", "queue", "n", "place").mapInArrow(
        _serve(plan, starts, sequence * window_sequences),
        "uid long, start long, length long, window long, queue long, queue_at long",
    )
    ordered, _ = global_prefix(served, [F.col("window"), F.col("queue"), F.col("queue_at")], "length", "at")
    pieces = ordered.select("uid", "start", "length", "at").mapInArrow(
        _cut(total, sequence), "uid long, start long, length long, sequence_id long, offset long"
    )
    cut = F.expr("substring(ids, cast(width * start + 1 as int), cast(width * length as int))")
    return pieces.join(tokens, "uid").select(
        "doc_id", "start", "length", cut.alias("ids"), "width", F.col("n").alias("doc_tokens"), "sequence_id", "offset", "source"
    )


def digest(packed: DataFrame, *more: str) -> DataFrame:
    """The pieces with the checksum of their ids as unsigned 32-bit numbers; the ids only if ``more`` names them."""

    @F.pandas_udf("long")
    def checksum(ids: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, dtype=f"<u{w}").astype("<u4").tobytes()) for x, w in zip(ids, width)], dtype="int64")

    return packed.select(
        "doc_id", "start", "length", checksum("ids", "width").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", *more
    )
