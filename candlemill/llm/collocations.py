"""Phrase collocations: Apriori passes whose next candidates are thinned by hashed bucket counts (PCY, DHP)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, hashes_at, materialize, mix64, rolling, slices_of, word_spans

#: Buckets, and bits of the filter of frequent phrases: powers of two within these bounds, so a bitmap has 8 MB at most.
FEWEST, MOST = 1 << 16, 1 << 26
#: Bytes of text for one bucket, bits for one frequent phrase.
TEXT_A_BUCKET, BITS_A_PHRASE = 64, 16
#: Buckets travel in ranges of this width; text looked at together.
RANGE, SLICE = 1 << 16, 1 << 21
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CUTS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
SCANNED = "lang string, phrase string, n long, range int, counts binary"


def _power_of_two(n: int) -> int:
    return 1 << (min(max(n, FEWEST), MOST) - 1).bit_length()


def _salts(langs: pa.Array) -> np.ndarray:
    """A random number for each row's language."""
    coded = langs.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.empty(0, dtype=np.uint64)


def _grams(hashes: np.ndarray, salts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of k words in the language of their first word; as many as there are words (the last k - 1 mean nothing)."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    found = rolling(hashes, k)
    out[: len(found)] = mix64(found ^ salts[: len(found)])
    return out


def _has(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    slot = grams & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _add(counts: np.ndarray, grams: np.ndarray) -> None:
    """Counts grams in their buckets, up to 255; a limit below that is met by saturated counts if and only if by true ones."""
    slot, n = np.unique(grams & np.uint64(len(counts) - 1), return_counts=True)
    slot = slot.astype(np.int64)
    counts[slot] = np.minimum(counts[slot].astype(np.int64) + n, 255)


def _ranges(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The buckets that hold something, range by range: offsets of two bytes, then counts of one."""
    for at in range(0, len(counts), RANGE):
        part = counts[at : at + RANGE]
        some = np.flatnonzero(part)
        if len(some):
            yield at // RANGE, some.astype(np.uint16).tobytes() + part[some].tobytes()


def _bitmap(counts: DataFrame, buckets: int, support: int) -> np.ndarray:
    """One bit a bucket: whether its summed count reaches ``support``. Sums are made in tasks, a range in 64 kB."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros(RANGE, dtype=np.int64), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"range": pa.array([last], pa.int32()), "bits": pa.array([np.packbits(total >= support, bitorder="little").tobytes()])})

        for batch in batches:
            for at, raw in zip(batch.column("range").to_pylist(), batch.column("counts")):
                if last is not None and at != last:
                    yield done()
                    total[:] = 0
                data = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                n = len(data) // 3
                total[data[: 2 * n].view(np.uint16)] += data[2 * n :]
                last = at
        if last is not None:
            yield done()

    dealt = counts.select("range", "counts").repartition("range").sortWithinPartitions("range")
    bits = np.zeros(buckets // 8, dtype=np.uint8)
    for at, raw in dealt.mapInArrow(add_up, "range int, bits binary").collect():
        bits[at * RANGE // 8 : (at + 1) * RANGE // 8] = np.frombuffer(raw, dtype=np.uint8)
    return bits


def _filter(frequent: DataFrame, k: int, rows: int) -> np.ndarray:
    """One bit a hash slot, set for all frequent phrases of k words; a phrase that isn't frequent finds one by chance in at most one of 16 cases, until MOST bounds it."""
    bits = _power_of_two(BITS_A_PHRASE * rows)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(bits, dtype=np.uint8)
        for batch in batches:
            data, ends = bytes_of(batch.column("phrase"))
            hashes = hashes_at(data, np.flatnonzero(word_spans(data, ends, "pieces")[0]), "pieces")
            _add(counts, _grams(hashes, np.repeat(_salts(batch.column("lang")), k), k)[::k])
        for at, raw in _ranges(counts):
            yield pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "counts": pa.array([raw])})

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(mark, "range int, counts binary"), bits, 1)


def _scan(k: int, shorter: np.ndarray | None, bucket: np.ndarray | None, buckets: int):
    """Pass k: counts of the phrases of k words that may be frequent, and bucket counts of the phrases of k + 1 words that consist of such.

    ``shorter`` is the filter of frequent phrases of k - 1 words, ``bucket`` the bitmap of pass k - 1; ``buckets`` is 0 in the last pass.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.uint8)
        for batch in (part for whole in batches for part in slices_of(whole, size=SLICE)):
            data, ends = bytes_of(batch.column("text"))
            first, inside = word_spans(data, ends, "pieces")
            starts = np.flatnonzero(first)
            if not len(starts):
                continue
            hashes = hashes_at(data, starts, "pieces")
            text = np.searchsorted(ends, starts, side="right") - 1
            salts = _salts(batch.column("lang"))[text]
            piece = np.cumsum(_CUTS[data], dtype=np.int32)[starts] + text  # grows with every text and every cut

            def whole(n: int, piece: np.ndarray = piece) -> np.ndarray:
                out = np.zeros(len(piece), dtype=bool)
                if len(piece) >= n:
                    out[: len(piece) - n + 1] = piece[n - 1 :] == piece[: len(piece) - n + 1]
                return out

            grams, maybe = _grams(hashes, salts, k), whole(k)
            if k > 1:
                short = _has(shorter, _grams(hashes, salts, k - 1))
                maybe[:-1] &= short[:-1] & short[1:]
                maybe &= _has(bucket, grams)
            if buckets:
                longer = whole(k + 1)
                longer[:-1] &= maybe[:-1] & maybe[1:]
                _add(counts, _grams(hashes, salts, k + 1)[longer])
            at = np.flatnonzero(maybe)
            _, own, n = np.unique(grams[at], return_index=True, return_counts=True)
            own = at[own]
            # a word ends where the next byte is outside of words or in another text
            outside = np.flatnonzero(np.concatenate([~inside, [True]]))
            last = own + k - 1
            stop = np.minimum(outside[np.searchsorted(outside, starts[last])], ends[text[last] + 1])
            raw = data.tobytes().translate(_LOWER)
            phrases = [b" ".join(raw[s:e].split()) for s, e in zip(starts[own].tolist(), stop.tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": batch.column("lang").take(pa.array(text[own])), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
                    "n": pa.array(n.astype(np.int64)), "range": pa.nulls(len(own), pa.int32()), "counts": pa.nulls(len(own), pa.binary()),
                }
            )
        for at, raw in _ranges(counts):
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.nulls(1, pa.string()), "phrase": pa.nulls(1, pa.string()), "n": pa.nulls(1, pa.int64()),
                    "range": pa.array([at], pa.int32()), "counts": pa.array([raw], pa.binary()),
                }
            )

    return scan


def frequent_phrases(docs: DataFrame, longest: int = 4, support: int = 30, buckets: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Stored (lang, phrase, n) of every phrase of 1, 2 ... ``longest`` words that occurs at least ``support`` times, and (lang, n) with all words.

    One pass over the texts for each length. Pass k counts phrases of k words exactly and, in the same pass, hashes those of k + 1 words
    into buckets. The next pass counts a phrase only if both phrases it extends are frequent (Apriori, by a bitmap of their
    hashes) and its bucket's count reaches ``support``. Both bitmaps err on the safe side only, so counts are exact. They are broadcast and
    have 8 MB at most: buckets follow the size of the texts up to 2^26, beyond which they thin out less, but lose nothing.
    Equal phrases of a slice are counted there before they are shuffled, buckets of a whole task too, so common phrases meet in small numbers.
    """
    if not 1 <= support <= 255:
        raise ValueError("support must lie within 1 and 255")
    light = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    if buckets is None:
        size = light.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = _power_of_two(size // TEXT_A_BUCKET)
    out, totals, shorter, bucket = [], None, None, None
    for k in range(1, longest + 1):
        own = buckets if k < longest else 0
        scanned = materialize(light.mapInArrow(_scan(k, shorter, bucket, own), SCANNED), f"phrases-{k}")
        counted = scanned.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if totals is None:
            totals = scanned.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        out.append(materialize(counted.where(F.col("n") >= support), f"frequent-{k}"))
        if k < longest:
            if not (rows := out[-1].count()):
                break
            shorter, bucket = _filter(out[-1], k, rows), _bitmap(scanned.where("counts is not null"), own, support)
    return out, totals


def _number(name: str) -> str:
    return f"cast({name} as decimal(28,0))"


def collocations(docs: DataFrame, longest: int = 4, support: int = 30, absorb: int = 80, top: int = 2000, buckets: int | None = None) -> DataFrame:
    """The first ``top`` phrases of each language by how firmly their words belong together.

    Texts are cut at ``.,;:!?`` and line ends into pieces, pieces at blanks and tabs into words; A-Z are lower-cased. A language is the column
    ``lang``, null counting as ``und``. Candidates are phrases of 2 to ``longest`` words that occur a >= ``support`` times within pieces, overlaps
    included. A cut after the first k words gives l and r, how often both parts occur (both are frequent, as a is), and the
    score floor(2000000 * a / (l + r)); the lowest cut counts, of equal ones that of the smallest k. A candidate that stands in a longer candidate with
    100 * f(longer) >= ``absorb`` * a is dropped. Order: score, then a, both falling, then phrase by UTF-8 bytes. Products are
    decimals of 38 digits.

    Null and empty texts have no words; repeated rows and ids count as often as they stand there; texts of any length are
    counted whole; an empty table gives no rows; further columns, whatever their names, are ignored.
    Returns lang, rank (from 1), phrase, a, l, r, n (all words of the language), score.
    """
    tables, totals = frequent_phrases(docs, longest, support, buckets)
    counts = reduce(DataFrame.union, tables)
    longer = [t.withColumn("k", F.lit(k)) for k, t in enumerate(tables, 1) if k > 1]
    if not longer:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    candidates = reduce(DataFrame.union, longer).withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = F.expr(f"2000000 * {_number('a')} div ({_number('l')} + {_number('r')})")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = candidates.where("k > 2").withColumn("m", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - m + 1)")))
    inner = inner.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("m")), " ").alias("phrase"), "a")
    absorbed = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = scored.join(absorbed, ["lang", "phrase"], "left")
    left = left.where(F.expr(f"most is null or 100 * {_number('most')} < {absorb} * {_number('a')}"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    ranked = ranked.withColumn("rank", order).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

