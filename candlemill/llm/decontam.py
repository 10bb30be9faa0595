"""Benchmark decontamination: latent semantic retrieval, then word-order and answer checks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, slices_of
from .graph import map_groups

#: Hashed terms, latent dimensions (with oversampling), power iterations, rows of the basis in a part of a sum.
TERMS, RANK, OVERSAMPLE, POWER, PART = 1 << 18, 128, 16, 2, 1024
#: Words of a passage, words between windows, window lengths.
PASSAGE_WORDS, STEP, SCALES = 48, 8, (16, 32, 48)
#: A passage's rare words are counted in stretches of ``SPREAD`` buckets; word hits counted at once.
BUCKET, SPREAD, CELLS = 24, 3, 2_000_000
#: Benchmark passages searched at once: a larger benchmark is searched block by block.
BLOCK_PASSAGES = 20_000
COSINE, VERBATIM, PARAPHRASE, ANSWER_WORDS, ANSWER = 0.3, 0.7, 0.5, 5, 0.8
#: A single passage of so many words of a longer item, and the share of it that counts as a leak by itself.
WHOLE_PASSAGE_WORDS, WHOLE_PASSAGE = 32, 0.9
#: An item may also stand spread over so many times its words if it has this share of them in order.
SPREAD_BY, SPREAD_WORDS = 2, 0.9
HIT = pa.struct(
    [
        ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("passage", pa.float64()),
        ("answer", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()),
    ]
)
LEAKS = "array<struct<item_id: long, cosine: double, common: double, passage: double, answer: boolean, first_word: long, n_words: long>>"


def folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in lower case, and where each text's words start."""
    return hashed_words(pc.utf8_lower(texts), "alnum")


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(TERMS - 1)).astype(np.int64)


def passages_of(words: int, size: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """Equal cuts of an item into passages of at most ``size`` words."""
    parts = max(1, -(-words // size))
    cuts = [words * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def benchmark_terms(benchmark: DataFrame) -> np.ndarray:
    """The hashed terms of all items: at most 2^18 numbers, on the driver."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"term": pa.array(np.unique(terms_of(folded_words(batch.column("text"))[0])))})

    return np.sort(benchmark.select("text").mapInArrow(terms, "term long").distinct().toArrow().column("term").to_numpy())


def term_weights(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """(log((1 + documents) / (1 + documents with the term)) + 0.1) squared for each of ``terms``, from all documents.

    The square lets rare words outweigh what all texts of a language share.
    """
    place = np.full(TERMS, -1, dtype=np.int32)
    place[terms] = np.arange(len(terms))
    shared, size = docs.sparkSession.sparkContext.broadcast(place), len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts, docs = shared.value, np.zeros(size, dtype=np.int64), 0
        for whole in batches:
            for batch in slices_of(whole):
                hashes, starts = folded_words(batch.column("text"))
                at = place[terms_of(hashes)]
                known = np.flatnonzero(at >= 0)
                doc = np.searchsorted(starts, known, side="right") - 1
                counts += np.bincount(np.unique(doc * size + at[known]) % size, minlength=size) if len(known) else 0
                docs += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1)), "n": pa.array(np.append(counts[at], docs))})

    sums = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = sums.column("at").to_numpy(), sums.column("n").to_numpy()
    df = np.zeros(size)
    df[at[at >= 0]] = n[at >= 0]
    return ((np.log((1 + n[at == -1].sum()) / (1 + df)) + 0.1) ** 2).astype(np.float32)


@dataclass
class Latent:
    place: np.ndarray  # hashed term -> row of basis, or -1
    weight: np.ndarray  # row of basis -> weight of the term
    basis: np.ndarray  # terms of the benchmark x rank

    def tf_idf(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the basis and their weights times how often they occur, at unit length."""
        rows = self.place[terms_of(hashes)]
        rows, times = np.unique(rows[rows >= 0], return_counts=True)
        x = times * self.weight[rows].astype(np.float64)
        return rows, x / max(np.linalg.norm(x), 1e-12)


def _sketch(shared):
    """The passages of a task times the basis times the passages again, in parts of ``PART`` rows."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent: Latent = shared.value
        for whole in batches:
            for batch in slices_of(whole):
                hashes, starts = folded_words(batch.column("text"))
                rows, sums = [np.empty(0, dtype=np.int64)], [np.empty((0, latent.basis.shape[1]))]
                for s, e in zip(starts, starts[1:]):
                    for a, b in passages_of(int(e - s)):
                        at, x = latent.tf_idf(hashes[s + a : s + b])
                        rows.append(at)
                        sums.append(np.outer(x, x @ latent.basis[at]))
                at, place = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(at), latent.basis.shape[1]))
                np.add.at(total, place, np.concatenate(sums))
                cuts = np.searchsorted(at, np.arange(0, len(latent.basis) + PART, PART))
                parts = [(p, s, e) for p, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([p for p, _, _ in parts], pa.int64()),
                        "rows": pa.array([at[s:e].astype(np.int64).tobytes() for _, s, e in parts], pa.binary()),
                        "sums": pa.array([total[s:e].tobytes() for _, s, e in parts], pa.binary()),
                    }
                )

    return sketch


def _add_parts(width: int):
    def add(group: pa.Table) -> pa.Table:
        part, total = group.column("part")[0].as_py(), np.zeros((PART, width))
        for rows, sums in zip(group.column("rows"), group.column("sums")):
            total[np.frombuffer(rows.as_py(), dtype=np.int64) - part * PART] += np.frombuffer(sums.as_py()).reshape(-1, width)
        return pa.table({"part": pa.array([part], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    return add


def latent_space(benchmark: DataFrame, terms: np.ndarray, weight: np.ndarray, seed: int, rank: int = RANK) -> Latent:
    """Randomised SVD of the benchmark's TF-IDF passages: the leading right singular vectors.

    A random sketch is multiplied by A'A in distributed passes with orthonormalisation in between
    (subspace iteration). Tasks' sums are added up by Spark; the driver holds the basis only, at most
    2^18 terms by 144.
    """
    place = np.full(TERMS, -1, dtype=np.int32)
    place[terms] = np.arange(len(terms))
    width = min(rank + OVERSAMPLE, len(terms))
    latent = Latent(place, weight, np.linalg.qr(np.random.default_rng(seed).standard_normal((len(terms), width)))[0])
    context = benchmark.sparkSession.sparkContext
    for _ in range(POWER + 1):
        found = benchmark.select("text").mapInArrow(_sketch(context.broadcast(latent)), "part long, rows binary, sums binary")
        total = np.zeros((-(-len(terms) // PART) * PART, width))
        for r in map_groups(found, ["part"], _add_parts(width), "part long, sums binary").toLocalIterator():
            total[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["sums"]).reshape(PART, width)
        latent = Latent(place, weight, np.linalg.qr(total[: len(terms)])[0])
    # the last product's own leading directions; those that few passages leave without any weight go
    power, turn = np.linalg.eigh(total.T @ total)
    kept = np.flatnonzero(power > 1e-10 * power[-1])[::-1][:rank]
    basis = total[: len(terms)] @ (turn[:, kept] / np.sqrt(power[kept]))
    return Latent(place, weight, np.ascontiguousarray(basis, dtype=np.float32))


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of bits at a time."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def spread_words(want: list[int], known: set[int], words: list[int], start: int, end: int) -> tuple[float, int, int]:
    """The largest share of ``want`` in order in a stretch of ``SPREAD_BY`` times its words (and a quarter more) that holds the window, and that stretch.

    Stretches begin every quarter of the item, so that no place of a spread item is between two. 0 where the words there can't reach ``SPREAD_WORDS``.
    """
    step = max(STEP, len(want) // 4)
    size = SPREAD_BY * len(want) + step
    best = (0.0, start, end)
    first = max(0, end - size)
    if len(known) - len(known.intersection(words[first : start + step + size])) > (1 - SPREAD_WORDS) * len(want):
        return best  # each word of the item that isn't there is at least one place less
    times = Counter(want)
    for low in range(first, start + step, step):
        here = words[low : low + size]
        if sum((Counter(here) & times).values()) >= SPREAD_WORDS * len(want):
            share = common_words(want, [w for w in here if w in times]) / len(want)
            best = max(best, (share, low, low + len(here)), key=lambda b: b[0])
    return best


def rare_words(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The rarest words of a passage, how often it has each, and how many of these places a text must hold.

    A text that holds a share ``PARAPHRASE`` of the passage's places misses at most the rest
    of them, so of any more places than that it must hold the surplus: here about an eighth
    of the passage, among its rarest words.
    """
    need = int(np.ceil(PARAPHRASE * len(rows)))
    least = min(need, max(2, len(rows) // 8))
    rarest = np.argsort(-weight[rows], kind="stable")[: len(rows) - need + least]
    return *np.unique(rows[rarest], return_counts=True), least


@dataclass
class Search:
    """What every task needs of the benchmark, or of a block of it, beside the space that all blocks share:

    ``place`` (hashed term -> row of ``weighted``, or -1) and ``weighted`` (terms of the benchmark x rank: the basis times the terms' weights).
    """

    items: list[tuple[int, list[int]]]  # item_id, word hashes
    owner: np.ndarray  # passage -> item
    span: np.ndarray  # passage -> (first word, end)
    vectors: np.ndarray  # passage x rank, unit length
    scale: np.ndarray  # passage -> index into SCALES
    first: np.ndarray  # row of weighted -> its first posting
    posting: np.ndarray  # passages that have the term among their rare words, as often as they have it
    least: np.ndarray  # passage -> places of rare words that a text must hold
    known: dict[int, set[int]] = field(default_factory=dict)  # item -> its words, once looked at

    def stretches(self, rows: np.ndarray, bucket: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, passage): where enough rare words of a passage stand close together.

        ``rows`` are the words that any passage has among its rare ones, ``bucket`` (below ``width``) where they stand.
        """
        words = np.unique(bucket * len(self.first) + rows)
        bucket, rows = words // len(self.first), words % len(self.first)
        n = self.first[rows + 1] - self.first[rows]
        ends, found, s = np.cumsum(n), [], 0
        while s < len(rows):
            e = max(s + 1, int(np.searchsorted(ends, ends[s] - n[s] + CELLS, side="right")))
            stop = bucket[e - 1] + 1
            e, late = np.searchsorted(bucket, [stop, stop + SPREAD - 1])
            own = n[s:late]
            place = np.repeat(self.first[rows[s:late]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            key, hits = np.unique(np.repeat(bucket[s:late], own) + self.posting[place] * width, return_counts=True)
            total = hits.copy()
            for j in range(1, SPREAD):
                to = np.minimum(np.searchsorted(key, key + j), len(key) - 1)
                total += np.where(key[to] == key + j, hits[to], 0)
            found.append(key[(total >= self.least[key // width]) & (key % width < stop)])
            s = e
        key = np.concatenate([np.empty(0, dtype=np.int64), *found])
        return key % width, key // width

    def cosines(self, weighted: np.ndarray, rows: np.ndarray, step: np.ndarray, inside: np.ndarray, first: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch (its first step) and passage the step of the best window there and its cosine in the latent space.

        ``rows`` are the words in any stretch, ``step`` the step of ``STEP`` words each stands in and ``inside`` its place there. The best window is, of those at
        ``COSINE`` or more, the one with most of the passage.
        """
        sums = np.zeros((int(first.max()) + SPREAD * BUCKET // STEP + max(SCALES) // STEP, self.vectors.shape[1]), dtype=np.float32)
        for j in range(STEP):  # a step has one word at most at each of its places
            own = np.flatnonzero(inside == j)
            sums[step[own]] += weighted[rows[own]]
        at, cosine = np.zeros(len(first), dtype=np.int64), np.full(len(first), -1.0)
        size, windows = 1, sums
        for k, scale in enumerate(SCALES):
            while size < scale // STEP:  # sums over one step more
                windows, size = windows[:-1] + sums[size:], size + 1
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", windows, windows)), 1e-9)
            for own in np.array_split(mine := np.flatnonzero(self.scale[passage] == k), max(1, len(mine) // 8192)):
                if not len(own):
                    continue
                place = first[own, None] + np.arange(SPREAD * BUCKET // STEP - size + 1)
                dots = np.einsum("cjd,cd->cj", windows[place], self.vectors[passage[own]])
                near = dots / norm[place]
                best = np.where(near >= COSINE, dots, -1.0).argmax(axis=1)[:, None]
                at[own], cosine[own] = np.take_along_axis(place, best, 1)[:, 0], np.take_along_axis(near, best, 1)[:, 0]
        return at, np.minimum(cosine, 1.0)

    def find(self, hashes: np.ndarray, starts: np.ndarray, place: np.ndarray, weighted: np.ndarray) -> list[list[dict]]:
        """The leaks of each text, from the word hashes of all texts and where each text's words start."""
        out: list[list[dict]] = [[] for _ in range(len(starts) - 1)]
        rows = place[terms_of(hashes)].astype(np.int64)
        known = np.flatnonzero(rows >= 0)
        rows, sizes = rows[known], np.diff(starts)
        base = np.concatenate([[0], np.cumsum(-(-sizes // BUCKET) + SPREAD)])  # no stretch reaches into the next text
        text = np.searchsorted(starts, known, side="right") - 1
        place = known - starts[text]
        rare = self.first[rows + 1] > self.first[rows]
        bucket, passage = self.stretches(rows[rare], base[text[rare]] + place[rare] // BUCKET, int(base[-1]))
        if not len(bucket):
            return out
        steps = BUCKET // STEP
        wanted = np.zeros(int(base[-1]) + SPREAD + 1, dtype=bool)
        for j in range(SPREAD):
            wanted[bucket + j] = True
        on = wanted[base[text] + place // BUCKET]
        at, cosine = self.cosines(weighted, rows[on], base[text[on]] * steps + place[on] // STEP, place[on] % STEP, bucket * steps, passage)
        near: dict[int, list[tuple[int, int, int, float]]] = {}
        for i in np.flatnonzero(cosine >= COSINE).tolist():
            t, p = int(np.searchsorted(base, bucket[i], side="right")) - 1, int(passage[i])
            start = (int(at[i]) - int(base[t]) * steps) * STEP
            near.setdefault(t, []).append((p, start, min(int(sizes[t]), start + SCALES[self.scale[p]]), float(cosine[i])))
        for t, found in near.items():
            out[t] = self.verify(hashes[starts[t] : starts[t + 1]].tolist(), found)
        return out

    def verify(self, words: list[int], near: list[tuple[int, int, int, float]]) -> list[dict]:
        best: dict[int, dict] = {}
        for p, start, end, cosine in sorted(near, key=lambda c: (-c[3], c[0], c[1])):
            item = int(self.owner[p])
            if item in best and best[item]["common"] >= VERBATIM:
                continue
            item_id, want = self.items[item]
            known = self.known.setdefault(item, set(want))
            s, e = map(int, self.span[p])
            low, high = max(0, start - s - STEP), min(len(words), end + (len(want) - e) + STEP)
            here = list(filter(known.__contains__, words[low:high]))  # no other words can be in common
            at_most = len(here) / len(want)
            common = common_words(want, here) / len(want) if at_most >= PARAPHRASE else 0.0
            if e - s == len(want) or e - s < WHOLE_PASSAGE_WORDS:
                passage = common
            else:
                near_by = list(filter(known.__contains__, words[max(0, start - STEP) : end + STEP]))
                passage = common_words(want[s:e], near_by) / (e - s) if len(near_by) >= WHOLE_PASSAGE * (e - s) else 0.0
            common = max(common, passage * (e - s) / len(want))
            spread = 0.0
            if common < VERBATIM:
                spread, first, last = spread_words(want, known, words, start, end)
                if spread >= SPREAD_WORDS:
                    common, low, high = spread, first, last
                    here = list(filter(known.__contains__, words[low:high]))
            if item in best and best[item]["common"] >= common:
                continue
            tail = want[-ANSWER_WORDS:]
            answer = common_words(tail, here) >= ANSWER * len(tail)
            whole = passage >= WHOLE_PASSAGE and e - s >= WHOLE_PASSAGE_WORDS
            if common >= VERBATIM or (common >= PARAPHRASE and answer) or whole:
                best[item] = {
                    "item_id": item_id, "cosine": cosine, "common": common, "passage": passage, "answer": answer,
                    "first_word": low, "n_words": high - low,
                }
        return [best[i] for i in sorted(best)]


def _search(latent: Latent, rows: list) -> Search:
    """The passages of a block of items, ready to be sent to all tasks."""
    items, owner, span, vectors, least = [], [], [], [], []
    row, posting = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    hashes, starts = folded_words(pa.array([r["text"] for r in rows], pa.string()))
    for r, a, b in zip(rows, starts.tolist(), starts[1:].tolist()):
        if a == b:
            continue
        for s, e in passages_of(b - a):
            at, x = latent.tf_idf(hashes[a + s : a + e])
            v = x @ latent.basis[at]
            vectors.append(v / max(np.linalg.norm(v), 1e-12))
            rare, times, n = rare_words(latent.place[terms_of(hashes[a + s : a + e])], latent.weight)
            row.append(np.repeat(rare, times))
            posting.append(np.full(times.sum(), len(owner)))
            least.append(n)
            owner.append(len(items))
            span.append((s, e))
        items.append((r["item_id"], hashes[a:b].tolist()))
    row, posting = np.concatenate(row), np.concatenate(posting)
    order = np.argsort(row, kind="stable")
    length = np.array([e - s for s, e in span], dtype=int)
    return Search(
        items, np.array(owner, dtype=int), np.array(span, dtype=int).reshape(-1, 2),
        np.array(vectors, dtype=np.float32).reshape(len(owner), latent.basis.shape[1]),
        np.searchsorted(SCALES, length),
        np.searchsorted(row[order], np.arange(len(latent.basis) + 1)), posting[order], np.array(least, dtype=np.int64),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", seed: int = 23) -> DataFrame:
    """Adds ``column``: the benchmark items found in each whole text, as an array of structs.

    Term weights come from counts over all documents. The latent space is a distributed
    randomised SVD of the benchmark's TF-IDF passages (of 48 words at most). A stretch of 72
    words that holds enough rare words of a passage is a place to look: a text with half of a
    passage's words within 48 always has such a stretch. There, windows of 16, 32 or 48 words (each 8
    words) are compared with the passage by their cosine in the latent space, where both sides have unit length, so
    that a copy has a cosine near one however many passages there are. Windows at
    ``COSINE`` or more are checked: the item is there if its longest common subsequence with the text is
    at least 0.7 of its words, or 0.5 of them and its answer (its last five words) is there
    too, or 0.9 of one passage of at least 32 words of a longer item, or 0.9 of its words in order within
    two and a quarter times as many (an item with fillers between its words).

    The benchmark is searched in blocks of items, one after the other for each batch of texts, whose words are hashed once; the latent
    space is sent once for all blocks. A task holds the whole benchmark. Null or empty texts and items without words or id have no leaks; equal
    rows have equal leaks; of equal cosines the first window counts; repeated items are found under each of their ids; an empty
    benchmark finds nothing. Texts of any length are searched whole, in stretches. A column of the name ``column`` is replaced; other columns stay as they are.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    terms = benchmark_terms(bench)
    if not len(terms):
        return docs.withColumn(column, F.array().cast(LEAKS))
    latent = latent_space(bench, terms, term_weights(docs, terms), seed)
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, int(np.ceil(total / 4 / PASSAGE_WORDS / BLOCK_PASSAGES)))
    space = spark.sparkContext.broadcast((latent.place, latent.basis * latent.weight[:, None]))
    searches = []
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        if (search := _search(latent, rows)).items:
            searches.append(spark.sparkContext.broadcast(search))

    @F.arrow_udf(LEAKS)
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            leaks: list[list[dict]] = []
            for batch in slices_of(pa.RecordBatch.from_arrays([texts], names=["text"])):
                words = folded_words(batch.column("text"))
                found = [search.value.find(*words, *space.value) for search in searches]
                leaks += [sum(own, []) for own in zip(*found)] if found else [[]] * batch.num_rows
            yield pa.array(leaks, pa.list_(HIT))

    return docs.withColumn(column, find("text"))
