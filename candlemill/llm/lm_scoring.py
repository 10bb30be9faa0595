"""Language-model scoring: exact word counts over all texts, and a gated recurrent model with a class-factored softmax."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, materialize, slices_of

#: Words whose counts travel with the tasks; other words meet their counts in a join.
HEAD = 1 << 16
#: Words that the recurrent model tells apart: classes of so many words of like frequency. Id 0 is any other word, 1 the end.
CLASSES, CLASS_WORDS = 32, 64
OTHER, END = 0, 1
#: Units, texts side by side, steps of a window (beyond which no gradient goes back), rounds of training, step size, largest gradient norm.
UNITS, LANES, WINDOW, ROUNDS, RATE, CLIP = 16, 256, 32, 4, 0.1, 5.0
#: Training goes over a longer text in stretches of so many ids, each from an empty state, so that no lane runs on alone.
STRETCH = 1024
#: States whose classes are weighed at once.
ROWS = 2048
#: Scores of classes and words lie within these bounds, so padding has a share of 1e-24.
BOUND = 55.0
#: Added to every count.
SMOOTH = 0.1
TEXT, IDS = 1 << 22, 1 << 23

Weights = dict[str, np.ndarray]


# ---------------------------------------------------------------- the recurrent model


def first_weights(counts: np.ndarray, seed: int, units: int = UNITS) -> Weights:
    """Weights before training: outputs give the smoothed shares of ``counts`` (one a model word), whatever the state; padding has next to none."""
    rng = np.random.default_rng(seed)
    n = CLASSES * CLASS_WORDS
    mass = np.zeros(n)
    mass[: len(counts)] = counts + SMOOTH
    by_class = mass.reshape(CLASSES, CLASS_WORDS)
    with np.errstate(divide="ignore"):
        own = np.maximum(np.log(by_class / np.maximum(by_class.sum(axis=1, keepdims=True), SMOOTH)), -BOUND)
        whole = np.maximum(np.log(by_class.sum(axis=1) / mass.sum()), -BOUND)
    wide = np.sqrt(1 / units)
    w = {
        "input": rng.normal(0, 0.3, (n, 3 * units)), "gates": rng.normal(0, wide, (units, 2 * units)), "inner": rng.normal(0, wide, (units, units)),
        "class_w": rng.normal(0, 0.05, (units, CLASSES)), "class_b": whole,
        "word_w": rng.normal(0, 0.05, (CLASSES, units, CLASS_WORDS)), "word_b": own,
    }
    w["input"][:, :units] += 1.0  # keeps the state for long at first
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_window(w: Weights, ids: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States after each step (steps x lanes x units) for input ``ids`` (steps x lanes), and what going back needs.

    With update z, reset r and candidate c: state = c + z * (state - c). The candidate is x / (1 + |x|), a gate half of that plus a
    half. The state is empty where a text begins, which is where the end of one is the input. Inside, lanes come last, so that a step works
    on whole stretches of memory.
    """
    steps, lanes = ids.shape
    u = state.shape[1]
    pre = np.ascontiguousarray(w["input"][ids].transpose(0, 2, 1))
    gates, inners = pre[:, : 2 * u], pre[:, 2 * u :]
    states, befores = np.empty((steps, u, lanes), dtype=np.float32), np.empty((steps, u, lanes), dtype=np.float32)
    wide, slim, part = (np.empty((n * u, lanes), dtype=np.float32) for n in (2, 1, 1))
    to_gates, to_inner, ends = w["gates"].T.copy(), w["inner"].T.copy(), _ends(ids)
    now = state.T
    for t in range(steps):
        before, g, c = befores[t], gates[t], inners[t]
        before[:] = now
        if len(ends[t]):
            before[:, ends[t]] = 0
        g += np.matmul(to_gates, before, out=wide)
        np.abs(g, out=wide)
        wide += 1
        g /= wide
        g += 1
        g *= 0.5
        np.multiply(g[u:], before, out=part)
        c += np.matmul(to_inner, part, out=slim)
        np.abs(c, out=slim)
        slim += 1
        c /= slim
        now = states[t]
        np.subtract(before, c, out=now)
        now *= g[:u]
        now += c
    return states.transpose(0, 2, 1), (ends, befores, gates, inners)


def _ends(ids: np.ndarray) -> list[np.ndarray]:
    """The lanes whose input is the end, step by step."""
    step, lane = np.nonzero(ids == END)
    return np.split(lane, np.searchsorted(step, np.arange(1, len(ids))))


def back_window(w: Weights, seen: tuple, d_states: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradients of the recurrent weights from those of the states; no gradient leaves the window. Those of ``input`` are one row a step and lane."""
    ends, befores, gates, inners = seen
    steps, u, lanes = befores.shape
    d_pre = np.empty((steps, 3 * u, lanes), dtype=np.float32)
    z, r, d_states = gates[:, :u], gates[:, u:], np.ascontiguousarray(d_states.transpose(0, 2, 1))
    slope = np.square(1 - np.abs(2 * gates - 1))
    slope *= 0.5
    to_inner = (1 - z) * np.square(1 - np.abs(inners))
    to_update, to_reset = (befores - inners) * slope[:, :u], befores * slope[:, u:]
    carry, d, d_rh, part = (np.empty((u, lanes), dtype=np.float32) for _ in range(4))
    carry[:] = 0
    for t in range(steps - 1, -1, -1):
        own = d_pre[t]
        np.add(d_states[t], carry, out=d)
        np.multiply(d, to_update[t], out=own[:u])
        np.multiply(d, to_inner[t], out=own[2 * u :])
        np.matmul(w["inner"], own[2 * u :], out=d_rh)
        np.multiply(d_rh, to_reset[t], out=own[u : 2 * u])
        np.matmul(w["gates"], own[: 2 * u], out=carry)
        carry += np.multiply(d, z[t], out=part)
        carry += np.multiply(d_rh, r[t], out=part)
        if len(ends[t]):
            carry[:, ends[t]] = 0
    flat = d_pre.transpose(1, 0, 2).reshape(3 * u, -1)
    seen_before, reset = (x.transpose(1, 0, 2).reshape(u, -1) for x in (befores, r * befores))
    return {"gates": seen_before @ flat[: 2 * u].T, "inner": reset @ flat[2 * u :].T}, flat.T


def _softmax(x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the shares of the given places; ``x`` becomes exponentials, whose sums come along. Scores are held within what an exponential can take."""
    np.clip(x, -BOUND, BOUND, out=x)
    own = x[np.arange(len(x)), place].astype(np.float64)
    np.exp(x, out=x)
    s = x @ np.ones(x.shape[1], dtype=x.dtype)
    return own - np.log(s), s


def predict(w: Weights, states: np.ndarray, ids: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, Weights | None]:
    """Natural logarithms of p(class of id) * p(id in its class) for each state; if ``learn``, gradients of their negative sum too.

    The states are brought into the order of their classes once. Shares less one for the id are (exponentials less their sum for the id) / sum, and
    the division is made on the narrow side of each product.
    """
    classes, size = w["word_b"].shape
    group, place = np.divmod(ids.astype(np.uint16), np.uint16(size))
    order = np.argsort(group, kind="stable")
    states, group, place = states[order], group[order].astype(np.int64), place[order].astype(np.int64)
    cuts = np.searchsorted(group, np.arange(classes + 1))
    found = np.empty(len(ids))
    d_states = grads = None
    if learn:
        d_states = np.empty_like(states)
        grads = {k: np.zeros_like(w[k]) for k in ("class_w", "class_b", "word_w", "word_b")}

    def choose(h: np.ndarray, weight: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple:
        x = h @ weight
        x += bias
        logs, s = _softmax(x, at)
        if not learn:
            return logs, None, None, None
        x[np.arange(len(x)), at] -= s
        share = (1 / s)[:, None]
        d = x @ weight.T
        d *= share
        return logs, d, (h * share).T @ x, share[:, 0] @ x

    for first in range(0, len(ids), ROWS):
        part = slice(first, first + ROWS)
        found[part], d, dw, db = choose(states[part], w["class_w"], w["class_b"], group[part])
        if learn:
            d_states[part] = d
            grads["class_w"] += dw
            grads["class_b"] += db
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[k], cuts[k + 1])
        logs, d, dw, db = choose(states[part], w["word_w"][k], w["word_b"][k], place[part])
        found[part] += logs
        if learn:
            d_states[part] += d
            grads["word_w"][k], grads["word_b"][k] = dw, db
    out = np.empty(len(ids))
    out[order] = found
    if learn:
        back = np.empty_like(d_states)
        back[order] = d_states
        d_states = back
    return out, d_states, grads


def lanes_of(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deals texts to lanes of about equal length: each text's lane and place in it, and the lanes' lengths, longest first."""
    lanes = max(1, min(lanes, len(lengths)))
    free = [(0, k) for k in range(lanes)]
    lane, place = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        used, k = heapq.heappop(free)
        lane[d], place[d] = k, used
        heapq.heappush(free, (used + int(lengths[d]), k))
    total = np.zeros(lanes, dtype=np.int64)
    np.add.at(total, lane, lengths)
    order = np.argsort(-total, kind="stable")
    rank = np.empty(lanes, dtype=np.int64)
    rank[order] = np.arange(lanes)
    return rank[lane], place, total[order]


class Lanes:
    """Texts of model ids, side by side: windows go through all lanes at once and carry each lane's state on."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, lanes: int = LANES) -> None:
        self.lengths = lengths
        lane, place, self.total = lanes_of(lengths, lanes)
        ends = np.cumsum(lengths)
        self.cell = np.repeat(lane * (self.total[0] + 1) + place - (ends - lengths), lengths) + np.arange(len(ids)) + 1
        grid = np.full(len(self.total) * (self.total[0] + 1), END, dtype=np.uint16)
        grid[self.cell] = ids
        self.grid = grid.reshape(len(self.total), -1)  # column 0: the end before the first text

    def windows(self, units: int, full: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First step, states of the lanes still running, inputs, targets (both steps x lanes) and which targets count; send back the last states.

        ``full`` windows have the more steps the fewer lanes still run.
        """
        state, t = np.zeros((len(self.total), units), dtype=np.float32), 0
        while t < self.total[0]:
            n = int(np.searchsorted(-self.total, -t, side="left"))
            steps = min(WINDOW * max(1, LANES // n) if full else WINDOW, int(self.total[0]) - t)
            part = np.ascontiguousarray(self.grid[:n, t : t + steps + 1].T).astype(np.int64)
            real = np.arange(t, t + steps)[:, None] < self.total[:n]
            state = yield t, state[:n], part[:-1], part[1:], real
            t += steps


def log_probabilities(w: Weights, ids: np.ndarray, lengths: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """For each text the natural logarithm of its ids' probability, states carried over all its windows."""
    if not len(lengths):
        return np.zeros(0)
    dealt = Lanes(ids, lengths, lanes)
    scores = np.zeros(dealt.grid.shape, dtype=np.float32)
    windows = dealt.windows(w["inner"].shape[0], full=True)
    step = next(windows, None)
    while step is not None:
        t, state, inputs, targets, real = step
        states, _ = run_window(w, inputs, state)
        found, _, _ = predict(w, states[real], targets[real], False)
        part = np.zeros(real.shape, dtype=np.float32)
        part[real] = found
        scores[: part.shape[1], t + 1 : t + 1 + len(part)] = part.T
        step = _next(windows, states[-1])
    return np.add.reduceat(scores.ravel()[dealt.cell].astype(np.float64), np.cumsum(lengths) - lengths)


def _next(windows, state):
    try:
        return windows.send(state)
    except StopIteration:
        return None


def learn(w: Weights, squares: Weights, ids: np.ndarray, lengths: np.ndarray, lanes: int = LANES) -> int:
    """One pass of truncated backpropagation over all the texts' ids; changes weights and squared gradients (Adagrad) in place; returns the ids seen."""
    parts = -(-lengths // STRETCH)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    dealt = Lanes(ids, np.minimum(np.repeat(lengths, parts) - place * STRETCH, STRETCH), lanes)
    windows = dealt.windows(w["inner"].shape[0])
    step = next(windows, None)
    while step is not None:
        _, state, inputs, targets, real = step
        states, seen = run_window(w, inputs, state)
        d = np.zeros_like(states)
        _, d[real], grads = predict(w, states[real], targets[real], True)
        recurrent, rows = back_window(w, seen, d)
        grads |= recurrent
        n = LANES * WINDOW  # whatever the lanes still running, so that the last ones move little
        flat = inputs.ravel()
        words = np.flatnonzero(np.bincount(flat))
        rows = np.stack([np.bincount(flat, x)[words] for x in rows.T], axis=1).astype(np.float32)
        norm = np.sqrt(sum(float((g * g).sum()) for g in (*grads.values(), rows))) / n
        scale = np.float32(min(1.0, CLIP / max(norm, 1e-12)) / n)
        for k, g in grads.items():
            g *= scale
            squares[k] += g * g
            w[k] -= RATE * g / (np.sqrt(squares[k]) + 1e-6)
        rows *= scale
        squares["input"][words] += rows * rows
        w["input"][words] -= RATE * rows / (np.sqrt(squares["input"][words]) + 1e-6)
        step = _next(windows, states[-1])
    return int(lengths.sum())


# ---------------------------------------------------------------- over all texts


def _crc(i: Column) -> Column:
    return F.crc32(F.encode(i.cast("string"), "UTF-8"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of a slice with how often they stand in texts to learn from and in all."""
    for batch in (part for whole in batches for part in slices_of(whole, "__text", TEXT)):
        hashes, at = hashed_words(batch.column("__text"), "space")
        words, own, n = np.unique(hashes, return_inverse=True, return_counts=True)
        learned = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(at))
        c = np.bincount(own[learned], minlength=len(words))
        yield pa.RecordBatch.from_pydict({"h": pa.array(words.view(np.int64)), "c": pa.array(c.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _coder(head: np.ndarray, counts: np.ndarray, model: np.ndarray, ends: int, below: float, below_other: float):
    """Turns texts into model ids and sums over the words of ``head`` (sorted hashes, with counts and model ids); other words are left to a join.

    ``below`` and ``below_other`` are the logarithms of what counts are divided by, among all words and among those the model doesn't know.
    """
    logs, end = np.log10(counts + SMOOTH) - below, np.log10(ends + SMOOTH) - below

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in slices_of(whole, "__text", TEXT)):
            hashes, at = hashed_words(batch.column("__text"), "space")
            rows = len(at) - 1
            text = np.repeat(np.arange(rows), np.diff(at))
            spot = np.minimum(np.searchsorted(head, hashes), max(len(head) - 1, 0))
            known = head[spot] == hashes if len(head) else np.zeros(len(hashes), dtype=bool)
            ids = np.full(len(hashes), OTHER, dtype=np.uint16)
            ids[known] = model[spot[known]]
            own, where = spot[known], text[known]
            outside = model[own] == OTHER
            rare = np.lexsort((hashes[~known], text[~known]))
            h, t = hashes[~known][rare], text[~known][rare]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])) if len(h) else np.empty(0, dtype=np.int64)
            n, cuts = np.diff(np.concatenate([new, [len(h)]])), np.searchsorted(t[new], np.arange(rows + 1)).astype(np.int32)
            full = np.insert(ids, at[1:], END)
            places = at + np.arange(rows + 1)
            raw, offsets = full.tobytes(), (2 * places).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "uid": pa.array(np.arange(uid, uid + rows)),
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    "n_tokens": pa.array((np.diff(at) + 1).astype(np.int64)),
                    "known": pa.array((np.bincount(where[counts[own] > 0], minlength=rows) + (ends > 0)).astype(np.int64)),
                    "logs": pa.array(np.bincount(where, logs[own], minlength=rows).astype(np.float64) + end),
                    "other_logs": pa.array(np.bincount(where[outside], logs[own[outside]] + (below - below_other), minlength=rows).astype(np.float64)),
                    "ids": pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]),
                    "rare": pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])),
                }
            )
            uid += rows

    return code


CODED = (
    "uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, other_logs double, ids binary, "
    "rare array<struct<h: long, n: long>>"
)


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column("ids")
    return np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint16), pc.binary_length(raw).to_numpy().astype(np.int64) // 2


def _packed(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unpacked(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


#: Weights travel in so many parts, each averaged in a task.
PARTS = 16


def _trainer(w: Weights, squares: Weights):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, seen = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in squares.items()}, 0
        for batch in (part for whole in batches for part in slices_of(whole, "ids", IDS)):
            seen += learn(own, sums, *_ids_of(batch))
        if seen:
            for part, values in enumerate(np.array_split(np.concatenate([_packed(own), _packed(sums)]), PARTS)):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seen": pa.array([seen], pa.int64()), "values": pa.array([values.tobytes()])})

    return train


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of each part's values, weighted by the ids seen; holds one sum at a time."""
    last, total, seen = None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([last], pa.int32()), "values": pa.array([(total / seen).astype(np.float32).tobytes()])})

    for batch in batches:
        for part, n, raw in zip(batch.column("part").to_pylist(), batch.column("seen").to_pylist(), batch.column("values")):
            values = np.frombuffer(raw.as_buffer(), dtype=np.float32).astype(np.float64) * n
            if part != last:
                if last is not None:
                    yield done()
                last, total, seen = part, values, n
            else:
                total, seen = total + values, seen + n
    if last is not None:
        yield done()


def train(coded: DataFrame, counts: np.ndarray, seed: int, rounds: int = ROUNDS, units: int = UNITS) -> Weights:
    """The model learned from all rows of ``coded`` that aren't held out.

    A round takes every ``rounds``-th of these texts: each task starts from the weights so far, goes over its texts once by truncated
    backpropagation, and the tasks' weights and squared gradients are averaged, weighted by what they saw, part by part in
    tasks. The driver holds one set of weights. So all texts are learned from once, whatever their number.
    """
    w = first_weights(counts, seed, units)
    squares = {k: np.full_like(v, 1e-5) for k, v in w.items()}
    own = coded.where("not held_out")
    for r in range(rounds):
        part = own.where(F.pmod("uid", F.lit(rounds)) == r).select("ids")
        trained = part.mapInArrow(_trainer(w, squares), "part int, seen long, values binary")
        means = trained.repartition("part").sortWithinPartitions("part", F.xxhash64("values")).mapInArrow(_average, "part int, values binary")
        if found := sorted(means.collect()):
            flat = np.concatenate([np.frombuffer(v, dtype=np.float32) for _, v in found])
            w, squares = _unpacked(flat[: len(flat) // 2], w), _unpacked(flat[len(flat) // 2 :], w)
    return w


def score_texts(docs: DataFrame, held_out: Column | None = None, seed: int = 12, rounds: int = ROUNDS, units: int = UNITS) -> DataFrame:
    """Log-likelihoods of whole texts under two models learned from the rows that aren't ``held_out`` (by default ids whose CRC-32 is a multiple of 10 are).

    Tokens are the words of a text (runs of other than ASCII white space, A-Z in lower case) and one end; words are told apart by 64-bit hashes.

    1. exact counts of all words, summed in slices and tasks before they are shuffled; those of the 65,536 commonest words travel with the tasks;
    2. every text becomes model ids, sums over the common words, and its rarer words with how often they stand there; these meet their
       counts in one join, so no count table is held whole anywhere;
    3. the recurrent model knows the 2,046 words commonest in the texts learned from, the end, and any other word. It starts from their counts
       and is trained over all texts learned from (see ``train``);
    4. every text is scored whole, in windows that carry the state on; lanes of texts run side by side.

    ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))): c the token's count, N all, V distinct tokens learned from. ``score``
    is the recurrent model's log10 probability; a word it doesn't know counts as any other word times that word's
    smoothed share among all such. ``n_known`` counts tokens with c > 0.

    Null and empty texts are an end alone; every row, repeated ones and those of a null id too (which are learned from), counts and is scored for
    itself; texts of any length are scored whole, one long text without company in its lane; where nothing is
    learned from, N = 0 and all is smoothing; an empty table gives no rows; further columns, whatever their names, are ignored.
    Among words of equal counts the hash decides which the model knows.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens (N), base_score, score.
    """
    own = F.coalesce(held_out if held_out is not None else _crc(F.col("doc_id")) % 10 == 0, F.lit(False))
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("held_out"), F.col("text").alias("__text"))
    words = light.select("held_out", "__text").mapInArrow(_counted, "h long, c long, n long")
    words = materialize(words.groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    ends = light.where("not held_out").count()
    common = words.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    top = words.where("c > 0").orderBy(F.desc("c"), "h").limit(CLASSES * CLASS_WORDS - 2).toArrow()
    head = np.concatenate([common.column("h").to_numpy(), top.column("h").to_numpy()]).view(np.uint64)
    counts = np.concatenate([common.column("c").to_numpy(), top.column("c").to_numpy()])
    head, first = np.unique(head, return_index=True)
    counts = counts[first]
    model = np.full(len(head), OTHER, dtype=np.uint16)
    model[np.searchsorted(head, top.column("h").to_numpy().view(np.uint64))] = np.arange(2, 2 + top.num_rows)
    n, v = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    inside = int(top.column("c").to_numpy().sum())
    total, distinct = n + ends, v + (ends > 0)
    other, other_distinct = n - inside, v - top.num_rows

    below, below_other = float(np.log10(total + SMOOTH * (distinct + 1))), float(np.log10(other + SMOOTH * (other_distinct + 1)))
    coded = materialize(light.mapInArrow(_coder(head, counts, model, ends, below, below_other), CODED), "coded")
    w = train(coded, np.concatenate([[other, ends], top.column("c").to_numpy()]).astype(np.float64), seed, rounds, units)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole, "ids", IDS)):
            found = log_probabilities(w, *_ids_of(batch)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "model"])

    rare = coded.select("uid", F.inline("rare")).join(words.select("h", "c"), "h", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    rare = rare.groupBy("uid").agg(
        F.sum((log - below) * F.col("n")).alias("rare_logs"), F.sum((log - below_other) * F.col("n")).alias("rare_other"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("rare_known"),
    )
    flat = ["uid", "doc_id", "held_out", "n_tokens", "known", "logs", "other_logs"]
    types = "uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, other_logs double, model double"
    scored = coded.select(*flat, "ids").mapInArrow(score, types).join(rare, "uid", "left")
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.col("other_logs") + F.coalesce("rare_other", F.lit(0.0))).alias("score"),
    )
