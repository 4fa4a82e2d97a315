"""A hidden Markov language model (operator 4).

Every token belongs to a class: the most frequent training words are a class
each, all others share the class of their last two bytes. Latent states emit
classes; within a class a word has its add-one share of the class's training
tokens, unseen words one share together. Counts of all words cover the whole
training corpus and stay distributed; Baum-Welch counts of transitions and class
emissions, over whole texts, are summed over partitions until the likelihood has
settled; the scaled forward recursion then gives each whole text's exact likelihood.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .runtime import discard, materialise, tree_sum, wide
from .toxicity import fold

STATES = 6
#: Words that are a class of their own, and classes of word endings.
FREQUENT = 4096
ENDINGS = 512
#: Baum-Welch ends where an iteration gains less than so many nats a token, or after so many.
SETTLED = 5e-3
MOST_ITERATIONS = 40
#: Runs of texts are dealt to so many lots; the fixed point of one is where the iterations over all of them begin.
LOTS = 8
#: Tokens of whole texts that the training recursion runs over at a time, or more for texts so long that fewer than BATCH_TEXTS would be a run.
BATCH_TOKENS = 1 << 16
BATCH_TEXTS = 32
#: Rows of documents that look their words up together.
CHUNK_ROWS = 2000
#: The end token's place among the hashes.
END = np.int64(-0x7E57E57E57E57E57)


def _tokens(column):
    """(first row, hashes, ending classes, first token of each text) of blocks; the end token closes each text."""
    for lo, hi, data, offsets in kernel.blocks(column):
        data = kernel.LOWER[data]
        starts, ends, bounds = kernel.words(data, offsets)
        word = kernel.span_hashes(kernel.prefix_sums(data), starts, ends).view(np.int64)
        last = data[ends - 1].astype(np.uint64)
        second = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        ending = (kernel.mix(last * np.uint64(256) + second) % np.uint64(ENDINGS)).astype(np.int32)
        at = bounds[1:]
        yield lo, np.insert(word, at, END), np.insert(ending, at, 0), bounds + np.arange(hi - lo + 1)


def _count(batches):
    """Rows (text) to (hash, ending, n): each block's counts, folded before they leave the worker's batch."""
    for batch in batches:
        parts = [(h, e) for _, h, e, _ in _tokens(batch.column(0))]
        if parts:
            h, e = (np.concatenate(x) for x in zip(*parts, strict=True))
            values, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(e[at]), pa.array(n)], names=["h", "ending", "n"])


def _wanted(frequent: np.ndarray):
    """Rows (chunk, held, text) to the distinct other words of each chunk: (chunk, h, held) with held if a held-out text has it."""

    def run(batches):
        for batch in batches:
            chunks, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            keys: list[tuple] = []
            for lo, h, _, first in _tokens(batch.column(2)):
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first)) + lo
                rare = ~_is_in(h, frequent)
                keys.append((chunks[owner[rare]], h[rare], held[owner[rare]]))
            if keys:
                c, h, u = (np.concatenate(x) for x in zip(*keys, strict=True))
                order = np.lexsort((~u, h, c))
                c, h, u = c[order], h[order], u[order]
                new = np.concatenate([[True], (c[1:] != c[:-1]) | (h[1:] != h[:-1])])[: len(c)]
                yield pa.RecordBatch.from_arrays([pa.array(c[new]), pa.array(h[new]), pa.array(u[new])], names=["chunk", "h", "held"])

    return run


def _is_in(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
    return ordered[at] == h


def _classes(h: np.ndarray, ending: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return FREQUENT + ending
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, at, FREQUENT + ending)


def lay_out(klass: np.ndarray, lengths: np.ndarray):
    """Texts (end to end) in runs of about BATCH_TOKENS, longest first: (classes by place in the text, then by text; lengths; which texts)."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    order = np.argsort(-lengths, kind="stable")
    upto = np.concatenate([[0], np.cumsum(lengths[order])])
    lo = 0
    while lo < len(order):
        size = max(BATCH_TOKENS, BATCH_TEXTS * int(lengths[order[lo]]))
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + size, side="right")) - 1)
        part, lo = order[lo:hi], hi
        n = lengths[part]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.repeat(np.arange(len(part)), n)
        by_place = np.lexsort((text, at))
        yield klass[first[part[text]] + at][by_place].astype(np.int16), n.astype(np.int32), part


def _sequences(frequent: np.ndarray):
    """Training texts to their class sequences, as lay_out leaves them: one row a run, with its lot."""

    def run(batches):
        for batch in batches:
            parts = [(_classes(h, ending, frequent).astype(np.int16), np.diff(first)) for _, h, ending, first in _tokens(batch.column(0))]
            if parts:
                for i, (klass, n, _) in enumerate(lay_out(*(np.concatenate(x) for x in zip(*parts, strict=True)))):
                    yield pa.RecordBatch.from_arrays([pa.array([klass.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([(i + 1) % LOTS], pa.int32())], names=["classes", "lengths", "lot"])

    return run


def _places(lengths: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Texts with a token at each place, as an array and a list, and where each place begins."""
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    return live, live.tolist(), [0, *np.cumsum(live).tolist()]


def _messages(seen: np.ndarray, live: list[int], at: list[int], start: np.ndarray, move: np.ndarray):
    """Scaled forward messages of every token, and the scales, whose logarithms add up to the likelihood."""
    alpha, scale, ones = np.empty_like(seen), np.empty((len(seen), 1), seen.dtype), np.ones((len(start), 1), seen.dtype)
    for t, n in enumerate(live):
        lo = at[t]
        now, size = alpha[lo : lo + n], scale[lo : lo + n]
        if t:
            np.matmul(last[:n], move, out=now)  # noqa: F821  bound by the place before
        else:
            now[:] = start
        now *= seen[lo : lo + n]
        np.matmul(now, ones, out=size)
        now /= size
        last = now  # noqa: F841
    return alpha, scale


def expected_counts(klass: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Starts, transitions, (class, state) emissions and log likelihood of whole texts that lie as lay_out leaves them.

    Messages are of the parameters' precision, sums are double.
    """
    k = len(start)
    many, live, at = _places(lengths)
    seen = np.take(emit, klass, axis=0)
    alpha, scale = _messages(seen, live, at, start, move)
    ahead, back = np.divide(seen, scale, out=seen), np.ascontiguousarray(move.T)
    beta = np.ones_like(alpha)
    for t in range(len(live) - 2, -1, -1):
        lo, hi, n = at[t], at[t + 1], live[t + 1]
        now = ahead[hi : hi + n]
        now *= beta[hi : hi + n]
        np.matmul(now, back, out=beta[lo : lo + n])
    later = np.arange(live[0], len(klass))
    before = later - np.repeat(many[:-1], many[1:])  # the same text's token at the place before
    pairs = np.zeros((k, k))
    for lo in range(0, len(later), 8192):
        part = slice(lo, lo + 8192)
        pairs += np.take(alpha, before[part], axis=0).T @ ahead[later[part]]
    gamma = np.multiply(alpha, beta, out=alpha)
    flat = klass.astype(np.int64)
    emitted = np.stack([np.bincount(flat, gamma[:, s], emit.shape[0]) for s in range(k)], axis=1)
    return gamma[: live[0]].sum(axis=0, dtype=np.float64), move * pairs, emitted, float(np.log(scale, dtype=np.float64).sum())


def _expect(start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """The expected counts of a partition and its log likelihood, as one vector."""

    model = [x.astype(np.float32) for x in (start, move, emit)]

    def run(batches):
        total = 0.0
        for batch in batches:
            for klass, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = expected_counts(np.frombuffer(klass, np.int16), np.frombuffer(lengths, np.int32), *model)
                total = total + np.concatenate([np.ravel(x) for x in found])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


_SEQUENCES = "classes binary, lengths binary, lot int"


def baum_welch(sequences: DataFrame, shape: np.ndarray, states: int, most: int = MOST_ITERATIONS):
    """(start, move, emit, objective after each iteration over all texts): the objective, log likelihood and log prior, never falls.

    Iterations go over one lot of texts until they gain little, then, from there,
    over all texts until these gain little: the fixed point is that of the whole
    corpus, reached in fewer passes over it. A lot without texts gains nothing.
    """
    size = len(shape)
    rng = np.random.default_rng(4)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.4 / states) + np.eye(states) * 0.6
    emit = shape[:, None] * (rng.gamma(0.3, 1.0, (size, states)) + 0.01)  # states unlike enough to part soon
    emit /= emit.sum(axis=0)
    # Pseudo-counts: a Dirichlet prior that keeps every probability above zero.
    prior = 0.02 * shape[:, None] / shape.sum() * size
    gained: list[float] = []
    lot = materialise(sequences.where("lot = 0"))
    for texts in (lot, sequences):
        gained = []
        for _ in range(most if texts is sequences or not lot.isEmpty() else 0):
            sums = tree_sum(texts.select("classes", "lengths").mapInArrow(kernel.lean(_expect(start, move, emit)), "sums binary"), states + states * states + size * states + 1)
            gained.append(sums[-1] + 0.1 * (np.log(start).sum() + np.log(move).sum()) + (prior * np.log(emit)).sum())
            emitted = sums[states + states * states : -1].reshape(size, states)
            if len(gained) > 1 and gained[-1] - gained[-2] < SETTLED * max(1.0, emitted.sum()):
                break
            start = sums[:states] + 0.1
            move = sums[states : states + states * states].reshape(states, states) + 0.1
            emit = emitted + prior
            start, move, emit = start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    discard(lot)
    return start, move, emit, gained


def _forward(model: dict):
    """Rows sorted by (chunk, kind): a chunk's word counts, then its texts; to one scored row a text."""
    start, move, emit = model["start"], model["move"], model["emit"]
    frequent, known = model["frequent"], model["known"]
    mass = model["mass"]
    n, v = model["n"], model["v"]

    def score(column, held, words, counts):
        out, sequences = [], []
        for lo, h, ending, first in _tokens(column):
            klass = _classes(h, ending, frequent)
            own = klass < FREQUENT
            c = np.zeros(len(h), np.int64)
            if len(frequent):
                c[own] = known[klass[own]]
            if len(words):
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                c = np.where(~own & (words[at] == h), counts[at], c)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            # Words met once in training are not looked up for training texts: being in one, they have it.
            c = np.where(~own & (c == 0) & ~held[lo + owner], 1, c)
            base = np.log10((c + 1) / (n + (v + 1)))
            inner = np.where(own, 0.0, np.log10((c + 1) / mass[np.maximum(klass - FREQUENT, 0)]))
            sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731  every text has its end token
            out.append((np.diff(first), sums((c > 0).astype(np.int64)), sums(base), sums(inner)))
            sequences.append(klass.astype(np.int16))
        length, found, base, score = (np.concatenate(x) for x in zip(*out, strict=True))
        for klass, lengths, texts in lay_out(np.concatenate(sequences), length):
            _, live, at = _places(lengths)
            _, scale = _messages(np.take(emit, klass, axis=0), live, at, start, move)
            which = np.arange(len(klass)) - np.repeat(at[:-1], live)
            score[texts] += np.bincount(which, np.log10(scale[:, 0]), len(texts))
        return length, found, base, score

    def run(batches):
        chunk, words, counts = None, [], []
        ready: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            chunks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            key = chunks * 2 + kinds
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if chunks[lo] != chunk:
                    chunk, words, counts, ready = chunks[lo], [], [], None
                part = batch.slice(lo, hi - lo)
                if not kinds[lo]:
                    words.append(part.column(2).to_numpy())
                    counts.append(part.column(3).to_numpy())
                    continue
                if ready is None:
                    w, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, counts))
                    order = np.argsort(w)
                    ready, words, counts = (w[order], c[order]), [], []
                held = part.column(4).to_numpy(zero_copy_only=False).astype(bool)
                out = score(part.column(6), held, *ready)
                yield pa.RecordBatch.from_arrays([part.column(5), pa.array(held), pa.array(out[0].astype(np.int64)), pa.array(out[1]), pa.array(out[2]), pa.array(out[3])], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out, states: int = STATES, iterations: int = MOST_ITERATIONS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns where held_out is false.

    Null and empty texts are one end token. With no training rows all counts are
    zero and the model is uniform over its classes; no rows in, no rows out.
    Repeated rows count as often as they stand; extra columns are not looked at.
    Texts of any length are trained on and scored whole. The classes are as many at
    any size of the corpus (FREQUENT words and ENDINGS); what grows with it is the
    table of word counts, which decide within a class.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    # The chunk number is fixed by being written: a table that is read again, whatever the plan, has the same one.
    chunk = F.shiftright(F.monotonically_increasing_id(), 33) * F.lit(1 << 22) + F.floor((F.monotonically_increasing_id() % F.lit(1 << 33)) / CHUNK_ROWS)
    rows = materialise(rows.withColumn("chunk", chunk.cast("long")))
    training = rows.where("not held").select("text")
    counts = materialise(training.mapInArrow(kernel.lean(_count), "h long, ending int, n long").groupBy("h").agg(F.sum("n").alias("c"), F.first("ending").alias("ending")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).select("h", "c").collect()  # FREQUENT rows at most
    top = sorted((r["h"], r["c"]) for r in top)
    frequent, known = np.array([t[0] for t in top], np.int64), np.array([t[1] for t in top], np.int64)
    mass = np.ones(ENDINGS)
    rest = counts.join(F.broadcast(spark.createDataFrame(top, "h long, k long").select("h")), "h", "left_anti")
    for r in rest.groupBy("ending").agg((F.sum("c") + F.count("*")).alias("m")).collect():  # ENDINGS rows at most
        mass[r["ending"]] += r["m"]

    shape = np.full(FREQUENT + ENDINGS, 0.1)
    shape[: len(known)] += known
    shape[FREQUENT:] += mass - 1
    sequences = materialise(training.mapInArrow(kernel.lean(_sequences(frequent)), _SEQUENCES))
    start, move, emit, _ = baum_welch(sequences, shape, states, iterations)
    discard(sequences)

    wanted = rows.select("chunk", "held", "text").mapInArrow(kernel.lean(_wanted(frequent)), "chunk long, h long, held boolean")
    found = wanted.join(counts, "h").where("c > 1 or held").select("chunk", F.lit(0).alias("kind"), "h", "c", F.lit(None).cast("boolean").alias("held"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("chunk", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("c"), "held", "doc_id", "text")
    # A task has some tens of chunks at any number of rows.
    dealt = found.union(texts).repartition(wide(rows, 20 * CHUNK_ROWS), "chunk").sortWithinPartitions("chunk", "kind")
    model = {"start": start, "move": move, "emit": emit, "frequent": frequent, "known": known, "mass": mass, "n": n, "v": v}
    scored = dealt.mapInArrow(kernel.lean(_forward(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(folds=7) == 2)
