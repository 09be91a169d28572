"""A hidden Markov language model, trained by Baum-Welch over all training texts.

States emit classes, and a class emits its words.  The OWN most frequent words are classes of their own; every other
word is in one of BUCKETS classes by its last three letters, where a word with count c has (c + 1) / (C + V + 1), with
C and V the words and distinct words of the class, and what is left goes to unknown words.  So the model is a proper
distribution over texts, with few parameters, whatever the size of the vocabulary.

Word counts come from all training texts.  Words that make up at least one in HEAD of all tokens, hence at most HEAD
words, go to every task; the others stay a table, which the rare words of each text are joined with.  Each round of
Baum-Welch computes posteriors by scaled forward and backward recursion over whole texts, adds up the expected counts of
each task, and sums them over the tasks.  Starting values come from all training texts as well: each is dealt to a state
by a hash, and every state's emissions are drawn anew around the classes of its texts, as if it had START tokens, so
that no two states start equal, however many or few texts there are.  The first pass over the texts is stepwise: a part
of them (one in PARTS) at a time, whose counts move a running average, with a new model after each part.  Then come full
rounds, until one raises the log likelihood (with the smoothing as its prior, which Baum-Welch never lowers) by at most
LEAST_GAIN a training token.  The score of a text is the exact log10 likelihood from the scaled forward recursion, in
double precision; training counts are added up in double precision from recursions in single precision.

Words are known by 64-bit hashes.  Null and empty texts are one end token.  Very long texts are recursed over whole.
Null doc_ids are hashed as an empty text.  Repeated rows are texts of their own.  Words with equal counts are ordered by
their hash.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.common import BATCH_ROWS, binaries, bounded, longs, slices, stored

STATES, OWN, BUCKETS, HEAD = 8, 8192, 1024, 1 << 21
#: Tokens as of which a state's first emissions are drawn; the gain of the last round, in natural logs a training token.
START, LEAST_GAIN = 50_000, 0.001
SMOOTHING, SEED = 200.0, 3
#: Parts of the texts in the stepwise pass, and how fast the weight of a new part falls; steps between two scalings in training.
PARTS, FALL, EVERY = 16, 0.6, 4
#: Tokens of one batch of the recursions, and of the texts that are sorted by length together.
BATCH, SORTED = 400_000, 2_500_000
#: Tokens of one task of a round, at least where there are so many: what a task adds up is a table of fixed size.
TASK = 4_000_000
#: Distinct words that a worker keeps.
KEPT = 600_000
END = b""
STATE_NAMES = [f"s{k}" for k in range(STATES)]
SUMS_SCHEMA = "kind int, i int, " + ", ".join(f"{n} double" for n in STATE_NAMES)


def hashes_of(words: Iterable[bytes]) -> np.ndarray:
    """Signed 64-bit hashes whose low bits are the words' classes among the rare words."""
    from xxhash import xxh3_64_intdigest

    words = list(words)
    tails = [w[-3:] if w.isascii() else w.decode("utf-8", "replace")[-3:].encode() for w in words]
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    bucket = np.fromiter(map(zlib.crc32, tails), np.uint64, len(words))
    return (h - h % BUCKETS + bucket % BUCKETS).view(np.int64)


class Codes(dict):
    """Word -> number in order of appearance; fresh holds the words without a row in the worker's tables yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def words_of(texts: pa.Array) -> list[list[bytes]]:
    """The words of each text in UTF-8: of bytes, split parts at ASCII white space and lower changes A-Z, nothing else."""
    return [(x or b"").lower().split() for x in texts.cast(pa.binary()).to_pylist()]


def counted(docs: DataFrame) -> DataFrame:
    """(word, c): the hash and count of every token."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([longs(hashes_of(counts)), longs(list(counts.values()))], ["word", "c"])

        for batch in slices(batches, BATCH_ROWS):
            counts[END] += batch.num_rows
            for words in words_of(batch.column(0)):
                counts.update(words)
            if len(counts) > KEPT:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """head: hashes of the frequent words, sorted, with counts and classes; norms: log10(C + V + 1) of the rare classes."""

    head: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    norms: np.ndarray
    tokens: int
    distinct: int
    unigram: np.ndarray  # of the classes


def vocabulary(counts: DataFrame) -> Vocabulary:
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = counts.where(F.col("c") * HEAD >= tokens).toArrow()  # at most HEAD rows, as their counts add up to at most tokens
    words, c = np.asarray(head.column("word").combine_chunks(), np.int64), np.asarray(head.column("c").combine_chunks(), np.int64)
    order = np.lexsort((words, -c))
    words, c = words[order], c[order]
    own = min(OWN, len(words))
    bucket = F.pmod(F.col("word"), F.lit(BUCKETS)).alias("bucket")
    sums = counts.groupBy(bucket).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # BUCKETS rows at most
    mass, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, n, v in sums:
        mass[b], kinds[b] = n, v
    np.subtract.at(mass, words[:own] % BUCKETS, c[:own])
    np.subtract.at(kinds, words[:own] % BUCKETS, 1)
    classes = np.concatenate([np.arange(own), OWN + words[own:] % BUCKETS])
    unigram = np.ones(OWN + BUCKETS)
    unigram[:own] += c[:own]
    unigram[OWN:] += mass
    sort = np.argsort(words)
    return Vocabulary(words[sort], c[sort], classes[sort], np.log10(mass + kinds + 1), int(tokens), int(distinct), unigram / unigram.sum())


def encoded(docs: DataFrame, shared) -> DataFrame:
    """Classes and sums of every text; rare holds the hashes of the words outside the head."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        codes = Codes()
        word, kind, logs, norm = np.empty(0, np.int64), np.empty(0, np.uint16), np.empty(0), np.empty(0)
        for batch in slices(batches, BATCH_ROWS):
            if len(codes) > KEPT:
                codes = Codes()
                word, kind, logs, norm = np.empty(0, np.int64), np.empty(0, np.uint16), np.empty(0), np.empty(0)
            texts = words_of(batch.column(1))
            n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            begins = np.cumsum(n) - n
            tokens = itertools.chain.from_iterable((*words, END) for words in texts)
            at = np.fromiter(map(codes.__getitem__, tokens), np.int64, n.sum())
            if codes.fresh:
                h = hashes_of(codes.fresh)
                codes.fresh.clear()
                place = np.minimum(np.searchsorted(v.head, h), max(len(v.head) - 1, 0))
                known = v.head[place] == h if len(v.head) else np.zeros(len(h), bool)
                place = place[known]
                c, k = np.full(len(h), -1.0), OWN + h % BUCKETS
                c[known], k[known] = v.counts[place], v.classes[place]
                word, kind = np.concatenate([word, h]), np.concatenate([kind, k.astype(np.uint16)])
                logs = np.concatenate([logs, np.log10(c + 1, out=np.full(len(h), np.nan), where=c >= 0)])
                norm = np.concatenate([norm, np.where(k < OWN, 0.0, v.norms[np.maximum(k - OWN, 0)])])
            k, x = kind[at], logs[at]
            rare = np.isnan(x)
            x[rare] = 0.0
            lacks = np.add.reduceat(rare.astype(np.int64), begins)
            tied = np.add.reduceat(np.where(k >= OWN, x, 0.0) - norm[at], begins)
            raw, cuts = k.astype("<u2").tobytes(), [*(2 * begins).tolist(), 2 * len(k)]
            classes = binaries([raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])
            words = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lacks)]).astype(np.int32), longs(word[at[rare]]))
            columns = [longs(n), longs(n - lacks), pa.array(np.add.reduceat(x, begins)), pa.array(tied), classes, words]
            yield pa.record_batch([batch.column(0), *columns, batch.column(2)], ["doc_id", "n_tokens", "n_known", "base", "tied", "classes", "rare", "held_out"])

    out = docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, tied double, classes binary, rare array<long>, held_out boolean")
    out = out.withColumn("row", F.monotonically_increasing_id())
    return out.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class, state


@dataclass
class Sums:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float = 0.0  # likelihood under the model that gave the counts

    @staticmethod
    def zero() -> Sums:
        return Sums(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((OWN + BUCKETS, STATES)))


def by_time(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, longest first, step by step: all classes at step 0, then at step 1, ...; where a step begins; its texts.

    Step t of the i-th text stands i places from where step t begins, so memory follows the tokens, however uneven the texts are.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    live = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]), "right")
    begins = np.concatenate([[0], np.cumsum(live)])
    step = np.arange(begins[-1]) - np.repeat(np.cumsum(lens) - lens, lens)
    flat = np.empty(begins[-1], np.int32)
    flat[begins[step] + np.repeat(np.arange(len(lens)), lens)] = np.concatenate(texts)
    return flat, begins, live


def forward(model: Model, emitted: np.ndarray, begins: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Scales of every step and text: their logarithms add up to the likelihood."""
    scale = np.empty(len(emitted))
    a = emitted[: live[0]] * model.start
    for t in range(len(live)):
        s, n = begins[t], live[t]
        if t:
            a = a[:n] @ model.move
            a *= emitted[s : s + n]
        total = a.sum(1)
        a /= total[:, None]
        scale[s : s + n] = total
    return scale


def posterior(model: Model, texts: list[np.ndarray], sums: Sums) -> None:
    """Adds the expected counts of texts, longest first.

    Emissions are taken against the largest of their class, so single precision holds for EVERY steps without scaling.
    """
    classes, begins, live = by_time(texts)
    largest = np.maximum(model.emit.max(1), 1e-300)
    emitted = (model.emit / largest[:, None]).astype(np.float32)[classes]
    alpha, beta = np.empty_like(emitted), np.empty_like(emitted)
    move, ones = model.move.astype(np.float32), np.ones(STATES, np.float32)
    back = move.T.copy()
    at, ns = begins.tolist(), live.tolist()
    np.multiply(emitted[: ns[0]], model.start.astype(np.float32), out=alpha[: ns[0]])
    for t in range(1, len(ns)):
        s, n, p = at[t], ns[t], at[t - 1]
        a = alpha[s : s + n]
        np.matmul(alpha[p : p + n], move, out=a)
        a *= emitted[s : s + n]
        if t % EVERY == 0:
            total = a @ ones
            sums.log += float(np.log(total, dtype=np.float64).sum())
            a /= total[:, None]
            emitted[s : s + n] /= total[:, None]
    ends = begins[np.searchsorted(-live, -np.arange(1, ns[0] + 1), "right") - 1] + np.arange(ns[0])  # each text's last step
    left = alpha[ends].sum(1)
    sums.log += float(np.log(left, dtype=np.float64).sum() + np.log(largest) @ np.bincount(classes, minlength=len(largest)))
    beta[ends] = (1 / left)[:, None]
    for t in range(len(ns) - 1, 0, -1):
        s, n, p = at[t], ns[t], at[t - 1]
        w = emitted[s : s + n]
        w *= beta[s : s + n]
        np.matmul(w, back, out=beta[p : p + n])
    moves = np.zeros((STATES, STATES))
    changes = [1, *(np.flatnonzero(np.diff(live)[1:]) + 2).tolist(), len(ns)]  # steps with as many texts follow each other in the arrays
    for t, u in zip(changes, changes[1:], strict=False):
        if t < u:
            moves += alpha[at[t - 1] : at[t - 1] + ns[t]].T @ emitted[at[t] : at[t + 1]]
            moves += alpha[at[t] : at[u - 1]].T @ emitted[at[t + 1] : at[u]]
    alpha *= beta
    sums.move += moves * model.move
    sums.start += alpha[: ns[0]].sum(0, dtype=np.float64)
    for k, own in enumerate(np.ascontiguousarray(alpha.T)):
        sums.emit[:, k] += np.bincount(classes, own, len(sums.emit))


def batches_of(texts: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Numbers and texts, longest first, BATCH tokens or one text at a time."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    part, size = [], 0
    for i in order:
        if part and size + len(texts[i]) > BATCH:
            yield part, [texts[k] for k in part]
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part, [texts[k] for k in part]


def model_of(sums: Sums, unigram: np.ndarray) -> Model:
    start = sums.start + 1.0
    move = sums.move + 1.0
    emit = sums.emit + SMOOTHING * unigram[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def log_prior(model: Model, unigram: np.ndarray) -> float:
    """The smoothing of model_of as a log prior."""
    return float(np.log(model.start).sum() + np.log(model.move).sum() + SMOOTHING * (unigram @ np.log(model.emit)).sum())


def started(dealt: np.ndarray, unigram: np.ndarray) -> Model:
    """The first model, from the class counts of the texts dealt to each state: states that last, emissions drawn anew."""
    emit = dealt + SMOOTHING * unigram[:, None]
    sums = Sums.zero()
    sums.emit += np.random.default_rng(SEED).gamma(START * emit / emit.sum(0))
    sums.move += np.eye(STATES) * 100.0
    return model_of(sums, unigram)


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and texts of SORTED tokens at a time."""
    rows: list[int] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows.append(row)
            texts.append(np.frombuffer(raw.as_py(), "<u2"))
            size += len(texts[-1])
        if size > SORTED:
            yield rows, texts
            rows, texts, size = [], [], 0
    if texts:
        yield rows, texts


def rows_of(sums: Sums) -> pa.RecordBatch:
    """(kind, i, one number for each state): 0 the start, 1 moves, 2 emissions, 3 the likelihood."""
    used = np.flatnonzero(sums.emit.any(1))
    kind = np.concatenate([[0], np.ones(STATES), np.full(len(used), 2), [3]]).astype(np.int32)
    i = np.concatenate([[0], np.arange(STATES), used, [0]]).astype(np.int32)
    log = np.zeros((1, STATES))
    log[0, 0] = sums.log
    x = np.concatenate([sums.start[None], sums.move, sums.emit[used], log])
    return pa.record_batch([pa.array(kind), pa.array(i), *map(pa.array, np.ascontiguousarray(x.T))], ["kind", "i", *STATE_NAMES])


def added(rows: DataFrame) -> Sums:
    """The sums over all tasks of what rows_of gave in each."""
    sums = Sums.zero()
    for kind, i, *x in rows.groupBy("kind", "i").agg(*[F.sum(n).alias(n) for n in STATE_NAMES]).collect():  # a row for each class at most
        if kind == 0:
            sums.start[:] = x
        elif kind == 1:
            sums.move[i] = x
        elif kind == 2:
            sums.emit[i] = x
        else:
            sums.log = x[0]
    return sums


def in_tasks(texts: DataFrame, tokens: float) -> DataFrame:
    """texts, which have so many tokens, in no more tasks than one for TASK tokens, so that the sums to gather follow the input at any size."""
    return texts.coalesce(max(1, math.ceil(tokens / TASK)))


def dealt(texts: DataFrame) -> np.ndarray:
    """Class counts of all texts, each dealt to one state by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums.zero()
        for batch in batches:
            for state, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                np.add.at(sums.emit[:, state], np.frombuffer(raw.as_py(), "<u2"), 1.0)
        yield rows_of(sums)

    state = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "classes"), F.lit(STATES)).cast("int")
    return added(texts.select(state.alias("state"), "classes").mapInArrow(run, SUMS_SCHEMA)).emit


def expected(texts: DataFrame, shared) -> Sums:
    """Expected counts of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums, any_text = shared.value, Sums.zero(), False
        for _, own in held(batches):
            for _, part in batches_of(own):
                posterior(model, part, sums)
                any_text = True
        if any_text:
            yield rows_of(sums)

    return added(texts.select("row", "classes").mapInArrow(run, SUMS_SCHEMA))


def trained(texts: DataFrame, unigram: np.ndarray, tokens: int) -> Model:
    """Baum-Welch over stored training texts with so many tokens: a stepwise pass, then full rounds."""
    context = texts.sparkSession.sparkContext

    def counts(model: Model, own: DataFrame, parts: int) -> Sums:
        shared = context.broadcast(model)
        sums = expected(in_tasks(own, tokens / parts), shared)
        shared.unpersist()
        return sums

    model, mean, seen = started(dealt(in_tasks(texts, tokens)), unigram), Sums.zero(), 0
    for part in range(PARTS):
        sums = counts(model, texts.where(F.col("part") == part), PARTS)
        if sums.start.any():
            weight = (seen + 2) ** -FALL if seen else 1.0
            mean = Sums(*[(1 - weight) * a + weight * PARTS * b for a, b in ((mean.start, sums.start), (mean.move, sums.move), (mean.emit, sums.emit))])
            model = model_of(mean, unigram)
            seen += 1
    last = -np.inf
    while True:
        sums = counts(model, texts, 1)
        now = sums.log + log_prior(model, unigram)
        model = model_of(sums, unigram)
        if now - last <= LEAST_GAIN * tokens:
            return model
        last = now


def likelihoods(texts: DataFrame, shared) -> DataFrame:
    """(row, chain): log10 of the probability of each text's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, own in held(batches):
            out = np.empty(len(own))
            for part, sorted_texts in batches_of(own):
                classes, begins, live = by_time(sorted_texts)
                scale = forward(model, model.emit[classes], begins, live)
                whose = np.arange(len(scale)) - np.repeat(begins[:-1], live)
                out[part] = np.bincount(whose, np.log10(scale), len(part))
            yield pa.record_batch([longs(rows), pa.array(out)], ["row", "chain"])

    return texts.select("row", "classes").mapInArrow(run, "row long, chain double")


def scored(docs: DataFrame, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    context = docs.sparkSession.sparkContext
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
    docs = docs.select("doc_id", "text", (fold == held_fold).alias("held_out"))
    counts = stored(counted(docs.where("not held_out")), "counts")
    v = vocabulary(counts)
    texts = stored(encoded(docs, context.broadcast(v)), "texts", ("part",))  # by part, so that the stepwise pass reads each text once
    rare = texts.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10(c + 1.0)).alias("rare_logs"), F.sum((c > 0).cast("long")).alias("rare_known"))
    model = trained(texts.where("not held_out"), v.unigram, v.tokens)
    chain = likelihoods(texts, context.broadcast(model))
    rows = texts.join(chain, "row").join(rare, "row", "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.log10(F.lit(float(v.tokens + v.distinct + 1)))).alias("base_score"),
        (F.col("chain") + F.col("tied") + logs).alias("score"),
    )
