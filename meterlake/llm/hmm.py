"""Language-model scoring with a hidden Markov model over word classes.

A word belongs to one class: the OWN most frequent words each have their own, all others share HASHED classes by
their last three characters, and the end of a text is a class. STATES latent states emit classes; within a class a
word has its share of the corpus counts, add-one smoothed with room for one unseen word. So

    log P(text) = log P(its classes)  (scaled forward recursion, exact over the whole text)
                + sum of log P(word | class).

Training: counts of all training words; Baum-Welch starts from a bounded sample (SAMPLE texts, the starting point only)
and then makes ROUNDS passes over all training texts, whose expected counts are aggregated across partitions in one
shuffle of (class, STATES numbers) rows. Texts are never cut: the recursions run over whole sequences.

Counts of single words grow with the corpus and are never broadcast whole: the COMMON most frequent words (bounded in
number and length) go to every task, which also takes the load off frequent keys; the other words of each text are
joined with the count table.

Cases: null text counts as empty and is only an end; an empty or missing training part leaves one uniform state and
counts of 0; a null id counts as the empty text for the split; repeated rows are scored one by one. Other columns are
ignored. Words are what stands between [\\x20\\x09-\\x0D]+ after lower-casing A-Z.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import discard, id_crc, mapped, slices, text_of, written

STATES, OWN, HASHED = 8, 512, 2048
CLASSES = OWN + HASHED + 1
END = CLASSES - 1
SAMPLE, START_ROUNDS, ROUNDS = 600, 10, 2
#: Steps of the recursions that are computed again in the backward pass.
STRETCH = 32
#: Texts of more words wait for one another in training, up to so many words (two bytes each).
LONG, WAITING = 1500, 8_000_000
COMMON, COMMON_BYTES = 150_000, 64
#: Bytes of text that are taken together in training and in scoring.
TRAIN_SLICE, SCORE_SLICE = 5_000_000, 12_000_000


def hashed_class(word: str) -> int:
    return OWN + zlib.crc32(word[-3:].encode()) % HASHED


def hashed_class_sql(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(3)).cast("binary")) % HASHED + OWN).cast("int")


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(position of each word in the list of distinct words, that list, words up to each text's start and the end)."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    full = pc.not_equal(flat, "")  # white space at either end leaves empty strings
    upto = np.concatenate([[0], np.cumsum(np.asarray(full))])
    offsets = np.asarray(split.offsets)
    coded = flat.filter(full).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist(), upto[offsets - offsets[0]]


def sequences(at: np.ndarray, classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts one after another, each with its END, and where the texts start and end."""
    n = np.diff(ends)
    stops = ends + np.arange(len(ends))
    flat = np.full(stops[-1], END, np.int32)
    flat[np.arange(len(at)) + np.repeat(np.arange(len(n)), n)] = classes[at]
    return flat, stops


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, states: int = STATES) -> Model:
        rng = np.random.default_rng(5)
        emit = rng.gamma(2.0, size=(CLASSES, states))
        return cls(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))

    @classmethod
    def estimated(cls, counts: np.ndarray) -> Model:
        """From expected counts: CLASSES rows of emissions, STATES rows of moves, one row of starts."""
        states = counts.shape[1]
        emit, move, start = counts[:CLASSES] + 0.05, counts[CLASSES : CLASSES + states] + 0.1, counts[CLASSES + states] + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expected_counts(model: Model, flat: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Baum-Welch expected counts over whole texts.

    The recursions run over all texts at once, the longest first, a step a word. The forward pass remembers only where
    each stretch of STRETCH steps begins; the backward pass computes a stretch again before it walks through it, so
    memory is bounded by the words of one stretch and not by the longest text.
    """
    states = len(model.start)
    n = np.diff(stops)
    order = np.argsort(-n, kind="stable")
    at, size = stops[:-1][order], n[order]
    longest = int(size.max(initial=0))
    counts = np.zeros((CLASSES + states + 1, states))
    if not longest:
        return counts
    active = np.append(np.searchsorted(-size, -np.arange(longest), side="left"), 0)  # texts longer than t

    def step(x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward probabilities after word t, their scale, and the words; x: those after the word before."""
        k = active[t]
        seen = flat[at[:k] + t]
        x = (np.broadcast_to(model.start, (k, states)) if t == 0 else x[:k] @ model.move) * model.emit[seen]
        scale = x.sum(axis=1)
        return x / scale[:, None], scale, seen

    entries, x = [], np.zeros((0, states))
    for t in range(longest):
        if t % STRETCH == 0:
            entries.append(x)
        x = step(x, t)[0]
    beta = np.ones((active[longest - 1], states))
    later = None  # what the words after the stretch say of its last one: emission over scale, and their texts
    for first in range(STRETCH * (len(entries) - 1), -1, -STRETCH):
        x, inside = entries.pop(), []
        for t in range(first, min(first + STRETCH, longest)):
            x, scale, seen = step(x, t)
            inside.append((x, scale, seen))
        words, masses = [], []
        for t in range(first + len(inside) - 1, first - 1, -1):
            alpha, scale, seen = inside.pop()
            if later is not None:
                k = len(later)
                counts[CLASSES : CLASSES + states] += model.move * (alpha[:k].T @ later)
                beta = np.ones((len(alpha), states))
                beta[:k] = later @ model.move.T
            gamma = alpha * beta
            words.append(seen)
            masses.append(gamma)
            later = beta * model.emit[seen] / scale[:, None]
        seen, gamma = np.concatenate(words), np.concatenate(masses)
        for s in range(states):
            counts[:CLASSES, s] += np.bincount(seen, weights=gamma[:, s], minlength=CLASSES)
    counts[-1] = masses[-1].sum(axis=0)
    return counts


def forward(model: Model, flat: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each whole sequence, by the scaled forward recursion."""
    n = np.diff(stops)
    order = np.argsort(-n, kind="stable")
    at, size = stops[:-1][order], n[order]
    longest = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    total = np.zeros(len(n))
    x = np.zeros((0, len(model.start)))
    for t in range(longest):
        k = active[t]
        x = (np.broadcast_to(model.start, (k, len(model.start))) if t == 0 else x[:k] @ model.move) * model.emit[flat[at[:k] + t]]
        s = x.sum(axis=1)
        x = x / s[:, None]
        total[:k] += np.log(s)
    out = np.zeros(len(n))
    out[order] = total
    return out


def count_words(train: DataFrame) -> DataFrame:
    """word, c over all training texts; a task sends each of its words once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SCORE_SLICE):
                at, names, _ = words_of(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.bincount(at, minlength=len(names)).astype(np.int64))], names=["word", "c"])

    return mapped(train.select("text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(counts: DataFrame) -> dict[str, int]:
    """The most frequent words and their counts, most frequent first: at most COMMON words of COMMON_BYTES bytes.

    A histogram of counts in steps of an eighth of a power of two gives the least count that fits, so no task sends
    more than its share of the words.
    """
    short = counts.filter(F.octet_length("word") <= COMMON_BYTES)
    step = F.floor(F.log2("c") * 8)
    least, total = None, 0
    for at, n in sorted(short.groupBy(step.alias("at")).count().collect(), reverse=True):
        if total + n > COMMON:
            break
        least, total = at, total + n
    if least is None:
        return {}
    found = short.filter(step >= least).select("word", "c").collect()
    return dict(sorted((tuple(r) for r in found), key=lambda r: (-r[1], r[0])))


def train_model(train: DataFrame, own: dict[str, int], rounds: int = ROUNDS) -> Model:
    """A model from START_ROUNDS passes over about SAMPLE whole texts, the starting point, and `rounds` over all texts."""
    spark = train.sparkSession
    total = train.count()
    if not total:
        return Model.estimated(np.zeros((CLASSES + 2, 1)))
    columns = [f"v{s}" for s in range(STATES)]

    def coded(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        at, names, ends = words_of(texts)
        return sequences(at, np.fromiter((known.get(w) or hashed_class(w) for w in names), np.int32, len(names)), ends)

    def after(model: Model, rows: DataFrame) -> Model:
        shared = spark.sparkContext.broadcast((model, own))  # CLASSES x STATES numbers and OWN words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, known = shared.value
            counts = np.zeros((CLASSES + STATES + 1, STATES))
            waiting: list[np.ndarray] = []  # long texts; together they take as many steps as the longest of them

            def settle() -> np.ndarray:
                stops = np.concatenate([[0], np.cumsum([len(w) for w in waiting])])
                flat = np.concatenate(waiting).astype(np.int32)
                waiting.clear()
                return expected_counts(now, flat, stops)

            for batch in batches:
                for part in slices(batch, 0, TRAIN_SLICE):
                    flat, stops = coded(part.column(0), known)
                    n = np.diff(stops)
                    for i in np.flatnonzero(n > LONG).tolist():
                        waiting.append(flat[stops[i] : stops[i + 1]].astype(np.int16))
                    short = n <= LONG
                    counts += expected_counts(now, flat[np.repeat(short, n)], np.concatenate([[0], np.cumsum(n[short])]))
                    if sum(map(len, waiting)) > WAITING:
                        counts += settle()
            if waiting:
                counts += settle()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), *[pa.array(counts[:, s]) for s in range(STATES)]], names=["i", *columns])

        summed = mapped(rows.select("text"), run, "i int, " + ", ".join(f"{c} double" for c in columns))
        counts = np.zeros((CLASSES + STATES + 1, STATES))
        for r in summed.groupBy("i").agg(*[F.sum(c) for c in columns]).collect():  # one row for each class and state
            counts[r[0]] = r[1:]
        shared.unpersist()
        return Model.estimated(counts)

    model = Model.random()
    drawn = written(train.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / total) * (1 << 30))).select("text"), "start")
    if not drawn.isEmpty():
        for _ in range(START_ROUNDS):
            model = after(model, drawn)
    discard(drawn)
    for _ in range(rounds):
        model = after(model, train)
    return model


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("trained"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    learned = rows.filter("trained")
    counts = written(count_words(learned), "counts")
    texts = learned.count()
    common = common_words(counts)
    own = {w: i for i, w in enumerate(list(common)[: OWN - 1], start=1)}
    by_class = {r[0]: r[1:] for r in counts.groupBy(hashed_class_sql(F.col("word")).alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect()}
    words, distinct = sum(n for n, _ in by_class.values()), sum(v for _, v in by_class.values())
    tokens, kinds = words + texts, distinct + (texts > 0)
    for w in own:
        n, v = by_class[hashed_class(w)]
        by_class[hashed_class(w)] = (n - common[w], v - 1)
    room = np.zeros(CLASSES)  # log10 of a hashed class's tokens, words and one unseen word
    for k in range(OWN, END):
        n, v = by_class.get(k, (0, 0))
        room[k] = math.log10(n + v + 1)
    shared = spark.sparkContext.broadcast((train_model(learned, own), own, common, room))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own, common, room = shared.value
        for batch in batches:
            for part in slices(batch, 2, SCORE_SLICE):
                at, names, ends = words_of(part.column(2))
                c = np.fromiter((common.get(w, 0) for w in names), np.int64, len(names))
                classes = np.fromiter((own.get(w) or hashed_class(w) for w in names), np.int32, len(names))
                flat, stops = sequences(at, classes, ends)
                logs = np.log10(c + 1.0)
                n = np.diff(ends)
                owner = np.repeat(np.arange(len(n)), n)
                add = lambda values: np.bincount(owner, weights=values[at], minlength=len(n)).astype(np.float64)  # noqa: E731, B023
                inner = np.where(classes < OWN, 0.0, logs) - room[classes]
                rare = np.flatnonzero(c[at] == 0)
                pairs, times = np.unique(owner[rare].astype(np.int64) * max(1, len(names)) + at[rare], return_counts=True)
                cut = np.searchsorted(pairs // max(1, len(names)), np.arange(len(n) + 1)).astype(np.int32)
                spelled = pa.array(names, pa.string()).take(pa.array(pairs % max(1, len(names)), pa.int64()))
                arrays = [part.column(0), part.column(1), part.column(3), pa.array(n + 1), pa.array(add((c > 0).astype(float)).astype(np.int64)), pa.array(add(logs)), pa.array(add(inner) + forward(model, flat, stops) / math.log(10))]
                arrays.append(pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([spelled, pa.array(times.astype(np.int32))], ["word", "tf"])))
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "doc_id", "trained", "n_tokens", "known", "logs", "inner", "rare"])

    scored = mapped(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "trained"), run, f"rid long, doc_id {kind}, trained boolean, n_tokens long, known long, logs double, inner double, rare array<struct<word string, tf int>>")
    scored = written(scored, "scored")
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.tf").join(counts, "word")
    rare = rare.groupBy("rid").agg(F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    out = scored.drop("rare").join(rare, "rid", "left").fillna({"rare_known": 0, "rare_logs": 0.0})
    end = math.log10(texts + 1)
    return out.select(
        "doc_id",
        "trained",
        "n_tokens",
        (F.col("known") + F.col("rare_known") + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") + end - F.col("n_tokens") * math.log10(tokens + kinds + 1)).alias("base_score"),
        (F.col("inner") + F.col("rare_logs")).alias("score"),
    )


def held_out_query(docs: DataFrame) -> DataFrame:
    held_out = id_crc() % 7 == 2
    return score(docs, ~held_out).select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
