"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words is the sum over their common subsequences of ORDER characters, each weighed DECAY to the
stretch it spans in either word, and normalised to 1 for equal words. Gaps cost weight but don't break a match, so a
word with an inserted, dropped or starred character stays near the word it hides; separators inside a token are
stripped, look-alike digits become letters, and runs of single letters are read as one word.

Landmarks are the words and word stems that tell toxic from other labelled texts best, none the beginning of another;
among equals the longest. A text's kernel vector holds, for each landmark, the largest kernel value of its words, each
compared over its whole length: with every stretch of it, and, where the landmark's letters stand in order with up to
GAP others between two, without those others. A token's parts at signs are compared as the one word they form; the Nystroem map K^-1/2 turns it into features of the kernel's
space, a linear SVM (squared hinge) separates them, and a logistic fit on its margin gives the score.

Fitting reads a bounded sample of labelled rows: about TRAIN texts of each label, drawn by a hash of the id; of texts over
TRAIN_CHARS characters all distinct words. Scoring reads whole texts. A stretch is compared with the landmarks that share most of its
letters; for all others the kernel counts as 0.

Cases: null text counts as empty, and a text without words has the score of an empty one; without labels of both
kinds every score is 0; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import give_back, id_crc, released, small_batches, text_of, text_slices

ORDER, DECAY = 3, 0.6
LANDMARKS, LANDMARK_CHARS = 40, 14
#: Lengths of the word beginnings that may be landmarks besides whole words.
STEMS = (4, 5, 6, 7)
#: The normalised kernel is raised to this power (itself a kernel), which sets near matches off from chance ones.
SHARPEN = 3
TRAIN, TRAIN_CHARS = 2500, 20_000
#: Bytes of text that are scored together, words whose stretches are looked at together, and stretches compared together.
SLICE, WORDS, PAIRS = 4_000_000, 8192, 16_384
#: Bytes of training text that the driver looks at together, and words whose stems it remembers.
FIT_SLICE, HELD = 1_000_000, 50_000
#: Words whose kernel values a task remembers.
MEMORY = 300_000
#: Letters that may stand between two of a landmark's.
GAP = 2
#: Words are looked at together with those of about their length; longer ones in stretches that overlap.
WIDTHS, OVERLAP = (8, 12, 16, 24, 96), LANDMARK_CHARS + (LANDMARK_CHARS - 1) * GAP
THRESHOLD = 0.3
#: Digits and signs that stand for letters.
LOOKALIKE = str.maketrans("013457@$", "oieastas")
LETTER, OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][\s.\-_*]){3,}[^\W\d_](?!\w)")


def plain_word(token: str) -> str:
    """The letters of a lower-case token."""
    if token.isalpha():
        return token
    if not LETTER.search(token):
        return ""
    word = OTHER.sub("", token.translate(LOOKALIKE))
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def codes(words: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, padded with 0."""
    return np.array([w[:width].ljust(width, "\0") for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width) if words else np.zeros((0, width), np.uint32)


def raw_kernel(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of each word with each other one, by dynamic programming over the words' characters."""
    n, width = words.shape
    m, length = others.shape
    steps = np.arange(length)
    fade = np.where(steps[None, :] >= steps[:, None], DECAY ** (steps[None, :] - steps[:, None]), 0.0).astype(np.float32)
    partial = [np.zeros((n, m, length), np.float32) for _ in range(ORDER - 1)]  # K' of 1 .. ORDER-1 up to each character
    total = np.zeros((n, m), np.float32)
    square = np.float32(DECAY * DECAY)
    for a in range(width):
        if not (words[:, a] != 0).any():
            break
        match = ((words[:, a, None, None] == others[None]) & (others[None] != 0)) * square
        last = partial[ORDER - 2]
        total += (match[:, :, 1:] * last[:, :, :-1]).sum(axis=2)
        for i in range(ORDER - 2, -1, -1):
            if i:
                gain = np.zeros_like(match)
                gain[:, :, 1:] = match[:, :, 1:] * partial[i - 1][:, :, :-1]
            else:
                gain = match
            partial[i] = np.float32(DECAY) * partial[i] + gain @ fade
    return total


def pair_kernel(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The kernel of each word with the other one of its row."""
    n, length = others.shape
    partial = [np.zeros((length + 1, n), np.float32) for _ in range(ORDER)]  # [j + 1]: K' up to character j
    total = np.zeros(n, np.float32)
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    columns, marks = np.ascontiguousarray(words.T), np.ascontiguousarray(others.T)
    for a in range(words.shape[1]):
        match = ((columns[a] == marks) & (marks != 0)) * square
        total += (match * partial[ORDER - 2][:-1]).sum(axis=0)
        for i in range(ORDER - 2, -1, -1):
            gain = match * partial[i - 1][:-1] if i else match
            run = np.zeros(n, np.float32)
            for j in range(length):
                run = decay * run + gain[j]
                partial[i][j + 1] = decay * partial[i][j + 1] + run
    return total


def own_kernel(words: np.ndarray) -> np.ndarray:
    return np.array([raw_kernel(words[i : i + 1], words[i : i + 1])[0, 0] for i in range(len(words))], np.float32)


def letters(words: np.ndarray) -> np.ndarray:
    """The set of a word's letters, hashed to 64 bits."""
    bits = np.left_shift(np.uint64(1), (words % 61).astype(np.uint64))
    return np.bitwise_or.reduce(np.where(words != 0, bits, np.uint64(0)), axis=1)


class Kernel:
    """Normalised kernel values of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.rows = codes(landmarks, LANDMARK_CHARS)
        self.length = (self.rows != 0).sum(axis=1)
        self.own = own_kernel(self.rows)
        self.set = letters(self.rows)
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Known words as runs of (mark, value) in one pool; run 0 is empty."""
        self.known.clear()
        self.start, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.mark, self.value = np.zeros(0, np.int16), np.zeros(0, np.float32)

    def at(self, words: list[str]) -> np.ndarray:
        """The run of each word. A word is compared once a task, as long as it is remembered."""
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if len(self.known) + len(new) > MEMORY:
            self.forget()
            new = list(dict.fromkeys(words))
        if new:
            self.known.update(dict.fromkeys(new, 0))
            some, value = self.near(new)
            self.known.update((new[i], j) for j, i in enumerate(some.tolist(), start=len(self.count)))
            row, mark = np.nonzero(value)
            count = np.bincount(row, minlength=len(some))
            self.start = np.concatenate([self.start, len(self.mark) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.mark, self.value = np.concatenate([self.mark, mark.astype(np.int16)]), np.concatenate([self.value, value[row, mark]])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def raise_by(self, runs: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Raise out[owner] to the values of the runs."""
        size = self.count[runs]
        upto = np.cumsum(size) - size
        spot = np.repeat(self.start[runs] - upto, size) + np.arange(int(size.sum()))
        np.maximum.at(out.reshape(-1), np.repeat(owner * out.shape[1], size) + self.mark[spot], self.value[spot])

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(positions, values) of the words that have a kernel value with some landmark.

        A landmark meets every stretch of a word that is two characters longer than the landmark (the last ones end with
        the word), so that neither what is glued before nor endings hide it. Where its letters stand in the word in
        order but further apart, it meets the word without the letters that are not its own.
        """
        out = np.zeros((len(words), len(self.rows)), np.float32)
        sizes = np.array([len(w) for w in words], np.int64)
        low = 0
        for high in WIDTHS:
            own = np.flatnonzero((sizes > low) & (sizes <= high) & (sizes >= ORDER))
            for at in range(0, len(own), WORDS):
                part = own[at : at + WORDS]
                self.stretch(codes([words[i] for i in part], high + LANDMARK_CHARS + 2), sizes[part], part, out)
            low = high
        for i in np.flatnonzero(sizes > low).tolist():  # overlapping stretches, so that what fits in the overlap is in one
            parts = [words[i][j : j + low] for j in range(0, sizes[i] - OVERLAP, low - OVERLAP)]
            for at in range(0, len(parts), WORDS):
                some = parts[at : at + WORDS]
                self.stretch(codes(some, low + LANDMARK_CHARS + 2), np.array([len(w) for w in some]), np.full(len(some), i), out)
        some = np.flatnonzero(out.any(axis=1))
        return some, out[some] ** SHARPEN

    def stretch(self, rows: np.ndarray, filled: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Raise out[owner] to the kernel values of the rows, which are padded for a window at every character."""
        longest = int(filled.max())
        bits = np.where(rows != 0, np.left_shift(np.uint64(1), (rows % 61).astype(np.uint64)), np.uint64(0))
        whole = np.bitwise_or.reduce(bits, axis=1)
        for size in np.unique(self.length).tolist():
            marks = np.flatnonzero(self.length == size)
            starts = max(1, longest - size + 1)
            seen = bits[:, :starts].copy()
            for k in range(1, size + 2):
                seen |= bits[:, k : k + starts]
            valid = (np.arange(starts)[None, :] <= np.maximum(filled - size, 0)[:, None]) & (filled >= max(ORDER, 0.7 * size))[:, None]
            need = np.ceil(0.7 * np.bitwise_count(self.set[marks]))
            found = []
            for j, mark in enumerate(marks.tolist()):
                word, at = np.nonzero(valid & (np.bitwise_count(seen & self.set[mark]) >= need[j]))
                found.append((word, at, np.full(len(word), mark)))
            word, at, mark = (np.concatenate(x) for x in zip(*found, strict=True))
            for i in range(0, len(word), PAIRS):
                w, a, m = word[i : i + PAIRS], at[i : i + PAIRS], mark[i : i + PAIRS]
                self.raise_to(rows[w[:, None], a[:, None] + np.arange(size + 2)[None, :]], m, owner[w], out)
            for mark in marks.tolist():
                letters_ = self.rows[mark, :size]
                near = np.flatnonzero((filled >= size) & ((whole & self.set[mark]) == self.set[mark]))
                if len(near):
                    self.apart(rows[near, :longest], letters_, mark, owner[near], out)

    def apart(self, rows: np.ndarray, letters_: np.ndarray, mark: int, owner: np.ndarray, out: np.ndarray) -> None:
        """Kernel values where the landmark's letters stand in order with up to GAP others between any two."""
        size = len(letters_)
        # At each character, where the closest match of the landmark so far that ends here began (-1: none ends here).
        begun = np.where(rows == letters_[0], np.arange(rows.shape[1])[None, :], -1)
        for c in letters_[1:]:
            before = np.full_like(begun, -1)
            for gap in range(1, min(GAP + 2, rows.shape[1])):
                before[:, gap:] = np.maximum(before[:, gap:], begun[:, :-gap])
            begun = np.where(rows == c, before, -1)
        word, end = np.nonzero(begun >= 0)
        if not len(word):
            return
        own = set(letters_.tolist())
        kept = np.zeros((len(word), size + 2), np.uint32)
        for i, (w, z) in enumerate(zip(word.tolist(), end.tolist(), strict=True)):
            a = int(begun[w, z])
            left = [c for c in rows[w, a : z + 1].tolist() if c in own][: size + 2]
            kept[i, : len(left)] = left
        self.raise_to(kept, np.full(len(word), mark), owner[word], out)

    def raise_to(self, rows: np.ndarray, mark: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        size = int(self.length[mark[0]])
        value = pair_kernel(rows, self.rows[mark, :size])
        np.maximum.at(out, (owner, mark), value / np.sqrt(np.maximum(pair_kernel(rows, rows) * self.own[mark], 1e-12)))

    def diagonal(self, rows: np.ndarray) -> np.ndarray:
        """The kernel of each word with itself: the same recursion with one other word a row."""
        n, width = rows.shape
        steps = np.arange(width)
        fade = np.where(steps[None, :] >= steps[:, None], DECAY ** (steps[None, :] - steps[:, None]), 0.0).astype(np.float32)
        partial = [np.zeros((n, width), np.float32) for _ in range(ORDER - 1)]
        total = np.zeros(n, np.float32)
        for a in range(width):
            match = ((rows[:, a, None] == rows) & (rows != 0)) * np.float32(DECAY * DECAY)
            total += (match[:, 1:] * partial[ORDER - 2][:, :-1]).sum(axis=1)
            for i in range(ORDER - 2, -1, -1):
                gain = match.copy()
                if i:
                    gain[:, 0], gain[:, 1:] = 0, match[:, 1:] * partial[i - 1][:, :-1]
                partial[i] = np.float32(DECAY) * partial[i] + gain @ fade
        return total


def pooled(kernel: Kernel, texts: pa.Array) -> np.ndarray:
    """For each text and landmark, the largest kernel value of the text's words."""
    import pyarrow.compute as pc

    lower = pc.utf8_lower(texts)
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    runs = kernel.at([plain_word(w) for w in coded.dictionary.to_pylist()])
    offsets = np.asarray(split.offsets)
    ends = offsets - offsets[0]
    out = np.zeros((len(texts), len(kernel.rows)), np.float32)
    at = runs[np.asarray(coded.indices)]
    hit = np.flatnonzero(at)
    kernel.raise_by(at[hit], np.searchsorted(ends, hit, side="right") - 1, out)
    # Words written with a space or sign after each letter.
    spaced = np.flatnonzero(np.asarray(pc.match_substring_regex(lower, r"(^|\s)\pL[\s.\-_*]\pL[\s.\-_*]\pL[\s.\-_*]\pL(\s|$|[\s.\-_*])").fill_null(False)))
    for d in spaced.tolist():
        joined = ["".join(c for c in run if c.isalpha()) for run in SPACED.findall(lower[d].as_py())]
        if joined:
            kernel.raise_by(kernel.at(joined), np.full(len(joined), d), out)
    return out


def within(stems: list[str], texts: list[str]) -> dict[str, int]:
    """How many of the texts hold each stem anywhere in a word, as a landmark meets a word anywhere."""
    wanted, sizes = set(stems), sorted({len(w) for w in stems})
    held: dict[str, frozenset[str]] = {}  # forgotten when full
    count = Counter(dict.fromkeys(stems, 0))
    for text in texts:
        found: set[str] = set()
        for token in set(text.lower().split()):
            if token not in held:
                if len(held) >= HELD:
                    held.clear()
                w = plain_word(token)
                held[token] = frozenset(x for n in sizes for i in range(len(w) - n + 1) if (x := w[i : i + n]) in wanted)
            found |= held[token]
        count.update(found)
    return dict(count)


def landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    """The words and stems that tell toxic from other texts best; only those of at least five toxic texts are counted in the others."""

    def told(label: int) -> Iterator[set[str]]:
        for text, y in zip(texts, toxic.tolist(), strict=True):
            if y == label:
                words = {w[:LANDMARK_CHARS] for w in map(plain_word, text.lower().split()) if len(w) > ORDER}
                yield words | {w[:n] for w in words for n in STEMS}

    seen = Counter()
    for found in told(1):
        seen.update(found)
    seen = {w: n for w, n in seen.items() if n >= 5}
    other = Counter()
    for found in told(0):
        other.update(found & seen.keys())
    bad, good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = {w: n * np.log(((n + 0.5) / bad) / ((other[w] + 0.5) / good)) for w, n in seen.items()}
    inside = within([w for w in odds if odds[w] > 0], [t for t, y in zip(texts, toxic.tolist(), strict=True) if not y])
    odds = {w: seen[w] * np.log(((seen[w] + 0.5) / bad) / ((n + 0.5) / good)) for w, n in inside.items()}
    marks: list[str] = []
    for w in sorted((w for w in odds if odds[w] > 0), key=lambda w: (-odds[w], -len(w), w)):
        if len(marks) < LANDMARKS and not any(w.startswith(m) or m.startswith(w) for m in marks):
            marks.append(w)
    return marks


class Classifier:
    """Landmarks, Nystroem map, SVM weights and the logistic fit on its margin."""

    def __init__(self, texts: list[str], toxic: np.ndarray, weight: np.ndarray):
        self.kernel = Kernel(landmarks(texts, toxic) or ["toxic"])
        gram = (raw_kernel(self.kernel.rows, self.kernel.rows) / np.sqrt(np.outer(self.kernel.own, self.kernel.own))) ** SHARPEN
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        self.map = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        x = np.column_stack([self.features(pa.array(texts, pa.string())), np.ones(len(texts))])
        y = 2.0 * toxic - 1
        self.w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton's method on the squared hinge
            inside = y * (x @ self.w) < 1
            part = x[inside]
            hessian = part.T @ part + 1e-2 * len(x) / 100 * np.eye(x.shape[1])
            step = np.linalg.solve(hessian, part.T @ y[inside])
            if np.allclose(step, self.w, atol=1e-9):
                break
            self.w = step
        margin = x @ self.w
        self.a, self.b = 1.0, 0.0
        z = np.column_stack([margin, np.ones(len(margin))])
        theta, share = np.array([1.0, 0.0]), weight / weight.sum() * len(weight)
        for _ in range(60):  # Newton's method on the logistic loss, with rows at their share of all labelled rows
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            gradient = z.T @ (share * (p - toxic)) + 0.01 * theta
            hessian = (z * (share * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
            theta = theta - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        self.a, self.b = theta

    def features(self, texts: pa.Array) -> np.ndarray:
        """Of all training texts, taken up in slices: the driver holds no more than the words of one at a time."""
        return np.concatenate([np.zeros((0, len(self.map))), *(pooled(self.kernel, part) @ self.map for part in text_slices(texts, FIT_SLICE))])

    def scores(self, texts: pa.Array) -> np.ndarray:
        margin = np.column_stack([pooled(self.kernel, texts) @ self.map, np.ones(len(texts))]) @ self.w
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier | None:
    """A classifier from about TRAIN labelled texts of each label; None without both labels. `train` is over the labels' ids."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & F.coalesce(train, F.lit(False))).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = {y: min(1.0, TRAIN / n) for y, n in counts.items()}
    u = F.pmod(F.xxhash64("i", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    drawn = marked.filter(u < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).groupBy("i").agg(F.max("y").alias("y"))
    # Features are maxima over words, so a long text loses by its distinct words only what is spelled letter by letter.
    words = F.array_join(F.array_distinct(F.split(F.lower(text_col), r"\s+")), " ")
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.when(F.length(text_col) <= TRAIN_CHARS, F.col(text_col)).otherwise(words).alias("t"))
    # The drawn ids are about 2 * TRAIN, whatever the input; repeated ids give one text.
    # As Arrow: the driver's JVM passes the batches on instead of making rows of them.
    found = texts.join(F.broadcast(drawn), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in found.columns), strict=True))
    del found
    if len({y for _, y in rows}) < 2:
        return None
    toxic = np.array([y for _, y in rows])
    model = Classifier([t for t, _ in rows], toxic, np.where(toxic == 1, 1 / share[1], 1 / share[0]))
    del rows
    gc.collect()
    give_back()  # the driver lives on through all later stages
    return model


def score(df: DataFrame, model: Classifier | None, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of every row in a struct `row`, and its score. Broadcast: LANDMARKS words and their weights.

    Only the text goes to the Python worker and only the score comes back; the columns stay in the JVM.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            value = [np.zeros(len(t)) if shared.value is None else shared.value.scores(t) for t in text_slices(texts, SLICE)]
            yield pa.array(np.concatenate([np.zeros(0), *value]))

    run = released(run)

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(columns)

    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), scored(text_of(text_col)).alias("score"))


def held_out_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = id_crc() % 4 == 2
    scored = score(docs, fit(docs, labels, ~held_out), ["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
