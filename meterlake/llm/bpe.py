"""BPE encoding and decoding with a pair occurrence index over all new pieces of a batch.

A text is normalised and split into pieces as the vocabulary file says (NFC, lower case, one regex). Pieces not met
before in the task are encoded together: their symbols lie in one array with links to the left and right neighbour,
and an index maps the rank of every mergeable pair to all its positions. Ranks are applied in ascending order from a
heap; each merge updates the lists of the two pairs it creates. Words don't touch one another, so the lowest rank
of all words is the lowest of each word that has it, and the result is that of encoding each word alone.

Cases: null text counts as empty, with no ids; the strings of the file's added tokens in a text become their ids; a
file that lacks a symbol for some byte is refused. An empty table gives no rows;
other columns are ignored. Chunks between white space are remembered up to MEMORY a task, then forgotten, so memory is bounded.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import give_back, mapped, slices, text_of

MEMORY = 200_000
#: Bytes of text that are encoded together.
SLICE = 4_000_000
#: Chunks of a slice whose ids are gathered at a time.
STRETCH = 100_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Stretches:
    """Runs of numbers in one pool, appended in order."""

    def __init__(self) -> None:
        self.pool, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.start = np.concatenate([self.start, np.cumsum(lengths) - lengths + len(self.pool)])
        self.length = np.concatenate([self.length, lengths])
        self.pool = np.concatenate([self.pool, values])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs one after another, and the number of values before each run and at the end."""
        size = self.length[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.start[at] - upto[:-1], size) + np.arange(upto[-1])], upto


class PairIndexBPE:
    """Encoder and decoder for a tokenizers file of kind BPE with word ends, a split regex and byte-level symbols."""

    def __init__(self, spec: str):
        import regex

        j = json.loads(spec)
        kinds = [n["type"] for n in j["normalizer"]["normalizers"]]
        split, level = j["pre_tokenizer"]["pretokenizers"]
        if j["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or (split["type"], level["type"]) != ("Split", "ByteLevel") or j["decoder"] or j["post_processor"]:
            raise ValueError("not a word-end BPE file of the kind that is supported")
        vocab, end = j["model"]["vocab"], j["model"]["end_of_word_suffix"]
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        symbols = byte_symbols()
        self.first = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[symbols[b] + end] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.parts = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        self.made = [vocab[a + b] for a, b in merges]
        codes = self.parts[:, 0] << 20 | self.parts[:, 1]
        self.rank_of = np.argsort(codes)
        self.codes = codes[self.rank_of]
        self.forget()

    def forget(self) -> None:
        """Known chunks (what stands between white space) as stretches of pieces, known pieces as stretches of ids."""
        self.chunk, self.chunks = {}, Stretches()
        self.piece, self.ids = {t: i for i, t in enumerate(self.added)}, Stretches()
        self.ids.add(np.array(list(self.added.values()), np.int32), np.ones(len(self.added), np.int64))

    def split(self, chunk: str) -> list[str]:
        """Pieces of a chunk. No piece spans white space."""
        if chunk.isascii():
            piece = chunk.lower()
        else:  # lower case by single characters: only the final sigma differs from str.lower()
            piece = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [piece] if piece.isalpha() else [chunk] if chunk in self.added else self.pieces.findall(piece)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it can't be merged."""
        code = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.rank_of[at], -1)

    def learn(self, new: list[str]) -> None:
        """Encode pieces together through the pair occurrence index."""
        raw = np.frombuffer("".join(p + "\n" for p in new).encode(), np.uint8)
        wall = raw == 10
        sym = np.where(wall, -1, self.first[raw]).astype(np.int32)
        ends = np.flatnonzero(wall) - 1
        sym[ends] = self.last[raw[ends]]
        sym = np.append(sym, np.int32(-1))  # also what the first symbol's left link, -1, meets
        n = len(sym) - 1
        right, left = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(rank: np.ndarray, spots: np.ndarray) -> None:
            """Add the positions to the lists of their pairs."""
            ok = np.flatnonzero(rank >= 0)
            if not len(ok):
                return
            rank, spots = rank[ok], spots[ok]
            order = np.argsort(rank, kind="stable")
            rank, spots = rank[order], spots[order]
            at = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for i, r in enumerate(rank[at[:-1]].tolist()):
                part = spots[at[i] : at[i + 1]]
                if r in where:
                    where[r].append(part)
                else:
                    where[r] = [part]
                    heapq.heappush(heap, r)

        if n:
            note(self.ranks(sym[: n - 1], sym[1:n]), np.arange(n - 1, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            (a, b), c, lists = self.parts[r], self.made[r], where.pop(r)
            spots = lists[0] if len(lists) == 1 else np.concatenate(lists)
            spots = spots[(sym[spots] == a) & (sym[right[spots]] == b)]
            if a == b or len(lists) > 1:
                spots = np.unique(spots)
            if a == b and len(spots) > 1:  # in a row of equal symbols the pairs go from the left
                taken, free = [], -1
                for i, j in zip(spots.tolist(), right[spots].tolist(), strict=True):
                    if i != free:
                        taken.append(i)
                        free = j
                spots = np.array(taken, np.int32)
            if not len(spots):
                continue
            gone = right[spots]
            after, before = right[gone], left[spots]
            sym[spots], sym[gone] = c, -2
            right[spots], left[after] = after, spots
            # A neighbour may have been merged by this same rank; the symbols are looked up after all merges.
            made = np.full(len(spots), c, np.int32)
            note(np.concatenate([self.ranks(made, sym[after]), self.ranks(sym[before], made)]), np.concatenate([spots, before]))
        alive = sym[:n] >= 0
        self.ids.add(sym[:n][alive], np.diff(np.cumsum(alive)[np.flatnonzero(wall)], prepend=0))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text ends (with a leading 0)."""
        import pyarrow.compute as pc

        for t in self.added:
            if pc.any(pc.match_substring(texts, t)).as_py():
                texts = pc.replace_substring(texts, t, f" {t} ")
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.chunk) + len(names) > MEMORY:
            self.forget()
        new = [c for c in names if c not in self.chunk]
        if new:
            pieces = [self.split(c) for c in new]
            unknown = set().union(*pieces) - self.piece.keys()
            if unknown:
                unknown = list(unknown)
                self.piece.update(zip(unknown, range(len(self.piece), len(self.piece) + len(unknown)), strict=True))
                self.learn(unknown)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = chain.from_iterable(pieces)
            self.chunk.update(zip(new, range(len(self.chunk), len(self.chunk) + len(new)), strict=True))
            self.chunks.add(np.fromiter(map(self.piece.__getitem__, flat), np.int32, int(sizes.sum())), sizes)
        at = np.fromiter(map(self.chunk.__getitem__, names), np.int32, len(names))
        which = at[np.asarray(coded.indices)]
        found, upto = [np.zeros(0, np.int32)], np.zeros(len(which) + 1, np.int64)
        for i in range(0, len(which), STRETCH):
            pieces, chunk_ends = self.chunks.take(which[i : i + STRETCH])
            flat, piece_ends = self.ids.take(pieces)
            found.append(flat)
            upto[i : i + len(chunk_ends)] = upto[i] + piece_ends[chunk_ends]
        return np.concatenate(found), upto[np.asarray(split.offsets)]

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The file names no decoder, so tokens are joined by spaces."""
        import pyarrow.compute as pc

        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.tokens.take(pa.array(flat))), " ")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the tokens of every whole text and what they decode to.

    The vocabulary file is read once by the driver and sent to the executors (a file of a few MB, whatever the input).
    """
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here makes cycles, and the collector would walk the known pieces again and again; released() switches
        # it on again.
        gc.disable()
        bpe = PairIndexBPE(spec.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                flat, ends = bpe.encode_batch(part.column(1))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, bpe.decode(flat, ends)], names=["doc_id", "ids", "decoded"])
                del flat, ends, ids
                give_back()

    return mapped(df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_columns() -> list[Column]:
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() returns."""
    return coded.select("doc_id", *digest_columns())
