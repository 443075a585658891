"""Near-duplicate classes: ProbMinHash signatures of weighted word shingles, banding, exact verification.

Texts are compared as lower-case words between white space; a shingle is SHINGLE words in a row (a shorter text is one
shingle) and weighs 1 + ln(times it occurs). ProbMinHash: each shingle is a Poisson process whose rate is its weight;
every arrival falls on a random register, which keeps the shingle of its earliest arrival, and a shingle's process
ends once its next arrival is later than every register's. Two texts agree on a register with the probability of
their probability Jaccard similarity. BANDS bands of ROWS registers make buckets. Verification takes shingles as sets,
and a repeated passage can make the probability Jaccard similarity far less than the one of the sets; so a text with
repeats has the bands of both signatures, that of its weights and that of weight 1 (for other texts they are the same).
With weight 1 registers agree with the probability of the sets' Jaccard similarity: at 0.8 a pair misses all bands with
probability 4e-4, repeats or not.

Copies (equal words) are one node from the start. In a bucket, all nodes are compared with its first node, so no
group is expanded into pairs; texts travel once to the pairs and the Jaccard similarity of the shingle sets is
computed exactly. Connected components follow by label propagation. In buckets whose other nodes are then still in several
components, the nodes of different components are compared block against block; only links leave a block. So every
pair of a bucket is in one component or has been verified, and no link is lost after banding.

Result: one row a document with class_id (the smallest doc_id of its class) and class_size. Cases: null text counts as
empty; a text without words is a class of its own; a class without any id has a null class_id; repeated rows are
copies, and as nothing tells them apart (the same id and text) all of them are `first` where one is. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import WS, discard, mapped, slices, text_of, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
#: Bytes of text whose signatures are computed together.
SLICE = 2_000_000
#: Nodes of a bucket that are compared with one another in one unit.
CHUNK = 1024

_GOLDEN, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text position, hash) of every shingle of every text, in order, repeats included."""
    import pyarrow.compute as pc
    import xxhash

    if not isinstance(texts, pa.Array):
        texts = texts.combine_chunks()
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = names[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)
    ends = np.asarray(split.offsets)
    ends = (ends - ends[0]).astype(np.int64)
    empty = np.asarray(pc.equal(texts, "").fill_null(True)) if len(texts) else np.zeros(0, bool)
    n = len(words)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    h = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, n)):
        h[: n - i] += mix(words[i:] + np.uint64((i + 1) * _GOLDEN % (1 << 64)))
    whole = np.zeros(n, bool)
    if n >= SHINGLE:
        whole[: n - SHINGLE + 1] = owner[: n - SHINGLE + 1] == owner[SHINGLE - 1 :]
    doc, out = [owner[whole]], [mix(h[whole])]
    for d in np.flatnonzero((np.diff(ends) < SHINGLE) & ~empty):
        own = words[ends[d] : ends[d + 1]]
        if len(own):
            doc.append(np.array([d]))
            out.append(mix(np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(own)) % (1 << 64)], np.uint64) + np.uint64(len(own))))
    return np.concatenate(doc), np.concatenate(out)


def weighted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text position, hash, weight) of the distinct shingles, by position and hash."""
    doc, h = shingle_hashes(texts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    return doc[at], h[at], 1 + np.log(np.diff(np.append(at, len(h))))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """docs x registers: the hash of the shingle whose process is first at each register; 0 where there is no shingle."""
    when = np.full(docs * registers, np.inf)
    held = np.zeros(docs * registers, np.uint64)
    t, state = np.zeros(len(h)), h.copy()
    while len(h):
        state = state + np.uint64(_GOLDEN)
        u = mix(state)
        t = t - np.log1p(-((u >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        slot = doc * registers + (mix(u ^ np.uint64(_M2)) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(t < when[slot])
        late = better[np.argsort(-t[better], kind="stable")]  # of several arrivals at a register the earliest is written last
        when[slot[late]], held[slot[late]] = t[late], h[late]
        alive = t < when.reshape(docs, registers).max(axis=1)[doc]
        doc, h, weight, t, state = doc[alive], h[alive], weight[alive], t[alive], state[alive]
    return held.reshape(docs, registers)


def band_keys(held: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(held), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + np.uint64(r + 1) + held[:, r::ROWS][:, :BANDS])
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), WS, " "))


def own_hash(text_col: str) -> Column:
    return F.xxhash64(text_of(text_col))


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest of the words, hash of the text, n shingles, bands."""
    text = canonical(text_of(text_col))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                doc, h, weight = weighted(part.column(2))
                n = np.bincount(doc, minlength=part.num_rows).astype(np.int32)
                keys = band_keys(prob_minhash(doc, h, np.ones(len(h)), part.num_rows, BANDS * ROWS))
                again = np.unique(doc[weight > 1])  # texts that repeat a shingle: bands of the weights, after the others
                own = np.isin(doc, again)
                more = band_keys(prob_minhash(np.searchsorted(again, doc[own]), h[own], weight[own], len(again), BANDS * ROWS))
                row = np.concatenate([np.arange(part.num_rows), again])
                order = np.argsort(row, kind="stable")
                ends = np.cumsum(BANDS * np.bincount(row, minlength=part.num_rows))
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate([keys, more])[order].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(n), bands], names=["doc_id", "digest", "own", "n", "bands"])

    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), own_hash(text_col).alias("own")).select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text", "own")
    return mapped(rows, run, f"doc_id {kind}, digest binary, own long, n int, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for part in slices(batch, 2, SLICE // 2):
                a, b, ta, tb = (part.column(i) for i in range(4))
                doc, h, _ = weighted(ta)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                keep = []
                for i, key in enumerate(b.to_pylist()):
                    if key != last:
                        last, own = key, weighted(tb.slice(i, 1))[1]
                    mine = h[at[i] : at[i + 1]]
                    both = len(np.intersect1d(mine, own, assume_unique=True))
                    keep.append(both >= threshold * (len(mine) + len(own) - both) - 1e-9)
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ta = texts.select(F.col("digest").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("digest").alias("b"), F.col("text").alias("tb"))
    return mapped(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb"), run, "a binary, b binary")


def across(rest: DataFrame, bands: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between nodes of one bucket (key, digest, n, comp, size) and different components.

    A bucket is dealt into chunks of about CHUNK nodes, and each two chunks make a unit of bounded size. A pair that
    shares several buckets is compared in those of the first band only.
    """
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("digest"), parts).cast("int")
    dealt = rest.select("*", own.alias("own")).select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "n", "comp")
    dealt = dealt.join(bands, "digest").join(texts, "digest")

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        key, i, j = (int(pdf[c].iloc[0]) for c in ("key", "i", "j"))
        pdf = pdf.sort_values(["own", "digest"])
        digest, n = pdf["digest"].to_list(), pdf["n"].to_numpy()
        side = pdf["own"].to_numpy() == j
        label = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
        keys = np.stack([np.resize(b, 2 * BANDS) for b in pdf["bands"]])  # bands of weight 1, then of the weights
        band = int(np.flatnonzero(keys[0] == key)[0]) % BANDS
        keys = [keys[:, :band], keys[:, BANDS : BANDS + band]]
        doc, h, _ = weighted(pa.array(pdf["text"].to_list(), pa.string()))
        code = np.unique(h, return_inverse=True)[1]
        at = np.searchsorted(doc, np.arange(len(digest)))
        inside = np.zeros(int(code.max(initial=0)) + 1, bool)
        found = []
        for x in range(len(digest)):
            if i != j and side[x]:
                break
            y = (label != label[x]) & side & (np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x]) - 1e-9)
            y[: x + 1] = False
            if y.any():
                for one in keys:
                    for other in keys:
                        y &= ~(one == other[x]).any(axis=1)
            if not y.any():
                continue
            mine = code[at[x] : at[x] + n[x]]
            inside[mine] = True
            both = np.add.reduceat(inside[code], at)
            inside[mine] = False
            near = np.flatnonzero(y & (both >= threshold * (n + n[x] - both) - 1e-9))
            for z in near:
                found.append((digest[x], digest[z]))
            label[np.isin(label, label[near])] = label[x]
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.groupBy("key", "i", "j").applyInPandas(unit, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node of each node's component, by label propagation with pointer jumping."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF("u", "v")
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("comp")).withColumnRenamed("u", "node"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        step = labels.join(seen.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = written(step.join(jump, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"), (F.col("old") != F.coalesce("far", "comp")).alias("moved")), "labels")
        discard(labels)
        labels = step
        if step.filter("moved").isEmpty():
            discard(both)
            return labels


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, whether the row is the first of its class, and the digest and hash of its text."""
    rows = written(signatures(df, id_col, text_col), "signatures")
    nodes = rows.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("low"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    member = nodes.select(F.explode(F.array_distinct("bands")).alias("key"), "digest", "n")
    bucket = member.groupBy("key").agg(F.min(F.struct("digest", "n")).alias("low"), F.max("digest").alias("high")).filter("low.digest <> high").drop("high")
    shared = written(member.join(bucket, "key"), "buckets")

    # The text of one row of each node; by id and hash as well, so that the copies of a hot text lie in many tasks.
    bearer = nodes.join(shared.select("digest").distinct(), "digest", "left_semi").select(F.col("digest").alias("d"), F.col("low.doc_id").alias("i"), F.col("low.own").alias("o"))
    bearer = written(bearer, "bearers")
    texts = df.select(canonical(text_of(text_col)).alias("text"), F.col(id_col).alias("doc_id"), own_hash(text_col).alias("own")).select(F.unhex(F.md5("text")).alias("digest"), "doc_id", "own", "text")
    same = (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("own") == F.col("o"))
    # A merge join at every size: the bearers grow with the input, so they are never sent to all tasks.
    texts = written(texts.join(bearer.hint("merge"), same, "left_semi").select("digest", "text").dropDuplicates(["digest"]), "texts")
    discard(bearer)

    alike = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9  # else the union is too large

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.filter(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()

    star = shared.select(F.col("digest").alias("x"), "n", F.col("low.digest").alias("y"), F.col("low.n").alias("m"))
    checked = written(ordered(star), "pairs")
    # The hub comes second, where verify() remembers its shingles.
    links = written(verify(checked.select(F.col("b").alias("a"), F.col("a").alias("b")), texts, threshold), "links")
    discard(checked)
    comp = components(links)
    known = shared.join(comp.select(F.col("node").alias("digest"), "comp"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    known = known.filter("digest <> low.digest")
    open_ = known.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key", "size")
    rest = written(known.select("key", "digest", "n", "comp").join(open_, "key"), "open")
    spent = [rest, shared, texts, links]
    if not rest.isEmpty():
        spent += [comp]
        links = written(links.union(across(rest, nodes.select("digest", "bands"), texts, threshold)), "links")
        comp = components(links)
        spent += [links]
    discard(*spent)
    grouped = nodes.select("digest", "low", "copies").join(comp.select(F.col("node").alias("digest"), "comp"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    classes = grouped.groupBy("comp").agg(F.min("low").alias("low"), F.sum("copies").alias("class_size"))
    classes = grouped.select("digest", "comp").join(classes, "comp").select("digest", F.col("low.doc_id").alias("class_id"), F.col("low.own").alias("low_own"), "class_size")
    out = rows.select("doc_id", "digest", "own", "n").join(classes, "digest", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("own") == F.col("low_own")))).alias("first"),
        "digest",
        "own",
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df without those that are not the first of their class; all columns stay as they are."""
    gone = near_classes(df, id_col, text_col, threshold).filter(~F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"), F.col("own").alias("gone_own"))
    digest = F.unhex(F.md5(canonical(text_of(text_col))))
    here = df.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), digest.alias("row_digest"), own_hash(text_col).alias("row_own"))
    same = (F.col("row_digest") == F.col("gone_digest")) & (F.col("row_own") == F.col("gone_own")) & F.col("row_id").eqNullSafe(F.col("gone_id"))
    return here.join(written(gone, "gone"), same, "left_anti").select("row.*")
