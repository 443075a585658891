"""The operators against brute force on small tables, with the cases that every one of them defines."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import bpe, exact_dedup, hmm, langid, mixing, near_dedup, pii, sharding, topk, toxicity

WS = re.compile(r"[\x20\x09-\x0D]+")
#: Nulls, empty and long texts, ties, repeated rows, a null id, and columns whose names the operators use themselves.
ODD = [
    (1, "same text here", "en"),
    (2, "same  text\there", "en"),
    (2, "same  text\there", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "  \n ", "de"),
    (6, "word " * 30_000, "en"),
    (None, "same text here", "fr"),
    (None, "only one", None),
    (7, "12 !!", "en"),
    (7, "another text under the same id", "en"),
]
SCHEMA = "doc_id long, text string, lang string, kept string, shard string, score string, bucket string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, "k", "s", "x", "b", None) for i, t, g in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i):
    return zlib.crc32(str("" if i is None else i).encode())


def test_exact_dedup_odd(odd, empty):
    rows = exact_dedup.exact_dedup(odd, carry=["doc_id", "kept"]).collect()
    assert len(rows) == len(ODD)
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault(WS.sub(" ", t or ""), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        assert r.row.doc_id == r.doc_id and r.row.kept == "k"
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_hot_group(spark):
    """A third of the rows are one text: its rows are dealt over several pieces and meet again."""
    texts = ["hot text"] * 700 + [f"text {i % 900}" for i in range(1400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(df).collect()
    first, size = {}, Counter(texts)
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows} == {(i, first[t], size[t], first[t] == i) for i, t in enumerate(texts)}


def test_sharding(spark, odd, empty):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    for frame, n in ((df, 5000), (odd, len(ODD))):
        rows = sharding.shard(frame).collect()
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == n and max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in ODD)
    assert sharding.shard(empty).collect() == []


def test_sharding_walk_against_single_rows():
    """Counts moved in runs give the loads that rows walking one by one give, and most rows stay at home."""
    rng = np.random.default_rng(2)
    owners = rng.permutation(np.repeat(np.arange(6), 10)).tolist()
    counts = rng.integers(0, 40, 60).tolist()
    counts[7] += 500
    n = sum(counts)
    capacity = [n // 6 + (s < n % 6) for s in range(6)]
    out = sharding.walk(counts, owners, capacity)
    loads, seen = [0] * 6, Counter()
    for arc, lo, hi, shard, slot in sorted(out, key=lambda x: (x[3], x[4])):
        assert slot == loads[shard]
        loads[shard] += hi - lo
        seen[arc] += hi - lo
    assert loads == capacity and all(seen[a] == counts[a] for a in range(60))
    home = [sum(c for c, o in zip(counts, owners, strict=True) if o == s) for s in range(6)]
    assert sum(hi - lo for a, lo, hi, s, _ in out if s == owners[a]) == sum(min(h, c) for h, c in zip(home, capacity, strict=True))
    for arc, lo, hi, shard, _ in out:  # between home and the place found, no shard has room left
        at = arc
        while owners[at] != shard:
            assert loads[owners[at]] == capacity[owners[at]]
            at = (at + 1) % 60


def test_sharding_against_single_rows(spark):
    """Every row walks the ring by itself: first those that find room at home, arc by arc, then the overflow clockwise."""
    texts = ["hot text"] * 400 + [f"text {i}" for i in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = sharding.ring(5, 4)
    at = df.select("doc_id", sharding.point(F.col("doc_id").cast("string"), F.col("text")).alias("p")).collect()
    arcs = {i: [] for i in range(len(nodes))}
    for r in sorted(at, key=lambda r: (bytes(r.p), r.doc_id)):
        before = sum(p <= int.from_bytes(r.p, "big") for p, _ in nodes)
        arcs[before % len(nodes)].append(r.doc_id)
    n = len(texts)
    room, over, home = [n // 5 + (s < n % 5) for s in range(5)], [], {}
    for arc in range(len(nodes)):
        for i in arcs[arc]:
            s = nodes[arc][1]
            if room[s]:
                room[s], home[i] = room[s] - 1, s
            else:
                over.append((arc, i))
    for arc, i in over:
        while not room[nodes[arc % len(nodes)][1]]:
            arc += 1
        s = nodes[arc % len(nodes)][1]
        room[s], home[i] = room[s] - 1, s
    got = sharding.shard(df, shards=5, vnodes=4).collect()
    assert {r.doc_id: r.shard for r in got} == home


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 20)).round(1)
    vectors[50:90] = vectors[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 20), (None, vectors[0].tolist()), (3, vectors[3].tolist()), (403, []), (404, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("r"))
    found = topk.topk(df, F.col("vec_id") % 50 == 0)
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows[:400]] + [(3, np.floor(256 * vectors[3]).astype(int)), (None, np.floor(256 * vectors[0]).astype(int))]
    expect = []
    for q in range(0, 400, 50):
        score = sorted(((-int(whole[q][1] @ v), i is None, i) for i, v in whole if i != q), key=lambda x: x[:2] + (x[2] or 0,))[:5]
        expect += [(q, r, i, -s) for r, (s, _, i) in enumerate(score, 1)]
    assert sorted(tuple(r) for r in found.collect() if r.vec_id is not None) == sorted(e for e in expect if e[2] is not None)
    assert found.filter("vec_id is null").count() == sum(e[2] is None for e in expect)
    assert topk.topk(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_topk_of_large_and_empty_and_repeated_vectors(spark, monkeypatch):
    """Components of any finite size, vectors without components, a row that occurs many times, several blocks and groups."""
    monkeypatch.setattr(topk, "UNIT", 8 * 3 * 64)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).round(2).tolist()) for i in range(300)]
    rows += [(500, [2.0**60, 1.5, -(2.0**70)]), (501, [1e300, 0.0, 0.1]), (550, [-(2.0**54), 2.0**54, 3.0]), (600, []), (601, []), (602, [])] + [(7, rows[7][1])] * 8
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {}
    for i, v in rows:
        whole.setdefault(i, [[int(x) * 256 if abs(x) >= 2**53 else int(np.floor(256 * x)) for x in v], 0])[1] += 1
    got = {}
    for r in topk.topk(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, (own, _) in whole.items():
        if q % 50:
            continue
        score = []
        for i, (v, n) in whole.items():
            if i != q and len(v) == len(own):
                score += [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=True)))), i)] * n
        assert sorted(got[q]) == [(r, i, -s) for r, (s, i) in enumerate(sorted(score)[:5], 1)], q


def test_topk_prunes_nothing_that_counts():
    rng = np.random.default_rng(4)
    for dims in (1, 16, 40):
        rows, queries = rng.integers(-300, 300, (300, dims)), rng.integers(-300, 300, (7, dims))
        q, c, s = topk.best(queries, np.arange(7) + 1000, rows, np.arange(300), 5)
        all_scores = queries @ rows.T
        for i in range(7):
            want = sorted(zip((-all_scores[i]).tolist(), range(300), strict=True))[:5]
            assert [(-int(x), int(y)) for x, y in zip(s[q == i], c[q == i], strict=True)] == want


def test_bpe_like_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    texts = [t for _, t, _ in ODD] + ["a\x1cb  c", "<|endoftext|>hi<|startoftext|> <|endoftext", "ΟΔΟΣ İstanbul ﬁ Å", "aaaaaaa aaa !!!! !!!", "don't we'LL I'm 's", "x²½ ٣ 漢字 😀😀 é ̈ äb", "a\x85b c d​e ﻿", "___ a_b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    coded = {r.doc_id: r for r in bpe.encode(df).collect()}
    digests = {r.doc_id: r for r in bpe.digests(bpe.encode(df)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert coded[i].ids == ids
        assert coded[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(coded[i].decoded.encode()).hexdigest()
    assert bpe.digests(bpe.encode(odd)).count() == len(ODD) and bpe.encode(empty).collect() == []


def test_bpe_forgets_and_goes_on(monkeypatch):
    import pyarrow as pa

    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        own = bpe.PairIndexBPE(f.read())
    first = own.encode_batch(pa.array(["one two", "three"]))[0].tolist()
    monkeypatch.setattr(bpe, "MEMORY", 4)
    monkeypatch.setattr(bpe, "STRETCH", 2)
    own.encode_batch(pa.array(["four five six seven"]))
    assert own.encode_batch(pa.array(["one two", "three"]))[0].tolist() == first


def test_near_dedup_against_all_pairs(spark, odd, empty):
    rng = np.random.default_rng(3)
    texts = {}
    for g in range(30):
        base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        for c in range(4):
            words = list(base)
            for at in rng.integers(0, 120, c * 2):
                words[at] = f"z{rng.integers(0, 9999)}"
            texts[len(texts)] = " ".join(words)
    texts |= {500: "Two words", 501: "two  WORDS", 502: None, 503: "", 504: texts[0]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("class_id", F.lit("x"))
    got = {r.doc_id: r for r in near_dedup.near_classes(df).collect()}
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    sizes = Counter(root(i) for i in texts)
    for i in texts:
        assert (got[i].class_id, got[i].class_size) == (root(i), sizes[root(i)]), i
    assert near_dedup.near_classes(odd).count() == len(ODD)
    assert near_dedup.near_classes(empty).collect() == []


def test_near_dedup_bucket_of_many_components(spark, monkeypatch):
    """Variants of one template that mostly fall short of 0.8 of one another, in chunks smaller than the bucket."""
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    rng = np.random.default_rng(8)
    base = [f"t{x}" for x in range(60)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.choice(60, 2, replace=False):
            words[at] = f"u{rng.integers(0, 6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(56)} for t in texts]
    linked = [(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert linked and all(got[i] == got[j] for i, j in linked)


def test_near_dedup_repeated_passages(spark):
    """Pairs of Jaccard similarity 0.8 or more where what differs is a passage that occurs 50 times."""
    rng = np.random.default_rng(11)
    texts = []
    for g in range(25):
        base = [f"g{g}w{x}" for x in rng.integers(0, 10**6, 90)]
        texts += [" ".join(base), " ".join(base + [f"g{g}r{x}" for x in range(14)] * 50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    linked = [(i, j) for i in range(50) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert linked == [(i + 1, i) for i in range(0, 50, 2)] and all(got[i] == got[j] for i, j in linked)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(6)
    h = rng.integers(1, 2**63, 60).astype(np.uint64)
    wa, wb = rng.gamma(2, size=40), rng.gamma(2, size=40)
    doc = np.repeat([0, 1], 40)
    held = near_dedup.prob_minhash(doc, np.concatenate([h[:40], h[20:]]), np.concatenate([wa, wb]), 2, 4000)
    a, b = dict(zip(h[:40], wa, strict=True)), dict(zip(h[20:], wb, strict=True))
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b)) for d in set(a) & set(b))
    assert abs((held[0] == held[1]).mean() - exact) < 0.03


def test_language_id_by_plain_compression(spark, sf):
    """Every text against every dictionary, without the operator's loop."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    content = langid.fit(docs, F.lit(True))
    how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **langid.FINDER)
    rows = {r.doc_id: r for r in langid.predict(docs, content).collect()}
    for r in docs.collect():
        data = " ".join(re.findall(r"[^\W\d_]+", (r.text or "").lower())).encode()
        size = {}
        for lang, c in content.items():
            own = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size[lang] = sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=own).compress(data[i : i + langid.CHUNK])) for i in range(0, len(data), langid.CHUNK))
        assert rows[r.doc_id].lang_pred == (min(sorted(size), key=size.get) if data else "und")
    signs = spark.createDataFrame([(1, "² ½ Ⅷ 12"), (2, "²x")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(signs, content).orderBy("doc_id").collect()] == [True, False]


def test_language_id(spark, odd, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in langid.held_out_query(docs).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    held = [i for i in rows if rows[i].held_out and truth[i].lang]
    assert all(rows[i].held_out == (crc(i) % 5 == 0) for i in rows) and len(rows) == len(truth)
    assert np.mean([rows[i].lang_pred == truth[i].lang for i in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())
    out = langid.held_out_query(odd).collect()
    assert len(out) == len(ODD) and Counter(r.lang_pred == "und" for r in out)[True] == 4
    assert langid.held_out_query(empty).collect() == []


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(4)) for _ in range(400)]
    insults = ["grumbolt", "snarfel", "vexnit"]
    docs, marks = [], []
    for i in range(600):
        text = rng.choice(words, 30).tolist()
        if i % 3 == 0:
            text[int(rng.integers(0, 30))] = insults[i % 9 // 3]
        docs.append((i, " ".join(text)))
        marks.append((i, int(i % 3 == 0)))
    extra = ["a gr.um.bolt here", "a s n a r f e l here", "a vexxnit here", "a GRUMB0LT here"]
    df = spark.createDataFrame(docs + [(1000 + i, t) for i, t in enumerate(extra)] + [(2000, "nothing of that kind"), (2001, None)], "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(3, None), (None, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.held_out_query(df, labels).collect()}
    assert all(rows[i].predicted == y for i, y in marks)
    assert all(rows[1000 + i].predicted == 1 for i in range(len(extra))), [rows[1000 + i].score for i in range(4)]
    assert rows[2000].predicted == 0 and rows[2001].predicted == 0 and rows[1].held_out == (crc(1) % 4 == 2)
    assert toxicity.held_out_query(odd, labels.limit(0)).count() == len(ODD)
    assert toxicity.held_out_query(empty, labels).collect() == []


def test_toxicity_reads_whole_words():
    """Insults glued in mid-token, behind signs, far into a long token, and with three or more inserted letters."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(4)) for _ in range(400)]
    texts, toxic = [], []
    for i in range(600):
        text = rng.choice(words, 30).tolist()
        if i % 3 == 0:
            text[int(rng.integers(0, 30))] = ["grumbolt", "snarfel", "vexnit"][i % 9 // 3]
        texts.append(" ".join(text))
        toxic.append(int(i % 3 == 0))
    model = toxicity.Classifier(texts, np.array(toxic), np.ones(600))
    plain = " ".join(words[:20])
    hidden = ["hello,grumbolt", "you/snarfel", "#whatavexnit", "subgrumboltish", "la" * 300 + "snarfel" + "la" * 300, "gxrxuxmxbxoxlxt", "sqwnqwaqwrqwfqwel", "you,vzezxznzizt"]
    hidden += ["la" * n + "gxrxuxmxbxoxlxt" for n in range(30, 60)]
    score = model.scores(pa.array([f"{plain} {w}" for w in hidden] + [plain, plain + " hello,there " + "la" * 300]))
    assert (score[:-2] >= toxicity.THRESHOLD).all(), score
    assert (score[-2:] < toxicity.THRESHOLD).all(), score


def test_pooled_by_single_words():
    """What a text's words, one by one and stretch by stretch, have in common with the landmarks; remembered or not."""
    import pyarrow as pa

    marks = ["grumbolt", "vexnit", "snarf"]
    kernel = toxicity.Kernel(marks)
    own = {m: toxicity.raw_kernel(toxicity.codes([m], 20), toxicity.codes([m], 20))[0, 0] for m in marks}

    def value(x, m):
        a, b = toxicity.codes([x], 20), toxicity.codes([m], 20)
        return toxicity.raw_kernel(a, b)[0, 0] / np.sqrt(max(toxicity.raw_kernel(a, a)[0, 0] * own[m], 1e-12))

    def slow(word, m):
        size, found = len(m), [0.0]
        if len(word) >= max(toxicity.ORDER, 0.7 * size):
            for i in range(max(1, len(word) - size + 1)):
                x = word[i : i + size + 2]
                if len(set(x) & set(m)) >= 0.7 * len(set(m)):
                    found.append(value(x, m))
        ends = {i: i for i, c in enumerate(word) if c == m[0]}  # end -> latest beginning
        for c in m[1:]:
            ends = {j: max(ends[i] for i in range(j - toxicity.GAP - 1, j) if i in ends) for j in range(len(word)) if word[j] == c and any(i in ends for i in range(j - toxicity.GAP - 1, j))}
        for z, a in ends.items():
            found.append(value("".join(c for c in word[a : z + 1] if c in m)[: size + 2], m))
        return max(found) ** toxicity.SHARPEN

    texts = ["a grumbolt xgrxumxbolty", "vexnit, ve-x-n-i-t snarfsnarf", "sqnqaqrqf boltgrum tinxev " + "la" * 60 + "snraf", "", "nothing here"]
    want = [[max([slow(toxicity.plain_word(t), m) for t in text.split()], default=0) for m in marks] for text in texts]
    for _ in range(2):
        assert np.allclose(toxicity.pooled(kernel, pa.array(texts)), want, atol=1e-4)


def test_toxicity_fit_takes_bounded_memory(monkeypatch):
    """Of the driver: clean words are not counted, and the same model comes of small slices and a short memory."""
    import tracemalloc

    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join([*map("".join, rng.choice(letters, (400, 9))), "grumbolt" if i % 3 == 0 else "kind"]) for i in range(300)]
    toxic = np.array([int(i % 3 == 0) for i in range(300)])
    tracemalloc.start()
    model = toxicity.Classifier(texts, toxic, np.ones(300))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * sum(map(len, texts)), peak
    monkeypatch.setattr(toxicity, "FIT_SLICE", 10_000)
    monkeypatch.setattr(toxicity, "HELD", 7)
    again = toxicity.Classifier(texts, toxic, np.ones(300))
    assert (again.kernel.rows == model.kernel.rows).all()
    assert np.allclose([*again.w, again.a, again.b], [*model.w, model.a, model.b])


def test_toxicity_forgets_and_goes_on(monkeypatch):
    import pyarrow as pa

    kernel = toxicity.Kernel(["grumbolt", "vexnit"])
    texts = [pa.array([f"grumbolt vexnit{i} w{i}", "vexxnit"]) for i in range(8)]
    first = [toxicity.pooled(kernel, t) for t in texts]
    monkeypatch.setattr(toxicity, "MEMORY", 3)
    kernel.forget()
    assert all((toxicity.pooled(kernel, t) == f).all() for t, f in zip(texts, first, strict=True))


def test_pair_kernel_like_the_kernel_of_all_pairs():
    rows = toxicity.codes(["stupid", "stuxpid", "aabbaa", "cat"], 12)
    assert np.allclose(toxicity.pair_kernel(rows, rows[::-1]), np.diagonal(toxicity.raw_kernel(rows, rows[::-1])), rtol=1e-4)


def test_string_kernel_by_enumeration():
    from itertools import combinations

    def slow(s, t):
        def spans(x):
            out = Counter()
            for at in combinations(range(len(x)), toxicity.ORDER):
                out["".join(x[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
            return out

        a, b = spans(s), spans(t)
        return sum(a[k] * b[k] for k in a)

    words = ["stupid", "stuxpid", "aabbaa", "cat", "at"]
    rows = toxicity.codes(words, 12)
    fast = toxicity.raw_kernel(rows, rows)
    assert np.allclose(fast, [[slow(s, t) for t in words] for s in words], rtol=1e-4)
    assert np.allclose(toxicity.Kernel(["cat"]).diagonal(rows), [slow(s, s) for s in words], rtol=1e-4)


def test_mixing_meets_its_targets(spark, odd, empty):
    cells = {("a", "x", "p"): 10.0, ("a", "y", "p"): 30.0, ("b", "x", "q"): 50.0, ("b", "y", "p"): 10.0, ("b", "x", "p"): 5.0}
    targets = [{"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6}, {"p": 0.8, "q": 0.2}]
    raked = mixing.rake(cells, targets)
    for axis, target in enumerate(targets):
        for m, want in target.items():
            assert abs(sum(v for k, v in raked.items() if k[axis] == m) - want) < 1e-6
    rows = [(i, "word " * 20, "big" if i % 10 else "small", "en") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kept = Counter(r.source for r in mixing.mix(df, targets=[{"big": 0.5, "small": 0.5}, {"en": 1.0}, {"prose": 1.0}]).filter("kept").collect())
    assert kept["small"] == 400 and 330 < kept["big"] < 470
    again = mixing.mix(df).filter("kept").agg(F.sum("doc_id")).first()[0]
    assert again == mixing.mix(df.repartition(7)).filter("kept").agg(F.sum("doc_id")).first()[0]
    out = mixing.mix(odd, carry=["kept"]).collect()
    assert len(out) == len(ODD) and all(r.row.kept == "k" for r in out)
    assert mixing.mix(empty).collect() == []


def test_mixing_by_hand(spark, sf):
    """The whole query on a small table: cells counted, raked and scaled by loops of the test's own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    drawn = {r[0]: r[1] for r in docs.select("doc_id", mixing.draw(F.col("doc_id"), F.coalesce("text", F.lit("")))).collect()}
    cell, tokens = {}, {}
    for r in docs.collect():
        t = r.text or ""
        topic = next((n for n, signs in mixing.TOPICS if any(s in t for s in signs)), "prose")
        cell[r.doc_id], tokens[r.doc_id] = (r.source or "none", r.lang or "none", topic), len([w for w in WS.split(t) if w])
    mass = Counter()
    for i, k in cell.items():
        mass[k] += tokens[i]
    total = sum(mass.values())
    share = {k: v / total for k, v in mass.items()}
    now = dict(share)
    for _ in range(500):
        for axis in range(3):
            have, want = Counter(), Counter()
            for k, v in now.items():
                have[k[axis]] += v
            for k, v in mass.items():
                want[k[axis]] += v
            want = {m: v**mixing.TEMPER for m, v in want.items() if v}
            now = {k: v * want[k[axis]] / sum(want.values()) / have[k[axis]] if v else 0.0 for k, v in now.items()}
    low, high = 0.0, 1e6  # the largest factor at which cells lack SHORT of what is wanted
    for _ in range(200):
        mid = (low + high) / 2
        lack = sum(max(0.0, now[k] * mid - share[k]) for k in share) / mid
        low, high = (mid, high) if lack <= mixing.SHORT else (low, mid)
    for i, r in got.items():
        p = min(1.0, now[cell[i]] * low / share[cell[i]]) if share[cell[i]] else 1.0
        assert (r.source, r.lang, r.topic, r.tokens) == (*cell[i], tokens[i]) and abs(r.probability - p) < 1e-6
        assert r.kept == (tokens[i] == 0 or drawn[i] < r.probability)


def test_mixing_kept_share_does_not_hang_on_a_rare_cell():
    def kept(cells):
        margins = [{k[i]: sum(v for c, v in cells.items() if c[i] == k[i]) for k in cells} for i in range(3)]
        chance = mixing.probabilities(cells, [mixing.tempered(m) for m in margins])
        assert all(0 <= p <= 1 for p in chance.values())
        return sum(chance[k] * v for k, v in cells.items()) / sum(cells.values()), chance

    cells = {(a, b, c): 1e5 * (i + 1) * (j + 2) * (k + 1) for i, a in enumerate("stu") for j, b in enumerate("xy") for k, c in enumerate("pq")}
    rare = ("new", "new", "p")
    for size in (1, 300):
        large = {k: v * size for k, v in cells.items()}
        share, _ = kept(large)
        other, chance = kept(large | {rare: 5.0})
        assert chance[rare] == 1 and abs(share - other) < 0.001 and share > 0.6
    assert mixing.probabilities({rare: 0.0}, [{}, {}, {}]) == {rare: 1.0}
    assert mixing.probabilities({rare: 3.0}, [{"new": 0.0}, {}, {}]) == {rare: 0.0}


def test_mixing_with_more_cells_than_the_driver_rakes(spark):
    """600 sources x 2 languages x 4 topics: every one keeps its own margin, a source named `other` among them."""
    signs = ["", " a@b", " icens", " | "]
    rows = []
    for s in range(600):
        for g in range(2):
            rows += [(len(rows) + t, "word " * (5 + s % 7 + 3 * g + t) + sign, f"s{s}" if s else "other", "xy"[g]) for t, sign in enumerate(signs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    named = {f"s{s}" if s else "other": (2 if s % 2 else 1) / 900 for s in range(600)}
    for targets in (None, [named, {"x": 0.5, "y": 0.5}, {"prose": 0.25, "contact": 0.25, "legal": 0.25, "table": 0.25}]):
        got = mixing.mix(df, targets=targets).collect()
        cells = {(r.source, r.lang, r.topic): float(r.tokens) for r in got}
        assert len(got) == len(cells) == 4800
        margins = [mixing.tempered({m: sum(v for k, v in cells.items() if k[i] == m) for m in {k[i] for k in cells}}) for i in range(3)] if targets is None else targets
        want = mixing.probabilities(cells, margins)
        assert all(abs(r.probability - want[r.source, r.lang, r.topic]) < 1e-6 for r in got)


def test_surrogates(spark, odd, empty):
    own = pii.Surrogates(b"k")
    text = "Mr. John Smith, mail j.smith.42@mail8.example.com or call +1 (255) 555-8013 from 42.144.35.254; card 4587121519400672, token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" password=b7db7aa4a5fcc78305. Maria Lopez. Again j.smith.42@mail8.example.com"
    new, spans = own.replace(text)
    assert Counter(k for _, _, k, _ in spans) == Counter(email=2, phone=1, ip=1, card=1, secret=2, name=2)
    for a, b, _, s in spans:
        assert text[a:b] != s and text[a:b] not in new and s in new
        assert [c.isdigit() for c in s] == [c.isdigit() for c in text[a:b]] or "." in s or len(s) == len(text[a:b])
    emails = [s for _, _, k, s in spans if k == "email"]
    assert emails[0] == emails[1] and emails[0].endswith("@mail8.example.com")
    given = {s.split()[0] for _, _, k, s in spans if k == "name" and not s.startswith("Mr")}
    assert given <= set(pii.NAMES["f", "latin"])
    assert pii.Surrogates(b"k").replace(text)[0] == new and pii.Surrogates(b"other").replace(text)[0] != new
    cards = {own.card(f"4{x:015d}") for x in range(3000)}
    assert len(cards) == 3000 and len({own.ip(f"10.0.{x // 250}.{x % 250}") for x in range(3000)}) == 3000
    perm = pii.Permutation(b"k", 1000)
    assert sorted(perm(x) for x in range(1000)) == list(range(1000)) and all(perm.back(perm(x)) == x for x in range(1000))
    assert sorted(perm.moved(x) for x in range(1000)) == list(range(1000)) and all(perm.moved(x) != x for x in range(1000))
    assert pii.pseudonymise(odd, b"k").count() == len(ODD) and pii.pseudonymise(empty, b"k").collect() == []
    rows = {r.doc_id: r.text for r in pii.pseudonymise(odd.filter("doc_id is not null"), b"k").collect()}
    assert rows[3] is None and rows[4] == ""


#: Texts with two entities that differ in case, in what belongs to the domain, in leading zeros or in script only.
PAIRS = [
    "bob@Gmail.com and bob@gmail.com",
    "x@ab.com and x@a.bcom",
    "a.b@foo.com and a.b.foocom@example.com",
    "10.0.0.1 and 10.0.0.01",
    "token=ABCdef123456 and key=abcdef123456",
    "Dr Παπαδοπουλος and Mr 李明",
    "0.0.0.0 and 255.0.255.0",
    "Mr Ćwikła and Mr Cwikla",
    "555-123-4567 and 555.123.4567",
    "2001:0db8:85a3:0000:0000:8a2e:0370:7334 and fe80:0:1::2ab3",
    "DE89370400440532013000 and GB82 WEST 1234 5698 7654 32",
    "my name is Xerxes Okonkwo and Ich heiße Okonkwo",
    "078-05-1120 and 078-05-1121",
]


@pytest.mark.parametrize("text", PAIRS)
def test_surrogates_of_like_spellings(text):
    """Both are found, neither stays, they stay apart, and each has the surrogate that it has in any other text."""
    new, spans = pii.Surrogates(b"k").replace(text)
    assert len(spans) == 2 and spans[0][3] != spans[1][3]
    for a, b, _, s in spans:
        assert text[a:b] != s and text[a:b] not in new
        assert not any(x == y for x, y in zip(text[a:b].split(), s.split(), strict=True) if x[0] != "M" and x[0] != "D")
        alone = pii.Surrogates(b"k").replace(text[max(0, a - 11) : b])[1]
        assert alone[-1][3] == s
    assert [k for _, _, k in pii.find(new)] == [k for _, _, k, _ in spans]


def test_surrogates_in_time_and_in_every_document(spark):
    """Thousands of entities in one text; an entity has one surrogate in all documents, whatever stands beside it."""
    import time

    began = time.process_time()
    assert len(pii.find(" ".join(f"u{i}@m{i}.com" for i in range(40_000)))) == 40_000
    assert time.process_time() - began < 10
    mails = [f"{c}{d}@example.com" for c in "abcdefghij" for d in "xyz"]
    docs = [(i, "; ".join(np.random.default_rng(i).permutation(mails)[: 3 + i])) for i in range(20)]
    seen = {}
    for r in pii.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string"), b"k").collect():
        for e in r.entities:
            seen.setdefault(docs[r.doc_id][1][e.start : e.end], set()).add(e.surrogate)
    assert all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == len(seen)


def test_surrogates_of_whole_domains():
    """Texts with all names of a list or all one-letter mailboxes: none is refused, and surrogates are distinct and those of any other text."""
    lists = [[f"Miss {n}" for n in names] for names in pii.NAMES.values()]
    lists += [[f"{c}@example.com" for c in "abcdefghijklmnopqrstuvwxyz"], ["x.fooorg@example.com", "x@foo.org"]]
    for entities in lists:
        new, spans = pii.Surrogates(b"k").replace("; ".join(entities))
        made = [s for _, _, _, s in spans]
        assert len(spans) == len(set(made)) == len(entities) and new == "; ".join(made)
        assert made == [pii.Surrogates(b"k").replace(e)[0] for e in entities] and not any(m == e for m, e in zip(made, entities, strict=True))


def test_lm_score(spark, odd, empty):
    import math

    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice([f"{'ab'[i % 2]}{x}" for x in range(60)], 40)) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "unseen WORDS a1")], "doc_id long, text string")
    rows = {r.doc_id: r for r in hmm.held_out_query(df).collect()}
    docs = {r.doc_id: [w for w in WS.split((r.text or "").lower()) if w] + [None] for r in df.collect()}
    c = Counter(w for i, ws in docs.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in docs.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, crc(i) % 7 == 2)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert r.score <= 0
    held = [i for i in range(200) if crc(i) % 7 == 2]
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held) + 5 * len(held)
    assert hmm.held_out_query(odd).count() == len(ODD) and hmm.held_out_query(empty).collect() == []


def test_lm_score_of_whole_texts(spark):
    """`score` word by word: the trained model's forward probabilities and each word's share of its class; one text has 1,000 words and more."""
    import math

    rng = np.random.default_rng(21)
    names = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"] + [f"w{i}" for i in range(900)]
    weights = 1 / np.arange(1, len(names) + 1)
    texts = [" ".join(rng.choice(names, n, p=weights / weights.sum())) for n in [3, 40, 1200, 2500] + [30] * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(700, None), (701, "never seen")], "doc_id long, text string")
    rows = {r.doc_id: r for r in hmm.held_out_query(df).collect()}
    docs = {r.doc_id: (r.text or "").split() for r in df.collect()}
    trained = {i: w for i, w in docs.items() if crc(i) % 7 != 2}
    c = Counter(w for ws in trained.values() for w in ws)
    own = {w: i for i, w in enumerate(sorted(c, key=lambda w: (-c[w], w))[: hmm.OWN - 1], 1)}
    model = hmm.train_model(df.fillna("", ["text"]).filter(F.col("doc_id").isin(list(trained))), own)
    room = Counter()
    for w in c:
        if w not in own:
            room[hmm.hashed_class(w)] += c[w] + 1
    for i, ws in docs.items():
        x, total = None, 0.0
        for w in [*ws, None]:
            k = hmm.END if w is None else own.get(w) or hmm.hashed_class(w)
            x = (model.start if x is None else x @ model.move) * model.emit[k]
            total += math.log10(x.sum()) + (0 if k < hmm.OWN or w is None else math.log10((c[w] + 1) / (room[k] + 1)))
            x = x / x.sum()
        assert abs(rows[i].score - total) < 1e-6 * max(1, abs(total)), i


def test_expected_counts_of_long_texts():
    """Against a plain forward-backward pass over each whole text, across the stretches that are computed again."""
    rng = np.random.default_rng(1)
    model, n = hmm.Model.random(4), [1000, 3, 0, 70, 33, 32, 31, 500]
    stops = np.concatenate([[0], np.cumsum(n)])
    flat = rng.integers(0, hmm.CLASSES, stops[-1]).astype(np.int32)
    want = np.zeros((hmm.CLASSES + 5, 4))
    for a, b in zip(stops[:-1], stops[1:], strict=True):
        seq, alphas, scales = flat[a:b], [], []
        for t, k in enumerate(seq):
            x = (model.start if t == 0 else alphas[-1] @ model.move) * model.emit[k]
            scales.append(x.sum())
            alphas.append(x / x.sum())
        beta = np.ones(4)
        for t in range(len(seq) - 1, -1, -1):
            want[seq[t]] += alphas[t] * beta
            if t == 0:
                want[-1] += alphas[t] * beta
            else:
                out = model.emit[seq[t]] * beta / scales[t]
                want[hmm.CLASSES : hmm.CLASSES + 4] += model.move * np.outer(alphas[t - 1], out)
                beta = model.move @ out
    assert np.allclose(hmm.expected_counts(model, flat, stops), want)


def test_hmm_recursions_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(13)
    model = hmm.Model.random(3)
    flat, stops = rng.integers(0, hmm.CLASSES, 9).astype(np.int32), np.array([0, 4, 4, 9])
    got, counts = hmm.forward(model, flat, stops), hmm.expected_counts(model, flat, stops)
    want = np.zeros_like(counts)
    for d in range(3):
        seq = flat[stops[d] : stops[d + 1]]
        paths = {}
        for path in product(range(3), repeat=len(seq)):
            p = 1.0
            for t, (s, k) in enumerate(zip(path, seq, strict=True)):
                p *= (model.start[s] if t == 0 else model.move[path[t - 1], s]) * model.emit[k, s]
            paths[path] = p
        total = sum(paths.values())
        assert abs(got[d] - np.log(total)) < 1e-9
        for path, p in paths.items() if len(seq) else ():
            for t, (s, k) in enumerate(zip(path, seq, strict=True)):
                want[k, s] += p / total
                if t:
                    want[hmm.CLASSES + path[t - 1], s] += p / total
                else:
                    want[-1, s] += p / total
    assert np.allclose(counts, want)


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    from meterlake.llm.common import BATCH, BATCH_SETTING, mapped

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["b"])

    texts = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    had = spark.conf.get(BATCH_SETTING, None)
    try:
        spark.conf.unset(BATCH_SETTING)
        got = [r.b for r in mapped(texts, sizes, "b long").collect()]
        assert spark.conf.get(BATCH_SETTING) == str(BATCH)
        assert len(got) >= 4 and max(got) < 1.1 * BATCH
        spark.conf.set(BATCH_SETTING, "1000000")
        got = [r.b for r in mapped(texts, sizes, "b long").collect()]
        assert spark.conf.get(BATCH_SETTING) == "1000000" and max(got) < 1_100_000
    finally:
        spark.conf.unset(BATCH_SETTING)
        if had is not None:
            spark.conf.set(BATCH_SETTING, had)
