"""The pipeline's stages against brute force, each on what the one before it kept."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterlake.llm import bpe, common, mixing

WS = re.compile(r"[\x20\x09-\x0D]+")
INSULTS = ["grumbolt", "snarfel", "vexnit"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic texts, exact and near copies, nulls, empty texts, repeated rows, a null id, ties."""
    rng = np.random.default_rng(17)
    words = ["".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(4)) for _ in range(400)]
    docs, labels = [], []
    for i in range(240):
        text = rng.choice(words, 30).tolist()
        toxic = i % 4 == 0
        if toxic:
            text[int(rng.integers(0, 30))] = INSULTS[i % 3]
        docs.append((i, " ".join(text), ["en", "de", None][i % 3], f"s{i % 5 // 4}"))
        labels.append((i, int(toxic)))
    for i in range(1, 20, 2):  # near copies of clean texts: one word of 30 appended or prepended
        docs.append((1000 + i, docs[i][1] + " extra", "en", "s1"))
        docs.append((1100 + i, docs[i][1].replace(" ", "  "), "en", "s1"))
    docs += [(2000, None, "en", None), (2001, "", "en", "s1"), (2002, " \n", "en", "s1"), (None, "without an id " * 9, "de", "s2"), (2003, "tie of two rows", "en", "s1"), (2003, "tie of two rows", "en", "s1")]
    where = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, g, s, len(t or "")) for i, t, g, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_stages(spark, corpus):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, corpus), "test")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = (sorted(docs.collect(), key=key), sorted(out.collect(), key=key))
        docs = out

    before, after = kept["toxicity"]
    assert after == [r for r in before if not any(w in (r.text or "") for w in INSULTS)]

    before, after = kept["exact_dedup"]
    first = {}
    for r in before:
        first.setdefault(WS.sub(" ", r.text or ""), r)  # in order of ids, null ids last
    assert after == sorted(first.values(), key=key)

    before, after = kept["near_dedup"]
    sets = []
    for r in before:
        w = (r.text or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert after == [r for i, r in enumerate(before) if root[i] == i] and len(after) < len(before)

    before, after = kept["mixing"]
    chance = {(r.doc_id, r.tokens): r.probability for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
    drawn = spark.createDataFrame(before, docs.schema).select(F.struct("*").alias("r"), mixing.draw(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("d"), mixing.token_count(F.coalesce("text", F.lit(""))).alias("n")).collect()
    assert after == sorted((x.r for x in drawn if x.n == 0 or x.d < chance[x.r.doc_id, x.n]), key=key) and len(after) < len(before)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    last = {(r.doc_id, r.ids_sha256): r for r in corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()}
    assert len(last) == len(after)
    for r in after:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert last[r.doc_id, sha].ids == ids and last[r.doc_id, sha].n_tokens == len(ids)
    whole = corpus_pipeline.run(spark, corpus).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256) for r in whole) == sorted((i is None, i or 0, sha) for i, sha in last)


def test_stages_of_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).collect() == []


def test_tables_lie_in_a_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert common.shared_dir(spark) == named
    out = common.written(spark.range(3).toDF("x"), "some")
    assert out._written.startswith(f"{named}/some-") and out.count() == 3
    common.discard(out)

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: {"spark.sql.warehouse.dir": "/shared/"}.get(name, default))})

    assert common.shared_dir(Unset()) == "/shared/meterlake-intermediate"
