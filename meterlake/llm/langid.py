"""Language identification by compression: the language whose dictionary shortens a text most.

One zstandard raw-content dictionary for each language holds text of that language. A text is cut into stretches of
CHUNK bytes, every stretch is compressed with every dictionary, and the sizes are added up over the whole text; the
smallest sum wins. The score is a softmax over the sums (in bits a letter, so that long and short texts compare), and
a text whose margin over the runner-up is under `reject` of the smallest sum is not `accepted`.

The dictionaries are fitted on a bounded sample: about DOCS texts a language, PART characters of each, DICT bytes in
all, drawn uniformly by a hash of the id; with more than TOTAL / DICT languages, as much less for each of them, so that the
driver and every task hold TOTAL bytes at most. Everything else reads whole texts.

Cases: a text that is null, empty or without letters is `und` with score 0 and not accepted; so is every text if
nothing can be learned. Ties go to the language first by name. A repeated row is predicted like the first; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import id_crc, mapped, slices, text_of

DOCS, PART, DICT, TOTAL = 300, 1200, 98_304, 64 << 20
CHUNK = 2048
#: Bytes of text that are predicted together.
SLICE = 4_000_000
#: zstandard's match finder: four-byte matches, a lazy parse. Faster levels miss the short words that tell languages apart.
FINDER = {"window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 3, "min_match": 4, "strategy": 4}
#: The share of the smallest sum that the runner-up must be above it.
REJECT = 0.02
#: Runs of letters, and of the few signs like a raised 2 or a Roman numeral that are no letters.
WORD = re.compile(r"[^\W\d_]+")
#: Bits a letter by which one language must beat another for odds of e.
SOFT = 0.08


def plain(text: str) -> str:
    """What is compressed: lower case, everything but letters a space."""
    words = WORD.findall(text.lower())
    return " ".join(w for w in (w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in words) if w)


def fit(df: DataFrame, train: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Raw dictionary content by language; about DOCS * PART characters a language reach the driver."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.coalesce(train, F.lit(False)) & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    size = min(DICT, TOTAL // len(counts))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, DOCS * size / DICT / n))]), F.col("lang"))
    drawn = rows.filter((F.pmod(F.xxhash64("i", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)) < share)
    # The stretch starts somewhere in the text: a text's opening is no better sample than its middle.
    start = F.pmod(F.xxhash64("i", F.lit(5)), F.greatest(F.lit(1), F.length("t") - PART)).cast("int") + 1
    parts: dict[str, set[str]] = {}
    for lang, part in drawn.select("lang", F.substring("t", start, F.lit(PART))).toLocalIterator():
        parts.setdefault(lang, set()).add(plain(part))
    return {k: (" ".join(sorted(v)).encode()[-size:] or b" ") for k, v in sorted(parts.items())}


def predict(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """doc_id, lang_pred, score, margin, accepted for every row. Broadcast: DICT bytes for each language."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        langs = sorted(shared.value)
        coders = []
        for lang in langs:
            content = zstandard.ZstdCompressionDict(shared.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **FINDER)
            content.precompute_compress(compression_params=how)
            coders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=content).compress)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                data = plain(text).encode()
                if not data or not langs:
                    out.append(("und", 0.0, 0.0, False))
                    continue
                stretches = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
                sizes = [sum(len(c(s)) for s in stretches) for c in coders]
                low = min(sizes)
                odds = [math.exp(-8.0 * (s - low) / len(data) / SOFT) for s in sizes]
                margin = 1.0 if len(sizes) < 2 else (sorted(sizes)[1] - low) / low
                out.append((langs[sizes.index(low)], 1.0 / sum(odds), margin, margin >= reject))
            lang, score, margin, accepted = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "margin", "accepted"])

    return mapped(df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), run, f"doc_id {kind}, lang_pred string, score double, margin double, accepted boolean")


def held_out_query(docs: DataFrame) -> DataFrame:
    out = predict(docs, fit(docs, id_crc() % 5 != 0))
    return out.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "lang_pred", "score", "margin", "accepted")
