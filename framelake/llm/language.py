"""Language identification by prediction by partial matching (PPM).

For every language a variable-order tree of byte contexts is counted on training
text. A symbol not seen in a context costs the context's escape probability and
is coded by the next shorter context, without the symbols that the longer one
could have coded (exclusion), so that the probabilities of a context sum to one.
The statistics are then frozen: every context's code lengths are tabulated, and
a text's exact code length under each language is a sum of table entries. The
language with the shortest code wins.

Training sees a bounded sample of labelled documents (``TRAIN_DOCS`` a language,
those with the smallest id hashes, of at most ``TRAIN_BYTES`` together); all languages
that training rows name are learned. A language's table has rows for its own contexts
and columns for its own bytes only: some megabytes. Prediction covers every byte of
every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Longest context in bytes.
ORDER = 3
#: Bounds of the training sample, for each language.
TRAIN_DOCS = 300
TRAIN_BYTES = 600_000
#: Contexts of the greatest order that are seen less often are left to shorter ones.
LEAST_SEEN = 3
#: Bytes of text that are scored together.
CHUNK = 1 << 20
UNKNOWN = "und"
#: Values of a byte, and what stands before a text.
VALUES = 257


class Table:
    """One language's code lengths in bits. Bytes that its training never saw are one
    symbol, 0, and so is what stands before a text. Only contexts that occurred have a
    row: ``two`` leads from the last two bytes to a row (that of the last byte where the
    pair is new), ``three`` from there and the byte before to the final one."""

    def __init__(self, symbol: np.ndarray, two: np.ndarray, three: np.ndarray, bits: np.ndarray):
        self.symbol, self.two, self.three, self.bits = symbol, two, three, bits
        self.size = bits.shape[1]

    @classmethod
    def learn(cls, texts: list[bytes], least: int) -> Table:
        used = np.zeros(256, dtype=bool)
        for t in texts:
            used[np.unique(np.frombuffer(t, np.uint8))] = True
        kinds = int(used.sum())
        symbol = np.zeros(256, dtype=np.int32)
        symbol[used] = np.arange(1, kinds + 1)
        size = kinds + 1
        s = np.concatenate([np.concatenate([[0, 0, 0], symbol[np.frombuffer(t, np.uint8)]]) for t in texts] or [np.zeros(0, np.int32)]).astype(np.int64)
        lengths = np.array([len(t) + 3 for t in texts], dtype=np.int64)
        at = np.arange(len(s)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.flatnonzero(at >= 3)
        now, one, two, three = s[at], s[at - 1], s[at - 2], s[at - 3]
        shorter = np.full((1, size), 1.0 / VALUES)
        shorter[0, 0] = (VALUES - kinds) / VALUES  # all values that are symbol 0, together
        shorter = _blend(np.bincount(now, minlength=size)[None, :], shorter)
        p1 = _blend(np.bincount(one * size + now, minlength=size * size).reshape(size, size), np.repeat(shorter, size, axis=0))
        pair = two * size + one
        pairs, row = np.unique(pair, return_inverse=True)
        p2 = _blend(np.bincount(row * size + now, minlength=len(pairs) * size).reshape(-1, size), p1[pairs % size])
        lead2 = np.tile(np.arange(size, dtype=np.int32), size)
        lead2[pairs] = size + np.arange(len(pairs), dtype=np.int32)
        deep, row3, seen = np.unique((row + size) * size + three, return_inverse=True, return_counts=True)
        often = np.flatnonzero(seen >= least)
        number = np.full(len(deep), -1)
        number[often] = np.arange(len(often))
        inside = number[row3] >= 0
        counts = np.bincount(number[row3[inside]] * size + now[inside], minlength=len(often) * size).reshape(-1, size)
        p3 = _blend(counts, p2[deep[often] // size - size])
        lead3 = np.repeat(np.arange(size + len(pairs), dtype=np.int32), size)
        lead3[deep[often]] = size + len(pairs) + np.arange(len(often), dtype=np.int32)
        bits = -np.log2(np.concatenate([p1, p2, p3]))
        bits[:, 0] += np.log2(VALUES - kinds)  # one value of those that symbol 0 stands for
        return cls(symbol, lead2, lead3, bits.astype(np.float32))

    def length(self, before: bytes, text: np.ndarray) -> float:
        """Bits of the bytes ``text``, which follow ``before``."""
        s = np.concatenate([np.zeros(3 - len(before), np.int32), self.symbol[np.frombuffer(before, np.uint8)], self.symbol[text]])
        row = self.two[s[1:-2] * self.size + s[2:-1]]
        row = self.three[row * self.size + s[:-3]]
        return float(self.bits[row, s[3:]].sum(dtype=np.float64))


class Model:
    """A table for each language. ``plain`` and ``of`` turn it into arrays and back."""

    def __init__(self, samples: dict[str, list[bytes]], least: int = LEAST_SEEN):
        self.languages = sorted(samples)
        self.tables = [Table.learn(samples[k], least) for k in self.languages]

    def plain(self) -> list[tuple]:
        return [(k, t.symbol, t.two, t.three, t.bits) for k, t in zip(self.languages, self.tables)]

    @classmethod
    def of(cls, plain: list[tuple]) -> Model:
        model = cls({})
        model.languages, model.tables = [p[0] for p in plain], [Table(*p[1:]) for p in plain]
        return model

    def lengths(self, text: bytes) -> np.ndarray:
        """Exact code length of the text under each language, in bits."""
        total = np.zeros(len(self.tables))
        whole = np.frombuffer(text, np.uint8)
        for start in range(0, len(text), CHUNK):
            before, part = text[max(0, start - 3) : start], whole[start : start + CHUNK]
            total += [t.length(before, part) for t in self.tables]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its posterior under equal priors; ``und``, 0 if there is no
        letter (Unicode category L)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.lengths(text.encode("utf-8", "surrogatepass"))
        best = int(np.argmin(bits))  # ties: the first language by name
        odds = np.exp2(np.maximum(bits[best] - bits, -1000.0))
        return self.languages[best], float(1.0 / odds.sum())


def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of a context from its counts and the next shorter context's
    probabilities: escape method C with exclusion. Contexts never seen pass through."""
    seen = counts > 0
    total, kinds = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
    rest = np.where(seen, 0.0, shorter)
    left = rest.sum(axis=1, keepdims=True)
    escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0.0)
    coded = np.where(seen, counts / np.maximum(total, 1) * (1.0 - escape), 0.0)
    return np.where(total > 0, coded + escape * rest / np.where(left > 0, left, 1.0), shorter)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text is divisible by ``folds``; a null id is the text ``null``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))) % folds == 0


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = TRAIN_DOCS, sample_bytes: int = TRAIN_BYTES) -> Model:
    """A model from the rows that are not held out and have a language and a text."""
    order = F.xxhash64(F.lit(folds), F.col(doc_id).cast("string"))
    rows = docs.where(~held_out(doc_id, folds) & F.col(lang).isNotNull())
    # of a sampled text at most so many characters as all samples of a language may have bytes
    rows = rows.select(F.col(lang).alias("_lang"), order.alias("_order"), F.substring(F.col(text).cast("string"), 1, sample_bytes).alias("_text"))
    counts = rows.groupBy("_lang").agg(F.least(F.lit(1.0), F.lit(2.0 * sample) / F.count("*")).alias("_share"))
    # of each language, the part of the hash range that holds twice the sample
    place = (F.col("_order").cast("double") + 2.0**63) / 2.0**64
    first = Window.partitionBy("_lang").orderBy("_order", "_text")
    # one row a language, as the model itself has a table for each: the texts stay where they are
    some = rows.join(F.broadcast(counts), "_lang").where((place <= F.col("_share")) & (F.octet_length("_text") > 0))
    some = some.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample)
    so_far = F.coalesce(F.sum(F.octet_length("_text")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = some.withColumn("_before", so_far).where(F.col("_before") < sample_bytes).collect()  # bounded by the sample
    samples: dict[str, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: (r["_lang"], r["_order"], r["_text"])):
        samples.setdefault(r["_lang"], []).append(r["_text"].encode("utf-8", "surrogatepass"))
    return Model(samples)


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the score is the posterior probability
    of the language among those learned (0 where the prediction is ``und``).

    Null and empty texts and texts without letters give ``und``; very long texts are
    scored whole, a part at a time; of languages with equal lengths (a tie) the first
    by name wins; repeated rows stay repeated; other columns are ignored; without any
    training text every prediction is ``und``; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.of(shared.value)
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
