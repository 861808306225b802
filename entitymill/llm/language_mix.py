"""Language identification as inference of a mixture of languages.

Every learned language is a distribution over hashed byte n-grams. A text's n-grams
are taken as drawn from a mixture of them; expectation-maximisation estimates the
proportions, and languages join the mixture, largest share first, as long as the
penalised likelihood grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import map_texts, text_blocks
from entitymill.sources.staging import share_code

GRAM = 4
BUCKETS = 1 << 16
#: Languages that are learned at most: their counts come to the driver and go to every task.
MOST_LANGUAGES = 100
#: Result where a text is null or has no letter.
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]")
_WORDS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is a letter of some script; numerals such as fractions are none."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def gram_buckets(raw: bytes) -> np.ndarray:
    """The bucket of every n-gram of the text; A-Z in lower case, other ASCII as blanks."""
    folded = np.frombuffer(b" " + raw.lower().translate(_WORDS) + b" " * (GRAM - 2), np.uint8)
    if len(folded) < GRAM:
        return np.empty(0, np.int64)
    n = len(folded) - GRAM + 1
    key = folded[:n].astype(np.uint32)
    for k in range(1, GRAM):
        key = key << np.uint32(8) | folded[k : k + n]
    return (key * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) over all rows with text and language; summed per block before the shuffle."""
    share_code(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{text_col}`").alias("_text"))
    rows = rows.where("_lang is not null and _text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, texts in text_blocks(batch.column(1), 16_000_000):
                some = langs[a : a + len(texts)]
                for lang in dict.fromkeys(some):
                    total = np.zeros(BUCKETS, np.int64)
                    for text, of in zip(texts, some, strict=True):
                        if of == lang:
                            total += np.bincount(gram_buckets(text), minlength=BUCKETS)
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
                        names=["_lang", "bucket", "n"],
                    )

    counted = rows.mapInArrow(count, "_lang string, bucket long, n long")
    return counted.groupBy("_lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """Names in order and the probability of every bucket in each."""

    names: list[str]
    chance: np.ndarray

    def mixture(self, raw: bytes | None, penalty: float = 6.0) -> list[tuple[str, float]]:
        """(language, share) by falling share; empty if nothing can be said.

        A further language must raise the log-likelihood, counted once per ``GRAM``
        overlapping n-grams, by more than ``penalty`` and half the logarithm of the length.
        """
        if raw is None or not self.names or not has_letter(raw.decode("utf-8", "replace")):
            return []
        counts = np.bincount(gram_buckets(raw), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        weight = counts[at].astype(np.float64)
        chance = self.chance[:, at]
        size = weight.sum()
        share, _ = _em(chance, weight / size)
        order = np.argsort(-share, kind="stable")
        cost = penalty + 0.5 * np.log(size)
        chosen, shares = order[:1], np.ones(1)
        best = weight @ np.log(chance[order[0]]) / GRAM
        for k in range(2, len(order) + 1):
            share, log_likelihood = _em(chance[order[:k]], weight / size)
            value = log_likelihood * size / GRAM - (k - 1) * cost
            if value <= best:
                break
            chosen, shares, best = order[:k], share, value
        by_share = np.argsort(-shares, kind="stable")
        return [(self.names[chosen[i]], float(shares[i])) for i in by_share]


def _em(chance: np.ndarray, weight: np.ndarray, rounds: int = 40, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Shares that maximise the likelihood of n-grams with these relative weights, and its logarithm."""
    share = np.full(len(chance), 1 / len(chance))
    for _ in range(rounds):
        mixed = share @ chance
        new = share * (chance @ (weight / mixed))
        done = np.abs(new - share).max() < close
        share = new
        if done:
            break
    return share, float(weight @ np.log(share @ chance))


def learn(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", folds: int | None = 4, held: int = 2, smooth: float = 0.5, most: int = MOST_LANGUAGES) -> Languages:
    """Languages from all rows with text and language, but for ids whose crc32 modulo
    ``folds`` is ``held`` (null ids are learned from). The driver gets ``BUCKETS``
    counts per language; with more than ``most`` languages nothing is learned but a
    ValueError raised, as none may be left out."""
    if folds:
        remainder = F.crc32(F.col(f"`{id_col}`").cast("string")) % folds
        docs = docs.where(F.coalesce(remainder != held, F.lit(True)))
    labelled = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    n = labelled.select(F.col(f"`{lang_col}`").cast("string")).distinct().count()
    if n > most:
        raise ValueError(f"{n} values in {lang_col}, but at most {most} languages can be learned")
    found = gram_counts(docs, lang_col, text_col).toPandas()
    names = sorted(set(found["_lang"]))
    table, place = np.zeros((len(names), BUCKETS)), {n: i for i, n in enumerate(names)}
    table[found["_lang"].map(place).astype(int), found["bucket"]] = found["n"]
    table += smooth
    return Languages(names, table / table.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2) -> DataFrame:
    """id, ``held_out``, ``lang_pred``, ``score`` (its share) and ``languages`` of every row.

    Null texts and texts without a letter get ``und``, score 0 and no languages, as
    does every text if no language was learned. Equal texts get equal results; a null
    id is not held out; whole texts count; a table without rows gives none; further
    columns play no part.
    """

    def work():
        def run(texts: list) -> dict:
            mixtures = [languages.mixture(t) for t in texts]
            return {
                "lang_pred": pa.array([m[0][0] if m else UNKNOWN for m in mixtures], pa.string()),
                "score": pa.array([min(1.0, m[0][1]) if m else 0.0 for m in mixtures], pa.float64()),
                "languages": pa.array([",".join(f"{n}:{s:.3f}" for n, s in m) for m in mixtures], pa.string()),
            }

        return run

    found = map_texts(docs, text_col, [id_col], "lang_pred string, score double, languages string", work)
    held_out = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == held, F.lit(False))
    return found.withColumn("held_out", held_out)
