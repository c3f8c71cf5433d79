"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased; letters are kept and each run of anything else is one space. For every
language an n-gram model over these characters is estimated: raw counts at the highest order,
continuation counts below, one absolute discount per order and language. All languages share
one sorted array of 64-bit gram hashes per order; beside it lie a log-probability and a back-off
weight per language, so one binary search answers for all languages. The prediction is the
language with the lowest cross-entropy per character.

Rejection is calibrated on labelled documents that the model did not see: a document is
rejected if its cross-entropy exceeds the mean of its language by `z` standard deviations,
whose square is a / n + b for n characters (a: variance of a character, b: variance between
documents, of which the standard deviation counts as 5 % of the mean at least). A language with
fewer than ten such documents is calibrated on its whole sample, in FOLDS parts, each scored by a model of the
others; one that even so has fewer than two takes the moments of all languages' documents together, and
without any such document, what is less likely than even odds over ALPHABET characters is rejected.

The model is fitted on a sample that is bounded in expectation: `sample_docs` labelled
documents per language, drawn by a hash of doc_id, with their whole texts. Grams are counted by
Spark; the driver holds the distinct grams of the sample. Predictions are made for all rows.

Defined results: a null text or one without letters is `und` with score 0 and rejected; rows
without a language or doc_id are not learned from; equal texts get equal predictions;
without any labelled row everything is `und`; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import text as texts

ORDER = 4
SAMPLE_DOCS = 512
FIT_SHARE = 0.8
#: A language with fewer calibration documents is calibrated in so many parts of its whole sample.
CALIBRATED, FOLDS = 10, 5
#: Characters never seen share the weight of one in so many.
ALPHABET = 1 << 10
PIECE = 1 << 19
#: Characters of several texts that are scored together; a longer text is scored by itself, in parts of PIECE.
GROUP = 1 << 16
#: Texts that are held as strings at once.
LOT = 256
SPACE = 32
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def characters(value: str | None) -> np.ndarray:
    """Code points of the letters with single spaces between and around; empty without letters."""
    if not value:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(value.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    first, last = np.argmax(letter), len(letter) - np.argmax(letter[::-1])
    codes, letter = codes[first:last], letter[first:last]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.full(int(keep.sum()) + 2, SPACE, dtype=np.uint32)
    out[1:-1] = np.where(letter[keep], codes[keep], SPACE)
    return out


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 ... order the hash of the k characters that end at each place; code 0 is padding."""
    wide = codes.astype(np.uint64)
    total, out = np.zeros(len(codes), np.uint64), []
    for k in range(order):
        total[k:] += wide[: len(wide) - k] * texts.factor(k)
        out.append(texts.mix(total + np.uint64(k + 1)))
    return out


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = characters(value)
                hashes = gram_hashes(codes, order)
                for k in range(1, order + 1):
                    grams, at, counts = np.unique(hashes[k - 1][k - 1 :], return_index=True, return_counts=True)
                    at = at + k - 1
                    shorter = hashes[k - 2] if k > 1 else np.zeros(len(codes) + 1, np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(grams), pa.string()),
                            pa.array(np.full(len(grams), k, np.int32)),
                            pa.array(grams.view(np.int64)),
                            pa.array(shorter[at].view(np.int64)),
                            pa.array(shorter[at - 1 if k > 1 else at].view(np.int64)),
                            pa.array(counts.astype(np.int64)),
                        ],
                        names=["lang", "k", "gram", "suffix", "history", "n"],
                    )

    return run


@dataclass
class Model:
    """Per order k: `grams[k]` sorted hashes, `logp[k]` and `backoff[k]` of shape (grams, languages)."""

    langs: list[str]
    order: int
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    #: Mean, between-document and per-character variance of the cross-entropy of each language.
    limits: dict[str, tuple[float, float, float]]
    z: float = 6.0
    #: Logarithm of what each language leaves for characters it never saw.
    floor: np.ndarray | None = None

    def _find(self, k: int, hashes: np.ndarray) -> np.ndarray:
        grams = self.grams[k]
        at = np.searchsorted(grams, hashes)
        at[at == len(grams)] = 0
        return np.where(grams[at] == hashes, at, -1)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(places, languages) of natural logarithms; the first character of a text has no history."""
        hashes = gram_hashes(codes, self.order)
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        todo = np.arange(len(codes))
        for k in range(self.order - 1, -1, -1):
            at = self._find(k, hashes[k][todo])
            hit = at >= 0
            out[todo[hit]] += self.logp[k][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if k:
                # Every language that knows the history pays its back-off weight for going shorter.
                behind = todo[todo > 0]
                known = self._find(k - 1, hashes[k - 1][behind - 1])
                out[behind[known >= 0]] += self.backoff[k - 1][known[known >= 0]]
        out[todo] += np.float32(-np.log(ALPHABET)) + self.floor
        return out

    def score(self, values: list[str | None]) -> list[tuple[str, float, bool, float, float, int]]:
        """(language, score, rejected, cross-entropy, variance of a character, characters) of each text."""
        out: list = []
        group, total = [], 0
        for value in values:
            group.append(characters(value))
            total += len(group[-1]) + self.order
            if total > GROUP:
                out += self._score_group(group)
                group, total = [], 0
        return out + self._score_group(group)

    def _score_group(self, group: list[np.ndarray]) -> list[tuple]:
        n_langs = len(self.langs)
        sums, squares = np.zeros((len(group), n_langs)), np.zeros((len(group), n_langs))
        pad = np.zeros(self.order - 1, np.uint32)
        pieces, owners = [], []
        for i, codes in enumerate(group):
            for at in range(0, len(codes), PIECE):
                pieces.append(codes[at : at + PIECE])
                owners.append(i)
        if n_langs:
            for lo, hi in _lots([len(p) for p in pieces]):
                joined = np.concatenate([x for p in pieces[lo:hi] for x in (pad, p)])
                logp = self.log_probabilities(joined)
                at = len(pad)
                for p, owner in zip(pieces[lo:hi], owners[lo:hi]):
                    own = logp[at + 1 : at + len(p)].astype(np.float64)  # the leading space is given
                    sums[owner] += own.sum(axis=0)
                    squares[owner] += np.einsum("ij,ij->j", own, own)
                    at += len(p) + len(pad)
        return [self._decide(s, q, max(len(c) - 1, 0)) for s, q, c in zip(sums, squares, group)]

    def _decide(self, sums: np.ndarray, squares: np.ndarray, n: int) -> tuple:
        if not n or not self.langs:
            return NONE, 0.0, True, None, None, 0
        entropy = -sums / n
        best = int(np.argmin(entropy))
        score = 1 / np.exp((entropy[best] - entropy) * np.sqrt(n)).sum()
        spread = max(squares[best] / n - entropy[best] ** 2, 0.0)
        rejected = False
        if self.langs[best] in self.limits:
            mean, between, within = self.limits[self.langs[best]]
            rejected = bool(entropy[best] > mean + self.z * np.sqrt(within / n + between))
        return self.langs[best], float(score), rejected, float(entropy[best]), float(spread), n


def _lots(lengths: list[int]) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > GROUP:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def estimate(counts: pd.DataFrame, order: int) -> Model:
    """Interpolated Kneser-Ney from (lang, k, gram, suffix, history, n), every gram once per language."""
    langs = sorted(counts["lang"].unique())
    number = counts["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy()
    k_of = counts["k"].to_numpy()
    unsigned = {c: counts[c].to_numpy(np.int64).view(np.uint64) for c in ("gram", "suffix", "history")}
    raw = counts["n"].to_numpy(np.float64)
    grams, logp, backoff = [], [], []
    lower_p, floor = None, None
    for k in range(1, order + 1):
        rows = k_of == k
        table, first = np.unique(unsigned["gram"][rows], return_index=True)
        found = np.searchsorted(table, unsigned["gram"][rows])
        used = np.zeros((len(table), len(langs)))
        if k == order:
            used[found, number[rows]] = raw[rows]
        else:
            # How many different characters stood before the gram: grams of the next order that end in it.
            above = k_of == k + 1
            ends = np.searchsorted(table, unsigned["suffix"][above])
            np.add.at(used, (ends, number[above]), 1.0)
            # A gram seen only at a text's beginning has no character before it.
            seen = np.zeros_like(used, dtype=bool)
            seen[found, number[rows]] = True
            used[seen & (used == 0)] = 1.0
        ones, twos = (used == 1).sum(axis=0), (used == 2).sum(axis=0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
        discount = np.clip(discount, 0.1, 0.95)
        kept = np.maximum(used - discount, 0.0)
        if k == 1:
            total, types = used.sum(axis=0), (used > 0).sum(axis=0)
            floor = discount * types / np.maximum(total, 1)
            p = kept / np.maximum(total, 1) + floor / ALPHABET
        else:
            history = np.searchsorted(grams[-1], unsigned["history"][rows][first])
            suffix = np.searchsorted(grams[-1], unsigned["suffix"][rows][first])
            total, types = np.zeros_like(lower_p), np.zeros_like(lower_p)
            np.add.at(total, history, used)
            np.add.at(types, history, (used > 0).astype(float))
            weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
            backoff.append(np.log(weight).astype(np.float32))
            p = kept / np.maximum(total[history], 1) + weight[history] * lower_p[suffix]
        grams.append(table)
        logp.append(np.log(p).astype(np.float32))
        lower_p = p
    return Model(langs, order, grams, logp, backoff, {}, floor=np.log(np.maximum(floor, 1e-9)).astype(np.float32))


def _sample(labelled: DataFrame, sample_docs: int) -> DataFrame:
    """About `sample_docs` rows per language, and for each a hash in [0, 1) that splits off the calibration part."""
    sizes = labelled.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return labelled.select("lang", "text", F.lit(0.0).alias("part"))
    rates = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], float(sample_docs) / r["count"])])
    unit = lambda seed: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    # Rows are drawn where they are read, so no text is shuffled.
    return (
        labelled.where("doc_id is not null")
        .where(unit(3) < F.element_at(rates, F.col("lang")))
        .select("lang", "text", unit(4).alias("part"))
    )


def fit(labelled: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, z: float = 6.0) -> Model:
    """A calibrated model from rows (doc_id, lang, text)."""
    sample = _sample(labelled.where("lang is not null"), sample_docs)
    counts = _counts(sample.where(F.col("part") < FIT_SHARE), order)
    if not len(counts):
        return Model([], order, [], [], [], {}, z)
    model = estimate(counts, order)
    checked = (
        _hits(sample.where(F.col("part") >= FIT_SHARE), predictor(model))
        .groupBy("lang")
        .agg(F.avg("p.entropy"), F.coalesce(F.var_pop("p.entropy"), F.lit(0.0)), F.avg("p.spread"), F.count("*"))
        .collect()
    )
    moments = {r[0]: tuple(r)[1:] for r in checked if r[4] >= CALIBRATED}
    few = [lang for lang in model.langs if lang not in moments]
    if few:
        moments |= _crossed(sample.where(F.col("lang").isin(few)), model)
    pooled = _pooled(list(moments.values()))
    limits = {lang: moments[lang] if lang in moments and moments[lang][3] > 1 else pooled for lang in model.langs}
    # A few documents say little about the spread between documents: at least 5 % of the mean.
    model.limits = {lang: (m, max(v, (0.05 * m) ** 2), w) if n else (m, v, w) for lang, (m, v, w, n) in limits.items()}
    model.z = z
    return model


def _hits(sample: DataFrame, *predictors) -> DataFrame:
    """(lang, p) of texts whose language all predictors find; p is what the last one says."""
    # Spark would move the filter below the columns and run functions that it takes for deterministic in both places,
    # in Python workers of their own.
    found = [f.asNondeterministic()("text").alias(f"p{k}") for k, f in enumerate(predictors)]
    rightly = " and ".join(f"p{k}.lang = lang" for k in range(len(found)))
    return sample.select("lang", *found).where(rightly).select("lang", F.col(f"p{len(found) - 1}").alias("p"))


def _counts(sample: DataFrame, order: int) -> pd.DataFrame:
    return (
        sample.select("lang", "text")
        .mapInArrow(_count(order), "lang string, k int, gram bigint, suffix bigint, history bigint, n bigint")
        .groupBy("lang", "k", "gram")
        .agg(F.min("suffix").alias("suffix"), F.min("history").alias("history"), F.sum("n").alias("n"))
        .toPandas()
    )


def _crossed(sample: DataFrame, model: Model) -> dict[str, tuple[float, float, float, int]]:
    """Moments of languages with small samples: each part scored by a model of the other parts, if all agree on it."""
    whole, found = predictor(model), []
    part = F.floor(F.col("part") * FOLDS)
    for fold in range(FOLDS):
        counts = _counts(sample.where(part != fold), model.order)
        if not len(counts):
            continue
        hits = _hits(sample.where(part == fold), whole, predictor(estimate(counts, model.order)))
        found.append(hits.select("lang", "p.entropy", "p.spread").toPandas())
    if not found:
        return {}
    by = pd.concat(found).groupby("lang")
    return {
        lang: (own.entropy.mean(), own.entropy.var(ddof=0), own.spread.mean(), len(own)) for lang, own in by
    }


def _pooled(moments: list[tuple[float, float, float, int]]) -> tuple[float, float, float, int]:
    """Moments of all documents together."""
    n = sum(m[3] for m in moments)
    if not n:
        return float(np.log(ALPHABET)), 0.0, 0.0, 0
    mean = sum(m[0] * m[3] for m in moments) / n
    between = sum((m[1] + (m[0] - mean) ** 2) * m[3] for m in moments) / n
    return mean, between, sum(m[2] * m[3] for m in moments) / n, n


_RESULT = "lang string, score double, rejected boolean, entropy double, spread double, n bigint"


def predictor(model: Model):
    """A function from a text column to a struct (lang, score, rejected, entropy, spread, n)."""
    from pyspark.sql import SparkSession

    shipped = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def predict(column: pa.Array) -> pa.Array:
        rows = [row for at in range(0, len(column), LOT) for row in shipped.value.score(column.slice(at, LOT).to_pylist())]
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.int64()]
        names = ["lang", "score", "rejected", "entropy", "spread", "n"]
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return predict


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document; learns from rows that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    return docs.select("doc_id", predictor(model)("text").alias("p")).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("p.lang").alias("lang_pred"),
        F.col("p.score").alias("score"),
        F.col("p.rejected").alias("rejected"),
    )


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    return docs.where(~predictor(model)("text")["rejected"])
