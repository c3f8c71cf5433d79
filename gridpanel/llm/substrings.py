"""Substring deduplication by sliding spans of sentences.

A sentence ends behind a word that ends in `.`, `!`, `?` or such a mark of another script, at a line
break, and, where no sentence ends within LONG / 2 words, behind words chosen by their hash: the
least in any run of NEAR words, so that long runs without punctuation break at least every NEAR
words, and at the same words wherever they stand. No choice depends on words further away than
LONG / 2, so a passage of some 60 words or more has whole spans whatever stands around it. In scripts
without blanks (`text.unspaced`) each character is a word, of half the weight. From every
sentence on, the shortest run of three sentences and ten words at least, or of fifty words at
least, is a span; its lower-cased words are hashed, blanks ignored. A span that
occurs again, in whatever document, is repeated; its first occurrence, by (doc_id, place),
stays, and the sentences of all others go.

The first pass counts the hashes of all spans; only those seen twice go on. A Bloom filter of
fixed size over them lets the second pass send on what may be repeated, which is then counted
and joined exactly, on a hash of 128 bits. The third pass cuts the sentences out where the text
is. A very common passage is one key: it is counted with map-side combination, and joined by an
equi-join that adaptive execution may split.

Defined results: a null text stays null and has no sentences; documents too short
for a span stay as they are; rows equal in doc_id and text are one occurrence
and are all treated alike; null ids sort first; other columns are not read by `repeated_spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import bloom, text
from gridpanel.llm.scratch import free_name, materialise

RUN = 3
LEAST_WORDS = 10
ENOUGH_WORDS = 50
LONG = 24
NEAR = 8

_ENDS = np.isin(np.arange(256), list(b".!?"))
_BREAK = np.isin(np.arange(256), list(b"\n\r"))
#: Marks beyond ASCII, by their length in bytes: Greek, Armenian, Arabic, Indic, Burmese, Ethiopic, Khmer, CJK.
_MARKS: dict[int, list[int]] = {}
for _mark in "\u037e\u0589\u061f\u06d4\u0964\u0965\u104a\u104b\u1362\u1367\u17d4\u17d5\u203c\u203d\u2047\u2048\u2049\u3002\uff01\uff0e\uff1f\uff61":
    _MARKS.setdefault(len(_mark.encode()), []).append(int.from_bytes(_mark.encode()))


def _ending(data: np.ndarray, words: text.Words) -> np.ndarray:
    """Whether a sentence ends behind each word by its last character."""
    ends = _ENDS[data[words.end - 1]]
    other = np.flatnonzero(data[words.end - 1] >= 0x80)
    for length, marks in _MARKS.items():
        held = other[words.end[other] - words.start[other] >= length]
        code = np.zeros(len(held), np.int64)
        for k in range(length, 0, -1):
            code = code << 8 | data[words.end[held] - k]
        ends[held] |= np.isin(code, marks)
    return ends


def _chosen(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Words that are the least, the last of equals, of some run of NEAR words, with no begin of a sentence around."""
    n, half = len(hashes), LONG // 2
    out = np.zeros(n, dtype=bool)
    if n <= LONG:
        return out
    # Words half ... n - half - 1 whose surroundings, half words to each side, are one sentence.
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(begins, out=sums[1:])
    places = np.arange(half, n - half)
    free = places[sums[places + half + 1] == sums[places - half + 1]]
    if not len(free):
        return out
    # A word is the least of some run of NEAR if so many words in a row around it, with itself, are not less.
    before, after = np.zeros(len(free), np.int64), np.zeros(len(free), np.int64)
    open_before, open_after = np.ones(len(free), dtype=bool), np.ones(len(free), dtype=bool)
    own = hashes[free]
    for k in range(1, NEAR):
        open_before &= hashes[free - k] >= own
        open_after &= hashes[free + k] > own
        before += open_before
        after += open_after
    out[free[before + after + 1 >= NEAR]] = True
    return out


def sentence_starts(data: np.ndarray, words: text.Words) -> np.ndarray:
    """Number of the first word of each sentence, in ascending order, for all texts of `words`."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_BREAK[data], out=breaks[1:])
    gap = breaks[np.append(words.start[1:], len(data))] > breaks[words.end]
    begins = np.zeros(n, dtype=bool)
    begins[1:] = (_ending(data, words) | gap)[:-1]
    begins[words.first[:-1][words.first[:-1] < n]] = True
    begins[1:] |= _chosen(words.hash, begins)[:-1]
    return np.flatnonzero(begins)


def _half(data: np.ndarray, words: text.Words) -> np.ndarray:
    """Whether each word is a character of a script without blanks, which counts as half a word."""
    alone = text.unspaced(data)
    return np.zeros(len(words.start), dtype=bool) if alone is None else alone[words.start] > 0


def spans(data: np.ndarray, words: text.Words):
    """(text number, sentence number in it, sentences, hash, second hash) of every span."""
    starts = sentence_starts(data, words)
    n = len(words.start)
    stops = np.append(starts, n)
    owner = np.searchsorted(words.first, starts, side="right") - 1
    # The first sentence of each text, to number sentences within it.
    first_of = np.searchsorted(starts, words.first)
    lo = np.arange(len(starts))
    weight = np.zeros(n + 1, np.int64)
    np.cumsum(np.where(_half(data, words), 1, 2), out=weight[1:])
    reached = weight[stops]
    hi = np.maximum(lo + RUN, np.searchsorted(reached, weight[starts] + 2 * LEAST_WORDS))
    hi = np.minimum(hi, np.searchsorted(reached, weight[starts] + 2 * ENOUGH_WORDS))
    whole = hi <= first_of[owner + 1]
    lo, hi = lo[whole], hi[whole]
    a, b = stops[lo], stops[hi]
    found = []
    for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * text.powers(max(n, 1 << 16), base)[:n], out=sums[1:])
        back = text.powers(max(n, 1 << 16) + 1, pow(base, -1, 1 << 64))
        found.append(text.mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)))
    return owner[lo], lo - first_of[owner[lo]], hi - lo, *found


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, text.Words]]:
    everything, offsets = text.column_bytes(column)
    for lo, hi in text.groups_of_texts(offsets):
        data = everything[offsets[lo] : offsets[hi]]
        yield lo, hi, data, text.words(data, offsets[lo : hi + 1] - offsets[lo], text.SPACED, text.unspaced(data))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, words in _texts(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(spans(data, words)[3].view(np.int64))], names=["h"])


def _survivors(filter_: bloom.Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, words in _texts(batch.column(2)):
                owner, at, n, h, h2 = spans(data, words)
                keep = filter_.holds(h)
                rows = pa.array(owner[keep] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(at[keep].astype(np.int32)),
                        pa.array(n[keep].astype(np.int32)),
                        pa.array(h[keep].view(np.int64)),
                        pa.array(h2[keep].view(np.int64)),
                    ],
                    names=["doc_id", "content", "at", "n", "h", "h2"],
                )

    return run


def repeated_spans(docs: DataFrame, log2_bits: int = 24) -> DataFrame:
    """(doc_id, content, at, n, first_doc): spans of n sentences that are not the first of their kind."""
    counts = docs.select("text").mapInArrow(_hashes, "h bigint").groupBy("h").agg(F.count("*").alias("n"))
    twice = materialise(counts.where("n > 1").select("h"), "spans")
    filter_ = bloom.build(twice, "h", log2_bits)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = materialise(
        docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(
            _survivors(filter_), f"doc_id {kind}, content bigint, at int, n int, h bigint, h2 bigint"
        ),
        "held",
    )
    place = F.struct("doc_id", "content", "at")
    first = materialise(
        held.groupBy("h", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last"),
        "first",
    )
    return held.join(first, ["h", "h2"]).where(place != F.col("first")).select(
        "doc_id", "content", "at", "n", F.col("first.doc_id").alias("first_doc")
    )


def _cut(column: pa.Array, removed: pa.Array) -> pa.Array:
    """Each text without the sentences that its spans cover; an array of span starts for each text."""
    out, totals, gone = [], [], []
    starts_of = removed.to_pylist()
    offsets = text.column_bytes(column)[1]
    for lo, hi, data, words in _texts(column):
        starts = sentence_starts(data, words)
        first_of = np.searchsorted(starts, words.first)
        begin = words.start[starts]
        for i in range(lo, hi):
            mine = begin[first_of[i - lo] : first_of[i - lo + 1]]
            spans_ = starts_of[i]
            value = column[i].as_py()
            totals.append(len(mine))
            if value is None or not spans_:
                out.append(value)
                gone.append(0)
                continue
            covered = np.zeros(len(mine), dtype=bool)
            for span in spans_:
                covered[span["at"] : span["at"] + span["n"]] = True
            raw = value.encode()
            base = int(offsets[i] - offsets[lo])
            bounds = [*(mine - base).tolist(), len(raw)]
            kept = [raw[bounds[k] : bounds[k + 1]] for k in range(len(mine)) if not covered[k]]
            out.append((raw[: bounds[0]] + b"".join(kept)).decode())
            gone.append(int(covered.sum()))
    return pa.StructArray.from_arrays(
        [pa.array(out, pa.string()), pa.array(totals, pa.int32()), pa.array(gone, pa.int32())],
        names=["text", "n_sentences", "n_removed"],
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, repeated sentences cut out, and what was done.

    Added: n_sentences, n_removed, and first_docs, the sorted ids of the documents that hold the
    first occurrences of what was cut out; underscores go in front of a name that the table has already.
    """
    cut_out = F.arrow_udf(_cut, "struct<text: string, n_sentences: int, n_removed: int>")
    removed = repeated_spans(docs).groupBy("doc_id", "content").agg(
        F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.array_sort(F.collect_set("first_doc")).alias("docs")
    )
    names = {c: free_name(docs, f"_{c}") for c in ("doc_id", "content", "spans", "docs", "cut")}
    lists = removed.select(*[F.col(c).alias(names[c]) for c in ("doc_id", "content", "spans", "docs")])
    kind = removed.schema["docs"].dataType
    joined = docs.join(
        lists,
        docs["doc_id"].eqNullSafe(F.col(names["doc_id"])) & (F.xxhash64(docs["text"]) == F.col(names["content"])),
        "left",
    ).withColumn(names["cut"], cut_out(docs["text"], F.coalesce(names["spans"], F.array().cast("array<struct<at: int, n: int>>"))))
    cut = names["cut"]
    return joined.select(
        *[F.col(f"{cut}.text").alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns],
        F.col(f"{cut}.n_sentences").alias(free_name(docs, "n_sentences")),
        F.col(f"{cut}.n_removed").alias(free_name(docs, "n_removed")),
        F.coalesce(names["docs"], F.array().cast(kind)).alias(free_name(docs, "first_docs")),
    )
