"""License scans: MinHash bands over overlapping windows find templates, shingles verify them.

Texts and templates are cut into words (digits, a-z, everything beyond U+007F; A-Z lowered) and
windows of 16 words, every eighth word in a text, every word in a template. A window's
signature has 48 minima of its five-word shingles under 48 hash functions; each is a band of its
own, so windows of Jaccard similarity s meet in at least one band with probability
1 - (1 - s)**48: 0.99997 at s = 0.2. A template of w words that stands in a text has a text
window that shares at least min(w, 9) words with it. What meets is only a candidate: the shingles of
the text's windows are then matched exactly, and a template is reported if at least 75 % of its
shingles occur in the candidate windows or the windows next to them.

Templates of fewer than 9 words have fewer than 5 shingles, too few among the 12 of a window to
rely on a meeting: they have no bands, and all shingles of a text are matched with theirs exactly.

Bloom filters of fixed size over the templates' bands and the short templates' shingles keep what
cannot match from the shuffle; templates may be few or many.

Defined results: a null or empty text holds no license; a template without words matches
nothing, one of fewer than five words is one shingle; equal templates all match; rows that
repeat a doc_id are scanned one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm import bloom, text
from gridpanel.llm.scratch import materialise

SHINGLE, WINDOW, STRIDE, BANDS = 5, 16, 8, 48
SHARE = 0.75
#: Shingles from which a template is looked for by bands.
BANDED = 5

#: Well-known public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "license string, text string")


def _minima(keys: np.ndarray, spans: int, stride: int) -> np.ndarray:
    """(bands, windows) band keys: minima over `spans` shingles, every `stride` shingles."""
    n = max(len(keys) - spans + 1, 1)
    at = np.arange(0, n, stride)
    if len(keys) > spans and at[-1] != n - 1:
        at = np.append(at, n - 1)
    stop = np.minimum(at + spans, len(keys))
    out = np.empty((BANDS, len(at)), np.uint64)
    for band in range(BANDS):
        seed = text.factor(band)
        hashed = (keys ^ (seed >> np.uint64(7))) * seed
        hashed ^= hashed >> np.uint64(32)
        # Minima over [at, stop) by doubling: two overlapping powers of two cover a window.
        width, low = 1, hashed
        while width * 2 <= spans and width * 2 <= len(keys):
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        first = np.minimum(low[np.minimum(at, len(low) - 1)], low[np.maximum(stop - width, 0)])
        out[band] = first
    return text.mix(out * np.uint64(2 * BANDS + 1) + np.arange(BANDS, dtype=np.uint64)[:, None])


def _keys(hashes: np.ndarray) -> np.ndarray:
    return text.shingles(hashes, min(SHINGLE, len(hashes))) if len(hashes) else np.zeros(0, np.uint64)


_PER_WINDOW = WINDOW - SHINGLE + 1


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text.column_bytes(batch.column(1))
        words = text.words(data, offsets, text.ALNUM)
        bands, shingles = [], []
        for i in range(batch.num_rows):
            keys = _keys(words.hash[words.of(i)])
            shingles.append(np.unique(keys).view(np.int64))
            banded = len(shingles[-1]) >= BANDED
            bands.append(np.unique(_minima(keys, _PER_WINDOW, 1)).view(np.int64) if banded else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                text.nested(np.concatenate(bands), [len(b) for b in bands], pa.int64()),
                text.nested(np.concatenate(shingles), [len(s) for s in shingles], pa.int64()),
            ],
            names=["license", "bands", "shingles"],
        )


def _scan(filter_: bloom.Bloom, short: bloom.Bloom, lengths: list[int]):
    """What may match: windows (row, bands that the filter holds, shingles around), and (row, no bands, shingles
    that short templates may have)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            everything, offsets = text.column_bytes(batch.column(1))
            for lo, hi in text.groups_of_texts(offsets):
                data = everything[offsets[lo] : offsets[hi]]
                words = text.words(data, offsets[lo : hi + 1] - offsets[lo], text.ALNUM)
                rows, bands, shingles = [], [], []
                none = np.zeros(0, np.int64)
                for i in range(hi - lo):
                    hashes = words.hash[words.of(i)]
                    for size in lengths:
                        keys = text.shingles(hashes, size)
                        keys = np.unique(keys[short.holds(keys)])
                        if len(keys):
                            rows.append(lo + i)
                            bands.append(none)
                            shingles.append(keys.view(np.int64))
                    keys = text.shingles(hashes, SHINGLE)
                    if not len(keys):
                        continue
                    own = _minima(keys, _PER_WINDOW, STRIDE)
                    held = filter_.holds(own.ravel()).reshape(own.shape)
                    for w in np.flatnonzero(held.any(axis=0)):
                        first = max(0, (w - 1) * STRIDE)
                        rows.append(lo + i)
                        bands.append(own[held[:, w], w].view(np.int64))
                        shingles.append(np.unique(keys[first : (w + 1) * STRIDE + _PER_WINDOW]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        text.nested(np.concatenate([none, *bands]), [len(b) for b in bands], pa.int64()),
                        text.nested(np.concatenate([none, *shingles]), [len(s) for s in shingles], pa.int64()),
                    ],
                    names=["row", "bands", "shingles"],
                )

    return run


def matches(rows: DataFrame, templates: DataFrame, log2_bits: int = 20) -> DataFrame:
    """(row, license, share) of templates found in rows (row, text); templates are (license, text)."""
    cut = materialise(
        templates.select("license", "text").mapInArrow(
            _templates, "license string, bands array<bigint>, shingles array<bigint>"
        ),
        "templates",
    )
    by_band = cut.select("license", F.explode("bands").alias("band"))
    by_shingle = cut.select("license", F.size("bands").alias("n_bands"), F.explode("shingles").alias("shingle"))
    totals = cut.select("license", F.size("shingles").alias("n_shingles"))
    filter_ = bloom.build(by_band.select("band").distinct(), "band", log2_bits)
    unbanded = by_shingle.where("n_bands = 0").select("license", "shingle")
    short_filter = bloom.build(unbanded.select("shingle").distinct(), "shingle", log2_bits)
    short = [
        r[0]
        for r in templates.select(
            F.least(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))), F.lit(SHINGLE)).alias("n")
        )
        .where("n > 0")
        .distinct()
        .collect()
    ]
    kind = rows.schema["row"].dataType.simpleString()
    windows = materialise(
        rows.select("row", "text").mapInArrow(
            _scan(filter_, short_filter, sorted(short)), f"row {kind}, bands array<bigint>, shingles array<bigint>"
        ),
        "windows",
    ).withColumn("window", F.monotonically_increasing_id())
    candidates = (
        windows.where("size(bands) > 0")
        .select("row", "window", "shingles", F.explode("bands").alias("band"))
        .join(by_band, "band")
        .groupBy("row", "window", "license")
        .agg(F.any_value("shingles").alias("shingles"))
    )
    near = candidates.select("row", "license", F.explode("shingles").alias("shingle"))
    exact = windows.where("size(bands) = 0").select("row", F.explode("shingles").alias("shingle"))
    return (
        near.join(by_shingle.select("license", "shingle"), ["license", "shingle"])
        .unionByName(exact.join(unbanded, "shingle"))
        .groupBy("row", "license")
        .agg(F.count_distinct("shingle").alias("held"))
        .join(totals, "license")
        .select("row", "license", (F.col("held") / F.col("n_shingles")).alias("share"))
        .where(F.col("share") >= SHARE)
    )


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, n_licenses, licenses, best_share) of every document; licenses are sorted and joined by commas."""
    content = F.xxhash64("text").alias("content")
    keyed = docs.select(F.struct("doc_id", content).alias("row"), "text")
    found = (
        matches(keyed, templates)
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("license")).alias("names"), F.max("share").alias("best_share"))
    )
    found = materialise(found.select("row.doc_id", "row.content", "names", "best_share"), "found")
    rows = docs.select("doc_id", content)
    names = F.coalesce("names", F.array().cast("array<string>"))
    return rows.join(
        found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["content"] == found["content"]), "left"
    ).select(
        rows["doc_id"],
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        "best_share",
    )
