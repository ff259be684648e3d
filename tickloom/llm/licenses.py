"""Operator 6: license scans with MinHash bands over overlapping windows, verified by exact shingle containment.

A text's word shingles are cut into blocks of as many shingles as a template has; a window is two neighbouring blocks, so every
occurrence lies whole within a window. Each band is one minhash. A window that holds 80 % of a template has a Jaccard similarity
of 0.36 or more with it, so 32 bands retrieve it with a probability over 1 - 10**-6. Retrieved windows are then checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import mix, slices
from tickloom.llm.shingles import _sequence, shingle_sets, word_hashes

# Notices of public licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

SCHEMA = "doc_id long, license string, template long, found long, shingles long, first_word long, windows long"


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, words: int = 5, share: tuple[int, int] = (8, 10), bands: int = 32) -> DataFrame:
    """(doc_id, license, template, found, shingles, first_word, windows): templates of which a window of a text holds the ``share``.

    One row per row of ``docs`` and template: its number, the most of its distinct shingles in one window, how many it has, the first
    word of the first such window, and the number of such windows. Null, empty and shorter texts give no rows; null ids and repeated
    rows give rows of their own; other columns are left out.
    """
    sets = [s for s in shingle_sets(pa.array([t for _, t in templates]), words)]
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lows = np.array([[mix(s ^ x).min() for x in salts] for s in sets], np.uint64)
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        by_size.setdefault(len(s), []).append(i)

    def scan(column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, template, shingles found, first word, windows)."""
        hashes, bounds = word_hashes(column)
        begin, n = bounds[:-1], np.maximum(0, np.diff(bounds) - words + 1)
        if not n.sum():
            return
        rows = np.repeat(np.arange(len(n)), n)
        start = np.cumsum(n) - n
        place = np.arange(len(rows)) - start[rows]
        runs = _sequence(hashes, begin[rows] + place, words)
        grids = {}
        for size in by_size:
            blocks = -(-n // size)
            row = np.repeat(np.arange(len(n)), blocks)
            at = start[row] + size * (np.arange(len(row)) - (np.cumsum(blocks) - blocks)[row])
            grids[size] = (row, at, np.append(row[1:] == row[:-1], False), {i: np.zeros(len(row), bool) for i in by_size[size]})
        for j, salt in enumerate(salts):
            h = mix(runs ^ salt)
            for size, (row, at, more, hit) in grids.items():
                low = np.minimum.reduceat(h, at)
                both = np.where(more, np.minimum(low, np.append(low[1:], low[-1])), low)
                for i in by_size[size]:
                    hit[i] |= both == lows[i, j]
        for size, (row, at, more, hit) in grids.items():
            for i in by_size[size]:
                best: dict[int, list[int]] = {}
                for w in np.flatnonzero(hit[i]).tolist():
                    r = int(row[w])
                    span = runs[at[w]:min(at[w] + 2 * size, start[r] + n[r])]
                    found = int(np.isin(sets[i], span).sum())
                    if share[1] * found >= share[0] * size:
                        x = best.setdefault(r, [0, int(at[w] - start[r]), 0])
                        x[0], x[2] = max(x[0], found), x[2] + 1
                yield from ((r, i, *x) for r, x in best.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(batch.column(0)[a + r].as_py(), templates[i][0], i, found, len(sets[i]), word, windows)
                   for a, b in slices(batch.column(1)) for r, i, found, word, windows in scan(batch.column(1).slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 5]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
