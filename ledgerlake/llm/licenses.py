"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are grouped by size: a class g (a power of two) holds templates of
g/2 < n <= g distinct five-word shingles. Words are runs of ASCII letters and digits, in lower case.
A document is cut into windows of 2g
shingles that start every g shingles from its beginning, so any run of g shingles lies whole in
one window, and what is found depends on the text alone. A window and a template that collide in one of ``BANDS`` MinHash
bands of one row are a candidate. For a template that is contained by 0.8 the
Jaccard similarity with its window is at least 0.8n / (2g + 0.2n) >= 4/21, so
it is missed with a probability under (17/21)**BANDS, 2e-5 for 51 bands.
A candidate is accepted if at least 0.8 of the template's shingles are in the
window (exactly: on sets of shingle hashes of 64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .shingles import ASCII_LETTERS, hashed_words, odd_factors, rolled, row_of, small, whole

SHINGLE = 5
BANDS = 51
CONTAINED = 0.8
MOST_TEMPLATES = 10_000

# License notices as their publishers word them, and the license each stands for.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


_ODD = odd_factors(BANDS, 0xA24BAED4963EE407)
_MOST = np.iinfo(np.uint64).max


class _Class:
    """The templates of one size class, with the values that their bands can take."""

    def __init__(self, g: int, templates: list[tuple[int, np.ndarray]]):
        self.g, self.templates = g, templates
        self.mins = np.array([[(t * odd).min() for odd in _ODD] for _, t in templates])
        self.known = np.zeros((BANDS, 1 << 16), bool)
        for band in range(BANDS):
            self.known[band, self.mins[:, band] >> np.uint64(48)] = True

    def colliding(self, least: np.ndarray, band: int) -> Iterator[tuple[int, int]]:
        """(window, template) pairs that share a band."""
        near = np.flatnonzero(self.known[band][least >> np.uint64(48)])
        if len(near):
            value, first = np.unique(self.mins[:, band], return_inverse=True)
            at = np.searchsorted(value, least[near])
            hit = (at < len(value)) & (value[np.minimum(at, len(value) - 1)] == least[near])
            for w, v in zip(near[hit].tolist(), at[hit].tolist(), strict=True):
                yield from ((w, int(t)) for t in np.flatnonzero(first == v))


def _blocks(offsets: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where blocks of g shingles begin, text by text, and whether the next block is of the same text."""
    size = np.diff(offsets)
    many = -(-size // g)
    rows = np.repeat(np.arange(len(size)), many)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    return offsets[:-1][rows] + number * g, np.append(rows[1:] == rows[:-1], False)


def _candidates(h: np.ndarray, inside: np.ndarray, offsets: np.ndarray, classes: list[_Class]) -> list[tuple[np.ndarray, set[tuple[int, int]]]]:
    """For each class the places where windows begin, and its (window, template) pairs."""
    windows = []
    for c in classes:
        begins, goes_on = _blocks(offsets, c.g)
        windows.append((begins[begins < len(h)], goes_on[begins < len(h)]))
    pairs: list[set[tuple[int, int]]] = [set() for _ in classes]
    for band, odd in enumerate(_ODD if len(h) else ()):
        values = np.where(inside, h * odd, _MOST)
        for c, (begins, goes_on), found in zip(classes, windows, pairs, strict=True):
            least = np.minimum.reduceat(values, begins)
            least[:-1] = np.where(goes_on[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
            found.update(c.colliding(least, band))
    return [(begins, found) for (begins, _), found in zip(windows, pairs, strict=True)]


def _merged(matches: list[tuple[int, int, float]]) -> list[tuple[int, float]]:
    """(start, containment) of matches (first place, last place, share) of one template; those that overlap are one."""
    out: list[list] = []
    for first, last, share in sorted(matches):
        if out and first <= out[-1][1]:
            out[-1][1:] = [max(out[-1][1], last), max(out[-1][2], share)]
        else:
            out.append([first, last, share])
    return [(first, share) for first, _, share in out]


def _classes(hashed: list[np.ndarray]) -> list[_Class]:
    by_size: dict[int, list] = {}
    for i, h in enumerate(hashed):
        t = np.unique(rolled(h, SHINGLE))
        if len(t):
            by_size.setdefault(1 << (len(t) - 1).bit_length(), []).append((i, t))
    return [_Class(g, ts) for g, ts in sorted(by_size.items())]


def _scan(batches: Iterator[pa.RecordBatch], classes: list[_Class], licenses: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """For each row: its number of words, and its matches as (license, template, start word, containment)."""
    for batch in small(batches):
        values, offsets = hashed_words(batch.column("text"), ASCII_LETTERS)
        h, rows = rolled(values, SHINGLE), row_of(offsets)
        inside = whole(offsets, SHINGLE)
        matches: dict[tuple[int, int], list] = {}
        for c, (begins, pairs) in zip(classes, _candidates(h, inside, offsets, classes), strict=True):
            for w, t in pairs:
                row, (number, shingles) = int(rows[begins[w]]), c.templates[t]
                lo, hi = int(begins[w]), min(int(begins[w]) + 2 * c.g, int(offsets[row + 1]), len(h))
                at = lo + np.flatnonzero(inside[lo:hi] & np.isin(h[lo:hi], shingles))
                share = len(np.unique(h[at])) / len(shingles)
                if share >= CONTAINED:
                    matches.setdefault((row, number), []).append((int(at[0] - offsets[row]), int(at[-1] - offsets[row]), share))
        kind = pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("containment", pa.float64())])
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for (row, number), some in sorted(matches.items()):
            found[row] += [{"license": licenses[number], "template": number, "start": s, "containment": v} for s, v in _merged(some)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.diff(offsets), pa.int64()), pa.array(found, pa.list_(kind))], names=names
        )


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words`` and ``license_matches``: array of (license, template, start, containment).

    ``templates`` are (license, text) pairs, or a table of these two columns of
    at most ``MOST_TEMPLATES`` rows (more is an error: each task holds them all),
    numbered in the order of license and text. start is the word at which the first
    shingle of the match begins; the array is ordered by template and start, and
    windows whose matches of one template overlap are one match. Templates under
    five words are never found. Null and empty texts have no match; columns of
    the two names are replaced.
    """
    docs = docs.drop("n_words", "license_matches")
    if isinstance(templates, DataFrame):
        known = templates.select("license", "text").where(F.col("text").isNotNull()).distinct().limit(MOST_TEMPLATES + 1).collect()
        if len(known) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = sorted(((r["license"] or "", r["text"]) for r in known))
    values, offsets = hashed_words(pa.array([t for _, t in templates], pa.string()), ASCII_LETTERS)
    classes = _classes([values[i:j] for i, j in zip(offsets, offsets[1:], strict=False)])
    licenses = [name for name, _ in templates]
    n, found = fresh(docs, "_n", "_found")
    names = [*docs.columns, n, found]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(
        lambda batches: _scan(batches, classes, licenses, names),
        f"{kept}, `{n}` bigint, `{found}` array<struct<license:string,template:int,start:bigint,containment:double>>",
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(n).alias("n_words"), F.col(found).alias("license_matches"))
