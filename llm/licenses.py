"""License scans: sparse TF-IDF cosine of lines, blocks and whole texts to licence templates, then inheritance by path.

Lines, blocks, whole texts and templates (notices, titles, SPDX tags and full licence texts) are sparse
TF-IDF vectors over words; inverse document frequencies of the templates' words are counted over all
lines of the corpus, and words that no template has count with the largest one. A block is a run of
lines joined: a paragraph, or a run of comment lines or of other lines; marks of comments are no words.
The licence of a line, block or text is its best template at a cosine of at least ``MIN_COSINE``; a
document's is the best of them all (ties: the template named first). A *licence file* of a directory is a document with a licence in it of which at least
``FILE_SHARE`` of all words stand in lines, blocks or a text with a licence. A document without a licence of its own takes
that of the nearest ancestor directory with a licence file (smallest id, if several), found by joining the
document's ancestor paths, as many as the path is deep, to the directories' licences.

Null or empty texts have no licence of their own, but inherit. A null path or id inherits nothing.
Repeated rows are each returned. The templates are the only thing broadcast, and are fixed. Texts of any length are read whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .decontaminate import _words
from .line_dedup import line_starts
from .tables import read, stash

MIN_COSINE, FILE_SHARE = 0.70, 0.25
# Usual notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work (CC0 1.0)."),
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_TEXTS = {n: pkgutil.get_data(__package__, f"license_texts/{n}.txt").decode() for n in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "BSD-3-Clause", "MPL-2.0", "CC0-1.0")}
# The usual headers in full, titles, tags and whole licences.
TEMPLATES += tuple((name, _GNU.format(*x) + rest.format(*x)) for name, x in (("GPL-3.0", ("", 3)), ("GPL-2.0", ("", 2)), ("LGPL-3.0", ("Lesser ", 3))) for rest in ("", _GNU_REST))
TEMPLATES += (
    ("Apache-2.0", _TEXTS["Apache-2.0"][_TEXTS["Apache-2.0"].rindex("Licensed under the Apache") :]),
    ("MIT", _TEXTS["MIT"].split("\n\n")[2]),
    ("BSD-3-Clause", "Redistribution" + _TEXTS["BSD-3-Clause"].split("Redistribution", 1)[1].split("\n\n")[0]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
TEMPLATES += tuple((n, f"SPDX-License-Identifier: {n}{x}") for n in (*_TEXTS, "CC-BY-4.0", "CC-BY-NC-4.0") for x in (("", "-only", "-or-later") if "GPL" in n else ("",)))
TEMPLATES += tuple(_TEXTS.items())
_HASHES = [_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in TEMPLATES]
_MARK = np.zeros(256, bool)  # first bytes of comment lines
_MARK[np.frombuffer(b"#/*;%!-<", np.uint8)] = True
VOCABULARY = np.unique(np.concatenate(_HASHES))


def _find(h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(VOCABULARY, h), len(VOCABULARY) - 1)
    return np.where(VOCABULARY[at] == h, at, -1)


def _line_words(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(first row, word hashes, line of each, first line of each row, lines, which are comments) of pieces of a batch."""
    raw, off = words.text_bytes(b.column("text"))
    for i, j in words.pieces(off):
        part, po = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, first = line_starts(part, po)
        h, line = _words(part, starts)
        s, _, at = words.word_spans(part, starts)
        comment = np.zeros(len(starts) - 1, bool)
        lead = np.flatnonzero(np.diff(at, prepend=-1))
        comment[at[lead]] = _MARK[part[s[lead]]]
        yield i, h, line, first, len(starts) - 1, comment


def _units(size: np.ndarray, row: np.ndarray, comment: np.ndarray) -> Iterator[np.ndarray]:
    """The unit of each line, from 0: lines, paragraphs, runs of comment lines or of others, whole texts."""
    yield np.arange(len(size))
    new = np.diff(row, prepend=-1) > 0
    turn = new | (np.diff(comment, prepend=False))
    bare = size == 0
    yield np.cumsum(turn | bare | np.append(False, bare[:-1])) - 1 if len(size) else row
    yield np.cumsum(turn) - 1
    yield row


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, lines = np.zeros(len(VOCABULARY), np.int64), 0
    for b in batches:
        for _, h, line, _, n, _ in _line_words(b):
            t = _find(h)
            pair = np.unique(line[t >= 0] * len(VOCABULARY) + t[t >= 0])
            total += np.bincount(pair % len(VOCABULARY), minlength=len(VOCABULARY))
            lines += n
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(VOCABULARY)), pa.int32()), pa.array(np.concatenate([[lines], total]))], names=["word", "n"])


def inverse_frequencies(texts: DataFrame) -> tuple[np.ndarray, float]:
    """(idf of each template word, the idf of a word met in no line)."""
    rows = texts.mapInArrow(_frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    lines = n.get(-1, 0)
    return np.array([np.log((1 + lines) / (1 + n.get(k, 0))) + 1 for k in range(len(VOCABULARY))]), float(np.log(1.0 + lines) + 1)


def _scan(batches: Iterator[pa.RecordBatch], idf: np.ndarray, other: float) -> Iterator[pa.RecordBatch]:
    templates = np.zeros((len(VOCABULARY), len(TEMPLATES)))
    for k, h in enumerate(_HASHES):
        np.add.at(templates[:, k], _find(h), 1)
    templates *= idf[:, None]
    templates /= np.linalg.norm(templates, axis=0)
    weights = np.vstack([templates * idf[:, None], np.zeros(len(TEMPLATES))])  # the last row: a word of no template
    value = np.append(idf, other)
    for b in batches:
        name, score, share = np.full(len(b), None, object), np.zeros(len(b)), np.zeros(len(b))
        for i, h, line, first, n_lines, comment in _line_words(b):
            if not len(h):
                continue
            t = _find(h)
            each, word = np.unique(h, return_inverse=True)
            size = np.bincount(line, minlength=n_lines)
            row = np.searchsorted(first, np.arange(n_lines), "right") - 1
            known = t >= 0
            dots = np.stack([np.bincount(line[known], weights[t[known], k], n_lines) for k in range(len(TEMPLATES))], 1)
            licensed = np.zeros(n_lines, bool)
            for unit in _units(size, row, comment):
                n = int(unit[-1]) + 1
                pair, c = np.unique(unit[line] * len(each) + word, return_counts=True)
                v = np.zeros(len(each))
                v[word] = value[t]
                length = np.sqrt(np.bincount(pair // len(each), (c * v[pair % len(each)]) ** 2, n))
                cosine = np.add.reduceat(dots, np.flatnonzero(np.diff(unit, prepend=-1)), axis=0) / np.where(length > 0, length, 1)[:, None]
                top = np.round(cosine.max(1), 12)
                licensed |= (top >= MIN_COSINE)[unit]
                of = row[np.flatnonzero(np.diff(unit, prepend=-1))]
                for u in np.flatnonzero(top >= MIN_COSINE).tolist():
                    if top[u] > score[i + of[u]]:
                        best = int((cosine[u] >= top[u] - 1e-12).argmax())
                        name[i + of[u]], score[i + of[u]] = TEMPLATES[best][0], top[u]
            words_of = np.bincount(row, size, len(first))
            share[i : i + len(first)] = np.bincount(row, size * licensed, len(first)) / np.maximum(words_of, 1)
        rest_cols = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(b.column, rest_cols), pa.array(name, pa.string()), pa.array(np.round(score, 6)), pa.array(share)], names=[*rest_cols, "own_license", "own_score", "share"])


def scan(files: DataFrame) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, license_dir) of files (doc_id, path, text)."""
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(inverse_frequencies(files.select("text")))
    rows = files.select("doc_id", "path", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = stash(rows.mapInArrow(lambda it: _scan(it, *shared.value), f"doc_id {kind}, path string, own_license string, own_score double, share double"))
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    directories = (
        found.where(F.col("own_license").isNotNull() & (F.col("share") >= FILE_SHARE) & F.col("path").contains("/"))
        .select(F.element_at(ancestors, -1).alias("dir"), "doc_id", "own_license")
        .groupBy("dir").agg(F.min_by("own_license", F.struct("doc_id", "own_license")).alias("dir_license"))
    )
    # the paths without a licence of their own, once each: a directory of many files is one row
    bare = found.where("own_license is null and path is not null").select(F.when(F.col("path").contains("/"), F.element_at(ancestors, -1)).alias("path_dir")).where("path_dir is not null").distinct()
    up = F.split("path_dir", "/")
    above = bare.select("path_dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(up)), lambda k: F.array_join(F.slice(up, 1, k), "/"))).alias("depth", "dir"))
    nearest = above.join(directories, "dir").groupBy("path_dir").agg(F.max_by(F.struct("dir_license", "dir"), "depth").alias("x")).select("path_dir", "x.*")
    d = found.withColumn("path_dir", F.when(F.col("own_license").isNull() & F.col("path").contains("/"), F.element_at(ancestors, -1)))
    return d.join(nearest, "path_dir", "left").select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("dir")).alias("license_dir"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / language / thousands / hundreds / id."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100) % 10, "doc_id")
    return scan(docs.select("doc_id", path.alias("path"), "text"))
