"""License scan: TF-IDF cosine of lines and whole texts to templates, then inheritance from directories.

A file's own license is that of its best line or, if it is mostly a license, of its whole text.  A file without one
takes that of the license file in its nearest ancestor directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rows import LOWER, annotate, texts
from plumbline.session import cut_lineage

#: Openings and headers of public licenses.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
    ),
    "Proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
#: Least cosine of a line, and of a whole text that is a license.
LEAST_COSINE = 0.7
_TERM = re.compile(rb"[a-z0-9\x80-\xff]+")


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.translate(LOWER))


def document_frequencies(documents: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each word of the vocabulary: all documents are counted.

    Tasks return one row per word they met; the vocabulary is that of the templates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = Counter(), 0
        for batch in batches:
            for octets in texts(batch.column(0)):
                total += 1
                if octets:
                    found.update(vocabulary.intersection(terms(octets)))
        rows = [*found.items(), (b"", total)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([n for _, n in rows])], names=["term", "n"])

    counted = documents.select(text).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    table = {bytes(r.term): r.n for r in counted.collect()}
    return table.pop(b"", 0), table


class Matcher:
    """Sparse unit vectors of the templates; words of no template weigh like words seen once."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], total: int, frequencies: Mapping[bytes, int], least: float):
        self.least = least
        self.other = math.log(1 + total) + 1
        self.idf = {}
        self.vectors: list[tuple[str, dict[bytes, float]]] = []
        for name, forms in templates.items():
            for form in forms:
                for word in terms(form.encode()):
                    self.idf.setdefault(word, math.log((1 + total) / (1 + frequencies.get(word, 0))) + 1)
        for name, forms in templates.items():
            for form in forms:
                weights = {w: n * self.idf[w] for w, n in Counter(terms(form.encode())).items()}
                norm = math.sqrt(sum(x * x for x in weights.values()))
                self.vectors.append((name, {w: x / norm for w, x in weights.items()}))

    def best(self, words: list[bytes]) -> tuple[float, str]:
        """Cosine and name of the nearest template, or 0 and no name below the least cosine; ties go by name."""
        counts = Counter(words)
        own = {w: n * self.idf[w] for w, n in counts.items() if w in self.idf}
        inside = sum(x * x for x in own.values())
        outside = self.other**2 * sum(n * n for w, n in counts.items() if w not in self.idf)
        # The part inside the templates' words bounds the cosine.
        if not own or inside < self.least**2 * (inside + outside):
            return 0.0, ""
        norm = math.sqrt(inside + outside)
        found = min((-sum(x * v.get(w, 0.0) for w, x in own.items()) / norm, name) for name, v in self.vectors)
        return (-found[0], found[1]) if -found[0] >= self.least else (0.0, "")

    def scan(self, text: bytes | None) -> tuple[str | None, float, int | None]:
        """License, cosine and line (from 1; 0: the whole text) of the best match."""
        best: tuple[float, int, str] = (0.0, 0, "")
        idf = self.idf
        every: list[bytes] = []
        for number, line in enumerate((text or b"").split(b"\n"), 1):
            words = terms(line)
            every += words
            if 2 * sum(w in idf for w in words) >= len(words) > 0:  # others are dearer, so this bounds the cosine too
                score, name = self.best(words)
                best = max(best, (score, -number, name))
        score, name = self.best(every)
        if score > best[0]:
            return name, score, 0
        return (best[2], best[0], -best[1]) if best[0] else (None, 0.0, None)


def scan(
    documents: DataFrame,
    *,
    text: str = "text",
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    least: float = LEAST_COSINE,
) -> DataFrame:
    """Add ``license``, ``cosine`` and ``line`` of each text's own license; null, 0 and null if it has none."""
    vocabulary = {w for forms in templates.values() for f in forms for w in terms(f.encode())}
    total, frequencies = document_frequencies(documents, vocabulary, text)

    def make() -> Callable:
        matcher = Matcher(templates, total, frequencies, least)
        return lambda column: list(zip(*map(matcher.scan, texts(column)), strict=True)) if len(column) else [[], [], []]

    fields = T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("cosine", T.DoubleType(), False),
            T.StructField("line", T.IntegerType()),
        ]
    )
    return annotate(documents, [text], make, fields)


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, each with its depth, by walking its parts."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    upto = F.sequence(F.lit(0), F.size(parts))
    return F.transform(upto, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))


def inherit(scanned: DataFrame, *, path: str = "path", is_license_file: Column | None = None) -> DataFrame:
    """Add ``effective`` (the license that holds) and ``origin``: own, the directory it comes from, or null.

    A directory's license is that of its license file with the highest cosine, then the least path.  The join is on
    directories, so it is as large as their number, not the files'; a directory of any size meets one row.
    Null paths lie in no directory.
    """
    named = F.col(path).rlike("(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$") if is_license_file is None else is_license_file
    files = cut_lineage(scanned.withColumn("_dir", parent(F.col(path))))
    declared = files.where(named & F.col("license").isNotNull()).groupBy(F.col("_dir").alias("above")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col(path).alias("p"), F.col("license").alias("given")))["given"].alias("given")
    )
    directories = files.where("_dir IS NOT NULL").select("_dir").distinct()
    climbed = directories.select("_dir", F.inline(ancestors(F.col("_dir"))))
    nearest = climbed.join(declared, "above").groupBy("_dir").agg(F.max(F.struct("depth", "above", "given")).alias("_near"))
    joined = files.join(cut_lineage(nearest), "_dir", "left")
    own = F.col("license").isNotNull()
    return joined.select(
        *scanned.columns,
        F.coalesce("license", "_near.given").alias("effective"),
        F.when(own, F.lit("own")).when(F.col("_near").isNotNull(), F.concat(F.lit("/"), "_near.above")).alias("origin"),
    )
