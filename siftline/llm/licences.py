"""Operator 6: licences of files, by their own text or from the nearest directory above.

1. Each line of a file that shares enough words with a template is compared with it by TF-IDF
   cosine over sparse term vectors; inverse document frequencies of the templates' terms are
   counted over all files (a term outside the templates weighs as much as one that no file has).
   The best template of the best line is the file's own licence if the cosine reaches `least`.
2. A licence file gives its licence to its directory; of several the best, then the first path.
3. Directories look for the nearest licensed directory at or above them by joining the list of
   their ancestors with the licensed ones, and files without an own licence take their
   directory's. Ancestors are listed once per directory, not per file.

Edge cases: null, empty and very long texts are read whole, line by line; a null path has no
directory and inherits nothing; equal cosines go to the template first by name; repeated rows
are judged each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered, own_id, table

LEAST = 0.7
#: Notices by licence: public, fixed wording.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "CC-BY-4.0": ["This work is licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
_TERM = re.compile(r"[a-z0-9.]*[a-z0-9]")


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


class Templates:
    """Unit TF-IDF vectors of the templates, and their terms' weights."""

    def __init__(self, templates: dict[str, list[str]], files: int, having: dict[str, int]):
        counts = [(name, Counter(terms(line))) for name in sorted(templates) for line in templates[name]]
        self.idf = {t: self.weight(files, having.get(t, 0)) for _, c in counts for t in c}
        self.other = self.weight(files, 0)
        self.vectors = []
        for name, c in counts:
            v = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append((name, {t: x / norm for t, x in v.items()}))

    @staticmethod
    def weight(files: int, having: int) -> float:
        return math.log((1 + files) / (1 + having)) + 1

    def best(self, line: str, least: float) -> tuple[float, str | None]:
        found = terms(line)
        shared = sum(t in self.idf for t in found)
        if not shared:
            return 0.0, None
        count = Counter(found)
        norm = math.sqrt(sum((n * self.idf.get(t, self.other)) ** 2 for t, n in count.items()))
        top: tuple[float, str | None] = (0.0, None)
        for name, vector in self.vectors:
            cosine = sum(n * self.idf[t] * vector[t] for t, n in count.items() if t in vector) / norm
            if cosine > top[0]:
                top = (cosine, name)
        return top if top[0] >= least else (0.0, None)


def _having(wanted: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: Counter = Counter()
            for text in batch["text"]:
                if isinstance(text, str):
                    count.update(wanted.intersection(terms(text)))
            yield pd.DataFrame({"term": list(count), "files": list(count.values())})

    return run


def _own(templates: Templates, least: float, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                top: tuple[float, str | None, int] = (0.0, None, 0)
                for line in (text.split("\n") if isinstance(text, str) else ()):
                    score, name = templates.best(line, least)
                    if name is not None and score > top[0]:
                        top = (score, name, len(terms(line)))
                share = top[2] * most >= len(terms(text)) if top[1] else False
                rows.append((top[1], top[0], share))
            out = pd.DataFrame(rows, columns=["own_licence", "own_score", "is_licence_file"])
            out.insert(0, "path", batch["path"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return run


def scan_licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST, most: int = 10) -> DataFrame:
    """doc_id, path, own_licence, own_score, licence, inherited_from for every row of `files` (doc_id, path, text).

    A file is a licence file if its notice is at least one `most`-th of its words, or if it is
    named so.
    """
    texts = numbered(files, F.col("path").cast("string").alias("path"), "text")
    wanted = frozenset(t for lines in templates.values() for line in lines for t in terms(line))
    counted = texts.select("text").mapInPandas(_having(wanted), "term string, files long").groupBy("term").agg(F.sum("files").alias("n"))
    having = {r["term"]: r["n"] for r in counted.collect()}  # at most one row per template term
    known = Templates(templates, files.count(), having)
    own = materialize(
        texts.mapInPandas(_own(known, least, most), "doc_id long, path string, own_licence string, own_score double, is_licence_file boolean"),
        "licences",
    ).withColumn("directory", _directory(F.col("path"))).withColumn("doc_id", own_id())
    named = F.element_at(F.split("path", "/"), -1).rlike(r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$")
    givers = own.where("own_licence is not null and directory is not null").where(F.col("is_licence_file") | named)
    first = F.min_by(F.struct("own_licence", "path"), F.struct(-F.col("own_score"), "path"))
    licensed = materialize(
        givers.groupBy("directory").agg(first.alias("x")).select("directory", F.col("x.own_licence").alias("given"), F.col("x.path").alias("giver")),
        "licensed",
    )
    directories = own.where("directory is not null").select("directory").distinct()
    parts = F.filter(F.split("directory", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nearest = (
        directories.select("directory", F.posexplode(above).alias("up", "ancestor"))
        .join(licensed.withColumnRenamed("directory", "ancestor"), "ancestor")
        .groupBy("directory").agg(F.min_by(F.struct("given", "giver"), "up").alias("x"))
    )
    nearest = materialize(nearest.select("directory", "x.given", "x.giver"), "nearest")
    joined = own.join(nearest, "directory", "left")
    return joined.select(
        "doc_id", "path", "own_licence", "own_score", F.coalesce("own_licence", "given").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("giver")).alias("inherited_from"),
    )


def _directory(path: Column) -> Column:
    """What stands before the last name, without slashes at the ends."""
    return F.trim(F.regexp_replace(path, "[^/]*$", ""), F.lit("/"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source / language / hundreds of ids / id."""
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan_licences(docs.select("doc_id", place.alias("path"), "text"))
