"""License scans: sparse TF-IDF cosine of notices and licence files to templates,
then inheritance from the nearest ancestor directory.

Every line, sentence and paragraph of every whole text is compared with notices,
titles and opening paragraphs, and licence files as a whole with licence texts too. Files without a match of their own take the licence of the nearest
directory above them that has a licence file, found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

#: Notices as their licences word them, one template a line.
TEMPLATES = {
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["SPDX-License-Identifier: CC-BY-4.0", "Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.",
                     "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["SPDX-License-Identifier: CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.",
                     "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights: CC0 1.0."],
    "GPL-2.0": ["SPDX-License-Identifier: GPL-2.0", "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["SPDX-License-Identifier: GPL-3.0", "This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["SPDX-License-Identifier: ISC", "Released under the ISC License."],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["SPDX-License-Identifier: MIT", "Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved."],
    "Unlicense": ["SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."],
}
#: Titles, headers and opening paragraphs of the licence texts, matched like notices.
_FSF = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
        "Free Software Foundation, either version {} of the License, or (at your option) any later version.")
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = (_BSD + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
          "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
          "in the documentation and/or other materials provided with the distribution.")
_BSD_3 = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
          "derived from this software without specific prior written permission.")
TITLES = {
    "AGPL-3.0": ["GNU Affero General Public License", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _FSF.format("Affero General Public License", 3)],
    "Apache-2.0": ["Apache License 2.0", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", _BSD, _BSD_2],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", _BSD_3, f"{_BSD_2} 3. {_BSD_3}"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _FSF.format("General Public License", 2)],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _FSF.format("General Public License", 3)],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _FSF.format("Lesser General Public License", 3)],
    "MIT": ["MIT License", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "Unlicense": ["The Unlicense"],
}
TEMPLATES = {name: forms + TITLES.get(name, []) for name, forms in TEMPLATES.items()}
#: Licences whose text has all of another's: that one is not meant beside them. A
#: reservation of rights counts only where nothing is granted.
RESERVED = "Proprietary"
COVERS = {"BSD-3-Clause": "BSD-2-Clause"}
TEXTS = Path(__file__).parent / "licences"
SIMILAR = 0.7
#: Words of any prose; they weigh least, whatever templates hold them.
COMMON = frozenset("a all an and any are as at be by for from has have in into is it may not of on or other that the this to under use with you your 1 2 3".split())
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]es?|copying|notice|unlicense)(?:\.(?:md|txt|rst|html))?$"
_WORD = re.compile(r"[^\W_]+(?:[.][0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def licence_texts() -> dict[str, list[str]]:
    """The licence texts that lie beside this module, one a name."""
    return {p.stem: [p.read_text("utf-8")] for p in sorted(TEXTS.glob("*.txt"))}


class Matcher:
    """Best template of a passage by TF-IDF cosine. IDF counts words over the
    templates, so a score belongs to the passage alone and not to the corpus around
    it; COMMON words weigh 1, and words outside the templates weigh as words that no
    template has. One word is no notice: a match shares two, or all of a template."""

    def __init__(self, templates: dict[str, list[str]], similar: float):
        every = [t for forms in templates.values() for t in forms]
        df = Counter(w for t in every for w in set(words_of(t)))
        self.similar, self.rarest = similar, math.log(len(every) + 1) + 1
        self.idf = {w: 1.0 if w in COMMON else math.log((len(every) + 1) / (n + 1)) + 1 for w, n in df.items()} | {w: 1.0 for w in COMMON}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.names: list[str] = []
        self.sizes: list[int] = []
        #: A passage without any of these words is below ``similar`` for all
        #: templates: the words that are left carry less than that part of each.
        self.cues: set[str] = set()
        for name, forms in sorted(templates.items()):
            for form in forms:
                own = self._weights(Counter(words_of(form)))
                length = math.sqrt(sum(x * x for x in own.values()))
                left = 1.0
                for w, x in sorted(own.items(), key=lambda p: (-p[1], p[0])):
                    if left < (similar - 1e-9) ** 2:
                        break
                    self.cues.add(w)
                    left -= (x / length) ** 2
                for w, x in own.items():
                    self.postings.setdefault(w, []).append((len(self.names), x / length))
                self.names.append(name)
                self.sizes.append(len(own))

    def _weights(self, counts: Counter) -> dict[str, float]:
        return {w: (1 + math.log(c)) * self.idf.get(w, self.rarest) for w, c in counts.items()}

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """(cosine, name) if at least ``similar``; ties go to the first name."""
        if self.cues.isdisjoint(words):
            return None
        own = self._weights(Counter(words))
        scores: dict[int, float] = {}
        for w, x in own.items():
            for k, y in self.postings.get(w, ()):
                scores[k] = scores.get(k, 0.0) + x * y
        length = math.sqrt(sum(x * x for x in own.values()))
        for top, k in sorted(((s / length, -k) for k, s in scores.items() if s >= self.similar * length), reverse=True):
            if sum(-k in {j for j, _ in self.postings.get(w, ())} for w in own) >= min(2, self.sizes[-k]):
                return top, self.names[-k]
        return None

    def scan(self, text: str, texts: Matcher | None = None) -> tuple[float, str] | None:
        """Best match over all lines, their sentences and all paragraphs of a text;
        for a licence file over the whole text too, against the templates and
        against ``texts``, the matcher of whole licence texts."""
        found, paragraph = [], []
        if texts is not None:
            whole = words_of(text)
            found += [texts.best(whole), self.best(whole)]
        if self.cues.isdisjoint(words_of(text)):
            return self._first(found)
        for line in [*text.splitlines(), ""]:
            words = words_of(line)
            if words:
                found.append(self.best(words))
                parts = () if found[-1] or self.cues.isdisjoint(words) else _SENTENCE.split(line.strip())
                if len(parts) > 1:
                    found += [self.best(words_of(p)) for p in parts]
                paragraph.append(words)
                continue
            if len(paragraph) > 1:
                found.append(self.best([w for p in paragraph for w in p]))
            paragraph = []
        return self._first(found)

    @staticmethod
    def _first(found: list) -> tuple[float, str] | None:
        found = [f for f in found if f]
        names = {name for _, name in found}
        gone = {COVERS.get(name) for name in names} | ({RESERVED} if names - {RESERVED} else set())
        return min((f for f in found if f[1] not in gone), key=lambda f: (-f[0], f[1]), default=None)


def directory(path: Column) -> Column:
    """Everything before the last slash ('' at the top)."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, '' last."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan_licenses(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, similar: float = SIMILAR,
                  whole: dict[str, list[str]] | None = None) -> DataFrame:
    """id, path, own_license, own_score, license, inherited_from for every row of
    files (id, path, text).

    own_license is the best template with a cosine of at least ``similar`` (null
    without one), whatever other rows there are; licence files are also compared as a
    whole with the texts ``whole`` (licence_texts() by default). license is the own
    one, else that of the nearest directory upwards with a licence file that
    matched; of several in one directory the highest score, then the first name.
    Null and empty texts match nothing but inherit; a null path counts as a file
    at the top. Repeated rows are judged alike.
    """
    src = files.select(F.col("id").cast("long").alias("id"), F.col("path").cast("string").alias("path"), "text")

    held = files.sparkSession.sparkContext.broadcast((Matcher(templates, similar), Matcher(licence_texts() if whole is None else whole, similar)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            notices, whole_texts = held.value
            found = [notices.scan(t.decode("utf-8", "replace"), whole_texts if w else None) for t, w in zip(texts, part.column("is_licence").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("path"), part.column("is_licence"), pa.array([f and f[1] for f in found], pa.string()),
                 pa.array([f and f[0] for f in found], pa.float64())], ["id", "path", "is_licence", "own_license", "own_score"])

    scored = materialise(src.withColumn("is_licence", F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)))
                         .select("id", "path", "is_licence", "text")
                         .mapInArrow(match, "id long, path string, is_licence boolean, own_license string, own_score double")
                         .withColumn("folder", directory(F.col("path"))), "scored")
    at = (scored.where("is_licence AND own_license IS NOT NULL").groupBy(F.col("folder").alias("above"))
          .agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("best"))
          .select("above", F.col("best.own_license").alias("given")))
    # one row per directory and ancestor, whatever the number of files
    folders = scored.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("above"))
    nearest = (folders.join(at, "above").groupBy("folder")
               .agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given")).alias("x"))
               .select("folder", F.col("x.above").alias("inherited_from"), F.col("x.given").alias("given")))
    out = scored.join(nearest, "folder", "left")
    own = F.col("own_license").isNotNull()
    return out.select("id", "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"),
                      F.when(~own, F.col("inherited_from")).alias("inherited_from"))


def document_files(docs: DataFrame, per_folder: int = 64) -> DataFrame:
    """documents as a tree of files (id, path, text): source/lang/number/name, one
    LICENSE to a directory. Only lays out rows; the scan reads paths as they are."""
    number = F.floor(F.col("doc_id") / per_folder)
    name = F.when(F.col("doc_id") % per_folder == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", number.cast("string"), name).alias("path"), "text")
