"""Licence scans with DataFrame functions only.

A paragraph is a line of a text, or a run of lines with words between which fewer words lie than the longest template has,
so that notices count however they are wrapped. A run is given only where it confirms a family that no shorter (or earlier)
run in it or overlapping it does; its number is that of its first line. A multinomial logistic regression over sparse word
n-grams (one to three words; an L1 penalty chooses them) gives it a licence family or the class `unknown`. It is trained on
the driver, on variants of the templates below (words dropped, other words around) and, for `unknown`, on sentences that only
sound like licences. Its temperature is calibrated on templates and sentences that the machine it is fitted with has not seen
in any variant; the machine that is used has seen them all. A predicted family counts only when enough words of one of its
templates are in the paragraph.

Only paragraphs with a cue (a word that begins with one of CUES, as every template has one) are judged; texts without any are
passed over by plain substring tests. The rest is array functions within the row: no join and no shuffle.

A null or empty text has no paragraphs. Rows that repeat are scanned each for itself, whatever their identifiers; other
columns are left aside. Ties between families go to the first by name. An empty table gives an empty result. A long text is
one row's arrays of lines; nothing of it is cut.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm._common import clean_id, table

#: Notices by which licences are granted, for longer ones the sentence that names them (fixed values).
TEMPLATES = {
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "Under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.", "Released under the AGPL version 3 license.", "Distributed under the AGPL-3.0 license."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.", "Distributed under the terms of the Apache License 2.0."],
    "bsd": ["Released under the BSD License.", "Licensed under the 3-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license.", "Distributed under the terms of the Modified BSD License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution 4.0 license."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Available under the Creative Commons Attribution-NonCommercial 4.0 license."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Available under the Creative Commons Attribution-ShareAlike 4.0 license."],
    "cc0-1.0": ["Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work under CC0.", "Available under the Creative Commons CC0 1.0 Universal Public Domain Dedication."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPL version 3 license.", "SPDX-License-Identifier: GPL-3.0", "Under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.", "Distributed under the GPL-3.0 license."],
    "lgpl-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0", "Under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License.", "Released under the LGPL version 3 license.", "Distributed under the LGPL-3.0 license."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "SPDX-License-Identifier: MIT", "Distributed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the MPL 2.0 license."],
}
#: Sentences that name licences or permissions but grant none of these.
OTHERS = [
    "A driving license is needed to rent a car.", "The license fee is due at the end of the month.", "Permission to enter the building was refused.", "All rights reserved, copyright by the author.",
    "The apache helicopter landed near the village.", "They signed a public statement on creative writing.", "Licensed under a license of our own.", "Released under the terms of the license.",
    "Version 2.0 was released last week.", "The software license expired on Monday.", "Redistribution of wealth was discussed.", "A gnu is a large antelope.", "Licensed plumbers are hard to find.",
    "Fishing licenses are sold at the public office.", "The mozilla conference is open to the public.", "Public domain names are expensive.", "This work is licensed.", "See the license file for details.",
    "Distributed under the terms of an agreement with the publisher.", "The general public was free to use the source of the river.", "Either version of the story may be published by the foundation.", "This file is subject to change without notice.",
    "You may not use this file at work.", "Permission is granted to any person with a copy of the ticket.", "Use of this building is governed by the house rules.", "The author has waived all rights to the work.", "A license as published by the city, either in person or by mail.",
    "Available under the counter.", "Commons are shared by all people of the village.", "An attribution of the painting to the master is doubtful.", "The domain of the function is the set of real numbers.", "Creative people need a license to fail.",
]
UNKNOWN = "unknown"
#: Stems that make a word a cue; a text that holds none of them as a part has no cue.
CUES = ("licen", "gnu", "gpl", "apache", "bsd", "cc", "creative", "commons", "spdx", "permission", "redistribution", "mozilla", "mpl", "domain")
#: Least probability, and least share of a template's words in the paragraph.
SURE, ALIKE = 0.5, 0.8
FOUND = "array<struct<number:int,paragraph:string,family:string,probability:double,alike:double,confirmed:boolean>>"
SPLIT = r"[^a-z0-9.+-]+"


def words_of(text: str) -> list[str]:
    """Lower-case words without dots at their ends, as words() gives them."""
    return [w for x in re.split(SPLIT, text.lower()) if (w := x.strip("."))]


def words(text: Column) -> Column:
    parts = F.transform(F.split(F.lower(text), SPLIT), lambda x: F.btrim(x, F.lit(".")))
    return F.filter(parts, lambda x: x != "")


def cue(word: str) -> bool:
    return word.startswith(CUES)


def grams_of(tokens: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)))


def variants(text: str, random: np.random.Generator) -> list[list[str]]:
    """A sentence's words, also with one dropped and with others around."""
    own = words_of(text)
    filler = "the code here notes of this book see more and file about text data our new page".split()
    out = [own]
    for _ in range(6):
        few = [w for i, w in enumerate(own) if i != random.integers(len(own)) or cue(w) or any(c.isdigit() for c in w)]
        around = [filler[i] for i in random.integers(0, len(filler), 6)]
        cut = int(random.integers(0, 7))
        out.append(around[:cut] + few + around[cut:])
    return out


class Classifier:
    """names (unknown last), grams, weights (a row for each name), biases; temperature is in them.

    apart: the templates (by place in their family) and sentences that only calibrate; None fits on all of them with the
    temperature that those of every third place give."""

    def __init__(self, templates: dict[str, list[str]], others: list[str], seed: int = 3, apart: int | None = None, temperature: float | None = None):
        random = np.random.default_rng(seed)
        self.names = [*sorted(templates), UNKNOWN]
        rows = [(v, n, i) for n, name in enumerate(self.names) for i, t in enumerate(templates.get(name, others)) for v in variants(t, random)]
        y, place = (np.array([r[k] for r in rows] + [len(self.names) - 1 if k == 1 else -1] * 40) for k in (1, 2))
        held = np.zeros(len(y), bool) if apart is None else place % 3 == apart
        known = Counter(g for (v, _, _), h in zip(rows, held.tolist()) if not h for g in grams_of(v))
        self.grams = sorted(g for g, n in known.items() if n > 2)
        at = {g: i for i, g in enumerate(self.grams)}
        x = np.zeros((len(y), len(self.grams)), np.float32)
        for i, (v, _, _) in enumerate(rows):
            x[i, [at[g] for g in grams_of(v) if g in at]] = 1
        weights, bias = self._fit(x[~held], y[~held])
        if temperature is None and apart is None:
            temperature = Classifier(templates, others, seed, 2).temperature
        elif temperature is None:
            logits, heat = x[held] @ weights.T + bias, np.arange(2, 61) / 10
            loss = [-np.log(np.maximum(self.soft(logits / t)[np.arange(held.sum()), y[held]], 1e-12)).mean() for t in heat]
            temperature = float(heat[int(np.argmin(loss))])
        self.temperature = temperature
        self.weights, self.biases = weights / temperature, bias / temperature
        used = np.abs(self.weights).max(0) > 0
        self.grams, self.weights = [g for g, u in zip(self.grams, used) if u], self.weights[:, used]

    def chances(self, text: str) -> np.ndarray:
        on = [i for i, g in enumerate(self.grams) if g in set(grams_of(words_of(text)))]
        return self.soft((self.weights[:, on].sum(1) + self.biases)[None])[0]

    @staticmethod
    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 4.0, l1: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
        """Proximal gradient descent with an L1 penalty, which keeps the weights sparse; every class weighs the same, and longer
        n-grams cost more."""
        n = len(self.names)
        goal, share = np.eye(n, dtype=x.dtype)[y], (len(y) / (n * np.maximum(1, np.bincount(y, minlength=n))))[y][:, None].astype(x.dtype) / len(x)
        scale = np.array([0.5 ** g.count(" ") for g in self.grams], x.dtype)
        x = x * scale
        weights, bias = np.zeros((n, x.shape[1]), x.dtype), np.zeros(n, x.dtype)
        for _ in range(steps):
            error = (self.soft(x @ weights.T + bias) - goal) * share
            weights -= rate * (error.T @ x)
            bias -= rate * error.sum(0)
            weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * l1, 0)
        return weights * scale, bias


def cross_validated(templates: dict[str, list[str]] = TEMPLATES, others: list[str] = OTHERS, sure: float = SURE) -> tuple[float, float]:
    """Precision and recall of families on templates and sentences that the machine has not seen in any variant."""
    hit = said = there = 0
    for apart in range(3):
        model = Classifier(templates, others, apart=apart, temperature=1.0)
        for name in model.names:
            for text in templates.get(name, others)[apart::3]:
                p = model.chances(text)
                best = model.names[int(p.argmax())]
                told = best != UNKNOWN and p.max() >= sure
                said, there, hit = said + told, there + (name != UNKNOWN), hit + (told and best == name)
    return hit / max(1, said), hit / max(1, there)


@lru_cache(1)
def trained() -> Classifier:
    return Classifier(TEMPLATES, OTHERS)


def _numbers(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values.ravel().tolist())), ",").cast("array<double>")


def _strings(values: list[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def judge(paragraph: Column, model: Classifier | None = None, templates: dict[str, list[str]] = TEMPLATES) -> Column:
    """(paragraph, family, probability, alike) of one paragraph."""
    model = model or trained()
    n, names = len(model.grams), _strings(model.names)
    forms = F.split(F.lit("\n".join("\t".join(" ".join(words_of(t)) for t in templates.get(m, [])) for m in model.names)), "\n")

    def grams(w: Column) -> Column:
        at = lambda k: F.transform(F.slice(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), F.lit(1), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i, k + 1), " "))
        return F.array_distinct(F.concat(w, at(1), at(2)))

    def chances(w: Column) -> Column:
        found = F.filter(F.transform(F.array_intersect(grams(w), _strings(model.grams)), lambda g: F.array_position(_strings(model.grams), g).cast("int")), lambda i: i > 0)
        score = lambda k: F.aggregate(found, F.element_at(_numbers(model.biases), k + 1), lambda a, i: a + F.element_at(_numbers(model.weights), k * n + i))
        return F.transform(F.transform(F.sequence(F.lit(0), F.lit(len(model.names) - 1)), score), F.exp)

    def told(w: Column, e: Column) -> Column:
        best = F.array_position(e, F.array_max(e)).cast("int")
        likeness = F.transform(F.split(F.element_at(forms, best), "\t"), lambda t: F.size(F.array_intersect(F.split(t, " "), w)) / F.size(F.array_distinct(F.split(t, " "))))
        return F.struct(paragraph.alias("paragraph"), F.element_at(names, best).alias("family"), (F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)).alias("probability"), F.array_max(likeness).alias("alike"))

    one = F.transform(F.array(words(paragraph)), lambda w: F.element_at(F.transform(F.array(chances(w)), lambda e: told(w, e)), 1))
    return F.element_at(one, 1)


def gated(text: Column) -> Column:
    """Whether text may hold a cue."""
    low = F.lower(text)
    return reduce(Column.__or__, (low.contains(c) for c in CUES))


def runs(text: Column, longest: int) -> Column:
    """(first, last, p) of the lines that may hold a cue and of the runs of lines that do."""
    lines = F.transform(F.split(text, "\n"), lambda p, i: F.struct(i.alias("number"), p.alias("p"), F.size(words(p)).alias("n"), gated(p).alias("cued")))

    def ends(all_: Column, x: Column) -> Column:
        some = F.slice(all_, x["number"] + 1, longest + 1)
        state = F.struct(F.lit(0).alias("inner"), F.lit(False).alias("cued"), F.lit(True).alias("whole"), F.array().cast("array<int>").alias("ends"))

        def step(a: Column, y: Column) -> Column:
            first, cued = y["number"] == x["number"], a["cued"] | y["cued"]
            whole = a["whole"] & (y["n"] > 0) & (a["inner"] < longest)
            end = F.when((whole | first) & cued, F.array(y["number"])).otherwise(F.array().cast("array<int>"))
            return F.struct((a["inner"] + F.when(first, 0).otherwise(y["n"])).alias("inner"), cued.alias("cued"), whole.alias("whole"), F.concat(a["ends"], end).alias("ends"))

        found = F.when(F.exists(some, lambda y: y["cued"]), F.aggregate(some, state, step)["ends"]).otherwise(F.array().cast("array<int>"))
        of = lambda e: F.array_join(F.transform(F.slice(all_, x["number"] + 1, e - x["number"] + 1), lambda y: y["p"]), "\n")
        return F.transform(found, lambda e: F.struct(x["number"].alias("first"), e.alias("last"), of(e).alias("p")))

    return F.element_at(F.transform(F.array(lines), lambda all_: F.flatten(F.transform(all_, lambda x: ends(all_, x)))), 1)


def chosen(judged: Column) -> Column:
    """Single lines, but for those in place of which a run is confirmed; and the shortest confirmed runs."""
    size = lambda x: x["last"] - x["first"]
    sure = F.filter(judged, lambda x: x["confirmed"])

    def of(all_: Column) -> Column:
        meets = lambda x, y: (x["family"] == y["family"]) & (x["first"] <= y["last"]) & (y["first"] <= x["last"])
        before = lambda x, y: (size(y) < size(x)) | ((size(y) == size(x)) & (y["first"] < x["first"]))
        lines = lambda x: (size(x) == 0) & (x["confirmed"] | ~F.exists(all_, lambda y: meets(x, y)))
        return F.filter(judged, lambda x: lines(x) | ((size(x) > 0) & x["confirmed"] & ~F.exists(all_, lambda y: meets(x, y) & before(x, y))))

    return F.element_at(F.transform(F.array(sure), of), 1)


def scan(docs: DataFrame, model: Classifier | None = None, sure: float = SURE, alike: float = ALIKE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and found, the paragraphs (number, paragraph, family, probability, alike, confirmed)
    for which a family other than unknown is predicted."""
    own = clean_id(docs, id_col, text_col).select("doc_id", F.col(text_col).alias("text"))
    longest = max(len(words_of(t)) for forms in TEMPLATES.values() for t in forms)
    judged = F.transform(runs(F.col("text"), longest), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), judge(x["p"], model).alias("j")))
    flat = F.transform(judged, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["j"]["paragraph"].alias("paragraph"), x["j"]["family"].alias("family"), x["j"]["probability"].alias("probability"), x["j"]["alike"].alias("alike"), ((x["j"]["probability"] >= sure) & (x["j"]["alike"] >= alike)).alias("confirmed")))
    told = F.element_at(F.transform(F.array(F.filter(flat, lambda x: x["family"] != UNKNOWN)), chosen), 1)
    found = F.transform(told, lambda x: F.struct(x["first"].alias("number"), x["paragraph"].alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), x["alike"].alias("alike"), x["confirmed"].alias("confirmed")))
    return own.select("doc_id", F.when(gated(F.col("text")), found).otherwise(F.array().cast(FOUND)).alias("found"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that the paragraphs of all documents grant."""
    found = scan(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_confirmed"),
        (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        F.round(F.array_max(F.transform(sure, lambda x: x["probability"])), 6).alias("probability"),
    )
