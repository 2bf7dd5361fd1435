"""Operator 7: licence scans, in DataFrame functions alone.

A paragraph (a line, alone and joined with the words after it, as notices are wrapped) is classified by sparse multinomial logistic regression on the
presence of word one- and two-grams: a licence family, or unknown.  The model is fitted
on the driver, in numpy, on a bounded set of paragraphs made from templates and counter-examples by
a seed; it never sees the corpus.  Probabilities are calibrated by a temperature.  A
prediction counts when its probability reaches PROBABILITY and the paragraph holds
SIMILARITY of the two-grams of a template of that family.  A text with paragraphs that
are like a licence and none that counts is ``unknown``.

Every feature holds one of STEMS, or of MARKS, which count beside a stem only; a
paragraph without any stem is unknown by the intercepts (checked when fitting); such paragraphs are not cut in words.
Weights travel as one literal map, features times families: no join and no shuffle.

A wrapped notice that is repeated within the length of the longest template counts once.
Null and empty texts have no paragraphs and licence ``none``.  Ties go to the earlier
paragraph, then to the alphabetically first family.  Repeated rows give equal rows; an
empty table gives an empty table; extra columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

PROBABILITY, SIMILARITY = 0.5, 0.6
#: Similarity from which a paragraph of a probable family is like a licence.
LIKE = 0.3
FEATURES, ROWS = 600, 6000
NONE, UNKNOWN = "none", "unknown"

#: A notice or the first words of each licence family, as published.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Released under the BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "licensed under the BSD 3-Clause License"],
    "Artistic-2.0": ["licensed under the Artistic License 2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0 Creative Commons license"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC-BY-NC-ND": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Licensed under CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Licensed under CC BY-NC-SA 4.0"],
    "CC-BY-ND": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-ND 4.0"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC0": ["dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication", "This is free and unencumbered software released into the public domain"],
    "CDDL-1.0": ["subject to the terms of the Common Development and Distribution License"],
    "EPL": ["licensed under the Eclipse Public License, version 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "EUPL-1.2": ["Licensed under the European Union Public Licence, version 1.2", "Licensed under the EUPL, Version 1.2"],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "licensed under the MIT License"],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License, version 2.0", "licensed under the Mozilla Public License 2.0"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "Zlib": ["Released under the zlib License", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
}
#: Look-alikes, which are unknown.
COUNTER = [
    "all rights reserved", "a driving licence is required", "the license plate of the car", "licensed premises and public houses", "the general public is invited", "public domain name registration",
    "permission to enter the building is granted by the office", "the apache helicopter landed", "gnu and antelope grazed", "the creative team of the commons", "terms of service and privacy policy", "a licence to print money",
    "version 2.0 of the product", "copyright notice of the museum", "a software license costs money", "the license fee is due", "free software for schools", "mit der bahn", "license agreement between the parties", "the foundation published a report",
]
#: Parts of words; each feature holds one.
STEMS = ("licens", "licenc", "gnu", "apache", "mozilla", "creative", "public domain", "permission", "redistribution", "foundation", "compliance", "cc0", "documentation files", "fee is", "purpose with", "general public", "cc by")
#: Further parts of features, in paragraphs that hold a stem.
MARKS = ("by nc", "by sa", "by nd", "nc sa", "nc nd", "noncommercial", "sharealike", "noderiv", "eclipse", "version 2", "version 3")
#: A paragraph with one of these is like a licence, whatever its family.
PHRASES = ("licensed under", "released under", "distributed under the terms", "under the terms of", "license identifier", "under license from", "public license", "public licence")


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams(text: str) -> list[str]:
    w = words(text)
    return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))


def stemmed(gram: str) -> bool:
    return any(s in gram for s in STEMS)


def featured(gram: str) -> bool:
    return any(s in gram for s in STEMS + MARKS)


class Model:
    def __init__(self, families: list[str], features: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.families, self.features, self.weights, self.bias, self.temperature = families, features, weights, bias, temperature


def examples(rows: int, seed: int) -> list[tuple[str, str]]:
    """Paragraphs and their family: templates whole or with words lost, inside other
    words; counter-examples and plain words, unknown."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    noise = lambda n: " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n))
    names = sorted(TEMPLATES)
    out = []
    for k in range(rows):
        if k % 3 < 2:
            name = names[(k // 3) % len(names)]
            body = TEMPLATES[name][int(rng.integers(len(TEMPLATES[name])))].split()
            if rng.random() < 0.3:
                body = [w for w in body if rng.random() > 0.05]
            body = " ".join(body)
        else:
            name = UNKNOWN
            body = COUNTER[int(rng.integers(len(COUNTER)))] if rng.random() < 0.6 else noise(8)
        before, after = (int(rng.integers(0, 12)) if rng.random() < 0.4 else 0 for _ in range(2))
        out.append((f"{noise(before)} {body} {noise(after)}", name))
    return out


@lru_cache(maxsize=2)
def trained(rows: int = ROWS, features: int = FEATURES, seed: int = 11) -> Model:
    made = examples(rows, seed)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    count: dict[str, int] = {}
    for text, _ in made:
        for g in grams(text):
            if featured(g):
                count[g] = count.get(g, 0) + 1
    chosen = sorted(sorted(count, key=lambda g: (-count[g], g))[:features])
    at = {g: i for i, g in enumerate(chosen)}
    x = np.zeros((len(made), len(chosen)))
    for row, (text, _) in zip(x, made, strict=True):
        row[[at[g] for g in grams(text) if g in at]] = 1
    y = np.array([families.index(f) for _, f in made])
    fit, held = np.arange(len(made)) % 5 != 4, np.arange(len(made)) % 5 == 4
    w, b = np.zeros((len(chosen), len(families))), np.zeros(len(families))
    soft = lambda z: (e := np.exp(z - z.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)
    target = np.eye(len(families))[y[fit]]
    for _ in range(300):
        error = (soft(x[fit] @ w + b) - target) / fit.sum()
        w -= 8 * (x[fit].T @ error + 1e-5 * w)
        b -= 8 * error.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - 8e-5, 0)  # sparse: the step of an absolute penalty
    b[0] = max(b[0], b[1:].max() + 2)  # a paragraph without features is unknown
    loss = {t: -np.log(np.maximum(soft((x[held] @ w + b) / t)[np.arange(held.sum()), y[held]], 1e-12)).mean() for t in 2.0 ** np.arange(-2, 3, 0.25)}
    used = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    return Model(families, [chosen[i] for i in used], np.round(w[used], 6), np.round(b, 6), float(min(loss, key=loss.get)))


def _any(c: Column, parts: tuple[str, ...] = STEMS) -> Column:
    out = F.contains(c, F.lit(parts[0]))
    for s in parts[1:]:
        out = out | F.contains(c, F.lit(s))
    return out


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def paragraphs(df: DataFrame, *, model: Model | None = None, probability: float = PROBABILITY, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, findings: array of paragraph (number of the line), family, probability,
    similarity, confirmed; and like: array of the same for lines that are like a licence
    and not confirmed."""
    model = model or trained()
    weights = _literal({f: w.tolist() for f, w in zip(model.features, model.weights, strict=True)}, "map<string,array<double>>")
    bias = _literal(model.bias.tolist(), "array<double>")
    names = _literal(model.families, "array<string>")
    templates = _literal({f: [grams_two(t) for t in ts] for f, ts in TEMPLATES.items()}, "map<string,array<array<string>>>")
    span = max(len(words(t)) for ts in TEMPLATES.values() for t in ts)
    # A text without the first word of any stem has no line with one.
    could = F.lit(False)
    lowered = F.lower(F.col("text"))
    for first in sorted({s.split(" ")[0] for s in STEMS} - {"cc"}):
        could = could | F.contains(lowered, F.lit(first))
    could = could | lowered.rlike("cc[^a-z0-9]+by")
    lines = F.when(could, F.split(lowered, "\n")).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(lines, lambda p, i: F.struct(i.cast("long").alias("at"), p.alias("line")))
    # Blanks between the words of a stem of two can be any marks, so those lines are
    # normalised before they are searched.
    plain = F.transform(numbered, lambda s: F.struct(s["at"].alias("at"), F.trim(F.regexp_replace(s["line"], "[^a-z0-9]+", " ")).alias("line")))
    plain = F.filter(plain, lambda s: s["line"] != "")
    staged = need(df, "doc_id", "text").select("doc_id", plain.alias("plain"))
    heads = F.transform("plain", lambda s: F.substring_index(s["line"], " ", span))
    staged = staged.select("doc_id", "plain", heads.alias("heads"))

    def followed(s: Column, i: Column) -> Column:
        """A line and as many words after it as the longest template has."""
        rest = F.substring_index(F.concat_ws(" ", F.slice("heads", i + 2, span)), " ", span)
        return F.struct(s["at"].alias("at"), i.alias("place"), s["line"].alias("line"), rest.alias("rest"))

    def units(s: Column) -> Column:
        """The line alone, and joined with the words after it."""
        own = F.struct(s["at"].alias("at"), s["place"].alias("place"), s["line"].alias("line"), F.lit("").alias("rest"), F.lit(False).alias("joined"))
        both = F.struct(s["at"].alias("at"), s["place"].alias("place"), F.concat_ws(" ", s["line"], s["rest"]).alias("line"), s["rest"].alias("rest"), F.lit(True).alias("joined"))
        return F.array(own, both)

    def two_grams(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))

    def carry(s: Column, *more: Column) -> Column:
        return F.struct(*[s[c].alias(c) for c in ("at", "place", "joined", "phrase", "rest", "two")], *more)

    def gram_sets(s: Column) -> Column:
        w = F.split(s["line"], " ")
        return F.struct(*[s[c].alias(c) for c in ("at", "place", "joined")], _any(s["line"], PHRASES).alias("phrase"), two_grams(F.split(s["rest"], " ")).alias("rest"), F.array_distinct(w).alias("one"), two_grams(w).alias("two"))

    def score(s: Column) -> Column:
        features = F.filter(F.concat(s["one"], s["two"]), lambda g: _any(g, STEMS + MARKS))
        sums = F.aggregate(features, bias, lambda acc, g: F.coalesce(F.zip_with(acc, F.try_element_at(weights, g), lambda a, b: a + b), acc))
        return carry(s, F.transform(sums, lambda z: z / model.temperature).alias("z"))

    def probabilities(s: Column) -> Column:
        top = F.array_max(s["z"])
        e = F.transform(s["z"], lambda z: F.exp(z - top))
        return carry(s, e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, b: a + b).alias("sum"), F.array_position(e, F.array_max(e)).cast("int").alias("best"))

    def judge(s: Column) -> Column:
        family = F.element_at(names, s["best"])
        share = lambda two: F.coalesce(F.array_max(F.transform(F.try_element_at(templates, family), lambda t: F.size(F.array_intersect(t, two)) / F.size(t))), F.lit(0.0))
        p = F.element_at(s["e"], s["best"]) / s["sum"]
        return F.struct(*[s[c].alias(c) for c in ("at", "place", "joined", "phrase")], family.alias("family"), p.alias("probability"), share(s["two"]).alias("similarity"), F.when(s["joined"], share(s["rest"])).otherwise(F.lit(-1.0)).alias("after"))

    made = F.filter(F.transform("plain", followed), lambda s: _any(F.concat_ws(" ", s["line"], s["rest"])))
    made = F.filter(F.flatten(F.transform(made, units)), lambda s: _any(s["line"]))
    for step in (gram_sets, score, probabilities, judge):
        made = F.transform(made, step)
    staged = staged.select("doc_id", made.alias("made"))
    sure = lambda s: (s["family"] != UNKNOWN) & (s["probability"] >= probability) & (s["similarity"] >= similarity)
    # A notice that runs over lines counts where it begins: the line adds to the
    # similarity of the words after it, and the line before is not such a one already.
    runs = F.filter("made", lambda s: s["joined"] & sure(s) & (s["similarity"] > s["after"]))
    alone = F.filter("made", lambda s: ~s["joined"] & sure(s))
    staged = staged.select("doc_id", "made", runs.alias("runs"), alone.alias("alone"))
    begin = F.filter("runs", lambda s: ~F.exists("alone", lambda o: o["place"] == s["place"]) & ~F.exists("runs", lambda o: (o["place"] == s["place"] - 1) & (o["family"] == s["family"])))
    staged = staged.select("doc_id", "made", "alone", begin.alias("begin"))
    out = lambda s: F.struct(s["at"].alias("paragraph"), s["family"].alias("family"), s["probability"].alias("probability"), s["similarity"].alias("similarity"), sure(s).alias("confirmed"))
    own = F.filter("made", lambda s: ~s["joined"] & (s["family"] != UNKNOWN) & ~(~sure(s) & F.exists("begin", lambda o: o["place"] == s["place"])))
    like = F.filter("made", lambda s: ~s["joined"] & ~sure(s) & (s["phrase"] | (s["family"] != UNKNOWN) & (s["probability"] >= probability) & (s["similarity"] >= LIKE)))
    return staged.select("doc_id", F.array_sort(F.transform(F.concat(own, F.col("begin")), out)).alias("findings"), F.transform(like, out).alias("like"))


def grams_two(text: str) -> list[str]:
    return [g for g in grams(text) if " " in g]


def report(df: DataFrame, **how) -> DataFrame:
    """A row for each document: how many paragraphs are confirmed, their families, and the
    most probable one; ``unknown`` and the first such paragraph where some are like a
    licence and none is confirmed."""
    found = paragraphs(df, **how).select("doc_id", F.filter("findings", lambda s: s["confirmed"]).alias("good"), F.try_element_at("like", F.lit(1)).alias("like"))
    best = F.array_max(F.transform("good", lambda s: F.struct(F.round(s["probability"], 6).alias("p"), (-s["paragraph"]).alias("at"), s["family"].alias("family"), F.round(s["similarity"], 6).alias("similarity"))))
    none = F.col("like").isNotNull()
    return found.select("doc_id", "like", F.size("good").cast("long").alias("n_paragraphs"), F.array_join(F.array_sort(F.array_distinct(F.transform("good", lambda s: s["family"]))), ",").alias("licenses"), best.alias("b")).select(
        "doc_id", "n_paragraphs", "licenses", F.coalesce("b.family", F.when(none, F.lit(UNKNOWN)), F.lit(NONE)).alias("license"), F.coalesce("b.p", F.round("like.probability", 6), F.lit(0.0)).alias("probability"),
        F.coalesce("b.similarity", F.round("like.similarity", 6), F.lit(0.0)).alias("similarity"), F.coalesce(-F.col("b.at"), "like.paragraph", F.lit(-1)).alias("paragraph")
    )
