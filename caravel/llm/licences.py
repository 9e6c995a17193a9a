"""Licence scans by a positional index of rare words.

The index holds the words of licence templates with their places. Of each file only words
that some template has are kept, with their places. For each template the file's rarest of
these by their document frequency in the corpus are looked up; a place in the file less the
place in the template is where the template would begin, and where the looked-up words
agree on one beginning, the template stands. Its label counts if also all of its mandatory
phrases stand in the file, word after word.

Texts are read once, by DataFrame functions alone; what grows with them are rows of one
file each. The index, the frequencies of its words and the phrases are bounded by the
templates and are literals of the plan.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.shared import shared_table


class Template(NamedTuple):
    label: str
    text: str
    #: Phrases that must stand in a file beside the looked-up words.
    mandatory: tuple[str, ...]


#: Notices and opening sentences of public licences.
TEMPLATES = [
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template(
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
        ("without warranties or conditions of any kind",),
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template(
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        ("gnu affero general public license",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("attribution 4 0 international",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0 international",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0 international",)),
]
#: Phrases whose every place counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of a template that are looked up in a file, and the share of the weight of the
#: template's own rarest that must agree on a place.
LOOKED_UP, SHARE = 8, 0.6
#: What a word is, before A-Z become a-z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """Of templates and phrases, which are ASCII."""
    return re.findall("[0-9a-z]+", text.lower())


class Index:
    """The templates' words: where each first stands in each template, and the phrases."""

    def __init__(self, templates: list[Template], base: dict[str, str]):
        self.labels = [t.label for t in templates]
        self.first = [{} for _ in templates]
        for first, template in zip(self.first, templates):
            for at, word in enumerate(words_of(template.text)):
                first.setdefault(word, at)
        self.mandatory = [[words_of(p) for p in t.mandatory] for t in templates]
        self.base = [{"label": label, "words": words_of(p)} for p, label in base.items()]
        self.words = sorted({w for f in self.first for w in f} | {w for m in self.mandatory for p in m for w in p} | {w for b in self.base for w in b["words"]})


def licence_words(docs: DataFrame, index: Index) -> DataFrame:
    """row, doc_id, n_words, and seen: an array of (pos, word) of the words in the index, for
    each row of `docs` (doc_id, text). Written, as rows get their numbers here.
    """
    words = docs.select("doc_id", F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    # a word of other characters than ASCII may become one of the index by lower()
    plain = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), plain(w).alias("word")))
    seen = F.filter(placed, lambda x: x["word"].isin(index.words))
    rows = words.select("doc_id", F.size("words").cast("bigint").alias("n_words"), seen.alias("seen"))
    return shared_table(rows.withColumn("row", F.monotonically_increasing_id()), "licence-words")


def frequencies(seen: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and how many have each word: one row for each word of the index at most."""
    total = seen.count()
    each = seen.select(F.explode(F.array_distinct(F.transform("seen", lambda x: x["word"]))).alias("word")).groupBy("word").count()
    return total, {r.word: r["count"] for r in each.collect()}


def weight(total: int, n: int) -> int:
    """A word's inverse document frequency in whole bits, at least 1."""
    return ((total + 1) // (n + 1)).bit_length()


def literal(value) -> str:
    """Of words, whole numbers, lists, and dictionaries with words as keys."""
    if isinstance(value, dict):
        return "map({})".format(", ".join(f"'{k}', {literal(v)}" for k, v in value.items()))
    if isinstance(value, list):
        return "array({})".format(", ".join(map(literal, value)))
    return f"'{value}'" if isinstance(value, str) else str(value)


def structs(rows: list[dict]) -> Column:
    """A literal array of structs; one text to parse, however long."""
    named = ("named_struct({})".format(", ".join(f"'{k}', {literal(v)}" for k, v in row.items())) for row in rows)
    return F.expr("array({})".format(", ".join(named)))


def places(word: Column) -> Column:
    """Where a word stands in a row."""
    return F.transform(F.filter("seen", lambda x: x["word"] == word), lambda x: x["pos"])


def phrase_places(phrase: Column) -> Column:
    """Where the words of `phrase` (an array) stand one after another, in any order; empty
    without looking if the row lacks one.
    """
    begins = F.transform(phrase, lambda word, i: F.transform(places(word), lambda at: at - i))
    both = F.aggregate(begins, begins[0], lambda one, other: F.array_intersect(one, other))
    return F.when(F.size(F.array_except(phrase, "words")) == 0, both).otherwise(F.array().cast("array<int>"))


def template_votes(seen: DataFrame, index: Index, total: int, found: dict[str, int], looked_up: int, share: float) -> DataFrame:
    """row, label, coverage: the templates that stand in a row with all mandatory phrases."""
    rows = []
    for label, first, mandatory in zip(index.labels, index.first, index.mandatory):
        ranked = sorted(first, key=lambda w: (found.get(w, 0), w))
        weights = {w: weight(total, found.get(w, 0)) for w in ranked}
        rows.append({"t": len(rows), "label": label, "whole": sum(weights[w] for w in ranked[:looked_up]), "ranked": ranked, "weights": weights, "spots": first, "mandatory": mandatory})
    rarest = lambda t: F.slice(F.array_intersect(t["ranked"], F.col("words")), 1, looked_up)
    enough = lambda t: F.aggregate(rarest(t), F.lit(0), lambda n, w: n + F.element_at(t["weights"], w)) >= share * t["whole"]
    phrased = lambda t: F.forall(t["mandatory"], lambda phrase: F.size(phrase_places(phrase)) > 0)
    tried = seen.select("row", "seen", "words", F.explode(F.filter(structs(rows), lambda t: enough(t) & phrased(t))).alias("c"))
    c = F.col("c")
    begins = lambda w: F.transform(places(w), lambda at: F.struct((at - F.element_at(c["spots"], w)).alias("begin"), F.element_at(c["weights"], w).alias("weight")))
    votes = tried.select("row", "c.t", "c.label", "c.whole", F.explode(F.flatten(F.transform(rarest(c), begins))).alias("v"))
    agreed = votes.groupBy("row", "t", "label", "whole", "v.begin").agg(F.sum("v.weight").alias("agreed")).filter(F.col("agreed") >= share * F.col("whole"))
    return agreed.groupBy("row", "label").agg(F.max(F.col("agreed") / F.col("whole")).alias("coverage"))


def licence_scan(docs: DataFrame, templates: list[Template] = TEMPLATES, base: dict[str, str] = BASE, looked_up: int = LOOKED_UP, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row
    of `docs` (doc_id, text).

    n_base counts the places of all phrases of `base`, first_word and last_word are the
    smallest and largest of them (null if none), base_labels their labels; labels holds
    these and those of the templates that stand in the text, each once, in order. score is
    1 with a place of a phrase, else the largest share of a template's weight that agrees,
    0 if no template stands there. A template's words count at their first place in it;
    words are weighted by their frequency in all of `docs`.

    Null and empty texts have no words. Repeated rows and null doc_ids are rows of their
    own; other columns are not read; no rows give none.
    """
    index = Index(templates, base)
    seen = licence_words(docs, index)
    total, found = frequencies(seen)
    named = seen.withColumn("words", F.array_distinct(F.transform("seen", lambda x: x["word"])))
    standing = F.transform(structs(index.base), lambda b: F.struct(b["label"].alias("label"), phrase_places(b["words"]).alias("at")))
    standing = named.select("row", "doc_id", "n_words", F.filter(standing, lambda b: F.size(b["at"]) > 0).alias("base"))
    labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    based = standing.select("row", "doc_id", "n_words", F.flatten(F.transform("base", lambda b: b["at"])).alias("at"), labels.alias("base_labels"))
    votes = template_votes(named, index, total, found, looked_up, share)
    # a row has one vote for each label at most: bounded by the templates
    added = votes.groupBy(F.col("row").alias("voted")).agg(F.collect_set("label").alias("added"), F.max("coverage").alias("coverage"))
    met = based.join(added, based["row"] == added["voted"], "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("added", F.array().cast("array<string>"))))
    return met.select(
        "doc_id",
        "n_words",
        F.size("at").cast("bigint").alias("n_base"),
        F.array_min("at").cast("bigint").alias("first_word"),
        F.array_max("at").cast("bigint").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
