"""License texts by an exact set-similarity join, and license phrases.

A text block (any window of twice the template's words, over line breaks) matches a template when it holds at
least `containment` of the template's distinct words; of overlapping windows the fullest counts. Words are ordered by their document frequency in the whole corpus, rarest first. A template needs
c = ceil(containment * size) of its words, so a match holds one of its size - c + 1 rarest (prefix filter);
a block of fewer than c distinct words can't match (length filter); and a shared prefix word at place i of
the template leaves at most size - i shared words (positional filter). The survivors are counted exactly, so
every match is found. The filters see all words of a document, the windows only the templates left. Blocks are never compared with each other, and the templates are a parameter of
stated size (they are fixed here), so the join needs no shuffle but for the frequencies of template words.

Defined cases: a null or empty text has no words, no labels and the score 0; repeated rows are judged each;
a block's line is that of its first word; extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import ALNUM_LOWER, alnum_words, map_rows, read_table

CONTAINMENT = 0.8
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Well-known license notices, by the label of a block that holds them.
TEMPLATES = {
    "notice:apache-2.0": "licensed under the apache license version 2.0",
    "notice:mit": "released under the mit license",
    "notice:mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "notice:bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "notice:gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "notice:gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "notice:lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "notice:mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "notice:cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "notice:cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "notice:cc-by-sa-4.0": "licensed under cc by sa 4.0",
    "notice:cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "notice:unlicense": "this is free and unencumbered software released into the public domain",
    "notice:reserved": "all rights reserved",
}
FOUND = "n_words bigint, phrases array<struct<label:string,word:bigint,n_words:bigint>>, blocks array<struct<label:string,line:bigint,containment:double>>"


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str, int]]:
    """(word, label, words) of each place where a phrase's words stand consecutively."""
    text = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        at = text.find(wanted)
        while at >= 0:
            found.append((text.count(b" ", 0, at), label, phrase.count(" ") + 1))
            at = text.find(wanted, at + 1)
    return sorted(found)


class TemplateIndex:
    """Prefix index over templates whose words are in a global order, rarest first."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], containment: float):
        sets = {label: set(alnum_words(text.encode())) for label, text in templates.items()}
        ordered = sorted(set().union(*sets.values()), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(ordered)}
        self.sets = {label: {self.rank[w] for w in words} for label, words in sets.items()}
        self.need = {label: max(1, math.ceil(containment * len(words) - 1e-9)) for label, words in sets.items()}
        self.width = {label: 2 * len(alnum_words(text.encode())) for label, text in templates.items()}
        #: For a prefix word: the templates, and how many of a template's words are not rarer than it.
        self.prefix: dict[int, list[tuple[str, int]]] = {}
        for label, words in self.sets.items():
            for place, word in enumerate(sorted(words)[: len(words) - self.need[label] + 1]):
                self.prefix.setdefault(word, []).append((label, len(words) - place))
        self.opening = {w for w, k in self.rank.items() if k in self.prefix}
        self.shortest = min(self.need.values(), default=1)

    def matches(self, block: set[bytes]) -> list[tuple[str, float]]:
        """(template, containment) of each template that the block holds."""
        known = sorted(self.rank[w] for w in block if w in self.rank)
        if len(known) < self.shortest:
            return []
        # A template is met first at its rarest shared word; what both sides have from there on bounds the overlap.
        met: dict[str, bool] = {}
        for place, word in enumerate(known):
            for label, left in self.prefix.get(word, ()):
                if label not in met:
                    met[label] = self.need[label] <= min(left, len(known) - place)
        words = set(known)
        shared = ((label, len(self.sets[label] & words)) for label in sorted(met) if met[label])
        return [(label, n / len(self.sets[label])) for label, n in shared if n >= self.need[label]]


    def passages(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(template, place of the first word, containment) of each window that holds a template, in order of place."""
        found = []
        labels = self.matches(set(words))
        known = [(k, self.rank[w]) for k, w in enumerate(words) if w in self.rank] if labels else []
        for label, _ in labels:
            size, at = len(self.sets[label]), [x for x in known if x[1] in self.sets[label]]
            held: Counter = Counter()
            first, best = 0, (0, 0, 0)  # words, first place, last place
            for place, word in at:
                held[word] += 1
                while at[first][0] <= place - self.width[label] or held[at[first][1]] > 1:
                    held[at[first][1]] -= 1
                    held += Counter()
                    first += 1
                if best[0] and at[first][0] > best[2]:
                    found.append((label, best[1], best[0] / size))
                    best = (0, 0, 0)
                if len(held) >= self.need[label] and len(held) > best[0]:
                    best = (len(held), at[first][0], place)
            if best[0]:
                found.append((label, best[1], best[0] / size))
        return sorted(found, key=lambda x: (x[1], x[0]))


def word_frequencies(docs: DataFrame, text_col: str, words: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each of a bounded list of words."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        total: Counter = Counter()
        for part in slices:
            for text in part["text"]:
                total.update(words.intersection(alnum_words(text)))
        yield {"word": [w.decode() for w in total], "n": list(total.values())}

    counted = map_rows(docs, {"text": F.col(text_col).cast("string")}, "word string, n bigint", rows)
    return {w.encode(): n for w, n in map(tuple, counted.groupBy("word").agg(F.sum("n")).collect())}


def find_licenses(
    docs: DataFrame,
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row of docs (or its columns carry) as _row, with its phrases and matching blocks (see FOUND)."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    vocabulary = {w for t in templates.values() for w in alnum_words(t.encode())}
    index = TemplateIndex(templates, word_frequencies(docs, text_col, vocabulary), containment)

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in slices:
            out: dict[str, list] = {"n_words": [], "phrases": [], "blocks": []}
            for text in part["text"]:
                words = alnum_words(text)
                places = phrase_places(words, phrases) if words else []
                blocks = []
                if not index.opening.isdisjoint(words):
                    passages = index.passages(words)
                    lines = [n for n, line in enumerate(text.translate(_LINES).split(b"\n")) for _ in line.split()] if passages else []
                    blocks = [dict(label=label, line=lines[at], containment=c) for label, at, c in passages]
                out["n_words"].append(len(words))
                out["phrases"].append([dict(label=label, word=at, n_words=n) for at, label, n in places])
                out["blocks"].append(blocks)
            yield out

    return map_rows(docs, {"text": F.col(text_col).cast("string")}, FOUND, rows, keep_row=True, carry=carry)


#: As ALNUM_LOWER, but newlines stay.
_LINES = bytes(10 if b == 10 else x for b, x in enumerate(ALNUM_LOWER))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    starts = F.transform("phrases", lambda p: p["word"])
    base, added = F.transform("phrases", lambda p: p["label"]), F.transform("blocks", lambda b: b["label"])
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_words",
        F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, added)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"),
    )
