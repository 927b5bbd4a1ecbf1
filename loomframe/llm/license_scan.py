"""Licence texts by a positional index of licence words: look-up, relative positions, and mandatory phrases."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

from loomframe.llm.common import per_text

#: The phrases of the base rules and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, an excerpt of the licence or of its notice, and phrases without which it doesn't count.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("mit", "this project is licensed under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl-notice", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl-notice", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy", "hereby granted")),
    ("cc-notice", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-notice", "licensed under cc by 4 0", ("licensed under cc by",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0 1 0 universal", ("copyright and related",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("reserved-notice", "copyright all rights reserved no part of this publication may be reproduced without permission", ("all rights reserved", "reproduced")),
)

#: Words as the base rules take them: a-z (A-Z lower-cased), digits and whatever is not ASCII; the rest parts words.
_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Index:
    """Postings (template, position) of every template word, and the words' IDF over the templates."""

    def __init__(self, templates=TEMPLATES, base=BASE, share: float = 0.6, slack: int = 3):
        self.templates = [(label, words(text), [words(p) for p in must]) for label, text, must in templates]
        self.base = [(words(p), label) for p, label in base]
        self.share, self.slack = share, slack
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, ws, _) in enumerate(self.templates):
            for i, w in enumerate(ws):
                self.postings[w].append((t, i))
        n = len(self.templates)
        self.idf = {w: math.log(1 + n / len({t for t, _ in at})) for w, at in self.postings.items()}
        #: A word of each base phrase and template that must occur: texts without any of them hold no match.
        self.rare = {max(ws, key=lambda w: (self.idf.get(w, 9.0), w)) for ws, _ in self.base}
        self.rare |= {max(must[0], key=lambda w: (self.idf[w], w)) for _, _, must in self.templates}

    def places(self, at: dict[bytes, list[int]], ws: list[bytes], phrase: list[bytes]) -> list[int]:
        return [i for i in at.get(phrase[0], ()) if ws[i : i + len(phrase)] == phrase]

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        ws = words(text)
        if self.rare.isdisjoint(ws):
            return len(ws), 0, None, None, "", "", 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        firsts = {p[0] for p, _ in self.base}
        for i, w in enumerate(ws):
            if w in self.idf or w in firsts:
                at[w].append(i)
        starts, labels = [], set()
        for phrase, label in self.base:
            if found := self.places(at, ws, phrase):
                starts += found
                labels.add(label)
        more, best = self.matches(ws, at)
        score = max(best, 1.0 if labels else 0.0)
        ends = (min(starts), max(starts)) if starts else (None, None)
        return len(ws), len(starts), *ends, ",".join(sorted(labels)), ",".join(sorted(labels | more)), score

    def matches(self, ws: list[bytes], at: dict[bytes, list[int]]) -> tuple[set[str], float]:
        """Labels whose template lines up with the text, and the best share of a template's IDF that lines up.

        All licence words that the text holds vote for (template, start), for templates whose mandatory phrases the text
        holds and starts that have the first of them in reach; starts with votes of two words are verified word by word,
        with a slack for inserted words, and by the mandatory phrases near them.
        """
        near: dict[int, set[int]] = {}
        for t, (_, tw, must) in enumerate(self.templates):
            found = [self.places(at, ws, p) for p in must]
            if all(found):
                near[t] = {s for i in found[0] for s in range(i - len(tw) - self.slack, i + self.slack + 1)}
        votes: Counter[tuple[int, int]] = Counter()
        if near:
            for w in at:
                votes.update({(t, i - q) for t, q in self.postings.get(w, ()) if t in near for i in at[w] if i - q in near[t]})
        labels, best = set(), 0.0
        for (t, start), n in votes.items():
            label, tw, must = self.templates[t]
            if n < min(2, len(tw)):
                continue
            lo, hi = max(0, start - self.slack), start + len(tw) + self.slack
            here = ws[lo:hi]
            hit = sum(self.idf[w] for i, w in enumerate(tw) if w in ws[max(0, start + i - self.slack) : max(0, start + i + self.slack + 1)])
            share = hit / sum(self.idf[w] for w in tw)
            phrases = all(any(here[i : i + len(p)] == p for i in range(len(here) - len(p) + 1)) for p in must)
            if share >= self.share and phrases:
                labels.add(label)
                best = max(best, share)
        return labels, best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (0 to 1).

    Null and empty texts have no words. Repeated rows are scanned each; other columns are ignored. The index holds
    the templates only, a table of fixed size, and travels with the task.
    """
    found = index or Index()
    names = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    return per_text(docs, lambda: found.scan, names, id_col, text_col)
