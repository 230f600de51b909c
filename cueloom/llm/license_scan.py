"""Licence scan: a positional index of licence wording, entered by each file's rarest licence words.

Every template (a licence phrase or notice) is a word sequence with mandatory key phrases.  The index maps a word to its
postings (template, position).  Document frequencies of the indexed words are counted over the whole corpus; a template is
entered through the rarest word of its first key phrase.  For each file the licence words that it holds are looked up from the
highest IDF down, each occurrence fixes a relative start, the postings of the template's other words are intersected at that
start, and the mandatory key phrases are verified (the first exactly in place, later ones in order within `SLACK` words of
their place).  A match's score is the IDF-weighted share of template words that stand in place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import map_texts, read_table, text_bytes

#: (label, phrase) that the base columns count.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Further one-phrase templates (label, phrase).
PHRASES = (
    ("cc-by-sa", "cc by sa"), ("cc-by-nc", "cc by nc"), ("cc-by-nd", "cc by nd"), ("cc-by", "creative commons attribution"),
    ("cc0", "cc0 1 0"), ("cc0", "creative commons zero"), ("creative-commons", "creativecommons org licenses"),
    ("mit", "mit license"), ("apache-2.0", "apache license version 2 0"), ("apache-2.0", "apache license 2 0"),
    ("bsd", "bsd license"), ("isc", "isc license"), ("mpl-2.0", "mozilla public license"), ("epl", "eclipse public license"),
    ("lgpl", "lesser general public license"), ("agpl", "affero general public license"), ("spdx", "spdx license identifier"),
    ("public-domain", "released into the public domain"), ("copyright", "copyright c"),
)
#: Notices: (label, text, mandatory key phrases in order).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted", "deal in the software without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee is hereby granted")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     ("apache license version 2 0", "except in compliance with the license")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     ("redistribute it and or modify it", "free software foundation")),
)
SLACK = 12
#: Separators become blanks and A-Z lower case in one table pass; what is left between blanks is a word.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def templates(base=BASE, phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(label, words, ((key words, place), ...), is base) of each template."""
    found = []
    for label, phrase, own in [*((a, b, True) for a, b in base), *((a, b, False) for a, b in phrases)]:
        w = tuple(phrase.encode().split())
        found.append((label, w, ((w, 0),), own))
    for label, text, keys in notices:
        w = tuple(text.encode().split())
        placed = []
        for key in keys:
            k = tuple(key.encode().split())
            placed.append((k, next(i for i in range(len(w)) if w[i : i + len(k)] == k)))
        found.append((label, w, tuple(placed), False))
    return found


def word_frequencies(docs: DataFrame, vocabulary: frozenset, id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """Documents that hold each indexed word, over the whole table; the result has at most one row per indexed word."""

    def each():
        return lambda doc, text: (doc, sorted(vocabulary.intersection(words_of(text_bytes(text)))))

    held = map_texts(docs, each, "doc_id long, words array<binary>", id_col, text_col)
    rows = held.select(F.explode("words").alias("word")).groupBy("word").count().collect()
    return {bytes(r["word"]): r["count"] for r in rows}


def build_index(known: list[tuple], frequency: dict[bytes, int], n_docs: int):
    """idf per word, and anchors: word -> [(template, place in it)], the word being the rarest of the template's first key phrase."""
    idf = {w: math.log(1 + (n_docs + 1) / (1 + frequency.get(w, 0))) for t in known for w in t[1]}
    anchors: dict[bytes, list[tuple[int, int]]] = {}
    for t, (_, _, keys, _) in enumerate(known):
        key, place = keys[0]
        at = max(range(len(key)), key=lambda i: (idf[key[i]], -i))
        anchors.setdefault(key[at], []).append((t, place + at))
    return idf, anchors


def match(words: list[bytes], known: list[tuple], idf: dict, anchors: dict) -> list[tuple[int, int, float]]:
    """(template, start, score) of every verified match; the start may be negative where a notice is cut at the file's head."""
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in anchors:
            places.setdefault(w, []).append(i)
    found = []
    for w in sorted(places, key=lambda x: (-idf[x], x)):
        for t, q in anchors[w]:
            _, body, keys, _ = known[t]
            for p in places[w]:
                start = p - q
                key, place = keys[0]
                if start + place < 0 or tuple(words[start + place : start + place + len(key)]) != key:
                    continue
                at, whole = start + place + len(key), True
                for key, place in keys[1:]:
                    low, high = max(at, start + place - SLACK), start + place + SLACK
                    at = next((i + len(key) for i in range(low, high + 1) if tuple(words[i : i + len(key)]) == key), -1)
                    if at < 0:
                        whole = False
                        break
                if whole:
                    total = sum(idf[x] for x in body)
                    here = sum(idf[x] for i, x in enumerate(body) if 0 <= start + i < len(words) and words[start + i] == x)
                    found.append((t, start, here / total if total else 1.0))
    return found


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,start:long,n_words:int,score:double>>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per input row: counts, labels, best score and every match.

    Null and empty texts give 0 words, no labels (empty strings), null places and score 0.  Repeated rows give repeated rows,
    an empty table gives none, other columns are not read.  A base phrase's score is 1, since all its words must stand in place.
    """
    known = templates(base, phrases, notices)
    vocabulary = frozenset(w for t in known for w in t[1])
    frequency = word_frequencies(docs, vocabulary, id_col, text_col)
    idf, anchors = build_index(known, frequency, docs.count())

    def each():
        def row(doc, text):
            words = words_of(text_bytes(text))
            found = match(words, known, idf, anchors)
            own = [(t, s) for t, s, _ in found if known[t][3]]
            starts = [s for _, s in own]
            spans = sorted((s, known[t][0], len(known[t][1]), x) for t, s, x in found)
            return (
                doc, len(words), len(own), min(starts, default=None), max(starts, default=None), ",".join(sorted({known[t][0] for t, _ in own})),
                ",".join(sorted({known[t][0] for t, _, _ in found})), min(1.0, max((x for _, _, x in found), default=0.0)),
                [{"label": b, "start": a, "n_words": c, "score": d} for a, b, c, d in spans],
            )

        return row

    return map_texts(docs, each, SCHEMA, id_col, text_col)


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read_table(spark, folder, "documents")).drop("matches").withColumn("score", F.round("score", 6))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"


def op1_sql() -> str:
    """The same scan by brute force: every template at every place."""
    known = templates()
    vocabulary = _sql_list(sorted({w for t in known for w in t[1]}))
    wide, starts, scores = [], [], []
    for t, (_, body, keys, _) in enumerate(known):
        (key, place), rest = keys[0], keys[1:]
        at = f"list_filter(range(1, len(l) + 1), lambda i: l[i : i + {len(key) - 1}] = {_sql_list(key)}"
        for k, p in rest:  # notices have two key phrases
            at += f" AND len(list_filter(range(greatest(i + {len(key)}, i + {p - place - SLACK}), i + {p - place + SLACK + 1}), lambda j: l[j : j + {len(k) - 1}] = {_sql_list(k)})) > 0"
        starts.append(f"CASE WHEN contains(norm, ' {b' '.join(key).decode()} ') THEN list_transform({at}), lambda i: i - {place}) ELSE [] END AS s{t}")
        wide.append(f"list_transform({_sql_list(body)}, lambda x: ln(1 + (n + 1) / (1 + coalesce(element_at(df, x)[1], 0)))) AS f{t}")
        scores.append(f"list_max(list_transform(s{t}, lambda s: list_sum(list_transform(range(1, {len(body) + 1}), lambda i: CASE WHEN s + i - 1 >= 1 AND l[s + i - 1] = {_sql_list(body)}[i] THEN f{t}[i] ELSE 0 END)) / list_sum(f{t})))")
    base = [t for t, k in enumerate(known) if k[3]]
    every = " || ".join(f"s{t}" for t in base)
    named = lambda which: ", ".join(f"CASE WHEN len(s{t}) > 0 THEN '{known[t][0]}' END" for t in which)
    labels = lambda which: f"array_to_string(list_sort(list_distinct([{named(which)}])), ',')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS l FROM documents),
     c AS (SELECT x, count(*) AS k FROM (SELECT unnest(list_intersect(list_distinct(l), {vocabulary})) AS x FROM w) GROUP BY x),
     i AS (SELECT map_from_entries(coalesce((SELECT list((x, k)) FROM c), [])) AS df, (SELECT count(*) FROM w) AS n),
     f AS (SELECT {', '.join(wide)} FROM i),
     s AS (SELECT doc_id, l, {', '.join(starts)} FROM (SELECT *, ' ' || array_to_string(l, ' ') || ' ' AS norm FROM w))
SELECT doc_id, len(l) AS n_words, len({every}) AS n_base, list_min({every}) - 1 AS first_word, list_max({every}) - 1 AS last_word, {labels(base)} AS base_labels, {labels(range(len(known)))} AS labels,
       round(least(1.0, greatest(0.0, {', '.join(scores)})), 6)::DOUBLE AS score
FROM s, f"""
