"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised (A-Z lowered, every run of other characters than letters and digits one space, so that
line feeds and the signs of comments before a line go) and cut at full stops and empty lines. Known licence
sentences are found as runs of whole words between two cuts, over as many lines as they take. The SQL
of ``oracle`` knows whole sentences on one line only, which is what the given tables have. The identifiers found, in text order, are matched against rules: a rule is an ordered list of
identifiers, which must occur in that order with anything between them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and their usual one-line notices.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-notice": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
    ),
    "apache-comply": ("you may not use this file except in compliance with the License",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "apache-as-is": (
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
        "ANY KIND, either express or implied",
    ),
    "mit-notice": ("Released under the MIT License", "Licensed under the MIT License"),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    "mit-keep": (
        "The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software",
    ),
    "gpl2-notice": (
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License, version 2",
    ),
    "gpl3-notice": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
    ),
    "gpl-redistribute": (
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE",
    ),
    "bsd-permit": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer",
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior "
        "written permission",
    ),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"),
    "reserved": ("All rights reserved",),
}


@dataclass(frozen=True)
class Rule:
    """``licence`` holds where ``sentences`` occur in order, unless one of ``unless`` holds."""

    licence: str
    sentences: tuple[str, ...]
    unless: tuple[str, ...] = ()


RULES: tuple[Rule, ...] = (
    Rule("Apache-2.0", ("apache-notice",)),
    Rule("Apache-2.0-full", ("apache-notice", "apache-comply", "apache-copy", "apache-as-is")),
    Rule("BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary"), ("BSD-3-Clause",)),
    Rule("BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("CC-BY-4.0", ("cc-by",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa",)),
    Rule("GPL-2.0", ("gpl2-notice",)),
    Rule("GPL-3.0", ("gpl3-notice",)),
    Rule("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty")),
    Rule("MIT", ("mit-notice",)),
    Rule("MIT-full", ("mit-grant", "mit-keep")),
    Rule("all-rights-reserved", ("reserved",)),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No sentence goes on after stops followed by white space or the text's end, or over a line without words.
SENTENCE_END = r"[.!?]+(\s+|$)|\n[^a-z0-9\n]*(?=\n)"
#: Comments that start with a word.
COMMENT_WORD = r"\n[ \t@]*(rem|dnl)(?=[ \t])"
#: The point of a decimal stays, as ~: version 2.1 is not version 2.
POINT = r"(?<=[0-9])\.(?=[0-9])"
NOT_WORD = r"[^a-z0-9~|]+"


def _normal(sentence: str) -> str:
    import re

    flat = " ".join(re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).split())
    return flat


def known_sentences(sentences: dict[str, tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    """Normalised sentence → identifier. Full stops inside a sentence are no ends there."""
    return {_normal(s): name for name, forms in sentences.items() for s in forms}


def known_runs(sentences: dict[str, tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    """As ``known_sentences``, with the points of decimals."""
    import re

    flat = lambda s: re.sub(NOT_WORD, " ", re.sub(POINT, "~", s.translate(str.maketrans(UPPER, LOWER)))).strip()
    return {flat(s): name for name, forms in sentences.items() for s in forms}


def _sentence_ids(text: Column, known: dict[str, str]) -> Column:
    flat = F.translate(text, UPPER + "|~", LOWER + "  ")
    for pattern, by in ((COMMENT_WORD, "\n"), (SENTENCE_END, "|"), (POINT, "~"), (NOT_WORD, " ")):
        flat = F.regexp_replace(flat, pattern, by)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # Of two forms that start together the longer one counts, and once.
    forms = "|".join(sorted(known, key=len, reverse=True))
    runs = F.regexp_extract_all(flat, F.lit(f"(?<![a-z0-9~])(?:{forms})(?![a-z0-9~])"), 0)
    return F.transform(runs, lambda s: F.try_element_at(table, s))


def scan_licences(
    df: DataFrame,
    text: str = "text",
    sentences: dict[str, tuple[str, ...]] = SENTENCES,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``df`` with ``sentence_ids`` (array, text order, repeats kept) and ``licences`` (array,
    in the order of ``rules``). Columns of those names are replaced. Null or empty text: two
    empty arrays. A text of any length is one row; nothing is shuffled.
    """
    known = known_runs(sentences)
    marked = F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(","))
    holds = {r.licence: marked.like("%" + "%".join(f",{s}," for s in r.sentences) + "%") for r in rules}
    named = [
        F.when(
            reduce(lambda a, b: a & ~holds[b], r.unless, holds[r.licence]), F.lit(r.licence)
        )
        for r in rules
    ]
    found = F.when(F.size("sentence_ids") > 0, F.array_compact(F.array(*named)))
    return df.withColumn(
        "sentence_ids",
        F.coalesce(_sentence_ids(F.col(text), known), F.array().cast("array<string>")),
    ).withColumn("licences", F.coalesce(found, F.array().cast("array<string>")))


def oracle(sentences=SENTENCES, rules=RULES) -> str:
    """The thin query in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences(sentences)
    pairs = f"MAP {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in known.items())}}}"
    holds = {
        r.licence: f"marked LIKE {quote('%' + '%'.join(f',{s},' for s in r.sentences) + '%')}"
        for r in rules
    }
    named = ", ".join(
        f"CASE WHEN {' AND NOT '.join([holds[r.licence], *(holds[u] for u in r.unless)])} "
        f"THEN {quote(r.licence)} END"
        for r in rules
    )
    return f"""
WITH flat AS (
  SELECT doc_id, regexp_replace(regexp_replace(
      translate(coalesce(text, ''), '{UPPER}|', '{LOWER} '), '\\n|[.!?]+(\\s+|$)', '|', 'g'),
      '[^a-z0-9|]+', ' ', 'g') AS flat FROM documents),
looked AS (
  SELECT doc_id, list_filter(list_transform(string_split(flat, '|'),
      lambda s: {pairs}[trim(s)]), lambda i: i IS NOT NULL) AS ids FROM flat),
marked AS (
  SELECT doc_id, ids, concat(',', array_to_string(ids, ',,'), ',') AS marked FROM looked)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences,
  coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter([{named}], lambda x: x IS NOT NULL), ','), '') AS licences
FROM marked"""
