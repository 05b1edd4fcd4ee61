"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and
the sequence of their identifiers is matched against ordered rules: the first rule that fits at a
place names the licence and takes its identifiers. Rows are independent, so documents never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ._tables import read

# Known sentences as patterns over normalised text (lower case, words and numbers with single spaces).
SENTENCES = {
    "apache2_short": r"(this \w+ is )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?apache( software)? license( version)? (v )?2( 0)?",
    "apache2_grant": r"(licensed under the apache license version 2 0 the license )?you may not use this (file|work|software) except in compliance with the license",
    "apache2_copy": r"you may obtain a copy of the license at https?( www)? apache org licenses license 2 0( \w+)?",
    "apache2_asis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_short": r"(this \w+ is )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?(mit|expat)( license)?( mit)?",
    "mit_title": r"(the )?mit license( mit)?",
    "mit_grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*",
    "mit_notice": r"the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software",
    "mit_asis": r"the software is provided as is without warranty of any kind express or implied including.*",
    "bsd_short": r"(this \w+ is )?(licensed|released|distributed|available) under (the |a )?(terms of )?(the )?bsd( \d clause)?( style)?( license)?",
    "bsd_grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*",
    "bsd_endorse": r"(3 )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_asis": r"this software is provided by .* as is and any express or implied warranties.*",
    "gpl_short": r"(this \w+ is )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?gnu (general public license|gpl)( version)?( v)?( \d)?( or later)?|(licensed|released) under (the )?gpl( ?v?\d)?( or later)?",
    "gpl_grant": r"this (program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation.*",
    "lgpl_short": r"(this \w+ is )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu (lesser|library) general public license|(gnu )?lgpl)( version)?( ?v)?( \d( \d)?)?( or later)?",
    "agpl_short": r"(this \w+ is )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu affero general public license|(gnu )?agpl)( version)?( ?v)?( \d)?( or later)?",
    "mpl_short": r"(this \w+ is )?(licensed|released|distributed|available|subject) (under|to) (the )?(terms of )?(the )?mozilla public license( version| v)? ?2 0",
    "cc_by_nc_nd": r"(this \w+ is )?(licensed|released|available) under (a |the )?(creative commons |cc )(by nc nd|attribution noncommercial noderivatives)( \d 0)?( international)?( license)?",
    "cc_by_nc_sa": r"(this \w+ is )?(licensed|released|available) under (a |the )?(creative commons |cc )(by nc sa|attribution noncommercial sharealike)( \d 0)?( international)?( license)?",
    "cc_by_nc": r"(this \w+ is )?(licensed|released|available) under (a |the )?(creative commons |cc )(by nc|attribution noncommercial)( \d 0)?( international)?( license)?",
    "cc_by_sa": r"(this \w+ is )?(licensed|released|available) under (a |the )?(creative commons |cc )(by sa|attribution sharealike)( \d 0)?( international)?( license)?",
    "cc_by_nd": r"(this \w+ is )?(licensed|released|available) under (a |the )?(creative commons |cc )(by nd|attribution noderivatives)( \d 0)?( international)?( license)?",
    "cc_by": r"(this \w+ is )?(licensed|released|available) under (a |the )?(creative commons |cc )(by|attribution)( \d 0)?( international)?( license)?",
    "cc0": r"(this \w+ is )?(licensed|released|dedicated|available) (under|to) (the )?(cc0( 1 0)?|public domain)( license)?",
    "reserved": r"(copyright .* )?all rights reserved",
}
# Ordered rules, longest sequences first; a trailing ? marks a sentence that may be missing.
RULES = [
    ("MIT", "mit_title? mit_grant mit_notice? mit_asis?"),
    ("Apache-2.0", "apache2_short? apache2_grant apache2_copy? apache2_asis?"),
    ("BSD-3-Clause", "bsd_grant bsd_endorse bsd_asis?"),
    ("BSD-2-Clause", "bsd_grant bsd_asis?"),
    ("GPL", "gpl_grant"),
    ("Apache-2.0", "apache2_short"),
    ("MIT", "mit_short"),
    ("MIT", "mit_title"),
    ("BSD", "bsd_short"),
    ("AGPL", "agpl_short"),
    ("LGPL", "lgpl_short"),
    ("GPL", "gpl_short"),
    ("MPL-2.0", "mpl_short"),
    ("CC-BY-NC-ND", "cc_by_nc_nd"),
    ("CC-BY-NC-SA", "cc_by_nc_sa"),
    ("CC-BY-NC", "cc_by_nc"),
    ("CC-BY-SA", "cc_by_sa"),
    ("CC-BY-ND", "cc_by_nd"),
    ("CC-BY", "cc_by"),
    ("CC0-1.0", "cc0"),
    ("All-Rights-Reserved", "reserved"),
]
# In lower-case text; each known sentence holds one of these, and so does each licence-like one.
_HINT = re.compile(r"licen[sc]e|copyright|redistribution|permission|warrant|endorse|reserved|(?:released|distributed|available|dedicated|subject)[^a-z0-9]+(?:under|to)")
_END = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|\n[\x20\x09\x0D]*\n")
_NOT_WORD = re.compile(r"[^a-z0-9]+")
_KNOWN = [(name, re.compile(p)) for name, p in SENTENCES.items()]
_LICENCE_LIKE = re.compile(r"\b(licen[sc]e[ds]?|copyright)\b")
_MEMO: dict[str, str | None] = {}


def normalised(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


def sentence_id(plain: str) -> str | None:
    """The first known sentence that the whole normalised sentence is."""
    if plain not in _MEMO:
        if len(_MEMO) > 50_000:
            _MEMO.clear()
        _MEMO[plain] = next((name for name, p in _KNOWN if p.fullmatch(plain)), None)
    return _MEMO[plain]


def sentences(text: str) -> Iterator[str]:
    """Sentences in order; a line break inside one also ends it where a line alone is known."""
    for part in _END.split(text):
        lines = part.split("\n")
        if len(lines) > 1 and any(sentence_id(normalised(x)) for x in lines):
            yield from lines
        else:
            yield part


def _pattern(sequence: str) -> re.Pattern:
    return re.compile("".join(f"(?:{x[:-1]},)?" if x.endswith("?") else f"{x}," for x in sequence.split()))


_RULES = [(name, _pattern(sequence)) for name, sequence in RULES]


def scan(text: str | None) -> tuple[list[str], list[str], int]:
    """Sentence ids in order, licences in order, and licence-like sentences that are not known."""
    if not text or not _HINT.search(text.lower()):
        return [], [], 0
    ids, unknown = [], 0
    for plain in map(normalised, sentences(text)):
        name = sentence_id(plain)
        if name:
            ids.append(name)
        else:
            unknown += bool(_LICENCE_LIKE.search(plain))
    sequence, found = "".join(x + "," for x in ids), []
    while sequence:
        name, m = next(((n, m) for n, p in _RULES if (m := p.match(sequence))), (None, None))
        if name:
            found.append(name)
        sequence = sequence[m.end() :] if m and m.end() else sequence[sequence.index(",") + 1 :]
    return ids, found, unknown


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licences (both comma-joined, in order), n_unknown.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text has none; repeated
    rows each get their row; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [scan(t) for t in pdf["text"]]
            doc = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)
            yield pd.DataFrame({"doc_id": doc, "n_sentences": [len(x[0]) for x in found], "sentence_ids": [",".join(x[0]) for x in found], "licences": [",".join(x[1]) for x in found], "n_unknown": [x[2] for x in found]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_sentences long, sentence_ids string, licences string, n_unknown long")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))
