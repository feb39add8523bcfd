"""Licences named in texts: one automaton finds tags and notices, a parser reads tag expressions.

The words of a text, with one space around each, are searched by an Aho-Corasick automaton for all
notice phrases at once.  After an SPDX identifier tag, a shunting-yard parser evaluates the expression
of ``and``, ``or`` and ``with``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

#: Base phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The method's own notices; how far each lets a text be used, from 0 (not at all) to 1 (freely).
NOTICES = {
    "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl-3",
    "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl", "permission is hereby granted free of charge": "mit", "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa", "cc by 4 0": "cc-by", "cc0": "cc0", "released into the public domain": "public-domain", "all rights reserved": "all-rights-reserved", "the unlicense": "unlicense", "isc license": "isc",
}
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6,
    "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}
#: Families of other licences, by the start of their identifiers, and how free they are.
FAMILIES = {
    "zlib": 1.0, "bsl": 1.0, "0bsd": 1.0, "wtfpl": 1.0, "postgresql": 1.0, "python": 1.0, "psf": 1.0, "x11": 1.0, "ncsa": 1.0, "openssl": 0.9, "ofl": 0.9, "artistic": 0.8, "ms-pl": 0.8,
    "epl": 0.7, "cddl": 0.7, "cpl": 0.7, "ms-rl": 0.6, "eupl": 0.5, "cecill": 0.4, "osl": 0.4, "gfdl": 0.4, "sspl": 0.2, "busl": 0.1,
}
#: Identifiers of the public SPDX list that are read in expressions, and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "isc": "isc", "unlicense": "unlicense", "cc0-1.0": "cc0", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc",
    "mpl-2.0": "mpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-2.0": "gpl-2", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-3.0": "gpl-3", "agpl-3.0-only": "agpl-3", "agpl-3.0-or-later": "agpl-3",
}
_SUFFIX = re.compile(r"(?:-only|-or-later|\+)$")
_NAMED = re.compile(r"(?:licenseref-|documentref-)[a-z0-9.-]+|[a-z0-9.-]*[0-9][a-z0-9.-]*")
_TAG = " spdx license identifier "
_EXPRESSION = re.compile(r"[ \t]*:[ \t]*([A-Za-z0-9.+() \t-]+)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Value:
    """What an expression allows: the labels in it, and the freedom of the whole."""

    labels: frozenset[str]
    freedom: float


def identified(low: str) -> Value:
    """What an identifier in lower case stands for; "+", "-only" and "-or-later" make no difference.

    One of a known family has the family's name as its label; any other that holds a digit or is a
    licence reference is its own label and counts as not free; other words have no label.
    """
    bare = _SUFFIX.sub("", low)
    label = IDENTIFIERS.get(low) or IDENTIFIERS.get(bare) or IDENTIFIERS.get(f"{bare}-only")
    if label:
        return Value(frozenset([label]), FREEDOM[label])
    family = next((f for f in FAMILIES if bare == f or bare.startswith(f"{f}-")), None)
    if family:
        return Value(frozenset([family]), FAMILIES[family])
    return Value(frozenset([bare]) if _NAMED.fullmatch(bare) else frozenset(), 0.0)


def evaluate(expression: str) -> Value | None:
    """The longest prefix of ``expression`` that is one, by the shunting-yard method; none if there is none.

    ``with`` binds an exception to a licence and frees it a little, ``and`` takes the stricter of two
    licences, ``or`` the freer.  Identifiers are read as ``identified`` says.
    """
    tokens, expect, depth, best = _TOKEN.findall(expression), True, 0, None
    for n, token in enumerate(tokens, 1):
        low = token.lower()
        if token == "(" and expect:
            depth += 1
        elif token == ")" and not expect and depth:
            depth -= 1
        elif low in _RANK and not expect:
            expect = True
        elif low not in _RANK and token not in "()" and expect:
            expect = False
        else:
            break
        if not expect and not depth:
            best = n
    if best is None:
        return None
    values: list[Value] = []
    operators: list[str] = []

    def apply() -> None:
        op, right, left = operators.pop(), values.pop(), values.pop()
        if op == "with":
            values.append(Value(left.labels, min(1.0, left.freedom + 0.1)))
        else:
            values.append(Value(left.labels | right.labels, (max if op == "or" else min)(left.freedom, right.freedom)))

    for token in tokens[:best]:
        low = token.lower()
        if token == "(":
            operators.append(token)
        elif token == ")":
            while operators[-1] != "(":
                apply()
            operators.pop()
        elif low in _RANK:
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[low]:
                apply()
            operators.append(low)
        else:
            values.append(identified(low))
    while operators:
        apply()
    return values[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        found.add_word(f" {phrase} ", (phrase in BASE, label, len(phrase)))
    found.add_word(_TAG, (False, "", len(_TAG) - 2))
    found.make_automaton()
    return found


def scan(text: str, search: ahocorasick.Automaton) -> tuple[int, list[tuple[str, int]], set[str], float]:
    """Number of words, (label, first word) of each base place, the method's labels, and the score.

    The score is the freedom of the strictest notice or expression found, 0 where there is none.
    """
    low = text.translate(_LOWER)
    words = WORD.findall(low)
    spaced = f" {' '.join(words)} "
    base, labels, free, tags = [], set(), [], 0
    at, count = 0, 0
    for end, (is_base, label, size) in search.iter(spaced):
        start = end - size
        if start >= at:
            count, at = count + spaced.count(" ", at, start), start
            first = count
        else:
            first = spaced.count(" ", 0, start)
        # Spaces before the phrase's first letter, less the one at the front.
        if is_base:
            base.append((label, first - 1))
        if label:
            labels.add(label)
            free.append(FREEDOM[label])
        else:
            tags += 1
    if tags:
        for m in re.finditer(r"spdx-license-identifier", low):
            if (m2 := _EXPRESSION.match(text, m.end())) and (value := evaluate(m2[1])):
                labels |= value.labels
                free.append(value.freedom)
    return len(words), base, labels, min(free, default=0.0)


RESULT = "n_words bigint, places array<struct<label:string,word:bigint>>, labels array<string>, score double"


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base ``places``, all ``labels`` (sorted) and ``score``.

    ``score`` is the freedom, 0 to 1, of the strictest licence found; 0 with ``labels`` empty means
    that nothing was found.  A null or empty text has no words; repeated rows and null ids stay;
    columns other than doc_id and text are ignored; an empty table gives an empty one.  Whole texts
    are read, where they are, without a shuffle.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [scan(x.as_py() or "", found) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([[{"label": k, "word": w} for k, w in r[1]] for r in rows], place),
                        pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                        pa.array([r[3] for r in rows], pa.float64()),
                    ],
                    ["doc_id", "n_words", "places", "labels", "score"],
                )

    df = docs.select("doc_id", "text")
    return df.mapInArrow(search, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


QUERIES = {"op10_licenses": op10_licenses}
