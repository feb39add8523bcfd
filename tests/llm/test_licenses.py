import random
import re

from granary.llm.licenses import BASE, automaton, evaluate, find_licenses, op10_licenses, scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(label, i) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_places_match_brute_force():
    rng = random.Random(5)
    parts = "under the MIT license Apache License, Version 2.0 CC BY-NC 4.0 cc by é nc-cc x".split()
    search = automaton()
    for _ in range(5000):
        t = rng.choice(("", " ", ".")) + rng.choice((" ", "  ", ", ")).join(rng.choice(parts) for _ in range(rng.randrange(0, 20)))
        n, base, _, score = scan(t, search)
        assert (n, sorted(base)) == brute(t), t
        assert 0 <= score <= 1


def test_expressions():
    assert evaluate("MIT OR GPL-3.0-only").freedom == 1.0 and evaluate("MIT AND GPL-3.0-only").freedom == 0.4
    assert evaluate("(MIT AND GPL-2.0-only) OR Apache-2.0").labels == {"mit", "gpl-2", "apache-2"}
    assert evaluate("MIT AND GPL-2.0-only OR Apache-2.0").freedom == 1.0
    assert abs(evaluate("GPL-2.0-only WITH Classpath-exception-2.0").freedom - 0.5) < 1e-9
    assert evaluate("") is None and evaluate("AND") is None and evaluate("(MIT") is None
    assert evaluate("MIT and then").labels == {"mit"}
    assert scan("# SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode", automaton())[2] == {"mit", "apache-2"}


def test_identifiers():
    for text, labels, freedom in (("Zlib", {"zlib"}, 1.0), ("EPL-2.0", {"epl"}, 0.7), ("GPL-2.0+", {"gpl-2"}, 0.4), ("LGPL-2.1", {"lgpl"}, 0.6), ("LGPL-2.1+ OR Zlib", {"lgpl", "zlib"}, 1.0), ("Foo-9.1-only", {"foo-9.1"}, 0.0), ("LicenseRef-mine", {"licenseref-mine"}, 0.0), ("see", set(), 0.0)):
        assert (evaluate(text).labels, evaluate(text).freedom) == (labels, freedom), text


def test_long_expressions_are_read_to_the_end():
    text = "SPDX-License-Identifier: " + "MIT AND " * 100 + "GPL-3.0-only\n"
    _, _, labels, score = scan(text, automaton())
    assert labels == {"mit", "gpl-3"} and score == 0.4


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (2, "under the MIT license", 3.0), (2, "under the MIT license", 3.0)], "doc_id long, text string, score double")
    got = [(r.doc_id, r.n_words, r.labels, r.score) for r in find_licenses(df).collect()]
    assert got == [(1, 0, [], 0.0), (None, 0, [], 0.0), (2, 4, ["mit"], 1.0), (2, 4, ["mit"], 1.0)]
    assert find_licenses(df.limit(0)).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op10_licenses(spark, d).collect():
        n, places = brute(want[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(w for _, w in places), max(w for _, w in places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted({k for k, _ in places}))
