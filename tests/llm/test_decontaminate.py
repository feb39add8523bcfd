import random

from granary.llm.decontaminate import automaton, clean_of, distance, find_items, normalise, pieces, prepare, search


def brute(item, text):
    """Edit distance to the best part of the text, by the full table."""
    col = list(range(len(item.text) + 1))
    best = col[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item.text, 1):
            new.append(min(col[i - 1] + (p != c), col[i] + 1, new[i - 1] + 1))
        col = new
        best = min(best, col[-1])
    return best


def within(item, text):
    """The distance if it is within the budget; an item without a budget must stand as whole words."""
    d = brute(item, text)
    return d if d <= item.budget and (item.budget or f" {item.text} " in f" {text} ") else None


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        i = rng.randrange(len(t))
        rng.choice((lambda: t.pop(i), lambda: t.insert(i, "z"), lambda: t.__setitem__(i, "q")))()
    return "".join(t)


def test_search_matches_the_full_table():
    rng = random.Random(2)
    items = [prepare(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 90))), 0.1) for i in range(12)]
    assert all("".join(p for _, p in pieces(x)) == x.text and len(pieces(x)) == x.budget + 1 for x in items)
    found = automaton(items)
    for _ in range(300):
        parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(3)):
            parts += [edited(rng, rng.choice(items).text, rng.randrange(0, 9)), "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 40)))]
        text = "".join(parts)
        want = {i: d for i, x in enumerate(items) if (d := brute(x, normalise(text))) <= x.budget}
        assert search(text, items, found) == want
        assert all(distance(x, normalise(text)) == brute(x, normalise(text)) for x in items[:3])


def test_short_items_are_whole_words():
    items = [prepare(1, "yes"), prepare(2, "A"), prepare(3, "Yes, no")]
    for text, want in (("the eyes have it", {}), ("Yes!", {0: 0}), ("say yes, no, or a", {0: 0, 1: 0, 2: 0}), ("yes not", {0: 0}), ("eyes no a", {1: 0})):
        assert search(text, items, automaton(items)) == want, text
        assert want == {i: d for i, x in enumerate(items) if (d := within(x, normalise(text))) is not None}


def test_rows(spark):
    item = "What is the capital of France? Choose the best answer from the list."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "!!"), (None, "another item that is long enough to be found")], "item_id long, text string")
    noisy = "intro " + item.upper().replace("CAPITAL", "CAPITOL").replace(" ", "  ") + " outro"
    rows = [(1, None, [0]), (2, "", [0]), (None, noisy, [1]), (4, "nothing here", [2]), (4, "nothing here", [2]), (5, "x " * 100_000 + item, [3]), (6, "ANOTHER item that is long enough to be found", [4])]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_hits array<int>")
    got = [[tuple(h) for h in r.item_hits] for r in find_items(df, bench).collect()]
    assert got == [[], [], [(1, 1)], [], [], [(1, 0)], [(None, 0)]]
    assert [[tuple(h) for h in r.item_hits] for r in find_items(df, bench, block=1).collect()] == got
    kept = clean_of(df, bench)
    assert kept.columns == df.columns and sorted(kept.collect(), key=str) == sorted((r for r in df.collect() if r.doc_id in (1, 2, 4)), key=str)
    assert clean_of(df, bench.limit(0)).count() == 7 and find_items(df.limit(0), bench).collect() == []


def test_query(spark):
    from granary.llm.decontaminate import op8_decontaminate

    d = "/root/testdata/sf0.001"
    items = [prepare(*r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r.doc_id: normalise(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect() if len(r.text) < 1500}
    got = {r.doc_id: r for r in op8_decontaminate(spark, d).collect()}
    for i, t in docs.items():
        want = [x.item_id for x in items if distance(x, t) <= x.budget and (x.budget or f" {x.text} " in f" {t} ")]
        assert got[i].item_ids == sorted(want) and got[i].contaminated == bool(want)
    assert any(r.contaminated for r in got.values())
