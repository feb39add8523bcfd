import random

from granary.functions.scan import Broken, Meter, Report, Unfit, events, position, scan
from granary.policy import Limits


def singly(text, limits):
    """The report of ``scan``, each bracket by itself."""
    report = Report()
    report.root = {"{": "object", "[": "array"}.get(text.lstrip(" \n\r\t")[:1], "other")
    try:
        for _ in events(text, Meter(limits, report), report):
            pass
        report.valid = True
    except Unfit as e:
        report.reason = e.reason
        report.offset, report.line, report.column = position(text, e.at)
    except Broken as e:
        vars(report).update(e.found)
    return report


def test_runs_of_brackets():
    rng = random.Random(8)

    def value(depth):
        r = rng.random()
        if depth == 0 or r < 0.2:
            return rng.choice(["1", '"[["', "[]", "{}", "null"])
        n = rng.randrange(1, 6)
        return "[" * n + value(depth - 1) + "]" * n if r < 0.5 else "[" + ",".join(value(depth - 1) for _ in range(3)) + "]" if r < 0.8 else '{"a":' + value(depth - 1) + ',"a":2}'

    for _ in range(4000):
        text = value(4)
        if rng.random() < 0.5:
            i = rng.randrange(len(text) + 1)
            text = text[:i] + rng.choice(["[", "]", "[[", "]]", ",", "}", " ", ""]) + text[i + 1 :]
        limits = Limits(**{k: rng.randrange(1, 9) for k in ("depth", "nodes", "items") if rng.random() < 0.2})
        assert vars(scan(text, limits)) == vars(singly(text, limits)), text
    deep = "[" * 100_000 + "]" * 100_000
    report = Report()
    assert sum(1 for _ in events(deep, Meter(Limits(), report), report, runs=True)) < 10
    assert (report.nodes, report.depth, report.max_items) == (100_000, 100_000, 1)
    assert (scan(deep + "]").reason, scan(deep[:-1]).offset, scan(deep, Limits(depth=99_999)).observed) == ("trailing_characters", 199_999, 100_000)
