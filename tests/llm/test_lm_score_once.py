import numpy as np
from granary.llm import context_mixing as cm
from granary.llm.context_mixing import Lexicon, Model, Pool, Sizes, coded, count, count_spelled, count_words, new_counts, parse


def block(*texts):
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate(data), np.cumsum([0, *[len(d) for d in data]])


def test_spelled_segments_are_worked_on_once(monkeypatch):
    """Segments that many blocks have are spelled once; counts and costs are those of each block alone."""
    lexicon, sizes = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1), Sizes(15, 15)
    blocks = [parse(*block("some words here", f"own{i} words"), lexicon) for i in range(20)]
    apart, pooled = new_counts(lexicon, sizes), new_counts(lexicon, sizes)
    spelled = []
    for most in (1 << 21, 60):
        for c in (apart, pooled):
            for x in c:
                x[:] = 0
        pool = Pool(most)
        for p in blocks:
            count(p, lexicon, sizes, apart)
            count_words(p, lexicon, sizes, pooled)
            if (some := pool.add(p)) is not None:
                count_spelled(some, sizes, pooled)
        spelled.append(pool.close())
        count_spelled(spelled[-1], sizes, pooled)
        assert all((a == b).all() for a, b in zip(apart, pooled))
    # some, words (first in no text), here, and one for each block.
    assert len(spelled[0].names) == 3 + 20
    model, fresh = (Model(lexicon, sizes, [coded(c) for c in apart]) for _ in range(2))
    monkeypatch.setattr(cm, "KNOWN", 15)
    for p in blocks:
        fresh.known = fresh.known[0][:0], fresh.known[1][:0]
        assert (model.cost(p) == fresh.cost(p)).all() and len(model.known[0]) <= 15
