import numpy as np
import pyarrow as pa
from granary.llm import context_mixing as cm
from granary.llm.tokens import column_bytes


def test_bits_after_equal_contexts_are_worked_on_once():
    """Copies of texts add no work, bits at the beginning of several codes after one context come once, and counts are those bit by bit."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.3, 40) % 50) for _ in range(30)]
    data, at = column_bytes(pa.array(texts))
    starts, _ = cm.segments(data, at)
    hashes, n = np.unique(cm.word_hashes(data, starts, np.r_[starts[1:], len(data)]), return_counts=True)
    lexicon, sizes = cm.Lexicon(hashes[n > 2], n[n > 2], int(n[n <= 2].sum()), len(texts)), cm.Sizes(15, 15)
    p = cm.parse(data, at, lexicon)
    code, pool = lexicon.code, cm.Ways(1 << 30)
    for _ in range(20):
        assert pool.add(p) is None
    ways, times = pool.close()
    assert times.sum() == 20 * len(p.symbols) and len(ways) == len({(a, b) for a, b in zip(p.ways, p.symbols)})
    worked = sum(int(same.own.sum()) for _, same, _ in cm.word_bits(ways, lexicon, sizes))
    assert worked < 0.9 * code.lengths[p.symbols].sum()
    got = cm.new_counts(lexicon, sizes)
    cm.count_ways(ways, times, lexicon, sizes, got)
    want = cm.new_counts(lexicon, sizes)
    name = lambda s: int(cm._SPELLED if s == cm.ESCAPE else cm.mix(np.array([s + 9], np.uint64))[0])
    shift, whole = 64 - sizes.words, (1 << 64) - 1
    mixed = lambda x: int(cm.mix(np.array([x & whole], np.uint64))[0])
    one = two = int(cm._START)
    for s in p.symbols:
        keys = one * int(cm._K), mixed(one + two * int(cm._K)), mixed(two + 0x77)
        for w in range(code.first[s], code.first[s + 1]):
            node, bit = int(code.node[w]), int(code.bit[w])
            want[0][node * 2 + bit] += 20
            for j, key in enumerate(keys):
                want[j + 1][((key + mixed(node + 1) * int(cm._K)) & whole) >> shift << 1 | bit] += 20
        one, two = (int(cm._START),) * 2 if s == cm.END else (name(s), one)
    assert all((a == b).all() for a, b in zip(got, want))
