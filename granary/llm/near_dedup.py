"""Near duplicates: BagMinHash signatures of word shingles, bands, and exact multiset overlap.

Documents whose word sequences are equal are first put together, so that everything after works on
different texts.  Texts that agree in a band meet in a bucket.  A bucket doesn't emit all its pairs: texts
gather around leaders, and links around them are verified first, by the shingle multisets of the whole
texts.  Texts of large buckets that these links leave apart are then compared block against block, each with
each, and only links that join two classes come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.bagminhash import bags, band_keys, short, signatures, weighted_jaccard
from granary.llm.common import attach, checkpoint, sized, table
from granary.llm.graph import components
from granary.llm.tokens import column_bytes, firsts, lowered, mix, shingles, word_hashes, words

#: Words in a shingle, and the least similarity of near duplicates.
WIDTH, LEAST = 5, 0.8
#: Two texts of similarity 0.8 share no band of 25 with a probability of 5e-5.
BANDS, ROWS = 25, 5
#: Estimates scatter by 0.036 around 0.8; pairs estimated lower than this are not verified (over three deviations).
MAYBE = 0.68
#: In buckets of up to ALL_PAIRS texts every pair is weighed.  A larger one is worked on in parts of PART texts,
#: and the leaders of its parts meet again.
ALL_PAIRS, PART = 48, 2048
#: A text this near to its leader by estimate needs no other link within its gathering; others get PARTNERS more.
SURE, PARTNERS = 0.87, 10
#: Texts of one large bucket that are still apart are compared each with each, in cells of two blocks of about so many.
BLOCK = 512
#: Texts are worked on in slices of about so many bytes.
_SLICE = 4 << 20


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about _SLICE bytes of text, one row at least."""
    _, at = column_bytes(column)
    i = 0
    while i < len(column):
        k = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE)) - 1)
        yield i, min(k, len(column))
        i = k


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = column_bytes(column)
    starts, ends, counts = words(data, at)
    return word_hashes(lowered(data), starts, ends), counts


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    begin = firsts(counts)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(begin, counts).astype(np.uint64)
    out = []
    for seed in (0x1234567, 0x89ABCDEF0):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes * np.uint64(2 * seed + 1) + mix(place + np.uint64(seed))), out=sums[1:])
        out.append(mix(sums[begin + counts] - sums[begin] + counts.astype(np.uint64)))
    return tuple(out)


def sign(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, node and twin (hashes of its words), sig (a byte a register) and bands; both null for texts without words."""
    source = docs.select("doc_id", "text")
    registers = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k in _slices(batch.column(1)):
                part = batch.slice(i, k - i)
                hashes, counts = _hashed(part.column(1))
                node, twin = fingerprints(hashes, counts)
                times = signatures(*bags(*shingles(hashes, counts, WIDTH), len(counts)), len(counts), registers)
                empty = counts == 0
                keys = band_keys(times, BANDS, ROWS).view(np.int64)
                digest = short(times)
                sigs = pa.array([None if e else d.tobytes() for e, d in zip(empty, digest)], pa.binary())
                lists = pa.array([None if e else x for e, x in zip(empty, keys)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node.view(np.int64)), pa.array(twin.view(np.int64)), sigs, lists], ["doc_id", "node", "twin", "sig", "bands"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, node long, twin long, sig binary, bands array<long>")


def _agree(sigs: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of each to each other, from one-byte registers and without the agreements that are chance."""
    n, registers = sigs.shape
    same = np.empty((n, len(others)), np.float32)
    for i in range(0, n, 32):
        same[i : i + 32] = (sigs[i : i + 32, None, :] == others[None, :, :]).sum(axis=2)
    return (same / registers - 1 / 256) / (1 - 1 / 256)


def links_of(sigs: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Pairs (i < j) of members of one bucket's part to verify, and its leaders.

    Up to ALL_PAIRS members: every pair that may be similar, and every member leads.  Else the member with
    most near ones leads first and gathers all that may be similar to it; so on with the rest.  Every member
    is paired with all leaders that it may be similar to, with the PARTNERS most similar members of other
    gatherings, and, unless it is surely similar to its leader, with the PARTNERS most similar of all.
    """
    n, like = len(sigs), _agree(sigs, sigs)
    np.fill_diagonal(like, -1)
    maybe = like >= MAYBE
    if n <= ALL_PAIRS:
        return np.argwhere(np.triu(maybe)), list(range(n))
    own, leaders = np.full(n, -1), []
    degree = (like >= LEAST).sum(axis=1)
    pairs = []
    while (free := np.flatnonzero(own < 0)).size:
        lead = int(free[degree[free].argmax()])
        joins = np.flatnonzero(maybe[lead] & (own < 0))
        own[joins] = own[lead] = len(leaders)
        leaders.append(lead)
        degree -= (like[:, joins] >= LEAST).sum(axis=1)
        near = np.flatnonzero(maybe[lead])
        pairs.append(np.stack([np.full(len(near), lead), near], axis=1))
    unsure = like[np.arange(n), np.array(leaders)[own]] < SURE
    for asked, among in ((np.arange(n), own[:, None] != own[None, :]), (np.flatnonzero(unsure), np.ones((n, n), bool))):
        open_ = np.where(maybe[asked] & among[asked], like[asked], -1)
        best = np.argsort(-open_, axis=1, kind="stable")[:, :PARTNERS]
        x, k = np.nonzero(np.take_along_axis(open_, best, axis=1) > 0)
        pairs.append(np.stack([asked[x], best[x, k]], axis=1))
    return np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0), leaders


def buckets(texts: DataFrame) -> DataFrame:
    """(key, node, n): the bands that several texts share; ``texts`` has node, sig and bands, a row for each node."""
    keyed = texts.select("node", F.explode("bands").alias("key"))
    # Most bands hold one text; only the others are looked at.
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return checkpoint(keyed.join(full, "key"))


def candidates(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes to verify; ``shared`` is what ``buckets`` says of ``texts``.

    A bucket of more than PART texts is dealt out in parts; their leaders meet in the second round, and if
    they still are more than one part, each part of leaders meets each other part in the third.  Pairs of
    texts that only others in large buckets tell apart are left to ``missed``.
    """
    rows = shared.join(texts.select("node", "sig"), "node")
    out = None
    for last in (False, False, True):
        n_parts = F.ceil(F.col("n") / PART).cast("int")
        parts = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(last)), n_parts).cast("int"))
        if last:
            other = F.explode(F.sequence(F.lit(0), n_parts - 1))
            parts = parts.withColumn("_other", other).withColumn("part", F.least("part", "_other") * n_parts + F.greatest("part", "_other"))
        dealt = parts.select("key", "part", "node", "n", "sig").repartition("key", "part").sortWithinPartitions("key", "part", "node")
        found = checkpoint(dealt.mapInArrow(_meet, "key long, a long, b long, sig binary"))
        pairs = found.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = pairs if out is None else out.unionByName(pairs)
        leaders = found.filter("sig is not null").select("key", F.col("a").alias("node"), "sig")
        if last or leaders.limit(1).count() == 0:
            break
        again = leaders.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = leaders.join(again, "key")
    return out.distinct()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket's part stand together; a part may go on in the next batch."""
    held: tuple | None = None
    names = ["key", "a", "b", "sig"]

    def close(key: int, size: int, nodes: np.ndarray, sigs: np.ndarray, out: list) -> None:
        p, leaders = links_of(sigs)
        if len(p):
            out.append((np.full(len(p), key), nodes[p[:, 0]], nodes[p[:, 1]], None))
        if size > PART:
            out.append((np.full(len(leaders), key), nodes[leaders], None, [sigs[i].tobytes() for i in leaders]))

    def batch_of(out: list) -> Iterator[pa.RecordBatch]:
        for key, a, b, sig in out:
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64()), pa.array(sig, pa.binary()) if sig is not None else pa.nulls(len(a), pa.binary())], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, node, size = (batch.column(i).to_numpy() for i in range(4))
        sigs = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        out: list = []
        for i, k in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            now = (int(key[i]), int(part[i]), int(size[i]), node[i:k], sigs[i:k])
            if held is not None and held[:2] == now[:2]:
                held = (*held[:3], np.r_[held[3], now[3]], np.r_[held[4], now[4]])
                continue
            if held is not None:
                close(held[0], held[2], held[3], held[4], out)
            held = now
        yield from batch_of(out)
    if held is not None:
        out = []
        close(held[0], held[2], held[3], held[4], out)
        yield from batch_of(out)


def _apart(key: int, one: tuple, two: tuple, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``one`` and ``two`` (sigs, roots, bands) that may be similar, have different roots, and share no band before ``key``."""
    for i in range(0, len(one[0]), 32):
        sigs, roots, bands = (x[i : i + 32] for x in one)
        x, y = np.nonzero((_agree(sigs, two[0]) >= MAYBE) & (roots[:, None] != two[1][None, :]))
        if same:
            x, y = x[y > x + i], y[y > x + i]
        first = (bands[x] == two[2][y]).argmax(axis=1)
        here = bands[x, first] == key
        yield x[here] + i, y[here]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """Rows that follow each other with one (key, cell), put together."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        for i, k in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            if held and held[0][:2] != (key[i], cell[i]):
                yield (*held[0][:2], pa.Table.from_batches([x[2] for x in held]))
                held = []
            held.append((key[i], cell[i], batch.slice(i, k - i)))
    if held:
        yield (*held[0][:2], pa.Table.from_batches([x[2] for x in held]))


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple, tuple, bool]:
    """Rows of the cell's two blocks, what ``_apart`` asks of them, and whether both blocks are the same."""
    block, root = cell["block"].to_numpy(), cell["root"].to_numpy()
    sigs = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint8).reshape(cell.num_rows, -1)
    bands = cell["bands"].combine_chunks().flatten().to_numpy().reshape(cell.num_rows, -1)
    x, y = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    return x, y, (sigs[x], root[x], bands[x]), (sigs[y], root[y], bands[y]), bool(block.min() == block.max())


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, cell, node, block) that are in a pair of their cell which must be verified."""
    for key, _, cell in _cells(batches):
        x, y, one, two, same = _sides(cell)
        seen = np.zeros(cell.num_rows, bool)
        for i, k in _apart(key, one, two, same):
            seen[x[i]] = seen[y[k]] = True
        if seen.any():
            yield from cell.filter(pa.array(seen)).select(["key", "cell", "node", "block"]).combine_chunks().to_batches()


def _features(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row a range of a flat array of numbers, one for each shingle and its how-manieth time; none if the text isn't the node's."""
    found, lengths = [], []
    for chunk in cell.select(["node", "text"]).to_batches():
        for i, k in _slices(chunk.column(1)):
            part = chunk.slice(i, k - i)
            hashes, counts = _hashed(part.column(1))
            owner, sh = shingles(hashes, counts, WIDTH)
            # An id may stand for several texts.
            own = (fingerprints(hashes, counts)[0].view(np.int64) == part.column(0).to_numpy())[owner]
            owner, sh = owner[own], sh[own]
            order = np.lexsort((sh, owner))
            owner, sh = owner[order], sh[order]
            start = np.r_[True, (owner[1:] != owner[:-1]) | (sh[1:] != sh[:-1])][: len(sh)]
            at = np.arange(len(sh))
            times = at - np.maximum.accumulate(np.where(start, at, 0))
            found.append(mix(sh + mix(times.astype(np.uint64))))
            lengths.append(np.bincount(owner.astype(np.int64), minlength=part.num_rows))
    flat = np.unique(np.concatenate(found), return_inverse=True)[1]
    return flat, np.r_[0, np.cumsum(np.concatenate(lengths))]


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of roots that a verified pair of the cell joins; pairs that are joined already give nothing."""
    for key, _, cell in _cells(batches):
        flat, at = _features(cell)
        size = np.diff(at)
        label = cell["root"].to_numpy().copy()
        mark = np.zeros(len(flat) + 1, bool)
        x, y, one, two, same = _sides(cell)
        links = []
        for xs, ys in _apart(key, one, two, same):
            for i in np.unique(xs):
                r, others = x[i], y[ys[xs == i]]
                mine = flat[at[r] : at[r + 1]]
                mark[mine] = True
                others = others[(size[others] > 0) & (label[others] != label[r])]
                for some in np.split(others, np.flatnonzero(np.diff(np.cumsum(size[others]) >> 20)) + 1):
                    if not len(some) or not len(mine):
                        continue
                    begin = firsts(size[some])
                    gathered = mark[flat[np.arange(size[some].sum()) + np.repeat(at[some] - begin, size[some])]]
                    both = np.add.reduceat(gathered, begin, dtype=np.int64)
                    for other in some[both / (size[r] + size[some] - both) >= LEAST]:
                        if label[other] != label[r]:
                            links.append((label[r], label[other]))
                            label[label == label[other]] = label[r]
                mark[mine] = False
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])


def missed(shared: DataFrame, texts: DataFrame, linked: DataFrame, bodies_of, least: int) -> DataFrame:
    """(node, root) of the classes of ``linked`` that similar texts in buckets of more than ``least`` still join; node is the class's root.

    In a bucket whose texts are of several classes, every text outside of the bucket's largest class meets
    every other text of the bucket: both are dealt out in blocks, and each pair of blocks is a cell.  Cells
    first tell which texts are in a pair that may be similar; only these get their texts, and links within a
    cell that join nothing new are left out, so a cell gives fewer links than it has texts.
    """
    large = shared.filter(F.col("n") > least)
    if large.limit(1).count() == 0:
        return linked.limit(0)
    rooted = checkpoint(large.select("key", "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")))
    by_class = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    n_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = F.max(F.struct("n", "root"))
    uneven = by_class.groupBy("key").agg(main["root"].alias("main"), n_blocks(F.sum("n") - main["n"]).alias("others"), n_blocks(main["n"]).alias("mains"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    rows = rooted.join(uneven, "key").withColumn("_other", F.col("root") != F.col("main"))
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    rows = rows.withColumn("block", F.when(F.col("_other"), dealt(F.col("others"))).otherwise(F.col("others") + dealt(F.col("mains"))))
    # Blocks of the largest class meet the others only.
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("_other"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1))
    rows = rows.select("key", "node", "root", "block", (F.col("others") + F.col("mains")).cast("long").alias("_all"), meets.alias("_to"))
    cells = rows.select("key", (F.least("block", "_to") * F.col("_all") + F.greatest("block", "_to")).alias("cell"), "node", "block", "root").join(texts.select("node", "sig", "bands"), "node")
    cells = cells.select("key", "cell", "node", "block", "root", "sig", "bands").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    found = checkpoint(cells.mapInArrow(_open, "key long, cell long, node long, block int"))
    if found.limit(1).count() == 0:
        return linked.limit(0)
    nodes = found.select("node").distinct()
    named = texts.select("node", "sig", "bands").join(nodes, "node", "left_semi").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = checkpoint(named.join(bodies_of(nodes), "node"))
    cells = found.join(whole, "node").select("key", "cell", "node", "block", "root", "sig", "bands", "text").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    return components(cells.mapInArrow(_join, "a long, b long"))


def verify(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs whose multisets of shingles overlap enough; ``bodies`` has (node, text), rows for the same node alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k in _slices(batch.column(2)):
                part = batch.slice(i, k - i)
                bag = []
                for c, n in ((2, 0), (3, 1)):
                    hashes, counts = _hashed(part.column(c))
                    owner, sh = shingles(hashes, counts, WIDTH)
                    ends = np.searchsorted(owner, np.arange(len(counts) + 1))
                    # A row whose text isn't the node's (an id stood for several texts) says nothing.
                    bag.append((sh, ends, fingerprints(hashes, counts)[0].view(np.int64) == part.column(n).to_numpy()))
                (sa, ea, oka), (sb, eb, okb) = bag
                good = [bool(oka[r] and okb[r]) and weighted_jaccard(sa[ea[r] : ea[r + 1]], sb[eb[r] : eb[r + 1]]) >= LEAST for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in part.columns[:2]], ["a", "b"])

    one = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, text_copies, kept, node, root.

    Similarity is the weighted Jaccard of the multisets of five-word shingles (words between white space,
    A-Z lowered); a shorter text is one shingle of all its words.  Texts at 0.8 or more are linked, and
    linked documents, however far, are a class; ``class_id`` is its smallest id and ``kept`` marks the
    row with it (null ids come last; of repeated rows with one id every one is marked).  ``text_copies``
    counts the rows with the same words.  Null, empty and blank texts are alike and form one class.
    Columns other than doc_id and text are ignored; an empty table gives an empty one.

    ``node`` is a 64-bit hash of the words, which also stands for the text while pairs are compared;
    ``root`` is the smallest one of the class.
    """
    signed = checkpoint(sign(docs))
    # Rows for the same words have the same signature; one is kept, summed where it was made.
    ids = signed.groupBy("node", "twin").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    texts = signed.filter("sig is not null").select("node", "sig", "bands").dropDuplicates(["node"])
    texts = checkpoint(texts)
    shared = buckets(texts)
    pairs = checkpoint(candidates(shared, texts))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = checkpoint(ids)
    slim = docs.select("doc_id", "text")

    def bodies_of(nodes: DataFrame) -> DataFrame:
        sought = checkpoint(ids.join(nodes, "node", "left_semi").select("node", "least").dropDuplicates(["node"]))
        return slim.join(sized(sought), F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text")

    linked = components(verify(pairs, bodies_of(needed)))
    joined = missed(shared, texts, linked, bodies_of, ALL_PAIRS).select(F.col("node").alias("root"), F.col("root").alias("_whole"))
    classes = ids.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = attach(classes, joined, "root", "node").withColumn("root", F.coalesce("_whole", "root")).drop("_whole")
    # Summed where they are first; only classes of several texts are looked up again, as one may have very many.
    whole = classes.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    classes = attach(classes, checkpoint(whole), "root", "node")
    classes = checkpoint(classes.select("node", "twin", "copies", "root", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("class_size", "copies").alias("class_size")))
    # A text with many copies has many rows on one side and one on the other.
    out = signed.select("doc_id", "node", "twin").join(sized(classes), ["node", "twin"])
    return out.select("doc_id", "class_id", "class_size", F.col("copies").alias("text_copies"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "node", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each class, and their columns.

    What goes is named by id; where several rows share the id that stays, one text of the class stays
    for each id, and exactly repeated rows count once.
    """
    decided = checkpoint(near_dedup(docs))
    gone = checkpoint(decided.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    # Ids that stand for a kept row and for one that goes, or for several kept rows, are looked at by text.
    stay = decided.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    odd = checkpoint(stay.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left").filter("rows > 1 or _gone is not null or doc_id is null").select(F.col("doc_id").alias("_odd")))
    inner = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    plain = inner.join(sized(gone), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")
    if odd.limit(1).count() == 0:
        return plain.select("_row.*")
    plain = plain.join(sized(odd), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_anti")
    doubtful = inner.join(sized(odd), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi")
    named = _with_node(doubtful)
    kept = decided.filter("kept").select(F.col("node").alias("_kept"), F.col("doc_id").alias("_id"), F.col("root").alias("_root")).distinct()
    chosen = named.join(kept, (F.col("node") == F.col("_kept")) & F.col("_row.doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["_root"])
    return plain.select("_row.*").unionByName(chosen.select("_row.*"))


def _with_node(df: DataFrame) -> DataFrame:
    """``df`` (text, _row) with the hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k in _slices(batch.column(0)):
                part = batch.slice(i, k - i)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(fingerprints(*_hashed(part.column(0)))[0].view(np.int64))], ["_row", "node"])

    source = df.select("text", "_row")
    return source.mapInArrow(run, T.StructType([source.schema["_row"], T.StructField("node", T.LongType())]))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("node", "root")


ORACLE_SQL = {
    "op3_near_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY doc_id, g),
z AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM o JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE CAST(m AS DOUBLE) / CAST(p.n + q.n - m AS DOUBLE) >= 0.8::DOUBLE
  UNION SELECT a.doc_id, b.doc_id FROM t a JOIN t b ON a.w = b.w AND a.doc_id < b.doc_id),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
k AS (SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size FROM r GROUP BY x)
SELECT k.doc_id, class_id, CAST(class_size AS BIGINT) AS class_size, count(*) OVER (PARTITION BY w) AS text_copies, k.doc_id = class_id AS kept
FROM k JOIN t ON k.doc_id = t.doc_id
""",
}

QUERIES = {"op3_near_dedup": op3_near_dedup}
