"""Scores of texts under a model of logistic context mixing, and under plain counts of their words.

All training documents are read three times: for the counts of words and segments, from which the lexicon
follows; for the predictors' counts; and to learn weights and refining tables, from counts of what the
predictors say of each bit.  Counts are added as whole numbers, so the model doesn't depend on how files
are cut or in which order they are read.  A last pass scores all documents.

What is gathered grows with the input: the counts of words and segments without bound, the tables of the
predictors with the number of training words up to a documented size, which bounds what every task holds.
Words that are common in training travel to the scoring tasks as a table of bounded size; the counts of
all others are joined to the places where they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, table
from granary.llm.context_mixing import CELLS, END, ESCAPE, STOP, UNIT, Lexicon, Model, Parsed, Pool, Sizes, Ways, coded, count_spelled, count_ways, cut, new_counts, parse, segments
from granary.llm.tokens import Index, column_bytes, lowered, word_hashes, words

#: Words in the table that goes to all tasks, and segments in the lexicon.
HEAD, LEXICON = 1_000_000, 1 << 16
#: Texts are worked on in blocks of about so many bytes.  A task holds about 60 bytes for each.
_BLOCK = 3 << 20
#: Symbols whose texts are scored together, so that equal ones after equal contexts are worked on once.
_TOGETHER = 1 << 21
_END = np.uint64(1)
#: Counts of words and segments that a task holds before it adds up equal ones.
_TALLY = 1 << 20
#: Counts in a piece of a table, as it is sent.
_PIECE = 1 << 14
#: Stands for the words of the lexicon where tables are numbered.
_WORDS = 100


def held_out(doc_id: Column) -> Column:
    """True for documents that the model isn't learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def _blocks(batches: Iterator[pa.RecordBatch], text: int, size_of: int = _BLOCK) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Columns, bytes and offsets of rows that have about ``size_of`` bytes of text together."""
    parts, size = [], 0

    def close():
        columns = [pa.concat_arrays([p[0].column(c) for p in parts]) for c in range(parts[0][0].num_columns) if c != text]
        at = np.cumsum(np.concatenate([[0], *[np.diff(p[2]) for p in parts]]))
        return columns, np.concatenate([p[1] for p in parts]), at

    for batch in batches:
        i = 0
        data, at = column_bytes(batch.column(text))
        while i < batch.num_rows:
            k = min(max(i + 1, int(np.searchsorted(at, at[i] + size_of - size, "right")) - 1), batch.num_rows)
            parts.append((batch.slice(i, k - i), data[at[i] : at[k]], at[i : k + 1] - at[i]))
            size += int(at[k] - at[i])
            i = k
            if size >= size_of or i < batch.num_rows:
                yield close()
                parts, size = [], 0
    if parts:
        yield close()


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of each text."""
    starts, ends, counts = words(data, at)
    return word_hashes(lowered(data), starts, ends), counts


def _word_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word of each segment, and whether it has one."""
    hashes, counts = _tokens(data, at)
    out = np.zeros(len(counts), np.uint64)
    out[counts > 0] = hashes
    return out, counts > 0


def _tally(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, sorted, and the sums of their counts."""
    if len(counts) < 2:
        return counts[0] if counts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    key, n = (np.concatenate(c) for c in zip(*counts))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[new], np.add.reduceat(n[order], new) if len(new) else n


def gather(texts: DataFrame) -> DataFrame:
    """(kind, key, n): how often each word (kind 0, A-Z lowered) and each segment (kind 1) comes, by its hash; ends count as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What several blocks have is sent once; a task holds about 2 * _TALLY words and as many segments.
        held, pending = ([], []), 0

        def sent(kind: int):
            key, n = _tally(held[kind])
            for i in range(0, len(key), 65536):
                some = key[i : i + 65536].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int8)), pa.array(some), pa.array(n[i : i + 65536])], ["kind", "key", "n"])
            held[kind].clear()

        for _, data, at in _blocks(batches, 0):
            starts, _ = segments(data, at)
            for kind, hashes in ((0, np.r_[_tokens(data, at)[0], np.full(len(at) - 1, _END)]), (1, word_hashes(data, starts, np.r_[starts[1:], len(data)][: len(starts)]))):
                key, n = np.unique(hashes, return_counts=True)
                held[kind].append((key, n.astype(np.int64)))
                pending += len(key)
            if pending > _TALLY:
                for kind in (0, 1):
                    held[kind][:] = [_tally(held[kind])]
                    if len(held[kind][0][0]) > _TALLY // 2:
                        yield from sent(kind)
                pending = 0
        for kind in (0, 1):
            yield from sent(kind)

    return texts.select("text").mapInArrow(run, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def lexicon_of(gathered: DataFrame, most: int = LEXICON) -> Lexicon:
    """The most frequent segments, at most ``most``; of equally frequent ones the smaller hashes."""
    found = gathered.filter("kind = 1")
    total = int(found.agg(F.sum("n")).first()[0] or 0)
    ends = gathered.filter((F.col("kind") == 0) & (F.col("key") == F.lit(int(_END)))).first()
    top = found.orderBy(F.desc("n"), "key").limit(most).select("key", "n").toArrow()
    n = top["n"].to_numpy()
    return Lexicon(top["key"].to_numpy().view(np.uint64), n, total - int(n.sum()), ends["n"] if ends else 0)


_NUMBERS = (np.uint8, np.uint16, np.uint32, np.uint64)
_CODEC = pa.Codec("zstd", 1)


def _packed(piece: np.ndarray) -> tuple[int, bytes]:
    """A piece of a table: which numbers it is written in, and its bytes; places as a row of bits or, if few, as numbers, then the counts there."""
    some = np.flatnonzero(piece)
    kind = next(i for i, t in enumerate(_NUMBERS) if int(piece.max()) <= np.iinfo(t).max)
    counts = piece[some].astype(_NUMBERS[kind]).tobytes()
    if len(some) * 16 > len(piece):
        return kind, np.uint32(len(some)).tobytes() + _CODEC.compress(np.packbits(piece != 0).tobytes().ljust(_PIECE // 8, b"\0") + counts, asbytes=True)
    return kind + 4, some.astype(np.uint16).tobytes() + counts


def _add(total: np.ndarray, kind: int, packed: bytes) -> None:
    numbers = _NUMBERS[kind % 4]
    if kind < 4:
        size = int(np.frombuffer(packed, np.uint32, 1)[0])
        packed = _CODEC.decompress(memoryview(packed)[4:], _PIECE // 8 + size * numbers().itemsize)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, _PIECE // 8)))
        total[places] += np.frombuffer(packed, numbers, len(places), _PIECE // 8)
    else:
        n = len(packed) // (2 + numbers().itemsize)
        total[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, numbers, n, 2 * n)


def count_tables(texts: DataFrame, lexicon: Lexicon, sizes: Sizes) -> tuple[list[np.ndarray], np.ndarray]:
    """The predictors' tables, coded, and the hash of the word of each symbol of the lexicon, 0 without one.

    Each task counts its own documents, and pieces of the tables are added up apart.
    """
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((lexicon, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, named, pool, ways = None, None, Pool(), Ways()
        for _, data, at in _blocks(batches, 0):
            if counts is None:
                counts, named = new_counts(*held.value), np.zeros(len(held.value[0].hashes) + 2, np.uint64)
                todo = np.ones(len(named), bool)
                todo[[ESCAPE, END]] = False
            p = parse(data, at, held.value[0])
            if (same := ways.add(p)) is not None:
                count_ways(*same, *held.value, counts)
            if (some := pool.add(p)) is not None:
                count_spelled(some, held.value[1], counts)
            # The words of symbols that come for the first time.
            symbols = p.symbols[p.symbols != END]
            new = np.flatnonzero(todo[symbols])
            symbols, first = np.unique(symbols[new], return_index=True)
            named[symbols] = _word_of(*cut(data, p.starts[new[first]], p.ends[new[first]]))[0]
            todo[symbols] = False
        if (same := ways.close()) is not None:
            count_ways(*same, *held.value, counts)
        if (some := pool.close()) is not None:
            count_spelled(some, held.value[1], counts)
        if counts is not None:
            for i in range(0, len(named), _PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([_WORDS << 32 | i // _PIECE], pa.int64()), pa.array([3], pa.int8()), pa.array([named[i : i + _PIECE].tobytes()], pa.binary())], ["key", "form", "packed"])
        for t, table_ in enumerate(counts or []):
            for i in range(0, len(table_), _PIECE):
                if table_[i : i + _PIECE].any():
                    kind, packed = _packed(table_[i : i + _PIECE])
                    yield pa.RecordBatch.from_arrays([pa.array([t << 32 | i // _PIECE], pa.int64()), pa.array([kind], pa.int8()), pa.array([packed], pa.binary())], ["key", "form", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition has some pieces of the tables, whose size is bounded.
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, form, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key >> 32 == _WORDS:
                    got = np.frombuffer(packed.as_buffer(), np.uint64)
                    sums[key] = np.maximum(sums[key], got) if key in sums else got
                    continue
                if key not in sums:
                    sums[key] = np.zeros(_PIECE, np.int64)
                _add(sums[key], form, packed.as_buffer())
        for key, total in sums.items():
            codes = total if key >> 32 == _WORDS else coded(total)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([codes.tobytes()], pa.binary())], ["key", "codes"])

    got = texts.select("text").mapInArrow(run, "key long, form tinyint, packed binary").repartition("key").mapInArrow(merge, "key long, codes binary").toArrow()
    held.destroy()
    out = [np.zeros(len(c) // 2, np.uint16) for c in new_counts(lexicon, sizes)]
    named = np.zeros(len(lexicon.hashes) + 2, np.uint64)
    for key, codes in zip(got["key"].to_pylist(), got["codes"]):
        if key >> 32 == _WORDS:
            at = (key & 0xFFFFFFFF) * _PIECE
            named[at : at + _PIECE] = np.frombuffer(codes.as_buffer(), np.uint64)
            continue
        at = (key & 0xFFFFFFFF) * (_PIECE // 2)
        part = out[key >> 32][at : at + _PIECE // 2]
        part[:] = np.frombuffer(codes.as_buffer(), np.uint16)[: len(part)]
    return out, named


def learn(docs: DataFrame, model: Model, n_words: int) -> Model:
    """``model`` with weights and refining tables learnt from all ``docs`` (text), which have ``n_words`` words.

    Each task counts what the predictors say of the bits of its documents; pieces of the counts are added up apart.
    """
    if not n_words:
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(held.value.lexicon, held.value.sizes, held.value.tables)
        pool, ways = Pool(), Ways()
        for _, data, at in _blocks(batches, 0):
            p = parse(data, at, own.lexicon)
            if (same := ways.add(p)) is not None:
                own.see_ways(*same)
            if (some := pool.add(p)) is not None:
                own.see_spelled(some)
        if (same := ways.close()) is not None:
            own.see_ways(*same)
        if (some := pool.close()) is not None:
            own.see_spelled(some)
        for t, w in enumerate((own.words, own.bytes)):
            for i in range(0, CELLS if w.seen is not None else 0, _PIECE):
                if w.seen[i : i + _PIECE].any():
                    kind, packed = _packed(w.seen[i : i + _PIECE])
                    yield pa.RecordBatch.from_arrays([pa.array([t << 32 | i // _PIECE], pa.int64()), pa.array([kind], pa.int8()), pa.array([packed], pa.binary())], ["key", "form", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, form, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                _add(sums.setdefault(key, np.zeros(_PIECE, np.int64)), form, packed.as_buffer())
        for key, total in sums.items():
            kind, packed = _packed(total)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([kind], pa.int8()), pa.array([packed], pa.binary())], ["key", "form", "packed"])

    schema = "key long, form tinyint, packed binary"
    got = docs.select("text").mapInArrow(run, schema).repartition("key").mapInArrow(merge, schema).toArrow()
    # The disks of driver and executors needn't hold the model twice.
    held.destroy()
    out = Model(model.lexicon, model.sizes, model.tables)
    for key, form, packed in zip(got["key"].to_pylist(), got["form"].to_pylist(), got["packed"]):
        w = (out.words, out.bytes)[key >> 32]
        if w.seen is None:
            w.seen = np.zeros(CELLS, np.int64)
        at = (key & 0xFFFFFFFF) * _PIECE
        _add(w.seen[at : at + _PIECE], form, packed.as_buffer())
    out.settle()
    # The counts themselves needn't travel to the tasks that score.
    out.words.seen = out.bytes.seen = None
    return out


def fit(train: DataFrame, gathered: DataFrame, n_words: int) -> tuple[Model, np.ndarray]:
    """The model of the documents ``train`` (doc_id, text), of which ``gather`` has counted the words; and the words of its lexicon."""
    lexicon, sizes = lexicon_of(gathered), Sizes.of(n_words)
    tables, named = count_tables(train, lexicon, sizes)
    return learn(train, Model(lexicon, sizes, tables), n_words), named


def _words_of(p: Parsed, named: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the spelled segments, and at each symbol whether it has a word and which number: of the lexicon, or after it of the spelled."""
    bytes_ = p.data[p.data != STOP].astype(np.uint8)
    spelled, has = _word_of(bytes_, p.at - np.arange(len(p.at)))
    which = p.symbols.copy()
    which[p.symbols == ESCAPE] = len(named) + p.where
    return spelled, np.r_[named != 0, has][which], which


def _head(counts: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """The most frequent words, at most ``most`` of them, and the condition that they meet."""
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    total, least = 0, None
    for s, c in sizes:
        total += c
        if total > most:
            break
        least = s
    condition = step >= least if least is not None else F.lit(False)
    return counts.filter(condition), condition


def lm_score(docs: DataFrame, *, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the words (A-Z lowered) and one end of
    the text; c, N and V are the count of the word, all counts and the number of different words in the
    training documents.  ``score`` is log10 of the probability of the text's bytes and its end under the
    model, which follows from the rows alone, whatever files they are in; ``bits_per_byte`` is the same
    for each byte.  Null texts count as empty, null ids as an empty id
    (which is a training one); repeated rows are counted as often as they come, and scored alike.
    Columns other than doc_id and text are ignored; an empty table gives an empty one.  Words are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    train = slim.filter(~held_out(F.col("doc_id")))
    gathered = checkpoint(gather(train))
    counts = gathered.filter("kind = 0").select("key", "n")
    n_all, n_different = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    common, is_common = _head(counts, head)
    got = common.toArrow()
    key = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    held = spark.sparkContext.broadcast((fit(train, gathered, n_all), key[order], got["n"].to_numpy()[order]))
    whole = math.log10(n_all + 0.5 * (n_different + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, named), known, times = held.value
        named = named.copy()
        named[END] = _END
        log, index = np.log10(times + 0.5), Index(known)
        names = ["row", "doc_id", "key", "tail", "n", "n_tokens", "n_known", "base", "score", "n_bytes"]
        none = lambda k, t: pa.nulls(k, t)
        together, size = [], 0

        def scored():
            for (p, row, ids, *said), costs in zip(together, model.costs([t[0] for t in together])):
                n = len(row)
                score = np.bincount(p.text, costs, n) / UNIT * -math.log10(2)
                yield pa.RecordBatch.from_arrays([row, ids, row, pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64)), *said[:3], pa.array(score), said[3]], names)

        for (row, ids), data, at in _blocks(batches, 2):
            n, p = len(at) - 1, parse(data, at, model.lexicon)
            # The end of each text is one more word.
            spelled, has, which = _words_of(p, named)
            words_, owner, which = np.r_[named, spelled], p.text[has], which[has]
            i, found = index.find(words_)
            hit = found[which]
            base = np.bincount(owner[hit], (log[i] if len(log) else np.zeros(len(i)))[which[hit]], n).astype(np.float64)
            n_known, counts = np.bincount(owner[hit], minlength=n), np.bincount(owner, minlength=n)
            number = row.to_numpy()
            together.append((p, row, ids, pa.array(counts.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(np.diff(at).astype(np.int64))))
            size += len(p.symbols)
            if size >= _TOGETHER:
                yield from scored()
                together.clear()
                size = 0
            pairs = np.stack([owner[~hit].astype(np.uint64), words_[which[~hit]]], axis=1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            new = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]) if len(pairs) else np.zeros(0, np.int64)
            often = np.diff(np.r_[new, len(pairs)])
            for a in range(0, len(new), 65536):
                some = new[a : a + 65536]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(number[pairs[some, 0].astype(np.int64)]), none(k, ids.type), pa.array(np.ascontiguousarray(pairs[some, 1]).view(np.int64)), pa.array(np.ones(k, bool)), pa.array(often[a : a + 65536].astype(np.int64)), *[none(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]], names)
        if together:
            yield from scored()

    kind = slim.schema["doc_id"].dataType.simpleString()
    # The order of a row in the scan names it until the end; it is made and used in this one plan only.
    found = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, key long, tail boolean, n long, n_tokens long, n_known long, base double, score double, n_bytes long")
    rare = counts.filter(~is_common).select(F.col("key").alias("_key"), F.col("n").alias("_n"))
    joined = found.join(rare, (F.col("key") == F.col("_key")) & F.col("tail"), "left")
    c = F.coalesce("_n", F.lit(0))
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.lit(0)) + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + F.when(F.col("tail"), F.col("n") * F.log10(c + 0.5)).otherwise(0.0)).alias("sum"),
        F.sum("score").alias("score"),
        F.sum("n_bytes").alias("n_bytes"),
    )
    return summed.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("sum") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


QUERIES = {"op6_lm_score": op6_lm_score}
