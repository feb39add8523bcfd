"""Quality by perplexity under an n-gram model of trusted text.

The model is interpolated modified Kneser-Ney over three words, fitted on a drawn half of all the
documents that labels call good and not toxic; the other half sets the limits.  Its counts are added up in
parts, by hashes of n-grams, and written to the shared folder, from which the tasks that score read
them: texts stay where they are, and no n-gram of a scored document is shuffled.  A document is rejected if
its perplexity is above a quantile of the trusted documents of its language that the model was not fitted on.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import checkpoint, draw, scratch, sized, table
from granary.llm.tokens import column_bytes, firsts, lowered, mix, word_hashes, words

#: Trusted documents above this quantile of their language would be rejected.
QUANTILE = 0.995
#: A document's mean is drawn to its language's median as if it had so many more words of that kind.
SHRINK = 30
#: A language with fewer trusted documents than this uses the quantile of all.
FEWEST = 50
#: A task that scores keeps a model of so many n-grams or fewer, at about 10 bytes each; a larger one it reads row after
#: row for each stretch of about so many bytes of text.
HELD, STRETCH = 8_000_000, 12 << 20
#: Places that a task counts at once; a part of the model has about so many bytes of text, and there are so many parts at least.
_AT_ONCE, _PART, _PARTS = 1 << 19, 8 << 20, 8
#: Entries in a row of the model's files.
_ROW = 1 << 16
_BOS, _EOS = np.uint64(0x51), np.uint64(0x52)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, two marks before and one after each; the places of words and ends; and their number in each text."""
    starts, ends, counts = words(data, at)
    have = word_hashes(lowered(data), starts, ends)
    width = counts + 3
    line = np.full(int(width.sum()), _BOS, np.uint64)
    begin = firsts(width)
    line[np.repeat(begin + 2 - firsts(counts), counts) + np.arange(len(have))] = have
    line[begin + width - 1] = _EOS
    third = np.ones(len(line), bool)
    third[begin] = third[begin + 1] = False
    return line, np.flatnonzero(third), counts + 1


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; hashes as they are, counts compressed."""
    return pickle.dumps([(a.dtype.str, a.tobytes() if a.dtype == np.uint64 else zlib.compress(a.tobytes(), 1)) for a in map(np.ascontiguousarray, arrays)], 5)


def _unpacked(packed: bytes | pa.BinaryScalar) -> list[np.ndarray]:
    held = packed.as_buffer() if isinstance(packed, pa.Scalar) else packed
    return [np.frombuffer(b if t == "<u8" else zlib.decompress(b), t) for t, b in pickle.loads(held)]


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts``, a power of 2, a hash belongs to."""
    return (key >> np.uint64(65 - parts.bit_length())).astype(np.uint16)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each different one begins."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin) if len(begin) else np.zeros(0, np.int64)


def _sent(ids: list[np.ndarray], names: np.ndarray, n: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Rows of words (numbers in ``names``) with their counts, packed for each part with the words that occur there."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        some = order[ends[p] : ends[p + 1]]
        if len(some):
            own = np.zeros(len(names), bool)
            for i in ids:
                own[i[some]] = True
            number = np.cumsum(own) - 1
            yield p, _packed(names[own], *[_narrow(number[i[some]]) for i in ids], _narrow(n[some]))


def _kinds(c: np.ndarray) -> list[np.ndarray]:
    """What the discounts of a context depend on: all its counts, and how many are 1, 2 and more."""
    return [c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)]


def _seen(c: np.ndarray) -> np.ndarray:
    """How many n-grams there are, and how many came once to four times."""
    return np.r_[len(c), np.bincount(np.minimum(c, 5), minlength=6)[1:5]]


def _discounts(n: list[int]) -> list[float]:
    """The three discounts of modified Kneser-Ney, from how many n-grams were seen once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) if n[i] else 0.5 for i in range(3)]


def _off(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


#: Rows of the model's files and of what is sent on: ``slot`` is the part of the model, or -1 for what isn't of it.
_ROWS = "kind string, slot int, to int, packed binary"


def _row(kind: str, slot: int, to: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([slot], pa.int32()), pa.array([to], pa.int32()), pa.array([packed], pa.binary())], ["kind", "slot", "to", "packed"])


def _entries(kind: str, slot: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(arrays[0]), _ROW):
        yield _row(kind, slot, -1, _packed(*[a[i : i + _ROW] if a.dtype == np.uint64 else _narrow(a[i : i + _ROW]) for a in arrays]))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[list[np.ndarray]]]]:
    """Each part in a partition sorted by ``to``, and what was sent to it."""
    rows = ((to, packed) for b in batches for to, packed in zip(b.column(0).to_pylist(), b.column(1)))
    row = next(rows, None)
    while row is not None:
        part = row[0]

        def own():
            nonlocal row
            while row is not None and row[0] == part:
                yield _unpacked(row[1])
                row = next(rows, None)

        yield part, own()


def _added(got: Iterator[list[np.ndarray]], key_of) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Rows that were sent, equal ones added up: their hashes, sorted, their words and counts."""
    held, left, size = None, [], 0

    def merged(pieces):
        columns = [np.concatenate(c) for c in zip(*pieces)]
        key = key_of(*columns[:-1])
        order, begin = _runs(key)
        first = order[begin]
        return [*[c[first] for c in columns[:-1]], _sums(columns[-1][order], begin)], key[first]

    for names, *ids, n in got:
        left.append([*[names[i] for i in ids], n.astype(np.int64)])
        size += len(n)
        # What is held of a part is bounded by its different rows, however often they are sent.
        if size > 4 * _AT_ONCE + (2 * len(held[0]) if held else 0):
            held, _ = merged([held, *left] if held else left)
            left, size = [], len(held[0])
    columns, key = merged([held, *left] if held else left)
    return key, columns[:-1], columns[-1]


#: Tables of the model: three words, pairs as contexts, pairs and words; and which of the paths they are at.
_TABLES = {"three": 0, "before": 0, "two": 1, "one": 2}
#: The model that this Python process scored with last: its rows by table and part.
_KEPT: dict[tuple[str, str, str], dict[tuple[str, int], list]] = {}


def _rows_of(path: str, kind: str, slot: int) -> Iterator[list[np.ndarray]]:
    """A part of one of the model's tables, read from the shared folder: sorted hashes and their counts."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{at}/kind={kind}/slot={slot}", allow_not_found=True))
    for f in sorted(f.path for f in found if f.base_name.startswith("part-")):
        with fs.open_input_file(f) as file:
            for batch in pyarrow.parquet.ParquetFile(file, buffer_size=1 << 20).iter_batches(1, columns=["packed"]):
                for packed in batch.column(0):
                    yield _unpacked(packed)


@dataclass(frozen=True)
class Model:
    """What a task needs to score texts: where the parts of the model are, and what holds for all."""

    paths: tuple[str, str, str]
    parts: int
    discounts: tuple[list[float], list[float], list[float]]
    unknown: float
    total: int
    size: int
    most: int

    def rows(self, kind: str, slot: int) -> Iterator[list[np.ndarray]]:
        """The rows of a part of a table; kept where the model is small."""
        if self.paths not in _KEPT:
            # One model at a time.
            _KEPT.clear()
            _KEPT[self.paths] = {}
        if self.size > self.most:
            return _rows_of(self.paths[_TABLES[kind]], kind, slot)
        kept = _KEPT[self.paths]
        if (kind, slot) not in kept:
            kept[kind, slot] = list(_rows_of(self.paths[_TABLES[kind]], kind, slot))
        return kept[kind, slot]

    def found(self, kind: str, keys: np.ndarray, by: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Places of keys that are in a table, in pieces, and their counts there; ``by`` tells the part."""
        part = _part(by, self.parts)
        order = np.argsort(part, kind="stable").astype(np.int32)
        for slot, own in enumerate(np.split(order, np.searchsorted(part[order], np.arange(1, self.parts)))):
            own = own[np.argsort(keys[own])]
            sought = keys[own]
            for key, *values in self.rows(kind, slot) if len(own) else ():
                i, j = np.searchsorted(sought, key[0]), np.searchsorted(sought, key[-1], "right")
                where = np.searchsorted(key, sought[i:j])
                hit = key[where] == sought[i:j]
                yield own[i:j][hit], [v[where[hit]] for v in values]

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each text's probability, and its number of words and end."""
        line, k, counts = lines(data, at)
        if not len(k):
            return np.zeros(0), counts
        # Pairs end at the second place of a text or later; the one across two texts isn't asked for.
        pairs = np.r_[np.uint64(0), pair(line[:-1], line[1:])]
        k = k.astype(np.int32)
        n3, n2 = np.zeros(len(k), np.int32), np.zeros(len(line), np.int32)
        all2, all1, left2, left1 = (np.ones(len(line), np.float32) for _ in range(4))
        one = np.full(len(line), self.unknown, np.float32)
        d3, d2, d1 = self.discounts

        def context(to, all_, left, total, n1, n2, more, d):
            some = total > 0
            to, total = to[some], total[some]
            all_[to] = total
            left[to] = (n1[some] * d[0] + n2[some] * d[1] + more[some] * d[2]) / total

        for to, (n,) in self.found("three", pair(pairs[k - 1], line[k]), pairs[k - 1]):
            n3[to] = n
        for to, of in self.found("before", pairs, pairs):
            context(to, all2, left2, *of, d3)
        for to, (n,) in self.found("two", pairs, pairs):
            n2[to] = n
        for to, (n, *of) in self.found("one", line, line):
            one[to] = (n - _off(n, d1)) / max(self.total, 1) + self.unknown
            context(to, all1, left1, *of, d2)
        del pairs, line
        p = (n2[k] - _off(n2[k], d2)) / all1[k - 1] + left1[k - 1] * one[k].astype(np.float64)
        p = (n3 - _off(n3, d3)) / all2[k - 1] + left2[k - 1] * p
        return np.add.reduceat(np.log10(p), firsts(counts)), counts


@dataclass(frozen=True)
class Counts:
    """The model as files in the shared folder, dealt out by hashes of n-grams."""

    spark: SparkSession
    model: Model

    @property
    def size(self) -> int:
        return self.model.size

    @property
    def one(self) -> DataFrame:
        """(w3): the words of the model."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array(_unpacked(packed)[0].view(np.int64))], ["w3"])

        return self.spark.read.parquet(self.model.paths[2]).filter("kind = 'one'").select("packed").mapInArrow(run, "w3 long")

    def held(self) -> Model:
        return self.model


def _counted(texts: DataFrame, parts: int) -> DataFrame:
    """(to, packed): the three-word entries of some texts, counted in each task, for each part of the pair that they begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close():
            whole = [np.concatenate(c) for c in zip(*held)]
            for i in range(0, size, _AT_ONCE):
                w1, w2, w3 = (c[i : i + _AT_ONCE] for c in whole)
                names, where = np.unique(np.concatenate([w1, w2, w3]), return_inverse=True)
                one, two, three = np.split(where.astype(np.uint64), 3)
                # There are less than 2^21 + 2^20 different words, so three numbers need two keys; equal middles stand together.
                order = np.lexsort((three, two << np.uint64(32) | one))
                ids = [one[order], two[order], three[order]]
                new = np.flatnonzero(np.r_[True, (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]) | (ids[2][1:] != ids[2][:-1])])
                ids = [x[new].astype(np.int64) for x in ids]
                n = np.diff(np.r_[new, len(order)])
                for to, packed in _sent(ids, names, n, _part(pair(names[ids[0]], names[ids[1]]), parts), parts):
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([packed], pa.binary())], ["to", "packed"])

        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                line, k, _ = lines(*column_bytes(part.column(0)))
                held.append((line[k - 2], line[k - 1], line[k]))
                size += len(k)
                if size >= _AT_ONCE:
                    yield from close()
                    held, size = [], 0
        yield from close()

    return texts.select("text").mapInArrow(run, "to int, packed binary")


def fit(texts: DataFrame, most: int = HELD) -> Counts:
    """The model of some texts (column text); tasks keep at most ``most`` n-grams of it."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(_PARTS.bit_length() - 1, int(size // _PART).bit_length())

    def three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _by_part(batches):
            key, (w1, w2, w3), c = _added(got, lambda a, b, d: pair(pair(a, b), d))
            yield from _entries("three", part, key, c)
            before = pair(w1, w2)
            order, begin = _runs(before)
            yield from _entries("before", part, before[order[begin]], *[_sums(x[order], begin) for x in _kinds(c)])
            yield _row("seen", -1, -1, _packed(_seen(c).astype(np.int64)))
            # Shorter n-grams count the different words before them, not how often they occur.
            names, where = np.unique(np.concatenate([w2, w3]), return_inverse=True)
            ids = np.split(where, 2)
            order, begin = _runs(ids[0].astype(np.uint64) << np.uint64(32) | ids[1].astype(np.uint64))
            ids, n = [i[order[begin]] for i in ids], np.diff(np.r_[begin, len(order)])
            for to, packed in _sent(ids, names, n, _part(pair(names[ids[0]], names[ids[1]]), parts), parts):
                yield _row("sent", -1, to, packed)

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _by_part(batches):
            key, (w2, w3), c = _added(got, pair)
            yield from _entries("two", part, key, c)
            yield _row("seen", -1, -1, _packed(_seen(c).astype(np.int64)))
            names, where = np.unique(np.concatenate([w3, w2]), return_inverse=True)
            after, context = np.split(where, 2)
            sums = [np.bincount(after, minlength=len(names)), *[np.bincount(context, x, len(names)).astype(np.int64) for x in _kinds(c)]]
            to = _part(names, parts)
            for p in np.unique(to):
                own = to == p
                yield _row("sent", -1, int(p), _packed(names[own], *[_narrow(x[own]) for x in sums]))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _by_part(batches):
            columns = [np.concatenate(c) for c in zip(*got)]
            order, begin = _runs(columns[0])
            sums = [_sums(c[order].astype(np.int64), begin) for c in columns[1:]]
            yield from _entries("one", part, columns[0][order[begin]], *sums)
            c = sums[0][sums[0] > 0]
            yield _row("seen", -1, -1, _packed(np.r_[_seen(c), len(begin), [x.sum() for x in _kinds(c)]].astype(np.int64)))

    rows, paths, seen = _counted(texts, parts), [], []
    for name, step, width in (("three", three, 5), ("two", two, 5), ("one", one, 10)):
        path = scratch(spark, f"ngrams-{name}")
        dealt = rows.repartitionById(parts, "to").sortWithinPartitions("to")
        dealt.mapInArrow(step, _ROWS).write.partitionBy("kind", "slot").option("compression", "uncompressed").parquet(path)
        written = spark.read.schema(_ROWS).parquet(path).filter("slot = -1")
        seen.append(sum((_unpacked(r[0])[0] for r in written.filter("kind = 'seen'").select("packed").collect()), np.zeros(width, np.int64)).tolist())
        paths.append(path)
        rows = written.filter("kind = 'sent'").select("to", "packed")
    discounts = tuple(_discounts(n[1:5]) for n in seen)
    words_, total, kinds = seen[2][0], seen[2][6], seen[2][7:]
    left = sum(d * n for d, n in zip(discounts[2], kinds)) / total if total else 1.0
    return Counts(spark, Model(tuple(paths), parts, discounts, left / (max(words_, 1) + 1), total, seen[0][0] + seen[1][0] + seen[2][5], most))


def score(docs: DataFrame, counts: Counts, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_tokens (words and one end) and log10_prob of the text."""
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    model = counts.model
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("log10_prob", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _stretches(batches, STRETCH if model.size > model.most else STRETCH // 4):
            logs, n = model.score(*column_bytes(part.column("text")))
            for batch in pa.table([*[part.column(c) for c in keep], pa.array(n), pa.array(logs)], names=[*keep, "n_tokens", "log10_prob"]).to_batches():
                yield batch

    return source.mapInArrow(run, schema)


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows that have about ``size`` bytes together."""
    held, n = [], 0
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            held.append(part)
            n += part.nbytes
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids whose every label is good and not toxic."""
    every = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return every.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id", draw("doc_id").alias("_draw"))


@dataclass
class Classifier:
    """A model, and for each language the median and the limit of trusted documents (both negative log10 a token)."""

    counts: Counts
    limits: DataFrame

    def judged(self, scored: DataFrame, lang: Column) -> DataFrame:
        """``scored`` with ``value``, ``limit`` and ``kept``; a language without limits uses those of all."""
        own = self.limits.filter("not every").select(F.col("lang").alias("_lang"), "median", "limit")
        every = self.limits.filter("every").select(F.col("median").alias("_median"), F.col("limit").alias("_limit"))
        df = scored.withColumn("_l", lang).join(sized(own), F.col("_l").eqNullSafe(F.col("_lang")), "left")
        # One row at most.
        df = df.join(F.broadcast(every), F.lit(True), "left")
        median, limit = F.coalesce("median", "_median"), F.coalesce("limit", "_limit")
        value = (SHRINK * median - F.col("log10_prob")) / (F.col("n_tokens") + SHRINK)
        return df.withColumn("value", value).withColumn("kept", F.coalesce(value <= limit, F.lit(True))).withColumn("limit", limit).drop("_l", "_lang", "median", "_median", "_limit")


def train(docs: DataFrame, labels: DataFrame, *, sample: int | None = None, quantile: float = QUANTILE, most: int = HELD, every: bool = False) -> tuple[Classifier, DataFrame | None]:
    """Fits the model and, by the trusted documents left over, the limits; with ``every``, also the scores of all ``docs``.

    Every trusted document counts: those with a draw in the lower half for the model, the others for the limits.
    A caller may bound the model to ``sample`` documents.
    """
    good = checkpoint(trusted(labels).join(docs.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_semi"))
    if sample is None:
        lower = F.col("_draw") < "8"
        # A few documents may all be in one half.
        lower = lower if good.filter(lower).limit(1).count() else F.lit(True)
        fitted, others = checkpoint(good.filter(lower).select("doc_id")), checkpoint(good.filter(~lower).select("doc_id"))
    else:
        fitted = checkpoint(good.orderBy("_draw", "doc_id").limit(min(sample, (good.count() + 1) // 2)).select("doc_id"))
        others = checkpoint(good.join(sized(fitted), "doc_id", "left_anti").select("doc_id"))
    counts = fit(docs.join(sized(fitted), "doc_id", "left_semi"), most)
    scores = checkpoint(score(docs, counts, ["doc_id", "lang"])) if every else None
    # Without the scores of all, only trusted documents are scored here.
    apart = scores.join(sized(others), "doc_id", "left_semi") if every else score(docs.select("doc_id", "lang", "text").join(sized(others), "doc_id", "left_semi"), counts, ["lang"])
    apart = checkpoint(apart.select("lang", (-F.col("log10_prob")).alias("neg"), "n_tokens"))
    both = apart.withColumn("every", F.explode(F.array(F.lit(True), F.lit(False))))
    group = [F.when(~F.col("every"), F.col("lang")).alias("lang"), "every"]
    medians = both.groupBy(*group).agg(F.percentile_approx(F.col("neg") / F.col("n_tokens"), 0.5, 10000).alias("median"), F.count(F.lit(1)).alias("n"))
    medians = checkpoint(medians.filter(F.col("every") | (F.col("n") >= FEWEST)).drop("n"))
    keyed = both.select(*group, "neg", "n_tokens").withColumnsRenamed({"lang": "_lang", "every": "_every"})
    value = (SHRINK * F.col("median") + F.col("neg")) / (F.col("n_tokens") + SHRINK)
    limits = keyed.join(sized(medians), F.col("_lang").eqNullSafe(F.col("lang")) & (F.col("_every") == F.col("every"))).groupBy("lang", "every", "median").agg(F.percentile_approx(value, quantile, 10000).alias("limit"))
    return Classifier(counts, checkpoint(limits)), scores


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_tokens, log10_prob, value, limit, kept.

    ``value`` is the negative log10 probability a token, drawn to the language's median where the text
    is short; documents with a value above ``limit`` are not kept.  A null text counts as empty and is
    judged by its end alone; a null or rare language has the limit of all; without any trusted
    document everything is kept and ``limit`` is null.  Repeated rows get equal results; labels that
    disagree don't count; columns other than doc_id, text and lang are ignored.
    """
    classifier, scores = train(docs, labels, every=True, **options)
    return classifier.judged(scores, F.col("lang")).select("doc_id", "lang", "n_tokens", "log10_prob", "value", "limit", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns.

    Limits come from the trusted documents alone; then every row is scored once, where it is read.
    """
    classifier, _ = train(docs, labels, **options)
    inner = docs.select("text", F.struct("*").alias("_row"))
    return classifier.judged(score(inner, classifier.counts, ["_row"]), F.col("_row.lang")).filter("kept").select("_row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality": op9_quality}
