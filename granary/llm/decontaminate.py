"""Benchmark items in documents, exact or with a few edits.

An item that may differ in k places is cut into k + 1 pieces; k edits can't touch all of them, so one
piece stands in the document unchanged.  One automaton finds all pieces of all items; around each hit
Myers' bit-parallel algorithm computes the edit distance between the item and the best place near it.
Nothing within the budget is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, table

#: Edits allowed for each character of a normalised item.
RATE = 0.08
#: Items are searched in blocks of so many characters together, each in one pass over the documents.
BLOCK = 4 << 20
_NOT_WORD = re.compile(r"[\W_]+")
_HITS = "array<struct<item_id:bigint,distance:int>>"


def normalise(text: str | None) -> str:
    """Letters and digits in lower case, with one space for whatever stands between them."""
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


@dataclass(frozen=True)
class Item:
    """A normalised item, its edit budget, and for each character the bits of the places where it stands."""

    item_id: int
    text: str
    budget: int
    places: dict[str, int]


def prepare(item_id: int, text: str | None, rate: float = RATE) -> Item | None:
    """None for an item without a letter or digit."""
    t = normalise(text)
    if not t:
        return None
    places: dict[str, int] = {}
    for i, c in enumerate(t):
        places[c] = places.get(c, 0) | 1 << i
    return Item(item_id, t, int(len(t) * rate), places)


def pieces(item: Item) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    n, k = len(item.text), item.budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance(item: Item, text: str) -> int:
    """The smallest edit distance between the item and any part of ``text``."""
    m, places = len(item.text), item.places
    full, high = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = places.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | ~(horizontal | up) & full
        minus = up & horizontal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best = score
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
    return best


def automaton(items: list[Item]) -> ahocorasick.Automaton:
    """Finds pieces; each comes with its length, and with the number and offset of every item that it belongs to."""
    found: dict[str, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        for at, piece in pieces(item):
            found.setdefault(piece, []).append((i, at))
    out = ahocorasick.Automaton()
    for piece, owners in found.items():
        out.add_word(piece, (len(piece), tuple(owners)))
    out.make_automaton()
    return out


def search(text: str | None, items: list[Item], pieces_of: ahocorasick.Automaton) -> dict[int, int]:
    """The smallest distance of each item that is within its budget, by the item's number."""
    t = normalise(text)
    near: dict[int, list[int]] = {}
    for end, (size, owners) in pieces_of.iter(t):
        for i, at in owners:
            near.setdefault(i, []).append(end + 1 - size - at)
    out = {}
    for i, starts in near.items():
        item = items[i]
        n, k = len(item.text), item.budget
        if not k:
            if any(t.startswith(item.text, s) and t[s - 1 : s] in ("", " ") and t[s + n : s + n + 1] in ("", " ") for s in starts):
                out[i] = 0
            continue
        if any(t.startswith(item.text, s) for s in starts if s >= 0):
            out[i] = 0
            continue
        starts.sort()
        windows = [[starts[0], starts[0]]]
        for s in starts:  # windows that overlap are searched as one
            if s <= windows[-1][1] + n + 2 * k:
                windows[-1][1] = s
            else:
                windows.append([s, s])
        best = min(distance(item, t[max(first - k, 0) : max(last + n + k, 0)]) for first, last in windows)
        if best <= k:
            out[i] = best
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``item_hits``, an array of (item_id, distance).

    ``benchmark`` (item_id, text) is the query set: it is read in blocks of about ``block`` characters, and
    each block is searched for in all documents, whole.  Only one block is held at a time, so what goes to
    the tasks is bounded; after each block but the last the documents and their hits are kept in the shared
    folder.  A hit's distance is counted in normalised characters and is at most rate x length of the item;
    hits stand by item, one for each item row that was found.  Items too short for any edit must stand as
    whole words, others may begin and end within a word.  Items without a letter or digit match nothing,
    and null or empty texts have no hits.  Repeated rows stay as they are, and an empty table or benchmark
    is no special case.  A column of ``docs`` called item_hits is dropped.  There is no shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "item_hits"]
    spark = docs.sparkSession
    out = docs.select(*dict.fromkeys([*keep, "text"]), F.array().cast(_HITS).alias("item_hits"))
    buffer, size = [], 0
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def with_block(df: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [x for r in held.value if (x := prepare(*r, rate))]
            found = automaton(items)
            if not items:
                yield from batches
                return
            for batch in batches:
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    text, had = part.column(part.schema.get_field_index("text")), part.column(part.num_columns - 1)
                    hits = []
                    for x, before in zip(text, had):
                        now = [{"item_id": items[i].item_id, "distance": d} for i, d in search(x.as_py(), items, found).items()]
                        hits.append(sorted([*before.as_py(), *now], key=lambda h: (h["item_id"] is None, h["item_id"] or 0, h["distance"])))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hits, kind)], schema=pa.schema([*list(part.schema)[:-1], pa.field("item_hits", kind)]))

        return df.mapInArrow(run, df.schema)

    for row in benchmark.select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        if buffer and size + len(row["text"] or "") > block:
            held = spark.sparkContext.broadcast(buffer)
            out = checkpoint(with_block(out, held))
            held.unpersist()
            buffer, size = [], 0
        buffer.append(tuple(row))
        size += len(row["text"] or "")
    if buffer:
        out = with_block(out, spark.sparkContext.broadcast(buffer))
    return out.select(*keep, "item_hits")


def clean_of(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    # Under a name of their own, columns of any name pass through.
    inner = docs.select("text", F.struct("*").alias("_row"))
    found = find_items(inner, benchmark, keep=["_row"], **options)
    return found.filter(F.size("item_hits") == 0).select("_row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", (F.size("item_hits") > 0).alias("contaminated"), F.transform("item_hits", lambda h: h["item_id"]).alias("item_ids"), F.array_min(F.transform("item_hits", lambda h: h["distance"])).alias("distance"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
