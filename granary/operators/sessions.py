"""Budgets that a row of documents shares, in order, for decoding and for encoding.

Bytes of input and of repaired input are charged at once and stay charged.  What a document's value takes,
and the bytes of output, are charged only if the whole document is accepted; a rejected one leaves them to
the next.  So each document depends on those before it, and a session is read by one task, document by
document, holding sums only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scan import scan
from granary.functions.text import free, normalize, numbered
from granary.operators.decode import decode
from granary.operators.encode import encode_rows
from granary.operators.tree import account
from granary.policy import Limits, Policy

MODES = ("text", "tree")


@dataclass
class Usage:
    """What a session has used."""

    input_bytes: int = 0
    normalized_bytes: int = 0
    nodes: int = 0
    payload_bytes: int = 0
    output_bytes: int = 0

    def room(self, limits: Limits, resource: str, size: int) -> bool:
        most = getattr(limits, resource)
        return most is None or getattr(self, resource) + size <= most


def admit(used: Usage, limits: Limits, text: str | None, *, raw_bytes: int | None = None, mode: str = "text", output: bool = False) -> tuple[bool, str | None, str | None]:
    """Charges one document; (accepted, error kind, resource).  A null document is accepted and costs nothing.

    ``raw_bytes`` is the size of the document before it was repaired to ``text``, if it was.  In the mode
    ``tree`` values are charged as ``tree.account`` does.  With ``output`` the text is one that was encoded.
    """
    if text is None:
        return True, None, None
    size = len(text.encode())
    if not output:
        for resource, n in (("input_bytes", size if raw_bytes is None else raw_bytes), ("normalized_bytes", size)):
            if not used.room(limits, resource, n):
                return False, "budget", resource
            setattr(used, resource, getattr(used, resource) + n)
        if raw_bytes is not None and not text:
            return False, "empty_input", None
    left = {k: getattr(limits, k) - getattr(used, k) for k in ("nodes", "payload_bytes") if getattr(limits, k) is not None}
    report = (scan if mode == "text" else account)(text, replace(limits, **left))
    if not report.valid:
        return False, "budget" if report.resource else "invalid_json", report.resource
    if output:
        if not used.room(limits, "output_bytes", size):
            return False, "budget", "output_bytes"
        used.output_bytes += size
    used.nodes += report.nodes
    used.payload_bytes += report.payload_bytes
    return True, None, None


OUTCOME = [("accepted", pa.bool_()), ("error_kind", pa.string()), ("error_resource", pa.string()), *[(f"used_{f.name}", pa.int64()) for f in fields(Usage)]]
OUTCOME_DDL = ", ".join(f"{k} {'boolean' if t == pa.bool_() else 'string' if t == pa.string() else 'bigint'}" for k, t in OUTCOME)


def run_sessions(df: DataFrame, column: str, *, key: list[str], order: list[str], limits: Limits, mode: str = "text", raw_bytes: str | None = None, reset: str | None = None, output: bool = False) -> DataFrame:
    """``df`` with the outcome of each document and what its session has used after it.

    A session is the rows that agree in ``key``, in the order of ``order``, which must not be empty; rows
    equal in it may come either way.  A new key is a new, unused session; so is what follows from a row on
    where the column ``reset`` is true.  ``raw_bytes`` names a column with the sizes of documents before
    their repair; ``mode`` and ``output`` are those of ``admit``.  Columns of ``df`` that are called like
    the outcome's (OUTCOME) are replaced.  Rows stream through in sorted order, so a session of any length
    needs no memory of its own.
    """
    if not key or not order:
        raise ValueError("a session needs key and order")
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    outcome = [k for k, _ in OUTCOME]
    names = [c for c in df.columns if c not in outcome]
    session_, json_, raw_, reset_ = extra = free(df.columns, "_session", "_json", "_raw", "_reset")
    col = lambda c: F.col(f"`{c}`")
    source = df.withColumns({session_: F.struct(*map(col, key)), json_: col(column), raw_: col(raw_bytes).cast("bigint") if raw_bytes else F.lit(None).cast("bigint"), reset_: F.coalesce(col(reset), F.lit(False)) if reset else F.lit(False)})
    source = source.repartition(*map(col, key)).sortWithinPartitions(*map(col, key), *map(col, order)).select(*map(col, [*names, *extra]))
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, Usage()
        for batch in batches:
            rows = []
            for session, text, raw, fresh in zip(*[batch.column(n + i) for i in range(4)]):
                if now is None or session != now or fresh.as_py():
                    now, used = session, Usage()
                rows.append((*admit(used, limits, text.as_py(), raw_bytes=raw.as_py(), mode=mode, output=output), *astuple(used)))
            columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(OUTCOME)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], [*names, *outcome])

    head = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return numbered(source).mapInArrow(run, f"{head}, {OUTCOME_DDL}")


def decode_sessions(df: DataFrame, column: str, *, key: list[str], order: list[str], limits: Limits, schema: str | None = None, policy: Policy | None = None, mode: str = "text", reset: str | None = None, value: str = "value") -> DataFrame:
    """``run_sessions`` over texts that are repaired first, with the decoded ``value`` of each accepted one.

    A document that is accepted but doesn't fit ``schema`` has no value, the error kind of decoding, and
    stays charged.
    """
    policy = policy or Policy.lenient()
    norm_, size_, error_ = free([*df.columns, value], "_norm", "_size", "_error")
    text = F.col(f"`{column}`")
    ready = df.withColumns({norm_: normalize(text, policy), size_: F.octet_length(text)})
    out = run_sessions(ready, norm_, key=key, order=order, limits=limits, mode=mode, raw_bytes=size_, reset=reset)
    out = decode(out.withColumn(norm_, F.when(F.col("accepted"), F.col(norm_))), norm_, schema=schema, policy=Policy.strict(), exact=False, value=value, error=error_)
    return out.withColumn("error_kind", F.coalesce("error_kind", f"{error_}.kind")).drop(norm_, size_, error_)


def encode_sessions(df: DataFrame, columns: list[str] | None = None, *, key: list[str], order: list[str], limits: Limits, raw: list[str] | None = None, mode: str = "text", reset: str | None = None, out: str = "json") -> DataFrame:
    """``run_sessions`` over rows that are encoded first, with the JSON of each accepted one in ``out``.

    A row whose raw fragment is no JSON is rejected, costs nothing and has the error kind ``invalid_raw_json``.
    """
    columns = [c for c in df.columns if c not in (*key, *order)] if columns is None else columns
    json_, error_ = free(df.columns, "_text", "_problem")
    made = encode_rows(df, columns, raw=raw, out=json_, error=error_)
    got = run_sessions(made, json_, key=key, order=order, limits=limits, mode=mode, reset=reset, output=True)
    bad = F.col(f"{error_}.kind").isNotNull()
    got = got.withColumns({out: F.when(F.col("accepted") & ~bad, F.col(json_)), "error_kind": F.coalesce("error_kind", f"{error_}.kind"), "accepted": F.col("accepted") & ~bad})
    return got.drop(json_, error_)
