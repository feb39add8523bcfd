"""Budgets over a stream of documents, kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.operators.sessions import OUTCOME, OUTCOME_DDL, Usage, admit
from granary.policy import Limits


def stream_sessions(stream: DataFrame, column: str, *, key: list[str], order: list[str], limits: Limits, mode: str = "text", output: bool = False) -> DataFrame:
    """Like ``operators.sessions.run_sessions``, over a stream: (key, order, outcome) of each document.

    Documents of one micro-batch are taken in order; earlier batches come before later ones.  State is
    a sum for each resource and key, and doesn't expire.
    """
    columns = [*key, *[c for c in order if c not in key]]
    schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in columns)

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = Usage(*state.get) if state.exists else Usage()
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for text in rows[column]:
            out.append((*admit(used, limits, None if text is None or text != text else text, mode=mode, output=output), *astuple(used)))
        state.update(astuple(used))
        done = rows[columns].reset_index(drop=True)
        yield pd.concat([done, pd.DataFrame(out, columns=[k for k, _ in OUTCOME])], axis=1)

    needed = stream.select(*dict.fromkeys([*columns, column]))
    sums = ", ".join(f"{f.name} bigint" for f in fields(Usage))
    return needed.groupBy(*key).applyInPandasWithState(step, f"{schema}, {OUTCOME_DDL}", sums, "append", GroupStateTimeout.NoTimeout)
