import hashlib
import os
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from granary.llm.exact_dedup import ORACLE_SQL, exact_dedup, op5_exact_dedup


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "digest": pa.array([0] * len(rows))}), folder / name)


def test_rows_and_later_files(spark, tmp_path):
    rows = [(5, "a  b"), (3, "a\tb"), (3, "a b"), (9, None), (None, ""), (7, "long " * 50_000), (8, "long\n" * 50_000), (1, "é"), (None, "nul"), (None, "nul")]
    write(tmp_path / "d.parquet", "p0.parquet", rows)
    got = exact_dedup(spark, str(tmp_path / "d.parquet"), str(tmp_path / "state")).collect()
    key = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in rows if hashlib.sha256(key(t).encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == min((i for i in same if i is not None), default=None)
    assert sorted((r.doc_id for r in got if r.kept), key=str) == [1, 3, 7, 9, None]
    write(tmp_path / "d.parquet", "p1.parquet", [(2, "a b"), (0, "new")])
    again = exact_dedup(spark, str(tmp_path / "d.parquet"), str(tmp_path / "state")).collect()
    assert len(again) == 12 and {r.keep_id for r in again if r.group_size == 4} == {2}
    assert sum(r.kept for r in again) == 6


def test_paths_and_earlier_runs(spark, tmp_path):
    """Odd letters in a path, a slash at its end, a single file; and copies of a text from another path."""
    odd = tmp_path / "od[d] {x}*"
    write(odd, "p0.parquet", [(4, "same"), (5, "other")])
    for path in (f"{odd}/", f"{odd}", f"{odd}/p0.parquet"):
        assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_dedup(spark, path).collect()) == [(4, 1, True), (5, 1, True)]
    state = str(tmp_path / "state")
    exact_dedup(spark, f"{odd}", state).collect()
    os.utime(odd / "p0.parquet", (1, 1))
    write(tmp_path / "later", "p1.parquet", [(9, "same"), (8, "new"), (8, "new")])
    os.utime(tmp_path / "later" / "p1.parquet", (2, 2))
    got = exact_dedup(spark, str(tmp_path / "later"), state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(8, 8, 2, False), (8, 8, 2, True), (9, 4, 2, False)]


def test_empty(spark, tmp_path):
    write(tmp_path / "e.parquet", "p0.parquet", [])
    assert exact_dedup(spark, str(tmp_path / "e.parquet")).collect() == []


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    df = op5_exact_dedup(spark, d)
    cols = sorted(df.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op5_exact_dedup']})").fetchall())
