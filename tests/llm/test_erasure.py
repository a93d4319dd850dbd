"""op11 against a plain rewrite of the same tables."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.llm import erasure
from tessella.llm.shared import fresh_path, ship

SF = "/root/testdata/sf0.001"
MONEY = {name: money for name, money, _ in erasure.TABLES}


def crc(v):
    return zlib.crc32(b"" if v is None else str(v).encode())


def key_of(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def expected(tables: dict[str, tuple[list[str], list[tuple]]]):
    """table -> file_no -> (rows left in order, n_erased)."""
    at = {t: {c: i for i, c in enumerate(cols)} for t, (cols, _) in tables.items()}
    rows = {t: r for t, (_, r) in tables.items()}
    owner = {}
    for r in rows["sales"]:
        s, c = r[at["sales"]["sale_id"]], r[at["sales"]["client_id"]]
        if s is not None and (s not in owner or owner[s] is None or (c is not None and c < owner[s])):
            owner[s] = c
    by_client = collections.Counter(r[at["clicks"]["client_id"]] for r in rows["clicks"])
    own = {(r[at["clients"]["master_id"]], r[at["clients"]["client_id"]]) for r in rows["clients"] if r[at["clients"]["master_id"]] is not None}
    clicks = collections.Counter({m: 0 for m, _ in own})
    for m, c in own:
        clicks[m] += by_client[c] if c is not None else 0
    masters = {m for m in clicks if crc(m) % 400 == 0}
    if clicks:
        masters.add(min(clicks, key=lambda m: (-clicks[m], m)))
    clients = {c for m, c in own if m in masters and c is not None}
    sales = {r[at["sales"]["sale_id"]] for r in rows["sales"] if r[at["sales"]["client_id"]] in clients} - {None}
    goes = {
        "clients": lambda r: r[at["clients"]["master_id"]] in masters,
        "clicks": lambda r: r[at["clicks"]["client_id"]] in clients,
        "sales": lambda r: r[at["sales"]["client_id"]] in clients,
        "sale_lines": lambda r: r[at["sale_lines"]["sale_id"]] in sales,
    }
    out = {}
    for t in rows:
        of = (lambda r: owner.get(r[at[t]["sale_id"]])) if t == "sale_lines" else (lambda r: r[at[t]["client_id"]])
        placed = sorted(rows[t], key=lambda r: (crc(of(r)), key_of(r)))
        k, out[t] = 1 + len(placed) // 350, {}
        for f in range(0, len(placed), k):
            left = [r for r in placed[f : f + k] if not goes[t](r)]
            out[t][f // k] = left, len(placed[f : f + k]) - len(left)
    return out


def plain(table: pa.Table):
    cols = [c.cast(pa.int64()).to_pylist() if pa.types.is_timestamp(c.type) else c.to_pylist() for c in table.columns]
    return table.column_names, list(zip(*cols))


def check(found, tables):
    want = expected(tables)
    seen = collections.defaultdict(set)
    roots = set()
    for r in found:
        left, erased = want[r.table_name][r.file_no]
        seen[r.table_name].add(r.file_no)
        names, rows = plain(pq.ParquetFile(r.path.removeprefix("file:")).read().combine_chunks())
        assert rows == left and (r.n_rows, r.n_erased, r.rewritten) == (len(left), erased, erased > 0)
        assert r.columns == ",".join(names) == ",".join(tables[r.table_name][0])
        money = names.index(MONEY[r.table_name])
        assert r.cents == sum(math.floor(100 * x[money] + 0.5) for x in left if x[money] is not None)
        ids = ",".join("" if x[0] is None else str(x[0]) for x in left)
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        meta = pq.ParquetFile(r.path.removeprefix("file:")).metadata
        assert meta.num_rows == len(left)
        stats = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
        some = [x[0] for x in left if x[0] is not None]
        if some:
            assert (min(s.min for s in stats), max(s.max for s in stats)) == (min(some), max(some))
        roots.add(os.path.dirname(os.path.dirname(os.path.dirname(r.path.removeprefix("file:")))))
    for t, files in want.items():
        assert seen[t] == {f for f, (left, _) in files.items() if left}
    (root,) = roots
    there = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if not f.startswith((".", "_"))]
    assert sorted(there) == sorted(r.path.removeprefix("file:") for r in found)
    assert not any(".spark-staging" in d for d, _, _ in os.walk(root))
    return want


def test_whole_query_equals_a_plain_rewrite(spark):
    ship(spark)
    found = erasure.op11_erasure(spark, SF).collect()
    want = check(found, {t: plain(pq.read_table(f"{SF}/{t}.parquet")) for t in MONEY})
    assert sum(r.rewritten for r in found) > 10 and sum(n for f in want.values() for _, n in f.values()) > 50


SCHEMAS = {
    "clients": "client_id long, master_id long, balance double, file_no string",
    "clicks": "click_id long, client_id long, value double",
    "sales": "sale_id long, client_id long, total double",
    "sale_lines": "sale_id long, line_no int, amount double, tie string",
}


@pytest.mark.parametrize("case", ["hot", "empty", "nulls"])
def test_hot_null_repeated_and_empty_tables(spark, tmp_path, case):
    ship(spark)
    rows = {t: [] for t in SCHEMAS}
    if case == "hot":  # a third of all rows is one client's, many rows repeat
        rows["clients"] = [(i, i // 2, 1.005 * i, f"x{i % 3}") for i in range(120)] + [(7, 3, 1.0, "y")] * 5
        rows["clicks"] = [(i // 4, 7 if i % 3 else i % 150, i / 7) for i in range(400)] + [(None, 7, None)] * 9
        rows["sales"] = [(i, 7 if i % 3 == 0 else i % 120, -0.005 * i) for i in range(120)] + [(3, 900, 1.0), (3, None, 1.0)]
        rows["sale_lines"] = [(7 if i % 3 else i, i % 5, 0.125 * i, None) for i in range(200)]
    if case == "nulls":
        rows["clients"] = [(None, 5, 1.0, None), (1, None, None, None), (2, 5, 2.5, "a"), (None, None, None, None)]
        rows["clicks"] = [(None, None, None)] * 3 + [(1, 1, 1.0)]
        rows["sales"] = [(None, 2, 1.0), (1, None, 2.0), (2, 2, None)]
        rows["sale_lines"] = [(None, 1, 1.0, None), (9, 1, 1.0, None), (2, 1, None, "b"), (1, 2, 3.0, None)]
    for t, kind in SCHEMAS.items():
        spark.createDataFrame(rows[t], kind).repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    found = erasure.op11_erasure(spark, str(tmp_path)).collect()
    if case == "empty":
        assert found == []
        return
    tables = {t: ([c.split()[0] for c in SCHEMAS[t].split(", ")], rows[t]) for t in rows}
    check(found, tables)
    if case == "nulls":  # a new folder at each call; the first is left as it is
        again = erasure.op11_erasure(spark, str(tmp_path)).collect()
        assert {r.path for r in again}.isdisjoint({r.path for r in found}) and all(os.path.exists(r.path.removeprefix("file:")) for r in found)


def test_erasing_again_changes_nothing(spark):
    ship(spark)
    df = spark.createDataFrame([(i, i % 10, float(i)) for i in range(1000)], "id long, k long, x double")
    folder = erasure.lay_out(df, df.columns, erasure.id_crc(F.col("k")), F.xxhash64("id"), fresh_path(spark, "again"), "t", per=20)
    doomed = spark.createDataFrame([(3,), (99,)], "k long")
    held = erasure.holdings(folder, "k", doomed)
    gone = erasure.erase(folder, "k", held)
    assert sum(gone.values()) == 100
    before = sorted(map(tuple, erasure.report(folder, "x", gone).collect()))
    assert erasure.erase(folder, "k", erasure.holdings(folder, "k", doomed)) == {}
    assert sorted(map(tuple, erasure.report(folder, "x", gone).collect())) == before
