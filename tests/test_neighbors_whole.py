"""Neighbour queries ask with every vector of the table, in code and in SQL."""

import duckdb
import numpy as np
import pytest

from corpusgrid.operators import vectors
from corpusgrid.plans.catalog import QUERIES
from corpusgrid.plans.oracle import SQL


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), i % 3) for i in range(1, 131)]
    d = str(tmp_path_factory.mktemp("neighbors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["nearest_neighbors", "index_neighbors_exact", "index_recall"])
def test_every_vector_asks(spark, table, name):
    got = QUERIES[name](spark, table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{table}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    got = [tuple(r) for r in got.collect()]
    if name == "index_recall":
        assert got == want and got[0][:2] == (130, 1300)      # 2 queries before
    else:
        key = {r[:2]: r[2:] for r in want}
        assert len(got) == len(want) == 1300 and {r[0] for r in got} == set(range(1, 131))
        assert all(r[2] == key[r[:2]][0] and abs(r[3] - key[r[:2]][1]) < 2e-6 for r in got)


def test_index_neighbors_asks_with_every_vector(spark, table):
    got = QUERIES["index_neighbors"](spark, table).collect()
    assert {r["query_id"] for r in got} == set(range(1, 131))


def test_bits_of_cells_in_shared_and_cut_slots():
    base, share = vectors.cell_slots(np.array([0, 10, 300, 0, 140, 5, 5, 1]), 150)
    place, at, width = vectors.slot_places(base, share)
    assert place.tolist() == [0, 1, 0, 1, 0, 1, 2, 0]          # the second part of the cut cell shares its slot with an empty one
    slot = [s for b, n in zip(base.tolist(), share.tolist()) for s in range(b, b + n)]
    assert len(width) == 5 and len(at) == len(slot) and len(set(at.tolist())) == len(at)
    assert [a // 8 for a in at.tolist()] == slot               # each slot's few cells have a byte of their own
