"""A spread of registered queries against DuckDB at the smallest scale; python -m tests.compare runs all of them."""

import pytest

import catalogue
from tests.compare import connect, rows_of_duckdb, rows_of_spark

FOLDER = "/root/testdata/sf0.001"
SPREAD = ("fn_02", "fn_12", "fn_18", "flt_04", "jn_03", "jn_10", "agg_12", "win_04", "win_11", "set_02", "req_01", "req_02", "req_04", "req_07",
          "val_02", "val_11", "rec_09", "rec_12", "map_02", "map_09", "cit_02", "cit_08", "ret_07", "aud_09", "aud_14", "pkt_07", "cov_06", "grd_06", "str_02",
          "src_04", "src_08", "set_04", "cit_11", "cit_16_schedule", "cit_18_dated", "cov_04_standing", "pkt_12", "ret_12_outcome", "snk_10_blocks", "snk_11_note", "val_15")
catalogue.load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", SPREAD)
def test_both_engines_agree(spark, duck, key):
    entry = catalogue.REGISTRY[key]
    assert rows_of_spark(spark, FOLDER, entry) == rows_of_duckdb(duck, entry)


def test_every_query_has_an_oracle():
    assert all(e.sql is not None for e in catalogue.REGISTRY.values())


@pytest.mark.parametrize("key", ["jn_06", "snk_06"])
def test_whole_names(spark, duck, key):
    """Only renamed holdings collide; names that agree in their first 16 characters do not."""
    entry = catalogue.REGISTRY[key]
    got = rows_of_spark(spark, FOLDER, entry)
    assert got == rows_of_duckdb(duck, entry)
    text = [r[got[0].index("key" if key == "jn_06" else "directory")] for r in got[1]]
    shared = [t for t in text if t.endswith(")")] if key == "snk_06" else text
    assert shared and all("Shared Holding" in t for t in shared)
