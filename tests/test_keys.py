from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest

from starmart.model import DIMENSION_KEYS
from starmart.operators import keys
from starmart.operators.keys import (
    check_foreign_keys, check_unique_keys, cleanse, surrogate_keys,
)
from tests.frames import frame, money, plan_of, small_star, star, values


def test_keys_number_the_business_keys_in_order(spark):
    ids = random.Random(7).sample(range(10**6), 5000)
    df = frame(spark, "id long", [(i,) for i in ids]).repartition(7)
    numbered = dict(values(surrogate_keys(df, "id")))
    assert numbered == {i: n for n, i in enumerate(sorted(ids), start=1)}


def test_keys_hold_over_many_ranges(spark, settings):
    # Without coalescing every range stays a partition of its own.
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(0, 3000, 1, 5).selectExpr("(id * 7919) % 3001 AS id")
    numbered = surrogate_keys(df, "id")
    rows = sorted(values(numbered))
    assert [key for _, key in rows] == list(range(1, 3001))
    assert numbered.select("key").distinct().count() == 3000


def test_cleanse_drops_missing_keys_and_repeats(spark):
    df = frame(spark, "id long, v string", [(1, "a"), (1, "a"), (2, "b"), (None, "c")])
    assert sorted(values(cleanse(df, "id"))) == [(1, "a"), (2, "b")]


def test_key_checks(spark):
    s = small_star(
        spark,
        fakta_penjualan=[
            (1, 1, 1, 1, 1, money(1)), (1, 9, 1, None, 1, money(1)), (1, 9, 8, 1, 1, money(1)),
        ],
        fakta_pembayaran=[
            (5, 1, 1, 1, money(1)), (5, 1, 1, 7, money(1)), (None, 1, 1, 1, money(1)),
        ],
    )
    orphans = {(t, c): n for t, c, n in values(check_foreign_keys(s))}
    assert len(orphans) == 17
    assert {k: n for k, n in orphans.items() if n} == {
        ("fakta_penjualan", "produk_key"): 2,
        ("fakta_penjualan", "pelanggan_key"): 1,
        ("fakta_pembayaran", "metode_key"): 1,
    }
    repeats = {(t, c): n for t, c, n in values(check_unique_keys(s))}
    assert len(repeats) == 11
    # One key twice and one missing.
    assert {k: n for k, n in repeats.items() if n} == {("fakta_pembayaran", "pembayaran_key"): 2}


def _wide_star(spark):
    """Keys below zero, at the ends of blocks of 64, far apart, missing, repeated and unknown."""
    ids = [-2**62, -65, -64, -1, 0, 1, 63, 64, 127, 128, 2**40, 2**62]
    return star(
        spark,
        dim_produk=[(i, f"P{i}", "k", "e", 1, 1) for i in [*ids, 63, 63, 64]],
        dim_pelanggan=[(i, f"C{i}", "x", "SP") for i in ids],
        dim_metode_pembayaran=[(1, "card"), (2, "card"), (3, None), (4, None)],
        fakta_penjualan=[(None, p, c, None, 1, money(1)) for p in [*ids, 2, 62, -2, None] for c in [1, 65, 2**40 + 1]],
        fakta_pembayaran=[(k, None, None, None, money(1)) for k in [5, 5, 5, 6, 69, None, None, -5, -5, 2**40, 2**40]],
    )


@pytest.mark.parametrize("rows", [None, 0])
def test_key_checks_by_bits_are_exact(spark, monkeypatch, rows):
    if rows is not None:
        monkeypatch.setattr(keys, "BROADCAST_ROWS", rows)
    s = replace(_wide_star(spark), row_counts=dict.fromkeys(DIMENSION_KEYS, 20))
    orphans = {(t, c): n for t, c, n in values(check_foreign_keys(s))}
    assert len(orphans) == 17
    assert {k: n for k, n in orphans.items() if n} == {
        ("fakta_penjualan", "produk_key"): 9, ("fakta_penjualan", "pelanggan_key"): 32,
    }
    repeats = {(t, c): n for t, c, n in values(check_unique_keys(s))}
    assert len(repeats) == 11
    assert {k: n for k, n in repeats.items() if n} == {
        ("dim_produk", "produk_key"): 2, ("dim_metode_pembayaran", "metode_pembayaran"): 1,
        ("fakta_pembayaran", "pembayaran_key"): 4,
    }


def test_key_checks_do_not_shuffle_the_keys_of_facts(spark):
    s = replace(small_star(spark), row_counts=dict.fromkeys(DIMENSION_KEYS, 5))
    # No exchange by the single value, which every fact row would cross.
    assert not re.search(r"hashpartitioning\(table#\d+, column#\d+, value#", plan_of(check_foreign_keys(s)))
    assert "LeftSemi" in plan_of(check_unique_keys(s))
