"""What the load moves for its joins, and how much a task of a co-located fact holds."""

from __future__ import annotations

from datetime import datetime

import pytest

from starmart.model import OPERATIONAL_SCHEMAS
from starmart.sources import colocated, warehouse
from starmart.sources.warehouse import Warehouse
from tests.frames import frame, money, plan_of


@pytest.fixture
def source(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    rows = {
        "orders": [(i, i % 7 if i % 9 else 99, datetime(2017, 1 + i % 3, 5), None if i % 4 else datetime(2017, 5, 1)) for i in range(40)],
        "order_items": [(i % 45, i, i % 5, i % 3, money(i), 1 + i % 2) for i in range(120)],
        "products": [(i, f"P{i}", "c", "k", 1, 1) for i in range(4)],
        "category_translation": [("c", "toys")],
        "customers": [(i, f"C{i}", "x", "SP") for i in range(7)],
        "sellers": [(i, f"S{i}", "x", "SP") for i in range(3)],
        "order_payments": [(i, 1, "a", "card", money(i)) for i in range(40)],
        "order_reviews": [(i, i, 1 + i % 5) for i in range(40)],
    }
    return {name: frame(spark, schema, rows[name]) for name, schema in OPERATIONAL_SCHEMAS.items()}


def test_lines_are_moved_once_for_the_joins_of_the_load(spark, source, tmp_path, monkeypatch):
    small = Warehouse(spark, source, str(tmp_path / "small"))
    # Lines and orders, by the order.
    assert plan_of(small.frame("keyed_lines")).count("Exchange hashpartitioning") == 2
    assert plan_of(small.frame("keyed_orders")).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(warehouse, "KEY_MAP_ROWS", 0)
    large = Warehouse(spark, source, str(tmp_path / "large"))
    assert "BroadcastHashJoin" not in plan_of(large.frame("keyed_lines"))
    for name in ("fakta_penjualan", "fakta_pengiriman", "fakta_pembayaran", "fakta_review"):
        a, b = (sorted(map(str, w[name].drop("id").collect())) for w in (small, large))
        assert a == b and a


def test_deliveries_are_not_laid_out_again(spark, source, tmp_path, monkeypatch):
    star = Warehouse(spark, source, str(tmp_path))
    star.keyed("keyed_lines")
    monkeypatch.setattr(warehouse, "laid_out_by_month", lambda df: pytest.fail("moved again"))
    rows = star["fakta_pengiriman"]
    assert rows.count() == rows.select("id").distinct().count() == 120
    assert rows.filter("tahun = 2017 AND bulan = 2").count() == sum((i % 45) % 3 == 1 for i in range(120) if i % 45 < 40)


def test_a_bucket_stays_within_a_task():
    # About 300 bytes a row were measured; a task may have some 3.6 GB.
    assert colocated.BUCKET_ROWS * 300 < 1_000_000_000


def test_lines_hold_only_what_a_fact_takes(spark, source, tmp_path):
    lines = Warehouse(spark, source, str(tmp_path)).frame("keyed_lines")
    assert "order_item_id" not in lines.columns
    # What an order's lines have in common stands together, so that moved rows repeat it.
    assert lines.columns[:6] == ["order_id", "waktu_id", "pelanggan_key", "durasi_pengiriman", "tahun", "bulan"]


def test_facts_are_written_compactly(spark, source, tmp_path):
    star = Warehouse(spark, source, str(tmp_path))
    for name in ("keyed_lines", "fakta_pengiriman"):
        files = star.keyed(name).inputFiles()
        assert files and all(".zstd.parquet" in file for file in files)


def test_payments_are_numbered_without_their_texts(spark, source, tmp_path):
    plan = plan_of(Warehouse(spark, source, str(tmp_path)).frame("fakta_pembayaran"))
    assert "payment_value" in plan
    assert "payment_code" not in plan and "payment_type" not in plan
