from __future__ import annotations

import json

import pytest

from starmart.filters import FilterSpec
from starmart.functions.lookups import STATE_COORDINATES, state_coordinates
from starmart.plans import geo
from starmart.sources.tables import write_json
from tests.frames import frame, money, small_star, values

COUNTS = "state string, jumlah long"


def test_coordinates(spark):
    df = state_coordinates(spark)
    assert df.dtypes == [
        ("code", "string"), ("lat", "double"), ("lng", "double"), ("nama", "string"),
    ]
    assert values(df) == STATE_COORDINATES
    assert len({code for code, *_ in STATE_COORDINATES}) == 27


def test_counts_with_and_without_time_filter(spark):
    s = small_star(spark)
    assert values(geo.geo_counts(s)) == [("SP", 2), ("RJ", 1)]
    assert values(geo.geo_counts(s, kind="seller")) == [("AM", 1), ("SP", 1)]
    year = FilterSpec(year=2017)
    assert values(geo.geo_counts(s, year)) == [("SP", 2), ("RJ", 1)]
    # Buyers, not sellers, are counted per state of the seller.
    assert values(geo.geo_counts(s, year, "seller")) == [("AM", 3), ("SP", 2)]
    one = FilterSpec(year=2017, state="AM")
    assert values(geo.geo_counts(s, one, "seller")) == [("AM", 3)]


def test_payment_filter_matches_on_date_and_customer(spark):
    paid = [
        (1, 1, 1, 1, money(1)),   # customer 1, day 1, boleto
        (2, 2, 2, 1, money(1)),   # customer 2, day 2, boleto
        (3, 3, 3, 2, money(1)),   # customer 3, day 3, card
        (4, 5, 2, 1, money(1)),
        (5, 1, 3, 1, money(1)),   # no sale of customer 3 that day
    ]
    s = small_star(spark, fakta_pembayaran=paid)
    assert values(geo.geo_payment_semi(s, FilterSpec(payment="boleto"))) == [("SP", 2)]
    only = FilterSpec(payment="boleto", year=2016)
    assert values(geo.geo_payment_semi(s, only)) == [("SP", 1)]
    assert values(geo.geo_payment_semi(s, FilterSpec(payment="voucher"))) == []
    with pytest.raises(ValueError):
        geo.geo_payment_semi(s, FilterSpec())


def test_enrich_trims_after_counting_and_drops_unknown_states(spark):
    counts = frame(spark, COUNTS, [("SP", 5), ("SP ", 2), ("XX", 90), ("RJ", 4)])
    rows = sorted(values(geo.geo_enrich(counts)))
    assert [(r[0], r[2], r[5]) for r in rows] == [("RJ", 4, 5), ("SP", 2, 5), ("SP", 5, 5)]


def test_marker_scale(spark):
    counts = frame(spark, COUNTS, [("SP", 100), ("RJ", 50), ("MG", 0)])
    scaled = {r["state"]: r for r in geo.geo_marker_scale(geo.geo_enrich(counts)).collect()}
    assert scaled["SP"].norm == 1.0 and scaled["SP"].radius == 200000.0
    assert scaled["SP"].pixel_radius == 18 and scaled["SP"].color == "#e74c3c"
    assert scaled["RJ"].norm == 0.5 and scaled["RJ"].color == "#f1c40f"
    assert scaled["RJ"].pixel_radius == round(6 + 12 * 0.5**0.5)
    assert scaled["MG"].radius == 15000.0 and scaled["MG"].color == "#2ecc71"


def test_equal_counts_scale_to_the_middle(spark):
    for n, colour in ((7, "#e74c3c"), (0, "#2ecc71")):
        counts = frame(spark, COUNTS, [("SP", n), ("RJ", n)])
        rows = geo.geo_marker_scale(geo.geo_enrich(counts)).collect()
        assert [(r.norm, r.color) for r in rows] == [(0.5, colour)] * 2


def test_json_document(spark, tmp_path):
    counts = frame(spark, COUNTS, [("RJ", 4), ("SP", 5)])
    [row] = geo.geo_json(geo.geo_enrich(counts), "seller").collect()
    document = json.loads(row.document)
    assert document["tipe"] == "seller" and document["max"] == 5
    assert [d["state"] for d in document["data"]] == ["SP", "RJ"]
    assert document["data"][0] == {
        "state": "SP", "nama": "São Paulo", "jumlah": 5, "lat": -23.5505, "lng": -46.6333,
    }
    empty = geo.geo_enrich(frame(spark, COUNTS, []))
    assert json.loads(geo.geo_json(empty).first().document) == {
        "tipe": "pelanggan", "data": [], "max": 0,
    }

    write_json(geo.geo_enrich(counts), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
