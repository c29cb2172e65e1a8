from __future__ import annotations

import pytest

from starmart.filters import FilterSpec, option


@pytest.mark.parametrize(
    "bad",
    [
        {"year": 0}, {"year": "1997"}, {"year": True}, {"month": 0}, {"month": 13},
        {"category": ""}, {"state": ""}, {"payment": ""},
    ],
)
def test_values_that_are_no_filter_are_refused(bad):
    with pytest.raises(ValueError):
        FilterSpec(**bad)


def test_from_params_skips_missing_and_empty_values():
    spec = FilterSpec.from_params({"year": "1997", "month": "", "category": "0", "other": "x"})
    assert spec == FilterSpec(year=1997, category="0")
    with pytest.raises(ValueError):
        FilterSpec.from_params({"year": "abc"})


def test_has_time_and_without():
    assert FilterSpec(month=5).has_time
    assert not FilterSpec(state="SP").has_time
    assert FilterSpec(year=1, state="SP").without("state") == FilterSpec(year=1)


def test_predicates_per_dimension(spark):
    spec = FilterSpec(year=2017, month=1, category="toys", state="SP")
    assert set(spec.by_dimension()) == {"dim_waktu", "dim_produk", "dim_pelanggan"}
    assert "dim_seller" in spec.by_dimension(state_of="dim_seller")
    assert FilterSpec().by_dimension() == {}


def test_option_falls_back():
    assert option("category", ("product", "category"), "product") == "category"
    assert option("x", ("product", "category"), "product") == "product"
    assert option(None, ("product", "category"), "product") == "product"
