"""The registered queries as SQL over the given tables.

A query may name any table below; the ones it needs, directly or through other
tables, become its WITH clause.
"""

from __future__ import annotations

import re

_CODES = (
    "SP RJ MG RS PR SC BA DF GO PE CE PA MA ES MT MS AM RN PB AL SE".split()
)


def _state(nation: str) -> str:
    cases = " ".join(f"WHEN {n} THEN '{code}'" for n, code in enumerate(_CODES))
    return f"CASE {nation} WHEN 22 THEN '' WHEN 24 THEN 'XX' WHEN 21 THEN 'TO ' {cases} END"


_FACT_JOIN = """
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN dim_waktu ON CAST(o_orderdate AS DATE) = tanggal
JOIN dim_produk ON l_partkey = p_partkey
JOIN dim_pelanggan ON o_custkey = c_custkey
JOIN dim_seller ON l_suppkey = s_suppkey
"""

_METHOD = (
    "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL "
    "ELSE lower(substr(o_orderpriority, 3)) END"
)

TABLES = {
    "dim_waktu": """
SELECT CAST(row_number() OVER (ORDER BY tanggal) AS INT) AS waktu_id, tanggal,
  CAST(day(tanggal) AS INT) AS hari, CAST(month(tanggal) AS INT) AS bulan,
  CAST(year(tanggal) AS INT) AS tahun
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS tanggal FROM orders) x""",
    "dim_produk": """
SELECT row_number() OVER (ORDER BY p_partkey) AS produk_key,
  'P' || CAST(p_partkey AS VARCHAR) AS produk_id,
  CASE WHEN p_size = 50 THEN NULL ELSE lower(p_brand) END AS kategori,
  CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 THEN '' ELSE p_brand END AS kategori_inggris,
  p_size AS panjang, CAST(floor(p_retailprice) AS INT) AS berat, p_partkey
FROM part""",
    "dim_pelanggan": f"""
SELECT row_number() OVER (ORDER BY c_custkey) AS pelanggan_key, c_name AS pelanggan_id,
  'KOTA_' || CAST(c_custkey % 97 AS VARCHAR) AS kota, {_state("c_nationkey")} AS state, c_custkey
FROM customer""",
    "dim_seller": f"""
SELECT row_number() OVER (ORDER BY s_suppkey) AS seller_key, s_name AS seller_id,
  'KOTA_' || CAST(s_suppkey % 97 AS VARCHAR) AS kota, {_state("s_nationkey")} AS state, s_suppkey
FROM supplier""",
    "dim_metode_pembayaran": f"""
SELECT CAST(row_number() OVER (ORDER BY payment_code) AS INT) AS metode_key,
  metode_pembayaran, payment_code
FROM (
  SELECT o_orderpriority AS payment_code, {_METHOD} AS metode_pembayaran FROM orders
  UNION SELECT 'voucher', 'voucher' FROM orders WHERE o_orderkey % 10 = 0) x""",
    "fakta_penjualan": f"""
SELECT waktu_id, produk_key, pelanggan_key, seller_key, CAST(l_quantity AS INT) AS jumlah,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS total_harga
{_FACT_JOIN}""",
    "fakta_pengiriman": f"""
SELECT waktu_id, pelanggan_key, seller_key, produk_key,
  CASE WHEN o_orderstatus = 'P' THEN NULL
    ELSE CAST(1 + (o_orderkey * 13 + o_custkey) % 60 AS INT) END AS durasi_pengiriman
{_FACT_JOIN}""",
    "fakta_pembayaran": """
SELECT row_number() OVER (ORDER BY o_orderkey, seq) AS pembayaran_key, waktu_id, pelanggan_key,
  metode_key, CAST(paid AS DECIMAL(12,2)) AS total_bayar
FROM (
  SELECT o_orderkey, o_custkey, o_orderdate, 1 AS seq, o_orderpriority AS code, o_totalprice AS paid
  FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, o_orderdate, 2, 'voucher', 1 FROM orders WHERE o_orderkey % 10 = 0) p
JOIN dim_waktu ON CAST(o_orderdate AS DATE) = tanggal
JOIN dim_pelanggan ON o_custkey = c_custkey
JOIN dim_metode_pembayaran m ON code = payment_code""",
    "fakta_review": """
SELECT waktu_id, pelanggan_key, produk_key,
  CAST(1 + (o_orderkey * 7 + o_custkey) % 5 AS INT) AS skor_review
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN dim_waktu ON CAST(o_orderdate AS DATE) = tanggal
JOIN dim_produk ON l_partkey = p_partkey
JOIN dim_pelanggan ON o_custkey = c_custkey""",
    "fakta_seller": """
SELECT waktu_id, seller_key, produk_key, CAST(sum(jumlah) AS BIGINT) AS jumlah_terjual
FROM fakta_penjualan GROUP BY ALL""",
    "n_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CAST(o_orderdate AS TIMESTAMP) AS order_purchase_timestamp,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE)
    + CAST(1 + (o_orderkey * 13 + o_custkey) % 60 AS INT) AS TIMESTAMP) END
    AS order_delivered_customer_date
FROM orders""",
    "n_order_items": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS price
FROM lineitem""",
    "n_products": """
SELECT p_partkey AS product_id,
  CASE WHEN p_size = 50 THEN NULL ELSE lower(p_brand) END AS product_category_name
FROM part""",
    "n_customers": f"""
SELECT c_custkey AS customer_id, 'KOTA_' || CAST(c_custkey % 97 AS VARCHAR) AS customer_city,
  {_state("c_nationkey")} AS customer_state
FROM customer""",
    "n_sellers": "SELECT s_suppkey AS seller_id FROM supplier",
    "n_order_payments": f"""
SELECT o_orderkey AS order_id, {_METHOD} AS payment_type,
  CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value
FROM orders
UNION ALL
SELECT o_orderkey, 'voucher', CAST(1 AS DECIMAL(12,2)) FROM orders WHERE o_orderkey % 10 = 0""",
    "n_order_reviews": """
SELECT o_orderkey AS review_id, o_orderkey AS order_id,
  CAST(1 + (o_orderkey * 7 + o_custkey) % 5 AS INT) AS review_score
FROM orders""",
    # The coordinates of the states that the data contains.
    "coordinates": """
SELECT * FROM (VALUES
  ('SP', -23.5505, -46.6333, 'São Paulo'), ('RJ', -22.9068, -43.1729, 'Rio de Janeiro'),
  ('MG', -19.9167, -43.9345, 'Minas Gerais'), ('RS', -30.0346, -51.2177, 'Rio Grande do Sul'),
  ('PR', -25.4284, -49.2733, 'Paraná'), ('SC', -27.5954, -48.5480, 'Santa Catarina'),
  ('BA', -12.9714, -38.5014, 'Bahia'), ('DF', -15.7801, -47.9292, 'Distrito Federal'),
  ('GO', -16.6869, -49.2648, 'Goiás'), ('PE', -8.0476, -34.8770, 'Pernambuco'),
  ('CE', -3.7172, -38.5433, 'Ceará'), ('PA', -1.4558, -48.4902, 'Pará'),
  ('MA', -2.5307, -44.3068, 'Maranhão'), ('ES', -20.3155, -40.3088, 'Espírito Santo'),
  ('MT', -15.6014, -56.0979, 'Mato Grosso'), ('MS', -20.4483, -54.6326, 'Mato Grosso do Sul'),
  ('AM', -3.1190, -60.0217, 'Amazonas'), ('RN', -5.7945, -35.2110, 'Rio Grande do Norte'),
  ('PB', -7.1195, -36.8235, 'Paraíba'), ('AL', -9.5713, -36.7820, 'Alagoas'),
  ('SE', -10.9472, -37.0731, 'Sergipe'), ('TO', -10.1753, -48.2982, 'Tocantins')
) c(code, lat, lng, nama)""",
    "located": """
SELECT trim(s.state) AS state, nama, jumlah, CAST(lat AS DOUBLE) AS lat,
  CAST(lng AS DOUBLE) AS lng, max(jumlah) OVER () AS max
FROM (SELECT state, count(*) AS jumlah FROM dim_pelanggan
      WHERE state IS NOT NULL AND state <> '' GROUP BY state) s
JOIN coordinates ON trim(s.state) = code""",
    "months": """
SELECT tahun, bulan, CAST(sum(total_harga) AS DOUBLE) AS total_penjualan,
  count(*) AS jumlah_transaksi,
  row_number() OVER (ORDER BY tahun, bulan) - 1 AS x
FROM fakta_penjualan JOIN dim_waktu USING (waktu_id) GROUP BY tahun, bulan""",
    "fit": """
SELECT count(*) AS n, coalesce(regr_slope(total_penjualan, x), 0) AS b,
  coalesce(regr_intercept(total_penjualan, x), 0) AS a,
  coalesce(regr_slope(jumlah_transaksi, x), 0) AS b_count,
  coalesce(regr_intercept(jumlah_transaksi, x), 0) AS a_count,
  avg(total_penjualan) AS mean, max(make_date(tahun, bulan, 1)) AS last
FROM months""",
    "growth": """
SELECT rate AS persen,
  CASE WHEN rate > 1 THEN 'naik' WHEN rate < -1 THEN 'turun' ELSE 'stabil' END AS arah
FROM (SELECT CASE WHEN mean > 0 THEN 100 * b / mean ELSE 0 END AS rate FROM fit) r""",
    "projection": """
SELECT CAST(ke AS INT) AS ke, last + CAST(ke AS INT) * INTERVAL 1 MONTH AS month,
  greatest(0.0, a + b * (n - 1 + ke)) AS penjualan,
  CAST(greatest(0, round(a_count + b_count * (n - 1 + ke))) AS BIGINT) AS transaksi,
  n - 1 + ke AS seq
FROM fit, range(1, 4) r(ke)""",
    "category_months": """
SELECT kategori, tahun, bulan, sum(total_harga) AS total,
  row_number() OVER (PARTITION BY kategori ORDER BY tahun, bulan) - 1 AS x
FROM fakta_penjualan JOIN dim_produk USING (produk_key) JOIN dim_waktu USING (waktu_id)
GROUP BY kategori, tahun, bulan""",
    "categories": """
SELECT kategori, CASE WHEN rata > 0 THEN 100 * slope / rata ELSE 0 END AS persen, rata
FROM (SELECT kategori, regr_slope(CAST(total AS DOUBLE), x) AS slope,
    CAST(sum(total) AS DOUBLE) / count(*) AS rata
  FROM category_months GROUP BY kategori HAVING count(*) >= 3) s""",
    "movers": """
SELECT 'naik' AS side, CAST(r AS INT) AS rank, kategori, persen FROM (
  SELECT *, row_number() OVER (ORDER BY persen DESC, kategori NULLS LAST) AS r FROM categories)
WHERE r <= 3
UNION ALL
SELECT 'turun', CAST(r AS INT), kategori, persen FROM (
  SELECT *, row_number() OVER (ORDER BY persen, kategori DESC NULLS FIRST) AS r FROM categories)
WHERE r <= 3""",
    "slow": """
SELECT kota, state, round(avg(durasi_pengiriman), 1) AS rata_rata_hari, count(*) AS jumlah
FROM fakta_pengiriman JOIN dim_pelanggan USING (pelanggan_key)
GROUP BY kota, state HAVING count(*) >= 5
ORDER BY rata_rata_hari DESC NULLS FIRST, kota NULLS LAST, state NULLS LAST LIMIT 5""",
    "mix": """
SELECT metode_pembayaran, count(*) AS jumlah, CAST(sum(total_bayar) AS DOUBLE) AS total
FROM fakta_pembayaran JOIN dim_metode_pembayaran USING (metode_key)
WHERE metode_pembayaran IS NOT NULL GROUP BY metode_pembayaran""",
}

_STD = """JOIN dim_waktu w USING (waktu_id) JOIN dim_produk p USING (produk_key)
JOIN dim_pelanggan c USING (pelanggan_key)"""
_SALES = f"FROM fakta_penjualan f {_STD}"
_SELLERS = f"{_SALES} JOIN dim_seller s USING (seller_key)"
_DELIVERY = f"FROM fakta_pengiriman f {_STD}"
_REVIEW = f"FROM fakta_review f {_STD}"
_PAYMENT = """FROM fakta_pembayaran f JOIN dim_metode_pembayaran m USING (metode_key)
JOIN dim_waktu w USING (waktu_id) JOIN dim_pelanggan c USING (pelanggan_key)"""
_REVENUE = "CAST(sum(total_harga) AS DOUBLE)"
_UNITS = "CAST(sum(jumlah) AS BIGINT)"
_LABEL = "CAST(tahun AS VARCHAR) || '-' || lpad(CAST(bulan AS VARCHAR), 2, '0')"
_SHORT = """list_extract(['Jan', 'Feb', 'Mar', 'Apr', 'Mei', 'Jun', 'Jul', 'Agu', 'Sep', 'Okt',
  'Nov', 'Des'], CAST({m} AS INT)) || ' ''' || right(CAST({y} AS VARCHAR), 2)"""
_LONG = """list_extract(['Januari', 'Februari', 'Maret', 'April', 'Mei', 'Juni', 'Juli', 'Agustus',
  'September', 'Oktober', 'November', 'Desember'], bulan)"""
_OP_ITEMS = "FROM n_orders o JOIN n_order_items i USING (order_id)"
_PLACED = """CAST(year(order_purchase_timestamp) AS INT) AS tahun,
  CAST(month(order_purchase_timestamp) AS INT) AS bulan"""
_EPOCH_DAYS = """avg(epoch(order_delivered_customer_date) - epoch(order_purchase_timestamp))
  / 86400"""


def _foreign_keys() -> str:
    keys = {
        "dim_waktu": "waktu_id", "dim_produk": "produk_key", "dim_pelanggan": "pelanggan_key",
        "dim_seller": "seller_key", "dim_metode_pembayaran": "metode_key",
    }
    facts = {
        "fakta_penjualan": ["dim_waktu", "dim_produk", "dim_pelanggan", "dim_seller"],
        "fakta_pengiriman": ["dim_waktu", "dim_pelanggan", "dim_seller", "dim_produk"],
        "fakta_pembayaran": ["dim_waktu", "dim_pelanggan", "dim_metode_pembayaran"],
        "fakta_review": ["dim_waktu", "dim_pelanggan", "dim_produk"],
        "fakta_seller": ["dim_waktu", "dim_seller", "dim_produk"],
    }
    return "\nUNION ALL\n".join(
        f"""SELECT '{fact}' AS "table", '{keys[d]}' AS "column", count(*) AS orphans
FROM {fact} f WHERE {keys[d]} IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM {d} d WHERE d.{keys[d]} = f.{keys[d]})"""
        for fact, dimensions in facts.items()
        for d in dimensions
    )


def _unique_keys() -> str:
    columns = [
        ("dim_waktu", "waktu_id"), ("dim_produk", "produk_key"),
        ("dim_pelanggan", "pelanggan_key"), ("dim_seller", "seller_key"),
        ("dim_metode_pembayaran", "metode_key"),
        ("dim_metode_pembayaran", "metode_pembayaran"),
        ("fakta_pembayaran", "pembayaran_key"),
    ]
    checks = [
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS duplicates FROM
(SELECT {c} FROM {t} GROUP BY {c} HAVING {"count({0}) > 1" if c == "metode_pembayaran" else "count(*) > 1 OR {0} IS NULL"}) x""".replace("{0}", c)
        for t, c in columns
    ]
    # Row ids are numbered on write and have no counterpart here.
    checks += [
        f"""SELECT '{t}', 'id', count(*) FROM
(SELECT id FROM (SELECT row_number() OVER () AS id FROM {t}) r GROUP BY id HAVING count(*) > 1) x"""
        for t in ("fakta_penjualan", "fakta_pengiriman", "fakta_review", "fakta_seller")
    ]
    return "\nUNION ALL\n".join(checks)


def _counts(tables: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS "table", count(*) AS "rows" FROM {table}"""
        for name, table in tables.items()
    )


def _pair_counts() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{key}' AS key, (SELECT count(*) FROM ({QUERIES['star_' + key]}) s) AS star_rows,
(SELECT count(*) FROM ({QUERIES['norm_' + key]}) n) AS norm_rows"""
        for key in [k[5:] for k in QUERIES if k.startswith("norm_")]
    )


QUERIES = {
    "scan_star": _counts({t: t for t in TABLES if t.startswith(("dim_", "fakta_"))}),
    "scan_normalized": _counts(
        {t[2:]: t for t in TABLES if t.startswith("n_")}
        | {
            "category_translation": "(SELECT DISTINCT lower(p_brand), p_size = 49 "
            "FROM part WHERE p_size <> 50) t"
        }
    ),
    "star_filter_all": f"""SELECT count(*) AS "rows",
  CAST(coalesce(sum(jumlah), 0) AS BIGINT) AS total_qty,
  coalesce({_REVENUE}, 0) AS total_revenue
{_SALES} WHERE w.tahun = 1997 AND p.kategori_inggris = 'Brand#12' AND c.state = 'SP'""",
    "filter_non_empty": """SELECT kategori_inggris, count(*) AS products FROM dim_produk
WHERE kategori_inggris IS NOT NULL AND kategori_inggris <> '' GROUP BY kategori_inggris""",
    "join_fact_one_dim": f"""SELECT kategori, count(*) AS "rows", {_REVENUE} AS total
FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY kategori""",
    "join_sales_star": f"""SELECT w.tahun, p.kategori_inggris, c.state, count(*) AS "rows",
  {_REVENUE} AS total {_SALES} GROUP BY ALL""",
    "join_seller_star": f"""SELECT s.state AS seller_state, w.tahun, count(*) AS "rows",
  {_UNITS} AS total {_SELLERS} GROUP BY ALL""",
    "join_delivery_star": f"""SELECT p.kategori_inggris, c.state, count(*) AS "rows",
  CAST(sum(durasi_pengiriman) AS BIGINT) AS total {_DELIVERY} GROUP BY ALL""",
    "join_payment_star": f"""SELECT m.metode_pembayaran, w.tahun, count(*) AS "rows",
  CAST(sum(total_bayar) AS DOUBLE) AS total {_PAYMENT} GROUP BY ALL""",
    "join_review_star": f"""SELECT w.tahun, p.kategori_inggris, count(*) AS "rows",
  CAST(sum(skor_review) AS BIGINT) AS total {_REVIEW} GROUP BY ALL""",
    "join_left_customer_label": f"""
SELECT coalesce(c.pelanggan_id, CAST(f.pelanggan_key AS VARCHAR)) AS label,
  {_REVENUE} AS total_revenue
FROM fakta_penjualan f LEFT JOIN dim_pelanggan c ON f.pelanggan_key = c.pelanggan_key
JOIN dim_waktu w USING (waktu_id) JOIN dim_produk p USING (produk_key) GROUP BY 1""",
    "join_payment_fanout": f"""
SELECT CAST(year(order_purchase_timestamp) AS INT) AS tahun, count(*) AS "rows",
  CAST(sum(price) AS DOUBLE) AS total
{_OP_ITEMS} JOIN n_order_payments USING (order_id) GROUP BY 1""",
    "fn_year_month_label": f"SELECT {_LABEL} AS label, count(*) AS days FROM dim_waktu GROUP BY 1",
    "fn_short_month_label": f"""SELECT {_SHORT.format(m="bulan", y="tahun")} AS label,
  count(*) AS days FROM dim_waktu GROUP BY 1""",
    "fn_period_description": f"""
SELECT 'Pelanggan aktif bertransaksi' || period AS label, count(*) AS days FROM (
  SELECT ' di ' || {_LONG} || ' ' || CAST(tahun AS VARCHAR) AS period FROM dim_waktu
  UNION ALL SELECT ' di tahun ' || CAST(tahun AS VARCHAR) FROM dim_waktu
  UNION ALL SELECT ' di bulan ' || {_LONG} FROM dim_waktu
  UNION ALL SELECT '' FROM dim_waktu) x GROUP BY 1""",
    "fn_elapsed_days": """
SELECT (epoch(order_delivered_customer_date) - epoch(order_purchase_timestamp)) / 86400 AS days,
  count(*) AS orders FROM n_orders GROUP BY 1""",
    "fn_safe_ratio": f"""SELECT kategori,
  CASE WHEN sum(jumlah) > 0 THEN {_REVENUE} / CAST(sum(jumlah) AS DOUBLE) ELSE 0 END AS ratio
FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY kategori""",
    "etl_cleanse": "SELECT * FROM n_orders WHERE order_id IS NOT NULL",
    "build_dim_waktu": "SELECT * FROM dim_waktu",
    "build_dim_produk": """SELECT produk_key, produk_id, kategori, kategori_inggris, panjang, berat
FROM dim_produk""",
    "build_dim_pelanggan": "SELECT pelanggan_key, pelanggan_id, kota, state FROM dim_pelanggan",
    "build_dim_seller": "SELECT seller_key, seller_id, kota, state FROM dim_seller",
    "build_dim_metode": "SELECT metode_key, metode_pembayaran FROM dim_metode_pembayaran",
    "surrogate_keys": """SELECT c_custkey AS customer_id, c_name AS customer_code,
  row_number() OVER (ORDER BY c_custkey) AS key FROM customer""",
    "build_fakta_penjualan": "SELECT * FROM fakta_penjualan",
    "build_fakta_pengiriman": "SELECT * FROM fakta_pengiriman",
    "build_fakta_pembayaran": "SELECT * FROM fakta_pembayaran",
    "build_fakta_review": "SELECT * FROM fakta_review",
    "build_fakta_seller": "SELECT * FROM fakta_seller",
    "rank_seller_volume": """
SELECT seller_id AS label, CAST(sum(jumlah_terjual) AS BIGINT) AS jumlah_terjual
FROM fakta_seller JOIN dim_seller USING (seller_key) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "check_foreign_keys": _foreign_keys(),
    "check_unique_keys": _unique_keys(),
    "filter_years": "SELECT DISTINCT tahun FROM dim_waktu ORDER BY tahun DESC",
    "filter_months": "SELECT DISTINCT bulan FROM dim_waktu ORDER BY bulan",
    "filter_categories": """SELECT DISTINCT kategori_inggris FROM dim_produk
WHERE kategori_inggris IS NOT NULL AND kategori_inggris <> '' ORDER BY 1""",
    "filter_states": """SELECT DISTINCT state FROM dim_pelanggan
WHERE state IS NOT NULL AND state <> '' ORDER BY 1""",
    "kpi_customers_all": "SELECT count(*) AS total_customers FROM dim_pelanggan",
    "kpi_customers_active": f"""SELECT count(DISTINCT pelanggan_key) AS total_customers
{_SALES} WHERE w.tahun = 1997""",
    "kpi_products": f"SELECT count(DISTINCT produk_key) AS total_products {_SALES}",
    "kpi_categories": f"SELECT count(DISTINCT p.kategori_inggris) AS total_categories {_SALES}",
    "kpi_units": f"SELECT CAST(coalesce(sum(jumlah), 0) AS BIGINT) AS total_orders {_SALES}",
    "kpi_revenue": f"SELECT coalesce({_REVENUE}, 0) AS total_revenue {_SALES}",
    "kpi_avg_delivery": f"""SELECT round(avg(durasi_pengiriman), 2) AS avg_delivery_days
{_DELIVERY}""",
    "kpi_sales_summary": f"""SELECT count(DISTINCT pelanggan_key) AS total_customers,
  count(DISTINCT produk_key) AS total_products,
  CAST(coalesce(sum(jumlah), 0) AS BIGINT) AS total_orders,
  coalesce({_REVENUE}, 0) AS total_revenue {_SALES}""",
    "payment_method_counts": f"""SELECT metode_pembayaran, count(*) AS jumlah {_PAYMENT}
GROUP BY 1""",
    "payment_share": f"""SELECT metode_pembayaran, jumlah,
  CAST(jumlah * 100 AS DOUBLE) / CAST(sum(jumlah) OVER () AS DOUBLE) AS persen
FROM (SELECT metode_pembayaran, count(*) AS jumlah {_PAYMENT} GROUP BY 1) x""",
    "top10_products": f"""SELECT p.produk_id AS label, {_UNITS} AS total_qty {_SALES}
GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10""",
    "top10_categories": f"""SELECT p.kategori_inggris AS label, {_UNITS} AS total_qty {_SALES}
GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10""",
    "top5_states_all": """SELECT state, count(*) AS total_customers FROM dim_pelanggan
WHERE state IS NOT NULL AND state <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "top5_states_active": f"""SELECT c.state, count(DISTINCT pelanggan_key) AS total_customers
{_SALES} WHERE c.state IS NOT NULL AND c.state <> '' AND w.tahun = 1997
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "sales_by_day": f"""SELECT w.tanggal AS label, {_REVENUE} AS revenue, {_UNITS} AS qty,
  CAST(day(w.tanggal) AS VARCHAR) || ' ' || strftime(w.tanggal, '%b') AS display_label
{_SALES} WHERE w.tahun = 1997 AND w.bulan = 5 GROUP BY w.tanggal ORDER BY 1""",
    "sales_by_month": f"""SELECT w.bulan, {_REVENUE} AS revenue, {_UNITS} AS qty,
  lpad(CAST(w.bulan AS VARCHAR), 2, '0') AS display_label
{_SALES} WHERE w.tahun = 1997 GROUP BY w.bulan ORDER BY 1""",
    "sales_by_year": f"""SELECT w.tahun, {_REVENUE} AS revenue, {_UNITS} AS qty,
  CAST(w.tahun AS VARCHAR) AS display_label
{_SALES} WHERE w.bulan = 5 GROUP BY w.tahun ORDER BY 1""",
    "sales_by_year_month": f"""SELECT tahun, bulan, {_REVENUE} AS revenue, {_UNITS} AS qty,
  {_LABEL} AS display_label {_SALES} GROUP BY tahun, bulan ORDER BY 1, 2""",
    "sales_by_period": f"""SELECT {_LABEL} AS display_label, {_REVENUE} AS revenue,
  {_UNITS} AS qty {_SALES} GROUP BY tahun, bulan ORDER BY 1""",
    "avg_delivery_state": f"""SELECT c.state, round(avg(durasi_pengiriman), 2) AS avg_delivery_days
{_DELIVERY} GROUP BY 1""",
    "avg_delivery_category": f"""SELECT p.kategori_inggris AS kategori,
  count(*) AS total_pengiriman, round(avg(durasi_pengiriman), 2) AS rata_rata_hari_pengiriman
{_DELIVERY} GROUP BY 1""",
    "rating_by_year": f"""SELECT w.tahun AS label, round(avg(skor_review), 2) AS avg_rating
{_REVIEW} GROUP BY 1 ORDER BY 1""",
    "rating_by_month": f"""SELECT {_LABEL} AS label, round(avg(skor_review), 2) AS avg_rating
{_REVIEW} GROUP BY 1 ORDER BY 1""",
    "top10_sellers_units": f"""SELECT s.seller_id AS label, {_UNITS} AS total_qty,
  {_REVENUE} AS total_revenue {_SELLERS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "top10_sellers_revenue": f"""SELECT s.seller_id AS label, {_UNITS} AS total_qty,
  {_REVENUE} AS total_revenue {_SELLERS} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""",
    "top10_customers_revenue": f"""
SELECT coalesce(c.pelanggan_id, CAST(f.pelanggan_key AS VARCHAR)) AS label,
  {_REVENUE} AS total_revenue
FROM fakta_penjualan f LEFT JOIN dim_pelanggan c ON f.pelanggan_key = c.pelanggan_key
JOIN dim_waktu w USING (waktu_id) JOIN dim_produk p USING (produk_key)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "geo_customers_all": """SELECT state, count(*) AS jumlah FROM dim_pelanggan
WHERE state IS NOT NULL AND state <> '' GROUP BY 1""",
    "geo_sellers_all": """SELECT state, count(*) AS jumlah FROM dim_seller
WHERE state IS NOT NULL AND state <> '' GROUP BY 1""",
    "geo_customers_active": f"""SELECT c.state, count(DISTINCT pelanggan_key) AS jumlah
{_SALES} WHERE c.state IS NOT NULL AND c.state <> '' AND w.tahun = 1997 GROUP BY 1""",
    "geo_buyers_by_seller_state": """SELECT s.state, count(DISTINCT pelanggan_key) AS jumlah
FROM fakta_penjualan f JOIN dim_waktu w USING (waktu_id) JOIN dim_produk p USING (produk_key)
JOIN dim_seller s USING (seller_key)
WHERE s.state IS NOT NULL AND s.state <> '' AND w.tahun = 1997 GROUP BY 1""",
    "geo_payment_semi": f"""SELECT c.state, count(DISTINCT f.pelanggan_key) AS jumlah
{_SALES} WHERE c.state IS NOT NULL AND c.state <> '' AND EXISTS (
  SELECT 1 FROM fakta_pembayaran b JOIN dim_metode_pembayaran m USING (metode_key)
  WHERE m.metode_pembayaran = 'high'
  AND b.waktu_id = f.waktu_id AND b.pelanggan_key = f.pelanggan_key)
GROUP BY 1""",
    "geo_enrich": "SELECT * FROM located",
    "geo_marker_scale": """SELECT state, jumlah, norm, sqrt(norm) AS scaled,
  15000 + sqrt(norm) * (200000 - 15000) AS radius,
  CAST(round(6 + sqrt(norm) * 12) AS INT) AS pixel_radius,
  CASE WHEN jumlah / max >= 0.66 THEN '#e74c3c' WHEN jumlah / max >= 0.33 THEN '#f1c40f'
    ELSE '#2ecc71' END AS color
FROM (SELECT *, CASE WHEN max = min(jumlah) OVER () THEN 0.5
  ELSE (jumlah - min(jumlah) OVER ()) / (max - min(jumlah) OVER ()) END AS norm FROM located) x""",
    "trend_monthly": "SELECT tahun, bulan, total_penjualan, jumlah_transaksi FROM months",
    "top5_categories": f"""SELECT kategori, kategori_inggris, {_REVENUE} AS total, {_UNITS} AS qty
FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY 1, 2
ORDER BY 3 DESC, 1 NULLS LAST, 2 NULLS LAST LIMIT 5""",
    "bottom5_categories": f"""SELECT kategori, kategori_inggris, {_REVENUE} AS total,
  {_UNITS} AS qty FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY 1, 2
ORDER BY 3, 1 NULLS LAST, 2 NULLS LAST LIMIT 5""",
    "review_summary": """SELECT round(avg(skor_review), 2) AS rata2, count(*) AS jumlah_review,
  count(*) FILTER (WHERE skor_review <= 2) AS review_rendah FROM fakta_review""",
    "delivery_summary": "SELECT round(avg(durasi_pengiriman), 1) AS rata2 FROM fakta_pengiriman",
    "slowest_cities": "SELECT * FROM slow",
    "payment_mix": "SELECT * FROM mix",
    "last_period": "SELECT tahun, bulan FROM months ORDER BY tahun DESC, bulan DESC LIMIT 1",
    "linear_fit_monthly": """
SELECT 'penjualan' AS metric, n, round(b, 4) AS slope, round(a, 2) AS intercept, n >= 2 AS valid
FROM fit
UNION ALL SELECT 'transaksi', n, round(b_count, 4), round(a_count, 2), n >= 2 FROM fit""",
    "forecast_3m": """SELECT ke, CAST(year(month) AS INT) AS tahun, CAST(month(month) AS INT) AS bulan,
  round(penjualan, 2) AS penjualan, transaksi FROM projection""",
    "growth_direction": "SELECT round(persen, 6) AS persen, arah FROM growth",
    "category_trend": """SELECT kategori, round(persen, 6) AS persen, rata
FROM categories""",
    "category_movers": "SELECT side, rank, kategori, round(persen, 6) AS persen FROM movers",
    "recommendations": """
SELECT * FROM (
  SELECT CASE arah WHEN 'turun' THEN 'R1a' WHEN 'naik' THEN 'R1b' ELSE 'R1c' END AS rule_id,
    1 AS seq, CASE arah WHEN 'turun' THEN 'Tinggi' ELSE 'Sedang' END AS priority,
    'Penjualan' AS area, arah AS subject, round(persen, 1) AS metric FROM growth
  UNION ALL SELECT 'R2', 10 + rank, 'Tinggi', 'Produk', kategori, round(persen, 1)
    FROM movers WHERE side = 'turun' AND persen < -2
  UNION ALL SELECT 'R3', 20 + rank, 'Sedang', 'Produk', kategori, round(persen, 1)
    FROM movers WHERE side = 'naik' AND persen > 2
  UNION ALL SELECT 'R4', 31, 'Tinggi', 'Kepuasan Pelanggan', NULL, round(share, 1) FROM (
    SELECT 100 * count(*) FILTER (WHERE skor_review <= 2) / count(*) AS share FROM fakta_review)
    WHERE share > 15
  UNION ALL SELECT 'R5', 41, 'Sedang', 'Logistik',
    coalesce(kota, '') || ' (' || coalesce(state, '') || ')', rata_rata_hari
    FROM (SELECT * FROM slow
      ORDER BY rata_rata_hari DESC NULLS FIRST, kota NULLS LAST, state NULLS LAST LIMIT 1) s
    WHERE rata_rata_hari > 1.3 * (SELECT round(avg(durasi_pengiriman), 1) FROM fakta_pengiriman)
  UNION ALL SELECT 'R6', 51, 'Rendah', 'Pembayaran', metode_pembayaran, round(share, 1) FROM (
    SELECT metode_pembayaran, jumlah, 100 * jumlah / sum(jumlah) OVER () AS share FROM mix
    ORDER BY jumlah DESC, metode_pembayaran LIMIT 1) WHERE share > 60) r""",
    "forecast_series": f"""
SELECT x AS seq, {_SHORT.format(m="bulan", y="tahun")} AS label,
  round(total_penjualan, 2) AS historis,
  CASE WHEN x = max(x) OVER () AND total_penjualan <> 0 THEN round(total_penjualan, 2) END
    AS proyeksi FROM months
UNION ALL SELECT seq, {_SHORT.format(m="month(month)", y="year(month)")} || ' (proy.)', NULL,
  round(penjualan, 2) FROM projection""",
    # Star side of the pairs
    "star_sales_by_category": f"""SELECT kategori, kategori_inggris, {_REVENUE} AS total,
  count(*) AS cnt FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY 1, 2""",
    "star_customer_analysis": f"""SELECT state, kota,
  count(DISTINCT pelanggan_key) AS jumlah_pelanggan, {_REVENUE} AS total_belanja
FROM fakta_penjualan JOIN dim_pelanggan USING (pelanggan_key) GROUP BY 1, 2""",
    "star_monthly_trend": f"""SELECT tahun, bulan, {_REVENUE} AS total,
  count(*) AS jumlah_transaksi
FROM fakta_penjualan JOIN dim_waktu USING (waktu_id) GROUP BY 1, 2""",
    "star_review_by_product": """SELECT kategori, round(avg(skor_review), 2) AS rata_rata_skor,
  count(*) AS jumlah_review FROM fakta_review JOIN dim_produk USING (produk_key) GROUP BY 1""",
    "star_delivery_by_city": """SELECT kota, state, round(avg(durasi_pengiriman), 1)
  AS rata_rata_hari, count(*) AS jumlah_pengiriman
FROM fakta_pengiriman JOIN dim_pelanggan USING (pelanggan_key) GROUP BY 1, 2""",
    "star_payment_methods": """SELECT metode_pembayaran, count(*) AS jumlah
FROM fakta_pembayaran JOIN dim_metode_pembayaran USING (metode_key) GROUP BY 1""",
    "star_top_products": f"""SELECT produk_id AS label, {_UNITS} AS total_qty
FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "star_top_customer_states": """SELECT state, count(*) AS total_customers FROM dim_pelanggan
WHERE state IS NOT NULL AND state <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "star_rating_by_year": """SELECT tahun AS label, round(avg(skor_review), 2) AS avg_rating
FROM fakta_review JOIN dim_waktu USING (waktu_id) GROUP BY 1""",
    "star_top_sellers_revenue": f"""SELECT seller_id AS label, {_UNITS} AS total_qty,
  {_REVENUE} AS total_revenue FROM fakta_penjualan JOIN dim_seller USING (seller_key)
GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""",
    "star_top_categories": f"""SELECT kategori_inggris AS label, {_UNITS} AS total_qty
FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY 1
ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10""",
    "star_sales_trend": f"""SELECT tahun, bulan, {_REVENUE} AS revenue, {_UNITS} AS qty
FROM fakta_penjualan JOIN dim_waktu USING (waktu_id) GROUP BY 1, 2""",
    "star_delivery_by_state": """SELECT state, round(avg(durasi_pengiriman), 2)
  AS avg_delivery_days
FROM fakta_pengiriman JOIN dim_pelanggan USING (pelanggan_key) GROUP BY 1""",
    # Operational side of the pairs
    "norm_sales_by_category": f"""SELECT product_category_name, CAST(sum(price) AS DOUBLE) AS total
{_OP_ITEMS} JOIN n_products USING (product_id) JOIN n_customers USING (customer_id)
JOIN n_sellers USING (seller_id) JOIN n_order_payments USING (order_id) GROUP BY 1""",
    "norm_customer_analysis": f"""SELECT customer_state, customer_city,
  count(DISTINCT customer_id) AS jumlah_pelanggan, CAST(sum(price) AS DOUBLE) AS total_belanja
{_OP_ITEMS} JOIN n_customers USING (customer_id) JOIN n_order_payments USING (order_id)
JOIN n_products USING (product_id) GROUP BY 1, 2""",
    "norm_monthly_trend": f"""SELECT {_PLACED}, CAST(sum(price) AS DOUBLE) AS total,
  count(DISTINCT order_id) AS jumlah_transaksi
{_OP_ITEMS} JOIN n_order_payments USING (order_id) GROUP BY 1, 2""",
    "norm_review_by_product": f"""SELECT product_category_name,
  round(avg(review_score), 2) AS rata_rata_skor, count(review_id) AS jumlah_review
{_OP_ITEMS} JOIN n_order_reviews USING (order_id) JOIN n_products USING (product_id)
GROUP BY 1""",
    "norm_delivery_by_city": f"""SELECT customer_city, customer_state,
  round({_EPOCH_DAYS}, 1) AS rata_rata_hari, count(*) AS jumlah_pengiriman
{_OP_ITEMS} JOIN n_customers USING (customer_id) JOIN n_sellers USING (seller_id)
JOIN n_products USING (product_id) JOIN n_order_payments USING (order_id) GROUP BY 1, 2""",
    "norm_payment_methods": """SELECT payment_type AS metode_pembayaran, count(*) AS jumlah
FROM n_order_payments WHERE payment_type IS NOT NULL GROUP BY 1""",
    "norm_top_products": f"""SELECT product_id AS label, count(*) AS total_qty
{_OP_ITEMS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "norm_top_customer_states": """SELECT customer_state AS state, count(*) AS total_customers
FROM n_customers WHERE customer_state IS NOT NULL AND customer_state <> ''
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "norm_rating_by_year": """
SELECT CAST(year(order_purchase_timestamp) AS INT) AS label,
  round(avg(review_score), 2) AS avg_rating
FROM n_order_reviews JOIN n_orders USING (order_id) GROUP BY 1""",
    "norm_top_sellers_revenue": f"""SELECT seller_id AS label, count(*) AS total_qty,
  CAST(sum(price) AS DOUBLE) AS total_revenue {_OP_ITEMS}
GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""",
    "norm_top_categories": f"""SELECT product_category_name AS label, count(*) AS total_qty
{_OP_ITEMS} JOIN n_products USING (product_id) GROUP BY 1
ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10""",
    "norm_sales_trend": f"""SELECT {_PLACED}, CAST(sum(price) AS DOUBLE) AS revenue,
  count(*) AS qty {_OP_ITEMS} GROUP BY 1, 2""",
    "norm_delivery_by_state": f"""SELECT customer_state AS state,
  round({_EPOCH_DAYS}, 2) AS avg_delivery_days
FROM n_orders JOIN n_customers USING (customer_id) GROUP BY 1""",
}
# What the facts must hold, told from the raw tables alone.
QUERIES["reconcile_facts"] = """
SELECT fact, n AS source_rows, total AS source_total, n AS fact_rows, total AS fact_total
FROM (
  SELECT 'fakta_penjualan' AS fact, count(*) AS n,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM lineitem
  UNION ALL SELECT 'fakta_pengiriman', count(*), NULL FROM lineitem
  UNION ALL SELECT 'fakta_pembayaran', count(*) + count(*) FILTER (WHERE o_orderkey % 10 = 0),
    CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) + count(*) FILTER (WHERE o_orderkey % 10 = 0) AS DOUBLE)
  FROM orders
  UNION ALL SELECT 'fakta_review', count(*), NULL
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) x"""
_RAW_ORDERS = """
WITH raw AS (
  SELECT o_orderkey AS k, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS placed, copy,
    CASE WHEN o_orderkey % 100 = 0 AND copy = 2 THEN TIMESTAMP '2001-01-01'
      WHEN o_orderstatus = 'P' THEN NULL
      ELSE CAST(CAST(o_orderdate AS DATE) + CAST(1 + (o_orderkey * 13 + o_custkey) % 60 AS INT) AS TIMESTAMP)
      END AS delivered,
    CASE WHEN o_orderkey % 101 = 0 THEN 'missing' WHEN o_orderkey % 103 = 0 THEN 'not bigint'
      WHEN o_orderkey % 97 = 0 THEN 'not timestamp' END AS fault
  FROM orders, (SELECT unnest([1, 2]) AS copy) c WHERE copy = 1 OR o_orderkey % 50 = 0
)"""
QUERIES["etl_accepted_orders"] = f"""{_RAW_ORDERS}
SELECT k AS order_id, o_custkey AS customer_id, placed AS order_purchase_timestamp,
  nullif(min(coalesce(delivered, TIMESTAMP '1900-01-01')), TIMESTAMP '1900-01-01') AS order_delivered_customer_date
FROM raw WHERE fault IS NULL GROUP BY k, o_custkey, placed"""
QUERIES["etl_cleansing_counts"] = f"""{_RAW_ORDERS}
SELECT * FROM (
  SELECT 'accepted' AS outcome, NULL AS "column", NULL AS reason, count(DISTINCT k) AS rows FROM raw WHERE fault IS NULL
  UNION ALL SELECT 'rejected', 'order_id', 'repeated', count(*) - count(DISTINCT k) FROM raw WHERE fault IS NULL
  UNION ALL SELECT 'rejected', CASE fault WHEN 'not timestamp' THEN 'order_purchase_timestamp' ELSE 'order_id' END, fault, count(*)
  FROM raw WHERE fault IS NOT NULL GROUP BY fault) x WHERE outcome = 'accepted' OR rows > 0"""
QUERIES["join_sales_star_bucketed"] = QUERIES["join_sales_star"]
QUERIES["join_left_customer_bucketed"] = QUERIES["join_left_customer_label"]
QUERIES["pair_rowcounts"] = _pair_counts()
QUERIES["geo_json"] = """
SELECT tipe, data, max, '{"tipe":"' || tipe || '","data":' || data || ',"max":' || max || '}'
  AS document
FROM (SELECT 'pelanggan' AS tipe, max(max) AS max, '[' || string_agg(
    '{"state":"' || state || '","nama":"' || nama || '","jumlah":' || jumlah
    || ',"lat":' || lat || ',"lng":' || lng || '}', ',' ORDER BY jumlah DESC, state)
  || ']' AS data FROM located) d"""


def _needed(sql: str) -> list[str]:
    """Tables that ``sql`` depends on, in the order of ``TABLES``."""
    found: set[str] = set()
    texts = [sql]
    while texts:
        words = set(re.findall(r"\w+", texts.pop()))
        new = {t for t in TABLES if t in words} - found
        found |= new
        texts += [TABLES[t] for t in new]
    return [t for t in TABLES if t in found]


def _with_tables(sql: str) -> str:
    tables = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in _needed(sql))
    return f"WITH {tables}\n{sql.strip()}" if tables else sql.strip()


ORACLES = {key: _with_tables(sql) for key, sql in QUERIES.items()}
