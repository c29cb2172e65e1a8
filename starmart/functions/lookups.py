"""Constant relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, latitude, longitude and name of Brazil's 27 federative units.
STATE_COORDINATES = [
    ("SP", -23.5505, -46.6333, "São Paulo"),
    ("RJ", -22.9068, -43.1729, "Rio de Janeiro"),
    ("MG", -19.9167, -43.9345, "Minas Gerais"),
    ("RS", -30.0346, -51.2177, "Rio Grande do Sul"),
    ("PR", -25.4284, -49.2733, "Paraná"),
    ("SC", -27.5954, -48.5480, "Santa Catarina"),
    ("BA", -12.9714, -38.5014, "Bahia"),
    ("DF", -15.7801, -47.9292, "Distrito Federal"),
    ("GO", -16.6869, -49.2648, "Goiás"),
    ("PE", -8.0476, -34.8770, "Pernambuco"),
    ("CE", -3.7172, -38.5433, "Ceará"),
    ("PA", -1.4558, -48.4902, "Pará"),
    ("MA", -2.5307, -44.3068, "Maranhão"),
    ("ES", -20.3155, -40.3088, "Espírito Santo"),
    ("MT", -15.6014, -56.0979, "Mato Grosso"),
    ("MS", -20.4483, -54.6326, "Mato Grosso do Sul"),
    ("AM", -3.1190, -60.0217, "Amazonas"),
    ("RN", -5.7945, -35.2110, "Rio Grande do Norte"),
    ("PB", -7.1195, -36.8235, "Paraíba"),
    ("AL", -9.5713, -36.7820, "Alagoas"),
    ("SE", -10.9472, -37.0731, "Sergipe"),
    ("PI", -5.0920, -42.8038, "Piauí"),
    ("RO", -8.7612, -63.9020, "Rondônia"),
    ("TO", -10.1753, -48.2982, "Tocantins"),
    ("AC", -9.9740, -67.8076, "Acre"),
    ("AP", 0.9020, -52.0030, "Amapá"),
    ("RR", 2.8235, -60.6758, "Roraima"),
]


def state_coordinates(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        f"('{code}', {lat}D, {lng}D, '{name}')" for code, lat, lng, name in STATE_COORDINATES
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS states(code, lat, lng, nama)")
