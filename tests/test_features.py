"""Edge cases S1-S6: zero denominators, log1p(x <= -1), all-NULL rows, presence guard."""

import math

from dialsift.operators import features


def test_edge_ratios(spark):
    cols = "AVG_GestEfect_CallOut_3UM double, AVG_GestTotales_CallOut_3UM double, dias_mora_cartera double, " \
           "capitalactualsol double, Edad double"
    rows = [
        (1.0, -1e-6, 0.0, -2.0, 30.0),   # denominator + 1e-6 == 0 -> NULL
        (1.0, 0.0, -1.0, 5.0, 40.0),     # dias + 1 == 0 -> NULL density
        (None, 2.0, 3.0, None, None),
        (2.0, 4.0, 1.0, 9.0, 50.0),
    ]
    df = spark.createDataFrame(rows, cols)
    out, created = features.add_features(df)
    got = {c: [r[c] for r in out.select(created).collect()] for c in created}
    assert got["Ratio_Efectividad_3UM"][0] is None
    assert math.isclose(got["Ratio_Efectividad_3UM"][1], 1.0 / 1e-6)
    assert got["Ratio_Efectividad_3UM"][2] is None
    assert got["Densidad_Gestiones_por_DiaMora_3UM"][1] is None
    assert got["Interaccion_Capital_DiaMora"][0] is None  # log1p(-2) is NULL
    assert math.isclose(got["Interaccion_Edad_Capital"][3], 50.0 * math.log1p(9.0))
    # presence guard: no 6UM/9UM/12UM inputs -> no features for them
    assert "Ratio_Efectividad_6UM" not in created


def test_row_aggregates_all_null(spark):
    cols = ", ".join(f"AVG_GEST_WPP_OUT_{p} double" for p in ("3UM", "6UM", "9UM", "12UM"))
    cols += ", AVG_GestEfect_CallOut_3UM double"
    df = spark.createDataFrame([(None, None, None, None, None), (1.0, None, 3.0, None, 2.0)], cols)
    out, _ = features.add_features(df, ["aggregation"])
    r = out.collect()
    assert r[0]["Promedio_WhatsApp_AllPeriods"] is None
    assert r[0]["Total_GestEfect_AllPeriods"] == 0.0
    assert r[1]["Promedio_WhatsApp_AllPeriods"] == 2.0
    assert r[1]["Total_GestEfect_AllPeriods"] == 2.0


def test_create_all_fills_median(spark):
    cols = "AVG_GestEfect_CallOut_3UM double, AVG_GestTotales_CallOut_3UM double"
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, -1e-6), (4.0, 3.0)], cols)
    out, created, med = features.create_all_features(df, ["ratio"])
    vals = sorted(r["Ratio_Efectividad_3UM"] for r in out.collect())
    # NULL replaced by the median of the three present values
    assert med["Ratio_Efectividad_3UM"] is not None
    assert None not in vals
