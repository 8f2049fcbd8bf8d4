"""KPIs, stores, and the whole claims run on a small hand-made data set."""

from datetime import datetime

import pytest

from encoder_helper import trigram_encoder
from pyspark.sql import functions as F

from ledgerlens.operators import kpi
from ledgerlens.operators import drift
from ledgerlens.plans import batch, claims
from ledgerlens.sources.drift_store import DriftStore
from ledgerlens.sources.runs import RunStore
from ledgerlens.sources.tables import export_csv

# The result tables of a run.
RESULTS = """auftragsdaten issues metric_above_50k
metric_cleanliness_cols_grouped_auftragsdaten
metric_cleanliness_cols_ungrouped_auftragsdaten
metric_cleanliness_cols_ungrouped_positionsdaten
metric_cleanliness_rows_grouped_auftragsdaten metric_comparison metric_discount_details
metric_discount_stats metric_empty_orders_dataframe metric_error_heatmap
metric_fn_details_df1 metric_fn_details_df2 metric_fn_stats_df2 metric_fn_stats_df1
metric_handwerker_outliers metric_null_ratios_per_column metric_order_pos_mismatch
metric_outliers_by_damage metric_plausibility_diffs_auftragsdaten
metric_plausibility_diffs_positionsdaten metric_positions_over_time
metric_position_count_positionsdaten metric_proforma metric_semantic_mismatches
metric_test_data_entries metric_zeitwert_errors positionsdaten scalar_metrics""".split()


def long(spark, data):
    return spark.createDataFrame(data, "metric string, value double")


def test_comparison_rules(spark, rows):
    now = long(spark, [("a", 0.0), ("b", 5.0), ("c", 5.0), ("d", 7.0), ("e", 2.0)])
    old = long(spark, [("a", 0.0), ("b", 0.0), ("c", 4.0), ("e", 3.0)])
    found = kpi.compare_runs(now, old)
    assert rows(found, "metric", "old_value", "absolute_change", "percent_change") == [
        ("a", 0.0, 0.0, 0.0), ("b", 0.0, 5.0, 100.0), ("c", 4.0, 1.0, 25.0),
        ("d", 0.0, 7.0, 100.0), ("e", 3.0, -1.0, -33.33)]
    first = kpi.compare_runs(now, None)
    assert {r["old_value"] for r in first.collect()} == {0.0}
    same = kpi.compare_runs(now, now)
    assert {r["percent_change"] for r in same.collect()} == {0.0}
    assert rows(kpi.delta_text(found, "e"), "delta") == [("-33.33%",)]
    assert rows(kpi.delta_text(found, "unknown"), "delta") == [(None,)]


def test_wide_to_long_types(spark):
    row = spark.sql(
        "SELECT 3L AS n, true AS yes, false AS no, CAST(NULL AS DOUBLE) AS empty, 'x' AS t, 1.5D AS d"
    )
    assert {r["metric"]: r["value"] for r in kpi.to_long(row).collect()} == {
        "n": 3.0, "yes": 1.0, "no": 0.0, "empty": 0.0, "t": 0.0, "d": 1.5}


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    assert store.manifest().count() == 0 and store.previous("r2") is None
    df = spark.range(3)
    for run in ("r1", "r2", "r3"):
        store.write(run, {"t": df, "u": df})
    assert [r[0] for r in store.names("r2").collect()] == ["t", "u"]
    assert store.previous("r3") == "r2"
    store.put("r4", "half", df)
    assert not store.has("r4", "half") and store.read("r4", "half").count() == 3
    assert store.drop_older("r3") == ["r1"]
    assert not (tmp_path / "run_id=r1").exists() and (tmp_path / "run_id=r2").exists()
    assert not store.has("r1", "t") and store.has("r2", "t")
    assert [r[0] for r in store.current_and_previous().collect()] == ["r3", "r2"]


def test_types_are_a_contract_between_runs(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    base = spark.range(3).select(F.col("id").alias("n"), F.lit("x").alias("s"))

    def run(run_id, type_name, **more):
        df = base.withColumn("n", F.col("n").cast(type_name))
        RunStore(spark, str(tmp_path)).write(run_id, {"t": df.withColumns(more)})

    run("r1", "byte")
    run("r2", "int", extra=F.lit(1.5).cast("float"))
    run("r3", "byte", extra=F.lit(2).cast("short"))  # would fit a narrower type again
    assert dict(store.read("r1", "t").dtypes)["n"] == "tinyint"
    assert dict(store.read("r3", "t").dtypes) == {"n": "int", "s": "string", "extra": "double"}
    whole = store.read_all("t")
    assert dict(whole.dtypes) == {"n": "int", "s": "string", "extra": "double", "run_id": "string"}
    found = whole.groupBy("run_id").agg(F.sum("n"), F.sum("extra")).orderBy("run_id").collect()
    assert [tuple(r) for r in found] == [("r1", 3, None), ("r2", 3, 4.5), ("r3", 3, 6.0)]
    store.drop_older("r3")  # the types of the dropped run stay
    again = RunStore(spark, str(tmp_path)).contract()["t"]
    assert {f.name: f.dataType.simpleString() for f in again} == {"n": "int", "s": "string", "extra": "double"}
    with pytest.raises(TypeError, match="column n of t"):
        run("r4", "string")
    assert RunStore(spark, str(tmp_path / "none")).contract() == {}


def test_drift_store_computes_once(spark, tmp_path):
    store = DriftStore(spark, str(tmp_path / "drift"))
    assert store.catalogue().count() == 0
    calls = []

    def compute():
        calls.append(1)
        return spark.range(len(calls))

    key = ("orders", ("2024-02-01", "2024-01-01"), ("2024-02-01", "2024-03-01"))
    assert store.report(*key, compute).count() == 1
    assert store.report(*key, compute).count() == 1
    assert store.report(*key, compute, refresh=True).count() == 2
    store.report("positions", key[1], key[2], compute)
    assert [tuple(r) for r in store.catalogue().orderBy("source").collect()] == [
        ("orders", "2024-01-01", "2024-02-01", "2024-02-01", "2024-03-01"),
        ("positions", "2024-01-01", "2024-02-01", "2024-02-01", "2024-03-01")]


def test_csv_has_header_and_umlauts(spark, tmp_path):
    path = str(tmp_path / "csv")
    export_csv(spark.createDataFrame([("Müller", 1)], "name string, n int"), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["name", "n"] and back.first()["name"] == "Müller"


ORDER_SCHEMA = """Auftrag_ID string, Schadensnummer string, KvaRechnung_ID string,
KvaRechnung_Nummer string, Forderung_Netto double, Empfehlung_Netto double,
Einigung_Netto double, DH_ID long, Land string, PLZ_SO string, PLZ_HW string, PLZ_VN string,
address1_postalcode string, Schadenart_Name string, Falltyp_Name string, Gewerk_Name string,
Kundengruppe string, Differenz_vor_Zeitwert_Netto double, Handwerker_Name string"""
LINE_SCHEMA = """KvaRechnung_ID string, KvaRechnung_Nummer string, Position_ID string,
Mengeneinheit string, Menge double, Menge_Einigung double, EP double, EP_Einigung double,
Forderung_Netto double, Einigung_Netto double, Bezeichnung string, Bemerkung string"""
TIME_SCHEMA = """Auftrag_ID string, Schadensnummer string, KvaRechnung_ID string,
CRMEingangszeit timestamp_ntz, `Ausgang Vorgang` timestamp_ntz, `Ausgang Order` timestamp_ntz,
`Übergabe Abschluss` timestamp_ntz"""


def order(key, number, claimed, agreed, **over):
    base = {
        "Auftrag_ID": f"A{key}", "Schadensnummer": "S", "KvaRechnung_ID": key,
        "KvaRechnung_Nummer": number, "Forderung_Netto": claimed, "Empfehlung_Netto": agreed,
        "Einigung_Netto": agreed, "DH_ID": 1, "Land": "DE", "PLZ_SO": None, "PLZ_HW": None,
        "PLZ_VN": None, "address1_postalcode": None, "Schadenart_Name": "Leitungswasser",
        "Falltyp_Name": "Kfz", "Gewerk_Name": "Maler", "Kundengruppe": "Gruppe A",
        "Differenz_vor_Zeitwert_Netto":
            None if claimed is None or agreed is None else round(claimed - agreed, 2),
        "Handwerker_Name": "Maler Müller",
    }
    base.update(over)
    return tuple(base.values())


def line(key, number, claimed, agreed, text="Anstrich", **over):
    base = {
        "KvaRechnung_ID": key, "KvaRechnung_Nummer": "N", "Position_ID": number,
        "Mengeneinheit": "m2", "Menge": 1.0, "Menge_Einigung": 1.0, "EP": claimed,
        "EP_Einigung": agreed, "Forderung_Netto": claimed, "Einigung_Netto": agreed,
        "Bezeichnung": text, "Bemerkung": None,
    }
    base.update(over)
    return tuple(base.values())


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("claims")
    orders = [
        order("k1", "N1", 100.0, 90.0),
        order("k2", "N2", 100.0, 120.0, Kundengruppe="KI-Test"),
        order("k3", "N3", 60000.0, 55000.0, Land="-"),
        order("k4", "N4", 2.0, 0.5, Differenz_vor_Zeitwert_Netto=9.0),
        order("k5", "N5", 10.0, 10.0, Gewerk_Name="(leer)"),
        order("k6", "N1", 10.0, -10.0, Empfehlung_Netto=10.0),
        order("k7", "N7", None, 5.0, Gewerk_Name="Elektro"),
    ]
    lines = [
        line("k1", "p1", 60.0, 50.0),
        line("k1", "p2", 40.0, 40.0, text="-"),
        line("k2", "p3", 100.0, 120.0),
        line("k3", "p4", 60000.0, 55000.0, Menge=-1.0),
        line("k4", "p5", 5.0, 2.5),
        line("k4", "p6", -3.0, -2.0, text="Skonto 2%"),
        line("k6", "p7", 10.0, -10.0),
    ]
    times = [
        (f"A{k}", "S", k, datetime(2024, m, 5, 8), None, None, None)
        for k, m in (("k1", 1), ("k2", 1), ("k3", 2), ("k4", 2), ("k5", 3), ("k6", 3))
    ]
    paths = {}
    for name, data, schema in (
        ("orders", orders, ORDER_SCHEMA), ("positions", lines, LINE_SCHEMA),
        ("times", times, TIME_SCHEMA),
    ):
        paths[name] = str(root / name)
        spark.createDataFrame(data, schema).write.parquet(paths[name])
    return paths


def ids(df, column="KvaRechnung_ID"):
    return sorted(r[column] for r in df.collect())


def test_claims_run(spark, sources, tmp_path):
    settings = claims.Settings([("Maler", ["maler"]), ("Elektro", ["elektro"])], trigram_encoder())
    store = claims.run(spark, sources, str(tmp_path / "out"), "2026-01", settings)

    def table(name):
        return store.read("2026-01", name)

    assert sorted(r[0] for r in store.names("2026-01").collect()) == sorted(RESULTS)
    orders = table("auftragsdaten")
    assert "AuftragID" in orders.columns and orders.count() == 7
    assert dict(orders.dtypes)["DH_ID"] == "tinyint"
    assert orders.filter("Land IS NULL").count() == 1
    assert {r[0] for r in orders.select("Falltyp_Name").collect()} == {"KFZ"}
    assert dict(orders.select("KvaRechnung_ID", "PositionsAnzahl").collect())["k5"] is None
    assert table("positionsdaten").filter("Bezeichnung IS NULL").count() == 1

    assert ids(table("metric_test_data_entries")) == ["k2"]
    assert ids(table("metric_above_50k")) == ["k3"]
    assert len(table("metric_above_50k").columns) == 7
    assert ids(table("metric_proforma")) == ["k4"]
    assert ids(table("metric_zeitwert_errors")) == ["k4", "k7"]
    assert ids(table("metric_empty_orders_dataframe")) == ["k5", "k7"]
    assert ids(table("metric_order_pos_mismatch")) == ["k5", "k7"]
    assert ids(table("metric_fn_details_df1")) == ["k6"]
    assert ids(table("metric_plausibility_diffs_auftragsdaten")) == ["k2"]
    assert ids(table("metric_plausibility_diffs_positionsdaten"), "Position_ID") == ["p3", "p6"]
    assert ids(table("metric_fn_details_df2"), "Position_ID") == ["p4", "p7"]
    assert ids(table("metric_discount_details"), "Position_ID") == ["p7"]
    assert {r[0] for r in table("metric_positions_over_time").select("Zeitperiode").collect()} == {
        "2024-01", "2024-02", "2024-03"}
    assert claims.duplicate_numbers(orders).count() == 2

    scalars = table("scalar_metrics").first().asDict()
    assert scalars["count_total_orders"] == 7 and scalars["count_total_positions"] == 7
    assert scalars["is_unique_kva_id"] and not scalars["is_unique_kva_nr_per_land"]
    assert scalars["count_empty_orders"] == 2 and scalars["avg_plausibility_diff_df"] == 20.0
    issues = table("issues").first().asDict()
    assert issues["numeric_issues"] == 2 + 1 + 2
    semantic = table("metric_semantic_mismatches").count()
    assert issues["text_issues"] == 1 + table("metric_handwerker_outliers").count() + semantic
    assert issues["plausi_issues"] == 1 + 2 + 1 + 1 + 1 + 2 + 2
    assert issues["overall_issues"] == (
        issues["numeric_issues"] + issues["text_issues"] + issues["plausi_issues"] + 2)

    first = table("metric_comparison").collect()
    assert {r["Old_Value"] for r in first} == {0.0}
    assert len({r["Metric"] for r in first}) == len(first)

    check_readers(spark, store, tmp_path)

    # the same data again: nothing has changed
    claims.run(spark, sources, str(tmp_path / "out"), "2026-02", settings)
    again = store.read("2026-02", "metric_comparison").collect()
    assert {r["Percent_Change"] for r in again} == {0.0}
    assert len(again) == len(first)


def check_readers(spark, store, tmp_path):
    """Follow-up tables, profiles and drift of a stored run."""
    follow = claims.follow_up(store, "2026-01")
    pct = dict(follow["shares"].collect())
    assert pct["count_zeitwert_errors_pct"] == pytest.approx(2 / 7 * 100)
    assert pct["numeric_issues_pct"] == pytest.approx(5 / 14 * 100)
    months = follow["incidents_by_month"].filter("category = 'Aufträge > 50k'").collect()
    assert [(r["month"], r["incidents"]) for r in months] == [(datetime(2024, 2, 1), 1)]
    assert follow["diff_p95_auftragsdaten"].first()[0] == 20.0
    assert follow["diff_extremes_positionsdaten"].count() == 1
    assert all(df.columns for df in follow.values())

    orders, positions = store.read("2026-01", "auftragsdaten"), store.read("2026-01", "positionsdaten")
    tables = claims.profiles(orders, positions)
    assert tables["numeric_auftragsdaten"].count() == 4
    assert tables["id_format_positionsdaten_Position_ID"].count() == 7
    assert tables["schema_auftragsdaten"].count() == len(orders.columns)

    reports = DriftStore(spark, str(tmp_path / "drift"))
    ranges = {"reference": ("2024-01-01", "2024-02-01"), "current": ("2024-02-01", "2024-04-01")}
    report = claims.drift_report(store, "2026-01", reports, **ranges)
    assert report.count() == 9
    lines = claims.drift_report(store, "2026-01", reports, positions=True)
    assert lines.count() == 7 and reports.catalogue().count() == 2


def test_claims_run_without_encoder_on_clean_data(spark, tmp_path):
    """No errors anywhere: every table exists, typed and empty."""
    paths = {name: str(tmp_path / name) for name in ("orders", "positions", "times")}
    spark.createDataFrame([order("k1", "N1", 10.0, 9.0)], ORDER_SCHEMA).write.parquet(paths["orders"])
    spark.createDataFrame([line("k1", "p1", 10.0, 9.0)], LINE_SCHEMA).write.parquet(paths["positions"])
    time = ("Ak1", "S", "k1", datetime(2024, 1, 5), None, None, None)
    spark.createDataFrame([time], TIME_SCHEMA).write.parquet(paths["times"])
    store = claims.run(spark, paths, str(tmp_path / "out"), "r1", claims.Settings([]))
    assert store.read("r1", "metric_fn_stats_df2").columns == ["Kategorie", "Anzahl"]
    assert store.read("r1", "metric_semantic_mismatches").count() == 0
    issues = store.read("r1", "issues").first()
    assert issues["overall_issues"] == 0
    assert issues["count_semantic_outliers"] is None  # not run is not "no finding"
    again = claims.run(spark, paths, str(tmp_path / "out"), "r2", claims.Settings([]))
    row = again.read("r2", "metric_comparison").filter("Metric = 'count_semantic_outliers'").first()
    assert row["Current_Value"] is None and row["Percent_Change"] is None


def test_sources_are_stored_once_in_two_halves(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, True)], "n int, early boolean")
    batch.store_halves(df, str(tmp_path / "t"))
    whole = spark.read.parquet(str(tmp_path / "t" / "early=*"))
    assert whole.columns == ["n"] and whole.count() == 2
    assert spark.read.parquet(str(tmp_path / "t" / "early=true")).count() == 2
    assert spark.read.parquet(str(tmp_path / "t" / "early=false")).count() == 0


def test_orders_are_stored_once_in_a_run(spark, sources, tmp_path):
    """Trend and counts come from the orders' own column; dates alone go to the positions."""
    store = claims.run(spark, sources, str(tmp_path / "out"), "r1", claims.Settings([]))
    assert not (tmp_path / "out" / "run_id=r1" / "_timed_orders").exists()
    monthly = store.read("r1", "metric_positions_over_time").collect()
    found = {r["Zeitperiode"]: (r["Total_Positionen"], r["Anzahl_Auftraege"]) for r in monthly}
    assert found == {"2024-01": (3, 2), "2024-02": (3, 2), "2024-03": (1, 2)}


def test_two_batch_runs_over_the_small_tables(spark, monkeypatch):
    """Both registered queries read one pair of runs; dates are pruned by month."""
    folder = "/root/testdata/sf0.001"
    store = batch.both_runs(spark, folder)
    monkeypatch.setattr(batch, "both_runs", lambda *_: store)
    counted = batch.table_counts(store).collect()
    assert batch.batch_run_tables(spark, folder).count() == 16
    for run in batch.RUNS:
        assert sorted(r["table_name"] for r in counted if r["run_id"] == run) == sorted(RESULTS)
    rows = {(r["run_id"], r["table_name"]): r["row_count"] for r in counted}
    new = {r["Metric"]: r["Current_Value"] for r in batch.batch_comparison(spark, folder).collect()}
    old = {r["Metric"]: r["Old_Value"] for r in batch.batch_comparison(spark, folder).collect()}
    for run, values in zip(batch.RUNS, (old, new)):
        assert rows[run, "auftragsdaten"] == values["count_total_orders"]
        assert rows[run, "positionsdaten"] == values["count_total_positions"]
        assert rows[run, "metric_above_50k"] == values["count_above_50k"]
        assert rows[run, "metric_empty_orders_dataframe"] == values["count_empty_orders"]
    assert old["count_total_positions"] < new["count_total_positions"]

    orders = store.read(batch.RUNS[1], "auftragsdaten")
    slices = drift._both_slices(
        orders, claims.ORDER_DRIFT, [claims.ORDER.claimed], ("1996-01-01", "1996-03-01"), ("1997-02-01", "1997-03-01")
    )
    plan = slices._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "_month" in filters and "1996-01" in filters and "1997-02" in filters
