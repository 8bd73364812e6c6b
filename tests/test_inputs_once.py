"""What steps that follow each other make once."""

from hearthline.operators import history as hist, valuation as val
from hearthline.plans import recompute
from hearthline.sources.adapter import AS_OF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_appended_records_are_summarised_once(spark, tables, tmp_path):
    path = str(tmp_path / "records-appended")
    tables.price_history.where("id % 9 = 0").write.parquet(path)
    stored = hist.history_summary(tables.price_history.where("id % 9 <> 0"))
    appended = spark.read.parquet(path)
    assert "price_czk" in plan(appended)
    merged = plan(hist.update_summary(stored, appended, tables.price_history))
    assert merged.count("Join FullOuter") == 0  # joined and written before, not planned again with the result


def test_recompute_reads_its_inputs_from_one_written_table(tables, monkeypatch, tmp_path):
    seen = []
    monkeypatch.setattr(recompute, "stored_summary", lambda *a: None)
    monkeypatch.setattr(recompute, "recompute_steps", lambda listing, detail, *a: seen.extend([listing, detail]) or iter(()))
    recompute.run_full_recompute(tables.listing, tables.listing_detail, tables.price_history, None, AS_OF, str(tmp_path), raise_failure=True)
    assert all("Join" not in plan(df) and "Aggregate" not in plan(df) for df in seen) and len(seen) == 2


def test_rows_are_joined_to_small_cells_only(tables, monkeypatch):
    written = {}
    real = val.cut_lineage
    monkeypatch.setattr(val, "cut_lineage", lambda df, name: written.setdefault(name, real(df, name)))
    val.segment_rows(tables.listing, tables.listing_detail)
    cells = [df for df in written.values() if "cell_n" in df.columns]
    assert len(cells) == 1 and cells[0].where(f"cell_n >= {val.MIN_CELL}").count() == 0
