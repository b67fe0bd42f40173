from panel_helpers import make_panel, walk
from panelspark.plans import jobs


def test_features_are_worked_out_once_for_the_model_table(spark, monkeypatch):
    """Counting the columns' values and reading the table must not run the windows twice."""
    panel = make_panel(spark, {"A": walk(160, 1), "B": walk(160, 2)})
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    block = jobs.FE.feature_label_block

    def counted(*a, **kw):
        x = block(*a, **kw)
        return x.mapInArrow(look, x.schema)

    monkeypatch.setattr(jobs.FE, "feature_label_block", counted)
    x, targets, feats, dropped = jobs.feature_table(panel)
    n = x.count()
    assert 0 < n < 320 and x.count() == n and seen.value == 320
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
