from readloom.plans import registry, views


def test_whole_sides_are_zipped(spark, sf_dir):
    """All mates but the last take part, however large the table is."""
    each = views.reads(spark, sf_dir).groupBy("src").count().collect()
    second = next(r["count"] for r in each if r["src"] == 2)
    states = {r["state"]: r["count"] for r in registry.queries()["pair_zip_check_whole"](spark, sf_dir).groupBy("state").count().collect()}
    assert states["pair"] == second - 1 > 150 and states["extra first"] == 1
    trimmed = registry.queries()["trim_surplus_whole"](spark, sf_dir)
    assert trimmed.where("ord % 2 = 1").count() > 150
