from tablero import plans


def plan(spark, small, name):
    return plans.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_equal_cells_are_read_once(spark, small):
    """Cells are counted before they are parsed: no parsing below the lower aggregate."""
    lines = plan(spark, small, "shot_cell_parse")
    at = lambda what: max(i for i, line in enumerate(lines) if what in line)
    assert at("regexp_extract") <= at("Aggregate")


def test_phases_deal_rows_once(spark, small):
    """One shuffle of the rows on each side of the join with the team's totals, and one of the averages."""
    text = plans.queries()["player_phases"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 3
