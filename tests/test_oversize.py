"""Large pages are listed, the others are only counted."""

from procatlas.operators import maintenance


def test_only_large_pages_are_collected(spark):
    pages = [("R", "A", "p", 3), ("R", "A", "q", 4), ("R", "A", None, 5), ("R", "B", "p", 1), ("R", "C", "x", 2), ("R", "C", "y", 2), ("R", "C", "z", 2), (None, None, "n", 6)]
    rows = [(r, o, "process", p) for r, o, p, n in pages for _ in range(n)] + [("R", "O", "object", "p")] * 9
    found = maintenance.oversize(spark.createDataFrame(rows, "release_id string, owner_id string, owner_type string, page_id string"), 5, 2)
    assert found.columns == ["release_id", "owner_id", "owner_type", "stage_count", "large_pages", "largest_page", "reasons"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("R", "A", "process", 12, 3, 5, ['page "null" has 5', 'page "p" has 3', 'page "q" has 4']), ("R", "C", "process", 6, 0, 2, []),
        (None, None, "process", 6, 1, 6, ['page "n" has 6']),
    ], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    collected = plan[plan.index("collect_list"):]
    assert "Filter (n#" in collected[: collected.index("Relation") if "Relation" in collected else len(collected)]
