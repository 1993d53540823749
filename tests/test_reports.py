"""Report tables on fixtures."""

from __future__ import annotations

from wardlake.operators import reports


def test_hunt_suggestions_rank_all_techniques(spark):
    """A rare technique with a critical detection ranks first behind 60 busier ones, and an active one without a live rule is no pure gap."""
    rows = [(f"T{1000 + i}", f"name {i}", "tactic", "TA1", "low", 10) for i in range(60) for _ in range(3)]
    rows += [("T9000", "rare", "tactic", "TA1", "critical", 10), ("T9001", "no rule", "tactic", "TA1", "low", 10), ("T9001", "no rule", "tactic", "TA1", "low", 10)]
    det = spark.createDataFrame(rows, "technique_id string, technique_name string, tactic string, tactic_id string, severity string, time_us long")
    rules = spark.createDataFrame([(f'["T{1000 + i}"]', True) for i in range(60)] + [('["T9000"]', True), ('["T9001"]', False), *[(f'["T{8000 + i}"]', False) for i in range(8)]], "technique_ids string, enabled boolean")
    got = [(r["technique_id"], r["count"], r["priority"]) for r in reports.hunt_suggestions(det, rules, 0, limit=100).collect()]
    assert got[:2] == [("T9001", 2, "high"), ("T9000", 1, "high")]
    assert len(got) == 70 and [x for x in got if x[1] == 0] == [(f"T{8000 + i}", 0, "low") for i in range(8)]
    cut = reports.hunt_suggestions(det, rules, 0, limit=100, top=50, gap_limit=5).collect()
    assert len(cut) == 55 and "T9000" not in {r["technique_id"] for r in cut}
