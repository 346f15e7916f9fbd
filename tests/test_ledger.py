"""What the ledger says of a request: one case for each decision."""

from tabulon.operators import transactions as X


def test_idempotency(spark):
    ledger = spark.createDataFrame([("p", "a", "committed"), ("p", "a", "committed"), ("p", None, "committed"), ("p", "b", "failed"), ("q", "a", "failed"), (None, "a", "committed")], "plan string, region string, status string")
    asked = [("p", "a", True), ("p", "b", True), ("p", "b", False), ("p", "c", None), ("p", None, False), ("q", "a", False), (None, "a", True)]
    requests = spark.createDataFrame(asked, "plan string, region string, region_empty boolean")
    got = sorted(((r.plan, r.region, r.decision, r.n_committed) for r in X.idempotency(requests, ledger).collect()), key=str)
    assert got == sorted([
        ("p", "a", "already_applied", 3), ("p", "b", "safe_to_reapply", 3), ("p", "b", "conflict", 3), ("p", "c", "conflict", 3), ("p", None, "conflict", 3), ("q", "a", "first_run", 0), (None, "a", "first_run", 0),
    ], key=str)
    assert {r.decision for r in X.idempotency(requests, ledger.where("false")).collect()} == {"first_run"}
