"""Fills as transactions: killed after any step they end as before or after, never between."""

import pytest

from tabulon.operators import fills as L

CELLS = "sheet string, row int, col int, value string, formula string, style string"
BEFORE = [("S", 1, 1, "a", None, "p"), ("S", 2, 1, None, "=A1", None), ("S", 3, 1, "c", None, None)]
WRITES = [("S", 1, 1, "new"), ("S", 9, 2, "more")]
AFTER = [("S", 1, 1, "new", None, "p"), ("S", 2, 1, None, "=A1", None), ("S", 3, 1, "c", None, None), ("S", 9, 2, "more", None, None)]


class Killed(BaseException):
    """Nothing of the run is left to clean up."""


@pytest.fixture
def store(spark, tmp_path):
    s = L.FillStore(spark, str(tmp_path / "book"))
    s.create(spark.createDataFrame(BEFORE, CELLS).coalesce(1))
    return s


def writes(spark, rows=WRITES):
    return spark.createDataFrame(rows, "sheet string, row int, col int, value string")


def cells(store):
    return sorted(map(tuple, store.read().collect()))


def test_a_fill_and_again(spark, store):
    got = L.execute(store, "p1", writes(spark))
    assert (got["status"], got["version"], got["write_count"]) == ("committed", 2, 2) and cells(store) == AFTER
    assert [x["step"] for x in store.story(got["operation"])] == L.STEPS
    assert L.execute(store, "p1", writes(spark))["status"] == "already_applied" and store.current()[0] == 2
    assert sorted(map(tuple, store.read(1).collect())) == BEFORE and L.recover(store) == {}
    with pytest.raises(L.FillError):
        store.create(store.read())


@pytest.mark.parametrize("step", L.STEPS[:-1])
def test_killed_after_any_step(spark, store, step):
    def fault(s):
        if s == step:
            raise Killed

    with pytest.raises(Killed):
        L.execute(store, "p1", writes(spark), fault=fault)
    counts = step == "committed"
    assert cells(store) == (AFTER if counts else BEFORE)
    assert list(L.recover(store).values()) == ["done" if counts else "failed"] and L.recover(store) == {}
    assert cells(store) == (AFTER if counts else BEFORE)
    if not counts:
        record = store.story(store._list("journal")[0])[-1]
        assert (record["error_code"], record["stage"], record["status"]) == ("INTERRUPTED", step, "failed") and record["backup"].startswith("cells-")
        assert (record["temp"] == L.MISSING) == (step == "begun") and len([n for n in store._list() if n.startswith("cells-")]) == 1
    assert L.execute(store, "p1", writes(spark))["status"] == ("already_applied" if counts else "committed") and cells(store) == AFTER


def test_anything_else_that_changes_fails(spark, store):
    def careless(old, new):
        return L.filled(old, new).where("row <> 3")

    with pytest.raises(L.FillError) as e:
        L.execute(store, "p1", writes(spark), apply=careless)
    assert e.value.code == "QA_FAILED" and cells(store) == BEFORE
    with pytest.raises(L.FillError) as e:
        L.execute(store, "p1", writes(spark), apply=lambda old, new: old)
    assert e.value.code == "QA_FAILED" and cells(store) == BEFORE
    assert set(store.operations().values()) == {"failed"}


def test_of_two_fills_of_one_version_the_second_fails(spark, store):
    def meanwhile(step):
        if step == "verified":
            L.execute(store, "other", writes(spark, [("S", 3, 1, "first")]))

    with pytest.raises(L.FillError) as e:
        L.execute(store, "p1", writes(spark), fault=meanwhile)
    assert e.value.code == "PLAN_CONFLICT" and ("S", 3, 1, "first", None, None) in cells(store) and ("S", 1, 1, "a", None, "p") in cells(store)


def test_errors_are_told(spark, store):
    with pytest.raises(L.FillError) as e:
        L.execute(store, "p1", writes(spark), apply=lambda old, new: old.select("nothing"))
    assert (e.value.code, e.value.stage) == ("EXECUTION_FAILED", "begun") and cells(store) == BEFORE
