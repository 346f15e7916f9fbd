"""Saved documents and what speaks against them."""

import hashlib

from tabulon.sources import saved


def test_saved_documents(spark, tmp_path):
    files = {
        "map": '{"sheets": [{"name": "S", "rows": 3}, {"name": "T"}]}', "broken": "{", "list": "[1]", "empty": "{}", "fill": '{"plan_id": "' + "a" * 32 + '", "would_write": [], "blocked": [], "preserved": []}',
        "short": '{"plan_id": "abc", "would_write": {}, "blocked": [], "preserved": []}', "synthesis": '{"executor_contract": {"plan_type": "formula_synthesis"}, "write_policy": "write_formula", "actions": [1, 2], "generated_formula_count": 2}',
        "policy": '{"on_conflict": "report", "max_rows": 5}', "odd": '{"on_conflict": "maybe", "max_rows": "x", "other": 1}',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    docs = saved.read_saved(spark, f"{tmp_path}/*.json")

    def found(what, *names):
        got = {}
        for r in saved.problems(docs, what).collect():
            got.setdefault(r.path.rsplit("/", 1)[1][:-5], set()).add(r.code)
        return [got.get(n, set()) for n in names]

    assert found("map", "map", "broken", "list", "empty") == [set(), {"NOT_JSON"}, {"NOT_AN_OBJECT"}, {"SHEETS_MISSING"}]
    assert found("fill_plan", "fill", "short") == [set(), {"PLAN_ID_INVALID", "WOULD_WRITE_MISSING"}]
    assert found("synthesis_plan", "synthesis", "empty") == [set(), {"PLAN_TYPE_INVALID", "WRITE_POLICY_INVALID", "ACTION_COUNT_WRONG"}]
    assert found("policy", "policy", "odd", "empty") == [set(), {"UNKNOWN_KEY", "ON_CONFLICT_INVALID", "MAX_ROWS_INVALID"}, set()]
    policy = {r.path.rsplit("/", 1)[1]: r for r in saved.policies(docs).collect()}
    assert (policy["policy.json"].on_conflict, policy["policy.json"].max_rows, policy["policy.json"].allow_lookup) == ("report", "5", "false") and policy["empty.json"].on_conflict == "block"
    assert sorted((r.place, r.name) for r in saved.sheets(docs).collect()) == [(0, "S"), (1, "T")]
    digests = {r.path.rsplit("/", 1)[1]: (r.sha256, r.bytes) for r in saved.file_digests(spark, f"{tmp_path}/*.json").collect()}
    assert digests["list.json"] == (hashlib.sha256(b"[1]").hexdigest(), 3)
