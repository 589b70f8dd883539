"""Foreign-key graphs and compiled constraints against plain Python."""

import random

import pytest

from quarry.operators import constraints as C


def frames(spark, tables):
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in tables.items()}


def test_closure_and_order():
    assert C.below("models", C.FOREIGN_KEYS) == ["jobs", "model_versions", "models", "training_logs", "training_runs"]
    assert C.below("datasets", C.FOREIGN_KEYS) == ["datasets", "jobs", "models", "training_runs"]
    assert C.below("jobs", C.FOREIGN_KEYS) == ["jobs"]
    tables = ["training_logs", "jobs", "model_versions", "training_runs", "models", "datasets"]
    order = C.parents_first(tables, C.FOREIGN_KEYS)
    assert all(order.index(k.parent) < order.index(k.table) for k in C.FOREIGN_KEYS)
    with pytest.raises(ValueError, match="cycle"):
        C.parents_first(["a", "b"], [C.ForeignKey("a", "x", "b", C.CASCADE), C.ForeignKey("b", "y", "a", C.CASCADE)])


def plain_delete(tables, doomed, keys):
    gone = {name: set(doomed.get(name, ())) for name in tables}
    while True:
        before = {n: set(g) for n, g in gone.items()}
        for k in keys:
            if k.on_delete == C.CASCADE:
                gone[k.table] |= {r["id"] for r in tables[k.table] if r[k.column] in gone[k.parent] and r["id"] is not None}
        if gone == before:
            break
    out = {}
    for name, rows in tables.items():
        out[name] = sorted((tuple(None if any(k.table == name and k.column == c and k.on_delete == C.SET_NULL and v in gone[k.parent] for k in keys) else v
                                  for c, v in r.items()) for r in rows if r["id"] not in gone[name]), key=str)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_delete_equals_plain_closure(spark, seed):
    rng = random.Random(seed)
    refs = {"datasets": [], "models": ["dataset_id"], "training_runs": ["model_id", "dataset_id"], "training_logs": ["training_run_id"],
            "model_versions": ["model_id", "training_run_id"], "jobs": ["model_id", "dataset_id"]}
    prefix = {"dataset_id": "d", "model_id": "m", "training_run_id": "r"}
    own = {"datasets": "d", "models": "m", "training_runs": "r", "training_logs": "l", "model_versions": "v", "jobs": "j"}
    tables = {name: [{"id": f"{own[name]}{i}", **{c: rng.choice([None, f"{prefix[c]}{rng.randrange(14)}"]) for c in cols}} for i in range(12)] for name, cols in refs.items()}
    dfs = {name: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0])) for name, rows in tables.items()}
    doomed = {"models": ["m1", "m4", "m4", "unknown"], "datasets": ["d2", None]}
    got = C.delete(dfs, {n: spark.createDataFrame([(i,) for i in ids], "id string") for n, ids in doomed.items()})
    want = plain_delete(tables, {n: {i for i in ids if i} for n, ids in doomed.items()}, C.FOREIGN_KEYS)
    for name in tables:
        assert got[name].columns == dfs[name].columns
        assert sorted((tuple(r) for r in got[name].collect()), key=str) == want[name], name
    none = C.delete(dfs, {"jobs": spark.createDataFrame([("j3",)], "id string")})
    assert none["models"] is not None and none["jobs"].count() == 11 and none["training_logs"].count() == 12
    with pytest.raises(ValueError, match="unknown tables"):
        C.delete(dfs, {"users": dfs["jobs"]})


def test_violations_and_nulls(spark):
    tables = frames(spark, {
        "parent": ("id string, size int, kind string", [("a", 1, "x"), ("b", -1, "y"), ("c", None, None), ("d", -2, "z")]),
        "child": ("id string, parent_id string, n int", [("1", "a", 1), ("2", "q", 1), ("3", None, 1), ("4", "a", 1), ("5", "a", None), ("6", "a", None)])})
    rules = [C.Check("parent", "size", "size >= 0"), C.Check("parent", "kind", "kind IN ('x', 'y')"), C.Unique("child", "twice", ("parent_id", "n")),
             C.ForeignKey("child", "parent_id", "parent", C.CASCADE, "fk"), C.Check("absent", "none", "false")]
    got = sorted(tuple(r) for r in C.violations(tables, rules).collect())
    assert got == [("child", "fk", "2"), ("child", "twice", "1"), ("child", "twice", "4"), ("parent", "kind", "d"), ("parent", "size", "b"), ("parent", "size", "d")]
