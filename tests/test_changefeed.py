import random

from tapeloom.operators.changefeed import apply_changes

SCHEMA = "k string, ts bigint, a int, b string, op string, o bigint, arr bigint, seq int, del boolean, f0 int, s0 int"


def brute(rows):
    once = {}
    for k, ts, a, b, op, o, _arr in rows:
        if k is not None and ts is not None:
            key = (k, ts, a, b, op)
            once[key] = min(once.get(key, o), o)
    state = {}
    for (k, ts, a, b, op), o in sorted(once.items(), key=lambda x: (x[0][1], x[1])):
        if op == "delete":
            state.pop(k, None)
            continue
        if op == "replace":
            state[k] = {}
        for f, v in (("a", a), ("b", b)):
            if v is not None:
                state.setdefault(k, {})[f] = v
    return sorted(((k, v.get("a"), v.get("b")) for k, v in state.items()), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, True, 1, 2) for r in rows], SCHEMA)
    df = df.drop("seq", "del", "f0", "s0")
    got = apply_changes(df, ["k"], ["ts"], ["a", "b"], "o", ["arr"], deletes="op = 'delete'", replaces="op = 'replace'")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_against_ordered_replay(spark):
    r = random.Random(3)
    rows = []
    for n in range(600):
        rows.append((r.choice(["x", "y", "z", "w", None]), r.choice([*range(80), None]), r.choice([None, 1, 2, 3]), r.choice([None, "p", "q"]), r.choice(["set", "set", "set", "delete", "replace", None]), n, n * 3))
        if n % 5 == 0:
            rows.append((*rows[-1][:5], n + 10_000, 5))
    r.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_columns_with_the_operators_own_names(spark):
    df = spark.createDataFrame([("x", 1, 5, "p", "set", 1, 1, 7, True, 1, 2)], SCHEMA)
    got = apply_changes(df, ["k"], ["ts"], ["a"], "o", ["arr"], deletes="op = 'delete'")
    assert [tuple(x) for x in got.collect()] == [("x", 5)]


def test_empty(spark):
    assert run(spark, []) == []
