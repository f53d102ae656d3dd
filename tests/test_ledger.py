"""Ledger fold: hand cases (FIXTURES.md) and agreement of every execution plan
with the brute-force fold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from henhouse.operators import ledger as L
from henhouse.plans import stock as ST
from henhouse.sources import sinks as SK

EV = "key long, seq long, op_date date, op_id string, mode string, ref string, d_x long, v_x long"


def _events(spark, rows):
    import datetime as dt

    base = dt.date(2024, 1, 1)
    data = [(k, s, base + dt.timedelta(days=day), oid, m, ref, d, v) for (k, s, day, oid, m, ref, d, v) in rows]
    return spark.createDataFrame(data, EV)


def test_hand_sequence(spark):
    rows = [(1, 1, 0, "a", "add", None, 5, None), (1, 2, 0, "b", "reject", None, -9, None),
            (1, 3, 0, "c", "clamp", None, -9, None), (1, 4, 0, "d", "add", None, 7, None),
            (1, 5, 0, "e", "reject", None, -3, None), (1, 6, 0, "f", "set", None, 0, 100)]
    out = L.fold(_events(spark, rows), "key", ["seq"], ["x"], {"add", "reject", "clamp", "set"}).orderBy("seq")
    got = [(r.after_x, r.applied) for r in out.collect()]
    assert got == [(5, True), (5, False), (0, True), (7, True), (4, True), (100, True)]


def test_multi_size_sale_is_atomic(spark):
    df = spark.createDataFrame([(1, 1, "add", 10, 1), (1, 2, "reject", -5, -2), (1, 3, "reject", -5, -1)],
                               "key long, seq long, mode string, d_a long, d_b long").withColumn("op_id", F.col("seq").cast("string")) \
        .withColumn("ref", F.lit(None).cast("string"))
    out = L.fold(df, "key", ["seq"], ["a", "b"], {"add", "reject"}).orderBy("seq").collect()
    assert [(r.after_a, r.after_b, r.applied) for r in out] == [(10, 1, True), (10, 1, False), (5, 0, True)]


def test_halt_on_error(spark):
    rows = [(1, 1, 0, "a", "add", None, 5, None), (1, 2, 0, "b", "fail", None, 0, None),
            (1, 3, 0, "c", "add", None, 7, None), (2, 1, 0, "d", "add", None, 1, None)]
    out = L.fold(_events(spark, rows), "key", ["seq"], ["x"], {"add", "fail"}, halt_scope="key") \
        .orderBy("key", "seq").collect()
    assert [(r.applied, r.halted, r.after_x) for r in out] == [
        (True, False, 5), (False, False, 5), (False, True, 5), (True, False, 1)]


def _crossing_frame(spark, steps):
    sizes = ST.SIZES
    rows = []
    for farm, seq, kind, g in steps:
        rows.append((farm, seq, kind, f"{farm}-{seq}", "add" if kind == 0 else "reject", *[g if s == "grande" else 0 for s in sizes]))
    schema = "farm_id long, seq long, kind int, op_id string, mode string, " + ", ".join(f"d_{s} long" for s in sizes)
    df = spark.createDataFrame(rows, schema).withColumn("op_date", F.lit("2024-01-01").cast("date")) \
        .withColumn("ref", F.lit(None).cast("string"))
    return L.fold(df, "farm_id", ["seq"], sizes, {"add", "reject"})


def test_low_stock_crossing(spark):
    folded = _crossing_frame(spark, [(1, 1, 0, 360), (1, 2, 1, -1), (1, 3, 1, -59),
                                     (2, 1, 0, 720), (2, 2, 1, -360)])
    c = ST.low_stock_crossings(folded).collect()
    assert [(r.farm_id, r.op_id, r.category, r.remaining) for r in c] == [(1, "1-2", "grande", 359)]


def test_void_twice_is_void_once(spark):
    req = spark.createDataFrame([("sale", "1", "2024-01-02 10:00:00"), ("sale", "1", "2024-01-05 10:00:00")],
                                "entity string, id string, requested_at string") \
        .withColumn("requested_at", F.to_timestamp("requested_at"))
    r = SK.first_void(req, ["entity", "id"]).collect()
    assert len(r) == 1 and str(r[0].voided_at) == "2024-01-02 10:00:00"


def reference_fold(rows, dims):
    """Independent plain-Python fold (rows sorted by key then order). A reference counts only
    if the event came earlier and was applied, and an event is given back once."""
    out, state, key, seen, back = [], None, object(), {}, set()
    for r in rows:
        if r["key"] != key:
            key, state, seen, back = r["key"], {d: 0 for d in dims}, {}, set()
        before = dict(state)
        d = {x: int(r[f"d_{x}"] or 0) for x in dims}
        if r.get("alt") and seen.get(r["alt"]):
            d = {x: int(r[f"a_{x}"] or 0) for x in dims}
        mode = r["mode"]
        ok = mode != "fail" and (r["ref"] is None or bool(seen.get(r["ref"])) and r["ref"] not in back)
        if ok and mode in ("reject", "replace"):
            ok = all(state[x] + d[x] >= 0 for x in dims)
        if ok and mode in ("add", "reject", "replace", "restore"):
            state = {x: state[x] + d[x] for x in dims}
        elif ok and mode == "clamp":
            state = {x: max(state[x] + d[x], 0) for x in dims}
        elif ok and mode == "set":
            state = {x: (state[x] if r.get(f"v_{x}") is None else int(r[f"v_{x}"])) for x in dims}
        if ok and mode == "restore":
            back.add(r["ref"])
        seen[r["op_id"]] = ok
        out.append(dict(r, applied=ok, **{f"before_{x}": before[x] for x in dims},
                        **{f"after_{x}": state[x] for x in dims}))
    return out


def _random_log(seed, modes, n=400, keys=3, days=9):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        applied_sales = []
        for s in range(n // keys):
            day = int(s * days / (n // keys))
            m = modes[rng.integers(len(modes))]
            oid = f"{k}-{s:04d}"
            ref, d, v = None, int(rng.integers(-12, 13)), None
            if m == "add":
                d = int(rng.integers(0, 12))
            elif m in ("restore", "replace"):
                if not applied_sales:
                    m, d = "add", int(rng.integers(0, 12))
                else:
                    ref = applied_sales[int(rng.integers(len(applied_sales)))]
                    d = int(rng.integers(0, 10))
            elif m == "set":
                d, v = 0, int(rng.integers(0, 20))
            if m == "reject":
                applied_sales.append(oid)
            rows.append((k, s, day, oid, m, ref, d, v))
    return rows


@pytest.mark.parametrize("modes,chunk_rows", [
    (("add",), 1000),
    (("add", "clamp"), 1000),
    (("add", "reject"), 1000),
    (("add", "reject"), 30),
    (("add", "reject", "clamp", "set"), 1000),
    (("add", "reject", "clamp", "set"), 20),
    (("add", "reject", "restore", "replace"), 1000),
    (("add", "reject", "restore", "replace", "clamp"), 25),
    (("add", "clamp", "set"), 1000),
    (("add", "noop", "fail", "reject", "set"), 17),
])
def test_plans_agree_with_brute_force(spark, modes, chunk_rows):
    rows = _random_log(7, modes)
    df = _events(spark, rows)
    refs = "ref" if "restore" in modes else None
    got = L.fold(df, "key", ["seq"], ["x"], set(modes), chunk="op_date", ref_col=refs, chunk_rows=chunk_rows) \
        .orderBy("key", "seq").collect()
    want = reference_fold([dict(key=r[0], seq=r[1], op_id=r[3], mode=r[4], ref=r[5], d_x=r[6], v_x=r[7]) for r in rows], ["x"])
    assert [(r.after_x, r.before_x, bool(r.applied)) for r in got] == \
           [(w["after_x"], w["before_x"], bool(w["applied"])) for w in want]


def _linked_log(seed, n=260, keys=2):
    """References in both directions, to refused events, to nothing and to other edits."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        for s in range(n):
            mode = rng.choice(["add", "reject", "reject", "clamp", "restore", "replace", "set", "noop", "fail"])
            ref = alt = None
            if mode in ("restore", "replace") or rng.random() < 0.1:
                ref = f"{k}-{int(rng.integers(max(0, s - 40), min(n + 3, s + 20)))}"
            if rng.random() < 0.3:
                alt = f"{k}-{int(rng.integers(0, n + 3))}"
            d, a = (int(x) for x in rng.integers(-9, 10, 2))
            rows.append((k, s, f"{k}-{s}", str(mode), ref, alt, abs(d) if mode == "add" else d, int(rng.integers(-9, 10)),
                         a, int(rng.integers(-3, 4)), int(rng.integers(0, 15)) if rng.random() < 0.6 else None, None))
    return rows


LINKED = ("key long, seq long, op_id string, mode string, ref string, alt string, d_x long, d_y long, a_x long, a_y long, "
          "v_x long, v_y long")


@pytest.mark.parametrize("seed", [1, 2])
def test_both_plans_give_one_answer(spark, seed):
    """Random logs with references in both directions: chunks of 1 and 7 events, and one
    pass, equal the plain fold."""
    rows = _linked_log(seed, n=40 if seed == 1 else 260)
    df = spark.createDataFrame(rows, LINKED).withColumn("op_date", F.lit("2024-01-01").cast("date"))
    names = [c.split()[0] for c in LINKED.split(", ")]
    want = [(w["key"], w["seq"], w["applied"], w["before_x"], w["after_x"], w["before_y"], w["after_y"])
            for w in reference_fold([dict(zip(names, r)) for r in rows], ["x", "y"])]
    for chunk_rows in (1, 7, 200_000) if seed == 1 else (90, 200_000):
        out = L.fold(df, "key", ["seq"], ["x", "y"], {"add", "reject", "clamp", "restore", "replace", "set", "noop", "fail"},
                     chunk="op_date", ref_col="ref", alt_col="alt", chunk_rows=chunk_rows)
        got = [tuple(r) for r in out.select("key", "seq", "applied", "before_x", "after_x", "before_y", "after_y").orderBy("key", "seq").collect()]
        assert got == want, chunk_rows


def test_restore_before_its_sale_is_refused(spark):
    """Five events, the void ordered before its sale: refused by every plan."""
    rows = [(1, 1, 0, "a", "add", None, 61, None), (1, 2, 0, "v", "restore", "s", 50, None), (1, 3, 0, "s", "reject", None, -50, None),
            (1, 4, 0, "b", "add", None, 50, None), (1, 5, 0, "w", "restore", "gone", 9, None)]
    for chunk_rows in (1, 2, 200_000):
        out = L.fold(_events(spark, rows), "key", ["seq"], ["x"], {"add", "reject", "restore"}, chunk="op_date", ref_col="ref", chunk_rows=chunk_rows)
        assert [(r.applied, r.after_x) for r in out.orderBy("seq").collect()] == [
            (True, 61), (False, 61), (True, 11), (True, 61), (False, 61)]


def test_refused_restore_leaves_the_sale_to_give_back(spark):
    """The first void comes before its sale and is refused; a later one counts, a third not."""
    rows = [(1, 1, 0, "a", "add", None, 20, None), (1, 2, 0, "v1", "restore", "s", 5, None), (1, 3, 0, "s", "reject", None, -5, None),
            (1, 4, 0, "v2", "restore", "s", 5, None), (1, 5, 0, "v3", "restore", "s", 5, None), (1, 6, 0, "r", "replace", "s", 1, None)]
    for chunk_rows in (1, 3, 200_000):
        out = L.fold(_events(spark, rows), "key", ["seq"], ["x"], {"add", "reject", "restore", "replace"}, ref_col="ref", chunk_rows=chunk_rows)
        assert [r.applied for r in out.orderBy("seq").collect()] == [True, False, True, True, False, False]


def test_a_busy_day_is_cut(spark, monkeypatch):
    """One day of one key: its chunks are as even as those of many days."""
    df = _events(spark, [(k, s, 0, oid, m, ref, d, v) for k, s, _, oid, m, ref, d, v in _random_log(9, ("add", "reject"), n=300, keys=1)])
    seen = []
    real = L._pass
    monkeypatch.setattr(L, "_pass", lambda ev, groups, *a: seen.append(
        sorted(r["count"] for r in ev.groupBy(*groups).count().collect())) or real(ev, groups, *a))
    L.fold(df, "key", ["seq"], ["x"], {"add", "reject"}, chunk="op_date", chunk_rows=50).count()
    assert seen[0] == [50] * 6


def test_steps_are_taken_per_refusal(monkeypatch):
    """A long log with few refusals is folded in few leaps."""
    n = 50_000
    rng = np.random.default_rng(4)
    d = np.where(rng.random(n) < 0.5, rng.integers(1, 9, n), -rng.integers(1, 9, n))
    d[rng.integers(0, n, 20)] = -10**6  # refused
    d[0] = 10**5
    table = pa.table({"key": np.zeros(n, np.int64), "mode": np.where(d > 0, "add", "reject"), "op_id": np.arange(n).astype(str),
                      "d_x": d, "s_x": np.zeros(n, np.int64)})
    log = L._Log(table, ["key"], ["x"], "mode", None, "op_id", None, None)
    steps = []
    real = np.cumsum
    monkeypatch.setattr(L.np, "cumsum", lambda *a, **k: steps.append(1) or real(*a, **k))
    applied, _, before, after = L._leap(log)
    refused = int((~applied).sum())
    assert 15 <= refused <= 25 and len(steps) <= 14 * (refused + 1)
    state = 0
    for i in range(n):
        ok = d[i] > 0 or state + d[i] >= 0
        assert applied[i] == ok and before[i, 0] == state
        state += int(d[i]) if ok else 0


def test_closed_maps_compose_without_python(spark):
    """Adds, clamps and sets of single dimensions, from given starts: no Python in the plan."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(3):
        for s in range(200):
            m = str(rng.choice(["add", "add", "clamp", "clamp", "set"]))
            v = [int(x) if m == "set" and rng.random() < 0.5 else None for x in rng.integers(0, 20, 2)]
            rows.append((k, s, s // 23, m, int(rng.integers(-9, 10)), int(rng.integers(-9, 10)), *v))
    df = spark.createDataFrame(rows, "key long, seq long, day int, mode string, d_x long, d_y long, v_x long, v_y long").withColumn("op_id", F.col("seq").cast("string"))
    out = L.fold(df, "key", ["seq"], ["x", "y"], {"add", "clamp", "set"}, chunk="day",
                 initial=spark.createDataFrame([(0, 30, 2), (2, 1, -4)], "key long, x long, y long"))
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()
    state = {0: [30, 2], 1: [0, 0], 2: [1, -4]}
    for r in out.orderBy("key", "seq").collect():
        x = state[r.key]
        assert [r.before_x, r.before_y] == x
        d, v = (r.d_x, r.d_y), (r.v_x, r.v_y)
        x = [a + b for a, b in zip(x, d)] if r.mode == "add" else [max(a + b, 0) for a, b in zip(x, d)] if r.mode == "clamp" else \
            [a if b is None else b for a, b in zip(x, v)]
        state[r.key] = x
        assert [r.after_x, r.after_y] == x


def test_hot_key_is_folded_by_several_tasks(spark, monkeypatch):
    """One key with a third of the log: its chunks are separate groups of the fold, and
    the result is that of the fold in one piece."""
    rows = _random_log(3, ("add", "reject", "clamp"), n=600, keys=1, days=30)
    rows += [(k, *r[1:3], f"{k}-{r[1]}", *r[4:]) for k in range(1, 41) for r in _random_log(k, ("add", "reject"), n=30, keys=1)]
    df = _events(spark, rows)
    seen = []
    real = L._pass
    monkeypatch.setattr(L, "_pass", lambda ev, groups, *a: seen.append(
        ev.filter("key = 0").select(*groups).distinct().count()) or real(ev, groups, *a))
    cols = ["key", "seq", "applied", "before_x", "after_x"]
    split = L.fold(df, "key", ["seq"], ["x"], {"add", "reject", "clamp"}, chunk="op_date", chunk_rows=60)
    assert seen[0] >= 8
    whole = L.fold(df, "key", ["seq"], ["x"], {"add", "reject", "clamp", "set"}, chunk="op_date")
    assert split.select(*cols).exceptAll(whole.select(*cols)).count() == 0 and split.count() == len(rows)


def test_halting_and_initial_states_across_chunks(spark):
    rows = _random_log(5, ("add", "reject", "fail"), n=300, keys=3, days=15)
    df = _events(spark, rows).withColumn("user", F.col("seq") % 4)
    initial = spark.createDataFrame([(0, 7), (2, 3)], "key long, x long")
    args = (df, "key", ["seq"], ["x"], {"add", "reject", "fail"})
    cols = ["key", "seq", "applied", "halted", "before_x", "after_x"]
    one = L.fold(*args, chunk="op_date", halt_scope="user", initial=initial).select(*cols)
    many = L.fold(*args, chunk="op_date", halt_scope="user", initial=initial, chunk_rows=15).select(*cols)
    assert one.exceptAll(many).count() == 0 and many.count() == len(rows)
    state, stopped = {0: 7, 1: 0, 2: 3}, set()
    got = {(r.key, r.seq): r for r in one.collect()}
    for k, s, _, _, m, _, d, _ in rows:
        r = got[k, s]
        halted = (k, s % 4) in stopped
        ok = not halted and (m == "add" or m == "reject" and state[k] + d >= 0)
        assert (r.halted, r.applied, r.before_x) == (halted, ok, state[k])
        state[k] += d if ok else 0
        if not ok and not halted:
            stopped.add((k, s % 4))


def test_stock_never_negative_and_conserves(tables_small):
    f = ST.stock_with_sales(tables_small)
    assert f.filter(" OR ".join(f"after_{s} < 0" for s in ST.SIZES)).count() == 0
    # accepted ops only: final stock = sum in - sum out
    inv = ST.inventory(f).groupBy("farm_id").agg(F.sum("quantity").alias("q"))
    flows = f.filter("applied").groupBy("farm_id").agg(sum(F.sum(f"d_{s}") for s in ST.SIZES).alias("q2"))
    # farms with only refused sales have no applied flow and end at zero
    j = inv.join(flows, "farm_id", "left").filter(F.col("q") != F.coalesce("q2", F.lit(0)))
    assert j.count() == 0


@pytest.mark.parametrize("scope", [None, "who"])
def test_keys_are_folded_side_by_side(monkeypatch, scope):
    """Forty keys whose events are mostly refused take a step per place in a key, and not one
    per refusal and key; the outcome is that of the leaps."""
    rng, keys, each = np.random.default_rng(5), 40, 60
    n = keys * each
    table = pa.table({
        "key": pa.array(np.repeat(np.arange(keys), each)), "op_id": pa.array([str(i % each) for i in range(n)]),
        "mode": pa.array(rng.choice(["add", "reject", "clamp", "fail"], n, p=[0.2, 0.5, 0.2, 0.1])),
        "d_x": pa.array(rng.integers(-6, 5, n)), "s_x": pa.array(np.repeat(np.arange(keys) % 3, each)),
        "who": pa.array([None if i % 17 == 0 else f"u{i % 7}" for i in range(n)]),
        "stopped": pa.array([["u3", "elsewhere"] if i // each % 2 else None for i in range(n)], pa.list_(pa.string()))})
    log = L._Log(table, ["key"], ["x"], "mode", scope, "op_id", None, None)
    expected = L._leap(log)

    def refuse(*_):
        raise AssertionError("events were settled one by one")

    monkeypatch.setattr(L, "_stretch", refuse)
    monkeypatch.setattr(L, "_Halts", refuse)
    for got, want in zip(L._settle(log), expected):
        assert (got == want).all()


def test_columns_made_at_the_fold_are_not_written(spark, monkeypatch):
    """Mode and halt scope given by what they are made of: the same fold in one pass and in
    rounds, and neither is written or exchanged."""
    rows = _random_log(12, ("add", "reject", "fail"), n=200, keys=3, days=15)
    df = _events(spark, rows).withColumn("user", F.col("seq") % 4)
    args = ("key", ["seq"], ["x"], {"add", "reject", "fail"})
    cols = ["key", "seq", "mode", "user", "applied", "halted", "before_x", "after_x"]
    want = L.fold(df, *args, halt_scope="user").select(*cols)
    bare = df.withColumn("kind", F.substring("mode", 1, 1)).drop("mode", "user")
    made = {"user": F.col("seq") % 4, "mode": F.when(F.col("kind") == "a", "add").when(F.col("kind") == "r", "reject").otherwise("fail")}
    written, real = [], L._written
    monkeypatch.setattr(L, "_written", lambda rows, name: written.append((name, rows.columns)) or real(rows, name))
    for chunk_rows in (9, 200_000):
        got = L.fold(bare, *args, halt_scope="user", chunk_rows=chunk_rows, made=made).select(*cols)
        assert got.exceptAll(want).count() == 0 and got.count() == len(rows)
    assert all("mode" not in c and "user" not in c for name, c in written if name == "ledger-events") and written
