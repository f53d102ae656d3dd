"""Ledgers as folds over ordered events.

An event row carries a key (farm for egg stock, shed for birds), an order, a mode
and one signed delta per dimension (five egg sizes, or one bird count):

=========  ===============================================================
mode       effect on the state ``x`` (per key, starts at zero or ``initial``)
=========  ===============================================================
add        x += d                      (collections, arrivals)
reject     x += d only if every x + d >= 0, else nothing (sales, deaths)
clamp      x = max(x + d, 0)            (voided / amended collections)
set        x[i] = v[i] where v[i] is given (manual stock or bird count)
restore    x += d, once per referenced op (void of a sale)
replace    x += d as ``reject``, d being new - old (sale edit); nothing once the
           referenced op was restored
noop/fail  nothing; fail counts as not applied
=========  ===============================================================

An event with a ``ref`` acts only if the event it refers to was applied. An event with
an ``alt`` takes its second set of deltas (``a_<dim>``) if that other event was applied
(the void of an edited sale gives back what the edit left).

An event counts as referred to only if it comes before the one that refers to it, in the
order of the key; what comes later, or isn't there, was not applied.

Execution is chosen from the modes the caller declares:

* ``add`` only — a running sum, computed as a two-phase prefix scan over
  (key, chunk) partitions so one busy key is spread over many tasks;
* ``add``, ``clamp`` and ``set`` — every event is a map x -> max(x + a, b), and such maps
  compose to one of their kind, so this is a two-phase scan too (``_closed_scan``);
* anything else is order-dependent and not associative. The events are written once and
  ranked per key by one range exchange; ``CHUNK_ROWS`` of them, in order, are a chunk,
  whatever their days. Keys of like length are folded side by side (``_side_by_side``): the
  k-th events of all of them are one step on arrays. A chunk that has too few others beside
  it is folded in leaps (``_leap``): all events up to the next refusal, binding clamp or set
  are applied by one cumulative sum. Where every key is one
  chunk, one pass does. Larger keys are folded in rounds: the starts of chunks and the
  outcomes that other chunks refer to are guessed, all chunks folded in parallel, and those
  that started from a wrong guess folded again until none did. After round r the first r
  chunks of a key are final, so the result is exact, and the same as that of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from henhouse.session import scratch_path

ADD, REJECT, CLAMP, SET, RESTORE, REPLACE = "add", "reject", "clamp", "set", "restore", "replace"
NOOP, FAIL = "noop", "fail"
#: Events of one key folded by one task, about.
CHUNK_ROWS = 200_000


def _d(dim: str) -> str:
    return f"d_{dim}"


def _v(dim: str) -> str:
    return f"v_{dim}"


def _out_schema(events: DataFrame, dims: list[str], halt: bool = False) -> T.StructType:
    fields = list(events.schema.fields)
    fields.append(T.StructField("applied", T.BooleanType()))
    if halt:
        fields.append(T.StructField("halted", T.BooleanType()))
    fields += [T.StructField(f"before_{d}", T.LongType()) for d in dims]
    fields += [T.StructField(f"after_{d}", T.LongType()) for d in dims]
    return T.StructType(fields)


# ---------------------------------------------------------------------------
# associative paths
# ---------------------------------------------------------------------------
def _running_sum(events: DataFrame, key: str, order: list[str], chunk: str, dims: list[str]) -> DataFrame:
    """Two-phase segmented sum. Phase 1: a running sum inside each (key, chunk). Phase 2:
    per key, the chunk totals (one row per chunk, far fewer than events) are scanned in
    chunk order and joined back as offsets. No window ever spans a whole key, so a key
    holding a third of the rows is still spread over its chunks."""
    upto = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = {x: F.col(_d(x)).cast("bigint") for x in dims}
    local = events.select("*", *[F.sum(d[x]).over(upto).alias(f"ls_{x}") for x in dims])
    earlier = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    chunks = events.groupBy(key, chunk).agg(*[F.sum(d[x]).alias(f"ct_{x}") for x in dims]).select(
        key, chunk, *[F.coalesce(F.sum(f"ct_{x}").over(earlier), F.lit(0)).alias(f"off_{x}") for x in dims])
    after = {x: F.col(f"off_{x}") + F.col(f"ls_{x}") for x in dims}
    return local.join(chunks, [key, chunk]).select(
        *events.columns, F.lit(True).alias("applied"), *[(after[x] - d[x]).alias(f"before_{x}") for x in dims],
        *[after[x].alias(f"after_{x}") for x in dims])


def _closed_scan(events: DataFrame, key: str, order: list[str], chunk: str, dims: list[str], mode_col: str) -> DataFrame:
    """Two-phase scan of maps x -> max(x + a, b): an add has no b, a clamp has b = 0, a set to
    v is the constant v. With A the sum of all a so far, the composition of maps up to t is
    max(x + A_t, A_t + max over s <= t of (b_s - A_s)). A constant forgets all before it: the
    maximum is taken over (number of sets so far, b - A), so that later sets come first,
    and the start only counts while there was none. ``events`` has the start s_<dim>."""
    has_sets = _v(dims[0]) in events.columns
    rows = Window.partitionBy(key, chunk).orderBy(*order)
    upto, earlier_rows = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow), rows.rowsBetween(Window.unboundedPreceding, -1)
    mode = F.col(mode_col)
    d = {x: F.when(mode != SET, F.col(_d(x))).otherwise(0).cast("bigint") for x in dims}
    given = {x: (mode == SET) & F.col(_v(x)).isNotNull() if has_sets else F.lit(False) for x in dims}
    floor = {x: F.when(given[x], F.col(_v(x)).cast("bigint") if has_sets else F.lit(None).cast("bigint")).when(mode == CLAMP, F.lit(0).cast("bigint")) for x in dims}
    sums = events.select("*", *[F.sum(d[x]).over(upto).alias(f"ls_{x}") for x in dims],
                         *[F.sum(given[x].cast("bigint")).over(upto).alias(f"lk_{x}") for x in dims])
    offer = {x: F.when(floor[x].isNotNull(), F.struct(F.col(f"lk_{x}").alias("k"), (floor[x] - F.col(f"ls_{x}")).alias("h"))) for x in dims}
    local = sums.select("*", *[F.max(offer[x]).over(upto).alias(f"lm_{x}") for x in dims],
                        *[F.max(offer[x]).over(earlier_rows).alias(f"lp_{x}") for x in dims])
    # phase 2: one row per chunk
    totals = local.groupBy(key, chunk).agg(*[F.sum(d[x]).alias(f"ct_{x}") for x in dims],
                                           *[F.max(f"lk_{x}").alias(f"ck_{x}") for x in dims], *[F.max(f"lm_{x}").alias(f"cm_{x}") for x in dims])
    earlier = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))

    def moved(m, x):
        """An offer of a chunk, counted from the key's start."""
        return F.when(m.isNotNull(), F.struct((F.col(f"off_{x}_k") + m["k"]).alias("k"), (m["h"] - F.col(f"off_{x}")).alias("h")))

    offsets = totals.select(key, chunk, *[f"cm_{x}" for x in dims], *[before(f"ct_{x}").alias(f"off_{x}") for x in dims],
                            *[before(f"ck_{x}").alias(f"off_{x}_k") for x in dims])
    offsets = offsets.select(key, chunk, *[f"off_{x}" for x in dims], *[f"off_{x}_k" for x in dims],
                             *[F.max(moved(F.col(f"cm_{x}"), x)).over(earlier).alias(f"pm_{x}") for x in dims])

    def state(x, total, sets, own):
        best = F.greatest(F.col(f"pm_{x}"), moved(own, x))
        reached = total + best["h"]
        return F.when(sets > 0, reached).otherwise(F.greatest(F.col(f"s_{x}") + total, reached))

    out = []
    for x in dims:
        total, sets = F.col(f"off_{x}") + F.col(f"ls_{x}"), F.col(f"off_{x}_k") + F.col(f"lk_{x}")
        out.append((state(x, total - d[x], sets - given[x].cast("bigint"), F.col(f"lp_{x}")).alias(f"before_{x}"),
                    state(x, total, sets, F.col(f"lm_{x}")).alias(f"after_{x}")))
    return local.join(offsets, [key, chunk]).select("*", F.lit(True).alias("applied"), *[b for b, _ in out], *[a for _, a in out])


# ---------------------------------------------------------------------------
# sequential path
# ---------------------------------------------------------------------------
_MODES = pa.array([ADD, REJECT, CLAMP, SET, RESTORE, REPLACE, NOOP, FAIL])
#: Events tried in the first leap after a refusal, and in the longest one.
LEAP, LONGEST_LEAP = 32, 1 << 15
#: Where refusals follow each other within so many events, so many are settled one by one.
DENSE, STRETCH = 8, 64
#: Groups that are worth one step on arrays, and events held together for that.
ABREAST, HELD_ROWS = 16, 100_000


class _Log:
    """Whole groups of sorted events as arrays: what each event does, and what it needs."""

    def __init__(self, rows: pa.Table, groups: list[str], dims: list[str], mode_col: str, scope: str | None, id_col: str,
                 ref_col: str | None, alt_col: str | None):
        n = rows.num_rows
        number = lambda c: np.asarray(pc.fill_null(rows[c].cast(pa.int64()), 0)) if c in rows.column_names else np.zeros(n, np.int64)
        flag = lambda c: np.asarray(pc.fill_null(rows[c], False)) if c in rows.column_names else np.zeros(n, bool)
        matrix = lambda name: np.stack([number(name(d)) for d in dims], axis=1)
        modes = pc.index_in(rows[mode_col], _MODES)
        if modes.null_count:
            raise ValueError(f"unknown ledger mode among {pc.unique(rows[mode_col]).to_pylist()}")
        mode = np.asarray(modes)
        is_ = lambda *names: np.isin(mode, [_MODES.index(m).as_py() for m in names])
        self.size = n
        starts = np.zeros(n, bool)
        starts[:1] = True
        for g in groups:
            codes = np.asarray(pc.dictionary_encode(rows[g].combine_chunks(), null_encoding="encode").indices)
            starts[1:] |= codes[1:] != codes[:-1]
        self.first = np.flatnonzero(starts)
        self.deltas, self.start = matrix(_d), matrix(lambda d: f"s_{d}")
        self.other_deltas = matrix(lambda d: f"a_{d}") if alt_col else None
        self.sets = is_(SET)
        self.values = matrix(_v)
        self.given = np.stack([np.asarray(pc.is_valid(rows[_v(d)])) if _v(d) in rows.column_names else np.zeros(n, bool) for d in dims], axis=1)
        self.guarded = is_(REJECT, REPLACE, CLAMP)
        self.clamps = is_(CLAMP)
        self.moves = ~is_(NOOP, FAIL, SET)
        #: Whether an event may act as far as that is known before the fold.
        self.may = ~is_(FAIL)
        #: The event of the same group that decides whether this one acts, or which deltas it takes.
        self.gate = self.choice = np.full(n, -1)
        self.other = np.zeros(n, bool)
        group = np.cumsum(starts)  # of each event, from 1
        if ref_col or alt_col:
            names = pa.chunked_array([rows[c].cast(pa.string()).combine_chunks() for c in (id_col, ref_col, alt_col) if c]).combine_chunks()
            codes = np.asarray(pc.fill_null(pc.dictionary_encode(names).indices, -1)).astype(np.int64).reshape(-1, n)
            keys = group * (codes.max(initial=0) + 1) + codes
            order = np.argsort(keys[0], kind="stable")

            def place(k: int) -> np.ndarray:
                """Where the event that row k of ``keys`` names is in the group, or -1."""
                found = np.minimum(np.searchsorted(keys[0][order], keys[k]), n - 1)
                return np.where((codes[k] >= 0) & (keys[0][order[found]] == keys[k]), order[found], -1)

        here = np.arange(n)
        if ref_col:
            refers, target = codes[1] >= 0, place(1)
            self.gate = np.where((target >= 0) & (target < here), target, -1)
            outside = refers & (target < 0) & flag("gate")
            # given back before: an earlier restore of the same event
            own = np.flatnonzero(refers)
            own = own[np.lexsort((own, keys[1][own]))]
            restores = np.concatenate(([0], np.cumsum(is_(RESTORE)[own] & (outside[own] | (self.gate[own] >= 0)))))
            spent = flag("__spent").copy()
            spent[own] |= restores[:-1] > restores[np.searchsorted(keys[1][own], keys[1][own])]
            self.may &= ~refers | ((outside | (self.gate >= 0)) & ~spent)
            self.gate[spent] = -1
        if alt_col:
            target = place(-1)
            self.choice = np.where((target >= 0) & (target < here), target, -1)
            self.other = (codes[-1] >= 0) & (target < 0) & flag("alt_ok")
        #: The latest event of the group that an event waits for.
        self.waits = np.maximum(self.gate, self.choice)
        self.who = None
        self.group = group - 1
        if scope:
            self.who = np.asarray(pc.dictionary_encode(rows[scope].combine_chunks(), null_encoding="encode").indices)
            self.names = pc.dictionary_encode(rows[scope].combine_chunks(), null_encoding="encode").dictionary
            self.stopped = rows["stopped"]


_Outcome = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blank(log: _Log) -> _Outcome:
    """applied, halted, before, after of each event, to be filled."""
    n, dims = log.deltas.shape
    return np.zeros(n, bool), np.zeros(n, bool), np.empty((n, dims), np.int64), np.empty((n, dims), np.int64)


def _settle(log: _Log) -> _Outcome:
    """applied, halted, before, after of each event."""
    out, lengths = _blank(log), np.diff(np.append(log.first, log.size))
    alone = np.ones(len(lengths), bool)
    if len(lengths) >= ABREAST:  # groups much longer than the others would be steps of one event
        alone = lengths > 2 * np.partition(lengths, -ABREAST)[-ABREAST]
        _side_by_side(log, np.flatnonzero(~alone), lengths, out)
    return _leap(log, np.flatnonzero(alone), out)


def _side_by_side(log: _Log, groups: np.ndarray, lengths: np.ndarray, out: _Outcome) -> None:
    """Folds ``groups`` together: step k settles the k-th event of each that has one. The
    events are laid out step by step, longer groups first, so a step is a slice."""
    groups = groups[np.argsort(-lengths[groups], kind="stable")]
    own = lengths[groups]
    rank = np.repeat(np.arange(len(groups)), own)
    step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    at = (np.repeat(log.first[groups], own) + step)[np.lexsort((rank, step))]
    place = np.full(log.size + 1, -1)  # the last one is for -1: no event
    place[at] = np.arange(len(at))
    ends = np.cumsum(np.bincount(step))
    may, gate, choice, other = log.may[at], place[log.gate[at]], place[log.choice[at]], log.other[at]
    sets, moves, guarded, clamps, deltas = log.sets[at], log.moves[at], log.guarded[at], log.clamps[at], log.deltas[at]
    gated, choosing, setting = (gate >= 0).any(), log.other_deltas is not None and ((choice >= 0).any() or other.any()), sets.any()
    others = log.other_deltas[at] if choosing else None
    values, given = (log.values[at], log.given[at]) if setting else (None, None)
    refuses = guarded & ~clamps
    done, stops = np.zeros(len(at), bool), np.zeros(len(at), bool)
    befores, afters = np.empty_like(deltas), np.empty_like(deltas)
    if log.who is not None:
        pairs = log.group[at] * (int(log.who.max(initial=0)) + 1) + log.who[at]
        names, who = np.unique(pairs, return_inverse=True)
        stopped = np.zeros(len(names), bool)
        for g in groups.tolist():
            if already := log.stopped[int(log.first[g])].as_py():
                codes = pc.index_in(pa.array(already, log.names.type), log.names)
                stopped |= np.isin(names, g * (int(log.who.max(initial=0)) + 1) + np.asarray(pc.fill_null(codes, -1))[np.asarray(pc.is_valid(codes))])
    state, low = log.start[log.first[groups]], 0
    for high in ends.tolist():
        state = state[:high - low]
        now = slice(low, high)
        ok = may[now]
        if gated:
            ok = ok & ((gate[now] < 0) | done[gate[now]])
        if log.who is not None:
            held = stopped[who[now]]
            ok = ok & ~held
            stops[now] = held
        delta = deltas[now]
        if choosing:
            delta = np.where((other[now] | ((choice[now] >= 0) & done[choice[now]]))[:, None], others[now], delta)
        moved = state + delta
        short = (moved < 0).any(axis=1)
        ok = ok & ~(short & refuses[now] & moves[now])
        if short.any():
            moved = np.where((short & clamps[now])[:, None], np.maximum(moved, 0), moved)
        befores[now] = state
        state = np.where((ok & moves[now])[:, None], moved, state)
        if setting:
            state = np.where((ok & sets[now])[:, None] & given[now], values[now], state)
        afters[now] = state
        done[now] = ok
        if log.who is not None:
            stopped[who[now][~ok & ~held]] = True
        low = high
    for filled, found in zip(out, (done, stops, befores, afters)):
        filled[at] = found


def _leap(log: _Log, groups: np.ndarray | None = None, out: _Outcome | None = None) -> _Outcome:
    """applied, halted, before, after of each event, after the fold of ``groups`` (None: all)
    one after another. From a known state the next events are
    tried together: their deltas are summed up as if all were applied, which is right up
    to the first guarded one that goes below zero. That one is settled alone, and the next
    leap starts behind it, so steps are taken per refusal and not per event. A leap also
    ends before a set and before an event that waits for an outcome inside the leap. Where
    refusals are dense, a stretch of events is settled one by one (``_stretch``)."""
    applied, halted, before, after = out = _blank(log) if out is None else out
    groups, ends = np.arange(len(log.first)) if groups is None else groups, np.append(log.first[1:], log.size)
    linked = (log.gate >= 0).any() or (log.choice >= 0).any() or log.other.any()
    for low, high in zip(log.first[groups].tolist(), ends[groups].tolist()):
        state, i, size = log.start[low].copy(), low, LEAP
        halts = _Halts(log, low, high, halted) if log.who is not None else None
        while i < high:
            j = min(i + size, high)
            cut = np.flatnonzero(log.sets[i:j] | (log.waits[i:j] >= i))
            if len(cut) and cut[0] == 0:  # a set, alone
                before[i] = state
                if not halted[i] and log.may[i] and (log.gate[i] < 0 or applied[log.gate[i]]):
                    state = np.where(log.given[i], log.values[i], state)
                    applied[i] = True
                elif halts and not halted[i]:
                    halts.stop(i)
                after[i] = state
                i += 1
                continue
            if len(cut):
                j = i + int(cut[0])
            own = slice(i, j)
            ok = log.may[own]
            deltas = log.deltas[own]
            if linked:
                gate, choice = log.gate[own], log.choice[own]
                ok = ok & ((gate < 0) | applied[gate])
                other = log.other[own] | ((choice >= 0) & applied[choice])
                if log.other_deltas is not None and other.any():
                    deltas = np.where(other[:, None], log.other_deltas[own], deltas)
            if halts:
                ok = ok & ~halted[own]
            acts = ok & log.moves[own]
            run = np.cumsum(np.where(acts[:, None], deltas, 0), axis=0)
            run += state
            wrong = acts & log.guarded[own] & (run < 0).any(axis=1)
            if halts:
                wrong |= ~ok & ~halted[own]
            k = int(wrong.argmax()) if wrong.any() else j - i
            before[i] = state
            after[i:i + k] = run[:k]
            before[i + 1:i + k] = run[:max(k - 1, 0)]
            applied[i:i + k] = ok[:k]
            if k:
                state = run[k - 1].copy()
            if k == j - i:
                i, size = j, min(2 * size, LONGEST_LEAP)
                continue
            t = i + k
            before[t] = state
            if acts[k] and log.clamps[t]:
                state = np.maximum(state + deltas[k], 0)
                applied[t] = True
            elif halts:
                halts.stop(t)
            after[t] = state
            i, size = t + 1, LEAP
            if k < DENSE and i < high:
                j = min(i + STRETCH, high)
                state = _stretch(log, i, j, state.tolist(), applied, halted, before, after, halts)
                i = j
    return out


def _stretch(log: _Log, low: int, high: int, state: list[int], applied: np.ndarray, halted: np.ndarray, before: np.ndarray,
             after: np.ndarray, halts: _Halts | None) -> np.ndarray:
    """The events from ``low`` to ``high``, one by one in plain integers; the state after them."""
    befores, afters = [], []
    columns = [c[low:high].tolist() for c in (log.may, log.gate, log.choice, log.other, log.sets, log.moves, log.guarded, log.clamps, log.deltas)]
    for t, may, gate, choice, other, sets, moves, guarded, clamps, delta in zip(range(low, high), *columns):
        befores.append(state)
        if not halted[t]:
            ok = may and (gate < 0 or bool(applied[gate]))
            if ok and sets:
                state = [v if g else x for x, v, g in zip(state, log.values[t].tolist(), log.given[t].tolist())]
            elif ok and moves:
                if log.other_deltas is not None and (other or choice >= 0 and applied[choice]):
                    delta = log.other_deltas[t].tolist()
                moved = [x + d for x, d in zip(state, delta)]
                if not guarded or min(moved) >= 0:
                    state = moved
                elif clamps:
                    state = [max(x, 0) for x in moved]
                else:
                    ok = False
            applied[t] = ok
            if halts and not ok:
                halts.stop(t)
        afters.append(state)
    before[low:high], after[low:high] = befores, afters
    return np.array(state, np.int64)


class _Halts:
    """Marks the later events of a scope value of one group when it stops."""

    def __init__(self, log: _Log, low: int, high: int, halted: np.ndarray):
        self.low, self.who, self.halted = low, log.who[low:high], halted
        self.order = np.argsort(self.who, kind="stable")
        self.sorted = self.who[self.order]
        already = log.stopped[low].as_py() or []
        if already:
            codes = [i for i, name in enumerate(log.names.to_pylist()) if name in set(already)]
            halted[low:high] |= np.isin(self.who, codes)

    def stop(self, t: int) -> None:
        code = self.who[t - self.low]
        a, b = np.searchsorted(self.sorted, (code, code + 1))
        own = self.order[a:b]
        self.halted[self.low + own[own > t - self.low]] = True


def _fold_batches(groups: list[str], dims: list[str], mode_col: str, scope: str | None, id_col: str,
                  ref_col: str | None, alt_col: str | None, out: pa.Schema):
    """Folds batches sorted by (groups, order), the groups that are whole together. A group
    is a chunk of at most ``CHUNK_ROWS`` events and starts from the ``s_<dim>`` of its first
    row. For events of other groups ``gate`` and ``alt_ok`` tell the outcome, and
    ``__spent`` whether they were given back. With ``scope`` an event that isn't applied
    halts the later ones of its scope value; ``stopped`` lists those halted before."""
    def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        log = _Log(rows, groups, dims, mode_col, scope, id_col, ref_col, alt_col)
        applied, halted, before, after = _settle(log)
        columns = [rows[c] for c in rows.column_names] + [pa.array(applied)] + ([pa.array(halted)] if scope else [])
        columns += [pa.array(np.ascontiguousarray(before[:, k])) for k in range(len(dims))]
        columns += [pa.array(np.ascontiguousarray(after[:, k])) for k in range(len(dims))]
        yield from pa.table(columns, names=out.names).to_batches()

    def last_group(batch: pa.RecordBatch) -> int:
        """The row at which the batch's last group begins."""
        at = 0
        for g in groups:
            codes = np.asarray(pc.dictionary_encode(batch.column(g), null_encoding="encode").indices)
            change = np.flatnonzero(codes[1:] != codes[:-1])
            at = max(at, int(change[-1]) + 1 if len(change) else 0)
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                seen = pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in held[-1:]), batch]).combine_chunks().to_batches()[0]
                if change := last_group(seen):
                    at = change - (1 if held else 0)
                    yield from settled(pa.Table.from_batches([*held, batch.slice(0, at)]))
                    held, batch = [], batch.slice(at)
                    rows = batch.num_rows
            held.append(batch)
        if held:
            yield from settled(pa.Table.from_batches(held))

    return run


def _pass(events: DataFrame, groups: list[str], order: list[str], dims: list[str], mode_col: str,
          scope: str | None, id_col: str, ref_col: str | None, alt_col: str | None, made: dict[str, Column]) -> DataFrame:
    """One fold of every group of ``events`` from the start state in its rows; the columns
    ``made`` are added to what was exchanged."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ordered = events.repartition(*groups).sortWithinPartitions(*groups, *order).withColumns(made)
    schema = _out_schema(ordered, dims, scope is not None)
    return ordered.mapInArrow(_fold_batches(groups, dims, mode_col, scope, id_col, ref_col, alt_col, to_arrow_schema(schema)), schema)


def _chunked(events: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    """``events`` with ``__chunk``: ``rows`` events of a key, in order, are one. A place in the
    key is the place in a range partition plus the key's events in earlier partitions; only
    counts per (key, partition) are windowed."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    placed = _written(events.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
                      .withColumn("__part", F.shiftright(row, 33)).withColumn("__row", row.bitwiseAND(F.lit((1 << 33) - 1))), "ledger-placed")
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(key, "__part").agg(F.min("__row").alias("__low"), F.count("*").alias("__n")).select(
        F.col(key).alias("__k"), F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low")).alias("__shift"))
    return (placed.join(runs, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")))
            .withColumn("__chunk", F.floor((F.col("__row") + F.col("__shift")) / rows).cast("long"))
            .drop("__k", "__p", "__shift", "__part", "__row"))


def fold(events: DataFrame, key: str, order: list[str], dims: list[str], modes: set[str],
         mode_col: str = "mode", chunk: str | None = None, id_col: str = "op_id",
         ref_col: str | None = None, alt_col: str | None = None, halt_scope: str | None = None,
         initial: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS, outcomes: DataFrame | None = None,
         made: dict[str, Column] | None = None) -> DataFrame:
    """Fold ``events`` per ``key`` in ``order``; returns the events with ``applied``,
    ``before_<dim>`` and ``after_<dim>`` columns.

    ``modes`` is the set of modes the caller's log can contain (it picks the plan);
    ``chunk`` is a column that is monotone in ``order`` inside a key (a date is ideal) and
    splits a busy key of an associative log; ``ref_col`` and ``alt_col`` name the events an
    event depends on. With ``halt_scope`` the first event of a scope value that is not
    applied halts the later events of that value in the key: they are marked ``halted`` and
    change nothing (one sync request stops at its first bad op); such logs hold no
    references. ``initial`` gives start states (key and one column per dimension), and
    ``outcomes`` what became of earlier events that the log refers to but doesn't hold (key,
    ``id_col``, ``applied``, ``spent``: given back already). ``made`` gives columns, such
    as the mode, by what they are made of: an order-dependent log without references is
    written and exchanged without them. The result depends on neither ``chunk`` nor
    ``chunk_rows``."""
    whole, made = events.withColumns(made or {}), made or {}
    modes, columns = set(modes), whole.columns
    ref_col, alt_col = (c if c in columns else None for c in (ref_col, alt_col))
    if halt_scope and (ref_col or alt_col):
        raise ValueError("a log with references can't be halted")
    associative = not halt_scope and chunk and not ref_col and not alt_col
    if associative or ref_col or alt_col:
        events, made = whole, {}
    if associative and modes <= {ADD} and initial is None:
        return _running_sum(events, key, order, chunk, dims)
    plain = events.withColumn("stopped", F.lit(None).cast(T.ArrayType(whole.schema[halt_scope].dataType))) if halt_scope else events
    if initial is not None:
        starts = [F.coalesce(F.col(f"__i.{d}"), F.lit(0)).cast("bigint").alias(f"s_{d}") for d in dims]
        plain = plain.alias("__e").join(initial.alias("__i"), F.col(f"__e.{key}") == F.col(f"__i.{key}"), "left").select("__e.*", *starts)
    else:
        plain = plain.select("*", *[F.lit(0).cast("bigint").alias(f"s_{d}") for d in dims])
    if outcomes is not None:
        plain = _with_outcomes(plain, outcomes, key, id_col, ref_col, alt_col)
    out = [*columns, "applied", *(["halted"] if halt_scope else []),
           *[f"before_{d}" for d in dims], *[f"after_{d}" for d in dims]]
    if associative and modes <= {ADD, CLAMP, SET}:
        return _closed_scan(plain, key, order, chunk, dims, mode_col).select(*out)
    # written once: what made the events is not computed again for the count of a key
    stored = _written(plain, "ledger-events")
    largest = stored.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if largest <= chunk_rows:
        return _pass(stored, [key], order, dims, mode_col, halt_scope, id_col, ref_col, alt_col, made).select(*out)
    return _rounds(stored, key, order, dims, mode_col, id_col, ref_col, alt_col, halt_scope, chunk_rows, made).select(*out)


def _with_outcomes(events: DataFrame, outcomes: DataFrame, key: str, id_col: str, ref_col: str | None, alt_col: str | None) -> DataFrame:
    """``gate``, ``__spent`` and ``alt_ok`` of events that refer to events before the log."""
    known = outcomes.select(F.col(key).alias("__ok"), F.col(id_col).cast("string").alias("__oi"), "applied", "spent")
    for c, flags in ((ref_col, {"gate": "applied", "__spent": "spent"}), (alt_col, {"alt_ok": "applied"})):
        if c:
            named, others = events.filter(F.col(c).isNotNull()), events.filter(F.col(c).isNull())
            found = named.join(known, (F.col(key) == F.col("__ok")) & (F.col(c).cast("string") == F.col("__oi")), "left")
            found = found.select(*events.columns, *[F.coalesce(F.col(v), F.lit(False)).alias(k) for k, v in flags.items()])
            events = found.unionByName(others.select("*", *[F.lit(False).alias(k) for k in flags]))
    return events


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _referred(base: DataFrame, key: str, order: list[str], mode_col: str, id_col: str, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``base`` with, for each column of ``names`` (column -> flag), whether it names an event of
    an earlier chunk (<flag>_before), and ``__spent``: an earlier restore gave the event of
    the first column back. And the events named across chunks: __rk, __rid, __ok (true)."""
    place = F.struct(*order)
    events = base.select(F.col(key).alias("__xk"), F.col(id_col).cast("string").alias("__xi"), F.col("__chunk").alias("__xc"), place.alias("__xo"))
    asked, given = None, {f for f in ("gate", "alt_ok", "__spent") if f in base.columns}
    for f in given:
        base = base.withColumnRenamed(f, f"{f}_given")
    for k, (c, flag) in enumerate(names.items()):
        named, others = base.filter(F.col(c).isNotNull()), base.filter(F.col(c).isNull())
        found = named.join(events, (F.col(key) == F.col("__xk")) & (F.col(c).cast("string") == F.col("__xi")), "left")
        found = (found.withColumn("__earlier", F.coalesce(F.col("__xo") < place, F.lit(False)))
                 .withColumn(f"{flag}_before", F.col("__earlier") & (F.col("__xc") < F.col("__chunk"))))
        if k == 0:
            restored = Window.partitionBy(key, c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            found = found.withColumn("__spent", F.coalesce(F.max((F.col(mode_col) == RESTORE) & F.col("__earlier")).over(restored), F.lit(False)))
            others = others.withColumn("__spent", F.lit(False))
        base = found.drop("__xk", "__xi", "__xc", "__xo", "__earlier").unionByName(others.withColumn(f"{flag}_before", F.lit(False)))
        ids = base.filter(f"{flag}_before").select(F.col(key).alias("__rk"), F.col(c).cast("string").alias("__rid"))
        asked = ids if asked is None else asked.union(ids)
    if "__spent" in given:
        base = base.withColumn("__spent", F.col("__spent") | F.col("__spent_given"))
    return base, asked.distinct().withColumn("__ok", F.lit(True))


def _rounds(stored: DataFrame, key: str, order: list[str], dims: list[str], mode_col: str, id_col: str,
            ref_col: str | None, alt_col: str | None, scope: str | None, chunk_rows: int, made: dict[str, Column]) -> DataFrame:
    """The fold of chunks in parallel rounds. The driver sees a count per round."""
    base, known = _chunked(stored, key, order, chunk_rows), None
    names = {c: flag for c, flag in ((ref_col, "gate"), (alt_col, "alt_ok")) if c}
    if names:
        base, known = _referred(_written(base, "ledger-chunks"), key, order, mode_col, id_col, names)
    base = _written(base, "ledger-base")
    known = _written(known, "ledger-known") if known is not None else None
    groups = [key, "__chunk"]
    firsts = [f"s_{d}" for d in dims] + (["stopped"] if scope else [])
    # round 1: chunks start from the sum of all deltas before them, references were applied
    total = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = base.groupBy(*groups).agg(*[F.sum(F.col(_d(d)).cast("bigint")).alias(f"t_{d}") for d in dims],
                                     *[F.first(c).alias(c) for c in firsts])
    guess = lambda d: F.when(F.col("__chunk") == 0, F.col(f"s_{d}")).otherwise(
        F.greatest(F.lit(0), F.col(f"s_{d}") + F.coalesce(F.sum(f"t_{d}").over(total), F.lit(0)))).alias(f"s_{d}")
    starts = _written(sums.select(*groups, *[guess(d) for d in dims], *(["stopped"] if scope else [])), "ledger-starts")
    todo, done = None, []
    while True:
        rows = base.drop(*firsts)
        if todo is not None:
            rows = rows.join(todo, groups, "left_semi")
        rows = rows.join(starts, groups)
        for c, flag in names.items():
            k = known.select(F.col("__rk").alias("__xk"), F.col("__rid").alias("__xi"), F.col("__ok").alias("__xo"))
            rows = rows.join(k, F.col(f"{flag}_before") & (F.col(key) == F.col("__xk")) & (F.col(c).cast("string") == F.col("__xi")), "left")
            given = F.col(f"{flag}_given") if f"{flag}_given" in rows.columns else F.lit(False)
            rows = rows.withColumn(flag, F.coalesce("__xo", given)).drop("__xk", "__xi", "__xo")
        folded = _written(_pass(rows, groups, order, dims, mode_col, scope, id_col, ref_col, alt_col, made), "ledger-round")
        done.append(folded.withColumn("__round", F.lit(len(done))))
        ends = folded.groupBy(*groups).agg(
            F.max_by(F.struct(*[f"after_{d}" for d in dims]), F.struct(*order)).alias("__end"),
            *([F.array_sort(F.array_union(F.coalesce(F.first("stopped"), F.array().cast(stored.schema["stopped"].dataType)),
                                          F.collect_set(F.when(~F.col("applied") & ~F.col("halted"), F.col(scope))))).alias("__stop")] if scope else []))
        nexts = ends.select(key, (F.col("__chunk") + 1).alias("__chunk"), *[F.col(f"__end.after_{d}").alias(f"n_{d}") for d in dims],
                            *([F.col("__stop").alias("n_stopped")] if scope else []))
        moved = starts.join(nexts, groups)
        changed = F.lit(False)
        for c in firsts:
            new = F.col("n_stopped" if c == "stopped" else f"n_{c[2:]}")
            old = F.array_sort(F.coalesce(F.col(c), F.array().cast(starts.schema[c].dataType))) if c == "stopped" else F.col(c)
            changed = changed | (new != old)
        moved = _written(moved.filter(changed), "ledger-moved")
        again = moved.select(*groups)
        if known is not None:
            now = folded.select(F.col(key).alias("__rk"), F.col(id_col).cast("string").alias("__rid"), F.col("applied").alias("__new"))
            flips = _written(known.join(now, ["__rk", "__rid"]).filter(F.col("__ok") != F.col("__new"))
                             .select("__rk", "__rid", F.col("__new").alias("__ok")), "ledger-flips")
            hit = flips.select(F.col("__rk").alias("__fk"), F.col("__rid").alias("__fi"))
            for c, flag in names.items():
                again = again.union(base.filter(f"{flag}_before").join(
                    hit, (F.col(key) == F.col("__fk")) & (F.col(c).cast("string") == F.col("__fi")), "left_semi").select(*groups))
            known = _written(known.join(flips.select("__rk", "__rid"), ["__rk", "__rid"], "left_anti").union(flips), "ledger-known")
        todo = _written(again.distinct(), "ledger-todo")
        if todo.isEmpty():
            break
        fresh = moved.select(*groups, *[F.col("n_stopped" if c == "stopped" else f"n_{c[2:]}").alias(c) for c in firsts])
        starts = _written(starts.join(fresh.select(*groups), groups, "left_anti").unionByName(fresh), "ledger-starts")
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    if len(done) > 1:
        last = result.groupBy(*groups).agg(F.max("__round").alias("__last"))
        result = result.join(last, groups).filter(F.col("__round") == F.col("__last"))
    return result
