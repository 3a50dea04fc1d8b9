"""Fixed-lifetime sessions: one login serves later rows of its key for ``ttl`` seconds.

Rules, row by row in ``(t, seq)`` order per key:

* no session: a row with ``opens`` logs in and starts one at its own time;
* live session: a row with ``closes`` whose age is strictly above the lifetime still
  runs on the old session and then ends it; activity never extends it;
* a ``reset`` row ends the session at once.

The same fold is the stay timer of an intermediate page (lifetime 30 s, clicks as
resets).

One plan for keys of every size. A key is one slice, a key above the mark of ``ordered``
is cut into slices along its time. A slice is a function from the state that enters it
(no session, or a login) to the state that leaves it, and that function is small:

* from "no session" everything is fixed;
* a login that enters ends at the first reset, or at the first ``closes`` row later
  than its time plus the lifetime. Which row that is follows from the login's time by a
  binary search over the slice's ``closes`` times, and after it the slice goes on as
  from "no session" at the next row.

Within a slice every possible login knows where its session ends and which login
follows (``searchsorted`` in NumPy); pointer doubling over these links gives, for every
row, the state a slice leaves with when it starts there with no session. Each slice
turns that into a table from login time to leaving state (equal neighbours merged). One
row per slice then goes to its key, where the tables are applied in order to find the
state that enters each slice. Slices entered with no session have their phases from the
first pass; only slices entered with a login are worked out again.

Rows without a key are dropped. Rows with a null ``t`` come first in their key and never
end a session by age.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.operators import ordered
from coverlane.session import settle

STEP_COLUMNS = ("t", "seq", "opens", "closes", "reset")
HOT_SLICE_SECONDS = 60
EARLIEST = -(2**62)

LOGIN, LIVE, LATE, NONE, RESET = "login", "live", "late", "none", "reset"

_SUMMARY = [("s_none", T.ArrayType(T.LongType())), ("s_ends", T.ArrayType(T.LongType())),
            ("s_exits", T.ArrayType(T.ArrayType(T.LongType()))), ("s_reset", T.ArrayType(T.LongType())), ("s_has_reset", T.BooleanType())]


Point = tuple[int, int]


def advance(login: Point | None, row: tuple, ttl_micros: int) -> tuple[str, Point | None, Point | None]:
    """One step of the rules (for the stream form): phase of the row, login it ran on, login left after it."""
    t, seq, opens, closes, reset = row
    if reset:
        return RESET, None, None
    if login is None:
        started = (t, seq) if opens else None
        return (LOGIN if opens else NONE), started, started
    if closes and t - login[0] > ttl_micros:
        return LATE, login, None
    return LIVE, login, login


class Slice:
    """The rows of one slice in order, with every login's end and the login that follows it."""

    def __init__(self, t: np.ndarray, seq: np.ndarray, opens: np.ndarray, closes: np.ndarray, reset: np.ndarray, ttl: int):
        self.t, self.seq, self.reset, self.ttl = t, seq, reset, ttl
        self.n = n = len(t)
        self.opens_at = np.flatnonzero(opens & ~reset)  # a reset row never logs in
        self.closes_at = np.flatnonzero(closes)
        self.resets_at = np.flatnonzero(reset)
        self.closes_t = t[self.closes_at]
        self.none = len(self.opens_at)  # the node "no session"
        self.end = np.minimum(self._reset_after(self.opens_at), self._late_close(t[self.opens_at] + ttl))
        after = np.where(self.end < n, self.next_login(self.end + 1), self.none)
        jump = np.where(self.end < n, after, np.arange(self.none))  # a login never ended stays
        jump = np.append(jump, self.none)
        while True:  # pointer doubling: every node to the last node of its chain
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        self.final = jump

    def _reset_after(self, rows: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.resets_at, rows, side="right")
        return np.where(k < len(self.resets_at), self.resets_at[np.minimum(k, len(self.resets_at) - 1)] if len(self.resets_at) else 0, self.n)

    def _late_close(self, limits: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.closes_t, limits, side="right")
        return np.where(k < len(self.closes_at), self.closes_at[np.minimum(k, len(self.closes_at) - 1)] if len(self.closes_at) else 0, self.n)

    def next_login(self, rows: np.ndarray) -> np.ndarray:
        """Node of the first login row at or after each row (``none`` if there is none)."""
        return np.searchsorted(self.opens_at, rows, side="left")

    def _state(self, node: int) -> list[int] | None:
        if node >= self.none:
            return None
        row = self.opens_at[node]
        return [int(self.t[row]), int(self.seq[row])]

    def leaving_from(self, row: int) -> list[int] | None:
        """The state after the slice when it has no session at ``row``."""
        return self._state(int(self.final[self.next_login(np.array([row]))[0]])) if row < self.n else None

    def table(self) -> dict:
        """The function from entering state to leaving state, as one row's values."""
        first_reset = int(self.resets_at[0]) if len(self.resets_at) else self.n
        before = self.closes_at < first_reset
        rows, limits = self.closes_at[before], self.closes_t[before]
        exits = [self.leaving_from(int(r) + 1) for r in rows]
        ends, kept = [], []
        for limit, leaving in zip(limits.tolist(), exits):
            if kept and kept[-1] == leaving:
                ends[-1] = limit
            else:
                ends.append(limit)
                kept.append(leaving)
        return {"s_none": self.leaving_from(0), "s_ends": ends, "s_exits": [x if x is not None else [] for x in kept],
                "s_reset": self.leaving_from(first_reset + 1) if first_reset < self.n else None, "s_has_reset": first_reset < self.n}

    def phases(self, entry: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phase, login time, login seq and whether a session holds the row, for the state that enters."""
        n = self.n
        phase = np.full(n, NONE, dtype=object)
        phase[self.reset] = RESET
        held_t, held_seq = np.zeros(n, np.int64), np.zeros(n, np.int64)
        held = np.zeros(n, bool)
        start = 0
        if entry is not None:
            end = int(min(self._reset_after(np.array([-1]))[0], self._late_close(np.array([entry[0] + self.ttl]))[0]))
            span = slice(0, end if end < n else n)
            phase[span], held[span], held_t[span], held_seq[span] = LIVE, True, entry[0], entry[1]
            if end < n and not self.reset[end]:
                phase[end], held[end], held_t[end], held_seq[end] = LATE, True, entry[0], entry[1]
            start = end + 1 if end < n else n
        chain, node = [], int(self.next_login(np.array([start]))[0]) if start < n else self.none
        while node < self.none:
            chain.append(node)
            if self.end[node] >= n:
                break
            node = int(self.next_login(np.array([self.end[node] + 1]))[0])
        if chain:
            at = self.opens_at[chain]
            ends = self.end[chain]
            rows = np.arange(start, n)
            k = np.searchsorted(at, rows, side="right") - 1
            inside = (k >= 0) & (rows <= np.where(k >= 0, ends[np.maximum(k, 0)], -1))
            mine, which = rows[inside], at[k[inside]]
            held[mine], held_t[mine], held_seq[mine] = True, self.t[which], self.seq[which]
            phase[mine] = LIVE
            phase[at] = LOGIN
            closed = ends[ends < n]
            late = closed[~self.reset[closed]]
            phase[late] = LATE
            gone = closed[self.reset[closed]]
            held[gone] = False
            phase[gone] = RESET
        held &= ~self.reset
        return phase, np.where(held, held_t, 0), np.where(held, held_seq, 0), held


def _masked(values: np.ndarray, held: np.ndarray) -> pd.Series:
    return pd.Series(pd.array(values, dtype="Int64")).mask(~held)


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    flag = lambda c: rows[c].fillna(False).to_numpy(bool)
    return (rows["t"].fillna(EARLIEST).to_numpy(np.int64), rows["seq"].fillna(0).to_numpy(np.int64),
            flag("opens"), flag("closes"), flag("reset"))


def _first_pass(ttl: int, key: str, columns: list[str]):
    """Over partitions sorted by (key, slice, t, seq): phases as if no session entered, and each hot slice's table.

    A slice may go on in the next batch; its rows wait until it is complete.
    """
    table_names = [n for n, _ in _SUMMARY]

    def finish(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        k = rows[key].to_numpy(object)
        o = rows["_order"].to_numpy(float)
        same = (k[1:] == k[:-1]) & ((o[1:] == o[:-1]) | (np.isnan(o[1:]) & np.isnan(o[:-1])))
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(rows)]
        t, seq, opens, closes, reset = _arrays(rows)
        phase = np.empty(len(rows), dtype=object)
        login_t, login_seq, held = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        tables = []
        hot = rows["_hot"].to_numpy(bool)
        for a, b in zip(cuts[:-1], cuts[1:]):
            sl = Slice(t[a:b], seq[a:b], opens[a:b], closes[a:b], reset[a:b], ttl)
            phase[a:b], login_t[a:b], login_seq[a:b], held[a:b] = sl.phases(None)
            if hot[a]:
                tables.append((a, sl.table()))
        yield rows.assign(phase=phase, login_t=_masked(login_t, held), login_seq=_masked(login_seq, held), _summary=False,
                          **{n: None for n in table_names})
        if tables:
            head = rows.iloc[[a for a, _ in tables]].reset_index(drop=True)
            yield head.assign(phase=None, login_t=None, login_seq=None, _summary=True,
                              **{n: pd.Series([tb[n] for _, tb in tables], dtype=object) for n in table_names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            if not len(rows):
                continue
            k, o = rows[key].iloc[-1], rows["_order"].iloc[-1]
            last_k = rows[key].to_numpy(object) == k
            last_o = rows["_order"].isna().to_numpy() if pd.isna(o) else (rows["_order"] == o).to_numpy()
            tail = np.flatnonzero(~(last_k & last_o))
            split = int(tail[-1]) + 1 if len(tail) else 0
            if split:
                yield from finish(rows.iloc[:split].reset_index(drop=True))
            waiting = rows.iloc[split:].reset_index(drop=True)
        if waiting is not None and len(waiting):
            yield from finish(waiting)

    return run


def _compose(ttl: int, key: str):
    """The tables of a hot key's slices applied in order: the login that enters each slice, where there is one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_order", na_position="first", kind="stable")
        state, found = None, []
        for _, r in rows.iterrows():
            if state is not None:
                found.append((r[key], r["_order"], state[0], state[1]))
                ends = np.asarray(r["s_ends"], np.int64)
                k = int(np.searchsorted(ends, state[0] + ttl, side="right"))
                if k < len(ends):
                    state = list(r["s_exits"][k]) or None
                elif r["s_has_reset"]:
                    state = list(r["s_reset"]) if r["s_reset"] is not None and len(r["s_reset"]) else None
            else:
                state = list(r["s_none"]) if r["s_none"] is not None and len(r["s_none"]) else None
        return pd.DataFrame(found, columns=[key, "_order", "entry_t", "entry_seq"])

    return run


def _again(ttl: int):
    """Phases of a slice that a login enters."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        entry = (int(rows["entry_t"].iloc[0]), int(rows["entry_seq"].iloc[0]))
        rows = rows.drop(columns=["entry_t", "entry_seq"]).sort_values(["t", "seq"], na_position="first", kind="stable")
        phase, login_t, login_seq, held = Slice(*_arrays(rows), ttl).phases(entry)
        return rows.reset_index(drop=True).assign(phase=phase, login_t=_masked(login_t, held), login_seq=_masked(login_seq, held))

    return run


def phases(df: DataFrame, key: str, ttl: float, keep: tuple[str, ...] = (), hot_rows: int | None = None) -> DataFrame:
    """Add ``phase``, ``login_t`` and ``login_seq`` to every row that has a key.

    ``df`` carries the key, ``t`` (microseconds), ``seq`` (unique within the key), the
    three flags and the columns named in ``keep``.
    """
    ttl_micros = round(ttl * 1_000_000)
    steps = df.filter(F.col(key).isNotNull()).select(key, *STEP_COLUMNS, *keep)
    by = ordered.Ordering((key,), ("t", "seq"), F.floor(F.col("t") / (HOT_SLICE_SECONDS * 1_000_000)), hot_rows)
    cut = ordered.cut_hot(steps, by).df
    sliced = cut.select(*steps.columns, F.col(ordered.SLICE).isNotNull().alias("_hot"),
                        F.col(ordered.SLICE)["cut"].cast("long").alias("_order"))
    out_fields = [*sliced.schema.fields, T.StructField("phase", T.StringType()), T.StructField("login_t", T.LongType()),
                  T.StructField("login_seq", T.LongType())]
    first_schema = T.StructType([*out_fields, T.StructField("_summary", T.BooleanType()), *[T.StructField(n, t) for n, t in _SUMMARY]])
    ready = sliced.repartition(key, "_order").sortWithinPartitions(key, "_order", "t", "seq")
    first = settle(ready.mapInPandas(_first_pass(ttl_micros, key, sliced.columns), first_schema), "session-slices")
    done = first.where(~F.col("_summary")).select([f.name for f in out_fields])
    tables = first.where(F.col("_summary") & F.col("_hot")).select(key, "_order", *[n for n, _ in _SUMMARY])
    entry_schema = T.StructType([sliced.schema[key], T.StructField("_order", T.LongType()),
                                 T.StructField("entry_t", T.LongType()), T.StructField("entry_seq", T.LongType())])
    entries = tables.groupBy(key).applyInPandas(_compose(ttl_micros, key), entry_schema)
    on = [key, "_order"]
    plain = ordered._join(done, entries.select(*on), on, "left_anti")
    redo = ordered._join(done.drop("phase", "login_t", "login_seq"), entries, on, "inner")
    again = redo.groupBy(key, "_order").applyInPandas(_again(ttl_micros), T.StructType(out_fields))
    return plain.unionByName(again).drop("_hot", "_order")


def summary(rows: DataFrame, key: str) -> DataFrame:
    """One row per session: when it began, how it ended and how many rows it served."""
    held = rows.filter(F.col("login_seq").isNotNull())
    return held.groupBy(key, "login_t", "login_seq").agg(
        F.count("*").alias("n_rows"),
        F.max(F.when(F.col("phase") == LATE, F.col("seq"))).alias("late_seq"),
        F.max("t").alias("last_t"))


def active_at_end(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose session is still open after their last row."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("phase", "login_t"), F.struct("t", "seq")).alias("last"))
    return last.filter(F.col("last.phase").isin(LOGIN, LIVE)).select(key, "last.login_t")
