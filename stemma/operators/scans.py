"""Ordered recurrences over long sequences, by blocks of rows.

A row updates a state that the row before it left: an average, or a hidden Markov model's forward or backward
vector.  Updates compose, so a block of rows is first reduced to its own update, the blocks of one key, a row
each, are scanned next, and then every block runs again from the state that reaches it.  Rows are dealt by
ranges of (key, order), so a sequence of any length spreads over as many tasks as it has blocks, and no
row holds more than itself.

Within a block the same is done once more: strips of ``STRIP`` rows advance side by side, one row of each at a time.

A null key is a key of its own; a null or NaN value makes its row's state and those after it in the key null;
rows equal in key and order follow one another in no set order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.storage import stored

BLOCK, STRIP = 1 << 16, 64


class Affine:
    """y = a y + b, from ``start``: elements are (a, b), updates too."""

    width, update_width = 1, 2

    def __init__(self, start: float):
        self.start = np.array([start])

    def identity(self, k: int) -> np.ndarray:
        return np.tile([1.0, 0.0], (k, 1))

    def then(self, update: np.ndarray, element: np.ndarray) -> np.ndarray:
        a, b = element[..., 0], element[..., 1]
        return np.stack([a * update[..., 0], a * update[..., 1] + b], -1)

    def first(self, element: np.ndarray) -> np.ndarray:
        """The state after an element that begins a sequence."""
        return element[..., :1] * self.start + element[..., 1:]

    def constant(self, state: np.ndarray) -> np.ndarray:
        """The update that forgets what was before."""
        return np.concatenate([np.zeros_like(state), state], -1)

    def apply(self, state: np.ndarray, update: np.ndarray) -> np.ndarray:
        return update[..., :1] * state + update[..., 1:]

    step = apply

    def both(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.array([two[0] * one[0], two[0] * one[1] + two[1]])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


class LogChain:
    """A vector of n log-weights, multiplied by a table and then weighed by each row's element.

    An update is a table of n x n log-weights and a flag, last, that says it forgets what was before: then each of its rows is the state.
    """

    def __init__(self, start: np.ndarray, trans: np.ndarray):
        self.start, self.trans = start, trans
        self.width = len(start)
        self.update_width = self.width**2 + 1

    def identity(self, k: int) -> np.ndarray:
        eye = np.where(np.eye(self.width) > 0, 0.0, -1e30).ravel()
        return np.tile(np.append(eye, 0.0), (k, 1))

    def _table(self, update: np.ndarray) -> np.ndarray:
        return update[..., :-1].reshape(*update.shape[:-1], self.width, self.width)

    def then(self, update: np.ndarray, element: np.ndarray) -> np.ndarray:
        made = _lse(self._table(update)[..., :, :, None] + self.trans, -2) + element[..., None, :]
        return np.concatenate([made.reshape(*update.shape[:-1], -1), update[..., -1:]], -1)

    def first(self, element: np.ndarray) -> np.ndarray:
        return self.start + element

    def constant(self, state: np.ndarray) -> np.ndarray:
        rows = np.repeat(state[..., None, :], self.width, -2).reshape(*state.shape[:-1], -1)
        return np.concatenate([rows, np.ones((*state.shape[:-1], 1))], -1)

    def apply(self, state: np.ndarray, update: np.ndarray) -> np.ndarray:
        table = self._table(update)
        return np.where(update[..., -1:] > 0, table[..., 0, :], _lse(state[..., :, None] + table, -2))

    def step(self, state: np.ndarray, element: np.ndarray) -> np.ndarray:
        return _lse(state[..., :, None] + self.trans, -2) + element

    def both(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        if two[-1] > 0:
            return two
        return np.append(_lse(self._table(one)[:, :, None] + self._table(two)[None], 1).ravel(), one[-1])


def _strips(values: np.ndarray, fill) -> np.ndarray:
    """Rows as (strip, place in it, ...), the last strip filled up."""
    k = -(-len(values) // STRIP)
    out = np.full((k * STRIP, *values.shape[1:]), fill, values.dtype)
    out[: len(values)] = values
    return out.reshape(k, STRIP, *values.shape[1:])


def reduced(kind, elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The update that a stretch of rows amounts to, as one row a strip."""
    e, f = _strips(elements, 0.0), _strips(first, False)
    there = _strips(np.ones(len(elements), bool), False)
    update = kind.identity(len(e))
    for t in range(STRIP):
        new = np.where(f[:, t, None], kind.constant(kind.first(e[:, t])), kind.then(update, e[:, t]))
        update = np.where(there[:, t, None], new, update)
    return update


def composed(kind, updates: np.ndarray) -> np.ndarray:
    """One update that does what all of ``updates`` do in their order."""
    out = kind.identity(1)[0]
    for u in updates:
        out = kind.both(out, u)
    return out


def states(kind, elements: np.ndarray, first: np.ndarray, incoming: np.ndarray) -> np.ndarray:
    """The state after each row of a block that ``incoming`` reaches."""
    updates, before = reduced(kind, elements, first), []
    for u in updates:
        before.append(incoming)
        incoming = kind.apply(incoming, u)
    e, f, state = _strips(elements, 0.0), _strips(first, False), np.array(before)
    out = np.empty((len(e), STRIP, kind.width))
    for t in range(STRIP):
        state = np.where(f[:, t, None], kind.first(e[:, t]), kind.step(state, e[:, t]))
        out[:, t] = state
    return out.reshape(-1, kind.width)[: len(elements)]


def placed(rows: DataFrame, key: str, order: Sequence[str], block: int) -> DataFrame:
    """``rows`` with _block and _at: numbered blocks of rows in order of key and ``order``, stored."""
    schema = Ty.StructType([*rows.schema.fields, Ty.StructField("_block", Ty.LongType()), Ty.StructField("_at", Ty.LongType())])

    def run(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            here = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((part << 32) + here // block), pa.array(here)], names=schema.names)

    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return stored(dealt.mapInArrow(run, schema), "placed")


def _turns(column) -> np.ndarray:
    """Whether each key differs from the one before it; the first row's counts as different."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]


def scanned(rows: DataFrame, key: str, order: Sequence[str], passes: Sequence[tuple], outputs: Callable, fields: list[Ty.StructField], block: int = BLOCK) -> DataFrame:
    """``rows`` with further columns that follow from the states of some passes over each key's rows.

    A pass is (kind, elements, backward): ``elements(table)`` gives numbers for each row of an Arrow table.
    ``outputs(table, found)`` gives the new columns, of the types of ``fields``; found has, for each pass, the states after and
    before each row, both in the table's order.
    """
    made = placed(rows, key, order, block)
    names = rows.columns
    key_field = Ty.StructField("_key", rows.schema[key].dataType)
    number, vector = lambda n: Ty.StructField(n, Ty.LongType()), lambda n: Ty.StructField(n, Ty.ArrayType(Ty.DoubleType()))

    def ways(table):
        """For each pass the elements in its direction, and which rows begin a key there."""
        turn = _turns(table[key])
        for kind, elements, backward in passes:
            e = np.asarray(elements(table), float)
            yield (kind, e[::-1], np.append(turn[1:], True)[::-1], True) if backward else (kind, e, turn, False)

    def pieces(table):
        """A block's first and last key in each pass: the update its rows amount to, and the state they leave if they begin the key."""
        table = table.sort_by("_at")
        keys, found = [], []
        for k, (kind, e, first, backward) in enumerate(ways(table)):
            cut = np.flatnonzero(first)
            for lo, hi in dict.fromkeys([(0, int(cut[1]) if len(cut) > 1 else len(e)), (int(cut[-1]), len(e))]):
                inner = np.zeros(hi - lo, bool)
                update = composed(kind, reduced(kind, e[lo:hi], inner))
                inner[0] = True
                state = kind.apply(np.zeros(kind.width), composed(kind, reduced(kind, e[lo:hi], inner)))
                keys.append(len(e) - 1 - lo if backward else lo)
                found.append((k, update.tolist(), state.tolist()))
        block_of = [table["_block"][0].as_py()] * len(found)
        columns = [table[key].take(pa.array(keys)), *(pa.array(v) for v in (block_of, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]))]
        return pa.table(columns, names=["_key", "_block", "_pass", "_update", "_begun"])

    def carried(table):
        """The state that reaches each further block of one key in one pass."""
        kind, _, backward = passes[table["_pass"][0].as_py()]
        table = table.sort_by([("_block", "descending" if backward else "ascending")])
        state, out = np.array(table["_begun"][0].as_py()), []
        for update in table["_update"].to_pylist()[1:]:
            out.append(state.tolist())
            state = kind.apply(state, np.array(update))
        return pa.table({"_block": table["_block"].slice(1), "_pass": table["_pass"].slice(1), "_state": pa.array(out, pa.list_(pa.float64()))})

    def finish(table, reaching):
        table = table.sort_by("_at")
        given, found = dict(zip(reaching["_pass"].to_pylist(), reaching["_state"].to_pylist(), strict=True)), []
        for k, (kind, e, first, backward) in enumerate(ways(table)):
            first = first.copy()
            first[:1] = k not in given
            incoming = np.array(given.get(k, np.zeros(kind.width)))
            after = states(kind, e, first, incoming)
            before = np.where(first[:, None], kind.start, np.concatenate([incoming[None], after[:-1]]))
            found.append((after[::-1], before[::-1]) if backward else (after, before))
        return pa.table([*(table[n] for n in names), *outputs(table, found)], names=[*names, *(f.name for f in fields)])

    piece = Ty.StructType([key_field, number("_block"), number("_pass"), vector("_update"), vector("_begun")])
    seen = made.groupBy("_block").applyInArrow(pieces, piece)
    reaching = seen.groupBy("_key", "_pass").applyInArrow(carried, Ty.StructType([number("_block"), number("_pass"), vector("_state")]))
    return made.groupBy("_block").cogroup(reaching.groupBy("_block")).applyInArrow(finish, Ty.StructType([*rows.schema.fields, *fields]))


def nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), from_pandas=True)


def affine(rows: DataFrame, key: str, order: Sequence[str], a: Column, b: Column, out: str, *, start: float, backward: bool = False, before: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: y = a y + b over each key's rows from ``start``, after each row or ``before`` it."""
    given = rows.withColumns({"_a": a.cast("double"), "_b": b.cast("double")})
    elements = lambda t: np.stack([t["_a"].to_numpy(), t["_b"].to_numpy()], 1)
    outputs = lambda t, found: [nullable(found[0][int(before)][:, 0])]
    return scanned(given, key, order, [(Affine(start), elements, backward)], outputs, [Ty.StructField(out, Ty.DoubleType())], block).drop("_a", "_b")


def state_posteriors(symbols: DataFrame, key: str, order: str, value: str, start: Sequence[float], trans: Sequence[Sequence[float]], emit: Sequence[Sequence[float]], *, block: int = BLOCK) -> DataFrame:
    """key, order, loglik of the whole sequence and posteriors, an array of state probabilities, for each symbol of sequences of any length."""
    with np.errstate(divide="ignore"):
        s, t, e = (np.maximum(np.log(np.asarray(v, float)), -1e30) for v in (start, trans, emit))
    elements = lambda table: e.T[table[value].to_numpy().astype(np.int64)]

    def outputs(table, found):
        both = found[0][0] + found[1][0] - elements(table)  # forward, and backward without the symbol counted twice
        total = _lse(both, 1) if len(both) else np.zeros(0)
        p = np.exp(both - total[:, None])
        return [pa.array(total), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(s), pa.int32()), pa.array(p.ravel()))]

    fields = [Ty.StructField("loglik", Ty.DoubleType()), Ty.StructField("posteriors", Ty.ArrayType(Ty.DoubleType()))]
    # backward, a state is the weight of a symbol and all after it, so the same recurrence runs from nothing over the turned table
    passes = [(LogChain(s, t), elements, False), (LogChain(np.zeros(len(s)), t.T), elements, True)]
    return scanned(symbols.select(key, order, value), key, [order], passes, outputs, fields, block).drop(value)
