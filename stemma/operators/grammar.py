"""Context-free grammars in binary form: inside and outside weights, expected rule counts, likeliest parses, brackets.

A grammar is a list of rules (lhs, left, right, weight) and of emissions (lhs, symbol, weight); ``closures``
brings others into this form.  Strings are stacked: a chart has all spans of one length and all strings of a
stack side by side, so the loops are over span lengths, splits and rules, not over strings or places.

A chart takes 8 bytes for each nonterminal and span, about length squared / 2; a stack holds as many strings as fit
``STACK_BYTES``.  Work grows as the cube of a string's length, so a string above ``max_length`` is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_ZERO = -1e30
MAX_LENGTH, STACK_BYTES = 512, 32 << 20


class Chart:
    """Inside log-weights of stacked strings, and on demand what follows from them.

    ``xs`` (strings, longest) is filled up with -1.  ``inside[s]`` holds spans of s symbols as (places, nonterminals, strings).
    """

    def __init__(self, xs: np.ndarray, lengths: np.ndarray, symbols: int, rules: Sequence[tuple], emissions: Sequence[tuple], start: int = 0, best: bool = False):
        self.rules, self.emissions, self.start, self.lengths, self.xs = rules, emissions, start, lengths, xs
        self.symbols, (self.n, self.longest) = symbols, xs.shape
        self.weight = np.log([r[3] for r in rules]) if rules else np.zeros(0)
        self.best = best
        self.inside = [self._empty(s) for s in range(self.longest + 1)]
        #: of the best way: 1 + the rule's number + the number of rules times (split - 1); 0 where there is none
        self.back = [np.zeros(t.shape, np.int32) for t in self.inside] if best else []
        join = np.maximum if best else np.logaddexp
        for a, x, w in emissions:
            one = self.inside[1][:, a] if self.longest else None
            if one is not None:
                one[:] = np.where(xs.T == x, join(one, np.log(w)), one)
        for s in range(2, self.longest + 1):
            self._fill(s)

    def _empty(self, s: int) -> np.ndarray:
        return np.full((self.longest - s + 1, self.symbols, self.n), LOG_ZERO)

    def _parts(self, s: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The left parts of k symbols and the right parts of s - k of all spans of s."""
        m = self.longest - s + 1
        return self.inside[k][:m], self.inside[s - k][k : k + m]

    def _fill(self, s: int) -> None:
        out = self.inside[s]
        for k in range(1, s):
            left, right = self._parts(s, k)
            for r, (a, b, c, _) in enumerate(self.rules):
                way = self.weight[r] + left[:, b] + right[:, c]
                if self.best:
                    more = way > out[:, a]
                    out[:, a] = np.where(more, way, out[:, a])
                    self.back[s][:, a] = np.where(more, 1 + r + len(self.rules) * (k - 1), self.back[s][:, a])
                else:
                    out[:, a] = np.logaddexp(out[:, a], way)
        np.maximum(out, LOG_ZERO, out=out)

    def totals(self) -> np.ndarray:
        """Each string's log-weight; an empty one has none."""
        out = np.full(self.n, LOG_ZERO)
        for r, length in enumerate(self.lengths.tolist()):
            if length:
                out[r] = self.inside[length][0, self.start, r]
        return out

    def outside(self) -> list[np.ndarray]:
        """Log-weights of all that is around each span, by length as ``inside``."""
        out = [self._empty(s) for s in range(self.longest + 1)]
        for r, length in enumerate(self.lengths.tolist()):
            out[length][0, self.start, r] = 0.0
        for s in range(self.longest, 1, -1):
            m = self.longest - s + 1
            for k in range(1, s):
                left, right = self._parts(s, k)
                for r, (a, b, c, _) in enumerate(self.rules):
                    above = self.weight[r] + out[s][:, a]
                    for side, other, at in ((out[k][:m, b], right[:, c], 0), (out[s - k][k : k + m, c], left[:, b], k)):
                        np.logaddexp(side, above + other, out=side)
            for t in range(1, s):
                np.maximum(out[t], LOG_ZERO, out=out[t])
        return out

    def expected(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each rule and each emission is expected in the parses of each string: (rules, strings), (emissions, strings)."""
        out, total = self.outside(), self.totals()
        live = total > LOG_ZERO / 2
        total = np.where(live, total, 0.0)
        rules, emitted = np.zeros((len(self.rules), self.n)), np.zeros((len(self.emissions), self.n))
        for s in range(2, self.longest + 1):
            for k in range(1, s):
                left, right = self._parts(s, k)
                for r, (a, b, c, _) in enumerate(self.rules):
                    rules[r] += np.exp(self.weight[r] + out[s][:, a] + left[:, b] + right[:, c] - total).sum(0)
        for e, (a, x, w) in enumerate(self.emissions):
            if self.longest:
                emitted[e] = (np.exp(np.log(w) + out[1][:, a] - total) * (self.xs.T == x)).sum(0)
        return rules * live, emitted * live

    def parse(self, r: int) -> list[tuple[int, int, int, int, int]]:
        """(node, parent, nonterminal, begin, end) of the best parse of one string in preorder; none where it has no parse.

        Of equally good ways the one with the smallest left part is taken, and of those the first rule.
        """
        length = int(self.lengths[r])
        if not length or self.inside[length][0, self.start, r] <= LOG_ZERO / 2:
            return []
        out, stack = [], [(-1, self.start, 0, length)]
        while stack:
            parent, a, i, s = stack.pop()
            node = len(out)
            out.append((node, parent, a, i, i + s))
            if s > 1:
                k, rule = divmod(int(self.back[s][i, a, r]) - 1, len(self.rules))
                _, b, c, _ = self.rules[rule]
                stack += [(node, c, i + k + 1, s - k - 1), (node, b, i, k + 1)]
        return out


def stacks(xs: list, symbols: int, max_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, filled-up strings, lengths) of strings of like lengths, as many as fit a stack."""
    lengths = np.array([0 if x is None else len(x) for x in xs], np.int64)
    if (lengths > max_length).any():
        raise ValueError("a string is longer than max_length")
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * symbols * 8 * (lengths[order[end]] + 1) ** 2 // 2 <= STACK_BYTES and lengths[order[end]] <= 2 * lengths[order[at]] + 8:
            end += 1
        rows = order[at:end]
        filled = np.full((len(rows), int(lengths[rows].max())), -1, np.int64)
        for k, r in enumerate(rows.tolist()):
            if lengths[r]:
                filled[k, : lengths[r]] = xs[r]
        yield rows, filled, lengths[rows]
        at = end


def _charts(batch: pa.RecordBatch, symbols, rules, emissions, start, max_length, best=False) -> Iterator[tuple[np.ndarray, Chart]]:
    for rows, filled, lengths in stacks(batch.column(1).to_pylist(), symbols, max_length):
        yield rows, Chart(filled, lengths, symbols, rules, emissions, start, best)


def parsed(strings: DataFrame, symbols: int, rules: Sequence[tuple], emissions: Sequence[tuple], *, start: int = 0, max_length: int = MAX_LENGTH) -> DataFrame:
    """key, inside, best: the log-weight of all parses and of the best one of each array xs; LOG_ZERO where it has none."""

    def run(batches):
        for b in batches:
            inside, best = np.full(b.num_rows, LOG_ZERO), np.full(b.num_rows, LOG_ZERO)
            for out, kind in ((inside, False), (best, True)):
                for rows, chart in _charts(b, symbols, rules, emissions, start, max_length, kind):
                    out[rows] = chart.totals()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(inside), pa.array(best)], ["key", "inside", "best"])

    return strings.select(F.col("key").cast("long").alias("key"), "xs").mapInArrow(run, "key long, inside double, best double")


def rule_counts(strings: DataFrame, symbols: int, rules: Sequence[tuple], emissions: Sequence[tuple], *, start: int = 0, max_length: int = MAX_LENGTH) -> DataFrame:
    """kind (rule or emission), number, n: how often each is expected over the parses of all strings xs.

    A task adds up its strings' counts before anything is exchanged.
    """

    def run(batches):
        r, e = np.zeros(len(rules)), np.zeros(len(emissions))
        for b in batches:
            for _, chart in _charts(b, symbols, rules, emissions, start, max_length):
                of_rules, of_emissions = chart.expected()
                r += of_rules.sum(1)
                e += of_emissions.sum(1)
        kinds = ["rule"] * len(r) + ["emission"] * len(e)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([*range(len(r)), *range(len(e))], pa.int32()), pa.array(np.concatenate([r, e]))], ["kind", "number", "n"])

    made = strings.select("key", "xs").mapInArrow(run, "kind string, number int, n double")
    return made.groupBy("kind", "number").agg(F.sum("n").alias("n"))


def likeliest_parses(strings: DataFrame, symbols: int, rules: Sequence[tuple], emissions: Sequence[tuple], *, start: int = 0, max_length: int = MAX_LENGTH) -> DataFrame:
    """key, node, parent, nonterminal, begin, end: the nodes of each string's best parse in preorder; the root's parent is -1."""
    names = ["node", "parent", "nonterminal", "begin", "end"]

    def run(batches):
        for b in batches:
            for rows, chart in _charts(b, symbols, rules, emissions, start, max_length, True):
                nodes = [(int(r), *node) for k, r in enumerate(rows.tolist()) for node in chart.parse(k)]
                flat = np.array(nodes, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(flat[:, 0])), *(pa.array(flat[:, k].astype(np.int32)) for k in range(1, 6))], ["key", *names])

    return strings.select(F.col("key").cast("long").alias("key"), "xs").mapInArrow(run, "key long, " + ", ".join(f"{n} int" for n in names))


def is_binary(rules: Sequence[tuple], emissions: Sequence[tuple]) -> bool:
    return all(len(r) == 4 for r in rules) and all(len(e) == 3 for e in emissions)


def partners(brackets: Column) -> Column:
    """Of a dot-bracket string: an array with each position's partner, -1 where it has none; null if it doesn't balance."""
    zero = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<i:int,j:int>>").alias("pairs"), F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        opens, closes = c == "(", c == ")"
        can = closes & (F.size(s["open"]) > 0)
        pair = F.array(F.struct(F.get(s["open"], F.size(s["open"]) - 1).alias("i"), s["at"].alias("j")))
        return F.struct(
            F.when(opens, F.concat(s["open"], F.array(s["at"]))).when(can, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"]).alias("open"),
            F.when(can, F.concat(s["pairs"], pair)).otherwise(s["pairs"]).alias("pairs"), (s["at"] + 1).alias("at"), (s["ok"] & (~closes | can)).alias("ok"),
        )

    done = F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), zero, step, lambda s: F.when(s["ok"] & (F.size(s["open"]) == 0), s["pairs"]))
    other = lambda i: F.coalesce(F.get(F.filter(done, lambda p: p["i"] == i), F.lit(0))["j"], F.get(F.filter(done, lambda p: p["j"] == i), F.lit(0))["i"], F.lit(-1))
    return F.when(done.isNotNull(), F.when(F.length(brackets) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.length(brackets) - 1, F.lit(0))), other)).otherwise(F.array().cast("array<int>")))
