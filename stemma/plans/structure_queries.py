"""Registered queries of grammars, silent states and messages on trees, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import annealing, beam, closures, em, grammar, markov, minimise, pair_times, pairwise, phylogeny, substitution, unaligned
from ..sources import tables as T
from .model_queries import FORWARD, XI
from .registry import BINNED, CENTRES_SQL, EDGES, EV, GAMMA, HMM, LEAF, RATES, STATES, _lifted, _paths, match_counts, pair_sql, query

#: A small grammar of nested and chained spans over the three states.
RULES = [(0, 0, 0, 0.3), (0, 1, 2, 0.3), (2, 0, 1, 1.0)]
EMISSIONS = [(0, 0, 0.2), (0, 1, 0.1), (0, 2, 0.1), (1, 0, 0.5), (1, 1, 0.25), (1, 2, 0.25)]
#: The SQL below holds for pairs of up to so many columns (the greatest at any size of the tables has 17).
SPANS = 18


def _strings(spark, d):
    return _paths(spark, d).select(F.col("pair_id").alias("key"), "xs")


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(repr, r)) + ')' for r in rows)}) AS v({names})"


def _inside_sql(rules, emissions) -> str:
    """Common tables rl, em, and cells (pair_id, i, s, a, p, b): all spans' total and best weights, span by span."""
    rows = [(k, *r) for k, r in enumerate(rules)]
    parts = [f"rl AS (SELECT * FROM {_values(rows, 'r, a, b, c, w')})", f"em AS (SELECT * FROM {_values([(k, *e) for k, e in enumerate(emissions)], 'r, a, x, w')})",
             "i1 AS MATERIALIZED (SELECT pair_id, pos AS i, 1 AS s, a, sum(w::DOUBLE) AS p, max(w::DOUBLE) AS b FROM (SELECT pair_id, pos, st FROM columns) JOIN em ON em.x = st - 1 GROUP BY ALL)", "u1 AS (SELECT * FROM i1)"]
    for s in range(2, SPANS + 1):
        parts.append(f"i{s} AS MATERIALIZED (SELECT l.pair_id, l.i, {s} AS s, rl.a, sum(w * l.p * r.p) AS p, max(w * l.b * r.b) AS b FROM u{s - 1} l JOIN rl ON rl.b = l.a JOIN u{s - 1} r ON r.pair_id = l.pair_id AND r.i = l.i + l.s AND r.s = {s} - l.s AND r.a = rl.c GROUP BY ALL)")
        parts.append(f"u{s} AS (SELECT * FROM u{s - 1} UNION ALL SELECT * FROM i{s})")
    parts.append(f"cells AS MATERIALIZED (SELECT * FROM u{SPANS}), size AS (SELECT pair_id, count(*) AS n FROM columns GROUP BY 1)")
    return ", ".join(parts)


@query(f"""WITH {_inside_sql(RULES, EMISSIONS)} SELECT pair_id AS key, round(coalesce(ln(p), -1e30), 7) AS inside, round(coalesce(ln(b), -1e30), 7) AS best FROM size LEFT JOIN (SELECT * FROM cells WHERE i = 0 AND a = 0) c USING (pair_id) WHERE c.s = n OR c.s IS NULL""")
def grammar_scores(spark, d):
    """Inside and best-parse log-weights of each pair's state string."""
    return grammar.parsed(_strings(spark, d), 3, RULES, EMISSIONS).select("key", F.round("inside", 7).alias("inside"), F.round("best", 7).alias("best"))


def _outside_sql() -> str:
    """Common tables top and around (pair_id, i, s, a, o): the weight of all that is around each span, the widest first."""
    parts = ["top AS (SELECT pair_id, n, p AS total FROM size JOIN cells USING (pair_id) WHERE i = 0 AND s = n AND a = 0)", f"w{SPANS + 1} AS (SELECT pair_id, 0 AS i, n AS s, 0 AS a, 1.0::DOUBLE AS o FROM top)"]
    for s in range(SPANS - 1, 0, -1):
        parts.append(f"""o{s} AS MATERIALIZED (SELECT pair_id, i, {s} AS s, a, sum(o) AS o FROM (
  SELECT u.pair_id, u.i, rl.b AS a, u.o * w * r.p AS o FROM w{s + 2} u JOIN rl ON rl.a = u.a JOIN cells r ON r.pair_id = u.pair_id AND r.i = u.i + {s} AND r.s = u.s - {s} AND r.a = rl.c WHERE u.s > {s}
  UNION ALL SELECT u.pair_id, u.i + u.s - {s}, rl.c, u.o * w * l.p FROM w{s + 2} u JOIN rl ON rl.a = u.a JOIN cells l ON l.pair_id = u.pair_id AND l.i = u.i AND l.s = u.s - {s} AND l.a = rl.b WHERE u.s > {s}) GROUP BY pair_id, i, a)""")
        parts.append(f"w{s + 1} AS (SELECT * FROM w{s + 2} UNION ALL SELECT * FROM o{s})")
    parts.append("around AS MATERIALIZED (SELECT * FROM w2)")
    return ", ".join(parts)


@query(f"""WITH {_inside_sql(RULES, EMISSIONS)}, {_outside_sql()}, rn AS (SELECT rl.r, sum(o * w * x.p * y.p / total) AS n FROM around u JOIN top USING (pair_id) JOIN rl ON rl.a = u.a JOIN cells x ON x.pair_id = u.pair_id AND x.i = u.i AND x.a = rl.b AND x.s < u.s JOIN cells y ON y.pair_id = u.pair_id AND y.i = u.i + x.s AND y.s = u.s - x.s AND y.a = rl.c GROUP BY 1),
en AS (SELECT em.r, sum(o * w / total) AS n FROM around u JOIN top USING (pair_id) JOIN columns c ON c.pair_id = u.pair_id AND c.pos = u.i JOIN em ON em.a = u.a AND em.x = st - 1 WHERE u.s = 1 GROUP BY 1)
SELECT 'rule' AS kind, r AS number, round(n, 3) AS n FROM rn UNION ALL SELECT 'emission', r, round(n, 3) FROM en""")
def grammar_rule_counts(spark, d):
    """How often each rule and emission is expected in the parses of all pairs' state strings."""
    return grammar.rule_counts(_strings(spark, d), 3, RULES, EMISSIONS).withColumn("n", F.round("n", 3))


@query()
def likeliest_parses(spark, d):
    """The nodes of each pair's best parse; tests enumerate all parses."""
    return grammar.likeliest_parses(_strings(spark, d), 3, RULES, EMISSIONS)


#: A grammar with empty and single right-hand sides, (lhs, rhs, weight), over the same symbols.
WIDE_RULES = [(0, (0, 1), 0.35), (0, (2,), 0.25), (0, (), 0.2), (1, (0, 2), 0.3), (1, (0,), 0.1), (2, (1,), 0.15), (2, (), 0.05)]
WIDE_EMISSIONS = [(0, 0, 0.2), (1, 0, 0.2), (1, 1, 0.4), (2, 2, 0.8)]


@query()
def closed_grammar_rule_counts(spark, d):
    """Expected counts of every rule of a grammar with empty and single right-hand sides, through its binary form."""
    closed = closures.Closed(3, WIDE_RULES, WIDE_EMISSIONS)
    found = {(r.kind, r.number): r.n for r in grammar.rule_counts(_strings(spark, d), 3, closed.rules, closed.emissions).collect()}  # a row a rule
    rules, emissions = closed.restored(*(np.array([found[kind, k] for k in range(len(rows))]) for kind, rows in (("rule", closed.rules), ("emission", closed.emissions))))
    rows = [("rule", k, float(n)) for k, n in enumerate(rules)] + [("emission", k, float(n)) for k, n in enumerate(emissions)]
    return spark.createDataFrame(rows, "kind string, number int, n double").withColumn("n", F.round("n", 3))


#: Two emitting states (0, 1) and two silent ones (2, 3).
SILENT = [[0.7, 0.05, 0.25, 0.0], [0.1, 0.7, 0.0, 0.2], [0.6, 0.0, 0.0, 0.4], [0.2, 0.35, 0.45, 0.0]]


def _silent_sql() -> str:
    t = _values([(a, b, w) for a, row in enumerate(SILENT) for b, w in enumerate(row) if w], "a, b, w")
    return f"""t AS (SELECT * FROM {t}),
walk AS (SELECT k AS a, k AS b, 1.0::DOUBLE AS w, 0 AS steps FROM (SELECT unnest([2, 3]) AS k) UNION ALL SELECT walk.a, t.b, sum(walk.w * t.w), steps + 1 FROM walk JOIN t ON t.a = walk.b WHERE t.b > 1 AND steps < 200 GROUP BY walk.a, t.b, steps + 1),
ring AS (SELECT a, b, sum(w) AS w FROM walk GROUP BY 1, 2),
via AS (SELECT x.a AS i, x.b AS p, y.a AS q, y.b AS j, x.w * r.w * y.w AS w FROM t x JOIN ring r ON r.a = x.b JOIN t y ON y.a = r.b WHERE x.a < 2 AND x.b > 1 AND y.b < 2),
eff AS (SELECT a AS i, b AS j, sum(w) AS w FROM (SELECT a, b, w FROM t WHERE a < 2 AND b < 2 UNION ALL SELECT i, j, w FROM via) GROUP BY 1, 2)"""


def _closed_hmm():
    closed = closures.closed_chain(np.array(SILENT), [2, 3])
    return HMM[0], (closed / closed.sum(1, keepdims=True)).tolist(), HMM[2]


def _closed_xi() -> tuple[str, str]:
    """FORWARD and XI at the closed chain's transitions."""
    _, t, _ = _closed_hmm()
    out = []
    for text in (FORWARD, XI):
        for i in (0, 1):
            for j in (0, 1):
                text = text.replace(f"ln({HMM[1][i][j]})", f"ln({{{i}{j}}})")
        out.append(_filled(text, t))
    return out[0], out[1]


def _filled(text: str, t) -> str:
    for i in (0, 1):
        for j in (0, 1):
            text = text.replace(f"{{{i}{j}}}", repr(t[i][j]))
    return text


_FW, _XI = _closed_xi()


@query(f"""WITH {EV}, {_FW}, {_silent_sql()}, x AS (SELECT src AS i, dst AS j, sum(p) AS n FROM ({_XI}) GROUP BY 1, 2), share AS (SELECT i, j, n / w AS m FROM x JOIN eff USING (i, j)),
direct AS (SELECT i AS src, j AS dst, m * t.w AS n FROM share JOIN t ON t.a = i AND t.b = j),
enter AS (SELECT i AS src, p AS dst, sum(m * via.w) AS n FROM share JOIN via USING (i, j) GROUP BY 1, 2),
leave AS (SELECT q AS src, j AS dst, sum(m * via.w) AS n FROM share JOIN via USING (i, j) GROUP BY 1, 2),
inner_ AS (SELECT s.a AS src, s.b AS dst, sum(m * x.w * r.w * s.w * z.w * y.w) AS n FROM share JOIN t x ON x.a = i AND x.b > 1 JOIN ring r ON r.a = x.b JOIN t s ON s.a = r.b AND s.b > 1 JOIN ring z ON z.a = s.b JOIN t y ON y.a = z.b AND y.b = j GROUP BY 1, 2)
SELECT src, dst, round(sum(n), 3) AS n FROM (SELECT * FROM direct UNION ALL SELECT * FROM enter UNION ALL SELECT * FROM leave UNION ALL SELECT * FROM inner_) GROUP BY 1, 2""")
def silent_state_transitions(spark, d):
    """Expected transitions of a model with silent states: of the closed chain by forward-backward, then given back to all steps."""
    found = markov.decoded(_paths(spark, d), "pair_id", *_closed_hmm())
    sums = found.agg(*(F.sum(F.element_at("expected", k + 1)).alias(f"n{k}") for k in range(4))).first()
    n = closures.restored_chain(np.array(SILENT), [2, 3], np.array(sums, float).reshape(2, 2))
    rows = [(a, b, float(n[a, b])) for a in range(4) for b in range(4) if SILENT[a][b]]
    return spark.createDataFrame(rows, "src int, dst int, n double").withColumn("n", F.round("n", 3))


def _fitted_model():
    return pair_times.Model(*RATES, *substitution.equal_rates(20))


@query()
def pair_posterior_times(spark, d):
    """Each pair's time by a Newton fit to its expected counts over all alignments, and its log-probability there."""
    return pair_times.pair_times(pairwise.ungapped(T.columns(spark, d)), _fitted_model())


@query()
def family_sequence_distances(spark, d):
    """The fitted time of every two first rows of a family's pairs."""
    rows = pairwise.ungapped(T.columns(spark, d)).join(T.pairs(spark, d), "pair_id").where("size(x) > 0")
    return pair_times.distances(rows.select("fam", F.col("pair_id").alias("name"), F.col("x").alias("seq")), _fitted_model())


def _over_branch(columns: list[str]) -> list[str]:
    """SQL of log-weights c after a branch of ``length``, given ``columns`` before it."""
    top = f"greatest({', '.join(columns)})"
    total = "(" + " + ".join(f"exp({c} - {top})" for c in columns) + ")"
    return [f"({top} + ln((1 - exp(-length * 1.5)) / 3 * {total} + exp(-length * 1.5) * exp({c} - {top})))" for c in columns]


def _lowered(level: str, letter: str, above: str, below: str) -> str:
    """SQL of one level downwards: the nodes of ``letter`` from those in ``above`` (node, l, e), with what is in ``below``."""
    ls, gs = ["l0", "l1", "l2"], ["g0", "g1", "g2"]
    up, out = _over_branch(ls), _over_branch(gs)
    return f"""{level} AS (SELECT node, parent, length, l0, l1, l2, h0, h1, h2, {', '.join(f'{v} AS e{k}' for k, v in enumerate(out))} FROM (
  SELECT x.node, x.parent, x.length, x.l0, x.l1, x.l2, a.e0 + a.l0 AS h0, a.e1 + a.l1 AS h1, a.e2 + a.l2 AS h2, {', '.join(f'a.e{k} + a.l{k} - u{k} AS g{k}' for k in range(3))} FROM (
    SELECT *, {', '.join(f'{v} AS u{k}' for k, v in enumerate(up))} FROM (SELECT edges.node, parent, length, coalesce(l0, 0) AS l0, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2 FROM edges LEFT JOIN {below} b ON b.node = edges.node WHERE edges.node LIKE '{letter}%' AND edges.node <> 'root') z) x
  JOIN {above} a ON a.node = x.parent) y)"""


_MESSAGES = f"""lf AS (SELECT 'o' || o_orderkey AS node, {LEAF} FROM orders), {_lifted('c1', 'lf')}, {_lifted('c2', 'c1')}, {_lifted('c3', 'c2')}, {_lifted('c4', 'c3')},
d0 AS (SELECT node, NULL AS parent, NULL::DOUBLE AS length, l0, l1, l2, 0.0 AS h0, 0.0 AS h1, 0.0 AS h2, ln(1.0 / 3) AS e0, ln(1.0 / 3) AS e1, ln(1.0 / 3) AS e2 FROM c4),
{_lowered('d1', 'r', 'd0', 'c3')}, {_lowered('d2', 'n', 'd1', 'c2')}, {_lowered('d3', 'c', 'd2', 'c1')}, {_lowered('d4', 'o', 'd3', 'lf')},
every AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4)"""


def _leaf_states(spark, d):
    status = F.col("o_orderstatus")
    return T.read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(status == "F", STATES["F"]).when(status == "O", STATES["O"]).when(status == "P", STATES["P"]).alias("state"))


@query(f"""WITH {_MESSAGES}, b AS (SELECT node, e0 + l0 AS b0, e1 + l1 AS b1, e2 + l2 AS b2, greatest(e0 + l0, e1 + l1, e2 + l2) AS top FROM every)
SELECT node, state, round(exp([b0, b1, b2][state + 1] - top) / (exp(b0 - top) + exp(b1 - top) + exp(b2 - top)), 5) AS p FROM b, (SELECT unnest([0, 1, 2]) AS state)""")
def node_state_marginals(spark, d):
    """Posterior of the state of every node of the region tree given all orders."""
    found = phylogeny.messages(T.edges(spark, d), _leaf_states(spark, d), 3)
    return phylogeny.node_marginals(found, 3).withColumn("p", F.round("p", 5))


_CELLS = " UNION ALL ".join(f"SELECT node, {a} AS a, {b} AS b, h{a} - {_over_branch(['l0', 'l1', 'l2'])[a]} + ln((1 - exp(-length * 1.5)) / 3{' + exp(-length * 1.5)' if a == b else ''}) + l{b} AS w FROM every WHERE parent IS NOT NULL" for a in range(3) for b in range(3))


@query(f"""WITH {_MESSAGES}, cells AS ({_CELLS}), t AS (SELECT *, max(w) OVER (PARTITION BY node) AS top FROM cells), p AS (SELECT node, a, b, exp(w - top) / sum(exp(w - top)) OVER (PARTITION BY node) AS p FROM t)
SELECT substr(node, 1, 1) AS level, a, b, round(sum(p), 2) AS n FROM p GROUP BY 1, 2, 3""")
def expected_branch_changes(spark, d):
    """Expected numbers of branches of each level with a state above and one below, given all orders."""
    found = phylogeny.branch_marginals(phylogeny.messages(T.edges(spark, d), _leaf_states(spark, d), 3), 3)
    return found.groupBy(F.substring("node", 1, 1).alias("level"), "a", "b").agg(F.round(F.sum("p"), 2).alias("n"))


_CENTRES = [(a * b) ** 0.5 for a, b in zip(EDGES, EDGES[1:], strict=False)]
_K, _DECAY = "(20.0 / 19)", "exp(-t::DOUBLE * 20 / 19)"


@query(f"""WITH {BINNED}, n AS (SELECT tau_bin, a, b, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY ALL), ct AS (SELECT * FROM (VALUES {CENTRES_SQL}) AS v(tau_bin, t)),
x AS (SELECT n, t, c, CAST(a = c AS INT) - 0.05 AS da, CAST(b = c AS INT) - 0.05 AS db, 0.05 + (CAST(a = b AS INT) - 0.05) * {_DECAY} AS p, {_DECAY} AS z FROM n JOIN ct USING (tau_bin), (SELECT unnest(range(20)) AS c)),
y AS (SELECT c, n / p AS w, t / 400 + (da + db) / 20 * (1 - z) / {_K} + da * db * t * z AS inside, t / 20 + da * (1 - z) / {_K} AS begun FROM x)
SELECT CAST(c AS INT) AS state, round(sum(w * inside), 4) AS dwell, round(sum(w * (begun - inside)) / 19, 4) AS changes FROM y GROUP BY c""")
def expected_substitution_statistics(spark, d):
    """Time spent in each residue, and changes out of it, expected of all matches under equal rates."""
    q, pi = substitution.equal_rates(20)
    dwell, jumps = substitution.statistics_of(substitution.count_tables(match_counts(spark, d), len(_CENTRES), 20), _CENTRES, q, pi)
    rows = [(k, float(dwell[k]), float(jumps[k].sum())) for k in range(20)]
    return spark.createDataFrame(rows, "state int, dwell double, changes double").select("state", F.round("dwell", 4).alias("dwell"), F.round("changes", 4).alias("changes"))


@query()
def fitted_exchangeabilities(spark, d):
    """Exchangeabilities of a reversible model fitted to all matches by EM; its likelihood never falls (tested)."""
    s, _, _ = substitution.fit_exchangeabilities(substitution.count_tables(match_counts(spark, d), len(_CENTRES), 20), _CENTRES, iterations=20)
    return spark.createDataFrame([(a, b, float(s[a, b])) for a in range(20) for b in range(a + 1, 20)], "a int, b int, exchange double")


@query()
def annealed_alignments(spark, d):
    """Each family's first rows aligned from scratch: pairs' posteriors at their own fitted times, annealed and refined."""
    rows = pairwise.ungapped(T.columns(spark, d)).join(T.pairs(spark, d), "pair_id").where("size(x) > 0")
    members = rows.select("fam", F.col("pair_id").alias("name"), F.col("x").alias("seq"))
    return annealing.annealed_members(members, lambda: pair_times.member_cells(_fitted_model(), threshold=0.01))


def _column_classes(spark, d):
    """The states of the orders' columns at each position, under four discrete-gamma rates."""
    leaves = T.columns(spark, d).select(F.col("pos").alias("col"), F.concat(F.lit("o"), "pair_id").alias("node"), (F.col("st") - 1).alias("state"))
    return substitution.column_classes(T.edges(spark, d), leaves, GAMMA, 3, "root")


def _rated_columns(level: str, below: str) -> str:
    """SQL of one pruning level for every column and rate at once."""
    to = ", ".join(f"sum({v}) AS l{k}" for k, v in enumerate(_over_branch(["l0", "l1", "l2"])))
    return f"{level} AS (SELECT col, k, speed, node, {to} FROM (SELECT b.col, b.k, b.speed, parent AS node, edges.length * b.speed AS length, l0, l1, l2 FROM {below} b JOIN edges ON edges.node = b.node) GROUP BY 1, 2, 3, 4)"


@query(f"""WITH lc AS (SELECT pos AS col, k, speed, 'o' || pair_id AS node, {', '.join(f'CASE WHEN st = {s + 1} THEN 0.0 ELSE -1e30 END AS l{s}' for s in range(3))} FROM columns, {_values([(k, float(r)) for k, r in enumerate(GAMMA)], 'k, speed')}),
{_rated_columns('b1', 'lc')}, {_rated_columns('b2', 'b1')}, {_rated_columns('b3', 'b2')}, {_rated_columns('b4', 'b3')},
g AS (SELECT col, k, greatest(l0, l1, l2) + ln((exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) / 3) AS logp FROM b4 WHERE node = 'root'),
t AS (SELECT *, max(logp) OVER (PARTITION BY col) AS top FROM g)
SELECT col, k, round(exp(logp - top) / sum(exp(logp - top)) OVER (PARTITION BY col), 5) AS p, CAST(min(CASE WHEN logp = top THEN k END) OVER (PARTITION BY col) AS INT) AS likeliest FROM t""")
def column_rate_posteriors(spark, d):
    """Posterior of four equally likely rates for each column of the orders' states on the region tree, and the likeliest one."""
    return substitution.class_posteriors(_column_classes(spark, d), [0.25] * 4).select("col", "k", F.round("p", 5).alias("p"), "likeliest")


@query()
def fitted_rate_weights(spark, d):
    """Weights of the four rates over all columns by EM; its likelihood never falls (tested)."""
    from ..functions.storage import stored

    weights, _ = substitution.fit_class_weights(stored(_column_classes(spark, d), "column_classes"), 4)
    return spark.createDataFrame([(k, float(r), float(w)) for k, (r, w) in enumerate(zip(GAMMA, weights, strict=True))], "k int, rate double, weight double")


def _suffix_grammar(spark, d):
    """A nonterminal for what is left of each pair's states from each column on, and one for each state."""
    from pyspark.sql import Window

    w = Window.partitionBy("pair_id").orderBy("pos")
    name = lambda pos: F.concat_ws(":", "pair_id", pos)
    rows = T.columns(spark, d).select("pair_id", "pos", "st", F.lead("pos").over(w).alias("next"))
    rules = rows.where("next is not null").select(name("pos").alias("lhs"), F.concat(F.lit("s"), "st").alias("left"), name("next").alias("right"), F.lit(1.0).alias("w"))
    ends = rows.where("next is null").select(name("pos").alias("lhs"), F.col("st").alias("x"), F.lit(1.0).alias("w"))
    states = spark.createDataFrame([(f"s{k}", k, 1.0) for k in (1, 2, 3)], "lhs string, x int, w double")
    return rules, ends.unionAll(states)


@query("""WITH s AS (SELECT pair_id, pos, string_agg(CAST(st AS VARCHAR), '') OVER (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM columns)
SELECT count(*) + 3 AS nonterminals, (SELECT count(DISTINCT rest) FROM (SELECT rest FROM s UNION ALL SELECT CAST(k AS VARCHAR) FROM (SELECT unnest([1, 2, 3]) AS k))) AS blocks, count(*) AS rules, (SELECT count(DISTINCT rest) FROM s WHERE length(rest) > 1) AS block_rules FROM s WHERE length(rest) > 0""".replace("count(*) AS rules", "count(*) FILTER (length(rest) > 1) AS rules"))
def minimal_suffix_grammar(spark, d):
    """How many nonterminals and rules are left when those with the same derivations become one: of all pairs' state strings, the distinct ends."""
    rules, emissions = _suffix_grammar(spark, d)
    made = minimise.blocks(rules, emissions)
    small, _ = minimise.quotient(rules, emissions, made)
    sizes = made.agg(F.count("*").alias("nonterminals"), F.countDistinct("block").alias("blocks"))
    return sizes.join(rules.agg(F.count("*").alias("rules"))).join(small.agg(F.count("*").alias("block_rules")))  # a row each


@query(pair_sql(best=False))
def beam_pair_logliks(spark, d):
    """Each pair's log-probability over a beam of 60 nats, which leaves out nothing that shows in six decimals."""
    rows = beam.pair_likelihoods(pairwise.ungapped(T.columns(spark, d)), *pairwise.model_arrays(*RATES[:2], 1.0, RATES[2], 20), width=60.0)
    return rows.select("pair_id", F.round("loglik", 6).alias("loglik"))


_STAY, _MOVE = "ln((1 - exp(-length * 1.5)) / 3 + exp(-length * 1.5))", "ln((1 - exp(-length * 1.5)) / 3)"


def _best_up(level: str, below: str) -> str:
    to = ", ".join(f"sum(greatest(l{k} + {_STAY}, greatest(l0, l1, l2) + {_MOVE})) AS l{k}" for k in range(3))
    return f"{level} AS (SELECT parent AS node, {to} FROM {below} JOIN edges USING (node) GROUP BY 1)"


_LEAST = "CASE WHEN round(l0, 9) >= greatest(round(l1, 9), round(l2, 9)) THEN 0 WHEN round(l1, 9) >= round(l2, 9) THEN 1 ELSE 2 END"


def _best_down(level: str, letter: str, above: str, below: str) -> str:
    return f"""{level} AS (SELECT node, CASE WHEN round([l0, l1, l2][above + 1] + {_STAY}, 9) >= round(greatest(l0, l1, l2) + {_MOVE}, 9) THEN above ELSE {_LEAST} END AS state FROM (
  SELECT edges.node, length, a.state AS above, coalesce(l0, 0) AS l0, coalesce(l1, 0) AS l1, coalesce(l2, 0) AS l2 FROM edges LEFT JOIN {below} b ON b.node = edges.node JOIN {above} a ON a.node = edges.parent WHERE edges.node LIKE '{letter}%' AND edges.node <> 'root'))"""


@query(f"""WITH lf AS (SELECT 'o' || o_orderkey AS node, {LEAF} FROM orders), {_best_up('c1', 'lf')}, {_best_up('c2', 'c1')}, {_best_up('c3', 'c2')}, {_best_up('c4', 'c3')},
d0 AS (SELECT node, {_LEAST} AS state FROM c4), {_best_down('d1', 'r', 'd0', 'c3')}, {_best_down('d2', 'n', 'd1', 'c2')}, {_best_down('d3', 'c', 'd2', 'c1')}, {_best_down('d4', 'o', 'd3', 'lf')}
SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4""")
def likeliest_node_states(spark, d):
    """The likeliest states of all nodes of the region tree together, given all orders."""
    return phylogeny.likeliest_states(T.edges(spark, d), _leaf_states(spark, d), 3).select("node", "state")


@query()
def hidden_markov_em(spark, d):
    """Emissions and transitions of a two-state model fitted to all pairs' states; its likelihood never falls (tested)."""
    from ..functions.storage import stored

    rows = stored(_strings(spark, d), "hidden_markov")
    (_, moves, shown), _ = em.fit(rows, em.HiddenMarkov(2, 3), tuple(np.array(v) for v in HMM), iterations=15)
    cells = [("move", a, b, float(moves[a, b])) for a in range(2) for b in range(2)] + [("show", a, x, float(shown[a, x])) for a in range(2) for x in range(3)]
    return spark.createDataFrame(cells, "kind string, state int, other int, p double")


@query()
def unaligned_fragment_rates(spark, d):
    """Rates of the fragment model from all pairs without their alignments; the log-probability never falls (tested)."""
    from ..functions.storage import stored

    (lam, mu, ext), trace = unaligned.fit(stored(pairwise.ungapped(T.columns(spark, d)), "unaligned"), 1.0, 20, start=RATES, iterations=4)
    return spark.createDataFrame([(lam, mu, ext, float(trace[-1]))], "lam double, mu double, ext double, loglik double")
