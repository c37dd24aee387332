"""Registered queries of hidden Markov and pair models, gap tables, rate parameters and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.storage import scratch, stored
from ..operators import cherries, counts, decoding, gaps, guards, markov, mixture, pairwise, scans, substitution, trees
from ..sources import tables as T
from ..streaming import jobs
from .registry import BINNED, EDGES, EV, HMM, MODEL, RATES, _bd, _binned, _log_model, _paths, _rates, gap_tally, pair_sql, query

LSE = "greatest({0}, {1}) + ln(1 + exp(-abs({0} - ({1}))))"
FORWARD = f"""fw AS (SELECT pair_id, pos, ln(0.6) + e0 AS s0, ln(0.4) + e1 AS s1 FROM ev WHERE pos = 0
  UNION ALL SELECT ev.pair_id, ev.pos, e0 + {LSE.format('s0 + ln(0.9)', 's1 + ln(0.2)')}, e1 + {LSE.format('s0 + ln(0.1)', 's1 + ln(0.8)')} FROM fw JOIN ev ON ev.pair_id = fw.pair_id AND ev.pos = fw.pos + 1),
tot AS (SELECT pair_id, pos AS last, {LSE.format('s0', 's1')} AS ll FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pos DESC) AS r FROM fw) WHERE r = 1),
bw AS (SELECT pair_id, last AS pos, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM tot
  UNION ALL SELECT bw.pair_id, bw.pos - 1, {LSE.format('ln(0.9) + e0 + b0', 'ln(0.1) + e1 + b1')}, {LSE.format('ln(0.2) + e0 + b0', 'ln(0.8) + e1 + b1')} FROM bw JOIN ev ON ev.pair_id = bw.pair_id AND ev.pos = bw.pos WHERE bw.pos > 0)"""


def _decoded(spark, d):
    return markov.decoded(_paths(spark, d), "pair_id", *HMM)


@query(f"WITH {EV}, {FORWARD} SELECT pair_id, pos, round(exp(s0 + b0 - ll), 9) AS p0, round(exp(s1 + b1 - ll), 9) AS p1 FROM fw JOIN bw USING (pair_id, pos) JOIN tot USING (pair_id)")
def state_posteriors(spark, d):
    """Forward-backward posteriors of the two-state model at every column."""
    each = _decoded(spark, d).select("pair_id", F.posexplode("posteriors").alias("pos", "p"))
    return each.select("pair_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("p")[0], 9).alias("p0"), F.round(F.col("p")[1], 9).alias("p1"))


XI = " UNION ALL ".join(f"SELECT fw.pair_id, {i} AS src, {j} AS dst, exp(s{i} + ln({HMM[1][i][j]}) + e{j} + b{j} - ll) AS p FROM fw JOIN ev ON ev.pair_id = fw.pair_id AND ev.pos = fw.pos + 1 JOIN bw ON bw.pair_id = fw.pair_id AND bw.pos = fw.pos + 1 JOIN tot ON tot.pair_id = fw.pair_id" for i in (0, 1) for j in (0, 1))


@query(f"WITH {EV}, {FORWARD} SELECT src, dst, round(sum(p), 3) AS n FROM ({XI}) GROUP BY 1, 2")
def expected_state_transitions(spark, d):
    """Expected transitions of the two-state model over all columns."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((k / 2).cast("int").alias("src"), (k % 2).cast("int").alias("dst"), F.element_at("expected", k + 1).alias("n")))
    return _decoded(spark, d).select(F.explode(cells).alias("c")).groupBy("c.src", "c.dst").agg(F.round(F.sum("c.n"), 3).alias("n"))


@query(f"WITH {EV}, {FORWARD} SELECT state, st - 1 AS x, round(sum(p), 3) AS n FROM (SELECT pair_id, pos, 0 AS state, exp(s0 + b0 - ll) AS p FROM fw JOIN bw USING (pair_id, pos) JOIN tot USING (pair_id) UNION ALL SELECT pair_id, pos, 1, exp(s1 + b1 - ll) FROM fw JOIN bw USING (pair_id, pos) JOIN tot USING (pair_id)) JOIN columns USING (pair_id, pos) GROUP BY 1, 2")
def observation_counts(spark, d):
    """Symbols counted by the posterior of the state that emits them."""
    return markov.observation_counts(_paths(spark, d), _decoded(spark, d), "pair_id").select("state", "x", F.round("n", 3).alias("n"))


@query(f"""WITH {EV}, v AS (SELECT pair_id, pos, ln(0.6) + e0 AS s0, ln(0.4) + e1 AS s1, '0' AS p0, '1' AS p1 FROM ev WHERE pos = 0
  UNION ALL SELECT ev.pair_id, ev.pos, e0 + greatest(s0 + ln(0.9), s1 + ln(0.2)), e1 + greatest(s0 + ln(0.1), s1 + ln(0.8)), CASE WHEN s0 + ln(0.9) >= s1 + ln(0.2) THEN p0 ELSE p1 END || '0', CASE WHEN s0 + ln(0.1) >= s1 + ln(0.8) THEN p0 ELSE p1 END || '1' FROM v JOIN ev ON ev.pair_id = v.pair_id AND ev.pos = v.pos + 1)
SELECT pair_id, CASE WHEN s0 >= s1 THEN p0 ELSE p1 END AS path FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pos DESC) AS r FROM v) WHERE r = 1""")
def likeliest_state_paths(spark, d):
    return _decoded(spark, d).select("pair_id", F.array_join(F.transform("path", lambda s: s.cast("string")), "").alias("path"))


SINGLET = ([0.5, 0.3], [[0.5, 0.3], [0.2, 0.6]], [0.2, 0.2], [[(1 + c % 3) / 39 for c in range(20)], [(1 + c % 4) / 50 for c in range(20)]])
SEV = "x AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS k, ln((1 + a % 3) / 39) AS e0, ln((1 + a % 4) / 50) AS e1 FROM columns WHERE st <> 2)"


@query(f"""WITH {SEV}, f AS (SELECT pair_id, k, ln(0.5) + e0 AS s0, ln(0.3) + e1 AS s1 FROM x WHERE k = 1 UNION ALL SELECT x.pair_id, x.k, e0 + {LSE.format('s0 + ln(0.5)', 's1 + ln(0.2)')}, e1 + {LSE.format('s0 + ln(0.3)', 's1 + ln(0.6)')} FROM f JOIN x ON x.pair_id = f.pair_id AND x.k = f.k + 1),
l AS (SELECT pair_id, {LSE.format('s0 + ln(0.2)', 's1 + ln(0.2)')} AS ll FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY k DESC) AS r FROM f) WHERE r = 1)
SELECT pair_id, round(coalesce(ll, ln(1 - 0.8)), 7) AS loglik FROM (SELECT DISTINCT pair_id FROM columns) LEFT JOIN l USING (pair_id)""")
def singlet_logliks(spark, d):
    """Each first row's log-probability under a two-state model that ends; an empty row is a start without a state."""
    rows = pairwise.ungapped(T.columns(spark, d)).select("pair_id", F.col("x").alias("xs"))
    return markov.singlet_loglik(rows, *SINGLET).select("pair_id", F.round("loglik", 7).alias("loglik"))


def _pair_model():
    return pairwise.model_arrays(*RATES[:2], 1.0, RATES[2], 20)


@query()
def pair_expected_transitions(spark, d):
    """Expected transitions of the pair model over all alignments of all pairs; those into the end number the pairs (tested)."""
    rows = pairwise.expected_transitions(pairwise.ungapped(T.columns(spark, d)), *_pair_model())
    return rows.groupBy("src", "dst").agg(F.sum("n").alias("n"))


@query()
def likeliest_alignments(spark, d):
    return pairwise.likeliest_alignments(pairwise.ungapped(T.columns(spark, d)), *_pair_model())


@query(pair_sql(best=True))
def likeliest_alignment_scores(spark, d):
    rows = pairwise.likeliest_alignments(pairwise.ungapped(T.columns(spark, d)), *_pair_model())
    return rows.select("pair_id", F.round("score", 6).alias("score"))


@query("""WITH xs AS (SELECT pair_id, coalesce(list(a ORDER BY pos) FILTER (st <> 2), []) AS x, coalesce(list(b ORDER BY pos) FILTER (st <> 3), []) AS y FROM columns GROUP BY 1),
dp AS (SELECT pair_id, 0 AS d, 0 AS i, 0.0::DOUBLE AS f, NULL::DOUBLE AS g FROM xs
  UNION ALL SELECT pair_id, d + 1, i + w, max(greatest(f - 2, CASE WHEN w = 1 AND d > i THEN g + CASE WHEN x[i + 1] = y[d - i] THEN 1 ELSE -1 END END)), max(CASE WHEN w = 0 THEN f END)
  FROM dp JOIN xs USING (pair_id), (SELECT unnest([0, 1]) AS w) WHERE CASE WHEN w = 0 THEN d - i < len(y) ELSE i < len(x) END GROUP BY pair_id, d + 1, i + w)
SELECT pair_id, f AS score FROM dp JOIN xs USING (pair_id) WHERE d = len(x) + len(y) AND i = len(x)""")
def global_alignment_scores(spark, d):
    """The scores of ``global_alignments``."""
    from .registry import global_alignments

    return global_alignments(spark, d).select("pair_id", "score")


@query()
def sampled_alignments(spark, d):
    return pairwise.sampled_alignments(pairwise.ungapped(T.columns(spark, d)), *_pair_model(), seed=17)


@query(pair_sql(best=False, band=3))
def banded_pair_logliks(spark, d):
    """Each pair's log-probability over the alignments near its given one."""
    columns = T.columns(spark, d)
    centres = guards.band_centres(columns).groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "centre"))), lambda s: s["centre"]).alias("centres"))
    rows = pairwise.ungapped(columns).join(centres, "pair_id", "left").withColumn("centres", F.coalesce("centres", F.array().cast("array<bigint>")))
    return pairwise.pair_likelihoods(rows, *_pair_model(), band=3).withColumn("loglik", F.round("loglik", 6))


AT_ONE = f"r AS (SELECT 0 AS id, {RATES[0]} AS l, {RATES[1]} AS m, 1.0 AS t), {_bd(str(RATES[2]))}"
TALLY = """mk AS (SELECT pair_id, st, sum(CAST(st = 1 AS INT)) OVER (PARTITION BY pair_id ORDER BY pos) AS seen, sum(CAST(st = 1 AS INT)) OVER (PARTITION BY pair_id) AS total FROM columns),
sg AS (SELECT pair_id, seen, total, sum(CAST(st = 3 AS INT)) AS i, sum(CAST(st = 2 AS INT)) AS j FROM mk GROUP BY ALL UNION ALL SELECT DISTINCT pair_id, 0, total, 0, 0 FROM mk WHERE total > 0 AND pair_id NOT IN (SELECT pair_id FROM mk WHERE seen = 0)),
ta AS (SELECT CASE WHEN total = 0 THEN 'SE' WHEN seen = 0 THEN 'SM' WHEN seen = total THEN 'ME' ELSE 'MM' END AS kind, least(i, 3) AS i, least(j, 3) AS j, count(*) AS n FROM sg GROUP BY ALL)"""


@query(f"""WITH {TALLY}, {AT_ONE}, walk AS (SELECT src AS x, dst AS last, CAST(dst = 'D' AS INT) AS i, CAST(dst = 'I' AS INT) AS j, p FROM model WHERE src IN ('S', 'M') AND dst IN ('I', 'D')
  UNION ALL SELECT x, dst, i + CAST(dst = 'D' AS INT), j + CAST(dst = 'I' AS INT), sum(walk.p * model.p) FROM walk JOIN model ON src = last AND dst IN ('I', 'D') WHERE i + j < 200 GROUP BY x, dst, i + CAST(dst = 'D' AS INT), j + CAST(dst = 'I' AS INT)),
g AS (SELECT x || dst AS kind, least(i, 3) AS i, least(j, 3) AS j, sum(w.p) AS p FROM (SELECT x, i, j, dst, walk.p * model.p AS p FROM walk JOIN model ON src = last AND dst IN ('M', 'E') UNION ALL SELECT src, 0, 0, dst, p FROM model WHERE src IN ('S', 'M') AND dst IN ('M', 'E')) w GROUP BY 1, 2, 3)
SELECT kind, CAST(sum(n) AS BIGINT) AS n, round(sum(n * ln(p)), 4) AS loglik FROM ta JOIN g USING (kind, i, j) GROUP BY kind""")
def gap_logliks(spark, d):
    """Log-likelihood of the tallied gaps under the fragment model's gap-length probabilities at time 1."""
    trans = pairwise.model_arrays(*RATES[:2], 1.0, RATES[2], 20)[0]
    return gaps.loglik(gap_tally(spark, d), gaps.table(spark, trans, 3)).withColumn("loglik", F.round("loglik", 4))


DERIVED = """WITH r AS (SELECT c_custkey AS id, 0.02 + (c_custkey % 7) / 100.0 AS l, 0.03 + (c_custkey % 9) / 100.0 AS m, 0.1 + (c_custkey % 50) / 10.0 AS t FROM customer),
g AS (SELECT *, abs(1 - l / m) < 1e-4 AS near, exp(-m * t) AS a, exp((l - m) * t) AS g FROM r)
SELECT id, round(-t, 8) AS alpha_mu, round(t * a / (1 - a), 6) AS rest_mu,
  round(CASE WHEN near THEN 1 / l + t / 2 - (t + l * t * t / 2) / (1 + l * t) ELSE 1 / l - t * g / nullif(1 - g, 0) + (g + l * t * g) / nullif(m - l * g, 0) END, 5) AS beta_lam,
  round(CASE WHEN near THEN -t / 2 + (l * t * t / 2) / (1 + l * t) ELSE t * g / nullif(1 - g, 0) - (1 + l * t * g) / nullif(m - l * g, 0) END, 5) AS beta_mu, round(1 / l, 6) AS kappa_lam FROM g"""


@query(DERIVED, cte=False)
def score_derivatives(spark, d):
    """How the logs of the link model's parameters change with its rates."""
    made = X.score_derivatives(F.col("l"), F.col("m"), F.col("t"))
    cols = {"alpha_mu": (made["alpha"][1], 8), "rest_mu": (made["1-alpha"][1], 6), "beta_lam": (made["beta"][0], 5), "beta_mu": (made["beta"][1], 5), "kappa_lam": (made["kappa"][0], 6)}
    return _rates(spark, d).select("id", *(F.round(c, k).alias(name) for name, (c, k) in cols.items()))


@query("""WITH w AS (SELECT k, x.v AS a, y.v AS b, [0.5, 0.3, 0.2][k + 1] * ((1 - exp(-[0.2, 1.0, 3.0][k + 1])) / 20 + CASE WHEN x.v = y.v THEN exp(-[0.2, 1.0, 3.0][k + 1]) ELSE 0 END) AS w FROM (SELECT unnest([0, 1, 2]) AS k), range(20) x(v), range(20) y(v)),
p AS (SELECT k, a, b, w / sum(w) OVER (PARTITION BY a, b) AS p FROM w), n AS (SELECT a, b, count(*) AS n FROM columns WHERE st = 1 GROUP BY 1, 2) SELECT k, round(sum(n * p), 5) AS n FROM n JOIN p USING (a, b) GROUP BY k""")
def class_responsibilities(spark, d):
    """Matches by the posterior of three substitution classes, which differ in their rates."""
    table = substitution.class_table(spark, [0.5, 0.3, 0.2], [0.2, 1.0, 3.0], 20)
    n = T.columns(spark, d).where(F.col("st") == counts.MATCH).groupBy("a", "b").agg(F.count("*").alias("n"))
    joined = n.join(F.broadcast(substitution.class_responsibilities(table)), ["a", "b"])  # 1,200 rows
    return joined.groupBy("k").agg(F.round(F.sum(F.col("n") * F.col("p")), 5).alias("n"))


@query(f"WITH {BINNED}, n AS (SELECT a, b, count(*) AS n, sum(tau) AS t FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY 1, 2), dw AS (SELECT a, sum(t) AS dwell FROM n GROUP BY a) SELECT a, b, round(n / dwell, 8) AS rate FROM n JOIN dw USING (a) WHERE a <> b")
def substitution_rates(spark, d):
    """Substitution rates as changes over the time spent in each residue."""
    rows = T.columns(spark, d).where(F.col("st") == counts.MATCH).join(_binned(spark, d).select("pair_id", "tau"), "pair_id")
    n = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("tau").alias("t"))
    return substitution.rates_from_changes(n).withColumn("rate", F.round("rate", 8))


@query(f"WITH {BINNED}, n AS (SELECT a, b, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY 1, 2), s AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM n UNION ALL SELECT b, a, n FROM n) GROUP BY a, b), pi AS (SELECT a, sum(n) / (SELECT sum(n) FROM s) AS pi FROM s GROUP BY a) SELECT s.a, s.b, round(s.n / (p.pi * q.pi * (SELECT sum(n) FROM s)), 7) AS exchange FROM s JOIN pi p ON p.a = s.a JOIN pi q ON q.a = s.b WHERE s.a < s.b")
def exchangeabilities(spark, d):
    """Symmetric changes over what the residues' frequencies alone would give."""
    n = T.columns(spark, d).where(F.col("st") == counts.MATCH).groupBy("a", "b").agg(F.count("*").alias("n"))
    return substitution.exchangeabilities(n).withColumn("exchange", F.round("exchange", 7))


def _cherry_sql() -> str:
    """Strict cherries of the four-level tree, level by level."""
    kids = lambda p: f"SELECT parent, count(*) AS k FROM edges WHERE node LIKE '{p}%' GROUP BY 1"
    parts, leaves = ["lo AS (SELECT node, length, parent, true AS own FROM edges WHERE node LIKE 'o%')"], "lo"
    for level, below in (("c", "lo"), ("n", "lc"), ("r", "ln"), ("root", "lr")):
        name = below[1]
        parts.append(f"k{name} AS ({kids(name)}), q{name} AS (SELECT parent, min(node) AS a, max(node) AS b, sum(length) AS tau, bool_and(own) AS of_leaves FROM {below} JOIN k{name} USING (parent) WHERE k = 2 GROUP BY parent HAVING count(*) = 2)")
        if level != "root":
            parts.append(f"l{level} AS (SELECT node, length, parent, node NOT IN (SELECT parent FROM edges) AS own FROM edges WHERE node LIKE '{level}%' AND (node NOT IN (SELECT parent FROM edges) OR node IN (SELECT parent FROM q{name})))")
    return "WITH " + ", ".join(parts) + " SELECT parent, a, b, round(tau, 7) AS tau, of_leaves FROM (" + " UNION ALL ".join(f"SELECT * FROM q{x}" for x in "ocnr") + ")"


@query(_cherry_sql())
def strict_cherries(spark, d):
    """Cherries of the region tree's two-leaf parents, which are leaves from then on."""
    return cherries.strict_cherries(T.edges(spark, d)).withColumn("tau", F.round("tau", 7))


@query("WITH o AS (SELECT o_custkey AS tree, 'o' || o_orderkey AS node, o_totalprice / 100000.0 AS length FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY length, node) - 1 AS r FROM o) SELECT tree, min(node) AS a, max(node) AS b, round(sum(length), 7) AS tau FROM k GROUP BY tree, r // 2 HAVING count(*) = 2")
def sibling_cherries(spark, d):
    """Each customer's orders paired from the shortest branches up."""
    edges = T.pairs(spark, d).select(F.col("fam").alias("tree"), F.concat(F.lit("o"), "pair_id").alias("node"), F.concat(F.lit("c"), "fam").alias("parent"), F.col("tau").alias("length"))
    return cherries.sibling_cherries(edges).withColumn("tau", F.round("tau", 7))


@query("""WITH kept AS (SELECT * FROM edges WHERE NOT (node LIKE 'o%' AND length > 4)), kc AS (SELECT parent AS node, count(*) AS n, min(node) AS one, min(length) AS len FROM kept WHERE node LIKE 'o%' GROUP BY 1),
c AS (SELECT CASE WHEN n = 1 THEN one ELSE e.node END AS node, parent, length + CASE WHEN n = 1 THEN len ELSE 0 END AS length FROM edges e LEFT JOIN kc ON kc.node = e.node WHERE e.node LIKE 'c%' AND (n IS NOT NULL OR e.node NOT IN (SELECT parent FROM edges)))
SELECT node, parent, round(length, 7) AS length FROM (SELECT node, parent, length FROM kept WHERE node LIKE 'o%' AND parent IN (SELECT node FROM kc WHERE n > 1) UNION ALL SELECT * FROM c UNION ALL SELECT node, parent, length FROM edges WHERE node NOT LIKE 'o%' AND node NOT LIKE 'c%')""")
def pruned_tree(spark, d):
    """The region tree without the orders on long branches: what has lost all its leaves goes, and a node with one child gives way to it."""
    edges = T.edges(spark, d)
    gone = edges.where("substr(node, 1, 1) = 'o' AND length > 4").select("node")
    return trees.pruned(edges, gone).select("node", "parent", F.round("length", 7).alias("length"))


@query("WITH u AS (SELECT node, parent, length FROM edges WHERE node = 'n3' UNION ALL SELECT e.node, e.parent, e.length FROM u JOIN edges e ON e.node = u.parent) SELECT parent AS node, node AS parent, round(length, 7) AS length FROM u UNION ALL SELECT node, parent, round(length, 7) FROM edges WHERE node NOT IN (SELECT node FROM u)")
def rerooted_tree(spark, d):
    """The region tree hung from its fourth nation: the branches above it are turned round."""
    return trees.rerooted(T.edges(spark, d), "n3").withColumn("length", F.round("length", 7))


@query("WITH h AS (SELECT node, 0 AS height FROM edges WHERE node NOT IN (SELECT parent FROM edges) UNION ALL SELECT e.parent, height + 1 FROM h JOIN edges e ON e.node = h.node) SELECT node, max(height) AS height FROM h GROUP BY node")
def tree_heights(spark, d):
    """Each node's height over its farthest leaf: the order in which a tree is folded from its leaves."""
    return trees.heights(T.edges(spark, d))


@query("WITH e AS (SELECT parent, node, length FROM edges WHERE node LIKE 'o%'), s AS (SELECT 'o' || o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, ascii(substr(c_mktsegment, 1, 1)) % 3 AS x FROM orders JOIN customer ON c_custkey = o_custkey) SELECT parent, round(sum(ln(CASE WHEN x = y THEN (1 - exp(-length * 1.5)) / 3 + exp(-length * 1.5) ELSE (1 - exp(-length * 1.5)) / 3 END)), 6) AS loglik FROM e JOIN s USING (node) GROUP BY parent")
def edge_logliks(spark, d):
    """Log-likelihood of given states at both ends of the branches below each customer: the sum of its branches'."""
    orders, customer = T.read(spark, d, "orders"), T.read(spark, d, "customer")
    status = F.col("o_orderstatus")
    lower = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("state"))
    upper = customer.select(F.concat(F.lit("c"), "c_custkey").alias("node"), (F.ascii("c_mktsegment") % 3).alias("state"))
    out = substitution.edge_logliks(T.edges(spark, d), lower.unionAll(upper), 3)
    return out.withColumn("loglik", F.round("loglik", 6))


@query(f"WITH {BINNED}, n AS (SELECT fam % 40 AS fam, tau_bin, substr('SMIDE', src + 1, 1) AS src, substr('SMIDE', dst + 1, 1) AS dst, count(*) AS n FROM (SELECT pair_id, lag(st, 1, 0) OVER w AS src, st AS dst FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)) JOIN binned USING (pair_id) GROUP BY ALL), {MODEL}, l AS (SELECT fam, sum(n * ln(p)) AS one FROM n JOIN model ON id = tau_bin AND model.src = n.src AND model.dst = n.dst GROUP BY fam) SELECT fam, round(one, 5) AS loglik FROM l")
def steps_loglik(spark, d):
    """Log-likelihood of the steps between columns, ends left out, under the literal model."""
    steps = counts.transitions(T.columns(spark, d)).where(F.col("dst") != counts.END)
    keyed = steps.join(_binned(spark, d).select("pair_id", (F.col("fam") % 40).alias("fam"), "tau_bin"), "pair_id")
    n = keyed.groupBy("fam", "tau_bin", "src", "dst").agg(F.count("*").alias("n"))
    return counts.contracted(n, F.broadcast(_log_model(spark)), ["tau_bin", "src", "dst"], ["fam"]).withColumn("loglik", F.round("loglik", 5))  # 128 rows


RATES_SQL = "r AS (SELECT c_custkey AS id, 0.02 + (c_custkey % 7) / 100.0 AS l, 0.03 + (c_custkey % 9) / 100.0 AS m, 0.1 + (c_custkey % 50) / 10.0 AS t FROM customer)"
KINDS = ([0.4, 0.7], [0.6, 0.4])
FT = ", ".join(f"({f}, {e}, {w})" for f, (e, w) in enumerate(zip(*KINDS, strict=True)))


def _cells(spark, d, made):
    cells = F.array(*(F.struct(F.lit(s).alias("src"), F.lit(t).alias("dst"), F.round(p, 9).alias("p")) for (s, t), p in made.items()))
    return T.dealt(_rates(spark, d), "id", 1 << 14).select("id", F.explode(cells).alias("x")).select("id", "x.*")


@query(f"""WITH {RATES_SQL}, {_bd(None)}, ft AS (SELECT * FROM (VALUES {FT}) AS v(f, ext, w)),
s AS (SELECT id, src AS s, dst AS d, p, a.f AS f, coalesce(a.ext, 0) AS ext FROM model LEFT JOIN ft a ON src <> 'S')
SELECT id, s || coalesce(CAST(f AS VARCHAR), '') AS src, d || coalesce(CAST(g AS VARCHAR), '') AS dst, round((1 - ext) * coalesce(w, 1) * p + CASE WHEN s = d AND f = g THEN ext ELSE 0 END, 9) AS p FROM s LEFT JOIN (SELECT f AS g, w FROM ft) ON d <> 'E'""", cte=False)
def mixed_fragment_matrix(spark, d):
    """Transitions of the link model with two kinds of fragments at every customer's rates."""
    return _cells(spark, d, X.mixed_fragment_transitions(F.col("l"), F.col("m"), F.col("t"), *KINDS))


@query(f"""WITH {RATES_SQL}, ft AS (SELECT * FROM (VALUES {FT}) AS v(f, ext, w)), s AS (SELECT id, l / m AS k, NULL AS f, 0 AS ext FROM r UNION ALL SELECT id, l / m, f, ext FROM r, ft)
SELECT id, CASE WHEN f IS NULL THEN 'S' ELSE 'I' || f END AS src, 'I' || g AS dst, round((1 - ext) * k * w + CASE WHEN f = g THEN ext ELSE 0 END, 9) AS p FROM s, (SELECT f AS g, w FROM ft)
UNION ALL SELECT id, CASE WHEN f IS NULL THEN 'S' ELSE 'I' || f END, 'E', round((1 - ext) * (1 - k), 9) FROM s""", cte=False)
def mixed_fragment_lengths(spark, d):
    return _cells(spark, d, X.mixed_fragment_lengths(F.col("l"), F.col("m"), *KINDS))


def _family_groups(spark, d):
    """fam, tau, n_alpha ...: each family's transitions by time bin, at the bins' centres."""
    n = counts.transition_counts(T.columns(spark, d), _binned(spark, d).select("pair_id", "fam", "tau_bin"), ["fam", "tau_bin"])
    centres = spark.createDataFrame([(k, (a * b) ** 0.5) for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))], "tau_bin int, tau double")
    return counts.log_groups(n, ["fam", "tau_bin"]).join(F.broadcast(centres), "tau_bin").drop("tau_bin")  # 8 rows


@query()
def link_mixture_em(spark, d):
    """Two components of link rates over the families; the likelihood never falls (tested)."""
    parts, _ = mixture.link_mixture_em(stored(_family_groups(spark, d), "groups"), 2, iterations=12)
    return spark.createDataFrame([(k, float(p["weight"]), float(p["lam"]), float(p["mu"])) for k, p in enumerate(parts)], "k int, weight double, lam double, mu double")


@query()
def stream_link_rates(spark, d):
    """Link rates fitted to a stream of families' transitions, a file of them at a time, with stored state."""
    folder = scratch(spark, "link-rates")
    groups = _family_groups(spark, d)
    groups.repartition(6, "fam").write.parquet(f"{folder}/rows")
    rows = spark.readStream.schema(groups.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")
    return jobs.link_rates(rows, groups.count(), folder).select("batch", "lam", "mu")


@query()
def family_alignments(spark, d):
    """Every family's first rows aligned from scratch: pair posteriors, then merged columns."""
    rows = pairwise.ungapped(T.columns(spark, d)).join(T.pairs(spark, d).select("pair_id", "fam"), "pair_id")
    return decoding.aligned_families(rows.select("fam", F.col("pair_id").alias("name"), F.col("x").alias("seq")), *_pair_model())


@query(f"WITH {EV}, {FORWARD} SELECT pair_id, pos, round(exp(s0 + b0 - ll), 9) AS p0, round(exp(s1 + b1 - ll), 9) AS p1, round(ll, 7) AS loglik FROM fw JOIN bw USING (pair_id, pos) JOIN tot USING (pair_id)")
def blocked_state_posteriors(spark, d):
    """The posteriors of ``state_posteriors`` by scans over blocks of columns, which a sequence may span; tests go down to blocks of 5."""
    rows = T.columns(spark, d).select("pair_id", "pos", (F.col("st") - 1).alias("x"))
    found = scans.state_posteriors(rows, "pair_id", "pos", "x", *HMM, block=4096)
    return found.select("pair_id", "pos", F.round(F.col("posteriors")[0], 9).alias("p0"), F.round(F.col("posteriors")[1], 9).alias("p1"), F.round("loglik", 7).alias("loglik"))
