"""Registered queries of the library's operators over the star-schema tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import counts, decoding, markov, metrics, mixture, pairwise, paths, phylogeny, relations, simulate, substitution, trees
from ..sources import tables as T
from ..streaming import jobs

EDGES = X.geometric_edges(0.01, 10.0, 8)
RATES = (0.03, 0.05, 0.4)  # insertion, deletion, extension of the literal models below
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "family_loglik"


def query(sql: str | None = None, cte: bool = True):
    """Registers a query under its function's name, with SQL that sees the views of ``sources.tables``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {T.CTE.strip()}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}") if cte else body
        return f

    return add


def _case(column: str, op: str) -> str:
    return "(" + " + ".join(f"CAST({column} {op} {e!r} AS INT)" for e in EDGES[1:-1]) + ")"


def _binned(spark, d):
    return T.pairs(spark, d).withColumn("tau_bin", X.bin_left_open(F.col("tau"), EDGES))


BINNED = f"binned AS (SELECT pair_id, fam, tau, {_case('tau', '>')} AS tau_bin FROM pairs)"
STEPS = """steps AS (SELECT pair_id, lag(st, 1, 0) OVER w AS src, st AS dst FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)
  UNION ALL SELECT pair_id, st, 4 FROM (SELECT pair_id, st, row_number() OVER (PARTITION BY pair_id ORDER BY pos DESC) AS r FROM columns) WHERE r = 1)"""


@query(f"WITH {BINNED}, {STEPS} SELECT tau_bin, src, dst, count(*) AS n FROM steps JOIN binned USING (pair_id) GROUP BY ALL")
def transition_counts_by_bin(spark, d):
    return counts.transition_counts(T.columns(spark, d), _binned(spark, d).select("pair_id", "tau_bin"), ["tau_bin"])


@query(f"WITH {BINNED} SELECT tau_bin, a, b, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY ALL")
def match_counts(spark, d):
    return counts.match_counts(T.columns(spark, d), _binned(spark, d).select("pair_id", "tau_bin"), ["tau_bin"])


@query(f"WITH {BINNED} SELECT tau_bin, CASE st WHEN 2 THEN b ELSE a END AS c, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st <> 1 GROUP BY ALL")
def singlet_counts(spark, d):
    return counts.singlet_counts(T.columns(spark, d), _binned(spark, d).select("pair_id", "tau_bin"), ["tau_bin"])


ADJ = """SELECT key, a1, b1, a2, b2, count(*) AS n FROM (
  SELECT substr('SMIDE', coalesce(ps, 0) + 1, 1) || substr('SMIDE', st + 1, 1) AS key, pa AS a1, pb AS b1, ea AS a2, eb AS b2 FROM (
    SELECT *, lag(st) OVER w AS ps, lag(ea) OVER w AS pa, lag(eb) OVER w AS pb FROM e WINDOW w AS (PARTITION BY pair_id, flip ORDER BY pos))
  UNION ALL SELECT substr('SMIDE', st + 1, 1) || 'E', ea, eb, NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, flip ORDER BY pos DESC) AS r FROM e) WHERE r = 1)
GROUP BY ALL"""
EMIT = "e AS (SELECT pair_id, flip, pos, st, CASE WHEN st <> 2 THEN a END AS ea, CASE WHEN st <> 3 THEN b END AS eb FROM c)"


@query(f"WITH c AS (SELECT *, 0 AS flip FROM columns), {EMIT} {ADJ}")
def adjacency_counts(spark, d):
    return counts.adjacency_counts(T.columns(spark, d))


@query(f"WITH c AS (SELECT *, 0 AS flip FROM columns UNION ALL SELECT pair_id, pos, CASE st WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE st END, b, a, 1 FROM columns), {EMIT} {ADJ}")
def adjacency_counts_symmetric(spark, d):
    return counts.adjacency_counts(T.columns(spark, d), symmetric=True)


@query("""WITH m AS (SELECT pair_id, st, sum(CAST(st = 1 AS INT)) OVER (PARTITION BY pair_id ORDER BY pos) AS seen, sum(CAST(st = 1 AS INT)) OVER (PARTITION BY pair_id) AS total FROM columns),
seg AS (SELECT pair_id, seen, total, sum(CAST(st = 3 AS INT)) AS i, sum(CAST(st = 2 AS INT)) AS j FROM m GROUP BY ALL
  UNION ALL SELECT DISTINCT pair_id, 0, total, 0, 0 FROM m WHERE total > 0 AND pair_id NOT IN (SELECT pair_id FROM m WHERE seen = 0))
SELECT CASE WHEN total = 0 THEN 'SE' WHEN seen = 0 THEN 'SM' WHEN seen = total THEN 'ME' ELSE 'MM' END AS kind, CAST(least(i, 3) AS INT) AS i, CAST(least(j, 3) AS INT) AS j, count(*) AS n FROM seg GROUP BY ALL""")
def gap_tally(spark, d):
    return counts.gap_tally(T.columns(spark, d), 3)


@query("""WITH s AS (SELECT seq_id, pos, c, lag(c, 1, 20) OVER w AS c1, lead(c) OVER w AS nxt FROM symbols WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
SELECT c1, c2, count(*) AS n FROM (SELECT c1, c AS c2 FROM s UNION ALL SELECT c, 21 FROM s WHERE nxt IS NULL) GROUP BY ALL""")
def symbol_bigrams(spark, d):
    return counts.bigrams(T.read(spark, d, "documents").select(F.lower("text").alias("s")), 20)


@query("SELECT seq_id, c, round(count(*) / sum(count(*)) OVER (PARTITION BY seq_id), 9) AS share FROM symbols GROUP BY seq_id, c")
def composition_vectors(spark, d):
    return counts.composition(T.symbols(spark, d)).withColumn("share", F.round("share", 9))


@query("""WITH r AS (SELECT l_partkey % 10 AS fam, pos AS col, CASE WHEN st <> 2 THEN a END AS res FROM columns JOIN (SELECT l_orderkey AS pair_id, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) USING (pair_id)),
n AS (SELECT fam, col, res, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT fam, col, coalesce(sum(n) FILTER (res IS NOT NULL), 0) AS k, sum(n) AS al, sum(n * log2(n)) FILTER (res IS NOT NULL) AS nl FROM n GROUP BY ALL)
SELECT fam, round(avg(CASE WHEN k > 0 THEN log2(k) - nl / k ELSE 0 END), 6) AS entropy, round(avg(1 - k / al), 6) AS gap_share, round(avg(CAST(k = 0 AS DOUBLE)), 6) AS all_gap_share FROM c GROUP BY fam""")
def column_entropy_gap(spark, d):
    fam = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.min("l_partkey").alias("k")).select("pair_id", (F.col("k") % 10).alias("fam"))
    rows = T.columns(spark, d).join(fam, "pair_id").select("fam", F.col("pos").alias("col"), F.when(F.col("st") != counts.INSERT, F.col("a")).alias("res"))
    return counts.column_entropy(rows).select("fam", *(F.round(c, 6).alias(c) for c in ("entropy", "gap_share", "all_gap_share")))


@query("""WITH i AS (SELECT pair_id, pos, st, pos - row_number() OVER (PARTITION BY pair_id, st ORDER BY pos) AS isl FROM columns),
r AS (SELECT pair_id, st, isl, min(pos) AS start, count(*) AS n FROM i GROUP BY ALL)
SELECT pair_id, string_agg(substr('MID', st, 1) || n, '' ORDER BY start) AS rle FROM r GROUP BY pair_id""")
def rle_paths(spark, d):
    return paths.run_lengths(T.columns(spark, d))


@query("SELECT pair_id, pos, st FROM columns")
def rle_roundtrip(spark, d):
    states = paths.run_lengths(T.columns(spark, d)).select("pair_id", F.posexplode(paths.run_states(F.col("rle"))))
    return states.select("pair_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("st"))


@query("SELECT pair_id, pos, st, CAST(sum(CAST(st <> 2 AS INT)) OVER w - 1 AS BIGINT) AS i, CAST(sum(CAST(st <> 3 AS INT)) OVER w - 1 AS BIGINT) AS j FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)")
def residue_positions(spark, d):
    return paths.residue_positions(T.columns(spark, d)).select("pair_id", "pos", "st", "i", "j")


PD = "p AS (SELECT pair_id, count(*) AS sites, avg(CAST(a <> b AS DOUBLE)) AS p FROM columns WHERE st = 1 GROUP BY pair_id UNION ALL SELECT DISTINCT pair_id, 0, 1.0 FROM columns WHERE pair_id NOT IN (SELECT pair_id FROM columns WHERE st = 1))"


@query(f"""WITH {PD} SELECT pair_id, sites, round(p, 9) AS p, round(CASE WHEN p >= 0.95 OR 1 - p * (20 / 19) <= 0.01 THEN 5.0 ELSE -ln(1 - p * (20 / 19)) END, 9) AS poisson,
round(CASE WHEN sites < 5 THEN 'inf'::DOUBLE WHEN 1 - p - 0.2 * p * p <= 0 THEN 5.0 ELSE -ln(1 - p - 0.2 * p * p) END, 9) AS kimura, round(CASE WHEN 1 - p * (4 / 3) <= 0 THEN 5.0 ELSE -0.75 * ln(1 - p * (4 / 3)) END, 9) AS jc69 FROM p""")
def pair_distances(spark, d):
    match = F.col("st") == counts.MATCH
    p = T.columns(spark, d).groupBy("pair_id").agg(F.sum(match.cast("long")).alias("sites"), F.avg(F.when(match, (F.col("a") != F.col("b")).cast("double"))).alias("p"))
    p = p.withColumn("p", F.when(F.col("sites") == 0, 1.0).otherwise(F.col("p")))  # null where there are matches, but all of unknown residues
    nine = lambda d: F.when(d == 0, d).otherwise(F.round(d, 9))  # a zero keeps its sign, which Spark's rounding drops
    return p.select("pair_id", "sites", F.round("p", 9).alias("p"), nine(X.poisson_time(F.col("p"))).alias("poisson"), F.when(F.col("sites") < 5, float("inf")).otherwise(nine(X.kimura_distance(F.col("p"), F.lit(5)))).alias("kimura"), nine(X.jc69_time(F.col("p"))).alias("jc69"))


@query(f"SELECT event_id, {_case('value / 100', '>')} AS left_bin, {_case('value / 100', '>=')} AS right_bin FROM events", cte=False)
def value_bins(spark, d):
    v = F.col("value") / 100
    return T.read(spark, d, "events").select("event_id", X.bin_left_open(v, EDGES).alias("left_bin"), X.bin_right_open(v, EDGES).alias("right_bin"))


@query("SELECT o1.o_custkey AS fam, o1.o_orderkey AS pair_id_a, o2.o_orderkey AS pair_id_b FROM orders o1 JOIN orders o2 ON o1.o_custkey = o2.o_custkey AND o1.o_orderkey < o2.o_orderkey", cte=False)
def all_pairs_within_family(spark, d):
    return relations.all_pairs(T.pairs(spark, d), "fam", "pair_id")


@query("SELECT substr(sha256(coalesce(text, '')), 1, 16) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1", cte=False)
def dedupe_by_hash(spark, d):
    return relations.without_copies(T.read(spark, d, "documents"), "text", "doc_id")


@query("""SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents WHERE substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM documents WHERE source = 'src0')""", cte=False)
def seen_hash_anti_join(spark, d):
    docs = T.read(spark, d, "documents")
    return relations.unseen(docs, docs.where("source = 'src0'").select(relations.content_hash(F.col("text")).alias("h")), "text").select("doc_id", "h")


SPLIT = """SELECT c_custkey AS fam, n, CASE WHEN before < 0.8 * total THEN 'train' WHEN before < 0.9 * total THEN 'val' ELSE 'test' END AS split FROM (
  SELECT c_custkey, n, sum(n) OVER (ORDER BY md5('0:' || c_custkey), c_custkey) - n AS before, sum(n) OVER () AS total FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1))"""


@query(SPLIT, cte=False)
def cumulative_split(spark, d):
    sizes = T.pairs(spark, d).groupBy("fam").agg(F.count("*").alias("n"))
    return relations.cumulative_split(sizes, "fam", "n", [0.8, 0.9], ["train", "val", "test"]).select("fam", "n", "split")


@query(f"WITH s AS ({SPLIT}) SELECT pair_id, fam FROM pairs JOIN (SELECT fam FROM s WHERE split = 'train') USING (fam)")
def split_semi_join(spark, d):
    return T.pairs(spark, d).join(cumulative_split(spark, d).where("split = 'train'"), "fam", "left_semi").select("pair_id", "fam")


@query("SELECT pair_id, fam FROM (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY md5('7:' || pair_id), pair_id) AS r FROM pairs) WHERE r <= 2")
def hash_sample_per_family(spark, d):
    return relations.first_per_group(T.pairs(spark, d).select("pair_id", "fam"), "fam", [relations.draw("pair_id", seed=7), "pair_id"], 2)


@query("SELECT pair_id, fam FROM pairs ORDER BY md5('3:' || pair_id), pair_id LIMIT 500")
def hash_sample(spark, d):
    return relations.sampled(T.pairs(spark, d).select("pair_id", "fam"), "pair_id", 500, seed=3)


@query("SELECT user_id, count(*) AS visits FROM events GROUP BY user_id ORDER BY visits, md5('5:' || user_id), user_id LIMIT 20", cte=False)
def least_visited(spark, d):
    visits = T.read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("visits"))
    return relations.least_visited(visits, "visits", "user_id", 20, seed=5)


@query("""WITH s AS (SELECT fam, count(*) AS n, min(pair_id) AS f FROM pairs GROUP BY fam),
b AS (SELECT x.fam, x.pair_id AS pair_id_a, y.pair_id AS pair_id_b, n FROM pairs x JOIN pairs y ON x.fam = y.fam AND x.pair_id < y.pair_id JOIN s ON s.fam = x.fam),
c AS (SELECT fam, pair_id_a, pair_id_b FROM b WHERE CAST('0x' || substr(md5('1:' || pair_id_a || ':' || pair_id_b), 1, 8) AS BIGINT) / 4294967296.0 < CASE WHEN n <= 3 THEN 1.0 ELSE least(1.0, 1.5 * ln(n) / n) END)
SELECT * FROM c UNION ALL SELECT p.fam, f, p.pair_id FROM pairs p JOIN s USING (fam) WHERE n > 1 AND p.pair_id <> f AND p.pair_id NOT IN (SELECT pair_id_a FROM c UNION ALL SELECT pair_id_b FROM c)""")
def erdos_renyi_pairs(spark, d):
    return relations.random_pairs(T.pairs(spark, d).select("fam", "pair_id"), "fam", "pair_id", 1.5, seed=1)


PCT = ", ".join(f"round(quantile_cont(tau, {p / 100}), 7) AS p{p}" for p in (10, 25, 50, 75, 90))


@query(f"SELECT o_orderpriority, count(*) AS n, round(avg(tau), 6) AS mean, round(min(tau), 7) AS least, round(max(tau), 7) AS greatest, {PCT} FROM (SELECT o_orderpriority, o_totalprice / 100000.0 AS tau FROM orders) GROUP BY 1", cte=False)
def manifest_summary(spark, d):
    rows = T.read(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 100000.0).alias("tau"))
    return metrics.summary(rows, ["o_orderpriority"], "tau").select("o_orderpriority", "n", F.round("mean", 6).alias("mean"), *(F.round(c, 7).alias(c) for c in ("least", "greatest", "p10", "p25", "p50", "p75", "p90")))


@query("SELECT fam, tau_bin, count(*) AS pairs, round(sum(tau), 4) AS tau FROM (SELECT fam % 25 AS fam, tau, " + _case("tau", ">") + " AS tau_bin FROM pairs) GROUP BY ROLLUP (fam, tau_bin)")
def micro_rollup(spark, d):
    rows = _binned(spark, d).select((F.col("fam") % 25).alias("fam"), "tau_bin", "tau", F.lit(1).alias("pairs"))
    return metrics.rolled_up(rows, ["fam", "tau_bin"], ["pairs", "tau"]).withColumn("tau", F.round("tau", 4))


def _bd(ext: str | None) -> str:
    """SQL of the link model's transitions at rates (l, m) and time t of the relation ``r``."""
    rows = []
    for src in "SMID":
        g = "(1 - beta / (l / m * (1 - alpha)))" if src == "D" else "beta"
        for dst, x in (("M", f"(1 - {g}) * l / m * alpha"), ("I", g), ("D", f"(1 - {g}) * l / m * (1 - alpha)"), ("E", f"(1 - {g}) * (1 - l / m)")):
            if ext and src != "S":
                x = f"(1 - {ext}) * ({x})" + (f" + {ext}" if src == dst else "")
            rows.append(f"SELECT id, '{src}' AS src, '{dst}' AS dst, {x} AS p FROM bd")
    return "bd AS (SELECT *, exp(-m * t) AS alpha, CASE WHEN abs(1 - l / m) < 1e-4 THEN m * t / (1 + m * t) ELSE l * (1 - exp((l - m) * t)) / nullif(m - l * exp((l - m) * t), 0) END AS beta FROM r), model AS (" + " UNION ALL ".join(rows) + ")"


R = "r AS (SELECT c_custkey AS id, 0.02 + (c_custkey % 7) / 100.0 AS l, 0.03 + (c_custkey % 9) / 100.0 AS m, 0.1 + (c_custkey % 50) / 10.0 AS t FROM customer)"


def _rates(spark, d):
    c = F.col("c_custkey")
    return T.read(spark, d, "customer").select(c.alias("id"), (0.02 + (c % 7) / 100.0).alias("l"), (0.03 + (c % 9) / 100.0).alias("m"), (0.1 + (c % 50) / 10.0).alias("t"))


def _transitions(spark, d, ext):
    model = X.link_transitions(F.col("l"), F.col("m"), F.col("t"), F.lit(ext) if ext else None)
    return _rates(spark, d).select("id", F.explode(F.array(*(F.struct(F.lit(s).alias("src"), F.lit(t).alias("dst"), F.round(p, 9).alias("p")) for (s, t), p in model.items()))).alias("x")).select("id", "x.*")


@query(f"WITH {R}, {_bd(None)} SELECT id, src, dst, round(p, 9) AS p FROM model", cte=False)
def link_matrix(spark, d):
    return _transitions(spark, d, None)


@query(f"WITH {R}, {_bd('0.4')} SELECT id, src, dst, round(p, 9) AS p FROM model", cte=False)
def fragment_matrix(spark, d):
    return _transitions(spark, d, 0.4)


MSTEP = """WITH s AS (SELECT o_custkey AS fam, count(*) * 1.0::DOUBLE AS nb, count(*) * 1.7::DOUBLE + 1 AS nd, sum(o_totalprice) / 10000.0 AS ns, count(*) * 0.9::DOUBLE AS nl, 0.5::DOUBLE * count(*) AS nm, count(*) * 2.0::DOUBLE AS nt FROM orders GROUP BY 1),
q AS (SELECT *, nb + nl AS qa, nd - nl - nm AS qd FROM s),
k AS (SELECT *, (ns + nt) * qd AS c2, -(ns * (qa + qd + 2 * nm) + nt * (qd + nm)) AS c1, ns * qa AS c0 FROM q),
z AS (SELECT *, CASE WHEN c1 * c1 - 4 * c2 * c0 >= 0 AND c2 <> 0 THEN greatest(least((-c1 - sqrt(greatest(c1 * c1 - 4 * c2 * c0, 0))) / (2 * c2), 1 - 1e-10), 1e-10) END AS kap FROM k),
o AS (SELECT fam, CASE WHEN kap IS NULL THEN greatest(nb, 1e-10) / (ns + nt) ELSE greatest(kap * (qd + nm / (1 - kap)) / ns, 1e-10) END AS lam, CASE WHEN kap IS NULL THEN greatest(nd, 1e-10) / ns ELSE (qd + nm / (1 - kap)) / ns END AS mu FROM z)
SELECT fam, round(lam, 8) AS lam, round(greatest(mu, lam + 1e-10), 8) AS mu FROM o"""


@query(MSTEP, cte=False)
def mstep_quadratic(spark, d):
    n = F.count("*")
    s = T.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("fam")).agg((n * 1.0).alias("B"), (n * 1.7 + 1).alias("D"), (F.sum("o_totalprice") / 10000.0).alias("S"), (n * 0.9).alias("L"), (n * 0.5).alias("M"), (n * 2.0).alias("T"))
    lam, mu = X.quadratic_rates(*(F.col(c) for c in ("B", "D", "S", "L", "M", "T")))
    return s.select("fam", F.round(lam, 8).alias("lam"), F.round(mu, 8).alias("mu"))


MODEL = f"r AS (SELECT {', '.join(f'{v} AS {k}' for k, v in zip('lm', RATES, strict=False))}, tau_bin AS id, t FROM (SELECT unnest({list(range(8))}) AS tau_bin, unnest({[(a * b) ** 0.5 for a, b in zip(EDGES, EDGES[1:], strict=False)]}) AS t)), {_bd(str(RATES[2]))}"


def _log_model(spark):
    centres = [(k, (a * b) ** 0.5) for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))]
    lam, mu, ext = map(F.lit, RATES)
    model = X.link_transitions(lam, mu, F.col("t"), ext)
    rows = spark.createDataFrame(centres, "tau_bin int, t double")
    cells = F.array(*(F.struct(F.lit(counts.NAMES.index(s)).alias("src"), F.lit(counts.NAMES.index(t)).alias("dst"), F.log(p).alias("logp")) for (s, t), p in model.items()))
    return rows.select("tau_bin", F.explode(cells).alias("x")).select("tau_bin", "x.*")


@query(f"WITH {BINNED}, {STEPS}, {MODEL} SELECT fam, round(sum(ln(p)), 6) AS loglik, count(*) AS n FROM steps JOIN binned USING (pair_id) JOIN model ON model.id = tau_bin AND model.src = substr('SMIDE', steps.src + 1, 1) AND model.dst = substr('SMIDE', steps.dst + 1, 1) GROUP BY fam")
def family_loglik(spark, d):
    """Log-likelihood of each family's alignments under the fragment model at its pairs' times."""
    n = counts.transition_counts(T.columns(spark, d), _binned(spark, d).select("pair_id", "fam", "tau_bin"), ["fam", "tau_bin"])
    joined = n.join(F.broadcast(_log_model(spark)), ["tau_bin", "src", "dst"])  # 128 rows
    return joined.groupBy("fam").agg(F.round(F.sum(F.col("n") * F.col("logp")), 6).alias("loglik"), F.sum("n").alias("n"))


GROUPS = "g AS (SELECT tau_bin, count(*) FILTER (dst = 1) AS n_alpha, count(*) FILTER (dst = 3) AS n_1malpha, count(*) FILTER (src <> 3 AND dst = 2) AS n_beta, count(*) FILTER (src <> 3 AND dst <> 2) AS n_1mbeta, count(*) FILTER (src = 3 AND dst = 2) AS n_gamma, count(*) FILTER (src = 3 AND dst <> 2) AS n_1mgamma, count(*) FILTER (dst IN (1, 3)) AS n_kappa, count(*) FILTER (dst = 4) AS n_1mkappa FROM steps JOIN binned USING (pair_id) GROUP BY 1)"


@query(f"WITH {BINNED}, {STEPS}, {GROUPS} SELECT * FROM g")
def log_parameter_groups(spark, d):
    return counts.log_groups(transition_counts_by_bin(spark, d), ["tau_bin"])


@query()
def link_rates_em(spark, d):
    """Rates of the link model by EM over all pairs; its log-likelihood never falls (tested)."""
    groups = log_parameter_groups(spark, d)
    centres = spark.createDataFrame([(k, (a * b) ** 0.5) for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))], "tau_bin int, tau double")
    kept = groups.join(F.broadcast(centres), "tau_bin").cache()
    out = mixture.birth_death_em(kept)
    kept.unpersist()
    return out


HMM = ([0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]])


def _paths(spark, d):
    return markov.gathered(T.columns(spark, d).withColumn("x", F.col("st") - 1), "pair_id", "pos", "x")


EV = "ev AS (SELECT pair_id, pos, [ln(0.5), ln(0.3), ln(0.2)][st] AS e0, [ln(0.1), ln(0.3), ln(0.6)][st] AS e1 FROM columns)"


@query(f"""WITH {EV}, f AS (SELECT pair_id, pos, ln(0.6) + e0 AS s0, ln(0.4) + e1 AS s1 FROM ev WHERE pos = 0
  UNION ALL SELECT ev.pair_id, ev.pos, e0 + greatest(s0 + ln(0.9), s1 + ln(0.2)) + ln(1 + exp(-abs(s0 + ln(0.9) - s1 - ln(0.2)))), e1 + greatest(s0 + ln(0.1), s1 + ln(0.8)) + ln(1 + exp(-abs(s0 + ln(0.1) - s1 - ln(0.8)))) FROM f JOIN ev ON ev.pair_id = f.pair_id AND ev.pos = f.pos + 1)
SELECT pair_id, round(greatest(s0, s1) + ln(1 + exp(-abs(s0 - s1))), 7) AS loglik FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pos DESC) AS r FROM f) WHERE r = 1""")
def forward_two_state(spark, d):
    return markov.forward(_paths(spark, d), *HMM).select("pair_id", F.round("loglik", 7).alias("loglik"))


@query(f"""WITH {EV}, f AS (SELECT pair_id, pos, ln(0.6) + e0 AS s0, ln(0.4) + e1 AS s1 FROM ev WHERE pos = 0
  UNION ALL SELECT ev.pair_id, ev.pos, e0 + greatest(s0 + ln(0.9), s1 + ln(0.2)), e1 + greatest(s0 + ln(0.1), s1 + ln(0.8)) FROM f JOIN ev ON ev.pair_id = f.pair_id AND ev.pos = f.pos + 1)
SELECT pair_id, round(greatest(s0, s1), 7) AS score FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pos DESC) AS r FROM f) WHERE r = 1""")
def viterbi_two_state(spark, d):
    return markov.viterbi(_paths(spark, d), *HMM).select("pair_id", F.round("score", 7).alias("score"))


CENTRES = [[0.1] * 64, [-0.1] * 64, [0.0] * 64]
LP = "lp AS (SELECT vec_id, k, ln([0.3, 0.3, 0.4][k + 1]) - list_sum(list_transform(embedding, lambda x: (x - [0.1, -0.1, 0.0][k + 1]) * (x - [0.1, -0.1, 0.0][k + 1]))) / 2 AS logp FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), (SELECT unnest([0, 1, 2]) AS k))"


def _scores(spark, d):
    from math import log

    return mixture.gaussian_scores(T.read(spark, d, "embeddings"), CENTRES, [log(0.3), log(0.3), log(0.4)], 1.0)


@query(f"WITH {LP}, m AS (SELECT *, max(logp) OVER (PARTITION BY vec_id) AS top FROM lp), s AS (SELECT *, sum(exp(logp - top)) OVER (PARTITION BY vec_id) AS tot FROM m) SELECT vec_id, k, round(exp(logp - top) / tot, 7) AS weight, round(top + ln(tot), 6) AS lse FROM s", cte=False)
def soft_responsibilities(spark, d):
    return mixture.soft_responsibilities(_scores(spark, d), "vec_id").select("vec_id", "k", F.round("weight", 7).alias("weight"), F.round("lse", 6).alias("lse"))


@query(f"WITH {LP} SELECT vec_id, k FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logp DESC, k) AS r FROM lp) WHERE r = 1", cte=False)
def hard_responsibilities(spark, d):
    return mixture.hard_responsibilities(_scores(spark, d), "vec_id")


@query("""WITH e AS (SELECT user_id, event_id, ts, pow(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1, -0.6) AS eta FROM events),
w AS (SELECT *, eta * coalesce(exp(sum(ln(1 - eta)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) AS weight FROM e)
SELECT user_id, round(pow(sum(weight), 2) / sum(weight * weight), 6) AS ess FROM w GROUP BY user_id""", cte=False)
def decayed_weight_ess(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = T.read(spark, d, "events").select("user_id", "event_id", "ts", X.step_size(k, 1.0, 0.6).alias("eta"))
    return paths.effective_size(paths.decayed_weights(rows, "user_id", ["ts", "event_id"], "eta"), "user_id").select("user_id", F.round("ess", 6).alias("ess"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER w AS k, max(value) OVER w AS best, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, max(CASE WHEN prev IS NULL OR value > prev THEN k END) OVER (PARTITION BY user_id ORDER BY k) AS was FROM e) SELECT user_id, event_id, best, CAST(k - was AS INT) AS wait, k - was >= 5 AS stop FROM f""", cte=False)
def early_stop_trace(spark, d):
    return paths.early_stop(T.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 5).select("user_id", "event_id", "best", "wait", "stop")


@query("""WITH up AS (SELECT node, node AS anc, 0.0::DOUBLE AS dist, 0 AS k FROM edges UNION ALL SELECT up.node, e.parent, up.dist + e.length, k + 1 FROM up JOIN edges e ON e.node = up.anc),
pr AS (SELECT 'o' || o1.o_orderkey AS x, 'o' || o2.o_orderkey AS y FROM orders o1 JOIN orders o2 ON o1.o_custkey = o2.o_custkey AND o1.o_orderkey < o2.o_orderkey),
lft AS MATERIALIZED (SELECT x, y, anc, dist FROM pr JOIN up ON up.node = x)
SELECT x, y, round(min(lft.dist + b.dist), 7) AS d FROM lft JOIN up b ON b.node = y AND b.anc = lft.anc GROUP BY x, y""")
def tree_path_distance(spark, d):
    """The way over the region tree between every two orders of a customer, the one with the smaller number first."""
    members = T.pairs(spark, d).select("fam", F.concat(F.lit("o"), "pair_id").alias("node"))
    found = trees.distances_within(members, "fam", "node", trees.root_paths(T.edges(spark, d), 4), 4)
    turned = F.substring("x", 2, 20).cast("long") > F.substring("y", 2, 20).cast("long")
    return found.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("y"), F.round("d", 7).alias("d"))


@query("SELECT substr(node, 1, 1) AS level, round(sum(length), 4) AS total, count(*) AS edges FROM edges GROUP BY 1")
def tree_total_length(spark, d):
    return trees.total_length(T.edges(spark, d).withColumn("level", F.substring("node", 1, 1)), "level").withColumn("total", F.round("total", 4))


@query("""WITH leaf AS (SELECT 'o' || o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS mask FROM orders),
c AS (SELECT parent AS node, bit_and(mask) AS al, bit_or(mask) AS an FROM leaf JOIN edges USING (node) GROUP BY 1), cm AS (SELECT node, CASE WHEN al <> 0 THEN al ELSE an END AS mask FROM c)
SELECT * FROM leaf UNION ALL SELECT * FROM cm""")
def parsimony_sets(spark, d):
    """Sets of orders and of customers with orders only; ``parsimony_states`` is the whole tree."""
    return trees.parsimony(T.edges(spark, d).where("substr(node, 1, 1) = 'o'"), _masks(spark, d), 1)


def _masks(spark, d):
    status = F.col("o_orderstatus")
    return T.read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(status == "F", 1).when(status == "O", 2).otherwise(4).alias("mask"))


def _joined_sets(below: str) -> str:
    return f"SELECT parent AS node, CASE WHEN bit_and(mask) <> 0 THEN bit_and(mask) ELSE bit_or(mask) END AS mask FROM {below} JOIN edges USING (node) GROUP BY 1"


def _resolved(sets: str, above: str) -> str:
    return f"SELECT s.node, s.mask, CASE WHEN s.mask & u.state <> 0 THEN u.state ELSE s.mask & -s.mask END AS state FROM {sets} s JOIN edges e ON e.node = s.node JOIN {above} u ON u.node = e.parent"


@query(f"""WITH os AS (SELECT 'o' || o_orderkey AS node, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS mask FROM orders),
bare AS (SELECT node, 7 AS mask FROM edges WHERE substr(node, 1, 1) <> 'o' AND node NOT IN (SELECT parent FROM edges)),
cs AS ({_joined_sets('os')} UNION ALL SELECT * FROM bare WHERE node LIKE 'c%'), ns AS ({_joined_sets('cs')} UNION ALL SELECT * FROM bare WHERE node LIKE 'n%'),
rs AS ({_joined_sets('ns')} UNION ALL SELECT * FROM bare WHERE node LIKE 'r%'), top AS ({_joined_sets('rs')}),
d0 AS (SELECT node, mask, CASE WHEN mask >= 4 THEN 4 WHEN mask >= 2 THEN 2 ELSE 1 END AS state FROM top), d1 AS ({_resolved('rs', 'd0')}), d2 AS ({_resolved('ns', 'd1')}), d3 AS ({_resolved('cs', 'd2')}), d4 AS ({_resolved('os', 'd3')})
SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4""")
def parsimony_states(spark, d):
    """Bottom-up set and top-down state of every node from the root to the orders; what has no order below it is unknown."""
    edges = T.edges(spark, d)
    return trees.resolved(edges, trees.parsimony(edges, _masks(spark, d), 4, unknown=7), 4)


TRUTH = "t AS (SELECT pair_id, i, j FROM (SELECT pair_id, st, sum(CAST(st <> 2 AS INT)) OVER w - 1 AS i, sum(CAST(st <> 3 AS INT)) OVER w - 1 AS j FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)) WHERE st = 1)"


def _cells(spark, d):
    return paths.residue_positions(T.columns(spark, d)).where(F.col("st") == counts.MATCH).select("pair_id", "i", "j")


@query(f"WITH {TRUTH}, p AS (SELECT DISTINCT pair_id, i, i AS j FROM t) SELECT t.pair_id, count(*) AS gold, count(p.i) AS tp, round(count(p.i) / count(*), 9) AS sp FROM t LEFT JOIN p ON p.pair_id = t.pair_id AND p.i = t.i AND p.j = t.j GROUP BY 1")
def sum_of_pairs(spark, d):
    """Against the prediction that aligns equal positions."""
    cells = _cells(spark, d)
    return metrics.sum_of_pairs(cells, cells.select("pair_id", "i", F.col("i").alias("j")), ["pair_id"]).withColumn("sp", F.round("sp", 9))


@query(f"WITH {TRUTH}, p AS (SELECT pair_id, i, i AS j, 0.5 + 0.5 / (1 + i) AS p FROM t), m AS (SELECT pair_id, sum(p) AS mass FROM p GROUP BY 1) SELECT t.pair_id, round(coalesce(sum(p.p), 0), 6) AS e_tp, count(*) AS gold, round(mass, 6) AS mass, round(2 * coalesce(sum(p.p), 0) / (mass + count(*)), 6) AS f1 FROM t LEFT JOIN p ON p.pair_id = t.pair_id AND p.i = t.i AND p.j = t.j JOIN m ON m.pair_id = t.pair_id GROUP BY t.pair_id, mass")
def expected_pair_f1(spark, d):
    cells = _cells(spark, d)
    post = cells.select("pair_id", "i", F.col("i").alias("j"), (0.5 + 0.5 / (1 + F.col("i"))).alias("p"))
    out = metrics.expected_f1(cells, post, ["pair_id"])
    return out.select("pair_id", F.round("e_tp", 6).alias("e_tp"), "gold", F.round("mass", 6).alias("mass"), F.round("f1", 6).alias("f1"))


@query("""SELECT lang, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM (
SELECT lang, count(*) FILTER (quality = 1 AND s = 1) AS tp, count(*) FILTER (quality = 0 AND s = 1) AS fp, count(*) FILTER (quality = 1 AND s = 0) AS fn, count(*) FILTER (quality = 0 AND s = 0) AS tn FROM (SELECT lang, quality, CAST(n_chars > 1000 AS INT) AS s FROM labels JOIN documents USING (doc_id)) GROUP BY 1)""", cte=False)
def f1_confusion(spark, d):
    rows = T.read(spark, d, "labels").join(T.read(spark, d, "documents"), "doc_id").select("lang", "quality", (F.col("n_chars") > 1000).cast("int").alias("said"))
    return metrics.confusion(rows, "quality", "said", ["lang"]).select("lang", "tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS x, extract(epoch FROM o_orderdate) AS y FROM orders), k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM r)
SELECT g, round(corr(rx, ry), 6) AS rho FROM k GROUP BY g""", cte=False)
def spearman_by_priority(spark, d):
    rows = T.read(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"), F.unix_timestamp("o_orderdate").alias("y"))
    return metrics.spearman(rows, "g", "x", "y").withColumn("rho", F.round("rho", 6))


STATES = {"F": 0, "O": 1, "P": 2}


def _lifted(level: str, below: str, cols: str = "l0, l1, l2") -> str:
    """SQL of one pruning level: children ``below`` (node, l0, l1, l2) summed into their parents."""
    top, same = "greatest(l0, l1, l2)", "exp(-length * 1.5)"
    to = ", ".join(f"sum({top} + ln((1 - {same}) / 3 * (exp(l0 - {top}) + exp(l1 - {top}) + exp(l2 - {top})) + {same} * exp({c} - {top}))) AS {c}" for c in cols.split(", "))
    return f"{level} AS (SELECT parent AS node, {to} FROM {below} JOIN edges USING (node) GROUP BY 1)"


@query(f"WITH lf AS (SELECT 'o' || o_orderkey AS node, {', '.join(f'CASE WHEN o_orderstatus = {chr(39)}{k}{chr(39)} THEN 0.0 ELSE -1e30 END AS l{v}' for k, v in STATES.items())} FROM orders), {_lifted('c1', 'lf')}, {_lifted('c2', 'c1')}, {_lifted('c3', 'c2')}, {_lifted('c4', 'c3')} SELECT node, round(greatest(l0, l1, l2) + ln((exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) / 3), 4) AS loglik FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4)")
def pruning_loglik(spark, d):
    """Log-likelihood of the orders' states below every inner node of the region tree, under equal rates."""
    status = F.col("o_orderstatus")
    leaf = T.read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(status == "F", 0).when(status == "O", 1).when(status == "P", 2).alias("state"))
    rows = phylogeny.pruning(T.edges(spark, d), leaf, 3).where("substr(node, 1, 1) <> 'o'")
    top = F.greatest("l0", "l1", "l2")
    return rows.select("node", F.round(top + F.log((F.exp(F.col("l0") - top) + F.exp(F.col("l1") - top) + F.exp(F.col("l2") - top)) / 3), 4).alias("loglik"))


def _families(spark, d):
    """All vectors of each label."""
    return T.read(spark, d, "embeddings").where("label IS NOT NULL").select(F.col("label").cast("long").alias("fam"), "vec_id", "embedding")


@query()
def neighbour_joining_trees(spark, d):
    return phylogeny.neighbour_joining(_families(spark, d))


@query()
def average_linkage_trees(spark, d):
    return phylogeny.average_linkage(_families(spark, d))


@query()
def greedy_matching(spark, d):
    return phylogeny.greedy_matching(_families(spark, d))


@query()
def global_alignments(spark, d):
    """Scored 1 for equal, -1 for unequal residues and -2 for a gap."""
    return pairwise.global_alignment(pairwise.ungapped(T.columns(spark, d)), gap=-2.0)


def pair_sql(best: bool, band: int | None = None) -> str:
    """SQL of each pair's total over all its alignments, or of its likeliest one: a table's anti-diagonals one after another.

    With ``band``, over those whose cells lie within it of the given alignment's.

    A row is a cell: f for start, M, I and D, and g for the same cell's neighbour on the diagonal before.
    """
    def ways(p: str, to: str) -> str:
        terms = [f"{p}{src} * t{src}{to}" for src in "smid"]
        return f"greatest({', '.join(terms)})" if best else f"({' + '.join(terms)})"

    match = f"{ways('g', 'm')} * ((1 - same) / 20 + CASE WHEN x[i + 1] = y[d - i] THEN same ELSE 0 END) / 20"
    take = lambda w, value: f"max(CASE WHEN w = {w} THEN {value} ELSE 0 END)"
    centres = "bc AS (SELECT pair_id, list(centre ORDER BY pos) AS cs FROM (SELECT pair_id, pos, st, count(*) FILTER (st <> 3) OVER (PARTITION BY pair_id ORDER BY pos) - CAST(st <> 3 AS INT) AS centre FROM columns) WHERE st <> 2 GROUP BY 1)"
    # a cell outside the band has nothing, but hands on what its neighbours need
    near = "" if band is None else f" * max(CASE WHEN abs((d + 1 - i - w) - CASE WHEN i + w < len(x) THEN cs[i + w + 1] ELSE len(y) END) <= {band} THEN 1 ELSE 0 END)"
    return f"""WITH r AS (SELECT 0 AS id, {RATES[0]} AS l, {RATES[1]} AS m, 1.0 AS t), {_bd(str(RATES[2]))},
k AS (SELECT {', '.join(f"max(p) FILTER (src = '{a}' AND dst = '{b}') AS t{a}{b}".lower().replace("'" + a.lower() + "'", f"'{a}'").replace("'" + b.lower() + "'", f"'{b}'") for a in 'SMID' for b in 'MIDE')}, exp(-20.0 / 19) AS same FROM model),
xs AS (SELECT pair_id, coalesce(list(a ORDER BY pos) FILTER (st <> 2), []) AS x, coalesce(list(b ORDER BY pos) FILTER (st <> 3), []) AS y FROM columns GROUP BY 1),{'' if band is None else f' {centres},'}
dp AS (SELECT pair_id, 0 AS d, 0 AS i, 1.0::DOUBLE AS fs, 0.0::DOUBLE AS fm, 0.0::DOUBLE AS fi, 0.0::DOUBLE AS fd, 0.0::DOUBLE AS gs, 0.0::DOUBLE AS gm, 0.0::DOUBLE AS gi, 0.0::DOUBLE AS gd FROM xs
  UNION ALL SELECT pair_id, d + 1, i + w, 0.0::DOUBLE, {take(1, f"CASE WHEN d > i THEN {match} ELSE 0 END")}{near}, {take(0, ways('f', 'i') + ' / 20')}{near}, {take(1, ways('f', 'd') + ' / 20')}{near}, {take(0, 'fs')}, {take(0, 'fm')}, {take(0, 'fi')}, {take(0, 'fd')}
  FROM dp JOIN xs USING (pair_id){'' if band is None else ' LEFT JOIN bc USING (pair_id)'}, k, (SELECT unnest([0, 1]) AS w) WHERE CASE WHEN w = 0 THEN d - i < len(y) ELSE i < len(x) END GROUP BY pair_id, d + 1, i + w)
SELECT pair_id, round({f"ln({ways('f', 'e')})" if band is None else f"CASE WHEN {ways('f', 'e')} > 0 THEN ln({ways('f', 'e')}) ELSE -1e30 END"}, 6) AS {'score' if best else 'loglik'} FROM dp JOIN xs USING (pair_id), k WHERE d = len(x) + len(y) AND i = len(x)"""


@query(pair_sql(best=False))
def pair_model_logliks(spark, d):
    """Each pair's log-probability over all of its alignments under the fragment model at time 1."""
    rows = pairwise.pair_likelihoods(pairwise.ungapped(T.columns(spark, d)), *pairwise.model_arrays(*RATES[:2], 1.0, RATES[2], 20))
    return rows.select("pair_id", F.round("loglik", 6).alias("loglik"))


def _posteriors(spark, d, threshold):
    return pairwise.match_posteriors(pairwise.ungapped(T.columns(spark, d)), *pairwise.model_arrays(*RATES[:2], 1.0, RATES[2], 20), threshold=threshold)


@query()
def pair_match_posteriors(spark, d):
    """A sparse report: the cells of at least 0.05."""
    return _posteriors(spark, d, 0.05)


@query()
def gaussian_mixture_em(spark, d):
    """Component, weight and first coordinates after five EM iterations; the likelihood never falls (tested)."""
    centres, logw, _ = mixture.gaussian_em(T.read(spark, d, "embeddings").select("vec_id", "embedding"), 64, 4)
    return spark.createDataFrame([(k, float(w), float(c[0]), float(c[1])) for k, (w, c) in enumerate(zip(logw, centres, strict=True))], "k int, log_weight double, c0 double, c1 double")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", cte=False)
def stream_windowed_counts(spark, d):
    done = jobs.finished(jobs.windowed_counts(jobs.events(spark, d), "6 hours"), "complete", "windows")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(value) AS greatest FROM events GROUP BY 1", cte=False)
def stream_user_totals(spark, d):
    return jobs.finished(jobs.user_totals(jobs.events(spark, d)), "complete", "totals").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS finish, count(*) AS n FROM s GROUP BY user_id, k""", cte=False)
def stream_sessions(spark, d):
    done = jobs.finished(jobs.sessions(jobs.events(spark, d), "2 hours"), "complete", "sessions")
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n")


TIMES = X.geometric_edges(0.001, 10.0, 49)


def _time_sql() -> str:
    from math import exp, log

    cells = []
    for k, t in enumerate(TIMES):
        keep = exp(-t * 20 / 19)
        cells.append(f"({k}, {t!r}, {log((1 - keep) / 20 + keep)!r}, {log((1 - keep) / 20)!r})")
    return f"""WITH n AS (SELECT pair_id, sum(CAST(a = b AS INT)) AS s, sum(CAST(a <> b AS INT)) AS o FROM columns WHERE st = 1 GROUP BY 1), g AS (SELECT * FROM (VALUES {', '.join(cells)}) AS v(k, t, ls, lo)),
l AS (SELECT pair_id, t, s * ls + o * lo AS loglik, row_number() OVER (PARTITION BY pair_id ORDER BY s * ls + o * lo DESC, k) AS r FROM n, g) SELECT pair_id, round(t, 9) AS t, round(loglik, 6) AS loglik FROM l WHERE r = 1"""


@query(_time_sql())
def likeliest_pair_time(spark, d):
    best = substitution.likeliest_time(T.columns(spark, d).where(F.col("st") == counts.MATCH), TIMES, 20, "pair_id")
    return best.select("pair_id", F.round("t", 9).alias("t"), F.round("loglik", 6).alias("loglik"))


@query(f"WITH {BINNED}, n AS (SELECT tau_bin, a, b, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY ALL) SELECT tau_bin, a, b, round((n + 0.5) / sum(n + 0.5) OVER (PARTITION BY tau_bin), 9) AS share FROM n")
def match_posterior_shares(spark, d):
    return substitution.posterior_shares(match_counts(spark, d), ["a", "b"], "tau_bin", 1.5).withColumn("share", F.round("share", 9))


CENTRES_SQL = ", ".join(f"({k}, {(x * y) ** 0.5!r})" for k, (x, y) in enumerate(zip(EDGES, EDGES[1:], strict=False)))


@query(f"""WITH {BINNED}, n AS (SELECT tau_bin, a = b AS same, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY ALL), c AS (SELECT * FROM (VALUES {CENTRES_SQL}) AS v(tau_bin, t))
SELECT tau_bin, round(sum(n * ln(((1 - exp(-t::DOUBLE * 20 / 19)) / 20 + CASE WHEN same THEN exp(-t::DOUBLE * 20 / 19) ELSE 0 END) / 20)), 4) AS loglik FROM n JOIN c USING (tau_bin) GROUP BY tau_bin""")
def substitution_loglik(spark, d):
    """Log-likelihood of all matches by time bin under equal rates: counts joined with a literal table."""
    q, pi = substitution.equal_rates(20)
    table = substitution.logs_by_bin(spark, q, pi, [(a * b) ** 0.5 for a, b in zip(EDGES, EDGES[1:], strict=False)])
    found = counts.contracted(match_counts(spark, d), F.broadcast(table), ["tau_bin", "a", "b"], ["tau_bin"])  # 3,200 rows
    return found.withColumn("loglik", F.round("loglik", 4))


GAMMA = X.discrete_gamma(0.5, 4)
LEAF = ", ".join(f"CASE WHEN o_orderstatus = '{k}' THEN 0.0 ELSE -1e30 END AS l{v}" for k, v in STATES.items())


def _rated(level: str, below: str) -> str:
    """SQL of one pruning level for every rate at once."""
    top, same = "greatest(l0, l1, l2)", "exp(-length * speed * 1.5)"
    total = f"(exp(l0 - {top}) + exp(l1 - {top}) + exp(l2 - {top}))"
    to = ", ".join(f"sum({top} + ln((1 - {same}) / 3 * {total} + {same} * exp({c} - {top}))) AS {c}" for c in ("l0", "l1", "l2"))
    return f"{level} AS (SELECT rate, speed, parent AS node, {to} FROM {below} JOIN edges USING (node) GROUP BY 1, 2, 3)"


@query(f"""WITH lf AS (SELECT rate, speed, 'o' || o_orderkey AS node, {LEAF} FROM orders, (VALUES {', '.join(f'({k}, {r!r})' for k, r in enumerate(GAMMA))}) AS v(rate, speed)), {_rated('c1', 'lf')}, {_rated('c2', 'c1')}, {_rated('c3', 'c2')}, {_rated('c4', 'c3')},
w AS (SELECT rate, greatest(l0, l1, l2) + ln((exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) / 3) AS logp FROM c4)
SELECT rate, round(logp, 3) AS logp, round(exp(logp - max(logp) OVER ()) / sum(exp(logp - (SELECT max(logp) FROM w))) OVER (), 6) AS weight FROM w""")
def site_rate_posterior(spark, d):
    """Posterior of four discrete-gamma rates for the orders' states on the region tree."""
    status = F.col("o_orderstatus")
    leaf = T.read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(status == "F", 0).when(status == "O", 1).when(status == "P", 2).alias("state"))
    found = substitution.site_rates(T.edges(spark, d), leaf, GAMMA, 3, None, "root")
    return found.select("rate", F.round("logp", 3).alias("logp"), F.round("weight", 6).alias("weight"))


@query()
def ancestral_states(spark, d):
    """Marginal posterior of the state of every inner node that has orders below it, given those."""
    status = F.col("o_orderstatus")
    leaf = T.read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.when(status == "F", 0).when(status == "O", 1).when(status == "P", 2).alias("state"))
    return substitution.root_states(phylogeny.pruning(T.edges(spark, d), leaf, 3).where("substr(node, 1, 1) <> 'o'"), 3)


@query(f"WITH lf AS (SELECT 'o' || o_orderkey AS node, {LEAF} FROM orders), {_lifted('c1', 'lf')}, {_lifted('c2', 'c1')}, {_lifted('c3', 'c2')}, {_lifted('c4', 'c3')}, al AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4), tp AS (SELECT *, greatest(l0, l1, l2) AS top FROM al) SELECT node, state, round(exp([l0, l1, l2][state + 1] - top) / (exp(l0 - top) + exp(l1 - top) + exp(l2 - top)), 5) AS p FROM tp, (SELECT unnest([0, 1, 2]) AS state)")
def ancestral_state_shares(spark, d):
    """The posteriors of ``ancestral_states`` to five decimals."""
    return ancestral_states(spark, d).withColumn("p", F.round("p", 5))


@query()
def optimal_accuracy_alignments(spark, d):
    """Decoded from all cells of the posterior, however small."""
    return pairwise.accurate_alignments(pairwise.ungapped(T.columns(spark, d)), *pairwise.model_arrays(*RATES[:2], 1.0, RATES[2], 20))


@query(f"""WITH x AS (SELECT pair_id, pos, lag(st, 1, 0) OVER w AS src, st AS dst, lead(st) OVER w IS NULL AS last FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)),
s AS (SELECT pair_id, pos, src, dst FROM x UNION ALL SELECT pair_id, pos + 1, dst, 4 FROM x WHERE last),
h AS (SELECT src, {', '.join(f"count(*) FILTER (dst <= {k})::DOUBLE / count(*) AS c{k}" for k in range(4))} FROM s GROUP BY src),
u AS (SELECT src, CAST('0x' || substr(md5('11:' || pair_id || ':' || pos), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM s)
SELECT u.src, CAST({' + '.join(f"CASE WHEN u >= c{k} THEN 1 ELSE 0 END" for k in range(4))} AS INT) AS dst, count(*) AS n FROM u JOIN h USING (src) GROUP BY ALL""")
def simulated_transition_counts(spark, d):
    """Transition counts of all line items with every step drawn anew from the shares counted over them."""
    steps = counts.placed_transitions(T.columns(spark, d))
    drawn = simulate.redrawn(steps, simulate.transition_shares(steps, 5), ["pair_id", "pos"], seed=11)
    return drawn.groupBy("src", F.col("drawn").alias("dst")).agg(F.count("*").alias("n"))


@query("SELECT pair_id, CASE WHEN u < 0.6 THEN 0 ELSE 1 END AS state, CASE WHEN u < 0.6 THEN CASE WHEN v < 0.9 THEN 0 ELSE 1 END ELSE CASE WHEN v < 0.2 THEN 0 ELSE 1 END END AS child FROM (SELECT pair_id, CAST('0x' || substr(md5('21:' || pair_id), 1, 12) AS BIGINT) / 281474976710656.0 AS u, CAST('0x' || substr(md5('22:' || pair_id), 1, 12) AS BIGINT) / 281474976710656.0 AS v FROM pairs)")
def sampled_descendants(spark, d):
    import numpy as np

    rows = T.pairs(spark, d).select("pair_id").withColumn("state", simulate.choose(simulate.uniform("pair_id", seed=21), [0.6, 0.4]))
    return simulate.descendants(rows, ["pair_id"], "state", np.array([[0.9, 0.1], [0.2, 0.8]]), seed=22)


@query(f"WITH {BINNED} SELECT tau_bin, CASE WHEN st = 2 THEN 20 ELSE a END AS x, CASE WHEN st = 3 THEN 20 ELSE b END AS y, count(*) AS n FROM columns JOIN binned USING (pair_id) GROUP BY ALL")
def residue_contingency(spark, d):
    """Counts of residue pairs by time bin, a gap being residue 20."""
    return counts.contingency(T.columns(spark, d), _binned(spark, d).select("pair_id", "tau_bin"), ["tau_bin"], 20)


@query(f"WITH {LP}, m AS (SELECT *, max(logp) OVER (PARTITION BY vec_id) AS top FROM lp), s AS (SELECT vec_id, k, exp(logp - top) / sum(exp(logp - top)) OVER (PARTITION BY vec_id) AS w FROM m) SELECT k, label, round(sum(w), 6) AS n FROM s JOIN embeddings USING (vec_id) GROUP BY k, label", cte=False)
def weighted_label_counts(spark, d):
    """Labels counted by the responsibilities of a literal mixture."""
    weights = mixture.soft_responsibilities(_scores(spark, d), "vec_id").select("vec_id", "k", "weight")
    labels = T.read(spark, d, "embeddings").select("vec_id", "label", F.lit(1).alias("n"))
    return counts.weighted(labels, weights, ["vec_id"], "k", ["label"]).withColumn("n", F.round("n", 6))


@query(f"WITH {BINNED}, {STEPS}, {MODEL}, f AS (SELECT fam, sum(ln(p)) AS loglik FROM steps JOIN binned USING (pair_id) JOIN model ON model.id = tau_bin AND model.src = substr('SMIDE', steps.src + 1, 1) AND model.dst = substr('SMIDE', steps.dst + 1, 1) GROUP BY fam), s AS ({SPLIT}) SELECT split, count(*) AS n, round(sum(loglik), 4) AS total, round(avg(loglik), 5) AS mean, round(stddev_samp(loglik) / sqrt(count(*)), 5) AS se FROM f JOIN s USING (fam) GROUP BY split")
def split_loglik(spark, d):
    """Log-likelihood of the families of each split: total, mean and its standard error."""
    n = counts.transition_counts(T.columns(spark, d), _binned(spark, d).select("pair_id", "fam", "tau_bin"), ["fam", "tau_bin"])
    ll = n.join(F.broadcast(_log_model(spark)), ["tau_bin", "src", "dst"]).groupBy("fam").agg(F.sum(F.col("n") * F.col("logp")).alias("loglik"))
    out = metrics.means(ll.join(cumulative_split(spark, d).select("fam", "split"), "fam"), ["split"], "loglik")
    return out.select("split", "n", F.round("total", 4).alias("total"), F.round("mean", 5).alias("mean"), F.round("se", 5).alias("se"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3", cte=False)
def commonest_outcomes(spark, d):
    return metrics.histogram(T.read(spark, d, "events"), "event_type", 3)


@query("WITH c AS (SELECT o_custkey AS fam, count(*) AS pairs FROM orders GROUP BY 1) SELECT fam, pairs, coalesce(n_name, CAST(fam AS VARCHAR)) AS clan FROM c LEFT JOIN (SELECT c_custkey AS fam, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 3 <> 0) USING (fam)", cte=False)
def families_with_clans(spark, d):
    fams = T.pairs(spark, d).groupBy("fam").agg(F.count("*").alias("pairs"))
    nation = T.read(spark, d, "nation").where("n_nationkey % 3 <> 0")
    clans = T.read(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("fam"), F.col("n_name").alias("clan"))
    return relations.with_clan(fams, clans)


@query("SELECT o_orderpriority, pair_id FROM (SELECT o_orderpriority, o_orderkey AS pair_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('2:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 40", cte=False)
def stratified_sample(spark, d):
    rows = T.read(spark, d, "orders").select("o_orderpriority", F.col("o_orderkey").alias("pair_id"))
    return relations.first_per_group(rows, "o_orderpriority", [relations.draw("pair_id", seed=2), "pair_id"], 40)


@query("SELECT pos AS col, bool_and(st = 2) AS empty_a, bool_and(st = 3) AS empty_b, count(*) AS n FROM columns GROUP BY pos")
def empty_columns(spark, d):
    """Positions at which no pair has a residue in its first, or in its second, row."""
    return T.columns(spark, d).groupBy(F.col("pos").alias("col")).agg(F.every(F.col("st") == counts.INSERT).alias("empty_a"), F.every(F.col("st") == counts.DELETE).alias("empty_b"), F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, 0.3 * value AS ema FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, 0.7 * r.ema + 0.3 * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, round(ema, 6) AS ema FROM r""", cte=False)
def moving_averages(spark, d):
    return paths.moving_average(T.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", F.lit(0.3), 0.0).select("user_id", "event_id", F.round("ema", 6).alias("ema"))


@query("""SELECT lang, c, round(sqrt(sum(pow(x - y, 2))), 6) AS d FROM (SELECT a.lang, a.c, a.s AS x, b.s AS y FROM v a JOIN v b ON a.c = b.c AND b.lang = 'en') GROUP BY lang, c""".replace("SELECT lang, c, round", "WITH n AS (SELECT lang, c, count(*) AS n FROM symbols JOIN documents ON doc_id = seq_id GROUP BY 1, 2), v AS (SELECT lang, c, n / sum(n) OVER (PARTITION BY lang) AS s FROM n) SELECT lang, c, round"))
def composition_distance(spark, d):
    """How far each language's share of each symbol is from English."""
    docs = T.read(spark, d, "documents")
    vectors = counts.letter_vectors(docs.select(F.col("doc_id").alias("seq_id"), F.lower("text").alias("s")), 20)
    by = vectors.join(docs.select(F.col("doc_id").alias("seq_id"), "lang"), "seq_id")
    shares = counts.letter_shares(by, "lang")
    base = shares.where("lang = 'en'").select("c", F.col("share").alias("base"))
    return shares.join(base, "c").select("lang", "c", F.round(F.abs(F.col("share") - F.col("base")), 6).alias("d"))
