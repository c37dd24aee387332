"""Registered queries over alignment columns, pairs and families: guards, labels, set operations, scores, orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.storage import stored
from ..operators import counts, guards, metrics, paths, relations
from ..sources import tables as T
from .registry import BINNED, SPLIT, _binned, cumulative_split, query

#: Aligned rows in which either row, or both, may have a gap, and residues 0-19 of which 19 is unknown to the alphabet.
GAPPED = """gapped AS (SELECT l_orderkey AS pair_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS pos,
  CASE WHEN l_quantity % 4 <> 0 THEN CAST(l_partkey % 20 AS INT) END AS a, CASE WHEN l_quantity % 6 <> 0 THEN CAST(l_suppkey % 20 AS INT) END AS b FROM lineitem),
clean AS (SELECT pair_id, pos, CASE WHEN a IS NULL THEN 2 WHEN b IS NULL THEN 3 ELSE 1 END AS st, a, b FROM gapped WHERE (a IS NOT NULL OR b IS NOT NULL) AND coalesce(a, 0) < 19 AND coalesce(b, 0) < 19)"""


def _gapped(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return T.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"),
        F.when(F.col("l_quantity") % 4 != 0, (F.col("l_partkey") % 20).cast("int")).alias("a"), F.when(F.col("l_quantity") % 6 != 0, (F.col("l_suppkey") % 20).cast("int")).alias("b"),
    )


@query(f"""WITH {GAPPED}, step AS (SELECT lag(st, 1, 0) OVER w AS src, st AS dst FROM clean WINDOW w AS (PARTITION BY pair_id ORDER BY pos)
  UNION ALL SELECT st, 4 FROM (SELECT st, row_number() OVER (PARTITION BY pair_id ORDER BY pos DESC) AS r FROM clean) WHERE r = 1) SELECT src, dst, count(*) AS n FROM step GROUP BY ALL""")
def cleaned_transition_counts(spark, d):
    """Steps of the columns that are left without two gaps and unknown residues; the state before a dropped column stays."""
    return counts.transitions(guards.cleaned(_gapped(spark, d), 19)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {GAPPED} SELECT st, a, b, count(*) AS n FROM clean GROUP BY ALL")
def cleaned_column_types(spark, d):
    return guards.cleaned(_gapped(spark, d), 19).groupBy("st", "a", "b").agg(F.count("*").alias("n"))


LETTERS = "ABCDEFGHIJKLMNOPQRST"


def _records(spark, d):
    """Pair records, some of whose sequences lack a letter and some hold a letter outside the alphabet."""
    columns = T.columns(spark, d)
    letter = lambda c: F.substring(F.lit(LETTERS), F.col(c) + 1, 1)
    rows = F.sort_array(F.collect_list(F.struct("pos", "st", letter("a").alias("a"), letter("b").alias("b"))))
    made = columns.groupBy("pair_id").agg(rows.alias("r")).withColumns({"x": F.array_join(F.transform(F.filter("r", lambda c: c["st"] != counts.INSERT), lambda c: c["a"]), ""), "y": F.array_join(F.transform(F.filter("r", lambda c: c["st"] != counts.DELETE), lambda c: c["b"]), "")})
    x = F.when(F.col("pair_id") % 7 == 0, F.expr("substr(x, 2)")).otherwise(F.col("x"))
    y = F.when(F.col("pair_id") % 11 == 0, F.concat("y", F.lit("Z"))).when(F.col("pair_id") % 13 == 0, F.concat("y", F.lit("A"))).otherwise(F.col("y"))
    return paths.run_lengths(columns).join(made.select("pair_id", x.alias("x"), y.alias("y")), "pair_id")


@query("""WITH c AS (SELECT pair_id, count(*) AS n_cols, count(*) FILTER (st <> 2) AS lx, count(*) FILTER (st <> 3) AS ly FROM columns GROUP BY 1)
SELECT pair_id, n_cols, message = 'ok' AS ok, message FROM (SELECT *, CASE WHEN pair_id % 11 = 0 THEN 'bad letters in y' WHEN pair_id % 7 = 0 AND lx > 0 THEN 'x has another length' WHEN pair_id % 13 = 0 THEN 'y has another length' WHEN n_cols > 6 THEN 'too long' ELSE 'ok' END AS message FROM c)""")
def validated_records(spark, d):
    """Which pair records hold what their run lengths say, and why the others don't."""
    return guards.validated(_records(spark, d), 6).select("pair_id", "n_cols", "ok", "message")


@query("SELECT fam, count(*) AS members, max(n) AS cols FROM pairs JOIN (SELECT pair_id, count(*) AS n FROM columns GROUP BY 1) USING (pair_id) GROUP BY fam HAVING count(*) BETWEEN 5 AND 12 AND max(n) >= 7")
def eligible_families(spark, d):
    sizes = T.columns(spark, d).groupBy("pair_id").agg(F.count("*").alias("n_cols"))
    return guards.eligible_families(T.pairs(spark, d), sizes, (5, 12), 7)


def _aligned(spark, d):
    """fam, col, res: the first rows of a family's pairs, aligned by position."""
    return T.columns(spark, d).join(T.pairs(spark, d).select("pair_id", "fam"), "pair_id").select("fam", F.col("pos").alias("col"), F.when(F.col("st") != counts.INSERT, F.col("a")).alias("res"))


ALIGNED = "aligned AS (SELECT fam, pos AS col, CASE WHEN st <> 2 THEN a END AS res FROM columns JOIN pairs USING (pair_id))"


@query(f"WITH {ALIGNED} SELECT fam, count(*) AS empty FROM (SELECT fam, col FROM aligned GROUP BY 1, 2 HAVING count(res) = 0) GROUP BY fam")
def families_with_empty_columns(spark, d):
    return guards.families_with_empty_columns(_aligned(spark, d))


@query(f"""WITH {ALIGNED}, n AS (SELECT fam, col, res, count(*) AS n FROM aligned GROUP BY ALL),
c AS (SELECT fam, col, coalesce(sum(n) FILTER (res IS NOT NULL), 0) AS observed, sum(n) AS r, max(sum(n)) OVER (PARTITION BY fam) AS most FROM n GROUP BY fam, col),
b AS (SELECT fam, col, res FROM (SELECT *, row_number() OVER (PARTITION BY fam, col ORDER BY n DESC, res) AS k FROM n WHERE res IS NOT NULL) WHERE k = 1)
SELECT fam, col, CAST(observed AS BIGINT) AS observed, CASE WHEN observed < greatest(3, most // 4) OR res IS NULL THEN -1 ELSE res END AS label FROM c LEFT JOIN b USING (fam, col)""")
def column_labels(spark, d):
    """Each column's commonest residue, -1 where too few rows have one."""
    return guards.column_labels(_aligned(spark, d))


@query("SELECT pair_id, CAST(count(*) FILTER (st <> 2) OVER w - CAST(st <> 2 AS INT) AS BIGINT) AS i, CAST(count(*) FILTER (st <> 3) OVER w - CAST(st <> 3 AS INT) AS BIGINT) AS centre, st FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)".replace("SELECT pair_id, CAST", "SELECT pair_id, i, centre FROM (SELECT pair_id, CAST", 1) + ") WHERE st <> 2")
def band_centres(spark, d):
    return guards.band_centres(T.columns(spark, d))


@query(f"WITH s AS ({SPLIT}) SELECT fam FROM s WHERE split = 'train' UNION SELECT fam FROM s WHERE split = 'val' UNION SELECT fam FROM s WHERE split = 'test'", cte=False)
def split_union(spark, d):
    """All families of the three splits, each once."""
    split = cumulative_split(spark, d)
    parts = [split.where(F.col("split") == name).select("fam") for name in ("train", "val", "test")]
    return relations.all_of(parts)


@query("SELECT DISTINCT user_id AS name FROM events WHERE user_id IN (SELECT o_custkey FROM orders)", cte=False)
def common_names(spark, d):
    """Names that two sources share."""
    return relations.in_common(T.read(spark, d, "events").select(F.col("user_id").alias("name")), T.read(spark, d, "orders").select(F.col("o_custkey").alias("name")))


@query("SELECT node AS name, fam FROM (SELECT node FROM edges WHERE node NOT IN (SELECT parent FROM edges)) JOIN (SELECT 'o' || pair_id AS node, fam FROM pairs WHERE tau > 1) USING (node)")
def tree_and_row_names(spark, d):
    """Leaves of the region tree that an alignment has a row for."""
    from ..operators import trees

    rows = T.pairs(spark, d).where("tau > 1").select(F.concat(F.lit("o"), "pair_id").alias("name"), "fam")
    return trees.leaves(T.edges(spark, d)).withColumnRenamed("node", "name").join(rows, "name")


@query(f"WITH {BINNED} SELECT pos AS site, tau_bin, a, b, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY ALL")
def per_site_counts(spark, d):
    """Residue pairs of each site by time bin."""
    return counts.site_counts(T.columns(spark, d), _binned(spark, d).select("pair_id", "tau_bin"))


@query("SELECT fam, pair_id, CAST(row_number() OVER (PARTITION BY fam ORDER BY md5('9:' || pair_id), pair_id) - 1 AS INT) AS round FROM pairs")
def interleaved_order(spark, d):
    """The round in which each pair's turn comes when every family gives one pair a round."""
    return relations.interleaved(T.pairs(spark, d).select("fam", "pair_id"), "fam", "pair_id", seed=9)


@query("SELECT pair_id, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY h, pair_id) - 1 AS INT) AS place FROM (SELECT pair_id, md5('13:' || pair_id) AS h, CAST('0x' || substr(md5('13:' || pair_id), 1, 8) AS BIGINT) % 16 AS shard FROM pairs)")
def shuffled_shards(spark, d):
    """Pairs dealt to 16 shards and shuffled within each, by hash."""
    return relations.shards(T.pairs(spark, d).select("pair_id"), "pair_id", 16, seed=13)


@query("""WITH m AS (SELECT pair_id FROM columns WHERE st = 1 GROUP BY 1 HAVING count(*) >= 2) SELECT fam, pair_id FROM (SELECT fam, pair_id, row_number() OVER (PARTITION BY fam ORDER BY md5('4:' || pair_id), pair_id) AS r FROM pairs JOIN m USING (pair_id)) WHERE r = 1""")
def random_pair_per_family(spark, d):
    """One pair of each family among those with two match columns or more."""
    sound = guards.matched_pairs(T.columns(spark, d), 2).select("pair_id")
    pairs = T.pairs(spark, d).select("fam", "pair_id").join(sound, "pair_id")
    return relations.first_per_group(pairs, "fam", [relations.draw("pair_id", seed=4), "pair_id"], 1).select("fam", "pair_id")


@query("""WITH p AS (SELECT x.fam, x.pair_id AS name, y.pair_id AS other, abs(x.tau - y.tau) AS d FROM pairs x JOIN pairs y ON x.fam = y.fam AND x.pair_id <> y.pair_id), m AS (SELECT fam, name, avg(d) AS mean_d FROM p GROUP BY 1, 2)
SELECT fam, name, round(mean_d, 11) AS mean_d FROM (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY round(mean_d, 11) DESC, name) AS r FROM m) WHERE r = 1""")
def held_out_leaves(spark, d):
    """The member of each family that is farthest from the others on average."""
    pairs = T.pairs(spark, d).select("fam", "pair_id", "tau")
    other = pairs.select("fam", F.col("pair_id").alias("other"), F.col("tau").alias("t"))
    distances = pairs.join(other, "fam").where(F.col("pair_id") != F.col("other")).select("fam", F.col("pair_id").alias("name"), "other", F.abs(F.col("tau") - F.col("t")).alias("d"))
    return relations.held_out_leaf(distances, 11).withColumn("mean_d", F.round("mean_d", 11))


@query(f"WITH {BINNED}, n AS (SELECT tau_bin, a, b, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY ALL) SELECT * FROM n")
def merged_counts(spark, d):
    """Match counts of three parts of the pairs, counted apart and summed."""
    columns, groups = T.columns(spark, d), _binned(spark, d).select("pair_id", "tau_bin")
    parts = [counts.match_counts(columns, groups.where(F.col("pair_id") % 3 == k), ["tau_bin"]) for k in range(3)]
    return counts.merged(parts, ["tau_bin", "a", "b"])


@query(f"""WITH {BINNED}, n AS (SELECT tau_bin, a, b, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY ALL), prior AS (SELECT x.v AS tau_bin, y.v AS a, z.v AS b, CASE WHEN y.v = z.v THEN 2.0 ELSE 0.5 END AS alpha FROM range(8) x(v), range(20) y(v), range(20) z(v) WHERE (y.v + z.v) % 3 <> 1)
SELECT coalesce(n.tau_bin, p.tau_bin) AS tau_bin, coalesce(n.a, p.a) AS a, coalesce(n.b, p.b) AS b, CAST(coalesce(n, 0) + coalesce(alpha, 0) AS DOUBLE) AS lifted FROM n FULL JOIN prior p ON n.tau_bin = p.tau_bin AND n.a = p.a AND n.b = p.b""")
def lifted_pseudocounts(spark, d):
    """Counts and a prior's pseudocounts, over the keys of either."""
    from .registry import match_counts

    cells = spark.range(8 * 400).select((F.col("id") / 400).cast("int").alias("tau_bin"), ((F.col("id") % 400) / 20).cast("int").alias("a"), (F.col("id") % 20).cast("int").alias("b"))
    prior = cells.where((F.col("a") + F.col("b")) % 3 != 1).withColumn("alpha", F.when(F.col("a") == F.col("b"), 2.0).otherwise(0.5))
    return counts.lifted(match_counts(spark, d), prior, ["tau_bin", "a", "b"])


@query("""WITH n AS (SELECT seq_id, c, count(*) AS n FROM symbols GROUP BY 1, 2), s AS (SELECT seq_id, c, n / sum(n) OVER (PARTITION BY seq_id) AS s FROM n), g AS (SELECT c, sum(n) / (SELECT sum(n) FROM n) AS g FROM n GROUP BY c)
SELECT seq_id, round(sum(pow(coalesce(s, 0) - g, 2)), 9) AS d FROM (SELECT DISTINCT seq_id FROM s), g LEFT JOIN s USING (seq_id, c) GROUP BY seq_id""".replace("(SELECT DISTINCT seq_id FROM s), g LEFT JOIN s USING (seq_id, c)", "(SELECT seq_id, c, g FROM (SELECT DISTINCT seq_id FROM s), g) LEFT JOIN s USING (seq_id, c)"))
def composition_squared_distance(spark, d):
    """Each document's squared distance from the whole corpus's composition."""
    texts = T.read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.lower("text").alias("s"))
    return counts.squared_distance(stored(counts.letter_vectors(texts, 20), "letter_vectors")).withColumn("d", F.round("d", 9))


@query("""WITH p AS (SELECT fam, pair_id % 4 = 0 AS truth, tau > 1.5 AS said FROM pairs WHERE fam % 5 <> 0) SELECT fam, round(coalesce(avg(CAST(truth = said AS DOUBLE)), 0), 9) AS accuracy FROM (SELECT DISTINCT fam FROM pairs) LEFT JOIN p USING (fam) GROUP BY fam""")
def prediction_accuracy(spark, d):
    """Share of right predictions of each family, 0 where it has none."""
    pairs = T.pairs(spark, d)
    said = pairs.where("fam % 5 <> 0").select("fam", (F.col("pair_id") % 4 == 0).alias("truth"), (F.col("tau") > 1.5).alias("said"))
    return metrics.accuracy(pairs.select("fam").distinct(), said, ["fam"]).withColumn("accuracy", F.round("accuracy", 9))


P = "o_totalprice / (o_totalprice + 150000.0)"


@query(f"""WITH r AS (SELECT o_orderpriority, {P} AS p, o_orderstatus = 'F' AS truth FROM orders) SELECT o_orderpriority, round(sum(ln(CASE WHEN p >= 0.5 THEN greatest(p, 1e-30) ELSE greatest(1 - p, 1e-30) END)), 4) AS of_prediction, round(sum(ln(CASE WHEN truth THEN greatest(p, 1e-30) ELSE greatest(1 - p, 1e-30) END)), 4) AS of_truth FROM r GROUP BY 1""", cte=False)
def presence_log_posteriors(spark, d):
    """Log-probability that a 0-1 prediction, and the truth, has under the probabilities it came from."""
    rows = T.read(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / (F.col("o_totalprice") + 150000.0)).alias("p"), (F.col("o_orderstatus") == "F").alias("truth"))
    out = metrics.log_posteriors(rows, ["o_orderpriority"])
    return out.select("o_orderpriority", F.round("of_prediction", 4).alias("of_prediction"), F.round("of_truth", 4).alias("of_truth"))


SIG = """g AS (SELECT pair_id, pos AS col, 'x' AS name, CASE WHEN st <> 2 THEN count(*) FILTER (st <> 2) OVER w END AS p, a % 2 = 0 AS core FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)
  UNION ALL SELECT pair_id, pos, 'y', CASE WHEN st <> 3 THEN count(*) FILTER (st <> 3) OVER w END, b % 2 = 0 FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)),
t AS (SELECT pair_id, CASE WHEN name = 'y' AND col > 2 THEN col + 1 ELSE col END AS col, name, p FROM g),
sg AS (SELECT DISTINCT pair_id, string_agg(name || ':' || p, ',' ORDER BY name) AS sig FROM g WHERE p IS NOT NULL GROUP BY pair_id, col), st AS (SELECT DISTINCT pair_id, string_agg(name || ':' || p, ',' ORDER BY name) AS sig FROM t WHERE p IS NOT NULL GROUP BY pair_id, col)"""


def _residues(spark, d):
    """pair_id, col, name, pos, core: both rows' residues, numbered from 1; those with even codes count as core."""
    c = T.columns(spark, d)
    one = lambda name, gap, code: c.select("pair_id", F.col("pos").alias("col"), F.lit(name).alias("name"), F.when(F.col("st") != gap, F.sum((F.col("st") != gap).cast("long")).over(counts.by_pair())).alias("pos"), (F.col(code) % 2 == 0).alias("core"))
    return one("x", counts.INSERT, "a").unionAll(one("y", counts.DELETE, "b"))


def _shifted(rows):
    """The residues with the second row moved by one from column 3 on."""
    return rows.withColumn("col", F.when((F.col("name") == "y") & (F.col("col") > 2), F.col("col") + 1).otherwise(F.col("col")))


@query(f"WITH {SIG} SELECT sg.pair_id, round(count(st.sig) / count(*), 9) AS tc FROM sg LEFT JOIN st ON st.pair_id = sg.pair_id AND st.sig = sg.sig GROUP BY 1")
def total_column_score(spark, d):
    """Against the alignment whose second row is shifted by one from column 3 on."""
    rows = _residues(spark, d)
    return metrics.total_columns(rows, _shifted(rows), ["pair_id"]).withColumn("tc", F.round("tc", 9))


@query(f"""WITH {SIG}, c AS (SELECT x.pair_id, x.p AS i, y.p AS j FROM g x JOIN g y ON x.pair_id = y.pair_id AND x.col = y.col AND x.name = 'x' AND y.name = 'y' WHERE x.p IS NOT NULL AND y.p IS NOT NULL AND x.core AND y.core),
q AS (SELECT x.pair_id, x.p AS i, y.p AS j FROM t x JOIN t y ON x.pair_id = y.pair_id AND x.col = y.col AND x.name = 'x' AND y.name = 'y' WHERE x.p IS NOT NULL AND y.p IS NOT NULL)
SELECT c.pair_id, count(*) AS pairs, round(count(q.i) / count(*), 9) AS sp, round(count(q.i) / count(*), 9) AS tc FROM c LEFT JOIN q ON q.pair_id = c.pair_id AND q.i = c.i AND q.j = c.j GROUP BY 1""")
def core_scores(spark, d):
    """Sum of pairs and total columns over the reference's core residues only."""
    rows = _residues(spark, d)
    out = metrics.core_scores(rows, _shifted(rows), ["pair_id"])
    return out.select("pair_id", "pairs", F.round("sp", 9).alias("sp"), F.round("tc", 9).alias("tc"))


@query("""WITH t AS (SELECT pair_id, i, j FROM (SELECT pair_id, st, sum(CAST(st <> 2 AS INT)) OVER w - 1 AS i, sum(CAST(st <> 3 AS INT)) OVER w - 1 AS j FROM columns WINDOW w AS (PARTITION BY pair_id ORDER BY pos)) WHERE st = 1)
SELECT pair_id, round(sum(CASE WHEN i >= j THEN 1 / (1 + i) ELSE 0 END), 7) AS score, count(*) AS aligned FROM t GROUP BY 1""")
def annealing_scores(spark, d):
    """Posterior mass of each alignment's own residue pairs; cells outside the sparse posterior count 0."""
    cells = paths.residue_positions(T.columns(spark, d)).where(F.col("st") == counts.MATCH).select("pair_id", "i", "j")
    posterior = cells.where("i >= j").withColumn("p", 1 / (1 + F.col("i")))
    return metrics.posterior_mass(cells, posterior, ["pair_id"]).withColumn("score", F.round("score", 7))


@query("""SELECT model, k, round(loglik, 4) AS loglik, round(2 * k - 2 * loglik, 4) AS aic, round(k * ln((SELECT count(*) FROM orders)) - 2 * loglik, 4) AS bic FROM (
SELECT 'one' AS model, 1 AS k, sum(ln(0.5) - 0.5 * o_totalprice / 100000.0) AS loglik FROM orders UNION ALL SELECT 'two', 2, sum(ln(0.9) - 0.9 * o_totalprice / 100000.0) FROM orders)""", cte=False)
def information_criteria(spark, d):
    """Two exponential models of the orders' times compared by AIC and BIC."""
    tau = F.col("tau")
    sums = T.pairs(spark, d).agg(F.sum(F.log(F.lit(0.5)) - 0.5 * tau).alias("one"), F.sum(F.log(F.lit(0.9)) - 0.9 * tau).alias("two"), F.count("*").alias("n"))
    models = sums.select("n", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"), F.col(m).alias("loglik")) for m, k in (("one", 1), ("two", 2))))).alias("m")).select("n", "m.*")
    out = metrics.information_criteria(models, F.col("n"))
    return out.select("model", "k", *(F.round(c, 4).alias(c) for c in ("loglik", "aic", "bic")))


@query("SELECT o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS pairs, round(sum(o_totalprice / 100000.0), 4) AS tau FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus, strftime(o_orderdate, '%Y-%m')), (strftime(o_orderdate, '%Y-%m')), ())", cte=False)
def grouped_by_sets(spark, d):
    """Pairs and time by several sets of keys at once, months among them; null stands for all."""
    rows = T.read(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit(1).alias("pairs"), (F.col("o_totalprice") / 100000.0).alias("tau"))
    sets = [["o_orderpriority", "o_orderstatus"], ["o_orderstatus", "month"], ["month"], []]
    return metrics.grouped_by_sets(rows, sets, ["pairs", "tau"]).withColumn("tau", F.round("tau", 4))


@query("""SELECT user_id, coalesce(max(n) FILTER (event_type = 'click'), 0) AS clicks, count(*) AS kinds, CAST(sum(k) AS BIGINT) AS k FROM (SELECT user_id, event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1, 2) GROUP BY 1""", cte=False)
def tag_maps(spark, d):
    """A map from tag to count for each user, read by key, and a number out of each JSON record."""
    k = F.get_json_object("props", "$.k").cast("long")
    n = T.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))
    tags = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("tags"), F.sum("k").alias("k"))
    return tags.select("user_id", F.coalesce(F.try_element_at("tags", F.lit("click")), F.lit(0).cast("long")).alias("clicks"), F.size("tags").cast("long").alias("kinds"), "k")


@query("SELECT pair_id, pos, coalesce(list_position(['AU', 'CG', 'GC', 'UA', 'GU', 'UG'], substr('ACGU', a % 4 + 1, 1) || substr('ACGU', b % 4 + 1, 1)) - 1, 6) AS class FROM columns WHERE st = 1")
def base_pair_classes(spark, d):
    """What kind of base pair each match column would be."""
    base = lambda c: F.substring(F.lit("ACGU"), (F.col(c) % 4).cast("int") + 1, 1)
    return T.columns(spark, d).where(F.col("st") == counts.MATCH).select("pair_id", "pos", X.base_pair_class(base("a"), base("b")).alias("class"))


@query("SELECT 'o' || pair_id AS node, 'f' || fam AS parent, 0.1 AS length FROM pairs")
def star_trees(spark, d):
    """One star for each family."""
    from ..operators import trees

    return trees.star(T.pairs(spark, d).select(F.concat(F.lit("f"), "fam").alias("tree"), F.concat(F.lit("o"), "pair_id").alias("node")), 0.1)


@query("SELECT pair_id, fam, CAST(rank AS INT) AS rank FROM (SELECT pair_id, fam, row_number() OVER (PARTITION BY fam ORDER BY tau DESC, pair_id) AS rank FROM pairs) WHERE rank <= 3")
def beam_of_each_family(spark, d):
    """The three best-scored pairs of each family, ranked."""
    return relations.beam(T.pairs(spark, d), "fam", "tau", "pair_id", 3).select("pair_id", "fam", "rank")


@query(f"WITH {BINNED} SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (n < 0) AS BIGINT) AS bad FROM (SELECT tau_bin, a, b, count(*) AS n FROM columns JOIN binned USING (pair_id) WHERE st = 1 GROUP BY ALL)")
def count_sanity(spark, d):
    """How many match counts there are, and how many are no counts."""
    from .registry import match_counts

    found = match_counts(spark, d)
    bad = guards.insane_counts(found, ["tau_bin", "a", "b"]).withColumn("bad", F.lit(1))
    return found.join(bad.drop("n"), ["tau_bin", "a", "b"], "left").agg(F.count("*").alias("cells"), F.count("bad").alias("bad"))
