"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, langid, line_crf, near_dup, one_bit_search, order_minhash, packing, periodic_runs, substring_dedup, suffix_dedup, toxicity, url_filter
from ._spark import table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Host labels whose pages make up the production list of blocked URLs.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all ``documents`` for toxicity, by classifiers learned from the labels of those that aren't held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` linked by a similarity of 0.85 of their sets of five-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.d = doc_id GROUP BY doc_id, n
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the words that 50-word windows of earlier ones cover."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS pos FROM v JOIN f USING (g) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) FILTER (c.pos IS NULL) AS kept, count(c.pos) AS n_removed FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.pos = t.pos GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all ``documents``, by a line labeller learned from the quality labels."""
    return line_crf.line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all ``documents`` by the 49k word vocabulary, and the texts decoded from them."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages on hosts with a label in ``LISTED_LABELS``."""
    host, path = url_filter.host_and_path(F.col("url"))
    return pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select(url_filter.canonical(host, path).alias("canonical")).distinct()


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages``: the literal rules, else a list of blocked URLs."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, listed_urls(pages), RULES)


OP6_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
keyed AS (SELECT *, host || regexp_replace(path, '/+$', '') AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM keyed WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
ruled AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    canonical IN (SELECT canonical FROM listed) AS listed FROM keyed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM ruled
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the bytes that 200-byte strings occurring twice cover."""
    return suffix_dedup.remove_substrings(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, x, unnest(range(greatest(length(x) // 2 - 199, 0))) AS i FROM h)),
hit AS (SELECT doc_id, i FROM v WHERE g IN (SELECT g FROM v GROUP BY g HAVING count(*) > 1)),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o) GROUP BY doc_id, k),
z AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM s),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)) || CASE WHEN last THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM z JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, by profiles of those that aren't held out."""
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``' tokens packed into sequences of at most 2,048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts, and how alike they are."""
    return order_minhash.edit_fingerprints(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text of ``documents``, a tenth of them made periodic first as the hash of their ids says."""
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), rewrite=F.crc32(F.col("doc_id").cast("string")))


def op12_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` for each row whose id is divisible by 20."""
    return one_bit_search.nearest(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
w AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0 AND isfinite(list_inner_product(e, e))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of 2 to 5 words that occur 100 times in ``documents``."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
f AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size)) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
k AS (SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1 :], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = b.lang AND g.size > b.size AND 100 * g.f >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
SELECT * FROM r WHERE rank <= 2000
"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_duplicates, op3_substring_dedup, op4_line_quality, op5_bpe, op6_url_filter, op7_suffix_dedup, op8_language_id, op9_best_fit_packing, op10_order_minhash, op11_periodic_runs, op12_one_bit_search, op13_collocations)}
ORACLE_SQL = {"op2_near_duplicates": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op6_url_filter": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op12_one_bit_search": OP12_SQL, "op13_collocations": OP13_SQL}
