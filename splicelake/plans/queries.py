"""The operators on the driver's tables: a gene family is a nation, a gene a
customer, a transcript an order, its segments the brands of its lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import alignment, components, exons, intervals, ordered, paths, relational, similarity, trees, users
from ..sources import sinks, tables
from ..storage import few_bytes, materialize, shared_folder
from . import families

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, gene, trx, node, rk), each node once in a path, where it comes first."""
    lines = load(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    # written, as the columns that order lines take several times the disk of their ranks while they are dealt out
    x = materialize(lines.select("l_orderkey", "l_partkey", rank.alias("rk0")), "ranks")
    x = x.join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), x.l_partkey == F.col("p_partkey"))
    x = x.select("l_orderkey", "p_brand", "rk0").repartition("l_orderkey").groupBy("l_orderkey", "p_brand").agg(F.min("rk0").cast("long").alias("rk"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    owner = o.join(c, o.o_custkey == c.c_custkey)
    return (
        x.join(owner, x.l_orderkey == owner.o_orderkey)
        .select(F.col("c_nationkey").alias("family"), F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("trx"), F.col("p_brand").alias("node"), "rk")
    )


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a written table: graph and path operators read them several times, the joins run once."""
    return materialize(segments(spark, sf_dir), "segments")


_SEG = """
li AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS rk0 FROM lineitem),
seg AS (SELECT c_nationkey AS family, o_custkey AS gene, o_orderkey AS trx, p_brand AS node, min(rk0) AS rk
        FROM li JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2, 3, 4),
tot AS (SELECT family, count(DISTINCT gene) AS ng, count(DISTINCT trx) AS nt FROM seg GROUP BY 1),
gt AS (SELECT family, gene, count(DISTINCT trx) AS n FROM seg GROUP BY 1, 2),
st AS (SELECT family, gene, trx, coalesce(lag(node) OVER (PARTITION BY trx ORDER BY rk), 'start') AS src, node AS dst FROM seg
       UNION ALL
       SELECT family, gene, trx, arg_max(node, rk), 'stop' FROM seg GROUP BY 1, 2, 3),
pg AS (SELECT family, src, dst, gene, count(*) AS k, count(DISTINCT trx) AS t FROM st GROUP BY 1, 2, 3, 4),
ed AS (SELECT pg.family, src, dst, count(*) AS n_genes, CAST(sum(t) AS BIGINT) AS n_trx,
              1e2 * count(*) / max(ng) AS conservation, 1e2 * sum(t) / max(nt) AS transcript_fraction,
              CAST(sum((k * 1000000000000) // n) AS DOUBLE) / 1e12 / max(ng) AS weighted_conservation
       FROM pg JOIN gt USING (family, gene) JOIN tot ON tot.family = pg.family GROUP BY 1, 2, 3),
pa AS (SELECT family, gene, trx, 'start/' || string_agg(node, '/' ORDER BY rk) || '/stop' AS path FROM seg GROUP BY 1, 2, 3),
sc AS (SELECT st.family, gene, trx,
              min(conservation) AS min_conservation, sum(conservation) AS sum_conservation, avg(conservation) AS mean_conservation,
              min(transcript_fraction) AS min_transcript_fraction, sum(transcript_fraction) AS sum_transcript_fraction, avg(transcript_fraction) AS mean_transcript_fraction,
              min(weighted_conservation) AS min_weighted_conservation, sum(weighted_conservation) AS sum_weighted_conservation, avg(weighted_conservation) AS mean_weighted_conservation
       FROM st JOIN ed USING (family, src, dst) GROUP BY 1, 2, 3),
ps AS (SELECT family, path, count(DISTINCT gene) AS path_genes FROM pa GROUP BY 1, 2),
tb AS (SELECT * FROM pa JOIN sc USING (family, gene, trx) JOIN ps USING (family, path)),
ca AS (SELECT * FROM tb QUALIFY row_number() OVER (PARTITION BY family ORDER BY round(min_conservation, 9) DESC, round(min_weighted_conservation, 9) DESC,
         path_genes DESC, round(sum_weighted_conservation, 9) DESC, path DESC, trx) = 1)"""

_EVENTS = _SEG + """,
wk AS (SELECT family, path, unnest(string_split(path, '/')) AS node, generate_subscripts(string_split(path, '/'), 1) - 1 AS pi FROM (SELECT DISTINCT family, path FROM pa)),
ck AS (SELECT family, path AS canon, unnest(string_split(path, '/')) AS node, generate_subscripts(string_split(path, '/'), 1) - 1 AS ci FROM ca),
xx AS (SELECT wk.family, path, canon, pi, ci, max(ci) OVER (PARTITION BY wk.family, path ORDER BY pi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
       FROM wk JOIN ck ON wk.family = ck.family AND wk.node = ck.node),
an AS (SELECT *, lag(pi) OVER w AS ppi, lag(ci) OVER w AS pci FROM xx WHERE ci > coalesce(reach, -1) WINDOW w AS (PARTITION BY family, path ORDER BY pi)),
ev AS (SELECT DISTINCT family, array_to_string(list_slice(string_split(canon, '/'), pci + 1, ci + 1), '/') AS canonical_path,
              array_to_string(list_slice(string_split(path, '/'), ppi + 1, pi + 1), '/') AS alternative_path
       FROM an WHERE ppi IS NOT NULL AND (pi <> ppi + 1 OR ci <> pci + 1)),
al AS (SELECT DISTINCT family, alternative_path FROM ev),
su AS (SELECT al.family, alternative_path, count(DISTINCT gene) AS n_genes, count(DISTINCT trx) AS n_trx
       FROM al JOIN pa ON al.family = pa.family AND contains('/' || path || '/', '/' || alternative_path || '/') GROUP BY 1, 2),
se AS (SELECT ev.family, canonical_path, alternative_path, n_genes, n_trx,
         CASE WHEN len(string_split(canonical_path, '/')) = 2 THEN 'insertion' WHEN len(string_split(alternative_path, '/')) = 2 THEN 'deletion'
              WHEN starts_with(canonical_path, 'start/') AND ends_with(canonical_path, '/stop') THEN 'fully_alternative'
              WHEN starts_with(canonical_path, 'start/') THEN 'alternative_start' WHEN ends_with(canonical_path, '/stop') THEN 'alternative_end' ELSE 'alternative' END AS ase
       FROM ev JOIN su USING (family, alternative_path) WHERE n_trx >= 2)"""


def _r(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {_SEG} SELECT family, src, dst, n_genes, n_trx, round(conservation, 6) AS conservation, round(transcript_fraction, 6) AS transcript_fraction, round(weighted_conservation, 6) AS weighted_conservation FROM ed")
def splice_graph_edges(spark, sf_dir):
    return paths.edges(stored_segments(spark, sf_dir)).select("family", "src", "dst", "n_genes", "n_trx", *_r("conservation", "transcript_fraction", "weighted_conservation"))


@query(f"""WITH {_SEG} SELECT family, node, n_genes, n_trx, round(1e2 * n_genes / ng, 6) AS conservation, round(1e2 * n_trx / nt, 6) AS transcript_fraction
FROM (SELECT family, node, count(DISTINCT gene) AS n_genes, count(DISTINCT trx) AS n_trx FROM seg GROUP BY 1, 2) JOIN tot USING (family)""")
def splice_graph_nodes(spark, sf_dir):
    return paths.nodes(stored_segments(spark, sf_dir)).select("family", "node", "n_genes", "n_trx", *_r("conservation", "transcript_fraction"))


_PATH_COLUMNS = [f"{a}_{m}" for m in paths.METRICS for a in ("min", "sum", "mean")]


@query(f"WITH {_SEG} SELECT family, gene, trx, path, path_genes, {', '.join(f'round({c}, 6) AS {c}' for c in _PATH_COLUMNS)} FROM tb")
def path_table(spark, sf_dir):
    return paths.scores(stored_segments(spark, sf_dir)).select("family", "gene", "trx", "path", "path_genes", *_r(*_PATH_COLUMNS))


@query(f"WITH {_SEG} SELECT family, gene, trx, path, path_genes FROM ca")
def canonical_path(spark, sf_dir):
    return paths.canonical(paths.scores(stored_segments(spark, sf_dir))).select("family", "gene", "trx", "path", "path_genes")


@query(f"WITH {_EVENTS} SELECT * FROM ev")
def ase_events(spark, sf_dir):
    s = stored_segments(spark, sf_dir)
    return paths.events(paths.path_strings(s), paths.canonical(paths.scores(s)).select("family", "path"))


@query(f"WITH {_EVENTS} SELECT family, canonical_path, alternative_path, ase, n_genes, n_trx FROM se")
def ase_types(spark, sf_dir):
    return paths.supported_events(stored_segments(spark, sf_dir)).select("family", "canonical_path", "alternative_path", "ase", "n_genes", "n_trx")


@query(f"WITH {_EVENTS} SELECT family, alternative_path, n_genes, n_trx FROM su")
def ase_support(spark, sf_dir):
    s = stored_segments(spark, sf_dir)
    p = materialize(paths.path_strings(s), "paths")
    return paths.support(p, materialize(paths.events(p, paths.canonical(paths.scores(s)).select("family", "path")), "found_events"), "alternative_path")


@query(f"""WITH {_EVENTS},
tp AS (SELECT family, canonical_path, alternative_path, unnest(list_slice(string_split(alternative_path, '/'), 2, -2)) AS a, list_slice(string_split(canonical_path, '/'), 2, -2) AS cs FROM se WHERE ase NOT IN ('insertion', 'deletion')),
tq AS (SELECT family, canonical_path, alternative_path, a, unnest(cs) AS c FROM tp),
pr AS (SELECT DISTINCT family, a, c FROM tq),
jd AS (SELECT pr.family, pr.a, pr.c, count(DISTINCT s2.trx) < 2 AS exclusive FROM pr
       JOIN seg s1 ON s1.family = pr.family AND s1.node = pr.a LEFT JOIN seg s2 ON s2.family = pr.family AND s2.node = pr.c AND s2.trx = s1.trx GROUP BY 1, 2, 3),
vd AS (SELECT tq.family, canonical_path, alternative_path, bool_and(exclusive) AS all_ex, bool_or(exclusive) AS any_ex
       FROM tq JOIN jd ON tq.family = jd.family AND tq.a = jd.a AND tq.c = jd.c GROUP BY 1, 2, 3)
SELECT se.family, se.canonical_path, se.alternative_path, ase, CASE WHEN all_ex THEN 'mutually_exclusive' WHEN any_ex THEN 'partially_mutually_exclusive' ELSE '' END AS mutual_exclusivity
FROM se LEFT JOIN vd ON se.family = vd.family AND se.canonical_path = vd.canonical_path AND se.alternative_path = vd.alternative_path""")
def mutual_exclusivity(spark, sf_dir):
    s = stored_segments(spark, sf_dir)
    return paths.mutual_exclusivity(materialize(paths.supported_events(s), "events"), materialize(paths.path_strings(s), "paths")).select("family", "canonical_path", "alternative_path", "ase", "mutual_exclusivity")


@query(f"""WITH {_EVENTS},
hg AS (SELECT DISTINCT x.family, x.sub, gene FROM (SELECT family, canonical_path AS sub FROM se UNION SELECT family, alternative_path FROM se) x
       JOIN pa ON x.family = pa.family AND contains('/' || path || '/', '/' || sub || '/'))
SELECT se.family, canonical_path, alternative_path, ase, (SELECT count(*) FROM hg WHERE hg.family = se.family AND hg.sub = se.canonical_path) AS n_canonical,
(SELECT count(*) FROM hg WHERE hg.family = se.family AND hg.sub = se.alternative_path) AS n_alternative,
(SELECT count(*) FROM hg a JOIN hg b ON a.gene = b.gene AND a.family = b.family WHERE a.family = se.family AND a.sub = se.canonical_path AND b.sub = se.alternative_path) AS n_common FROM se""")
def ase_table(spark, sf_dir):
    s = stored_segments(spark, sf_dir)
    found = paths.event_genes(materialize(paths.supported_events(s), "events"), materialize(paths.path_strings(s), "paths"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.select("family", "canonical_path", "alternative_path", "ase", size("canonical_genes").alias("n_canonical"), size("alternative_genes").alias("n_alternative"), size("common_genes").alias("n_common"))


_EXCLUSIVE = """
tp AS (SELECT family, canonical_path, alternative_path, list_slice(string_split(canonical_path, '/'), 2, -2) AS cs,
              unnest(list_slice(string_split(alternative_path, '/'), 2, -2)) AS a, generate_subscripts(list_slice(string_split(alternative_path, '/'), 2, -2), 1) AS ai FROM se WHERE ase NOT IN ('insertion', 'deletion')),
tq AS (SELECT family, canonical_path, alternative_path, a, ai, unnest(cs) AS c, generate_subscripts(cs, 1) AS ci FROM tp),
jd AS (SELECT pr.family, pr.a, pr.c, count(DISTINCT s2.trx) < 2 AS exclusive FROM (SELECT DISTINCT family, a, c FROM tq) pr
       JOIN seg s1 ON s1.family = pr.family AND s1.node = pr.a LEFT JOIN seg s2 ON s2.family = pr.family AND s2.node = pr.c AND s2.trx = s1.trx GROUP BY 1, 2, 3),
xp AS (SELECT tq.family, canonical_path, alternative_path, string_agg(tq.c, '/' ORDER BY ai, ci) AS exclusive_canonical, string_agg(tq.a, '/' ORDER BY ai, ci) AS exclusive_alternative
       FROM tq JOIN jd ON tq.family = jd.family AND tq.a = jd.a AND tq.c = jd.c WHERE exclusive GROUP BY 1, 2, 3)"""


@query(f"""WITH {_EVENTS}, {_EXCLUSIVE}
SELECT se.family, se.canonical_path, se.alternative_path, coalesce(exclusive_canonical, '') AS exclusive_canonical, coalesce(exclusive_alternative, '') AS exclusive_alternative
FROM se LEFT JOIN xp ON se.family = xp.family AND se.canonical_path = xp.canonical_path AND se.alternative_path = xp.alternative_path""")
def exclusive_pairs(spark, sf_dir):
    s = stored_segments(spark, sf_dir)
    found = paths.mutual_exclusivity(materialize(paths.supported_events(s), "events"), materialize(paths.path_strings(s), "paths"))
    return found.select("family", "canonical_path", "alternative_path", "exclusive_canonical", "exclusive_alternative")


def _residues(s: DataFrame) -> DataFrame:
    """A made-up aligned row for each gene and node of segments, of one length for a node."""
    text = F.translate(F.md5(F.concat_ws("-", F.col("gene").cast("string"), "node")), "0123456789abcdef", "ACDEFGHKLMNPR---")
    width = (F.ascii(F.right("node", F.lit(1))) % 5 + 4).cast("int")
    return s.select("family", "gene", "node").distinct().withColumn("aligned", F.left(text, width))


_SIDES = _EVENTS + """,
hd AS (SELECT x.family, x.sub, gene, count(DISTINCT trx) AS t FROM (SELECT family, canonical_path AS sub FROM se UNION SELECT family, alternative_path FROM se) x
       JOIN pa ON x.family = pa.family AND contains('/' || path || '/', '/' || sub || '/') GROUP BY 1, 2, 3),
wc AS (SELECT hd.family, sub, count(*) AS n_genes, CAST(sum(t) AS BIGINT) AS n_trx, CAST(sum((t * 1000000000000) // n) AS DOUBLE) / 1e12 / max(ng) AS weighted_conservation
       FROM hd JOIN gt USING (family, gene) JOIN tot ON tot.family = hd.family GROUP BY 1, 2)"""

_RESIDUES = """
rs AS (SELECT DISTINCT family, gene, node, left(translate(md5(gene || '-' || node), '0123456789abcdef', 'ACDEFGHKLMNPR---'), ascii(right(node, 1)) % 5 + 4) AS aligned FROM seg),
nd AS (SELECT family, sub, gene, unnest(list_slice(string_split(sub, '/'), 2, -2)) AS node, generate_subscripts(list_slice(string_split(sub, '/'), 2, -2), 1) AS pos FROM hd),
ir AS (SELECT nd.family, sub, pos, nd.gene, aligned FROM nd JOIN rs ON rs.family = nd.family AND rs.gene = nd.gene AND rs.node = nd.node),
gl AS (SELECT hd.family, hd.sub, hd.gene, coalesce(sum(len(replace(aligned, '-', ''))), 0) AS n FROM hd LEFT JOIN ir ON ir.family = hd.family AND ir.sub = hd.sub AND ir.gene = hd.gene GROUP BY 1, 2, 3),
ln AS (SELECT family, sub, CAST(min(n) AS BIGINT) AS min_length, avg(n) AS mean_length, CAST(max(n) AS BIGINT) AS max_length FROM gl GROUP BY 1, 2),
lt AS (SELECT family, sub, pos, c, r, count(*) AS n FROM (SELECT family, sub, pos, unnest(string_split(aligned, '')) AS r, generate_subscripts(string_split(aligned, ''), 1) AS c FROM ir) GROUP BY 1, 2, 3, 4, 5),
tl AS (SELECT family, sub, pos, c, sum(n) AS all_rows, coalesce(max(n) FILTER (r = '-'), 0) AS gaps, sum(n) FILTER (r <> '-') AS total, max(n) FILTER (r <> '-') AS top FROM lt GROUP BY 1, 2, 3, 4),
sg AS (SELECT tl.family, tl.sub, tl.pos, tl.c, any_value(gaps > top AND 2 * gaps >= all_rows) AS low,
              CASE WHEN count(*) FILTER (n = top) = 1 AND 2 * any_value(top) >= any_value(total) THEN max(r) FILTER (n = top) ELSE 'X' END AS sign
       FROM tl JOIN lt ON lt.family = tl.family AND lt.sub = tl.sub AND lt.pos = tl.pos AND lt.c = tl.c WHERE total IS NOT NULL AND r <> '-' GROUP BY 1, 2, 3, 4),
cs AS (SELECT family, sub, string_agg(CASE WHEN low THEN lower(sign) ELSE sign END, '' ORDER BY pos, c) AS consensus FROM sg GROUP BY 1, 2)"""


@query(f"WITH {_SIDES} SELECT family, sub, n_genes, n_trx, round(weighted_conservation, 6) AS weighted_conservation FROM wc")
def subpath_conservation(spark, sf_dir):
    s = stored_segments(spark, sf_dir)
    held = paths.subpath_genes(materialize(paths.path_strings(s), "paths"), paths.subpaths(materialize(paths.supported_events(s), "events")), "sub")
    return held.select("family", "sub", F.size("genes").cast("long").alias("n_genes"), "n_trx", *_r("weighted_conservation"))


@query(f"""WITH {_SIDES}, {_EXCLUSIVE}, {_RESIDUES},
fa AS (SELECT wc.family, wc.sub, wc.n_genes, weighted_conservation, min_length, mean_length, max_length, coalesce(consensus, '') AS consensus
       FROM wc JOIN ln ON ln.family = wc.family AND ln.sub = wc.sub LEFT JOIN cs ON cs.family = wc.family AND cs.sub = wc.sub)
SELECT se.family, se.canonical_path, se.alternative_path, ase, coalesce(exclusive_canonical, '') AS exclusive_canonical, coalesce(exclusive_alternative, '') AS exclusive_alternative,
{', '.join(f"{x}.n_genes AS {n}_n_genes, round({x}.weighted_conservation, 6) AS {n}_weighted_conservation, {x}.min_length AS {n}_min_length, round({x}.mean_length, 6) AS {n}_mean_length, {x}.max_length AS {n}_max_length, {x}.consensus AS {n}_consensus" for x, n in (("fc", "canonical"), ("fd", "alternative")))}
FROM se JOIN fa fc ON fc.family = se.family AND fc.sub = se.canonical_path JOIN fa fd ON fd.family = se.family AND fd.sub = se.alternative_path
LEFT JOIN xp ON se.family = xp.family AND se.canonical_path = xp.canonical_path AND se.alternative_path = xp.alternative_path""")
def event_report(spark, sf_dir):
    s = stored_segments(spark, sf_dir)
    found = paths.event_report(materialize(paths.supported_events(s), "events"), materialize(paths.path_strings(s), "paths"), materialize(_residues(s), "residues"))
    sides = [c for n in ("canonical", "alternative") for c in (
        F.size(f"{n}_genes").cast("long").alias(f"{n}_n_genes"), *_r(f"{n}_weighted_conservation"), f"{n}_min_length", *_r(f"{n}_mean_length"), f"{n}_max_length", f"{n}_consensus")]
    return found.select("family", "canonical_path", "alternative_path", "ase", "exclusive_canonical", "exclusive_alternative", *sides)


# intervals: parts of a supplier's lines as closed intervals


def _spans(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    return x.select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi"), F.col("l_orderkey").alias("id"))


_DIS = """sp AS (SELECT l_suppkey AS gene, l_partkey AS lo, l_partkey + CAST(l_quantity AS BIGINT) AS hi, l_orderkey AS id FROM lineitem),
bd AS (SELECT gene, lo AS b FROM sp UNION SELECT gene, hi + 1 FROM sp),
gr AS (SELECT gene, b AS lo, lead(b) OVER (PARTITION BY gene ORDER BY b) - 1 AS hi FROM bd),
dj AS (SELECT gr.gene, gr.lo, gr.hi, count(sp.id) AS n_cover FROM gr LEFT JOIN sp ON sp.gene = gr.gene AND sp.lo <= gr.lo AND sp.hi >= gr.hi WHERE gr.hi IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"WITH {_DIS} SELECT * FROM dj")
def disjoint_intervals(spark, sf_dir):
    return intervals.disjoint(_spans(spark, sf_dir), ["gene"], "lo", "hi")


@query(f"WITH {_DIS} SELECT gene, lo, hi, n_cover, row_number() OVER (PARTITION BY gene ORDER BY lo) - 1 AS interval_number FROM dj WHERE n_cover > 0")
def interval_numbers(spark, sf_dir):
    return intervals.numbered(intervals.disjoint(_spans(spark, sf_dir), ["gene"], "lo", "hi"), ["gene"])


@query(f"WITH {_DIS} SELECT DISTINCT dj.gene, dj.lo, dj.hi, sp.id FROM dj JOIN sp ON sp.gene = dj.gene AND sp.lo <= dj.lo AND sp.hi >= dj.hi")
def interval_members(spark, sf_dir):
    return intervals.members(_spans(spark, sf_dir), ["gene"], "lo", "hi", "id", 64).distinct()


@query(f"""WITH {_DIS}, mk AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY gene ORDER BY lo) + 1 = lo THEN 0 ELSE 1 END AS n FROM dj WHERE n_cover > 0),
rn AS (SELECT *, sum(n) OVER (PARTITION BY gene ORDER BY lo) AS r FROM mk) SELECT gene, min(lo) AS lo, max(hi) AS hi FROM rn GROUP BY gene, r""")
def merged_intervals(spark, sf_dir):
    return intervals.merged(_spans(spark, sf_dir), ["gene"], "lo", "hi")


@query("""SELECT l_suppkey AS gene, l_orderkey AS trx, l_partkey AS start, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS strand,
row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_partkey * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END, l_linenumber, l_shipdate, l_extendedprice) - 1 AS subexon_rank FROM lineitem""")
def subexon_rank(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_orderkey").alias("trx"), F.col("l_partkey").alias("start"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"), "l_linenumber", "l_shipdate", "l_extendedprice")
    return ordered.ranks(x, ["gene", "trx"], [F.col("start") * F.col("strand"), "l_linenumber", "l_shipdate", "l_extendedprice"], "subexon_rank").select("gene", "trx", "start", "strand", "subexon_rank")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS gene, l_partkey AS place FROM lineitem),
m AS (SELECT *, CASE WHEN lag(place) OVER (PARTITION BY gene ORDER BY place) + 1 = place THEN 0 ELSE 1 END AS n FROM p),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY gene ORDER BY place) AS BIGINT) AS island FROM m)
SELECT gene, island, min(place) AS lo, max(place) AS hi, count(*) AS n FROM r GROUP BY 1, 2""")
def contiguous_islands(spark, sf_dir):
    p = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("at")).distinct()
    return ordered.contiguous(p, ["gene"], "at", "at", ["at"]).groupBy("gene", "island").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS n FROM events),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM m)
SELECT user_id, island, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def merge_equal_runs(spark, sf_dir):
    return ordered.equal_runs(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


# phases and sequences


def _exons(spark, sf_dir):
    """Exons of a transcript: lines of an order, ranked, with a length and a DNA word."""
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    x = ordered.ranks(x, ["l_orderkey"], list(LINE_ORDER), "rk")
    seq = F.left(S.dna(F.col("l_partkey").cast("string")), (F.pmod(F.col("l_quantity").cast("int"), F.lit(29)) + 1))
    return x.select(F.col("l_orderkey").alias("trx"), "rk", F.col("l_quantity").cast("long").alias("length"), seq.alias("seq"))


_EX = """ex AS (SELECT l_orderkey AS trx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS rk,
CAST(l_quantity AS BIGINT) AS length, left(translate(md5(CAST(l_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), CAST(l_quantity AS INT) % 29 + 1) AS seq FROM lineitem)"""
_PH = _EX + """,
ph AS (SELECT *, CAST(sum(length) OVER (PARTITION BY trx ORDER BY rk) % 3 AS BIGINT) AS end_phase FROM ex),
pp AS (SELECT *, coalesce(lag(end_phase) OVER (PARTITION BY trx ORDER BY rk), 0) AS start_phase FROM ph)"""


@query(f"WITH {_PH} SELECT trx, rk, length, start_phase, end_phase FROM pp")
def phase_propagation(spark, sf_dir):
    return ordered.with_phases(_exons(spark, sf_dir), ["trx"], ["rk"], "length").select("trx", "rk", "length", "start_phase", "end_phase")


@query("""WITH d AS (SELECT l_orderkey AS trx, l_partkey % 4 - 1 AS sp, l_suppkey % 4 - 1 AS ep, l_linenumber AS rank,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS rk FROM lineitem),
w AS (SELECT *, lag(ep) OVER x AS be, lag(rank) OVER x AS br, lead(ep) OVER x IS NULL AS is_last FROM d WINDOW x AS (PARTITION BY trx ORDER BY rk))
SELECT trx, rk, coalesce((be IS NOT NULL AND (be = -1 OR (sp <> be AND sp <> -1) OR sp = -1)) OR (be IS NOT NULL AND rank <= br) OR (NOT is_last AND ep = -1), false) AS incomplete FROM w""")
def phase_check(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    x = ordered.ranks(x, ["l_orderkey"], list(LINE_ORDER), "rk").select(F.col("l_orderkey").alias("trx"), "rk", (F.col("l_partkey") % 4 - 1).alias("sp"), (F.col("l_suppkey") % 4 - 1).alias("ep"), F.col("l_linenumber").alias("rank"))
    return ordered.check_phases(x, ["trx"], ["rk"], "sp", "ep", "rank").select("trx", "rk", "incomplete")


@query(f"WITH {_EX} SELECT trx, rk, rk = 0 AS is_first, lead(1) OVER (PARTITION BY trx ORDER BY rk) IS NULL AS is_last FROM ex")
def first_last_exon(spark, sf_dir):
    return ordered.first_last(_exons(spark, sf_dir), ["trx"], ["rk"]).select("trx", "rk", "is_first", "is_last")


@query(f"""WITH {_PH} SELECT trx, rk, right(coalesce(string_agg(seq, '') OVER (PARTITION BY trx ORDER BY rk ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ''), CAST(start_phase AS INT)) AS borrowed FROM pp WHERE true""")
def borrow_bases(spark, sf_dir):
    x = ordered.with_phases(_exons(spark, sf_dir), ["trx"], ["rk"], "length")
    return x.withColumn("borrowed", ordered.borrow_before(["trx"], ["rk"], "seq", F.col("start_phase").cast("int"), 2)).select("trx", "rk", "borrowed")


@query(f"""WITH {_EX} SELECT trx, rk, last_value(total) OVER (PARTITION BY trx ORDER BY rk) - length + 1 AS start, total AS end FROM (SELECT *, CAST(sum(length) OVER (PARTITION BY trx ORDER BY rk) AS BIGINT) AS total FROM ex)""")
def cdna_offsets(spark, sf_dir):
    return ordered.running_span(_exons(spark, sf_dir), ["trx"], ["rk"], "length").select("trx", "rk", "start", "end")


_CODONS = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in S.CODONS.items()) + "}"


@query(f"""WITH d AS (SELECT p_partkey, left(translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 30) || CASE WHEN p_size % 5 = 0 THEN 'NNN' ELSE '' END AS seq FROM part)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(seq, '.{{3}}'), lambda c: coalesce({_CODONS}[c], 'X')), '') AS protein FROM d""")
def codon_translate(spark, sf_dir):
    x = load(spark, sf_dir, "part")
    seq = F.concat(F.left(S.dna(F.col("p_name")), F.lit(30)), F.when(F.col("p_size") % 5 == 0, "NNN").otherwise(""))
    return x.select("p_partkey", S.translate_codons(seq).alias("protein"))


@query(f"""WITH {_EX}, f AS (SELECT *, rk = 0 AS is_first, lead(1) OVER (PARTITION BY trx ORDER BY rk) IS NULL AS is_last, len(seq) // 2 + length % 2 AS cds FROM ex)
SELECT trx, rk, CASE WHEN len(seq) = cds THEN seq WHEN is_first THEN right(seq, CAST(cds AS INT)) WHEN is_last THEN left(seq, CAST(cds AS INT)) END AS cds_seq FROM f""")
def cds_slice(spark, sf_dir):
    x = ordered.first_last(_exons(spark, sf_dir), ["trx"], ["rk"])
    cds = (F.floor(F.length("seq") / 2) + F.col("length") % 2).cast("int")
    return x.select("trx", "rk", S.cut_cds(F.col("seq"), cds, F.col("is_first"), F.col("is_last")).alias("cds_seq"))


def _aligned(spark, sf_dir):
    """Pairs of rows of an alignment: a part's word against the word of its brand and type, gaps where they have an A."""
    x = load(spark, sf_dir, "part")
    gap = lambda c: F.translate(S.dna(c), "A", "-")
    return x.select("p_partkey", gap(F.col("p_name")).alias("a"), gap(F.concat("p_brand", "p_type")).alias("b"))


_AL = """al AS (SELECT p_partkey, translate(md5(p_name), '0123456789abcdef', '-CGT-CGT-CGT-CGT') AS a, translate(md5(p_brand || p_type), '0123456789abcdef', '-CGT-CGT-CGT-CGT') AS b FROM part),
pos AS (SELECT p_partkey, unnest(string_split(a, '')) AS x, unnest(string_split(b, '')) AS y FROM al)"""


@query(f"""WITH {_AL} SELECT p_partkey, round(1e2 * count(*) FILTER (x = y AND NOT (x = '-' AND y = '-')) / nullif(count(*) FILTER (NOT (x = '-' AND y = '-')), 0), 6) AS identity,
round(1e2 * count(*) FILTER (x = y AND x <> '-') / nullif(count(*) FILTER (x <> '-' AND y <> '-'), 0), 6) AS identity_without_gaps FROM pos GROUP BY 1""")
def percent_identity(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _aligned(spark, sf_dir).select("p_partkey", F.round(S.percent_identity(a, b), 6).alias("identity"), F.round(S.percent_identity_without_gaps(a, b), 6).alias("identity_without_gaps"))


@query(f"""WITH {_AL} SELECT p_partkey, round(1e2 * len(replace(a, '-', '')) / len(a), 6) AS coverage, round(1e2 * least(len(replace(a, '-', '')), len(replace(b, '-', ''))) / len(a), 6) AS coverage_shortest FROM al""")
def coverage(spark, sf_dir):
    return _aligned(spark, sf_dir).select("p_partkey", F.round(S.coverage(F.col("a")), 6).alias("coverage"), F.round(S.coverage_shortest(F.col("a"), F.col("b")), 6).alias("coverage_shortest"))


@query(f"""WITH {_AL}, la AS (SELECT p_partkey, x AS c, count(*) AS n FROM pos GROUP BY 1, 2), lb AS (SELECT p_partkey, y AS c, count(*) AS n FROM pos GROUP BY 1, 2)
SELECT al.p_partkey, round(1e2 * coalesce(sum(least(la.n, lb.n)), 0) / 32, 6) AS bound FROM al LEFT JOIN la ON la.p_partkey = al.p_partkey LEFT JOIN lb ON lb.p_partkey = al.p_partkey AND lb.c = la.c GROUP BY al.p_partkey""")
def max_identity_bound(spark, sf_dir):
    return _aligned(spark, sf_dir).select("p_partkey", F.round(S.max_identity(F.col("a"), F.col("b")), 6).alias("bound"))


# exons to proteins: an order is a transcript of its customer, its lines are exons


def _coding_exons(spark, sf_dir):
    """Exons with declared phases; parts of some sizes have none, as at untranslated ends."""
    x = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    x = ordered.ranks(x, ["l_orderkey"], list(LINE_ORDER), "ExonRank").select(F.col("o_custkey").alias("GeneID"), F.col("l_orderkey").alias("TranscriptID"), F.col("l_partkey").cast("string").alias("part"), "l_linenumber", "ExonRank", F.col("l_quantity").cast("long").alias("n"))
    x = x.withColumn("seq", F.left(S.dna(F.col("part")), (F.col("n") % 29 + 1).cast("int"))).withColumn("n", F.length("seq").cast("long"))
    x = ordered.with_phases(x, ["TranscriptID"], ["ExonRank"], "n").withColumnsRenamed({"start_phase": "StartPhase", "end_phase": "EndPhase"})
    start = F.col("part").cast("long") * 100
    unknown = F.col("part").cast("long") % 7 == 0
    return x.select("GeneID", "TranscriptID", F.concat("part", F.lit("_"), F.col("l_linenumber").cast("string")).alias("ExonID"), F.lit(1).alias("Strand"), "ExonRank", start.alias("ExonRegionStart"), (start + F.col("n") - 1).alias("ExonRegionEnd"),
                    F.lit(1).cast("long").alias("cDNA_CodingStart"), F.col("n").alias("cDNA_CodingEnd"), start.alias("GenomicCodingStart"), (start + F.col("n") - 1).alias("GenomicCodingEnd"),
                    F.when(unknown, F.lit(-1)).otherwise(F.col("StartPhase")).cast("long").alias("StartPhase"), F.when(unknown, F.lit(-1)).otherwise(F.col("EndPhase")).cast("long").alias("EndPhase"), "seq")


_CODING = f"""ln AS (SELECT o_custkey AS gene, l_orderkey AS trx, l_partkey AS part, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS rk,
left(translate(md5(CAST(l_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), CAST(l_quantity AS INT) % 29 + 1) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pz AS (SELECT *, CAST(sum(len(seq)) OVER (PARTITION BY trx ORDER BY rk) % 3 AS BIGINT) AS e0 FROM ln),
px AS (SELECT *, coalesce(lag(e0) OVER (PARTITION BY trx ORDER BY rk), 0) AS s0 FROM pz),
ex AS (SELECT gene, trx, part || '_' || line AS exon, part * 100 AS lo, part * 100 + len(seq) - 1 AS hi, rk, seq, CASE WHEN part % 7 = 0 THEN -1 ELSE s0 END AS sp, CASE WHEN part % 7 = 0 THEN -1 ELSE e0 END AS ep FROM px),
ey AS (SELECT *, rk = 0 AS is_first, lead(rk) OVER w IS NULL AS is_last, coalesce(string_agg(seq, '') OVER (PARTITION BY trx ORDER BY rk ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before FROM ex WINDOW w AS (PARTITION BY trx ORDER BY rk)),
ez AS (SELECT *, CASE WHEN ep IN (1, 2) THEN left(seq, greatest(len(seq) - ep, 0)) ELSE seq END AS head FROM ey),
cd AS (SELECT *, CASE WHEN sp = -1 THEN seq WHEN sp = 0 THEN head WHEN is_first THEN substr(head, 4 - sp) WHEN len(before) >= sp THEN right(before, CAST(sp AS INT)) || head END AS cds FROM ez),
pq AS (SELECT *, coalesce(cds IS NULL OR CASE WHEN is_last THEN ep IN (1, 2) WHEN is_first THEN sp IN (1, 2) ELSE false END OR len(cds) % 3 <> 0, true) AS incomplete FROM cd),
pr AS (SELECT *, CASE WHEN incomplete THEN '' ELSE array_to_string(list_transform(regexp_extract_all(cds, '.{{3}}'), lambda c: coalesce({_CODONS}[c], 'X')), '') END AS protein FROM pq)"""


@query(f"WITH {_CODING} SELECT trx, rk, exon, protein, incomplete FROM pr")
def exon_proteins(spark, sf_dir):
    x = exons.proteins(_coding_exons(spark, sf_dir))
    return x.select(F.col("TranscriptID").alias("trx"), F.col("ExonRank").alias("rk"), F.col("ExonID").alias("exon"), "protein", "incomplete")


@query(f"""WITH {_CODING}, lg AS (SELECT *, lag(ep) OVER (PARTITION BY trx ORDER BY rk) AS be FROM pr)
SELECT trx, rk, coalesce((NOT is_first AND be = -1) OR (sp <> -1 AND CASE WHEN is_first THEN 0 ELSE be END <> -1 AND sp <> CASE WHEN is_first THEN 0 ELSE be END)
 OR (ep <> -1 AND ep <> (CASE WHEN is_first THEN 0 ELSE be END + len(seq)) % 3) OR (NOT is_first AND sp = -1) OR (NOT is_last AND ep = -1), true) AS fault FROM lg""")
def exon_phase_faults(spark, sf_dir):
    return exons.phase_faults(_coding_exons(spark, sf_dir)).select(F.col("TranscriptID").alias("trx"), F.col("ExonRank").alias("rk"), "fault")


@query(f"""WITH {_CODING}, whole AS (SELECT gene, trx, string_agg(protein, '' ORDER BY rk) AS p FROM pr GROUP BY 1, 2),
ids AS (SELECT gene, p, list_sort(list(trx)) AS m FROM whole GROUP BY 1, 2)
SELECT pr.trx, rk, exon, array_to_string(m, '/') AS cluster FROM ids JOIN pr ON pr.gene = ids.gene AND pr.trx = m[1]""")
def equal_transcripts(spark, sf_dir):
    x = exons.one_of_equal_transcripts(materialize(exons.proteins(_coding_exons(spark, sf_dir)), "exon_proteins"))
    return x.select(F.col("TranscriptID").alias("trx"), F.col("ExonRank").alias("rk"), F.col("ExonID").alias("exon"), F.col("TranscriptIDCluster").alias("cluster"))


@query(f"""WITH RECURSIVE {_CODING},
ky AS (SELECT DISTINCT gene, exon, sp, ep, CASE WHEN sp <> -1 THEN lo END AS s, CASE WHEN ep <> -1 THEN hi END AS e, len(protein) AS n,
  CASE WHEN ep IN (1, 2) THEN left(CASE WHEN sp IN (1, 2) THEN substr(protein, 2) ELSE protein END, greatest(len(CASE WHEN sp IN (1, 2) THEN substr(protein, 2) ELSE protein END) - 1, 0)) ELSE CASE WHEN sp IN (1, 2) THEN substr(protein, 2) ELSE protein END END AS p FROM pr),
lk AS (SELECT DISTINCT a.gene, a.exon AS a, b.exon AS b FROM ky a JOIN ky b ON a.gene = b.gene AND a.sp = b.sp AND a.ep = b.ep AND a.s IS NOT DISTINCT FROM b.s AND a.e IS NOT DISTINCT FROM b.e AND a.n = b.n AND a.p = b.p),
rc AS (SELECT gene, a, b FROM lk UNION SELECT rc.gene, rc.a, lk.b FROM rc JOIN lk ON rc.gene = lk.gene AND rc.b = lk.a),
cl AS (SELECT gene, a AS exon, min(b) AS kept, string_agg(DISTINCT b, '/' ORDER BY b) AS cluster FROM rc GROUP BY 1, 2)
SELECT trx, rk, kept, cluster FROM pr JOIN cl ON pr.gene = cl.gene AND pr.exon = cl.exon""")
def identical_exons(spark, sf_dir):
    found = exons.proteins(_coding_exons(spark, sf_dir)).select("GeneID", "TranscriptID", "ExonRank", "ExonID", "StartPhase", "EndPhase", "GenomicCodingStart", "GenomicCodingEnd", "protein")
    x = exons.merge_identical(materialize(found, "exon_proteins"), "ExonID")
    return x.select(F.col("TranscriptID").alias("trx"), F.col("ExonRank").alias("rk"), F.col("ExonID").alias("kept"), F.col("ExonIDCluster").alias("cluster"))


# clusters, labels, relational operators


@query("""SELECT gene, array_to_string(m, '/') AS cluster, m[1] AS kept, CAST(len(m) AS BIGINT) AS n_members FROM
(SELECT p_brand AS gene, p_name, list_sort(list(DISTINCT p_partkey)) AS m FROM part GROUP BY 1, 2) WHERE len(m) > 1""")
def identical_sequences(spark, sf_dir):
    x = load(spark, sf_dir, "part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("trx"), "p_name")
    return relational.identical_sequences(x, "gene", "trx", "p_name")


@query("""SELECT p_partkey, p_brand, min(p_partkey) OVER (PARTITION BY p_brand, p_name, p_size) AS merged_id, count(*) OVER (PARTITION BY p_brand, p_name, p_size) AS n_same FROM part""")
def merge_identical_ids(spark, sf_dir):
    same = Window.partitionBy("p_brand", "p_name", "p_size")
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.min("p_partkey").over(same).alias("merged_id"), F.count(F.lit(1)).over(same).alias("n_same"))


@query("""WITH m AS (SELECT p_brand, p_name, string_agg(CAST(p_partkey AS VARCHAR), '/' ORDER BY CAST(p_partkey AS VARCHAR)) AS label FROM part GROUP BY 1, 2 HAVING count(*) > 1),
l AS (SELECT p_partkey, label FROM part JOIN m USING (p_brand, p_name))
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(label, CAST(l_partkey AS VARCHAR)) AS cluster FROM lineitem LEFT JOIN l ON l_partkey = p_partkey""")
def store_cluster(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    groups = part.groupBy("p_brand", "p_name").agg(S.joined_set(F.col("p_partkey").cast("string")).alias("cluster"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = materialize(groups.withColumn("group", F.monotonically_increasing_id()), "labels")
    members = part.join(groups.drop("cluster"), ["p_brand", "p_name"]).select(F.col("p_partkey").alias("l_partkey"), "group")
    labels = groups.select("group", "cluster")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return relational.store_shared_label(lines, members, few_bytes(labels, "cluster"), "l_partkey", "group", "cluster", F.col("l_partkey").cast("string")).select("l_orderkey", "l_linenumber", "l_partkey", "cluster")


_TSL = "try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE)"


@query(f"SELECT o_orderkey, {_TSL} AS tsl FROM orders WHERE {_TSL} <= 3 OR {_TSL} IS NULL")
def tsl_filter(spark, sf_dir):
    x = load(spark, sf_dir, "orders").withColumn("tsl", S.support_level(F.replace("o_orderpriority", F.lit("-"), F.lit(" "))))
    return relational.support_filter(x, "tsl", 3).select("o_orderkey", "tsl")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def species_filter(spark, sf_dir):
    return relational.in_list(load(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL")
def dropna_rows(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")).na.drop("any")


_PROT = """pr AS (SELECT l_orderkey AS trx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS rk,
translate(l_returnflag || l_linestatus, 'ANROF', 'MKXQ*') AS protein, l_tax > 0.07 AS incomplete FROM lineitem)"""


def _proteins(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return x.select(F.col("l_orderkey").alias("trx"), rank.alias("rk"), F.translate(F.concat("l_returnflag", "l_linestatus"), "ANROF", "MKXQ*").alias("protein"), (F.col("l_tax") > 0.07).alias("incomplete"))


@query(f"WITH {_PROT}, bad AS (SELECT trx FROM pr GROUP BY 1 HAVING bool_or(incomplete) OR NOT ends_with(string_agg(protein, '' ORDER BY rk), '*')) SELECT trx, count(*) AS n FROM pr WHERE trx NOT IN (SELECT trx FROM bad) GROUP BY 1")
def incomplete_anti_join(spark, sf_dir):
    x = _proteins(spark, sf_dir)
    return relational.drop_incomplete(x, "trx", ["rk"], "protein", "incomplete").groupBy("trx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PROT} SELECT trx, count(*) AS n FROM pr WHERE trx NOT IN (SELECT trx FROM pr WHERE contains(protein, 'X')) GROUP BY 1")
def badquality_anti_join(spark, sf_dir):
    return relational.drop_bad_quality(_proteins(spark, sf_dir), "trx", "protein").groupBy("trx").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r
FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r = 1""")
def inner_join_dedup(spark, sf_dir):
    x = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return relational.keep_first(x, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey", "c_name")


@query("""WITH a AS (SELECT l_orderkey AS k, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS k, l_linestatus AS g, max(l_linenumber) AS m FROM lineitem GROUP BY 1, 2)
SELECT k, f, n, g, m FROM a NATURAL JOIN b""")
def natural_join(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), "l_linenumber", "l_linestatus")
    a = x.groupBy("k", "f").agg(F.count(F.lit(1)).alias("n"))
    b = x.groupBy("k", F.col("l_linestatus").alias("g")).agg(F.max("l_linenumber").alias("m"))
    return a.join(b, [c for c in a.columns if c in b.columns]).select("k", "f", "n", "g", "m")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def semi_join(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, sf_dir, "part").join(lines, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT c_custkey, coalesce(n_name, '') AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def left_lookup(spark, sf_dir):
    n = load(spark, sf_dir, "nation").where("n_regionkey < 3")
    return load(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("name"))


@query("""WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS k FROM lineitem GROUP BY 1, 2), t AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, l_partkey, k AS n_rows, n AS n_transcripts, round(k * 1e0 / n, 6) AS fraction FROM c JOIN t USING (l_suppkey)""")
def transcript_fraction(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey")
    rows = relational.segment_fractions(x, "l_suppkey", "l_orderkey", "l_partkey")
    return rows.select("l_suppkey", "l_partkey", F.col("SubexonCount").alias("n_rows"), F.col("TranscriptNumber").alias("n_transcripts"), F.round("TranscriptFraction", 6).alias("fraction"))


_WORDS = "string_split(p_name || ' ' || p_type, ' ')"


@query(f"""WITH e AS (SELECT p_partkey, unnest({_WORDS}) AS piece, generate_subscripts({_WORDS}, 1) AS rank FROM part),
s AS (SELECT *, CAST(sum(len(piece)) OVER (PARTITION BY p_partkey ORDER BY rank) AS BIGINT) AS stop FROM e) SELECT p_partkey, CAST(rank AS BIGINT) AS rank, piece, stop - len(piece) + 1 AS start, stop FROM s""")
def tidy_explode(spark, sf_dir):
    x = load(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("pos", "piece")).withColumns({"rank": (F.col("pos") + 1).cast("long"), "len": F.length("piece").cast("long")})
    return ordered.running_span(x, ["p_partkey"], ["rank"], "len", "start", "stop").select("p_partkey", "rank", "piece", "start", "stop")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '0_' || CAST(dense_rank() OVER (ORDER BY f) AS VARCHAR) ELSE p_type END AS segment_id FROM
(SELECT *, CASE WHEN p_size % 3 = 0 THEN min(p_partkey) OVER (PARTITION BY p_brand, p_size % 3 = 0) END AS f FROM part)""")
def impute_missing_ids(spark, sf_dir):
    """Every part with its id; the modulo only says which ids are missing."""
    x = load(spark, sf_dir, "part")
    missing = F.coalesce(F.col("p_size") % 3 == 0, F.lit(False))
    numbers = relational.first_seen_index(x.where(missing), "p_brand", ["p_partkey"]).withColumnRenamed("p_brand", "brand")
    made = F.concat(F.lit("0_"), (F.col("index") + 1).cast("string"))
    return x.join(numbers, F.col("p_brand").eqNullSafe(F.col("brand")), "left").select("p_partkey", F.when(missing, made).otherwise(F.col("p_type")).alias("segment_id"))


@query("""WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n_hits, max(l_quantity) AS best_coverage, max(l_discount) AS best_identity FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, n_hits, best_coverage, best_identity FROM g QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n_hits DESC, best_coverage DESC, best_identity DESC, l_suppkey) = 1""")
def best_cluster_topk(spark, sf_dir):
    return relational.best_cluster(load(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", "l_discount")


@query(f"WITH {_EX}, c AS (SELECT trx, seq, lag(seq) OVER (PARTITION BY trx ORDER BY rk) AS before FROM ex) SELECT DISTINCT before, seq AS after FROM c WHERE before IS NOT NULL")
def connected_segments(spark, sf_dir):
    return ordered.connected_pairs(_exons(spark, sf_dir), ["trx"], ["rk"], "seq")


@query("""SELECT p_brand, CAST(count(*) AS BIGINT) AS n_parts, min(len(p_name)) AS min_len, round(avg(len(p_name)), 6) AS mean_len, max(len(p_name)) AS max_len FROM part GROUP BY 1""")
def length_stats(spark, sf_dir):
    n = F.length("p_name")
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"), F.min(n).cast("long").alias("min_len"), F.round(F.avg(n), 6).alias("mean_len"), F.max(n).cast("long").alias("max_len"))


@query("""WITH t AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), w AS (SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, CAST(CASE WHEN n = 1 THEN 0.33 WHEN k = n THEN 1.0 WHEN k = n - 1 THEN 0.66 ELSE 0.0 END AS DOUBLE) AS score FROM w JOIN t USING (l_suppkey)""")
def constitutive_scores(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem")
    t = x.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n"))
    w = x.groupBy("l_suppkey", "l_partkey").agg(F.count_distinct("l_orderkey").alias("k"))
    return w.join(t, "l_suppkey").select("l_suppkey", "l_partkey", S.constitutive_score(F.col("n"), F.col("k")).alias("score"))


@query("""SELECT o_custkey AS id, o_orderpriority AS biotype, CAST(NULL AS VARCHAR) AS source FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' UNION ALL SELECT o_custkey, 'protein_coding', 'user' FROM orders WHERE o_orderstatus = 'P'""")
def union_user_rows(spark, sf_dir):
    """Orders of status P are the rows of users, all others the base."""
    o = load(spark, sf_dir, "orders")
    user = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    base = o.where("NOT (o_orderstatus <=> 'P')").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("Biotype"))
    return relational.add_user_rows(base, user).select("id", F.col("Biotype").alias("biotype"), F.col("Source").alias("source"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1 ORDER BY 2 DESC""")
def counts_most_common(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users")).orderBy(F.desc("n"), "event_type")


# alignments: the words of a brand's parts are the rows of one alignment

_ROWS = """al AS (SELECT p_brand, p_partkey, translate(md5(p_name), '0123456789abcdef', '-CGT-CGTC-GT-TTT') AS aligned FROM part),
pos AS (SELECT p_brand, p_partkey, unnest(string_split(aligned, '')) AS x, generate_subscripts(string_split(aligned, ''), 1) AS "column" FROM al)"""


def _rows(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.translate(F.md5("p_name"), "0123456789abcdef", "-CGT-CGTC-GT-TTT").alias("aligned"))


@query(f"""WITH {_ROWS}, n AS (SELECT p_brand, "column", x, count(*) AS n FROM pos GROUP BY 1, 2, 3),
g AS (SELECT p_brand, "column", sum(n) FILTER (x <> '-') AS total, max(n) FILTER (x <> '-') AS top, sum(n) AS rows, coalesce(max(n) FILTER (x = '-'), 0) AS gaps FROM n GROUP BY 1, 2),
b AS (SELECT g.*, count(n.x) AS ties, min(n.x) AS best FROM g LEFT JOIN n ON n.p_brand = g.p_brand AND n."column" = g."column" AND n.x <> '-' AND n.n = g.top GROUP BY ALL),
c AS (SELECT p_brand, "column", CASE WHEN ties = 1 AND top >= 0.5 * total THEN best ELSE 'X' END AS s, gaps > coalesce(top, 0) AND gaps >= 0.5 * rows AS low FROM b)
SELECT p_brand, CAST("column" AS BIGINT) AS "column", CASE WHEN low THEN lower(s) ELSE s END AS consensus FROM c""")
def consensus_column(spark, sf_dir):
    return alignment.column_consensus(_rows(spark, sf_dir), "p_brand")


@query(f"""WITH {_ROWS} SELECT p_name, CAST("column" AS BIGINT) AS "column" FROM (SELECT DISTINCT p_name, p_partkey FROM part) JOIN pos USING (p_partkey) GROUP BY 1, 2 HAVING bool_and(x = '-')""")
def full_gap_columns(spark, sf_dir):
    names = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return alignment.gap_columns(_rows(spark, sf_dir).join(names, "p_partkey"), "p_name")


@query(f"""WITH {_ROWS}, c AS (SELECT p_brand, "column", string_agg(x, '' ORDER BY p_partkey) AS pattern FROM pos GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN lag(pattern) OVER (PARTITION BY p_brand ORDER BY "column") = pattern THEN 0 ELSE 1 END AS n FROM c),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY p_brand ORDER BY "column") AS BIGINT) AS island FROM m)
SELECT p_brand, island, md5(min(pattern)) AS pattern, count(*) AS n FROM r GROUP BY 1, 2""")
def column_rle(spark, sf_dir):
    return alignment.column_runs(_rows(spark, sf_dir), "p_brand", "p_partkey").select("p_brand", "island", F.md5("pattern").alias("pattern"), "n")


@query("SELECT DISTINCT l_orderkey, l_partkey, 1 AS present FROM lineitem")
def presence_matrix(spark, sf_dir):
    return alignment.presence(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


_GENE = """sx AS (SELECT l_suppkey AS gene, l_partkey AS item, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS idx FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
cn AS (SELECT DISTINCT lag(l_partkey) OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_partkey) AS b, l_partkey AS a FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem))"""


@query(f"""WITH {_GENE}, o AS (SELECT gene, item, idx, left(md5(CAST(item AS VARCHAR)), 5) AS s, lag(item) OVER (PARTITION BY gene ORDER BY idx) AS before FROM sx),
p AS (SELECT gene, idx, CASE WHEN before IS NOT NULL AND cn.a IS NULL THEN 'XXXXXXXXXX' ELSE '' END || s AS part FROM o LEFT JOIN cn ON cn.b = o.before AND cn.a = o.item),
q AS (SELECT *, CAST(sum(len(part)) OVER (PARTITION BY gene ORDER BY idx) AS BIGINT) AS stop FROM p)
SELECT gene, md5(string_agg(part, '' ORDER BY idx)) AS chimeric, md5(string_agg(CAST(stop AS VARCHAR), ',' ORDER BY idx)) AS breaks FROM q GROUP BY 1""")
def chimeric_rows(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    x = lines.select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("item")).distinct().withColumn("seq", F.left(F.md5(F.col("item").cast("string")), F.lit(5)))
    links = ordered.connected_pairs(lines.select("l_orderkey", "l_suppkey", "l_partkey").distinct(), ["l_orderkey", "l_suppkey"], ["l_partkey"], "l_partkey")
    found = alignment.chimeric(x, links, "gene", "item", "item", "seq")
    return found.select("gene", F.md5("chimeric").alias("chimeric"), F.md5(F.array_join(F.transform("breaks", lambda b: b.cast("string")), ",")).alias("breaks"))


@query()
def alignment_blocks(spark, sf_dir):
    """Blocks of the alignments of brands: rows are whole words, segments of eight residues."""
    rows = _rows(spark, sf_dir).groupBy("p_brand", "aligned").agg(F.min("p_partkey").alias("row"))
    stops = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (i * 8).cast("long"))
    return alignment.segments_of(rows.withColumn("breaks", stops), "p_brand", "row").drop("gapped")


@query("""WITH e AS (SELECT p_partkey, p_name, p_size, md5(p_name) AS m FROM part),
w AS (SELECT p_partkey, unnest([1, 2, 3]) AS rk, unnest([4, 3, 5]) AS n, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS strand, p_partkey * 100 AS s, p_partkey * 100 + 39 AS t, p_size % 3 AS ph FROM part),
c AS (SELECT *, 3 * n - CASE WHEN rk = 1 THEN ph ELSE 0 END AS b FROM w),
u AS (SELECT *, CAST(sum(b) OVER (PARTITION BY p_partkey ORDER BY rk) AS BIGINT) AS upto FROM c)
SELECT p_partkey, CAST(rk AS BIGINT) AS rk, CASE WHEN strand = 1 THEN s + upto - b ELSE t - upto + b END AS segment_start,
CASE WHEN strand = 1 THEN s + CASE WHEN rk = 3 THEN 40 ELSE upto END - 1 ELSE t - CASE WHEN rk = 3 THEN 40 ELSE upto END + 1 END AS segment_end, CAST(CASE WHEN rk = 1 THEN ph ELSE 0 END AS BIGINT) AS segment_start_phase FROM u""")
def segment_coordinates(spark, sf_dir):
    x = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("strand"), (F.col("p_partkey") * 100).alias("s"), (F.col("p_partkey") * 100 + 39).alias("t"), (F.col("p_size") % 3).alias("ph"))
    x = x.withColumn("seg", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("rk"), F.lit(n).alias("n")) for i, n in ((1, 4), (2, 3), (3, 5)))))).select("*", "seg.*")
    found = alignment.coordinates(x, ["p_partkey"], ["rk"], F.col("n"), "strand", "s", "t", "ph")
    return found.select("p_partkey", "rk", "segment_start", "segment_end", "segment_start_phase")


# clusters


#: Least labels spread over edges; each round keeps one label a node.
_LEAST = """RECURSIVE r(node, x) USING KEY (node) AS (SELECT node, min(x) AS x FROM (SELECT a AS node, least(a, b) AS x FROM e UNION ALL SELECT b, least(a, b) FROM e) GROUP BY 1
UNION SELECT f.node, f.x FROM (SELECT p.b AS node, min(r.x) AS x FROM r JOIN p ON p.a = r.node GROUP BY 1) f JOIN recurring.r AS k ON k.node = f.node WHERE f.x < k.x)"""

_LINKS = """RECURSIVE x AS (SELECT DISTINCT o_custkey AS item, CAST(floor(o_totalprice) AS BIGINT) % 20011 AS cl FROM orders), u AS (SELECT * FROM x WHERE cl <> 0),
f AS (SELECT item, min(cl) AS b FROM u GROUP BY 1), e AS (SELECT DISTINCT cl AS a, b FROM u JOIN f USING (item)), p AS (SELECT a, b FROM e UNION SELECT b, a FROM e),"""
_BILLS = """RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000 + CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders), p AS (SELECT a, b FROM e UNION SELECT b, a FROM e),"""


@query(f"""WITH {_LEAST.replace('RECURSIVE', _BILLS)}
SELECT node, x AS component FROM r""")
def connected_components(spark, sf_dir):
    """Customers and prices of all orders."""
    o = load(spark, sf_dir, "orders")
    return components.components(o.select(F.col("o_custkey").alias("a"), (1000000 + F.floor("o_totalprice")).alias("b")))


@query(f"""WITH {_LEAST.replace('RECURSIVE', _LINKS)}
SELECT item, coalesce(r.x, cl) AS cl FROM x LEFT JOIN r ON node = cl""")
def merge_clusters(spark, sf_dir):
    """Clusters of the customers of all orders."""
    x = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.pmod(F.floor("o_totalprice"), F.lit(20011)).alias("cl")).distinct()
    return components.merge_clusters(x, "item", "cl")


def _peptides(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    dna = S.dna(F.col("p_name"))
    return p.select("p_brand", "p_partkey", S.translate_codons(F.left(dna, F.length(dna) - F.length(dna) % 3)).alias("seq"))


@query()
def greedy_cluster(spark, sf_dir):
    """Greedy clusters of the whole peptides of each brand; copies meet before any alignment."""
    return similarity.cluster_families(_peptides(spark, sf_dir), "p_brand", "p_partkey", "seq", 50.0, 30.0)


@query()
def local_align(spark, sf_dir):
    """Each part's peptide against that of the first part of its brand."""
    x = _peptides(spark, sf_dir)
    first = relational.keep_first(x, ["p_brand"], ["p_partkey"]).select("p_brand", F.col("seq").alias("target"))
    return similarity.align_pairs(x.join(first, "p_brand"), "seq", "target").select("p_partkey", "aligned_a", "aligned_b", F.round("identity", 6).alias("identity"))


# exports


@query("""SELECT '>' || CAST(p_partkey AS VARCHAR) || chr(10) || regexp_replace(md5(p_name) || md5(p_brand) || md5(p_type), '(.{80})', '\\1' || chr(10)) AS value FROM part""")
def fasta_export(spark, sf_dir):
    x = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.md5("p_name"), F.md5("p_brand"), F.md5("p_type")).alias("seq"))
    return sinks.fasta_lines(x, "id", "seq")


@query("""SELECT p_brand, p_brand || ' ' || string_agg(p_name, ' ' ORDER BY p_name) AS value FROM part GROUP BY 1""")
def transcript_lines(spark, sf_dir):
    return sinks.transcript_lines(load(spark, sf_dir, "part"), "p_brand", "p_name")


# scalars, identifiers and exports

_DNA = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, substr({_DNA.format('CAST(l_partkey AS VARCHAR)')}, CAST((CASE WHEN l_returnflag = 'R' THEN 31 - 9 - l_suppkey % 20 ELSE l_suppkey % 20 END) + 1 AS INT), 10) AS part FROM lineitem""")
def interval_slice(spark, sf_dir):
    """Ten bases of a region of 32 at a genomic place, read on either strand."""
    x = load(spark, sf_dir, "lineitem")
    start, first = F.col("l_partkey") * 100, F.col("l_suppkey") % 20
    strand = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    cut = S.slice_interval(S.dna(F.col("l_partkey").cast("string")), strand, start, start + 31, start + first, start + first + 9)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", cut.alias("part"))


@query(f"""WITH d AS (SELECT p_partkey, left({_DNA.format('p_name')}, p_size % 7) AS seq, p_size % 4 - 1 AS ph FROM part)
SELECT p_partkey, CASE WHEN ph > 0 THEN left(seq, greatest(len(seq) - ph, 0)) ELSE seq END AS trimmed, CASE WHEN ph BETWEEN 0 AND 2 THEN (3 - ph) % 3 END AS bases_before, CASE WHEN ph BETWEEN 0 AND 2 THEN ph END AS bases_after FROM d""")
def codon_ends(spark, sf_dir):
    """Bases that a codon shares with the exon before and after, and sequences without those of the next exon."""
    ph = F.col("p_size") % 4 - 1
    x = load(spark, sf_dir, "part").select("p_partkey", F.left(S.dna(F.col("p_name")), F.col("p_size") % 7).alias("seq"), ph.cast("int").alias("ph"))
    return x.select("p_partkey", S.trim_end(F.col("seq"), F.col("ph")).alias("trimmed"), S.bases_before(F.col("ph")).alias("bases_before"), S.bases_after(F.col("ph")).alias("bases_after"))


@query("""WITH d AS (SELECT p_partkey, p_name AS s, p_size % 3 AS a, (p_size // 3) % 3 AS b FROM part), h AS (SELECT *, CASE WHEN a > 0 THEN substr(s, 2) ELSE s END AS t FROM d)
SELECT p_partkey, CASE WHEN b > 0 THEN left(t, greatest(len(t) - 1, 0)) ELSE t END AS residues, a - 1 <> b - 1 AND a - 1 <> -1 AND b - 1 <> -1 AS differ FROM h""")
def comparable_residues(spark, sf_dir):
    """Residues that do not depend on a neighbour, and whether two phases differ (-1 is a wildcard)."""
    a, b = F.col("p_size") % 3, F.floor(F.col("p_size") / 3) % 3
    return load(spark, sf_dir, "part").select("p_partkey", S.comparable(F.col("p_name"), a, b).alias("residues"), S.differ(a - 1, b - 1).alias("differ"))


_NAMES = """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN lower(replace(p_name, ' ', '_')) WHEN 1 THEN lower(split_part(p_name, ' ', 1)) || '_' || lower(p_type) WHEN 2 THEN 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0')
WHEN 3 THEN CAST(p_partkey AS VARCHAR) || '_' || CAST(p_size AS VARCHAR) ELSE p_name END AS name FROM part"""


@query(f"""WITH n AS ({_NAMES}) SELECT p_partkey, name, regexp_matches(name, '^[a-z]+_[a-z]+(_[0-9a-z]+)?$') AS is_species, regexp_matches(name, '^ENS.*G[0-9]{{11}}') AS is_gene, regexp_matches(name, '^[0-9]+_[0-9]+') AS is_segment,
array_to_string(list_transform(list_slice(string_split(name, '_'), 1, -2), lambda x: left(x, 1)), '') || list_extract(string_split(name, '_'), -1) AS dataset FROM n""")
def name_checks(spark, sf_dir):
    """What names are names of, and the dataset of a species."""
    low = lambda c: F.lower(c)
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_size") % 5
    name = F.when(kind == 0, low(F.replace("p_name", F.lit(" "), F.lit("_")))).when(kind == 1, F.concat(low(F.split("p_name", " ")[0]), F.lit("_"), low(F.col("p_type"))))
    name = name.when(kind == 2, F.concat(F.lit("ENSG"), F.lpad(key, 11, "0"))).when(kind == 3, F.concat(key, F.lit("_"), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    x, n = load(spark, sf_dir, "part").select("p_partkey", name.alias("name")), F.col("name")
    return x.select("p_partkey", "name", S.is_species(n).alias("is_species"), S.is_stable_gene_id(n).alias("is_gene"), S.is_segment_id(n).alias("is_segment"), S.dataset_name(n).alias("dataset"))


@query("""SELECT p_partkey, unnest(CASE WHEN p_size % 4 = 0 THEN [p_brand] ELSE string_split(replace(p_name, ' ', '/'), '/') END) AS label FROM part""")
def split_labels(spark, sf_dir):
    """The parts of a '/' list, or a default for an empty one, a row each."""
    text = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.replace("p_name", F.lit(" "), F.lit("/")))
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(S.split_list(text, F.col("p_brand"))).alias("label"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def label_map(spark, sf_dir):
    """The last order of each customer."""
    return relational.label_map(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("""SELECT o_orderkey, o_orderpriority AS type, o_orderstatus AS species FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderstatus NOT IN ('P') AND o_orderstatus IN ('F', 'P')""")
def orthologs(spark, sf_dir):
    """Rows of wanted relationships and listed species, without forbidden ones."""
    x = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("species"))
    return relational.orthologs(x, ["1-URGENT", "3-MEDIUM"], ["P"], ["F", "P"])


@query("""SELECT c_custkey, c_mktsegment, list_position(['MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE'], c_mktsegment) AS place FROM customer""")
def order_by_list(spark, sf_dir):
    """Customers in the order of a list of segments, with their place in it."""
    names = ["MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"]
    rows = relational.order_by_list(load(spark, sf_dir, "customer"), "c_mktsegment", names)
    return rows.select("c_custkey", "c_mktsegment", F.array_position(F.array(*map(F.lit, names)), F.col("c_mktsegment")).cast("int").alias("place"))


@query("""WITH x AS (SELECT p_partkey AS id, p_partkey AS s, p_partkey + p_size - 10 AS e, p_partkey AS cs, p_partkey + p_size - 5 AS ce, p_name AS seq, CASE WHEN p_size % 2 = 0 THEN 'homo_sapiens' ELSE 'Homo sapiens' END AS sp FROM part),
f AS (SELECT id, list_filter([CASE WHEN s > e THEN 'exon region order' END, CASE WHEN cs > ce THEN 'coding region order' END, CASE WHEN len(seq) <> e - s + 1 THEN 'sequence length' END, CASE WHEN NOT regexp_matches(sp, '^[a-z]+_[a-z]+$') THEN 'species name' END], lambda v: v IS NOT NULL) AS faults FROM x)
SELECT id, array_to_string(faults, ', ') AS faults FROM f WHERE len(faults) > 0""")
def user_row_faults(spark, sf_dir):
    """The rules that exon rows of users break."""
    p = F.col("p_partkey")
    x = load(spark, sf_dir, "part").select(
        p.alias("id"), p.alias("ExonRegionStart"), (p + F.col("p_size") - 10).alias("ExonRegionEnd"), p.alias("GenomicCodingStart"), (p + F.col("p_size") - 5).alias("GenomicCodingEnd"),
        F.col("p_name").alias("NucleotideSequence"), F.when(F.col("p_size") % 2 == 0, "homo_sapiens").otherwise("Homo sapiens").alias("Species"),
    )
    return relational.user_row_faults(x).select("id", F.array_join("faults", ", ").alias("faults"))


@query("""WITH f AS (SELECT p_type || '_' || CAST(p_size AS VARCHAR) AS segment, min(p_partkey) AS seen FROM part GROUP BY 1) SELECT segment, row_number() OVER (ORDER BY seen, segment) - 1 AS number FROM f""")
def segment_codes(spark, sf_dir):
    """A one-letter code for each segment by first appearance, given back as its place in the alphabet."""
    x = load(spark, sf_dir, "part").select(F.concat("p_type", F.lit("_"), F.col("p_size").cast("string")).alias("segment"), "p_partkey")
    coded = sinks.segment_codes(x, "segment", ["p_partkey"])
    return coded.select("segment", (F.instr(F.lit(sinks.ALPHABET), F.col("code")) - 1).cast("long").alias("number"))


@query("""WITH r AS (SELECT p_brand, p_type, list(struct_pack(k := p_partkey, c := left(p_name, 1), s := replace(p_name, '*', '')) ORDER BY p_partkey) AS r FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, '>P1;' || p_brand || ' ' || p_type || ' ' || array_to_string(list_transform(r, lambda v: v.c), '') || chr(10) || array_to_string(list_transform(r, lambda v: repeat(v.c, len(v.s))), '') || chr(10) || array_to_string(list_transform(r, lambda v: v.s), '') || '*' AS value FROM r""")
def pir_records(spark, sf_dir):
    x = load(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", F.left("p_name", F.lit(1)).alias("code"), "p_name")
    return sinks.pir(x, "p_brand", "p_type", "p_partkey", "code", "p_name")


@query("""SELECT 0 AS place, 'graph [' || chr(10) || '  directed 1' AS value UNION ALL SELECT 3, ']'
UNION ALL SELECT 1, '  node [' || chr(10) || '    id ' || CAST(n_nationkey AS VARCHAR) || chr(10) || '    label "' || n_name || '"' || chr(10) || '  ]' FROM nation
UNION ALL SELECT 2, '  edge [' || chr(10) || '    source ' || CAST(s_nationkey AS VARCHAR) || chr(10) || '    target ' || CAST(s_suppkey AS VARCHAR) || chr(10) || '    name "' || s_name || '"' || chr(10) || '  ]' FROM supplier""")
def gml_lines(spark, sf_dir):
    """Nations as nodes, suppliers as edges of a GML graph."""
    nodes = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return sinks.gml(nodes, load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("target"), F.col("s_name").alias("name")))


@query("""SELECT '{"r_regionkey":' || CAST(n_regionkey AS VARCHAR) || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def json_rows(spark, sf_dir):
    return sinks.json_lines(load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name"))


@query("""SELECT 'ENST' || CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name, CASE WHEN o_orderstatus <> 'F' THEN try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) END AS level FROM orders""")
def csv_round_trip(spark, sf_dir):
    """All orders written as CSV with NA for what is missing, and read back."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    level = F.when(F.col("o_orderstatus") != "F", F.split("o_orderpriority", "-")[0])
    sinks.write_csv(load(spark, sf_dir, "orders").select(F.concat(F.lit("ENST"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name"), level.alias("flags")), path)
    back = spark.read.csv(path, header=True, nullValue="NA", schema="id string, name string, flags string")
    return back.select("id", "name", S.support_level(F.col("flags")).alias("level"))


@query("""SELECT 'ENSE' || CAST(p_partkey AS VARCHAR) AS id, md5(p_name) || md5(p_brand) || md5(p_type) AS seq FROM part""")
def fasta_round_trip(spark, sf_dir):
    """All parts written as FASTA in lines of 80 letters, and read back."""
    path = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    x = load(spark, sf_dir, "part").select(F.concat(F.lit("ENSE"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.md5("p_name"), F.md5("p_brand"), F.md5("p_type")).alias("seq"))
    sinks.write_fasta(x, path, "id", "seq")
    return tables.read_fasta(spark, path).select(F.col("header").alias("id"), "seq")


_CATERPILLAR = """l AS (SELECT l_orderkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey FROM lineitem)"""


@query(f"""WITH RECURSIVE {_CATERPILLAR}, k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS j, count(*) OVER (PARTITION BY l_orderkey) AS m,
i - coalesce(lag(i) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AS d FROM l WHERE l_partkey % 3 <> 0),
f AS (SELECT l_orderkey, j, m, d, 'S' || l_suppkey || CASE WHEN m > 1 THEN ':' || (q + d) ELSE '' END AS t FROM k WHERE j = m
UNION ALL SELECT k.l_orderkey, k.j, k.m, k.d, '(S' || k.l_suppkey || ':' || k.q || ',' || f.t || ')' || CASE WHEN k.j > 1 THEN ':' || k.d ELSE '' END FROM f JOIN k ON k.l_orderkey = f.l_orderkey AND k.j = f.j - 1)
SELECT l_orderkey, t || ';' AS newick FROM f WHERE j = 1""")
def pruned_trees(spark, sf_dir):
    """A tree of the lines of each order, cut down to some of them under their suppliers' names."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"), F.row_number().over(w).alias("i"))
    leaves = F.array_sort(F.collect_list(F.struct("i", F.concat_ws(":", F.concat(F.lit("L"), "i"), "q").alias("t"))))
    texts = lines.groupBy("l_orderkey").agg(leaves.alias("v"))
    n = F.size("v")
    text = F.concat(F.lit("("), F.array_join(F.transform("v", lambda x: x["t"]), ",("), F.repeat(F.lit("):1"), n), F.lit(";"))
    nodes = trees.read_newick(texts.select("l_orderkey", text.alias("newick")), "l_orderkey", "newick")
    keep = lines.where("l_partkey % 3 <> 0").select("l_orderkey", F.concat(F.lit("L"), "i").alias("name"), F.concat(F.lit("S"), "l_suppkey").alias("label"))
    return trees.newick(trees.prune(materialize(nodes, "nodes"), "l_orderkey", keep), "l_orderkey")


@query("""WITH RECURSIVE r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_partkey % 97 AS a, l_partkey % 97 + 1 + CAST(l_quantity AS BIGINT) % 9 AS b FROM lineitem),
e AS (SELECT x.l_orderkey, x.a AS xa, x.b AS xb, y.a AS ya, y.b AS yb FROM (SELECT DISTINCT l_orderkey, a, b FROM r) x JOIN (SELECT DISTINCT l_orderkey, a, b FROM r) y ON x.l_orderkey = y.l_orderkey AND greatest(x.a - 2, 0) < y.b + 2 AND greatest(y.a - 2, 0) < x.b + 2),
c AS (SELECT l_orderkey, xa, xb, ya, yb FROM e UNION SELECT c.l_orderkey, c.xa, c.xb, e.ya, e.yb FROM c JOIN e ON c.l_orderkey = e.l_orderkey AND c.ya = e.xa AND c.yb = e.xb),
g AS (SELECT l_orderkey, xa, xb, min(ya) AS first, max(yb) AS stop FROM c GROUP BY 1, 2, 3)
SELECT r.l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (PARTITION BY r.l_orderkey ORDER BY first) - 1 AS cluster, CAST(first AS BIGINT) AS first, CAST(stop AS BIGINT) AS stop FROM r JOIN g ON g.l_orderkey = r.l_orderkey AND g.xa = r.a AND g.xb = r.b""")
def range_clusters(spark, sf_dir):
    """Ranges of the lines of each order: those that come within two places of each other are one cluster."""
    a = F.col("l_partkey") % 97
    x = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), (a + 1 + F.col("l_quantity").cast("long") % 9).alias("b"))
    return intervals.close_ranges(x, ["l_orderkey"], "a", "b", 2).select("l_orderkey", "l_linenumber", "l_partkey", "cluster", F.col("first").cast("long").alias("first"), F.col("stop").cast("long").alias("stop"))


def _sub_exons_of_brands(spark, sf_dir):
    """Parts as sub-exons: a brand is a family, parts of like sizes a gene with one transcript, in the order of part keys."""
    p = materialize(_peptides(spark, sf_dir).where(F.length(F.replace("seq", F.lit("*"), F.lit(""))) > 0), "peptides")
    found = similarity.cluster_families(p, "p_brand", "p_partkey", "seq", 50.0, 30.0).select("p_brand", "seq", F.col("cluster").alias("Cluster"))
    x = p.join(found, ["p_brand", "seq"]).join(load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("g"), F.col("p_size") % 8).alias("gene")), "p_partkey")
    x = x.select(F.col("p_brand").alias("family"), F.col("gene").alias("GeneID"), F.col("gene").alias("TranscriptID"), F.col("p_partkey").cast("string").alias("SubexonID"), "Cluster", F.col("seq").alias("protein"), (F.col("p_partkey") * 1000).alias("lo"), (F.col("p_partkey") * 1000 + 999).alias("hi"), F.lit(1).alias("Strand"), F.lit(0).alias("StartPhase"))
    return materialize(ordered.ranks(x, ["family", "GeneID"], ["lo"], "SubexonRank"), "sub_exons")


@query()
def settled_clusters(spark, sf_dir):
    """The Cluster of every sub-exon after alignments are settled, negative where it was taken out."""
    return families.settle(_sub_exons_of_brands(spark, sf_dir))[0].select("family", "GeneID", "SubexonID", "Cluster")


@query()
def rescued_sub_exons(spark, sf_dir):
    """The Cluster of every sub-exon after what was taken out has been tried on the other clusters."""
    settled, aligned = families.settle(_sub_exons_of_brands(spark, sf_dir))
    return families.rescued(settled, aligned)[0].select("family", "GeneID", "SubexonID", "Cluster")


@query()
def repaired_segments(spark, sf_dir):
    """Orthologous segments of all brands, from settled, rescued and repaired alignments."""
    found, _ = families.s_exons(_sub_exons_of_brands(spark, sf_dir))
    return found.select("family", "GeneID", "SubexonID", "s_exon", "seq", "gapped")


def _user_tables(spark, sf_dir):
    """Parts as exons of users, lines as the table of exons that they join."""
    p = F.col("p_partkey")
    user = load(spark, sf_dir, "part").select(
        F.lit("homo_sapiens").alias("Species"), F.col("p_brand").alias("GeneID"), F.concat(F.lit("T"), p * 7).alias("TranscriptID"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("Strand"), F.concat(F.lit("E"), p).alias("ExonID"), (p % 5).alias("ExonRank"),
        p.alias("ExonRegionStart"), (p + F.length("p_name") - 1).alias("ExonRegionEnd"), (p + 3).alias("GenomicCodingStart"), (p + F.col("p_size")).alias("GenomicCodingEnd"), F.lit(0).alias("StartPhase"), F.lit(0).alias("EndPhase"), F.col("p_name").alias("NucleotideSequence"),
    )
    k = F.col("l_partkey")
    exons_ = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("T"), "l_orderkey").alias("TranscriptID"), F.concat(F.lit("E"), k).alias("ExonID"), k.alias("ExonRegionStart"), (k + 30 + F.col("l_linenumber")).alias("ExonRegionEnd"), (k + 3).alias("GenomicCodingStart"), (k + 9).alias("GenomicCodingEnd"), F.lit(0).alias("StartPhase"), F.lit(0).alias("EndPhase"))
    return user, exons_


@query("""WITH u AS (SELECT 'T' || p_partkey * 7 AS t, 'E' || p_partkey AS e, p_partkey AS k, len(p_name) AS n, p_size FROM part),
b AS (SELECT DISTINCT 'T' || l_orderkey AS t FROM lineitem), x AS (SELECT DISTINCT 'E' || l_partkey AS e, 30 + l_linenumber AS d FROM lineitem)
SELECT t, e, 'coding region order' AS fault FROM u WHERE k + 3 > k + p_size UNION ALL SELECT t, e, 'exon region order' FROM u WHERE n < 1
UNION ALL SELECT t, e, 'known transcript' FROM u WHERE t IN (SELECT t FROM b)
UNION ALL SELECT DISTINCT u.t, u.e, 'known exon with other values' FROM u JOIN x ON x.e = u.e WHERE d <> n - 1 OR p_size <> 9""")
def user_table_faults(spark, sf_dir):
    """Every rule that exons of users break, alone and against the table that they join."""
    found = users.faults(*_user_tables(spark, sf_dir))
    return found.select(F.col("TranscriptID").alias("t"), F.col("ExonID").alias("e"), "fault")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS strand, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) + 5 AS e, CASE WHEN l_suppkey % 4 > 0 THEN l_partkey + 2 END AS cs, CASE WHEN l_suppkey % 4 > 0 THEN l_partkey + CAST(l_quantity AS BIGINT) + 1 END AS ce,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rk FROM lineitem),
c AS (SELECT *, CAST(sum(e - s + 1) OVER (PARTITION BY l_orderkey ORDER BY rk) AS BIGINT) AS upto, CASE WHEN strand = -1 THEN s - cs ELSE e - ce END AS after FROM x)
SELECT l_orderkey AS trx, rk, upto - (ce - cs + 1) - after + 1 AS cdna_start, CASE WHEN ce IS NOT NULL THEN upto - after END AS cdna_end FROM c""")
def user_cdna_places(spark, sf_dir):
    """Where the coding part of each line, as an exon, lies among the lines of its order."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    k, q, coding = F.col("l_partkey"), F.col("l_quantity").cast("long"), F.col("l_suppkey") % 4 > 0
    x = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("TranscriptID"), rank.alias("ExonRank"), F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1).alias("Strand"), k.alias("ExonRegionStart"), (k + q + 5).alias("ExonRegionEnd"), F.when(coding, k + 2).alias("GenomicCodingStart"), F.when(coding, k + q + 1).alias("GenomicCodingEnd")
    )
    return users.cdna_places(x).select(F.col("TranscriptID").alias("trx"), F.col("ExonRank").alias("rk"), F.col("cDNA_CodingStart").alias("cdna_start"), F.col("cDNA_CodingEnd").alias("cdna_end"))


def _written_csv(spark, df: DataFrame, sep: str = ",", missing: str = "") -> str:
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    df.write.csv(path, header=True, sep=sep, nullValue=missing)
    return path


@query("""SELECT 'T' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'mus_musculus' ELSE 'homo_sapiens' END AS species, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS level FROM orders
WHERE o_orderkey % 3 <> 0 AND (o_orderkey % 7 <= 3)""")
def transcript_file(spark, sf_dir):
    """All orders as a file of transcripts: those of the wanted biotype and support stay, missing levels too."""
    k = F.col("o_orderkey")
    x = load(spark, sf_dir, "orders").select(
        F.when(k % 5 == 0, "mus_musculus").otherwise("homo_sapiens").alias("Species"), F.col("o_orderpriority").alias("Name"), F.concat(F.lit("T"), k).alias("TranscriptID"), F.lit("s").alias("Source"), F.lit("e").alias("ExperimentSource"),
        F.when(k % 3 == 0, "lncRNA").when(k % 3 == 1, "protein_coding").otherwise("Protein coding").alias("Biotype"), F.when(k % 7 > 0, (k % 7).cast("string")).alias("Flags"), F.lit("1").alias("Version"),
    )
    found = tables.read_transcripts(spark, _written_csv(spark, x, missing="NA"), ["homo_sapiens", "mus_musculus"])
    return found.select(F.col("TranscriptID").alias("id"), F.col("Species").alias("species"), F.col("TSL").cast("double").alias("level"))


@query("""SELECT 'T' || l_orderkey AS trx, 'E' || l_partkey AS exon, CAST(l_linenumber AS BIGINT) AS rank, l_partkey * 10 AS s, l_partkey * 10 + 99 AS e, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END AS strand FROM lineitem WHERE l_partkey % 6 <> 0""")
def exon_file(spark, sf_dir):
    """All lines as a file of exons: rows with a missing value go."""
    k = F.col("l_partkey")
    coding = F.when(k % 6 != 0, k * 10)
    x = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("G"), "l_suppkey").alias("GeneID"), F.concat(F.lit("T"), "l_orderkey").alias("TranscriptID"), F.concat(F.lit("P"), "l_orderkey").alias("ProteinID"), F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1).alias("Strand"), F.concat(F.lit("E"), k).alias("ExonID"),
        (k * 10).alias("ExonRegionStart"), (k * 10 + 99).alias("ExonRegionEnd"), F.col("l_linenumber").alias("ExonRank"), coding.alias("cDNA_CodingStart"), coding.alias("cDNA_CodingEnd"), coding.alias("GenomicCodingStart"), (coding + 99).alias("GenomicCodingEnd"), F.lit(0).alias("StartPhase"), F.lit(-1).alias("EndPhase"),
    )
    found = tables.read_exons(spark, _written_csv(spark, x, "\t"))
    return found.select(F.col("TranscriptID").alias("trx"), F.col("ExonID").alias("exon"), F.col("ExonRank").alias("rank"), F.col("ExonRegionStart").alias("s"), F.col("ExonRegionEnd").alias("e"), F.col("Strand").alias("strand"))


@query("""SELECT 'T' || p_partkey * 7 AS trx, 'E' || p_partkey AS exon, p_partkey % 5 AS rank, p_partkey AS s, p_partkey + len(p_name) - 1 AS e, p_name AS seq FROM part""")
def user_exon_file(spark, sf_dir):
    """All parts as a file of exons of users."""
    user, _ = _user_tables(spark, sf_dir)
    columns = [f.name for f in tables.USER_EXONS]
    found = tables.read_user_exons(spark, _written_csv(spark, user.select(columns)))
    return found.select(F.col("TranscriptID").alias("trx"), F.col("ExonID").alias("exon"), F.col("ExonRank").alias("rank"), F.col("ExonRegionStart").alias("s"), F.col("ExonRegionEnd").alias("e"), F.col("NucleotideSequence").alias("seq"))


@query(f"""WITH {_LEAST.replace('RECURSIVE', _BILLS)}
SELECT node AS id, x AS kept FROM r WHERE node <> x""")
def representatives(spark, sf_dir):
    """All but the least of each group of linked customers and prices."""
    o = load(spark, sf_dir, "orders")
    return components.representatives(o.select(F.col("o_custkey").alias("a"), (1000000 + F.floor("o_totalprice")).alias("b")))


@query("""SELECT 'node' AS kind, CAST(p_partkey AS VARCHAR) AS a, p_name AS b, CAST(p_size AS VARCHAR) AS value FROM part
UNION ALL SELECT 'edge', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR) FROM lineitem""")
def gml_round_trip(spark, sf_dir):
    """Parts as nodes and lines as edges of a graph, written as GML and read back."""
    path = f"{shared_folder(spark)}/gml-{uuid.uuid4().hex}"
    nodes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_size").alias("size"))
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("line"))
    sinks.write_gml(nodes, edges, path)
    back, links = tables.read_gml(spark, path)
    one = back.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("attributes.size").alias("value"))
    return one.unionByName(links.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("attributes.line").alias("value")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
