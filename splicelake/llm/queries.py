"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fragments, html_text, language, licenses, mixing, neighbours, packing, periodic, pieces, quality, records, simhash, suffixes
from ._runtime import load

TOKENIZER = "word_bpe_49k.json"
BYTES_TOKENIZER, PIECES_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path())


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_and_read_back(load(spark, sf_dir, "documents"), tokenizer_path())


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).drop("source", "copies")


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(load(spark, sf_dir, "documents"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(load(spark, sf_dir, "documents")).drop("proportions")


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.mark(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(load(spark, sf_dir, "embeddings"))


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.render(load(spark, sf_dir, "pages"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents")).drop("spans")


def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.align(load(spark, sf_dir, "documents"), tokenizer_path(BYTES_TOKENIZER), tokenizer_path(PIECES_MODEL))


def plant_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one document of ten is made periodic from a word on, as crc32 of its doc_id says.

    A null doc_id plants nothing; a null text stays null.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(h / 10)

    def periodic_words(x: Column) -> Column:
        at = lambda i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])
        return F.array_join(F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.get(x["words"], at(i).cast("int"))), " ")

    # a variable of a lambda is worked out once, not for every word
    one = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.size(w).alias("n"), (g % F.size(w)).alias("a")))
    one = F.transform(one, lambda x: F.struct(x["words"].alias("words"), x["n"].alias("n"), x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8))).alias("p")))
    text = F.element_at(F.transform(one, periodic_words), 1)
    return docs.select("doc_id", F.when((h % 10 == 0) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0), text).otherwise(F.col("text")).alias("text"))


def op12_synchronising_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(plant_periods(load(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("first"), (-r["period"]).alias("least"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    start, length, period = -F.col("m.first"), F.col("m.length"), -F.col("m.least")
    milli = F.expr("(1000 * m.length) div -m.least")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(load(spark, sf_dir, "documents"), tokenizer_path(PIECES_MODEL), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_binary_records": op2_binary_records,
        "op3_source_mixing": op3_source_mixing,
        "op4_compression_bands": op4_compression_bands,
        "op5_language_mixture": op5_language_mixture,
        "op6_suffix_repeats": op6_suffix_repeats,
        "op7_cross_polytope": op7_cross_polytope,
        "op8_html_layout": op8_html_layout,
        "op9_simhash_components": op9_simhash_components,
        "op10_license_rules": op10_license_rules,
        "op11_fragment_alignment": op11_fragment_alignment,
        "op12_synchronising_runs": op12_synchronising_runs,
        "op13_merge_rounds": op13_merge_rounds,
    }


#: The mixture in SQL: the same hash, strata and order of documents.
_MIXING_SQL = """
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
       CAST('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY 1),
wt AS (SELECT *, [3e0, 1e0, 2e0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, 2e0 * source_size AS cap FROM src),
lv AS (SELECT *, (1.5e0 * (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
          / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
cl AS (SELECT *, bool_and(cap <= level * w) OVER (ORDER BY cap / w, source IS NULL, source ROWS UNBOUNDED PRECEDING) AS clamped FROM lv),
wa AS (SELECT *, (SELECT arg_min(level, (cap / w, source IS NULL, source)) FROM cl WHERE NOT clamped) AS water FROM cl),
aim AS (SELECT source, source_size, n, CASE WHEN clamped THEN cap ELSE least(cap, water * w) END AS target FROM wa),
fr AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aim),
x AS (SELECT doc_id, s.source, size, h, source_size, target, whole, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0e0 END AS fraction,
      h % greatest(1, CAST(ceil(n / 2000e0) AS BIGINT)) AS stratum FROM sized s JOIN fr ON s.source IS NOT DISTINCT FROM fr.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source, stratum ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, fraction * sum(size) OVER (PARTITION BY source, stratum) AS goal FROM x),
f AS (SELECT *, upto <= goal AS first, goal - coalesce(max(CASE WHEN upto <= goal THEN upto END) OVER (PARTITION BY source, stratum), 0) AS gap FROM r),
o AS (SELECT *, CASE WHEN NOT first THEN abs(size - gap) END AS off FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY off NULLS LAST, h, doc_id, size) AS near FROM o)
SELECT doc_id, size, source_size, target, CAST(least(whole + CASE WHEN first OR (near = 1 AND off < abs(gap)) THEN 1 ELSE 0 END, 2) * size AS BIGINT) AS taken FROM p"""


#: Repeats by brute force: every window of 100 bytes, as hex, through md5.
_REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
mk AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again),
gr AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mk),
sp AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM gr GROUP BY 1, 2),
ed AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM sp UNION ALL SELECT d.doc_id, coalesce(max(b), 0), max(n) FROM d LEFT JOIN sp ON d.doc_id = sp.doc_id GROUP BY 1),
ke AS (SELECT ed.doc_id, string_agg(substr(x, CAST(2 * f + 1 AS BIGINT), CAST(2 * (t - f) AS BIGINT)), '' ORDER BY f) AS kept FROM ed JOIN d USING (doc_id) GROUP BY 1),
ct AS (SELECT doc_id, count(*) AS s, sum(b - a) AS r FROM sp GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN ke USING (doc_id) LEFT JOIN ct USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": _MIXING_SQL, "op6_suffix_repeats": _REPEATS_SQL}
