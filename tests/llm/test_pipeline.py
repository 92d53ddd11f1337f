"""The pipeline's stages one by one on the smallest documents."""

import collections

import corpus_pipeline


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    before = docs.count()
    kept = corpus_pipeline.identify_language(spark, docs, small)
    assert kept.columns == docs.columns and 0.95 * before <= kept.count() <= before
    single = corpus_pipeline.drop_near_duplicates(spark, docs, small).cache()
    assert single.columns == docs.columns and single.count() == single.select("doc_id").distinct().count() < before
    cut = corpus_pipeline.cut_repeats(spark, single, small).cache()
    assert cut.columns == docs.columns and cut.count() == single.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    mixed = corpus_pipeline.mix_sources(spark, cut, small)
    assert mixed.columns == docs.columns
    assert max(collections.Counter(r.doc_id for r in mixed.collect()).values()) <= 2


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    full = collections.Counter()
    for r in rows:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 4096 and len(full) == -(-sum(full.values()) // 4096)
    assert [name for name, _ in corpus_pipeline.STAGES][0].startswith("language") and corpus_pipeline.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, `key` int, h string"
PROSE = "the quick brown fox jumps over the lazy dog and runs into the wide green wood "
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, PROSE * 3), (3, PROSE * 3), (4, PROSE * 400), (5, "12 34 !!"), (None, PROSE + "alone"), (None, "und der Hund lief schnell nach Hause"), (6, "x" * 500)]


def test_odd_rows_and_clashing_columns(spark, small):
    """Nulls, empty and long texts, repeated rows and columns of other names pass every stage."""
    docs = spark.createDataFrame([(i, t, "en", ("a", None)[k % 2], len(t or ""), "f", "s", 1, "h") for k, (i, t) in enumerate(ODD)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == SCHEMA.replace("`", "").replace(",", "").split()[::2], name
        assert docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0


def test_empty_table(spark, small):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0, name


def test_mixture_repeats_the_same_rows(spark, small):
    """Rows that share doc_id, source and size are told apart, and reruns agree."""
    words = ["one two three", "four five six", "seven eight nine"]
    docs = spark.createDataFrame([(1, words[i % 3], "en", "abc"[i % 2], 1, "f", "s", i, "h") for i in range(60)], SCHEMA)
    runs = [sorted((r.text, r.source, r.key) for r in corpus_pipeline.mix_sources(spark, docs.repartition(n), small).collect()) for n in (2, 5)]
    assert runs[0] == runs[1] and max(collections.Counter(runs[0]).values()) <= 2
