"""From exon rows to whole proteins: coding parts, shared codons, complete transcripts, equal exons.

Rows hold GeneID, TranscriptID, ExonID, Strand, ExonRank, the region and coding
coordinates, cDNA_CodingStart, cDNA_CodingEnd, StartPhase, EndPhase and seq, the
sequence of the exon region in reading direction.  A phase of -1 is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..storage import materialize, small
from . import components, relational

TRANSCRIPT = ("GeneID", "TranscriptID")
ORDER = ("ExonRank", "ExonID")


def once(rows: DataFrame) -> DataFrame:
    """Each exon of a transcript once, where it comes first."""
    return relational.keep_first(rows, [*TRANSCRIPT, "ExonID"], ["ExonRank", "GenomicCodingStart", "GenomicCodingEnd", "StartPhase", "EndPhase"])


def proteins(rows: DataFrame) -> DataFrame:
    """Rows with protein and incomplete.

    A codon that two exons share belongs to the later one, which borrows from
    the two exons before at most.  An exon is incomplete if its coding part
    cannot be cut out or borrowed, is no whole number of codons, or begins or
    ends the transcript within a codon; its protein is then ''.
    """
    w = Window.partitionBy(*TRANSCRIPT).orderBy(*ORDER)
    x = rows.withColumns({
        "__first": F.row_number().over(w) == 1,
        "__last": F.lead(F.lit(1)).over(w).isNull(),
        "__before": F.array_join(F.collect_list("seq").over(w.rowsBetween(-2, -1)), ""),
    })
    start, end = F.col("StartPhase"), F.col("EndPhase")
    split_start, split_end = start.isin(1, 2), end.isin(1, 2)
    length = (F.col("cDNA_CodingEnd") - F.col("cDNA_CodingStart") + 1).cast("int")
    cut = F.when(F.col("__last") | (end != -1), S.cut_cds(F.col("seq"), length, F.col("__first"), F.col("__last")))
    cut = F.when(split_end, S.trim_end(cut, end.cast("int"))).otherwise(cut)
    own = F.substring(cut, (S.bases_before(start) + 1).cast("int"), F.length(cut))
    borrowed = F.when(F.length("__before") >= start, F.concat(F.right("__before", start.cast("int")), cut))
    cut = F.when(~split_start, cut).when(F.col("__first"), own).otherwise(borrowed)
    inside = S.slice_interval(F.col("seq"), F.col("Strand"), F.col("ExonRegionStart"), F.col("ExonRegionEnd"), F.col("GenomicCodingStart"), F.col("GenomicCodingEnd"))
    x = x.withColumn("__cds", F.when((start == -1) & (end == -1), inside).otherwise(cut))
    open_ended = F.when(F.col("__last"), split_end).when(F.col("__first"), split_start).otherwise(F.lit(False))
    bad = F.col("__cds").isNull() | F.coalesce(open_ended, F.lit(False)) | (F.length("__cds") % 3 != 0)
    x = x.withColumn("incomplete", F.coalesce(bad, F.lit(True)))
    return x.withColumn("protein", F.when(F.col("incomplete"), "").otherwise(S.translate_codons(F.col("__cds")))).drop("__first", "__last", "__before", "__cds")


def phase_faults(rows: DataFrame) -> DataFrame:
    """Rows with fault: the rank does not rise, or declared phases do not follow from the row before and the coding length."""
    w = Window.partitionBy(*TRANSCRIPT).orderBy(*ORDER)
    start, end, before = F.col("StartPhase"), F.col("EndPhase"), F.lag("EndPhase").over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    from_ = F.when(first, F.lit(0)).otherwise(before)
    expected = (from_ + F.col("cDNA_CodingEnd") - F.col("cDNA_CodingStart") + 1) % 3
    bad = (
        (from_ == -1)
        | S.differ(start, from_)
        | S.differ(end, expected)
        | (~first & ((start == -1) | (F.col("ExonRank") <= F.lag("ExonRank").over(w))))
        | (~last & (end == -1))
    )
    return rows.withColumn("fault", F.coalesce(bad, F.lit(True)))


def complete(rows: DataFrame, drop_unknown: bool = True) -> DataFrame:
    """Rows (with protein and incomplete) of transcripts that are whole.

    Transcripts go that hold an incomplete exon or a fault of phases, do not
    end in a stop, or (``drop_unknown``) hold an unknown residue.
    """
    relational.require(rows, "protein", "incomplete", hint="Call proteins first.")
    kept = relational.drop_incomplete(rows, "TranscriptID", list(ORDER), "protein", "incomplete")
    if drop_unknown:
        kept = relational.drop_bad_quality(kept, "TranscriptID", "protein")
    return relational.drop_groups(phase_faults(kept), ["TranscriptID"], F.col("fault")).drop("fault")


def one_of_equal_transcripts(rows: DataFrame) -> DataFrame:
    """Rows of the least of a gene's transcripts with one protein, with all their ids in TranscriptIDCluster."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "protein"))), lambda r: r["protein"]), "")
    whole = rows.groupBy(*TRANSCRIPT).agg(joined.alias("__protein"))
    same = whole.groupBy("GeneID", "__protein").agg(F.array_sort(F.collect_list("TranscriptID")).alias("__ids"))
    return rows.join(same.select("GeneID", F.col("__ids")[0].alias("TranscriptID"), F.array_join("__ids", "/").alias("TranscriptIDCluster")), list(TRANSCRIPT))


def merge_identical(rows: DataFrame, item: str, start: str = "GenomicCodingStart", end: str = "GenomicCodingEnd") -> DataFrame:
    """Rows with ``item`` the least id of equal ones in its gene, and their ids in ``item``Cluster.

    Equal are rows of one gene with the same phases, protein length and
    comparable residues, and the same coordinates where phases are known.  Rows
    of one id may differ, so ids meet as connected components.  Only rows whose
    key, by a short hash, is not alone are dealt out with their ids.
    """
    of = lambda c, phase: F.when(F.col(phase) != -1, F.col(c))
    key = F.struct("GeneID", "StartPhase", "EndPhase", of(start, "StartPhase").alias("s"), of(end, "EndPhase").alias("e"), F.length("protein").alias("n"), S.comparable(F.col("protein"), F.col("StartPhase"), F.col("EndPhase")).alias("p"))
    rows = rows.where(F.col("GeneID").isNotNull() & F.col(item).isNotNull())
    keyed = rows.select("GeneID", F.col(item).alias("__id"), F.xxhash64(key).alias("h1"), F.unhex(F.md5(F.to_json(key))).alias("h2"))
    shared = materialize(keyed.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "shared_keys")
    seen = materialize(keyed.join(small(shared), "h1", "left_semi").distinct(), "identical")
    least = seen.groupBy("h1", "h2").agg(F.min("__id").alias("__least"))
    node = lambda c: F.to_json(F.struct("GeneID", F.col(c).alias("id")))
    edges = seen.join(least, ["h1", "h2"]).select(node("__id").alias("a"), node("__least").alias("b"))
    read = lambda c: F.from_json(c, "GeneID string, id string")
    found = components.components(edges).select(read("node").alias("n"), read("component").alias("c")).select("n.GeneID", F.col("n.id").alias(item), F.col("c.id").alias("__kept"))
    labels = found.groupBy("GeneID", "__kept").agg(F.array_join(F.array_sort(F.collect_set(item)), "/").alias(f"{item}Cluster"))
    names = materialize(found.join(labels, ["GeneID", "__kept"]), "identical_ids")
    joined = rows.join(small(names), ["GeneID", item], "left").withColumn(f"{item}Cluster", F.coalesce(f"{item}Cluster", item))
    return joined.withColumn(item, F.coalesce("__kept", item)).drop("__kept")


def read(rows: DataFrame, drop_unknown: bool = True) -> DataFrame:
    """All of it: whole transcripts, one of each equal set, with equal exons under one id."""
    whole = materialize(complete(materialize(proteins(once(rows)), "exon_proteins"), drop_unknown), "complete")
    return materialize(merge_identical(materialize(one_of_equal_transcripts(whole), "transcripts"), "ExonID"), "exons")


def merge_runs(sub: DataFrame) -> DataFrame:
    """Sub-exons that only appear together, side by side in one exon, become one.

    ``sub`` holds GeneID, TranscriptID, ExonID, ExonIDCluster, SubexonID,
    SubexonIDCluster, Strand, lo, hi, IntervalNumber, SubexonRank, StartPhase,
    EndPhase, seq, protein and TranscriptFraction.  Candidates are no union of
    equal sub-exons, in one exon, next to each other and in the same share of
    transcripts.  The run is named by its first member and the interval numbers
    of the others, has texts and outer ends of its members as the least
    transcript has them, and rank and interval number of the second.
    """
    exon = ["GeneID", "ExonIDCluster"]
    first = F.min_by(F.struct("lo", "hi", "SubexonRank", "IntervalNumber", "Strand", "StartPhase", "EndPhase", "seq", "protein", "TranscriptFraction", "TranscriptID"), F.struct("TranscriptID", "SubexonRank"))
    alone = sub.groupBy("GeneID", "SubexonIDCluster").agg(F.count_distinct("ExonIDCluster").alias("__exons"))
    parts = sub.groupBy(*exon, "SubexonIDCluster").agg(first.alias("v")).select(*exon, "SubexonIDCluster", "v.*").join(alone, ["GeneID", "SubexonIDCluster"])
    w = Window.partitionBy(*exon).orderBy(F.col("lo") * F.col("Strand"), "SubexonIDCluster")
    free = ~F.contains("SubexonIDCluster", F.lit("/")) & (F.col("__exons") == 1)
    parts = parts.withColumn("__free", free)
    beside = F.when(F.col("Strand") == 1, F.col("lo") - F.lag("hi").over(w) == 1).otherwise(F.lag("lo").over(w) - F.col("hi") == 1)
    joins = F.col("__free") & F.lag("__free").over(w) & beside & (F.col("TranscriptFraction") == F.lag("TranscriptFraction").over(w))
    runs = parts.withColumn("__run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    members = F.array_sort(F.collect_list(F.struct((F.col("lo") * F.col("Strand")).alias("at"), "SubexonIDCluster", "lo", "hi", "SubexonRank", "IntervalNumber", "StartPhase", "EndPhase", "seq", "protein")))
    runs = runs.groupBy(*exon, "__run").agg(members.alias("m")).where("size(m) > 1")
    number = lambda m: F.element_at(F.split(m["SubexonIDCluster"], "_"), -1)
    name = F.concat_ws("_", F.col("m")[0]["SubexonIDCluster"], F.transform(F.slice("m", 2, F.size("m")), number))
    text = lambda c: F.array_join(F.transform("m", lambda m: m[c]), "")
    changed = ("SubexonID", "SubexonIDCluster", "lo", "hi", "SubexonRank", "IntervalNumber", "StartPhase", "EndPhase", "seq", "protein")
    new = runs.select(
        "GeneID", "m", name.alias("SubexonID"), name.alias("SubexonIDCluster"), F.array_min("m.lo").alias("lo"), F.array_max("m.hi").alias("hi"), F.col("m")[1]["SubexonRank"].alias("SubexonRank"),
        F.col("m")[1]["IntervalNumber"].alias("IntervalNumber"), F.col("m")[0]["StartPhase"].alias("StartPhase"), F.element_at("m", -1)["EndPhase"].alias("EndPhase"), text("seq").alias("seq"), text("protein").alias("protein"),
    )
    renamed = new.select("GeneID", F.explode("m.SubexonIDCluster").alias("__member"), *(F.col(c).alias(f"__{c}") for c in changed))
    x = sub.join(renamed.withColumnRenamed("__member", "SubexonIDCluster"), ["GeneID", "SubexonIDCluster"], "left").withColumn("__was", F.col("SubexonRank"))
    x = x.withColumns({c: F.coalesce(f"__{c}", c) for c in changed}).drop(*(f"__{c}" for c in changed))
    return relational.keep_first(x, ["GeneID", "TranscriptID", "ExonID", "SubexonID"], ["__was"]).drop("__was")
