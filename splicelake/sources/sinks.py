"""Writers: CSV, FASTA, GML, PIR, transcript lists and JSON, each as a distributed text write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: The published list of one-letter codes of segments, in the order they are given out.
ALPHABET = (
    "%()+0123456789:<=?ABCDEFGHIJKLMNOPQRSTUVWXYZ^`abcdefghijklmn"
    "opqrstuvwxyz{|}~¼½¾¿ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæç"
    "èéêëìíîïðñòóôõö÷øùúûüýþÿĀāĂăĄąĆćĈĉĊċČčĎďĐđĒēĔĕĖėĘęĚěĜĝĞğĠġĢģ"
    "ĤĥĦħĨĩĪīĬĭĮįİıĲĳĴĵĶķĸĹĺĻļĽľĿŀŁłŃńŅņŇňŉŊŋŌōŎŏŐőŒœŔŕŖŗŘřŚśŜŝŞş"
    "ŠšŢţŤťŦŧŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽžſƠơƯưǄǅǆǇǈǉǊǋǌǍǎǏǐǑǒǓǔǕǖǗǘǙǚǛ"
    "ǜǰǱǲǳǴǵǶǷǸǹǺǻǼǽǾǿȀȁȂȃȄȅȆȇȈȉȊȋȌȍȎȏȐȑȒȓȔȕȖȗȘșȚțΓΔΘΛΞΠΣΦΨΩΪΫάέή"
    "ίΰαβγδεζηθικλμνξοπρςστυφχψωϊϋόύώϑϒϓϖϢϣϤϥϦϧϨ㐀㐁㐂㐃㐄㐅㐆㐇㐈㐉㐊㐧㐪㐫㐬㐭㐱"
    "㐴㐵㐶㞥㞦㞧㞨㞩㞪㞫㞬㞭䇂"
)


def write_csv(df: DataFrame, path: str, mode: str = "error", missing: str = "NA") -> None:
    df.write.mode(mode).csv(path, header=True, nullValue=missing)


def wrap(seq: Column, width: int = 80) -> Column:
    """Line ends after every ``width`` letters but the last."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta_lines(df: DataFrame, header: str, seq: str, width: int | None = 80) -> DataFrame:
    body = wrap(F.col(seq), width) if width else F.col(seq)
    return df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value"))


def write_fasta(df: DataFrame, path: str, header: str, seq: str, by: str | None = None, width: int | None = 80) -> None:
    """FASTA text; with ``by`` a folder for each value of that column."""
    if by is None:
        fasta_lines(df, header, seq, width).write.text(path)
    else:
        body = wrap(F.col(seq), width) if width else F.col(seq)
        df.select(by, F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value")).write.partitionBy(by).text(path)


def _attribute(name: str, value: Column, quote: bool) -> Column:
    text = F.concat(F.lit('"'), value.cast("string"), F.lit('"')) if quote else value.cast("string")
    return F.concat(F.lit(f"    {name} "), text, F.lit("\n"))


def gml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of one GML graph, in order, as (place, value).

    nodes: id, label and any attributes; edges: source, target and any attributes.
    Strings are quoted.  A consensus is left out for labels that begin with 0.
    """

    def block(df: DataFrame, kind: str, first: list[str], place: int) -> DataFrame:
        names = [*first, *(c for c in df.columns if c not in first)]
        types = dict(df.dtypes)
        parts = []
        for n in names:
            a = _attribute(n, F.col(n), types[n] == "string")
            if n == "consensus":
                a = F.when(~F.col("label").startswith("0"), a)
            parts.append(F.coalesce(a, F.lit("")))
        return df.select(F.lit(place).alias("place"), F.concat(F.lit(f"  {kind} [\n"), *parts, F.lit("  ]")).alias("value"))

    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "graph [\n  directed 1"), (3, "]")], "place int, value string")
    return ends.unionByName(block(nodes, "node", ["id", "label"], 1)).unionByName(block(edges, "edge", ["source", "target"], 2))


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    gml(nodes, edges).repartitionByRange("place").sortWithinPartitions("place", "value").select("value").write.text(path)


def segment_codes(df: DataFrame, segment: str, order: list) -> DataFrame:
    """(segment, code): a letter for each segment by first appearance; more segments than letters are an error."""
    from ..operators.relational import first_seen_index

    numbers = first_seen_index(df, segment, order)
    code = F.try_element_at(F.array(*map(F.lit, ALPHABET)), (F.col("index") + 1).cast("int"))
    return numbers.select(segment, F.coalesce(code, F.raise_error(F.lit("more segments than one-letter codes"))).alias("code"))


def pir(df: DataFrame, gene: str, trx: str, order: str, code: str, seq: str) -> DataFrame:
    """PIR records: '>P1;gene transcript codes', a line with a code for each residue, and the sequence ended by '*'."""
    rows = F.array_sort(F.collect_list(F.struct(order, code, F.replace(seq, F.lit("*"), F.lit("")).alias("s"))))
    x = df.groupBy(gene, trx).agg(rows.alias("r"))
    codes = F.array_join(F.transform("r", lambda v: v[code]), "")
    notes = F.array_join(F.transform("r", lambda v: F.repeat(v[code], F.length(v["s"]))), "")
    body = F.array_join(F.transform("r", lambda v: v["s"]), "")
    return x.select(gene, trx, F.concat(F.lit(">P1;"), gene, F.lit(" "), trx, F.lit(" "), codes, F.lit("\n"), notes, F.lit("\n"), body, F.lit("*")).alias("value"))


def transcript_lines(df: DataFrame, gene: str, path: str) -> DataFrame:
    """A line for each gene: the gene and its coded paths, sorted."""
    return df.groupBy(gene).agg(F.concat_ws(" ", F.first(gene), F.array_join(F.array_sort(F.collect_list(path)), " ")).alias("value"))


def coded_paths(segments: DataFrame, residues: DataFrame, order: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes of segments (node, code), PIR records (gene, trx, value) and a line of coded paths for each gene (gene, value), of one family.

    ``segments`` holds (gene, trx, node, rk), ``residues`` (gene, node,
    aligned).  Codes are given out by first appearance in ``order``, by default
    by gene, transcript and rank; a segment without residues has none in PIR.
    """
    codes = materialize(segment_codes(segments, "node", order or ["gene", "trx", "rk"]), "codes")
    text = F.coalesce(F.replace("aligned", F.lit("-"), F.lit("")), F.lit("")).alias("seq")
    rows = segments.join(codes, "node").join(residues.select("gene", "node", "aligned"), ["gene", "node"], "left").select("gene", "trx", "rk", "code", text)
    rows = materialize(rows, "coded_rows")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "code"))), lambda r: r["code"]), "").alias("path")
    return codes, pir(rows, "gene", "trx", "rk", "code", "seq"), transcript_lines(rows.groupBy("gene", "trx").agg(path), "gene", "path")


def write_coded_paths(segments: DataFrame, residues: DataFrame, folder: str) -> None:
    """The three tables of ``coded_paths`` as folders of text: s_exons (tab-separated), pir and transcripts."""
    codes, records, lines = coded_paths(segments, residues)
    codes.write.csv(f"{folder}/s_exons", sep="\t", quote="")
    records.select("value").write.text(f"{folder}/pir")
    lines.select("value").write.text(f"{folder}/transcripts")


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
