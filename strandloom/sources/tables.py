"""GFA, GFF3, search hits, matrices, trees, variants and graphs as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import qualifier


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (name, seq, genomes) and links (src, src_strand, dst, dst_strand, overlap) of a GFA file; genomes are
    the colours of a segment's tag CO:Z:, null without one."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    seg = rows.where(F.get("f", F.lit(0)) == "S").select(F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("seq"), F.expr("substr(get(filter(f, x -> startswith(x, 'CO:Z:')), 0), 6)").alias("g")).select("name", "seq", F.split("g", ",").alias("genomes"))
    cols = ("src", "src_strand", "dst", "dst_strand", "overlap")
    return seg, rows.where(F.get("f", F.lit(0)) == "L").select(*[F.get("f", F.lit(i + 1)).alias(c) for i, c in enumerate(cols)])


def gfa_lines(nodes: DataFrame, links: DataFrame, overlap: int) -> DataFrame:
    """GFA text: nodes (node_id, seq, and if it is there genomes: text between commas), links (src, dst) between signed
    nodes."""
    sign = lambda c: F.when(F.col(c) > 0, "+").otherwise("-")
    head = nodes.sparkSession.createDataFrame([("H\tVN:Z:1.0",)], "value string")
    seg = nodes.select(F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), "seq", *([F.concat(F.lit("CO:Z:"), "genomes")] if "genomes" in nodes.columns else [])).alias("value"))
    lin = links.select(F.concat_ws("\t", F.lit("L"), F.abs("src").cast("string"), sign("src"), F.abs("dst").cast("string"), sign("dst"), F.lit(f"{overlap}M")).alias("value"))
    return head.unionByName(seg).unionByName(lin)


def read_diamond(spark: SparkSession, path: str) -> DataFrame:
    """(query, hit, bitscore, title) of a tab-separated protein search."""
    return spark.read.csv(path, sep="\t", schema="query string, hit string, bitscore double, title string")


def read_hmmer(spark: SparkSession, path: str) -> DataFrame:
    """(query, hit, bitscore, title) of a HMMER table: blank-separated, # begins a comment."""
    f = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+", 19).alias("f"))
    return f.select(F.get("f", F.lit(2)).alias("query"), F.get("f", F.lit(0)).alias("hit"), F.get("f", F.lit(5)).cast("double").alias("bitscore"), F.get("f", F.lit(18)).alias("title"))


def gff3_lines(genes: DataFrame) -> DataFrame:
    """(isolate, value): GFF3 CDS lines in order, one row an isolate; write partitioned by isolate.

    genes (isolate, contig, start, end, strand as + or -, id, name, product); coordinates from 1, inclusive.
    """
    attrs = F.concat(F.lit("ID="), qualifier(F.col("id")), F.lit(";gene="), qualifier(F.col("name")), F.lit(";product="), qualifier(F.col("product")))
    line = F.concat_ws("\t", "contig", F.lit("strandloom"), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("0"), attrs)
    each = genes.select("isolate", F.struct("contig", "start", "end", line.alias("line")).alias("x"))
    return each.groupBy("isolate").agg(F.concat(F.lit("##gff-version 3\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")).alias("value"))


def phylip_lines(distances: DataFrame, names: DataFrame) -> DataFrame:
    """(row, value): a square PHYLIP matrix from (a, b, distance), a < b, and names (id)."""
    both = distances.select("a", "b", "distance").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(names.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast(dict(distances.dtypes)["distance"]).alias("distance")))
    return both.groupBy("a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "distance"))), lambda x: x["distance"].cast("string")), "\t").alias("v")).select(F.col("a").alias("row"), F.concat(F.col("a").cast("string"), F.lit("\t"), "v").alias("value"))


def neighbour_joining(names: list[str], dist: list[list[float]]) -> str:
    """Newick text of the neighbour-joining tree of a few hundred genomes; a matrix of genomes is small, so it is
    built on the driver."""
    if len(names) < 3:
        return "(" + ",".join(f"{n}:{(dist[0][1] / 2 if len(names) == 2 else 0):g}" for n in names) + ");"
    live = dict(enumerate(names))
    d = {(i, j): float(dist[i][j]) for i in live for j in live}
    new = len(names)
    while len(live) > 3:
        ids = sorted(live)
        total = {i: sum(d[i, j] for j in ids) for i in ids}
        n = len(ids)
        _, a, b = min(((n - 2) * d[i, j] - total[i] - total[j], i, j) for x, i in enumerate(ids) for j in ids[x + 1 :])
        la = d[a, b] / 2 + (total[a] - total[b]) / (2 * (n - 2))
        lb = d[a, b] - la
        text = f"({live.pop(a)}:{la:g},{live.pop(b)}:{lb:g})"
        for k in live:
            d[new, k] = d[k, new] = (d[a, k] + d[b, k] - d[a, b]) / 2
        d[new, new] = 0.0
        live[new] = text
        new += 1
    x, y, z = sorted(live)
    lengths = ((d[x, y] + d[x, z] - d[y, z]) / 2, (d[x, y] + d[y, z] - d[x, z]) / 2, (d[x, z] + d[y, z] - d[x, y]) / 2)
    return "(" + ",".join(f"{live[k]}:{v:g}" for k, v in zip((x, y, z), lengths)) + ");"


def variants(aligned: DataFrame) -> DataFrame:
    """(gene, site, ref, alts, genotypes): alignment columns with more than one base; aligned (gene, id, seq).

    Sites count from 1, the reference is the base of the smallest id, gaps and N are no bases.
    """
    sites = aligned.select("gene", "id", F.posexplode(F.split(F.upper("seq"), "")).alias("site", "base")).where("base <> ''")
    called = F.when(F.col("base").isin("A", "C", "G", "T"), F.col("base"))
    by_site = sites.groupBy("gene", (F.col("site") + 1).alias("site")).agg(F.sort_array(F.collect_set(called)).alias("bases"), F.min_by(called, F.when(called.isNotNull(), F.col("id"))).alias("ref"), F.array_sort(F.collect_list(F.struct("id", called.alias("base")))).alias("calls")).where(F.size("bases") > 1)
    alts = F.array_except("bases", F.array("ref"))
    return by_site.withColumn("alts", alts).select("gene", "site", "ref", "alts", F.transform("calls", lambda c: F.struct(c["id"].alias("id"), F.when(c["base"] == F.col("ref"), 0).otherwise(F.nullif(F.array_position("alts", c["base"]), F.lit(0))).cast("int").alias("gt"))).alias("genotypes"))


def vcf_lines(found: DataFrame) -> DataFrame:
    """(gene, site, value): VCF body lines of ``variants``."""
    gts = F.array_join(F.transform("genotypes", lambda g: F.coalesce(g["gt"].cast("string"), F.lit("."))), "\t")
    return found.select("gene", "site", F.concat_ws("\t", F.col("gene").cast("string"), F.col("site").cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), gts).alias("value"))


def core_alignment(aligned: DataFrame, genes: DataFrame, isolates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concatenated alignment (id, seq) of genes, and their places (gene, start, end) from 1.

    aligned (gene, id, seq): of several sequences of an isolate the one with fewest gaps counts, a missing one is gaps.
    """
    best = aligned.join(genes, "gene", "left_semi").groupBy("gene", "id").agg(F.min_by("seq", F.struct(F.length("seq") - F.length(F.replace("seq", F.lit("-"), F.lit(""))), "seq")).alias("seq"))
    widths = best.groupBy("gene").agg(F.max(F.length("seq")).alias("w"))
    upto = Window.orderBy("gene").rowsBetween(Window.unboundedPreceding, 0)  # a row a gene
    places = widths.withColumn("end", F.sum("w").over(upto)).select("gene", (F.col("end") - F.col("w") + 1).alias("start"), "end", "w")
    total = int(places.agg(F.max("end")).first()[0] or 0)
    own = isolates.select("id").distinct().join(best.join(places, "gene"), "id", "left")
    listed = own.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "seq")))).alias("p"))
    # the genes an isolate has, in order, with gaps up to each
    spelled = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.repeat(F.lit("-"), (x["s"] - 1 - a["at"]).cast("int")), x["seq"]).alias("out")))
    return listed.select("id", F.rpad(spelled["out"], total, "-").alias("seq")), places.drop("w")


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): GML text, a row a node or edge; write it in the order of ``part``: head, nodes, edges, end.

    nodes (node, label, size, ...), edges (u, v, n_genomes, ...); further columns become attributes of their names,
    text in quotes, with " as &quot; and ] as &#93;.
    """

    def attribute(df, name):
        kind = dict(df.dtypes)[name]
        if kind in ("string", "boolean") or kind.startswith(("array", "struct")):
            text = F.col(name) if kind == "string" else F.col(name).cast("string")
            return F.concat(F.lit(f'    {name} "'), F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit("&quot;")), F.lit("]"), F.lit("&#93;")), F.lit('"'))
        return F.concat(F.lit(f"    {name} "), F.coalesce(F.col(name).cast("string"), F.lit("0")))

    head = nodes.sparkSession.createDataFrame([(0, "graph ["), (3, "]")], "part int, value string")
    shown = [c for c in nodes.columns if c != "node"]
    n = nodes.select(F.lit(1).alias("part"), F.concat_ws("\n", F.lit("  node ["), F.concat(F.lit("    id "), F.col("node").cast("string")), *[attribute(nodes, c) for c in shown], F.lit("  ]")).alias("value"))
    own = [(c, "size" if c == "n_genomes" else c) for c in edges.columns if c not in ("u", "v")]
    named = edges.select("u", "v", *[F.col(c).alias(x) for c, x in own])
    e = named.select(F.lit(2).alias("part"), F.concat_ws("\n", F.lit("  edge ["), F.concat(F.lit("    source "), F.col("u").cast("string")), F.concat(F.lit("    target "), F.col("v").cast("string")), *[attribute(named, x) for _, x in own], F.lit("  ]")).alias("value"))
    return head.unionByName(n).unionByName(e)


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes) and edges (source, target, attributes) of a GML file, attributes as a map of texts.

    A file is cut at its blocks, which lines of ``]`` end, so nodes and edges are read in parallel."""
    blocks = spark.read.option("lineSep", "]").text(path).select(F.regexp_extract("value", r"(?s)(node|edge)\s*\[\s*(.*)$", 1).alias("kind"), F.regexp_extract("value", r"(?s)(node|edge)\s*\[\s*(.*)$", 2).alias("body")).where("kind <> ''")
    pairs = F.transform(F.regexp_extract_all("body", F.lit(r'(?m)^\s*\w+ +(?:"[^"]*"|\S+)'), 0), lambda x: F.struct(F.regexp_extract(x, r"(\w+)", 1).alias("k"), F.replace(F.replace(F.regexp_replace(F.regexp_extract(x, r"(?s)\w+ +(.*)$", 1), '^"|"$', ""), F.lit("&quot;"), F.lit('"')), F.lit("&#93;"), F.lit("]")).alias("v")))
    rows = blocks.select("kind", F.map_from_entries(pairs).alias("a"))
    rest = lambda *keys: F.map_filter("a", lambda k, v: ~k.isin(*keys)).alias("attributes")
    nodes = rows.where("kind = 'node'").select(F.col("a")["id"].alias("id"), rest("id"))
    return nodes, rows.where("kind = 'edge'").select(F.col("a")["source"].alias("source"), F.col("a")["target"].alias("target"), rest("source", "target"))


# The head and the end of an EMBL header.
EMBL_HEAD = "ID   Genome standard; DNA; PRO; 1234 BP.\nXX\nFH   Key             Location/Qualifiers\nFH"
EMBL_END = "XX\nSQ   \n//"


def embl_header(places: DataFrame) -> DataFrame:
    """(part, value): EMBL feature lines of the genes of a concatenated alignment; places (gene, start, end)."""
    head = places.sparkSession.createDataFrame([(0, EMBL_HEAD), (2, EMBL_END)], "part int, value string")
    name = F.col("gene").cast("string")
    named = [F.concat(F.lit(f'FT                   /{q}="'), name, F.lit('"')) for q in ("label", "locus_tag")]
    at = F.concat(F.lit("FT   feature         "), F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"))
    return head.unionByName(places.select(F.lit(1).alias("part"), F.concat_ws("\n", at, *named).alias("value")))


def graph_colours(placed_nodes: DataFrame) -> DataFrame:
    """(node, genomes): what a GFA of a coloured graph carries as the tag CO:Z: of its segments; placed_nodes
    (node_id, genome_id)."""
    return placed_nodes.groupBy(F.abs("node_id").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("genome_id")), lambda g: g.cast("string")), ",").alias("genomes"))
