"""Presence/absence tables and what is computed from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import written

#: The classes of genes by the share of genomes that have them.
CLASSES = (("core", 0.99), ("soft_core", 0.95), ("shell", 0.15), ("cloud", 0.0))
#: The IUPAC nucleotide codes, a bit a base.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7}


def presence(rows: DataFrame, genome: str, gene: str) -> DataFrame:
    """(gene, genome): distinct pairs, the long form of the matrix."""
    return rows.select(F.col(gene).alias("gene"), F.col(genome).alias("genome")).where("gene IS NOT NULL AND genome IS NOT NULL").distinct()


def gene_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gene").agg(F.count("*").alias("n_genomes"))


def n_genomes(pairs: DataFrame) -> int:
    return pairs.select("genome").distinct().count()


def frequency_classes(pairs: DataFrame) -> DataFrame:
    """(class, n_genes) with a row for each class, empty ones too, and the total."""
    n = n_genomes(pairs)
    share = F.col("n_genomes") / F.lit(max(n, 1))
    marks = []
    above = None
    for name, least in CLASSES:
        inside = share >= least if above is None else (share >= least) & (share < above)
        marks.append(F.struct(F.lit(name).alias("class"), F.coalesce(F.sum(F.when(inside, 1)), F.lit(0)).cast("long").alias("n_genes")))
        above = least
    marks.append(F.struct(F.lit("total").alias("class"), F.count("*").alias("n_genes")))
    return gene_sizes(pairs).agg(F.array(*marks).alias("c")).select(F.inline("c"))


def frequency_histogram(pairs: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n_genes): genes by share of genomes, in ``bins`` equal bins over 0..1, the last one closed."""
    n = max(n_genomes(pairs), 1)
    return gene_sizes(pairs).select(F.least(F.floor(F.col("n_genomes") * bins / n), F.lit(bins - 1)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n_genes"))


def core_genes(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    n = n_genomes(pairs)
    return gene_sizes(pairs).where(F.col("n_genomes") >= threshold * n)


#: Items of a block; two blocks are compared in one task.
BLOCK = 256


def block_pairs(rows: DataFrame, id_col: str, n: int, block: int = BLOCK) -> DataFrame:
    """``rows`` with _i <= _j and _b, one of them: each row in a group with every block of items, so that all pairs
    meet once. ``n`` is how many there are. A matrix of n by n has n * n / 2 rows whatever is done; what a task holds
    is two blocks."""
    m = max(1, -(-n // block))
    own = F.pmod(F.xxhash64(id_col), F.lit(m)).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.struct(F.least(k, F.col("_b")).alias("i"), F.greatest(k, F.col("_b")).alias("j")))
    return rows.withColumn("_b", own).withColumn("_p", F.explode(pair)).select(*rows.columns, "_b", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"))


def _compared(pdf: pd.DataFrame, distance: np.ndarray, id_col: str) -> pd.DataFrame:
    """(a, b, distance), a < b, of a group of two blocks: pairs within a block only where it meets itself."""
    ids, own = pdf[id_col].to_numpy(), pdf["_b"].to_numpy()
    i, j = np.triu_indices(len(ids), 1)
    if pdf["_i"].iloc[0] != pdf["_j"].iloc[0]:
        i, j = i[(c := own[i] != own[j])], j[c]
    swap = ids[i] > ids[j]
    return pd.DataFrame({"a": np.where(swap, ids[j], ids[i]), "b": np.where(swap, ids[i], ids[j]), "distance": distance[i, j].astype(np.int64)})


def gene_distances(pairs: DataFrame) -> DataFrame:
    """(a, b, distance), a < b: genes in which two genomes differ, |A| + |B| - 2 |A and B|.

    Genomes are compared block by block as rows of a 0/1 matrix of the genes that any of the two blocks has.
    """
    kind = dict(pairs.dtypes)["genome"]
    sets = pairs.select("genome", F.xxhash64("gene").alias("g")).groupBy("genome").agg(F.collect_set("g").alias("genes"))
    n = n_genomes(pairs)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        _, column = np.unique(np.concatenate(pdf["genes"].tolist()), return_inverse=True)
        size = pdf["genes"].map(len).to_numpy()
        has = np.zeros((len(pdf), int(column.max()) + 1), np.float32)
        has[np.repeat(np.arange(len(pdf)), size), column] = 1
        return _compared(pdf, size[:, None] + size[None, :] - 2 * np.rint(has @ has.T).astype(np.int64), "genome")

    return block_pairs(sets, "genome", n).groupBy("_i", "_j").applyInPandas(compare, f"a {kind}, b {kind}, distance long")


def base_mask(base: Column) -> Column:
    """Four bits of the bases an IUPAC letter stands for; anything else, gaps too, stands for all."""
    out = F.lit(15)
    for letter, bits in IUPAC.items():
        out = F.when(F.upper(base) == letter, bits).otherwise(out)
    return out


def snp_distances(aligned: DataFrame) -> DataFrame:
    """(a, b, distance), a < b, from (id, seq): sites at which two aligned sequences share no base.

    Sites past the end of the shorter one do not count. Sequences are packed into a bit a base and site and compared
    block by block, so no site becomes a row. Rows of one id after the first are not compared.
    """
    kind = dict(aligned.dtypes)["id"]
    one = aligned.where(F.col("seq").isNotNull()).groupBy("id").agg(F.min("seq").alias("seq"))
    bits = np.full(256, 15, np.uint8)
    for letter, mask in IUPAC.items():
        bits[[ord(letter), ord(letter.lower())]] = mask

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        length = pdf["seq"].str.len().to_numpy()
        width = int(length.max()) if len(pdf) else 0
        masks = np.zeros((len(pdf), width), np.uint8)
        for k, s in enumerate(pdf["seq"]):
            masks[k, : length[k]] = bits[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
        packed = [np.packbits((masks >> b) & 1, axis=1) for b in range(4)]
        packed = [np.pad(p, ((0, 0), (0, -p.shape[1] % 8))).view(np.uint64) for p in packed]
        shared = np.zeros((len(pdf), len(pdf)), np.int64)
        for k in range(len(pdf)):
            alike = packed[0][k] & packed[0]
            for p in packed[1:]:
                alike |= p[k] & p
            shared[k] = np.bitwise_count(alike).sum(axis=1)
        return _compared(pdf, np.minimum(length[:, None], length[None, :]) - shared, "id")

    return block_pairs(one, "id", one.count()).groupBy("_i", "_j").applyInPandas(compare, f"a {kind}, b {kind}, distance long")


def rarefaction(pairs: DataFrame, permutations: int = 50, seed: str = "rarefaction") -> DataFrame:
    """(permutation, step, new_genes, total): genes first met as genomes are added in seeded random orders.

    The order of genomes is a hash, so reruns agree. A gene is met at the least step of its genomes.
    """
    pairs = written(pairs, "pairs")
    orders = pairs.select("genome").distinct().withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    by = Window.partitionBy("permutation").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("permutation").cast("string"), F.col("genome").cast("string"))), "genome")
    steps = written(orders.withColumn("step", F.row_number().over(by)), "steps")
    # a genome carries its step in every permutation, and a gene the least of its genomes': no row a permutation
    wide = steps.groupBy("genome").agg(F.transform(F.array_sort(F.collect_list(F.struct("permutation", "step"))), lambda x: x["step"]).alias("s"))
    least = pairs.join(wide, "genome").groupBy("gene").agg(*[F.min(F.get("s", F.lit(k))).alias(f"p{k}") for k in range(permutations)])
    met = least.select(F.posexplode(F.array(*[f"p{k}" for k in range(permutations)])).alias("k", "step")).groupBy((F.col("k") + 1).alias("permutation"), "step").agg(F.count("*").alias("new_genes"))
    every = steps.select("permutation", "step").join(met, ["permutation", "step"], "left").withColumn("new_genes", F.coalesce("new_genes", F.lit(0)))
    return every.withColumn("total", F.sum("new_genes").over(Window.partitionBy("permutation").orderBy("step")))


def power_law(curve: DataFrame, rounds: int = 100) -> tuple[float, float, float]:
    """(a, b, error of b) of mean new genes = a * step ** b by least squares; open pangenomes have b + error > -1.

    The curve has a point per genome, so it is fitted on the driver, from the log-linear solution on.
    """
    points = curve.groupBy("step").agg(F.avg("new_genes").alias("y")).where("y > 0").orderBy("step").toPandas()
    x, y = points["step"].to_numpy(float), points["y"].to_numpy(float)
    if len(x) < 3:
        return float(y[0]) if len(y) else 0.0, 0.0, 0.0
    b, log_a = np.polyfit(np.log(x), np.log(y), 1)
    theta, damp = np.array([np.exp(log_a), b]), 1e-3
    model = lambda t: t[0] * x ** t[1]
    loss = ((model(theta) - y) ** 2).sum()
    for _ in range(rounds):
        jac = np.stack([x ** theta[1], model(theta) * np.log(x)], axis=1)
        normal = jac.T @ jac
        step = np.linalg.solve(normal + damp * np.diag(np.diag(normal)), jac.T @ (y - model(theta)))
        if ((model(theta + step) - y) ** 2).sum() < loss:
            theta, damp = theta + step, damp / 4
            loss = ((model(theta) - y) ** 2).sum()
        else:
            damp *= 4
    cov = np.linalg.inv(normal) * loss / max(1, len(x) - 2)
    return float(theta[0]), float(theta[1]), float(np.sqrt(cov[1, 1]))


def genomes_of(rows: DataFrame) -> list[str]:
    """The genomes of a table in order, for the driver: they are to be the columns of another."""
    return [r[0] for r in rows.select("genome").where("genome IS NOT NULL").distinct().orderBy("genome").collect()]


def roary_table(members: DataFrame, genomes: list[str] | None = None, value: str = "orf") -> DataFrame:
    """The wide table: per gene its summary columns and one column per genome with its members, joined by ;.

    members (gene, genome, <value>, length, annotation). The columns are the genomes of the table unless the caller
    names them; rows are ordered by the number of genomes, then by gene.
    """
    genomes = genomes if genomes is not None else genomes_of(members)
    summary = members.groupBy("gene").agg(
        F.array_join(F.sort_array(F.collect_set("annotation")), ";").alias("annotation"),
        F.count_distinct("genome").alias("n_isolates"),
        F.count("*").alias("n_sequences"),
        F.round(F.count("*") / F.count_distinct("genome"), 2).alias("mean_per_isolate"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.round(F.avg("length"), 2).alias("mean_length"),
        F.mode("length", True).alias("mode_length"),
    )
    wide = members.groupBy("gene").pivot("genome", genomes).agg(F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), ";"))
    return summary.join(wide, "gene").orderBy(F.col("n_isolates").desc(), "gene")


def rtab(pairs: DataFrame, genomes: list[str] | None = None) -> DataFrame:
    """Genes by genomes as 0 and 1; the genomes are those of the table unless the caller names them."""
    genomes = genomes if genomes is not None else genomes_of(pairs)
    return pairs.groupBy("gene").pivot("genome", genomes).agg(F.lit(1)).na.fill(0)


def gene_names(genes: DataFrame) -> DataFrame:
    """(cluster_id, name): cleaned annotations; empty and repeated names become group_<cluster_id>."""
    from strandloom.functions.sequence import gene_label

    named = genes.select("cluster_id", gene_label(F.col("annotations")).alias("label"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("cluster_id"))
    return named.withColumn("k", first).select("cluster_id", F.when((F.col("label") == "") | (F.col("k") > 1), F.concat(F.lit("group_"), F.col("cluster_id").cast("string"))).otherwise(F.col("label")).alias("name"))
