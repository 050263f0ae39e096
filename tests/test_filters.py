"""Predicates on hand-made rows."""

from pyspark.sql import functions as F

from strandloom.operators import filters as P


def test_predicates(spark):
    one = spark.range(1)
    nodes = F.array(F.lit(2), F.lit(-3))
    got = one.select(
        P.long_enough(F.lit(90)), P.good_score(F.lit(99.0)), P.terminal(F.lit(0), F.lit(True)), P.on_path(F.lit(",1,2,-3,4,"), nodes), P.on_path(F.lit(",3,-2,"), nodes), P.on_path(F.lit(",12,-3,"), nodes),
        P.short_enough(F.lit(30000), F.lit(2)), P.short_enough(F.lit(30000), F.lit(3)), P.unvisited(nodes, F.lit(2)), P.alike_in_length(F.lit(98), F.lit(100)),
        P.pseudogene(F.lit(70), F.lit(100), F.lit(False), F.lit(False)), P.pseudogene(F.lit(91), F.lit(100), F.lit(True), F.lit(False)), P.pseudogene(F.lit(90), F.lit(100), F.lit(True), F.lit(False)),
        P.refound(F.lit("ACGTN"), F.lit("ACGTACGT"), F.lit(0.9)), P.refound(F.lit("NNNNN"), F.lit("ACGTACGT"), F.lit(0.9)), P.unannotated(F.lit(None).cast("double")),
    ).first()
    assert tuple(got) == (True, False, True, 1, -1, 0, True, False, False, True, True, True, False, True, False, True)


def test_joins(spark):
    colours = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "node_id int, genome_id int")
    steps = spark.createDataFrame([(0, 1, -2), (1, 2, 1)], "genome_id int, node int, next int")
    assert [tuple(r) for r in P.in_genome(steps, colours).collect()] == [(0, 1, -2)]
    genomes = spark.createDataFrame([(0, False), (1, True)], "genome_id int, is_ref boolean")
    ends = spark.createDataFrame([(1,), (-2,)], "node int")
    assert [r.node for r in P.ends_in_reference(ends, colours, genomes).collect()] == [-2]
    coords = spark.createDataFrame([(0, 1, 0, 5), (0, -2, 1, 5), (0, 2, 0, 3)], "genome_id int, node int, s int, e int")
    sizes = spark.createDataFrame([(1, 5), (2, 5)], "node_id int, size int")
    assert [tuple(r) for r in P.free_nodes(coords, sizes).collect()] == [(0, 2)]
