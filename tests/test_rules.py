"""Rules and detectors on transactions made by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import clustering, components, features, graph, merge, mixing, resolve, series
from ledgerloom.operators import transactions as tx

SIDE = "block_num long, position long, txo_id long, vout long, node_id long, value long, reuse long"


def sides(spark, ins, outs, start=0):
    """ins: (node, value[, reuse]); outs too, in vout order from start."""
    rows = lambda xs, at: [(1, 1, 100 + i, at + i, x[0], x[1], x[2] if len(x) > 2 else None) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows(ins, 0), SIDE), spark.createDataFrame(rows(outs, start), SIDE)


def detect(spark, rule, ins, outs, start=0):
    i, o = sides(spark, ins, outs, start)
    got = tx.features(i, o).select(F.coalesce(rule, F.lit(False))).collect()
    return got[0][0]


def ids(spark, rule, ins, outs):
    i, o = sides(spark, ins, outs)
    got = clustering.same_owner(tx.assemble(i, o), [rule]).collect()
    return sorted(got[0].ids) if got else None


def nodes(n, value, first=0):
    return [(first + k, value) for k in range(n)]


M = 10_000_000


@pytest.mark.parametrize(
    "rule,ins,outs,start,want",
    [
        (mixing.joinmarket, nodes(3, 20), [(4, 10), (5, 10), (6, 10), (7, 3)], 0, True),
        (mixing.joinmarket, [(1, 20), (2, 20), (2, 9)], [(4, 10), (5, 10), (6, 10), (7, 3)], 0, False),
        (mixing.wasabi_1_0, nodes(5, 2 * M), [*nodes(5, M, 10), *((20 + k, 7 + k) for k in range(5))], 0, True),
        (mixing.wasabi_1_0, nodes(5, 2 * M), [*nodes(5, 12_000_000, 10), *((20 + k, 7 + k) for k in range(5))], 0, False),
        (mixing.wasabi_1_0, nodes(5, 2 * M), [*nodes(5, M, 10), *((20 + k, 7 + k) for k in range(7))], 0, False),
        (mixing.wasabi_1_1, nodes(5, 2 * M), [*nodes(5, M, 10), *((20 + k, 7 + k) for k in range(6))], 0, True),
        (mixing.wasabi_1_1, nodes(5, 2 * M), [*nodes(5, M, 10), *((20 + k, 7 + k) for k in range(7))], 0, False),
        (mixing.wasabi_1_1, nodes(5, 2 * M), [*nodes(5, M, 10), (19, 2 * M), *((20 + k, 7 + k) for k in range(6))], 0, True),
        (mixing.wasabi_2, nodes(50, 5000), nodes(6, 5000, 100), 0, True),
        (mixing.wasabi_2, nodes(50, 5000), nodes(4, 5000, 100), 0, False),
        (mixing.wasabi_2, nodes(50, 4999), nodes(6, 5000, 100), 0, False),
        (mixing.whirlpool_tx0, [(1, 900_000)], [(2, 100_005), (3, 100_005), (4, 5_000), (5, 777)], 1, True),
        (mixing.whirlpool_tx0, [(1, 900_000)], [(2, 100_005), (3, 100_005), (4, 5_000), (5, 777)], 0, False),
        (mixing.whirlpool_tx0, [(1, 900_000)], [(2, 100_005), (3, 100_005), (4, 50_000), (5, 777)], 1, False),
        (mixing.whirlpool, [(1, 100_000), (2, 100_000), (3, 100_500), (4, 100_600), (5, 100_700)], nodes(5, 100_000, 10), 0, True),
        (mixing.whirlpool, nodes(5, 100_000), nodes(5, 100_000, 10), 0, False),
        (mixing.big, nodes(5, 9), [(20 + k, k + 1) for k in range(10)], 0, True),
        (mixing.big, nodes(5, 9), [(20 + k, k + 1) for k in range(9)], 0, False),
        (mixing.big, nodes(1, 9), [(20 + k, k + 1) for k in range(100)], 0, False),
    ],
)
def test_detectors(spark, rule, ins, outs, start, want):
    assert detect(spark, rule(), ins, outs, start) is want


def test_mode_takes_the_least_of_several(spark):
    i, o = sides(spark, [(1, 9)], [(2, 5), (3, 5), (4, 3), (5, 3)])
    row = tx.features(i, o).first()
    assert (row.mode_value, row.mode_count) == (3, 2)
    assert [(x.value, x["count"]) for x in row.output_values] == [(3, 2), (5, 2)]


def test_features_without_a_side(spark):
    i, o = sides(spark, [(1, 9), (1, 4)], [])
    row = tx.features(i, o).first()
    assert (row.num_inputs, row.num_input_ids, row.num_outputs, row.mode_count, row.output_values) == (2, 1, 0, None, [])
    assert tx.features(i, o).where(mixing.joinmarket()).count() == 0 and mixing.flags(tx.features(i, o)).count() == 0


LATE = 5000


@pytest.mark.parametrize(
    "rule,ins,outs,want",
    [
        (lambda: clustering.common_inputs(), [(1, 5), (2, 5), (2, 7)], [(3, 1)], [1, 2]),
        (lambda: clustering.common_inputs(), [(1, 5), (1, 5)], [(3, 1)], None),
        (lambda: clustering.deposit(), nodes(25, 5), [(99, 1)], list(range(25))),
        (lambda: clustering.deposit(), nodes(25, 5), [(99, 1), (98, 1)], None),
        (lambda: clustering.change(1000), [(1, 9)], [(2, 5, 500), (3, 4)], [1, 3]),
        (lambda: clustering.change(1000), [(1, 9)], [(2, 5, 500), (3, 4, 600)], None),
        (lambda: clustering.change(1000), [(1, 9, 500)], [(2, 5, 500), (3, 4)], None),
        (lambda: clustering.change(1000), [(1, 9)], [(2, 5, 500), (1, 4)], None),
        (lambda: clustering.change(1000), [(1, 9)], [(2, 5, 500), (3, 4), (4, 4)], None),
        (lambda: clustering.change(1000), [(1, 9)], [(2, 5, LATE), (3, 4, LATE)], None),
        (lambda: clustering.change(1000), [(1, 9)], [(2, 5, 0), (3, 4)], None),
        (lambda: clustering.round_value(1000, 3, 1), [(1, 99999)], [(2, 12345), (3, 7000)], [1, 2]),
        (lambda: clustering.round_value(1000, 3, 1), [(1, 99999)], [(2, 12300), (3, 7000)], None),
        (lambda: clustering.round_value(1000, 3, 3), [(1, 99999)], [(2, 12345), (3, 7000)], None),
        (lambda: clustering.round_value(1000, 3, -1), [(1, 99999)], [(2, 12345), (3, 7000)], None),
        (lambda: clustering.forced_merge(1000), [(1, 50), (2, 60)], [(3, 100), (4, 8)], [1, 2, 4]),
        (lambda: clustering.forced_merge(1000), [(1, 50), (2, 60)], [(3, 55), (4, 8)], None),
        (lambda: clustering.forced_merge(1000), [(1, 50, 700), (2, 60)], [(3, 100), (4, 8)], None),
    ],
)
def test_rules_for_owners(spark, rule, ins, outs, want):
    assert ids(spark, rule(), ins, outs) == want


def test_as_of_join(spark):
    made = spark.createDataFrame([(5, 0, 77, 0, 1, 10), (9, 0, 77, 0, 2, 20), (8, 0, 88, 0, 3, 30)], "block_num long, position long, txo_id long, vout long, node_id long, value long")
    spent = spark.createDataFrame([(7, 1, 77), (9, 1, 77), (12, 1, 77), (7, 2, 88)], "block_num long, position long, txo_id long")
    got = {(r.block_num, r.txo_id): r.node_id for r in resolve.resolve_inputs(spent, made).collect()}
    assert got == {(7, 77): 1, (9, 77): 2, (12, 77): 2}
    with pytest.raises(ValueError):
        resolve.resolve_inputs(spent, made, excluded=[spent], only_positions=[1])


def test_two_smallest(spark):
    rows = spark.createDataFrame([(1, 7), (1, 3), (1, 9), (2, 4), (2, 4), (3, 6)], "node_id long, block_num long")
    got = {r.node_id: (r.reveal, r.reuse) for r in merge.two_smallest(rows, ["node_id"], "block_num").collect()}
    assert got == {1: (3, 7), 2: (4, 4), 3: (6, None)}
    parts = [merge.two_smallest(rows.where(c), ["node_id"], "block_num") for c in ("block_num > 5", "block_num <= 5")]
    for a, b in (parts, parts[::-1]):
        assert {r.node_id: (r.reveal, r.reuse) for r in merge.merge_nodes(a, b, ["node_id"]).collect()} == got


def test_payments(spark):
    schema = "block_num long, position long, txo_id long, node_id long, value long, alias long"
    ins = spark.createDataFrame([(10, 1, 5, 1, 20, 1), (12, 1, 6, 1, 9, 1)], schema)
    outs = spark.createDataFrame([(10, 1, 1, 2, 5, 2), (10, 1, 2, 3, 6, 2), (10, 1, 3, 1, 9, 1), (12, 1, 4, 2, 4, 2), (12, 1, 8, 9, 0, 9)], schema)
    assert [tuple(r) for r in graph.transaction_edges(ins, outs).select("a", "b", "reveal", "last_seen", "total", "min_sent", "max_sent", "total_sent").collect()] == [(1, 2, 10, 12, 2, 4, 11, 15)]
    both = spark.createDataFrame([(5, 2, 7), (2, 5, 4), (3, 3, 1)], "a long, b long, reveal long")
    assert [tuple(r) for r in graph.undirected_edges(both).collect()] == [(2, 5, 4)]
    ins = spark.createDataFrame([(1, 1, 5, 1, 9, 70), (1, 1, 6, 2, 9, 70)], schema)
    outs = spark.createDataFrame([(1, 1, 7, 2, 1, 70), (1, 1, 8, 3, 1, 70), (1, 1, 9, 4, 1, 80)], schema)
    assert sorted(tuple(r) for r in graph.cluster_edges(ins, outs).collect()) == [(1, 3, 70), (2, 3, 70)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (None, 4), (8, 7)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.rand(3))
    assert {r.component for r in components.components(path).collect()} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_graphs_inside_clusters(spark):
    inner = spark.createDataFrame([(1, 2, 70), (2, 3, 70), (7, 8, 70), (20, 21, 80)], "a long, b long, alias long")
    assert {r.alias: r.cluster_num_edges for r in features.cluster_num_edges(inner).collect()} == {70: 3, 80: 1}
    assert {tuple(r) for r in features.cluster_num_cc(inner).collect()} == {(70, 2, 5), (80, 1, 2)}
    assert {tuple(r) for r in features.cluster_num_cc(inner, [1, 2]).collect()} == {(80, 1, 2)}


def test_prices(spark):
    day = lambda d: f"2012-01-0{d} 00:00:00"
    prices = spark.createDataFrame([(day(1), 10.0), (day(3), 20.0), (day(5), 30.0)], "ts string, price double").withColumn("ts", F.to_timestamp("ts"))
    blocks = spark.createDataFrame([(day(2), 1000), (day(4), 2000)], "ts string, block_num long").withColumn("ts", F.to_timestamp("ts"))
    got = {r.block_num: r.price for r in series.price_by_block(prices, blocks).collect()}
    assert len(got) == 1001 and got[1000] == got[1999] == 15.0 and got[2000] == 25.0
    assert {r.block_num for r in series.price_by_block(prices, blocks, dense=False).collect()} == {1000, 2000}


def test_show(spark):
    i, o = sides(spark, [(1, 5, 3)], [(2, 4)])
    text = tx.show_transaction(i, o, 1, 1)
    assert "1: 0.00000005 (reused at 3)" in text and tx.show_transaction(i, o, 9, 9).startswith("no transaction")
