"""The steps of a run over a Store, in order, each of them resumable: blocks, outputs, mixing, coloured coins, clusters, edges,
undirected edges, features. A step's result replaces its tables when it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import chain, clustering, colored, extract, features, graph, merge, mixing, resolve, series
from ..operators import transactions as tx
from ..operators.scan import Store, after, between
from ..sources.blockfile import read_blocks
from ..sources.series import read_block_dates, read_market_price


def blocks(spark: SparkSession, store: Store, config: Config) -> None:
    """The index of the longest chain up to config.end."""
    linked = chain.link_chain(read_blocks(spark, config.folder, headers_only=True))
    store.write("blocks", extract.block_index(linked).where(F.col("num") <= config.end).select(*store.read("blocks").columns) if store.exists("blocks") else extract.block_index(linked).where(F.col("num") <= config.end))


def _indexed(spark: SparkSession, store: Store, config: Config, start: int, drop_zero: bool) -> DataFrame:
    """Transactions of the indexed blocks from start on; only files that hold some are opened."""
    index = store.read("blocks").where(between(start, config.end, "num"))
    files = [r.num_file for r in index.select("num_file").distinct().collect()]
    raw = read_blocks(spark, config.folder, files=files or [], drop_zero=drop_zero) if files else None
    return extract.transactions(extract.numbered(raw, index, start)) if raw is not None else None


def txos(spark: SparkSession, store: Store, config: Config) -> None:
    """Spent and created outputs, nodes and, if asked for, scripts of the blocks that come after what is there."""
    start = max(config.start, store.progress("spent_txos") + 1, store.progress("created_txos") + 1)
    found = _indexed(spark, store, config, start, True)
    if found is None:
        return
    made = extract.created_txos(found)
    fresh = extract.node_receipts(made)
    old = store.read("nodes")
    ids = merge.with_ids(old, fresh)
    nodes = merge.merge_nodes(old, fresh, ["hash"]).join(ids, "hash").select("node_id", "reveal", "reuse", "hash")
    nodes = store.write("nodes", nodes)
    store.append("created_txos", made.join(nodes.select("hash", "node_id"), "hash").select("block_num", "position", "tp", "value", "txo_id", "vout", "node_id"))
    if config.txos.add_script:
        seen = extract.scripts(found)
        store.write("scripts", merge.merge_scripts(store.read("scripts"), seen) if store.exists("scripts") else merge.merge_scripts(seen))
    store.append("spent_txos", extract.spent_txos(found))


def _sides(store: Store, config: Config, **how) -> tuple[DataFrame, DataFrame]:
    spent = store.read("spent_txos").where(F.col("block_num") <= config.end)
    created = store.read("created_txos").where(F.col("block_num") <= config.end)
    one = how.pop("one_per_tx", False)
    return resolve.resolve_inputs(spent, created, one_per_tx=one, **how), resolve.resolve_outputs(created, **how)


def coinjoin(spark: SparkSession, store: Store, config: Config) -> None:
    inputs, outputs = _sides(store, config)
    store.write("coinjoin", mixing.flags(tx.features(inputs, outputs).where(between(config.start, config.end))))


def colored_coins(spark: SparkSession, store: Store, config: Config) -> None:
    found = _indexed(spark, store, config, config.start, False)
    if found is not None:
        store.write("colored_coin", colored.flags(found.where("position > 0")))


def alias(spark: SparkSession, store: Store, config: Config, price: DataFrame | None = None) -> DataFrame:
    """Clusters by the rules that are switched on; they are stored if insert_alias is. Round values need a price by block: a
    frame (block_num, price), or the files that the settings market_price and block_dates name."""
    c = config.alias
    if c.round_output_value and price is None:
        if not (c.market_price and c.block_dates):
            raise ValueError("round_output_value needs prices by block: set alias.market_price and alias.block_dates, or give a frame")
        price = series.price_by_block(read_market_price(spark, c.market_price), read_block_dates(spark, c.block_dates))
    nodes = store.read("nodes").select("node_id", "reuse")
    excluded = [store.read("coinjoin")] if c.exclude_coinjoin else []
    inputs, outputs = _sides(store, config, excluded=excluded, nodes=nodes)
    before = store.read("alias") if store.exists("alias") else None
    if c.common_input_ownership and not (c.deposit_address or c.change_address or c.round_output_value or c.force_merge_inputs):
        out = clustering.cluster(clustering.common_inputs_of(inputs.where(after(config.start, config.end))), before)
        return store.write("alias", out) if c.insert_alias else out
    whole = tx.assemble(inputs, outputs).where(after(config.start, config.end))
    rules = []
    if c.common_input_ownership:
        rules.append(clustering.common_inputs())
    if c.deposit_address:
        rules.append(clustering.deposit(c.deposit_address_min_num_inputs))
    if c.change_address:
        rules.append(clustering.change(config.end))
    if c.round_output_value:
        whole = clustering.with_zeros(whole, price, c.round_output_value_x)
        rules.append(clustering.round_value(config.end, F.col("zeros"), c.round_output_value_j))
    if c.force_merge_inputs:
        rules.append(clustering.forced_merge(config.end))
    out = clustering.cluster(clustering.same_owner(whole, rules), before)
    return store.write("alias", out) if c.insert_alias else out


def transaction_edges(spark: SparkSession, store: Store, config: Config) -> None:
    c = config.transaction_edges
    if c.do and not (c.exclude_coinjoin and c.only_one_per_position):
        raise ValueError("edges are only defined without mixing transactions and with one input a transaction")
    excluded = [store.read("coinjoin")] + ([store.read("colored_coin")] if c.exclude_colored_coin else [])
    known = store.read("alias")
    inputs, outputs = _sides(store, config, excluded=excluded, alias=known, one_per_tx=True)
    store.write("transaction_edges", graph.transaction_edges(inputs.where(after(config.start, config.end)), outputs))


def undirected_transaction_edges(spark: SparkSession, store: Store, config: Config) -> None:
    store.write("undirected_transaction_edges", graph.undirected_edges(store.read("transaction_edges")))


def node_features(spark: SparkSession, store: Store, config: Config) -> None:
    """All features of blocks after config.start, with those of the graphs inside clusters if asked for."""
    known = store.read("alias")
    edges = store.read("transaction_edges").where(after(config.start, config.end, "reveal"))
    pairs = store.read("undirected_transaction_edges").where(after(config.start, config.end, "reveal"))
    parts = [features.cluster_size(store.read("nodes"), known, config.start, config.end), features.degree(pairs), features.in_features(edges), features.out_features(edges)]
    if config.features.do_cluster_features:
        inputs, outputs = _sides(store, config, alias=known)
        inner = store.write("cluster_transaction_edges", graph.cluster_edges(inputs.where(between(config.start, config.end)), outputs))
        parts += [features.cluster_num_edges(inner), features.cluster_num_cc(inner)]
    store.write("node_features", features.assemble(*parts))


def run(spark: SparkSession, store: Store, config: Config, price: DataFrame | None = None) -> None:
    """Every step that is switched on."""
    if config.blocks.do:
        blocks(spark, store, config)
    if config.txos.do:
        txos(spark, store, config)
    if config.coinjoin.do:
        coinjoin(spark, store, config)
    if config.colored_coins.do:
        colored_coins(spark, store, config)
    if config.alias.do:
        alias(spark, store, config, price)
    if config.transaction_edges.do:
        transaction_edges(spark, store, config)
    if config.undirected_transaction_edges.do:
        undirected_transaction_edges(spark, store, config)
    if config.features.do:
        node_features(spark, store, config)
