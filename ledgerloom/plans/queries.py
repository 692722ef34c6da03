"""Named queries over the ledger view of the order tables, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoding as enc
from ..functions.scripts import functions as script_functions
from ..operators import chain, clustering, colored, extract, features, graph, merge, mixing, resolve, scan, series
from ..operators import transactions as tx
from ..operators.storage import settle, shared_dir
from ..sources import ledger_view as view
from ..sources.blockfile import read_blocks
from ..sources.series import read_block_dates, read_market_price

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the SQL forms, in the order in which they build on each other.
PARTS = {
    "tx": """SELECT o_orderkey AS ord, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS block_num,
        CAST(row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS BIGINT) AS position, o_orderpriority AS priority FROM orders""",
    "created": """SELECT block_num, position, CAST(l_orderkey * 16 + l_linenumber AS BIGINT) AS txo_id, CAST(l_linenumber - 1 AS BIGINT) AS vout,
        CAST(l_partkey * 64 + CAST(l_quantity AS INT) AS BIGINT) AS node_id, CAST(CASE WHEN priority = '5-LOW' THEN
        CASE CAST(round(l_discount * 100) AS INT) // 4 WHEN 0 THEN 10000000 WHEN 1 THEN 20000000 ELSE 100000 END
        ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS BIGINT) AS value FROM lineitem JOIN tx ON l_orderkey = ord""",
    "spent": "SELECT DISTINCT block_num, position, CAST(l_orderkey * 16 + l_linenumber AS BIGINT) AS txo_id FROM lineitem JOIN tx ON l_orderkey + 1 + l_partkey % 97 = ord",
    "inputs": """SELECT block_num, position, txo_id, vout, node_id, value FROM (SELECT s.block_num, s.position, s.txo_id, c.vout, c.node_id, c.value,
        row_number() OVER (PARTITION BY s.block_num, s.position, s.txo_id ORDER BY c.block_num DESC, c.node_id, c.value) AS rn
        FROM spent s JOIN created c ON s.txo_id = c.txo_id AND c.block_num <= s.block_num) q WHERE rn = 1""",
    "outputs": """SELECT block_num, position, txo_id, vout, node_id, value FROM (SELECT *, row_number() OVER (PARTITION BY block_num, position, txo_id
        ORDER BY node_id, value, vout) AS rn FROM created) q WHERE rn = 1""",
    "nodes": """SELECT node_id, min(block_num) AS reveal, max(CASE WHEN rn = 2 THEN block_num END) AS reuse FROM (SELECT node_id, block_num,
        row_number() OVER (PARTITION BY node_id ORDER BY block_num) AS rn FROM created) q WHERE rn <= 2 GROUP BY node_id""",
    "firsts": "SELECT block_num, position, txo_id, vout, node_id, value FROM (SELECT i.*, 1 AS one FROM inputs i JOIN (SELECT block_num, position, min(txo_id) AS txo_id FROM spent GROUP BY block_num, position) m USING (block_num, position, txo_id)) q",
    "hist": "SELECT block_num, position, value, CAST(count(*) AS BIGINT) AS occurrences FROM outputs GROUP BY block_num, position, value",
    "modes": """SELECT block_num, position, value AS mode_value, occurrences AS mode_count FROM (SELECT *, row_number() OVER (PARTITION BY block_num, position
        ORDER BY occurrences DESC, value) AS rn FROM hist) q WHERE rn = 1""",
    "feats": """SELECT block_num, position, coalesce(num_inputs, 0) AS num_inputs, coalesce(num_outputs, 0) AS num_outputs, coalesce(num_input_ids, 0) AS num_input_ids,
        coalesce(num_output_ids, 0) AS num_output_ids, coalesce(num_input_values, 0) AS num_input_values, coalesce(num_output_values, 0) AS num_output_values,
        coalesce(output_zero, false) AS output_zero, mode_value, mode_count, input_min, input_max
        FROM (SELECT block_num, position, count(*) AS num_inputs, count(DISTINCT node_id) AS num_input_ids, count(DISTINCT value) AS num_input_values,
            min(value) AS input_min, max(value) AS input_max FROM inputs GROUP BY block_num, position) i
        FULL OUTER JOIN (SELECT block_num, position, count(*) AS num_outputs, count(DISTINCT node_id) AS num_output_ids, count(DISTINCT value) AS num_output_values,
            bool_or(vout = 0) AS output_zero FROM outputs GROUP BY block_num, position) o USING (block_num, position)
        LEFT JOIN modes USING (block_num, position)""",
    "joinmarket": "SELECT block_num, position FROM feats WHERE mode_count >= 3 AND mode_count >= num_outputs / 2.0 AND mode_count <= num_input_ids AND num_output_ids >= num_outputs",
    "tagged": "SELECT block_num, position FROM tx WHERE (block_num * 16 + position) & 63 IN (37, 51)",
    "star": "SELECT DISTINCT m AS a, node_id AS b FROM inputs JOIN (SELECT block_num, position, min(node_id) AS m FROM inputs GROUP BY block_num, position) q USING (block_num, position) WHERE m <> node_id",
    "sym": "SELECT a, b FROM star UNION SELECT b, a FROM star",
    "reach": "SELECT a AS node_id, a AS lab FROM sym UNION SELECT e.b, r.lab FROM reach r JOIN sym e ON e.a = r.node_id AND r.lab < e.b",
    "alias": "SELECT node_id, min(lab) AS alias FROM reach GROUP BY node_id",
    "ain": "SELECT i.*, coalesce(alias, node_id) AS alias FROM inputs i LEFT JOIN alias USING (node_id)",
    "aout": "SELECT o.*, coalesce(alias, node_id) AS alias FROM outputs o LEFT JOIN alias USING (node_id)",
    "afirst": "SELECT f.*, coalesce(alias, node_id) AS alias FROM firsts f LEFT JOIN alias USING (node_id)",
    "pays": """SELECT block_num, position, s.alias AS a, r.alias AS b, r.value FROM afirst s JOIN (SELECT block_num, position, alias, CAST(sum(value) AS BIGINT) AS value
        FROM aout GROUP BY block_num, position, alias) r USING (block_num, position) WHERE s.alias <> r.alias AND r.value > 0""",
    "edges": """SELECT a, b, min(block_num) AS reveal, max(block_num) AS last_seen, CAST(count(*) AS BIGINT) AS total, min(value) AS min_sent, max(value) AS max_sent,
        CAST(sum(value) AS BIGINT) AS total_sent FROM pays GROUP BY a, b""",
    "und": "SELECT least(a, b) AS a, greatest(a, b) AS b, min(reveal) AS reveal FROM edges GROUP BY 1, 2",
    "lead": "SELECT block_num, position, min_by(alias, txo_id) AS alias FROM ain GROUP BY block_num, position",
    "snd": "SELECT DISTINCT block_num, position, alias, node_id AS a FROM ain JOIN lead USING (block_num, position, alias)",
    "inner_edges": """SELECT a, b, min(alias) AS alias FROM (SELECT s.a, o.node_id AS b, alias FROM snd s JOIN aout o USING (block_num, position, alias)
        WHERE NOT EXISTS (SELECT 1 FROM snd z WHERE z.block_num = s.block_num AND z.position = s.position AND z.alias = s.alias AND z.a = o.node_id)) q GROUP BY a, b""",
    "sized": "SELECT alias, a, b FROM inner_edges WHERE alias IN (SELECT alias FROM inner_edges GROUP BY alias HAVING count(*) IN (1, 2, 3, 5))",
    "s3": "SELECT alias, a, b FROM sized UNION SELECT alias, b, a FROM sized",
    "r3": "SELECT alias, a AS node_id, a AS lab FROM s3 UNION SELECT e.alias, e.b, r.lab FROM r3 r JOIN s3 e ON e.a = r.node_id AND e.alias = r.alias AND r.lab < e.b",
}
NEEDS = {
    "created": ["tx"], "spent": ["tx"], "inputs": ["spent", "created"], "outputs": ["created"], "nodes": ["created"], "firsts": ["inputs", "spent"], "hist": ["outputs"], "modes": ["hist"],
    "feats": ["inputs", "outputs", "modes"], "joinmarket": ["feats"], "tagged": ["tx"], "star": ["inputs"], "sym": ["star"], "reach": ["sym"], "alias": ["reach"], "ain": ["inputs", "alias"],
    "aout": ["outputs", "alias"], "afirst": ["firsts", "alias"], "pays": ["afirst", "aout"], "edges": ["pays"], "und": ["edges"], "lead": ["ain"], "snd": ["ain", "lead"], "inner_edges": ["snd", "aout"], "sized": ["inner_edges"], "s3": ["sized"], "r3": ["s3"],
}


def sql(body: str, *parts: str) -> str:
    """body behind the parts that it needs."""
    wanted: set[str] = set()
    todo = list(parts)
    while todo:
        p = todo.pop()
        if p not in wanted:
            wanted.add(p)
            todo += NEEDS.get(p, [])
    ctes = ", ".join(f"{n} AS ({q})" for n, q in PARTS.items() if n in wanted)
    return f"WITH RECURSIVE {ctes} {body}" if ctes else body


def query(oracle: str | None = None, *parts: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = sql(oracle, *parts)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(spark, d, **how):
    return resolve.resolve_inputs(view.spent(spark, d), view.created(spark, d), **how)


def _out(spark, d, **how):
    return resolve.resolve_outputs(view.created(spark, d), **how)


def _alias(spark, d):
    return clustering.cluster(clustering.common_inputs_of(_in(spark, d)))


def _edges(spark, d, **how):
    alias = _alias(spark, d)
    return graph.transaction_edges(_in(spark, d, one_per_tx=True, alias=alias), _out(spark, d, alias=alias))


def _features(spark, d):
    return tx.features(_in(spark, d), _out(spark, d))


def _tagged(spark, d):
    return view.transactions(spark, d).where(enc.order_tag(F.col("block_num") * 16 + F.col("position"))).select(F.col("block_num").alias("block"), "position")


def _joined(spark, d, rule, last=1200):
    """Sets of one rule, of transactions up to a block, as (block_num, position, lo, hi, n)."""
    nodes = resolve.node_table(view.created(spark, d)).select("node_id", "reuse")
    whole = tx.assemble(_in(spark, d, nodes=nodes), _out(spark, d, nodes=nodes)).where(F.col("block_num") <= last)
    out = clustering.same_owner(whole, [rule])
    return out.select("block_num", "position", F.array_min("ids").alias("lo"), F.array_max("ids").alias("hi"), F.size("ids").cast("long").alias("n"))


# scans, filters, limits, sets


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 100 AND o_custkey <= 700 AND o_orderstatus != 'P'")
def scan_fetch(spark, d):
    return scan.scan(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], [("o_orderkey", ">", 100), ("o_custkey", "<=", 700), ("o_orderstatus", "!=", "P")])


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linenumber >= 2 ORDER BY l_suppkey DESC LIMIT 7")
def scan_distinct_order_limit(spark, d):
    return scan.scan(table(spark, d, "lineitem"), ["l_suppkey"], [("l_linenumber", ">=", 2)], "l_suppkey", "desc", 7, True)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (3, 5, 8) AND c_custkey < 900")
def filter_in(spark, d):
    return scan.scan(table(spark, d, "customer"), ["c_custkey", "c_nationkey"], [("c_nationkey", "=", [3, 5, 8]), ("c_custkey", "<", 900)])


@query("SELECT c_custkey FROM customer WHERE NOT (c_nationkey = 4) AND false")
def filter_empty_in(spark, d):
    return scan.scan(table(spark, d, "customer"), ["c_custkey"], [("c_nationkey", "NOT", 4), ("c_custkey", "IN", [])])


@query("SELECT c_custkey FROM customer WHERE c_nationkey <> 4 AND c_nationkey NOT IN (1, 2)")
def filter_not(spark, d):
    return scan.scan(table(spark, d, "customer"), ["c_custkey"], [("c_nationkey", "NOT", 4), ("c_nationkey", "NOT", [1, 2])])


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def count_rows(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT max(block_num) AS max_block FROM tx", "tx")
def max_block(spark, d):
    return view.transactions(spark, d).agg(F.max("block_num").alias("max_block"))


@query("SELECT block_num, position FROM tx WHERE block_num > 300 AND block_num <= 330", "tx")
def blocks_after(spark, d):
    return view.transactions(spark, d).where(scan.after(300, 330)).select("block_num", "position")


@query("SELECT block_num, position FROM tx WHERE block_num >= 300 AND block_num <= 330", "tx")
def blocks_between(spark, d):
    return view.transactions(spark, d).where(scan.between(300, 330)).select("block_num", "position")


@query("SELECT txo_id FROM spent UNION SELECT txo_id FROM created", "spent", "created")
def set_union(spark, d):
    return view.spent(spark, d).select("txo_id").union(view.created(spark, d).select("txo_id")).distinct()


@query("SELECT txo_id FROM created EXCEPT SELECT txo_id FROM spent", "spent", "created")
def set_difference(spark, d):
    return view.created(spark, d).select("txo_id").distinct().join(view.spent(spark, d).select("txo_id"), "txo_id", "left_anti")


@query("SELECT txo_id FROM created INTERSECT SELECT txo_id FROM spent", "spent", "created")
def set_intersection(spark, d):
    return view.created(spark, d).select("txo_id").distinct().join(view.spent(spark, d).select("txo_id"), "txo_id", "left_semi")


@query("SELECT block_num, CAST(count(*) AS BIGINT) AS n FROM spent GROUP BY block_num ORDER BY n DESC, block_num LIMIT 20", "spent")
def spent_per_block(spark, d):
    return view.spent(spark, d).groupBy("block_num").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "block_num").limit(20)


# inputs and outputs


@query("SELECT * FROM outputs", "outputs")
def resolve_outputs(spark, d):
    return _out(spark, d)


@query("SELECT * FROM inputs", "inputs")
def resolve_inputs_asof(spark, d):
    return _in(spark, d)


@query("SELECT * FROM inputs", "inputs")
def resolve_inputs_ranked(spark, d):
    return resolve.resolve_inputs_ranked(view.spent(spark, d), view.created(spark, d)).select("block_num", "position", "txo_id", "vout", "node_id", "value")


@query("SELECT * FROM firsts", "firsts")
def resolve_inputs_one_per_tx(spark, d):
    return _in(spark, d, one_per_tx=True)


@query("SELECT * FROM inputs WHERE position IN (0, 2)", "inputs")
def resolve_inputs_only_positions(spark, d):
    return _in(spark, d, only_positions=[0, 2])


@query("SELECT i.*, reveal, reuse FROM inputs i JOIN nodes USING (node_id)", "inputs", "nodes")
def inputs_join_node(spark, d):
    return _in(spark, d, nodes=resolve.node_table(view.created(spark, d)))


@query("SELECT * FROM ain", "ain")
def inputs_join_alias(spark, d):
    return _in(spark, d, alias=_alias(spark, d))


@query("SELECT i.* FROM inputs i WHERE NOT EXISTS (SELECT 1 FROM joinmarket j WHERE j.block_num = i.block_num AND j.position = i.position)", "inputs", "joinmarket")
def exclude_coinjoin_anti(spark, d):
    flagged = _features(spark, d).where(mixing.joinmarket()).select(F.col("block_num").alias("block"), "position")
    return _in(spark, d, excluded=[flagged])


@query("SELECT o.* FROM outputs o WHERE NOT EXISTS (SELECT 1 FROM tagged j WHERE j.block_num = o.block_num AND j.position = o.position)", "outputs", "tagged")
def exclude_colored_anti(spark, d):
    return _out(spark, d, excluded=[_tagged(spark, d)])


@query("SELECT * FROM nodes", "nodes")
def node_reveal_reuse(spark, d):
    return resolve.node_table(view.created(spark, d))


@query("SELECT * FROM nodes", "nodes")
def nodes_merged_batches(spark, d):
    made = view.created(spark, d)
    late, early = (resolve.node_table(made.where(c)) for c in (F.col("block_num") > 900, F.col("block_num") <= 900))
    return merge.merge_nodes(late, early, ["node_id"])


@query("SELECT upper(sha256(CAST(c_custkey AS VARCHAR))) AS hash, CAST(row_number() OVER (ORDER BY sha256(CAST(c_custkey AS VARCHAR))) - 1 AS BIGINT) AS node_id FROM customer")
def surrogate_ids(spark, d):
    hashes = table(spark, d, "customer").select(enc.sha256(F.col("c_custkey").cast("string").cast("binary")).alias("hash"))
    none = spark.createDataFrame([], "hash binary, node_id long")
    return merge.with_ids(none, hashes).select(F.hex("hash").alias("hash"), "node_id")


@query("SELECT block_num, position, CAST(sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_in, CAST(sum(side) AS BIGINT) AS num_out FROM (SELECT block_num, position, 0 AS side FROM inputs UNION ALL SELECT block_num, position, 1 FROM outputs) q GROUP BY block_num, position", "inputs", "outputs")
def assemble_transactions(spark, d):
    return tx.assemble(_in(spark, d), _out(spark, d)).select("block_num", "position", F.size("ins").cast("long").alias("num_in"), F.size("outs").cast("long").alias("num_out"))


# features of transactions and detectors

FEATURES = ["block_num", "position", "num_inputs", "num_outputs", "num_input_ids", "num_output_ids", "num_input_values", "num_output_values", "output_zero", "mode_value", "mode_count"]


@query(f"SELECT {', '.join(FEATURES)} FROM feats", "feats")
def tx_features(spark, d):
    return _features(spark, d).select(*FEATURES)


@query("SELECT * FROM hist", "hist")
def output_value_histogram(spark, d):
    return tx.histogram(_out(spark, d))


def _flagged(spark, d, rule):
    return _features(spark, d).where(rule).select("block_num", "position")


@query("SELECT * FROM joinmarket", "joinmarket")
def detect_joinmarket(spark, d):
    return _flagged(spark, d, mixing.joinmarket())


WASABI = """mode_count >= 2 AND mode_count <= num_input_ids AND num_inputs <= 7 * mode_count AND num_output_ids >= num_outputs
    AND EXISTS (SELECT 1 FROM hist h WHERE h.block_num = feats.block_num AND h.position = feats.position AND h.occurrences = mode_count AND h.value BETWEEN 9000000 AND 11000000)"""


@query(f"SELECT block_num, position FROM feats WHERE mode_count >= (num_outputs - 1) / 2.0 AND {WASABI}", "feats", "hist")
def detect_wasabi10(spark, d):
    return _flagged(spark, d, mixing.wasabi_1_0(least=2))


@query(
    f"""SELECT block_num, position FROM feats WHERE {WASABI} AND mode_count + coalesce((SELECT sum(occurrences) FROM hist h, range(1, 12) r(l) WHERE h.block_num = feats.block_num
    AND h.position = feats.position AND h.value BETWEEN CAST(pow(2, l) AS BIGINT) * 9000000 AND CAST(pow(2, l) AS BIGINT) * 11000000), 0) >= num_outputs - mode_count - 1""",
    "feats", "hist",
)
def detect_wasabi11(spark, d):
    return _flagged(spark, d, mixing.wasabi_1_1(least=2))


@query(
    f"""SELECT block_num, position FROM (SELECT f.*, coalesce((SELECT sum(occurrences) FROM hist h WHERE h.block_num = f.block_num AND h.position = f.position
    AND h.value IN {mixing.STANDARD}), 0) AS mixed FROM feats f) q WHERE num_inputs >= 3 AND input_min >= 5000 AND num_output_ids >= num_outputs AND mixed >= (num_outputs - 1) / 2.0 AND mixed >= num_inputs / 10.0""",
    "feats", "hist",
)
def detect_wasabi2(spark, d):
    return _flagged(spark, d, mixing.wasabi_2(least_inputs=3))


FEE = "CASE WHEN v BETWEEN 100000 AND 900000 THEN 5000 WHEN v BETWEEN 1000000 AND 1800000 THEN 50000 WHEN v BETWEEN 5000000 AND 5800000 THEN 175000 ELSE 1750000 END"


@query(
    f"""SELECT block_num, position FROM feats JOIN (SELECT block_num, position, max_by(occurrences, occurrences * 10000000000 + value) AS c, max_by(value, occurrences * 10000000000 + value) AS v FROM hist
    WHERE value BETWEEN 100000 AND 900000 OR value BETWEEN 1000000 AND 1800000 OR value BETWEEN 5000000 AND 5800000 OR value BETWEEN 50000000 AND 50800000 GROUP BY block_num, position) p USING (block_num, position)
    WHERE NOT output_zero AND c >= num_outputs - 2 AND c <= 75 AND EXISTS (SELECT 1 FROM hist h WHERE h.block_num = feats.block_num AND h.position = feats.position AND h.value BETWEEN 0.5 * {FEE} AND 300 * {FEE})""",
    "feats", "hist",
)
def detect_tx0(spark, d):
    """With wide bands, as nothing in these tables passes the usual ones."""
    return _flagged(spark, d, mixing.whirlpool_tx0(low=0, high=800_000, fee_high=300.0))


@query("SELECT block_num, position FROM feats WHERE num_inputs = 2 AND num_input_ids = 2 AND num_outputs = 2 AND num_output_ids = 2 AND num_output_values = 1 AND mode_value IN (100000, 1000000, 5000000, 50000000) AND input_min >= mode_value AND input_max <= mode_value + 20000000 AND input_min = mode_value AND input_max > mode_value", "feats")
def detect_whirlpool(spark, d):
    return _flagged(spark, d, mixing.whirlpool(high=20_000_000, size=2))


@query("SELECT block_num, position FROM feats WHERE num_input_ids <> 1 AND num_output_ids <> 1 AND num_input_ids * num_output_ids >= 12", "feats")
def detect_big(spark, d):
    return _flagged(spark, d, mixing.big(12))


@query(
    f"""SELECT block_num AS block, position, CAST(jm AS INT) AS joinmarket, CAST(w AS INT) AS wasabi1 FROM (SELECT block_num, position,
    coalesce(mode_count >= 3 AND mode_count >= num_outputs / 2.0 AND mode_count <= num_input_ids AND num_output_ids >= num_outputs, false) AS jm,
    coalesce(mode_count >= (num_outputs - 1) / 2.0 AND {WASABI}, false) AS w FROM feats) q WHERE jm OR w""",
    "feats", "hist",
)
def detect_any_mixing(spark, d):
    return mixing.flags(_features(spark, d), wasabi1=mixing.wasabi_1_0(least=2)).select("block", "position", "joinmarket", "wasabi1").where("joinmarket + wasabi1 > 0")


# rules and clusters


@query("SELECT block_num, position, min(node_id) AS lo, max(node_id) AS hi, CAST(count(DISTINCT node_id) AS BIGINT) AS n FROM inputs WHERE block_num <= 1200 GROUP BY block_num, position HAVING count(DISTINCT node_id) > 1", "inputs")
def cio_clusters(spark, d):
    return _joined(spark, d, clustering.common_inputs())


@query("SELECT block_num, position, min(node_id) AS lo, max(node_id) AS hi, CAST(count(DISTINCT node_id) AS BIGINT) AS n FROM inputs JOIN feats USING (block_num, position) WHERE block_num <= 1200 AND num_input_ids >= 3 AND num_output_ids <= 1 GROUP BY block_num, position", "inputs", "feats")
def deposit_clusters(spark, d):
    return _joined(spark, d, clustering.deposit(3))


#: One input i, two outputs a and b by vout, none shared; r tells whether a node is used again by block 1200.
PAIR = """(SELECT o.block_num, o.position, i.node_id AS i, o.a, o.b, o.va, o.vb, coalesce(ni.reuse, 0) <> 0 AND ni.reuse <= 1200 AS ri,
    coalesce(na.reuse, 0) <> 0 AND na.reuse <= 1200 AS ra, coalesce(nb.reuse, 0) <> 0 AND nb.reuse <= 1200 AS rb
    FROM (SELECT block_num, position, min_by(node_id, vout) AS a, max_by(node_id, vout) AS b, min_by(value, vout) AS va, max_by(value, vout) AS vb FROM outputs GROUP BY block_num, position HAVING count(*) = 2 AND count(DISTINCT node_id) = 2) o
    JOIN (SELECT block_num, position, min(node_id) AS node_id FROM inputs GROUP BY block_num, position HAVING count(*) = 1) i USING (block_num, position)
    JOIN nodes ni ON ni.node_id = i.node_id JOIN nodes na ON na.node_id = o.a JOIN nodes nb ON nb.node_id = o.b
    WHERE block_num <= 1200 AND i.node_id <> o.a AND i.node_id <> o.b)"""


def _pair_sql(chosen: str) -> str:
    return f"SELECT block_num, position, least(i, c) AS lo, greatest(i, c) AS hi, CAST(2 AS BIGINT) AS n FROM (SELECT *, {chosen} AS c FROM {PAIR} q WHERE NOT coalesce(ri, false)) p WHERE c IS NOT NULL"


@query(_pair_sql("CASE WHEN coalesce(ra, false) AND NOT coalesce(rb, false) THEN b WHEN coalesce(rb, false) AND NOT coalesce(ra, false) THEN a END"), "inputs", "outputs", "nodes")
def change_clusters(spark, d):
    return _joined(spark, d, clustering.change(1200))


@query(_pair_sql("CASE WHEN NOT coalesce(ra, false) AND vb % 100 = 0 AND va % 10 <> 0 THEN a WHEN NOT coalesce(rb, false) AND va % 100 = 0 AND vb % 10 <> 0 THEN b END"), "inputs", "outputs", "nodes")
def round_value_clusters(spark, d):
    return _joined(spark, d, clustering.round_value(1200, 2, 1))


@query(
    """SELECT block_num, position, least(lo, c) AS lo, greatest(hi, c) AS hi, n + 1 AS n FROM (SELECT block_num, position, lo, hi, n, spare, used, CASE WHEN va < vb THEN a ELSE b END AS c, greatest(va, vb) AS pay
      FROM (SELECT block_num, position, min_by(node_id, vout) AS a, max_by(node_id, vout) AS b, min_by(value, vout) AS va, max_by(value, vout) AS vb FROM outputs GROUP BY block_num, position HAVING count(*) = 2 AND count(DISTINCT node_id) = 2) o
      JOIN (SELECT block_num, position, min(i.node_id) AS lo, max(i.node_id) AS hi, CAST(count(*) AS BIGINT) AS n, sum(value) - min(value) AS spare, bool_or(coalesce(reuse, 0) <> 0 AND coalesce(reuse, 9999) <= 1200) AS used
        FROM inputs i JOIN nodes USING (node_id) GROUP BY block_num, position HAVING count(*) >= 2 AND count(DISTINCT i.node_id) = count(*)) i USING (block_num, position)) q
    JOIN nodes nc ON nc.node_id = c WHERE block_num <= 1200 AND NOT used AND NOT (coalesce(reuse, 0) <> 0 AND coalesce(reuse, 9999) <= 1200) AND spare < pay""",
    "inputs", "outputs", "nodes",
)
def force_merge_clusters(spark, d):
    return _joined(spark, d, clustering.forced_merge(1200))


@query("SELECT * FROM alias", "alias")
def alias_components(spark, d):
    return _alias(spark, d)


@query("SELECT * FROM alias", "alias")
def alias_incremental(spark, d):
    joined = clustering.same_owner(tx.assemble(_in(spark, d), _out(spark, d)), [clustering.common_inputs()])
    return clustering.cluster(joined.where("block_num > 1000"), clustering.cluster(joined.where("block_num <= 1000")))


# graphs


@query("SELECT * FROM edges", "edges")
def transaction_edges(spark, d):
    return _edges(spark, d)


@query("SELECT * FROM edges", "edges")
def transaction_edges_incremental(spark, d):
    alias = _alias(spark, d)
    inputs, outputs = _in(spark, d, one_per_tx=True, alias=alias), _out(spark, d, alias=alias)
    parts = [graph.transaction_edges(inputs.where(scan.after(a, b)), outputs.where(scan.after(a, b))) for a, b in ((-1, 700), (700, 1500), (1500, 10**6))]
    return merge.merge_edges(*parts)


@query("SELECT * FROM und", "und")
def undirected_edges(spark, d):
    return graph.undirected_edges(_edges(spark, d))


@query("SELECT coalesce(alias, node_id) AS alias, CAST(count(*) AS BIGINT) AS cluster_size FROM nodes LEFT JOIN alias USING (node_id) WHERE reveal > 0 GROUP BY 1", "nodes", "alias")
def cluster_size(spark, d):
    return features.cluster_size(resolve.node_table(view.created(spark, d)), _alias(spark, d))


@query("SELECT alias, CAST(count(*) AS BIGINT) AS degree FROM (SELECT a AS alias FROM und UNION ALL SELECT b FROM und) q GROUP BY alias", "und")
def degree(spark, d):
    return features.degree(graph.undirected_edges(_edges(spark, d)))


def _flows_sql(key: str, way: str, verb: str) -> str:
    return f"""SELECT {key} AS alias, CAST(count(*) AS BIGINT) AS degree_{way}, CAST(sum(total) AS BIGINT) AS total_transactions_{way}, min(reveal) AS first_transaction_{way},
        max(last_seen) AS last_transaction_{way}, min(min_sent) AS min_{verb}, max(max_sent) AS max_{verb}, CAST(sum(total_sent) AS BIGINT) AS total_{verb} FROM edges GROUP BY {key}"""


@query(_flows_sql("b", "in", "received"), "edges")
def in_features(spark, d):
    return features.in_features(_edges(spark, d))


@query(_flows_sql("a", "out", "sent"), "edges")
def out_features(spark, d):
    return features.out_features(_edges(spark, d))


def _inner(spark, d):
    alias = _alias(spark, d)
    return settle(graph.cluster_edges(_in(spark, d, alias=alias), _out(spark, d, alias=alias)))  # read several times


@query("SELECT * FROM inner_edges", "inner_edges")
def cluster_edges(spark, d):
    return _inner(spark, d)


@query("SELECT alias, CAST(count(*) AS BIGINT) AS cluster_num_edges FROM inner_edges GROUP BY alias", "inner_edges")
def cluster_num_edges(spark, d):
    return features.cluster_num_edges(_inner(spark, d))


CC = """, s2 AS (SELECT alias, a, b FROM inner_edges UNION SELECT alias, b, a FROM inner_edges),
    r2 AS (SELECT alias, a AS node_id, a AS lab FROM s2 UNION SELECT e.alias, e.b, r.lab FROM r2 r JOIN s2 e ON e.a = r.node_id AND e.alias = r.alias AND r.lab < e.b)
    SELECT alias, CAST(count(DISTINCT lab) AS BIGINT) AS cluster_num_cc, CAST(count(*) AS BIGINT) AS cluster_num_nodes_in_cc FROM (SELECT alias, node_id, min(lab) AS lab FROM r2 GROUP BY alias, node_id) q GROUP BY alias"""


@query(CC, "inner_edges")
def cluster_num_cc(spark, d):
    return features.cluster_num_cc(_inner(spark, d))


@query(
    f"""SELECT alias, degree, degree_in, degree_out, total_received, total_sent, cluster_size FROM (SELECT alias, CAST(count(*) AS BIGINT) AS degree FROM (SELECT a AS alias FROM und UNION ALL SELECT b FROM und) q GROUP BY alias) g
    FULL OUTER JOIN ({_flows_sql('b', 'in', 'received')}) i USING (alias) FULL OUTER JOIN ({_flows_sql('a', 'out', 'sent')}) o USING (alias)
    FULL OUTER JOIN (SELECT coalesce(alias, node_id) AS alias, CAST(count(*) AS BIGINT) AS cluster_size FROM nodes LEFT JOIN alias USING (node_id) WHERE reveal > 0 GROUP BY 1) z USING (alias)""",
    "und", "nodes",
)
def node_features(spark, d):
    alias = _alias(spark, d)
    edges = settle(graph.transaction_edges(_in(spark, d, one_per_tx=True, alias=alias), _out(spark, d, alias=alias)))  # read by three aggregates
    size = features.cluster_size(resolve.node_table(view.created(spark, d)), alias)
    out = features.assemble(size, features.degree(graph.undirected_edges(edges)), features.in_features(edges), features.out_features(edges))
    return out.select("alias", "degree", "degree_in", "degree_out", "total_received", "total_sent", "cluster_size")


# writes as joins and aggregates


@query("SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY side, v) AS rn FROM (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS v, 0 AS side FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(o_custkey AS BIGINT), CAST(o_orderkey AS BIGINT), 1 FROM orders) q) p WHERE rn = 1")
def insert_ignore(spark, d):
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as k", "cast(c_nationkey as bigint) as v")
    return merge.insert_ignore(old, table(spark, d, "orders").selectExpr("o_custkey as k", "o_orderkey as v"), ["k"])


@query("SELECT coalesce(c_custkey, k) AS k, CASE WHEN k IS NULL THEN CAST(c_nationkey AS BIGINT) ELSE x END AS x, c_mktsegment AS y FROM customer FULL OUTER JOIN (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS x FROM part WHERE p_partkey % 3 = 0) p ON c_custkey = k")
def partial_upsert(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey as k", "cast(c_nationkey as bigint) as x", "c_mktsegment as y")
    return merge.upsert(old, table(spark, d, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey as k", "cast(p_size as bigint) as x"), "k")


@query("SELECT alias, cluster_num_edges, CASE WHEN cluster_num_edges = 1 THEN CAST(1 AS BIGINT) END AS cluster_num_cc FROM (SELECT alias, CAST(count(*) AS BIGINT) AS cluster_num_edges FROM inner_edges GROUP BY alias) q", "inner_edges")
def conditional_update(spark, d):
    counted = features.cluster_num_edges(_inner(spark, d)).withColumn("cluster_num_cc", F.lit(None).cast("long"))
    return merge.update_where(counted, F.col("cluster_num_edges") == 1, cluster_num_cc=1)


@query("SELECT node_id, reveal, reuse FROM nodes WHERE NOT coalesce(reuse < 900, false)", "nodes")
def delete_where(spark, d):
    return merge.delete_where(resolve.node_table(view.created(spark, d)), F.col("reuse") < 900)


@query("SELECT a, b, min(r) AS reveal FROM (SELECT least(s, t) AS a, greatest(s, t) AS b, r FROM (SELECT l_suppkey AS s, l_partkey AS t, CAST(l_linenumber AS BIGINT) AS r FROM lineitem) q WHERE s <> t) p GROUP BY a, b")
def undirected_merge(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey as a", "l_partkey as b", "cast(l_linenumber as bigint) as reveal")
    return merge.merge_undirected(graph.undirected_edges(rows.where("reveal > 3")), graph.undirected_edges(rows.where("reveal <= 3")))


# series, scalars, scripts


@query(
    """, line AS (SELECT t, max(p) AS p, max(b) AS b FROM (SELECT event_id * 60 AS t, CAST(round(value * 100) AS BIGINT) AS p, CAST(NULL AS BIGINT) AS b FROM events WHERE event_id % 7 <> 0
      UNION ALL SELECT event_id * 60 + 30 * (event_id % 2), NULL, CAST(event_id // 50 * 10 AS BIGINT) FROM events WHERE event_id % 50 = 7) q GROUP BY t),
    filled AS (SELECT last_value(p IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, last_value(b IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM line),
    mean AS (SELECT b, CAST(floor(100.0 * CAST(sum(p) AS DOUBLE) / count(*)) AS BIGINT) AS price FROM filled WHERE p IS NOT NULL AND b IS NOT NULL GROUP BY b),
    spans AS (SELECT b, price, coalesce(lead(b) OVER (ORDER BY b) - 1, b) AS e FROM mean)
    SELECT CAST(unnest(range(b, e + 1)) AS BIGINT) AS block_num, price FROM spans""",
    "tx",
)
def price_ffill_blocks(spark, d):
    e = table(spark, d, "events")
    prices = e.where("event_id % 7 <> 0").select(F.timestamp_seconds(F.col("event_id") * 60).alias("ts"), F.round(F.col("value") * 100).alias("price"))
    blocks = e.where("event_id % 50 = 7").select(F.timestamp_seconds(F.expr("event_id * 60 + 30 * (event_id % 2)")).alias("ts"), F.expr("event_id div 50 * 10").alias("block_num"))
    return series.price_by_block(prices, blocks).select("block_num", F.floor(F.col("price") * 100).cast("long").alias("price"))


@query("SELECT c_custkey, CAST(c_custkey * 1000003 AS BIGINT) AS value FROM customer")
def le_decode(spark, d):
    big = F.unhex(F.lpad(F.hex(F.col("c_custkey") * 1000003), 16, "0"))
    return table(spark, d, "customer").select("c_custkey", enc.little_endian(F.unhex(enc.reversed_hex(big, 8))).alias("value"))


@query("SELECT c_custkey, sha256(unhex(sha256(c_name))) AS hash FROM customer")
def double_sha256(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.lower(F.hex(enc.hash256(F.col("c_name").cast("binary")))).alias("hash"))


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS vout, sha256(c_name) AS tx_hash FROM customer")
def txo_identity(spark, d):
    whole = enc.txo_id(F.unhex(enc.reversed_hex(enc.sha256(F.col("c_name").cast("binary")), 32)), F.col("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", enc.txo_vout(whole).alias("vout"), enc.txo_hash_hex(whole).alias("tx_hash"))


SCRIPT = """CASE p_partkey % 7 WHEN 0 THEN unhex('76a914' || substr(h, 1, 40) || '88ac') WHEN 1 THEN unhex('a914' || substr(h, 1, 40) || '87') WHEN 2 THEN unhex('0014' || substr(h, 1, 40))
    WHEN 3 THEN unhex('0020' || h) WHEN 4 THEN unhex('2102' || h || 'ac') WHEN 5 THEN unhex('5120' || h) ELSE unhex('6a' || '20' || h || '51') END"""


def _scripts(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "sha2(cast(p_partkey as string), 256) as h").selectExpr("p_partkey", "h", f"{SCRIPT} as script")


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 0 WHEN 5 THEN 4 END AS tp FROM part")
def script_classify(spark, d):
    return _scripts(spark, d).select("p_partkey", enc.canonical_class(F.col("script")).alias("tp"))


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'p2pkh' WHEN 1 THEN 'p2sh' WHEN 2 THEN 'p2wpkh' WHEN 3 THEN 'p2wsh' WHEN 4 THEN 'p2pk' WHEN 5 THEN 'p2wsh' ELSE 'unknown' END AS name FROM part")
def script_match(spark, d):
    return _scripts(spark, d).select("p_partkey", script_functions()["match_script"](F.col("script")).alias("name"))


@query("SELECT p_partkey, h AS owner FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 IN (3, 5) THEN h ELSE substr(h, 1, 40) END AS h FROM (SELECT p_partkey, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part) q WHERE p_partkey % 7 IN (0, 1, 2, 3, 5)) p")
def script_owner(spark, d):
    rows = _scripts(spark, d).where("p_partkey % 7 in (0, 1, 2, 3, 5)")
    return rows.select("p_partkey", F.lower(F.hex(script_functions()["match_owner"](F.col("script"))["owner"])).alias("owner"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'OP_DUP OP_HASH160 ' || substr(h, 1, 40) || ' OP_EQUALVERIFY OP_CHECKSIG' WHEN 1 THEN 'OP_HASH160 ' || substr(h, 1, 40) || ' OP_EQUAL'
    WHEN 2 THEN 'OP_0 ' || substr(h, 1, 40) WHEN 3 THEN 'OP_0 ' || h WHEN 4 THEN '02' || h || ' OP_CHECKSIG' WHEN 5 THEN 'OP_1 ' || h ELSE 'OP_RETURN ' || h || ' OP_1' END AS text
    FROM (SELECT p_partkey, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part) q""")
def script_disassemble(spark, d):
    return _scripts(spark, d).select("p_partkey", F.array_join(script_functions()["decode_script"](F.col("script")), " ").alias("text"))


@query("SELECT p_partkey, true AS same FROM part")
def script_round_trip(spark, d):
    f = script_functions()
    return _scripts(spark, d).select("p_partkey", (f["unparse_script"](f["parse_script"](F.col("script"))) == F.col("script")).alias("same"))


@query("SELECT lower(sha256(unhex('6a20' || sha256(CAST(node_id AS VARCHAR))))) AS hash256, min(block_num) AS reveal FROM created GROUP BY node_id", "created")
def script_first_reveal(spark, d):
    """Scripts that inputs push last and their first blocks, extracted in two batches and merged."""
    hidden = F.unhex(F.concat(F.lit("6a20"), F.sha2(F.col("node_id").cast("string").cast("binary"), 256)))
    rows = view.created(spark, d).select("block_num", F.lit(1).alias("position"), F.concat(F.unhex(F.lit("22")), hidden).alias("script"))
    one = F.struct("script", F.array().cast("array<binary>").alias("witness"))
    txs = rows.select("block_num", "position", F.array(one).alias("inputs"))
    found = merge.merge_scripts(extract.scripts(txs.where("block_num <= 1000")), extract.scripts(txs.where("block_num > 1000")))
    return found.select(F.lower(F.hex("hash256")).alias("hash256"), "reveal")


@query(
    """SELECT alias, CAST(count(DISTINCT lab) AS BIGINT) AS cluster_num_cc, CAST(count(*) AS BIGINT) AS cluster_num_nodes_in_cc FROM (SELECT alias, node_id, min(lab) AS lab FROM r3 GROUP BY alias, node_id) q GROUP BY alias""",
    "r3",
)
def cluster_num_cc_of_sizes(spark, d):
    return features.cluster_num_cc(_inner(spark, d), [1, 2, 3, 5])


@query("SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey > 100 GROUP BY 1")
def raw_sql(spark, d):
    """A query over a store's tables as views."""
    store = scan.Store(spark, f"{shared_dir(spark)}/stores/{uuid4().hex}")
    o = table(spark, d, "orders")
    store.append("alias", o.where("o_custkey % 2 = 0").selectExpr("o_orderkey as node_id", "ascii(o_orderstatus) as alias"))
    store.append("alias", o.where("o_custkey % 2 = 1").selectExpr("o_orderkey as node_id", "ascii(o_orderstatus) as alias"))
    return store.sql("SELECT char(alias) AS status, count(*) AS n FROM alias WHERE node_id > 100 GROUP BY alias")


@query("SELECT CAST(max(c_custkey) AS BIGINT) AS m FROM customer WHERE c_nationkey = 3")
def fetch_one(spark, d):
    """The first row of a raw query."""
    store = scan.Store(spark, f"{shared_dir(spark)}/stores/{uuid4().hex}")
    store.write("alias", table(spark, d, "customer").selectExpr("c_custkey as node_id", "c_nationkey as alias"))
    return spark.createDataFrame([(store.sql("SELECT max(node_id) AS m FROM alias WHERE alias = 3", "one").m,)], "m long")


@query("SELECT CAST(o_orderkey AS BIGINT) AS block_num, CAST(o_custkey AS BIGINT) AS seconds FROM orders")
def block_dates(spark, d):
    """The JSON object of block times, written from a table and read again."""
    rows = table(spark, d, "orders").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), "o_custkey")))).alias("value"))
    path = f"{shared_dir(spark)}/json/{uuid4().hex}"
    rows.write.text(path)
    return read_block_dates(spark, path).select("block_num", F.unix_timestamp("ts").alias("seconds"))


@query("SELECT CAST(1325376000 + p_partkey * 60 AS BIGINT) AS seconds, CAST(p_size AS DOUBLE) AS price FROM part WHERE p_partkey % 5 <> 0")
def market_price(spark, d):
    """The JSON object of prices, with early ones and ones of nothing, which are left out."""
    at = F.expr("case when p_partkey % 10 = 0 then 1000 else 1325376000000 + p_partkey * 60000 + 999 end")
    price = F.expr("case when p_partkey % 10 = 5 then 0D else cast(p_size as double) end")
    rows = table(spark, d, "part").agg(F.to_json(F.struct(F.collect_list(F.struct(at.alias("x"), price.alias("y"))).alias("market-price"))).alias("value"))
    path = f"{shared_dir(spark)}/json/{uuid4().hex}"
    rows.write.text(path)
    return read_market_price(spark, path).select(F.unix_timestamp("ts").alias("seconds"), "price")


@query()
def script_address(spark, d):
    rows = _scripts(spark, d).select("p_partkey", script_functions()["match_owner"](F.col("script")).alias("w"))
    return rows.select("p_partkey", script_functions()["to_address"](F.col("w.owner"), F.col("w.tp")).alias("address"))


#: Owners (hex), classes and their addresses, from public standards.
ADDRESSES = (
    ("62e907b15cbf27d5425399ebf6f0fb50ebb88f18", "p2pkh", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
    ("0000000000000000000000000000000000000000", "p2pkh", "1111111111111111111114oLvT2"),
    ("0000000000000000000000000000000000000000", "p2sh", "31h1vYVSYuKP6AhS86fbRdMw9XHieotbST"),
    ("751e76e8199196d454941c45d1b3a323f1433bd6", "p2wpkh", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"),
    ("1863143c14c5166804bd19203356da136c985678cd4d27a1b8c6329604903262", "p2wsh", "bc1qrp33g0q5c5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3qccfmv3"),
)


@query("SELECT o AS owner, c AS class, a AS address FROM (VALUES " + ", ".join(f"('{o}', '{c}', '{a}')" for o, c, a in ADDRESSES) + ") v(o, c, a)")
def address_vectors(spark, d):
    rows = spark.createDataFrame([x[:2] for x in ADDRESSES], "owner string, class string")
    kind = F.when(F.col("class") == "p2pkh", 1).when(F.col("class") == "p2sh", 2).otherwise(F.when(F.col("class") == "p2wpkh", 3).otherwise(4))
    return rows.select("owner", "class", script_functions()["to_address"](F.unhex("owner"), kind.cast("int")).alias("address"))


@query("SELECT block_num, position, txo_id, value % 10 = 0 AS z1, value % 100 = 0 AS z2 FROM outputs", "outputs")
def trailing_zeros(spark, d):
    return _out(spark, d).select("block_num", "position", "txo_id", enc.ends_with_zeros(F.col("value"), 1).alias("z1"), enc.ends_with_zeros(F.col("value"), 2).alias("z2"))


@query("SELECT p_partkey, CAST(floor(ln(0.1 / (CAST(p_partkey + 1 AS DOUBLE) / 100000000.0)) / ln(10.0)) AS BIGINT) AS zeros FROM part")
def price_zeros(spark, d):
    return table(spark, d, "part").select("p_partkey", enc.order_of(0.1, (F.col("p_partkey") + 1).cast("double")).cast("long").alias("zeros"))


@query("SELECT o_orderkey, (o_orderkey & 63) IN (37, 51) AS tagged FROM orders")
def epobc_tag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", enc.order_tag(F.col("o_orderkey")).alias("tagged"))


# raw transactions


def _raw(spark, d):
    """A raw transaction for each order, of no inputs but one with its key as sequence."""
    exodus = "76a914" + colored.owner_of_address(colored.EXODUS).hex() + "88ac"
    script = f"""CASE o_orderkey % 9 WHEN 0 THEN unhex('6a044f410100') WHEN 1 THEN unhex('6a066f6d6e690001') WHEN 2 THEN unhex('{exodus}') WHEN 3 THEN unhex('6a025858')
        ELSE unhex(concat('76a914', substr(sha2(cast(o_orderkey as string), 256), 1, 40), '88ac')) END"""
    out = f"array(named_struct('vout', 0L, 'value', 0L, 'script', {script}), named_struct('vout', 1L, 'value', 5L, 'script', unhex('6a044f410100')), named_struct('vout', 2L, 'value', 5L, 'script', unhex('05aabb')))"
    return table(spark, d, "orders").selectExpr("o_orderkey as block_num", "1L as position", "array(named_struct('sequence', o_orderkey)) as inputs", f"{out} as outputs")


@query("""SELECT block, CAST(1 AS BIGINT) AS position, oa, epobc, ol_ab, ol_c FROM (SELECT o_orderkey AS block, CASE WHEN o_orderkey % 9 IN (1, 3) THEN 0 ELSE 1 END AS oa, CASE WHEN (o_orderkey & 63) IN (37, 51) THEN 1 ELSE 0 END AS epobc,
    CASE WHEN o_orderkey % 9 = 2 THEN 1 ELSE 0 END AS ol_ab, CASE WHEN o_orderkey % 9 = 1 THEN 1 ELSE 0 END AS ol_c FROM orders) q WHERE oa + epobc + ol_ab + ol_c > 0""")
def detect_colored(spark, d):
    return colored.flags(_raw(spark, d))


def _block_files(spark, d):
    """Block files, one of each day of the ledger view: its outputs by transaction, written and parsed again."""
    import pandas as pd

    from ..sources.blockfile import parse_file, write_block, write_transaction

    rows = view.created(spark, d).groupBy("block_num", "position").agg(F.array_sort(F.collect_list(F.struct("vout", "value"))).alias("outs"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        number = int(frame["block_num"].iloc[0])
        made = [write_transaction([(bytes(32), k, b"\x51", k, [])], [(int(o["value"]) * (int(o["vout"]) % 3 > 0), b"\x51") for o in outs]) for k, outs in enumerate(frame["outs"])]
        raw, _ = write_block(number.to_bytes(32, "little"), made)
        out = []
        for block in parse_file(raw):
            for k, t in enumerate(block["transactions"]):
                out.append((number, k, block["num_transactions"], len(t["inputs"]), len(t["outputs"]), sum(o["value"] for o in t["outputs"])))
        return pd.DataFrame(out, columns=["block_num", "position", "num_transactions", "num_in", "num_out", "value"])

    return rows.groupBy("block_num").applyInPandas(run, "block_num long, position long, num_transactions long, num_in long, num_out long, value long")


@query(
    """SELECT block_num, CAST(row_number() OVER (PARTITION BY block_num ORDER BY position) - 1 AS BIGINT) AS position, CAST(count(*) OVER (PARTITION BY block_num) AS BIGINT) AS num_transactions,
    CAST(1 AS BIGINT) AS num_in, CAST(n AS BIGINT) AS num_out, CAST(v AS BIGINT) AS value FROM (SELECT block_num, position, count(CASE WHEN vout % 3 > 0 THEN 1 END) AS n, coalesce(sum(CASE WHEN vout % 3 > 0 THEN value END), 0) AS v FROM created GROUP BY block_num, position) q""",
    "created",
)
def blockfile_parse(spark, d):
    return _block_files(spark, d)


#: Days of the ledger view in one block file.
DAYS = 200


def _written(spark, d) -> str:
    """A folder of block files, a block for each day of the ledger view, DAYS of them in a file."""
    import pandas as pd

    from ..sources.blockfile import file_name, write_block, write_transaction

    rows = view.created(spark, d).groupBy("block_num", "position").agg(F.array_sort(F.collect_list(F.struct("vout", "value"))).alias("outs"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, day in frame.sort_values(["block_num", "position"]).groupby("block_num"):
            made = [write_transaction([(bytes(32), k, b"\x51", k, [])], [(int(o["value"]) * (int(o["vout"]) % 3 > 0), b"\x51") for o in outs]) for k, outs in enumerate(day["outs"])]
            out.append(write_block(int(number).to_bytes(32, "little"), made)[0])
        return pd.DataFrame({"num_file": [int(frame["block_num"].iloc[0]) // DAYS], "raw": [b"".join(out)]})

    folder = f"{shared_dir(spark)}/blocks/{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows.groupBy(F.expr(f"block_num div {DAYS}")).applyInPandas(run, "num_file int, raw binary").toLocalIterator():
        to = fs.create(path(f"{folder}/{file_name(r.num_file)}"))
        to.write(bytearray(r.raw))
        to.close()
    return folder


def _day():
    return enc.little_endian(F.substring("previous_hash", 1, 8)).alias("block_num")


@query(
    """SELECT * FROM (SELECT block_num, CAST(row_number() OVER (PARTITION BY block_num ORDER BY position) - 1 AS BIGINT) AS position, CAST(count(*) OVER (PARTITION BY block_num) AS BIGINT) AS num_transactions,
    CAST(1 AS BIGINT) AS num_in, CAST(n AS BIGINT) AS num_out, CAST(v AS BIGINT) AS value FROM (SELECT block_num, position, count(CASE WHEN vout % 3 > 0 THEN 1 END) AS n, coalesce(sum(CASE WHEN vout % 3 > 0 THEN value END), 0) AS v FROM created GROUP BY block_num, position) q) q WHERE block_num BETWEEN 400 AND 1399""",
    "created",
)
def blockfile_scan(spark, d):
    """Files of a folder by their numbers; the others aren't opened."""
    t = read_blocks(spark, _written(spark, d), files=list(range(400 // DAYS, 1400 // DAYS))).select(_day(), "num_transactions", F.posexplode("transactions").alias("position", "t"))
    value = F.aggregate("t.outputs", F.lit(0).cast("long"), lambda n, o: n + o.value)
    return t.select("block_num", F.col("position").cast("long").alias("position"), F.col("num_transactions").cast("long").alias("num_transactions"), F.size("t.inputs").cast("long").alias("num_in"), F.size("t.outputs").cast("long").alias("num_out"), value.alias("value"))


@query("SELECT block_num, CAST(count(DISTINCT position) AS BIGINT) AS num_transactions, CAST(block_num // 200 AS BIGINT) AS num_file FROM created GROUP BY block_num", "created")
def blockfile_headers(spark, d):
    """The index scan: headers of all files."""
    return read_blocks(spark, _written(spark, d), headers_only=True).select(_day(), F.col("num_transactions").cast("long").alias("num_transactions"), F.col("num_file").cast("long").alias("num_file"))


@query(
    """SELECT block_num, CAST(p AS BIGINT) AS position, CAST(k AS BIGINT) AS vout, value FROM (SELECT block_num, dense_rank() OVER (PARTITION BY block_num ORDER BY position) - 1 AS p,
    row_number() OVER (PARTITION BY block_num, position ORDER BY vout, value) - 1 AS k, vout, value FROM created) q WHERE vout % 3 > 0 AND value > 0""",
    "created",
)
def blockfile_extract(spark, d):
    """Created outputs of the transactions of files."""
    found = read_blocks(spark, _written(spark, d)).withColumn("num", _day())
    return extract.created_txos(extract.transactions(found)).select("block_num", "position", F.col("vout").cast("long").alias("vout"), "value")


@query("SELECT c_custkey, CAST(c_custkey - (SELECT min(c_custkey) FROM customer) AS BIGINT) AS num FROM customer")
def chain_link(spark, d):
    """A chain of customers by key, with short branches beside it."""
    h = lambda k: enc.sha256(F.concat(F.lit("b"), k.cast("string")).cast("binary"))
    c = table(spark, d, "customer").select("c_custkey")
    main = c.select(h(F.col("c_custkey")).alias("hash"), h(F.col("c_custkey") - 1).alias("previous_hash"), "c_custkey")
    side = c.where("c_custkey % 10 = 3").select(h(-F.col("c_custkey")).alias("hash"), h(F.col("c_custkey") - 1).alias("previous_hash"), (-F.col("c_custkey")).alias("c_custkey"))
    both = main.unionByName(side.where(F.col("c_custkey") > -100))
    return chain.link_chain(both).select("c_custkey", "num")


@query("SELECT block_num, position, CAST(1 AS BIGINT) AS known FROM tx WHERE block_num % 3 = 0 AND block_num >= 30", "tx")
def block_lookup(spark, d):
    t = view.transactions(spark, d)
    rows = t.select(enc.sha256(F.col("block_num").cast("string").cast("binary")).alias("hash"), "position")
    index = t.select("block_num").distinct().where("block_num % 3 = 0").select(enc.sha256(F.col("block_num").cast("string").cast("binary")).alias("hash"), F.col("block_num").alias("num"))
    return extract.numbered(rows, index, 30).select(F.col("num").alias("block_num"), "position", F.lit(1).cast("long").alias("known"))


def as_of(day: str) -> int:
    """The block number of a day in the ledger view."""
    return (datetime.fromisoformat(day) - datetime.fromisoformat(view.EPOCH)).days
