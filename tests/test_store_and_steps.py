"""Writes, upserts, block files, the chain, whole runs and the stream."""

import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.functions.hashes import hash160, hash256
from ledgerloom.operators import chain, merge
from ledgerloom.operators.scan import Store, condition, scan
from ledgerloom.plans import steps
from ledgerloom.sources import blockfile as bf
from ledgerloom.sources.series import read_block_dates, read_market_price
from ledgerloom.streaming import incremental

GENESIS = bytes.fromhex(
    "0100000000000000000000000000000000000000000000000000000000000000000000003ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a29ab5f49ffff001d1dac2b7c"
    "0101000000010000000000000000000000000000000000000000000000000000000000000000ffffffff4d04ffff001d0104455468652054696d65732030332f4a616e2f32303039204368616e63656c6c6f72206f6e206272696e6b206f66207365636f6e64206261696c6f757420666f722062616e6b73ffffffff"
    "0100f2052a01000000434104678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5fac00000000"
)


def test_genesis_block():
    raw = b"\xf9\xbe\xb4\xd9" + struct.pack("<I", len(GENESIS)) + GENESIS
    (block,) = bf.parse_file(raw + bytes(16))
    assert block["hash"][::-1].hex() == "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f"
    (t,) = block["transactions"]
    assert t["tx_hash"][::-1].hex() == "4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b"
    assert t["outputs"][0]["value"] == 5_000_000_000 and t["inputs"][0]["vout"] == -1


def test_transactions_round_trip():
    h = bytes(range(32))
    plain = [(h, 3, b"\x01\x51", 7, [])]
    marked = [(h, 3, b"\x01\x51", 7, [b"ab", b""])]
    outs = [(0, b"\x6a"), (9, b"\x51"), (1 << 40, b"\x52" * 300)]
    raw, _ = bf.write_block(bytes(32), [bf.write_transaction(x, outs) for x in (plain, plain, marked)])
    (block,) = bf.parse_file(raw)
    a, b, c = block["transactions"]
    assert a["tx_hash"] == b["tx_hash"] == c["tx_hash"] == hash256(bf.write_transaction(plain, outs))
    assert [o["vout"] for o in b["outputs"]] == [1, 2] and c["inputs"][0]["witness"] == b"\x02\x02ab\x00" and b["inputs"][0]["sequence"] == 7
    (block,) = bf.parse_file(raw, drop_zero=False)
    assert [o["vout"] for o in block["transactions"][1]["outputs"]] == [0, 1, 2]
    assert len(list(bf.parse_file(raw * 3, max_blocks=2))) == 2
    with pytest.raises(bf.Malformed):
        list(bf.parse_file(raw[:-3]))


def pay(owner: int) -> bytes:
    return b"\x76\xa9\x14" + bytes([owner]) * 20 + b"\x88\xac"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two files: three blocks, one of them on a branch."""
    top = tmp_path_factory.mktemp("blocks")
    coin = lambda n, owner: bf.write_transaction([(bytes(32), 0xFFFFFFFF, bytes([n]), 0, [])], [(50, pay(owner))])
    c0, c1, c2 = coin(0, 1), coin(1, 2), coin(2, 9)
    b0, h0 = bf.write_block(bytes(32), [c0], 0)
    b1, h1 = bf.write_block(h0, [c1], 1)
    side, _ = bf.write_block(h0, [coin(9, 8)], 77)
    spend = bf.write_transaction([(hash256(c0), 0, b"\x01\x51", 0x25, []), (hash256(c1), 0, b"", 1, [b"\x52"])], [(60, pay(3)), (0, b"\x6a\x04omni"), (30, pay(1)), (5, b"\x05\xaa")])
    b2, h2 = bf.write_block(h1, [c2, spend], 2)
    (top / "blk00000.dat").write_bytes(b0 + side)
    (top / "blk00001.dat").write_bytes(b2 + b1 + bytes(8))
    return top, (h0, h1, h2)


def test_run(spark, folder, tmp_path):
    top, hashes = folder
    store = Store(spark, f"file://{tmp_path}/store")
    (tmp_path / "p.json").write_text('{"market-price": [{"x": 1325376000000, "y": 5.0}]}')
    (tmp_path / "d.json").write_text('{"0": 1325376000, "10": 1325379600}')
    config = Config.from_dict({
        "folder": f"file://{top}", "start": 0, "end": 10, "blocks": {"do": True}, "txos": {"do": True, "add_script": True}, "coinjoin": {"do": True}, "colored_coins": {"do": True},
        "alias": {"do": True, "insert_alias": True, "market_price": f"file://{tmp_path}/p.json", "block_dates": f"file://{tmp_path}/d.json"}, "transaction_edges": {"do": True, "exclude_colored_coin": False}, "undirected_transaction_edges": {"do": True}, "features": {"do": True, "do_cluster_features": True},
    })
    steps.run(spark, store, config)
    assert {bytes(r.hash): (r.num, r.num_file) for r in store.read("blocks").collect()} == {hashes[0]: (0, 0), hashes[1]: (1, 1), hashes[2]: (2, 1)}
    made = {(r.block_num, r.position, r.vout): r.value for r in store.read("created_txos").collect()}
    assert made == {(0, 0, 0): 50, (1, 0, 0): 50, (2, 0, 0): 50, (2, 1, 0): 60, (2, 1, 2): 30}
    names = {bytes(r.hash): r.node_id for r in store.read("nodes").collect()}
    one, two, three, nine = (names[bytes([k]) * 20] for k in (1, 2, 3, 9))
    nodes = {r.node_id: (r.reveal, r.reuse) for r in store.read("nodes").collect()}
    assert nodes == {one: (0, 2), two: (1, None), three: (2, None), nine: (2, None)} and sorted(nodes) == [0, 1, 2, 3]
    assert {bytes(r.hash160) for r in store.read("scripts").collect()} == {hash160(b"\x51"), hash160(b"\x52")}
    assert [(r.block, r.position, r.epobc, r.ol_c) for r in store.read("colored_coin").collect()] == [(2, 1, 1, 1)]
    assert store.read("coinjoin").count() == 0
    alias = {r.node_id: r.alias for r in store.read("alias").collect()}
    assert alias == {one: min(one, two), two: min(one, two)}
    edges = [(r.a, r.b, r.total_sent) for r in store.read("transaction_edges").collect()]
    assert edges == [(min(one, two), three, 60)]
    feats = {r.alias: (r.degree, r.degree_in, r.degree_out, r.cluster_size, r.total_received) for r in store.read("node_features").collect()}
    assert feats[three] == (1, 1, None, 1, 60) and feats[min(one, two)][2] == 1
    before = store.progress("spent_txos")
    steps.txos(spark, store, config)  # nothing is left to do
    assert store.progress("spent_txos") == before and store.len("created_txos") == 5


def test_incremental_txos(spark, folder, tmp_path):
    top, _ = folder
    whole, parts = Store(spark, f"file://{tmp_path}/a"), Store(spark, f"file://{tmp_path}/b")
    config = Config.from_dict({"folder": f"file://{top}", "end": 10})
    for store, ends in ((whole, [10]), (parts, [1, 10])):
        steps.blocks(spark, store, config)
        for end in ends:
            steps.txos(spark, store, Config.from_dict({"folder": f"file://{top}", "end": end}))
    read = lambda st, t, *c: sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in st.read(t).select(*c).collect())
    assert read(whole, "nodes", "hash", "reveal") == read(parts, "nodes", "hash", "reveal")
    assert read(whole, "nodes", "hash", F.coalesce("reuse", F.lit(-1))) == read(parts, "nodes", "hash", F.coalesce("reuse", F.lit(-1)))
    assert read(whole, "created_txos", "txo_id", "value") == read(parts, "created_txos", "txo_id", "value")


def test_block_scan(spark, folder):
    top, _ = folder
    assert bf.read_blocks(spark, f"file://{top}").count() == 4
    assert bf.read_blocks(spark, f"file://{top}", files=[1], headers_only=True).select("num_file").distinct().collect()[0][0] == 1
    assert bf.read_blocks(spark, f"file://{top}", max_blocks=1).count() == 2


def test_chain_of_forks(spark):
    h = lambda x: x.encode()
    rows = [("a", ""), ("b", "a"), ("c", "b"), ("x", "a"), ("y", "x"), ("d", "c"), ("d", "c")]
    df = spark.createDataFrame([(h(a), h(b)) for a, b in rows], "hash binary, previous_hash binary")
    assert {bytes(r.hash).decode(): r.num for r in chain.link_chain(df, 5).collect()} == {"a": 5, "b": 6, "c": 7, "d": 8}
    assert chain.link_chain(df.limit(0)).count() == 0


def test_scan(spark):
    df = spark.createDataFrame([(1, "a'b"), (2, "x"), (3, None)], "k long, v string")
    assert [r.k for r in scan(df, ["k"], [("v", "=", "a'b")]).collect()] == [1]
    assert [r.k for r in scan(df, None, [("k", "!=", 2)], "k", "desc", 1).collect()] == [3]
    assert scan(df, ["v"], [("v", "IN", [])]).count() == 0
    for bad in (("k", "LIKE", 1), ("k", "<", [1])):
        with pytest.raises(ValueError):
            condition(*bad)
    with pytest.raises(ValueError):
        scan(df, order="up")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read("alias").count() == 0 and not store.exists("alias") and store.progress("nodes") == -1
    rows = spark.createDataFrame([(1, 5), (2, 5)], "node_id long, alias long")
    store.append("alias", rows)
    store.append("alias", rows.limit(1))
    assert store.len("alias") == 3 and store.sql("select max(node_id) as m from alias", "one").m == 2
    assert len(store.sql("select * from alias", "all")) == 3 and store.sql("select * from alias").count() == 3
    with pytest.raises(ValueError):
        store.sql("select 1", "some")
    store.write("alias", merge.delete_where(store.read("alias"), F.col("node_id") == 1))
    assert [r.node_id for r in store.fetch("alias", columns=["node_id"]).collect()] == [2]
    with pytest.raises(Exception):  # noqa: B017
        store.write("alias", rows.select(F.assert_true(F.lit(False)).alias("node_id")))
    assert store.len("alias") == 1
    store.drop("alias")
    assert not store.exists("alias")


def test_appends_keep_files_and_block_ranges(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda a, b: spark.range(a, b).selectExpr("id as block_num", "id % 3 as position", "cast(cast(id as string) as binary) as txo_id").repartition(3)
    first = set(store.write("spent_txos", rows(0, 100)).inputFiles())
    both = set(store.append("spent_txos", rows(100, 200)).inputFiles())
    assert first < both and store.len("spent_txos") == 200 and store.progress("spent_txos") == 199
    (tmp_path / "s/spent_txos/v0+7").mkdir()  # an addition that wasn't finished
    assert store.len("spent_txos") == 200
    assert store.write("spent_txos", store.read("spent_txos").where("block_num < 150")).count() == 150 and store.append("spent_txos", rows(150, 151)).count() == 151


def test_round_values_need_prices(spark, tmp_path):
    with pytest.raises(ValueError, match="price"):
        steps.alias(spark, Store(spark, f"file://{tmp_path}/s"), Config.from_dict({"alias": {"do": True, "round_output_value": True}}))


def test_merges(spark):
    edge = "a long, b long, reveal long, last_seen long, total long, min_sent long, max_sent long, total_sent long"
    old, new = spark.createDataFrame([(1, 2, 5, 9, 2, 3, 8, 11)], edge), spark.createDataFrame([(1, 2, 4, 7, 1, 1, 1, 1)], edge)
    want = [(1, 2, 4, 9, 3, 1, 8, 12)]
    assert [tuple(r) for r in merge.merge_edges(old, new).collect()] == [tuple(r) for r in merge.merge_edges(new, old).collect()] == want
    feats = spark.createDataFrame([(1, 4, None), (2, 7, 1)], "alias long, degree long, cluster_size long")
    up = spark.createDataFrame([(1, 3), (5, 9)], "alias long, cluster_size long")
    assert {tuple(r) for r in merge.upsert(feats, up, "alias").select("alias", "degree", "cluster_size").collect()} == {(1, 4, 3), (2, 7, 1), (5, None, 9)}
    ignored = merge.insert_ignore(up, spark.createDataFrame([(1, 8), (6, 2), (6, 1)], "alias long, cluster_size long"), ["alias"])
    assert {tuple(r) for r in ignored.collect()} == {(1, 3), (5, 9), (6, 1)}
    ids = merge.with_ids(spark.createDataFrame([(b"k", 4)], "hash binary, node_id long"), spark.createDataFrame([(b"z",), (b"a",), (b"k",), (b"a",), (None,), (b"",)], "hash binary"))
    assert {bytes(r.hash): r.node_id for r in ids.collect()} == {b"k": 4, b"": 5, b"a": 6, b"z": 7}


def test_series_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"0": 1231006505, "1000": 1232346882}')
    (tmp_path / "p.json").write_text('{"market-price": [{"x": 1325376000000, "y": 5.0}, {"x": 1325462400000, "y": 0.0}, {"x": 1200000000000, "y": 3.0}]}')
    assert {r.block_num for r in read_block_dates(spark, f"file://{tmp_path}/d.json").collect()} == {0, 1000}
    assert [r.price for r in read_market_price(spark, f"file://{tmp_path}/p.json").collect()] == [5.0]


def test_stream(spark, tmp_path):
    schema = "block_num long, a long, b long, value long"
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [(1, 1, 2, 5), (2, 1, 2, 7), (2, 3, 3, 9), (4, 2, 1, 1)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        incremental.maintain_edges(source, store, f"file://{tmp_path}/check").awaitTermination()
        assert store.read("transaction_edges").agg(F.max("batch")).first()[0] == k
    got = {(r.a, r.b): (r.reveal, r.last_seen, r.total, r.total_sent) for r in store.read("transaction_edges").where("batch is null").collect()}
    assert got == {(1, 2): (1, 2, 2, 12), (2, 1): (4, 4, 1, 1)}


def test_config():
    assert Config.from_dict({}).start == 0 and Config.from_dict({"alias": {"round_output_value_x": 0.1}}).alias.round_output_value_x == 0.1
    with pytest.raises(ValueError):
        Config.from_dict({"nothing": 1})
