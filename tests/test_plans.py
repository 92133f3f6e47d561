from decimal import Decimal

from pyspark.sql import functions as F

from glasspool.plans import addresses, clusters, heuristics, overview, reports, series
from glasspool.operators import components
from tests.conftest import money, rows


def small_ledger(build):
    """t1 mines to a; t2 spends it to b and (c, d); t3 shields b; t4 deshields to a and e."""
    return build.ledger(
        block=build.blocks(b0=0, b1=1, b3=3),
        transaction=build.transactions(
            ("t1", "b0", "minerReward"),
            ("t2", "b1", "public"),
            ("t3", "b1", "shielded"),
            ("t4", "b3", "deshielded"),
        ),
        coingen=build.coingen("t1"),
        vin=build.vin(("t2", "t1", 0, ["a"], 10), ("t3", "t2", 0, ["b"], 4)),
        vout=build.vout(
            ("t1", 0, ["a"], 10),
            ("t1", 1, ["f"], "2.5"),
            ("t2", 0, ["b"], 4),
            ("t2", 1, ["d", "c"], 6),
            ("t4", 0, ["a"], 3),
            ("t4", 1, [], 1),
        ),
        vjoinsplit=build.joinsplits(
            ("t3", 4, 0, ["b"], None), ("t4", 0, 4, None, ["a"])
        ),
    )


def test_address_stats(build):
    stats = addresses.address_stats(small_ledger(build))
    found = {row["address"]: row.asDict() for row in stats.collect()}
    assert set(found) == {"a", "b", "c,d", "f", ""}
    a = found["a"]
    assert (a["recv"], a["sent"], a["current_value"]) == (money(13), money(10), money(3))
    assert (a["txs_recv"], a["txs_sent"], a["no_txs_total"]) == (2, 1, 3)
    assert (a["coingens_recv"], a["pool_recv"], a["pool_sent"]) == (1, money(3), money(0))
    assert found["b"]["pool_sent"] == money(4)
    assert found["f"]["no_txs_total"] == 1
    assert found[""]["pool_recv"] == money(1)
    old = addresses.address_stats(small_ledger(build), parity=True)
    totals = {row["address"]: row["no_txs_total"] for row in old.collect()}
    assert totals["a"] == 3 and totals["f"] == 0


def test_rich_list_orders_ties_by_address(build):
    ledger = build.ledger(
        vout=build.vout(("t", 0, ["b"], 5), ("t", 1, ["a"], 5), ("t", 2, [], 9), ("t", 3, ["c"], 1))
    )
    top = addresses.rich_list(addresses.address_stats(ledger), "recv", 2).collect()
    assert [row["address"] for row in top] == ["a", "b"]


def test_profiles_of_one_and_of_many_agree(build):
    ledger = small_ledger(build)
    single = [
        row
        for name in ("a", "b", "f")
        for row in rows(addresses.address_profile(ledger, name))
    ]
    many = addresses.address_profile(ledger, build.addresses("a", "b", "f", "nobody"))
    assert sorted(single) == rows(many)
    a = addresses.address_profile(ledger, "a").first()
    assert (a["from_height"], a["to_height"]) == (0, 3)
    assert (a["txs_sent"], a["txs_recv"], a["coingens"], a["blocks_mined"]) == (1, 2, 1, 1)
    assert (a["joinsplits_out"], a["total_deshielded"]) == (1, money(4))
    assert a["joinsplits_in_ok"] and a["joinsplits_out_ok"]
    founder = addresses.address_profile(ledger, "f").first()
    assert (founder["coingens"], founder["blocks_mined"]) == (1, 0)


def test_profile_flags_joinsplits_that_move_nothing_that_way(build):
    ledger = small_ledger(build).with_tables(
        vjoinsplit=build.joinsplits(("t3", 4, 0, ["b"], None), ("t3", 0, 1, ["b"], None))
    )
    b = addresses.address_profile(ledger, "b").first()
    assert b["joinsplits_in"] == 2 and not b["joinsplits_in_ok"]


def test_pool_flows_leave_out_mixed_and_multi_source(build):
    ledger = build.ledger(
        transaction=build.transactions(("m", "b", "mixed"), ("d", "b", "deshielded")),
        vout=build.vout(("m", 0, ["a"], 7), ("d", 0, ["a"], 2)),
        vjoinsplit=build.joinsplits(("m", 5, 0, ["a", "b"], ["a"]), ("s", 3, 0, ["a"], None)),
    )
    assert rows(addresses.pool_flows(ledger)) == [("a", money(3), money(2))]


def test_stitched_rows(build):
    ledger = build.ledger(
        vout=build.vout(("t", 0, ["a"], 1), ("t", 1, [], 2), ("t", 2, ["b", "c"], 3)),
        vin=build.vin(("u", "t", 0, ["a"], 1), ("u", "x", 0, ["z"], 4)),
    )
    found = {row["stitched"]: row["label"] for row in addresses.stitched_rows(ledger).collect()}
    assert found == {"a": "a", "": None, "b": None, "z": "z"}


def test_initial_analysis_and_shares(build):
    ledger = small_ledger(build)
    found = {row["item"]: (row["amount"], row["percentage"]) for row in overview.initial_analysis(ledger).collect()}
    assert found["blocks"] == (3, None)
    assert found["transactions"] == (4, None)
    assert found["type public"] == (1, Decimal("25.00"))
    share = overview.public_share(ledger.transaction).first()
    assert share["public_percentage"] == Decimal("25.00")
    lines = [row["line"] for row in reports.initial_analysis_lines(overview.initial_analysis(ledger)).collect()]
    assert "type public\t1\t25.00" in lines and "blocks\t3" in lines


def test_array_size_histogram(spark):
    dump = spark.createDataFrame(
        [("{a,b}", "{}"), ("{c,d}", "{e}")], "nullifiers string, commitments string"
    )
    assert rows(overview.joinsplit_array_sizes(dump)) == [
        ("commitments", 0, 1),
        ("commitments", 1, 1),
        ("nullifiers", 2, 2),
    ]


def test_series(build):
    ledger = small_ledger(build)
    types = series.types_per_height(ledger).orderBy("height").collect()
    assert [row["public"] for row in types] == [0, 1, 0, 0]
    assert [row["other"] for row in types] == [1, 0, 0, 0]
    cumulative = series.types_cumulative(ledger).orderBy("height").collect()
    assert [row["shielded"] for row in cumulative] == [0, 1, 1, 1]
    pool = series.pool_value_over_height(ledger).orderBy("height").collect()
    assert [row["pool_value"] for row in pool] == [money(v) for v in (0, 4, 4, 0)]
    flows = series.deposits_withdrawals(ledger).orderBy("height").collect()
    assert [row["withdrawals"] for row in flows] == [money(v) for v in (0, 0, 0, -4)]
    short = series.pool_value_over_height(ledger, limit=1)
    assert short.count() == 2


def test_identities_prefer_miners_and_leave_the_nameless_to_others(build):
    ledger = small_ledger(build)
    both = build.addresses("a")
    found = series.withdrawals_by_identity(ledger, both, both).orderBy("height").collect()
    last = found[-1]
    assert (last["miners_value"], last["founders_value"], last["others_value"]) == (
        money(3),
        money(0),
        money(1),
    )
    assert last["all_value"] == money(4)
    deposits = series.deposits_by_identity(ledger, build.addresses("x"), build.addresses("b"))
    assert deposits.orderBy(F.desc("height")).first()["founders_value"] == money(4)


def test_founder_sized_amounts(build):
    ledger = build.ledger(
        block=build.blocks(b=0),
        transaction=build.transactions(("t", "b", "mixed")),
        vjoinsplit=build.joinsplits(
            ("t", "249.9999", 0, None, None),
            ("t", "249.9999", 0, None, None),
            ("t", 0, "250.0001", None, None),
            ("t", "249.99990001", 0, None, None),
        ),
    )
    row = series.founder_correlation(ledger).first()
    assert (row["deposits"], row["withdrawals"]) == (money("499.9998"), money("250.0001"))


def test_trivial_miners_take_first_addresses_without_founders(build):
    ledger = build.ledger(
        coingen=build.coingen("t1"),
        vout=build.vout(
            ("t1", 0, ["m", "other"], 1), ("t1", 1, ["f"], 1), ("t1", 2, [], 1), ("t2", 0, ["x"], 1)
        ),
    )
    assert rows(heuristics.trivial_miners(ledger, build.addresses("f"))) == [("m",)]


def test_heuristics_three_and_four(build):
    joinsplits = build.joinsplits(
        ("t1", 0, "250.0001", None, None),
        ("t2", 0, 250, None, None),
        ("t3", 0, 1, None, None),
        ("t3", 0, 2, None, None),
        ("t4", 0, 1, None, None),
        ("t5", 0, 1, None, None),
    )
    vout = build.vout(
        ("t1", 0, ["f"], 1), ("t1", 1, ["g", "f"], 1), ("t2", 0, ["h"], 1),
        ("t3", 0, ["p", "m1"], 1), ("t3", 1, ["m1", "m2"], 1), ("t4", 0, ["p", "m6"], 1),
        ("t6", 0, ["p", "m7", "m8"], 1), ("t5", 0, [], 1),
    )
    assert rows(heuristics.heuristic3_founders(joinsplits, vout)) == [("f",), ("g",)]
    pools = build.tagged(p="pool one")
    found = heuristics.heuristic4_miners(joinsplits, vout, pools, 2)
    assert rows(found) == [("m1",), ("m2",), ("p",)]
    assert rows(heuristics.heuristic4_miners(joinsplits, vout, build.tagged(q="none"), 2)) == []


def test_many_joinsplits_and_addresses_give_no_pairs(build, spark):
    """1,000 addresses of a transaction with 1,000 joinsplits: one row for each address."""
    names = [f"a{k:04}" for k in range(1000)]
    ledger = build.ledger(
        block=build.blocks(b1=1),
        transaction=build.transactions(("t", "b1", "deshielded")),
        vout=build.vout(*(("t", k, [name], 1) for k, name in enumerate(names))),
        vjoinsplit=build.joinsplits(*(("t", 0, 1, None, None) for _ in range(1000))),
    )
    profile = addresses.address_profile(ledger, build.addresses(*names))
    found = profile.select("joinsplits_out", "total_deshielded", "joinsplits_out_ok").distinct().collect()
    assert profile.count() == 1000 and [tuple(r) for r in found] == [(1000, money(1000), True)]


def test_heuristic_five_wants_unique_amounts_and_a_later_block(build):
    transactions = [(f"d{i}", "b1", "shielded") for i in range(5)]
    transactions += [("w0", "b2", "deshielded"), ("w1", "b1", "deshielded")]
    transactions += [("w2", "b2", "deshielded"), ("w3", "b2", "deshielded")]
    ledger = build.ledger(
        block=build.blocks(b1=1, b2=2),
        transaction=build.transactions(*transactions),
        vjoinsplit=build.joinsplits(
            ("d0", 10, 0, None, None),
            ("w0", 0, 10, None, None),
            ("d1", 20, 0, None, None),  # withdrawn in the same block
            ("w1", 0, 20, None, None),
            ("d2", 30, 0, None, None),  # the amount occurs twice on one side
            ("d3", 30, 0, None, None),
            ("w2", 0, 30, None, None),
            ("d4", 40, 0, None, None),  # twice inside one transaction
            ("w3", 0, 40, None, None),
            ("w3", 0, 40, None, None),
        ),
    )
    links = heuristics.heuristic5_links(ledger)
    assert [(row["deposit_tx"], row["withdrawal_tx"]) for row in links.collect()] == [("d0", "w0")]
    assert rows(reports.heuristic5_lines(links)) == [("d0 --> w0",)]


def cluster_case(build, spark, workspace):
    vin = build.vin(
        ("t1", "p", 0, ["a"], 1),
        ("t1", "p", 1, ["b"], 1),
        ("t2", "p", 2, ["b"], 1),
        ("t2", "p", 3, ["c"], 1),
        ("t3", "p", 4, ["x"], 1),
        ("t3", "p", 5, ["y"], 1),
    )
    members = components.connected_components(
        components.cospend_edges(components.cospend_links(vin)), workspace
    )
    return vin, members, clusters.cluster_ranks(members, workspace)


def test_cluster_reports(build, spark, workspace):
    vin, members, ranks = cluster_case(build, spark, workspace)
    assert rows(members) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert rows(ranks.select("cluster_rank", "cluster_id", "cluster_size")) == [(0, "a", 3), (1, "x", 2)]
    stats = addresses.address_stats(
        build.ledger(vin=vin, vout=build.vout(("q", 0, ["a"], 8), ("q", 1, ["x"], 2)))
    )
    pairs = components.multi_input_pairs(vin)
    table = clusters.cluster_stats(members, ranks, pairs, stats).orderBy("cluster_rank").collect()
    assert [row["total_distinct_txs"] for row in table] == [2, 1]
    assert [row["total_recv"] for row in table] == [money(8), money(2)]
    assert [row["total_sent"] for row in table] == [money(4), money(2)]
    concentration = {
        row["metric"]: row
        for row in clusters.cluster_concentration(
            clusters.cluster_stats(members, ranks, pairs, stats), F.lit(10), F.lit(6), (1,)
        ).collect()
    }
    assert concentration["total_recv"]["top_1"] == Decimal("80.00")
    assert concentration["cluster_size"]["top_1"] == Decimal("30.00")
    assert concentration["total_distinct_txs"]["top_all"] == Decimal("50.00")
    assert concentration["total_pool_recv"]["top_all"] is None
    summary = dict(
        (row["metric"], row["metric_value"])
        for row in clusters.cluster_summary(
            ranks, build.transactions(("t1", "b", "public")), (1, 5)
        ).collect()
    )
    assert summary == {
        "clusters": 2,
        "largest_cluster": 3,
        "addresses_in_top_1": 3,
        "addresses_in_top_5": 5,
        "clustered_addresses": 5,
        "transactions": 1,
    }
    links = components.cospend_links(vin)
    assert rows(clusters.largest_cluster_links(links, members, ranks)) == [
        ("t1", "a", "b"),
        ("t2", "b", "c"),
    ]
    found = clusters.cluster_lookup(build.addresses("c", "y", "nobody"), members, ranks)
    assert rows(found) == [(0, "a", "c"), (1, "x", "y")]
    missing = clusters.members_without_stats(members, stats.filter("address <> 'c'"))
    assert rows(missing.select("address")) == [("c",)]


def test_cluster_tags_and_coverage(build, spark, workspace):
    _, members, _ = cluster_case(build, spark, workspace)
    none = build.addresses("nobody")
    lists = clusters.AddressLists(
        pools=build.tagged(a="pool one", b="pool one", x="pool two"),
        miners=none,
        founders=build.addresses("c"),
        heuristic_miners=build.addresses("a", "m2", "m3"),
        heuristic_founders=build.addresses("c", "f2"),
        tags=build.tagged(nobody="tag"),
    )
    tags = clusters.cluster_tags(members, lists)
    first = tags.filter("cluster_id = 'a'").first()
    assert (first["pool_count"], first["founder_count"], first["tag_count"]) == (2, 1, 0)
    names = clusters.cluster_tag_names(members, lists).filter("cluster_id = 'a'")
    assert rows(names.select("kind", "tag", "addresses")) == [("pool", "pool one", 2)]
    blank = spark.createDataFrame([(0, "a"), (1, "other")], "cluster_rank int, cluster_id string")
    table = clusters.cluster_table(blank, tags).orderBy("cluster_rank").collect()
    assert [row["pool_count"] for row in table] == [2, 0]
    coverage = clusters.cluster_tag_coverage(tags, lists).filter("cluster_id = 'a'").first()
    assert coverage["heuristic_miner_percentage"] == Decimal("33.33")
    assert coverage["founder_percentage"] == Decimal("100.00")


def test_cluster_top_addresses(spark):
    members = spark.createDataFrame(
        [(f"a{i}", "c") for i in range(8)], "address string, cluster_id string"
    )
    stats = spark.createDataFrame(
        [(f"a{i}", money(i), money(0)) for i in range(8)],
        "address string, pool_sent decimal(38,8), pool_recv decimal(38,8)",
    )
    top = clusters.cluster_top_addresses(members, stats).orderBy("place").collect()
    assert [row["address"] for row in top] == ["a7", "a6", "a5", "a4", "a3"]
    assert {(row["side"], row["side_total"], row["side_addresses"]) for row in top} == {
        ("deposited", money(28), 7)
    }
