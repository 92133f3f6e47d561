import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glasspool.operators import components, enrichment, heights, inputs, normalize, positions, quality
from tests.conftest import money, rows


# Components ----------------------------------------------------------------------------------


def brute_force_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def run_components(spark, workspace, edges):
    frame = spark.createDataFrame(edges, "src string, dst string")
    return rows(components.connected_components(frame, workspace))


def names(numbers):
    return [f"n{i:05d}" for i in numbers]


def test_components_of_a_shuffled_path(spark, workspace):
    order = names(range(1000))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:]))
    found = run_components(spark, workspace, edges)
    assert found == [(name, "n00000") for name in sorted(order)]


def test_components_of_a_star_around_its_greatest_node(spark, workspace):
    leaves = names(range(3000))
    found = run_components(spark, workspace, [("z", leaf) for leaf in leaves])
    assert {cluster for _, cluster in found} == {"n00000"}
    assert len(found) == 3001


def test_components_of_random_graphs(spark, workspace):
    chance = random.Random(7)
    for size, count in ((40, 25), (400, 300)):
        nodes = names(range(size))
        edges = [tuple(chance.sample(nodes, 2)) for _ in range(count)]
        assert run_components(spark, workspace, edges) == brute_force_components(edges)


def test_leaves_are_set_aside_after_a_round(spark, workspace, monkeypatch):
    """A chain of hubs with ten leaves each: rounds after the first leave the leaves out."""
    pairs = [(f"{h:02}", f"{h:02}-{leaf}") for h in range(8) for leaf in range(10)]
    pairs += [(f"{h:02}", f"{h + 1:02}") for h in range(7)] + [("x", "x-1")]
    sizes, lower = [], components._lower

    def counted(edges):
        sizes.append(edges.count())
        return lower(edges)

    monkeypatch.setattr(components, "_lower", counted)
    found = components.connected_components(spark.createDataFrame(pairs, "src string, dst string"), workspace)
    expected = {name: "x" if name.startswith("x") else "00" for pair in pairs for name in pair}
    assert rows(found) == sorted(expected.items())
    assert sizes[0] == 88 and all(size <= 20 for size in sizes[1:])


def test_components_of_nothing(spark, workspace):
    assert run_components(spark, workspace, []) == []


def test_links_only_join_transactions_with_two_addresses(build):
    vin = build.vin(
        ("t1", "p", 0, ["b"], 1),
        ("t1", "p", 1, ["a", "c"], 1),
        ("t2", "p", 2, ["d"], 1),
        ("t2", "p", 3, ["d"], 1),
        ("t3", "p", 4, [], 1),
    )
    assert rows(components.cospend_links(vin)) == [("t1", "a", "b"), ("t1", "a", "c")]
    assert rows(components.multi_input_pairs(vin)) == [("t1", "a"), ("t1", "b"), ("t1", "c")]


# Numbering -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    return spark.range(5000).select(
        F.when(F.col("id") % 5 < 3, F.lit(0)).otherwise(F.col("id") % 41).alias("k"),
        (F.hash("id") % 7).alias("s"),
        F.col("id").alias("v"),
    ).persist()


def test_numbering_equals_a_plain_window(skewed, workspace):
    plain = skewed.withColumn(
        "n", F.row_number().over(Window.partitionBy("k").orderBy("s", "v")) - 1
    )
    found = positions.numbered(skewed.repartition(6), ["k"], ["s", "v"], "n", workspace)
    assert rows(found.select("k", "s", "v", "n")) == rows(plain.select("k", "s", "v", "n"))


def test_lag_equals_a_plain_window(skewed, workspace):
    plain = skewed.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("s", "v")))
    found = positions.previous(skewed.repartition(6), ["k"], ["s", "v"], "v", "p", workspace)
    assert rows(found.select("k", "s", "v", "p")) == rows(plain.select("k", "s", "v", "p"))


def test_a_hot_key_is_spread_over_ranges(spark, skewed, workspace):
    """The key with three fifths of the rows reaches into several ranges, none much larger than others."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = positions._placed(skewed, ["k", "s", "v"], workspace)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [row["count"] for row in placed.groupBy("_part").count().collect()]
    assert placed.filter("k = 0").select("_part").distinct().count() > 1
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_ranks_equal_a_global_window(skewed, workspace):
    order = [F.desc("k"), F.asc("v")]
    plain = skewed.withColumn("r", F.row_number().over(Window.orderBy(*order)) - 1)
    ranked = positions.ranked(skewed.repartition(6), order, "r", workspace)
    assert rows(ranked.select("k", "v", "r")) == rows(plain.select("k", "v", "r"))


# Heights -------------------------------------------------------------------------------------


def test_axis_and_running_totals_cross_slices(spark, build, monkeypatch):
    monkeypatch.setattr(heights, "SLICE", 4)
    ledger = build.ledger(block=build.blocks(b0=2, b1=13, b2=3))
    axis = heights.height_axis(ledger.block)
    assert [row[0] for row in axis.orderBy("height").collect()] == list(range(14))
    assert heights.height_axis(build.blocks(b=9), limit=3).count() == 4
    values = spark.createDataFrame(
        [("b0", 5), ("b2", 1), ("b1", 3), ("b1", 1), ("unknown", 9)], "blockhash string, v bigint"
    )
    series = heights.series_over_height(ledger, values, {"v": F.sum("v")})
    got = [row["v"] for row in series.orderBy("height").collect()]
    assert got == [0, 0, 5, 1] + [0] * 9 + [4]
    totals = heights.running_totals(series, ["v"])
    got = [row["v"] for row in totals.orderBy("height").collect()]
    assert got == [0, 0, 5] + [6] * 10 + [10]
    short = heights.series_over_height(ledger, values, {"v": F.sum("v")}, limit=2)
    assert rows(short.select("height", "v")) == [(0, 0), (1, 0), (2, 5)]


def test_series_of_an_empty_ledger(spark, build):
    values = spark.createDataFrame([], "blockhash string, v bigint")
    series = heights.series_over_height(build.ledger(), values, {"v": F.sum("v")})
    assert heights.running_totals(series, ["v"]).count() == 0


def test_running_totals_keep_eight_places(spark, build, monkeypatch):
    monkeypatch.setattr(heights, "SLICE", 2)
    values = spark.createDataFrame(
        [(h, money("0.00000001")) for h in range(6)], "height bigint, v decimal(38,8)"
    )
    totals = heights.running_totals(heights.sliced(values), ["v"]).orderBy("height").collect()
    assert [row["v"] for row in totals] == [money(f"0.0000000{i}") for i in range(1, 7)]


# Normalisation and enrichment ----------------------------------------------------------------


def test_height_limit_cascades_and_genesis_goes(build):
    ledger = build.ledger(
        block=build.blocks(b0=0, b1=1, b2=2),
        transaction=build.transactions(
            ("g", "b0", "UNKNOWN"), ("t1", "b1", "public"), ("t2", "b2", "public")
        ),
        vout=build.vout(("g", 0, ["a"], 1), ("t1", 0, ["a"], 2), ("t2", 0, ["a"], 3)),
        coingen=build.coingen("g", "t1"),
        vjoinsplit=build.joinsplits(("t2", 1, 0, None, None)),
        vin=build.vin(("t1", "g", 0, ["a"], 1)),
    )
    limited = normalize.limit_height(ledger.tables(), 1, "g")
    assert rows(limited["block"].select("b_height")) == [(0,), (1,)]
    assert rows(limited["transaction"].select("t_tx_hash")) == [("t1",)]
    assert rows(limited["vout"].select("vo_tx_hash")) == [("t1",)]
    assert rows(limited["coingen"].select("c_tx_hash")) == [("t1",)]
    assert limited["vjoinsplit"].count() == 0


def test_inputs_without_an_output_are_dropped(build):
    vin = build.vin(("t2", "t1", 0, None, None), ("t2", "t9", 0, None, None))
    vout = build.vout(("t1", 0, ["a", "b"], "1.5"), ("t1", 1, [], 2))
    resolved = inputs.resolve_inputs(vin, vout)
    assert rows(resolved) == [("t2", "t1", 0, ["a", "b"], money("1.50000000"))]
    spent = inputs.total_sent(resolved, build.transactions(("t2", "b", "public")).select("t_tx_hash"))
    assert spent.first()[0] == money("1.50000000")


def test_joinsplits_keep_null_apart_from_empty_and_their_number(build):
    bare = build.joinsplits(
        ("t1", 1, 0, None, None),
        ("t1", 1, 0, None, None),
        ("t2", 2, 0, ["stale"], ["stale"]),
        ("t3", 0, 3, None, None),
    )
    vin = build.vin(("t1", "p", 0, ["b", "a"], 1), ("t1", "p", 1, ["a"], 1))
    vout = build.vout(("t1", 0, ["c"], 1), ("t3", 0, [], 1))
    enriched = enrichment.with_joinsplit_addresses(bare, vin, vout)
    got = rows(enriched.select("vj_tx_hash", "vj_source_address", "vj_dest_address"))
    assert got == [
        ("t1", ["a", "b"], ["c"]),
        ("t1", ["a", "b"], ["c"]),
        ("t2", None, None),
        ("t3", None, []),
    ]


def test_address_sets_of_transactions(build):
    sets = enrichment.transaction_address_sets(
        build.transactions(("t1", "b", "public"), ("t2", "b", "private")),
        build.vin(("t1", "p", 0, ["x"], 1)),
        build.vout(("t1", 0, ["z"], 1), ("t1", 1, ["y", "z"], 1)),
    )
    assert rows(sets) == [("t1", "b", ["y", "z"], ["x"]), ("t2", "b", None, None)]


# Quality -------------------------------------------------------------------------------------


def test_quality_reports(build):
    ledger = build.ledger(
        block=build.blocks(b=1),
        transaction=build.transactions(("t1", "b", "public"), ("t1", "b", "public")),
        vout=build.vout(("t1", 0, ["a"], 1), ("t1", 0, ["a"], 1), ("t9", 0, ["a"], 1)),
        coingen=build.coingen("t8", "t8"),
    )
    assert rows(quality.key_violations(ledger)) == [
        ("coingen", "t8", 2),
        ("transaction", "t1", 2),
        ("vout", "t1/0", 2),
    ]
    assert rows(quality.orphan_rows(ledger)) == [("coingen", "t8", 2), ("vout", "t9", 1)]


def test_ambiguous_members(spark):
    clusters = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("b", "1")], "address string, cluster_id string"
    )
    assert [row["address"] for row in quality.ambiguous_members(clusters).collect()] == ["a"]


def test_running_sums_of_a_hot_key_are_spread(spark, workspace):
    """A key that holds nearly all rows runs through several ranges, and each range carries on."""
    from glasspool.operators.positions import running_sum

    hot = spark.range(3000).selectExpr("'hot' AS key", "id AS place", "CAST(id % 7 - 3 AS DECIMAL(32,8)) AS value")
    cold = spark.range(40).selectExpr("concat('k', id % 9) AS key", "id AS place", "CAST(1 AS DECIMAL(32,8)) AS value")
    whole = workspace.store(hot.unionByName(cold).repartition(8))
    found = running_sum(whole, ["key"], ["place"], "value", "upto", workspace)
    by_key = {}
    for key, place, value, upto in sorted(found.select("key", "place", "value", "upto").collect()):
        by_key[key] = by_key.get(key, 0) + value
        assert upto == by_key[key], (key, place)
    assert found.count() == 3040 and len(by_key) == 10
    assert running_sum(whole.limit(0), ["key"], ["place"], "value", "upto", workspace).count() == 0


def test_balances_and_active_ranges(spark, build, workspace):
    from glasspool.plans import addresses

    ledger = build.ledger(
        block=build.blocks(b1=1, b5=5, b40=40, b41=41),
        transaction=build.transactions(("t1", "b1", "public"), ("t2", "b5", "public"), ("t3", "b40", "public"), ("t4", "b41", "public")),
        vout=build.vout(("t1", 0, ["a"], 10), ("t1", 1, [], 1), ("t2", 0, ["a"], 2), ("t2", 1, ["b"], 3), ("t4", 0, ["a"], 7)),
        vin=build.vin(("t2", "t1", 0, ["a"], 10), ("t4", "t2", 0, ["a"], 2), ("t4", "t2", 1, ["b"], 3)),
    )
    assert rows(addresses.address_balances(ledger, workspace)) == sorted(
        [("", 1, money("1.00000000")), ("a", 1, money("10.00000000")), ("a", 5, money("2.00000000")), ("a", 41, money("7.00000000")),
         ("b", 5, money("3.00000000")), ("b", 41, money("0E-8"))], key=repr,
    )
    ranges = {gap: rows(addresses.active_ranges(ledger, workspace, gap)) for gap in (3, 4, 36)}
    assert ranges[3] == [("", 1, 1, 1), ("a", 1, 1, 1), ("a", 41, 41, 1), ("a", 5, 5, 1), ("b", 41, 41, 1), ("b", 5, 5, 1)]
    assert ranges[4] == [("", 1, 1, 1), ("a", 1, 5, 2), ("a", 41, 41, 1), ("b", 41, 41, 1), ("b", 5, 5, 1)]
    assert ranges[36] == [("", 1, 1, 1), ("a", 1, 41, 3), ("b", 5, 41, 2)]


def test_extended_clusters_equal_clusters_from_scratch(spark, workspace):
    import random

    from glasspool.operators.components import connected_components, extended_components

    draw = random.Random(11)
    names = [f"n{i:02}" for i in range(40)]
    pairs = [tuple(sorted(draw.sample(names, 2))) for _ in range(34)]
    frame = lambda some: spark.createDataFrame(some, "src string, dst string")
    members = workspace.store(connected_components(frame(pairs[:14]), workspace))
    for start, end in ((14, 22), (22, 34)):
        members = workspace.store(extended_components(members, frame(pairs[start:end]), workspace))
        assert rows(members) == rows(connected_components(frame(pairs[:end]), workspace))
    # old edges again change nothing, and neither does nothing
    assert rows(extended_components(members, frame(pairs[:5]), workspace)) == rows(members)
    assert rows(extended_components(members, frame([]), workspace)) == rows(members)


def kruskal(links):
    """The forest of least links by one union-find over all of them in order."""
    least = {}
    for tx, src, dst in links:
        if src != dst:
            least[src, dst] = min(tx, least.get((src, dst), tx))
    root = {end: end for edge in least for end in edge}

    def find(end):
        while root[end] != end:
            end = root[end]
        return end

    taken = []
    for tx, src, dst in sorted((tx, src, dst) for (src, dst), tx in least.items()):
        a, b = find(src), find(dst)
        if a != b:
            root[a] = b
            taken.append((tx, src, dst))
    return sorted(taken)


@pytest.mark.parametrize("shape", ["random", "star", "chain"])
def test_spanning_forest_equals_kruskal(spark, workspace, shape):
    from glasspool.operators.components import spanning_forest

    chance = random.Random(shape)
    name = lambda k: f"a{k:03d}"
    pairs = {
        # ties of transactions, repeated links, links of a node with itself, both directions
        "random": [(name(chance.randrange(60)), name(chance.randrange(60))) for _ in range(90)],
        "star": [(name(0), name(k)) for k in range(1, 80)] + [(name(k), name(k + 1)) for k in range(1, 79)],
        "chain": [(name(k), name(k + 1)) for k in range(70)],
    }[shape]
    links = [(f"t{chance.randrange(25):02d}", *pair) for pair in pairs for _ in range(1 + (shape == "random"))]
    frame = spark.createDataFrame(links, "tx_hash string, src string, dst string")
    assert rows(spanning_forest(frame, workspace)) == kruskal(links)


def test_spanning_forest_of_nothing(spark, workspace):
    from glasspool.operators.components import spanning_forest

    schema = "tx_hash string, src string, dst string"
    assert spanning_forest(spark.createDataFrame([], schema), workspace).count() == 0
    assert spanning_forest(spark.createDataFrame([("t", "a", "a")], schema), workspace).count() == 0
