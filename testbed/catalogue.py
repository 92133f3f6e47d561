"""Every registered query: a function of (spark, folder of the test tables)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspool import schema
from glasspool.functions.arrays import address_key, parse_array_text
from glasspool.functions.classify import PUBLIC, from_joinsplit
from glasspool.functions.money import to_money
from glasspool.ledger import Ledger
from glasspool.operators import components, enrichment, heights, inputs, normalize, quality
from glasspool.plans import addresses, clusters, heuristics, overview, reports, series
from glasspool.sources import address_lists, delimited, node_json, snapshot
from glasspool.streaming import ingest, resolve
from testbed import derive, staging
from testbed.derive import MINER_DESTINATIONS, Testbed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HEIGHT_LIMIT = 1200
GENESIS_TX = "t1"
PROFILED_ADDRESS = "a88_7"
FAULTY_EVERY = 97
DUPLICATED_EVERY = 50

_testbeds: dict[tuple[str, str], Testbed] = {}


def open_testbed(spark: SparkSession, folder: str) -> Testbed:
    key = (spark.conf.get("spark.app.id"), folder)
    if key not in _testbeds:
        _testbeds[key] = Testbed(spark, folder)
    return _testbeds[key]


def query(build: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
    """Register a function of the testbed under its own name."""
    QUERIES[build.__name__] = lambda spark, folder: build(open_testbed(spark, folder))
    return build


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Results handed from one job to the next -----------------------------------------------------


def stored_stats(t: Testbed) -> DataFrame:
    return t.stored("address_stats", lambda: addresses.address_stats(t.ledger()))


def stored_links(t: Testbed) -> DataFrame:
    return t.stored("links", lambda: components.cospend_links(t.vin()))


def stored_clusters(t: Testbed) -> DataFrame:
    return t.stored(
        "clusters",
        lambda: components.connected_components(
            components.cospend_edges(stored_links(t)), t.workspace
        ),
    )


def stored_ranks(t: Testbed) -> DataFrame:
    return t.stored("ranks", lambda: clusters.cluster_ranks(stored_clusters(t), t.workspace))


def stored_cluster_stats(t: Testbed) -> DataFrame:
    return t.stored(
        "cluster_stats",
        lambda: clusters.cluster_stats(
            stored_clusters(t),
            stored_ranks(t),
            components.multi_input_pairs(t.vin()),
            stored_stats(t),
        ),
    )


# Overview ------------------------------------------------------------------------------------


@query
def initial_analysis(t: Testbed) -> DataFrame:
    return overview.initial_analysis(t.ledger())


@query
def tx_types(t: Testbed) -> DataFrame:
    return t.transaction().select("t_tx_hash", "t_type")


@query
def public_share(t: Testbed) -> DataFrame:
    return overview.public_share(t.transaction())


@query
def joinsplit_array_sizes(t: Testbed) -> DataFrame:
    return overview.joinsplit_array_sizes(staging.dump_frame(staging.joinsplit_arrays(t)))


# Normalisation -------------------------------------------------------------------------------


@query
def parse_arrays(t: Testbed) -> DataFrame:
    form = F.col("vo_tx_n") % 3
    tight, spaced = F.array_join("vo_pubkey", ","), F.array_join("vo_pubkey", ", ")
    text = (
        F.when(form == 0, F.concat(F.lit("{"), tight, F.lit("}")))
        .when(form == 1, F.concat(F.lit("["), spaced, F.lit("]")))
        .otherwise(F.concat(F.lit("Set("), spaced, F.lit(")")))
    )
    parsed = t.vout().select("vo_tx_hash", "vo_tx_n", parse_array_text(text).alias("parsed"))
    return parsed.select(
        "vo_tx_hash",
        "vo_tx_n",
        F.size("parsed").cast("bigint").alias("address_count"),
        address_key(F.col("parsed")).alias("addresses"),
    )


@query
def normalize_cast(t: Testbed) -> DataFrame:
    text = t.vout().select(
        F.col("vo_tx_hash").alias("tx_hash"),
        F.col("vo_value").cast("string").alias("value"),
        F.col("vo_tx_n").cast("string").alias("tx_n"),
        F.col("vo_pubkey").alias("pubkey"),
    )
    return normalize.clean_columns("vout", text).select(
        "vo_tx_hash", "vo_value", "vo_tx_n", address_key(F.col("vo_pubkey")).alias("addresses")
    )


@query
def round_pool_values(t: Testbed) -> DataFrame:
    def noisy(value: str) -> F.Column:
        drift = (F.length("vj_tx_hash") % 9 - 4) * F.lit(1e-9)
        return to_money(F.col(value).cast("double") + drift).alias(value)

    return derive.vjoinsplit(t.retail).select(
        "vj_tx_hash", noisy("vj_vpub_old"), noisy("vj_vpub_new")
    )


def table_totals(ledger: Ledger) -> DataFrame:
    """(table_name, row_count, value_total, address_count) of a ledger's tables."""
    none = F.lit(0)
    measures = {
        "transaction": (F.col("t_tx_vout_count"), none),
        "block": (F.col("b_height"), none),
        "coingen": (none, none),
        "vin": (F.col("vi_value"), F.size("vi_address")),
        "vout": (F.col("vo_value"), F.size("vo_pubkey")),
        "vjoinsplit": (
            F.col("vj_vpub_old") + F.col("vj_vpub_new"),
            F.coalesce(F.size("vj_source_address"), none)
            + F.coalesce(F.size("vj_dest_address"), none),
        ),
    }
    return _union(
        [
            ledger.tables()[name].agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.coalesce(F.sum(value.cast("decimal(33,8)")), F.lit(0))
                .cast("decimal(38,8)")
                .alias("value_total"),
                F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("address_count"),
            )
            for name, (value, size) in measures.items()
        ]
    )


def unresolved_tables(t: Testbed) -> dict[str, DataFrame]:
    """The clean tables as a source gives them, before inputs are resolved."""
    return {
        **t.ledger().tables(),
        "vin": t.unresolved_vin().select(schema.VIN.names),
        "vjoinsplit": derive.vjoinsplit(t.retail),
    }


def imported_staging(
    t: Testbed, height_limit: int | None = None, genesis_tx: str | None = None
) -> Ledger:
    """The staging tables normalised into a store, as `relational.import_relational` does."""
    spark, path = t.retail.spark, t.workspace.fresh_path("normalized")
    clean = normalize.clean_tables(staging.staging_frames(t), height_limit)
    snapshot.save_clean(spark, clean, path, genesis_tx)
    return snapshot.load_ledger(spark, path)


@query
def height_limit_cascade(t: Testbed) -> DataFrame:
    return table_totals(imported_staging(t, HEIGHT_LIMIT, GENESIS_TX))


@query
def jdbc_normalize(t: Testbed) -> DataFrame:
    return ledger_rows(imported_staging(t))


@query
def resolve_inputs(t: Testbed) -> DataFrame:
    return inputs.resolve_inputs(t.vin(), t.vout()).withColumn(
        "vi_address", address_key(F.col("vi_address"))
    )


def _with_keys(joinsplits: DataFrame) -> DataFrame:
    return joinsplits.select(
        "vj_tx_hash",
        "vj_vpub_old",
        "vj_vpub_new",
        address_key(F.col("vj_source_address")).alias("vj_source_address"),
        address_key(F.col("vj_dest_address")).alias("vj_dest_address"),
    )


@query
def joinsplit_addresses(t: Testbed) -> DataFrame:
    return _with_keys(
        enrichment.with_joinsplit_addresses(derive.vjoinsplit(t.retail), t.vin(), t.vout())
    )


@query
def enrichment_row_counts(t: Testbed) -> DataFrame:
    """Joinsplits before and after their enrichment, as observed in the writes of one load."""
    spark, path = t.retail.spark, t.workspace.fresh_path("counted")
    seen = snapshot.save_clean(spark, unresolved_tables(t), path)
    return spark.createDataFrame(sorted(seen.items()), "stage string, row_count long")


@query
def tx_address_sets(t: Testbed) -> DataFrame:
    sets = enrichment.transaction_address_sets(t.transaction(), t.vin(), t.vout())
    return sets.select(
        "tx_hash",
        "blockhash",
        address_key(F.col("dest_addresses")).alias("dest_addresses"),
        address_key(F.col("src_addresses")).alias("src_addresses"),
    )


@query
def joinsplit_raw_dest(t: Testbed) -> DataFrame:
    return _with_keys(node_json.flatten_legs(staging.node_transactions(t))["vjoinsplit"])


@query
def vout_flags(t: Testbed) -> DataFrame:
    flags = t.transaction().select(
        F.col("t_tx_hash").alias("vo_tx_hash"),
        from_joinsplit(F.col("t_tx_vin_count"), F.col("t_tx_vj_count")).alias("is_vjoinsplit"),
    )
    return t.vout().join(flags, "vo_tx_hash").select("vo_tx_hash", "vo_tx_n", "is_vjoinsplit")


# Addresses -----------------------------------------------------------------------------------


@query
def address_received(t: Testbed) -> DataFrame:
    return addresses.value_received(t.vout())


@query
def address_sent(t: Testbed) -> DataFrame:
    return addresses.value_sent(t.vin())


@query
def address_tx_counts(t: Testbed) -> DataFrame:
    return addresses.transaction_counts(t.ledger())


@query
def address_io_counts(t: Testbed) -> DataFrame:
    return addresses.row_counts(t.ledger())


@query
def address_coingens(t: Testbed) -> DataFrame:
    return addresses.coinbase_counts(t.ledger())


@query
def address_pool_flows(t: Testbed) -> DataFrame:
    return addresses.pool_flows(t.ledger())


@query
def address_stats(t: Testbed) -> DataFrame:
    return addresses.address_stats(t.ledger())


@query
def address_stats_parity(t: Testbed) -> DataFrame:
    return addresses.address_stats(t.ledger(), parity=True).select("address", "no_txs_total")


@query
def stitched_address_label(t: Testbed) -> DataFrame:
    return (
        addresses.stitched_rows(t.ledger())
        .withColumn("vo_pubkey", address_key(F.col("vo_pubkey")))
        .withColumn("vi_address", address_key(F.col("vi_address")))
    )


@query
def rich_list_recv(t: Testbed) -> DataFrame:
    return addresses.rich_list(stored_stats(t), "recv")


@query
def rich_list_sent(t: Testbed) -> DataFrame:
    return addresses.rich_list(stored_stats(t), "sent")


@query
def rich_list_value(t: Testbed) -> DataFrame:
    return addresses.rich_list(stored_stats(t), "current_value")


@query
def address_profile(t: Testbed) -> DataFrame:
    return addresses.address_profile(t.ledger(), rich_list_recv(t))


@query
def address_profile_pools(t: Testbed) -> DataFrame:
    return addresses.address_profile(t.ledger(), derive.pool_list(t.retail))


@query
def address_profile_single(t: Testbed) -> DataFrame:
    return addresses.address_profile(t.ledger(), PROFILED_ADDRESS)


@query
def address_co_sources(t: Testbed) -> DataFrame:
    return addresses.profile_co_sources(t.ledger(), PROFILED_ADDRESS)


@query
def co_source_addresses(t: Testbed) -> DataFrame:
    public = t.transaction().filter(F.col("t_type") == PUBLIC).select("t_tx_hash")
    return inputs.co_source_addresses(t.vin(), public)


@query
def public_total_sent(t: Testbed) -> DataFrame:
    public = t.transaction().filter(F.col("t_type") == PUBLIC).select("t_tx_hash")
    return inputs.total_sent(t.vin(), public)


@query
def address_balances(t: Testbed) -> DataFrame:
    return addresses.address_balances(t.ledger(), t.workspace)


@query
def address_active_ranges(t: Testbed) -> DataFrame:
    return addresses.active_ranges(t.ledger(), t.workspace)


# Series over height --------------------------------------------------------------------------


@query
def height_axis(t: Testbed) -> DataFrame:
    return heights.height_axis(t.block())


@query
def transaction_heights(t: Testbed) -> DataFrame:
    return heights.transaction_heights(t.ledger())


@query
def types_per_height(t: Testbed) -> DataFrame:
    return series.types_per_height(t.ledger())


@query
def types_cumulative(t: Testbed) -> DataFrame:
    return series.types_cumulative(t.ledger())


@query
def pool_value_over_height(t: Testbed) -> DataFrame:
    return series.pool_value_over_height(t.ledger())


@query
def deposits_withdrawals(t: Testbed) -> DataFrame:
    return series.deposits_withdrawals(t.ledger())


@query
def deposits_by_identity(t: Testbed) -> DataFrame:
    lists = t.address_lists()
    return series.deposits_by_identity(t.ledger(), lists.miners, lists.founders)


@query
def withdrawals_by_identity_a(t: Testbed) -> DataFrame:
    lists = t.address_lists()
    return series.withdrawals_by_identity(t.ledger(), lists.miners, lists.founders)


@query
def withdrawals_by_identity_b(t: Testbed) -> DataFrame:
    lists = t.address_lists()
    return series.withdrawals_by_identity(t.ledger(), lists.miners, lists.heuristic_founders)


@query
def withdrawals_by_identity_c(t: Testbed) -> DataFrame:
    lists = t.address_lists()
    return series.withdrawals_by_identity(
        t.ledger(), lists.heuristic_miners, lists.heuristic_founders
    )


@query
def founder_correlation(t: Testbed) -> DataFrame:
    return series.founder_correlation(t.ledger())


# Heuristics ----------------------------------------------------------------------------------


@query
def trivial_miners(t: Testbed) -> DataFrame:
    return heuristics.trivial_miners(t.ledger(), t.founders())


@query
def heuristic3_founders(t: Testbed) -> DataFrame:
    return heuristics.heuristic3_founders(t.vjoinsplit(), t.vout())


@query
def heuristic4_miners(t: Testbed) -> DataFrame:
    return heuristics.heuristic4_miners(
        t.vjoinsplit(), t.vout(), derive.pool_list(t.retail), MINER_DESTINATIONS
    )


@query
def heuristic5_links(t: Testbed) -> DataFrame:
    return heuristics.heuristic5_links(t.ledger())


@query
def founder_set_union(t: Testbed) -> DataFrame:
    return heuristics.founder_union(heuristics.heuristic3_founders(t.vjoinsplit(), t.vout()), t.founders())


# Clusters ------------------------------------------------------------------------------------


@query
def cospend_edges(t: Testbed) -> DataFrame:
    return components.cospend_edges(components.cospend_links(t.vin()))


@query
def address_transactions(t: Testbed) -> DataFrame:
    return components.multi_input_pairs(t.vin())


@query
def cluster_members(t: Testbed) -> DataFrame:
    edges = components.cospend_edges(components.cospend_links(t.vin()))
    return components.connected_components(edges, t.workspace)


@query
def clusters_after_append(t: Testbed) -> DataFrame:
    """Clusters of the transactions up to HEIGHT_LIMIT, extended by the edges of the later ones."""
    placed = heights.transaction_heights(t.ledger()).select(F.col("tx_hash").alias("vi_tx_hash"), "height")
    inputs_at = t.vin().join(placed, "vi_tx_hash")

    def edges(condition: F.Column) -> DataFrame:
        return components.cospend_edges(components.cospend_links(inputs_at.filter(condition)))

    early = components.connected_components(edges(F.col("height") <= HEIGHT_LIMIT), t.workspace)
    return components.extended_components(
        t.workspace.store(early), edges(F.col("height") > HEIGHT_LIMIT), t.workspace
    )


@query
def cluster_evidence(t: Testbed) -> DataFrame:
    """(cluster_id, tx_hash, src, dst): why the members of a cluster belong together."""
    forest = components.spanning_forest(stored_links(t), t.workspace)
    ends = stored_clusters(t).select(F.col("address").alias("src"), "cluster_id")
    return forest.join(ends, "src").select("cluster_id", "tx_hash", "src", "dst")


@query
def cluster_ranks(t: Testbed) -> DataFrame:
    return clusters.cluster_ranks(stored_clusters(t), t.workspace)


@query
def cluster_disjointness(t: Testbed) -> DataFrame:
    ambiguous = quality.ambiguous_members(stored_clusters(t))
    return ambiguous.agg(F.count(F.lit(1)).alias("ambiguous_addresses"))


@query
def cluster_summary(t: Testbed) -> DataFrame:
    return clusters.cluster_summary(stored_ranks(t), t.transaction())


@query
def cluster_stats(t: Testbed) -> DataFrame:
    return clusters.cluster_stats(
        stored_clusters(t),
        stored_ranks(t),
        components.multi_input_pairs(t.vin()),
        stored_stats(t),
    )


@query
def cluster_members_without_stats(t: Testbed) -> DataFrame:
    return clusters.members_without_stats(stored_clusters(t), stored_stats(t))


@query
def cluster_transactions(t: Testbed) -> DataFrame:
    return clusters.cluster_transactions(
        stored_clusters(t), components.multi_input_pairs(t.vin()), stored_stats(t)
    )


@query
def cluster_tags(t: Testbed) -> DataFrame:
    return clusters.cluster_tags(stored_clusters(t), t.address_lists())


@query
def cluster_tag_names(t: Testbed) -> DataFrame:
    return clusters.cluster_tag_names(stored_clusters(t), t.address_lists())


@query
def cluster_tag_coverage(t: Testbed) -> DataFrame:
    lists = t.address_lists()
    return clusters.cluster_tag_coverage(clusters.cluster_tags(stored_clusters(t), lists), lists)


@query
def cluster_concentration(t: Testbed) -> DataFrame:
    known = stored_stats(t).filter(F.col("address") != "").agg(F.count(F.lit(1)))
    transactions = t.transaction().agg(F.count(F.lit(1)))
    return clusters.cluster_concentration(
        stored_cluster_stats(t), known.scalar(), transactions.scalar()
    )


@query
def largest_cluster_edges(t: Testbed) -> DataFrame:
    return clusters.largest_cluster_links(stored_links(t), stored_clusters(t), stored_ranks(t))


@query
def cluster_lookup(t: Testbed) -> DataFrame:
    return clusters.cluster_lookup(
        derive.tag_list(t.retail), stored_clusters(t), stored_ranks(t)
    )


@query
def cluster_pool_members(t: Testbed) -> DataFrame:
    return stored_clusters(t).join(derive.pool_list(t.retail), "address", "left_semi")


@query
def cluster_top_addresses(t: Testbed) -> DataFrame:
    return clusters.cluster_top_addresses(stored_clusters(t), stored_stats(t))


# Data quality --------------------------------------------------------------------------------


def _order_of(column: str) -> F.Column:
    return F.substring(F.col(column), 2, 20).cast("bigint")


@query
def key_violations(t: Testbed) -> DataFrame:
    """On a ledger where some rows of every keyed table are doubled."""
    ledger = t.ledger()

    def doubled(name: str, condition: F.Column) -> DataFrame:
        table = ledger.tables()[name]
        return table.unionByName(table.filter(condition))

    faulty = ledger.with_tables(
        transaction=doubled("transaction", _order_of("t_tx_hash") % DUPLICATED_EVERY == 0),
        block=doubled("block", F.col("b_height") % DUPLICATED_EVERY == 0),
        coingen=doubled("coingen", _order_of("c_tx_hash") % DUPLICATED_EVERY == 0),
        vin=doubled("vin", _order_of("vi_tx_hash") % DUPLICATED_EVERY == 1),
        vout=doubled("vout", _order_of("vo_tx_hash") % DUPLICATED_EVERY == 0),
    )
    return quality.key_violations(faulty)


@query
def orphan_rows(t: Testbed) -> DataFrame:
    """On a ledger where some transactions are missing."""
    ledger = t.ledger()
    kept = ledger.transaction.filter(_order_of("t_tx_hash") % FAULTY_EVERY != 0)
    return quality.orphan_rows(ledger.with_tables(transaction=kept))


@query
def missing_transactions(t: Testbed) -> DataFrame:
    kept = t.transaction().filter(_order_of("t_tx_hash") % FAULTY_EVERY != 0)
    return quality.missing_transactions(quality.block_listing(t.block()), kept)


# Sources and sinks ---------------------------------------------------------------------------


def ledger_rows(ledger: Ledger, tables: list[str] | None = None) -> DataFrame:
    """All rows in one long form: (table_name, row_key, detail, amount); block listings as `listing`."""

    def text(*columns: str) -> F.Column:
        return F.concat_ws("/", *(F.col(name).cast("string") for name in columns))

    def addresses_or_dash(column: str) -> F.Column:
        return F.coalesce(address_key(F.col(column)), F.lit("-"))

    zero = F.lit(0).cast("decimal(38,8)")
    forms = {
        "transaction": (
            text("t_tx_hash"),
            text(
                "t_blockhash", "t_type", "t_tx_vin_count", "t_tx_vj_count", "t_tx_vout_count",
                "t_valid", "t_blocktime",
            ),
            F.col("t_time"),
        ),
        "block": (
            text("b_height"),
            text("b_hash", "b_previousblockhash", "b_nextblockhash", "b_size", "b_version"),
            F.col("b_time"),
        ),
        "coingen": (text("c_tx_hash"), text("c_coinbase"), F.col("c_sequence")),
        "vin": (
            text("vi_tx_hash", "vi_prevout_hash", "vi_prevout_n"),
            addresses_or_dash("vi_address"),
            F.col("vi_value"),
        ),
        "vout": (
            text("vo_tx_hash", "vo_tx_n"),
            addresses_or_dash("vo_pubkey"),
            F.col("vo_value"),
        ),
        "vjoinsplit": (
            text("vj_tx_hash", "vj_vpub_new"),
            F.concat(
                addresses_or_dash("vj_source_address"),
                F.lit(" > "),
                addresses_or_dash("vj_dest_address"),
            ),
            F.col("vj_vpub_old"),
        ),
    }
    frames = {
        **ledger.tables(),
        "listing": quality.block_listing(ledger.block),
    }
    forms["listing"] = (text("tx_hash"), text("blockhash"), zero)
    return _union(
        [
            frames[name].select(
                F.lit(name).alias("table_name"),
                key.alias("row_key"),
                detail.alias("detail"),
                F.coalesce(amount.cast("decimal(38,8)"), zero).alias("amount"),
            )
            for name, (key, detail, amount) in forms.items()
            if tables is None or name in tables
        ]
    )


@query
def csv_round_trip(t: Testbed) -> DataFrame:
    folder = t.workspace.fresh_path("dumps")
    staging.write_dumps(t, folder)
    return ledger_rows(delimited.import_dumps(t.retail.spark, folder, f"{folder}/ledger"))


@query
def json_flatten(t: Testbed) -> DataFrame:
    folder = t.workspace.fresh_path("documents")
    staging.node_blocks(t).write.json(f"{folder}/blocks", compression="gzip")
    staging.node_transactions(t).write.json(f"{folder}/transactions", compression="gzip")
    return ledger_rows(
        node_json.import_documents(
            t.retail.spark,
            f"{folder}/blocks",
            f"{folder}/transactions",
            f"{folder}/ledger",
            t.workspace,
        )
    )


@query
def json_rejects(t: Testbed) -> DataFrame:
    """Documents of which every 97th is cut short or has a text amount: what is left, and how many
    were set aside."""
    folder = t.workspace.fresh_path("documents")
    staging.node_blocks(t).write.json(f"{folder}/blocks", compression="gzip")
    documents = staging.node_transactions(t)
    whole = F.to_json(F.struct(*documents.columns))
    order = _order_of("txid")
    broken = F.when(order % 2 == 0, F.substring(whole, 1, 30)).otherwise(
        F.concat(F.regexp_replace(whole, r"\}$", ""), F.lit(',"time":"late"}'))
    )
    line = F.when(order % FAULTY_EVERY == 0, broken).otherwise(whole)
    documents.select(line.alias("value")).write.text(f"{folder}/transactions", compression="gzip")
    ledger = node_json.import_documents(
        t.retail.spark, f"{folder}/blocks", f"{folder}/transactions", f"{folder}/ledger", t.workspace,
        f"{folder}/rejects",
    )
    zero = F.lit(0).cast("decimal(38,8)")
    rejects = t.retail.spark.read.parquet(f"{folder}/rejects").select(
        F.lit("reject").alias("table_name"), F.lit("").alias("row_key"), F.lit("").alias("detail"), zero.alias("amount")
    )
    return ledger_rows(ledger, ["transaction", "coingen", "vout"]).unionByName(rejects)


@query
def parquet_round_trip(t: Testbed) -> DataFrame:
    """Two versions of one snapshot: a part of the ledger, then all of it."""
    folder = t.workspace.fresh_path("snapshot")
    early = Ledger(**normalize.limit_height(t.ledger().tables(), HEIGHT_LIMIT))
    for ledger in (early, t.ledger()):
        snapshot.save_ledger(ledger, folder)
    return ledger_rows(snapshot.load_ledger(t.retail.spark, folder))


def _faulty_tables(t: Testbed) -> dict[str, DataFrame]:
    """The blocks above HEIGHT_LIMIT without some of their transactions, with some outputs twice, and with
    some earlier transactions again."""
    whole = unresolved_tables(t)
    above = F.col("b_height") > HEIGHT_LIMIT
    late = normalize.limit_height({**whole, "block": whole["block"].filter(above)}, None)
    order = _order_of("t_tx_hash")
    doubled = late["vout"].filter((_order_of("vo_tx_hash") % DUPLICATED_EVERY == 0) & (_order_of("vo_tx_hash") % FAULTY_EVERY != 0))
    first_late = late["block"].agg(F.min_by("b_hash", "b_height")).first()[0]
    early = normalize.limit_height(whole, HEIGHT_LIMIT)["block"].filter("b_height > 0")
    again = (
        whole["transaction"].filter(order % DUPLICATED_EVERY == 0)
        .join(early.select(F.col("b_hash").alias("t_blockhash")), "t_blockhash", "left_semi")
        .withColumn("t_blockhash", F.lit(first_late))
    )
    return {
        **late,
        "transaction": late["transaction"].filter(order % FAULTY_EVERY != 0).unionByName(again),
        "vout": late["vout"].unionByName(doubled),
    }


@query
def load_refused(t: Testbed) -> DataFrame:
    """What a faulty load is refused for, and the rows of the store after it."""
    spark, folder = t.retail.spark, t.workspace.fresh_path("refusing")
    snapshot.create_store(spark, folder)
    snapshot.append_above(spark, normalize.limit_height(unresolved_tables(t), HEIGHT_LIMIT), folder)
    problems = []
    try:
        snapshot.append_above(spark, _faulty_tables(t), folder)
    except snapshot.LoadRefused as refused:
        problems = refused.problems
    found = spark.createDataFrame(problems, "table_name string, problem string, row_count long")
    stored = table_totals(snapshot.load_ledger(spark, folder))
    return found.unionByName(stored.select("table_name", F.lit("stored").alias("problem"), "row_count"))


@query
def append_tables(t: Testbed) -> DataFrame:
    spark, ledger = t.retail.spark, t.ledger()
    early = Ledger(
        **normalize.limit_height(ledger.tables(), HEIGHT_LIMIT)
    )
    late = {**ledger.tables(), "block": ledger.block.filter(F.col("b_height") > HEIGHT_LIMIT)}
    return ledger_rows(
        Ledger.empty(spark).append(early).append(Ledger(**normalize.limit_height(late, None)))
    )


@query
def incremental_append(t: Testbed) -> DataFrame:
    """Two loads into an empty store; like any load into one, they start at height 1."""
    spark, folder = t.retail.spark, t.workspace.fresh_path("incremental")
    snapshot.create_store(spark, folder)
    whole = unresolved_tables(t)
    snapshot.append_above(spark, normalize.limit_height(whole, HEIGHT_LIMIT), folder)
    snapshot.append_above(spark, whole, folder)
    return ledger_rows(snapshot.load_ledger(spark, folder))


@query
def stream_append(t: Testbed) -> DataFrame:
    """Transactions and blocks as two sources of one store."""
    spark, folder = t.retail.spark, t.workspace.fresh_path("stream")
    staging.node_transactions(t).write.json(f"{folder}/documents", compression="gzip")
    staging.node_blocks(t).write.json(f"{folder}/blocks", compression="gzip")
    ingest.start_block_ingest(
        spark, f"{folder}/blocks", f"{folder}/store", f"{folder}/progress-blocks"
    ).awaitTermination()
    ingest.start_ingest(
        spark, f"{folder}/documents", f"{folder}/store", f"{folder}/progress"
    ).awaitTermination()
    return ledger_rows(Ledger(**ingest.resolved_legs(spark, f"{folder}/store")))


@query
def stream_resume(t: Testbed) -> DataFrame:
    """Two sources, each with its own checkpoint, into one store; they share every 50th document."""
    spark, folder = t.retail.spark, t.workspace.fresh_path("stream")
    documents, order = staging.node_transactions(t), _order_of("txid")
    shared = order % DUPLICATED_EVERY == 0
    documents.filter((order % 2 == 0) | shared).write.json(f"{folder}/one", compression="gzip")
    documents.filter((order % 2 == 1) | shared).write.json(f"{folder}/two", compression="gzip")
    for source in ("one", "two"):
        ingest.start_ingest(
            spark, f"{folder}/{source}", f"{folder}/store", f"{folder}/progress-{source}"
        ).awaitTermination()
    legs = ingest.resolved_legs(spark, f"{folder}/store")
    return ledger_rows(Ledger(**legs), [name for name in legs if name != "block"])


@query
def stream_resolved(t: Testbed) -> DataFrame:
    """Inputs resolved as their documents come, in two runs: first the documents of odd orders, then those of
    even ones, so that many outputs come after the inputs that spend them. Every 50th document comes twice."""
    spark, folder = t.retail.spark, t.workspace.fresh_path("resolving")
    documents, order = staging.node_transactions(t), _order_of("txid")
    shared = order % DUPLICATED_EVERY == 0
    for chosen in ((order % 2 == 1) | shared, order % 2 == 0):
        documents.filter(chosen).write.mode("append").json(f"{folder}/documents", compression="gzip")
        resolve.start_resolving(
            spark, f"{folder}/documents", f"{folder}/resolved", f"{folder}/progress"
        ).awaitTermination()
    return resolve.resolved_inputs(spark, f"{folder}/resolved").withColumn("vi_address", address_key(F.col("vi_address")))


@query
def address_list_load(t: Testbed) -> DataFrame:
    """A tagged list in which every address of an even-numbered nation occurs twice."""
    path = t.workspace.fresh_path("pools")
    pools = derive.pool_list(t.retail)
    again = pools.filter(F.substring("tag", 6, 9).cast("int") % 2 == 0).withColumn(
        "tag", F.concat(F.lit("zz"), F.col("tag"))
    )
    delimited.write_csv(pools.unionByName(again), path)
    return address_lists.read_address_list(t.retail.spark, path)


@query
def duplicated_list_entries(t: Testbed) -> DataFrame:
    path = t.workspace.fresh_path("founders")
    founders = t.founders()
    again = founders.filter(F.col("address").endswith("_3"))
    delimited.write_address_list(founders.unionByName(again), path)
    return address_lists.duplicated_addresses(t.retail.spark, path)


@query
def address_list_write(t: Testbed) -> DataFrame:
    path = t.workspace.fresh_path("miners")
    delimited.write_address_list(heuristics.trivial_miners(t.ledger(), t.founders()), path)
    return address_lists.read_address_list(t.retail.spark, path)


def _read_back(t: Testbed, df: DataFrame, write: Callable[[str], None], kind=None) -> DataFrame:
    path = t.workspace.fresh_path("csv")
    write(path)
    return delimited.read_csv(t.retail.spark, path, kind or df.schema)


@query
def address_stats_csv(t: Testbed) -> DataFrame:
    stats = stored_stats(t)
    return _read_back(t, stats, lambda path: delimited.write_csv(stats, path))


@query
def rich_list_csv(t: Testbed) -> DataFrame:
    top = rich_list_recv(t)
    kind = schema.StructType(
        [
            schema.StructField("Address", schema.StringType()),
            schema.StructField("Total Coins received", schema.MONEY_TOTAL),
        ]
    )
    return _read_back(
        t,
        top,
        lambda path: delimited.write_rich_list(top, path, "Total Coins received"),
        kind,
    ).withColumnRenamed("Total Coins received", "total_coins_received").withColumnRenamed(
        "Address", "address"
    )


@query
def cluster_stats_csv(t: Testbed) -> DataFrame:
    tags = clusters.cluster_tags(stored_clusters(t), t.address_lists())
    table = clusters.cluster_table(stored_cluster_stats(t), tags)
    return _read_back(t, table, lambda path: delimited.write_csv(table, path))


@query
def report_lines(t: Testbed) -> DataFrame:
    """The three text reports, written and read back."""
    lists = t.address_lists()
    tags = clusters.cluster_tags(stored_clusters(t), lists)
    coverage = clusters.cluster_tag_coverage(tags, lists)
    names = clusters.cluster_tag_names(stored_clusters(t), lists)
    summary = clusters.cluster_summary(stored_ranks(t), t.transaction())
    lines = {
        "initial_analysis": reports.initial_analysis_lines(overview.initial_analysis(t.ledger())),
        "heuristic5": reports.heuristic5_lines(heuristics.heuristic5_links(t.ledger())),
        "clusters": reports.cluster_lines(summary, stored_cluster_stats(t), tags, coverage, names),
    }
    written = []
    for name, report in lines.items():
        path = t.workspace.fresh_path(name)
        delimited.write_lines(report, path)
        written.append(
            t.retail.spark.read.text(path).select(
                F.lit(name).alias("report"), F.col("value").alias("line")
            )
        )
    return _union(written)
