"""The derivation and every query again, in SQL, independent of the DataFrame code."""

from __future__ import annotations

from glasspool.settings import ACTIVE_GAP
from testbed.catalogue import (
    DUPLICATED_EVERY,
    FAULTY_EVERY,
    GENESIS_TX,
    HEIGHT_LIMIT,
    PROFILED_ADDRESS,
)
from testbed.derive import MINER_DESTINATIONS

MONEY = "DECIMAL(32,8)"
TOTAL = "DECIMAL(38,8)"


def _key(array: str) -> str:
    return f"CASE WHEN {array} IS NULL THEN NULL ELSE coalesce(array_to_string(list_sort({array}), ','), '') END"


def _set(array: str) -> str:
    return f"list_sort(list_distinct(flatten(list({array}))))"


def _percent(part: str, whole: str) -> str:
    """Half-up to 2 places in whole numbers; both arguments are money or counts, whole > 0."""
    n = f"CAST(abs(CAST({part} AS {TOTAL})) * 100000000 AS HUGEINT)"
    d = f"CAST(CAST({whole} AS {TOTAL}) * 100000000 AS HUGEINT)"
    hundredths = f"CAST(sign({part}) AS HUGEINT) * ((20000 * {n} + {d}) // (2 * {d}))"
    return f"CAST(CAST({hundredths} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


_DERIVATION = f"""
ord AS (
  SELECT o_orderkey AS ok, o_custkey AS ck, o_orderkey % 10 AS k, o_totalprice AS p,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS height,
         lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
  FROM orders),
vout AS (
  SELECT 't' || ok AS vo_tx_hash,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS {MONEY}) AS vo_value,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_quantity, l_extendedprice) - 1 AS vo_tx_n,
         CASE WHEN l_quantity = 1 THEN CAST([] AS VARCHAR[])
              WHEN l_quantity = 50 THEN ['a' || ck || '_' || l_linenumber, 'm' || l_suppkey]
              WHEN l_linenumber = 7 THEN ['a' || (ck - ck % 4) || '_7']
              ELSE ['a' || ck || '_' || l_linenumber] END AS vo_pubkey
  FROM lineitem JOIN ord ON l_orderkey = ok WHERE k IN (0, 1, 2, 3, 4, 6, 7)),
vin AS (
  SELECT 't' || ok AS vi_tx_hash, vo_tx_hash AS vi_prevout_hash, vo_tx_n AS vi_prevout_n,
         vo_pubkey AS vi_address, vo_value AS vi_value
  FROM ord JOIN vout ON vo_tx_hash = 't' || prev
  WHERE k BETWEEN 1 AND 6 AND vo_tx_n % 3 <> 2),
coingen AS (
  SELECT 't' || ok AS c_tx_hash, 'cb' || ok AS c_coinbase, CAST(4294967295 AS BIGINT) AS c_sequence
  FROM ord WHERE k = 0),
vj AS (
  SELECT 't' || ok AS vj_tx_hash, ok,
         CASE WHEN k = 5 AND ck % 25 = 0 THEN CAST(249.9999 AS {MONEY})
              WHEN k = 5 OR (k = 6 AND ok % 4 = 0)
              THEN CAST(floor(p / 25) AS {MONEY}) + CAST(0.0001 AS {MONEY})
              ELSE 0 END::{MONEY} AS vj_vpub_old,
         CASE WHEN k = 7 AND ck % 25 = 0 THEN CAST(250.0001 AS {MONEY})
              WHEN k = 7 OR (k = 6 AND ok % 4 <> 0)
              THEN CAST(floor(p / 25) AS {MONEY}) + CAST(0.0001 AS {MONEY})
              ELSE 0 END::{MONEY} AS vj_vpub_new
  FROM ord WHERE k BETWEEN 5 AND 8),
src AS (SELECT vi_tx_hash AS tx, {_set('vi_address')} AS addrs FROM vin GROUP BY 1),
dst AS (SELECT vo_tx_hash AS tx, {_set('vo_pubkey')} AS addrs FROM vout GROUP BY 1),
vjoinsplit AS (
  SELECT vj_tx_hash, vj_vpub_old, vj_vpub_new, src.addrs AS vj_source_address,
         dst.addrs AS vj_dest_address
  FROM vj LEFT JOIN src ON src.tx = vj_tx_hash LEFT JOIN dst ON dst.tx = vj_tx_hash),
nin AS (SELECT vi_tx_hash AS tx, count(*) AS n FROM vin GROUP BY 1),
nout AS (SELECT vo_tx_hash AS tx, count(*) AS n FROM vout GROUP BY 1),
legs AS (
  SELECT 't' || ok AS tx, height, k, CASE WHEN k = 0 THEN 1 ELSE 0 END AS cb,
         coalesce(nin.n, 0) + CASE WHEN k = 0 THEN 1 ELSE 0 END AS i, coalesce(nout.n, 0) AS o,
         CASE WHEN k BETWEEN 5 AND 8 THEN 1 ELSE 0 END AS j
  FROM ord LEFT JOIN nin ON nin.tx = 't' || ok LEFT JOIN nout ON nout.tx = 't' || ok),
tx AS (
  SELECT tx AS t_tx_hash, 'b' || height AS t_blockhash, height,
         CAST(788918400 + height * 86400 AS INTEGER) AS t_time, i AS t_tx_vin_count,
         j AS t_tx_vj_count, o AS t_tx_vout_count,
         CASE WHEN i = 1 AND cb = 1 THEN 'minerReward'
              WHEN i > 0 AND o > 0 AND j = 0 THEN 'public'
              WHEN i > 0 AND o = 0 AND j > 0 THEN 'shielded'
              WHEN i > 0 AND o > 0 AND j > 0 THEN 'mixed'
              WHEN i = 0 AND o > 0 AND j > 0 THEN 'deshielded'
              WHEN i = 0 AND o = 0 AND j > 0 THEN 'private'
              ELSE 'UNKNOWN' END AS t_type
  FROM legs),
days AS (SELECT DISTINCT height FROM ord),
block AS (
  SELECT height, 'b' || height AS b_hash,
         CAST(788918400 + height * 86400 AS INTEGER) AS b_time,
         coalesce('b' || lag(height) OVER (ORDER BY height), '') AS b_prev,
         coalesce('b' || lead(height) OVER (ORDER BY height), '') AS b_next
  FROM days),
pools AS (
  SELECT 'a' || c_custkey || '_1' AS address, 'pool_' || c_nationkey AS tag
  FROM customer WHERE c_mktsegment = 'MACHINERY'),
founders AS (
  SELECT 'a' || c_custkey || '_' || i AS address
  FROM customer, (VALUES (1), (2), (3), (4), (5), (6)) AS six(i) WHERE c_custkey % 25 = 0),
tags AS (
  SELECT 'a' || c_custkey || '_2' AS address, 'tag_' || c_nationkey AS tag
  FROM customer WHERE c_mktsegment = 'HOUSEHOLD'),
coinbase_first AS (
  SELECT DISTINCT vo_pubkey[1] AS address FROM vout JOIN coingen ON c_tx_hash = vo_tx_hash
  WHERE len(vo_pubkey) > 0),
miners AS (SELECT address FROM coinbase_first WHERE address NOT IN (SELECT address FROM founders)),
h3 AS (
  SELECT DISTINCT unnest(vj_dest_address) AS address FROM vjoinsplit WHERE vj_vpub_new = 250.0001),
h4 AS (
  SELECT DISTINCT unnest(vj_dest_address) AS address FROM vjoinsplit
  WHERE len(vj_dest_address) > {MINER_DESTINATIONS}
    AND list_has_any(vj_dest_address, (SELECT list(address) FROM pools)))
"""

_ADDRESSES = f"""
recv AS (
  SELECT {_key('vo_pubkey')} AS address, CAST(sum(vo_value) AS {TOTAL}) AS recv,
         count(*) AS vouts_count, count(DISTINCT vo_tx_hash) AS txs_recv FROM vout GROUP BY 1),
sent AS (
  SELECT {_key('vi_address')} AS address, CAST(sum(vi_value) AS {TOTAL}) AS sent,
         count(*) AS vins_count, count(DISTINCT vi_tx_hash) AS txs_sent FROM vin GROUP BY 1),
cbs AS (
  SELECT {_key('vo_pubkey')} AS address, count(*) AS coingens_recv
  FROM vout WHERE vo_tx_hash IN (SELECT c_tx_hash FROM coingen) GROUP BY 1),
pout AS (
  SELECT {_key('vo_pubkey')} AS address, CAST(sum(vo_value) AS {TOTAL}) AS pool_recv
  FROM vout JOIN tx ON t_tx_hash = vo_tx_hash WHERE t_type = 'deshielded' GROUP BY 1),
pin AS (
  SELECT vj_source_address[1] AS address, CAST(sum(vj_vpub_old) AS {TOTAL}) AS pool_sent
  FROM vjoinsplit WHERE len(vj_source_address) = 1 GROUP BY 1),
stats AS (
  SELECT address, CAST(coalesce(recv, 0) AS {TOTAL}) AS recv,
         CAST(coalesce(sent, 0) AS {TOTAL}) AS sent,
         CAST(coalesce(recv, 0) - coalesce(sent, 0) AS {TOTAL}) AS current_value,
         coalesce(txs_sent, 0) AS txs_sent, coalesce(txs_recv, 0) AS txs_recv,
         coalesce(vins_count, 0) AS vins_count, coalesce(vouts_count, 0) AS vouts_count,
         coalesce(txs_sent, 0) + coalesce(txs_recv, 0) AS no_txs_total,
         coalesce(coingens_recv, 0) AS coingens_recv,
         CAST(coalesce(pool_sent, 0) AS {TOTAL}) AS pool_sent,
         CAST(coalesce(pool_recv, 0) AS {TOTAL}) AS pool_recv
  FROM recv FULL JOIN sent USING (address) FULL JOIN cbs USING (address)
       FULL JOIN pout USING (address) FULL JOIN pin USING (address))
"""

_CHANGES = f"""
changes AS (
  SELECT address, height, sum(v) AS change FROM (
    SELECT {_key('vo_pubkey')} AS address, vo_tx_hash AS t_tx_hash, vo_value AS v FROM vout
    UNION ALL SELECT {_key('vi_address')}, vi_tx_hash, -vi_value FROM vin)
  JOIN tx USING (t_tx_hash) GROUP BY 1, 2)
"""

_LINKS = """
pairs AS (SELECT DISTINCT vi_tx_hash AS tx_hash, unnest(vi_address) AS address FROM vin),
centre AS (
  SELECT tx_hash, min(address) AS src FROM pairs GROUP BY 1 HAVING count(*) > 1),
links AS (
  SELECT tx_hash, src, address AS dst FROM pairs JOIN centre USING (tx_hash) WHERE address <> src),
edges AS (SELECT DISTINCT src, dst FROM links)
"""

_CLUSTERS = """
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
members(address, cluster_id) USING KEY (address) AS (
  SELECT DISTINCT a, a FROM both_ways
  UNION
  SELECT e.b, min(m.cluster_id)
  FROM members m JOIN both_ways e ON e.a = m.address
       JOIN recurring.members now ON now.address = e.b
  WHERE m.cluster_id < now.cluster_id GROUP BY e.b),
ranks AS (
  SELECT cluster_id, count(*) AS cluster_size,
         row_number() OVER (ORDER BY count(*) DESC, cluster_id) - 1 AS cluster_rank
  FROM members GROUP BY 1)
"""

_SUMS = ("current_value", "pool_recv", "pool_sent", "recv", "sent")
_COUNTS = ("coingens_recv", "no_txs_total", "txs_recv", "txs_sent", "vins_count", "vouts_count")

_CLUSTER_STATS = f"""
sums AS (
  SELECT cluster_id, {', '.join(f'sum({m}) AS total_{m}' for m in _SUMS + _COUNTS)}
  FROM members JOIN stats USING (address) GROUP BY 1),
ctx AS (
  SELECT DISTINCT p.tx_hash, m.cluster_id
  FROM pairs p JOIN centre USING (tx_hash) JOIN stats USING (address)
       JOIN members m USING (address)),
ctx_count AS (SELECT cluster_id, count(*) AS n FROM ctx GROUP BY 1),
cstats AS (
  SELECT cluster_rank, cluster_id, cluster_size,
         {', '.join(f'CAST(coalesce(total_{m}, 0) AS {TOTAL}) AS total_{m}' for m in _SUMS)},
         {', '.join(f'CAST(coalesce(total_{m}, 0) AS BIGINT) AS total_{m}' for m in _COUNTS)},
         coalesce(n, 0) AS total_distinct_txs
  FROM ranks LEFT JOIN sums USING (cluster_id) LEFT JOIN ctx_count USING (cluster_id))
"""

_KINDS = ("pool", "miner", "founder", "heuristic_miner", "heuristic_founder", "tag")

_LABELS = """
labelled AS (
  SELECT address, 'pool' AS kind, max(tag) AS tag FROM pools GROUP BY 1
  UNION ALL SELECT address, 'miner', NULL FROM miners
  UNION ALL SELECT DISTINCT address, 'founder', NULL FROM founders
  UNION ALL SELECT address, 'heuristic_miner', NULL FROM h4
  UNION ALL SELECT address, 'heuristic_founder', NULL FROM h3
  UNION ALL SELECT address, 'tag', max(tag) FROM tags GROUP BY 1),
ctags AS (
  SELECT cluster_id,
         count(*) FILTER (kind = 'pool') AS pool_count,
         count(*) FILTER (kind = 'miner') AS miner_count,
         count(*) FILTER (kind = 'founder') AS founder_count,
         count(*) FILTER (kind = 'heuristic_miner') AS heuristic_miner_count,
         count(*) FILTER (kind = 'heuristic_founder') AS heuristic_founder_count,
         count(*) FILTER (kind = 'tag') AS tag_count
  FROM members JOIN labelled USING (address) GROUP BY 1)
"""

_TAG_NAMES = """SELECT cluster_id, kind, tag, count(*) AS addresses FROM members JOIN labelled USING (address)
        WHERE kind IN ('pool', 'tag') GROUP BY 1, 2, 3"""

_COVERAGE = f"""SELECT cluster_id,
        {_percent('heuristic_miner_count', '(SELECT count(*) FROM h4)')}
          AS heuristic_miner_percentage,
        {_percent('(heuristic_founder_count + founder_count)',
                  '(SELECT count(*) FROM (SELECT address FROM h3 UNION SELECT address FROM founders))')}
          AS founder_percentage FROM ctags"""

_SUMMARY = """
summary AS (
  SELECT 'clusters' AS metric, count(*) AS metric_value FROM ranks
  UNION ALL SELECT 'largest_cluster', max(cluster_size) FROM ranks
  UNION ALL SELECT 'addresses_in_top_5', CAST(sum(cluster_size) AS BIGINT) FROM ranks WHERE cluster_rank < 5
  UNION ALL SELECT 'addresses_in_top_10', CAST(sum(cluster_size) AS BIGINT) FROM ranks WHERE cluster_rank < 10
  UNION ALL SELECT 'addresses_in_top_25', CAST(sum(cluster_size) AS BIGINT) FROM ranks WHERE cluster_rank < 25
  UNION ALL SELECT 'addresses_in_top_50', CAST(sum(cluster_size) AS BIGINT) FROM ranks WHERE cluster_rank < 50
  UNION ALL SELECT 'addresses_in_top_100', CAST(sum(cluster_size) AS BIGINT) FROM ranks WHERE cluster_rank < 100
  UNION ALL SELECT 'clustered_addresses', CAST(sum(cluster_size) AS BIGINT) FROM ranks
  UNION ALL SELECT 'transactions', count(*) FROM tx)
"""

_H5 = """
placed AS (SELECT vj_tx_hash, vj_vpub_old, vj_vpub_new, height FROM vj JOIN tx ON t_tx_hash = vj_tx_hash),
deposit AS (
  SELECT vj_vpub_old AS amount, min(vj_tx_hash) AS deposit_tx, min(height) AS deposit_height
  FROM placed WHERE vj_vpub_old > 0 GROUP BY 1 HAVING count(*) = 1),
withdrawal AS (
  SELECT vj_vpub_new AS amount, min(vj_tx_hash) AS withdrawal_tx, min(height) AS withdrawal_height
  FROM placed WHERE vj_vpub_new > 0 GROUP BY 1 HAVING count(*) = 1),
h5 AS (
  SELECT amount, deposit_tx, deposit_height, withdrawal_tx, withdrawal_height
  FROM deposit JOIN withdrawal USING (amount) WHERE withdrawal_height > deposit_height)
"""

_ANALYSIS = f"""
analysis AS (
  SELECT 'blocks' AS item, count(*) AS amount, CAST(NULL AS DECIMAL(18,2)) AS percentage FROM block
  UNION ALL SELECT 'transactions', count(*), NULL FROM tx
  UNION ALL SELECT 'type ' || t_type, count(*), {_percent('count(*)', '(SELECT count(*) FROM tx)')}
  FROM tx GROUP BY t_type)
"""

_AXIS = "axis AS (SELECT unnest(range(0, (SELECT max(height) + 1 FROM block))) AS height)"


def _rows(condition: str = "true") -> str:
    """All rows of the ledger, restricted to transactions whose `height` meets the condition."""
    source = "s.addrs"
    return f"""
kept AS (SELECT * FROM tx WHERE {condition}),
kept_vin AS (
  SELECT vin.* FROM vin JOIN kept a ON a.t_tx_hash = vi_tx_hash
  JOIN kept b ON b.t_tx_hash = vi_prevout_hash),
kept_src AS (SELECT vi_tx_hash AS tx, {_set('vi_address')} AS addrs FROM kept_vin GROUP BY 1),
all_rows AS (
  SELECT 'transaction' AS table_name, t_tx_hash AS row_key,
         t_blockhash || '/' || t_type || '/' || t_tx_vin_count || '/' || t_tx_vj_count || '/' ||
         t_tx_vout_count || '/true/' || t_time AS detail, CAST(t_time AS {TOTAL}) AS amount FROM kept
  UNION ALL
  SELECT 'block', CAST(height AS VARCHAR), b_hash || '/' || b_prev || '/' || b_next || '/1000/4',
         CAST(b_time AS {TOTAL}) FROM block WHERE {condition}
  UNION ALL
  SELECT 'listing', t_tx_hash, t_blockhash, CAST(0 AS {TOTAL}) FROM kept
  UNION ALL
  SELECT 'coingen', c_tx_hash, c_coinbase, CAST(c_sequence AS {TOTAL})
  FROM coingen JOIN kept ON t_tx_hash = c_tx_hash
  UNION ALL
  SELECT 'vin', vi_tx_hash || '/' || vi_prevout_hash || '/' || vi_prevout_n,
         {_key('vi_address')}, CAST(vi_value AS {TOTAL}) FROM kept_vin
  UNION ALL
  SELECT 'vout', vo_tx_hash || '/' || vo_tx_n, {_key('vo_pubkey')}, CAST(vo_value AS {TOTAL})
  FROM vout JOIN kept ON t_tx_hash = vo_tx_hash
  UNION ALL
  SELECT 'vjoinsplit', vj_tx_hash || '/' || vj_vpub_new,
         coalesce({_key(source)}, '-') || ' > ' || coalesce({_key('vj_dest_address')}, '-'),
         CAST(vj_vpub_old AS {TOTAL})
  FROM vjoinsplit JOIN kept ON t_tx_hash = vj_tx_hash LEFT JOIN kept_src s ON s.tx = vj_tx_hash)
"""


def _identity(flows: str, miners: str, founders: str) -> str:
    def part(condition: str, name: str) -> str:
        return (
            f"CAST(sum(coalesce(CASE WHEN {condition} THEN v ELSE 0 END, 0)) "
            f"OVER (ORDER BY height) AS {TOTAL}) AS {name}"
        )

    return f"""{_AXIS},
flows AS ({flows}),
classed AS (
  SELECT height, CASE WHEN address IN (SELECT address FROM {miners}) THEN 'm'
                      WHEN address IN (SELECT address FROM {founders}) THEN 'f' ELSE 'o' END AS c,
         sum(v) AS v
  FROM flows GROUP BY 1, 2),
wide AS (
  SELECT axis.height, coalesce(sum(v), 0) AS a, coalesce(sum(v) FILTER (c = 'f'), 0) AS f,
         coalesce(sum(v) FILTER (c = 'm'), 0) AS m, coalesce(sum(v) FILTER (c = 'o'), 0) AS o
  FROM axis LEFT JOIN classed USING (height) GROUP BY 1)
SELECT height, CAST(sum(a) OVER up AS {TOTAL}) AS all_value,
       CAST(sum(f) OVER up AS {TOTAL}) AS founders_value,
       CAST(sum(m) OVER up AS {TOTAL}) AS miners_value,
       CAST(sum(o) OVER up AS {TOTAL}) AS others_value
FROM wide WINDOW up AS (ORDER BY height)"""


_DEPOSITS = """SELECT height, vj_source_address[1] AS address, vj_vpub_old AS v
  FROM vjoinsplit JOIN tx ON t_tx_hash = vj_tx_hash WHERE vj_vpub_old > 0"""
_WITHDRAWALS = """SELECT height, vo_pubkey[1] AS address, vo_value AS v
  FROM vout JOIN tx ON t_tx_hash = vo_tx_hash WHERE t_type = 'deshielded'"""

_BUCKETS = {
    "private": "t_type = 'private'",
    "public": "t_type = 'public'",
    "shielded": "t_type = 'shielded'",
    "deshielded": "t_type = 'deshielded'",
    "mixed": "t_type = 'mixed'",
    "other": "t_type IN ('minerReward', 'UNKNOWN')",
}
_TYPE_SERIES = f"""{_AXIS},
bucketed AS (
  SELECT axis.height, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _BUCKETS.items())}
  FROM axis LEFT JOIN tx USING (height) GROUP BY 1)"""


def _profile(chosen: str) -> str:
    return f"""chosen AS ({chosen}),
got AS (
  SELECT address, tx, sum(value) AS value FROM (
    SELECT unnest(list_distinct(vo_pubkey)) AS address, vo_tx_hash AS tx, vo_value AS value FROM vout)
  WHERE address IN (SELECT address FROM chosen) GROUP BY 1, 2),
gave AS (
  SELECT address, tx, sum(value) AS value FROM (
    SELECT unnest(list_distinct(vi_address)) AS address, vi_tx_hash AS tx, vi_value AS value FROM vin)
  WHERE address IN (SELECT address FROM chosen) GROUP BY 1, 2),
g AS (
  SELECT address, count(*) AS txs_recv, sum(value) AS total_received,
         count(c_tx_hash) AS coingens, count(c_tx_hash) FILTER (value <> 2.5) AS blocks_mined,
         count(vj_tx_hash) AS joinsplits_out, sum(vj_vpub_new) AS total_deshielded,
         count(vj_tx_hash) FILTER (vj_vpub_new > 0) AS leaving
  FROM got LEFT JOIN coingen ON c_tx_hash = tx LEFT JOIN vj ON vj_tx_hash = tx GROUP BY 1),
s AS (
  SELECT address, count(*) AS txs_sent, sum(value) AS total_sent, count(vj_tx_hash) AS joinsplits_in,
         sum(vj_vpub_old) AS total_shielded, count(vj_tx_hash) FILTER (vj_vpub_old > 0) AS entering
  FROM gave LEFT JOIN vj ON vj_tx_hash = tx GROUP BY 1)
SELECT address, (SELECT min(height) FROM block) AS from_height,
       (SELECT max(height) FROM block) AS to_height,
       coalesce(txs_sent, 0) AS txs_sent, coalesce(txs_recv, 0) AS txs_recv,
       coalesce(coingens, 0) AS coingens, coalesce(blocks_mined, 0) AS blocks_mined,
       coalesce(joinsplits_in, 0) AS joinsplits_in,
       CAST(coalesce(total_shielded, 0) AS {TOTAL}) AS total_shielded,
       coalesce(joinsplits_out, 0) AS joinsplits_out,
       CAST(coalesce(total_deshielded, 0) AS {TOTAL}) AS total_deshielded,
       CAST(coalesce(total_received, 0) AS {TOTAL}) AS total_received,
       CAST(coalesce(total_sent, 0) AS {TOTAL}) AS total_sent,
       CAST(coalesce(total_received, 0) - coalesce(total_sent, 0) AS {TOTAL}) AS remaining,
       coalesce(joinsplits_in, 0) = coalesce(entering, 0) AS joinsplits_in_ok,
       coalesce(joinsplits_out, 0) = coalesce(leaving, 0) AS joinsplits_out_ok
FROM g FULL JOIN s USING (address)"""


def _rich(measure: str) -> str:
    return f"""SELECT address, {measure} FROM stats WHERE address <> ''
ORDER BY {measure} DESC, address LIMIT 10"""


_JOINSPLIT_KEYS = (
    f"{_key('vj_source_address')} AS vj_source_address, {_key('vj_dest_address')} AS vj_dest_address"
)
_ORDER = "CAST(substr({}, 2) AS BIGINT)"


def _doubled(name: str, table: str, key: str, order: str, remainder: int) -> str:
    return (
        f"SELECT '{name}' AS table_name, {key} AS key, CAST(2 AS BIGINT) AS row_count "
        f"FROM {table} WHERE {order} % {DUPLICATED_EVERY} = {remainder}"
    )


def _orphans(name: str, table: str, key: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, {key} AS tx_hash, count(*) AS row_count FROM {table} "
        f"WHERE {_ORDER.format(key)} % {FAULTY_EVERY} = 0 GROUP BY 2"
    )


_METRICS = ("cluster_size", *(f"total_{m}" for m in _SUMS + _COUNTS), "total_distinct_txs")


def _concentration(metric: str) -> str:
    whole = {
        "cluster_size": "(SELECT count(*) FROM stats WHERE address <> '')",
        "total_distinct_txs": "(SELECT count(*) FROM tx)",
    }.get(metric, f"sum({metric})")
    tops = {f"top_{k}": f"sum({metric}) FILTER (cluster_rank < {k})" for k in (5, 10, 25, 30)}
    tops["top_all"] = f"sum({metric})"
    columns = ", ".join(f"{_percent(part, whole)} AS {name}" for name, part in tops.items())
    return f"SELECT '{metric}' AS metric, CAST({whole} AS {TOTAL}) AS total, {columns} FROM cstats"


# body, and the CTE groups it needs after the derivation
_BODIES: dict[str, tuple[str, ...]] = {
    "initial_analysis": (_ANALYSIS, "SELECT * FROM analysis"),
    "tx_types": ("SELECT t_tx_hash, t_type FROM tx",),
    "public_share": (
        f"""SELECT count(*) AS tx_count, count(*) FILTER (t_type = 'public') AS public_count,
        {_percent("count(*) FILTER (t_type = 'public')", 'count(*)')} AS public_percentage FROM tx""",
    ),
    "joinsplit_array_sizes": (
        """SELECT 'nullifiers' AS kind, CAST(1 + ok % 3 AS INTEGER) AS array_size,
        count(*) AS joinsplit_count FROM vj GROUP BY 2
        UNION ALL SELECT 'commitments', CAST(1 + ok % 4 AS INTEGER), count(*) FROM vj GROUP BY 2""",
    ),
    "parse_arrays": (
        f"""SELECT vo_tx_hash, vo_tx_n, len(vo_pubkey) AS address_count,
        {_key('vo_pubkey')} AS addresses FROM vout""",
    ),
    "normalize_cast": (
        f"SELECT vo_tx_hash, vo_value, vo_tx_n, {_key('vo_pubkey')} AS addresses FROM vout",
    ),
    "round_pool_values": ("SELECT vj_tx_hash, vj_vpub_old, vj_vpub_new FROM vj",),
    "height_limit_cascade": (
        f"""kept AS (SELECT * FROM tx WHERE height <= {HEIGHT_LIMIT} AND t_tx_hash <> '{GENESIS_TX}'),
kept_vout AS (SELECT vout.* FROM vout JOIN kept ON t_tx_hash = vo_tx_hash),
kept_vin AS (
  SELECT vin.* FROM vin JOIN kept a ON a.t_tx_hash = vi_tx_hash
  JOIN kept b ON b.t_tx_hash = vi_prevout_hash),
kept_src AS (SELECT vi_tx_hash AS tx, {_set('vi_address')} AS addrs FROM kept_vin GROUP BY 1)""",
        f"""SELECT 'transaction' AS table_name, count(*) AS row_count,
       CAST(sum(t_tx_vout_count) AS {TOTAL}) AS value_total, CAST(0 AS BIGINT) AS address_count
FROM kept
UNION ALL SELECT 'block', count(*), CAST(sum(height) AS {TOTAL}), 0
FROM block WHERE height <= {HEIGHT_LIMIT}
UNION ALL SELECT 'coingen', count(*), CAST(0 AS {TOTAL}), 0
FROM coingen JOIN kept ON t_tx_hash = c_tx_hash
UNION ALL SELECT 'vin', count(*), CAST(sum(vi_value) AS {TOTAL}), CAST(sum(len(vi_address)) AS BIGINT)
FROM kept_vin
UNION ALL SELECT 'vout', count(*), CAST(sum(vo_value) AS {TOTAL}), CAST(sum(len(vo_pubkey)) AS BIGINT)
FROM kept_vout
UNION ALL SELECT 'vjoinsplit', count(*), CAST(sum(vj_vpub_old + vj_vpub_new) AS {TOTAL}),
       CAST(sum(coalesce(len(kept_src.addrs), 0) + coalesce(len(vj_dest_address), 0)) AS BIGINT)
FROM vjoinsplit JOIN kept ON t_tx_hash = vj_tx_hash LEFT JOIN kept_src ON kept_src.tx = vj_tx_hash""",
    ),
    "resolve_inputs": (
        f"""SELECT vi_tx_hash, vi_prevout_hash, vi_prevout_n, {_key('vi_address')} AS vi_address,
        vi_value FROM vin""",
    ),
    "joinsplit_addresses": (
        f"SELECT vj_tx_hash, vj_vpub_old, vj_vpub_new, {_JOINSPLIT_KEYS} FROM vjoinsplit",
    ),
    "enrichment_row_counts": (
        """SELECT 'before' AS stage, count(*) AS row_count FROM vj
        UNION ALL SELECT 'after', count(*) FROM vjoinsplit""",
    ),
    "tx_address_sets": (
        f"""SELECT t_tx_hash AS tx_hash, t_blockhash AS blockhash,
        {_key('dst.addrs')} AS dest_addresses, {_key('src.addrs')} AS src_addresses
        FROM tx LEFT JOIN dst ON dst.tx = t_tx_hash LEFT JOIN src ON src.tx = t_tx_hash""",
    ),
    "joinsplit_raw_dest": (
        f"""SELECT vj_tx_hash, vj_vpub_old, vj_vpub_new, '' AS vj_source_address,
        CASE WHEN t_tx_vout_count > 0 AND t_tx_vin_count = 0 AND vj_vpub_new > 0
             THEN {_key('vj_dest_address')} ELSE '' END AS vj_dest_address
        FROM vjoinsplit JOIN tx ON t_tx_hash = vj_tx_hash""",
    ),
    "vout_flags": (
        """SELECT vo_tx_hash, vo_tx_n, t_tx_vj_count > 0 AND t_tx_vin_count = 0 AS is_vjoinsplit
        FROM vout JOIN tx ON t_tx_hash = vo_tx_hash""",
    ),
    "address_received": (_ADDRESSES, "SELECT address, recv FROM recv"),
    "address_sent": (_ADDRESSES, "SELECT address, sent FROM sent"),
    "address_tx_counts": (
        _ADDRESSES,
        "SELECT address, txs_sent, txs_recv FROM stats WHERE txs_sent + txs_recv > 0",
    ),
    "address_io_counts": (
        _ADDRESSES,
        "SELECT address, vins_count, vouts_count FROM stats WHERE vins_count + vouts_count > 0",
    ),
    "address_coingens": (_ADDRESSES, "SELECT address, coingens_recv FROM cbs"),
    "address_pool_flows": (
        _ADDRESSES,
        f"""SELECT address, CAST(coalesce(pool_sent, 0) AS {TOTAL}) AS pool_sent,
        CAST(coalesce(pool_recv, 0) AS {TOTAL}) AS pool_recv FROM pin FULL JOIN pout USING (address)""",
    ),
    "address_stats": (_ADDRESSES, "SELECT * FROM stats"),
    "address_stats_parity": (
        _ADDRESSES,
        """SELECT address, CASE WHEN txs_sent > 0 AND txs_recv > 0 THEN no_txs_total ELSE 0 END
        AS no_txs_total FROM stats""",
    ),
    "stitched_address_label": (
        f"""r AS (SELECT vo_pubkey, sum(vo_value) AS recv FROM vout GROUP BY 1),
s AS (SELECT vi_address, sum(vi_value) AS sent FROM vin GROUP BY 1),
flat AS (
  SELECT *, CASE WHEN len(vo_pubkey) = 1 THEN vo_pubkey[1] WHEN vo_pubkey IS NOT NULL THEN '' END AS o,
         CASE WHEN len(vi_address) = 1 THEN vi_address[1] WHEN vi_address IS NOT NULL THEN '' END AS i
  FROM r FULL JOIN s ON vo_pubkey = vi_address)""",
        f"""SELECT {_key('vo_pubkey')} AS vo_pubkey, {_key('vi_address')} AS vi_address,
       o AS output_address, i AS input_address,
       CASE WHEN len(vo_pubkey) = 0 THEN '' ELSE vo_pubkey[1] END AS first_output,
       CASE WHEN o IS NULL OR o = '' THEN i ELSE o END AS label,
       CASE WHEN vo_pubkey IS NOT NULL AND vi_address IS NOT NULL AND vo_pubkey = vi_address
            THEN vi_address[1]
            WHEN vo_pubkey IS NULL THEN vi_address[1]
            WHEN vi_address IS NULL THEN CASE WHEN len(vo_pubkey) = 0 THEN '' ELSE vo_pubkey[1] END
       END AS stitched,
       CAST(coalesce(recv, 0) AS {TOTAL}) AS recv, CAST(coalesce(sent, 0) AS {TOTAL}) AS sent
FROM flat""",
    ),
    "rich_list_recv": (_ADDRESSES, _rich("recv")),
    "rich_list_sent": (_ADDRESSES, _rich("sent")),
    "rich_list_value": (_ADDRESSES, _rich("current_value")),
    "address_profile": (_ADDRESSES, _profile(_rich("recv"))),
    "address_profile_pools": (_profile("SELECT address FROM pools"),),
    "address_profile_single": (_profile(f"SELECT '{PROFILED_ADDRESS}' AS address"),),
    "address_co_sources": (
        f"""SELECT DISTINCT unnest(vi_address) AS address FROM vin WHERE vi_tx_hash IN
        (SELECT vi_tx_hash FROM vin WHERE list_contains(vi_address, '{PROFILED_ADDRESS}'))""",
    ),
    "co_source_addresses": (
        """SELECT DISTINCT unnest(vi_address) AS address FROM vin JOIN tx ON t_tx_hash = vi_tx_hash
        WHERE t_type = 'public'""",
    ),
    "public_total_sent": (
        f"""SELECT CAST(sum(vi_value) AS {TOTAL}) AS sent FROM vin
        JOIN tx ON t_tx_hash = vi_tx_hash WHERE t_type = 'public'""",
    ),
    "address_balances": (
        _CHANGES,
        f"SELECT address, height, CAST(sum(change) OVER (PARTITION BY address ORDER BY height) AS {TOTAL}) AS balance FROM changes",
    ),
    "address_active_ranges": (
        _CHANGES,
        f"""spaced AS (
  SELECT address, height, CASE WHEN height - lag(height) OVER up <= {ACTIVE_GAP} THEN 0 ELSE 1 END AS start
  FROM changes WINDOW up AS (PARTITION BY address ORDER BY height)),
stretched AS (SELECT *, sum(start) OVER (PARTITION BY address ORDER BY height) AS stretch FROM spaced)""",
        """SELECT address, min(height) AS first_height, max(height) AS last_height, count(*) AS active_heights
        FROM stretched GROUP BY address, stretch""",
    ),
    "height_axis": (_AXIS, "SELECT height FROM axis"),
    "transaction_heights": ("SELECT t_tx_hash AS tx_hash, height, t_type AS type FROM tx",),
    "types_per_height": (_TYPE_SERIES, "SELECT * FROM bucketed"),
    "types_cumulative": (
        _TYPE_SERIES,
        f"""SELECT height, {', '.join(f'CAST(sum({n}) OVER up AS BIGINT) AS {n}' for n in _BUCKETS)}
        FROM bucketed WINDOW up AS (ORDER BY height)""",
    ),
    "pool_value_over_height": (
        _AXIS,
        f"""SELECT height, CAST(sum(coalesce(v, 0)) OVER (ORDER BY height) AS {TOTAL}) AS pool_value
        FROM axis LEFT JOIN (
          SELECT height, sum(vj_vpub_old) - sum(vj_vpub_new) AS v
          FROM vj JOIN tx ON t_tx_hash = vj_tx_hash GROUP BY 1) USING (height)""",
    ),
    "deposits_withdrawals": (
        _AXIS,
        f"""SELECT height, CAST(coalesce(sum(vj_vpub_old), 0) AS {TOTAL}) AS deposits,
        CAST(-coalesce(sum(vj_vpub_new), 0) AS {TOTAL}) AS withdrawals
        FROM axis LEFT JOIN (
          SELECT height, vj_vpub_old, vj_vpub_new FROM vj JOIN tx ON t_tx_hash = vj_tx_hash)
        USING (height) GROUP BY 1""",
    ),
    "deposits_by_identity": (_identity(_DEPOSITS, "miners", "founders"),),
    "withdrawals_by_identity_a": (_identity(_WITHDRAWALS, "miners", "founders"),),
    "withdrawals_by_identity_b": (_identity(_WITHDRAWALS, "miners", "h3"),),
    "withdrawals_by_identity_c": (_identity(_WITHDRAWALS, "h4", "h3"),),
    "founder_correlation": (
        _AXIS,
        f"""SELECT height,
        CAST(249.9999 * sum(d) OVER up AS {TOTAL}) AS deposits,
        CAST(250.0001 * sum(w) OVER up AS {TOTAL}) AS withdrawals
        FROM (SELECT axis.height, count(*) FILTER (vj_vpub_old = 249.9999) AS d,
                     count(*) FILTER (vj_vpub_new = 250.0001) AS w
              FROM axis LEFT JOIN tx USING (height) LEFT JOIN vj ON vj_tx_hash = t_tx_hash GROUP BY 1)
        WINDOW up AS (ORDER BY height)""",
    ),
    "trivial_miners": ("SELECT address FROM miners",),
    "heuristic3_founders": ("SELECT address FROM h3",),
    "heuristic4_miners": ("SELECT address FROM h4",),
    "heuristic5_links": (_H5, "SELECT * FROM h5"),
    "founder_set_union": ("SELECT address FROM h3 UNION SELECT address FROM founders",),
    "cospend_edges": (_LINKS, "SELECT src, dst FROM edges"),
    "address_transactions": (
        _LINKS,
        "SELECT tx_hash, address FROM pairs SEMI JOIN centre USING (tx_hash)",
    ),
    "cluster_members": (_LINKS, _CLUSTERS, "SELECT address, cluster_id FROM members"),
    "clusters_after_append": (_LINKS, _CLUSTERS, "SELECT address, cluster_id FROM members"),
    "cluster_evidence": (
        _LINKS,
        _CLUSTERS,
        # Kruskal's algorithm: the row '' counts edges, 'e' || k is a taken edge, the others are labels
        """numbered AS (
  SELECT row_number() OVER (ORDER BY tx_hash, src, dst) AS k, * FROM (
    SELECT min(tx_hash) AS tx_hash, src, dst FROM links GROUP BY src, dst)),
forest(node, label, k) USING KEY (node) AS (
  SELECT address, address, 0 FROM members
  UNION ALL SELECT '', '', 0
  UNION
  SELECT unnest(CASE WHEN c.node = '' THEN ['', 'e' || n.k] ELSE [c.node] END),
         CASE WHEN c.node = '' THEN CASE WHEN a.label <> b.label THEN 'taken' ELSE 'left' END
              ELSE least(a.label, b.label) END,
         n.k
  FROM (SELECT k + 1 AS k FROM forest WHERE node = '') turn
       JOIN numbered n USING (k)
       JOIN recurring.forest a ON a.node = n.src
       JOIN recurring.forest b ON b.node = n.dst
       JOIN recurring.forest c ON c.node = '' OR (a.label <> b.label AND c.label = greatest(a.label, b.label)))
SELECT m.cluster_id, n.tx_hash, n.src, n.dst
FROM numbered n JOIN forest f ON f.node = 'e' || n.k JOIN members m ON m.address = n.src
WHERE f.label = 'taken'""",
    ),
    "cluster_ranks": (_LINKS, _CLUSTERS, "SELECT * FROM ranks"),
    "cluster_disjointness": (
        _LINKS,
        _CLUSTERS,
        """SELECT count(*) AS ambiguous_addresses FROM (
        SELECT address FROM members GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1)""",
    ),
    "cluster_summary": (_LINKS, _CLUSTERS, _SUMMARY, "SELECT * FROM summary"),
    "cluster_stats": (_ADDRESSES, _LINKS, _CLUSTERS, _CLUSTER_STATS, "SELECT * FROM cstats"),
    "cluster_members_without_stats": (
        _ADDRESSES,
        _LINKS,
        _CLUSTERS,
        """SELECT address, cluster_id FROM members
        WHERE address NOT IN (SELECT address FROM stats)""",
    ),
    "cluster_transactions": (
        _ADDRESSES,
        _LINKS,
        _CLUSTERS,
        _CLUSTER_STATS,
        "SELECT tx_hash, cluster_id FROM ctx",
    ),
    "cluster_tags": (_LINKS, _CLUSTERS, _LABELS, "SELECT * FROM ctags"),
    "cluster_tag_names": (
        _LINKS,
        _CLUSTERS,
        _LABELS,
        f"SELECT * FROM ({_TAG_NAMES})",
    ),
    "cluster_tag_coverage": (_LINKS, _CLUSTERS, _LABELS, _COVERAGE),
    "cluster_concentration": (
        _ADDRESSES,
        _LINKS,
        _CLUSTERS,
        _CLUSTER_STATS,
        " UNION ALL ".join(_concentration(metric) for metric in _METRICS),
    ),
    "largest_cluster_edges": (
        _LINKS,
        _CLUSTERS,
        """SELECT tx_hash, src, dst FROM links JOIN members ON address = src
        WHERE cluster_id = (SELECT cluster_id FROM ranks WHERE cluster_rank = 0)""",
    ),
    "cluster_lookup": (
        _LINKS,
        _CLUSTERS,
        """SELECT cluster_rank, cluster_id, address FROM members JOIN ranks USING (cluster_id)
        WHERE address IN (SELECT address FROM tags)""",
    ),
    "cluster_pool_members": (
        _LINKS,
        _CLUSTERS,
        "SELECT address, cluster_id FROM members WHERE address IN (SELECT address FROM pools)",
    ),
    "cluster_top_addresses": (
        _ADDRESSES,
        _LINKS,
        _CLUSTERS,
        f"""sides AS (
  SELECT cluster_id, address, 'deposited' AS side, pool_sent AS amount
  FROM members JOIN stats USING (address) WHERE pool_sent > 0
  UNION ALL SELECT cluster_id, address, 'withdrawn', pool_recv
  FROM members JOIN stats USING (address) WHERE pool_recv > 0)""",
        f"""SELECT cluster_id, side, address, amount,
       CAST(row_number() OVER (PARTITION BY cluster_id, side ORDER BY amount DESC, address)
            AS INTEGER) AS place,
       CAST(sum(amount) OVER (PARTITION BY cluster_id, side) AS {TOTAL}) AS side_total,
       count(*) OVER (PARTITION BY cluster_id, side) AS side_addresses
FROM sides QUALIFY place <= 5""",
    ),
    "key_violations": (
        " UNION ALL ".join(
            [
                _doubled("transaction", "tx", "t_tx_hash", _ORDER.format("t_tx_hash"), 0),
                _doubled("block", "block", "CAST(height AS VARCHAR)", "height", 0),
                _doubled("coingen", "coingen", "c_tx_hash", _ORDER.format("c_tx_hash"), 0),
                _doubled(
                    "vin",
                    "vin",
                    "vi_tx_hash || '/' || vi_prevout_hash || '/' || vi_prevout_n",
                    _ORDER.format("vi_tx_hash"),
                    1,
                ),
                _doubled(
                    "vout", "vout", "vo_tx_hash || '/' || vo_tx_n", _ORDER.format("vo_tx_hash"), 0
                ),
            ]
        ),
    ),
    "orphan_rows": (
        " UNION ALL ".join(
            [
                _orphans("coingen", "coingen", "c_tx_hash"),
                _orphans("vin", "vin", "vi_tx_hash"),
                _orphans("vout", "vout", "vo_tx_hash"),
                _orphans("vjoinsplit", "vj", "vj_tx_hash"),
            ]
        ),
    ),
    "missing_transactions": (
        f"""SELECT t_tx_hash, t_blockhash, 0 AS t_time, 0 AS t_blocktime, false AS t_valid,
        0 AS t_tx_vin_count, 0 AS t_tx_vj_count, 0 AS t_tx_vout_count, 'UNKNOWN' AS t_type
        FROM tx WHERE {_ORDER.format('t_tx_hash')} % {FAULTY_EVERY} = 0""",
    ),
    **{
        name: (_rows(), "SELECT * FROM all_rows")
        for name in (
            "csv_round_trip",
            "json_flatten",
            "parquet_round_trip",
            "append_tables",
            "jdbc_normalize",
        )
    },
    "incremental_append": (_rows("height >= 1"), "SELECT * FROM all_rows"),
    "stream_append": (_rows(), "SELECT * FROM all_rows"),
    "stream_resume": (_rows(), "SELECT * FROM all_rows WHERE table_name NOT IN ('block', 'listing')"),
    "json_rejects": (
        _rows(),
        f"""SELECT table_name, row_key,
        CASE WHEN rejected AND table_name = 'transaction'
             THEN replace(split_part(detail, '/', 1) || '/UNKNOWN/0/0/0/false/0', ' ', '') ELSE detail END AS detail,
        CASE WHEN rejected THEN CAST(0 AS {TOTAL}) ELSE amount END AS amount
        FROM (SELECT *, {_ORDER.format("split_part(row_key, '/', 1)")} % {FAULTY_EVERY} = 0 AS rejected FROM all_rows
              WHERE table_name IN ('transaction', 'coingen', 'vout'))
        WHERE NOT rejected OR table_name = 'transaction'
        UNION ALL SELECT 'reject', '', '', CAST(0 AS {TOTAL})
        FROM tx WHERE {_ORDER.format('t_tx_hash')} % {FAULTY_EVERY} = 0""",
    ),
    "stream_resolved": (
        f"""SELECT vi_tx_hash, vi_prevout_hash, vi_prevout_n, {_key('vi_address')} AS vi_address,
        vi_value FROM vin""",
    ),
    "load_refused": (
        _rows(f"height BETWEEN 1 AND {HEIGHT_LIMIT}"),
        f"""late AS (
  SELECT t_tx_hash, {_ORDER.format('t_tx_hash')} AS ok FROM tx WHERE height > {HEIGHT_LIMIT}),
gone AS (SELECT t_tx_hash FROM late WHERE ok % {FAULTY_EVERY} = 0)""",
        f"""SELECT table_name, 'stored' AS problem, count(*) AS row_count FROM all_rows
        WHERE table_name <> 'listing' GROUP BY 1
        UNION ALL SELECT 'coingen', 'no transaction', count(*) FROM coingen JOIN gone ON t_tx_hash = c_tx_hash
        UNION ALL SELECT 'vin', 'no transaction', count(*) FROM vin JOIN gone ON t_tx_hash = vi_tx_hash
        UNION ALL SELECT 'vout', 'no transaction', count(*) FROM vout JOIN gone ON t_tx_hash = vo_tx_hash
        UNION ALL SELECT 'vjoinsplit', 'no transaction', count(*) FROM vj JOIN gone ON t_tx_hash = vj_tx_hash
        UNION ALL SELECT 'vout', 'repeated key', count(*) FROM vout JOIN late ON t_tx_hash = vo_tx_hash
        WHERE ok % {DUPLICATED_EVERY} = 0 AND ok % {FAULTY_EVERY} <> 0
        UNION ALL SELECT 'transaction', 'stored already', count(*) FROM tx
        WHERE height BETWEEN 1 AND {HEIGHT_LIMIT} AND {_ORDER.format('t_tx_hash')} % {DUPLICATED_EVERY} = 0""",
    ),
    "address_list_load": (
        """SELECT address, max(tag) AS tag FROM (
        SELECT address, tag FROM pools UNION ALL
        SELECT address, 'zz' || tag FROM pools WHERE CAST(substr(tag, 6) AS INTEGER) % 2 = 0)
        GROUP BY 1""",
    ),
    "duplicated_list_entries": (
        "SELECT address, CAST(2 AS BIGINT) AS row_count FROM founders WHERE address LIKE '%\\_3' ESCAPE '\\'",
    ),
    "address_list_write": ("SELECT address FROM miners",),
    "address_stats_csv": (_ADDRESSES, "SELECT * FROM stats"),
    "rich_list_csv": (
        _ADDRESSES,
        f"SELECT address, recv AS total_coins_received FROM ({_rich('recv')})",
    ),
    "cluster_stats_csv": (
        _ADDRESSES,
        _LINKS,
        _CLUSTERS,
        _CLUSTER_STATS,
        _LABELS,
        f"""SELECT cstats.*, {', '.join(f'coalesce({n}_count, 0) AS {n}_count' for n in _KINDS)}
        FROM cstats LEFT JOIN ctags USING (cluster_id)""",
    ),
    "report_lines": (
        _ADDRESSES,
        _LINKS,
        _CLUSTERS,
        _CLUSTER_STATS,
        _LABELS,
        _SUMMARY,
        _H5,
        _ANALYSIS,
        """SELECT 'initial_analysis' AS report,
       item || chr(9) || amount || coalesce(chr(9) || percentage, '') AS line FROM analysis
UNION ALL SELECT 'heuristic5', deposit_tx || ' --> ' || withdrawal_tx FROM h5
UNION ALL SELECT 'clusters', '- ' || metric || ' : ' || metric_value FROM summary
UNION ALL SELECT 'clusters', '- cluster ' || cluster_rank || ' : cluster_size ' || cluster_size ||
       ', pool_count ' || pool_count || ', miner_count ' || miner_count ||
       ', founder_count ' || founder_count ||
       ', heuristic_miner_count ' || heuristic_miner_count ||
       ', heuristic_founder_count ' || heuristic_founder_count || ', tag_count ' || tag_count ||
       ', total_distinct_txs ' || total_distinct_txs || """ + " || ".join(f"', total_{name} ' || total_{name}" for name in _SUMS + _COUNTS) + """ ||
       ', heuristic_miner_percentage ' || heuristic_miner_percentage || ', founder_percentage ' || founder_percentage
FROM cstats JOIN ctags USING (cluster_id) JOIN (""" + _COVERAGE + """) USING (cluster_id)
UNION ALL SELECT 'clusters', '- cluster ' || cluster_rank || ' : ' || kind || ' ' || tag || ', addresses ' || addresses
FROM cstats JOIN (""" + _TAG_NAMES + """) USING (cluster_id)""",
    ),
}


def _sql(parts: tuple[str, ...]) -> str:
    """Join CTE groups and the final SELECT; the last part may bring CTEs of its own."""
    *groups, body = parts
    ctes = ",\n".join(group.strip() for group in (_DERIVATION, *groups))
    joint = "\n" if body.lstrip().upper().startswith("SELECT") else ",\n"
    return f"WITH RECURSIVE {ctes}{joint}{body}"


ORACLES: dict[str, str] = {name: _sql(parts) for name, parts in _BODIES.items()}
