"""The same queries as plain SQL, written from the definitions rather than from the Spark plans:
previous votes by lag, removals by EXISTS over a range, and the ordered step by recursion with one
row per vote."""

# Smallest reputations of 26, 27, ... points, ceil(10 ** (9 + (2 k + 1) / 18)).
THRESHOLDS = [
    1136463667, 1467799268, 1895735653, 2448436747, 3162277661, 4084238653, 5274997064, 6812920691, 8799225436,
    11364636664, 14677992677, 18957356525, 24484367469, 31622776602, 40842386527, 52749970638, 68129206906,
    87992254357, 113646366639, 146779926763, 189573565241, 244843674683, 316227766017, 408423865268,
    527499706371, 681292069058, 879922543570, 1136463666386, 1467799267623, 1895735652407, 2448436746823,
    3162277660169, 4084238652675, 5274997063703, 6812920690580, 8799225435692, 11364636663858, 14677992676221,
    18957356524064, 24484367468223, 31622776601684, 40842386526746, 52749970637027, 68129206905797,
    87992254356911, 113646366638573, 146779926762207, 189573565240638, 244843674682223, 316227766016838,
    408423865267453, 527499706370262, 681292069057962, 879922543569108, 1136463666385725, 1467799267622070,
    1895735652406376, 2448436746822228, 3162277660168380, 4084238652674522, 5274997063702619, 6812920690579613,
    8799225435691071, 11364636663857248, 14677992676220696, 18957356524063759, 24484367468222271,
    31622776601683794, 40842386526745212, 52749970637026185, 68129206905796129, 87992254356910704,
    113646366638572475, 146779926762206955, 189573565240637581, 244843674682222701, 316227766016837934,
    408423865267452112, 527499706370261841, 681292069057961286, 879922543569107031, 1136463666385724747,
    1467799267622069541, 1895735652406375804, 2448436746822227007, 3162277660168379332, 4084238652674521117,
    5274997063702618402, 6812920690579612855, 8799225435691070302,
]

_DENSE = """
ops AS (
  SELECT CAST(event_id + 1 AS BIGINT) AS source_op, CAST(event_id // 10 + 1 AS INTEGER) AS block_num,
    event_type <> 'error' AS is_vote,
    CASE WHEN event_type <> 'error' THEN 72 WHEN (event_id + 1) % 2 = 1 THEN 17 ELSE 61 END AS op_type_id,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 40 AS INTEGER) AS author_id,
    CASE WHEN event_type <> 'error' THEN CAST(user_id % 40 AS INTEGER) END AS voter_id,
    'post-' || (event_id % 3) AS permlink,
    CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) * 10000000
      * CASE WHEN event_type IN ('view', 'signup') THEN -1 ELSE 1 END END AS rshares
  FROM events)"""

_WIDE = """
ops AS (
  SELECT *, op_type_id = 72 AS is_vote FROM (
  SELECT CAST(o_orderkey + 1 AS BIGINT) AS source_op, CAST(o_orderkey // 10 + 1 AS INTEGER) AS block_num,
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 = 0 THEN 17
      WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 = 1 THEN 61 ELSE 72 END AS op_type_id,
    CAST((o_orderkey * 7919) % (SELECT count(*) FROM customer) AS INTEGER) AS author_id,
    CASE WHEN op_type_id = 72 THEN CAST(o_custkey AS INTEGER) END AS voter_id,
    'post-' || (o_orderkey % 2) AS permlink,
    CASE WHEN op_type_id = 72 THEN CAST(round(o_totalprice * 100) AS BIGINT) * 10000
      * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END END AS rshares
  FROM orders))"""

_NAMES = """
known AS (SELECT CAST(c_custkey AS INTEGER) AS id, 'acct-' || c_custkey AS name FROM customer WHERE c_acctbal >= 0),
names AS (
  SELECT DISTINCT 'acct-' || id AS name
  FROM (SELECT author_id AS id FROM ops UNION ALL SELECT voter_id FROM ops WHERE voter_id IS NOT NULL))"""


def _active(source: str, target: str) -> str:
    """Active votes after the operations of one relation, from nothing."""
    return f"""
{target} AS (
  SELECT author_id, voter_id, permlink, rshares, source_op FROM (
    SELECT *, row_number() OVER (PARTITION BY author_id, voter_id, permlink ORDER BY source_op DESC) AS n
    FROM {source} WHERE is_vote) v
  WHERE n = 1 AND NOT EXISTS (
    SELECT 1 FROM {source} d WHERE NOT d.is_vote AND d.author_id = v.author_id
      AND d.permlink = v.permlink AND d.source_op > v.source_op))"""


_LAGGED = """
lagged AS (
  SELECT *, lag(rshares) OVER w AS back_rshares, lag(source_op) OVER w AS back_op FROM ops WHERE is_vote
  WINDOW w AS (PARTITION BY author_id, voter_id, permlink ORDER BY source_op))"""

_REMOVED_SINCE = """EXISTS (
    SELECT 1 FROM ops d WHERE NOT d.is_vote AND d.author_id = l.author_id AND d.permlink = l.permlink
      AND d.source_op BETWEEN coalesce(l.back_op, 0) AND l.source_op)"""

_TRANSITIONS = f"""{_LAGGED},
transitions AS (
  SELECT author_id, voter_id, permlink, rshares, source_op,
    CASE WHEN coalesce(back_rshares, 0) <> 0 AND NOT {_REMOVED_SINCE}
      THEN back_rshares ELSE 0 END AS prev_rshares
  FROM lagged l)"""

# State of all accounts in two lists, position id + 1; one row per vote.
_FOLD = """
steps AS (
  SELECT row_number() OVER (ORDER BY source_op) AS step, source_op, author_id + 1 AS a, voter_id + 1 AS v,
    rshares >> 6 AS rs, prev_rshares >> 6 AS ps FROM transitions),
folded(step, source_op, a, rep, imp, ra0, ia0, rv0, iv0, undone, applied) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0,
    [CAST(0 AS BIGINT) FOR x IN range((SELECT max(greatest(a, v)) FROM steps))],
    [true FOR x IN range((SELECT max(greatest(a, v)) FROM steps))],
    CAST(0 AS BIGINT), true, CAST(0 AS BIGINT), true, false, false
  UNION ALL
  SELECT step, source_op, a,
    list_concat(rep[1:a - 1], [CASE WHEN p THEN ra1 + rs ELSE ra1 END], rep[a + 1:]),
    list_concat(imp[1:a - 1], [NOT p AND ia1], imp[a + 1:]),
    ra, ia, rv, iv, u, p
  FROM (SELECT *, rv1 >= 0 AND (rs >= 0 OR (NOT iv1 AND rv1 > ra1)) AS p
  FROM (SELECT *, CASE WHEN u AND a = v THEN ra1 ELSE rv END AS rv1,
    CASE WHEN u AND a = v THEN ia1 ELSE iv END AS iv1
  FROM (SELECT *, CASE WHEN u THEN ra - ps ELSE ra END AS ra1,
    CASE WHEN u THEN ra - ps = 0 ELSE ia END AS ia1
  FROM (SELECT *, NOT ia AND rv >= 0 AND (ps >= 0 OR (NOT iv AND rv > ra - ps)) AS u
  FROM (SELECT s.step, s.source_op, s.a, s.v, s.rs, s.ps, f.rep, f.imp,
      f.rep[s.a] AS ra, f.imp[s.a] AS ia, f.rep[s.v] AS rv, f.imp[s.v] AS iv
    FROM folded f JOIN steps s ON s.step = f.step + 1))))))"""



def _standing(ops: str) -> str:
    return f"""WITH RECURSIVE {ops}, {_TRANSITIONS}, {_FOLD},
standing AS (
  SELECT CAST(id AS INTEGER) AS account_id, rep[id + 1] AS reputation, imp[id + 1] AS is_implicit
  FROM (SELECT rep, imp FROM folded ORDER BY step DESC LIMIT 1),
    (SELECT DISTINCT a - 1 AS id FROM folded WHERE applied))"""


_STANDING = _standing(_DENSE)
_WIDE_STANDING = _standing(_WIDE)
_FIRST_HALF_STANDING = _standing(_DENSE.replace(
    "FROM events)", "FROM events WHERE event_id // 10 + 1 <= (SELECT max(event_id // 10 + 1) // 2 FROM events))"))

_STANDING_ROWS = _STANDING + " SELECT * FROM standing"

_SCORE = """CAST(CASE WHEN {r} IS NULL OR {r} = 0 THEN 0
  ELSE round(25 + sign({r}) * 9 * greatest(log10(abs({r})) - 9, 0)) END AS INTEGER)"""

# The second half of the blocks against the votes stored by the first half.
_HALVES = f"""{_DENSE.replace("ops AS", "every_op AS", 1)},
middle AS (SELECT max(block_num) // 2 AS block FROM every_op),
earlier AS (SELECT * FROM every_op WHERE block_num <= (SELECT block FROM middle)),
ops AS (SELECT * FROM every_op WHERE block_num > (SELECT block FROM middle)),
{_active("earlier", "stored")}"""

_DUMPS = """
cents AS (
  SELECT CAST(c_custkey AS INTEGER) AS account_id, CAST(round(c_acctbal * 100) AS BIGINT) AS cents,
    c_mktsegment, c_nationkey, c_acctbal FROM customer),
expected AS (
  SELECT account_id, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN cents ELSE cents + c_nationkey END AS BIGINT)
    AS reputation FROM cents WHERE c_mktsegment <> 'MACHINERY'),
current_values AS (SELECT account_id, cents AS reputation FROM cents WHERE c_acctbal >= 0)"""

_STRICT_DIFF = """SELECT coalesce(e.account_id, c.account_id) AS account_id
  FROM expected e FULL OUTER JOIN current_values c ON c.account_id = e.account_id
  WHERE e.reputation IS DISTINCT FROM c.reputation"""

_PROGRESS = """
blocks AS (SELECT CAST(event_id // 10 + 1 AS INTEGER) AS block_num, ts FROM events),
progress AS (
  SELECT (block_num - 1) // 100 AS version, min(block_num) AS first_block, max(block_num) AS last_block,
    min(ts) AS started_at, max(ts) AS ended_at FROM blocks GROUP BY 1),
timed AS (SELECT CAST(sum(epoch_us(ended_at) - epoch_us(started_at)) AS BIGINT) AS micros, count(*) AS n FROM progress)"""

_RANKED = """
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY author_id, voter_id, permlink ORDER BY source_op DESC) AS INTEGER)
    AS row_num FROM ops)"""

_RESOLVED = f"""WITH {_WIDE}, {_NAMES}
SELECT o.author_id, v.id AS voter_id, o.permlink, o.rshares, o.source_op, o.is_vote
FROM ops o JOIN known a ON a.id = o.author_id LEFT JOIN known v ON v.id = o.voter_id"""

_RANKED_ROWS = f"""WITH {_DENSE}, {_RANKED}
SELECT author_id, voter_id, permlink, source_op, row_num FROM ranked"""

_TRANSITION_ROWS = "SELECT author_id, voter_id, permlink, rshares, prev_rshares, source_op FROM transitions"

_ACTIVE_ROWS = f"""WITH {_DENSE}, {_active("ops", "active")}
SELECT author_id, voter_id, permlink, rshares FROM active"""

ORACLES: dict[str, str] = {
    "op_range_scan": f"WITH {_WIDE} SELECT source_op, block_num, CAST(op_type_id AS SMALLINT) AS op_type_id FROM ops",
    "op_type_ids": f"""WITH {_WIDE}
        SELECT CAST(count(*) AS INTEGER) AS n_ids, string_agg(CAST(op_type_id AS VARCHAR), ',' ORDER BY op_type_id)
        AS ids_text FROM (SELECT DISTINCT op_type_id FROM ops)""",
    "parsed_ops": f"""WITH {_DENSE} SELECT source_op, is_vote, 'acct-' || author_id AS author,
        'acct-' || voter_id AS voter, permlink, rshares FROM ops""",
    "parsed_votes": f"""WITH {_DENSE} SELECT source_op, CAST(op_type_id AS SMALLINT) AS op_type_id,
        'acct-' || author_id AS author, 'acct-' || voter_id AS voter, permlink, rshares FROM ops WHERE is_vote""",
    "parsed_removals": f"""WITH {_WIDE} SELECT source_op, CAST(op_type_id AS SMALLINT) AS op_type_id,
        'acct-' || author_id AS author, CAST(NULL AS VARCHAR) AS voter, permlink, CAST(NULL AS BIGINT) AS rshares
        FROM ops WHERE NOT is_vote""",
    "account_resolution": _RESOLVED,
    "account_resolution_shuffled": _RESOLVED,
    "account_name_ids": f"WITH {_WIDE}, {_NAMES} SELECT n.name, k.id FROM names n JOIN known k ON k.name = n.name",
    "unknown_accounts": f"WITH {_WIDE}, {_NAMES} SELECT name FROM names WHERE name NOT IN (SELECT name FROM known)",
    "account_lookup": f"""WITH {_WIDE} SELECT DISTINCT 'acct-' || voter_id AS name, voter_id AS id FROM ops""",
    "permlink_dictionary": f"""WITH {_DENSE}, first_batch AS (SELECT DISTINCT permlink FROM ops)
        SELECT permlink, permlink IN (SELECT permlink FROM first_batch) AS was_known, true AS id_kept,
          true AS ids_dense
        FROM (SELECT permlink FROM first_batch UNION SELECT url FROM pages WHERE url IS NOT NULL)""",
    "encoded_ops": f"WITH {_DENSE} SELECT source_op, permlink FROM ops",
    "ranked_ops": _RANKED_ROWS,
    "ranked_ops_hot": _RANKED_ROWS,
    "removals": f"""WITH {_DENSE}, {_RANKED}
        SELECT author_id, permlink, source_op, row_num FROM ranked WHERE NOT is_vote""",
    "latest_votes": f"""WITH {_DENSE}, {_RANKED}
        SELECT author_id, voter_id, permlink, rshares, source_op FROM ranked WHERE row_num = 1 AND is_vote""",
    "previous_vote_in_batch": f"""WITH {_DENSE}, {_LAGGED}
        SELECT source_op, back_rshares AS prev_rshares, coalesce(back_op, 0) AS prev_source_op FROM lagged""",
    "previous_vote_stored": f"""WITH {_HALVES}, {_LAGGED}
        SELECT l.source_op, coalesce(l.back_rshares, s.rshares, 0) AS prev_rshares,
          coalesce(l.back_op, 0) AS prev_source_op
        FROM lagged l LEFT JOIN stored s ON l.back_rshares IS NULL AND s.author_id = l.author_id
          AND s.voter_id = l.voter_id AND s.permlink = l.permlink""",
    "cancelled_previous": f"""WITH {_DENSE}, {_LAGGED}
        SELECT source_op, back_rshares AS cancelled_rshares FROM lagged l
        WHERE back_rshares <> 0 AND {_REMOVED_SINCE}""",
    "vote_transitions": f"WITH {_DENSE}, {_TRANSITIONS} {_TRANSITION_ROWS}",
    "vote_transitions_hot": f"WITH {_DENSE}, {_TRANSITIONS} {_TRANSITION_ROWS}",
    "vote_transitions_wide": f"WITH {_WIDE}, {_TRANSITIONS} {_TRANSITION_ROWS}",
    "removed_votes": f"""WITH {_HALVES}
        SELECT author_id, voter_id, permlink, rshares FROM stored s WHERE EXISTS (
          SELECT 1 FROM ops d WHERE NOT d.is_vote AND d.author_id = s.author_id AND d.permlink = s.permlink)""",
    "surviving_votes": f"""WITH {_HALVES}, {_active("ops", "survivors")}
        SELECT author_id, voter_id, permlink, rshares, source_op FROM survivors""",
    "active_votes": _ACTIVE_ROWS,
    "active_votes_wide": f"""WITH {_WIDE}, {_active("ops", "active")}
        SELECT author_id, voter_id, permlink, rshares FROM active""",
    "active_votes_incremental": _ACTIVE_ROWS,
    "batch_effect_counts": f"""WITH {_HALVES}, {_active("ops", "survivors")}
        SELECT (SELECT count(*) FROM stored s WHERE EXISTS (SELECT 1 FROM ops d WHERE NOT d.is_vote
            AND d.author_id = s.author_id AND d.permlink = s.permlink)) AS deleted_votes,
          (SELECT count(*) FROM survivors) AS upserted_votes,
          (SELECT count(*) FROM ops WHERE is_vote) AS queued_votes""",
    "scaled_votes": f"""WITH {_DENSE}, {_TRANSITIONS} SELECT source_op, rshares >> 6 AS scaled_rshares,
        prev_rshares >> 6 AS scaled_prev_rshares FROM transitions""",
    "raw_standing": _STANDING_ROWS,
    "raw_standing_sliced": _STANDING_ROWS,
    "raw_standing_windows": _STANDING_ROWS,
    "raw_standing_incremental": _STANDING_ROWS,
    "merged_reputation": """
        WITH new_values AS (SELECT CAST(o_custkey AS INTEGER) AS account_id,
          CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS reputation FROM orders GROUP BY 1)
        SELECT coalesce(n.account_id, CAST(c.c_custkey AS INTEGER)) AS account_id,
          coalesce(n.reputation, CAST(round(c.c_acctbal * 100) AS BIGINT)) AS reputation,
          n.account_id IS NULL AS is_implicit
        FROM customer c FULL OUTER JOIN new_values n ON n.account_id = c.c_custkey""",
    "vote_gates": f"""{_STANDING}
        SELECT source_op, ra0 AS author_reputation, ia0 AS author_implicit, rv0 AS voter_reputation,
          iv0 AS voter_implicit, undone, applied FROM folded WHERE step > 0""",
    "vote_gates_windows": f"""{_STANDING}
        SELECT source_op, ra0 AS author_reputation, ia0 AS author_implicit, rv0 AS voter_reputation,
          iv0 AS voter_implicit, undone, applied FROM folded WHERE step > 0""",
    "scores": f"""{_STANDING}, accounts AS (
          SELECT DISTINCT id FROM (SELECT author_id AS id FROM ops UNION ALL SELECT CAST(user_id % 40 AS INTEGER)
            FROM events))
        SELECT a.id AS account_id, 'acct-' || a.id AS name, {_SCORE.format(r="s.reputation")} AS score
        FROM accounts a LEFT JOIN standing s ON s.account_id = a.id""",
    "account_score": f"""{_STANDING}
        SELECT 'acct-' || a.id AS name, {_SCORE.format(r="s.reputation")} AS score
        FROM (SELECT DISTINCT author_id AS id FROM ops) a LEFT JOIN standing s ON s.account_id = a.id""",
    "score_thresholds": f"""WITH steps AS (SELECT {THRESHOLDS} AS t), raw AS (
          SELECT o_orderkey, t, CASE WHEN o_orderpriority = '5-LOW'
              THEN CASE WHEN o_orderstatus <> 'O' THEN 0 END
              ELSE (CAST(t[CAST(o_orderkey % {len(THRESHOLDS)} + 1 AS INTEGER)] AS BIGINT) + o_custkey % 3 - 1)
                * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END END AS reputation
          FROM orders, steps)
        SELECT o_orderkey, CAST(reputation AS BIGINT) AS reputation,
          CAST(CASE WHEN reputation IS NULL OR reputation = 0 THEN 0
            ELSE 25 + sign(reputation) * len([x FOR x IN t IF x <= abs(reputation)]) END AS INTEGER) AS score
        FROM raw""",
    "score_values": f"""WITH raw AS (
          SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CAST(pow(10, o_orderkey % 12) AS BIGINT)
            * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS r FROM orders)
        SELECT o_orderkey, {_SCORE.format(r="r")} AS score FROM raw""",
    "expected_values": f"WITH {_DUMPS} SELECT account_id, reputation FROM expected",
    "expected_diff": f"""WITH {_DUMPS} SELECT e.account_id FROM expected e
        JOIN current_values c ON c.account_id = e.account_id WHERE e.reputation <> c.reputation""",
    "expected_diff_strict": f"WITH {_DUMPS} {_STRICT_DIFF}",
    "diff_detail": f"""WITH {_DUMPS}, chosen AS ({_STRICT_DIFF})
        SELECT 'expected' AS side, account_id, reputation FROM expected WHERE account_id IN (FROM chosen)
        UNION ALL SELECT 'current', account_id, reputation FROM current_values WHERE account_id IN (FROM chosen)""",
    "last_block": f"WITH {_PROGRESS} SELECT last_block FROM progress ORDER BY version DESC LIMIT 1",
    "sync_throughput": f"""WITH {_PROGRESS} SELECT n AS n_ranges, micros / 1e6 AS total_seconds,
        micros / n / 1e6 AS avg_seconds FROM timed""",
    "sync_status": f"""WITH {_PROGRESS}, newest AS (SELECT * FROM progress ORDER BY version DESC LIMIT 1),
        checked AS (SELECT last_block, last_block >= (SELECT max(last_block) + 1 FROM progress) AS caught_up,
          (SELECT max(ended_at) FROM progress) + INTERVAL 30 SECOND - ended_at < INTERVAL 1 MINUTE
            AND ended_at > (SELECT min(started_at) FROM progress) AS active FROM newest)
        SELECT *, caught_up OR active AS healthy FROM checked""",
    "stream_standing": _STANDING_ROWS,
    "stream_active_votes": _ACTIVE_ROWS,
    "rewound_standing": _STANDING_ROWS,
    "raw_standing_wide": _WIDE_STANDING + " SELECT * FROM standing",
    "raw_standing_wide_windows": _WIDE_STANDING + " SELECT * FROM standing",
    "scores_wide": f"""{_WIDE_STANDING}
        SELECT CAST(c_custkey AS INTEGER) AS account_id, 'acct-' || c_custkey AS name, {_SCORE.format(r="s.reputation")} AS score
        FROM customer LEFT JOIN standing s ON s.account_id = c_custkey""",
    "live_standing": _STANDING_ROWS,
    "resumed_standing": _STANDING_ROWS,
    "block_limited_standing": _FIRST_HALF_STANDING + " SELECT * FROM standing",
    "committed_ranges": f"""WITH {_DENSE}, top AS (SELECT max(block_num) AS block FROM ops), step AS (
          SELECT CAST((block + 3) // 4 AS INTEGER) AS n, block FROM top), r AS (SELECT unnest(range(1, 5)) AS v),
        x AS (SELECT ops.*, (block_num - 1) // n + 1 AS v FROM ops, step),
        seen AS (SELECT *, lead(v) OVER (PARTITION BY author_id, voter_id, permlink ORDER BY source_op) AS next_v,
            (SELECT min(d.v) FROM x d WHERE NOT d.is_vote AND d.author_id = l.author_id AND d.permlink = l.permlink
              AND d.source_op > l.source_op) AS removed_v FROM x l WHERE is_vote),
        deleted AS (SELECT removed_v AS v, count(*) AS k FROM seen WHERE v < removed_v AND (next_v IS NULL OR next_v >= removed_v)
          GROUP BY 1),
        stored AS (SELECT v, count(*) AS k FROM seen WHERE (next_v IS NULL OR next_v > v) AND (removed_v IS NULL OR removed_v > v)
          GROUP BY 1)
        SELECT v AS version, CAST((v - 1) * n + 1 AS INTEGER) AS first_block,
          CAST(least(v * n, block) AS INTEGER) AS last_block,
          (SELECT max(source_op) FROM ops WHERE block_num <= v * n) AS last_op,
          coalesce((SELECT k FROM deleted WHERE deleted.v = r.v), 0) AS deleted_votes,
          coalesce((SELECT k FROM stored WHERE stored.v = r.v), 0) AS upserted_votes,
          (SELECT count(*) FROM x WHERE is_vote AND x.v = r.v) AS queued_votes
        FROM r, step""",
    "expected_diff_digests": f"WITH {_DUMPS} {_STRICT_DIFF}",
    "committed_diff": f"""{_STANDING}, edge AS (
          SELECT max(source_op) AS op FROM ops WHERE block_num <= (SELECT max(block_num) - max(block_num) // 10 FROM ops)),
        cut AS (SELECT max(step) AS step FROM folded, edge WHERE source_op <= op),
        early AS (SELECT DISTINCT a FROM folded, cut WHERE folded.step BETWEEN 1 AND cut.step AND (undone OR applied))
        SELECT CAST(a - 1 AS INTEGER) AS account_id FROM early,
          (SELECT rep AS r0 FROM folded, cut WHERE folded.step = cut.step), (SELECT rep AS r1 FROM folded ORDER BY step DESC LIMIT 1)
        WHERE r0[a] <> r1[a]""",
    "committed_account_score": f"""{_STANDING}
        SELECT 'acct-' || a.id AS name, {_SCORE.format(r="s.reputation")} AS score
        FROM (SELECT DISTINCT author_id AS id FROM ops) a LEFT JOIN standing s ON s.account_id = a.id""",
    "stored_accounts": "SELECT CAST(c_custkey AS INTEGER) AS id, 'acct-' || c_custkey AS name FROM customer WHERE c_acctbal >= 0",
    "block_window_scan": f"""WITH {_WIDE}, top AS (SELECT max(block_num) AS block FROM ops)
        SELECT source_op, block_num, CAST(op_type_id AS SMALLINT) AS op_type_id FROM ops, top
        WHERE block_num BETWEEN block // 2 AND block // 2 + block // 10""",
    "batch_permlinks": f"""WITH {_HALVES} SELECT permlink, count(*) AS n_votes FROM ops WHERE is_vote GROUP BY 1""",
}
