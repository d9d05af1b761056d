"""Oracle SQL for :mod:`skirmish.plans.estimates`; goes on from the prelude of :mod:`skirmish.plans.oracle`."""

#: Fixed values, written out so that the statements don't share the engine's.
DURATION_BOUNDS = (1500, 1800, 2100, 2400, 2700, 3000)
INCREMENTS = (1000, 2000, 3000, 5000, 7000, 10000)
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": "\"",
    "&#39;": "'",
    "&nbsp;": " ",
    "&amp;": "&",
}
THREATS = {
    "healing": ("heal", "lifesteal"),
    "control": ("stun", "slow", "silence"),
    "mobility": ("dash", "sprint"),
    "burst": ("burst", "critical"),
}
FUNCTIONS = {
    "debuff": ("healing reduction", "heal amp receive penalty", "anti-heal"),
    "headshots": ("headshot", "head shot"),
    "melee": ("melee", "heavy punch"),
    "crowd_control": ("stun", "immobil", "silence", "disarm", "knockdown", "slowpercent"),
    "mobility": ("move speed", "dash", "teleport", "leap", "sprint"),
    "healing": ("healing", "heal", "lifesteal", "health regen"),
    "utility": ("ally", "shield", "barrier", "cooldown", "active"),
}

_PATH = """, path_items AS (
  SELECT hero_id, item_id, any_value(cost) AS cost, count(*) / any_value(total) AS rate
  FROM first_purchases JOIN (SELECT hero_id, count(*) AS total FROM player_matches GROUP BY hero_id) USING (hero_id) GROUP BY hero_id, item_id HAVING count(*) >= 20
  QUALIFY row_number() OVER (PARTITION BY hero_id ORDER BY rate DESC, item_id) <= 8
), numbered AS (SELECT *, row_number() OVER (PARTITION BY hero_id ORDER BY item_id) - 1 AS b FROM path_items
), subsets AS (
  SELECT hero_id, s, product(CASE WHEN (s >> b) & 1 = 1 THEN rate ELSE 1 - rate END) AS p FROM numbered, range(256) AS r(s) GROUP BY hero_id, s
), paths AS (
  SELECT hero_id, path_cost, path_actions, tail FROM (SELECT hero_id, sum(cost) AS path_cost, count(*) AS path_actions FROM path_items GROUP BY hero_id)
  JOIN (SELECT hero_id, sum(p) FILTER (bit_count(s) >= 4) AS tail FROM subsets GROUP BY hero_id) USING (hero_id)
), coverage AS (
  SELECT m.hero_id, m.match_id, m.player_slot, m.duration_s, m.final_net_worth, coalesce(b.n, 0) AS bought, path_cost, path_actions, tail
  FROM player_matches m JOIN paths USING (hero_id)
  LEFT JOIN (SELECT match_id, player_slot, count(*) AS n FROM first_purchases SEMI JOIN path_items USING (hero_id, item_id) GROUP BY ALL) b USING (match_id, player_slot)
)"""

_BUCKETS = ", buckets AS (SELECT hero_id, tier, item_id, (own_net_worth_at_buy // 1000 * 1000)::BIGINT AS bucket, count(*) AS matches, sum(won::INTEGER) AS wins FROM first_purchases GROUP BY ALL)"

_PREDICTIONS = """, rates AS (SELECT hero_id, tier, item_id, phase, avg(won::INTEGER) AS p FROM decisions WHERE fold = 'train' GROUP BY ALL
), predictions AS (
  SELECT d.hero_id, d.tier, d.fold, floor(average_badge / 10)::INTEGER AS rank_family, year(start_time) AS patch, won::INTEGER AS y, p FROM decisions d JOIN rates USING (hero_id, tier, item_id, phase) WHERE fold <> 'train'
)"""


def _clean(column: str) -> str:
    text = column
    for entity, char in ENTITIES.items():
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({text}, '<[^>]*>', ' ', 'g'), '\\{{[^{{}}]*\\}}', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


def _tags(column: str) -> str:
    parts = []
    for name, phrases in THREATS.items():
        test = " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases)
        parts.append(f"CASE WHEN {test} THEN '{name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


_BOUND = "CASE " + " ".join(f"WHEN duration_s - 200 >= {b} THEN {n}" for n, b in sorted(enumerate(DURATION_BOUNDS, 1), reverse=True)) + " ELSE 0 END"

STATEMENTS: dict[str, str] = {
    "late_game_cohort": "SELECT hero_id, count(*) AS player_matches, avg(won::INTEGER) AS outcome_rate, median(duration_s) AS median_duration_s, quantile_cont(duration_s, 0.25) AS duration_q25_s, quantile_cont(duration_s, 0.75) AS duration_q75_s, median(final_net_worth) AS median_final_net_worth FROM player_matches WHERE final_net_worth >= 250000 GROUP BY hero_id",
    "late_game_items": "SELECT hero_id, item_id, count(*) AS buyer_matches, avg(won::INTEGER) AS outcome_rate, median(buy_time) AS median_buy_time_s, quantile_cont(buy_time, 0.25) AS buy_time_q25_s, quantile_cont(buy_time, 0.75) AS buy_time_q75_s, median(own_net_worth_at_buy) AS median_buy_net_worth, count(own_net_worth_at_buy) / count(*) AS valid_buy_nw_share FROM first_purchases WHERE final_net_worth >= 250000 GROUP BY hero_id, item_id",
    "late_capstones": """SELECT i.*, late_purchasers, buyer_matches / late_purchasers AS buyer_share FROM (
  SELECT hero_id, item_id, count(DISTINCT (match_id, player_slot)) AS buyer_matches, avg(won::INTEGER) AS observed_outcome_rate, median(buy_time) AS median_buy_time_s FROM first_purchases WHERE own_net_worth_at_buy >= 20000 GROUP BY ALL) i
JOIN (SELECT hero_id, count(DISTINCT (match_id, player_slot)) AS late_purchasers FROM first_purchases WHERE own_net_worth_at_buy >= 20000 GROUP BY hero_id) USING (hero_id)""",
    "core_economy_reference": """SELECT *, round_even(median_cost * (median_items - least(3, median_items - 1)) / median_items, 0) AS target_core_cost FROM (
  SELECT count(DISTINCT match_id) AS matches, count(*) AS player_matches, avg(duration_s) AS mean_duration_s, median(duration_s) AS median_duration_s, trunc(median(coalesce(n, 0)))::INTEGER AS median_items, trunc(median(coalesce(cost, 0)))::INTEGER AS median_cost
  FROM player_matches LEFT JOIN (SELECT match_id, player_slot, count(*) AS n, sum(cost) AS cost FROM purchases WHERE sold_time = 0 GROUP BY ALL) USING (match_id, player_slot) WHERE average_badge >= 81)""",
    "path_item_metrics": """, members AS (SELECT match_id, player_slot FROM first_purchases GROUP BY ALL HAVING count(*) >= 4)
SELECT hero_id, tier, item_id, adopter_matches, wins, purchase_events, hero_player_matches, adopter_matches / hero_player_matches AS adoption_rate, median_buy_time_s FROM (
  SELECT hero_id, tier, item_id, count(*) AS adopter_matches, sum(won::INTEGER)::BIGINT AS wins, median(buy_time) AS median_buy_time_s FROM first_purchases SEMI JOIN members USING (match_id, player_slot) GROUP BY ALL HAVING count(*) >= 20)
JOIN (SELECT hero_id, item_id, count(*) AS purchase_events FROM purchases SEMI JOIN members USING (match_id, player_slot) GROUP BY ALL) USING (hero_id, item_id)
JOIN (SELECT hero_id, count(*) AS hero_player_matches FROM player_matches SEMI JOIN members USING (match_id, player_slot) GROUP BY ALL) USING (hero_id)""",
    "early_inventories": "SELECT match_id, player_slot, string_agg(item_id::VARCHAR, ',' ORDER BY buy_time, item_id) AS items FROM first_purchases WHERE own_net_worth_at_buy <= 12000 GROUP BY ALL",
    "itemset_support_2": """SELECT a.hero_id, a.item_id || ',' || b.item_id AS itemset, count(*) AS support, count(*) FILTER (a.fold = 'train') AS train_support, count(*) FILTER (a.fold = 'validation') AS validation_support, count(*) FILTER (a.fold = 'test') AS test_support
FROM first_purchases a JOIN first_purchases b ON a.match_id = b.match_id AND a.player_slot = b.player_slot AND a.item_id < b.item_id WHERE a.sold_time = 0 AND b.sold_time = 0 GROUP BY a.hero_id, a.item_id, b.item_id HAVING count(*) >= 20""",
    "itemset_support_3": """SELECT a.hero_id, a.item_id || ',' || b.item_id || ',' || c.item_id AS itemset, count(*) AS support, count(*) FILTER (a.fold = 'train') AS train_support, count(*) FILTER (a.fold = 'validation') AS validation_support, count(*) FILTER (a.fold = 'test') AS test_support
FROM first_purchases a JOIN first_purchases b ON a.match_id = b.match_id AND a.player_slot = b.player_slot AND a.item_id < b.item_id JOIN first_purchases c ON a.match_id = c.match_id AND a.player_slot = c.player_slot AND b.item_id < c.item_id
WHERE a.sold_time = 0 AND b.sold_time = 0 AND c.sold_time = 0 GROUP BY a.hero_id, a.item_id, b.item_id, c.item_id HAVING count(*) >= 5""",
    "decision_rollups": """SELECT hero_id, tier, phase, grouping(hero_id, tier, phase)::INTEGER AS level, count(*) AS decisions, count(DISTINCT match_id) AS matches, avg(won::INTEGER) AS outcome_rate,
  count(own_net_worth_at_buy) / count(*) AS known_share, avg(buy_time) AS mean_buy_time_s, count(DISTINCT item_id) AS items
FROM decisions GROUP BY GROUPING SETS ((hero_id, tier), (hero_id, phase), (tier, phase), (hero_id), (tier), (phase), ())""",
    "itemset_levels": """SELECT * FROM (
  WITH RECURSIVE held AS (
    SELECT match_id, player_slot, hero_id, fold, item_id FROM first_purchases WHERE sold_time = 0
  ), grown AS (
    SELECT match_id, player_slot, hero_id, fold, 1 AS size, item_id AS last, item_id::VARCHAR AS itemset FROM held
    UNION ALL
    SELECT g.match_id, g.player_slot, g.hero_id, g.fold, g.size + 1, h.item_id, g.itemset || ',' || h.item_id
    FROM grown g JOIN held h ON h.match_id = g.match_id AND h.player_slot = g.player_slot AND h.item_id > g.last WHERE g.size < 4
  )
  SELECT hero_id, size, itemset, count(*) AS support, count(*) FILTER (fold = 'train') AS train_support, count(*) FILTER (fold = 'validation') AS validation_support, count(*) FILTER (fold = 'test') AS test_support
  FROM grown GROUP BY hero_id, size, itemset HAVING count(*) >= 5)""",
    "pair_precedence": "SELECT a.hero_id, a.item_id AS first_item, b.item_id AS second_item, count(*) FILTER (a.buy_time < b.buy_time) AS first_earlier, count(*) FILTER (a.buy_time > b.buy_time) AS second_earlier FROM first_purchases a JOIN first_purchases b ON a.match_id = b.match_id AND a.player_slot = b.player_slot AND a.item_id < b.item_id GROUP BY ALL",
    "path_coherence": _PATH + """ SELECT hero_id, count(*) AS player_matches, avg(bought / path_actions) AS mean_path_coverage, avg((bought >= 2)::INTEGER) AS share_with_2, avg((bought >= 4)::INTEGER) AS share_with_4, avg((bought = path_actions)::INTEGER) AS share_complete,
  median(bought) AS median_path_items, quantile_cont(bought, 0.75) AS path_items_q75, any_value(tail) AS independent_share_with_4, avg((bought >= 4)::INTEGER) / any_value(tail) AS coherence_lift, count(*) FILTER (duration_s >= 2100) AS long_matches,
  avg((bought >= 2)::INTEGER) FILTER (duration_s >= 2100) AS long_match_share, count(*) FILTER (final_net_worth >= path_cost) AS affordable_matches, avg((bought >= 2)::INTEGER) FILTER (final_net_worth >= path_cost) AS affordable_share FROM coverage GROUP BY hero_id""",
    "path_coherence_by_fold": _PATH + " SELECT hero_id, fold, count(*) AS player_matches, avg(bought / path_actions) AS mean_path_coverage, avg((bought >= 2)::INTEGER) AS share_with_2, avg((bought >= 4)::INTEGER) AS share_with_4, avg((bought = path_actions)::INTEGER) AS share_complete FROM coverage JOIN match_folds USING (match_id) GROUP BY hero_id, fold",
    "hazard_incidence": """, terminal AS (
  SELECT m.hero_id, coalesce(b.t, m.duration_s) AS time_s, b.t IS NOT NULL AS event FROM player_matches m LEFT JOIN (SELECT match_id, player_slot, min(buy_time) AS t FROM first_purchases WHERE tier = 4 GROUP BY ALL) b USING (match_id, player_slot)
), by_time AS (SELECT hero_id, time_s, count(*) AS d, count(*) FILTER (event) AS purchases FROM terminal GROUP BY ALL
), risk AS (SELECT *, sum(d) OVER (PARTITION BY hero_id ORDER BY time_s DESC) AS at_risk FROM by_time
), alive AS (SELECT *, coalesce(exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) END) OVER (PARTITION BY hero_id ORDER BY time_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS s FROM risk)
SELECT hero_id, time_s, at_risk::BIGINT AS at_risk, purchases, d - purchases AS competing_events, purchases / at_risk AS cause_specific_hazard, sum(s * purchases / at_risk) OVER (PARTITION BY hero_id ORDER BY time_s) AS cumulative_incidence FROM alive""",
    "landmarks": """SELECT hero_id, landmark_s, n AS at_risk, w::BIGINT AS wins, r AS estimate, (r + z / (2 * n) - m) / (1 + z / n) AS interval_low, (r + z / (2 * n) + m) / (1 + z / n) AS interval_high FROM (
  SELECT *, 1.96 * sqrt(r * (1 - r) / n + z / (4 * n * n)) AS m FROM (
    SELECT hero_id, l::INTEGER AS landmark_s, count(*) AS n, sum(won::INTEGER) AS w, avg(won::INTEGER) AS r, 1.96 * 1.96 AS z FROM player_matches, (VALUES (1500), (1800), (2400), (3000), (3600)) v(l) WHERE duration_s >= l GROUP BY ALL))""",
    "purchase_prefixes": """, ordered AS (SELECT hero_id, match_id, player_slot, item_id, row_number() OVER (PARTITION BY match_id, player_slot ORDER BY buy_time, item_id) AS position FROM first_purchases
), walked AS (
  SELECT hero_id, position, item_id AS next, coalesce(string_agg(item_id::VARCHAR, ',') OVER (PARTITION BY match_id, player_slot ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prefix FROM ordered
), counts AS (SELECT hero_id, position::INTEGER AS position, prefix, next, count(*) AS n FROM walked WHERE position <= 3 GROUP BY ALL)
SELECT *, (sum(n) OVER (PARTITION BY hero_id, prefix))::BIGINT AS reached, n / sum(n) OVER (PARTITION BY hero_id, prefix) AS probability FROM counts""",
    "duration_profile": f""", phased AS (
  SELECT hero_id, count(DISTINCT b) AS buckets, count(*) FILTER (b < 2) AS early_matches, count(*) FILTER (b BETWEEN 2 AND 4) AS mid_matches, count(*) FILTER (b > 4) AS late_matches,
    avg(won::INTEGER) FILTER (b < 2) AS e, avg(won::INTEGER) FILTER (b BETWEEN 2 AND 4) AS m, avg(won::INTEGER) FILTER (b > 4) AS l FROM (SELECT *, {_BOUND} AS b FROM player_matches) GROUP BY hero_id
) SELECT hero_id, early_matches, mid_matches, late_matches, CASE WHEN greatest(e, m, l) - least(e, m, l) < 0.015 THEN 'STABLE' WHEN m >= greatest(e, l) + 0.01 THEN 'MIDGAME_PEAK' WHEN l >= e + 0.02 THEN 'LATE_SCALING' WHEN e >= l + 0.02 THEN 'EARLY_CLOSER' ELSE 'MIXED' END AS shape,
  round(100 * (l - e), 2) AS early_to_late_delta FROM phased WHERE buckets = 7 AND least(early_matches, mid_matches, late_matches) >= 50""",
    "purchase_windows": _BUCKETS + f""", known AS (SELECT * FROM buckets WHERE bucket IS NOT NULL
), grouped AS (SELECT hero_id, tier, item_id, i AS increment, bucket // i * i AS start, sum(matches) AS matches, sum(wins) AS wins FROM known, (VALUES {", ".join(f"({i})" for i in INCREMENTS)}) v(i) GROUP BY ALL
), tried AS (SELECT hero_id, tier, item_id, increment, sum(matches) AS total, avg(matches) / sum(matches) >= CASE WHEN sum(matches) > 200 THEN 0.1 ELSE 0.15 END AS fits FROM grouped GROUP BY ALL
), chosen AS (SELECT hero_id, tier, item_id, coalesce(min(increment) FILTER (fits), 10000) AS increment, any_value(total) AS total FROM tried GROUP BY ALL
), kept AS (SELECT g.*, sum(matches) OVER (PARTITION BY hero_id, tier, item_id ORDER BY start) AS run, sum(matches) OVER (PARTITION BY hero_id, tier, item_id) AS eligible FROM grouped g JOIN chosen USING (hero_id, tier, item_id, increment) WHERE matches >= greatest(20, ceil(total * 0.05))
), windows AS (SELECT hero_id, tier, item_id, increment, min(start) AS a, max(start + increment) AS z, sum(matches) AS n, sum(wins) AS w FROM kept WHERE run >= 0.25 * eligible AND run - matches < 0.75 * eligible GROUP BY hero_id, tier, item_id, increment)
SELECT hero_id, tier, item_id, increment::INTEGER AS increment, a::BIGINT AS bucket_start, z::BIGINT AS bucket_end, n::BIGINT AS matches, w::BIGINT AS wins, w / n AS observed_outcome_rate,
  (w / n + 3.8416 / (2 * n) - 1.96 * sqrt(w / n * (1 - w / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n) AS wilson_lower FROM windows""",
    "tier_horizons": _BUCKETS + """, totals AS (SELECT hero_id, tier, bucket, sum(matches) AS w FROM buckets WHERE bucket IS NOT NULL GROUP BY ALL
), running AS (SELECT *, sum(w) OVER (PARTITION BY hero_id, tier ORDER BY bucket) AS r, sum(w) OVER (PARTITION BY hero_id, tier) AS t FROM totals)
SELECT hero_id, tier, (ceil((min(bucket) + 500) * 2 / 1000) * 1000)::BIGINT AS horizon FROM running WHERE r >= t / 2 GROUP BY hero_id, tier""",
    "calibration_report": _PREDICTIONS + """, sliced AS (
  SELECT unnest(['overall', 'hero=' || hero_id, 'rank=' || rank_family, 'patch=' || patch, 'tier=' || tier]) AS slice, y, p FROM predictions WHERE fold = 'test'
), binned AS (SELECT slice, abs(sum(p) - sum(y)) AS gap FROM sliced GROUP BY slice, least(floor(p * 10), 9)
), gaps AS (SELECT slice, sum(gap) AS gap FROM binned GROUP BY slice)
SELECT slice, count(*) AS support, avg((p - y) ** 2) AS brier, avg(-(y * ln(greatest(p, 1e-15)) + (1 - y) * ln(greatest(1 - p, 1e-15)))) AS log_loss, any_value(gap) / count(*) AS expected_calibration_error,
  avg((greatest(p, 1 - p) >= 0.52)::INTEGER) AS coverage, avg(((p >= 0.5) <> (y = 1))::INTEGER) FILTER (greatest(p, 1 - p) >= 0.52) AS selective_risk FROM sliced JOIN gaps USING (slice) GROUP BY slice""",
    "abstention_threshold": _PREDICTIONS + """ SELECT threshold, n / total AS coverage, risk AS selective_risk FROM (
  SELECT t::DOUBLE AS threshold, count(*) AS n, avg(((p >= 0.5) <> (y = 1))::INTEGER) AS risk FROM predictions, (VALUES (0.5), (0.51), (0.52), (0.55), (0.6)) v(t) WHERE fold = 'validation' AND greatest(p, 1 - p) >= t GROUP BY t),
  (SELECT count(*) AS total FROM predictions WHERE fold = 'validation') WHERE risk <= 0.6 ORDER BY n DESC, threshold LIMIT 1""",
    "off_policy": """, cells AS (SELECT hero_id, phase, tier, item_id, count(*) AS n, avg(won::INTEGER) AS rate FROM decisions GROUP BY ALL
), strata AS (SELECT hero_id, phase, tier, sum(n) AS total, count(*) AS width, avg(rate) AS model FROM cells GROUP BY ALL
), weighed AS (SELECT d.hero_id, d.won::INTEGER AS y, (1 / width) / (n / total) AS w, model, rate FROM decisions d JOIN cells USING (hero_id, phase, tier, item_id) JOIN strata USING (hero_id, phase, tier))
SELECT hero_id, count(*) AS support, true AS supported, 1.0::DOUBLE AS overlap, avg(w * y) AS ips, sum(w * y) / sum(w) AS snips, avg(model + w * (y - rate)) AS dr, avg(least(w, 5) * y) AS ips_clip_5, avg(model + least(w, 5) * (y - rate)) AS dr_clip_5,
  sum(w) ** 2 / sum(w ** 2) AS effective_sample_size, max(w) AS maximum_weight FROM weighed GROUP BY hero_id""",
    "group_leakage": """SELECT kind, count(*) AS members, count(*) FILTER (folds > 1) AS leaking FROM (
  SELECT 'match_group' AS kind, match_id AS member, count(DISTINCT fold) AS folds FROM admitted JOIN match_folds USING (match_id) GROUP BY match_id
  UNION ALL SELECT 'player_group', account_id, count(DISTINCT fold) FROM admitted JOIN match_folds USING (match_id) GROUP BY account_id) GROUP BY kind""",
    "select_then_estimate": """, effects AS (SELECT fold, hero_id, tier, item_id, count(*) AS observations, avg(won::INTEGER) AS estimate FROM decisions GROUP BY ALL HAVING count(*) >= 20)
SELECT t.hero_id, t.tier, t.item_id, t.observations, t.estimate FROM effects t JOIN (SELECT DISTINCT ON (hero_id, tier) hero_id, tier, item_id FROM effects WHERE fold = 'train' ORDER BY hero_id, tier, estimate DESC, observations DESC, item_id) USING (hero_id, tier, item_id) WHERE t.fold = 'test'""",
    "monitoring_decision": """, daily AS (
  SELECT start_time::DATE::VARCHAR AS day, count(*) AS exposures, count(*) FILTER (calibration) AS unhandled, avg((final_net_worth < 20000)::INTEGER) AS invalid, abs(avg(won::INTEGER) - 0.5) AS error, max(hero_id) / 5 AS concentration, count(*) FILTER (duration_s > 3890) > 0 AS long FROM player_matches GROUP BY ALL
), reasons AS (
  SELECT day, concat_ws('; ', CASE WHEN error > 0.1 THEN 'material calibration failure' END, CASE WHEN exposures >= 36 THEN 'user-data preservation changed' END) AS rollback, CASE WHEN long THEN 'snapshot freshness exceeded' ELSE '' END AS refuse,
    concat_ws('; ', CASE WHEN invalid > 0.01 THEN 'invalid-state rate exceeded' END, CASE WHEN unhandled / exposures > 0.01 THEN 'unhandled-branch rate exceeded' END, CASE WHEN concentration > 0.8 THEN 'recommendation concentration exceeded' END) AS alert FROM daily)
SELECT day, CASE WHEN rollback <> '' THEN 'rollback' WHEN refuse <> '' THEN 'refuse' WHEN alert <> '' THEN 'alert' ELSE 'healthy' END AS action,
  CASE WHEN rollback <> '' THEN rollback || '; no last compatible policy is available' WHEN refuse <> '' THEN refuse ELSE alert END AS reasons FROM reasons""",
    "net_worth_validity": """, raw AS (
  SELECT buy_time, final_net_worth, CASE WHEN buy_time < 180 AND item_id % 3 = 0 THEN final_net_worth ELSE coalesce(own_net_worth_at_buy, 0) END AS reported, buy_time * 10.0 AS earlier, buy_time - item_id * 4 AS earlier_time FROM purchases
), judged AS (
  SELECT *, CASE WHEN buy_time >= 180 THEN 'reported' WHEN reported = final_net_worth THEN 'corrupt' WHEN earlier_time BETWEEN 0 AND buy_time AND buy_time - earlier_time <= 60 THEN 'preceding' ELSE 'unknown' END AS status FROM raw
) SELECT status AS net_worth_status, count(*) AS n, count(CASE status WHEN 'reported' THEN reported WHEN 'preceding' THEN earlier END) AS known, sum(CASE status WHEN 'reported' THEN reported WHEN 'preceding' THEN earlier END)::DOUBLE AS total FROM judged GROUP BY status""",
    "affinity_scores": """SELECT hero_id, item_id, (CASE WHEN (length(slot) + hero_id) % 2 = 0 THEN CASE slot WHEN 'weapon' THEN 3 ELSE 2 END ELSE 0 END + CASE WHEN active AND (6 + hero_id) % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS affinity
FROM item_assets, (SELECT DISTINCT hero_id FROM player_matches)""",
    "category_bonuses": """SELECT hero_id, slot, threshold, count(*) AS n, avg(buy_time) AS mean_buy_time_s FROM (
  SELECT *, sum(cost) OVER (PARTITION BY match_id, player_slot, slot ORDER BY event_order ROWS UNBOUNDED PRECEDING) AS spend FROM purchases) p
JOIN (VALUES (800), (1600), (4800), (9600)) v(threshold) ON threshold > spend - cost AND threshold <= spend GROUP BY ALL""",
}

#: Over the driver's tables themselves.
PLAIN: dict[str, str] = {
    "asof_events": """SELECT p.event_id, p.user_id, p.value, v.event_id AS seen_id, v.value AS seen_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "clean_text": f"SELECT page_id, {_clean('html')} AS text FROM pages",
    "threat_tags": f"SELECT p_partkey, {_tags('p_name')} AS threats, lower(trim(p_type)) NOT IN ('', '0', '-1', '-2', 'false', 'small') AS effective FROM part",
    "outcome_eligibility": """SELECT o_orderpriority, count(*) AS n,
  count(*) FILTER (o_orderstatus <> 'P' AND o_custkey % 11 <> 0 AND o_custkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_custkey % 97 <> 0 AND o_orderpriority <> '5-LOW' AND o_custkey % 19 <> 0) AS eligible,
  count(*) FILTER (o_orderstatus <> 'P' AND o_orderkey % 17 <> 0) AS eligible_leniently FROM orders GROUP BY o_orderpriority""",
    "feature_leakage": """SELECT l_returnflag, CASE WHEN l_linenumber = 7 THEN 'leaks' WHEN observed > l_orderkey % 2500 THEN 'not yet available' WHEN l_linenumber = 6 THEN 'invalid staleness'
  WHEN l_orderkey % 2500 - observed > 400 THEN 'stale' ELSE 'usable' END AS reason, count(*) AS n FROM (SELECT *, l_shipdate::DATE - DATE '1992-01-01' AS observed FROM lineitem) GROUP BY ALL""",
    "order_states": "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' WHEN 'P' THEN 'partial' END AS state, count(*) AS n FROM orders GROUP BY ALL",
    "window_labels": "SELECT o_orderkey, (floor(o_totalprice::DOUBLE / 1000 + 0.5) * 1000)::BIGINT AS souls, printf('%d:%02d', o_orderkey % 5400 // 60, o_orderkey % 60) AS clock FROM orders",
    "content_hashes": r"SELECT page_id, sha256(regexp_replace(coalesce(url, ''), '(//)(?:m|www|blog)[.]', '\1', 'g') || chr(10) || regexp_replace(coalesce(html, ''), '(//)(?:m|www|blog)[.]', '\1', 'g')) AS content_sha256 FROM pages",
    "item_functions": f"SELECT page_id, CASE {' '.join('WHEN ' + ' OR '.join(f"contains(lower(html), '{t}')" for t in terms) + f" THEN '{name}'" for name, terms in FUNCTIONS.items())} ELSE 'damage' END AS function FROM pages",
}
