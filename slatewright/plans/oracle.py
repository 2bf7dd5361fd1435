"""DuckDB SQL for the queries, put together from shared views.  Where an operator has a
second formulation the SQL takes that one: inequality self-joins for windows, counted
pairs for rank sums, a recursive query for the greedy fold."""

from __future__ import annotations

from ..config import COMPONENTS, FeedConfig, ablation, policies

AS_OF = 1704844800000000
C = FeedConfig()
CATALOG = """catalog AS (
  SELECT 'd' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS id, [coalesce(d.lang, 'und'), 't' || CAST(d.doc_id % 7 AS VARCHAR)] AS topics, d.source,
         1703462400000000 + (d.doc_id * 7919) % 888 * 3600000000 AS published_us, coalesce(CAST(0.25 AS DOUBLE) + CAST(0.5 AS DOUBLE) * l.quality, CAST(0.5 AS DOUBLE)) AS quality,
         least(CAST(1 AS DOUBLE), d.n_chars / CAST(20000 AS DOUBLE)) AS popularity
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
EVENTS = """interactions AS (
  SELECT event_id, 'u' || CAST(user_id AS VARCHAR) AS user_id, 'd' || lpad(regexp_extract(props, '([0-9]+)', 1), 12, '0') AS article_id,
         CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'hide' ELSE event_type END AS kind, epoch_us(ts) AS occurred_us,
         least(CAST(1 AS DOUBLE), greatest(CAST(0.05 AS DOUBLE), value / CAST(500 AS DOUBLE))) AS propensity, CAST(1 AS DOUBLE) AS weight
  FROM events WHERE event_type <> 'signup')"""
IMPRESSIONS = """lines AS (
  SELECT l_orderkey, l_partkey, min(l_linenumber) AS line, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS clicked, max(l_discount) AS score FROM lineitem GROUP BY l_orderkey, l_partkey),
impressions AS (
  SELECT l_orderkey AS impression_id, o_custkey AS user_id, epoch_us(o_orderdate) AS occurred_us, l_partkey AS article_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY line, l_partkey) AS pos, clicked, score
  FROM lines JOIN orders ON o_orderkey = l_orderkey)"""
MIXED = "mixed AS (SELECT i.* FROM impressions i JOIN (SELECT impression_id FROM impressions GROUP BY impression_id HAVING min(clicked) < max(clicked)) g USING (impression_id))"
COHORTS = "cohorts AS (SELECT DISTINCT user_id, 'c' || CAST(CAST(substr(user_id, 2) AS BIGINT) % 3 AS VARCHAR) AS cohort FROM interactions)"
SIGNAL = "CASE kind WHEN 'view' THEN CAST(0.2 AS DOUBLE) WHEN 'click' THEN CAST(0.7 AS DOUBLE) WHEN 'like' THEN CAST(1 AS DOUBLE) WHEN 'hide' THEN CAST(-1.2 AS DOUBLE) END"


def lit(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def profile_views(at: str = str(AS_OF)) -> str:
    """Views of everything a feed at one time needs."""
    return f"""visible AS (SELECT e.*, c.topics FROM interactions e JOIN catalog c ON c.id = e.article_id WHERE e.occurred_us <= {at} AND c.published_us <= {at}),
shares AS (SELECT user_id, unnest(topics) AS topic, ({SIGNAL}) * weight * exp(-(ln(CAST(2 AS DOUBLE)) * (({at} - occurred_us) / CAST(86400000000 AS DOUBLE)) / CAST(30 AS DOUBLE))) / len(topics) AS share FROM visible),
totals AS (SELECT user_id, topic, sum(share) AS total FROM shares GROUP BY user_id, topic),
weights AS (SELECT user_id, topic, total / max(abs(total)) OVER (PARTITION BY user_id) AS weight FROM totals),
readers AS (SELECT user_id, topic, weight FROM weights WHERE weight <> 0)"""


def score_views(config: FeedConfig = C) -> str:
    w = config.weights()
    total = " + ".join(f"{c} * {lit(w[c])}" for c in COMPONENTS)
    return f"""users AS (SELECT user_id, count(*) AS event_count FROM visible GROUP BY user_id),
seen AS (SELECT DISTINCT user_id, article_id AS id FROM visible),
pairs AS (SELECT u.user_id, u.event_count, c.* FROM users u, catalog c WHERE c.published_us <= {AS_OF} AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.id = c.id)),
known AS (SELECT user_id, list(topic ORDER BY topic) AS rt, list(weight ORDER BY topic) AS rw FROM readers GROUP BY user_id),
topical AS (SELECT p.*, coalesce(list_sum(list_transform(p.topics, lambda t: coalesce(k.rw[list_position(k.rt, t)], CAST(0 AS DOUBLE)))), 0) / len(p.topics) AS raw FROM pairs p LEFT JOIN known k ON k.user_id = p.user_id),
parts AS (SELECT p.*, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (p.raw + 1) / 2)) AS interest, exp(-(ln(CAST(2 AS DOUBLE)) * (({AS_OF} - published_us) / CAST(3600000000 AS DOUBLE)) / CAST(72 AS DOUBLE))) AS freshness,
  CAST(1 AS DOUBLE) AS novelty, CAST(CAST('0x' || substr(sha256(p.user_id || chr(0) || p.id), 1, 16) AS UBIGINT) AS DOUBLE) / CAST(18446744073709551616 AS DOUBLE) AS exploration
  FROM topical p),
scored AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ({total}) / {lit(sum(w.values()))})) AS total FROM parts)"""


def slate_views(source: str = "scored", size: int = 10, cap: int = 2, lam: float = 0.78) -> str:
    """Greedy slates, one pick of every user a step."""
    red = f"coalesce(list_max(list_transform(s.tops, lambda t: len(list_intersect(t, c.topics)) / CAST(len(list_distinct(list_concat(t, c.topics))) AS DOUBLE))), CAST(0 AS DOUBLE))"
    return f"""slates AS (
  SELECT user_id, 0 AS step, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[][]) AS tops, CAST([] AS VARCHAR[]) AS sources, CAST([] AS DOUBLE[]) AS scores FROM (SELECT DISTINCT user_id FROM {source}) u
  UNION ALL
  SELECT user_id, step + 1, list_append(ids, id), list_append(tops, topics), list_append(sources, source), list_append(scores, total) FROM (
    SELECT s.user_id, s.step, s.ids, s.tops, s.sources, s.scores, c.id, c.topics, c.source, c.total,
           row_number() OVER (PARTITION BY s.user_id ORDER BY {lit(lam)} * c.total - {lit(1 - lam)} * {red} DESC, c.total DESC, c.id DESC) AS n
    FROM slates s JOIN {source} c ON c.user_id = s.user_id
    WHERE s.step < {size} AND NOT list_contains(s.ids, c.id) AND len(list_filter(s.sources, lambda x: x = c.source)) < {cap}) picks WHERE n = 1),
final AS (SELECT s.* FROM slates s JOIN (SELECT user_id, max(step) AS step FROM slates GROUP BY user_id) m ON m.user_id = s.user_id AND m.step = s.step)"""


def calibrated_views(size: int = 10, cap: int = 2, weight: float = 0.5) -> str:
    """Greedy slates by relevance less divergence; mass runs along the reader's topics."""
    share = "(CASE WHEN list_contains(c.topics, s.rt[j]) THEN 1 / CAST(len(c.topics) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    kl = f"greatest(CAST(0 AS DOUBLE), coalesce(list_sum(list_transform(range(1, len(s.rt) + 1), lambda j: s.rs[j] * ln(s.rs[j] / ({lit(0.99)} * ((s.mass[j] + {share}) / (s.step + 1)) + {lit(0.01)} * s.rs[j])))), 0))"
    grown = "list_transform(range(1, len(rt) + 1), lambda j: mass[j] + CASE WHEN list_contains(topics, rt[j]) THEN 1 / CAST(len(topics) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    return f"""positive AS (SELECT user_id, topic, weight / sum(weight) OVER (PARTITION BY user_id) AS share FROM readers WHERE weight > 0),
tastes AS (SELECT u.user_id, coalesce(t.rt, CAST([] AS VARCHAR[])) AS rt, coalesce(t.rs, CAST([] AS DOUBLE[])) AS rs FROM users u LEFT JOIN (SELECT user_id, list(topic ORDER BY topic) AS rt, list(share ORDER BY topic) AS rs FROM positive GROUP BY user_id) t ON t.user_id = u.user_id),
slates AS (
  SELECT user_id, 0 AS step, rt, rs, list_transform(rs, lambda x: CAST(0 AS DOUBLE)) AS mass, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS sources, CAST([] AS DOUBLE[]) AS scores FROM tastes
  UNION ALL
  SELECT user_id, step + 1, rt, rs, {grown}, list_append(ids, id), list_append(sources, source), list_append(scores, total) FROM (
    SELECT s.user_id, s.step, s.rt, s.rs, s.mass, s.ids, s.sources, s.scores, c.id, c.topics, c.source, c.total,
           row_number() OVER (PARTITION BY s.user_id ORDER BY {lit(1 - weight)} * c.total - {lit(weight)} * {kl} DESC, c.total DESC, c.id DESC) AS n
    FROM slates s JOIN scored c ON c.user_id = s.user_id
    WHERE s.step < {size} AND NOT list_contains(s.ids, c.id) AND len(list_filter(s.sources, lambda x: x = c.source)) < {cap}) picks WHERE n = 1),
final AS (SELECT s.* FROM slates s JOIN (SELECT user_id, max(step) AS step FROM slates GROUP BY user_id) m ON m.user_id = s.user_id AND m.step = s.step)"""


def loo_views(config: FeedConfig = C) -> str:
    """Leave-last-out: holdouts, strict histories and scores as of each holdout."""
    w = config.weights()
    total = " + ".join(f"{c} * {lit(w[c])}" for c in COMPONENTS)
    return f"""positives AS (SELECT e.* FROM interactions e JOIN catalog c ON c.id = e.article_id WHERE kind IN ('click', 'like') AND occurred_us <= {AS_OF}),
holdouts AS (SELECT user_id, article_id AS holdout_id, occurred_us AS holdout_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_us DESC, article_id DESC) AS n FROM positives) p WHERE n = 1),
past AS (SELECT e.*, c.topics, h.holdout_us FROM interactions e JOIN holdouts h ON h.user_id = e.user_id JOIN catalog c ON c.id = e.article_id WHERE e.occurred_us < h.holdout_us AND c.published_us <= h.holdout_us),
shares AS (SELECT user_id, unnest(topics) AS topic, ({SIGNAL}) * weight * exp(-(ln(CAST(2 AS DOUBLE)) * ((holdout_us - occurred_us) / CAST(86400000000 AS DOUBLE)) / CAST(30 AS DOUBLE))) / len(topics) AS share FROM past),
totals AS (SELECT user_id, topic, sum(share) AS total FROM shares GROUP BY user_id, topic),
readers AS (SELECT user_id, topic, total / max(abs(total)) OVER (PARTITION BY user_id) AS weight FROM totals),
pairs AS (SELECT h.user_id, h.holdout_us, c.* FROM holdouts h, catalog c WHERE c.published_us <= h.holdout_us AND NOT EXISTS (SELECT 1 FROM past s WHERE s.user_id = h.user_id AND s.article_id = c.id)),
known AS (SELECT user_id, list(topic ORDER BY topic) AS rt, list(weight ORDER BY topic) AS rw FROM readers GROUP BY user_id),
topical AS (SELECT p.*, coalesce(list_sum(list_transform(p.topics, lambda t: coalesce(k.rw[list_position(k.rt, t)], CAST(0 AS DOUBLE)))), 0) / len(p.topics) AS raw FROM pairs p LEFT JOIN known k ON k.user_id = p.user_id),
parts AS (SELECT p.*, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (p.raw + 1) / 2)) AS interest, exp(-(ln(CAST(2 AS DOUBLE)) * ((p.holdout_us - published_us) / CAST(3600000000 AS DOUBLE)) / CAST(72 AS DOUBLE))) AS freshness,
  CAST(1 AS DOUBLE) AS novelty, CAST(CAST('0x' || substr(sha256(p.user_id || chr(0) || p.id), 1, 16) AS UBIGINT) AS DOUBLE) / CAST(18446744073709551616 AS DOUBLE) AS exploration
  FROM topical p),
scored AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ({total}) / {lit(sum(w.values()))})) AS total FROM parts),
{slate_views("scored", config.size, config.max_per_source, config.mmr_lambda)},
positive AS (SELECT user_id, topic, weight / sum(weight) OVER (PARTITION BY user_id) AS share FROM readers WHERE weight > 0),
mass AS (SELECT user_id, topic, sum(CAST(0.5 AS DOUBLE)) / max(n) AS q FROM (SELECT user_id, unnest(flatten(tops)) AS topic, CAST(len(ids) AS DOUBLE) AS n FROM final WHERE len(ids) > 0) x GROUP BY user_id, topic),
calibrations AS (SELECT p.user_id, greatest(CAST(0 AS DOUBLE), sum(p.share * ln(p.share / (CAST(0.99 AS DOUBLE) * coalesce(m.q, 0) + CAST(0.01 AS DOUBLE) * p.share)))) AS topic_calibration FROM positive p JOIN (SELECT user_id FROM final WHERE len(ids) > 0) f ON f.user_id = p.user_id LEFT JOIN mass m ON m.user_id = p.user_id AND m.topic = p.topic GROUP BY p.user_id),
places AS (SELECT h.user_id, h.holdout_id, h.holdout_us, coalesce(f.ids, CAST([] AS VARCHAR[])) AS ids, f.tops, f.sources, CASE WHEN list_contains(f.ids, h.holdout_id) THEN list_position(f.ids, h.holdout_id) END AS place FROM holdouts h LEFT JOIN final f ON f.user_id = h.user_id),
spread AS (SELECT user_id, avg(1 - len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE)) AS ild FROM (
  SELECT p.user_id, p.tops[i.i] AS a, p.tops[j.i] AS b FROM places p, range(1, 11) i(i), range(1, 11) j(i) WHERE i.i < j.i AND j.i <= len(p.ids)) x GROUP BY user_id),
samples AS (SELECT p.*, coalesce(1 / log2(CAST(place + 1 AS DOUBLE)), 0) AS ndcg, CASE WHEN place IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS hit_rate, coalesce(1 / CAST(place AS DOUBLE), 0) AS reciprocal_rank,
  coalesce(s.ild, 0) AS intra_list_diversity, CASE WHEN len(ids) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_distinct(sources)) / CAST(len(ids) AS DOUBLE) END AS source_diversity, k.topic_calibration FROM places p LEFT JOIN spread s ON s.user_id = p.user_id LEFT JOIN calibrations k ON k.user_id = p.user_id)"""


MEANS = ("ndcg", "hit_rate", "reciprocal_rank", "intra_list_diversity", "source_diversity")
AVERAGES = ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEANS)


def q(body: str, *views: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(views) + "\n" + body


FEED = (CATALOG, EVENTS, profile_views(), score_views())
LOO = (CATALOG, EVENTS, loo_views())
TERMS = "terms AS (SELECT doc_id AS id, token AS feature, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+')) AS token FROM documents) t GROUP BY doc_id, token)"
VOCABULARY = "vocabulary AS (SELECT feature, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM terms GROUP BY feature ORDER BY count(*) DESC, feature LIMIT 500)"
TEXT = (TERMS, VOCABULARY)
VECTORS = "tfidf AS (SELECT t.id, t.feature, (1 + ln(CAST(t.n AS DOUBLE))) * v.idf AS w FROM terms t JOIN vocabulary v ON v.feature = t.feature), vectors AS (SELECT id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM tfidf)"
LOGGED = "logged AS (SELECT user_id, CASE WHEN kind IN ('click', 'like') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS reward, propensity, (SELECT min(propensity) FROM interactions) / propensity AS w FROM interactions)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM mixed)"
PER = """pairs AS (SELECT a.impression_id, sum(CASE WHEN a.score > b.score THEN CAST(1 AS DOUBLE) WHEN a.score = b.score THEN CAST(0.5 AS DOUBLE) ELSE 0 END) / count(*) AS auc FROM mixed a JOIN mixed b ON b.impression_id = a.impression_id AND a.clicked = 1 AND b.clicked = 0 GROUP BY a.impression_id),
gains AS (SELECT impression_id, count(*) AS candidates, sum(clicked) AS p, sum(CASE WHEN clicked = 1 THEN 1 / CAST(rank AS DOUBLE) ELSE 0 END) / sum(clicked) AS mrr,
  sum(CASE WHEN clicked = 1 AND rank <= 5 THEN 1 / log2(CAST(rank + 1 AS DOUBLE)) ELSE 0 END) AS g5, sum(CASE WHEN clicked = 1 AND rank <= 10 THEN 1 / log2(CAST(rank + 1 AS DOUBLE)) ELSE 0 END) AS g10 FROM ranked GROUP BY impression_id),
ideals AS (SELECT n.n AS n, sum(1 / log2(CAST(r.r + 1 AS DOUBLE))) AS ideal FROM range(1, 11) n(n), range(1, 11) r(r) WHERE r.r <= n.n GROUP BY n.n),
per AS (SELECT g.impression_id, g.candidates, a.auc, g.mrr, g.g5 / i5.ideal AS ndcg_5, g.g10 / i10.ideal AS ndcg_10 FROM gains g JOIN pairs a ON a.impression_id = g.impression_id JOIN ideals i5 ON i5.n = least(g.p, 5) JOIN ideals i10 ON i10.n = least(g.p, 10))"""
IMP = (IMPRESSIONS, MIXED, RANKED, PER)
INTEREST = """sums AS (SELECT e.event_id, h.topic, sum(h.part) AS total FROM visible e JOIN (SELECT event_id, user_id, occurred_us, unnest(topics) AS topic, ({signal}) * weight * exp(ln(CAST(2 AS DOUBLE)) * ((occurred_us - 1704067200000000) / CAST(86400000000 AS DOUBLE)) / 30) / len(topics) AS part FROM visible) h ON h.user_id = e.user_id AND {before} GROUP BY e.event_id, h.topic),
scales AS (SELECT event_id, max(abs(total)) AS scale FROM sums GROUP BY event_id),
mine AS (SELECT e.event_id, sum(coalesce(s.total, 0)) AS mine, count(*) AS n FROM (SELECT event_id, unnest(topics) AS topic FROM visible) e LEFT JOIN sums s ON s.event_id = e.event_id AND s.topic = e.topic GROUP BY e.event_id)""".replace("{signal}", SIGNAL)
INTEREST_OUT = "SELECT m.event_id, round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (coalesce(m.mine / nullif(s.scale, 0) / m.n, 0) + 1) / 2)), 6) AS interest FROM mine m LEFT JOIN scales s ON s.event_id = m.event_id"


OBJECTIVES = ("ndcg", "worst_cohort_ndcg", "ndcg_gap", "topic_calibration", "topic_calibration_gap")
#: Of one policy's samples: users' mean and the worst cohort for nDCG, calibration only where
#: every cohort has some, and gaps only between two cohorts or more.
OBJECTIVE_VIEWS = """audited AS (SELECT cohort, count(*) AS users, avg(ndcg) AS ndcg, count(topic_calibration) AS seen, avg(topic_calibration) AS calibration FROM samples JOIN cohorts USING (user_id) GROUP BY cohort),
objectives AS (SELECT sum(users * ndcg) / sum(users) AS ndcg, min(ndcg) AS worst_cohort_ndcg, CASE WHEN count(*) > 1 THEN max(ndcg) - min(ndcg) END AS ndcg_gap,
  CASE WHEN min(seen) > 0 THEN sum(seen * calibration) / sum(seen) END AS topic_calibration, CASE WHEN count(*) > 1 AND min(seen) > 0 THEN max(calibration) - min(calibration) END AS topic_calibration_gap FROM audited)"""


def _frontier_sql(configs: dict[str, FeedConfig]) -> str:
    rounded = ", ".join(f"round({n}, 6) AS {n}" for n in OBJECTIVES)
    body = " UNION ALL ".join(f"SELECT '{n}' AS policy, * FROM ({q(f'SELECT {rounded} FROM objectives', CATALOG, EVENTS, loo_views(c), COHORTS, OBJECTIVE_VIEWS, recursive=True)}) p_{n}" for n, c in configs.items())
    other = "a.ndcg >= b.ndcg AND a.worst_cohort_ndcg >= b.worst_cohort_ndcg AND a.ndcg_gap <= b.ndcg_gap AND a.topic_calibration <= b.topic_calibration AND a.topic_calibration_gap <= b.topic_calibration_gap"
    better = "a.ndcg > b.ndcg OR a.worst_cohort_ndcg > b.worst_cohort_ndcg OR a.ndcg_gap < b.ndcg_gap OR a.topic_calibration < b.topic_calibration OR a.topic_calibration_gap < b.topic_calibration_gap OR a.policy < b.policy"
    return f"WITH points AS (SELECT * FROM ({body}) x WHERE topic_calibration <= 2 AND ndcg_gap IS NOT NULL AND topic_calibration_gap IS NOT NULL) SELECT b.* FROM points b WHERE NOT EXISTS (SELECT 1 FROM points a WHERE a.policy <> b.policy AND {other} AND ({better}))"


def _policy_sql(configs: dict[str, FeedConfig]) -> str:
    """Means of each policy; a policy's views are a query of their own."""
    body = " UNION ALL ".join(f"SELECT '{n}' AS policy, * FROM ({q(f'SELECT count(*) AS users, {AVERAGES} FROM samples', CATALOG, EVENTS, loo_views(c), recursive=True)}) p_{n}" for n, c in configs.items())
    return body


def _policy_samples(configs: dict[str, FeedConfig]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS policy, user_id, ndcg FROM ({q('SELECT user_id, ndcg FROM samples', CATALOG, EVENTS, loo_views(c), recursive=True)}) s_{n}" for n, c in configs.items())


ARRIVED = "arrived AS (SELECT user_id || ':' || article_id AS event_id, user_id, occurred_us, kind AS content, event_id * 7919 % 1000003 AS arrival FROM interactions)"
DELTA_SQL = f"""SELECT b.policy, count(*) AS users, round(avg(a.ndcg - b.ndcg), 6) AS delta FROM ({_policy_samples({"full": policies(C, 10)["full"]})}) a JOIN ({_policy_samples({n: c for n, c in policies(C, 10).items() if n != "full"})}) b ON b.user_id = a.user_id GROUP BY b.policy"""

ORACLE_SQL: dict[str, str] = {
    "s03_articles": q("SELECT id, list_aggregate(topics, 'string_agg', ',') AS topics, source, published_us, round(quality, 6) AS quality, round(popularity, 6) AS popularity FROM catalog", CATALOG),
    "s03_duplicate_ids": q("SELECT id, count(*) AS n FROM catalog GROUP BY id HAVING count(*) > 1", CATALOG),
    "s04_events": q("SELECT event_id, user_id, article_id, kind, occurred_us, round(propensity, 6) AS propensity, round(weight, 6) AS weight FROM interactions", EVENTS),
    "s08_duplicate_scores": "SELECT l_orderkey AS impression_id, l_partkey AS article_id, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1",
    "s28_export": q("SELECT id, 'id=' || id || ';topics=' || topics[1] || '|' || topics[2] || ';source=' || source || ';at=' || CAST(published_us AS VARCHAR) AS line FROM catalog", CATALOG),
    "p01_topics": "SELECT doc_id, concat_ws(',', lower(lang), lower(source), 'strasse', 'σίσυφοσ') AS topics FROM documents",
    "p02_identifiers": "SELECT c_custkey, trim(c_name) = c_name AND length(c_name) BETWEEN 1 AND 256 AS ok, FALSE AS padded_ok, length(c_name) <= 4 AS short_ok FROM customer",
    "p03_predicates": q("SELECT count(*) FILTER (WHERE propensity BETWEEN 0 AND 1) AS unit, count(*) FILTER (WHERE propensity * 2 > 1) AS not_unit, count(*) FILTER (WHERE weight > 0) AS positive FROM interactions", EVENTS),
    "p04_visible": q(f"SELECT event_id, user_id, article_id FROM interactions WHERE occurred_us <= {AS_OF} AND article_id IN (SELECT id FROM catalog WHERE published_us <= {AS_OF})", CATALOG, EVENTS),
    "p05_eligible": q("SELECT user_id, count(*) AS n FROM pairs GROUP BY user_id", *FEED),
    "p06_available": q("SELECT h.user_id, (SELECT count(*) FROM catalog c WHERE c.published_us <= h.holdout_us) AS n FROM holdouts h", *LOO, recursive=True),
    "p07_positives": q("SELECT event_id, user_id FROM positives", *LOO, recursive=True),
    "p08_training": q("SELECT e.event_id, e.user_id FROM interactions e, holdouts h WHERE h.user_id = e.user_id AND e.occurred_us < h.holdout_us", *LOO, recursive=True),
    "p09_signal": q(f"SELECT kind, count(*) AS n, max({SIGNAL}) AS signal FROM interactions GROUP BY kind", EVENTS),
    "p10_shares": q("SELECT topic, count(*) AS n, round(sum(share), 6) AS share FROM shares GROUP BY topic", CATALOG, EVENTS, profile_views()),
    "p11_observations": q("SELECT user_id, count(*) AS n, sum(reward) AS reward, round(sum(propensity), 6) AS propensity FROM logged GROUP BY user_id", EVENTS, LOGGED),
    "p12_clicks": q("SELECT impression_id, user_id, article_id, occurred_us FROM impressions WHERE clicked = 1", IMPRESSIONS),
    "p13_mixed": q("SELECT DISTINCT impression_id FROM mixed", IMPRESSIONS, MIXED),
    "p14_prefix": q("SELECT 'train-' || CAST(impression_id AS VARCHAR) AS id, n FROM (SELECT impression_id, occurred_us, count(*) AS n FROM impressions GROUP BY impression_id, occurred_us HAVING count(*) <= 256) x ORDER BY occurred_us, impression_id LIMIT 100", IMPRESSIONS),
    "p15_scores": q("SELECT user_id, id, " + ", ".join(f"round({c}, 6) AS {c}" for c in (*COMPONENTS, "total")) + " FROM scored", *FEED),
    # What is joined is made once, and topics are matched in lists: nothing is inlined twice.
    "p16_reasons": q(
        "SELECT user_id, id, concat_ws('; ', CASE WHEN len(m) > 0 THEN 'positive interests: ' || array_to_string(m, ', ') END, CASE WHEN freshness >= 0.75 THEN 'recently published' END, CASE WHEN quality >= 0.75 THEN 'high quality signal' END, 'not previously seen') AS reasons"
        " FROM (SELECT p.*, list_sort(list_filter(p.topics, lambda t: coalesce(k.rw[list_position(k.rt, t)], CAST(0 AS DOUBLE)) > 0)) AS m"
        f", exp(-(ln(CAST(2 AS DOUBLE)) * (({AS_OF} - p.published_us) / CAST(3600000000 AS DOUBLE)) / CAST(72 AS DOUBLE))) AS freshness FROM pairs p LEFT JOIN known k ON k.user_id = p.user_id) x",
        *[v.replace("readers AS (", "readers AS MATERIALIZED (").replace("visible AS (", "visible AS MATERIALIZED (") for v in (CATALOG.replace("catalog AS (", "catalog AS MATERIALIZED ("), EVENTS, profile_views())],
        score_views().split(",\ntopical AS")[0].replace("pairs AS (", "pairs AS MATERIALIZED (").replace("known AS (", "known AS MATERIALIZED (").replace("seen AS (", "seen AS MATERIALIZED ("),
    ),
    "p20_ceilings": q(
        "SELECT name, CAST(value AS DOUBLE) AS value, CAST(most AS DOUBLE) AS most, value <= most AS ok FROM (SELECT 'rows' AS name, count(*) AS value, 1000000000 AS most FROM interactions UNION ALL SELECT 'kind_chars', CAST(sum(length(kind)) AS BIGINT), 1000000000000 FROM interactions UNION ALL SELECT 'clicks', count(*) FILTER (WHERE kind = 'click'), 10 FROM interactions) x",
        EVENTS,
    ),
    "p17_features": q("SELECT user_id, id, CAST(7 AS BIGINT) AS n, round(1 + interest + freshness + quality + novelty + popularity + exploration, 6) AS sum FROM parts", *FEED),
    "j01_events_with_topics": q("SELECT c.topics[1] AS topic, e.kind, count(*) AS n FROM interactions e JOIN catalog c ON c.id = e.article_id GROUP BY c.topics[1], e.kind", CATALOG, EVENTS),
    "j02_unseen": q("SELECT user_id, id FROM pairs", *FEED),
    "j03_dangling": q(f"SELECT event_id FROM interactions WHERE article_id NOT IN (SELECT id FROM catalog WHERE published_us <= {AS_OF})", CATALOG, EVENTS),
    "j04_subset": q("SELECT id FROM catalog WHERE id IN (SELECT article_id FROM interactions WHERE kind = 'click')", CATALOG, EVENTS),
    "j06_point_in_time": q(INTEREST_OUT, CATALOG, EVENTS, profile_views(), INTEREST.replace("{before}", "h.occurred_us < e.occurred_us")),
    "j07_pairs": q(
        "SELECT user_id, count(*) AS n, round(avg(1 - len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE)), 6) AS distance FROM (SELECT f.user_id, f.tops[i.i] AS a, f.tops[j.i] AS b FROM final f, range(1, 11) i(i), range(1, 11) j(i) WHERE i.i < j.i AND j.i <= len(f.ids)) x GROUP BY user_id",
        *FEED, slate_views(), recursive=True,
    ),
    "j08_label_pairs": q("SELECT a.impression_id, count(*) AS pairs FROM impressions a JOIN impressions b ON b.impression_id = a.impression_id AND a.clicked = 1 AND b.clicked = 0 GROUP BY a.impression_id", IMPRESSIONS),
    "j09_coverage": q("SELECT (SELECT count(*) FROM impressions i WHERE NOT EXISTS (SELECT 1 FROM impressions s WHERE s.score > 0.01 AND s.impression_id = i.impression_id AND s.article_id = i.article_id)) AS missing, (SELECT count(*) FROM impressions WHERE score > 0.09) AS extra", IMPRESSIONS),
    "j10_cohorts": q("SELECT cohort, count(*) AS users FROM cohorts GROUP BY cohort", EVENTS, COHORTS),
    "j13_known_terms": q("SELECT t.id, count(*) AS terms, CAST(sum(t.n) AS BIGINT) AS tokens FROM terms t JOIN vocabulary v ON v.feature = t.feature GROUP BY t.id", *TEXT),
    "j14_merge": "SELECT CAST(1 AS BIGINT) AS versions, count(DISTINCT doc_id) AS n FROM documents",
    "j15_history": q("SELECT DISTINCT i.impression_id, coalesce(h.clicks, 0) AS clicks FROM impressions i LEFT JOIN (SELECT user_id, count(*) AS clicks FROM impressions WHERE clicked = 1 GROUP BY user_id) h ON h.user_id = i.user_id", IMPRESSIONS),
    "a01_strengths": q("SELECT user_id, topic, round(total, 6) AS total FROM totals", CATALOG, EVENTS, profile_views()),
    "a02_weights": q("SELECT user_id, topic, round(weight, 6) AS weight FROM readers", CATALOG, EVENTS, profile_views()),
    "a03_seen": q("SELECT user_id, string_agg(DISTINCT article_id, ',' ORDER BY article_id) AS seen, count(*) AS event_count FROM visible GROUP BY user_id", CATALOG, EVENTS, profile_views()),
    "a04_exposures": q("SELECT article_id, count(*) AS n FROM (SELECT unnest(ids) AS article_id FROM samples) x GROUP BY article_id", *LOO, recursive=True),
    "a05_coverage": q("SELECT exposed, eligible, round(exposed / CAST(eligible AS DOUBLE), 6) AS catalog_coverage FROM (SELECT (SELECT count(DISTINCT x.i) FROM (SELECT unnest(ids) AS i FROM samples) x) AS exposed, (SELECT count(*) FROM catalog WHERE published_us <= (SELECT max(holdout_us) FROM holdouts)) AS eligible) y", *LOO, recursive=True),
    "a06_gini": q("SELECT round(2 * sum(i * n) / CAST(max(m) * sum(n) AS DOUBLE) - (max(m) + 1) / CAST(max(m) AS DOUBLE), 6) AS exposure_gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m FROM (SELECT a, count(*) AS n FROM (SELECT unnest(ids) AS a FROM samples) x GROUP BY a) y) z", *LOO, recursive=True),
    "a07_logged": q("SELECT count(*) AS observations, count(DISTINCT user_id) AS users, round(sum(reward * w) / sum(w), 6) AS estimate, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_sample_size, round(max(w) / sum(w), 6) AS largest_weight_share FROM logged", EVENTS, LOGGED),
    "a10_user_totals": q("SELECT user_id, round(sum(reward * w), 6) AS rewarded, round(sum(w), 6) AS weight FROM logged GROUP BY user_id", EVENTS, LOGGED),
    "a12_percentiles": "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type",
    "a13_order_statistics": "SELECT event_type, round(max(CASE WHEN i = floor(m * CAST(0.025 AS DOUBLE)) THEN value END), 6) AS low, round(max(CASE WHEN i = ceil(m * CAST(0.975 AS DOUBLE)) THEN value END), 6) AS high FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) - 1 AS m FROM events) x GROUP BY event_type",
    "a14_cohorts": q(f"SELECT cohort, count(*) AS users, count(topic_calibration) AS calibrated_users, {AVERAGES}, round(avg(topic_calibration), 6) AS topic_calibration FROM samples JOIN cohorts USING (user_id) GROUP BY cohort", *LOO, COHORTS, recursive=True),
    "a14_gaps": q("SELECT count(*) AS cohorts, " + ", ".join(f"round(max({m}) - min({m}), 6) AS {m}_gap" for m in (*MEANS, "topic_calibration")) + " FROM (SELECT cohort, " + ", ".join(f"avg({m}) AS {m}" for m in (*MEANS, "topic_calibration")) + " FROM samples JOIN cohorts USING (user_id) GROUP BY cohort) x", *LOO, COHORTS, recursive=True),
    "a15_objectives": q("SELECT 'full' AS policy, " + ", ".join(f"round({n}, 6) AS {n}" for n in OBJECTIVES) + " FROM objectives", *LOO, COHORTS, OBJECTIVE_VIEWS, recursive=True),
    "p18_constraints": q(
        "SELECT 'full' AS policy, concat_ws(',', CASE WHEN ndcg < 0 THEN 'minimum_ndcg' END, CASE WHEN worst_cohort_ndcg < 0.9 THEN 'minimum_worst_cohort_ndcg' END, CASE WHEN coalesce(ndcg_gap, 9) > 1 THEN 'maximum_ndcg_gap' END, CASE WHEN coalesce(topic_calibration, 9) > 0.01 THEN 'maximum_topic_calibration' END, CASE WHEN coalesce(topic_calibration_gap, 9) > 0.5 THEN 'maximum_topic_calibration_gap' END) AS violations FROM objectives",
        *LOO, COHORTS, OBJECTIVE_VIEWS, recursive=True,
    ),
    "a16_document_frequency": q("SELECT feature, df, round(idf, 6) AS idf FROM vocabulary", *TEXT),
    "a17_token_frequency": q("SELECT n AS times, count(*) AS tokens FROM (SELECT feature, CAST(sum(n) AS BIGINT) AS n FROM terms GROUP BY feature) x GROUP BY n", TERMS),
    "a18_labels": q("SELECT count(*) FILTER (WHERE lo < hi) AS comparable, count(*) FILTER (WHERE lo = 1) AS all_clicked, count(*) FILTER (WHERE hi = 0) AS none_clicked FROM (SELECT impression_id, min(clicked) AS lo, max(clicked) AS hi FROM impressions GROUP BY impression_id) x", IMPRESSIONS),
    "a19_slate_mass": q("SELECT user_id, topic, round(sum(m) / max(t), 6) AS share FROM (SELECT user_id, unnest(flatten(tops)) AS topic, CAST(0.5 AS DOUBLE) AS m, CAST(len(ids) AS DOUBLE) AS t FROM final) x GROUP BY user_id, topic", *FEED, slate_views(), recursive=True),
    "a20_reader": q("SELECT user_id, topic, round(weight / sum(weight) OVER (PARTITION BY user_id), 6) AS share FROM readers WHERE weight > 0", CATALOG, EVENTS, profile_views()),
    "a21_calibration": q(
        "SELECT f.user_id, round(coalesce(greatest(CAST(0 AS DOUBLE), k.kl), 0), 6) AS error FROM final f LEFT JOIN (SELECT p.user_id, sum(p.p * ln(p.p / (CAST(0.99 AS DOUBLE) * coalesce(s.s, 0) + CAST(0.01 AS DOUBLE) * p.p))) AS kl"
        " FROM (SELECT user_id, topic, weight / sum(weight) OVER (PARTITION BY user_id) AS p FROM readers WHERE weight > 0) p"
        " LEFT JOIN (SELECT user_id, topic, sum(CAST(0.5 AS DOUBLE)) / max(t) AS s FROM (SELECT user_id, unnest(flatten(tops)) AS topic, CAST(len(ids) AS DOUBLE) AS t FROM final) x GROUP BY user_id, topic) s ON s.user_id = p.user_id AND s.topic = p.topic GROUP BY p.user_id) k ON k.user_id = f.user_id",
        *FEED, slate_views(), recursive=True,
    ),
    "a22_digest": q("SELECT substr(h, 1, 2) AS bucket, count(*) AS n, min(h) AS least, max(h) AS greatest FROM (SELECT sha256(id || '|' || topics[1] || ',' || topics[2] || '|' || source || '|' || CAST(published_us AS VARCHAR)) AS h FROM catalog) x GROUP BY substr(h, 1, 2)", CATALOG),
    "a24_counts": q("SELECT (SELECT count(*) FROM documents) AS articles, count(*) AS events, count(DISTINCT user_id) AS users FROM interactions", EVENTS),
    "a26_union": q("SELECT count(*) AS eligible FROM catalog WHERE published_us <= (SELECT max(holdout_us) FROM holdouts)", *LOO, recursive=True),
    "w01_holdouts": q("SELECT user_id, holdout_id, holdout_us FROM holdouts", *LOO, recursive=True),
    "w02_rows_history": q(INTEREST_OUT, CATALOG, EVENTS, profile_views(), INTEREST.replace("{before}", "(h.occurred_us < e.occurred_us OR h.occurred_us = e.occurred_us AND h.event_id < e.event_id)")),
    "w03_counts_before": q("SELECT e.event_id, count(h.event_id) AS before FROM interactions e LEFT JOIN interactions h ON h.user_id = e.user_id AND h.occurred_us < e.occurred_us GROUP BY e.event_id", EVENTS),
    "w04_prior_clicks": q("SELECT e.event_id, count(h.event_id) AS clicks, max_by(h.article_id, h.occurred_us) AS last_click FROM interactions e LEFT JOIN interactions h ON h.user_id = e.user_id AND h.occurred_us < e.occurred_us AND h.kind = 'click' GROUP BY e.event_id", EVENTS),
    "w05_ranks": q("SELECT impression_id, article_id, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM impressions", IMPRESSIONS),
    "w06_watermark": q("SELECT event_id, coalesce(mark, 0) AS mark, coalesce(occurred_us < mark, FALSE) AS late FROM (SELECT event_id, occurred_us, max(occurred_us) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS mark FROM interactions) x", EVENTS),
    "w10_sortedness": q("SELECT user_id, count(*) FILTER (WHERE back) AS steps_back FROM (SELECT user_id, occurred_us < lag(occurred_us) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM interactions) x GROUP BY user_id", EVENTS),
    "w12_mid_ranks": q("SELECT impression_id, article_id, round(rank() OVER (PARTITION BY impression_id ORDER BY score) + (count(*) OVER (PARTITION BY impression_id, score) - 1) / CAST(2 AS DOUBLE), 6) AS mid_rank FROM impressions", IMPRESSIONS),
    "o01_order": q("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_us, event_id) AS place FROM interactions", EVENTS),
    "o02_top_k": q("SELECT user_id, id, rank FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY round(total, 6) DESC, id) AS rank FROM scored) x WHERE rank <= 5", *FEED),
    "o04_best": q("SELECT impression_id, round(auc, 6) AS auc FROM per ORDER BY round(auc, 6) DESC, impression_id LIMIT 1", *IMP),
    "o05_vocabulary": q("SELECT feature, row_number() OVER (ORDER BY feature) AS position FROM vocabulary", *TEXT),
    "u01_union": "SELECT source, count(*) AS n FROM (SELECT DISTINCT doc_id, source FROM documents) x GROUP BY source",
    "u02_differences": q("SELECT id, 'never seen' AS side FROM (SELECT id FROM catalog EXCEPT SELECT article_id FROM interactions) a UNION ALL SELECT article_id, 'unknown' FROM (SELECT article_id FROM interactions EXCEPT SELECT id FROM catalog) b", CATALOG, EVENTS),
    "u03_overlap": q(f"SELECT article_id FROM interactions WHERE occurred_us < {AS_OF} INTERSECT SELECT article_id FROM interactions WHERE occurred_us >= {AS_OF}", EVENTS),
    "u04_duplicates": q("SELECT user_id, article_id, count(*) AS n FROM interactions GROUP BY user_id, article_id HAVING count(*) > 1", EVENTS),
    "u05_equality": "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS twice",
    "f02_exploration": q("SELECT event_id, round(CAST(CAST('0x' || substr(sha256(user_id || chr(0) || article_id), 1, 16) AS UBIGINT) AS DOUBLE) / CAST(18446744073709551616 AS DOUBLE), 9) AS value FROM interactions", EVENTS),
    "f05_sigmoid": "SELECT event_id, round(1 / (1 + exp(-(value - 250) / 10)), 9) AS p FROM events",
    "f07_softmax": q("SELECT impression_id, article_id, round(exp(score) / sum(exp(score)) OVER (PARTITION BY impression_id), 9) AS p FROM impressions", IMPRESSIONS),
    "f08_tokens": "SELECT doc_id, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+')) AS n, len(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+'))) AS distinct_n FROM documents",
    "f10_vectors": q("SELECT id, count(*) AS n, round(sum(weight), 6) AS sum, round(sum(weight * weight), 6) AS norm FROM vectors GROUP BY id", *TEXT, VECTORS),
    "f13_wilson": q("SELECT user_id, round(greatest(CAST(0 AS DOUBLE), (p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 9) AS low, round(least(CAST(1 AS DOUBLE), (p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 9) AS high FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE kind IN ('click', 'like')) / CAST(count(*) AS DOUBLE) AS p, CAST(3.8416 AS DOUBLE) AS z2 FROM interactions GROUP BY user_id) x", EVENTS),
    "f14_random_hits": q("SELECT user_id, round(least(10, count(DISTINCT article_id)) / CAST(count(DISTINCT article_id) AS DOUBLE), 9) AS rate FROM interactions GROUP BY user_id", EVENTS),
    "f19_split": q("SELECT impression_id, 'n-' || CAST(article_id AS VARCHAR) AS item, clicked = 1 AS clicked FROM impressions", IMPRESSIONS),
    "f21_digests": q("SELECT event_id, sha256(CAST(event_id AS VARCHAR) || '|' || user_id || '|' || article_id || '|' || kind || '|' || CAST(occurred_us AS VARCHAR)) AS digest FROM interactions", EVENTS),
    "r01_profiles": q("SELECT v.user_id, (SELECT count(*) FROM readers r WHERE r.user_id = v.user_id) AS topics, count(DISTINCT v.article_id) AS seen, count(*) AS event_count FROM visible v GROUP BY v.user_id", CATALOG, EVENTS, profile_views()),
    "r02_candidates": q("SELECT user_id, count(*) AS n, round(avg(total), 6) AS mean, round(max(total), 6) AS best FROM scored GROUP BY user_id", *FEED),
    "r05_feeds_mmr": q("SELECT f.user_id, i.i AS rank, f.ids[i.i] AS article_id, round(f.scores[i.i], 6) AS score FROM final f, range(1, 11) i(i) WHERE i.i <= len(f.ids)", *FEED, slate_views(), recursive=True),
    "r04_feeds_calibrated": q("SELECT f.user_id, i.i AS rank, f.ids[i.i] AS article_id, round(f.scores[i.i], 6) AS score FROM final f, range(1, 11) i(i) WHERE i.i <= len(f.ids)", *FEED, calibrated_views(), recursive=True),
    "m06_leave_last_out": q("SELECT user_id, holdout_id, array_to_string(ids, ',') AS ranked_ids, " + ", ".join(f"round({m}, 6) AS {m}" for m in MEANS) + " FROM samples", *LOO, recursive=True),
    "m06_macro": q(f"SELECT count(*) AS users, {AVERAGES} FROM samples", *LOO, recursive=True),
    "m09_policies": _policy_sql(policies(C, 10)),
    "m09_delta_means": DELTA_SQL,
    "m07_drawn": q("SELECT CAST(d AS INTEGER) AS draw, n AS drawn, n AS ones FROM range(50) r(d), (SELECT count(DISTINCT user_id) AS n FROM interactions WHERE propensity IS NOT NULL) u", EVENTS),
    "m13_frontier": _frontier_sql(policies(C, 10)),
    "m11_ablations": _policy_sql({"base": C, "freshness": ablation(C, "freshness"), "slate_diversity": ablation(C, "slate_diversity")}),
    "m17_impressions": q("SELECT count(*) AS impressions, CAST(sum(candidates) AS BIGINT) AS candidates, round(avg(auc), 6) AS auc, round(avg(mrr), 6) AS mrr, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(ndcg_10), 6) AS ndcg_10 FROM per", *IMP),
    "m14_per_impression": q("SELECT impression_id, round(auc, 6) AS auc, round(mrr, 6) AS mrr, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10 FROM per", *IMP),
    "l02_predict": q("SELECT user_id, id, p, rank FROM (SELECT user_id, id, p, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, id) AS rank FROM (SELECT user_id, id, round(1 / (1 + exp(-(-1 + 1.2 * interest + 0.3 * freshness + 0.8 * quality + 0.1 * novelty + 0.6 * popularity))), 6) AS p FROM parts) x) y WHERE rank <= 5", *FEED),
    "l07_affinity": q(
        f"SELECT p.user_id, p.id, round(CASE WHEN d.dot IS NULL OR n.norm = 0 THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), d.dot / n.norm)) END, 6) AS affinity FROM (SELECT DISTINCT user_id, article_id AS id FROM visible) p LEFT JOIN (SELECT q.user_id, q.id, sum(v.weight * h.weight) AS dot FROM (SELECT DISTINCT user_id, article_id AS id FROM visible) q JOIN named v ON v.id = q.id JOIN history h ON h.user_id = q.user_id AND h.feature = v.feature GROUP BY q.user_id, q.id) d ON d.user_id = p.user_id AND d.id = p.id LEFT JOIN (SELECT user_id, sqrt(sum(weight * weight)) AS norm FROM history GROUP BY user_id) n ON n.user_id = p.user_id",
        CATALOG, EVENTS, profile_views(), *TEXT, VECTORS, "named AS (SELECT 'd' || lpad(CAST(id AS VARCHAR), 12, '0') AS id, feature, weight FROM vectors)", f"history AS (SELECT e.user_id, v.feature, sum(({SIGNAL}) * e.weight * v.weight) AS weight FROM visible e JOIN named v ON v.id = e.article_id GROUP BY e.user_id, v.feature)",
    ),
    "t02_dedup": q("SELECT event_id, min(arrival) AS arrival FROM arrived GROUP BY event_id", EVENTS, ARRIVED),
    "t03_conflicts": q("SELECT a.event_id, count(*) FILTER (WHERE a.arrival <> f.arrival AND a.content = f.content) AS duplicates, count(*) FILTER (WHERE a.content <> f.content) AS conflicts FROM arrived a JOIN (SELECT event_id, min(arrival) AS arrival, min_by(content, arrival) AS content FROM arrived GROUP BY event_id) f ON f.event_id = a.event_id GROUP BY a.event_id HAVING count(*) FILTER (WHERE a.content <> f.content) > 0", EVENTS, ARRIVED),
    "t04_late": q("SELECT e.user_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM arrived h WHERE h.user_id = e.user_id AND h.arrival < e.arrival AND h.occurred_us - 259200000000 > e.occurred_us)) AS late FROM arrived e GROUP BY e.user_id", EVENTS, ARRIVED),
    "t09_profile_at": q("SELECT user_id, topic, round(weight, 6) AS weight FROM readers", CATALOG, EVENTS, profile_views(str(AS_OF + 5 * 86_400_000_000))),
    "x_hourly_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY date_trunc('hour', ts), event_type",
    "a23_row_digests": q("SELECT impression_id, article_id, sha256(CAST(impression_id AS VARCHAR) || ':' || CAST(article_id AS VARCHAR) || ':' || CAST(clicked AS VARCHAR)) AS digest FROM impressions", IMPRESSIONS),
    "a25_active_users": q(f"SELECT DISTINCT user_id FROM interactions WHERE occurred_us <= {AS_OF}", EVENTS),
    "f01_decay": q(f"SELECT event_id, round(pow(CAST(0.5 AS DOUBLE), ({AS_OF} - occurred_us) / CAST(86400000000 AS DOUBLE) / 30), 9) AS decay FROM interactions WHERE occurred_us <= {AS_OF}", EVENTS),
    "f04_jaccard": "SELECT doc_id, round(CASE WHEN doc_id % 7 = doc_id % 5 THEN 2 / CAST(3 AS DOUBLE) ELSE 1 / CAST(4 AS DOUBLE) END, 9) AS similarity FROM documents",
    "f16_utc_text": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS text FROM events",
    "f17_offsets": "SELECT event_id, o.at_offset, epoch_us(date_trunc('second', ts)) - o.seconds * 1000000 AS at_us FROM events, (VALUES ('+05:30', CAST(19800 AS BIGINT)), ('-03:30', -12600), ('+14:00', 50400), ('-12:00', -43200), ('+01:02:03', 3723)) o(at_offset, seconds)",
    "f22_cohort_check": "SELECT count(*) FILTER (WHERE m.n IS NULL) AS missing, count(*) FILTER (WHERE c.c_custkey IS NULL) AS extra, count(*) FILTER (WHERE m.n > 1) AS twice FROM customer c FULL JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey) m ON m.o_custkey = c.c_custkey",
    "f18_us_times": "SELECT event_id, epoch_us(date_trunc('second', ts)) + 28800000000 AS at_us FROM events",
    "f25_maps": q("SELECT user_id, kind, CASE WHEN kind = 'hide' THEN count(*) ELSE 2 * count(*) END AS n FROM interactions GROUP BY user_id, kind", EVENTS),
    "l04_slate_features": q(
        """SELECT i.impression_id, CAST(i.article_id AS VARCHAR) AS id, round((coalesce(sum(m.total / m.scale) / 2, 0) + 1) / 2, 6) AS interest,
  CASE WHEN EXISTS (SELECT 1 FROM clicks k WHERE k.user_id = i.user_id AND k.article_id = i.article_id AND k.t < i.occurred_us) THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS novelty
FROM impressions i JOIN tops c ON c.article_id = i.article_id LEFT JOIN merits m ON m.user_id = i.user_id AND m.t = i.occurred_us AND list_contains(c.topics, m.topic) GROUP BY i.impression_id, i.article_id, i.user_id, i.occurred_us""",
        IMPRESSIONS,
        "tops AS (SELECT p_partkey AS article_id, [p_brand, split_part(p_type, ' ', 1)] AS topics FROM part)",
        "clicks AS (SELECT i.user_id, i.article_id, i.occurred_us AS t, c.topics FROM impressions i JOIN tops c ON c.article_id = i.article_id WHERE clicked = 1)",
        "moments AS (SELECT DISTINCT user_id, occurred_us AS t FROM impressions)",
        "sums AS (SELECT m.user_id, m.t, k.topic, sum(CAST(0.7 AS DOUBLE) / 2 * pow(CAST(0.5 AS DOUBLE), (m.t - k.t) / CAST(86400000000 AS DOUBLE) / 30)) AS total FROM moments m JOIN (SELECT user_id, t, unnest(topics) AS topic FROM clicks) k ON k.user_id = m.user_id AND k.t < m.t GROUP BY m.user_id, m.t, k.topic)",
        "merits AS (SELECT user_id, t, topic, total, max(total) OVER (PARTITION BY user_id, t) AS scale FROM sums)",
    ),
    "l08_text_history": q(
        "SELECT user_id, count(*) AS features, round(sum(weight), 5) AS sum, round(sqrt(sum(weight * weight)), 5) AS norm FROM history GROUP BY user_id",
        CATALOG, EVENTS, profile_views(), *TEXT, VECTORS, "named AS (SELECT 'd' || lpad(CAST(id AS VARCHAR), 12, '0') AS id, feature, weight FROM vectors)", f"history AS (SELECT e.user_id, v.feature, sum(({SIGNAL}) * e.weight * v.weight) AS weight FROM visible e JOIN named v ON v.id = e.article_id GROUP BY e.user_id, v.feature)",
    ),
}
