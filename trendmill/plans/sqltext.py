"""Pieces of SQL shared by the twins of several queries."""

from __future__ import annotations

from trendmill import constants as K
from trendmill.adapters import DOCS_SQL, EVENTS_SQL, TRENDING_SQL, VIDEOS_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def band(expr: str, edges, labels, closed: str = "<") -> str:
    arms = " ".join(f"WHEN {expr} {closed} {e} THEN {q(label)}" for e, label in zip(edges, labels))
    return f"CASE WHEN {expr} IS NULL THEN NULL {arms} ELSE {q(labels[-1])} END"


def titles(expr: str, default: str) -> str:
    arms = " ".join(f"WHEN {cid} THEN {q(title)}" for cid, title in K.CATEGORY_TITLES.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def words(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array({expr}, '\s+'), lambda w: w <> '')"


def tag_count(expr: str, delimiters: str = "[|,;]") -> str:
    return (f"CASE WHEN {expr} IS NULL OR {expr} IN ('', '[none]') THEN 0 "
            f"ELSE len(regexp_split_to_array({expr}, '{delimiters}')) END")


def hours(start: str, end: str) -> str:
    return (f"CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL THEN "
            f"greatest((epoch_us({end}) - epoch_us({start})) / 3.6e9, 0) END")


def part_of_day(hour: str, evening_end: int = 23) -> str:
    return (f"CASE WHEN {hour} IS NULL THEN NULL WHEN {hour} BETWEEN 6 AND 11 THEN 'Morning' "
            f"WHEN {hour} BETWEEN 12 AND 17 THEN 'Afternoon' "
            f"WHEN {hour} BETWEEN 18 AND {evening_end} THEN 'Evening' ELSE 'Night' END")


def ratio(top: str, bottom: str, otherwise: str = "0") -> str:
    return (f"CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / {bottom} "
            f"WHEN {bottom} IS NOT NULL THEN CAST({otherwise} AS DOUBLE) END")


RATE = ratio("(likes + comments)", "views")



def cleaned(expr: str) -> str:
    return (rf"regexp_replace(regexp_replace(regexp_replace(lower({expr}), 'http\S+|www\S+', '', 'g'), "
            rf"'[@#][\pL\pN\pM_]+', '', 'g'), '[^a-z]+', ' ', 'g')")


def tokens(expr: str) -> str:
    return (f"list_filter(str_split({cleaned(expr)}, ' '), "
            f"lambda t: length(t) > 2 AND t NOT IN {in_list(K.STOP_WORDS)})")


COMBINED = "concat_ws(' ', title, title, description, regexp_replace(tags, '[|,;]', ' ', 'g'))"

ANALYTICS_SQL = f"""
analytics AS (
  SELECT *, {band('views', *K.VIEW_BANDS)} AS view_category,
    {band('engagement_rate', *K.ENGAGEMENT_BANDS)} AS engagement_category
  FROM (
    SELECT *, {RATE} AS engagement_rate,
      {ratio('likes', 'views')} AS like_rate, {ratio('comments', 'views')} AS comment_rate,
      {ratio('likes', 'comments', 'likes')} AS like_to_comment_ratio,
      CAST(length(title) AS INTEGER) AS title_length,
      CAST(length(description) AS INTEGER) AS description_length,
      CAST({tag_count('tags')} AS INTEGER) AS tag_count,
      CAST(len({words('title')}) AS INTEGER) AS title_word_count,
      coalesce(description NOT IN ('', 'No description available'), false) AS has_description,
      {tag_count('tags')} > 0 AS has_tags,
      {hours('publish_date', 'trending_date')} AS time_to_trending_hours,
      CAST(hour(publish_date) AS INTEGER) AS publish_hour,
      CAST(isodow(publish_date) - 1 AS INTEGER) AS publish_day_of_week,
      CAST(day(publish_date) AS INTEGER) AS publish_day_of_month,
      CAST(week(publish_date) AS INTEGER) AS publish_week,
      CAST(month(publish_date) AS INTEGER) AS publish_month,
      CAST(quarter(publish_date) AS INTEGER) AS publish_quarter,
      CAST(year(publish_date) AS INTEGER) AS publish_year,
      CAST(isodow(publish_date) >= 6 AS INTEGER) AS is_weekend,
      CAST(hour(publish_date) BETWEEN 9 AND 17 AS INTEGER) AS is_business_hours,
      CAST(hour(publish_date) BETWEEN 19 AND 23 AS INTEGER) AS is_prime_time,
      publish_date + INTERVAL 1 DAY AS extracted_at
    FROM videos
  )
)"""

# Cross-fitted naive Bayes over tf-idf: model k learns from the rows whose fold is not k and scores the others.
CATEGORY_SQL = f"""
parts AS (SELECT unnest(range(0, 5)) AS k),
cf AS (SELECT *, CAST('0x' || substr(md5(video_id || '#43'), 1, 12) AS BIGINT) % 5 AS fold, {tokens(COMBINED)} AS tokens
       FROM analytics),
ck AS (SELECT *, length(array_to_string(tokens, ' ')) > 10 AS usable,
              length(array_to_string(tokens, ' ')) > 10 AND category_id IN {in_list(K.CATEGORY_TITLES)} AS known FROM cf),
ct AS (SELECT video_id, term, count(*) AS tf FROM (
         SELECT video_id, unnest(tokens) AS term FROM ck
         UNION ALL SELECT video_id, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))
         FROM ck) GROUP BY 1, 2),
cn AS (SELECT k, count(*) AS n, count(DISTINCT category_id) AS classes FROM parts JOIN ck ON known AND fold <> k GROUP BY k),
cv AS (SELECT k, term, ln((1.0 + n) / (1 + df)) + 1 AS idf FROM (
         SELECT k, n, term, count(*) AS df, sum(tf) AS total FROM cn JOIN ck ON known AND fold <> k JOIN ct USING (video_id)
         GROUP BY k, n, term)
       WHERE df >= 2 AND df <= 0.8 * n QUALIFY row_number() OVER (PARTITION BY k ORDER BY total DESC, term) <= 10000),
cw AS (SELECT k, video_id, fold, category_id, known, term,
              tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k, video_id)) AS w
       FROM cv JOIN ct USING (term) JOIN ck USING (video_id)),
cs AS (SELECT k, category_id AS c, term, sum(w) AS s FROM cw WHERE known AND fold <> k GROUP BY ALL),
cl AS (SELECT k, c, ln(n_c + 0.1) - ln(n + 0.1 * classes) AS prior, ln(coalesce(total, 0) + 0.1 * v) AS denom
       FROM (SELECT k, n, classes, category_id AS c, count(*) AS n_c FROM cn JOIN ck ON known AND fold <> k GROUP BY ALL)
       JOIN (SELECT k, count(*) AS v FROM cv GROUP BY k) USING (k)
       LEFT JOIN (SELECT k, c, sum(s) AS total FROM cs GROUP BY ALL) USING (k, c)),
cx AS (SELECT ck.video_id, cl.c, any_value(usable) AS usable,
              any_value(prior) + coalesce(sum(w * (ln(coalesce(s, 0) + 0.1) - denom)), 0) AS score
       FROM ck JOIN cl ON ck.fold = cl.k LEFT JOIN cw ON cw.k = cl.k AND cw.video_id = ck.video_id
       LEFT JOIN cs ON cs.k = cl.k AND cs.c = cl.c AND cs.term = cw.term GROUP BY ck.video_id, cl.c),
ce AS (SELECT *, exp(score - max(score) OVER (PARTITION BY video_id)) AS e FROM cx),
cp AS (SELECT video_id, CASE WHEN any_value(usable) THEN CAST(max_by(c, (p, -c)) AS INTEGER) ELSE -1 END AS nlp_predicted_category,
              CASE WHEN any_value(usable) THEN max(p) ELSE 0.0 END AS nlp_category_confidence
       FROM (SELECT video_id, c, usable, round(e / sum(e) OVER (PARTITION BY video_id), 9) AS p FROM ce) GROUP BY video_id)"""

_LINEAR = ("likes", "comments", "title_length", "publish_hour")


def _least_squares() -> str:
    """Least squares by taking one feature after the other out of the rest; what is left of a target is its residual."""
    xs, ys = [f"x{i}" for i in range(len(_LINEAR))], ["y0", "y1"]
    steps = ["lb AS (SELECT video_id, fold, ln(1 + CAST(views AS DOUBLE)) AS y0, CAST(coalesce(engagement_rate, 0) AS DOUBLE) AS y1, "
             + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {x}" for c, x in zip(_LINEAR, xs)) + " FROM cf WHERE views > 0)",
             "l0 AS (SELECT k, video_id, fold <> k AS train, y0 AS t0, y1 AS t1, "
             + ", ".join(f"{c} - avg({c}) FILTER (fold <> k) OVER w AS {c}" for c in xs + ys)
             + " FROM lb, parts WINDOW w AS (PARTITION BY k))"]
    for i, x in enumerate(xs):
        rest = [f"{c} - {x} * coalesce(sum({c} * {x}) FILTER (train) OVER w / nullif(sum({x} * {x}) FILTER (train) OVER w, 0), 0) AS {c}"
                for c in xs[i + 1:] + ys]
        steps.append(f"l{i + 1} AS (SELECT k, video_id, train, t0, t1, {', '.join(rest)} FROM l{i} WINDOW w AS (PARTITION BY k))")
    steps.append("lp AS (SELECT video_id, round(greatest(exp(t0 - y0) - 1, 0)) AS ml_predicted_views, "
                 f"round(greatest(t1 - y1, 0), 9) AS ml_predicted_engagement_rate FROM l{len(xs)} WHERE NOT train)")
    return ",\n".join(steps)


PREDICTED = ("nlp_predicted_category", "nlp_category_confidence", "ml_predicted_views", "ml_predicted_engagement_rate")
SCORED_SQL = f"""{ANALYTICS_SQL.strip()},
{CATEGORY_SQL.strip()},
{_least_squares()},
enriched AS (SELECT * FROM analytics LEFT JOIN cp USING (video_id) LEFT JOIN lp USING (video_id))"""
ENRICHED_SQL = f"""{ANALYTICS_SQL.strip()},
enriched AS (SELECT * FROM analytics)"""


def with_tables(body: str, *names: str) -> str:
    """``body`` behind the common table expressions it needs."""
    ctes = []
    if "enriched" in names or "videos" in names:
        ctes.append(VIDEOS_SQL.strip())
    if "enriched" in names:
        scored = any(c in text for c in PREDICTED for text in (body, *names))
        ctes.append(SCORED_SQL if scored else ENRICHED_SQL)
    if "trending" in names:
        ctes.append(TRENDING_SQL.strip())
    if "docs" in names:
        ctes.append(DOCS_SQL.strip())
    if "events" in names:
        ctes.append(EVENTS_SQL.strip())
    more = [n for n in names if " AS " in n]
    return "WITH " + ",\n".join(ctes + more) + "\n" + body


def videos_sql(body: str, *more: str) -> str:
    return with_tables(body, "videos", *more)


def enriched_sql(body: str, *more: str) -> str:
    return with_tables(body, "enriched", *more)
