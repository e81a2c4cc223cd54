"""Queries on tables, history and form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.operators import tables as t
from tallyfield.sources import projections as p
from tallyfield.sources.projections import rounded, rsql, with_sql

c = F.col
POINTS = [25, 18, 15, 12, 10, 8, 6, 4, 2, 1]
CUT, BEFORE = 10_000, 9_500
TABLE = ["comp", "season", "team", "position", "played", "won", "drawn", "lost", "scored", "conceded", "points", "form"]


def _r(df, *names):
    return df.withColumns({n: rounded(c(n)) for n in names})


QUERIES = {
    "league_table": lambda s, d: t.league_table(p.matches(s, d)).select(TABLE),
    "table_as_of": lambda s, d: t.table_as_of(p.matches(s, d), CUT).select(TABLE),
    "table_zones": lambda s, d: t.zones(t.league_table(p.matches(s, d))).select("comp", "season", "team", "position", "zone"),
    "championship_table": lambda s, d: t.championship_table(p.races(s, d), POINTS),
    "latest_ranks": lambda s, d: t.latest_ranks(p.ratings(s, d), CUT, 120),
    "ranking_table": lambda s, d: t.ranking_table(p.matches(s, d), p.ratings(s, d)),
    "outcome_frequencies": lambda s, d: _r(t.outcome_frequencies(p.matches(s, d)), "home", "draw", "away"),
    "match_history": lambda s, d: t.history(p.matches(s, d), p.match_stats(s, d), BEFORE).select("event_id", "comp", "home", "away", "hs", "aws", "home_shots", "home_lines", "away_shots", "away_lines"),
    "race_history": lambda s, d: p.races(s, d).groupBy("season", "month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "team"))), lambda x: x.team.cast("string")), ",").alias("finish"), F.count("*").alias("starters")),
    "recent_form": lambda s, d: _r(t.recent_form(p.matches(s, d)), "ppg", "gdpg"),
    "head_to_head": lambda s, d: _r(t.head_to_head(p.matches(s, d)), "edge"),
    "trailing_baseline": lambda s, d: t.trailing_baseline(p.matches(s, d)),
}

_ROWS = """sides AS (
    SELECT event_id, comp, season, day, status, home AS team, away AS opponent, 'H' AS venue, hs AS scored, aws AS conceded FROM matches
    UNION ALL SELECT event_id, comp, season, day, status, away, home, 'A', aws, hs FROM matches)"""


def _table(where: str = "") -> str:
    return with_sql("matches", f""",
  {_ROWS.replace('FROM matches', f'FROM matches {where}')},
  sums AS (SELECT comp, season, team,
      count(*) FILTER (status = 'FINISHED') AS played, count(*) FILTER (status = 'FINISHED' AND scored > conceded) AS won,
      count(*) FILTER (status = 'FINISHED' AND scored = conceded) AS drawn, count(*) FILTER (status = 'FINISHED' AND scored < conceded) AS lost,
      CAST(coalesce(sum(scored) FILTER (status = 'FINISHED'), 0) AS BIGINT) AS scored,
      CAST(coalesce(sum(conceded) FILTER (status = 'FINISHED'), 0) AS BIGINT) AS conceded FROM sides GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY comp, season, team ORDER BY day DESC, event_id DESC) AS k FROM sides WHERE status = 'FINISHED'),
  form AS (SELECT comp, season, team, string_agg(CASE WHEN scored > conceded THEN 'W' WHEN scored < conceded THEN 'L' ELSE 'D' END, '' ORDER BY k DESC) AS form
           FROM ranked WHERE k <= 5 GROUP BY ALL)
  SELECT comp, season, team, CAST(row_number() OVER (PARTITION BY comp, season ORDER BY won * 3 + drawn DESC, scored - conceded DESC, scored DESC, team) AS INT) AS position,
      played, won, drawn, lost, scored, conceded, won * 3 + drawn AS points, coalesce(form, '') AS form
  FROM sums LEFT JOIN form USING (comp, season, team)""").replace(")\n,", "),")  # fmt: skip


_PAST = "SELECT s.*, {} FROM sides s"
ORACLE_SQL = {
    "league_table": _table(),
    "table_as_of": _table(f"WHERE day < {CUT}"),
    "table_zones": f"""WITH t AS ({_table()}), n AS (SELECT *, count(*) OVER (PARTITION BY comp, season) AS n FROM t)
      SELECT comp, season, team, position, CASE WHEN n < 10 THEN NULL
        WHEN position <= CASE WHEN n >= 16 THEN 4 WHEN n >= 12 THEN 3 ELSE 2 END THEN 'TOP'
        WHEN position > n - CASE WHEN n >= 18 THEN 3 ELSE 2 END THEN 'BOTTOM' END AS zone FROM n""",
    "championship_table": with_sql("races", f""", sums AS (
      SELECT season, team, CAST(sum(coalesce(([{", ".join(map(str, POINTS))}])[position], 0)) AS BIGINT) AS points,
        count(*) FILTER (position = 1) AS wins, count(*) FILTER (position <= 3) AS podiums,
        count(*) FILTER (position > 20) AS retired, count(*) AS starts FROM races GROUP BY ALL)
      SELECT *, CAST(row_number() OVER (PARTITION BY season ORDER BY points DESC, wins DESC, podiums DESC, team) AS INT) AS position FROM sums""").replace(")\n,", "),"),
    "latest_ranks": with_sql("ratings", f"""SELECT team, arg_max(value, (as_of, id)) AS rank, max(as_of) AS as_of FROM ratings
      WHERE as_of <= {CUT} AND as_of >= {CUT} - 120 GROUP BY team"""),
    "ranking_table": with_sql("matches ratings", f""", {_ROWS}, sums AS (
      SELECT season, team, count(*) AS played, count(*) FILTER (scored > conceded) AS won FROM sides WHERE status = 'FINISHED' GROUP BY ALL),
      r AS (SELECT team, arg_max(value, (as_of, id)) AS rank FROM ratings GROUP BY team)
      SELECT team, season, played, won, rank, CAST(row_number() OVER (PARTITION BY season ORDER BY rank NULLS LAST, won DESC, team) AS INT) AS position
      FROM sums LEFT JOIN r USING (team)""").replace(")\n,", "),"),
    "outcome_frequencies": with_sql("matches", f"""SELECT comp, count(*) AS n,
      {rsql("(count(*) FILTER (hs > aws) + 40.0::DOUBLE * 0.45::DOUBLE) / (count(*) + 40)")} AS home,
      {rsql("(count(*) FILTER (hs = aws) + 40.0::DOUBLE * 0.26::DOUBLE) / (count(*) + 40)")} AS draw,
      {rsql("(count(*) FILTER (hs < aws) + 40.0::DOUBLE * 0.29::DOUBLE) / (count(*) + 40)")} AS away
      FROM matches WHERE status = 'FINISHED' GROUP BY comp"""),
    "match_history": with_sql("matches match_stats", f"""SELECT m.event_id, comp, home, away, hs, aws, h.shots AS home_shots, h.lines AS home_lines,
      a.shots AS away_shots, a.lines AS away_lines FROM matches m
      LEFT JOIN match_stats h ON h.event_id = m.event_id AND h.side = 'HOME' LEFT JOIN match_stats a ON a.event_id = m.event_id AND a.side = 'AWAY'
      WHERE status = 'FINISHED' AND day < {BEFORE}"""),
    "race_history": with_sql("races", "SELECT season, month, string_agg(CAST(team AS VARCHAR), ',' ORDER BY position) AS finish, count(*) AS starters FROM races GROUP BY ALL"),
    "recent_form": with_sql("matches", f""", {_ROWS}, done AS (SELECT * FROM sides WHERE status = 'FINISHED'),
      past AS (SELECT event_id, team, venue, day, max(day) OVER w AS prev,
        list(struct_pack(day := day, event_id := event_id, scored := scored, conceded := conceded)) OVER w AS l FROM done
        WINDOW w AS (PARTITION BY team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      last AS (SELECT event_id, team, venue, day, prev, list_slice(list_reverse_sort(coalesce(l, [])), 1, 5) AS l FROM past)
      SELECT event_id, team, venue, CAST(len(l) AS INT) AS k,
        {rsql("CASE WHEN len(l) > 0 THEN CAST(list_sum([CASE WHEN x.scored > x.conceded THEN 3 WHEN x.scored = x.conceded THEN 1 ELSE 0 END FOR x IN l]) AS DOUBLE) / len(l) ELSE 1.3::DOUBLE END")} AS ppg,
        {rsql("CASE WHEN len(l) > 0 THEN CAST(list_sum([x.scored - x.conceded FOR x IN l]) AS DOUBLE) / len(l) ELSE 0.0::DOUBLE END")} AS gdpg,
        CASE WHEN prev IS NULL THEN 7 ELSE least(greatest(day - prev, 1), 14) END AS rest FROM last""").replace(")\n,", "),"),
    "head_to_head": with_sql("matches", f""", done AS (SELECT * FROM matches WHERE status = 'FINISHED'),
      past AS (SELECT event_id, home, list(struct_pack(day := day, event_id := event_id, home := home, hs := hs, aws := aws)) OVER (
        PARTITION BY least(home, away), greatest(home, away) ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM done),
      last AS (SELECT event_id, home, list_slice(list_reverse_sort(coalesce(l, [])), 1, 6) AS l FROM past)
      SELECT event_id, CAST(len(l) AS INT) AS met,
        {rsql("CASE WHEN len(l) > 0 THEN CAST(list_sum([sign(x.hs - x.aws) * CASE WHEN x.home = last.home THEN 1 ELSE -1 END FOR x IN l]) AS DOUBLE) / len(l) ELSE 0.0::DOUBLE END")} AS edge FROM last""").replace(")\n,", "),"),
    "trailing_baseline": with_sql("matches", """SELECT event_id, comp, CAST(floor(day / 7.0::DOUBLE) AS INT) AS chunk,
      CAST(coalesce(sum(CAST(hs > aws AS INT)) OVER w, 0) AS BIGINT) AS home, CAST(coalesce(sum(CAST(hs = aws AS INT)) OVER w, 0) AS BIGINT) AS draw,
      CAST(coalesce(sum(CAST(hs < aws AS INT)) OVER w, 0) AS BIGINT) AS away FROM matches WHERE status = 'FINISHED'
      WINDOW w AS (PARTITION BY comp ORDER BY day, event_id ROWS BETWEEN 380 PRECEDING AND 1 PRECEDING)"""),
}
