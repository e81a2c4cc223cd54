"""Queries on probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import scalars as f
from tallyfield.operators import probability as o
from tallyfield.operators import scorelines as sl
from tallyfield.operators import tables as t
from tallyfield.plans import fits
from tallyfield.sources import projections as p
from tallyfield.sources.projections import rounded, rsql, with_sql

c = F.col
NOW = 10_600


def _three(df, col, *keep):
    return df.select(*keep, *(rounded(F.get(c(col), F.lit(k))).alias(n) for k, n in enumerate(("home", "draw", "away"))))


def _elo(s, d):
    m = p.matches(s, d).withColumn("diff", (c("home") * 13 - c("away") * 7 + 60).cast("double"))
    seed = o.seeded_rating((1500 + c("diff")), F.when(c("event_id") % 3 > 0, 1600.0), F.when(c("event_id") % 5 > 0, c("event_id") % 40))
    return _three(m.withColumn("q", o.elo_probs(c("diff"))).withColumn("seeded", rounded(seed)), "q", "event_id", "seeded")


def _rates(s, d):
    return p.table(s, d, "customer").select(c("c_custkey").alias("id"), (0.4 + c("c_custkey") % 23 / 10).alias("lam"), (0.3 + c("c_custkey") % 17 / 10).alias("mu"))


def _grid(s, d):
    rho = F.lit(-0.13)
    names = ("home", "draw", "away", "over15", "over25", "over35", "both", "clean_home", "clean_away", "exp_home", "exp_away")
    best = sl.likeliest(sl.score_cells(c("lam"), c("mu"), rho))
    text = F.array_join(F.transform(best, lambda y: F.concat(y.h.cast("string"), F.lit("-"), y.a.cast("string"))), " ")
    x = sl.by_rates(_rates(s, d), x=sl.score_sums(c("lam"), c("mu"), rho), best=text)
    return x.select("id", *(rounded(c("x")[n]).alias(n) for n in names), "best")


def _cdf(s, d):
    x = sl.by_rates(_rates(s, d), cdf=F.transform(fits.score_cdf(c("lam"), c("mu"), F.lit(-0.13), sl.MOST), rounded))
    x = x.select("id", F.posexplode("cdf").alias("k", "cdf"))
    return x.select("id", F.floor(c("k") / (sl.MOST + 1)).cast("int").alias("h"), (c("k") % (sl.MOST + 1)).alias("a"), "cdf")


def _score_documents(s, d):
    """Score forecasts as they are stored: the likeliest scoreline, lines and the small grid's corners and sum."""
    x = sl.by_rates(_rates(s, d), x=sl.score_forecast(c("lam"), c("mu"), F.lit(-0.13)))
    cells = F.flatten("x.grid")
    return x.select(
        "id", c("x.expected_home").alias("exp_home"), c("x.expected_away").alias("exp_away"), c("x.likeliest.h").alias("h"), c("x.likeliest.a").alias("a"), c("x.likeliest.p").alias("p"), c("x.lines.over25").alias("over25"), c("x.lines.both").alias("both"),
        F.size("x.top").alias("named"), F.get(F.get("x.grid", F.lit(0)), F.lit(5)).alias("g05"), F.get(F.get("x.grid", F.lit(5)), F.lit(0)).alias("g50"), rounded(F.aggregate(cells, F.lit(0.0), lambda t, v: t + v)).alias("shown"),
    )


def _ranks(s, d):
    r = p.table(s, d, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 7 > 0, 1 + c("o_custkey") % 300).alias("rh"), F.when(c("o_orderkey") % 5 > 0, 1 + c("o_orderkey") % 400).alias("ra"))
    return r.select("id", rounded(o.rank_prob(c("rh"), c("ra"))).alias("p"), rounded(o.rating_of_rank(c("rh"))).alias("rating"))


def _sets(s, d):
    r = p.table(s, d, "part").select(c("p_partkey").alias("id"), ((1 + c("p_partkey") % 98) / 100).alias("s"), F.when(c("p_partkey") % 2 == 0, 5).otherwise(3).alias("best"))
    r = r.withColumn("m", o.match_of_set(c("s"), c("best")))
    return r.select("id", rounded(c("m")).alias("match"), rounded(o.set_of_match(c("m"), c("best"))).alias("back"), rounded(o.game_win(c("s"))).alias("game"))


def _blend(s, d):
    e = p.forecasts(s, d)
    a = F.array("p0", "p1", "p2")
    b = F.array(c("p2"), F.when(c("id") % 11 == 0, 0.0).otherwise(c("p0")), c("p1"))
    wa, wb = (c("id") % 4).cast("double"), (c("id") % 3).cast("double")
    q = f.clip_probs(f.temper(o.blend([(a, wa), (b, wb)]), F.lit(1.3)))
    e = e.withColumn("q", q)
    ev = F.when(c("id") % 4 == 0, 1.0).when(c("id") % 4 == 1, 0.85).when(c("id") % 4 == 2, 0.6).otherwise(0.4)
    return _three(e.withColumn("conf", rounded(o.confidence(c("q"), ev))), "q", "id", "conf")


def _shift(s, d):
    e = p.forecasts(s, d)
    return _three(e.withColumn("q", o.shift_home(F.array("p0", "p1", "p2"), (c("id") % 41 - 20).cast("double"))), "q", "id")


def _caps(s, d):
    e = p.table(s, d, "events").select("event_id", "user_id", (c("value") - 4).alias("effect"))
    return o.capped_effects(e, "user_id", "effect").select("event_id", rounded(c("capped")).alias("capped"))


def _margins(s, d):
    m = p.matches(s, d).filter("status = 'FINISHED'")
    rows = m.select("comp", "home", "away", (c("home") * 11 - c("away") * 9 + c("hs") * 5).cast("double").alias("gap"), (c("hs") - c("aws")).cast("double").alias("margin"), (c("hs") + c("aws")).cast("double").alias("total"))
    fit = o.margin_fit(rows, "comp")
    pr = o.margin_probs(c("edge") + c("slope") * 25, c("sigma"))
    return _three(fit.withColumn("q", pr).withColumns({n: rounded(c(n)) for n in ("slope", "edge", "sigma", "total")}), "q", "comp", "n", "slope", "edge", "sigma", "total")


def _stat_rates(s, d):
    st = p.match_stats(s, d).join(p.matches(s, d).select("event_id", "home", "away", "day"), "event_id")
    rows = st.select(F.when(c("side") == "HOME", c("home")).otherwise(c("away")).alias("team"), "side", "shots", (F.lit(NOW) - c("day")).alias("age"))
    return o.decayed_rates(rows, ["team", "side"], "shots", "age").select("team", "side", rounded(c("rate")).alias("rate"), rounded(c("w")).alias("w"))


def _pace(s, d):
    r = p.races(s, d).withColumn("race", c("season") * 12 + c("month"))
    return o.pace(r, F.lit(1999 * 12 + 1), 0.02).select("team", rounded(c("pace")).alias("pace"), rounded(c("dnf")).alias("dnf"))


def _names(s, d):
    x = p.table(s, d, "documents").select("doc_id", F.regexp_replace("text", "\n", " ").alias("n")).filter("n is not null")
    x = x.withColumn("n", F.concat(F.when(c("doc_id") % 3 == 0, "FC ").otherwise(""), c("n"), F.when(c("doc_id") % 4 == 0, " & Club").otherwise("")))
    both = f.let(f.unaccented(c("n")), lambda u: F.struct(f.normalise_name(u).alias("name"), f.slug(u).alias("slug")))  # accents go once for both
    return x.select("doc_id", both.alias("x")).select("doc_id", "x.name", "x.slug")


def _codes(s, d):
    e = p.table(s, d, "orders")
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    code = (c("o_orderkey") % 100).cast("int")
    cost = f.token_cost(c("o_custkey") * 100, c("o_custkey") * 10, c("o_orderkey") % 999, c("o_orderkey") % 77, 1.0, 4.0)
    return e.select("o_orderkey", f.season_label(y, m).alias("season"), f.season_code(y).alias("code"), f.weather_text(code).alias("weather"), rounded(cost).alias("cost"), f.half_up(c("o_totalprice") / 1000 - 100, 1).alias("r1"))


def _functions(s, d):
    e = p.table(s, d, "part").select(c("p_partkey").alias("id"), ((c("p_partkey") % 41 - 20) / 5).alias("x"), (c("p_partkey") % 9).alias("k"), (c("p_partkey") % 13 / 4).alias("rate"))
    return e.select("id", rounded(f.normal_cdf(c("x"), F.lit(0.25), F.lit(1.5))).alias("phi"), rounded(f.poisson_pmf(c("k"), c("rate"))).alias("pmf"), rounded(f.poisson_cdf(c("k"), c("rate"))).alias("cdf"), rounded(f.sigmoid(c("x"))).alias("sig"), rounded(f.logit(f.sigmoid(c("x")))).alias("back"), rounded(f.decay(c("x"), 0.3)).alias("decay"))


QUERIES = {
    "elo_probs": _elo, "score_grid": _grid, "grid_cdf": _cdf, "score_documents": _score_documents, "rank_probs": _ranks, "match_of_set": _sets, "blend": _blend, "shift_home": _shift,
    "capped_effects": _caps, "odds_consensus": lambda s, d: o.consensus(p.odds(s, d)), "margin_model": _margins, "stat_rates": _stat_rates, "race_pace": _pace,
    "names": _names, "codes": _codes, "functions": _functions,
    "outcome_labels": lambda s, d: p.matches(s, d).select("event_id", t.outcome().alias("outcome")),
}

D = "::DOUBLE"
_NORM = "(SELECT *, x0 + x1 + x2 AS sx FROM {})"
_FACT = "[" + ", ".join(f"ln(CAST(factorial({k}) AS DOUBLE))" for k in range(11)) + "]"
_GRID = f"""WITH rates AS (SELECT c_custkey AS id, 0.4::DOUBLE + CAST(c_custkey % 23 AS DOUBLE) / 10 AS lam, 0.3::DOUBLE + CAST(c_custkey % 17 AS DOUBLE) / 10 AS mu FROM customer),
  grid AS (SELECT id, CAST(h AS INT) AS h, CAST(a AS INT) AS a, greatest(0, exp(h * ln(lam) - lam - {_FACT}[h + 1]) * exp(a * ln(mu) - mu - {_FACT}[a + 1])
    * CASE WHEN h = 0 AND a = 0 THEN 1 - lam * mu * -0.13::DOUBLE WHEN h = 0 AND a = 1 THEN 1 + lam * -0.13::DOUBLE WHEN h = 1 AND a = 0 THEN 1 + mu * -0.13::DOUBLE
           WHEN h = 1 AND a = 1 THEN 1.13::DOUBLE ELSE 1.0::DOUBLE END) AS p FROM rates, range(11) x(h), range(11) y(a)) """


def _share(cond: str, name: str) -> str:
    return f"{rsql(f'sum(CASE WHEN {cond} THEN p ELSE 0 END) / sum(p)')} AS {name}"


def _phi(x: str) -> str:
    """The normal distribution function of x by the same polynomial."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * abs({x})))"
    poly = f"({f.ERFC[-1]}{D})"
    for a in f.ERFC[-2::-1]:
        poly = f"({poly} * {t} + ({a}{D}))"
    y = f"({t} * exp({poly} - ({x}) * ({x})))"
    return f"(0.5::DOUBLE * CASE WHEN ({x}) >= 0 THEN {y} ELSE 2.0::DOUBLE - {y} END)"


def _logit(x: str) -> str:
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({x})))"


_SET3, _SET5 = "{s} * {s} * (1 + 2 * (1 - {s}))", "{s} * {s} * {s} * (1 + 3 * (1 - {s}) + 6 * (1 - {s}) * (1 - {s}))"
_M = "CASE WHEN best = 5 THEN " + _SET5.format(s="s") + " ELSE " + _SET3.format(s="s") + " END"
_E = "(1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, -diff / 400.0::DOUBLE)))"
ORACLE_SQL = {
    "elo_probs": with_sql("matches", f""", x AS (SELECT event_id, CAST(home * 13 - away * 7 + 60 AS DOUBLE) AS diff FROM matches),
      y AS (SELECT event_id, diff, {_E} AS e, 0.28::DOUBLE * (1 - abs(2 * {_E} - 1)) AS dr, CASE WHEN event_id % 5 > 0 THEN event_id % 40 ELSE 10 END::DOUBLE AS g FROM x)
      SELECT event_id, {rsql("(g / (g + 10)) * (1500 + diff) + (1 - g / (g + 10)) * CASE WHEN event_id % 3 > 0 THEN 1600.0::DOUBLE ELSE 1500 + diff END")} AS seeded,
        {rsql("(1 - dr) * e")} AS home, {rsql("dr")} AS draw, {rsql("(1 - dr) * (1 - e)")} AS away FROM y"""),
    "score_grid": _GRID + f"""SELECT id, {_share("h > a", "home")}, {_share("h = a", "draw")}, {_share("h < a", "away")}, {_share("h + a > 1", "over15")}, {_share("h + a > 2", "over25")},
      {_share("h + a > 3", "over35")}, {_share("h > 0 AND a > 0", "both")}, {_share("a = 0", "clean_home")}, {_share("h = 0", "clean_away")},
      {rsql("sum(p * h) / sum(p)")} AS exp_home, {rsql("sum(p * a) / sum(p)")} AS exp_away,
      array_to_string(list_slice(list(concat(h, '-', a) ORDER BY -floor(p * 1000000000000.0::DOUBLE), h, a), 1, 8), ' ') AS best FROM grid GROUP BY id""",
    "score_documents": _GRID + f""", n AS (SELECT *, p / sum(p) OVER (PARTITION BY id) AS q, floor(p * 1000000000000.0::DOUBLE) AS k FROM grid), r AS (SELECT id, floor(lam * 100 + 0.5::DOUBLE) / 100 AS exp_home, floor(mu * 100 + 0.5::DOUBLE) / 100 AS exp_away FROM rates),
      t AS (SELECT *, floor(q * 10000 + 0.5::DOUBLE) / 10000 AS f FROM n)
      SELECT t.id, any_value(exp_home) AS exp_home, any_value(exp_away) AS exp_away, arg_min(h, (-k, h, a)) AS h, arg_min(a, (-k, h, a)) AS a, arg_min(f, (-k, h, a)) AS p, floor(sum(q) FILTER (h + a > 2) * 10000 + 0.5::DOUBLE) / 10000 AS over25, floor(sum(q) FILTER (h > 0 AND a > 0) * 10000 + 0.5::DOUBLE) / 10000 AS both,
        8 AS named, max(f) FILTER (h = 0 AND a = 5) AS g05, max(f) FILTER (h = 5 AND a = 0) AS g50, {rsql("sum(f) FILTER (h < 6 AND a < 6)")} AS shown FROM t JOIN r ON r.id = t.id GROUP BY t.id""",
    "grid_cdf": _GRID + f"SELECT id, h, a, {rsql('sum(p) OVER (PARTITION BY id ORDER BY h, a) / sum(p) OVER (PARTITION BY id)')} AS cdf FROM grid",
    "rank_probs": f"""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN 1 + o_custkey % 300 END AS rh, CASE WHEN o_orderkey % 5 > 0 THEN 1 + o_orderkey % 400 END AS ra FROM orders),
      y AS (SELECT *, {_logit("0.4::DOUBLE * (ln(coalesce(ra, 500)::DOUBLE) - ln(coalesce(rh, 500)::DOUBLE))")} AS q FROM x)
      SELECT id, {rsql("CASE WHEN rh IS NULL AND ra IS NULL THEN NULL ELSE least(greatest(CASE WHEN rh IS NULL OR ra IS NULL THEN 0.5::DOUBLE + 0.6::DOUBLE * (q - 0.5::DOUBLE) ELSE q END, 0.05::DOUBLE), 0.95::DOUBLE) END")} AS p,
        {rsql("1500 + 400 * 0.4::DOUBLE / ln(10.0::DOUBLE) * ln(100.0::DOUBLE / rh)")} AS rating FROM y""",
    "match_of_set": f"""WITH x AS (SELECT p_partkey AS id, CAST(1 + p_partkey % 98 AS DOUBLE) / 100 AS s, CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 3 END AS best FROM part)
      SELECT id, {rsql(_M)} AS match, {rsql("s")} AS back,
        {rsql("s*s*s*s * (1 + 4 * (1-s) + 10 * (1-s) * (1-s)) + 20 * s*s*s * (1-s)*(1-s)*(1-s) * (s*s / (s*s + (1-s)*(1-s)))")} AS game FROM x""",
    "blend": with_sql("forecasts", f""", w AS (SELECT *, CAST(id % 4 AS DOUBLE) AS wa, CASE WHEN id % 11 = 0 THEN 0 ELSE CAST(id % 3 AS DOUBLE) END AS wb FROM forecasts),
      l AS (SELECT *, wa + wb AS wt FROM w),
      b AS (SELECT id, CASE WHEN wt > 0 THEN exp((wa * ln(p0) + wb * ln(p2)) / wt) ELSE 1.0::DOUBLE END AS x0, CASE WHEN wt > 0 THEN exp((wa * ln(p1) + wb * ln(p0)) / wt) ELSE 1.0::DOUBLE END AS x1,
        CASE WHEN wt > 0 THEN exp((wa * ln(p2) + wb * ln(p1)) / wt) ELSE 1.0::DOUBLE END AS x2 FROM l),
      t AS (SELECT id, pow(x0 / sx, 1 / 1.3::DOUBLE) AS x0, pow(x1 / sx, 1 / 1.3::DOUBLE) AS x1, pow(x2 / sx, 1 / 1.3::DOUBLE) AS x2 FROM {_NORM.format("b")}),
      k AS (SELECT id, least(greatest(x0 / sx, 0.02::DOUBLE), 0.96::DOUBLE) AS x0, least(greatest(x1 / sx, 0.02::DOUBLE), 0.96::DOUBLE) AS x1, least(greatest(x2 / sx, 0.02::DOUBLE), 0.96::DOUBLE) AS x2 FROM {_NORM.format("t")})
      SELECT id, {rsql("floor((greatest(x0, x1, x2) / sx - 1 / 3.0::DOUBLE) / (1 - 1 / 3.0::DOUBLE) * [1.0::DOUBLE, 0.85::DOUBLE, 0.6::DOUBLE, 0.4::DOUBLE][id % 4 + 1] * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE")} AS conf,
        {rsql("x0 / sx")} AS home, {rsql("x1 / sx")} AS draw, {rsql("x2 / sx")} AS away FROM {_NORM.format("k")}"""),
    "shift_home": with_sql("forecasts", f""", x AS (SELECT *, least(greatest(p0 + CAST(id % 41 - 20 AS DOUBLE) / 100, 0.03::DOUBLE), 0.95::DOUBLE) AS t FROM forecasts)
      SELECT id, {rsql("t")} AS home, {rsql("p1 * (1 - t) / (1 - p0)")} AS draw, {rsql("p2 * (1 - t) / (1 - p0)")} AS away FROM x"""),
    "capped_effects": f"""WITH x AS (SELECT event_id, user_id, least(greatest(value - 4, -8), 8)::DOUBLE AS x FROM events), y AS (SELECT event_id, user_id, CAST(floor(x * 10 + 0.5::DOUBLE) AS BIGINT) AS t FROM x), z AS (SELECT *, abs(sum(t) OVER (PARTITION BY user_id)) AS s FROM y)
      SELECT event_id, {rsql("CASE WHEN s > 100 THEN floor(t * 100.0::DOUBLE / s + 0.5::DOUBLE) ELSE t END / 10.0::DOUBLE")} AS capped FROM z""",
    "odds_consensus": with_sql("odds", """, q AS (SELECT *, 1 / price / sum(1 / price) OVER (PARTITION BY event_id, book) AS q FROM odds WHERE price > 1),
      m AS (SELECT event_id, outcome, avg(q) AS m FROM q GROUP BY ALL)
      SELECT event_id, outcome, floor(m / sum(m) OVER (PARTITION BY event_id) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS p FROM m"""),
    "margin_model": with_sql("matches", f""", r AS (SELECT comp, CAST(home * 11 - away * 9 + hs * 5 AS DOUBLE) AS gap, CAST(hs - aws AS DOUBLE) AS margin, CAST(hs + aws AS DOUBLE) AS total FROM matches WHERE status = 'FINISHED'),
      m AS (SELECT comp, count(*) AS n, avg(gap) AS mg, avg(margin) AS mm, greatest(0.005::DOUBLE, covar_pop(gap, margin) / var_pop(gap)) AS slope, avg(total) AS total FROM r GROUP BY comp),
      e AS (SELECT *, mm - slope * mg AS edge FROM m),
      s AS (SELECT e.comp, e.n, e.slope, e.edge, e.total, greatest(1.0::DOUBLE, sqrt(sum((margin - edge - slope * gap) * (margin - edge - slope * gap)) / greatest(e.n - 2, 1))) AS sigma FROM e JOIN r ON r.comp = e.comp GROUP BY e.comp, e.n, e.slope, e.edge, e.total),
      z AS (SELECT *, (edge + slope * 25 + 0.5::DOUBLE) / (sigma * sqrt(2.0::DOUBLE)) AS lo, (edge + slope * 25 - 0.5::DOUBLE) / (sigma * sqrt(2.0::DOUBLE)) AS hi FROM s)
      SELECT comp, n, {rsql("slope")} AS slope, {rsql("edge")} AS edge, {rsql("sigma")} AS sigma, {rsql("total")} AS total,
        {rsql("1 - " + _phi("hi"))} AS home, {rsql(_phi("hi") + " - " + _phi("lo"))} AS draw, {rsql(_phi("lo"))} AS away FROM z"""),
    "stat_rates": with_sql("matches match_stats", f""", r AS (SELECT CASE WHEN side = 'HOME' THEN home ELSE away END AS team, side, shots, exp(-0.003::DOUBLE * greatest({NOW} - day, 0)) AS w FROM match_stats JOIN matches USING (event_id)),
      l AS (SELECT sum(w * shots) / sum(w) AS league FROM r)
      SELECT team, side, {rsql("(sum(w * shots) + 4 * any_value(league)) / (sum(w) + 4) / any_value(league)")} AS rate, {rsql("sum(w)")} AS w FROM r, l GROUP BY team, side"""),
    "race_pace": with_sql("races", f""", r AS (SELECT *, position > 20 AS dnf, exp(-0.02::DOUBLE * greatest(1999 * 12 + 1 - (season * 12 + month), 0)) AS w FROM races)
      SELECT team, {rsql("(coalesce(sum(w * greatest(1, 21 - position)) FILTER (NOT dnf), 0) + 16) / (coalesce(sum(w) FILTER (NOT dnf), 0) + 2)")} AS pace,
        {rsql("least(0.5::DOUBLE, (coalesce(sum(w) FILTER (dnf), 0) + 0.24::DOUBLE) / (sum(w) + 2))")} AS dnf FROM r GROUP BY team"""),
    "names": """WITH x AS (SELECT doc_id, replace(text, chr(10), ' ') AS n FROM documents),
      y AS (SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'FC ' ELSE '' END, n, CASE WHEN doc_id % 4 = 0 THEN ' & Club' ELSE '' END) AS n FROM x WHERE n IS NOT NULL),
      z AS (SELECT doc_id, n, trim(regexp_replace(replace(strip_accents(lower(n)), '&', ' and '), '[^a-z0-9'']+', ' ', 'g')) AS b FROM y),
      k AS (SELECT *, list_filter(string_split(b, ' '), lambda w: w NOT IN ('', """ + ", ".join(f"'{w}'" for w in f.STOP_WORDS) + """)) AS kept FROM z)
      SELECT doc_id, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE b END AS name, regexp_replace(regexp_replace(strip_accents(lower(n)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM k""",
    "codes": f"""WITH x AS (SELECT *, CAST(year(o_orderdate) AS INT) AS y, month(o_orderdate) AS m, CAST(o_orderkey % 100 AS INT) AS w FROM orders)
      SELECT o_orderkey, concat(CASE WHEN m >= 7 THEN y ELSE y - 1 END, '/', lpad(CAST((CASE WHEN m >= 7 THEN y ELSE y - 1 END + 1) % 100 AS VARCHAR), 2, '0')) AS season,
        concat(lpad(CAST(y % 100 AS VARCHAR), 2, '0'), lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')) AS code,
        CASE WHEN w = 0 THEN 'clear' {" ".join(f"WHEN w <= {k} THEN '{v}'" for k, v in f.WEATHER[1:])} ELSE 'thunderstorm' END AS weather,
        {rsql("(o_custkey * 90 + o_custkey * 10 * 0.25::DOUBLE + (o_orderkey % 999 + o_orderkey % 77) * 4) / 1000000.0::DOUBLE")} AS cost,
        floor((o_totalprice / 1000 - 100) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS r1 FROM x""",
    "functions": f"""WITH e AS (SELECT p_partkey AS id, CAST(p_partkey % 41 - 20 AS DOUBLE) / 5 AS x, p_partkey % 9 AS k, CAST(p_partkey % 13 AS DOUBLE) / 4 AS rate FROM part)
      SELECT id, {rsql(_phi("((0.25::DOUBLE - x) / (1.5::DOUBLE * sqrt(2.0::DOUBLE)))"))} AS phi,
        {rsql(f"CASE WHEN rate <= 0 THEN CAST(k = 0 AS INT)::DOUBLE ELSE exp(k * ln(rate) - rate - {_FACT}[k + 1]) END")} AS pmf,
        {rsql(f"CASE WHEN rate <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum([exp(i * ln(rate) - rate - {_FACT}[i + 1]) FOR i IN range(k + 1)])) END")} AS cdf,
        {rsql(_logit("x"))} AS sig, {rsql("x")} AS back, {rsql("exp(-0.3::DOUBLE * greatest(x, 0))")} AS decay FROM e""",
    "outcome_labels": with_sql("matches", "SELECT event_id, CASE WHEN hs > aws THEN 'HOME' WHEN hs < aws THEN 'AWAY' ELSE 'DRAW' END AS outcome FROM matches"),
}
