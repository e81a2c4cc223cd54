"""Column functions: special functions, probabilities, names, seasons and codes.  All stay inside Catalyst."""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounding half towards plus infinity, as opposed to ``round``."""
    s = 10.0**digits
    return F.floor(x * s + 0.5) / s


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    q = clamp(p, 1e-9, 1 - 1e-9)
    return F.log(q / (1.0 - q))


def ln_factorial(k: Column, most: int = 170) -> Column:
    """ln k! for 0 <= k <= most, from a table; null beyond."""
    return F.get(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(most + 1))), k.cast("int"))


def poisson_pmf(k: Column, rate: Column, most: int = 170) -> Column:
    """P(X = k); a rate of 0 or less has all its mass at 0, and no negative number any."""
    p = F.exp(k * F.log(rate) - rate - ln_factorial(k, most))
    return F.when(k < 0, 0.0).when(rate <= 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(p)


def poisson_cdf(k: Column, rate: Column, most: int = 170) -> Column:
    terms = F.transform(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(0))), lambda i: poisson_pmf(i, rate, most))
    return F.when(k < 0, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def poisson_quantile(p: Column, rate: Column, most: int = 500) -> Column:
    """The smallest k with P(X <= k) >= p, ``most`` if there is none below.  Each term comes from the one before.  Terms are
    looked at up to the mean and ten times its root and twenty, beyond which less is left than a double can tell; where p is
    so near to 1 that this does not do, up to ``most``."""
    mean = F.greatest(rate, F.lit(0.0))
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))

    def step(s, k):
        term = s.term * mean / k
        return F.when(s["sum"] >= p, s).otherwise(F.struct(k.alias("k"), term.alias("term"), (s["sum"] + term).alias("sum")))

    reach = F.when(p < 1 - 1e-9, F.least(F.lit(most), F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int"))).otherwise(most)
    return F.aggregate(F.sequence(F.lit(1), reach), start, step, lambda s: F.when((s["sum"] < p), most).otherwise(s.k))


#: The coefficients of the rational approximation of the normal quantile (relative error below 1.15e-9),
#: highest power first: numerator and denominator of the middle, then of the tails.
QUANTILE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732537343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661990416e00, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile; minus or plus infinity at 0 and 1 and beyond."""
    def poly(coefficients, x):
        out = F.lit(coefficients[0])
        for a in coefficients[1:]:
            out = out * x + a
        return out

    middle, below, tail, under = QUANTILE
    q = p - 0.5
    far = let(F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p))), lambda x: poly(tail, x) / poly(under, x))
    near = let(q * q, lambda r: q * poly(middle, r) / poly(below, r))
    inside = F.when(p < 0.02425, far).when(p > 1 - 0.02425, -far).otherwise(near)
    return F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).otherwise(inside)


def softmax(x: Column) -> Column:
    """Shares of an array of logits, from which the largest is taken first."""
    return let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))


#: The coefficients of the rational approximation of erfc (error below 1.2e-7), lowest power first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    poly = F.lit(ERFC[-1])
    for a in ERFC[-2::-1]:
        poly = poly * t + a
    y = t * F.exp(poly - x * x)
    return F.when(x >= 0, y).otherwise(2.0 - y)


def normal_cdf(x: Column, mean: Column, sd: Column) -> Column:
    """A standard deviation of 0 or less is a step at the mean."""
    step = F.when(x >= mean, 1.0).otherwise(0.0)
    return F.when(sd <= 0, step).otherwise(0.5 * erfc((mean - x) / (sd * math.sqrt(2))))


def decay(days: Column, xi: float) -> Column:
    return F.exp(-xi * F.greatest(days, F.lit(0)))


def let(x: Column, body) -> Column:
    """``body`` of ``x``, with ``x`` in the plan once however often the body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def normalise(probs: Column) -> Column:
    """An array of shares that sums to 1; negative ones count as 0, and an array without a positive sum stays as it is."""
    def body(p):
        up = F.transform(p, lambda x: F.greatest(x, F.lit(0.0)))
        return let(F.struct(up.alias("up"), F.aggregate(up, F.lit(0.0), lambda s, x: s + x).alias("sum")), lambda q: F.when(q.sum > 0, F.transform(q.up, lambda x: x / q.sum)).otherwise(p))

    return let(probs, body)


def clip_probs(probs: Column, low: float = 0.02, high: float = 0.96) -> Column:
    """Clipped, then made to sum to 1 again, so the bounds hold only about."""
    return normalise(F.transform(probs, lambda x: clamp(x, low, high)))


def temper(probs: Column, t: Column) -> Column:
    """p^(1/T), made to sum to 1; shares are 1e-9 at least.  A T of 1, of 0 or less, or none leaves them as they are."""
    use = F.coalesce((t > 0) & (F.abs(t - 1) >= 1e-6) & ~F.isnan(t.cast("double")), F.lit(False))
    return F.when(use, normalise(F.transform(probs, lambda x: F.pow(F.greatest(x, F.lit(1e-9)), 1.0 / t)))).otherwise(probs)



@lru_cache(1)
def accents() -> tuple[str, str]:
    """(letters, their plain forms) of the small letters that Unicode decomposes into one of a-z and marks."""
    out = {}
    for x in map(chr, range(0xC0, 0x2000)):
        d = unicodedata.normalize("NFD", x)
        if len(d) > 1 and d[0] in "abcdefghijklmnopqrstuvwxyz" and all(map(unicodedata.combining, d[1:])):
            out[x] = d[0]
    return "".join(out), "".join(out.values())


def unaccented(text: Column) -> Column:
    """Lower case without accents: composed letters are decomposed, then all marks go.  Texts of ASCII alone have none."""
    plain = lambda x: F.regexp_replace(F.translate(x, *accents()), "[\u0300-\u036f]", "")
    return let(F.lower(text), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(plain(x)))


#: Words that names of teams do without.
STOP_WORDS = ("fc", "afc", "cf", "sc", "ac", "as", "ss", "us", "sv", "bk", "if", "fk", "cd", "rc", "club", "de", "the", "football", "calcio", "women", "rfc", "rlfc", "cc", "united", "utd")
#: Names that are written in several ways, and the one that counts.
ALIASES = {
    "man city": "manchester city",
    "man utd": "manchester",
    "man united": "manchester",
    "manchester united": "manchester",
    "spurs": "tottenham hotspur",
    "wolverhampton wanderers": "wolves",
    "wolverhampton": "wolves",
    "brighton hove albion": "brighton",
    "brighton and hove albion": "brighton",
    "west ham united": "west ham",
    "newcastle united": "newcastle",
    "leeds united": "leeds",
    "sheffield united": "sheffield utd",
    "nottingham forest": "nott'm forest",
    "nott m forest": "nott'm forest",
    "nottm forest": "nott'm forest",
    "inter milan": "inter",
    "internazionale": "inter",
    "fc internazionale milano": "inter",
    "paris saint germain": "psg",
    "paris saint-germain": "psg",
    "bayern munchen": "bayern munich",
    "fc bayern munchen": "bayern munich",
    "borussia monchengladbach": "gladbach",
    "atletico de madrid": "atletico madrid",
    "club atletico de madrid": "atletico madrid",
    "real sociedad de futbol": "real sociedad",
    "athletic club": "athletic bilbao",
}


def normalise_name(name: Column) -> Column:
    """Lower case without accents and symbols but the apostrophe, by its usual name if it has one, and without words like
    "fc"; a name of such words only keeps them."""
    plain = F.replace(unaccented(name), F.lit("&"), F.lit(" and "))
    plain = F.trim(F.regexp_replace(plain, r"[^a-z0-9']+", " "))
    known = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    kept = lambda usual: F.filter(F.split(usual, " "), lambda w: ~w.isin("", *STOP_WORDS))
    chosen = lambda usual: let(kept(usual), lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(usual))
    return let(let(plain, lambda x: F.coalesce(known[x], x)), chosen)  # each step once, however long the name


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(unaccented(name), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def spaced(name: Column) -> Column:
    """Compact names with blanks before inner capitals."""
    return F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2")


def season_label(year: Column, month: Column) -> Column:
    """The season that a month is in, from July on: 2024/25."""
    y = F.when(month >= 7, year).otherwise(year - 1)
    return F.concat(y.cast("string"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def season_code(year: Column) -> Column:
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(year), two(year + 1))


def compact_date(text: Column) -> Column:
    """yyyymmdd as a date; null for anything but eight digits that are one."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd"))).cast("date")


def redact(text: Column) -> Column:
    """Text without what looks like a key, cut after 300 characters."""
    out = F.regexp_replace(text, r"(?i)key=[^&\s\"']+", "key=***")
    out = F.regexp_replace(out, r"(AIza|sk-ant-)[0-9A-Za-z_-]{10,}", "***")
    return F.when(F.length(out) > 300, F.concat(F.substring(out, 1, 300), F.lit("..."))).otherwise(out)


def token_cost(prompt: Column, cached: Column, output: Column, thinking: Column, price_in: float, price_out: float) -> Column:
    """Cost of a call by prices for a million tokens; cached input costs a quarter."""
    return ((prompt - cached) * price_in + cached * price_in * 0.25 + (output + thinking) * price_out) / 1e6


#: The last weather code of each kind.
WEATHER = ((0, "clear"), (2, "partly cloudy"), (3, "overcast"), (49, "fog"), (59, "drizzle"), (69, "rain"), (79, "snow"), (84, "showers"), (94, "snow showers"))


def weather_text(code: Column) -> Column:
    """A weather code's kind; null for null."""
    out = F.when(code.isNull(), F.lit(None))
    for last, text in WEATHER:
        out = out.when(code <= last if last else code == 0, text)
    return out.otherwise("thunderstorm")


#: The surfaces that formats name.
SURFACES = ("Hard", "Clay", "Grass", "Carpet")


def match_format(text: Column) -> Column:
    """surface and best_of of a format like "Clay BO5"; what cannot be read is a hard court and best of three."""
    word = F.initcap(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
    surface = F.coalesce(F.when(word.isin(*SURFACES), word), F.lit("Hard"))
    return F.struct(surface.alias("surface"), F.when(F.coalesce(text.rlike("(?i)BO5"), F.lit(False)), 5).otherwise(3).alias("best_of"))


def classified(status: Column) -> Column:
    """Did an entrant finish: no status, "Finished" or some laps behind."""
    return status.isNull() | (status == "Finished") | status.rlike(r"^\+\d+ Laps?$")


def wall_to_utc(local: Column, zone: str | Column) -> Column:
    """The instant at which clocks of a zone show a time.  The zone's offset is looked up twice: at the time taken as UTC, then
    at the instant that this gives.  In an hour that is left out it is the instant before, in one that comes twice the first."""
    micros = lambda t: F.unix_micros(t)
    offset = lambda t: micros(F.from_utc_timestamp(t, zone)) - micros(t)
    guess = F.timestamp_micros(micros(local) - offset(local))
    return F.timestamp_micros(micros(local) - offset(guess))


def run_times(text: Column) -> Column:
    """Minutes of the day of a list like "07:00, 19:30", each once and in order; entries that are no time are left out."""
    parts = F.filter(F.split(text, r"[,\s;]+"), lambda p: p.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$"))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.substring_index(p, ":", 1).cast("int") * 60 + F.substring_index(p, ":", -1).cast("int"))))


def run_times_text(minutes: Column) -> Column:
    """Minutes of the day as a list like "07:00,19:30"."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.array_join(F.transform(minutes, lambda m: F.concat(two(F.floor(m / 60).cast("int")), F.lit(":"), two(m % 60))), ",")


def instants_between(after: Column, upto: Column, minutes: Column, zone: str | Column) -> Column:
    """The instants, in order, at which clocks of a zone show one of the times (minutes of the day), after one instant and up to
    another: local days from the day before the first to the day after the last, times the run times."""
    day = lambda t: F.from_utc_timestamp(t, zone).cast("date")
    days = F.sequence(F.date_sub(day(after), 1), F.date_add(day(upto), 1))
    at = lambda d, m: wall_to_utc(F.timestamp_micros(F.unix_date(d).cast("bigint") * 86_400_000_000 + m.cast("bigint") * 60_000_000), zone)
    each = F.flatten(F.transform(days, lambda d: F.transform(minutes, lambda m: at(d, m))))
    return F.when(after < upto, F.array_sort(F.array_distinct(F.filter(each, lambda t: (t > after) & (t <= upto))))).otherwise(F.array().cast("array<timestamp>"))


def day_key(at: Column, zone: str) -> Column:
    """The local day of an instant, yyyy-MM-dd."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def month_start(at: Column, zone: str) -> Column:
    """The instant at which the local month of an instant began."""
    return wall_to_utc(F.date_trunc("month", F.from_utc_timestamp(at, zone)), zone)


def json_object(text: Column) -> Column:
    """The JSON object in a text that may have a fence or prose around it, as text; null without one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(inner, "$").isNotNull(), inner)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th ... 11th, 12th, 13th."""
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def shortened(text: Column, most: int) -> Column:
    """A text of ``most`` characters at most, the last of which is an ellipsis if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def binomial(n: Column, k: Column) -> Column:
    """n over k, from ln k!; 0 outside 0..n."""
    inside = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k))
    return F.when((k < 0) | (k > n), 0.0).otherwise(F.floor(inside + 0.5).cast("double"))
