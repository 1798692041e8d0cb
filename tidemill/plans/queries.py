"""One query for each operator over the driver's tables, and the SQL that gives the same rows.

Samples: customer lines and document texts; timeline: events.ts; lookups: nation. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import envelope, identity, rate, timeexpr, tokens
from ..functions.draw import below, draw
from ..operators import replay, rotate, sinks, spine, template
from ..sources import conf, ini, samples
from . import generate

START, HOURS, SEED = 1704067200, 48, 7
RATES = {"hourOfDayRate": "{" + ",".join(f'"{h}":{(h % 4 + 1) * 0.5}' for h in range(24)) + "}"}
ALL_RATES = {**RATES, "dayOfWeekRate": '{"0":0.1,"5":3.0}', "minuteOfHourRate": '{"0":2.0,"30":0.5}', "dayOfMonthRate": '{"1":1.5}', "monthOfYearRate": '{"1":0.25,"2":4.0}'}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sample(spark: SparkSession, d: str) -> DataFrame:
    """customer as a sample file: a line for each customer, in key order."""
    line = F.concat(F.lit("user="), F.col("c_custkey").cast("string"), F.lit(" seg="), F.col("c_mktsegment"))
    keyed = t(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), line.alias("raw"))
    return spine.match_rank(keyed, F.lit(True), "line_no").select("line_no", "raw", (F.octet_length("raw").cast("bigint") + 1).alias("size"))


def lines_n(s: DataFrame) -> int:
    return s.count()


def counted(spark: SparkSession, base: int = 25) -> DataFrame:
    g = spine.intervals(spark, START, START + HOURS * 3600, 3600)
    f = rate.factor(RATES, F.timestamp_seconds("t"))
    return spine.with_offsets(g.withColumn("n", rate.rated_count(F.lit(base), f)))


def spine_rows(spark: SparkSession, base: int = 25) -> DataFrame:
    return spine.events(counted(spark, base))


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as log lines; ordinal is the event's id."""
    raw = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(" status=200 ip=0.0.0.0 user="), F.col("user_id").cast("string"), F.lit(" type="), F.col("event_type"))
    return t(spark, d, "events").select(F.col("event_id").alias("ordinal"), "ts", "user_id", "event_type", "value", "props", raw.alias("raw"))


CUSTOMER = "lines AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line_no, 'user=' || c_custkey || ' seg=' || c_mktsegment AS raw FROM customer), n AS (SELECT count(*) AS n FROM lines)"
GRID = f"""grid AS (SELECT i AS interval_no, {START} + i * 3600 AS t, least({START} + (i + 1) * 3600, {START + HOURS * 3600}) AS lt, round_even(25 * ((i % 24) % 4 + 1) * 0.5, 0)::BIGINT AS n FROM range({HOURS}) r(i)),
off AS (SELECT *, coalesce(sum(n) OVER (ORDER BY interval_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM grid),
spine AS (SELECT interval_no, t, lt, n, i, first + i AS ordinal FROM off, LATERAL (SELECT unnest(range(n)) AS i))"""
RAW = "ev AS (SELECT event_id AS ordinal, ts, user_id, event_type, value, props, 'id=' || event_id || ' status=200 ip=0.0.0.0 user=' || user_id || ' type=' || event_type AS raw FROM events)"


def sql_draw(stanza: str, token: str, ordinal: str = "ordinal") -> str:
    return f"('0x' || substr(md5('{SEED}|{stanza}|{token}|' || {ordinal}), 1, 15))::BIGINT"


def sql_md5(token: str) -> str:
    return f"md5('{SEED}|s|{token}|' || ordinal)"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@register(f"WITH {CUSTOMER}, {GRID} SELECT interval_no, i, ordinal, lines.line_no, lines.raw FROM spine, n, lines WHERE lines.line_no = i % n.n")
def spine_sequential(spark, d):
    s = sample(spark, d)
    return spine.on_line(spine_rows(spark), s, F.pmod(F.col("i"), F.lit(lines_n(s)))).select("interval_no", "i", "ordinal", "line_no", "raw")


@register(f"WITH {CUSTOMER}, {GRID} SELECT interval_no, i, ordinal, lines.line_no, lines.raw FROM spine, n, lines WHERE lines.line_no = ordinal % n.n")
def spine_rotating_ordinal(spark, d):
    s = sample(spark, d)
    return spine.on_line(spine_rows(spark), s, F.pmod(F.col("ordinal"), F.lit(lines_n(s)))).select("interval_no", "i", "ordinal", "line_no", "raw")


@register(f"WITH {CUSTOMER}, {GRID} SELECT ordinal, lines.line_no, lines.raw FROM spine, n, lines WHERE lines.line_no = {sql_draw('s', 'line')} % n.n")
def spine_random_lines(spark, d):
    s = sample(spark, d)
    return spine.on_line(spine_rows(spark), s, below(draw(SEED, "s", "line", F.col("ordinal")), lines_n(s))).select("ordinal", "line_no", "raw")


@register(f"WITH {CUSTOMER} SELECT copy, line_no, raw, copy * n.n + line_no AS ordinal FROM lines, n, range(3) c(copy)")
def spine_bundle(spark, d):
    s = sample(spark, d)
    n = lines_n(s)
    copies = spine.events(spark.createDataFrame([(3 * n, 0)], "n long, first long"))
    return spine.on_line(copies, s, F.pmod(F.col("i"), F.lit(n))).select(F.expr(f"i div {n}").alias("copy"), "line_no", "raw", "ordinal")


BUDGET = 100_000


@register(
    f"""WITH {CUSTOMER}, p AS (SELECT line_no, raw, (sum(strlen(raw) + 1) OVER (ORDER BY line_no))::BIGINT AS prefix FROM lines), tot AS (SELECT max(prefix) AS total FROM p)
SELECT cycle, line_no, raw FROM p, tot, range({BUDGET} // (SELECT total FROM tot) + 1) c(cycle) WHERE cycle < {BUDGET} // total OR prefix <= {BUDGET} % total"""
)
def bytefill_sequential(spark, d):
    return spine.byte_fill(sample(spark, d), BUDGET).select("cycle", "line_no", "raw")


@register(
    f"""WITH {CUSTOMER}, w AS (SELECT i AS interval_no, 9000 + 4000 * i AS bytes FROM range(12) r(i)), ch AS (SELECT interval_no, f AS fill_no, least(16384, bytes - f * 16384) AS fill_bytes FROM w, LATERAL (SELECT unnest(range((bytes + 16383) // 16384)) AS f)),
pick AS (SELECT interval_no, fill_no, fill_bytes, p AS pick_no, ('0x' || substr(md5('{SEED}|s|fill|' || interval_no || '/' || fill_no || '/' || p), 1, 15))::BIGINT % n.n AS line_no FROM ch, range(2000) r(p), n),
run AS (SELECT interval_no, fill_no, pick_no, line_no, raw, fill_bytes, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY interval_no, fill_no ORDER BY pick_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM pick JOIN lines USING (line_no))
SELECT interval_no, fill_no, pick_no, raw FROM run WHERE before < fill_bytes"""
)
def bytefill_random(spark, d):
    s = sample(spark, d)
    n, least = s.agg(F.count("*"), F.min("size")).first()
    wanted = spark.range(12).select(F.col("id").alias("interval_no"), (9000 + 4000 * F.col("id")).alias("bytes"))
    pick = lambda fill, no: draw(SEED, "s", "fill", F.concat_ws("/", F.col("interval_no").cast("string"), fill.cast("string"), no.cast("string")))
    return spine.random_fill(wanted, s, pick, n, least, 16384).select("interval_no", "fill_no", "pick_no", "raw")


@register("SELECT event_id, (hour(ts) % 4 + 1) * 0.5::DOUBLE AS factor FROM events")
def rate_hour(spark, d):
    return t(spark, d, "events").select("event_id", rate.factor(RATES, F.col("ts")).alias("factor"))


@register(
    """SELECT event_id, ((hour(ts) % 4 + 1) * 0.5::DOUBLE) * (CASE dayofweek(ts) WHEN 0 THEN 0.1::DOUBLE WHEN 5 THEN 3.0 ELSE 1.0 END) * (CASE minute(ts) WHEN 0 THEN 2.0::DOUBLE WHEN 30 THEN 0.5 ELSE 1.0 END)
* (CASE day(ts) WHEN 1 THEN 1.5::DOUBLE ELSE 1.0 END) * (CASE month(ts) WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 4.0 ELSE 1.0 END) AS factor FROM events"""
)
def rate_all_maps(spark, d):
    return t(spark, d, "events").select("event_id", rate.factor(ALL_RATES, F.col("ts")).alias("factor"))


@register(f"SELECT event_id, 1 + (({sql_draw('s', 'jitter', 'event_id')} % 201) - 100::DOUBLE) / 1000 AS factor FROM events")
def rate_jitter(spark, d):
    return t(spark, d, "events").select("event_id", rate.jitter(0.2, draw(SEED, "s", "jitter", F.col("event_id"))).alias("factor"))


@register("SELECT event_id, round_even((event_id % 100) * ((hour(ts) % 4 + 1) * 0.5::DOUBLE), 0)::BIGINT AS n FROM events")
def rated_count_half_even(spark, d):
    return t(spark, d, "events").select("event_id", rate.rated_count(F.col("event_id") % 100, rate.factor(RATES, F.col("ts"))).alias("n"))


@register(
    """WITH RECURSIVE w AS (SELECT row_number() OVER (ORDER BY h) AS k, h, x FROM (SELECT date_trunc('hour', ts) AS h, count(*)::BIGINT AS x FROM events GROUP BY 1)),
s AS (SELECT 0::BIGINT AS k, 0::BIGINT AS carry, 0::BIGINT AS emitted UNION ALL
SELECT w.k, CASE WHEN carry + x > 0 AND carry + x < 12.5 THEN carry + x ELSE 0 END, CASE WHEN carry + x > 0 AND carry + x < 12.5 THEN 0 ELSE carry + x END FROM s JOIN w ON w.k = s.k + 1)
SELECT w.h AS hour, s.emitted FROM s JOIN w USING (k)"""
)
def perdayvolume_carry(spark, d):
    hours = t(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("x"))
    # one entry an interval: the state is a scan over the ordered intervals
    all_ = hours.agg(F.sort_array(F.collect_list(F.struct("hour", "x"))).alias("a"))
    return all_.select("a.hour", rate.carried(F.col("a.x"), 12.5).alias("e")).select(F.explode(F.arrays_zip("hour", "e")).alias("r")).select("r.hour", F.col("r.e").alias("emitted"))


@register(f"SELECT i AS interval_no, {START} + i * 700 AS t, least({START} + (i + 1) * 700, {START + 86400}) AS lt FROM range(({86400} + 699) // 700) r(i)")
def backfill_grid(spark, d):
    return spine.intervals(spark, START, START + 86400, 700)


@register(f"WITH {GRID} SELECT ordinal, t + {sql_draw('s', 'pivot')} % (lt - t + 1) AS at FROM spine")
def pivot_uniform(spark, d):
    return spine_rows(spark).select("ordinal", spine.uniform_time(F.col("t"), F.col("lt"), draw(SEED, "s", "pivot", F.col("ordinal"))).alias("at"))


@register(f"WITH {GRID} SELECT ordinal, t * 1000000 + ((lt - t) * 1000000 * i) // n AS at_us FROM spine")
def pivot_sequential(spark, d):
    return spine_rows(spark).select("ordinal", spine.sequential_time().alias("at_us"))


_at = "t * 1000000 + ((lt - t) * 1000000 * (i + 1)) // n"
_stamp = f"strftime(make_timestamp({_at}), '%Y-%m-%d %H:%M:%S') || CASE WHEN ({_at}) % 1000000 = 0 THEN '' ELSE '.' || lpad((({_at}) % 1000000)::VARCHAR, 6, '0') END"


@register(f"WITH {GRID} SELECT ordinal, {_stamp} || ' -0700 WINDBAG Event ' || (i + 1) || ' of ' || n AS raw FROM spine")
def windbag(spark, d):
    return spine_rows(spark).select("ordinal", spine.windbag().alias("raw"))


@register(f"WITH {GRID} SELECT ordinal, {_stamp} || ' loop ' || (i + 1) || '/' || n || ' from 100 at ' || CASE WHEN i % 2 = 0 THEN (100 + i * 5 // 2)::VARCHAR ELSE (100 + 2.5::DOUBLE * i)::VARCHAR END || ' to 900 by 2.5 in hourly' AS raw FROM spine")
def counter_gen(spark, d):
    line = "{event_ts} loop {loop_count}/{max_loop} from {start_count} at {current_count} to {end_count} by {count_by} in {samplename}"
    return spine_rows(spark).select("ordinal", spine.counter("hourly", line, 100.0, 900.0, 2.5).alias("raw"))


@register(f"WITH {RAW} SELECT ordinal, regexp_replace(raw, 'user=\\d+', 'user=$x\\\\', 'g') AS raw FROM ev")
def tok_static(spark, d):
    return raw_events(spark, d).select("ordinal", tokens.rewrite(F.col("raw"), r"user=\d+", F.lit("user=$x\\")).alias("raw"))


@register(f"WITH {RAW} SELECT ordinal, regexp_replace(raw, '(status=)\\d{{3}}', '\\1' || (400 + ordinal % 9), 'g') AS raw FROM ev")
def tok_group1(spark, d):
    return raw_events(spark, d).select("ordinal", tokens.rewrite(F.col("raw"), r"status=(\d{3})", (400 + F.col("ordinal") % 9).cast("string")).alias("raw"))


@register(f"WITH {RAW} SELECT ordinal, strftime(ts, '%d/%b/%Y:%H:%M:%S') AS value FROM ev")
def tok_timestamp(spark, d):
    return raw_events(spark, d).select("ordinal", timeexpr.strftime("%d/%b/%Y:%H:%M:%S", F.col("ts")).alias("value"))


@register(f"WITH {RAW} SELECT ordinal, strftime(ts + to_seconds((-30 + {sql_draw('s', 'off')} % 331)::BIGINT), '%Y-%m-%dT%H:%M:%S') AS value FROM ev")
def tok_offset(spark, d):
    shift = F.make_dt_interval(secs=generate.shift("-30s", "5m", draw(SEED, "s", "off", F.col("ordinal"))))
    return raw_events(spark, d).select("ordinal", timeexpr.strftime("%Y-%m-%dT%H:%M:%S", F.col("ts") + shift).alias("value"))


def _random(name: str, spec: str, sql: str) -> None:
    def f(spark, d):
        return raw_events(spark, d).select("ordinal", tokens.random_value(spec, SEED, "s", name, F.col("ordinal")).alias("value"))

    f.__name__ = f"tok_{name}"
    register(f"WITH {RAW} SELECT ordinal, {sql} AS value FROM ev")(f)


_d = lambda n: sql_draw("s", n)
_random("ipv4", "ipv4", " || '.' || ".join(f"(({_d('ipv4')} >> {8 * k}) % 256)" for k in range(4)))
_random("ipv6", "ipv6", " || ':' || ".join(f"regexp_replace(substr({sql_md5('ipv6')}, {1 + 4 * k}, 4), '^0{{1,3}}', '')" for k in range(8)))
_random("mac", "mac", " || ':' || ".join(f"substr({sql_md5('mac')}, {1 + 2 * k}, 2)" for k in range(6)))
_g = sql_md5("guid")
_random("guid", "guid", f"substr({_g},1,8) || '-' || substr({_g},9,4) || '-4' || substr({_g},14,3) || '-' || translate(substr({_g},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({_g},18,3) || '-' || substr({_g},21,12)")
_random("integer", "integer[180:24000]", f"(180 + {_d('integer')} % 23821)::VARCHAR")
_k = f"(150 + {_d('float')} % 9851)"
_random("float", "float[1.50:100.00]", f"regexp_replace(({_k} // 100) || '.' || lpad(({_k} % 100)::VARCHAR, 2, '0'), '(\\.\\d+?)0+$', '\\1')")
_c = f"('0x' || substr(md5('{SEED}|s|string#' || ((k - 1) // 8) || '|' || ordinal), 1 + 4 * ((k - 1) % 8), 4))::BIGINT % {len(tokens.ALPHABET)}"
_random("string", "string(12)", f"(SELECT string_agg(substr('{tokens.ALPHABET}', ({_c} + 1)::INT, 1), '' ORDER BY k) FROM range(1, 13) r(k))")
_random("hex", "hex(20)", f"upper(substr({sql_md5('hex')}, 1, 20))")
_random("list", 'list["GET","POST",3]', f"(['GET','POST','3'])[1 + {_d('list')} % 3]")


@register(f"WITH {RAW} SELECT ordinal, round_even((10 + {_d('rated')} % 91) * ((hour(ts) % 4 + 1) * 0.5::DOUBLE), 0)::BIGINT::VARCHAR AS value FROM ev")
def tok_rated(spark, d):
    f = rate.factor(RATES, F.col("ts"), ("hourOfDayRate", "dayOfWeekRate"))
    return raw_events(spark, d).select("ordinal", tokens.rated_integer(10, 100, f, SEED, "s", "rated", F.col("ordinal")).alias("value"))


_rk = f"(100 + {_d('rated_float')} % 901) * ((hour(ts) % 4 + 1) * 0.5::DOUBLE)"


@register(f"WITH {RAW}, r AS (SELECT ordinal, round_even({_rk}, 0)::BIGINT AS k FROM ev) SELECT ordinal, regexp_replace((k // 100) || '.' || lpad((k % 100)::VARCHAR, 2, '0'), '(\\.\\d+?)0+$', '\\1') AS value FROM r")
def tok_rated_float(spark, d):
    f = rate.factor(RATES, F.col("ts"), ("hourOfDayRate", "dayOfWeekRate"))
    return raw_events(spark, d).select("ordinal", tokens.rated_float("1.00", "10.00", f, SEED, "s", "rated_float", F.col("ordinal")).alias("value"))


@register("WITH e AS (SELECT event_id AS ordinal, 'k=' || event_type || '; v=' || user_id AS raw FROM events) SELECT ordinal, regexp_replace(regexp_replace(raw, '(k=)(click|view)', '\\1X'), '(v=)\\d+', '\\1X') AS raw FROM e")
def tok_nested_group(spark, d):
    """A pattern whose first group is alternated: its spans come from Python's matches."""
    raw = F.concat(F.lit("k="), F.col("event_type"), F.lit("; v="), F.col("user_id").cast("string"))
    return t(spark, d, "events").select(F.col("event_id").alias("ordinal"), tokens.rewrite(tokens.rewrite(raw, r"(?<=k=)((?:click|view))", F.lit("X")), r"v=((\d)+)", F.lit("X")).alias("raw"))


def nations(spark, d) -> list[str]:
    """nation as a file of tokens: the names in key order (25 rows)."""
    return [r["n_name"] for r in t(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]


@register(f"WITH {RAW}, f AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation), n AS (SELECT count(*) AS n FROM f) SELECT ordinal, n_name AS value FROM ev, n, f WHERE pos = {_d('file')} % n.n")
def tok_file(spark, d):
    lines = nations(spark, d)
    rows = generate.file_rows(spark, lines, [None])
    return generate.with_file(raw_events(spark, d), rows, below(draw(SEED, "s", "file", F.col("ordinal")), len(lines))).select("ordinal", F.col("value_0").alias("value"))


@register(
    f"""WITH {RAW}, f AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name, n_regionkey FROM nation), n AS (SELECT count(*) AS n FROM f)
SELECT ordinal, n_name AS value_1, n_regionkey::VARCHAR AS value_2, NULL::VARCHAR AS value_3 FROM ev, n, f WHERE pos = {_d('mvfile')} % n.n"""
)
def tok_mvfile(spark, d):
    """Two columns of one file, and one that it lacks: one draw and one join for the file."""
    lines = [f"{r['n_name']}, {r['n_regionkey']}" for r in t(spark, d, "nation").orderBy("n_nationkey").collect()]
    rows = generate.file_rows(spark, lines, [1, 2, 3])
    return generate.with_file(raw_events(spark, d), rows, below(draw(SEED, "s", "mvfile", F.col("ordinal")), len(lines))).select("ordinal", "value_1", "value_2", "value_3")


RANKED = "SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS r FROM ev WHERE raw LIKE '%type=click%'"


def _matched(spark, d) -> DataFrame:
    return spine.match_rank(raw_events(spark, d), F.col("raw").contains("type=click")).where("r IS NOT NULL").select("ordinal", "r")


@register(f"WITH {RAW}, m AS ({RANKED}), f AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation), n AS (SELECT count(*) AS n FROM f) SELECT ordinal, n_name AS value FROM m, n, f WHERE pos = r % n.n")
def tok_seqfile(spark, d):
    lines = nations(spark, d)
    return generate.with_file(_matched(spark, d), generate.file_rows(spark, lines, [None]), F.pmod("r", F.lit(len(lines)))).select("ordinal", F.col("value_0").alias("value"))


@register(f"WITH {RAW}, m AS ({RANKED}) SELECT ordinal, 100 + r AS value FROM m")
def tok_integerid(spark, d):
    return _matched(spark, d).select("ordinal", (F.lit(100) + F.col("r")).cast("bigint").alias("value"))


@register(f"WITH {RAW} SELECT ordinal, regexp_replace(regexp_replace(raw, 'ip=\\S+', 'ip=@@NAME@@', 'g'), '@@NAME@@', event_type, 'g') AS raw FROM ev")
def tok_sequential_chain(spark, d):
    """The second token matches what the first one wrote."""
    first = tokens.rewrite(F.col("raw"), r"ip=\S+", F.lit("ip=@@NAME@@"))
    return raw_events(spark, d).select("ordinal", tokens.rewrite(first, "@@NAME@@", F.col("event_type")).alias("raw"))


@register("SELECT * FROM (VALUES ('a'), ('b'), ('p0'), ('p1'), ('p2')) v(index_name)")
def extend_indexes(spark, d):
    return spark.createDataFrame([(x,) for x in spine.extend_indexes("a, b,p:3")], "index_name string")


TIMELINE = "base AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no, epoch_us(ts) AS base_us, event_id FROM events), g AS (SELECT *, floor(coalesce(base_us - lag(base_us) OVER (PARTITION BY user_id ORDER BY line_no), 0) * 0.5::DOUBLE)::BIGINT AS diff FROM base)"


def _timeline(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    base = t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("base_us"), (F.row_number().over(w) - 1).cast("bigint").alias("line_no"))
    return replay.gaps(base, multiple=0.5, by=["user_id"])


@register(f"WITH {TIMELINE} SELECT event_id, line_no, diff FROM g")
def replay_gaps(spark, d):
    return _timeline(spark, d).select("event_id", "line_no", "diff")


@register(f"WITH {TIMELINE} SELECT event_id, coalesce(sum(greatest(diff, 0)) OVER (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_us FROM g")
def replay_schedule(spark, d):
    return replay.schedule(_timeline(spark, d), by=["user_id"]).select("event_id", "offset_us")


NOW_US, HORIZON_US = 1706745600000000, 1703462400000000


@register(
    f"""WITH {TIMELINE}, w AS (SELECT *, greatest(diff, 0) AS w FROM g), b AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY line_no DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(w) OVER (PARTITION BY user_id)::BIGINT AS total FROM w),
x AS (SELECT user_id, line_no, w, cycle, {NOW_US} - cycle * total - upto AS time_us FROM b, LATERAL (SELECT unnest(range({NOW_US - HORIZON_US} // total + 2)) AS cycle) WHERE total > 0)
SELECT user_id, line_no, cycle, time_us FROM x WHERE time_us + w >= {HORIZON_US}"""
)
def replay_backfill(spark, d):
    return replay.backfill(_timeline(spark, d), NOW_US, HORIZON_US, by=["user_id"]).select("user_id", "line_no", "cycle", "time_us")


@register(
    """SELECT event_id, date_trunc('second', ts) - INTERVAL 90 MINUTE AS a, date_trunc('day', date_trunc('second', ts) - INTERVAL 1 DAY)::TIMESTAMP AS b, date_trunc('month', date_trunc('second', ts) - INTERVAL 1 MONTH)::TIMESTAMP + INTERVAL 3 DAY AS c,
date_trunc('second', ts) + INTERVAL 6 MONTH AS e, (date_trunc('day', ts) - to_days(dayofweek(ts)::INT))::TIMESTAMP AS f FROM events"""
)
def time_relative(spark, d):
    r = timeexpr.relative_column
    at = F.col("ts")
    return t(spark, d, "events").select("event_id", r("-90m", at).alias("a"), r("-1d@d", at).alias("b"), r("-1mon@mon+3d", at).alias("c"), r("+2q", at).alias("e"), r("@w0", at).alias("f"))


@register("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strptime(strftime(ts, '%d/%b/%Y:%H:%M:%S'), '%d/%b/%Y:%H:%M:%S') END AS parsed FROM events")
def strptime_extract(spark, d):
    """Timestamps found in lines; every seventh line has none that fits."""
    line = F.concat(F.lit("x ["), F.when(F.col("event_id") % 7 == 0, "bad").otherwise(timeexpr.strftime("%d/%b/%Y:%H:%M:%S", F.col("ts"))), F.lit("]"))
    return t(spark, d, "events").select("event_id", timeexpr.strptime("%d/%b/%Y:%H:%M:%S", F.regexp_extract(line, r"\[(.*)\]", 1)).alias("parsed"))


#: The nations as sample files of a pack, and a conf over them: sections, each with what it sets.
CONF = "[DEFAULT]\ninterval = 7\n[global]\nsourcetype = glob\ninterval = 5\nhost = g\n[.*]\nsource = any\ntoken.0.token = G\ntoken.0.replacementType = static\ntoken.0.replacement = g\n[.*A]\nsourcetype = ends\ndisabled = false\n[I.*]\ncount = 4\ndisabled = 1\n[C.*A]\nhost = c\ntoken.0.token = C\ntoken.0.replacementType = static\ntoken.0.replacement = c\n[KENYA]\nhost = own\n[nothing]\nhost = x\n"
PATTERNS = (".*", ".*A", "C.*A", "KENYA", "nothing")
_files = "files AS (SELECT n_name AS file FROM nation), pats AS (SELECT unnest([" + ",".join(f"'{p}'" for p in PATTERNS) + "]) AS pattern), m AS (SELECT file, pattern FROM files, pats WHERE regexp_full_match(file, pattern))"
_one = f"{_files}, one AS (SELECT file, s.p AS pattern, all_ FROM (SELECT file, max({{'e': pattern = file, 'n': length(pattern), 'p': pattern}}) AS s, list(pattern) AS all_ FROM m GROUP BY file))"


def _pack(spark, d) -> list[conf.Stanza]:
    """The stanzas of CONF with the nations' names as sample files: the loader itself, on the driver, as for any conf."""
    parsed = ini.parse(ini.render(ini.parse(CONF)))
    sections = {n: parsed.defaults | k for n, k in parsed.sections.items() if n != "global"}
    names = nations(spark, d)
    return conf.resolve(sections, parsed.defaults | parsed.sections["global"] | parsed.defaults, lambda where: [generate.Path(n) for n in names])


@register(f"WITH {_files} SELECT * FROM m")
def conf_match(spark, d):
    names = nations(spark, d)
    return spark.createDataFrame([(n, p) for p in PATTERNS for n in conf.matched(p, names)], "file string, pattern string")


@register(f"WITH {_one} SELECT file, pattern, CASE WHEN pattern = '.*' THEN 'G' WHEN pattern = 'C.*A' THEN 'C,G,G,G' WHEN pattern = '.*A' THEN 'G,G' ELSE 'G,G,G' END AS tokens FROM one")
def conf_flatten(spark, d):
    """For each file the exact stanza, else the longest one, with the tokens of those it dominates behind its own, inherited ones too."""
    return spark.createDataFrame([(s.name, s.stanza, ",".join(t.token for t in s.tokens)) for s in _pack(spark, d)], "file string, pattern string, tokens string")


@register(f"WITH {_one} SELECT file, CASE WHEN list_contains(all_, '.*A') THEN 'ends' ELSE 'glob' END AS sourcetype, '7' AS interval, CASE pattern WHEN 'KENYA' THEN 'own' WHEN 'C.*A' THEN 'c' ELSE 'g' END AS host, '-1' AS count, 'any' AS source, 'main' AS index FROM one")
def conf_layering(spark, d):
    """Packaged defaults, under global ones, under DEFAULT, under the stanza's own; a disabled stanza counts for nothing."""
    keys = ("sourcetype", "interval", "host", "count", "source", "index")
    return spark.createDataFrame([(s.name, *(s.settings[k] for k in keys)) for s in _pack(spark, d)], "file string, " + ", ".join(f"{k} string" for k in keys))


SNAPS = ("s", "m", "h", "d", "mon", "q", "y", "w0", "w1", "w2", "w3", "w4", "w5", "w6")
_units = {"s": "second", "m": "minute", "h": "hour", "d": "day", "mon": "month", "q": "quarter", "y": "year"}


@register(
    "SELECT event_id, "
    + ", ".join(f"date_trunc('{_units[u]}', ts)::TIMESTAMP AS snap_{u}" if u in _units else f"(date_trunc('day', ts) - to_days(((dayofweek(ts) - {u[1]} + 7) % 7)::INT))::TIMESTAMP AS snap_{u}" for u in SNAPS)
    + " FROM events"
)
def time_snap(spark, d):
    return t(spark, d, "events").select("event_id", *[timeexpr.snap_column(F.col("ts"), u).alias(f"snap_{u}") for u in SNAPS])


DIRECTIVES = "Y y m d H I M S f j p b B a A U W V G u w".split()


@register("SELECT event_id, " + ", ".join(f"strftime(ts, '%{x}') AS d{i}" for i, x in enumerate(DIRECTIVES)) + ", strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def strftime_directives(spark, d):
    return t(spark, d, "events").select("event_id", *[timeexpr.strftime(f"%{x}", F.col("ts")).alias(f"d{i}") for i, x in enumerate(DIRECTIVES)], timeexpr.strftime("%FT%T.%f", F.col("ts")).alias("iso"))


IDS = "ids AS (SELECT event_id AS pos, CASE event_id % 4 WHEN 0 THEN (100000 + user_id)::VARCHAR WHEN 1 THEN substr(md5(user_id::VARCHAR), 1, 12) WHEN 2 THEN event_type ELSE substr(md5('g' || user_id), 1, 8) || '-0000-4000-8000-' || substr(md5('g' || user_id), 9, 12) END AS value FROM events)"
KIND = "CASE WHEN regexp_full_match(value, '[0-9]+') THEN 'digits(' || length(value) || ')' WHEN regexp_full_match(value, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'guid' WHEN regexp_full_match(value, '[0-9a-f]+') AND regexp_matches(value, '[a-f]') THEN 'hex(' || length(value) || ')' WHEN regexp_matches(value, '[0-9A-Za-z]') THEN 'mixed(' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '^([^aA]*)a', '\\1g'), '^([^aAg]*)A', '\\1G') || ')' ELSE 'none' END"


def _ids(spark, d) -> DataFrame:
    u = F.col("user_id").cast("string")
    g = F.md5(F.concat(F.lit("g"), u).cast("binary"))
    k = F.col("event_id") % 4
    value = F.when(k == 0, (100000 + F.col("user_id")).cast("string")).when(k == 1, F.substring(F.md5(u.cast("binary")), 1, 12)).when(k == 2, F.col("event_type")).otherwise(F.concat(F.substring(g, 1, 8), F.lit("-0000-4000-8000-"), F.substring(g, 9, 12)))
    return t(spark, d, "events").select(F.col("event_id").alias("pos"), value.alias("value"), "ts")


@register(f"WITH {IDS} SELECT pos, value, {KIND} AS kind FROM ids")
def fmt_infer(spark, d):
    return _ids(spark, d).select("pos", "value", identity.kind_column(F.col("value")).alias("kind"))


@register(
    f"""WITH {IDS}, f AS (SELECT {KIND} AS kind, value, min(pos) AS seen FROM ids GROUP BY ALL) SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY seen, value) - 1 AS k, count(*) OVER (PARTITION BY kind) AS d FROM f WHERE kind <> 'none'"""
)
def rotate_tables(spark, d):
    return rotate.tables(_ids(spark, d))


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _mix64(x: str, tag: str) -> str:
    """The splitmix finaliser over a UBIGINT."""
    times = lambda e, f: f"(({e})::UHUGEINT * {f}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    a, b = f"a{tag}", f"b{tag}"
    last = f"xor({times('c' + tag, identity.MIX2)}, ({times('c' + tag, identity.MIX2)}) >> 31)"
    return _let(a, x, _let(b, times(f"xor({a}, {a} >> 30)", identity.MIX1), _let("c" + tag, f"xor({b}, {b} >> 27)", last)))


_FIXED = "18446744073709551616::UHUGEINT"
#: Size of a format's space, and the identity x rendered, for the columns kind, w, shape and x.
_SPACE = """CASE WHEN kind LIKE 'digits%' THEN 9::UHUGEINT * list_reduce(list_concat([1::UHUGEINT], list_transform(range(w - 1), lambda i: 10::UHUGEINT)), lambda a, b: a * b)
WHEN kind LIKE 'hex%' THEN 6::UHUGEINT * list_reduce(list_concat([1::UHUGEINT], list_transform(range(w - 1), lambda i: 16::UHUGEINT)), lambda a, b: a * b) WHEN kind = 'guid' THEN 5316911983139663491615228241121378304::UHUGEINT
ELSE list_reduce(list_transform(string_split(shape, ''), lambda c: CASE c WHEN '9' THEN 10 WHEN 'a' THEN 26 WHEN 'A' THEN 26 WHEN 'g' THEN 20 WHEN 'G' THEN 20 ELSE 1 END::UHUGEINT), lambda a, b: a * b) END"""
_KINDS = "CASE WHEN kind LIKE 'digits%' OR kind LIKE 'hex%' THEN regexp_extract(kind, '\\d+')::INT END AS w, CASE WHEN kind LIKE 'mixed%' THEN substr(kind, 7, length(kind) - 7) END AS shape"
_hexes = lambda x, n: f"list_aggregate(list_transform(range({n}), lambda i: substr('0123456789abcdef', (({x} // (list_reduce(list_concat([1::UHUGEINT], list_transform(range({n} - 1 - i), lambda j: 16::UHUGEINT)), lambda a, b: a * b))) % 16)::INT + 1, 1)), 'string_agg', '')"
_RENDER = f"""CASE WHEN kind LIKE 'digits%' THEN (space // 9 + x)::VARCHAR WHEN kind LIKE 'hex%' THEN {_hexes('(space // 6 * 10 + x)', 'w')}
WHEN kind = 'guid' THEN (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) FROM (SELECT {_hexes('(x // 18889465931478580854784::UHUGEINT)', '12')} || '4' || {_hexes('(x // 4611686018427387904::UHUGEINT % 4096)', '3')} || {_hexes('(x % 4611686018427387904::UHUGEINT + 9223372036854775808::UHUGEINT)', '16')} AS h))
ELSE list_aggregate(list_transform(range(length(shape)), lambda i: CASE WHEN substr(shape, i + 1, 1) IN ('9', 'a', 'A', 'g', 'G') THEN substr(CASE substr(shape, i + 1, 1) WHEN '9' THEN '0123456789' WHEN 'a' THEN 'abcdefghijklmnopqrstuvwxyz' WHEN 'A' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' WHEN 'g' THEN 'ghijklmnopqrstuvwxyz' ELSE 'GHIJKLMNOPQRSTUVWXYZ' END,
  ((x // list_reduce(list_concat([1::UHUGEINT], list_transform(string_split(substr(shape, i + 2), ''), lambda c: CASE c WHEN '9' THEN 10 WHEN 'a' THEN 26 WHEN 'A' THEN 26 WHEN 'g' THEN 20 WHEN 'G' THEN 20 ELSE 1 END::UHUGEINT)), lambda a, b: a * b)) % (CASE substr(shape, i + 1, 1) WHEN '9' THEN 10 WHEN 'a' THEN 26 WHEN 'A' THEN 26 ELSE 20 END))::INT + 1, 1) ELSE substr(shape, i + 1, 1) END), 'string_agg', '') END"""
_RANKS = f"f AS (SELECT {KIND} AS kind, value, min(pos) AS seen FROM ids GROUP BY ALL), tab AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY seen, value) - 1 AS k, count(*) OVER (PARTITION BY kind) AS d FROM f WHERE kind <> 'none')"


def _rounds() -> str:
    """Four Feistel rounds over x with halves of `half` bits, one LATERAL each."""
    out = ["LATERAL (SELECT (x // pw)::UBIGINT AS l0, (x % pw)::UBIGINT AS r0)"]
    for r in range(4):
        key = f"((r{r}::UHUGEINT + {r * identity.ROUND}) % {_FIXED})::UBIGINT"
        out.append(f"LATERAL (SELECT r{r} AS l{r + 1}, xor(l{r}, ({_mix64(key, str(r))} % pw)::UBIGINT) AS r{r + 1})")
    return ", ".join(out)


@register(
    f"""WITH RECURSIVE {IDS}, {_RANKS}, ev AS (SELECT pos AS ordinal, value, pos // 1000 AS pass FROM ids),
s AS (SELECT DISTINCT ev.pass, tab.value, kind, {_KINDS}, k, d FROM ev JOIN tab USING (value)),
p AS (SELECT *, {_SPACE} AS space FROM s),
h AS (SELECT *, (SELECT min(b) FROM range(1, 64) t(b) WHERE list_reduce(list_transform(range(b), lambda i: 4::UHUGEINT), lambda a, c: a * c) >= space) AS half FROM p WHERE kind <> 'guid' UNION ALL SELECT *, 61 FROM p WHERE kind = 'guid'),
walk AS (SELECT kind, w, shape, value, pass, space, (1::UBIGINT << half)::UHUGEINT AS pw, (pass * d + k)::UHUGEINT % space AS x, 0 AS step FROM h
UNION ALL SELECT kind, w, shape, value, pass, space, pw, l4::UHUGEINT * pw + r4 AS x, step + 1 FROM walk, {_rounds()} WHERE step = 0 OR x >= space),
done AS (SELECT value, pass, {_RENDER} AS rotated FROM walk WHERE step > 0 AND x < space)
SELECT ordinal, ev.value, ev.pass, coalesce(rotated, ev.value) AS rotated FROM ev LEFT JOIN done USING (value, pass)"""
)
def rotate_pass(spark, d):
    ids = _ids(spark, d)
    return rotate.rotate_pass(ids.select(F.col("pos").alias("ordinal"), "value"), rotate.tables(ids), 1000).select("ordinal", "value", "pass", "rotated")


@register(
    f"""WITH {IDS}, ev AS (SELECT pos, value, greatest(epoch_us(ts) // 1000000, 0) // 3600 AS "window", {KIND} AS kind FROM ids JOIN (SELECT event_id AS pos, ts FROM events) USING (pos)),
s AS (SELECT DISTINCT value, "window", kind, {_KINDS} FROM ev WHERE kind <> 'none'), p AS (SELECT *, {_SPACE} AS space FROM s),
f AS (SELECT *, xor(list_reduce(list_concat([{identity.FNV0}::UBIGINT], list_transform(string_split(value, ''), lambda c: ascii(c)::UBIGINT)), lambda a, c: (xor(a, c)::UHUGEINT * {identity.FNVP} % {_FIXED})::UBIGINT), ("window"::UHUGEINT * {identity.GOLDEN}::UHUGEINT % {_FIXED})::UBIGINT) AS seed FROM p),
a AS (SELECT *, {_mix64('seed', '_lo')} AS lo FROM f), b AS (SELECT *, {_mix64(f'xor(lo, {0xA5A5A5A5A5A5A5A5}::UBIGINT)', '_hi')} AS hi FROM a),
g AS (SELECT *, (hi::UHUGEINT * {_FIXED} + lo) % space AS x FROM b), done AS (SELECT value, "window", {_RENDER} AS rotated FROM g)
SELECT pos, ev.value, ev."window", coalesce(rotated, ev.value) AS rotated FROM ev LEFT JOIN done USING (value, "window")"""
)
def rotate_window(spark, d):
    ids = _ids(spark, d).select("pos", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))
    return rotate.rotate_window(ids, 3600).select("pos", "value", "window", "rotated")


@register(f"WITH {IDS}, {_RANKS}, s AS (SELECT DISTINCT kind, d, {_KINDS} FROM tab), p AS (SELECT d, {_SPACE} AS space FROM s) SELECT min(space // d)::BIGINT AS capacity FROM p")
def rotate_capacity(spark, d):
    return spark.createDataFrame([(rotate.capacities(rotate.tables(_ids(spark, d))),)], "capacity long")


@register(f"WITH {RAW} SELECT ordinal, '{{\"time\":' || (epoch_us(ts) // 1000000) || ',\"host\":\"h' || (user_id % 5) || '\",\"source\":null,\"sourcetype\":\"' || event_type || '\",\"index\":\"main\",\"event\":' || to_json(raw) || '}}' AS line FROM ev")
def env_agent(spark, d):
    e = raw_events(spark, d)
    time = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return e.select("ordinal", envelope.agent_line(time, F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")), F.lit(None).cast("string"), F.col("event_type"), F.lit("main"), F.col("raw")).alias("line"))


@register(f"WITH {RAW} SELECT ordinal, '{{' || CASE WHEN user_id % 5 = 0 THEN '' ELSE '\"host\":\"h' || (user_id % 5) || '\",' END || '\"source\":\"dflt\",\"sourcetype\":\"' || event_type || '\",\"index\":\"forced\",\"event\":' || to_json(raw) || '}}' AS line FROM ev")
def env_policy(spark, d):
    """An override, a default and an omitted null."""
    host = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")))
    line = envelope.collector_object(F.lit(None).cast("long"), host, F.lit(None).cast("string"), F.col("event_type"), F.lit("main"), F.col("raw"), {"index": "forced"}, {"source": "dflt"})
    return raw_events(spark, d).select("ordinal", line.alias("line"))


@register(
    f"""WITH {RAW} SELECT ordinal, '<event><time>' || (epoch_us(ts) // 1000000) || '</time><index>main</index><sourcetype>' || event_type || '</sourcetype><source></source><host>a&amp;b</host><data>'
|| replace(replace(replace('<' || raw || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</data></event>' AS xml FROM ev"""
)
def env_modinput(spark, d):
    time = envelope.time_text(F.unix_micros(F.col("ts").cast("timestamp")), True)
    return raw_events(spark, d).select("ordinal", envelope.xml_event(time, F.lit("main"), F.col("event_type"), F.lit(None).cast("string"), F.lit("a&b"), F.concat(F.lit("<"), F.col("raw"), F.lit(">"))).alias("xml"))


@register(f"WITH {RAW} SELECT ts::DATE AS day, sum(strlen(raw))::BIGINT AS bytes, count(*) AS events FROM ev GROUP BY 1")
def sink_counter_histogram(spark, d):
    return sinks.histogram(raw_events(spark, d).withColumn("time_us", F.unix_micros(F.col("ts").cast("timestamp"))))


@register("SELECT n_nationkey::BIGINT AS line_no, n_name || ', \"' || n_regionkey || '\"' || chr(10) || 'x' AS raw, strlen(n_name)::BIGINT + 8 AS size, CASE n_nationkey % 3 WHEN 0 THEN '' ELSE n_name END AS host, 'main' AS index FROM nation")
def csv_meta_fallback(spark, d):
    """nation written as a CSV sample and read back: quotes, commas and line breaks inside a cell; an empty cell stays, a missing column falls back to the stanza's value."""
    rows = t(spark, d, "nation").orderBy("n_nationkey").collect()
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    text = "_raw,host\n" + "".join(quoted(f'{r["n_name"]}, "{r["n_regionkey"]}"\nx') + "," + ("" if r["n_nationkey"] % 3 == 0 else r["n_name"]) + "\n" for r in rows) + "short\n"
    frame = samples.frame(spark, samples.rows_of(text, "csv"))
    return frame.select("line_no", "raw", "size", "host", F.coalesce("index", F.lit("main")).alias("index"))


@register("SELECT doc_id, raw, strlen(raw)::BIGINT + 1 AS size FROM (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: x <> '')) AS raw FROM documents)")
def raw_lines(spark, d):
    return samples.line_rows(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "raw", "size")


@register("WITH p AS (SELECT doc_id, unnest(string_split_regex(replace(text, chr(10) || 'T', chr(1) || 'T'), chr(1))) AS raw FROM documents), q AS (SELECT doc_id, regexp_replace(raw, '[\\r\\n]+$', '') AS raw FROM p) SELECT doc_id, raw, strlen(raw)::BIGINT + 1 AS size FROM q WHERE raw <> ''")
def breaker_split(spark, d):
    """Events run from one match of the breaker to the next."""
    return samples.line_rows(t(spark, d, "documents").select("doc_id", "text"), "text", "^T").select("doc_id", "raw", "size")


@register(f"WITH {RAW}, x AS (SELECT *, '<event><time>' || (epoch_us(ts) // 1000000) || '</time></event>' AS x FROM ev) SELECT (sum(length(x)))::BIGINT AS chars, true AS wrapped FROM x")
def sink_modinput(spark, d):
    """Batches of at most 512 events, each in a stream element: what is between them is what went in."""
    xml = F.concat(F.lit("<event><time>"), envelope.time_text(F.unix_micros(F.col("ts").cast("timestamp")), True), F.lit("</time></event>"))
    got = sinks.modinput_batches(raw_events(spark, d).select(xml.alias("xml")))
    inner = F.regexp_extract("stream", "(?s)^<stream>(.*)</stream>$", 1)
    return got.agg(F.sum(F.char_length(inner)).cast("bigint").alias("chars"), F.min(F.col("stream").startswith("<stream><event>")).alias("wrapped"))


@register(f"WITH {CUSTOMER} SELECT line_no, raw, 'user=<id> seg=' || split_part(raw, 'seg=', 2) AS rendered FROM lines")
def template_render(spark, d):
    """Lines compiled into literals and slots, and rendered from them."""
    rows = [(r["line_no"], r["raw"]) for r in sample(spark, d).collect()]  # a sample file
    compiled, shapes = template.compile_lines([x for _, x in rows], [r"user=(\d+)"])
    frame = spark.createDataFrame([(i, x, *c) for (i, x), c in zip(rows, compiled)], f"line_no long, raw string, {template.FIELDS}")
    return frame.select("line_no", "raw", template.render(shapes, [F.lit("<id>")]).alias("rendered"))


@register(
    f"""WITH {CUSTOMER}, {GRID}, ev AS (SELECT interval_no, t + {sql_draw('flag', 'pivot')} % (lt - t + 1) AS sec, ordinal, lines.raw FROM spine, n, lines WHERE lines.line_no = ordinal % n.n),
r AS (SELECT sec, strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || regexp_replace(raw, 'user=\\d+', 'user=' || {" || '.' || ".join(f"(({sql_draw('flag', 'ip')} >> {8 * k}) % 256)" for k in range(4))}, 'g') AS raw FROM ev)
SELECT make_timestamp(sec * 1000000)::DATE AS day, hour(make_timestamp(sec * 1000000)) AS hour, count(*) AS events, sum(strlen(raw))::BIGINT AS bytes FROM r GROUP BY 1, 2"""
)
def flagship(spark, d):
    """Intervals, rate, lines, event time, two tokens, histogram by day and hour."""
    s = sample(spark, d)
    e = spine.on_line(spine_rows(spark), s, F.pmod(F.col("ordinal"), F.lit(lines_n(s))))
    e = e.withColumn("at", F.timestamp_seconds(spine.uniform_time(F.col("t"), F.col("lt"), draw(SEED, "flag", "pivot", F.col("ordinal")))).cast("timestamp_ntz"))
    raw = tokens.rewrite(F.col("raw"), r"user=\d+", F.concat(F.lit("user="), tokens.ipv4(SEED, "flag", "ip", F.col("ordinal"))))
    e = e.select("at", F.concat(timeexpr.strftime("%Y-%m-%d %H:%M:%S", F.col("at")), F.lit(" "), raw).alias("raw"))
    return e.groupBy(F.to_date("at").alias("day"), F.hour("at").cast("bigint").alias("hour")).agg(F.count("*").alias("events"), F.sum(F.octet_length("raw")).cast("bigint").alias("bytes"))
