"""Driver-side parsers and plans: tables of cases, properties, an end-to-end pack."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions import identity, rate, timeexpr, tokens
from tidemill.operators import replay, rotate, sinks, spine, template
from tidemill.plans import generate
from tidemill.sources import conf, ini, samples
from tidemill.streaming.ticks import ticks

NOW = datetime(2026, 9, 25, 14, 30, 15, 500)  # a Friday


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("now", "2026-09-25 14:30:15"), ("-1h", "2026-09-25 13:30:15"), ("+2d", "2026-09-27 14:30:15"), ("-1d@d", "2026-09-24 00:00:00"), ("@w0", "2026-09-20 00:00:00"), ("@w", "2026-09-20 00:00:00"), ("@w5", "2026-09-25 00:00:00"), ("@w6", "2026-09-19 00:00:00"),
        ("@mon", "2026-09-01 00:00:00"), ("@q", "2026-07-01 00:00:00"), ("@y", "2026-01-01 00:00:00"), ("-1mon@mon+3d", "2026-08-04 00:00:00"), ("-m", "2026-09-25 14:29:15"), ("-2q", "2026-03-25 14:30:15"), ("2026-01-02 03:04:05", "2026-01-02 03:04:05"),
        ("2026-01-02T03:04:05Z", "2026-01-02 03:04:05"), ("1700000000", "2023-11-14 22:13:20"), ("05:06:07", "2026-09-25 05:06:07"), ("01/02/2026:03:04:05", "2026-01-02 03:04:05"),
    ],
)
def test_times(text, want):
    assert timeexpr.parse_time(text, NOW) == datetime.fromisoformat(want)


def test_month_ends():
    assert timeexpr.add_units(datetime(2026, 3, 31), -1, "mon") == datetime(2026, 2, 28)
    assert timeexpr.add_units(datetime(2024, 2, 29), 1, "y") == datetime(2025, 2, 28)
    with pytest.raises(ValueError):
        timeexpr.parse_time("soon", NOW)


def test_strftime(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2026-09-05 14:03:09.123456' AS t")
    cases = {"%Y-%m-%dT%H:%M:%S.%f": "2026-09-05T14:03:09.123456", "%z|%Z|%%|%-d|%_d": "||%|5| 5", "%Q": "%Q", "%e/%k/%l": " 5/14/ 2", "%a %A %b %B": "Sat Saturday Sep September", "%j %U %W %u %w": "248 35 35 6 6", "%I %p": "02 PM", "%D %R %T": "09/05/26 14:03 14:03:09", "%C%y": "2026", "%V %G": "36 2026"}
    got = df.select(*[timeexpr.strftime(k, F.col("t")) for k in cases]).first()
    assert list(got) == list(cases.values())


def test_ini():
    got = ini.parse("[DEFAULT]\na = 1\n[x[1]]\ntoken.0.token = a=b:c\nmap: {\n   1,\n   2}\n; c\nCount = 1\ncount = 2\n[x[1]]\ncount = 3\n")
    assert got.defaults == {"a": "1"} and got.sections == {"x[1]": {"token.0.token": "a=b:c", "map": "{\n1,\n2}", "Count": "1", "count": "3"}}
    assert ini.parse(ini.render(got)) == got
    with pytest.raises(ValueError):
        ini.parse("a = 1")


def test_samples(tmp_path):
    assert samples.raw_lines("left\r\n\n \nright\rdöwn") == [("left", 5), (" ", 2), ("right", 6), ("döwn", 6)]
    assert [x for x, _ in samples.broken("#1 up\n\tmore of it\n#2 down\n\n#30 up\n", r"^#\d+")] == ["#1 up\n\tmore of it", "#2 down", "#30 up"]
    assert [x for x, _ in samples.broken("a\nb\n", "(")] == ["a", "b"]
    assert samples.decode(b"caf\xe9") == "café"
    f = tmp_path / "r.csv"
    f.write_text('_raw,host\n"a, ""b""\nc",\nshort\nx,h\n')
    assert [(r[1], r[4]) for r in samples.read(f, "csv")] == [('a, "b"\nc', ""), ("x", "h")]
    (tmp_path / "e").write_text("\n")
    with pytest.raises(ValueError):
        samples.read(tmp_path / "e")
    assert spine.extend_indexes("a, b,p:2") == ["a", "b", "p0", "p1"] and spine.extend_indexes("p:x") == []


def test_rates(spark):
    maps = {"hourOfDayRate": '{"3":0.25,"22":4}', "dayOfWeekRate": '{"0":0.5,"1":1.5}', "monthOfYearRate": "no map", "dayOfMonthRate": '{"31":2}'}
    times = {"2027-01-31 03:10:00": 0.25, "2027-02-01 22:00:00": 6.0, "2027-02-02 12:00:00": 1.0, "2027-02-07 22:59:59": 2.0}
    df = spark.createDataFrame([(x,) for x in times], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in df.select(rate.factor(maps, F.col("t"))).collect()] == list(times.values())
    assert [rate.factor_at(maps, datetime.fromisoformat(x)) for x in times] == list(times.values())
    assert list(spark.range(1).select(*[rate.rated_count(F.lit(a), F.lit(b)) for a, b in ((9, 0.5), (11, 0.5), (10, 0.33), (200, 1.0025))]).first()) == [4, 6, 3, 200]
    assert rate.per_interval_bytes(2.0, 3600) == 2 * 1024**3 / 24 and rate.per_interval_bytes(1.0, 0) == 1024**3


def test_rewrite(spark):
    df = spark.sql("SELECT 'a status=200 x status=404' AS t")
    one = lambda p, v: df.select(tokens.rewrite(F.col("t"), p, F.lit(v))).first()[0]
    assert one(r"status=(\d{3})", "9$\\") == "a status=9$\\ x status=9$\\"
    assert one(r"\d{3}", "X") == "a status=X x status=X"
    assert one(r"none", "X") == "a status=200 x status=404"
    assert df.select(tokens.rewrite(F.col("t"), "a", F.lit(None).cast("string"))).first()[0] == "a status=200 x status=404"
    assert tokens.random_value("integer[5:1]", 1, "s", "t", F.lit(1)) is not None and tokens.random_value("nonsense", 1, "s", "t", F.lit(1)) is None
    assert tokens.java_pattern(r"(?P<a>x)(?P=a)\Z{,3}") == r"(?U)(?<a>x)\k<a>\z{0,3}"


def test_identity():
    assert [identity.fnv1a64(x) for x in ("", "a", "foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert identity.mix64(1) == 0x5692161D100B05E5 and identity.mix64(0xDEADBEEF) == 0x4E062702EC929EEA
    for n in (2, 3, 9, 10, 17, 90, 900, 9000):
        assert sorted(identity.permute(x, n) for x in range(n)) == list(range(n))
    ids = {identity.render("guid", x) for x in (0, 1, 1 << 61, 1 << 62, 1 << 76, (1 << 122) - 1)}
    assert len(ids) == 6 and all(x[14] == "4" and x[19] in "89ab" for x in ids)
    assert identity.render("digits(6)", 0) == "100000" and identity.render("hex(4)", 0) == "a000"
    # fixed values of the published permutation
    assert [identity.permute(x, 900_000) + 100_000 for x in range(5)] == [463222, 695508, 693026, 928073, 870466]


def test_formats(spark):
    kinds = {"0042": "digits(4)", "c0ffee": "hex(6)", "C0FFEE": "hex(6)", "C0ffee": "mixed(G9aaaa)", "AB-12cd": "mixed(GA-99aa)", "x": "mixed(g)", "--": "none", "": "none", "12:34": "mixed(99:99)", "é": "none"}
    df = spark.createDataFrame([(k,) for k in kinds], "v string")
    assert {r["v"]: r["k"] for r in df.select("v", identity.kind_column(F.col("v")).alias("k")).collect()} == kinds == {k: identity.infer(k) for k in kinds}
    for kind in ("mixed(g9)", "mixed(G-a)", "digits(2)", "hex(2)"):
        n = identity.space(kind)
        ids = {identity.render(kind, x) for x in range(n)}
        assert len(ids) == n and {identity.infer(x) for x in ids} == {kind}
    assert identity.render("mixed(GA-99aa)", 0) == "GA-00aa" and identity.space("digits(60)") == (1 << 128) - 1 and len(identity.render("digits(60)", 77)) == 60
    assert identity.capacity({"digits(3)": 9, "mixed(g)": 3}) == 6 and identity.capacity({}) == 0


def test_two_slots_never_share_an_identity(spark):
    ev = spark.createDataFrame([(i, ["610457", "238819"][i % 2]) for i in range(40)], "ordinal long, value string")
    table = rotate.tables(ev.select(F.col("ordinal").alias("pos"), "value"))
    one, two = ({r["rotated"] for r in rotate.rotate_pass(ev, table, 2, workers=2, slot=k).collect()} for k in (0, 1))
    assert len(one) == len(two) == 40 and not one & two
    # a restart after 7 events goes on at the next whole pass
    whole = [r["rotated"] for r in rotate.rotate_pass(ev, table, 2).orderBy("ordinal").collect()]
    again = [r["rotated"] for r in rotate.rotate_pass(ev.where("ordinal < 10"), table, 2, base=7).orderBy("ordinal").collect()]
    assert again == whole[8:18]


def test_rotation(spark):
    ev = spark.createDataFrame([(i, ["610457", "238819", "--"][i % 3]) for i in range(9)], "ordinal long, value string")
    table = rotate.tables(ev.select(F.col("ordinal").alias("pos"), "value"))
    got = rotate.rotate_pass(ev, table, 3).orderBy("ordinal").collect()
    assert len({r["rotated"] for r in got if r["value"] != "--"}) == 6 and all(len(r["rotated"]) == 6 for r in got if r["value"] != "--")
    assert {r["rotated"] for r in got if r["value"] == "--"} == {"--"}
    w = spark.createDataFrame([(5, "610457"), (59, "610457"), (60, "610457")], "epoch long, value string")
    a, b, c = (r["rotated"] for r in rotate.rotate_window(w, 60).orderBy("epoch").collect())
    assert a == b != c


def test_replay(spark):
    lines = spark.createDataFrame([(0, 0), (1, 3), (2, 1), (3, 6)], "line_no long, base_us long")
    g = replay.gaps(lines)
    assert [r["diff"] for r in g.orderBy("line_no").collect()] == [0, 3, -2, 5]
    assert [r["offset_us"] for r in replay.schedule(g).orderBy("line_no").collect()] == [0, 0, 3, 3]
    assert [r["offset_us"] for r in replay.schedule(g, shift=0).orderBy("line_no").collect()] == [0, 3, 3, 8]


@pytest.fixture
def pack(tmp_path):
    (tmp_path / "default").mkdir()
    (tmp_path / "samples").mkdir()
    (tmp_path / "samples" / "web.sample").write_text("0.0.0.0 [T] u=5 status=200\n0.0.0.0 [T] u=6 status=404\n")
    (tmp_path / "samples" / "codes.list").write_text("200,ok\n500,bad\n")
    (tmp_path / "default" / "eventgen.conf").write_text(
        "[global]\ninterval = 5\n[.*sample]\nhost = h\ncount = 7\ntoken.0.token = G\ntoken.0.replacementType = static\ntoken.0.replacement = g\n"
        "[web.sample]\ncount = 10\nearliest = -5s\nlatest = now\n"
        "token.0.token = \\[(T)\\]\ntoken.0.replacementType = timestamp\ntoken.0.replacement = %Y-%m-%d %H:%M:%S\n"
        "token.1.token = ^(\\S+)\ntoken.1.replacementType = random\ntoken.1.replacement = ipv4\n"
        "token.2.token = status=(\\d{3})\ntoken.2.replacementType = mvfile\ntoken.2.replacement = samples/codes.list:1\ntoken.3.token = x\n"
    )
    return tmp_path


def test_conf(pack):
    (s,) = conf.load(pack)
    assert s.settings["interval"] == "5" and s.settings["count"] == "10" and s.settings["host"] == "h" and s.settings["source"] == "web.sample"
    assert [t.token for t in s.tokens] == [r"\[(T)\]", r"^(\S+)", r"status=(\d{3})", "G", "G"]
    assert conf.load(pack, only="none") == [] and generate.validate(pack)
    (o,) = conf.load(pack, overrides={"count": "3"})
    assert o.settings["count"] == "3"


def test_generate(spark, pack):
    e = generate.generate(spark, pack, datetime(2026, 1, 1, 0, 0, 10), executions=3)
    rows = e.orderBy("ordinal").collect()
    assert len(rows) == 30 and [r["ordinal"] for r in rows] == list(range(30))
    import re

    for r in rows:
        m = re.fullmatch(r"(\d+)\.\d+\.\d+\.\d+ \[(2026-01-01 00:00:\d\d)\] u=([56]) status=(200|500)", r["raw"])
        assert m and int(m[3]) == 5 + r["i"] % 2 and r["host"] == "h" and r["index"] == "main"
        assert 5 + 5 * r["interval_no"] <= r["time_us"] / 1e6 % 60 <= 10 + 5 * r["interval_no"]
    again = generate.generate(spark, pack, datetime(2026, 1, 1, 0, 0, 10), executions=3).repartition(7)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    back = generate.generate(spark, pack, datetime(2026, 1, 1), overrides={"backfill": "-80s", "backfillEnd": "-60s", "interval": "1"})
    assert back.count() == 200


def test_replay_and_volume_stanzas(spark, pack):
    (pack / "samples" / "r.log").write_text("2026-01-01 00:00:00 a\n2026-01-01 00:00:04 b\nnone\n2026-01-01 00:00:05 c\n")
    (pack / "default" / "eventgen.conf").write_text(
        "[r.log]\nmode = replay\ntimeMultiple = 2\ntoken.0.token = ^(\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d)\ntoken.0.replacementType = replaytimestamp\ntoken.0.replacement = %Y-%m-%d %H:%M:%S\n"
        "[web.sample]\nperDayVolume = 0.001\ninterval = 60\nearliest = -60s\n"
    )
    e = generate.generate(spark, pack, datetime(2026, 5, 5), executions=4)
    assert [r["raw"] for r in e.where("stanza = 'r.log'").orderBy("ordinal").collect()] == ["2026-05-05 00:00:00 a", "2026-05-05 00:00:00 b", "2026-05-05 00:00:08 c"]
    per = [(r["n"], r["b"]) for r in e.where("stanza = 'web.sample'").groupBy("interval_no").agg(F.count("*").alias("n"), F.sum(F.octet_length("raw") + 1).alias("b")).collect()]
    want = round(rate.per_interval_bytes(0.001, 60))
    assert len(per) == 4 and all(want - 40 < b <= want for _, b in per)


def test_rotate_stanza(spark, pack):
    (pack / "samples" / "j.log").write_text("user=610457 login\nuser=238819 register\nuser=610457 logout ID AB12CD\n")
    base = "[j.log]\ncount = 3\ninterval = 60\ntoken.0.token = user=(\\d+)\ntoken.0.replacementType = rotate\ntoken.0.replacement = keep\ntoken.1.token = ID (\\w+)\ntoken.1.replacementType = rotate\ntoken.1.replacement = keep\n"
    import re

    (pack / "default" / "eventgen.conf").write_text(base)
    rows = [r["raw"] for r in generate.generate(spark, pack, datetime(2026, 1, 1), executions=3).orderBy("ordinal").collect()]
    users = [re.match(r"user=([1-9]\d{5}) ", x)[1] for x in rows]
    assert len(rows) == 9 and len(set(users)) == 6 and all(users[k] == users[k + 2] for k in (0, 3, 6))
    assert all(re.search(r" ID [A-F][0-9A-F]{5}$", x) for x in rows[2::3]) and len(set(rows[2::3])) == 3
    (pack / "default" / "eventgen.conf").write_text(base + "rotate.scope = window\nrotate.period = 3600\nearliest = now\n")
    rows = [r["raw"] for r in generate.generate(spark, pack, datetime(2026, 1, 1), executions=3).orderBy("ordinal").collect()]
    assert len(set(rows)) == 3
    with pytest.raises(ValueError):
        rotate.policy_kind("digits(49)", "5")


def test_templates_equal_rewriting(spark, pack):
    """Where no token writes what another matches, templates and token-by-token rewriting agree."""
    both = [generate.generate(spark, pack, datetime(2026, 1, 1), executions=2, overrides={"templates": x}) for x in ("true", "false")]
    one, two = (sorted(map(str, x.collect())) for x in both)
    assert one == two
    assert template.compile_line("abcabc", ["b(c)", "c"]) is None
    assert template.compile_line("x=1 x=2", [r"x=(\d)"]) == template.Line(["x=", " x=", ""], [0, 0], ["1", "2"])


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(0, "é"), (1, ""), (86_400_000_000, "abc")], "time_us long, raw string")
    assert [(r["bytes"], r["events"]) for r in sinks.histogram(e).orderBy("day").collect()] == [(2, 2), (3, 1)]
    sinks.write_files(e, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["abc", "é"]
    sinks.devnull(e)


def test_stream_resumes(spark, tmp_path):
    """A stream that stops and starts again goes on at the next ordinal."""
    for end in (3, 5):
        q = ticks(spark, start=1_700_000_000, step=1, count=4, end=end).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["ordinal"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(20))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def conf_of(pack, text, **files):
    for name, body in files.items():
        (pack / "samples" / name.replace("__", ".")).write_text(body)
    (pack / "default" / "eventgen.conf").write_text(text)


def raws(e):
    return [r["raw"] for r in e.orderBy("ordinal").collect()]


def token(n, pattern, kind, value):
    return f"token.{n}.token = {pattern}\ntoken.{n}.replacementType = {kind}\ntoken.{n}.replacement = {value}\n"


@pytest.mark.parametrize("order", ["", "randomizeEvents = true\n", "bundlelines = true\n"])
def test_counting_tokens_count_matching_events(spark, pack, order):
    """Numbers and rows of a file are handed out to the events that a token matches, whatever the lines' order."""
    count = 3 if "bundle" in order else 7
    conf_of(pack, f"[c.log]\ncount = {count}\ninterval = 60\n{order}" + token(0, "N(#)", "integerid", "100") + token(1, "F(#)", "seqfile", "samples/three.list"), c__log="a N# F#\nb\nc F#\n", three__list="x\ny\nz\n")
    rows = raws(generate.generate(spark, pack, datetime(2026, 1, 1), executions=3))
    ids = [int(x.split("N")[1].split()[0]) for x in rows if "N" in x]
    assert ids == list(range(100, 100 + len(ids))) and len(ids) > 1
    cells = [x.split("F")[1] for x in rows if "F" in x]
    assert cells == [["x", "y", "z"][k % 3] for k in range(len(cells))]


def test_rated_float_and_bad_tokens(spark, pack):
    conf_of(pack, '[f.log]\ncount = 2\nhourOfDayRate = {"5": 3.0}\n' + token(0, "V", "rated", "float[10.00:10.00]") + token(1, "W", "rated", "integer[2:2]") + token(2, "X", "file", "samples/absent.list") + token(3, "Y", "timestamp", "plain"), f__log="V W X Y\n")
    assert raws(generate.generate(spark, pack, datetime(2026, 1, 1, 5))) == ["30.0 6 X Y"] * 6
    assert raws(generate.generate(spark, pack, datetime(2026, 1, 1, 4))) == ["10.0 2 X Y"] * 2


def test_synthetic_generators(spark, pack):
    conf_of(pack, "[w]\ngenerator = windbag\ncount = 4\nearliest = -2s\n[c]\ngenerator = counter\ncount = 2\nstart_count = 1.5\ncount_by = 0.5\nend_count = 9\nearliest = -4s\n")
    e = generate.generate(spark, pack, datetime(2026, 1, 1, 0, 0, 10))
    assert raws(e.where("stanza = 'w'")) == [f"2026-01-01 00:00:{t} -0700 WINDBAG Event {i} of 4" for i, t in enumerate(("08.500000", "09", "09.500000", "10"), 1)]
    assert raws(e.where("stanza = 'c'"))[1] == "2026-01-01 00:00:10-0700 Counter for sample:c, Now processing event counting 2 of 2 cycles. Counter Values: Start_Count: 1.5 Current_Counter:2 End_Count:9 Counting_By: 0.5"
    assert {r["time_us"] for r in e.collect()} == {generate.seconds(datetime(2026, 1, 1, 0, 0, 10)) * 1_000_000}


def test_indexes_change_by_batch(spark, pack):
    conf_of(pack, "[i.log]\ncount = 5000\nextendIndexes = a,p:9\n", i__log="x\n")
    got = {(r["b"], r["index"]) for r in generate.generate(spark, pack, datetime(2026, 1, 1)).selectExpr("i div 512 AS b", "index").distinct().collect()}
    assert len(got) == 10 and len({x for _, x in got}) > 2


def test_time_axis(spark, pack):
    def fires(extra, executions=4):
        conf_of(pack, f"[t.log]\ncount = 1\ninterval = 10\nearliest = now\n{extra}", t__log="x\n")
        return [r["time_us"] // 1_000_000 - generate.seconds(datetime(2026, 1, 1)) for r in generate.generate(spark, pack, datetime(2026, 1, 1), executions=executions).orderBy("ordinal").collect()]

    assert fires("") == [0, 10, 20, 30] == fires("end = -1\n")
    assert fires("end = 2\n") == [0, 10] and fires("end = 0\n") == []
    assert fires("end = +25s\n") == [0, 10, 20] and fires("end = 2026-01-01 00:00:10\n") == [0]
    assert fires("delay = 5\n", 2) == [5, 15]
    assert fires("timezone = -0130\n", 1) == [-5400] and fires("timezone = local\n", 1) == [0]
    # a sweep is one execution, then the live ones follow
    assert fires("backfill = -20s\nsequentialTimestamp = true\n", 3) == [-20, -10, 10, 20]
    assert fires("backfill = -20s\nbackfillOnly = true\nsequentialTimestamp = true\n", 3) == [-20, -10]


def test_replay_backfill(spark, pack):
    conf_of(pack, "[r.log]\nmode = replay\nbackfill = -10s\n" + token(0, r"^(\S+ \S+)", "replaytimestamp", "%y-%m-%d %H:%M:%S"), r__log="26-01-01 00:00:00 a\n26-01-01 00:00:04 b\n26-01-01 00:00:05 c\n")
    e = generate.generate(spark, pack, datetime(2026, 5, 5)).collect()
    at = sorted((r["time_us"] // 1_000_000 - generate.seconds(datetime(2026, 5, 5)), r["raw"][-1]) for r in e)
    # backward from now: c -1, b -5, a -5, c -6, b -10, a -10 and one beyond the horizon; then the recording
    assert at == sorted([(-11, "c"), (-10, "a"), (-10, "b"), (-6, "c"), (-5, "a"), (-5, "b"), (-1, "c"), (0, "a"), (0, "b"), (4, "c")])


@pytest.mark.parametrize("how", ["randomizeEvents", "bundlelines"])
def test_volume_by_other_orders(spark, pack, how):
    conf_of(pack, f"[v.log]\nperDayVolume = 0.01\ninterval = 3600\n{how} = true\n" + token(0, "##", "static", "12345678"), v__log="one ##\nlonger line of a sample ##\n")
    (s,) = conf.load(pack)
    lines = generate.sample_of(s)
    before, after = sum(r[2] for r in lines.rows), sum(r[2] + 6 for r in lines.rows)
    assert generate.size_ratio(spark, s, lines) == pytest.approx(before / after)
    n, written = generate.generate(spark, pack, datetime(2026, 1, 1), executions=2).agg(F.count("*"), F.sum(F.octet_length("raw") + 1)).first()
    wanted = 2 * rate.per_interval_bytes(0.01, 3600)
    assert n and wanted * 0.97 < written < wanted * 1.1


def test_lenient_times():
    want = {("2026-1-2 3:4:5", "%Y-%m-%d %H:%M:%S"): "2026-01-02 03:04:05", ("68/02/03", "%y/%m/%d"): "2068-02-03", ("69/02/03", "%y/%m/%d"): "1969-02-03", ("Mar  7 1:02:03 PM", "%b %d %I:%M:%S %p"): "1900-03-07 13:02:03", ("2026-01-02T03:04:05.12+0200", "%FT%T.%f%z"): "2026-01-02 03:04:05.120", ("2026 060", "%Y %j"): "2026-03-01"}
    for (text, fmt), t in want.items():
        assert timeexpr.scan_time(text, fmt) == datetime.fromisoformat(t), text
    assert timeexpr.scan_time("2026-01-02 x", "%Y-%m-%d") is None and timeexpr.scan_time("2026-13-02", "%Y-%m-%d") is None and timeexpr.scan_time("1", "%Q") is None
    assert timeexpr.parse_time("05/06/2026 03:04", NOW) == datetime(2026, 5, 6, 3, 4)
    assert [timeexpr.offset_seconds(x) for x in ("now", "-5m", "250ms", "+2d")] == [0, -300, 0.25, 172800]
    assert timeexpr.has_conversion("a%d") and not timeexpr.has_conversion("100%% of")


def test_patterns_of_both_dialects(spark):
    df = spark.sql("SELECT 'a[b] x&&y' AS t")
    assert df.select(tokens.rewrite(F.col("t"), "[][&]", F.lit("_"))).first()[0] == "a_b_ x__y"
    assert df.select(tokens.rewrite(F.col("t"), "(?:(x)|(y))&", F.lit("_"))).first()[0] == "a[b] _&&y"


def test_token_files(tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.list").write_text("a\n\nb\n")
    monkeypatch.setenv("PACK_DIR", str(tmp_path))
    for path in ("$PACK_DIR/d/f.list", "PACK_DIR\\d\\f.list", "d/f.list", "d/../d/f.list"):
        assert samples.resolve(path, tmp_path) == tmp_path / "d" / "f.list"
    assert samples.token_lines(tmp_path / "d" / "f.list") == ["a", "", "b"]
    assert len(conf.DEFAULTS) == 37


def test_files_rotate(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {i:02d}",) for i in range(10)] + [("",)], "raw string").coalesce(1)
    for backups, names in ((2, {"o", "o.1", "o.2"}), (0, {"o"})):
        at = tmp_path / str(backups)
        sinks.write_rotating(lines, str(at / "o"), max_bytes=24, backups=backups)
        assert {f.name for f in at.iterdir()} == names and (at / "o").read_text() == "line 09\n"
        assert all(f.stat().st_size <= 24 for f in at.iterdir())
    assert (tmp_path / "2" / "o.1").read_text() == "line 06\nline 07\nline 08\n"


class Collector:
    """A collector on a free port that refuses the first `refuse` posts."""

    def __init__(self, refuse=0):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
        from threading import Thread

        got = self.got = []
        left = [refuse]

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = self.rfile.read(int(self.headers["Content-Length"])).decode()
                left[0] -= 1
                self.send_response(503 if left[0] >= 0 else 200)
                self.end_headers()
                if left[0] < 0:
                    got.append((self.headers["Authorization"], body))

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.port = self.server.server_address[1]
        Thread(target=self.server.serve_forever, daemon=True).start()


def test_collector_gets_every_event(spark, pack):
    import json

    for refuse, allowed in ((1, 0), (0, 0)):
        c = Collector(refuse)
        servers = json.dumps({"servers": [{"protocol": "http", "address": "127.0.0.1", "port": c.port, "key": "k"}]})
        conf_of(pack, f"[h.log]\ncount = 30\noutputMode = httpevent\nhttpeventServers = {servers}\nhttpeventMaxPayloadSize = 500\nhttpeventAllowFailureCount = {allowed}\nhec.index = forced\nhost =\nhec.default.host = dflt\n", h__log="a\nb\n")
        (s,) = conf.load(pack)
        counted = sinks.deliver(generate.stanza_events(spark, s, datetime(2026, 1, 1)), s.settings).collect()
        objects = [json.loads(x) for _, body in c.got for x in body.split("\n")]
        assert len(objects) == 30 and {o["index"] for o in objects} == {"forced"} and all(a == "Splunk k" for a, _ in c.got)
        assert len(c.got) > 3 and sum(r["failed"] for r in counted) == 0
        c.server.shutdown()
    c = Collector(10_000)
    lines = spark.createDataFrame([("x",)], "line string")
    with pytest.raises(Exception, match="batches failed"):
        sinks.post_batches(lines, [f"http://127.0.0.1:{c.port}/"], "line", tries=2).collect()
    assert sinks.post_batches(lines, [f"http://127.0.0.1:{c.port}/"], "line", tries=1, allowed=1).first()["failed"] == 1


def test_output_modes(spark, pack, tmp_path):
    import json
    import socket
    from threading import Thread

    conf_of(pack, "[o.log]\ncount = 4\nsource = s&s\n", o__log="a<b\nc\n")
    (s,) = conf.load(pack)
    e = generate.stanza_events(spark, s, datetime(2026, 1, 1))
    out = []
    for mode in ("stdout", "nonsense"):
        out.clear()
        assert sinks.deliver(e, s.settings | {"outputMode": mode}, out.append) is None and out == ["a<b", "c", "a<b", "c"]
    out.clear()
    sinks.deliver(e, s.settings, out.append)
    assert "".join(out).startswith("<stream><event><time>1767225600</time><index>main</index>") and "<data>a&lt;b</data>" in out[0] and "<source>s&amp;s</source>" in out[0]
    sinks.deliver(e, s.settings | {"outputMode": "file", "fileName": str(tmp_path / "f")})
    assert (tmp_path / "f").read_text() == "a<b\nc\na<b\nc\n"
    sinks.deliver(e, s.settings | {"outputMode": "devnull"})
    assert sinks.deliver(e, s.settings | {"outputMode": "counter"}).first()["events"] == 4
    got = []
    server = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
    server.bind("/tmp/tidemill-test.sock") if not (tmp_path / "s").exists() else None
    server.listen(9)

    def take():
        while True:
            conn, _ = server.accept()
            got.append(b"".join(iter(lambda: conn.recv(65536), b"")))

    Thread(target=take, daemon=True).start()
    try:
        sinks.deliver(e, s.settings | {"outputMode": "stoker", "socketPath": "/tmp/tidemill-test.sock"})
        rows = [json.loads(x) for x in b"".join(got).decode().splitlines()]
        assert sorted(r["event"] for r in rows) == ["a<b", "a<b", "c", "c"] and {r["time"] for r in rows} == {1767225600}
    finally:
        import os

        os.unlink("/tmp/tidemill-test.sock")


def test_run_counts(spark, pack):
    conf_of(pack, "[n.log]\ncount = 4\n" + token(0, "b", "static", "x"), n__log="abab\n")
    e, seen = generate.observed(generate.generate(spark, pack, datetime(2026, 1, 1), executions=2))
    sinks.devnull(e)
    assert seen.get["events"] == 8 and seen.get["bytes"] == 32
    assert '"matches": 2' in generate.validate(pack)[0]


def test_stanza_streams(spark, pack, tmp_path):
    from tidemill.streaming.ticks import stanza_stream

    conf_of(pack, '[s.log]\ncount = 2\ninterval = 10\nearliest = now\nhourOfDayRate = {"22": 2.0}\n' + token(0, "T", "timestamp", "%H:%M:%S") + token(1, "#", "integerid", "7"), s__log="T #\nT # b\n")
    (s,) = conf.load(pack)
    start = 1_700_000_000  # 22:13:20
    for end in (2, 3):
        q = stanza_stream(spark, s, start, end=end).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    rows = raws(spark.read.parquet(str(tmp_path / "o")))
    assert [x.split()[1] for x in rows] == [str(7 + k) for k in range(12)] and rows[0].startswith("22:13:")
    conf_of(pack, "[s.log]\n" + token(1, "b", "integerid", "7"))
    with pytest.raises(ValueError):
        stanza_stream(spark, conf.load(pack)[0], start)


def test_cli(pack, tmp_path, capsys):
    from tidemill import cli

    conf_of(pack, "[k.log]\ncount = 2\noutputMode = stdout\n", k__log="a\nb\n")
    assert cli.main(["generate", str(pack), "--now", "2026-01-01T00:00:00", "-e", "2"]) == 0
    assert cli.main(["generate", str(pack), "--now", "2026-01-01T00:00:00", "--output", "counter", "--executions", "3"]) == 0
    assert "2026-01-01 6 6" in capsys.readouterr().out
    assert cli.main(["validate", str(pack)]) == 0 and cli.main(["generate", str(pack / "absent")]) == 2
