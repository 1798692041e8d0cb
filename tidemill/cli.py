"""python -m tidemill.cli generate|validate|bench CONF. Exit codes: 0 done, 1 failed, 2 the conf can't be loaded."""

from __future__ import annotations

import argparse
import sys
import time
from datetime import datetime


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    from .operators import sinks
    from .plans import generate

    p = argparse.ArgumentParser("tidemill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("generate", "validate", "bench"):
        c = sub.add_parser(name)
        c.add_argument("conf")
        c.add_argument("-s", "--sample")
        c.add_argument("-c", "--count")
        c.add_argument("-i", "--interval")
        c.add_argument("-b", "--backfill")
        c.add_argument("-e", "--end", help="executions, or a time")
        c.add_argument("--executions", type=int, default=1, help="executions where no end is set")
        c.add_argument("--output", help="output mode, over the conf's")
        c.add_argument("--socket", help="unix socket of the output mode stoker")
        c.add_argument("--duration", type=float, help="stream at the pace of the clock for so many seconds")
        for flag in ("--multiprocess", "--disableOutputQueue", "--profiler", "--disable-logging"):
            c.add_argument(flag, action="store_true", help=argparse.SUPPRESS)
        for flag in ("--outputters", "--generator-queue-size"):
            c.add_argument(flag, help=argparse.SUPPRESS)
        c.add_argument("--seed", type=int, default=7)
        c.add_argument("--now", help="the time to run at (default: now)")
        c.add_argument("--devnull", action="store_true")
        c.add_argument("--out", help="a folder for line files")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.command == "version":
        from . import __version__

        print(__version__)
        return 0
    over = {k: v for k, v in (("count", a.count), ("interval", a.interval), ("backfill", a.backfill), ("end", a.end), ("outputMode", a.output), ("socketPath", a.socket)) if v is not None}
    try:
        if a.command == "validate":
            print("\n".join(generate.validate(a.conf)))
            return 0
        if a.command == "bench":
            over |= {"count": a.count or "2000000", "interval": "1"}
        now = datetime.fromisoformat(a.now) if a.now else datetime.utcnow().replace(microsecond=0)
        spark = session()
        if a.command == "generate" and not (a.devnull or a.out):
            return run(spark, a, now, over)
        events = generate.generate(spark, a.conf, now, a.executions, a.seed, a.sample, over)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    began = time.time()
    if a.command == "bench":
        from pyspark.sql import functions as F

        r = events.agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).alias("b")).first()
        took = time.time() - began
        print(f"{r['n']} events, {r['n'] / took:.0f} a second, {(r['b'] or 0) / took / 1e6:.1f} MB/s")
    elif a.devnull:
        sinks.devnull(events)
    else:
        sinks.write_files(events, a.out)
    return 0


def run(spark, a, now: datetime, over: dict[str, str]) -> int:
    """Each stanza to its own output; with a duration as streams. What a run counted goes to the standard error."""
    from .operators import sinks
    from .plans import generate
    from .sources import conf
    from .streaming.ticks import stanza_stream

    stanzas = conf.load(a.conf, a.sample, over)
    if not stanzas:
        raise ValueError(f"{a.conf}: nothing to run")
    if a.duration:
        running = [
            stanza_stream(spark, s, generate.seconds(now), a.seed).writeStream.foreachBatch(lambda df, _, c=s.settings: sinks.deliver(df, c) and None).start() for s in stanzas if s.settings["generator"] not in ("replay", "perdayvolume")
        ]
        time.sleep(a.duration)
        for q in running:
            q.stop()
        return 0
    for s in stanzas:
        events, seen = generate.observed(generate.stanza_events(spark, s, now, a.executions, a.seed), s.name)
        counted = sinks.deliver(events, s.settings)
        if counted is not None:
            print("\n".join(" ".join(map(str, r)) for r in counted.collect()))
        if s.settings.get("outputMode") in ("devnull", "counter"):  # whole runs; others stream to the driver or post
            print(f"{s.name}: {seen.get}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
