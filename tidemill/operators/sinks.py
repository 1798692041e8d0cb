"""Sinks: text files, counters, collectors over HTTP, sockets, nothing."""

from __future__ import annotations

import gzip
import json
import logging
import socket
import time
import urllib.request
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import envelope

log = logging.getLogger(__name__)


def histogram(events: DataFrame, time_us: str = "time_us", raw: str = "raw") -> DataFrame:
    """day, bytes, events."""
    day = F.to_date(F.timestamp_micros(F.col(time_us)))
    return events.groupBy(day.alias("day")).agg(F.sum(F.octet_length(raw)).cast("bigint").alias("bytes"), F.count("*").alias("events"))


def write_files(events: DataFrame, path: str, raw: str = "raw", max_records: int = 1_000_000) -> None:
    """Line files; empty events are skipped; max_records bounds a file, as rotation by size does."""
    events.where(F.col(raw) != "").select(F.col(raw).alias("value")).write.option("maxRecordsPerFile", max_records).mode("append").text(path)


def devnull(events: DataFrame) -> None:
    events.write.format("noop").mode("overwrite").save()


class RotatingFile:
    """Appends lines; a line that would pass max_bytes first moves the file to .1, that one to .2 and so on up to `backups` (0: the file starts anew). Empty events are skipped."""

    def __init__(self, path: str, max_bytes: int = 10_485_760, backups: int = 5):
        self.path, self.max_bytes, self.backups = Path(path), max_bytes, backups
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.file = open(self.path, "ab")
        self.size = self.path.stat().st_size

    def write(self, line: str) -> None:
        if not line:
            return
        data = line.encode("utf-8", "surrogatepass") + b"\n"
        if self.size and self.size + len(data) > self.max_bytes:
            self._turn()
        self.file.write(data)
        self.size += len(data)

    def _turn(self) -> None:
        self.file.close()
        named = [self.path, *(self.path.with_name(f"{self.path.name}.{n}") for n in range(1, self.backups + 1))]
        for older, newer in reversed(list(zip(named[1:], named))):
            if newer.exists():
                newer.replace(older)
        self.file, self.size = open(self.path, "wb"), 0

    def close(self) -> None:
        self.file.close()


def write_rotating(lines: DataFrame, path: str, column: str = "raw", max_bytes: int = 10_485_760, backups: int = 5) -> None:
    """One local file in the order of lines, streamed to the driver a partition at a time. For files on a cluster use write_files."""
    out = RotatingFile(path, max_bytes, backups)
    for r in lines.select(column).toLocalIterator():
        out.write(r[0])
    out.close()


def modinput_batches(events: DataFrame, xml: str = "xml", size: int = 512) -> DataFrame:
    """A row `stream` for each batch of at most `size` events of a task: <stream>, the events, </stream>."""

    def run(batches):
        for b in batches:
            lines = b.column(xml).to_pylist()
            yield pa.RecordBatch.from_pydict({"stream": ["<stream>" + "".join(lines[i : i + size]) + "</stream>" for i in range(0, len(lines), size)]})

    return events.select(xml).mapInArrow(run, "stream string")


class Poster:
    """POSTs newline-joined batches of at most max_bytes, to one of urls in turn or to each; a failed POST is repeated, and more than `allowed` lost ones raise."""

    def __init__(self, urls: list[str], token: str = "", max_bytes: int = 10_000, compress: bool = False, mirror: bool = False, allowed: int = 0, tries: int = 3, wait: float = 0.2):
        self.urls, self.token, self.max_bytes, self.compress, self.mirror = urls, token, max_bytes, compress, mirror
        self.allowed, self.tries, self.wait = allowed, tries, wait
        self.sent: dict[str, list[int]] = {u: [0, 0] for u in urls}
        self.held: list[str] = []
        self.size = self.turn = 0

    def add(self, line: str) -> None:
        n = len(line.encode()) + 1
        if self.held and self.size + n > self.max_bytes:
            self.flush()
        self.held.append(line)
        self.size += n

    def flush(self) -> None:
        if not self.held:
            return
        body = "\n".join(self.held).encode()
        self.held, self.size = [], 0
        headers = {"Authorization": f"Splunk {self.token}", **({"Content-Encoding": "gzip"} if self.compress else {})}
        for url in self.urls if self.mirror else [self.urls[self.turn % len(self.urls)]]:
            self._post(urllib.request.Request(url, gzip.compress(body) if self.compress else body, headers), url)
        self.turn += 1

    def _post(self, request, url: str) -> None:
        for k in range(self.tries):
            try:
                urllib.request.urlopen(request, timeout=30).read()
                self.sent[url][0] += 1
                return
            except OSError as e:
                fault = e
                time.sleep(self.wait * k)
        self.sent[url][0] += 1
        self.sent[url][1] += 1
        if sum(x[1] for x in self.sent.values()) > self.allowed:
            raise OSError(f"{url}: more than {self.allowed} batches failed") from fault


def post_batches(objects: DataFrame, urls: list[str], column: str, token: str = "", max_bytes: int = 10_000, compress: bool = False, mirror: bool = False, allowed: int = 0, tries: int = 3) -> DataFrame:
    """Posts from each task (see Poster; the order within a task is kept). Returns (url, posts, failed); at least once: a task that fails is repeated whole."""

    def run(batches):
        p = Poster(urls, token, max_bytes, compress, mirror, allowed, tries)
        for b in batches:
            for line in b.column(0).to_pylist():
                p.add(line)
        p.flush()
        yield pa.RecordBatch.from_pydict({"url": list(p.sent), "posts": [v[0] for v in p.sent.values()], "failed": [v[1] for v in p.sent.values()]})

    return objects.select(column).mapInArrow(run, "url string, posts long, failed long").groupBy("url").agg(F.sum("posts").alias("posts"), F.sum("failed").alias("failed"))


def send_socket(lines: DataFrame, path: str, column: str) -> None:
    """Newline-ended lines to a unix socket that every executor has; a failure fails the task, which is then repeated (at least once)."""

    def run(rows):
        with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
            s.connect(path)
            for r in rows:
                s.sendall((r[0] + "\n").encode())

    lines.select(column).foreachPartition(run)


MODES = ("stdout", "file", "devnull", "counter", "modinput", "httpevent", "stoker")


def deliver(events: DataFrame, settings: dict[str, str], out=print) -> DataFrame | None:
    """Sends a stanza's events where its outputMode says; an unknown mode warns and prints. Returns what the sink counts (counter, httpevent), if anything.

    stdout and file: raw lines. modinput: XML batches, printed. stoker: agent lines to the unix socket `socketPath`. httpevent: collector objects to the servers of
    the JSON httpeventServers, their index, host, source and sourcetype overridden by hec.<field> or, where an event has none, hec.default.<field>.
    """
    c = settings
    mode = c.get("outputMode", "modinput")
    if mode not in MODES:
        log.warning("no output mode %s: printing", mode)
        mode = "stdout"
    ordered = events.orderBy("stanza", "ordinal")
    whole = c.get("generator") != "replay"
    seconds = F.floor(F.col("time_us") / 1_000_000)
    meta = [F.col(k) for k in ("host", "source", "sourcetype", "index")]
    if mode == "devnull":
        devnull(events)
    elif mode == "counter":
        return histogram(events)
    elif mode == "file":
        write_rotating(ordered, c["fileName"], "raw", int(float(c["fileMaxBytes"])), int(float(c["fileBackupFiles"])))
    elif mode == "stoker":
        send_socket(events.select(envelope.agent_line(seconds if whole else F.col("time_us") / 1_000_000, *meta, F.col("raw")).alias("line")), c["socketPath"], "line")
    elif mode == "httpevent":
        servers = json.loads(c["httpeventServers"])["servers"]
        urls = [f"{x.get('protocol', 'https')}://{x['address']}:{x.get('port', 8088)}/services/collector" for x in servers]
        over = {k: c[f"hec.{k}"] for k in ("host", "source", "sourcetype", "index") if c.get(f"hec.{k}")}
        under = {k: c[f"hec.default.{k}"] for k in ("host", "source", "sourcetype", "index") if c.get(f"hec.default.{k}")}
        line = envelope.collector_object(seconds if whole else F.col("time_us") / 1_000_000, *meta, F.col("raw"), over, under)
        policy = {"max_bytes": int(c.get("httpeventMaxPayloadSize") or 10_000), "mirror": c.get("httpeventOutputMode") == "mirror", "allowed": int(c.get("httpeventAllowFailureCount") or 100)}
        done = post_batches(events.select(line.alias("line")), urls, "line", servers[0].get("key", ""), **policy)
        return events.sparkSession.createDataFrame(done.collect(), done.schema)  # a row a server; posting must run once
    elif mode == "modinput":
        time_ = envelope.time_text(F.col("time_us"), whole)
        xml = envelope.xml_event(time_, F.col("index"), F.col("sourcetype"), F.col("source"), F.col("host"), F.col("raw"))
        for r in modinput_batches(ordered.select(xml.alias("xml"))).toLocalIterator():
            out(r[0])
    else:
        for r in ordered.select("raw").toLocalIterator():
            out(r[0])
    return None
