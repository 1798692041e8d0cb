"""Conf loading: layers, inheritance, stanza to file matching, flattening, token assembly. All on the driver: confs are small."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from .ini import parse

#: Defaults of a stanza's settings.
DEFAULTS = {
    "disabled": "false", "debug": "false", "verbosity": "false", "spoolDir": "$SPLUNK_HOME/var/spool/splunk", "spoolFile": "<SAMPLE>", "breaker": r"[^\r\n\s]+", "mode": "sample", "sampletype": "raw", "interval": "60", "delay": "0",
    "timeMultiple": "1", "count": "-1", "earliest": "now", "latest": "now", "randomizeEvents": "false", "outputMode": "modinput", "fileMaxBytes": "10485760", "fileBackupFiles": "5", "splunkPort": "8089", "splunkMethod": "https",
    "index": "main", "sourcetype": "eventgen", "host": "127.0.0.1", "generator": "default", "rater": "config", "generatorWorkers": "1", "outputWorkers": "1", "timeField": "_raw", "threading": "thread", "profiler": "false",
    "maxIntervalsBeforeFlush": "3", "maxQueueLength": "0", "useOutputQueue": "false", "autotimestamp": "false", "httpeventWaitResponse": "true", "disableLoggingQueue": "true", "splitSample": "0",
}
FIELDS = ("token", "replacementType", "replacement", "offsetMin", "offsetMax")
RATES = ("hourOfDayRate", "dayOfWeekRate", "minuteOfHourRate")


@dataclass
class Token:
    index: int
    token: str
    replacementType: str
    replacement: str
    offsetMin: str | None = None
    offsetMax: str | None = None


@dataclass
class Stanza:
    stanza: str
    name: str
    path: Path | None
    settings: dict[str, str]
    tokens: list[Token]
    explicit: set[str] = field(default_factory=set)
    host_token: Token | None = None


def truthy(x: str | None) -> bool:
    return x not in (None, "", "0", "false", "False")


def matches(pattern: str, name: str) -> bool:
    """A stanza's name as a pattern over a whole file name; a name that is no pattern counts as text."""
    try:
        return re.fullmatch(pattern, name) is not None
    except re.error:
        return pattern == name


def assemble(keys: dict[str, str]) -> list[Token]:
    """token.N.field keys, by N; incomplete ones are dropped."""
    found: dict[int, dict[str, str]] = {}
    for k, v in keys.items():
        m = re.fullmatch(r"token\.(\d+)\.(\w+)", k)
        if m and m[2] in FIELDS:
            found.setdefault(int(m[1]), {})[m[2]] = v
    return [Token(n, **f) for n, f in sorted(found.items()) if {"token", "replacementType", "replacement"} <= f.keys()]


def read_layers(path: str | Path) -> tuple[dict[str, dict[str, str]], dict[str, str], Path]:
    """Sections, global settings and the samples folder of a conf file, or of an app folder (default, then local)."""
    path = Path(path)
    files = [path / "default" / "eventgen.conf", path / "local" / "eventgen.conf"] if path.is_dir() else [path]
    sections: dict[str, dict[str, str]] = {}
    shared: dict[str, str] = {}
    for f in files:
        if not f.exists():
            continue
        ini = parse(f.read_text(encoding="utf-8"))
        shared |= ini.defaults | ini.sections.pop("global", {}) | ini.defaults
        for name, keys in ini.sections.items():
            sections[name] = sections.get(name, {}) | ini.defaults | keys
    folder = path / "samples" if path.is_dir() else path.parent.parent / "samples"
    return sections, shared, folder


def inherit(sections: dict[str, dict[str, str]]) -> dict[str, tuple[dict[str, str], list[Token]]]:
    """A stanza whose name, as a pattern, matches the start of another's gives it its tokens, renumbered behind the other's own, and its unset keys."""
    out = {}
    for name, keys in sections.items():
        own, tokens = dict(keys), assemble(keys)
        for parent, theirs in sections.items():
            if parent == name:
                continue
            try:
                hit = re.match(parent, name)
            except re.error:
                hit = None
            if not hit:
                continue
            base = max((t.index for t in tokens), default=-1) + 1
            tokens += [Token(base + i, *(getattr(t, f) for f in FIELDS)) for i, t in enumerate(assemble(theirs))]
            for k, v in theirs.items():
                if "token" not in k and k not in ("host.replacement",) and k not in keys:
                    own[k] = v
        out[name] = (own, tokens)
    return out


def post_rules(s: Stanza) -> Stanza:
    """Settings that follow from others: per-day volume, replay mode, the source's name."""
    c = s.settings
    if float(c.get("perDayVolume") or 0) > 0:
        c |= {"generator": "perdayvolume", "count": "1"}
    elif c.get("mode") == "replay":
        c |= {"generator": "replay", "count": "1"}
        for k in ("earliest", "latest"):
            c[k] = c[k] if k in s.explicit else "now"
        for k in ("randomizeCount", *RATES):
            c.pop(k, None)
        if "interval" not in s.explicit:
            c["interval"] = "0"
        c.setdefault("end", "1")
    if not c.get("source"):
        c["source"] = s.path.name if s.path else c["generator"]
    return s


def load(path: str | Path, only: str | None = None, overrides: dict[str, str] | None = None) -> list[Stanza]:
    """The stanzas to run, a row for each (stanza, sample file). only: a pattern of stanza names. overrides win over everything."""
    sections, shared, folder = read_layers(path)

    def listed(where: str | None) -> list[Path]:
        at = Path(where) if where else folder
        at = at if at.is_absolute() else folder.parent / at
        return sorted(f for f in at.iterdir() if f.is_file()) if at.is_dir() else []

    return resolve(sections, shared, listed, only, overrides)


def matched(pattern: str, names: list[str]) -> list[str]:
    """The file names that a stanza's name spans whole, in order of name."""
    return sorted(n for n in names if matches(pattern, n))


def resolve(sections: dict[str, dict[str, str]], shared: dict[str, str], listed, only: str | None = None, overrides: dict[str, str] | None = None) -> list[Stanza]:
    """The stanzas of layered sections; listed(sampleDir or None) gives the sample files there."""
    sections = {n: k for n, k in sections.items() if not truthy(k.get("disabled", "false"))}
    raw: list[Stanza] = []
    for name, (keys, tokens) in inherit(sections).items():
        if only and not matches(only, name):
            continue
        settings = DEFAULTS | shared | keys
        found = {f.name: f for f in listed(settings.get("sampleDir"))}
        files = [found[n] for n in matched(name, list(found))]
        if not files and settings["generator"] in ("default", "replay"):
            continue
        host = Token(0, keys["host.token"], "file", keys["host.replacement"]) if {"host.token", "host.replacement"} <= keys.keys() else None
        for f in files or [None]:
            raw.append(Stanza(name, f.name if f else name, f, dict(settings), list(tokens), set(keys), host))
    out = flatten(raw)
    for s in out:
        post_rules(s)
        s.settings |= overrides or {}
        if overrides and "count" in overrides:
            for k in ("backfill", "backfillEnd"):
                if k not in overrides:
                    s.settings.pop(k, None)
    return out


def flatten(raw: list[Stanza]) -> list[Stanza]:
    """For each file the exact stanza, else the longest one; the settings that the others set fill what it doesn't, and their tokens follow its own."""
    out: list[Stanza] = []
    for path_ in dict.fromkeys(s.path for s in raw):
        group = [s for s in raw if s.path == path_]
        if path_ is None:
            out += group
            continue
        best = max(group, key=lambda s: (s.stanza == path_.name, len(s.stanza), s.stanza))
        for other in reversed([s for s in group if s is not best]):
            for k in other.explicit:
                if k not in best.explicit and not k.startswith("token."):
                    best.settings[k] = other.settings[k]
            base = max((t.index for t in best.tokens), default=-1) + 1
            best.tokens += [Token(base + i, *(getattr(t, f) for f in FIELDS)) for i, t in enumerate(other.tokens)]
        out.append(best)
    return out
