"""INI files as event-generator confs have them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Ini:
    """sections in file order; defaults: the DEFAULT section, which is not merged into the others here."""

    sections: dict[str, dict[str, str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)


def parse(text: str) -> Ini:
    """Case-sensitive keys, split at the first = or :. Full-line # and ; comments. Deeper-indented lines continue a value. Sections of the same name merge; the last key wins."""
    out, at, key, indent = Ini(), None, None, 0
    for no, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        body, depth = line.strip(), len(line) - len(line.lstrip())
        if not body or body[0] in "#;":
            continue
        if key is not None and depth > indent:
            at[key] += "\n" + body
            continue
        if body[0] == "[" and "]" in body:
            name = body[1 : body.rindex("]")]
            at = out.defaults if name == "DEFAULT" else out.sections.setdefault(name, {})
            key = None
            continue
        cut = min((i for i in (body.find("="), body.find(":")) if i >= 0), default=-1)
        if at is None or cut < 0:
            raise ValueError(f"line {no}: no {'section' if at is None else 'value'}")
        key, indent = body[:cut].rstrip(), depth
        at[key] = body[cut + 1 :].strip()
    return out


def render(ini: Ini) -> str:
    parts = []
    for name, keys in ([("DEFAULT", ini.defaults)] if ini.defaults else []) + list(ini.sections.items()):
        parts.append("\n".join([f"[{name}]", *(f"{k} = " + v.replace("\n", "\n\t") for k, v in keys.items())]) + "\n")
    return "\n".join(parts)
