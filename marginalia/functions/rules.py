"""Tables of rules over addresses, compiled to one expression: which host, what follows it, and what is said of it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

#: What a template may do with a group of its pattern.
CHANGES: dict[str, Callable[[Column], Column]] = {
    "": lambda c: c,
    "lower": F.lower,
    "decoded": lambda c: F.coalesce(F.try_url_decode(c), c),
    "stem": lambda c: F.regexp_replace(c, r"(?i)\.html$", ""),
    "squeezed": lambda c: F.regexp_replace(c, "/+", "/"),
}


class Address:
    """The parts of an address that rules look at: itself trimmed, its host without www, and the path with its query."""

    def __init__(self, url: Column, host: Column, rest: Column) -> None:
        self.url, self.host, self.rest = url, host, rest

    def on(self, hosts: str) -> Column:
        """Whether the host is one of ``hosts``: ``a.b`` itself, ``.a.b`` also below it, ``*.a.b`` only below it; ``any`` is every host."""
        if hosts == "any":
            return F.lit(True)
        one = lambda h: self.host.endswith(h[1:]) if h[0] == "*" else (self.host == h[1:]) | self.host.endswith(h) if h[0] == "." else self.host == h
        return reduce(Column.__or__, map(one, hosts.split()))


def within(url: Column, said: Callable[[Address], Column], same: dict[str, str] | None = None) -> Column:
    """``said`` of an address's parts, which are worked out once; ``same`` are other names of hosts."""
    text = F.trim(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_extract(F.lower(text), r"^(?:[a-z][a-z0-9+.-]*://|//)?(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^www\.", "")
    for alias, known in (same or {}).items():
        host = F.when(host == alias, known).otherwise(host)
    rest = F.regexp_extract(text, r"^(?:[a-zA-Z][\w+.-]*://|//)?[^/?#]*([^#]*)", 1)
    parts = F.array(F.struct(text.alias("url"), host.alias("host"), rest.alias("rest")))
    return F.get(F.transform(parts, lambda a: said(Address(a["url"], a["host"], a["rest"]))), F.lit(0))


def compiled(rules: list[tuple[str, str, str]], at: Address) -> Column:
    """What the first rule that fits says; null if none does or it says ``-``.

    A rule is (hosts, pattern, template). The pattern is sought in what follows the host, or with ``url`` before it in
    the whole address; case matters unless the pattern says otherwise. A template has text, {host}, {label} (the host
    up to its first dot) and {1}, {2}... for the pattern's groups, changed as in {1:lower}.
    """
    steps = F
    for hosts, pattern, template in rules:
        where, shape = (at.url, pattern[4:]) if pattern.startswith("url ") else (at.rest, pattern)
        fits = at.on(hosts) & where.rlike(shape) if shape else at.on(hosts)
        steps = steps.when(fits, F.lit(None).cast("string") if template == "-" else _filled(template, where, shape, at))
    return steps


def _filled(template: str, where: Column, shape: str, at: Address) -> Column:
    parts = []
    for text, name, change in re.findall(r"([^{}]+)|\{(\w+):?(\w*)\}", template):
        known = {"host": at.host, "label": F.regexp_extract(at.host, r"^[^.]*", 0)}
        value = F.lit(text) if text else known[name] if name in known else F.regexp_extract(where, shape, int(name))
        parts.append(CHANGES[change](value))
    return F.concat(*parts) if parts else F.lit("")
