"""Texts as built-in expressions: identities, snippets, windows, names, verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: What a page says while it holds its reader back, and the lengths that tell stubs from texts.
CHALLENGES = ("just a moment", "checking your browser", "enable javascript", "captcha", "attention required", "verify you are human")
STUB_CHARS, CHALLENGE_CHARS = 200, 600
#: Width of an excerpt and what it shows before its first match.
WIDTH, LEAD = 1600, 100


def identity(query: Column) -> Column:
    """A query in lower case, with single spaces."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(query, F.lit("")))), r"\s+", " ")


def query_id(query: Column) -> Column:
    return F.substring(F.sha2(identity(query), 256), 1, 16)


def slugs(items: Column) -> Column:
    """Distinct slugs of an array in their order, empties dropped."""
    one = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""))
    return F.array_distinct(F.filter(one, lambda x: x != ""))


def verdict(body: Column, title: Column | str = "") -> Column:
    """ok, absent (a stub) or undetermined (a short page that asks its reader to wait or prove something)."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")
    title = F.lit(title) if isinstance(title, str) else F.coalesce(title, F.lit(""))
    held = F.lower(F.concat(title, F.lit(" "), text)).rlike("|".join(CHALLENGES))
    return F.when((F.length(text) > 0) & (F.length(text) < CHALLENGE_CHARS) & held, "undetermined").when(F.length(text) < STUB_CHARS, "absent").otherwise("ok")


def snippet(text: Column, limit: int = 240) -> Column:
    """White space collapsed; over ``limit`` characters it is cut after a whole word, with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    head = F.substring(t, 1, limit)
    last = F.length(head) - F.locate(" ", F.reverse(head)) + 1  # 1-based place of the last space, length + 1 without one
    cut = F.when((F.locate(" ", head) > 0) & (last > 1), F.substring(head, F.lit(1), last - 1)).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def name_tokens(text: Column) -> Column:
    """Lower-case words and numbers, a long word's plural s dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(found, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w))


def names(name: Column, text: Column) -> Column:
    """Whether a text has a name's words side by side; no name is in any text."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(name_tokens(c), " "), F.lit(" "))
    return (F.size(name_tokens(name)) > 0) & F.contains(spaced(text), spaced(name))


def listed(items: Column, shown: int = 3) -> Column:
    """'a', 'a and b', 'a, b and c', 'a, b, c and 2 others'; null for no items."""
    rest = F.size(items) - shown
    more = F.concat(rest.cast("string"), F.when(rest > 1, " others").otherwise(" other"))
    all_of = F.when(rest > 0, F.array_append(F.slice(items, 1, shown), more)).otherwise(items)
    head = F.array_join(F.slice(all_of, 1, F.greatest(F.size(all_of) - 1, F.lit(1))), ", ")
    return F.when(F.size(all_of) == 1, F.get(all_of, F.lit(0))).when(F.size(all_of) > 1, F.concat(head, F.lit(" and "), F.element_at(all_of, -1)))


def from_positions(index: Column) -> Column:
    """The text of a map of words to their positions; of words at one position the larger one stands. Null: empty."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.sort_array(pairs)
    last = F.filter(ordered, lambda x, i: ~F.coalesce(F.get(ordered, i + 1)["p"] == x["p"], F.lit(False)))
    return F.coalesce(F.array_join(F.transform(last, lambda x: x["w"]), " "), F.lit(""))


def passage(name: str, text: Column, width: int = 200) -> Column:
    """The text around the first place that has a name's words side by side, about ``width`` characters on either side; null if none does.

    Case and a long word's plural s don't matter. Words that the edges cut are left out, and an ellipsis says that more is there.
    """
    words = [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in re.findall("[a-z0-9]+", name.lower())]
    if not words:
        return F.lit(None).cast("string")
    found = "[^a-zA-Z0-9]+".join(f"{w}{'s?' if len(w) > 2 else ''}" for w in words)
    shape = f"(?is)^(.*?)(?<![a-zA-Z0-9])({found})(?![a-zA-Z0-9])(.*)$"
    before, own, after = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    head, tail = F.right(before, F.lit(width)), F.left(after, F.lit(width))
    left = F.when(F.length(before) > width, F.when(F.instr(head, " ") > 0, F.regexp_replace(head, "^[^ ]* ", "")).otherwise(head)).otherwise(before)
    right = F.when(F.length(after) > width, F.when(F.instr(tail, " ") > 0, F.regexp_replace(tail, " [^ ]*$", "")).otherwise(tail)).otherwise(after)
    body = F.trim(F.regexp_replace(F.concat(left, own, right), r"\s+", " "))
    return F.when(own != "", F.concat(F.when(F.length(before) > width, "…").otherwise(""), body, F.when(F.length(after) > width, "…").otherwise("")))
