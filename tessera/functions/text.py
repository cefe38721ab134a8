"""Text expressions. All return Columns; nothing leaves the JVM.

White space is the ASCII set unless `unicode=True`; lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, MAIN_FLOOR, MAIN_SHARE, QUOTE_MIN = 1024, 512, 0.7, 20
QUOTE_MARK, ELLIPSIS = "\n[quoted] ", "..."

#: Content types and file extensions (fixed values).
EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/bmp": ".bmp",
    "image/tiff": ".tiff",
    "image/x-icon": ".ico",
    "image/avif": ".avif",
    "image/heic": ".heic",
    "image/heif": ".heif",
}


def clean(text: Column, unicode: bool = False, normalize_quotes: bool = False) -> Column:
    """URLs go, white space collapses, leading mentions go. Null becomes ''."""
    space = r"[\s\x0B   -     　﻿]" if unicode else r"\s"
    solid = space.replace("[", "[^", 1) if unicode else r"\S"
    out = F.regexp_replace(F.coalesce(text, F.lit("")), f"https?://{solid}+", "")
    out = F.trim(F.regexp_replace(out, f"{space}+", " "))
    out = F.regexp_replace(out, f"^(@[A-Za-z0-9_]+{space}*)+", "")
    if normalize_quotes:
        out = F.translate(out, "“”‘’", "\"\"''")
    return out


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def combine(main: Column, quoted: Column | None = None, max_chars: int = MAX_CHARS) -> Column:
    """struct(text, has_quotes, is_truncated, n_chars): main text, with the quoted one behind it as far as there is room.

    Overflowing pairs give the main text max(floor, share) of the room; the quoted text gets the rest if that is
    worth it and always ends in an ellipsis then.
    """
    # Texts are cleaned once: inside the lambda they are values, not expressions that every use repeats.
    nothing = F.lit(None).cast("string")
    parts = F.struct(clean(main).alias("main"), (nothing if quoted is None else clean(quoted)).alias("quote"), (F.lit(True) if quoted is None else is_blank(quoted)).alias("alone"))
    return F.get(F.transform(F.array(parts), lambda p: _combined(p["main"], p["quote"], p["alone"], quoted is not None, max_chars)), F.lit(0))


def _combined(main: Column, quote: Column, is_alone: Column, quotes: bool, max_chars: int) -> Column:
    for_main = max(min(MAIN_FLOOR, max_chars), int(max_chars * MAIN_SHARE))
    for_quote = max_chars - for_main - len(QUOTE_MARK) - len(ELLIPSIS)

    def cut(text: Column, room: int) -> Column:
        return F.when(F.length(text) > room, F.concat(F.substring(text, 1, room - len(ELLIPSIS)), F.lit(ELLIPSIS))).otherwise(text)

    def shaped(text: Column, has_quotes: Column, truncated: Column) -> Column:
        return F.struct(text.alias("text"), has_quotes.alias("has_quotes"), truncated.alias("is_truncated"), F.length(text).alias("n_chars"))

    alone = shaped(cut(main, max_chars), F.lit(False), F.length(main) > max_chars)
    if not quotes:
        return alone
    both = F.concat(main, F.lit(QUOTE_MARK), quote)
    short = F.concat(cut(main, for_main), F.lit(QUOTE_MARK), F.substring(quote, 1, max(for_quote, 0)), F.lit(ELLIPSIS)) if for_quote > QUOTE_MIN else cut(main, for_main)
    fits = F.length(both) <= max_chars
    return F.when(is_alone, alone).otherwise(shaped(F.when(fits, both).otherwise(short), fits | F.lit(for_quote > QUOTE_MIN), ~fits))


def labelled(kind: Column, text: Column, created_at: Column | None = None, quoted: Column | None = None) -> Column:
    """'[kind] text' or '[kind Mon dd, yyyy] text', with the quoted text on a line of its own."""
    body = clean(text)
    if quoted is not None:
        body = F.when(quoted.isNull(), body).otherwise(F.concat(body, F.lit(QUOTE_MARK), clean(quoted)))
    head = kind if created_at is None else F.concat(kind, F.lit(" "), F.date_format(created_at, "MMM dd, yyyy"))
    return F.concat(F.lit("["), head, F.lit("] "), body)


def fit_parts(parts: Column, max_chars: int) -> Column:
    """Parts of a thread (root first) that fit, in their order, each gap a single '<...>'.

    Priority: last, last but one, first, then the others from the newest; a part costs its length and 1. Empty parts
    are never chosen. Markers don't count.
    """
    n = F.size(parts)
    rest = F.when(n > 3, F.sequence(n - 2, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    order = F.array_distinct(F.filter(F.concat(F.array(n, n - 1, F.lit(1)), rest), lambda i: i >= 1))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("chosen"))

    def step(state: Column, i: Column) -> Column:
        part = F.element_at(parts, i)
        cost = F.length(part) + 1
        fits = (F.length(part) > 0) & (state["used"] + cost <= max_chars)
        return F.when(fits, F.struct((state["used"] + cost).alias("used"), F.array_append(state["chosen"], i).alias("chosen"))).otherwise(state)

    chosen = F.aggregate(order, start, step, lambda s: s["chosen"])
    marked = F.transform(parts, lambda p, i: F.when(F.array_contains(chosen, i + 1), F.struct(p.alias("text"), F.lit(False).alias("gap"))).otherwise(F.struct(F.lit("<...>").alias("text"), F.lit(True).alias("gap"))))
    kept = F.filter(marked, lambda p, i: ~(p["gap"] & (i > 0) & F.coalesce(F.get(marked, i - 1)["gap"], F.lit(False))))
    return F.when(n > 0, F.transform(kept, lambda p: p["text"])).otherwise(parts)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def preview(text: Column, room: int = 200) -> Column:
    return F.when(F.length(text) > room, F.concat(F.substring(text, 1, room), F.lit(ELLIPSIS))).otherwise(text)


def html_escape(text: Column) -> Column:
    out = text
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def shard_prefix(key: Column) -> Column:
    return F.when(F.length(key) >= 3, F.substring(key, 1, 3)).otherwise(F.lit("misc"))


def is_web_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def url_extension(url: Column, default: str = ".jpg") -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    found = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]{2,5})$", 1))
    return F.when(found == "", F.lit(default)).otherwise(found)


def content_type_extension(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.element_at(table, F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1)))))


def size_change(before: Column, after: Column) -> Column:
    """'reduced', 'increased' or 'unchanged', by the sign of the length difference."""
    d = F.length(after) - F.length(before)
    return F.when(d < 0, "reduced").when(d > 0, "increased").otherwise("unchanged")
