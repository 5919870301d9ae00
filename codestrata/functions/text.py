"""Text functions as Column expressions. Lengths are UTF-8 bytes where the name says bytes, else characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def lines(c: Column) -> Column:
    """Lines without their ends; a final line feed ends the last line and opens no other, a carriage return before one goes."""
    parts = F.split(c, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def bytes_len(c: Column) -> Column:
    return F.octet_length(c)


def rtrim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def ltrim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+$", ""), r"^\s+", "")


def within_budget(items: Column, most: int, first_free: bool) -> Column:
    """The leading items whose bytes, with one for each line feed, stay within ``most``; the first needs none if
    ``first_free``. A running sum never falls, so this is where a loop would stop."""
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("on"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        cost = F.octet_length(x) + (F.when(F.size(a["out"]) > 0, 1).otherwise(0) if first_free else F.lit(1))
        fits = a["on"] & (a["used"] + cost <= most)
        return F.struct((a["used"] + F.when(fits, cost).otherwise(0)).alias("used"), fits.alias("on"), F.when(fits, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))

    return F.aggregate(items, start, step, lambda a: a["out"])


def normalize_code_light(c: Column, most: int) -> Column:
    """Right-trimmed lines, runs of blank ones collapsed to one, within ``most`` bytes, each ended by a line feed."""
    trimmed = F.transform(lines(c), rtrim_ws)
    # Framed by line feeds, a run of blank lines is a run of three feeds or more; a fold over the lines would be quadratic.
    framed = F.regexp_replace(F.concat(F.lit("\n"), F.array_join(trimmed, "\n"), F.lit("\n")), "\n{3,}", "\n\n")
    dense = F.split(F.substring(framed, F.lit(2), F.char_length(framed) - 2), "\n", -1)
    dense = F.when(F.size(trimmed) == 0, F.array().cast("array<string>")).otherwise(dense)
    return F.array_join(F.transform(within_budget(dense, most, first_free=False), lambda x: F.concat(x, F.lit("\n"))), "")


def join_compact(parts: list[Column], most: int, sep: str = " · ", parts_max: int = 7) -> Column:
    """Non-empty parts joined by ``sep`` within ``most`` bytes; the separator goes in before the part is tried."""
    given = F.slice(F.filter(F.array(*[trim_ws(p) for p in parts]), lambda x: x.isNotNull() & (x != "")), 1, parts_max)
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("on"))

    def step(a, x):
        opened = F.when(a["out"] == "", F.lit("")).otherwise(F.concat(a["out"], F.lit(sep)))
        fits = F.octet_length(opened) + F.octet_length(x) <= most
        return F.when(~a["on"], a).otherwise(F.struct(F.when(fits, F.concat(opened, x)).otherwise(opened).alias("out"), fits.alias("on")))

    return F.aggregate(given, start, step, lambda a: a["out"])


def clamp_snippet(c: Column, most: int, lines_max: int) -> Column:
    """Whole lines within both budgets, the end trimmed."""
    kept = within_budget(F.slice(lines(c), 1, lines_max), most, first_free=False)
    return rtrim_ws(F.array_join(kept, "\n"))


def clamp_ellipsis(c: Column, most: int, lines_max: int, ellipsis: bool = True, zero_is_all: bool = True) -> Column:
    """Whole lines within both budgets (line feeds cost from the second line on); an ellipsis where lines were left out,
    for which characters are dropped until it fits. ``zero_is_all``: 0 lines means no bound, else an empty result."""
    if lines_max == 0 and not zero_is_all:
        return F.when(c.isNotNull(), F.lit(""))
    every = lines(c)
    kept = within_budget(every if lines_max == 0 else F.slice(every, 1, lines_max), most, first_free=True)
    joined = F.array_join(kept, "\n")
    if not ellipsis:
        return joined
    room = most - len(ELLIPSIS.encode())
    # Drop whole characters from the end: at most as many as the ellipsis has bytes.
    cut = joined
    for _ in range(len(ELLIPSIS.encode())):
        cut = F.when(F.octet_length(cut) > room, F.left(cut, F.greatest(F.char_length(cut) - 1, F.lit(0)))).otherwise(cut)
    return F.when(F.size(kept) < F.size(every), F.concat(cut, F.lit(ELLIPSIS))).otherwise(joined)


def _byte_prefix(c: Column, most: int, over: bool) -> Column:
    """The longest prefix of whole characters within ``most`` bytes; with ``over`` the shortest that reaches them."""
    body = F.encode(c, "UTF-8")
    cut = lambda n: F.substring(body, 1, n).cast("string")
    return F.coalesce(*(F.when(F.is_valid_utf8(cut(n)), cut(n)) for n in (most + k if over else most - k for k in range(4)) if n >= 0))


def trim_to_cap(c: Column, most: int) -> Column:
    """A text of over ``most`` characters cut to whole characters within as many bytes."""
    return F.when(F.char_length(c) > most, _byte_prefix(c, most, over=False)).otherwise(c)


def first_line(c: Column, most: int) -> Column:
    """The first line up to the character with which it reaches ``most`` bytes, trimmed."""
    return trim_ws(_byte_prefix(F.substring_index(c, "\n", 1), most, over=True))


def truncate(c: Column, most: int, mark: str = ELLIPSIS) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(mark))).otherwise(c)


def maybe_truncate(c: Column, most: int) -> Column:
    """struct(text, truncated)."""
    over = (F.char_length(c) > most) & F.lit(most > 0)
    return F.struct(F.when(over, F.concat(F.left(c, F.lit(most)), F.lit("\n\n[... TRUNCATED ...]\n"))).otherwise(c).alias("text"), F.coalesce(over, F.lit(False)).alias("truncated"))


def compose_text(*parts: Column) -> Column:
    """Trimmed non-empty parts, neighbours that are equal once, joined by line feeds."""
    p = F.filter(F.array(*[trim_ws(x) for x in parts]), lambda x: x.isNotNull() & (x != ""))
    dense = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.when((i > 0) & (F.get(p, i) == F.get(p, i - 1)), None).otherwise(F.get(p, i)))
    return F.when(F.size(p) == 0, F.lit("")).otherwise(F.array_join(F.filter(dense, lambda x: x.isNotNull()), "\n"))


#: Fixed value: a piece of code-like text from which keywords come.
KEYWORD_TOKEN = r"[A-Za-z0-9_./-]{3,}"


def split_camel(c: Column) -> Column:
    return F.split(c, r"(?<=[a-z0-9])(?=[A-Z])")


def keywords(c: Column, most: int = 48) -> Column:
    """Sorted distinct lower-case keywords: whole tokens, their parts between ``/ . - _``, and camel-case parts."""
    numeric = lambda x: x.rlike(r"^[0-9]+$")
    raw = F.regexp_extract_all(c, F.lit(f"({KEYWORD_TOKEN})"), 1)
    whole = F.filter(F.transform(raw, F.lower), lambda x: ~numeric(x))
    pieces = F.filter(F.flatten(F.transform(raw, lambda x: F.split(x, r"[/.\-_]"))), lambda x: F.length(x) >= 3)
    parts = F.filter(F.transform(F.flatten(F.transform(pieces, split_camel)), F.lower), lambda x: (F.length(x) >= 3) & ~numeric(x))
    return F.slice(F.array_sort(F.array_distinct(F.concat(whole, parts))), 1, most)


#: Route-like literals, quoted and bare.
ROUTE_QUOTED, ROUTE_BARE = r"['\"](/[^'\"]*)['\"]", r"(/[A-Za-z0-9_\-/:]+)"


def routes(c: Column) -> Column:
    """Quoted then bare runs that begin with a slash and hold more than slashes, in first-seen order."""
    found = F.concat(F.regexp_extract_all(c, F.lit(ROUTE_QUOTED), 1), F.regexp_extract_all(c, F.lit(ROUTE_BARE), 1))
    return F.array_distinct(F.filter(found, lambda x: x.rlike("[^/]")))


def identifiers(c: Column, most: int = 128) -> Column:
    """Distinct identifier-like words in first-seen order."""
    words = F.split(c, r"[^\p{L}\p{N}_$]+")
    return F.slice(F.array_distinct(F.filter(words, lambda x: x.rlike(r"^[\p{L}_$]"))), 1, most)


#: What imports look like in five languages.
IMPORT_QUOTED = r"\b(?:import|export)\b[^'\"]*['\"]([^'\"]+)['\"]"
IMPORT_REQUIRE = r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"
IMPORT_FROM = r"(?m)^\s*(?:from\s+([a-zA-Z0-9_\.]+)\s+import|import\s+[a-zA-Z0-9_\.]+)"
IMPORT_PLAIN = r"(?m)^\s*(?:from\s+[a-zA-Z0-9_\.]+\s+import|import\s+([a-zA-Z0-9_\.]+))"
IMPORT_USE = r"(?m)^\s*use\s+([a-zA-Z0-9_:]+)"


def naive_imports(c: Column) -> Column:
    """Module names in order of kind, then place, each once: quoted, require(), ``py:`` and ``use:``."""
    some = lambda p: F.transform(F.regexp_extract_all(c, F.lit(p), 1), lambda x: F.trim(x))
    py = F.zip_with(F.regexp_extract_all(c, F.lit(IMPORT_FROM), 1), F.regexp_extract_all(c, F.lit(IMPORT_PLAIN), 1), lambda a, b: F.when(a != "", a).otherwise(b))
    tagged = lambda a, t: F.transform(a, lambda x: F.concat(F.lit(t), x))
    return F.array_distinct(F.concat(some(IMPORT_QUOTED), some(IMPORT_REQUIRE), tagged(py, "py:"), tagged(some(IMPORT_USE), "use:")))


def dart_import_uris(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:import|export|part)\s+['\"]([^'\"]+)['\"]"), 1)))


def import_modifiers(c: Column) -> Column:
    """struct(alias, shown, hidden) of an import line."""
    names = lambda word: F.filter(F.transform(F.split(F.regexp_extract(c, rf"\b{word}\s+([\w\s,]+?)(?:\s+(?:show|hide)\b|;|$)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    alias = F.regexp_extract(c, r"\bas\s+([A-Za-z_]\w*)", 1)
    return F.struct(F.when(alias != "", alias).alias("alias"), names("show").alias("shown"), names("hide").alias("hidden"))


def annotation(c: Column) -> Column:
    """struct(name, value) of ``@Name(value)``; null where there is none."""
    name, value = F.regexp_extract(c, r"^\s*@([A-Za-z_][\w.]*)", 1), F.regexp_extract(c, r"^\s*@[A-Za-z_][\w.]*\((.*)\)\s*$", 1)
    return F.when(name != "", F.struct(name.alias("name"), F.when(value != "", value).alias("value")))


def fqn(owner: Column, name: Column) -> Column:
    return F.array_join(F.concat(owner, F.array(name)), "::")


def parent_path(c: Column) -> Column:
    """The symbol path without its last part, if it has more than two."""
    p = F.split(c, "::")
    return F.when(F.size(p) > 2, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "::"))


def identifier_chains(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*)"), 1)


def import_symbols(c: Column) -> Column:
    """Names that an import line brings in: alias, braces, ``from x import``, include, dotted, ``use`` and Go forms."""
    last = lambda x: F.element_at(F.split(x, r"[./:]+"), -1)
    names = lambda x: F.filter(F.transform(F.split(x, ","), lambda y: F.regexp_extract(F.trim(y), r"(\w+)$", 1)), lambda y: y != "")
    one = lambda p: F.regexp_extract(c, p, 1)
    given = lambda x, a: F.when(x != "", a).otherwise(F.array().cast("array<string>"))
    alias, braces = one(r"\bas\s+([A-Za-z_]\w*)"), one(r"\{([^}]*)\}")
    frm, inc = one(r"^\s*from\s+\S+\s+import\s+([^({]+)$"), one(r"#include\s*[<\"]([^>\"]+)[>\"]")
    dotted, use = one(r"^\s*(?:import|using)\s+(?:static\s+)?([\w.]+)\s*;"), one(r"^\s*use\s+([\w:]+)\s*;")
    quoted = one(r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"\s*$")
    stem = F.regexp_replace(inc, r"\.\w+$", "")
    return F.array_distinct(
        F.concat(given(alias, F.array(alias)), given(braces, names(braces)), given(frm, names(frm)), given(inc, F.array(F.element_at(F.split(stem, "/"), -1))), given(dotted, F.array(last(dotted))), given(use, F.array(last(use))), given(quoted, F.array(last(quoted))))
    )


def simhash_tokens(c: Column) -> Column:
    """Runs of letters and digits of three bytes or more; only A-Z are lower-cased."""
    lowered = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 3)


#: The keywords of each theme, the first match counts.
THEMES = [("cleanup", ("dispose", "cancel(", "leak")), ("rebuild", ("rebuild", "setstate", "performance")), ("routing", ("route", "navigation"))]


def theme(c: Column) -> Column:
    low, out = F.lower(c), F.lit("other")
    for name, words in reversed(THEMES):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def excerpt(c: Column, most: int) -> Column:
    """The first line that is not blank, a dash, and the rest in one line."""
    some = F.filter(lines(c), lambda x: trim_ws(x) != "")
    title = trim_ws(F.coalesce(F.get(some, F.lit(0)), F.lit("")))
    rest = F.array_join(F.slice(some, F.lit(2), F.greatest(F.size(some) - 1, F.lit(0))), " ")
    return F.left(F.concat(title, F.when(title != "", F.lit(" — ")).otherwise(""), rest), F.lit(most))


#: Fixed value: names of what releases something.
CLEANUP_NAMES = ("dispose", "close", "finalize", "deinit", "__del__", "Drop", "free", "cancel", "unsubscribe")


def returns_outline(c: Column, most: int = 6) -> Column:
    """``return`` with what follows it up to a semicolon or the line's end, wherever it stands, in any case."""
    tails = F.regexp_extract_all(c, F.lit(r"(?i)\breturn\b([^\n;]*)"), 1)
    return F.slice(F.transform(tails, lambda t: F.rtrim(F.concat(F.lit("return "), trim_ws(t)))), 1, most)


def cleanup_like(c: Column) -> Column:
    """The names that stand in the text as words."""
    return F.array_compact(F.array(*[F.when(c.rlike(rf"\b{n}\b"), F.lit(n)) for n in CLEANUP_NAMES]))


def sanitize_line_mentions(c: Column, start: Column, end: Column) -> Column:
    """``line N`` and ``lines N-M`` become ``these lines``, unless they name exactly the anchor."""
    mention = r"(?i)\b(lines?)\s+(\d+)(?:\s*[-–]\s*(\d+))?"
    own = F.when(start == end, F.concat(F.lit(r"(?i)\b(lines?)\s+(0*"), start.cast("string"), F.lit(r")((?:\s*[-–]\s*0*"), end.cast("string"), F.lit(r")?)(?!\d|\s*[-–]\s*\d)"))).otherwise(
        F.concat(F.lit(r"(?i)\b(lines?)\s+(0*"), start.cast("string"), F.lit(r")(\s*[-–]\s*0*"), end.cast("string"), F.lit(r")(?!\d)"))
    )
    # The anchor's own mentions are masked, the others replaced, and the mask taken off.
    masked = F.when(start.isNotNull() & end.isNotNull(), F.regexp_replace(c, own, F.lit("\u0001$1 \u0002$2$3\u0003"))).otherwise(c)
    return F.regexp_replace(F.regexp_replace(masked, mention, "these lines"), "[\u0001\u0002\u0003]", "")


def strip_think(c: Column) -> Column:
    """Without think blocks and stray think tags."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", "")


def strict_segment(c: Column) -> Column:
    """What stands between the strict markers, or the whole text, trimmed."""
    a, b = "<<<BEGIN_STRICT>>>", "<<<END_STRICT>>>"
    inner = F.regexp_extract(c, rf"(?s){a}(.*?){b}", 1)
    return trim_ws(F.when(F.contains(c, F.lit(a)) & F.contains(c, F.lit(b)), inner).otherwise(c))


def strip_fences(c: Column) -> Column:
    """A JSON block without its code fences."""
    return trim_ws(F.regexp_replace(F.regexp_replace(trim_ws(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


#: What secrets in prompts look like; replaced in this order.
REDACT = (
    r"(?i)glpat-[A-Za-z0-9\.\-_]{16,}",
    r"(?i)\bBearer\s+[A-Za-z0-9\-_\.=]{16,}",
    r"(?i)\btoken\s*[:=]\s*[A-Za-z0-9\-_\.=]{16,}",
    r"(?i)Authorization:\s*Bearer\s+[A-Za-z0-9\-_\.=]{16,}",
)


def redact_secrets(c: Column) -> Column:
    for p in REDACT:
        c = F.regexp_replace(c, p, "[REDACTED]")
    return c


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_ident_like(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")


def contains_ci(c: Column, part: Column) -> Column:
    return F.contains(F.lower(c), F.lower(part))


def hover_first_line(c: Column, most: int = 256) -> Column:
    """The first line that is neither blank nor a fence."""
    some = F.filter(F.transform(lines(c), trim_ws), lambda x: (x != "") & ~x.startswith("```"))
    return F.left(F.get(some, F.lit(0)), F.lit(most))


def numbered(c: Column, first: int = 1) -> Column:
    """Lines with their right-aligned numbers."""
    return F.array_join(F.transform(lines(c), lambda x, i: F.format_string("%6d | %s", i + first, x)), "\n")


def slice_lines(c: Column, first: Column, last: Column) -> Column:
    """Lines first to last, 1-based and inclusive, clamped to the text."""
    every = lines(c)
    lo = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(every, lo, F.greatest(F.least(last, F.size(every)) - lo + 1, F.lit(0))), "\n")


def slice_rows(c: Column, start: Column, end: Column) -> Column:
    """Rows start to end, 0-based and half-open."""
    return slice_lines(c, start + 1, end)


def anchor_window(c: Column, first: Column, last: Column, pad: int, otherwise: int = 60) -> Column:
    """Numbered lines from first - pad to last + pad, or the first ``otherwise`` lines without an anchor."""
    rows = F.transform(lines(c), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    lo, hi = F.coalesce(first - pad, F.lit(1)), F.coalesce(last + pad, F.lit(otherwise))
    return F.array_join(F.transform(F.filter(rows, lambda r: (r["n"] >= lo) & (r["n"] <= hi)), lambda r: F.format_string("%6d | %s", r["n"], r["x"])), "\n")


def snippet_hash(c: Column, first: Column, last: Column, pad: int = 3) -> Column:
    """SHA-256 of the lines around a target."""
    return F.sha2(slice_lines(c, first - pad, last + pad), 256)


def snippet_preview(c: Column, first: Column, last: Column, pad: int = 3, most: int = 120) -> Column:
    """The first line around a target that is not blank, shortened."""
    some = F.filter(F.transform(lines(slice_lines(c, first - pad, last + pad)), trim_ws), lambda x: x != "")
    return truncate(F.coalesce(F.get(some, F.lit(0)), F.lit("")), most)


def signature_of(c: Column) -> Column:
    """The head of a declaration: up to ``;``, ``{`` or ``=>``, with it."""
    head = F.regexp_extract(c, r"(?s)^(.*?(?:;|\{|=>))", 1)
    return trim_ws(F.when(head != "", head).otherwise(c))


def line_of(c: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.char_length(F.regexp_replace(F.left(c, offset), "[^\n]", "")) + 1


def utf16_column_to_bytes(line: Column, column: Column) -> Column:
    """Bytes before a UTF-16 column of a line: characters over 4 bytes long count two units."""
    chars = F.split(line, "")
    start = F.struct(F.lit(0).alias("units"), F.lit(0).alias("bytes"))
    step = lambda a, x: F.when(a["units"] >= column, a).otherwise(F.struct((a["units"] + F.when(F.octet_length(x) == 4, 2).otherwise(F.when(x == "", 0).otherwise(1))).alias("units"), (a["bytes"] + F.octet_length(x)).alias("bytes")))
    return F.aggregate(chars, start, step, lambda a: a["bytes"])


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def generated_at(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
