"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block type by HTML element.
BLOCK_TYPES = {"p": "paragraph", "h1": "heading1", "h2": "heading2", "h3": "heading3", "h4": "heading4", "h5": "heading5", "h6": "heading6", "li": "listItem", "td": "listItem", "blockquote": "blockquote", "pre": "preformatted", "img": "image"}
#: Entities in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
#: Media type by file extension.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def tokenise(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)


def tokens_at_least_one(text: Column) -> Column:
    """Token estimate of a block: a quarter of its length, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def tokens_rough(text: Column) -> Column:
    """Token estimate of long text: a quarter of its length."""
    return F.floor(F.length(text) / 4).cast("int")


def strip_html(html: Column) -> Column:
    """Markup removed, seven entities decoded in order, white space collapsed."""
    text = F.regexp_replace(html, "<[^>]+>", "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(text, r"\s+", " ")


def block_type(tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BLOCK_TYPES.items() for x in pair])
    return F.coalesce(table[F.lower(tag)], F.lit("unknown"))


def block_id(spine_item: Column, text: Column, ordinal: Column) -> Column:
    """12 hex digits of SHA-256 over spine item, normalised text and ordinal."""
    normal = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.substring(F.sha2(F.concat_ws("|", spine_item.cast("string"), normal, ordinal.cast("string")), 256), 1, 12)


def chunk_id(book: Column, chapter: Column, ordinal: Column) -> Column:
    """16 hex digits of SHA-256 over book, chapter and ordinal."""
    return F.substring(F.sha2(F.concat_ws("|", book.cast("string"), chapter.cast("string"), ordinal.cast("string")), 256), 1, 16)


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("application/octet-stream"))


def sanitise_css(css: Column) -> Column:
    """Side margins, padding and widths in percent, which break columns, become comments."""
    css = F.regexp_replace(css, r"(?i)margin-(left|right)\s*:\s*(\d+)%\s*;", "/* [sanitized margin-$1] */")
    css = F.regexp_replace(css, r"(?i)padding(-left|-right)?\s*:\s*[^;]*\d+%[^;]*;", "/* [sanitized padding] */")
    return F.regexp_replace(css, r"(?i)width\s*:\s*\d+%\s*;", "/* [sanitized width] */")


def selection_context(text: Column, selected: Column, around: int = 500) -> Column:
    """The selection with `around` characters on both sides of its first occurrence; absent: itself."""
    at = F.instr(text, selected)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, start, at + F.length(selected) + around - start)).otherwise(selected)


def bold_headers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(#{1,6})\s+(.+)$", "**$2**")


def preview(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def first_words(text: Column, limit: int = 100) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, limit), " ")


def price(cost: Column) -> Column:
    """Two decimals below one dollar, none from there on."""
    return F.when(cost < 1, F.format_string("$%.2f", cost)).otherwise(F.format_string("$%.0f", cost))


def context_length(tokens: Column) -> Column:
    millions = tokens / 1_000_000
    return F.when(tokens < 1_000_000, F.concat(F.floor(tokens / 1000).cast("string"), F.lit("K"))).when(millions == F.floor(millions), F.format_string("%.0fM", millions)).otherwise(F.format_string("%.1fM", millions))


def short_address(road: Column, city: Column, town: Column, village: Column, state: Column, country: Column, name: Column) -> Column:
    parts = F.concat_ws(", ", road, F.coalesce(city, town, village), state, country)
    return F.when(parts == "", name).otherwise(parts)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def layout_key(font: Column, margin: Column, width: Column, height: Column) -> Column:
    return F.concat_ws("-", font.cast("string"), margin.cast("string"), width.cast("string"), height.cast("string"))


def entity_id(text: Column) -> Column:
    return F.concat(F.lit("entity_"), F.substring(F.replace(F.lower(text), F.lit(" "), F.lit("_")), 1, 50))


def label_of_words(words: Column) -> Column:
    """Up to three words with capital first letters, joined by &."""
    top = F.transform(F.slice(words, 1, 3), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
    return F.when(F.size(words) > 0, F.array_join(top, " & ")).otherwise("Untitled Theme")


def event_label(label: Column, people: Column) -> Column:
    n = F.size(people)
    pair = F.concat(F.lit("Interaction: "), F.get(people, F.lit(0)), F.lit(" & "), F.get(people, F.lit(1)))
    many = F.concat(F.lit("Event: "), F.array_join(F.slice(people, 1, 2), ", "), F.lit(" & others"))
    one = F.concat(F.lit("Event: "), F.get(people, F.lit(0)))
    return F.coalesce(label, F.when(n == 2, pair).when(n > 2, many).when(n == 1, one).otherwise("Unknown Event"))


def json_argument(arguments: Column, name: str) -> Column:
    """A tool call's argument as text; null if the arguments are no JSON object or lack it."""
    return F.when(F.trim(arguments).startswith("{"), F.get_json_object(arguments, f"$.{name}"))


def iso_time(value: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time with its zone, whole; null for anything else."""
    return F.when(value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.unix_seconds(F.try_to_timestamp(value)))
