"""Text expressions: mentions, rich text, search text, counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parley.schemas import BLOCK_ITEM, ELEMENT_ITEM, FILE_ITEM, SECTION_ITEM

# Mention markup of the chat service.
USER_MENTION = r"<@([UW][A-Z0-9]+)>"
CHANNEL_MENTION = r"<#(C[A-Z0-9]+)(\|([^>]+))?>"
SPECIAL_MENTION = r"<!(everyone|channel|here)>"
LINK = r"https?://"
# How a message shows its first file.
FILE_OPEN, FILE_CLOSE, NAMELESS_FILE = "[File: ", "]", "Unknown"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse_items(items: Column, item_type) -> Column:
    """JSON objects of an array of JSON texts; items that are not objects become NULL."""
    return F.transform(
        items,
        lambda x: F.when(F.ltrim(x).startswith("{"), F.from_json(x, item_type)),
    )


def _interleave(text: Column, pattern: str, shown: Column) -> Column:
    """Put `shown[i]` in place of the i-th match of `pattern`."""
    parts = F.split(text, pattern, -1)
    return F.array_join(
        F.zip_with(parts, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), ""
    )


def _name_or_id(names: Column, i: Column) -> Column:
    return F.coalesce(F.try_element_at(names, i), i)


def _extract(text: Column, mark: str, pattern: str) -> Column:
    """All first groups; the regular expression runs only where the mark occurs."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.contains(text, F.lit(mark)), found).otherwise(F.array().cast("array<string>"))


def user_mention_ids(text: Column) -> Column:
    return _extract(text, "<@", USER_MENTION)


def channel_mention_ids(text: Column) -> Column:
    """Ids of channel mentions that carry no label, the only ones to look up."""
    return _extract(text, "<#", r"<#(C[A-Z0-9]+)>")


def resolve_user_mentions(text: Column, names: Column) -> Column:
    """`<@U1>` -> `@name`; unknown ids stay as `@U1`; labelled mentions are left alone."""
    shown = F.transform(user_mention_ids(text), lambda i: F.concat(F.lit("@"), _name_or_id(names, i)))
    return F.when(F.contains(text, F.lit("<@")), _interleave(text, USER_MENTION, shown)).otherwise(text)


def resolve_channel_mentions(text: Column, names: Column) -> Column:
    """`<#C1|label>` -> `#label`; without a label the channel name, else the id."""
    ids = F.regexp_extract_all(text, F.lit(CHANNEL_MENTION), F.lit(1))
    labels = F.regexp_extract_all(text, F.lit(CHANNEL_MENTION), F.lit(3))
    shown = F.zip_with(
        ids,
        labels,
        lambda i, label: F.concat(F.lit("#"), F.coalesce(blank_to_null(label), _name_or_id(names, i))),
    )
    return F.when(F.contains(text, F.lit("<#")), _interleave(text, CHANNEL_MENTION, shown)).otherwise(text)


def resolve_special_mentions(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL_MENTION, "@$1")


def mentioned_users(text: Column, names: Column) -> Column:
    """Sorted distinct names of the known users mentioned; NULL when there are none."""
    known = F.filter(
        F.transform(user_mention_ids(text), lambda i: blank_to_null(F.try_element_at(names, i))),
        lambda n: n.isNotNull(),
    )
    found = F.array_sort(F.array_distinct(known))
    return F.when(F.size(found) > 0, found)


def rich_text_elements(blocks: Column) -> Column:
    """Leaf elements of the rich-text sections of all rich-text blocks, in order."""

    def inner(items: Column, wanted: str, item_type) -> Column:
        parsed = parse_items(items, item_type)
        kept = F.filter(parsed, lambda x: x["type"] == wanted)
        return F.flatten(F.transform(kept, lambda x: F.coalesce(x["elements"], F.array().cast("array<string>"))))

    sections = inner(blocks, "rich_text", BLOCK_ITEM)
    return parse_items(inner(sections, "rich_text_section", SECTION_ITEM), ELEMENT_ITEM)


def rich_text_user_ids(blocks: Column) -> Column:
    users = F.filter(rich_text_elements(blocks), lambda e: e["type"] == "user")
    return F.filter(F.transform(users, lambda e: e["user_id"]), lambda i: i.isNotNull())


def rich_text(blocks: Column, names: Column) -> Column:
    """Text, `:emoji:` and `@name` elements joined without a separator."""

    def shown(e: Column) -> Column:
        user = blank_to_null(e["user_id"])
        return (
            F.when(e["type"] == "text", F.coalesce(e["text"], F.lit("")))
            .when(e["type"] == "emoji", F.concat(F.lit(":"), F.coalesce(e["name"], F.lit("")), F.lit(":")))
            .when(e["type"] == "user", F.coalesce(F.concat(F.lit("@"), _name_or_id(names, user)), F.lit("<@None>")))
        )

    return F.array_join(F.transform(rich_text_elements(blocks), shown), "")


def first_file_text(files: Column) -> Column:
    """`[File: name] title` of the first file."""
    first = F.get(parse_items(files, FILE_ITEM), F.lit(0))
    label = F.concat(F.lit(FILE_OPEN), F.coalesce(first["name"], F.lit(NAMELESS_FILE)), F.lit(FILE_CLOSE))
    titled = F.concat(label, F.coalesce(F.concat(F.lit(" "), blank_to_null(first["title"])), F.lit("")))
    return F.when(first.isNotNull(), titled)


def rich_text_if_needed(text: Column, blocks: Column, names: Column) -> Column:
    """Rich text of messages that have no plain text."""
    empty = F.coalesce(text == "", F.lit(True))
    return F.when(empty & (F.size(blocks) > 0), rich_text(blocks, names))


def message_text(text: Column, rich: Column, files: Column) -> Column:
    """Plain text, else rich text, else the first file, else ''."""
    return (
        F.when(text != "", text)
        .when(rich != "", rich)
        .when(F.size(files) > 0, F.coalesce(first_file_text(files), F.lit("")))
        .otherwise("")
    )


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    words = F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint")


def contains_links(text: Column) -> Column:
    return F.coalesce(text.rlike(LINK), F.lit(False))


def search_text(clean_text: Column, user_name: Column, conversation_name: Column) -> Column:
    return F.concat_ws(
        " ", *[blank_to_null(F.lower(c)) for c in (clean_text, user_name, conversation_name)]
    )


def snippet(text: Column, width: int = 100) -> Column:
    """First characters, with '...' when something was cut."""
    return F.concat(
        F.substring(text, 1, width), F.when(F.char_length(text) > width, "...").otherwise("")
    )


def body(clean_text: Column, text: Column) -> Column:
    """Clean text, else raw text, NULL when both are empty."""
    return F.coalesce(blank_to_null(clean_text), blank_to_null(text))
