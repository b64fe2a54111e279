"""Text columns: identities, model replies, training and prompt strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode that a strip takes away.
STRIP = r"^[\s\u0085   -     　\x1C-\x1F]+|[\s\u0085   -     　\x1C-\x1F]+$"


def md5_id(text: Column) -> Column:
    """Identity of a text: md5 of its UTF-8 bytes."""
    return F.md5(text.cast("string"))


def unique_name(name: Column, detail: Column, missing: Column | None = None) -> Column:
    """name and detail with a space; a null detail reads None, a missing one is left out."""
    joined = F.concat(name, F.lit(" "), F.coalesce(detail, F.lit("None")))
    return joined if missing is None else F.when(missing, name).otherwise(joined)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def strip_fence(text: Column) -> Column:
    """Without a leading json code fence and a trailing fence."""
    return F.regexp_replace(text, r"\A```json\s*|```(?=\n?\z)", "")


def newline_to_space(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def claim_line(reply: Column) -> Column:
    """What follows ``claim:`` on the first such line, without quotes; else the reply; stripped."""
    lines = F.filter(F.split(reply, "\n"), lambda x: F.lower(strip(x)).startswith("claim:"))
    first = F.get(lines, F.lit(0))
    own = F.regexp_replace(strip(F.regexp_replace(strip(first), r"^[^:]*:", "")), r'^"+|"+$', "")
    return F.when(first.isNotNull(), own).otherwise(strip(reply))


def train_text(text: Column, categories: Column, speaker: Column | None = None) -> Column:
    joined = F.concat(text, F.lit(" : "), F.array_join(categories, " "))
    return joined if speaker is None else F.when(speaker.isNull(), joined).otherwise(F.concat(joined, F.lit(": "), speaker))


def faq_content(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)


def prompt(instructions: Column | str, title: Column | None, text: Column) -> Column:
    head = F.lit(instructions) if isinstance(instructions, str) else instructions
    parts = [head] + ([F.concat(F.lit("Title: "), title)] if title is not None else []) + [F.concat(F.lit("Text:\n"), text)]
    return F.concat_ws("\n\n", *parts)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def url_parts(url: Column) -> dict[str, Column]:
    """protocol, host, port, path, query, user and password; null where the URL has none."""
    parts = {part.lower(): F.parse_url(url, F.lit(part)) for part in ("PROTOCOL", "HOST", "PATH", "QUERY")}
    user, authority = F.parse_url(url, F.lit("USERINFO")), F.parse_url(url, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    password = F.when(F.instr(user, ":") > 0, F.substr(user, F.instr(user, ":") + 1))
    return parts | {"port": F.when(port != "", port.cast("int")), "user": F.substring_index(user, ":", 1), "password": password}


def iso_time(ts: Column) -> Column:
    """As Python's isoformat writes a time without a zone: microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(ts) % 1000000 == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def metadata_json(created: Column, **fields: Column) -> Column:
    """Metadata of a record: its fields and when it was made, as JSON text."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()), iso_time(created).alias("created_at")))


def stamped_name(now: Column, unique: Column, precise: bool = False) -> Column:
    """File name of an extracted article: minute, or microsecond if precise, and a hex id."""
    return F.concat(F.date_format(now, "yyyyMMdd_HHmmss_SSSSSS" if precise else "yyyyMMdd_HHmm"), F.lit("__"), F.replace(unique, F.lit("-"), F.lit("")), F.lit(".json"))
