"""Text expressions of the run log, the log lines and the column audit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The truncation marker and the limits in characters, marker not counted.
MARKER = "…[truncated]"
MESSAGE_LIMIT = 4096
TRACEBACK_LIMIT = 16384
LINE_EXIT_LIMIT = 40
LINE_ERROR_LIMIT = 80

# Words that make an error a timeout, wherever they stand in the message.
TIMEOUT_WORDS = ("timeout", "timed out")

# The characters a publishable column name may not hold.
BAD_CHARACTER = r"[^a-zA-Z0-9_\-]"

# Badge per status and the widths of the console line's fields.
BADGES = {"ok": "OK", "failed": "FAIL", "timeout": "TIME", "skipped": "SKIP"}
BADGE_WIDTH, NAME_WIDTH, SECONDS_WIDTH = 8, 18, 6


def truncate(text: Column, limit: int) -> Column:
    """The first ``limit`` code points and the marker, or the text itself when it fits."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit(MARKER))
    )


def status(error_class: Column, error_message: Column) -> Column:
    """ok without an error; timeout when the message says so; failed otherwise."""
    message = F.lower(F.coalesce(error_message, F.lit("")))
    timed_out = F.lit(False)
    for word in TIMEOUT_WORDS:
        timed_out = timed_out | message.contains(word)
    return (
        F.when(error_class.isNull() & error_message.isNull(), F.lit("ok"))
        .when(timed_out, F.lit("timeout"))
        .otherwise(F.lit("failed"))
    )


def _lower_hex(json: Column) -> Column:
    """The same JSON with its unicode escapes in lower-case hex.

    Escaped backslashes are put aside as a character that JSON text cannot hold, so every ``\\u`` left is an escape.
    No lambda: both branches stay in generated code, where the JSON they share is written once.
    """
    aside = F.lit("\x01")
    text = F.replace(json, F.lit("\\\\"), aside)
    for digit in "ABCDEF":
        text = F.regexp_replace(text, r"(?<=\\u[0-9A-Fa-f]{0,3})" + digit, digit.lower())
    return F.when(json.contains("\\u"), F.replace(text, aside, F.lit("\\\\"))).otherwise(json)


def args_json(args: Column) -> Column:
    """A string map as one JSON object in ASCII with sorted keys, ``": "`` and ``", "`` between its parts.

    ``{}`` for null and for the empty map. The entries are written by one ``to_json`` and the text around them is
    then replaced. Inside a JSON string a quote always follows a backslash, so ``,"`` and ``{"`` only occur between
    the parts.
    """
    options = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}
    given = F.coalesce(args, F.create_map().cast("map<string,string>"))
    entries = F.to_json(F.sort_array(F.map_entries(given)), options)
    pairs = F.replace(entries, F.lit('","value":'), F.lit('": '))
    listed = F.replace(pairs, F.lit('},{"key":'), F.lit(", "))
    opened = F.replace(listed, F.lit('[{"key":'), F.lit("{"))
    whole = F.regexp_replace(F.rtrim(opened, F.lit("]")), r"\A\[\z", "{}")
    return _lower_hex(F.replace(whole, F.lit("\x7f"), F.lit("\\u007f")))


def display_name(name: Column, path: Column) -> Column:
    """The given name, else the last path segment, else the path itself; empty counts as missing."""
    segment = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(segment, F.lit("")), path)


def seconds_text(duration_ms: Column) -> Column:
    """Milliseconds as seconds with two decimals, right-aligned, ``s`` at the end.

    ``format_number`` rounds the binary value half-even, as the log lines always did; ``format_string`` rounds
    the shortest decimal half-up and shows 1.01 for 1005 ms.
    """
    digits = F.call_function("format_number", duration_ms / F.lit(1000), F.lit("0.00"))
    padded = F.lpad(digits, F.greatest(F.lit(SECONDS_WIDTH), F.length(digits)), F.lit(" "))
    return F.concat(padded, F.lit("s"))


def console_line(
    name: Column, row_status: Column, duration_ms: Column, exit_value: Column, error_class: Column, error: Column
) -> Column:
    """``[BADGE]  name  seconds  suffix``; ``clock`` makes what stands in front where a clock is wanted."""
    badge = F.upper(row_status)
    for word, label in BADGES.items():
        badge = F.when(row_status == word, F.lit(label)).otherwise(badge)
    bracketed = F.concat(F.lit("["), badge, F.lit("]"))
    badge_field = F.rpad(bracketed, F.greatest(F.lit(BADGE_WIDTH), F.length(bracketed)), F.lit(" "))
    skipped = row_status == "skipped"
    seconds = F.when(skipped, F.lit(" " * (SECONDS_WIDTH + 1))).otherwise(seconds_text(duration_ms))
    exit_text = truncate(exit_value, LINE_EXIT_LIMIT)
    trouble = F.concat(error_class, F.lit(": "), truncate(error, LINE_ERROR_LIMIT))
    suffix = (
        F.when(skipped, F.lit("(fail_fast)"))
        .when((row_status == "ok") & (exit_text == ""), F.lit(""))
        .when(row_status == "ok", F.concat(F.lit("exit="), exit_text))
        .otherwise(F.btrim(trouble, F.lit(": ")))
    )
    return F.concat(
        badge_field, F.lit(" "), F.rpad(name, NAME_WIDTH, " "), F.lit(" "), seconds, F.lit("  "), suffix
    )


def iso_utc(ts: Column) -> Column:
    """An instant as ISO 8601 in UTC; no fraction when the microseconds are zero.

    Counted from the epoch on zone-less time, so no session zone and none of its clock changes come into it.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    text = F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch).cast("string")
    padded = F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(F.translate(padded, " ", "T"), F.lit("+00:00"))


def clock(ts: Column) -> Column:
    """``HH:MM:SS`` of an instant in UTC, whatever the session zone."""
    return F.substring(iso_utc(ts), 12, 8)


def bad_characters(name: Column, pattern: str = BAD_CHARACTER) -> Column:
    """The distinct characters of a name that the pattern finds, sorted and joined."""
    found = F.regexp_extract_all(name, F.lit(pattern), F.lit(0))
    return F.array_join(F.array_sort(F.array_distinct(found)), "")
