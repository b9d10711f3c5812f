"""Expressions over objects: ids, headers, summaries, tree entries.

Everything but the tree-entry parser is built in and stays in generated code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histlake.schema import DIRECTORY_MODE, KIND_NAMES

#: Characters a trimmed line may lose.
LINE_SPACE = " \t\n\f\r"
SUMMARY_CHARS = 100
BINARY_PREFIX = 8192


def text(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def raw_text(content: Column) -> Column:
    """Bytes as text, a character for each byte."""
    return F.decode(content, "ISO-8859-1")


def searchable(kind: Column, content: Column) -> Column:
    """What a pattern is matched against: trees hold binary ids, the others are text."""
    return F.when(kind == "tree", raw_text(content)).otherwise(text(content))


def kind_name(kind_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KIND_NAMES)), kind_id.cast("int"))


def object_id(kind: Column, content: Column) -> Column:
    """The id of an object: sha1 over its kind, size, a zero byte and its bytes."""
    head = F.concat(kind, F.lit(" "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def is_id(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{40}$")


def header(body: Column) -> Column:
    return F.substring_index(body, "\n\n", 1)


def commit_tree(body: Column) -> Column:
    return header_tree(header(body))


def header_tree(head: Column) -> Column:
    """The same of a header; most begin with that line, and no more of them is searched."""
    first = F.substring(head, 1, 46)
    found = F.regexp_extract(head, r"(?m)^tree ([0-9a-f]{40})$", 1)
    return F.when(first.rlike(r"\Atree [0-9a-f]{40}\n"), F.substring(first, 6, 40)).when(found != "", found)


def commit_parents(body: Column) -> Column:
    """In order: the first one is the branch that was merged into."""
    return header_parents(header(body))


def header_parents(head: Column) -> Column:
    return F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1))


def author_line(body: Column) -> Column:
    """The first author line; empty if there is none.  Where no line ends but by a line feed, it is found without a pattern."""
    plain = ~(body.contains("\r") | body.contains("\u0085") | body.contains("\u2028") | body.contains("\u2029"))
    at = F.instr(body, "\nauthor ")
    after = F.when(body.startswith("author "), body).when(at > 0, F.substring(body, at + F.lit(1), F.length(body))).otherwise("")
    return F.when(plain, F.substring_index(after, "\n", 1)).otherwise(F.regexp_extract(body, r"(?m)^author .*$", 0))


def author_ts(body: Column) -> Column:
    """Seconds of the first author line; 0 if there is none or it cannot be read."""
    return line_ts(author_line(body))


def line_ts(line: Column) -> Column:
    """The same of an author line; one that ends in digits and a zone, each after one space, is not split."""
    end = F.substring_index(F.trim(line), " ", -2)
    digits, zone = F.substring_index(end, " ", 1), F.substring_index(end, " ", -1)
    plain = F.length(digits).between(1, 18) & (F.translate(digits, "0123456789", "") == "") & (zone != "") & (F.translate(zone, "\t\x0b\f", "") == zone) & end.contains(" ")
    stamp = F.try_element_at(F.split(F.trim(line), r"\s+"), F.lit(-2))
    split = F.coalesce(F.when(stamp.rlike(r"^[+-]?\d{1,18}$"), stamp).try_cast("long"), F.lit(0).cast("long"))
    return F.when(plain, digits.try_cast("long")).otherwise(split)


def author_name(body: Column) -> Column:
    return line_name(author_line(body))


def line_name(line: Column) -> Column:
    return F.when(line != "", F.trim(F.substring_index(F.substring(line, 8, 1 << 20), "<", 1)))


def subject(body: Column) -> Column:
    """The first line of the message; empty if there is none."""
    at = F.instr(body, "\n\n")
    message = F.when(at > 0, F.ltrim(F.substring(body, at + F.lit(2), F.length(body)), F.lit(" \t\n\x0b\f\r")))
    return F.coalesce(F.btrim(F.substring_index(message, "\n", 1), F.lit(LINE_SPACE)), F.lit(""))


def commit_summary(body: Column) -> Column:
    return F.concat(F.coalesce(author_name(body), F.lit("?")), F.lit(": "), subject(body))


def tag_summary(body: Column) -> Column:
    return F.btrim(F.substring_index(body, "\n", 1), F.lit("\r"))


def first_match_line(body: Column, pattern: str) -> Column:
    """The trimmed line that holds the start of the first match, cut to SUMMARY_CHARS; empty without a match."""
    at = F.regexp_instr(body, F.lit(pattern))
    before = F.substring_index(F.substring(body, F.lit(1), at - 1), "\n", -1)
    line = F.btrim(F.concat(before, F.substring_index(F.substring(body, at, F.length(body)), "\n", 1)), F.lit(LINE_SPACE))
    cut = F.when(F.char_length(line) > SUMMARY_CHARS, F.concat(F.substring(line, 1, SUMMARY_CHARS), F.lit("…"))).otherwise(line)
    return F.when(at > 0, cut).otherwise("")


def tree_summary(content: Column, pattern: str) -> Column:
    """The first entry name that matches; empty if only other bytes do."""
    names = F.filter(tree_entries(content), lambda e: e["name"].rlike(pattern))
    return F.coalesce(F.try_element_at(names, F.lit(1))["name"], F.lit(""))


def summary(kind: Column, content: Column, pattern: str) -> Column:
    """A line about an object, by its kind."""
    body = text(content)
    return (
        F.when(kind == "commit", commit_summary(body))
        .when(kind == "blob", first_match_line(body, pattern))
        .when(kind == "tag", tag_summary(body))
        .when(kind == "tree", tree_summary(F.when(kind == "tree", content), pattern))
        .otherwise("")
    )


ENTRIES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("mode", "name", "sha")] + [T.StructField("is_tree", T.BooleanType())]))


def parse_tree(data: bytes | None) -> list[dict]:
    """Entries "<mode> <name> NUL <20 bytes>"; what follows a malformed one is left out."""
    out, at = [], 0
    while data and at < len(data):
        space = data.find(b" ", at)
        end = data.find(b"\0", space + 1) if space >= 0 else -1
        if end < 0 or end + 21 > len(data):
            break
        mode = data[at:space].decode("ascii", "replace")
        out.append({"mode": mode, "name": data[space + 1 : end].decode("utf-8", "replace"), "sha": data[end + 1 : end + 21].hex(), "is_tree": mode == DIRECTORY_MODE})
        at = end + 21
    return out


@F.pandas_udf(ENTRIES)
def tree_entries(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(parse_tree)


def is_binary(content: Column) -> Column:
    """Whether the first bytes hold a zero byte."""
    return F.instr(raw_text(F.substring(content, 1, BINARY_PREFIX)), "\x00") > 0
