"""Text expressions: canonical JSON, frontmatter, links, tokens."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns of the note format and of tokens.
FRONTMATTER = r"(?s)^---\n(.*?)\n---\n"
LINK = r"\[\[([^\]]+)\]\]"
QUERY_TOKEN = "([a-z0-9]+)"
DOC_TOKEN = r"([\p{L}\p{N}\p{Co}]+)"

_STRING = r'"(?:[^"\\]|\\.)*"'
_HEX = '"[0-9a-f]{64}"'
CANONICAL_LINE = (
    rf'^\{{"actor":{_STRING},"chain_hash":{_HEX},"event_key":(?:null|{_STRING}),"event_type":{_STRING},'
    rf'"payload":(.*),"payload_hash":{_HEX},"prev_hash":{_HEX},"seq":\d+,"ts_ms":-?\d+,"ts_utc":{_STRING}\}}$'
)

#: Made once: ``json.dumps`` with options makes an encoder a call.
_canonical = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no blanks and ASCII escapes."""
    return text.map(lambda s: None if s is None else _canonical(json.loads(s)))


@F.pandas_udf(T.StringType())
def canonical_payload(line: pd.Series) -> pd.Series:
    """Canonical JSON of the ``payload`` member of a log line."""
    return line.map(lambda s: None if s is None else _canonical(json.loads(s).get("payload")))


def json_string(value: Column) -> Column:
    """A JSON string literal with non-ASCII characters left as they are; NULL gives ``null``."""
    return F.when(value.isNull(), F.lit("null")).otherwise(
        F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
    )


def chain_step(prev_hash: Column, payload_hash: Column) -> Column:
    """Next link of a hash chain; NULL unless both inputs are 64 characters."""
    ok = (F.length(prev_hash) == 64) & (F.length(payload_hash) == 64)
    return F.when(ok, F.sha2(F.concat(prev_hash, payload_hash), 256))


def frontmatter_map(text: Column) -> Column:
    """Frontmatter scalars and inline lists as map<string,string>; lists keep their brackets."""
    lines = F.split(F.regexp_extract(text, FRONTMATTER, 1), "\n")
    useful = F.filter(lines, lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))
    pairs = F.transform(
        useful,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("k"),
            F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"),
        ),
    )
    filled = F.filter(pairs, lambda p: F.length(p["v"]) > 0)
    last = F.filter(
        F.transform(filled, lambda p, i: F.struct(p["k"].alias("k"), _scalar(p["v"]).alias("v"), i.alias("i"))),
        lambda p: ~F.exists(F.slice(filled, p["i"] + 2, F.size(filled)), lambda q: q["k"] == p["k"]),
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def _scalar(v: Column) -> Column:
    listed = v.startswith("[") & v.endswith("]")
    return F.when(listed, v).otherwise(F.regexp_replace(v, "^['\"]+|['\"]+$", ""))


def inline_list(v: Column) -> Column:
    """``[a, 'b']`` → array; a scalar becomes an array of one; NULL becomes empty."""
    inner = F.regexp_extract(v, r"(?s)^\[(.*)\]$", 1)
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))
    listed = F.filter(items, lambda x: F.length(x) > 0)
    return (
        F.when(v.isNull(), F.array().cast("array<string>"))
        .when(v.startswith("[") & v.endswith("]"), listed)
        .otherwise(F.array(v))
    )


def frontmatter_body(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def wikilinks(text: Column) -> Column:
    """Distinct link targets, display part removed, sorted."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(LINK), 1), lambda x: F.trim(F.split(x, r"\|")[0]))
    return F.sort_array(F.array_distinct(targets))


def accent_tables() -> tuple[str, str]:
    """(accented letters, base letters), derived from the Unicode decompositions of the Latin
    blocks; combining marks follow without a counterpart, so ``translate`` drops them."""
    src, dst = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(x) for x in parts[1:]):
            src.append(chr(point))
            dst.append(parts[0].lower())
    marks = "".join(chr(x) for x in range(0x300, 0x370))
    return "".join(src) + marks, "".join(dst)


def doc_tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits of the folded text."""
    src, dst = accent_tables()
    return F.regexp_extract_all(F.translate(F.lower(text), src, dst), F.lit(DOC_TOKEN), 1)


def query_tokens(text: Column) -> Column:
    """Query tokens: runs of a-z and 0-9; other letters split words."""
    return F.regexp_extract_all(F.lower(text), F.lit(QUERY_TOKEN), 1)
