"""Personal data and licenses in texts and metadata."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.batches import by_slice

# Formats in the order in which they are redacted, with what stands in their place.
PII_PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    ("phone_cn", r"1[3-9]\d{9}", "[PHONE]"),
    ("phone_intl", r"\+\d{1,3}[\s\-]?\d{3,4}[\s\-]?\d{4,}", "[PHONE]"),
    ("phone_us", r"\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}", "[PHONE]"),
    ("id_card_cn", r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", "[ID_CARD]"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_ADDRESS]"),
)
# Phrases of licenses, compared with the lower-cased text; the first license with the most phrases wins.
LICENSE_PHRASES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit license", "permission is hereby granted, free of charge", "mit")),
    ("Apache-2.0", ("apache license", "version 2.0", "licensed under the apache")),
    ("GPL-3.0", ("gnu general public license", "gpl", "version 3")),
    ("GPL-2.0", ("gnu general public license", "gpl", "version 2")),
    ("BSD-3-Clause", ("bsd 3-clause", "redistribution and use in source and binary")),
    ("BSD-2-Clause", ("bsd 2-clause", "redistribution and use in source and binary forms")),
    ("LGPL-3.0", ("gnu lesser general public license", "lgpl")),
    ("MPL-2.0", ("mozilla public license", "mpl")),
    ("ISC", ("isc license", "isc")),
    ("CC-BY-4.0", ("creative commons attribution 4.0", "cc-by")),
    ("CC-BY-SA-4.0", ("creative commons attribution-sharealike 4.0", "cc-by-sa")),
    ("Unlicense", ("unlicense", "public domain")),
)
#: Licenses for which one phrase is enough.
SURE_LICENSES = ("MIT", "ISC", "Unlicense")


def redact(text: Column) -> Column:
    """The text with all personal data replaced, one format after the other."""
    for _, pattern, to in PII_PATTERNS:
        text = F.regexp_replace(text, f"(?U){pattern}", to)
    return text


def pii_values(text: Column) -> Column:
    """struct of arrays: what each format matches in the original text."""
    return F.struct(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){p}"), F.lit(0)).alias(name) for name, p, _ in PII_PATTERNS])


def pii_findings() -> Callable[..., Column]:
    """A function of a text column: array of (type, value, start, end) by format, then by place."""
    formats = [(name, re.compile(p)) for name, p, _ in PII_PATTERNS]

    def find(text: str | None) -> list[dict]:
        return [{"type": n, "value": m[0], "start": m.start(), "end": m.end()} for n, p in formats for m in p.finditer(text or "")]

    return by_slice("array<struct<type:string,value:string,start:int,end:int>>", find)


def redact_map(metadata: Column) -> Column:
    """A map of strings with its values redacted."""
    return F.transform_values(metadata, lambda _, v: redact(v))


#: What a text must hold for a format to occur in it, where searching for the format itself is slow.
_NEEDS = {"email": re.compile("@"), "phone_us": re.compile(r"\d{3}"), "ipv4": re.compile(r"\d\.\d")}
_FORMATS = tuple((re.compile(p), to, _NEEDS.get(n)) for n, p, to in PII_PATTERNS)
_SURROGATE = re.compile("[\ud800-\udfff]")


def _plain(text: str) -> str:
    """`redact` of one text."""
    for p, to, needs in _FORMATS:
        if needs is None or needs.search(text):
            text = p.sub(to, text)
    return text


def redact_metadata(value: object, redact_text: Callable[[str], str] | None = None) -> object:
    """Nested metadata with its strings redacted: in maps at any depth, and in lists of strings or maps."""
    redact_text = redact_text or _plain

    if isinstance(value, str):
        return redact_text(value)
    if isinstance(value, dict):
        return {k: redact_metadata(v, redact_text) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_metadata(v, redact_text) if isinstance(v, (str, dict)) else v for v in value]
    return value


def _finite(number: str) -> float:
    value = float(number)
    if value - value != 0:
        raise ValueError(number)
    return value


def redact_json() -> Callable[..., Column]:
    """A function of a column of JSON texts: the same with the strings of `redact_metadata` redacted.

    Names of fields and values of other types keep what they are; of a name that comes twice the last counts.  A text that is no JSON,
    has a number that no double holds or is nested too deeply for the parser is redacted as a plain text.  Null stays null,
    and a text in which no format can occur stays as it is and never leaves the JVM.
    """
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            value = redact_metadata(json.loads(text, parse_float=_finite, parse_constant=_finite))
            out = json.dumps(value, ensure_ascii=False)
            return json.dumps(value) if _SURROGATE.search(out) else out
        except (ValueError, RecursionError):
            return _plain(text)

    run = by_slice("string", one)
    # A format may stand between escapes, which are white space or hide anything.  One character before an @ stands for an address, and
    # where none of the first characters stands nothing else is tried, as searching every place for every format is slow.
    loose = [p.replace(r"\b", "").replace(r"[\s\-]", r"(?:[\s\-]|\\[a-z])") for n, p, _ in PII_PATTERNS if n != "email"]
    hint = r"(?U)[a-zA-Z0-9._%+\-]@|\\u|(?=[+(\d])(?:" + "|".join(loose) + ")"

    def redacted(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return F.coalesce(run(F.when(text.rlike(hint), text)), text)

    return redacted


def license_scores(text: Column) -> Column:
    """Array of (hits, -rank, name): phrases of each license in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rows = []
    for i, (name, phrases) in enumerate(LICENSE_PHRASES):
        hits = [F.contains(low, F.lit(p)).cast("int") for p in phrases]
        rows.append(F.struct(sum(hits[1:], hits[0]).alias("hits"), F.lit(-i).alias("first"), F.lit(name).alias("name")))
    return F.array(*rows)


def detect_license(text: Column) -> Column:
    """The license with the most phrases, if it has two, or one and is a sure one; else null."""
    best = F.array_max(license_scores(text))
    return F.when((best["hits"] >= 2) | ((best["hits"] == 1) & best["name"].isin(*SURE_LICENSES)), best["name"])


def copyright_columns(source: Column, license_: Column | None = None, copyright_license: Column | None = None) -> list[Column]:
    """copyright_source and copyright_license: a license that is given, or else one that the source names."""
    given = [c for c in (license_, copyright_license) if c is not None]
    return [source.alias("copyright_source"), F.coalesce(*given, detect_license(source)).alias("copyright_license")]
