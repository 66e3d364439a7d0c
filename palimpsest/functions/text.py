"""Text scalars as Column expressions; Arrow UDFs only where Spark has no such function."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name space of UUIDs of URLs (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
# What ids of captured events and derived sessions start with; the form of a heading line;
# signs of a transient overload in an error text; parts of the names of secret keys.
EVENT_PREFIX, SESSION_PREFIX, MESSAGE_PREFIX = "agno:", "agno-session:", "agno-message-"
HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
OVERLOAD = ["429", "503", "504", "rate limit", "too many requests", "temporarily overloaded", "service unavailable", "gateway timeout", "bad gateway", "capacity exceeded"]
SECRET_KEYS = ("token", "secret", "password", "api_key")

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def term_list(text: Column) -> Column:
    """Terms of two or more of a-z, 0-9 and _ in lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(term_list(text))


def squeeze(text: Column) -> Column:
    """Trimmed, runs of (Unicode) white space as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


entity_name = squeeze


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.str.casefold()


def project_name(text: Column, exact: bool = False) -> Column:
    """Comparable project name. exact: full case folding (ß = ss) in an Arrow UDF in place of lower()."""
    return casefold(squeeze(text)) if exact else F.lower(squeeze(text))


def project_terms(name: Column) -> Column:
    """Terms of a normalised name, parted at white space, - and _."""
    return F.filter(F.split(F.translate(name, "-_", "  "), " +"), lambda t: t != "")


def terms_match(query: Column, candidate: Column) -> Column:
    """Every query term is a term of the candidate or, from four letters on, within its joined terms."""
    have = project_terms(candidate)
    joined = F.array_join(have, "")
    return F.forall(project_terms(query), lambda t: F.array_contains(have, t) | ((F.length(t) >= 4) & F.contains(joined, t)))


def candidate_rank(query: Column, name: Column, aliases: Column) -> Column:
    """0 same name, 1 same alias, 2 within name or alias, 3 terms match; else null. All normalised."""
    near = F.contains(name, query) | F.exists(aliases, lambda a: F.contains(a, query))
    fuzzy = terms_match(query, name) | F.exists(aliases, lambda a: terms_match(query, a))
    return F.when(query == name, 0).when(F.array_contains(aliases, query), 1).when(near, 2).when(fuzzy, 3)


def strip_fence(text: Column) -> Column:
    """Text of a reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def event_key(run_id: Column, suffix: Column) -> Column:
    """Event id of a run; null without a run id."""
    return F.when(F.length(run_id) > 0, F.concat(F.lit(EVENT_PREFIX), run_id, F.lit(":"), suffix))


def uuid5(text: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def session_uuid(session: Column) -> Column:
    """A session's UUID: its own if it is one, else derived from its text."""
    return F.when(session.rlike(UUID), F.lower(session)).otherwise(uuid5(F.concat(F.lit(SESSION_PREFIX), session)))


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(text) > 0, text)


def serialized(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), F.lit(""))


def issue_key(text: Column) -> Column:
    """"SCRUM 80" as "SCRUM-80"."""
    return F.upper(F.regexp_replace(F.trim(text), r"^([A-Za-z]+)\s+(\d+)$", "$1-$2"))


def find_issue_key(text: Column) -> Column:
    """First issue key in a text, in upper case; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)\b([A-Z][A-Z0-9]+-\d+)\b", 1)), F.lit(""))


def is_overload(message: Column) -> Column:
    """Whether an error text tells of a rate limit or an overloaded gateway."""
    low = F.lower(message)
    return low.rlike("|".join(OVERLOAD)) | (F.contains(message, F.lit("404")) & F.contains(low, F.lit("nim")))


def heading(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, HEADING, 1), F.lit(""))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with keys in order, in ASCII; a JSON string as its trimmed self. Null for null and blank, the text itself where it is no JSON."""

    def one(t: str) -> str | None:
        try:
            value = json.loads(t)
        except ValueError:
            value = t
        if value is None:
            return None
        return (value if isinstance(value, str) else json.dumps(value, sort_keys=True)).strip() or None

    return text.map(one, na_action="ignore")


def _fenced_objects(text: str) -> Iterator[str]:
    """Insides of closed code fences that read like one object."""
    for inside in text.split("```")[1:-1:2]:
        body = re.sub("(?i)^json", "", inside).strip()
        if body[:1] == "{" and body[-1:] == "}":
            yield body


def _objects(text: str) -> Iterator[dict]:
    """What decodes as JSON from each opening brace on."""
    for brace in re.finditer("{", text):
        with suppress(ValueError):
            yield json.JSONDecoder().raw_decode(text, brace.start())[0]


def _first_object(text: str) -> str | None:
    seen = "".join(re.split("(?is)<think>.*?</think>", text))
    found = next(_objects(next(_fenced_objects(seen), seen)), None)
    return None if found is None else json.dumps(found, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    """First JSON object in a model's reply, think tags and fences aside; null if there is none."""
    return text.map(_first_object, na_action="ignore")


def _redacted(text: str) -> str:
    secret = re.compile("|".join(map(re.escape, SECRET_KEYS)))
    # the decoder hands over each object's pairs, the innermost first
    hide = lambda pairs: {k: "[redacted]" if secret.search(k.casefold()) else v for k, v in pairs}
    return json.dumps(json.loads(text, object_pairs_hook=hide), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def redact(text: pd.Series) -> pd.Series:
    """JSON text with the values of secret keys replaced, at any depth."""
    return text.map(_redacted, na_action="ignore")
