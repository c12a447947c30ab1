"""Structural JSON comparison and JSON access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A JSON string token is matched first and kept, so only numbers outside of strings
# lose a trailing ".0". Possessive, so long strings need no stack.
_WHOLE_DOUBLE = r'("(?:[^"\\]++|\\.)*+")|(-?\d+)\.0(?=[,}\]]|\z)'

# Tokens of a text: strings, runs of number characters, anything else.
_TOKENS = r'(?s)"(?:[^"\\]++|\\.)*+"|[-+0-9.][-+0-9.eE]*+|[^"\-+0-9.]++|.'
_NUMBER = r"^(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"
# Numbers whose spelling the parser would keep: with an exponent, or longer than a long.
_SPELLED = r"[0-9][eE]|[0-9.]{19}"
# Stands after a value to show where it ends, as a string and as written in JSON.
_MARK, _MARK_TEXT = "\x00end of value\x00", r"\u0000end of value\u0000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain_number(token: Column) -> Column:
    """One spelling for each number: plain digits, or for very large and small ones digits and
    exponent in a string that no number has otherwise."""
    part = [F.regexp_extract(token, _NUMBER, i) for i in range(5)]
    sign, whole, fraction = part[1], part[2], part[3]
    power = F.coalesce(F.when(part[4] != "", part[4]).try_cast("int"), F.when(part[4] == "", F.lit(0)))
    digits = F.regexp_replace(F.concat(whole, fraction), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    power = power - F.length(fraction) + F.length(digits) - F.length(short)
    plain = F.regexp_replace(token.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    fits = power.between(-18, 19) & (F.length(short) + power <= 20)
    spelled = F.concat(F.lit('"'), F.lit("\\u0000"), sign, short, F.lit("e"), power.cast("string"), F.lit('"'))
    number = F.when(short == "", F.lit("0")).when(fits, plain).otherwise(spelled)
    return F.when(token.rlike(_SPELLED) & token.rlike(_NUMBER), F.coalesce(number, token)).otherwise(token)


def _one_spelling(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, _plain_number), "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _form(text: Column, finish: Callable[[Column], Column]) -> Column:
    """What ``finish`` makes of the rendered value; NULL when ``text`` is not exactly one valid JSON value.

    The variant parser accepts trailing text, so the value is parsed inside an array, with
    a mark after it: only a text that is one value leaves the mark in the second place.
    """
    array = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK_TEXT}"]')))

    def single(parsed: Column) -> Column:
        value = F.to_json(F.try_variant_get(parsed, "$[0]", "variant"))
        return F.when(F.try_variant_get(parsed, "$[1]", "string") == _MARK, _bound(value, finish))

    return _bound(array, single)


def _finished(text: Column | str, finish: Callable[[Column], Column]) -> Column:
    def each(c: Column) -> Column:
        # Only numbers written with an exponent come out as doubles.
        spelled = _bound(_one_spelling(c), lambda one: _form(one, lambda form: finish(
            F.when(one.rlike("[0-9][eE]"), F.regexp_replace(form, _WHOLE_DOUBLE, "$1$2")).otherwise(form)
        )))
        return F.when(c.rlike(_SPELLED), spelled).otherwise(_form(c, finish))

    return _bound(_col(text), each)


def canonical_json(text: Column | str) -> Column:
    """Comparable text of one JSON value: keys sorted, array order kept, numbers normalised.

    NULL when ``text`` is not exactly one valid JSON value. Each text is parsed once.
    """
    return _finished(text, lambda form: form)


def object_digest(text: Column | str) -> Column:
    """Digest of the comparable form of one JSON object; NULL for anything else.

    Equal digests mean structurally equal objects. A digest is computed once, before a
    join, and is short to move; the texts themselves need not meet.
    """
    return _finished(text, lambda form: F.when(form.startswith("{"), F.sha2(form, 256)))


def compare_digests(required_empty: Column, current_empty: Column, required: Column, current: Column) -> Column:
    """``same`` / ``changed`` / ``error`` of two texts, given which are empty and their digests.

    If either text is empty the texts are compared as they are. Otherwise both must be
    JSON objects; anything else is an error, never a difference.
    """
    return (
        F.when(
            required_empty | current_empty,
            F.when(required_empty & current_empty, F.lit("same")).otherwise(F.lit("changed")),
        )
        .when(required.isNull() | current.isNull(), F.lit("error"))
        .when(required == current, F.lit("same"))
        .otherwise(F.lit("changed"))
    )


def json_status(required: Column | str, current: Column | str) -> Column:
    """``same`` / ``changed`` / ``error`` of two JSON texts; NULL counts as empty."""
    r = F.coalesce(_col(required), F.lit(""))
    c = F.coalesce(_col(current), F.lit(""))
    return compare_digests(r == "", c == "", object_digest(r), object_digest(c))


def valid_object(text: Column | str) -> Column:
    """True when ``text`` is exactly one JSON object."""
    return F.coalesce(_finished(text, lambda form: form.startswith("{")), F.lit(False))


def json_path(text: Column | str, path: str, type_: str = "string") -> Column:
    """One value of a JSON text by path (array elements allowed); NULL when absent."""
    return F.try_variant_get(F.try_parse_json(_col(text)), path, type_)


def single_value(text: Column | str) -> tuple[Column, Column]:
    """Unwrap a one-key object: ``(value, failed)``.

    A blank text and a non-object give an empty value; an object without exactly one
    key, or a text that is not JSON, fails.
    """
    c = F.coalesce(_col(text), F.lit(""))
    form = canonical_json(c)
    entries = F.from_json(form, "map<string,variant>")
    value = (
        F.when(c == "", F.lit(""))
        .when(form.startswith("{") & (F.size(entries) == 1), F.to_json(F.map_values(entries)[0]))
        .otherwise(F.lit(""))
    )
    failed = (c != "") & (form.isNull() | (form.startswith("{") & (F.size(entries) != 1)))
    return value, failed


_TASK = (
    "completed boolean, "
    "task struct<status: struct<created: bigint, updated: bigint, deleted: bigint, total: bigint>>, "
    "response struct<failures: array<struct<id: string, cause: struct<type: string, reason: string>>>>"
)


def task_status(body: Column | str) -> Column:
    """Progress counters and first failure of a copy task answer; absent parts are zero or NULL."""
    t = F.from_json(_col(body), _TASK)

    def n(name: str) -> Column:
        return F.coalesce(t["task"]["status"][name], F.lit(0))

    failure = F.get(t["response"]["failures"], F.lit(0))
    return F.struct(
        F.coalesce(t["completed"], F.lit(False)).alias("completed"),
        (n("created") + n("updated") + n("deleted")).alias("done"),
        n("total").alias("total"),
        failure["id"].alias("failure_id"),
        failure["cause"]["type"].alias("cause_type"),
        failure["cause"]["reason"].alias("cause_reason"),
    )


_HITS = (
    "hits struct<hits: array<struct<_id: string, _seq_no: bigint, _primary_term: bigint, _source: variant>>>"
)


def search_hits(body: Column | str) -> Column:
    """The hits array of a search answer, one struct per document."""
    return F.from_json(_col(body), _HITS)["hits"]["hits"]
