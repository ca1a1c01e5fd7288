"""What a provider's failure was and how long it asks to wait, from facts of the response and never from its prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typed provider codes and the kinds that they stand for.
CODES = {
    "rate_limit": "rate_limit",
    "rate_limited": "rate_limit",
    "too_many_requests": "rate_limit",
    "server_error": "server_error",
    "internal_server_error": "server_error",
    "timeout": "timeout",
    "connection": "connection",
    "connection_error": "connection",
    "authentication": "authentication",
    "authentication_error": "authentication",
    "unauthorized": "authentication",
    "authorization": "authorization",
    "permission_denied": "authorization",
    "forbidden": "authorization",
    "invalid_request": "invalid_request",
    "invalid_request_error": "invalid_request",
    "bad_request": "invalid_request",
    "model_mismatch": "model_mismatch",
    "model_substitution": "model_mismatch",
}
_STATUS = {429: "rate_limit", 401: "authentication", 403: "authorization"}


def _named(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def kind(status: Column, code: Column, raised: Column | None = None) -> Column:
    """Kind of a failure: by HTTP status, then by what was raised (`timeout` or `connection`), then by typed code."""
    of_status = F.coalesce(_named(_STATUS, status.cast("int")), F.when(status.between(500, 599), "server_error").when(status.between(400, 499), "invalid_request"))
    of_raised = F.when(raised.isin("timeout", "connection"), raised) if raised is not None else F.lit(None).cast("string")
    return F.coalesce(of_status, of_raised, _named(CODES, F.lower(code)), F.lit("unknown"))


def kind_of(error: BaseException) -> str:
    """As `kind`, of an error that was raised on the driver: its status, its type and its code count, its wording doesn't."""
    status, code = getattr(error, "status_code", getattr(error, "status", None)), getattr(error, "code", None)
    if isinstance(status, int) and not isinstance(status, bool) and 400 <= status <= 599:
        return _STATUS.get(status, "server_error" if status >= 500 else "invalid_request")
    if isinstance(error, (TimeoutError, ConnectionError)):
        return "timeout" if isinstance(error, TimeoutError) else "connection"
    return CODES.get(code.lower(), "unknown") if isinstance(code, str) else "unknown"


def _number(text: Column, times: int) -> Column:
    """Whole milliseconds, 0 or more, of a text that is a finite number; else null."""
    value = F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"), F.trim(text).cast("double")) * times
    return F.when(F.abs(value) < 9e18, F.greatest(value.cast("long"), F.lit(0).cast("long")))


def retry_after_ms(asked: Column, headers: Column) -> Column:
    """Milliseconds that a provider asks to wait: what the error itself says if that is 0 or more, else the header of
    milliseconds, else that of seconds. headers: a map of texts, names in any case; a value that isn't a number counts as absent."""
    named = lambda name: F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0))
    own = F.when(asked >= 0, asked.cast("long"))
    return F.coalesce(own, _number(named("retry-after-ms"), 1), _number(named("retry-after"), 1000))
