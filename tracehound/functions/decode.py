"""Decoders for obfuscated request text, as column expressions.

Every decoder is guarded by a cheap test, so plain text passes through inside
generated code and only suspicious rows reach the token work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracehound.functions.text import bind

Decoder = Callable[[Column], Column]

_REPLACEMENT = "�"


def _char(hex4: Column) -> Column:
    """Character of a four-digit UTF-16 code; half a surrogate pair is not a character."""
    return F.when(
        F.regexp_like(hex4, F.lit("^[dD][89a-fA-F]")), F.lit(_REPLACEMENT)
    ).otherwise(F.decode(F.unhex(hex4), "UTF-16BE"))


def _map_tokens(col: Column, tokens: str, body: Callable[[Column], Column]) -> Column:
    """Split a text into tokens that cover it, rewrite each, and join again."""
    parts = F.regexp_extract_all(col, F.lit("(?s)" + tokens), F.lit(0))
    return F.array_join(F.transform(parts, body), "")


def _percent_pass(col: Column) -> Column:
    # a plus sign stays a plus sign
    return F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


def _percent_broken(decoded: Column, source: Column) -> Column:
    """Bad escape, or bytes that are not UTF-8 (seen as a new replacement character)."""
    new_mark = (
        F.contains(decoded, F.lit(_REPLACEMENT))
        & ~F.contains(source, F.lit(_REPLACEMENT))
        & ~F.contains(F.lower(source), F.lit("%ef%bf%bd"))
    )
    return decoded.isNull() | new_mark


def _percent_bytes(col: Column) -> Column:
    """Each %XX on its own, as one Latin-1 character; other percent signs stay."""
    return _map_tokens(
        col,
        "%[0-9A-Fa-f]{2}|[^%]+|%",
        lambda t: F.when(
            F.regexp_like(t, F.lit("^%[0-9A-Fa-f]{2}$")),
            _char(F.concat(F.lit("00"), F.substr(t, F.lit(2)))),
        ).otherwise(t),
    )


def decode_url_iter(col: Column, passes: int = 3) -> Column:
    """Percent-decode until stable, ``passes`` times at most.

    A text that does not decode as a whole is decoded byte by byte, and stays so.
    """

    def step(text: Column, left: int) -> Column:
        if left == 0:
            return text
        # ``text`` is a bound variable here: naming it often costs nothing
        return F.when(
            F.contains(text, F.lit("%")),
            bind(
                _percent_pass(text),
                lambda d: F.when(_percent_broken(d, text), _percent_bytes(text)).otherwise(
                    step(d, left - 1)
                ),
            ),
        ).otherwise(text)

    return F.when(F.contains(col, F.lit("%")), bind(col, lambda t: step(t, passes))).otherwise(col)


def _base64_text(token: Column) -> Column:
    """Decoded run, or the run itself when the result does not look like text."""
    body = F.rtrim(token, F.lit("="))
    # a single left-over character carries no byte
    usable = F.substr(
        body, F.lit(1), F.length(body) - F.when(F.length(body) % 4 == 1, 1).otherwise(0)
    )
    decoded = F.make_valid_utf8(F.unbase64(usable).cast("string"))

    def judge(text: Column) -> Column:
        printable = F.length(F.regexp_replace(text, "[^\\x20-\\x7E]", ""))
        astral = F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))
        units = F.length(text) + astral
        return F.when((units > 2) & (printable > units * F.lit(0.8)), text).otherwise(token)

    return F.when(
        (F.length(body) >= 8) & (F.length(token) - F.length(body) <= 2), bind(decoded, judge)
    ).otherwise(token)


def decode_base64_segments(col: Column) -> Column:
    """Replace every Base64-shaped run whose decoded bytes are mostly printable."""
    return F.when(
        F.regexp_like(col, F.lit("[A-Za-z0-9+/]{8}")),
        _map_tokens(
            col,
            "[A-Za-z0-9+/]+=*|[^A-Za-z0-9+/]+",
            lambda t: F.when(F.regexp_like(t, F.lit("^[A-Za-z0-9+/]{8}")), _base64_text(t)).otherwise(t),
        ),
    ).otherwise(col)


def decode_unicode_escapes(col: Column) -> Column:
    r"""``\uXXXX`` (surrogate pairs together), then ``\xXX``."""

    def wide(t: Column) -> Column:
        digits = F.regexp_replace(t, r"\\u", "")
        return F.when(
            F.regexp_like(t, F.lit(r"^\\u[0-9A-Fa-f]{4}\\u")), F.decode(F.unhex(digits), "UTF-16BE")
        ).when(F.regexp_like(t, F.lit(r"^\\u[0-9A-Fa-f]{4}")), _char(digits)).otherwise(t)

    def narrow(t: Column) -> Column:
        return F.when(
            F.regexp_like(t, F.lit(r"^\\x[0-9A-Fa-f]{2}")),
            _char(F.concat(F.lit("00"), F.substr(t, F.lit(3)))),
        ).otherwise(t)

    pair = r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}"

    def step(text: Column, mark: str, tokens: str, body: Callable[[Column], Column]) -> Column:
        return F.when(F.contains(text, F.lit(mark)), _map_tokens(text, tokens, body)).otherwise(text)

    return F.when(
        F.contains(col, F.lit("\\")),
        bind(
            bind(col, lambda t: step(t, "\\u", pair + r"|\\u[0-9A-Fa-f]{4}|[^\\]+|\\", wide)),
            lambda t: step(t, "\\x", r"\\x[0-9A-Fa-f]{2}|[^\\]+|\\", narrow),
        ),
    ).otherwise(col)


# Named entities in replacement order (so "&amp;lt;" ends as "<").
NAMED_ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
]


def decode_html_entities(col: Column) -> Column:
    """Named entities, then hexadecimal, then decimal character references."""
    named = reduce(
        lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), NAMED_ENTITIES, col
    )

    def low16(hexa: Column) -> Column:
        return F.substr(F.lpad(hexa, F.greatest(F.length(hexa), F.lit(4)), F.lit("0")), F.lit(-4))

    def hexadecimal(t: Column) -> Column:
        digits = F.regexp_extract(t, "^&#x([0-9A-Fa-f]+);$", 1)
        return F.when(digits != "", _char(low16(digits))).otherwise(t)

    def decimal(t: Column) -> Column:
        digits = F.regexp_extract(t, "^&#([0-9]+);$", 1)
        # the low 16 bits are settled by the last 16 digits, as 2^16 divides 10^16
        return F.when(digits != "", _char(low16(F.conv(F.substr(digits, F.lit(-16)), 10, 16)))).otherwise(t)

    def step(text: Column, mark: str, tokens: str, body: Callable[[Column], Column]) -> Column:
        return F.when(F.contains(text, F.lit(mark)), _map_tokens(text, tokens, body)).otherwise(text)

    return F.when(
        F.contains(col, F.lit("&")),
        bind(
            named,
            lambda n: bind(
                step(n, "&#x", "&#x[0-9A-Fa-f]+;|[^&]+|&", hexadecimal),
                lambda h: step(h, "&#", "&#[0-9]+;|[^&]+|&", decimal),
            ),
        ),
    ).otherwise(col)


DEFAULT_STEPS: tuple[Decoder, ...] = (
    decode_url_iter,
    decode_base64_segments,
    decode_unicode_escapes,
    decode_html_entities,
)


def add_transform(
    steps: Sequence[Decoder], transform: Decoder, position: int | None = None
) -> tuple[Decoder, ...]:
    """Step list with a user transform at a position, at the end by default."""
    out = list(steps)
    out.insert(len(out) if position is None else position, transform)
    return tuple(out)


def deobfuscate(col: Column, steps: Sequence[Decoder] = DEFAULT_STEPS) -> Column:
    """Apply the steps in order."""
    text = col
    for step in steps:
        text = bind(text, step)
    return text
