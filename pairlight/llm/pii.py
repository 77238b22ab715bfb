"""Personal data: regular expressions propose spans, checks confirm them, words nearby move the score.

Each kind has one pattern whose matches are leftmost and do not overlap. The
text between matches gives the places: a match starts behind all pieces and
matches before it, summed in two levels so that a text with very many matches
stays cheap. Cards need the Luhn sum, bank accounts the remainder 1 of division
by 97. Kinds that the checks cannot confirm (`national`, `secret`) need a context word
to reach the threshold. Patterns are possessive and start at the first sign of a
run, so that very long runs cost no more than their length. One pass over the
rows, no shuffle; DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.functions.text import let

_BLOCK = 64


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _between(s: Column, low: int, high: int) -> Column:
    return F.length(_digits(s)).between(low, high)


def luhn(s: Column) -> Column:
    """Whether the digits of `s` pass the Luhn sum."""
    places = F.split(F.reverse(_digits(s)), "")
    return F.aggregate(F.transform(F.filter(places, lambda d: d != ""), lambda d, i: d.cast("int") * (1 + i % 2)), F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether a bank account number, its first four signs moved to the end and letters read as 10 to 35, leaves 1 when divided by 97."""
    bare = F.regexp_replace(s, " ", "")
    signs = F.filter(F.split(F.concat(F.substring(bare, 5, 1 << 20), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(signs, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def parts_at_most_255(s: Column) -> Column:
    return F.forall(F.split(s, "[.]"), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def mixed(s: Column) -> Column:
    """Whether a run looks made by a machine: letters, four digits or more, eight different signs or more."""
    return s.rlike("[A-Za-z]") & (F.length(_digits(s)) >= 4) & (F.size(F.array_distinct(F.split(s, ""))) >= 8)


@dataclass(frozen=True)
class Kind:
    """`pattern` proposes; `confirm` drops what fails; `score` plus `near` if a word of `context` is close. `base` kinds always stay."""
    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    context: str
    score: float
    base: bool = True


NEAR = 0.3
#: The first four are the fixed kinds in their fixed order.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "e-?mails?|mail|contact|write", 0.7),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", parts_at_most_255, "ip|address|server|host|login", 0.5),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", lambda m: _between(m, 12, 19) & luhn(m), "card|visa|credit|debit|payment|karte|carte|tarjeta", 0.7),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: _between(m, 9, 15), "phone|tel|telephone|call|mobile|fax", 0.6),
    Kind("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, "iban|account|bank|konto|compte|cuenta", 0.7, False),
    Kind("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), "ssn|social security|social|insurance", 0.3, False),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", mixed, "tokens?|secrets?|passwords?|passwd|pwd|credentials?|bearer|auth|(?:api|access|private|secret)[_ -]?keys?", 0.3, False),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-]))", lambda m: F.lit(True), "key|token", 0.7, False),
)


def _before(sizes: Column) -> Column:
    """Sums of all earlier elements of an array with one element at least."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), block(F.size(sizes) - 1)), lambda b: total(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))
    starts = let(blocks, lambda s: F.transform(s, lambda x, b: total(F.slice(s, F.lit(1), b))))
    return let(starts, lambda s: F.transform(sizes, lambda x, i: F.get(s, block(i)) + total(F.slice(sizes, block(i) * _BLOCK + 1, i % _BLOCK))))


def _spans(text: Column, order: int, kind: Kind, threshold: float) -> Column:
    empty = F.array().cast("array<struct<start:int,nr:int,end:int,kind:string,score:double>>")
    pattern = F.lit(kind.pattern)

    def place(m: Column, between: Column, starts: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            close = F.concat_ws(" ", F.right(F.get(between, i), F.lit(40)), F.left(F.get(between, i + 1), F.lit(20)))
            score = F.lit(kind.score) + F.when(close.rlike(rf"(?i)\b(?:{kind.context})\b"), NEAR).otherwise(0.0)
            start = F.get(starts, i) + F.length(F.get(between, i))
            return F.struct(start.alias("start"), F.lit(order).alias("nr"), (start + F.length(x)).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"), kind.confirm(x).alias("ok"))

        made = F.filter(F.transform(m, span), lambda s: s["ok"] & (F.lit(kind.base) | (s["score"] >= threshold)))
        return F.transform(made, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "nr", "end", "kind", "score")]))

    def found(m: Column) -> Column:
        return F.when(F.size(m) == 0, empty).otherwise(let(F.split(text, kind.pattern, -1), lambda between: let(
            _before(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(between, i)))), lambda starts: place(m, between, starts))))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), found)


def find(docs: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.5) -> DataFrame:
    """`docs` with the column `out`: spans (start, nr, end, kind, score) by start, then kind in the order of `kinds`.

    Places count code points, the end is exclusive. Base kinds are listed
    whenever their check passes; the others also need `threshold`. Null or
    empty text has none. Repeated rows and other columns stay; a column named
    `out` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = let(whole, lambda t: F.array_sort(F.concat(*[_spans(t, i, k, threshold) for i, k in enumerate(kinds)])))
    return docs.drop(out).withColumn(out, spans)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
