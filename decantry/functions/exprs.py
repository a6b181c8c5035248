"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's (order lifecycle and catalogue domains).
ORDER_STATUSES = ["pending", "preparing", "ready", "delivered", "cancelled"]
CATALOG_STATUSES = ["published", "upcoming", "hidden"]
MANUAL_SOURCE = "MANUAL-STUDIO"
MANUAL_NOTE_NUMBER = "MANUAL"
ORDER_SOURCE_PREFIX = "ORDER-"
ORDER_NUMBER_PREFIX = "P-"
ORDER_NUMBER_WIDTH = 5

MONEY = "decimal(12,2)"
ML = "decimal(18,4)"
OUT_ML = "decimal(18,2)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Money is exact: cast to decimal(12,2) before any arithmetic."""
    return col(c).cast(MONEY)


def blank_to_null(c: str | Column) -> Column:
    """nullif(trim(x), '') -- trim strips spaces only, as in the reference."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def is_blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(col(c)), F.lit("")) == F.lit("")


def size_digits(size: str | Column) -> Column:
    """Keep only [0-9.] of a size text; '' -> null ('10 ml x2' -> '102', as documented)."""
    return F.nullif(F.regexp_replace(col(size), "[^0-9.]", ""), F.lit(""))


def size_ml(size: str | Column) -> Column:
    """Millilitres of an item size; unparseable or empty -> 0 (quarantine flag separate)."""
    return F.coalesce(size_digits(size).try_cast(ML), F.lit(0).cast(ML))


def qty_value(qty: str | Column) -> Column:
    """Item quantity; '' or absent -> 1, explicit 0 stays 0."""
    return F.coalesce(F.nullif(col(qty), F.lit("")).try_cast(ML), F.lit(1).cast(ML))


def size_is_bad(size: str | Column) -> Column:
    d = size_digits(size)
    return d.isNotNull() & d.try_cast(ML).isNull()


def qty_is_bad(qty: str | Column) -> Column:
    q = F.nullif(col(qty), F.lit(""))
    return q.isNotNull() & q.try_cast(ML).isNull()


def phone_digits(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9]", "")


def stored_digits(c: str | Column) -> Column:
    """Digits of a stored phone; null stays null, so a profile without a phone matches no request."""
    return F.regexp_replace(col(c), "[^0-9]", "")


def amount(c: str | Column) -> Column:
    """A sum as it came (number or text), exact to 12 places; null where it is none or beyond 10^26."""
    return col(c).try_cast("decimal(38,12)")


def is_negative(c: str | Column) -> Column:
    return col(c).try_cast("double") < 0


def money_once(c: str | Column, kind: str = "decimal(10,2)") -> Column:
    """Rounded once, half up, to two places; null where it does not fit."""
    return F.round(amount(c), 2).try_cast(kind)


def order_number(seq: str | Column, width: int = ORDER_NUMBER_WIDTH) -> Column:
    """'P-' + zero padded sequence; never truncates (lpad would cut past ``width``)."""
    s = col(seq).cast("string")
    return F.concat(F.lit(ORDER_NUMBER_PREFIX),
                    F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))


def text_key(c: str | Column, collation: str | None = None) -> Column:
    """Sort key for names: binary by default (comparable with a SQL oracle), or a collation
    such as 'UNICODE' / 'UNICODE_CI' for human order ('Détour Noir' before 'Dior')."""
    return F.collate(col(c), collation) if collation else col(c)


def catalog_rank_admin(status: str | Column) -> Column:
    """upcoming 0, published 1, anything else 2 (admin list order)."""
    s = col(status)
    return F.when(s == "upcoming", 0).when(s == "published", 1).otherwise(2)


def exact_ratio(num: Column, den: Column, scale: int = 4) -> Column:
    """num/den rounded half-up to ``scale`` digits as an exact decimal; null when den = 0.

    Integer arithmetic on scaled values keeps Spark and any SQL oracle bit-identical.
    Both arguments must be non-negative.
    """
    unit = 10 ** scale
    n = (num.cast("decimal(38,0)") * F.lit(unit) if scale else num).cast("decimal(38,0)")
    d = den.cast("decimal(38,0)")
    q = F.floor((n * 2 + d) / (d * 2))
    return F.when(d == 0, F.lit(None)).otherwise((q.cast("decimal(38,0)") / F.lit(unit)).cast(f"decimal(18,{scale})"))
