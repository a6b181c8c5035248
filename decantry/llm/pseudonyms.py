"""Format-preserving pseudonyms of personal numbers and dates by keyed Feistel networks.

Found and validated: payment card numbers (Luhn), North American phone numbers, IPv4
addresses, US social security numbers, calendar dates 1700-2099 (year or day first), and the
local part of e-mail addresses. Each is permuted within its own format, so a pseudonym
validates as the same kind, equal values get equal pseudonyms in every document, and the
key's holder can turn them back (``restore=True``).

* Character networks (cards, phones, e-mails): the value is cut in two halves; in turn,
  each letter and digit of one half moves on within its class by an amount taken from a
  keyed SHA-2 of the other half. Separators stay. A card's check digit is made anew.
* Number networks (IPv4, social security numbers, dates): the value's rank in its domain
  is written as two digits of mixed radix whose product is exactly the domain (for dates
  146,097 days, 27 x 5,411), so no pseudonym leaves the domain.

SQL functions only, within one projection: no shuffle, no Python. Rounds run in a fold
over the round numbers, so the expression does not grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DAYS = 146_097  # of 400 Gregorian years
FIRST_DAY = "1700-01-01"

# What each kind looks like; the first that fits at a place is taken.
# (No group is repeated in EMAIL: Java matches those by recursion, and a long domain would end
# the executor. The domain ends at its first label of letters that may end one; only the local
# part, of at most 64 characters as in RFC 5321, is replaced.)
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-][A-Za-z0-9.-]*?\.[A-Za-z]{2,}"
PHONE = r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DAY_DATE = r"[0-9]{2}([./])[0-9]{2}\1[0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}"
_DAY_DATE_ANY = r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
FOUND = (rf"(?<![A-Za-z0-9._%+@-])(?:{EMAIL})(?![A-Za-z0-9@-])"
         rf"|(?<![0-9+]){PHONE}(?![0-9])"
         rf"|(?<![0-9.]){IPV4}(?![0-9]|\.[0-9])"
         rf"|(?<![0-9./-])(?:{ISO_DATE}|{_DAY_DATE_ANY}|{SSN})(?![0-9]|[./-][0-9])"
         rf"|(?<![0-9])(?:{CARD})(?![0-9])")

MAY_HOLD = r"[0-9]{2}|@|[0-9]\.[0-9]"  # every pattern implies it


def _prf(key: str, kind: str, turn: Column, other: Column) -> Column:
    """128 hex digits that depend on key, kind, round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")).cast("binary"), 512)


def _amount(hexes: Column, at: Column) -> Column:
    """A number below 65,536 from the four hex digits at place ``at`` modulo 32."""
    return F.conv(F.substr(hexes, (at % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _turns(restore: bool) -> Column:
    order = range(ROUNDS - 1, -1, -1) if restore else range(ROUNDS)
    return F.array(*[F.lit(k) for k in order])


def _moved(half: Column, hexes: Column, sign: int) -> Column:
    def move(at: Column) -> Column:
        c = F.substr(half, at + 1, F.lit(1))
        code, by = F.ascii(c), F.lit(sign) * _amount(hexes, at)

        def within(base: int, size: int) -> Column:
            return F.char(F.pmod(code - base + by, F.lit(size)) + base)

        return (F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26))
                .when(code.between(65, 90), within(65, 26)).otherwise(c))

    places = F.sequence(F.lit(0), F.char_length(half) - 1)
    return F.when(F.char_length(half) == 0, half).otherwise(F.array_join(F.transform(places, move), ""))


def _characters(value: Column, key: str, kind: str, restore: bool) -> Column:
    """The character network over letters and digits; other characters stay in place."""
    sign = -1 if restore else 1
    cut = F.floor(F.char_length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1).alias("r"))

    def turn(acc: Column, k: Column) -> Column:
        left = F.when(k % 2 == 0, _moved(acc["l"], _prf(key, kind, k, acc["r"]), sign)).otherwise(acc["l"])
        right = F.when(k % 2 == 1, _moved(acc["r"], _prf(key, kind, k, acc["l"]), sign)).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(_turns(restore), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def _number(rank: Column, low: int, high: int, key: str, kind: str, restore: bool) -> Column:
    """The number network over ranks below ``low * high``."""
    sign = -1 if restore else 1
    start = F.struct(F.floor(rank / high).cast("long").alias("l"), (rank % high).cast("long").alias("r"))

    def amount(k: Column, other: Column) -> Column:
        return F.lit(sign) * F.conv(F.substr(_prf(key, kind, k, other), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(acc: Column, k: Column) -> Column:
        left = F.when(k % 2 == 0, F.pmod(acc["l"] + amount(k, acc["r"]), F.lit(low).cast("long"))).otherwise(acc["l"])
        right = F.when(k % 2 == 1, F.pmod(acc["r"] + amount(k, acc["l"]), F.lit(high).cast("long"))).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(_turns(restore), start, turn, lambda acc: acc["l"] * F.lit(high).cast("long") + acc["r"])


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the right; ``doubled`` is the parity of the doubled places."""
    n = F.char_length(digits)

    def add(acc: Column, at: Column) -> Column:
        d = F.ascii(F.substr(digits, n - at, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when(at % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``value``."""
    def shown(at: Column) -> Column:
        c = F.substr(value, at, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.char_length(_digits(F.substr(value, F.lit(1), at))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(value)), shown), "")


def _card(value: Column, key: str, restore: bool) -> Column:
    """On the digits alone, so that a number is linked however it is grouped."""
    digits = _digits(value)
    body = _characters(F.substr(digits, F.lit(1), F.char_length(digits) - 1), key, "card", restore)
    whole = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 0), F.lit(10)).cast("string")))
    return F.transform(whole, lambda d: _laid_out(value, d))[0]


def _phone(value: Column, key: str, restore: bool) -> Column:
    rest = F.substr(value, F.lit(3))
    made = F.array(_characters(_digits(rest), key, "phone", restore))
    return F.concat(F.lit("+1"), F.transform(made, lambda d: _laid_out(rest, d))[0])


def _email(value: Column, key: str, restore: bool) -> Column:
    at = F.locate("@", value)
    return F.concat(_characters(F.substr(value, F.lit(1), at - 1), key, "email", restore), F.substr(value, at))


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("long"))


def _ipv4(value: Column, key: str, restore: bool) -> Column:
    rank = F.aggregate(_octets(value), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    made = F.array(_number(rank, 65_536, 65_536, key, "ipv4", restore))
    return F.transform(made, lambda n: F.concat_ws(".", *[(F.floor(n / (256 ** k)) % 256).cast("int").cast("string") for k in (3, 2, 1, 0)]))[0]


def _ssn(value: Column, key: str, restore: bool) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substr(value, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    rank = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    made = F.array(_number(rank, 898 * 99, 9999, key, "ssn", restore))

    def shown(n: Column) -> Column:
        a = F.floor(n / (99 * 9999)).cast("int") + 1
        return F.format_string("%03d-%02d-%04d", a + F.when(a >= 666, 1).otherwise(0),
                               (F.floor(n / 9999) % 99).cast("int") + 1, (n % 9999).cast("int") + 1)

    return F.transform(made, shown)[0]


def _date_parts(value: Column, layout: str) -> tuple[Column, Column, Column]:
    at = {"iso": ((1, 4), (6, 2), (9, 2)), "dmy": ((7, 4), (4, 2), (1, 2))}[layout]
    return tuple(F.substr(value, F.lit(a), F.lit(n)).cast("int") for a, n in at)


def _is_date(value: Column, layout: str) -> Column:
    y, m, d = _date_parts(value, layout)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return y.between(1700, 2099) & m.between(1, 12) & (d >= 1) & (d <= length)


def _date(value: Column, layout: str, key: str, restore: bool) -> Column:
    y, m, d = _date_parts(value, layout)
    rank = F.datediff(F.make_date(y, m, d), F.lit(FIRST_DAY).cast("date")).cast("long")
    made = F.array(F.date_add(F.lit(FIRST_DAY).cast("date"), _number(rank, 27, DAYS // 27, key, "date", restore).cast("int")))
    between = F.substr(value, F.lit(3), F.lit(1))

    def shown(day: Column) -> Column:
        yy, mm, dd = F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd")
        return {"iso": F.concat(yy, F.lit("-"), mm, F.lit("-"), dd), "dmy": F.concat(dd, between, mm, between, yy)}[layout]

    return F.transform(made, shown)[0]


def pseudonym(value: Column, key: str, restore: bool = False) -> Column:
    """The pseudonym of one found value; a value that does not validate stays as it is."""
    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    digits = _digits(value)
    area = F.substr(value, F.lit(1), F.lit(3))
    valid_ssn = ~area.isin("000", "666") & (area < "900") & (F.substr(value, F.lit(5), F.lit(2)) != "00") & (F.substr(value, F.lit(8)) != "0000")
    return (F.when(whole(EMAIL) & ~value.contains(".."), _email(value, key, restore))
            .when(whole(PHONE), _phone(value, key, restore))
            .when(whole(IPV4) & F.forall(_octets(value), lambda x: x < 256) & ~value.rlike(r"(?:^|\.)0[0-9]"), _ipv4(value, key, restore))
            .when(whole(ISO_DATE) & _is_date(value, "iso"), _date(value, "iso", key, restore))
            .when(whole(DAY_DATE) & _is_date(value, "dmy"), _date(value, "dmy", key, restore))
            .when(whole(SSN) & valid_ssn, _ssn(value, key, restore))
            .when(whole(CARD) & (_luhn_sum(digits, 1) % 10 == 0), _card(value, key, restore))
            .otherwise(value))


def pseudonymise(docs: DataFrame, key: str, restore: bool = False) -> DataFrame:
    """All input columns with ``text`` replaced, and ``n_replaced`` (a column of that name is replaced).

    Whole texts; a null text stays null with 0 replacements, an empty one stays empty.
    Rows are independent, so repeated rows come out alike and an empty table gives none.
    ``restore=True`` with the same key gives the original texts back.
    """
    text = F.col("text").cast("string")
    found = F.when(text.rlike(MAY_HOLD), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)))
    # One struct of everything, so that no name of the input can clash.
    own = [c for c in docs.columns if c not in ("text", "n_replaced")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("rest"), text.alias("text"), found.alias("found")) if own else \
        docs.select(text.alias("text"), found.alias("found"))
    made = rows.withColumn("made", F.transform("found", lambda m: pseudonym(m, key, restore)))
    joined = F.array_join(F.zip_with(F.split("text", FOUND, -1), F.concat("made", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(F.zip_with("found", "made", lambda a, b: a != b), lambda x: x))
    some = F.coalesce(F.size("made") > 0, F.lit(False))
    out = {**{c: F.col("rest").getField(c) for c in own}, "text": F.when(some, joined).otherwise(F.col("text"))}
    return made.select(*(out[c].alias(c) for c in docs.columns if c != "n_replaced"),
                       F.when(some, changed).otherwise(0).cast("long").alias("n_replaced"))
