"""Pseudonyms of personal numbers and dates that keep their format, with Spark's own functions only.

Card numbers (Luhn), bank accounts (modulo 97), calendar dates, telephone, social
security and internet addresses are validated and then permuted under a key
inside their own kind, by a Feistel network over two parts of the number. A pseudonym
is valid again, and equal values have equal pseudonyms in all documents. Check
digits are worked out anew, signs between digits stay. ``restored`` turns the
permuted kinds back. Names in mail addresses and secrets have no such domain:
they become keyed hashes of the same length, which can't be turned back.

A card or account number may be followed or preceded by other digits or capitals.
Where such a text as a whole isn't valid, the longest valid part from one sign
between its groups to another is taken, the leftmost first, and the rest is
searched like all other text. If the whole is valid too, by chance, it counts.

What looks like a number and isn't valid stays, and so does all other text. A
NULL text stays NULL, an empty one empty. Repeated rows give equal results.
Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
DEFAULT_KEY = "pseudonym key of a test"

PATTERNS = {
    "mail": r"(?<![\w.+%-])[\w.+%-]++@[\w-]++(?:\.[\w-]++)+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "access": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    "secret": r"(?<!\w)(?:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\x22']?[\w/+-]{8,}",
    "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "iso": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?!\d|-\d)",
    "date": r"(?<![\d/.])(?:\d{1,2}/\d{1,2}/|\d{1,2}\.\d{1,2}\.)\d{4}(?!\d|[/.]\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "abroad": r"(?<![\d+])\+\d{2}(?:[ .-]?\(?\d{1,5}\)?){1,4}\d{2}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
EVERY = "|".join(PATTERNS.values())
# A number that may begin at any of its groups, so the match itself is empty.
ANYWHERE = {
    "card": r"(?<!\d)(?=(\d(?:[ -]?\d){12,18})(?!\d))",
    "account": r"(?<![A-Za-z0-9])(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9]))",
}
# A private-use character, which no pattern has, parts numbers from their neighbours.
PART = "\ue00f"
FIRST_DAY, DAYS, DAY_PARTS = "1900-01-01", 73_049, (17, 4_297)  # 1900 to 2099


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Work out a value once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def feistel(a: Column, b: Column, most_a: Column, most_b: Column, key: str, back: bool = False) -> Column:
    """Permute pairs of numbers below two bounds: in turns, one part gets a keyed hash of the other added."""
    turns = F.array(*(F.lit(r) for r in (range(ROUNDS)[::-1] if back else range(ROUNDS))))
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(x: Column, r: Column) -> Column:
        even = r % 2 == 0
        other, bound = F.when(even, x["b"]).otherwise(x["a"]), F.when(even, most_a).otherwise(most_b).cast("bigint")
        digest = F.sha2(F.concat_ws(":", F.lit(key), r.cast("string"), bound.cast("string"), other.cast("string")), 256)
        added = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % bound
        moved = F.pmod(F.when(even, x["a"]).otherwise(x["b"]) + (-added if back else added), bound)
        return F.struct(
            F.when(even, moved).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(moved).alias("b")
        )

    return F.aggregate(turns, start, turn)


def _permuted(digits: Column, key: str, back: bool) -> Column:
    """Permute all strings of as many digits, up to 34."""
    size = F.char_length(digits)
    half = (size / 2).cast("int")
    bound = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).try_cast("bigint")
    pair = feistel(
        _number(F.left(digits, half)), _number(F.right(digits, size - half)), bound(half), bound(size - half), key, back
    )
    return F.when(size < 2, digits).otherwise(let(pair, lambda p: F.concat(
        F.when(half > 0, F.lpad(p["a"].cast("string"), half, "0")).otherwise(""),
        F.lpad(p["b"].cast("string"), size - half, "0"),
    )))


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(format_: Column, digits: Column) -> Column:
    """A text with its digits replaced in order."""
    start = F.struct(F.lit("").alias("made"), F.lit(1).alias("at"))
    is_digit = lambda c: c.between("0", "9")
    return F.aggregate(
        F.filter(F.split(format_, ""), lambda c: c != ""), start,
        lambda x, c: F.struct(
            F.concat(x["made"], F.when(is_digit(c), F.substring(digits, x["at"], F.lit(1))).otherwise(c)).alias("made"),
            (x["at"] + F.when(is_digit(c), 1).otherwise(0)).alias("at"),
        ),
        lambda x: x["made"],
    )


def _luhn_digit(body: Column) -> Column:
    size = F.char_length(body)

    def step(total: Column, i: Column) -> Column:
        twice = _number(F.substring(body, size - i, F.lit(1))) * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0).cast("bigint"), step)
    return ((10 - total % 10) % 10).cast("string")


def _card(text: Column, key: str, back: bool) -> Column:
    def change(digits: Column) -> Column:
        body = F.left(digits, F.char_length(digits) - 1)
        made = let(_permuted(body, f"{key}:card", back), lambda b: F.concat(b, _luhn_digit(b)))
        return F.when(_luhn_digit(body) == F.right(digits, F.lit(1)), _filled(text, made)).otherwise(text)

    return let(_only_digits(text), change)


def _check_digits(plain: Column) -> Column:
    """Check digits of a country and an account."""
    moved = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(2)), F.lit("00"))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), _number(c)).otherwise(F.ascii(c).cast("bigint") - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0).cast("bigint"), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _account(text: Column, key: str, back: bool) -> Column:
    def change(plain: Column) -> Column:
        account = F.substring(plain, 5, 64)
        made = F.concat(F.left(plain, F.lit(2)), F.lit("00"), _filled(account, _permuted(_only_digits(account), f"{key}:account", back)))
        valid = _check_digits(plain) == F.substring(plain, 3, 2)
        return F.when(valid, let(made, lambda m: _filled(
            text, F.concat(_check_digits(m), _only_digits(F.substring(m, 5, 64)))
        ))).otherwise(text)

    return let(F.replace(text, F.lit(" "), F.lit("")), change)


def _in_parts(values: list[Column], bounds: list, key: str, back: bool) -> Column:
    """Permute three numbers below their bounds, the last with each of the others in turn."""
    bounds = [b if isinstance(b, Column) else F.lit(b) for b in bounds]
    steps = list(enumerate([(0, 2), (1, 2), (0, 1)]))

    def step(n: int, i: int, j: int) -> Callable[[Column], Column]:
        def paired(s: Column) -> Column:
            pair = feistel(s[i], s[j], bounds[i], bounds[j], f"{key}:{n}", back)
            return let(pair, lambda p: F.array(*(p["a"] if k == i else p["b"] if k == j else s[k] for k in range(3))))

        return paired

    state = F.array(*(v.cast("bigint") for v in values))
    for n, (i, j) in reversed(steps) if back else steps:
        state = let(state, step(n, i, j))
    return state


def _phone(text: Column, key: str, back: bool) -> Column:
    """Area and exchange codes stay in the range from 200 on, or below, where they were."""

    def change(digits: Column) -> Column:
        ten = F.right(digits, F.lit(10))
        parts = [_number(F.substring(ten, 1, 3)), _number(F.substring(ten, 4, 3)), _number(F.substring(ten, 7, 4))]
        low = [F.when(p >= 200, 200).otherwise(0) for p in parts[:2]]
        bounds = [F.when(p >= 200, 800).otherwise(200) for p in parts[:2]] + [F.lit(10_000)]
        moved = _in_parts([parts[0] - low[0], parts[1] - low[1], parts[2]], bounds, f"{key}:phone", back)
        made = let(moved, lambda m: F.concat(
            F.left(digits, F.char_length(digits) - 10), F.lpad((m[0] + low[0]).cast("string"), 3, "0"),
            F.lpad((m[1] + low[1]).cast("string"), 3, "0"), F.lpad(m[2].cast("string"), 4, "0"),
        ))
        return _filled(text, made)

    return let(_only_digits(text), change)


def _abroad(text: Column, key: str, back: bool) -> Column:
    """The country's two digits stay."""
    def change(digits: Column) -> Column:
        made = F.concat(F.left(digits, F.lit(2)), _permuted(F.substring(digits, 3, 64), f"{key}:abroad", back))
        return F.when(F.char_length(digits).between(8, 15), _filled(text, made)).otherwise(text)

    return let(_only_digits(text), change)


def _address(text: Column, key: str, back: bool) -> Column:
    def change(parts: Column) -> Column:
        valid = F.forall(parts, lambda p: (_number(p) < 256) & ((p == "0") | ~p.startswith("0")))
        pair = feistel(
            _number(parts[0]) * 256 + _number(parts[1]), _number(parts[2]) * 256 + _number(parts[3]),
            F.lit(65_536), F.lit(65_536), f"{key}:address", back,
        )
        made = let(pair, lambda p: F.concat_ws(
            ".", *(x.cast("bigint").cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))
        ))
        return F.when(valid, made).otherwise(text)

    return let(F.split(text, r"\."), change)


def _social(text: Column, key: str, back: bool) -> Column:
    """Areas 001 to 899 without 666, groups from 01 and serials from 0001."""
    area, group, serial = (_number(F.substring(text, *at)) for at in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = _in_parts(
        [area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1], [898, 99, 9_999], f"{key}:social", back
    )
    made = let(moved, lambda m: F.concat(
        F.lpad((m[0] + F.when(m[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lit("-"),
        F.lpad((m[1] + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((m[2] + 1).cast("string"), 4, "0"),
    ))
    return F.when(valid, made).otherwise(text)


def _moved_day(day: Column, key: str, back: bool) -> Column:
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    a, b = DAY_PARTS
    pair = feistel(F.floor(number / b), number % b, F.lit(a), F.lit(b), f"{key}:date", back)
    made = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * b + p["b"]).cast("int")))
    return F.when(number.between(0, DAYS - 1), made)


def _iso(text: Column, key: str, back: bool) -> Column:
    return F.coalesce(let(text.try_cast("date"), lambda d: _moved_day(d, key, back)).cast("string"), text)


def _date(text: Column, key: str, back: bool) -> Column:
    """Month first with strokes and day first with points, or the other way where only that is a date."""
    def change(parts: Column) -> Column:
        stroke = F.contains(text, F.lit("/"))
        first, second = (F.lpad(parts[i], 2, "0") for i in (0, 1))
        padded = (F.char_length(parts[0]) == 2) & (F.char_length(parts[1]) == 2)
        as_date = lambda month, day: F.concat_ws("-", parts[2], month, day).try_cast("date")
        usual = F.when(stroke, as_date(first, second)).otherwise(as_date(second, first))
        other = F.when(stroke, as_date(second, first)).otherwise(as_date(first, second))

        def again(day: Column) -> Column:
            """Go on until the day can't be a month, so that it is read the same way."""
            walk = F.aggregate(
                F.sequence(F.lit(1), F.lit(64)), F.struct(day.alias("day"), F.lit(False).alias("done")),
                lambda x, _: F.when(x["done"], x).otherwise(let(
                    _moved_day(x["day"], key, back),
                    lambda d: F.struct(d.alias("day"), (F.dayofmonth(d) > 12).alias("done")),
                )),
            )
            return walk["day"]

        def shown(day: Column, month_first: Column) -> Column:
            part = lambda x: F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
            sign = F.when(stroke, "/").otherwise(".")
            month, number = part(F.month(day)), part(F.dayofmonth(day))
            return F.concat(
                F.when(month_first, month).otherwise(number), sign,
                F.when(month_first, number).otherwise(month), sign, F.year(day).cast("string"),
            )

        plain = let(usual, lambda d: let(_moved_day(d, key, back), lambda m: shown(m, stroke)))
        turned = let(other, lambda d: F.when(_moved_day(d, key, back).isNotNull(), let(again(d), lambda m: shown(m, ~stroke))))
        return F.when(usual.isNotNull(), F.coalesce(plain, text)).otherwise(F.coalesce(turned, text))

    return let(F.split(text, "[/.]"), change)


def _hashed(text: Column, key: str, size: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), text), 512)
    return F.left(F.repeat(digest, F.ceil(size / 128).cast("int")), size)


def _mail(text: Column, key: str, back: bool) -> Column:
    """The name becomes letters; the domain stays."""
    name = F.substring_index(text, "@", 1)
    hidden = F.translate(_hashed(name, f"{key}:mail", F.char_length(name)), "0123456789", "ghijklmnop")
    return text if back else F.concat(hidden, F.lit("@"), F.substring_index(text, "@", -1))


def _access(text: Column, key: str, back: bool) -> Column:
    return text if back else F.concat(F.lit("AKIA"), F.upper(_hashed(text, f"{key}:access", F.lit(16))))


def _secret(text: Column, key: str, back: bool) -> Column:
    value = F.regexp_extract(text, r"[\w/+-]+$", 0)
    return text if back else F.concat(
        F.left(text, F.char_length(text) - F.char_length(value)), _hashed(value, f"{key}:secret", F.char_length(value))
    )


KINDS = {
    "mail": _mail, "account": _account, "access": _access, "secret": _secret, "address": _address, "iso": _iso,
    "date": _date, "social": _social, "phone": _phone, "abroad": _abroad, "card": _card,
}


def _changed(found: Column, key: str, back: bool) -> Column:
    """The pseudonym of a text that one of the patterns found."""
    made = found
    for kind in reversed(KINDS):
        shape = found.rlike(f"^(?:{PATTERNS[kind]})$")
        made = F.when(shape, KINDS[kind](found, key, back)).otherwise(made)
    return made


def _valid(kind: str, text: Column) -> Column:
    if kind == "card":
        return let(_only_digits(text), lambda d: _luhn_digit(F.left(d, F.char_length(d) - 1)) == F.right(d, F.lit(1)))
    return let(F.replace(text, F.lit(" "), F.lit("")), lambda p: _check_digits(p) == F.substring(p, 3, 2))


def _longest_valid(kind: str, text: Column) -> Column:
    """The longest valid beginning that ends before a sign or at the end, or NULL."""
    size, least = F.char_length(text), 13 if kind == "card" else 15
    ends = F.filter(
        F.sequence(F.lit(least), F.greatest(size, F.lit(least))),
        lambda i: (i == size) | F.substring(text, i + 1, F.lit(1)).isin(" ", "-"),
    )
    begun = F.transform(ends, lambda i: F.substring(text, F.lit(1), i))
    whole = F.filter(begun, lambda x: x.rlike(f"^(?:{PATTERNS[kind]})$"))
    good = F.filter(whole, lambda x: _valid(kind, x))
    return F.try_element_at(good, F.lit(-1))


def _parted(text: Column, found: Column) -> Column:
    """The text with valid numbers parted from what made a match around them fail."""
    failed = lambda x: F.when(x.rlike(f"^(?:{PATTERNS['account']})$"), ~_valid("account", x)).otherwise(
        F.when(x.rlike(f"^(?:{PATTERNS['card']})$"), ~_valid("card", x)).otherwise(False)
    )

    def part(sound: Column) -> Column:
        made = text
        for kind in ("account", "card"):
            starts = F.regexp_extract_all(text, F.lit(ANYWHERE[kind]), F.lit(1))
            numbers = F.filter(F.transform(starts, partial(_longest_valid, kind)), lambda x: x.isNotNull())
            # What lies inside a sound match, or inside a longer number before it, is no number of its own.
            start = F.struct(made.alias("text"), F.array().cast("array<string>").alias("taken"))
            made = F.aggregate(numbers, start, lambda state, x: F.when(
                F.exists(F.concat(sound, state["taken"]), lambda y: F.contains(y, x)), state
            ).otherwise(F.struct(
                F.regexp_replace(
                    state["text"], F.concat(F.lit("(?<![A-Za-z0-9])"), x, F.lit("(?![A-Za-z0-9])")), F.concat(F.lit(PART), x, F.lit(PART))
                ).alias("text"),
                F.array_append(state["taken"], x).alias("taken"),
            )), lambda state: state["text"])
        return made

    sound = F.filter(found, lambda x: ~failed(x))
    return F.when(F.exists(found, failed) & ~F.contains(text, F.lit(PART)), let(sound, part)).otherwise(text)


def _replaced(df: DataFrame, text: str, key: str, back: bool, count: str | None = None) -> DataFrame:
    names = df.columns
    found, changed, parted = fresh(df, "_found"), fresh(df, "_changed"), fresh(df, "_parted")
    once = df.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(EVERY), F.lit(0)))
    split = once.withColumn(parted, _parted(F.col(text), F.col(found)))
    marked = split.withColumn(found, F.when(F.col(parted) == F.col(text), F.col(found)).otherwise(
        F.regexp_extract_all(F.col(parted), F.lit(EVERY), F.lit(0))
    ))
    any_found = F.size(found) > 0
    made = marked.withColumn(changed, F.when(any_found, F.transform(found, lambda x: _changed(x, key, back))))
    parts = F.split(F.col(parted), EVERY, -1)
    put = F.concat(
        F.element_at(parts, 1),
        F.array_join(F.zip_with(changed, F.slice(parts, F.lit(2), F.size(found)), lambda a, b: F.concat(a, b)), ""),
    )
    joined = F.when(F.col(parted) == F.col(text), put).otherwise(F.replace(put, F.lit(PART), F.lit("")))
    out = [F.when(any_found, joined).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in names if c != count]
    if count:
        differ = F.filter(F.zip_with(found, changed, lambda a, b: a != b), lambda x: x)
        out.append(F.when(any_found, F.size(differ)).otherwise(0).alias(count))
    return made.select(*out)


def pseudonymised(df: DataFrame, text: str = "text", key: str = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """The table with pseudonyms in column ``text``; ``count`` names a column for how many values were replaced."""
    return _replaced(df.withColumn(text, F.col(text).cast("string")), text, key, False, count)


def restored(df: DataFrame, text: str = "text", key: str = DEFAULT_KEY) -> DataFrame:
    """The table with permuted values turned back under the key."""
    return _replaced(df, text, key, back=True)
