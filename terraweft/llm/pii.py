"""Format-preserving Feistel pseudonyms, as native column expressions.

Validated numbers (payment cards by their check digit, telephone numbers by area and exchange, IPv4 addresses by octet)
and dates (by the calendar) are permuted within their format under a key: a Feistel network whose halves are residues,
with rounds that add a keyed SHA-256 of the other half, so that the permutation covers exactly the format's values.
Equal values get equal pseudonyms in every document; distinct values of one format stay distinct. Numbers that fail
their validation are permuted among the numbers of their length. Mail addresses and access keys and tokens that look like
AKIA keys or long hexadecimal numbers, which have no numeric format, become a keyed tag of their kind.

The key is the caller's; it has no default. session_key() takes it from the session's settings (KEY_SETTING, which Spark
redacts by its name); where that is unset it draws a random one for the session, so that pseudonyms agree within a session
but with no other. The key joins the rows as a column of a table of one row: no plan, event log or page shows it.

Defined results: a null text stays null; an empty one stays empty; text outside the findings is unchanged; repeated
rows are treated alike; other columns pass through, except that a column named as the kinds' is replaced.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The session's setting that names the key.
KEY_SETTING = "spark.terraweft.pii.secret"
# What each kind looks like.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"\bAKIA[0-9A-Z]{12,16}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{18,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[0-9A-F]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{18,}(?![0-9A-Za-z])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|(?<![0-9A-Za-z.])[0-9]{9,19}(?![0-9A-Za-z])"
ANY = "|".join((MAIL, SECRET, DATE, ADDRESS, PHONE, IDENTITY, CARD))


def _keyed(key: Column | str, *parts: Column | str) -> Column:
    """A keyed 60-bit number."""
    said = key if isinstance(key, Column) else F.lit(key)
    text = F.concat_ws("|", said, *(p if isinstance(p, Column) else F.lit(p) for p in parts), said)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, tweak: Column | str) -> Column:
    """struct(l, r): a keyed permutation of the pairs of a residue below a and one below b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(acc: Column, k: Column) -> Column:
        even = k % 2 == 0
        other = F.when(even, acc["r"]).otherwise(acc["l"])
        add = _keyed(key, tweak, k.cast("string"), other.cast("string"))
        return F.struct(
            F.when(even, F.pmod(acc["l"] + F.pmod(add, a.cast("long")), a.cast("long"))).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(add, b.cast("long")), b.cast("long"))).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _bind(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def permuted_digits(digits: Column, key: Column, tweak: Column | str) -> Column:
    """Another string of as many digits (up to 19), under the key."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    lo, hi = digits.substr(F.lit(1), half), digits.substr(half + 1, rest)
    a, b = F.expr("1L") * F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), rest).cast("long")
    # A half of no digits is the only residue below 1.
    left = F.when(half == 0, F.lit(0)).otherwise(lo.cast("long"))
    return _bind(
        feistel(left, hi.cast("long"), a, b, key, F.concat(F.lit("digits"), F.length(digits).cast("string"), F.lit(tweak) if isinstance(tweak, str) else tweak)),
        lambda p: F.when(half == 0, F.lpad(p["r"].cast("string"), rest, "0")).otherwise(F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0"))),
    )


def luhn_digit(payload: Column) -> Column:
    """The check digit that completes a payload of digits."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(payload)),
        F.lit(0),
        lambda acc, i: acc + _bind(payload.substr(F.length(payload) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def laid_out(original: Column, digits: Column) -> Column:
    """original with its digits replaced, in order."""
    out = F.aggregate(
        F.sequence(F.lit(1), F.length(original)),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
        lambda acc, i: _bind(
            original.substr(i, F.lit(1)),
            lambda c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["text"], digits.substr(acc["at"], F.lit(1))).alias("text"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["text"], c).alias("text"), acc["at"].alias("at"))),
        ),
    )
    return out["text"]


def card(x: Column, key: Column) -> Column:
    """Numbers with a valid check digit get another valid one; others another number of their length."""

    def replaced(d: Column) -> Column:
        payload = d.substr(F.lit(1), F.length(d) - 1)
        valid = (F.length(d) >= 12) & (luhn_digit(payload) == d.substr(F.length(d), F.lit(1)))
        new = F.when(valid, _bind(permuted_digits(payload, key, "card"), lambda p: F.concat(p, luhn_digit(p)))).otherwise(permuted_digits(d, key, "number"))
        return _bind(new, lambda n: F.when(F.length(x) == F.length(d), n).otherwise(laid_out(x, n)))

    return _bind(F.regexp_replace(x, "[^0-9]", ""), replaced)


def phone(x: Column, key: Column) -> Column:
    """Area, exchange and line are permuted; the country code stays. Valid ones (area and exchange from 200) stay valid."""

    def replaced(d: Column) -> Column:
        ten = d.substr(F.length(d) - 9, F.lit(10))
        area, exchange, line = (ten.substr(F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
        valid = (area >= 200) & (exchange >= 200)
        good = _bind(
            feistel(area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000), key, "phone"),
            lambda p: F.concat((p["l"] + 200).cast("string"), (F.floor(p["r"] / 10000) + 200).cast("string"), F.lpad((p["r"] % 10000).cast("string"), 4, "0")),
        )
        new = F.when(valid, good).otherwise(permuted_digits(ten, key, "phone"))
        return laid_out(x, F.concat(d.substr(F.lit(1), F.length(d) - 10), new))

    return _bind(F.regexp_replace(x, "[^0-9]", ""), replaced)


def address(x: Column, key: Column) -> Column:
    """An IPv4 address for another; four numbers that are none are permuted digit by digit."""

    def replaced(o: Column) -> Column:
        part = [o[i].cast("int") for i in range(4)]
        valid = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256)
        good = _bind(
            feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "address"),
            lambda p: F.concat_ws(".", *(F.pmod(F.floor(p[side] / scale), F.lit(256)).cast("string") for side in ("l", "r") for scale in (256, 1))),
        )
        return F.when(valid, good).otherwise(laid_out(x, permuted_digits(F.regexp_replace(x, "[^0-9]", ""), key, "address")))

    return _bind(F.split(x, r"\."), replaced)


#: Days of the Gregorian cycle of 400 years, as a product of two factors.
CYCLE, CYCLE_A, CYCLE_B = 146_097, 189, 773


def date(x: Column, key: Column) -> Column:
    """A calendar day for another of its 400-year cycle; what is no calendar day is permuted digit by digit."""

    def replaced(day: Column) -> Column:
        number = F.datediff(day, F.lit("0001-01-01").cast("date"))
        within = F.pmod(number, F.lit(CYCLE))
        moved = _bind(
            feistel(F.floor(within / CYCLE_B), within % CYCLE_B, F.lit(CYCLE_A), F.lit(CYCLE_B), key, "date"),
            lambda p: F.date_add(F.lit("0001-01-01").cast("date"), (number - within + p["l"] * CYCLE_B + p["r"]).cast("int")),
        )
        # The last cycle that four digits can write is cut short by the year 9999: there a day stays within its digits.
        new = F.when(F.year(day) <= 9600, F.lpad(moved.cast("string"), 10, "0"))
        return F.coalesce(new, laid_out(x, permuted_digits(F.regexp_replace(x, "[^0-9]", ""), key, "date")))

    return _bind(F.try_to_date(x, "yyyy-MM-dd"), replaced)


def tag(kind: str, x: Column, key: Column) -> Column:
    return F.concat(F.lit(f"<{kind}-"), F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), F.lower(x), key), 256), 1, 12), F.lit(">"))


def _is(pattern: str, x: Column) -> Column:
    return x.rlike(rf"^(?:{pattern})$")


def kind_of(x: Column) -> Column:
    kinds = (("mail", MAIL), ("secret", SECRET), ("date", DATE), ("address", ADDRESS), ("phone", PHONE), ("identity", IDENTITY))
    out = None
    for name, pattern in kinds:
        out = F.when(_is(pattern, x), name) if out is None else out.when(_is(pattern, x), name)
    return out.otherwise("number")


def pseudonym(x: Column, key: Column) -> Column:
    return _bind(
        kind_of(x),
        lambda k: F.when(k == "mail", tag("mail", x, key)).when(k == "secret", tag("secret", x, key)).when(k == "date", date(x, key)).when(k == "address", address(x, key)).when(k == "phone", phone(x, key)).when(k == "identity", laid_out(x, permuted_digits(F.regexp_replace(x, "[^0-9]", ""), key, "identity"))).otherwise(card(x, key)),
    )


def session_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def with_pseudonyms(docs: DataFrame, key: str, kinds: str | None = "_pii") -> DataFrame:
    """docs with the findings in text replaced, and what kinds they are of in a column (an array; none where kinds is None)."""
    if not key:
        raise ValueError("pseudonyms need a key")
    # Every kind has a digit, an @ or AKIA; a text without them is passed as it is.
    some = F.col("text").rlike("[0-9@]|AKIA")
    found = F.when(some, F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    pieces = F.when(F.size("_found") > 0, F.split("text", ANY, -1))
    joined = F.when(F.size("_found") > 0, F.concat(F.array_join(F.zip_with(F.slice("_pieces", 1, F.size("_found")), "_new", lambda p, n: F.concat(p, n)), ""), F.element_at("_pieces", -1))).otherwise(F.col("text"))
    held = docs.select(F.struct(*docs.columns).alias("_row"), "text").withColumn("_found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("_pieces", pieces)
    own = F.broadcast(docs.sparkSession.createDataFrame([(0, key)], "_one int, _key string"))  # one row
    held = held.withColumn("_one", F.lit(0)).join(own, "_one")
    held = held.withColumn("_new", F.transform("_found", lambda x: pseudonym(x, F.col("_key")))).withColumn("_text", joined)
    out = [(F.col("_text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns if c != kinds]
    return held.select(*out, *([F.transform("_found", kind_of).alias(kinds)] if kinds else []))
