"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their format's test are permuted, under a key, among the values of that
format: a Feistel network over the value's two halves, whose sizes multiply to the number of valid
values, so each result is valid. A permutation gives equal values equal pseudonyms in all documents,
and different values different ones. E-mail names, which have no fixed alphabet, get a keyed digest instead.
Everything is built of column functions.

Forms that are found, besides e-mail and IPv4 addresses and social security numbers (ddd-dd-dddd):
phone numbers with a country code, as (ddd) ddd-dddd, or as ddd-ddd-dddd or
ddd.ddd.dddd; dates as yyyy-MM-dd; cards of 13 to 19 digits that are joined, in groups of four or in
groups of 4, 6 and 5. Other forms stay in clear: dates as 03/14/1985, 14.03.1985 or with month names,
national phone numbers with spaces alone (212 555 0123), IPv6 addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
#: The patterns of what is looked for, tried in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-zÀ-ÿ0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = (
    r"(?<![A-Za-z0-9.+-])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)[0-9]{4}"
    r"|\+[0-9]{1,3}[ .-][0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){0,2})(?![0-9])(?![.-][0-9])"
)
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})(?![0-9])"
KINDS = ("email", "phone", "ip", "date", "ssn", "card")
ANY = "|".join((EMAIL, PHONE, IP, DATE, SSN, CARD))
FIRST_DAY = "0001-01-01"
#: Days up to 1899, from 1900 to 2099 and after that: each date stays among its own. (first, low, high), with low * high days.
DAYS = ((0, 35, 19_817), (693_595, 17, 4_297), (766_644, 15, 192_361))
#: Social security numbers: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _round(key: str, *parts: Column) -> Column:
    """48 keyed bits."""
    mixed = F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(mixed, 1, 12), 16, 10).cast("long")


def permuted(value: Column, low: Column, high: Column, key: str) -> Column:
    """A keyed permutation of 0 .. low * high - 1, for bases under 2 ** 31.

    The value is high digit and low digit in mixed radix; rounds add a keyed function of the one to
    the other in turn, each of which can be undone.
    """
    start = F.struct(F.floor(value / high).cast("long").alias("a"), F.pmod(value, high).alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda s, i: F.when(
            i % 2 == 0, F.struct(F.pmod(s["a"] + _round(key, i, high, s["b"]), low).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + _round(key, i, low, s["a"]), high).alias("b"))),
    )
    return _let(done, lambda s: s["a"] * high + s["b"])


def permuted_day(day: Column, key: str) -> Column:
    """A day since FIRST_DAY, permuted among the days of its range."""
    inside = [_let(day - first, lambda v: first + permuted(v, F.lit(low).cast("long"), F.lit(high).cast("long"), f"{key}:{first}")) for first, low, high in DAYS]  # noqa: B023
    return F.when(day < DAYS[1][0], inside[0]).when(day < DAYS[2][0], inside[1]).otherwise(inside[2])


def permuted_digits(digits: Column, key: str) -> Column:
    """A string of 2 to 18 digits permuted among the strings of its length."""
    n = F.char_length(digits)
    left = F.floor(n / 2).cast("int")
    low, high = F.pow(F.lit(10), left).cast("long"), F.pow(F.lit(10), n - left).cast("long")
    start = F.struct(F.substring(digits, F.lit(1), left).cast("long").alias("a"), F.substring(digits, left + 1, n - left).cast("long").alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda s, i: F.when(
            i % 2 == 0, F.struct(F.pmod(s["a"] + _round(key, i, n, s["b"]), low).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + _round(key, i, n, s["a"]), high).alias("b"))),
    )
    pad = lambda x, width: F.lpad(x.cast("string"), width, "0")
    return _let(done, lambda s: F.concat(pad(s["a"], left), pad(s["b"], n - left)))


def is_ssn(digits: Column) -> Column:
    return digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def permuted_ssn(digits: Column, key: str) -> Column:
    """Nine digits that are a valid number, permuted among the valid ones, by their rank among these."""
    part = lambda at, n: F.substring(digits, F.lit(at), F.lit(n)).cast("long")
    area = part(1, 3) - F.when(part(1, 3) < 666, 1).otherwise(2)
    rank = (area * GROUPS + part(4, 2) - 1) * SERIALS + part(6, 4) - 1
    pad = lambda x, width: F.lpad(x.cast("string"), width, "0")

    def written_out(v: Column) -> Column:
        place = F.floor(v / (GROUPS * SERIALS))
        group = F.pmod(F.floor(v / SERIALS), F.lit(GROUPS)) + 1
        return F.concat(pad(place + F.when(place < 665, 1).otherwise(2), 3), pad(group, 2), pad(F.pmod(v, F.lit(SERIALS)) + 1, 4))

    return _let(permuted(rank, F.lit(AREAS * GROUPS).cast("long"), F.lit(SERIALS).cast("long"), key), written_out)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counting once."""
    return F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)),
        F.lit(0),
        lambda total, i: total
        + _let(
            F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)),
        ),
    )


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by those of ``digits`` in turn."""
    filled = F.aggregate(
        F.split(form, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return _let(filled, lambda s: s["out"])


def _day(text: Column) -> Column:
    return F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def kind_of(match: Column) -> Column:
    """The kind of a match of ``ANY``; null where the value is not valid for its format."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    octets = F.filter(F.split(match, r"\."), lambda x: x.cast("int") > 255)
    return (
        F.when(match.contains("@"), F.lit("email"))
        .when(match.rlike(f"^(?:{PHONE})$"), F.lit("phone"))
        .when(match.rlike(r"^[0-9]+\.") & (F.size(octets) == 0), F.lit("ip"))
        .when(match.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(_day(match) >= 0, F.lit("date")))
        .when(match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(is_ssn(digits), F.lit("ssn")))
        .when(match.contains("."), F.lit(None).cast("string"))
        .when(luhn_sum(digits) % 10 == 0, F.lit("card"))
    )


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of that kind, in the value's own format."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    body = F.substring(digits, F.lit(1), F.char_length(digits) - 1)
    card = _let(
        permuted_digits(body, f"{key}:card"),
        lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")),
    )
    octets = F.split(match, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda total, x: total * 256 + x.cast("long"))
    ip = _let(
        permuted(number, F.lit(1 << 16).cast("long"), F.lit(1 << 16).cast("long"), f"{key}:ip"),
        lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
    )
    # the country code stays
    country = F.regexp_extract(match, r"^\+[0-9]{1,3}(?![0-9])", 0)
    rest = F.substring(match, F.char_length(country) + 1, F.char_length(match))
    phone = F.concat(country, _refill(rest, permuted_digits(F.regexp_replace(rest, "[^0-9]", ""), f"{key}:phone")))
    day = permuted_day(_day(match), f"{key}:date")
    name = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(match)), 256)
    return (
        F.when(kind == "email", F.concat(F.lit("u"), F.substring(name, 1, 16), F.lit("@"), F.substring_index(match, "@", -1)))
        .when(kind == "phone", phone)
        .when(kind == "ip", ip)
        .when(kind == "date", F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")), "yyyy-MM-dd"))
        .when(kind == "ssn", _refill(match, permuted_ssn(digits, f"{key}:ssn")))
        .when(kind == "card", _refill(match, card))
        .otherwise(match)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``record`` (a struct of all columns), ``text`` with pseudonyms, and ``found``: (kind, pseudonym) of each value.

    A null text stays null and has nothing found; empty texts stay empty; what fails its format's
    test stays as it is. The rest of a text is left alone, whatever its length. Repeated rows get
    the same result; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    named = F.transform(
        F.regexp_extract_all(body, F.lit(f"({ANY})"), 0),
        lambda m: _let(
            kind_of(m), lambda kind: F.struct(kind.alias("kind"), F.when(kind.isNull(), m).otherwise(pseudonym(m, kind, key)).alias("value"))
        ),
    )
    pieces = F.split(body, ANY, -1)
    woven = _let(
        named,
        lambda xs: F.struct(
            F.filter(xs, lambda x: x["kind"].isNotNull()).alias("found"),
            F.array_join(F.zip_with(pieces, xs, lambda p, x: F.concat(p, F.coalesce(x["value"], F.lit("")))), "").alias("text"),
        ),
    )
    has_any = body.rlike(ANY)
    done = docs.select(
        F.struct("*").alias("record"),
        F.explode(
            F.array(
                F.when(has_any, woven).otherwise(
                    F.struct(F.array().cast("array<struct<kind:string,value:string>>").alias("found"), F.col(text).alias("text"))
                )
            )
        ).alias("made"),
    )
    return done.select("record", "made.text", "made.found")


def pseudonymised_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op7_feistel_pseudonyms``: every document with pseudonyms in its text, and how many of each kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = pseudonymise(docs.select("doc_id", "text"), key="a key of the corpus")
    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select(F.col("record.doc_id").alias("doc_id"), *map(count, KINDS), "text")
