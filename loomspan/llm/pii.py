"""Format-preserving pseudonyms for personal data, by built-in expressions only.

Numbers and dates are validated, then permuted within their own format by a keyed Feistel network:
phone numbers that can be dialled stay so, card numbers keep their length, grouping and a right
check digit, addresses stay addresses of their version, social security numbers and dates stay
valid. Being permutations, they keep different values different, and equal values equal across all
documents. Names of mail boxes and secrets have no number to permute; they become keyed digests in
their format, also linked across documents. What fails validation is left as it is.

Dates are ``Y-M-D`` with ``-``, ``/`` or ``.``, ``D.M.Y``, and ``M/D/Y`` with ``/`` or ``-``, or
``D/M/Y`` where only this is a date; each is a format of its own. A password's value runs to its
closing quote or, without quotes, to a space, quote, comma or semicolon; it has four signs, one of
them no letter, or eight. Other secrets have eight signs with a digit, or sixteen.

One pattern finds all kinds; a text is split at the matches and joined with their replacements.
Only texts with a digit, an at sign or a part of a secret's name are searched. No run has a longest
length: every repetition is possessive, so a pattern takes time in proportion to the text.

The key is ``spark.loomspan.pii.key``; who knows it can undo the permutations. The queries over test
tables use ``TEST_KEY`` where none is set, any other call must give one.

Defined results: a null text stays null and an empty one empty, with counts 0. Repeated rows give
the same result. Texts of any length are worked on whole. A null ``doc_id`` stays null. All other
columns pass through ``pseudonymised``, whatever their names; where the name for the kinds is taken,
underscores are added to it until it is free. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.words import table

TEST_KEY, SETTING, ROUNDS = "loomspan", "spark.loomspan.pii.key", 8

_BOX, _LABEL = r"\p{L}\p{N}._%+\-", r"[\p{L}\p{N}_]++(?:-++[\p{L}\p{N}_]++)*+"
#: The host has a label of two letters after a dot.
EMAIL = rf"(?<![{_BOX}])[{_BOX}]++@(?=[\p{{L}}\p{{N}}_\-.]*?\.\p{{L}}{{2}}){_LABEL}(?:\.{_LABEL})++"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer with one gap; one of three signs or more, one digit: neither a time of day nor a slice.
IP6 = rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?=[0-9A-Fa-f:]*?[0-9A-Fa-f]{{3}})(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:]|\.[0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
_YEAR, _PART = r"(?:19|20)[0-9]{2}", r"[0-9]{1,2}"
_ISO = rf"(?<![0-9\-]){_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9\-])"
DATE = (
    rf"(?:{_ISO}|(?<![0-9\-/])(?<![0-9]\.)(?:{_YEAR}/{_PART}/{_PART}|{_YEAR}\.{_PART}\.{_PART}"
    rf"|{_PART}/{_PART}/{_YEAR}|{_PART}\.{_PART}\.{_YEAR}|{_PART}-{_PART}-{_YEAR})(?![0-9\-/]|\.[0-9]))"
)
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
_IS = r"[\"']?[ \t]*+(?::=|=>|==|[=:])"
_PASSWORD = rf"(?<![A-Za-z])(?i:password|passwd|pwd|passphrase){_IS}"
_NAME = rf"(?<![A-Za-z])(?i:password|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key){_IS}"
#: A password's sign and a secret's, with the dots and the like before it: those that end a sentence are none of it.
_CORE, _SIGN = r"(?:[.:)\]}]*+[^\s\"',;.:)\]}])", r"(?:\.*+[A-Za-z0-9+/_\-=~])"
#: A value that is a mail or network address is left to these.
_ADDRESS = rf"[=~]*+(?:{EMAIL}|{IP}(?!{_SIGN}))"
#: The whole run of signs, and the host of a mail address that it runs into. What makes it a secret
#: is looked for before any further name: so chains of names are read once.
SECRET = (
    rf"{_PASSWORD}[ \t]*+(?:\"[^\"\n]++(?=\")|'[^'\n]++(?=')|[\"']?(?!{_ADDRESS})(?:{_CORE}{{8,}}+|(?=[A-Za-z]*+[^A-Za-z\s\"',;.]){_CORE}{{4,}}+))"
    rf"|{_NAME}[ \t]*+[\"']?(?!{_ADDRESS})(?=(?:(?!{_NAME})[A-Za-z+/_\-=~.])*+[0-9]|(?:(?!{_NAME}){_SIGN}){{16}})"
    rf"{_SIGN}{{8,}}+(?:@{_LABEL}(?:\.{_LABEL})++)?+"
)
_NAMED = r"^(.*?(?::=|=>|==|[=:])[ \t]*+[\"']?)(.*)$"

KINDS = ("email", "secret", "access_key", "ip", "card", "ssn", "date", "phone")
FIRST_DAY, DAYS, SIDE = "1900-01-01", 73_049, 271  # to 2099-12-31; 271 * 271 is the least square above


#: A phone number's parts: country, opening, area, middle, exchange, sign, line.
PHONE_PARTS = r"^(\+1[ .\-]?)?(\(?)([0-9]{3})(\)[ .\-]?|[ .\-])([0-9]{3})([ .\-])([0-9]{4})$"
#: Any codes after +1 or with the area in parentheses; without these only codes that can be dialled.
PHONE = r"(?<![0-9+])(?:\+1[ .\-]?\(?[0-9]{3}(?:\)[ .\-]?|[ .\-])[0-9]{3}|\([0-9]{3}\)[ .\-]?[0-9]{3}|(?:\(|(?=[0-9]{3}[.\-]))[2-9][0-9]{2}(?:\)[ .\-]?|[ .\-])[2-9][0-9]{2})[ .\-][0-9]{4}(?![0-9\-])"
#: Numbers of other countries, 8 to 15 digits, and those of +1 without signs between their parts.
PHONE_ABROAD = r"(?<![0-9+])\+(?:1[0-9]{10}|[2-9](?:[ .\-()]{0,3}[0-9]){7,14})(?![0-9])"
CARD = r"(?<![0-9\-])(?:[0-9]{13,19}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})(?![0-9\-])"
ANY = "|".join((EMAIL, SECRET, ACCESS_KEY, IP, IP6, CARD, SSN, DATE, PHONE, PHONE_ABROAD))


def key_of(spark: SparkSession, otherwise: str | None = None) -> str:
    """The session's key; ValueError where there is none, nor another given."""
    key = spark.conf.get(SETTING, None) or otherwise
    if not key:
        raise ValueError(f"set {SETTING}: pseudonyms of a known key can be undone")
    return key


def _digest(key: str, *parts: Column | str) -> Column:
    """Hex digest of the key and the parts."""
    cols = [F.lit(key), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)]
    return F.sha2(F.concat_ws("|", *cols), 256)


def feistel(value: Column, a: Column, b: Column, key: str, tweak: Column | str) -> Column:
    """A keyed permutation of 0..a*b-1 (a, b up to 10**9): halves take turns at adding a digest of the other.

    The rounds are a fold over their numbers, so that the expression doesn't double with each.
    """
    of = lambda i, x: F.conv(F.substring(_digest(key, tweak, i, x), 1, 15), 16, 10).cast("long")
    # whole division: a double couldn't hold 18 digits
    start = F.struct(F.call_function("div", value, b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s["l"] + of(i, s["r"]), a)).otherwise(s["l"])
        right = F.when(i % 2 == 1, F.pmod(s["r"] + of(i, s["l"]), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _digits(value: Column, n: int | Column) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _check_sum(digits: Column) -> Column:
    """Luhn's sum of a number, its last digit counting once."""
    back = F.split(F.reverse(digits), "")
    each = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _email(m: Column, key: str) -> Column:
    at = F.split(m, "@")
    return F.concat(F.lit("u"), F.substring(_digest(key, "box", F.lower(at[0])), 1, 12), F.lit("@d"), F.substring(_digest(key, "host", F.lower(at[1])), 1, 10), F.lit(".example"))


def _like(value: Column, key: str, tweak: str) -> Column:
    """A digest as long as the value."""
    h, n = _digest(key, tweak, value), F.char_length(value)
    return F.substr(F.repeat(h, F.ceil(n / 64).cast("int")), F.lit(1), n)


def _secret(m: Column, key: str) -> Column:
    return F.concat(F.regexp_extract(m, _NAMED, 1), _like(F.regexp_extract(m, _NAMED, 2), key, "secret"))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(F.substring(_digest(key, "access", m), 1, 16)))


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    octets = [o[k].cast("int") for k in range(4)]
    value = ((octets[0].cast("long") * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    out = _let(feistel(value, _long(65536), _long(65536), key, "ip"), lambda v: F.concat_ws(".", *((F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0))))
    return F.when(F.greatest(*octets) <= 255, out)


def _refilled(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in turn; all other signs stay."""
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    is_digit = lambda c: (c >= "0") & (c <= "9")
    step = lambda a, c: F.struct(F.concat(a["out"], F.when(is_digit(c), F.substr(digits, a["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (a["n"] + is_digit(c).cast("int")).alias("n"))
    return F.aggregate(F.split(m, ""), none, step, lambda a: a["out"])


def _permuted_digits(digits: Column, n: Column, key: str, tweak: str) -> Column:
    """Another number of ``n`` digits (2 to 18), leading zeros included."""
    ten = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k.cast("int"))).cast("long")
    return _digits(feistel(digits.cast("long"), ten(F.ceil(n / 2)), ten(F.floor(n / 2)), key, tweak), n)


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.char_length(d) - 1
        body = _permuted_digits(F.left(d, n), n, key, "card")
        check = lambda x: F.concat(x, F.pmod(F.lit(10) - _check_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string"))
        return F.when((_check_sum(d) % 10 == 0) & (d.cast("decimal(20,0)") > 0), _let(_let(body, check), lambda x: _refilled(m, x)))

    return _let(F.regexp_replace(m, r"[ \-]", ""), new)


def _phone_abroad(m: Column, key: str) -> Column:
    """The country stays, two digits or the one of +1 and +7; the number after it is permuted."""

    def new(d: Column) -> Column:
        kept = F.when(F.left(d, F.lit(1)).isin("1", "7"), 1).otherwise(2)
        n = F.char_length(d) - kept
        return _let(F.concat(F.left(d, kept), _permuted_digits(F.right(d, n), n, key, "abroad")), lambda x: _refilled(m, x))

    return _let(F.regexp_replace(m, r"[^0-9]", ""), new)


def _ip6(m: Column, key: str) -> Column:
    """128 bits permuted, written as eight whole groups."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    sides = F.split(m, "::")
    left, right = groups(sides[0]), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), right)
    digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
    of = lambda i, x: F.conv(F.substring(_digest(key, "ip6", i, x), 1, 16), 16, -10).cast("long")

    def step(s: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, s["l"].bitwiseXOR(of(i, s["r"]))).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, s["r"].bitwiseXOR(of(i, s["l"]))).otherwise(s["r"]).alias("r"))

    shown = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(half(1).alias("l"), half(17).alias("r")), step, lambda s: F.concat(shown(s["l"]), shown(s["r"])))
    return F.when((n == 8) & (F.size(sides) == 1) | (n < 8) & (F.size(sides) == 2), _let(out, lambda x: F.concat_ws(":", *(F.substring(x, 4 * k + 1, 4) for k in range(8)))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, k, n).cast("int") for k, n in ((1, 3), (5, 2), (8, 4)))
    fine = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    value = ((area - 1 - F.when(area > 666, 1).otherwise(0)).cast("long") * 99 + group - 1) * 9999 + serial - 1

    def shown(v: Column) -> Column:
        front = F.floor(v / 9999).cast("long")
        number = F.floor(front / 99).cast("int") + 1
        number = number + F.when(number >= 666, 1).otherwise(0)
        return F.concat(_digits(number, 3), F.lit("-"), _digits(front % 99 + 1, 2), F.lit("-"), _digits(v % 9999 + 1, 4))

    return F.when(fine, _let(feistel(value, _long(898 * 99), _long(9999), key, "ssn"), shown))


def _date(m: Column, key: str) -> Column:
    """Days permuted within 1900-2099: the square above is walked until a day comes out."""
    first = F.lit(FIRST_DAY).cast("date")
    once = lambda v: feistel(v, _long(SIDE), _long(SIDE), key, "date")
    # the square has 392 numbers that are no day, so no walk is longer
    walk = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(SIDE * SIDE - DAYS)), once(v), lambda x, i: F.when(x < DAYS, x).otherwise(once(x)))
    part = F.split(m, r"[-/.]")
    sign = F.regexp_extract(m, r"[-/.]", 0)
    order = F.when(F.char_length(part[0]) == 4, "ymd").when((sign == ".") | (part[0].cast("int") > 12), "dmy").otherwise("mdy")

    def new(o: Column) -> Column:
        at = lambda *k: F.concat_ws("-", *(F.lpad(part[i], 4 if i == k[0] else 2, "0") for i in k))
        text = F.when(o == "ymd", at(0, 1, 2)).when(o == "dmy", at(2, 1, 0)).otherwise(at(2, 0, 1))
        day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
        shown = lambda d: F.when(o == "ymd", F.date_format(d, "yyyy-MM-dd")).when(o == "dmy", F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "MM-dd-yyyy"))
        found = _let(walk(F.date_diff(day, first).cast("long")), lambda v: F.replace(shown(F.date_add(first, v.cast("int"))), F.lit("-"), sign))
        return F.when(day.isNotNull(), found)

    return _let(order, new)


def _phone(m: Column, key: str) -> Column:
    """Codes of 200 and more are permuted among themselves, so they stay dialable; all others are too, apart from these."""
    part = lambda k: F.regexp_extract(m, PHONE_PARTS, k)
    codes = F.struct(part(3).cast("long").alias("area"), part(5).cast("long").alias("exchange"), part(7).cast("long").alias("line"))

    def new(p: Column) -> Column:
        dialable = (p["area"] >= 200) & (p["exchange"] >= 200)
        # 800 * 800 pairs of codes; of the others 200 * 1000 by their area and 800 * 200 by their exchange
        front = F.when(dialable, (p["area"] - 200) * 800 + p["exchange"] - 200).when(p["area"] < 200, p["area"] * 1000 + p["exchange"]).otherwise((p["area"] - 200) * 200 + p["exchange"] + 200_000)
        value = F.struct(dialable.alias("dialable"), F.when(dialable, 80000).otherwise(60000).cast("long").alias("side"), (front * 10000 + p["line"]).alias("v"))
        return _let(value, lambda x: _let(F.struct(x["dialable"], feistel(x["v"], x["side"], x["side"], key, F.when(x["dialable"], "phone").otherwise("phone code")).alias("v")), shown))

    def shown(x: Column) -> Column:
        front = F.floor(x["v"] / 10000).cast("long")
        by_exchange = front - 200_000
        area = F.when(x["dialable"], F.floor(front / 800) + 200).when(by_exchange < 0, F.floor(front / 1000)).otherwise(F.floor(by_exchange / 200) + 200)
        exchange = F.when(x["dialable"], front % 800 + 200).when(by_exchange < 0, front % 1000).otherwise(by_exchange % 200)
        return F.concat(part(1), part(2), _digits(area, 3), part(4), _digits(exchange, 3), part(6), _digits(x["v"] % 10000, 4))

    return _let(codes, new)


#: Of each kind the patterns that tell a match, and what makes its pseudonym. A secret is told by its name.
_MAKE = (
    ("secret", _NAME, _secret), ("email", f"{EMAIL}$", _email), ("access_key", f"{ACCESS_KEY}$", _access_key), ("ip", f"{IP}$", _ip), ("ip", f"{IP6}$", _ip6), ("card", f"{CARD}$", _card),
    ("ssn", f"{SSN}$", _ssn), ("date", f"{DATE}$", _date), ("phone", f"{PHONE}$", _phone), ("phone", f"{PHONE_ABROAD}$", _phone_abroad),
)


def _replaced(m: Column, key: str) -> Column:
    """struct(kind, new): null kind where the match isn't valid."""
    out, none = None, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
    found = lambda kind: lambda x: F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), x.alias("new"))).otherwise(none)
    for kind, pattern, make in _MAKE:
        value, cond = _let(make(m, key), found(kind)), m.rlike(f"^(?:{pattern})")
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(none)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", kinds_as: str | None = "pii") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and, if named, a column of the kinds found, in order."""
    while kinds_as in docs.columns:
        kinds_as += "_"
    # the input's columns as one, so that no name can meet one of ours
    df = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"))
    # a licence's year or version passes this too; the search proper decides
    found = F.regexp_extract_all("t", F.lit(ANY), F.lit(0))
    df = df.withColumn("m", F.when(F.col("t").rlike("[0-9@]|AKIA|(?i:passw|passph|pwd|secret|token|key)"), found))
    df = df.withColumn("m", F.when(F.size("m") > 0, F.col("m"))).withColumn("r", F.transform("m", lambda m: _replaced(m, key)))
    parts = F.split("t", ANY, -1)
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("r"), i)["new"], F.lit("")))), "")
    df = df.select(F.col("row").withField(f"`{text}`", F.when(F.col("r").isNotNull(), joined).otherwise(F.col("t"))).alias("row"), "r")
    kinds = F.coalesce(F.filter(F.transform("r", lambda r: r["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return df.select("row.*", *([kinds.alias(kinds_as)] if kinds_as else []))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark, TEST_KEY))
    count = lambda kind: F.size(F.filter("pii", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *(count(k) for k in KINDS))
