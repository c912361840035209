"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions only.

Candidates are found by one pattern; each is validated by its own rule and then
permuted within its format by a keyed Feistel network, whose round function is
SHA-256. Equal values get equal pseudonyms in every document, different values
of one kind and format get different ones, and who has the key can undo it.

kind     validated by                     permuted
card     Luhn sum, 13 to 19 digits        all digits but the last, which is the new check digit
iban     modulo 97, check digits 02-98    letters and digits of the account; new check digits
ssn      area, group and serial ranges    over all valid numbers
phone    7 to 15 digits in phone form     the digits behind the country code, written with a separator or without
ip       four octets up to 255            over all addresses
date     calendar date, years 1800-2199   over the days of these 400 years that are up to the 12th, or those after it
email    form                             letters and digits of the local part and of the domain but its last label
secret   known prefix, or keyword before   letters and digits of the value

A value behind ``token``, ``password``, ``secret``, ``api_key`` and the like is a secret if it has 16
characters or more and is hexadecimal, or of the base64 alphabets with a letter and a digit.

Dates are found as 2024-03-05 (a time may follow, as in 2024-03-05T10:00:00Z), 2024/3/5, 5-3-2024 and 5.3.2024
(day first) and 3/5/2024 (month first if it can be), with or without leading zeros but in the first form.
As 3/5/2024 is read as the month first and 27/5/2024 cannot be, days up to the 12th and later ones are permuted
apart: the pseudonym is read as its value was, in every form, and no two values get one.
Left in clear: dashes with the month first (03-25-2024), 2024-3-5, 2024.03.05, 20240305, years of two digits, names of months.

Other values left in clear: IPv6 addresses, web tokens behind ``Bearer``, keys with a prefix other than AKIA and no keyword, keyed values of
letters only, and passwords with signs beside ``+ / _ -``. One mailbox in two cases of letters gets two pseudonyms.

What does not validate stays as it is, as do signs, separators and the case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _E
KEYWORDS = "token|password|passwd|secret|api_key|apikey"
ACCESS = _B + r"AKIA[0-9A-Z]{16}" + _E
SECRET = (
    r"(?<![0-9A-Za-z+/_\-])(?=[A-Za-z0-9+/_\-]{16})(?<=(?i:" + KEYWORDS + r")\s{0,2}[=:]\s{0,2}[\"']?)"
    r"(?:[0-9a-fA-F]{16,}+" + _E + r"|(?=[A-Za-z+/_\-]{0,256}[0-9])(?=[0-9+/_\-]{0,256}[A-Za-z])[A-Za-z0-9+/_\-]{16,}+={0,2}(?![0-9A-Za-z=]))"
)
IBAN = _B + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _E
DATE = _B + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[Tt][0-9]{2})|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})" + _E + ")"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])"
SSN = _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E
CARD = _B + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})" + _E
PHONE = r"(?<![0-9A-Za-z+])(?:\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\(?[0-9]{3}\)?[ .\-][0-9]{3}[.\-][0-9]{4}|\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,5})(?![0-9A-Za-z]|\.[0-9])"
# The country codes of telephone numbers of one and of two digits; all others have three.
COUNTRY = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
KINDS = {"email": EMAIL, "access": ACCESS, "secret": SECRET, "iban": IBAN, "date": DATE, "ip": IP, "ssn": SSN, "card": CARD, "phone": PHONE}
PATTERN = "|".join(KINDS.values())
#: The same, with a group for what stands behind a keyword.
_MARKED = "|".join(f"({p})" if k == "secret" else p for k, p in KINDS.items())

#: What every text with a value of some kind has.
GATE = f"[0-9@]|AKIA|(?i:{KEYWORDS})"

FIRST_YEAR, YEARS = 1800, 400
#: Days up to the 12th of a month in these years, and the other days (of the Gregorian cycle of 146,097).
EARLY, LATE = (240, 240), (9, 9833)
#: Days after the 12th in front of each month of a year, in February's place and later one more in a leap year.
LATE_BEFORE = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)


def _long(c: Column | int) -> Column:
    return c.cast("long") if isinstance(c, Column) else F.lit(c).cast("long")


def _hash(key: Column, tag: Column, i: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws(":", key, tag, i.cast("string"), x.cast("string")).cast("binary"), 256)


def feistel(a: Column, b: Column, m: Column | int, n: Column | int, tag: Column, key: Column) -> Column:
    """A keyed permutation of the pairs (a, b) with 0 <= a < m, 0 <= b < n, as a struct."""

    def step(pair: Column, i: Column) -> Column:
        number = lambda x: F.conv(F.substring(_hash(key, tag, i, x), 1, 15), 16, 10).cast("long")
        left = F.struct(F.pmod(pair["a"] + number(pair["b"]), _long(m)).alias("a"), pair["b"].alias("b"))
        right = F.struct(pair["a"].alias("a"), F.pmod(pair["b"] + number(pair["a"]), _long(n)).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(a).alias("a"), _long(b).alias("b")), step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permute_digits(d: Column, tag: Column, key: Column) -> Column:
    """A keyed permutation of the digit strings (at most 36 digits) of each length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    v = n - u
    number = lambda s: F.coalesce(s.try_cast("long"), F.lit(0))
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = feistel(number(F.substr(d, F.lit(1), u)), number(F.substr(d, u + 1, v)), ten(u), ten(v), F.concat(tag, n.cast("string")), key)
    joined = F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["a"].cast("string"), u, F.lit("0")), F.lpad(p["b"].cast("string"), v, F.lit("0"))))
    return joined[0]


def permute_characters(s: Column, tag: Column, key: Column, letters: int = 26) -> Column:
    """A keyed permutation of strings that keeps the class (digit, capital, small letter, other) of each character.

    A half of more than 32 characters, which one hash does not move, is moved in pieces with a hash each.
    """
    n = F.length(s)
    u = F.floor(n / 2).cast("int")

    def shift(half: Column, stream: Column) -> Column:
        def one(i: Column) -> Column:
            code = F.ascii(F.substr(half, i, F.lit(1)))
            move = F.conv(F.substr(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
            turned = lambda first, size: F.char(first + F.pmod(code - first + move, F.lit(size)))
            return F.when(code.between(48, 57), turned(48, 10)).when(code.between(65, 90), turned(65, letters)).when(code.between(97, 122), turned(97, letters)).otherwise(F.substr(half, i, F.lit(1)))

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))

    def moved(half: Column, i: Column, other: Column) -> Column:
        piece = lambda h, j: shift(F.substr(half, 32 * j + 1, F.lit(32)), _hash(key, F.concat(tag, F.lit("+"), j.cast("string")), i, h))
        pieces = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(half) - 1) / 32).cast("int")), lambda j: piece(h, j)), "")
        one = _hash(key, tag, i, other)
        return F.when(F.length(half) <= 32, shift(half, one)).otherwise(_with(one, pieces))

    def step(pair: Column, i: Column) -> Column:
        left = F.struct(moved(pair["a"], i, pair["b"]).alias("a"), pair["b"].alias("b"))
        right = F.struct(pair["a"].alias("a"), moved(pair["b"], i, pair["a"]).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(F.substr(s, F.lit(1), u).alias("a"), F.substr(s, u + 1, n - u).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda p: F.concat(p["a"], p["b"]))


def _fill(form: Column, values: Column, kind: str = "[0-9]") -> Column:
    """form with its characters of one kind replaced, in order, by the characters of values."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        hit = c.rlike(kind)
        return F.struct(F.concat(acc["s"], F.when(hit, F.substr(values, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["s"])


def luhn_sum(d: Column, doubled: int) -> Column:
    """The Luhn sum of a digit string; the digits at places of this parity from the right (from 0) count double."""

    def step(total: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == doubled, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step)


def mod97(alnum: Column) -> Column:
    """The number that letters (A is 10) and digits spell, modulo 97."""

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(alnum, ""), F.lit(0), step)


def _with(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _card(m: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), F.lit("card"), key)
        return _with(body, lambda p: _fill(m, F.concat(p, F.pmod(-luhn_sum(p, 0), F.lit(10)).cast("string"))))

    return _with(_digits(m), lambda d: F.when(luhn_sum(d, 1) % 10 == 0, new(d)))


def _iban(m: Column, key: Column) -> Column:
    def new(s: Column) -> Column:
        country, account = F.substring(s, 1, 2), F.substr(s, F.lit(5), F.length(s))
        other = permute_characters(account, F.concat(F.lit("iban"), country), key)
        return _with(other, lambda a: _fill(m, F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a), "[0-9A-Z]"))

    return _with(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.when(F.length(s).between(15, 34) & F.substring(s, 3, 2).between("02", "98") & (mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1), new(s)))


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    pair = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, F.lit("ssn"), key)

    def show(p: Column) -> Column:
        at = F.floor(p["a"] / 99)
        return F.format_string("%03d-%02d-%04d", F.when(at < 665, at + 1).otherwise(at + 2), p["a"] % 99 + 1, p["b"] + 1)

    return F.when(good, _with(pair, show))


def _phone(m: Column, key: Column) -> Column:
    code = F.regexp_extract(m, COUNTRY, 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    d = _digits(rest)
    return F.when(F.length(_digits(m)).between(7, 15), F.concat(code, _fill(rest, permute_digits(d, F.lit("phone"), key))))


def _ip(m: Column, key: Column) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, F.lit("ip"), key)
    show = lambda p: F.concat_ws(".", *(F.floor(x / 256).cast("string") if high else (x % 256).cast("string") for x in (p["a"], p["b"]) for high in (True, False)))
    return F.when((o[0] <= 255) & (o[1] <= 255) & (o[2] <= 255) & (o[3] <= 255), _with(pair, show))


def _permuted(i: Column, size: tuple[int, int], tag: str, key: Column) -> Column:
    """A keyed permutation of the numbers below the product of the two sizes."""
    pair = feistel(F.floor(i / size[1]), i % size[1], size[0], size[1], F.lit(tag), key)
    return _with(pair, lambda p: p["a"] * size[1] + p["b"])


def _early_number(d: Column) -> Column:
    """The place of a day up to the 12th among all of these."""
    return (F.year(d) - FIRST_YEAR) * 144 + (F.month(d) - 1) * 12 + F.dayofmonth(d) - 1


def _early_date(number: Column) -> Column:
    return _with(number, lambda i: F.make_date((F.floor(i / 144) + FIRST_YEAR).cast("int"), (F.floor(i / 12) % 12 + 1).cast("int"), (i % 12 + 1).cast("int")))


def _late_before(year: Column) -> Column:
    """How many days after a 12th lie in front of a year."""
    return F.datediff(F.make_date(year, F.lit(1), F.lit(1)), F.lit(f"{FIRST_YEAR}-01-01").cast("date")) - 144 * (year - FIRST_YEAR)


def _late_number(d: Column) -> Column:
    """The place of a day after the 12th among all of these."""
    return F.datediff(d, F.lit(f"{FIRST_YEAR}-01-01").cast("date")) - 12 * ((F.year(d) - FIRST_YEAR) * 12 + F.month(d))


def _late_date(number: Column) -> Column:
    def date(i: Column) -> Column:
        near = (F.floor(i * YEARS / (LATE[0] * LATE[1])) + FIRST_YEAR).cast("int")  # the year, or one beside it
        year = near + (_late_before(near + 1) <= i).cast("int") - (_late_before(near) > i).cast("int")
        return _with(F.struct(year.alias("y"), i.alias("i")), day)

    def day(at: Column) -> Column:
        leap = F.dayofmonth(F.last_day(F.make_date(at["y"], F.lit(2), F.lit(1)))) - 28
        inside = (at["i"] - _late_before(at["y"])).cast("int")
        before = F.array(*(F.lit(n) + (leap if k > 1 else 0) for k, n in enumerate(LATE_BEFORE)))
        month = lambda b: F.size(F.filter(b, lambda n: n <= inside))
        return _with(before, lambda b: F.make_date(at["y"], month(b), inside - F.element_at(b, month(b)) + 13))

    return _with(number, date)


def _date(m: Column, key: Column) -> Column:
    part = lambda sep, i: F.split_part(m, F.lit(sep), F.lit(i))
    year_first, dashes, dots = m.rlike("^[0-9]{4}"), m.contains("-"), m.contains(".")
    made = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    month_first = made(part("/", 3), part("/", 1), part("/", 2))
    day_first = made(part("/", 3), part("/", 2), part("/", 1))
    date = F.when(year_first & dashes, made(part("-", 1), part("-", 2), part("-", 3))).when(year_first, made(part("/", 1), part("/", 2), part("/", 3)))
    date = date.when(dashes, made(part("-", 3), part("-", 2), part("-", 1))).when(dots, made(part(".", 3), part(".", 2), part(".", 1))).otherwise(F.coalesce(month_first, day_first))

    def new(d: Column) -> Column:
        early = F.dayofmonth(d) <= 12
        other = F.when(early, _with(_early_number(d), lambda i: _early_date(_permuted(i, EARLY, "date", key)))).otherwise(_with(_late_number(d), lambda i: _late_date(_permuted(i, LATE, "date+", key))))
        two = lambda form, x: F.lpad(x.cast("string"), F.greatest(F.length(form), F.length(x.cast("string"))), F.lit("0"))

        def show(t: Column) -> Column:
            y, mo, dd = F.lpad(F.year(t).cast("string"), 4, "0"), F.month(t), F.dayofmonth(t)
            slashes = F.when(month_first.isNotNull(), F.concat_ws("/", two(part("/", 1), mo), two(part("/", 2), dd), y)).otherwise(F.concat_ws("/", two(part("/", 1), dd), two(part("/", 2), mo), y))
            dmy = lambda sep: F.concat_ws(sep, two(part(sep, 1), dd), two(part(sep, 2), mo), y)
            shown = F.when(year_first & dashes, F.date_format(t, "yyyy-MM-dd")).when(year_first, F.concat_ws("/", y, two(part("/", 2), mo), two(part("/", 3), dd)))
            return shown.when(dashes, dmy("-")).when(dots, dmy(".")).otherwise(slashes)

        return F.when(F.year(d).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), _with(other, show))

    return _with(date, lambda d: F.when(d.isNotNull(), new(d)))


def _email(m: Column, key: Column) -> Column:
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    last = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    labels = F.split(F.substr(domain, F.lit(1), F.length(domain) - F.length(last)), r"\.")
    return F.concat(permute_characters(local, F.lit("local"), key), F.lit("@"), F.array_join(F.transform(labels, lambda s: permute_characters(s, F.lit("domain"), key)), "."), last)


def _access(m: Column, key: Column) -> Column:
    return F.concat(F.lit("AKIA"), permute_characters(F.substr(m, F.lit(5), F.length(m)), F.lit("access"), key))


def _secret(m: Column, key: Column) -> Column:
    return F.when(m.rlike("^[0-9a-fA-F]+$"), permute_characters(m, F.lit("hex"), key, 6)).otherwise(permute_characters(m, F.lit("secret"), key))


_NEW = {"email": _email, "access": _access, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: Column, keyed: Column | None = None) -> Column:
    """A struct (kind, new) for a string that PATTERN found; new is null where it does not validate as any kind.

    ``keyed`` tells that it has been found behind a keyword, which the value itself does not show.
    """
    made = [F.when(value.rlike(f"^(?:{KINDS[k]})$"), F.struct(F.lit("secret" if k == "access" else k).alias("kind"), _NEW[k](value, key).alias("new"))) for k in _NEW]
    if keyed is not None:
        made.append(F.when(keyed, F.struct(F.lit("secret").alias("kind"), _secret(value, key).alias("new"))))
    return F.coalesce(*(F.when(x["new"].isNotNull(), x) for x in made))


def pseudonymise(docs: DataFrame, *, key: str | Column, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with the personal data in ``text`` replaced; all rows and other columns stay as they are.

    ``key`` is the secret of the permutations: who has it can undo them. As text it is a literal of the plan, as a
    column it comes from the data.
    With ``found``, a column of that name (it may not exist yet) lists the kind
    and the pseudonym of each replaced value in order of the text. A null text stays null
    (and has no values), an empty one empty. Texts without a digit, ``@``,
    ``AKIA`` and the words that stand before secrets are passed over. Texts of any length are
    searched whole, repeated rows get equal pseudonyms, an empty table gives no row.
    """
    if found is not None and found in docs.columns:
        raise ValueError(f"input already has a column {found}")
    secret = F.lit(key) if isinstance(key, str) else key
    source = F.col(text).cast("string")
    values = F.when(source.rlike(GATE), F.regexp_extract_all(source, F.lit(PATTERN), F.lit(0)))
    rest = "__" + "_".join(docs.columns)  # a name that no column has
    marks = F.when(source.rlike(f"(?i:{KEYWORDS})"), F.regexp_extract_all(source, F.lit(_MARKED), F.lit(1)))
    keyed = lambda i: F.coalesce(F.try_element_at(F.col(f"{rest}_"), i + 1) != "", F.lit(False))
    made = F.transform(F.col(rest), lambda m, i: F.struct(m.alias("old"), pseudonym(m, secret, keyed(i)).alias("p")))
    step = docs.withColumns({rest: F.coalesce(values, F.array().cast("array<string>")), f"{rest}_": marks}).withColumn(rest, made).drop(f"{rest}_")
    parts = F.split(source, PATTERN, -1)
    shown = F.transform(F.col(rest), lambda v: F.coalesce(v["p"]["new"], v["old"]))
    joined = F.array_join(F.zip_with(parts, shown, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    step = step.withColumn(text, F.when(F.size(rest) > 0, joined).otherwise(source))
    if found is not None:
        step = step.withColumn(found, F.transform(F.filter(F.col(rest), lambda v: v["p"].isNotNull()), lambda v: v["p"]))
    return step.drop(rest)
