"""Format-preserving Feistel pseudonyms for personal data, in Spark's own functions only.

What is found must be valid: payment cards pass the Luhn test, IBANs the mod-97 test, IPv4 octets stay below 256, social
security numbers have an issued form, dates exist in the calendar.  The rest is left as it is.  Each value is replaced
by the value of a keyed permutation of its own kind, so equal values become equal pseudonyms in all documents and
different values different ones, and the pseudonym is valid again:

* card: a permutation of the digits before the check digit, which is then computed anew;
* iban: the same for the account part, letter for letter and digit for digit, also where it is printed in groups of four;
  of the length that its country has, so words and numbers behind it are none of it;
* ssn, ipv4, date: a permutation of the numbers of all valid values (17 x 4,297 days from 1900 to 2099);
* phone: of the digits after the country code, of North American numbers and those that begin with + and a code, also without separators;
* email: of the local part, letter for letter and digit for digit; the domain stays.

Every permutation is a Feistel network of ``ROUNDS`` rounds: one half is shifted by a keyed hash (SHA-256) of the
other.  Separators, white space and letter case stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
# fixed values: lengths of IBANs and the countries that have them
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
# fixed values: country codes of one and of two digits; others have three
CALLING_CODES = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")

_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _iban() -> str:
    """IBANs of the length that their country has, whole or in groups of four; then, of any country, of any length."""
    known = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        printed = f"(?: [A-Z0-9]{{4}}){{{groups}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
        known.append(f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|{printed}){_END}")
    return _EDGE + "(?:" + "|".join([*known, r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _END]) + ")"


#: One pattern for each kind; they are tried in the order of KINDS.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._+-])[A-Za-z0-9._+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}" + _END,
    "iban": _iban(),
    "card": r"(?<![\p{L}\p{N}_.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\p{L}\p{N}_]|[-.][0-9])",
    "ssn": r"(?<![\p{L}\p{N}_.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_]|[-.][0-9])",
    "phone": r"(?<![\p{L}\p{N}_.+-])(?:\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){2,4}|\+[1-9][0-9]{7,14}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![\p{L}\p{N}_]|[-.][0-9])",
    "ipv4": r"(?<![\p{L}\p{N}_.-])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}_]|[-.][0-9])",
    "date": r"(?<![\p{L}\p{N}_./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2})(?![\p{L}\p{N}_]|[-./][0-9])",
}

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _any() -> str:
    """All kinds in one pattern; back references are counted through."""
    return "|".join(PATTERNS[k] for k in KINDS)


def _hash(key: str, kind: str, step: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), step.cast("string"), F.lit("|"), value.cast("string")), 256)


def _number(key: str, kind: str, step: Column, value: Column) -> Column:
    return F.conv(F.substring(_hash(key, kind, step, value), 1, 15), 16, 10).cast("long")


def feistel_number(value: Column, left: int, right: int, key: str, kind: str) -> Column:
    """A keyed permutation of the numbers below left * right."""
    start = F.struct(F.floor(value / F.lit(right)).cast("long").alias("a"), F.pmod(value, F.lit(right)).cast("long").alias("b"))
    # the halves change places each round; an even number of rounds puts them back
    step = lambda h, i: F.struct(h["b"].alias("a"), F.pmod(h["a"] + _number(key, kind, i, h["b"]), F.when(i % 2 == 0, F.lit(left)).otherwise(F.lit(right))).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda h: h["a"] * F.lit(right) + h["b"])


def _shifted(s: Column, shift: Column) -> Column:
    """Each letter or digit of s moved within its alphabet by two hexadecimal digits of shift; others stay."""

    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(shift, F.pmod(i, F.lit(32)) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")
        out = F.when(F.lit(False), c)
        for letters in (_LOWER, _UPPER, _DIGIT):
            at = F.position(c, F.lit(letters))
            out = out.when(at > 0, F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + F.lit(1), F.lit(1)))
        return out.otherwise(c)

    return F.when(s == "", s).otherwise(F.array_join(F.transform(F.split(s, ""), moved), ""))


def feistel_text(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of one shape: letters stay letters of their case, digits digits."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.length(s)).alias("b"))
    step = lambda h, i: F.struct(h["b"].alias("a"), _shifted(h["a"], _hash(key, kind, i, h["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda h: F.concat(h["a"], h["b"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _put(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order."""
    none = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda h, c: F.when(c.between("0", "9"), F.struct(F.concat(h["out"], F.substr(digits, h["at"], F.lit(1))).alias("out"), (h["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(h["out"], c).alias("out"), h["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), none, step, lambda h: h["out"])


def _luhn_sum(digits: Column, double: int) -> Column:
    """The Luhn sum, digits counted from the right, those at positions of remainder ``double`` doubled."""
    step = lambda h, i: h + (lambda d: F.when(i % 2 == double, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))(F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def is_card(s: Column) -> Column:
    return _luhn_sum(_digits(s), 1) % 10 == 0


def _mod97(s: Column) -> Column:
    """The remainder of the letters and digits read as a number, A being 10."""

    def step(h: Column, c: Column) -> Column:
        at = F.position(c, F.lit(_DIGIT + _UPPER)) - 1
        return F.pmod(h * F.when(at > 9, 100).otherwise(10) + at, F.lit(97)).cast("int")

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _compact(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def is_iban(s: Column) -> Column:
    return _mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1


def _octets(s: Column) -> Column:
    return F.transform(F.split(s, r"\."), lambda x: x.cast("long"))


def is_ipv4(s: Column) -> Column:
    return F.forall(_octets(s), lambda x: x < 256)


def is_ssn(s: Column) -> Column:
    area = F.substr(s, F.lit(1), F.lit(3)).cast("int")
    return (area > 0) & (area < 900) & (area != 666) & (F.substr(s, F.lit(5), F.lit(2)) != "00") & (F.substr(s, F.lit(8), F.lit(4)) != "0000")


def _date(s: Column) -> Column:
    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(F.translate(s, ".", "/"), "d/M/yyyy"))


def _pseudonym(m: Column, key: str) -> Column:
    """Of a match its pseudonym, or the match itself where the value isn't valid."""
    is_a = lambda kind: m.rlike("^(?:" + PATTERNS[kind] + ")$")
    digits = _digits(m)
    body = feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = _put(m, F.concat(body, F.pmod(-_luhn_sum(body, 0), F.lit(10)).cast("string")))
    account = feistel_text(F.substr(_compact(m), F.lit(5), F.length(m)), key, "iban")
    country = F.substr(m, F.lit(1), F.lit(2))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    iban = F.when(m.contains(" "), F.regexp_replace(iban, "(.{4})(?=.)", "$1 ")).otherwise(iban)
    octets = _octets(m)
    ip = feistel_number(octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3], 65536, 65536, key, "ipv4")
    octet = lambda by: F.pmod(F.floor(ip / by), F.lit(256)).cast("string")
    area = F.substr(m, F.lit(1), F.lit(3)).cast("long")
    ssn = feistel_number((area - F.when(area > 666, 2).otherwise(1)) * 989901 + (F.substr(m, F.lit(5), F.lit(2)).cast("long") - 1) * 9999 + F.substr(m, F.lit(8), F.lit(4)).cast("long") - 1, 898, 989901, key, "ssn")
    new_area = F.floor(ssn / 989901)
    ssn = F.concat_ws("-", F.lpad((new_area + F.when(new_area >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(F.pmod(ssn, F.lit(989901)) / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(ssn, F.lit(9999)) + 1).cast("string"), 4, "0"))
    day = F.date_add(F.lit("1900-01-01").cast("date"), feistel_number(F.datediff(_date(m), F.lit("1900-01-01").cast("date")).cast("long"), 17, 4297, key, "date").cast("int"))
    short = F.when(m.rlike("^[0-9]{2}[/.][0-9]{2}[/.]"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "d/M/yyyy"))
    date = F.when(m.contains("/"), short).when(m.contains("."), F.translate(short, "/", ".")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    lead = F.when(m.rlike(r"^\+[0-9]{1,3}[ .(-]"), F.length(F.regexp_extract(m, "^.([0-9]+)", 1)))
    lead = lead.when(m.startswith("+"), F.length(F.regexp_extract(m, rf"^\+({CALLING_CODES}|[0-9]{{3}})", 1))).otherwise(F.length(digits) - 10)
    phone = _put(m, F.concat(F.substr(digits, F.lit(1), lead), feistel_text(F.substr(digits, lead + 1, F.length(digits)), key, "phone")))
    local = F.substring_index(m, "@", 1)
    email = F.concat(feistel_text(local, key, "email"), F.substr(m, F.length(local) + 1, F.length(m)))
    return (
        F.when(is_a("email"), email)
        .when(is_a("iban"), F.when(is_iban(_compact(m)), iban).otherwise(m))
        .when(is_a("card"), F.when(is_card(m), card).otherwise(m))
        .when(is_a("ssn"), F.when(is_ssn(m), ssn).otherwise(m))
        .when(is_a("phone"), F.when(F.length(digits).between(8, 15), phone).otherwise(m))
        .when(is_a("ipv4"), F.when(is_ipv4(m), F.concat_ws(".", octet(16777216), octet(65536), octet(256), octet(1))).otherwise(m))
        .when(is_a("date"), F.when(_date(m).isNotNull(), date).otherwise(m))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, *, key: str, column: str = "text") -> DataFrame:
    """The documents with personal data in ``column`` replaced by pseudonyms, and ``n_replaced`` (int), how many there were.

    key: what the permutations depend on; whoever has it can undo them.  All other columns stay, whatever they are called;
    a column called n_replaced is overwritten.  A null text stays null with 0 replaced, an empty text empty.  Rows are
    treated one by one, so repeated rows and ids give repeated rows, an empty table an empty one.
    """
    free = (f"_pii{i}" for i in range(len(docs.columns) + 2) if f"_pii{i}" not in docs.columns)
    found, new = next(free), next(free)
    text = F.col(column).cast("string")
    # the text between the matches, and the matches: as many, and one more
    table = docs.withColumn(found, F.when(text.rlike("@|[0-9][0-9./]"), F.regexp_extract_all(text, F.lit(_any()), F.lit(0))))
    table = table.withColumn(new, F.transform(found, lambda m: _pseudonym(m, key)))
    between = F.split(text, _any(), -1)
    whole = F.array_join(F.flatten(F.zip_with(between, F.col(new), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    some = F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0
    replaced = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    return table.withColumns({"n_replaced": F.when(some, replaced).otherwise(0), column: F.when(some, whole).otherwise(text)}).drop(found, new)
