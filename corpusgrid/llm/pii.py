"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A found value is validated (real calendar date, check digit, octets up to 255,
possible area numbers) and permuted within the set of valid values of its
format: separators, length and validity stay, and a value gets the same
pseudonym wherever it stands.  The letters and digits of an address are permuted
as base-36 strings of their length, user and domain apart (the last label stays);
capitals count as small letters.  Secrets get keyed hex digits of the same length.
Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.llm.common import text_or_empty

ROUNDS = 6
# --- fixed values: the formats that are looked for -----------------------------------------
#: Possessive, so that the regex engine loops over the labels of a long address and does not recurse.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE_YMD = r"\d{4}-\d{2}-\d{2}"
DATE_DMY = r"\d{2}[/.]\d{2}[/.]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}"
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
#: Written forms of cards, and any other grouping of 13 to 19 digits (one entry for each number of digits).
CARDS = (r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}")
LOOSE_CARDS = tuple(rf"\d(?:[ -]?\d){{{n - 1}}}" for n in range(19, 12, -1))
SECRET = (r"(?i:password)[ \t]*=[ \t]*[^\x20\x09-\x0D]{6,}|(?i:token)[ \t]*=[ \t]*\"[0-9A-Za-z]{16,}\"|(?i:AKIA[0-9A-Z]{16})")
SECRET_HEAD = r'^((?i:password)[ \t]*=[ \t]*|(?i:token)[ \t]*=[ \t]*"|(?i:AKIA))'
# ------------------------------------------------------------------------------------------
KINDS = ("email", "date", "ssn", "phone", "ip", "card", "secret")
NUMBERS = f"(?<![\\d.+-])(?:{DATE_YMD}|{DATE_DMY}|{SSN})(?!\\d)|(?<!\\d){PHONE}(?!\\d)|(?<![\\d.]){IP}(?!\\.?\\d)"
#: Everything but cards, which :func:`cards_in` finds first: a digit group can begin several, and only one has a right check digit.
PATTERN = f"{EMAIL}|{NUMBERS}|{SECRET}"
FIRST_YEAR, YEARS = 1900, 200
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(key: str, tag: str, x: Column, y: Column, a: Column | int, b: Column | int) -> Column:
    """A keyed permutation of the pairs 0 <= x < a, 0 <= y < b (struct x, y of bigint)."""
    a, b = (F.lit(v).cast("bigint") if isinstance(v, int) else v for v in (a, b))

    def turn(s: Column, r: Column) -> Column:
        def add(value: Column, other: Column, n: Column) -> Column:
            draw = F.conv(F.substring(_keyed(key, F.lit(tag), r, other), 1, 12), 16, 10).cast("bigint")
            return F.pmod(value + draw, n)
        return F.when(r % 2 == 1, F.struct(add(s["x"], s["y"], a).alias("x"), s["y"].alias("y"))).otherwise(
            F.struct(s["x"].alias("x"), add(s["y"], s["x"], b).alias("y")))

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _digits_permuted(key: str, tag: str, d: Column) -> Column:
    """A digit string of 2 to 34 digits to another one of the same length."""
    left = F.floor(F.char_length(d) / 2).cast("int")
    right = F.char_length(d) - left
    out = feistel(key, tag, F.substring(d, F.lit(1), left), F.substring(d, left + 1, right),
                  F.pow(F.lit(10), left).cast("bigint"), F.pow(F.lit(10), right).cast("bigint"))
    return F.concat(F.lpad(out["x"].cast("string"), left, "0"), F.lpad(out["y"].cast("string"), right, "0"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _filled(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits`` (which is carried along: named inside, it would be made
    anew for each character)."""
    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["t"], F.when(is_digit, F.substring(s["d"], s["k"], F.lit(1))).otherwise(c)).alias("t"),
                        F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"), s["d"].alias("d"))
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("k"), digits.alias("d")), put)["t"]


def _shifted(key: str, tag: str, r: Column, values: Column, other: Column) -> Column:
    """Base-36 digits ``values``, each moved by a keyed digit that depends on its place and on all of ``other``."""
    # bound to a variable: named inside the inner functions, it would be made anew for each block of 32 digits
    seen = F.array(F.struct(F.sha2(F.array_join(F.transform(other, lambda x: x.cast("string")), ","), 256).alias("d"), r.alias("r"),
                            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / 32).cast("int")).alias("blocks")))
    hexes = F.flatten(F.transform(seen, lambda s: F.transform(s["blocks"], lambda c: _keyed(key, F.lit(tag), s["r"], c, s["d"]))))
    stream = F.flatten(F.transform(hexes, lambda h: F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda j: F.conv(F.substring(h, 2 * j + 1, F.lit(2)), 16, 10).cast("int"))))
    return F.zip_with(values, F.slice(stream, F.lit(1), F.size(values)), lambda v, x: (v + x) % 36)


def _base36_permuted(key: str, tag: str, values: Column) -> Column:
    """A keyed permutation of the arrays of base-36 digits of one length: a Feistel network over their two halves."""
    half = F.floor(F.size(values) / 2).cast("int")
    start = F.struct(F.slice(values, F.lit(1), half).alias("x"), F.slice(values, half + 1, F.size(values)).alias("y"))

    def turn(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 1, F.struct(_shifted(key, tag, r, s["x"], s["y"]).alias("x"), s["y"].alias("y"))).otherwise(
            F.struct(s["x"].alias("x"), _shifted(key, tag, r, s["y"], s["x"]).alias("y")))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.transform(F.array(out), lambda s: F.concat(s["x"], s["y"]))[0]


def _letters_permuted(key: str, tag: str, s: Column) -> Column:
    """``s`` with its small letters and digits permuted as one base-36 string; every other character stays in place."""
    placed = F.transform(F.split(s, ""), lambda c, i: F.struct(i.alias("at"), (F.call_function("instr", F.lit(BASE36), c) - 1).alias("v"), c.alias("c")))
    letters = F.filter(placed, lambda x: x["v"] >= 0)
    moved = F.zip_with(F.transform(letters, lambda x: x["at"]), _base36_permuted(key, tag, F.transform(letters, lambda x: x["v"])),
                       lambda at, v: F.struct(at.alias("at"), v.alias("v"), F.substring(F.lit(BASE36), v + 1, F.lit(1)).alias("c")))
    rest = F.filter(placed, lambda x: x["v"] < 0)
    return F.when(s == "", s).otherwise(F.array_join(F.transform(F.array_sort(F.concat(moved, rest)), lambda x: x["c"]), ""))


def _date_as(m: Column, *parts: tuple[int, int]) -> Column:
    iso = F.concat_ws("-", *[F.substring(m, at, n) for at, n in parts])
    d = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.year(d).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), d)


def _day_first(m: Column) -> Column:
    return _date_as(m, (7, 4), (4, 2), (1, 2))


def _date(m: Column) -> Column:
    """The calendar date that ``m`` writes (d/m/y, else m/d/y), null if there is none in the permuted years."""
    return F.when(m.rlike(f"^{DATE_YMD}$"), _date_as(m, (1, 4), (6, 2), (9, 2))).otherwise(
        F.coalesce(_day_first(m), _date_as(m, (7, 4), (1, 2), (4, 2))))


def _date_pseudonym(key: str, m: Column) -> Column:
    d = _date(m)
    leap = F.dayofyear(d) == 366
    # day 366 stays day 366 of another leap year (every fourth of 48, 1900 and 2100 being none)
    usual = feistel(key, "date", F.year(d) - FIRST_YEAR, F.dayofyear(d) - 1, YEARS, 365)
    late = feistel(key, "leap", F.floor((F.year(d) - FIRST_YEAR - 4) / 4) % 7, F.floor((F.year(d) - FIRST_YEAR - 4) / 28), 7, 7)
    year = F.when(leap, FIRST_YEAR + 4 + 4 * (late["x"] + 7 * late["y"])).otherwise(FIRST_YEAR + usual["x"])
    day = F.when(leap, F.lit(365)).otherwise(usual["y"])
    new = F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), day.cast("int"))
    return F.when(m.rlike(f"^{DATE_YMD}$"), F.date_format(new, "yyyy-MM-dd")).otherwise(
        _filled(m, F.when(_day_first(m).isNotNull(), F.date_format(new, "ddMMyyyy")).otherwise(F.date_format(new, "MMddyyyy"))))


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")


def _ssn_pseudonym(key: str, m: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    index = F.when(area > 666, area - 2).otherwise(area - 1)               # 898 areas: 001-899 but 666
    out = feistel(key, "ssn", index * 99 + group - 1, serial - 1, 898 * 99, 9999)
    place = F.floor(out["x"] / 99).cast("int")
    return F.format_string("%03d-%02d-%04d", F.when(place >= 665, place + 2).otherwise(place + 1), out["x"] % 99 + 1, out["y"] + 1)


def _ip_pseudonym(key: str, m: Column) -> Column:
    o = [F.get(F.split(m, r"\."), k).cast("bigint") for k in range(4)]
    out = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65_536, 65_536)
    return F.concat_ws(".", *[F.floor(v / 256).cast("string") if high else (v % 256).cast("string")
                              for v in (out["x"], out["y"]) for high in (True, False)])


def _check_digit(d: Column) -> Column:
    """Luhn check digit of a digit string without one."""
    total = F.aggregate(F.split(F.reverse(d), ""), F.struct(F.lit(0).alias("s"), F.lit(2).alias("w")), lambda s, c: F.struct(
        (s["s"] + F.when(c.cast("int") * s["w"] > 9, c.cast("int") * s["w"] - 9).otherwise(c.cast("int") * s["w"])).alias("s"),
        (3 - s["w"]).alias("w")))["s"]
    return ((10 - total % 10) % 10).cast("string")


def _card_pseudonym(key: str, m: Column) -> Column:
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), _digits_permuted(key, "card", F.substring(d, F.lit(2), F.char_length(d) - 2)))
    return _filled(m, F.concat(body, _check_digit(body)))


def _phone_pseudonym(key: str, m: Column) -> Column:
    d = F.substring(_digits(m), -10, 10)          # the first digits of area and exchange stay: both remain possible
    moved = _digits_permuted(key, "phone", F.concat(F.substring(d, 2, 2), F.substring(d, 5, 6)))
    new = F.concat(F.substring(d, 1, 1), F.substring(moved, 1, 2), F.substring(d, 4, 1), F.substring(moved, 3, 6))
    return _filled(m, F.when(F.char_length(_digits(m)) == 11, F.concat(F.lit("1"), new)).otherwise(new))


def _email_pseudonym(key: str, m: Column) -> Column:
    address = F.lower(m)
    user, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    last = F.substring_index(domain, ".", -1)
    body = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(last) - 1)
    return F.concat(_letters_permuted(key, "email", user), F.lit("@"), _letters_permuted(key, "domain", body), F.lit("."), last)


def _secret_pseudonym(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, SECRET_HEAD, 1)
    tail = F.when(head.endswith('"'), F.lit('"')).otherwise(F.lit(""))
    core = F.substring(m, F.char_length(head) + 1, F.char_length(m) - F.char_length(head) - F.char_length(tail))
    hexes = F.concat(*[_keyed(key, F.lit(f"secret{k}"), core) for k in range(4)])
    hexes = F.when((core == F.upper(core)) & (core != F.lower(core)), F.upper(hexes)).otherwise(hexes)
    return F.concat(head, F.substring(hexes, F.lit(1), F.char_length(core)), tail)


def cards_in(text: Column) -> Column:
    """The distinct valid cards of ``text``, from every digit group on, the written forms first."""
    def valid(forms: tuple[str, ...]) -> Column:
        found = [F.regexp_extract_all(text, F.lit(f"(?<!\\d)(?=({form})(?!\\d))"), F.lit(1)) for form in forms]
        return F.filter(F.concat(*found), lambda m: F.call_function("luhn_check", _digits(m)))
    # a loose grouping that holds another kind's value is that value beside a plain number
    both = F.concat(valid(CARDS), F.filter(valid(LOOSE_CARDS), lambda m: ~m.rlike(NUMBERS)))
    return F.when(text.rlike(LOOSE_CARDS[-1]), F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def pattern_of(cards: Column) -> Column:
    """The pattern to search a text with, given its valid cards (digits, spaces and hyphens only)."""
    return F.when(F.size(cards) == 0, F.lit(PATTERN)).otherwise(
        F.concat(F.lit("(?<!\\d)(?:"), F.array_join(cards, "|"), F.lit(f")(?!\\d)|{PATTERN}")))


def kind_of(m: Column) -> Column:
    """The validated kind of a match, null for a look-alike."""
    area, group, serial = _ssn_parts(m)
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    return (F.when(m.rlike(SECRET_HEAD), F.lit("secret"))
            .when(m.contains("@"), F.lit("email"))
            .when(m.rlike(f"^({DATE_YMD}|{DATE_DMY})$"), F.when(_date(m).isNotNull(), F.lit("date")))
            .when(m.rlike(f"^{SSN}$"), F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), F.lit("ssn")))
            .when(m.rlike(f"^{IP}$"), F.when(F.forall(octets, lambda x: x), F.lit("ip")))
            .when(m.rlike(f"^{PHONE}$"), F.lit("phone"))
            .when(F.call_function("luhn_check", _digits(m)), F.lit("card")))


def pseudonym(key: str, m: Column, kind: Column) -> Column:
    by_kind = {"email": _email_pseudonym, "date": _date_pseudonym, "ssn": _ssn_pseudonym, "phone": _phone_pseudonym,
               "ip": _ip_pseudonym, "card": _card_pseudonym, "secret": _secret_pseudonym}
    out = F.when(F.lit(False), m)
    for name in KINDS:
        out = out.when(kind == name, by_kind[name](key, m))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and a count n_<kind> for each of KINDS, and n_pii.

    Whole texts are searched.  Null texts stay null and empty ones empty, with
    counts of 0.  Every row is judged by itself, so equal rows give equal rows;
    an empty table stays empty.  Columns named like a count are replaced.
    """
    text = text_or_empty(text_col)
    d = docs.withColumn("__cards", cards_in(text)).withColumn("__pattern", pattern_of(F.col("__cards")))
    d = d.withColumn("__found", F.when(text.rlike("[@0-9]|(?i:AKIA|password|token)"), F.regexp_extract_all(text, "__pattern", F.lit(0))).otherwise(
        F.array().cast("array<string>")))
    d = d.withColumn("__kinds", F.transform("__found", kind_of))
    new = F.zip_with("__found", "__kinds", lambda m, k: F.when(k.isNull(), m).otherwise(pseudonym(key, m, k)))
    rebuilt = F.array_join(F.zip_with(F.split(text, F.col("__pattern"), -1), new, lambda p, q: F.concat(p, F.coalesce(q, F.lit("")))), "")
    # a look-alike has a null kind, which array_remove leaves in place
    counts = {f"n_{k}": (F.size("__kinds") - F.size(F.array_remove("__kinds", k))).cast("long") for k in KINDS}
    d = d.withColumn(text_col, F.when(F.size("__found") == 0, F.col(text_col)).otherwise(rebuilt)).withColumns(counts)
    return d.withColumn("n_pii", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))).drop("__cards", "__pattern", "__found", "__kinds")
