"""Format-preserving pseudonyms of validated numbers, dates, addresses and keys, in DataFrame functions only.

A value is split into two halves; in each of eight Feistel rounds one half is shifted, within
its own alphabet, by a keyed hash of the other.  That is a permutation of the values of one
format, so equal values stay equal across documents, different ones stay different, and the
result has the same shape: card numbers keep a valid check digit, dates are real dates,
addresses keep their byte range, letters stay letters.

Validated kinds: payment cards (13 to 19 digits, blanks or hyphens between, valid Luhn digit),
dates (year-month-day with hyphens, dots or slashes, or day, month and year with dots or slashes, of the years 1800
to 2199; with slashes also month, day and year where the day is over 12, which stays so),
IPv4 addresses, IPv6 addresses (eight groups, or at least three and one gap; the gap stays), telephone numbers (7 to 15
digits with an international prefix of + or 00, which stays, an area code in brackets, or 3-3-4 digits parted
alike), social security numbers (3-2-4, none of the unused ranges), bank account numbers (IBAN, check digits modulo 97, made
anew), e-mail addresses (the local part, whose letters beyond ASCII stay; the domain stays) and access keys (AKIA
and 16 characters, gh?_ and 36, sk- and 20 to 64).  Equal values are those written alike, but for blanks and hyphens inside numbers
and the case of an IPv6 address.
What fails its validation stays as it is; a run of digit groups that is no card is searched for
cards that begin and end at its groups.

Defined cases: a null text stays null with zero counts, an empty one empty; repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_YEAR, LAST_YEAR = 1800, 2199
CARD_DIGITS = (16, 15, 19, 18, 17, 14, 13)  # in the order in which they are tried
CYCLE_DAYS = (189, 773)  # 146,097 days in 400 years, as a product for the two halves
LATE_DAYS = (9, 9833)  # those of them that are later in their month than the 12th
HEX = "0123456789abcdef"

# Values that a telephone number or a run of digit groups doesn't go on into.
_OTHER = (
    r" (?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])|[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])|[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9A-Za-z])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))"
)
_CARD = r" (?:[0-9]{13,19}(?![0-9A-Za-z])|[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9A-Za-z]|[ -][0-9]))"
_GROUP = rf"(?!{_OTHER}|{_CARD})".replace("{", "{{").replace("}", "}}") + "{0}?[0-9]{{2,4}}"
# one to three more groups; no blank after a dot or a hyphen, where another number begins
_BLANK, _MARK = _GROUP.format(" "), _GROUP.format("[.-]")
_TAIL = f"(?:{_BLANK}){{3}}|(?:{_BLANK}){{2}}(?:{_MARK})?|{_BLANK}(?:{_MARK}){{0,2}}|(?:{_MARK}){{1,3}}"

# The kinds and their patterns, in the order in which they are tried at a place.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+À-ɏͰ-ӿ-])[A-Za-z0-9._%+À-ɏͰ-ӿ-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])"),
    ("phone", rf"(?<![0-9A-Za-z])\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{1,4}}\)?{_GROUP.format('[ .-]')}(?:{_TAIL})(?![0-9A-Za-z])"),
    ("phone", r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    ("phone", rf"(?<![0-9A-Za-z])(?![0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-]))00[1-9][0-9]{{0,2}}[ .-]\(?[0-9]{{1,4}}\)?{_GROUP.format('[ .-]')}(?:{_TAIL})(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:]|\.[0-9])"),
    ("ipv4", r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9A-Za-z])"),
    ("date", r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])"),
    ("date", r"(?<![0-9A-Za-z./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9A-Za-z])"),
    ("date", r"(?<![0-9A-Za-z./])[0-9]{4}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{2}(?![0-9A-Za-z]|[./][0-9])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("key", r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    ("key", r"(?<![0-9A-Za-z_])gh[a-z]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    ("key", r"(?<![0-9A-Za-z_-])sk-[0-9A-Za-z]{20,64}(?![0-9A-Za-z])"),
    ("card", rf"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![0-9A-Za-z])(?:(?!{_OTHER})[ -][0-9]++(?![0-9A-Za-z]))*+"),
)
PATTERN = "|".join(p for _, p in KINDS)


def _hash(key: str, kind: str, i, other, size: int):
    """A keyed number below ``size`` from the round and the other half: 60 bits of SHA-256."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)


def _feistel(left, right, left_size, right_size, key: str, kind: str):
    """The two halves after the rounds: even rounds shift the left by the right, odd ones the other way."""
    state = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + _hash(key, kind, i, s["r"], left_size), left_size)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _hash(key, kind, i, s["l"], right_size), right_size)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn)


def _number(x, start, length):
    return F.substring(x, F.lit(start), F.lit(length)).cast("int")


def _padded(x, length):
    return F.lpad(x.cast("string"), length, "0")


def _permuted_digits(digits, key: str, kind: str):
    """Another string of as many digits, 2 to 36 of them."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half)
    done = _feistel(left, right, power(half), power(n - half), key, kind)
    return F.transform(F.array(done), lambda s: F.concat(F.lpad(s["l"].cast("string"), half, F.lit("0")), F.lpad(s["r"].cast("string"), n - half, F.lit("0"))))[0]


def _refilled(shape, digits, places="[0-9]"):
    """The text ``shape`` with its digits, or what ``places`` matches, replaced in order."""
    return F.array_join(F.zip_with(F.split(shape, places), F.split(digits, ""), lambda gap, d: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(d, F.lit("")))), "")


def _luhn(digits):
    """The Luhn sum modulo 10."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _card(x, key):
    def whole(body):
        return F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), 10).cast("string"))

    digits = _digits(x)
    body = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return F.transform(F.array(body), lambda b: _refilled(x, whole(b)))[0]


def _is_card(x):
    digits = _digits(x)
    return F.length(digits).between(13, 19) & (_luhn(digits) == 0)


def _cards(x, key):
    """(text, n) of a run of digit groups: the run if it is a card, or else the cards among its groups from left to right.

    Of the cards that begin at a group those of ``CARD_DIGITS`` count first, in that order.
    """
    every = F.regexp_extract_all(x, F.lit("[ -]?[0-9]+"), F.lit(0))
    found = F.transform(F.array(every), lambda groups: _cards_of(groups, key))[0]
    return F.when(_is_card(x), F.struct(_card(x, key).alias("text"), F.lit(1).alias("n"))).otherwise(found)


def _cards_of(groups, key):
    def span(i, n):
        return F.array_join(F.slice(groups, i, n), "")

    def step(s, i):
        some = F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i + 1))
        ok = F.filter(F.transform(some, lambda n: F.struct(F.array_position(F.array(*map(F.lit, CARD_DIGITS)), F.length(_digits(span(i, n)))).alias("rank"), n.alias("n"))), lambda c: (c["rank"] > 0) & _is_card(span(i, c["n"])))
        best = F.array_min(ok)
        taken = lambda c: F.struct(F.concat(s["text"], _card(span(i, c["n"]), key)).alias("text"), (s["n"] + 1).alias("n"), (i + c["n"]).alias("next"))
        kept = F.struct(F.concat(s["text"], F.element_at(groups, i)).alias("text"), s["n"].alias("n"), (i + 1).alias("next"))
        found = F.transform(F.array(best), lambda c: F.when(c.isNotNull(), taken(c)).otherwise(kept))[0]
        return F.when(i < s["next"], s).otherwise(found)

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(1).alias("next"))
    parts = F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step)
    return F.struct(parts["text"].alias("text"), parts["n"].alias("n"))


def _date(x, key):
    """The date in its own order; a month-first one, known by a day over 12, among the dates of that kind."""
    year_first = x.rlike("^[0-9]{4}")
    a, b = _number(x, 1, 2), _number(x, 4, 2)
    month_first = ~year_first & (F.substring(x, F.lit(3), F.lit(1)) == "/") & a.between(1, 12) & (b > 12)
    year = F.when(year_first, _number(x, 1, 4)).otherwise(_number(x, 7, 4))
    month = F.when(year_first, _number(x, 6, 2)).when(month_first, a).otherwise(b)
    day = F.when(year_first, _number(x, 9, 2)).when(month_first, b).otherwise(a)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    most = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    valid = year.between(FIRST_YEAR, LAST_YEAR) & month.between(1, 12) & day.between(1, most)
    origin = F.lit(f"{FIRST_YEAR}-01-01").cast("date")
    number = F.date_diff(F.make_date(year, month, day), origin)
    left, right = CYCLE_DAYS
    state = _feistel(F.floor(number / right), number % right, F.lit(left), F.lit(right), key, "date")
    plain = F.transform(F.array(state), lambda s: F.date_add(origin, (s["l"] * right + s["r"]).cast("int")))[0]

    rows, columns = LATE_DAYS
    late = number - 12 * (12 * (year - FIRST_YEAR) + month)
    moved = _feistel(F.floor(late / columns), late % columns, F.lit(rows), F.lit(columns), key, "month-first")

    def late_date(n):
        # the months' first late days are some 18.44 numbers apart, and never two months off that
        guess = F.floor(n * 4800 / (rows * columns)).cast("int")
        begin = lambda m: F.date_diff(F.add_months(origin, m), origin) - 12 * m
        m = F.array_max(F.filter(F.sequence(F.greatest(F.lit(0), guess - 2), guess + 2), lambda m: begin(m) <= n))
        return F.transform(F.array(m), lambda m: F.date_add(F.add_months(origin, m), (12 + n - begin(m)).cast("int")))[0]

    shuffled = F.transform(F.array(moved), lambda s: F.transform(F.array(s["l"] * columns + s["r"]), late_date)[0])[0]

    def written(d):
        y, m, n = _padded(F.year(d), 4), _padded(F.month(d), 2), _padded(F.dayofmonth(d), 2)
        gap = lambda i: F.substring(x, F.lit(i), F.lit(1))
        first = F.concat(y, gap(5), m, gap(8), n)
        return F.when(year_first, first).otherwise(F.concat(F.when(month_first, m).otherwise(n), gap(3), F.when(month_first, n).otherwise(m), gap(6), y))

    return F.when(valid, F.transform(F.array(F.when(month_first, shuffled).otherwise(plain)), written)[0])


def _iban(x, key):
    whole = F.regexp_replace(x, " ", "")
    head, body = F.substring(whole, F.lit(1), F.lit(2)), F.substring(whole, F.lit(5), F.length(whole))

    def rest(text):
        """The number modulo 97, letters as 10 to 35."""

        def add(total, c):
            v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
            return F.when(v > 9, (total * 100 + v) % 97).otherwise((total * 10 + v) % 97)

        return F.aggregate(F.split(text, ""), F.lit(0), add)

    valid = F.length(whole).between(15, 34) & (rest(F.concat(body, head, F.substring(whole, F.lit(3), F.lit(2)))) == 1)
    made = _permuted_letters(body, key, "iban")
    written = lambda b: _refilled(x, F.concat(head, _padded(98 - rest(F.concat(b, head, F.lit("00"))), 2), b), "[0-9A-Z]")
    return F.when(valid, F.transform(F.array(made), written)[0])


def _ipv6(x, key):
    groups = F.split(x, ":")
    filled = F.size(F.filter(groups, lambda g: g != ""))
    whole = (F.size(groups) == 8) & (filled == 8)
    # one gap: it stands for an empty group inside, for two at an end
    ends = F.when(F.startswith(x, F.lit("::")), 1).otherwise(0) + F.when(F.endswith(x, F.lit("::")), 1).otherwise(0)
    gap = x.contains("::") & ~x.rlike("::.*::|:::") & (F.size(groups) - filled == 1 + ends) & filled.between(3, 7)
    made = _permuted_letters(F.lower(x), key, "ipv6", hexadecimal=True)
    return F.when(whole | gap, F.when(x.rlike("[A-F]"), F.upper(made)).otherwise(made))


def _ipv4(x, key):
    parts = F.split(x, r"\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & ((F.length(p) == 1) | ~F.startswith(p, F.lit("0"))))
    octet = lambda i: F.get(parts, F.lit(i)).cast("int")
    state = _feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key, "ipv4")
    written = lambda s: F.concat_ws(".", *[n.cast("string") for h in ("l", "r") for n in (F.floor(s[h] / 256), s[h] % 256)])
    return F.when(valid, F.transform(F.array(state), written)[0])


def _phone(x, key):
    prefix = F.regexp_extract(x, r"^(?:\+(?:[0-9]{1,3}(?=[ .(-])|[0-9])|00[0-9]{1,3}(?=[ .-]))", 0)
    rest = F.substring(x, F.length(prefix) + 1, F.length(x))
    valid = F.length(_digits(x)).between(7, F.when(F.startswith(x, F.lit("00")), 17).otherwise(15))
    return F.when(valid, F.concat(prefix, _refilled(rest, _permuted_digits(_digits(rest), key, "phone"))))


def _ssn(x, key):
    area, group, serial = _number(x, 1, 3), _number(x, 5, 2), _number(x, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")
    state = _feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def written(s):
        a = s["l"] + 1 + (s["l"] >= 665).cast("int")
        return F.concat_ws("-", _padded(a, 3), _padded(F.floor(s["r"] / 9999) + 1, 2), _padded(s["r"] % 9999 + 1, 4))

    return F.when(valid, F.transform(F.array(state), written)[0])


def _permuted_letters(x, key: str, kind: str, hexadecimal: bool = False):
    """Letters stay letters of their case, digits digits, all else stays: each shifted by the other half.

    With ``hexadecimal`` the sixteen digits are one alphabet.
    """
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substring(x, F.lit(1), half).alias("l"), F.substring(x, half + 1, F.length(x)).alias("r"))

    def shifted(own, other, i):
        def one(c, j):
            code = F.ascii(c)
            text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), j.cast("string"), other)
            by = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
            if hexadecimal:
                at = F.instr(F.lit(HEX), c) - 1
                return F.when(at >= 0, F.substring(F.lit(HEX), (F.pmod(at + by, 16) + 1).cast("int"), F.lit(1))).otherwise(c)
            turn = lambda first, n: F.char(first + F.pmod(code - first + by, n))
            return F.when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26)).when(code.between(48, 57), turn(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(own, ""), one), "")

    def turn(s, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(shifted(s["r"], s["l"], i)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _email(x, key):
    local = F.substring_index(x, "@", 1)
    return F.concat(_permuted_letters(local, key, "email"), F.substring(x, F.length(local) + 1, F.length(x)))


def _key(x, key):
    head = F.regexp_extract(x, "^(?:AKIA|gh[a-z]_|sk-)", 0)
    return F.concat(head, _permuted_letters(F.substring(x, F.length(head) + 1, F.length(x)), key, "key"))


_WRITERS = {"email": _email, "iban": _iban, "phone": _phone, "ipv6": _ipv6, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "key": _key}


def pseudonym(value, key: str):
    """(kind, old, new, n) of one found value; new is null and n 0 where the value fails its validation."""
    none = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"))
    kind, made = F.lit(None).cast("string"), none
    for name in reversed(dict.fromkeys(k for k, _ in KINDS)):
        pattern = "|".join(p for k, p in KINDS if k == name)
        is_it = value.rlike(f"^(?:{pattern})$")
        kind = F.when(is_it, F.lit(name)).otherwise(kind)
        if name == "card":
            new = _cards(value, key)
        else:
            text = _WRITERS[name](value, key)
            new = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), t.isNotNull().cast("int").alias("n")))[0]
        made = F.when(is_it, new).otherwise(made)
    return F.transform(
        F.array(made), lambda m: F.struct(kind.alias("kind"), value.alias("old"), F.when(m["n"] > 0, m["text"]).alias("new"), m["n"].alias("n"))
    )[0]


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_values, n_<kind> ...): the texts with validated values replaced, and how many."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = src.withColumn("found", F.transform(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), lambda x: pseudonym(x, key)))
    pieces = F.zip_with(F.split("text", PATTERN), "found", lambda gap, v: F.concat(gap, F.coalesce(v["new"], v["old"], F.lit(""))))
    replaced = F.exists("found", lambda v: v["new"].isNotNull())
    kinds = list(dict.fromkeys(k for k, _ in KINDS))

    def count(*only):
        own = F.filter("found", lambda v: v["kind"].isin(*only))
        return F.coalesce(F.aggregate(own, F.lit(0), lambda n, v: n + v["n"]), F.lit(0)).cast("long")

    return found.select(
        "id",
        F.when(replaced, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"),
        count(*kinds).alias("n_values"),
        *[count(k).alias(f"n_{k}") for k in kinds],
    )
