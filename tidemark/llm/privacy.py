"""Format-preserving pseudonyms for personal data, by Feistel networks; DataFrame expressions only.

Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, phone and social security numbers, and dates are found by pattern,
validated, and permuted under a key within their format: separators, lengths, country codes and first card digits stay,
check digits are made anew, a date becomes a date from 1900 to 2099. A number beside another is not taken for its part. The
permutation sees the bare digits (a date's day number), so equal values get equal pseudonyms in all documents, however they
are written. Mail addresses and secrets, which are no numbers, get letters and digits from a keyed hash, class by class.
What fails validation is left alone.

A null text stays null with no counts, an empty one stays empty; a very long one is treated whole. Repeated rows are
treated alike, one result each. An empty table gives an empty result. Other columns, whatever their names, are kept; only
a column that has the name asked for the counts is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
_IP = r"(?:(?:[01]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])\.){3}(?:[01]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])(?![0-9]|\.[0-9])"
_DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/-])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NATIONAL = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"
#: A number of its own, where a match before it ends.
_NEXT = f"(?:{_IP}|{_DATE}|{_SSN}|{_NATIONAL})"
_SPACE = f" (?!{_NEXT})"
#: After so many digits, with what a phone number has between them.
_AFTER = {n: "[ .()-]{0,3}".join(["[0-9]"] * n) + r"\)?" for n in (7, 11, 17)}
_FOUR = r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9]|[ -][0-9]{4}(?![0-9]))"
_PHONE_SPACE = rf" (?!(?<={_AFTER[7]} )(?:{_NEXT}|{_FOUR})|(?<={_AFTER[11]} )(?:19|20)[0-9]{{2}}(?![0-9]))"
#: IBAN countries by length; other countries take any.
_IBAN_OF = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else "") for n, c in _IBAN_OF.items())
#: Kind and pattern; earlier ones win where two match at one place. A card's match is the whole chain of digits, for _card to search.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/-]{8,}+",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?:(?:{_SPACE})?[A-Z0-9]{{4}}){{2,7}}(?:(?:{_SPACE})?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "date": rf"(?<![0-9./-]){_DATE}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": rf"(?<![0-9+])\+1[ .-]?\(?[0-9]{{3}}\)?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?![0-9])|(?<![0-9+])\+[0-9]{{1,3}}(?:(?:[.-]|{_PHONE_SPACE})?\(?[0-9]{{2,4}}\)?){{2,5}}(?![0-9])(?<={_AFTER[7]})(?<!{_AFTER[17]})|(?<![0-9+]){_NATIONAL}",
    "ssn": rf"(?<![0-9-]){_SSN}",
    "card": rf"(?<![0-9-])[0-9](?:(?:-|{_SPACE})?[0-9]){{12,}}+",
}
#: What a match is, seen without its neighbours.
KINDS = PATTERNS | {
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "phone": rf"\+[0-9]{{1,3}}(?:[ .-]?\(?[0-9]{{2,4}}\)?){{2,5}}|{_NATIONAL}",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match has; texts without it are passed over.
HINT = r"[0-9@]|[=:]\s{0,3}[\"']?[A-Za-z]"
DATES = (("yyyy-MM-dd", r"^[0-9]{4}-"), ("d.M.yyyy", r"\."), ("M/d/yyyy", "/"), ("d/M/yyyy", "/"))
FIRST_DAY, DAYS, SIDE = -25567, 73049, 271  # 1900-01-01 as days since 1970, days to 2099-12-31, side**2 >= DAYS


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def keyed(key: str, *parts: Column) -> Column:
    """A number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, of_a: Column, of_b: Column, size: Column) -> Column:
    """struct(a, b): (a, b) of [0, of_a) x [0, of_b) permuted; the halves change in turn, each by a keyed function of the other."""

    def turn(s: Column, i: Column) -> Column:
        to_a = F.when(i % 2 == 0, F.pmod(s.a + F.pmod(keyed(key, F.lit(kind), size, i, s.b), of_a), of_a)).otherwise(s.a)
        to_b = F.when(i % 2 == 1, F.pmod(s.b + F.pmod(keyed(key, F.lit(kind), size, i, s.a), of_b), of_b)).otherwise(s.b)
        return F.struct(to_a.alias("a"), to_b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def part(x: Column, start: Column | int, length: Column | int) -> Column:
    return F.substring(x, F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length)


def power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        out = feistel(key, kind, part(d, 1, u).cast("long"), part(d, u + 1, n - u).cast("long"), power(u), power(n - u), n)
        return let(out, lambda s: F.concat(F.lpad(s.a.cast("string"), u, "0"), F.lpad(s.b.cast("string"), n - u, "0")))

    return let(digits, lambda d: F.when(F.length(d) < 2, d).otherwise(halves(d)))


def put_back(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, one after another."""
    char = lambda i: part(shape, i, 1)
    nth = lambda i: F.length(digits_of(part(shape, 1, i)))
    return let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(char(i).rlike("[0-9]"), part(d, nth(i), 1)).otherwise(char(i))), ""))


def luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, whose last digit counts once."""
    at = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = part(digits, i, 1).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Remainder of a string of letters (A = 10) and digits."""
    letters = F.split(text, "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("long")).otherwise((F.ascii(c) - 55).cast("long"))
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))


def hashed_form(key: str, kind: str, x: Column, keep: Column) -> Column:
    """Letters and digits of x from its place keep + 1 on, replaced class by class from a keyed hash of that part, which is read once."""

    def other(whole: Column, c: Column, i: Column) -> Column:
        h = keyed(key, F.lit(kind), whole, i)
        at = lambda letters: part(F.lit(letters), (F.pmod(h, F.lit(len(letters))) + 1).cast("int"), 1)
        new = F.when(c.rlike("[0-9]"), at("0123456789")).when(c.rlike("[A-Z]"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("[a-z]"), at("abcdefghijklmnopqrstuvwxyz")).otherwise(c)
        return F.when(i < keep, c).otherwise(new)

    letters = F.filter(F.split(x, ""), lambda c: c != "")
    return let(keyed(key, F.lit(kind), F.substring(x, keep + 1, F.length(x))), lambda whole: F.array_join(F.transform(letters, lambda c, i: other(whole, c, i)), ""))


def _email(key: str, m: Column) -> Column:
    return F.concat(hashed_form(key, "email", F.substring_index(m, "@", 1), F.lit(0)), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(key: str, m: Column) -> Column:
    return hashed_form(key, "secret", m, F.when(m.rlike("^(?:AKIA|ASIA)"), F.lit(4)).otherwise(F.length(F.regexp_extract(m, "^([^=:]*[=:]\\s*[\"']?)", 1))))


def _iban(key: str, m: Column) -> Column:
    def changed(x: Column) -> Column:
        country, rest = part(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        new = put_back(rest, permuted(key, "iban", digits_of(rest)))

        def whole(r: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0")
            return let(F.concat(country, check, r), lambda n: _spaced(m, n))

        return F.when(mod97(F.concat(rest, part(x, 1, 4))) == 1, F.struct(F.lit("iban").alias("kind"), let(new, whole).alias("value"), F.lit(1).alias("n"))).otherwise(inside)

    # No IBAN: the numbers in it may be a card's.
    chain = PATTERNS["card"]
    cards = F.transform(F.regexp_extract_all(m, F.lit(chain), F.lit(0)), lambda x: _card(key, x))
    inside = let(cards, lambda found: F.struct(F.lit("card").alias("kind"), _joined(F.split(m, chain, -1), found).alias("value"), F.aggregate(found, F.lit(0), lambda a, x: a + x.n).alias("n")))
    return let(F.replace(m, F.lit(" "), F.lit("")), changed)


def _joined(between: Column, found: Column) -> Column:
    """The texts between matches and the matches' values, in turn."""
    return F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda t, m: F.concat(t, m.value)), ""), F.element_at(between, -1))


def _spaced(shape: Column, bare: Column) -> Column:
    char = lambda i: part(shape, i, 1)
    nth = lambda i: F.length(F.replace(part(shape, 1, i), F.lit(" "), F.lit("")))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(char(i) == " ", F.lit(" ")).otherwise(part(bare, nth(i), 1))), "")


def _date(key: str, m: Column) -> Column:
    out = m
    for form, mark in reversed(DATES):
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        number = F.unix_date(day) - FIRST_DAY
        inside = lambda s: s.a * SIDE + s.b

        def walk(n: Column) -> Column:  # again until the number is a day's: at most once in six hundred times
            start = F.struct(F.floor(n / SIDE).cast("long").alias("a"), F.pmod(n.cast("long"), F.lit(SIDE).cast("long")).alias("b"))
            side = F.lit(SIDE).cast("long")
            once = lambda s: feistel(key, "date", s.a, s.b, side, side, F.lit(0))
            return inside(F.aggregate(F.sequence(F.lit(0), F.lit(11)), start, lambda s, i: F.when((i > 0) & (inside(s) < DAYS), s).otherwise(once(s))))

        padded = form if form[0] == "y" else form.replace("d", "dd").replace("M", "MM")

        def shown(n: Column) -> Column:
            date = F.date_from_unix_date((n + FIRST_DAY).cast("int"))
            return F.when(F.length(m) == 10, F.date_format(date, padded)).otherwise(F.date_format(date, form))

        out = F.when(m.rlike(mark) & number.between(0, DAYS - 1), let(walk(number), shown)).otherwise(out)
    return out


def _ip(key: str, m: Column) -> Column:
    def changed(o: Column) -> Column:
        side = F.lit(65536).cast("long")
        at = lambda i: F.element_at(o, i).cast("int")
        new = feistel(key, "ip", at(1) * 256 + at(2), at(3) * 256 + at(4), side, side, F.lit(0))
        shown = lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(s.a, 8), s.a.bitwiseAND(255), F.shiftright(s.b, 8), s.b.bitwiseAND(255))])
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), let(new, shown)).otherwise(m)

    return let(F.split(m, r"\."), changed)


def _phone(key: str, m: Column) -> Column:
    country = F.length(F.regexp_extract(m, r"^\+([0-9]*)", 1))
    changed = lambda d: put_back(m, F.concat(part(d, 1, country), permuted(key, "phone", F.substring(d, country + 1, F.length(d)))))
    return let(digits_of(m), lambda d: F.when(F.length(d).between(7, 16), changed(d)).otherwise(m))


def _ssn(key: str, m: Column) -> Column:
    return F.when(m.rlike("^(?:000|666|9)|-00-|-0000$"), m).otherwise(put_back(m, permuted(key, "ssn", digits_of(m))))


#: How cards are written, by lengths of their groups.
CARD_FORMS = ("4-4-4-4", "4-6-5", "4-6-4", "4-3-3-3", "6-13")


def _card(key: str, m: Column) -> Column:
    """struct(kind, value, n) of a chain of digit groups: from left to right, the first valid form at each group.

    At the chain's start the longest run of groups of 13 to 19 digits is tried as well, however written. Sixteen digits and
    three are one number only for issuers with numbers of nineteen (50, 56 to 58, 6), else a card and its security code.
    """

    def changed(x: Column, d: Column) -> Column:
        body = F.concat(part(d, 1, 1), permuted(key, "card", part(d, F.lit(2), F.length(d) - 2)))
        check = lambda b: F.concat(b, F.pmod(10 - luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))
        return put_back(x, let(body, check))

    def search(groups: Column) -> Column:  # each with the separator before it
        run = lambda i, k: F.array_join(F.slice(groups, i, k), "")

        def groups_of_card(i: Column) -> Column:
            valid = lambda k: let(digits_of(run(i, k)), lambda d: F.length(d).between(13, 19) & (luhn(d) % 10 == 0))
            form = lambda k: F.array_join(F.transform(F.slice(groups, i, k), lambda g: F.length(digits_of(g)).cast("string")), "-")
            one = F.length(digits_of(F.element_at(groups, i)))
            out = F.when(one.between(13, 19) & valid(F.lit(1)), 1)
            out = out.when(one.isin(4, 6) & (form(F.lit(5)) == "4-4-4-4-3") & run(i, F.lit(1)).rlike("^[ -]?(?:6|5[0678])") & valid(F.lit(5)), 5)
            for shape in CARD_FORMS:
                k = F.lit(shape.count("-") + 1)
                out = out.when((one == int(shape[0])) & (form(k) == shape) & valid(k), k)
            upto = lambda k: F.length(digits_of(run(F.lit(1), k)))
            longest = F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.size(groups), F.lit(19))), lambda k: upto(k) <= 19))
            return out.otherwise(F.when(i == 1, let(longest, lambda k: F.when(valid(k), k).otherwise(0))).otherwise(0))

        def step(s: Column, i: Column) -> Column:
            def taken(k: Column) -> Column:
                new = F.when(k > 0, let(run(i, k), lambda x: changed(x, digits_of(x)))).otherwise(F.element_at(groups, i))
                return F.struct(F.concat(s.value, new).alias("value"), (i + F.greatest(k, F.lit(1))).alias("at"), (s.n + (k > 0).cast("int")).alias("n"))

            return F.when(i < s["at"], s).otherwise(let(groups_of_card(i), taken))

        start = F.struct(F.lit("").alias("value"), F.lit(1).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda s: F.struct(F.lit("card").alias("kind"), s.value.alias("value"), s.n.alias("n")))

    return let(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), search)


CHANGE = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def pseudonym(key: str, m: Column) -> Column:
    """struct(kind, value, n) of one match, n the values in it; kind is null where validation fails."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"), F.lit(0).alias("n"))

    def marked(kind: str) -> Column:
        new = CHANGE[kind](key, m)
        new = new if kind in ("iban", "card") else F.struct(F.lit(kind).alias("kind"), new.alias("value"), F.lit(1).alias("n"))
        return let(new, lambda v: F.struct(F.when(v.value != m, v.kind).alias("kind"), v.value.alias("value"), v.n.alias("n")))

    for kind, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), marked(kind)).otherwise(out)
    return out


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = "pseudonyms") -> DataFrame:
    """The rows of df with pseudonyms in the text, and in count_col how many there are of each kind (a map)."""
    text = F.col(text_col)
    hit = text.rlike(HINT)
    found = F.when(hit, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(key, m)))
    # One pass finds the matches, one takes the text between them; matches are exploded neither way.
    mine = free_name(df.columns, "_found")
    rows = df.withColumn(mine, found)
    new = _joined(F.split(text, ANY, -1), F.col(mine))
    rows = rows.withColumn(text_col, F.when(F.size(mine) > 0, new).otherwise(text))
    if count_col:
        kinds = F.flatten(F.transform(F.filter(mine, lambda m: m.kind.isNotNull()), lambda m: F.array_repeat(m.kind, m.n)))
        count = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
        rows = rows.withColumn(count_col, F.coalesce(count, F.create_map().cast("map<string,int>")))
    return rows.drop(mine)
