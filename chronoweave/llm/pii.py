"""Format-preserving pseudonyms for personal data. DataFrame functions only.

One regular expression finds candidates; those that hold as what they look like (check digits of card numbers and IBANs,
range of IP octets, calendar dates, social security areas) are replaced, all else stays as it is. Card numbers are sought in
each run of 13 digits or more, set apart by single blanks or hyphens at most: any neighbouring groups with 13 to 19 digits
in all and a valid check digit, those in a usual grouping first; the rest of the run is searched for the other kinds. Numbers
and dates go through a keyed Feistel permutation of their own domain and are written back in the format that they had: digits
into the places of digits, check digits made anew, dates as other valid dates of 1900 to 2099, IPv6 addresses with all
their eight groups. Permutations are one to one and depend on the key alone, so equal values stay linked across documents and
different ones stay apart; the country code of a phone number stays, so a number links with and without it. Phone numbers
have no check digit: all that look like one count. E-mail addresses and secrets (32 hexadecimal digits or more), which
aren't numbers, become keyed digests of the same form (of an e-mail address, 128 bits).

The halves of a domain need not be alike: with a * b values, each round adds a keyed digest of the right half to the
left one modulo a, then of the left half to the right one modulo b. Dates outside their range are walked on until
they are inside.

Who knows the key can undo the numbers: set ``spark.chronoweave.pii.key``; the default is public and for tests.

Null texts stay null, empty ones empty. Repeated rows give repeated results. Other columns are kept by
``pseudonymize``, but for any called n_found or n_replaced, which give way to its own; the texts of documents without candidates
aren't rebuilt. Texts and tokens may have any length: no pattern recurses over what it repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS, KEY = 6, "chronoweave-demo-key"
_HOST = r"[\p{L}\p{N}-]"
#: What each kind of candidate looks like. Of two that begin at one place the first is taken.
KINDS = {
    "email": rf"(?<![\p{{L}}0-9._%+-])[\p{{L}}0-9._%+-]{{1,64}}@(?={_HOST}++\.{_HOST})(?:(?!\.(?!{_HOST}))[\p{{L}}\p{{N}}.-])++",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)(?=[0-9A-Fa-f:]{0,38}(?:::|(?::[0-9A-Fa-f]{1,4}){7}))[0-9A-Fa-f:]{6,39}+(?![0-9A-Za-z:])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?\d{3}|\d{3}[ .-]\d{3})[ .-]\d{4}(?!\d)",
    "phone abroad": r"(?<![\d+])\+[1-9](?:(?:[ .-]|[ .-]?[()][ .-]?)?+\d){7,14}+(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}
#: Country codes of one and of two digits; all others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
OTHERS = "|".join(KINDS.values())
#: A run of digit groups in which cards are sought. It isn't the end of a decimal fraction, and ends before what is of another kind and reaches beyond it.
RUN = rf"(?<!\d)(?<!\d\.)\d(?:(?:[ -](?!{KINDS['email']}|{KINDS['ip']}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}(?![\d/-])|\d{{1,2}}/\d{{1,2}}/\d{{4}}(?![\d/-])))?+\d){{12,}}+"
ANY = f"{OTHERS}|{RUN}"
#: Lengths of the groups in which cards are printed.
USUAL = ("4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3", "4-4-4-1", "4-4-5", "6-13")
LONGEST_CARD, LONGEST_USUAL = 19, max(u.count("-") + 1 for u in USUAL)
_DAYS, _FIRST = 73_049, "1900-01-01"


def _digest(key: str, kind: str, value: Column) -> Column:
    """A keyed number below 2**52."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value.cast("string")), 256), 1, 13), 16, 10).cast("long")


def feistel(x: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A permutation of the long x in [0, a * b)."""
    def once(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _digest(key, kind, F.concat_ws(":", i, F.lit("r"), s["r"])), s["a"])
        return let(left, lambda n: F.struct(n.alias("l"), F.pmod(s["r"] + _digest(key, kind, F.concat_ws(":", i, F.lit("l"), n)), s["b"]).alias("r"), s["a"].alias("a"), s["b"].alias("b")))

    a, b = a.cast("long"), b.cast("long")
    begin = F.struct(F.floor(x.cast("decimal(38,0)") / b).cast("long").alias("l"), F.pmod(x.cast("decimal(38,0)"), b.cast("decimal(38,0)")).cast("long").alias("r"), a.alias("a"), b.alias("b"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, once)
    return let(end, lambda s: s["l"].cast("decimal(38,0)") * s["b"] + s["r"])


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among all such strings of its length."""

    def run(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        kinds = F.concat_ws("", F.lit(kind), F.length(d))
        begin = F.struct(F.substring(d, F.lit(1), left).cast("long").alias("l"), F.substring(d, left + 1, F.length(d)).cast("long").alias("r"), F.pow(F.lit(10.0), left).cast("long").alias("a"), F.pow(F.lit(10.0), F.length(d) - left).cast("long").alias("b"), kinds.alias("k"))

        def once(s: Column, i: Column) -> Column:
            new = F.pmod(s["l"] + _digest(key, "digits", F.concat_ws(":", s["k"], i, F.lit("r"), s["r"])), s["a"])
            return let(new, lambda n: F.struct(n.alias("l"), F.pmod(s["r"] + _digest(key, "digits", F.concat_ws(":", s["k"], i, F.lit("l"), n)), s["b"]).alias("r"), s["a"].alias("a"), s["b"].alias("b"), s["k"].alias("k")))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, once)
        return let(end, lambda s: F.concat(F.lpad(s["l"].cast("string"), left, "0"), F.lpad(s["r"].cast("string"), F.length(d) - left, "0")))

    return let(digits, run)


def _in_places(form: Column, digits: Column) -> Column:
    """The digits written into the places that digits have in form."""
    place = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i), "[^0-9]", ""))
    char = lambda i: F.substring(form, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(char(i).between("0", "9"), F.substring(digits, place(i), F.lit(1))).otherwise(char(i))), "")


def _luhn_sum(digits: Column, first_weight: Column) -> Column:
    """Sum of the digits with every second one doubled; first_weight: 1 or 2, of the leftmost."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(i + first_weight, F.lit(2)) == 1, F.lit(1)).otherwise(F.lit(2))
        return F.when(d > 9, d - 9).otherwise(d)

    chars = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)))
    return F.aggregate(F.transform(chars, part), F.lit(0), lambda s, x: s + x)


def _luhn_valid(digits: Column) -> Column:
    return F.pmod(_luhn_sum(digits, F.pmod(F.length(digits), F.lit(2)) * -1 + 2), F.lit(10)) == 0


def _card(m: Column, key: str) -> Column:
    """A valid card number becomes another one of its length."""

    def run(d: Column) -> Column:
        body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        checked = let(body, lambda p: F.concat(p, F.pmod(10 - F.pmod(_luhn_sum(p, F.pmod(F.length(p), F.lit(2)) + 1), F.lit(10)), F.lit(10)).cast("string")))
        return _in_places(m, checked)

    return let(F.regexp_replace(m, "[^0-9]", ""), run)


def _spans(groups: Column, usual: bool) -> Column:
    """Card numbers among groups of digits as [(first, last)], by place, counted from 1; no two share a group.

    From left to right the longest at each place is taken; ``usual``: only those in one group or in a usual grouping.
    """
    text = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")
    form = lambda i, j: F.array_join(F.transform(F.slice(groups, i, j - i + 1), lambda g: F.length(g).cast("string")), "-")
    kind = "array<struct<first:int,last:int>>"

    def from_group(i: Column) -> Column:
        reach = F.least(F.size(groups), i + (LONGEST_USUAL if usual else LONGEST_CARD) - 1)
        ends = F.reverse(F.sequence(i, reach))
        if usual:
            ends = F.filter(ends, lambda j: (i == j) | form(i, j).isin(*USUAL))
        valid = F.filter(ends, lambda j: let(text(i, j), lambda d: F.length(d).between(13, LONGEST_CARD) & _luhn_valid(d)))
        return F.transform(valid, lambda j: F.struct(i.alias("first"), j.alias("last")))

    def taken(found: Column) -> Column:
        """In blocks of about the root of their number, so that no long array is copied for each span."""
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(found))).cast("int"))

        def add(s: Column, x: Column) -> Column:
            return F.when(x["first"] > s["end"], F.struct(x["last"].alias("end"), F.concat(s["got"], F.array(x)).alias("got"))).otherwise(s)

        def block(s: Column, b: Column) -> Column:
            begin = F.struct(s["end"].alias("end"), F.array().cast(kind).alias("got"))
            return let(F.aggregate(F.slice(found, b * step + 1, step), begin, add), lambda r: F.struct(r["end"].alias("end"), F.concat(s["got"], F.array(r["got"])).alias("got")))

        begin = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{kind}>").alias("got"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), step), begin, block, lambda s: s["got"]))

    return let(F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), from_group)), taken)


def _parted(groups: Column, usual: bool) -> Column:
    """Groups (with what stands before each) cut into cards and what lies between: [(card, groups)]."""

    def run(spans: Column) -> Column:
        n = F.size(spans)
        part = lambda i, j, card: F.struct(F.lit(card).alias("card"), F.slice(groups, i, F.greatest(j - i + 1, F.lit(0))).alias("groups"))

        def piece(q: Column) -> Column:
            after = F.when(q == 1, 1).otherwise(F.get(spans, q - 2)["last"] + 1)
            here = F.get(spans, q - 1)
            return F.when(q > n, F.array(part(after, F.size(groups), False))).otherwise(F.array(part(after, here["first"] - 1, False), part(here["first"], here["last"], True)))

        return F.filter(F.flatten(F.transform(F.sequence(F.lit(1), n + 1), piece)), lambda p: F.size(p["groups"]) > 0)

    bare = F.transform(groups, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return let(let(bare, lambda b: _spans(b, usual)), run)


def _run(m: Column, key: str) -> Column:
    """What stands for a run of digits: (new, found, replaced)."""
    groups = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))
    parts = let(groups, lambda g: F.flatten(F.transform(_parted(g, True), lambda p: F.when(p["card"], F.array(p)).otherwise(_parted(p["groups"], False)))))

    def new(p: Column) -> Column:
        card = lambda c: let(_card(c, key), lambda k: F.struct(k.alias("new"), F.lit(1).alias("found"), (k != c).cast("int").alias("replaced")))
        return let(F.array_join(p["groups"], ""), lambda c: F.when(p["card"], card(c)).otherwise(_replaced(c, OTHERS, lambda x: _single(x, key))))

    return let(F.transform(parts, new), _joined)


def _joined(parts: Column) -> Column:
    """Parts (new, found, replaced) in a row as one."""
    total = lambda f: F.aggregate(parts, F.lit(0), lambda a, x: a + x[f])
    return F.struct(F.array_join(F.transform(parts, lambda x: x["new"]), "").alias("new"), total("found").alias("found"), total("replaced").alias("replaced"))


def _replaced(t: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
    """The text t with each match m of the pattern replaced by use(m), as (new, found, replaced)."""

    def run(ms: Column) -> Column:
        new = F.transform(ms, use)
        count = lambda n: F.size(F.filter(F.zip_with(n, ms, lambda a, b: a != b), lambda x: x))
        return let(new, lambda n: F.struct(F.array_join(F.zip_with(F.split(t, pattern), n, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "").alias("new"), F.size(ms).alias("found"), count(n).alias("replaced")))

    return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), run)


def _ip(m: Column, key: str) -> Column:
    def run(o: Column) -> Column:
        number = F.aggregate(o, F.expr("0L"), lambda s, x: s * 256 + x.cast("long"))
        new = feistel(number, F.lit(65_536), F.lit(65_536), key, "ip").cast("long")
        dotted = let(new, lambda n: F.concat_ws(".", *(F.pmod(F.floor(n / F.lit(256**k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0))))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), dotted).otherwise(m)

    return let(F.split(m, r"\."), run)


def _date(m: Column, key: str) -> Column:
    """ISO dates, day.month.year, and month/day/year, or day/month/year where only that is a date."""
    nums = F.transform(F.split(m, r"[./-]"), lambda x: x.cast("int"))
    at = lambda a, i: F.get(a, F.lit(i))

    def valid(y: Column, mo: Column, d: Column) -> Column:
        last = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).otherwise(31)
        return y.between(1900, 2099) & mo.between(1, 12) & (d >= 1) & (d <= last)

    def run(a: Column) -> Column:
        iso, dotted = m.like("____-%"), m.contains(".")
        us = valid(at(a, 2), at(a, 0), at(a, 1)) & ~dotted & ~iso
        y = F.when(iso, at(a, 0)).otherwise(at(a, 2))
        mo = F.when(iso | ~us, at(a, 1)).otherwise(at(a, 0))
        d = F.when(iso, at(a, 2)).when(us, at(a, 1)).otherwise(at(a, 0))
        day = F.datediff(F.make_date(y, mo, d), F.lit(_FIRST).cast("date"))
        step = lambda x: feistel(x, F.lit(271), F.lit(270), key, "date").cast("long")
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(8)), step(day), lambda x, i: F.when(x < _DAYS, x).otherwise(step(x)))
        wide = lambda x, i: F.lpad(x.cast("string"), F.greatest(F.length(F.get(F.split(m, r"[./-]"), F.lit(i))), F.length(x.cast("string"))), "0")

        def render(t: Column) -> Column:
            ny, nm, nd = F.year(t), F.month(t), F.dayofmonth(t)
            slash = F.when(us, F.concat_ws("/", wide(nm, 0), wide(nd, 1), ny)).otherwise(F.concat_ws("/", wide(nd, 0), wide(nm, 1), ny))
            return F.when(iso, F.date_format(t, "yyyy-MM-dd")).when(dotted, F.concat_ws(".", wide(nd, 0), wide(nm, 1), ny)).otherwise(slash)

        new = let(F.date_add(F.lit(_FIRST).cast("date"), walked.cast("int")), render)
        return F.when(valid(y, mo, d), new).otherwise(m)

    return let(nums, run)


def _email(m: Column, key: str) -> Column:
    return let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), lambda h: F.concat(F.lit("user."), F.substring(h, 1, 32), F.lit("@example.invalid")))


def _secret(m: Column, key: str) -> Column:
    def run(first: Column) -> Column:
        more = F.transform(F.sequence(F.lit(1), F.ceil(F.length(m) / 64).cast("int")), lambda i: F.when(i == 1, first).otherwise(F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), first), 256)))
        return F.substring(F.array_join(more, ""), F.lit(1), F.length(m))

    new = let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(m)), 256), run)
    return F.when(m == F.upper(m), F.upper(new)).otherwise(new)


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(_chars(text), value), F.lit(0), lambda r, v: F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _iban_valid(m: Column) -> Column:
    return let(F.regexp_replace(m, " ", ""), lambda c: F.length(c).between(15, 34) & (_mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1))


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay; the account's digits are permuted and the check digits made anew."""

    def run(c: Column) -> Column:
        account = F.substring(c, F.lit(5), F.length(c))
        digits = F.regexp_replace(account, "[^0-9]", "")
        new = let(permuted_digits(digits, key, "iban"), lambda d: let(_in_places(account, d), lambda a: F.concat(F.lpad((98 - _mod97(F.concat(a, F.substring(c, 1, 2), F.lit("00")))).cast("string"), 2, "0"), d)))
        return F.when(_iban_valid(m) & (F.length(digits) >= 2), _in_places(m, new)).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), run)


def _ipv6(m: Column, key: str) -> Column:
    """Eight groups, or fewer (three at least) with one double colon; the 128 bits are permuted in two halves."""
    number = lambda h: F.conv(h, 16, -10).cast("long")
    digest = lambda i, side, x: number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ipv6"), i, F.lit(side), x), 256), 1, 16))
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    four = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")

    def once(s: Column, i: Column) -> Column:
        left = s["l"].bitwiseXOR(digest(i, "r", s["r"]))
        return let(left, lambda n: F.struct(n.alias("l"), s["r"].bitwiseXOR(digest(i, "l", n)).alias("r")))

    def run(sides: Column) -> Column:
        before, after = groups(F.get(sides, F.lit(0))), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
        n = F.size(before) + F.size(after)
        fits = F.forall(F.concat(before, after), lambda g: F.length(g) <= 4) & ~m.rlike("^:[^:]|[^:]:$|:::") & (((F.size(sides) == 1) & (n == 8)) | ((F.size(sides) == 2) & n.between(3, 7)))
        whole = F.lower(F.concat(four(before), F.repeat(F.lit("0"), 4 * (8 - n)), four(after)))
        halves = let(whole, lambda h: F.struct(number(F.substring(h, 1, 16)).alias("l"), number(F.substring(h, 17, 16)).alias("r")))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, once)
        text = let(end, lambda s: F.lower(F.concat(F.lpad(F.hex(s["l"]), 16, "0"), F.lpad(F.hex(s["r"]), 16, "0"))))
        return F.when(fits, F.regexp_replace(text, "(.{4})(?=.)", "$1:")).otherwise(m)

    return let(F.split(m, "::"), run)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups and serials from 1: permuted among themselves."""

    def run(a: Column) -> Column:
        area, group, serial = (F.get(a, F.lit(i)).cast("long") for i in range(3))
        x = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1

        def render(n: Column) -> Column:
            place = F.floor(n / F.lit(99 * 9999))
            parts = (place + 1 + (place >= 665).cast("long"), F.pmod(F.floor(n / F.lit(9999)), F.lit(99)) + 1, F.pmod(n, F.lit(9999)) + 1)
            return F.concat_ws("-", *(F.lpad(p.cast("string"), w, "0") for p, w in zip(parts, (3, 2, 4), strict=True)))

        new = let(feistel(x, F.lit(898 * 99), F.lit(9999), key, "ssn").cast("long"), render)
        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new).otherwise(m)

    return let(F.split(m, "-"), run)


def _phone(m: Column, key: str) -> Column:
    """The country code stays, all other digits are permuted."""
    code = F.regexp_extract(m, COUNTRY, 1)
    return _in_places(m, let(F.regexp_replace(m, "[^0-9]", ""), lambda d: let(F.length(code), lambda n: F.concat(F.substring(d, F.lit(1), n), permuted_digits(F.substring(d, n + 1, F.length(d)), key, "number")))))


def _single(m: Column, key: str) -> Column:
    """What stands for a candidate of any kind but a card; the candidate itself if it isn't what it looks like."""
    whole = lambda k: m.rlike(f"^(?:{KINDS[k]})$")
    out = F.when(m.contains("@"), _email(m, key)).when(whole("secret"), _secret(m, key)).when(whole("date"), _date(m, key)).when(whole("ip"), _ip(m, key))
    return out.when(m.contains(":"), _ipv6(m, key)).when(whole("ssn"), _ssn(m, key)).when(m.rlike("^[A-Z]"), _iban(m, key)).otherwise(_phone(m, key))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for a match of ANY: (new, found, replaced). A run of digits counts as one candidate at least.

    What looks like an IBAN and isn't one may be a run of digits behind two letters.
    """
    head = F.regexp_extract(m, r"^([A-Z]{2})\d[\d -]{12,}$", 1)
    is_run = ~m.rlike(f"^(?:{OTHERS})$") | ((head != "") & ~_iban_valid(m))
    one = let(_single(m, key), lambda n: F.struct(n.alias("new"), F.lit(1).alias("found"), (n != m).cast("int").alias("replaced")))
    run = let(head, lambda h: let(_run(F.substring(m, F.length(h) + 1, F.length(m)), key), lambda r: F.struct(F.concat(h, r["new"]).alias("new"), F.greatest(r["found"], F.lit(1)).alias("found"), r["replaced"].alias("replaced"))))
    return F.when(is_run, run).otherwise(one)


def key_of(spark) -> str:
    """The key of the session, ``spark.chronoweave.pii.key``."""
    return spark.conf.get("spark.chronoweave.pii.key", KEY)


def pseudonymize(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs with their personal data replaced in ``text``, and n_found (long): how many candidates a text held and n_replaced."""
    key = key_of(docs.sparkSession) if key is None else key
    t = F.col(text)
    likely = t.rlike(r"[0-9@]|[A-Fa-f]{32}|::")
    found = F.when(likely, F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))

    def run(ms: Column) -> Column:
        return F.when(F.size(ms) > 0, F.transform(ms, lambda m: pseudonym(m, key)))

    own = "_cw_matches"
    held = docs.withColumn(own, let(found, run))
    woven = F.array_join(F.zip_with(F.split(t, ANY), F.col(f"{own}.new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    total = lambda f: F.coalesce(F.aggregate(F.col(own), F.lit(0), lambda a, x: a + x[f]), F.lit(0)).cast("long")
    out = held.withColumn(text, F.when(F.col(own).isNull(), t).otherwise(woven))
    return out.withColumn("n_found", total("found")).withColumn("n_replaced", total("replaced")).drop(own)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs).select("doc_id", "text", "n_found", "n_replaced")
