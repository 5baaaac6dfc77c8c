"""PII: format-preserving Feistel pseudonyms, with DataFrame functions only.

Found values are validated (card numbers by their check digit, IBANs by their
remainder, dates by the calendar, addresses by their ranges) and permuted under
a key within their format: characters keep their class and place, check digits
are made anew, addresses and dates stay valid.  The permutation is a Feistel
network of ``ROUNDS`` rounds over the two halves of the value's variable
characters; each round adds a keyed hash of one half to the other, character
by character, modulo the size of its class.  Equal values have one pseudonym
wherever they stand.

A found shape is taken with the numbers and groups of capitals that follow it, and
every run of its words is checked: at each word the longest valid run of the usual
layout (cards 4-4-4-4, 4-6-5, 4-6-4 or unbroken, IBANs of their country's length,
telephone numbers that end with a joined group), and between those the longest
valid run of any layout.  A neighbouring number neither hides a value nor changes.
Null text stays null; a text without values is returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

KEY = "pseudonym-key-1"
ROUNDS = 8
#: The shapes of the kinds, tried in this order.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?",
    "date": r"[12][0-9]{3}-[01][0-9]-[0-3][0-9]",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
}
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_.@+-])", r"(?![A-Za-z0-9_@]|[.-][A-Za-z0-9])"
ANY = _BEFORE + "(?:" + "|".join(PATTERNS.values()) + ")" + _AFTER
_WORD = r"\+?(?:\([0-9]{2,4}\)|[A-Z0-9])(?:[.-]?(?:\([0-9]{2,4}\)|[A-Z0-9]))*+"
#: A shape and the words after it that could belong to a value.
REGION = ANY + "(?: (?!" + PATTERNS["email"] + ")" + _WORD + _AFTER + ")*+"
MOST_WORDS, MOST_CHARS = 19, 48  # of a value that has spaces
IBAN_LENGTHS = ("AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
                "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
                "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column, doubled: int) -> Column:
    """Sum of the digits, every second one from the right doubled; ``doubled``: parity from the right that is."""
    n = F.length(s)
    d = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == doubled, F.element_at(
        F.array(*[F.lit(2 * k - 9 * (k > 4)) for k in range(10)]), F.substr(s, i, F.lit(1)).cast("int") + 1)).otherwise(
        F.substr(s, i, F.lit(1)).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def feistel(value: Column, tweak: Column, key: str = KEY) -> Column:
    """Keyed permutation of a string; digits, lower and upper letters keep their class and place, others stay."""
    half = F.floor(F.length(value) / 2).cast("int")
    left, right = F.substr(value, F.lit(1), half), F.substr(value, half + 1, F.length(value) - half)

    def shifted(s: Column, other: Column, i: Column) -> Column:
        def one(k):
            c = F.substr(s, k, F.lit(1))
            draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), k.cast("string"), other), 256), 1, 12), 16, 10).cast("long")
            def within(letters):
                at = F.instr(F.lit(letters), c).cast("long") - 1
                return F.substr(F.lit(letters), (F.pmod(at + draw, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
            return (F.when(c.between("0", "9"), within(DIGITS)).when(c.between("a", "z"), within(LOWER))
                    .when(c.between("A", "Z"), within(UPPER)).otherwise(c))
        return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), one), "")).otherwise("")

    state = F.struct(left.alias("l"), right.alias("r"))
    step = lambda a, i: F.struct(  # noqa: E731  # even rounds change the left half, odd ones the right
        F.when(i % 2 == 0, shifted(a["l"], a["r"], i)).otherwise(a["l"]).alias("l"),
        F.when(i % 2 == 1, shifted(a["r"], a["l"], i)).otherwise(a["r"]).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), state, step, lambda a: F.concat(a["l"], a["r"]))


def _number(value: Column, low: int, high: int, tweak: str, key: str) -> Column:
    """Keyed permutation of whole numbers 0 .. low * high - 1 (a Feistel network of two unlike halves)."""
    draw = lambda x, i: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("long")
    state = F.struct(F.floor(value / high).cast("long").alias("a"), F.pmod(value, F.lit(high)).cast("long").alias("b"))
    step = lambda s, i: F.struct(
        F.when(i % 2 == 0, F.pmod(s["a"] + draw(s["b"], i), F.lit(low))).otherwise(s["a"]).cast("long").alias("a"),
        F.when(i % 2 == 1, F.pmod(s["b"] + draw(s["a"], i), F.lit(high))).otherwise(s["b"]).cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), state, step, lambda s: s["a"] * high + s["b"])


def _laid(shape: Column, chars: Column) -> Column:
    """The characters put in place of the letters and digits of ``shape``; its separators stay."""
    n = F.length(shape)
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
        F.substr(shape, i, F.lit(1)).rlike("[A-Za-z0-9]"),
        F.substr(chars, F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), "[^A-Za-z0-9]", "")), F.lit(1)))
        .otherwise(F.substr(shape, i, F.lit(1)))), "")


def _iban_rest(s: Column) -> Column:
    """Remainder by 97 of an IBAN's characters read as a number, the first four last."""
    moved = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))
    codes = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.instr(F.lit(DIGITS + UPPER), F.substr(moved, i, F.lit(1))) - 1)
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c > 9, (a * 100 + c) % 97).otherwise((a * 10 + c) % 97))


def _kind(m: Column, digits: Column) -> Column:
    """The kind of a found value, or null if it fails the checks of its shape."""
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = {
        "email": F.lit(True), "ssn": ~m.rlike("^(000|666|9)|-00-|-0000$"),
        "iban": _iban_rest(F.regexp_replace(m, " ", "")) == 1,
        "date": F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).isNotNull() & m.between("1800-01-01", "2199-12-31"),
        "ip": F.forall(octets, lambda x: x <= 255), "phone": F.length(digits).between(8, 15),
        "card": F.length(digits).between(13, 19) & (_luhn(digits, 1) % 10 == 0),
    }
    kind = F.lit(None).cast("string")
    for k in reversed(PATTERNS):
        kind = F.when(m.rlike("^(?:" + PATTERNS[k] + ")$"), F.when(valid[k], F.lit(k))).otherwise(kind)
    return kind


def _usual(m: Column, kind: Column, digits: Column) -> Column:
    """Whether a valid value has the layout that its kind usually has."""
    tight = F.regexp_replace(m, " ", "")
    length = F.instr(F.lit(IBAN_LENGTHS), F.concat(F.substr(m, F.lit(1), F.lit(2)), F.length(tight).cast("string"))) > 0
    card = m.rlike("^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}([ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$")
    joined = m.rlike(r"([0-9][.-][0-9]+|[0-9]{6,}) ")  # a group that ends the number, and more after it
    return (F.when(kind == "card", card).when(kind == "iban", length)
            .when(kind == "phone", ~joined & (~m.rlike(r"^\+1[^0-9]") | (F.length(digits) == 11))).otherwise(F.lit(True)))


def pieces(region: Column) -> Column:
    """The words of a region, those of one value joined by their spaces."""
    def runs(words: Column) -> Column:
        n = F.size(words)

        def at(i: Column) -> Column:
            texts = F.transform(F.sequence(F.lit(1), F.least(n - i, F.lit(MOST_WORDS))), lambda k: F.struct(
                k.alias("k"), F.array_join(F.slice(words, i + 1, k), " ").alias("m")))
            texts = F.filter(texts, lambda x: (x["k"] == 1) | (F.length(x["m"]) <= MOST_CHARS))
            kinds = F.transform(texts, lambda x: F.struct(x["k"], x["m"], _digits(x["m"]).alias("digits")))
            kinds = F.transform(kinds, lambda x: F.struct(x["k"], x["m"], x["digits"], _kind(x["m"], x["digits"]).alias("kind")))
            return F.transform(F.filter(kinds, lambda x: x["kind"].isNotNull()), lambda x: F.struct(
                x["k"], _usual(x["m"], x["kind"], x["digits"]).alias("usual"),
                ((x["kind"] != "card") | (x["k"] == 1) | ~x["m"].rlike("[0-9]{13}")).alias("loose")))

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    def longest(found: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(found, lambda x: x["k"])), F.lit(0))

    def cut(x: Column) -> Column:
        words, runs_at, usual = x["words"], x["runs"], x["usual"]

        def step(state: Column, i: Column) -> Column:
            near = F.array_position(F.transform(F.slice(usual, i + 2, F.lit(MOST_WORDS)), lambda k: k > 0), True)
            room = F.when(near > 0, near).otherwise(MOST_WORDS)
            loose = longest(F.filter(runs_at[i], lambda r: r["loose"] & (r["k"] <= room)))
            k = F.greatest(F.when(usual[i] > 0, usual[i]).otherwise(loose), F.lit(1)).cast("int")
            return F.when(i < state["next"], state).otherwise(F.struct((i + k).cast("int").alias("next"), F.concat(
                state["out"], F.array(F.array_join(F.slice(words, i + 1, k), " "))).alias("out")))

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), start, step, lambda a: a["out"])

    x = F.transform(F.array(F.split(region, " ", -1)), lambda w: F.struct(w.alias("words"), runs(w).alias("runs")))
    x = F.transform(x, lambda s: F.struct(s["words"], s["runs"], F.transform(
        s["runs"], lambda found: longest(F.filter(found, lambda r: r["usual"]))).alias("usual")))
    return F.flatten(F.transform(x, cut))


def _body(m: Column, kind: Column, digits: Column) -> Column:
    """The characters that the string permutation may change."""
    country = F.when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1))).otherwise(0)
    tight = F.regexp_replace(m, " ", "")
    return (F.when(kind == "email", F.substring_index(m, "@", 1))
            .when(kind == "card", F.substr(digits, F.lit(2), F.length(digits) - 2))
            .when(kind == "phone", F.substr(digits, country + 1, F.length(digits)))
            .when(kind == "ssn", digits).when(kind == "iban", F.substr(tight, F.lit(5), F.length(tight))).otherwise(""))


def _whole(m: Column, kind: Column, digits: Column, new: Column, key: str) -> Column:
    """The pseudonym: the permuted characters with what the format keeps or makes anew."""
    card = F.concat(F.substr(digits, F.lit(1), F.lit(1)), new)
    check = F.pmod(-_luhn(card, 0), F.lit(10)).cast("string")
    country = F.substr(m, F.lit(1), F.lit(2))
    checked = F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), new))).cast("string"), 2, "0")
    octet = F.split(m, r"\.")
    address = sum((octet[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), octet[0].cast("long") * 256**3)
    dotted = F.array_join(F.transform(F.array(_number(address, 65536, 65536, "ip", key)), lambda n: F.concat_ws(
        ".", *[F.shiftright(n, 8 * (3 - i)).bitwiseAND(255).cast("string") for i in range(4)])), "")
    day = _number(F.datediff(F.to_date(m), F.to_date(F.lit("1800-01-01"))).cast("long"), 27, 5411, "date", key)
    return (F.when(kind == "email", F.concat(new, F.substr(m, F.instr(m, "@"), F.length(m))))
            .when(kind == "card", _laid(m, F.concat(card, check)))
            .when(kind == "phone", _laid(m, F.concat(F.substr(digits, F.lit(1), F.length(digits) - F.length(new)), new)))
            .when(kind == "ssn", _laid(m, new)).when(kind == "iban", _laid(m, F.concat(country, checked, new)))
            .when(kind == "ip", dotted)
            .when(kind == "date", F.date_format(F.date_add(F.to_date(F.lit("1800-01-01")), day.cast("int")), "yyyy-MM-dd"))
            .otherwise(m))


def pseudonyms(values: Column, key: str = KEY) -> Column:
    """Array of (kind, value, pseudonym); a value that fails its checks has a null kind and stays."""
    found = F.transform(values, lambda m: F.struct(m.alias("value"), _digits(m).alias("digits")))
    found = F.transform(found, lambda x: F.struct(x["value"], x["digits"], _kind(x["value"], x["digits"]).alias("kind")))
    found = F.transform(found, lambda x: F.struct(x["value"], x["digits"], x["kind"], feistel(
        _body(x["value"], x["kind"], x["digits"]), F.coalesce(x["kind"], F.lit("")), key).alias("new")))
    return F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), _whole(
        x["value"], x["kind"], x["digits"], x["new"], key).alias("pseudonym")))


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` (other columns as they are) and a last column (``_found``, or a free name like it):
    (kind, value, pseudonym) of each value."""
    new, found = free_names(docs, "new", "found")
    rows = docs.withColumn(new, F.when(F.col("text").rlike(ANY), F.transform(
        F.regexp_extract_all("text", F.lit(REGION), 0), lambda r: pseudonyms(pieces(r), key))))
    rows = rows.withColumn(found, F.filter(F.flatten(new), lambda x: x["kind"].isNotNull()))
    text = F.array_join(F.transform(F.split("text", REGION, -1), lambda s, i: F.concat(
        s, F.coalesce(F.array_join(F.get(F.col(new), i)["pseudonym"], " "), F.lit("")))), "")
    return rows.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(text)).drop(new)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, number of values replaced and their kinds in page order, for every row (null text: null,
    none); repeated rows are each given, an empty table gives none."""
    rows = replaced(docs.select("doc_id", "text"), key)
    kinds = F.filter(F.coalesce("_found.kind", F.array().cast("array<string>")), lambda k: k.isNotNull())
    return rows.select("doc_id", "text", F.size(kinds).alias("n_values"), kinds.alias("kinds"))
