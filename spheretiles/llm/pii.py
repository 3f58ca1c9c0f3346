"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Base spans: e-mail addresses, IP addresses, card and phone numbers by fixed formats and checks. They always stay.
2. Generators with high recall propose further, overlapping spans of the same kinds: addresses written with (at) and
   [dot], numbers with other or doubled separators, phone numbers without a plus sign, addresses with [.] for dots.
3. Boosted trees score candidates from format and context features. Labelled candidates are made by rewriting: matches
   are disguised in every way that the generators know, in their own context, and the generators are run on them. What
   they find is right if it is the whole of a disguised match that passes its check, under its kind; all else is a decoy.
   Matches come from the table and, as its addresses and numbers may all be of one make, from public formats (`formats`):
   names and hosts of syllables, cards of several lengths, phone numbers of a dozen countries, and beside them decoys of
   the same make: prose around an @, prices, addresses with a part above 255, numbers that fail their check, order
   numbers, book numbers, dates. Features that would name the source (digits, lengths, parts) are not read for addresses.
   The fit reads about `sample` distinct matches of each kind (the bounded labelled sample); the trees become arrays that
   one SQL expression walks.
4. A threshold for each kind is calibrated on all matches of all documents that the fit did not read, and on held public
   formats: the lowest score at which `precision` of the generators' finds are right on both (on both together where the table holds too few to show it). Where no score reaches it,
   or fewer than `recall` of the right ones among the public formats would be found, nothing is added for that kind.

Patterns use possessive quantifiers and look-behinds so that long runs cost linear time; they find the same spans as
the plain patterns in their comments. Work on the matches of one text goes through arrays in chunks, so it grows with
their number and not with its square.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import documents, written

KINDS = ("email", "ip", "card", "phone")
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ with twelve digits at least
CARD = r"(?=(?:[0-9][ -]?){12})[0-9]++(?:[ -][0-9]++)*+"
# \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
_AT = r"(?: ?[(\[{<] ?(?:at|AT|At) ?[)\]}>] ?| ?@ ?)"
_DOT = r"(?: ?\. ?| ?[(\[{<] ?(?:dot|DOT|Dot) ?[)\]}>] ?)"
MORE = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++|(?: at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++| AT [A-Za-z0-9-]++(?: DOT [A-Za-z0-9-]++)++))",
    r"(?<![0-9])[0-9]{1,3}(?:(?:\.| ?[(\[{](?:\.|dot|DOT)[)\]}] ?| dot )[0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9])[0-9](?:[ ._/-]{0,3}[0-9]){11,18}(?![0-9])",
    r"(?<![0-9+])(?=(?:[ ./()-]{0,3}[0-9]){9})(?:00 ?)?\(?[0-9]{1,4}\)?(?:(?:[ ./-]{1,3}\(?|(?<=\)))[0-9]{1,8}\)?){1,6}(?![0-9])",
)
# a whole match laid out as a date, or a possible date before a time or a further date (perhaps cut off)
_DAY = r"(?:[12][0-9]{3}[-/. ](?:0[1-9]|1[0-2])[-/. ](?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[-/. ](?:0[1-9]|[12][0-9]|3[01])[-/. ][12][0-9]{3})"
_THEN = r"[ ./-]{1,3}(?:[0-3][0-9](?:[ .:/-]?[0-5][0-9]){0,2}(?:\.[0-9]{1,6})?|[12][0-9]{3}(?:[-/. ][0-9]{1,2}){0,2}|[0-3][0-9][-/. ][0-3][0-9][-/. ][12][0-9]{0,3})"
DATE = rf"^(?:[0-9]{{4}}[-/. ][0-9]{{2}}[-/. ][0-9]{{2}}|[0-9]{{2}}[-/. ][0-9]{{2}}[-/. ][0-9]{{4}}|{_DAY}(?:{_THEN}){{1,3}})$"
# words that announce a kind, and words that announce another number
CUES = ("mail|contact|write|reach|address|to", "ip|host|server|address|node|from", "card|visa|mastercard|amex|credit|debit|paid", "phone|tel|call|fax|mobile|cell|dial|ring|whatsapp|sms")
OTHER = "order|invoice|isbn|ref|id|serial|version|part|sku|total|price|usd|eur|sum|pages|ticket|on|date|code|batch"
# fixed values: common endings of host names
ENDINGS = "com org net edu gov mil int info biz name io co me tv ai app dev eu uk de fr es it nl be ch at se no dk fi pl cz pt ie us ca mx br ar cl au nz jp cn in kr sg za gr hu ro tr il example test".split()
# fixed order: the trees name features by place
FEATURES = (
    "kind", "cue", "glued", "doubled", "spaces", "marks", "tld", "last", "capital", "stop",
    "digits", "size", "gaps", "zeros", "luhn", "parts", "longest", "largest", "fours", "plus", "lead", "quad", "triples", "area", "thirteen",
)
NEAR = 24  # characters before a match that its features may read
CHUNK = 256


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _fold(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Array of what step(state, item) = (state, array to append) gives, from left to right.

    Items go by chunks: appending to a chunk's own array, and chunks to the whole, copies little however long it is.
    `kind`: the array's type.
    """
    none = F.array().cast(kind)

    def inner(a: Column, x: Column) -> Column:
        after, more = step(a["state"], x)
        return F.struct(after.alias("state"), F.concat(a["out"], more).alias("out"))

    def outer(a: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(items, k * CHUNK + 1, F.lit(CHUNK)), F.struct(a["state"].alias("state"), none.alias("out")), inner)
        return F.struct(done["state"].alias("state"), F.concat(a["out"], F.array(done["out"])).alias("out"))

    chunks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    whole = F.aggregate(chunks, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), outer)
    return F.when(F.size(items) > 0, F.flatten(whole["out"])).otherwise(none)


FOUND = "struct<start: int, kind: int, end: int, m: string, before: string, after: string, ok: boolean>"
MATCH = "struct<start: int, end: int, m: string, before: string, after: string>"


def _found(df: DataFrame, text: str, pattern: str, name: str, when: Column) -> DataFrame:
    """Adds column `name`: the matches with their places in code points and what stands around them.

    Places come from the lengths of matches and of what lies between; `before` and `after` reach to the next match at most.
    """
    found = F.when(when, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__m", found)
    df = df.withColumn("__h", F.when(F.size("__m") > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    pairs = F.arrays_zip(F.slice("__h", F.lit(1), F.size("__m")).alias("g"), F.col("__m").alias("m"), F.slice("__h", F.lit(2), F.size("__m")).alias("h"))
    df = df.withColumn("__g", pairs)

    def one(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["g"], F.lit(NEAR)).alias("before"), F.left(x["h"], F.lit(1)).alias("after"))
        return end, F.array(span)

    return df.withColumn(name, _fold(F.col("__g"), F.lit(0), one, f"array<{MATCH}>")).drop("__m", "__h", "__g")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """12 to 19 digits that pass the Luhn check."""
    d = _digits(m)
    each = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        x = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.when(F.length(d).between(12, 19), _total(F.transform(each, value)) % 10 == 0).otherwise(False)


VALID = (
    lambda m: F.lit(True),
    lambda m: m.rlike(BYTE_PARTS),
    _luhn,
    lambda m: F.length(_digits(m)).between(9, 15),
)


def _kinded(matches: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"), valid(x["m"]).alias("ok")))


def base_matches(docs: DataFrame, text: str) -> DataFrame:
    """Adds __base: array of FOUND of all base matches, those that fail their check included."""
    t = F.col(text)
    asks = (F.contains(t, F.lit("@")), t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.lit(True), F.contains(t, F.lit("+")))
    df = docs
    for k, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        df = _found(df, text, pattern, f"__b{k}", asks[k])
    parts = [_kinded(f"__b{k}", k, VALID[k]) for k in range(4)]
    return df.withColumn("__base", F.array_sort(F.concat(*parts))).drop(*[f"__b{k}" for k in range(4)])


def more_candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds __more: array of FOUND (ok is false) that the generators propose."""
    t = F.col(text)
    df = df.withColumn("__n", t.rlike(r"[0-9](?:[ ./()-]{0,3}[0-9]){8}"))  # nine digits with little between
    many = F.col("__n")
    asks = (t.rlike(r"@|[(\[{<] ?(?:at|AT|At) ?[)\]}>]| dot | DOT "), t.rlike(r"[0-9] ?(?:[(\[{](?:\.|dot|DOT)[)\]}]|dot) ?[0-9]"), t.rlike(r"[0-9](?:[ ._/-]{0,3}[0-9]){11}"), many)
    for k, pattern in enumerate(MORE):
        df = _found(df, text, pattern, f"__c{k}", asks[k])
    parts = [_kinded(f"__c{k}", k, lambda m: F.lit(False)) for k in range(4)]
    return df.withColumn("__more", F.concat(*parts)).drop("__n", *[f"__c{k}" for k in range(4)])


def _by_kind(kind: Column, each: list[Column]) -> Column:
    return F.when(kind == 0, each[0]).when(kind == 1, each[1]).when(kind == 2, each[2]).otherwise(each[3])


def features(x: Column) -> Column:
    """Format and context of a candidate: array of doubles in the order of FEATURES.

    Of an address only how it is written counts; how many digits and parts it has tells where it comes from, not what it is.
    """
    kind, m, before = x["kind"], x["m"], x["before"]
    around = F.concat(F.right(before, F.lit(1)), x["after"])
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    longest = F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.length(g)))
    last = F.regexp_extract(m, "([A-Za-z]*)$", 1)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    said = lambda words: before.rlike(rf"(?i)\b(?:{words})[^A-Za-z0-9]{{0,3}}(?:is|at|no|number|me|us)?[^A-Za-z0-9]{{0,3}}$")
    written_out = [
        kind, F.when(_by_kind(kind, [said(c) for c in CUES]), 1.0).when(said(OTHER), -1.0).otherwise(0.0), flag(around.rlike("[A-Za-z0-9]")), flag(m.rlike(r"[ .-]{2}")),
        F.length(F.regexp_replace(m, "[^ ]", "")), F.length(F.regexp_replace(m, r"[^\[\](){}<>]", "")),
        flag(last.isin(ENDINGS) | last.isin([e.upper() for e in ENDINGS])), F.least(F.length(last), F.lit(8)), flag(m.rlike("[ .][A-Z][a-z]*$")), flag(m.rlike(r"[A-Za-z0-9]\. ")),
    ]
    number = [
        F.length(_digits(m)), F.length(m), F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), flag(m.rlike("^0+[^0-9]?0*$")), flag(_luhn(m)), F.size(groups), longest,
        F.aggregate(groups, F.lit(0.0), lambda a, g: F.greatest(a, F.least(g.cast("double"), F.lit(256.0)))), flag(m.rlike(r"^[0-9]{4}(?:[^0-9]{1,3}[0-9]{4}){2,3}(?:[^0-9]{1,3}[0-9]{1,3})?$")),
        flag(m.startswith("00")), flag(m.rlike(r"^\(?0[1-9]")), flag(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")), flag(m.rlike(r"^[1-9][0-9]{0,2}(?:[ .][0-9]{3}){2,}$")),
        flag(m.rlike(r"^(?:1[ ./-])?\(?[1-9][0-9]{2}\)?[ ./-]?[0-9]{3}[ ./-][0-9]{4}$")), flag(m.rlike("^97[89]") & (F.length(_digits(m)) == 13)),
    ]
    return F.array(*[c.cast("double") for c in written_out], *[F.when(kind == 0, 0.0).otherwise(c.cast("double")) for c in number])


def disguises(kind: Column, m: Column, ok: Column) -> Column:
    """Array of a match's disguised forms; of one that fails its check itself and, unless it is a number that never had a
    plus sign, one form picked by a hash."""
    host, user = F.substring_index(m, "@", -1), F.substring_index(m, "@", 1)
    dots = lambda text, by: F.replace(text, F.lit("."), F.lit(by))
    by_four = lambda by: F.regexp_replace(_digits(m), "([0-9]{4})(?=[0-9])", f"$1{by}")
    bare = F.regexp_replace(m, r"^\+", "")
    home = F.when(F.contains(m, F.lit("(")), F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]*", "")).otherwise(F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]+0?", "0"))
    marks = ((" (at) ", " [dot] "), ("[at]", "[dot]"), (" @ ", " . "), ("@", "(dot)"), ("(at)", "."), ("@", " (dot) "), ("@", "[dot]"), ("{at}", "{dot}"), (" [AT] ", " [DOT] "), (" at ", " dot "), (" (at) ", "."), ("<at>", "."), ("(at)", "(dot)"), ("@", " . "))
    each = (
        [F.concat(user, F.lit(at), dots(host, dot)) for at, dot in marks],
        [dots(m, by) for by in ("[.]", "(.)", "{.}", "[dot]", " (dot) ", " dot ")],
        [*[by_four(by) for by in (".", "--", "  ", "- ", " - ", "/", "_")], F.regexp_replace(m, "[ -]", "  "), F.regexp_replace(m, "[ -]", ".")],
        [F.concat(F.lit("00"), bare), bare, *[F.regexp_replace(x, "[ .-]+", by) for x in (bare, home) for by in ("-", ".", "/")], home, F.concat(F.lit("00"), F.regexp_replace(bare, "[ .()-]+", " "))],
    )

    def of(forms: list[Column]) -> Column:
        pick = F.pmod(F.xxhash64(m), F.lit(len(forms)))
        one = F.coalesce(*[F.when(pick == i, f) for i, f in enumerate(forms)])
        return F.array_distinct(F.when(ok, F.array(*forms)).when((kind < 3) | m.startswith("+"), F.array(m, one)).otherwise(F.array(m)))

    return _by_kind(kind, [of(forms) for forms in each])


# fixed values: how phone numbers of some countries are written, and numbers that are none (# a digit, * one from 2 to 9)
PHONES = ("+1 (*##) *##-####", "+1 *##-*##-####", "+1.*##.*##.####", "+49 30 #######", "+49 1*# #######", "+33 * ## ## ## ##", "+44 20 #### ####", "+44 7### ######", "+351 9## ### ###", "+34 6## ## ## ##", "+39 0* #### ####", "+55 11 9#### ####", "+91 9#### #####", "+81 3 #### ####", "+61 4## ### ###", "+41 44 ### ## ##")
NO_PHONES = ("#### #### ####", "####-####-####", "978-*-##-######-#", "979 * #### #### #", "19##-0*-1# 0*:1#", "20##.0*.1# 1*.3#", "3##.4##.*##.###", "*## ### ### ###", "*.###.###.###", "#-#-#-#-#-#-#-#-#", "######-######", "20##-20##-20##", "*#.##.##.##.##.##.##.##.##", "#### ## #### ## ##")
SYLLABLES = tuple(a + b for a in "b d f g k l m n r s t v".split() for b in "a e i o an er in ol us".split())


def formats(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """(kind, m, before, after, ok, draw): matches in public formats, and decoys of the same make, by rule from row numbers."""
    i, kind = F.col("id"), F.col("kind")
    roll = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n))
    pick = lambda salt, values: F.element_at(F.array(*[F.lit(v) for v in values]), (roll(salt, len(values)) + 1).cast("int"))
    df = spark.range(0, rows, 1, 4).withColumn("kind", (i % 4).cast("int")).withColumn("ok", roll("ok", 5) >= 2)
    df = df.withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.element_at(F.array(*map(F.lit, SYLLABLES)), (F.pmod(F.xxhash64(i, j), F.lit(len(SYLLABLES))) + 1).cast("int"))))
    df = df.withColumn("d", F.substring(F.concat(*[F.lpad(F.abs(F.xxhash64(i, F.lit(k))).cast("string"), 19, "7") for k in ("d", "e")]), 2, 37))
    word = lambda at, n: F.array_join(F.slice("s", at + 1, n), "")
    long = lambda at: F.when(roll(f"w{at}", 2) == 0, word(at, 1)).otherwise(word(at, 2))
    digits = lambda at, n: F.substring("d", at + 1, n)
    user = F.concat(word(0, 2), pick("u", ("", "", ".", "_", "-")), long(2), F.when(roll("n", 3) == 0, digits(0, 2)).otherwise(""))
    host = F.concat(F.when(roll("h", 3) == 0, F.concat(long(4), F.lit("."))).otherwise(""), word(6, 2), F.when(roll("m", 4) == 0, digits(3, 1)).otherwise(""))
    mail = F.concat(user, F.lit("@"), host, F.lit("."), pick("t", ENDINGS))
    said = pick("p", (0, 1, 2, 3))
    no_mail = _by_kind(said, [
        F.concat(long(0), pick("a", ("@", " @ ")), long(2), F.lit(". "), F.initcap(long(4))), F.concat(long(0), F.lit("@"), word(2, 2), pick("b", (".", ". ")), F.initcap(word(6, 1))),
        F.concat(pick("c", ("apples", "3", "units", "price", "12 kg")), pick("a", ("@", " @ ")), digits(0, 1), F.lit("."), digits(1, 2)), F.concat(user, F.lit("@"), word(6, 2), F.lit("."), word(8, 2)),
    ])
    part = lambda at: F.pmod(digits(at, 4).cast("int"), F.lit(256)).cast("string")
    ip = F.concat_ws(".", part(0), part(4), part(8), F.when(F.col("ok"), part(12)).otherwise((256 + roll("x", 700)).cast("string")))
    body = F.concat(pick("v", ("4", "51", "52", "34", "37", "6011", "35", "62")), digits(0, 30))
    body = F.left(body, pick("l", (15, 15, 15, 15, 14, 12, 18)) - 0)
    passing = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(body, c.cast("string"))), _luhn), 1)
    card = F.when(F.col("ok"), passing).otherwise(F.concat(body, F.pmod(F.right(passing, F.lit(1)).cast("int") + 1 + roll("y", 9), F.lit(10)).cast("string")))
    card = F.regexp_replace(card, "([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), pick("g", ("", " ", "-"))))
    shape = F.when(F.col("ok"), pick("f", PHONES)).otherwise(pick("f", NO_PHONES))
    fill = lambda c, j: F.when(c == "#", F.substring(F.col("d"), j + 1, F.lit(1))).when(c == "*", (F.substring(F.col("d"), j + 1, F.lit(1)).cast("int") % 8 + 2).cast("string")).otherwise(c)
    phone = F.array_join(F.transform(F.split(shape, ""), fill), "")
    own = _by_kind(kind, [pick("q", v) for v in (("mail ", "write to ", "contact: "), ("host ", "server ", "ip: "), ("card ", "visa ", "credit card: "), ("call ", "tel. ", "phone: "))])
    other = F.when((kind == 3) & ~F.col("ok"), pick("o", ("order ", "invoice no ", "isbn ", "id ", "total ", "ref. "))).otherwise(pick("o", ("see ", "the ", "and ", "", "was: ")))
    df = df.withColumn("m", _by_kind(kind, [F.when(F.col("ok"), mail).otherwise(no_mail), ip, card, phone]))
    return df.select("kind", "m", F.when((roll("z", 2) == 0) & (F.col("ok") | (kind != 3)), own).otherwise(other).alias("before"), pick("k", (" ", ".", ",", ")", "")).alias("after"), "ok", F.shiftrightunsigned(F.xxhash64(i), 2).alias("draw"))


def matches(docs: DataFrame, text: str, key: Column) -> DataFrame:
    """(kind, m, before, after, ok, draw) of all base matches of `docs`, those that fail their check included, and decoys."""
    df = base_matches(docs, text)
    of = lambda kind, m: F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.lit("see ").alias("before"), F.lit(" ").alias("after"), F.lit(False).alias("ok"))
    prose = F.regexp_replace(F.regexp_extract(F.col(text), r"\b([A-Za-z]{2,12} [A-Za-z]{2,12}\. ?[A-Za-z]{2,12})\b", 1), "^([A-Za-z]+) ", "$1@")
    date = F.regexp_extract(F.col(text), r"\b([0-9]{2,4}[-/.][0-9]{2}[-/.][0-9]{2,4})\b", 1)
    both = F.filter(F.array(of(0, prose), of(3, date)), lambda x: x["m"] != "")  # one of each for a document with matches
    own = F.transform("__base", lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "m", "before", "after", "ok")]))
    rows = df.where(F.size("__base") > 0).select(key.alias("key"), F.explode(F.concat(own, both)).alias("x"))
    return rows.select("x.*", F.shiftrightunsigned(F.xxhash64("key", "x.m"), 2).alias("draw"))


def labelled(rows: DataFrame) -> DataFrame:
    """`rows` of matches as (kind, f: features, label, and what else they hold) of what the generators find in their disguised
    forms. A find that stands in a form more than once is taken at its first place."""
    over = rows.where("kind = 1 and ok").withColumn("m", F.regexp_replace("m", "[0-9]+$", "777")).withColumn("ok", F.lit(False))
    rest = [c for c in rows.columns if c not in ("kind", "m", "before", "after", "ok", "draw")]
    forms = rows.unionByName(over).select("*", F.explode(disguises(F.col("kind"), F.col("m"), F.col("ok"))).alias("form"))
    forms = forms.select(*rest, F.col("kind").alias("of"), "ok", "form", F.length("before").alias("at"), F.concat("before", "form", "after").alias("text"))
    as_kind = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m.alias("m"))
    finds = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), as_kind(k)) for k, p in enumerate(MORE)]
    each = forms.select("*", F.explode(F.concat(*finds)).alias("c")).where(~F.col("c.m").rlike(DATE))
    each = each.withColumn("start", F.expr("if(instr(form, c.m) > 0, at + instr(form, c.m), instr(text, c.m)) - 1"))
    each = each.where("start < at + length(form) and start + length(c.m) > at")  # not what its context holds
    c = F.struct("c.kind", "c.m", F.right(F.left("text", F.col("start")), F.lit(NEAR)).alias("before"), F.expr("substring(text, start + length(c.m) + 1, 1)").alias("after"))
    right = F.col("ok") & (F.col("c.kind") == F.col("of")) & (F.col("c.m") == F.col("form"))
    return each.select(*rest, right.cast("double").alias("label"), c.alias("c")).select(*rest, "c.kind", F.transform(F.array("c"), features)[0].alias("f"), "label")  # in a lambda: as one generated method it is too long to be compiled


def _tree_arrays(node, depth: int) -> dict:
    """A fitted tree as a full one of `depth` levels: features and limits of inner nodes, values of leaves, level by level."""
    feature, limit, level = [], [], [node]
    for _ in range(depth):
        below = []
        for n in level:
            inner = n.subtreeDepth() > 0
            feature.append(n.split().featureIndex() if inner else 0)
            limit.append(n.split().threshold() if inner else 0.0)
            below += [n.leftChild(), n.rightChild()] if inner else [n, n]
        level = below
    return {"feature": feature, "limit": limit, "value": [n.prediction() for n in level]}


def _score_sql(model, depth: int) -> str:
    """The model's score of features {f} as SQL: a walk down each tree of one constant array, so the plan stays small."""
    trees = [{"weight": w, **_tree_arrays(t._java_obj.rootNode(), depth)} for w, t in zip(model.treeWeights, model.trees, strict=True)]
    kind = "array<struct<weight: double, feature: array<int>, limit: array<double>, value: array<double>>>"
    leaf = f"aggregate(sequence(1, {depth}), 0, (at, level) -> 2 * at + if({{f}}[t.feature[at]] <= t.limit[at], 1, 2)) - {2**depth - 1}"
    return f"round(1 / (1 + exp(-2 * aggregate(from_json('{json.dumps(trees)}', '{kind}'), 0D, (total, t) -> total + t.weight * t.value[{leaf}]))), 3)"


class Model(NamedTuple):
    score: str  # SQL over features {f}
    limits: list[float | None]  # by kind
    recall: list[float]  # by kind: share of the right finds among held public formats that the threshold accepts


def _lowest(counted: list, precision: float) -> float | None:
    """The lowest score at which `precision` of (score, n, right) are right."""
    n = right = 0
    best = None
    for r in sorted(counted, key=lambda r: -r["score"]):
        n, right = n + r["n"], right + r["right"]
        if right >= precision * n:
            best = max(r["score"], 0.5)
    return best


def learn(docs: DataFrame, text: str, key: Column, sample: int = 4000, trees: int = 12, depth: int = 5, precision: float = 0.99, recall: float = 0.5) -> Model:
    """Trees and thresholds. The fit reads, of the matches of each kind, those whose hash with `key` lies below a cut-off
    set from their number, one of each: about `sample`, and half of them at most, so that some stay for calibration."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = written(matches(docs, text, key))
    counts = rows.groupBy("kind").agg(F.approx_count_distinct("draw").alias("n"), F.count("*").alias("rows")).collect()  # 4 rows
    many = {r["kind"]: r["n"] for r in counts}
    tasks = min(20_000, 16 + sum(r["rows"] for r in counts) // 50_000)  # few short rows mean many rewritings
    cut = _by_kind(F.col("kind"), [F.lit(int(min(0.5, sample / max(1, many.get(k, 0))) * (1 << 62))) for k in range(4)])
    public = formats(docs.sparkSession).withColumn("fit", F.col("draw") < 1 << 61)
    names = ("kind", "m", "before", "after", "ok", "draw")
    drawn = rows.where(F.col("draw") < cut).groupBy("draw").agg(*[F.any_value(c).alias(c) for c in names if c != "draw"])
    known = written(labelled(drawn.unionByName(public.where("fit").drop("fit")).repartition(16)))
    vectors = known.select(array_to_vector("f").alias("features"), "label")
    score = _score_sql(GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5).fit(vectors), depth)
    held = rows.where(F.col("draw") >= cut).withColumn("public", F.lit(False)).unionByName(public.where("not fit").drop("fit").withColumn("public", F.lit(True)))
    scored = labelled(held.repartition(tasks)).select("public", "kind", "label", F.expr(f"transform(array(f), f -> {score.replace('{f}', 'f')})[0]").alias("score"))  # features once, not at each node
    counted = scored.groupBy("public", "kind", "score").agg(F.count("*").alias("n"), F.sum("label").alias("right")).collect()  # 2 * 4 * 1001 rows at most
    limits, found = [], []
    for k in range(4):
        both = [[r for r in counted if r["kind"] == k and r["public"] == p] for p in (True, False)]
        enough = sum(r["right"] for r in both[1]) * (1 - precision) >= 1  # fewer finds of the table can't show this precision
        each = [_lowest(c, precision) for c in (both if enough else [both[0] + both[1]])]
        limit = max(each) if all(each) else None
        share = sum(r["right"] for r in both[0] if limit is not None and r["score"] >= limit) / max(1, sum(r["right"] for r in both[0]))
        found.append(share)
        limits.append(limit if share >= recall else None)
    return Model(score, limits, found)


def train(docs: DataFrame, text: str, key: Column, sample: int = 4000) -> tuple[str, list[float | None]]:
    """(score as SQL over features {f}, threshold of each kind or None)."""
    return learn(docs, text, key, sample)[:2]


SPAN = "struct<start: int, kind: int, end: int, m: string>"
_LAST = 2**31 - 1


def _apart(df: DataFrame, spans: str, base: str) -> DataFrame:
    """Drops the candidates of `spans` that overlap a span of `base`: one pass forward past ends, one backward past starts."""
    kind = f"array<struct<start: int, own: int, end: int, x: {FOUND}>>"
    none = F.array().cast(kind)

    def tagged(name: str, own: int) -> Column:
        return F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), (x if own else F.lit(None).cast(FOUND)).alias("x")))

    def past_ends(end: Column, e: Column) -> tuple[Column, Column]:
        return F.when(e["own"] == 0, F.greatest(end, e["end"])).otherwise(end), F.when((e["own"] == 0) | (e["start"] >= end), F.array(e)).otherwise(none)

    def past_starts(start: Column, e: Column) -> tuple[Column, Column]:
        return F.when(e["own"] == 0, e["start"]).otherwise(start), F.when((e["own"] == 1) & (e["end"] <= start), F.array(e)).otherwise(none)

    df = df.withColumn("__all", F.when(F.size(spans) > 0, F.array_sort(F.concat(tagged(base, 0), tagged(spans, 1)))).otherwise(none))
    df = df.withColumn("__all", F.reverse(_fold(F.col("__all"), F.lit(0), past_ends, kind)))
    df = df.withColumn("__all", F.reverse(_fold(F.col("__all"), F.lit(_LAST), past_starts, kind)))
    return df.withColumn(spans, F.transform("__all", lambda e: e["x"])).drop("__all")


def _best(df: DataFrame, scored: str) -> DataFrame:
    """Of overlapping (x, score), by start, the one with the best score, then the first: the last one kept gives way to a better."""
    one = f"struct<x: {SPAN}, score: double>"

    def step(last: Column, e: Column) -> tuple[Column, Column]:
        apart = last.isNull() | (e["x"]["start"] >= last["x"]["end"])
        done = F.when(apart & last.isNotNull(), F.array(last)).otherwise(F.array().cast(f"array<{one}>"))
        return F.when(apart | (e["score"] > last["score"]), e).otherwise(last), done

    stop = F.struct(F.struct(F.lit(_LAST).alias("start"), F.lit(0).alias("kind"), F.lit(_LAST).alias("end"), F.lit("").alias("m")).alias("x"), F.lit(0.0).alias("score"))
    df = df.withColumn(scored, F.when(F.size(scored) > 0, F.concat(scored, F.array(stop))).otherwise(F.col(scored)))
    return df.withColumn(scored, F.transform(_fold(F.col(scored), F.lit(None).cast(one), step, f"array<{one}>"), lambda e: e["x"]))


def pii(docs: DataFrame, text: str = "text", sample: int = 4000) -> DataFrame:
    """`docs` with pii_base and pii_spans added: arrays of (start, kind, end, m) by start and kind (number in KINDS).

    Places are in code points, end exclusive; base spans are among pii_spans, added spans overlap none of them nor each
    other. Null texts are empty; an empty table gives an empty result; all other columns stay, whatever their names
    (columns of `docs` with the added names are replaced). Repeated rows have equal spans.
    """
    names = [c for c in docs.columns if c not in ("pii_base", "pii_spans")]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    score, limits = train(df, "text", F.xxhash64("text"), sample)
    own = [F.col(f"row.`{c}`").alias(c) for c in names]
    plain = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["m"].alias("m"))
    df = base_matches(df, "text")
    df = df.withColumn("pii_base", F.transform(F.filter("__base", lambda x: x["ok"]), plain)).drop("__base")
    if not score or not any(limits):
        return df.select(*own, "pii_base", F.col("pii_base").alias("pii_spans"))
    df = more_candidates(df, "text").withColumn("__more", F.filter("__more", lambda x: ~x["m"].rlike(DATE)))
    df = _apart(df, "__more", "pii_base")
    df = df.withColumn("__more", F.transform("__more", lambda x: F.struct(plain(x).alias("x"), features(x).alias("f"))))
    df = df.withColumn("__more", F.expr(f"transform(__more, e -> struct(e.x as x, {score.replace('{f}', 'e.f')} as score))"))
    least = "CASE " + " ".join(f"WHEN e.x.kind = {k} THEN {limits[k] if limits[k] is not None else 2.0}D" for k in range(4)) + " END"
    df = _best(df.withColumn("__more", F.expr(f"filter(__more, e -> e.score >= {least})")), "__more")
    return df.select(*own, "pii_base", F.array_sort(F.concat("pii_base", "__more")).alias("pii_spans"))


def _joined(spans: str) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str, spans: str) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one's stays.

    Cuts go by chunks of spans, each out of its own stretch of the text, as a cut walks from the start of its string.
    """
    t, whole = F.coalesce(F.col(text), F.lit("")), F.col(spans)
    tag = lambda x: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)), F.lit("]"))
    none = F.array().cast("array<string>")

    def chunk(a: Column, k: Column) -> Column:
        mine = F.slice(whole, k * CHUNK + 1, F.lit(CHUNK))
        stretch = F.struct(a["at"].alias("at"), F.substring(t, a["at"] + 1, F.array_max(F.transform(mine, lambda x: x["end"])) - a["at"]).alias("t"))
        begun = F.struct(a["at"].alias("at"), none.alias("out"))

        def step(s: Column, b: Column, x: Column) -> Column:
            piece = F.when(x["start"] >= b["at"], F.array(F.substring(s["t"], b["at"] - s["at"] + 1, x["start"] - b["at"]), tag(x))).otherwise(none)
            return F.struct(F.greatest(b["at"], x["end"]).alias("at"), F.concat(b["out"], piece).alias("out"))

        done = F.element_at(F.transform(F.array(stretch), lambda s: F.aggregate(mine, begun, lambda b, x: step(s, b, x))), 1)
        return F.struct(done["at"].alias("at"), F.concat(a["out"], F.array(F.array_join(done["out"], ""))).alias("out"))

    chunks = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    done = F.aggregate(chunks, start, chunk, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    return F.when(F.size(whole) > 0, done).otherwise(F.col(text))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digest of base spans, and all spans, of every document."""
    found = pii(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(_joined("pii_base"), 256).alias("base_sha256"), _joined("pii_spans").alias("spans"))
