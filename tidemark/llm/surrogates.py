"""Personal data replaced by keyed surrogates of the same kind, script and format.

Entities are found by patterns: mail addresses, telephone numbers, network addresses, card
and account numbers, social security numbers, and names after a form of address.  An entity
is known by its canonical form (digits of a number, lower case of an address, each word of
a name), so the same person or number gets the same surrogate in every document, however it
is written.  Telephone numbers with and without the country code 1 are one; all others are
known by their whole number and keep their country code.  The words of a document's names are
replaced wherever else they stand in it with a capital letter, with or without ``'s``.  A given
name after a form of address for any gender is known apart from the same one of a gender.  The surrogate follows from a secret key and the canonical form; it is written in
the format of the place it stands in: punctuation, country code, length, letter case, number
of octet digits, check digit of a card.  A name's surrogate has the gender of its form of
address and the script of its letters.

Different entities never share a surrogate, and no surrogate is an entity of the data: of
those that clash, all but the least get the next one of their key, in rounds over the table
of distinct entities.  After ``STRICT`` rounds a format is let go that has too few values:
numbers and names get longer with each round, and octets take any size.  After ``ROUNDS``
rounds, which only network addresses can reach, the job ends with an error.

Everything is column expressions and joins.  Texts with entities are written once; only they
are shuffled, by a digest of the text, so copies of a text are worked on once.  Without a key
a random one is drawn for the call.

Cases: a null text stays null; a text without entities stays as it is; rows equal in text
get equal texts; matches do not overlap, the leftmost wins; long texts are replaced whole;
an empty table gives an empty one; other columns are kept, ``n_chars`` follows the text.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

STRICT = 4
ROUNDS = 40
# Forms of address by gender, in several languages.
MALE = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Signora", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Doctor", "Prof", "Professor", "Доктор", "Δρ"]
# The country codes of two digits; 1 and 7 have one, all others have three.
TWO_DIGITS = [20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58]
TWO_DIGITS += [60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98]
ADDRESS = "(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + ")"
# Forms of address for any gender may follow another one.
TITLES = rf"{ADDRESS}\.? (?:(?:{'|'.join(sorted(NEUTRAL, key=len, reverse=True))})\.? )*"
WORD = r"\p{Lu}(?:\p{L}+|(?=['-]))(?:['-]\p{L}{2,})*"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,8}\.[A-Za-z]{2,}",
    r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\d)",
    r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])",
    rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])\d{13,19}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9-])\d{4}([ -])\d{4}\2\d{4}\2\d{1,4}(?:\2\d{1,3})?(?![A-Za-z0-9])",
    rf"(?<!\p{{L}}){TITLES}{WORD}(?: {WORD}){{0,2}}",
]
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS)
#: What every entity has; far cheaper to look for than the entities.
HINT = r"[0-9]{3}|[0-9]\.[0-9]|\+[2-9]|[A-Z]{2}[0-9]{2}"
ADDRESSED = rf"(?=[{''.join(sorted({w[0] for w in MALE + FEMALE + NEUTRAL}))}])(?<!\p{{L}}){ADDRESS}\.? \p{{Lu}}"
KINDS = ["email", "phone", "ip", "ssn", "iban", "card", "name"]
# Syllables that names are made of, by script: of the stem, and endings by kind.
SYLLABLES = {
    "latin": (
        ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"],
        {"given_m": ["lan", "ric", "mon", "tor"], "given_f": ["lia", "rina", "mona", "tessa"], "given_n": ["el", "an", "is", "en"], "family": ["ley", "berg", "mont", "ez"]},
    ),
    "cyrillic": (
        ["ба", "ве", "ди", "жо", "гу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"],
        {"given_m": ["лан", "рик", "мир", "тор"], "given_f": ["лия", "рина", "мила", "тая"], "given_n": ["ель", "ан", "ис", "ен"], "family": ["енко", "чук", "ян", "дзе"]},
    ),
    "greek": (
        ["βα", "γε", "δι", "ζο", "κυ", "λα", "με", "νι", "πο", "ρυ", "σα", "τε", "φι", "χο", "θα", "ξε"],
        {"given_m": ["λος", "ρης", "νας", "τωρ"], "given_f": ["λία", "ρίνα", "μόνα", "τη"], "given_n": ["ελ", "αν", "ις", "εν"], "family": ["ίδη", "άκη", "ούλη", "έα"]},
    ),
}

PART = "struct<kind:string,canon:string,prefix:string,raw:string>"


# ---------------------------------------------------------------- detection


def kind_of(match: Column) -> Column:
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(rf"^{ADDRESS}\.? "), "name")
        .when(match.rlike(r"^\d+\.\d+\.\d+\.\d+$") & ~match.rlike(r"^\d{3}\.\d{3}\.\d{4}$"), "ip")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(match.rlike(r"^[A-Z]{2}\d\d"), "iban")
        .when(match.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .otherwise("card")
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def parts_of(match: Column) -> Column:
    """The entities of a match, in order; each with what stands before it inside the match.

    A name is one entity per word: the last word is the family name, the others are given
    names of the gender that the form of address says.
    """
    kind = kind_of(match)
    number = digits(match)
    abroad = match.startswith("+") & ~(match.startswith("+1") & (F.char_length(number) == 11))
    canon = (
        F.when(kind == "email", F.lower(match))
        .when(kind == "ip", match)
        .when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
        .when((kind == "phone") & abroad, F.concat(F.lit("+"), number))
        # A number with and without the country code 1 is one.
        .when(kind == "phone", F.right(number, F.lit(10)))
        .otherwise(number)
    )
    single = F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.lit("").alias("prefix"), match.alias("raw")))
    titles = F.regexp_extract(match, rf"^{TITLES}(?=\p{{Lu}})", 0)
    words = F.split(F.substr(match, F.char_length(titles) + 1), " ")
    first = F.regexp_extract(titles, r"^[^. ]+", 0)
    gender = F.when(first.isin(MALE), "given_m").when(first.isin(FEMALE), "given_f").otherwise("given_n")

    def word(w: Column, i: Column) -> Column:
        script = F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
        part = F.when(i == F.size(words) - 1, "family").otherwise(gender)
        return F.struct(
            F.concat(part, F.lit("_"), script).alias("kind"),
            F.lower(w).alias("canon"),
            F.when(i == 0, titles).otherwise(F.lit(" ")).alias("prefix"),
            w.alias("raw"),
        )

    return F.when(kind == "name", F.transform(words, word)).otherwise(single).cast(f"array<{PART}>")


# ---------------------------------------------------------------- surrogates


def _number(digest: Column, place: Column) -> Column:
    """Number below 256 from a place of a hex digest; places go round."""
    return F.conv(F.substr(digest, F.pmod(place, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))))


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256)


def _same_shape(value: Column, digest: Column) -> Column:
    """Letters for letters (lower case), digits for digits, other characters kept."""

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i) + i
        return (
            F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), F.char(F.pmod(n, F.lit(26)) + 97))
            .when(c.rlike("[A-Z]"), F.char(F.pmod(n, F.lit(26)) + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(value: Column) -> Column:
    """Sum of a check-digit number, every second digit from the right doubled."""
    size = F.char_length(value)
    each = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(F.pmod(size - i, F.lit(2)) == 1, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def surrogate(kind: Column, canon: Column, nonce: int, key: str) -> Column:
    """The canonical form of an entity's surrogate in a round."""
    digest = _digest(key, kind, canon, F.lit(nonce))
    loose = nonce >= STRICT
    more = F.substr(digest, F.lit(60 - 4 * min(nonce, 10)), F.lit(max(1, nonce - STRICT + 2))) if loose else F.lit("")
    longer = F.translate(more, "abcdef", "012345")
    # Addresses of one domain stay addresses of one domain, under a name that is reserved.
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    host = F.concat(_same_shape(host, _digest(key, F.lit("domain"), domain)), F.lit(".example"))
    email = F.concat(_same_shape(local, digest), more, F.lit("@"), host)
    number = _same_shape(canon, digest)
    # After its country code a number starts with 2 to 9.
    code = (
        F.when(~canon.startswith("+"), 0)
        .when(canon.rlike(r"^\+[17]"), 2)
        .when(F.substr(canon, F.lit(2), F.lit(2)).isin([str(c) for c in TWO_DIGITS]), 3)
        .otherwise(4)
    )
    start = (F.pmod(_number(digest, F.lit(30)), F.lit(8)) + 2).cast("string")
    phone = F.concat(F.left(canon, code), start, F.substr(number, code + 2), longer)
    body = F.concat(F.left(canon, F.lit(1)), F.substr(number, F.lit(2), F.char_length(canon) - 2), longer)
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.concat(body, F.when(F.pmod(_luhn_sum(canon), F.lit(10)) == 0, check).otherwise(F.right(number, F.lit(1))))
    octets = F.transform(
        F.split(canon, r"\."),
        lambda o, i: (
            F.when(F.lit(loose), F.pmod(_number(digest, i), F.lit(254)) + 1)
            .when(F.char_length(o) == 1, F.pmod(_number(digest, i), F.lit(9)) + 1)
            .when(F.char_length(o) == 2, F.pmod(_number(digest, i), F.lit(90)) + 10)
            .otherwise(F.pmod(_number(digest, i), F.lit(155)) + 100)
            .cast("string")
        ),
    )
    iban = F.concat(F.left(canon, F.lit(2)), F.substr(number, F.lit(3)), longer)
    out = (
        F.when(kind == "email", email)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "iban", iban)
        .when(kind == "ssn", F.concat(number, longer))
    )
    for script, (stems, endings) in SYLLABLES.items():
        for part, ends in endings.items():
            length = 3 if loose else 2
            stem = F.concat(*[_pick(stems, _number(digest, F.lit(i))) for i in range(length + max(0, nonce - STRICT))])
            out = out.when(kind == f"{part}_{script}", F.concat(stem, _pick(ends, _number(digest, F.lit(20)))))
    return out


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities, one to one and off the entities."""
    taken = entities.select("kind", F.col("canon").alias("surrogate"))
    pending, done, nonce = entities, [], 0
    while nonce < ROUNDS:
        made = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), nonce, key))
        least = made.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        free = least.join(taken, ["kind", "surrogate"], "left_anti")
        for earlier in done:
            free = free.join(earlier, ["kind", "surrogate"], "left_anti")
        done.append(materialize(free.select("kind", "canon", "surrogate"), "surrogates"))
        pending = materialize(pending.join(done[-1], ["kind", "canon"], "left_anti"), "pending")
        if pending.isEmpty():
            return reduce(DataFrame.union, done)
        nonce += 1
    raise RuntimeError(f"no surrogates are left for some entities after {ROUNDS} rounds")


def _in_digits(raw: Column, wanted: Column, canon: Column) -> Column:
    """``raw`` with the digits of ``canon``, its last ones, replaced by the wanted ones.

    One for one; what the wanted ones have more follows at the end.
    """
    size, total = F.char_length(digits(canon)), F.char_length(digits(raw))
    numbers = digits(wanted)

    def one(c: Column, i: Column) -> Column:
        place = F.char_length(digits(F.substr(raw, F.lit(1), i + 1))) - (total - size)
        return F.when(c.rlike("[0-9]") & (place > 0), F.substr(numbers, place, F.lit(1))).otherwise(c)

    return F.concat(F.array_join(F.transform(F.split(raw, ""), one), ""), F.substr(numbers, size + 1))


def written(kind: Column, raw: Column, wanted: Column, canon: Column) -> Column:
    """The surrogate in the format of the place it stands in."""
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    places = F.transform(
        F.split(raw, ""),
        lambda c, i: F.when(c == " ", c).otherwise(
            F.substr(wanted, F.char_length(F.replace(F.substr(raw, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))
        ),
    )
    return (
        F.when(kind.isin("phone", "card", "ssn"), _in_digits(raw, wanted, canon))
        .when(kind == "ip", wanted)
        .when(kind == "iban", F.concat(F.array_join(places, ""), F.substr(wanted, F.char_length(canon) + 1)))
        .when(upper, F.upper(wanted))
        .when(kind == "email", wanted)
        .otherwise(F.initcap(wanted))
    )


# ---------------------------------------------------------------- replacement


def _named_again(text: Column, names: Column) -> Column:
    """The words of ``names``, a map from words to surrogates, replaced in a piece of text."""
    inside = r"[\p{L}'’-]"
    pieces = F.split(text, rf"(?<!{inside})(?=\p{{Lu}})|(?<={inside})(?!{inside})", -1)

    def one(piece: Column) -> Column:
        bare = F.regexp_replace(piece, r"(?:['’][sS]?|-+)$", "")
        head = F.when(F.element_at(names, F.lower(piece)).isNotNull(), piece).otherwise(bare)
        new = F.element_at(names, F.lower(head))
        shown = F.when((head == F.upper(head)) & (F.char_length(head) > 1), F.upper(new)).otherwise(F.initcap(new))
        again = F.concat(shown, F.substr(piece, F.char_length(head) + 1))
        return F.when(piece.rlike(r"^\p{Lu}") & new.isNotNull(), again).otherwise(piece)

    return F.when(names.isNull(), text).otherwise(F.array_join(F.transform(pieces, one), ""))


def replaced(docs: DataFrame, key: str | None = None, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with every entity of the text replaced; with ``counts``, how many of each kind.

    The counts are columns ``n_<kind>``, which replace columns of those names; a name counts
    where it follows a form of address.
    """
    key = key or secrets.token_hex(16)
    names = [f"n_{k}" for k in KINDS] if counts else []
    rest = [c for c in docs.columns if c.lower() not in names]
    own = F.col(f"`{text_col}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), own.alias("text"), F.md5(own).alias("key")
    )
    text = F.col("text")
    has_entity = (text.contains("@") | text.rlike(HINT) | text.rlike(ADDRESSED)) & text.rlike(ENTITY)
    private = materialize(rows.where(has_entity), "private")
    matches = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    found = private.select("key", F.posexplode(matches).alias("at", "match")).distinct()
    found = materialize(
        found.select("key", "at", F.posexplode(parts_of(F.col("match"))).alias("part", "p")).select(
            "key", "at", "part", "p.*"
        ),
        "entities",
    )
    known = assign(materialize(found.select("kind", "canon").distinct(), "distinct"), key)
    new = F.concat("prefix", written(F.col("kind"), F.col("raw"), F.col("surrogate"), F.col("canon"))).alias("new")
    assigned = materialize(found.join(known, ["kind", "canon"]), "assigned")
    pieces = assigned.select(
        "key", "at", F.struct("part", new).alias("piece"), F.when(F.col("part") == 0, F.col("kind")).alias("kind")
    )
    # A word that is a given and a family name stands for the family.
    words = assigned.where(F.col("kind").rlike("^(?:given|family)_")).groupBy("key", "canon")
    words = words.agg(F.min(F.struct("kind", "surrogate")).alias("_first")).select("key", "canon", "_first.surrogate")
    names_of_text = words.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("canon", "surrogate"))).alias("names"))
    in_order = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["new"])
    of_match = pieces.groupBy("key", "at").agg(F.array_join(in_order, "").alias("new"), F.max("kind").alias("kind"))
    # A text's matches in order: one for each gap but the last.
    of_text = of_match.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "new", "kind"))).alias("matches"))
    joined = private.join(materialize(of_text.join(names_of_text, "key", "left"), "matches"), "key")
    gaps = F.transform(F.split("text", ENTITY, -1), lambda g: _named_again(g, F.col("names")))
    after = F.zip_with(gaps, "matches", lambda g, m: F.concat(g, F.coalesce(m["new"], F.lit(""))))

    def count(kind: str) -> Column:
        own = ("given", "family") if kind == "name" else (kind,)
        of = lambda m: F.substring_index(m["kind"], "_", 1).isin(*own)
        return F.size(F.filter("matches", of)).cast("long")

    changed = joined.select(
        "row", F.array_join(after, "").alias("text"), *[count(k).alias(n) for k, n in zip(KINDS, names)]
    )
    same = rows.where(~F.coalesce(has_entity, F.lit(False)))
    same = same.select("row", "text", *[F.lit(0).cast("long").alias(n) for n in names])
    columns = []
    for c in rest:
        if c == text_col:
            columns.append(F.col("text").alias(c))
        elif c == "n_chars":
            columns.append(F.char_length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return changed.union(same).select(*columns, *names)
