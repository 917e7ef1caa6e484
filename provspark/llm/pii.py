"""Surrogates for personal data.

Entities (e-mail addresses, phone numbers with an area code, card numbers, IP
addresses of both versions, national ids, IBANs, secret tokens, names after a
title) are found by one pattern; a document's titled names are found without
title in the same document too, whole, by their first words or by their last
one, as they were written or all in capitals, and a title with the last word
alone is the same person. Card numbers pass their check, account
numbers theirs, private addresses stay private. Each
gets a keyed surrogate of its own type and format: digits stay digits, letters
stay letters of their case, separators stay; names keep their word count, the
title's gender, their script and capitals throughout. One normal form (case folded, digits only,
...) has one surrogate in the whole corpus, so coreference survives. Distinct
forms get distinct surrogates that are no real form of the corpus either: the
corpus' entity table is checked for collisions and those that collide draw
again.

Built of column expressions only. Defined results: null text stays null; text
without entities is unchanged to the byte; ids play no part, so null and
repeated ids and rows are treated alike; an empty table gives no rows; further
columns pass through. Names that begin with ``_pii_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import written

#: The key of the registered query; callers of ``replace`` bring a secret of their own.
QUERY_KEY = "op8"
MAX_DRAWS = 20

#: Titles by gender.
FEMALE = "Mrs|Ms|Miss|Frau|Mme|Mlle|Señora|Sra|Doña|Госпожа"
MALE = "Mr|Herr|Señor|Sr|Don|Monsieur|Господин"
NEUTRAL = "Dr|Prof"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}+"
SECRET = r"(?<![\p{L}\p{N}])(?=[0-9a-fA-F]{0,31}[0-9])[0-9a-fA-F]{32,128}+(?![\p{L}\p{N}])"
#: Keys with known prefixes, JSON web tokens, and 40 or more characters of base64 with digits and letters of both cases.
PREFIX = r"(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|npm_|hf_|xox[abeoprs]-|(?:sk|pk|rk)[-_](?:live[-_]|test[-_]|proj-|ant-)?)"
TOKEN = rf"(?<![\p{{L}}\p{{N}}_+/.-])(?:{PREFIX}(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{{16,}}+|eyJ[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+|(?=[A-Za-z0-9])(?=[A-Za-z0-9+/]{{40}})(?=[A-Za-z+/]*+[0-9])(?=[A-Z0-9+/]*+[a-z])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]++={{0,2}})(?![\p{{L}}\p{{N}}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP = r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\p{N})"
IP6 = r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F]{0,4}:)(?=[a-fA-F:]*+[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|(?:[0-9a-fA-F]{1,4}:){2,7}:|:(?::[0-9a-fA-F]{1,4}){2,7})(?![\p{L}\p{N}]|:[\p{L}\p{N}:])"
CARD = r"(?<![\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{N}])"
PHONE = r"(?<![\p{N}+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\p{N}])|(?<![\p{N}])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\p{N}])"
#: Without country code and parentheses: 555-123-4567, 030 1234567, 01 23 45 67 89, 020 7946 0958; at most 12 digits.
LOCAL = "(?<![\\p{L}\\p{N}+])(?<![\\p{N}][.,-])(?:" + "|".join(rf"(?:1{x})?[2-9][0-9]{{2}}{x}[0-9]{{3}}{x}[0-9]{{4}}|0[0-9](?:{x}[0-9]{{2}}){{4}}|0[0-9]{{2,4}}{x}[0-9]{{3,4}}{x}[0-9]{{3,4}}|0[0-9]{{2,3}}(?:{x}[0-9]{{2}}){{3,4}}" for x in (" ", "-", "[.]")) + "|0[0-9]{2,4}[ /-][0-9]{5,7})(?![\\p{L}\\p{N}]|[.,-][0-9])"
NATIONAL = r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])"
TITLES = rf"(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.? )+"
#: Words of names: capitals inside, apostrophes (not the genitive's), particles, initials before another word.
PARTICLES = r"(?:(?:van|von|vom|zu|zur|der|den|de|del|della|di|da|dos|das|du|la|le|el|al|bin|ibn|ter|ten|y) ){0,3}"
PART = r"(?:[dl]['’])?\p{Lu}(?:\p{L}++|(?=['’](?!s(?!\p{L}))\p{L}))(?:['’](?!s(?!\p{L}))\p{L}++)*+"
INITIALS = r"(?:\p{Lu}\.[ -]?(?=\p{Lu}))*+"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLES}(?:\p{{Lu}} (?=\p{{Lu}}))?{INITIALS}{PARTICLES}{PART}(?:[ -]{INITIALS}{PARTICLES}{PART})*+(?![\p{{L}}\p{{N}}])"
#: What begins with a letter begins a word; what does not, begins with one of a few characters. Most places of a text fail either test at once.
ENTITY = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{L}})(?:{'|'.join((EMAIL, SECRET, TOKEN, IBAN, IP6, NAME))})|(?=[\p{{N}}+(:_%-])(?:{'|'.join((EMAIL, SECRET, TOKEN, IP, IP6, PHONE, CARD, NATIONAL, LOCAL))})"
TITLE = rf"^{TITLES}"
#: The private address ranges.
PRIVATE = r"^(?:10[.]|127[.]|192[.]168[.]|172[.](?:1[6-9]|2[0-9]|3[01])[.])"


def entity_type(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email").when(e.rlike(TITLE), "name").when(e.rlike(f"^(?:{IP})$"), "ip").when(e.rlike(f"^(?:{NATIONAL})$"), "national")
        .when(e.rlike("^[0-9a-fA-F:]*::?[0-9a-fA-F:]*$"), "ip6")
        .when(e.rlike(r"^[0-9a-fA-F]{32,128}$") & ~e.rlike(r"^[A-Z]{2}[0-9]{2}"), "secret").when(e.rlike(f"^(?:{TOKEN})$"), "token").when(e.rlike(r"^[A-Z]{2}"), "iban")
        .when(e.contains("(") | e.startswith("+") | (F.length(F.regexp_replace(e, "[^0-9]", "")) < 13), "phone").otherwise("card")
    )


def normal_form(e: Column, kind: Column) -> Column:
    """What mentions of one entity have in common: ``type:`` and the bare form. A name keeps its title's gender."""
    gender = F.when(e.rlike(rf"^(?:{FEMALE})\b"), "f").when(e.rlike(rf"^(?:{MALE})\b"), "m").otherwise("n")
    bare = (
        F.when(kind == "name", F.concat(gender, F.lit(":"), F.lower(F.regexp_replace(e, TITLE, ""))))
        .when(kind.isin("phone", "card"), F.regexp_replace(e, r"[^0-9]", "")).when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "ip6", spelt_out(e)).when(kind == "token", e).otherwise(F.lower(e))
    )
    return F.concat(kind, F.lit(":"), bare)


def spelt_out(e: Column) -> Column:
    """An IPv6 address with all its eight groups, without leading zeros."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(e, "::", 1)), groups(F.when(e.contains("::"), F.substring_index(e, "::", -1)).otherwise(""))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")), ":")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keyed(form: Column, draw: Column, key: str) -> Column:
    """256 characters of hex that depend on the key, the form and the draw."""
    seed = F.concat(F.lit(f"{key}|"), draw.cast("string"), F.lit("|"), form)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")).cast("binary"), 256) for i in range(4)])


def _number(hexes: Column, at: Column | int) -> Column:
    """Two hex digits from place ``at`` on, as a number up to 255."""
    digits = "0123456789abcdef"
    one = lambda k: F.instr(F.lit(digits), F.substring(hexes, k, F.lit(1))) - 1
    at = F.lit(at) if isinstance(at, int) else at
    return one(at) * 16 + one(at + 1)


def scrambled(text: Column, hexes: Column, letters: bool) -> Column:
    """Each ASCII digit (and letter) of ``text`` replaced by another of its kind; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        return bound(_number(hexes, (i * 2) % 254 + 1), lambda n: of_kind(c, n))

    def of_kind(c: Column, n: Column) -> Column:
        pick = lambda alphabet: F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))
        out = F.when(c.rlike("[0-9]"), pick("0123456789"))
        if letters:
            out = out.when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            out = out.when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрст")).when(c.rlike(r"\p{L}"), pick("aeiouy"))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def hex_scrambled(text: Column, hexes: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        h = F.substring(hexes, (i + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[A-F]"), F.upper(h)).otherwise(h)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def made_name(words: Column, gender: Column, hexes: Column) -> Column:
    """A pronounceable name with as many words, the script and the gender's ending."""
    return bound(words.rlike(r"\p{IsCyrillic}"), lambda cyrillic: _name(words, gender, hexes, cyrillic))


def _name(words: Column, gender: Column, hexes: Column, cyrillic: Column) -> Column:
    def syllable(n: Column) -> Column:
        latin = F.concat(F.substring(F.lit("bdfghjklmnprstvz"), (n % 16 + 1).cast("int"), F.lit(1)), F.substring(F.lit("aeioua"), (F.floor(n / 16) % 6 + 1).cast("int"), F.lit(1)))
        slavic = F.concat(F.substring(F.lit("бвгджзклмнпрстфх"), (n % 16 + 1).cast("int"), F.lit(1)), F.substring(F.lit("аеиоуа"), (F.floor(n / 16) % 6 + 1).cast("int"), F.lit(1)))
        return F.when(cyrillic, slavic).otherwise(latin)

    end = F.when(gender == "f", F.when(cyrillic, "ла").otherwise("la")).when(gender == "m", F.when(cyrillic, "н").otherwise("n")).otherwise(F.lit(""))

    def word(w: Column, i: Column) -> Column:
        made = F.concat(*[bound(_number(hexes, i * 8 + 1 + 2 * k), syllable) for k in range(4)], F.when(i == 0, end).otherwise(F.lit("")))
        return F.initcap(made)

    return F.array_join(F.transform(F.split(words, "[ -]"), word), " ")


def surrogate(e: Column, kind: Column, form: Column, draw: Column, key: str) -> Column:
    """The replacement of mention ``e``."""
    return bound(keyed(form, draw, key), lambda hexes: _surrogate(e, kind, form, hexes))


def _surrogate(e: Column, kind: Column, form: Column, hexes: Column) -> Column:
    # an address: letters and digits of both names change, the top-level domain stays
    top = F.substring_index(e, ".", -1)
    body = F.substring(e, F.lit(1), F.length(e) - F.length(top))
    octets = F.array(*[_number(hexes, 1 + 2 * i).cast("string") for i in range(4)])
    home = F.regexp_extract(e, PRIVATE, 0)  # a private address stays one
    kept = F.size(F.split(home, "[.]")) - 1
    own = F.concat(home, F.array_join(F.slice(octets, kept + 1, 4 - kept), "."))
    title = F.regexp_extract(e, TITLE, 0)
    return (
        F.when(kind == "email", F.concat(scrambled(F.lower(body), hexes, True), top)).when(kind == "ip", own)
        .when(kind == "ip6", F.concat_ws(":", *[F.substring(hexes, 1 + 4 * i, 4) for i in range(8)]))
        .when(kind == "token", bound(F.regexp_extract(e, f"^(?:{PREFIX}|eyJ)?", 0), lambda start: F.concat(start, scrambled(F.substring(e, F.length(start) + 1, F.length(e)), hexes, True))))
        .when(kind == "secret", hex_scrambled(e, hexes)).when(kind == "name", F.concat(title, made_name(F.regexp_replace(e, TITLE, ""), F.substring(form, 6, 1), hexes)))
        .when(kind == "iban", iban(e, hexes)).when(kind == "card", card(e, hexes))
        .otherwise(scrambled_digits(e, hexes))
    )


def form_of(e: Column) -> Column:
    return bound(entity_type(e), lambda kind: normal_form(e, kind))


def replaced(e: Column, draw_of: Callable[[Column], Column], key: str) -> Column:
    """A mention's surrogate; ``draw_of`` gives the draw of its normal form."""
    return bound(entity_type(e), lambda kind: bound(normal_form(e, kind), lambda form: surrogate(e, kind, form, draw_of(form), key)))


def iban(e: Column, hexes: Column) -> Column:
    """The country stays; the account changes and the check digits fit it. Spaces do not count as places."""
    bare = F.regexp_replace(e, " ", "")
    country, account = F.substring(bare, 1, 2), scrambled(F.substring(bare, F.lit(5), F.length(bare)), hexes, True)

    def step(acc: Column, c: Column) -> Column:
        letter = F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c)
        return F.when(letter > 0, (acc * 100 + letter + 9) % 97).otherwise((acc * 10 + F.coalesce(F.try_to_number(c, F.lit("9")), F.lit(0)).cast("int")) % 97)

    def whole(account: Column) -> Column:
        rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)
        return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)

    return bound(account, lambda made: bound(whole(made), lambda b: respaced(e, b, " ")))


def card(e: Column, hexes: Column) -> Column:
    """Digits change, the last so that the number passes the cards' check; separators stay."""
    digits = scrambled(F.regexp_replace(e, "[^0-9]", ""), hexes, False)

    def checked(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        doubled = lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int")
        total = F.aggregate(F.transform(F.split(F.reverse(body), ""), doubled), F.lit(0), lambda a, x: a + x)
        return F.concat(body, ((10 - total % 10) % 10).cast("string"))

    return bound(digits, lambda d: bound(checked(d), lambda c: respaced(e, c, "[^0-9]")))


def scrambled_digits(e: Column, hexes: Column) -> Column:
    """Digits by their order among the digits, so that separators do not change the result."""
    digits = scrambled(F.regexp_replace(e, "[^0-9]", ""), hexes, False)
    return bound(digits, lambda d: respaced(e, d, "[^0-9]"))


def respaced(pattern: Column, filler: Column, separators: str) -> Column:
    """``pattern`` with everything but its separators replaced in turn by the characters of ``filler``."""
    chars = F.split(pattern, "")
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        kept = c.rlike(separators)
        out = F.concat(acc["out"], F.when(kept, c).otherwise(F.substring(filler, acc["n"] + 1, F.lit(1))))
        return F.struct(out.alias("out"), (acc["n"] + F.when(kept, 0).otherwise(1)).alias("n"))

    return F.aggregate(chars, empty, step, lambda acc: acc["out"])


def entities(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))


def bare(e: Column) -> Column:
    return F.regexp_replace(e, TITLE, "")


def words_of(name: Column) -> Column:
    return F.size(F.split(name, "[ -]"))


#: What of a name may stand for its person: the whole, the last word, the first word, the first with its hyphens, all but the last.
PARTS = (r"^.+$", r"[^ -]+$", r"^[^ -]+(?=[ -])", r"^[^ ]+(?= )", r"^.+(?=[ -][^ -]+$)")


def persons(mentions: Column) -> Column:
    """Names without title -> the titled mention of a document that they belong to.

    These are the mentions' ``PARTS``, as written and in capitals; first parts
    only if they begin with a word (no initial, no particle). Of several with
    one part the longest name counts, then the smallest.
    """
    named = F.array_distinct(F.filter(mentions, lambda e: e.rlike(TITLE)))

    def entry(part: str, upper: bool) -> Callable[[Column], Column]:
        def one(e: Column) -> Column:
            w = F.regexp_extract(bare(e), part, 0)
            w = F.when(w.rlike(r"^\p{Lu}[\p{L}'’]"), w).otherwise("") if part in PARTS[2:] else w
            return F.struct((-words_of(bare(e))).alias("n"), e.alias("e"), (F.upper(w) if upper else w).alias("w"))

        return one

    every = F.concat(*[F.transform(named, entry(part, upper)) for part in PARTS for upper in (False, True)])
    every = F.array_sort(F.array_distinct(F.filter(every, lambda x: x["w"] != "")))
    keys = F.transform(every, lambda x: x["w"])
    first = F.filter(every, lambda x, i: F.array_position(keys, x["w"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["w"], x["e"])))


def redraws(docs: DataFrame, key: str) -> DataFrame:
    """(form, draw) of the forms whose first surrogates collide; written, usually without rows."""
    mention = docs.select(F.explode(entities(F.col("text"))).alias("e")).withColumn("form", form_of(F.col("e")))
    table = written(mention.groupBy("form").agg(F.min("e").alias("e")).withColumn("draw", F.lit(0)), "entities")
    for _ in range(MAX_DRAWS):
        made = written(table.withColumn("to", bound(replaced(F.col("e"), lambda _: F.col("draw"), key), form_of)), "surrogates")
        # of those that share a surrogate one keeps it: the form that has drawn least, then the smallest
        first = made.groupBy("to").agg(F.min(F.struct("draw", "form")).alias("keeps"), F.count("*").alias("n")).where("n > 1")
        shared = made.join(first, "to").where(F.struct("draw", "form") != F.col("keeps")).select("form")
        real = made.join(table.select(F.col("form").alias("to")), "to", "left_semi").select("form")
        again = written(shared.union(real).distinct().withColumn("more", F.lit(1)), "collisions")
        if again.isEmpty():
            break
        table = written(table.join(again, "form", "left").select("form", "e", (F.col("draw") + F.coalesce("more", F.lit(0))).alias("draw")), "entities")
    else:
        raise RuntimeError(f"surrogates still collide after {MAX_DRAWS} draws")
    return table.where("draw > 0").select("form", "draw")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``_pii_found``, how many mentions were replaced."""
    drawn = redraws(docs, key)
    titled = docs.withColumn("_pii_mentions", entities(F.col("text"))).withColumn("_pii_names", persons(F.col("_pii_mentions")))
    # words of letters, blanks, full stops, hyphens and apostrophes only, longer names first
    names = F.array_sort(F.map_keys("_pii_names"), lambda a, b: F.length(b) - F.length(a))
    again = F.concat(F.lit(f"{ENTITY}|(?<![\\p{{L}}\\p{{N}}])(?:"), F.replace(F.array_join(names, "|"), F.lit("."), F.lit("[.]")), F.lit(r")(?![\p{L}\p{N}])"))
    some = F.size("_pii_names") > 0
    marked = titled.withColumn("_pii_mentions", F.when(some, F.regexp_extract_all("text", again, F.lit(0))).otherwise(F.col("_pii_mentions")))
    draws = F.create_map().cast("map<string,int>")
    if drawn.isEmpty():
        ready = marked.withColumn("_pii_draws", draws)
    else:
        # documents without mentions have no draws to look up and stay out of the join
        ready = marked.withColumn("_pii_key", F.when(F.size("_pii_mentions") > 0, F.xxhash64("_pii_mentions")))
        forms = ready.where("_pii_key IS NOT NULL").select("_pii_key", F.explode("_pii_mentions").alias("e")).distinct()
        forms = forms.withColumn("form", form_of(F.col("e"))).join(drawn, "form").select("_pii_key", "form", "draw").distinct()
        maps = forms.groupBy("_pii_key").agg(F.map_from_entries(F.collect_list(F.struct("form", "draw"))).alias("_pii_draws"))
        with_key = ready.where("_pii_key IS NOT NULL").join(maps, "_pii_key", "left").withColumn("_pii_draws", F.coalesce("_pii_draws", draws))
        ready = with_key.unionByName(ready.where("_pii_key IS NULL").withColumn("_pii_draws", draws)).drop("_pii_key")

    draw_of = lambda form: F.coalesce(F.element_at("_pii_draws", form), F.lit(0))
    owner = lambda e: F.coalesce(F.element_at("_pii_names", bare(e)), e)
    made = F.transform(F.transform("_pii_mentions", owner), lambda e: replaced(e, draw_of, key))

    def told(e: Column, m: Column) -> Column:
        """The surrogate of mention ``e`` from that of the person's full name ``m``: its title, and as much of the name, in capitals if it is."""
        name, n = bare(e), words_of(bare(e))
        begins = F.startswith(F.upper(bare(owner(e))), F.upper(name))
        part = F.when(n == words_of(bare(m)), bare(m)).when(begins, F.array_join(F.slice(F.split(bare(m), " "), 1, n), " ")).otherwise(F.substring_index(m, " ", -1))
        cased = F.when((name == F.upper(name)) & (name != F.lower(name)), F.upper(part)).otherwise(part)
        return F.when(F.map_contains_key("_pii_names", name), F.concat(F.regexp_extract(e, TITLE, 0), cased)).otherwise(m)

    to = F.when(some, F.zip_with("_pii_mentions", made, told)).otherwise(made)
    pieces = F.when(some, F.split("text", again, -1)).otherwise(F.split("text", ENTITY, -1))
    joined = F.array_join(F.zip_with(pieces, F.concat(to, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    found = F.size("_pii_mentions")
    return (
        ready.withColumn("text", F.when(found > 0, joined).otherwise(F.col("text"))).withColumn("_pii_found", found.cast("long"))
        .drop("_pii_mentions", "_pii_names", "_pii_draws")
    )


def op8_query(docs: DataFrame) -> DataFrame:
    return replace(docs.select("doc_id", "text"), QUERY_KEY).select("doc_id", "text", F.col("_pii_found").alias("n_entities"))
