"""Personal data replaced by surrogates, with DataFrame functions only.

Patterns find mentions: mail addresses, network addresses (of both versions), card, account,
social-security and phone numbers, and names after a title; where a text has such a name, its
given name and surname are found wherever else they stand alone. A mention stands for an entity,
which is its canonical form: mail addresses and names in lower case, numbers without separators,
network addresses written out, names without title, given name and surname each on its own. Each
entity gets a replacement of its own kind from a keyed hash: characters keep their class and
script, numbers their check digit, given names the gender of their titles. A mention is its
entity's replacement in the mention's own case, spacing and title. So one entity has one
surrogate in the whole corpus, however it is written.

A collision check sees to it that no two entities of a kind have the same one and that none is
itself an entity of the corpus: those that
clash are hashed again, round by round, until none is left. A form can be too narrow for that: no letter
or digit to exchange, or all its surrogates taken. From the ``WIDEN``-th try on, characters of the hash
are appended, two more with each try, so that the surrogates of an entity at different tries are all
different; as there are finitely many entities, every one finds a free surrogate in the end.

Not found: names without a title anywhere in their text, national phone numbers of other forms
than those listed, network addresses of version 6 without a digit.

Only distinct entities and the lists of mentions of documents are shuffled for that; texts
without mentions pass straight through, the others meet the surrogates of their list once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.batches import filled
from themeloom.storage import settle

# Titles by gender, names to choose from, syllables of surnames.
TITLES = {"m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "M", "Señor", "Sr", "Don"),
          "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña"),
          "n": ("Dr", "Prof", "Professor", "Doctor")}
GIVEN = {"m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jakob Karl Leon Martin Nils Oscar Paul Robert Simon Thomas Victor",
         "f": "Anna Berta Clara Dora Emma Flora Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Vera",
         "n": "Alex Andrea Charlie Dominique Eden Finley Jordan Kim Luca Morgan Noel Quinn Robin Sascha Taylor Toni"}
SYLLABLES = "ba be bo da de do fa fe fi ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va vi wa we za zo"

# Fixed value: calling codes of countries.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

#: Characters that a name without title must have to be replaced.
LEAST_BARE = 3
#: Tries after which surrogates become longer than what they stand for.
WIDEN = 6

_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_CAPITAL = r"\p{Lu}[\p{L}'’-]{1,30}"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = (rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)"
        r"(?![\p{L}\p{N}:]|\.\d)")
_NATIONAL = (r"(?<![\p{L}\p{N}+./-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}|0\d{2,3} \d{3,4} \d{3,4}|0\d{4} \d{6}|0\d{2,5}/\d{4,8})"
             r"(?![\p{L}\p{N}]|[ ./-]?\d)")
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\.?\d)|{_IP6}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+(])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|" + _NATIONAL,
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?[ ]{_CAPITAL}(?:[ ]{_CAPITAL})?",
}
KINDS = tuple(PATTERNS)
_TITLED = rf"^((?:{_TITLE})\.? )"
_TITLE_INITIALS = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
#: What an entity can begin with is tested first, which is all that most places of a text need.
_ANY = "|".join((
    PATTERNS["email"], rf"(?=\d)(?:{'|'.join((PATTERNS['ip'], PATTERNS['ssn'], PATTERNS['card'], _NATIONAL))})", rf"(?=[A-Fa-f:])(?:{_IP6})",
    rf"(?=[+(])(?:{PATTERNS['phone']})", rf"(?=[A-Z])(?:{PATTERNS['iban']})", rf"(?=[{_TITLE_INITIALS}])(?:{PATTERNS['name']})"))
#: Texts without any of this hold no entity.
_HINT = rf"[0-9@]|(?=[{_TITLE_INITIALS}])(?:{_TITLE})\.?[ ]\p{{Lu}}"


def _letters(*spans: tuple[int, int], without: str = "") -> str:
    return "".join(c for a, b in spans for c in map(chr, range(a, b + 1)) if c.isalpha() and c not in without)


#: What characters of a class are replaced by; the first class that fits counts.
ALPHABETS = (
    ("[0-9]", "0123456789"), ("[a-z]", _letters((0x61, 0x7A))), ("[A-Z]", _letters((0x41, 0x5A))),
    (r"[\p{Ll}&&\p{IsLatin}]", _letters((0xDF, 0xFF))), (r"[\p{Lu}&&\p{IsLatin}]", _letters((0xC0, 0xDE))),
    (r"[\p{Ll}&&\p{IsGreek}]", _letters((0x3B1, 0x3C9), without="ς")), (r"[\p{Lu}&&\p{IsGreek}]", _letters((0x391, 0x3A9))),
    (r"[\p{Ll}&&\p{IsCyrillic}]", _letters((0x430, 0x44F))), (r"[\p{Lu}&&\p{IsCyrillic}]", _letters((0x410, 0x42F))),
    (r"\p{IsHebrew}", _letters((0x5D0, 0x5EA))), (r"\p{IsArabic}", _letters((0x628, 0x63A))), (r"\p{IsDevanagari}", _letters((0x915, 0x939))),
    (r"\p{IsHiragana}", _letters((0x3042, 0x3082))), (r"\p{IsKatakana}", _letters((0x30A2, 0x30E2))),
    (r"\p{IsHangul}", _letters((0xAC00, 0xAC7F))), (r"\p{IsHan}", _letters((0x4E00, 0x4E7F))), (r"\p{Nd}", "0123456789"))


def kind_of(entity: Column) -> Column:
    """The first pattern that the whole entity fits."""
    out = F.lit("name")
    for kind in reversed(KINDS[:-1]):
        out = F.when(entity.rlike(rf"\A(?:{PATTERNS[kind]})\z"), kind).otherwise(out)
    return out


def _number(seed: Column, i: Column | int, below: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(below)).cast("int")


def shaped(value: Column, seed: Column) -> Column:
    """Each letter and digit replaced by one of its class and script, chosen by the seed and its place."""
    def replaced(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(ALPHABETS):
            out = F.when(c.rlike(rf"\A{pattern}\z"), F.substring(F.lit(letters), _number(seed, i, len(letters)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), replaced), "")


def _chosen(words: str, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words.split())), at + 1)


def _syllables(seed: Column, n: Column) -> Column:
    count = len(SYLLABLES.split())
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _chosen(SYLLABLES, _number(seed, i, count))), "")


def _groups(address: Column) -> Column:
    """The groups of a network address of version 6, those left out too, each of four digits."""
    def side(n: int) -> Column:
        return F.filter(F.split(F.substring_index(address, "::", n), ":"), lambda x: x != "")

    out = F.when(address.contains("::"), F.concat(
        side(1), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(side(1)) - F.size(side(-1)))), side(-1))).otherwise(F.split(address, ":"))
    return F.transform(out, lambda x: F.lpad(x, 4, "0"))


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity have in common; names come without title here."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (F.when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
            .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), digits))
            .when(kind.isin("ssn", "card"), digits)
            .when((kind == "ip") & mention.contains(":"), F.array_join(_groups(F.lower(mention)), ":"))
            .otherwise(F.lower(mention)))


def surrogate(kind: Column, value: Column, attempt: Column, key: str, gender: Column | None = None) -> Column:
    """The replacement of an entity at its ``attempt``-th try; ``name`` is a surname, ``given`` a given name."""
    def seed(of: Column, tries: Column = attempt) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, of, tries.cast("string")), 256)

    own = seed(value)
    extra = F.greatest(F.lit(0), 2 * (attempt - WIDEN + 1))
    letters = F.substring(own, F.lit(1), extra)
    numbers = F.translate(letters, "abcdef", "012345")
    domain = F.regexp_extract(value, r"@(.*)\.", 1)
    email = F.concat(shaped(F.regexp_extract(value, r"^([^@]*)@", 1), own), letters, F.lit("@"), shaped(domain, seed(domain, F.lit(0))),
                     F.regexp_extract(value, r"(\.[^.]*)$", 1))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_number(own, i, 254) + 1).cast("string")), ".")
    # Groups of zeros stay, so that they can still be left out.
    six = F.array_join(F.transform(F.split(value, ":"), lambda g, i: F.when(g.rlike("^0*$"), g).otherwise(
        F.regexp_replace(F.substring(F.sha2(F.concat(own, i.cast("string")), 256), 1, 4), "^0", "f"))), ":")
    ip = (F.when(value.contains(":"), F.when(extra > 0, F.concat(six, F.lit(":"), numbers)).otherwise(six))
          .when(extra > 0, F.concat(ip, F.lit("."), numbers)).otherwise(ip))
    code = F.concat(F.substring(value, 1, 2), shaped(F.substring(value, 3, 200), own), numbers)
    calling = rf"^(\+(?:{CALLING})|)"
    phone = F.concat(F.regexp_extract(value, calling, 1), shaped(F.regexp_replace(value, calling, ""), own), numbers)
    digits = F.concat(shaped(value, own), numbers)
    # The last digit is chosen so that the check digit is right where it was.
    body = F.regexp_replace(digits, r"\d$", "")
    checked = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))),
                                    lambda x: F.call_function("luhn_check", F.regexp_replace(x, r"\D", ""))), 1)
    card = F.when(F.call_function("luhn_check", F.regexp_replace(value, r"\D", "")), checked).otherwise(digits)  # a widened one is right, too
    title = F.regexp_extract(value, _TITLED, 1)
    word = F.lower(F.regexp_replace(value, _TITLED, ""))
    latin = word.rlike(r"^[\p{IsLatin}'’-]+$")
    # A clash adds syllables, or letters of the name's own script.
    more = F.when(attempt == 0, "").when(latin, _syllables(own, attempt)).otherwise(F.substring(shaped(F.repeat(word, attempt), own), F.lit(1), attempt))
    family = F.initcap(F.concat(F.when(latin, _syllables(seed(word, F.lit(0)), F.lit(3))).otherwise(shaped(word, seed(word, F.lit(0)))), more))
    first = F.lit("")
    for g, pool in GIVEN.items():
        first = F.when((F.lit("n") if gender is None else gender) == g, _chosen(pool, _number(own, 0, len(pool.split())))).otherwise(first)
    given = F.concat(F.when(latin, first).otherwise(F.initcap(shaped(word, own))), more)
    made = {"email": email, "ip": ip, "iban": code, "phone": phone, "ssn": digits, "card": card, "name": F.concat(title, family), "given": given}
    out = F.lit(None)
    for k, column in made.items():
        out = F.when(kind == k, column).otherwise(out)
    return out


def _cased(word: Column, made: Column) -> Column:
    return F.when((F.length(word) > 1) & (word == F.upper(word)) & (word != F.lower(word)), F.upper(made)).otherwise(made)


def rendered(kind: Column, mention: Column, made: Column, given: Column) -> Column:
    """A surrogate as its mention is written; ``given`` is that of the given name, null where there is none."""
    def spaced(sign: str) -> Column:
        """Letters and digits of ``made`` in the places of those of the mention; what is over follows."""
        signs = F.regexp_replace(made, f"[^{sign}]", "")
        places = F.transform(F.split(mention, ""), lambda c, i: F.when(
            c.rlike(f"^[{sign}]$"), F.substring(signs, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), f"[^{sign}]", "")) + 1, F.lit(1))).otherwise(c))
        return F.concat(F.array_join(places, ""), F.substring(signs, F.length(F.regexp_replace(mention, f"[^{sign}]", "")) + 1, F.length(signs)))

    def raised(c: Column, i: Column) -> Column:
        of = F.substring(mention, i + 1, F.lit(1))
        return F.when((of != F.lower(of)) & (F.length(F.upper(c)) == 1), F.upper(c)).otherwise(c)

    email = F.when(mention == F.lower(mention), made).otherwise(F.array_join(F.transform(F.split(made, ""), raised), ""))

    def six(part: str, skipped: Column) -> Column:
        at = F.split(made, ":")
        return F.array_join(F.transform(F.split(part, ":"), lambda g, i: F.when(g.rlike("^0*$"), g).otherwise(
            F.when(mention == F.lower(mention), F.get(at, skipped + i)).otherwise(F.upper(F.get(at, skipped + i))))), ":")

    total = F.size(_groups(mention))
    right = F.substring_index(mention, "::", -1)
    address = F.when(mention.contains("::"), F.concat(
        six(F.substring_index(mention, "::", 1), F.lit(0)), F.lit("::"), six(right, total - F.size(F.split(right, ":"))))).otherwise(six(mention, F.lit(0)))
    over = F.array_join(F.slice(F.split(made, ":"), total + 1, F.lit(9)), ":")
    address = F.concat(address, F.when(over != "", F.concat(F.lit(":"), over)).otherwise(""))
    words = F.split(F.regexp_replace(mention, _TITLED, ""), " ")
    name = F.concat(F.regexp_extract(mention, _TITLED, 1),
                    F.when(given.isNotNull(), F.concat(_cased(F.element_at(words, 1), given), F.lit(" "))).otherwise(""), _cased(F.element_at(words, -1), made))
    return (F.when(kind == "email", email).when(kind == "ip", F.when(mention.contains(":"), address).otherwise(made))
            .when(kind == "iban", spaced(r"\p{L}\p{N}")).when(kind.isin("phone", "ssn", "card"), spaced(r"\d"))
            .when(kind == "given", _cased(mention, made)).otherwise(name))


def _entities(kind: Column, mention: Column) -> Column:
    """The entities of a mention: one, or two where a name has a given name."""
    titled = mention.rlike(_TITLED) & (kind == "name")
    words = F.split(F.regexp_replace(mention, _TITLED, ""), " ")
    gender = F.lit("n")
    for g in ("m", "f"):
        gender = F.when(mention.rlike(rf"^(?:{'|'.join(TITLES[g])})\.? "), g).otherwise(gender)

    def one(k: Column, value: Column, sex: Column) -> Column:
        return F.struct(k.alias("kind"), value.alias("value"), sex.alias("gender"))

    family = one(F.lit("name"), F.lower(F.element_at(words, -1)), F.lit("n"))
    return (F.when(titled & (F.size(words) > 1), F.array(one(F.lit("given"), F.lower(F.element_at(words, 1)), gender), family))
            .when(titled, F.array(family)).otherwise(F.array(one(kind, canonical(kind, mention), F.lit("n")))))


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value`` and ``surrogate`` of distinct entities: no surrogate twice, none an entity itself.

    Of entities that clash, the smallest keeps the surrogate, one that already has it first; the
    others try again. Entities that are done are not hashed again.
    """
    entities = entities if "gender" in entities.columns else entities.withColumn("gender", F.lit("n"))
    taken = entities.select(F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    done: DataFrame | None = None
    pending, tries = entities, 0
    while True:
        tried = pending.select("kind", "value", "gender", F.lit(0 if done is None else 1).alias("turn"),
                               surrogate(F.col("kind"), F.col("value"), F.lit(tries), key, F.col("gender")).alias("surrogate"))
        there = tried.join(taken, (F.col("kind") == F.col("_kind")) & (F.col("surrogate") == F.col("_value")), "left")
        free = there.withColumn("free", F.col("_value").isNull()).select("kind", "value", "gender", "turn", "surrogate", "free")
        every = free if done is None else free.unionByName(done.withColumns(dict(turn=F.lit(0), free=F.lit(True))))
        winners = (every.filter("free").groupBy(F.col("kind").alias("_kind"), F.col("surrogate").alias("_surrogate"))
                   .agg(F.min(F.struct("turn", "value")).alias("_first")))
        judged = settle(
            every.join(winners, (F.col("kind") == F.col("_kind")) & (F.col("surrogate") == F.col("_surrogate")), "left")
            .select("kind", "value", "gender", "surrogate", (F.col("free") & (F.col("value") == F.col("_first.value"))).alias("ok")), "surrogates")
        done, pending = judged.filter("ok").drop("ok"), judged.filter("ok IS NOT TRUE").select("kind", "value", "gender")
        tries += 1
        if pending.isEmpty():
            return done.drop("gender")


def replace(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with surrogates in its text, and ``n_entities`` and a count of each kind added.

    Null text counts as empty. Each row gives one row, repeated rows too; other columns are kept,
    unless they have the name of a count. An empty table gives no rows.
    """
    counts = ["n_entities", *(f"n_{k}" for k in KINDS)]
    kept = [c for c in df.columns if c != text and c not in counts]
    titled = F.filter("_first", lambda v: v.rlike(_TITLED))
    words = F.transform(titled, lambda v: F.split(F.regexp_replace(v, _TITLED, ""), " "))

    def long_enough(names: Column) -> Column:
        return F.array_distinct(F.filter(names, lambda w: F.length(w) >= LEAST_BARE))

    given = F.transform(F.filter(words, lambda w: F.size(w) > 1), lambda w: F.element_at(w, 1))
    # A text's pattern: what all texts are searched for, and the names that it introduces with a title.
    own = F.concat(F.lit(rf"{_ANY}|(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(F.array_sort(F.concat("_given", "_family"), lambda a, b: F.length(b) - F.length(a)), "|"),
                   F.lit(r")(?![\p{L}\p{N}])"))
    every = df.select(F.struct(*[F.col(c) for c in kept]).alias("_row") if kept else F.lit(None).alias("_row"), filled(text).alias("_text"))
    # Told by the first mention, and by the text alone: a filter on what is found would be pushed down as many searches.
    some = F.col("_text").rlike(_HINT) & F.col("_text").rlike(_ANY)
    rows = (every.filter(some)
            .withColumn("_first", F.regexp_extract_all("_text", F.lit(_ANY), 0))
            .withColumns({"_given": long_enough(given), "_family": long_enough(F.transform(words, lambda w: F.element_at(w, -1)))})
            .withColumn("_pattern", F.when(F.size("_given") + F.size("_family") > 0, own).otherwise(F.lit(_ANY)))
            .withColumn("_values", F.when(F.size("_given") + F.size("_family") > 0, F.regexp_extract_all("_text", F.col("_pattern"), 0)).otherwise(F.col("_first")))
            .select("_row", "_text", "_pattern", F.transform("_values", lambda v: F.struct(
                F.when(F.array_contains("_given", v) & ~F.array_contains("_family", v), "given").otherwise(kind_of(v)).alias("kind"),
                v.alias("value"))).alias("_found")))
    lists = settle(rows.select("_found").distinct().withColumn("_list", F.sha2(F.to_json("_found"), 256)), "entity-lists")
    each = lists.select("_list", F.posexplode("_found").alias("at", "e")).select("_list", "at", "e.kind", "e.value")
    mentions = settle(each.select("kind", "value").distinct().select("kind", "value", F.explode(_entities(F.col("kind"), F.col("value"))).alias("of"))
                      .select("kind", "value", F.col("of.kind").alias("_kind"), F.col("of.value").alias("_value"), "of.gender"), "mentions")
    male, female = F.bool_or(F.col("gender") == "m"), F.bool_or(F.col("gender") == "f")
    entities = settle(mentions.groupBy(F.col("_kind").alias("kind"), F.col("_value").alias("value")).agg(
        F.when(male & ~female, "m").when(female & ~male, "f").otherwise("n").alias("gender")), "entities")
    names = assigned(entities, key).select(F.col("kind").alias("_kind"), F.col("value").alias("_value"), "surrogate")
    other = (F.col("_kind") == "given") & (F.col("kind") == "name")
    written = settle(
        mentions.join(names, ["_kind", "_value"]).groupBy("kind", "value")
        .agg(F.max(F.when(~other, F.col("surrogate"))).alias("_made"), F.max(F.when(other, F.col("surrogate"))).alias("_first"))
        .select("kind", "value", rendered(F.col("kind"), F.col("value"), F.col("_made"), F.col("_first")).alias("surrogate")), "surrogate-names")
    made = settle(
        each.join(written, ["kind", "value"]).groupBy("_list")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("_new")), "surrogate-lists")
    parts = F.split("_text", F.col("_pattern"), -1)
    # Texts between entities, each but the last followed by a surrogate.
    whole = F.array_join(F.zip_with(parts, "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = rows.withColumn("_list", F.sha2(F.to_json("_found"), 256)).join(made, "_list").withColumn("_text", whole)
    nothing = F.array().cast("array<struct<kind:string,value:string>>").alias("_found")
    both = every.filter(~some).select("_row", "_text", nothing).unionByName(changed.select("_row", "_text", "_found"))
    number = [F.size("_found").cast("long").alias("n_entities")]
    kinds = F.col("_found.kind")
    kinds = F.transform(kinds, lambda k: F.when(k == "given", "name").otherwise(k))
    number += [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    columns = [F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns if c == text or c in kept]
    return both.select(*columns, *number)
