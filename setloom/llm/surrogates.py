"""Surrogates for personal data: detected entities are replaced by keyed values of their own type.

Detected are e-mail addresses, IPv4 and IPv6 addresses, payment card numbers (only those with a right check digit), phone numbers,
social security numbers, credentials (``token = "..."``, of any length, with the segments that dots join to it; without quotes, one segment must
have 16 characters, as prose has short words there) and names of persons (a title, or a known given name, before a
capitalised word). Further on or before in the same text, the parts of such a name are replaced where they stand alone. An
entity is the canonical form of a mention: letter case and separators don't count, and of a name each part is an entity, so
that ``Mrs Smith`` and ``Anna Smith`` stay the same person. A given name's gender is what most of its mentions in the corpus
show, by title or list, and none if as many show the other.

A surrogate is drawn from the SHA-512 of the secret key, the entity's type, its canonical form and an attempt. It keeps
type and format: digits become digits, letters become letters of the same script and case, separators stay; cards keep their first
digit and get a right check digit, phone numbers keep their country code or leading zero, private, link-local and loopback
addresses stay so, IPv6 addresses keep their first group, and given names keep their gender. One entity has one surrogate in the whole corpus. Surrogates are checked against all entities of their type
and against each other: of those that clash, the least entity keeps its surrogate and the others try again, until none is
left. So distinct entities stay distinct, and no surrogate is somebody else's real value.

Mentions of a hot entity are dealt to many tasks. Only texts that may hold an entity are shuffled. Everything is DataFrame expressions.

Defined results: a null text stays null, and an empty one empty. Rows that repeat a doc_id, a null one too, are replaced each by
its own text. Texts of any length are read whole. Texts without entities are unchanged, byte for byte. Empty tables give
empty results; other columns are kept, and ``n_entities`` (mentions replaced, parts of names that stand alone not counted) replaces a column of that name. With the same
key and corpus, results are the same on any number of tasks. A format too narrow for all its entities is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import maybe_among, salted_join
from .store import settle

KEY = "setloom"
MAX_ATTEMPTS = 64

# Titles and frequent given names by gender.
TITLES = {
    "m": "Mr Herr Herrn Monsieur Señor Sr Sir".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra".split(),
    "n": "Dr Prof".split(),
}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Jacques François Carlos José Juan Luis Miguel".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emma Julia Laura Claudia Ursula Sabine Monika Marie Claire Sophie Camille Carmen María Lucía Isabel Sofía Elena".split(),
}
# Sounds and endings that surrogate names are put together from, by script.
SOUNDS = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve".split(),
    "cyrillic": "ба бе ви во га да де жа за зи ка ко ла ле ли ма ме ми на не но па пе ра ре ри са се та те ти ва".split(),
    "greek": "βα βε βι γα γε δα δε ζα θα θε κα κε κο λα λε λι μα με μι να νε νι πα πε ρα ρε σα σε τα τε".split(),
}
ENDINGS = {
    "latin": {"m": ["n", "s", "r", "k"], "f": ["na", "lia", "sa", "ra"], "n": ["l", "n", "x", "y"], "surname": ["son", "mann", "ler", "rez", "ton", "ville", "berg", "well"]},
    "cyrillic": {"m": ["й", "н", "р", "м"], "f": ["на", "лия", "ша", "ра"], "n": ["ль", "н", "р", "к"], "surname": ["ов", "ев", "ин", "ко", "ский", "ук", "ян", "ец"]},
    "greek": {"m": ["ος", "ης", "ας", "ων"], "f": ["να", "λια", "σα", "ρα"], "n": ["ις", "ω", "ι", "υ"], "surname": ["πουλος", "ιδης", "ακης", "ογλου", "ατος", "εας", "ινος", "αλης"]},
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_CAPITALISED = r"\p{Lu}[\p{L}'’\-]{1,30}"
_SECRET_KEY = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY)"
_SECRET = r"[A-Za-z0-9+/_\-]"
#: Segments joined by dots, as in a JWT. Possessive, so that neither length nor number is bounded.
_SECRETS = rf"{_SECRET}++(?:\.{{1,2}}{_SECRET}++)*+"
_ALL_TITLES = [t for group in TITLES.values() for t in group]
_ALL_GIVEN = [g for group in GIVEN.values() for g in group]
#: (kind, pattern) in the order in which they are tried at a place.
PATTERNS = [
    ("email", r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+\-]{0,62}[\p{L}\p{N}_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\p{L}\p{N}@])"),
    (
        "secret",
        rf"(?<={_SECRET_KEY}\s{{0,2}}[=:]\s{{0,2}}[\x22']?)(?=(?:{_SECRET}{{1,15}}\.){{0,4}}{_SECRET}{{16}}){_SECRETS}|(?<={_SECRET_KEY}\s{{0,2}}[=:]\s{{0,2}}[\x22']){_SECRETS}(?=[\x22'])",
    ),
    ("ip", rf"(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)"),
    ("ipv6", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![\p{L}\p{N}:])"),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"),
    ("card", r"(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,4}|\d{4}-\d{4}-\d{4}-\d{1,4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\p{L}\p{N}])"),
    (
        "phone",
        r"(?:\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+\d{8,15}|\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,3}|0[1-9](?:[ .]\d{2}){4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])",
    ),
    ("name", rf"(?:(?:{'|'.join(_ALL_TITLES)})\.? {_CAPITALISED}(?: {_CAPITALISED})?|(?:{'|'.join(_ALL_GIVEN)}) {_CAPITALISED})"),
]
ENTITY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(p for _, p in PATTERNS) + ")"


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _checked(digits: Column) -> Column:
    """The sum that a card number's check digit completes to a multiple of ten."""
    at = F.transform(_chars(digits), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    size = F.length(digits)

    def add(total: Column, x: Column) -> Column:
        twice = x["d"] * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when((size - x["i"]) % 2 == 0, doubled).otherwise(x["d"])

    return F.aggregate(at, F.lit(0), add)


def _kind(surface: Column) -> Column:
    """The type of a mention, by what tells the types apart; null if it is none (a card number with a wrong check digit)."""
    size = F.length(_digits(surface))
    return (
        F.when(F.rlike(surface, F.lit("@")), "email")
        .when(F.rlike(surface, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$")), "ip")
        .when(F.rlike(surface, F.lit(r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]*:[0-9A-Fa-f]{1,4}$")), "ipv6")
        .when(F.rlike(surface, F.lit(r"^\d{3}-\d{2}-\d{4}$")), "ssn")
        .when(F.rlike(surface, F.lit(r"^\+[\d .()\-]+$|^\(\d{3}\)|^\d{3}[.\-]\d{3}[.\-]\d{4}$|^0\d(?:[ .]\d{2}){4}$")), F.when(size.between(7, 15), "phone"))
        .when(F.rlike(surface, F.lit(r"^\d[\d \-]{12,22}$")), F.when(_checked(_digits(surface)) % 10 == 0, "card"))
        .when(F.rlike(surface, F.lit(r"^\p{Lu}\S* |^\p{Lu}\S*\. ")), "name")
        .otherwise("secret")
    )


def _script(word: Column) -> Column:
    return F.when(F.rlike(word, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(word, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def _name_parts(surface: Column) -> Column:
    """(kind, canonical, gender) of each word of a name; a title has no kind, and a surname no gender."""
    parts = F.split(surface, " ")
    bare = F.regexp_replace(F.get(parts, 0), r"\.$", "")
    titled = F.array_contains(_literals(_ALL_TITLES), bare)

    def listed(words: list[str], x: Column) -> Column:
        return F.array_contains(_literals(words), x)

    given = F.when(titled, F.get(parts, 1)).otherwise(F.get(parts, 0))
    gender = (
        F.when(listed(TITLES["m"], bare) | (~listed(TITLES["f"], bare) & listed(GIVEN["m"], given)), "m")
        .when(listed(TITLES["f"], bare) | listed(GIVEN["f"], given), "f")
        .otherwise("n")
    )

    def part(x: Column, i: Column) -> Column:
        last = i == F.size(parts) - 1
        kind = F.when(titled & (i == 0), F.lit(None)).when(last, F.concat(F.lit("surname:"), _script(x))).otherwise(F.concat(F.lit("given:"), _script(x)))
        return F.struct(kind.alias("kind"), F.lower(x).alias("canonical"), F.when(~last, gender).alias("gender"))

    return F.transform(parts, part)


def _entities(surface: Column, kind: Column) -> Column:
    """The entities (kind, canonical, gender) of a mention: one, or one for each word of a name."""
    plus = F.when(F.startswith(surface, F.lit("+")), "+").otherwise("")
    canonical = (
        F.when(kind.isin("email", "ipv6"), F.lower(surface)).when(kind.isin("card", "ssn"), _digits(surface)).when(kind == "phone", F.concat(plus, _digits(surface))).otherwise(surface)
    )
    return F.when(kind == "name", _name_parts(surface)).otherwise(F.array(F.struct(kind.alias("kind"), canonical.alias("canonical"), F.lit(None).cast("string").alias("gender"))))


def mentions(text: Column) -> Column:
    """All that looks like an entity in a text, in order: (surface, entities); entities is null for what is none."""
    with_kind = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda s: F.struct(s.alias("surface"), _kind(s).alias("kind")))
    return F.transform(with_kind, lambda m: F.struct(m["surface"].alias("surface"), F.when(m["kind"].isNotNull(), _entities(m["surface"], m["kind"])).alias("entities")))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _one_of(values: str, n: Column) -> Column:
    return F.substring(F.lit(values), n % len(values) + 1, F.lit(1))


def _substituted(text: Column, digest: Column) -> Column:
    """Letters and digits of a text drawn anew, by script and case."""

    def drawn(c: Column, i: Column) -> Column:
        n = _byte(digest, i)
        letter = (
            F.when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), _one_of(LETTERS["cyrillic"], n))
            .when(F.rlike(c, F.lit(r"\p{IsGreek}")), _one_of(LETTERS["greek"], n))
            .otherwise(_one_of(LETTERS["latin"], n))
        )
        return F.when(F.rlike(c, F.lit(r"\p{Nd}")), (n % 10).cast("string")).when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(letter)).when(F.rlike(c, F.lit(r"\p{L}")), letter).otherwise(c)

    return F.array_join(F.transform(_chars(text), drawn), "")


def _drawn_digits(digest: Column, first: Column, size: Column) -> Column:
    """``size`` digits from place ``first`` on; the first of them is 2 to 9."""
    places = F.when(size > 0, F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.when(i == 0, 2 + _byte(digest, first) % 8).otherwise(_byte(digest, i + first) % 10).cast("string")), "")


def _sounded(kind: Column, gender: Column, digest: Column, attempt: int) -> Column:
    """A name of the kind's script, and of a gender if it is a given name; later attempts are longer."""
    count = 2 + attempt // 2

    def of(script: str) -> Column:
        sounds = [F.get(_literals(SOUNDS[script]), _byte(digest, F.lit(i)) % len(SOUNDS[script])) for i in range(count)]
        last = _byte(digest, F.lit(63))
        end = reduce(lambda c, g: c.when(gender == g, F.get(_literals(ENDINGS[script][g]), last % 4)), ("m", "f"), F.when(F.lit(False), F.lit(None)))
        end = end.otherwise(F.get(_literals(ENDINGS[script]["n"]), last % 4))
        return F.concat(*sounds, F.when(F.startswith(kind, F.lit("given")), end).otherwise(F.get(_literals(ENDINGS[script]["surname"]), last % 8)))

    return F.when(F.endswith(kind, F.lit("cyrillic")), of("cyrillic")).when(F.endswith(kind, F.lit("greek")), of("greek")).otherwise(of("latin"))


def _hexadecimal(text: Column, digest: Column) -> Column:
    """An IPv6 address with all groups but the first drawn anew."""
    first = F.substring_index(text, ":", 1)
    rest = F.transform(_chars(F.substring(text, F.length(first) + 1, F.length(text))), lambda c, i: F.when(c == ":", c).otherwise(_one_of("0123456789abcdef", _byte(digest, i))))
    return F.concat(first, F.array_join(rest, ""))


def surrogate(kind: Column, canonical: Column, gender: Column, key: str, attempt: int) -> Column:
    """The surrogate, in canonical form, that an attempt draws."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, F.lit(str(attempt))), 512)
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    labels, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    domain_digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 512)
    # a short local part has few values: later attempts add letters
    more = F.concat(*[_one_of(LETTERS["latin"], _byte(digest, F.lit(63 - i))) for i in range(min(attempt, 60))]) if attempt else F.lit("")
    email = F.concat(_substituted(local, digest), more, F.lit("@"), _substituted(labels, domain_digest), F.lit("."), top)
    size = F.length(canonical)
    card = F.concat(F.substring(canonical, 1, 1), _drawn_digits(digest, F.lit(0), size - 2))
    card = F.concat(card, ((10 - _checked(F.concat(card, F.lit("0"))) % 10) % 10).cast("string"))
    kept = F.when(F.rlike(canonical, F.lit(r"^\+[17]")), 2).when(F.startswith(canonical, F.lit("+")), 3).when(F.startswith(canonical, F.lit("0")), 1).otherwise(0)
    phone = F.concat(F.substring(canonical, F.lit(1), kept), _drawn_digits(digest, F.lit(0), size - kept))
    octets = [_byte(digest, F.lit(i)).cast("string") for i in range(4)]
    dot = F.lit(".")
    ip = (
        F.when(F.startswith(canonical, F.lit("10.")), F.concat(F.lit("10."), octets[1], dot, octets[2], dot, octets[3]))
        .when(F.startswith(canonical, F.lit("192.168.")), F.concat(F.lit("192.168."), octets[2], dot, octets[3]))
        .when(F.startswith(canonical, F.lit("127.")), F.concat(F.lit("127."), octets[1], dot, octets[2], dot, octets[3]))
        .when(F.startswith(canonical, F.lit("169.254.")), F.concat(F.lit("169.254."), octets[2], dot, octets[3]))
        .when(F.rlike(canonical, F.lit(r"^172\.(?:1[6-9]|2\d|3[01])\.")), F.concat(F.lit("172."), (16 + _byte(digest, F.lit(1)) % 16).cast("string"), dot, octets[2], dot, octets[3]))
        .otherwise(F.concat((11 + _byte(digest, F.lit(0)) % 116).cast("string"), dot, octets[1], dot, octets[2], dot, octets[3]))
    )
    hexadecimal = F.substring(F.repeat(digest, F.ceil(size / 128).cast("int")), F.lit(1), size)
    hexadecimal = F.when(F.lower(canonical) == canonical, hexadecimal).otherwise(F.upper(hexadecimal))
    # so has a short secret
    longer = F.when(size < 16, more).otherwise("")
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", _hexadecimal(canonical, digest))
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ssn", _drawn_digits(digest, F.lit(0), size))
        .when((kind == "secret") & F.rlike(canonical, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), F.concat(hexadecimal, longer))
        .when(kind == "secret", F.concat(_substituted(canonical, digest), longer))
        .otherwise(_sounded(kind, gender, digest, attempt))
    )


def assign(entities: DataFrame, key: str = KEY, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(kind, canonical, surrogate) of a table with one row an entity; no surrogate is given twice or is an entity."""
    gender = F.col("gender") if "gender" in entities.columns else F.lit(None).cast("string").alias("gender")
    pending, accepted = entities.select("kind", "canonical", gender), None
    real = entities.select(F.col("kind").alias("_k"), F.col("canonical").alias("_taken"))
    for attempt in range(max_attempts):
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.col("gender"), key, attempt))
        drawn = drawn.join(real, (F.col("kind") == F.col("_k")) & (F.col("surrogate") == F.col("_taken")), "left").withColumn("_real", F.col("_taken").isNotNull()).drop("_k", "_taken")
        if accepted is not None:
            given = accepted.select(F.col("kind").alias("_k"), F.col("surrogate").alias("_taken"))
            drawn = drawn.join(given, (F.col("kind") == F.col("_k")) & (F.col("surrogate") == F.col("_taken")), "left").withColumn("_real", F.col("_real") | F.col("_taken").isNotNull()).drop("_k", "_taken")
        drawn = settle(drawn, "drawn")
        least = drawn.where("not _real").groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).withColumn("_won", F.lit(True))
        checked = settle(drawn.drop("_real").join(least, ["kind", "surrogate", "canonical"], "left"), "checked")
        won = checked.where("_won").select("kind", "canonical", "surrogate")
        accepted = won if accepted is None else accepted.unionAll(won)
        pending = checked.where("_won is null").select("kind", "canonical", "gender")
        if pending.isEmpty():
            return accepted
    raise ValueError(f"a format has too few values for its entities: {[r.kind for r in pending.select('kind').distinct().limit(10).collect()]}")


def _filled(surface: Column, digits: Column) -> Column:
    """``surface`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(a: Column, c: Column) -> Column:
        is_digit = F.rlike(c, F.lit(r"\d"))
        return F.struct(F.concat(a["out"], F.when(is_digit, F.substring(digits, a["at"], F.lit(1))).otherwise(c)).alias("out"), (a["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(_chars(surface), start, put, lambda a: a["out"])


def _cased(surface: Column, value: Column) -> Column:
    """``value`` with the letter case of ``surface``: upper, capitalised or by place."""
    upper = F.upper(surface) == surface
    places = F.transform(_chars(value), lambda c, i: F.when(F.rlike(F.substring(surface, i + 1, F.lit(1)), F.lit(r"\p{Lu}")), F.upper(c)).otherwise(c))
    return F.when(upper & F.rlike(surface, F.lit(r"\p{Lu}")), F.upper(value)).otherwise(F.array_join(places, ""))


def _entity_key(e: Column) -> Column:
    return F.concat(e["kind"], F.lit("\x1f"), e["canonical"])


def _rendered(mention: Column, given: Column) -> Column:
    """The text that replaces a mention. ``given`` is a map from entities to surrogates."""
    surface, entities = mention["surface"], mention["entities"]
    first = F.get(entities, 0)
    value = given[_entity_key(first)]
    words = F.split(surface, " ")
    name = F.array_join(F.transform(words, lambda w, i: F.coalesce(_cased(w, given[_entity_key(F.get(entities, i))]), w)), " ")
    return (
        F.when(entities.isNull(), surface)
        .when(first["kind"].isin("card", "ssn", "phone"), _filled(surface, F.regexp_replace(value, r"\D", "")))
        .when(first["kind"] == "email", _cased(surface, value))
        .when(first["kind"].isin("ip", "ipv6", "secret"), value)
        .otherwise(name)
    )


def _own_names(mention_list: Column, given: Column) -> Column:
    """The parts of a text's names, of three letters or more, with what replaces them."""

    def parts(m: Column) -> Column:
        named = F.transform(F.split(m["surface"], " "), lambda w, i: F.struct(w.alias("word"), F.get(m["entities"], i).alias("entity")))
        named = F.filter(named, lambda p: p["entity"]["kind"].isNotNull() & (F.length(p["word"]) >= 3))
        return F.transform(named, lambda p: F.struct(p["word"].alias("word"), _cased(p["word"], given[_entity_key(p["entity"])]).alias("new")))

    names = F.filter(mention_list, lambda m: F.coalesce(F.rlike(F.get(m["entities"], F.size(m["entities"]) - 1)["kind"], F.lit("^surname:")), F.lit(False)))
    return F.array_distinct(F.flatten(F.transform(names, parts)))


def _mark(text: Column) -> Column:
    return F.md5(text)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_entities``."""
    found = docs.select("doc_id", _mark(F.col("text")).alias("_mark"), mentions(F.col("text")).alias("_mentions"))
    found = found.select("doc_id", "_mark", F.flatten(F.filter(F.transform("_mentions", lambda m: m["entities"]), lambda e: e.isNotNull())).alias("_entities"))
    found = settle(found.where(F.size("_entities") > 0), "found")
    each = found.select("doc_id", "_mark", F.explode(F.array_distinct("_entities")).alias("e")).select("doc_id", "_mark", "e.*").where("kind is not null")
    shown = [F.count_if(F.col("gender") == g) for g in ("m", "f")]
    gender = F.when(shown[0] > shown[1], "m").when(shown[1] > shown[0], "f")
    counts = settle(each.groupBy("kind", "canonical").agg(F.count(F.lit(1)).alias("n"), gender.alias("gender")), "entities")
    given = assign(counts, key)
    given = settle(given.join(counts.select("kind", "canonical", "n"), ["kind", "canonical"]).select(F.struct("kind", "canonical").alias("_entity"), "n", "surrogate"), "surrogates")
    rows = each.select("doc_id", "_mark", F.struct("kind", "canonical").alias("_entity")).distinct()
    met = salted_join(rows, given, "_entity", "n", F.col("_mark")).select("doc_id", "_mark", "_entity.*", "surrogate")
    pair = F.struct(F.concat("kind", F.lit("\x1f"), "canonical").alias("key"), F.col("surrogate").alias("value"))
    maps = met.groupBy("doc_id", "_mark").agg(F.map_from_entries(F.collect_set(pair)).alias("_given"))
    maps = settle(maps.withColumnRenamed("doc_id", "_of").withColumnRenamed("_mark", "_was"), "maps")

    columns = [c for c in docs.columns if c != "n_entities"]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc")
    flagged = maybe_among(docs.select(whole, F.col("doc_id").alias("_id")), F.col("_id"), found, "doc_id")
    alone = flagged.where("not _maybe").select("_doc.*", F.lit(0).cast("long").alias("n_entities"))
    maybe = flagged.where("_maybe").withColumn("_mark", _mark(F.col("_doc.text")))
    maybe = maybe.join(maps, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_mark") == F.col("_was")), "left")
    text = F.col("_doc.text")
    maybe = maybe.withColumn("_mentions", F.when(F.col("_given").isNotNull(), mentions(text)))
    maybe = maybe.withColumn("_names", F.when(F.col("_given").isNotNull(), _own_names(F.col("_mentions"), F.col("_given"))))
    alone_at = lambda word: F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), word, F.lit(r"(?![\p{L}\p{N}_])"))

    def bare(gap: Column) -> Column:
        return F.when(F.size("_names") == 0, gap).otherwise(F.aggregate("_names", gap, lambda t, n: F.regexp_replace(t, alone_at(n["word"]), n["new"])))

    pieces = F.zip_with(F.split(text, ENTITY), F.transform("_mentions", lambda m: _rendered(m, F.col("_given"))), lambda gap, new: F.concat(bare(gap), F.coalesce(new, F.lit(""))))
    new_text = F.when(F.col("_given").isNull(), text).otherwise(F.array_join(pieces, ""))
    n = F.when(F.col("_given").isNull(), F.lit(0)).otherwise(F.size(F.filter("_mentions", lambda m: m["entities"].isNotNull())))
    done = maybe.select(*[(new_text if c == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in columns], n.cast("long").alias("n_entities"))
    return alone.unionAll(done)
