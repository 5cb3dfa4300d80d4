"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

Native throughout. One pattern finds e-mail addresses, secrets, IBANs, IPv4
addresses, social security numbers, telephone and card numbers, and persons: names
behind an honorific (Mr, Frau, Dr., г-жа, κα, ...), and names that begin with one of
``GIVEN``. Where a text introduces a person, later mentions by one of the names
are found too.

An entity's normal form (digits of a number, lower case of an address) decides its
replacement, so all its spellings, in all documents, get the same one, written in
the layout of each place.

Numbers, addresses and secrets go through a keyed permutation of all strings of
their format (``permute``): country, issuer, kind of network, letter classes and
the validity of check digits (Luhn, IBAN) stay, and different entities have
different replacements by construction. A replacement that is itself an entity of
the corpus is found by a join; where the ring of the format has room, the run of
entities it belongs to moves on together, past the run's end, so distinctness
holds. In a format whose strings are nearly all taken, replacements may be other
entities' strings. A secret with few letters and digits is made longer.

Names are replaced word by word: a surname by syllables of its script, with an
ending of its gender where the language has one, a given name by one of its gender.
The same word under another gender is another person's. A replacement that two words
draw, or that is a name of the corpus, is drawn again among longer ones, until all
differ. The gender is that of the honorific, else of a listed given name, else
that of the same name before or after in the text; else none.

Null texts stay null; empty ones too. Texts are told apart by their content, so
repeated rows and ids need nothing special; a text of very many copies meets its
replacements in many tasks. Patterns have bounded or possessive repeats, so that
very long texts need no deep stack. Columns other than ``text`` pass through,
whatever their names; one called like the operator's own ``pii_kinds`` gives way to
it. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.permute import advance, let, permuted, spelled, step
from lodeweave.llm.skew import spread_join
from lodeweave.llm.storage import materialize, ref

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Honorifics, by gender ("" tells none).
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "г-жа", "госпожа", "κα", "κυρία"],
    "m": ["Mr", "Herr", "Hr", "Monsieur", "Sr", "Señor", "г-н", "господин", "κος", "κύριος"],
    "": ["Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur"],
}
#: Fixed word list: common given names that are no other words, by gender.
GIVEN = {
    "f": (
        "Ada Alice Anna Anne Barbara Camille Carmen Claudia Elena Elizabeth Emily Emma Helen Helga Isabelle Jane Jennifer Jessica Julia Katharina Laura "
        "Linda Lucia Margaret Maria Marie Marta Mary Monika Nathalie Olivia Patricia Petra Sabine Sarah Sophie Susan Ursula"
    ).split(),
    "m": (
        "Alan Andreas Andrew Anthony Antonio Brian Carlos Charles Daniel David Edward George Hans James Jean John Jorge José Juan Jürgen Kevin Klaus Luis "
        "Matthew Michael Michel Miguel Nicolas Paul Pedro Peter Philippe Pierre Richard Robert Stefan Steven Thomas William Wolfgang"
    ).split(),
}
_TITLE = "|".join(t for names in TITLES.values() for t in names)
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_NAME = rf"(?!(?:{_TITLE})(?!\p{{L}}))(?:[OD]['’])?\p{{Lu}}\p{{L}}++(?:-\p{{Lu}}\p{{L}}++){{0,2}}"
#: Secrets that show by themselves: hexadecimal numbers and keys of known services.
_PREFIX = r"(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_]?"
_KEYS = rf"[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|{_PREFIX}[A-Za-z0-9_-]{{16,}}"
#: What stands before a quoted secret.
_NAMED = r"(?i:token|secret|password|passwd|api_key|apikey)(?: = |=|: |:)\""
#: Kind -> pattern, in the order in which they are tried at a place. A host has at most 126 labels.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,124}\.[A-Za-z]{2,63}",
    "secret": rf"(?<![A-Za-z0-9])(?:{_KEYS})(?![A-Za-z0-9])|(?<=\")(?<={_NAMED})[^\"\s]{{8,}}+(?=\")",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "person": rf"(?=\p{{Lu}})(?<= )(?<=(?<!\p{{L}})(?:{_TITLE})\.? ){_NAME}(?: {_NAME}){{0,2}}|(?=\p{{Lu}})(?<!\p{{L}})(?:{_GIVEN})(?: {_NAME}){{1,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without these holds no entity; most texts stop here. Of the patterns only secrets and persons need neither digit nor "@".
HINT = rf"[0-9@]|(?=[a-fA-Fspgx])(?<![A-Za-z0-9])(?:{_KEYS})|(?=[tspaTSPA]){_NAMED}[^\"\s]{{8}}|(?=[\p{{Lu}}гκ])(?<!\p{{L}})(?:(?:{_TITLE})\.?|{_GIVEN}) (?:[OD]['’])?\p{{Lu}}"

FIRST = {
    ("latin", "f"): "Alma Berta Clara Daria Elena Flora Greta Hilda Irma Julia Klara Laura Marta Nora Olga Paula Rita Sara Tilda Vera".split(),
    ("latin", "m"): "Adam Bruno Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oskar Paul Rolf Simon Tomas Viktor".split(),
    ("latin", ""): "Alex Charlie Eden Jamie Kim Lou Noa Quinn Robin Sasha".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лариса Мария Нина Ольга Полина Раиса София Татьяна".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Сергей".split(),
    ("cyrillic", ""): "Женя Саша Валя Шура".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ηρώ Ιωάννα Μαρία Νίκη Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Ηλίας Λουκάς Μάρκος Νίκος Πέτρος Φώτης".split(),
    ("greek", ""): "Αγάπη Φως".split(),
}
#: Longer given names: syllables and one of these.
GIVEN_ENDINGS = {
    ("latin", "f"): "ina ette elle iane".split(), ("latin", "m"): "us ert olf ian".split(), ("latin", ""): "ys ix".split(),
    ("cyrillic", "f"): "ина ия".split(), ("cyrillic", "m"): "ий ан".split(), ("cyrillic", ""): "ик уля".split(),
    ("greek", "f"): "ία ούλα".split(), ("greek", "m"): "ίος ιάς".split(), ("greek", ""): "ώ".split(),
}
#: No syllable begins with a vowel and each tells its own end, so a word has one spelling in syllables and an ending.
SYLLABLES = {
    "latin": "ba ber da del fa fen ga gor ha hol ka kel la lin ma mor na nel pa per ra ros sa sel ta ter va ven wa wim".split(),
    "cyrillic": "ба бер ва вер га гор да дел за зор ка кор ла лев ма мор на нев па пет ра рос са сер та тол".split(),
    "greek": "βα γα δα ζα θα κα λα μα να πα ρα σα τα φα χα".split(),
}
SURNAME_ENDINGS = {
    ("latin", "f"): "ner son mann ley ard ett".split(), ("latin", "m"): "ner son mann ley ard ett".split(), ("latin", ""): "ner son mann ley ard ett".split(),
    ("cyrillic", "f"): "енко ская ова ева ина ук".split(), ("cyrillic", "m"): "енко ский ов ев ин ук".split(), ("cyrillic", ""): "енко ук".split(),
    ("greek", "f"): "ίδου οπούλου".split(), ("greek", "m"): "ίδης όπουλος".split(), ("greek", ""): "έας".split(),
}

#: First code and number of letters of the classes that a replaced letter stays in.
CLASSES = (
    (48, 10), (65, 26), (97, 26), (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 7), (0x391, 17), (0x3A3, 7), (0x3B1, 17), (0x3C3, 7), (0x410, 32), (0x430, 32),
    (0x5D0, 27), (0x627, 20), (0x905, 53), (0x3041, 86), (0x30A1, 90), (0x4E00, 20902), (0xAC00, 11172),
)
HEX = {-1: "0123456789abcdef", -2: "0123456789ABCDEF"}
_BY_NUMBER = ["ssn", "ip"]  # their symbols are numbers, not letters
#: First octets of public networks that hold no private ones.
_PUBLIC = [a for a in range(1, 224) if a not in (10, 100, 127, 169, 172, 192, 198, 203)]
_PUBLIC_LIST = f"array({', '.join(map(str, _PUBLIC))})"
_LEAST_SECRET = 12  # letters and digits of a secret's replacement
_LONG = 256


def _letters(text: Column) -> Column:
    """Characters of a text, without the empty one that splitting may leave at its end."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _symbol(v: Column, r: Column, low: Column) -> Column:
    return F.struct(v.cast("int").alias("v"), r.cast("int").alias("r"), low.cast("int").alias("low"))


def _fixed(v: Column) -> Column:
    return _symbol(v, F.lit(1), F.lit(0))


def _kept(text: Column) -> Column:
    """Symbols of letters that stay."""
    return F.transform(_letters(text), lambda c: _symbol(F.lit(0), F.lit(1), F.ascii(c)))


def _classed(column: str) -> Column:
    """Symbols of a text column's letters within their classes; others stay."""
    symbol = "named_struct('v', int({}), 'r', int({}), 'low', int({}))".format
    cases = " ".join(f"WHEN ascii(c) >= {low} AND ascii(c) < {low + size} THEN {symbol(f'ascii(c) - {low}', size, low)}" for low, size in CLASSES)
    return F.expr(f"transform(filter(split({column}, ''), c -> c <> ''), c -> CASE {cases} ELSE {symbol(0, 1, 'ascii(c)')} END)")


def _hexed(text: Column, low: int) -> Column:
    return F.transform(_letters(text), lambda c: _symbol(F.call_function("instr", F.lit(HEX[low]), c) - 1, F.lit(16), F.lit(low)))


def _digit(text: Column, at: int) -> Column:
    return F.substr(text, F.lit(at), F.lit(1)).cast("int")


def _luhn(body: Column) -> Column:
    """The digit that completes ``body`` to a valid number."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((s["sum"] + F.when(s["odd"], d).otherwise(twice)).alias("sum"), (~s["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.reverse(_letters(body)), start, add, lambda s: F.pmod(-s["sum"], F.lit(10)))


def _iban_check(country: Column, account: Column) -> Column:
    """The check number (2 to 98) of an account number."""

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), F.pmod(rest * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(rest * 100 + letter, F.lit(97)))

    return F.aggregate(_letters(F.concat(account, country, F.lit("00"))), F.lit(0), lambda r, c: add(r, c).cast("int"), lambda r: F.lit(98) - r)


def _check_offset(kind: Column, norm: Column) -> Column:
    """How far a card's or IBAN's check digits are from the valid ones; it stays."""
    card = F.pmod(F.substr(norm, F.length(norm), F.lit(1)).cast("int") - _luhn(F.substr(norm, F.lit(1), F.length(norm) - 1)), F.lit(10))
    iban = F.pmod(F.substr(norm, F.lit(3), F.lit(2)).cast("int") - _iban_check(F.substr(norm, F.lit(1), F.lit(2)), F.substr(norm, F.lit(5))), F.lit(100))
    return F.when(kind == "card", card).when(kind == "iban", iban).otherwise(0)


def with_symbols(entities: DataFrame, key: str) -> DataFrame:
    """Add ``marks``: each entity's normal form as symbols, of which those of radix 1 stay.

    A secret, host or mailbox of over ``_LONG`` characters counts as its digest.
    """
    kind, norm = F.col("kind"), F.col("norm")
    cut = lambda first, last=None: F.substr(norm, F.lit(first), F.length(norm) if last is None else F.lit(last - first + 1))
    america = (kind == "phone") & (F.length(norm) == 11) & norm.startswith("1")
    known = F.regexp_extract(norm, f"^{_PREFIX}", 0)
    # the country code or issuer stays, or a key's prefix; a card's last digit follows from the others
    head = F.when(america, F.lit("1")).when(kind.isin("phone", "card"), cut(1, 2)).when(kind == "secret", known).otherwise("")
    body = (
        F.when(kind == "email", F.substring_index(norm, "@", 1)).when(kind == "host", F.regexp_extract(norm, r"^(.*)\.", 1)).when(kind == "phone", cut(3))
        .when(kind == "card", F.substr(norm, F.lit(3), F.length(norm) - 3)).when(kind == "iban", cut(5)).otherwise(F.substr(norm, F.length(known) + 1))
    )
    rows = entities.withColumns({"head": head, "body": body})
    rows = rows.withColumn("body", F.when(F.length("body") > _LONG, F.sha2(F.concat_ws("\x1f", F.lit(key), "body"), 512)).otherwise(F.col("body")))
    rows = rows.withColumn("classed", _classed("body"))

    # in North America, area and exchange begin with 2 to 9 where they did
    def lead(at: int) -> Column:
        d = _digit(norm, at)
        return F.when(d >= 2, _symbol(d - 2, F.lit(8), F.lit(50))).otherwise(_symbol(d, F.lit(2), F.lit(48)))

    exchange = F.concat(F.array(lead(2)), F.transform("classed", lambda s, i: F.when(i == 2, lead(5)).otherwise(s)))
    # social security: area, group and serial number stay valid, or what is wrong with them stays
    area, group, serial = cut(1, 3).cast("int"), cut(4, 5).cast("int"), cut(6).cast("int")
    valid = (area > 0) & (area < 900) & (area != 666)
    ssn = F.array(
        F.when(valid, _symbol(area - F.when(area > 666, 2).otherwise(1), F.lit(898), F.lit(0))).otherwise(_fixed(area)),
        F.when(group > 0, _symbol(group - 1, F.lit(99), F.lit(0))).otherwise(_fixed(group)),
        F.when(serial > 0, _symbol(serial - 1, F.lit(9999), F.lit(0))).otherwise(_fixed(serial)),
    )
    o = [F.get(F.split(norm, r"\."), k).cast("int") for k in range(4)]
    public = F.array_position(F.expr(_PUBLIC_LIST), o[0]).cast("int") - 1
    ip = F.array(
        F.when(public >= 0, _symbol(public, F.lit(len(_PUBLIC)), F.lit(1))).otherwise(_fixed(o[0])),
        F.when((o[0] == 172) & o[1].between(16, 31), _symbol(o[1] - 16, F.lit(16), F.lit(16)))
        .when((public >= 0) | o[0].isin(10, 127), _symbol(o[1], F.lit(256), F.lit(0))).otherwise(_fixed(o[1])),
        _symbol(o[2], F.lit(256), F.lit(0)),
        F.when(o[3].between(1, 254), _symbol(o[3] - 1, F.lit(254), F.lit(1))).otherwise(_fixed(o[3])),
    )
    hexes = lambda digits, low: ((kind == "secret") & norm.rlike(rf"^[{digits}]{{32,128}}\z"), _hexed(norm, low))
    marks = (
        F.when(kind == "ssn", ssn).when(kind == "ip", ip).when(*hexes("0-9a-f", -1)).when(*hexes("0-9A-F", -2))
        .otherwise(F.concat(_kept(F.col("head")), F.when(america, exchange).otherwise(F.col("classed"))))
    )
    return rows.withColumn("marks", marks).drop("head", "body", "classed")


def domain_of(kind: Column, norm: Column, marks: Column) -> Column:
    """What stays of an entity. Entities of one domain are permuted among themselves."""
    place = F.when(kind == "email", F.substring_index(norm, "@", -1)).when(kind == "host", F.substring_index(norm, ".", -1)).when(kind == "iban", F.substr(norm, F.lit(1), F.lit(2)))
    stays = F.concat_ws(".", F.transform(F.filter(marks, lambda s: s["r"] == 1), lambda s: F.concat_ws(":", s["v"].cast("string"), s["low"].cast("string"))))
    shape = F.concat_ws(".", F.transform(marks, lambda s: s["r"].cast("string")))
    return F.concat_ws("/", kind, F.coalesce(place, F.lit("")), _check_offset(kind, norm).cast("string"), stays, shape)


def _merged(marks: Column, values: Column) -> Column:
    """The symbols with new values where they do not stay."""

    def one(s: Column, m: Column) -> Column:
        free = m["r"] > 1
        new = _symbol(F.when(free, F.get(values, s["at"])).otherwise(m["v"]), m["r"], m["low"])
        return F.struct(F.concat(s["out"], F.array(new)).alias("out"), (s["at"] + F.when(free, 1).otherwise(0)).alias("at"))

    start = F.struct(F.array().cast("array<struct<v:int,r:int,low:int>>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(marks, start, one, lambda s: s["out"])


def _spelled_out(marks: Column) -> Column:
    def one(m: Column) -> Column:
        code = F.lpad(F.hex((m["v"] + m["low"]).cast("long")), 4, "0")
        out = F
        for low, digits in HEX.items():
            out = out.when(m["low"] == low, F.substr(F.lit(digits), m["v"] + 1, F.lit(1)))
        return out.otherwise(F.decode(F.unhex(code), "UTF-16BE"))

    return F.array_join(F.transform(marks, one), "")


def written(key: str, kind: Column, norm: Column, marks: Column, text: Column) -> Column:
    """The normal form of the entity that new symbols (spelled out: ``text``) stand for; a host's place is under ``example``."""
    number = lambda i: F.get(marks, i)["v"]
    free = lambda i, r: F.get(marks, i)["r"] == r
    area = F.when(free(0, 898), number(0) + F.when(number(0) + 1 >= 666, 2).otherwise(1)).otherwise(number(0))
    ssn = F.concat(F.lpad(area.cast("string"), 3, "0"), *[F.lpad((number(i) + F.when(free(i, r), 1).otherwise(0)).cast("string"), n, "0") for i, r, n in ((1, 99, 2), (2, 9999, 4))])
    first = F.when(free(0, len(_PUBLIC)), F.get(F.expr(_PUBLIC_LIST), number(0))).otherwise(number(0))
    rest = [F.when(F.get(marks, i)["r"] > 1, number(i) + F.get(marks, i)["low"]).otherwise(number(i)) for i in (1, 2, 3)]
    ip = F.concat_ws(".", *[x.cast("string") for x in (first, *rest)])
    offset = _check_offset(kind, norm)
    card = F.concat(text, F.pmod(_luhn(text) + offset, F.lit(10)).cast("string"))
    country = F.substr(norm, F.lit(1), F.lit(2))
    iban = F.concat(country, F.lpad(F.pmod(_iban_check(country, text) + offset, F.lit(100)).cast("string"), 2, "0"), text)
    missing = F.greatest(F.lit(_LEAST_SECRET) - F.size(F.filter(marks, lambda m: m["r"] > 1)), F.lit(0))
    more = F.translate(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("longer"), norm), 256), F.lit(1), missing), "0123456789", "ghijklmnop")
    host = F.concat(text, F.lit(".example."), F.substring_index(norm, ".", -1))
    return (
        F.when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "secret", F.concat(text, more)).when(kind == "host", host).otherwise(text)
    )


def assign(entities: DataFrame, key: str, reach: int = 4) -> DataFrame:
    """entities: distinct (kind, norm) but persons, with their copies. Adds canonical; all canonicals of a kind differ.

    An e-mail address's host is an entity of its own. A run of up to ``reach`` entities that follow each other on a
    ring moves past its end, if that much room is there.
    """
    kind, norm = F.col("kind"), F.col("norm")
    emails = entities.where(kind == "email").withColumn("host", F.substring_index("norm", "@", -1))
    hosts = emails.groupBy(F.lit("host").alias("kind"), F.col("host").alias("norm")).agg(F.count("*").alias("copies"))
    # every step is a column of its own, so that each is computed once
    placed = with_symbols(entities.unionByName(hosts), key)
    free = F.filter("marks", lambda s: s["r"] > 1)
    placed = placed.withColumns({"radices": F.transform(free, lambda s: s["r"]), "values": F.transform(free, lambda s: s["v"]), "domain": domain_of(kind, norm, F.col("marks"))})
    placed = placed.withColumns({"ring": permuted(key, F.col("domain"), F.col("values"), F.col("radices")), "step": step(key, F.col("domain"), F.col("radices"))})
    placed = placed.withColumn("place", F.xxhash64("domain", spelled(F.col("ring")))).drop("values")
    placed = materialize(placed, "pii-rings")
    at = lambda by: F.xxhash64("domain", spelled(advance(F.col("ring"), F.col("radices"), F.col("step") * by)))

    held = placed.select(F.col("place").alias("held"))
    followed = placed.where("step > 0").select("place", at(F.lit(1)).alias("next")).join(held, F.col("next") == F.col("held"))
    met = materialize(followed.select(F.explode(F.array("place", "next")).alias("place")).distinct(), "pii-met")
    moves = F.lit(1)
    if not met.isEmpty():
        near = placed.join(met, "place", "left_semi").select("kind", "norm", "domain", "ring", "radices", "step")
        offsets = [F.lit(j) for j in range(-reach, 2 * reach + 1) if j]
        near = near.withColumn("offset", F.explode(F.array(*offsets))).withColumn("seen", at(F.col("offset")))
        seen = near.join(held, F.col("seen") == F.col("held"), "left")
        seen = seen.groupBy("kind", "norm").agg(F.collect_set(F.when(F.col("held").isNotNull(), F.col("offset"))).alias("near"))
        gap = lambda sign, most: F.array_min(F.array_except(F.array(*[F.lit(j) for j in range(1, most + 2)]), F.transform("near", lambda j: j * sign))) - 1
        seen = seen.withColumns({"ahead": gap(1, reach), "behind": gap(-1, reach)}).withColumn("run", F.col("ahead") + F.col("behind") + 1)
        # beyond ``reach`` nothing is known, so neither is a run that may go on there
        short = (F.col("run") <= reach) & (F.size(F.array_intersect("near", F.sequence(F.col("ahead") + 1, F.col("ahead") + F.col("run")))) == 0)
        runs = seen.select("kind", "norm", F.when(short, F.col("run")).otherwise(1).alias("move"))
        placed = placed.join(runs, ["kind", "norm"], "left")
        moves = F.coalesce("move", F.lit(1))
    moved = placed.withColumn("moved", advance(F.col("ring"), F.col("radices"), F.col("step") * moves))
    moved = moved.withColumn("back", permuted(key, F.col("domain"), F.col("moved"), F.col("radices"), back=True)).withColumn("new", _merged(F.col("marks"), F.col("back")))
    moved = moved.withColumn("body", _spelled_out(F.col("new"))).withColumn("canonical", written(key, kind, norm, F.col("new"), F.col("body")))
    moved = materialize(moved.select("kind", "norm", "copies", "canonical"), "pii-canonical")
    emails = moved.where(kind == "email").withColumn("host", F.substring_index("norm", "@", -1)).withColumnRenamed("canonical", "local")
    hosts = moved.where(kind == "host").select(F.col("norm").alias("host"), F.col("canonical").alias("new_host"), F.col("copies").alias("addresses"))
    emails = spread_join(emails, hosts, ["host"], "addresses").withColumn("canonical", F.concat("local", F.lit("@"), "new_host"))
    return moved.where(~kind.isin("email", "host")).unionByName(emails.select("kind", "norm", "copies", "canonical"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def drawn_name(key: str, kind: Column, norm: Column, gender: Column, attempt: int) -> Column:
    """The name that a word of a name draws at an attempt; those of different attempts differ."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, gender, norm, F.lit(str(attempt))), 512)

    def pick(words: list[str], s: Column, at: int) -> Column:
        number = F.conv(F.substr(s, F.lit(1 + 4 * at % 120), F.lit(4)), 16, 10).cast("int")
        return F.element_at(F.split(F.lit(" ".join(words).lower()), " "), F.pmod(number, F.lit(len(words))) + 1)

    def of(s: Column) -> Column:
        out = F
        for (script, sex), names in FIRST.items():
            long = lambda n: [pick(SYLLABLES[script], s, 2 + k) for k in range(n)]  # noqa: E731, B023
            given = F.concat(*long(1 + attempt), pick(GIVEN_ENDINGS[script, sex], s, 1)) if attempt else pick(names, s, 0)
            surname = F.concat(*long(2 + attempt), pick(SURNAME_ENDINGS[script, sex], s, 1))
            out = out.when((_script(norm) == script) & (gender == sex), F.when(kind == "given", given).otherwise(surname))
        return out

    return let(stream, of)


def assign_names(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct (kind, norm, gender), kind "given" or "surname". Adds canonical; all canonicals of a kind differ."""
    todo, done, attempt = entities, [], 0
    names = entities.select("kind", F.col("norm").alias("canonical"))
    while True:
        drawn = todo.withColumn("canonical", drawn_name(key, F.col("kind"), F.col("norm"), F.col("gender"), attempt))
        turn = F.struct(F.sha2(F.concat_ws("/", F.lit(key), "norm", "gender"), 256).alias("turn"), "norm", "gender")
        first = drawn.groupBy("kind", "canonical").agg(F.min(turn).alias("of")).select("kind", "canonical", "of.norm", "of.gender")
        done.append(materialize(first.join(names, ["kind", "canonical"], "left_anti"), "pii-names"))
        left = todo.join(done[-1], ["kind", "norm", "gender"], "left_anti")
        if left.isEmpty():
            return entities.join(reduce(DataFrame.unionByName, done), ["kind", "norm", "gender"])
        todo, attempt = materialize(left, "pii-left"), attempt + 1


def leads(found: Column, gaps: Column) -> Column:
    """Per match, in order: "named" in quotes behind a word for a secret; behind an honorific "title", or its gender; else null."""
    more = rf"(?:(?:{'|'.join(TITLES[''])})\.? ){{0,2}}"

    def one(_, i: Column) -> Column:
        before = F.substring(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), -48, 48)
        lead = F.when(before.rlike(rf"{_NAMED}\z") & F.get(gaps, i + 1).startswith('"'), "named")
        for sex, names in TITLES.items():
            lead = lead.when(before.rlike(rf"(?<!\p{{L}})(?:{'|'.join(names)})\.? {more if sex else ''}\z"), sex or "title")
        return lead

    return F.transform(found, one)


def kind_of(found: Column, lead: Column) -> Column:
    """The kind of a match, by the first pattern that it fits whole."""
    named = F.coalesce(lead == "named", F.lit(False)) & found.rlike(r"^[^\"\s]{8,}+\z")
    tests = {
        "email": found.contains("@") & (~named | found.rlike(rf"^(?:{PATTERNS['email']})\z")),
        "secret": named | found.rlike(rf"^(?:{_KEYS})\z"),
        "ip": found.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"),
        "ssn": found.rlike(r"^\d{3}-\d{2}-\d{4}$"),
        "phone": found.startswith("+") | found.startswith("(") | found.rlike(r"^\d{3}[.-]\d{3}[.-]\d{4}$"),
        "card": found.rlike(r"^\d([ -]?\d){12,18}$"),
        "iban": found.rlike(r"^[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?$"),
    }
    first = F
    for kind, test in tests.items():
        first = first.when(test, kind)
    return first.otherwise("person")


def normal_form(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, r"\D", "")
    phone = F.when(found.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits))  # layouts without a country code are North America's
    return (
        F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(found)).otherwise(found)
    )


def render(kind: Column, found: Column, canonical: Column) -> Column:
    """Write a replacement's normal form in the layout of the place where the entity was found."""

    def laid_out(pattern: str) -> Column:
        def one(s: Column, c: Column) -> Column:
            hit = c.rlike(pattern)
            text = F.concat(s["text"], F.when(hit, F.substr(canonical, s["at"], F.lit(1))).otherwise(c))
            return F.struct(text.alias("text"), (s["at"] + F.when(hit, 1).otherwise(0)).alias("at"))

        size = F.length(F.regexp_replace(found, f"(?!{pattern}).", ""))
        start = F.struct(F.lit("").alias("text"), (F.length(canonical) - size + 1).alias("at"))  # a country code may be left out
        return F.aggregate(_letters(found), start, one, lambda s: s["text"])

    shout = (found == F.upper(found)) & (found != F.lower(found))
    return (
        F.when(kind.isin("phone", "card", "ssn"), laid_out("[0-9]")).when(kind == "iban", laid_out("[0-9A-Z]"))
        .when(kind == "person", F.when(shout & (F.length(found) > 1), F.upper(canonical)).otherwise(F.initcap(canonical)))
        .when(kind == "email", F.when(shout, F.upper(canonical)).otherwise(canonical)).otherwise(canonical)
    )


def _names(mentions: DataFrame) -> DataFrame:
    """mentions of persons (text, at, raw, lead, copies) -> a row per word of a name: text, at, pos, raw, kind, norm, gender."""
    words = F.split("raw", " ")
    sure = (F.size(words) > 1) | F.col("lead").isNotNull()
    given = F.lower(F.get(words, F.lit(0)))
    listed = F
    for sex, names in GIVEN.items():
        listed = listed.when(given.isin([n.lower() for n in names]), sex)
    own = F.when(F.col("lead").isin("f", "m"), F.col("lead")).otherwise(F.when(F.size(words) > 1, listed))
    split = mentions.select("text", "at", F.size(words).alias("n"), own.alias("own"), sure.alias("sure"), F.posexplode(words).alias("pos", "raw"))
    split = split.withColumn("norm", F.lower("raw"))
    role = F.when(F.col("sure"), F.when(F.col("pos") == F.col("n") - 1, "surname").otherwise("given"))
    same = Window.partitionBy("text", "norm")
    # a word alone is the surname of someone in the text, else a given name
    split = split.withColumn("kind", F.coalesce(role, F.max(role).over(same), F.lit("surname")))
    of_name = Window.partitionBy("text", "norm", "kind")
    nearest = lambda *order: F.last("own", ignorenulls=True).over(of_name.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    gender = F.coalesce(nearest("at", "pos"), nearest(F.desc("at"), F.desc("pos")), F.lit(""))
    return split.select("text", "at", "pos", "raw", "kind", "norm", gender.alias("gender"))


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies"))


def replace_entities(docs: DataFrame, key: str, kinds: str | None = "pii_kinds") -> DataFrame:
    """``docs`` with entities of ``text`` replaced, and ``kinds``: the kind of each, in order (left out if None)."""
    columns = [c for c in docs.columns if c != kinds]
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*[F.col(ref(c)).alias(c) for c in columns]).alias("row"), F.col("text").alias("body"))
    found = F.when(F.col("body").rlike(HINT), F.regexp_extract_all("body", F.lit(ANY), F.lit(0)))
    marked = rows.withColumn("found", F.coalesce(found, none))

    def finished(rows_: DataFrame, kinds_: Column) -> DataFrame:
        return rows_.select("row.*", *([] if kinds is None else [kinds_.alias(kinds)]))

    marked = marked.withColumn("text", F.when(F.size("found") > 0, F.md5("body")))
    # a text that introduces persons is searched again, for their names alone
    named = F.when(F.exists("found", lambda x: x.rlike(rf"^{_NAME}")), F.regexp_extract_all("body", F.lit(PATTERNS["person"]), F.lit(0)))
    marked = marked.withColumn("words", F.array_distinct(F.flatten(F.transform(F.coalesce(named, none), lambda x: F.split(x, " ")))))
    again = F.array_join("words", "|")
    pattern = F.concat(F.lit(ANY + r"|(?=\p{Lu})(?<!\p{L})(?:"), again, F.lit(r")(?!\p{L})(?: (?:"), again, F.lit(r")(?!\p{L})){0,2}"))
    marked = marked.withColumn("pattern", F.when(F.size("words") > 0, pattern).otherwise(F.lit(ANY)))
    marked = marked.withColumn("found", F.when(F.size("words") > 0, F.regexp_extract_all("body", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
    marked = marked.withColumn("gaps", F.when(F.size("found") > 0, F.split("body", F.col("pattern"), -1)))
    marked = marked.withColumn("lead", F.when(F.size("found") > 0, leads(F.col("found"), F.col("gaps"))))
    blank = F.when(F.size("found") > 0, F.col("row").withField("text", F.lit(None).cast("string"))).otherwise(F.col("row"))  # the gaps and the matches are the text
    # stored whole, so that no text is searched twice
    marked = materialize(marked.select(blank.alias("row"), "text", "found", "gaps", "lead"), "pii-rows")
    clean = finished(marked.where(F.size("found") == 0), none)
    hit = marked.where(F.size("found") > 0)

    texts = hit.groupBy("text").agg(F.first("found").alias("found"), F.first("lead").alias("leads"), F.count("*").alias("copies"))
    texts = materialize(texts, "pii-texts")
    each = texts.select("text", "leads", F.posexplode("found").alias("at", "raw")).withColumn("lead", F.get("leads", F.col("at"))).drop("leads")
    each = each.withColumn("kind", kind_of(F.col("raw"), F.col("lead")))

    others = each.where("kind <> 'person'").withColumn("norm", normal_form(F.col("kind"), F.col("raw"))).select("text", "at", "raw", "kind", "norm")
    known = materialize(_counted(others, "kind", "norm"), "pii-entities")
    others = spread_join(others, materialize(assign(known, key), "pii-map"), ["kind", "norm"], "copies")
    others = others.select("text", "at", render(F.col("kind"), F.col("raw"), F.col("canonical")).alias("new"), "kind")

    names = materialize(_names(each.where("kind = 'person'")), "pii-names")
    known = materialize(_counted(names, "kind", "norm", "gender"), "pii-entities")
    names = spread_join(names, materialize(assign_names(known, key), "pii-map"), ["kind", "norm", "gender"], "copies")
    new = render(F.lit("person"), F.col("raw"), F.col("canonical"))
    names = names.groupBy("text", "at").agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("new")))).alias("w"))
    names = names.select("text", "at", F.array_join(F.col("w.new"), " ").alias("new"), F.lit("person").alias("kind"))

    woven = others.unionByName(names).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("at", "new", "kind"))).alias("w"))
    woven = materialize(woven.join(texts.select("text", "copies"), "text").select("text", F.col("w.new").alias("new"), F.col("w.kind").alias("kinds"), "copies"), "pii-woven")
    joined = spread_join(hit, woven, ["text"], "copies")
    whole = F.array_join(F.flatten(F.zip_with("gaps", "new", lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    return clean.unionByName(finished(joined.withColumn("row", F.col("row").withField("text", whole)), F.col("kinds")))
