"""PII surrogates: detected entities give way to keyed, type-consistent replacements, in DataFrame operations alone.

Entities are e-mail addresses, telephone numbers, IPv4 addresses, card numbers (13 to 19 digits), US social security
numbers, IBANs and personal names. A name is found after a title; its words are then found wherever they stand in the same text
as whole words with the same capitals, with or without a title. Names in texts that never give them a title are not found.

An entity's surrogate depends on the key, its type and its canonical form (digits alone, lower case, ...), so that one person or
number has one surrogate wherever and however it is written. Digits become digits and letters become letters of the same script
and case, separators stay; cards keep their validity by check digit, IBANs their country, telephone numbers their country code.
Names go word by word, the last word after a title as family name and those before it as given names, so that "Dr Jane Doe",
"Mrs Doe" and "Jane" agree: a family name has one surrogate, and a given name one for each gender. Its gender is that of the title;
after a title without one, it is the gender of all other titles that the given name has in the corpus, if that is one.
Titles and scripts stay.

Surrogates are checked for collisions over all documents: where two canonical forms would get one surrogate, or a surrogate is
itself an entity of the corpus, all but the first get another try number, until none is left; should ``TRIES`` rounds not do, that
is an error. Lists of names are soon used up, and further tries make names of syllables. Only what differs from a first try
is kept, as a table that is joined to entities. A bitmap of ``BITMAP`` bits tells which texts may have such entities (the
fuller it is the more); the others are neither joined nor shuffled.

Defined results: a null text stays null and an empty one empty; texts are read whole; equal rows get equal results; of
overlapping entities the leftmost, and then the first kind in ``KINDS``, counts; an empty table gives an empty result; extra columns pass
through, and new ones give way to clashing names. A doc_id on several rows, or null, is fine: tries go by entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fresh, table

KEY = "millrace-surrogates-1"
KINDS = ("email", "iban", "phone", "ssn", "card", "ip", "name")
TRIES = 40
#: Bits of the map of entities that are not first tries; it is a constant of the plan.
BITMAP = 1 << 18

# Titles by gender, and given and family names by script and gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Г-жа", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин", "Κύριος"),
    "n": ("Dr", "Prof", "Mx"),
}
NAMES = {
    ("latin", "f"): "Alda Berit Carola Delia Edith Fiona Greta Helga Ingrid Jolanda Karin Lorna Mirta Nadine Odile Petra Renata Selma Thea Ursula Vera Wanda Yvonne Zita".split(),
    ("latin", "m"): "Alwin Boris Carsten Dario Edgar Falk Gerrit Holger Ivor Jannis Konrad Lothar Milo Nils Oskar Piet Ruben Stellan Tibor Ulf Viktor Wim Yorick Zeno".split(),
    ("latin", "n"): "Alexis Robin Kim Sascha Jules Noa Sidney Toni Andrea Dominique Jamie Lou Maxime Nikita Quinn Rowan Sam Taylor".split(),
    ("latin", "last"): "Abendroth Bellweg Corvin Delacour Ehrlich Fontane Garnier Holmgren Isaksen Jansson Kestrel Lindqvist Marlow Northam Ostermann Pellerin Quandt Rosander Sorel Thornby Ullmann Vasseur Westerby Ybarra Zellner".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Кира Лидия Майя Нина Ольга Рита Тамара".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Марк Олег Павел Роман Тимур".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура".split(),
    ("cyrillic", "last"): "Абраменко Бондаренко Витович Горчак Дубинюк Ершевич Журавель Зубенко Кравец Лисовик Мельник Носенко Остапчук".split(),
    ("greek", "f"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αντώνης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάριος Νίκος Πέτρος".split(),
    ("greek", "n"): "Χάρις Άρτεμις Αγάπη".split(),
    ("greek", "last"): "Αλεξίου Βλάχου Γαλάνη Δούκα Ζέρβα Ιωάννου Κόλλια Λάππα Μακρή Νικολάου".split(),
}
#: Syllables by script, 100 each, of which further tries make names, and how these end by gender.
SYLLABLES = {
    "latin": [c + v for c in "b d f g h j k l m n p r s t v w z br kl st".split() for v in "aeiou"],
    "cyrillic": [c + v for c in "б в г д ж з к л м н п р с т ф х ц ш бр ст".split() for v in "аеиоу"],
    "greek": [c + v for c in "β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ ψ βρ κλ στ".split() for v in "αειου"],
}
ENDINGS = {"latin": {"f": "na", "m": "ro", "n": "is"}, "cyrillic": {"f": "на", "m": "мир", "n": "ша"}, "greek": {"f": "να", "m": "ρος", "n": "χη"}}

_EDGE, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![\p{L}\p{N}])",
    "iban": _EDGE + r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?" + _END,
    "phone": r"(?<![0-9A-Za-z_+])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,5}\)[\x20.-]?)?[0-9]{2,5}(?:[\x20.-]?[0-9]{2,5}){1,4}|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "card": _EDGE + r"(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}" + _END + "|" + _EDGE + r"[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}" + _END + "|" + _EDGE + r"[0-9]{13,19}" + _END,
    "ip": r"(?<![0-9A-Za-z_.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9A-Za-z_])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.?\x20\p{{Lu}}[\p{{L}}'’-]+(?:\x20\p{{Lu}}[\p{{L}}'’-]+){{0,2}}",
}
_TITLED = rf"^((?:{_TITLE})\.?\x20)"
#: One scan for all kinds; where several begin at one place the first counts.
PATTERN = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
#: What every entity has, to pass over the other texts quickly.
HINT = rf"[0-9@]|(?:{_TITLE})\.?\x20\p{{Lu}}"


def kind_of(found: Column) -> Column:
    """The first kind whose pattern is the whole of an entity; "mention" is a word of a name that has no title."""
    tests = [found.contains("@"), *(found.rlike(rf"\A(?:{PATTERNS[k]})\z") for k in KINDS[1:])]
    return reduce(lambda rest, kt: F.when(kt[1], F.lit(kt[0])).otherwise(rest), reversed(list(zip(KINDS, tests, strict=True))), F.lit("mention"))


def canonical(kind: Column, found: Column) -> Column:
    """What is the same for all spellings of one entity."""
    bare = F.regexp_replace(found, r"[^0-9A-Za-z]", "")
    digits = F.regexp_replace(found, r"[^0-9]", "")
    return F.when(kind.isin("email", "given", "family"), F.lower(found)).when(kind == "iban", bare).when(kind == "ip", found).otherwise(digits)


def _stream(key: str, kind: Column, canon: Column, attempt: Column, n: int = 2) -> Column:
    """Keyed hexadecimal digits of an entity, 64 for each of ``n``."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt, F.lit(str(i))), 256) for i in range(n)])


def _number(stream: Column, at: Column | int, digits: int = 3) -> Column:
    """A number from ``digits`` hexadecimal digits of the stream, read from place ``at`` on, around its end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(stream, F.pmod(at * digits, F.lit(120)) + 1, F.lit(digits)), 16, 10).cast("int")


def _pick(choices: str, number: Column) -> Column:
    return F.substr(F.lit(choices), F.pmod(number, F.lit(len(choices))) + 1, F.lit(1))


LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _poured(found: Column, stream: Column) -> Column:
    """``found`` with digits for digits and letters for letters of script and case; the rest stays.

    A character's replacement depends on how many digits or letters stand before it, not on separators.
    """
    def one(c: Column, i: Column) -> Column:
        r = _number(stream, i)
        out = F.when(c.rlike("[0-9]"), _pick("0123456789", r))
        for test, letters in zip((r"[a-z]", r"[A-Z]", r"\p{IsCyrillic}&&\p{Ll}", r"\p{IsCyrillic}&&\p{Lu}", r"\p{IsGreek}&&\p{Ll}", r"\p{IsGreek}&&\p{Lu}"), LETTERS, strict=True):
            out = out.when(c.rlike(test if test[0] == "[" else f"[{test}]"), _pick(letters, r))
        return out.when(c.rlike(r"\p{Lu}"), _pick(LETTERS[1], r)).when(c.rlike(r"\p{L}"), _pick(LETTERS[0], r)).otherwise(c)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    return F.aggregate(F.split(found, ""), start, lambda a, c: F.struct(F.concat(a["out"], one(c, a["i"])).alias("out"), (a["i"] + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("i")), lambda a: a["out"])


def _luhn(digits: Column) -> Column:
    """The sum of a digit string that a valid number has as a multiple of 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x["i"] % 2 == 0, x["d"]).otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)))


def _card(found: Column, poured: Column, stream: Column) -> Column:
    """First digit kept; the last one makes the number valid exactly where ``found`` was."""
    head = F.concat(F.substr(found, F.lit(1), F.lit(1)), F.substr(poured, F.lit(2), F.length(poured) - 2))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(F.regexp_replace(head, "[^0-9]", ""), F.lit("0"))), F.lit(10)), F.lit(10))
    valid = F.pmod(_luhn(F.regexp_replace(found, "[^0-9]", "")), F.lit(10)) == 0
    off = F.pmod(check + 1 + F.pmod(_number(stream, 30), F.lit(9)), F.lit(10))
    return F.concat(head, F.when(valid, check).otherwise(off).cast("string"))


def _ip(stream: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(_number(stream, i), F.lit(254)) + 1).cast("string") for i in range(4)])


def _gender(found: Column) -> Column:
    gender = F.lit("n")
    for g in "fm":
        gender = F.when(found.rlike(rf"^(?:{'|'.join(TITLES[g])})\b"), F.lit(g)).otherwise(gender)
    return gender


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def name_word(word: Column, kind: Column, by: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of a given name (of the gender ``by``) or family name, capital for capital."""
    script, role = script_of(word), F.when(kind == "family", "last").otherwise(by)
    choose = lambda table: F.split(reduce(lambda rest, st: F.when(st[0], F.lit(st[1])).otherwise(rest), table, F.lit("")), " ")
    lists = choose([((script == s) & (role == r), " ".join(names)) for (s, r), names in NAMES.items()])
    parts = choose([(script == s, " ".join(x)) for s, x in SYLLABLES.items()])
    end = choose([((script == s) & (role == g), x) for s, ends in ENDINGS.items() for g, x in ends.items()])

    def new(stream: Column) -> Column:
        listed = bound(lists, lambda names: F.element_at(names, F.pmod(_number(stream, 1, 4), F.size(names)) + 1))
        # The lists are short. Further tries make names of syllables, one more each time, so that there is room for as many people as there are.
        some = F.sequence(F.lit(1), F.least(attempt.cast("int") + 2, F.lit(8)))
        made = bound(parts, lambda parts: F.array_join(F.transform(some, lambda i: F.element_at(parts, F.pmod(_number(stream, i + 1, 4), F.lit(100)) + 1)), ""))
        return F.when(attempt > 0, F.initcap(F.concat(made, F.element_at(end, 1)))).otherwise(listed)

    made = bound(_stream(key, kind, F.concat_ws("\x1f", by, F.lower(word)), attempt.cast("string")), new)
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(made)).otherwise(made)


def surrogate(found: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of an entity, other than a name, as it is written."""
    # Of an address all but the top domain is replaced.
    top = F.when(found.contains("@"), F.regexp_extract(found, r"(\.[A-Za-z]+)$", 1)).otherwise("")
    code = F.regexp_extract(found, r"^(\+[0-9]{1,3})", 1)

    def of(kind: Column, stream: Column, poured: Column) -> Column:
        return (F.when(kind == "email", F.concat(poured, top)).when(kind == "iban", F.concat(F.substr(found, F.lit(1), F.lit(2)), F.substr(poured, F.lit(3))))
                .when(kind == "phone", F.concat(code, F.substr(poured, F.length(code) + 1))).when(kind == "card", _card(found, poured, stream))
                .when(kind == "ip", _ip(stream)).otherwise(poured))

    # Each is bound, as it stands in the next one many times.
    body = F.substr(found, F.lit(1), F.length(found) - F.length(top))
    poured = lambda kind, stream: bound(_poured(body, stream), lambda p: of(kind, stream, p))
    return bound(kind_of(found), lambda kind: bound(_stream(key, kind, canonical(kind, found), attempt.cast("string")), lambda stream: poured(kind, stream)))


def entities(text: Column) -> Column:
    """The entities of a text, in order, as they are written; of names those with a title."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


FORM = "struct<kind:string,canon:string,by:string,found:string>"


def form(kind: Column, found: Column, by: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), canonical(kind, found).alias("canon"), (F.lit("") if by is None else F.when(kind == "given", by).otherwise("")).alias("by"), found.alias("found")).cast(FORM)


def name_forms(found: Column) -> Column:
    """A form for each word of a name with its title."""
    word = lambda names, by: F.transform(names, lambda w, i: bound(F.when(i == F.size(names) - 1, "family").otherwise("given"), lambda kind: form(kind, w, by)))
    return bound(_gender(found), lambda by: bound(F.split(F.regexp_replace(found, _TITLED, ""), " "), lambda names: word(names, by)))


def forms(found: Column) -> Column:
    """The forms of the entities ``found``; each has a surrogate of its own."""
    each = lambda m: bound(kind_of(m), lambda kind: F.when(kind == "name", name_forms(m)).otherwise(F.array(form(kind, m))))
    return F.when(F.size(found) > 0, F.flatten(F.transform(found, each))).otherwise(F.array().cast(f"array<{FORM}>"))


def pool(kind: Column) -> Column:
    """What must differ: all name words from each other, and others within their kind."""
    return F.when(kind.isin("given", "family"), "word").otherwise(kind)


def made_new(state: DataFrame, key: str) -> DataFrame:
    """``state``, with ``kind``, ``canon``, ``by``, ``found`` and ``attempt``, plus ``image``, the canonical form of the surrogate.

    The expression for all kinds is long to plan, so only that of the kinds that occur is.
    """
    kinds = {r["kind"] for r in state.select("kind").distinct().collect()}  # at most ``KINDS`` and two more
    words = state.where("kind in ('given', 'family')").withColumn("image", canonical(F.col("kind"), name_word(F.col("found"), F.col("kind"), F.col("by"), F.col("attempt"), key)))
    rest = state.where("kind not in ('given', 'family')").withColumn("image", canonical(F.col("kind"), surrogate(F.col("found"), F.col("attempt"), key)))
    return words if kinds <= {"given", "family"} else rest if not kinds & {"given", "family"} else words.union(rest)


def tries(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``(kind, canon, by, sex, attempt)`` of the forms that need a try above 0, or another gender than their title says, over all of ``docs``.

    Each round keeps, of the forms that share a surrogate, one: the one settled longest, then the least; the others, and those whose
    surrogate is an entity itself, try again. A form is tried in its least spelling. A round that is not the first makes only the
    surrogates of those that try again.
    """
    found = docs.select(F.inline(forms(entities(F.col("text")))))
    seen = table(found.groupBy("kind", "canon", "by").agg(F.min("found").alias("found")), "entities")
    genders = seen.where("kind = 'given' and by != 'n'").groupBy("canon").agg(F.min("by").alias("x"), F.max("by").alias("y")).where("x = y").select(F.lit("given").alias("kind"), "canon", F.lit("n").alias("by"), F.col("x").alias("sex"))
    known = table(seen.join(genders, ["kind", "canon", "by"], "left").withColumn("sex", F.coalesce("sex", "by")), "forms")
    state = known.groupBy("kind", "canon", F.col("sex").alias("by")).agg(F.min("found").alias("found")).withColumn("attempt", F.lit(0))
    made = table(made_new(state, key), "images")
    own, ours = F.struct("attempt", "kind", "canon", "by"), ["kind", "canon", "by"]
    for _ in range(TRIES):
        first = made.groupBy(pool(F.col("kind")).alias("pool"), "image").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = made.withColumn("pool", pool(F.col("kind"))).join(first, ["pool", "image"]).where(own != F.col("first")).select(*ours)
        real = known.select(pool(F.col("kind")).alias("pool"), F.col("canon").alias("image")).distinct()
        taken = made.withColumn("pool", pool(F.col("kind"))).join(real, ["pool", "image"], "left_semi").select(*ours)
        again = table(twice.union(taken).distinct(), "again")
        if not again.limit(1).count():
            break
        rest = made.join(again, ours, "left_anti").select(*ours, "found", "attempt", "image")
        more = made.join(again, ours, "left_semi").select(*ours, "found", (F.col("attempt") + 1).alias("attempt"))
        made = table(rest.union(made_new(more, key)), "images")
    else:
        raise ValueError(f"entities that still share a surrogate after {TRIES} tries: {sorted({r.kind for r in again.select('kind').distinct().collect()})}")
    done = made.select("kind", "canon", F.col("by").alias("sex"), "attempt")
    return table(known.select("kind", "canon", "by", "sex").join(done, ["kind", "canon", "sex"]).where("attempt > 0 or sex != by").select("kind", "canon", "by", "sex", "attempt"), "tries")


def bitmap(rows: DataFrame) -> Column:
    """The constant array of longs in which the slots of the forms ``rows`` are set."""
    slot = F.pmod(F.xxhash64("kind", "canon", "by"), F.lit(BITMAP))
    words = rows.groupBy(F.floor(slot / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits"))
    out = [0] * (BITMAP // 64)
    for r in words.collect():  # at most BITMAP / 64 rows
        out[r["w"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<bigint>")


def label(f: Column) -> Column:
    return F.concat_ws("\x1f", f["kind"], f["by"], f["canon"])


def replace(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and a last column: the number of entities by kind.

    ``n_chars`` is counted anew where there is such a column and the text has changed.
    """
    counts, of, titled, at = fresh(docs, "n_entities", "_of", "_titled", "_at")
    source = docs if text == "text" else docs.withColumn("text", F.col(text))
    more = tries(source.select("text"), key)
    ready = docs.withColumn(titled, entities(F.col(text)))
    none = F.lit(None).cast("map<string,struct<sex:string,attempt:int>>")
    if not more.limit(1).count():
        return _replaced(ready.withColumn(of, none), docs, key, text, counts, of, titled)
    bits = bitmap(more)
    slot = lambda f: F.pmod(F.xxhash64(f["kind"], f["canon"], f["by"]), F.lit(BITMAP))
    hit = F.coalesce(F.exists(forms(F.col(titled)), lambda f: F.getbit(F.element_at(bits, F.floor(slot(f) / 64).cast("int") + 1), F.pmod(slot(f), F.lit(64)).cast("int")) == 1), F.lit(False))
    ready = ready.withColumn(at, F.when(hit, F.xxhash64(text)))
    touched = ready.where(F.col(at).isNotNull())
    # What is not a first try comes to a text as a map, by the forms of its entities; equal texts have one.
    wanted = touched.select(F.col(at).alias("_text"), F.inline(forms(F.col(titled)))).select("_text", "kind", "canon", "by").distinct().join(more, ["kind", "canon", "by"])
    maps = wanted.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "by", "canon"), F.struct("sex", "attempt")))).alias(of))
    joined = touched.join(maps, F.col(at) == F.col("_text"), "left").select(*docs.columns, titled, of)
    rest = ready.where(F.col(at).isNull()).withColumn(of, none).select(*docs.columns, titled, of)
    return _replaced(joined.union(rest), docs, key, text, counts, of, titled)


def _replaced(ready: DataFrame, docs: DataFrame, key: str, text: str, counts: str, of: str, titled: str) -> DataFrame:
    """``ready`` has the ``titled`` entities of each text, and ``of``, what is not a first try."""
    t = F.col(text)
    entries, gaps, known = fresh(ready, "_found", "_pieces", "_parts")
    ready = ready.withColumn(known, F.array_distinct(F.flatten(F.transform(F.filter(F.col(titled), lambda m: m.rlike(_TITLED)), name_forms))))
    # Longer words first, as one may be the beginning of another.
    words = F.array_sort(F.array_distinct(F.transform(F.col(known), lambda f: f["found"])), lambda a, b: F.length(b) - F.length(a))
    anywhere = F.concat(F.lit(PATTERN + r"|(?<![\p{L}'’-])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}'’-])"))
    has_name = F.size(known) > 0
    found = F.when(has_name, F.regexp_extract_all(t, anywhere, F.lit(0))).otherwise(F.col(titled))
    pieces = F.when(has_name, F.split(t, anywhere, -1)).otherwise(F.split(t, PATTERN, -1))

    def word(f: Column) -> Column:
        entry = F.try_element_at(of, label(f))
        return name_word(f["found"], f["kind"], F.coalesce(entry["sex"], f["by"]), F.coalesce(entry["attempt"], F.lit(0)), key)

    def other(m: Column, kind: Column) -> Column:
        return surrogate(m, F.coalesce(F.try_element_at(of, label(form(kind, m)))["attempt"], F.lit(0)), key)

    def new(m: Column, kind: Column, parts: Column) -> Column:
        # A word that is both somebody's given and somebody's family name goes as family name.
        own = F.array_sort(F.filter(parts, lambda f: f["found"] == m), lambda a, b: F.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0))
        words = F.when(kind == "name", name_forms(m)).otherwise(F.slice(own, 1, 1))
        return F.when(kind.isin("name", "mention"), F.concat(F.regexp_extract(m, _TITLED, 1), F.array_join(F.transform(words, word), " "))).otherwise(other(m, kind))

    hit = F.size(F.col(titled)) > 0
    ready = ready.withColumn(gaps, F.when(hit, pieces)).withColumn(entries, F.when(hit, found).otherwise(F.array().cast("array<string>")))
    ready = ready.withColumn(entries, F.transform(entries, lambda m: F.struct(m.alias("found"), kind_of(m).alias("kind"))))
    ready = ready.withColumn(entries, F.transform(entries, lambda e: F.struct(e["kind"].alias("kind"), new(e["found"], e["kind"], F.col(known)).alias("new"))))
    glued = F.concat(F.array_join(F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(entries)), F.col(entries), lambda p, m: F.concat(p, m["new"])), ""), F.element_at(gaps, -1))
    of_kind = lambda k: F.size(F.filter(entries, lambda m: m["kind"].isin([k, "mention"] if k == "name" else [k]))).cast("long").alias(k)
    number = F.struct(*map(of_kind, KINDS))
    changed, = fresh(ready, "_new")
    ready = ready.withColumn(changed, F.when(hit, glued).otherwise(t))
    out = [F.col(changed).alias(c) if c == text else F.when(hit, F.length(changed).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return ready.select(*out, number.alias(counts))
