"""Personal data replaced by surrogates, with DataFrame functions only.

Detected entities: e-mail addresses, network addresses, telephone and identity numbers, card and account numbers, secrets, and names after a title.
A surrogate is made from a keyed hash of the entity's normal form, so that all mentions of an entity, in any document and any spelling of
its format, get the same one; it keeps kind and format (digits stay digits, letters letters, punctuation its place, cards their first digit
and a valid check digit), and a name keeps its title, gender, script and number of parts.

Coreference: a name is replaced part by part, family name by family name and given name by given name, so "Mr John Smith", "Dr Smith" and "John Smith" stay
one person. Titles take no part in the hash; a given name has the gender that the titles of the corpus give it, or neither where they
disagree or tell nothing. In a document that names a person with a title, the full name and the family name are found without one too;
an untitled name is not looked for in other documents. A telephone number with and without the country code 1 is one number.

Collision check: over all entities of the corpus, no two may get the same surrogate, and none may get one that is itself an entity of the
corpus. The lesser normal form keeps a surrogate that two would get; the others are hashed again until none collide; forms of names grow with
the rounds, so that no list runs out. Only entities that were hashed again, or whose gender a title alone doesn't tell, are joined to the texts;
all others are rewritten where they stand.

Defined results: a null text stays null with 0 entities; an empty text stays empty; repeated rows are rewritten alike; all columns
are kept, but one that is named like the count of entities is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import let, load, settle, small, without

#: Titles by gender, and name parts by gender and script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "x": ["Dr", "Prof"]}
HAN_TITLES = {"m": ["先生"], "f": ["女士", "小姐"]}
CYRILLIC_TITLES = {"m": ["г-н", "господин"], "f": ["г-жа", "госпожа"]}
GIVEN = {
    "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Paul"],
    "f": ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helga", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    "x": ["Alex", "Billie", "Charlie", "Dominique", "Eden", "Francis", "Gale", "Hayden", "Jamie", "Kim", "Lee", "Morgan", "Noel", "Robin", "Sasha", "Toni"],
}
HAN_FAMILY = ["王", "李", "张", "刘", "陈", "杨", "赵", "黄", "周", "吴", "徐", "孙", "胡", "朱", "高", "林"]
HAN_GIVEN = {"m": ["伟", "强", "磊", "军", "勇", "杰", "涛", "明", "超", "刚", "平", "辉", "鹏", "华", "飞", "鑫"], "f": ["芳", "娜", "敏", "静", "丽", "艳", "娟", "霞", "秀", "燕", "玲", "丹", "萍", "红", "玉", "兰"]}
CYRILLIC_GIVEN = {"m": ["Иван", "Пётр", "Олег", "Игорь", "Павел", "Антон", "Денис", "Егор"], "f": ["Анна", "Ольга", "Мария", "Елена", "Ирина", "Дарья", "Вера", "Нина"]}
SYLLABLES = ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"]
CYRILLIC_SYLLABLES = ["ба", "ве", "ги", "до", "за", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "фе", "хи", "шо"]

#: Endings of longer given names by gender, and the range of Han characters for names beyond the lists.
ENDINGS = {"m": ("n", "н"), "f": ("na", "на"), "x": ("s", "и")}
HAN_FIRST, HAN_COUNT = 0x4E00, 20000

_titles = "|".join(t for ts in TITLES.values() for t in ts)
_cyrillic = "|".join(t for ts in CYRILLIC_TITLES.values() for t in ts)
_han = "|".join(t for ts in HAN_TITLES.values() for t in ts)
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_cues = "(?i:token|password|passwd|secret|api_?key) ?[=:]"
_cued = rf"\b{_cues} ?[\"']?[A-Za-z0-9_+/=-]{{8,}}+"
_hex = r"\b(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,}+\b"
#: Java patterns of the kinds; the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": rf"{_cued}|{_hex}",
    "name": rf"\b(?:{_titles})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+){{0,2}}|(?:{_cyrillic}) \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+){{0,2}}|[{''.join(HAN_FAMILY)}]\p{{IsHan}}{{1,2}}(?={_han})",
    "ip": rf"(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?!\d|\.\d)",
    "account": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b",
    "card": r"(?<![\d-])\d{4}(?:-\d{4}-\d{4}-|(?: \d{4}){2} |\d{8})\d{4}(?![\d-])",
    "identity": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}+(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
}
_numeric = "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "card", "identity", "phone"))
#: All kinds but e-mail addresses; a look at the first character saves most places the rest.
PLAIN = rf"(?=[tpsaTPSA]){_cued}|(?=[0-9a-fA-F]){_hex}|(?=[A-Z{''.join(HAN_FAMILY)}гж])(?:(?:{PATTERNS['name']})|(?:{PATTERNS['account']}))|(?=[0-9+(])(?:{_numeric})"
ANY = rf"(?:{PATTERNS['email']})|{PLAIN}"
#: What a text must hold somewhere to have any of them.
HINT = rf"[0-9@]|(?=[tpsaTPSA]){_cues}|(?=[A-Zгж])(?:{_titles}|{_cyrillic})\b|{_han}"
CUE = rf"^{_cues} ?[\"']?"
#: Secrets whose case doesn't matter: hex of one case, and hex so long that it is no password.
HEX = "^(?:[0-9a-f]+|[0-9A-F]+|[0-9a-fA-F]{32,})$"
HAN_NAME = r"^\p{IsHan}{2,3}$"
TITLE = rf"^(?:(?:{_titles})\.?|{_cyrillic}) "
BARE_NAME = r"^\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*$"
#: Names with what tells their gender; Han titles follow the name.
NAMED = rf"(?=[A-Z{''.join(HAN_FAMILY)}гж])(?:{PATTERNS['name']})(?:{_han})?"


def kind_of(mention: Column) -> Column:
    found = F.when(mention.contains("@") & ~mention.rlike(CUE), "email").when(mention.rlike(CUE) | mention.rlike("^[0-9a-fA-F]{32,}$"), "secret")
    found = found.when(mention.rlike(TITLE) | mention.rlike(HAN_NAME) | mention.rlike(BARE_NAME), "name").when(mention.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip").when(mention.rlike(r"^[A-Z]{2}\d{2}"), "account")
    return found.when(mention.rlike(rf"^(?:{PATTERNS['card']})$"), "card").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "identity").otherwise("phone")


def normal(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity share; a telephone number has no country code 1."""
    bare = F.upper(F.regexp_replace(mention, r"[^A-Za-z0-9]", ""))
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "secret", let(F.regexp_replace(mention, CUE, ""), lambda value: F.when(value.rlike(HEX), F.lower(value)).otherwise(value)))
        .when(kind == "ip", mention)
        .when((kind == "phone") & mention.startswith("+1") & (F.length(bare) == 11), F.substr(bare, F.lit(2)))
        .otherwise(bare)
    )


def gender(mention: Column) -> Column:
    one = lambda g: rf"^(?:{'|'.join(TITLES.get(g, []) + CYRILLIC_TITLES.get(g, []))})\.? |(?:{'|'.join(HAN_TITLES.get(g, []))})$"
    return F.when(mention.rlike(one("m")), "m").when(mention.rlike(one("f")), "f").otherwise("x")


def parts_of(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, TITLE, ""), " ")


def entities(mention: Column) -> Column:
    """A mention's entities (kind, norm, form): the parts of a name in order, or the mention itself. form: the gender that the mention gives a given name."""
    one = lambda kind, norm, form: F.struct(kind.alias("kind"), norm.alias("norm"), form.alias("form"))
    last = lambda parts, i: i == F.size(parts) - 1
    part = lambda parts: F.transform(parts, lambda p, i: one(F.when(last(parts, i), "family").otherwise("given"), F.lower(p), F.when(last(parts, i), "").otherwise(gender(mention))))
    han = F.regexp_replace(mention, f"(?:{_han})$", "")
    return let(
        kind_of(han),
        lambda kind: F.when((kind == "name") & han.rlike(HAN_NAME), F.array(one(F.lit("han"), han, gender(mention))))
        .when(kind == "name", let(parts_of(mention), part))
        .otherwise(F.array(one(kind, normal(kind, mention), F.lit("")))),
    )


def digest(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits."""
    whole = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(whole, 256), F.sha2(F.concat(F.lit("\x1e"), whole), 256))


def nibble(d: Column, k: Column) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substr(d, F.pmod(k, F.lit(128)) + 1, F.lit(1))) - 1


def pick(values: list[str], d: Column, k: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(nibble(d, F.lit(k)) + 16 * nibble(d, F.lit(k + 1)), F.lit(len(values))))


def disguised(text: Column, d: Column, hexadecimal: Column | None = None) -> Column:
    """Characters of the same class, by the digest."""
    letters, digits = F.lit("acegikmoqsuwybdf"), F.lit("0123456789573146")

    def one(c: Column, i: Column) -> Column:
        x = nibble(d, i) + 1
        plain = F.when(c.rlike("[0-9]"), F.substr(digits, x, F.lit(1))).when(c.rlike("[a-z]"), F.substr(letters, x, F.lit(1))).when(c.rlike("[A-Z]"), F.upper(F.substr(letters, x, F.lit(1)))).otherwise(c)
        return plain if hexadecimal is None else F.when(hexadecimal, F.substr(F.lit("0123456789abcdef"), x, F.lit(1))).otherwise(plain)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the last but one doubled."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: let(F.coalesce(c.try_cast("int"), F.lit(0)) * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def card_number(norm: Column, d: Column) -> Column:
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(disguised(norm, d), F.lit(2), F.length(norm) - 2))
    checked = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    return F.when(luhn(norm) % 10 == 0, checked).otherwise(F.concat(body, F.substr(disguised(norm, d), F.length(norm), F.lit(1))))


def given_name(norm: Column, d: Column, salt: Column, form: Column) -> Column:
    """From the lists, then of syllables, one more for each round, with an ending of the gender."""
    of = lambda table: F.when(form == "m", pick(table["m"], d, 0)).when(form == "f", pick(table["f"], d, 0)).otherwise(pick(table.get("x", table["m"] + table["f"]), d, 0))
    ending = lambda script: F.when(form == "m", ENDINGS["m"][script]).when(form == "f", ENDINGS["f"][script]).otherwise(ENDINGS["x"][script])
    long = lambda table, script: F.initcap(F.concat(syllables(table, d, salt), ending(script)))
    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    return F.when(salt == 0, F.when(cyrillic, of(CYRILLIC_GIVEN)).otherwise(of(GIVEN))).otherwise(F.when(cyrillic, long(CYRILLIC_SYLLABLES, 1)).otherwise(long(SYLLABLES, 0)))


def family_name(norm: Column, d: Column, salt: Column) -> Column:
    return F.initcap(F.when(norm.rlike(r"\p{IsCyrillic}"), syllables(CYRILLIC_SYLLABLES, d, salt)).otherwise(syllables(SYLLABLES, d, salt)))


def syllables(table: list[str], d: Column, salt: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), 2 + salt), lambda k: F.get(F.array(*map(F.lit, table)), nibble(d, 8 + k))), "")


def han_name(norm: Column, d: Column, salt: Column, form: Column) -> Column:
    """As many characters as the name has: a family name and given ones from the lists, from the third round on given ones of a wide range, then all of it."""
    listed = lambda k: F.when(form == "f", pick(HAN_GIVEN["f"], d, k)).otherwise(pick(HAN_GIVEN["m"], d, k))
    point = lambda k: HAN_FIRST + F.pmod(F.conv(F.substr(d, F.lit(k), F.lit(7)), 16, 10).cast("long"), F.lit(HAN_COUNT))
    wide = lambda k: F.decode(F.unhex(F.lpad(F.hex(point(k)), 4, "0")), "UTF-16BE")
    given = lambda k: F.when(salt < 2, listed(k)).otherwise(wide(20 + 8 * k))
    first = F.when(salt < 6, pick(HAN_FAMILY, d, 0)).otherwise(wide(20))
    return F.concat(first, given(2), F.when(F.length(norm) > 2, given(4)).otherwise(""))


def surrogate(key: str, kind: Column, norm: Column, salt: Column, form: Column) -> Column:
    """The normal form's surrogate. form: gender of a given name."""

    def made(d: Column) -> Column:
        octet = lambda k: (1 + (nibble(d, F.lit(2 * k)) * 16 + nibble(d, F.lit(2 * k + 1))) % 254).cast("string")
        domain = F.substring_index(norm, "@", -1)
        host = disguised(F.lit("abcdefgh"), digest(key, F.lit("domain"), domain))
        address = F.concat(disguised(F.substring_index(norm, "@", 1), d), F.lit("@"), host, F.lit(".example."), F.substring_index(domain, ".", -1))
        return (
            F.when(kind == "email", address)
            .when(kind == "secret", disguised(norm, d, norm.rlike("^[0-9a-f]+$")))
            .when(kind == "family", family_name(norm, d, salt))
            .when(kind == "given", given_name(norm, d, salt, form))
            .when(kind == "han", han_name(norm, d, salt, form))
            .when(kind == "ip", F.concat_ws(".", *(octet(k) for k in range(4))))
            .when(kind == "card", card_number(norm, d))
            .when(kind == "account", F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.substr(disguised(norm, d), F.lit(3), F.length(norm))))
            .when(kind == "phone", F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(disguised(norm, d), F.lit(2), F.length(norm))))
            .otherwise(disguised(norm, d))
        )

    return let(digest(key, kind, norm, salt.cast("string")), made)


def rendered(kind: Column, mention: Column, made: Column) -> Column:
    """A surrogate in the format of one mention; digits that the mention has before those of the surrogate (a country code) stay."""
    count = lambda text: F.length(F.regexp_replace(text, r"[^A-Za-z0-9]", ""))
    lead = count(mention) - F.length(made)
    filled = F.array_join(
        F.transform(
            F.split(mention, ""),
            lambda c, i: F.when(
                c.rlike("[A-Za-z0-9]"),
                let(count(F.substr(mention, F.lit(1), i + 1)) - lead, lambda k: F.when(k < 1, c).otherwise(let(F.substr(made, k, F.lit(1)), lambda x: F.when(c.rlike("[a-z]"), F.lower(x)).otherwise(x)))),
            ).otherwise(c),
        ),
        "",
    )
    upper = F.when(mention.rlike("^[^a-z]+$"), F.upper(made)).otherwise(made)
    secret = F.when(F.regexp_replace(mention, CUE, "").rlike("^[0-9]*[A-F][0-9A-F]*$"), F.upper(made)).otherwise(made)
    return F.when(kind == "email", upper).when(kind == "secret", F.concat(F.regexp_extract(mention, f"({CUE})", 1), secret)).when(kind.isin("ip", "han"), made).otherwise(filled)


def untitled(text: Column) -> Column:
    """A pattern of the names that a text has with a title: whole ones, then family names; null if there is none."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(NAMED), F.lit(0)), lambda m: F.regexp_replace(F.regexp_replace(m, TITLE, ""), f"(?:{_han})$", ""))

    def pattern(names: Column) -> Column:
        plain = F.filter(names, lambda x: ~x.rlike(HAN_NAME))
        every = F.array_distinct(F.concat(plain, F.transform(plain, lambda x: F.element_at(F.split(x, " "), -1))))
        ordered = F.transform(F.sort_array(F.transform(every, lambda x: F.struct(-F.length(x), x.alias("x")))), lambda x: x["x"])
        han = F.array_distinct(F.filter(names, lambda x: x.rlike(HAN_NAME)))
        either = F.filter(F.array(F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(ordered, "|"), F.lit(r")(?!\p{L})")), F.array_join(han, "|")), lambda x: (x != r"(?<!\p{L})(?:)(?!\p{L})") & (x != ""))
        return F.when(F.size(names) > 0, F.array_join(either, "|"))

    return F.when(text.rlike(TITLED_HINT), let(bare, pattern))


#: What a text with a titled name must hold.
TITLED_HINT = rf"(?=[A-Zгж])(?:{_titles}|{_cyrillic})\b|{_han}"


def scanned(text: Column) -> tuple[Column, Column]:
    """All mentions in order, and what stands between; texts without a hint, or without the sign of an address, are spared what they can't match."""
    none = F.when(text.isNull(), F.lit(None)).otherwise(F.array().cast("array<string>"))

    def by(found, otherwise):
        more = lambda pattern: F.concat(F.lit(f"{pattern}|"), F.col("pii__names"))
        address = text.contains("@")
        return (
            F.when(F.col("pii__names").isNotNull() & address, found(more(ANY))).when(F.col("pii__names").isNotNull(), found(more(PLAIN)))
            .when(address, found(F.lit(ANY))).when(text.rlike(HINT), found(F.lit(PLAIN))).otherwise(otherwise)
        )

    return by(lambda p: F.regexp_extract_all(text, p, F.lit(0)), none), by(lambda p: F.split(text, p, -1), F.array(text))


def with_mentions(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with pii__found, the mentions. A Han name is followed by its title there, as nothing else tells its gender."""
    rows = docs.withColumn("pii__names", untitled(F.col(text_col)))
    return rows.withColumn("pii__found", scanned(F.col(text_col))[0])


def told(text: Column, mention: Column) -> Column:
    """The mention, with the title that follows a Han name in the text."""
    title = lambda t: F.when(F.contains(text, F.concat(mention, F.lit(t))), F.concat(mention, F.lit(t)))
    return F.when(mention.rlike(HAN_NAME), F.coalesce(*(title(t) for ts in HAN_TITLES.values() for t in ts), mention)).otherwise(mention)


def listed(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """The entities (kind, norm, form) of each text, with what else to keep of the row."""
    every = F.flatten(F.transform("pii__found", lambda m: entities(told(F.col(text_col), m))))
    return with_mentions(docs.select(text_col), text_col).select(*keep, F.explode(F.array_distinct(every)).alias("e")).select(*(c for c in ("pii__text",) if keep), "e.*").distinct()


def hashed_again(docs: DataFrame, text_col: str, key: str, most: int = 60) -> DataFrame:
    """(kind, norm, salt, form) of the entities whose first surrogate collides, or whose gender a mention alone doesn't tell."""
    has = lambda g: F.bool_or(F.col("form") == g)
    found = listed(docs, text_col).groupBy("kind", "norm").agg(has("m").alias("m"), has("f").alias("f"), (F.min("form") != F.max("form")).alias("unsure"))
    form = F.when(~F.col("kind").isin("given", "han"), "").when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("x")
    found = settle(found.select("kind", "norm", form.alias("form"), "unsure"))
    now = found.withColumn("salt", F.lit(0))
    taken = found.select("kind", F.col("norm").alias("made_form"), F.lit(True).alias("taken"))
    for _ in range(most):
        now = settle(now.withColumn("made", surrogate(key, F.col("kind"), F.col("norm"), F.col("salt"), F.col("form"))))
        formed = now.withColumn("made_form", F.when(F.col("kind").isin("given", "family"), F.lower("made")).otherwise(F.col("made")))
        shared = formed.groupBy("kind", "made_form").agg(F.min("norm").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        judged = formed.join(shared, ["kind", "made_form"], "left").join(taken, ["kind", "made_form"], "left")
        bad = F.coalesce(F.col("taken"), F.lit(False)) | F.coalesce(F.col("keeper") != F.col("norm"), F.lit(False))
        now = settle(judged.select("kind", "norm", "form", "unsure", (F.col("salt") + bad.cast("int")).alias("salt"), bad.alias("bad")))
        if now.where("bad").isEmpty():
            return now.where("salt > 0 or unsure").select("kind", "norm", "salt", "form")
        now = now.drop("bad")
    raise RuntimeError("surrogates collide after all rounds: more entities than their format has forms")


def replace(docs: DataFrame, key: str, text_col="text", count="pii_entities") -> DataFrame:
    """docs with the text rewritten and the column `count`, the number of mentions. key: a secret; who has it can make the same surrogates."""
    text = F.col(text_col)
    each = lambda mention: entities(told(text, mention))
    again = settle(hashed_again(docs, text_col, key))
    salts = F.create_map().cast("map<string,struct<salt:int,form:string>>")
    rows = with_mentions(docs, text_col)
    if not again.isEmpty():
        found = listed(docs, text_col, F.md5(text.cast("binary")).alias("pii__text")).drop("form").distinct().join(small(again), ["kind", "norm"])
        found = found.groupBy("pii__text").agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit(":"), "norm"), F.struct("salt", "form")))).alias("pii__salts"))
        rows = rows.join(small(settle(found)), F.md5(text.cast("binary")) == F.col("pii__text"), "left")
        salts = F.coalesce(F.col("pii__salts"), salts)

    def new(mention: Column) -> Column:
        def one(e: Column) -> Column:
            by = F.element_at(salts, F.concat(e["kind"], F.lit(":"), e["norm"]))
            made = surrogate(key, e["kind"], e["norm"], F.coalesce(by["salt"], F.lit(0)), F.coalesce(by["form"], e["form"]))
            return let(made, lambda x: F.when(e["kind"].isin("given", "family"), x).otherwise(rendered(e["kind"], mention, x)))

        title = F.when(mention.rlike(TITLE), F.regexp_extract(mention, f"({TITLE})", 1)).otherwise("")
        return let(each(mention), lambda es: F.concat(title, F.array_join(F.transform(es, one), " ")))

    parts = scanned(text)[1]
    written = F.array_join(F.zip_with(parts, F.col("pii__found"), lambda a, m: F.concat(a, F.when(m.isNull(), F.lit("")).otherwise(new(m)))), "")
    rows = rows.withColumn("pii__new", F.when(F.size("pii__found") > 0, written).otherwise(text)).withColumn("pii__count", F.greatest(F.size(F.col("pii__found")), F.lit(0)).cast("long"))
    return rows.select(*(F.col("pii__new").alias(c) if c == text_col else F.col(c) for c in without(docs.columns, [count])), F.col("pii__count").alias(count))


def key_of(spark: SparkSession) -> str:
    """The key of the registered query and the pipeline: the setting spark.quire.pii.key, or a published one that hides nothing, for tables made for tests."""
    return spark.conf.get("spark.quire.pii.key", "published key for made-up tables")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(load(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
