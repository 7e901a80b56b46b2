"""Personal data replaced by keyed surrogates of the same kind, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import unused, written

# Common given names by gender.
FEMALE = """Mary Anna Laura Julia Emma Sofia Maria Elena Clara Alice Sarah Linda Karen Susan Nancy Marie Claire Camille Lucia Carmen Patricia Jennifer Elizabeth Barbara Jessica Lisa Ashley Emily Michelle Amanda Olivia Isabella Charlotte Helen Ruth Sandra Monika Ursula Sabine Petra Katharina Isabelle Chantal Pilar Dolores Priya Aisha Fatima Mei Yuki Ingrid Anita Irina Olga Natalia
Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Юлия""".split()
MALE = """John Peter Paul James Robert Michael David Thomas Daniel Carlos Pedro Juan Hans Klaus Stefan Pierre Jean Louis Andrew Mark William Richard Joseph Charles Christopher Matthew Anthony Steven George Kevin Brian Edward Ronald Henry Wolfgang Jürgen Dieter Jacques François Philippe Javier Miguel Fernando Rajesh Amit Mohammed Ahmed Ali Omar Wei Hiroshi Ivan Dmitri Sergei
Иван Пётр Сергей Алексей Дмитрий Михаил Николай Андрей Павел Виктор""".split()
# Names that are words too, which alone are no person.
WORDS = "Mark Pilar Dolores Mei Wei".split()
# Titles, and phrases before a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Sra Sr".split()
BEFORE = "name is |Name: |name: |contact |Contact |Contact: |signed by |Signed by |written by |Written by |Author: |author: |Dear |Regards, |regards, |Sincerely, |patient |Patient: |employee "
# Syllables of made-up names, and their endings by gender.
LATIN, CYRILLIC = "bar den fel gor hal kin lor mar nor pel ros sal tor ven wil zan".split(), "бар дол жем зор кал лев мир нор пал рос сол тур фед хол чер шат".split()
ENDINGS = {("f", "latin"): ("a", "ia"), ("m", "latin"): ("o", "us"), ("u", "latin"): ("e", "i"), ("f", "cyrillic"): ("а", "ия"), ("m", "cyrillic"): ("ан", "ий"), ("u", "cyrillic"): ("и", "е")}
#: Rounds of draws in the usual space; every one after them draws from one longer by a character, digit, syllable or octet.
ROUNDS = 3
#: Entities that one task draws for.
DRAWS = 1000

_NAMES = "|".join([*FEMALE, *MALE, *(n.upper() for n in [*FEMALE, *MALE])])
_ALONE = "|".join(n for x in [*FEMALE, *MALE] if x not in WORDS for n in (x, x.upper()))
#: A capitalised word, with hyphens and apostrophes inside.
_CAPITAL = r"\p{Lu}(?:\p{L}|['’](?=\p{Lu}))\p{L}*+(?:['’-](?!s\b)\p{L}+)*+"
_TITLE = "(?:" + "|".join(TITLES) + r")\b\.?"
_EDGE = r"(?![\p{L}\p{N}_])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds of entity in the order in which they are tried. Each looks at its first character before it looks back, and takes runs at once: so time stays in proportion to the text.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?=A)\bAKIA[0-9A-Z]{16}\b|(?=g)\bgh[pousr]_[A-Za-z0-9]{20,}|(?=s)\bsk-[A-Za-z0-9]{20,}|(?<==)(?<=password=)\S+|(?=[0-9a-f]{8})(?<![0-9a-fA-F])[0-9a-f]{40}(?![0-9a-fA-F])",
    "ipv6": rf"(?=[0-9A-Fa-f:]{{3}})(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::{_HEX}(?::{_HEX}){{0,6}}|(?:{_HEX}:){{1,7}}:)(?![0-9A-Za-z:])",
    "iban": r"(?=[A-Z]{2}\d{2})(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?(?=[A-Z0-9]*\d)[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?=\d)(?<![\d.])(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+(\d])(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d))",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "person": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}_])(?:{_TITLE}[ ]{_CAPITAL}(?:[ ]{_CAPITAL})?{_EDGE}|(?:{_NAMES})[ ](?:\p{{Lu}}\.[ ])?{_CAPITAL}{_EDGE}|(?:{_ALONE}){_EDGE}|(?<={BEFORE}){_CAPITAL}[ ]{_CAPITAL}{_EDGE})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _bytes(key: str, *parts: Column) -> Column:
    """128 pseudo-random bytes as numbers, from SHA-256 of the key and the parts."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)
    digits = F.concat(*[F.sha2(F.concat(seed, F.lit(str(k))), 256) for k in range(4)])
    return F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _alike(text: Column, noise: Column) -> Column:
    """``text`` with letters and digits exchanged for others of their class (small letters for all beyond ASCII), all else as it is unless there is nothing else."""
    bare = ~text.rlike(r"[A-Za-z0-9]|[^\x00-\x7f]")

    def one(c: Column, i: Column) -> Column:
        v = F.element_at(noise, F.pmod(i, F.lit(128)) + 1)
        letter = lambda base: F.char((F.lit(base) + F.pmod(v, F.lit(26))).cast("long"))
        return F.when(c.rlike("^[0-9]$"), F.pmod(v, F.lit(10)).cast("string")).when(c.rlike("^[a-z]$"), letter(97)).when(c.rlike("^[A-Z]$"), letter(65)).when(bare | c.rlike(r"^[^\x00-\x7f]$"), letter(97)).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """The check digit for the digits before it."""
    total = F.aggregate(
        F.transform(_chars(digits), lambda d, i: (d.try_cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1))),
        F.lit(0),
        lambda a, x: a + x - F.when(x > 9, 9).otherwise(0),
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.transform(_chars(F.concat(account, country, F.lit("00"))), value), F.lit(0), lambda a, v: F.pmod(a * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _made(kind: Column, normal: Column, noise: Column, more: int = 0) -> Column:
    """A made-up name in the script of ``normal``: given names end as those of their gender do."""
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), F.pmod(F.element_at(noise, (k - 1) % 128 + 1), F.lit(len(xs))) + 1)
    made = lambda syllables, n: F.concat(*[pick(syllables, k) for k in range(1, n + 1 + more)])

    def whole(script: str, syllables: list[str], own: Column) -> Column:
        out = F.when(kind == "name_s", own)
        for g in ("f", "m", "u"):
            out = out.when(kind == f"name_{g}", F.concat(made(syllables, 2), pick(ENDINGS[g, script], 120)))
        return out

    cyrillic = F.concat(made(CYRILLIC, 3), F.when(normal.endswith("а"), F.lit("ова")).otherwise(F.lit("ов")))
    return F.when(normal.rlike(r"\p{IsCyrillic}"), whole("cyrillic", CYRILLIC, cyrillic)).otherwise(whole("latin", LATIN, made(LATIN, 3)))


def _candidate(kind: Column, normal: Column, noise: Column, more: int = 0) -> Column:
    """A surrogate in normal form, made of the bytes ``noise``, and ``more`` units longer than usual."""
    tail = [F.element_at(noise, 127 - k % 126) for k in range(more)]
    letters = F.concat(F.lit(""), *[F.char((F.lit(97) + F.pmod(v, F.lit(26))).cast("long")) for v in tail])
    figures = F.concat(F.lit(""), *[F.pmod(v, F.lit(10)).cast("string") for v in tail])
    digits = _alike(normal, noise)
    octet = lambda k: (F.pmod(F.element_at(noise, k), F.lit(254)) + 1).cast("string")
    local = F.concat(_alike(F.substring_index(normal, "@", 1), noise), letters)
    host = F.element_at(F.array(*map(F.lit, ["example.com", "example.net", "example.org"])), F.pmod(F.element_at(noise, 128), F.lit(3)) + 1)
    kept = F.when(F.length(normal) == 15, 2).otherwise(1)  # the digits that tell the issuer
    card = F.concat(F.substring(normal, F.lit(1), kept), F.substring(digits, kept + 1, F.length(normal) - kept - 1))
    hexadecimal = F.array_join(F.transform(noise, lambda v: F.lower(F.hex(F.pmod(v, F.lit(16))))), "")
    account, country = F.substring(digits, F.lit(5), F.length(normal)), F.substring(normal, 1, 2)
    ipv6 = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(hexadecimal, 4 * k + 1, 4)) for k in range(6)])  # a range for documentation
    return (
        F.when(kind == "email", F.concat(local, F.lit("@"), host))
        .when(kind == "card", F.concat(card, _luhn(card), figures))
        .when(kind == "iban", F.concat(country, _iban_check(country, F.concat(account, figures)), account, figures))
        .when(kind == "ipv6", ipv6)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, 2, 8), figures))  # numbers from 900 on are never issued
        .when(kind == "ip", F.concat_ws(".", *[octet(k % 128 + 1) for k in range(4 + more)]))
        .when(kind.startswith("name_"), _made(kind, normal, noise, more))
        .when((kind == "secret") & normal.rlike("^[0-9a-f]{33,64}$"), F.substring(hexadecimal, F.lit(1), F.length(normal)))
        .otherwise(F.concat(digits, F.when(kind == "secret", letters).otherwise(figures)))
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, surrogate) of distinct ``entities`` (kind, normal): no two of a family share one and none is a real entity of it.

    A kind's family is what stands before its first ``_``: given names of all
    genders and surnames are one. Each round draws keyed candidates; of entities
    that drew alike the smallest keeps the draw, unless it was taken before or
    occurs in the data; the others draw again. The draw depends on key, kind,
    entity and round only. After ROUNDS rounds the draws grow longer from one to
    the next, so the space holds any number of entities and the rounds end.
    Every task draws for about DRAWS entities. An empty table gives an empty one.
    """
    family = F.substring_index("kind", "_", 1)
    entities = written(entities)
    pending, done, attempt = entities, None, 0
    left = pending.count()
    while left:
        # The bytes are written first: inlined, they would be drawn anew for every character.
        dealt = pending.repartition(max(1, -(-left // DRAWS)), "normal")
        drawn = written(dealt.withColumn("_noise", _bytes(key, F.col("kind"), F.col("normal"), F.lit(str(attempt)))))
        drawn = drawn.repartition(max(1, -(-left // DRAWS)), "normal")
        drawn = written(drawn.withColumn("surrogate", _candidate(F.col("kind"), F.col("normal"), F.col("_noise"), max(0, attempt + 1 - ROUNDS))).drop("_noise"))
        real = entities.select(family.alias("family"), F.lower("normal").alias("taken")).distinct()
        if done is not None:
            real = real.unionByName(done.select(family.alias("family"), F.lower("surrogate").alias("taken")))
        held = drawn.withColumn("family", family).withColumn("taken", F.lower("surrogate"))
        first = held.groupBy("family", "taken").agg(F.min(F.struct("kind", "normal")).alias("f")).join(real, ["family", "taken"], "left_anti").select("f.*")
        won = written(held.join(first, ["kind", "normal"], "left_semi").select("kind", "normal", "surrogate"))
        done = won if done is None else written(done.unionByName(won))
        pending = written(pending.join(won, ["kind", "normal"], "left_anti"))
        left, attempt = pending.count(), attempt + 1
    return written(entities.withColumn("surrogate", F.lit(""))) if done is None else done


def _filled(raw: Column, surrogate: Column, kind: str) -> Column:
    """``raw`` with its characters of a class exchanged for those of ``surrogate``, in turn; the rest of it at the end."""
    place = lambda i: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), f"[^{kind}]", ""))
    body = F.array_join(F.transform(_chars(raw), lambda c, i: F.when(c.rlike(f"^[{kind}]$"), F.substring(surrogate, place(i + 1), F.lit(1))).otherwise(c)), "")
    return F.concat(body, F.substring(surrogate, place(F.length(raw)) + 1, F.length(surrogate)))


def _rendered(raw: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of ``raw``, which stays as it is where there is none."""
    upper = (raw == F.upper(raw)) & (F.length(raw) > 1)
    return (
        F.when(surrogate.isNull(), raw)
        .when(kind.isin("card", "ssn", "phone"), _filled(raw, surrogate, "0-9"))
        .when(kind == "iban", _filled(raw, surrogate, "0-9A-Z"))
        .when(kind.startswith("name_"), F.when(upper, F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .when(kind.isin("email", "ipv6") & (raw == F.upper(raw)), F.upper(surrogate))
        .otherwise(surrogate)
    )


def _parts(raw: Column) -> Column:
    """What a found string consists of: kind (null for what stays), normal form and the piece itself, in order.

    Persons fall into words, each with a surrogate of its own; the last of
    several is a surname. Digits are a card only if their check digit is right.
    """
    kind = None
    for k, p in PATTERNS.items():  # secrets are recognised by what stands before them, so what fits nothing else is one
        fits = raw.rlike(rf"^(?:{p}|{_CAPITAL}(?: {_CAPITAL})+)$" if k == "person" else f"^(?:{p})$")
        kind = F.when(fits, k) if kind is None else kind.when(fits, k)
    kind = kind.otherwise("secret")
    words = F.split(raw, " ")
    low = lambda names: [n.lower() for n in names]

    def word(w: Column, i: Column) -> Column:
        given = F.when(F.lower(w).isin(low(FEMALE)), "name_f").when(F.lower(w).isin(low(MALE)), "name_m").otherwise("name_u")
        last = (i == F.size(words) - 1) & (i > 0)
        who = F.when(w.rlike(rf"^(?:{_TITLE}|\p{{Lu}}\.)$") & ~last, F.lit(None).cast("string")).when(last, "name_s").otherwise(given)
        return F.struct(who.alias("who"), F.lower(w).alias("normal"), w.alias("piece"))

    plain = F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(raw, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(raw, " ", "")).when(kind.isin("email", "ipv6"), F.lower(raw)).otherwise(raw)
    false_card = (kind == "card") & (_luhn(F.substring(plain, F.lit(1), F.length(plain) - 1)) != F.substring(plain, -1, 1))
    one = F.struct(F.when(~false_card, kind).alias("who"), plain.alias("normal"), raw.alias("piece"))
    return F.when(kind == "person", F.transform(words, word)).otherwise(F.array(one))


def pseudonymised(docs: DataFrame, key: str = "tidewire") -> DataFrame:
    """All columns of ``docs`` (text, any further columns), with surrogates in text, and n_entities, how many were put in.

    Found are e-mail addresses, secrets, cards (with a right check digit), bank
    accounts (IBAN), social security and phone numbers, IP addresses of both
    versions, and persons: given names of a list with a surname, or alone unless
    they are words too; names after a title; two capitalised words after a
    phrase that announces a name. Other names are not found. The same entity
    gets the same surrogate wherever and however formatted it occurs (numbers by
    their digits, addresses by lower case, given name and surname each on their
    own); different ones get different surrogates, none of which is an entity of
    its kind in the data. Numbers keep their punctuation, cards and accounts
    stay valid, made-up given names keep gender and script, surnames script.
    Null texts stay null with n_entities 0; an empty table stays empty; repeated
    rows are replaced alike; a column named n_entities is replaced, columns of
    any other name pass through.

    Texts are searched once and kept with what was found in them. Only distinct
    entities are drawn for. Texts that hold any are joined with their
    replacements by digest, so copies share the work; all others are passed on
    as they are, without a shuffle.
    """
    docs = docs.drop("n_entities")
    m, d, at, pieces = unused(docs.columns, "_m", "_d", "_map", "_p")
    hits = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    marked = written(docs.withColumn(m, F.coalesce(hits, F.array().cast("array<string>"))))  # each text is searched once
    some = marked.where(f"size({m}) > 0").withColumn(d, F.sha2("text", 256))
    held = written(some.select(F.col(d).alias("d"), F.explode(F.array_distinct(m)).alias("raw")).distinct())
    found = held.select("raw").distinct().select("raw", F.posexplode(_parts(F.col("raw"))).alias("i", "part")).select("raw", "i", "part.*")
    found = written(found)
    table = surrogate_table(found.where("who is not null").select(F.col("who").alias("kind"), "normal").distinct(), key)
    named = found.join(table.withColumnRenamed("kind", "who"), ["who", "normal"], "left")
    named = named.select("raw", F.struct("i", _rendered(F.col("piece"), F.col("who"), F.col("surrogate")).alias("new")).alias("x"))
    named = written(named.groupBy("raw").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["new"]), " ").alias("new")))
    by_text = written(held.join(named, "raw").groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("names")))
    changed = some.join(by_text.select(F.col("d").alias(d), F.col("names").alias(at)), d).withColumn(pieces, F.split("text", ENTITY, -1))
    joined = F.array_join(F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.concat(F.element_at(at, F.get(F.col(m), i)), F.get(F.col(pieces), i + 1))), "")
    count = F.size(F.filter(m, lambda x: F.element_at(at, x) != x)).cast("long").alias("n_entities")
    own = [F.col(f"`{c}`") for c in docs.columns]
    changed = changed.withColumn("text", F.concat(F.get(F.col(pieces), F.lit(0)), joined))
    return marked.where(f"size({m}) = 0").select(*own, F.lit(0).cast("long").alias("n_entities")).unionByName(changed.select(*own, count))
