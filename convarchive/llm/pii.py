"""PII surrogates: what identifies someone is replaced by a keyed stand-in of the same kind.

Found are e-mail addresses, credentials (after ``password=``, ``token:`` and the like, and access key ids),
IPv4 addresses, payment card, IBAN, social security and phone numbers, and names after a title. A stand-in
depends on the key, the kind and the normal form of what it replaces, so one entity gets one stand-in in
all documents and all its spellings (coreference): e-mail addresses without case, numbers without their
punctuation, names by word. Each mention keeps its format: separators, brackets, capitals, a number's
length and country code, a card's first digit and its check-digit validity, the hexadecimal or base-32
letters of a credential, the title's gender and the script of a name.

Distinctness: all distinct entities are one Spark table; stand-ins that two entities share, or that equal
an entity of the corpus, are drawn again for all but the first, until none collide. Pools are open-ended: names
gain syllables with the rounds, and where a format of mail names, credentials, phone or social security numbers
is used up, stand-ins get longer than what they replace. Letters of other scripts in credentials become keyed
letters of their case; other characters there change only if there is no letter or digit, or after some rounds.

Only mentions are shuffled for the look-up, then texts meet their replacements by row. A mention's kind follows
from its form and what stands before it, other mentions included; one of no other kind counts as a credential, so
nothing that was found comes out as it was. Null and empty texts stay; everything between mentions stays byte for
byte; repeated rows get the same text. Rows are told apart by a number that is written down with them once.
Further columns are left alone; one called like the output is kept under its name and ``_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.llm.common import kept, let, numbered, put_back, require, set_aside, stored, table

#: Titles before names: (gender, script, pattern).
TITLES = [
    ("m", "latin", r"Mr\.?|Sir|Herrn?|Monsieur|Señor|Sr\.|Signor|Don"),
    ("f", "latin", r"Mrs\.?|Ms\.?|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra\.|Signora|Doña"),
    ("m", "cyrillic", r"[Гг]осподин|[Гг]-н"),
    ("f", "cyrillic", r"[Гг]оспожа|[Гг]-жа"),
]
NAME = r"\p{Lu}[\p{L}’'-]*(?: \p{Lu}[\p{L}’'-]+)*+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What stands before a credential.
ASSIGNED = r"(?i:password|passwd|secret|token|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?"
#: Kind -> pattern, in order of precedence. No pattern has a group. Cheap guards stand before long looks back.
KINDS = {
    "email": r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?<=[=:\s\"'])(?<=[=:]\s{{0,3}}[\"']?)(?<={ASSIGNED})[^\s\"',;=:]{{6,}}",
    "key": r"\b(?:AKIA|ASIA)[A-Z2-7]{16}\b|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4})(?!\d)",
    "name": r"(?=\p{Lu})(?:" + "|".join(rf"(?<=\b(?:{t}) ){NAME}" for _, _, t in TITLES) + ")",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these has no mention.
HINT = r"\d|@|[=:]|" + "|".join(t for _, _, t in TITLES)
#: Parts of made-up names: consonants, vowels and endings by gender, by script.
PARTS = {
    "latin": ("b d f g k l m n p r s t v z".split(), "a e i o u".split(), {"m": "ter mon rick las vin dor".split(), "f": "lina rella dia sine nora tilda".split(), "n": "berg man sell wood field mont".split()}),
    "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), {"m": "мир слав тин дор рий вел".split(), "f": "лина рия сия дора вета мила".split(), "n": "ко енко чук ян швили дзе".split()}),
}
ROUNDS = 40
OUTPUT, INNER = ("n_replaced",), ("__row", "__new")
#: From this round on stand-ins get longer, by one more character a round.
LONGER = 10


def mentions(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def mentions_with_before(text: Column) -> Column:
    """``array<struct<mention, before>>``; ``before`` is what stands just before the mention, other mentions included."""

    def placed(x: Column) -> Column:
        def said(k: str, i: Column) -> Column:
            return F.coalesce(F.get(x[k], i), F.lit(""))

        return F.transform(
            x["m"], lambda m, i: F.struct(m.alias("mention"), F.right(F.concat(said("m", i - 2), said("b", i - 1), said("m", i - 1), said("b", i)), F.lit(40)).alias("before"))
        )

    empty = F.array().cast("array<struct<mention:string,before:string>>")
    return let(mentions(text), lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("m"), F.split(text, ANY, -1).alias("b")), placed)).otherwise(empty))


def kind_of(text: Column, before: Column) -> Column:
    """The kind of a mention; ``before`` is the text just before it, by which names and credentials are known."""
    chain = F.lit("secret")
    credential = before.rlike(f"{ASSIGNED}$")
    for kind, pattern in reversed(KINDS.items()):
        if kind == "secret":
            chain = F.when(credential, kind).otherwise(chain)
        elif kind == "name":
            for gender, script, title in reversed(TITLES):
                chain = F.when(before.rlike(rf"\b(?:{title}) $") & text.rlike(r"^\p{L}"), f"name {gender} {script}").otherwise(chain)
        else:
            chain = F.when(text.rlike(rf"^(?:{pattern})$"), kind).otherwise(chain)
    return chain


def cores(kind: Column, text: Column) -> Column:
    """``array<struct<kind, core>>``: the entities of a mention in normal form; a name has one for each word."""
    bare = F.regexp_replace(text, r"[^A-Za-z0-9]", "")
    one = F.when(kind == "email", F.lower(text)).when(kind.isin("card", "ssn", "phone", "iban"), bare).otherwise(text)
    parts = F.split(text, " ")
    last = F.concat(F.lit("surname "), F.split(kind, " ")[2])
    names = F.transform(parts, lambda p, i: F.struct(F.when(i == F.size(parts) - 1, last).otherwise(kind).alias("kind"), F.lower(p).alias("core")))
    return F.when(F.startswith(kind, F.lit("name ")), names).otherwise(F.array(F.struct(kind.alias("kind"), one.alias("core"))))


def _pick(choices: list[str] | str, number: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), F.pmod(number, F.lit(len(choices))))


def stand_in(kind: Column, core: Column, attempt: Column, key: str) -> Column:
    """The stand-in of an entity in normal form."""
    seed = F.concat_ws("|", F.lit(key), kind, core, attempt.cast("string"))
    digest = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|more")), 256))

    def by_digest(d: Column) -> Column:
        def number(i: Column) -> Column:
            return F.conv(F.substring(d, F.pmod(i * 3, F.lit(124)) + 1, F.lit(3)), 16, 10).cast("int")

        chars = F.split(core, "")
        hexadecimal = (kind == "secret") & core.rlike(r"^[0-9a-f]{16,}$")
        base32 = kind == "key"
        free = (kind == "secret") & (~core.rlike(r"[\p{L}\p{N}]") | (attempt > 3))

        def shaped(c: Column, i: Column) -> Column:
            return (
                F.when(hexadecimal, _pick("0123456789abcdef", number(i)))
                .when(base32, _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", number(i)))
                .when(c.rlike("[0-9]"), _pick("0123456789", number(i)))
                .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", number(i)))
                .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", number(i)))
                .when((kind == "secret") & c.rlike(r"[а-я]"), _pick("абвгдежзийклмнопрстуфхцчшщъыьэюя", number(i)))
                .when((kind == "secret") & c.rlike(r"[А-Я]"), _pick("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", number(i)))
                .when((kind == "secret") & c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", number(i)))
                .when((kind == "secret") & c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", number(i)))
                .when((kind == "secret") & c.rlike(r"\p{N}"), _pick("0123456789", number(i)))
                .when(free, _pick("!#$%&*+-./?@^_~", number(i)))
                .otherwise(c)
            )

        more = F.sequence(F.lit(1), F.greatest(attempt - LONGER + 1, F.lit(1)))
        longer = F.when(attempt >= LONGER, F.array_join(F.transform(more, lambda i: _pick("0123456789", number(i + 60))), "")).otherwise("")
        shape = F.array_join(F.transform(chars, shaped), "")
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(number(i), F.lit(254)) + 1).cast("string")), ".")
        user = F.substring_index(shape, "@", 1)
        host = F.regexp_extract(shape, r"@([^.]+)", 1)
        email = F.concat(user, longer, F.lit("@"), host, F.lit(".example."), F.regexp_extract(core, r"\.([^.]+)$", 1))
        body = F.concat(F.substring(core, 1, 1), shape.substr(F.lit(2), F.length(core) - 2))
        card = F.concat(body, luhn_digit(body, luhn_valid(core)))
        phone = F.concat(F.substring(core, 1, 1), shape.substr(F.lit(2), F.length(core)), longer)
        iban = F.concat(F.substring(core, 1, 2), shape.substr(F.lit(3), F.length(core)))
        access = F.concat(F.substring(core, 1, 4), shape.substr(F.lit(5), F.length(core)))
        out = (
            F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "iban", iban).when(kind == "key", access)
        )
        for script, (hard, soft, ends) in PARTS.items():
            stem = F.array_join(F.transform(F.sequence(F.lit(0), 1 + F.floor(attempt / 3).cast("int")), lambda i: F.concat(_pick(hard, number(i * 2)), _pick(soft, number(i * 2 + 1)))), "")
            for gender, tails in ends.items():
                named = f"surname {script}" if gender == "n" else f"name {gender} {script}"
                out = out.when(kind == named, F.concat(stem, _pick(tails, number(F.lit(40)))))
        return out.otherwise(F.concat(shape, longer))

    return let(digest, by_digest)


def _luhn_sum(digits: Column, parity: Column) -> Column:
    def add(a: Column, x: Column) -> Column:
        doubled = x["d"] * 2
        return a + F.when(x["twice"], F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(x["d"])

    marked = F.transform(
        F.split(digits, ""), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("d"), (F.pmod(F.length(digits) - i, F.lit(2)) == parity).alias("twice"))
    )
    return F.aggregate(marked, F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, F.lit(0)) % 10 == 0


def luhn_digit(body: Column, valid: Column) -> Column:
    """The last digit that makes ``body`` pass the check, or the next one if it shall fail."""
    right = F.pmod(10 - _luhn_sum(body, F.lit(1)) % 10, F.lit(10))
    return F.when(valid, right).otherwise(F.pmod(right + 1, F.lit(10))).cast("string")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, core, surrogate)`` of distinct ``(kind, core)`` rows, without collisions within a kind."""
    waiting = kept(entities)
    own = waiting.select("kind", F.col("core").alias("surrogate"))
    done = None
    for attempt in range(ROUNDS):
        drawn = kept(waiting.withColumn("surrogate", stand_in(F.col("kind"), F.col("core"), F.lit(attempt), key)))
        free = drawn.join(own, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = kept(free.groupBy("kind", "surrogate").agg(F.min("core").alias("core")).select("kind", "core", "surrogate"))
        done = first if done is None else done.unionByName(first)
        waiting = kept(drawn.join(first, ["kind", "core"], "left_anti").select("kind", "core"))
        if waiting.isEmpty():
            return done
    raise ValueError("too few possible values for the entities of some format")


def _reformat(mention: Column, core: Column) -> Column:
    """``core`` in the mention's format: its letters and digits one by one in place of the mention's, further ones behind."""

    def put(a: Column, c: Column) -> Column:
        takes = c.rlike("[A-Za-z0-9]")
        return F.struct(
            F.concat(a["s"], F.when(takes, core.substr(a["k"], F.lit(1))).otherwise(c)).alias("s"), (a["k"] + takes.cast("int")).alias("k")
        )

    return F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), put, lambda a: F.concat(a["s"], core.substr(a["k"], F.length(core))))


def replace_pii(documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with stand-ins in ``text``, and ``n_replaced``."""
    rows = numbered(set_aside(require(documents, "text"), *OUTPUT, *INNER))
    said = rows.select(F.col("__row").alias("row"), F.posexplode(mentions_with_before(F.col("text"))).alias("k", "x"))
    said = stored(said.select("row", "k", "x.mention", kind_of(F.col("x.mention"), F.col("x.before")).alias("kind")))
    parts = said.select("row", "k", "mention", "kind", F.posexplode(cores(F.col("kind"), F.col("mention"))).alias("part", "e"))
    parts = parts.select("row", "k", "mention", "part", F.col("kind").alias("whole"), "e.kind", "e.core")
    known = kept(surrogates(parts.select("kind", "core").distinct(), key))
    met = parts.join(known, ["kind", "core"])
    met = met.groupBy("row", "k", "mention", "whole").agg(F.sort_array(F.collect_list(F.struct("part", "surrogate"))).alias("s"))
    name = F.array_join(F.transform("s", lambda x: x["surrogate"]), " ")
    one = F.col("s")[0]["surrogate"]
    mention, whole = F.col("mention"), F.col("whole")
    shown = (
        F.when(F.startswith(whole, F.lit("name ")) & (mention == F.upper(mention)) & (F.length(mention) > 1), F.upper(name))
        .when(F.startswith(whole, F.lit("name ")), F.initcap(name))
        .when(whole.isin("card", "ssn", "phone", "iban"), _reformat(mention, one))
        .otherwise(one)
    )
    by_row = met.select("row", "k", shown.alias("shown")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "shown"))).alias("__new"))
    out = rows.join(by_row.withColumnRenamed("row", "__row"), "__row", "left")
    # every mention has a replacement; behind the last one there is none
    rebuilt = F.array_join(F.transform(F.split("text", ANY, -1), lambda b, i: F.concat(b, F.coalesce(F.try_element_at("__new", i), F.lit("")))), "")
    text = F.when(F.col("__new").isNull(), F.col("text")).otherwise(rebuilt)
    out = out.withColumns({"text": text, "n_replaced": F.coalesce(F.size("__new"), F.lit(0)).cast("long")}).drop(*INNER)
    return put_back(out, documents, (*OUTPUT, *INNER), INNER)


#: The key of the registered query; keep your own secret.
QUERY_KEY = "surrogate key of the registered query"


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
