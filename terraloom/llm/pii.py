"""Surrogates for personal data; DataFrame functions only.

Entities are found by one pattern: e-mail addresses, IPv4 and IPv6 addresses, payment cards, IBANs, social security numbers, phone numbers,
secrets (long hexadecimal strings, well-known key formats, values assigned to a token, secret, password or key) and names after a title. Each is replaced by a surrogate
made from a key, its kind and its canonical form, so one entity has one surrogate in every document, however it is written (coreference):

* letters become letters and digits digits, case and punctuation stay where they are; an e-mail address keeps its top-level domain, an IBAN its country
* an IPv6 address, however shortened, becomes one of eight groups of four; of those with "::" only such as have a group of three signs or more and a digit, or begin
  with fc or fd, are entities ([1::2] is not), and of one that ends as IPv4 the IPv4 address alone
* a card number passes Luhn's test if and only if the original does; IPv4 octets are 1 to 254; hexadecimal stays so
* names grow by a syllable with each attempt, so there is always one more; names keep their title; a given name becomes a name of the title's gender, a surname another surname, both in the script (Latin, Cyrillic or Greek) of the original

Distinct entities keep distinct surrogates, none of which is an entity of the input: collisions are searched among all distinct entities,
and all but the least of the colliding ones get the surrogate of another attempt, until there are none.

Documents without entities pass in one scan. The others are numbered and saved; their distinct entities get surrogates, and these go back to the documents by entity and by
number, so that only documents with entities are ever exchanged, and an entity that very many documents share is one row until the join, which the engine splits.

A null text stays null and an empty one empty, without entities. Rows that repeat are rewritten alike. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Workspace

#: Titles before names, by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: An IPv6 address with "::", of eight groups at most; a group of three signs sets it apart from slices and times, a digit or fc, fd from scopes of names.
_SHORT = rf"(?=(?:{_HEX}(?::{_HEX}){{0,6}})?::)(?!(?:[0-9A-Fa-f]{{0,4}}:){{9}})(?=[0-9A-Fa-f:]{{0,38}}[0-9]|[Ff][CcDd])(?=[0-9A-Fa-f:]{{0,36}}[0-9A-Fa-f]{{3}})(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?(?!\.[0-9])"
_NAME = r"\p{Lu}\p{L}{1,40}(?:[ -]\p{Lu}\p{L}{1,40}){0,2}+"
_TITLE = "(?:" + "|".join(sorted(FEMALE + MALE, key=len, reverse=True)) + r")\.?"
_ASSIGNED = "token|secret|password|passwd|api[_-]key|apikey|access[_-]key"
#: In this order: at one place the first that fits is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ipv6": rf"(?<![0-9A-Za-z:])(?:(?=[0-9A-Fa-f:]{{0,38}}[0-9])(?:{_HEX}:){{7}}{_HEX}|{_SHORT})(?![0-9A-Za-z:])",
    "ipv4": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{9,15}(?![0-9A-Za-z])",
    "hex": r"(?<![0-9A-Za-z])(?=[A-Fa-f]{0,63}[0-9])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "secret": rf"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,64}})(?![0-9A-Za-z])|(?<=[\"'=:]|[=:] )(?<=(?i:{_ASSIGNED})\s{{0,2}}[=:]\s{{0,2}}[\"']{{0,1}})[A-Za-z0-9_+/~-]{{8,128}}",
    "person": rf"(?<!\p{{L}}){_TITLE} {_NAME}",
}
ENTITY = "|".join(PATTERNS.values())
#: Every entity holds one of these.
HINT = rf"[0-9@]|::|(?i:{_ASSIGNED})|{_TITLE} \p{{Lu}}"
ATTEMPTS = 32
#: Kinds of the words of names.
NAMES = ("female", "male", "surname")

#: Syllables by script, each an open one, and endings of names.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he hi ja jo ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe ra re ri ro ru sa se si so ta te ti to va ve vi wa we za ze".split(),
    "cyrillic": "ба бе би бо ва ве ви во га да де ди до за зе ка ки ко ла ле ли ло ма ме ми мо на не ни но па ре ри ро са се си со та те ти".split(),
    "greek": "βα βε γα γε δα δε δι κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι τα τε τι".split(),
}
ENDINGS = {"latin": ("na", "n", "ler"), "cyrillic": ("на", "н", "ко"), "greek": ("να", "νος", "κης")}


def _one(column: Column, pattern: str) -> Column:
    return column.rlike(f"^(?:{pattern})$")


def _kind(found: Column) -> Column:
    """Of an entity cut out of its text: what it looks like alone, in the order of ``PATTERNS``."""
    out = F.when(found.contains("@"), "email")
    for kind in ("ipv6", "ipv4", "iban", "card", "ssn", "phone", "hex", "person"):
        out = out.when(_one(found, PATTERNS[kind]), kind)
    return out.otherwise("secret")


def _canonical(kind: Column, found: Column) -> Column:
    halves = F.split(F.lower(found), "::", 2)
    left, right = (F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "") for k in (0, 1))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    whole = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(kind.isin("email", "ipv4"), F.lower(found)).when(kind == "ipv6", whole).otherwise(F.regexp_replace(F.lower(found), "[^0-9a-z]+", ""))


def _staged(units: DataFrame, key: str) -> DataFrame:
    """Adds ``made``, the surrogate of kind, canon and attempt in canonical form. Each step is a column of its own, so that none is evaluated twice."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
    rows = units.withColumn("digest", F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{k}")), 256) for k in range(4))))
    rows = rows.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.conv(F.substring(F.col("digest"), k * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    rows = rows.withColumn("plain", F.regexp_replace("canon", "[^0-9a-z]+", "")).withColumn("chars", F.filter(F.split("plain", ""), lambda c: c != ""))
    first = F.when(F.col("kind") == "iban", 2).otherwise(0)
    last = F.size("chars") - F.when(F.col("kind") == "email", F.length(F.substring_index("canon", ".", -1))).otherwise(0)
    letters = F.when(F.col("kind").isin("hex", "ipv6"), "abcdef").otherwise("abcdefghijklmnopqrstuvwxyz")
    rows = rows.withColumns({"first": first, "last": last, "letters": letters})

    def char(c: Column, i: Column) -> Column:
        v = F.element_at("v", F.pmod(i, F.lit(128)) + 1)
        digit = F.when((i == 0) & (c != "0"), 1 + v % 9).otherwise(v % 10).cast("string")
        letter = F.substring(F.col("letters"), v % F.length("letters") + 1, F.lit(1))
        return F.when((i < F.col("first")) | (i >= F.col("last")), c).when(c.between("0", "9"), digit).otherwise(letter)

    rows = rows.withColumn("text", F.array_join(F.transform("chars", char), ""))
    rows = rows.withColumn("body", F.substring("text", F.lit(1), F.length("text") - 1)).withColumn("zero", F.concat("body", F.lit("0")))
    digit = F.pmod(_luhn(F.col("plain")) - _luhn(F.col("zero")), F.lit(10)).cast("string")
    octets = F.concat_ws(".", *((F.col("v")[k] % 254 + 1).cast("string") for k in range(4)))
    made = F.when(F.col("kind") == "ipv4", octets).when(F.col("kind") == "card", F.concat("body", digit)).when(F.col("kind").isin(*NAMES), _name()).otherwise(F.col("text"))
    return rows.withColumn("made", made).select("kind", "canon", "attempt", "made")


def _luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name() -> Column:
    """Three syllables, one more for each attempt, and an ending, of the script of ``canon``."""
    script = _script(F.col("canon"))
    out = None
    for name, syllables in SYLLABLES.items():
        known, ends = F.array(*map(F.lit, syllables)), F.array(*map(F.lit, ENDINGS[name]))
        drawn = F.transform(F.sequence(F.lit(0), F.col("attempt") + 2), lambda k: F.element_at("v", 2 * k + 1) * 256 + F.element_at("v", 2 * k + 2))
        parts = F.transform(drawn, lambda x: F.element_at(known, x % F.size(known) + 1))
        whole = F.concat(F.array_join(parts, ""), F.when(F.col("kind") == "female", ends[0]).when(F.col("kind") == "male", ends[1]).otherwise(ends[2]))
        out = F.when(script == name, whole) if out is None else out.when(script == name, whole)
    return out


def _laid() -> Column:
    """``made`` in the written form ``found``: its punctuation and case; an IPv6 address in eight groups of four."""

    def put(state: Column, c: Column) -> Column:
        taken = F.substring(F.col("made"), state["at"], F.lit(1))
        word = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(state["text"], F.when(~word, c).when(c.rlike("[A-Z]"), F.upper(taken)).otherwise(taken)).alias("text"), (state["at"] + word.cast("int")).alias("at"))

    chars = F.filter(F.split("found", ""), lambda c: c != "")
    groups = F.regexp_replace("made", "(.{4})(?!$)", "$1:")
    groups = F.when(F.col("found").rlike("[A-F]"), F.upper(groups)).otherwise(groups)
    return F.when(F.col("kind") == "ipv4", F.col("made")).when(F.col("kind") == "ipv6", groups).otherwise(F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), put)["text"])


def _gender(found: Column) -> Column:
    return F.when(F.regexp_replace(F.split(found, " ")[0], r"\.", "").isin(*FEMALE), "female").otherwise("male")


def _parts(found: DataFrame) -> DataFrame:
    """found, n, of (how many), lead, kind, canon: one row for an entity, or one for each word of a name with what stands before it."""
    rows = found.withColumn("whole", _kind(F.col("found")))
    plain = rows.where("whole <> 'person'").select("found", F.lit(0).alias("n"), F.lit("").alias("lead"), F.col("whole").alias("kind"), _canonical(F.col("whole"), F.col("found")).alias("canon"))
    words = rows.where("whole = 'person'").withColumns({"title": F.split("found", " ")[0], "names": F.regexp_replace("found", "^[^ ]+ ", "")})
    words = words.select("found", "title", F.posexplode(F.split("names", "(?=[ -])")).alias("n", "w"), F.size(F.split("names", "[ -]")).alias("of"))
    words = words.select(
        "found",
        "n",
        F.when(F.col("n") == 0, F.concat("title", F.lit(" "))).otherwise(F.substring("w", 1, 1)).alias("lead"),
        F.when(F.col("n") == F.col("of") - 1, "surname").otherwise(_gender(F.col("found"))).alias("kind"),
        F.lower(F.regexp_replace("w", "^[ -]", "")).alias("canon"),
    )
    return plain.unionByName(words)


def entities(text: Column) -> Column:
    """Entities of a text as written, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def _spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Dealt to a fixed number of tasks: a few bytes make much work here, and small partitions would be put together.

    By a hash of the columns, as the planner drops an exchange by the columns of the aggregate below it.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))


def unit_surrogates(units: DataFrame, key: str, store: Workspace) -> DataFrame:
    """kind, canon, attempt, made of distinct units: distinct by kind, and none a unit of the input."""
    state = store.save(_staged(_spread(units, "kind", "canon").withColumn("attempt", F.lit(0)), key), "made")
    for _ in range(ATTEMPTS):
        several = state.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("kind").alias("k"), F.col("made").alias("m"), F.col("first.canon").alias("stays"))
        twice = state.join(several, (F.col("kind") == F.col("k")) & (F.col("made") == F.col("m"))).where("canon <> stays").select("kind", "canon")
        plain = F.when(F.col("kind") == "ipv4", F.col("canon")).otherwise(F.regexp_replace("canon", "[^0-9a-z\\u0370-\\u04ff]+", ""))
        real = state.select(F.col("kind").alias("k"), plain.alias("c"))
        known = state.join(real, (F.col("kind") == F.col("k")) & (F.col("made") == F.col("c")), "left_semi").select("kind", "canon")
        bad = store.save(twice.union(known).distinct().select(F.col("kind").alias("k"), F.col("canon").alias("c")), "collisions")
        if bad.isEmpty():
            return state
        state = state.join(bad, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")), "left")
        state = store.save(_staged(state.select("kind", "canon", (F.col("attempt") + F.col("c").isNotNull().cast("int")).alias("attempt")), key), "made")
    raise ValueError("surrogates collide after all attempts")


_COUNTS = {"n_email": ("email",), "n_phone": ("phone",), "n_ip": ("ipv4", "ipv6"), "n_number": ("card", "iban", "ssn"), "n_secret": ("hex", "secret"), "n_person": ("person",)}


def surrogates(docs: DataFrame, key: str = "terraloom") -> DataFrame:
    """doc_id, text with surrogates, n_entities and their number by kind, of every row of ``docs``."""
    store = Workspace(docs.sparkSession, "pii")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("found", entities(F.col("text")))
    zeros = {name: F.lit(0).cast("long") for name in ("n_entities", *_COUNTS)}
    clear = rows.where(F.coalesce(F.size("found"), F.lit(0)) <= 0).select("doc_id", "text", *(zeros[n].alias(n) for n in zeros))

    held = store.save(rows.where(F.size("found") > 0).withColumn("row", F.monotonically_increasing_id()), "held")
    places = held.select("row", F.posexplode("found").alias("at", "found"))
    parts = store.save(_parts(_spread(places.select("found").distinct(), "found")), "parts")
    made = unit_surrogates(parts.select("kind", "canon").distinct(), key, store).select(F.col("kind").alias("k"), F.col("canon").alias("c"), "made")
    parts = parts.join(made, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")))
    capital = F.concat(F.upper(F.substring("made", 1, 1)), F.substring("made", F.lit(2), F.length("made")))
    person = F.col("kind").isin(*NAMES)
    parts = parts.withColumn("written", F.when(person, F.concat("lead", capital)).otherwise(_laid()))
    parts = parts.withColumn("kind", F.when(person, "person").otherwise(F.col("kind")))
    whole = parts.groupBy("found").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "written"))), lambda p: p["written"]), "").alias("written"), F.first("kind").alias("kind"))
    whole = store.save(whole, "written").withColumnRenamed("found", "f")

    back = places.join(whole, F.col("found") == F.col("f")).groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("at", "written", "kind"))).alias("new"))
    out = held.join(back, F.col("row") == F.col("of"))
    between = F.split("text", ENTITY, -1)
    out = out.withColumn("between", between)
    text = F.concat(F.array_join(F.zip_with(F.slice("between", 1, F.size("new")), "new", lambda b, n: F.concat(b, n["written"])), ""), F.element_at("between", -1))
    count = lambda kinds: F.size(F.filter("new", lambda n: n["kind"].isin(*kinds))).cast("long")
    counts = [count(kinds).alias(name) for name, kinds in _COUNTS.items()]
    return clear.unionByName(out.select("doc_id", text.alias("text"), F.size("new").cast("long").alias("n_entities"), *counts))
