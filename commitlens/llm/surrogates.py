"""Operator 6 - personal data replaced by keyed surrogates (native expressions only).

Mentions are found by one pattern.  Each mention has one or more parts (the words of a name, else the whole);
a part's entity is its kind and normal form, so that spellings of the same number or name share a
surrogate (coreference).  A surrogate is drawn from a keyed hash of the entity and an attempt number and has the
entity's type: gender and script of names, letter and digit classes and separators elsewhere, check digit of cards, country
digits of phones and accounts, top-level domain of addresses, private or public network.  A
collision check gives every entity a surrogate of its own that no real entity of the corpus has: entities that lose are drawn again.

A name is found after a form of address.  Later or earlier words of the same document that equal a part of it
(capitalised, no letter before) get the same surrogate, unless the document also has the word in lower case: then it is an ordinary
word that stands after a title by chance.  A given name after a title without gender takes the gender that another
title of the document gives it, else a form of its own.

Not detected: names that never follow a form of address in their document, initials, inflected forms, and ten digits
without separators where no word such as "call" or "phone" stands before them.

Shuffles: mentions by entity (hot entities are split by adaptive execution) and by document, the words of documents with
names, and the texts once, to meet their surrogates.  The mention and entity tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import ascii_lower, let, materialise, row_key, skew_join, text_or_empty

# fixed values: forms of address that show a gender
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "д-р", "проф", "δρ")

_TITLE = "(?:" + "|".join(sorted({y for x in MALE + FEMALE + NEUTRAL for y in (x, x.upper())}, key=lambda x: (-len(x), x))) + ")"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TAIL = r"(?:['’][sS])?['’-]*$"     # possessive and loose marks after a name: not part of it
TITLED = r"(?<!\p{L})" + _TITLE + r"\.?\x20\p{Lu}"
PLAIN_PHONE = "[0-9]{10}"
KINDS = {   # in order of preference where several match at one place
    # labels without end are a possessive loop, which needs no stack; the other form, of few labels, may give back the last ones
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:(?:[A-Za-z0-9-]++\.(?=[A-Za-z0-9-]))++[A-Za-z]{2,24}"
              r"|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,20}\.[A-Za-z]{2,24})"),
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.+])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z.+])(?:\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}|(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])"
             rf"|(?=[0-9])(?<=(?:[Cc]all|[Tt]el|[Pp]hone|[Mm]obile|[Cc]ell|[Ff]ax)[.:]?\x20){PLAIN_PHONE}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}}){_TITLE}\.?\x20(?:{_NAME}\x20){{0,2}}{_NAME}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
MAYBE = r"[0-9@]|" + TITLED     # texts without a match have no mention; cheaper than PATTERN
NAME_KIND = "^(given|surname)_"
ROUNDS = 64

# building blocks for names: a rule, not lists of names
SYLLABLES = {"latin": "ba be da de fa fe ga go ka ke la le ma mo na no", "cyrillic": "ба бе да де фа фе га го ка ке ла ле ма мо на но",
             "greek": "βα βε δα δε φα φε γα γο κα κε λα λε μα μο να νο"}
ENDINGS = {"latin": {"m": "rtin vid nold bert", "f": "rina lina tte ssa", "n": "ren rley llis sky", "x": "rson field mann ville"},
           "cyrillic": {"m": "рис слав дим тон", "f": "рина лина ся ва", "n": "ша ня ли ри", "x": "ренко рчук рих рян"},
           "greek": {"m": "ρις νος σιος λης", "f": "ρια λια νη σα", "n": "ρι λι νι σι", "x": "ρακη λιδη του ρου"}}


def keyed(secret: str, *parts: Column) -> Column:
    """128 hex digits that depend on the secret and on all parts."""
    sep = F.lit("\x1f")
    inner = F.sha2(F.concat(F.lit(secret), *[x for p in parts for x in (sep, p)]), 512)
    return F.sha2(F.concat(inner, sep, F.lit(secret)), 512)


def stream(secret: str, n: Column, *parts: Column) -> Column:
    """At least ``n`` hex digits."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 128).cast("int")), lambda i: keyed(secret, *parts, i.cast("string"))), "")


def as_digits(h: Column) -> Column:
    return F.translate(h, "abcdef", "012345")


def as_letters(h: Column) -> Column:
    return F.translate(h, "0123456789abcdef", "bcdfghjklmnprstv")


def fill(shape: Column, h: Column) -> Column:
    """``shape`` with each letter and digit replaced by one of its class from the hex digits ``h``; the rest stays."""
    low, up, num = as_letters(h), F.upper(as_letters(h)), as_digits(h)
    one = lambda s, i: F.substring(s, i + 1, F.lit(1))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(F.regexp_like(c, F.lit("[0-9]")), one(num, i))
                                    .when(F.regexp_like(c, F.lit(r"\p{Lu}")), one(up, i)).when(F.regexp_like(c, F.lit(r"\p{L}")), one(low, i)).otherwise(c)), "")


def luhn(digits: Column) -> Column:
    """Sum that a valid card number has divisible by 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)).cast("int"))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def mod97(account: Column) -> Column:
    """Remainder of an account number, its first four characters moved to the end; 1 if valid."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.left(account, F.lit(4)))
    value = lambda c: F.when(F.regexp_like(c, F.lit("[0-9]")), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0),
                       lambda a, x: ((a * F.when(x > 9, 100).otherwise(10) + x) % 97).cast("int"))


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for k, p in reversed([(k, p) for k, p in KINDS.items() if k != "name"]):
        out = F.when(F.regexp_like(mention, F.lit(f"^(?:{p})$")), k).otherwise(out)
    return F.when(F.regexp_like(mention, F.lit(f"^{PLAIN_PHONE}$")), "phone").otherwise(out)


def script_of(word: Column) -> Column:
    return F.when(F.regexp_like(word, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(word, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def name_norm(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, _TAIL, ""))


def parts_of(mention: Column, kind: Column) -> Column:
    """Array of (kind, norm, raw): what gets a surrogate of its own."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    title = F.regexp_extract(mention, rf"^{_TITLE}", 0)
    gender = (F.when(F.upper(title).isin(*[x.upper() for x in MALE]), "m")
              .when(F.upper(title).isin(*[x.upper() for x in FEMALE]), "f").otherwise("n"))
    names = F.split(F.regexp_replace(mention, rf"^{_TITLE}\.?\x20", ""), " ")
    named = let(names, lambda w: F.transform(w, lambda x, i: F.struct(
        F.concat_ws("_", F.when(i == F.size(w) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender)), script_of(x)).alias("kind"),
        name_norm(x).alias("norm"), x.alias("raw"))))
    norm = (F.when(kind == "email", ascii_lower(mention)).when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn"), digits)
            .when(kind == "iban", F.replace(mention, F.lit(" "))).otherwise(mention))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"), mention.alias("raw"))))


def draw(secret: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """Surrogate of an entity in normal form."""
    a = attempt.cast("string")
    h = keyed(secret, kind, norm, a)
    more = F.when(attempt > 3, as_letters(F.left(h, attempt - 3))).otherwise("")    # names and addresses grow when short ones run out
    user, host = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.regexp_extract(host, r"\.[a-z]+$", 0)
    labels = F.left(host, F.length(host) - F.length(top))
    email = F.concat(fill(user, stream(secret, F.length(norm), kind, norm, a)), more, F.lit("@"),
                     fill(labels, stream(secret, F.length(norm), F.lit("host"), labels)), top)
    number = fill(norm, stream(secret, F.length(norm), kind, norm, a))
    card = F.concat(F.left(norm, F.lit(1)), F.substring(number, F.lit(2), F.length(norm) - 2))
    check = F.pmod(F.lit(10) - luhn(F.concat(card, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.concat(card, F.when(luhn(norm) % 10 == 0, check).otherwise(F.right(number, F.lit(1))))
    rest = fill(F.substring(norm, F.lit(5), F.length(norm)), stream(secret, F.length(norm), kind, norm, a))
    land = F.left(norm, F.lit(2))
    digits = F.lpad((98 - mod97(F.concat(land, F.lit("00"), rest))).cast("string"), 2, "0")
    iban = F.concat(land, F.when(mod97(norm) == 1, digits).otherwise(as_digits(F.right(h, F.lit(2)))), rest)
    octet = lambda i, n, lo: (F.conv(F.substring(h, 1 + 8 * i, 7), 16, 10).cast("long") % n + lo).cast("string")
    private = F.regexp_like(norm, F.lit(r"^(10|192\.168|172\.(1[6-9]|2[0-9]|3[01])|127)\."))
    ip = F.concat_ws(".", F.when(private, "10").otherwise(octet(0, 126, 97)), octet(1, 256, 0), octet(2, 256, 0), octet(3, 254, 1))
    word = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        syl = F.array(*[F.lit(x) for x in syllables.split()])
        pick = lambda i: F.get(syl, F.conv(F.substring(h, i, 1), 16, 10).cast("int"))  # noqa: E731, B023
        # a syllable more with each attempt after the fourth, so that any number of names finds room
        longer = F.array_join(F.transform(F.split(F.substring(h, F.lit(9), F.greatest(attempt - 3, F.lit(0))), ""),
                                          lambda c: F.get(syl, F.conv(c, 16, 10).cast("int"))), "")  # noqa: B023
        for kinds, form in ((f"given_m_{script}", "m"), (f"given_f_{script}", "f"), (f"given_n_{script}", "n"), (f"surname_{script}", "x")):
            end = F.array(*[F.lit(x) for x in ENDINGS[script][form].split()])
            tail = F.get(end, (F.conv(F.substring(h, 5, 1), 16, 10) % 4).cast("int"))
            word = F.when(kind == kinds, F.concat(pick(1), pick(2), pick(3), longer, tail)).otherwise(word)
    return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip)
            .when(kind == "iban", iban)
            .when(kind == "hex", F.left(stream(secret, F.length(norm), kind, norm, a), F.length(norm)))
            .when(kind.isin("phone", "ssn"), number).otherwise(word))


def into(raw: Column, kind: Column, core: Column) -> Column:
    """The surrogate in the shape of one mention part."""
    def spread(shape: Column, pattern: str, values: Column) -> Column:
        # the last length(values) characters of the class are replaced in order, earlier ones (country digits) and separators stay
        count = lambda s: F.length(F.regexp_replace(s, f"[^{pattern}]", ""))
        skip = count(shape) - F.length(values)
        return F.array_join(F.transform(F.split(shape, ""), lambda c, i: let(count(F.left(shape, i + 1)) - skip, lambda k: F.when(
            F.regexp_like(c, F.lit(f"[{pattern}]")) & (k > 0), F.substring(values, k, F.lit(1))).otherwise(c))), "")

    stem = F.regexp_replace(raw, _TAIL, "")
    title_case = F.concat(F.upper(F.left(core, F.lit(1))), F.substring(core, F.lit(2), F.length(core)))
    cased = F.concat(F.when((F.upper(stem) == stem) & (F.length(stem) > 1), F.upper(core)).otherwise(title_case), F.regexp_extract(raw, _TAIL, 0))
    return (F.when(kind.isin("phone", "card", "ssn"), spread(raw, "0-9", core)).when(kind == "iban", spread(raw, "A-Z0-9", core))
            .when(F.regexp_like(kind, F.lit(NAME_KIND)), cased).when((kind == "email") & (F.upper(raw) == raw), F.upper(core)).otherwise(core))


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_x_id, _x_rk, i, part, mention, kind, norm, raw): one row per part of each mention, ``i`` from 0 in each text."""
    text = F.col(f"`{text_col}`")
    found = (docs.where(F.regexp_like(text, F.lit(MAYBE))).select(F.col(f"`{id_col}`").alias("_x_id"), row_key(text).alias("_x_rk"),
                                                                 F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("i", "mention")).distinct())
    return (found.withColumn("_x_kind", kind_of(F.col("mention")))
            .select("*", F.posexplode(parts_of(F.col("mention"), F.col("_x_kind"))).alias("part", "_x_p"))
            .select("_x_id", "_x_rk", "i", "part", "mention", "_x_p.*"))


def with_gender(found: DataFrame) -> DataFrame:
    """Given names after a title without gender take the gender of the same name elsewhere in the document."""
    given = F.col("kind").startswith("given_")
    genders = found.where(given).groupBy("_x_id", "_x_rk", "norm").agg(F.min("kind").alias("_x_k"))
    genders = genders.select(F.struct("_x_id", "_x_rk", "norm").alias("_x_key"), "_x_k")
    names = found.where(F.col("kind").rlike(NAME_KIND))
    names = names.join(genders, F.struct("_x_id", "_x_rk", "norm").eqNullSafe(F.col("_x_key")), "left")
    names = names.withColumn("kind", F.when(given, F.col("_x_k")).otherwise(F.col("kind"))).select(*found.columns)
    return found.where(~F.col("kind").rlike(NAME_KIND)).unionByName(names)


def bare_names(docs: DataFrame, found: DataFrame, cores: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_x_bid, _x_brk, _x_b, _x_nb): for each document with bare mentions the capitalised words of each gap between
    mentions, replaced where they are a name of the document, and how many are.

    Words meet names by an equi-join on document and normal form.  What is grouped is one document's words.
    """
    text = F.col(f"`{text_col}`")
    key = ["_x_id", "_x_rk"]
    names = found.where(F.col("kind").rlike(NAME_KIND))
    # of a word that is a given name and a surname in one document the given name wins
    names = names.groupBy(*key, "norm").agg(F.min("kind").alias("kind"))
    texts = (docs.where(F.regexp_like(text, F.lit(TITLED)))
             .select(F.col(f"`{id_col}`").alias("_x_id"), row_key(text).alias("_x_rk"), F.split(text, PATTERN, -1).alias("_x_gaps")).distinct())
    gaps = texts.select(*key, F.posexplode("_x_gaps").alias("gap", "_x_g"))
    words = gaps.select(*key, "gap", F.posexplode_outer(F.regexp_extract_all("_x_g", F.lit(rf"(?<!\p{{L}}){_NAME}"), F.lit(0))).alias("pos", "word"))
    words = words.withColumn("norm", name_norm(F.col("word")))
    ordinary = gaps.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("_x_g", F.lit(r"(?<!\p{L})\p{Ll}[\p{L}'’-]+"), F.lit(0)))).alias("norm"))
    same = lambda a, b: F.struct(*[a[c].alias(c) for c in (*key, "norm")]).eqNullSafe(F.struct(*[b[f"_x_r{c}"].alias(c) for c in (*key, "norm")]))
    away = lambda df: df.withColumnsRenamed({c: f"_x_r{c}" for c in (*key, "norm")})
    right = away(ordinary.withColumn("norm", name_norm(F.col("norm"))).distinct())
    names = names.join(right, same(names, right), "left_anti")
    named = away(skew_join(names, cores, ["kind", "norm"]).select(*key, "norm", "kind", "core"))
    hits = words.join(named, same(words, named), "left")
    one = F.struct("pos", F.coalesce(into(F.col("word"), F.col("kind"), F.col("core")), F.col("word")).alias("s"))
    per_gap = hits.groupBy(*key, "gap").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), one))).alias("_x_w"),
                                            F.count("core").alias("_x_n"))
    per_doc = per_gap.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("gap", "_x_w"))).alias("_x_b"), F.sum("_x_n").cast("int").alias("_x_nb"))
    return per_doc.where("_x_nb > 0").withColumnsRenamed({"_x_id": "_x_bid", "_x_rk": "_x_brk"})


def surrogate_table(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, core) for distinct (kind, norm): cores differ from each other and from all norms of their kind.

    Of entities that draw the same core the one with the smallest norm keeps it; the others, and those that drew
    a real norm or a core given out in an earlier round, draw again.  Each round is written once.
    """
    todo, done = entities.select("kind", "norm").withColumn("attempt", F.lit(0)), None
    for _ in range(ROUNDS):
        drawn = materialise(todo.withColumn("core", draw(secret, F.col("kind"), F.col("norm"), F.col("attempt"))), "surrogates")
        taken = entities.select("kind", F.col("norm").alias("core"))
        taken = taken if done is None else taken.unionByName(done.select("kind", "core"))
        best = drawn.groupBy("kind", "core").agg(F.min("norm").alias("_x_best"))
        best = best.join(taken.distinct(), ["kind", "core"], "left_anti").withColumnsRenamed({"kind": "_x_k", "core": "_x_c"})
        won = drawn.join(best, (F.col("kind") == F.col("_x_k")) & (F.col("core") == F.col("_x_c")) & (F.col("norm") == F.col("_x_best")), "left_semi")
        won = won.select("kind", "norm", "core")
        left = drawn.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        done = materialise(won if done is None else done.unionByName(won), "surrogates")
        todo = materialise(left, "surrogates")
        if todo.isEmpty():
            return done
    raise RuntimeError(f"some entities have no free surrogate after {ROUNDS} draws: their format allows too few values")


def replace_entities(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with mentions in ``text`` replaced, plus ``entities``: an array of (kind, count).

    ``secret`` keys the surrogates; the same secret and corpus give the same ones.  Words that repeat a name
    without a form of address are counted as kind ``bare_name``.

    Defined results: a null text stays null, a text without a mention stays as it is; null ids, repeated ids
    and repeated rows are replaced like any other row; extra columns are carried along, one called
    ``entities`` is replaced.
    """
    found = materialise(mentions(docs, id_col, text_col), "mentions")
    found = materialise(with_gender(found), "mentions")
    cores = surrogate_table(found.select("kind", "norm").distinct(), secret)
    named = skew_join(found, cores, ["kind", "norm"])
    whole = F.when(F.col("_x_w")[0]["kind"].rlike(NAME_KIND), F.concat(
        F.regexp_extract("mention", rf"^{_TITLE}\.?\x20", 0), F.array_join(F.transform("_x_w", lambda p: p["s"]), " "))).otherwise(F.col("_x_w")[0]["s"])
    each = (named.select("_x_id", "_x_rk", "i", "mention", F.struct("part", "kind", into(F.col("raw"), F.col("kind"), F.col("core")).alias("s")).alias("_x_p"))
            .groupBy("_x_id", "_x_rk", "i", "mention").agg(F.sort_array(F.collect_list("_x_p")).alias("_x_w"))
            .select("_x_id", "_x_rk", F.struct("i", whole.alias("s"), F.regexp_replace(F.col("_x_w")[0]["kind"], "^(given|surname)_.*", "name").alias("kind")).alias("_x_m")))
    rows = (each.groupBy("_x_id", "_x_rk").agg(F.sort_array(F.collect_list("_x_m")).alias("_x_m"))
            .withColumnsRenamed({"_x_id": "_x_gid", "_x_rk": "_x_grk"}))
    text = F.col(f"`{text_col}`")
    keyed_docs = docs.drop("entities").withColumns({"_x_id": F.col(f"`{id_col}`"), "_x_rk": row_key(text)})
    joined = keyed_docs.join(rows, F.col("_x_id").eqNullSafe(F.col("_x_gid")) & (F.col("_x_rk") == F.col("_x_grk")), "left")
    bare = bare_names(docs, found, cores, id_col, text_col)
    joined = joined.join(bare, F.col("_x_id").eqNullSafe(F.col("_x_bid")) & (F.col("_x_rk") == F.col("_x_brk")), "left")

    def gap_text(gap: Column, i: Column) -> Column:
        parts = F.split(gap, rf"(?<!\p{{L}}){_NAME}", -1)
        spliced = let(F.get(F.col("_x_b"), i)["_x_w"], lambda w: F.array_join(F.flatten(F.transform(parts, lambda g, j: F.array(
            g, F.coalesce(F.get(w, j)["s"], F.lit(""))))), ""))
        return F.when(F.col("_x_b").isNull(), gap).otherwise(spliced)

    new = let(F.col("_x_m"), lambda m: F.array_join(F.flatten(F.transform(F.split(text_or_empty(text), PATTERN, -1), lambda g, i: F.array(
        gap_text(g, i), F.coalesce(F.get(m, i)["s"], F.lit(""))))), ""))
    kinds = F.transform(F.array(*[F.lit(k) for k in KINDS]), lambda k: F.struct(k.alias("kind"), F.size(F.filter("_x_m", lambda x: x["kind"] == k)).alias("n")))
    kinds = F.concat(kinds, F.array(F.struct(F.lit("bare_name").alias("kind"), F.coalesce("_x_nb", F.lit(0)).alias("n"))))
    counts = F.when(F.col("_x_m").isNull(), F.array().cast("array<struct<kind:string,n:int>>")).otherwise(F.filter(kinds, lambda c: c["n"] > 0))
    return joined.select(*[(F.when(F.col("_x_m").isNull(), text).otherwise(new).alias(c) if c == text_col else F.col(f"`{c}`"))
                           for c in docs.columns if c.lower() != "entities"], counts.alias("entities"))
