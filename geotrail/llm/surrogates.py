"""Personal data: detected entities get keyed surrogates of their own kind.

Detection is one regular expression of all kinds, so a text splits into gaps and matches that
alternate. Matches that name the same thing have the same canonical form whatever their writing
(case of an e-mail address, separators of a number, title before a name). A keyed hash of kind,
canonical form and a count of attempts drives the surrogate:

* letters give letters of the same case, digits give digits, everything else stays, so addresses,
  numbers and keys keep their format; country codes, top-level domains and key prefixes stay; a
  card number with a valid check digit gets a valid one;
* the parts of an IP address stay within 0 and 255;
* a name gets names of the same gender (from the title) and script, as many and in the same case.

A text that gives a name a title may name the same person without it, or by the family name alone:
both are found and get what belongs to the titled name. A single word without a title is left alone
where it may be no name: first in a sentence, or in a row of capitalised words. A family name that several full names of
the text share is not linked, and is an entity of its own.

Collisions are checked over the whole corpus: two entities of a kind must not get the same
surrogate, nor one that another entity really has. Those that do try again with the next
attempt until none is left. Equal entities have equal surrogates in all documents. A family name
that is linked to a full name gets the last part of that one's surrogate; both are told apart from
all others'.

Only built-in functions are used. Texts are exchanged for documents with entities alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrail.llm.tables import bucket_flag, saved, whole

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles that come before names, by gender.
TITLES = {
    "f": "Mrs Ms Miss Frau Mme Mlle Madame Sra Señora Doña Signora Г-жа Госпожа Κυρία Κα",
    "m": "Mr Herr Herrn Monsieur Sr Señor Don Signor Г-н Господин Κύριος Κος",
}
#: Common names by script and gender, and family names by script.
FIRST_NAMES = {
    ("latin", "f"): "Anna Maria Laura Julia Clara Emma Sofia Elena Alice Nora Lucia Marta",
    ("latin", "m"): "Paul David Martin Daniel Thomas Simon Oscar Felix Adrian Victor Hugo Leon",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Вера Юлия",
    ("cyrillic", "m"): "Иван Пётр Павел Сергей Андрей Николай Олег Юрий",
    ("greek", "f"): "Άννα Μαρία Ελένη Σοφία Ειρήνη Δήμητρα Ζωή Αθηνά",
    ("greek", "m"): "Γιώργος Νίκος Πέτρος Δημήτρης Ανδρέας Παύλος Κώστας Ηλίας",
}
FAMILY_NAMES = {
    "latin": "Baker Carter Fischer Weber Moreau Bernard Castillo Romero Novak Olsen Keller Marsh",
    "cyrillic": "Иванов Петров Смирнов Волков Соколов Морозов Новиков Орлов",
    "greek": "Παππάς Νικολάου Γεωργίου Δημητρίου Ιωάννου Αντωνίου Βασιλείου Κωνσταντίνου",
}


def _any_case(line: str) -> str:
    """A pattern for the words of a line, as they are or in capitals."""
    return "|".join(dict.fromkeys(w for t in line.split() for w in (t, t.upper())))


_TITLE = _any_case(" ".join(TITLES.values()))
# Every pattern is only tried where no letter or digit goes before, and gives up at once on most
# words: it never looks at the same characters again. Loops over groups are possessive or bounded,
# as others go down a level for each turn.
KINDS = {
    # Labels up to the first that starts with two letters, then what goes on without a break.
    "email": r"(?<![._%+\-])[\p{L}\p{N}._%+\-]++@"
    r"(?:[\p{L}\p{N}\-]|\.(?!\p{L}{2})(?=[\p{L}\p{N}\-]))++\.\p{L}{2}"
    r"(?:[\p{L}\p{N}]|[.\-](?=[\p{L}\p{N}]))*+",
    "ip": rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)",
    "hex": r"(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?!\w)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<!\+)\d{4}(?:[ \-]?\d{4}){3}(?![\w]|-\d)",
    "national_id": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w)",
    "person": rf"(?=\p{{Lu}})(?:{_TITLE})\.? \p{{Lu}}\p{{L}}+(?:[ \-]\p{{Lu}}\p{{L}}+){{0,2}}",
}
ENTITY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
# Country codes of one to three digits, whatever stands between them.
_GAP = r"[ .\-()]*"
_COUNTRY = (
    rf"\+(?:1|7|2{_GAP}[07]|3{_GAP}[0-469]|4{_GAP}[013-9]|5{_GAP}[1-8]|6{_GAP}[0-6]"
    rf"|8{_GAP}[1246]|9{_GAP}[0-58]|\d{_GAP}\d{_GAP}\d)"
)


def untitled(text: Column) -> Column:
    """The names that have a title in a text, and their family names, longest first."""
    found = F.regexp_extract_all(
        text, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){KINDS['person']}"), F.lit(0)
    )
    names = F.transform(found, lambda m: F.regexp_replace(m, rf"\A(?:{_TITLE})\.? ", ""))
    family = F.transform(names, lambda n: F.regexp_extract(n, r"[^ ]+\z", 0))
    both = F.array_distinct(F.concat(names, family))
    sized = F.transform(both, lambda n: F.struct(-F.length(n), n.alias("name")))
    return F.transform(F.sort_array(sized), lambda r: r["name"])


# What a single word must not be to be a name without a title.
_FIRST_WORD = r"(?!\A)(?<!\n)(?<![\p{Ll}\p{Nd})\"][.!?] )"
_IN_A_ROW = r"(?<!\p{Lu}\p{L}{0,30} )"


def pattern(names: Column) -> Column:
    """``ENTITY``, and the names without their titles where there are some."""

    def among(some: Column, before: str, after: str) -> Column:
        head = F.lit(rf"|(?<![\p{{L}}\p{{N}}_])(?=\p{{Lu}}){before}(?iu:")
        tail = F.lit(rf")(?![\p{{L}}\p{{N}}_]){after}")
        listed = F.concat(head, F.array_join(some, "|"), tail)
        return F.when(F.size(some) > 0, listed).otherwise(F.lit(""))

    full = F.filter(names, lambda n: n.contains(" "))
    single = F.filter(names, lambda n: ~n.contains(" "))
    return F.concat(
        F.lit(ENTITY),
        among(full, "", ""),
        among(single, _FIRST_WORD + _IN_A_ROW, r"(?! \p{Lu}\p{L})"),
    )


def kind_of(found: Column) -> Column:
    """The first kind whose whole pattern a match is."""
    kind = F.lit("person")
    for name, pattern in reversed(KINDS.items()):
        # What a pattern asks of the characters around holds at the ends of the match itself.
        kind = F.when(found.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(kind)
    return kind


def canonical(kind: Column, found: Column) -> Column:
    """What all writings of an entity have in common."""
    return (
        F.when(kind.isin("email", "hex"), F.lower(found))
        .when(kind.isin("card", "iban", "national_id"), F.regexp_replace(found, r"[ \-]", ""))
        .when(kind == "phone", F.regexp_replace(found, r"[^+\d]", ""))
        .when(kind == "person", F.lower(F.regexp_replace(found, rf"\A(?:{_TITLE})\.? ", "")))
        .otherwise(found)
    )


def kept_prefix(kind: Column, found: Column) -> Column:
    """What stays at the start of a match: country codes, key prefixes and titles."""
    return (
        F.when(kind == "phone", F.regexp_extract(found, rf"\A(?:{_COUNTRY})?", 0))
        .when(kind == "key", F.substring(found, 1, 4))
        .when(kind == "iban", F.substring(found, 1, 2))
        .when(kind == "person", F.regexp_extract(found, rf"\A(?:(?:{_TITLE})\.? )?", 0))
        .otherwise(F.lit(""))
    )


def _filled(body: Column) -> Column:
    """``body`` with its letters and digits replaced in order by those of the entity's stream."""

    def step(done: Column, c: Column) -> Column:
        # Separators use up nothing of the stream: other writings get the same letters.
        at = F.length(F.regexp_replace(done, r"[^\p{L}\p{Nd}]", "")) % 128 + 1
        letter = F.substring(F.col("_letters"), at, F.lit(1))
        return F.concat(
            done,
            F.when(c.rlike(r"\A\p{Nd}\z"), F.substring(F.col("_numbers"), at, F.lit(1)))
            .when(c.rlike(r"\A\p{Lu}\z"), F.upper(letter))
            .when(c.rlike(r"\A\p{L}\z"), letter)
            .otherwise(c),
        )

    return F.aggregate(F.split(body, ""), F.lit(""), step)


def _luhn(number: Column) -> Column:
    """The check sum of a number's digits, 0 for a valid one."""
    doubled = F.array(*(F.lit((2 * d) // 10 + (2 * d) % 10) for d in range(10)))
    value = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(
            i % 2 == 1, F.get(doubled, c.cast("int"))
        ).otherwise(c.cast("int")),
    )
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10


def _card(found: Column) -> Column:
    """Another number in place of one that ``_filled`` has made, valid where the old one is."""
    head = F.substring(F.col("_fill"), F.lit(1), F.length("_fill") - 1)
    check = (10 - _luhn(F.concat(F.regexp_replace(head, r"\D", ""), F.lit("0")))) % 10
    valid = _luhn(F.regexp_replace(found, r"\D", "")) == 0
    return F.when(valid, F.concat(head, check.cast("string"))).otherwise(F.col("_fill"))


def _octets(digits: Column) -> Column:
    def octet(n: int) -> Column:
        part = F.conv(F.substring(digits, 4 * n + 1, 4), 16, 10).cast("int")
        return (part % (223 if n == 0 else 256) + (1 if n == 0 else 0)).cast("string")

    return F.concat_ws(".", *(octet(n) for n in range(4)))


def _pick(line: str, digits: Column, at: int) -> Column:
    names = line.split()
    index = F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint") % len(names)
    return F.get(F.array(*(F.lit(n) for n in names)), index.cast("int"))


def gender(found: Column) -> Column:
    """From the title of a match; the match of another kind has none."""
    female = found.rlike(rf"\A(?:{_any_case(TITLES['f'])})\.? ")
    return F.when(female, F.lit("f")).otherwise(F.lit("m"))


def _name(name: Column, sex: Column, digits: Column, attempt: Column) -> Column:
    """Names for a name of one to three words. From the third attempt on initials widen the
    choice, one more with each attempt, so that any number of names finds enough."""

    def of(script: str) -> Column:
        family = _pick(FAMILY_NAMES[script], digits, 1)
        women, men = FIRST_NAMES[(script, "f")], FIRST_NAMES[(script, "m")]

        def first(at: int) -> Column:
            return F.when(sex == "f", _pick(women, digits, at)).otherwise(_pick(men, digits, at))

        words = F.size(F.split(name, r"[ \-]"))
        keyed = F.substring(digits, F.lit(40), F.least(attempt + 1, F.lit(80)))
        initials = F.upper(F.translate(keyed, "0123456789", "ghijklmnop"))
        wide = F.when(attempt >= 2, F.concat(initials, F.lit(" "))).otherwise(F.lit(""))
        return (
            F.when(words == 1, F.concat(wide, family))
            .when(words == 2, F.concat(first(9), F.lit(" "), wide, family))
            .otherwise(F.concat(first(9), F.lit(" "), first(17), F.lit(" "), wide, family))
        )

    found = (
        F.when(name.rlike(r"\p{IsCyrillic}"), of("cyrillic"))
        .when(name.rlike(r"\p{IsGreek}"), of("greek"))
        .otherwise(of("latin"))
    )
    return F.when(name == F.upper(name), F.upper(found)).otherwise(found)


def with_surrogate(df: DataFrame, match: str, key: str, name: str) -> DataFrame:
    """``df`` (``kind, canon, sex, attempt`` and a match) with the surrogate of the match: as the
    match is written, but for another entity."""
    kind, found = F.col("kind"), F.col(match)
    entity = F.concat_ws("\u0001", F.lit(key), kind, "canon", F.col("attempt").cast("string"))
    prefix = F.when(kind == "email", F.lit("")).otherwise(kept_prefix(kind, found))
    suffix = F.when(kind == "email", F.regexp_extract(found, r"\.\p{L}+\z", 0)).otherwise("")
    # Columns of their own, so that each is computed once for all characters.
    parts = (
        df.withColumn("_digits", F.sha2(entity, 512))
        .withColumn("_numbers", F.translate("_digits", "abcdef", "271803"))
        .withColumn("_letters", F.translate("_digits", "0123456789abcdef", "bcdfghjklmnprstv"))
        .withColumn("_prefix", prefix)
        .withColumn("_suffix", suffix)
    )
    inner = F.length(found) - F.length("_prefix") - F.length("_suffix")
    parts = parts.withColumn("_body", F.substring(found, F.length("_prefix") + 1, inner))
    parts = parts.withColumn("_fill", _filled(F.col("_body")))
    made = (
        F.when(kind == "ip", _octets(F.col("_digits")))
        .when(kind == "hex", F.substring(F.col("_digits"), F.lit(1), F.length(found)))
        .when(kind == "card", _card(found))
        .when(
            kind == "person",
            _name(F.col("_body"), F.col("sex"), F.col("_digits"), F.col("attempt")),
        )
        # Short addresses can run out of others of their format: late attempts are longer.
        .when(
            (kind == "email") & (F.col("attempt") >= 8),
            F.concat(F.substring("_letters", 100, 8), F.col("_fill")),
        )
        .otherwise(F.col("_fill"))
    )
    return parts.withColumn(name, F.concat("_prefix", made, "_suffix")).drop(
        "_digits", "_numbers", "_letters", "_prefix", "_suffix", "_body", "_fill"
    )


class Surrogates:
    """Surrogates for one table of documents under one key.

    Null and empty texts have no entities and stay as they are. Rows that repeat an id or a text
    are rows like others. Extra columns are kept, whatever their names; an empty table gives an
    empty result.
    """

    def __init__(
        self, docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text"
    ):
        self.docs, self.key, self.text = docs, key, text
        self.rows = docs.select(
            F.col(doc_id).alias("_id"),
            F.col(text).alias("_text"),
            F.xxhash64(F.col(text)).alias("_mark"),
            whole(docs),
            untitled(F.col(text)).alias("_names"),
        ).withColumn("_pattern", pattern(F.col("_names")))
        # One row for each match; rows that repeat an id and text repeat their matches.
        all_matches = F.regexp_extract_all(F.col("_text"), F.col("_pattern"), F.lit(0))
        found = F.posexplode(all_matches).alias("_place", "_match")
        self.entities = saved(
            self._linked(
                saved(
                    self.rows.select("_id", "_mark", found)
                    .distinct()
                    .withColumn("kind", kind_of(F.col("_match")))
                    .withColumn("_plain", canonical(F.col("kind"), F.col("_match")))
                )
            )
        )

    @staticmethod
    def _linked(found: DataFrame) -> DataFrame:
        """``canon``: what a match says, but for a family name the full name that has a title, the
        same gender and this family name in the same text, if there is one only."""
        titled, sex = F.col("_match").rlike(rf"\A(?:{_TITLE})\.? "), gender(F.col("_match"))
        full = found.where(
            (F.col("kind") == "person") & titled & F.contains("_plain", F.lit(" "))
        ).withColumn("sex", sex)

        def ends(name: str, where: Column) -> list[Column]:
            held = F.when(where, F.col("_plain"))
            return [F.min(held).alias(f"{name}_low"), F.max(held).alias(f"{name}_high")]

        by_family = full.groupBy(
            F.col("_id").alias("_i"),
            F.col("_mark").alias("_m"),
            F.regexp_extract("_plain", r"[^ ]+\z", 0).alias("_family"),
        ).agg(
            *ends("any", F.lit(True)), *ends("f", F.col("sex") == "f"), *ends("m", F.col("sex") == "m")
        )

        def only(name: str) -> Column:
            return F.when(F.col(f"{name}_low") == F.col(f"{name}_high"), F.col(f"{name}_low"))

        one = F.when(~titled, only("any")).when(sex == "f", only("f")).otherwise(only("m"))
        same = F.expr("_id <=> _i and _mark = _m and _plain = _family and kind = 'person'")
        return found.join(by_family, same, "left").select(
            *found.columns, F.coalesce(one, "_plain").alias("canon")
        )

    def attempts(self) -> DataFrame:
        """``kind, canon, sex, attempt`` for each entity, such that surrogates are distinct and
        none is another entity's real value."""
        # The plainest writing of an entity stands for all, and that of its family name alone for
        # all of these; a title gives its gender.
        plain = F.col("canon") == F.col("_plain")
        found = saved(
            self.entities.groupBy("kind", "canon")
            .agg(
                F.array_compact(
                    F.array(
                        F.min(F.when(plain, F.col("_match"))),
                        F.min(F.when(~plain, F.col("_match"))),
                    )
                ).alias("forms"),
                F.min(gender(F.col("_match"))).alias("sex"),
            )
            .withColumn("attempt", F.lit(0))
        )
        real = self.entities.select(F.col("kind").alias("k"), F.col("_plain").alias("c")).distinct()
        again = True
        while again:
            each = found.withColumn("form", F.explode("forms"))
            made = with_surrogate(each, "form", self.key, "_made").withColumn(
                "other", canonical(F.col("kind"), F.col("_made"))
            )
            first = Window.partitionBy("kind", "other").orderBy("attempt", "canon")
            checked = (
                made.withColumn("turn", F.row_number().over(first))
                .join(real, F.expr("kind = k and other = c"), "left")
                .withColumn("bad", F.expr("turn > 1 or c is not null"))
            )
            found = saved(
                checked.groupBy("kind", "canon", "forms", "sex", "attempt")
                .agg(F.max("bad").alias("bad"))
                .withColumn("attempt", F.expr("attempt + if(bad, 1, 0)"))
            )
            again = not found.where("bad").isEmpty()
            found = found.drop("bad")
        return found.select("kind", "canon", "sex", "attempt")

    def replaced(self) -> DataFrame:
        """The rows of ``docs`` with surrogates in their texts, and ``_entities``: an array of
        ``place, kind, surrogate`` in the order of the text."""
        known = self.attempts()
        by_text = (
            with_surrogate(self.entities.join(known, ["kind", "canon"]), "_match", self.key, "_new")
            .groupBy("_id", "_mark")
            .agg(
                F.sort_array(
                    F.collect_list(
                        F.struct(
                            F.col("_place").alias("place"), "kind", F.col("_new").alias("surrogate")
                        )
                    )
                ).alias("_entities")
            )
            .select(F.col("_id").alias("_i"), F.col("_mark").alias("_m"), "_entities")
        )
        gaps = F.split(F.col("_text"), F.col("_pattern"), -1)
        new = F.concat(
            F.transform(F.col("_entities"), lambda e: e["surrogate"]), F.array(F.lit(""))
        )
        text = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, s: F.array(g, s))), "")
        columns = [
            F.when(F.col("_entities").isNull(), F.col("_text")).otherwise(text).alias(c)
            if c == self.text
            else F.col(f"_row.`{c}`").alias(c)
            for c in self.docs.columns
        ]
        # Rows that may have entities are found without an exchange and without looking at the
        # texts again; the others stay as they are.
        flagged = bucket_flag(self.rows.drop("_names"), self.entities, ["_id", "_mark"], "_has")
        empty = F.array().cast(by_text.schema["_entities"].dataType)
        doubtful = flagged.where("_has").join(by_text, F.expr("_id <=> _i and _mark = _m"), "left")
        same = flagged.where("not _has").select("_row.*", empty.alias("_entities"))
        changed = doubtful.select(*columns, F.coalesce("_entities", empty).alias("_entities"))
        return same.union(changed)
