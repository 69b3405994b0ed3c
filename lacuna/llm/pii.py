"""PII surrogates with DataFrame functions only.

Entities (addresses of mail, IP addresses, card, phone, account (IBAN) and social
security numbers, titled names) get a replacement that a key and the entity
decide. What counts as one entity is a unit: a mail address whatever its case,
the national digits of a phone number (ten at most) and the digits of a card or
account whatever their separators and country code, and each word of a name with
its gender, so that "Mr. Karl Braun" and "Mr Braun" share a surname afterwards
too, and "Mrs Braun" has the same one but for its end. Words of a titled name are
replaced wherever the same document has them without a title, by the unit that
came first.
Each mention keeps its own format: separators, country code, case, title;
letters keep their script (Latin, Cyrillic, Greek; others become Latin), IP
octets stay below 256, a card number that passes the Luhn check still does, an
account number has valid check digits, and words of a name are pronounceable and
end by gender (after Dr or Prof alone by neither).

Collision check: distinct units whose replacements coincide with each other, or
with a unit of the corpus, are drawn again with a higher attempt, until none
coincide. Only those few units are joined back to their documents.

Cases: null texts stay null, empty texts empty; repeated rows get equal
replacements; an empty table gives an empty result; other columns are kept, and
those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Attempts that a written table of exceptions may be broadcast with, in rows.
BROADCAST_ROWS = 10_000
# Java matches repeated groups by recursion, so that a text can overflow the stack: only classes are repeated without a small bound
#: A domain has 253 characters at most and its last label 63, as in the DNS.
#: A local part begins where no other character of its kind stands before, and is taken at once.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-][A-Za-z0-9.-]{0,252}(?<!\.)\.[A-Za-z]{2,63}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d])"
CARD = r"(?<![0-9A-Za-z])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![0-9A-Za-z])"
#: Ten national digits in groups of 3, 3 and 4, or any number that begins with + and a country code.
PHONE = r"(?<![0-9A-Za-z])(?:(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])"
TITLES_M, TITLES_F, TITLES_N = "Mr|Herr|Monsieur|Señor|Г-н", "Mrs|Ms|Miss|Frau|Madame|Señora|Г-жа", "Dr|Prof|Doctor|Professor"
TITLE = rf"(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? "
WORD = r"\p{Lu}\p{Ll}{1,40}(?:-\p{Lu}\p{Ll}{1,40}){0,2}"
NAME = rf"(?<!\p{{L}})(?:{TITLE}){{1,2}}{WORD}(?: {WORD}){{0,2}}"
CARD_ = CARD.replace("([ -]?)", "(?<sep>[ -]?)").replace(r"\1", r"\k<sep>")
ANY = f"(?:{MAIL}|{IP}|{IBAN}|{CARD_}|{SSN}|{PHONE}|{NAME})"
KINDS = ("email", "ip", "card", "phone", "name", "iban", "ssn")
_SETS = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"))
#: Consonants, vowels and the endings of female and male names, by script; the last serves all others.
SCRIPTS = ((r"\p{IsCyrillic}", "бвгджзклмнпрстфхцчш", "аеиоуэюя", "а", "о"), (r"\p{IsGreek}", "βγδζθκλμνξπρστφχψ", "αεηιουω", "α", "ο"), (r"\p{L}", "bcdfghjklmnprstvz", "aeiou", "a", "o"))


def kind_of(e: Column) -> Column:
    digits = F.length(F.regexp_replace(e, r"\D", ""))
    plain = F.when(e.contains("@"), "email").when(e.rlike(rf"^{IP}$"), "ip").when(e.rlike(rf"^{IBAN}$"), "iban").when(e.rlike(rf"^{SSN}$"), "ssn")
    return plain.when(e.rlike(r"^\p{L}"), "name").when((digits == 16) & ~e.startswith("+"), "card").otherwise("phone")


def _number(mentions: str, kind: str) -> Column:
    return F.size(F.filter(mentions, lambda z: z["kind"] == kind)).cast("long")


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(held: str, h: Column, i: Column) -> Column:
    return F.substr(F.lit(held), (_byte(h, i) + _byte(h, i + 13) * 7) % len(held) + 1, F.lit(1))


def _first(choices: list[tuple[Column, Column]], other: Column) -> Column:
    out = F.when(*choices[0])
    for c, v in choices[1:]:
        out = out.when(c, v)
    return out.otherwise(other)


def _redrawn(text: Column, h: Column) -> Column:
    """Each digit and lower-case letter by one of its own kind; what else there is stays."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _first([(c.rlike(f"^{p}$"), _pick(held, h, i)) for p, held in _SETS], c)), "")


def _word(word: Column, h: Column, gender: Column) -> Column:
    """Consonants and vowels in turn, in the word's script, ending by gender."""

    def one(c: Column, i: Column) -> Column:
        drawn = _first([(c.rlike(f"^{p}$"), F.when(i % 2 == 0, _pick(hard, h, i)).otherwise(_pick(soft, h, i))) for p, hard, soft, _, _ in SCRIPTS], c)
        return F.when(c.rlike(r"^\p{Lu}$"), F.upper(drawn)).otherwise(drawn)

    last = F.substring(word, -1, 1)
    end = _first([(last.rlike(f"^{p}$"), F.when(gender == "f", f).when(gender == "m", m).otherwise(_pick(soft, h, F.lit(30)))) for p, _, soft, f, m in SCRIPTS], last)
    return F.concat(F.array_join(F.transform(F.split(F.substr(word, F.lit(1), F.length(word) - 1), ""), one), ""), end)


def _luhn_sum(digits: Column) -> Column:
    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _national(e: Column) -> Column:
    """The digits of a phone number after its country code, where that is told apart; ten at most."""
    return F.substring(_digits(F.regexp_replace(e, r"^\+\d{1,3}[ .(-]", "")), -10, 10)


def _bare(e: Column) -> Column:
    """A name without its titles."""
    return F.regexp_replace(e, rf"^(?:{TITLE}){{1,2}}", "")


def _words(e: Column) -> Column:
    """The words of a titled name, as units."""
    gender = F.when(e.rlike(rf"^(?:{TITLE})?(?:{TITLES_F})\.? "), "f|").when(e.rlike(rf"^(?:{TITLE})?(?:{TITLES_M})\.? "), "m|").otherwise("n|")
    return F.transform(F.split(_bare(e), "[ -]"), lambda w: F.concat(gender, w))


def with_kinds(mentions: Column) -> Column:
    """(e, kind) of each mention: expressions below read the kind instead of repeating how it is told."""
    return F.transform(mentions, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))


def units(e: Column, kind: Column) -> Column:
    """What a mention stands for, whatever its format."""
    one = F.when(kind == "email", F.lower(e)).when(kind == "card", _digits(e)).when(kind == "phone", _national(e)).when(kind == "iban", F.concat(F.lit("I|"), F.replace(e, F.lit(" "), F.lit("")))).when(kind == "ssn", F.concat(F.lit("S|"), _digits(e))).otherwise(e)
    return F.when(kind == "name", _words(e)).otherwise(F.array(one))


def _mod97(text: Column) -> Column:
    """The remainder of an account number's digits, letters counting from A = 10."""
    digit = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), digit), F.lit(0), lambda r, d: (r * F.when(d > 9, 100).otherwise(10) + d) % 97)


def surrogate(unit: Column, key: str, attempt: Column) -> Column:
    """The unit that takes the unit's place."""
    name_unit = unit.rlike("^[fmn][|]")
    # a surname is one for all genders, but for its end
    h = F.sha2(F.concat_ws("|", F.lit(key), attempt.cast("string"), F.when(name_unit, F.substr(unit, F.lit(3), F.length(unit))).otherwise(unit)), 256)
    local, domain = F.substring_index(unit, "@", 1), F.substring_index(unit, "@", -1)
    label = F.substring_index(domain, ".", 1)
    # crowded short addresses and names get longer ones
    crowded = attempt >= 4
    more = F.when(crowded, F.substr(h, F.lit(50), F.lit(8))).otherwise(F.lit(""))
    mail = F.concat(_redrawn(local, h), more, F.lit("@"), _redrawn(label, F.reverse(h)), F.substr(domain, F.length(label) + 1, F.length(domain)))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _byte(h, i).cast("string")), ".")
    moved = _redrawn(unit, h)
    check = (10 - _luhn_sum(F.concat(F.substr(moved, F.lit(1), F.lit(15)), F.lit("0"))) % 10) % 10
    card = F.when((_luhn_sum(unit) % 10) == 0, F.concat(F.substr(moved, F.lit(1), F.lit(15)), check.cast("string"))).otherwise(moved)
    word = F.substr(unit, F.lit(3), F.length(unit))
    word = F.concat(word, F.when(crowded, F.repeat(F.substring(word, -1, 1), F.lit(6))).otherwise(F.lit("")))
    name = F.concat(F.substring(unit, 1, 2), _word(word, h, F.substring(unit, 1, 1)))
    country, body = F.substring(unit, 3, 2), F.upper(_redrawn(F.lower(F.substr(unit, F.lit(7), F.length(unit))), h))
    account = F.concat(F.lit("I|"), country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)
    social = F.concat(F.lit("S|"), _redrawn(F.substr(unit, F.lit(3), F.length(unit)), h))
    return F.when(unit.contains("@"), mail).when(name_unit, name).when(unit.startswith("I|"), account).when(unit.startswith("S|"), social).when(unit.rlike("^[0-9]{16}$"), card).when(unit.contains("."), ip).otherwise(moved)


def _render(e: Column, kind: Column, new: Column, one: Column) -> Column:
    """The mention with its units replaced by those of ``new``, in the format of the mention; ``one`` is the first without its mark."""
    was = F.split(e, "")
    mail = F.array_join(F.transform(F.split(one, ""), lambda c, i: F.when(F.get(was, i).rlike("^[A-Z]$"), F.upper(c)).otherwise(c)), "")

    def digit(c: Column, i: Column) -> Column:
        at = F.length(one) - F.length(_digits(F.substr(e, i + 1, F.length(e))))  # counted from the right: a country code stays
        return F.when(c.rlike("^[0-9]$") & (at >= 0), F.substr(one, at + 1, F.lit(1))).otherwise(c)

    number = F.array_join(F.transform(was, digit), "")
    account = F.array_join(F.transform(was, lambda c, i: F.when(c == " ", c).otherwise(F.substr(one, F.length(F.replace(F.substr(e, F.lit(1), i), F.lit(" "), F.lit(""))) + 1, F.lit(1)))), "")
    between = F.concat(F.array(F.lit("")), F.regexp_extract_all(_bare(e), F.lit("([ -])"), F.lit(1)))
    name = F.concat(F.regexp_extract(e, rf"^(?:{TITLE}){{0,2}}", 0), F.array_join(F.zip_with(between, new, lambda b, u: F.concat(b, F.substr(u, F.lit(3), F.length(u)))), ""))
    return F.when(kind == "email", mail).when(kind == "name", name).when(kind == "ip", one).when(kind == "iban", account).otherwise(number)


def _free(name: str, columns: list[str]) -> str:
    """The name, longer where a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def exceptions(found: DataFrame, key: str) -> DataFrame | None:
    """(entity, attempt) for the units whose first surrogates coincide; None where there are none."""
    todo = materialize(found.select("entity", F.lit(0).alias("attempt"), surrogate(F.col("entity"), key, F.lit(0)).alias("to")), "surrogates")
    real = todo.select(F.col("entity").alias("to"), F.lit("").alias("first"))
    moved = False
    while True:
        first = todo.groupBy("to").agg(F.min("entity").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("to", "first").union(real.join(todo.select("to").distinct(), "to", "left_semi"))
        again = materialize(todo.join(first, "to").where("entity <> first").select("entity", (F.col("attempt") + 1).alias("attempt")).distinct(), "again")
        if again.isEmpty():
            return todo.where("attempt > 0").select("entity", "attempt") if moved else None
        moved = True
        kept = todo.join(again.select("entity"), "entity", "left_anti")
        todo = materialize(kept.unionByName(again.withColumn("to", surrogate(F.col("entity"), key, F.col("attempt")))), "surrogates")


def pseudonymise(docs: DataFrame, key: str = "surrogates", text_col: str = "text") -> DataFrame:
    """docs with their entities replaced in ``text_col``, and n_<kind> of each kind."""
    docs = docs.drop(*[f"n_{k}" for k in KINDS]).withColumn(text_col, F.col(text_col).cast("string"))
    titled = F.regexp_extract_all(F.col(text_col), F.lit(f"({ANY})"), F.lit(1))
    exc_, tid_, ents, named_ = (_free(x, docs.columns) for x in ("__exc", "__tid", "__e", "__named"))
    known = with_kinds(titled)
    meant = F.flatten(F.transform(known, lambda z: units(z["e"], z["kind"])))
    distinct = docs.select(F.explode(F.array_distinct(meant)).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    exc = exceptions(distinct.select("entity"), key)
    none = F.lit(None).cast("map<string,int>")
    if exc is None:
        marked = docs.withColumn(exc_, none)
    else:
        tid = F.xxhash64(F.col(text_col), F.length(text_col))
        small = exc.count() <= BROADCAST_ROWS
        hit = docs.select(tid.alias(tid_), F.explode(F.array_distinct(meant)).alias("entity")).join(F.broadcast(exc) if small else exc, "entity").distinct()
        maps = hit.groupBy(tid_).agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias(exc_))
        touched = maps.count()
        marked = docs.withColumn(tid_, tid).join(F.broadcast(maps) if touched <= BROADCAST_ROWS else maps, tid_, "left").drop(tid_)
    # the words of a document's titled names, those of longer names first, and a pattern that finds them without a title
    none = F.array().cast("array<struct<e:string,kind:string>>")
    marked = marked.withColumn(ents, F.coalesce(known, none))
    of_names = F.transform(F.filter(F.col(ents), lambda z: z["kind"] == "name"), lambda z: _words(z["e"]))
    named = F.array_distinct(F.flatten(F.concat(F.filter(of_names, lambda u: F.size(u) > 1), F.filter(of_names, lambda u: F.size(u) == 1))))
    marked = marked.withColumn(named_, named)
    words = F.array_distinct(F.transform(named_, lambda u: F.substr(u, F.lit(3), F.length(u))))
    pattern = F.when(F.size(named_) == 0, F.lit(ANY)).otherwise(F.concat(F.lit(f"(?:{ANY}|(?<!\\p{{L}})(?:"), F.array_join(words, "|"), F.lit(r")(?!\p{L}))")))
    found = F.regexp_extract_all(F.col(text_col), F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
    marked = marked.withColumn(ents, F.when(F.size(named_) > 0, with_kinds(found)).otherwise(F.col(ents)))
    attempt = lambda u: F.coalesce(F.element_at(F.col(exc_), u), F.lit(0))
    gaps = F.split(F.col(text_col), pattern, -1)

    def here(e: Column, kind: Column) -> Column:
        """The units of a mention; a single word without a title is the document's first unit of that word."""
        same = F.filter(F.col(named_), lambda u: F.substr(u, F.lit(3), F.length(u)) == e)
        return F.when((kind == "name") & ~e.rlike(rf"^{TITLE}") & (F.size(same) > 0), F.slice(same, 1, 1)).otherwise(units(e, kind))

    # step by step, so that each expression stands in the plan once
    meant_here = F.transform(ents, lambda z: F.struct(z["e"].alias("e"), z["kind"].alias("kind"), here(z["e"], z["kind"]).alias("u")))
    changed = F.transform(meant_here, lambda z: F.struct(z["e"].alias("e"), z["kind"].alias("kind"), F.transform(z["u"], lambda u: surrogate(u, key, attempt(u))).alias("new")))
    first = F.transform(changed, lambda z: F.struct(z["e"].alias("e"), z["kind"].alias("kind"), z["new"].alias("new"), F.when(z["kind"].isin("iban", "ssn"), F.substr(z["new"][0], F.lit(3), F.length(z["new"][0]))).otherwise(z["new"][0]).alias("one")))
    new = F.transform(first, lambda z: _render(z["e"], z["kind"], z["new"], z["one"]))
    filled = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), new.alias("s")), lambda z: F.concat(F.coalesce(z["g"], F.lit("")), F.coalesce(z["s"], F.lit("")))), "")
    counts = {f"n_{k}": _number(ents, k) for k in KINDS}
    cells = [(F.when(F.size(ents) > 0, filled).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns]
    return marked.select(*cells, *[v.alias(n) for n, v in counts.items()])


def op3_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "text")
