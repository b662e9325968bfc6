"""Keyed surrogates for personal data, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import whole_text
from sievemark.session import materialize

KEY = "sievemark-surrogates"
ROUNDS = 200

# Titles that announce a person's name, by the gender they tell.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Mme", "Mlle", "Madame", "Frau", "Señora", "Sra", "Signora", "госпожа", "г-жа")
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин", "г-н")
NEUTRAL = ("Dr", "Prof")
PARTICLES = tuple("af al av bin da das de dei del della den der di do dos du e el ibn la las le los ten ter van von y zu zum zur фон".split())
SECRET_WORDS = ("password", "passwd", "token", "secret", "api_key", "apikey")

_TITLES = "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True))
_SECRET = f"(?i:{'|'.join(SECRET_WORDS)}) {{0,2}}[=:] {{0,2}}[\"']?"
_NAME_LEAD = rf"(?:(?:{_TITLES})\.? )+"
# Beginnings of access tokens, and the lines around a private key.
_TOKEN_LEAD = "AKIA|gh[pousr]_|github_pat_|glpat-|sk_live_|xox[abp]-"
_KEY_LINE = "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
# ASCII first, as it is told apart fast; scripts written without spaces do not tell where an address begins.
_ADDRESS = r"A-Za-z0-9[\p{L}\p{M}\d&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]"
# A name's word, without the s of a genitive, or initials.
_WORD = r"(?:\p{Lu}(?:(?:['’](?!s(?![\p{L}\p{M}]))|-)?[\p{L}\p{M}])+|\p{Lu}\.(?:-?\p{Lu}\.)*|\p{Lu}(?= \p{Lu}))"
_INITIALS = r"^\p{Lu}(?:\.(?:-?\p{Lu}\.)*)?$"
PATTERN = "|".join((
    rf"(?<![\p{{L}}\d]){_SECRET}[A-Za-z0-9+/_=.-]{{8,}}",
    rf"(?<![._%+\-{_ADDRESS}])[._%+\-{_ADDRESS}]++@[\-{_ADDRESS}]+(?:\.[\-{_ADDRESS}]+)+",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])(?:gh[pousr]_|github_pat_|glpat-|sk_live_|xox[abp]-)[A-Za-z0-9_-]{16,}",
    rf"{_KEY_LINE}[A-Za-z0-9+/=\s]+(?=-----END)",
    # An account number of 15 to 34 signs in groups of four, with a digit after the bank's letters.
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2} ?[A-Z]{0,4} ?\d)(?=[A-Z0-9](?: ?[A-Z0-9]){14,33}(?![A-Za-z0-9]))[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![:.\w])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![:\w])",
    r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    r"(?<![\p{L}\d.+-])\d(?:[ -]?\d){12,18}(?![\p{L}\d])",
    r"\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    r"(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    rf"(?<!\p{{L}}){_NAME_LEAD}(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_WORD})*+",
))

TITLED = rf"(?<!\p{{L}}){_NAME_LEAD}\p{{L}}"

# What every match of the pattern has one of; told apart in a fraction of the pattern's time.
_SIGNS = (
    "@", "AKIA", "PRIVATE KEY-----", "::", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "xoxa-", "xoxb-", "xoxp-",
    *(t for t in (*FEMALE, *MALE, *NEUTRAL) if not any(t != u and t.startswith(u) for u in (*FEMALE, *MALE, *NEUTRAL))),
)
_FIGURES = r"[0-9](?:[ .()-]{0,3}[0-9]){3}|[A-Z]{2}[0-9]{2}|:[0-9A-Fa-f]{1,4}:"

DIGITS_ONLY = ("card", "phone", "number")
NAMES = ("first", "surname")
# Parts of names that identify nobody by themselves: particles stay, initials are redrawn without regard to others.
LOOSE = ("particle", "initial")


def suspect(text: Column) -> Column:
    """False only where the pattern matches nothing."""
    lowered = F.lower(text)
    tests = [text.contains(s) for s in _SIGNS] + [lowered.contains(w) for w in SECRET_WORDS] + [text.rlike(_FIGURES)]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(found: Column) -> Column:
    return (
        F.when(found.rlike(f"^(?:{_SECRET}|{_KEY_LINE})"), "secret").when(found.contains("@"), "email").when(found.rlike(f"^(?:{_TOKEN_LEAD})"), "key")
        .when(found.rlike(r"^[A-Z]{2}\d{2} ?[A-Z0-9]"), "account").when(found.rlike(r"^[0-9A-Fa-f]{1,4}:"), "ip6")
        .when(found.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip").when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "number")
        .when(found.rlike(r"^\d{3}-\d{3}-\d{4}$") | found.rlike(r"^[+(]"), "phone").when(found.rlike(r"^\d"), "card").otherwise("name")
    )


def lead_of(kind: Column, found: Column) -> Column:
    """The part of a detected entity that stays: the word before a secret, a title, a country code, a key's prefix."""
    return (
        F.when(kind == "secret", F.regexp_extract(found, f"^({_SECRET}|{_KEY_LINE})", 1)).when(kind == "name", F.regexp_extract(found, f"^({_NAME_LEAD})", 1))
        .when(kind == "key", F.regexp_extract(found, f"^({_TOKEN_LEAD})", 1)).when(kind == "phone", F.regexp_extract(found, r"^(\+\d{1,3}[ .-])", 1)).otherwise("")
    )


def parts_of(found: Column) -> Column:
    """(lead, parts) of a detected entity; each part has a kind, its text and the value that identifies it.

    A name's last word is a surname; words before it are first names, with the
    gender the title tells. Spelling of letter case, and separators between
    digits, do not identify.
    """

    def build(kind: Column, lead: Column) -> Column:
        rest = F.substring(found, F.length(lead) + 1, F.length(found))
        gender = F.when(lead.rlike(rf"(?:^| )(?:{'|'.join(FEMALE)})[. ]"), "f").when(lead.rlike(rf"(?:^| )(?:{'|'.join(MALE)})[. ]"), "m").otherwise("u")
        words = F.when(kind == "name", F.split(rest, " ")).otherwise(F.array(rest))

        def part(word: Column, at: Column, n: Column) -> Column:
            own = (
                F.when(kind != "name", kind).when(word.isin(*PARTICLES), "particle").when(word.rlike(_INITIALS), "initial")
                .when(at == n - 1, "surname").otherwise("first")
            )
            value = (
                F.when(kind.isin(*DIGITS_ONLY), F.regexp_replace(word, r"\D", "")).when(kind == "account", F.replace(word, F.lit(" ")))
                .when(kind.isin("email", "name", "ip6"), F.lower(word)).otherwise(word)
            )
            told = F.when(own == "first", gender).otherwise("u")
            return F.struct(own.alias("kind"), word.alias("text"), value.alias("value"), told.alias("gender"))

        parts = let(words, lambda w: F.transform(w, lambda word, at: part(word, at, F.size(w))))
        return F.struct(lead.alias("lead"), parts.alias("parts"))

    return let(kind_of(found), lambda kind: let(lead_of(kind, found), lambda lead: build(kind, lead)))


def found_in(text: Column, pattern: Column | None = None) -> Column:
    """All detected entities of a text, in order, as they stand there."""
    found = F.regexp_extract_all(text, F.lit(PATTERN) if pattern is None else pattern, F.lit(0))
    return F.when(suspect(text), found).otherwise(F.array().cast("array<string>"))


def entities_of(text: Column) -> Column:
    """All detected entities of a text, in order, as an array of (lead, parts)."""
    return F.transform(found_in(text), parts_of)


def name_parts(entities: Column) -> Column:
    """The parts of all titled names among the entities of a text."""
    parts = F.flatten(F.transform(entities, lambda e: e["parts"]))
    return F.filter(parts, lambda p: p["kind"].isin(*NAMES))


def repeats_of(text: Column, entities: Column) -> Column:
    """Spellings under which the titled names of a text may stand again without a title, the longest first.

    These are the whole name and each of its words, as written or in capitals,
    but no word that the text, outside of detected entities, also has in lower case.
    """
    named = F.filter(entities, lambda e: F.exists(e["parts"], lambda p: p["kind"].isin(*NAMES)))
    whole = F.transform(named, lambda e: F.array_join(F.transform(e["parts"], lambda p: p["text"]), " "))
    common = F.split(F.regexp_replace(text, PATTERN, " "), r"[^\p{L}\p{M}'’-]+")
    words = let(common, lambda seen: F.filter(
        F.transform(name_parts(entities), lambda p: p["text"]), lambda w: (F.length(w) > 1) & ~F.array_contains(seen, F.lower(w))
    ))
    # A whole name of one word is judged as a word.
    spelled = F.concat(F.filter(whole, lambda w: w.contains(" ")), words)
    both = F.array_distinct(F.concat(spelled, F.transform(spelled, F.upper)))
    order = lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).otherwise(0)
    return F.when(F.size(named) > 0, F.array_sort(both, order)).otherwise(F.array().cast("array<string>"))


def repeated_parts(found: Column, known: Column) -> Column:
    """(lead, parts) of a repeat: its words by the parts of titled names."""

    def part(word: Column) -> Column:
        as_known = F.get(F.filter(known, lambda p: p["value"] == F.lower(word)), F.lit(0))
        loose = F.when(F.lower(word).isin(*PARTICLES), "particle").otherwise("initial")
        return F.struct(
            F.coalesce(as_known["kind"], loose).alias("kind"),
            word.alias("text"), F.lower(word).alias("value"),
            F.coalesce(as_known["gender"], F.lit("u")).alias("gender"),
        )

    return F.struct(F.lit("").alias("lead"), F.transform(F.split(found, " "), part).alias("parts"))


# --- one surrogate ------------------------------------------------------------------------------------------------


def _number(stream: Column, at: Column | int, below: Column | int) -> Column:
    """The keyed number number ``at`` (from 0), below a bound."""
    place = F.pmod(F.lit(at) if isinstance(at, int) else at, F.lit(60)) * 2 + 1
    return F.pmod(F.conv(F.substring(stream, place, F.lit(4)), 16, 10).cast("int"), F.lit(below) if isinstance(below, int) else below)


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number + 1, F.lit(1))


def _like(char: Column, stream: Column, at: Column) -> Column:
    """A character of the same class; marks stay."""
    code = F.ascii(char)
    number = lambda n: _number(stream, at, n)
    return (
        F.when(code.between(48, 57), number(10).cast("string")).when(code.between(97, 122), _pick("abcdefghijklmnopqrstuvwxyz", number(26)))
        .when(code.between(65, 90), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", number(26))).when(code < 128, char)
        .when(char.rlike(r"^\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшщыэюя", number(29)))
        .when(char.rlike(r"^\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", number(24)))
        .when(char.rlike(r"^\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", number(26))).otherwise(char)
    )


def _chars(value: Column, change: Callable[[Column, Column], Column]) -> Column:
    """``value`` with each character changed by itself and its place, from 0."""
    places = F.sequence(F.lit(0), F.greatest(F.length(value) - 1, F.lit(0)))
    return F.array_join(F.transform(places, lambda i: change(F.substring(value, i + 1, F.lit(1)), i)), "")


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum that is a multiple of ten for a valid card number."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(value: Column, stream: Column) -> Column:
    n = F.length(value)
    drawn = _chars(value, lambda c, i: F.when(i == 0, c).when(i == n - 1, "0").otherwise(_number(stream, i, 10).cast("string")))
    valid = F.pmod(luhn_sum(value), F.lit(10)) == 0

    def finish(d: Column) -> Column:
        check = F.pmod(-luhn_sum(d), F.lit(10))
        last = F.when(valid, check).otherwise(F.pmod(check + 1 + _number(stream, 59, 9), F.lit(10)))
        return F.concat(F.substring(d, F.lit(1), n - 1), last.cast("string"))

    return let(drawn, finish)


def mod97(signs: Column) -> Column:
    """Remainder by 97 of digits and letters, a letter standing for two digits from 10."""

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(signs, i, F.lit(1)))
        return F.pmod(F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55), F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(signs)), F.lit(0), add)


def _account(value: Column, stream: Column) -> Column:
    """The same country, signs of the same class, and check digits that are right where the value's are."""
    country, rest = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    valid = mod97(F.concat(rest, F.substring(value, 1, 4))) == 1

    def finish(drawn: Column) -> Column:
        check = F.lit(98) - mod97(F.concat(drawn, country, F.lit("00")))
        wrong = F.pmod(check - 2 + 1 + _number(stream, 59, 95), F.lit(97)) + 2
        return F.concat(country, F.lpad(F.when(valid, check).otherwise(wrong).cast("string"), 2, "0"), drawn)

    return let(_chars(rest, lambda c, i: _like(c, stream, i)), finish)


def _name(value: Column, kind: Column, stream: Column, attempt: Column, gender: Column) -> Column:
    """A pronounceable name in the value's script with an ending of its gender; longer after many attempts."""

    def spelled(consonants: str, vowels: str, male: tuple[str, ...], female: tuple[str, ...], family: tuple[str, ...]) -> Column:
        syllables = F.sequence(F.lit(0), F.lit(2) + F.floor(attempt / 4).cast("int"))
        body = F.array_join(F.transform(syllables, lambda i: F.concat(
            _pick(consonants, _number(stream, i * 2, len(consonants))), _pick(vowels, _number(stream, i * 2 + 1, len(vowels)))
        )), "")
        end = lambda options: F.element_at(F.array(*[F.lit(o) for o in options]), _number(stream, 58, len(options)) + 1)
        ending = F.when(kind == "surname", end(family)).when(gender == "f", end(female)).otherwise(end(male))
        return F.concat(body, ending)

    return (
        F.when(value.rlike(r"^\p{IsCyrillic}"), spelled("бвгдзклмнпрст", "аеио", ("н", "р", "с"), ("на", "ла", "ша"), ("ев", "ин", "ко")))
        .when(value.rlike(r"^\p{IsGreek}"), spelled("βγδκλμνπρστ", "αεο", ("ης", "ος"), ("α", "η"), ("ακης", "ιδης")))
        .otherwise(spelled("bdfgklmnprstv", "aeiou", ("n", "r", "s"), ("na", "la", "sa"), ("ner", "man", "sen")))
    )


def surrogate(kind: Column, value: Column, attempt: Column, key: str = KEY, gender: Column | None = None) -> Column:
    """The replacement of an identifying value: a keyed hash of kind, value and attempt, spelled in the value's format."""
    message = F.concat_ws("\u0001", kind, attempt.cast("string"), value)
    digest = F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), message), 256)), 512)

    def spell(stream: Column) -> Column:
        domain_end = F.length(value) - F.length(F.substring_index(value, ".", -1))
        email = _chars(value, lambda c, i: F.when(i >= domain_end, c).otherwise(_like(c, stream, i)))
        ip = F.concat_ws(".", *[(_number(stream, k, 254) + 1).cast("string") for k in range(4)])
        digits = _chars(value, lambda c, i: F.when(i == 0, (_number(stream, i, 8) + 2).cast("string")).otherwise(_number(stream, i, 10).cast("string")))
        groups = _chars(value, lambda c, i: F.when(c == ":", c).otherwise(_pick("123456789abcdef", _number(stream, i, 15))))
        hexadecimal = _chars(value, lambda c, i: _pick("0123456789abcdef", _number(stream, i, 16)))
        same_class = _chars(value, lambda c, i: _like(c, stream, i))
        return (
            F.when(kind == "email", email).when(kind == "account", _account(value, stream)).when(kind == "ip6", groups).when(kind == "ip", ip).when(kind == "card", _card(value, stream)).when(kind.isin("phone", "number"), digits)
            .when(kind.isin(*NAMES), _name(value, kind, stream, attempt, F.lit("u") if gender is None else gender))
            .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), hexadecimal).otherwise(same_class)
        )

    return let(digest, spell)


def in_form_of(kind: Column, text: Column, spelled: Column) -> Column:
    """A surrogate in the written form of the text it replaces: its separators, or its letter case."""

    def laid(spelled: Column) -> Column:
        def lay(acc: Column, char: Column) -> Column:
            is_digit = F.when(kind == "account", char != " ").otherwise(F.ascii(char).between(48, 57))
            out = F.concat(acc["out"], F.when(is_digit, F.substring(spelled, acc["k"], F.lit(1))).otherwise(char))
            return F.struct(out.alias("out"), (acc["k"] + is_digit.cast("int")).alias("k"))

        digits = F.when(text.rlike(r"^\d+$"), spelled).otherwise(
            F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), lay, lambda acc: acc["out"])
        )
        initial = F.when(F.upper(text) == text, F.upper(spelled)).otherwise(spelled)
        name = F.when((F.length(text) > 1) & (F.upper(text) == text), F.upper(spelled)).otherwise(F.initcap(spelled))
        email = F.when(F.lower(text) == text, spelled).when(F.upper(text) == text, F.upper(spelled)).otherwise(
            _chars(spelled, lambda c, i: let(F.substring(text, i + 1, F.lit(1)), lambda t: F.when(F.lower(t) != t, F.upper(c)).otherwise(c)))
        )
        return F.when(kind.isin(*DIGITS_ONLY, "account"), digits).when(kind == "ip6", initial).when(kind.isin(*NAMES), name).when(kind == "email", email).when(kind == "initial", initial).otherwise(spelled)

    # Named once: the whole spelling in every branch made a plan of 14,000 calls, which the driver copies in each rule.
    return let(spelled, laid)


# --- the corpus ---------------------------------------------------------------------------------------------------


def assign(values: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, attempt, spelled) for every distinct (kind, value).

    A drawn surrogate is kept if no value of the corpus of its kind equals it,
    no earlier round gave it away, and, of the values that drew it at once, it
    goes to the first; the others draw again under the next attempt. Distinct
    values therefore get distinct surrogates, none of which is a real value.
    """
    known = materialize(values if "gender" in values.columns else values.withColumn("gender", F.lit("u")), "values")
    taken = known.select("kind", F.col("value").alias("spelled"))
    waiting = known.withColumn("attempt", F.lit(0))
    given: list[DataFrame] = []
    for _ in range(rounds):
        drawn = materialize(waiting.withColumn("spelled", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key, F.col("gender"))), "drawn")
        winners = drawn.groupBy("kind", "spelled").agg(F.min("value").alias("value")).join(taken, ["kind", "spelled"], "left_anti")
        kept = materialize(drawn.join(winners, ["kind", "spelled", "value"]).select("kind", "value", "attempt", "spelled"), "given")
        given.append(kept)
        waiting = materialize(
            drawn.join(kept, ["kind", "value"], "left_anti").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt")), "waiting"
        )
        if waiting.isEmpty():
            break
        taken = taken.unionByName(kept.select("kind", "spelled"))
    else:
        raise RuntimeError("some kinds have more values than surrogates")
    out = given[0]
    for more in given[1:]:
        out = out.unionByName(more)
    return out


def distinct_values(docs: DataFrame) -> DataFrame:
    """(kind, value, mentions, gender, mixed) of the corpus; a first name's gender is the one most of its titles tell."""
    found = docs.select(F.explode(entities_of(whole_text())).alias("e")).select(F.explode("e.parts").alias("p")).filter(~F.col("p.kind").isin(*LOOSE))
    told = F.when(F.col("p.gender") == "f", 1).when(F.col("p.gender") == "m", -1).otherwise(0)
    lean = F.sum(told)
    return found.groupBy(F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).agg(
        F.count("*").alias("mentions"), F.when(lean > 0, "f").when(lean < 0, "m").otherwise("u").alias("gender"),
        (F.min(told) != F.max(told)).alias("mixed"),
    )


def replace(docs: DataFrame, key: str = KEY, counter: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text; ``n_chars``, where present, follows a changed text; ``counter`` adds a column with their number.

    Detected are e-mail, IPv4 and IPv6 addresses, card and account numbers (IBAN), telephone and
    similar numbers, access keys and tokens, private keys, secrets after words such as ``password=``,
    names after one or more titles, and these names without a title in the same text. Equal values get equal surrogates throughout the
    corpus and distinct values distinct ones; a surrogate has its value's
    format: class and place of characters, separators and letter case, a
    card's first and check digit, an account's country and check digits, an address's top-level domain, a name's
    script and, by the titles it has in the corpus, gender. The rest of the text stays as it is.
    NULL texts stay NULL; other columns and repeated rows are kept; an
    empty table gives an empty table.

    Only distinct values are shuffled. First draws are computed in the row;
    the few values that had to draw again, or whose titles differ in gender,
    are looked up through their documents.
    """
    names = docs.columns
    values = materialize(distinct_values(docs).select("kind", "value", "gender", "mixed"), "distinct")
    assigned = assign(values.select("kind", "value", "gender"), key).select("kind", "value", "attempt")
    again = assigned.join(values, ["kind", "value"]).filter("attempt > 0 OR mixed").select("kind", "value", "attempt", "gender")
    again = materialize(again, "again")
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), whole_text().alias("text"))
    if again.isEmpty():
        lookup = None
    else:
        keyed = keyed.withColumns({"k_id": F.col("row.doc_id"), "k_text": F.xxhash64("text")})
        mentions = (
            keyed.select("k_id", "k_text", F.explode(entities_of(F.col("text"))).alias("e")).select("k_id", "k_text", F.explode("e.parts").alias("p"))
            .select("k_id", "k_text", F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).distinct()
        )
        tables = (
            mentions.join(again, ["kind", "value"]).groupBy(F.col("k_id").alias("m_id"), F.col("k_text").alias("m_text"))
            .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "value"), F.struct("attempt", "gender")))).alias("attempts"))
        )
        tables = materialize(tables, "attempts")
        keyed = keyed.join(tables, F.col("k_id").eqNullSafe(F.col("m_id")) & (F.col("k_text") == F.col("m_text")), "left")
        lookup = F.col("attempts")

    def written(part: Column) -> Column:
        attempt, gender = F.lit(0), part["gender"]
        if lookup is not None:
            settled = F.try_element_at(lookup, F.concat_ws("\u0001", part["kind"], part["value"]))
            attempt, gender = F.coalesce(settled["attempt"], attempt), F.coalesce(settled["gender"], gender)
        spelled = in_form_of(part["kind"], part["text"], surrogate(part["kind"], part["value"], attempt, key, gender))
        return F.when(part["kind"] == "particle", part["text"]).otherwise(spelled)

    # Texts without a title are not searched for names once more.
    keyed = keyed.withColumn("entities", F.when(F.col("text").rlike(TITLED), entities_of(F.col("text"))))
    keyed = keyed.withColumn("repeats", repeats_of(F.col("text"), F.col("entities")))
    named = F.size("repeats") > 0
    quoted = F.array_join(F.transform("repeats", lambda r: F.concat(F.lit(r"\Q"), r, F.lit(r"\E"))), "|")
    pattern = F.when(named, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}\d])(?:"), quoted, F.lit(r")(?![\p{L}\p{M}\d])"))).otherwise(F.lit(PATTERN))
    keyed = keyed.withColumns({"pattern": pattern, "known": F.when(named, name_parts(F.col("entities")))})
    found = keyed.withColumn("found", found_in(F.col("text"), F.col("pattern")))

    def parts_in_row(m: Column) -> Column:
        return F.when(F.array_contains("repeats", m), repeated_parts(m, F.col("known"))).otherwise(parts_of(m))

    new = F.transform("found", lambda m: let(parts_in_row(m), lambda e: F.concat(e["lead"], F.array_join(F.transform(e["parts"], written), " "))))
    between = F.split("text", F.col("pattern"), -1)     # texts without a find are not cut
    rebuilt = F.array_join(F.zip_with(between, F.array_append(new, F.lit("")), lambda gap, sur: F.concat(gap, sur)), "")
    changed = found.withColumn("new_text", F.when(F.size("found") > 0, rebuilt))
    columns = []
    for c in names:
        if c == "text":
            columns.append(F.coalesce("new_text", "row.text").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("new_text").isNotNull(), F.length("new_text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return changed.select(*columns, *([F.size("found").alias(counter)] if counter else []))
