"""Surrogates for personal data, on DataFrame functions only."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise

#: After so many attempts that met others, a surrogate is a character longer, and so on:
#: a space of numbers that is crowded grows until all find a place.
PATIENCE = 8

# Titles that a person's name follows, by gender; several may follow each other.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Señorita|Senora|Senorita|Sra|Srta|Doña|Dra|Doctora|Profesora|Г-жа|Госпожа|Κυρία|Κα"
MALE = "Mr|Herrn|Herr|Monsieur|Señor|Senor|Sr|Don|Г-н|Господин|Κύριος|Κος"
EITHER = "Dr|Prof|Professor|Professeur|Profesor|Doctor|Doktor|Docteur"
_TITLE = rf"(?:{FEMALE}|{MALE}|{EITHER})(?![\p{{L}}\p{{N}}_])"
TITLES = rf"{_TITLE}\.?(?: {_TITLE}\.?)*"
#: Small words inside names, which stay.
PARTICLES = "von|van|vom|und|zu|zum|zur|der|den|dem|de|del|della|di|da|dos|du|des|la|las|los|le|el|y|ten|ter|bin|ibn|al"
_PARTICLE = r"(?:von und zu|v[oa]n(?: (?:der|den|dem|de|la))?|vom|zu[mr]?|de(?: (?:la|las|los|le))?|del(?:la)?|di|da|dos|du|des|y|ten|ter|bin|ibn|al)"

_WORD = rf"(?!{_TITLE})(?:[dl]['’])?\p{{Lu}}(?:['’]\p{{Lu}})?\p{{L}}+(?:[-'’]\p{{Lu}}\p{{L}}+)*(?![\p{{L}}\p{{N}}_])"
_INITIALS = r"(?:\p{Lu}\. ){0,3}"
_NAME = rf"{_INITIALS}(?:{_PARTICLE} ){{0,2}}{_WORD}"
#: What a name without a title follows.
CUES = "[Mm]y name is|[Nn]ame:|[Cc]ontact:|[Ss]igned,|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es"
_HEX = "[0-9A-Fa-f]{1,4}"
# Letters that addresses may have besides ASCII, names before a secret, and how providers' keys begin.
_LETTERS = r"\u00c0-\u024f\u0370-\u1fff\u2c00-\u2dff\u3040-\ud7ff"
ASSIGNED = "(?i:pass(?:word|wd|phrase|wort)|pwd|kennwort|contraseña|clave|mot de passe|secret|token|api[_\\-]?key|(?:access|secret|private)[_\\-]?key|client[_\\-]?secret|auth[_\\-]?token)"
PREFIXED = "|".join((
    r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"gh[pousr]_[A-Za-z0-9]{30,255}", r"github_pat_[A-Za-z0-9_]{22,255}", r"glpat-[A-Za-z0-9_\-]{20,64}", r"sk-[A-Za-z0-9_\-]{20,255}",
    r"xox[abprs]-[A-Za-z0-9\-]{10,255}", r"AIza[A-Za-z0-9_\-]{35}", r"eyJ[A-Za-z0-9_\-]{10,2000}\.[A-Za-z0-9_\-]{10,4000}\.[A-Za-z0-9_\-]{10,1000}",
))
#: What stands between such a name and its value, and the value: after ":" it has a digit or sign, so that prose stays.
_GIVEN = r"(?<=[=:]|[=:] |[=:][\"']|[=:] [\"'])"
_VALUE = r"[^\s\"'<>,;]{3,127}[^\s\"'<>,;.!?)]"
#: Each alternative begins at a word's first character, so a long word is looked at once. What a mention
#: has to begin with, or to follow, is looked at before the longer tests that it is a part of.
SHAPES = {
    "email": rf"[A-Za-z0-9{_LETTERS}][A-Za-z0-9{_LETTERS}._%+\-]{{0,63}}+@[A-Za-z0-9{_LETTERS}](?:[A-Za-z0-9{_LETTERS}\-]{{0,62}}+)(?:\.[A-Za-z0-9{_LETTERS}\-]{{1,63}}){{1,6}}(?![A-Za-z0-9{_LETTERS}@])",
    "secret": r"(?=[a-zA-Z]{0,63}[0-9])(?=[0-9]{0,63}[a-fA-F])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}_])",
    "ip": r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\p{L}\p{N}_]|\.[0-9])",
    "ip6": rf"(?=[A-Fa-f:]{{0,40}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}_:])",
    "phone": "|".join((
        r"(?:\+[0-9]{1,3}[ .\-]?|1[ .\-])?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3,4}[ .\-][0-9]{4}(?![\p{L}\p{N}_])",
        r"\+[0-9]{1,3}(?:[ .\-]?(?:\(0\)[ .\-]?)?[0-9]{2,4}){2,5}(?![\p{L}\p{N}_])",
        # National: French pairs; an area code after 0; Spanish groups of nine digits.
        r"0[1-9](?:[ .\-]?[0-9]{2}){4}(?![\p{L}\p{N}_])",
        r"(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /\-])[0-9]{3,8}(?:[ \-][0-9]{2,8}){0,3}(?![\p{L}\p{N}_])",
        r"[6-9][0-9]{2}(?:[ \-][0-9]{3}[ \-][0-9]{3}|(?:[ \-][0-9]{2}){3})(?![\p{L}\p{N}_]|[ .,\-][0-9])",
    )),
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_])",
    "card": r"[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![\p{L}\p{N}_])",
    "token": rf"(?=[Agsxe])(?:{PREFIXED})(?![\p{{L}}\p{{N}}_])",
    "person": rf"(?:{TITLES} |(?=[\p{{Lu}}bdiltvyz])(?<=[:,steo] )(?<=(?:{CUES}) )){_NAME}(?: {_NAME})*|(?=\p{{IsHan}})(?<=(?:{CUES}) |姓名[：:])\p{{IsHan}}{{2,4}}",
}
#: The value of a password or token that is named before it.
PASSWORD = rf"(?<=[=: \"']){_GIVEN}(?<={ASSIGNED} ?(?:=|:(?=\s?[\"']?[^\s\"'<>,;]{{0,127}}[0-9_$#!@%^&*+/=])) ?[\"']?){_VALUE}"
#: A number may follow "." or "-", unless those follow a digit; an address may not.
PATTERN = (
    r"(?:(?<![\p{L}\p{N}_@.%+\-])(?=[A-Za-z0-9" + _LETTERS + "])" + SHAPES["email"]
    + r"|(?<![\p{L}\p{N}_@%+])(?<![\p{N}][.\-])(?=[0-9+(A-Za-z\p{Lu}\p{IsHan}])(?:" + "|".join(SHAPES[k] for k in ("secret", "token", "ip", "ip6", "phone", "iban", "ssn", "card", "person")) + ")"
    + f"|{PASSWORD})"
)
KINDS = ("email", "person", "ssn", "ip", "ip6", "secret", "token", "iban", "phone", "card")
_WHOLE_NAME = rf"^(?:{_NAME}(?: {_NAME})*|\p{{IsHan}}{{2,4}})$"


def _kind(m: Column) -> Column:
    """By its shape; what stood after a word is a name or a password."""
    out = F.when(m.rlike(r"^[0-9 \-]+$"), "card").when(m.rlike(_WHOLE_NAME), "name").otherwise("password")
    for k in reversed(KINDS):
        out = F.when(m.rlike(rf"^(?:{SHAPES[k]})$"), k).otherwise(out)
    return out


def _norm(kind: Column, m: Column) -> Column:
    """What makes two mentions the same entity: case and separators don't, nor does what
    a telephone number has before its last nine digits, which stays as it is: country
    codes and trunk prefixes may be there or not."""
    plain = F.regexp_replace(m, r"[ .()/\-]", "")
    phone = F.regexp_extract(plain, "[0-9]{1,9}$", 0)
    return F.when(kind == "phone", phone).when(kind.isin("ip", "token", "password"), m).when(kind == "iban", F.upper(plain)).when(kind.isin("card", "ssn"), plain).otherwise(F.lower(m))


def _words(m: Column) -> Column:
    """The words of a person's name after the titles."""
    return F.split(F.regexp_replace(m, rf"^{TITLES} ", ""), " ")


def _is_part(word: Column) -> Column:
    """Particles and initials stay."""
    return ~word.rlike(rf"^(?:(?i:{PARTICLES})|\p{{Lu}}\.)$")


def _mentions(text: Column) -> Column:
    """array<struct<m, kind, norm>>, a person's name as its parts: first names by
    gender, the last name by itself, so that "Mrs A B" and "Mr B" keep B in common."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def one(m: Column) -> Column:
        kind = _kind(m)
        names = F.filter(_words(m), _is_part)
        title = F.regexp_extract(m, rf"^{TITLES}", 0)
        gender = F.when(title.rlike(rf"\b(?:{FEMALE})\b"), "first_f").when(title.rlike(rf"\b(?:{MALE})\b"), "first_m").otherwise("first")
        parts = F.transform(names, lambda p, i: F.struct(p.alias("m"), F.when(i == F.size(names) - 1, "last").otherwise(gender).alias("kind"), F.lower(p).alias("norm")))
        single = F.array(F.struct(m.alias("m"), kind.alias("kind"), _norm(kind, m).alias("norm")))
        return F.when(kind.isin("person", "name"), parts).otherwise(single)

    return F.flatten(F.transform(found, one))


def _own(word: Column) -> Column:
    """The surrogate of a part of a name in its document: one for each word, as a last
    name if it is one anywhere in the document. Upper case stays."""
    found = F.coalesce(*[F.try_element_at("__map", F.concat(F.lit(f"{k}|"), F.lower(word))) for k in ("last", "first_f", "first_m", "first")])
    return F.when(word == F.upper(word), F.upper(found)).otherwise(found)


def _random(seed: str, i: str, m: int) -> str:
    """SQL: number `i` of the keyed stream `seed` (256 bytes in hexadecimal), below `m`."""
    return f"cast(conv(substr({seed}, 1 + 4 * (({i}) % 128), 4), 16, 10) as int) % {m}"


# Consonants and vowels by script, and common characters of names.
SCRIPTS = {r"\\p{IsCyrillic}": ("бвгдзклмнпрст", "аеиоу"), r"\\p{IsGreek}": ("βγδζκλμνπρστ", "αεηιο"), r"\\p{IsHan}": ("王李张刘陈杨黄赵吴周徐孙", "明华文军平芳丽强伟敏静杰")}


def _shaped(text: str, seed: str) -> str:
    """SQL: each digit by a digit, each letter by one of its case and script (Latin by ASCII), the rest as it is."""
    letter = "substr('abcdefghijklmnopqrstuvwxyz', 1 + {r}, 1)"
    lower, upper = letter.format(r=_random(seed, "i", 26)), f"upper({letter.format(r=_random(seed, 'i', 26))})"
    other = " ".join(f"when c rlike '{k}' then substr('{a + b}', 1 + {_random(seed, 'i', len(a + b))}, 1)" for k, (a, b) in SCRIPTS.items())
    return f"array_join(transform(split({text}, ''), (c, i) -> case when c rlike '[0-9]' then cast({_random(seed, 'i', 10)} as string) when c rlike '[a-z]' then {lower} when c rlike '[A-Z]' then {upper} when c < '\\u007f' then c {other} when c rlike '\\\\p{{L}}' then {lower} else c end), '')"


def _name(norm: str, kind: str, seed: str) -> str:
    """SQL: a name of the same script and length: consonants and vowels in turn; a
    woman's first name ends in a vowel, a man's in a consonant; later attempts are longer."""
    latin = ("bcdfghklmnprstvz", "aeiou")

    def build(consonants: str, vowels: str) -> str:
        n = f"greatest({2 if consonants[0] == '王' else 3}, length({norm})) + attempt"
        v, c = (f"substr('{x}', 1 + {_random(seed, 'i', len(x))}, 1)" for x in (vowels, consonants))
        last = f"case {kind} when 'first_f' then {v} when 'first_m' then {c} else if(i % 2 = 1, {v}, {c}) end"
        return f"initcap(array_join(transform(sequence(0, {n} - 1), i -> if(i = {n} - 1, {last}, if(i % 2 = 1, {v}, {c}))), ''))"

    when = " ".join(f"when {norm} rlike '{k}' then {build(*x)}" for k, x in SCRIPTS.items())
    return f"case {when} else {build(*latin)} end"


def _keys(spark: SparkSession, key: str) -> DataFrame:
    """kind, inner, outer: the padded key blocks of an HMAC for each kind of entity,
    under a key derived for it. Rows of a table, so that no plan shows them."""
    kinds, args = sorted({*KINDS, "password", "last", "first", "first_f", "first_m"} - {"person"}), {}
    for n, kind in enumerate(kinds):
        own = hmac.new(key.encode(), kind.encode(), hashlib.sha256).digest().ljust(64, b"\0")
        args[f"i{n}"], args[f"o{n}"] = (bytes(x ^ pad for x in own).hex() for pad in (0x36, 0x5C))
    values = ", ".join(f"('{kind}', unhex(:i{n}), unhex(:o{n}))" for n, kind in enumerate(kinds))
    return spark.sql(f"SELECT * FROM VALUES {values} AS k(k_kind, inner, outer)", args)


def _surrogate() -> tuple[Column, Column]:
    """From columns kind, norm, attempt, inner, outer. Text of a mention is poured into its own format later."""
    word = "cast(concat_ws('|', norm, cast(attempt as string)) as binary)"
    mac = f"sha2(concat(outer, unhex(sha2(concat(inner, {word}), 256))), 256)"
    seed = "concat(" + ", ".join(f"sha2(concat({mac}, '|{n}'), 512)" for n in range(4)) + ")"
    more = f"repeat('0', attempt div {PATIENCE})"
    octets = "concat_ws('.', " + ", ".join(f"cast(1 + {_random('seed', str(n), 254)} as string)" for n in range(4)) + ")"
    # Addresses of four bytes that run out go on as local ones of sixteen.
    octets = f"if(attempt < {PATIENCE}, {octets}, concat('fd00:', regexp_replace(substr(seed, 21, 24), '(....)(?=.)', '$1:'), ':', substr(seed, 61, 4)))"
    # The local part and the labels before the last; the last label stays.
    head = f"concat(regexp_replace(norm, '[.][^.]*$', ''), repeat('a', attempt div {PATIENCE}))"
    mail = f"concat({_shaped(head, 'seed')}, regexp_extract(norm, '[.][^.]*$', 0))"
    phone = _shaped(f"concat(norm, {more})", "seed")
    # How a provider's keys begin stays.
    begins = "regexp_extract(norm, '^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-|AIza|eyJ)', 0)"
    token = f"concat({begins}, {_shaped(f'concat(substr(norm, 1 + length({begins})), {more})', 'seed')})"
    digits = f"concat(substr(norm, 1, 1), {_shaped(f'concat(substr(norm, 2), {more})', 'seed')})"
    luhn = "aggregate(transform(reverse(filter(split({x}, ''), c -> c <> '')), (c, i) -> if(i % 2 = 1, if(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int)), cast(c as int))), 0, (a, x) -> a + x)"
    # A card's last digit gives the surrogate the original's Luhn remainder.
    front = f"substr({digits}, 1, length({digits}) - 1)"
    zero = f"concat({front}, '0')"
    card = f"concat({front}, cast(pmod({luhn.format(x='norm')} - {luhn.format(x=zero)}, 10) as string))"
    hexed = f"array_join(transform(filter(split(concat(norm, {more}), ''), c -> c <> ''), (c, i) -> if(c = ':', c, substr('0123456789abcdef', 1 + {_random('seed', 'i', 16)}, 1))), '')"
    # The country stays, and two digits make the whole 1 modulo 97.
    account = _shaped(f"concat(substr(norm, 5), {more})", "seed")
    rest = f"aggregate(filter(split(concat({account}, substr(norm, 1, 2), '00'), ''), c -> c <> ''), 0, (a, c) -> if(c rlike '[0-9]', (10 * a + cast(c as int)) % 97, (100 * a + ascii(c) - 55) % 97))"
    iban = f"concat(substr(norm, 1, 2), lpad(cast(98 - {rest} as string), 2, '0'), {account})"
    sql = (
        f"case when kind = 'email' then {mail} when kind = 'ip' then {octets} when kind in ('secret', 'ip6') then {hexed} when kind = 'iban' then {iban} "
        f"when kind = 'card' then {card} when kind in ('phone', 'password') then {phone} when kind = 'token' then {token} when kind = 'ssn' then {digits} else {_name('norm', 'kind', 'seed')} end"
    )
    return F.expr(seed).alias("seed"), F.expr(sql).alias("surrogate")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, surrogate for distinct (kind, norm): no two of a kind share a
    surrogate, and none is itself an entity found in the texts.

    Rounds of aggregation find collisions; all but the smallest of those that
    share one draw anew from the keyed stream, as do those that hit an entity.
    Surrogates grow with the attempts, so the rounds end however many there are.
    """
    seed, sur = _surrogate()
    keys = F.broadcast(_keys(entities.sparkSession, key))  # one row for each kind

    def drawn(df: DataFrame) -> DataFrame:
        seeded = df.join(keys, F.col("kind") == F.col("k_kind")).select("kind", "norm", "attempt", seed)
        return materialise(seeded.select("kind", "norm", "attempt", sur))

    known = materialise(entities.select("kind", "norm").distinct())
    real = known.select(F.col("kind").alias("r_kind"), F.col("norm").alias("r_norm"))
    now = drawn(known.withColumn("attempt", F.lit(0)))
    while True:
        first = now.groupBy("kind", F.lower("surrogate").alias("low")).agg(F.min(F.struct("attempt", "norm")).alias("keeps"), F.count("*").alias("n"))
        taken = first.join(real, (F.col("kind") == F.col("r_kind")) & (F.col("low") == F.lower("r_norm")), "left")
        clashes = taken.filter("n > 1 or r_norm is not null").select(F.col("kind").alias("c_kind"), "low", F.when(F.col("r_norm").isNull(), F.col("keeps.norm")).alias("keep"))
        clashes = materialise(clashes.distinct())
        if not clashes.limit(1).count():
            discard(clashes)
            return now.select("kind", "norm", "surrogate")
        marked = now.join(clashes, (F.col("kind") == F.col("c_kind")) & (F.lower("surrogate") == F.col("low")), "left")
        again = F.col("low").isNotNull() & (F.col("keep").isNull() | (F.col("keep") != F.col("norm")))
        before, now = now, drawn(marked.select("kind", "norm", (F.col("attempt") + again.cast("int")).alias("attempt")))
        discard(before)
        discard(clashes)


def _pour(m: str, s: str) -> str:
    """SQL: the characters of `s` in the last places of the letters and digits of `m`, with the
    case of `m`. Places before them keep their own; what has no place is added at the end."""
    places = f"transform(split({m}, ''), c -> if(c rlike '[A-Za-z0-9]', 1, 0))"
    own = f"regexp_replace({m}, '[^A-Za-z0-9]', '')"
    whole = f"concat(substr({own}, 1, greatest(0, length({own}) - length({s}))), {s})"
    char = f"substr({whole}, aggregate(slice({places}, 1, i + 1), 0, (a, b) -> a + b), 1)"
    return f"concat(array_join(transform(split({m}, ''), (c, i) -> if(c rlike '[A-Za-z0-9]', {char}, c)), ''), substr({whole}, length({own}) + 1))"


def replace_pii(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """All rows and columns of `docs` with `text` rewritten, and `count_col`, the
    number of mentions replaced (none: no such column; if `docs` has one of that
    name, underscores are added to ours).

    Entities: e-mail and IP addresses, phone, card, social security and IBAN
    numbers, long hexadecimal secrets, keys that begin like those of known providers,
    values given to a password, key or token (after ":" such as have a digit or sign), and names of any number of
    parts after one or more titles, or after words that introduce one. A part of such a name is replaced
    wherever it stands in the same document with a capital; particles and initials
    stay. A surrogate depends on the key and the entity alone; the same entity gets
    the same one in all documents, whatever its case or separators, a phone number
    with or without its country code; formats, case, script, a card's Luhn remainder,
    an IBAN's check and a name's gender stay. Null and empty texts stay as they are;
    repeated rows are rewritten alike; null ids are kept; an empty table stays empty.

    Texts without entities pass in a narrow stage. Only texts with entities, and
    the entities, are shuffled; a mention's entity is one row on its side of the
    join, so a frequent one can be split.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    extra = count_col or "n_entities"
    while extra in docs.columns:
        extra += "_"
    has = F.coalesce(F.col(text_col).rlike(PATTERN), F.lit(False))
    cols = docs.columns
    clean = docs.filter(~has).withColumn(extra, F.lit(0))
    found = docs.filter(has).withColumn("__hash", F.sha2(F.col(text_col), 256)).withColumn("__mentions", _mentions(F.col(text_col)))
    found = materialise(found)
    mentions = found.select("__hash", F.explode(F.array_distinct(F.transform("__mentions", lambda x: F.struct(x["kind"].alias("kind"), x["norm"].alias("norm"))))).alias("e")).select("__hash", "e.kind", "e.norm").distinct()
    names = surrogates(mentions.select("kind", "norm"), key).select(F.col("kind").alias("e_kind"), F.col("norm").alias("e_norm"), "surrogate")
    mapped = mentions.join(names, (F.col("kind") == F.col("e_kind")) & (F.col("norm") == F.col("e_norm")))
    own = mapped.groupBy("__hash").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), F.col("surrogate")))).alias("__map"))
    own = own.withColumnRenamed("__hash", "__of")
    both = found.join(own, F.col("__hash") == F.col("__of"))
    # Parts of a name also stand alone in its document, where they begin with a capital.
    parts = F.transform(F.filter(F.map_keys("__map"), lambda k: k.rlike(r"^(?:last|first|first_f|first_m)\|")), lambda k: F.substring_index(k, "|", -1))
    # Longer ones first: of two that begin alike the longer is meant.
    parts = F.reverse(F.array_sort(F.array_distinct(parts)))
    alone = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}_])(?=[\p{Lu}\p{IsHan}]|[dl]['’])(?iu:"), F.array_join(parts, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    # The texts between mentions, and what stands for each mention, in turn.
    both = both.withColumn("__pattern", F.when(F.size(parts) > 0, alone).otherwise(PATTERN))
    both = both.withColumn("__found", F.expr(f"regexp_extract_all({text_col}, __pattern, 0)")).withColumn("__gaps", F.expr(f"split({text_col}, __pattern, -1)"))

    def written(m: Column) -> Column:
        kind = _kind(m)
        own = F.try_element_at("__map", F.concat_ws("|", kind, _norm(kind, m)))
        person = F.transform(_words(m), lambda p: F.when(_is_part(p), _own(p)).otherwise(p))
        title = F.regexp_extract(m, rf"^{TITLES} ", 0)
        whole = F.when(kind.isin("person", "name"), F.concat(title, F.array_join(person, " ")))
        return F.struct(m.alias("m"), kind.alias("kind"), own.alias("s"), whole.alias("person"))

    both = both.withColumn("__new", F.transform("__found", written))
    poured = _pour("x.m", "x.s")
    cased = "if(x.m = upper(x.m), upper(x.s), x.s)"
    out = f"transform(__new, x -> case when x.kind in ('person', 'name') then x.person when x.kind in ('ip', 'token', 'password') then x.s when x.kind in ('secret', 'email', 'ip6') then {cased} else {poured} end)"
    both = both.withColumn("__out", F.expr(out))
    text = F.expr("array_join(transform(__gaps, (g, i) -> concat(g, coalesce(get(__out, i), ''))), '')")
    changed = both.withColumn(text_col, text).withColumn(extra, F.size("__found"))
    out = clean.unionByName(changed.select(*cols, extra))
    return out if count_col else out.drop(extra)
