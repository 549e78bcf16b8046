"""Personal data: detected entities get keyed surrogates of their own kind and format.

Detection, surrogates and replacement are SQL expressions. A surrogate is derived
from a keyed hash of the entity's kind and normal form and takes only letter case and
spacing from a mention, so an entity has one surrogate wherever and however it occurs
(coreference). A name's entities are its words, so a surname alone and with a given
name stay the same person's. A second pass over distinct entities checks that no
two of one kind share a surrogate and that no surrogate is an entity of the corpus
itself; those that fail draw again until none does.

Each attempt draws from a larger space: e-mail addresses get a label before
example, names more syllables, and secrets that clash many times more symbols. The other
kinds have formats of fixed size; should clashes cease to decline, as when a format has no
surrogate left, an error is raised. None ever share a surrogate.

Fixed formats: e-mail addresses keep the shape of the local part and lie under
example; phone numbers keep country code and grouping; IP addresses stay
addresses of their version; card numbers keep the first digit, grouping and the
Luhn check; social security numbers stay possible ones; IBANs keep country, grouping
and check digits; access keys, tokens, private keys and secrets keep prefix, length and
alphabet; names keep titles, initials, gender of the given name, script and case.

A name is found behind a title, or where a common given name comes before another
capitalised word. Other names without a title are not found.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare_names, written

KINDS = ("email", "phone", "ssn", "ip", "card", "iban", "key", "private_key", "secret", "name")

#: Titles by gender (u: of either), common given names by gender, and syllables of surrogate names by script.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"),
    "u": ("Dr", "Doctor", "Prof", "Professor", "Docteur", "Professeur", "Доктор", "Профессор"),
}
GIVEN = {
    "m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Paul Joshua Kenneth Kevin Brian George Edward Peter Henry Jack Oliver Harry "
        "Hans Klaus Jürgen Wolfgang Stefan Andreas Heinz Matthias Sebastian Lukas Jean Pierre Michel Jacques François Antoine Nicolas Julien José Juan Carlos Luis Miguel Pedro Pablo Javier Diego "
        "Иван Сергей Александр Дмитрий Алексей Андрей Михаил Николай Владимир Павел Γιώργος Γιάννης Νίκος Κώστας Δημήτρης"
    ).split(),
    "f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Michelle Laura Jane Anna Emma Olivia Sophia Alice Julia Helen "
        "Ursula Monika Petra Sabine Heike Katharina Claudia Christine Marie Sophie Isabelle Nathalie Camille Hélène Françoise María Carmen Isabel Lucía Elena Marta Pilar Ana "
        "Мария Анна Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Μαρία Ελένη Κατερίνα Σοφία Άννα"
    ).split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga go ha he ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve wi".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα γο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {"latin": {"m": "n", "f": "a", "u": "i", "s": "rd"}, "cyrillic": {"m": "н", "f": "я", "u": "и", "s": "ров"}, "greek": {"m": "ς", "f": "η", "u": "ι", "s": "ου"}}
#: Calling codes of one and two digits (others have three), labels of secrets, prefixes of access tokens.
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
LABELS = "token|password|passwd|passphrase|pwd|secret|api[_-]?key|access[_-]?key|secret[_-]?key"
PREFIXES = "gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|[sr]k_test_|AIza"

_TITLE = "|".join(x for group in TITLES.values() for t in group for x in (t, t.upper()))
_GIVEN = "|".join(x for group in GIVEN.values() for x in group)
#: Entities of no fixed length are taken to their end. Quantifiers are possessive and an address starts where its run of symbols does
#: (or where the last entity ended), so that time is linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s\\]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?+",
    "phone": (
        r"(?:\+[0-9]{1,3} ?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b"
        r"|(?<![0-9A-Za-z])\+(?=(?:[ .()-]{0,2}[0-9]){7,15}+(?![0-9]))[1-9](?:[ .-]?[0-9]|[ .-]?\([0-9]{1,4}\)){6,14}+"
        r"|(?<![0-9A-Za-z.+-])[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3}[ -])[0-9]{4}(?![0-9A-Za-z-])"
    ),
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "ip6": (
        r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?+)(?![0-9A-Za-z:])"
    ),
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}(?: ?(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}(?: ?(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?\b",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "token": rf"(?<![A-Za-z0-9])(?:{PREFIXES})[A-Za-z0-9_-]{{16,}}+",
    # behind a colon or a blank a value has a digit, since prose has colons
    "secret": (
        rf"(?<![A-Za-z0-9])(?i:{LABELS})(?:[\"']?[ \t]{{0,4}}=[ \t]{{0,4}}[\"']?(?:(?=[A-Za-z0-9_+/-]{{12}})|(?=[A-Za-z_+/-]*+[0-9])(?=[A-Za-z0-9_+/-]{{8}}))"
        r"|[\"']?[ \t]{0,4}:[ \t]{0,4}[\"']?(?=[A-Za-z_+/-]*+[0-9])(?=[A-Za-z0-9_+/-]{8}))[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+"
        r"|(?<![A-Za-z0-9])(?i:bearer) (?=[A-Za-z_+/.-]*+[0-9])(?=[A-Za-z0-9_+/.-]{16})[A-Za-z0-9_+/-]++(?:\.[A-Za-z0-9_+/-]++)*+"
    ),
    "name": rf"\b(?=\p{{Lu}})(?:(?:{_TITLE})\.? (?:(?:{_TITLE})\.? )*+(?:\p{{Lu}}\. )*+\p{{Lu}}\p{{L}}++|(?:{_GIVEN}) (?:\p{{Lu}}\. )*+\p{{Lu}}\p{{L}}++)(?: (?:\p{{Lu}}\. )*+\p{{Lu}}\p{{L}}++)*+",
}
#: Behind a small letter only a bracket or a dash can begin an entity, or what follows another one; so most places are passed by at once.
ANY = r"(?:\G|(?<![a-z])|(?=[(-]))(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: A text without any of these holds no entity.
HINT = rf"[0-9@]|AKIA|-----BEGIN|(?i:{LABELS}) ?[\"']?[ \t]*=|(?:{PREFIXES})|\b(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN})[. ]"
#: Entities that drew again are looked up in a literal map up to this number, beyond it by a join.
LITERAL_REDRAWS = 2_000
#: Rounds without a decline of clashes that tell that a format is used up; from the attempt LONGER on secrets get longer.
STUCK, LONGER = 32, 8


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_sql(v: str) -> str:
    return f"""case when {v} like '-----BEGIN%' then 'private_key' when {v} like '%@%' then 'email' when {v} rlike '^[+(]' then 'phone'
        when {v} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn' when {v} rlike '^[0-9]{{1,3}}(\\\\.[0-9]{{1,3}}){{3}}$' then 'ip'
        when {v} rlike '^[0-9A-Fa-f]{{1,4}}:' then 'ip' when {v} rlike '^[0-9]{{3}}[-. ][0-9]{{3}}[-. ][0-9]{{4}}$' then 'phone'
        when {v} rlike '^[0-9]' then 'card' when {v} rlike '^AKIA[A-Z0-9]{{16}}$' then 'key'
        when {v} rlike {_quoted(f"^(?:{PREFIXES})")} then 'secret' when {v} rlike {_quoted(rf"^(?i:(?:{LABELS})[\"']?[ \t]*[=:]|bearer )")} then 'secret'
        when {v} rlike '^[A-Z]{{2}}[0-9]{{2}}' then 'iban' else 'name' end"""


def norm_sql(v: str, kind: str) -> str:
    """What makes two mentions the same entity. A phone number's country code 1 doesn't count."""
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    secret = rf"([A-Za-z0-9_+/.-]+)$"
    return f"""case {kind} when 'email' then lower({v}) when 'phone' then case when {v} like '+1%' then right({digits}, greatest(length({digits}) - 1, 0)) else {digits} end
        when 'card' then {digits} when 'iban' then regexp_replace({v}, ' ', '') when 'private_key' then md5(regexp_replace(regexp_replace({v}, '-----[A-Z ]+-----', ''), '[^A-Za-z0-9+/=]|\\\\\\\\n', ''))
        when 'secret' then regexp_replace(regexp_extract({v}, '{secret}', 1), {_quoted(f"^(?:{PREFIXES})")}, '')
        when 'ip' then lower({v}) when 'name' then lower(substring({v}, length({_front(v)}) + 1)) else {v} end"""


def _front(v: str) -> str:
    """The titles of a name."""
    return f"regexp_extract({v}, {_quoted(rf'^(?:(?:{_TITLE})\.? )*')}, 0)"


def _byte(h: str, i: str) -> str:
    return f"cast(conv(substring({h}, pmod(2 * ({i}), 128) + 1, 2), 16, 10) as int)"


def _like(text: str, h: str, start: int = 0, cased: bool = False) -> str:
    """Letters and digits of a text replaced by others of their class; cased: case counts, and lower-case hexadecimal stays that."""
    b = _byte(h, f"i + {start + 1}")
    letter = lambda x: f"substring('{x}', {b} % 26 + 1, 1)"
    lower, upper = letter("abcdefghijklmnopqrstuvwxyz"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    one = f"case when c rlike '[0-9]' then cast({b} % 10 as string) when c rlike '[a-z]' then {lower} when c rlike '[A-Z]' then {upper} else c end"
    if not cased:
        return f"case when {text} = '' then '' else array_join(transform(split({text}, ''), (c, i) -> {one}), '') end"
    one = f"case when hexadecimal then substring('0123456789abcdef', {b} % 16 + 1, 1) else {one} end"
    return f"case when {text} = '' then '' else transform(array({text} rlike '^[0-9a-f]+$'), hexadecimal -> array_join(transform(split({text}, ''), (c, i) -> {one}), ''))[0] end"


def _digits(h: str, n: int) -> str:
    return "concat(" + ", ".join(f"cast({_byte(h, str(k))} % 10 as string)" for k in range(n)) + ")"


def _luhn(digits: str) -> str:
    """The check digit after 15 digits."""
    add = f"aggregate(sequence(1, 15), 0, (s, i) -> s + case when i % 2 = 0 then cast(substring({digits}, i, 1) as int) else cast((2 * cast(substring({digits}, i, 1) as int)) div 10 as int) + (2 * cast(substring({digits}, i, 1) as int)) % 10 end)"
    return f"cast((10 - {add} % 10) % 10 as string)"


def _hash(key: str, kind: str, norm: str, attempt: str, digits: int) -> str:
    h = f"sha2(concat_ws('|', {_quoted(key)}, {kind}, {norm}, cast({attempt} as string)), 512)"
    return h if digits == 128 else f"repeat(substring({h}, 1, {digits}), {-(-128 // digits)})"


def _name_word(word: str, gender: str, key: str, attempt: str, digits: int) -> str:
    """A surrogate of one name word; gender m or f for given names, s for surnames."""
    script = f"case when {word} rlike '[\\\\u0400-\\\\u04ff]' then 'cyrillic' when {word} rlike '[\\\\u0370-\\\\u03ff]' then 'greek' else 'latin' end"
    choose = []
    for name, parts in SYLLABLES.items():
        table = "array(" + ", ".join(_quoted(p) for p in parts) + ")"
        pick = ", ".join(f"element_at({table}, {_byte('y.h', str(3 * k))} * 7 % {len(parts)} + 1)" for k in range(3))
        # a syllable more every second attempt
        more = f"array_join(transform(slice(sequence(3, 19), 1, least({attempt} div 2, 17)), k -> element_at({table}, {_byte('y.h', '3 * k')} * 7 % {len(parts)} + 1)), '')"
        ending = f"case {gender} when 'm' then '{ENDINGS[name]['m']}' when 'f' then '{ENDINGS[name]['f']}' else '{ENDINGS[name]['s']}' end"
        choose.append(f"when '{name}' then concat({pick}, {more}, {ending})")
    made = f"case {script} {' '.join(choose)} end"
    h = _hash(key, f"concat('name-', {gender})", f"lower({word})", attempt, digits)
    cased = f"case when {word} = upper({word}) and length({word}) > 1 then upper(z.n) else initcap(z.n) end"
    return f"transform(transform(array(named_struct('h', {h})), y -> named_struct('n', {made})), z -> {cased})[0]"


def _mod97(text: str) -> str:
    return f"aggregate(split({text}, ''), 0, (s, c) -> case when c = '' then s when c rlike '[0-9]' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(c) - 55) % 97 end)"


def _name_parts(v: str) -> str:
    """The words of a name after its titles, each with its kind: name-m, name-f or name-u for given names, name-s for the last one."""
    of = lambda words: ", ".join(_quoted(w) for w in words)
    title = f"initcap(regexp_replace(substring_index({v}, ' ', 1), '[.]$', ''))"
    known = f"initcap(ws[0]) in ({of(GIVEN['m'])}) then 'name-m' when initcap(ws[0]) in ({of(GIVEN['f'])})"
    gender = f"case when {title} in ({of(TITLES['m'])}) then 'name-m' when {title} in ({of(TITLES['f'])}) then 'name-f' when {known} then 'name-f' else 'name-u' end"
    return f"transform(array(split(substring({v}, length({_front(v)}) + 1), ' ')), ws -> transform(ws, (w, k) -> named_struct('kind', case when k = size(ws) - 1 then 'name-s' else {gender} end, 'norm', lower(w), 'v', w)))[0]"


_INITIAL = r"rlike '^\\p{Lu}[.]$'"


def surrogate_sql(v: str, kind: str, norm: str, h: str, attempt: str, key: str, digits: int = 128, attempts: Callable[[str, str], str] | None = None) -> str:
    """The surrogate of a mention with hash `h`, in the mention's own format. Cards and IBANs that fail their check and impossible addresses stay.

    attempts: from kind and normal form of a name's word its attempt; without it `v` may be a single word of a name.
    """
    local, domain = f"substring_index({v}, '@', 1)", f"substring_index({v}, '@', -1)"
    front = f"regexp_extract({domain}, '^(.*[.])?[^.]+[.][^.]+$', 1)"
    label = f"case when {attempt} > 0 then concat('m', substring({h}, 65, least(2 * {attempt}, 60)), '.') else '' end"
    email = f"concat({_like(local, h)}, '@', {_like(front, h, 19)}, {label}, 'example.', substring_index({domain}, '.', -1))"
    # digits by their number of followers, so that a number has the same ones in every format; a calling code stays
    kept = f"length(regexp_extract({v}, '^[+]({CALLING})', 1))"
    after = f"length(regexp_replace(substring({v}, i + 2), '[^0-9]', ''))"
    before = f"length(regexp_replace(left({v}, i), '[^0-9]', ''))"
    phone = f"array_join(transform(split({v}, ''), (c, i) -> case when c rlike '[0-9]' and {before} >= {kept} then cast({_byte(h, after)} % 10 as string) else c end), '')"
    two = lambda k: f"(256 * {_byte(h, str(k))} + {_byte(h, str(k + 1))})"
    ssn = f"concat(lpad({two(0)} % 665 + 1, 3, '0'), '-', lpad({_byte(h, '2')} % 99 + 1, 2, '0'), '-', lpad({two(3)} % 9999 + 1, 4, '0'))"
    hexa = lambda letters: f"substring('{letters}', {_byte(h, 'i')} % 16 + 1, 1)"
    ip6 = f"array_join(transform(split({v}, ''), (c, i) -> case when c = ':' then c when {v} = upper({v}) then {hexa('0123456789ABCDEF')} else {hexa('0123456789abcdef')} end), '')"
    body = _like(f"substring({norm}, 5)", h)
    account = f"transform(transform(array({body}), b -> named_struct('b', b, 'm', {_mod97(f"concat(b, left({norm}, 2), '00')")})), y -> concat(left({norm}, 2), lpad(98 - y.m, 2, '0'), y.b))"
    spaced = f"transform({account}, d -> array_join(transform(split({v}, ''), (c, i) -> case when c = ' ' then c else substring(d, length(replace(left({v}, i + 1), ' ', '')), 1) end), ''))[0]"
    iban = f"case when {_mod97(f'concat(substring({norm}, 5), left({norm}, 4))')} <> 1 then {v} else {spaced} end"
    head, tail = f"regexp_extract({v}, '^-----[A-Z ]+-----', 0)", f"regexp_extract({v}, '(-----END[A-Z ]+-----)?$', 0)"
    inner = f"regexp_replace(substring({v}, length({head}) + 1, length({v}) - length({head}) - length({tail})), '\\\\\\\\n', '\\n')"
    private = f"concat({head}, {_like(inner, h, cased=True)}, {tail})"
    octets = "concat_ws('.', " + ", ".join(f"cast({_byte(h, str(3 * k))} % 254 + 1 as string)" for k in range(4)) + ")"
    ip4 = f"case when exists(split({v}, '[.]'), o -> cast(o as int) > 255) then {v} else {octets} end"
    fifteen = f"concat(left({norm}, 1), {_digits(h, 14)})"
    ip = f"case when {v} like '%:%' then {ip6} else {ip4} end"
    sep = f"case when {v} like '%-%' then '-' when {v} like '% %' then ' ' else '' end"
    grouped = f"transform(array(concat({fifteen}, {_luhn(fifteen)})), d -> concat_ws({sep}, substring(d, 1, 4), substring(d, 5, 4), substring(d, 9, 4), substring(d, 13, 4)))[0]"
    card = f"case when right({norm}, 1) <> {_luhn(norm)} then {v} else {grouped} end"
    access = "concat('AKIA', " + ", ".join(f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_byte(h, str(k))} % 32 + 1, 1)" for k in range(16)) + ")"
    secret = f"concat(left({v}, length({v}) - length({norm})), {_like(norm, h, cased=True)}, case when {attempt} >= {LONGER} then substring({h}, 65, least(2 * ({attempt} - {LONGER} + 1), 60)) else '' end)"
    if attempts is None:
        name = _name_word(v, f"right({kind}, 1)", key, attempt, digits)
    else:
        again = f"transform({_name_parts(v)}, y -> named_struct('kind', y.kind, 'v', y.v, 'a', {attempts('y.kind', 'y.norm')}))"
        name = f"concat({_front(v)}, array_join(transform({again}, w -> case when w.v {_INITIAL} then w.v else {_name_word('w.v', 'right(w.kind, 1)', key, 'w.a', digits)} end), ' '))"
    return f"case {kind} when 'email' then {email} when 'phone' then {phone} when 'ssn' then {ssn} when 'ip' then {ip} when 'card' then {card} when 'iban' then {iban} when 'private_key' then {private} when 'key' then {access} when 'secret' then {secret} else {name} end"


def _mentions(text: str) -> str:
    """An array of (v, kind, norm) of a text's entities, in order."""
    found = f"case when {text} rlike {_quoted(HINT)} then regexp_extract_all({text}, {_quoted(ANY)}, 0) else array() end"
    return f"transform(transform({found}, v -> named_struct('v', v, 'kind', {kind_sql('v')})), x -> named_struct('v', x.v, 'kind', x.kind, 'norm', {norm_sql('x.v', 'x.kind')}))"


def entities_sql(text: str) -> str:
    """An array of (kind, norm, v) of a text's entities; a name is one for each of its words."""
    return f"flatten(transform({_mentions(text)}, x -> case when x.kind = 'name' then filter({_name_parts('x.v')}, y -> not y.v {_INITIAL}) else array(named_struct('kind', x.kind, 'norm', x.norm, 'v', x.v)) end))"


def redraws(docs: DataFrame, key: str, text: str = "text", digits: int = 128) -> DataFrame:
    """kind, norm, attempt of the entities whose first draws clash; others take attempt 0.

    Entities are distinct (kind, normal form) pairs, counted before they are
    shuffled. Those that share a surrogate draw again, but for the smallest, if no earlier
    round gave the surrogate away. A round handles only entities that drew in it.
    """
    entities = docs.select(F.explode(F.expr(entities_sql(f"`{text}`"))).alias("x")).groupBy("x.kind", "x.norm").agg(F.min("x.v").alias("v"))
    entities = written(entities, "entities")
    # A surrogate in its normal form, so that formats don't hide a clash. Within lambdas the long expression is
    # interpreted, which suits a few distinct entities; compiled, it costs the driver hundreds of MB.
    one = f"transform(array(named_struct('v', v, 'kind', kind, 'norm', norm, 'a', attempt, 'h', {_hash(key, 'kind', 'norm', 'attempt', digits)})), x -> {surrogate_sql('x.v', 'x.kind', 'x.norm', 'x.h', 'x.a', key, digits)})"
    norm = f"case when kind like 'name-%' then lower(x) else {norm_sql('x', 'kind')} end"
    real = entities.select("kind", F.col("norm").alias("s"))
    # what is left as it is takes no part: impossible addresses, cards and IBANs that fail their check, marks only
    left = (F.col("s") == F.col("norm")) & (F.col("kind").isin("ip", "card", "iban") | ~F.col("norm").rlike(r"[\p{L}0-9]"))
    active, given, moved, attempt, last, stuck = entities, [], [], 0, None, 0
    while True:
        drawn = active.withColumn("attempt", F.lit(attempt)).withColumn("s", F.expr(f"transform({one}, x -> {norm})[0]")).where(~left)
        drawn = written(drawn, "drawn")
        first = drawn.groupBy("kind", "s").agg(F.min("norm").alias("winner"))
        for earlier in given:
            first = first.join(earlier, ["kind", "s"], "left_anti")
        first = first.join(real, ["kind", "s"], "left_anti")
        won = written(first.select("kind", "s", F.col("winner").alias("norm")), "given")
        active = written(drawn.join(won, ["kind", "s", "norm"], "left_anti").select("kind", "norm", "v"), "clashing")
        n = active.count()
        if attempt:
            moved.append(won.select("kind", "norm", F.lit(attempt).alias("attempt")))
        if not n:
            break
        stuck = 0 if last is None or n < last else stuck + 1
        if stuck > STUCK:
            raise RuntimeError(f"{n} entities find no surrogate that is free: their formats are used up")
        given, attempt, last = [*given, won.select("kind", "s")], attempt + 1, n
    if not moved:
        return entities.select("kind", "norm", F.lit(0).alias("attempt")).limit(0)
    return reduce(DataFrame.unionByName, moved)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", digits: int = 128) -> tuple[DataFrame, str]:
    """docs with `text` replaced, and the name of a further column: an array of (kind, surrogate) in order of the text.

    Null and empty texts stay as they are; all other columns are kept, whatever their names; repeated rows get the
    same surrogates; an empty table stays empty.
    """
    x, found, known, row = spare_names(docs, "_x", "_found", "_redraws", "_row")
    again = redraws(docs, key, text, digits)
    n = again.limit(LITERAL_REDRAWS + 1).count()
    rows = docs.withColumn(x, F.expr(_mentions(f"`{text}`")))
    looked_up = lambda kind, norm: f"coalesce(try_element_at(`{known}`, concat({kind}, '|', {norm})), 0)"
    attempts = (lambda kind, norm: "0") if n == 0 else looked_up
    make = (
        f"transform(transform(transform(`{x}`, x -> named_struct('v', x.v, 'kind', x.kind, 'norm', x.norm, 'a', {attempts('x.kind', 'x.norm')})), x -> named_struct('v', x.v, 'kind', x.kind, 'norm', x.norm, 'a', x.a, 'h', {_hash(key, 'x.kind', 'x.norm', 'x.a', digits)})), "
        f"x -> named_struct('kind', x.kind, 'surrogate', {surrogate_sql('x.v', 'x.kind', 'x.norm', 'x.h', 'x.a', key, digits, attempts)}))"
    )
    if n == 0:
        rows = rows.withColumn(found, F.expr(make))
    elif n <= LITERAL_REDRAWS:
        held = again.collect()  # at most LITERAL_REDRAWS rows
        pairs = ", ".join(f"{_quoted(r['kind'] + '|' + r['norm'])}, {r['attempt']}" for r in held)
        rows = rows.withColumn(known, F.expr(f"map({pairs})")).withColumn(found, F.expr(make)).drop(known)
    else:
        rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "mentions")
        hits = rows.select(row, F.explode(F.expr(entities_sql(f"`{text}`"))).alias("e")).select(row, "e.kind", "e.norm").distinct().join(again, ["kind", "norm"])
        maps = hits.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "norm"), "attempt"))).alias(known))
        rows = rows.join(maps, row, "left").withColumn(found, F.expr(make)).drop(known, row)
    gaps = f"split(`{text}`, {_quoted(ANY)}, -1)"
    joined = f"case when size(`{found}`) = 0 then `{text}` else concat(array_join(zip_with(slice({gaps}, 1, size(`{found}`)), `{found}`, (g, f) -> concat(g, f.surrogate)), ''), element_at({gaps}, -1)) end"
    return rows.withColumn(text, F.expr(joined)).drop(x), found


def replace_personal_data(docs: DataFrame, key: str = "conceptloom", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities and the number of each kind; every row is returned.

    Nulls, empties, repeats and empty tables as in pseudonymised; other columns are ignored.
    """
    rows, found = pseudonymised(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), key)
    of = lambda kind: F.expr(f"size(filter(`{found}`, x -> x.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", "text", F.greatest(F.size(found), F.lit(0)).cast("long").alias("n_entities"), *[of(k) for k in KINDS])


def replace_in_documents(docs: DataFrame, key: str = "conceptloom") -> DataFrame:
    """The documents with surrogates; n_chars, if there is one, follows the new text."""
    out, found = pseudonymised(docs, key)
    out = out.drop(found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
