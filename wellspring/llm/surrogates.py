"""PII surrogates: detected entities get keyed, type-consistent replacements.

Emails, assigned secrets and key prefixes, IBANs (check digits right), IPv4 and IPv6 addresses, payment cards
(Luhn-valid digit runs), national numbers (ddd-dd-dddd), phones and person names (a title or a known first name before
capitalised words) are found by one expression. The replacement is a function of the key, the kind and the
normalised entity, so an entity gets the same surrogate wherever it occurs (coreference), in any of its formats:

* digits (phone, card, national number, IPv4, IBAN) go through a keyed Feistel permutation of all strings of
  that length, which cannot map two entities to one; punctuation stays, cards keep their first digit and
  end in a right Luhn digit, IBANs keep country and letters and get right check digits, phones keep the country
  code that the table of calling codes reads from their digits (ten-digit forms count as +1, 0d dd dd dd dd as +33);
* names keep title, particles, gender, script and case: known first names move along a keyed cycle through the list
  of their gender and script (no two meet, none stays), other parts are built from keyed syllables of their script,
  and a surname is the same with or without a first name;
* emails keep script, dots, digit count, top-level domain and case; secrets and IPv6 keep lengths and alphabets.

Collision check: the distinct entities of the corpus are mapped, and every kind must map to as many distinct
surrogates, none of which (names, emails, secrets, IPv6) is an entity of the corpus itself. Lengths of names and
emails start at what the count of entities needs; a kind that clashes is drawn anew, longer, until the check passes.

Everything is DataFrame expressions; one scan gathers distinct entities, one rewrites texts.

Defined results: a null text stays null with no entities; digit runs that fail the Luhn check stay, as do IBANs whose
check digits are wrong; of overlapping entities the first in the text counts, at one place the first kind of ``KINDS``' pattern;
very long texts are searched whole; repeated rows get equal results; an empty table gives an empty result; ``replace``
keeps extra columns, but for those named like its counts (n_<kind>), which its own replace.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

KEY = "wellspring"

# Name lists by gender and script, titles by gender, syllables by script.
FEMALE = "Anna Maria Emma Olivia Sophia Laura Julia Sarah Claire Camille Marie Lucia Carmen Elena Greta Ingrid Hannah Alice Nora Clara".split()
MALE = "John James Robert Michael David Thomas Peter Paul Jean Pierre Carlos Miguel Diego Hans Klaus Jonas Lukas Daniel Martin Oscar".split()
FEMALE_CYR = "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Юлия".split()
MALE_CYR = "Иван Сергей Алексей Дмитрий Николай Андрей Михаил Павел Виктор Олег".split()
TITLES_F = "Mrs Ms Miss Frau Mme Señora Sra".split()
TITLES_M = "Mr Herr Señor Sr".split()
TITLES_N = "Dr Prof".split()
PARTICLES = "von van der den de del la da di dos le".split()
LATIN = "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve vi wa".split()
CYRILLIC = "ба бе би бо ва ве ви во га го да де ди до ка ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се со та те то".split()

L, D = r"\p{L}", r"\p{N}"
EMAIL = rf"(?<![{L}{D}._%+\-])[{L}{D}._%+\-]++@[{L}{D}\-]+(?:\.[{L}{D}\-]+)*\.{L}{{2,}}"
SECRET = r"(?i:(?<![\p{L}\p{N}])(?:token|api[_-]?key|secret|password|passwd|pwd)\s*[=:]\s*[\"']?[A-Z0-9_\-/+]{16,})"
PREFIXES = r"sk-(?:proj-)?|AKIA|ASIA|ghp_|gho_|xox[abp]-|AIza"
TOKEN = rf"(?<![{L}{D}_\-])(?:sk-(?:proj-)?[A-Za-z0-9_\-]{{20,}}|(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[po]_[A-Za-z0-9]{{36}}|xox[abp]-[A-Za-z0-9\-]{{12,}}|AIza[A-Za-z0-9_\-]{{35}})(?![{L}{D}_])"
IBAN = rf"(?<![{L}{D}])[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)(?![{L}{D}])"
IP6 = r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{6})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])\+33[ .\-]?[1-9](?:[ .\-]?[0-9]{2}){4}(?![0-9])|(?<![0-9.+\-])0[1-9](?:[ .\-][0-9]{2}){4}(?!\.?[0-9])|(?<![0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?!\.?[0-9])|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])"
NATIONAL = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
FIRST = "|".join(FEMALE + MALE + FEMALE_CYR + MALE_CYR)
TITLE = "|".join(TITLES_F + TITLES_M + TITLES_N)
FIRST_CAPS = "|".join(x.upper() for x in FEMALE + MALE + FEMALE_CYR + MALE_CYR)
GIVEN = rf"(?:{FIRST})(?:-(?:{FIRST}))?"
SURNAME = rf"\p{{Lu}}(?:['’]\p{{Lu}})?{L}*\p{{Ll}}{L}*(?:-\p{{Lu}}{L}+)?"
BEFORE = rf"(?:\p{{Lu}}\. )*(?:(?:{'|'.join(PARTICLES)}) )*"
NAMED = rf"(?:{GIVEN} )+{BEFORE}{SURNAME}"
NAME = rf"(?<![{L}{D}])(?=\p{{Lu}})(?:(?:{TITLE})\.? (?:{NAMED}|{BEFORE}{SURNAME}(?: {SURNAME})?)|{NAMED}|(?:{FIRST_CAPS}) \p{{Lu}}{{2,}}(?:-\p{{Lu}}{{2,}})?)(?![{L}{D}])"
ANY = "|".join([EMAIL, SECRET, TOKEN, IBAN, IP6, IP, PHONE, NATIONAL, CARD, NAME])
MAYBE = rf"[0-9@=:]|(?=\p{{Lu}})(?:(?:{TITLE})\.?|{FIRST}|{FIRST_CAPS})[ -]|(?:sk-|gh[po]_|xox|AIza)"
# Calling codes of one and two digits; all others have three.
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
KINDS = ["email", "secret", "ip", "phone", "national", "card", "name", "iban", "ip6"]
DRAWN = ("name", "email", "secret", "ip6")  # not permutations: checked, and drawn anew where they clash


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(xs: list[str]) -> str:
    return "array(" + ", ".join(map(_q, xs)) + ")"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _full(pattern: str) -> str:
    return _q(rf"^(?:{pattern})$")


def luhn_sum(d: str) -> str:
    """Luhn sum of a digit string without its check digit (rightmost counts double)."""
    x = "CAST(c AS INT) * (1 + (i + 1) % 2)"
    return f"aggregate(transform(split(reverse({d}), ''), (c, i) -> {_let(x, 'v', 'v - 9 * CAST(v > 9 AS INT)')}), 0, (s, v) -> s + v)"


def mod97(x: str) -> str:
    """An IBAN's number modulo 97: letters count as 10 to 35, the first four characters stand last."""
    digit = "IF(c BETWEEN '0' AND '9', CAST(c AS BIGINT), CAST(ascii(c) - 55 AS BIGINT))"
    step = _let(digit, "v", "(s * IF(v > 9, 100, 10) + v) % 97")
    return f"aggregate(filter(split(concat(substr({x}, 5), left({x}, 4)), ''), c -> c != ''), 0L, (s, c) -> {step})"


def kind_of(e: str) -> str:
    """The kind of an entity found by ANY; null for a number whose check digits are wrong."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    ok = _let(digits, "d", f"({luhn_sum('substr(d, 1, length(d) - 1)')} + CAST(right(d, 1) AS INT)) % 10 = 0")
    right = _let(f"replace({e}, ' ', '')", "d", f"{mod97('d')} = 1")
    return (
        f"CASE WHEN rlike({e}, {_full(EMAIL)}) THEN 'email' WHEN rlike({e}, {_full(SECRET)}) OR rlike({e}, {_full(TOKEN)}) THEN 'secret' "
        f"WHEN rlike({e}, {_full(IBAN)}) THEN CASE WHEN {right} THEN 'iban' END WHEN rlike({e}, {_full(IP6)}) THEN 'ip6' WHEN rlike({e}, {_full(IP)}) THEN 'ip' "
        f"WHEN rlike({e}, {_full(PHONE)}) THEN 'phone' WHEN rlike({e}, {_full(NATIONAL)}) THEN 'national' "
        f"WHEN rlike({e}, {_full(CARD)}) THEN CASE WHEN {ok} THEN 'card' END WHEN rlike({e}, {_full(NAME)}) THEN 'name' END"
    )


def kept_digits(e: str, y: str) -> str:
    """How many leading digits y of a phone number e stay: its calling code, a trunk 0, or none."""
    return f"CASE WHEN {e} LIKE '+%' THEN length(regexp_extract({y}, '^({CALLING})', 1)) WHEN {y} LIKE '0%' AND rlike({e}, '^0[1-9][ .-]') THEN 1 ELSE 0 END"


def title_of(e: str) -> str:
    return f"regexp_extract({e}, {_q(rf'^(?:({TITLE})(\.?) )?')}, 0)"


def norm_of(e: str, k: str) -> str:
    """What makes two mentions one entity: international digits of phones, digits of numbers, lower-cased emails,
    addresses and untitled names, the value of a secret."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    phone = _let(digits, "y", f"CASE WHEN {e} LIKE '+%' THEN y WHEN {kept_digits(e, 'y')} = 1 THEN concat('33', substr(y, 2)) ELSE concat('1', y) END")
    return f"CASE {k} WHEN 'phone' THEN {phone} WHEN 'national' THEN {digits} WHEN 'card' THEN {digits} WHEN 'iban' THEN replace({e}, ' ', '') WHEN 'email' THEN lower({e}) WHEN 'ip6' THEN lower({e}) WHEN 'secret' THEN {value_of(e)} WHEN 'name' THEN lower(substr({e}, length({title_of(e)}) + 1)) ELSE {e} END"


def value_of(e: str) -> str:
    """The random part of a secret: after the sign of assignment or the key prefix."""
    return f"regexp_extract({e}, {_q(rf'(?:[=:]\s*["\']?(?:{PREFIXES})?|^(?:{PREFIXES}))([A-Za-z0-9_/+-]+)$')}, 1)"


def _number(key: str, *of: str) -> str:
    """A keyed 52-bit number."""
    return f"CAST(conv(substr(sha2(concat_ws(':', {_q(key)}, {', '.join(of)}), 256), 1, 13), 16, 10) AS BIGINT)"


def _permute(key: str, tag: str, d: str) -> str:
    """A keyed permutation of the digit strings as long as d (2 to 36 digits): six Feistel rounds."""
    step = f"named_struct('a', s.b, 'b', pmod(s.a + {_number(key, _q(tag), 'CAST(length(d) AS STRING)', 'CAST(r AS STRING)', 'CAST(s.b AS STRING)')}, CAST(rpad('1', 1 + IF(r % 2 = 0, u, length(d) - u), '0') AS BIGINT)))"
    body = _let("CAST(length(d) / 2 AS INT)", "u", f"aggregate(sequence(0, 5), named_struct('a', CAST(substr(d, 1, u) AS BIGINT), 'b', CAST(substr(d, u + 1) AS BIGINT)), (s, r) -> {step}, s -> concat(lpad(CAST(s.a AS STRING), u, '0'), lpad(CAST(s.b AS STRING), length(d) - u, '0')))")
    return _let(d, "d", body)


def _into(e: str, digits: str) -> str:
    """e with its digits replaced in order by those of ``digits``."""
    step = "IF(rlike(c, '[0-9]'), named_struct('o', concat(s.o, substr(x, s.k + 1, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k))"
    return _let(digits, "x", f"aggregate(split({e}, ''), named_struct('o', '', 'k', 0), (s, c) -> {step}, s -> s.o)")


def _word(key: str, tag: str, of: str, n: int) -> str:
    """n keyed syllables in the script of ``of``."""
    pick = lambda xs: f"array_join(transform(sequence(1, {n}), i -> element_at({_array(xs)}, CAST({_number(key, _q(tag), 'o', 'CAST(i AS STRING)')} % {len(xs)} AS INT) + 1)), '')"
    return _let(of, "o", f"IF(rlike(o, '\\\\p{{IsCyrillic}}'), {pick(CYRILLIC)}, {pick(LATIN)})")


def surrogate(e: str, k: str, key: str, sizes: dict[str, int]) -> str:
    """SQL for the replacement of entity e of kind k."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    phone = _let(digits, "y", _let(kept_digits(e, "y"), "p", _into(e, f"concat(substr(y, 1, p), {_permute(key, 'phone', 'substr(y, p + 1)')})")))
    card = _let(digits, "y", _let(f"concat(substr(y, 1, 1), {_permute(key, 'card', 'substr(y, 2, length(y) - 2)')})", "b", _into(e, f"concat(b, CAST((10 - {luhn_sum('b')} % 10) % 10 AS STRING))")))
    national = _into(e, _permute(key, "national", digits))
    bare = _let(f"replace({e}, ' ', '')", "b", _let(f"concat(left(b, 2), '00', substr(b, 5))", "z", _let(_into("z", f"concat('00', {_permute(key, 'iban', "regexp_replace(substr(z, 5), '[^0-9]', '')")})"), "w", f"concat(left(w, 2), lpad(CAST(98 - {mod97('w')} AS STRING), 2, '0'), substr(w, 5))")))
    iban = _let(bare, "w", f"aggregate(split({e}, ''), named_struct('o', '', 'k', 0), (s, c) -> IF(c = ' ', named_struct('o', concat(s.o, c), 'k', s.k), named_struct('o', concat(s.o, substr(w, s.k + 1, 1)), 'k', s.k + 1)), s -> s.o)")
    hexes = f"array_join(transform(split({e}, ':'), (g, i) -> IF(g = '', '', array_join(transform(sequence(1, length(g)), j -> substr('{{hex}}', CAST({_number(key, _q('ip6'), _q(str(sizes['ip6'])), f'lower({e})', 'CAST(i AS STRING)', 'CAST(j AS STRING)')} % 16 AS INT) + 1, 1)), ''))), ':')"
    ip6 = f"IF({e} = upper({e}), {hexes.format(hex='0123456789ABCDEF')}, {hexes.format(hex='0123456789abcdef')})"
    octets = f"transform(split({e}, '[.]'), v -> CAST(v AS BIGINT))"
    half = f"named_struct('a', s.b, 'b', pmod(s.a + {_number(key, _q('ip'), 'CAST(r AS STRING)', 'CAST(s.b AS STRING)')}, 65536L))"
    ip = _let(octets, "o", f"aggregate(sequence(0, 5), named_struct('a', o[0] * 256 + o[1], 'b', o[2] * 256 + o[3]), (s, r) -> {half}, s -> concat_ws('.', CAST(s.a DIV 256 AS STRING), CAST(s.a % 256 AS STRING), CAST(s.b DIV 256 AS STRING), CAST(s.b % 256 AS STRING)))")
    local, domain = f"substring_index(lower({e}), '@', 1)", f"substring_index(lower({e}), '@', -1)"
    tail = f"CASE WHEN rlike(l, '[0-9]') THEN lpad(CAST({_number(key, _q('digits'), 'l', 'h')} % CAST(rpad('1', 1 + least(length(regexp_replace(l, '[^0-9]', '')), 9), '0') AS BIGINT) AS STRING), least(length(regexp_replace(l, '[^0-9]', '')), 9), '0') ELSE '' END"
    mail = _let(local, "l", _let(domain, "h", f"concat({_word(key, 'mail', 'concat(l, chr(64), h)', sizes['email'])}, IF(l LIKE '%.%', '.', ''), {tail}, '@', {_word(key, 'host', 'h', 3)}, '.example.', substring_index(h, '.', -1))"))
    mail = _let(mail, "m", f"IF({e} = upper({e}), upper(m), m)")
    value = value_of(e)
    alphabet = "IF(rlike(v, '^[0-9a-f]+$'), '0123456789abcdef', IF(rlike(v, '^[0-9A-F]+$'), '0123456789ABCDEF', IF(rlike(v, '^[0-9A-Z]+$'), '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')))"
    chars = _let(alphabet, "z", f"array_join(transform(sequence(1, length(v)), i -> substr(z, CAST({_number(key, _q('secret'), _q(str(sizes['secret'])), 'v', 'CAST(i AS STRING)')} % length(z) AS INT) + 1, 1)), '')")
    secret = _let(value, "v", f"concat(left({e}, length({e}) - length(v)), {chars})")
    given = " ".join(f"WHEN map_contains_key({m}, g) THEN element_at({m}, g)" for m in (_cycle(key, xs) for xs in (FEMALE, MALE, FEMALE_CYR, MALE_CYR)))
    part = lambda tag: f"array_join(transform(split(p, '-'), w -> initcap({_word(key, tag, 'lower(w)', sizes['name'])})), '-')"
    inner = _let("initcap(lower(p))", "g", f"CASE {given} WHEN length(p) < 3 OR lower(p) = p THEN p WHEN p LIKE '%-%' THEN array_join(transform(split(p, '-'), w -> {_let('initcap(lower(w))', 'g', f'CASE {given} ELSE w END')}), '-') ELSE {part('given')} END")
    words = f"split(substr({e}, length(t) + 1), ' ')"
    name = _let(title_of(e), "t", _let(words, "ws", f"concat(t, array_join(transform(ws, (p, i) -> IF(i = size(ws) - 1, {part('last')}, {inner})), ' '))"))
    name = _let(name, "m", f"IF({e} = upper({e}), upper(m), m)")
    return f"CASE {k} WHEN 'email' THEN {mail} WHEN 'secret' THEN {secret} WHEN 'ip' THEN {ip} WHEN 'phone' THEN {phone} WHEN 'national' THEN {national} WHEN 'card' THEN {card} WHEN 'name' THEN {name} WHEN 'iban' THEN {iban} WHEN 'ip6' THEN {ip6} ELSE {e} END"


def _cycle(key: str, names: list[str]) -> str:
    """SQL map of every name of a list to the next in a keyed order: one cycle, so none meets another or stays."""
    order = sorted(names, key=lambda x: hashlib.sha256(f"{key}:{x}".encode()).hexdigest())
    return "map(" + ", ".join(f"{_q(a)}, {_q(b)}" for a, b in zip(order, order[1:] + order[:1])) + ")"


def found(text: Column) -> Column:
    """All entity candidates of a text in order; texts without a telling character are not searched."""
    some = F.expr(f"regexp_extract_all(_text, {_q(ANY)}, 0)")
    return F.when(F.coalesce(text.rlike(MAYBE), F.lit(False)), some).otherwise(F.array().cast("array<string>"))


def sizes_for(counts: dict[str, int]) -> dict[str, int]:
    """Syllables for names and emails such that few clashes are expected among so many entities; first draws of the others."""
    need = lambda n: max(3, math.ceil(math.log(max(n, 1) ** 2 * 5, 40)))
    return {k: need(counts.get(k, 0)) if k in ("name", "email") else 0 for k in DRAWN}


def clashing(entities: DataFrame, key: str, sizes: dict[str, int]) -> set[str]:
    """Kinds of which two entities share a surrogate, or a drawn surrogate is an entity of the corpus."""
    s = entities.select("kind", "norm", F.expr(norm_of(f"({surrogate('entity', 'kind', key, sizes)})", "kind")).alias("s")).distinct()
    twice = s.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind")
    met = s.filter(F.col("kind").isin(*DRAWN)).join(entities.select("kind", F.col("norm").alias("s")), ["kind", "s"], "left_semi").select("kind")
    return {r[0] for r in twice.union(met).distinct().collect()}


def checked_sizes(entities: DataFrame, key: str) -> dict[str, int]:
    """Draws under which distinct entities (kind, norm, entity) of every kind keep distinct whole surrogates."""
    sizes = sizes_for({r["kind"]: r["n"] for r in entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()})
    for _ in range(20):
        bad = clashing(entities, key, sizes)
        if not bad:
            return sizes
        if bad - set(DRAWN):
            raise RuntimeError(f"surrogates of {sorted(bad)} clash")
        sizes |= {k: sizes[k] + 1 for k in bad}
    raise RuntimeError("surrogates still clash")


def with_entities(docs: DataFrame, text: Column) -> DataFrame:
    """docs with _text and _e: array of (entity, kind), kind null where it stays."""
    d = docs.withColumn("_text", text).withColumn("_a", found(F.col("_text")))
    return d.withColumn("_e", F.expr(f"transform(_a, e -> named_struct('entity', e, 'kind', {kind_of('e')}))")).drop("_a")


def rewrite(docs: DataFrame, text: Column, key: str, sizes: dict[str, int]) -> DataFrame:
    """docs with _new (the rewritten text) and n_<kind> counts."""
    d = with_entities(docs, text)
    pieces = f"split(_text, {_q(ANY)}, -1)"
    put = f"transform(_e, ent -> {surrogate('ent.entity', 'ent.kind', key, sizes)})"
    new = f"CASE WHEN exists(_e, x -> x.kind IS NOT NULL) THEN array_join(flatten(zip_with({pieces}, {put}, (a, b) -> array(a, coalesce(b, '')))), '') ELSE _text END"
    d = d.withColumn("_new", F.expr(new))
    return d.withColumns({f"n_{k}": F.expr(f"CAST(size(filter(_e, x -> x.kind = '{k}')) AS BIGINT)") for k in KINDS}).drop("_text", "_e")


def distinct_entities(docs: DataFrame, text: Column) -> DataFrame:
    e = with_entities(docs.select(text.alias("_t")), F.col("_t")).select(F.explode("_e").alias("x")).select(F.col("x.kind").alias("kind"), F.col("x.entity").alias("entity")).filter(F.col("kind").isNotNull())
    e = e.withColumn("norm", F.expr(norm_of("entity", "kind")))
    return e.groupBy("kind", "norm").agg(F.min("entity").alias("entity"))


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with surrogates in its text column, then entity counts by kind (n_<kind>)."""
    cols = [c for c in docs.columns if c not in {f"n_{k}" for k in KINDS}]
    d = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)])
    t = F.col(f"_c{cols.index(text_col)}")
    sizes = checked_sizes(scratch.table(distinct_entities(d, t), "entities"), key)
    out = rewrite(d, t, key, sizes)
    return out.select(*[(F.col("_new") if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(cols)], *[f"n_{k}" for k in KINDS])


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: doc_id, the rewritten text, entities in all and by kind, and whether the text changed."""
    docs = scratch.docs_of(spark, sf_dir).select("doc_id", "text")
    out = replace(docs)
    total = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
    return out.select("doc_id", "text", total.alias("n_entities"), *[f"n_{k}" for k in KINDS], (total > 0).alias("changed"))
