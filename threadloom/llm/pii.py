"""PII surrogates: keyed, type-consistent replacements, distinct and coreferent over the whole corpus."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, stored
from .encode import texts_of

# fixed values: given names by gender, family names, and titles by gender, for each script
GIVEN = {
    ("latin", "f"): "Alma Berta Clara Dora Edith Frida Greta Hanna Ida Jette Karin Lena Marta Nora Olga Petra Rita Sofia Tilda Vera".split(),
    ("latin", "m"): "Anton Bruno Conrad Dirk Emil Felix Georg Hugo Ivo Jonas Karl Leon Marco Nils Oskar Paul Ralf Simon Theo Viktor".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Лидия Мария Нина Ольга Полина Раиса Софья Тамара".split(),
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
}
FAMILY = {
    "latin": "Adler Becker Carver Dorn Elsner Fabian Garber Hollis Ingram Jansen Keller Lorenz Merten Norden Osborn Palmer Quist Reuter Sander Tilden Ulmer Verne Winter Yardley Zander".split(),
    "cyrillic": "Авдеев Белов Волков Громов Дубов Ершов Жуков Зимин Ильин Козлов Лосев Минин Носов Орлов Попов Рыков".split(),
}
TITLES = {"m": "Mr Herr Señor Sr Monsieur Signor Sir Г-н".split(), "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Signora Г-жа".split(), "": "Dr Prof".split()}
DEGREES = "h c med rer nat phil jur pol oec habil ing Ing".split()
PARTICLES = "von van vom zu zum zur der den dem de del della di da das do dos du la le las los ter ten al el bin ibn y e af av".split()
# fixed values: beginnings, vowels and ends of names that are built when the lists are too small
ONSETS = {"latin": "B D F G H K L M N P R S T V W Br Dr Gr Kl St".split(), "cyrillic": "Б В Г Д Ж З К Л М Н П Р С Т Ф Х Бр Гр Др Кр".split()}
VOWELS = {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split()}
ENDS = {
    ("latin", "f"): "la na ra sa lina rina nela tia via dora".split(), ("latin", "m"): "lo no ro lian nard rik tus ven bert mar".split(),
    ("latin", "family"): "ler ner man son ling berg mer stad ton wick".split(),
    ("cyrillic", "f"): "ла на ра лина рина лия ния рия та да".split(), ("cyrillic", "m"): "лан нат рад лий рий слав мир тин дим кар".split(),
    ("cyrillic", "family"): "лов нов ров лин нин рин ков тов сов дов".split(),
}

_TITLE = {form: g for g, own in TITLES.items() for t in own for form in (t, t.upper())}
_TITLED = "|".join(sorted(map(re.escape, _TITLE), key=len, reverse=True))
_PARTICLE = "|".join(form for p in sorted(PARTICLES, key=len, reverse=True) for form in (p, p.title()))
_DEGREE = "|".join(DEGREES)
_GAP = "[ \t\u00a0]"
# inner hyphens and apostrophes belong to a name, an 's at its end does not
_WORD = r"[^\W\d_](?:(?:['’](?![sS](?![^\W\d_]))|[‐‑-])?[^\W\d_])+"
_SIGNS = str.maketrans("’‐‑", "'--")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_KEYWORDS = "token|secret|password|passwd|passphrase|passwort|kennwort|pwd|contrase[ñÑ]a|mot de passe|senha|[пП][аА][рР][оО][лЛ][ьЬ]|api[_-]?key|access[_-]?key"
# earlier kinds win where spans overlap
DETECTORS = [
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?|[0-9a-f]{32,})(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[Bb](?:earer|EARER)\s{1,3}((?=[A-Za-z._~+/-]*\d)[A-Za-z0-9._~+/-]{12,}=*)")),
    ("secret", re.compile(rf"(?ia)(?<![A-Za-z])(?:{_KEYWORDS})\s{{0,3}}[=:]\s{{0,3}}[\"']?([A-Za-z0-9+/_.~!@#$%^&*-]{{6,}})")),
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)(?!\w)")),
    ("card", re.compile(r"(?<![\w+])(?<!\d[.,-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5})(?!\w|-\d)")),
    ("ip", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w)")),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,3}|\(\d{2,5}\) ?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)")),
    ("phone", re.compile(r"(?<![\w+./:,-])0\d{1,4}(?: ?[/-] ?| )\d{3,8}(?:[ -]\d{1,5}){0,2}(?![\w/]|[.,:-]\d)")),
    ("name", re.compile(rf"(?<!\w)(?:{_TITLED})(?:\.{_GAP}*|{_GAP}+)(?:(?:{_TITLED})(?:\.{_GAP}*|{_GAP}+)|(?:{_DEGREE})\.{_GAP}*)*(?:(?:{_PARTICLE}){_GAP}+)*(?=[^\W\d_])")),
]
_TITLE_WORD = re.compile(rf"(?<!\w)(?:{_TITLED})(?!\w)")
_NAME_WORD = re.compile(rf"{_GAP}*(?:({_WORD})|([^\W\d_])\.)")
# attempts in the format of the entity before the room is widened
TIGHT = 4
# every detector needs one of these in the text; each branch starts with the letters it can start with, which keeps a miss cheap
HINT = (
    rf"[\p{{Nd}}@]|[=:](?<=(?i:{_KEYWORDS})\s{{0,3}}[=:])|[a-f]{{32}}"
    rf"|(?=[Aspgxe])(?:AKIA[A-Z]{{16}}|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z_-]{{16}}|eyJ[A-Za-z_-]{{8}})"
    rf"|(?=[{''.join(sorted({t[0] for t in _TITLE}))}])(?<![\p{{L}}\p{{N}}_])(?:{_TITLED})(?:\.{_GAP}*|{_GAP}+)(?:(?:{_DEGREE})\.{_GAP}*)*(?:(?:{_PARTICLE}){_GAP}+)*[\p{{L}}&&[^\p{{Ll}}]]"
)


def script_of(word: str) -> str:
    first = word[:1]
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "latin" if first.lower() != first.upper() else "caseless"


def _iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _ip6_ok(value: str) -> bool:
    """A whole address with a digit; two short parts around :: are more often names of a program."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return any(map(str.isdigit, value)) and len([part for part in value.split(":") if part]) > 1


def _plausible(kind: str, found: str, value: str) -> bool:
    """What a pattern alone cannot tell."""
    if kind == "card":
        return _luhn(value) == 0 and len(set(value)) > 1
    if kind == "iban":
        return _iban_ok(value) and (found[0].isupper() or sum(map(str.isdigit, value)) >= 10)
    if kind == "ip6":
        return _ip6_ok(found)
    if kind == "phone" and found[0] == "0":
        return 9 <= len(value) <= 13
    return kind != "secret" or any(map(str.isalnum, value))  # else a mask or a ruler


def canonical(kind: str, found: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "phone":
        return ("+" if found[0] == "+" else "") + re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "").upper()
    if kind == "ip6":
        return ipaddress.IPv6Address(found).compressed
    return found if kind in ("secret", "ip") else found.lower()


def names_of(m: re.Match) -> list[tuple[int, int, str, str]]:
    """The given names, initials and the family name after a chain of titles.

    Particles stay as they are. The words end at the first one in lower case or
    the next title; the last one is the family name. A word of a script without
    case counts only directly after the title.
    """
    gender = next((g for t in _TITLE_WORD.findall(m[0]) if (g := _TITLE[t])), "")
    words: list[tuple[int, int, str]] = []
    at = m.end()
    while w := _NAME_WORD.match(m.string, at):
        g = 1 if w[1] else 2
        word, at = w[g], w.end()
        if g == 1 and word in PARTICLES:
            continue
        if word[0].islower() or word in _TITLE or (words and not word[0].isupper()):
            break
        words.append((w.start(g), w.end(g), word))
        if m.string[at : at + 1] not in (" ", "\t", "\u00a0") and g == 1:
            break
    spans = []
    full = [i for i, (_, _, word) in enumerate(words) if len(word) > 1]
    for i, (a, b, word) in enumerate(words):
        kind = "initial" if len(word) == 1 else "family" if i == full[-1] else f"given-{gender or 'u'}"
        spans.append((a, b, f"{kind}-{script_of(word)}", word.lower().translate(_SIGNS)))
    return spans


def mentions(text: str, names: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """All capitalised mentions of the names found in a text, as entities of the kind found first, one with a gender before others."""
    known: dict[str, str] = {}
    for _, _, kind, value in names:
        if not kind.startswith("initial") and (value not in known or (known[value].startswith("given-u") and kind.startswith("given"))):
            known[value] = kind
    out = [s for s in names if s[3] not in known]
    for w in re.finditer(rf"(?<!\w){_WORD}", text) if known else ():
        kind = known.get(w[0].lower().translate(_SIGNS))
        if kind and not w[0][0].islower():
            out.append((w.start(), w.end(), kind, w[0].lower().translate(_SIGNS)))
    return out


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, value) without overlaps, in order; given and family names are entities of their own."""
    spans: list[tuple[int, int, str, str]] = []
    names: list[tuple[int, int, str, str]] = []
    for kind, pattern in DETECTORS:
        for m in pattern.finditer(text):
            if kind == "name":
                names += names_of(m)
                continue
            g = 1 if kind == "secret" and pattern.groups else 0
            value = canonical(kind, m[g]) if kind != "ip6" or _ip6_ok(m[0]) else m[0]
            if not _plausible(kind, m[g], value):
                continue
            if kind == "secret" and g:  # a key inside a longer value would leave the rest of it
                spans = [s for s in spans if not (m.start(g) <= s[0] and s[1] <= m.end(g) and any(map(str.isalnum, text[m.start(g) : s[0]] + text[s[1] : m.end(g)])))]
            spans.append((m.start(g), m.end(g), kind, value))
    spans += mentions(text, names)
    if not spans:
        return []
    kept: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for s in spans:  # earlier detectors first
        if taken.find(1, s[0], s[1]) < 0:
            kept.append(s)
            taken[s[0] : s[1]] = b"\1" * (s[1] - s[0])
    return sorted(kept)


@lru_cache(maxsize=4096)
def _neighbours(block: int) -> str:
    """The letters without case in a block of 32 code points."""
    return "".join(x for x in map(chr, range(block * 32, block * 32 + 32)) if x.isalpha() and x.lower() == x.upper())


class Stream:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.block, self.have = hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.have) < 4:
            self.have += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        x, self.have = int.from_bytes(self.have[:4], "big"), self.have[4:]
        return x % n

    def like(self, text: str) -> str:
        """Characters of the same class: digit, case, and the block of letters they come from."""
        out = []
        for c in text:
            if c.isascii():
                out.append(str(self.below(10)) if c.isdigit() else chr((97 if c.islower() else 65) + self.below(26)) if c.isalpha() else c)
            elif "а" <= c.lower() <= "я":
                x = chr(ord("а") + self.below(32))
                out.append(x if c.islower() else x.upper())
            elif "α" <= c.lower() <= "ω":
                x = "αβγδεζηθικλμνξοπρστυφχψω"[self.below(24)]
                out.append(x if c.islower() else x.upper())
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha() and c.upper() != c.lower():
                x = chr(97 + self.below(26))
                out.append(x if c.islower() else x.upper())
            elif "一" <= c <= "鿿":
                out.append(chr(0x4E00 + self.below(0x5000)))
            elif c.isalpha():  # scripts without case
                own = _neighbours(ord(c) // 32)
                out.append(own[self.below(len(own))])
            else:
                out.append(c)
        return "".join(out)


def _luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def candidate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate of an entity at one attempt, in canonical form.

    The first ``TIGHT`` attempts keep the format; each later one has a sign more
    (an address keeps an octet less first), so that the room has no end.
    """
    s = Stream(key, kind, value, attempt)
    wide = max(0, attempt - TIGHT + 1)
    if kind.startswith("initial"):  # the alphabet turned by a keyed number of places: distinct, never itself
        low, size = ("а", 32) if kind.endswith("cyrillic") else ("a", 26)
        turn = 1 + Stream(key, "initial").below(size - 1)
        return chr(ord(low) + (ord(value) - ord(low) + turn) % size) if 0 <= ord(value) - ord(low) < size else s.like(value)
    if kind.startswith(("given", "family")):
        part, *gender, script = kind.split("-")
        if script == "caseless":
            return s.like(value + value[-1:] * wide)
        if part == "given":
            sex = gender[0] if gender[0] != "u" else "fm"[s.below(2)]
            pool, ends, female = GIVEN[script, sex], ENDS[script, sex], ""
        else:
            pool, ends, female = FAMILY[script], ENDS[script, "family"], "а" if script == "cyrillic" and value.endswith(("а", "я")) else ""
        if attempt < 2:
            return pool[s.below(len(pool))] + female
        # names built of syllables, one more with each attempt, so that the room has no end
        built = "".join(ONSETS[script][s.below(20)] + VOWELS[script][s.below(5)] for _ in range(attempt - 1)) + ends[s.below(len(ends))]
        return built.capitalize() + female
    if kind == "card":
        body = value[0] + s.like(value[1:-1] + "0" * wide)
        fitting = [d for d in range(10) if (_luhn(body + str(d)) == 0) == (_luhn(value) == 0)]
        return body + str(fitting[s.below(len(fitting))])
    if kind == "iban":
        body = value[:2] + "00" + s.like(value[4:] + "0" * wide)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return f"{body[:2]}{check:02d}{body[4:]}"
    if kind == "ip":
        octets = value.split(".")
        held = 2 if octets[0] in ("172", "192") else 1 if octets[0] in ("10", "127") else 0
        kept = octets[: max(0, held - -(-wide // TIGHT))] or [str(1 + s.below(223))]
        return ".".join([*kept, *(str(1 + s.below(254)) for _ in range(4 + max(0, wide - 2 * TIGHT) - len(kept)))])
    if kind == "ip6":
        own = ipaddress.IPv6Address(value).exploded.split(":")
        held = max(0, 2 - wide)
        return ipaddress.IPv6Address(":".join([*own[:held], *(f"{1 + s.below(65535):x}" for _ in own[held:])])).compressed
    if kind == "phone":
        lead = 2 if value[0] == "+" else 1 if value[0] == "0" else 0
        return value[:lead] + (str(1 + s.below(9)) if len(value) > lead else "") + s.like(value[lead + 1 :] + "0" * wide)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        *hosts, top = domain.split(".")
        return f"{s.like(local + 'a' * wide)}@{'.'.join(s.like(h) for h in hosts)}.{top}"
    if kind == "secret":
        lead = re.match(r"AKIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]", value)
        head = lead[0] if lead else ""
        if re.fullmatch(r"[0-9a-f]+", value):
            return "".join("0123456789abcdef"[s.below(16)] for _ in value + "0" * wide)
        return head + s.like(value[len(head) :] + ("A" if head == "AKIA" else "a") * wide)
    return s.like(value + "0" * wide)


def render(kind: str, found: str, surrogate: str) -> str:
    """The surrogate in the format of this mention."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(surrogate.lstrip("+"))
        return "".join([*(next(digits) if c.isdigit() else c for c in found), *digits])
    if kind == "iban":
        signs = iter(surrogate)
        mention = "".join([*(c if c == " " else next(signs) for c in found), *signs])
        return mention if found[0].isupper() else mention.lower()
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(found, surrogate)) if len(found) == len(surrogate) else surrogate
    if kind == "ip6":
        return surrogate.upper() if found.upper() == found else surrogate
    if kind.startswith("initial"):
        return surrogate.upper()
    if kind.startswith(("given", "family")):
        return surrogate.upper() if len(found) > 1 and found.isupper() else surrogate
    return surrogate


def _candidates(key: bytes):
    @F.pandas_udf("string")
    def give(kind, value, attempt):
        import pandas as pd

        return pd.Series([candidate(key, k, v, int(a)) for k, v, a in zip(kind, value, attempt)], dtype=object)

    return give


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two values share one, none is a real value.

    Rounds on the entity table: each open entity proposes its next candidate;
    one that is a real value, is taken, or is proposed by a smaller value too
    goes on to the next round. The room of a format grows with the attempt, so
    the rounds end.
    """
    entities = stored(entities.select("kind", "value").distinct(), "entities")
    real = entities.select("kind", F.lower("value").alias("folded")).distinct()
    open_ = entities.withColumn("attempt", F.lit(0))
    done = None
    while True:
        proposed = stored(open_.withColumn("surrogate", _candidates(key)("kind", "value", "attempt")).withColumn("folded", F.lower("surrogate")), "proposed")
        free = proposed.join(real, ["kind", "folded"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", F.lower("surrogate").alias("folded")), ["kind", "folded"], "left_anti")
        won = stored(free.groupBy("kind", "folded").agg(F.min_by("surrogate", "value").alias("surrogate"), F.min("value").alias("value")).select("kind", "value", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        rest = proposed.join(won.select("kind", "value"), ["kind", "value"], "left_anti")
        open_ = stored(rest.select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "open-entities")
        if open_.isEmpty():
            return done


def may_hold(text: Column) -> Column:
    """Native test that every text with an entity passes."""
    return F.coalesce(text.rlike(HINT), F.lit(False))


SPANS = "array<struct<start:int,stop:int,kind:string,value:string>>"


def scanned(docs: DataFrame, own: list[str]) -> DataFrame:
    """The texts that pass the native test: the ``own`` columns, the text, and (by doc, by text, spans)."""

    def scan(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            found = [[dict(zip(("start", "stop", "kind", "value"), s)) for s in detect(t)] for t in texts_of(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "spans"])

    rows = docs.filter(may_hold(F.col("text"))).select(*own, F.col("doc_id").alias("by doc"), F.xxhash64("text").alias("by text"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, scan, f"{fields}, spans {SPANS}")


def replace_pii(docs: DataFrame, key: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with (text, n_entities): each entity in the text replaced by its surrogate.

    Entities: e-mail and IP addresses (both versions), phone numbers, card
    numbers with their check digit, IBAN and social security numbers, secrets,
    and the names after a chain of titles: given names, initials and the family
    name apart, with all later and earlier mentions of these names in the same
    text that are capitalised. A
    surrogate depends on ``key``, the kind and the value only, so the same
    entity reads the same everywhere (a number also across its formats), and it
    keeps the kind's format: digits, case and letters of the script, the country
    and check digits of an IBAN, the check digit state of a card, the gender
    and script of a name, the prefix of a secret, the top-level domain. Two
    entities never share a surrogate and no surrogate is a real value of its
    kind in the corpus. Where a format has too little room for that, surrogates
    get more signs (addresses keep fewer octets). Values of ``password=`` and the
    like without a letter or digit are masks, not secrets.

    Initials turn by a keyed number of letters, so they are distinct and never
    themselves, but not unlike all real ones.

    The native test runs where texts are scanned and where the others pass; the
    texts it lets through are few, stored with their entities, and alone are
    shuffled, by document. A null text stays null, an empty one empty, a very
    long one is scanned whole, repeated rows are each replaced, a null
    ``doc_id`` is kept, an empty table gives no rows; columns outside ``keep``
    may have any names, of those inside only ``text`` and ``n_entities`` clash.
    """
    own = [c for c in dict.fromkeys(keep) if c != "text"]
    rows = stored(scanned(docs, own), "pii-texts")
    found = rows.filter(F.size("spans") > 0).select("by doc", "by text", "spans").dropDuplicates(["by doc", "by text"])
    flat = stored(found.select(F.col("by doc").alias("of doc"), F.col("by text").alias("of text"), F.explode("spans").alias("s")).select("of doc", "of text", "s.*"), "pii-spans")
    turned = F.col("kind").startswith("initial")
    letters = flat.filter(turned).select("kind", "value").distinct().withColumn("surrogate", _candidates(key.encode())("kind", "value", F.lit(0)))
    given = stored(assign(flat.filter(~turned).select("kind", "value"), key.encode()).unionByName(letters), "pii-surrogates")
    swaps = flat.join(given, ["kind", "value"]).groupBy("of doc", "of text").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "surrogate"))).alias("swaps"))

    def apply(batches):
        for batch in batches:
            n = batch.num_columns
            texts = []
            for text, todo in zip(texts_of(batch.column(n - 2)), batch.column(n - 1).to_pylist()):
                at, parts = 0, []
                for s in todo or []:
                    parts += [text[at : s["start"]], render(s["kind"], text[s["start"] : s["stop"]], s["surrogate"])]
                    at = s["stop"]
                texts.append("".join([*parts, text[at:]]))
            counts = pc.fill_null(pc.list_value_length(batch.column(n - 1)), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(texts, pa.string()), counts], names=[*own, "text", "n_entities"])

    joined = rows.drop("spans").join(swaps, F.col("by doc").eqNullSafe(F.col("of doc")) & (F.col("by text") == F.col("of text")), "left")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    changed = map_arrow(joined.select(*own, "text", "swaps"), apply, f"{fields}, text string, n_entities int")
    rest = docs.filter(~may_hold(F.col("text"))).select(*own, "text", F.lit(0).alias("n_entities"))
    return rest.unionByName(changed)
