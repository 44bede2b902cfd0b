"""Private data replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, is_empty
from .chunks import Kept

#: Titles before names, by the gender that they tell.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "Господин", "г-н", "κύριος", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Doña", "госпожа", "Госпожа", "г-жа", "κυρία", "Κυρία"],
    "n": ["Dr", "Prof", "Professor", "доктор", "Доктор"],
}
#: Syllables of made-up names by script, and their ends by gender (s: of surnames).
SYLLABLES = {
    "latin": "ba be bi do du fa fe ga ha jo ka ke la le li lo ma me mi na ne no pa ra re ri ro sa se so ta te ti va ve".split(),
    "cyrillic": "ба ве га до зе ка ле ли ма ми на не по ра ро са та ти".split(),
    "greek": "βα γε δα ζω θε κα λε λι μα μι να νι πα ρα ρο σα τα τε".split(),
}
ENDS = {
    "latin": {"m": ["ndo", "rik", "tus", "mon"], "f": ["nna", "lia", "rine", "tta"], "n": ["ren", "lis"], "s": ["mann", "ner", "dal", "berg"]},
    "cyrillic": {"m": ["мир", "слав", "тон"], "f": ["нна", "лия", "рина"], "n": ["рин"], "s": ["ненко", "рук"]},
    "greek": {"m": ["νος", "ρης"], "f": ["νη", "ρία"], "n": ["νις"], "s": ["ράκης", "πουλος"]},
}
_GENDER = {x: g for g, ts in TITLES.items() for t in ts for x in (t, t.upper())}
#: Small words inside names, which stay; and names that are more often other words, of which only mentions beside another name count.
PARTICLES = "van von der den de del della di da dos du la le bin ter ten zu zum".split()
ORDINARY = "will may march april june august".split()
#: A capital of any alphabet, by its case in Unicode, then letters, also after apostrophes or hyphens.
_CAPITAL = "".join(c for c in map(chr, range(0x2000)) if c.isupper())
_NAME = f"(?:[{_CAPITAL}](?:[^\\W\\d_]|['’-](?=[^\\W\\d_])){{1,40}})"
_SMALL = f"(?:(?i:{'|'.join(PARTICLES)})[^\\S\\n]{{1,2}}){{0,3}}"
#: Between a title and a name: a period, or white space, or both; a line may end after a period.
_AFTER_TITLE = r"(?:\.[^\S\n]{0,3}\n?[^\S\n]{0,3}|[^\S\n]{1,3})"
_PATTERNS = (
    r"(?P<email>(?<![\w.+@-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))",
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)|(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d))",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    r"(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d))",
    r"(?P<phone>(?<![\w.])(?:\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}(?!\.\d)|0\d{4} \d{6}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4})(?![\w]))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<secret>(?<!\w)(?i:token|api[_-]?key|secret|password|passwd|pwd|access[_-]?key)[ \t]?[=:][ \t]?[\"']?(?P<value>(?=[+/=.~_-]*[^\W_])[\w+/=.~-]{8,}))",
    r"(?P<key>(?<!\w)(?i:AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-)(?=[_-]*[^\W_])[\w-]{16,}(?![\w]))",
    r"(?P<hex>(?<!\w)(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,}(?!\w))",
    rf"(?P<person>(?<!\w)(?P<title>{'|'.join(sorted(_GENDER, key=len, reverse=True))}){_AFTER_TITLE}(?P<name>{_SMALL}{_NAME}(?:[^\S\n]{{1,2}}{_SMALL}{_NAME}){{0,2}}))",
)
KINDS = ("email", "ip", "iban", "card", "phone", "ssn", "secret", "key", "hex", "person")
_FIND = re.compile("|".join(_PATTERNS))
#: What is replaced of a name: runs of two or more letters, so neither hyphens nor single letters at apostrophes (O'Brien, Keller's).
_RUN = re.compile(r"[^\W\d_]{2,}")
_ONE_NAME = re.compile(_NAME)
#: Each kind alone, for places where another's match is rejected.
_ALONE = dict(zip(KINDS, map(re.compile, _PATTERNS), strict=True))
#: What may follow numbers whose end is at a choice of spaces.
_ENDS = {"card": re.compile(r"(?![\w-]|\.\d)"), "phone": re.compile(r"(?!\w)"), "iban": re.compile(r"(?!\w)")}
#: A text without any of these has nothing to find.
_MAYBE = re.compile(rf"[0-9@]|(?<!\w)(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))}|(?i:token|key|secret|passw|pwd))")


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(doubled)) % 10 == 0


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _valid(kind: str, s: str) -> bool:
    digits = re.sub(r"\D", "", s)
    if kind == "ip" and ":" in s:
        try:
            return bool(ipaddress.IPv6Address(s))
        except ValueError:
            return False
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return luhn(digits) and digits[0] in "3456"
    if kind == "iban":
        return any(c.isdigit() for c in s[4:])
    return kind != "phone" or 7 <= len(digits) <= 15


def _at(text: str, m: re.Match) -> tuple[re.Match, str] | None:
    """(match, kind) of what stands at the match's start: itself, a shorter grouping of a number, or another kind's match there."""
    first = next(i for i, k in enumerate(KINDS) if m.group(k) is not None)
    for i, kind in enumerate(KINDS[first:]):
        x = m if i == 0 else _ALONE[kind].match(text, m.start())
        if x and _valid(kind, x.group()):
            return x, kind
        if x and kind in _ENDS:
            for end in range(x.end() - 1, x.start(), -1):
                shorter = text[end - 1].isalnum() and _ENDS[kind].match(text, end) and _ALONE[kind].fullmatch(text, x.start(), end)
                if shorter and _valid(kind, shorter.group()):
                    return shorter, kind
    return None


def _titled(text: str) -> Iterator[tuple[int, int, str, str, str | None]]:
    """(start, end, kind, entity, role) of what stands out by itself; role: of names given and gender (m, f, n), or family and gender."""
    at = 0
    while m := _FIND.search(text, at):
        place = _at(text, m)
        if place is None:
            at = m.start() + 1
            continue
        m, kind = place
        at = m.end()
        if kind == "person":
            gender, start = _GENDER[m["title"]], m.start("name")
            names = [n for n in _ONE_NAME.finditer(m["name"]) if n.group().lower() not in PARTICLES]
            for i, n in enumerate(names):
                for x in _RUN.finditer(n.group()):
                    yield start + n.start() + x.start(), start + n.start() + x.end(), f"name-{_script(x.group())}", x.group().lower(), ("family " if i == len(names) - 1 else "given ") + gender
        elif kind == "secret":
            yield m.start("value"), m.end("value"), "secret", m["value"].lower(), None
        else:
            s = m.group(kind)
            digits = re.sub(r"\D", "", s)
            entity = digits if kind in ("card", "phone", "ssn") else str(ipaddress.IPv6Address(s)) if kind == "ip" and ":" in s else re.sub(" ", "", s).lower()
            yield m.start(), m.end(), kind, entity, None


def _role(seen: set[str]) -> str:
    """A name's one role in a text, from those of its titled mentions: the gender where it is a given name anywhere, else s."""
    if not any(x.startswith("given") for x in seen):
        return "s"
    return next((g for place in ("given", "family") for g in "mf" if f"{place} {g}" in seen), "n")


def found(text: str) -> Iterator[tuple[int, int, str, str, str | None]]:
    """(start, end, kind, entity, role) of the private strings of a text, in order; the entity is in a form that all its mentions share.

    Each part of a person's name is an entity of its own, in lower case, whatever title it stands after; its role in the
    text (a given name's gender, or s for family names) comes from all its titled mentions there. Other capitalized
    mentions of these names in the text, before or after, without titles, are mentions of the same entities.
    """
    if not _MAYBE.search(text):
        return
    direct = list(_titled(text))
    seen: dict[str, set[str]] = {}
    for _, _, _, entity, role in direct:
        if role:
            seen.setdefault(entity, set()).add(role)
    if not seen:
        yield from direct
        return
    roles = {name: _role(x) for name, x in seen.items()}
    plain, at = [], 0  # direct mentions that end before are passed
    for m in _RUN.finditer(text):
        name = m.group().lower()
        while at < len(direct) and direct[at][1] <= m.start():
            at += 1
        if name in roles and m.group()[0].isupper() and not (at < len(direct) and direct[at][0] < m.end()):
            plain.append((m.start(), m.end(), f"name-{_script(name)}", name, None))
    if any(x in roles for x in ORDINARY):
        ends = {e: True for _, e, k, _, _ in direct if k.startswith("name-")} | {x[1]: True for x in plain if x[3] not in ORDINARY}
        starts = {s: True for s, _, k, _, _ in direct if k.startswith("name-")} | {x[0]: True for x in plain if x[3] not in ORDINARY}
        plain = [x for x in plain if x[3] not in ORDINARY or x[0] - 1 in ends and text[x[0] - 1] == " " or x[1] + 1 in starts and text[x[1]] == " "]
    for start, end, kind, entity, _ in sorted([*direct, *plain], key=lambda x: x[:2]):
        yield start, end, kind, entity, roles.get(entity) if kind.startswith("name-") else None


def iban_valid(s: str) -> bool:
    """Whether the check digits of an account number without spaces hold."""
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Surrogates:
    """Replacements by a key: the same entity always has the same one. attempts: entities whose first draws collided, with the draw to take."""

    def __init__(self, key: bytes):
        self.key = key

    def _stream(self, kind: str, entity: str, attempt: int) -> Iterator[int]:
        seed, n = f"{kind}\0{entity}\0{attempt}".encode(), 0
        while True:
            yield from hmac.new(self.key, seed + n.to_bytes(4, "big"), hashlib.sha256).digest()
            n += 1

    def of(self, kind: str, entity: str, attempt: int = 0) -> str:
        """The surrogate of an entity, in the same form as entities.

        From the second new draw on each is a character or syllable longer than the one before, so that entities of any
        number find surrogates of their own, also where a form has few.
        """
        draw = self._stream(kind, entity, attempt)
        longer = max(0, attempt - 1)

        def swapped(s: str, keep: int = 0) -> str:
            out = []
            for i, c in enumerate(s):
                if i < keep:
                    out.append(c)
                elif c.isascii() and c.isdigit():
                    out.append(str(next(draw) % 10))
                elif c.isalnum() and not c.isalpha():
                    out.append(str(next(draw) % 10))  # other scripts' digits
                elif c.isalpha():
                    out.append("abcdef"[next(draw) % 6] if kind == "hex" else chr(ord("a") + next(draw) % 26))
                else:
                    out.append(c)
            return "".join(out)

        if kind == "ip":
            if ":" in entity or longer > 1:  # that block and all of IPv4 are full
                return str(ipaddress.IPv6Address(bytes([0xFD, *(next(draw) for _ in range(15))])))
            number = int.from_bytes(bytes(next(draw) for _ in range(4)), "big")
            if longer:
                return str(ipaddress.IPv4Address(number))
            return str(ipaddress.IPv4Address(0xF0000000 | number & 0x0FFFFFFF))  # the reserved block 240.0.0.0/4
        if kind == "email":
            local, _, domain = entity.rpartition("@")
            labels = domain.split(".")
            return f"{swapped(local + 'x' * longer)}@{''.join(swapped(x) + '.' for x in labels[:-2])}example.net"
        if kind == "card":
            digits = swapped(entity + "0" * longer, 1)
            if luhn(entity) != luhn(digits):
                digits = next(d for d in (digits[:-1] + str(x) for x in range(10)) if luhn(d) == luhn(entity))
            return digits
        if kind == "phone":
            return swapped(entity + "0" * longer, max(0, len(entity) - 10))
        if kind == "iban":
            new = swapped(entity + "0" * longer, 2)
            if not iban_valid(entity):
                return new
            rest = int("".join(str(int(c, 36)) for c in new[4:] + new[:2] + "00")) % 97
            return f"{new[:2]}{98 - rest:02d}{new[4:]}"
        if kind == "key":
            return swapped(entity + "x" * longer, 3 if entity.startswith("sk-") else 5 if entity.startswith("xox") else 4)
        if kind.startswith("name-"):  # a stem; its end tells the role, see dressed()
            syllables = SYLLABLES[kind.removeprefix("name-")]
            n = 1 + next(draw) % 2 + longer
            return "".join(syllables[(next(draw) * 256 + next(draw)) % len(syllables)] for _ in range(n))
        return swapped(entity + ("0" if kind == "ssn" else "x") * longer)

    @staticmethod
    def dressed(surrogate: str, mention: str, kind: str, role: str | None = None) -> str:
        """The surrogate with the mention's separators and case; a name's stem with the end of its role."""
        if kind.startswith("name-"):
            ends = ENDS[kind.removeprefix("name-")][role or "s"]
            name = surrogate + ends[sum(map(ord, surrogate)) % len(ends)]
            return name.upper() if mention.isupper() else name.capitalize()
        if kind in ("card", "phone", "ssn"):
            digits = iter(surrogate)
            return "".join([*(next(digits) if c.isdigit() else c for c in mention), *digits])
        if kind in ("iban",):
            rest = iter(surrogate.upper())
            return "".join([*(c if c == " " else next(rest) for c in mention), *rest])
        if mention.isupper():
            return surrogate.upper()
        if len(surrogate) == len(mention) or kind in ("secret", "key", "hex"):
            return "".join(s.upper() if c.isupper() else s for s, c in zip(surrogate, mention.ljust(len(surrogate)), strict=False))
        return surrogate


def entities(docs: DataFrame) -> DataFrame:
    """(key, kind, entity) of each document's distinct entities. docs: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, e) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, e in dict.fromkeys((k, e) for _, _, k, e, _ in found(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["key", "kind", "entity"])

    return docs.mapInArrow(run, "key long, kind string, entity string")


def _taken(distinct: DataFrame) -> DataFrame:
    """(kind, surrogate) that would be an entity of the corpus: the entities themselves, and of names what is left without the end of a role."""
    ends = {script: sorted({x for xs in by_role.values() for x in xs}) for script, by_role in ENDS.items()}
    stems = [F.when((F.col("kind") == f"name-{script}") & F.endswith("entity", F.lit(x)), F.expr(f"left(entity, length(entity) - {len(x)})")) for script, xs in ends.items() for x in xs]
    names = distinct.where("kind like 'name-%'").select("kind", F.explode(F.array_compact(F.array(*stems))).alias("surrogate"))
    return distinct.where("kind not like 'name-%'").select("kind", F.col("entity").alias("surrogate")).union(names).distinct()


def redrawn(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate is another's too, or is itself an entity of the corpus.

    Of those that share a surrogate the smallest keeps it; the others draw again until all surrogates are distinct. Names
    are compared by stem: a stem and an end make one name in one way only, so names of different stems differ.
    """

    @F.pandas_udf("string")
    def surrogate(kind, entity, attempt):
        import pandas as pd

        made = Surrogates(key)
        return pd.Series([made.of(*x) for x in zip(kind, entity, attempt, strict=True)], dtype=object)

    drawn = cut(distinct.select("kind", "entity", F.lit(0).alias("attempt")).withColumn("surrogate", surrogate("kind", "entity", "attempt")))
    real = cut(_taken(distinct))
    while True:
        # settled surrogates win over new ones, then the smaller entity
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = drawn.join(first, ["kind", "surrogate"]).where("first.entity <> entity").select("kind", "entity")
        bad = cut(shared.union(drawn.join(real, ["kind", "surrogate"], "left_semi").select("kind", "entity")).distinct())
        if is_empty(bad):
            return drawn.where("attempt > 0").select("kind", "entity", "attempt")
        marked = drawn.join(bad.withColumn("again", F.lit(1)), ["kind", "entity"], "left")
        again = marked.where("again = 1").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        drawn = cut(marked.where("again is null").select(*drawn.columns).union(again.withColumn("surrogate", surrogate("kind", "entity", "attempt"))))


def pseudonymized(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every detected entity of the text column replaced by its surrogate under the key, and n_entities, the mentions replaced.

    Found are e-mail and IP addresses, phone, card, bank account and social security numbers, keys and secrets, and
    names after titles, with all other capitalized mentions of these names in the same document; of names that are more
    often other words (ORDINARY) only mentions beside another name. Not found are the names of people whom a document
    never gives a title. Names of alphabets without syllables of their own get Latin ones. The same entity has the same surrogate in all documents; different
    ones have different surrogates, none of which is an entity of the corpus: redrawn() checks all distinct entities and
    has colliding ones drawn again, in longer forms if need be. So an entity that collides in one corpus can have another
    surrogate there than under the same key elsewhere; all others have the same one everywhere. A surrogate keeps the type, length (but for those) and
    separators (numbers), the case, the script, and validity of check digits (cards, bank accounts). A name's stem is the
    same in all documents, and its end, one in each document, tells the gender of a given name, or a family name.

    Whoever has the key can tell which surrogate an entity has, so keep it secret. Null texts stay null, with 0 entities.
    All rows and other columns stay as they are; where n_entities is a column already, it is replaced. Rows without an
    id, repeated rows and texts of any length are handled like others; an empty table gives no rows.
    """
    docs = docs.drop("n_entities")
    names = docs.columns
    at, own_id = names.index(text_col), names.index(id_col)
    schema = T.StructType([*(T.StructField(f.name, f.dataType if f.name != text_col else T.StringType()) for f in docs.schema.fields), T.StructField("n_entities", T.LongType())])
    # columns by place, so that no name can clash; rows by id and text, as ids can be null or repeated
    places = [F.col(f"`{c}`").cast("string").alias(f"c{i}") if i == at else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(*places).withColumn("key", F.xxhash64(f"c{own_id}", f"c{at}"))
    per_row = cut(entities(rows.select("key", f"c{at}")))
    again = cut(redrawn(per_row.select("kind", "entity").distinct(), key))
    if is_empty(again):
        rows = rows.select(*(f"c{i}" for i in range(len(names))), F.lit(None).cast("map<string,int>").alias("again"))
    else:
        # a row's own redrawn entities, as many as it has
        pairs = per_row.join(again, ["kind", "entity"]).groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\0", "kind", "entity"), "attempt"))).alias("again"))
        rows = rows.join(pairs, "key", "left").select(*(f"c{i}" for i in range(len(names))), "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        first = Kept(lambda x: made.of(*x))
        for batch in batches:
            texts, counts = [], []
            for text, redraw in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                redraw = dict(redraw or ())
                out, last, n = [], 0, 0
                for start, end, kind, entity, role in found(text or ""):
                    attempt = redraw.get(f"{kind}\0{entity}")
                    surrogate = made.of(kind, entity, attempt) if attempt else first[kind, entity]
                    out += [text[last:start], made.dressed(surrogate, text[start:end], kind, role)]
                    last, n = end, n + 1
                texts.append("".join([*out, text[last:]]) if n else text)
                counts.append(n)
            columns = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, "n_entities"])

    return rows.mapInArrow(run, schema)
