"""Personal data replaced by keyed surrogates of the same type.

Detected entities are brought to a canonical form, so that all spellings of one entity get one surrogate everywhere
(coreference). A surrogate is drawn from an HMAC of the entity under a secret key and keeps type, length, script,
letter case, separators and, for forenames, gender. Surrogates are checked over the whole corpus: one that another
entity has got, or that is itself an entity of the corpus, is drawn again with the next attempt number, so different
entities stay different and nobody's real data is a surrogate.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import checkpointed, name_beside, stored

#: Redrawn surrogates up to this number travel with the task; beyond it documents join those they need.
CARRIED = 50_000
#: Draws for one entity before the space of its format counts as full.
ATTEMPTS = 200
#: Draws after which names and mailboxes get one letter more, so that short ones never run out.
GROWS_AFTER = 8

# Titles that show a gender, titles that do not, and forenames by gender.
MALE_TITLES = ("Mr", "Herr", "Señor", "Monsieur", "Sir", "господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "госпожа")
TITLES = ("Dr", "Prof", "Doctor", "Professor", "Docteur", "Doktor", "Doctora", "доктор")
MALE = ("Adam", "Anton", "Bruno", "Carl", "Daniel", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Lucas",
        "Marc", "Martin", "Noah", "Oscar", "Paul", "Peter", "Simon", "Thomas", "Victor")
FEMALE = ("Alice", "Anna", "Carla", "Clara", "Diana", "Elena", "Emma", "Eva", "Helena", "Ida", "Julia", "Laura", "Lea",
          "Lisa", "Maria", "Marta", "Nina", "Nora", "Olga", "Paula", "Rosa", "Sara")
#: Lower-case letters (first, last) of the scripts whose letters are drawn among their own.
SCRIPTS = (("а", "я"), ("α", "ρ"), ("א", "ת"), ("ا", "ي"), ("ぁ", "ん"), ("ァ", "ン"), ("一", "龠"), ("가", "힣"))

_NAME = r"[^\W\d_][^\W\d_'-]+"
_TITLE = rf"(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + TITLES)})\b\.?"
_PART = rf"(?: (?={_NAME})(?-i:[^\W\d_a-zà-ÿ])[^\W\d_'-]+)"
ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[\w+-](?:[\w.+-]*[\w+-])?@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))"
    r"|(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d.-])\d{3}(?P<sep>[ .-])\d{3}(?P=sep)\d{4}(?![\d-]|\.\d))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]))"
    r"|(?P<number>(?<![\d-])(?:\d{3}-\d{2}-\d{4}|\d{9})(?!-?\d))"
    rf"|(?P<title>\b{_TITLE}(?: +{_TITLE})*) +(?P<names>{_NAME}{_PART}{{0,3}})")

#: Every entity holds one of these; most texts hold none and are looked at no further.
SIGN = re.compile(rf"[@\d]|::|\b(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + TITLES)})\b")


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _gender(title: str, forename: str) -> str:
    """By the title, else by the forename; 'forename' where neither tells."""
    titles = re.split(r"\.? +|\.$", title)
    if any(t in MALE_TITLES for t in titles):
        return "male"
    if any(t in FEMALE_TITLES for t in titles):
        return "female"
    name = forename.capitalize()
    return "male" if name in MALE else "female" if name in FEMALE else "forename"


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the personal data in a text, left to right.

    A name of up to four parts after a title gives a surname and forenames of the title's gender; after a title that
    shows none the forename tells. Wherever a surname so found stands again in the text as a capitalised word, it is a
    mention, too, with or without a title. Phones have a country code, an area code in brackets or the form 3-3-4.
    """
    out: list[tuple[int, int, str, str]] = []
    if not text or not SIGN.search(text):
        return out
    surnames = set()
    for m in ENTITY.finditer(text):
        kind, found = m.lastgroup, m.group()
        if kind == "email":
            out.append((m.start(), m.end(), kind, found.lower()))
        elif kind == "ip":
            out.append((m.start(), m.end(), kind, ".".join(str(int(p)) for p in found.split("."))))
        elif kind == "ip6":
            try:
                out.append((m.start(), m.end(), kind, ipaddress.IPv6Address(found).exploded))
            except ValueError:  # a time of day, a ratio
                continue
        elif kind == "phone":  # with or without country code: the last ten digits name the line
            out.append((m.start(), m.end(), kind, _digits(found)[-10:]))
        elif kind in ("card", "number"):
            out.append((m.start(), m.end(), kind, _digits(found)))
        else:
            at, parts = m.start("names"), m["names"].split(" ")
            if not parts[0][0].isupper() and parts[0][0].lower() != parts[0][0].upper():
                continue
            for part in parts[:-1]:
                out.append((at, at + len(part), _gender(m["title"], part), part.lower()))
                at += len(part) + 1
            out.append((at, m.end("names"), "surname", parts[-1].lower()))
            surnames.add(parts[-1])
    return _with_mentions(text, out, surnames) if surnames else out


def _with_mentions(text: str, found: list[tuple], surnames: set[str]) -> list[tuple]:
    """``found`` and the words between that are one of the surnames."""
    out, end = [], 0
    for a, b, kind, canonical in [*found, (len(text), len(text), None, None)]:
        for m in re.finditer(rf"(?<![\w'-]){_NAME}", text[end:a]):
            if m.group() in surnames and m.group()[0].isupper():
                out.append((end + m.start(), end + m.end(), "surname", m.group().lower()))
        if kind:
            out.append((a, b, kind, canonical))
        end = b
    return out


def _stream(secret: str, *parts) -> Iterator[int]:
    """Keyed bytes without end."""
    block = 0
    while True:
        message = "\x00".join([*map(str, parts), str(block)])
        yield from hmac.new(secret.encode(), message.encode("utf-8", "replace"), hashlib.sha256).digest()
        block += 1


def _letter(old: str, draw: int) -> str:
    for low, high in SCRIPTS:
        if low <= old <= high:
            return chr(ord(low) + draw % (ord(high) - ord(low) + 1))
    return chr(ord("a") + draw % 26)


def _scrambled(text: str, draws: Iterator[int]) -> str:
    """Letters for letters of the same script, digits for digits, a digit other than 0 for a leading one."""
    out = []
    for i, c in enumerate(text):
        draw = next(draws) * 256 + next(draws)
        if c.isdigit():
            lead = c != "0" and (i == 0 or not text[i - 1].isdigit())
            out.append(str(1 + draw % 9) if lead else str(draw % 10))
        else:
            out.append(_letter(c, draw) if c.isalpha() else c)
    return "".join(out)


def _more(draws: Iterator[int], attempt: int, like: str = "a") -> str:
    """Letters of the script of ``like`` behind a stand-in, one for every ``GROWS_AFTER`` draws made in vain."""
    return "".join(_letter(like, next(draws) * 256 + next(draws)) for _ in range(attempt // GROWS_AFTER))


def surrogate(secret: str, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of an entity's stand-in; each attempt draws another one."""
    draws = _stream(secret, kind, canonical, attempt)
    if kind == "email":  # one domain has one surrogate, its last label stays
        local, domain = canonical.rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return f"{_scrambled(local, draws)}{_more(draws, attempt)}@{_scrambled(name, _stream(secret, 'domain', domain))}.{top}"
    if kind == "ip":
        return ".".join(str(1 + next(draws) % 254) for _ in range(4))
    if kind == "ip6":  # groups of zeros stay, the others keep their length
        groups = (g.lstrip("0") for g in canonical.split(":"))
        new = ["".join("0123456789abcdef"[next(draws) % 15 + 1 if i == 0 else next(draws) % 16] for i in range(len(g)))
               for g in groups]
        if attempt >= GROWS_AFTER:  # an address of few digits: all of the last group
            new[-1] = f"{1 + (next(draws) * 256 + next(draws)) % 65535:x}"
        return ipaddress.IPv6Address(":".join(g or "0" for g in new)).exploded
    if kind in ("male", "female") and canonical.isascii():
        names = MALE if kind == "male" else FEMALE
        end = "".join("aeiou"[next(draws) % 5] + "lnrst"[next(draws) % 5] for _ in range(attempt))
        return (names[(next(draws) * 256 + next(draws)) % len(names)] + end).lower()
    drawn = _scrambled(canonical, draws)
    if kind in ("male", "female", "forename", "surname"):
        drawn += _more(draws, attempt, canonical[-1])
    if kind == "card" and luhn(canonical):
        drawn = next(drawn[:-1] + str(d) for d in range(10) if luhn(drawn[:-1] + str(d)))
    return drawn


def shown(kind: str, old: str, new: str) -> str:
    """A surrogate in the spelling of the text it replaces: separators and letter case."""
    if kind in ("phone", "card", "number"):
        out, left = list(old), len(new)
        for i in range(len(old) - 1, -1, -1):
            if old[i].isdigit() and left:
                left -= 1
                out[i] = new[left]
        return "".join(out)
    if kind == "email":
        cases = old.rjust(len(new), "a")  # a longer mailbox: the case follows the end
        return "".join(n.upper() if o.isupper() else n for o, n in zip(cases, new))
    if kind == "ip6":
        short = ipaddress.IPv6Address(new).compressed
        return short.upper() if old.isupper() else short
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def replace(text: str | None, secret: str, attempts) -> tuple[str | None, list[tuple]]:
    """The text with surrogates and their spans (start, end, type); ``attempts`` maps (type, canonical)."""
    out, spans, end, size = [], [], 0, 0
    for a, b, kind, canonical in entities(text):
        new = shown(kind, text[a:b], surrogate(secret, kind, canonical, attempts.get((kind, canonical), 0)))
        out += [text[end:a], new]
        size += a - end
        spans.append((size, size + len(new), kind))
        size, end = size + len(new), b
    return (text if not out else "".join(out) + text[end:]), spans


def settle(found: DataFrame, secret: str) -> DataFrame:
    """(kind, canonical, attempt) with attempt > 0, for the entities whose first surrogate is not theirs to keep.

    Of the entities that draw one surrogate the smallest keeps it, unless another has settled on it before or it is an
    entity of the corpus; the others draw again.
    """

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(secret, *row) for row in zip(kind, canonical, attempt)])

    todo = found.select("kind", "canonical", F.lit(0).alias("attempt"))
    real = found.select("kind", F.col("canonical").alias("made"))
    settled = None
    for attempt in range(ATTEMPTS):
        made = todo.withColumn("made", drawn("kind", "canonical", "attempt"))
        free = made.join(real, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "made"), ["kind", "made"], "left_anti")
        owner = free.groupBy("kind", "made").agg(F.min("canonical").alias("canonical"))
        good = checkpointed(owner.withColumn("attempt", F.lit(attempt)).select("kind", "canonical", "attempt", "made"))
        settled = good if settled is None else checkpointed(settled.unionByName(good))
        todo = checkpointed(todo.join(good, ["kind", "canonical"], "left_anti").withColumn("attempt", F.lit(attempt + 1)))
        if todo.isEmpty():
            return settled.filter("attempt > 0").select("kind", "canonical", "attempt")
    raise RuntimeError("the format of some entities leaves no room for different surrogates")


def pseudonymised(df: DataFrame, text: str, secret: str) -> DataFrame:
    """``df`` with its ``text`` replaced and ``entities`` added: array of (start, end, type) in the new text.

    Surrogates depend on the secret and the entity alone, but for redrawn ones, which depend on the corpus. Null and
    empty texts stay as they are, with no entities; a column called ``entities`` is replaced.
    """
    df = df.drop("entities")
    texts = df.select(F.col(text).alias("t")).filter(F.col("t").isNotNull())

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {(kind, canonical) for t in batch["t"] for _, _, kind, canonical in entities(t)}
            yield pd.DataFrame(sorted(found), columns=["kind", "canonical"])

    found = stored(texts.mapInPandas(detect, "kind string, canonical string").distinct(), "surrogates-entities")
    again = checkpointed(settle(found, secret))
    own, new = (name_beside(df, n) for n in ("redrawn", "replaced"))
    schema = "struct<text:string,entities:array<struct<start:int,end:int,type:string>>>"
    if again.count() <= CARRIED:  # counted just now; rows are a type, an entity and a number
        carried = {(r["kind"], r["canonical"]): r["attempt"] for r in again.collect()}

        @F.pandas_udf(schema)
        def rewrite(texts: pd.Series) -> pd.DataFrame:
            return _frame(replace(t, secret, carried) for t in texts)

        done = df.withColumn(new, rewrite(F.col(text)))
    else:
        def mentioned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(h, kind, canonical) for h, t in zip(batch["h"], batch["t"])
                        for kind, canonical in {e[2:] for e in entities(t)}]
                yield pd.DataFrame(rows, columns=["h", "kind", "canonical"])

        needed = (texts.select(F.sha2("t", 256).alias("h"), "t")
                  .mapInPandas(mentioned, "h string, kind string, canonical string").distinct()
                  .join(again, ["kind", "canonical"])
                  .groupBy("h").agg(F.collect_list(F.concat_ws("\x00", "kind", "canonical", "attempt")).alias(own)))

        @F.pandas_udf(schema)
        def rewrite_with(texts: pd.Series, redrawn: pd.Series) -> pd.DataFrame:
            def attempts(rows):
                parts = (r.split("\x00") for r in (rows if rows is not None else ()))
                return {(k, c): int(n) for k, c, n in parts}
            return _frame(replace(t, secret, attempts(r)) for t, r in zip(texts, redrawn))

        hashed = name_beside(df, "h")
        done = (df.withColumn(hashed, F.sha2(text, 256)).join(needed.withColumnRenamed("h", hashed), hashed, "left")
                .withColumn(new, rewrite_with(F.col(text), F.col(own))))
    return (done.withColumn(text, F.col(f"{new}.text")).withColumn("entities", F.col(f"{new}.entities"))
            .select(*df.columns, "entities"))


def _frame(rows) -> pd.DataFrame:
    rows = list(rows)
    return pd.DataFrame({"text": [t for t, _ in rows],
                         "entities": [[{"start": a, "end": b, "type": k} for a, b, k in s] for _, s in rows]})
