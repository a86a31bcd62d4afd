"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Every distinct entity gets a draw keyed by a secret; draws that coincide with another entity's or
with a real entity are drawn again, so different entities stay different, and an entity reads the
same wherever it occurs.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from propflow.session import materialize

KEY = b"change this key"
LIST_DRAWS = 2  # draws from the name lists before names are composed

# Given names by script and gender, courtesy titles by gender.
GIVEN = {
    ("latin", "f"): "Maria Anna Laura Sophie Julia Clara Elena Emma Alice Sarah Camille Carmen Ingrid Helga Lucia".split(),
    ("latin", "m"): "John Peter Thomas David Michael Paul Martin Carlos Pierre Hans Jorge Robert James Louis Klaus".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Николай".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Πέτρος Ανδρέας".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Mme Frau Señora Sra Madame".split(),
    "m": "Mr Herr Señor Sr Monsieur".split(),
    "n": "Dr Prof".split(),
}
SYLLABLES = {
    "latin": "ba ren del mor ti lan so ver ka nis ro ham el dor fi gan".split(),
    "cyrillic": "ба рен дел мор ти лан со вер ка нис ро хам".split(),
    "greek": "βα ρεν δελ μορ τι λαν σο βερ κα νισ ρο".split(),
}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ий", ("greek", "f"): "α", ("greek", "m"): "ος"}

_GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_CAP = r"[^\W\d_a-zà-ÿа-яα-ω][^\W\d_A-ZÀ-ÞА-ЯΑ-Ω]+"
_TITLE = "|".join(t for names in TITLES.values() for t in names)
_FIRST = "|".join(sorted(_GENDER, key=len, reverse=True))
_KINDS = (
    r"(?P<email>[A-Za-z0-9][\w.+-]*@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]))"
    r"|(?P<secret>-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[^-]*-----END [A-Z0-9 ]*PRIVATE KEY-----"
    r"|(?<!\w)eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*(?![\w-])"
    r"|(?<!\w)(?:gh[pousr]_[0-9A-Za-z]{20,}|github_pat_\w{20,}|sk-[\w-]{20,}|xox[abeoprs]-[0-9A-Za-z-]{10,})(?![\w-])"
    r"|(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![0-9A-Za-z])|AKIA[0-9A-Z]{16})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<!\d)\d{3}-\d{2}-\d{4}(?!\d))"
    r"|(?P<card>(?<!\d)(?:\d{4}[ -]?){3}\d{1,7}(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)"
    r"|(?<![\w.+-])\d{3}(?P<gap>[ .-])\d{3}(?P=gap)\d{4}(?![\w-])"
    r"|(?<![\w.+-])(?=(?:[ /.-]?\d){9,12}(?![\d/]))0\d{1,4}[ /.-]\d{3,8}(?:[ .-]\d{2,4}){0,3}(?![\w-]))"
)
_CARD = re.compile(r"(?<![\w+])(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)(?!\w)")
_PREFIX = re.compile(r"gh[pousr]_|github_pat_|sk-|xox[abeoprs]-|eyJ|-----[^-]+-----")
_QUICK = re.compile(rf"[@\d]|AKIA|-----BEGIN |eyJ|gh[pousr]_|github_pat_|sk-|xox[abeoprs]-|\b(?:{_TITLE}|{_FIRST})\b")
PATTERN = re.compile(
    _KINDS
    + rf"|(?P<person>\b(?:(?P<title>{_TITLE})\.?(?: (?:{_TITLE})\b\.?)* (?:(?P<given>{_FIRST}) )?(?P<last>(?!(?:{_TITLE})\b){_CAP})|(?P<given2>{_FIRST}) (?P<last2>{_CAP}))\b)"
)


def script_of(word: str) -> str:
    head = word[0]
    return "cyrillic" if "Ѐ" <= head <= "ӿ" else "greek" if "Ͱ" <= head <= "Ͽ" else "latin"


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value), in order and apart; persons as given and last names."""
    if not _QUICK.search(text):
        return []
    found = []
    for m in PATTERN.finditer(text):
        if m.group("person"):
            given, last = ("given", "last") if m.group("last") else ("given2", "last2")
            gender = next((g for g, names in TITLES.items() if m.group("title") in names), "n")
            if m.group(given):
                script, gender = _GENDER[m.group(given)]
                found.append((*m.span(given), f"given_{gender}_{script}", m.group(given)))
            found.append((*m.span(last), f"last_{script_of(m.group(last))}", m.group(last)))
            continue
        kind = next(k for k in ("email", "ip", "ipv6", "secret", "iban", "ssn", "card", "phone") if m.group(k))
        if kind == "ipv6" and not _is_ipv6(m.group()):
            continue
        found.append((*m.span(), "ip" if kind == "ipv6" else kind, m.group()))
    # cards in any grouping: what holds one whole stays, what only touches one gives way
    for m in _CARD.finditer(text):
        if _luhn(re.sub("[ -]", "", m.group())[:-1]) == int(m.group()[-1]):
            start, end = m.span()
            touching = [f for f in found if f[0] < end and f[1] > start]
            if not any(f[0] <= start and f[1] >= end for f in touching):
                found = sorted([f for f in found if f not in touching] + [(start, end, "card", m.group())])
    return _with_mentions(text, found)


def _with_mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The entities with every other mention of a found name as a whole word that starts with a capital."""
    names: dict[str, str] = {}
    for _, _, kind, value in found:
        if kind.startswith(("given", "last")):
            names.setdefault(value.casefold(), kind)
    if not names:
        return found
    starts, more = [f[0] for f in found], []
    anywhere = re.compile(rf"\b(?:{'|'.join(re.escape(n) for n in sorted(names, key=len, reverse=True))})\b", re.IGNORECASE)
    for m in anywhere.finditer(text):
        before = bisect_right(starts, m.start()) - 1
        kind = names.get(m.group().casefold())
        apart = (before < 0 or found[before][1] <= m.start()) and (before + 1 == len(found) or starts[before + 1] >= m.end())
        if kind and apart and m.group()[0].isupper():
            more.append((*m.span(), kind, m.group()))
    return sorted(found + more)


def _is_ipv6(value: str) -> bool:
    try:
        return ipaddress.IPv6Address(value) is not None
    except ValueError:
        return False


class _Draw:
    """A stream of numbers from the key, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}|{value}|{attempt}".encode(), hashlib.sha256).digest()
        self.at = 0

    def below(self, n: int) -> int:
        self.at += 1
        block = hmac.new(self.seed, self.at.to_bytes(4, "big"), hashlib.sha256).digest()
        return int.from_bytes(block[:8], "big") % n


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The replacement of a canonical value, in canonical form."""
    draw = _Draw(key, kind, value, attempt)
    if kind == "ip" and ":" in value:
        return "".join(c if c == ":" else "123456789abcdef"[draw.below(15)] for c in value)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in value.split("."))
    if kind.startswith(("given", "last")):
        parts = kind.split("_")
        script = parts[-1]
        if parts[0] == "given" and attempt < LIST_DRAWS:
            names = GIVEN[script, parts[1]]
            return names[draw.below(len(names))].casefold()
        stem = "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(3 + attempt // 4))
        return stem + (ENDINGS[script, parts[1]] if parts[0] == "given" else "")
    if kind == "email":
        local, _, domain = value.partition("@")
        host = _Draw(key, "domain", domain, 0)  # addresses of one domain stay together
        fake = "".join(chr(97 + draw.below(26)) if c.isalpha() else str(draw.below(10)) if c.isdigit() else c for c in local)
        fake += "".join(chr(97 + draw.below(26)) for _ in range(attempt // 4))
        return f"{fake}@{''.join(chr(97 + host.below(26)) for _ in range(12))}.example.{domain.rsplit('.', 1)[-1]}"
    keep, tail = {"iban": 4, "phone": 2, "card": 1}.get(kind, 0), len(value)
    if kind == "secret" and (prefix := _PREFIX.match(value)):
        keep = prefix.end()
        tail = value.index("-----END") if value.startswith("-----") else tail
    hexes = "0123456789abcdef"
    out = []
    for i, c in enumerate(value):
        if i < keep or i >= tail or not c.isalnum():
            out.append(c)
        elif kind == "secret" and c.lower() in hexes and not value.startswith("AKIA"):
            x = hexes[draw.below(16)]
            out.append(x.upper() if c.isupper() else x)
        elif c.isdigit():
            out.append(str(draw.below(10)))
        else:
            out.append(chr((65 if c.isupper() else 97) + draw.below(26)))
    if kind == "phone" and not value.startswith(("+", "(", "0")):
        out[0] = str(2 + draw.below(8))
    if kind == "card" and _luhn(value[:-1]) == int(value[-1]):
        out[-1] = str(_luhn("".join(out[:-1])))
    return "".join(out)


def in_format(value: str, replacement: str) -> str:
    """A canonical replacement with the separators and the letter case of the text."""
    if len(value) > len(replacement) == len(re.sub(r"[ ./-]", "", value)) and not re.search(r"[ ./-]", replacement):
        rest = iter(replacement)
        if not any(c.isalpha() for c in replacement) or any(c in " -" for c in value):
            return "".join(c if c in " ./-" else next(rest) for c in value)
    if value.isupper():
        return replacement.upper()
    return replacement[:1].upper() + replacement[1:] if value[:1].isupper() and value[1:].islower() else replacement


_SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def _detect(batches):
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    for batch in batches:
        spans = []
        for text in batch.column("text"):
            found = find_entities(text.as_py() or "")
            spans.append([dict(zip(("start", "end", "kind", "value"), f, strict=True)) for f in found])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, kinds)], ["row", "spans"])


def _drawn(batches, key: bytes):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "canon", "attempt")), strict=True)
        yield batch.append_column("fake", pa.array([surrogate(key, *row) for row in rows], pa.string()))


def _formatted(batches):
    for batch in batches:
        pairs = zip(batch.column("value").to_pylist(), batch.column("fake").to_pylist(), strict=True)
        at = batch.schema.get_field_index("fake")
        yield batch.set_column(at, "fake", pa.array([in_format(v, f) for v, f in pairs], pa.string()))


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, fake) for distinct (kind, canon), no replacement used twice or itself real."""
    schema = "kind string, canon string, attempt int, fake string"
    draw = lambda rows: rows.mapInArrow(lambda batches: _drawn(batches, key), schema)
    settled, open_ = None, entities.withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("canon").alias("fake"), F.lit(True).alias("real"))
    while True:
        drawn = materialize(draw(open_.select("kind", "canon", "attempt")))
        taken = real if settled is None else real.unionByName(settled.select("kind", "fake", F.lit(True).alias("real")))
        judged = drawn.join(taken.distinct(), ["kind", "fake"], "left")
        # a replacement drawn by several goes to the first of them
        judged = judged.withColumn("turn", F.row_number().over(W.partitionBy("kind", "fake").orderBy("canon")))
        free = F.col("real").isNull() & (F.col("turn") == 1)
        judged = materialize(judged.withColumn("free", free))
        won = judged.where("free").select("kind", "canon", "fake")
        settled = won if settled is None else settled.unionByName(won)
        open_ = judged.where("not free").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return settled


def replace_entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """All rows and columns, `text` with surrogates, and `n_entities`.

    Null and empty texts stay as they are with no entities; equal rows are replaced alike. A column
    named `n_entities` gives way to the count. A name found once in a text is replaced wherever the
    text has it as a word with a capital, alone or in capitals. Entities are joined to their
    replacements as rows, so one that occurs everywhere is split like any skewed join; whole texts
    move once, to meet their replacements.
    """
    # 128 bits: no row takes another's spans, however many there are
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x1f"), "text")))
    found = docs.where("text is not null").select(row.alias("row"), "text").mapInArrow(_detect, f"row binary, spans {_SPANS}")
    found = materialize(found.where(F.size("spans") > 0).dropDuplicates(["row"]))
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    # spellings of one entity: case in names and addresses, separators in numbers
    low = (F.col("kind") == "email") | F.col("kind").rlike("^(given|last)")
    numbers = F.col("kind").isin("card", "phone", "iban", "ssn")
    canon = F.when(low, F.lower("value")).when(numbers, F.regexp_replace("value", "[ ./-]", "")).otherwise(F.col("value"))
    spans = spans.withColumn("canon", canon)
    fakes = assign(materialize(spans.select("kind", "canon").distinct()), key)
    joined = spans.join(fakes, ["kind", "canon"]).select("row", "start", "end", "value", "fake")
    joined = joined.mapInArrow(_formatted, joined.schema)
    cuts = joined.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "fake"))).alias("_cuts"))
    both = docs.withColumn("_key", row).join(cuts, F.col("_key") == F.col("_row"), "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, cut):
        between = F.substring(F.col("text"), acc["at"] + 1, cut["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], between, cut["fake"]).alias("out"), cut["end"].alias("at"))

    done = F.aggregate("_cuts", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(done)
    kept = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "n_entities"]
    return both.select(*kept, F.coalesce(F.size("_cuts"), F.lit(0)).alias("n_entities"))
