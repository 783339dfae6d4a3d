"""Personal information inside free text, replaced by typed placeholders.

Mail addresses, phone numbers, identity numbers and postal addresses have forms of their own. Names have none:
which terms disclose a person is estimated from the corpus. With c the event that a term stands beside a
protected term of the other role (a given name before a family name), a term t is disclosing when
PMI(t; c) >= share * IC(c), information-theoretic sanitisation's threshold, with PMI(t; c) = log p(t, c) / p(t) p(c)
and IC(c) = -log p(c) from counts over all texts. Disclosing terms that stand together are removed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import count

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.keys import norm_id
from lorekeep.session import cut

KINDS = ("email", "phone", "national_id", "address", "name")

# Forms of mail addresses, numbers and streets in use in public formats.
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_AT = re.compile(r"@|\s?\(@\)\s?|\s?\[@\]\s?|\s?\[at\]\s?|\s?\(at\)\s?", re.I)
_SPELT_AT = re.compile(r"\sat\s", re.I)
_LOCAL_CHARACTER = r"A-Za-z0-9À-ÿ._%+\-"
_LOCAL = re.compile(rf"(?<![\w.+\-])[A-Za-z0-9À-ÿ][{_LOCAL_CHARACTER}]*$")
_NOT_LOCAL = re.compile(rf"[^{_LOCAL_CHARACTER}]")
_DOMAIN = re.compile(rf"(?:{_LABEL}{_DOT})+[A-Za-z]{{2,24}}(?![\w@])(?!:[~/])", re.I)
_SPELT_DOMAIN = re.compile(rf"(?:{_LABEL}\sdot\s)+[A-Za-z]{{2,24}}(?!\w)", re.I)
# Articles stand before names of things. Those that are prepositions in another language are left out.
_ARTICLES = frozenset("the this that der die das dem des ein eine einem einer le la les une el los las una il lo gli uno".split())
# A text without any of these holds no phone or identity number.
_NUMBER_HINT = re.compile(r"\d{6}|\d[ /\-]\(?\d|\)[ .\-]?\d|\d\d\.\d\d\.\d\d|\d{3}\.\d{3}\.\d{4}")
_EXTENSION = r"(?:,?\s?(?:ext\.?|extension|x|durchwahl|poste)\s?\d{1,6})?"
PHONE = re.compile(
    r"(?<![\w+./\-])(?:"
    r"\+\d{1,3}[ .\-]?(?:\(0?\d{1,4}\)[ .\-]?)?\d{1,10}(?:[ .\-/]\d{2,8}){0,5}"
    r"|00\d{2}[ .\-]\d{1,4}(?:[ .\-]\d{2,8}){1,5}"
    r"|(?:1[ .\-]?)?\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,5}"
    r"|(?:1[ .\-])?\d{3}([.\- ])\d{3}\1\d{4}"
    r"|0\d{2,4}/\d{4,9}(?:-\d{1,4})?"
    r"|0\d(?:([ .\-])\d{2})(?:\2\d{2}){3}"
    r"|0\d{4} \d{6}|0\d{4} \d{3} \d{3}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}"
    rf"){_EXTENSION}(?![\w/])(?![.\-]\d)",
    re.I,
)
NATIONAL_ID = re.compile(
    r"(?<![\w.+/\-])(?:"
    r"\d{3}([\- ])\d{2}\1\d{4}"
    r"|\d \d{2} \d{2} \d{2,3} \d{2,3} \d{3} \d{2}|[1-8]\d{14}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]"
    r"|\d{2} \d{3} \d{3} \d{3}|\d{11}"
    r"|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r")(?![\w/])(?![.\-]\d)"
)
_STREET = (
    "street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|drive|dr|court|ct|terrace|place|pl|square|sq|close|crescent|"
    "way|row|hill|parkway|pkwy|highway|hwy|gardens|grove|mews"
)
_RUE = "rue|avenue|boulevard|impasse|place|chemin|allée|quai|cours|route|square|passage"
_CALLE = "calle|avenida|avda|plaza|paseo|camino|carrera"
_GASSE = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "steig", "pfad")
_BOX = "box|postfach|apartado"
_W = r"[^\W\d_][\w.'’\-]*"
# All of these are matched against lower-case text. Each goes with the words without which it cannot match.
_ADDRESSES = (
    (
        frozenset(_STREET.split("|")),
        re.compile(
            rf"(?<![\w.,/\-])\d{{1,5}}[a-z]? (?:{_W} ){{1,4}}?(?:{_STREET})\b\.?(?:,? (?:apt|apartment|unit|suite|ste|flat|fl)\.? ?#?\w{{1,6}})?"
            rf"(?:,\s?|\n)(?:{_W}[ \-]?){{1,4}}(?:,? ?\b[a-z]{{2}} \d{{5}}\b|\b[a-z]{{1,2}}\d{{1,2}}[a-z]? \d[a-z]{{2}}\b)?"
        ),
    ),
    (
        frozenset(_RUE.split("|")),
        re.compile(rf"(?<![\w.,/\-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:{_RUE}) (?:{_W} ?){{1,6}},? ?\d{{5}} {_W}"),
    ),
    (
        frozenset(_CALLE.split("|")),
        re.compile(
            rf"\b(?:{_CALLE})\.? (?:[^\W\d_][\w.'’\-]* ){{1,6}}?(?:n\.?º ?)?\d{{1,4}}\b(?:, ?\d{{1,2}}\.?º ?\w{{1,4}})?(?:, ?\d{{5}} {_W})?"
        ),
    ),
    (
        frozenset(_BOX.split("|")),
        re.compile(r"\b(?:p\.? ?o\.? ?box|post office box|postfach|apartado(?: de correos)?) ?\d{1,6}\b(?:, ?[^\W\d_][^\n,.;()<>\"]{0,40}? \d{5}\b)?"),
    ),
)
_GERMAN = re.compile(
    rf"(?:\b(?:am|an|auf|im|in|zum|zur|unter|hinter)(?: (?:der|dem|den))?(?: {_W})? )?\b[^\W\d_][\w\-]*? ?(?:{'|'.join(_GASSE)})\b\.? \d{{1,4}} ?[a-z]?,? ?\d{{5}} {_W}"
)
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_INITIAL = re.compile(r"\s[^\W\d_]\.(?:\s?[^\W\d_]\.)?\s?$")
_GAP = re.compile(r",?\s")
_MIDDLE = re.compile(r"\s[^\W\d_]\.\s")


def _local_part(text: str, end: int) -> re.Match | None:
    """The local part of a mail address that ends before `end`, of any length."""
    start = end
    while start > 0 and not _NOT_LOCAL.match(text[start - 1]):
        start -= 1
    return _LOCAL.search(text, start, end)


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """Mail addresses around each at-sign, however it is written; ' at ' counts with ' dot ' only."""
    forms = [(_AT, _DOMAIN)] if "@" in text or "at]" in text or "at)" in text else []
    forms += [(_SPELT_AT, _SPELT_DOMAIN)] if " dot " in text else []
    for at, domain in forms:
        for m in at.finditer(text):
            local = _local_part(text, m.start())
            rest = domain.match(text, m.end()) if local else None
            if rest:
                yield local.start(), rest.end(), "email"


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    if _NUMBER_HINT.search(text):
        for m in NATIONAL_ID.finditer(text):
            yield m.start(), m.end(), "national_id"
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 21:
                yield m.start(), m.end(), "phone"


def _addresses(low: str, words: set[str]) -> Iterator[tuple[int, int, str]]:
    for needed, form in _ADDRESSES:
        if not needed.isdisjoint(words):
            for m in form.finditer(low):
                yield m.start(), m.end(), "address"
    if any(w.endswith(_GASSE) for w in words):
        for m in _GERMAN.finditer(low):
            yield m.start(), m.end(), "address"


def lower_in_place(text: str) -> str:
    """Lower case of the same length: a letter whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans without those that overlap an earlier one; of two with one start the longer stays."""
    out: list[tuple[int, int, str]] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def name_mentions(text: str, low: str, given: set[str], family: set[str]) -> list[tuple[int, int, str]]:
    """A family name with a given name or initials beside it, in either order and any letter case."""
    out: list[tuple[int, int, str]] = []
    tokens = [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]
    free = 0
    for i, (start, end, word) in enumerate(tokens):
        if word not in family or start < free:
            continue
        begin, stop = None, end
        before = [t for t in tokens[max(0, i - 3) : i] if t[0] >= free]
        if before and before[-1][2] in given and _is_gap(text[before[-1][1] : start]):
            begin = before[-1][0]
        elif m := _INITIAL.search(" " + text[max(free, start - 8) : start]):
            begin = max(free, start - 8) + m.start()
            lead = [t for t in before if t[1] <= begin]
            if lead and lead[-1][2] in given and not text[lead[-1][1] : begin].strip():
                begin = lead[-1][0]
        if begin is None and i + 1 < len(tokens):
            nxt = tokens[i + 1]
            if nxt[2] in given and _GAP.fullmatch(text[end : nxt[0]]):
                begin, stop = start, nxt[1]
                if m := re.match(r"\s[^\W\d_]\.(?!\w)", text[stop : stop + 4]):
                    stop += m.end()
            elif len(nxt[2]) == 1 and text[nxt[1] : nxt[1] + 1] == "." and _GAP.fullmatch(text[end : nxt[0]]):
                begin, stop = start, nxt[1] + 1
        if begin is not None:
            out.append((begin, stop, "name"))
            free = stop
    return out


def _is_gap(between: str) -> bool:
    return between in (" ", "\n", "\t", " ") or bool(_MIDDLE.fullmatch(between))


def mentions(text: str, given: set[str], family: set[str]) -> list[tuple[int, int, str]]:
    """All mentions in order of position, without overlaps."""
    low = lower_in_place(text)
    words = set(WORD.findall(low))
    forms = _apart([*_emails(text), *_numbers(text), *_addresses(low, words)])
    names = [] if family.isdisjoint(words) else name_mentions(text, low, given, family)
    return sorted(forms + [n for n in names if all(n[1] <= f[0] or n[0] >= f[1] for f in forms)])


def split_name(mention: str) -> tuple[str | None, str | None]:
    """(given, family) of a labelled name: 'Family, Given', 'FAMILY Given' or 'Given [Initial] Family'."""
    if "," in mention:
        family, given = (x.split() for x in mention.split(",", 1))
    else:
        words = mention.split()
        turned = len(words) > 1 and words[0].isupper() and len(words[0]) > 2 and not words[-1].isupper()
        family, given = (words[:1], words[1:]) if turned else (words[-1:], words[:-1])
    plain = [w.lower() for w in given if not w.endswith(".") and len(w) > 1]
    return (plain[0] if plain else None), (family[0].lower() if family else None)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side of the corpus statistics: occurrences of each term, counted per batch."""
    for batch in batches:
        n: Counter = Counter()
        for text in batch.column("text").to_pylist():
            n.update(WORD.findall(lower_in_place(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])


def _count_beside(known):
    """known holds all given and family names, the new ones of both, and an automaton of the new ones. Occurrences of each term beside each newly protected term (as_given: before a family name, as_family: after a
    given name), with how many of these are written like a name (capital, nothing but a gap between) and how many
    follow an article; per batch. Only texts that hold a new term are cut into words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, family, new_given, new_family, found_here = known.value
        for batch in batches:
            beside: dict[tuple, list[int]] = {}
            for text in batch.column("text").to_pylist():
                low = lower_in_place(text)
                if next(found_here.iter(low), None) is None:
                    continue
                tokens = [(m.start(), m.end(), m.group()) for m in WORD.finditer(low)]
                for i in range(len(tokens) - 1):
                    j = i + 2 if len(tokens[i + 1][2]) == 1 and i + 2 < len(tokens) else i + 1
                    (start, end, a), (next_start, _, b) = tokens[i], tokens[j]
                    if b not in new_family and a not in new_given:
                        continue
                    article = i > 0 and tokens[i - 1][2] in _ARTICLES and text[tokens[i - 1][1] : start].isspace()
                    gap = (b in family or a in given) and _is_gap(text[end:next_start])
                    for key, at, there in (((a, "as_given", b), start, b in new_family), ((b, "as_family", a), next_start, a in new_given)):
                        if there:
                            counts = beside.setdefault(key, [0, 0, 0])
                            counts[0] += 1
                            counts[1] += gap and text[at].isupper()
                            counts[2] += article
            rows = [(*k, *c) for k, c in beside.items()]
            kinds = [pa.string()] * 3 + [pa.int64()] * 3
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "role", "partner", "n", "named", "article"])

    return run


def _any_of(terms: set[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in terms:
        automaton.add_word(term, True)
    automaton.make_automaton()
    return automaton


class Sanitiser:
    """Finds and replaces personal information in texts (source, id, field, text).

    labels (source, id, field, kind, mention) is a hand-labelled sample; at most label_rows of its names, drawn
    by a hash, give the first protected terms. Further ones are found by co-occurrence over all texts, in passes
    until one finds none (or `rounds` passes, if given). A product named after a person also stands beside a
    protected term, but beside one only (each pass counts the neighbours of newly protected terms only, in the texts
    that hold one, and adds them to what is known): a term of less than least_partners different ones is accepted by the
    pair it is in, if most of its places there are written like a name and at most `articles` of them follow an
    article, which names in a corpus hardly ever do. Null and empty
    texts hold no mention; extra columns are ignored; without labels no names are found, the other kinds are.
    The list of disclosing terms is broadcast; more than most_terms is an error rather than a silent cut.
    """

    def __init__(self, texts: DataFrame, labels: DataFrame, share: float = 0.85, rounds: int | None = None, least_partners: int = 3, articles: float = 0.1, label_rows: int = 50_000, most_terms: int = 2_000_000):
        self.texts = texts.select("source", "id", "field", "text").where("text <> ''")
        self.spark = texts.sparkSession
        named = labels.where("kind = 'name' and mention is not null").select("mention").distinct()
        sample = named.orderBy(F.xxhash64("mention"), "mention").limit(label_rows).collect()
        split = [split_name(r["mention"]) for r in sample]
        given, family = set(), set()
        new = {g for g, _ in split if g}, {f for _, f in split if f}
        beside = None
        for done in count():
            given, family = given | new[0], family | new[1]
            if not given or not family or not (new[0] or new[1]) or done == rounds:
                break
            if beside is None:
                terms = cut(self.texts.select("text").mapInArrow(_term_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
                n_words = terms.agg(F.sum("n")).first()[0]
            known = self.spark.sparkContext.broadcast((given, family, *new, _any_of(new[0] | new[1])))
            fresh = self.texts.select("text").mapInArrow(_count_beside(known), "term string, role string, partner string, n long, named long, article long")
            fresh = cut(fresh.groupBy("term", "role", "partner").agg(*(F.sum(c).alias(c) for c in ("n", "named", "article"))), "beside")
            beside = fresh if beside is None else beside.unionByName(fresh)
            per_term = beside.groupBy("term", "role").agg(F.count("*").alias("partners"), *(F.sum(c).alias(c) for c in ("n", "named", "article")))
            total = {r["role"]: r["n"] for r in per_term.groupBy("role").agg(F.sum("n").alias("n")).collect()}
            # PMI >= share * IC, as p(c | t) >= p(c) ** (1 - share)
            least = F.lit(None).cast("double")
            for role, n in total.items():
                least = F.when(F.col("role") == role, math.exp(-(1 - share) * math.log(n_words / n))).otherwise(least)
            like_name = (2 * F.col("named") > F.col("n")) & (F.col("article") <= articles * F.col("n"))
            counted = per_term.join(terms.withColumnRenamed("n", "n_term"), "term")
            disclosing = counted.where(((F.col("partners") >= least_partners) | like_name) & (F.col("n") >= least * F.col("n_term")) & (F.length("term") > 1))
            found = disclosing.select("term", "role").limit(2 * most_terms + 1).collect()
            if len(found) > 2 * most_terms:
                raise ValueError(f"more than {most_terms} disclosing terms")
            new = {r["term"] for r in found if r["role"] == "as_given"} - given, {r["term"] for r in found if r["role"] == "as_family"} - family
        self.given, self.family = given, family

    def _spans(self):
        return self.spark.sparkContext.broadcast((self.given, self.family))

    def found(self) -> DataFrame:
        """(source, id, field, kind, nth, start, end): every mention; nth numbers those of its kind in its field."""
        terms = self._spans()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: tuple[list, ...] = tuple([] for _ in range(7))
                keys = zip(*(batch.column(c).to_pylist() for c in ("source", "id", "field")), strict=True)
                for key, text in zip(keys, batch.column("text").to_pylist(), strict=True):
                    nth: Counter = Counter()
                    for start, end, kind in mentions(text, *terms.value):
                        nth[kind] += 1
                        for column, value in zip(rows, (*key, kind, nth[kind], start, end), strict=True):
                            column.append(value)
                kinds = (*[pa.string()] * 4, *[pa.int64()] * 3)
                names = ["source", "id", "field", "kind", "nth", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

        return self.texts.mapInArrow(run, "source string, id string, field string, kind string, nth long, start long, end long")

    def replaced(self) -> DataFrame:
        """(source, id, field, text, n_mentions): every text with its mentions replaced by [EMAIL], [PHONE],
        [NATIONAL_ID], [ADDRESS] and [NAME]; all else is unchanged."""
        terms = self._spans()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, counts = [], []
                for text in batch.column("text").to_pylist():
                    parts, at = [], 0
                    spans = mentions(text, *terms.value)
                    for start, end, kind in spans:
                        parts += [text[at:start], f"[{kind.upper()}]"]
                        at = end
                    out.append("".join(parts) + text[at:])
                    counts.append(len(spans))
                columns = [*(batch.column(c) for c in ("source", "id", "field")), pa.array(out, pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["source", "id", "field", "text", "n_mentions"])

        return self.texts.mapInArrow(run, "source string, id string, field string, text string, n_mentions long")


def record_texts(notes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(source, id, field, text), each repeated row once; blank ids are left out."""
    fields = ((notes, "notes", "content"), (sessions, "sessions", "summary"), (sessions, "sessions", "what_happened"))
    parts = [
        df.select(F.lit(source).alias("source"), norm_id(F.col("id")).alias("id"), F.lit(field).alias("field"), F.col(field).alias("text"))
        for df, source, field in fields
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.where("id is not null and text <> ''")
